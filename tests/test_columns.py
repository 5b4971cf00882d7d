import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import columns as C
from tokenloom.plans import registry as R


def values(spark, kind, data, column):
    rows = [(i, x) for i, x in enumerate(data)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_lengths_are_utf16_units(spark):
    assert values(spark, "string", ["a😀b", "", "é"], C.utf16_length("x")) == [4, 0, 1]
    assert values(spark, "string", ["a😀b", "", "abcde"], C.heuristic_tokens("x", 2.5)) == [2, 0, 2]


def fixed(x: float, digits: int) -> str:
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def test_fixed_decimals_follow_the_exact_binary_value(spark):
    r = random.Random(1)
    xs = [0.0, 0.05, 0.25, 1.45, 1.25, 999.95, 0.15, 1e9, 0.125, 1e12 + 0.5]
    xs += [r.uniform(0, 10 ** r.randint(-3, 12)) for _ in range(1000)] + [r.randint(0, 10**6) / 1000 for _ in range(1000)] + [k / 8 for k in range(400)]
    for digits in (0, 1, 2):
        assert values(spark, "double", xs, C.to_fixed("x", digits)) == [fixed(x, digits) for x in xs]


def test_short_numbers(spark):
    ns = {0: "0", 999: "999", 1000: "1.0K", 1250: "1.3K", 1450: "1.4K", 999_950: "1000.0K", 1_000_000: "1.0M", 1_250_000: "1.3M", 10**12: "1000000.0M"}
    assert values(spark, "bigint", list(ns), C.format_number("x")) == list(ns.values())
    limits = {922_000: "922K", 1_000_000: "1M", 1_047_576: "1M", 10_485_760: "10M", 16_385: "16K", 1_500_000: "1.5M"}
    assert values(spark, "bigint", list(limits), C.format_limit("x")) == list(limits.values())


def test_status_thresholds(spark):
    at = lambda limit: values(spark, "bigint", [1_000, 110_000, 200_000], C.status("x", F.lit(limit).cast("bigint")))
    assert at(128_000) == ["ok", "warning", "error"]
    assert at(None) == at(0) == ["ok", "ok", "ok"]
    assert values(spark, "bigint", [5], C.percentage("x", F.lit(None).cast("bigint"))) == [0.0]


def test_meter_never_claims_more_than_is_there(spark):
    limit = F.lit(10_000).cast("bigint")
    assert values(spark, "bigint", [7_999, 8_000, 9_970, 10_000, 500_000, 123], C.meter_percent("x", limit)) == ["79", "80", "99", "100", "5000", "1.2"]
    assert values(spark, "bigint", [7_999, 500_000], C.meter_fill("x", limit)) == ["79.99", "100.00"]
    assert values(spark, "bigint", [7_999, 8_000, 10_000], C.meter_caption("x", limit)) == ["of 10.0K tokens", "Approaching the 10.0K token limit", "Over the 10.0K token limit"]


@pytest.mark.parametrize(
    ("path", "name", "ext", "language"),
    [
        ("a/b.wibble", "b.wibble", "wibble", ".wibble"),
        ("/x/.gitignore", ".gitignore", "", ".gitignore"),
        ("Makefile", "Makefile", "", "No extension"),
        ("A.TS", "A.TS", "ts", "TypeScript"),
        ("C:\\r\\a.", "a.", "", "No extension"),
        ("a.constructor", "a.constructor", "constructor", ".constructor"),
        ("", "", "", "No extension"),
    ],
)
def test_names(spark, path, name, ext, language):
    assert values(spark, "string", [path], F.struct(C.file_name("x"), C.extension("x"), C.language("x")))[0] == (name, ext, language)


def test_skip_reasons_in_order(spark):
    rows = [("icon.png", 5, True), ("big.txt", 10_485_761, True), ("fine.txt", 10_485_760, False), ("empty", 0, None), ("app.log", 1, True), (".lock", 1, False), ("a.lock", 1, False)]
    df = spark.createDataFrame(rows, "path string, size bigint, ignored boolean")
    assert [r[0] for r in df.select(C.skip_reason("path", "size", "ignored")).collect()] == ["binary", "too-large", None, None, "gitignored", None, "binary"]


def test_bytes(spark):
    data = [b"a" * 10 + b"\0", b"a" * 8192 + b"\0", b"", b"\xef\xbb\xbfhi", b"a\xffb", b"\xe2\x82"]
    assert values(spark, "binary", data, C.looks_binary("x")) == [True, False, False, False, False, False]
    assert values(spark, "binary", data[2:], C.decode_utf8("x")) == ["", "hi", "a�b", "�"]


def test_cells_and_markup(spark):
    cells = ["=cmd|'/c calc'!A1.ts", 'a"b', "a\tb\r\nc", "plain"]
    assert values(spark, "string", cells, C.csv_cell("x")) == ["\"'=cmd|'/c calc'!A1.ts\"", '"a""b"', '"a b c"', '"plain"']
    assert values(spark, "string", ["<a href=\"x\">&'"], C.escape_html("x")) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;"]
    assert values(spark, "string", ["</script>\u2028"], C.embed_json(F.struct("x"))) == ['{"x":"\\u003c/script>\\u2028"}']


def test_shares(spark):
    assert values(spark, "double", [0.1, 0.0999, 1.0, 0.005], C.bar_share("x")) == ["10%", "10.0%", "100%", "0.5%"]
    assert values(spark, "bigint", [0, 25], C.bar_width("x", F.lit(100))) == ["0.00", "25.00"]
    assert values(spark, "bigint", [1], C.table_share("x", F.lit(0))) == ["—"]


def test_lines_for_people(spark):
    m = R.BY_ID["claude-opus-5"]
    note = C.tooltip(F.lit("File"), "x", F.lit(False), F.lit(m.label), F.lit(m.provider), F.lit(m.kind), F.lit(m.context_limit))
    assert values(spark, "bigint", [900_000], note)[0] == "**File**\n\nModel: Claude Opus 5\nContext: 90.0% of 1.0M\n\nApproaching the context limit.\n\nEstimated. Anthropic does not publish a tokenizer for this model."
    assert values(spark, "bigint", [1234], C.status_text("x", F.lit(True), F.lit(None).cast("bigint"), True)) == ["[ok] 1.2K tokens (selection)"]
