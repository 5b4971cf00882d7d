"""Column expressions: all built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import registry as R


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf16_length(text) -> Column:
    """Length in UTF-16 code units, as editors count characters."""
    return (F.length(F.encode(_c(text), "UTF-16BE")) / 2).cast("bigint")


def heuristic_tokens(text, ratio) -> Column:
    """Characters over characters per token, rounded up."""
    return F.ceil(utf16_length(text).cast("double") / (F.lit(float(ratio)) if isinstance(ratio, int | float) else _c(ratio))).cast("bigint")


def token_count(text, ratio) -> Column:
    """struct<count, exact> of an estimate: an empty text is exactly nothing."""
    return F.when(F.coalesce(F.length(_c(text)), F.lit(0)) == 0, F.struct(F.lit(0).cast("bigint").alias("count"), F.lit(True).alias("exact"))).otherwise(
        F.struct(heuristic_tokens(text, ratio).alias("count"), F.lit(False).alias("exact"))
    )


def to_fixed(x, digits: int) -> Column:
    """A non-negative double with so many decimals; its exact binary value decides, ties go up."""
    x = _c(x).cast("double")

    # An integral division keeps every digit; each range's scale takes all bits of its doubles.
    def exact(bits: int) -> Column:
        whole = F.floor(x * F.lit(float(1 << bits))).cast("decimal(20,0)")
        top = whole * F.lit(2 * 10**digits).cast("decimal(6,0)") + F.lit(1 << bits).cast("decimal(20,0)")
        return F.call_function("div", top, F.lit(2 << bits).cast("decimal(20,0)"))

    n = F.when(x < 4, exact(60)).when(x < 1024, exact(52)).when(x < float(1 << 30), exact(32)).when(x < float(1 << 41), exact(22)).otherwise(exact(10))
    if digits == 0:
        return n.cast("string")
    unit = 10**digits
    return F.concat(F.call_function("div", n, F.lit(unit)).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))


def format_number(n) -> Column:
    """1250 as 1.3K, 999950 as 1000.0K, 1000000 as 1.0M; below 1000 the digits."""
    n = _c(n)
    return F.when(n >= 1_000_000, F.concat(to_fixed(n / F.lit(1_000_000), 1), F.lit("M"))).when(n >= 1000, F.concat(to_fixed(n / F.lit(1000), 1), F.lit("K"))).otherwise(n.cast("string"))


def format_limit(n) -> Column:
    """1000000 as 1M, 1047576 as 1M, 10485760 as 10M, 922000 as 922K."""
    n = _c(n)
    millions = n / F.lit(1_000_000)
    return (
        F.when(n >= 10_000_000, F.concat(to_fixed(millions, 0), F.lit("M")))
        .when(n >= 1_000_000, F.concat(F.regexp_replace(to_fixed(millions, 1), r"\.0$", ""), F.lit("M")))
        .otherwise(F.concat(to_fixed(n / F.lit(1000), 0), F.lit("K")))
    )


def thousands(n) -> Column:
    return F.format_number(_c(n), 0)


def _limited(limit: Column) -> Column:
    return F.coalesce(limit, F.lit(0)) != 0


def percentage(count, limit) -> Column:
    count, limit = _c(count), _c(limit)
    return F.when(_limited(limit), count / limit * 100).otherwise(F.lit(0.0))


def status(count, limit) -> Column:
    """ok, warning or error by the share of the limit; without a limit all is well."""
    p = percentage(count, limit)
    return F.when(p >= R.ERROR_PERCENT, "error").when(p >= R.WARNING_PERCENT, "warning").otherwise("ok")


def context_status(count, limit) -> Column:
    return F.struct(percentage(count, limit).alias("percentage"), status(count, limit).alias("status"), _c(limit).alias("limit"))


def meter_percent(count, limit) -> Column:
    """The share of the limit in percent, cut and not rounded, so that it never claims a threshold
    that has not been passed; null without a limit."""
    share = _c(count) / _c(limit)
    text = F.when(share >= 0.1, F.floor(share * 100).cast("string")).otherwise(to_fixed(F.floor(share * 1000) / F.lit(10), 1))
    return F.when(_limited(_c(limit)), text)


def meter_fill(count, limit) -> Column:
    return F.when(_limited(_c(limit)), to_fixed(F.least(_c(count) / _c(limit), F.lit(1.0)) * 100, 2))


def meter_caption(count, limit) -> Column:
    shown, state = format_number(limit), status(count, limit)
    return F.when(
        _limited(_c(limit)),
        F.when(state == "error", F.concat(F.lit("Over the "), shown, F.lit(" token limit")))
        .when(state == "warning", F.concat(F.lit("Approaching the "), shown, F.lit(" token limit")))
        .otherwise(F.concat(F.lit("of "), shown, F.lit(" tokens"))),
    )


def bar_width(tokens, widest) -> Column:
    return F.when(_c(widest) > 0, to_fixed(_c(tokens) / _c(widest) * 100, 2)).otherwise(F.lit("0.00"))


def bar_share(share) -> Column:
    share = _c(share)
    return F.concat(F.when(share >= 0.1, to_fixed(share * 100, 0)).otherwise(to_fixed(share * 100, 1)), F.lit("%"))


def table_share(tokens, total) -> Column:
    return F.when(_c(total) > 0, F.concat(to_fixed(_c(tokens) / _c(total) * 100, 1), F.lit("%"))).otherwise(F.lit("—"))


def share(tokens, total) -> Column:
    return F.when(_c(total) > 0, _c(tokens) / _c(total)).otherwise(F.lit(0.0))


def segments(path) -> Column:
    """Parts of a path between slashes of either kind."""
    return F.filter(F.split(_c(path), r"[/\\]"), lambda x: x != "")


def file_name(path) -> Column:
    parts = segments(path)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.lit(""))


def extension(path) -> Column:
    """In lower case; a leading dot begins no extension, a trailing one leaves it empty."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1))


def language_or(path, known: Column) -> Column:
    """A known language, else the dotted extension, else the name of a dotfile, else none."""
    ext, name = extension(path), file_name(path)
    return F.coalesce(known, F.when(ext != "", F.concat(F.lit("."), ext)).when(name.startswith("."), name).otherwise(F.lit("No extension")))


def language(path) -> Column:
    known = F.create_map(*[F.lit(x) for pair in R.LANGUAGES.items() for x in pair])
    return language_or(path, F.try_element_at(known, extension(path)))


def folder(path, root) -> Column:
    """First part below the root's, or (root) for files directly in it."""
    parts, depth = segments(path), F.size(_c(root))
    return F.when(F.size(parts) - depth > 1, F.try_element_at(parts, depth + 1)).otherwise(F.lit("(root)"))


def display_path(path, root) -> Column:
    """Below the root, if it is there; else whole; with forward slashes."""
    parts, root = segments(path), _c(root)
    depth = F.size(root)
    below = F.filter(parts, lambda _, i: i >= depth)
    return F.array_join(F.when(F.filter(parts, lambda _, i: i < depth) == root, below).otherwise(parts), "/")


def skip_reason(path, size, ignored) -> Column:
    """Why a file is not counted, in the order of the tests: extension, size, ignore rules; else null.
    A name that is nothing but a dot and an extension has none."""
    return (
        F.when(extension(path).isin(*R.BINARY_EXTENSIONS), "binary").when(_c(size) > R.MAX_BYTES, "too-large").when(F.coalesce(_c(ignored), F.lit(False)), "gitignored")
    )


def skip_text(reason) -> Column:
    out = F.lit(None).cast("string")
    for k, text in R.SKIP_TEXTS.items():
        out = F.when(_c(reason) == k, text).otherwise(out)
    return out


def looks_binary(content) -> Column:
    """A zero byte among the first 8192."""
    return F.call_function("locate", F.lit(b"\0"), F.substring(_c(content), 1, R.SNIFF_BYTES)) > 0


def decode_utf8(content) -> Column:
    """Text of bytes: what is not UTF-8 becomes U+FFFD, one byte order mark at the start goes."""
    return F.regexp_replace(F.make_valid_utf8(_c(content).cast("string")), "^\ufeff", "")


def escape_html(text) -> Column:
    out = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def embed_json(value) -> Column:
    """JSON that can stand in a script element."""
    out = F.to_json(value)
    for a, b in (("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def plain_cell(value) -> Column:
    """Tabs and line ends, which would part cells and rows, as spaces."""
    return F.regexp_replace(_c(value).cast("string"), "[\\t\\r\\n]+", " ")


def csv_cell(value) -> Column:
    """Quoted; what a spreadsheet would take for a formula begins with an apostrophe."""
    text = plain_cell(value)
    safe = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(*values) -> Column:
    return F.concat_ws(",", *[csv_cell(v) for v in values])


def tsv_line(*values) -> Column:
    return F.concat_ws("\t", *[plain_cell(v) for v in values])


def prefixed(count, exact) -> Column:
    """The count in short form, marked where it is an estimate."""
    return F.concat(F.when(_c(exact), "").otherwise("≈"), format_number(count))


def status_text(count, exact, limit, selection=False) -> Column:
    mark = {"error": "[over]", "warning": "[near]", "ok": "[ok]"}
    shown = F.lit(mark["ok"])
    for state in ("warning", "error"):
        shown = F.when(status(count, limit) == state, mark[state]).otherwise(shown)
    chosen = F.lit(selection) if isinstance(selection, bool) else _c(selection)
    return F.concat(shown, F.lit(" "), prefixed(count, exact), F.lit(" tokens"), F.when(chosen, " (selection)").otherwise(""))


def notification(name, count, exact, label) -> Column:
    return F.concat(_c(name), F.lit(": "), prefixed(count, exact), F.lit(" tokens ("), _c(label), F.lit(")"))


def tooltip(title, count, exact, label, provider, kind, limit) -> Column:
    state = status(count, limit)
    context = F.when(
        _limited(_c(limit)),
        F.concat(
            F.lit("\nContext: "), to_fixed(percentage(count, limit), 1), F.lit("% of "), format_number(limit),
            F.when(state == "warning", "\n\nApproaching the context limit.").when(state == "error", "\n\nOver the context limit.").otherwise(""),
        ),
    ).otherwise("")
    estimate = F.when(_c(exact), "").when(_c(kind).isin("hf", "tiktokenModel"), "\n\nEstimated. Load the model's tokenizer for an exact count.").otherwise(
        F.concat(F.lit("\n\nEstimated. "), _c(provider), F.lit(" does not publish a tokenizer for this model."))
    )
    return F.concat(F.lit("**"), _c(title), F.lit("**\n\nModel: "), _c(label), context, estimate)


def repository_folder(repo) -> Column:
    return F.regexp_replace(_c(repo), r"[/\\]", "--")


def accuracy(kind) -> Column:
    return F.when(_c(kind) == "tiktoken", "exact").when(_c(kind).isin("hf", "tiktokenModel"), "after-download").otherwise("estimated")


def is_downloadable(kind) -> Column:
    return _c(kind).isin("hf", "tiktokenModel")
