"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Seeds are what fixed patterns find: e-mail and IP addresses, card and phone numbers. Around each occurrence, and
around every other token that might identify somebody (it has a digit or an @), stand words: the two before it, and
the one on either side. These contexts are lexical patterns, and the distinct values that stand in them their
instances. A graph joins the two, and is scored in rounds: a pattern's confidence in a kind is the share of that
kind among its instances' scores (one more instance is added that has none, so few prove little), and a value that is no
seed takes the confidence of the best pattern that it stands in. Patterns that end up confident enough, and hold enough
different seeds, mark what else stands in them: identifiers that no fixed pattern knows.

Texts are read once; what leaves that pass is one row for each match. Positions are sums of lengths along a text.
Pairs of pattern and value are made distinct before they are shuffled, and scores travel by joins that can be
split, so neither a common context nor a common value has to fit into a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

KINDS = ("email", "ip", "card", "phone")

# Parts are possessive and starts are the first sign of a run, so that neither a run of any length is tried from each of
# its signs, nor Java's matcher recurses; what is found is the same. ``\G``: a run may go on where a match has ended.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may identify somebody: a run with a digit or an @, and digits that follow it one space apart.
_RUN = "[A-Za-z0-9_%+@:/#.-]"
CANDIDATE = rf"(?<!{_RUN})(?=[A-Za-z_%+:/#.-]*+[0-9@]){_RUN}++(?:\x20\(?[0-9][0-9)-]*+)*+"

_WORD, _APART = r"[\p{L}\p{N}]++", r"[^\p{L}\p{N}]*+"
#: Characters before and behind a match in which its context is looked for.
REACH = 64


@dataclass(frozen=True)
class Rules:
    """When a pattern is believed: its confidence, and the different seeds that it holds, are at least these."""

    rounds: int = 3
    confidence: float = 0.6
    seeds: int = 3


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def valid(kind: str = "kind", m: str = "m") -> Column:
    """Whether a match of a kind is one: parts of an address up to 255, 12 to 19 digits with a sound check digit
    (Luhn), 9 to 15 digits."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    digit = "cast(substr(d, length(d) - i, 1) as int)"
    luhn = f"transform(array({_digits(m)}), d -> aggregate(sequence(0, length(d) - 1), 0, (a, i) -> a + if(i % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))))[0] % 10 = 0"
    return F.expr(
        f"case {kind} when 'email' then true when 'ip' then {m} rlike '^(?:{part}(?:[.]|$)){{4}}$' "
        f"when 'card' then case when length({_digits(m)}) between 12 and 19 then {luhn} else false end when 'phone' then length({_digits(m)}) between 9 and 15 else false end"
    )


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, kind, idx, gap, m, before, behind): a row of kind ``doc`` for each document, which alone has its
    doc_id; and one for each match of a kind or ``candidate``: the characters between the match before and it, itself,
    and what stands around it, but no further than the next match of its kind."""
    every = PATTERNS | {"candidate": CANDIDATE}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = [F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("found")) for kind, p in every.items()]
    each = rows.select("row", "doc_id", "text", F.explode(F.array(F.struct(F.lit("doc").alias("kind"), F.array(F.lit("")).alias("found")), *found)).alias("k"))
    each = each.select("row", "doc_id", "text", "k.kind", "k.found").where(F.size("found") > 0)
    # Only texts with matches of a kind are split at them.
    parts = F.when(F.col("kind") == "doc", F.array(F.lit(""), F.lit("")))
    for kind, p in every.items():
        parts = parts.when(F.col("kind") == kind, F.split("text", p, -1))
    split = each.select("row", F.when(F.col("kind") == "doc", F.col("doc_id")).alias("doc_id"), "kind", "found", parts.alias("parts"))
    zipped = F.arrays_zip("found", "parts", F.slice("parts", F.lit(2), F.size("found")).alias("next"))
    out = split.select("row", "doc_id", "kind", F.posexplode_outer(zipped).alias("idx", "z")).where("z.found is not null")
    before = F.regexp_extract(F.lower(F.right(F.col("z.parts"), F.lit(REACH))), f"(?:{_WORD}{_APART}){{1,2}}$", 0)
    behind = F.regexp_extract(F.lower(F.left(F.col("z.next"), F.lit(REACH))), f"^{_APART}{_WORD}", 0)
    spaced = [F.regexp_replace(c, r"\s+", " ") for c in (before, behind)]
    return out.select("row", "doc_id", "kind", "idx", F.length("z.parts").alias("gap"), F.col("z.found").alias("m"), spaced[0].alias("before"), spaced[1].alias("behind"))


def _placed(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, m, before, behind) of valid matches, and of candidates that touch none of them.
    Positions count characters (code points); ``end`` is the first behind."""
    along = W.partitionBy("row", "kind").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    rows = found.where("kind != 'doc'").repartition("row")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(along)).withColumn("start", F.col("end") - F.length("m"))
    rows = rows.withColumn("seed", valid()).where("seed or kind = 'candidate'")
    # Two running sums along a text tell whether a seed reaches into a candidate from before, or begins inside it.
    forth = W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("row").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("reach", F.max(F.when(F.col("seed"), F.col("end"))).over(forth)).withColumn("next", F.min(F.when(F.col("seed"), F.col("start"))).over(back))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return rows.where(F.col("seed") | free).select("row", "kind", "start", "end", "m", "before", "behind")


def _contexts(spans: DataFrame) -> DataFrame:
    """``spans`` with a row for each lexical pattern that they stand in: the two words before, and the word on either
    side, with what stands between."""
    last = F.regexp_extract("before", f"{_WORD}{_APART}$", 0)
    both = F.when((F.col("before") != "") & (F.col("behind") != ""), F.concat(last, F.lit("_"), F.col("behind")))
    patterns = F.array_compact(F.array(F.when(F.col("before") != "", F.concat("before", F.lit("_"))), both))
    return spans.withColumn("pattern", F.explode(patterns))


def believed(contexts: DataFrame, rules: Rules) -> DataFrame:
    """(pattern, kind, confidence) of the patterns to believe. ``contexts``: (pattern, kind, m), where kind
    ``candidate`` is what is no seed."""
    seed = F.col("kind") != "candidate"
    pairs = contexts.groupBy("pattern", F.lower("m").alias("value")).agg(F.min(F.when(seed, F.col("kind"))).alias("kind"))
    # A pattern of one value tells nothing of any other.
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("n"), F.count("kind").alias("seeds")).where("n > 1")
    edges = written(pairs.join(sizes.select("pattern", "n"), "pattern"))
    known = edges.where("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    scores, patterns = known, None
    for turn in range(rules.rounds):
        sums = edges.drop("kind").join(scores, "value").groupBy("pattern", "kind", "n").agg(F.sum("score").alias("s"))
        patterns = written(sums.select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("confidence")))
        if turn < rules.rounds - 1:
            others = edges.where("kind is null").select("pattern", "value").join(patterns, "pattern")
            scores = written(known.unionByName(others.groupBy("value", "kind").agg(F.max("confidence").alias("score")).join(known.select("value"), "value", "left_anti")))
    held = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= rules.seeds)
    return patterns.where(F.col("confidence") >= rules.confidence).join(held, ["pattern", "kind"]).select("pattern", "kind", "confidence")


def _nth() -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))


def _all_spans(found: DataFrame, rules: Rules) -> DataFrame:
    """(row, kind, start, end, m, confidence): seeds, whose confidence is null, and what believed patterns mark."""
    spans = written(_placed(found))
    contexts = written(_contexts(spans))
    marked = contexts.where("kind = 'candidate'").drop("kind").join(believed(contexts.select("pattern", "kind", "m"), rules), "pattern")
    # The most confident pattern gives the kind; of equals, the first of KINDS.
    best = F.max_by(F.struct("kind", "confidence"), F.struct("confidence", (-_nth()).alias("nth"))).alias("best")
    more = marked.groupBy("row", "start", "end").agg(best, F.first("m").alias("m")).select("row", "best.kind", "start", "end", "m", "best.confidence")
    seeds = spans.where("kind != 'candidate'").select("row", "kind", "start", "end", "m", F.lit(None).cast("double").alias("confidence"))
    return seeds.unionByName(more)


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """doc_id, kind, start, end, m (the text of the span) and confidence, a row for each span. Seeds have no
    confidence; the others are identifiers that patterns found."""
    found = written(matches(docs, doc_id, text))
    ids = found.where("kind = 'doc'").select("row", "doc_id")
    return _all_spans(found, rules).join(ids, "row").select("doc_id", "kind", "start", "end", "m", "confidence")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """A row for each row of ``docs``: doc_id, n_email, n_ip, n_card and n_phone (seeds), base_sha256 (of the seeds'
    spans), spans (of all) and n_found (spans that patterns found).

    Spans are written ``kind:start:end`` by start, then kind in the order of ``KINDS``, and joined by commas. A null text
    is an empty one, and has none; a null doc_id stays, and rows given twice come back twice. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    found = written(matches(docs, doc_id, text))
    rows = _all_spans(found, rules).select("row", F.struct("start", _nth().alias("nth"), "end", "kind", F.col("confidence").isNull().alias("seed")).alias("s"))
    of_docs = found.where("kind = 'doc'").select("row", "doc_id")
    listed = of_docs.join(rows.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("all")), "row", "left")
    listed = listed.withColumn("all", F.coalesce("all", F.array().cast(listed.schema["all"].dataType)))
    seeds = F.filter("all", lambda s: s["seed"])

    def written_out(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(seeds, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return listed.select("doc_id", *map(count, KINDS), F.sha2(written_out(seeds), 256).alias("base_sha256"), written_out(F.col("all")).alias("spans"), F.size(F.filter("all", lambda s: ~s["seed"])).cast("long").alias("n_found"))
