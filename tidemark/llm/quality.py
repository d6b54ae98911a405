"""Quality rules whose thresholds follow the corpus.

Each document gets counts, and from them measures in thousandths (whole numbers, so sums and
comparisons are exact). A quantile sketch of a measure is its counts in buckets of under 1 %
relative width; sketches of any parts of the corpus add up, in any order, to the same sketch.
There is one per language and source; where one has too few documents its language's sketches are
merged, and where these are too few all of them. A document is rejected when a measure lies further
from its group's median than several times the spread of the group's better half. A least spread
keeps groups without variation from rejecting documents that differ a little.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import saved, whole_row, words

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents a group needs for thresholds of its own.
LEAST_GROUP = 30


@dataclass(frozen=True)
class Rule:
    """A measure in thousandths of ``top`` per ``bottom``; too far above (or, if ``both``, below) the
    median goes. ``reach`` times the spread is allowed, and the spread is at least ``least``."""

    name: str
    top: str
    bottom: str
    least: int
    reach: int = 4
    both: bool = False


RULES = (
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("dup_lines", "n_dup_lines", "n_lines", 120),
    Rule("repeats", "n_repeat_words", "n_words", 75),
    Rule("word_length", "word_chars", "n_words", 500, both=True),
)


def _within(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, inside one expression."""
    return F.transform(F.array(value), f)[0]


def repeat_words(w: Column, size: int = 3) -> Column:
    """How many words lie in windows of ``size`` words that the array holds twice or more.

    Windows are hashed and sorted with their places, equal neighbours are kept, and the places,
    sorted, cover ``size`` words each or what is left up to the next."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(w) - size),
        lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(size))).alias("h"), i.alias("i")),
    )
    same = lambda s, a, b: F.get(s, a)["h"] == F.get(s, b)["h"]

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(same(s, k, k - 1), F.lit(False)) | F.coalesce(same(s, k, k + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return F.when(F.size(w) > size, _within(_within(F.array_sort(hashed), places), covered)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``BASE`` and ``n_lines`` (lines with a word), from whole texts.

    The counts come out of a generator, so filters on them stay above it and a text is split once."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")

    def counts(x: Column) -> Column:
        w, lines = x["w"], x["l"]
        found = {
            "n_words": F.size(w),
            "word_chars": F.char_length(F.array_join(w, "")),
            "n_symbols": F.char_length(value) - F.char_length(F.translate(value, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeat_words(w),
            "n_lines": F.size(lines),
        }
        return F.struct(*(c.cast("long").alias(n) for n, c in found.items()))

    parts = F.array(F.struct(words(F.col(text)).alias("w"), lines.alias("l")))
    own = [c for c in docs.columns if c not in (*BASE, "n_lines")]
    return docs.select(*own, F.inline(F.transform(parts, counts)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measure(rule: Rule) -> Column:
    """The rule's measure in whole thousandths; 0 over 0."""
    return F.expr(f"coalesce(1000 * {rule.top} div nullif({rule.bottom}, 0), 0L)")


def bucket(value: Column) -> Column:
    """A value with all but its eight highest bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(lang, source, rule, bucket, n) over the documents that the base rules pass."""
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), bucket(measure(r)).alias("bucket")) for r in rules))
    rows = counts.where(~base_failed()).select("lang", "source", F.explode(each).alias("x"))
    return rows.groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Quartiles of each group's merged sketch: the bucket that holds the quarter's last document."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("total"))
    at = [F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)]
    return merged.groupBy(*by, "rule").agg(F.max("total").alias("total"), *at)


def thresholds(sketch: DataFrame, rules: tuple[Rule, ...] = RULES, least_group: int = LEAST_GROUP) -> DataFrame:
    """(lang, source, {rule}_low, {rule}_high): one stored row per language and source."""
    own, lang, every = _quantiles(sketch, ["lang", "source"]), _quantiles(sketch, ["lang"]), _quantiles(sketch, [])
    a, b, c = own.alias("a"), lang.alias("b"), every.alias("c")
    found = a.join(b, (F.col("a.rule") == F.col("b.rule")) & F.col("a.lang").eqNullSafe(F.col("b.lang"))).join(c, F.col("a.rule") == F.col("c.rule"))
    pick = lambda q: F.when(F.col("a.total") >= least_group, F.col(f"a.{q}")).when(F.col("b.total") >= least_group, F.col(f"b.{q}")).otherwise(F.col(f"c.{q}"))
    found = found.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("a.rule").alias("rule"), *(pick(q).alias(q) for q in ("q1", "q2", "q3")))
    limits = []
    for r in rules:
        # the lower half shows how much good documents vary, also where nearly half are bad
        spread = F.greatest(F.col("q3") - F.col("q1") if r.both else F.col("q2") - F.col("q1"), F.lit(r.least).cast("long"))
        mine = F.col("rule") == r.name
        limits.append(F.max(F.when(mine, F.col("q2") + r.reach * spread)).alias(f"{r.name}_high"))
        limits.append(F.max(F.when(mine, F.col("q2") - r.reach * spread if r.both else F.lit(-1).cast("long"))).alias(f"{r.name}_low"))
    return saved(found.groupBy("lang", "source").agg(*limits), "quality-thresholds")


def judged(counts: DataFrame, limits: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counts`` with ``base_failed`` and ``kept``."""
    t = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = counts.join(t, counts["lang"].eqNullSafe(t["_lang"]) & counts["source"].eqNullSafe(t["_source"]), "left")
    inside = F.lit(True)
    for r in rules:
        inside = inside & measure(r).between(F.col(f"{r.name}_low"), F.col(f"{r.name}_high"))
    # a group without a threshold has no document that the base rules pass
    return joined.select(counts["*"], base_failed().alias("base_failed"), (~base_failed() & F.coalesce(inside, F.lit(False))).alias("kept"))


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: its id, the counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words, so the base rules fail them. Null languages and sources
    are groups like others. Repeated rows are judged alike and each count in the sketches. An empty
    table gives no rows. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counts = saved(measured(rows).drop("text"), "quality-counts")
    out = judged(counts, thresholds(sketches(counts)))
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", "kept")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Rows are stored once with their
    counts: the sketches then read the counts alone, and no text is counted twice."""
    rows = docs.select(whole_row(docs).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counts = saved(measured(rows).drop("text"), "quality-counts")
    return judged(counts, thresholds(sketches(counts))).where("kept").select("row.*")
