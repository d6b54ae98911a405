"""URL rules by a sorted sweep over reversed hosts.

``www.example.com`` becomes ``com.example.www.``, so a host and its subdomains are one interval of
keys, and the intervals of rules nest or are disjoint. Splitters sampled from the urls cut the key
range into parts of nearly equal rows; a host with very many urls spans several parts. A part gets
the urls and rules whose keys lie in it, and the rules whose interval is open where it begins: those
whose host is the first key's host or above it, found by joining the labels above each splitter.
In each part rules and urls pass in key order while a stack holds the rules whose host covers the
current key; a url is judged by the longest rule on the stack whose path begins the url's path.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Parts the keys are cut into, as many as ``PART_ROWS`` asks for within these; sample keys for each.
LEAST_PARTS, MOST_PARTS, PART_ROWS, SAMPLES = 64, 16384, 1 << 20, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    after = F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    after = F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _splitters(keys: list[str], times: list[int], parts: int) -> list[bytes]:
    """The keys that cut the sample, in which each key stands ``times``, into parts of about one size."""
    sample = sorted(zip((k.encode() for k in keys), times))
    upto = list(accumulate(n for _, n in sample))
    return [sample[bisect_right(upto, upto[-1] * k // parts)][0] for k in range(1, parts)] if sample else []


def _parts(splitters: list[str], names: list[str]):
    """Adds ``part``: the part that holds the key. Where equal splitters leave several parts to one
    key, its rows are dealt among them by ``deal``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, known = [], {}
            for key, deal in zip(batch.column("key").to_pylist(), batch.column("deal").to_pylist()):
                if key not in known:
                    lo, hi = bisect_left(splitters, key.encode()), bisect_right(splitters, key.encode())
                    known[key] = (lo + 1, hi - lo) if hi > lo else (hi, 1)
                first, among = known[key]
                found.append(first + deal % among)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*names, "part"])

    return run


def _labels_above(key: str) -> list[str]:
    """The key itself and the keys of the domains above it."""
    ends = [i + 1 for i, c in enumerate(key) if c == "."]
    return [key[:e] for e in ends]


def _sweep(kept: list[str]):
    """Rules come before urls of the same key. A rule is (key, path, verdict, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, key, fits = None, [], None, []
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("part", "key", "is_url", "path", "verdict", "rule")}
            rows, rules, verdicts = [], [], []
            for i, (p, k, is_url, path, verdict, rule) in enumerate(zip(*columns.values())):
                if p != part:
                    part, stack, key = p, [], None
                if k != key or not is_url:
                    while stack and not k.startswith(stack[-1][0]):
                        stack.pop()
                    key = k
                    if not is_url:
                        stack.append((k, path, verdict, rule))
                    # the longest rule first; of equal length, that of the narrower host
                    fits = sorted(stack, key=lambda r: (-len(r[3]), -len(r[0]), r[1]))
                if is_url:
                    best = next((r for r in fits if path.startswith(r[1])), None)
                    rows.append(i)
                    rules.append(best and best[3])
                    verdicts.append(best and best[2])
            if rows:
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(c) for c in kept), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], [*kept, "rule", "verdict"]
                )

    return run


def judge(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow", parts: int | None = None
) -> DataFrame:
    """One row per row of ``urls``: id, ``host``, ``path``, ``rule`` (host and path of the longest rule that fits, or
    null) and ``verdict`` (the rule's, or ``default``).

    ``rules`` has host, path, verdict; a rule fits its host and every subdomain where the url's path
    begins with the rule's. Hosts are folded as urls are. Of rules with the same host and path the
    least verdict in code-point order holds; rules with a null in a column are left out. Urls that
    are null or have no ``://`` have an empty host and path, which only a rule with an empty host and
    path fits. Repeated rows each get their row; empty tables give no rows or the default; other
    columns are not read."""
    spark = urls.sparkSession
    value = F.col(url)
    named = urls.select(
        F.col(id_col).alias("id"), F.coalesce(host_of(value), F.lit("")).alias("host"), F.coalesce(path_of(value), F.lit("")).alias("path"),
        F.pmod(F.xxhash64(F.lit(11), F.col(id_col).cast("string"), url), F.lit(1 << 30)).cast("int").alias("deal"),
    )
    named = named.withColumn("key", host_key(F.col("host")))
    given = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
    given = given.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    given = given.select(host_key(F.col("host")).alias("key"), "path", "verdict", F.concat("host", "path").alias("rule"))
    total = named.count()
    parts = parts or min(MOST_PARTS, max(LEAST_PARTS, -(-total // PART_ROWS)))
    # a bounded sample: SAMPLES keys a part, whatever the number of urls
    share = min(1.0, SAMPLES * parts / max(1, total))
    drawn = named.where(F.xxhash64("deal", "key") < F.lit(int(share * (2**64 - 1)) - 2**63)) if share < 1 else named
    # equal rows are drawn together and reach the driver as one key with their number
    drawn = drawn.groupBy("deal", "key").agg(F.count("*").alias("n")).toArrow()
    splitters = _splitters(drawn.column("key").to_pylist(), drawn.column("n").to_pylist(), parts)
    dealt = named.mapInArrow(_parts(splitters, named.columns), StructType([*named.schema.fields, StructField("part", IntegerType())]))
    # a rule goes to the part its key begins in, and to each part that begins inside its interval
    begun = given.withColumn("deal", F.lit(0))
    begun = begun.mapInArrow(_parts(splitters, begun.columns), StructType([*begun.schema.fields, StructField("part", IntegerType())]))
    above = [(a, i + 1) for i, s in enumerate(splitters) for a in _labels_above(s.decode())]
    open_ = given.join(spark.createDataFrame(above, "key string, part int"), "key")
    columns = ["key", "path", "verdict", "rule", "part"]
    placed = begun.select(*columns).unionByName(open_.select(*columns)).distinct()
    none = F.lit(None).cast("string")
    both = dealt.select("part", "key", F.lit(True).alias("is_url"), "path", none.alias("verdict"), none.alias("rule"), "id", "host").unionByName(
        placed.select("part", "key", F.lit(False).alias("is_url"), "path", "verdict", "rule"), allowMissingColumns=True
    )
    swept = both.repartition("part").sortWithinPartitions("part", "key", "is_url", "path")
    kept = ["id", "host", "path"]
    fields = [swept.schema[c] for c in kept]
    judged = swept.mapInArrow(_sweep(kept), StructType([*fields, StructField("rule", StringType()), StructField("verdict", StringType())]))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
