"""SimHash fingerprints, links within a few bits, and groups of near copies.

Candidates: if two 64-bit fingerprints differ in at most r bits, one of r + 1 blocks of bits
is equal in both. Fingerprints meet in buckets of equal blocks. A bucket of more than
``BUCKET`` different fingerprints is dealt again by the blocks of its other bits, where the
same argument holds; what is still larger is cut into chunks, and every two chunks meet. So no
bound on a bucket loses a link.

Comparison: inside a bucket 64 fingerprints share a machine word per bit (a bit plane). A
query's distance to 64 others is counted at once with carry-save counters; a word is
abandoned once all its 64 lanes exceed the radius. A bucket gives the links of a spanning
forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import row_hash, saved, small_side, whole_row
from tidemark.llm.graph import components

BITS = 64
#: Different fingerprints that one bucket may hold before it is dealt again.
BUCKET = 512
_CHUNK = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_FULL = np.uint64(2**64 - 1)


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned number: a bit is set if it is set in over
    half the shingles' hashes. A text of fewer words is one shingle; one without words has 0."""
    words = (text.encode() if isinstance(text, str) else text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    hash64, totals = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, _CHUNK):
        part = np.array([hash64(line[s:e], 42) for s, e in zip(starts[lo : lo + _CHUNK], ends[lo : lo + _CHUNK])], dtype="<u8")
        totals += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, with ``fp``, the fingerprint as a signed long."""
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = StructType([*rest, StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(text).cast(pa.binary())], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(found)], [*(f.name for f in rest), "fp"])

    return docs.mapInArrow(run, schema)


def linked_pairs(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of equal ``group`` (sorted) within ``radius`` bits, bit-sliced."""
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    width = -(-n // 64)
    planes = np.zeros((BITS, width * 8), dtype=np.uint8)
    planes[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    planes = planes.view("<u8")
    masks = np.where(bits.T == 1, _FULL, np.uint64(0))  # per plane, a query's bit in all 64 lanes
    ends = np.searchsorted(group, group, "right")
    lo, hi = (np.arange(n) + 1) // 64, -(-ends // 64)
    per = np.where(ends > np.arange(n) + 1, hi - lo, 0)
    total = np.cumsum(per)
    firsts, seconds, counters = [], [], max(1, radius.bit_length())
    q0 = 0
    while q0 < n:
        q1 = max(q0 + 1, int(np.searchsorted(total, (total[q0 - 1] if q0 else 0) + _CHUNK, "right")))
        count = per[q0:q1]
        q = np.repeat(np.arange(q0, q1), count)
        w = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + lo[q]
        q0 = q1
        if not len(q):
            continue
        # lanes outside the query's own bucket, or not after it, exceed the radius from the start
        below = np.clip(q + 1 - 64 * w, 0, 64).astype(np.uint64)
        above = np.clip(ends[q] - 64 * w, 0, 64).astype(np.uint64)
        ones = lambda k: np.where(k >= 64, _FULL, (np.uint64(1) << (k & np.uint64(63))) - np.uint64(1))
        over = ones(below) | ~ones(above)
        sums = [np.zeros(len(q), dtype=np.uint64) for _ in range(counters)]
        for b in range(BITS):
            carry = planes[b, w] ^ masks[b, q]
            for c in sums:
                carry_out = c & carry
                c ^= carry
                carry = carry_out
            over |= carry
            if b % 8 == 7 and b + 1 < BITS:
                live = over != _FULL
                if not live.all():
                    q, w, over, sums = q[live], w[live], over[live], [c[live] for c in sums]
                    if not len(q):
                        break
        live = over != _FULL
        q, w, over = q[live], w[live], over[live]
        lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(lanes)
        i, j = q[at], 64 * w[at] + lane
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius  # counters hold more than a radius that isn't 2^k - 1
        firsts.append(i[near])
        seconds.append(j[near])
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(firsts), np.concatenate(seconds)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the first member it is linked to, over any number of links."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            label = spanning(*linked_pairs(g, f, radius), len(f))
            moved = np.flatnonzero(label != np.arange(len(f)))
            signed = f.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], ["a", "b"])

        for batch in batches:
            group = np.concatenate([group, batch.column("bucket").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(group) >= 1 << 14:
                cut = int(np.searchsorted(group, group[-1], "left"))  # the last bucket may go on
                if cut:
                    yield links(group[:cut], fps[:cut])
                    group, fps = group[cut:], fps[cut:]
        if len(group):
            yield links(group, fps)

    return run


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    """Bit numbers in ``parts`` runs of nearly equal length."""
    size, rest = divmod(len(bits), parts)
    out, at = [], 0
    for p in range(parts):
        step = size + (p < rest)
        out.append(bits[at : at + step])
        at += step
    return out


def _take(fp: Column, run: list[int]) -> Column:
    """The value of a run of adjacent bits, or of what is left of it around a gap."""
    value, at, k = F.lit(0).cast("long"), 0, 0
    while k < len(run):
        end = k
        while end + 1 < len(run) and run[end + 1] == run[end] + 1:
            end += 1
        width = end - k + 1
        piece = F.shiftrightunsigned(fp, run[k]).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else 2**63 - 1))
        value = value.bitwiseOR(F.shiftleft(piece, at))
        at, k = at + width, end + 1
    return value


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all different fingerprints ``fp`` within ``radius`` bits: the links
    of a spanning forest of each bucket. ``fps`` holds each fingerprint once."""
    runs = _cuts(list(range(BITS)), radius + 1)
    first = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), _take(F.col("fp"), r).alias("k")) for t, r in enumerate(runs)))).alias("x"))
    first = first.select("fp", "x.t", "x.k")
    sizes = saved(first.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    # (radius + 1) * 2^(64 / (radius + 1)) rows at most: 2^18 for a radius of 3
    first = first.join(F.broadcast(sizes) if radius >= 3 else sizes, ["t", "k"])
    # a large bucket is dealt again by the bits its members don't share yet
    again = []
    for t, r in enumerate(runs):
        rest = _cuts([b for b in range(BITS) if b not in r], radius + 1)
        again += [F.struct(F.lit(t).alias("t"), F.lit(u).alias("u"), _take(F.col("fp"), s).alias("v")) for u, s in enumerate(rest)]
    large = first.where(F.col("n") > bucket).select("fp", "t", "k", F.explode(F.array(*again)).alias("x"))
    large = large.where("t = x.t").select("fp", "t", "k", "x.u", "x.v")
    second_sizes = saved(large.groupBy("t", "k", "u", "v").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    large = large.join(second_sizes, ["t", "k", "u", "v"])
    small = first.where(F.col("n") <= bucket).select(F.xxhash64("t", "k").alias("bucket"), "fp")
    fine = large.where(F.col("n") <= bucket).select(F.xxhash64("t", "k", "u", "v").alias("bucket"), "fp")
    # what is still large: chunks of at most about half a bucket, and a bucket for every two of them
    chunks = F.ceil(F.col("n") * 2 / bucket)
    own = F.pmod(F.xxhash64("fp", F.lit(7)), chunks)
    rest = large.where(F.col("n") > bucket).withColumn("chunks", chunks).withColumn("own", own)
    rest = rest.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    rest = rest.where("chunks = 1 OR own <> other").select(
        F.xxhash64("t", "k", "u", "v", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp"
    )
    # buckets whose numbers collide are compared as one: more work, the same links
    met = small.unionByName(fine).unionByName(rest).repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(_compare(radius), "a long, b long")


def roots_of(marked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root) for each fingerprint of ``marked`` that is linked to another one."""
    distinct = saved(marked.select("fp").distinct(), "simhash-distinct")
    found = saved(links(distinct, radius), "simhash-links")
    return components(found).withColumnRenamed("node", "fp")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` and ``component`` (the smallest id among all rows
    reachable over links, null if all of them are null).

    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay, all in
    one component; an empty table gives no rows; other columns are not read."""
    marked = saved(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", shingle), "simhash-fps")
    roots = roots_of(marked, radius)
    least = marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    rooted = saved(least.join(roots, "fp", "left").select("fp", "least", "n", "root").where("n > 1 OR root IS NOT NULL"), "simhash-rooted")
    group = F.coalesce("root", "fp")
    best = saved(rooted.groupBy(group.alias("g")).agg(F.min("least").alias("component")), "simhash-least")
    groups = rooted.select("fp", group.alias("g")).join(best, "g").select("fp", "component", F.lit(True).alias("grouped"))
    out = marked.join(saved(groups, "simhash-groups"), "fp", "left")
    component = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "fp", component.alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (nulls last), then the
    smallest hash of all its columns; of rows equal in every column one stays. Nulls, empty texts
    and empty tables as in ``near_copies``; all columns stay, whatever their names."""
    keys = [row_hash(docs).alias("h1"), row_hash(docs, F.lit(1)).alias("h2")]
    marks = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *keys)
    marked = saved(fingerprints(marks, "text", shingle), "simhash-fps")
    roots = roots_of(marked, radius)
    # the best row of each fingerprint first, so a large group is small before it meets
    order = F.struct(F.col("id").isNull().alias("absent"), "id", "h1", "h2")
    best = marked.groupBy("fp").agg(F.min(order).alias("best")).join(roots, "fp", "left")
    best = best.groupBy(F.coalesce("root", "fp")).agg(F.min("best").alias("best")).select("best.h1", "best.h2")
    copies = marked.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    judged = copies.join(best.withColumn("wins", F.lit(True)), ["h1", "h2"], "left")
    judged = saved(judged.where("wins IS NULL OR copies > 1").select("h1", "h2", "wins"), "simhash-judged")
    keyed = docs.select(whole_row(docs).alias("row"), *keys)
    once = keyed.join(small_side(judged), ["h1", "h2"], "left_anti").select("row.*")
    again = keyed.join(small_side(judged.where("wins")), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row"))
    return once.unionByName(again.select("row.*"))
