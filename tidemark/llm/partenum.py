"""Sets of word n-grams that are alike by Jaccard similarity: PartEnum signatures.

Sets of equal content are one class. Sizes fall into bands; an instance of the signature scheme serves the pairs
whose larger set lies in its band, and a smaller set takes part in each band it can have a partner in. Two linked sets of an instance differ in at
most k features. The domain of features is partitioned into parts by hash, and each part into ``CELLS`` cells. So few parts can have
more than ``SPARE`` differences that some part has no more, and there the cells without one form a subset that is equal in
both sets: the signatures are the contents of all subsets of ``CELLS - SPARE`` cells of a part.

Empty subsets, and those of one feature, say little and are shared by many. There are some more parts than needed, so a set with few
such subsets shares another one with each partner and leaves them out; a set with many gives them too.

Links. A first pass checks each class against the class of smallest number that it shares most signatures with, so that a large group
of near copies becomes one component without its pairs. What is left are signatures whose classes lie in
different components: those meet in blocks, are compared by sketches (parity bits of the features, a lower bound of the number of
differences), and only survivors are checked by their texts: for each class and component the nearest first, then, in what are still different components,
all. No bound on a group's size drops a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tidemark.llm.common import saved, small_side
from tidemark.llm.graph import components
from tidemark.llm.words import LOWER, SPACED, Block, Spans, blocks, lists, mix

#: Cells of a part, and how many of them a signature leaves out.
CELLS, SPARE = 2, 1
#: Upper end of a size band, in lower ends.
BAND = 1.4
#: Classes of one signature that are compared in one block.
CHUNK = 2048


def bands(percent: int, most: int = 1 << 31) -> np.ndarray:
    """Lower ends of the size bands, ascending. Sets of the first can only be linked to equal ones."""
    out, low = [1], (100 + percent) // (2 * (100 - percent)) + 1 if percent < 100 else most
    while low <= most:
        out.append(low)
        low = max(low, int(low * BAND)) + 1
    return np.array(out, dtype=np.int64)


def most_differences(larger: np.ndarray | int, percent: int, smaller: np.ndarray | int | None = None):
    """How many features two linked sets of these sizes can differ in."""
    return (larger + (larger if smaller is None else smaller)) * (100 - percent) // (100 + percent)


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's ``width``-word shingles, ascending, and where each text's start. A text of fewer words
    has its whole sequence as one."""
    counts = block.counts
    windows = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = block.first[text] + at
    hashed = Spans(block.hashes()).of(start, start + np.minimum(counts, width)[text])
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    text, hashed = text[new], hashed[new]
    return hashed, np.searchsorted(text, np.arange(len(counts) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``, modulo 2 ** 64; empty runs have 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[first[1:]] - sums[first[:-1]]


def digests(features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its features."""
    return _sums(mix(features ^ np.uint64(0x51ED270B7A3C9D15)), first), _sums(mix(features + np.uint64(0xA0761D6478BD642F)), first)


def signatures(features: np.ndarray, first: np.ndarray, percent: int, cells: int = CELLS, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets; see the module's text."""
    sizes, lows = np.diff(first), bands(percent)
    own = np.searchsorted(lows, sizes, "right") - 1
    reach = np.searchsorted(lows, sizes * 100 // percent, "right") - 1
    mixed, of, found = mix(features), [], []
    for instance in range(1, int(reach.max(initial=0)) + 1):
        members = np.flatnonzero((own <= instance) & (instance <= reach) & (sizes > 0))
        if not len(members):
            continue
        top = int(lows[instance + 1]) - 1 if instance + 1 < len(lows) else int(sizes[members].max())
        k = int(most_differences(top, percent))
        extra = 1 + k // 50
        parts = k // (spare + 1) + 1 + extra
        n = parts * cells
        counts = sizes[members]
        rows = np.repeat(np.arange(len(members)), counts)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[members], counts)
        # features ascend, and so do their cells: a cell is a run
        key = rows * n + ((features[at] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        edge = np.searchsorted(key, np.arange(len(members) * n + 1))
        held, have = _sums(mixed[at], edge).reshape(-1, parts, cells), np.diff(edge).reshape(-1, parts, cells)
        content, size = [], []
        for subset in combinations(range(cells), cells - spare):
            name = mix(np.arange(parts, dtype=np.uint64) * np.uint64(4096) + np.uint64(sum(1 << c for c in subset)) + (np.uint64(instance) << np.uint64(48)))
            content.append(mix(held[:, :, subset].sum(axis=2, dtype=np.uint64) + name))
            size.append(have[:, :, subset].sum(axis=2))
        content, weak = np.stack(content, axis=2), np.stack(size, axis=2) < 2
        few = weak.sum(axis=(1, 2)) <= extra
        row, part, subset = np.nonzero(~(weak & few[:, None, None]))
        of.append(members[row])
        found.append(content[row, part, subset])
    if not of:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return of[order], found[order]


def sketch(features: np.ndarray) -> bytes:
    """Parity bits of a set: two to four for each feature."""
    width = 1 << max(6, int(2 * len(features) - 1).bit_length())
    return np.packbits(np.bincount((features & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def unfold(sketches: list[bytes]) -> np.ndarray:
    """Sketches of several widths as one matrix of words: longer ones are folded to the shortest, which keeps parities."""
    shortest = min(map(len, sketches))
    out = np.empty((len(sketches), shortest // 8), np.uint64)
    for i, s in enumerate(sketches):
        words = np.frombuffer(s, np.uint64)
        out[i] = np.bitwise_xor.reduce(words.reshape(-1, shortest // 8), axis=0)
    return out


def _described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    schema = T.StructType([
        docs.schema["id"], T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("signatures", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), SPACED, LOWER):
                features, first = shingle_sets(block, width)
                of, found = signatures(features, first, percent)
                part = batch.slice(block.rows.start, len(block.rows))
                columns = [pa.array(x) for x in (np.diff(first), *(d.view(np.int64) for d in digests(features, first)))]
                sketches = pa.array([sketch(features[a:b]) for a, b in zip(first, first[1:])], pa.binary())
                found = lists(found.view(np.int64), np.bincount(of, minlength=len(block.rows)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, sketches, found], names=schema.names)

    return docs.mapInArrow(run, schema)


def _linked(width: int, percent: int):
    """Of pairs of texts, those whose sets are linked, by their features themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                keep = []
                sides = [_sets(batch.column(name), width) for name in ("text_a", "text_b")]
                for x, y in zip(*sides):
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(len(both) > 0 and 100 * shared >= percent * (len(both) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    out = []
    for block in blocks(texts, SPACED, LOWER):
        features, first = shingle_sets(block, width)
        out += [features[a:b] for a, b in zip(first, first[1:])]
    return out


def _check(pairs: DataFrame, marked: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b) of row numbers. Texts of b meet their pairs where they are if those are few; then they meet
    the texts of a."""
    texts = marked.select("r", "text")
    right = texts.join(small_side(pairs), texts.r == pairs.b).select("a", "b", F.col("text").alias("text_b"))
    firsts = pairs.select(F.col("a").alias("r")).distinct()
    left = texts.join(firsts, "r", "left_semi").select(F.col("r").alias("a"), F.col("text").alias("text_a"))
    met = right.join(left, "a").select("a", "b", "text_a", "text_b")
    return saved(met.mapInArrow(_linked(width, percent), "a long, b long"), "partenum-links")


def _near(percent: int, nearest_only: bool):
    """Pairs of a block's classes that lie in different components and may be linked, by sizes and sketches; with ``nearest_only``
    one for each class and other component."""

    def of_group(r: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        words = unfold(sketches)
        for i in range(len(r)):
            smaller, larger = np.minimum(n, n[i]), np.maximum(n, n[i])
            ok = np.flatnonzero((root != root[i]) & (100 * smaller >= percent * larger))
            if not nearest_only:
                ok = ok[ok > i]
            far = np.bitwise_count(words[ok] ^ words[i]).sum(axis=1, dtype=np.int64)
            close = far <= most_differences(larger[ok], percent, smaller[ok])
            ok, far = ok[close], far[close]
            if nearest_only and len(ok):
                order = np.lexsort((r[ok], far, root[ok]))
                ok, far = ok[order], far[order]
                first = np.ones(len(ok), bool)
                first[1:] = root[ok][1:] != root[ok][:-1]
                ok, far = ok[first], far[first]
            if len(ok):
                yield np.minimum(r[ok], r[i]), np.maximum(r[ok], r[i]), far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            r, root, n = (np.array(c, np.int64) for c in list(zip(*held))[:3])
            for a, b, far in of_group(r, root, n, [h[3] for h in held]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(far)], names=["a", "b", "far"])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket != now:
                    if len(held) > 1:
                        yield from flush()
                    now, held = bucket, []
                held.append(row)
        if len(held) > 1:
            yield from flush()

    return run


def _open_pairs(shared: DataFrame, roots: DataFrame, marked: DataFrame, percent: int, nearest_only: bool) -> DataFrame:
    """Pairs still to be checked: of one signature, but of different components."""
    rooted = shared.select("s", "r").join(roots.select(F.col("node").alias("r"), "root"), "r", "left")
    rooted = saved(rooted.withColumn("root", F.coalesce("root", "r")), "partenum-rooted")
    split = rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low < high").select("s", "m")
    left = rooted.join(split, "s").join(marked.select("r", "n", "sketch"), "r")
    chunks = F.ceil(F.col("m") * 2 / CHUNK)
    own = F.pmod(F.xxhash64("r"), chunks)
    left = left.withColumn("chunks", chunks).withColumn("own", own)
    left = left.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")).where("chunks = 1 OR own <> other")
    # signatures whose numbers collide are compared as one: more work, the same links
    met = left.select(F.xxhash64("s", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "r", "root", "n", "sketch")
    met = met.repartition("bucket").sortWithinPartitions("bucket")
    found = met.mapInArrow(_near(percent, nearest_only), "a long, b long, far long")
    return found.groupBy("a", "b").agg(F.min("far").alias("far"))


def links(marked: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between classes (by row numbers ``r``) enough to connect every two that are reachable."""
    rows = marked.select("r", "signatures").join(small_side(classes.select("r")), "r", "left_semi").select("r", F.explode("signatures").alias("s"))
    hubs = rows.groupBy("s").agg(F.min("r").alias("hub"), F.max("r").alias("high")).where("hub < high").select("s", "hub")
    shared = saved(rows.join(hubs, "s"), "partenum-shared")
    often = shared.where("r <> hub").groupBy("r", "hub").agg(F.count("*").alias("n"))
    best = often.groupBy("r").agg(F.min(F.struct((-F.col("n")).alias("n"), "hub")).alias("best"))
    pairs = saved(best.select(F.col("best.hub").alias("a"), F.col("r").alias("b")), "partenum-pairs")
    found = _check(pairs, marked, width, percent)
    for nearest_only in (True, False):
        open_ = _open_pairs(shared, components(found), marked, percent, nearest_only).select("a", "b")
        open_ = saved(open_.join(pairs, ["a", "b"], "left_anti"), "partenum-pairs")
        if open_.isEmpty():
            break
        pairs = pairs.unionByName(open_)
        found = found.unionByName(_check(open_, marked, width, percent))
    return found


def similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` (size of its set) and ``component``, the smallest id reachable over links: sets
    whose intersection is at least ``percent`` per cent of their union.

    Texts without words, and null ones, have an empty set and are linked with nothing, so their component is their own id. Rows of
    equal sets are linked, repeated rows too; null ids are passed over when the smallest is taken; an empty table gives no
    rows; other columns are not read. Features are 64-bit hashes of shingles; sets are taken for equal if their sizes and 128-bit
    digests are."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    marked = saved(_described(rows, width, percent).withColumn("r", F.monotonically_increasing_id()), "partenum-sets")
    content = ["n", "d1", "d2"]
    classes = marked.where("n > 0").groupBy(*content).agg(F.min("r").alias("r"), F.min("id").alias("least"), F.count("*").alias("rows"))
    classes = saved(classes, "partenum-classes")
    roots = components(links(marked, classes, width, percent))
    rooted = classes.join(roots.select(F.col("node").alias("r"), "root"), "r", "left").where("rows > 1 OR root IS NOT NULL")
    rooted = saved(rooted.withColumn("root", F.coalesce("root", "r")), "partenum-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    groups = saved(rooted.join(least, "root").select(*content, "component", F.lit(True).alias("grouped")), "partenum-groups")
    out = marked.select("id", *content).join(small_side(groups), content, "left")
    component = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component"))

