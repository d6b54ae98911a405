"""Removal of repeated word windows over a compacted De Bruijn graph.

The graph's k-mers are ``K`` consecutive words. Every window of ``window`` words picks the smallest of its
k-mer hashes, so two equal windows pick the same k-mer; only picked k-mers (about one in fourteen
words) become nodes. Between one picked k-mer and the next of the same text, and from a text's
first words or to its last, run edges labelled with the hash of the words they span.

* A node that occurs once ends it: windows that picked it occur once.
* A node that occurs again, always between the same two edges, doesn't branch. A join carries that to its occurrences, where
  neighbouring such nodes make up one path, named by its first node: nonbranching paths are maximal, so all
  occurrences of a path are the same run of nodes.
* Hashes only propose. The words of each occurrence of a path, from its source coordinates, have a 128-bit digest (BLAKE2b), and
  a path is repeated only if it occurs again and all its occurrences have the words of the first; its windows are then settled
  together.
* Windows where paths branch, and those of paths whose occurrences differ, are told by the digests of their own words.

Nodes, paths and windows travel by hash or digest and by source coordinate; texts are read from
the source and move once, to meet what was found about them. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import saved
from tidemark.llm.words import SPACED, Block, Spans, blocks, mix, sliding_first_min

WINDOW, K = 35, 8


class _Graph:
    """The nodes and edges of a block's texts."""

    def __init__(self, block: Block, window: int, k: int, bits: int):
        text = block.text
        self.begin, self.end = block.first[text], block.first[text + 1]
        hashes = block.hashes()
        if bits < 64:
            hashes = hashes >> np.uint64(64 - bits)
        spans, at = Spans(hashes), np.arange(len(text))
        kmers = spans.of(at[: max(0, len(at) - k + 1)], np.arange(k, max(k, len(at) + 1)))
        pick = sliding_first_min(kmers, window - k + 1)
        self.windows = np.flatnonzero(at[: len(pick)] + window <= self.end[: len(pick)])
        pick = pick[self.windows]
        self.nodes = np.unique(pick)  # word positions in the block
        self.picked = np.searchsorted(self.nodes, pick)  # each window's node
        self.node_text = text[self.nodes] if len(self.nodes) else np.empty(0, np.int64)
        first = np.searchsorted(self.node_text, np.arange(len(block.rows)))
        self.number = np.arange(len(self.nodes)) - first[self.node_text]  # within its text
        self.first = np.append(first, len(self.nodes))
        self.node_hash = kmers[self.nodes]
        same = self.node_text[1:] == self.node_text[:-1]
        leaves, enters = np.append(same, False), np.append(False, same)[: len(self.nodes)]
        leaves = leaves[: len(self.nodes)]
        here = self.nodes
        after = np.where(leaves, np.roll(here, -1) + k, self.end[here])
        before = np.where(enters, np.roll(here, 1), self.begin[here])
        self.before, self.after = before, after
        out = spans.of(here, after) ^ np.where(leaves, np.uint64(0), np.uint64(0x5851F42D4C957F2D))
        into = spans.of(before, here + k) ^ np.where(enters, np.uint64(0), np.uint64(0x14057B7EF767814F))
        self.edges = mix(mix(into) * np.uint64(3) + out)


def _nodes(window: int, k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text"), SPACED):
                if len(block.starts) < window:
                    continue
                g = _Graph(block, window, k, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g.node_hash.view(np.int64)),
                        pa.array(g.edges.view(np.int64)),
                        pa.array(uid[block.rows.start + g.node_text]),
                        pa.array(g.number.astype(np.int32)),
                    ],
                    ["node", "edges", "uid", "number"],
                )

    return run


class _Settled:
    """Windows of a block on nonbranching paths (``proven``), those whose own words must decide (``open``), and the paths.

    ``flags`` has, for each text, 2 * node number + 1 if its paths don't branch, for repeated nodes; ``bad`` the numbers of
    first nodes of paths whose occurrences differ."""

    def __init__(self, block: Block, flags: list, bad: list, window: int, k: int, bits: int):
        self.graph = g = _Graph(block, window, k, bits)
        repeated, linear = np.zeros(len(g.nodes), bool), np.zeros(len(g.nodes), bool)
        for t, codes in enumerate(flags):
            if len(codes):
                at = g.first[t] + (codes >> 1)
                repeated[at] = True
                linear[at] = codes & 1
        # runs of such nodes inside a text
        new = linear.copy()
        new[1:] &= ~(linear[:-1] & (g.node_text[1:] == g.node_text[:-1]))
        self.heads = np.flatnonzero(new)
        end = linear.copy()
        end[:-1] &= ~(linear[1:] & (g.node_text[1:] == g.node_text[:-1]))
        self.tails = np.flatnonzero(end)
        for t, numbers in enumerate(bad):
            for head in g.first[t] + numbers:
                linear[head : self.tails[np.searchsorted(self.heads, head)] + 1] = False
        branching = np.append(0, np.cumsum(~linear))
        lo = np.searchsorted(g.nodes, g.windows, "left")
        hi = np.searchsorted(g.nodes, g.windows + window - k, "right")
        again = repeated[g.picked]
        proven = again & (branching[hi] == branching[lo])
        self.proven, self.open = g.windows[proven], g.windows[again & ~proven]


class _Digests:
    """Digests of spans of a block's words, joined by one space."""

    def __init__(self, block: Block):
        sizes = block.ends - block.starts + 1
        self.at = np.append(0, np.cumsum(sizes))
        edge = np.zeros(len(block.data) + 1, np.int8)
        edge[block.starts] += 1
        edge[block.ends + 1] -= 1
        # each word with the byte behind it, which becomes a space
        data = block.data.copy()
        data[block.ends] = 0x20
        self.bytes = memoryview(data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes())

    def of(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return [hashlib.blake2b(self.bytes[a:b], digest_size=16).digest() for a, b in zip(self.at[starts].tolist(), self.at[ends].tolist())]


def _evidence(window: int, k: int, bits: int, again: bool):
    """Digests of the occurrences of paths (``path`` is the first node's hash, ``start`` its number) and of windows whose words must
    decide (``path`` is null, ``start`` a word); ``again`` gives only windows of paths that are bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, flags, bad = batch.column("uid").to_numpy(zero_copy_only=False), _codes(batch.column("codes")), _codes(batch.column("bad"))
            for block in blocks(batch.column("text"), SPACED):
                own = [flags[r] for r in block.rows]
                if not any(map(len, own)):
                    continue
                none = [np.empty(0, np.int64)] * len(own)
                found = _Settled(block, own, none, window, k, bits)
                g, digests, windows = found.graph, _Digests(block), found.open
                if again:
                    more = _Settled(block, own, [bad[r] for r in block.rows], window, k, bits).open
                    windows = np.setdiff1d(more, windows, assume_unique=True)
                text = block.text[windows]
                columns = [uid[block.rows.start + text], (windows - block.first[text]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(windows), pa.int64()), *map(pa.array, columns), pa.array(digests.of(windows, windows + window), pa.binary())], _EVIDENCE
                )
                if again or not len(found.heads):
                    continue
                spans = digests.of(g.before[found.heads], g.after[found.tails])
                columns = [g.node_hash[found.heads].view(np.int64), uid[block.rows.start + g.node_text[found.heads]], g.number[found.heads].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(spans, pa.binary())], _EVIDENCE)

    return run


_EVIDENCE = ["path", "uid", "start", "digest"]


def _codes(column: pa.Array) -> list[np.ndarray]:
    empty = np.empty(0, np.int32)
    return [empty if (v := column[i]).values is None else v.values.to_numpy(zero_copy_only=False) for i in range(len(column))]


def _branching(window: int, k: int):
    """(uid, start, h1, h2) of the windows whose words must decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, flags = batch.column("uid").to_numpy(zero_copy_only=False), _codes(batch.column("codes"))
            for block in blocks(batch.column("text"), SPACED):
                own = [flags[r] for r in block.rows]
                if not any(map(len, own)):
                    continue
                _, open_, g = _settled(block, own, window, k)
                if not len(open_):
                    continue
                text = block.text[open_]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid[block.rows.start + text]),
                        pa.array((open_ - block.first[text]).astype(np.int32)),
                        pa.array(Spans(g.hashes).of(open_, open_ + window).view(np.int64)),
                        pa.array(Spans(block.hashes(2), _SEED2 | 1).of(open_, open_ + window).view(np.int64)),
                    ],
                    ["uid", "start", "h1", "h2"],
                )

    return run


def _cut(window: int, k: int, bits: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, starts, bad = (_codes(batch.column(c)) for c in ("codes", "starts", "bad"))
            for block in blocks(batch.column("text"), SPACED):
                own, found = [flags[r] for r in block.rows], [starts[r] + block.first[i] for i, r in enumerate(block.rows)]
                gone = np.zeros(len(block.starts) + 1, np.int64)
                if any(map(len, own)):
                    proven = _Settled(block, own, [bad[r] for r in block.rows], window, k, bits).proven
                    for s in (proven, *found):
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + window, -1)
                stay = np.cumsum(gone[:-1]) == 0
                text = block.text
                kept = np.bincount(text[stay], minlength=len(block.rows))
                # the bytes of kept words, each with the separator after it but the last of a text
                data = block.data.copy()
                data[block.ends] = 0x20
                last = np.append(text[stay][1:] != text[stay][:-1], True)[: stay.sum()]
                edge = np.zeros(len(data) + 1, np.int8)
                edge[block.starts[stay]] += 1
                stops = block.ends[stay] + ~last
                np.add.at(edge, stops, -1)
                take = np.cumsum(edge[:-1], dtype=np.int8) > 0
                sizes = np.bincount(text[stay], weights=stops - block.starts[stay], minlength=len(block.rows)).astype(np.int64)
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                kept_text = pa.StringArray.from_buffers(len(block.rows), pa.py_buffer(offsets), pa.py_buffer(data[take]))
                part = batch.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(block.counts.astype(np.int64)), pa.array((block.counts - kept).astype(np.int64)), kept_text],
                    [*names, "n_words", "n_removed", "kept_text"],
                )

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed`` and ``kept_text`` (its words that lie in no
    window whose words also start anywhere else, joined by one space).

    Null and empty texts have no words; texts shorter than a window lose none. Repeated rows count
    as repeats and lose all they have if they hold a window. An empty table gives no rows. Other
    columns are not read. ``hash_bits`` is how much of a word's hash is used: with few bits, hashes propose much that digests refuse."""
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    nodes = source.select("uid", "text").mapInArrow(_nodes(window, k, hash_bits), "node long, edges long, uid long, number int")
    seen = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("edges").alias("a"), F.max("edges").alias("b"))
    # stored, so that the join below is between two plain tables and a hot node can be split
    again = saved(seen.where("n > 1").select("node", F.expr("cast(a = b as int)").alias("linear")), "repeated-nodes")
    met = nodes.select("node", "uid", "number").join(again, "node")
    codes = saved(met.groupBy("uid").agg(F.collect_list(F.col("number") * 2 + F.col("linear")).alias("codes")), "repeated-codes")
    none = F.array().cast("array<int>")
    told = source.join(codes, "uid")  # texts without a repeated node have nothing to tell
    kinds = "path long, uid long, start int, digest binary"
    evidence = saved(told.withColumn("bad", none).mapInArrow(_evidence(window, k, hash_bits, False), kinds), "repeated-evidence")
    # a path that all its occurrences spell alike, twice or more, is repeated
    paths = evidence.where("path IS NOT NULL")
    alike = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
    differ = saved(alike.where("n < 2 OR a <> b").select("path"), "differing-paths")
    bad = saved(paths.join(differ, "path").groupBy("uid").agg(F.collect_list("start").alias("bad")), "differing-codes")
    windows = evidence.where("path IS NULL").select("uid", "start", "digest")
    if not bad.isEmpty():
        windows = windows.unionByName(saved(told.join(bad, "uid").mapInArrow(_evidence(window, k, hash_bits, True), kinds), "repeated-evidence").drop("path"))
    counts = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    # dealt anew by another key: the join then shuffles it itself, and a hot window can be split
    counts = counts.repartition(F.xxhash64("digest"))
    starts = windows.join(counts, "digest").groupBy("uid").agg(F.collect_list("start").alias("starts"))
    found = codes.join(starts, "uid", "left").join(bad, "uid", "left")
    fields = [StructField("id", docs.schema[id_col].dataType), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    out = source.join(found, "uid", "left").mapInArrow(_cut(window, k, hash_bits, ["id"]), StructType(fields))
    return out.withColumnRenamed("id", id_col)
