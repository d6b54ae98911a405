"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item. Each text keeps, of every
``window - gram + 1`` consecutive ``gram``-word hashes, the smallest. A span of ``window``
equal words keeps the same one on both sides, so joining kept hashes finds every shared
window. Each joined hash is then extended: the windows around it are compared word by word.
An item of fewer words is one window of its own length, and keeps the hash of all its words;
documents keep every hash of such a length.

Hashes that no item has are dropped where the document is read, by a bit table of fixed
size; a large benchmark fills it and lets more through to the join, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import saved, small_side, whole_row
from tidemark.llm.words import ALNUM, LOWER, Block, Spans, blocks, mix, sliding_first_min

WINDOW = 10
GRAM = 6
#: The bit table has 2^24 bits, 2 MiB, whatever the size of the benchmark.
FILTER_BITS = 24

_HIT = pa.list_(pa.struct([("m", pa.int32()), ("fp", pa.int64()), ("start", pa.int32()), ("near", pa.string())]))


def _kept(block: Block, lengths: list[int], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each window length: kept hashes, where each stands, and the span of words to look at."""
    if not len(block.starts):
        return
    spans, text = Spans(block.hashes()), block.text
    begin, end, at = block.first[text], block.first[text + 1], np.arange(len(text))
    for m in lengths:
        size = min(m, gram) if m == window else m
        grams = at[: max(0, len(at) - size + 1)]
        hashes = spans.of(grams, grams + size) ^ mix(np.array([m], dtype=np.uint64))
        picks = sliding_first_min(hashes, m - size + 1)
        picks = np.unique(picks[at[: len(picks)] + m <= end[: len(picks)]])
        yield m, hashes[picks], picks, np.maximum(begin[picks], picks - (m - size)), np.minimum(end[picks], picks + m)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), ALNUM, LOWER):
                rows = []
                for k, row in enumerate(block.rows):
                    a, b = block.first[k], block.first[k + 1]
                    if m := min(window, b - a):
                        item = batch.column("item")[row].as_py()
                        rows += [(item, int(m), block.span(s, s + m)) for s in range(a, b - m + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field("item").type, pa.int32(), pa.string()))],
                        ["item", "m", "words"],
                    )

    return run


def _item_hashes(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("words"), ALNUM):
                # each window is an item here, so its own length is what counts
                for m in np.unique(block.counts):
                    if m:
                        for length, hashes, _, lo, hi in _kept(block, [int(m)], window, gram):
                            whole = block.counts[block.text[lo]] == length
                            found = hashes[whole].view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), length, np.int32)), pa.array(found)], ["m", "fp"])

    return run


def _probe(lengths: list[int], window: int, gram: int, bits: np.ndarray, shift: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for block in blocks(batch.column("text"), ALNUM, LOWER):
                counts[block.rows.start : block.rows.stop] = block.counts
                text = block.text
                for m, hashes, at, lo, hi in _kept(block, lengths, window, gram):
                    slot = hashes >> np.uint64(shift)
                    maybe = np.flatnonzero(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                    for k in maybe.tolist():
                        t = text[at[k]]
                        row = block.rows.start + int(t)
                        hits[row] = hits[row] or []
                        hits[row].append({"m": m, "fp": int(hashes[k].view(np.int64)), "start": int(lo[k] - block.first[t]), "near": block.span(lo[k], hi[k])})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(counts), pa.array(hits, _HIT)], [*columns, "n_words", "hits"]
            )

    return run


def benchmark_windows(items: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item, m, words): every window of every item, as stored rows. Null texts have none."""
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    return saved(rows.mapInArrow(_item_windows(window), f"item {kind}, m int, words string").distinct(), "windows")


def _covered(spans: Column) -> Column:
    """How many words sorted (start, m) spans cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))

    def add(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["start"] + x["m"])
        return F.struct(end.alias("end"), (acc["words"] + end - F.greatest(acc["end"], x["start"])).alias("words"))

    return F.aggregate(spans, zero, add, lambda acc: acc["words"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    keys: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit`` (words inside any window that an item
    has), ``spans`` (start and length of those windows), ``items`` (their item ids as sorted strings)
    and ``contaminated``. ``keys`` are further columns to keep.

    Null and empty texts have no words and are clean. Repeated rows each get their row. Items with
    a null id hit words but are not listed; items that repeat are listed once. Empty tables on
    either side give clean documents or no rows. Other columns are not read."""
    keys = keys or {}
    windows = benchmark_windows(items, item, item_text, window)
    texts = saved(windows.select("m", "words").distinct().withColumn("wid", F.monotonically_increasing_id()), "window-texts")
    hashes = saved(texts.mapInArrow(_item_hashes(window, gram), "m int, fp long").distinct(), "window-hashes")
    lengths = sorted(r.m for r in texts.select("m").distinct().collect())  # at most ``window`` of them
    shift = 64 - FILTER_BITS
    slots = hashes.select(F.shiftrightunsigned("fp", shift).alias("slot"))
    table = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), *(c.alias(k) for k, c in keys.items()), F.col(text).alias("text"))
    columns = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    probe = _probe(lengths, window, gram, bits, shift, columns)
    probed = saved(rows.mapInArrow(probe, f"{kinds}, n_words long, hits array<struct<m int, fp long, start int, near string>>"), "probed")
    # hashes that the benchmark has, then every window that holds such a hash, word by word
    met = probed.select("uid", F.explode("hits").alias("h")).select("uid", "h.*").join(hashes, ["m", "fp"], "left_semi")
    near = met.withColumn("near", F.split("near", " "))
    first = F.explode(F.sequence(F.lit(0), F.size("near") - F.col("m"))).alias("skip")
    around = near.where(F.size("near") >= F.col("m")).select("uid", "m", "start", "near", first).select(
        "uid", "m", (F.col("start") + F.col("skip")).alias("start"), F.array_join(F.slice("near", F.col("skip") + 1, F.col("m")), " ").alias("words")
    )
    around = saved(around.distinct(), "around")
    hit = saved(around.join(texts, ["m", "words"]).select("uid", "start", "m", "wid"), "hit-windows")
    spans = F.array_sort(F.collect_set(F.struct("start", "m")))
    per_doc = hit.groupBy("uid").agg(spans.alias("spans"), F.sort_array(F.collect_set("wid")).alias("wids"))
    per_doc = saved(per_doc.withColumn("combo", F.sha2(F.array_join(F.col("wids").cast("array<string>"), ","), 256)), "hit-documents")
    # documents with the same windows share one list of items
    combos = per_doc.groupBy("combo").agg(F.first("wids").alias("wids")).select("combo", F.explode("wids").alias("wid"))
    named = combos.join(texts.join(windows, ["m", "words"]).select("wid", "item"), "wid")
    listed = named.groupBy("combo").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    found = per_doc.join(saved(listed, "hit-items"), "combo", "left").select("uid", "spans", "items", _covered(F.col("spans")).alias("n_hit"))
    out = probed.drop("hits").join(saved(found, "found"), "uid", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col),
        *keys,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        "spans",
        F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns and repeated rows
    stay. Whether a document goes depends on its text alone, so texts are matched by two hashes."""
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    texts = docs.select(h1.alias("h1"), F.col(text).alias("text"))
    judged = contamination(texts, items, "h1", "text", keys={"h2": F.xxhash64(F.lit(1), "text")}, **options)
    bad = saved(judged.where("contaminated").select("h1", "h2").distinct(), "contaminated")
    keyed = docs.select(whole_row(docs).alias("row"), h1.alias("h1"), h2.alias("h2"))
    return keyed.join(small_side(bad), ["h1", "h2"], "left_anti").select("row.*")
