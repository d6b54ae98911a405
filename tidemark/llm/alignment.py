"""Tokens of two tokenizers over the same bytes: where both end, which ids end together, how often.

Each text is read by a byte-level BPE (after one space) and by a piece model that adds that space itself,
so both give the same bytes. The byte offsets where tokens end are two ascending lists. The shorter one
drives a galloping search into the longer: every end starts where the search for an earlier end has left it,
doubles its step until it has passed, and halves the rest. Indices common to both slice the tokens
into groups; the differences between their ranks are the groups' ranges on either side.

A block of whole texts is aligned at once, in numpy. It holds its links (the ids of the two tokens that end a
group) against a dictionary of its own, so that a corpus' counts are summed and looked up once per block
and id pair instead of once per token: texts are read by the tokenizers once, and token lists are not moved.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tidemark.llm.common import saved

#: Folder of the tokenizers' files, the same on every machine.
FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes of a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Every so many ends one is placed first, and the others start from it.
_STRIDE = 4

# Fixed value: how the byte-level vocabulary's texts are split before merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that the fast splitter has no stack for.
_LONG_SPACE = re.compile(r"\s{50000}")


@dataclass(frozen=True)
class Tokenizer:
    """``encode`` gives each text's ids; ``tokens`` are the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]

    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others,
    in order, for the letters from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> Tokenizer:
    """A byte-level BPE from its JSON file. Its ids rise with the merges' ranks, so they serve as ranks. Texts get one
    space in front; strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    letters, special = _byte_letters(), {t["id"] for t in described["added_tokens"] if t["special"]}
    vocabulary = described["model"]["vocab"]
    tokens = [b""] * (1 + max([*vocabulary.values(), *special]))
    for word, i in vocabulary.items():
        if i not in special:
            tokens[i] = bytes(letters[c] for c in word)
    fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})

    @lru_cache(maxsize=1)
    def slow():
        import tokenizers

        found = tokenizers.Tokenizer.from_file(path)
        found.encode_special_tokens = True
        return found

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            slow().encode(f" {t}", add_special_tokens=False).ids if len(t) >= 50000 and _LONG_SPACE.search(t) else fast.encode_ordinary(f" {t}")
            for t in texts
        ]

    return Tokenizer(encode, tokens)


@lru_cache(maxsize=2)
def piece_bpe(path: str) -> Tokenizer:
    """A piece model from its file; U+2581 stands for a space and <0xHH> for a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Tokenizer(lambda texts: model.encode(texts, num_threads=1), tokens)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of ``short``'s values the first place in ``long`` that is not smaller (its length if none is). Both ascend.

    Every ``_STRIDE``-th value is placed first, by the same search; each other starts from the last of those before it."""
    n = len(short)
    if n <= _STRIDE:
        low = np.zeros(n, np.int64)
    else:
        low = np.repeat(gallop(short[::_STRIDE], long), _STRIDE)[:n]
    # exponential steps: low stays at or before the place, high gets at or behind it
    high, step, open_ = low.copy(), 1, np.arange(n)
    while len(open_):
        at = high[open_]
        inside = at < len(long)
        open_, at = open_[inside], at[inside]
        behind = long[at] < short[open_]
        open_, at = open_[behind], at[behind]
        low[open_] = at + 1
        high[open_] = np.minimum(at + step, len(long))
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, on both sides, of the ends that both lists have."""
    a_drives = len(ends_a) <= len(ends_b)
    short, long = (ends_a, ends_b) if a_drives else (ends_b, ends_a)
    place = gallop(short, long)
    met = np.flatnonzero(place < len(long))
    met = met[long[place[met]] == short[met]]
    return (met, place[met]) if a_drives else (place[met], met)


@dataclass
class Aligned:
    """Tokens of a run of texts and the groups they fall in.

    ``first_a[i]:first_a[i + 1]`` are text i's tokens in ``a`` (ids), likewise for b and for its groups; group g ends with tokens
    ``last_a[g]`` and ``last_b[g]``. A text without tokens has none of either."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_group: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(i) for i in ids], out=first[1:])
    out = np.empty(first[-1], np.int32)
    for i, lo in zip(ids, first):
        out[lo : lo + len(i)] = i
    return out, first


def align_texts(texts: list[str | None], a: Tokenizer, b: Tokenizer) -> Aligned:
    """Null and empty texts, and those whose tokens do not give back their bytes, have no tokens."""
    ids_a, ids_b = [[] for _ in texts], [[] for _ in texts]
    there = [i for i, t in enumerate(texts) if t]
    for i, x, y in zip(there, a.encode([texts[i] for i in there]), b.encode([texts[i] for i in there])):
        whole = f" {texts[i]}".encode()
        if b"".join(map(a.tokens.__getitem__, x)) == whole and b"".join(map(b.tokens.__getitem__, y)) == whole:
            ids_a[i], ids_b[i] = x, y
    (flat_a, first_a), (flat_b, first_b) = _flat(ids_a), _flat(ids_b)
    # texts stand end to end, so a text's end is common and no group spans two
    last_a, last_b = common_ends(np.cumsum(a.lengths()[flat_a]), np.cumsum(b.lengths()[flat_b]))
    return Aligned(flat_a, flat_b, first_a, first_b, np.searchsorted(last_a, first_a), last_a, last_b)


def _group_texts(found: Aligned, strings: list[bytes], offset: int) -> Iterator[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``. ``strings`` has for each id its digits and the sign behind it: inside its
    side of a group, then at its end; b's ids start at ``offset``."""
    n = len(found.a) + len(found.b)
    ends_a, ends_b = np.zeros(len(found.a), np.int64), np.zeros(len(found.b), np.int64)
    ends_a[found.last_a] = ends_b[found.last_b] = 1
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    before_b = np.concatenate([[0], found.last_b + 1])
    codes = np.empty(n, np.int64)
    codes[np.arange(len(found.a)) + before_b[group_a]] = 2 * found.a + ends_a
    codes[np.arange(len(found.b)) + found.last_a[group_b] + 1] = 2 * (found.b + offset) + ends_b
    first = found.first_a + found.first_b
    for lo, hi in zip(first, first[1:]):
        yield b"".join(map(strings.__getitem__, codes[lo:hi].tolist()))[:-1]


@lru_cache(maxsize=1)
def _strings(n_a: int, n_b: int) -> list[bytes]:
    return [b"%d%s" % (i, s) for i in range(n_a) for s in (b",", b"|")] + [b"%d%s" % (i, s) for i in range(n_b) for s in (b",", b";")]


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, small ones short: their bytes by place, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of about ``size`` bytes of texts; rows of several batches meet."""
    ids, texts, have = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            more = len(t or "") + 16
            if ids and have + more > size:
                yield ids, texts
                ids, texts, have = [], [], 0
            ids.append(i)
            texts.append(t)
            have += more
    if ids:
        yield ids, texts


def _columns(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """One row per row of ``docs``: its id, ``a_ids`` and ``b_ids``, and for each group the numbers of its tokens on
    either side (``a_sizes``, ``b_sizes``). Null and empty texts and those that the tokens do not give back have
    empty lists; repeated rows stay; an empty table gives no rows; other columns are not read."""
    rows = _columns(docs, id_col, text)
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("a_ids", "b_ids", "a_sizes", "b_sizes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_bpe(f"{folder}/{BYTE_BPE}"), piece_bpe(f"{folder}/{PIECE_BPE}")
        for ids, texts in _texts(batches, BLOCK_BYTES):
            found = align_texts(texts, a, b)
            sizes = [np.diff(last, prepend=-1) for last in (found.last_a, found.last_b)]
            lists = [
                pa.ListArray.from_arrays(first.astype(np.int32), pa.array(values, pa.int32()))
                for first, values in ((found.first_a, found.a), (found.first_b, found.b), (found.first_group, sizes[0]), (found.first_group, sizes[1]))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ids, _arrow(schema["id"].dataType)), *lists], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_LISTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(rows: DataFrame, folder: str, size: int) -> DataFrame:
    """One row per block: what its texts have, as lists, and their links. ``pairs`` are the block's id pairs, ascending, with
    the ``times`` each is linked; ``links`` are numbers (text, pair), ascending, with the ``link_times`` of each."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        *(T.StructField(n, T.ArrayType(T.LongType())) for n in _LISTS), T.StructField("groups_sha256", T.ArrayType(T.StringType())),
        *(T.StructField(n, T.BinaryType()) for n in ("pairs", "times", "links", "link_times")),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_bpe(f"{folder}/{BYTE_BPE}"), piece_bpe(f"{folder}/{PIECE_BPE}")
        strings, number = _strings(len(a.tokens), len(b.tokens)), TaskContext.get().partitionId() << 32
        for ids, texts in _texts(batches, size):
            found = align_texts(texts, a, b)
            hashed = [hashlib.sha256(s).hexdigest() if s else "" for s in _group_texts(found, strings, len(a.tokens))]
            linked = found.a[found.last_a].astype(np.int64) << 32 | found.b[found.last_b]
            pairs, code, times = np.unique(linked, return_inverse=True, return_counts=True)
            n_groups = np.diff(found.first_group)
            links, link_times = np.unique(np.repeat(np.arange(len(ids)), n_groups) * max(1, len(pairs)) + code, return_counts=True)
            lists = [np.diff(found.first_a), np.diff(found.first_b), n_groups, n_groups]
            blobs = [_pack(np.diff(pairs, prepend=0)), _pack(times), _pack(np.diff(links, prepend=0)), _pack(link_times)]
            row = [number, ids, *[x.tolist() for x in lists], hashed, *blobs]
            yield pa.RecordBatch.from_arrays([pa.array([v], _arrow(f.dataType)) for v, f in zip(row, schema)], names=schema.names)
            number += 1

    return rows.mapInArrow(run, schema)


def _pairs(blocks: DataFrame) -> DataFrame:
    """(block, a, b, n): how often a block links two ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, times in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pair = np.cumsum(_unpack(pairs))
                columns = [np.full(len(pair), block), (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), _unpack(times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "a", "b", "n"])

    return blocks.select("block", "pairs", "times").mapInArrow(run, "block long, a int, b int, n long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best) of all id pairs: how often they are linked, and whether no other id is linked more
    often to b. ``pairs`` has parts of those counts. The largest counts are one row per id of b, so they are broadcast: no more than the
    vocabulary has."""
    counts = saved(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "alignment-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def scored(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = FOLDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, tokens on either side, groups, links, ``n_best`` (links whose count is the
    highest of their b id, ties included), ``count_sum`` (over its links) and ``groups_sha256``.

    Null and empty texts, and texts that the tokens do not give back, have zeros and an empty hash; repeated rows
    stay and count each time; an empty table gives no rows; other columns are not read."""
    rows = _columns(docs, id_col, text)
    blocks = saved(_blocks(rows, folder, block_bytes), "alignment-blocks")
    pairs = _pairs(blocks)
    known = pairs.drop("n").join(link_counts(pairs), ["a", "b"])
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in (*_LISTS, "n_best", "count_sum")),
        T.StructField("groups_sha256", T.StringType()),
    ])

    def score(block: pa.Table, dictionary: pa.Table) -> pa.Table:
        """A block's texts, by its dictionary of counts."""
        if not block.num_rows:
            return pa.Table.from_arrays([pa.array([], _arrow(f.dataType)) for f in schema], names=schema.names)
        row = {n: block.column(n)[0].as_py() for n in block.column_names}
        dictionary = dictionary.sort_by([("a", "ascending"), ("b", "ascending")])
        count, best = dictionary.column("count").to_numpy(), dictionary.column("best").to_numpy().astype(np.int64)
        links, times = np.cumsum(_unpack(row["links"])), _unpack(row["link_times"])
        text_of, pair = np.divmod(links, max(1, len(count)))
        first = np.searchsorted(text_of, np.arange(len(row["ids"]) + 1))

        def per_text(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            return sums[first[1:]] - sums[first[:-1]]

        values = [row["ids"], *(row[n] for n in _LISTS), per_text(times * best[pair]), per_text(times * count[pair]), row["groups_sha256"]]
        return pa.Table.from_arrays([pa.array(v, _arrow(f.dataType)) for v, f in zip(values, schema)], names=schema.names)

    kept = blocks.drop("pairs", "times")
    found = kept.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)
    return found.withColumnRenamed("id", id_col)
