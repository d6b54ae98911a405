"""A quality classifier from overlapping heuristics instead of labels.

Eleven heuristic labellers vote good, bad or not at all on a text. How often each of them errs, and how
common good texts are, is estimated by expectation-maximisation from the counts of vote patterns (at most
3^11 rows, whatever the corpus). The posteriors of the patterns then teach a linear scorer over hashed
features of the text, which also judges what no labeller votes on. The scorer learns from a sample of at
most about ``TRAIN_ROWS`` texts; votes, pattern counts and scores cover all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import word_count
from tidemark.llm.words import SPACED, Block, Spans, blocks, lists, mix

TRAIN_ROWS, FEATURE_BITS = 10_000, 16
#: Features of all texts that are learned from, at most about so many: of very long texts there are fewer.
TRAIN_FEATURES = 20_000_000
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "repeats", "lines", "length", "word_length", "capitals", "sentences", "letters", "marks", "echoes", "top_word")

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = np.array([chr(b).isalpha() if b < 128 else b >= 0xC0 for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_MARK = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])
_STOP = np.isin(np.arange(256), list(b".!?"))
_LEAD = np.array([b < 0x80 or b >= 0xC0 for b in range(256)])


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(flags, dtype=np.int64))


def _repeated(block: Block, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """For each word whether a window of ``size`` words over it occurs twice or more in its text."""
    n, text = len(hashes), block.text
    out = np.zeros(n + 1, np.int64)
    at = np.arange(max(0, n - size + 1))
    at = at[at + size <= block.first[text[at] + 1]]
    if len(at):
        window = mix(Spans(hashes).of(at, at + size) + text[at].astype(np.uint64))
        _, which, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        np.add.at(out, twice, 1)
        np.add.at(out, twice + size, -1)
    return np.cumsum(out)[:-1] > 0


def _duplicate_lines(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier one (as words), for each text."""
    lines, repeats = np.zeros(len(block.rows), np.int64), np.zeros(len(block.rows), np.int64)
    if len(block.starts):
        hashes, text = block.hashes(3), block.text
        breaks = np.flatnonzero(block.data == 0x0A)
        line = np.searchsorted(breaks, block.starts)
        new = np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1]))
        first = np.flatnonzero(new)
        key = mix(Spans(hashes).of(first, np.append(first[1:], len(line))) + text[first].astype(np.uint64))
        _, at = np.unique(key, return_index=True)
        lines = np.bincount(text[first], minlength=len(block.rows))
        repeats = lines - np.bincount(text[first[at]], minlength=len(block.rows))
    return lines, repeats


def votes(block: Block, hashes: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """One row of votes for each text, in the order of ``LABELLERS``."""
    rows, n = len(block.rows), block.counts.astype(float)
    some = np.maximum(n, 1)
    per_text = lambda flags: np.diff(_sums(flags)[block.offsets]).astype(float)
    per_word = lambda values: np.bincount(block.text, weights=values, minlength=rows)
    letters = np.maximum(per_text(_LETTER[block.data]), 1)
    in_words = _sums(_LEAD[block.data])
    word_length = per_word(in_words[block.ends] - in_words[block.starts]) / some
    stops = per_word(_STOP[block.data[block.ends - 1]]) / some
    # words that end in two marks, or are one
    last, first = block.ends - 1, block.starts
    marks = per_word(_MARK[block.data[last]] & (_MARK[block.data[np.maximum(last - 1, first)]])) / some
    text = block.text
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]))[: len(text)]
    _, at, times = np.unique(mix(hashes + text.astype(np.uint64)), return_index=True, return_counts=True)
    top = np.zeros(rows)
    np.maximum.at(top, text[at], times)
    echoes, top = per_word(same) / some, top / some
    letter_share = letters / np.maximum(per_text(SPACED[block.data]), 1)
    lines, copies = _duplicate_lines(block)
    symbols, repeats = per_text(_SYMBOL[block.data]) / some, per_word(repeated) / some
    capitals, copied = per_text(_UPPER[block.data]) / letters, copies / np.maximum(lines, 1)
    # (bad if, good if), for each labeller
    rules = [
        (symbols > 0.1, symbols <= 0.01),
        (repeats > 0.4, repeats < 0.15),
        (copied > 0.3, (copies == 0) & (lines >= 2)),
        (n < 4, n >= 60),
        ((word_length < 2.5) | (word_length > 12), (word_length > 3) & (word_length < 9)),
        (capitals > 0.4, capitals < 0.15),
        ((n >= 30) & ((stops < 0.005) | (stops > 0.5)), (n >= 30) & (stops > 0.02) & (stops < 0.4)),
        (letter_share < 0.8, letter_share > 0.9),
        (marks > 0.2, marks < 0.05),
        ((n >= 10) & (echoes > 0.1), (n >= 10) & (echoes < 0.03)),
        ((n >= 30) & (top > 0.2), (n >= 30) & (top < 0.13)),
    ]
    out = np.full((rows, len(rules)), NONE, np.int8)
    for k, (bad, good) in enumerate(rules):
        out[good, k] = GOOD
        out[bad, k] = BAD
    out[n == 0, :] = NONE
    out[n == 0, 3] = BAD
    return out


def features(block: Block, hashes: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted: shares of a text's words by their last three bytes, by shape, by how
    much of the text the same word makes up, and in repeated windows; each text's values have length 1."""
    text, size = block.text, block.counts[block.text]
    first, last, length = block.data[block.starts], block.data[block.ends - 1], block.ends - block.starts
    tail = last.astype(np.uint64)
    for k in (2, 3):
        tail |= np.where(length >= k, block.data[np.maximum(block.ends - k, 0)], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
    upper, digit = _sums(_UPPER[block.data]), _sums(_DIGIT[block.data])
    shape = (
        np.minimum(upper[block.ends] - upper[block.starts], 3) + 4 * _UPPER[first] + 8 * (digit[block.ends] > digit[block.starts])
        + 16 * _SYMBOL[last] + 32 * _STOP[last] + 64 * np.minimum(length // 4, 7)
    ).astype(np.uint64)
    _, which, times = np.unique(mix(hashes + text.astype(np.uint64)), return_inverse=True, return_counts=True)
    share = np.minimum(np.floor(-np.log2(times[which] / np.maximum(size, 1))), 12).astype(np.uint64)
    kinds = [tail, shape, share, repeated.astype(np.uint64)]
    slots = np.concatenate([mix(v * np.uint64(8) + np.uint64(k)) >> np.uint64(64 - FEATURE_BITS) for k, v in enumerate(kinds)])
    pair, times = np.unique(np.tile(text, len(kinds)).astype(np.int64) << FEATURE_BITS | slots.astype(np.int64), return_counts=True)
    of, slot = pair >> FEATURE_BITS, pair & ((1 << FEATURE_BITS) - 1)
    value = np.sqrt(times / np.maximum(block.counts[of], 1))
    norm = np.sqrt(np.bincount(of, weights=value**2, minlength=len(block.rows)))
    return of, slot, value / norm[of]


def _rates(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray) -> np.ndarray:
    """What posteriors say of the labellers: row 0 has the logarithms of being bad and good, row k + 1 those of each vote of labeller k
    on either; no vote says nothing."""
    weight = np.stack([counts * (1 - post), counts * post])
    prior = np.log((weight.sum(axis=1) + 1) / (counts.sum() + 2))
    out = [np.column_stack([prior, prior, prior])]
    for k in range(patterns.shape[1]):
        rate = np.stack([weight[:, patterns[:, k] == v].sum(axis=1) + 1 for v in (BAD, GOOD)], axis=1)
        out.append(np.column_stack([np.log(rate / rate.sum(axis=1, keepdims=True)), np.zeros(2)]))
    return np.stack(out)


def posterior(patterns: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The posterior of being good for votes of any pattern."""
    log = rates[0][:, :1] + np.zeros((2, len(patterns)))
    for k in range(patterns.shape[1]):
        log = log + rates[k + 1][:, patterns[:, k]]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior of being good for each vote pattern, by expectation-maximisation.

    It starts from the share of good votes; each labeller that votes has its own rate of bad votes
    on good and on bad texts, smoothed by one text."""
    good = (patterns == GOOD).sum(axis=1)
    post = (good + 0.5) / (good + (patterns == BAD).sum(axis=1) * 3 + 1.0)
    for _ in range(rounds):
        after = posterior(patterns, _rates(patterns, counts, post))
        done = np.abs(after - post).max() < 1e-9
        post = after
        if done:
            break
    return post


def fit(of: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, times: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer, the constant last, of texts that count ``times``, by gradient steps of a size of their own for each weight."""
    w, seen = np.zeros((1 << FEATURE_BITS) + 1), np.full((1 << FEATURE_BITS) + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(of, weights=value * w[slot], minlength=len(target)) + w[-1]
        err = times * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.append(np.bincount(slot, weights=value * err[of], minlength=1 << FEATURE_BITS), err.sum()) / max(1.0, times.sum()) + ridge * w
        seen += grad**2
        w -= 0.5 * grad / np.sqrt(seen)
    return w


@dataclass(frozen=True)
class Model:
    posteriors: dict[tuple[int, ...], float]
    weights: np.ndarray
    rates: np.ndarray | None = None

    def believed(self, cast: np.ndarray) -> np.ndarray:
        """Posteriors of votes; those of patterns that were not learned from come from the labellers' rates."""
        known = [self.posteriors.get(tuple(v)) for v in cast.tolist()]
        new = np.array([v is None for v in known], bool)
        out = np.array([0.5 if v is None else v for v in known])
        if new.any() and self.rates is not None:
            out[new] = posterior(cast[new], self.rates)
        return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    for block in blocks(batch.column("text"), SPACED):
        hashes = block.hashes()
        yield block, hashes, _repeated(block, hashes)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, hashes, repeated in _blocks(batch):
            text = ["".join(map(str, v)) for v in votes(block, hashes, repeated)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["votes"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, hashes, repeated in _blocks(batch):
            of, slot, value = features(block, hashes, repeated)
            per = np.bincount(of, minlength=len(block.rows))
            text = ["".join(map(str, v)) for v in votes(block, hashes, repeated)]
            times = batch.column("times").slice(block.rows.start, len(block.rows))
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), lists(slot, per, pa.int32()), lists(value, per, pa.float32()), times], ["votes", "slots", "values", "times"])


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, repeated in _blocks(batch):
                cast = votes(block, hashes, repeated)
                of, slot, value = features(block, hashes, repeated)
                z = np.bincount(of, weights=value * model.weights[slot], minlength=len(cast)) + model.weights[-1]
                post = model.believed(cast)
                own = batch.column("id").slice(block.rows.start, len(block.rows))
                score = np.where(block.counts > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [own, lists(cast.ravel(), np.full(len(cast), cast.shape[1]), pa.int32()), pa.array(post), pa.array(score)], ["id", "votes", "posterior", "score"]
                )

    return run


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    """Patterns over all of ``docs``; a scorer from at most about ``TRAIN_ROWS`` of them, picked by a hash of id and text, and fewer where these
    have more than ``TRAIN_FEATURES`` features.

    Equal rows are picked together, as one text that counts as often as they are."""
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(F.lit(19), F.col(id_col).cast("string"), text).alias("h"))
    counted = rows.select("text").mapInArrow(_vote, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()
    counted = sorted((tuple(map(int, r.votes)), r.n) for r in counted)
    if not counted:
        return Model({}, np.zeros((1 << FEATURE_BITS) + 1))
    patterns, counts = np.array([p for p, _ in counted]), np.array([n for _, n in counted], float)
    post = estimate(patterns, counts)
    posteriors = dict(zip((p for p, _ in counted), post.tolist()))
    share = min(1.0, TRAIN_ROWS / counts.sum())
    drawn = rows.where(F.shiftrightunsigned("h", 34) < F.lit(math.ceil(share * (1 << 30))))
    drawn = drawn.groupBy("h", "text").agg(F.count("*").alias("times"))
    load = drawn.agg(F.sum(F.least(4 * word_count(F.col("text")), F.lit(1 << FEATURE_BITS)))).first()[0] or 0
    if load > TRAIN_FEATURES:
        again = F.shiftrightunsigned(F.xxhash64(F.lit(23), "h"), 34)
        drawn = drawn.where(again < F.lit(math.ceil(TRAIN_FEATURES / load * (1 << 30))))
    kinds = StructType([StructField("votes", StringType()), StructField("slots", ArrayType(IntegerType())), StructField("values", ArrayType(FloatType())), StructField("times", LongType())])
    got = drawn.select("text", "times").mapInArrow(_sample, kinds).withColumn("order", F.xxhash64("slots", "values")).toArrow()
    got = got.sort_by([("votes", "ascending"), ("order", "ascending"), ("times", "ascending")])
    slots, values = got.column("slots").combine_chunks(), got.column("values").combine_chunks()
    per = slots.value_lengths().to_numpy(zero_copy_only=False)
    target = np.array([posteriors[tuple(map(int, v))] for v in got.column("votes").to_pylist()])
    return Model(posteriors, fit(np.repeat(np.arange(len(per)), per), slots.flatten().to_numpy(), values.flatten().to_numpy(), target, got.column("times").to_numpy().astype(float)), _rates(patterns, counts, post))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``votes`` (in the order of ``LABELLERS``: 1 good, 0 bad, 2 none), ``posterior``
    (what the votes say) and ``score`` (what the scorer says; 0 for a text without words), both from 0 to 1.

    The model may have been learned on other documents; one learned on none says 0.5 of all votes. Null and
    empty texts have no words. Repeated rows are judged alike; an empty table gives no rows; other columns
    are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kinds = StructType([rows.schema["id"], StructField("votes", ArrayType(IntegerType())), StructField("posterior", DoubleType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_judge(model), kinds).withColumnRenamed("id", id_col)
