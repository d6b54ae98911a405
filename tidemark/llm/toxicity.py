"""Toxicity by a weighted finite-state pattern grammar.

Words and marks of a text are symbols, and small transducers read them. Each is a table of arcs, (state, symbol) to
(state, marks); a symbol without an arc leaves the state. ``compose`` makes one machine of two, whose states are pairs and whose marks
are both machines'; the grammar is the composition of four:

* ``NEGATION``: a negating word marks the next ``NEGATION_REACH`` words, unless "only" follows it;
* ``REPORTED``: a reporting word marks the rest of its sentence as someone else's, over a colon, and what it
  introduces in quotes up to the closing one;
* ``TARGET``: a word for someone marks those behind it in the clause; one in the form of an object is told apart;
* ``OBJECT``: what a threatening verb acts on: a target within ``OBJECT_REACH`` words, a thing (a word such as "the" stands first, or
  other words follow), or nothing, at the clause's end.

Beside them run the insults, a lexicon whose weights are learned from labelled documents (log odds of a document being toxic
if it has the word), and fixed phrases, as paths through a trie of words.

Clauses end at full stops, exclamation and question marks, semicolons, colons, quotes and line ends; their matches are closed there. An insult adds its
weight as plain, negated or reported; plain ones also count for the worst clause and, if the clause has
a target besides, as aimed. A threatening verb counts only if it is aimed: its object is a target, or it has a target before it and no object, or
one in the form of an object before it. It adds to ``threat`` if a target stands before it, else to ``threat_ahead``, as phrases do; it counts as
reported after a reporting word, and not at all if negated. A word may have an arc in the lexicon and one of the fixed lists. A document's measures are
those sums and its worst clause, each over the root of its length, and a logistic function of them,
fitted on the same labelled documents, is its score. Threats and reported matches are rare in labels:
the fit draws their weights towards ``PRIOR``, which is what stays where no label speaks. Lexicon and fit use at most ``TRAIN_ROWS`` labelled documents; the fit takes its measures from
lexicons learned on the other half, so a rare word of one document doesn't vouch for itself.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.llm.common import saved
from tidemark.llm.words import ALNUM, LOWER, Block, blocks

#: At most about so many labelled documents are learned from, and so many words kept.
TRAIN_ROWS, LEXICON_WORDS = 20_000, 20_000
LEAST_DOCUMENTS, LEAST_WEIGHT = 3, 1.5
NEGATION_REACH, OBJECT_REACH = 3, 3
MEASURES = ("plain", "worst_clause", "negated", "reported", "aimed", "threat", "threat_ahead")
#: Weights before any label is seen: an aimed threat is worth about what a strong insult is, a reported match a quarter.
PRIOR = {"reported": 1.5, "threat": 25.0, "threat_ahead": 25.0}

# Word lists of the grammar, in English, German, French and Spanish.
THREATS = """
kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying beat beats beaten beating crush crushes crushed crushing
töten töte tötest tötet tötete töteten getötet umbringen umbringe umbringst umbringt umzubringen umgebracht
schlagen schlage schlägst schlägt schlagt schlug schlugen geschlagen zerstören zerstöre zerstörst zerstört zerstörte zerstörten
tuer tue tues tuons tuez tuent tué tuerai tueras tuera tuerons tuerez tueront
frapper frappe frappes frappons frappez frappent frappé frapperai frapperas frappera frapperons frapperez frapperont
détruire détruis détruit détruisons détruisez détruisent détruirai détruiras détruira détruirons détruirez détruiront
matar mato matas mata matamos matan matado matando mataré matarás matará mataremos matarán
golpear golpeo golpeas golpea golpeamos golpean golpeado golpearé golpearás golpeará golpearemos golpearán
destruir destruyo destruyes destruye destruimos destruyen destruido destruiré destruirás destruirá destruiremos destruirán
""".split()
TARGETS = "you your yours he she they du ihr sie tu ton vous votre ils tú usted ustedes ellos".split()
OBJECTS = "him her them dir dich dein euch te toi ti".split()  # targets in the form of an object
NEGATIONS = "not never no neither nor nicht nie kein keine ne pas jamais aucun nunca ningún ninguna".split()
ONLY = "only just merely nur bloß seulement solo solamente".split()
REPORTS = """
said says claimed wrote called quoted warned warns threatened sagte sagt schrieb nannte warnte drohte
dit disait écrit appelé avertit menaça dijo dice escribió llamó advirtió amenazó
""".split()
THINGS = "the a an this that these those its our der das den dem ein eine einen le la les un une des el los las una unos unas".split()
PHRASES = """
go die; die in a fire; drop dead; rot in hell; burn in hell; go to hell; kill yourself; hang yourself; you are dead; watch your back
fahr zur hölle; verrecke; geh sterben; va mourir; va en enfer; crève; vete al infierno; muérete
""".replace("\n", ";").split(";")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Symbols: classes of words, then marks between words.
OTHER, THREAT, TARGET_WORD, OBJECT_WORD, NEGATION_WORD, ONLY_WORD, REPORT_WORD, THING, CLAUSE, FRAME, QUOTE, BREAK = range(12)
WORD_CLASSES, BOUNDS = range(OTHER, CLAUSE), range(CLAUSE, BREAK + 1)
_FIXED = ((THREAT, THREATS), (TARGET_WORD, TARGETS), (OBJECT_WORD, OBJECTS), (NEGATION_WORD, NEGATIONS), (ONLY_WORD, ONLY), (REPORT_WORD, REPORTS), (THING, THINGS))
_BOUND = np.zeros(256, np.int8)
for _signs, _symbol in ((b".!?;", CLAUSE), (b":", FRAME), (b'"', QUOTE), (b"\n", BREAK)):
    _BOUND[list(_signs)] = _symbol
# Marks of an arc: what holds of the word that is read, and what becomes of threats that wait for an object.
NEGATED, REPORTED_BY, BEFORE, BEFORE_OBJECT, AIMED, AT_THING, AT_END = (1 << i for i in range(7))

State = Hashable


@dataclass(frozen=True)
class Transducer:
    start: State
    arcs: dict[tuple[State, int], tuple[State, int]]

    def read(self, state: State, symbol: int) -> tuple[State, int]:
        return self.arcs.get((state, symbol), (state, 0))

    def states(self) -> set[State]:
        return {self.start, *(s for s, _ in self.arcs), *(s for s, _ in self.arcs.values())}


def compose(a: Transducer, b: Transducer) -> Transducer:
    """One machine that reads as both do: pairs of states that can be reached, marks of both."""
    start, arcs = (a.start, b.start), {}
    open_, seen = [start], {start}
    while open_:
        x, y = state = open_.pop()
        for symbol in (*WORD_CLASSES, *BOUNDS):
            (x1, m1), (y1, m2) = a.read(x, symbol), b.read(y, symbol)
            arcs[state, symbol] = (x1, y1), m1 | m2
            if (x1, y1) not in seen:
                seen.add((x1, y1))
                open_.append((x1, y1))
    return Transducer(start, arcs)


def _negation(reach: int) -> Transducer:
    """The state is how many words are still negated."""
    arcs = {(n, w): (n - 1, NEGATED) for n in range(1, reach + 1) for w in WORD_CLASSES}
    arcs |= {(n, w): (0, 0) for n in range(reach + 1) for w in BOUNDS}
    arcs |= {(n, NEGATION_WORD): (reach, NEGATED if n else 0) for n in range(reach + 1)}
    return Transducer(0, {**arcs, (reach, ONLY_WORD): (0, 0)})


def _reported() -> Transducer:
    arcs = {("told", w): ("told", REPORTED_BY) for w in WORD_CLASSES} | {("quoted", w): ("quoted", REPORTED_BY) for w in WORD_CLASSES}
    arcs |= {("own", REPORT_WORD): ("told", 0), ("told", CLAUSE): ("own", 0), ("told", QUOTE): ("quoted", 0), ("quoted", QUOTE): ("own", 0)}
    return Transducer("own", {**arcs, ("told", BREAK): ("own", 0), ("quoted", BREAK): ("own", 0)})


def _target() -> Transducer:
    arcs = {(s, w): (s, m) for s, m in (("subject", BEFORE), ("object", BEFORE | BEFORE_OBJECT)) for w in WORD_CLASSES}
    arcs |= {(s, w): ("none", 0) for s in ("subject", "object") for w in BOUNDS}
    arcs |= {("none", TARGET_WORD): ("subject", 0), ("none", OBJECT_WORD): ("object", 0), ("subject", OBJECT_WORD): ("object", BEFORE)}
    return Transducer("none", arcs)


def _object(reach: int) -> Transducer:
    """The state is how many words the object may still take; ``reach`` right behind the verb."""
    arcs = {(n, w): (n - 1, AT_THING if n == 1 else 0) for n in range(1, reach + 1) for w in WORD_CLASSES}
    arcs |= {(n, w): (0, AIMED) for n in range(1, reach + 1) for w in (TARGET_WORD, OBJECT_WORD)}
    arcs |= {(n, THING): (0, AT_THING) for n in range(1, reach + 1)}
    arcs |= {(n, w): (0, AT_END if n == reach else AT_THING) for n in range(1, reach + 1) for w in BOUNDS}
    return Transducer(0, arcs | {(n, THREAT): (reach, 0) for n in range(reach + 1)})


TRANSDUCERS = (_negation(NEGATION_REACH), _reported(), _target(), _object(OBJECT_REACH))
MACHINE = reduce(compose, TRANSDUCERS)


def _tables(machine: Transducer) -> tuple[list[int], list[int], int]:
    """The machine as lists over state number * 12 + symbol: the next state and the marks; state 0 is the start."""
    states = [machine.start, *(s for s in machine.states() if s != machine.start)]
    number = {s: i for i, s in enumerate(states)}
    found = [machine.read(s, w) for s in states for w in (*WORD_CLASSES, *BOUNDS)]
    return [number[s] for s, _ in found], [m for _, m in found], len(WORD_CLASSES) + len(BOUNDS)


_NEXT, _MARKS, _SYMBOLS = _tables(MACHINE)
#: Other words in a row after which a further one changes nothing.
_SETTLED = max(NEGATION_REACH, OBJECT_REACH)


def _word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``Block.hashes`` gives these words."""
    out = np.zeros(len(words), np.uint64)
    for block in blocks(pa.array(words, pa.string()), ALNUM, LOWER):
        one = np.flatnonzero(block.counts == 1)
        out[block.rows.start + one] = block.hashes()[block.first[one]]
    return out


def _trie(phrases: list[list[int]]) -> dict[tuple[int, int], int]:
    """(node, word number) to node; 0 is the root, and negative nodes end a phrase."""
    arcs: dict[tuple[int, int], int] = {}
    for phrase in phrases:
        node = 0
        for i, w in enumerate(phrase):
            if arcs.get((node, w), 0) < 0:  # a shorter phrase ends here
                break
            node = arcs.setdefault((node, w), (len(arcs) + 1) * (-1 if i == len(phrase) - 1 else 1))
    return arcs


class _Clause:
    """What was matched since the last clause ended. Measures are added to ``row``."""

    __slots__ = ("row", "insults", "targets", "waiting")

    def __init__(self, row: np.ndarray):
        self.row, self.insults, self.targets, self.waiting = row, [], 0, []

    def insult(self, weight: float, marks: int, is_target: bool) -> None:
        as_what = 2 if marks & NEGATED else 3 if marks & REPORTED_BY else 0
        self.row[as_what] += weight
        if as_what == 0:
            self.insults.append((weight, is_target))

    def threat(self, marks: int) -> None:
        if not marks & NEGATED:
            self.waiting.append(marks)

    def phrase(self, marks: int) -> None:
        if not marks & NEGATED:
            self.row[3 if marks & REPORTED_BY else 6] += 1

    def resolve(self, marks: int) -> None:
        """Threats that wait learn what they act on."""
        if self.waiting and marks & (AIMED | AT_THING | AT_END):
            for w in self.waiting:
                if marks & AIMED or w & BEFORE_OBJECT or marks & AT_END and w & BEFORE:
                    self.row[3 if w & REPORTED_BY else 5 if w & BEFORE else 6] += 1
            self.waiting = []

    def close(self) -> None:
        plain = sum(v for v, _ in self.insults)
        self.row[4] += sum(v for v, is_target in self.insults if self.targets > is_target)
        self.row[1] = max(self.row[1], plain)
        self.insults, self.targets = [], 0

    @property
    def idle(self) -> bool:
        return not (self.insults or self.targets or self.waiting)


@dataclass(frozen=True)
class Grammar:
    """Word hashes in order, with each word's class, its weight as an insult and its number in phrases (0 for none)."""

    hashes: np.ndarray
    kinds: np.ndarray
    weights: np.ndarray
    numbers: np.ndarray
    trie: dict[tuple[int, int], int]

    @classmethod
    def of(cls, lexicon: dict[str, float]) -> Grammar:
        arcs = {w: k for k, ws in _FIXED for w in ws}
        phrases = [p.split() for p in PHRASES if p.split()]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(w for p in phrases for w in p), 1)}
        known = list(dict.fromkeys([*arcs, *numbers, *lexicon]))
        hashes = _word_hashes(known)
        order = np.argsort(hashes)
        columns = (np.array([arcs.get(w, OTHER) for w in known], np.int8), np.array([lexicon.get(w, 0.0) for w in known]), np.array([numbers.get(w, 0) for w in known], np.int32))
        return cls(hashes[order], *(c[order] for c in columns), _trie([[numbers[w] for w in p] for p in phrases]))

    def measures(self, block: Block) -> np.ndarray:
        """One row of ``MEASURES`` for each text of the block."""
        out, counts = np.zeros((len(block.rows), len(MEASURES))), block.counts
        if len(block.starts) and len(self.hashes):
            hashes = block.hashes()
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            places = np.flatnonzero(_BOUND[block.data])
            before = np.searchsorted(block.starts, places)  # words that stand before each mark
            marks = _BOUND[block.data[places]].tolist()
            of, first = block.text[hit], np.searchsorted(before, hit, "right")  # marks up to each hit
            columns = (hit, first, self.kinds[at[hit]], self.weights[at[hit]], self.numbers[at[hit]])
            last = np.searchsorted(places, block.offsets[1:])  # marks up to each text's end
            edge = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(hit) else np.empty(0, np.int64)
            for lo, hi in zip(edge, np.append(edge[1:], len(hit))):
                t = int(of[lo])
                self._read(out[t], [c[lo:hi].tolist() for c in columns], before, marks, int(block.first[t + 1]), int(last[t]))
        return out / np.sqrt(counts + 10.0)[:, None]

    def _read(self, row: np.ndarray, hits: list[list], before: np.ndarray, marks: list[int], end: int, last: int) -> None:
        """A text's known words in order. Between them the machine reads other words, as many as change anything, and marks.

        The text's words stop before ``end``, its marks before ``last``."""
        clause, state, node, phrase_marks = _Clause(row), 0, 0, 0
        at, mark = hits[0][0], hits[1][0]  # the next word and mark

        def others(upto: int) -> None:
            nonlocal state, node, at
            if upto > at:
                node = 0
                for _ in range(min(upto - at, _SETTLED)):
                    i = state * _SYMBOLS + OTHER
                    state = _NEXT[i]
                    clause.resolve(_MARKS[i])
                at = upto

        for w, first, kind, weight, number in zip(*hits):
            while mark < first:
                if state == 0 and clause.idle and node == 0:  # nothing that a mark could end
                    mark, at = first, w
                    break
                others(int(before[mark]))
                i = state * _SYMBOLS + marks[mark]
                state, node = _NEXT[i], 0
                clause.resolve(_MARKS[i])
                clause.close()
                mark += 1
            others(w)
            i = state * _SYMBOLS + kind
            state, m = _NEXT[i], _MARKS[i]
            clause.resolve(m)
            is_target = kind in (TARGET_WORD, OBJECT_WORD)
            clause.targets += is_target
            if weight:
                clause.insult(weight, m, is_target)
            if kind == THREAT:
                clause.threat(m)
            phrase_marks = m if node == 0 else phrase_marks
            node = self.trie.get((node, number), 0) if number else 0
            if node == 0 and number:  # a new phrase may start here
                node, phrase_marks = self.trie.get((0, number), 0), m
            if node < 0:
                clause.phrase(phrase_marks)
                node = 0
            at = w + 1
        # what follows the last known word, up to the clause's end
        others(int(before[mark]) if mark < last else end)
        i = state * _SYMBOLS + (marks[mark] if mark < last else BREAK)
        clause.resolve(_MARKS[i])
        clause.close()


def learned_words(text: Column) -> Column:
    """The different words the lexicon is learned from."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""))


def _lexicon(counts: DataFrame, halves: Sequence[int], toxic: float, other: float) -> dict[str, float]:
    """The words of greatest weight by the documents of some halves, ranked where they were counted."""
    p, n = (sum((F.col(f"{h}_{c}") for h in halves), F.lit(0)) for c in "pn")
    weight = F.log((p + 0.05) / F.lit(toxic + 0.1)) - F.log((n + 0.5) / F.lit(other + 1.0))
    weighed = counts.where(p >= LEAST_DOCUMENTS).select("word", weight.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    rows = weighed.orderBy(F.col("weight").desc(), "word").limit(LEXICON_WORDS).toArrow().to_pylist()
    return {r["word"]: r["weight"] for r in rows}


def _scan(grammars: list[Grammar], names: list[str], finish):
    """Measures by one grammar (the row's ``half`` says which if there are several), then ``finish``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("half").to_numpy() if len(grammars) > 1 else None
            found = [np.empty((0, len(MEASURES)))]
            for block in blocks(batch.column("text"), ALNUM, LOWER):
                each = [g.measures(block) for g in grammars]
                own = half[block.rows.start : block.rows.stop] if half is not None else np.zeros(len(block.rows), np.int64)
                found.append(np.stack(each)[own, np.arange(len(own))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), finish(np.concatenate(found))], [*names, "found"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights, the constant last, of rows that count ``n`` times, by Newton's method; the ridge draws them towards ``PRIOR``, or else 0."""
    x = np.column_stack([x, np.ones(len(x))])
    prior = np.array([*(PRIOR.get(m, 0.0) for m in MEASURES), 0.0])
    w = prior.copy()
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, x.T @ (n * (y - p)) - keep @ (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    grammar: Grammar
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from ``docs`` and ``labels`` (id and 0 or 1; other values and nulls don't count). Labels beyond
    ``TRAIN_ROWS`` are thinned by a hash of the id, so reruns learn from the same ones, and the rest is
    small enough to be broadcast. Equal rows are one example that weighs as much as they are; different
    texts under one id are thinned again. Without both labels the model scores all documents alike."""
    known = labels.where(F.col(label).isin(0, 1)).dropna(subset=[id_col]).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("toxic"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))  # of labels that disagree, toxic holds
    # 30 bits, so that the share may be exactly 1
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(13), F.col("id").cast("string")), 34)
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    known = saved(known.where(draw < F.lit(math.ceil(share * (1 << 30)))), "toxic-labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    half = F.pmod(F.xxhash64(F.lit(17), F.col("id").cast("string")), F.lit(2)).cast("int")
    rows = saved(rows.groupBy("id", "toxic", "text", half.alias("half")).agg(F.count("*").alias("n")), "toxic-training")
    again = F.shiftrightunsigned(F.xxhash64(F.lit(19), F.col("id").cast("string"), "text"), 34)
    share = min(1.0, TRAIN_ROWS / max(1, rows.count()))
    rows = rows.where(again < F.lit(math.ceil(share * (1 << 30)))).drop("id")
    sides = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.sum("n").alias("n")).collect()}
    words = rows.select("half", "toxic", "n", F.explode(learned_words(F.col("text"))).alias("word"))
    toxic, other = F.sum(F.col("n") * F.col("toxic")), F.sum(F.col("n") * (1 - F.col("toxic")))
    counts = words.groupBy("word").pivot("half", [0, 1]).agg(toxic.alias("p"), other.alias("n")).na.fill(0)
    counts = counts.where(F.col("0_p") + F.col("1_p") >= LEAST_DOCUMENTS)
    counts = saved(counts, "toxic-words")
    lexicon = lambda halves: _lexicon(counts, halves, *(float(sum(sides.get((h, t), 0) for h in halves)) for t in (1, 0)))
    grammar = Grammar.of(lexicon((0, 1)))
    crossed = [Grammar.of(lexicon((1,))), Grammar.of(lexicon((0,)))]
    kinds = StructType([rows.schema["toxic"], rows.schema["n"], StructField("found", ArrayType(DoubleType()))])
    as_lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    measured = rows.select("toxic", "n", "half", "text").mapInArrow(_scan(crossed, ["toxic", "n"], as_lists), kinds).toArrow()
    y, n = (measured.column(c).to_numpy().astype(float) for c in ("toxic", "n"))
    if len(set(y)) < 2:
        return Model(grammar, np.zeros(len(MEASURES) + 1) - (10 if not y.any() else -10) * np.eye(len(MEASURES) + 1)[-1])
    x = np.stack(measured.column("found").to_numpy())
    order = np.lexsort(x.T)  # sums don't depend on how the rows came
    return Model(grammar, _fit(x[order], y[order], n[order]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``measures`` (in the order of ``MEASURES``) and ``score`` from 0 to 1.

    Null and empty texts match nothing and get the score of a document without matches. Repeated rows
    score alike; an empty table gives no rows; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    as_lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    kinds = StructType([rows.schema["id"], StructField("found", ArrayType(DoubleType()))])
    found = rows.mapInArrow(_scan([model.grammar], ["id"], as_lists), kinds)
    z = F.lit(float(model.weights[-1]))
    for i, w in enumerate(model.weights[:-1]):
        z = z + F.col("found")[i] * F.lit(float(w))
    return found.select(F.col("id").alias(id_col), F.col("found").alias("measures"), (1 / (1 + F.exp(-z))).alias("score"))
