import random

import numpy as np
import pytest

from tests.llm import plain
from tidemark.llm import partenum


def shingles(text):
    w = plain.words((text or "").translate(plain.FOLD))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def components(ids, texts, percent=90):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, n in enumerate(ids):
        least[find(i)] = min(least.get(find(i), n), n)
    return sorted((n, len(s), least[find(i)]) for i, (n, s) in enumerate(zip(ids, sets)))


def found(spark, ids, texts, percent=90):
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component) for r in partenum.similar(docs, percent=percent).collect())


def edited(r, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        at, kind = r.randrange(len(out)), r.random()
        if kind < 0.6:
            out[at] = r.choice(vocabulary)
        elif kind < 0.8:
            out.insert(at, r.choice(vocabulary))
        else:
            del out[at]
    return out


def near(seed, n, sizes, vocabulary=400):
    """Copies with few or more edits, chains of them, and texts that share most of a passage."""
    r = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    texts, passage = [], [r.choice(names) for _ in range(60)]
    while len(texts) < n:
        base = [r.choice(names) for _ in range(r.choice(sizes))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            base = edited(r, base, r.randint(0, max(1, len(base) // 40)), names)
            texts.append(" ".join(base))
        texts.append(" ".join(passage + [r.choice(names) for _ in range(8)]))
    return texts[:n]


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_components_are_those_of_all_pairs(spark, percent):
    texts = near(1, 260, (1, 2, 3, 5, 9, 12, 20, 40, 90, 300)) + [None, "", "  \n", "one", "One", "one two", "a a a a a a a", "A a a a"]
    ids = random.Random(2).sample(range(10_000), len(texts))
    assert found(spark, ids, texts, percent) == components(ids, texts, percent)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(partenum, "CHUNK", 16)
    r = random.Random(3)
    names = [f"w{i}" for i in range(3000)]
    base = [r.choice(names) for _ in range(120)]
    texts = [" ".join(edited(r, base, r.randint(0, 4), names)) for _ in range(220)] + near(4, 80, (15, 60))
    ids = list(range(len(texts)))
    assert found(spark, ids, texts) == components(ids, texts)


def test_links_do_not_need_the_first_pass(spark, monkeypatch):
    """With chunks of two classes everything that the hubs leave meets in blocks of pairs."""
    monkeypatch.setattr(partenum, "CHUNK", 2)
    texts = near(8, 120, (12, 20, 25))
    ids = list(range(len(texts)))
    assert found(spark, ids, texts) == components(ids, texts)


@pytest.mark.parametrize("cells, spare", [(1, 0), (2, 1), (3, 1), (4, 2)])
@pytest.mark.parametrize("percent", [90, 75])
def test_linked_sets_share_a_signature(cells, spare, percent):
    r = np.random.default_rng(6)
    for size in [10, 11, 13, 14, 15, 19, 20, 21, 22, 30, 60, 200, 1500]:
        for _ in range(30):
            x = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            if r.random() < 0.3:  # all features in few cells, so that most subsets are empty
                x = np.unique(x >> np.uint64(20))
            shared = x[r.random(len(x)) < r.uniform(percent / 100, 1)]
            more = np.unique(r.integers(0, 2**63, r.integers(0, 1 + size // 12), dtype=np.uint64))
            y = np.unique(np.concatenate([shared, more]))
            both = len(np.intersect1d(x, y))
            if 100 * both < percent * (len(x) + len(y) - both) or np.array_equal(x, y):
                continue
            features, first = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
            of, found = partenum.signatures(features, first, percent, cells, spare)
            assert set(found[of == 0].tolist()) & set(found[of == 1].tolist())
            words = partenum.unfold([partenum.sketch(x), partenum.sketch(y)])
            assert np.bitwise_count(words[0] ^ words[1]).sum() <= len(x) + len(y) - 2 * both


def test_bands_cover_all_sizes_once():
    for percent in (50, 80, 90, 99, 100):
        lows = partenum.bands(percent, 10_000)
        assert lows[0] == 1 and (np.diff(lows) > 0).all()
        assert partenum.most_differences(int(lows[1]) - 1 if len(lows) > 1 else 1, percent) == 0


def test_nulls_repeats_other_columns_and_no_rows(spark):
    rows = [(7, "a b c d", {"x": 1}, 1), (7, "a b c d", {"x": 1}, 1), (3, "A B C D", None, 2), (None, "a b c d", None, 3), (None, None, None, 4), (9, "", None, 5), (9, "e f", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `r.n` map<string,int>, id long")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component) for r in partenum.similar(docs).collect() if r.component is not None)
    assert got == [(-1, 2, 3), (3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9), (9, 1, 9)]
    assert partenum.similar(docs).where("doc_id IS NULL AND component IS NULL").count() == 1
    assert partenum.similar(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(9)
    long = [f"w{r.randrange(5000)}" for _ in range(30_000)]
    texts = [" ".join(long), " ".join(long[:15_000] + ["x"] * 40 + long[15_000:]), " ".join(long[: 15_000]), "word " * 20_000]
    assert found(spark, range(4), texts) == components(range(4), texts)
