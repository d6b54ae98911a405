import random

import pytest

from tests.llm import plain
from tidemark.llm.substrings import cut_repeats


def check(spark, texts, window, k, bits=64):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    path = spark.conf.get("spark.checkpoint.dir") + f"/substrings-{random.random()}"
    df.write.parquet(path)  # rows come in the same order each time
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in cut_repeats(spark.read.parquet(path), window=window, k=k, hash_bits=bits).collect()}
    assert got == dict(enumerate(plain.cut(texts, window)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_few_words_branch_everywhere(spark, seed):
    """A small vocabulary makes k-mers that repeat between different neighbours."""
    r = random.Random(seed)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(60)]
    check(spark, texts, 7, 3)


@pytest.mark.parametrize("seed", [4, 5])
def test_copied_passages(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passages = [[word() for _ in range(r.randrange(10, 60))] for _ in range(4)]
    texts = []
    for _ in range(40):
        w = [word() for _ in range(r.randrange(80))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            at = r.randrange(len(w) + 1)
            w[at:at] = p[a : a + r.randrange(1, 50)]
        texts.append("  ".join(w) if r.random() < 0.3 else "\t".join(w))
    texts += texts[:3] + [" ".join(passages[0])] * 3
    check(spark, texts, 12, 4)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_colliding_hashes_change_nothing(spark, bits):
    """With few bits most words share a hash: nodes, edges and whole paths are taken for equal until their words are read."""
    r = random.Random(bits)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    long = [word() for _ in range(300)]
    texts = [" ".join(word() for _ in range(r.randrange(120))) for _ in range(40)]
    texts += [" ".join(long), " ".join(long[:150] + [word()] + long[150:]), " ".join(long[20:280])] * 2 + texts[:4]
    check(spark, texts, 12, 4, bits)


def test_edges(spark):
    one = " ".join(["w"] * 30)
    long = " ".join(f"x{i}" for i in range(50_000))
    texts = [None, "", " \n\t", "short one", one, "Ä " * 20, long, "y " + long, "a b c\x0bd", one + " end", "naïve 漢字 " * 9]
    check(spark, texts, 8, 3)
    empty = spark.createDataFrame([], "doc_id long, text string, uid string, node int")
    assert cut_repeats(empty).collect() == []


def test_repeated_rows_and_clashing_names(spark):
    text = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(1, text, "a", 5), (1, text, "a", 5), (None, "z " + text, "b", 6)], "doc_id long, text string, uid string, codes int").coalesce(1)
    got = sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in cut_repeats(df, window=10, k=4).collect())
    assert got == [(0, 20, "z"), (1, 20, ""), (1, 20, "")]
