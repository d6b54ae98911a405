import random

from tests.llm import plain
from tidemark.llm import decontaminate


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect())


def want(docs, items):
    return sorted(((i is None, i or 0), n, hit, ids, hit > 0) for (i, _), (n, hit, ids) in zip(docs, plain.contamination([t for _, t in docs], items)))


def test_against_plain(spark):
    r = random.Random(1)
    vocab = ["The", "cat", "Über", "x1", "sat", "on", "a", "mat", "日本"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(i, text(r.randrange(8, 25))) for i in range(30)] + [(50, "one two three"), (51, "UNIQUEWORD"), (52, None), (53, "..."), (54, "one two three")]
    docs = [(i, text(r.randrange(60))) for i in range(40)]
    for k in range(20):
        words = items[k][1].split()
        a = r.randrange(len(words))
        docs.append((100 + k, text(10) + " " + " ".join(words[a : a + r.randrange(8, 14)]) + "! " + text(9)))
    docs += [(200, "we say: One, two THREE four"), (201, "uniqueword"), (202, None), (203, ""), (204, " ".join(t for _, t in items if t)), (None, items[0][1]), (205, items[3][1]), (205, items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b)
    assert rows_of(got) == want(docs, items)
    clean = decontaminate.clean(d, b)
    dirty = {t for (_, t), (_, hit, _) in zip(docs, plain.contamination([t for _, t in docs], items)) if hit}
    assert sorted(map(str, clean.collect())) == sorted(str(x) for x in d.collect() if x.text not in dirty)


def test_winnowing_keeps_a_hash_of_every_window(spark):
    """Passages of exactly ten words, at every place and at both ends of a text."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randrange(10, 40)))) for i in range(50)]
    docs = []
    for i, t in items:
        w = t.split()
        a = r.randrange(len(w) - 9)
        before, after = [word() for _ in range(i % 4)], [word() for _ in range(i % 3)]
        docs += [(i, " ".join(before + w[a : a + 10] + after)), (1000 + i, " ".join(before + w[a : a + 9] + after))]
    got = {x.doc_id: x.n_hit for x in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[i] == 10 and got[1000 + i] == 0 for i, _ in items)


def test_empty_tables_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 3, "x")], "doc_id long, text string, uid int, hits string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs, none).collect()] == [(3, 0, [], False)]
    assert decontaminate.clean(docs, none).collect() == docs.collect()
    assert decontaminate.contamination(docs.limit(0), none).collect() == []
    null_id = spark.createDataFrame([(None, "a b"), (4, "a b")], "item_id long, text string")
    got = decontaminate.contamination(docs, null_id).first()
    assert (got.n_hit, got["items"]) == (2, ["4"])
    assert decontaminate.clean(docs, null_id).collect() == []
