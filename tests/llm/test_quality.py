import random

from tests.llm import plain
from tidemark.llm import quality


def test_counts(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["a", "b", "Ünï", "x#", "$%&", "<b>", "漢字|"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 30, 200, 4000)]
    texts += [None, "", " \n \t", "a\nb\na\n\n \na", "same line\nsame line\nsame line ", "w " * 500, "a\x0bb\x0cc\rd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality.measured(df).collect():
        t = texts[x.doc_id] or ""
        w = plain.words(t)
        lines = [y for y in t.split("\n") if plain.words(y)]
        assert (x.n_words, x.word_chars) == (len(w), sum(map(len, w)))
        assert x.n_symbols == sum(c in quality.SYMBOLS for c in t)
        assert (x.n_dup_lines, x.n_lines) == (len(lines) - len(set(lines)), len(lines))
        assert x.n_repeat_words == plain.repeat_words(t)


def test_bucket_is_the_eight_highest_bits(spark):
    values = [0, 1, 255, 256, 257, 1000, 65_537, 10**9, 10**15]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r[0] for r in df.select(quality.bucket(df.v)).collect()]
    assert got == [v >> max(0, v.bit_length() - 8) << max(0, v.bit_length() - 8) for v in values]


def good(r, n=120):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(n))


def test_sketches_add_up_whatever_the_parts(spark):
    r = random.Random(2)
    rows = [(i, good(r), "en", r.choice("ab")) for i in range(60)]
    df = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    whole = {tuple(x) for x in quality.sketches(df).collect()}
    parts = quality.sketches(df.where("doc_id < 20")).unionByName(quality.sketches(df.where("doc_id >= 20")))
    assert {tuple(x) for x in parts.groupBy("lang", "source", "rule", "bucket").sum("n").collect()} == whole


def test_rules_follow_the_group(spark):
    """A third of one source is junk; another source's documents all have some symbols."""
    r = random.Random(3)
    rows = [(i, good(r), "en", "hot") for i in range(200)]
    rows += [(1000 + i, " ".join(w + "###" for w in good(r).split()), "en", "hot") for i in range(100)]
    rows += [(2000 + i, " ".join(w + ("#" if k % 3 else "") for k, w in enumerate(good(r).split())), "xx", "code") for i in range(100)]
    rows += [(3000, "too short", "en", "hot"), (3001, None, None, None), (3002, "", "en", None), (3003, "w " * 80, "en", "hot"), (3004, good(r), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality.quality(df).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept for i in range(100))
    assert all(got[2000 + i].kept for i in range(100))
    assert [got[3000 + k].base_failed for k in range(5)] == [True, True, True, True, False]
    assert got[3004].kept
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, x in got.items() if x.kept)


def test_empty_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_words int, _w string, row int"
    empty = spark.createDataFrame([], schema)
    assert quality.quality(empty).collect() == [] and quality.keep(empty).collect() == []
    r = random.Random(4)
    one = spark.createDataFrame([(1, good(r), "en", "a", 7, "x", 2)] * 2, schema)
    assert quality.keep(one).collect() == one.collect()


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (quality.quality(docs), quality.keep(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("Python", "Arrow", "Pandas", "ExistingRDD") if x in plan]


def test_labelled_documents(spark, sf_dir):
    """Labels are no input: nearly all good documents that pass the base rules stay, nearly no bad ones."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    rates = [sum(x.kept for x in rows if x.quality == q) / max(1, sum(x.quality == q for x in rows)) for q in (0, 1)]
    assert rates[1] > 0.97 and rates[0] < 0.35
