import random

from tidemark.llm import mixture


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, hash long, weight int")


def test_targets_and_taken(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(40)), r.choice(["b", "a", "é", None, "z"]), 0, 0) for i in range(3000)]
    rows += [(5000 + i, "w " * 10, "hot", 0, 0) for i in range(1500)] + [(9000, "only one text", "tiny", 0, 0), (9001, None, "none", 0, 0), (9002, "", "none", 0, 0)]
    got = mixture.mixed(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size, target, taken, largest = {}, {}, {}, {}
    source = {i: s for i, _, s, _, _ in rows}
    for x in got:
        s = source[x.doc_id]
        size[s] = size.get(s, 0) + x.size
        taken[s] = taken.get(s, 0) + x.size * x.copies
        largest[s] = max(largest.get(s, 0), x.size)
        target[s] = x.target
        assert 0 <= x.copies <= 3
    assert all(x.source_size == size[source[x.doc_id]] for x in got)
    # water filling by hand: a unit is raised until all is shared
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        unit = (total - sum(3 * size[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and weight[s] * unit > 3 * size[s]}
        if not more:
            break
        full |= more
    for s in order:
        assert abs(target[s] - (3 * size[s] if s in full else weight[s] * unit)) < 1e-6 * total
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_reruns_agree_and_mix_repeats_rows(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randrange(1, 30)), r.choice("abc"), 0, i) for i in range(400)]
    df = frame(spark, rows)
    copies = {x.doc_id: x.copies for x in mixture.mixed(df).collect()}
    assert copies == {x.doc_id: x.copies for x in mixture.mixed(df.repartition(5)).collect()}
    out = mixture.mix(df)
    assert out.columns == df.columns
    n = {}
    for x in out.collect():
        n[x.doc_id] = n.get(x.doc_id, 0) + 1
    assert n == {k: v for k, v in copies.items() if v}


def test_edges(spark):
    assert mixture.mixed(frame(spark, [])).collect() == [] and mixture.mix(frame(spark, [])).collect() == []
    rows = [(1, None, None, 0, 0), (2, "", "a", 0, 0)]
    assert sorted((x.doc_id, x.size, x.target, x.copies) for x in mixture.mixed(frame(spark, rows)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    same = [(None, "w w", "a", 0, 0)] * 4 + [(1, "w", "a", 0, 0), (1, "w", "a", 0, 0)]
    got = mixture.mixed(frame(spark, same)).collect()
    assert len(got) == 6 and sum(x.size * x.copies for x in got) == 10


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mixture.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Arrow", "Pandas", "ExistingRDD") if x in plan]
