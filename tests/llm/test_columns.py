"""Map, dotted and clashing columns through every operator and stage, and what they do not change."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import alignment, decontaminate, mixture, partenum, quality, sharding, simhash, substrings, toxicity, weaklabels
from tidemark.llm.common import importable, saved, table

ODD = ["a map", "dot.ted", "row", "h1", "hash", "same", "range", "id", "size", "n", "back`tick"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    importable(spark)
    return saved(table(spark, sf_dir, "documents").where("doc_id < 150"), "odd")


def wide(docs):
    odd = [F.create_map(F.lit("k"), F.col("doc_id")), F.struct(F.lit(1).alias("x.y"))]
    return docs.select("*", *[(odd[i] if i < 2 else F.lit(i)).alias(c) for i, c in enumerate(ODD)])


def names(df):
    return [f"`{c.replace('`', '``')}`" for c in df.columns]


OPERATORS = {
    "substrings": lambda d: substrings.cut_repeats(d).select("doc_id", "n_words", "n_removed"),
    "sharding": lambda d: sharding.shard_rows(d, 4).select("doc_id", "size"),
    "mixture": lambda d: mixture.mixed(d),
    "decontaminate": lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(3)).select("doc_id", "n_words", "n_hit"),
    "weaklabels": lambda d: weaklabels.judge(d, weaklabels.learn(d)).select("doc_id", F.round("posterior", 6).alias("p")),
    "quality": lambda d: quality.quality(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))).select("doc_id", F.round("score", 6).alias("s")),
    "simhash": lambda d: simhash.near_copies(d),
    "alignment": lambda d: alignment.scored(d),
    "partenum": lambda d: partenum.similar(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_do_not_mind_other_columns(docs, name):
    plain, odd = OPERATORS[name](docs), OPERATORS[name](wide(docs))
    assert plain.columns == odd.columns and sorted(map(str, plain.collect())) == sorted(map(str, odd.collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_other_columns(spark, sf_dir, docs, name, stage):
    odd = wide(docs)
    out = stage(spark, odd, sf_dir)
    assert out.columns[: len(odd.columns)] == odd.columns
    kept = out.select(*names(odd))
    assert saved(kept, "odd-out").count() > 0
    ids = sorted(r.doc_id for r in out.select("doc_id").collect())
    if name != "sharding":
        assert ids == sorted(r.doc_id for r in stage(spark, docs, sf_dir).select("doc_id").collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_no_rows_and_repeated_rows(spark, sf_dir, docs, name, stage):
    assert saved(stage(spark, wide(docs).limit(0), sf_dir).select("doc_id"), "odd-none").count() == 0
    twice = wide(docs).where("doc_id < 20")
    assert saved(stage(spark, twice.unionByName(twice), sf_dir).select("doc_id"), "odd-twice").count() >= 0


def test_a_model_judges_documents_it_has_not_seen(spark, docs):
    model = weaklabels.learn(docs.where("doc_id < 20"))
    told = weaklabels.judge(docs, model).collect()
    assert len(told) == docs.count() and all(0 <= r.posterior <= 1 for r in told)
    patterns = {tuple(r.votes) for r in weaklabels.judge(docs.where("doc_id < 20"), model).collect()}
    assert any(tuple(r.votes) not in patterns for r in told)
    assert {r.posterior for r in weaklabels.judge(docs, weaklabels.learn(docs.limit(0))).collect()} == {0.5}


def test_a_mix_meets_targets_with_repeated_ids(spark):
    rows = [(7, "w " * (i % 20 + 1), "a") for i in range(400)] + [(1000 + i, "w " * 10, "a") for i in range(200)]
    rows += [(None, "same text here", "b")] * 300 + [(5000 + i, "w " * 30, "b") for i in range(200)] + [(i, "w w", "c") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixture.mixed(df).withColumn("taken", F.col("size") * F.col("copies"))
    again = mixture.mixed(df.repartition(3)).withColumn("taken", F.col("size") * F.col("copies"))
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    sums = found.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(sums) == 3 and all(abs(x.taken - x.target) <= 30 for x in sums)
    assert mixture.mix(df).count() == found.agg(F.sum("copies")).first()[0]
