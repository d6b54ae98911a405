"""Every query of the thirteen operators, against its SQL or its table's rows."""

import pytest

from tests.compare import connect, difference
from tests.llm import plain
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert difference(result, duck, ORACLES[name]) == ""
    else:
        table = "pages" if "page_id" in result.columns else "documents"
        ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(result.columns[0])
        assert sorted(r[0] for r in result.select(result.columns[0]).collect()) == sorted(r[0] for r in ids.collect())


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_simhash_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain.fingerprint(x.text) for x in docs]
    label, least = plain.groups(fps), {}
    for x, g in zip(docs, label):
        least[g] = min(least.get(g, x.doc_id), x.doc_id)
    want = sorted((x.doc_id, f"{fp:016x}", least[g]) for x, fp, g in zip(docs, fps, label))
    assert sorted(tuple(r) for r in QUERIES["op10_simhash"](spark, sf_dir).collect()) == want


def test_classifier_query_against_plain_votes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    votes = [plain.labeller_votes(x.text) for x in docs]
    post = plain.posteriors(votes)
    got = {r.doc_id: r for r in QUERIES["op5_classifier"](spark, sf_dir).collect()}
    assert {i: r.votes for i, r in got.items()} == {x.doc_id: "".join(map(str, v)) for x, v in zip(docs, votes)}
    assert all(abs(got[x.doc_id].posterior - p) < 1e-6 for x, p in zip(docs, post))
    # the scorer agrees with the posteriors it learned from where these are sure
    sure = [(x.doc_id, p) for x, p in zip(docs, post) if abs(p - 0.5) > 0.4]
    assert sum((got[i].score >= 0.5) == (p >= 0.5) for i, p in sure) > 0.97 * len(sure)
