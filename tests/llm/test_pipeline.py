"""The stages in a row, each against a plain version on what the stage before it kept."""

from collections import Counter

import corpus_pipeline
from tests.llm import plain
from tidemark.llm import quality, sharding
from tidemark.llm.common import saved, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, before, sf_dir), "pipeline-test")
        assert after.columns == columns
        check = {"quality rules": rules, "SimHash near-dedup": copies, "benchmark decontamination": leaks, "mixing sources": mixed}[name]
        check(spark, sf_dir, before, after)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert sorted(map(str, ([x[c] for c in columns] for x in last))) == sorted(map(str, map(list, before.collect())))
    held = Counter()
    for s in {x.shard for x in last}:
        slots = sorted(x.slot for x in last if x.shard == s)
        assert slots == list(range(len(slots)))
        held[s] = sum(len((x.text or "").encode()) + sharding.OVERHEAD for x in last if x.shard == s)
    # no shard is further from the mean than the largest text and what may stay together
    mean, longest = sum(held.values()) / corpus_pipeline.SHARDS, max(len((x.text or "").encode()) for x in last)
    assert len(held) == corpus_pipeline.SHARDS and all(abs(n - mean) <= longest + 0.05 * mean for n in held.values())


def rules(spark, sf_dir, before, after):
    rows = before.collect()
    keep = plain.quality([(x.text, x.lang, x.source) for x in rows], quality.RULES, quality.LEAST_GROUP)
    want = sorted(x.doc_id for x, k in zip(rows, keep) if k)
    assert sorted(x.doc_id for x in after.collect()) == want and len(want) > 500


def copies(spark, sf_dir, before, after):
    rows = before.collect()
    label = plain.groups([plain.fingerprint(x.text) for x in rows])
    least = {}
    for x, g in zip(rows, label):
        least[g] = min(least.get(g, x.doc_id), x.doc_id)
    assert sorted(x.doc_id for x in after.collect()) == sorted(least.values())


def leaks(spark, sf_dir, before, after):
    items = [(x.item_id, x.text) for x in table(spark, sf_dir, "benchmark").collect()]
    rows = before.collect()
    found = plain.contamination([x.text for x in rows], items)
    assert sorted(x.doc_id for x in after.collect()) == sorted(x.doc_id for x, (_, hit, _) in zip(rows, found) if not hit)


def mixed(spark, sf_dir, before, after):
    rows = before.collect()
    want = {x.doc_id: n for x, n in zip(rows, plain.mixture([(x.doc_id, x.text, x.source) for x in rows])) if n}
    assert Counter(x.doc_id for x in after.collect()) == want


def test_run_is_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[-2:] == ["shard", "slot"] and got.count() > 300
