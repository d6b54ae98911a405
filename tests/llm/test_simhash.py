import random

import numpy as np

from tests.llm import plain
from tidemark.llm import simhash


def components(spark, fps, **options):
    df = spark.createDataFrame([(int(f) - (1 << 64) if f >> 63 else int(f),) for f in set(fps)], "fp long")
    from tidemark.llm.graph import components

    roots = {r.node: r.root for r in components(simhash.links(df, **options)).collect()}
    out = [roots.get(int(f) - (1 << 64) if f >> 63 else int(f), int(f) - (1 << 64) if f >> 63 else int(f)) for f in fps]
    return out


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def test_fingerprints(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["The", "cat", "ÄRGER", "sat", "x1", "漢"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 3000)] + [None, "", "\n \t"]
    assert [simhash.fingerprint(t) for t in texts] == [plain.fingerprint(t) for t in texts]


def test_links_are_those_of_all_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(150)]
    near = [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(6))) for b in base for _ in range(2)]
    fps = base + [n % (1 << 64) for n in near] + [0, 7, 2**64 - 1]
    assert same_partition(components(spark, fps), plain.groups(fps))


def test_large_buckets_are_dealt_again_and_lose_no_link(spark):
    """Buckets of at most 4: the second deal and the chunks both come into play."""
    r = random.Random(3)
    fps = [0x1234_5678_9ABC_DEF0 ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.getrandbits(8) << 20) for _ in range(250)]
    fps += [r.getrandbits(64) for _ in range(50)]
    assert same_partition(components(spark, fps, bucket=4), plain.groups(fps))


def test_bit_sliced_pairs():
    r = np.random.default_rng(4)
    for radius in (1, 2, 3, 5):
        group = np.sort(r.integers(0, 12, 400))
        fps = r.integers(0, 2**63, 400, dtype=np.uint64) & np.uint64(0x0F0F0F)
        i, j = simhash.linked_pairs(group, fps, radius)
        want = {(a, b) for a in range(400) for b in range(a + 1, 400) if group[a] == group[b] and int(fps[a] ^ fps[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_near_copies_and_one_of_each(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(80)) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate(base)]
    rows += [(100 + i, t + " end", "x") for i, t in enumerate(base[:8])] + [(200 + i, t.upper(), "y") for i, t in enumerate(base[:4])]
    rows += [(300, None, "x"), (301, "", "y"), (None, base[0], "x"), (5, base[5], "x"), (5, base[5], "x"), (7, base[9], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = [plain.fingerprint(t) for _, t, _ in rows]
    label = plain.groups(fps)
    least = {g: min((i for (i, _, _), h in zip(rows, label) if h == g and i is not None), default=None) for g in label}
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component) for r in simhash.near_copies(df).collect())
    assert got == sorted((i is None, i or 0, f, least[g]) for (i, _, _), f, g in zip(rows, fps, label))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    kept = [tuple(x) for x in kept.collect()]
    assert len(kept) == len(set(label)) and set(kept) <= set(rows)
    assert sorted(label[rows.index(k)] for k in kept) == sorted(set(label))
    for k in kept:
        assert k[0] == least[label[rows.index(k)]]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_copies(empty).collect() == [] and simhash.one_of_each(empty).collect() == []


def test_long_chain_is_one_component(spark):
    """Each differs from the next in three bits, the ends in many."""
    fps, f = [], 0
    for k in range(21):
        fps.append(f)
        f ^= 7 << (3 * k)
    assert len(set(components(spark, fps))) == 1
