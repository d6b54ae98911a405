import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn int, role string, text string"


def rebuilt(rows):
    """Conversations of the contract, by plain lists."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def plain(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                children[tuple(ts[: d - 1])].add(tuple(ts[:d]))

    sums = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves = 0 if children[node] else 1
        for child in children[node]:
            leaves, saved = leaves + sums[child][0], saved + sums[child][1]
        sums[node] = leaves, saved
    out = []
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), parent, len(ms), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, container=trie.CONTAINER):
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(3)
    nodes = trie.nodes(trie.with_shared_heads(trie.turns_of(conversations)), container)
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=str)


def talks(seed, n, alphabet=3, longest=9, base=0, step=1):
    r = random.Random(seed)
    rows = []
    for c in range(base, base + n * step, step):
        kept = [t for t in range(r.randint(1, longest))]
        for t in kept:
            rows.append((c, t, r.choice(["user", "assistant"]), "x" * r.randint(0, alphabet)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("container", [1, 7, 40, 20_000])
def test_nodes_as_plain(spark, container):
    rows = talks(1, 240)
    assert found(spark, rows, container) == plain(rebuilt(rows))


@pytest.mark.parametrize("container", [1, 20_000])
def test_ties_nulls_repeats_and_conversations_without_turns(spark, container):
    rows = talks(2, 60, alphabet=1, longest=3, base=101, step=7)  # most bases are not there
    rows += [(None, 1, "user", "x"), (5, None, "user", "late"), (5, 0, None, None), (5, 0, "", ""), (5, None, "user", "late"), (-3, 1, "a", "b"), (-250, 0, "a", "b")]
    want = plain(rebuilt(rows))
    assert any(len(ts) == 0 for ts in rebuilt(rows).values())
    assert found(spark, rows, container) == want


@pytest.mark.parametrize("container", [3, 50])
def test_many_copies_and_a_long_common_start(spark, container):
    start = [("user", f"s{i}") for i in range(45)]
    rows = [(c, i, *t) for c in range(1000, 1060) for i, t in enumerate(start + [("user", f"own{c % 7}")] * (c % 3))]
    rows += talks(4, 20)
    assert found(spark, rows, container) == plain(rebuilt(rows))


def test_ids_of_copies_meet_in_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "_ID_BITS", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 400, 100)] + [(c, 0, "user", "same") for c in range(-40, 300) if c % 100]
    assert found(spark, rows) == plain(rebuilt(rows))


def test_one_very_long_conversation(spark):
    rows = [(100, i, "user", "y" * (i % 3)) for i in range(3000)] + [(101, i, "user", "y" * (i % 3)) for i in range(1500)]
    convs = rebuilt(rows)
    got = found(spark, rows, 100)
    assert len(got) == 3001 and {g[1]: g[3] for g in got} == {d: 2 if d <= len(convs[101]) else 1 for d in range(3001)}


def test_other_columns_and_no_rows(spark):
    rows = [(0, 0, "user", "hi", {"a": 1}, 1), (1, 0, "user", "hi", None, 2)]
    wide = spark.createDataFrame(rows, SCHEMA + ", `turns.id` map<string,int>, m long")
    narrow = [r[:4] for r in rows]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.nodes(trie.with_shared_heads(trie.turns_of(wide))).collect()), key=str)
    assert got == plain(rebuilt(narrow))
    assert trie.nodes(trie.with_shared_heads(trie.turns_of(wide.limit(0)))).count() == 0
