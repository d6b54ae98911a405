import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import alignment

PATHS = f"{alignment.FOLDER}/{alignment.BYTE_BPE}", f"{alignment.FOLDER}/{alignment.PIECE_BPE}"


@pytest.fixture(scope="module")
def both():
    """Each tokenizer by its own library: text to (ids, ends in bytes)."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    letters = {v: k for k, v in alignment._byte_letters().items()}
    assert sorted(letters) == list(range(256))
    back = {c: b for b, c in letters.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def of_a(text):
        found = a.encode(" " + text, add_special_tokens=False)
        return found.ids, [bytes(back[c] for c in t) for t in found.tokens]

    def of_b(text):
        ids = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids]
        return ids, [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]

    return of_a, of_b


def plain(texts, both):
    rows, times = [], Counter()
    for text in texts:
        (x, xs), (y, ys) = (f(text) for f in both) if text else (([], []), ([], []))
        whole = b" " + (text or "").encode()
        if not text or b"".join(xs) != whole or b"".join(ys) != whole:
            rows.append(((0, 0, 0), [], ""))
            continue
        ends = [dict(zip(np.cumsum([len(t) for t in ts]).tolist(), range(len(ts)))) for ts in (xs, ys)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for e in common:
            p, q = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, x[i : p + 1])) + "|" + ",".join(map(str, y[j : q + 1])))
            links.append((x[p], y[q]))
            i, j = p + 1, q + 1
        times.update(links)
        rows.append(((len(x), len(y), len(common)), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, q), n in times.items():
        top[q] = max(top[q], n)
    return [
        (*sizes, len(links), sum(times[k] == top[k[1]] for k in links), sum(times[k] for k in links), digest) for sizes, links, digest in rows
    ]


def sample(n=60):
    r = random.Random(5)
    parts = ["the", "The", "Straße", "漢字", "naïve", "🙂", "don't", "  ", "\n", "\n\n", "\t", "123", "1,234.5", "<s>", "<|endoftext|>", " ", "é", "é", "\x00", "foo_bar", "...", "ω", "▁"]
    texts = ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 80))) for _ in range(n)]
    return texts + [None, "", " ", "x", "▁", "x", "the the the", " lead", "end ", "\n" * 300]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_scored_as_plain(spark, both, block_bytes):
    texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.scored(docs, block_bytes=block_bytes).collect()}
    assert [found[i] for i in range(len(texts))] == plain(texts, both)


def test_groups_are_slices_of_both_lists(spark, both):
    texts = sample(20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.align(docs).collect():
        want = plain([texts[r.doc_id]], both)[0]
        assert (len(r.a_ids), len(r.b_ids), len(r.a_sizes)) == want[:3]
        assert (sum(r.a_sizes), sum(r.b_sizes)) == want[:2] and all(r.a_sizes) and all(r.b_sizes)


def test_gallop_places_as_a_search_does():
    r = np.random.default_rng(3)
    for _ in range(200):
        lists = sorted((np.unique(r.integers(0, r.integers(1, 5000), r.integers(0, 700))) for _ in range(2)), key=len)
        assert (alignment.gallop(*lists) == np.searchsorted(lists[1], lists[0])).all()
        a, b = alignment.common_ends(lists[1], lists[0])
        assert (lists[1][a] == lists[0][b]).all() and len(a) == len(np.intersect1d(*lists))


def test_ids_are_those_of_the_vocabulary_file(both):
    texts = [t for t in sample(200) if t]
    assert alignment.byte_bpe(PATHS[0]).encode(texts) == [both[0](t)[0] for t in texts]


def test_very_long_white_space_and_words():
    a, b = (f(p) for f, p in zip((alignment.byte_bpe, alignment.piece_bpe), PATHS))
    texts = [" " * 1_500_000 + "x", "a" * 200_000, "\n" * 60_000]
    found = alignment.align_texts(texts, a, b)
    assert (np.diff(found.first_group) > 0).all()


def test_repeated_rows_other_columns_and_no_rows(spark):
    rows = [(1, "to be", 2, {"a": 1}), (1, "to be", 2, {"a": 1}), (None, "or not", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, `block.a` map<string,int>")
    found = sorted(tuple(r) for r in alignment.scored(docs).fillna(-1, ["doc_id"]).select("doc_id", "n_links", "count_sum").collect())
    once = alignment.scored(docs.where("doc_id = 1").limit(1)).first()
    assert [f[0] for f in found] == [-1, 1, 1] and found[1] == (1, once.n_links, 2 * once.count_sum)
    assert alignment.scored(docs.limit(0)).count() == 0 and alignment.align(docs.limit(0)).count() == 0
    strings = spark.createDataFrame([("k", "words")], "`a.b` string, body string")
    assert alignment.scored(strings, id_col="a.b", text="body").first()[0] == "k"
