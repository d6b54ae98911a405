import random

import numpy as np
import pyarrow as pa

from tests.llm import plain
from tidemark.llm import toxicity, weaklabels
from tidemark.llm.words import ALNUM, LOWER, SPACED, blocks


def measures(texts, lexicon):
    g = toxicity.Grammar.of(lexicon)
    return np.concatenate([g.measures(b) for b in blocks(pa.array(texts, pa.string()), ALNUM, LOWER)])


def test_grammar_scores_clauses_not_words():
    texts = ["you idiot", "he said you idiot", "not an idiot", "not. idiot", "an idiot and a moron", "an idiot. a moron", "I will hurt you", "they hurt", "they never hurt", "", None, "IDIOT!"]
    got = measures(texts, {"idiot": 2.0, "moron": 3.0})
    n = np.sqrt(np.array([len(plain.ALNUM.findall((t or "").translate(plain.FOLD))) for t in texts]) + 10)
    got = {t: dict(zip(toxicity.MEASURES, row * k)) for t, row, k in zip(texts, got, n)}
    near = lambda a, b: abs(a - b) < 1e-9
    assert near(got["you idiot"]["plain"], 2) and near(got["you idiot"]["aimed"], 2)
    assert near(got["he said you idiot"]["reported"], 2) and near(got["he said you idiot"]["plain"], 0)
    assert near(got["not an idiot"]["negated"], 2) and near(got["not. idiot"]["plain"], 2)
    assert near(got["an idiot and a moron"]["worst_clause"], 5) and near(got["an idiot. a moron"]["worst_clause"], 3)
    assert near(got["they hurt"]["threat"], 1) and near(got["they never hurt"]["threat"], 0) and near(got["I will hurt you"]["threat"], 0)
    assert not any(got[""].values()) and not any(got[None].values()) and near(got["IDIOT!"]["plain"], 2)


def test_targets_stand_before_or_after():
    texts = ["I will hurt you", "kill them", "je vais te frapper, toi", "they hurt", "idiot, you", "an idiot", "he said I will kill you", "I will not hurt you", "hurt. you"]
    texts += ["kills them", "je te tue", "ich schlage dich", "te mataré", "they said idiot", "you are not an idiot", "you kill", "you"]
    got = measures(texts, {"idiot": 2.0, "kill": 3.0, "you": 4.0})
    n = np.sqrt(np.array([len(plain.ALNUM.findall(t.translate(plain.FOLD))) for t in texts]) + 10)
    got = {t: {m: round(v, 9) for m, v in zip(toxicity.MEASURES, row * k)} for t, row, k in zip(texts, got, n)}
    threats = {t: (x["threat"], x["threat_ahead"]) for t, x in got.items()}
    assert threats["I will hurt you"] == (0, 1) and threats["kill them"] == (0, 1) and threats["they hurt"] == (1, 0)
    assert all(sum(threats[t]) == 1 for t in ("je vais te frapper, toi", "kills them", "je te tue", "ich schlage dich", "te mataré"))
    assert threats["hurt. you"] == threats["I will not hurt you"] == threats["he said I will kill you"] == (0, 0)
    assert got["he said I will kill you"]["reported"] == 8 and got["he said I will kill you"]["worst_clause"] == 0
    assert got["idiot, you"]["aimed"] == 2 and got["an idiot"]["aimed"] == 0
    assert got["they said idiot"]["aimed"] == got["they said idiot"]["worst_clause"] == 0
    assert got["you are not an idiot"]["aimed"] == 0 and got["you are not an idiot"]["worst_clause"] == 4
    # words of the lexicon keep their fixed arcs, and a word is not its own target
    assert threats["you kill"] == (1, 0) and got["you kill"]["plain"] == 7 and got["you kill"]["aimed"] == 3
    assert got["you"]["aimed"] == 0


def read_apart(words, marks_between):
    """Marks of each symbol, with every transducer run by itself over all words and marks of a text."""
    arcs = {w: k for k, ws in toxicity._FIXED for w in ws}
    signs = {".": toxicity.CLAUSE, "!": toxicity.CLAUSE, ":": toxicity.FRAME, '"': toxicity.QUOTE, "\n": toxicity.BREAK}
    symbols = []
    for word, after in zip(words, marks_between):
        symbols.append((word, arcs.get(word, toxicity.OTHER)))
        symbols += [(None, signs[m]) for m in after]
    states = [t.start for t in toxicity.TRANSDUCERS]
    out = []
    for word, symbol in symbols:
        marks = 0
        for i, t in enumerate(toxicity.TRANSDUCERS):
            states[i], m = t.arcs.get((states[i], symbol), (states[i], 0))
            marks |= m
        out.append((word, symbol, marks))
    return out


def enumerated(words, marks_between, lexicon):
    """The measures by clauses as lists: every threat looks for what it acts on."""
    T = toxicity
    row, read = dict.fromkeys(T.MEASURES, 0.0), read_apart(words, marks_between)
    phrases, clause, i = [p.split() for p in T.PHRASES if p.split()], [], 0
    read.append((None, T.BREAK, 0))
    own = [j for j, (w, _, _) in enumerate(read) if w is not None]
    taken = set()
    for j in own:  # phrases, none over another: the shortest from each place, if all its words follow each other
        for p in sorted(phrases, key=len):
            if [read[k][0] for k in range(j, j + len(p)) if k < len(read)] == p and not taken & set(range(j, j + len(p))):
                taken |= set(range(j, j + len(p)))
                if not read[j][2] & T.NEGATED:
                    row["reported" if read[j][2] & T.REPORTED_BY else "threat_ahead"] += 1
                break
    for j, (word, symbol, marks) in enumerate(read):
        if word is not None:
            clause.append(j)
            continue
        targets = [k for k in clause if read[k][1] in (T.TARGET_WORD, T.OBJECT_WORD)]
        worst = 0.0
        for k in clause:
            w, s, m = read[k]
            if w in lexicon:
                what = "negated" if m & T.NEGATED else "reported" if m & T.REPORTED_BY else "plain"
                row[what] += lexicon[w]
                if what == "plain":
                    worst += lexicon[w]
                    row["aimed"] += lexicon[w] * any(x != k for x in targets)
            if s == T.THREAT and not m & T.NEGATED:
                before = [x for x in targets if x < k]
                as_object = any(read[x][1] == T.OBJECT_WORD for x in before)
                verb, left, fate = k, T.OBJECT_REACH, None
                for x in clause:
                    if x > k and fate is None:
                        if read[x][1] == T.THREAT:
                            left = T.OBJECT_REACH
                        elif read[x][1] in (T.TARGET_WORD, T.OBJECT_WORD):
                            fate = "target"
                        elif read[x][1] == T.THING or left == 1:
                            fate = "thing"
                        else:
                            left -= 1
                fate = fate or ("end" if left == T.OBJECT_REACH else "thing")
                if fate == "target" or as_object or fate == "end" and before:
                    row["reported" if m & T.REPORTED_BY else "threat" if before else "threat_ahead"] += 1
        row["worst_clause"] = max(row["worst_clause"], worst)
        clause = []
    return row


def test_composed_grammar_agrees_with_its_parts_on_random_texts():
    r = random.Random(11)
    lists = [toxicity.THREATS, toxicity.TARGETS, toxicity.OBJECTS, toxicity.NEGATIONS, toxicity.ONLY, toxicity.REPORTS, toxicity.THINGS, ["idiot", "moron", "you", "kill"], [w for p in toxicity.PHRASES for w in p.split()]]
    lexicon = {"idiot": 2.0, "moron": 3.0, "you": 4.0, "kill": 5.0, "die": 1.5}
    texts, want = [], []
    for n in range(1500):
        words, marks = [], []
        for _ in range(r.randint(1, 25)):
            if r.random() < 0.1:
                more = r.choice([p for p in toxicity.PHRASES if p.strip()]).split()
            else:
                more = [r.choice(r.choice(lists))] if r.random() < 0.6 else [r.choice(["x", "house", "red", "went"])]
            words += more
            marks += [""] * (len(more) - 1) + [r.choice(["", "", "", "", ".", ":", '"', "\n", ':"', '."', "!.", "\n\n"])]
        texts.append(" ".join(w + m for w, m in zip(words, marks)))
        want.append(enumerated(words, marks, lexicon))
    got = measures(texts, lexicon)
    n = np.sqrt(np.array([len(plain.ALNUM.findall(t)) for t in texts]) + 10)
    for t, row, k, w in zip(texts, got, n, want):
        assert {m: round(float(v * k), 6) for m, v in zip(toxicity.MEASURES, row)} == {m: round(v, 6) for m, v in w.items()}, t


def test_sentences_fall_on_the_right_side(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    mild = ["They beat the record again", "The storm will destroy the village and they fled", "You can kill the process with ctrl-c", "He warned: I will kill you",
            'She said: "I will hurt you. I will kill you."', "They never hurt you", "They beat Liverpool again", "je vais détruire la maison", "er sagte, ich schlage dich"]
    bad = ["go die in a fire", "I will not only hurt you", "I will hurt and destroy you", "kill yourself", "We will beat you up", "je vais te frapper fort", "They will kill you", "ich bringe dich um, verrecke", "No. I will kill you"]
    texts = spark.createDataFrame(list(enumerate(mild + bad)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(texts, model).collect()}
    assert [t for i, t in enumerate(mild + bad) if (got[i] >= 0.5) != (t in bad)] == []


def test_threats_count_without_labelled_threats(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    texts = spark.createDataFrame([(0, "I will hurt you"), (1, "they will kill"), (2, "we will meet you"), (3, "she said I will hurt you")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(texts, model).collect()}
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] < 0.1 and got[2] < got[3] < 0.5


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("crc32(cast(doc_id AS string)) % 5 <> 0")
    model = toxicity.learn(docs, train)
    held = toxicity.score(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 5 = 0").select("score", "toxic").collect()
    truth, score = np.array([x.toxic for x in held]), np.array([x.score for x in held])
    assert ((score >= 0.5) == truth).mean() > 0.97
    assert (score[truth == 0] >= 0.5).mean() < 0.01 and (score[truth == 1] >= 0.5).mean() > 0.85
    again = toxicity.learn(docs.repartition(5), train.repartition(3))
    assert np.allclose(model.weights, again.weights)


def test_toxicity_edges(spark):
    schema = "doc_id long, text string, found string, half int"
    rows = [(1, "bad bad word", "x", 1), (1, "bad bad word", "x", 1), (None, None, None, None), (2, "", "", 0), (3, "fine " * 30_000, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    for labels in ([], [(1, 1)], [(1, 0), (3, 0)], [(1, 1), (3, 0), (2, None), (None, 1), (7, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(docs, model).collect()
        assert len(got) == 5 and all(0 <= x.score <= 1 for x in got)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_expectation_maximisation_finds_the_rates():
    """Votes drawn from known rates: the posterior must agree with the hidden truth."""
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.8
    rates = [(0.02, 0.6), (0.05, 0.5), (0.01, 0.4), (0.1, 0.7), (0.03, 0.5)]  # of a bad vote on good, on bad texts
    cast = np.stack([np.where(r.random(truth.size) < 0.1, weaklabels.NONE, np.where(r.random(truth.size) < np.where(truth, g, b), weaklabels.BAD, weaklabels.GOOD)) for g, b in rates], axis=1)
    patterns, which, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    post = weaklabels.estimate(patterns, counts.astype(float))[which.ravel()]
    assert ((post >= 0.5) == truth).mean() > 0.9
    assert abs(post.mean() - 0.8) < 0.05


def test_votes_follow_plain_counts():
    r = random.Random(2)
    texts = [" ".join(r.choice(["aa", "bb", "Cc", "d#", "E.", "漢字漢"]) for _ in range(n)) for n in (0, 1, 2, 3, 5, 20, 100)]
    texts += [None, "a b c\na b c\nx", "\n\n", "w " * 50, "same\nsame\nsame\nother"]
    for b in blocks(pa.array(texts, pa.string()), SPACED):
        repeated = weaklabels._repeated(b, b.hashes())
        assert np.bincount(b.text, weights=repeated, minlength=len(texts)).tolist() == [plain.repeat_words(t) for t in texts]
        lines, copies = weaklabels._duplicate_lines(b)
        own = [[tuple(plain.words(x)) for x in (t or "").split("\n") if plain.words(x)] for t in texts]
        assert lines.tolist() == [len(x) for x in own] and copies.tolist() == [len(x) - len(set(x)) for x in own]


def test_quality_without_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = weaklabels.judge(docs, weaklabels.learn(docs)).join(labels, "doc_id").select("score", "posterior", "quality").collect()
    truth, score = np.array([x.quality for x in got]), np.array([x.score for x in got])
    assert ((score >= 0.5) == truth).mean() > 0.98
    assert (score[truth == 1] >= 0.5).mean() > 0.99


def test_classifier_edges(spark):
    schema = "doc_id long, text string, votes string, id int"
    rows = [(1, "some good words here", "x", 1), (1, "some good words here", "x", 1), (None, None, None, None), (2, "", "", 0), (3, "fine " * 30_000, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    got = weaklabels.judge(docs, weaklabels.learn(docs)).collect()
    assert len(got) == 5 and all(0 <= x.score <= 1 and 0 <= x.posterior <= 1 and len(x.votes) == 11 for x in got)
    assert [x.score for x in got if x.doc_id in (None, 2)] == [0, 0]
    empty = docs.limit(0)
    assert weaklabels.judge(empty, weaklabels.learn(empty)).collect() == []


def test_repeated_rows_reach_the_driver_once(spark, monkeypatch):
    given, fits = [], (toxicity._fit, weaklabels.fit)
    monkeypatch.setattr(toxicity, "_fit", lambda x, y, n: given.append(n) or fits[0](x, y, n))
    monkeypatch.setattr(weaklabels, "fit", lambda *a: given.append(a[-1]) or fits[1](*a))
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 100)
    monkeypatch.setattr(weaklabels, "TRAIN_ROWS", 400)
    rows = spark.range(800).selectExpr("id % 8 AS doc_id", "concat('some words ', id % 8) AS text")
    labels = spark.range(8).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    toxicity.learn(rows, labels)
    weaklabels.learn(rows)
    assert given[0].tolist() == [100] * 8
    assert 0 < len(given[1]) <= 8 and set(given[1].tolist()) == {100}
    # different texts of one id
    toxicity.learn(spark.range(3000).selectExpr("id % 2 AS doc_id", "concat('some words ', id) AS text"), labels)
    assert 50 < len(given[2]) < 150


def test_long_texts_are_fewer_examples(spark, monkeypatch):
    given, fit = [], weaklabels.fit
    monkeypatch.setattr(weaklabels, "fit", lambda *a: given.append((len(a[3]), len(a[0]))) or fit(*a))
    rows = spark.range(300).selectExpr("id AS doc_id", "concat('w', id, ' ', array_join(transform(sequence(1, 400), x -> concat('v', x * id)), ' ')) AS text")
    monkeypatch.setattr(weaklabels, "TRAIN_FEATURES", 100_000)
    model = weaklabels.learn(rows)
    assert 20 < given[0][0] < 120 and given[0][1] <= 150_000
    assert weaklabels.judge(rows, model).count() == 300
