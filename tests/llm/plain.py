"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return SPACED.findall(text or "")


def fingerprint(text, shingle=3):
    w = words((text or "").translate(FOLD))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, radius=3):
    """For each fingerprint a number of its component."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def cut(texts, window):
    """(n_words, n_removed, kept text) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(texts, items, window=10):
    """(n_words, n_hit, sorted item ids) of each text; ``items`` are (id, text)."""
    grams = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            grams[tuple(w[i : i + m])].add(item)
    out = []
    for text in texts:
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, ids = set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    ids |= grams[tuple(w[i : i + m])]
        out.append((len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


def repeat_words(text, size=3):
    w = words(text)
    seen = Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return len({i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)})


def url_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(FOLD)
        path = re.match(r"[^?#]*", re.sub(r"^[^/?#]*", "", rest))[0]
    fits = [(len(h + p), len(h), p, h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = sorted(fits, key=lambda r: (-r[0], -r[1], r[2]))[0]
    return host, path, best[3], best[4]


def quality(docs, rules, least_group):
    """Whether the adaptive rules keep each of ``docs`` (text, lang, source)."""
    counts = []
    for text, _, _ in docs:
        t, w = text or "", words(text)
        lines = [x for x in t.split("\n") if words(x)]
        counts.append({
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(t), "n_lines": len(lines),
        })
    passed = [c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] for c in counts]

    def measure(rule, c):
        return 1000 * c[rule.top] // c[rule.bottom] if c[rule.bottom] else 0

    def quartiles(values):
        values = sorted(v >> max(0, v.bit_length() - 8) << max(0, v.bit_length() - 8) for v in values)
        return [values[-(-k * len(values) // 4) - 1] for k in (1, 2, 3)]

    keep = list(passed)
    for rule in rules:
        levels = [defaultdict(list), defaultdict(list), defaultdict(list)]
        for (_, lang, source), c, ok in zip(docs, counts, passed):
            if ok:
                for level, key in zip(levels, ((lang, source), lang, None)):
                    level[key].append(measure(rule, c))
        for i, ((_, lang, source), c) in enumerate(zip(docs, counts)):
            if passed[i]:
                groups = [level[key] for level, key in zip(levels, ((lang, source), lang, None))]
                q1, q2, q3 = quartiles(next((g for g in groups[:2] if len(g) >= least_group), groups[2]))
                spread = max((q3 if rule.both else q2) - q1, rule.least)
                low = q2 - rule.reach * spread if rule.both else -1
                keep[i] = keep[i] and low <= measure(rule, c) <= q2 + rule.reach * spread
    return keep


def mixture(docs, weights=(5, 2, 1), most=3):
    """How often the mix takes each of ``docs`` (id, text, source); ids are unique."""
    sizes = [len(words(t)) for _, t, _ in docs]
    hashes = [int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16) for i, _, _ in docs]
    total = Counter()
    for (_, _, s), n in zip(docs, sizes):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    share, open_, target = sum(total.values()), set(total), {}
    while open_:
        unit = share / sum(weight[s] for s in open_)
        full = [s for s in open_ if most * total[s] <= weight[s] * unit]
        if not full:
            target.update({s: weight[s] * unit for s in open_})
            break
        for s in full:
            target[s] = float(most * total[s])
            share -= most * total[s]
            open_.remove(s)
    copies = [0] * len(docs)
    for s in order:
        whole = int(target[s] // total[s]) if total[s] else 0
        budget, before, closed = target[s] - whole * total[s], 0, False
        for h, i in sorted((hashes[i], i) for i, d in enumerate(docs) if d[2] == s):
            closed = closed or not (before <= budget and (before + sizes[i] <= budget or sizes[i] < 2 * (budget - before)))
            copies[i] = whole + (not closed)
            before += sizes[i]
    return copies


def labeller_votes(text):
    """The votes of the eleven quality labellers: 1 good, 0 bad, 2 none."""
    t, w = text or "", words(text)
    n = len(w)
    if not n:
        return (2, 2, 2, 0, 2, 2, 2, 2, 2, 2, 2)
    lines = [tuple(words(x)) for x in t.split("\n") if words(x)]
    copies = len(lines) - len(set(lines))
    raw = t.encode()
    upper = sum(0x41 <= b <= 0x5A for b in raw)
    letters = max(1, sum(chr(b).isalpha() if b < 128 else b >= 0xC0 for b in raw))
    solid = max(1, sum(b != 0x20 and not 9 <= b <= 13 for b in raw))
    is_mark = lambda b: 0x21 <= b < 0x7F and not chr(b).isalnum()
    ends = [x.encode() for x in w]
    marks = sum(is_mark(x[-1]) and is_mark(x[max(len(x) - 2, 0)]) for x in ends) / n
    symbols, repeats, copied = sum(c in "#*$%&|<>" for c in t) / n, repeat_words(t) / n, copies / max(1, len(lines))
    length, stops = sum(map(len, w)) / n, sum(x[-1] in ".!?" for x in w) / n
    echoes, top = sum(a == b for a, b in zip(w, w[1:])) / n, max(Counter(w).values()) / n
    capitals, share = upper / letters, letters / solid
    rules = [
        (symbols > 0.1, symbols <= 0.01), (repeats > 0.4, repeats < 0.15), (copied > 0.3, copies == 0 and len(lines) >= 2), (n < 4, n >= 60),
        (length < 2.5 or length > 12, 3 < length < 9), (capitals > 0.4, capitals < 0.15),
        (n >= 30 and (stops < 0.005 or stops > 0.5), n >= 30 and 0.02 < stops < 0.4), (share < 0.8, share > 0.9), (marks > 0.2, marks < 0.05),
        (n >= 10 and echoes > 0.1, n >= 10 and echoes < 0.03), (n >= 30 and top > 0.2, n >= 30 and top < 0.13),
    ]
    return tuple(0 if bad else 1 if good else 2 for bad, good in rules)


def posteriors(votes, rounds=200):
    """The chance of being good for each pattern of votes, by expectation-maximisation over texts."""
    post = [(sum(v == 1 for v in x) + 0.5) / (sum(v == 1 for v in x) + 3 * sum(v == 0 for v in x) + 1.0) for x in votes]
    for _ in range(rounds):
        prior = [(sum(1 - p for p in post) + 1) / (len(post) + 2), (sum(post) + 1) / (len(post) + 2)]
        rate = {}
        for k in range(len(votes[0])):
            for c in (0, 1):
                seen = [sum((p if c else 1 - p) for p, x in zip(post, votes) if x[k] == v) + 1 for v in (0, 1)]
                rate[k, c] = [s / sum(seen) for s in seen]
        after = []
        for x in votes:
            log = [math.log(prior[c]) + sum(math.log(rate[k, c][v]) for k, v in enumerate(x) if v < 2) for c in (0, 1)]
            after.append(1 / (1 + math.exp(max(-50, min(50, log[0] - log[1])))))
        done = max(abs(a - b) for a, b in zip(after, post)) < 1e-9
        post = after
        if done:
            break
    return post
