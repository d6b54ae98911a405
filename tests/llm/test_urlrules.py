import random

from tests.llm import plain
from tidemark.llm import urlrules

RULES = "host string, path string, verdict string"


def judged(df):
    return sorted((x.page_id or -1, x.host, x.path, x["rule"], x.verdict) for x in df.collect())


def want(urls, rules):
    return sorted((i or -1, *plain.url_verdict(u, rules)) for i, u in urls)


def test_against_plain(spark):
    r = random.Random(1)
    labels = ["a", "b", "com", "net", "x-y", "com2"]
    hosts = [".".join(r.choice(labels) for _ in range(r.randrange(1, 5))) for _ in range(40)]
    paths = ["", "/", "/en", "/en/", "/en/x", "/e", "/é/"]
    verdict = {}
    for _ in range(60):
        h, p = r.choice(hosts), r.choice(paths)
        verdict[h, p] = r.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in verdict.items()]
    urls = [(i, f"http://{r.choice(['', 'WWW.', 'm.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/en/', '#/en/', 'page'])}") for i in range(1500)]
    urls += [(2000 + i, "https://hot.a.com/en/x") for i in range(800)]
    urls += [(3000, None), (3001, ""), (3002, "no scheme"), (3003, "a://b://c/d"), (3004, "http://"), (None, "http://a.com/"), (3005, "http://a.com/"), (3005, "http://a.com/"), (3006, "http://A.COM/\n/x")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    rules_df = spark.createDataFrame(rules, RULES)
    for parts in (1, 7, 64):
        assert judged(urlrules.judge(df, rules_df, parts=parts)) == want(urls, rules)


def test_empty_nulls_and_clashing_names(spark):
    urls = spark.createDataFrame([(1, "http://a.com/x", "k", 3)], "page_id long, url string, key string, part int")
    none = spark.createDataFrame([], RULES)
    assert judged(urlrules.judge(urls, none)) == [(1, "a.com", "/x", None, "allow")]
    assert judged(urlrules.judge(urls, none, default="block")) == [(1, "a.com", "/x", None, "block")]
    odd = spark.createDataFrame([("COM", "/", "block"), (None, "/", "allow"), ("a.com", None, "allow"), ("com", "/", "allow")], RULES)
    assert judged(urlrules.judge(urls, odd)) == [(1, "a.com", "/x", "com/", "allow")]
    assert urlrules.judge(urls.limit(0), odd).collect() == []


def test_repeated_rows_reach_the_driver_once(spark, monkeypatch):
    r, given, cut = random.Random(5), [], urlrules._splitters
    monkeypatch.setattr(urlrules, "_splitters", lambda keys, times, parts: given.append(times) or cut(keys, times, parts))
    urls = [(i, f"http://h{i}.com/") for i in range(20)] + [(99, "http://hot.com/")] * 300
    got = urlrules.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([("com", "/", "block")], RULES))
    assert got.count() == 320 and sorted(given[0]) == [1] * 20 + [300]
    keys, times = [f"k{r.randrange(30)}" for _ in range(50)], [r.choice([1, 2, 90]) for _ in range(50)]
    sample = sorted(k.encode() for k, n in zip(keys, times) for _ in range(n))
    assert all(cut(keys, times, p) == [sample[len(sample) * k // p] for k in range(1, p)] for p in (1, 2, 7, 64)) and cut([], [], 4) == []
