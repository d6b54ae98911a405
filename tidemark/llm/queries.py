"""The thirteen operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import alignment, decontaminate, mixture, pages, partenum, quality, sharding, simhash, substrings, toxicity, trie, urlrules, weaklabels
from tidemark.llm.common import saved, table
from tidemark.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

WORD = r"'[^\x20\x09-\x0D]+'"
SHARDS = 40


@query(
    "op1_substrings",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    win AS (SELECT doc_id, i, count(*) OVER f AS size, md5(string_agg(word, ' ') OVER f) AS words FROM words
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY words) AS c FROM win WHERE size = 35) WHERE c > 1),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM rep),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.cut_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_sharding")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = sharding.shard_rows(table(spark, sf, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op3_mixture",
    f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight, 3 * source_size AS cap FROM s),
    o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS share, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weights FROM w
      WINDOW p AS (ORDER BY source_size / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, cap::DOUBLE * weights::DOUBLE <= weight::DOUBLE * share::DOUBLE AS is_full FROM o),
    u AS (SELECT share::DOUBLE / weights::DOUBLE AS unit FROM f WHERE NOT is_full ORDER BY source_size / weight::DOUBLE, source IS NULL, source LIMIT 1),
    t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE weight::DOUBLE * (SELECT unit FROM u) END AS target FROM f),
    b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
    g AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h),
    r AS (SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h) - size AS before FROM g)
    SELECT doc_id, d.size, source_size, target,
      (d.size * (whole + CASE WHEN before + r.size <= target - whole * source_size OR before <= target - whole * source_size
        AND r.size < 2 * (target - whole * source_size - before) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = mixture.mixed(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_FOLDED = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op4_decontaminate",
    f"""WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
    items AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS words FROM
      (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0)),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    long AS (SELECT doc_id, i, 10 AS m, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS size FROM words
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
    short AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS words, m AS size FROM
      (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM iw WHERE m < 10) WHERE len(w) >= m)),
    dw AS (SELECT * FROM long WHERE size = 10 UNION ALL SELECT * FROM short),
    hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.words = iw.words),
    cover AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, m)) AS i FROM hit) GROUP BY doc_id),
    per AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0)::BIGINT AS n_hit, coalesce(per.n, 0)::BIGINT AS n_items,
      sha256(coalesce(per.ids, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN per USING (doc_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op5_classifier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = weaklabels.judge(docs, weaklabels.learn(docs))
    good = F.col("score") >= 0.5
    return found.select("doc_id", F.array_join(F.col("votes").cast("array<string>"), "").alias("votes"), "posterior", "score", good.cast("int").alias("predicted"), good.alias("kept"))


@query(
    "op6_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p),
    r AS (SELECT *, payload_bytes >= 1000 AND page_id <> top AS again FROM k)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN again THEN top END AS refers_to FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return pages.archived(table(spark, sf, "pages"))


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query(
    "op7_urlrules",
    rf"""WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES_SQL}),
    u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
    m AS (SELECT page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
    SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf, "pages"), rules)


_MEASURES = {r.name: f"coalesce(1000 * {r.top} // nullif({r.bottom}, 0), 0)" for r in quality.RULES}
_BUCKET = "CASE WHEN v < 256 THEN v ELSE (v >> (length(bin(v)) - 8)) << (length(bin(v)) - 8) END"


def _quality_sql() -> str:
    each = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS rule, {m} AS v FROM b WHERE NOT base_failed" for n, m in _MEASURES.items())
    levels = {"a": "lang, source, rule", "b2": "lang, rule", "c": "rule"}
    quartiles = ", ".join(
        f"""{k} AS (SELECT {by}, max(total) AS total, {', '.join(f'min(CASE WHEN 4 * upto >= {q} * total THEN bucket END) AS q{q}' for q in (1, 2, 3))} FROM
        (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM
          (SELECT {by}, bucket, count(*) AS n FROM s GROUP BY {by}, bucket)) GROUP BY {by})"""
        for k, by in levels.items()
    )
    pick = ", ".join(f"CASE WHEN a.total >= {quality.LEAST_GROUP} THEN a.q{q} WHEN b2.total >= {quality.LEAST_GROUP} THEN b2.q{q} ELSE c.q{q} END AS q{q}" for q in (1, 2, 3))
    low, high = [], []
    for r in quality.RULES:
        spread = f"greatest({'q3' if r.both else 'q2'} - q1, {r.least})"
        high.append(f"WHEN '{r.name}' THEN q2 + {r.reach} * {spread}")
        low.append(f"WHEN '{r.name}' THEN {f'q2 - {r.reach} * {spread}' if r.both else '-1'}")
    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {WORD})) AS l FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    win AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS words, count(*) OVER f AS size FROM words
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS c FROM win WHERE size = 3) WHERE c > 1),
    cover AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM rep) GROUP BY doc_id),
    b0 AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM d LEFT JOIN cover USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b0),
    v AS ({each}), s AS (SELECT lang, source, rule, {_BUCKET} AS bucket FROM v), {quartiles},
    q AS (SELECT a.lang, a.source, a.rule, {pick} FROM a JOIN b2 ON a.lang IS NOT DISTINCT FROM b2.lang AND a.rule = b2.rule JOIN c ON a.rule = c.rule),
    t AS (SELECT lang, source, rule, CASE rule {' '.join(low)} END AS low, CASE rule {' '.join(high)} END AS high FROM q),
    m AS (SELECT doc_id, lang, source, unnest([{', '.join(f"'{n}'" for n in _MEASURES)}]) AS rule, unnest([{', '.join(_MEASURES.values())}]) AS v FROM b),
    bad AS (SELECT DISTINCT doc_id FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source AND m.rule = t.rule
      WHERE v NOT BETWEEN low AND high)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b"""


@query("op8_quality", _quality_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents"))


@query("op9_toxicity")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf, "labels").where(~F.coalesce(held_out, F.lit(False))).select("doc_id", "toxic")
    found = toxicity.score(docs, toxicity.learn(docs, labels))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_simhash")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))


@query("op11_alignment")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment.scored(table(spark, sf, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query(
    "op12_jaccard",
    f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w
      FROM documents),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d),
    win AS (SELECT doc_id, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS size, i, n FROM words
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    sets AS (SELECT DISTINCT doc_id, md5(s) AS s FROM win WHERE size = 3 OR (n < 3 AND i = 1)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM met JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(top, doc_id)) AS component_id
    FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS top FROM reach GROUP BY a) USING (doc_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = partenum.similar(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda r, b:
      list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


@query(
    "op13_trie",
    f"""WITH o AS (SELECT conv_id AS c, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
      length(coalesce(text, ''))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT c, id, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS i FROM o),
    b AS (SELECT c, c - c % 100 AS base, ({_CRC}) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
    s0 AS (SELECT b.c, 0 AS own, i, id, size FROM b JOIN t ON t.c = b.base AND t.i <= b.h
      UNION ALL SELECT b.c, 1, i, id, size FROM b JOIN t ON t.c = b.c AND t.i > b.h),
    s AS (SELECT c, id, size, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d FROM s0),
    p AS (SELECT c, d, size, md5(string_agg(id, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM s
      UNION ALL SELECT c, 0, 0, 'root' FROM b),
    q AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS at_end FROM p),
    n AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
      sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE at_end), '')) AS ends_sha256 FROM q GROUP BY k),
    kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
    under AS (SELECT DISTINCT x.k AS top, y.k FROM p x JOIN p y ON x.c = y.c AND x.d <= y.d),
    sums AS (SELECT top AS k, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM under JOIN m USING (k) GROUP BY top)
    SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
      n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
    FROM m JOIN sums USING (k) LEFT JOIN m u ON m.up = u.k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    turns = saved(trie.turns_of(table(spark, sf, "conversations")), "trie-turns")
    return trie.nodes(trie.with_shared_heads(turns, 100, 5))
