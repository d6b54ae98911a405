"""Counts, watermarks, hashes and key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.values import ntz
from tidemark.operators import apply, locate, parity
from tidemark.operators.shape import with_audit
from tidemark.queries.registry import derived, query, table
from tidemark.queries.shaping import FINGERPRINT
from tidemark.session import work_path
from tidemark.sources.scan import custom_sql

COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "updated_at"]
HASH_SQL = "CAST(coalesce(bit_xor(CAST(('0x' || substr(md5(f), 1, 15)) AS BIGINT)), 0) AS VARCHAR)"


def _source(spark: SparkSession, sf: str) -> DataFrame:
    """The customers as the source has them, in the target's business columns."""
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"), "c_mktsegment",
        (ntz("2000-06-01 00:00:00") + F.make_dt_interval(F.col("c_nationkey"))).alias("updated_at"),
    )


SOURCE_SQL = """SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment,
    CAST(TIMESTAMP '2000-06-01 00:00:00' + INTERVAL '1' DAY * c_nationkey AS TIMESTAMP) AS updated_at FROM customer"""


@query("row_count", "SELECT count(*) AS row_count FROM lineitem WHERE l_quantity > 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return parity.row_count(table(spark, sf, "lineitem"), "l_quantity > 10")


@query("custom_sql_count", "SELECT count(*) AS row_count FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey) q")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = custom_sql(
        spark, "SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey", {"lineitem": table(spark, sf, "lineitem")}
    )
    return parity.row_count(rows)


@query("max_watermark", "SELECT CAST(max(updated_at) AS VARCHAR) AS max_watermark FROM f_target WHERE NOT _is_deleted")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return parity.max_watermark(derived(spark, sf, "f_target"), "updated_at")


@query("delta_max_watermark", "SELECT count(*) AS row_count, max(updated_at) AS new_watermark FROM f_delta")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return parity.delta_watermark(derived(spark, sf, "f_delta"), "updated_at", ntz("2000-12-31 00:00:00"))


@query(
    "parity_count",
    """SELECT s AS source_rows, t AS target_rows, s - t AS delta, s = t AS count_ok FROM
       (SELECT (SELECT count(*) FROM customer) AS s, (SELECT count(*) FROM f_target WHERE NOT _is_deleted) AS t) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return parity.count_parity(table(spark, sf, "customer"), derived(spark, sf, "f_target"))


@query(
    "parity_watermark",
    f"""SELECT s AS source_wm, t AS target_wm, s IS NOT DISTINCT FROM t AS wm_ok FROM
        (SELECT (SELECT strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') FROM ({SOURCE_SQL}) a) AS s,
                (SELECT strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') FROM f_target WHERE NOT _is_deleted) AS t) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return parity.watermark_parity(_source(spark, sf), derived(spark, sf, "f_target"), "updated_at")


@query(
    "parity_deep_hash",
    f"""WITH s AS (SELECT {FINGERPRINT} AS f FROM ({SOURCE_SQL}) a),
             t AS (SELECT {FINGERPRINT} AS f FROM f_target WHERE NOT _is_deleted)
        SELECT source_rows, target_rows, source_hash, target_hash, source_hash = target_hash AS hash_ok
        FROM (SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows,
                     (SELECT {HASH_SQL} FROM s) AS source_hash, (SELECT {HASH_SQL} FROM t) AS target_hash) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return parity.hash_parity(_source(spark, sf), derived(spark, sf, "f_target"), COLUMNS)


@query(
    "parity_after_full_load",
    f"""WITH s AS (SELECT {FINGERPRINT} AS f, updated_at FROM ({SOURCE_SQL}) a)
        SELECT count(*) AS source_rows, count(*) AS target_rows, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS source_wm,
               strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS target_wm, {HASH_SQL} AS source_hash, {HASH_SQL} AS target_hash,
               0 AS delta, TRUE AS count_ok, TRUE AS wm_ok, TRUE AS hash_ok, TRUE AS ok FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    source = _source(spark, sf)
    path = work_path(spark, "full-load")
    empty = derived(spark, sf, "f_target").limit(0)
    apply.replace_all(empty, source, ntz("2001-09-01 00:00:00"), "b1").write.parquet(path)
    return parity.parity(source, spark.read.parquet(path), COLUMNS, "updated_at", deep=True)


@query(
    "rows_per_file",
    "SELECT 'orders' AS file_name, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    def files(name: str) -> DataFrame:
        file = F.regexp_extract(F.col("_metadata.file_path"), r"/(\w+)\.parquet", 1)
        return parity.rows_per_file(table(spark, sf, name), file)

    return files("orders").unionByName(files("customer"))


@query(
    "file_report",
    """SELECT o_orderpriority || ' : ' || count(*) AS line FROM orders GROUP BY o_orderpriority
       UNION ALL SELECT 'TOTAL : ' || count(*) FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "per-file")
    table(spark, sf, "orders").withColumn("kind", F.col("o_orderpriority")).write.partitionBy("kind").parquet(path)
    stored = spark.read.option("recursiveFileLookup", True).parquet(path)
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/kind=([^/]+)/", 1))
    return parity.file_report(parity.rows_per_file(stored, folder))


@query(
    "key_uniqueness",
    """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return parity.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "key_check",
    """SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys, sum(n) = count(*) AS is_unique
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return parity.key_check(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "parity_locate",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 700 = 1 THEN 'missing' WHEN o_orderkey % 700 = 3 THEN 'changed' ELSE 'extra' END AS kind,
          CASE WHEN o_orderkey % 700 = 2 THEN 0 ELSE 1 END::BIGINT AS source_rows, CASE WHEN o_orderkey % 700 = 1 THEN 0 ELSE 1 END::BIGINT AS target_rows
       FROM orders WHERE o_orderkey % 700 BETWEEN 1 AND 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A target that lacks some keys, has some that are gone from the source, and one price off by a cent in others."""
    orders = table(spark, sf, "orders")
    off = F.when(F.col("o_orderkey") % 700 == 3, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))
    target = with_audit(orders.where("o_orderkey % 700 <> 1").withColumn("o_totalprice", off), ntz("2024-01-31 00:00:00"), "b1")
    return locate.locate(orders.where("o_orderkey % 700 <> 2"), target, ["o_orderkey"])


KEY_CANDIDATES = {
    "lineitem": (["l_orderkey"], ["l_partkey"], ["l_orderkey", "l_suppkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey"]),
    "events": (["user_id"], ["event_type"], ["event_type", "user_id"], ["event_id"]),
}
_KEYS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{', '.join(keys)}' AS keys, (SELECT count(*) FROM {name}) AS n, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(keys)} FROM {name}) k) AS d"
    for name, candidates in KEY_CANDIDATES.items() for keys in candidates
)


@query(
    "propose_keys_sketched",
    f"""SELECT table_name, keys, CASE WHEN d < 0.95 * n THEN 'ruled out' WHEN d < n THEN 'not unique' ELSE 'unique' END AS verdict,
          CASE WHEN d >= 0.95 * n THEN d END AS distinct_keys FROM ({_KEYS_SQL}) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Several candidate keys of a table in one scan; what the sketches leave is checked exactly."""
    found = None
    for name, candidates in KEY_CANDIDATES.items():
        rows = table(spark, sf, name)
        told = parity.sketched_keys(rows, candidates)
        exact = [parity.key_check(rows, candidates[r["rank"]]).withColumn("rank", F.lit(r["rank"])) for r in told.where("plausible").collect()]
        checks = reduce(DataFrame.unionByName, exact)
        verdict = F.when(F.col("is_unique").isNull(), "ruled out").when(F.col("is_unique"), "unique").otherwise("not unique")
        both = told.join(checks, "rank", "left").select(F.lit(name).alias("table_name"), "keys", verdict.alias("verdict"), "distinct_keys")
        found = both if found is None else found.unionByName(both)
    return found
