"""Filters, projections, type mapping and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import typemap
from tidemark.functions.fingerprint import row_text
from tidemark.functions.values import freshness, ntz, time_ceiling, zero_date_to_null
from tidemark.operators import shape
from tidemark.queries.registry import derived, query, table
from tidemark.sources import scan

START, END = "2000-03-01 00:00:00", "2000-09-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"
BATCH_TS = "2001-09-01 00:00:00"


@query("filter_static", "SELECT * FROM orders WHERE o_totalprice > 250000 AND o_orderpriority LIKE '1%'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.full_scan(table(spark, sf, "orders"), "o_totalprice > 250000 AND o_orderpriority LIKE '1%'")


@query(
    "filter_and_window",
    f"""SELECT * FROM orders WHERE o_orderstatus = 'O'
        AND o_orderdate > TIMESTAMP '{START}' AND o_orderdate <= TIMESTAMP '{END}'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    spec = scan.Scan("INCREMENTAL", filter="o_orderstatus = 'O'", cursor_column="o_orderdate")
    return scan.scan(table(spark, sf, "orders"), spec, START, END)


@query(
    "time_ceiling",
    f"""SELECT CAST(TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE AS TIMESTAMP) AS ceiling, count(*) AS row_count
        FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' AND ts <= TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ceiling = time_ceiling(AS_OF)
    rows = scan.within(table(spark, sf, "events"), "ts", "2024-01-30 12:00:00", ceiling)
    return rows.agg(ntz(ceiling).alias("ceiling"), F.count(F.lit(1)).alias("row_count"))


@query("id_ceiling", "SELECT max(event_id) AS ceiling FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.id_ceiling(table(spark, sf, "events"), "event_id")


# Orders with a second change column: the first ship date of their lines.
ORDER_CHANGES = """SELECT o_orderkey, o_orderdate, first_ship FROM orders LEFT JOIN
    (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey"""


def _order_changes(spark: SparkSession, sf: str) -> DataFrame:
    ships = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first_ship")
    )
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(ships, "o_orderkey", "left")


@query(
    "cdc_multi_col",
    f"""SELECT * FROM ({ORDER_CHANGES}) c
        WHERE (o_orderdate >= TIMESTAMP '{START}' AND o_orderdate < TIMESTAMP '{END}')
           OR (first_ship >= TIMESTAMP '{START}' AND first_ship < TIMESTAMP '{END}')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.changed_between(_order_changes(spark, sf), ["o_orderdate", "first_ship"], START, END)


@query(
    "cdc_multi_col_open",
    f"""SELECT * FROM ({ORDER_CHANGES}) c
        WHERE o_orderdate > TIMESTAMP '{START}' OR first_ship > TIMESTAMP '{START}'""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan.changed_after(_order_changes(spark, sf), ["o_orderdate", "first_ship"], START)


@query(
    "cdc_id_cast",
    """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events
       WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return scan.id_changed_after(events, "k", 50)


@query(
    "cdc_first_run",
    """SELECT config_id, source_table,
              coalesce(last_loaded_at, TIMESTAMP '1900-01-01 00:00:00') AS start_time, coalesce(last_loaded_key, 0) AS start_key
       FROM f_config""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "f_config").select(
        "config_id",
        "source_table",
        scan.first_run_cursor(F.col("last_loaded_at"), "time").alias("start_time"),
        scan.first_run_cursor(F.col("last_loaded_key"), "id").alias("start_key"),
    )


@query("live_rows", "SELECT * FROM f_target WHERE NOT coalesce(_is_deleted, FALSE)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return shape.live_rows(derived(spark, sf, "f_target"))


@query(
    "wide_decimal_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(l_tax AS DECIMAL(12,2)) AS tax
       FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_tax").cast("decimal(12,2)").alias("tax"),
    )
    return shape.wide_decimals_as_text(rows, {"price": 65, "tax": 12})


@query(
    "ntz_projection",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type FROM events",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return shape.clock_columns(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"))


@query("key_projection", 'SELECT l_orderkey AS "L_ORDERKEY", l_linenumber AS "L_LINENUMBER" FROM lineitem')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return shape.key_projection(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("positional_projection", "SELECT s_suppkey AS id, s_name AS label, s_nationkey AS parent, s_acctbal AS balance FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return shape.positional(table(spark, sf, "supplier"), ["id", "label", "parent", "balance"])


@query(
    "trim_all",
    """SELECT trim(CAST(page_id AS VARCHAR)) AS page_id, trim(url, ' ') AS url, trim(html, ' ') AS html FROM pages""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return shape.trim_all(table(spark, sf, "pages"))


@query(
    "csv_quote_projection",
    """SELECT '"' || replace(coalesce(CAST(conv_id AS VARCHAR), ''), '"', '""') || '"' AS conv_id,
              '"' || replace(coalesce(CAST(turn AS VARCHAR), ''), '"', '""') || '"' AS turn,
              '"' || replace(coalesce(role, ''), '"', '""') || '"' AS role,
              '"' || replace(coalesce(text, ''), '"', '""') || '"' AS text
       FROM (SELECT conv_id, turn, nullif(role, 'user') AS role, text FROM conversations) c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return shape.quote_all(table(spark, sf, "conversations").withColumn("role", F.nullif("role", F.lit("user"))))


@query(
    "custom_sql_generic_cols",
    """SELECT CAST(c_nationkey AS VARCHAR) AS "COLUMN_1", CAST(count(*) AS VARCHAR) AS "COLUMN_2",
              CAST(max(c_name) AS VARCHAR) AS "COLUMN_3" FROM customer GROUP BY c_nationkey""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.custom_sql(
        spark,
        "SELECT c_nationkey, count(*) AS n, max(c_name) FROM {customer} GROUP BY c_nationkey",
        {"customer": table(spark, sf, "customer")},
    )
    return shape.generic_columns(rows)


AUDIT = f"""TIMESTAMP '{BATCH_TS}' AS _load_ts, 'supplier.parquet' AS _src_file, 'b7' AS _batch_id,
    FALSE AS _is_deleted, CAST(NULL AS TIMESTAMP) AS _deleted_at"""


@query("audit_columns", f"SELECT *, {AUDIT} FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return shape.with_audit(table(spark, sf, "supplier"), ntz(BATCH_TS), "b7", F.lit("supplier.parquet"))


@query(
    "history_columns",
    f"""SELECT *, {AUDIT}, TIMESTAMP '{BATCH_TS}' AS _valid_from, CAST(NULL AS TIMESTAMP) AS _valid_to,
               TRUE AS _is_current FROM supplier""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = shape.with_audit(table(spark, sf, "supplier"), ntz(BATCH_TS), "b7", F.lit("supplier.parquet"))
    return shape.with_history(rows, ntz(BATCH_TS))


@query("business_columns", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, updated_at FROM f_history")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived(spark, sf, "f_history")
    return rows.select(*shape.business_columns(rows))


MYSQL_CASE = """CASE WHEN lower(data_type) = 'tinyint' AND column_type = 'tinyint(1)' THEN 'BOOLEAN'
    WHEN lower(data_type) IN ('tinyint', 'smallint', 'mediumint', 'int', 'bigint', 'year', 'bit') THEN 'NUMBER(38,0)'
    WHEN data_type IN ('decimal', 'numeric') AND coalesce(numeric_precision, 38) > 38 THEN 'VARCHAR'
    WHEN data_type IN ('decimal', 'numeric') THEN
         'NUMBER(' || coalesce(numeric_precision, 38) || ',' || coalesce(numeric_scale, 0) || ')'
    WHEN data_type IN ('float', 'double') THEN 'FLOAT' WHEN data_type = 'datetime' THEN 'TIMESTAMP_NTZ'
    WHEN data_type = 'timestamp' THEN 'TIMESTAMP_TZ' WHEN data_type = 'date' THEN 'DATE' WHEN data_type = 'time' THEN 'TIME'
    WHEN data_type = 'json' THEN 'VARIANT' WHEN data_type IN ('enum', 'set') THEN 'VARCHAR(512)'
    WHEN data_type IN ('blob', 'varbinary') AND blob_mode = 'binary' THEN 'BINARY'
    WHEN data_type IN ('blob', 'varbinary') AND blob_mode = 'skip' THEN 'VARCHAR'
    WHEN data_type IN ('char', 'varchar') AND character_maximum_length > 0 THEN 'VARCHAR(' || character_maximum_length || ')'
    ELSE 'VARCHAR(16777216)' END"""


def _mapped(columns: DataFrame) -> DataFrame:
    return columns.withColumn(
        "target_type",
        typemap.mysql_type(
            F.col("data_type"), F.col("column_type"), F.col("numeric_precision"), F.col("numeric_scale"),
            F.col("character_maximum_length"), F.col("blob_mode"),
        ),
    )


@query("map_types_mysql", f"SELECT table_name, column_id, column_name, {MYSQL_CASE} AS target_type FROM f_columns")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mapped(derived(spark, sf, "f_columns"))
    return rows.select("table_name", "column_id", "column_name", "target_type")


@query(
    "target_schema",
    f"""WITH m AS (SELECT table_name, column_id + 1 AS ordinal, upper(column_name) AS column_name,
                          {MYSQL_CASE} AS target_type FROM f_columns)
        SELECT table_name, ordinal, column_name,
               CASE target_type WHEN 'NUMBER(38,0)' THEN 'bigint' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'FLOAT' THEN 'double'
                    WHEN 'TIMESTAMP_NTZ' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_TZ' THEN 'timestamp' WHEN 'DATE' THEN 'date'
                    WHEN 'BINARY' THEN 'binary'
                    ELSE CASE WHEN target_type LIKE 'NUMBER(%' THEN replace(target_type, 'NUMBER', 'decimal') ELSE 'string' END
               END AS spark_type FROM m
        UNION ALL
        SELECT table_name, n + o, c, t FROM
          (SELECT table_name, max(ordinal) AS n FROM m GROUP BY table_name) x,
          (VALUES (1, '_LOAD_TS', 'timestamp_ntz'), (2, '_SRC_FILE', 'string'), (3, '_BATCH_ID', 'string'),
                  (4, '_IS_DELETED', 'boolean'), (5, '_DELETED_AT', 'timestamp_ntz'), (6, '_VALID_FROM', 'timestamp_ntz'),
                  (7, '_VALID_TO', 'timestamp_ntz'), (8, '_IS_CURRENT', 'boolean')) a(o, c, t)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mapped(derived(spark, sf, "f_columns")).withColumn("ordinal", F.col("column_id") + 1)
    return shape.target_columns(rows, history=True)


TERADATA_CASE = """CASE
    WHEN t IN ('BYTEINT', 'INTEGER', 'DECIMAL') THEN 'NUMBER(38,0)' WHEN t = 'DECIMAL(18,2)' THEN 'NUMBER(18,2)'
    WHEN t = 'NUMERIC(40, 3)' THEN 'VARCHAR' WHEN t = 'NUMBER(*,3)' THEN 'NUMBER(38,18)' WHEN t = 'NUMBER(12)' THEN 'NUMBER(12,0)'
    WHEN t IN ('FLOAT', 'DOUBLE PRECISION') THEN 'FLOAT' WHEN t = 'INTDATE' THEN 'DATE' WHEN t LIKE 'TIME(%' OR t = 'TIME' THEN 'TIME'
    WHEN t LIKE 'TIMESTAMP%ZONE' THEN 'TIMESTAMP_TZ' WHEN t LIKE 'TIMESTAMP%' THEN 'TIMESTAMP_NTZ'
    WHEN t LIKE 'INTERVAL%' OR t LIKE 'PERIOD%' THEN 'VARCHAR(128)' WHEN t LIKE 'CHAR(%' THEN 'VARCHAR' || substr(t, 5)
    WHEN t = 'CHARACTER' THEN 'VARCHAR(255)'
    WHEN t LIKE 'VARCHAR(%' THEN 'VARCHAR(' || least(CAST(regexp_extract(t, '([0-9]+)', 1) AS BIGINT), 16777216) || ')'
    WHEN t LIKE 'BLOB%' OR t LIKE 'BYTE%' OR t LIKE 'VARBYTE%' THEN 'BINARY' WHEN t LIKE 'JSON%' THEN 'VARIANT'
    ELSE 'VARCHAR(16777216)' END"""


@query(
    "map_types_teradata",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {TERADATA_CASE} AS target_type
        FROM (SELECT *, upper(trim(coalesce(type_text, ''))) AS t FROM f_type_texts) x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "f_type_texts").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        typemap.teradata_type(F.col("type_text")).alias("target_type"),
    )


CODE_COLUMNS = ["table_name", "column_id", "column_name"]
NUMBER_SQL = """'NUMBER(' || CASE WHEN total_digits = -128 THEN '*' ELSE CAST(total_digits AS VARCHAR) END
    || CASE WHEN fraction_digits IN (0, -128) THEN '' ELSE ',' || fraction_digits END || ')'"""
FRACTION_SQL = """WHEN code = 'AT' THEN 'TIME(' || fraction_digits || ')' WHEN code = 'TS' THEN 'TIMESTAMP(' || fraction_digits || ')'
    WHEN code = 'TZ' THEN 'TIME(' || fraction_digits || ') WITH TIME ZONE'
    WHEN code = 'SZ' THEN 'TIMESTAMP(' || fraction_digits || ') WITH TIME ZONE' WHEN code = 'PD' THEN 'PERIOD(DATE)'
    WHEN code = 'PS' THEN 'PERIOD(TIMESTAMP(' || fraction_digits || '))' WHEN code = 'PT' THEN 'PERIOD(TIME(' || fraction_digits || '))'
    WHEN code = 'PM' THEN 'PERIOD(TIMESTAMP(' || fraction_digits || ') WITH TIME ZONE)'
    WHEN code = 'PZ' THEN 'PERIOD(TIME(' || fraction_digits || ') WITH TIME ZONE)'
    WHEN code = 'F ' THEN 'FLOAT' WHEN code = 'I1' THEN 'BYTEINT' WHEN code = 'I2' THEN 'SMALLINT' WHEN code = 'I8' THEN 'BIGINT'
    WHEN code = 'I ' THEN 'INTEGER' WHEN code = 'XM' THEN 'XML' WHEN code = 'JN' THEN 'JSON(' || column_length || ')'
    WHEN code = 'BF' THEN 'BYTE(' || column_length || ')' WHEN code = 'BV' THEN 'VARBYTE(' || column_length || ')'
    WHEN code = 'BO' THEN 'BLOB(' || column_length || ')' WHEN code = 'CO' THEN 'CLOB(' || column_length || ')'
    WHEN code = 'D ' THEN 'DECIMAL(' || total_digits || ',' || fraction_digits || ')'"""


@query(
    "decode_type_codes",
    f"""SELECT table_name, column_id, column_name, CASE {FRACTION_SQL}
          WHEN code = 'CF' THEN 'CHAR(' || least(column_length, 64000) || ')'
          WHEN code = 'CV' THEN 'VARCHAR(' || least(column_length, 64000) || ')'
          WHEN code = 'DA' THEN 'DATE' WHEN code = 'N' THEN {NUMBER_SQL}
          WHEN code = 'YR' THEN 'INTERVAL YEAR' WHEN code = 'YM' THEN 'INTERVAL YEAR TO MONTH' WHEN code = 'MO' THEN 'INTERVAL MONTH'
          WHEN code = 'DY' THEN 'INTERVAL DAY' WHEN code = 'DH' THEN 'INTERVAL DAY TO HOUR' WHEN code = 'DM' THEN 'INTERVAL DAY TO MINUTE'
          WHEN code = 'DS' THEN 'INTERVAL DAY TO SECOND' WHEN code = 'HR' THEN 'INTERVAL HOUR' WHEN code = 'HM' THEN 'INTERVAL HOUR TO MINUTE'
          WHEN code = 'HS' THEN 'INTERVAL HOUR TO SECOND' WHEN code = 'MI' THEN 'INTERVAL MINUTE' WHEN code = 'MS' THEN 'INTERVAL MINUTE TO SECOND'
          WHEN code = 'SC' THEN 'INTERVAL SECOND' ELSE 'VARCHAR(16777216)' END AS type_text FROM f_codes""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    text = typemap.dictionary_type(
        F.col("code"), F.col("column_length"), F.col("total_digits"), F.col("fraction_digits")
    )
    return derived(spark, sf, "f_codes").select(*CODE_COLUMNS, text.alias("type_text"))


@query(
    "decode_type_codes_legacy",
    f"""SELECT table_name, column_id, column_name, CASE {FRACTION_SQL}
          WHEN code = 'CF' THEN 'CHAR(' || least(column_length * 2, 64000) || ')'
          WHEN code = 'CV' THEN 'VARCHAR(' || least(column_length * 2, 64000) || ')'
          WHEN code = 'DA' THEN 'INTDATE' WHEN code = 'N' THEN {NUMBER_SQL}
          WHEN code = 'YR' THEN 'INTERVAL YEAR(' || total_digits || ')' WHEN code = 'YM' THEN 'INTERVAL YEAR(' || total_digits || ') TO MONTH'
          WHEN code = 'MO' THEN 'INTERVAL MONTH(' || total_digits || ')' WHEN code = 'DY' THEN 'INTERVAL DAY(' || total_digits || ')'
          WHEN code = 'DH' THEN 'INTERVAL DAY(' || total_digits || ') TO HOUR' WHEN code = 'DM' THEN 'INTERVAL DAY(' || total_digits || ') TO MINUTE'
          WHEN code = 'DS' THEN 'INTERVAL DAY(' || total_digits || ') TO SECOND(' || fraction_digits || ')'
          WHEN code = 'HR' THEN 'INTERVAL HOUR(' || total_digits || ')' WHEN code = 'HM' THEN 'INTERVAL HOUR(' || total_digits || ') TO MINUTE'
          WHEN code = 'HS' THEN 'INTERVAL HOUR(' || total_digits || ') TO SECOND(' || fraction_digits || ')'
          WHEN code = 'MI' THEN 'INTERVAL MINUTE(' || total_digits || ')'
          WHEN code = 'MS' THEN 'INTERVAL MINUTE(' || total_digits || ') TO SECOND(' || fraction_digits || ')'
          WHEN code = 'SC' THEN 'INTERVAL SECOND(' || total_digits || ',' || fraction_digits || ')'
          WHEN code = '++' THEN 'TD_ANYTYPE' WHEN code = 'VA' THEN 'TD_VALIST'
          WHEN code = 'UT' AND udt_name IS NOT NULL THEN udt_name
          WHEN code IN ('A1', 'AN') AND udt_name IS NOT NULL THEN 'SYSUDTLIB.' || udt_name
          ELSE '<Unknown> ' || code END AS type_text,
          CASE WHEN code IN ('CV', 'CF', 'CO') THEN CASE char_type WHEN 1 THEN ' CHARACTER SET LATIN' WHEN 2 THEN ' CHARACTER SET UNICODE'
               WHEN 3 THEN ' CHARACTER SET KANJISJIS' WHEN 4 THEN ' CHARACTER SET GRAPHIC' WHEN 5 THEN ' CHARACTER SET KANJI1' ELSE '' END
               ELSE '' END AS string_type FROM f_codes""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    text = typemap.legacy_dictionary_type(
        F.col("code"), F.col("column_length"), F.col("total_digits"), F.col("fraction_digits"), F.col("udt_name")
    )
    charset = typemap.legacy_charset(F.col("code"), F.col("char_type"))
    return derived(spark, sf, "f_codes").select(*CODE_COLUMNS, text.alias("type_text"), charset.alias("string_type"))


@query(
    "apply_schema",
    """SELECT o_orderkey AS "O_ORDERKEY", CAST(o_totalprice AS DECIMAL(18,2)) AS "O_TOTALPRICE",
              CAST(o_orderdate AS DATE) AS "O_ORDERDATE", o_orderstatus AS "O_ORDERSTATUS",
              TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS "O_LEVEL", CAST(NULL AS INTEGER) AS "O_BAD" FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_orderdate").cast("string"),
        "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("o_level"), F.col("o_orderstatus").alias("o_bad"),
    )
    types = {"o_orderkey": "bigint", "o_totalprice": "decimal(18,2)", "o_orderdate": "date", "o_level": "int", "o_bad": "int"}
    return shape.apply_schema(raw, types, bad="null")


@query(
    "zero_date_null",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    day = F.when(F.col("o_orderstatus") == "F", "0000-00-00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", zero_date_to_null(day).alias("day"))


FINGERPRINT = """concat_ws('~|~', coalesce(CAST(c_custkey AS VARCHAR), '~N~'), coalesce(c_name, '~N~'),
    coalesce(CAST(c_nationkey AS VARCHAR), '~N~'), coalesce(CAST(c_acctbal AS VARCHAR), '~N~'),
    coalesce(c_mktsegment, '~N~'), coalesce(strftime(updated_at, '%Y-%m-%d %H:%M:%S'), '~N~'))"""


@query("row_fingerprint", f"SELECT c_custkey, updated_at, c_acctbal, {FINGERPRINT} AS fingerprint FROM f_delta")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = derived(spark, sf, "f_delta")
    return rows.select("c_custkey", "updated_at", "c_acctbal", row_text(rows).alias("fingerprint"))


@query(
    "string_functions",
    """SELECT doc_id, trim(upper(source), ' ') AS up, replace(lang, 'e', 'E') AS swapped, concat_ws('-', lang, source) AS joined,
              left(source, 2) AS prefix, substr(source, 2, 3) AS middle, split_part(source, 'c', 2) AS tail,
              contains(lower(text), 'the') AS mentions, source LIKE 'src\\_%' ESCAPE '\\' AS escaped FROM documents""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.trim(F.upper("source")).alias("up"),
        F.replace("lang", F.lit("e"), F.lit("E")).alias("swapped"),
        F.concat_ws("-", "lang", "source").alias("joined"),
        F.left("source", F.lit(2)).alias("prefix"),
        F.substring("source", 2, 3).alias("middle"),
        F.split_part("source", F.lit("c"), F.lit(2)).alias("tail"),
        F.contains(F.lower("text"), F.lit("the")).alias("mentions"),
        F.expr(r"source LIKE 'src!_%' ESCAPE '!'").alias("escaped"),
    )


@query(
    "datetime_functions",
    f"""SELECT event_id, CAST(ts + INTERVAL 90 MINUTE AS TIMESTAMP) AS later,
               CAST(floor(epoch(TIMESTAMP '{AS_OF}' - ts)) AS BIGINT) AS seconds_ago,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS parsed,
               CAST(ts AS DATE) AS day, strftime(ts, '%I:%M:%S %p') AS clock FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        F.timestamp_add("MINUTE", F.lit(90), ts).alias("later"),
        F.timestamp_diff("SECOND", ts, ntz(AS_OF)).alias("seconds_ago"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("shown"),
        F.to_timestamp_ntz(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("parsed"),
        F.to_date(ts).alias("day"),
        F.date_format(ts, "hh:mm:ss a").alias("clock"),
    )


@query(
    "math_functions",
    """SELECT o_orderkey, abs(price - 200000) AS distance, CAST(ceil(price / 1073.741824) AS BIGINT) AS parts,
              CAST(round(price, 1) AS DECIMAL(18,1)) AS rounded, CAST(floor(price) AS BIGINT) AS whole,
              CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15)) AS BIGINT) AS from_hex
       FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders) o""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.abs(price - F.lit(200000)).cast("decimal(18,2)").alias("distance"),
        F.ceil(F.col("o_totalprice") / 1073.741824).alias("parts"),
        F.round(price, 1).cast("decimal(18,1)").alias("rounded"),
        F.floor(price).cast("bigint").alias("whole"),
        F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 15), 16, 10).cast("long").alias("from_hex"),
    )


@query(
    "json_metadata",
    """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS events,
              count_if(CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50) AS high
       FROM events GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    parsed = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(parsed >= 50).alias("high")
    )


@query(
    "merge_keys_array",
    """SELECT config_id, CASE WHEN coalesce(merge_keys_text, '') = '' THEN 0
              ELSE length(merge_keys_text) - length(replace(merge_keys_text, ',', '')) + 1 END AS key_count,
              CASE WHEN coalesce(merge_keys_text, '') = '' THEN NULL ELSE split_part(merge_keys_text, ',', 1) END AS first_key
       FROM f_config""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.filter(F.split(F.coalesce("merge_keys_text", F.lit("")), ","), lambda k: k != "")
    return derived(spark, sf, "f_config").withColumn("keys", keys).select(
        "config_id", F.size("keys").alias("key_count"), F.get("keys", F.lit(0)).alias("first_key")
    )


MINUTES = "(date_diff('second', last_loaded_at, TIMESTAMP '2024-01-30 12:30:00') / 60.0)"


@query(
    "freshness_label",
    f"""SELECT config_id, CASE WHEN last_loaded_at IS NULL THEN 'Never'
            WHEN {MINUTES} / 60 < 1 THEN CAST(CAST(floor({MINUTES}) AS BIGINT) AS VARCHAR) || 'm ago'
            WHEN {MINUTES} / 60 < 24 THEN CAST(CAST(round(CAST({MINUTES} / 60 AS DECIMAL(18,6)), 1) AS DECIMAL(18,1)) AS VARCHAR) || 'h ago'
            ELSE CAST(CAST(round(CAST({MINUTES} / 1440 AS DECIMAL(18,6)), 1) AS DECIMAL(18,1)) AS VARCHAR) || 'd ago' END AS freshness
        FROM f_config""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    label = freshness(F.col("last_loaded_at"), ntz("2024-01-30 12:30:00"))
    return derived(spark, sf, "f_config").select("config_id", label.alias("freshness"))
