"""Inputs derived from the given tables, in SQL both engines run."""

INPUTS: dict[str, str] = {
    # A loaded target that lacks one segment's keys and holds soft-deleted rows.
    "f_target": """
        SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment,
               CAST({ntz} '2000-06-01 00:00:00' + INTERVAL '1' DAY * c_nationkey AS {ntz}) AS updated_at,
               {ntz} '2000-12-31 00:00:00' AS _load_ts, 'seed' AS _src_file, 'b0' AS _batch_id,
               c_acctbal < 0 AS _is_deleted,
               CASE WHEN c_acctbal < 0 THEN {ntz} '2000-12-31 12:00:00' END AS _deleted_at
        FROM {customer} WHERE c_mktsegment <> 'MACHINERY'""",
    # What changed in 2001: one change per order, so keys repeat and some cursors are null.
    "f_delta": """
        SELECT o_custkey AS c_custkey, concat('Customer#', CAST(o_custkey AS {text})) AS c_name,
               CAST(length(o_orderpriority) AS INT) AS c_nationkey,
               CAST(o_totalprice AS DECIMAL(18,2)) AS c_acctbal, o_orderpriority AS c_mktsegment,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderdate END AS updated_at
        FROM {orders} WHERE o_orderdate >= {ntz} '2001-01-01 00:00:00'""",
    # The same target as history: current versions and, for some keys, an older closed one.
    "f_history": """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, updated_at,
               _load_ts, _src_file, _batch_id, FALSE AS _is_deleted, CAST(NULL AS {ntz}) AS _deleted_at,
               updated_at AS _valid_from, CAST(NULL AS {ntz}) AS _valid_to, TRUE AS _is_current
        FROM f_target
        UNION ALL
        SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal - 50 AS DECIMAL(18,2)), c_mktsegment, updated_at,
               _load_ts, _src_file, _batch_id, FALSE, CAST(NULL AS {ntz}),
               {ntz} '1999-01-01 00:00:00', updated_at, FALSE
        FROM f_target WHERE NOT _is_deleted""",
    # Keys still in the source: customers who ordered since 2000.
    "f_source_keys": """
        SELECT o_custkey AS c_custkey FROM {orders} WHERE o_orderdate >= {ntz} '2000-06-01 00:00:00'""",
    # Waiting batches: every month of 2001 is one.
    "f_backlog": """
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, updated_at,
               CAST(20010000 + 100 * month(o_orderdate) AS BIGINT) AS batch_no,
               CAST(date_trunc('month', o_orderdate) AS {ntz}) AS batch_at
        FROM (SELECT o_custkey AS c_custkey, concat('Customer#', CAST(o_custkey AS {text})) AS c_name,
                     CAST(length(o_orderpriority) AS INT) AS c_nationkey,
                     CAST(o_totalprice AS DECIMAL(18,2)) AS c_acctbal, o_orderpriority AS c_mktsegment,
                     CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderdate END AS updated_at,
                     o_orderdate
              FROM {orders} WHERE o_orderdate >= {ntz} '2001-01-01 00:00:00') o""",
    "f_run_log": """
        SELECT event_id AS run_no, CAST(floor(event_id / 5) AS BIGINT) AS batch_id, user_id AS table_no,
               CASE event_type WHEN 'signup' THEN 'success' WHEN 'purchase' THEN 'success'
                    WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'mismatch' ELSE 'failed' END AS status,
               CASE event_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental'
                    WHEN 2 THEN 'reconcile' ELSE 'validate' END AS load_type,
               CASE WHEN event_type = 'error'
                    THEN concat('step failed with code ', CAST(event_id % 23 AS {text}), ' ', props) END AS error_message,
               CAST(value AS DECIMAL(18,2)) AS duration_sec, event_id % 1000 AS rows_extracted,
               event_id % 900 AS rows_loaded, ts AS inserted_at
        FROM {events}""",
    "f_step_log": """
        SELECT CAST(floor(event_id / 7) AS BIGINT) AS run_id, CAST(floor(event_id / 70) AS BIGINT) AS config_id,
               CAST(event_id % 7 + 1 AS INT) AS step_order,
               CASE event_id % 7 WHEN 0 THEN 'ddl' WHEN 1 THEN 'schema_drift' WHEN 2 THEN 'extract'
                    WHEN 3 THEN 'upload' WHEN 4 THEN 'load' WHEN 5 THEN 'merge' ELSE 'watermark' END AS step_name,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped'
                    WHEN event_type = 'click' THEN 'running' ELSE 'success' END AS status,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS started_at,
               CASE WHEN event_type = 'click' THEN NULL ELSE ts + INTERVAL '90' SECOND END AS ended_at
        FROM {events}""",
    "f_manifest": """
        SELECT o_orderkey AS manifest_id, CAST(o_custkey % 50 AS INT) AS config_id, o_orderdate AS run_at,
               CASE o_orderstatus WHEN 'F' THEN 'loaded' WHEN 'O' THEN 'uploaded' ELSE 'extracted' END AS status,
               CASE o_orderkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 's3' ELSE 'azure' END AS storage_type,
               CASE o_orderkey % 2 WHEN 0 THEN 'parquet' ELSE 'csv' END AS file_format,
               CAST(o_totalprice AS DECIMAL(18,2)) AS file_size_bytes, o_orderkey % 1000 AS row_count,
               CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS uploaded_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS loaded_at
        FROM {orders}""",
    # Status changes on manifest rows: one per line item of the order.
    "f_manifest_changes": """
        SELECT l_orderkey AS manifest_id,
               CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'uploaded' ELSE 'loaded' END AS status,
               l_shipdate AS changed_at
        FROM {lineitem} WHERE l_shipdate >= {ntz} '2001-01-01 00:00:00'""",
    # Column metadata: twelve columns per table, all type branches.
    "f_columns": """
        SELECT concat('tab_', CAST(CAST(floor(p_partkey / 12) AS BIGINT) AS {text})) AS table_name,
               CAST(p_partkey % 12 AS INT) AS column_id,
               CASE p_partkey % 12
                    WHEN 0 THEN 'id' WHEN 1 THEN 'Code'
                    WHEN 2 THEN CASE WHEN p_size < 12 THEN 'Updated_At' WHEN p_size < 24 THEN 'modified_at'
                                     WHEN p_size < 36 THEN 'last_modified' ELSE 'remark' END
                    WHEN 3 THEN CASE WHEN p_size < 25 THEN 'created_at' ELSE 'created_by' END
                    ELSE concat('col_', CAST(p_partkey % 12 AS {text})) END AS column_name,
               CASE WHEN p_partkey % 12 = 0 THEN CASE WHEN p_size < 40 THEN 'bigint' ELSE 'varchar' END
                    WHEN p_partkey % 12 IN (2, 3) THEN
                         CASE p_size % 4 WHEN 0 THEN 'datetime' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'date' ELSE 'varchar' END
                    ELSE CASE (p_partkey + p_size) % 24
                         WHEN 0 THEN 'tinyint' WHEN 1 THEN 'tinyint' WHEN 2 THEN 'smallint' WHEN 3 THEN 'YEAR'
                         WHEN 4 THEN 'decimal' WHEN 5 THEN 'numeric' WHEN 6 THEN 'float' WHEN 7 THEN 'double'
                         WHEN 8 THEN 'bit' WHEN 9 THEN 'datetime' WHEN 10 THEN 'timestamp' WHEN 11 THEN 'date'
                         WHEN 12 THEN 'time' WHEN 13 THEN 'json' WHEN 14 THEN 'enum' WHEN 15 THEN 'set'
                         WHEN 16 THEN 'blob' WHEN 17 THEN 'varbinary' WHEN 18 THEN 'longtext' WHEN 19 THEN 'char'
                         WHEN 20 THEN 'varchar' WHEN 21 THEN 'mediumint' WHEN 22 THEN 'geometry' ELSE 'int' END
                    END AS data_type,
               CASE WHEN (p_partkey + p_size) % 24 = 0 THEN 'tinyint(1)' ELSE 'other' END AS column_type,
               CAST(CASE WHEN p_size < 3 THEN NULL ELSE p_size + 4 END AS INT) AS numeric_precision,
               CAST(CASE WHEN p_size < 6 THEN NULL ELSE p_size % 5 END AS INT) AS numeric_scale,
               CAST(CASE WHEN p_size < 9 THEN NULL ELSE p_size * 10 END AS BIGINT) AS character_maximum_length,
               CASE p_size % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'text' ELSE 'skip' END AS blob_mode,
               CAST(CASE WHEN p_partkey % 12 = 0 AND p_size < 45 THEN 2
                    WHEN p_partkey % 12 = 1 AND p_size < 15 THEN 1 END AS INT) AS key_position
        FROM {part}""",
    # Dictionary columns of the second source kind: every type code.
    "f_codes": """
        SELECT concat('td_', CAST(CAST(floor(l_orderkey / 10) AS BIGINT) AS {text})) AS table_name,
               l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS column_id,
               concat('c', CAST(l_partkey AS {text})) AS column_name,
               CASE l_partkey % 45
                    WHEN 0 THEN 'BF' WHEN 1 THEN 'BV' WHEN 2 THEN 'CF' WHEN 3 THEN 'CV' WHEN 4 THEN 'D '
                    WHEN 5 THEN 'DA' WHEN 6 THEN 'F ' WHEN 7 THEN 'I1' WHEN 8 THEN 'I2' WHEN 9 THEN 'I8'
                    WHEN 10 THEN 'I ' WHEN 11 THEN 'AT' WHEN 12 THEN 'TS' WHEN 13 THEN 'TZ' WHEN 14 THEN 'SZ'
                    WHEN 15 THEN 'BO' WHEN 16 THEN 'CO' WHEN 17 THEN 'PD' WHEN 18 THEN 'PS' WHEN 19 THEN 'PT'
                    WHEN 20 THEN 'PM' WHEN 21 THEN 'PZ' WHEN 22 THEN 'N' WHEN 23 THEN 'JN' WHEN 24 THEN 'XM'
                    WHEN 25 THEN 'YR' WHEN 26 THEN 'YM' WHEN 27 THEN 'MO' WHEN 28 THEN 'DY' WHEN 29 THEN 'DH'
                    WHEN 30 THEN 'DM' WHEN 31 THEN 'DS' WHEN 32 THEN 'HR' WHEN 33 THEN 'HM' WHEN 34 THEN 'HS'
                    WHEN 35 THEN 'MI' WHEN 36 THEN 'MS' WHEN 37 THEN 'SC' WHEN 38 THEN 'UT' WHEN 39 THEN '++'
                    WHEN 40 THEN 'A1' WHEN 41 THEN 'AN' WHEN 42 THEN 'VA' WHEN 43 THEN 'N' ELSE 'QQ' END AS code,
               CAST(l_quantity * 1000 AS BIGINT) AS column_length,
               CAST(CASE WHEN l_linenumber = 7 THEN -128 ELSE l_suppkey % 38 + 1 END AS INT) AS total_digits,
               CAST(CASE WHEN l_linenumber = 6 THEN -128 ELSE l_linenumber - 1 END AS INT) AS fraction_digits,
               CAST(l_linenumber % 6 AS INT) AS char_type,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('udt_', l_returnflag) END AS udt_name
        FROM {lineitem}""",
    # Type texts as a second source's dictionary gives them.
    "f_type_texts": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE l_partkey % 30
                    WHEN 0 THEN 'BYTEINT' WHEN 1 THEN ' integer ' WHEN 2 THEN 'DECIMAL(18,2)' WHEN 3 THEN 'NUMERIC(40, 3)'
                    WHEN 4 THEN 'NUMBER(*,3)' WHEN 5 THEN 'NUMBER(12)' WHEN 6 THEN 'DECIMAL' WHEN 7 THEN 'FLOAT'
                    WHEN 8 THEN 'DOUBLE PRECISION' WHEN 9 THEN 'INTDATE' WHEN 10 THEN 'TIME(6) WITH TIME ZONE'
                    WHEN 11 THEN 'TIME' WHEN 12 THEN 'TIMESTAMP(6)' WHEN 13 THEN 'TIMESTAMP(0) WITH TIME ZONE'
                    WHEN 14 THEN 'INTERVAL DAY TO SECOND' WHEN 15 THEN 'PERIOD(DATE)'
                    WHEN 16 THEN concat('CHAR(', CAST(l_linenumber AS {text}), ')') WHEN 17 THEN 'CHARACTER'
                    WHEN 18 THEN concat('VARCHAR(', CAST(l_suppkey * 1000000 AS {text}), ')') WHEN 19 THEN 'VARCHAR'
                    WHEN 20 THEN 'CLOB(2000)' WHEN 21 THEN 'BLOB(10)' WHEN 22 THEN 'BYTE(4)' WHEN 23 THEN 'VARBYTE(9)'
                    WHEN 24 THEN 'JSON(100)' WHEN 25 THEN 'XML' WHEN 26 THEN 'TD_ANYTYPE' WHEN 27 THEN 'SYSUDTLIB.pt'
                    WHEN 28 THEN NULL ELSE 'mystery' END AS type_text
        FROM {lineitem}""",
    # One configured table per customer.
    "f_config": """
        SELECT c_custkey AS config_id, concat('db', CAST(c_nationkey AS {text})) AS source_db,
               concat('tab_', CAST(c_custkey AS {text})) AS source_table,
               concat('RAW_', c_mktsegment) AS target_table,
               CASE c_custkey % 4 WHEN 0 THEN 'updated_at' WHEN 1 THEN NULL WHEN 2 THEN 'ID' ELSE 'created_at' END AS watermark_col,
               CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'id' ELSE 'time' END AS watermark_type,
               CASE c_custkey % 5 WHEN 0 THEN NULL ELSE 'id' END AS primary_key,
               CASE c_custkey % 3 WHEN 0 THEN 'emp_no,from_date' WHEN 1 THEN '' ELSE NULL END AS merge_keys_text,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'FULL' ELSE 'incremental' END AS load_type,
               CASE WHEN c_acctbal < 1000 THEN NULL
                    ELSE CAST({ntz} '2024-01-30 12:00:00' - INTERVAL '1' HOUR * (c_nationkey * 3) AS {ntz}) END AS last_loaded_at,
               CASE WHEN c_acctbal < 5000 THEN NULL ELSE c_custkey END AS last_loaded_key,
               c_mktsegment <> 'FURNITURE' AS active,
               CASE c_nationkey % 4 WHEN 0 THEN 'Success' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' END AS last_run_status,
               CAST(c_acctbal AS DECIMAL(18,2)) AS notes_value
        FROM {customer}""",
    # A catalogue of tables: one per supplier order line group, some in system schemas.
    "f_catalogue": """
        SELECT CASE s_nationkey % 6 WHEN 0 THEN 'mysql' WHEN 1 THEN 'Sys' WHEN 2 THEN 'dbc'
                    ELSE concat('db', CAST(s_nationkey AS {text})) END AS schema_name,
               s_name AS table_name,
               CASE s_nationkey % 5 WHEN 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
        FROM {supplier}""",
    # A mixed run log, one line per event.
    "f_log_lines": """
        SELECT event_id AS line_no,
               CASE event_type
                    WHEN 'signup' THEN concat('[db', CAST(user_id % 5 AS {text}), '.t', CAST(user_id AS {text}), '] ✅ load done')
                    WHEN 'error' THEN concat('[db.t', CAST(user_id AS {text}), '] FAILED: code ', CAST(event_id % 23 AS {text}))
                    WHEN 'view' THEN concat('[full/', CAST(user_id AS {text}), '] batch started')
                    WHEN 'click' THEN concat('no new rows for user ', CAST(user_id AS {text}))
                    ELSE concat('Total Rows Exported:  ', CASE WHEN event_id % 2 = 0 THEN '1,2' ELSE '' END,
                                CAST(event_id + 100 AS {text})) END AS line
        FROM {events}""",
}
