"""The engine's tables as views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "files": """
        SELECT source AS project, lang || '/' || source || '/' || CAST(doc_id AS STRING) || '.ts' AS file_path, CAST(doc_id * 1000 AS DOUBLE) AS mtime_ms,
            n_chars AS size, md5(coalesce(text, '')) AS content_hash, '2024-01-01T00:00:00.000Z' AS updated_at,
            CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS line_count
        FROM documents""",
    "symbols": """
        SELECT id, project, file_path, kind, name, start_line, start_column, start_line + size AS end_line, 1 AS end_column, is_exported, signature,
            md5(name || '|' || kind || '|' || coalesce(signature, '')) AS fingerprint, detail_json, content_hash, '2024-01-01T00:00:00.000Z' AS indexed_at, resolved_type,
            CASE WHEN id % 17 = 0 THEN NULL ELSE md5(kind || '|' || CAST(size AS STRING) || '|' || CAST(id % 400 AS STRING)) END AS structural_fingerprint
        FROM (
            SELECT id, project, file_path, kind, size, is_exported, detail_json, content_hash, resolved_type, start_line, start_column,
                CASE WHEN kind IN ('method', 'property') THEN 'Part' || CAST(id % 40 AS STRING) || '.' || word ELSE word END AS name,
                CASE WHEN kind IN ('function', 'method') THEN 'params:' || CAST(size % 4 AS STRING) || '|async:' || CAST(id % 2 AS STRING) END AS signature
            FROM (
                SELECT p_partkey AS id, lower(p_type) AS project, 'src/' || replace(lower(p_brand), '#', '_') || '/m' || CAST(p_partkey % 20 AS STRING) || '.ts' AS file_path,
                    CASE p_size % 9 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' WHEN 3 THEN 'variable' WHEN 4 THEN 'type' WHEN 5 THEN 'interface' WHEN 6 THEN 'enum' WHEN 7 THEN 'namespace' ELSE 'property' END AS kind,
                    replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN '' ELSE '-' END) || '_' || CAST(p_partkey % 300 AS STRING) AS word, p_size AS size, p_partkey % 3 <> 0 AS is_exported,
                    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN '{broken' ELSE '{"returnType":"T' || CAST(p_size % 5 AS STRING) || '","parameters":[{"name":"a","type":"string","isOptional":false},{"name":"b","isOptional":true}],"decorators":[{"name":"D' || CAST(p_partkey % 6 AS STRING) || '"},{"name":"E' || CAST(p_size % 4 AS STRING) || '"}],"members":[{"name":"x","kind":"method","type":"T"},{"name":"y' || CAST(p_partkey % 5 AS STRING) || '","kind":"property","type":"U"}]}' END AS detail_json,
                    md5(p_name) AS content_hash, CASE WHEN p_partkey % 10 = 0 THEN 'string' END AS resolved_type, CAST(1 + (p_partkey * 7) % 300 AS INT) AS start_line, p_size % 40 AS start_column
                FROM part))""",
    "relations": """
        SELECT k * 8 + l AS id, 'p' || CAST(s % 3 AS STRING) AS project, type, 'src/n' || CAST(s % 40 AS STRING) || '.ts' AS src_file_path,
            CASE WHEN type IN ('imports', 'type-references') THEN NULL ELSE 'sym' || CAST(k % 30 AS STRING) END AS src_symbol_name,
            CASE WHEN d > 0 THEN 'p' || CAST(p % 3 AS STRING) END AS dst_project, CASE WHEN d > 0 THEN 'src/n' || CAST(p % 60 AS STRING) || '.ts' END AS dst_file_path,
            CASE WHEN l = 7 THEN NULL ELSE 'sym' || CAST(p % 30 AS STRING) END AS dst_symbol_name,
            CASE WHEN type = 're-exports' THEN '{"isReExport":true,"specifiers":[{"local":"sym' || CAST(p % 30 AS STRING) || '","exported":"sym' || CAST(k % 30 AS STRING) || '"}]}' WHEN d > 0 THEN NULL ELSE '{"isExternal":true}' END AS meta_json,
            CASE WHEN d > 0 THEN './n' || CAST(p % 60 AS STRING) ELSE 'pkg' || CAST(p % 9 AS STRING) END AS specifier, d = 0 AS is_external
        FROM (
            SELECT l_orderkey AS k, l_linenumber AS l, min(l_suppkey) AS s, min(l_partkey) AS p, min(l_discount) AS d,
                CASE l_linenumber WHEN 2 THEN 'type-references' WHEN 3 THEN 're-exports' WHEN 4 THEN 'calls' WHEN 5 THEN 'extends' WHEN 6 THEN 'implements' ELSE 'imports' END AS type
            FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "chain": """
        SELECT 'o' || CAST(o_orderkey AS STRING) AS src, 'o' || CAST(prev AS STRING) AS dst
        FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL""",
    "rings": """
        SELECT DISTINCT 's' || CAST(a AS STRING) AS src, 's' || CAST(b AS STRING) AS dst FROM (
            SELECT k AS a, k - k % 12 + (5 * k + 1) % 12 AS b FROM (SELECT s_suppkey AS k FROM supplier)
            UNION ALL SELECT k, k - k % 12 + (7 * k + n) % 12 FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) WHERE k % 4 = 0
            UNION ALL SELECT k, k + 12 FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 12 = 5)""",
    "changelog": """
        SELECT event_id AS id, 'p' || CAST(user_id % 3 AS STRING) AS project, CASE event_type WHEN 'click' THEN 'modified' WHEN 'error' THEN 'removed' WHEN 'purchase' THEN 'added' WHEN 'signup' THEN 'renamed' ELSE 'moved' END AS change_type,
            'sym' || CAST(user_id % 50 AS STRING) AS symbol_name, 'function' AS symbol_kind, 'src/n' || CAST(user_id % 40 AS STRING) || '.ts' AS file_path,
            CASE event_type WHEN 'signup' THEN 'old' || CAST(user_id % 50 AS STRING) END AS old_name, CASE event_type WHEN 'view' THEN 'src/old.ts' END AS old_file_path, md5(props) AS fingerprint,
            substr(CAST(ts AS STRING), 1, 19) AS changed_at, event_id % 11 = 0 AS is_full_index, 'run' || CAST(user_id % 20 AS STRING) AS index_run_id
        FROM events""",
    "annotations": """
        SELECT event_id AS id, 'p' || CAST(user_id % 3 AS STRING) AS project, 'src/n' || CAST(user_id % 40 AS STRING) || '.ts' AS file_path,
            CASE event_type WHEN 'click' THEN 'deprecated' WHEN 'error' THEN 'todo' WHEN 'purchase' THEN 'param' WHEN 'signup' THEN 'see' ELSE 'returns' END AS tag,
            event_type || ' value_' || CAST(user_id % 25 AS STRING) || ' ' || props AS value, CASE event_id % 3 WHEN 0 THEN 'jsdoc' WHEN 1 THEN 'line' ELSE 'block' END AS source,
            CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'sym' || CAST(user_id % 50 AS STRING) END AS symbol_name, CAST(1 + event_id % 500 AS INT) AS start_line, 0 AS start_column, CAST(1 + event_id % 500 AS INT) AS end_line, 9 AS end_column, '2024-01-01T00:00:00.000Z' AS indexed_at
        FROM events""",
    "comments": """
        SELECT event_id AS id, 'src/n' || CAST(user_id % 40 AS STRING) || '.ts' AS file_path, CAST(1 + (event_id * 3) % 900 AS INT) AS line,
            CASE event_id % 4 WHEN 0 THEN 'plain remark ' || event_type WHEN 1 THEN 'fix @' || event_type || ' later ' || props WHEN 2 THEN '@' || event_type || '-x1 ' || props ELSE 'mail me@' || event_type || ' now' END AS text
        FROM events""",
    "declarations": """
        SELECT p_partkey AS id, 'src/n' || CAST(p_partkey % 40 AS STRING) || '.ts' AS file_path, CAST(1 + (p_partkey * 11) % 900 AS INT) AS start_line, 'decl' || CAST(p_partkey AS STRING) AS name FROM part""",
    "nodes": """
        SELECT p_partkey AS id, p_partkey % 40 AS file_id, CAST((p_partkey * 13) % 1000 AS INT) AS start_at, CAST((p_partkey * 13) % 1000 + 1 + p_size * p_size AS INT) AS end_at FROM part""",
    "offsets": """SELECT o_orderkey AS id, o_orderkey % 40 AS file_id, CAST((o_custkey * 31) % 1500 AS INT) AS at FROM orders""",
    "leases": """
        SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS pid, user_id % 5 AS own_pid, event_id % 3 <> 0 AS alive, CAST(floor(value * 10) AS BIGINT) AS age_s, 'i' || CAST(user_id % 4 AS STRING) AS instance_id, 'i' || CAST(event_id % 4 AS STRING) AS own_instance FROM events""",
}
#: Snapshots: before = symbols, after = symbols with deterministic edits by key.
_COLUMNS = "id, project, kind, signature, start_line, is_exported, structural_fingerprint"
VIEWS["before_snapshot"] = f"SELECT {_COLUMNS}, file_path, name, fingerprint FROM symbols WHERE id % 19 <> 1"
VIEWS["after_snapshot"] = f"""
    SELECT {_COLUMNS}, CASE WHEN id % 23 = 2 THEN 'src/moved/' || CAST(id % 9 AS STRING) || '.ts' ELSE file_path END AS file_path,
        CASE WHEN id % 7 = 3 THEN 'new_' || name ELSE name END AS name, CASE WHEN id % 11 = 4 THEN md5(fingerprint) ELSE fingerprint END AS fingerprint
    FROM symbols WHERE id % 31 <> 5"""
BASED_ON = {"before_snapshot": "symbols", "after_snapshot": "symbols"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the Parquet tables of ``sf_dir``, inlined into one plan."""
    if name.endswith("_raw"):
        return spark.read.parquet(f"{sf_dir}/{name.removesuffix('_raw')}.parquet")
    if name in BASED_ON:
        return spark.sql(VIEWS[name].replace(f"FROM {BASED_ON[name]}", "FROM {base}"), base=view(spark, sf_dir, BASED_ON[name]))
    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", VIEWS[name])]
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str) -> str:
    """DuckDB text: the views that ``sql`` names, as common tables before it."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    names = list(dict.fromkeys([BASED_ON[v] for v in names if v in BASED_ON] + names))
    tables = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    recursive = "RECURSIVE " if "/*recursive*/" in sql else ""
    sql = sql.strip()
    if not names and not recursive:
        return sql
    if sql.upper().startswith("WITH "):
        sql = sql[5:].removeprefix("RECURSIVE ")
        return f"WITH {recursive}{tables}, {sql}"
    return f"WITH {recursive}{tables} {sql}"
