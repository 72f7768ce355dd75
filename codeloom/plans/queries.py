"""A query for each operator over the adapter's views, and the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import bindings, diff, graph, imports, places, search
from codeloom.plans.adapter import view, with_views
from codeloom.sources import projects, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(lambda v: view(spark, sf_dir, v))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return build

    return register


def simple(name: str, sql: str, build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    query(name, sql)(build)


SYM = "id, project, file_path, kind, name"
REL = "id, type, src_file_path, src_symbol_name, dst_file_path, dst_symbol_name"
_sym = lambda df: df.select("id", "project", "file_path", "kind", "name")
_rel = lambda df: df.select(*REL.split(", "))
_FILE, _PRJ = "src/brand_2/m0.ts", "economy"

# --- sources -------------------------------------------------------------------------------
_BOUNDS = [("en", "english"), ("en/src1", "english-one"), ("de/src0", "german-zero"), ("fr", "french")]
_BOUNDS_SQL = "bounds(dir, project) AS (VALUES " + ", ".join(f"('{d}', '{p}')" for d, p in _BOUNDS) + ")"


@query("a2_resolve_file_project", f"""WITH {_BOUNDS_SQL} SELECT file_path, coalesce((SELECT arg_max(b.project, length(b.dir)) FROM bounds b WHERE f.file_path = b.dir OR starts_with(f.file_path, b.dir || '/')), 'default') AS project FROM files f""")
def _a2(v):
    files = v("files").select("file_path")
    return projects.file_projects(files, files.sparkSession.createDataFrame(_BOUNDS, "dir string, project string")).select("file_path", "project")


_SCAN = "SELECT project, file_path, CASE WHEN size % 3 = 0 THEN mtime_ms + 1 ELSE mtime_ms END AS mtime_ms, size, CASE WHEN size % 5 = 0 THEN 'x' || content_hash ELSE content_hash END AS content_hash FROM files WHERE size % 7 <> 0"


@query("a3_detect_changes", f"""WITH scan AS ({_SCAN}), old AS (SELECT * FROM files WHERE size % 11 <> 0)
    SELECT coalesce(s.project, o.project) AS project, coalesce(s.file_path, o.file_path) AS file_path,
        CASE WHEN s.file_path IS NULL THEN 'deleted' WHEN o.file_path IS NULL THEN 'changed' WHEN (s.mtime_ms = o.mtime_ms AND s.size = o.size) OR s.content_hash = o.content_hash THEN 'unchanged' ELSE 'changed' END AS status
    FROM scan s FULL OUTER JOIN old o ON s.project = o.project AND s.file_path = o.file_path""")
def _a3(v):
    f = v("files")
    scan = f.where("size % 7 != 0").select("project", "file_path", F.expr("CASE WHEN size % 3 = 0 THEN mtime_ms + 1 ELSE mtime_ms END").alias("mtime_ms"), "size", F.expr("CASE WHEN size % 5 = 0 THEN 'x' || content_hash ELSE content_hash END").alias("content_hash"))
    return projects.detect_changes(scan, f.where("size % 11 != 0"))


simple("a4_scan_scope", "SELECT file_path FROM files WHERE file_path LIKE '%.ts' AND NOT regexp_matches(file_path, '^fr/[^/]*/[^/]*$')", lambda v: v("files").where(projects.in_scope(F.col("file_path"), ignore=["fr/*/*"])).select("file_path"))
simple("a10_list_files", "SELECT file_path, size, content_hash FROM files WHERE project = 'src0'", lambda v: v("files").where("project = 'src0'").select("file_path", "size", "content_hash"))
simple("a11_get_file", "SELECT file_path, size, line_count FROM files WHERE project = 'src1' AND file_path = 'en/src1/1.ts'", lambda v: v("files").where("project = 'src1' AND file_path = 'en/src1/1.ts'").select("file_path", "size", "line_count"))
simple("a12_file_symbols", f"SELECT {SYM} FROM symbols WHERE project = '{_PRJ}' AND file_path = '{_FILE}'", lambda v: _sym(search.file_symbols(v("symbols"), _PRJ, _FILE)))

# --- writes ---------------------------------------------------------------------------------
_FC = "project, file_path, size, content_hash"


@query("b1_upsert_files", f"""WITH fresh AS (SELECT project, file_path, size + 1 AS size, 'new' AS content_hash FROM files WHERE size % 4 = 1 UNION ALL SELECT 'src0', 'made/' || file_path, size, content_hash FROM files WHERE size % 50 = 3)
    SELECT {_FC} FROM fresh UNION ALL SELECT f.project, f.file_path, f.size, f.content_hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM fresh n WHERE n.project = f.project AND n.file_path = f.file_path)""")
def _b1(v):
    f = v("files").select("project", "file_path", "size", "content_hash")
    fresh = f.where("size % 4 = 1").selectExpr("project", "file_path", "size + 1 AS size", "'new' AS content_hash").unionByName(f.where("size % 50 = 3").selectExpr("'src0' AS project", "'made/' || file_path AS file_path", "size", "content_hash"))
    return tables.upsert(f, fresh, ["project", "file_path"])


@query("b2_replace_file_symbols", f"""WITH touched AS (SELECT DISTINCT project, file_path FROM symbols WHERE id % 37 = 0)
    SELECT {SYM} FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.project = s.project AND t.file_path = s.file_path)
    UNION ALL SELECT id + 1000000, project, file_path, kind, 'new_' || name FROM symbols WHERE id % 37 = 0""")
def _b2(v):
    s = _sym(v("symbols"))
    hit = s.where("id % 37 = 0")
    return tables.replace_of_files(s, hit.select("project", "file_path").distinct(), hit.selectExpr("id + 1000000 AS id", "project", "file_path", "kind", "'new_' || name AS name"))


simple("b3_default_dst_project", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN dst_project END, CASE WHEN dst_file_path IS NOT NULL THEN project END) AS dst_project FROM relations", lambda v: tables.default_dst_project(v("relations").withColumn("dst_project", F.expr("CASE WHEN id % 2 = 0 THEN dst_project END"))).select("id", "dst_project"))
simple("b4_replace_file_annotations", "SELECT id, tag FROM annotations WHERE NOT (project = 'p1' AND file_path = 'src/n1.ts') UNION ALL SELECT id, 'again' FROM annotations WHERE project = 'p1' AND file_path = 'src/n1.ts' AND id % 2 = 0", lambda v: (lambda a, hit: tables.replace_of_files(a, hit.select("project", "file_path").distinct(), hit.where("id % 2 = 0").withColumn("tag", F.lit("again"))))(v("annotations").select("id", "project", "file_path", "tag"), v("annotations").where("project = 'p1' AND file_path = 'src/n1.ts'").select("id", "project", "file_path", "tag")).select("id", "tag"))


@query("b6_retarget_relations", """SELECT id, CASE WHEN hit THEN 'src/moved.ts' ELSE dst_file_path END AS dst_file_path, CASE WHEN hit THEN 'symNew' ELSE dst_symbol_name END AS dst_symbol_name, CASE WHEN hit THEN 'p9' ELSE dst_project END AS dst_project
    FROM (SELECT *, coalesce(dst_project = 'p1' AND dst_file_path = 'src/n7.ts' AND dst_symbol_name = 'sym7', false) OR coalesce(dst_project = 'p2' AND dst_file_path = 'src/n5.ts' AND dst_symbol_name IS NULL, false) AS hit FROM relations)""")
def _b6(v):
    r = v("relations")
    moved = r.sparkSession.createDataFrame([("p1", "src/n7.ts", "sym7", "src/moved.ts", "symNew", "p9"), ("p2", "src/n5.ts", None, "src/moved.ts", "symNew", "p9")], "dst_project string, old_file string, old_symbol string, new_file string, new_symbol string, new_project string")
    return tables.retarget(r, moved).select("id", "dst_file_path", "dst_symbol_name", "dst_project")


_GONE = "(project = 'p0' AND file_path IN ('src/n3.ts', 'src/n9.ts', 'src/n12.ts'))"


@query("b7_cascade_delete_relations", f"SELECT {REL} FROM relations WHERE NOT {_GONE.replace('file_path', 'src_file_path')} AND NOT coalesce({_GONE.replace('project', 'dst_project').replace('file_path', 'dst_file_path')}, false)")
def _b7(v):
    r = v("relations")
    gone = r.sparkSession.createDataFrame([("p0", f"src/n{n}.ts") for n in (3, 9, 12)], "project string, file_path string")
    return _rel(tables.cascade_delete(v("files"), v("symbols"), r, v("annotations"), gone)["relations"])


simple("b8_prune_changelog", "SELECT id FROM changelog WHERE NOT (changed_at < '2024-01-10 00:00:00' AND project = 'p1')", lambda v: tables.pruned(v("changelog"), "2024-01-10 00:00:00", "p1").select("id"))

# --- searches -------------------------------------------------------------------------------
_FTS = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"


def _fts_sql(columns: list[str], q: str) -> str:
    every = []
    for phrase in T.fts_phrases(q):
        n = len(phrase)
        whole = "".join(f" AND t[i + {k}] = '{p}'" for k, p in enumerate(phrase[:-1]))
        every.append("(" + " OR ".join(f"len(list_filter(range(1, len({_FTS(c)}) - {n} + 2), lambda i: list_bool_and(list_transform([{_FTS(c)}], lambda t: starts_with(t[i + {n - 1}], '{phrase[-1]}'){whole})))) > 0" for c in columns) + ")")
    return " AND ".join(every) or "false"


_SC, _AC = ["name", "file_path", "kind"], ["tag", "value"]


def _search_symbols(name: str, where: str, limit: int | None = None, **conditions) -> None:
    tail = f" ORDER BY name, id LIMIT {limit}" if limit is not None else ""
    simple(name, f"SELECT {SYM} FROM symbols WHERE {where}{tail}", lambda v: _sym(search.search_symbols(v("symbols"), limit=limit, **conditions)))


_search_symbols("c1_search_symbols", f"{_fts_sql(_SC, 'ring brand')} AND kind = 'method' AND is_exported AND project = 'small'", text="ring brand", kind="method", is_exported=True, project="small")
_search_symbols("c2_exact_name", "name = 'small_ring_0'", text="small_ring_0", exact=True)
_search_symbols("c3_fts_prefix", _fts_sql(_SC, "red-wid"), text="red-wid")
_search_symbols("c4_regex", "regexp_matches(name, '(ring|bolt)_?[0-9]+$')", regex="(ring|bolt)_?[0-9]+$")
_search_symbols("c5_decorator", "detail_json LIKE '{\"ret%' AND (detail_json LIKE '%{\"name\":\"D3\"}%')", decorator="D3")
_search_symbols("c6_resolved_type", "resolved_type = 'string'", resolved_type="string")
simple("c7_search_by_name", f"SELECT {SYM} FROM symbols WHERE {_fts_sql(_SC, 'blue')} AND project = 'large' ORDER BY name, id LIMIT 50", lambda v: _sym(search.search_by_name(v("symbols"), "blue", "large")))
simple("c8_by_kind", f"SELECT {SYM} FROM symbols WHERE project = 'promo' AND kind = 'enum'", lambda v: _sym(search.by_kind(v("symbols"), "promo", "enum")))
simple("c9_by_fingerprint", f"SELECT {SYM} FROM symbols s WHERE EXISTS (SELECT 1 FROM symbols o WHERE o.id = 4 AND o.project = s.project AND o.fingerprint = s.fingerprint)", lambda v: _sym(v("symbols").join(v("symbols").where("id = 4").select("project", "fingerprint"), ["project", "fingerprint"], "left_semi")))
simple("c10_search_relations", f"SELECT {REL} FROM relations WHERE type = 'imports' AND project = 'p1' AND dst_symbol_name IS NULL", lambda v: _rel(search.search_relations(v("relations"), type="imports", project="p1", dst_symbol_name=None)))
simple("c11_glob_relations", f"SELECT {REL} FROM relations WHERE regexp_matches(src_file_path, '^src/n1[^/]*\\.ts$') AND (dst_file_path IS NULL OR regexp_matches(dst_file_path, '^(.*/)?n(2|3)[^/]\\.ts$'))", lambda v: _rel(search.search_relations(v("relations"), src_glob="src/n1*.ts", dst_glob="**/n{2,3}?.ts")))
simple("c12_result_shape", "SELECT id, CASE WHEN instr(name, '.') > 0 THEN substr(name, instr(name, '.') + 1) END AS member_name, start_line AS line, CASE WHEN detail_json LIKE '{\"ret%' THEN 'T' || CAST(CAST(end_line - start_line AS INT) % 5 AS STRING) END AS return_type FROM symbols", lambda v: search.shaped_symbols(v("symbols")).select("id", "member_name", F.col("span.start.line").alias("line"), F.col("detail.returnType").alias("return_type")))
simple("c13_outgoing", f"SELECT {REL} FROM relations WHERE project = 'p2' AND src_file_path = 'src/n5.ts' AND (src_symbol_name = 'sym3' OR src_symbol_name IS NULL)", lambda v: _rel(search.outgoing(v("relations"), "p2", "src/n5.ts", "sym3")))
simple("c14_incoming", f"SELECT {REL} FROM relations WHERE dst_project = 'p1' AND dst_file_path = 'src/n7.ts'", lambda v: _rel(search.incoming(v("relations"), "p1", "src/n7.ts")))
simple("c14_by_type", f"SELECT {REL} FROM relations WHERE project = 'p0' AND type = 'extends'", lambda v: _rel(search.by_type(v("relations"), "p0", "extends")))
simple("c15_internal_relations", f"SELECT {REL} FROM relations WHERE project = 'p2' AND src_file_path = 'src/n5.ts' AND dst_file_path = 'src/n5.ts' ORDER BY id LIMIT 10000", lambda v: _rel(search.internal_relations(v("relations"), "p2", "src/n5.ts")))
simple("c16_symbols_by_file", f"SELECT {SYM} FROM symbols WHERE project = '{_PRJ}' AND file_path = '{_FILE}' ORDER BY name, id LIMIT 10000", lambda v: _sym(search.search_symbols(v("symbols"), project=_PRJ, file_path=_FILE, limit=10_000)))
simple("c17_module_interface", f"SELECT name, kind, CASE WHEN detail_json LIKE '{{\"ret%' THEN '(a: string, b?: unknown)' END AS parameters, CASE WHEN detail_json LIKE '{{\"ret%' THEN 'T' || CAST((end_line - start_line) % 5 AS STRING) END AS return_type FROM symbols WHERE project = 'small' AND file_path LIKE 'src/brand_1%' AND is_exported", lambda v: v("symbols").where("project = 'small' AND file_path LIKE 'src/brand_1%'").transform(lambda s: search.module_interface(s.withColumn("file_path", F.lit("f")), "small", "f")).select("name", "kind", "parameters", "return_type"))
simple("c18_full_symbol", "SELECT id, name, CASE WHEN detail_json LIKE '{\"ret%' THEN 'T' || CAST((end_line - start_line) % 5 AS STRING) END AS return_type FROM symbols WHERE project = 'economy' AND name = 'small_ring_0' AND file_path = 'src/brand_2/m0.ts' ORDER BY name, id LIMIT 1", lambda v: search.full_symbol(v("symbols"), "economy", "small_ring_0", "src/brand_2/m0.ts").select("id", "name", F.col("returnType").alias("return_type")))
simple("c19_search_annotations", f"SELECT id, tag, value FROM annotations WHERE source = 'line' AND tag = 'todo' AND {_fts_sql(_AC, 'value_1')}", lambda v: search.search_annotations(v("annotations"), text="value_1", tag="todo", source="line").select("id", "tag", "value"))
simple("c20_symbol_changes", "SELECT id, change_type, symbol_name FROM changelog WHERE changed_at >= '2024-01-05 00:00:00' AND change_type IN ('added', 'moved') AND id > 2000 AND NOT is_full_index ORDER BY id LIMIT 1000", lambda v: search.symbol_changes(v("changelog"), "2024-01-05 00:00:00", change_types=["added", "moved"], after_id=2000).select("id", "change_type", "symbol_name"))
_search_symbols("c21_search_all_symbols", _fts_sql(_SC, "small class"), text="small class")
simple("c21_search_all_relations", f"SELECT {REL} FROM relations WHERE is_external", lambda v: _rel(search.search_relations(v("relations"), is_external=True)))
simple("d1_fts_semi_join", f"SELECT {SYM} FROM symbols WHERE {_fts_sql(_SC, 'enum m1')}", lambda v: v("symbols").transform(lambda s: _sym(s).join(s.where(T.fts_match([F.col(c) for c in _SC], "enum m1")).select("id"), "id", "left_semi")))
simple("d2_decorators", "SELECT id, 'D' || CAST(id % 6 AS STRING) AS decorator FROM symbols WHERE detail_json LIKE '{\"ret%' UNION ALL SELECT id, 'E' || CAST((end_line - start_line) % 4 AS STRING) FROM symbols WHERE detail_json LIKE '{\"ret%'", lambda v: v("symbols").select("id", F.explode(search.detail_of(F.col("detail_json"))["decorators"]).alias("d")).select("id", F.col("d.name").alias("decorator")))
simple("e1_symbol_stats", "SELECT count(*) AS symbol_count, count(DISTINCT file_path) AS file_count FROM symbols WHERE project = 'small'", lambda v: search.symbol_stats(v("symbols"), "small"))
simple("e2_file_stats", """SELECT f.project, f.file_path, coalesce(s.n, 0) AS symbol_count, coalesce(s.x, 0) AS exported_symbol_count, coalesce(r.n, 0) AS relation_count, CAST(f.line_count AS BIGINT) AS line_count, f.size
    FROM (SELECT DISTINCT project, src_file_path AS file_path, 7 AS line_count, CAST(5 AS BIGINT) AS size FROM relations) f LEFT JOIN (SELECT 'p' || CAST(id % 3 AS STRING) AS project, 'src/n' || CAST(id % 45 AS STRING) || '.ts' AS file_path, count(*) AS n, CAST(sum(CAST(is_exported AS INT)) AS BIGINT) AS x FROM symbols GROUP BY 1, 2) s ON s.project = f.project AND s.file_path = f.file_path
    LEFT JOIN (SELECT project, src_file_path AS file_path, count(*) AS n FROM relations GROUP BY 1, 2) r ON r.project = f.project AND r.file_path = f.file_path""", lambda v: search.file_stats(v("relations").selectExpr("project", "src_file_path AS file_path", "7 AS line_count", "CAST(5 AS BIGINT) AS size").distinct(), v("symbols").selectExpr("'p' || CAST(id % 3 AS STRING) AS project", "'src/n' || CAST(id % 45 AS STRING) || '.ts' AS file_path", "is_exported"), v("relations")))
simple("e6_member_signature", "SELECT id, md5('x:method:T' || ',' || 'y' || CAST(id % 5 AS STRING) || ':property:U') AS signature FROM symbols WHERE detail_json LIKE '{\"ret%'", lambda v: v("symbols").select("id", search.detail_of(F.col("detail_json"))["members"].alias("m")).where("m is not null").select("id", F.md5(F.array_join(F.array_sort(F.transform("m", lambda m: F.concat_ws(":", m["name"], m["kind"], m["type"]))), ",").cast("binary")).alias("signature")))
simple("e7_line_count", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents", lambda v: v("documents_raw").select("doc_id", T.line_count(F.col("text")).cast("long").alias("lines")))
_search_symbols("g1_order_limit", "project = 'small'", limit=37, project="small")
simple("g2_limit_by_id", f"SELECT {REL} FROM relations WHERE type = 'calls' ORDER BY id LIMIT 25", lambda v: _rel(search.search_relations(v("relations"), type="calls", limit=25)))
simple("g3_keyset_page", "SELECT id, change_type FROM changelog WHERE changed_at >= '2024' AND id > 500 ORDER BY id LIMIT 40", lambda v: search.symbol_changes(v("changelog"), "2024", after_id=500, include_full_index=True, limit=40).select("id", "change_type"))
_search_symbols("g4_default_limits", "kind = 'class'", limit=1000, kind="class")
for _i, _q in enumerate(("part", "blue bolt", "m1.ts", "brand_1", "src/brand", "zzz", "widget_1")):
    _search_symbols(f"i{_i + 1}_fts_{T.re.sub('[^a-z0-9]+', '_', _q)}", _fts_sql(_SC, _q), text=_q)

# --- graphs ---------------------------------------------------------------------------------
_EDGES = "edges AS (SELECT DISTINCT src_file_path AS src, dst_file_path AS dst FROM relations WHERE type IN ('imports', 'type-references', 're-exports') AND dst_file_path IS NOT NULL)"
_graph = lambda v: graph.edges(v("relations"))
_seeds = lambda df, *n: df.sparkSession.createDataFrame([(x,) for x in n], "node string")


def _reach_sql(table: str, seeds: list[str], forward: bool) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    inside = ", ".join(f"'{s}'" for s in seeds)
    return f"WITH {_EDGES + ', ' if table == 'edges' else ''}reach AS (SELECT DISTINCT {b} AS node FROM {table} WHERE {a} IN ({inside}) UNION SELECT e.{b} FROM reach r JOIN {table} e ON e.{a} = r.node) SELECT node FROM reach /*recursive*/"


simple("j1_dependency_edges", f"WITH {_EDGES} SELECT src, dst FROM edges", _graph)
simple("j1_edges_of_project", "SELECT DISTINCT src_file_path AS src, dst_file_path AS dst FROM relations WHERE type IN ('imports', 'type-references', 're-exports') AND dst_file_path IS NOT NULL AND project = 'p1'", lambda v: graph.edges(v("relations"), ["p1"]))
simple("h0a_edge_union", f"WITH {_EDGES} SELECT count(*) AS n FROM edges", lambda v: _graph(v).agg(F.count(F.lit(1)).alias("n")))
_NOW = "now AS (SELECT DISTINCT src_file_path AS src, dst_file_path AS dst FROM relations WHERE type IN ('imports', 'type-references', 're-exports') AND dst_file_path IS NOT NULL AND id % 3 <> 0)"


@query("j2_patched_edges", f"WITH {_EDGES}, {_NOW} SELECT src, dst FROM edges WHERE src NOT IN ('src/n1.ts', 'src/n2.ts') AND dst NOT IN ('src/n1.ts', 'src/n2.ts') UNION SELECT src, dst FROM now WHERE src = 'src/n1.ts' OR dst = 'src/n1.ts'")
def _j2(v):
    r = v("relations")
    return graph.patched_edges(graph.edges(r), r.sparkSession.createDataFrame([("src/n1.ts", False), ("src/n2.ts", True)], "file_path string, deleted boolean"), r.where("id % 3 != 0"))


simple("j3_direct_dependencies", "SELECT id, dst_file_path FROM (SELECT * FROM relations WHERE project = 'p1' AND src_file_path = 'src/n4.ts' AND type = 'imports' ORDER BY id LIMIT 10000) WHERE dst_file_path IS NOT NULL", lambda v: graph.direct_dependencies(v("relations"), "p1", "src/n4.ts"))
simple("j4_direct_dependents", "SELECT id, src_file_path FROM relations WHERE project = 'p1' AND dst_file_path = 'src/n4.ts' AND type = 'imports' ORDER BY id LIMIT 10000", lambda v: graph.direct_dependents(v("relations"), "p1", "src/n4.ts"))
simple("j5_transitive_dependencies", _reach_sql("chain", ["o100", "o900", "o1400"], True), lambda v: graph.transitive_dependencies(v("chain"), _seeds(v("chain"), "o100", "o900", "o1400")))
simple("j6_transitive_dependents", _reach_sql("chain", ["o100", "o57", "o3"], False), lambda v: graph.transitive_dependents(v("chain"), _seeds(v("chain"), "o100", "o57", "o3")))
simple("j7_affected", _reach_sql("rings", ["s1", "s4"], False), lambda v: graph.affected(v("rings"), _seeds(v("rings"), "s1", "s4")))
simple("h0c_affected_files", _reach_sql("edges", ["src/n41.ts", "src/n50.ts"], False), lambda v: graph.affected(_graph(v), _seeds(v("relations"), "src/n41.ts", "src/n50.ts")))
simple("j5_all_pairs", "WITH reach AS (SELECT src, dst FROM chain UNION SELECT r.src, e.dst FROM reach r JOIN chain e ON e.src = r.dst) SELECT src, dst FROM reach /*recursive*/", lambda v: graph.closure(v("chain")))
_RING_REACH = "reach AS (SELECT src, dst FROM rings UNION SELECT r.src, e.dst FROM reach r JOIN rings e ON e.src = r.dst)"
simple("j8_has_cycle", f"WITH {_RING_REACH} SELECT count(*) > 0 AS cyclic FROM reach WHERE src = dst /*recursive*/", lambda v: v("rings").sparkSession.createDataFrame([(graph.has_cycle(v("rings")),)], "cyclic boolean"))
simple("j8_no_cycle", "WITH reach AS (SELECT src, dst FROM chain UNION SELECT r.src, e.dst FROM reach r JOIN chain e ON e.src = r.dst) SELECT count(*) > 0 AS cyclic FROM reach WHERE src = dst /*recursive*/", lambda v: v("chain").sparkSession.createDataFrame([(graph.has_cycle(v("chain")),)], "cyclic boolean"))
simple("j9_strong_components", f"WITH {_RING_REACH} SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src /*recursive*/", lambda v: graph.strong_components(v("rings")))
_CIRCUITS = """WITH paths AS (SELECT src AS start, dst AS last, [src] AS path FROM rings WHERE src <= dst UNION ALL SELECT p.start, e.dst, list_append(p.path, p.last) FROM paths p JOIN rings e ON e.src = p.last WHERE p.last <> p.start AND (e.dst = p.start OR (e.dst > p.start AND NOT list_contains(p.path, e.dst) AND e.dst <> p.last))),
    closed AS (SELECT path FROM paths WHERE last = start) SELECT DISTINCT list_min(list_transform(range(len(path)), lambda i: array_to_string(list_concat(path[i + 1 :], path[: i]), '::'))) AS cycle FROM closed /*recursive*/"""
simple("j10_circuits", _CIRCUITS, lambda v: graph.circuits(v("rings")).select(F.array_join("cycle", "::").alias("cycle")))
simple("g5_max_cycles", _CIRCUITS.replace(" /*recursive*/", " ORDER BY cycle LIMIT 5 /*recursive*/"), lambda v: graph.circuits(v("rings"), 5).select(F.array_join("cycle", "::").alias("cycle")))
simple("j12_import_graph", f"WITH {_EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE src = node), '') AS dependencies FROM n", lambda v: graph.import_graph(_graph(v)).select("node", F.array_join("dependencies", ",").alias("dependencies")))
simple("e3_fan_metrics", f"WITH {_EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS fan_in, (SELECT count(*) FROM edges WHERE src = node) AS fan_out FROM n", lambda v: graph.fan_metrics(_graph(v)))
_WANT = "SELECT DISTINCT 'sym' || CAST(id % 30 AS STRING) AS name, 'src/n' || CAST(id % 40 AS STRING) || '.ts' AS file_path FROM symbols"
simple("j13_resolve_symbol", f"""WITH want AS ({_WANT}),
    re AS (SELECT *, row_number() OVER (PARTITION BY src_file_path ORDER BY id) AS k FROM relations WHERE type = 're-exports' AND project = 'p1'),
    hop AS (SELECT f, n, df, dn FROM (
        SELECT src_file_path AS f, 'sym' || CAST(CAST(floor(id / 8.0) AS BIGINT) % 30 AS STRING) AS n, dst_file_path AS df, regexp_extract(meta_json, '"local":"([^"]*)"', 1) AS dn, id FROM re WHERE k <= 500)
        QUALIFY row_number() OVER (PARTITION BY f, n ORDER BY id) = 1),
    walk AS (SELECT name, file_path, name AS here, file_path AS inn, [file_path || '::' || name] AS seen, '' AS chain, false AS circular FROM want
        UNION ALL SELECT w.name, w.file_path, h.dn, h.df, list_append(w.seen, h.df || '::' || h.dn), w.chain || w.inn || '::' || w.here || ';', list_contains(w.seen, h.df || '::' || h.dn)
        FROM walk w JOIN hop h ON h.f = w.inn AND h.n = w.here WHERE NOT w.circular AND h.df IS NOT NULL)
    SELECT name, file_path, arg_max(here, len(seen)) AS original_name, arg_max(inn, len(seen)) AS original_file, max(len(seen)) - 1 AS hops, arg_max(chain, len(seen)) AS chain, bool_or(circular) AS circular FROM walk GROUP BY name, file_path /*recursive*/""", lambda v: graph.resolve_symbols(v("relations"), v("symbols").selectExpr("'sym' || CAST(id % 30 AS STRING) AS name", "'src/n' || CAST(id % 40 AS STRING) || '.ts' AS file_path").distinct(), "p1").withColumn("chain", F.array_join(F.transform("chain", lambda c: F.concat(c["file_path"], F.lit("::"), c["exported_as"], F.lit(";"))), "")))
_HER = "h AS (SELECT DISTINCT src_file_path || '::' || src_symbol_name AS src, dst_file_path || '::' || dst_symbol_name AS dst, type AS kind FROM relations WHERE type IN ('extends', 'implements') AND dst_file_path IS NOT NULL AND dst_symbol_name IS NOT NULL)"
simple("j14_heritage_edges", f"WITH {_HER}, reach AS (SELECT 'src/n5.ts::sym5' AS node UNION SELECT h.dst FROM reach r JOIN h ON h.src = r.node) SELECT src, dst, kind FROM h WHERE src IN (SELECT node FROM reach) /*recursive*/", lambda v: graph.heritage_edges(v("relations"), "sym5", "src/n5.ts").select("src", "dst", "kind"))

# --- diffs ----------------------------------------------------------------------------------
_LATEST = "b AS (SELECT * FROM before_snapshot QUALIFY row_number() OVER (PARTITION BY file_path, name ORDER BY id DESC) = 1), a AS (SELECT * FROM after_snapshot QUALIFY row_number() OVER (PARTITION BY file_path, name ORDER BY id DESC) = 1)"
_ADDED = "added AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file_path = a.file_path AND b.name = a.name))"
_REMOVED = "removed AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.file_path = a.file_path AND b.name = a.name))"
_snap = lambda v: (diff.latest_by_key(v("before_snapshot")), diff.latest_by_key(v("after_snapshot")))
simple("d3_added", f"WITH {_LATEST}, {_ADDED} SELECT id, file_path, name FROM added", lambda v: diff.added(*_snap(v)).select("id", "file_path", "name"))
simple("d3_removed", f"WITH {_LATEST}, {_REMOVED} SELECT id, file_path, name FROM removed", lambda v: diff.removed(*_snap(v)).select("id", "file_path", "name"))
simple("d4_modified", f"WITH {_LATEST} SELECT a.id, a.file_path, a.name FROM a JOIN b ON a.file_path = b.file_path AND a.name = b.name WHERE a.fingerprint IS DISTINCT FROM b.fingerprint OR a.is_exported <> b.is_exported OR coalesce(a.structural_fingerprint <> b.structural_fingerprint, false)", lambda v: diff.modified(*_snap(v)).select("id", "file_path", "name"))
simple("d5_diff_symbols", f"WITH {_LATEST} SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL OUTER JOIN b ON a.file_path = b.file_path AND a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.fingerprint IS DISTINCT FROM b.fingerprint", lambda v: diff.diff_symbols(*_snap(v)))
_RK = "type, src_file_path, src_symbol_name, dst_file_path, dst_symbol_name, md5(coalesce(meta_json, '')) AS meta_hash"
simple("d6_relation_diff", f"SELECT *, 'added' AS change FROM (SELECT {_RK} FROM relations WHERE id % 5 <> 0 EXCEPT SELECT {_RK} FROM relations WHERE id % 7 <> 0) UNION ALL SELECT *, 'removed' AS change FROM (SELECT {_RK} FROM relations WHERE id % 7 <> 0 EXCEPT SELECT {_RK} FROM relations WHERE id % 5 <> 0)", lambda v: diff.relation_diff(v("relations").where("id % 7 != 0"), v("relations").where("id % 5 != 0")))
_GROUP = "file_path, kind, structural_fingerprint"
_ONE = f"pairs AS (SELECT {_GROUP}, min(r.name) AS old_name, min(n.name) AS new_name FROM removed r JOIN added n USING ({_GROUP}) GROUP BY ALL HAVING count(*) = 1)"
query("d7_renames")(lambda v: (lambda b, a: diff.renames(diff.added(b, a), diff.removed(b, a)))(*_snap(v)))
simple("d7_single_renames", f"WITH {_LATEST}, {_ADDED}, {_REMOVED}, {_ONE} SELECT file_path, kind, old_name, new_name FROM pairs", lambda v: (lambda b, a: (lambda n, r: diff.renames(n.join(n.groupBy("file_path", "kind", "structural_fingerprint").count().where("count = 1"), ["file_path", "kind", "structural_fingerprint"], "left_semi"), r.join(r.groupBy("file_path", "kind", "structural_fingerprint").count().where("count = 1"), ["file_path", "kind", "structural_fingerprint"], "left_semi")))(diff.added(b, a), diff.removed(b, a)))(*_snap(v)))
simple("d8_member_renames", f"WITH {_LATEST}, {_ADDED}, {_REMOVED} SELECT r.file_path, r.kind, r.name AS old_name, n.name AS new_name FROM removed r JOIN added n ON r.file_path = n.file_path AND instr(r.name, '.') > 0 AND instr(n.name, '.') > 0 AND substr(n.name, instr(n.name, '.')) = substr(r.name, instr(r.name, '.')) AND substr(n.name, 1, instr(n.name, '.')) = 'new_' || substr(r.name, 1, instr(r.name, '.'))", lambda v: (lambda b, a: (lambda n, r: diff.member_renames(r.where("name LIKE '%.%'").selectExpr("file_path", "substring_index(name, '.', 1) AS old_name", "'new_' || substring_index(name, '.', 1) AS new_name").distinct(), n, r))(diff.added(b, a), diff.removed(b, a)))(*_snap(v)))
simple("d9_moves", f"WITH {_LATEST}, {_REMOVED}, one AS (SELECT project, fingerprint, min(file_path) AS new_file, min(name) AS new_name FROM a GROUP BY 1, 2 HAVING count(*) = 1) SELECT r.project, r.name, r.kind, r.file_path AS old_file, one.new_file, one.new_name, r.fingerprint FROM removed r JOIN one ON one.project = r.project AND one.fingerprint = r.fingerprint WHERE r.file_path <> one.new_file", lambda v: (lambda b, a: diff.moves(diff.removed(b, a), a))(*_snap(v)))
query("n8_change_rows")(lambda v: diff.change_rows(v("before_snapshot"), v("after_snapshot"), "run-1", "2024-01-01T00:00:00.000Z", False))

# --- places ---------------------------------------------------------------------------------
simple("d13_next_declaration", "SELECT c.id, (SELECT arg_min(d.name, (d.start_line, d.name)) FROM declarations d WHERE d.file_path = c.file_path AND d.start_line > c.line AND d.start_line - c.line <= 3) AS symbol_name FROM comments c", lambda v: places.next_declaration(v("comments").select("id", "file_path", "line"), v("declarations")))
simple("d14_latest_comment", """WITH rows AS (SELECT file_path, start_line AS place, 1 AS side, id FROM declarations UNION ALL SELECT file_path, line, 0, id FROM comments),
    w AS (SELECT *, lag(side) OVER o AS ps, lag(id) OVER o AS pid FROM rows WINDOW o AS (PARTITION BY file_path ORDER BY place, side, id)) SELECT id, CASE WHEN ps = 0 THEN pid ELSE -1 END AS comment_id FROM w WHERE side = 1""", lambda v: places.latest_comment(v("declarations"), v("comments").select("id", "file_path", "line")).select("id", F.coalesce("comment_id", F.lit(-1)).alias("comment_id")))
simple("d15_innermost_node", "SELECT o.id, arg_min(n.id, (n.end_at - n.start_at, n.id)) AS node_id FROM offsets o JOIN nodes n ON o.file_id = n.file_id AND n.start_at <= o.at AND o.at < n.end_at GROUP BY o.id", lambda v: places.innermost_node(v("offsets"), v("nodes")))
simple("d15_node_at_span", "SELECT a.id, max(b.id) AS node_id FROM nodes a JOIN nodes b USING (file_id, start_at, end_at) GROUP BY a.id", lambda v: places.node_at_span(v("nodes"), v("nodes")))
# Fixed value: what counts as a tag.
_TAG = r"(?:^|\s)@([a-zA-Z][\w-]*\w|[a-zA-Z])\s*(.*)$"
simple("l20_comment_tags", f"SELECT id, regexp_extract(text, '(?m){_TAG}', 1) AS tag, regexp_extract(text, '(?m){_TAG}', 2) AS value FROM comments WHERE regexp_matches(text, '(?m){_TAG}')", lambda v: places.comment_tags(v("comments")))
simple("l10_member_rows", "SELECT id, name || '.x' AS name FROM symbols WHERE detail_json LIKE '{\"ret%' UNION ALL SELECT id, name || '.y' || CAST(id % 5 AS STRING) FROM symbols WHERE detail_json LIKE '{\"ret%'", lambda v: v("symbols").select("id", "name", F.explode(search.detail_of(F.col("detail_json"))["members"]).alias("m")).select("id", F.concat_ws(".", "name", "m.name").alias("name")))
simple("d12_resolve_imports", """WITH f AS (SELECT DISTINCT src_file_path AS p FROM relations) SELECT id, (SELECT min(p) FROM f WHERE NOT is_external AND p = 'src/' || substr(specifier, 3) || '.ts') AS dst_file_path, is_external AND specifier LIKE 'pkg%' AS is_external,
    NOT is_external AND NOT EXISTS (SELECT 1 FROM f WHERE p = 'src/' || substr(specifier, 3) || '.ts') AS is_unresolved FROM relations""", lambda v: imports.resolve_imports(v("relations").select("id", "src_file_path", "specifier"), v("relations").select(F.col("src_file_path").alias("file_path"))).select("id", "dst_file_path", "is_external", "is_unresolved"))
_ENDS = "['.ts', '.d.ts', '/index.ts', '/index.d.ts', '.mts', '/index.mts', '.cts', '/index.cts']"
simple("k16_candidates", f"SELECT id, i AS place, 'src/' || substr(specifier, 3) || {_ENDS}[i + 1] AS candidate FROM relations, range(8) u(i) WHERE NOT is_external", lambda v: v("relations").select("id", F.posexplode(imports.candidates(F.col("src_file_path"), F.col("specifier"))).alias("place", "candidate")).withColumn("place", F.col("place").cast("long")))
# Files of every ending stand beside each other, so that the order of candidates decides.
_CLASH = f"clash AS (SELECT DISTINCT 'src/n' || CAST(id % 60 AS STRING) || {_ENDS}[1 + CAST((id * 5 + CAST(floor(id / 60.0) AS BIGINT)) % 8 AS BIGINT)] AS p FROM symbols WHERE id % 3 <> 0)"
simple("d12_candidate_order", f"WITH {_CLASH} SELECT r.id, arg_min(p, i) AS dst_file_path FROM relations r LEFT JOIN (SELECT p, i, e FROM clash, (SELECT i, {_ENDS}[i + 1] AS e FROM range(8) u(i))) c ON c.p = 'src/' || substr(r.specifier, 3) || c.e WHERE NOT r.is_external GROUP BY r.id", lambda v: imports.resolve_imports(v("relations").where("NOT is_external").select("id", "src_file_path", "specifier"), v("symbols").where("id % 3 <> 0").select(F.concat(F.lit("src/n"), (F.col("id") % 60).cast("string"), F.element_at(F.array(*[F.lit(e) for e in imports.ENDINGS]), (1 + (F.col("id") * 5 + F.floor(F.col("id") / 60)) % 8).cast("int"))).alias("file_path"))).select("id", "dst_file_path"))
simple("a7_path_aliases", """WITH f AS (SELECT DISTINCT src_file_path AS p FROM relations) SELECT id, 'pkg/n' || CAST(id % 70 AS STRING) AS specifier, p AS dst_file_path, false AS is_unresolved, p IS NULL AS is_external
    FROM relations LEFT JOIN f ON p = 'src/n' || CAST(id % 70 AS STRING) || '.ts'""", lambda v: imports.resolve_imports(v("relations").selectExpr("id", "src_file_path", "'pkg/n' || CAST(id % 70 AS STRING) AS specifier"), v("relations").select(F.col("src_file_path").alias("file_path")), [("pkg/x*", ["none/*"]), ("pkg/*", ["lib/*", "./src/*"]), ("*", ["other/*"])]).select("id", "specifier", "dst_file_path", "is_unresolved", "is_external"))
simple("k17_bare_specifier", "SELECT id, NOT (specifier LIKE '.%' OR specifier LIKE '/%') AS bare FROM relations", lambda v: v("relations").select("id", imports.is_bare(F.col("specifier")).alias("bare")))
_AT = "CAST(floor(length(text) / 2.0) AS INT)"
simple("k3_line_column", f"SELECT doc_id, CAST(len(string_split(substr(text, 1, {_AT}), chr(10))) AS BIGINT) AS line, CAST(length(string_split(substr(text, 1, {_AT}), chr(10))[-1]) AS BIGINT) AS col FROM documents", lambda v: v("documents_raw").withColumn("at", F.floor(F.length("text") / 2).cast("int")).select("doc_id", T.line_of(F.col("text"), F.col("at")).cast("long").alias("line"), T.column_of(F.col("text"), F.col("at")).cast("long").alias("col")))
simple("k4_line_column_to_position", r"""WITH t AS (SELECT doc_id, replace(replace(text, chr(8232), chr(10)), chr(8233), chr(10)) AS text, 1 + doc_id % 7 AS line, doc_id % 50 AS col FROM documents),
    l AS (SELECT *, regexp_extract_all(text, '[^\r\n]*(?:\r\n|\r|\n)') AS ended FROM t),
    m AS (SELECT *, len(ended) + 1 AS n, coalesce(list_sum([length(x) FOR x IN ended[1 : line - 1]]), 0) AS p0, coalesce(list_sum([length(x) FOR x IN ended]), 0) AS whole FROM l)
    SELECT doc_id, CAST(CASE WHEN line < n AND col < length(ended[line]) OR line = n AND col <= length(text) - whole THEN p0 + col ELSE -1 END AS BIGINT) AS position FROM m""", lambda v: v("documents_raw").select("doc_id", F.coalesce(T.line_column_to_position(F.col("text"), (1 + F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 50).cast("int")), F.lit(-1)).cast("long").alias("position")))
simple("k4_find_name_position", r"""SELECT doc_id, CASE WHEN regexp_matches(rest, '(^|[^A-Za-z0-9_$])la([^A-Za-z0-9_$]|$)') THEN p0 + length(regexp_extract(rest, '^((?s:.)*?(?:^|[^A-Za-z0-9_$]))la(?:[^A-Za-z0-9_$]|$)', 1)) ELSE -1 END AS position
    FROM (SELECT doc_id, p0, CASE WHEN p0 > 0 AND regexp_matches(substr(text, p0, 2), '^[A-Za-z0-9_$]{2}') THEN '_' || substr(text, p0 + 2) ELSE substr(text, p0 + 1) END AS rest FROM (SELECT doc_id, text, CAST(doc_id % 30 AS INT) AS p0 FROM documents))""", lambda v: v("documents_raw").select("doc_id", F.coalesce(T.find_name_position(F.col("text"), (F.col("doc_id") % 30).cast("int"), F.lit("la")), F.lit(-1)).cast("long").alias("position")))
simple("k2_normalize_path", "SELECT id, replace(replace(file_path, '/', chr(92)), chr(92), '/') AS path FROM symbols", lambda v: v("symbols").select("id", T.normalize_path(F.replace("file_path", F.lit("/"), F.lit("\\"))).alias("path")))
simple("k7_fingerprint", "SELECT id, fingerprint FROM symbols", lambda v: v("symbols").select("id", T.fingerprint_of(F.col("name"), F.col("kind"), F.col("signature")).alias("fingerprint")))
simple("k6_signature", "SELECT id, CASE WHEN kind IN ('function', 'method') THEN 'params:2|async:' || CASE WHEN id % 2 = 1 THEN '1' ELSE '0' END END AS signature FROM symbols WHERE detail_json LIKE '{\"ret%'", lambda v: v("symbols").where("detail_json LIKE '{\"ret%'").select("id", T.signature_of(F.col("kind"), search.detail_of(F.col("detail_json"))["parameters"], F.col("id") % 2 == 1).alias("signature")))
simple("k10_json_access", "SELECT id, json_extract_string(props, '$.k') AS k FROM (SELECT event_id AS id, props FROM events)", lambda v: v("events_raw").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k")))
simple("k11_glob", "SELECT id FROM symbols WHERE regexp_matches(file_path, '^src/(?:brand_1|brand_2)/m[^/]\\.ts$')", lambda v: v("symbols").where(T.glob_match(F.col("file_path"), "src/{brand_1,brand_2}/m?.ts")).select("id"))
simple("n10_lease_role", "SELECT id, CASE WHEN pid IS NULL OR NOT alive OR age_s >= 60 OR (pid = own_pid AND instance_id <> own_instance) THEN 'owner' ELSE 'reader' END AS role FROM leases", lambda v: v("leases").select("id", projects.lease_role(F.col("pid"), F.col("alive"), F.col("age_s"), F.col("instance_id"), F.col("own_pid"), F.col("own_instance")).alias("role")))
simple("k8_structural_fingerprint", """SELECT id, md5(kind || '|' || CASE WHEN id % 2 = 0 THEN 'async,export' ELSE 'export' END || '|' || 'A' || CAST(id % 3 AS STRING) || ',B|' || CAST(id % 4 AS STRING) || '|' || coalesce(resolved_type, '') || '|') AS fingerprint FROM symbols""", lambda v: v("symbols").select("id", T.structural_fingerprint_of(F.col("kind"), F.when(F.col("id") % 2 == 0, F.array(F.lit("export"), F.lit("async"))).otherwise(F.array(F.lit("export"))), F.array(F.lit("B"), F.concat(F.lit("A"), (F.col("id") % 3).cast("string"))), (F.col("id") % 4).cast("int"), F.col("resolved_type"), F.lit(None).cast("array<string>")).alias("fingerprint")))
simple("k18_metavariables", r"SELECT event_id AS id, upper(event_type) || ',ARGS,X_1' AS names FROM events", lambda v: v("events_raw").select(F.col("event_id").alias("id"), F.array_join(T.metavariables(F.concat(F.lit("f($"), F.upper("event_type"), F.lit(", $$$ARGS, a$b, $X_1)"))), ",").alias("names")))
_OPS = "['=', '+=', '??=', '++', '>>>=', '&&=', '==', '--', '+']"
simple("m2_write_kind", f"SELECT id, CASE WHEN d THEN 'declaration' WHEN op = '=' THEN 'assignment' WHEN op IN ('+=', '>>>=') THEN 'compound' WHEN op IN ('??=', '&&=') THEN 'logical' WHEN op IN ('++', '--') THEN 'update' END AS write_kind FROM (SELECT event_id AS id, event_id % 10 = 0 AS d, {_OPS}[1 + event_id % 9] AS op FROM events)", lambda v: v("events_raw").select(F.col("event_id").alias("id"), bindings.write_kind(F.element_at(F.array(*[F.lit(o) for o in ("=", "+=", "??=", "++", ">>>=", "&&=", "==", "--", "+")]), (1 + F.col("event_id") % 9).cast("int")), F.col("event_id") % 10 == 0).alias("write_kind")))
