"""The facade: a project tree indexed into versioned tables, and every query over them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.errors import LoomError
from codeloom.extract.source import Source, parse_jsdoc
from codeloom.functions import text
from codeloom.operators import bindings, diff, graph, indexing, patterns, search, types
from codeloom.sources import projects, tables
from codeloom.sources.config import load_aliases
from codeloom.streaming.lease import Lease

RETENTION_DAYS = 30
UNSET = search.UNSET


class Loom:
    """Open with ``Loom.open``; all query methods give DataFrames unless they answer yes or no.

    Every change writes new versions of the tables it touches and one manifest, so readers
    never see half a run. Only an owner may index; a second session is a reader.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, role: str = "owner"):
        self.spark, self.root, self.role = spark, root.rstrip("/"), role
        self.store = tables.TableStore(spark, folder)
        self.closed, self.lease = False, None
        self._graphs: dict[str, DataFrame] = {}
        self._memory: dict[str, str] = {}
        self._listeners: dict[str, list[Callable]] = {"indexed": [], "changed": [], "error": [], "role": []}

    @classmethod
    def open(cls, spark: SparkSession, root: str, folder: str | None = None, index: bool = True, role: str = "owner") -> Loom:
        if not root.startswith(("/", "file:", "hdfs:", "s3")):
            raise LoomError("validation", "the root must be an absolute path")
        self = cls(spark, root, folder or f"{root.rstrip('/')}/.codeloom", role)
        if role == "owner" and "://" not in self.store.folder.removeprefix("file://"):
            self.lease = Lease(self.store.folder.removeprefix("file://"))
            self.role = self.lease.acquire()
        if index and self.role == "owner":
            self.reindex()
        return self

    def poll(self) -> str:
        """Renews an owner's lease, or tries for one that is free; gives the role and tells ``role`` where it changed.

        To be called every HEARTBEAT_S by owners and every POLL_S by readers. A run looks first, too.
        """
        if self.lease is not None and not self.closed:
            role = "owner" if self.lease.heartbeat() or self.role == "reader" and self.lease.acquire() == "owner" else "reader"
            if role != self.role:
                self.role = role
                self._tell("role", role)
        return self.role

    def close(self, cleanup: bool = False) -> None:
        if not self.closed and self.lease is not None:
            self.lease.release()
        if not self.closed and cleanup:
            self.store.drop()
        self.closed = True
        self._graphs.clear()

    # --- tables ---------------------------------------------------------------------------------
    def _table(self, name: str) -> DataFrame:
        if self.closed:
            raise LoomError("closed", "this engine is closed")
        return self.store.read(name, getattr(schema, name.upper()))

    files = property(lambda self: self._table("files"))
    symbols = property(lambda self: self._table("symbols"))
    relations = property(lambda self: self._table("relations"))
    annotations = property(lambda self: self._table("annotations"))
    changelog = property(lambda self: self._table("changelog"))

    @property
    def projects(self) -> list[tuple[str, str]]:
        found = [(r.dir, r.project) for r in projects.discover_projects(self.spark, self.root).collect()]
        return found or [(".", self.default_project)]

    @property
    def default_project(self) -> str:
        return self.root.rsplit("/", 1)[-1]

    def on(self, event: str, callback: Callable) -> Callable[[], None]:
        """``indexed``, ``changed``, ``error`` or ``role``; gives what undoes it. A callback's own failure is swallowed."""
        self._listeners[event].append(callback)
        return lambda: self._listeners[event].remove(callback)

    def _tell(self, event: str, value) -> None:
        for f in list(self._listeners[event]):
            try:
                f(value)
            except Exception:  # noqa: S110, BLE001
                pass

    # --- indexing -------------------------------------------------------------------------------
    def _scan(self, paths: list[str] | None = None) -> DataFrame:
        """All files, or those of ``paths``, with what is held in memory before what is stored."""
        bounds = self.spark.createDataFrame(self.projects, "dir string, project string")
        scan = projects.scan_files(self.spark, self.root) if paths is None else projects.read_files(self.spark, self.root, paths)
        memory = [(p, t) for p, t in self._memory.items() if paths is None or p in paths]
        if memory:
            held = self.spark.createDataFrame(memory, "file_path string, content string")
            held = held.select("file_path", F.lit(0.0).alias("mtime_ms"), F.length("content").cast("long").alias("size"), "content")
            scan = scan.join(held.select("file_path"), "file_path", "left_anti").select(*scan.columns).unionByName(held)
        return projects.file_projects(scan, bounds, self.default_project).withColumn("content_hash", indexing.content_hash("content"))

    def reindex(self) -> dict:
        """Indexes what changed since the last run; the result counts this run's rows."""
        return self._apply(None)

    def apply_events(self, events: list[tuple[str, str]]) -> dict:
        """Events (create, change or delete; path): those files are read again without a look at their hash."""
        return self._apply({path: kind for kind, path in events})

    def _apply(self, events: dict[str, str] | None) -> dict:
        if self.closed or self.poll() != "owner":
            raise LoomError("closed", "only an open owner may index")
        began, now, run = time.time(), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z"), uuid.uuid4().hex
        scan = tables.cut(self._scan(None if events is None else [p for p, k in events.items() if k != "delete"]), "scan")
        files, symbols, relations, annotations, log = self.files, self.symbols, self.relations, self.annotations, self.changelog
        if events is None:
            status = tables.cut(projects.detect_changes(scan, files), "status")
        else:
            hit = self.spark.createDataFrame([(p, "deleted" if k == "delete" else "changed") for p, k in events.items()] or [("", "")], "file_path string, status string")
            known = files.select("project", "file_path").unionByName(scan.select("project", "file_path")).distinct()
            status = tables.cut(known.join(hit, "file_path").select("project", "file_path", "status"), "status")
        touched = status.where("status != 'unchanged'").select("project", "file_path")
        changed = tables.cut(scan.join(status.where("status = 'changed'").select("project", "file_path"), ["project", "file_path"], "left_semi"), "changed")
        parsed = tables.cut(indexing.parse_files(changed), "parsed")
        bounds = self.spark.createDataFrame(self.projects, "dir string, project string")
        gone = status.where("status = 'deleted'").select("project", "file_path")
        rows = changed.select("project", "file_path", "mtime_ms", "size", "content_hash", F.lit(now).alias("updated_at"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("line_count"))
        new_files = tables.replace_of_files(files, touched, rows)
        next_id = lambda t: (t.agg(F.max("id")).first()[0] or 0) + 1
        new_symbols = tables.cut(indexing.symbols_of(parsed, rows, now, next_id(symbols)), "symbols")
        new_relations = tables.cut(indexing.relations_of(parsed, new_files.select("file_path"), bounds, next_id(relations), load_aliases(self.spark, self.root)), "relations")
        new_annotations = tables.cut(indexing.annotations_of(parsed, now, next_id(annotations)), "annotations")
        kept = tables.cascade_delete(files, symbols, relations, annotations, gone)
        merged = {
            "files": new_files,
            "symbols": tables.replace_of_files(kept["symbols"], touched, new_symbols),
            "relations": tables.replace_of_files(kept["relations"], touched, new_relations, "src_file_path"),
            "annotations": tables.replace_of_files(kept["annotations"], touched, new_annotations),
        }
        before = tables.cut(symbols.join(touched, ["project", "file_path"], "left_semi").select(*symbols.columns), "before")
        changes = tables.cut(diff.change_rows(before, new_symbols, run, now, events is None, next_id(log), events is not None, merged["symbols"]), "changes")
        moved = changes.where("change_type = 'moved'").select(F.col("project").alias("dst_project"), F.col("old_file_path").alias("old_file"), F.col("symbol_name").alias("old_symbol"), F.col("file_path").alias("new_file"), F.col("symbol_name").alias("new_symbol"), F.lit(None).cast("string").alias("new_project"))
        merged["relations"] = tables.retarget(merged["relations"], moved)
        oldest = (datetime.now(UTC) - timedelta(days=RETENTION_DAYS)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        merged["changelog"] = tables.pruned(log, oldest).unionByName(changes.select(*log.columns))
        self.store.commit(merged)
        self._graphs.clear()
        counts = {r.change_type: r["count"] for r in changes.groupBy("change_type").count().collect()}
        failed = [r.file_path for r in parsed.where("error is not null").select("file_path").collect()]
        result = {"indexed_files": changed.count(), "removed_files": gone.count(), "symbols": new_symbols.count(), "relations": new_relations.count(), "annotations": new_annotations.count(), "failed_files": failed, "changes": counts, "run_id": run, "duration_ms": int(1000 * (time.time() - began))}
        self._tell("indexed", result)
        for path in failed:
            self._tell("error", LoomError("parse", path))
        return result

    def notify_file_changed(self, path: str, content: str) -> dict | None:
        """A source held in memory; the same content again does nothing."""
        if self._memory.get(path) == content:
            return None
        self._memory[path] = content
        self._tell("changed", ("change", path))
        return self.apply_events([("change", path)])

    def notify_file_deleted(self, path: str) -> dict:
        self._memory.pop(path, None)
        self._tell("changed", ("delete", path))
        return self.apply_events([("delete", path)])

    # --- parsing --------------------------------------------------------------------------------
    @staticmethod
    def parse_source(path: str, text: str) -> Source:
        return Source(path, text)

    def batch_parse(self, paths: list[str]) -> DataFrame:
        return indexing.parse_files(self._scan().where(F.col("file_path").isin(paths)))

    extract_symbols = staticmethod(lambda path, text: indexing.symbol_rows(Source(path, text)))
    extract_relations = staticmethod(lambda path, text: indexing.relation_rows(Source(path, text)))
    parse_jsdoc = staticmethod(parse_jsdoc)

    # --- queries --------------------------------------------------------------------------------
    def _project(self, project) -> str:
        return self.default_project if project in (None, UNSET) else project

    def stats(self, project: str | None = None) -> DataFrame:
        return search.symbol_stats(self.symbols, self._project(project))

    def search_symbols(self, project=UNSET, **query) -> DataFrame:
        return search.search_symbols(self.symbols, project=self._project(project), **query)

    def search_all_symbols(self, **query) -> DataFrame:
        return search.search_symbols(self.symbols, **query)

    def search_relations(self, project=UNSET, **query) -> DataFrame:
        return search.search_relations(self.relations, project=self._project(project), **query)

    def search_all_relations(self, **query) -> DataFrame:
        return search.search_relations(self.relations, **query)

    def search_annotations(self, project: str | None = None, **query) -> DataFrame:
        return search.search_annotations(self.annotations, project=self._project(project), **query)

    def list_indexed_files(self, project: str | None = None) -> DataFrame:
        return self.files.where(F.col("project") == self._project(project))

    def file_info(self, path: str, project: str | None = None) -> DataFrame:
        return self.list_indexed_files(project).where(F.col("file_path") == path)

    def file_stats(self, path: str, project: str | None = None) -> DataFrame:
        info = self.file_info(path, project)
        if info.isEmpty():
            raise LoomError("search", f"{path} isn't indexed")
        return search.file_stats(info, self.symbols, self.relations, self._project(project))

    def symbols_by_file(self, path: str, project: str | None = None) -> DataFrame:
        return search.search_symbols(self.symbols, project=self._project(project), file_path=path, limit=10_000)

    def internal_relations(self, path: str, project: str | None = None) -> DataFrame:
        return search.internal_relations(self.relations, self._project(project), path)

    def module_interface(self, path: str, project: str | None = None) -> DataFrame:
        return search.module_interface(self.symbols, self._project(project), path)

    def full_symbol(self, name: str, path: str, project: str | None = None) -> DataFrame:
        return search.full_symbol(self.symbols, self._project(project), name, path)

    def symbol_changes(self, since: str, **options) -> DataFrame:
        return search.symbol_changes(self.changelog, since, **options)

    def prune_changelog(self, before: str) -> int:
        log = self.changelog
        kept = tables.cut(tables.pruned(log, before), "log")
        n = log.count() - kept.count()
        self.store.commit({"changelog": kept})
        return n

    # --- graph ----------------------------------------------------------------------------------
    def _graph(self, project: str | None = None) -> DataFrame:
        key = project or "*"
        if key not in self._graphs:
            self._graphs[key] = tables.cut(graph.edges(self.relations, [project] if project else None), "edges")
        return self._graphs[key]

    def _nodes(self, *paths: str) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "node string")

    def dependencies(self, path: str, project: str | None = None, limit: int = 10_000) -> DataFrame:
        return graph.direct_dependencies(self.relations, self._project(project), path, limit)

    def dependents(self, path: str, project: str | None = None, limit: int = 10_000) -> DataFrame:
        return graph.direct_dependents(self.relations, self._project(project), path, limit)

    def transitive_dependencies(self, path: str, project: str | None = None) -> DataFrame:
        return graph.transitive_dependencies(self._graph(project), self._nodes(path))

    def transitive_dependents(self, path: str, project: str | None = None) -> DataFrame:
        return graph.transitive_dependents(self._graph(project), self._nodes(path))

    def affected(self, paths: list[str], project: str | None = None) -> DataFrame:
        return graph.affected(self._graph(project), self._nodes(*paths))

    def has_cycle(self, project: str | None = None) -> bool:
        return graph.has_cycle(self._graph(project))

    def cycle_paths(self, project: str | None = None, max_cycles: int | None = None) -> DataFrame:
        return graph.circuits(self._graph(project), max_cycles)

    def import_graph(self, project: str | None = None) -> DataFrame:
        return graph.import_graph(self._graph(project))

    def fan_metrics(self, path: str | None = None, project: str | None = None) -> DataFrame:
        out = graph.fan_metrics(self._graph(project))
        return out if path is None else out.where(F.col("node") == path)

    def resolve_symbol(self, name: str, path: str, project: str | None = None) -> DataFrame:
        """The origin of an exported name; through re-exports of ``project`` alone, or of all projects."""
        return graph.resolve_symbols(self.relations, self.spark.createDataFrame([(name, path)], "name string, file_path string"), project)

    def heritage_chain(self, name: str, path: str) -> dict:
        """The tree above a symbol; one that comes again is a leaf."""
        edges = graph.heritage_edges(self.relations, name, path).orderBy("src", "kind", "dst").collect()
        below: dict[str, list] = {}
        for e in edges:
            below.setdefault(e.src, []).append((e.dst, e.kind))
        seen: set[str] = set()

        def node(key: str, kind: str | None) -> dict:
            file, _, symbol = key.partition("::")
            fresh = key not in seen
            seen.add(key)
            return {"symbol": symbol, "file": file, "kind": kind, "children": [node(k, how) for k, how in below.get(key, [])] if fresh else []}

        return node(f"{path}::{name}", None)

    def base_types(self, name: str, path: str) -> DataFrame:
        return self.relations.where((F.col("src_file_path") == path) & (F.col("src_symbol_name") == name) & F.col("type").isin("extends", "implements")).select("type", "dst_file_path", "dst_symbol_name")

    def implementations(self, name: str, path: str) -> DataFrame:
        """file, symbol of all that extends or implements a symbol, directly or not."""
        key = lambda s: F.concat_ws("::", f"{s}_file_path", f"{s}_symbol_name")
        up = self.relations.where(F.col("type").isin("extends", "implements") & F.col("dst_file_path").isNotNull()).select(key("src").alias("src"), key("dst").alias("dst")).distinct()
        found = graph.transitive_dependents(up, self._nodes(f"{path}::{name}"))
        return found.select(F.substring_index("node", "::", 1).alias("file_path"), F.substring_index("node", "::", -1).alias("name"))

    def symbol_node(self, name: str, path: str) -> DataFrame:
        """A symbol and its members."""
        return self.symbols.where((F.col("file_path") == path) & ((F.col("name") == name) | F.startswith("name", F.lit(name + "."))))

    def semantic_module_interface(self, path: str) -> DataFrame:
        """Exports of a module, those of its re-exports among them: name, origin_name, origin_file."""
        own = self.symbols.where((F.col("file_path") == path) & F.col("is_exported") & (F.instr("name", ".") == 0)).select("name", F.col("name").alias("origin_name"), F.col("file_path").alias("origin_file"))
        meta = F.from_json("meta_json", schema.META)
        named = self.relations.where((F.col("src_file_path") == path) & (F.col("type") == "re-exports")).select(F.explode(meta["specifiers"]["exported"]).alias("name"), F.lit(path).alias("file_path")).distinct()
        origins = graph.resolve_symbols(self.relations, named).select("name", F.col("original_name").alias("origin_name"), F.col("original_file").alias("origin_file"))
        stars = self.relations.where((F.col("src_file_path") == path) & (F.col("type") == "re-exports") & (F.col("dst_symbol_name") == "*") & F.col("dst_file_path").isNotNull()).select(F.col("dst_file_path").alias("file_path"))
        all_of = self.symbols.join(stars.distinct(), "file_path", "left_semi").where(F.col("is_exported") & (F.instr("name", ".") == 0)).select("name", F.col("name").alias("origin_name"), F.col("file_path").alias("origin_file"))
        return own.unionByName(origins).unionByName(all_of).distinct()

    @staticmethod
    def diff_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
        return diff.diff_symbols(before, after)

    def file_bindings(self, paths: list[str]) -> DataFrame:
        """Every binding of the files with its references: bindings.SCHEMA."""
        return bindings.file_bindings(self._scan().where(F.col("file_path").isin(paths)))

    def find_pattern(self, pattern: str, paths: list[str] | None = None) -> DataFrame:
        scan = self._scan()
        return patterns.find_pattern(scan if paths is None else scan.where(F.col("file_path").isin(paths)), pattern)

    # --- positions ------------------------------------------------------------------------------
    def line_column_to_position(self, path: str, line: int, column: int) -> int | None:
        """0-based offset in a file of a 1-based line and 0-based column; None for a place or a file that isn't there."""
        at = self._scan([path]).select(text.line_column_to_position(F.col("content"), F.lit(line), F.lit(column))).first()
        return at[0] if at else None

    def find_name_position(self, path: str, start: int, name: str) -> int | None:
        """0-based offset of the first whole word ``name`` at or after ``start``."""
        at = self._scan([path]).select(text.find_name_position(F.col("content"), F.lit(start), F.lit(name))).first()
        return at[0] if at else None

    # --- types ----------------------------------------------------------------------------------
    def file_types(self, path: str) -> DataFrame:
        """name, type of the declarations of a file, as far as they are declared or literal."""
        return types.file_types(self.symbols.where(F.col("file_path") == path))

    def is_assignable(self, source: tuple[str, str], target: tuple[str, str]) -> bool:
        """Whether a symbol (file, name) extends or implements another, or has all that the other's members ask for."""
        if types.nominally_assignable(self.relations, source, target):
            return True
        alike = types.structurally_assignable(self.symbols.where(F.col("file_path").isin(source[0], target[0])), *target)
        return not alike.where((F.col("file_path") == source[0]) & (F.col("name") == source[1])).isEmpty()
