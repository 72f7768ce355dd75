"""A project tree indexed, changed and asked; and the pieces in front of it."""

import json
import random
import re
import sqlite3
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.engine import Loom
from codeloom.errors import LoomError
from codeloom.extract.lexer import lex
from codeloom.extract.source import Source, parse_jsdoc
from codeloom.functions import text as T
from codeloom.operators import bindings, diff, graph, imports, patterns, places, search
from codeloom.sources import projects, tables
from codeloom.streaming import watch

TREE = {
    "package.json": '{"name": "root-app"}',
    "src/a.ts": "import { b } from './b';\n/** @deprecated use other */\nexport function a(x: string): number { return b(x); }\nexport class Widget extends Base implements Shape { m(): void {} }\nclass Base {}\ninterface Shape { m(): void }\n",
    "src/b.ts": "import { c as cc } from './c';\nimport lib from 'lib';\nexport const b = (y: string) => cc(y);\nexport { cc as renamed };\n",
    "src/c.ts": "import './a';\nexport function c(z: string) { return z; }\n// @todo improve this\nexport enum Kind { One, Two }\n",
    "src/index.ts": "export { a } from './a';\nexport * from './c';\n",
    "packages/p/package.json": '{"name": "@x/p"}',
    "packages/p/src/d.ts": "import { a } from '../../../src/a';\nexport const d = a('q');\n",
    "node_modules/z/i.ts": "export const no = 1;",
}


def write(root, tree):
    for path, text in tree.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("app")
    write(root, TREE)
    e = Loom.open(spark, str(root), str(tmp_path_factory.mktemp("store")))
    e.root_path = root
    return e


def names(df, column="name"):
    return {r[0] for r in df.select(column).collect()}


def test_index_and_search(engine):
    assert names(engine.files, "file_path") == {p for p in TREE if p.endswith(".ts") and not p.startswith("node_modules")}
    assert {"a", "Widget", "Widget.m", "Base", "Shape", "b", "c", "Kind", "Kind.One", "d"} <= names(engine.symbols)
    assert names(engine.search_all_symbols(text="widg", kind="class")) == {"Widget"}
    assert names(engine.search_all_symbols(regex="^[ab]$")) == {"a", "b"}
    assert names(engine.search_symbols(project="@x/p", text="const")) == set()
    assert names(engine.search_annotations(project="root-app", tag="todo"), "value") == {"improve this"}
    assert {r.name for r in engine.module_interface("src/a.ts", "root-app").collect()} == {"a", "Widget", "Widget.m"}
    assert engine.module_interface("src/a.ts", "root-app").where("name = 'a'").first().parameters == "(x: string)"
    with pytest.raises(LoomError):
        engine.search_all_symbols(regex="(")
    with pytest.raises(LoomError):
        engine.file_stats("nowhere.ts")


def test_relations_and_graph(engine):
    rel = {(r.type, r.src_file_path, r.dst_file_path, r.dst_symbol_name) for r in engine.relations.collect()}
    assert ("imports", "src/a.ts", "src/b.ts", "b") in rel and ("imports", "src/b.ts", None, "default") in rel
    assert ("calls", "src/a.ts", "src/b.ts", "b") in rel and ("extends", "src/a.ts", "src/a.ts", "Base") in rel
    assert ("imports", "packages/p/src/d.ts", "src/a.ts", "a") in rel
    assert engine.has_cycle()
    assert [r.cycle for r in engine.cycle_paths().collect()] == [["src/a.ts", "src/b.ts", "src/c.ts"]]
    assert names(engine.affected(["src/c.ts"]), "node") == {"src/a.ts", "src/b.ts", "src/c.ts", "src/index.ts", "packages/p/src/d.ts"}
    assert engine.resolve_symbol("a", "src/index.ts").first().original_file == "src/a.ts"
    assert [c["symbol"] for c in engine.heritage_chain("Widget", "src/a.ts")["children"]] == ["Base", "Shape"]
    assert {("a", "src/a.ts"), ("c", "src/c.ts"), ("Kind", "src/c.ts")} <= {(r.name, r.origin_file) for r in engine.semantic_module_interface("src/index.ts").collect()}
    assert names(engine.implementations("Shape", "src/a.ts")) == {"Widget"}


def test_incremental_runs_log_changes(engine):
    again = engine.reindex()
    assert again["indexed_files"] == 0 and again["changes"] == {}
    write(engine.root_path, {"src/c.ts": TREE["src/c.ts"].replace("function c(", "function cRenamed("), "src/new.ts": "export type Fresh = string;"})
    (engine.root_path / "packages/p/src/d.ts").unlink()
    seen = []
    undo = engine.on("indexed", seen.append)
    engine.on("indexed", lambda _: 1 / 0)
    out = engine.reindex()
    undo()
    assert out["indexed_files"] == 2 and out["removed_files"] == 1 and seen == [out]
    log = {(r.change_type, r.symbol_name, r.old_name) for r in engine.symbol_changes("2000", include_full_index=True).collect() if r.index_run_id == out["run_id"]}
    assert {("renamed", "cRenamed", "c"), ("added", "Fresh", None), ("removed", "d", None)} == log
    assert engine.prune_changelog("2000") == 0
    held = engine.notify_file_changed("src/mem.ts", "export const inMemory = 1;")
    assert held["indexed_files"] == 1 and engine.notify_file_changed("src/mem.ts", "export const inMemory = 1;") is None
    assert "inMemory" in names(engine.symbols)
    engine.notify_file_deleted("src/mem.ts")
    assert "inMemory" not in names(engine.symbols)


def test_stream_of_events(engine, spark, tmp_path):
    write(engine.root_path, {"src/late.ts": "export const late = 1;"})
    (tmp_path / "in").mkdir()
    rows = [{"event_type": "create", "file_path": "src/late.ts", "seq": 1}, {"event_type": "change", "file_path": "src/x.d.ts", "seq": 2}, {"event_type": "change", "file_path": "node_modules/q.ts", "seq": 3}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    watch.watch(engine, watch.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert "late" in names(engine.symbols)


def test_closed_engine_and_readers(spark, tmp_path):
    e = Loom.open(spark, str(tmp_path), str(tmp_path / "s"), index=False, role="reader")
    with pytest.raises(LoomError, match="owner"):
        e.reindex()
    e.close(cleanup=True)
    e.close()
    with pytest.raises(LoomError, match="closed"):
        e.stats()
    with pytest.raises(LoomError):
        Loom.open(spark, "relative")


def test_source_reading():
    s = Source("f.ts", "export default class extends X {}\nlet { p, q: [r, ...t] } = o, u = function* () {};\nexport { u as v };\nabstract class K { get g() { return 1 } static { } private x?: Map<string, number[]> = new Map() }\nnamespace N { export namespace M { export const deep = 1 } const hid = 2 }\nexport async function* gen({ a, b }: { a: number; b: string }, ...rest: any[]): AsyncGenerator<number> {}\n")
    got = {x.name: x for x in s.symbols}
    assert set(got) == {"default", "p", "r", "t", "u", "K", "N", "gen"} and s.errors == []
    assert got["u"].is_exported and got["u"].kind == "function" and got["default"].heritage == [{"kind": "extends", "name": "X"}]
    assert [(m.name, m.method_kind, m.return_type) for m in got["K"].members] == [("g", "getter", None), ("x", None, "Map<string, number[]>")]
    assert [p["name"] for p in got["gen"].parameters] == ["{ a, b }", "...rest"] and got["gen"].is_async
    for broken in ("class {", "export const = ;", "import {", "function f(a, {", "`${", "/* x", "a ? b : <T>(", "enum E { A, ", "type X<", "((((", "}}}}", "export"):
        Source("x.ts", broken)


def test_tokens_and_docs():
    assert [t.text for t in lex("a = /x[/]y/g / 2 + `t${`n${1}`}` // c\n'\\'' ?? b?.c").tokens[:-1]] == ["a", "=", "/x[/]y/g", "/", "2", "+", "`t${`n${1}`}`", "'\\''", "??", "b", "?.", "c"]
    doc = parse_jsdoc("/** Sum.\n * More.\n * @param {number} [x=3] - left\n * @returns {number} it */")
    assert doc["description"] == "Sum.\nMore." and doc["tags"][0] == {"tag": "param", "name": "x", "type": "number", "description": "left", "optional": True, "default": "3"}


def test_bindings_and_patterns(spark):
    rows = bindings.bindings_of("let x = 1; function f(p) { var x = p; x += 1; return (z) => z + x } x ||= f(1); x++")
    assert [(r["declared_column"], r["write_kind"]) for r in rows if r["name"] == "x"] == [(4, "declaration"), (31, "declaration"), (31, "compound"), (31, None), (4, "logical"), (4, "update")]
    df = spark.createDataFrame([("m.ts", "log(1);\nfoo(a, b(c));\nfoo(q, q)")], "file_path string, content string")
    assert [(r.start_line, r.captures) for r in patterns.find_pattern(df, "foo($$$ARGS)").collect()] == [(2, {"ARGS": "a, b(c)"}), (3, {"ARGS": "q, q"})]
    assert [r.captures for r in patterns.find_pattern(df, "foo($A, $A)").collect()] == [{"A": "q"}]


def test_full_text_equals_sqlite(spark):
    words = ["handler_500", "handler_5001", "UserService", "user", "src/user.ts", "a-b", "Café", "method", "class", "über_alles"]
    rng = random.Random(1)
    rows = [(i, rng.choice(words) + rng.choice(["", "_x", "9"]), f"src/{rng.choice(words)}.ts", rng.choice(["class", "method"])) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(name, file_path, kind)")
    db.executemany("insert into f(rowid, name, file_path, kind) values (?, ?, ?, ?)", [(r[0] + 1, *r[1:]) for r in rows])
    df = spark.createDataFrame(rows, "id long, name string, file_path string, kind string").cache()
    for q in ("handler_500", "user", "service", "cafe", "src class", "handler 500", "user.ts", "a-b method", 'us"er', "UBER", "src/user", "x"):
        match = " ".join('"' + t.replace('"', '""') + '"*' for t in q.split())
        want = {r[0] - 1 for r in db.execute("select rowid from f where f match ?", (match,))}
        assert names(df.where(T.fts_match([F.col(c) for c in ("name", "file_path", "kind")], q)), "id") == want, q
    assert search.search_symbols(df, text="  ").count() == 60 and df.where(T.fts_match([F.col("name")], "***")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14))
def test_graph_properties(spark, pairs):
    if not pairs:
        return
    g = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    reach = {(f"n{a}", f"n{b}") for a, b in pairs}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    assert {(r.src, r.dst) for r in graph.closure(g).collect()} == reach
    cyclic = any(a == b for a, b in reach)
    assert graph.has_cycle(g) == cyclic
    both = {(a, b) for a, b in reach if (b, a) in reach}
    assert {r.node: r.component for r in graph.strong_components(g).collect()} == {a: min(d for c, d in both if c == a) for a, _ in both}
    cycles = [r.cycle for r in graph.circuits(g).collect()]
    assert bool(cycles) == cyclic
    edge = {(f"n{a}", f"n{b}") for a, b in pairs}
    assert all((c[i], c[(i + 1) % len(c)]) in edge for c in cycles for i in range(len(c)))
    seed = spark.createDataFrame([("n0",)], "node string")
    assert names(graph.transitive_dependencies(g, seed), "node") == {b for a, b in reach if a == "n0"}


def test_renames_take_the_nearest_line(spark):
    shape = "id long, project string, file_path string, name string, kind string, fingerprint string, structural_fingerprint string, start_line int, is_exported boolean, signature string"
    row = lambda i, name, line, fp="f", sf="s", file="a.ts": (i, "p", file, name, "function", fp, sf, line, True, None)
    before = spark.createDataFrame([row(1, "old1", 10), row(2, "old2", 50), row(3, "same", 70, "x", "q"), row(4, "gone", 90, "g1", None)], shape)
    after = spark.createDataFrame([row(1, "new1", 49), row(2, "new2", 11), row(3, "same", 70, "y", "q"), row(4, "gone", 5, "g1", None, "b.ts")], shape)
    got = {(r.old_name, r.new_name) for r in diff.renames(diff.added(before, after), diff.removed(before, after)).collect()}
    assert got == {("old1", "new2"), ("old2", "new1")}
    rows = diff.change_rows(before, after, "r", "t", False).orderBy("id").collect()
    assert [(r.id, r.change_type, r.symbol_name, r.old_name, r.old_file_path) for r in rows] == [(1, "modified", "same", None, None), (2, "renamed", "new1", "old2", None), (3, "renamed", "new2", "old1", None), (4, "moved", "gone", None, "a.ts")]


def test_globs_paths_imports_and_aliases(spark):
    one = spark.range(1)
    for pattern, path, hit in (("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/x/a.ts", False), ("**/a.ts", "a.ts", True), ("src/**/a.ts", "src/q/r/a.ts", True), ("x.{ts,js}", "x.js", True), ("[ab]?.ts", "b1.ts", True), ("a.ts", "aXts", False)):
        assert one.select(T.glob_match(F.lit(path), pattern)).first()[0] is hit, pattern
    at = lambda src, spec: one.select(imports.candidates(F.lit(src), F.lit(spec))).first()[0]
    assert at("src/x/a.ts", "../b.js") == ["src/b.ts"] and at("a.ts", "./c.mts") == ["c.mts"] and at("a.ts", "pkg") == [] and at("s/a.ts", "./d") == [f"s/d{e}" for e in (".ts", ".d.ts", "/index.ts", "/index.d.ts", ".mts", "/index.mts", ".cts", "/index.cts")]
    alias = one.select(imports.alias_candidates(F.lit("@lib/x/y"), [("@other/*", ["no/*"]), ("@lib/*", ["src/lib/*", "alt/*"])], ".")).first()[0]
    assert alias == ["src/lib/x/y", "alt/x/y"]


def test_projects_and_changes(spark, tmp_path):
    write(tmp_path, {k: v for k, v in TREE.items() if k.endswith("package.json")} | {"node_modules/q/package.json": "{}", "un/package.json": "{}"})
    assert [(r.dir, r.project) for r in projects.discover_projects(spark, str(tmp_path)).collect()] == [("packages/p", "@x/p"), ("un", "un"), (".", "root-app")]
    lease = spark.createDataFrame([(1, True, 59, "i", 9, "j"), (1, True, 60, "i", 9, "j"), (1, False, 1, "i", 9, "j"), (9, True, 1, "i", 9, "j"), (9, True, 1, "j", 9, "j"), (None, True, 0, "i", 9, "j")], "pid int, alive boolean, age int, ins string, own int, mine string")
    role = projects.lease_role(*[F.col(c) for c in ("pid", "alive", "age", "ins", "own", "mine")])
    assert [r[0] for r in lease.select(role).collect()] == ["reader", "owner", "owner", "owner", "reader", "owner"]


def test_store_keeps_whole_versions(spark, tmp_path):
    store, shape = tables.TableStore(spark, str(tmp_path / "t")), "project string, n int"
    values = lambda: {tuple(r) for r in store.read("files", shape).select("project", "n").collect()}
    assert store.read("files", shape).count() == 0 and store.manifest() == {}
    store.commit({"files": spark.createDataFrame([("p", 1), ("q", 2)], shape)})
    store.commit({"files": tables.upsert(store.read("files", shape), spark.createDataFrame([("q", 5)], shape), ["project"])})
    assert values() == {("p", 1), ("q", 5)}
    # A writer that dies before its manifest is in place leaves the version before.
    (tmp_path / "t/manifests/half.tmp").write_text('{"files": "nowhere"')
    with pytest.raises(ZeroDivisionError):
        store.commit({"files": spark.range(1).select(F.lit("x").alias("project"), F.lit(1).alias("n")), "other": _Dies()})
    assert values() == {("p", 1), ("q", 5)}
    for n in range(4):
        store.commit({"files": spark.createDataFrame([("v", n)], shape)})
    assert values() == {("v", 3)} and len(store._versions()) == tables.KEPT
    assert len(list((tmp_path / "t/files").iterdir())) == tables.KEPT + 1  # and the one of the run that died
    (tmp_path / f"t/manifests/{store._versions()[-1]}.json").write_text("{broken")
    for f in (tmp_path / "t/manifests").glob(".*.crc"):
        f.unlink()
    with pytest.raises(LoomError):
        store.manifest()


class _Dies:
    columns = ()

    @property
    def write(self):
        raise ZeroDivisionError


def test_aliases_resolve_from_end_to_end(spark, tmp_path):
    write(tmp_path / "app", {"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["gen/*", "src/*"], "exact": ["src/one.ts"]}}}', "src/one.ts": "export const one = 1;", "src/lib/index.ts": "export class Lib { run(): void {} }", "src/use.ts": "import { Lib } from '@app/lib';\nimport { one } from 'exact';\nimport x from 'other';\nexport const y = new Lib();"})
    e = Loom.open(spark, str(tmp_path / "app"), str(tmp_path / "store"))
    rel = {(r.type, r.specifier, r.dst_file_path, r.is_external) for r in e.relations.where("src_file_path = 'src/use.ts'").collect()}
    assert {("imports", "@app/lib", "src/lib/index.ts", False), ("imports", "exact", "src/one.ts", False), ("imports", "other", None, True), ("calls", "@app/lib", "src/lib/index.ts", False)} <= rel
    assert names(e.affected(["src/lib/index.ts"]), "node") == {"src/use.ts"}
    # The rule changes: an event reads it anew.
    (tmp_path / "app/tsconfig.json").write_text('{"compilerOptions": {"paths": {"@app/*": ["none/*"]}}}')
    e.apply_events([("change", "src/use.ts")])
    assert {r.dst_file_path for r in e.relations.where("type = 'imports' and specifier = '@app/lib'").collect()} == {None}
    assert e.line_column_to_position("src/use.ts", 2, 9) == 41 and e.line_column_to_position("src/use.ts", 9, 0) is None
    assert e.find_name_position("src/use.ts", 0, "Lib") == 9 and e.find_name_position("src/use.ts", 10, "Lib") == 105 and e.find_name_position("no.ts", 0, "x") is None
    e.close()


def test_one_owner_at_a_time(spark, tmp_path):
    write(tmp_path / "app", {"a.ts": "export const a = 1;"})
    first = Loom.open(spark, str(tmp_path / "app"), str(tmp_path / "store"))
    told = []
    first.on("role", told.append)
    assert first.role == "owner" and first.poll() == "owner"
    lease = first.lease.path
    taken = json.loads(lease.read_text()) | {"pid": 1, "instance": "another"}
    lease.write_text(json.dumps(taken | {"heartbeat": 9e12}))
    assert first.poll() == "reader" and told == ["reader"]
    with pytest.raises(LoomError):
        first.reindex()
    second = Loom.open(spark, str(tmp_path / "app"), str(tmp_path / "store"))
    assert second.role == "reader" and names(second.files, "file_path") == {"a.ts"}
    lease.write_text(json.dumps(taken | {"heartbeat": 1}))
    assert first.poll() == "owner" and told == ["reader", "owner"]
    first.close()
    assert second.poll() == "owner"
    second.close()


def test_moves_only_in_runs_of_events(spark, tmp_path):
    root = tmp_path / "app"
    write(root, {"a.ts": "export function carried(x: number) { return x; }", "user.ts": "import { carried } from './a';\ncarried(1);", "twin.ts": "export const q = 1;"})
    e = Loom.open(spark, str(root), str(tmp_path / "store"))
    (root / "a.ts").unlink()
    write(root, {"b.ts": "export function carried(x: number) { return x; }"})
    out = e.apply_events([("delete", "a.ts"), ("create", "b.ts")])
    assert out["changes"] == {"moved": 1}
    # A second symbol of the same fingerprint stands in a file that no event touches: not the only one, so no move.
    write(root, {"twin.ts": "export function carried(x: number) { return x; }"})
    e.apply_events([("change", "twin.ts")])
    (root / "b.ts").unlink()
    write(root, {"c.ts": "export function carried(x: number) { return x; }"})
    assert e.apply_events([("delete", "b.ts"), ("create", "c.ts")])["changes"] == {"added": 1, "removed": 1}
    # A full run of the same kind.
    (root / "c.ts").unlink()
    (root / "twin.ts").unlink()
    write(root, {"d.ts": "export function carried(x: number) { return x; }"})
    assert "moved" not in e.reindex()["changes"]
    e.close()


def test_annotations_link_to_members():
    s = Source("f.ts", "export class A {\n  /** @deprecated no */\n  m(): void {}\n\n\n\n  // @todo later\n  n(): void {}\n}\n// @x far\n\n\n\n\nclass B {}\n")
    assert [(a["tag"], a["symbol_name"]) for a in s.annotations()] == [("deprecated", "A.m"), ("todo", "A.n"), ("x", None)]


def test_resolving_stops_where_the_way_ends(spark):
    shape = "id long, project string, type string, src_file_path string, dst_file_path string, meta_json string"
    meta = lambda local, exported: json.dumps({"specifiers": [{"local": local, "exported": exported}]})
    rows = [
        (1, "p", "re-exports", "a.ts", None, meta("x", "x")), (2, "p", "re-exports", "a.ts", "b.ts", meta("x", "x")), (3, "p", "re-exports", "i.ts", "a.ts", meta("x", "y")),
        (4, "p", "re-exports", "l.ts", "m.ts", meta("u", "u")), (5, "p", "re-exports", "m.ts", "l.ts", meta("u", "u")), (6, "q", "re-exports", "z.ts", "a.ts", meta("x", "x")), (7, "p", "re-exports", "e.ts", "a.ts", meta("", "w")),
    ]
    rel = spark.createDataFrame(rows, shape)
    want = spark.createDataFrame([("y", "i.ts"), ("u", "l.ts"), ("x", "z.ts"), ("w", "e.ts")], "name string, file_path string")
    got = {r.name + "@" + r.file_path: (r.original_name, r.original_file, [tuple(c) for c in r.chain], r.circular) for r in graph.resolve_symbols(rel, want, "p").collect()}
    assert got == {
        "y@i.ts": ("x", "a.ts", [("i.ts", "y")], False), "u@l.ts": ("u", "l.ts", [("l.ts", "u"), ("m.ts", "u")], True),
        "x@z.ts": ("x", "z.ts", [], False), "w@e.ts": ("w", "e.ts", [], False),
    }


def test_full_text_folds_as_sqlite_does(spark):
    words = ["žlutý", "ŽLUTÝ kůň", "straße", "Ångström", "ñandú", "çà", "ΣΑΣ", "σας", "й", "и", "e\u0301tude", "étude", "x\u0305y", "ǖ", "日本語", "İstanbul", "naïve_value", "ﬁn"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(name)")
    db.executemany("insert into f(rowid, name) values (?, ?)", list(enumerate(words, 1)))
    df = spark.createDataFrame(list(enumerate(words, 1)), "id long, name string").cache()
    for q in [*words, "zluty", "kun", "angstrom", "nandu", "ca", "etude", "naive value", "ž", "istanbul"]:
        match = " ".join('"' + t.replace('"', '""') + '"*' for t in q.split())
        want = {r[0] for r in db.execute("select rowid from f where f match ?", (match,))}
        assert names(df.where(T.fts_match([F.col("name")], q)), "id") == want, q


def test_positions_against_a_plain_reading(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "la", " ", "$", "é", "\n", "\r\n", "\r", "\u2028", "la_", ".la"]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    ends = re.compile("\r\n|[\n\r\u2028\u2029]")
    rows = [(t, rng.randint(0, 6), rng.randint(-1, 5), rng.randint(0, 12)) for t in texts]
    got = spark.createDataFrame(rows, "t string, line int, col int, at int").select("*", T.line_column_to_position(F.col("t"), F.col("line"), F.col("col")).alias("p"), T.find_name_position(F.col("t"), F.col("at"), F.lit("la")).alias("n")).collect()
    for r in got:
        starts = [0, *(m.end() for m in ends.finditer(r.t))]
        want = None
        if 1 <= r.line <= len(starts) and r.col >= 0:
            at = starts[r.line - 1] + r.col
            want = at if (at < starts[r.line] if r.line < len(starts) else at <= len(r.t)) else None
        assert r.p == want, r
        found = next((m.start() for m in re.finditer(r"(?<![A-Za-z0-9_$])la(?![A-Za-z0-9_$])", r.t) if m.start() >= r.at), None)
        assert r.n == found, r


def test_renames_against_plain_greedy_matching(spark):
    rng = random.Random(9)
    shape = "id long, project string, file_path string, name string, kind string, fingerprint string, structural_fingerprint string, start_line int, is_exported boolean, signature string"
    side = lambda name: [(i, "p", f"f{rng.randint(0, 2)}.ts", f"{name}{i}", "function", f"{name}{i}", rng.choice(["s", "t", None]), rng.randint(1, 40), True, None) for i in range(40)]
    old, new = side("old"), side("new")
    want = set()
    for group in {(r[2], r[6]) for r in old if r[6]}:
        a = sorted((r[7], r[3], r[0]) for r in old if (r[2], r[6]) == group)
        b = sorted((r[7], r[3], r[0]) for r in new if (r[2], r[6]) == group)
        pairs = sorted((abs(x[0] - y[0]), i, j) for i, x in enumerate(a) for j, y in enumerate(b))
        left, right = set(), set()
        for _, i, j in pairs:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.add((group[0], a[i][1], b[j][1]))
    assert {(r.file_path, r.old_name, r.new_name) for r in diff.renames(spark.createDataFrame(new, shape), spark.createDataFrame(old, shape)).collect()} == want


def test_comments_merge_and_link(spark):
    c = spark.createDataFrame([(1, "a.ts", 1, "@todo one"), (2, "a.ts", 2, "and two"), (3, "a.ts", 4, "loose"), (4, "a.ts", 5, "@x y")], "id long, file_path string, line int, text string")
    assert {(r.line, r.end_line, r.text) for r in places.merged_line_comments(c).collect()} == {(1, 2, "@todo one and two"), (5, 5, "@x y")}


def test_a_long_chain(spark):
    n = 24
    g = spark.createDataFrame([(f"f{i:03}", f"f{i + 1:03}") for i in range(n)], "src string, dst string")
    assert graph.closure(g).count() == n * (n + 1) // 2 and not graph.has_cycle(g)


def test_innermost_node_against_brute_force(spark):
    rng = random.Random(8)
    nodes = [(i, rng.randint(0, 1), s := rng.randint(-40, 60), s + rng.choice([-1, 0, 1, 2, 3, 17, 64, 130])) for i in range(300)] + [(900, 0, None, 5), (901, None, 0, 50)]
    offsets = [(i, rng.randint(0, 2), rng.randint(-60, 220)) for i in range(400)] + [(900, None, 3), (901, 1, None)]
    want = {i: min(a)[1] for i, f, at in offsets if None not in (f, at) and (a := [(e - s, n) for n, g, s, e in nodes if None not in (g, s) and f == g and s <= at < e])}
    nodes, offsets = spark.createDataFrame(nodes, "id long, file_id long, start_at int, end_at int"), spark.createDataFrame(offsets, "id long, file_id long, at int")
    assert {r.id: r.node_id for r in places.innermost_node(offsets, nodes).collect()} == want
    assert places.innermost_node(offsets, nodes.limit(0)).count() == 0 and places.innermost_node(offsets.limit(0), nodes).count() == 0


def test_innermost_node_does_not_meet_every_node_around(spark):
    n = 60_000  # the pairs of an offset and a node around it are 1.8 billion
    nodes = spark.range(n).selectExpr("id", "0L as file_id", "cast(id as int) as start_at", "cast(2 * %d - id as int) as end_at" % n)
    offsets = spark.range(n).selectExpr("id", "0L as file_id", "cast(id as int) as at")
    began = time.perf_counter()
    assert places.innermost_node(offsets, nodes).where("id = node_id").count() == n
    assert time.perf_counter() - began < 60


def test_strong_components_of_a_long_chain_of_rings(spark, monkeypatch):
    # The least node leads to all rings, so settling a component for each colour takes a round a ring.
    rings = [(f"n{i:03}{x}", f"n{i:03}{y}") for i in range(40) for x, y in ("ab", "bc", "ca")]
    steps = [(f"n{i:03}c", f"n{i + 1:03}a") for i in range(39)] + [("m", "n000a"), ("x", "x"), ("n039b", "z"), (None, "n000a"), ("n000a", None)]
    g = spark.createDataFrame(rings + steps, "src string, dst string").cache()
    want = {a: f"{a[:4]}a" for a, _ in rings} | {"x": "x"}
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or real(df, name))
    assert {r.node: r.component for r in graph.strong_components(g).collect()} == want
    assert len(written) < 10
    few = g.where("src < 'n003' or src = 'x'").selectExpr("src", "dst")
    monkeypatch.setattr(graph, "SMALL_EDGES", 0)  # the way of large graphs
    assert {r.node: r.component for r in graph.strong_components(few).collect()} == {a: c for a, c in want.items() if a < "n003" or a == "x"}
    assert graph.strong_components(g.limit(0)).count() == 0


def _chained_rings(spark, n):
    rings = [(f"n{i:03}{x}", f"n{i:03}{y}") for i in range(n) for x, y in ("ab", "bc", "ca")]
    return spark.createDataFrame(rings + [(f"n{i:03}c", f"n{i + 1:03}a") for i in range(n - 1)], "src string, dst string")


def test_circuits_of_a_long_chain_of_rings_take_few_rounds(spark, monkeypatch):
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or real(df, name))
    assert ["::".join(r.cycle) for r in graph.circuits(_chained_rings(spark, 40)).collect()] == [f"n{i:03}a::n{i:03}b::n{i:03}c" for i in range(40)]
    assert len(written) < 20


def test_max_cycles_of_a_long_chain_of_rings_takes_the_first_in_order(spark, monkeypatch):
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or real(df, name))
    assert ["::".join(r.cycle) for r in graph.circuits(_chained_rings(spark, 40), 5).collect()] == [f"n{i:03}a::n{i:03}b::n{i:03}c" for i in range(5)]
    assert len(written) < 20


def _plain_circuits(edges):
    edges, found = set(edges), set()

    def go(path):
        for a, b in edges:
            if a == path[-1] and b == path[0]:
                found.add(min(("::".join(path[i:] + path[:i]), tuple(path[i:] + path[:i])) for i in range(len(path))))
            elif a == path[-1] and b > path[0] and b not in path:
                go([*path, b])

    for a in {a for a, _ in edges}:
        go([a])
    return [list(c) for _, c in sorted(found)]


def test_circuits_against_a_plain_search(spark):
    rng = random.Random(5)
    for names_, n in ((["s1", "s10", "s100", "s2", "s", "s1x", "t"], 20), (["a", "a:", "a::b", "b", "::", "c", "a::a"], 18), ([f"n{i:02}" for i in range(24)], 60)):
        rows = {(rng.choice(names_), rng.choice(names_)) for _ in range(n)}
        want = _plain_circuits(rows)
        assert len(want) > 5
        g = spark.createDataFrame(sorted(rows), "src string, dst string")
        assert [r.cycle for r in graph.circuits(g).collect()] == want
        for k in (0, 1, 3, len(want), len(want) + 1):
            assert [r.cycle for r in graph.circuits(g, k).collect()] == want[:k]


def test_circuits_of_large_components_by_rounds_are_the_same(spark):
    g = _chained_rings(spark, 3).union(spark.createDataFrame([("n000c", "n000b"), ("n000a", "n000a"), ("n000b", "n000a")], "src string, dst string")).cache()
    want = [r.cycle for r in graph.circuits(g).collect()]
    assert len(want) == 6 and [r.cycle for r in graph._circuits_by_rounds(g).orderBy("text").collect()] == want


def test_a_long_circuit_takes_no_round_a_node(spark, monkeypatch):
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or real(df, name))
    ring = [f"n{i:03}" for i in range(300)]
    g = spark.createDataFrame(list(zip(ring, ring[1:] + ring[:1], strict=True)), "src string, dst string")
    assert [r.cycle for r in graph.circuits(g).collect()] == [ring]
    assert len(written) < 8


def test_max_cycles_of_a_dense_graph_takes_the_first_alone(spark):
    n = 40  # over 10 ** 46 circuits in all
    g = spark.range(n * n).selectExpr("format_string('n%02d', id div {0}) as src".format(n), "format_string('n%02d', id % {0}) as dst".format(n)).where("src != dst")
    got = ["::".join(r.cycle) for r in graph.circuits(g, 3).collect()]
    assert got == ["n00::n01", "n00::n01::n02", "n00::n01::n02::n03"]


def test_first_circuits_of_a_small_graph_are_one_task(spark, monkeypatch):
    written, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or real(df, name))
    g = _chained_rings(spark, 300).union(spark.createDataFrame([("n", "n"), ("o", "p"), ("p", "o"), ("a", "z")], "src string, dst string"))
    got = [r.cycle for r in graph.circuits(g, 4).collect()]
    assert written == ["edges"]
    assert got == [r.cycle for r in graph.circuits(g).collect()][:4] and got[0] == ["n"]
