import pytest
from pyspark.sql import functions as F

from codeloom.operators import types
from codeloom.sources.config import load_aliases, parse_jsonc
from codeloom.streaming.lease import Lease, may_own


def test_tsconfig_with_comments_and_parents(spark, tmp_path):
    assert parse_jsonc('{"a": "//no", /* c */ "b": [1, 2,], // x\n}') == {"a": "//no", "b": [1, 2]}
    with pytest.raises(ValueError):
        parse_jsonc("[1]")
    (tmp_path / "base.json").write_text('{"compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["old/*"]}}}')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base", "compilerOptions": {"paths": {"@a/*": ["new/*"], "b": ["x"]}}}')
    assert load_aliases(spark, str(tmp_path)) == {"base_url": "src", "paths": [("@a/*", ["new/*"]), ("b", ["x"])]}
    assert load_aliases(spark, str(tmp_path / "none")) is None


def test_lease_passes_on(tmp_path):
    now = [1000.0]
    one, two = (Lease(str(tmp_path), pid, lambda: now[0], lambda _: True) for pid in (1, 2))
    assert one.acquire() == "owner" and two.acquire() == "reader" and one.heartbeat()
    now[0] += 59.9
    assert two.acquire() == "reader"
    now[0] += 0.1
    assert two.acquire() == "owner" and not one.heartbeat()
    two.release()
    assert one.acquire() == "owner"
    assert may_own({"pid": 5, "heartbeat": 1, "instance": "a"}, 5, "b", 1, lambda _: True)
    assert may_own({"pid": 5, "heartbeat": 1, "instance": "a"}, 6, "b", 1, lambda _: False)


def test_declared_types(spark):
    rows = [("a.ts", "x", "variable", '{"initializer":"\'s\'"}'), ("a.ts", "n", "variable", '{"initializer":"-1.5"}'), ("a.ts", "f", "function", '{"returnType":"Promise<A>"}'), ("a.ts", "q", "variable", '{"initializer":"g()"}')]
    df = spark.createDataFrame(rows, "file_path string, name string, kind string, detail_json string")
    assert {r.name: r.type for r in types.file_types(df).collect()} == {"x": "string", "n": "number", "f": "Promise<A>", "q": None}
    assert {r.name for r in types.file_types(df).where(types.is_thenable(F.col("type"))).collect()} == {"f"}
    rel = spark.createDataFrame([("extends", "a", "A", "a", "B"), ("implements", "a", "B", "b", "C")], "type string, src_file_path string, src_symbol_name string, dst_file_path string, dst_symbol_name string")
    assert types.nominally_assignable(rel, ("a", "A"), ("b", "C")) and not types.nominally_assignable(rel, ("b", "C"), ("a", "A"))
    shape = spark.createDataFrame([("a", "I.m", '{"returnType":"T"}'), ("a", "K.m", '{"returnType":"T"}'), ("a", "K.z", "{}"), ("a", "L.m", "{}")], "file_path string, name string, detail_json string")
    assert [r.name for r in types.structurally_assignable(shape, "a", "I").collect()] == ["K"]
