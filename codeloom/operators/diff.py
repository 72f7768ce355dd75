"""Snapshots of symbols and relations compared: added, removed, modified, renamed and moved."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.sources.tables import numbered

KEY = ["file_path", "name"]


def latest_by_key(snapshot: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row a key: of duplicates (overloads, accessor pairs) the last by id."""
    last = Window.partitionBy(*keys).orderBy(F.col("id").desc())
    return snapshot.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def added(before: DataFrame, after: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return after.join(before.select(*keys), keys, "left_anti")


def removed(before: DataFrame, after: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return before.join(after.select(*keys), keys, "left_anti")


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def modified(before: DataFrame, after: DataFrame) -> DataFrame:
    """Same key, another fingerprint, export flag, or structural fingerprint (where both have one)."""
    old = before.select(*KEY, F.col("fingerprint").alias("_fp"), F.col("is_exported").alias("_ex"), F.col("structural_fingerprint").alias("_sf"))
    shape = F.coalesce(F.col("structural_fingerprint") != F.col("_sf"), F.lit(False))
    return after.join(old, KEY).where(_differs("fingerprint", "_fp") | _differs("is_exported", "_ex") | shape).drop("_fp", "_ex", "_sf")


def diff_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_path, name, change: added, removed, or modified where fingerprints differ."""
    b = before.select(*KEY, F.col("fingerprint").alias("_old"), F.lit(True).alias("_b"))
    a = after.select(*KEY, F.col("fingerprint").alias("_new"), F.lit(True).alias("_a"))
    both = b.join(a, KEY, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(_differs("_old", "_new"), "modified")
    return both.select(*KEY, change.alias("change")).where("change is not null")


RELATION_KEY = ["type", "src_file_path", "src_symbol_name", "dst_file_path", "dst_symbol_name"]


def relation_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct relation keys with a hash of their metadata, and whether they were added or removed."""
    keyed = lambda df: df.select(*RELATION_KEY, F.md5(F.coalesce("meta_json", F.lit("")).cast("binary")).alias("meta_hash")).distinct()
    a, b = keyed(after), keyed(before)
    only = lambda x, y: x.exceptAll(y)  # noqa: E731  both are distinct
    return only(a, b).withColumn("change", F.lit("added")).unionByName(only(b, a).withColumn("change", F.lit("removed")))


def renames(added_rows: DataFrame, removed_rows: DataFrame) -> DataFrame:
    """file_path, kind, old_name, new_name: one to one within a file, kind and structural shape, the nearest start lines first.

    Groups of one old and one new symbol stay in joins; only the others are matched in Python, a group at a time.
    """
    group = ["file_path", "kind", "structural_fingerprint"]
    sides = []
    for df, side in ((removed_rows, "old"), (added_rows, "new")):
        sides.append(df.where("structural_fingerprint is not null").select(*group, F.struct("start_line", "name", "id").alias("row"), F.lit(side).alias("side")))
    rows = sides[0].unionByName(sides[1]).groupBy(*group).agg(
        F.count_if(F.col("side") == "old").alias("_old"), F.count_if(F.col("side") == "new").alias("_new"), F.array_sort(F.collect_list(F.struct("side", "row"))).alias("rows")
    ).where("_old > 0 and _new > 0")
    name = lambda side: F.filter("rows", lambda r: r["side"] == side)[0]["row"]["name"]
    single = rows.where("_old = 1 and _new = 1").select("file_path", "kind", name("old").alias("old_name"), name("new").alias("new_name"))

    def match(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                old = [x["row"] for x in r.rows if x["side"] == "old"]
                new = [x["row"] for x in r.rows if x["side"] == "new"]
                ranked = sorted((abs(o["start_line"] - n["start_line"]), i, j) for i, o in enumerate(old) for j, n in enumerate(new))
                used_o, used_n = set(), set()
                for _, i, j in ranked:
                    if i not in used_o and j not in used_n:
                        used_o.add(i)
                        used_n.add(j)
                        out.append((r.file_path, r.kind, old[i]["name"], new[j]["name"]))
            yield pd.DataFrame(out, columns=["file_path", "kind", "old_name", "new_name"])

    several = rows.where("_old > 1 or _new > 1").select("file_path", "kind", "rows").mapInPandas(match, "file_path string, kind string, old_name string, new_name string")
    return single.unionByName(several)


def member_renames(parents: DataFrame, added_rows: DataFrame, removed_rows: DataFrame) -> DataFrame:
    """Members of renamed parents: ``Old.x`` that went and ``New.x`` that came in the same file."""
    dot = lambda c: F.instr(c, ".")
    part = lambda c, first: F.substr(c, F.lit(1), dot(c) - 1) if first else F.substr(c, dot(c) + 1, F.length(c))
    side = lambda df, p, n: df.where(dot("name") > 0).select("file_path", part(F.col("name"), True).alias(p), part(F.col("name"), False).alias("_suffix"), F.col("name").alias(n), F.col("kind").alias(f"_k{n}"))
    both = parents.join(side(removed_rows, "old_name", "_old"), ["file_path", "old_name"]).join(side(added_rows, "new_name", "_new"), ["file_path", "new_name", "_suffix"])
    return both.select("file_path", F.col("_k_old").alias("kind"), F.col("_old").alias("old_name"), F.col("_new").alias("new_name"))


def moves(removed_rows: DataFrame, current: DataFrame) -> DataFrame:
    """project, name, old_file, new_file of removed symbols of whose fingerprint the project has exactly one symbol now."""
    now = current.where("fingerprint is not null").select("project", "fingerprint", F.col("file_path").alias("new_file"), F.col("name").alias("new_name"))
    one = now.groupBy("project", "fingerprint").agg(F.count(F.lit(1)).alias("_n"), F.min("new_file").alias("new_file"), F.min("new_name").alias("new_name")).where("_n = 1")
    joined = removed_rows.select("project", "fingerprint", F.col("file_path").alias("old_file"), "name", "kind").join(one, ["project", "fingerprint"])
    return joined.where("old_file != new_file").select("project", "name", "kind", "old_file", "new_file", "new_name", "fingerprint")


def change_rows(before: DataFrame, after: DataFrame, run_id: str, changed_at: str, is_full: bool, first_id: int = 1, find_moves: bool = True, current: DataFrame | None = None) -> DataFrame:
    """Change-log rows of two snapshots, in the order added, modified, removed, renamed, moved.

    The snapshots may be of touched files alone; ``current`` has all symbols there are now, among
    which a moved one's fingerprint must be the only one of its project.
    """
    b, a = latest_by_key(before), latest_by_key(after)
    new, gone = added(b, a), removed(b, a)
    named = renames(new, gone)
    named = named.unionByName(member_renames(named, new, gone)).dropDuplicates(["file_path", "old_name"])
    gone = gone.join(named.select("file_path", F.col("old_name").alias("name")), KEY, "left_anti")
    new_names = named.select("file_path", F.col("new_name").alias("name"))
    fresh = new.join(new_names, KEY, "left_anti")
    moved = moves(gone, a if current is None else current) if find_moves else moves(gone, a).limit(0)
    gone = gone.join(moved.select(F.col("old_file").alias("file_path"), "name"), KEY, "left_anti")
    fresh = fresh.join(moved.select(F.col("new_file").alias("file_path"), F.col("new_name").alias("name")), KEY, "left_anti")
    null = F.lit(None).cast("string")

    def rows(df: DataFrame, order: int, change: str, old_name: Column = null, old_file: Column = null) -> DataFrame:
        return df.select(F.lit(order).alias("_o"), "project", F.lit(change).alias("change_type"), F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), "file_path", old_name.alias("old_name"), old_file.alias("old_file_path"), "fingerprint")

    renamed = a.join(named.select("file_path", F.col("new_name").alias("name"), "old_name"), KEY)
    moved_rows = moved.select("project", F.col("new_name").alias("name"), "kind", F.col("new_file").alias("file_path"), F.col("old_file").alias("_old"), "fingerprint")
    every = rows(fresh, 0, "added").unionByName(rows(modified(b, a), 1, "modified")).unionByName(rows(gone, 2, "removed"))
    every = every.unionByName(rows(renamed, 3, "renamed", F.col("old_name"))).unionByName(rows(moved_rows, 4, "moved", null, F.col("_old")))
    every = numbered(every, ["_o", "file_path", "symbol_name"], "id", first_id)
    return every.select("id", "project", "change_type", "symbol_name", "symbol_kind", "file_path", "old_name", "old_file_path", "fingerprint", F.lit(changed_at).alias("changed_at"), F.lit(is_full).alias("is_full_index"), F.lit(run_id).alias("index_run_id"))
