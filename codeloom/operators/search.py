"""Searches over symbols, relations, annotations and the change log. Results have a total order: the reference order, then id."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.errors import LoomError
from codeloom.functions.text import fts_match, glob_match, is_blank_query, member_name

UNSET = object()


def _is(column: str, value) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def detail_of(detail_json: Column) -> Column:
    """The parsed detail; text that isn't JSON gives a struct of nulls."""
    return F.from_json(detail_json, schema.DETAIL)


def has_decorator(detail_json: Column, name: str) -> Column:
    return F.coalesce(F.exists(detail_of(detail_json).getField("decorators"), lambda d: d["name"] == name), F.lit(False))


def check_regex(pattern: str) -> None:
    try:
        re.compile(pattern)
    except re.error as e:
        raise LoomError("validation", f"bad regular expression: {e}") from e


def search_symbols(symbols: DataFrame, text: str | None = None, exact: bool = False, kind: str | None = None, file_path=UNSET, is_exported=UNSET, project=UNSET, decorator: str | None = None, regex: str | None = None, resolved_type=UNSET, limit: int | None = None) -> DataFrame:
    """All given conditions together, ordered by name. ``text`` is full text over name, file_path and kind, or a whole name if ``exact``.

    A blank text is no condition. A regular expression is tried on all matches before the limit.
    """
    out = symbols
    if not is_blank_query(text):
        out = out.where(F.col("name") == text) if exact else out.where(fts_match([F.col("name"), F.col("file_path"), F.col("kind")], text))
    if kind:
        out = out.where(F.col("kind") == kind)
    for column, value in (("file_path", file_path), ("is_exported", is_exported), ("project", project), ("resolved_type", resolved_type)):
        if value is not UNSET:
            out = out.where(_is(column, value))
    if decorator:
        out = out.where(has_decorator(F.col("detail_json"), decorator))
    if regex is not None:
        check_regex(regex)
        out = out.where(F.col("name").rlike(regex))
    out = out.orderBy("name", "id")
    return out if limit is None else out.limit(limit)


def search_by_name(symbols: DataFrame, text: str, project: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Full-text search by name; a blank text finds nothing."""
    if is_blank_query(text):
        return symbols.limit(0)
    return search_symbols(symbols, text=text, project=project, **({"kind": kind} if kind else {})).limit(limit)


def by_kind(symbols: DataFrame, project: str, kind: str) -> DataFrame:
    return symbols.where((F.col("project") == project) & (F.col("kind") == kind)).orderBy("name", "id")


def by_fingerprint(symbols: DataFrame, project: str, fingerprint: str) -> DataFrame:
    return symbols.where((F.col("project") == project) & (F.col("fingerprint") == fingerprint))


def file_symbols(symbols: DataFrame, project: str, file_path: str) -> DataFrame:
    return symbols.where((F.col("project") == project) & (F.col("file_path") == file_path))


def shaped_symbols(symbols: DataFrame) -> DataFrame:
    """Rows as results: member name, nested span and parsed detail."""
    point = lambda a: F.struct(F.col(f"{a}_line").alias("line"), F.col(f"{a}_column").alias("column"))
    return symbols.select(
        "id", "project", "file_path", "kind", "name", member_name(F.col("name")).alias("member_name"), F.struct(point("start").alias("start"), point("end").alias("end")).alias("span"),
        "is_exported", "signature", "fingerprint", detail_of(F.col("detail_json")).alias("detail"),
    )


def search_relations(relations: DataFrame, src_glob: str | None = None, dst_glob: str | None = None, limit: int | None = None, **equal) -> DataFrame:
    """Equality on any columns given (None: null), globs on either path; a null target passes a target glob. Ordered by id."""
    for side, glob in (("src", src_glob), ("dst", dst_glob)):
        if glob is not None and f"{side}_file_path" in equal:
            raise LoomError("validation", f"{side}: a path and a pattern exclude each other")
    out = relations
    for column, value in equal.items():
        out = out.where(_is(column, value))
    if src_glob is not None:
        out = out.where(glob_match(F.col("src_file_path"), src_glob))
    if dst_glob is not None:
        out = out.where(F.col("dst_file_path").isNull() | glob_match(F.col("dst_file_path"), dst_glob))
    out = out.orderBy("id")
    return out if limit is None else out.limit(limit)


def outgoing(relations: DataFrame, project: str, file_path: str, symbol: str | None = None) -> DataFrame:
    """Relations from a file; with a symbol, its own and those of the file as a whole."""
    out = relations.where((F.col("project") == project) & (F.col("src_file_path") == file_path))
    return out if symbol is None else out.where((F.col("src_symbol_name") == symbol) | F.col("src_symbol_name").isNull())


def incoming(relations: DataFrame, dst_project: str, file_path: str) -> DataFrame:
    return relations.where((F.col("dst_project") == dst_project) & (F.col("dst_file_path") == file_path))


def by_type(relations: DataFrame, project: str, kind: str) -> DataFrame:
    return relations.where((F.col("project") == project) & (F.col("type") == kind))


def internal_relations(relations: DataFrame, project: str, file_path: str, limit: int = 10_000) -> DataFrame:
    return search_relations(relations, project=project, src_file_path=file_path, dst_file_path=file_path, limit=limit)


def module_interface(symbols: DataFrame, project: str, file_path: str) -> DataFrame:
    """Exported symbols of a file with their parameters as text."""
    detail = detail_of(F.col("detail_json"))
    shown = F.transform(detail["parameters"], lambda p: F.concat(p["name"], F.when(p["isOptional"], "?").otherwise(""), F.lit(": "), F.coalesce(p["type"], F.lit("unknown"))))
    text = F.when(F.size(detail["parameters"]) >= 0, F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")")))
    return file_symbols(symbols, project, file_path).where("is_exported").select("name", "kind", text.alias("parameters"), detail["returnType"].alias("return_type"), detail["jsDoc"].alias("js_doc")).orderBy("name")


def full_symbol(symbols: DataFrame, project: str, name: str, file_path: str) -> DataFrame:
    """The first symbol of that whole name in the file, its detail's fields lifted; no row if there is none."""
    return search_symbols(symbols, text=name, exact=True, file_path=file_path, project=project, limit=1).select("*", detail_of(F.col("detail_json")).alias("_d")).select(*symbols.columns, "_d.*")


def search_annotations(annotations: DataFrame, text: str | None = None, tag: str | None = None, file_path: str | None = None, symbol_name: str | None = None, source: str | None = None, project: str | None = None, limit: int | None = None) -> DataFrame:
    """Empty conditions are none. Ordered by id."""
    out = annotations
    for column, value in (("project", project), ("tag", tag), ("file_path", file_path), ("symbol_name", symbol_name), ("source", source)):
        if value:
            out = out.where(F.col(column) == value)
    if not is_blank_query(text):
        out = out.where(fts_match([F.col("tag"), F.col("value")], text))
    out = out.orderBy("id")
    return out if limit is None else out.limit(limit)


def symbol_changes(changelog: DataFrame, since: str, project: str | None = None, change_types: Sequence[str] | None = None, symbol_name: str | None = None, file_path: str | None = None, index_run_id: str | None = None, after_id: int = 0, include_full_index: bool = False, limit: int = 1000) -> DataFrame:
    """Changes at or after an ISO time, a page at a time: pass the last id seen as ``after_id`` for the next."""
    out = changelog.where(F.col("changed_at") >= since)
    for column, value in (("project", project), ("symbol_name", symbol_name), ("file_path", file_path), ("index_run_id", index_run_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if change_types:
        out = out.where(F.col("change_type").isin(list(change_types)))
    if after_id:
        out = out.where(F.col("id") > after_id)
    if not include_full_index:
        out = out.where(~F.col("is_full_index"))
    return out.orderBy("id").limit(limit)


def symbol_stats(symbols: DataFrame, project: str) -> DataFrame:
    """symbol_count and file_count; a file without symbols isn't counted."""
    return symbols.where(F.col("project") == project).agg(F.count(F.lit(1)).alias("symbol_count"), F.countDistinct("file_path").alias("file_count"))


def file_stats(files: DataFrame, symbols: DataFrame, relations: DataFrame, project: str | None = None) -> DataFrame:
    """Per file: symbols, exported symbols, relations from it, lines and size."""
    pick = lambda df: df if project is None else df.where(F.col("project") == project)
    s = pick(symbols).groupBy("project", "file_path").agg(F.count(F.lit(1)).alias("symbol_count"), F.count_if("is_exported").alias("exported_symbol_count"))
    r = pick(relations).groupBy("project", F.col("src_file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("relation_count"))
    joined = pick(files).join(s, ["project", "file_path"], "left").join(r, ["project", "file_path"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("project", "file_path", zero("symbol_count"), zero("exported_symbol_count"), zero("relation_count"), zero("line_count"), "size")
