"""Declared types: what annotations and literals say. Inference is out of reach here and gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import transitive_dependencies
from codeloom.operators.search import detail_of


def literal_type(initializer: Column) -> Column:
    """The type of a literal initializer; null for anything else."""
    return (
        F.when(initializer.rlike(r"^(['\"]).*\1$|^`[^$]*`$"), "string").when(initializer.rlike(r"^-?(\d[\d_]*\.?\d*([eE][+-]?\d+)?|0[xXbBoO][\da-fA-F_]+)$"), "number")
        .when(initializer.isin("true", "false"), "boolean").when(initializer.rlike(r"^-?\d+n$"), "bigint").when(initializer == "null", "null")
    )


def file_types(symbols: DataFrame) -> DataFrame:
    """file_path, name, kind, type: declared types of symbols, of functions their return types."""
    d = detail_of(F.col("detail_json"))
    return symbols.select("file_path", "name", "kind", F.coalesce(d["returnType"], F.when(F.col("kind") == "variable", literal_type(d["initializer"]))).alias("type"))


def is_thenable(declared: Column) -> Column:
    """Whether a declared type is a promise, alone or within a union."""
    return declared.rlike(r"(^|\|)\s*(Promise|PromiseLike)\s*<")


def nominally_assignable(relations: DataFrame, source: tuple[str, str], target: tuple[str, str]) -> bool:
    """Whether a symbol (file, name) is the target or extends or implements it, directly or not."""
    if source == target:
        return True
    key = lambda s: F.concat_ws("::", f"{s}_file_path", f"{s}_symbol_name")
    up = relations.where(F.col("type").isin("extends", "implements") & F.col("dst_file_path").isNotNull()).select(key("src").alias("src"), key("dst").alias("dst")).distinct()
    seed = relations.sparkSession.createDataFrame([("::".join(source),)], "node string")
    return not transitive_dependencies(up, seed).where(F.col("node") == "::".join(target)).isEmpty()


def structurally_assignable(symbols: DataFrame, target_file: str, target: str) -> DataFrame:
    """file_path, name of classes and interfaces that have all members of the target, by name and declared type."""
    member = symbols.where(F.instr("name", ".") > 0).select("file_path", F.substring_index("name", ".", 1).alias("owner"), F.substring_index("name", ".", -1).alias("member"), F.coalesce(detail_of(F.col("detail_json"))["returnType"], F.lit("")).alias("t"))
    wanted = member.where((F.col("file_path") == target_file) & (F.col("owner") == target)).select("member", "t").distinct()
    n = wanted.count()
    having = member.join(wanted, ["member", "t"]).groupBy("file_path", "owner").agg(F.countDistinct("member").alias("_n")).where(F.col("_n") == n)
    return having.where(~((F.col("file_path") == target_file) & (F.col("owner") == target))).select("file_path", F.col("owner").alias("name"))
