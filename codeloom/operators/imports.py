"""Import specifiers to files: candidates in a fixed order, and the first that exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How compiled names map to sources, and what is tried for a name without an extension, in order.
COMPILED = ((".js", ".ts"), (".mjs", ".mts"), (".cjs", ".cts"))
ENDINGS = (".ts", ".d.ts", "/index.ts", "/index.d.ts", ".mts", "/index.mts", ".cts", "/index.cts")


def folded(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts; what leads above the root keeps its ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when((p == "..") & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def is_bare(specifier: Column) -> Column:
    return ~specifier.rlike(r"^[./]")


def source_names(base: Column) -> Column:
    """Paths of sources that a path without a known extension may mean, in order; a compiled name means its source."""
    out = F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS])
    for a, b in COMPILED:
        out = F.when(F.endswith(base, F.lit(a)), F.array(F.concat(F.substr(base, F.lit(1), F.length(base) - len(a)), F.lit(b)))).otherwise(out)
    for e in (".ts", ".mts", ".cts"):
        out = F.when(F.endswith(base, F.lit(e)), F.array(base)).otherwise(out)
    return out


def candidates(src_path: Column, specifier: Column, aliases: list[tuple[str, list[str]]] = (), base_url: str = ".") -> Column:
    """Paths that a specifier may mean, in order: of a relative one beside its source, of others by the first alias that matches."""
    base = folded(F.concat_ws("/", F.regexp_replace(src_path, "/?[^/]*$", ""), specifier))
    bases = F.when(~is_bare(specifier), F.array(base)).otherwise(alias_candidates(specifier, list(aliases), base_url))
    return F.flatten(F.transform(bases, source_names))


def alias_candidates(specifier: Column, aliases: list[tuple[str, list[str]]], base_url: str = "") -> Column:
    """For path aliases (pattern with one ``*`` at most, targets): bases of the first pattern that matches. Patterns without targets match nothing."""
    out = F.array().cast("array<string>")
    for pattern, targets in reversed([(p, t) for p, t in aliases if t]):
        head, star, tail = pattern.partition("*")
        hit = F.startswith(specifier, F.lit(head)) & F.endswith(specifier, F.lit(tail)) & (F.length(specifier) >= len(head) + len(tail)) if star else specifier == pattern
        middle = F.substr(specifier, F.lit(len(head) + 1), F.length(specifier) - len(head) - len(tail)) if star else F.lit("")
        made = F.array(*[folded(F.concat_ws("/", F.lit(base_url), F.concat(F.lit(t.partition("*")[0]), middle, F.lit(t.partition("*")[2])))) for t in targets])
        out = F.when(hit, made).otherwise(out)
    return out


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, list[str]]] = (), base_url: str = ".") -> DataFrame:
    """``imports`` (id, src_file_path, specifier) with dst_file_path (the first candidate that is a file; else null), is_external and is_unresolved."""
    each = imports.select("id", F.posexplode(candidates(F.col("src_file_path"), F.col("specifier"), aliases, base_url)).alias("_at", "file_path"))
    hit = each.join(files.select("file_path").distinct(), "file_path").groupBy("id").agg(F.min(F.struct("_at", "file_path")).alias("_m"))
    out = imports.join(hit, "id", "left").withColumn("dst_file_path", F.col("_m.file_path")).drop("_m")
    missing = F.col("dst_file_path").isNull()
    return out.withColumn("is_external", missing & is_bare(F.col("specifier"))).withColumn("is_unresolved", missing & ~is_bare(F.col("specifier")))
