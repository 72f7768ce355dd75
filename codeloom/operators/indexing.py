"""Source files to tables: symbols, relations and annotations, a batch of files to an Arrow batch.

Python reads one file at a time and knows nothing of others; names that lead to other files
are resolved afterwards by joins over all known files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeloom import schema
from codeloom.extract.source import Source, Symbol
from codeloom.operators.imports import folded, resolve_imports
from codeloom.sources.projects import file_projects
from codeloom.sources.tables import numbered

PARSED = "project string, file_path string, error string, symbols string, relations string, annotations string"
_SYMBOL = (
    "array<struct<kind:string,name:string,start_line:int,start_column:int,end_line:int,end_column:int,is_exported:boolean,"
    "signature:string,fingerprint:string,detail_json:string,structural_fingerprint:string>>"
)
_RELATION = "array<struct<type:string,src_symbol_name:string,specifier:string,dst_symbol_name:string,meta_json:string>>"
_ANNOTATION = "array<struct<tag:string,value:string,source:string,symbol_name:string,start_line:int,start_column:int,end_line:int,end_column:int>>"


@F.pandas_udf(StringType())
def content_hash(text: pd.Series) -> pd.Series:
    """XXH64 of the text with seed 0, as 16 hexadecimal digits."""
    return text.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t.encode()))


def _hash(s: str) -> str:
    return xxhash.xxh64_hexdigest(s.encode())


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def symbol_rows(source: Source) -> list[dict]:
    """Rows of a file's symbols and, as ``Parent.member``, of their members."""

    def row(s: Symbol, name: str, exported: bool) -> dict:
        kind = s.kind
        signature = f"params:{len(s.parameters)}|async:{int(s.is_async)}" if kind in ("function", "method") else None
        members = sorted(stable_json({"name": m.name, "kind": m.method_kind or m.kind, "type": m.return_type, "params": len(m.parameters)}) for m in s.members)
        shape = [kind, ",".join(sorted(s.modifiers)), len(s.type_parameters), ",".join(sorted(f"{h['kind']}:{h['name']}" for h in s.heritage)), ",".join(sorted(d["name"] for d in s.decorators)), s.method_kind or "", len(s.parameters), s.return_type or "", _hash("|".join(members)) if members else ""]
        (l1, c1), (l2, c2) = source.lines.place(s.start), source.lines.place(s.end)
        return {
            "kind": kind, "name": name, "start_line": l1, "start_column": c1, "end_line": l2, "end_column": c2, "is_exported": exported, "signature": signature,
            "fingerprint": _hash(f"{name}|{kind}|{signature or ''}"), "detail_json": stable_json(s.detail()), "structural_fingerprint": _hash("|".join(map(str, shape))),
        }

    out = []
    for s in source.symbols:
        out.append(row(s, s.name, s.is_exported))
        out += [row(m, f"{s.name}.{m.name}", s.is_exported) for m in s.members]
    return out


def relation_rows(source: Source) -> list[dict]:
    out = [{"type": i.kind, "src_symbol_name": None, "specifier": i.specifier, "dst_symbol_name": i.imported, "meta_json": stable_json(i.meta) if i.meta else None} for i in [*source.imports, *source.dynamic_imports()]]
    for r in [*source.calls(), *source.heritage()]:
        out.append({"type": r["type"], "src_symbol_name": r["src"], "specifier": r["specifier"], "dst_symbol_name": r["dst"], "meta_json": stable_json(r["meta"]) if r["meta"] else None})
    return out


def annotation_rows(source: Source) -> list[dict]:
    out = []
    for a in source.annotations():
        (l1, c1), (l2, c2) = source.lines.place(a["start"]), source.lines.place(a["end"])
        out.append({"tag": a["tag"], "value": a["value"], "source": a["source"], "symbol_name": a["symbol_name"], "start_line": l1, "start_column": c1, "end_line": l2, "end_column": c2})
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """files (project, file_path, content) to one row each of PARSED: JSON lists, or what went wrong."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for project, path, text in batch.itertuples(index=False):
                try:
                    s = Source(path, text or "")
                    out.append((project, path, "; ".join(s.errors) or None, stable_json(symbol_rows(s)), stable_json(relation_rows(s)), stable_json(annotation_rows(s))))
                except Exception as e:  # one file's failure is its own
                    out.append((project, path, f"{type(e).__name__}: {e}", "[]", "[]", "[]"))
            yield pd.DataFrame(out, columns=["project", "file_path", "error", "symbols", "relations", "annotations"])

    return files.select("project", "file_path", "content").mapInPandas(parse, PARSED)


def _rows(parsed: DataFrame, column: str, shape: str) -> DataFrame:
    return parsed.select("project", "file_path", F.posexplode(F.from_json(column, shape)).alias("_pos", "_r")).select("project", "file_path", "_pos", "_r.*")


def symbols_of(parsed: DataFrame, hashes: DataFrame, now: str, first_id: int = 1) -> DataFrame:
    rows = _rows(parsed, "symbols", _SYMBOL).join(hashes.select("project", "file_path", "content_hash"), ["project", "file_path"], "left")
    rows = rows.withColumn("indexed_at", F.lit(now)).withColumn("resolved_type", F.lit(None).cast("string"))
    return _as(numbered(rows, ["project", "file_path", "_pos"], "id", first_id), schema.SYMBOLS)


def annotations_of(parsed: DataFrame, now: str, first_id: int = 1) -> DataFrame:
    rows = _rows(parsed, "annotations", _ANNOTATION).withColumn("indexed_at", F.lit(now))
    return _as(numbered(rows, ["project", "file_path", "_pos"], "id", first_id), schema.ANNOTATIONS)


def _alias_options(aliases: dict | None) -> dict:
    return {"aliases": aliases["paths"], "base_url": aliases["base_url"]} if aliases else {}


def relations_of(parsed: DataFrame, known_files: DataFrame, boundaries: DataFrame, first_id: int = 1, aliases: dict | None = None) -> DataFrame:
    """Relations with their targets resolved. A name of this file targets it; a path that leaves the root drops the row.

    aliases: of ``load_aliases``, or None.
    """
    rows = numbered(_rows(parsed, "relations", _RELATION), ["project", "file_path", "_pos"], "id", first_id).withColumnRenamed("file_path", "src_file_path")
    named = resolve_imports(rows.where("specifier is not null").select("id", "src_file_path", "specifier"), known_files, **_alias_options(aliases)).select("id", F.col("dst_file_path").alias("_dst"), "is_external")
    rows = rows.join(named, "id", "left")
    outside = F.startswith(folded(F.concat_ws("/", F.regexp_replace("src_file_path", "/?[^/]*$", ""), F.col("specifier"))), F.lit("../")) & F.startswith("specifier", F.lit("."))
    rows = rows.where(~F.coalesce(outside, F.lit(False)))
    rows = rows.withColumn("dst_file_path", F.when(F.col("specifier").isNull(), F.col("src_file_path")).otherwise(F.col("_dst"))).withColumn("is_external", F.coalesce("is_external", F.lit(False)))
    targets = file_projects(rows.select(F.col("dst_file_path").alias("file_path")).where("file_path is not null").distinct(), boundaries)
    rows = rows.join(targets.select(F.col("file_path").alias("dst_file_path"), F.col("project").alias("dst_project")), "dst_file_path", "left")
    return _as(rows, schema.RELATIONS)


def _as(df: DataFrame, shape: str) -> DataFrame:
    columns: list[Column] = []
    for part in shape.split(", "):
        name, kind = part.split(" ", 1)
        columns.append(F.col(name).cast(kind).alias(name))
    return df.select(*columns)
