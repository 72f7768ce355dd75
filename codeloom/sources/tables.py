"""Written tables: lineage cuts, and versioned tables whose current version is named by a small manifest.

A change writes whole new files for the tables it touches and then one manifest of the next
number; readers take the manifest of the highest number, so a failed write is never seen and
no manifest is ever replaced. The last few versions stay for readers that are under way.
"""

from __future__ import annotations

import functools
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.errors import LoomError

KEPT = 3  # versions that stay readable


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="codeloom-tables-")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of spark.checkpoint.dir (one of our own only where that is unset and all runs in this process)."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise LoomError("store", "spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = (named or _own_folder()).rstrip("/")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], out: str, first: int = 1) -> DataFrame:
    """Adds ``out``: first, first + 1, ... in the given order, without bringing the rows together.

    Rows are dealt by ranges and written; the ranges' counts, a tiny table, give their starts.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id counts a partition's rows in its low bits
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(low))), "numbered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").withColumn(out, (F.col("_s") + F.col("_i") + first).cast("long")).drop("_p", "_i", "_s")


class TableStore:
    """Named tables under one folder, with versions and a manifest. ``commit`` replaces several tables at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, text: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Numbers of the manifests, in order."""
        fs, folder = self._fs(), self._path(f"{self.folder}/manifests")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict[str, str]:
        text = "".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifests/{version}.json").collect())
        try:
            return json.loads(text)
        except ValueError as e:
            raise LoomError("store", f"manifest {version} of {self.folder} can't be read") from e

    def manifest(self) -> dict[str, str]:
        """Table name to folder; empty for a new store. A manifest that can't be read is an error, never an empty store."""
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else {}

    def read(self, name: str, schema: str) -> DataFrame:
        at = self.manifest().get(name)
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}")

    def commit(self, tables: dict[str, DataFrame], partition_by: str | None = "project") -> None:
        versions = self._versions()
        new = self._manifest(versions[-1]) if versions else {}
        for name, df in tables.items():
            new[name] = f"{name}/{uuid.uuid4().hex}"
            writer = df.write.partitionBy(partition_by) if partition_by and partition_by in df.columns else df.write
            writer.parquet(f"{self.folder}/{new[name]}")
        fs, version = self._fs(), (versions[-1] if versions else 0) + 1
        target, temporary = self._path(f"{self.folder}/manifests/{version}.json"), self._path(f"{self.folder}/manifests/{uuid.uuid4().hex}.tmp")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        # A name that is taken means that another writer came first.
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            raise LoomError("store", f"version {version} of {self.folder} was written by another session")
        self._expire([*versions, version])

    def _expire(self, versions: list[int]) -> None:
        """Drops all versions but the last KEPT, and the tables that only they name."""
        fs, old, kept = self._fs(), versions[:-KEPT], versions[-KEPT:]
        if old:
            used = {at for v in kept for at in self._manifest(v).values()}
            for v in old:
                for at in set(self._manifest(v).values()) - used:
                    fs.delete(self._path(f"{self.folder}/{at}"), True)
                fs.delete(self._path(f"{self.folder}/manifests/{v}.json"), False)

    def drop(self) -> None:
        self._fs().delete(self._path(self.folder), True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of equal keys replaced by ``rows`` and new ones added."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def replace_of_files(table: DataFrame, files: DataFrame, rows: DataFrame, file_column: str = "file_path") -> DataFrame:
    """``table`` with all rows of ``files`` (project, file_path) replaced by ``rows``."""
    gone = files.select("project", F.col("file_path").alias(file_column))
    return table.join(gone, ["project", file_column], "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def default_dst_project(relations: DataFrame) -> DataFrame:
    """A target without a project lies in its source's; no target, no project."""
    return relations.withColumn("dst_project", F.coalesce("dst_project", F.when(F.col("dst_file_path").isNotNull(), F.col("project"))))


def cascade_delete(files: DataFrame, symbols: DataFrame, relations: DataFrame, annotations: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files of ``gone`` (project, file_path), their rows, and relations into them."""
    out = {n: t.join(gone, ["project", "file_path"], "left_anti").select(*t.columns) for n, t in (("files", files), ("symbols", symbols), ("annotations", annotations))}
    src = gone.select("project", F.col("file_path").alias("src_file_path"))
    dst = gone.select(F.col("project").alias("dst_project"), F.col("file_path").alias("dst_file_path"))
    kept = relations.join(src, ["project", "src_file_path"], "left_anti").join(dst, ["dst_project", "dst_file_path"], "left_anti")
    return out | {"relations": kept.select(*relations.columns)}


def retarget(relations: DataFrame, moved: DataFrame) -> DataFrame:
    """Relations into moved symbols, pointed to where these are now.

    moved: dst_project, old_file, old_symbol (null: matches null only), new_file, new_symbol, new_project (null: unchanged).
    """
    m = moved.select(F.col("dst_project").alias("_p"), F.col("old_file").alias("_of"), F.col("old_symbol").alias("_os"), "new_file", "new_symbol", "new_project", F.lit(True).alias("_hit"))
    hit = (F.col("dst_project") == F.col("_p")) & (F.col("dst_file_path") == F.col("_of")) & F.col("dst_symbol_name").eqNullSafe(F.col("_os"))
    out = relations.join(m, hit, "left")
    new = {"dst_file_path": F.col("new_file"), "dst_symbol_name": F.col("new_symbol"), "dst_project": F.coalesce("new_project", "dst_project")}
    return out.select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in relations.columns])


def pruned(changelog: DataFrame, before: str, project: str | None = None) -> DataFrame:
    """``changelog`` without what changed before an ISO time (that time itself stays)."""
    old = F.col("changed_at") < before
    return changelog.where(~(old if project is None else old & (F.col("project") == project)))
