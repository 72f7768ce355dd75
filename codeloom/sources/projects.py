"""Project boundaries, file scans and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import glob_regex

# What is scanned by default, and folders that no scan enters.
EXTENSIONS = (".ts", ".mts", ".cts")
SKIPPED = ("node_modules", ".git", "dist", ".codeloom")


def discover_projects(spark: SparkSession, root: str) -> DataFrame:
    """dir, project for each package.json below ``root``, the longest dir first; ``.`` for the root's own."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace(".", r"\.") + "/?", "")
    folder = F.regexp_replace(rel, "/?package\\.json$", "")
    inside = ~F.exists(F.split(rel, "/"), lambda p: p.isin(*SKIPPED))
    shown = F.when(folder == "", ".").otherwise(folder)
    name = F.coalesce(F.get_json_object(F.col("content").cast("string"), "$.name"), F.when(folder == "", base.rsplit("/", 1)[-1]).otherwise(F.element_at(F.split(folder, "/"), -1)))
    return found.where(inside).select(shown.alias("dir"), name.alias("project")).orderBy(F.length("dir").desc(), "dir")


def file_projects(paths: DataFrame, boundaries: DataFrame, root_project: str = "default") -> DataFrame:
    """``paths`` (file_path, ...) with ``project``: that of the longest boundary around the path.

    A path's own prefixes are joined with the boundaries by equality, so nothing is broadcast by force.
    """
    parts = F.split("file_path", "/")
    prefixes = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    each = paths.select("file_path", F.explode(prefixes).alias("dir")).distinct().join(boundaries, "dir")
    best = each.groupBy("file_path").agg(F.max(F.struct(F.when(F.col("dir") == ".", 0).otherwise(F.length("dir")).alias("n"), "project")).alias("_b"))
    return paths.join(best, "file_path", "left").withColumn("project", F.coalesce("_b.project", F.lit(root_project))).drop("_b")


def in_scope(path: Column, extensions: tuple[str, ...] = EXTENSIONS, ignore: list[str] | None = None) -> Column:
    """Whether a path has one of the extensions, lies outside node_modules and matches no ignored glob."""
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(path, F.lit(e))
    for pattern in ["**/node_modules/**", *(ignore or [])]:
        out = out & ~path.rlike(glob_regex(pattern))
    return out


def detect_changes(scan: DataFrame, files: DataFrame) -> DataFrame:
    """project, file_path, status: changed, unchanged or deleted.

    scan: project, file_path, mtime_ms, size, content_hash. Equal time and size is unchanged
    without a look at the hash; otherwise an equal hash is.
    """
    keys = ["project", "file_path"]
    new = scan.select(*keys, F.col("mtime_ms").alias("_m"), F.col("size").alias("_s"), F.col("content_hash").alias("_h"), F.lit(True).alias("_new"))
    old = files.select(*keys, "mtime_ms", "size", "content_hash", F.lit(True).alias("_old"))
    same = (F.col("_m") == F.col("mtime_ms")) & (F.col("_s") == F.col("size"))
    status = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "changed").when(same | (F.col("_h") == F.col("content_hash")), "unchanged").otherwise("changed")
    return new.join(old, keys, "full_outer").select(*keys, status.alias("status"))


def _rows(found: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace(".", r"\.") + "/", "")
    return found.select(rel.alias("file_path"), (F.unix_micros("modificationTime") / 1000).alias("mtime_ms"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, ignore: list[str] | None = None) -> DataFrame:
    """file_path (relative), mtime_ms, size, content of a tree's source files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    return _rows(found, root).where(in_scope(F.col("file_path"), extensions, ignore))


def read_files(spark: SparkSession, root: str, paths: list[str], extensions: tuple[str, ...] = EXTENSIONS, ignore: list[str] | None = None) -> DataFrame:
    """The same for a few files by their relative paths; those that aren't there give no row. Nothing else is listed or read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole = [f"{root.rstrip('/')}/{p}" for p in paths]
    there = [p for p in whole if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.createDataFrame([], "file_path string, mtime_ms double, size long, content string")
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(there)
    return _rows(found, root).where(in_scope(F.col("file_path"), extensions, ignore))


def lease_role(pid: Column, alive: Column, age_s: Column, instance: Column, own_pid: Column, own_instance: Column, stale_s: int = 60) -> Column:
    """owner if there is no owner, it died, its heartbeat is stale, or its process id was used again by us; else reader."""
    free = pid.isNull() | ~alive | (age_s >= stale_s) | ((pid == own_pid) & (instance != own_instance))
    return F.when(free, "owner").otherwise("reader")
