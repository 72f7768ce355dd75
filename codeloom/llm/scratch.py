"""Tables in the folder that driver and executors share, and small helpers on joins and ranks.

``cut`` writes a DataFrame as Parquet and reads it back, which ends its lineage: a lost
executor costs nothing, since the files are in the cluster's own shared store.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="codeloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of our own, but only if all runs in this one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_folder()).rstrip("/")


def drop_table(table: DataFrame) -> None:
    """Deletes a table that ``cut`` wrote and that no plan needs any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def drop_tables(tables: list[DataFrame]) -> None:
    for table in tables:
        drop_table(table)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20


def small_or_not(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast only if its rows are at most ``max_rows`` and hold at most ``max_bytes``, counted here.

    Beyond that the join is left to a shuffle, with the same result. ``df`` should be a written
    table, since it is read for the count.
    """
    kinds = dict(df.dtypes)
    width = F.lit(16 * len(kinds))
    for name, kind in kinds.items():
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif "<" in kind:
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def salts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps among the rows of equal ``keys``.

    A key of any size is dealt over as many salts as there are shuffle partitions: ranks
    within a salt come from a window, and the salts' counts (a tiny table) give their starts.
    """
    n = salts(df.sparkSession)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    rows = salted.withColumn("_in_salt", F.row_number().over(within) - 1)
    return (
        rows.join(starts, [*keys, "_salt"])
        .withColumn(out, (F.col("_in_salt") + F.col("_start")).cast("long"))
        .drop("_salt", "_in_salt", "_start")
    )


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the fast built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
