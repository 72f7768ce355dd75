"""Token ids in Parquet: list columns in ascending key order, dictionary encoded, with page indexes.

A data set is a folder of Parquet files, each with a run of consecutive documents:
``doc_id, part, start_in_part, n_tokens, tokens``. Ids take a page dictionary (16 bits an id
for a vocabulary of 50,000), counts and starts delta encoding (format version 2), and every
column chunk has Parquet's column and offset indexes, so a reader takes the counts without
the ids, or the ids of a few documents by their page ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.scratch import new_path
from codeloom.llm.tokens import by_bytes, chunk_tokenizer, crc

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> str:
    """Encodes ``docs`` (doc_id, text; null text: empty) and writes them, ordered by doc_id; gives the folder.

    Rows of equal doc_id stay neighbours, ordered by a hash of the text, by which any number of
    them is dealt over tasks. Null doc_ids come first. An empty table gives a folder without rows.
    """
    path = path or new_path(docs.sparkSession, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        tok = chunk_tokenizer(tokenizer)
        for batch in batches:
            for first, stop in by_bytes(batch.column(1)):
                n = stop - first
                ids, stops = tok.encode_column(batch.column(1).slice(first, n), end_id)
                starts = np.concatenate([[0], stops[:-1]])
                tokens = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.full(n, part, np.int32)), pa.array(at + starts), pa.array(stops - starts), tokens],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"],
                )
                at += len(ids)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    (
        ordered.mapInArrow(encode, SCHEMA).write
        .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes))
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true").option("compression", "zstd")
        .option("parquet.enable.dictionary#n_tokens", "false").option("parquet.enable.dictionary#start_in_part", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .parquet(path)
    )
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens: the scan reads these two columns and no ids."""
    return read_token_files(spark, path).select("doc_id", "n_tokens")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id, tokens of the doc_ids from ``first`` to ``last``.

    The filter reaches the scan, which skips row groups by their statistics and, in the rest,
    reads the pages alone whose index entries overlap the range.
    """
    return read_token_files(spark, path).where(F.col("doc_id").between(first, last)).select("doc_id", "tokens")


def document_starts(tokens: DataFrame) -> DataFrame:
    """``part, part_start``: ids in all files before this part, from the counts alone (no ids are read)."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("part_start"))


def token_digest(tokens: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sums = np.fromiter((crc(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.int64, len(ends) - 1)
            counts = np.diff(ends).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), pa.array(counts), pa.array(sums)], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    rows = tokens.mapInArrow(digest, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(document_starts(tokens)), "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
