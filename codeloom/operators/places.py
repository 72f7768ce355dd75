"""Joins by place in a text: the next declaration after a comment, the node around an offset.

As-of joins deal both sides by file and go over them once in order, so a file's rows cost a
sort and not a product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def next_declaration(comments: DataFrame, declarations: DataFrame, within: int = 3) -> DataFrame:
    """id, symbol_name: the first declaration that starts after the comment's ``line``, ``within`` lines at most; else null.

    comments: id, file_path, line; declarations: file_path, start_line, name. Of several on one line the least name.
    """
    firsts = declarations.groupBy("file_path", "start_line").agg(F.min("name").alias("name"))
    rows = comments.select("file_path", F.col("line").alias("at"), F.lit(1).alias("side"), "id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("start"))
    rows = rows.unionByName(firsts.select("file_path", F.col("start_line").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), "name", F.col("start_line").alias("start")))
    # Backwards over a file: declarations of the comment's own line come before it and don't count.
    back = Window.partitionBy("file_path").orderBy(F.col("at").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("start").isNotNull(), F.struct("start", "name")), ignorenulls=True).over(back)
    found = rows.withColumn("_next", last).where("side = 1")
    return found.select("id", F.when(F.col("_next.start") - F.col("at") <= within, F.col("_next.name")).alias("symbol_name"))


def latest_comment(declarations: DataFrame, comments: DataFrame) -> DataFrame:
    """id (of the declaration), comment_id: the last comment that ends at or before its start with no declaration between.

    A comment of an earlier declaration's line belongs to that one's successor.
    """
    rows = declarations.select("file_path", F.col("start_line").alias("at"), F.lit(1).alias("side"), "id")
    rows = rows.unionByName(comments.select("file_path", F.col("line").alias("at"), F.lit(0).alias("side"), "id"))
    forward = Window.partitionBy("file_path").orderBy("at", "side", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.struct("side", "id"), ignorenulls=True).over(forward)
    found = rows.withColumn("_last", last).where("side = 1")
    return found.select("id", F.when(F.col("_last.side") == 0, F.col("_last.id")).alias("comment_id"))


def innermost_node(offsets: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, node_id: the narrowest node [start_at, end_at) of the file around each offset; no row where there is none. Ties: the least node.

    A node is cut into aligned blocks of 1, 2, 4, ... characters, two of a size at most, and each block
    keeps its narrowest node alone. An offset lies in one block of each size, so the work is the rows'
    number times the sizes', however many nodes stand around an offset.
    """
    start, end, at = (F.col(c).cast("long") for c in ("start_at", "end_at", "at"))
    best = F.when(F.col("id").isNotNull(), F.struct((end - start).alias("w"), F.col("id").alias("node_id")))
    spans = nodes.select("file_id", start.alias("_s"), end.alias("_e"), best.alias("_m")).where("_s < _e")
    sizes = (spans.agg(F.max(F.col("_e") - F.col("_s"))).first()[0] or 1).bit_length()
    block = lambda k, b: F.struct(F.lit(k).alias("k"), b.alias("b"))
    cuts = []
    for k in range(sizes):
        low, high = -F.shiftright(-F.col("_s"), k), F.shiftright("_e", k)  # whole blocks of 2**k characters inside
        odd = lambda b: b.bitwiseAND(F.lit(1)) == 1
        cuts += [F.when((low < high) & odd(low), block(k, low)), F.when((low < high) & odd(high), block(k, high - 1))]
    blocks = spans.select("file_id", "_m", F.explode(F.array_compact(F.array(*cuts))).alias("_b")).groupBy("file_id", "_b.k", "_b.b").agg(F.min("_m").alias("_m"))
    points = offsets.select("file_id", at.alias("_at")).distinct()
    points = points.select("file_id", "_at", F.explode(F.array(*[block(k, F.shiftright("_at", k)) for k in range(sizes)])).alias("_b")).select("file_id", "_at", "_b.k", "_b.b")
    met = points.join(blocks, ["file_id", "k", "b"]).groupBy("file_id", "_at").agg(F.min("_m").alias("_m"))
    found = offsets.select("id", "file_id", at.alias("_at")).join(met, ["file_id", "_at"])
    return found.groupBy("id").agg(F.min("_m").alias("_m")).select("id", F.col("_m.node_id").alias("node_id"))


def node_at_span(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, node_id of nodes with exactly that span; of several the one of the greatest id (the innermost)."""
    return spans.join(nodes.select("file_id", "start_at", "end_at", F.col("id").alias("node_id")), ["file_id", "start_at", "end_at"]).groupBy("id").agg(F.max("node_id").alias("node_id"))


def comment_tags(comments: DataFrame) -> DataFrame:
    """id, tag, value: the first ``@tag`` of each comment; comments without one drop out."""
    # Fixed value: what counts as a tag.
    tag = r"(?m)(?:^|\s)@([a-zA-Z][\w-]*\w|[a-zA-Z])\s*(.*)$"
    found = comments.select("id", F.regexp_extract("text", tag, 1).alias("tag"), F.regexp_extract("text", tag, 2).alias("value"))
    return found.where("tag != ''")


def merged_line_comments(comments: DataFrame) -> DataFrame:
    """file_path, line, end_line, text: a tagged line comment with the untagged ones on the lines right after it."""
    w = Window.partitionBy("file_path").orderBy("line", "id")
    tagged = F.col("text").rlike(r"(?:^|\s)@[a-zA-Z]")
    starts = comments.withColumn("_new", (tagged | (F.coalesce(F.col("line") - F.lag("line").over(w), F.lit(9)) != 1)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = starts.groupBy("file_path", "_run").agg(F.min("line").alias("line"), F.max("line").alias("end_line"), F.array_sort(F.collect_list(F.struct("line", "id", "text"))).alias("_t"))
    return runs.select("file_path", "line", "end_line", F.array_join(F.col("_t.text"), " ").alias("text")).where(F.col("text").rlike(r"(?:^|\s)@[a-zA-Z]"))
