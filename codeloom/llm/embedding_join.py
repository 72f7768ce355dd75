"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine c or more lie within eps = sqrt(2 - 2c) of each other. Vectors are
turned to principal axes and sorted by the cells, of side eps, of their leading coordinates.
The sorted sequence is cut into blocks, and blocks stand in a tree of intervals with bounding
boxes. Pairs of intervals are joined recursively: a pair whose boxes lie further apart than
eps is skipped with all that it holds. What is left is a list of block pairs, each compared
by matrix products in one task, after the same recursion over the blocks' own parts.

The axes only steer what is skipped: they may come from a bounded sample, and every vector
is compared in its own coordinates, in double precision. Vectors of single-precision numbers
are exchanged as such, which loses nothing.

How much is skipped depends on the data. Boxes of vectors that spread alike over many
dimensions all lie within eps of each other, so every two blocks meet; blocks are as large as
memory allows, so that each vector is then sent to as few others as can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.components import connected_components
from codeloom.llm.scratch import cut, small_or_not

BLOCK_BYTES, LEAF, FANOUT = 2 << 20, 128, 8
CELL_DIMS, BOX_DIMS = 6, 16
SMALL_ROWS = 500_000


def principal_axes(vectors: DataFrame, dims: int, sample: int = 10_000) -> np.ndarray:
    """Orthonormal axes (columns, by falling variance) of ``sample`` unit vectors at most, chosen by a hash of the key."""
    rows = vectors.where(F.size("v") == dims).orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()
    x = _unit(np.array([r.v for r in rows], np.float64))
    values, axes = np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(dims))
    return np.atleast_2d(axes)[:, ::-1]


def _unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)  # first by the largest part, so that squares neither overflow nor vanish
    x = raw / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _number(vectors: DataFrame) -> str:
    """float or double: the kind of the numbers of column v."""
    return dict(vectors.dtypes)["v"][6:-1]


def _ordered(vectors: DataFrame, dims: int, axes: np.ndarray, eps: float) -> DataFrame:
    """key, m, v, cells for vectors of ``dims`` numbers: cells of the leading axes, to sort by."""
    shared = vectors.sparkSession.sparkContext.broadcast(axes[:, :CELL_DIMS])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("v").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, dims))
            y = x @ shared.value
            grid = np.floor(y / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("m"), batch.column("v"), pa.array(list(grid), pa.list_(pa.int32())), pa.array(y[:, -1])],
                names=["key", "m", "v", "cells", "y"],
            )

    return vectors.where(F.size("v") == dims).mapInArrow(cells, f"key long, m long, v array<{_number(vectors)}>, cells array<int>, y double")


def _blocks(ordered: DataFrame, dims: int, axes: np.ndarray) -> DataFrame:
    """Runs of vectors of the sorted sequence, of BLOCK_BYTES together, each one row: part, chunk, keys, counts, vectors (bytes), low, high (box)."""
    kind = "<f4" if _number(ordered) == "float" else "<f8"
    size = max(LEAF, BLOCK_BYTES // (dims * int(kind[-1])))
    shared = ordered.sparkSession.sparkContext.broadcast(axes[:, :BOX_DIMS])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def row(k: int) -> pa.RecordBatch:
            keys, m, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held[:] = [(keys[k:], m[k:], v[k:])] if k < len(keys) else []
            keys, m, v = keys[:k], m[:k], v[:k]
            y = _unit(v.astype(np.float64)) @ shared.value
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([keys.astype("<i8").tobytes()]), pa.array([m.astype("<i8").tobytes()]), pa.array([v.astype(kind).tobytes()]),
                 pa.array([y.min(axis=0)], pa.list_(pa.float64())), pa.array([y.max(axis=0)], pa.list_(pa.float64()))],
                names=["part", "chunk", "keys", "counts", "vectors", "low", "high"],
            )

        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dims)
                held.append((batch.column("key").to_numpy(), batch.column("m").to_numpy(), v))
            while sum(len(h[0]) for h in held) >= size:
                yield row(size)
                chunk += 1
        if held and sum(len(h[0]) for h in held):
            yield row(size)

    dealt = ordered.repartitionByRange("cells", "y", "key").sortWithinPartitions("cells", "y", "key").select("key", "m", "v")
    made = cut(dealt.mapInArrow(runs, "part int, chunk long, keys binary, counts binary, vectors binary, low array<double>, high array<double>"), "blocks")
    per_part = made.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return cut(made.join(F.broadcast(starts), "part").withColumn("block", F.col("_start") + F.col("chunk")).drop("part", "chunk", "_start"), "blocks")


def _spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) of a matrix of links that join all that its links join, about one for each row and column."""
    rows, cols = hit.shape
    u, w = np.nonzero(hit)
    if len(u) <= rows + cols:
        return u, w
    # Links of a row to its least column and of a column to its least row, and one for each pair of labels that these leave apart.
    first_col, first_row = hit.argmax(axis=1), hit.argmax(axis=0)
    r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    u, w = np.concatenate([r, first_row[c]]), np.concatenate([first_col[r], c])
    while True:
        part = _roots(rows + cols, u, w + rows)
        apart = hit & (part[:rows, None] != part[None, rows:])
        if not apart.any():
            return u, w
        x, y = np.nonzero(apart)
        _, pick = np.unique(part[x], return_index=True)
        u, w = np.concatenate([u, x[pick]]), np.concatenate([w, y[pick]])


def _roots(n: int, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the edges (u, w) lead to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[w])
        new = root.copy()
        for at in (root[u], root[w], u, w):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near(eps: float):
    gap = F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= F.lit(eps * eps * (1 + 1e-9))


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """a, b (a <= b): block pairs that the recursion over intervals leaves."""
    levels = [blocks.select("block", "low", "high")]
    n = blocks.count()
    while n > 1:
        up = levels[-1].groupBy(F.floor(F.col("block") / FANOUT).cast("long").alias("block"))
        spread = [f"array({', '.join(f'{f}({c}[{i}])' for i in range(BOX_DIMS))}) AS {c}" for f, c in (("min", "low"), ("max", "high"))]
        levels.append(cut(up.agg(*[F.expr(s.split(" AS ")[0]).alias(s.split(" AS ")[1]) for s in spread]), "intervals"))
        n = -(-n // FANOUT)
    pairs = levels[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    for level in reversed(levels[:-1]):
        left = level.select(F.col("block").alias("a2"), "low", "high", F.floor(F.col("block") / FANOUT).cast("long").alias("a"))
        right = level.select(F.col("block").alias("b2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.floor(F.col("block") / FANOUT).cast("long").alias("b"))
        pairs = cut(pairs.join(left, "a").join(right, "b").where((F.col("a2") <= F.col("b2")) & _near(eps)).select(F.col("a2").alias("a"), F.col("b2").alias("b")), "pairs")
    return pairs


def _join_blocks(pairs: DataFrame, blocks: DataFrame, dims: int, axes: np.ndarray, cosine: float, kind: str) -> DataFrame:
    """For each block pair: key, n (linked vectors of the other block, by their counts), root (a key for each part that the links join)."""
    shared = blocks.sparkSession.sparkContext.broadcast(axes[:, :BOX_DIMS])
    eps2 = (2 - 2 * cosine) * (1 + 1e-9)

    def boxes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(y), LEAF)
        return np.minimum.reduceat(y, at, axis=0), np.maximum.reduceat(y, at, axis=0)

    def links(row: dict) -> pd.DataFrame:
        same = row["a"] == row["b"]
        ka, kb = (np.frombuffer(row[k], "<i8") for k in ("keys_a", "keys_b"))
        ma, mb = (np.frombuffer(row[k], "<i8") for k in ("counts_a", "counts_b"))
        va, vb = (np.frombuffer(row[k], kind).astype(np.float64).reshape(-1, dims) for k in ("vectors_a", "vectors_b"))
        xa, xb = _unit(va), _unit(vb)
        la, ha = boxes(xa @ shared.value)
        lb, hb = boxes(xb @ shared.value)
        na, nb = np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64)
        keys = ka if same else np.concatenate([ka, kb])
        shift = 0 if same else len(ka)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(len(la)):
            gap = np.maximum(0, np.maximum(la[i] - hb, lb - ha[i]))
            ra = slice(i * LEAF, min((i + 1) * LEAF, len(ka)))
            near = np.flatnonzero((gap * gap).sum(axis=1) <= eps2)
            if same:
                near = near[near >= i]
            for j in near:
                rb = slice(j * LEAF, min((j + 1) * LEAF, len(kb)))
                c = xa[ra] @ xb[rb].T
                hit = c >= cosine
                for p, q in np.argwhere(np.abs(c - cosine) < 1e-12):  # too close to tell from unit vectors
                    u, w = va[ra][p], vb[rb][q]
                    hit[p, q] = u @ w / (np.linalg.norm(u) * np.linalg.norm(w)) >= cosine
                if same and i == j:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                na[ra] += hit @ mb[rb]
                if not (same and i == j):
                    nb[rb] += ma[ra] @ hit
                u, w = _spanning(hit)
                ends.append((u + ra.start, w + rb.start + shift))
        if not ends:
            return pd.DataFrame({"key": [], "n": [], "root": []}).astype("int64")
        root = _roots(len(keys), *(np.concatenate(x) for x in zip(*ends, strict=True)))
        n = na + nb if same else np.concatenate([na, nb])
        some = n > 0
        return pd.DataFrame({"key": keys[some], "n": n[some], "root": keys[root[some]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield links(row)

    side = {s: blocks.select(F.col("block").alias(s), F.col("keys").alias(f"keys_{s}"), F.col("counts").alias(f"counts_{s}"), F.col("vectors").alias(f"vectors_{s}")) for s in "ab"}
    rows = pairs.join(side["a"], "a").join(side["b"], "b")
    return rows.mapInPandas(run, "key long, n long, root long")


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """``key, n_links, component_id, kept`` for each row of ``vectors``.

    Rows link when the cosine of their vectors, in double precision, is ``cosine`` or more.
    Equal vectors are compared once and counted as often as they occur. Vectors that are
    null, empty, zero or hold null or non-finite parts link with nothing, nor do vectors of
    different lengths. A null key gets no links and a null component. An empty table gives
    no rows.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(kind).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    is_good = F.col("key").isNotNull() & F.coalesce(sound, F.lit(False))
    good = rows.where(is_good)
    classes = cut(good.groupBy("v").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("m")), "classes")
    eps = float(np.sqrt(2 - 2 * cosine))
    found: DataFrame | None = None
    for (dims,) in sorted(classes.select(F.size("v")).distinct().collect()):
        axes = principal_axes(classes.select("key", "v"), dims)
        boxed = np.zeros((dims, max(BOX_DIMS, dims)))
        boxed[:, :dims] = axes  # vectors of fewer numbers than a box has get zeros
        blocks = _blocks(_ordered(classes, dims, axes, eps), dims, boxed)
        part = _join_blocks(_block_pairs(blocks, eps), blocks, dims, boxed, cosine, "<f4" if _number(classes) == "float" else "<f8")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    links = cut(found.groupBy("key", "root").agg(F.sum("n").alias("n")), "links")
    component = connected_components(links, "key", "root").withColumnRenamed("node", "key")
    sums = links.groupBy("key").agg(F.sum("n").alias("n"))
    of_class = classes.join(sums, "key", "left").join(component, "key", "left")
    of_class = cut(of_class.select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "key").alias("component_id")), "classes")
    # Rows that can't link are set aside, as they would all be of one null key in the join.
    linked = good.join(of_class, "v").select("key", "n_links", "component_id")
    alone = rows.where(~is_good).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("key").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
