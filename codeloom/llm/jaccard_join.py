"""Exact n-gram Jaccard self-join through a token-group matrix.

A document's set is its distinct word shingles. Equal sets form one class, and only a
class's least document goes on. Tokens (shingles) have one order for all documents: rare
ones first, by counts over the whole corpus. Two sets of similarity t or more then share a
token among the first ``n - ceil(t n) + 1`` of each, so only these are exchanged.

1. Groups of similar documents: each joins the leader (least document of a token) with which
   it shares most first tokens. Groups are cut into blocks of bounded size, and each block is
   opened once: all its pairs are compared, its group's leader among them.
2. Documents linked so far form components. The matrix has a cell for each first token and
   block. A document queries the blocks that share first tokens with it through members of
   other components; the larger component's blocks are queried. At a block, the overlap with
   the union of the block's tokens bounds every member's overlap, and only blocks whose bound
   reaches the threshold are opened, for an exact comparison.

Every pair of the threshold is found: pairs within a component need no link of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import connected_components
from codeloom.llm.scratch import cut, small_or_not

COUNT_BITS = 18
BLOCK_DOCS, BLOCK_TOKENS = 64, 200_000
QUERY_TOKENS = 400_000
SMALL_ROWS = 1_000_000
_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words has one, of all its words; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        x = w[i : i + len(h)]
        h += (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _token_counts(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Occurrences in all documents of tokens by the first COUNT_BITS of their hash: an array of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(total, (shingle_set(t, size) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    summed = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def _sets(docs: DataFrame, key: str, text: str, size: int, counts: np.ndarray, percent: int) -> DataFrame:
    """key, n (set size), fp (of the set), firsts (tokens to exchange, each with its rank by count in the high byte)."""
    level = np.minimum(255, np.round(8 * np.log2(np.maximum(1, counts / max(1.0, counts.mean()))))).astype(np.uint64) << np.uint64(56)
    ranks = docs.sparkSession.sparkContext.broadcast(level)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            n, fp, firsts = [], [], []
            for t in batch.column(1).to_pylist():
                h = shingle_set(t, size)
                tokens = np.sort(rank[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] | (h >> np.uint64(8)))
                n.append(len(h))
                fp.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
                firsts.append(tokens[: len(h) - -(-percent * len(h) // 100) + 1 if len(h) else 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], names=["key", "n", "fp", "firsts"])

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(build, "key long, n long, fp binary, firsts array<long>")


def _links(tokens: list[np.ndarray], keys: np.ndarray, queries: list[np.ndarray], query_keys: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Exact links of a block's members, or of queries with them, as stars: a pair for each link that joins something."""
    union, where = np.unique(np.concatenate(tokens), return_inverse=True)
    sizes = np.array([len(t) for t in tokens])
    matrix = np.zeros((len(tokens), len(union)), np.float32)
    matrix[np.repeat(np.arange(len(tokens)), sizes), where] = 1
    found: list[tuple[int, int]] = []
    own = not queries
    for i, q in enumerate(tokens if own else queries):
        at = np.searchsorted(union, q)
        inside = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == q)]
        if 100 * len(inside) < percent * len(q):  # the group's bound: no member can reach the threshold
            continue
        both = matrix[i + 1 :, inside].sum(axis=1) if own else matrix[:, inside].sum(axis=1)
        other = sizes[i + 1 :] if own else sizes
        both = np.rint(both).astype(np.int64)
        linked = np.flatnonzero(100 * both >= percent * (len(q) + other - both))
        me, them = (keys[i], keys[i + 1 :]) if own else (query_keys[i], keys)
        found += [(int(me), int(them[j])) for j in linked if them[j] != me]
    return found


def _open_blocks(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links of blocks. rows: block, part, key, text, asks (true for queries, false for members).

    Sets are made anew from the texts on the side of the scan, and only sets are exchanged.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, np.ndarray] = {}
            made = []
            for t in batch.column("text").to_pylist():
                if t not in sets:
                    sets = {t: shingle_set(t, size)}
                made.append(sets[t].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "part", "key", "asks")), pa.array(made, pa.list_(pa.int64()))], names=["block", "part", "key", "asks", "tokens"])

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["key", "asks"])
        sets = [np.asarray(t).view(np.uint64) for t in block["tokens"]]
        keys, asks = block["key"].to_numpy(np.int64), block["asks"].to_numpy(bool)
        members = [s for s, q in zip(sets, asks, strict=True) if not q]
        asking = [s for s, q in zip(sets, asks, strict=True) if q]
        if not members or (asks.any() and not asking) or (not asks.any() and len(members) < 2):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        pairs = _links(members, keys[~asks], asking, keys[asks], percent)
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    sets = rows.select("block", "part", "key", "asks", "text").mapInArrow(to_sets, "block long, part int, key long, asks boolean, tokens array<long>")
    return sets.groupBy("block", "part").applyInPandas(compare, "a long, b long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id`` for each row of ``docs``.

    Documents link when their sets' Jaccard similarity is ``percent`` / 100 or more.
    component_id is the least key reachable by links, itself included. Null or wordless
    texts have an empty set and link with nothing; a null key gets a null component. Rows
    of one key are one node. An empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    counts = _token_counts(docs, "text", size)
    sets = cut(_sets(docs, "key", "text", size, counts, percent), "sets")

    # Classes of equal sets, by a 128-bit fingerprint and the size.
    whole = sets.where("n > 0 and key is not null")
    classes = cut(whole.groupBy("fp", "n").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("_m")), "classes")
    reps = small_or_not(classes.select(F.col("rep").alias("key")), SMALL_ROWS)
    firsts = whole.join(reps, "key", "left_semi").select("key", "n", F.explode("firsts").alias("token"))

    # A token that two classes have: its least class leads. Tokens of one class alone drop out here.
    postings = firsts.select("token", "key", "n")
    shared = cut(_shared_tokens(postings), "shared")
    leaders = shared.where("key != leader").groupBy("key", "leader").agg(F.count(F.lit(1)).alias("_n"), F.first("n").alias("n"), F.first("leader_n").alias("leader_n"))
    # Which group a document joins decides work alone, not results: like sets share about a third of their first tokens or more.
    leaders = leaders.where(3 * 100 * F.col("_n") >= (100 - percent) * F.least("n", "leader_n"))
    best = leaders.groupBy("key").agg(F.max(F.struct(F.col("_n"), (-F.col("leader")).alias("l"))).alias("_b")).select("key", (-F.col("_b.l")).alias("leader"))
    nodes = shared.groupBy("key").agg(F.first("n").alias("n"))
    grouped = nodes.join(best, "key", "left").withColumn("leader", F.coalesce("leader", "key"))
    top = grouped.select(F.col("key").alias("leader"), F.col("leader").alias("_up"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.05))).cast("int")
    grouped = cut(grouped.join(top, "leader").select("key", "n", F.col("_up").alias("leader"), band.alias("band")), "grouped")

    # Blocks of bounded size, each of sets about as large as each other; every block of a group also has the group's leader.
    totals = grouped.groupBy("leader", "band").agg(F.count(F.lit(1)).alias("_docs"), F.sum("n").alias("_tokens"), F.max(F.col("key") != F.col("leader")).alias("_more"))
    n_blocks = F.ceil(F.greatest(F.col("_docs") / BLOCK_DOCS, F.col("_tokens") / BLOCK_TOKENS)).cast("int")
    totals = cut(totals.withColumn("_blocks", n_blocks), "totals")
    blocks = grouped.join(totals, ["leader", "band"]).select("key", "n", F.xxhash64("leader", "band", F.pmod(F.xxhash64("key"), F.col("_blocks"))).alias("block"), "_more")
    blocks = cut(blocks, "blocks")
    with_leader = totals.where("_more").select(F.col("leader").alias("key"), F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: F.xxhash64("leader", "band", i.cast("long")))).alias("block"))
    members = blocks.where("_more").select("key", "block").unionByName(with_leader).distinct()
    linked = cut(_open_blocks(_with_texts(docs, members.withColumn("part", F.lit(0)).withColumn("asks", F.lit(False))), size, percent), "links")
    found = connected_components(linked)

    # The matrix: first tokens by block and component; queries go where another component is.
    state = blocks.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    state = cut(state.select("key", "n", "block", "component"), "state")
    weight = state.groupBy("component").agg(F.count(F.lit(1)).alias("_w"))
    state = cut(state.join(cut(weight, "weight"), "component"), "state")
    cells = shared.select("token", "key").join(state, "key")
    spread = cut(cells.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("token"), "spread")
    cells = cut(cells.join(small_or_not(spread, SMALL_ROWS), "token", "left_semi"), "cells")
    asking = cells.select("token", F.col("key").alias("q"), F.col("n").alias("qn"), F.struct(F.col("_w"), F.col("component")).alias("_mine"))
    matrix = cells.groupBy("token", "block", F.struct(F.col("_w"), F.col("component")).alias("_theirs")).agg(F.min("n").alias("_least"), F.max("n").alias("_most"))
    can = (F.col("_mine") < F.col("_theirs")) & (100 * F.col("qn") >= percent * F.col("_least")) & (100 * F.col("_most") >= percent * F.col("qn"))
    met = asking.join(matrix, "token").where(can).groupBy("q", "block").agg(F.count(F.lit(1)).alias("_n"), F.first("qn").alias("n"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    needed = _least_shared_in(F.col("n"), F.col("_least"), F.col("_most"), percent)
    asks = cut(met.where(F.col("_n") >= needed).select(F.col("q").alias("key"), "n", "block"), "asks")
    if not asks.isEmpty():
        per = cut(asks.groupBy("block").agg(F.ceil(F.sum("n") / QUERY_TOKENS).cast("int").alias("_parts")), "parts")
        queries = asks.join(per, "block").select("key", "block", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int").alias("part"), F.lit(True).alias("asks"))
        asked = blocks.join(per, "block").select("key", "block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(False).alias("asks"))
        more = cut(_open_blocks(_with_texts(docs, queries.unionByName(asked)), size, percent), "links")
        found = connected_components(linked.unionByName(more))

    of_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_class = cut(of_class.select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "classes")
    return (
        sets.select("key", "n", "fp").join(small_or_not(of_class, SMALL_ROWS // 2), ["fp", "n"], "left")
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))
    )


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """How many of their first tokens two sets of these sizes must share to reach the threshold, 1 at least.

    They must share ``o = ceil(t (n + m) / (1 + t))`` tokens. Up to the last first token of
    the set whose first tokens end earlier, all shared ones are first tokens of both; beyond
    it that set has ``ceil(t n) - 1`` tokens left.
    """
    up = lambda x: F.ceil(x).cast("long")
    both = up(F.lit(percent) * (n + m) / F.lit(100 + percent))
    return F.greatest(both - F.greatest(up(F.lit(percent) * n / F.lit(100)), up(F.lit(percent) * m / F.lit(100))) + 1, F.lit(1))


def _least_shared_in(n: Column, least: Column, most: Column, percent: int) -> Column:
    """The least of ``_least_shared`` over all sizes from least to most.

    Up to n it never falls as m grows. From n on it falls by t t / (1 + t) a size, but the two
    ceilings may move it by less than 1 each way, so a size before the last may need one less:
    only sizes within (1 + t) / (t t) of the last can.
    """
    near_end = -(-100 * (100 + percent) // percent**2)
    if near_end > 16:  # one less than at the ends is never too much
        ends = F.least(_least_shared(n, least, percent), _least_shared(n, most, percent))
        return F.greatest(ends - 1, F.lit(1))
    return F.least(_least_shared(n, least, percent), *[_least_shared(n, F.greatest(least, most - i), percent) for i in range(near_end)])


def _shared_tokens(postings: DataFrame) -> DataFrame:
    """token, key, n, leader, leader_n for tokens of two keys or more. One exchange; each task streams its tokens in order."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, whose token may go on
        lead: tuple[int, int] = (0, 0)
        for batch in batches:
            token = batch.column("token").to_numpy()
            key = batch.column("key").to_numpy()
            n = batch.column("n").to_numpy()
            if not len(token):
                continue
            goes_on = held is not None and held[0] == token[0]
            if held is not None and not goes_on:
                held = None
            new = np.concatenate([[not goes_on], token[1:] != token[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            leader = np.where(first >= 0, key[first], lead[0])
            leader_n = np.where(first >= 0, n[first], lead[1])
            alone = leader == key
            again = np.concatenate([~new[1:], [False]])  # the same token follows within the batch
            out = ~alone | (alone & again)
            extra = [(held[0], held[1], held[2], held[1], held[2])] if goes_on and held[3] else []  # a leader not given yet
            cols = [np.concatenate([[e[i] for e in extra], a[out]]).astype(np.int64) for i, a in enumerate((token, key, n, leader, leader_n))]
            lead = (int(leader[-1]), int(leader_n[-1]))
            held = (token[-1], key[-1], n[-1], bool(alone[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "key", "n", "leader", "leader_n"])

    dealt = postings.repartition("token").sortWithinPartitions("token", "key")
    return dealt.mapInArrow(runs, "token long, key long, n long, leader long, leader_n long")


def _with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the text of their key; one text alone where a key repeats is no assumption: each is taken."""
    return docs.join(small_or_not(cut(rows, "assigned"), SMALL_ROWS), "key")
