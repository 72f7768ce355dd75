"""Dependency graphs: closures, cycles, circuits, fan metrics, re-export and inheritance chains.

Loops go over frontiers: each round is a join, a ``distinct`` and an anti-join against what
has been seen, written to the shared folder, so plans stay short and a lost executor costs
one round at most.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from codeloom import schema
from codeloom.sources.tables import cut

SMALL_EDGES, SMALL_BYTES = 1_000_000, 128 << 20  # a graph that one task takes in whole
WALKERS = 32  # tasks that share out a component's circuits


def edges(relations: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """Distinct src, dst of imports, type references and re-exports; rows without a target drop out. No projects: all."""
    out = relations.where(F.col("type").isin(list(schema.EDGE_TYPES)) & F.col("dst_file_path").isNotNull())
    if projects is not None:
        out = out.where(F.col("project").isin(projects))
    return out.select(F.col("src_file_path").alias("src"), F.col("dst_file_path").alias("dst")).distinct()


def patched_edges(old: DataFrame, touched: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges after files of ``touched`` (file_path, deleted) changed: theirs are dropped and those that changed files have now are added."""
    gone = touched.select(F.col("file_path").alias("_f"))
    kept = old.join(gone, F.col("src") == F.col("_f"), "left_anti").join(gone, F.col("dst") == F.col("_f"), "left_anti")
    changed = touched.where(~F.col("deleted")).select(F.col("file_path").alias("_f"))
    new = edges(relations)
    leaving = new.join(changed, F.col("src") == F.col("_f"), "left_semi")
    coming = new.join(changed, F.col("dst") == F.col("_f"), "left_semi")
    return kept.unionByName(leaving).unionByName(coming).distinct()


def import_graph(graph: DataFrame) -> DataFrame:
    """node, dependencies (sorted, distinct; empty for sinks)."""
    out = graph.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dependencies")).withColumnRenamed("src", "node")
    nodes = graph.select(F.col("src").alias("node")).unionByName(graph.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(out, "node", "left").select("node", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"))


def reachable(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: all that follows from ``seeds`` (node) in one step or more; a seed only if it lies on a way back. One job a level."""
    step = graph.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    frontier, seen = seeds.select("node").distinct(), None
    while True:
        nxt = frontier.join(step, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        if seen is not None:
            nxt = nxt.join(seen.select(F.col("node").alias("_seen")), F.col("node") == F.col("_seen"), "left_anti")
        frontier = cut(nxt, "frontier")
        if frontier.isEmpty():
            return seen if seen is not None else frontier
        seen = frontier if seen is None else cut(seen.unionByName(frontier), "seen")


def transitive_dependencies(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    return reachable(graph, seeds)


def transitive_dependents(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    return reachable(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)


affected = transitive_dependents


def closure(graph: DataFrame) -> DataFrame:
    """All pairs src, dst joined by a path, by doubling path lengths: as many rounds as the longest path's logarithm."""
    paths = cut(graph.select("src", "dst").distinct(), "closure")
    n = paths.count()
    while True:
        left = paths.select(F.col("src").alias("a"), F.col("dst").alias("m"))
        right = paths.select(F.col("src").alias("m"), F.col("dst").alias("b"))
        longer = left.join(right, "m").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        paths = cut(paths.select("src", "dst").unionByName(longer).distinct(), "closure")
        grown = paths.count()
        if grown == n:
            return paths
        n = grown


def cyclic_core(graph: DataFrame) -> DataFrame:
    """Edges left after peeling, again and again, nodes without edges in or out: empty just if there is no cycle."""
    core = cut(graph.select("src", "dst").distinct(), "core")
    n = core.count()
    while n:
        starts = core.select(F.col("src").alias("_s")).distinct()
        ends = core.select(F.col("dst").alias("_d")).distinct()
        core = cut(core.join(ends, F.col("src") == F.col("_d"), "left_semi").join(starts, F.col("dst") == F.col("_s"), "left_semi"), "core")
        left = core.count()
        if left == n:
            break
        n = left
    return core


def has_cycle(graph: DataFrame) -> bool:
    return not cyclic_core(graph).isEmpty()


def _components_of(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least node of its strong component, -1 outside any cycle (Tarjan, without recursion)."""
    order = np.argsort(src, kind="stable")
    targets, starts = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, met, low, of, stack, count = starts[:-1], [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        way = [] if met[root] else [root]
        while way:
            v = way[-1]
            if not met[v]:
                count += 1
                met[v] = low[v] = count
                stack.append(v)
            i, end, deeper = at[v], starts[v + 1], False
            while i < end and not deeper:
                w = targets[i]
                i += 1
                if not met[w]:
                    way.append(w)
                    deeper = True
                elif of[w] < 0 and met[w] < low[v]:
                    low[v] = met[w]
            at[v] = i
            if deeper:
                continue
            way.pop()
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
            if low[v] == met[v]:
                members = [stack.pop()]
                while members[-1] != v:
                    members.append(stack.pop())
                least = min(members)
                for w in members:
                    of[w] = least
    out = np.array(of, np.int64)
    cyclic = (np.bincount(out, minlength=n) > 1)[out]
    cyclic[src[src == dst]] = True  # a node alone lies on a cycle only by an edge to itself
    return np.where(cyclic, out, -1)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all the edges (src, dst) of a partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    edges_ = pa.Table.from_batches(got)
    both = pa.chunked_array(edges_["src"].chunks + edges_["dst"].chunks).combine_chunks().dictionary_encode()
    values = both.dictionary.to_pylist()
    names = sorted(values)
    rank = {x: i for i, x in enumerate(names)}
    ids = np.array([rank[x] for x in values], np.int64)[both.indices.to_numpy(zero_copy_only=False)]
    component = _components_of(ids[: len(edges_)], ids[len(edges_) :], len(names))
    nodes = np.flatnonzero(component >= 0)
    out, kind = pa.array(names, both.dictionary.type), both.dictionary.type
    for k in range(0, len(nodes), 10_000):
        some = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([out.take(pa.array(some)).cast(kind), out.take(pa.array(component[some])).cast(kind)], names=["node", "component"])


def strong_components(graph: DataFrame) -> DataFrame:
    """node, component (its least node) for nodes on cycles.

    A graph of up to SMALL_EDGES edges and SMALL_BYTES bytes of names is one task's, in a walk over
    its edges. In a larger one nodes outside any cycle are peeled off first. Then, again and
    again, each node takes the least node that leads to it as its colour; within a colour, all that
    leads back to the colour's own node is one component, and goes. Every round settles a component
    for each colour, and its tables are as large as the graph that is left, never as its pairs; a
    long chain of components takes many rounds.
    """
    return _strong_components(_whole_edges(graph))


def _whole_edges(graph: DataFrame) -> DataFrame:
    return cut(graph.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")


def _small(graph: DataFrame) -> tuple[bool, bool]:
    """Whether one task takes the edges in whole, and whether a name has a colon."""
    src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
    size, colon = F.octet_length(src) + F.octet_length(dst), F.contains(src, F.lit(":")) | F.contains(dst, F.lit(":"))
    n, n_bytes, colons = graph.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.coalesce(F.bool_or(colon), F.lit(False))).first()
    return n <= SMALL_EDGES and n_bytes <= SMALL_BYTES, colons


def _strong_components(graph: DataFrame) -> DataFrame:
    if _small(graph)[0]:
        kind = graph.schema["src"].dataType
        shape = StructType([StructField("node", kind), StructField("component", kind)])
        return cut(graph.coalesce(1).mapInArrow(_solved, shape), "components")
    live, done = cyclic_core(graph), None
    while not live.isEmpty():
        nodes = live.select(F.col("src").alias("node")).distinct()
        colour = _spread_least(live, nodes.withColumn("c", F.col("node")))
        within = (
            live.join(colour.toDF("src", "_a"), "src").join(colour.toDF("dst", "_b"), "dst")
            .where("_a = _b").select("src", "dst", F.col("_a").alias("c"))
        )
        within = cut(within, "within")
        found = seen = cut(colour.where("node = c"), "roots")
        while True:
            back = found.join(within, (F.col("node") == F.col("dst")) & (found["c"] == within["c"])).select(F.col("src").alias("node"), within["c"].alias("c")).distinct()
            found = cut(back.join(seen.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti"), "found")
            if found.isEmpty():
                break
            seen = cut(seen.unionByName(found), "seen")
        settled = seen.select("node", F.col("c").alias("component"))
        # A node with no edge to itself or to its component's others lies on no cycle.
        alone = settled.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(F.col("component").alias("node"))
        loops = live.where("src = dst").select(F.col("src").alias("_l"))
        alone = alone.join(loops, F.col("node") == F.col("_l"), "left_anti")
        kept = settled.join(alone, "node", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        gone = seen.select(F.col("node").alias("_g"))
        rest = live.join(gone, F.col("src") == F.col("_g"), "left_anti").join(gone, F.col("dst") == F.col("_g"), "left_anti")
        live = cyclic_core(cut(rest, "live"))
    return done if done is not None else graph.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)


def _spread_least(graph: DataFrame, marks: DataFrame) -> DataFrame:
    """node, c: the least mark of any node that leads to it, its own among them. Only marks that fell are passed on."""
    step = graph.select("src", "dst")
    fell = marks
    while True:
        passed = fell.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("_d")).agg(F.min("c").alias("_c"))
        marks = cut(marks.join(passed, F.col("node") == F.col("_d"), "left").select("node", F.least("c", F.coalesce("_c", "c")).alias("c"), (F.coalesce(F.col("_c") < F.col("c"), F.lit(False))).alias("_fell")), "marks")
        fell = marks.where("_fell").select("node", "c")
        if fell.isEmpty():
            return marks.select("node", "c")
        marks = marks.select("node", "c")


def _next_steps(src: np.ndarray, dst: np.ndarray, n: int) -> list[list[int]]:
    order = np.lexsort((dst, src))
    starts, targets = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()
    return [targets[starts[v] : starts[v + 1]] for v in range(n)]


def _by_least_node(src: np.ndarray, dst: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Least node (ascending), nodes, src and dst of strong components, taken apart again without their least node: a circuit lies whole in the one that has its own least node as least."""

    def components(nodes: np.ndarray, s: np.ndarray, d: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        i, j = np.searchsorted(nodes, s), np.searchsorted(nodes, d)
        at = _components_of(i, j, len(nodes))
        members, inside = np.argsort(at, kind="stable"), np.flatnonzero((at[i] == at[j]) & (at[i] >= 0))
        members, inside = members[at[members] >= 0], inside[np.argsort(at[i][inside], kind="stable")]
        cuts = np.flatnonzero(np.diff(at[members])) + 1, np.flatnonzero(np.diff(at[i][inside])) + 1
        for own, e in zip(np.split(nodes[members], cuts[0]), np.split(inside, cuts[1]), strict=True):
            if len(own):
                yield int(own[0]), own, s[e], d[e]

    left = list(components(np.arange(n), src, dst))
    heapq.heapify(left)
    while left:
        first, own, s, d = heapq.heappop(left)
        yield first, own, s, d
        rest = (s != first) & (d != first)
        for part in components(own[1:], s[rest], d[rest]) if rest.any() else ():
            heapq.heappush(left, part)


def _circuits_through(start: int, steps: dict[int, list[int]]) -> Iterator[list[int]]:
    """Elementary circuits through ``start`` of a strong component (Johnson: a node that leads nowhere stays blocked until a node behind it is free)."""
    path, way, blocked, waiting, closed = [start], [iter(steps[start])], {start}, {}, [False]
    while way:
        for w in way[-1]:
            if w == start:
                yield path
                closed[-1] = True
            elif w not in blocked:
                path.append(w)
                way.append(iter(steps[w]))
                blocked.add(w)
                closed.append(False)
                break
        else:
            way.pop()
            v = path.pop()
            if closed.pop():
                if closed:
                    closed[-1] = True
                free = [v]
                while free:
                    u = free.pop()
                    if u in blocked:
                        blocked.discard(u)
                        free += waiting.pop(u, ())
            else:
                for w in steps[v]:
                    waiting.setdefault(w, set()).add(v)


def _least_rotation(names: list[str]) -> tuple[str, list[str]]:
    """The rotation of the least joined text, with that text."""
    keys = [x + "::" for x in names]
    low = min(keys)  # what doesn't begin with it is behind it
    return min(("::".join(r), r) for r in (names[i:] + names[:i] for i, k in enumerate(keys) if k.startswith(low)))


def _first_circuits(names: list[str], src: np.ndarray, dst: np.ndarray, k: int) -> Iterator[tuple[str, list[str]]]:
    """Circuits of a graph, the first ``k`` in the order of their texts among them; names hold no colon.

    The least of the open paths is extended, each known to lead back to its start, so that a
    circuit is met after no more paths than it has nodes.
    """
    for name in sorted(names[v] for v in src[src == dst].tolist())[:k]:
        yield name, [name]
    rank = sorted(range(len(names)), key=lambda v: names[v] + "::")
    place = np.empty(len(names), np.int64)
    place[rank] = np.arange(len(names))
    names, count = [names[v] for v in rank], 0
    for first, _, s, d in _by_least_node(place[src], place[dst], len(names)):
        steps, into = {}, {}
        for x, y in zip(s.tolist(), d.tolist(), strict=True):
            if x != y:
                steps.setdefault(x, []).append(y)
                into.setdefault(y, []).append(x)
        heap = [(names[first] + "::", False, [first])] if steps else []
        while heap:
            text, whole, path = heapq.heappop(heap)
            if whole:
                yield text, [names[v] for v in path]
                count += 1
                if count >= k:
                    return
                continue
            on = set(path)
            while True:
                back, nexts = first in steps[path[-1]], [w for w in steps[path[-1]] if w not in on]
                if back or len(nexts) != 1:
                    break
                path.append(nexts[0])
                on.add(nexts[0])
            if back:
                heapq.heappush(heap, ("::".join(names[v] for v in path), True, path))
            ends, todo = {first}, [first] if nexts else []  # what leads to the start past the path
            while todo:
                for x in into[todo.pop()]:
                    if x not in on and x not in ends:
                        ends.add(x)
                        todo.append(x)
            for longer in ([*path, w] for w in nexts if w in ends):
                heapq.heappush(heap, ("::".join(names[v] for v in longer) + "::", False, longer))


def _first_walked(max_cycles: int):
    """text, cycle of the first ``max_cycles`` circuits, and some more, of all the edges (src, dst) of a partition; names hold no colon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        sides = [rows[c].cast(pa.string()).to_pylist() for c in ("src", "dst")]
        names = sorted({*sides[0], *sides[1]})
        rank = {x: i for i, x in enumerate(names)}
        circuits_ = _first_circuits(names, *(np.array([rank[x] for x in side], np.int64) for side in sides), max_cycles)
        while some := list(itertools.islice(circuits_, 10_000)):
            texts, cycles = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(cycles, pa.list_(pa.string()))], names=["text", "cycle"])

    return run


def _walked(max_cycles: int | None):
    """Of rows component, part, parts, src, dst, sorted by the first two: text, cycle of each circuit whose turn is the part's; at most the first ``max_cycles`` of a component."""

    def found(got: list[pa.Table]) -> Iterator[tuple[str, list[str]]]:
        rows = pa.concat_tables(got)
        names = sorted(set(rows["src"].to_pylist()))
        rank = {x: i for i, x in enumerate(names)}
        src, dst = (np.array([rank[x] for x in rows[c].to_pylist()], np.int64) for c in ("src", "dst"))
        if max_cycles is not None and max_cycles < 1:
            return
        if max_cycles is not None and not any(":" in x for x in names):
            yield from _first_circuits(names, src, dst, max_cycles)
            return
        part, parts = rows["part"][0].as_py(), rows["parts"][0].as_py()
        for turn, (start, nodes, s, d) in enumerate(_by_least_node(src, dst, len(names))):
            if turn % parts == part:
                steps = dict(zip(nodes.tolist(), _next_steps(np.searchsorted(nodes, s), np.searchsorted(nodes, d), len(nodes)), strict=True))
                steps = {v: nodes[w].tolist() for v, w in steps.items()}
                for path in _circuits_through(start, steps):
                    yield _least_rotation([names[v] for v in path])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
        key, got = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            both = list(zip(rows["component"].to_pylist(), rows["part"].to_pylist(), strict=True))
            i = 0
            while i < len(both):
                j = i + 1
                while j < len(both) and both[j] == both[i]:
                    j += 1
                if both[i] != key and got:
                    yield got
                    got = []
                key = both[i]
                got.append(rows.slice(i, j - i))
                i = j
        if got:
            yield got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, texts, cycles, size = [pa.string(), pa.list_(pa.string())], [], [], 0
        for got in groups(batches):
            for text, cycle in found(got):
                texts.append(text)
                cycles.append(cycle)
                size += len(text) + 64
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, shape[0]), pa.array(cycles, shape[1])], names=["text", "cycle"])
                    texts, cycles, size = [], [], 0
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(texts, shape[0]), pa.array(cycles, shape[1])], names=["text", "cycle"])

    return run


def circuits(graph: DataFrame, max_cycles: int | None = None) -> DataFrame:
    """cycle: each elementary circuit once, rotated to the least joined text, in the order of that text.

    A strong component of up to SMALL_EDGES edges is walked within tasks, one for few edges and up
    to WALKERS for many, that share out the circuits by their least node. With ``max_cycles`` a
    component gives its first ones alone, and one task finds those of a graph of up to SMALL_EDGES
    edges, unless names hold colons (then texts don't follow the order of names, and all are found
    first). Larger components grow paths by rounds.
    """
    graph = _whole_edges(graph)
    if max_cycles is not None and max_cycles > 0 and _small(graph) == (True, False):
        return graph.coalesce(1).mapInArrow(_first_walked(max_cycles), "text string, cycle array<string>").orderBy("text", "cycle").select("cycle").limit(max_cycles)
    sc = _strong_components(graph)
    inside = (
        graph.join(sc.select(F.col("node").alias("src"), "component"), "src")
        .join(sc.select(F.col("node").alias("dst"), F.col("component").alias("_b")), "dst").where("component = _b")
        .select("component", "src", "dst").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("component")))
    )
    inside = cut(inside, "inside")
    parts = F.lit(1) if max_cycles is not None else F.least(F.ceil(F.col("_n") / 64), F.lit(WALKERS))
    dealt = inside.where(F.col("_n") <= SMALL_EDGES).withColumn("parts", parts.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("component", "part", "parts", "src", "dst").repartition(graph.sparkSession.sparkContext.defaultParallelism, "component", "part").sortWithinPartitions("component", "part")
    found = dealt.mapInArrow(_walked(max_cycles), "text string, cycle array<string>")
    large = inside.where(F.col("_n") > SMALL_EDGES)
    if not large.isEmpty():
        found = found.unionByName(_circuits_by_rounds(large.select("src", "dst")))
    if max_cycles is None:  # a sort reads its rows twice
        return cut(found, "circuits").orderBy("text", "cycle").select("cycle")
    return found.orderBy("text", "cycle").select("cycle").limit(max_cycles)


def _circuits_by_rounds(inside: DataFrame) -> DataFrame:
    """text, cycle of all circuits: paths grow from a circuit's least node within its strong component, and close on it."""
    step = inside.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    paths = cut(inside.where("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")), "paths")
    found = None
    while found is None or not paths.isEmpty():
        closed = paths.where("last = start").select(F.slice("path", 1, F.size("path") - 1).alias("path"))
        found = closed if found is None else found.unionByName(closed)
        grown = paths.where("last != start").join(step, F.col("last") == F.col("_from")).where((F.col("_to") == F.col("start")) | ((F.col("_to") > F.col("start")) & ~F.array_contains("path", F.col("_to"))))
        paths = cut(grown.select("start", F.col("_to").alias("last"), F.concat("path", F.array("_to")).alias("path")), "paths")
    rotations = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.concat(F.slice("path", i + 1, F.size("path")), F.slice("path", 1, i)))
    least = F.array_min(F.transform(rotations, lambda r: F.struct(F.array_join(r, "::").alias("text"), r.alias("cycle"))))
    return found.select(least.alias("_m")).select("_m.text", "_m.cycle").distinct()


def fan_metrics(graph: DataFrame) -> DataFrame:
    """node, fan_in, fan_out: distinct neighbours either way."""
    out = graph.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("fan_out"))
    into = graph.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("fan_in"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def direct_dependencies(relations: DataFrame, project: str, file_path: str, limit: int = 10_000) -> DataFrame:
    """Targets of a file's import rows as they stand: repeated, the limit before rows without a target drop out."""
    rows = relations.where((F.col("project") == project) & (F.col("src_file_path") == file_path) & (F.col("type") == "imports")).orderBy("id").limit(limit)
    return rows.where(F.col("dst_file_path").isNotNull()).select("id", "dst_file_path")


def direct_dependents(relations: DataFrame, project: str, file_path: str, limit: int = 10_000) -> DataFrame:
    rows = relations.where((F.col("project") == project) & (F.col("dst_file_path") == file_path) & (F.col("type") == "imports")).orderBy("id").limit(limit)
    return rows.select("id", "src_file_path")


def resolve_symbols(relations: DataFrame, wanted: DataFrame, project: str | None = None, limit: int = 500) -> DataFrame:
    """For each ``name, file_path`` its origin through re-exports: original_name, original_file, hops, chain, circular.

    At each hop the re-export of the least id (among the first ``limit`` of its file) whose
    specifiers export the name is followed; one without a target, or with an empty local name,
    ends the way there. ``chain`` has the file and name of each place that was left. A place
    that comes again ends the way, too, as its own origin, and sets ``circular``.
    """
    meta = F.from_json("meta_json", schema.META)
    mine = relations.where(F.col("type") == "re-exports")
    if project is not None:
        mine = mine.where(F.col("project") == project)
    of_file = Window.partitionBy("src_file_path").orderBy("id")
    hops = (
        mine.withColumn("_rank", F.row_number().over(of_file)).where(F.col("_rank") <= limit)
        .select("id", "src_file_path", "dst_file_path", F.posexplode(meta["specifiers"]).alias("_pos", "_s"))
        .groupBy(F.col("src_file_path").alias("_f"), F.col("_s.exported").alias("_n"))
        .agg(F.min(F.struct("id", "_pos", "dst_file_path", F.col("_s.local").alias("local"))).alias("_hop"))
    )
    hops = cut(hops.where(F.col("_hop.dst_file_path").isNotNull() & (F.col("_hop.local") != "")), "hops")
    no_chain = F.array().cast("array<struct<file_path:string,exported_as:string>>")
    live = wanted.select("name", "file_path", F.col("name").alias("_at"), F.col("file_path").alias("_in"), F.array(F.concat_ws("::", "file_path", "name")).alias("_seen"), no_chain.alias("chain"))
    done = None
    while True:
        stepped = live.join(hops, (F.col("_in") == F.col("_f")) & (F.col("_at") == F.col("_n")), "left")
        moves = F.col("_hop").isNotNull()
        nxt = F.concat_ws("::", F.col("_hop.dst_file_path"), F.col("_hop.local"))
        left = F.concat("chain", F.array(F.struct(F.col("_in").alias("file_path"), F.col("_at").alias("exported_as"))))
        stepped = cut(stepped.select(
            "name", "file_path", F.coalesce("_hop.local", "_at").alias("_at"), F.coalesce("_hop.dst_file_path", "_in").alias("_in"),
            F.when(moves, F.concat("_seen", F.array(nxt))).otherwise(F.col("_seen")).alias("_seen"), F.when(moves, left).otherwise(F.col("chain")).alias("chain"),
            (moves & F.array_contains("_seen", nxt)).alias("_circular"), moves.alias("_moves"),
        ), "resolve")
        ended = stepped.where(~F.col("_moves") | F.col("_circular"))
        ended = ended.select("name", "file_path", F.col("_at").alias("original_name"), F.col("_in").alias("original_file"), F.size("chain").cast("long").alias("hops"), "chain", F.col("_circular").alias("circular"))
        done = ended if done is None else done.unionByName(ended)
        live = stepped.where(F.col("_moves") & ~F.col("_circular")).select("name", "file_path", "_at", "_in", "_seen", "chain")
        if live.isEmpty():
            return done


def heritage_edges(relations: DataFrame, name: str, file_path: str) -> DataFrame:
    """Edges (src, dst, kind) of all that a symbol extends or implements, directly or not; symbols as ``file::name``."""
    key = lambda side: F.concat_ws("::", F.col(f"{side}_file_path"), F.col(f"{side}_symbol_name"))
    all_edges = relations.where(F.col("type").isin("extends", "implements") & F.col("dst_file_path").isNotNull() & F.col("dst_symbol_name").isNotNull() & F.col("src_symbol_name").isNotNull())
    all_edges = cut(all_edges.select(key("src").alias("src"), key("dst").alias("dst"), F.col("type").alias("kind")).distinct(), "heritage")
    spark = relations.sparkSession
    seed = spark.createDataFrame([(f"{file_path}::{name}",)], "node string")
    nodes = reachable(all_edges.select("src", "dst"), seed).select("node").unionByName(seed).distinct()
    return all_edges.join(nodes, F.col("src") == F.col("node"), "left_semi")
