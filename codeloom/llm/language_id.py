"""Language identification by string kernels: presence bits of blended n-grams, Nystroem landmarks, kernel ridge.

The kernel of two texts is the number of n-grams (n = 1 to 4) of letters that both have,
over the root of the product of their own numbers. N-grams are hashed to a fixed number of
bits. Landmarks span a Nystroem space in which one ridge regression for each language
against the rest is solved, over all labelled rows: executors sum up its normal equations. As
the kernel is linear in the bits, landmarks and regressions fold into one matrix (bits x
languages), and a batch of texts is scored by the product of its sparse bit matrix with it.

Only the landmarks are a sample, of 256 rows or one a label, by a hash of the key: they span the space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 18
MAX_N = 4
UNKNOWN = "und"
LANDMARKS = 256
_BLOCK = 1 << 12  # bits whose counts make one row
_HELD_LABELS = 16  # labels whose counts a task holds at once


@cache
def _letters() -> np.ndarray:
    """For each code point that of its lower case, or 32 (blank) if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            out[c] = ord(ch.lower()[0])
    return out


def ngram_bits(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted numbers of the bits that the text's n-grams set; empty if it has no letter. ``seen``: 2**BITS False values."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = c == 32
    if blank.all():
        return np.zeros(0, np.int64)
    c = c[~(blank & np.concatenate([[True], blank[:-1]]))]  # runs of what is no letter are one blank
    c = np.concatenate([[32], c, [32]] if c[-1] != 32 else [[32], c]).astype(np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, MAX_N + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        seen[((h + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def landmark_rows(docs: DataFrame, label: str, key: str, counts: dict[str, int], per_label: int) -> DataFrame:
    """Rows from which landmarks are taken: about twice ``per_label`` of each label and a few more, by a hash of the key. ``counts``: rows by label."""
    each = 2 * per_label + 32
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    u = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))
    return docs.where(u < share[F.col(label)])


def chosen(bits: list[np.ndarray], labels: list[str], names: list[str], landmarks: int) -> list[np.ndarray]:
    """The first examples of each label, evenly many."""
    by_label = [[b for b, x in zip(bits, labels, strict=True) if x == name] for name in names]
    return [b for group in by_label for b in group[: max(1, landmarks // len(names))]]


def weights(counts: dict[str, int]) -> dict[str, float]:
    """An example's weight by its label, so that languages count alike."""
    return {k: sum(counts.values()) / (len(counts) * n) for k, n in counts.items()}


class Basis:
    """The Nystroem space of landmarks given by their bits: ``place`` of each bit that one sets (else -1), and coordinates of texts."""

    def __init__(self, landmarks: list[np.ndarray]):
        used = np.unique(np.concatenate(landmarks))
        self.used, self.place = used, np.full(1 << BITS, -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.sets = np.zeros((len(used), -(-len(landmarks) // 8) * 8), np.uint8)  # landmarks by columns, over the bits that they set, and empty ones up to whole words
        for c, b in enumerate(landmarks):
            self.sets[self.place[b], c] = 1
        self.scale = 1 / np.sqrt([len(b) for b in landmarks])
        values, vectors = np.linalg.eigh(np.stack([self.kernel(b) for b in landmarks]))
        keep = values > 1e-8 * values.max()
        self.to_space = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        """The kernel of a text (not without letters) and each landmark."""
        at = self.place[bits]
        at = at[at >= 0]
        if not len(at):
            return np.zeros(len(self.scale))
        # Eight bytes are added as one word; none overflows in 255 rows.
        words = self.sets.view(np.uint64)[at]
        runs = np.stack([words[k : k + 255].sum(axis=0) for k in range(0, len(at), 255)]).view(np.uint8)
        return runs.sum(axis=0, dtype=np.int64)[: len(self.scale)] * self.scale / np.sqrt(len(bits))

    def equations(self, bits: list[np.ndarray], labels: list[str], names: list[str], weight: dict[str, float]) -> np.ndarray:
        """x1' W (x1, y): the normal equations' sums over examples, of coordinates and a constant against these and each label's 1 or -1."""
        # Not by BLAS, whose threads would be as many as the machine's cores in each Python worker.
        x = np.einsum("ij,jk->ik", np.stack([self.kernel(b) for b in bits]), self.to_space)
        x1 = np.hstack([x, np.ones((len(x), 1))])
        y = np.array([[1.0 if lab == name else -1.0 for name in names] for lab in labels])
        return np.einsum("ni,nj->ij", x1 * np.array([weight[lab] for lab in labels])[:, None], np.hstack([x1, y]))


class KernelModel:
    """``labels`` and the folded matrix: scores of a text are rows[bits].sum() / sqrt(bits) + bias. ``known``: the bits that count as known."""

    def __init__(self, labels: list[str], rows: np.ndarray, bias: np.ndarray, known: np.ndarray):
        self.labels, self.rows, self.bias, self.known = labels, rows, bias, known

    @classmethod
    def unlearned(cls) -> KernelModel:
        return cls([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.zeros(1 << BITS, bool))

    @classmethod
    def solved(cls, basis: Basis, sums: np.ndarray, names: list[str], n: int, known: np.ndarray | None = None, ridge: float = 1e-3) -> KernelModel:
        """The model of the normal equations' ``sums`` over ``n`` examples."""
        size = len(sums)
        penalty = ridge * n * np.eye(size)
        penalty[-1, -1] = 0
        w = np.linalg.solve(sums[:, :size] + penalty, sums[:, size:])
        rows = np.zeros((1 << BITS, len(names)), np.float32)
        rows[basis.used] = basis.sets[:, : len(basis.scale)].astype(np.float32) @ (basis.scale[:, None] * (basis.to_space @ w[:-1])).astype(np.float32)
        return cls(names, rows, w[-1], basis.place >= 0 if known is None else known)

    @classmethod
    def fit(cls, bits: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> KernelModel:
        """Fits on examples given by their bits, which must be in a fixed order. Landmarks are dealt evenly over the labels."""
        names = sorted(set(labels))
        if not names:
            return cls.unlearned()
        basis = Basis(chosen(bits, labels, names, landmarks))
        return cls.solved(basis, basis.equations(bits, labels, names, weights({n: labels.count(n) for n in names})), names, len(labels), ridge=ridge)

    def known_share(self, bits: list[np.ndarray]) -> np.ndarray:
        """The share of each text's bits that are known, 0 for a text of no letters."""
        return np.array([self.known[b].mean() if len(b) else 0.0 for b in bits])

    def predict(self, bits: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """Labels and scores from 0 to 1; ``und`` and 0 for a text of no letters or a model of no labels."""
        n = len(bits)
        sizes = np.array([len(b) for b in bits])
        if not self.labels or not sizes.sum():
            return [UNKNOWN] * n, np.zeros(n)
        some = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        sums = np.add.reduceat(self.rows[np.concatenate([bits[i] for i in some])], starts, axis=0, dtype=np.float64)
        values = sums / np.sqrt(sizes[some])[:, None] + self.bias
        names, scores = [UNKNOWN] * n, np.zeros(n)
        for i, best in zip(some, values.argmax(axis=1), strict=True):
            names[i] = self.labels[best]
        scores[some] = np.clip((values.max(axis=1) + 1) / 2, 0, 1)
        return names, scores


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << BITS, bool)
    for batch in batches:
        found = [ngram_bits(t or "", seen).astype(np.int32) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["key", "label", "bits"])


def _sums_of(shared: Broadcast, counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition's rows (label, text): the rows of its normal equations, by number, and if ``counted`` how many texts of a label set each bit, in blocks."""

    def rows(label: str | None, sums: np.ndarray) -> pa.RecordBatch:
        some = [(k, row) for k, row in enumerate(sums) if label is None or row.any()]
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array([k for k, _ in some], pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([r.tobytes() for _, r in some], pa.binary())], names=["label", "k", "part", "sums"])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, names, weight = shared.value
        seen, total, counts = np.zeros(1 << BITS, bool), None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [(ngram_bits(t or "", seen), x) for t, x in zip(some.column("text").to_pylist(), some.column("label").to_pylist(), strict=True)]
                found = [(b, x) for b, x in found if len(b) and x in weight]
                if not found:
                    continue
                new = basis.equations([b for b, _ in found], [x for _, x in found], names, weight)
                total = new if total is None else total + new
                for b, x in found if counted else []:
                    if x not in counts:
                        if len(counts) == _HELD_LABELS:
                            yield from (rows(k, c.reshape(-1, _BLOCK)) for k, c in counts.items())
                            counts = {}
                        counts[x] = np.zeros(1 << BITS, np.int64)
                    counts[x][b] += 1
        if total is not None:
            yield rows(None, total)
        yield from (rows(k, c.reshape(-1, _BLOCK)) for k, c in counts.items())

    return sums_of


def fit_language_model(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", landmarks: int = LANDMARKS, counted: bool = False) -> KernelModel:
    """Learns from all rows with a label and letters.

    The driver gets the landmarks' bits and the sums over all rows alone. With ``counted`` the bits that count as
    known come from all rows, too: those that in some label as many texts set as would make one in its landmarks.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    per_label = max(1, landmarks // max(1, len(counts)))
    if not counts:
        return KernelModel.unlearned()
    bits = landmark_rows(rows, "label", "key", counts, per_label).mapInArrow(_bits_of, "key string, label string, bits array<int>")
    got = sorted(((r.key or "", r.label, np.array(r.bits, np.int64)) for r in bits.where(F.size("bits") > 0).toLocalIterator()), key=lambda r: (r[0], r[1], len(r[2])))
    names = sorted(counts)
    marks = chosen([r[2] for r in got], [r[1] for r in got], names, landmarks)
    if not marks:
        return KernelModel.unlearned()
    basis = Basis(marks)
    shared = docs.sparkSession.sparkContext.broadcast((basis, names, weights(counts)))

    def added(batch: pa.Table) -> pa.Table:
        one, kind = batch.slice(0, 1), np.float64 if batch.column("label")[0].as_py() is None else np.int64
        total = 0
        for row in batch.sort_by("part").column("sums"):
            total = total + np.frombuffer(row.as_py(), kind)
        if kind is np.int64:
            total = total * per_label >= counts[one.column("label")[0].as_py()]
        return pa.table({"label": one.column("label"), "k": one.column("k"), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("label", "text").mapInArrow(_sums_of(shared, counted), "label string, k int, part int, sums binary")
    total, known = {}, np.zeros(1 << BITS, bool) if counted else None
    for r in parts.groupBy("label", "k").applyInArrow(added, "label string, k int, sums binary").toLocalIterator():
        if r.label is None:
            total[r.k] = np.frombuffer(r.sums, np.float64)
        else:
            known[r.k * _BLOCK : (r.k + 1) * _BLOCK] |= np.frombuffer(r.sums, bool)
    shared.unpersist()
    return KernelModel.solved(basis, np.stack([total[k] for k in range(len(total))]), names, sum(counts.values()), known)


def identify_language(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (columns of these names are replaced).

    Whole texts are read. A text that is null or without letters is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen, known = np.zeros(1 << BITS, bool), shared.value
        for texts in batches:
            languages, scores = [], [np.zeros(0)]
            for k in range(0, len(texts), 256):
                some = known.predict([ngram_bits(t or "", seen) for t in texts.iloc[k : k + 256]])
                languages += some[0]
                scores.append(some[1])
            yield pd.DataFrame({"lang_pred": languages, "score": np.concatenate(scores)})

    # Annotations are strings in this module, so the kind is given by real types.
    identify.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    identify = F.pandas_udf(identify, "lang_pred string, score double")
    found = docs.select(*names, identify(F.col(text)).alias("_found"))
    return found.select(*names, "_found.lang_pred", "_found.score")



def known_share(texts: Column, model: KernelModel) -> Column:
    """The share of a text's n-gram bits that ``model`` knows, from 0 to 1, whatever the number of labels."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def share(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen, known = np.zeros(1 << BITS, bool), shared.value
        for some in batches:
            yield pa.array([known.known_share([ngram_bits(t.as_py() or "", seen)])[0] for t in some], pa.float64())

    share.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(share, "double")(texts)
