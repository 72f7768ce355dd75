"""Exact token ids of whole texts, by looking up what the tokenizer gives for each unit.

Texts are taken as UTF-8 bytes in blocks. Blocks are cut into units with array operations: runs
of letters, single digits and runs of signs, which are what ``word_bpe_49k.json`` splits a text
into before it merges. A unit's ids come from a table keyed by a 64-bit hash of its bytes, so a
word costs the library only when it is new. Only chunks of ASCII and of letters below U+0100
are cut like that; any other chunk between blanks (other scripts, apostrophes, control signs,
special strings) is one unit and goes to the library as it stands.

The table is bounded; when full it starts afresh, which costs time and never changes ids.
Units longer than ``LONGEST`` bytes aren't kept at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

MAX_UNITS, MAX_IDS = 1_000_000, 8_000_000
LONGEST = 64
BLOCK = 1 << 18
SPACE, LETTER, DIGIT, SIGN, WIDE, OTHER = range(6)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Lists:
    """Lists of whole numbers, one after another in one growing array."""

    def __init__(self, dtype: type = np.uint32) -> None:
        self.ids, self.used = np.zeros(1 << 16, dtype), 0
        self.starts, self.lens, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def append(self, flat: np.ndarray, lens: np.ndarray) -> int:
        """The number of the first list of these."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lens) > len(self.lens):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        first, self.n = self.n, self.n + len(lens)
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first : self.n] = self.used + np.cumsum(lens) - lens
        self.lens[first : self.n] = lens
        self.used += len(flat)
        return first

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these lists, joined, and where each list ends there."""
        lens = self.lens[which]
        ends = np.cumsum(lens)
        flat = np.repeat(self.starts[which] - ends + lens, lens)
        flat += np.arange(len(flat))
        return self.ids[flat], ends


class HashTable:
    """64-bit hashes (not 0) to numbers, with open addressing, many at once."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for one that isn't known."""
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == hashes, self.values[at], np.int32(-1))
        left = np.flatnonzero((seen != hashes) & (seen != 0))
        at, want = (at[left] + 1) & mask, hashes[left]
        while len(left):
            seen = self.keys[at]
            hit = seen == want
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (seen != 0)
            left, at, want = left[on], (at[on] + 1) & mask, want[on]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that aren't known yet."""
        while 2 * (self.n + len(hashes)) > len(self.keys):
            used = np.flatnonzero(self.keys)
            keys, old = self.keys[used], self.values[used]
            self.__init__(self.bits + 1)
            self.add(keys, old)
        self.n += len(hashes)
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            won = free & (self.keys[at] == hashes)  # of two for one place the last has it
            self.values[at[won]] = values[won]
            hashes, values, at = hashes[~won], values[~won], (at[~won] + 1) & mask


class UnitHash:
    """Hashes of stretches of bytes, from running sums of byte values times powers."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
        self.powers, self.inverse = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(n, base & (1 << 64) - 1, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.powers, self.inverse = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self._grow(max(2 * BLOCK, len(data) + 1))
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = self.value[data]
        terms *= self.powers[: len(data)]
        np.cumsum(terms, out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= (ends - starts).astype(np.uint64) << np.uint64(56)
        h ^= h >> np.uint64(30)
        h *= _M1
        h ^= h >> np.uint64(27)
        h *= _M2
        h ^= h >> np.uint64(31)
        return np.maximum(h, np.uint64(1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after another, and its offsets there; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, space: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Stretches of about ``most`` bytes that start the data or a run after a byte for which ``space`` (by byte) holds."""
    a = 0
    while a < len(data):
        b = min(a + most, len(data))
        if b < len(data):
            near = max(a, b - 1024)
            if not space[data[near:b]].any():
                near = a
            back = np.flatnonzero(space[data[near:b]])
            if len(back):
                b = near + int(back[-1]) + 1
            else:  # one long chunk: up to its end
                while b < len(data):
                    ahead = np.flatnonzero(space[data[b : b + most]])
                    b = min(b + most, len(data)) if not len(ahead) else b + int(ahead[0]) + 1
                    if len(ahead):
                        break
        yield a, b
        a = b


def by_bytes(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of rows of about ``most`` bytes together, one row at least."""
    _, at = utf8(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    c[0x21:0x7F] = SIGN
    for a, b, kind in ((0x30, 0x3A, DIGIT), (0x41, 0x5B, LETTER), (0x61, 0x7B, LETTER)):
        c[a:b] = kind
    c[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    c[0xC3] = WIDE
    c[ord("'")] = OTHER  # may be a contraction
    return c


_CLASS = _classes()
_SPACES = _CLASS == SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary's entries."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ChunkTokenizer:
    """``encode_column(column)``: the ids of all texts in one array, and where each text ends."""

    def __init__(self, path: str, max_units: int = MAX_UNITS, max_ids: int = MAX_IDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize  # of a unit that is cut and lower-cased already
        self.letters = {b: s for b, s in _byte_letters().items() if b != 0x20}
        self.max_units, self.max_ids = max_units, max_ids
        self.hash, self.table, self.lists = UnitHash(), HashTable(), Lists()

    def _units(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block with letters lower-cased, and starts, ends and classes of its units. edges: where texts start."""
        kind, low = _CLASS[raw], _LOWER[raw]
        lead = np.flatnonzero(kind == WIDE)
        if len(lead):
            after = raw[np.minimum(lead + 1, len(raw) - 1)]
            letter = (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
            kind[lead[~letter]] = OTHER
            lead, after = lead[letter], after[letter]
            kind[lead] = kind[lead + 1] = LETTER
            low[lead[after < 0x9F] + 1] += 0x20
        special = np.flatnonzero(raw == ord("<"))
        special = special[raw[np.minimum(special + 1, len(raw) - 1)] == ord("|")]
        kind[special] = OTHER
        new = np.empty(len(raw), bool)
        new[0] = True
        odd = np.flatnonzero(kind == OTHER)
        if len(odd):
            blank = kind == SPACE
            new[1:] = blank[1:] != blank[:-1]
            new[edges] = True
            cuts = np.append(np.flatnonzero(new), len(raw))
            chunk = np.unique(np.searchsorted(cuts, odd, side="right") - 1)
            a, n = cuts[chunk], np.diff(cuts)[chunk]
            whole = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            kind[whole] = OTHER
            low[whole] = raw[whole]
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == DIGIT
        new[edges] = True
        cuts = np.append(np.flatnonzero(new), len(raw))
        starts, ends, kinds = cuts[:-1], cuts[1:], kind[cuts[:-1]]
        keep = kinds != SPACE
        return low, starts[keep], ends[keep], kinds[keep]

    def _learn(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> int:
        """Adds the lists of these units; the number of the first."""
        held, spans, odd = low.tobytes(), list(zip(starts.tolist(), ends.tolist(), strict=True)), kinds == OTHER
        lens = np.zeros(len(starts), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * 2
        easy = np.flatnonzero(~odd)
        if len(easy):
            # Bytes as letters: ASCII stands for itself; the blanks between units cut them again.
            joined = b" ".join([held[a:b] for a, b in (spans[i] for i in easy)]).decode("latin-1")
            if not joined.isascii():
                joined = joined.translate(self.letters)
            merged = self.merged
            ids = [[t.id for t in merged(unit)] for unit in joined.split(" ")]
            lens[easy] = [len(x) for x in ids]
            parts[0] = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens[easy].sum()))
        hard = np.flatnonzero(odd)
        if len(hard):
            texts = [held[a:b].decode("utf-8", "replace") for a, b in (spans[i] for i in hard)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lens[hard] = [len(x) for x in ids]
            parts[1] = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens[hard].sum()))
        # Lists in the order easy, hard.
        return self.lists.append(np.concatenate(parts), lens[np.concatenate([easy, hard])])

    def _numbers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        hashes = self.hash.of(low, starts, ends)
        hashes ^= (kinds == OTHER).astype(np.uint64) << np.uint64(63)
        np.maximum(hashes, np.uint64(1), out=hashes)
        numbers = self.table.find(hashes)
        short = ends - starts <= LONGEST
        numbers[~short] = -1
        missed = np.flatnonzero(numbers < 0)
        if len(missed):
            keep = short[missed]
            distinct, first, back = np.unique(hashes[missed[keep]], return_index=True, return_inverse=True)
            which = np.concatenate([missed[keep][first], missed[~keep]])
            odd = kinds[which] == OTHER
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            given = np.empty(len(which), np.int32)
            given[order] = self._learn(low, starts[which], ends[which], kinds[which]) + np.arange(len(which))
            self.table.add(distinct, given[: len(distinct)])
            numbers[missed[keep]] = given[: len(distinct)][back]
            numbers[missed[~keep]] = given[len(distinct) :]
        return numbers

    def encode_column(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """With ``end``, that id follows each text. Null is empty."""
        data, offsets = utf8(column)
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        counts = np.zeros(len(offsets) - 1, np.int64)
        for a, b in blocks(data, _SPACES):
            if self.lists.n > self.max_units or self.lists.used > self.max_ids:
                self.table, self.lists = HashTable(), Lists()
            inside = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
            low, starts, ends, kinds = self._units(data[a:b], inside)
            if not len(starts):
                continue
            found, stops = self.lists.take(self._numbers(low, starts, ends, kinds))
            ids.append(found)
            of = np.searchsorted(offsets, starts + a, side="right") - 1
            counts += np.bincount(of, np.diff(stops, prepend=0), len(counts)).astype(np.int64)
        joined, stops = np.concatenate(ids), np.cumsum(counts)
        if end is not None:
            joined = np.insert(joined, stops, np.uint32(end))
            stops = stops + np.arange(1, len(stops) + 1)
        return joined, stops

    def encode_batch(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string()), end)


_OPEN: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for each Python worker, so that its table outlives a task."""
    if path not in _OPEN:
        _OPEN[path] = ChunkTokenizer(path)
    return _OPEN[path]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
