"""Exact token counts at every prefix of a text, for a sentencepiece BPE model.

For a word, dynamic programming over its prefixes keeps the last token of each prefix's
encoding: the encoding of ``w[:i]`` is that of ``w[:i - k]`` and one token of length ``k``,
and only for one ``k`` does that token follow the other encoding's last token without being
merged differently. So counts[i] = counts[i - k] + 1, and every prefix is answered at once.
Tokens of this model never hold a blank but at their start, so a text's counts are running
sums of its words' counts. The counts at all prefixes of a word are stored once, in a table keyed
by a 64-bit hash of its bytes; texts are cut into words with array operations, a text's count is
the sum over its words, and where a budget of tokens ends is read from the stored prefixes of the
word in which it is passed, without encoding anything again.

A model is accepted if its normalizer changes nothing but blanks, its pieces hold blanks only at
their start, and runs of blanks merge after all else, with counts that repeat with the longest
run's length. A run then costs a look-up, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tokens import LONGEST, HashTable, Lists, UnitHash, blocks, by_bytes, utf8

MAX_WORDS, MAX_PREFIXES, MAX_FITS = 1_000_000, 24_000_000, 400_000
_MARK = "▁"
_CUTS = np.zeros(256, bool)
_CUTS[[0x20, 0x0A]] = True


class PrefixCounter:
    def __init__(self, model: str, max_words: int = MAX_WORDS, max_prefixes: int = MAX_PREFIXES, max_fits: int = MAX_FITS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.dummy = spec.add_dummy_prefix
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model's normalizer isn't supported")
        own = [p for p in proto.pieces if p.type == 4]
        normal = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if own or any(re.search(f"[^{_MARK}]{_MARK}|{_MARK}{_MARK}+[^{_MARK}]", p) for p in normal) or any("\n" in p for p in normal):
            raise ValueError("this model's pieces can't be counted word by word")
        blank = {p for p in normal if set(p) == {_MARK} and len(p) > 1}
        if blank and max(normal[p] for p in blank) >= min(s for p, s in normal.items() if len(p) > 1 and p not in blank):
            raise ValueError("this model merges blanks before words")
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.score = {p: s for p, s in normal.items() if p not in blank}
        self.max_words, self.max_prefixes, self.max_fits = max_words, max_prefixes, max_fits
        self.fits: dict[tuple[str, str], bool] = {}
        # Pieces that their own texts encode to; only these ever end an encoding.
        self.whole = {p for p in self.score if len(p) > 1 and self._stays(p, "")}
        # By the last two characters: lengths of the pieces that end so, the longest first.
        tails: dict[str, set[int]] = {}
        for p in self.whole:
            tails.setdefault(p[-2:], set()).add(len(p))
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}
        # Counts of runs of 0, 1, 2, ... blanks, up to where they repeat.
        self.period = max(map(len, blank), default=1)
        start = len(self.lib.encode("\n"))
        self.runs = np.array([0, *(len(self.lib.encode("\n" + " " * n)) - start for n in range(1, 4 * self.period + 1))], np.int64)
        if (self.runs[1 + self.period :] != self.runs[1 : -self.period] + 1).any():
            raise ValueError("this model's counts of blanks don't repeat")
        self.hash, self.table_of, self.lists = UnitHash(11), HashTable(), Lists(np.uint8)

    def blank_counts(self, n: np.ndarray) -> np.ndarray:
        """Tokens of runs of n blanks."""
        over = np.maximum(0, -(-(n - 2 * self.period) // self.period))
        return self.runs[n - over * self.period] + over

    def _stays(self, left: str, right: str) -> bool:
        """Whether plain BPE (the best pair first, of equal ones the leftmost) of the two, joined, gives them back. With an empty right: of one piece."""
        get, none, border = self.score.get, -np.inf, len(left)
        parts = list(left + right)
        starts = list(range(len(parts)))
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i], starts[i + 1]
            if starts[i] < border < starts[i] + len(parts[i]):
                return False
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return len(parts) == (2 if right else 1)

    def _learn(self, left: str, right: str) -> bool:
        if len(self.fits) >= self.max_fits:
            self.fits.clear()
        ok = self.fits[left, right] = self._stays(left, right)
        return ok

    def table(self, word: str) -> tuple[list[int], list[bool]]:
        """For the prefixes of 0, 1, ... characters of ``word`` (one blank at most, at its start, as the mark): token counts, and whether the first token is that blank alone."""
        whole, tails, fits, learn = self.whole, self.tails, self.fits, self._learn
        counts, last, alone = [0], [""], [False]
        for i in range(1, len(word) + 1):
            for k in tails.get(word[i - 2 : i], ()) if i > 1 else ():
                if k > i:
                    continue
                token = word[i - k : i]
                if token in whole:
                    left = last[i - k]
                    # fits: whether two pieces stay as they are side by side.
                    ok = not left or fits.get((left, token))
                    if ok or ok is None and learn(left, token):
                        counts.append(counts[i - k] + 1)
                        last.append(token)
                        alone.append(alone[i - k])
                        break
            else:
                token = word[i - 1 : i]
                if token in self.score or token == _MARK:
                    if last[i - 1] and not (fits.get((last[i - 1], token)) or learn(last[i - 1], token)):
                        raise AssertionError(f"no encoding ends at {i} in {word!r}")
                    counts.append(counts[i - 1] + 1)
                    last.append(token)
                else:  # no piece of its own: its bytes, with which nothing merges
                    counts.append(counts[i - 1] + len(token.encode("utf-8", "replace")))
                    last.append("")
                alone.append(token == _MARK if i == 1 else alone[i - 1])
        return counts, alone

    def run_table(self, blanks: int, word: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, ... characters of a run of blanks and a word (without blanks) behind it."""
        if not blanks:
            return np.array(self.table(word)[0], np.int64)
        counts, alone = (np.array(x) for x in self.table(_MARK + word))
        before = self.blank_counts(np.arange(blanks + 1))
        # The last blank is the word's; if it stays alone in front of it, it is the run's.
        behind = np.where(alone[2:], before[blanks] + counts[2:] - 1, before[blanks - 1] + counts[2:])
        return np.concatenate([before, behind])

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the text's prefixes of 0, 1, ..., len(text) characters."""
        if not text:
            return np.zeros(1, np.int64)
        marked = (" " if self.dummy else "") + text.replace(_MARK, " ")
        parts, base = [np.zeros(1, np.int64)], 0
        for m in re.finditer(r"\n|( *)([^ \n]*)", marked):
            if m.end() > m.start():
                counts = np.array([0, 1]) if m[0] == "\n" else self.run_table(len(m[1]), m[2])
                parts.append(base + counts[1:])
                base += int(counts[-1])
        out = np.concatenate(parts)
        return np.concatenate([[0], out[2:]]) if self.dummy else out

    def count(self, text: str) -> int:
        """The count at the whole text: the last of its prefixes."""
        return int(self.count_column(pa.array([text], pa.string()), None)[0][0])

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])

    # --- whole columns ----------------------------------------------------------------------------
    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word's stored prefix counts; new words are reckoned and stored."""
        hashes = self.hash.of(data, starts, ends)
        numbers = self.table_of.find(hashes)
        short = ends - starts <= LONGEST
        numbers[~short] = -1
        missed = np.flatnonzero(numbers < 0)
        if len(missed):
            keep = short[missed]
            distinct, first, back = np.unique(hashes[missed[keep]], return_index=True, return_inverse=True)
            which = np.concatenate([missed[keep][first], missed[~keep]])
            held = data.tobytes()
            # For each prefix its count's growth, 0 to 4 a character, and a flag for a first blank that stays alone.
            lens, grown = [], []
            for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True):
                word = held[a:b].decode("utf-8", "replace")
                counts, alone = self.table(_MARK + word[1:] if word[:1] == " " else word)
                lens.append(len(word) + 1)
                grown += [int(alone[-1]), *(y - x + 128 for x, y in zip(counts, counts[1:], strict=False))]
            number = self.lists.append(np.array(grown, np.int64).astype(np.uint8), np.array(lens, np.int64)) + np.arange(len(which), dtype=np.int32)
            self.table_of.add(distinct, number[: len(distinct)])
            numbers[missed[keep]] = number[: len(distinct)][back]
            numbers[missed[~keep]] = number[len(distinct) :]
        return numbers

    def _stored(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each number: the word's count, whether its first blank stays alone, and its characters."""
        lists = self.lists
        if len(self._totals) < lists.n:
            new = np.arange(len(self._totals), lists.n)
            flat, ends = lists.take(new)
            firsts = np.concatenate([[0], ends[:-1]])
            growth = flat.astype(np.int64) - 128
            growth[firsts] = 0
            sums = np.concatenate([[0], np.cumsum(growth)])
            self._totals = np.concatenate([self._totals, (sums[ends] - sums[firsts]).astype(np.int64)])
            self._alone = np.concatenate([self._alone, flat[firsts] == 1])
        return self._totals[numbers], self._alone[numbers], lists.lens[numbers] - 1

    _totals, _alone = np.zeros(0, np.int64), np.zeros(0, bool)

    def count_column(self, column: pa.Array, budget: int | None) -> tuple[np.ndarray, np.ndarray]:
        """For each text its tokens and, with a ``budget``, the characters of its longest prefix of at most that many. Null is empty."""
        if pc.any(pc.match_substring(column, _MARK)).as_py():
            column = pc.replace_substring(column, _MARK, " ")
        data, at = utf8(column)
        n = len(at) - 1
        totals, chars = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        if self.dummy:  # a blank before each text, but for empty ones
            some = at[:-1] < at[1:]
            data = np.insert(data, at[:-1][some], 0x20)
            at = at + np.concatenate([[0], np.cumsum(some)])
        seen = np.zeros(n, np.int64)  # characters of each text in the blocks before
        for a, b in _whole_runs(data, at):
            if self.lists.n > self.max_words or self.lists.used > self.max_prefixes:
                self.table_of, self.lists = HashTable(), Lists(np.uint8)
                self._totals, self._alone = np.zeros(0, np.int64), np.zeros(0, bool)
            block = data[a:b]
            cuts = _CUTS[block]
            cuts[1:] |= block[:-1] == 0x0A
            cuts[at[np.searchsorted(at, a, "left") : np.searchsorted(at, b, "left")] - a] = True
            cuts[0] = True
            starts = np.flatnonzero(cuts)
            ends = np.append(starts[1:], len(block))
            of = np.searchsorted(at, starts + a, side="right") - 1
            counts, alone, width = self._stored(self._numbers(block, starts, ends))
            # A run of blanks and the word behind it are one: the run is counted by its length.
            blank = (block[starts] == 0x20) & (ends - starts == 1)
            blank[:-1] &= (block[starts[1:]] == 0x20) & (of[1:] == of[:-1])
            blank[-1:] = False
            head = np.flatnonzero(~np.concatenate([[False], blank[:-1]]))  # where a run or a word without one begins
            tail = np.append(head[1:], len(starts)) - 1
            more = tail - head  # blanks before the last
            merged = np.where(more > 0, np.where(alone[tail], self.blank_counts(more + 1) + counts[tail] - 1, self.blank_counts(more) + counts[tail]), counts[tail])
            text = of[head]
            if budget is not None:
                before = np.concatenate([[0], np.cumsum(merged)])
                length = np.concatenate([[0], np.cumsum(more + width[tail])])
                first = np.searchsorted(text, text)  # the text's first run in this block
                used = totals[text] + before[:-1] - before[first]
                over = np.flatnonzero((used + merged > budget) & (used <= budget))
                for k in over.tolist():
                    if chars[text[k]] < 0:
                        inside = self._inside(block, starts, ends, int(head[k]), int(tail[k]), int(used[k]), budget)
                        chars[text[k]] = seen[text[k]] + length[k] - length[first[k]] + inside - self.dummy
                seen += np.bincount(text, more + width[tail], n).astype(np.int64)
            totals += np.bincount(text, merged, n).astype(np.int64)
        if budget is not None:
            whole = chars < 0
            chars[whole] = seen[whole] - (self.dummy & (seen[whole] > 0))
            chars = np.maximum(chars, 0)
        return totals, chars

    def _inside(self, block: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: int, tail: int, used: int, budget: int) -> int:
        """Characters of a run and its word that still fit, from the stored counts at the word's prefixes."""
        word = block[starts[tail] : ends[tail]].tobytes().decode("utf-8", "replace")
        blanks = tail - head + (word[:1] == " ")
        counts = self.run_table(blanks, word[1:] if word[:1] == " " else word)
        return int(np.flatnonzero(used + counts <= budget)[-1])


def _whole_runs(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks that end where a word ends and no run of blanks goes on: before a blank that follows something else, or behind a line end."""
    space = np.zeros(256, bool)
    space[0x20] = space[0x0A] = True
    held: int | None = None
    for a, b in blocks(data, space):
        a = held if held is not None else a
        held = None
        if b < len(data):
            # The blank that ends the block, and those before it, go to the next one.
            c = b
            while c > a and data[c - 1] == 0x20:
                near = max(a, c - 4096)
                other = np.flatnonzero(data[near:c] != 0x20)
                c = near + int(other[-1]) + 1 if len(other) else near
            if c == a:  # all blanks: on with the next
                held = a
                continue
            held = c
            b = c
        if a < b:
            yield a, b
    if held is not None and held < len(data):
        yield held, len(data)


_OPEN: dict[str, PrefixCounter] = {}


def prefix_counter(model: str) -> PrefixCounter:
    if model not in _OPEN:
        _OPEN[model] = PrefixCounter(model)
    return _OPEN[model]


def count_tokens(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars for each row of ``docs`` (doc_id, text; null: empty).

    fit_chars: characters of the text's longest prefix of at most ``limit`` tokens. Repeated rows
    get a row each, null doc_ids are kept, an empty table gives no rows, and other columns are
    left out, whatever their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch in batches:
            for a, b in by_bytes(batch.column(2)):
                n, fit = counter.count_column(batch.column(2).slice(a, b - a), limit)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(fit)], names=["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, fit_chars long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def prefix_table(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, prefix_tokens: the token count at every prefix, to answer truncation and budgets by lookup."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for batch in batches:
            for k in range(batch.num_rows):
                counts = counter.prefix_counts(batch.column(1)[k].as_py() or "").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([counts], pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tables, "doc_id long, prefix_tokens array<int>")
