"""Structural search: a pattern of tokens with ``$X`` (one expression) and ``$$$X`` (any number of list parts)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codeloom.extract.lexer import Lines, Token, lex

MATCHES = "file_path string, start_line int, end_line int, text string, captures map<string,string>"
_OPEN, _CLOSE = "([{", ")]}"


def _pattern_tokens(pattern: str) -> list[str]:
    return [t.text for t in lex(re.sub(r"\$\$\$([A-Z_])", r"__many_\1", pattern)).tokens if t.kind != "end"]


def match_at(tokens: list[Token], i: int, pattern: list[str], text: str) -> tuple[int, dict[str, str]] | None:
    """Where a match from token ``i`` ends, and its captures. The same name must capture the same text."""

    def go(i: int, k: int, got: dict[str, str]) -> tuple[int, dict[str, str]] | None:
        if k == len(pattern):
            return i, got
        p = pattern[k]
        one, many = re.fullmatch(r"\$([A-Z_][A-Z_0-9]*)", p), re.fullmatch(r"__many_([A-Z_0-9]*)", p)
        if not one and not many:
            return go(i + 1, k + 1, got) if tokens[i].text == p and tokens[i].kind != "end" else None
        name, depth, ends = (one or many)[1], 0, [i] if many else []
        j = i
        while tokens[j].kind != "end":
            x = tokens[j].text if tokens[j].kind == "sign" else ""
            if x and x in _CLOSE and depth == 0 or x == ";" and depth == 0 or x == "," and depth == 0 and one:
                break
            depth += (x != "" and x in _OPEN) - (x != "" and x in _CLOSE)
            j += 1
            if depth == 0:
                ends.append(j)
        for e in ends:
            part = text[tokens[i].start : tokens[e - 1].end] if e > i else ""
            if name != "_" and got.get(name, part) != part:
                continue
            parts = re.sub(r"\s*,\s*", ", ", part) if many else part
            if found := go(e, k + 1, {**got, name: parts}):
                return found
        return None

    return go(i, 0, {})


def find_pattern(files: DataFrame, pattern: str) -> DataFrame:
    """MATCHES of a pattern in files (file_path, content): 1-based lines, the text and what was captured."""
    wanted = _pattern_tokens(pattern)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in batch.itertuples(index=False):
                tokens, lines, i = lex(text or "").tokens, Lines(text or ""), 0
                while wanted and i < len(tokens) - 1:
                    hit = match_at(tokens, i, wanted, text)
                    if hit and hit[0] > i:
                        a, b = tokens[i].start, tokens[hit[0] - 1].end
                        out.append((path, lines.place(a)[0], lines.place(b)[0], text[a:b], hit[1]))
                    i += 1
            yield pd.DataFrame(out, columns=["file_path", "start_line", "end_line", "text", "captures"])

    return files.select("file_path", "content").mapInPandas(search, MATCHES)
