"""Bindings of a file and their references, by scopes of blocks and functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.extract.lexer import Lines, lex

SCHEMA = "file_path string, name string, declared_line int, declared_column int, line int, column int, is_declaration boolean, write_kind string, scope_kind string"
_DECLARES = set("const let var function class interface type enum namespace import".split())
_COMPOUND = set("+= -= *= /= %= **= <<= >>= >>>= &= |= ^=".split())
_LOGICAL = set("&&= ||= ??=".split())
_WORDS = set("if for while do switch case return new typeof await yield throw else try catch finally in of instanceof void delete super this import export from as default extends implements const let var function class interface type enum namespace async static public private protected readonly declare abstract true false null undefined break continue get set keyof is".split())


def bindings_of(text: str) -> list[dict]:
    """Each use of a name that some scope of the file declares, with the declaration it means (hoisted, innermost first)."""
    t, lines = lex(text).tokens, Lines(text)
    scopes: list[dict] = [{"kind": "module", "start": 0, "end": len(t), "up": None, "names": {}}]
    at, stack, pending = [0] * len(t), [0], None
    parens: list[int] = []
    for i, x in enumerate(t):
        at[i] = stack[-1]
        if x.kind == "name" and x.text == "function" or x.text == "=>":
            pending = "function"
        if x.kind != "sign":
            continue
        if x.text == "(":
            close = _closing(t, i)
            follows = t[close + 1].text if close + 1 < len(t) else ""
            before = t[i - 1] if i else None
            is_head = pending == "function" or follows in ("=>", "{", ":") and before is not None and (before.kind == "name" and before.text not in _WORDS or follows == "=>")
            if is_head:
                scopes.append({"kind": "function", "start": i, "end": len(t), "up": stack[-1], "names": {}, "head": close})
                parens.append(len(scopes) - 1)
                at[i] = len(scopes) - 1
                for k in range(i + 1, close):
                    if t[k].kind == "name" and (t[k - 1].text in ("(", ",", "...", "{", "[") or t[k - 1].text in ("public", "private", "protected", "readonly")) and t[k].text not in _WORDS:
                        scopes[-1]["names"].setdefault(t[k].text, k)
                stack.append(len(scopes) - 1)
                scopes[-1]["open"] = None
                pending = "body"
        elif x.text == "{":
            top = scopes[stack[-1]]
            if top["kind"] == "function" and top.get("open") is None and i > top["head"]:
                top["open"] = i
                pending = None
            else:
                scopes.append({"kind": "block", "start": i, "end": len(t), "up": stack[-1], "names": {}, "open": i})
                stack.append(len(scopes) - 1)
            at[i] = stack[-1]
        elif x.text == "}" and len(stack) > 1:
            while len(stack) > 2 and scopes[stack[-1]]["kind"] == "function" and scopes[stack[-1]].get("open") is None:
                scopes[stack.pop()]["end"] = i  # an arrow function whose body is an expression
            scopes[stack[-1]]["end"] = i
            stack.pop()
        elif x.text in (";", ",", ")") and len(stack) > 1 and scopes[stack[-1]]["kind"] == "function" and scopes[stack[-1]].get("open") is None and i > scopes[stack[-1]]["head"]:
            scopes[stack[-1]]["end"] = i
            stack.pop()
            at[i] = stack[-1]
    declared: set[int] = set()
    for s in scopes:
        declared.update(s["names"].values())
    for i, x in enumerate(t[:-1]):
        if x.kind != "name" or x.text not in _DECLARES or i and t[i - 1].text == ".":
            continue
        k, where = i + 1, at[i]
        if x.text == "var":
            while scopes[where]["kind"] == "block":
                where = scopes[where]["up"]
        if x.text == "import":
            while k < len(t) and t[k].kind != "string" and t[k].text != "from":
                if t[k].kind == "name" and t[k].text not in ("type", "as") and t[k + 1].text != "as":
                    scopes[where]["names"].setdefault(t[k].text, k)
                    declared.add(k)
                k += 1
            continue
        k += t[k].text == "*"
        ends = _closing(t, k) if t[k].text in "{[" else k
        for q in range(k, ends + 1):
            if t[q].kind == "name" and t[q].text not in _WORDS and t[q + 1].text != ":":
                scopes[where]["names"].setdefault(t[q].text, q)
                declared.add(q)
    out = []
    for i, x in enumerate(t[:-1]):
        if x.kind != "name" or x.text in _WORDS or i and t[i - 1].text in (".", "?.") or t[i + 1].text == ":" and i not in declared and t[i - 1].text in ("{", ","):
            continue
        s: int | None = at[i]
        while s is not None and x.text not in scopes[s]["names"]:
            s = scopes[s]["up"]
        if s is None:
            continue
        where = scopes[s]["names"][x.text]
        (l1, c1), (l2, c2) = lines.place(t[where].start), lines.place(x.start)
        nxt, prev = t[i + 1].text, t[i - 1].text if i else ""
        kind = "declaration" if i == where else "assignment" if nxt == "=" else "compound" if nxt in _COMPOUND else "logical" if nxt in _LOGICAL else "update" if nxt in ("++", "--") or prev in ("++", "--") else None
        out.append({"name": x.text, "declared_line": l1, "declared_column": c1, "line": l2, "column": c2, "is_declaration": i == where, "write_kind": kind, "scope_kind": scopes[at[i]]["kind"]})
    return out


def _closing(t: list, i: int) -> int:
    depth = 0
    for k in range(i, len(t)):
        if t[k].kind == "sign" and t[k].text in "([{":
            depth += 1
        elif t[k].kind == "sign" and t[k].text in ")]}":
            depth -= 1
            if depth == 0:
                return k
    return len(t) - 1


def file_bindings(files: DataFrame) -> DataFrame:
    """SCHEMA for files (file_path, content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [{"file_path": p, **b} for p, text in batch.itertuples(index=False) for b in bindings_of(text or "")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file_path", "content").mapInPandas(read, SCHEMA)


def write_kind(operator: Column, is_declaration: Column) -> Column:
    """How an operator next to a name writes to it; null for a plain read."""
    return (
        F.when(is_declaration, "declaration").when(operator == "=", "assignment").when(operator.isin(*_COMPOUND), "compound")
        .when(operator.isin(*_LOGICAL), "logical").when(operator.isin("++", "--"), "update")
    )
