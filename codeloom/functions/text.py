"""Full-text phrases, globs, line places and fingerprints as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters (lower-cased) and what they are searched as, for ``translate``; the marks at the end are taken out.

    An ASCII letter with one mark is that letter; letters that fold to another one are that.
    Marks that make such letters fall away where they stand alone; others part terms.
    """
    letters, marks = {}, set()
    for c in map(chr, range(0xA0, 0x2000)):
        if not c.isalpha() or c != c.lower():
            continue
        plain = c.casefold() if len(c.casefold()) == 1 else c
        parts = unicodedata.normalize("NFD", plain)
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
            marks.add(parts[1])
            plain = parts[0]
        if plain != c:
            letters[c] = plain
    return "".join(letters) + "".join(sorted(marks)), "".join(letters.values())


_FROM, _TO = _folds()
_FOLD = {ord(c): _TO[i] if i < len(_TO) else None for i, c in enumerate(_FROM)}


def fts_phrases(query: str) -> list[list[str]]:
    """Terms of each blank-separated token of a query; a token's last term is a prefix. Tokens without terms drop out."""
    tokens = query.replace("\0", "").split()
    return [t for t in (re.findall(r"[^\W_]+", token.lower().translate(_FOLD)) for token in tokens) if t]


def is_blank_query(query: str | None) -> bool:
    return not (query or "").replace("\0", "").strip()


def fts_text(text: Column) -> Column:
    """The terms of a text, lower-cased and folded as ``fts_phrases`` folds a query, each behind a blank. Texts of ASCII take the fast built-ins alone."""
    low = F.lower(text)
    folded = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _FROM, _TO))
    return F.concat(F.lit(" "), F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def fts_match(columns: list[Column], query: str) -> Column:
    """Whether each phrase of the query stands in some column, its last term as a prefix. A query without terms matches nothing.

    With a blank before each term, a phrase is a piece of the text of terms.
    """
    phrases = fts_phrases(query)
    if not phrases:
        return F.lit(False)
    texts = [fts_text(c) for c in columns]
    out = F.lit(True)
    for phrase in phrases:
        any_column = F.lit(False)
        for t in texts:
            any_column = any_column | F.coalesce(F.contains(t, F.lit(" " + " ".join(phrase))), F.lit(False))
        out = out & any_column
    return out


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for ``*``, ``**``, ``?``, ``{a,b}`` and ``[...]``; ``*`` and ``?`` stay within a path part."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    """The literal start of the pattern goes to the scan as a prefix; the rest is a regular expression."""
    literal = re.match(r"[^*?{\[]*", pattern).group(0)
    return F.startswith(path, F.lit(literal)) & path.rlike(glob_regex(pattern))


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return line_count(F.substr(text, F.lit(1), offset))


def column_of(text: Column, offset: Column) -> Column:
    """0-based column: characters since the last line end before the offset."""
    return F.length(F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1))


_LINE = r"[^\n\r\u2028\u2029]*(?:\r\n|[\n\r\u2028\u2029]|\z)"
_LINE_END = r"\r\n|[\n\r\u2028\u2029]"


def line_column_to_position(text: Column, line: Column, column: Column) -> Column:
    """0-based offset of a 1-based line and 0-based column; null for a place that the text hasn't.

    A column may reach up to its line's end, the line's own end sign among it; on the last line
    up to the text's end.
    """
    n = F.regexp_count(text, F.lit(_LINE_END)) + 1
    lines = F.slice(F.regexp_extract_all(text, F.lit(_LINE), F.lit(0)), F.lit(1), n)
    start = F.length(F.array_join(F.slice(lines, F.lit(1), line - 1), ""))
    width = F.length(F.get(lines, line - 1))
    inside = (column >= 0) & ((column < width) | ((line == n) & (column == width)))
    return F.when((line >= 1) & (line <= n), F.when(inside, start + column))


def find_name_position(text: Column, start: Column, name: Column) -> Column:
    """0-based offset of the first ``name`` at or after ``start`` that stands as a whole word; null if there is none.

    What may stand in a name (ASCII letters, digits, _ and $) must not stand beside it.
    """
    # From the sign before the start on, so that it is seen but not matched.
    at = F.greatest(start, F.lit(0))
    rest = F.when(at > 0, F.substr(text, at)).otherwise(text)
    word = F.concat(F.when(at > 0, r"(?!\A)").otherwise(""), F.lit(r"(?<![A-Za-z0-9_$])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_$])"))
    found = F.regexp_instr(rest, word)
    return F.when((found > 0) & (F.length(name) > 0), found - 1 + F.greatest(at - 1, F.lit(0)))


def member_name(name: Column) -> Column:
    """What follows the first dot of a member's name; null for others."""
    at = F.instr(name, ".")
    return F.when(at > 0, F.substr(name, at + 1, F.length(name)))


def signature_of(kind: Column, parameters: Column, is_async: Column) -> Column:
    return F.when(kind.isin("function", "method"), F.concat(F.lit("params:"), F.coalesce(F.size(parameters), F.lit(0)).cast("string"), F.lit("|async:"), F.when(is_async, "1").otherwise("0")))


def fingerprint_of(name: Column, kind: Column, signature: Column) -> Column:
    return F.md5(F.concat_ws("|", name, kind, F.coalesce(signature, F.lit(""))).cast("binary"))


def structural_fingerprint_of(kind: Column, modifiers: Column, heritage: Column, n_parameters: Column, return_type: Column, members: Column) -> Column:
    """A symbol's shape without its name; order of modifiers, heritage and members doesn't matter."""
    join = lambda a: F.array_join(F.array_sort(F.coalesce(a, F.array().cast("array<string>"))), ",")
    return F.md5(F.concat_ws("|", kind, join(modifiers), join(heritage), n_parameters.cast("string"), F.coalesce(return_type, F.lit("")), join(members)).cast("binary"))


def metavariables(pattern: Column) -> Column:
    return F.regexp_extract_all(pattern, F.lit(r"\$\{1,3}([A-Z_][A-Z_0-9]*)".replace(r"\$\{", r"\${")), F.lit(1))
