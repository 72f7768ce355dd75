"""Tokens and comments of TypeScript source."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SPACE = re.compile(r"[ \t\r\n\v\f\u00a0\ufeff\u2028\u2029]+")
_NAME = re.compile(r"[#@]?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"0[xXbBoO][0-9a-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
# Operators, the longest first, and words after which a slash starts a pattern.
_SIGN = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[-+*/%&|^!~?:;,.=<>()\[\]{}@#]")
_BEFORE_PATTERN = set("return typeof case in of do else void delete throw new instanceof yield await".split())


@dataclass
class Token:
    kind: str  # name, number, string, template, regex, sign, end
    text: str
    start: int
    end: int


@dataclass
class Comment:
    kind: str  # line, block, jsdoc
    text: str
    start: int
    end: int


@dataclass
class Lexed:
    tokens: list[Token]
    comments: list[Comment]
    errors: list[str] = field(default_factory=list)


def _template_end(src: str, at: int) -> int:
    """Past the closing backquote of the template that starts at ``at``; its expressions may hold templates."""
    i = at + 1
    while i < len(src):
        c = src[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif src.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(src) and depth:
                if src[i] == "{":
                    depth += 1
                elif src[i] == "}":
                    depth -= 1
                elif src[i] == "`":
                    i = _template_end(src, i) - 1
                elif src[i] in "'\"" and (m := _STRING.match(src, i)):
                    i = m.end() - 1
                i += 1
        else:
            i += 1
    return len(src)


def lex(src: str) -> Lexed:
    tokens: list[Token] = []
    comments: list[Comment] = []
    errors: list[str] = []
    i, n = 0, len(src)
    if src.startswith("#!"):
        i = src.find("\n") if "\n" in src else n
    while i < n:
        if m := _SPACE.match(src, i):
            i = m.end()
            continue
        if src.startswith("//", i):
            end = src.find("\n", i)
            end = n if end < 0 else end
            comments.append(Comment("line", src[i + 2 : end], i, end))
            i = end
            continue
        if src.startswith("/*", i):
            end = src.find("*/", i + 2)
            if end < 0:
                errors.append(f"comment without end at {i}")
            end = n if end < 0 else end + 2
            comments.append(Comment("jsdoc" if src.startswith("/**", i) and src[i : i + 4] != "/**/" else "block", src[i:end], i, end))
            i = end
            continue
        c = src[i]
        kind, end = "", i
        if c == "`":
            kind, end = "template", _template_end(src, i)
        elif c in "'\"" and (m := _STRING.match(src, i)):
            kind, end = "string", m.end()
        elif c == "/" and _pattern_may_start(tokens) and (m := _REGEX.match(src, i)):
            kind, end = "regex", m.end()
        elif (c.isdigit() or c == "." and src[i + 1 : i + 2].isdigit()) and (m := _NUMBER.match(src, i)):
            kind, end = "number", m.end()
        elif c != "@" and (m := _NAME.match(src, i)):
            kind, end = "name", m.end()
        elif m := _SIGN.match(src, i):
            kind, end = "sign", m.end()
        else:
            errors.append(f"unexpected {c!r} at {i}")
            i += 1
            continue
        tokens.append(Token(kind, src[i:end], i, end))
        i = end
    tokens.append(Token("end", "", n, n))
    return Lexed(tokens, comments, errors)


def _pattern_may_start(tokens: list[Token]) -> bool:
    if not tokens:
        return True
    last = tokens[-1]
    if last.kind == "name":
        return last.text in _BEFORE_PATTERN
    return last.kind == "sign" and last.text not in (")", "]", "}", "++", "--")


class Lines:
    """1-based lines and 0-based columns of offsets."""

    def __init__(self, src: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", src))]

    def place(self, offset: int) -> tuple[int, int]:
        import bisect

        k = bisect.bisect_right(self.starts, offset) - 1
        return k + 1, offset - self.starts[k]


def string_value(text: str) -> str:
    body = text[1:-1]
    return re.sub(r"\\(u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[\s\S])", _unescape, body) if "\\" in body else body


def _unescape(m: re.Match) -> str:
    code = m[2] or m[3] or m[4]
    if code:
        return chr(int(code, 16))
    return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}.get(m[1], m[1])
