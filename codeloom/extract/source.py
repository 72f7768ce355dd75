"""Symbols, imports, calls, heritage and annotations of a TypeScript file.

A hand-written reader of declarations: it follows brackets, modifiers and headers, keeps
types and initializers as text, and walks function bodies for calls. What it can't read is
noted as an error and skipped; no source makes it fail.
"""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass, field

from codeloom.extract.lexer import Comment, Lines, Token, lex, string_value

# Words of the language.
MODIFIERS = set("export default declare abstract async static readonly public private protected override accessor const".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_KEYWORDS = set("if for while switch catch return function class new typeof await yield throw else do try finally case in of instanceof void delete super import export const let var this with async".split())
_ENDERS = set("function class interface enum namespace module type const let var import export abstract declare async".split())


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    is_exported: bool = False
    modifiers: list[str] = field(default_factory=list)
    parameters: list[dict] = field(default_factory=list)
    return_type: str | None = None
    heritage: list[dict] = field(default_factory=list)
    decorators: list[dict] = field(default_factory=list)
    type_parameters: list[str] = field(default_factory=list)
    initializer: str | None = None
    members: list[Symbol] = field(default_factory=list)
    js_doc: str | None = None
    method_kind: str | None = None
    is_async: bool = False
    body: tuple[int, int] | None = None  # tokens of its block

    def detail(self) -> dict:
        out: dict = {}
        for key, value in (
            ("parameters", self.parameters), ("returnType", self.return_type), ("heritage", self.heritage), ("decorators", self.decorators), ("typeParameters", self.type_parameters),
            ("modifiers", self.modifiers), ("initializer", self.initializer), ("jsDoc", self.js_doc),
            ("members", [{"name": m.name, "kind": m.method_kind or m.kind, "type": m.return_type} for m in self.members]),
        ):
            if value:
                out[key] = value
        return out


@dataclass
class Import:
    """A binding of an import or re-export; ``kind`` is the relation's type."""

    kind: str
    specifier: str
    local: str | None  # name in this file
    imported: str | None  # name there; ``*`` for all
    meta: dict = field(default_factory=dict)


class Source:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        lexed = lex(text)
        self.t, self.comments, self.errors = lexed.tokens, lexed.comments, lexed.errors
        self.lines = Lines(text)
        self.symbols: list[Symbol] = []
        self.imports: list[Import] = []
        self.exported_later: set[str] = set()
        self.match = self._brackets()
        try:
            self._statements(0, len(self.t) - 1, self.symbols, top=True)
        except (IndexError, RecursionError) as e:
            self.errors.append(f"reading stopped: {type(e).__name__}")
        for s in self.symbols:
            if s.name in self.exported_later:
                s.is_exported = True
        self._attach_docs()

    # --- tokens -----------------------------------------------------------------------------
    def _brackets(self) -> dict[int, int]:
        out: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "sign" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "sign" and t.text in _CLOSE:
                while stack and _OPEN[self.t[stack[-1]].text] != t.text:
                    self.errors.append(f"unmatched {self.t[stack.pop()].text}")
                if stack:
                    out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.t) - 1
            self.errors.append(f"unclosed {self.t[i].text}")
        return out

    def _is(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].text in texts and self.t[i].kind in ("sign", "name")

    def _past(self, i: int) -> int:
        """Past a token, or past the bracket's end that it opens."""
        return self.match[i] + 1 if i in self.match else i + 1

    def _text(self, a: int, b: int) -> str:
        return self.text[self.t[a].start : self.t[b - 1].end] if b > a else ""

    def _angle(self, i: int) -> int:
        """Past type parameters that start at ``<``."""
        depth = 0
        while self.t[i].kind != "end":
            x = self.t[i].text
            if self.t[i].kind == "sign" and x and set(x) <= {"<"}:
                depth += len(x)
            elif self.t[i].kind == "sign" and x and set(x) <= {">"}:
                depth -= len(x)
                if depth <= 0:
                    return i + 1
            i = self._past(i)
        return i

    def _newline_between(self, a: int, b: int) -> bool:
        return "\n" in self.text[self.t[a].end : self.t[b].start]

    def _type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """Past a type: up to a stop at its own depth."""
        first = i
        while self.t[i].kind != "end":
            x = self.t[i].text
            if self.t[i].kind == "sign" and x in stops and not (x == "{" and (i == first or self.t[i - 1].text in ("|", "&", ":", "=>", "=", "extends", "keyof", ",", "<"))):
                return i
            if self.t[i].text == "<" and self.t[i].kind == "sign":
                i = self._angle(i)
                continue
            if self.t[i].kind == "sign" and x in _CLOSE:
                return i
            if i > first and self._newline_between(i - 1, i) and self.t[i - 1].text not in ("|", "&", "=>", ":", "=", "?", "extends", ",", "keyof", "typeof", ".") and x not in ("|", "&", "=>", "?", ":", "extends", ".", "[") and ";" in stops:
                return i
            i = self._past(i)
        return i

    def _statement_end(self, i: int, limit: int) -> int:
        """Past a statement: a semicolon, or a line end before a word that starts another."""
        first = i
        while i < limit:
            x = self.t[i]
            if x.text == ";" and x.kind == "sign":
                return i + 1
            if i > first and self._newline_between(i - 1, i):
                before = self.t[i - 1]
                goes_on = before.kind == "sign" and before.text not in (")", "]", "}", "++", "--") or x.kind == "sign" and x.text in (".", "?.", "(", "[", "?", ":", "+", "-", "*", "/", "&&", "||", "??", "=", "=>", ",", "|", "&", "==", "===")
                if not goes_on:
                    return i
            i = self._past(i)
        return i

    # --- statements -------------------------------------------------------------------------
    def _statements(self, i: int, limit: int, out: list[Symbol], top: bool, exported_only: bool = False) -> None:
        while i < limit:
            start = i
            found: list[Symbol] = []
            i = self._statement(i, limit, found, top)
            if exported_only:
                found = [s for s in found if s.is_exported]
            out.extend(found)
            if i <= start:
                i = self._past(start)

    def _statement(self, i: int, limit: int, out: list[Symbol], top: bool) -> int:
        start, decorators = i, []
        while self._is(i, "@"):
            i = self._decorator(i, decorators)
        modifiers: list[str] = []
        while self.t[i].kind == "name" and self.t[i].text in MODIFIERS and not self._is(i + 1, "(", "=", ":", ".", ";", ","):
            if self.t[i].text == "const" and not self._is(i + 1, "enum"):
                break
            modifiers.append(self.t[i].text)
            i += 1
            while self._is(i, "@"):
                i = self._decorator(i, decorators)
        x, exported = self.t[i].text, "export" in modifiers
        common = {"is_exported": exported, "decorators": decorators, "modifiers": [m for m in modifiers if m not in ("export", "default")], "start": self.t[start].start}
        if x == "import" and not exported and not self._is(i + 1, "(", "."):
            return self._import(i, limit)
        if exported and x in ("{", "*") or exported and x == "type" and self._is(i + 1, "{", "*"):
            return self._re_export(i, limit)
        if exported and x == "=":
            return self._statement_end(i, limit)
        if x == "function":
            return self._function(i, common, out, "default" in modifiers, limit)
        if x == "class":
            return self._class(i, common, out, limit)
        if x == "interface" and self.t[i + 1].kind == "name":
            return self._class(i, common, out, limit)
        if x == "enum" and self.t[i + 1].kind == "name":
            return self._enum(i, common, out)
        if x in ("namespace", "module") and self.t[i + 1].kind in ("name", "string") and not self._newline_between(i, i + 1):
            return self._namespace(i, common, out)
        if x == "type" and self.t[i + 1].kind == "name" and (self._is(i + 2, "=", "<")):
            return self._alias(i, common, out, limit)
        if x in ("const", "let", "var"):
            return self._variables(i, common, out, limit)
        if exported and "default" in modifiers:
            end = self._statement_end(i, limit)
            if self.t[i].kind == "name" and end - i <= 2:
                self.exported_later.add(x)
                return end
            arrow = any(self._is(k, "=>") for k in range(i, end)) or "async" in modifiers
            out.append(Symbol("function" if arrow else "variable", "default", end=self.t[end - 1].end, initializer=self._text(i, end).rstrip(";"), **common))
            return end
        return self._statement_end(i, limit)

    def _decorator(self, i: int, out: list[dict]) -> int:
        k = i + 1
        while self.t[k].kind == "name" and self._is(k + 1, "."):
            k += 2
        name, k = self._text(i + 1, k + 1), k + 1
        arguments: list[str] = []
        if self._is(k, "("):
            arguments = [self._text(a, b) for a, b in self._list(k)]
            k = self._past(k)
        out.append({"name": name, "arguments": arguments} if arguments else {"name": name})
        return k

    def _list(self, i: int) -> list[tuple[int, int]]:
        """Token ranges of the parts between commas of the bracket at ``i``."""
        out, a, k, end = [], i + 1, i + 1, self.match[i]
        while k < end:
            if self._is(k, ","):
                out.append((a, k))
                a = k + 1
                k += 1
            elif self._is(k, "<") and self.t[k - 1].kind == "name" and (past := self._angle(k)) <= end and not any(self._is(q, "&&", "||", ";") for q in range(k, past)):
                k = past
            else:
                k = self._past(k)
        if a < end:
            out.append((a, end))
        return out

    def _type_parameters(self, i: int) -> tuple[list[str], int]:
        if not self._is(i, "<"):
            return [], i
        end = self._angle(i)
        out, a, k = [], i + 1, i + 1
        while k < end - 1:
            if self._is(k, ","):
                out.append(self._text(a, k))
                a, k = k + 1, k + 1
            elif self._is(k, "<"):
                k = self._angle(k)
            else:
                k = self._past(k)
        if a < end - 1:
            out.append(self._text(a, end - 1))
        return [p.split(" ")[0] for p in out], end

    def _parameters(self, i: int) -> list[dict]:
        out = []
        for a, b in self._list(i):
            decorators: list[dict] = []
            while self._is(a, "@"):
                a = self._decorator(a, decorators)
            while self.t[a].text in ("public", "private", "protected", "readonly", "override") and a + 1 < b and self.t[a + 1].kind == "name":
                a += 1
            k, rest = a, ""
            if self._is(k, "..."):
                rest, k = "...", k + 1
            name_end = self._past(k)
            p: dict = {"name": rest + self._text(k, name_end)}
            k = name_end
            p["isOptional"] = False
            if self._is(k, "?"):
                p["isOptional"], k = True, k + 1
            if self._is(k, ":"):
                e = min(self._type_end(k + 1, ("=",)), b)
                p["type"], k = self._text(k + 1, e), e
            if k < b and self._is(k, "="):
                p["defaultValue"], p["isOptional"] = self._text(k + 1, b), True
            if decorators:
                p["decorators"] = decorators
            out.append(p)
        return out

    def _header(self, i: int, s: Symbol, stops: tuple[str, ...] = ("{", ";", ",")) -> int:
        """Type parameters, parameters and return type from ``i`` on."""
        s.type_parameters, i = self._type_parameters(i)
        if self._is(i, "("):
            s.parameters = self._parameters(i)
            i = self._past(i)
        if self._is(i, ":"):
            e = self._type_end(i + 1, stops)
            s.return_type, i = self._text(i + 1, e), e
        return i

    def _block(self, i: int, s: Symbol) -> int:
        if self._is(i, "{"):
            s.body = (i, self.match[i])
            s.end = self.t[self.match[i]].end
            return self._past(i)
        s.end = self.t[i - 1].end
        return i + 1 if self._is(i, ";") else i

    def _function(self, i: int, common: dict, out: list[Symbol], default: bool, limit: int) -> int:
        i += 1
        if self._is(i, "*"):
            i += 1
        name = self.t[i].text if self.t[i].kind == "name" else "default"
        i += self.t[i].kind == "name"
        s = Symbol("function", name, end=0, is_async="async" in common["modifiers"], **common)
        out.append(s)
        return self._block(self._header(i, s), s)

    def _class(self, i: int, common: dict, out: list[Symbol], limit: int) -> int:
        kind = self.t[i].text
        i += 1
        name = "default"
        if self.t[i].kind == "name" and self.t[i].text not in ("extends", "implements"):
            name, i = self.t[i].text, i + 1
        s = Symbol(kind, name, end=0, **common)
        s.type_parameters, i = self._type_parameters(i)
        while self._is(i, "extends", "implements"):
            how, i = self.t[i].text, i + 1
            while not self._is(i, "{", "extends", "implements") and self.t[i].kind != "end":
                a = i
                while self.t[i].kind != "end" and not self._is(i, "{", ",", "implements", "<"):
                    i = self._past(i)
                if i == a:
                    i += 1
                h: dict = {"kind": how, "name": self._text(a, i)}
                if self._is(i, "<"):
                    e = self._angle(i)
                    h["typeArguments"], i = [self._text(i + 1, e - 1)], e
                if h["name"] and h["name"] != ",":
                    s.heritage.append(h)
                if self._is(i, ","):
                    i += 1
        out.append(s)
        if self._is(i, "{"):
            self._members(i, s)
        return self._block(i, s)

    def _members(self, i: int, s: Symbol) -> None:
        end, i = self.match[i], i + 1
        while i < end:
            if self._is(i, ";", ","):
                i += 1
                continue
            start, decorators, modifiers = i, [], []
            while self._is(i, "@"):
                i = self._decorator(i, decorators)
            while self.t[i].kind == "name" and self.t[i].text in MODIFIERS and not self._is(i + 1, "(", "=", ":", ";", "?", "!", "}", ",") and i + 1 < end:
                modifiers.append(self.t[i].text)
                i += 1
            if modifiers == ["static"] and self._is(i, "{"):
                i = self._past(i)
                continue
            how = None
            if self.t[i].text in ("get", "set") and not self._is(i + 1, "(", "=", ":", ";", "?", ",", "}"):
                how, i = {"get": "getter", "set": "setter"}[self.t[i].text], i + 1
            if self._is(i, "*"):
                i += 1
            if self._is(i, "("):
                i = self._type_end(i, (";", ","))  # a call signature
                continue
            if self._is(i, "["):
                name, i = self._text(i, self._past(i)), self._past(i)
                if ":" in name and s.kind == "interface":
                    i = self._type_end(i, (";", ","))
                    continue
            else:
                name, i = (string_value(self.t[i].text) if self.t[i].kind == "string" else self.t[i].text), i + 1
            m = Symbol("property", name, self.t[start].start, 0, modifiers=modifiers, decorators=decorators, is_async="async" in modifiers)
            if self._is(i, "?", "!"):
                i += 1
            if self._is(i, "(", "<"):
                m.kind, m.method_kind = "method", how or ("constructor" if name == "constructor" else "method")
                i = self._block(self._header(i, m), m)
            else:
                if self._is(i, ":"):
                    e = self._type_end(i + 1, ("=", ";", ","))
                    m.return_type, i = self._text(i + 1, e), e
                if self._is(i, "="):
                    e = min(self._statement_end(i + 1, end), end)
                    m.initializer, i = self._text(i + 1, e).rstrip(";"), e
                m.end = self.t[max(start, i - 1)].end
            s.members.append(m)
            if i <= start:
                i = self._past(start)

    def _enum(self, i: int, common: dict, out: list[Symbol]) -> int:
        s = Symbol("enum", self.t[i + 1].text, end=0, **common)
        out.append(s)
        if self._is(i + 2, "{"):
            for a, b in self._list(i + 2):
                name = string_value(self.t[a].text) if self.t[a].kind == "string" else self.t[a].text
                s.members.append(Symbol("property", name, self.t[a].start, self.t[b - 1].end, initializer=self._text(a + 2, b) or None))
        return self._block(i + 2, s)

    def _namespace(self, i: int, common: dict, out: list[Symbol]) -> int:
        k = i + 1
        while self._is(k + 1, "."):
            k += 2
        name = self._text(i + 1, k + 1)
        s = Symbol("namespace", string_value(name) if name[:1] in "'\"" else name, end=0, **common)
        out.append(s)
        if self._is(k + 1, "{"):
            self._statements(k + 2, self.match[k + 1], s.members, top=False, exported_only=True)
        return self._block(k + 1, s)

    def _alias(self, i: int, common: dict, out: list[Symbol], limit: int) -> int:
        s = Symbol("type", self.t[i + 1].text, end=0, **common)
        s.type_parameters, k = self._type_parameters(i + 2)
        e = min(self._type_end(k + 1, (";",)), limit)
        s.initializer, s.end = self._text(k + 1, e), self.t[e - 1].end
        out.append(s)
        return e + 1 if self._is(e, ";") else e

    def _variables(self, i: int, common: dict, out: list[Symbol], limit: int) -> int:
        end = self._statement_end(i, limit)
        how, k = self.t[i].text, i + 1
        common = common | {"modifiers": [*common["modifiers"], *(["const"] if how == "const" else [])]}
        while k < end and not self._is(k, ";"):
            a, names_end = k, self._past(k)
            names = self._pattern(k) if self._is(k, "{", "[") else [self.t[k].text]
            k = names_end
            annotation = None
            if self._is(k, "!"):
                k += 1
            if self._is(k, ":"):
                e = min(self._type_end(k + 1, ("=", ",", ";")), end)
                annotation, k = self._text(k + 1, e), e
            value = None
            s = Symbol("variable", names[0] if names else "", end=0, return_type=annotation, **common)
            if self._is(k, "="):
                b = k + 1
                k = self._initializer_end(b, end)
                value = (b, k)
                s.initializer = self._text(b, k).rstrip(";")
                self._function_value(b, k, s)
            stop = self.t[max(a, k - 1)].end
            for n, name in enumerate(names):
                copy = s if n == 0 else Symbol(s.kind, name, end=0, return_type=None, initializer=s.initializer, **common)
                copy.end, copy.start = stop, common["start"]
                out.append(copy)
            if value is None and k == names_end and not self._is(k, ",", ";") and k < end:
                break
            if self._is(k, ","):
                k += 1
            elif k < end and not self._is(k, ";"):
                break
        return end

    def _initializer_end(self, i: int, limit: int) -> int:
        while i < limit and not self._is(i, ",", ";"):
            i = self._past(i)
        return i

    def _function_value(self, b: int, e: int, s: Symbol) -> None:
        """Header and body of an initializer that is a function."""
        k = b
        if self._is(k, "async"):
            s.is_async, k = True, k + 1
        if self._is(k, "function"):
            s.kind, k = "function", k + 1
            k += self._is(k, "*")
            k += self.t[k].kind == "name"
            s.return_type = None
            self._block(self._header(k, s), s)
            return
        if self.t[k].kind == "name" and self._is(k + 1, "=>"):
            s.kind, s.parameters = "function", [{"name": self.t[k].text, "isOptional": False}]
            k += 2
        else:
            _, q = self._type_parameters(k)
            if not self._is(q, "("):
                return
            after = self._past(q)
            if self._is(after, ":"):
                after = self._type_end(after + 1, ("=>",))
            if not self._is(after, "=>"):
                return
            s.kind = "function"
            s.return_type = None
            k = self._header(k, s, ("=>",)) + 1
        s.body = (k, self.match[k]) if self._is(k, "{") else (k - 1, e)

    def _pattern(self, i: int) -> list[str]:
        """Names that a destructuring pattern binds."""
        out: list[str] = []
        for a, b in self._list(i):
            if self._is(a, "..."):
                a += 1
            k = a
            if self._is(i, "{"):
                colon = self._past(a)
                if self._is(colon, ":"):
                    k = colon + 1
            if self._is(k, "{", "["):
                out += self._pattern(k)
            elif k < b and self.t[k].kind == "name":
                out.append(self.t[k].text)
        return out

    # --- imports ------------------------------------------------------------------------------
    def _import(self, i: int, limit: int) -> int:
        end, k = self._statement_end(i, limit), i + 1
        kind, meta = "imports", {}
        if self._is(k, "type") and not self._is(k + 1, "from", ",", "="):
            kind, meta, k = "type-references", {"isType": True}, k + 1
        if self.t[k].kind == "string":
            self.imports.append(Import(kind, string_value(self.t[k].text), None, None, meta))
            return end
        at = next((q for q in range(end - 1, k - 1, -1) if self.t[q].kind == "string" and self._is(q - 1, "from")), None)
        if at is None:
            return end
        spec = string_value(self.t[at].text)
        while k < at - 1:
            if self._is(k, "{"):
                for a, b in self._list(k):
                    own_kind, own_meta = kind, dict(meta)
                    if self._is(a, "type") and b - a > 1 and not self._is(a + 1, "as"):
                        own_kind, own_meta, a = "type-references", {"isType": True}, a + 1
                    name = string_value(self.t[a].text) if self.t[a].kind == "string" else self.t[a].text
                    self.imports.append(Import(own_kind, spec, self.t[b - 1].text, name, own_meta | {"importKind": "named"}))
                k = self._past(k)
            elif self._is(k, "*"):
                self.imports.append(Import(kind, spec, self.t[k + 2].text, "*", meta | {"importKind": "namespace"}))
                k += 3
            elif self._is(k, ","):
                k += 1
            else:
                self.imports.append(Import(kind, spec, self.t[k].text, "default", meta | {"importKind": "default"}))
                k += 1
        return end

    def _re_export(self, i: int, limit: int) -> int:
        end, kind, meta = self._statement_end(i, limit), "re-exports", {"isReExport": True}
        if self._is(i, "type"):
            kind, meta, i = "type-references", {"isReExport": True, "isType": True}, i + 1
        at = next((q for q in range(end - 1, i - 1, -1) if self.t[q].kind == "string" and self._is(q - 1, "from")), None)
        spec = string_value(self.t[at].text) if at is not None else None
        if self._is(i, "*"):
            if spec is not None:
                alias = self.t[i + 2].text if self._is(i + 1, "as") else None
                self.imports.append(Import(kind, spec, alias, "*", meta | ({"namespaceAlias": alias} if alias else {})))
            return end
        pairs = []
        for a, b in self._list(i):
            if self._is(a, "type") and b - a > 1 and not self._is(a + 1, "as"):
                a += 1
            pairs.append({"local": self.t[a].text, "exported": self.t[b - 1].text})
        if spec is not None:
            self.imports.append(Import(kind, spec, None, None, meta | {"specifiers": pairs}))
            return end
        for p in pairs:
            self.exported_later.add(p["local"])
            origin = next((x for x in self.imports if x.local == p["local"] and x.imported and x.kind in ("imports", "type-references")), None)
            if origin:
                self.imports.append(Import("type-references" if origin.kind == "type-references" else kind, origin.specifier, None, origin.imported, meta | {"specifiers": [{"local": origin.imported, "exported": p["exported"]}]}))
        return end

    def dynamic_imports(self) -> list[Import]:
        out = []
        for i, t in enumerate(self.t[:-2]):
            if t.kind != "name" or i and self._is(i - 1, "."):
                continue
            k, meta = i + 1, None
            if t.text == "import" and self._is(k, "("):
                meta = {"isDynamic": True}
            elif t.text == "require" and self._is(k, "("):
                meta = {"isRequire": True}
            elif t.text == "require" and self._is(k, ".") and self._is(k + 1, "resolve") and self._is(k + 2, "("):
                meta, k = {"isRequireResolve": True}, k + 2
            if meta and self.t[k + 1].kind == "string" and self._is(k + 2, ")"):
                out.append(Import("imports", string_value(self.t[k + 1].text), None, None, meta))
        return out

    # --- relations of symbols -----------------------------------------------------------------
    @functools.cached_property
    def _bound(self) -> dict[str, Import]:
        return {x.local: x for x in self.imports if x.local and x.imported and x.kind in ("imports", "type-references")}

    def _target(self, name: str) -> tuple[str | None, str, dict]:
        """specifier (None: this file), name there, metadata of a dotted name. All imports must have been read."""
        bound, head, _, rest = self._bound, *name.partition(".")
        if head in bound:
            b = bound[head]
            if not rest:
                return b.specifier, b.imported, {}
            if b.imported == "*":
                return b.specifier, rest, {"isNamespaceImport": True}
            return None, name, {}
        return None, name, {"isLocal": True} if not rest else {}

    def heritage(self) -> list[dict]:
        out = []
        for s in self.symbols:
            for h in s.heritage:
                spec, name, meta = self._target(h["name"])
                out.append({"type": h["kind"], "src": s.name, "specifier": spec, "dst": name, "meta": meta})
        return out

    def calls(self) -> list[dict]:
        """Calls and ``new`` with the innermost named function around each."""
        scopes: list[tuple[int, int, str]] = []

        def add(s: Symbol, prefix: str) -> None:
            if s.body and s.kind in ("function", "method"):
                scopes.append((*s.body, prefix + s.name))
            for m in s.members:
                add(m, f"{s.name}." if s.kind == "class" else prefix)

        for s in self.symbols:
            add(s, "")
        scopes.sort()
        out = []
        for i, t in enumerate(self.t[:-1]):
            if t.kind != "name" or t.text in _KEYWORDS and t.text != "super":
                continue
            k = i + 1
            if self._is(k, "?."):
                k += 1
            if self._is(k, "<") and (e := self._angle(k)) < len(self.t) and self._is(e, "(") and "\n" not in self._text(k, e):
                k = e
            if not self._is(k, "(") or self._declares(i):
                continue
            a = i
            while a >= 2 and self._is(a - 1, ".", "?.") and self.t[a - 2].kind == "name":
                a -= 2
            if a and self._is(a - 1, "."):
                continue  # called on the result of an expression
            name = "".join(x.text for x in self.t[a : i + 1]).replace("?.", ".")
            meta = {"isNew": True} if a and self._is(a - 1, "new") else {}
            around = [s for s in scopes if s[0] < i < s[1]]
            caller = max(around)[2] if around else None
            spec, dst, more = self._target(name)
            if caller is None:
                meta["scope"] = "module"
            more.pop("isLocal", None)
            out.append({"type": "calls", "src": caller, "specifier": spec, "dst": dst, "meta": meta | more})
        return out

    def _declares(self, i: int) -> bool:
        """Whether the name before a bracket is declared there: a function's or a method's name."""
        if i and (self._is(i - 1, "function", "get", "set") or self._is(i - 1, "*") and self._is(i - 2, "function")):
            return True
        return any(m.start <= self.t[i].start < m.end and m.name == self.t[i].text and m.method_kind and self.text[m.start : self.t[i].start].count("(") <= self.text[m.start : self.t[i].start].count(")") and "{" not in self.text[m.start : self.t[i].start] for s in self.symbols for m in s.members)

    # --- documentation --------------------------------------------------------------------------
    def _attach_docs(self) -> None:
        docs = [c for c in self.comments if c.kind == "jsdoc"]
        starts = sorted(s.start for s in self.symbols)
        for s in self.symbols:
            before = [c for c in docs if c.end <= s.start]
            if before and not any(before[-1].end <= x < s.start for x in starts) and not self.text[before[-1].end : s.start].strip():
                s.js_doc = before[-1].text

    def annotations(self) -> list[dict]:
        """Tags of JSDoc, block and line comments with the symbol that starts within three lines below."""
        found: list[tuple[str, str, str, int, int]] = []
        run: list[Comment] = []

        def flush() -> None:
            if run and (m := _TAG.search(run[0].text)):
                value = " ".join([m[2].strip(), *(c.text.strip() for c in run[1:])]).strip()
                found.append((m[1], value, "line", run[0].start, run[-1].end))
            run.clear()

        for c in self.comments:
            if c.kind == "line":
                alone = not self.text[: c.start].rpartition("\n")[2].strip()
                next_line = run and alone and self.lines.place(c.start)[0] == self.lines.place(run[-1].end)[0] + 1
                if not next_line or _TAG.search(c.text):
                    flush()
                    if not _TAG.search(c.text):
                        continue
                run.append(c)
                continue
            flush()
            if c.kind == "jsdoc":
                for tag in parse_jsdoc(c.text)["tags"]:
                    value = " ".join(x for x in (tag["name"], tag["description"]) if x)
                    found.append((tag["tag"], value, "jsdoc", c.start, c.end))
            else:
                for line in c.text.removeprefix("/*").removesuffix("*/").split("\n"):
                    if m := _TAG.search(re.sub(r"^\s*\*?\s?", "", line)):
                        found.append((m[1], m[2].strip(), "block", c.start, c.end))
        flush()
        named = [(self.lines.place(x.start)[0], name) for s in self.symbols for x, name in [(s, s.name), *((m, f"{s.name}.{m.name}") for m in s.members)]]
        named.sort(key=lambda x: x[0])  # of several on a line a symbol before its members, and these before the next symbol
        starts = [line for line, _ in named]
        out = []
        for tag, value, source, a, b in found:
            end = self.lines.place(b)[0]
            k = bisect.bisect_right(starts, end)
            near = k < len(named) and starts[k] - end <= 3
            out.append({"tag": tag, "value": value, "source": source, "symbol_name": named[k][1] if near else None, "start": a, "end": b})
        return out


# Fixed value: what counts as a tag.
_TAG = re.compile(r"(?:^|\s)@([a-zA-Z][\w-]*\w|[a-zA-Z])\s*(.*)$", re.M)
_JSDOC_TAG = re.compile(r"^@(\w[\w-]*)\s*(?:\{([^}]*)\})?\s*(.*)$", re.S)
_NAMED = set("param arg argument property prop template typedef callback".split())


def parse_jsdoc(text: str) -> dict:
    """description and tags (tag, name, type, description, optional, default) of a documentation comment."""
    body = re.sub(r"^/\*\*|\*/$", "", text.strip())
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in body.split("\n")]
    parts = re.split(r"(?m)^(?=@\w)", "\n".join(lines).strip())
    out: dict = {"description": "" if parts[0].startswith("@") else parts[0].strip(), "tags": []}
    for p in parts if parts[0].startswith("@") else parts[1:]:
        m = _JSDOC_TAG.match(p.strip())
        if not m:
            continue
        name, rest, optional, default = "", m[3].strip(), False, None
        if m[1] in _NAMED:
            if b := re.match(r"\[([^\]=]+)(?:=([^\]]*))?\]\s*", rest):
                name, default, optional, rest = b[1].strip(), b[2], True, rest[b.end() :]
            elif b := re.match(r"(\S+)\s*", rest):
                name, rest = b[1], rest[b.end() :]
        out["tags"].append({"tag": m[1], "name": name, "type": m[2] or "", "description": re.sub(r"^-\s*", "", rest).strip(), "optional": optional, "default": default})
    return out
