"""HTML as a tree of block elements and runs of text, with features for each node."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
UNSEEN = set("script style template head title noscript iframe svg canvas object select textarea math audio video".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}

KINDS = {k: i for i, ks in enumerate(("article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tr td th tbody thead", "blockquote pre figure figcaption", "nav", "header", "footer", "aside", "form button input fieldset", "body html")) for k in ks.split()}
N_KINDS = 17
MARKS = [
    re.compile(x)
    for x in (
        r"article|story|post|entry", r"content|main|body|text", r"nav|menu|breadcrumb|tabs|pag(er|ination)", r"head|masthead|logo|topbar", r"foot|copyright|legal|colophon",
        r"side|aside|widget|rail", r"^ads?$|^ad[-_]|[-_]ads?\b|advert|sponsor|promo|banner", r"cookie|consent|notice|gdpr|alert|popup|modal|overlay", r"form|subscribe|newsletter|sign-?up|login|search",
        r"comment|disqus|repl(y|ies)|discussion|respond", r"share|social|related|recommend|more|tags|meta|author|byline",
    )
]


class Tree(HTMLParser):
    """Nodes in page order, each after its parent. A run of text is a node of tag ``#text``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.attrs = ["#root"], [-1], [{}]
        self.text: list[list[str]] = [[]]
        self.link_chars, self.inputs = [0], [0]
        self.open: list[tuple[str, int]] = [("#root", 0)]  # inline elements stand for the block around them
        self.unseen: list[str] = []
        self.links, self.run = 0, -1
        self.feed(html)
        self.close()

    def _block(self) -> int:
        return self.open[-1][1]

    def _add(self, tag: str, attrs: dict) -> int:
        for field, x in ((self.tag, tag), (self.parent, self._block()), (self.attrs, attrs), (self.text, []), (self.link_chars, 0), (self.inputs, 0)):
            field.append(x)
        return len(self.tag) - 1

    def _close_to(self, k: int) -> None:
        for tag, _ in self.open[k:]:
            self.links -= tag == "a"
        del self.open[k:]
        self.run = -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.unseen or tag in UNSEEN:
            if tag in UNSEEN and tag not in VOID:
                self.unseen.append(tag)
            if tag == "body":  # a head that was never closed
                self.unseen.clear()
            else:
                return
        if tag in ENDS_P:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    self._close_to(k)
                    break
                if self.open[k][0] not in INLINE:
                    break
        if tag in CLOSES:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in CLOSES[tag]:
                    self._close_to(k)
                    if tag != "td" and tag != "th":
                        continue
                    break
                if self.open[k][0] in HOLDS[tag]:
                    break
        if tag == "br":
            self.handle_data(" ")
        elif tag in ("input", "button"):
            self.inputs[self._block()] += 1
        if tag in VOID:
            if tag == "hr":
                self.run = -1
            return
        if tag in INLINE:
            self.links += tag == "a"
            self.open.append((tag, self._block()))
            return
        self.run = -1
        self.open.append((tag, self._add(tag, {k: v or "" for k, v in attrs})))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag in self.unseen:
                del self.unseen[self.unseen.index(tag) :]
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in INLINE:  # may close across other inline elements, never across a block
                    self.links -= tag == "a"
                    del self.open[k]
                else:
                    self._close_to(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.unseen or not data:
            return
        if self.run < 0:
            if not data.strip():
                return
            self.run = self._add("#text", {})
        self.text[self.run].append(data)
        if self.links > 0:
            self.link_chars[self.run] += len(data.strip())

    def blocks(self) -> list[str]:
        """For each node its text with white space made single, empty for elements."""
        return [" ".join("".join(t).split()) if t else "" for t in self.text]


def node_features(tree: Tree, texts: list[str]) -> np.ndarray:
    n = len(tree.tag)
    parent = np.array(tree.parent)
    kind = np.array([KINDS.get(t, N_KINDS - 1) for t in tree.tag])
    is_text = np.array([t == "#text" for t in tree.tag])
    kind[is_text] = kind[parent[is_text]]
    marks = np.zeros((n, len(MARKS) + 1), np.float32)
    for i, a in enumerate(tree.attrs):
        if a:
            words = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')} {a.get('itemprop', '')}".lower().split()
            for w in words:
                for k, m in enumerate(MARKS):
                    marks[i, k] += m.search(w) is not None
            marks[i, -1] = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
    kinds = np.zeros((n, N_KINDS), np.float32)
    kinds[np.arange(n), kind] = 1
    above = np.zeros((n, N_KINDS + marks.shape[1]), np.float32)  # of the elements around a node
    own = np.hstack([kinds, marks])
    depth = np.zeros(n, np.float32)
    for i in range(1, n):
        p = parent[i]
        above[i] = np.maximum(above[p], own[p])
        depth[i] = depth[p] + 1
    # chars, words, link chars, runs, stops (ends of sentences), digits, inputs, long runs
    s = np.zeros((n, 8), np.float64)
    longest = np.zeros(n)
    for i, t in enumerate(texts):
        if t:
            s[i, :7] = len(t), t.count(" ") + 1, min(len(t), tree.link_chars[i]), 1, len(re.findall(r"[.!?;:](?:\s|$)", t)), sum(map(str.isdigit, t[:400])), 0
            s[i, 7] = len(t) >= 80
            longest[i] = len(t)
        s[i, 6] = tree.inputs[i]
    for i in range(n - 1, 0, -1):
        s[parent[i]] += s[i]
        longest[parent[i]] = max(longest[parent[i]], longest[i])
    total = max(1.0, s[0, 0])
    order = np.zeros(n)  # characters before the node
    run = 0
    for i in range(n):
        order[i] = run
        run += len(texts[i])
    children = np.bincount(parent[1:], minlength=n)
    rank, same, before, after = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    by_parent: dict[int, list[int]] = {}
    for i in range(1, n):
        by_parent.setdefault(int(parent[i]), []).append(i)
    for sibs in by_parent.values():
        tags: dict[str, int] = {}
        for k, i in enumerate(sibs):
            tags[tree.tag[i]] = tags.get(tree.tag[i], 0) + 1
            rank[i] = k / len(sibs)
            if k:
                before[i], after[sibs[k - 1]] = s[sibs[k - 1], 0], s[i, 0]
        for i in sibs:
            same[i] = tags[tree.tag[i]]
    up = np.maximum(parent, 0)
    chars = np.maximum(1, s[:, 0])
    lg = lambda x: np.log1p(x)
    rest = np.stack([
        depth, is_text, lg(s[:, 0]), lg(s[:, 1]), s[:, 2] / chars, lg(s[:, 3]), s[:, 0] / np.maximum(1, s[:, 3]), s[:, 4] / np.maximum(1, s[:, 1]), s[:, 5] / np.minimum(chars, 400), s[:, 6], s[:, 7],
        lg(longest), s[:, 0] / total, order / total, children, rank, lg(same), lg(before), lg(after), lg(s[up, 0]), s[up, 2] / chars[up], lg(children[up]), s[:, 0] / chars[up], s[:, 0] / np.maximum(1, s[:, 1]), np.full(n, lg(total)),
    ], axis=1)
    return np.hstack([own, above, rest]).astype(np.float32)
