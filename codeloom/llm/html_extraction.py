"""Main text of web pages: boosted trees over DOM nodes, decoded so that a page's choices agree.

The trees score every node, elements and runs of text alike, by the density of its subtree,
tokens of its attributes, its depth, its siblings and what stands around it. Decoding walks
the tree once upwards and once downwards and takes the best set of nodes in which nothing is
kept inside what is dropped. The model is trained here, on pages that a generator makes up
with known main text; it never sees the corpus.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.boosting import BoostedTrees
from codeloom.llm.html_tree import Tree, node_features

#: Marks main text in made-up pages; it is taken out of the text before features are made.
_KEEP = "\ue000"


class _Pages:
    """Made-up pages of many layouts."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = self.r.choice(["etaoinshrdlu", "aeioulnrtsdcéèç", "aeinrstäöüßgh", "aeosrnidlcóñí", "абвгдежик"])
        self.words = ["".join(self.r.choices(letters, k=self.r.randint(1, 9))) for _ in range(300)]

    def say(self, n: int, stops: bool = True) -> str:
        w = [self.r.choice(self.words) + self.r.choice(["", "", "", ",", "&amp;", "***", "."] if stops and self.r.random() < 0.3 else [""]) for _ in range(max(1, n))]
        return (" ".join(w)).capitalize() + ("." if stops else "")

    def name(self, *names: str) -> str:
        pick = self.r.choice(names)
        extra = self.r.choice(["", "", "-wrap", "-inner", " box", " col-3"])
        return self.r.choice(["", f' class="{pick}{extra}"', f' id="{pick}"', f' class="{pick}"'])

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.r.choice(self.words)}">{self.say(self.r.randint(1, 4), False)}</a>' for _ in range(n)]
        shape = self.r.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def around(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return f"<nav{self.name('nav', 'menu')}>{self.links(r.randint(2, 12))}</nav>" if r.random() < 0.7 else f'<div class="{r.choice(["nav", "main-menu", "breadcrumbs", "navbar"])}">{self.links(r.randint(2, 9))}</div>'
        if kind == "header":
            return f"<header{self.name('header', 'site-header')}><div>{self.say(r.randint(1, 5), False)}</div>{self.links(r.randint(0, 5)) if r.random() < 0.5 else ''}<p>{self.say(r.randint(2, 14))}</p></header>"
        if kind == "footer":
            inner = f"&copy; {self.say(r.randint(1, 4), False)} &middot; {self.say(r.randint(2, 30))}"
            inner += f"<p>{self.say(r.randint(4, 60))}</p>" if r.random() < 0.4 else ""
            return r.choice([f"<footer{self.name('footer')}>{inner}</footer>", f'<div class="{r.choice(["footer", "site-footer", "copyright"])}">{inner}</div>'])
        if kind == "side":
            inner = f"<h3>{self.say(r.randint(1, 4), False)}</h3>" + (self.links(r.randint(2, 8)) if r.random() < 0.6 else f"<p>{self.say(r.randint(5, 60))}</p>")
            return r.choice([f"<aside{self.name('sidebar', 'widget')}>{inner}</aside>", f'<div class="{r.choice(["sidebar", "widget", "side-bar", "right-rail", "related", "recommended"])}">{inner}</div>'])
        if kind == "ad":
            return f'<div class="{r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad"])}">{r.choice(["", "<p>"])}{self.say(r.randint(2, 60))}</div>'
        if kind == "notice":
            return f'<div class="{r.choice(["cookie", "cookie-notice", "consent", "notice", "gdpr", "popup", "alert"])}">{r.choice(["", "<p>"])}{self.say(r.randint(4, 60))}<button>{self.say(1, False)}</button></div>'
        if kind == "form":
            return f'<form{self.name("newsletter", "subscribe", "search-form", "login")}><label>{self.say(r.randint(1, 10))}</label><input name="q"><p>{self.say(r.randint(2, 30))}</p><button>{self.say(1, False)}</button></form>'
        if kind == "share":
            return f'<div class="{r.choice(["share", "social", "post-meta", "tags", "byline"])}">{self.links(r.randint(1, 5))}</div>'
        one = lambda: f'<{(t := r.choice(["div", "li", "article", "section"]))} class="{r.choice(["comment", "comment-body", "reply"])}"><p>{self.say(r.randint(3, 80))}</p></{t}>'
        return f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["id", "class"])}="{r.choice(["comments", "comment-list", "disqus", "discussion", "respond"])}"><h3>{self.say(2, False)}</h3>{"".join(one() for _ in range(r.randint(1, 6)))}</{t}>'

    def content(self) -> str:
        r, out = self.r, []
        k = lambda n, stops=True: _KEEP + self.say(n, stops)
        if r.random() < 0.8:
            out.append(f"<h1>{k(r.randint(2, 14), False)}</h1>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            n = r.choice([1, 3, 8, 20, 40, 80, 150])
            if x < 0.7:
                p = k(n)
                if r.random() < 0.15:
                    p += f' <a href="/x">{self.say(r.randint(1, 5), False)}</a> {self.say(r.randint(1, 20))}'
                out.append(r.choice([f"<p>{p}</p>"] * 6 + [f"<p><b>{p}<br>", f"<p>{p}", f"<p><em>{p}</em></p>", f"<div>{p}</div>"]))
            elif x < 0.8:
                out.append(f"<h2>{k(r.randint(1, 8), False)}</h2>")
            elif x < 0.88:
                out.append("<ul>" + "".join(f"<li>{k(r.randint(1, 20))}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.92:
                out.append(f"<blockquote><p>{k(n)}</p></blockquote>")
            elif x < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{k(r.randint(1, 4), False)}</td><td>{k(r.randint(1, 8), False)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.97:
                out.append(f"<pre><code>{k(n)}</code></pre>")
            else:
                out.append(self.around(r.choice(["ad", "share", "form", "side"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = self.content()
        shape = r.random()
        if shape < 0.5:
            body = f"<article{self.name('post', 'entry', 'article', 'story')}>{body}</article>"
        elif shape < 0.7:
            body = f"<main{self.name('main', 'content')}>{body}</main>"
        else:
            body = f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "main", "story", "text"])}">{body}</div>'
        if r.random() < 0.3:
            body = f"<div{self.name('wrapper', 'container', 'main')}>{body}{self.around('comments') if r.random() < 0.4 else ''}{self.around('side') if r.random() < 0.4 else ''}</div>"
        if r.random() < 0.2:
            body = f"<main>{body}</main>"
        top = [x for x in ("nav", "header", "notice", "ad", "form", "share", "side") if r.random() < (0.7 if x == "nav" else 0.3)]
        end = [x for x in ("comments", "side", "share", "ad", "form", "footer", "notice", "nav") if r.random() < (0.8 if x == "footer" else 0.3)]
        r.shuffle(top)
        html = f"<!DOCTYPE html><html><head><title>{self.say(4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        html += "".join(map(self.around, top)) + body + "".join(map(self.around, end))
        return html + ("</body></html>" if r.random() < 0.9 else "")


@cache
def main_text_model(pages: int = 500, seed: int = 5) -> BoostedTrees:
    """The model, from ``pages`` made-up pages."""
    xs, ys, ws = [], [], []
    for i in range(pages):
        tree = Tree(_Pages(seed * 100_000 + i).page())
        marked = tree.blocks()
        keep = np.array([_KEEP in t for t in marked], float)
        for k in range(len(keep) - 1, 0, -1):
            keep[tree.parent[k]] = max(keep[tree.parent[k]], keep[k])
        texts = [t.replace(_KEEP, "") for t in marked]
        xs.append(node_features(tree, texts))
        ys.append(keep)
        ws.append(np.array([1.0 + np.log1p(len(t)) for t in texts]) / np.sqrt(len(texts)))
    w = np.concatenate(ws)
    return BoostedTrees.fit(np.concatenate(xs), np.concatenate(ys), w / w.mean())


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the set of the greatest sum of log odds with nothing kept inside what is dropped."""
    best = odds.astype(np.float64).copy()
    best[0] = np.inf  # the page itself is no choice
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = np.zeros(len(best), bool)
    keep[0] = True
    for i in range(1, len(best)):
        keep[i] = keep[parent[i]] and best[i] > 0
    return keep


def main_texts(pages: list[str | None], model: BoostedTrees, most_nodes: int = 20_000) -> list[str]:
    """Of each page the blocks of its main text in page order, joined by blank lines; empty if there are none.

    Nodes of several pages are scored together, about ``most_nodes`` at a time.
    """
    out = [""] * len(pages)
    held: list[tuple[int, Tree, list[str], np.ndarray]] = []

    def score() -> None:
        odds = model.log_odds(np.concatenate([f for *_, f in held]))
        at = 0
        for k, tree, texts, f in held:
            keep = decode(tree.parent, odds[at : at + len(f)])
            out[k] = "\n\n".join(t for t, kept in zip(texts, keep, strict=True) if t and kept)
            at += len(f)
        held.clear()

    n = 0
    for k, html in enumerate(pages):
        tree = Tree((html or "").replace("\0", ""))
        texts = tree.blocks()
        if any(texts):
            held.append((k, tree, texts, node_features(tree, texts)))
            n += len(texts)
        if n >= most_nodes:
            score()
            n = 0
    if held:
        score()
    return out


def main_text(html: str | None, model: BoostedTrees) -> str:
    return main_texts([html], model)[0]


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``html``, with the main text of each whole page in ``out`` (replaced if it is there).

    Null and empty pages give an empty text; repeated rows a row each.
    """
    model = pages.sparkSession.sparkContext.broadcast(main_text_model())
    names = [c for c in pages.columns if c not in (html, out)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(batch.num_columns - 1).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, out])

    rows = pages.select(*names, html)
    schema = rows.select(*names, F.lit("").alias(out)).schema
    return rows.mapInArrow(extract, schema)
