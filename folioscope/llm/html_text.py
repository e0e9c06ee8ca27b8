"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a variable, content or not. Its own marks (tag, words of its class and
id, role, how much text it holds, what part of that is links, whether sentences end in it) speak for one of the two, and a potential joins it with
its parent. Sum-product messages go up the tree and down again, and the marginal of an element
decides on its text. Potentials and marks are counted on labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .html_pages import labelled_pages

#: Kinds of elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style".split())                     # text up to the end tag, never shown
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
ENDS_BEFORE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
               "option": ("option",), "optgroup": ("option", "optgroup"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",),
         "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"[.!?…。](?=\s|$)")


class Page:
    """Elements in page order, each with its parent and marks, and the text blocks between
    block boundaries: lists of (element, text)."""

    __slots__ = ("parent", "marks", "label", "blocks", "_open", "_names", "_text", "_shown", "_linked", "_links", "_ends", "_count")

    def __init__(self, source: str) -> None:
        self.parent, self.marks, self.label = [-1], [["tag=page"]], [0]
        self.blocks: list[list[tuple[int, str]]] = []
        self._open, self._names, self._text = [0], ["page"], []
        self._shown, self._linked, self._links, self._ends = [0], [0], 0, [0]
        self._count: Counter[str] = Counter()
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at:m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if name not in UNSEEN:
                    self._close(name)
                continue
            if name not in UNSEEN:
                self._start(name, m[3] or m[6] or "")
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                stop = end.start() if end else len(source)
                if name not in UNSEEN:
                    self._add(source[at:stop])
                at = stop
        self._flush()
        for i, (shown, linked) in enumerate(zip(self._shown, self._linked)):
            if linked * 2 > shown:
                self.marks[i].append("links")
        self._mark_text()

    def _mark_text(self) -> None:
        """Marks of the text in an element and below it: how much stands there outside links, what part of it is links, and
        whether it has ends of sentences."""
        shown, linked, ends = self._shown[:], self._linked[:], self._ends[:]
        for i in range(len(self.parent) - 1, 0, -1):
            p = self.parent[i]
            shown[p], linked[p], ends[p] = shown[p] + shown[i], linked[p] + linked[i], ends[p] + ends[i]
        for i in range(1, len(self.parent)):
            if shown[i]:
                self.marks[i] += [f"said={min(5, (shown[i] - linked[i]).bit_length() // 2)}", f"linked={4 * linked[i] // shown[i]}", f"ends={min(ends[i], 2)}"]

    def _add(self, text: str) -> None:
        self._text.append((self._open[-1], text))
        if n := len(text.strip()):
            self._shown[self._open[-1]] += n
            self._ends[self._open[-1]] += len(_SENTENCE.findall(text))
            if self._links:
                self._linked[self._open[-1]] += n

    def _flush(self) -> None:
        if self._text:
            self.blocks.append(self._text)
            self._text = []

    def _start(self, name: str, attributes: str) -> None:
        marks, label = [f"tag={name}"], None
        if attributes and "=" in attributes or "hidden" in attributes or "data-" in attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (a or b or c).lower()
                if key in ("class", "id"):
                    marks.extend(f"name={w}" for w in dict.fromkeys(_PART.findall(value)))
                elif key == "role":
                    marks.append(f"role={value}")
                elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
                    marks.append("hidden")
                elif key in ("data-main", "data-not"):
                    label = int(key == "data-main")
        if name == "a":
            self._links += 1
        if name in INLINE and (len(marks) == 1 or name in VOID):
            if name == "br":
                self._text.append((self._open[-1], " "))
            return
        if name not in INLINE:
            self._flush()
        if name in CLOSES_P:
            self._pop_to("p", ("button", "td", "th", "table", "caption"))
        for other in ENDS_BEFORE.get(name, ()):
            self._pop_to(other, HOLDS[name])
        if name in VOID:
            return
        marks.append(f"in={self._names[-1]}")
        self.parent.append(self._open[-1])
        self.marks.append(marks)
        self.label.append(self.label[self._open[-1]] if label is None else label)
        self._shown.append(0)
        self._linked.append(0)
        self._ends.append(0)
        self._open.append(len(self.parent) - 1)
        self._names.append(name)
        self._count[name] += 1

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = max(0, self._links - 1)
        if name not in INLINE:
            self._flush()
        self._pop_to(name, ("td", "th") if name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html") else ())

    def _pop_to(self, name: str, walls: tuple[str, ...]) -> None:
        """Ends the innermost open element of that name, and those in it; none beyond a wall."""
        if not self._count[name]:
            return
        for k in range(len(self._names) - 1, 0, -1):
            if self._names[k] == name:
                self._count.subtract(self._names[k:])
                del self._names[k:], self._open[k:]
                return
            if self._names[k] in walls:
                return


class TreeModel:
    """Potentials of (parent, child) labels and log weights of marks.

    Trained on labelled pages by the likelihood of all labels of a page together: its gradient is
    what is seen less what sum-product expects, for pairs of labels and for marks."""

    def __init__(self, pages: Iterable[str] = (), steps: int = 250, rate: float = 0.2, penalty: float = 2e-6) -> None:
        self.edge, self.marks = [[0.5, 0.5], [0.5, 0.5]], {}
        parsed = [Page(source) for source in pages]
        if not parsed:
            return
        names = {m: k for k, m in enumerate(sorted({m for p in parsed for marks in p.marks[1:] for m in marks}))}
        parent, label, depth, rows, columns = [], [], [], [], []
        for p in parsed:                                       # all pages side by side, as one forest
            first = len(parent)
            for i in range(len(p.parent)):
                parent.append(first + max(0, p.parent[i]))
                depth.append(0 if i == 0 else depth[first + p.parent[i]] + 1)
                label.append(p.label[i])
                if i:
                    rows += [first + i] * len(p.marks[i])
                    columns += [names[m] for m in p.marks[i]]
        up, y, level = np.array(parent), np.array(label), np.array(depth)
        rows, columns = np.array(rows), np.array(columns)
        levels = [np.flatnonzero(level == d) for d in range(1, level.max() + 1)]
        inner = np.flatnonzero(level > 0)
        seen_pairs = np.bincount(y[up[inner]] * 2 + y[inner], minlength=4).reshape(2, 2)
        theta, size = np.zeros(4 + len(names)), len(inner)
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            edge, own = theta[:4].reshape(2, 2), np.zeros((len(up), 2))
            own[:, 1] = np.bincount(rows, theta[4:][columns], len(up))
            own[level == 0, 1] = -60.0                         # a page itself is not content
            message = np.zeros_like(own)
            for nodes in reversed(levels):
                message[nodes] = np.logaddexp(edge[:, 0] + own[nodes, :1], edge[:, 1] + own[nodes, 1:])
                np.add.at(own, up[nodes], message[nodes])
            belief, pairs = own.copy(), np.zeros((2, 2))
            for nodes in levels:
                known = belief[up[nodes]] - message[nodes]
                both = known[:, :, None] + edge[None] + own[nodes][:, None, :]
                both = np.exp(both - both.max((1, 2), keepdims=True))
                both /= both.sum((1, 2), keepdims=True)
                pairs += both.sum(0)
                belief[nodes] = np.log(both.sum(1) + 1e-30)
            content = np.exp(belief[:, 1])
            slope = np.concatenate([(seen_pairs - pairs).ravel(), np.bincount(columns, (y - content)[rows], len(names))]) / size - penalty * theta
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
            theta += rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
        self.edge = np.exp(theta[:4].reshape(2, 2) - theta[:4].max()).tolist()
        self.marks = dict(zip(names, theta[4:].tolist()))

    def marginals(self, page: Page) -> list[float]:
        """The probability of each element to be content. The page itself is not."""
        n, parent, edge = len(page.parent), page.parent, self.edge
        (e00, e01), (e10, e11) = edge
        own0, own1 = [1.0] * n, [1.0] * n                # evidence of an element and all below it
        for i in range(n):
            said = sum(self.marks.get(m, 0.0) for m in page.marks[i])
            odds = math.exp(max(-30.0, min(30.0, said)))
            own0[i], own1[i] = 1 / (1 + odds), odds / (1 + odds)
        own0[0], own1[0] = 1.0, 0.0
        up0, up1 = [1.0] * n, [1.0] * n                  # messages to the parent
        for i in range(n - 1, 0, -1):
            a, b = own0[i], own1[i]
            u0, u1 = e00 * a + e01 * b, e10 * a + e11 * b
            scale = u0 + u1
            u0, u1 = u0 / scale, u1 / scale
            up0[i], up1[i] = u0, u1
            p = parent[i]
            a, b = own0[p] * u0, own1[p] * u1
            scale = a + b
            own0[p], own1[p] = a / scale, b / scale
        out, belief0, belief1 = [0.0] * n, [1.0] * n, [0.0] * n
        for i in range(1, n):
            p = parent[i]
            a, b = belief0[p] / up0[i], belief1[p] / up1[i]      # all that the parent knows from elsewhere
            d0, d1 = (a * e00 + b * e10) * own0[i], (a * e01 + b * e11) * own1[i]
            scale = d0 + d1
            belief0[i], belief1[i] = d0 / scale, d1 / scale
            out[i] = belief1[i]
        return out


@cache
def default_model() -> TreeModel:
    return TreeModel(labelled_pages())


def main_text(source: str | None, model: TreeModel) -> str:
    """The text of the elements that are content: character references decoded, white space of a
    block turned into one space, blocks joined by an empty line. Empty for null or empty html and
    for a page without content."""
    if not source:
        return ""
    page = Page(source)
    keep = model.marginals(page)
    out = []
    for block in page.blocks:
        text = "".join([t for node, t in block if keep[node] >= 0.5])
        if text and (text := " ".join(html.unescape(text).split())):
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """One row per page: id, url, text, n_chars.

    Works on the whole html of every row; a null html is empty. Rows that repeat come out as often
    as they come in; no rows give no rows. Other columns are not read. Pages are independent, so one task holds one
    batch of them at a time.
    """
    model = model or default_model()
    marks, edge = model.marks, model.edge

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TreeModel()
        own.marks, own.edge = marks, edge
        for pdf in batches:
            texts = [main_text(h, own) for h in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = {c: t for c, t in rows.dtypes}
    done = rows.mapInPandas(run, f"id {kind['id']}, url {kind['url']}, text string, n_chars long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
