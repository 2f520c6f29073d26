"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and text of a page is a binary variable, content or not. Its own potential is log-linear
in features of the node (tag, words of class and id, length, share of link text); a parent and a child
are tied by a 2 x 2 potential for the kind of child. The graph is a tree, so one upward and one
downward pass of sum-product messages give exact marginals. Weights maximise the likelihood of
labelled pages, whose gradient takes the same two passes.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from . import html_pages
from .common import add_by_text

#: a quote counts after an equals sign only; one that is never closed ends with the tag
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW = {t: re.compile(f"</{t}", re.I) for t in ("script", "style", "textarea", "noscript", "template", "iframe", "svg")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: a new one of these ends an open one of the named tags
CLOSES = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
NOT_IN_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
               "ol p pre section table ul".split())
SCOPE = set("article aside body div footer form header html main nav section table ul ol dl".split())
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Page:
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)  # "" for a text
    names: list[str] = field(default_factory=list)  # class, id and role
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)  # texts of one block follow one another in it
    label: list[int | None] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: str = "", text: str = "", block: int = 0, label=None) -> int:
        for column, value in zip((self.parent, self.tag, self.names, self.text, self.block, self.label),
                                 (parent, tag, names, text, block, label), strict=True):
            column.append(value)
        return len(self.parent) - 1


def read(source: str, labelled: bool = False) -> Page:
    """Nodes of a page in document order (a parent comes before its children). Forgiving: unclosed and
    stray tags are as in browsers, near enough for text. Raw text of scripts and the like is left out.
    ``labelled``: data-label is a training label; on other pages the attribute means nothing."""
    page = Page()
    stack, open_tags, block, at = [page.add(-1, "html")], {"html": 1}, 0, 0

    def pop_to(names) -> None:
        nonlocal block
        while len(stack) > 1:
            tag = page.tag[stack.pop()]
            open_tags[tag] -= 1
            block += tag not in INLINE
            if tag in names:
                return

    def text(part: str) -> None:
        if part:
            page.add(stack[-1], "", text=entities.unescape(part), block=block)

    while (m := TOKEN.search(source, at)) is not None:
        text(source[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag in VOID:
                text(" ")
            elif open_tags.get(tag):
                pop_to((tag,))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
            continue
        if tag == "html":
            continue
        if tag in NOT_IN_P and open_tags.get("p"):
            pop_to(("p",))
        for other in CLOSES.get(tag, ()):
            if open_tags.get(other):
                k = len(stack) - 1
                while k and page.tag[stack[k]] not in SCOPE and page.tag[stack[k]] != other:
                    k -= 1
                if page.tag[stack[k]] == other:
                    pop_to((other,))
        values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        block += tag not in INLINE
        label = values.pop("data-label", None)
        node = page.add(stack[-1], tag, " ".join(values.values()).lower(), label=int(label) if labelled and label is not None else None)
        if tag in RAW:
            end = RAW[tag].search(source, at)
            at = end.start() if end else len(source)
            close = source.find(">", at)
            at = close + 1 if end and close >= 0 else len(source)
            continue
        if not m[3].endswith("/"):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    text(source[at:])
    return page


def features(page: Page) -> list[list[str]]:
    """Names of each node's binary features."""
    n = len(page.parent)
    chars, linked = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if not page.tag[i]:
            chars[i] = len(page.text[i].strip())
        if page.tag[i] == "a":
            linked[i] = chars[i]
        if i:
            chars[page.parent[i]] += chars[i]
            linked[page.parent[i]] += linked[i]
    out = []
    for i in range(n):
        size = min(6, int(math.log2(chars[i] + 1) / 1.5))
        density = 0 if not chars[i] else min(3, int(4 * linked[i] / chars[i]))
        above = page.tag[page.parent[i]] if i else ""
        if page.tag[i]:
            names = {w for w in WORD.findall(page.names[i])}
            out.append(["element", f"tag={page.tag[i]}", f"size={size}", f"density={density}", *(f"name={w}" for w in sorted(names)),
                        *(["named"] if names else [])])
        else:
            out.append(["text", f"in={above}", f"long={size}", "stop" if page.text[i].rstrip()[-1:] in ".!?" else "open"])
    return out


def kind(page: Page, i: int) -> int:
    """Which edge potential ties node ``i`` to its parent: of a text, an inline or a block element."""
    return 0 if not page.tag[i] else 1 if page.tag[i] in INLINE else 2


@dataclass
class Model:
    weights: dict[str, float]  # feature: log-odds of content
    edges: np.ndarray  # kind x parent's state x child's state

    def own(self, page: Page) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in features(page)]


def sum_product(parent: list[int], kinds: list[int], own: list[float], edges) -> tuple[list[float], list[tuple]]:
    """Probability of content of every node and, per node, the joint (00, 01, 10, 11) with its parent.

    Messages are kept as log-odds and log-sums, so deep and wide trees don't underflow.
    """
    n = len(parent)
    soft = lambda a, b: (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))
    tables = [[float(x) for x in e.ravel()] for e in edges]
    belief, up = list(own), [0.0] * n  # log-odds: node given what lies below; message to the parent
    for i in range(n - 1, 0, -1):
        t00, t01, t10, t11 = tables[kinds[i]]
        up[i] = soft(t10, t11 + belief[i]) - soft(t00, t01 + belief[i])
        belief[parent[i]] += up[i]
    joint: list[tuple] = [()] * n
    full = list(belief)
    for i in range(1, n):
        t00, t01, t10, t11 = tables[kinds[i]]
        rest = full[parent[i]] - up[i]  # the parent without what this child said
        full[i] = belief[i] + soft(t01, t11 + rest) - soft(t00, t10 + rest)
        joint[i] = (t00, t01 + belief[i], t10 + rest, t11 + rest + belief[i])
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in full], joint


def labels(page: Page) -> list[int]:
    """Each node's label: its own or the nearest above; 0 at the top."""
    out = []
    for i, own in enumerate(page.label):
        out.append(own if own is not None else out[page.parent[i]] if i else 0)
    return out


def fit(sources: list[str], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Maximum likelihood by Adagrad; expected counts come from the two message passes."""
    pages = [read(s, labelled=True) for s in sources]
    rows, truth = [features(p) for p in pages], [labels(p) for p in pages]
    model = Model({f: 0.0 for page in rows for row in page for f in row}, np.zeros((3, 2, 2)))
    squares: dict[str, float] = dict.fromkeys(model.weights, 1e-3)
    edge_squares = np.full((3, 2, 2), 1e-3)
    for _ in range(rounds):
        gradient, edge_gradient = dict.fromkeys(model.weights, 0.0), np.zeros((3, 2, 2))
        for page, row, y in zip(pages, rows, truth, strict=True):
            kinds = [kind(page, i) for i in range(len(y))]
            own = [sum(model.weights[f] for f in r) for r in row]
            p, joint = sum_product(page.parent, kinds, own, model.edges)
            for i, r in enumerate(row):
                for f in r:
                    gradient[f] += y[i] - p[i]
                if i:
                    e = np.exp(np.array(joint[i]) - max(joint[i]))
                    edge_gradient[kinds[i]] -= (e / e.sum()).reshape(2, 2)
                    edge_gradient[kinds[i], y[page.parent[i]], y[i]] += 1
        for f, g in gradient.items():
            g -= decay * len(pages) * model.weights[f]
            squares[f] += g * g
            model.weights[f] += rate * g / math.sqrt(squares[f])
        edge_gradient -= decay * len(pages) * model.edges
        edge_squares += edge_gradient ** 2
        model.edges += rate * edge_gradient / np.sqrt(edge_squares)
    return model


def train() -> Model:
    """The model of the fixed labelled pages (always the same)."""
    return fit(html_pages.pages())


def main_text(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = read(source)
    p, _ = sum_product(page.parent, [kind(page, i) for i in range(len(page.parent))], model.own(page), model.edges)
    blocks: list[list[str]] = []
    last = None
    for i, tag in enumerate(page.tag):
        if not tag and p[i] >= 0.5:
            if page.block[i] != last:
                blocks.append([])
                last = page.block[i]
            blocks[-1].append(page.text[i])
    joined = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return " ".join(b for b in joined if b)


def extract(pages: DataFrame, model: Model, source: str = "html") -> DataFrame:
    """Replace ``source`` by text and n_chars (code points).

    Null and empty pages, and pages without content, give the empty text. Whole pages are read.
    """
    weights, edges = model.weights, model.edges  # as large as the features of the fixed training pages

    def make():
        m = Model(weights, edges)

        def work(sources):
            texts = [main_text(s, m) for s in sources]
            return texts, [len(t) for t in texts]
        return work

    return add_by_text(pages, source, "text string, n_chars long", make)
