"""Main text of web pages by a tree-structured graphical model.

Nodes are the elements of the page and its blocks of text; parent-child potentials tie a node to its parent, features of the
node (tag, names in class, id and role, links, length) are its own evidence. Messages go up the tree and down again, so that
each block gets its exact marginal of being content. All potentials are counted on labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import long_values, table
from .html_seed import labelled_pages

# A comment, a declaration, or a tag; quotes count only behind an equals sign. No part is tried twice, so a page is read in linear time.
MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+")
# Elements without text of the page, inline elements, elements without an end, and what an open element ends at.
NO_TEXT = frozenset(("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "select", "textarea", "head", "title", "audio", "video", "map", "datalist"))
RAW_TEXT = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr wbr img label output".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes head".split())
SCOPES = frozenset(("ul", "ol", "dl", "table", "select", "body", "menu"))


class Tree:
    """Elements and text blocks of a page, parents before children: parent, features and, for blocks, text."""

    def __init__(self, page: str | None):
        self.parent, self.features, self.text = [-1], [["tag:root"]], [None]
        self._read(page or "")

    def _node(self, parent: int, features: list[str], text: str | None) -> int:
        self.parent.append(parent), self.features.append(features), self.text.append(text)
        return len(self.parent) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("root", 0)]
        opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        scopes: list[int] = []
        pieces: list[str] = []
        linked = link_depth = hidden = at = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self._node(stack[-1][1], block_features(text, linked), text)
                pieces.clear()
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            if stack[-1][0] == "head" and raw.strip():  # text ends a head that has no end tag
                close(len(stack) - 1)
            if raw and not hidden:
                pieces.append(html.unescape(raw))
                if link_depth:
                    linked += len(raw)

        def close(to: int) -> None:
            nonlocal hidden
            flush()
            while len(stack) > to:
                tag, _ = stack.pop()
                opened[tag].pop()
                hidden -= tag in NO_TEXT
                if tag in SCOPES:
                    scopes.pop()

        while m := MARKUP.search(page, at):
            add(page[at : m.start()])
            at = m.end()
            end, tag, attrs = m[1], m[2], m[3]
            if not tag:
                continue
            tag = tag.lower()
            if stack[-1][0] == "head" and not end and tag not in IN_HEAD and tag != "br":
                close(len(stack) - 1)
            if tag in INLINE:
                if tag == "a":
                    link_depth = 0 if end else 1
                continue
            if tag == "br":
                add(" ")
                continue
            if end:
                if opened[tag]:
                    close(opened[tag][-1])
                    link_depth = 0
                else:
                    flush()
                continue
            flush()
            if tag in VOID:
                continue
            if tag in ENDS_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            elif tag in SIBLINGS:
                before = max((opened[t][-1] for t in SIBLINGS[tag] if opened[t]), default=0)
                if before > (scopes[-1] if scopes else 0):
                    close(before)
            elif tag == "body" and opened["head"]:
                close(opened["head"][0])
            if tag == "svg" and attrs.endswith("/") or tag in ("script", "iframe") and ends_itself(tag, attrs, page, at):
                continue
            opened[tag].append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append((tag, self._node(stack[-1][1], [*element_features(tag, attrs), f"under:{stack[-1][0]}>{tag}"], None)))
            link_depth = 0
            if tag in NO_TEXT:
                hidden += 1
            if tag in RAW_TEXT:  # markup in it is text, up to its own end tag
                last = RAW_ENDS[tag].search(page, at)
                at = last.start() if last else len(page)
        add(page[at:])
        flush()


#: End tags of elements whose content is not markup.
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TEXT}
NEXT_RAW = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in ("script", "iframe")}


def ends_itself(tag: str, attrs: str, page: str, at: int) -> bool:
    """Whether a tag with a slash at its end has no end tag: another one of its kind, or nothing, comes first."""
    if not attrs.endswith("/") or len(attrs) > 1 and attrs[-2] not in " \t\n\r\f\"'":
        return False
    following = NEXT_RAW[tag].search(page, at)
    return following is None or not following[1]


def element_features(tag: str, attrs: str) -> list[str]:
    out = ["tag:" + tag]
    if attrs:
        for m in NAMES.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            out += {"name:" + w for w in SPLIT.split(value) if len(w) > 1} | {"full:" + w for w in value.split() if "-" in w or "_" in w}
    return out


def block_features(text: str, linked: int) -> list[str]:
    n = len(text)
    out = ["block", f"size:{min(n.bit_length(), 10)}", f"links:{min(4, 4 * linked // n)}", f"end:{text[-1] in '.!?:'}"]
    if text[0] == "©" or text[:9].lower() == "copyright":
        out.append("name:copyright")
    return out


class PageModel:
    """Log potentials: own evidence of a node by feature, and of a child's label given its parent's, by kind of child. They begin
    as damped log ratios of counts; some rounds of gradient steps on the likelihood of whole labelled trees follow, whose
    gradient is what the labels say minus what the messages expect."""

    def __init__(self, pages: list[tuple[str, list[tuple[str, bool]]]], rounds: int = 4):
        trees = []
        seen = {False: Counter(), True: Counter()}
        nodes: Counter = Counter()
        moves: Counter = Counter()
        for page, blocks in pages:
            tree = Tree(page)
            labels = self._labels(tree, blocks)
            trees.append((tree, labels))
            for i, features in enumerate(tree.features):
                kind = tree.text[i] is not None
                nodes[kind, labels[i]] += 1
                for f in set(features):
                    seen[labels[i]][kind, f] += 1
                if i:
                    moves[kind, labels[tree.parent[i]], labels[i]] += 1
        self.own: dict[tuple[bool, str], float] = {}
        for kind, f in seen[False].keys() | seen[True].keys():
            rate = [(seen[y][kind, f] + 0.5) / (nodes[kind, y] + 1) for y in (False, True)]
            self.own[kind, f] = math.log(rate[1] / rate[0]) / 3  # evidence for content
        self.pair = {kind: [[math.log((moves[kind, p, c] + 1) / (moves[kind, p, False] + moves[kind, p, True] + 2)) for c in (False, True)] for p in (False, True)] for kind in (False, True)}

        for number in range(rounds):
            for tree, labels in trees:
                self._step(tree, labels, 0.3 / (1 + number))

    def _step(self, tree: Tree, labels: list[bool], rate: float) -> None:
        up, sent, belief = self._messages(tree)
        for i, features in enumerate(tree.features):
            kind = tree.text[i] is not None
            off = rate * (labels[i] - _chance(belief[i]))
            if abs(off) > 1e-4:
                for f in features:
                    if (kind, f) in self.own:
                        self.own[kind, f] += off
            if i:
                parent = belief[tree.parent[i]]
                pair = self.pair[kind]
                joint = [[parent[p] - sent[i][p] + pair[p][c] + up[i][c] for c in (0, 1)] for p in (0, 1)]
                top = max(map(max, joint))
                odds = [[math.exp(x - top) for x in row] for row in joint]
                total = sum(map(sum, odds))
                for p in (0, 1):
                    for c in (0, 1):
                        pair[p][c] += 0.1 * rate * ((labels[tree.parent[i]] == p and labels[i] == c) - odds[p][c] / total)

    @staticmethod
    def _labels(tree: Tree, blocks: list[tuple[str, bool]]) -> list[bool]:
        """Labels of blocks by their text in page order; an element is content if a block below it is."""
        labels, at = [False] * len(tree.parent), 0
        for i, text in enumerate(tree.text):
            if text is not None:
                found = next((k for k in range(at, len(blocks)) if " ".join(blocks[k][0].split()) == text), None)
                if found is not None:
                    labels[i], at = blocks[found][1], found + 1
        for i in range(len(labels) - 1, 0, -1):
            labels[tree.parent[i]] |= labels[i]
        return labels

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of content of each node."""
        return [_chance(b) for b in self._messages(tree)[2]]

    def _messages(self, tree: Tree) -> tuple[list, list, list]:
        """Up from the leaves and down from the root: evidence below each node, what it tells its parent, and its belief."""
        n, own = len(tree.parent), self.own
        kinds = [t is not None for t in tree.text]
        up = [[0.0, sum(own.get((kinds[i], f), 0.0) for f in tree.features[i])] for i in range(n)]
        sent = [[0.0, 0.0] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            pair, (a, b) = self.pair[kinds[i]], up[i]
            sent[i] = [_add(pair[0][0] + a, pair[0][1] + b), _add(pair[1][0] + a, pair[1][1] + b)]
            parent = up[tree.parent[i]]
            parent[0] += sent[i][0]
            parent[1] += sent[i][1]
        belief: list[tuple[float, float]] = [(up[0][0], up[0][1])] * n
        for i in range(1, n):
            pair, (p0, p1) = self.pair[kinds[i]], belief[tree.parent[i]]
            p0, p1 = p0 - sent[i][0], p1 - sent[i][1]  # the parent without what this child told it
            belief[i] = (up[i][0] + _add(pair[0][0] + p0, pair[1][0] + p1), up[i][1] + _add(pair[0][1] + p0, pair[1][1] + p1))
        return up, sent, belief

    def main_text(self, page: str | None) -> str:
        tree = Tree(page)
        return " ".join(t for t, p in zip(tree.text, self.marginals(tree)) if t is not None and p > 0.5)


def _chance(belief: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(max(-700, min(700, belief[0] - belief[1]))))


def _add(a: float, b: float) -> float:
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


def extract_text(pages: DataFrame, html_col: str = "html", model: PageModel | None = None) -> DataFrame:
    """Adds text and n_chars to pages, replacing columns of these names. Null or empty html, and pages without content, have the
    empty text. Whole pages are read; nothing is cut."""
    model = model or PageModel(labelled_pages())
    base = pages.drop("text", "n_chars")
    schema = StructType([*base.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(html_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return base.mapInArrow(read, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_values(spark)
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html"))).select("page_id", "url", "text", "n_chars")
