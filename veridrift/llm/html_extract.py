"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Each element gets features of its subtree (text, density of text and links), its attribute
tokens, depth, siblings and ancestors.  Gradient-boosted trees give its chance to be main text.
Decoding then picks the likeliest labels of the whole tree under one rule: below a node that is
clutter everything is clutter.  So no descendant contradicts an ancestor.  The text of the nodes
that remain is cut into blocks.

The trees are trained on made-up pages with known text (``html_pages``), as the corpus has no
labels; training takes seconds, on the driver, and its size is a parameter.

How it scales.  A map over the pages without shuffle or state; the model is a few kilobytes.

Edge cases.  A null or empty page has an empty text, and so has one whose text is all clutter.  A page on
which the model keeps nothing gives what stands outside clutter, so titles alone and short pages
aren't lost.  Captions go with what holds their figure.
Scripts, styles, comments, titles and other unseen parts never count.  Tags left open are closed
where the next block, or the end, closes them; stray end tags are dropped, and of a tag that never
ends the name and its attributes.  Text outside any element belongs to the page's body.  Repeated
rows come back as often.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from veridrift.llm.batches import with_made
from veridrift.llm.html_pages import CLUTTER_MARK, MARK, training_pages

TRAINING_PAGES, SEED = 900, 11
TREES, DEPTH, RATE, CUTS = 90, 5, 0.2, 24

# Elements by how HTML treats them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title noscript template iframe object svg math textarea select".split())
RAW = frozenset("script style title textarea".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var button".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
GROUPS = ("article main", "section", "div", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "nav menu", "footer", "header", "aside", "form fieldset label button input", "a", "ul ol dl", "li dt dd", "table tbody thead tr td th", "body html", "#run")
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
GOOD = frozenset("article content post entry story main text body".split())
BAD = frozenset(
    "ad ads advert advertisement adslot sponsored promo banner nav navbar navigation menu breadcrumb toc header masthead topbar footer foot copyright legal "
    "sidebar side related widget recommended trending cookie consent notice gdpr alert popup modal newsletter subscribe form login search signup contact "
    "share social tags pagination comment comments reply replies discussion disqus".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    # a tag that never ends: its name and whole attributes, and one that the end of the page cuts off
    r"|</?[a-zA-Z][^\s/><]*+(?:\s++[\w:-]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))*+(?:\s++[\w:-]++\s*+=\s*+(?:\"[^\"<>]*+|'[^'<>]*+)$)?+",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[A-Za-z]+")


#: The element of a run of text, with what inline elements it has, that stands in the body itself.
RUN = "#run"


@dataclass
class Tree:
    """Elements in page order, and the text and block ends between them."""

    tags: list[str]
    parents: list[int]
    attributes: list[str]
    #: (element, text), or (-1, "") where a block ends
    flow: list[tuple[int, str]]


def parse(page: str | None) -> Tree:
    tree = Tree(["body"], [-1], [""], [])
    stack = [0]
    flow, tags = tree.flow, tree.tags
    page = page or ""

    def add(text: str) -> None:
        if len(stack) == 1 and html.unescape(text).strip():
            tags.append(RUN)
            tree.parents.append(0)
            tree.attributes.append("")
            stack.append(len(tags) - 1)
        flow.append((stack[-1], text))

    at, unseen = 0, None
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and unseen is None:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag in UNSEEN:
            # only foreign elements can close themselves; a script's unquoted address may end in a stroke
            if not closing and not (tag in FOREIGN and (m[3] or m[6] or "").endswith("/")):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in RAW else at
            continue
        if tag == "head" or tag in ("html", "body") and closing:
            continue
        if tag not in INLINE and tag != "wbr":
            flow.append((-1, "") if tag != "br" else (stack[-1], " "))
            if tag != "br" and len(stack) > 1 and tags[stack[1]] == RUN:
                del stack[1:]
        if tag in ("html", "body"):
            tree.attributes[0] += m[3] or m[6] or ""
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == "p":
                    del stack[i:]
                    break
                if tags[stack[i]] not in INLINE:
                    break
        if tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in STOPS[tag]:
                    break
                if tags[stack[i]] in SAME[tag]:
                    del stack[i:]
                    break
        if tag in VOID:
            continue
        tags.append(tag)
        tree.parents.append(stack[-1])
        tree.attributes.append(m[3] or m[6] or "")
        if not (m[3] or m[6] or "").endswith("/") or tag not in INLINE:
            stack.append(len(tags) - 1)
    if at < len(page) and unseen is None:
        add(page[at:])
    return tree


@cache
def attribute_scores(text: str) -> tuple[int, int]:
    words = {w.lower() for a in ATTRIBUTE.findall(text) for w in NAME.findall(a)}
    return len(words & GOOD), len(words & BAD)


#: Elements of text whose inline elements aren't judged apart.
HOLDS_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd #run".split()) | INLINE
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
CLUTTER = frozenset("nav menu aside form fieldset button label input".split())
#: How many numbers describe an element's text, and how many the element beside that.
OF_TEXT, BESIDE = 9, 12
FEATURES = len(GROUPS) + 3 * OF_TEXT + BESIDE


#: Letters of its own that make any element one of text.
SENTENCE = 40


def tied(tree: Tree) -> list[bool]:
    """Elements that go with their parent."""
    holds = [t in HOLDS_TEXT for t in tree.tags]
    for e, text in tree.flow:
        if e >= 0 and len(text.strip()) >= SENTENCE:
            holds[e] = True
    captions = [t == "figcaption" or t == "figure" and not attribute_scores(tree.attributes[i])[1] for i, t in enumerate(tree.tags)]
    return [i > 0 and (captions[i] or t in INLINE and holds[tree.parents[i]]) for i, t in enumerate(tree.tags)]


def features(tree: Tree) -> np.ndarray:
    """A row of features for each element: its kind, its subtree's text and that of the two elements
    around it, and its place."""
    n = len(tree.tags)
    chars, marks, pieces, linked, elements, headings, prose = ([0] * n for _ in range(7))
    elements = [1] * n
    total = 0
    first = [0] * n
    in_link = [False] * n
    depth, good_above, bad_above = [0] * n, [0] * n, [0] * n
    scores = [attribute_scores(a) if a else (0, 0) for a in tree.attributes]
    siblings, place, seen = [0] * n, [0] * n, {}
    for i in range(1, n):
        p = tree.parents[i]
        in_link[i] = in_link[p] or tree.tags[i] == "a"
        depth[i] = depth[p] + 1
        good_above[i] = good_above[p] + (scores[p][0] > 0 or tree.tags[p] in ("article", "main"))
        bad_above[i] = bad_above[p] + (scores[p][1] > 0)
        headings[i] = int(tree.tags[i] in HEADINGS)
        place[i] = siblings[p]
        siblings[p] += 1
        seen[p, tree.tags[i]] = seen.get((p, tree.tags[i]), 0) + 1
    begun = [False] * n
    for e, text in tree.flow:
        if e < 0:
            continue
        size = len(text.strip())
        if not size:
            continue
        if not begun[e]:
            begun[e], first[e] = True, total
        total += size
        chars[e] += size
        pieces[e] += 1
        marks[e] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        if in_link[e]:
            linked[e] += size
        elif size >= SENTENCE:
            prose[e] += size
    own = chars.copy()
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        for count in (chars, marks, pieces, linked, elements, headings, prose):
            count[p] += count[i]
        if begun[i] and (not begun[p] or first[i] < first[p]):
            begun[p], first[p] = True, first[i]
    g = len(GROUPS)
    of_text = np.array(
        [
            (
                math.log1p(c),
                c / elements[i],
                linked[i] / c if c else 0.0,
                100 * marks[i] / c if c else 0.0,
                c / pieces[i] if pieces[i] else 0.0,
                c / total if total else 0.0,
                math.log1p(prose[i]),
                prose[i] / c if c else 0.0,
                headings[i],
            )
            for i, c in enumerate(chars)
        ]
    )
    parents = np.array(tree.parents).clip(0)
    around = parents[parents]
    out = np.zeros((n, FEATURES))
    out[:, g : g + 3 * OF_TEXT] = np.hstack([of_text, of_text[parents], of_text[around]])
    article = float("article" in tree.tags or "main" in tree.tags)
    for i in range(n):
        p = tree.parents[i]
        k = GROUP.get(tree.tags[i])
        if k is not None:
            out[i, k] = 1
        out[i, g + 3 * OF_TEXT :] = (
            math.log1p(own[i]),
            first[i] / total if total else 0.0,
            depth[i],
            scores[i][0],
            scores[i][1],
            good_above[i],
            bad_above[i],
            siblings[p] if p >= 0 else 0,
            seen[p, tree.tags[i]] if i else 0,
            place[i],
            GROUP.get(tree.tags[p], -1) if p >= 0 else -1,
            article,
        )
    return out


@dataclass
class Forest:
    """Trees of equal depth, as arrays: feature and cut of each inner node, value of each leaf."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def chance(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            score += v[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic gradient boosting with second-order leaves over quantile cuts."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CUTS))) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)  # bin > k iff x > cuts[k]
    bins = CUTS + 1
    mean = y.mean()
    start = math.log(mean / (1 - mean))
    score = np.full(len(y), start)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    forest = Forest(start, np.zeros((TREES, inner), int), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            chosen, where = np.zeros(width, int), np.full(width, bins)
            for j in range(x.shape[1]):
                key = (at - base) * bins + binned[:, j]
                g = np.bincount(key, grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(key, hess, width * bins).reshape(width, bins).cumsum(axis=1)
                ga, ha = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (ga - g) ** 2 / (ha - h + 1) - ga**2 / (ha + 1)
                gain[(h < 1) | (ha - h < 1)] = 0
                k = gain[:, :-1].argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], chosen[better], where[better] = top[better], j, k[better]
            for i in range(width):
                forest.feature[t, base + i] = chosen[i]
                if where[i] < len(cuts[chosen[i]]):
                    forest.cut[t, base + i] = cuts[chosen[i]][where[i]]
            at = 2 * at + 1 + (x[np.arange(len(x)), forest.feature[t, at]] > forest.cut[t, at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + 1)
        forest.value[t] = value
        score += value[leaf]
    return forest


def training_labels(tree: Tree) -> np.ndarray:
    """1 for the main container, what holds it, and what it holds but what is marked as clutter."""
    n = len(tree.tags)
    main = next(i for i in range(n) if MARK in tree.attributes[i])
    y = np.zeros(n)
    i = main
    while i >= 0:
        y[i] = 1
        i = tree.parents[i]
    for i in range(main + 1, n):
        y[i] = y[tree.parents[i]] if tree.parents[i] >= main and CLUTTER_MARK not in tree.attributes[i] else 0
    return y


def unmarked(page: str) -> str:
    return page.replace(f" {MARK}", "").replace(f" {CLUTTER_MARK}", "")


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Forest:
    xs, ys = [], []
    for page in training_pages(pages, seed):
        tree = parse(page)
        y = training_labels(tree)
        tree.attributes = [unmarked(a) for a in tree.attributes]
        free = ~np.array(tied(tree))
        free[0] = False
        xs.append(features(tree)[free])
        ys.append(y[free])
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(tree: Tree, chance: np.ndarray) -> list[bool]:
    """The likeliest labels in which clutter has no main text below; the body holds main text.

    Inline elements of a text go with it.
    """
    n = len(tree.tags)
    chance = chance.clip(1e-6, 1 - 1e-6)
    yes, no = np.log(chance).tolist(), np.log(1 - chance).tolist()
    goes = tied(tree)
    for i in range(n - 1, 0, -1):
        if goes[i]:
            yes[i] = no[i] = 0.0
        p = tree.parents[i]
        yes[p] += max(yes[i], no[i])
        no[p] += no[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[tree.parents[i]] and (goes[i] or yes[i] >= no[i])
    return keep


def unclear(tree: Tree) -> list[bool]:
    """Elements that nothing but their model's chance speaks against: no clutter by its kind or name,
    nor below such.  Headers and footers of an article are none."""
    keep, inside = [True] * len(tree.tags), [False] * len(tree.tags)
    for i in range(1, len(keep)):
        p, tag = tree.parents[i], tree.tags[i]
        inside[i] = inside[p] or tag in ("article", "main")
        named = attribute_scores(tree.attributes[i])
        clutter = tag in CLUTTER or tag in ("header", "footer") and not inside[p] or named[1] > 0 and not named[0]
        keep[i] = keep[p] and not clutter
    return keep


def main_text(tree: Tree, keep: list[bool]) -> str:
    """The kept text in blocks, one to a line; where none is, what stands outside clutter.

    So a page of a title or a few words, on which the model finds no article, isn't empty.
    """
    return joined_text(tree, keep) or joined_text(tree, unclear(tree))


def joined_text(tree: Tree, keep: list[bool]) -> str:
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    for e, text in tree.flow:
        if e < 0:
            close()
        elif keep[e]:
            held.append(text)
    close()
    return "\n".join(blocks)


def extract(pages: list[str | None], forest: Forest) -> list[str]:
    trees = [parse(p) for p in pages]
    rows = [features(t) for t in trees]
    chances = np.split(forest.chance(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    return [main_text(t, decode(t, c)) for t, c in zip(trees, chances, strict=True)]


def main_texts(pages: DataFrame, forest: Forest | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    forest = forest or trained()

    def work(pages: list[str | None]) -> list[list]:
        texts = extract(pages, forest)
        return [texts, [len(t) for t in texts]]

    return with_made(pages, ["page_id", "url"], "html", "text string, n_chars long", work)
