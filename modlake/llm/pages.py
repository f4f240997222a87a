"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block nodes. Each has features of its tag, attribute tokens, depth, siblings and subtree
density (text, links, tags). Gradient-boosted trees give the log-odds that a node belongs to the article. They are
trained here, on nodes of a bounded sample of pages with weak labels: the insides of article and main are content,
elements whose tag or attribute tokens name page furniture are not. The nodes are shown with these marks, without those
of an article, and without any, so that where a page has no marks, place, density, depth and siblings decide; and marked
nodes are shown with another node's kind and shape, so that where it has marks, they do. Without content marks in the
sample, a page's main flow of paragraphs stands for them; without furniture, links and what lies outside of that flow do;
and what is still unknown takes the label that first trees give it clearly.

Decoding picks the labelling of the highest total log-odds in which no node is kept below a dropped one: a dynamic
programme up the tree, then down.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import hashed_sample

#: Pages whose nodes the trees are trained on, drawn by a hash of the id.
SAMPLE_PAGES = 200
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 16
#: Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp wbr br img input".split())
FURNITURE = frozenset("nav footer header aside form button fieldset menu dialog head option label legend datalist select noscript template".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Tokens of class, id and role that name page furniture, and those that name the article.
FURNITURE_TOKENS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs footer foot "
    "header masthead comment comments commentary reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager search form copyright legal disclaimer complementary contentinfo".split()
)
ARTICLE_TOKENS = frozenset("article content post entry story main body text prose".split())
#: Of the former, those that no prose contradicts; and elements that hold a block of running text.
SURE_TOKENS = frozenset("ad ads adv advert adverts advertisement advertising comment comments commentary reply replies respond discussion disqus cookie cookies consent gdpr newsletter".split())
PROSE = frozenset(("p", "pre", "blockquote"))
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_END = re.compile("[>\"']")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Open elements that a new one ends.
_ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
_SPACE = re.compile(r"\s+")
FEATURES = (
    "furniture_tag", "article_tag", "paragraph", "heading", "list_item", "furniture_token", "article_token", "under_furniture", "under_article",
    "depth", "siblings", "place", "same_siblings", "children", "own_chars", "all_chars", "link_share", "tag_density", "stop_marks", "sibling_chars", "in_flow",
)
_SHAPE = FEATURES.index("depth")  # from here on: place and density, not meaning
_KIND = [FEATURES.index(x) for x in ("paragraph", "heading", "list_item")]
_ARTICLE_MARKS = [FEATURES.index(x) for x in ("article_tag", "article_token", "under_article")]
_FURNITURE_MARKS = [FEATURES.index(x) for x in ("furniture_tag", "furniture_token", "under_furniture")]


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "kids", "own", "links", "tags", "marks")

    def __init__(self, tag: str, parent: int, depth: int, tokens: frozenset):
        self.tag, self.parent, self.depth, self.tokens = tag, parent, depth, tokens
        self.kids: list[int] = []
        self.own = self.links = self.tags = self.marks = 0


_NONE: frozenset = frozenset()


def _tokens(attrs: str) -> frozenset:
    if not attrs or attrs.isspace():
        return frozenset()
    out: set[str] = set()
    for name, a, b, c in _ATTR.findall(attrs):
        if name.lower() == "hidden":
            out.add("hidden")
        value = a or b or c
        out.update(t for t in _SPLIT.split(value.replace("_", "-")) if t)
        out.update(t for t in _SPLIT.split(value.lower()) if t)
    return frozenset(out)


def _tag_end(source: str, at: int, lost: set[int]) -> int:
    """Where the > of a tag stands that is open at ``at``, outside of quoted values; -1 if nowhere. An unclosed quote is a plain mark.

    ``lost``: opening quotes from which no > was found before. What follows a quote doesn't depend on where the tag began, so all
    tags of a page together walk each quote once.
    """
    path = []
    while (m := _END.search(source, at)) is not None and m.start() not in lost:
        if m[0] == ">":
            return m.start()
        path.append(m.start())
        close = source.find(m[0], m.end())
        at = close + 1 if close >= 0 else m.end()
    lost.update(path)
    return -1


def _pieces(source: str) -> Iterator[tuple[str | None, str | None, str | None, str, int]]:
    """(text, slash, name, attributes, end) of each run of text or tag; comments and declarations are passed over.

    The consumer may send the place to go on from. One pass: what can't be a tag is text, and once no > or quote is left
    no more tags are tried.
    """
    at, size, dead, lost = 0, len(source), False, set()
    while at < size:
        text = name = close = None
        attrs = ""
        if source[at] != "<":
            end = source.find("<", at)
            end = size if end < 0 else end
            text = source[at:end]
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        elif source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at)
            at = size if end < 0 else end + 1
            continue
        else:
            m = None if dead else _NAME.match(source, at)
            stop = _tag_end(source, m.end(), lost) if m else -1
            if stop < 0:
                dead = dead or (m is not None and _END.search(source, m.end()) is None)
                text, end = "<", at + 1
            else:
                close, name, attrs, end = m[1], m[2], source[m.end() : stop], stop + 1
        to = yield text, close, name, attrs, end
        if to is not None:
            end = to
            yield None, None, None, "", end
        at = end


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents before children, and the runs of raw text as (node, text); a run of None ends a block.

    Unclosed elements end with their parent; a paragraph, list item, row or cell ends where the next begins; end tags
    without a start are passed over.
    """
    nodes = [Node("body", -1, 0, frozenset())]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements with the block node that they are in
    opened = Counter()  # names on the stack above the body
    links, size = 0, len(source)
    pieces = _pieces(source)
    for text, close, name, attrs, at in pieces:
        here = stack[-1][1]
        if text is not None:
            n = len(text)
            if not text.isspace():
                node = nodes[here]
                node.own += n
                node.links += n if links else 0
                node.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            runs.append((here, text))
        elif name is not None:
            name = name.lower()
            if close:
                if opened[name]:
                    while len(stack) > 1:
                        t, _ = stack.pop()
                        opened[t] -= 1
                        links -= t == "a"
                        if t == name:
                            break
                    if name not in INLINE:
                        runs.append((-1, ""))
                continue
            nodes[here].tags += 1
            if name in RAW and not attrs.endswith("/"):
                end = _RAW_END[name].search(source, at)
                pieces.send(end.end() if end else size)
                continue
            if name in VOID:
                if name == "br" or name == "hr":
                    runs.append((here, " ") if name == "br" else (-1, ""))
                continue
            tokens = _tokens(attrs) if attrs else _NONE
            inline = name in INLINE and not (tokens & FURNITURE_TOKENS)
            if inline:
                if name == "a":
                    links += 1
                stack.append((name, here))
                opened[name] += 1
                continue
            if name in ("html", "body"):
                continue
            if name not in INLINE:
                runs.append((-1, ""))
            ends = () if name in INLINE else _ENDS.get(name, _ENDS["p"])
            for i in range(len(stack) - 1, 0, -1):  # what the new element ends, up to the nearest container
                t = stack[i][0]
                if t in ends:
                    for t, _ in stack[i:]:
                        links -= t == "a"
                        opened[t] -= 1
                    del stack[i:]
                    break
                if t not in INLINE and t not in ("p",):
                    break
            here = stack[-1][1]
            nodes.append(Node(name, here, nodes[here].depth + 1, tokens))
            nodes[here].kids.append(len(nodes) - 1)
            stack.append((name, len(nodes) - 1))
            opened[name] += 1
    return nodes, runs


def flow(nodes: list[Node], chars: list[int], links: list[int]) -> tuple[list[bool], set[int]]:
    """Which nodes belong to the page's main run of text, and the nodes whose furniture tokens it contradicts.

    A node's run is the text of its own paragraphs and headings without links, twice if the page's first heading of the highest
    level is among them; where no node has any, its own text. The longest run wins, the first of equals, with
    siblings of its tag that have a run of a quarter of it or more (sections), and with headings beside it or beside an ancestor. Reader
    comments stand in a container each, so they make no run together. A run of two paragraphs or more that is half
    of all such runs, with that heading or inside of an article, is not furniture by a token like header or legal alone.
    """
    n = len(nodes)
    run, count = [0] * n, [0] * n
    for i, x in enumerate(nodes):
        if x.parent >= 0 and (x.tag in PROSE or x.tag in HEADINGS):
            run[x.parent] += chars[i] - links[i]
            count[x.parent] += x.tag in PROSE
    if not any(run):
        run = [x.own - x.links for x in nodes]
    top = min((i for i, x in enumerate(nodes) if x.tag in HEADINGS), key=lambda i: (nodes[i].tag, i), default=-1)
    title = nodes[top].parent if top >= 0 else -1
    best = max(range(n), key=lambda i: (run[i] * (2 if i == title else 1), -i))
    inside, above = [False] * n, [best]
    if not run[best]:
        return inside, set()
    inside[best] = True
    while (up := nodes[above[-1]].parent) >= 0:
        for k in nodes[up].kids:
            section = len(above) == 1 and nodes[k].tag == nodes[best].tag and run[k] * 4 >= run[best]
            if section or nodes[k].tag in HEADINGS:
                inside[k] = True
        above.append(up)
    for i in range(1, n):
        inside[i] = inside[i] or inside[nodes[i].parent]
    of_article = title in above or any(nodes[i].tag in ARTICLE for i in above)
    return inside, set(above) if of_article and count[best] > 1 and run[best] * 2 >= sum(r for r, c in zip(run, count, strict=True) if c > 1) else set()


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES for each node; sums over subtrees from the leaves up."""
    n = len(nodes)
    chars, links, tags = [x.own for x in nodes], [x.links for x in nodes], [x.tags for x in nodes]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i]
    out: list[tuple] = []
    inside, held = flow(nodes, chars, links)
    token = [bool(x.tokens & (SURE_TOKENS if i in held else FURNITURE_TOKENS)) for i, x in enumerate(nodes)]
    under_f, under_a = [False] * n, [False] * n
    places = [0] * n
    same: list[int] = [1] * n
    for x in nodes:
        by: dict[str, int] = {}
        for j, k in enumerate(x.kids):
            places[k] = j
            by[nodes[k].tag] = by.get(nodes[k].tag, 0) + 1
        for k in x.kids:
            same[k] = by[nodes[k].tag]
    for i, x in enumerate(nodes):
        p = x.parent
        if p >= 0:
            q = nodes[p]
            under_f[i] = under_f[p] or q.tag in FURNITURE or token[p]
            under_a[i] = under_a[p] or q.tag in ARTICLE
            siblings, around = len(q.kids), chars[p] - chars[i]
        else:
            siblings, around = 1, 0
        out.append((
            x.tag in FURNITURE, x.tag in ARTICLE, x.tag in ("p", "pre", "blockquote"), x.tag in HEADINGS, x.tag in ("li", "ul", "ol", "dl", "dd", "dt"), token[i] or "hidden" in x.tokens,
            bool(x.tokens & ARTICLE_TOKENS), under_f[i], under_a[i], x.depth, siblings, places[i] / siblings, same[i], len(x.kids), log1p(x.own), log1p(chars[i]), links[i] / max(chars[i], 1),
            tags[i] / max(chars[i], 1), x.marks / max(x.own, 1), log1p(around), inside[i],
        ))
    return np.array(out, np.float64)


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1: content, 0: furniture, -1: not known."""
    f = {n: x[:, i] > 0 for i, n in enumerate(FEATURES)}
    bad = f["furniture_tag"] | f["furniture_token"] | f["under_furniture"]
    good = (f["article_tag"] | f["under_article"]) & ~bad
    return np.where(bad, 0, np.where(good, 1, -1))


def _cuts(values: np.ndarray) -> np.ndarray:
    """Between the values of a feature with few of them, so that a rare mark can be split off; else at quantiles."""
    seen = np.unique(values)
    if len(seen) <= BINS:
        return (seen[1:] + seen[:-1]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Gradient-boosted trees of logistic loss on binned features: the model as plain arrays. One label only, or none: no trees."""
    if not len(y) or y.min() == y.max():
        return {"start": 0.0, "trees": [], "cuts": []}
    cuts = [_cuts(c) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    f, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        grad, hess = y - p, p * (1 - p) + 1e-6
        node, split = np.zeros(len(y), int), []
        for level in range(DEPTH):
            chosen = []
            for k in range(1 << level):
                own = node == k
                best = (1e-6, 0, BINS + 1)  # to the left with all
                g, h = grad[own], hess[own]
                whole = g.sum() ** 2 / (h.sum() + 1) if own.any() else 0.0
                for j in range(x.shape[1]):
                    gs, hs = np.cumsum(np.bincount(bins[own, j], g, BINS + 1)), np.cumsum(np.bincount(bins[own, j], h, BINS + 1))
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
                    b = int(np.argmax(gain[:-1]))
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, b)
                chosen.append((best[1], best[2]))
            split.append(chosen)
            js, bs = np.array([c[0] for c in chosen])[node], np.array([c[1] for c in chosen])[node]
            node = node * 2 + (bins[np.arange(len(y)), js] > bs)
        leaf = RATE * np.bincount(node, grad, 1 << DEPTH) / (np.bincount(node, hess, 1 << DEPTH) + 1)
        f = f + leaf[node]
        trees.append((split, leaf))
    return {"start": start, "trees": trees, "cuts": cuts}


def by_marks(x: np.ndarray) -> np.ndarray:
    """What is known without any tree: marks of furniture count against a node, everything else stays."""
    return np.where((x[:, _FURNITURE_MARKS] > 0).any(1), -4.0, 4.0)


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    if not model["trees"]:
        return by_marks(x)
    out = np.full(len(x), model["start"])
    bins = np.stack([np.searchsorted(c, v, "right") for c, v in zip(model["cuts"], x.T, strict=True)], 1)
    rows = np.arange(len(x))
    for split, leaf in model["trees"]:
        node = np.zeros(len(x), int)
        for chosen in split:
            c = np.array(chosen)[node]
            node = node * 2 + (bins[rows, c[:, 0]] > c[:, 1])
        out += leaf[node]
    return out


def decode(nodes: list[Node], odds: list[float]) -> list[bool]:
    """Which nodes are kept: the highest sum of odds by own text, none below a dropped node; a tie drops."""
    n = len(nodes)
    worth = [0.0] * n
    below = [0.0] * n
    for i in range(n - 1, -1, -1):
        worth[i] = odds[i] * nodes[i].own + below[i]
        if i and worth[i] > 0:
            below[nodes[i].parent] += worth[i]
    kept = [False] * n
    for i in range(n):
        kept[i] = worth[i] > 0 and (i == 0 or kept[nodes[i].parent])
    return kept


def article(nodes: list[Node], runs: list[tuple[int, str]], x: np.ndarray, odds: np.ndarray) -> str:
    """The text of the decoded nodes; where these hold links at most, all text outside of marked furniture; empty if that is links at most."""
    for kept in (decode(nodes, odds.tolist()), decode(nodes, by_marks(x).tolist())):
        if any(k and n.own > n.links for k, n in zip(kept, nodes, strict=True)):
            return blocks(runs, kept)
    return ""


def blocks(runs: list[tuple[int, str]], kept: list[bool]) -> str:
    """Text of the kept nodes: blocks in page order, white space as one space, character references decoded."""
    out, now, owner = [], [], None

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    for node, text in runs:
        if node < 0:
            flush()
        elif kept[node]:
            now.append(text)
        elif now and not text.isspace():
            now.append(" ")
    flush()
    return "\n".join(out)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict:
    """Trees from the nodes of ``SAMPLE_PAGES`` pages."""
    ids = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    sample = hashed_sample(ids.filter("html is not null"), SAMPLE_PAGES, "id").collect()
    xs = [features(parse(r.html)[0]) for r in sample]
    return fit(np.concatenate(xs) if xs else np.zeros((0, len(FEATURES))))


def fit(x: np.ndarray) -> dict:
    """Trees from the features of a sample's nodes."""
    if not len(x):
        return boost(x, np.zeros(0))
    y = weak_labels(x)
    f = {n: x[:, i] for i, n in enumerate(FEATURES)}
    own = np.expm1(f["own_chars"])
    text = (f["link_share"] < 0.3) & (f["in_flow"] > 0)
    if not ((y == 1) & (own > 0)).any():
        y[(y == -1) & text & ((f["paragraph"] > 0) | (f["heading"] > 0) | (own >= 100))] = 1
    if not ((y == 0) & (own > 0)).any():
        y[(y == -1) & ((f["link_share"] > 0.6) | (f["in_flow"] == 0))] = 0
    # what is still unknown takes the label that trees of the known nodes give it clearly
    unknown = (y == -1) & (own > 0)
    if unknown.any():
        odds = log_odds(boost(x[(y >= 0) & (own > 0)], y[(y >= 0) & (own > 0)].astype(float)), x[unknown])
        y[unknown] = np.where(np.abs(odds) < 1, -1, odds > 0)
    # weighed like decoding does: nodes without text of their own are decided by what they hold
    x, y = x[(y >= 0) & (own > 0)], y[(y >= 0) & (own > 0)]
    bare, plain = x.copy(), x.copy()
    bare[:, _ARTICLE_MARKS] = 0
    plain[:, _ARTICLE_MARKS + _FURNITURE_MARKS] = 0
    # with another node's kind and shape: marked content, and marked furniture with and without what marks an article around it
    rng = np.random.default_rng(5)
    marked, sets, labels = (x[:, _ARTICLE_MARKS + _FURNITURE_MARKS] > 0).any(1), [x, bare, plain, plain], [y] * 4
    for part, rows in ((x, marked), (bare, marked & (y == 0))):
        z, at = part[rows].copy(), np.flatnonzero(rows)
        z[:, _SHAPE:] = part[rng.permutation(len(part))[: len(at)], _SHAPE:]
        z[:, _KIND] = part[rng.permutation(len(part))[: len(at)]][:, _KIND]
        sets.append(z), labels.append(y[rows])
    return boost(np.concatenate(sets), np.concatenate(labels).astype(float))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the article of each whole page.

    Null and empty pages, and pages of marked furniture only, give an empty text. Repeated rows give repeated rows; other
    columns are left out.
    """
    model = model or train(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, 200):
                parsed = [parse(h or "") for h in batch.column(2).slice(a, 200).to_pylist()]
                xs = [features(nodes) for nodes, _ in parsed]
                odds = np.split(log_odds(model, np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
                out += [article(nodes, runs, x, o) for (nodes, runs), x, o in zip(parsed, xs, odds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
