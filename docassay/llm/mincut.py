"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with their place in the element tree. A classifier gives each block its terminal
capacity: the log-odds of being content, by its shape (words, link share, sentence marks, heading, list) and by what its
containers are called (elements, roles, words of class and id names), all of them features of one logistic model.
Smoothness edges join neighbours in the page and neighbours under one ancestor; their capacity is half the log-odds that
blocks so related are of one kind. Blocks whose terminal capacity outweighs all their edges are settled first (this is
exact); a maximum flow over the rest gives the cut, so neighbours outvote a block that its own features leave in doubt.

Weights and edges are fitted on the blocks of all pages, as counts by feature cell (their number is bounded by the
features). Labels come from pages that mark their main part with an element or role: what is in it is content, all else
boilerplate. Every labelled block counts three times: with all features, without elements and roles, and by its shape
alone, so that pages without such marks are judged by the features that they have. Counts become shares, so the fit is
the same at every size; a ridge towards PRIOR decides where the pages say nothing.

Defined results: null or empty html, and pages without content, give an empty string. Unclosed, crossed and stray tags
are repaired as far as a stack of open elements can; a "<" that opens no tag is text. An unclosed script or style ends
with the page, another unclosed raw element at its own tag. Of a formula the MathML stays, without its annotations.
What a page hides is not text. Rows are independent: repeated rows and clashing extra columns change nothing. Of equal
cuts the one with the least content is taken.
"""

from __future__ import annotations

import functools
import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm._common import released, slices

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*(?:>|(?=<)|\Z)"
    r"|<[!?][^>]*>?",
    re.S,
)
# Every attribute from left to right, so that nothing is looked for within a name or a value.
ATTRIBUTE = re.compile(r"(?P<key>[^\s/>\"'][^\s/>=\"']*+)(?:\s*+=\s*+(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]++)?))?")

# Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml object canvas audio video select datalist".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br"}
ITEMS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select", "optgroup"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAINS = frozenset("article main".split())
AWAY = frozenset("nav footer aside form button menu dialog fieldset label search head".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
# Words of class and id names, apart at hyphens, underscores, digits and humps.
AWAY_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies disqus respond discussion share sharing social related recommended recommendations trending popular subscribe subscription newsletter signup login signin register widget widgets popup modal overlay paywall toolbar pagination pager tags taglist copyright legal disclaimer skip search form".split())
CONTENT_WORDS = frozenset("article content post entry story body text prose main".split())
# Words that say nothing beside a word of the first list: a name made of both kinds only is sure.
PLAIN_WORDS = frozenset("area bar block body bottom box btn button buttons col column container content div footer group header holder inner item items left link links list main panel post posts right section slot top unit wrap wrapper".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE = re.compile(r"[.!?…。！？](?:[\"'”’)\]]*)(?:\s|$)")

# Evidence of a block's containers: the marked main part; an element or role that is not main text; a name that surely is
# not, or partly; a name of content; and, on a page with a marked main part, a place outside it.
MAIN, ASIDE, SURE, PARTLY, NAMED, OUTSIDE = (1 << k for k in range(6))
SHAPES, EVIDENCE = 16, 6
#: Log-odds that each feature adds where the pages say nothing: words (6), link share (4), sentence marks (2), heading
#: (2), list item (2), then the evidence in its order, then what every block has.
PRIOR = (-1.0, -0.6, 0.0, 0.5, 1.0, 1.5, 0.5, 0.0, -1.5, -2.5, -0.6, 0.7, 0.0, 0.2, 0.1, -0.3, 1.5, -3.0, -3.0, -0.6, 1.0, -1.0, 0.3)
#: What all labelled blocks together weigh against the ridge.
WEIGHT = 200.0
#: Relations: same block parent, same ancestor above it, near in depth, else; each for equal and for unequal evidence; then
#: the next block under the same ancestor.
RELATIONS = 9
PRIOR_EDGES = (1.5, 1.2, 0.6, 0.4, 0.4, 0.2, 0.1, 0.05, 0.8)
#: Share that smooths a relation's odds.
SMOOTH = 0.02
LEAST_EDGE = 0.05
UNITS = 10_000
#: The model without any page.
BASE = (PRIOR, PRIOR_EDGES)


class Block:
    __slots__ = ("depth", "evidence", "heading", "item", "key", "linked", "parent", "text")


def parse(source: str) -> list[Block]:
    """Text blocks in page order."""
    blocks: list[Block] = []
    # An open element: (name, ordinal, evidence, hidden).
    stack: list[tuple] = [("", 0, 0, False)]
    names: list[str] = [""]
    opened: dict[str, int] = {}  # open elements by name
    parts: list[str] = []
    endless: set[str] = set()  # raw elements that no tag ends from here on
    linked, links, ordinal, at, end = 0, 0, 0, 0, len(source)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                k = len(stack) - 1
                while k and names[k] not in BLOCK:
                    k -= 1
                b = Block()
                b.text, b.linked, b.parent, b.depth = text, min(linked, len(text)), stack[k][1], len(stack)
                b.evidence = top[2]
                b.heading = names[k] in HEADINGS
                b.item = bool(opened.get("li") or opened.get("td") or opened.get("dd"))
                b.key = stack[k - 1][1] if k else 0
                blocks.append(b)
            parts.clear()
        linked = 0

    def pop_to(k: int):
        nonlocal links
        while len(stack) > k:
            links -= stack.pop()[0] == "a"
            opened[names.pop()] -= 1

    def newest(name: str) -> int:
        k = len(names) - 1
        while names[k] != name:
            k -= 1
        return k

    def add(text: str):
        nonlocal linked
        if not stack[-1][3]:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())

    while at < end:
        m = MARKUP.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name == "p" and not opened.get("p"):
                flush()
            elif opened.get(name):
                if name in BLOCK:
                    flush()
                k = newest(name)
                if name not in BLOCK and any(x in BLOCK for x in names[k + 1 :]):
                    continue  # an inline element does not end the blocks inside it
                if any(x in BLOCK for x in names[k:]):
                    flush()
                pop_to(k)
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and opened.get("p"):
                k = newest("p")
                if not any(x in BLOCK for x in names[k + 1 :]):
                    # Elements such as <b> that the paragraph left open end with it.
                    pop_to(k)
            if name in ITEMS:
                same, stop = ITEMS[name]
                same = same.split()
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in stop:
                        break
                    if names[k] in same:
                        pop_to(k)
                        break
        if name in RAW:
            if not m["attrs"].rstrip().endswith("/"):
                close = None if name in endless else re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                if close:
                    at = close.end()
                elif name in ("script", "style"):
                    at = end
                else:
                    endless.add(name)
            continue
        if name in VOID or m["attrs"].rstrip().endswith("/"):
            continue
        _, _, evidence, hidden = stack[-1]
        if name in MAINS:
            evidence = evidence & ~PARTLY | MAIN
        elif name in AWAY or (name == "header" and not evidence & MAIN):
            evidence |= ASIDE
        attrs = m["attrs"]
        if attrs:
            seen = set()
            for x in ATTRIBUTE.finditer(attrs):
                key, value = x["key"].lower(), x["a"] or x["b"] or x["c"] or ""
                if key in seen:  # the first of equal names counts
                    continue
                seen.add(key)
                if key in ("class", "id") and name not in ("html", "body"):
                    evidence |= (named if len(value) <= 256 else named.__wrapped__)(value, bool(evidence & MAIN))
                elif key == "role":
                    roles = {*value.lower().split()}
                    evidence |= ASIDE * bool(roles & AWAY_ROLES) | MAIN * bool(roles & MAINS)
                elif key == "style":
                    flat = value.lower().replace(" ", "")
                    hidden = hidden or "display:none" in flat or "visibility:hidden" in flat
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                    hidden = True
        ordinal += 1
        links += name == "a"
        stack.append((name, ordinal, evidence, hidden))
        names.append(name)
        opened[name] = opened.get(name, 0) + 1
    flush()
    if any(b.evidence & MAIN for b in blocks):
        for b in blocks:
            if not b.evidence & MAIN:
                b.evidence |= OUTSIDE
    return blocks


@functools.lru_cache(4096)
def named(value: str, in_main: bool) -> int:
    """Evidence of a class or id attribute."""
    out = 0
    for token in value.split()[:64]:
        words = [w.lower() for w in WORD.findall(token)]
        away = [w for w in words if w in AWAY_WORDS and not (in_main and w == "header")]
        if away:
            sure = any(w not in PLAIN_WORDS for w in away) or len(words) == 1
            out |= SURE if sure and all(w in AWAY_WORDS or w in PLAIN_WORDS for w in words) else PARTLY
        elif any(w in CONTENT_WORDS for w in words):
            out |= NAMED
    return out


def shape(b: Block) -> tuple[int, ...]:
    """The active shape features of a block: word count, link share, sentence marks, heading, list item."""
    words, share = b.text.count(" ") + 1, b.linked / len(b.text)
    return (
        0 if words < 3 else 1 if words < 6 else 2 if words < 12 else 3 if words < 25 else 4 if words < 60 else 5,
        6 + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3),
        10 + bool(SENTENCE.search(b.text)),
        12 + b.heading,
        14 + b.item,
    )


def terminals(blocks: list[Block], weights: tuple[float, ...]) -> list[float]:
    """Capacity to the content side less that to the boilerplate side, of each block."""
    by_evidence = {e: weights[-1] + sum(weights[SHAPES + k] for k in range(EVIDENCE) if e >> k & 1) for e in {b.evidence for b in blocks}}
    return [by_evidence[b.evidence] + sum(weights[k] for k in shape(b)) for b in blocks]


def relations(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, later block, kind of relation) of the pairs that edges join."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            a = blocks[k - 1]
            kind = 0 if a.parent == b.parent else 1 if a.key == b.key else 2 if abs(a.depth - b.depth) <= 1 else 3
            out.append((k - 1, k, kind if a.evidence == b.evidence else 4 + kind))
        j = last.get((b.key, b.evidence))
        if j is not None and j < k - 1:
            out.append((j, k, 8))
        last[b.key, b.evidence] = k
    return out


def minimum_cut(unary: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """The content side of a minimum cut; of several, the least. Capacities count in whole units."""
    n = len(unary)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    total = [0] * n
    for a, b, w in links:
        w = round(w * UNITS)
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
        total[a] += w
        total[b] += w
    gain, side = [round(u * UNITS) for u in unary], [None] * n
    pending = deque(range(n))
    while pending:  # a block that outweighs its edges is settled; its edges become capacities of its neighbours
        k = pending.popleft()
        if side[k] is None and abs(gain[k]) > total[k]:
            side[k] = gain[k] > 0
            for j, w in near[k].items():
                gain[j] += w if side[k] else -w
                total[j] -= w
                del near[j][k]
                pending.append(j)
            near[k] = {}
    rest = [k for k in range(n) if side[k] is None]
    if rest:
        for k, content in zip(rest, flow_side(rest, gain, near), strict=True):
            side[k] = content
    return [bool(s) for s in side]


def flow_side(rest: list[int], gain: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Whether the source still reaches each node after a maximum flow, by two search trees that grow from the terminals,
    meet on augmenting paths and keep what a saturated arc did not cut off."""
    place = {k: i for i, k in enumerate(rest)}
    n = len(rest)
    to: list[int] = []
    cap: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for k in rest:
        i = place[k]
        for other, w in near[k].items():
            j = place[other]
            if i < j:  # arc a goes from i to j, arc a ^ 1 back
                arcs[i].append(len(to))
                arcs[j].append(len(to) + 1)
                to += (j, i)
                cap += (w, w)
    room = [gain[k] for k in rest]  # to the source if above 0, to the sink if below
    tree = [(g > 0) - (g < 0) for g in room]  # 1: of the source, -1: of the sink, 0: free
    up = [-1 if t else None for t in tree]  # the arc to the parent, -1 at a terminal, None without a parent
    active = deque(i for i in range(n) if tree[i])

    def rooted(i: int) -> bool:
        while up[i] is not None:
            if up[i] == -1:
                return True
            i = to[up[i]]
        return False

    def augment(a: int) -> list[int]:
        """Push what the path through arc a, from the source's tree to the sink's, lets through; the nodes cut off."""
        i, j = to[a ^ 1], to[a]
        least, x = cap[a], i
        while up[x] != -1:
            least = min(least, cap[up[x] ^ 1])
            x = to[up[x]]
        least, x = min(least, room[x]), j
        while up[x] != -1:
            least = min(least, cap[up[x]])
            x = to[up[x]]
        least = min(least, -room[x])
        cap[a] -= least
        cap[a ^ 1] += least
        lost = []
        for x, sign in ((i, 1), (j, -1)):
            while up[x] != -1:
                arc = up[x] ^ 1 if sign > 0 else up[x]
                cap[arc] -= least
                cap[arc ^ 1] += least
                parent = to[up[x]]
                if not cap[arc]:
                    up[x] = None
                    lost.append(x)
                x = parent
            room[x] -= sign * least
            if not room[x]:
                up[x] = None
                lost.append(x)
        return lost

    def adopt(lost: list[int]) -> None:
        while lost:
            i = lost.pop()
            t = tree[i]
            for a in arcs[i]:
                if tree[to[a]] == t and cap[a ^ 1 if t > 0 else a] and rooted(to[a]):
                    up[i] = a
                    break
            else:
                for a in arcs[i]:
                    j = to[a]
                    if tree[j] == t:
                        if cap[a ^ 1 if t > 0 else a]:
                            active.append(j)
                        if up[j] == a ^ 1:
                            up[j] = None
                            lost.append(j)
                tree[i] = 0

    while active:
        i = active[0]
        t, meeting = tree[i], None
        if t:
            for a in arcs[i]:
                if cap[a if t > 0 else a ^ 1]:
                    j = to[a]
                    if not tree[j]:
                        tree[j], up[j] = t, a ^ 1
                        active.append(j)
                    elif tree[j] != t:
                        meeting = a if t > 0 else a ^ 1
                        break
        if meeting is None:
            active.popleft()
        else:
            adopt(augment(meeting))
    return [t > 0 for t in tree]


def labels(source: str, model: tuple[tuple[float, ...], tuple[float, ...]]) -> tuple[list[Block], list[float], list[bool]]:
    """(blocks, terminal capacities, whether each is content) of a page."""
    blocks = parse(source)
    weights, edges = model
    unary = terminals(blocks, weights)
    return blocks, unary, minimum_cut(unary, [(a, b, edges[kind]) for a, b, kind in relations(blocks)])


def main_text(source: str, model: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    blocks, _, side = labels(source, model)
    return " ".join(b.text for b, s in zip(blocks, side, strict=True) if s)


def truth(b: Block) -> bool | None:
    """What a page's own marks say of a block: content, boilerplate, or nothing sure."""
    if b.evidence & MAIN:
        return None if b.evidence & (ASIDE | SURE | PARTLY) else True
    return False if b.evidence & OUTSIDE else None


def fit(pages: DataFrame) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(feature weights, edge capacities) from the blocks of all pages that mark their main part."""

    def run(batches):
        counts: dict[tuple, int] = {}
        for whole in batches:
            for batch in slices(whole, "html"):
                for page in batch.column("html").to_pylist():
                    blocks = parse(page or "")
                    known = [truth(b) for b in blocks]
                    for b, yes in zip(blocks, known, strict=True):
                        if yes is not None:
                            key = (yes, b.evidence, *shape(b))
                            counts[key] = counts.get(key, 0) + 1
                    for i, j, kind in relations(blocks):
                        if known[i] is not None and known[j] is not None:
                            key = (known[i] == known[j], -1, kind)
                            counts[key] = counts.get(key, 0) + 1
        keys = [*counts]
        yield pa.RecordBatch.from_pydict({"yes": pa.array([k[0] for k in keys], pa.bool_()), "evidence": pa.array([k[1] for k in keys], pa.int32()), "shape": pa.array([list(k[2:]) for k in keys], pa.list_(pa.int32())), "n": pa.array([counts[k] for k in keys], pa.int64())})

    made = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(released(run), "yes boolean, evidence int, shape array<int>, n bigint")
    cells = made.groupBy("yes", "evidence", "shape").agg(F.sum("n").alias("n")).collect()  # as many as features have values
    return _weights([c for c in cells if c["evidence"] >= 0]), _edges([c for c in cells if c["evidence"] < 0])


def _weights(cells: list) -> tuple[float, ...]:
    prior = np.array(PRIOR)
    yes = sum(c["n"] for c in cells if c["yes"])
    no = sum(c["n"] for c in cells if not c["yes"])
    if not yes or not no:
        return PRIOR
    x, y, n = [], [], []
    marks = MAIN | OUTSIDE | ASIDE
    for c in sorted(cells, key=lambda c: (c["yes"], c["evidence"], c["shape"])):
        for evidence in (c["evidence"], c["evidence"] & ~marks, 0):
            row = np.zeros(len(prior))
            row[[*c["shape"], *(SHAPES + k for k in range(EVIDENCE) if evidence >> k & 1), len(prior) - 1]] = 1
            x.append(row)
            y.append(float(c["yes"]))
            n.append(WEIGHT * c["n"] / (yes if c["yes"] else no) / 6)  # both sides, and the three views, weigh the same
    x, y, n, w = np.array(x), np.array(y), np.array(n), prior.copy()
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (p - y)) + (w - prior))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _edges(cells: list) -> tuple[float, ...]:
    same, other = np.zeros(RELATIONS), np.zeros(RELATIONS)
    for c in cells:
        (same if c["yes"] else other)[c["shape"][0]] += c["n"]
    total = same + other
    odds = (same / np.maximum(total, 1) + SMOOTH) / (other / np.maximum(total, 1) + SMOOTH)
    return tuple(float(max(LEAST_EDGE, np.log(o) / 2)) if t else p for o, t, p in zip(odds, total, PRIOR_EDGES, strict=True))


def extract(pages: DataFrame, model: tuple[tuple[float, ...], tuple[float, ...]]) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    chosen = pages.select("page_id", "url", F.col("html").cast("string"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(page or "", model) for page in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return chosen.mapInArrow(released(run), f"{kinds}, text string, n_chars bigint")
