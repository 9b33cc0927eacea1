"""Exact top-k inner products by dual-tree cover-tree search.

Vectors become integers, floor(SCALE * x). Every task builds a cover tree over its rows, block by block, and lets a tree
over each bounded chunk of queries pass it. A node of level l holds points within RATIO ** l of its centre; its children
are of lower levels, the first has the node's own centre (nesting), centres of a net are further from each other than
what they cover (separation), and every point lies in one child (covering). A net has FANOUT centres at most; points that
it leaves uncovered, as where all are about as far from each other, are single children of the node, which are kept in
leaves by their distance from its centre. Every node keeps the measured radius and the greatest norm of what it covers.

A pair of nodes is visited unless the bound, the lesser of cq . cx + |cq| rx + |cx| rq + rq rx and of the product of the greatest
norms, is below the worst kth score of the query group; pairs of leaves are scored at once, in floating point where
products are exact, else in whole numbers of any size that are cut to 64 bits at the end. Tasks' best rows are ranked by
Spark.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of different length are not compared; a query is not its own candidate (nor is a row that repeats its
vec_id). Ties go to the smaller vec_id. Rows that repeat a query's vec_id with the same vector count once as a query; with
another vector they are a query of their own, with a list of its own under the same query_id. Extra columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm._vectors import Best, clean, matrix, search

SCALE = 256
LEAF = 512
QUERY_LEAF = 128
FANOUT = 32
RATIO = 1.5


class Node:
    __slots__ = ("a", "b", "center", "children", "level", "most", "norm", "radius")

    def __init__(self, center: np.ndarray, radius: float, most: float, a: int, b: int):
        self.center, self.radius, self.most, self.a, self.b = center, radius, most, a, b
        self.level = math.ceil(math.log(radius, RATIO)) if radius > 0 else -math.inf
        self.norm, self.children = float(np.linalg.norm(center)), []


def build(x: np.ndarray, leaf: int) -> tuple[Node, np.ndarray]:
    """(root, order): a node covers the rows order[a:b]."""
    order = np.empty(len(x), dtype=np.int64)
    norms = np.sqrt((x * x).sum(axis=1))
    place = 0

    def grow(points: np.ndarray, center: int, whole: bool = False) -> Node:
        nonlocal place
        d = np.sqrt(((x[points] - x[center]) ** 2).sum(axis=1))
        node = Node(x[center], float(d.max()) * (1 + 1e-12), float(norms[points].max()), place, place)
        if whole or len(points) <= leaf or node.radius == 0:
            order[place : place + len(points)] = points
            place += len(points)
        else:
            reach = min(RATIO ** (node.level - 1), node.radius / RATIO)
            near = d <= reach
            groups, rest, far = [(points[near], center)], points[~near], d[~near]
            while len(rest) and len(groups) < FANOUT:
                c = int(rest[np.argmax(far)])  # the point furthest from the centres so far
                away = np.sqrt(((x[rest] - x[c]) ** 2).sum(axis=1))
                near = away <= reach
                groups.append((rest[near], c))
                rest, far = rest[~near], np.minimum(far, away)[~near]
            node.children = [grow(p, c) for p, c in groups if len(p)]
            if len(rest):
                rest = rest[np.argsort(((x[rest] - x[center]) ** 2).sum(axis=1), kind="stable")]
                node.children += [grow(rest[a : a + leaf], int(rest[a]), True) for a in range(0, len(rest), leaf)]
        node.b = place
        return node

    return grow(np.arange(len(x)), 0), order


def bound(q: Node, n: Node) -> float:
    product = float(q.center @ n.center)
    reach = q.norm * n.radius + n.norm * q.radius + q.radius * n.radius
    return min(product + reach + 1e-9 * (abs(product) + reach), q.most * n.most * (1 + 1e-9)) + 1e-6


def dual_search(best: Best, q: np.ndarray, q_root: Node, x: np.ndarray, ids: np.ndarray, x_root: Node, exact: bool) -> int:
    """Update best (in the query tree's order) from the pairs that the bound lets through; the number of leaf pairs scored."""
    scored = 0
    stack = [(bound(q_root, x_root), q_root, x_root)]
    while stack:
        most, a, b = stack.pop()
        if most < best.worst(a.a, a.b):
            continue
        if not a.children and not b.children:
            scored += 1
            rows = slice(b.a, b.b)
            if exact:
                score = (q[a.a : a.b] @ x[rows].T).astype(np.int64)
            else:
                most = np.iinfo(np.int64).max
                score = np.array([[max(-most - 1, min(most, s)) for s in row] for row in q[a.a : a.b].astype(object) @ x[rows].astype(object).T], dtype=np.int64)
            for i in range(a.a, a.b):
                s = score[i - a.a]
                hit = np.flatnonzero((s >= best.score[i, -1]) & (ids[rows] != best.queries[i]))
                if len(hit) > best.k:  # keep what can be among the k best, ties included
                    hit = hit[s[hit] >= np.partition(s[hit], -best.k)[-best.k]]
                if len(hit):
                    best.offer(i, s[hit], ids[rows][hit])
        elif a.children and (not b.children or a.radius >= b.radius):
            stack += [(bound(c, b), c, b) for c in a.children]
        else:  # the most promising child is on top of the stack
            stack += sorted(((bound(a, c), a, c) for c in b.children), key=lambda p: p[0])
    return scored


def whole(table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return {n: (ids, np.floor(SCALE * v), places) for n, (ids, v, places) in matrix(table).items()}


def index(block) -> dict:
    """A tree over each length of vectors in a block: rows in the tree's order, their ids, the root."""
    out = {}
    for n, (ids, x, _) in whole(block).items():
        root, order = build(x, LEAF)
        out[n] = x[order], ids[order], root
    return out


def look(k: int):
    def run(trees: dict, chunk) -> Iterator[Best]:
        for n, (ids, q, places) in whole(chunk).items():
            if n in trees:
                x, x_ids, x_root = trees[n]
                root, order = build(q, QUERY_LEAF)
                best = Best(ids[order], k, np.int64, places[order])
                exact = float(np.abs(q).max()) * float(np.abs(x).max()) * n < 2.0**53
                dual_search(best, q[order], root, x, x_ids, x_root, exact)
                yield best

    return run


def top_k(vectors: DataFrame, k: int = 5, modulus: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products; queries have a vec_id that modulus divides."""
    rows = clean(vectors, zero=True)
    queries = rows.where(F.pmod("vec_id", F.lit(modulus)) == 0).distinct()
    return search(rows, queries, k, "bigint", index, look(k))
