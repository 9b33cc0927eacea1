"""Near-duplicate classes by ProbMinHash.

A document's weighted set holds its five-word shingles (all its words, if fewer), each of weight 1 + log2 of how often it
occurs. Every shingle is a Poisson process of its weight's rate whose points fall into SLOTS slots; a slot keeps the
shingle of its first point, and a shingle's process ends once it is later than every slot (early termination). The share
of equal slots estimates the probability Jaccard similarity of weighted sets, at equal weights that of plain sets.

A document has BANDS bands of ROWS slots from its weighted signature, and as many from that of its plain set, so that
copies one of which repeats a passage meet as well; both are the same where no shingle repeats. Documents that share a
band are candidates. A link is verified exactly: the probability Jaccard similarity of the weighted sets or the Jaccard
similarity of the plain ones is SIMILARITY or more. Classes are the connected components of the links.

Work per bucket follows its size. Equal texts are one node from the start. Each bucket first compares its members with
its most connected one only. Buckets whose members are still in several components are then compared in blocks of
members of different components, inside tasks that get two blocks of some BLOCK members and return links that join
components, not pairs; a pair is looked at in the first of its common bands only. Nothing is capped.

Defined results: words are lower-cased and parted at ASCII white space. Null texts and texts without a word are classes
of their own, rows without doc_id too (their class is null). A class is named after its smallest doc_id. Repeated rows
are in one class; rows that repeat a doc_id with another text are documents of their own, whose classes may bear one
name. An empty table gives an empty table; extra columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm._common import U64, discard, hash_words, materialise, mix, released, slices, words_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
SLOTS = BANDS * ROWS
BLOCK = 256
STEP = U64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, their counts, hash of each text's words, its words)."""
    codes, words, offsets = words_of(texts, lower=True)
    h = hash_words(words)[codes]
    counts = np.diff(offsets)
    with np.errstate(over="ignore"):
        rolled = h.copy()
        for k in range(1, WORDS):
            rolled[:-k] = rolled[:-k] * STEP + h[k:] if k < len(h) else rolled[:-k]
        rolled = mix(rolled)
        sets, times, whole = [], [], np.zeros(len(counts), dtype=U64)
        for i, (a, n) in enumerate(zip(offsets[:-1], counts, strict=True)):
            if n >= WORDS:
                found, c = np.unique(rolled[a : a + n - WORDS + 1], return_counts=True)
            elif n:
                x = U64(n)
                for y in h[a : a + n]:
                    x = mix(x * STEP + y)
                found, c = np.array([x], dtype=U64), np.ones(1, dtype=np.int64)
            else:
                found, c = np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
            sets.append(found)
            times.append(c)
        if len(h):
            # A hash of the word sequence: a sum of words mixed with their places.
            place = np.arange(len(h), dtype=np.int64) - np.repeat(offsets[:-1], counts)
            mixed = mix(h ^ mix(place.astype(U64) * STEP + U64(1)))
            ends = np.r_[U64(0), np.cumsum(mixed, dtype=U64)]
            whole = mix(ends[offsets[1:]] - ends[offsets[:-1]] + counts.astype(U64))
    return sets, times, whole, counts


def signatures(sets: list[np.ndarray], times: list[np.ndarray]) -> np.ndarray:
    """ProbMinHash of each set, weighted 1 + log2(times): the shingle hash (32 bits) of the first point in each slot."""
    n = len(sets)
    q = np.full(n * SLOTS, np.inf)
    out = np.zeros(n * SLOTS, dtype=np.uint32)
    if not n:
        return out.reshape(0, SLOTS)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    h = np.concatenate(sets)
    rate = 1 + np.log2(np.maximum(np.concatenate(times), 1).astype(np.float64))
    doc = np.repeat(np.arange(n), sizes)
    t, step = np.zeros(len(h)), 0
    with np.errstate(over="ignore"):
        while len(h):
            step += 1
            r = mix(h + STEP * U64(step))
            t = t - np.log1p(-((r >> U64(11)).astype(np.float64) * 2.0**-53)) / rate
            slot = doc * SLOTS + (mix(r + STEP) % U64(SLOTS)).astype(np.int64)
            first = t < q[slot]
            s, x = slot[first], t[first]
            np.minimum.at(q, s, x)
            won = x == q[s]
            out[s[won]] = (h[first][won] >> U64(32)).astype(np.uint32)
            alive = t < q.reshape(n, SLOTS).max(axis=1)[doc]
            h, t, rate, doc = h[alive], t[alive], rate[alive], doc[alive]
    return out.reshape(n, SLOTS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sig), BANDS), dtype=U64) + np.arange(1, BANDS + 1, dtype=U64)
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(U64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            x = mix(x * STEP + parts[:, :, k])
    return x.astype(np.int64)


def bands_of(sets: list[np.ndarray], times: list[np.ndarray]) -> np.ndarray:
    """Band keys of each plain set, then of each weighted set."""
    plain = band_keys(signatures(sets, [np.ones(len(s), dtype=np.int64) for s in sets]))
    out = np.concatenate([plain, plain], axis=1)
    some = [i for i, t in enumerate(times) if len(t) and t.max() > 1]
    if some:
        out[some, BANDS:] = band_keys(signatures([sets[i] for i in some], [times[i] for i in some]))
    return out


def twin(text: str = "text"):
    """A hash of a text's words by built-in functions: it tells rows that repeat a doc_id apart."""
    words = F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+", " ")
    return F.xxhash64(F.trim(words))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, twin, node (hash of the words; null without words), keys (plain bands, weighted bands)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, chars=4_000_000):
                sets, times, node, words = shingles(batch.column("text"))
                keys = bands_of(sets, times)
                none = words == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * 2 * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), pa.array(node.astype(np.int64), mask=none), lists], names=["doc_id", "twin", "node", "keys"])

    return docs.select(F.col("doc_id").cast("bigint"), twin().alias("twin"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id bigint, twin bigint, node bigint, keys array<bigint>")


class Weighted:
    """A text's sorted shingles with their weights; weights is None where none repeats."""

    def __init__(self, shingles: np.ndarray, repeats: np.ndarray):
        self.shingles, self.weights = shingles, None
        if len(repeats):
            self.weights = np.ones(len(shingles))
            self.weights[repeats[:, 0]] = 1 + np.log2(repeats[:, 1])

    @staticmethod
    def repeats(times: np.ndarray) -> np.ndarray:
        """(place, times) of the shingles that occur more than once."""
        at = np.flatnonzero(times > 1)
        return np.stack([at, times[at]], axis=1).astype("<u4")

    @classmethod
    def of(cls, shingles: pa.BinaryScalar, repeats: pa.BinaryScalar) -> Weighted:
        return cls(np.frombuffer(shingles.as_buffer(), U64), np.frombuffer(repeats.as_buffer(), "<u4").reshape(-1, 2))


def probability_jaccard(a: Weighted, b: Weighted) -> float:
    """Sum over common shingles i of one over the sum over all shingles j of max(a_j / a_i, b_j / b_i)."""
    both, at, bt = np.intersect1d(a.shingles, b.shingles, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = (np.ones(len(s.shingles)) if s.weights is None else s.weights for s in (a, b))
    only_x, only_y, x, y = x.sum() - x[at].sum(), y.sum() - y[bt].sum(), x[at], y[bt]
    order = np.argsort(-x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # For a shingle of ratio r, common shingles of ratio r or more count by x, the others by r y.
    upto = np.searchsorted(-ratio, -ratio, side="right")
    over, under = np.r_[0, np.cumsum(x)][upto] + only_x, y.sum() - np.r_[0, np.cumsum(y)][upto] + only_y
    return float((x / (over + ratio * under)).sum())


def similar(a: Weighted, b: Weighted) -> bool:
    """Whether plain or weighted sets have a similarity of at least SIMILARITY."""
    m, n = len(a.shingles), len(b.shingles)
    if min(m, n) >= SIMILARITY * max(m, n):
        both = len(np.intersect1d(a.shingles, b.shingles, assume_unique=True))
        if both >= SIMILARITY * (m + n - both) - 1e-9:
            return True
    return (a.weights is not None or b.weights is not None) and probability_jaccard(a, b) >= SIMILARITY - 1e-9


def components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, comp (its component's least node) of all nodes of (a, b), and the table they are read from: least neighbour and
    pointer jumping, by joins."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = old = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("far"))
        new = materialise(lower.join(jump, F.col("next") == F.col("to"), "left").select("node", F.least("next", "far").alias("comp"), "was"), "labels")
        discard(old)
        old, labels = new, new.select("node", "comp")
        if new.where("comp <> was").isEmpty():
            discard(both)
            return labels, old


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("repeats").alias("ra"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("repeats").alias("rb"))

    def run(batches):
        for batch in batches:
            columns = zip(*(batch.column(c) for c in ("sa", "ra", "sb", "rb")), strict=True)
            keep = [similar(Weighted.of(sa, ra), Weighted.of(sb, rb)) for sa, ra, sb, rb in columns]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ra", "sb", "rb").mapInArrow(released(run), "a bigint, b bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes), repeats (place and times of those that repeat) of the texts of wanted (rep, node)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, chars=4_000_000):
                sets, times, node, _ = shingles(batch.column("text"))
                out = pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([Weighted.repeats(t).tobytes() for t in times], pa.binary())], names=["node", "asked", "shingles", "repeats"])
                # Rows that repeat a doc_id with another text belong to another node.
                yield out.filter(pc.equal(out.column("node"), out.column("asked"))).select(["node", "shingles", "repeats"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.join(wanted, texts["doc_id"] == wanted["rep"]).select("text", "node").mapInArrow(released(run), "node bigint, shingles binary, repeats binary").dropDuplicates(["node"])


def across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components among the members (key, size, node, comp, keys) of each bucket."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "keys").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        key, i, j = (table[c][0].as_py() for c in ("key", "i", "j"))
        node, comp, own = (table[c].to_numpy() for c in ("node", "comp", "own"))
        keys = np.array(table["keys"].to_pylist(), dtype=np.int64).reshape(-1, 2 * BANDS)
        band = int(np.flatnonzero(keys[0] == key)[0]) % BANDS
        plain, weighted = keys[:, :band], keys[:, BANDS : BANDS + band]
        sets = [Weighted.of(x, y) for x, y in zip(table["shingles"].combine_chunks(), table["repeats"].combine_chunks(), strict=True)]
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for x in range(len(node)):
            rest = np.arange(x + 1, len(node))
            rest = rest[(comp[rest] != comp[x]) & ((own[rest] != own[x]) | (i == j))]
            if band and len(rest):
                p, q, u, v = plain[rest], weighted[rest], plain[x], weighted[x]
                rest = rest[~((p == u) | (q == v) | (p == v) | (q == u)).any(axis=1)]
            for y in rest.tolist():
                a, b = find(comp[x].item()), find(comp[y].item())
                if a != b and similar(sets[x], sets[y]):
                    root[a] = b
                    out.append((node[x].item(), node[y].item()))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, twin, node and comp (least node of the class) of every row; without words, node and comp are null."""
    rows = materialise(sketch(docs), "sketches")
    nodes = materialise(rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "nodes")
    banded = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialise(banded.join(shared, "key"), "buckets")
    degree = buckets.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = buckets.join(degree, "node")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", F.col("node").alias("b")))["b"].alias("b"))
    pairs = buckets.join(leaders, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("rep", "node")
    sets = materialise(shingle_sets(docs, wanted), "shingles")
    edges = materialise(verified(pairs, sets), "edges")
    labels, held = components(edges)
    placed = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    left = placed.join(open_keys, "key").join(nodes.select("node", "keys"), "node")
    more = materialise(across(left, sets), "edges")
    if not more.isEmpty():
        discard(held)
        labels, held = components(edges.union(more))
    named = materialise(nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "classes")
    discard(nodes, buckets, sets, edges, more, held)
    return rows.select("doc_id", "twin", "node").join(named, "node", "left")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node and class_id of every row."""
    rows = members(docs)
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "comp", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, one of its smallest doc_id, with all columns as they came; rows without doc_id stay, and of
    those without a word one for each doc_id."""
    rows = members(docs).where("doc_id is not null")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "twin")).alias("x")).select("x.doc_id", "x.twin")
    first = first.union(rows.where("comp is null").select("doc_id", "twin")).distinct()
    own = "near_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    first = first.select(F.col("doc_id").alias(own + "doc"), F.col("twin").alias(own + "twin"))
    marked = docs.withColumn(own, twin())
    kept = marked.join(first, (F.col("doc_id").cast("bigint") == F.col(own + "doc")) & (F.col(own) == F.col(own + "twin")), "left_semi").dropDuplicates(["doc_id", own])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))
