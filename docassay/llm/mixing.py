"""Soft-membership mixing of sources to target weights.

A softmax classifier, fitted by small steps over a bounded sample of labelled rows (SAMPLE, the rows of least hash), gives
every document a posterior p over domains from its hashed words and a few shape features.

Projected-gradient least squares fits nonnegative document rates r. With S the sum of r * tokens * p over all documents
and T the target totals, it minimises (S - T)' M (S - T) / 2 + SLACK * sum of tokens * (r - 1)^2 / 2 over r >= 0, where M is the
inverse of the sum of tokens * p p'; so differences weigh by what documents can do about them. Each round aggregates S
over all documents (one small row) and moves every rate against its gradient, scaled by one over its tokens, then
projects it: r <- max(0, r + STEP * (p . M (T - S) - SLACK * (r - 1))). That the curvature is 1 + SLACK at most makes the step safe
everywhere. A rate depends on its own p and the rounds' small vectors M (T - S) only: the driver keeps these, rates are
column expressions over them, and none is collected.

A document is then emitted floor(rate) times, and once more with the probability of the rest, by a hash of doc_id.

Defined results: null texts have no tokens, keep rate 1 and take no part in the totals. Rows that repeat a doc_id are
separate documents of equal luck. Without labelled rows all posteriors are equal shares of the target's domains. Domains
that no document can supply stay short of their target; the fit then is the least-squares one.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay.llm._common import discard, expand, hash_words, materialise, released, slices, words_of

SAMPLE = 8_000
BUCKETS = 1 << 14
SHAPES = 5
EPOCHS, BATCH = 12, 256
RIDGE = 2e-3
ROUNDS = 60
#: Share of the tokens that the domains' totals may miss their targets by, or that a round may still move them.
TOLERANCE = 1e-4
#: Weight of the rates' distance from one against the misfit: it keeps rates bounded where no document can supply a domain.
SLACK = 1e-4
STEP = 1 / (1 + SLACK)


def featurise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, first bucket of each text and the total, shape features, words) of some texts."""
    codes, words, offsets = words_of(texts, lower=True)
    bucket = (hash_words(words) % np.uint64(BUCKETS)).astype(np.int64)
    length = np.fromiter(map(len, words.to_pylist()), dtype=np.float64, count=len(words))
    odd = np.fromiter((not w[:-1].isalpha() for w in words.to_pylist()), dtype=np.float64, count=len(words))
    n = np.diff(offsets)
    found, shape = [], np.zeros((len(n), SHAPES))
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        own = codes[a:b]
        distinct = np.unique(own)
        found.append(np.unique(bucket[distinct]))
        if b > a:
            shape[i] = np.log1p(b - a) / 5, len(distinct) / (b - a), length[own].mean() / 8, odd[own].mean(), 1
    ends = np.r_[0, np.cumsum([len(f) for f in found], dtype=np.int64)]
    return np.concatenate(found) if found else np.empty(0, np.int64), ends, shape, n


def _logits(flat: np.ndarray, ends: np.ndarray, shape: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(w[flat], axis=0)])
    return sums[ends[1:]] - sums[ends[:-1]] + shape @ v


def fit(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of buckets and shape features, from labels (doc_id, domain) joined with doc_id and text of documents."""
    sample = labels.select(F.col("doc_id").cast("bigint"), F.col("domain")).where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    joined = texts.join(F.broadcast(sample), "doc_id")  # at most SAMPLE rows

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                flat, ends, shape, _ = featurise(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                shapes = pa.ListArray.from_arrays(pa.array(np.arange(len(shape) + 1, dtype=np.int32) * SHAPES), pa.array(shape.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), lists, shapes], names=["doc_id", "domain", "buckets", "shape"])

    table = joined.select("doc_id", "domain", "text").mapInArrow(released(run), "doc_id bigint, domain string, buckets array<int>, shape array<double>").toArrow().sort_by("doc_id").combine_chunks()
    w, v = np.zeros((BUCKETS, len(domains))), np.zeros((SHAPES, len(domains)))
    if not table.num_rows:
        return w, v
    lists = table["buckets"].combine_chunks()
    flat, ends = np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
    shape = np.asarray(table["shape"].combine_chunks().flatten()).reshape(-1, SHAPES)
    truth = np.array([domains.index(d) for d in table["domain"].to_pylist()])
    one = np.eye(len(domains))[truth]
    # Adam over batches in an order of its own.
    m = [np.zeros_like(w), np.zeros_like(v)]
    s = [np.zeros_like(w), np.zeros_like(v)]
    rng, step = np.random.default_rng(1), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(truth))
        rate = 0.02 * (1 - epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            rows, step = order[a : a + BATCH], step + 1
            sizes = ends[rows + 1] - ends[rows]
            own, cuts = flat[expand(ends[rows], sizes)], np.r_[0, np.cumsum(sizes)]
            z = _logits(own, cuts, shape[rows], w, v)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - one[rows]) / len(rows)
            part = np.repeat(g, sizes, axis=0)
            gw = np.stack([np.bincount(own, part[:, c], BUCKETS) for c in range(len(domains))], axis=1) + RIDGE * w
            for k, (x, grad) in enumerate(((w, gw), (v, shape[rows].T @ g + RIDGE * v))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad * grad
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return w, v


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], domains: list[str], keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The kept columns, then n_tokens and the posterior (array by domains), each with the prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias(f"{prefix}text_"))
    schema = chosen.select(*chosen.columns[:-1]).schema.add(f"{prefix}n_tokens", T.LongType()).add(f"{prefix}posterior", T.ArrayType(T.DoubleType()))
    d = len(domains)

    def run(batches):
        w, v = sent.value
        for whole in batches:
            for batch in slices(whole, f"{prefix}text_", 2_000_000):
                flat, ends, shape, n = featurise(batch.column(len(keep)))
                z = _logits(flat, ends, shape, w, v)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * d), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(n), lists], names=[*keep, f"{prefix}n_tokens", f"{prefix}posterior"])

    return chosen.mapInArrow(released(run), schema)


def rate_of(tokens: Column, posterior: Column, moves: list[list[float]]) -> Column:
    """A document's rate after the rounds' moves; one for a document without tokens."""
    rate = F.lit(1.0)
    for move in moves:
        dot = reduce(add, (F.get(posterior, F.lit(k)) * F.lit(float(STEP * x)) for k, x in enumerate(move)))
        rate = F.greatest(F.lit(0.0), rate * F.lit(1 - STEP * SLACK) + F.lit(STEP * SLACK) + dot)
    return F.when(tokens == 0, F.lit(1.0)).otherwise(rate)


def solve(rows: DataFrame, targets: list[float], tokens: str = "n_tokens", posterior: str = "posterior", rounds: int = ROUNDS) -> tuple[list[list[float]], float]:
    """(the rounds' moves, share of the tokens by which totals miss) that bring the domains' expected tokens to shares of
    the total; rows are read once a round."""
    d = len(targets)
    p, t = F.col(posterior), F.col(tokens).cast("double")
    pairs = [(j, k) for j in range(d) for k in range(j, d)]
    share = np.array(targets) / sum(targets)
    first = rows.agg(F.sum(t).alias("t"), *(F.sum(t * F.get(p, F.lit(j)) * F.get(p, F.lit(k))).alias(f"h{j}_{k}") for j, k in pairs)).first()
    total = float(first["t"] or 0)
    if not total:
        return [], 0.0
    h = np.zeros((d, d))
    for j, k in pairs:
        h[j, k] = h[k, j] = first[f"h{j}_{k}"] / total
    weigh = np.linalg.inv(h + 1e-9 * np.eye(d))  # a domain that no document has stays without effect
    moves: list[list[float]] = []
    before, left = None, np.inf
    for _ in range(rounds):
        held = rows.select((rate_of(t, p, moves) * t).alias("rt"), *(F.get(p, F.lit(k)).alias(f"p{k}") for k in range(d)))
        now = held.agg(*(F.sum(F.col("rt") * F.col(f"p{k}")).alias(f"s{k}") for k in range(d))).first()
        reached = np.array([float(now[f"s{k}"]) for k in range(d)]) / total
        left = float(np.abs(share - reached).sum())
        if left < TOLERANCE or (before is not None and np.abs(reached - before).sum() < TOLERANCE / 100):
            break
        before = reached
        moves.append((weigh @ (share - reached)).tolist())
    return moves, left


def copies_of(rate: Column, doc_id: str) -> Column:
    luck = F.pmod(F.xxhash64(F.lit("mix"), F.col(doc_id)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (luck < rate - F.floor(rate)).cast("int")).cast("bigint")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, one posterior column p_<domain> each, rate and copies of every document."""
    domains = sorted(targets)
    rows = materialise(posteriors(docs, fit(docs, labels, domains), domains), "posteriors")
    moved, _ = solve(rows, [targets[d] for d in domains])
    rated = rows.withColumn("rate", rate_of(F.col("n_tokens"), F.col("posterior"), moved))
    return rated.select("doc_id", "n_tokens", *(F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(domains)), "rate", copies_of(F.col("rate"), "doc_id").alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The documents, all columns as they came, each as often as its rate says."""
    domains = sorted(targets)
    prefix = "mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    model = fit(docs, labels, domains)
    rows = materialise(posteriors(docs, model, domains, keep=()), "posteriors")
    moved, _ = solve(rows, [targets[d] for d in domains])
    discard(rows)
    again = posteriors(docs, model, domains, keep=tuple(docs.columns), prefix=prefix)
    rate = rate_of(F.col(prefix + "n_tokens"), F.col(prefix + "posterior"), moved)
    dealt = again.withColumn(prefix + "n", copies_of(rate, "doc_id")).where(F.col(prefix + "n") > 0)
    return dealt.withColumn(prefix + "k", F.explode(F.sequence(F.lit(1), F.col(prefix + "n")))).select(*docs.columns)


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled table: toxic, else high or low by quality; rows that lack what decides are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 1), "high").when((F.col("toxic") == 0) & (F.col("quality") == 0), "low")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")
