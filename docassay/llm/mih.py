"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: the sample's mean is taken off, principal axes and an iterated rotation make sign bits, as many as components and
64 at most; WORDS such rotations from different starts stand side by side. They are fitted on at most SAMPLE rows, those
of least hash; every row is coded and indexed. A task indexes its rows, block by block, in each of the code's substrings
of PART bits. A query probes all values within radius // substrings of the first substrings, as many as the division leaves
over and one, and within one less of the others, which by the pigeonhole principle retrieves every code within the radius,
checks the whole code's distance, and ranks what is left by exact cosine.

The radius grows with the query: codes of rows at cosine c differ in bits * t places on average, t = acos(c) / pi. For at
most PROBES queries the exact neighbours among all rows are found; margin is the number of deviations sqrt(bits * t * (1 - t))
by which the share COVER of them is nearer than average or at most further. A query is done with a block once its radius
reaches bits * t + margin * deviation for its kth best cosine so far: what is further would have to be an exception to be
among the best. Where fewer than k rows are in the ball the radius grows on, to the whole code.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without vec_id; vectors of different length are not compared (the commonest length of the sample is coded, others are
searched exactly). Ties go to the smaller vec_id; a query is not its own candidate. Rows that repeat a query's vec_id with
the same vector count once as a query; with another vector they are a query of their own. Extra columns take no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm._common import released
from docassay.llm._vectors import Best, clean, matrix, row_blocks, search

SAMPLE = 4_096
PROBES = 96
COVER = 0.93
PART = 16
ITERATIONS = 30
WORDS = 3
#: Bits by which a radius grows where too few rows are near.
STEP = 16


class Model:
    """The mean and, for each word of the code, the projection whose signs are its bits."""

    def __init__(self, x: np.ndarray):
        self.bits = min(64, x.shape[1])
        self.margin = 2.0
        self.start = 0.5
        unit = x / norms_of(x)[:, None]
        self.mean = unit.mean(axis=0)
        values, axes = np.linalg.eigh(np.cov(unit - self.mean, rowvar=False).reshape(x.shape[1], x.shape[1]))
        axes = axes[:, np.argsort(-values)[: self.bits]]
        v = (unit - self.mean) @ axes
        self.projections = []
        for word in range(WORDS):
            r = np.linalg.qr(np.random.default_rng(3 + word).normal(size=(self.bits, self.bits)))[0]
            for _ in range(ITERATIONS):
                left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (left @ right).T
            self.projections.append(axes @ r)

    @property
    def whole(self) -> int:
        return self.bits * WORDS

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows x words."""
        centred = x / norms_of(x)[:, None] - self.mean
        out = np.empty((len(x), WORDS), dtype="<u8")
        for word, projection in enumerate(self.projections):
            packed = np.packbits(centred @ projection >= 0, axis=1, bitorder="little")
            out[:, word] = np.ascontiguousarray(np.pad(packed, ((0, 0), (0, 8 - packed.shape[1])))).view("<u8").ravel()
        return out

    def deviations(self, cosine: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """How far codes are from the distance that their vectors' cosine leads to, in deviations."""
        t = np.clip(np.arccos(np.clip(cosine, -1, 1)) / np.pi, 1e-6, 1 - 1e-6)
        return (distance - self.whole * t) / np.sqrt(self.whole * t * (1 - t))

    def radius(self, cosine: float) -> int:
        """The code distance within which rows of at least such a cosine are, but for exceptions."""
        t = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
        return max(0, min(self.whole, math.ceil(self.whole * t + self.margin * math.sqrt(self.whole * t * (1 - t)))))


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


@cache
def masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most radius ones, the fewest ones first."""
    return np.concatenate([np.fromiter((sum(1 << i for i in c) for c in itertools.combinations(range(bits), r)), dtype=np.int64) for r in range(min(bits, radius) + 1)])


class Index:
    """Rows by each substring of their codes."""

    def __init__(self, code: np.ndarray, bits: int):
        self.code = code
        self.parts = [(word, a, min(PART, bits - a)) for word in range(code.shape[1]) for a in range(0, bits, PART)]
        self.tables = []
        for word, a, n in self.parts:
            value = ((code[:, word] >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.r_[0, np.cumsum(np.bincount(value, minlength=1 << n))]))

    def ball(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius."""
        seen = np.zeros(len(self.code), dtype=bool)
        each, more = divmod(radius, len(self.parts))
        for j, ((word, a, n), (order, heads)) in enumerate(zip(self.parts, self.tables, strict=True)):
            near = each - (j > more)  # were all parts further than this, the codes would differ in more than the radius
            if near < 0:
                continue
            probe = masks(n, near) ^ ((int(code[word]) >> a) & ((1 << n) - 1))
            start, size = heads[probe], heads[probe + 1] - heads[probe]
            hit = size > 0
            start, size = start[hit], size[hit]
            total = int(size.sum())
            if total:
                ends = np.cumsum(size)
                seen[order[np.arange(total) + np.repeat(start - (ends - size), size)]] = True
        rows = np.flatnonzero(seen)
        return rows[distances(self.code[rows], code) <= radius]


def cosines(x: np.ndarray, norms: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
    """Row by row, so that equal vectors have equal scores wherever they are."""
    return (x * q).sum(axis=1) / (norms * norm)


def norms_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def index(model: Model | None, width: int):
    def run(block) -> dict:
        out = {}
        for n, (ids, x, _) in matrix(block).items():
            out[n] = ids, x, norms_of(x), Index(model.codes(x), model.bits) if model and n == width else None
        return out

    return run


def look(k: int, model: Model | None, width: int):
    def run(made: dict, chunk) -> Iterator[Best]:
        for n, (query_ids, q, places) in matrix(chunk).items():
            if n not in made:
                continue
            ids, x, x_norms, held = made[n]
            best, q_norms = Best(query_ids, k, places=places), norms_of(q)
            codes = model.codes(q) if held else None

            def offer(i: int, rows: np.ndarray, ids=ids, x=x, x_norms=x_norms, q=q, q_norms=q_norms, best=best) -> None:
                rows = rows[ids[rows] != best.queries[i]]
                rough = (x[rows] @ q[i]) / (x_norms[rows] * q_norms[i])
                keep = rough >= best.score[i, -1] - 1e-9
                if keep.sum() > k:
                    keep &= rough >= np.partition(rough, -k)[-k] - 1e-9
                rows = rows[keep]
                best.offer(i, cosines(x[rows], x_norms[rows], q[i], q_norms[i]), ids[rows])

            for i in range(len(q)):
                if not held:
                    offer(i, np.arange(len(x)))
                    continue
                radius = model.radius(model.start)
                while True:
                    best.score[i], best.id[i] = best.low, np.iinfo(np.int64).max
                    offer(i, held.ball(codes[i], radius))
                    wanted = model.radius(float(best.score[i, -1])) if best.score[i, -1] > best.low else radius + STEP
                    if radius >= min(wanted, model.whole):
                        break
                    radius = min(wanted, model.whole)
            yield best

    return run


def calibrate(rows: DataFrame, queries: DataFrame, k: int, width: int, model: Model) -> None:
    """Set a model's margin and first cosine from the exact neighbours of at most PROBES queries among all rows."""
    held = matrix(queries.orderBy(F.xxhash64("vec_id"), "v").limit(PROBES).toArrow()).get(width)  # PROBES rows
    if held is None:
        return
    ids, q, _ = held
    sent = rows.sparkSession.sparkContext.broadcast((ids, q, model.codes(q), model))

    def run(batches):
        ids, q, q_codes, model = sent.value
        for block in row_blocks(batches):
            row_ids, x, _ = matrix(block).get(width, (None, None, None))
            if x is None:
                continue
            score = (x @ q.T) / (norms_of(x)[:, None] * norms_of(q))
            score[row_ids[:, None] == ids[None, :]] = -np.inf
            top = np.argpartition(-score, min(k, len(x)) - 1, axis=0)[: min(k, len(x))]
            i, j = np.tile(np.arange(len(q)), len(top)), top.ravel()
            near = np.isfinite(score[j, i])
            i, j = i[near], j[near]
            far = np.bitwise_count(model.codes(x[j]) ^ q_codes[i]).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(score[j, i]), pa.array(far)], names=["probe", "score", "distance"])

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "distance")
    near = rows.mapInArrow(released(run), "probe int, score double, distance int").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toArrow()  # PROBES times k rows
    if near.num_rows:
        score, rank = near["score"].to_numpy(), near["rank"].to_numpy()
        model.margin = float(np.quantile(model.deviations(score, near["distance"].to_numpy()), COVER, method="higher"))
        model.start = float(np.median(score[rank == rank.max()]))


def nearest(vectors: DataFrame, k: int = 5, modulus: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id modulus divides."""
    rows = clean(vectors, zero=False)
    queries = rows.where(F.pmod("vec_id", F.lit(modulus)) == 0).distinct()
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow())  # SAMPLE rows
    width = max(sample, key=lambda n: len(sample[n][0]), default=0)
    model = None
    if width and len(sample[width][0]) > 1:
        model = Model(sample[width][1])
        calibrate(rows, queries, k, width, model)
    return search(rows, queries, k, "double", index(model, width), look(k, model, width))
