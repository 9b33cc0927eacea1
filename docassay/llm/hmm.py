"""Language-model scores: an add-one unigram base and a hidden Markov model over word classes.

Tokens are the words of the text between ASCII white space, A to Z lower-cased, then one end token. The counts of all
words of all training rows are a distributed table keyed by a 64-bit hash; every token of every row is looked up in it:
the commonest words, FREQUENT at most, in a broadcast, all others by a join, after each row has summed up its own.

The HMM emits classes: each of the OWN commonest words is a class, the end is one, other words share one of TAILS
classes by their last letters; within such a class a word has its add-one share. Baum-Welch runs over all training rows,
whole, from a fixed random start, until a pass raises the summed log-likelihood by less than TOLERANCE of it. A pass is
SHARDS steps: in each, tasks add up expected counts over the rows of one share of the files, Spark sums them across
partitions, they replace that share's counts of the pass before, and the model is made anew from the counts of all shares
(incremental expectation-maximisation). The model to start from is trained likewise on the first share alone. The driver holds SHARDS tables of STATES x classes. MOST_PASSES only guards against
a run without end; a model that meets it is reported by a warning. Rows are walked in windows of WINDOW tokens that hand
their state on, forwards and then backwards, so memory does not grow with a row's length and nothing is cut. Scoring
runs the scaled forward recursion over whole rows, so a row's score is exact under the model: log10 of the probability of
its class sequence and of its words given their classes.

Defined results: null and empty texts are the end token alone. A table without training rows gives every token an equal
share. Rows that repeat a doc_id are scored one by one, and all of them train. Extra columns take no part.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm._common import U64, hash_words, materialise, released, slices, words_of

STATES = 8
OWN, TAILS = 4096, 512
CLASSES = OWN + TAILS + 1
END = CLASSES - 1
FREQUENT = 1 << 18
#: Bins to a doubling of the count, where the commonest words are told from the others.
BINS = 64
#: Tokens that are walked between two stored states, and rows that are walked at once.
WINDOW, ROWS = 64, 2048
#: Training ends when a pass's relative gain in log-likelihood is below this.
TOLERANCE = 3e-4
SHARDS = 8
#: How many times the tolerance the first share's training may stop at.
START = 4
MOST_PASSES = 200
#: Distinct words that a task holds before it hands its counts on.
HELD = 1_000_000


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))


def tails(words: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(w[-3:].encode("utf-8", "replace")) % TAILS for w in words.to_pylist()), dtype=np.int16, count=len(words))


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, tail, c of every word of the texts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, tail, n = (np.concatenate([x[k] for x in held]) for k in range(3))
            h, first, back = np.unique(h, return_index=True, return_inverse=True)
            return h, tail[first], np.bincount(back, n, len(h)).astype(np.int64)

        def rows():
            h, tail, n = merged()
            for a in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (h.view(np.int64), tail, n)], names=["hash", "tail", "n"])

        for whole in batches:
            for batch in slices(whole):
                codes, words, _ = words_of(lowered(batch.column("text")))
                held.append((hash_words(words), tails(words), np.bincount(codes, minlength=len(words))))
                size += len(words)
                if size >= HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield from rows()
                        held, size = [], 0
        if held:
            yield from rows()

    return docs.select(F.col("text").cast("string")).mapInArrow(released(run), "hash bigint, tail smallint, n bigint").where("n > 0").groupBy("hash").agg(F.first("tail").alias("tail"), F.sum("n").alias("c"))


class Vocabulary:
    """The commonest words' counts, those that are classes, and the totals."""

    def __init__(self, counts: DataFrame, ends: int):
        # Counts by a fine logarithmic bin say from which count on there are FREQUENT words at most; no task sorts them all.
        size = F.floor(F.log2(F.col("c").cast("double")) * BINS).cast("int")
        least, room = None, FREQUENT
        for r in sorted(counts.groupBy(size.alias("bin")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["bin"]):  # 64 * BINS rows at most
            room -= r["n"]
            if room < 0:
                break
            least = r["bin"]
        chosen = counts.where(size >= least) if least is not None else counts.limit(0)
        top = chosen.select("hash", "c", "tail").toArrow().sort_by([("c", "descending"), ("hash", "ascending")])  # FREQUENT rows at most
        h, c = top["hash"].to_numpy().view(U64), top["c"].to_numpy()
        order = np.argsort(h)
        self.hash, self.count = h[order], c[order]
        self.own = np.full(len(h), -1, dtype=np.int32)
        self.own[: min(OWN, len(h))] = np.arange(min(OWN, len(h)))
        self.own = self.own[order]
        all_n, all_v = np.zeros(TAILS), np.zeros(TAILS)
        for r in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # TAILS rows
            all_n[r["tail"]], all_v[r["tail"]] = r["n"], r["v"]
        own = top["tail"].to_numpy()[:OWN]
        self.tail_n = all_n - np.bincount(own, c[:OWN], TAILS)
        self.tail_v = all_v - np.bincount(own, minlength=TAILS)
        self.ends = ends
        self.tokens = int(all_n.sum()) + ends
        self.distinct = int(all_v.sum()) + (ends > 0)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the commonest words, whether it is there) of hashes."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return at, self.hash[at] == h


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every row: rid, doc_id, held_out, n_tokens, classes (16-bit), known, logs and within (of the commonest words), the
    hashes of its other words and how often each occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        from pyspark import TaskContext

        v = sent.value
        rid = TaskContext.get().partitionId() << 40
        log_c = np.log10(v.count + 1.0)
        tail_log = np.log10(v.tail_n + v.tail_v + 1)
        for whole in batches:
            for batch in slices(whole):
                codes, words, offsets = words_of(lowered(batch.column("text")))
                h = hash_words(words)
                at, there = v.find(h)
                tail = tails(words).astype(np.int32)
                own = np.where(there, v.own[at] if len(v.own) else -1, -1)
                cls = np.where(own >= 0, own, OWN + tail).astype(np.uint16)
                logs = np.where(there, log_c[at] if len(log_c) else 0, 0.0)
                less = np.where(own >= 0, 0.0, tail_log[tail])
                gives = np.where(own >= 0, 0.0, logs) - less  # log10 of the word's share of its class, without a rare word's count
                n = np.diff(offsets)
                count = len(n)
                ends = np.arange(1, count + 1) + offsets[1:] - 1  # each text gets an end token
                seq = np.full(len(codes) + count, END, dtype=np.uint16)
                place = np.ones(len(seq), dtype=bool)
                place[ends] = False
                seq[place] = cls[codes]
                cut = np.r_[0, ends + 1]

                def sums(x, codes=codes, offsets=offsets):
                    s = np.r_[0.0, np.cumsum(x[codes])]
                    return s[offsets[1:]] - s[offsets[:-1]]

                known = sums(there.astype(np.float64)).round().astype(np.int64)
                rare, times = [], []
                unknown = ~there
                for a, b in zip(offsets, offsets[1:], strict=False):
                    own_codes = codes[a:b]
                    x, k = np.unique(own_codes[unknown[own_codes]], return_counts=True)
                    rare.append(h[x].tobytes())
                    times.append(k.astype(np.uint32).tobytes())
                raw = seq.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid + np.arange(count)), batch.column("doc_id"), batch.column("held_out"), pa.array(n + 1), pa.array([raw[2 * a : 2 * b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array(known), pa.array(sums(logs)), pa.array(sums(gives)), pa.array(rare, pa.binary()), pa.array(times, pa.binary())],
                    names=["rid", "doc_id", "held_out", "n_tokens", "classes", "known", "logs", "within", "rare", "times"],
                )
                rid += count

    return docs.select("doc_id", "held_out", F.col("text").cast("string")).mapInArrow(released(run), "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, classes binary, known bigint, logs double, within double, rare binary, times binary")


class Model:
    """Start, transitions and emissions (classes x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.passes = 0

    @classmethod
    def initial(cls, shares: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = (shares + 1e-9)[:, None] * rng.gamma(2.0, 1.0, (len(shares), states))
        move = np.full((states, states), 0.3 / max(1, states - 1)) + np.eye(states) * (0.7 - 0.3 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expected(model: Model, seqs: list[np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (starts, moves, emissions) and log-likelihood of whole sequences."""
    k, classes = len(model.start), len(model.emit)
    starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes)), 0.0
    seqs = sorted((s for s in seqs if len(s)), key=len, reverse=True)
    emit = np.ascontiguousarray(model.emit.T, dtype=np.float32)
    start, move = model.start.astype(np.float32)[:, None], model.move.astype(np.float32)
    onward = np.ascontiguousarray(move.T)
    for a in range(0, len(seqs), ROWS):  # arrays are states x sequences, the longest first
        group = seqs[a : a + ROWS]
        flat, n = np.concatenate(group).astype(np.intp), np.fromiter(map(len, group), dtype=np.int64, count=len(group))
        begin = np.cumsum(n) - n
        longer = lambda t, n=n: int(np.searchsorted(-n, -t, side="left"))  # noqa: E731  sequences longer than t

        def walk(w: int, before: np.ndarray | None, last: int | None = None, flat=flat, begin=begin, n=n, longer=longer):
            """Classes, emissions, scaled states and scales of a window's places, for all sequences or the first ones."""
            for t in range(w * window, min((w + 1) * window, int(n[0]))):
                m = longer(t) if last is None else last
                c = flat[begin[:m] + t]
                e = emit.take(c, axis=1)
                x = (start if before is None else onward @ before[:, :m]) * e
                s = x.sum(axis=0)
                before = x / s
                yield c, e, before, s

        entries: list[np.ndarray | None] = [None]  # the state before each window
        while (m := longer(len(entries) * window)) > 0:
            for _, _, state, _ in walk(len(entries) - 1, entries[-1], m):
                pass
            entries.append(state)
        carry = np.empty((k, 0), np.float32)  # what the next window hands back
        for w in range(len(entries) - 1, -1, -1):
            steps = list(walk(w, entries[w]))
            total += sum(float(np.log(s, dtype=np.float64).sum()) for *_, s in steps)
            gammas = []
            for i in range(len(steps) - 1, -1, -1):
                _, e, alpha, s = steps[i]
                beta = np.ones_like(alpha)
                if carry.shape[1]:
                    after = carry.shape[1]
                    beta[:, :after] = move @ carry
                    moves += model.move * (alpha[:, :after] @ carry.T)
                gamma = alpha * beta
                gamma /= gamma.sum(axis=0)
                gammas.append(gamma)
                carry = e * beta / s
            if not w:
                starts += gammas[-1].sum(axis=1)
            c = np.concatenate([c for c, *_ in reversed(steps)])
            for j in range(k):
                emits[j] += np.bincount(c, np.concatenate([g[j] for g in gammas]), classes)
    return starts, moves, emits.T, total


def maximise(starts, moves, emits) -> Model:
    share = lambda x, add: (x + add) / (x + add).sum(axis=-1, keepdims=True)
    even = emits.sum(axis=1) + 0.5
    emit = emits + 0.1 * even[:, None] / even.sum() * max(1.0, float(emits.sum()) ** 0.5)
    return Model(share(starts, 0.1), share(moves, 0.1), emit / emit.sum(axis=0))


def forward(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log of the probability of each whole sequence, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    if not seqs:
        return out
    n = np.fromiter(map(len, seqs), dtype=np.int64, count=len(seqs))
    order = np.argsort(-n, kind="stable")
    flat, begin = np.concatenate([seqs[i] for i in order]), np.r_[0, np.cumsum(n[order])][:-1]
    size, logs = n[order], np.zeros(len(seqs))
    alpha = None
    counts = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")  # sequences longer than t
    for t, m in enumerate(counts.tolist()):
        x = (np.broadcast_to(model.start, (m, len(model.start))) if t == 0 else alpha[:m] @ model.move) * model.emit[flat[begin[:m] + t]]
        s = x.sum(axis=1)
        alpha = x / s[:, None]
        logs[:m] += np.log(s)
    out[order] = logs
    return out


def sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("classes")]


def gathered(batches, size: int = 12_000_000):
    """Lists of batches of some bytes of classes together, so that the few long rows of many batches are walked side by side."""
    held, n = [], 0
    for whole in batches:
        for batch in slices(whole, "classes", size):
            held.append(batch)
            n += batch.column("classes").nbytes
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def train(rows: DataFrame, shares: np.ndarray, tolerance: float = TOLERANCE, most: int = MOST_PASSES) -> Model:
    """Baum-Welch over all rows of a written table (classes, held_out) that are not held out, until it converges."""
    spark = rows.sparkSession
    model = Model.initial(shares)
    k, m = STATES, len(shares)
    parts = (k, k * k, m * k, 1)
    files = sorted(rows.inputFiles())
    shards = [spark.read.schema(rows.schema).parquet(*files[i::SHARDS]).where("not held_out") for i in range(min(SHARDS, len(files)))]
    counts = np.zeros((len(shards), sum(parts)))

    def count(i: int) -> None:
        """Expected counts of a share under the model."""
        sent = spark.sparkContext.broadcast(model)

        def run(batches):
            sums = np.zeros(sum(parts))
            for some in gathered(batches):
                got = expected(sent.value, [s for batch in some for s in sequences(batch)])
                sums += np.concatenate([np.ravel(x) for x in got])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["place", "x"])

        table = shards[i].select("classes").mapInArrow(released(run), "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow()  # as many rows as the model has parameters
        counts[i] = 0
        counts[i, table["place"].to_numpy()] = table["x"].to_numpy()
        sent.unpersist()

    # The first share alone gives the model to start from, then each pass takes all shares.
    for stage in ([0],) * (len(shards) > 1) + (range(len(shards)),) * (len(shards) > 0):
        last = -np.inf
        for done in range(most):
            for i in stage:
                count(i)
                if counts[:, -1].any() and (done or len(stage) == 1 or i + 1 == len(shards)):  # all of the stage's shares have counts
                    a, c, d, _ = np.split(counts.sum(axis=0), np.cumsum(parts)[:-1])
                    model = maximise(a, c.reshape(k, k), d.reshape(m, k))
            total = counts[:, -1].sum()
            if not total or total - last <= (tolerance if len(stage) == len(shards) else START * tolerance) * abs(total):
                break
            last = total
        else:
            warnings.warn(f"Baum-Welch has not converged in {most} passes", stacklevel=2)
        model.passes = done + 1
    return model


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text, held_out); rows not held out train."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), "held_out")
    training = docs.where("not held_out")
    counts = materialise(word_counts(training), "word-counts")
    vocabulary = Vocabulary(counts, training.count())
    rows = materialise(encode(docs, vocabulary), "class-sequences")
    shares = np.zeros(CLASSES)
    own = vocabulary.own >= 0
    shares[vocabulary.own[own]] = vocabulary.count[own]
    shares[OWN : OWN + TAILS] = vocabulary.tail_n
    shares[END] = vocabulary.ends
    model = train(rows, shares / max(1, shares.sum()))
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for some in gathered(batches):
            logs, at = forward(sent.value, [s for batch in some for s in sequences(batch)]) / np.log(10), 0
            for batch in some:
                yield batch.drop_columns(["classes"]).append_column("sequence", pa.array(logs[at : at + batch.num_rows]))
                at += batch.num_rows

    scored = rows.select("rid", "doc_id", "held_out", "n_tokens", "known", "logs", "within", "classes").mapInArrow(released(run), "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, within double, sequence double")

    def rare(batches):
        for whole in batches:
            for batch in slices(whole, "rare", 8_000_000):
                h = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("rare")]
                n = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("times")]
                rid = np.repeat(np.asarray(batch.column("rid")), [len(x) for x in h])
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.concatenate(h)), pa.array(np.concatenate(n).astype(np.int32))], names=["rid", "hash", "n"])

    others = rows.select("rid", "rare", "times").mapInArrow(released(rare), "rid bigint, hash bigint, n int")
    found = others.join(counts.select("hash", "c"), "hash").groupBy("rid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    v = vocabulary
    floor, end_log = float(np.log10(v.tokens + v.distinct + 1)), float(np.log10(v.ends + 1))
    both = scored.join(found, "rid", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(v.ends > 0))).cast("bigint").alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        (logs + F.lit(end_log) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("sequence") + F.col("within") + F.coalesce("more_logs", F.lit(0.0))).alias("score"),
    )
