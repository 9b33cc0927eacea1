"""Language identification as multilingual mixture inference.

Model: hashed character trigrams (a non-letter counts as a word edge) have one smoothed distribution per language, from
counts over all training rows; a further component, uniform over the buckets, stands for noise. A document's segments
are its words (cut after SEGMENT letters where a script has no word edges); expectation-maximisation over them estimates
the share of each language. The language set is the prefix of the languages, ranked by share, whose log-likelihood
less PENALTY * log(trigrams) / 2 a language is best, tried up to where no larger set can be better; the prediction is its language of largest share.

Defined results: null texts and texts without a letter give `und`, score 0 and no languages; without any training row
every document does. Ties go to the language first in code point order. Rows are independent of each other, so repeated
rows repeat their result. The model's size is bounded by BUCKETS times the number of languages, however many documents.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm._common import U64, mix, released, slices

BUCKETS = 1 << 16
SMOOTHING = 0.5
SEGMENT = 32
ROUNDS = 8
PENALTY = 4.0
SLICE = 1_000_000


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the letters of some texts: bucket, row, whether it begins a segment; and of each row, its letters."""
    rows = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")).to_pylist()
    codes = np.frombuffer(("\n" + "\n".join(rows) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool), np.zeros(len(rows), np.int64)
    c = np.where(letter, codes, 32).astype(U64)
    with np.errstate(over="ignore"):
        bucket = (mix(c[at - 1] * U64(0x9E3779B97F4A7C15) + c[at] * U64(0xC2B2AE3D27D4EB4F) + c[at + 1] * U64(0x165667B19E3779F9)) >> U64(48)).astype(np.int32)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in rows), dtype=np.int64, count=len(rows)))
    counts = np.diff(np.r_[0, np.searchsorted(at, ends, side="right")])
    first = ~letter[at - 1]
    begins = np.flatnonzero(first)
    inside = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
    return bucket, np.repeat(np.arange(len(rows), dtype=np.int32), counts), inside % SEGMENT == 0, counts


def count(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows that have a language."""
    rows = docs.select(docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where("lang is not null and text is not null")

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for name, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
            sums.clear()

        for whole in batches:
            for batch in slices(whole, chars=SLICE):
                bucket, row, _, _ = trigrams(batch.column("text"))
                names = batch.column("lang").dictionary_encode()
                code = np.asarray(names.indices)[row]
                for k, name in enumerate(names.dictionary.to_pylist()):
                    if name not in sums:
                        if len(sums) >= 64:
                            yield from flush()
                        sums[name] = np.zeros(BUCKETS, np.int64)
                    sums[name] += np.bincount(bucket[code == k], minlength=BUCKETS)
        yield from flush()

    return rows.mapInArrow(released(run), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probability of each bucket in each of them and in the noise component)."""
    table = count(docs, text, lang).toArrow()  # languages times BUCKETS rows at most
    names = sorted(set(table["lang"].to_pylist()))
    n = np.zeros((BUCKETS, len(names)))
    if names:
        place = {name: k for k, name in enumerate(names)}
        encoded = table["lang"].combine_chunks().dictionary_encode()
        column = np.array([place[x] for x in encoded.dictionary.to_pylist()])[np.asarray(encoded.indices)]
        n[table["bucket"].to_numpy(), column] = table["n"].to_numpy()
    names_p = np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * BUCKETS))
    return names, np.concatenate([names_p, np.full((BUCKETS, 1), -np.log(BUCKETS))], axis=1).astype(np.float32)


def infer(texts: pa.Array, names: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """(prediction, its share, languages with shares, noise share) of each text."""
    bucket, row, begins, letters = trigrams(texts)
    n, k = len(texts), len(names)
    if not len(bucket) or not k:
        return ["und"] * n, np.zeros(n), [""] * n, np.zeros(n)
    starts = np.flatnonzero(begins)
    like = np.add.reduceat(model[bucket], starts, axis=0).astype(np.float64)  # segments x components
    owner = row[starts]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    at = owner[heads]  # rows that have letters
    local = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(owner)]))
    size = np.diff(np.r_[heads, len(owner)])[:, None]
    top = like.max(axis=1)
    p = np.exp(like - top[:, None]).astype(np.float32)
    base = np.add.reduceat(top, heads)

    def em(share: np.ndarray, rounds: int, p=p, local=local, heads=heads, size=size, base=base) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            r = p * share[local]
            total = r.sum(axis=1)
            r /= np.maximum(total, 1e-30)[:, None]
            share = (np.add.reduceat(r, heads, axis=0) / size).astype(np.float32)
        total = (p * share[local]).sum(axis=1)
        return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)).astype(np.float64), heads) + base

    full, _ = em(np.full((len(heads), k + 1), 1 / (k + 1), np.float32), ROUNDS)
    whole = np.add.reduceat(like[:, :k], heads, axis=0)
    order = np.lexsort((np.arange(k)[None, :].repeat(len(heads), 0), -whole, -full[:, :k]), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(k)[None, :], axis=1)
    cost = PENALTY * np.log(np.maximum(letters[at], 2)) / 2
    best, best_share = np.full(len(heads), -np.inf), np.zeros((len(heads), k + 1))
    left, part = np.arange(len(heads)), (p, local, heads, size, base)  # rows that a larger set may fit better, their segments
    for m in range(1, k + 1):
        # No set explains a segment better than its best component does.
        rise = base[left] + 1e-6 * size[left, 0] - m * cost[left] > best[left]
        if not rise.any():
            break
        if not rise.all():
            left = left[rise]
            inside = np.isin(local, left)
            count = size[left, 0]
            part = p[inside], np.repeat(np.arange(len(left)), count), np.cumsum(count) - count, size[left], base[left]
        share = np.where(np.c_[rank[left] < m, np.ones(len(left), bool)], np.maximum(full[left], 1e-6), 0)
        share, value = em((share / share.sum(axis=1, keepdims=True)).astype(np.float32), ROUNDS // 2, *part)
        value = value - m * cost[left]
        better = value > best[left]
        best[left] = np.where(better, value, best[left])
        best_share[left[better]] = share[better]
    first = np.lexsort((np.arange(k)[None, :].repeat(len(heads), 0), -whole, -best_share[:, :k]), axis=1)[:, 0]
    pred, score, listed, noise = ["und"] * n, np.zeros(n), [""] * n, np.zeros(n)
    score[at] = np.clip(best_share[np.arange(len(heads)), first], 0, 1)
    noise[at] = best_share[:, k]
    for j, r in enumerate(at):
        pred[r] = names[first[j]]
        listed[r] = ",".join(f"{names[c]}:{best_share[j, c]:.4f}" for c in np.argsort(-best_share[j, :k], kind="stable") if best_share[j, c] >= 0.005)
    return pred, score, listed, noise


MADE = {"lang_pred": pa.string(), "score": pa.float64(), "languages": pa.string(), "noise": pa.float64()}


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The kept columns, then lang_pred, score, languages and noise, each with the prefix, which the caller sets where names clash."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    chosen = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(f"{prefix}text_"))
    schema = chosen.select(*chosen.columns[:-1]).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("languages", "string"), ("noise", "double")):
        schema = schema.add(prefix + name, kind)

    def run(batches):
        names, table = sent.value
        for whole in batches:
            for batch in slices(whole, f"{prefix}text_", SLICE):
                made = infer(batch.column(len(keep)), names, table)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(x, kind) for x, kind in zip(made, MADE.values(), strict=True))], names=[*keep, *(prefix + x for x in MADE)])

    return chosen.mapInArrow(released(run), schema)


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The documents in which a language was found, all columns as they came."""
    prefix = "langid_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    out = predict(docs, model, keep=tuple(docs.columns), prefix=prefix)
    return out.where(F.col(prefix + "lang_pred") != "und").select(*docs.columns)
