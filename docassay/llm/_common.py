"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows taken from one Arrow batch at a time, so that a worker's memory follows this and not the batch.
SLICE_CHARS = 8_000_000
U64 = np.uint64


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docassay-")
        atexit.register(shutil.rmtree, folder, True)
        base = "file://" + folder
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it again: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialise wrote for frames that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(column: str, modulus: int):
    """crc32 of a column as text, modulo; a null counts as an empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS):
    """Cut a batch so that no slice holds much over so many bytes of a string column; one longer value stands alone."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    piece = np.cumsum(sizes) // chars
    starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


class Recent:
    """A cache bounded in bytes: two generations, of which the older one goes when the newer one is half the bound."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.new, self.old, self.held = {}, {}, 0

    def get(self, key: str) -> bytes | None:
        out = self.new.get(key)
        if out is None and (out := self.old.get(key)) is not None:
            self.put(key, out)
        return out

    def put(self, key: str, value: bytes) -> bytes:
        cost = 250 + 2 * len(key) + len(value)  # what the objects and their places in a table take, about
        if cost < 2_000:
            if self.held + cost > self.size // 2:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[key] = value
            self.held += cost
        return value


@functools.cache
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library than glibc
        return None


def released(run: Callable) -> Callable:
    """A task that hands its free memory back at its end: Python workers live on, and other operators run beside them."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _trim():
            _trim()(0)

    return wrapped


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, distinct words, first word of each row and the total) of texts cut at ASCII white space; null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    encoded = flat.dictionary_encode()
    codes = np.asarray(encoded.indices)
    empty = np.flatnonzero(np.asarray(pc.equal(encoded.dictionary, "")))
    if len(empty):  # before a leading and after a trailing white space
        keep = codes != empty[0]
        offsets = np.r_[0, np.cumsum(keep)][offsets]
        codes = codes[keep]
    return codes, encoded.dictionary, offsets


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit xxhash of each distinct word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in words.to_pylist()), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
