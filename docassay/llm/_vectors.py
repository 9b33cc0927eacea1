"""What the two vector searches share: clean vectors, written chunks of queries, blocks of rows, best-k tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm._common import materialise, released

#: Queries that are looked up at a time, and rows that are indexed at a time.
CHUNK = 8_192
ROWS = 65_536


def clean(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part; rows of zeros do if zero is set."""
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    if not zero:
        good = good & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & good)


def matrix(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, places) by number of components; vectors of different length are not comparable."""
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ids, sizes = np.asarray(table.column("vec_id")), np.asarray(pc.list_value_length(column))
    places = np.asarray(table.column("place")) if "place" in table.schema.names else np.zeros(len(ids), np.int64)
    flat, ends = np.asarray(column.flatten()), np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    out = {}
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[int(n)] = ids[at], flat[ends[at][:, None] + np.arange(n)], places[at]
    return out


def query_files(queries: DataFrame) -> list[str]:
    """The queries, written to the shared folder in files of some CHUNK rows."""
    n = max(1, -(-queries.count() // CHUNK))
    return materialise(queries.repartition(n, "vec_id", "place"), "queries").inputFiles()


def chunks_of(files: list[str]) -> Iterator[pa.Table]:
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(CHUNK):
                yield pa.Table.from_batches([batch])


def row_blocks(batches, rows: int = ROWS) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class Best:
    """The k best (score, id) of each query; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, k: int, kind=np.float64, places: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.places = np.zeros(len(queries), np.int64) if places is None else places
        self.low = np.iinfo(np.int64).min if kind == np.int64 else -np.inf
        self.score = np.full((len(queries), k), self.low, dtype=kind)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def worst(self, a: int, b: int):
        return self.score[a:b, -1].min()

    def offer(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        keep = (score >= self.score[i, -1]) & (ids != self.queries[i])
        if keep.any():
            score, ids = np.r_[self.score[i], score[keep]], np.r_[self.id[i], ids[keep]]
            order = np.lexsort((ids, -score if score.dtype.kind == "f" else ~score))[: self.k]
            self.score[i], self.id[i] = score[order], ids[order]

    def batch(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.id != np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(self.queries[i]), pa.array(self.places[i]), pa.array(self.id[i, j]), pa.array(self.score[i, j])], names=["query_id", "place", "vec_id", "score"])


def search(rows: DataFrame, queries: DataFrame, k: int, kind: str, index: Callable, look: Callable) -> DataFrame:
    """query_id, rank, vec_id, score. Each task indexes its rows block by block, once, and lets all chunks of the queries
    pass: look(index(block), chunk) gives the best of a block, Spark the best of all. Rows are read once, and the plan is
    the same however many queries there are. Queries are distinct (vec_id, v); place tells those of one vec_id apart."""
    files = query_files(queries.withColumn("place", F.xxhash64("v")))

    def run(batches):
        for block in row_blocks(batches):
            made = index(block)
            for chunk in chunks_of(files):
                for best in look(made, chunk):
                    yield best.batch()

    found = rows.mapInArrow(released(run), f"query_id bigint, place bigint, vec_id bigint, score {kind}")
    order = Window.partitionBy("query_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
