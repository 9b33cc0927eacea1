"""Token-id files of directly addressable codes.

An id is cut into chunks of CHUNKS bits, lowest first. Level 0 holds the first chunk of every id; a level's bitmap says
which of its entries go on in the next level, and a rank directory (ones before each block of RANK bits) tells where.
Any id is found with one rank look-up per level, without decoding its neighbours.

A file holds the documents of one range of doc_id in ascending order (equal doc_ids by a hash of the text, then by their
place in the input, so that one doc_id may hold any share of the rows): MAGIC, a header of 64-bit
integers (documents, ids, levels), doc_ids, their null flags, first id of each document, then for each level its
entries, bitmap and rank directory. Files are written by tasks under names of their own attempt; the manifest, which
Spark commits, names the files that count, so a task that is run again does no harm.

Documents are read back by address: a span of ids takes one rank look-up per level, for where it begins there.

Null texts count as empty; every document ends with ``end_id``. Null doc_ids come first. Empty tables give no files and
no rows; extra columns take no part.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm._common import Recent, materialise, released, shared_dir, slices
from docassay.llm.bpe import byte_letters, ids_of

MAGIC = b"DACIDS1\n"
#: Bits of each level; the last level takes what is left of 32 bits.
CHUNKS = (8, 8, 16)
#: Bits to a block of the rank directory.
RANK = 512
#: Bytes, about, of a worker's cache of chunks; it goes at the end of a task.
CACHE = 160_000_000


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entries, packed bitmap, rank directory) of each level."""
    rest, levels = ids.astype(np.uint32), []
    for bits in CHUNKS:
        kind = np.uint8 if bits <= 8 else np.uint16
        more = (rest >> np.uint32(bits)) > 0
        levels.append(((rest & np.uint32((1 << bits) - 1)).astype(kind), np.packbits(more, bitorder="little"), np.r_[0, np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK), dtype=np.int64) if len(more) else [])].astype("<u8")))
        rest = rest[more] >> np.uint32(bits)
        if not len(rest):
            break
    return levels


class Codes:
    """One file's ids: all of them, a range, or a single one."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        docs, total, levels = struct.unpack_from("<3q", raw, 8)
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.total = total
        self.doc_ids, self.nulls, self.first = take("<i8", docs), take("u1", docs), take("<u8", docs + 1).astype(np.int64)
        self.levels, n = [], total
        for k in range(levels):
            entries = take("u1" if CHUNKS[k] <= 8 else "<u2", n)
            bitmap, ranks = take("u1", -(-n // 8)), take("<u8", -(-n // RANK) + 1)
            self.levels.append((entries, bitmap, ranks))
            n = int(ranks[-1])

    def rank(self, level: int, i: int) -> int:
        """Entries before the i-th of a level that go on in the next one."""
        _, bitmap, ranks = self.levels[level]
        block = i // RANK
        whole, rest = bitmap[block * RANK // 8 : i >> 3], i & 7
        return int(ranks[block]) + int(np.bitwise_count(whole).sum()) + (int(bitmap[i >> 3] & ((1 << rest) - 1)).bit_count() if rest else 0)

    def one(self, i: int) -> int:
        """The i-th id."""
        out = shift = 0
        for k, ((entries, bitmap, _), bits) in enumerate(zip(self.levels, CHUNKS, strict=False)):
            out |= int(entries[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self.rank(k, i), shift + bits
        return out

    def span(self, a: int, b: int) -> np.ndarray:
        """The ids from the a-th to before the b-th: their entries stand together in every level."""
        out, where, shift = np.zeros(b - a, dtype=np.uint32), slice(None), 0
        for k, ((entries, bitmap, _), bits) in enumerate(zip(self.levels, CHUNKS, strict=False)):
            out[where] |= entries[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.flatnonzero(np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a])
            if not len(more):
                break
            a = self.rank(k, a)
            b, shift = a + len(more), shift + bits
            where = more if isinstance(where, slice) else where[more]
        return out

    def all(self) -> np.ndarray:
        out, where, shift = np.zeros(self.total, dtype=np.uint32), None, 0
        for (entries, bitmap, _), bits in zip(self.levels, CHUNKS, strict=False):
            part = entries.astype(np.uint32) << np.uint32(shift)
            more = np.flatnonzero(np.unpackbits(bitmap, bitorder="little", count=len(entries)))
            if where is None:
                out |= part
                where = more
            else:
                out[where] |= part
                where = where[more]
            shift += bits
        return out


def dump(doc_ids: np.ndarray, nulls: np.ndarray, first: np.ndarray, ids: np.ndarray) -> list[bytes]:
    levels = encode_levels(ids)
    out = [MAGIC, struct.pack("<3q", len(doc_ids), len(ids), len(levels)), doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), first.astype("<u8").tobytes()]
    for entries, bitmap, ranks in levels:
        out += [entries.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return out


class LibraryEncoder:
    """Ids of white-space-parted chunks by the tokenizers library, behind a bounded cache.

    No pre-token of such a file crosses white space. For chunks of Latin letters the normaliser and the pre-tokeniser
    leave one lower-case pre-token, which goes to the library's model at once; all others take its whole encode().
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.latin = str.maketrans({chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)})
        self.recent = Recent(CACHE)
        self.mark = {s: [t.id for t in self.model.tokenize(s)] for s in ".,"}

    def chunk(self, chunk: str) -> bytes:
        if (out := self.recent.get(chunk)) is None:
            body = chunk[:-1] if chunk[-1:] in (".", ",") else chunk
            if body.isalpha() and max(body) < "\u0250" and "\u0130" not in body:
                ids = [t.id for t in self.model.tokenize(body.lower().translate(self.latin))]
                if body is not chunk:
                    ids += self.mark[chunk[-1]]
            else:
                ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            out = self.recent.put(chunk, array("I", ids).tobytes())
        return out


@functools.cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to every document."""
    counts = np.diff(offsets) + 1
    ends = np.r_[0, np.cumsum(counts)].astype(np.int64)
    out = np.full(int(ends[-1]), end_id, dtype=np.uint32)
    place = np.ones(len(out), dtype=bool)
    place[ends[1:] - 1] = False
    out[place] = ids
    return out, ends


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, file_chars: int = 64_000_000) -> DataFrame:
    """Encode doc_id and text into files below folder; the manifest: path, first_id, null_first, docs, ids.

    A partition of the range over doc_id starts another file after file_chars of text, so a task holds no more than that.
    """
    keys = ["doc_id", "hash", "place"]
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        chunk = encoder(path).chunk
        kept: list[tuple] = []
        size = 0

        def close():
            doc_ids, nulls = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
            ids, counts = np.concatenate([k[2] for k in kept]), np.concatenate([np.diff(k[3]) for k in kept])
            name = f"{base}/{uuid.uuid4().hex}.dac"
            with files.open_output_stream(name) as out:
                for part in dump(doc_ids, nulls, np.r_[0, np.cumsum(counts)], ids):
                    out.write(part)
            return pa.RecordBatch.from_pydict({"path": [name], "first_id": pa.array([int(doc_ids[0])], pa.int64()), "null_first": [bool(nulls[0])], "docs": [len(doc_ids)], "ids": [len(ids)]})

        order = 0
        for whole in batches:
            for batch in slices(whole):
                ids, offsets = with_end(*ids_of(batch.column("text"), chunk), end_id)
                column = batch.column("doc_id")
                kept.append((np.asarray(column.fill_null(0)), np.asarray(column.is_null()), ids, offsets))
                size += batch.nbytes
                if size >= file_chars:
                    yield close().append_column("piece", pa.array([order], pa.int64()))
                    kept, size, order = [], 0, order + 1
        if kept:
            yield close().append_column("piece", pa.array([order], pa.int64()))
        encoder(path).recent.clear()

    made = ordered.mapInArrow(released(run), "path string, first_id bigint, null_first boolean, docs bigint, ids bigint, piece bigint")
    return made.withColumn("part", F.spark_partition_id())


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in a manifest's files."""
    spark = manifest.sparkSession
    # One row for each file of a range partition: their number is that of tasks, not of documents.
    rows = sorted(manifest.collect(), key=lambda r: (r["part"], r["piece"]))
    starts = np.r_[0, np.cumsum([r["ids"] for r in rows], dtype=np.int64)] if rows else np.zeros(1, dtype=np.int64)
    listed = spark.createDataFrame([(r["path"], int(s)) for r, s in zip(rows, starts, strict=False)], "path string, base bigint")

    def run(batches):
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.open_input_file(path) as f:
                    codes = Codes(f.read())
                first = codes.first
                crc = [zlib.crc32(codes.span(a, b).astype("<u4", copy=False)) for a, b in itertools.pairwise(first.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(codes.doc_ids, mask=codes.nulls.astype(bool)), pa.array(first[:-1] + base), pa.array(np.diff(first)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, len(rows))).mapInArrow(released(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids, then read them back from the files."""
    folder = shared_dir(docs.sparkSession, "token-ids")
    return read(materialise(write(docs, path, folder, end_id), "token-manifest"), folder)
