"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level k holds chunk k of all ids that have
one; a bitmap beside it says which of them go on, and a rank directory over the bitmap (ones before
each block of 512 bits) says where in the next level they go on. So the token at any place is read
with one chunk, one bit and one rank for each level, without decoding what lies before it.

A file holds documents of one range of doc_id, in ascending order (null first), each with an
end id, and per document its first token's place. A range has as many files as its tokens need
(``FILE_TOKENS``); files follow each other in the order of ranges.

Layout, little-endian: ``CDAC0001``; int64 lengths of documents, tokens and levels; int64 doc_id
and int8 "is null" of each document; int64 places, one more than documents; then for each level
int64 chunks, the chunks (uint8), the bitmap (uint8, lowest bit first), the directory (uint32).

Reading goes through the directories: a document's tokens are found level by level from the ranks of its
first and last place, whatever lies before them.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; rows that
repeat are documents of their own; a document of any length is in one file; an empty table gives no file
and an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import map_arrow, materialize, partitions, scratch, slices
from .side import store

MAGIC = b"CDAC0001"
BLOCK = 512
END_ID = 0
#: Tokens with which a file is full; it ends with the document that reaches it.
FILE_TOKENS = 32 << 20

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def pack(doc_ids: list[int | None], places: np.ndarray, ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while len(rest) or not levels:
        chunks, more = (rest & 255).astype(np.uint8), rest > 255
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (BLOCK // 8)))
        ones = _ONES[bitmap].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(np.array([len(chunks)], "<i8").tobytes() + chunks.tobytes() + bitmap.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
    head = np.array([len(doc_ids), len(ids), len(levels)], "<i8").tobytes()
    known = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    null = np.array([x is None for x in doc_ids], "i1").tobytes()
    return b"".join([MAGIC, head, known, null, places.astype("<i8").tobytes(), *levels])


class TokenFile:
    """A file's bytes, addressed in place: ``[i]`` is any token, ``document(k)`` one document's."""

    def __init__(self, data: bytes):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        n_docs, self.n_tokens, n_levels = (int(x) for x in take("<i8", 3))
        known, null = take("<i8", n_docs), take("i1", n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(known, null, strict=True)]
        self.places = take("<i8", n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<i8", 1)[0])
            size = -(-n // BLOCK) * (BLOCK // 8)
            self.levels.append((take("u1", n), take("u1", size), take("<u4", size * 8 // BLOCK + 1)))

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for shift, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * shift)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            start = i // BLOCK * (BLOCK // 8)
            whole = int(_ONES[bitmap[start : i >> 3]].sum())
            i = int(directory[i // BLOCK]) + whole + int(_ONES[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
        raise ValueError("a token goes on past the last level")

    def _rank(self, level: int, i: int) -> int:
        """How many of the first i tokens of a level go on in the next one."""
        _, bitmap, directory = self.levels[level]
        ones = int(directory[i // BLOCK]) + int(_ONES[bitmap[i // BLOCK * (BLOCK // 8) : i >> 3]].sum())
        return ones + int(_ONES[bitmap[i >> 3] & ((1 << (i & 7)) - 1)]) if i & 7 else ones

    def between(self, a: int, b: int) -> np.ndarray:
        """The tokens at places a, ..., b - 1."""
        spans, found = [], []
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            more = np.unpackbits(bitmap[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 : (a & 7) + b - a].view(bool)
            spans.append((chunks[a:b], more))
            if not more.any():
                break
            a, b = self._rank(level, a), self._rank(level, b)
        for chunks, more in reversed(spans):
            value = chunks.astype("<u4")
            if len(found):
                value[more] |= found << np.uint32(8)
            found = value
        return found

    def ids(self) -> np.ndarray:
        """All tokens."""
        return self.between(0, self.n_tokens)

    def document(self, k: int) -> np.ndarray:
        return self.between(int(self.places[k]), int(self.places[k + 1]))


class _Writer:
    """Documents of one task, file by file."""

    def __init__(self, folder: str, part: int):
        (self.store, self.root), self.part, self.n = store(folder), part, 0
        self.clear()

    def clear(self) -> None:
        self.doc_ids, self.sizes, self.ids = [], [], []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        """Takes documents in; gives the row of a file if one is full."""
        self.doc_ids += doc_ids
        self.ids.append(ids)
        self.sizes.append(np.diff(ends, prepend=0))
        return self.write() if sum(map(len, self.ids)) >= FILE_TOKENS else None

    def write(self) -> pa.RecordBatch:
        places = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))])
        data = pack(self.doc_ids, places, np.concatenate(self.ids))
        name, draft = f"part-{self.part:06d}-{self.n:06d}.cdac", f"{self.root}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as out:
            out.write(data)
        self.store.move(draft, f"{self.root}/{name}")
        row = {"part": [self.part], "number": [self.n], "file": [name], "n_docs": [len(self.doc_ids)], "n_tokens": [int(places[-1])]}
        self.n += 1
        self.clear()
        return pa.RecordBatch.from_pydict(row)


def write_tokens(docs: DataFrame, folder: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Encode and write; returns a row for each file: part, number, file, n_docs, n_tokens, start (tokens in
    the files before it). A task that runs again replaces its files, each in one step, by equal ones."""

    def write(batches):
        encode, out = encoder(path).encode_batch, _Writer(folder, TaskContext.get().partitionId())
        for batch in batches:
            for some in slices(batch, 1, 2000):
                ids, ends = encode(some.column(1).to_pylist())
                ids = np.insert(ids, ends, end_id)
                if (row := out.add(some.column(0).to_pylist(), ids, ends + np.arange(1, len(ends) + 1))) is not None:
                    yield row
        if out.doc_ids:
            yield out.write()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = map_arrow(rows, write, "part long, number long, file string, n_docs long, n_tokens long")
    files = materialize(files, "token-files")
    ahead = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) and middle_id (the token at the place
    in the middle, read by itself) of each document."""

    def read(batches):
        for batch in batches:
            for data, base in zip(batch.column(0), batch.column(1), strict=True):
                f = TokenFile(data.as_buffer())
                sizes = np.diff(f.places)
                upto = np.searchsorted(f.places, np.arange(0, f.n_tokens, 1 << 18), side="left").tolist()
                for i, j in zip(upto, [*upto[1:], len(f.doc_ids)], strict=True):
                    at = f.places[i : j + 1]
                    if i < j:
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(f.doc_ids[i:j], pa.int64()),
                                "start": pa.array(at[:-1] + base.as_py(), pa.int64()),
                                "n_tokens": pa.array(sizes[i:j], pa.int64()),
                                "ids": pa.array([f.document(k).tobytes() for k in range(i, j)], pa.binary()),
                                "middle_id": pa.array([f[int(a + n // 2)] for a, n in zip(at, sizes[i:j], strict=False)], pa.int64()),
                            }
                        )

    spark = files.sparkSession
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.cdac").load(folder)
    stored = stored.select("content", F.element_at(F.split("path", "/"), -1).alias("file"))
    stored = stored.join(files.select("file", "start"), "file").select("content", "start")
    return map_arrow(stored, read, "doc_id long, start long, n_tokens long, ids binary, middle_id long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "middle_id")
