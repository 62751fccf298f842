"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are level 0. To go up a level, runs of one name become one name; then
deterministic coin tossing colours the names: each name's label becomes the place and value of the
lowest bit in which it differs from the name before it, until six labels are left, then three.
Landmarks are the local maxima of the labels and the local minima that stand apart from them. A
phrase goes from one landmark to the next, two or three names as a rule, and its name is a digest
of the names in it. Where phrases begin depends on a few names to either side only, so equal
substrings get equal names inside, whatever their offset; phrases of level k have about 2.4**k bytes.

The fingerprint is the name of the whole text (the level at which one phrase is left), a colon,
and a sketch: minima of independent hashes over the phrase names of level 2 (24 slots) and of
levels 3 and 4 (40 slots), 16 bits of each in hexadecimal. The likeness of two fingerprints is the
share of equal slots; 1 if the whole texts' names are equal.

The texts of a batch, which is bounded by bytes, are parsed at once with array operations.

Defined cases: null and empty texts have the name 0 and are like each other only; a null doc_id
sorts after all others; rows that repeat follow each other, those of one doc_id by their texts; the only row
of a table is its own next one; texts of any length are parsed whole; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, partitions, slices

#: Slots of the sketch by the levels that fill them.
SLOTS = (((2,), 24), ((3, 4), 40))
N_SLOTS = sum(n for _, n in SLOTS)
EMPTY = "0" * 16 + ":" + "f" * (4 * N_SLOTS)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_KEYS = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, (N_SLOTS, 2), dtype=np.uint64) | _U(1)
_LOW_BIT = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """Murmur's finalizer: every bit of the name depends on every bit of the input."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing. first: where a text begins; there a name is compared with itself
    but for the lowest bit. Neighbours differ before and after."""
    differ = np.empty_like(names)
    differ[1:] = names[1:] ^ names[:-1]
    differ[first] = 1
    if names.dtype == np.uint8:
        low = _LOW_BIT[differ]
    else:
        low = ((differ & (~differ + _U(1))).astype(np.float64).view(np.int64) >> 52) - 1023
    return (2 * low + ((names >> low.astype(names.dtype)) & names.dtype.type(1))).astype(np.uint8)


def _landmarks(names: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where phrases begin, for names of which no two neighbours are equal."""
    label = _labels(names, first)
    for _ in range(3 if names.dtype != np.uint8 else 2):
        label = _labels(label, first)
    while label.max(initial=0) > 5:
        label = _labels(label, first)
    none = np.uint8(9)
    before, after = np.empty_like(label), np.empty_like(label)
    for colour in (5, 4, 3):  # never neighbours, so all change at once
        at = np.flatnonzero(label == colour)
        before[1:], after[:-1] = label[:-1], label[1:]
        before[first], after[last] = none, none
        b, a = before[at], after[at]
        new = np.zeros(len(at), np.uint8)
        new[(b == 0) | (a == 0)] = 1
        new[((b == 0) & (a == 1)) | ((b == 1) & (a == 0))] = 2
        label[at] = new
    before[1:], after[:-1] = label[:-1], label[1:]
    before[first], after[last] = none, none  # a text's ends are no maxima
    top = (label > before) & (label > after)
    apart = np.ones(len(label), bool)
    apart[1:] &= ~top[:-1]
    apart[:-1] &= ~top[1:]
    start = top | ((label < before) & (label < after) & apart)
    start[np.minimum(first + 1, last)] = False  # the first phrase has two names at least
    start[first] = True
    return start


def levels(data: np.ndarray, firsts: np.ndarray):
    """Yields (names, first index of each text) of levels 1, 2, ... until each text is one phrase.
    data: bytes of texts that are not empty, one after another; firsts: where each begins."""
    names, first = data, firsts
    while True:
        is_first = np.zeros(len(names), bool)
        is_first[first] = True
        run = is_first.copy()
        run[1:] |= names[1:] != names[:-1]
        at = np.flatnonzero(run)
        length = np.diff(at, append=len(names))
        kept = names[at]
        first = np.cumsum(run)[first] - 1
        last = np.append(first[1:], len(at)) - 1
        start = np.flatnonzero(_landmarks(kept, first, last))
        long = kept.astype(np.uint64) + (length - 1).astype(np.uint64) * _BASE
        # a phrase's digest: its names by their places in it
        place = (np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))).astype(np.uint64)
        old, was = names, at[first]
        names = _mix(np.add.reduceat(_mix(long + _BASE) * (place * _U(2) + _U(3)), start))
        first = np.searchsorted(start, first)
        if old.dtype != np.uint8:  # what is one phrase already keeps its name, whatever it is parsed with
            done = np.diff(was, append=len(old)) == 1
            names[first[done]] = old[was[done]]
        yield names, first
        if len(names) == len(first):
            return


def sketch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(names of the whole texts, sketches) for texts in UTF-8."""
    size = np.array([len(t) for t in texts], np.int64)
    root, slots = np.zeros(len(texts), np.uint64), np.full((len(texts), N_SLOTS), 0xFFFF, np.uint16)
    full = np.flatnonzero(size)
    if not len(full):
        return root, slots
    data = np.frombuffer(b"".join(texts), np.uint8)
    firsts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
    lowest = np.full((N_SLOTS, len(full)), 2**64 - 1, np.uint64)
    at = 0
    wanted = [(k, n) for k, n in SLOTS]
    top = max(k for ks, _ in SLOTS for k in ks)
    level = 0
    for level, (names, first) in enumerate(levels(data, firsts), 1):
        at = 0
        for ks, n in wanted:
            if level in ks:
                salted = _mix(names + _U(level))
                for s in range(at, at + n):
                    np.minimum(lowest[s], np.minimum.reduceat((salted ^ _KEYS[s, 0]) * _KEYS[s, 1], first), out=lowest[s])
            at += n
    while level < top:  # short texts end below: their one phrase stands for the levels above
        level, at = level + 1, 0
        for ks, n in wanted:
            if level in ks:
                salted = _mix(names + _U(level))
                for s in range(at, at + n):
                    lowest[s] = np.minimum(lowest[s], (salted ^ _KEYS[s, 0]) * _KEYS[s, 1])
            at += n
    # a text ends on a level of its own: hash the last names with the sizes
    root[full] = _mix(names ^ _mix(size[full].astype(np.uint64))) | _U(1)
    slots[full] = (_mix(lowest.T.copy()) >> _U(48)).astype(np.uint16)
    return root, slots


def text_of(root: np.ndarray, slots: np.ndarray) -> list[str]:
    raw = slots.astype(">u2").tobytes().hex()
    width = 4 * N_SLOTS
    return [f"{int(r):016x}:{raw[i * width : (i + 1) * width]}" for i, r in enumerate(root)]


def likeness(root_a, slots_a, root_b, slots_b) -> np.ndarray:
    same = (slots_a == slots_b).mean(axis=1)
    return np.where(root_a == root_b, 1.0, np.where((root_a == 0) | (root_b == 0), 0.0, same))


def likeness_of(a: str, b: str) -> float:
    """Of two fingerprints as strings."""
    x, y = (np.array([int(s[:16], 16)], np.uint64) for s in (a, b))
    p, q = (np.frombuffer(bytes.fromhex(s[17:]), ">u2")[None] for s in (a, b))
    return float(likeness(x, p, y, q)[0])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, 1, 1000):
                got = text_of(*sketch([(x.as_py() or "").encode("utf-8") for x in some.column(1)]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(got, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return map_arrow(rows, run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ghost, key, doc_id, text) in partitions in which every document is followed by
    the next one in descending doc_id, the last by the first: documents are dealt out by ranges of
    doc_id, and the head of each range is sent to the end of the range before it as well."""
    spark = docs.sparkSession
    n = partitions(spark)
    lowest = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = [k / n for k in range(1, n)] + [1.0]
    found = rows.agg(F.percentile_approx("key", F.lit(cuts).cast("array<double>"), F.lit(10000)).alias("b"), F.max("key").alias("m")).first()
    # upper ends of the ranges: keys that occur, as many as partitions at most
    ends = np.array(sorted({*(found.b or []), found.m} - {None}), np.int64)

    @F.pandas_udf("array<struct<bucket: int, ghost: boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(ends, keys.to_numpy())
        # the head of a range (its greatest key) follows the last document of the next higher range
        return pd.Series(
            [[{"bucket": b, "ghost": False}] + ([{"bucket": (b + 1) % len(ends), "ghost": True}] if ends[b] == k else []) for b, k in zip(at.tolist(), keys, strict=True)]
        )

    rows = rows.withColumn("place", F.explode(places("key"))).select("place.bucket", "place.ghost", "key", "doc_id", "text")
    return rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col("key").desc(), "text")


def _together(rows: list[tuple], most: int = 500, size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Parts of rows (doc_id, text, next text) of so many characters, one row at least."""
    some, n = [], 0
    for row in rows:
        if some and (len(some) == most or n + len(row[1]) > size):
            yield some
            some, n = [], 0
        some.append(row)
        n += len(row[1])
    if some:
        yield some


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to that and to the
    next document: see ``query``."""

    def run(batches):
        held = None  # (bucket, doc_id, text) that waits for its next one
        for batch in batches:
            buckets, ghosts, _, ids, texts = (c.to_pylist() for c in batch.columns)
            ready = []
            for bucket, ghost, doc_id, text in zip(buckets, ghosts, ids, texts, strict=True):
                if held and held[0] == bucket:
                    ready.append((held[1], held[2], text or ""))
                held = None if ghost else (bucket, doc_id, text or "")
            for some in _together(ready):
                edited = [t[: len(t) - len(t) // 3] + following[: len(t) // 3] for _, t, following in some]
                raw = [e.encode("utf-8") for e in edited]
                # a document's next one is the following row's own text, but for the last row
                both = [t.encode("utf-8") for _, t, _ in some] + [some[-1][2].encode("utf-8")]
                root, slots = sketch(both + raw)
                k = len(some)
                prints, edited_prints = text_of(root[:k], slots[:k]), text_of(root[k + 1 :], slots[k + 1 :])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([x for x, _, _ in some], pa.int64()),
                        "n_chars": pa.array([len(t) for _, t, _ in some], pa.int64()),
                        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in raw],
                        "fingerprint": prints,
                        "edited_fingerprint": edited_prints,
                        "near_edited": likeness(root[:k], slots[:k], root[k + 1 :], slots[k + 1 :]),
                        "near_next": likeness(root[:k], slots[:k], *_following(some, root, slots)),
                    }
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(with_next(docs), run, schema)


def _following(some, root, slots):
    """Fingerprints of each row's next document, from those of the rows; computed where a range ends
    between two rows."""
    k = len(some)
    root, slots = root[1 : k + 1].copy(), slots[1 : k + 1].copy()
    odd = [i for i in range(k - 1) if some[i][2] != some[i + 1][1]]
    if odd:
        root[odd], slots[odd] = sketch([some[i][2].encode("utf-8") for i in odd])
    return root, slots


def query(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
