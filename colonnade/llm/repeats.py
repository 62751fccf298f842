"""Removing repeated substrings with suffix arrays of shards.

A window is a string of ``LENGTH`` bytes at a place of a text. It repeats if an equal one starts
earlier: in a document with a smaller doc_id, or earlier in the same one. All bytes of repeating
windows go.

Every window has an anchor: the leftmost of its ``GRAM``-byte grams with the smallest digest. Equal
windows have equal anchors at equal places, so anchors that occur once in the corpus, most of them,
need no sorting. Texts around the others, fragments, go to shards by their anchor's digest; equal
fragments are one. Each shard sorts its suffixes by induced sorting; windows next to each other
whose permuted common prefix reaches LENGTH are equal, and all but the first of them repeat.

1. Copies: of equal texts all but the first repeat as a whole, and leave.
2. Anchors are counted: their digests, made distinct per block of rows, meet by digest, and each block gets
   back those that are repeated.
3. Fragments around anchors seen twice are sent to shards. An anchor with very many different
   fragments (where a passage in a third of all documents begins) would bring them all to one shard; its
   windows go one by one by their own digests, so only equal ones, which are merged per block, meet.
4. Shards are sorted, and the repeating windows noted by file and row.
5. Texts are cut.

Texts are never shuffled: steps 2, 3 and 5 read them where they are, and look up what the other
steps found about the file they read in the shared folder.

Defined cases: null and empty texts have no byte; texts shorter than LENGTH are left as they are;
a null doc_id comes after all others; rows with equal doc_id are in the order of files and rows;
texts of any length are read whole; an empty table gives an empty result; other columns are not read,
whatever their names (a frame that has a column ``_metadata`` or is no plain file scan is written first).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, map_arrow, materialize, partitions
from .side import get, put
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 100, 50
#: Rows of a block, whose anchors and fragments are made distinct together.
BLOCK = 1024
#: An anchor with more fragments than this, those of each block made distinct, is dealt out window by window.
MANY = 32768
#: Bytes of text for which there is a shard: bounds what a task sorts at once.
PER_SHARD = 2 << 20
#: Bytes of whole texts that are digested at once, and windows of one text.
_TOGETHER, _CHUNK = 1 << 20, 1 << 23

_U = np.uint64
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = [np.random.Generator(np.random.PCG64(90 + k)).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1) for k in (0, 1)]
_PLACE = _U((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Digests:
    """Digests of substrings of some bytes, from prefix sums of a polynomial modulo 2**64."""

    _up: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
    _down: list[np.ndarray] = [np.ones(1, np.uint64)] * 2

    def __init__(self, data: np.ndarray, k: int = 0):
        n = len(data) + 1
        if len(self._up[k]) < n:
            size = 1 << n.bit_length()
            back = pow(_STEPS[k], -1, 2**64)
            for to, x in ((self._up, _STEPS[k]), (self._down, back)):
                to[k] = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(x))]), dtype=np.uint64)
        self.k = k
        self.sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[k][data] * self._up[k][: n - 1], dtype=np.uint64)])

    def of(self, start, end) -> np.ndarray:
        shift = self._down[self.k][start]
        return _mix((self.sums[end] - self.sums[start]) * shift)


def _parts(ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about ``_TOGETHER`` bytes, one text at least."""
    out, a = [], 0
    while a < len(ends):
        begin = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + _TOGETHER, side="right")))
        out.append((a, b))
        a = b
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, anchor, first, count): the runs of neighbouring windows with one anchor, in order.
    data: texts one after another, ``ends`` where each ends. A run lies in one text."""
    found = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for a, b in _parts(ends):
        begin = int(ends[a - 1]) if a else 0
        digest, anchor, first, count = _anchors(data[begin : int(ends[b - 1])], ends[a:b] - begin)
        found.append((digest, anchor + begin, first + begin, count))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def substring_digests(data: np.ndarray, ends: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two independent digests of substrings, each within one text."""
    out = [np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)]
    for a, b in _parts(ends):
        begin, stop = int(ends[a - 1]) if a else 0, int(ends[b - 1])
        mine = np.flatnonzero((start >= begin) & (start < stop))
        for k in (0, 1):
            out[k][mine] = Digests(data[begin:stop], k).of(start[mine] - begin, end[mine] - begin)
    return out


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), none, none, none
    digests = Digests(data)
    n, wide = len(data), LENGTH - GRAM + 1
    gram = digests.of(slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    at = np.empty(n - LENGTH + 1, np.int64)
    for begin in range(0, len(at), _CHUNK):
        some = gram[begin : min(begin + _CHUNK, len(at)) + wide - 1]
        # the place below the digest: of equal digests the leftmost is the smallest
        low, span = (some & ~_PLACE) | np.arange(len(some), dtype=np.uint64), 1
        while span * 2 <= wide:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        at[begin : begin + len(low)] = (low & _PLACE).astype(np.int64) + begin
    whole = np.ones(len(at), bool)  # windows within one text
    for e in ends[:-1].tolist():
        whole[max(0, e - LENGTH + 1) : e] = False
    fresh = np.empty(len(at), bool)
    fresh[0] = True
    fresh[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    fresh[ends[:-1][ends[:-1] < len(at)]] = True
    first = np.flatnonzero(fresh)
    count = np.diff(first, append=len(at))
    keep = whole[first]
    first, count = first[keep], count[keep]
    anchor = at[first]
    return gram[anchor], anchor, first, count


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int], list[bytes], list]]:
    """(file, block, rows, texts in UTF-8, other columns) for rows _f, _r, text, ...: what a task reads
    of each block of a file. Another task may read the rest of a block."""
    key, rows, texts, more = None, [], [], []
    for some in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
        for f, r, text, *rest in zip(*(c.to_pylist() for c in some.columns), strict=True):
            if (f, r // BLOCK) != key:
                if rows:
                    yield *key, rows, texts, more
                key, rows, texts, more = (f, r // BLOCK), [], [], []
            rows.append(r)
            texts.append((text or "").encode("utf-8"))
            more.append(rest)
    if rows:
        yield *key, rows, texts, more


def _copies_of(copies: str, f: int, rows: list[int]) -> set[int]:
    return set(get(copies, f, ["_r"], rows[0], rows[-1])["_r"].to_pylist())


class _Block:
    """The anchors of a block without its copies, the same whenever they are computed."""

    def __init__(self, texts: list[bytes], rows: list[int], copies: set[int]):
        self.index = [i for i, r in enumerate(rows) if r not in copies and len(texts[i]) >= LENGTH]
        self.data = np.frombuffer(b"".join(texts[i] for i in self.index), np.uint8)
        self.ends = np.cumsum([len(texts[i]) for i in self.index], dtype=np.int64)
        self.digest, self.anchor, self.first, self.count = anchors(self.data, self.ends)
        self.distinct, self.of, times = np.unique(self.digest, return_inverse=True, return_counts=True)
        self.twice = times > 1

    def fragments(self) -> np.ndarray:
        """How many different fragments each distinct anchor has."""
        out = np.ones(len(self.distinct), np.int64)
        some = np.flatnonzero(self.twice[self.of])
        if len(some):
            of, first = self.of[some], self.first[some]
            k0, k1 = substring_digests(self.data, self.ends, first, first + self.count[some] + LENGTH - 1)
            order = np.lexsort((k1, k0, of))
            of, k0, k1 = of[order], k0[order], k1[order]
            fresh = np.append(True, (of[1:] != of[:-1]) | (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]))
            n = np.bincount(of[fresh], minlength=len(out))
            out[n > 0] = n[n > 0]
        return out


def _shard(digest: np.ndarray, n: int) -> np.ndarray:
    return ((digest >> _U(32)) % _U(n)).astype(np.int64)


def count_anchors(rows: DataFrame, copies: str, n: int) -> DataFrame:
    """_f, _r (first row of a block), found: the block's anchors that are repeated, and how: 1, or 2 for those
    with very many fragments. Which part of a block a task reads makes no difference."""

    def send(batches):
        for f, block, rows, texts, _ in _blocks(batches):
            b = _Block(texts, rows, _copies_of(copies, f, rows))
            shard = _shard(b.distinct, n)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(n + 1))
            full = np.flatnonzero(np.diff(cuts))
            # the highest bit: twice in this part of the block
            n_of = np.minimum(b.fragments(), 2**31 - 1).astype("<u4") | (b.twice.astype("<u4") << np.uint32(31))
            some = [order[cuts[s] : cuts[s + 1]] for s in full.tolist()]
            blobs = [b.distinct[x].tobytes() + n_of[x].tobytes() for x in some]
            k = len(full)
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array(full, pa.int32()), "_f": pa.array([f] * k, pa.int64()), "_r": pa.array([block * BLOCK] * k, pa.int64()), "digests": pa.array(blobs, pa.binary())}
            )

    def meet(batches):
        keys, blobs = [], []
        for batch in batches:
            keys += zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True)
            blobs += batch.column(3).to_pylist()
        if not keys:
            return
        size = np.array([len(x) // 12 for x in blobs])
        digests = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(blobs, size.tolist(), strict=True)])
        n_of = np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for x, n in zip(blobs, size.tolist(), strict=True)])
        _, of, times = np.unique(digests, return_inverse=True, return_counts=True)
        many = np.bincount(of, weights=n_of & np.uint32(2**31 - 1)) > MANY
        how = ((times > 1) | many).astype(np.uint8)[of] + many.astype(np.uint8)[of]
        how = np.maximum(how, (n_of >> np.uint32(31)).astype(np.uint8))
        cuts = np.cumsum(size)[:-1]
        keep, out = [], []
        for k, (d, h) in enumerate(zip(np.split(digests, cuts), np.split(how, cuts), strict=True)):
            if h.any():
                keep.append(keys[k])
                out.append(zstandard.compress(d[h > 0].tobytes() + h[h > 0].tobytes(), 1))
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([k[0] for k in keep], pa.int32()),
                "_f": pa.array([k[1] for k in keep], pa.int64()),
                "_r": pa.array([k[2] for k in keep], pa.int64()),
                "found": pa.array(out, pa.binary()),
            }
        )

    sent = map_arrow(rows.select("_f", "_r", "text"), send, "shard int, _f long, _r long, digests binary")
    return map_arrow(sent.repartitionById(n, F.col("shard")), meet, "shard int, _f long, _r long, found binary")


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... size of them, for each."""
    upto = np.cumsum(size)
    out = np.repeat(start - (upto - size), size)
    out += np.arange(len(out))
    return out


def send_fragments(rows: DataFrame, copies: str, seen: str, shards: int) -> DataFrame:
    """shard and a blob of fragments: see ``_pack``."""

    def run(batches):
        for f, block, rows, texts, more in _blocks(batches):
            b = _Block(texts, rows, _copies_of(copies, f, rows))
            if not len(b.digest):
                continue
            # 0: once, 1: repeated, 2: with very many fragments
            state = np.zeros(len(b.distinct), np.uint8)
            for found in get(seen, f, ["found"], block * BLOCK, block * BLOCK)["found"].to_pylist():
                raw = zstandard.decompress(found)
                digests, how = np.frombuffer(raw, np.uint64, len(raw) // 9), np.frombuffer(raw, np.uint8, len(raw) // 9, len(raw) // 9 * 8)
                at = np.minimum(np.searchsorted(b.distinct, digests), len(b.distinct) - 1)
                mine = b.distinct[at] == digests
                state[at[mine]] = np.maximum(state[at[mine]], how[mine])
            state = state[b.of]
            some, hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
            first = np.concatenate([b.first[some], _ragged(b.first[hot], b.count[hot])])
            count = np.concatenate([b.count[some], np.ones(int(b.count[hot].sum()), np.int64)])
            if not len(first):
                continue
            end = first + count + LENGTH - 1
            keys = substring_digests(b.data, b.ends, first, end)
            # by the anchor, or by the window itself
            by = np.concatenate([b.digest[some], keys[0][len(some) :]])
            to = _shard(_mix(by ^ _U(1)), shards)
            text_of = np.searchsorted(b.ends, first, side="right")
            index = np.array(b.index)[text_of]
            place = first - np.concatenate([[0], b.ends])[text_of]
            doc_ids = [m[0] for m in more]
            for s in np.unique(to).tolist():
                at = np.flatnonzero(to == s)
                order = np.lexsort((place[at], index[at], keys[1][at], keys[0][at]))
                at = at[order]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (keys[0][at][1:] != keys[0][at][:-1]) | (keys[1][at][1:] != keys[1][at][:-1])
                heads = at[fresh]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([s], pa.int32()),
                        "_f": pa.array([f], pa.int64()),
                        "blob": pa.array(
                            [
                                _pack(
                                    keys[0][heads], keys[1][heads], count[heads].astype(np.uint8), b.data[_ragged(heads_first := first[heads], end[heads] - heads_first)],
                                    np.diff(np.flatnonzero(fresh), append=len(at)).astype(np.uint32),
                                    np.array([doc_ids[i] is None for i in index[at].tolist()], np.uint8),
                                    np.array([doc_ids[i] or 0 for i in index[at].tolist()], np.int64),
                                    np.array(rows, np.int64)[index[at]], place[at].astype(np.int64),
                                )
                            ],
                            pa.binary(),
                        ),
                    }
                )

    return map_arrow(rows.select("_f", "_r", "text", "doc_id"), run, "shard int, _f long, blob binary")


_KINDS = ("<u8", "<u8", "u1", "u1", "<u4", "u1", "<i8", "<i8", "<i8")


def _pack(*arrays: np.ndarray) -> bytes:
    """Of each fragment: two digests, its number of windows; all bytes; the number of places of each;
    of each place: whether doc_id is null, doc_id, row, first byte."""
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.astype(k, copy=False).tobytes() for a, k in zip(arrays, _KINDS, strict=True)), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<i8", len(_KINDS)), 8 * len(_KINDS), []
    for n, k in zip(sizes.tolist(), _KINDS, strict=True):
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


def sort_shard(files: np.ndarray, blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(file, row, begin, end) of ranges of window starts that repeat, from one shard's fragments."""
    k0, k1, count = (np.concatenate([b[i] for b in blobs]) for i in (0, 1, 2))
    texts = [b[3] for b in blobs]
    places = np.concatenate([b[4] for b in blobs]).astype(np.int64)
    null, doc, row, at = (np.concatenate([b[i] for b in blobs]) for i in (5, 6, 7, 8))
    file = np.repeat(files, [len(b[5]) for b in blobs])
    size = count.astype(np.int64) + LENGTH - 1
    data = np.concatenate(texts)
    start = np.cumsum(size) - size
    # documents in order; equal fragments of different blocks are one
    order = np.lexsort((row, file, doc, null))
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for x in (null, doc, file, row):
        fresh[1:] |= x[order][1:] != x[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    by_key = np.lexsort((k1, k0))
    new = np.ones(len(by_key), bool)
    new[1:] = (k0[by_key][1:] != k0[by_key][:-1]) | (k1[by_key][1:] != k1[by_key][:-1])
    fragment = np.empty(len(by_key), np.int64)
    fragment[by_key] = np.cumsum(new) - 1
    heads = by_key[new]
    of_place = np.repeat(fragment, places)
    # the first place of each fragment
    first_order = np.lexsort((at, rank, of_place))
    first_of = np.ones(len(first_order), bool)
    first_of[1:] = of_place[first_order][1:] != of_place[first_order][:-1]
    first = first_order[first_of]
    windows = count[heads].astype(np.int64)
    long = size[heads]
    # one string: fragments with a separator behind each, and the sentinel
    s = np.full(int(long.sum()) + len(heads) + 1, 1, np.uint16)
    s[-1] = 0
    begin = np.cumsum(long + 1) - (long + 1)
    s[_ragged(begin, long)] = data[_ragged(start[heads], long)].astype(np.uint16) + 2
    sa = suffix_array(s)
    valid = np.zeros(len(s), bool)
    window_at = _ragged(begin, windows)
    valid[window_at] = True
    limit = np.zeros(len(s), np.int64)
    limit[_ragged(begin, long)] = np.repeat(begin + long, long)
    ordered = sa[valid[sa]]
    share = common_prefixes(s, ordered, limit)
    apart = share[ordered] < LENGTH
    apart[0] = True
    # of equal windows the one that starts first: by document, then by place
    within = np.repeat(np.arange(len(heads)), windows)
    when_rank, when_at = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    when_rank[window_at] = rank[first][within]
    when_at[window_at] = at[first][within] + (window_at - begin[within])
    group = np.cumsum(apart)
    best = np.lexsort((when_at[ordered], when_rank[ordered], group))
    is_first = np.ones(len(best), bool)
    is_first[1:] = group[best][1:] != group[best][:-1]
    repeats = np.ones(len(s), bool)
    repeats[ordered[best[is_first]]] = False
    # ranges: single windows of first places that repeat, all windows of the other places
    hit = window_at[repeats[window_at]]
    frag = np.repeat(np.arange(len(heads)), windows)[repeats[window_at]]
    edge = np.ones(len(hit), bool)
    edge[1:] = (hit[1:] != hit[:-1] + 1) | (frag[1:] != frag[:-1])
    e = np.flatnonzero(edge)
    n = np.diff(e, append=len(hit))
    place1, low1 = first[frag[e]], at[first][frag[e]] + hit[e] - begin[frag[e]]
    other = first_order[~first_of]
    out_place = np.concatenate([place1, other])
    low = np.concatenate([low1, at[other]])
    high = np.concatenate([low1 + n, at[other] + windows[of_place[other]]])
    return file[out_place], row[out_place], low, high


def sort_shards(fragments: DataFrame, n: int) -> DataFrame:
    """_f, _r (first row of a block), ranges: triples of row in the block, begin and end of windows that repeat."""

    def shards(batches):
        shard, files, blobs = None, [], []
        for batch in batches:
            for s, f, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if blobs:
                        yield files, blobs
                    shard, files, blobs = s, [], []
                files.append(f)
                blobs.append(blob)
        if blobs:
            yield files, blobs

    def run(batches):
        for files, blobs in shards(batches):
            file, row, low, high = sort_shard(np.array(files, np.int64), [_unpack(x) for x in blobs])
            block = row // BLOCK
            order = np.lexsort((low, row, file))
            file, row, low, high, block = (x[order] for x in (file, row, low, high, block))
            fresh = np.ones(len(file), bool)
            fresh[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(fresh)
            cuts = np.append(at, len(file)).tolist()
            triples = np.stack([row - block * BLOCK, low, high], axis=1).astype("<i8")
            yield pa.RecordBatch.from_pydict(
                {
                    "_f": pa.array(file[at], pa.int64()),
                    "_r": pa.array(block[at] * BLOCK, pa.int64()),
                    "ranges": pa.array([zstandard.compress(triples[a:b].tobytes(), 1) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                }
            )

    dealt = fragments.repartitionById(n, F.pmod("shard", F.lit(n))).sortWithinPartitions("shard")
    return map_arrow(dealt, run, "_f long, _r long, ranges binary")


def cut(rows: DataFrame, copies: str, found: str) -> DataFrame:
    """doc_id, text (bytes that are left), n_bytes, spans: (start, end) of what was removed."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])
        for f, block, rows, texts, more in _blocks(batches):
            gone = _copies_of(copies, f, rows)
            got = get(found, f, ["ranges"], block * BLOCK, block * BLOCK)["ranges"].to_pylist()
            triples = [np.frombuffer(zstandard.decompress(x), "<i8").reshape(-1, 3) for x in got]
            triples = np.concatenate(triples) if triples else np.zeros((0, 3), np.int64)
            triples = triples[np.lexsort((triples[:, 1], triples[:, 0]))]
            out = []
            for r, text, (doc_id,) in zip(rows, texts, more, strict=True):
                spans = []
                if r in gone:
                    spans = [[0, len(text)]] if len(text) >= LENGTH else []
                else:
                    a, b = np.searchsorted(triples[:, 0], [r - block * BLOCK, r - block * BLOCK + 1])
                    if b > a:
                        low, high = triples[a:b, 1], np.maximum.accumulate(triples[a:b, 2] + LENGTH - 1)
                        new = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
                        spans = np.stack([low[new], high[np.append(new[1:], len(low)) - 1]], axis=1).tolist()
                kept, at = [], 0
                for x, y in spans:
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                out.append({"doc_id": doc_id, "kept": b"".join(kept), "n_bytes": len(text), "spans": spans})
                if len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_arrow(rows.select("_f", "_r", "text", "doc_id"), run, "doc_id long, kept binary, n_bytes long, spans array<array<long>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes and spans of each row."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    ids = materialize(rows.select("_f", "_r", "doc_id", digest.alias("digest"), size), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_f", "_r")
    groups = materialize(ids.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    copies = ids.drop("size").join(groups, "digest").where("_f <> first._f or _r <> first._r")
    copies = put(copies.select("_f", "_r"), "copies")
    seen = put(count_anchors(rows, copies, n), "seen")
    shards = max(n, (ids.agg(F.sum("size")).first()[0] or 0) // PER_SHARD)
    discard(spark, ids, groups)
    fragments = send_fragments(rows, copies, seen, shards)
    found = put(sort_shards(fragments, n), "found")
    discard(spark, seen)
    return cut(rows, copies, found)


def digests(result: DataFrame) -> DataFrame:
    """The columns of the query from those of ``remove_repeats``."""

    def run(batches):
        for batch in batches:
            spans = [x or [] for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_bytes": batch.column(2),
                    "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                    "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(1)], pa.string()),
                }
            )

    return map_arrow(result, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
