"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct shingles. Equal sets are one class, told by 128 bits of digest; the
row with the smallest doc_id represents it, and all that follows is on classes. Minima of 256 hashes give
42 bands of six; classes that agree in a band are candidates. Of every minimum two bits are kept, packed
into words; the share of equal positions, by bit counts, corrected for chance agreement (one in
four), estimates the similarity, and candidates five standard errors below the threshold go. What is
left is confirmed on the full sets. A pair at the threshold shares no band with a probability of
(1 - 0.8**6)**42 = 3e-6 and is estimated too low with one of 3e-7; a closer pair with less.

Pairs within a bucket are not written out. Each bucket has a leader, the member that shares
buckets with most others (as an original does that all copies resemble), and members are compared
with it. What these links connect needs no other link. Members of a bucket that are still apart
are then compared across the parts: those outside the bucket's largest part with all members of
other parts, by signatures of four times as many hashes and once for each pair, before anything is
written. So no link between candidates is lost that would join two components.

Defined cases: null and empty texts and those of white space have the empty set and are linked
with nothing; with fewer words than a shingle has, all words are the one shingle; rows with a null
doc_id are linked with nothing and have a null component_id and kept true; rows that share a
doc_id share a component, and each of their texts links it with others; texts of any length are read
whole; an empty table gives an empty result; other columns are not read, whatever their names (a frame
that has a column ``_metadata`` or is no plain file scan is written first).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed, map_arrow, materialize, partitions, slices
from .graph import components

BANDS, ROWS, BITS = 42, 6, 2
#: Hashes of a signature, and of the finer one.
N_HASHES, N_FINE = 256, 1024
N_WORDS, N_FINE_WORDS = N_HASHES * BITS // 64, N_FINE * BITS // 64
#: Standard errors of an estimate by which a candidate must fall short to go.
SURE = 5.0
#: Members compared with one replica of a leader.
PER_REPLICA = 32
#: Bytes of words that are digested at once.
_CHUNK = 1 << 20

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(4))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]  # A-Z in lower case
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_KEYS = _RNG.integers(0, 2**63, (N_HASHES + N_FINE, 2), dtype=np.uint64) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class _Powers:
    """_STEP**i and _BACK**i modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(x))]), dtype=np.uint64) for x in (_STEP, _BACK))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): the distinct shingles of each text as 64-bit digests, ascending within a
    text, one text after another, and where each text's end. All texts at once."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    # a word's digest from prefix sums, taken back to where the word starts
    word, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _CHUNK, side="right")))
        some = data[start[at] : end[to - 1]]
        a, b = start[at:to] - start[at], end[at:to] - start[at]
        up, down = _POWERS.to(len(some) + 1)
        sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[some] * up[:-1], dtype=np.uint64)])
        word[at:to] = _mix((sums[b] - sums[a]) * down[a])
        at = to
    ends_of_text = np.cumsum(size)
    of = np.searchsorted(ends_of_text, start, side="right")
    words = np.bincount(of, minlength=len(texts))
    first = np.cumsum(words) - words
    shingle = np.zeros(len(word), np.uint64)
    for j in range(k):
        part = word[j:] * _KEYS[j, 0]
        shingle[: len(part)] += part
    whole = np.arange(len(word)) + k <= np.repeat(first + words, words)
    values, owner = [_mix(shingle[whole])], [of[whole]]
    for n in range(1, k):  # short texts: all words, under a key for their number
        short = np.flatnonzero(words == n)
        at = first[short]
        values.append(_mix(sum((word[at + j] * _KEYS[j, 0] for j in range(n)), np.full(len(at), _U(n))) ^ _KEYS[n, 1]))
        owner.append(short)
    value, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.cumsum(np.bincount(owner, minlength=len(texts)))


def minima(values: np.ndarray, starts: np.ndarray, full: np.ndarray, n: int, first: int, last: int) -> np.ndarray:
    """[hash, set]: the least digest of each set under each hash; sets that are empty keep the greatest."""
    low = np.zeros((last - first, n), np.uint64)
    if len(full):
        for h in range(first, last):
            low[h - first, full] = np.minimum.reduceat((values ^ _KEYS[h, 0]) * _KEYS[h, 1], starts)
    return _mix(low)


def pack(low: np.ndarray) -> list[np.ndarray]:
    """The lowest bits of the minima, many in a word."""
    per_word, out = 64 // BITS, []
    for w in range(len(low) // per_word):
        packed = np.zeros(low.shape[1], np.uint64)
        for i in range(per_word):
            packed |= (low[w * per_word + i] & _U((1 << BITS) - 1)) << _U(BITS * i)
        out.append(packed.view(np.int64))
    return out


def signatures(values: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Of each set: n, a digest of the set (d1, d2), packed bits (s0, s1, ...) and band keys."""
    n = np.diff(ends, prepend=0)
    full = np.flatnonzero(n)
    starts = (ends - n)[full]
    out = {"n": n}
    for name, key in (("d1", _KEYS[0]), ("d2", _KEYS[1])):
        d = np.zeros(len(n), np.uint64)
        if len(full):
            d[full] = np.add.reduceat(_mix(values ^ key[0]) * key[1], starts)
        out[name] = d.view(np.int64)
    low = minima(values, starts, full, len(n), 0, N_HASHES)
    for w, word in enumerate(pack(low)):
        out[f"s{w}"] = word
    bands = np.zeros((len(n), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(n), _U(b + 1))
        for r in range(ROWS):
            key = _mix(key * _U(_STEP) + low[b * ROWS + r])
        bands[:, b] = key
    out["bands"] = bands.view(np.int64)
    return out


_SIGNATURE = [f"s{w}" for w in range(N_WORDS)]
_FINE = [f"t{w}" for w in range(N_FINE_WORDS)]


def _utf8(texts: pa.Array) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8") for x in texts]


def sign(docs: DataFrame, k: int) -> DataFrame:
    """_f, _r, doc_id, n, d1, d2, s0.., bands of each row."""
    names = ["n", "d1", "d2", *_SIGNATURE]

    def run(batches):
        for batch in batches:
            for some in slices(batch, 3, 400):
                s = signatures(*shingle_sets(_utf8(some.column(3)), k))
                bands = pa.FixedSizeListArray.from_arrays(pa.array(s["bands"].ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], *(pa.array(s[x]) for x in names), bands], names=["_f", "_r", "doc_id", *names, "bands"])

    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, f"_f long, _r long, doc_id long, {', '.join(f'{x} long' for x in names)}, bands array<long>")


def fine(texts: DataFrame, k: int) -> DataFrame:
    """rep and the words t0, t1, ... of a signature by other hashes, more of them."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, 1, 400):
                values, ends = shingle_sets(_utf8(some.column(1)), k)
                n = np.diff(ends, prepend=0)
                full = np.flatnonzero(n)
                words = pack(minima(values, (ends - n)[full], full, len(n), N_HASHES, N_HASHES + N_FINE))
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, words)], names=["rep", *_FINE])

    return map_arrow(texts.select("rep", "text"), run, "rep long, " + ", ".join(f"{t} long" for t in _FINE))


def estimate(a: list[str], b: list[str]):
    """Collision-corrected similarity of two signatures, by bit counts. a, b: their words."""
    mask = "6148914691236517205L"  # the lower bit of each pair
    unlike = " + ".join(f"bit_count((({x} ^ {y}) | shiftrightunsigned({x} ^ {y}, 1)) & {mask})" for x, y in zip(a, b, strict=True))
    chance = 1 / 2**BITS
    return (1 - F.expr(unlike) / (len(a) * 64 // BITS) - chance) / (1 - chance)


def least(percent: int, n: int) -> float:
    """An estimate by n hashes below this is ``SURE`` standard errors short of the threshold."""
    j, chance = percent / 100, 1 / 2**BITS
    p = j + (1 - j) * chance
    return j - SURE * (p * (1 - p) / n) ** 0.5 / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes whose full sets are as similar as asked, the doc_ids (a, b). Each b travels
    to its a; an a with many pairs is replicated, so that no task has more than a share of them."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / PER_REPLICA).cast("int").alias("replicas"))
    salt = F.pmod(F.xxhash64("b"), F.col("replicas")).cast("int")
    members = pairs.join(counts, "a").select("a", "b", salt.alias("salt")).join(texts, F.col("b") == F.col("rep"))
    members = members.select("a", "salt", F.lit(1).alias("kind"), "doc", "text")
    leaders = counts.join(texts, F.col("a") == F.col("rep")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1)))
    leaders = leaders.select("a", "salt", F.lit(0).alias("kind"), "doc", "text")
    rows = members.unionByName(leaders).repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches):
        group, own, own_doc = None, None, None
        for batch in batches:
            for some in slices(batch, 4, 400):
                values, ends = shingle_sets(_utf8(some.column(4)), k)
                found, begin = [], 0
                for a, salt, kind, doc, end in zip(*(some.column(i).to_pylist() for i in range(4)), ends.tolist(), strict=True):
                    mine, begin = values[begin:end], end
                    if kind == 0:
                        group, own, own_doc = (a, salt), mine, doc
                    elif group == (a, salt):
                        both = len(mine) + len(own)
                        # ascending and distinct: what occurs twice when merged is in both
                        merged = np.sort(np.concatenate([mine, own]), kind="stable")
                        common = int((merged[1:] == merged[:-1]).sum())
                        if 100 * common >= percent * (both - common):
                            found.append((own_doc, doc))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long")


def one_id(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between a doc_id that rows of several classes have and the doc_ids of these classes."""
    spread = [F.min("d1") != F.max("d1"), F.min("d2") != F.max("d2")]
    twice = some.groupBy("doc_id").agg((spread[0] | spread[1]).alias("more")).where("more").select("doc_id")
    own = some.select("doc_id", "d1", "d2").join(twice, "doc_id").distinct().join(classes.select("d1", "d2", "doc"), ["d1", "d2"])
    return own.select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row. k: words of a shingle; percent: least
    similarity of a link, intersection over union."""
    spark = docs.sparkSession
    signed = materialize(sign(docs, k), "signed")
    some = signed.where("n > 0 and doc_id is not null")
    # a class has an id (rep), the smallest of its doc_ids (doc) and that document's row
    classes = some.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "_f", "_r", *_SIGNATURE, "bands")).alias("r"))
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "d1", "d2", F.col("r.doc_id").alias("doc"), *(f"r.{c}" for c in ("_f", "_r", *_SIGNATURE, "bands")))
    classes = materialize(classes, "classes")

    # buckets of more than one class, and their members
    banded = classes.select("rep", "doc", F.posexplode("bands").alias("band", "key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(crowded, "key"), "members")
    degrees = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = members.select("key", "rep", "doc").join(degrees, "rep")
    leaders = ranked.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), "doc", "rep")).alias("l")).select("key", F.col("l.rep").alias("a"))
    needed = classes.select("rep", "doc", "_f", "_r").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = materialize(keyed(docs, "text").join(needed, ["_f", "_r"]).select("rep", "doc", "text"), "texts")

    # every member against its bucket's leader: those pairs whose bits say they may be similar enough
    stars = members.join(leaders, "key").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    for side in ("a", "b"):
        stars = stars.join(classes.select(F.col("rep").alias(side), *(F.col(w).alias(f"{side}_{w}") for w in _SIGNATURE)), side)
    near = estimate([f"a_{w}" for w in _SIGNATURE], [f"b_{w}" for w in _SIGNATURE]) >= least(percent, N_HASHES)
    stars = materialize(stars.where(near).select("a", "b"), "stars")
    links = materialize(confirm(stars, texts, k, percent).union(one_id(some, classes)), "links")
    label = components(links)

    # what candidates are apart still
    parted = members.select("key", "band", "rep", "doc").join(label, F.col("doc") == F.col("node"), "left")
    parted = parted.select("key", "band", "rep", F.coalesce("label", "doc").alias("part"))
    by_part = parted.groupBy("key", "part").agg(F.count("*").alias("n"))
    largest = by_part.groupBy("key").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    within = materialize(parted.join(largest.select("key", F.col("m.part").alias("main")), "key"), "parted")
    finer = texts.join(within.select("rep").distinct(), "rep", "left_semi")
    finer = materialize(fine(finer, k).join(classes.select("rep", F.col("bands").alias("all_bands")), "rep"), "fine")
    parted = within.join(finer, "rep")
    apart = parted.where("part <> main").select("key", F.col("rep").alias("x"), F.col("part").alias("x_part"), F.col("all_bands").alias("x_bands"), *(F.col(t).alias(f"x{t}") for t in _FINE))
    near = estimate([f"x{t}" for t in _FINE], _FINE) >= least(percent, N_FINE)
    other = (F.col("x_part") != F.col("part")) & ((F.col("part") == F.col("main")) | (F.col("x") < F.col("rep")))
    # a pair is compared in the first band that it shares
    once = F.expr("array_position(zip_with(x_bands, all_bands, (p, q) -> p = q), true) = band + 1")
    across = apart.alias("l").join(parted.alias("r"), (F.col("l.key") == F.col("r.key")) & other & near & once)
    across = across.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))
    across = across.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    across = materialize(across, "across")
    more = materialize(confirm(across, texts, k, percent), "links")
    if more.limit(1).count():
        label = components(links.unionByName(more))
    # what follows reads the signed rows, the classes and the labels only
    discard(spark, members, texts, stars, links, within, finer, across, more)

    of_class = classes.select("d1", "d2", "doc").join(label, F.col("doc") == F.col("node"), "left")
    of_class = of_class.select("d1", "d2", F.coalesce("label", "doc").alias("component"))
    rows = signed.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, b.b FROM reach r JOIN edges b ON r.other = b.a
), least AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(other, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
