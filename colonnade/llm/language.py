"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are reduced to lower-case letters with one space between words. Their n-grams of one to four
letters are hashed to ``BUCKETS`` features (n-grams of one letter and those longer alternate salts);
counts are damped (1 + log), weighted by inverse document frequency and scaled to length one.
Document frequencies are counted over all documents one may learn from. The weights are fitted with
follow-the-regularised-leader and elastic-net penalties, on a bounded sample of them: the
``SAMPLE`` documents of each language (``SAMPLE_IN_ALL`` together) with the smallest digests of their ids. A tenth of the sample
stays out of the fit; the temperature that makes the scores on it most likely calibrates them.

What reaches the driver is bounded by BUCKETS, and by SAMPLE and the number of languages; what is
sent to the executors by BUCKETS and the number of languages.

Defined cases: a null text and one without letters get ``und`` and score 0, as do all if there is
nothing to learn from; equal scores go to the language that sorts first; a null doc_id is never
learned from and is not held out; null languages are not learned; rows that repeat are rows of
their own; texts of any length are read whole; an empty table gives an empty result; of the other
columns only lang is read, to learn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .side import store

UNKNOWN = "und"
BUCKETS = 1 << 15
LONGEST_GRAM = 4
#: Documents of each language that the weights are fitted on, at most.
SAMPLE = 1500
#: Documents of the whole sample, which many languages share evenly; each of them has ``LEAST``, if it has as many.
SAMPLE_IN_ALL, LEAST = 6000, 10

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SALTS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def letters(text: str | None) -> str:
    """Lower case; whatever is no letter becomes one space; a space at both ends. Empty without letters."""
    kept = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {kept} " if kept and any(map(str.isalpha, kept)) else ""


def gram_counts(text: str) -> np.ndarray:
    """How often each feature occurs in what ``letters`` returned."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    value = np.zeros(len(codes), np.uint32)
    for n in range(LONGEST_GRAM):
        value = (value[: len(codes) - n] ^ (codes[n:] + np.uint32(n))) * _SALTS[n]
        if len(value):
            mixed = value ^ (value >> np.uint32(15))
            out += np.bincount((mixed * _SALTS[0]) >> np.uint32(32 - 15), minlength=BUCKETS)
    return out


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass(frozen=True)
class Trained:
    """Where a model is written, and whether there was anything to learn."""

    frequencies: str
    weights: str
    learned: bool


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # float32 [BUCKETS]
    start: np.ndarray  # where the weights of each feature begin, and the end
    language: np.ndarray  # of each weight that is not zero
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        at, x = _features(counts, self.idf)
        n = self.start[at + 1] - self.start[at]
        upto = np.cumsum(n)
        pick = np.repeat(self.start[at] - (upto - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.language[pick], self.weight[pick] * np.repeat(x, n), len(self.languages)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        kept = letters(text)
        if not kept or not self.languages:
            return UNKNOWN, 0.0
        z = self.scores(gram_counts(kept)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def _table(folder: str) -> pa.Table:
    system, root = store(folder)
    return ds.dataset(root, filesystem=system, format="parquet").to_table()


def _idf(frequencies: str) -> np.ndarray:
    df, t = np.zeros(BUCKETS + 1, np.int64), _table(frequencies)
    df[np.asarray(t["bucket"])] = np.asarray(t["n"])  # -1: the number of documents
    return (np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1).astype(np.float32)


@lru_cache(maxsize=1)
def load(model: Trained) -> Model:
    """A model as tasks use it; once for each Python worker."""
    rows = sorted(_table(model.weights).to_pylist(), key=lambda r: r["lang"])
    at = [np.frombuffer(r["at"], "<u2") for r in rows]
    size, language = [len(a) for a in at], np.repeat(np.arange(len(rows)), [len(a) for a in at])
    feature = np.concatenate(at) if sum(size) else np.zeros(0, np.uint16)
    order = np.lexsort((language, feature))
    weight = np.frombuffer(b"".join(r["w"] for r in rows), "<f4")[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=BUCKETS))])
    bias = np.array([r["bias"] for r in rows])
    return Model([r["lang"] for r in rows], _idf(model.frequencies), start, language[order], weight, bias, rows[0]["temperature"] if rows else 1.0)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 3, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal, one document at a time: per coordinate z gathers gradients and n their squares,
    and the weight is the closed form of the elastic-net step. Returns (weights, bias)."""
    z, n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))  # the last row is the bias

    def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float = l1) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at.astype(np.int64), BUCKETS), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = np.outer(x, p)
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) * alpha**-1 * w
            n[at] = ni + g2
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores that makes the labels most likely, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        z = scores / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    low, high, g = np.log(0.25), np.log(20.0), (5**0.5 - 1) / 2
    if not len(labels):
        return 1.0
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[str, int, bytes, bytes]], idf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, weights, bias, temperature) from a sample: (language, rank, features, counts)."""
    rows = sorted(rows, key=lambda r: r[:2])
    languages = sorted({r[0] for r in rows})
    place = {k: i for i, k in enumerate(languages)}
    learn, check = ([], []), ([], [])
    for lang, rank, at, n in rows:
        if not at:
            continue
        at = np.frombuffer(at, "<u2")
        x = (1 + np.log(np.frombuffer(n, "<u4").astype(np.float32))) * idf[at]
        to = check if rank % 10 == 0 else learn
        to[0].append((at, (x / np.sqrt((x * x).sum())).astype(np.float32)))
        to[1].append(place[lang])
    weights, bias = ftrl(learn[0], np.array(learn[1], int), len(languages))
    scores = np.array([x @ weights[at] + bias for at, x in check[0]]).reshape(-1, len(languages))
    return languages, weights, bias, temperature(scores, np.array(check[1], int))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Trained:
    """labelled: doc_id, text, lang."""
    rows = labelled.where("lang is not null and doc_id is not null").select("doc_id", "text", "lang")

    def count(batches):
        # one sum for each task: BUCKETS counts, whatever it reads
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if kept := letters(text.as_py()):
                    total += gram_counts(kept) > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    counts = map_arrow(rows.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequencies = materialize(counts, "frequencies").written_to

    # Smallest digests first, of ids alone, language by language: a top-k for each is all that is sorted.
    digest = F.xxhash64(F.lit("language"), "doc_id")
    sizes = rows.select("lang", digest.alias("digest")).groupBy("lang").agg(F.count("*").alias("size"), F.min("digest").alias("first"))
    sizes = materialize(sizes, "languages")
    each = max(LEAST, min(sample, SAMPLE_IN_ALL // max(1, sizes.count())))
    # a bound on the digest that leaves little more than the sample of each language, then the exact cut
    share = F.lit(2.0 * each + 100) / F.col("size")
    bound = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((F.least(share, F.lit(0.999)) * 2.0**64 - 2.0**63).cast("long"))
    few = rows.join(sizes.select("lang", F.greatest(bound, "first").alias("bound")), "lang").withColumn("digest", digest)
    few = few.where("digest <= bound").select("lang", "digest", F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sparse(batches):
        for batch in batches:
            out = []
            for lang, digest, doc_id, text in zip(*batch.columns, strict=True):
                c = gram_counts(letters(text.as_py()))
                at = np.flatnonzero(c)
                packed = at.astype("<u2").tobytes(), np.minimum(c[at], 2**32 - 1).astype("<u4").tobytes()
                out.append({"lang": lang.as_py(), "digest": digest.as_py(), "doc_id": doc_id.as_py(), "at": packed[0], "n": packed[1]})
            schema = pa.schema([("lang", pa.string()), ("digest", pa.int64()), ("doc_id", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    # texts are reduced to at most BUCKETS counts before they are sent anywhere
    few = map_arrow(few, sparse, "lang string, digest long, doc_id long, at binary, n binary")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "doc_id"))
    taken = few.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "rank", "at", "n")

    def fit_all(batches):
        got = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not got:
            return
        languages, weights, bias, t = fit(got, _idf(frequencies))
        for k, lang in enumerate(languages):
            at = np.flatnonzero(weights[:, k])
            row = {"lang": [lang], "bias": [float(bias[k])], "temperature": [t], "at": [at.astype("<u2").tobytes()], "w": [weights[at, k].astype("<f4").tobytes()]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("lang", pa.string()), ("bias", pa.float64()), ("temperature", pa.float64()), ("at", pa.binary()), ("w", pa.binary())]))

    # one task: the sample's bound is the bound of what it reads
    weights = map_arrow(taken.repartition(1), fit_all, "lang string, bias double, temperature double, at binary, w binary")
    weights = materialize(weights, "weights")
    return Trained(frequencies, weights.written_to, bool(weights.limit(1).count()))


def predict(docs: DataFrame, model: Trained, *keep: str) -> DataFrame:
    """The columns in ``keep``, then lang_pred and score, from text alone."""

    def run(batches):
        m = load(model)
        for batch in batches:
            got = [m.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) if keep else ""
    return map_arrow(rows, run, f"{fields}lang_pred string, score double")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(rows, model, "doc_id", "held_out")
