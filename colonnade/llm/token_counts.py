"""Token counts that follow edits.

A document's pre-tokens are grouped, in order, into leaves of a segment tree whose nodes hold the
sums of characters and of tokens below them; a leaf holds each pre-token's number of tokens. An edit
replaces a range of code points. Only the pre-tokens it touches are encoded again, with context at its boundaries: from the pre-token before
the first one touched, whose end depends on what follows it, up to the first place behind the edit
where a pre-token of the new text begins at a place where one began before. From there on the
pattern sees what it saw before, so the rest stands. Sums are updated along the paths to the root;
a leaf that has grown large is split, by the numbers that it holds.
The tokenizer's added tokens are pre-tokens; where the text before an edit ends as one of them begins,
an edit may make or break one, and what it touches begins there.

Defined cases: a null text counts as empty and has no token; edits beyond the end are cut to the
text; an edit without text deletes; a null doc_id is kept; rows that repeat are counted each; texts
of any length are counted whole; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import map_arrow

#: Pre-tokens of a leaf when the tree is built; a leaf that grows past eight times that is split.
LEAF = 16


class CountTree:
    """The text of a document, its token count, and edits."""

    def __init__(self, text: str | None, path: str | None = None):
        self.encoder = encoder(path)
        self.encoded = 0  # pre-tokens encoded so far
        self._build(self.encoder.pre_tokens(text or ""))

    def _count(self, tokens: list[str]) -> list[int]:
        """The number of tokens of each pre-token, from the encoder."""
        self.encoded += len(tokens)
        return list(map(self.encoder.counts.__getitem__, tokens))

    def _build(self, tokens: list[str]) -> None:
        counts, at = self._count(tokens), range(0, len(tokens), LEAF)
        leaves, numbers = [tokens[i : i + LEAF] for i in at], [counts[i : i + LEAF] for i in at]
        self._lay_out(leaves, numbers, [len("".join(x)) for x in leaves], list(map(sum, numbers)))

    def _lay_out(self, leaves: list[list[str]], counts: list[list[int]], chars: list[int], sums: list[int]) -> None:
        """The tree over leaves with known sums."""
        self.size = 1 << (max(1, len(leaves)) - 1).bit_length()
        none = self.size - len(leaves)
        self.leaves, self.counts = leaves + [[] for _ in range(none)], counts + [[] for _ in range(none)]
        self.chars, self.sums = [0] * self.size + chars + [0] * none, [0] * self.size + sums + [0] * none
        for x in (self.chars, self.sums):
            for k in range(self.size - 1, 0, -1):
                x[k] = x[2 * k] + x[2 * k + 1]

    def _split(self, leaf: int) -> None:
        """A leaf becomes as many as it has pre-tokens for; all others stay as they are. Empty ones go."""
        tokens, counts, at = self.leaves[leaf], self.counts[leaf], range(0, len(self.leaves[leaf]), LEAF)
        own = [(tokens[i : i + LEAF], counts[i : i + LEAF]) for i in at]
        own = [(t, c, len("".join(t)), sum(c)) for t, c in own]
        whole = list(zip(self.leaves, self.counts, self.chars[self.size :], self.sums[self.size :], strict=True))
        self._lay_out(*map(list, zip(*(x for x in [*whole[:leaf], *own, *whole[leaf + 1 :]] if x[0]), strict=True)))

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    @property
    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t in leaf)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place below the end, and where that leaf begins."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if place >= begin + self.chars[k]:
                begin += self.chars[k]
                k += 1
        return k - self.size, begin

    def _begun(self, place: int) -> int:
        """Characters before a place with which an added token may begin, that ends behind it."""
        before, at, n = "", place, self.encoder.longest_added - 1
        while at and len(before) < n:
            leaf, begin = self._find(at - 1)
            before, at = "".join(self.leaves[leaf])[: at - begin] + before, begin
        return max((k for x in self.encoder.added for k in range(1, len(x)) if before.endswith(x[:k])), default=0)

    def _set(self, leaf: int, tokens: list[str], counts: list[int]) -> None:
        self.leaves[leaf], self.counts[leaf] = tokens, counts
        k = leaf + self.size
        chars, sums = sum(map(len, tokens)) - self.chars[k], sum(counts) - self.sums[k]
        while k:
            self.chars[k] += chars
            self.sums[k] += sums
            k //= 2

    def edit(self, start: int, end: int, text: str | None = "") -> None:
        """Replace code points [start, end) by ``text``."""
        text = text or ""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        if start == end and not text:
            return
        if not self.n_chars:
            self._build(self.encoder.pre_tokens(text))
            return
        # the leaf and pre-token before the first one touched
        touched = start - self._begun(start)
        first, begin = self._find(max(0, touched - 1))
        k, at = 0, begin
        while k < len(self.leaves[first]) - 1 and at + len(self.leaves[first][k]) < touched:
            at += len(self.leaves[first][k])
            k += 1
        if k:
            k -= 1
            at -= len(self.leaves[first][k])
        elif begin:
            first, begin = self._find(begin - 1)
            k = len(self.leaves[first]) - 1
            at = begin + sum(map(len, self.leaves[first][:k]))
        head, head_counts, shift = self.leaves[first][:k], self.counts[first][:k], len(text) - (end - start)
        # old pre-tokens from there on are taken in as far as the new ones need
        leaf, place, taken, old_ends = first, at, self.leaves[first][k:], []
        source, fresh = "", []
        while True:
            for t in taken:
                place += len(t)
                old_ends.append(place)
            source += "".join(taken)
            whole = leaf == self.size - 1 or place == self.n_chars
            if place > end or whole:
                new = source[: start - at] + text + source[end - at :]
                meets = {e + shift: i for i, e in enumerate(old_ends) if e >= end and e + shift >= start + len(text)}
                fresh, p, met = [], at, None
                for token in self.encoder.pre_tokens(new):
                    p += len(token)
                    # one that reaches the end of what is taken in might go on or end otherwise
                    if not whole and p - at + max(2, self.encoder.longest_added) > len(new):
                        break
                    fresh.append(token)
                    if p in meets:
                        met = meets[p]
                        break
                if met is not None or whole:
                    break
            leaf += 1
            while not self.leaves[leaf] and leaf < self.size - 1:
                leaf += 1
            taken = list(self.leaves[leaf])
        # what of the last leaf stands
        if met is None:
            rest = []
        else:
            left = len(old_ends) - 1 - met
            rest = taken[len(taken) - left :] if left <= len(taken) else None
            while rest is None:  # met in an earlier leaf: later ones stand as they are
                left -= len(taken)
                leaf -= 1
                while not self.leaves[leaf]:
                    leaf -= 1
                taken = self.leaves[leaf][k:] if leaf == first else self.leaves[leaf]
                rest = taken[len(taken) - left :] if left <= len(taken) else None
        rest_counts = self.counts[leaf][len(self.counts[leaf]) - len(rest) :]
        fresh_counts = self._count(fresh)
        if leaf == first:
            self._set(first, head + fresh + rest, head_counts + fresh_counts + rest_counts)
        else:
            self._set(first, head + fresh, head_counts + fresh_counts)
            for i in range(first + 1, leaf):
                if self.leaves[i]:
                    self._set(i, [], [])
            self._set(leaf, rest, rest_counts)
        if len(self.leaves[first]) > 8 * LEAF:
            self._split(first)


def edits_of(text: str) -> list[tuple[int, int, str]]:
    """The query's edits: a tenth (40 code points at most) goes from the middle, the text's first 25
    come in again at two thirds, and a line is added. Places are those after the edits before."""
    n = len(text)
    cut = min(40, n // 10)
    return [(n // 2, n // 2 + cut, ""), (2 * (n - cut) // 3, 2 * (n - cut) // 3, text[:25]), (n - cut + len(text[:25]),) * 2 + ("\nRevised 2 times.",)]


def count_edited(docs: DataFrame, edits=edits_of, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pretokens; after ``edits``: n_tokens_edited, n_reencoded (pre-tokens
    encoded for them) and edited_sha256. edits: text -> [(start, end, text)]."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                tree = CountTree(text, path)
                n, pre, tree.encoded = tree.n_tokens, tree.encoded, 0
                for start, end, new in edits(text):
                    tree.edit(start, end, new)
                out.append((doc_id, n, pre, tree.n_tokens, tree.encoded, hashlib.sha256(tree.text.encode("utf-8")).hexdigest()))
            names = ["doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded", "edited_sha256"]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n != "edited_sha256" else pa.string()) for n, c in zip(names, cols, strict=True)], names=names)

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    schema = "doc_id long, n_tokens long, n_pretokens long, n_tokens_edited long, n_reencoded long, edited_sha256 string"
    return map_arrow(rows, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return count_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
