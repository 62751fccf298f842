"""A bounded memory of how parts of texts are written as ids, looked up for all parts of a batch at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., size of them, for each."""
    upto = np.cumsum(size)
    out = np.repeat(start - (upto - size), size)
    out += np.arange(len(out))
    return out


class Memory:
    """The n best ways to write parts as ids, in arrays by slot. A part is told by 128 bits of digest.
    Beyond the bounds, parts that were asked for seldom are forgotten."""

    _BY_SLOT = ("check", "score", "hits", "loss", "rank", "at", "size")
    _TOP = 18

    def __init__(self, n: int, most: int, most_ids: int):
        self.n, self.most, self.most_ids = n, most, most_ids
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # first digests in order, and whose they are
        self.first = np.zeros((1 << self._TOP) + 1, np.int64)
        self.check, self.score, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: By slot and path: how much it loses against the best, its place in the order of equal scores, and where
        #: its ids are.
        self.loss, self.rank = np.zeros((0, n), np.int64), np.zeros((0, n), np.int8)
        self.at, self.size = np.zeros((0, n), np.uint32), np.zeros((0, n), np.int32)
        self.pool, self.filled = np.zeros(4096, np.uint32), 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slots of parts, -1 of those that are not there."""
        top = (key >> _U(64 - self._TOP)).astype(np.int64)
        at, end, out = self.first[top], self.first[top + 1], np.full(len(key), -1, np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.keys[at[live]] == key[live]
            out[live[hit]] = self.slot[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        there = np.flatnonzero(out >= 0)
        out[there[self.check[out[there]] != check[there]]] = -1
        return out

    def slots(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot of each part codes[start : end], slots that are new, which parts these are). Forgets first."""
        self.forget()
        key, check = Digests.of(codes, start, end)
        slots = self.find(key, check)
        miss = np.flatnonzero(slots < 0)
        new, own = miss, np.zeros(0, np.int64)
        if len(miss):
            miss = miss[np.lexsort((check[miss], key[miss]))]
            fresh = np.append(True, (key[miss][1:] != key[miss][:-1]) | (check[miss][1:] != check[miss][:-1]))
            new = miss[fresh]
            own = self.add(key[new], check[new])
            slots[miss] = own[np.cumsum(fresh) - 1]
        self.hits += np.bincount(slots, minlength=len(self.hits))
        return slots, own, new

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first way's ids of each slot, one after another, and how many each has."""
        size = self.size[slots, 0].astype(np.int64)
        return self.pool[ragged(self.at[slots, 0].astype(np.int64), size)], size

    def add(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """New slots for parts."""
        old, n = len(self.check), len(key)
        for name in self._BY_SLOT:
            x = getattr(self, name)
            setattr(self, name, np.concatenate([x, np.zeros((n, *x.shape[1:]), x.dtype)]))
        self.check[old:] = check
        self._order(np.concatenate([self.keys, key]), np.concatenate([self.slot, np.arange(old, old + n)]))
        return np.arange(old, old + n)

    def _order(self, keys: np.ndarray, slot: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]
        n_of = np.bincount((self.keys >> _U(64 - self._TOP)).astype(np.int64), minlength=1 << self._TOP)
        self.first = np.concatenate([[0], np.cumsum(n_of)])

    def put(self, slots: np.ndarray, score: np.ndarray, loss: np.ndarray, rank: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Paths of some slots; ids: those of slot by slot and path by path."""
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled + 2 * len(ids), np.uint32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        at = np.cumsum(size).reshape(size.shape) - size + self.filled
        self.score[slots], self.loss[slots], self.rank[slots], self.size[slots], self.at[slots] = score, loss, rank, size, at
        self.filled += len(ids)

    def forget(self) -> None:
        n = len(self.check)
        if n <= self.most and self.filled <= self.most_ids:
            return
        half = min(n, self.most // 2)
        # long parts are dear and come seldom: an id counts as a part
        worth = self.hits / np.maximum(1, self.size.sum(axis=1) // (4 * self.n))
        keep = np.flatnonzero(worth > max(1.0, np.partition(worth, n - half)[n - half]))
        self.pool = self.pool[ragged(self.at[keep].ravel().astype(np.int64), self.size[keep].ravel().astype(np.int64))]
        new = np.full(n, -1, np.int64)
        new[keep] = np.arange(len(keep))
        for name in self._BY_SLOT:
            setattr(self, name, getattr(self, name)[keep])
        self.hits >>= 1
        self.at = (np.cumsum(self.size) - self.size.ravel()).reshape(self.size.shape).astype(np.uint32)
        self.filled = len(self.pool)
        stay = new[self.slot] >= 0
        self._order(self.keys[stay], new[self.slot[stay]])


class Digests:
    """128 bits of digest for parts of a string, from prefix sums of two polynomials modulo 2**64."""

    _SYMBOLS = [np.random.Generator(np.random.PCG64(20 + k)).integers(0, 2**63, 1 << 16, dtype=np.uint64) * _U(2) + _U(1) for k in (0, 1)]
    _STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    _UP: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
    _DOWN: list[np.ndarray] = [np.ones(1, np.uint64)] * 2

    @classmethod
    def of(cls, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        out = [np.empty(len(start), np.uint64) for _ in cls._STEPS]
        at = 0
        while at < len(start):  # a stretch of parts that fits a cache, or a single one
            to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 17), side="right")))
            some, a, b = codes[start[at] : end[to - 1]], start[at:to] - start[at], end[at:to] - start[at]
            n = len(some) + 1
            for k, step in enumerate(cls._STEPS):
                if len(cls._UP[k]) < n:
                    for powers, x in ((cls._UP, step), (cls._DOWN, pow(step, -1, 2**64))):
                        powers[k] = np.cumprod(np.concatenate([[_U(1)], np.full((1 << n.bit_length()) - 1, _U(x))]), dtype=np.uint64)
                symbols = cls._SYMBOLS[k][some & 0xFFFF] + (some >> 16) * _U(step)
                sums = np.concatenate([[_U(0)], np.cumsum(symbols * cls._UP[k][: n - 1], dtype=np.uint64)])
                x = (sums[b] - sums[a]) * cls._DOWN[k][a] + (b - a).astype(np.uint64)
                x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
                out[k][at:to] = x ^ (x >> _U(33))
            at = to
        return out
