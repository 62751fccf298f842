"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice: its edges are the vocabulary's pieces where they occur, and a path's score is
the sum of its pieces' scores. A forward Viterbi pass gives every position the best score of
reaching it from the start. An A* search then runs backward from the end: what it has is exact, and
the forward score is the exact rest, so paths come out in the order of their scores, the first
without a detour.

The vocabulary comes from merges: its file scores a piece by its rank alone, and sums of ranks mean
nothing. So a piece's score is the logarithm of its share under Zipf's law at that rank, as a
unigram model would have it: a path's score is then a log-probability.

Where no piece of the vocabulary spans the place between two characters, every path passes it. A
text is cut at such places into parts; a part's N best paths are searched once and remembered up to a
bound, and the N best of the text are put together from the parts' paths by what these lose
against the best. The parts of one length are searched together, all by one step at a time, and the texts
of a batch are put together at once. Cuts, memory and searching together change the time and never the result.

Text is written with U+2581 for spaces and one such sign before it, as the model was made with
(its other normalization is the identity). A character that no piece covers is spelled in
byte pieces; such a spelling scores ``PENALTY`` below the lowest piece for each byte, so it is
taken only where nothing else reaches. Pieces of user-defined kind (runs of spaces) score 0. Scores
are whole multiples of 2**-20, so sums are exact. Of paths with equal scores the one with the longer last
piece comes first, then the longer one before it, and so on.

Decoding joins pieces and bytes, and takes the added sign off.

Defined cases: null and empty texts have no piece, one path with score 0; a text that contains
U+2581 itself decodes with a space there, as the library's does, every other text decodes to itself; a
null doc_id is kept; rows that repeat are encoded each; texts of any length are encoded whole; an empty
table gives an empty result; columns that are not asked for are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import map_arrow, slices
from .memory import Memory, ragged

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
#: Ranks above this mark pieces that the model's makers added by hand.
USER_DEFINED = 1e8

#: One unit of score is so many steps.
ONE = 1 << 20

#: Remembered parts, and ids of their paths.
REMEMBERED, REMEMBERED_IDS = 160_000, 3_000_000

#: Paths of a text that the query and the pipeline write.
PATHS = 4

#: Longest part that is searched together with others.
_TOGETHER = 24

_U = np.uint64
_STEP, _SPREAD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)

#: More than any path loses against the best one.
_FAR = 1 << 34
#: Bits for a part's place in a text, and one more, in the number that compares what parts lose.
_PLACE = 28

#: No entry, and the first one, of the search over many parts.
_NONE, _ROOT = -(1 << 61), ((1 << 24) - 1) << 5

Path = tuple[float, tuple[int, ...]]  # score, ids


#: A part's path: score, place in the order of equal scores, ids. Paths are listed best first.
Ranked = tuple[int, int, bytes]


def _ranked(paths: list[tuple]) -> list[Ranked]:
    """Paths (score, what orders equal scores, ids), with its place in that order instead of the second."""
    rank = {o: k for k, o in enumerate(sorted(p[1] for p in paths))}
    return [(score, rank[o], ids) for score, o, ids in paths]


def _leaving(parts: list[list[Ranked]], n: int) -> list[int]:
    """The n - 1 parts that the second to n-th best paths can leave the best path in.

    Parts choose independently. A path that leaves the best one in some part is behind the one that
    leaves it there only, so n - 1 parts are enough: those where that comes first. Of equal scores the
    order from the end decides."""
    near = []
    for k, paths in enumerate(parts):
        if len(paths) > 1:
            late = paths[1][1] > paths[0][1]
            near.append((paths[0][0] - paths[1][0], late, k if late else -k, k))
    return sorted(k for *_, k in sorted(near)[: n - 1])


def _choices(options: list[list[tuple[int, int]]], n: int) -> list[tuple[int, tuple, tuple]]:
    """The n best ways to take one path (loss, rank) of each of some parts: (loss in all, ranks from the end, choices)."""
    found = [(0, (), ())]
    for of_part in options:
        found = sorted((lost + x, (r, *order), (*took, c)) for lost, order, took in found for c, (x, r) in enumerate(of_part))[:n]
    return found


def _together(parts: list[list[Ranked]], n: int) -> list[tuple]:
    """The n best paths of parts together: (score, what orders equal scores, ids), best first."""
    ids, best, chosen = [p[0][2] for p in parts], sum(p[0][0] for p in parts), _leaving(parts, n)
    out = []
    for lost, order, took in _choices([[(parts[k][0][0] - s, r) for s, r, _ in parts[k]] for k in chosen], n):
        own = list(ids)
        for k, c in zip(chosen, took, strict=True):
            own[k] = parts[k][c][2]
        out.append((best - lost, order, b"".join(own)))
    return out


class Lattice:
    """A vocabulary, and the searches over the lattices it spans."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        self.texts, self.ids, self.byte = [], {}, {}
        for i in range(model.get_piece_size()):
            piece, rank = model.id_to_piece(i), -model.get_score(i)
            if model.is_byte(i):
                self.byte[i] = int(piece[3:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = (i, 0.0 if rank > USER_DEFINED else -math.log(rank + 1))
            self.texts.append(piece)
        share = math.log(sum(math.exp(s) for _, s in self.ids.values() if s < 0))
        self.ids = {p: (i, round((s - share) * ONE) if s < 0 else 0) for p, (i, s) in self.ids.items()}
        self.byte_ids = {b: i for i, b in self.byte.items()}
        self.byte_score = min(s for _, s in self.ids.values()) - round(PENALTY * ONE)
        self.longest = max(map(len, self.ids))
        #: Every beginning of a piece, with what the piece is that it makes up, if it does.
        self.begins = {p[:k]: self.ids.get(p[:k]) for p in self.ids for k in range(1, len(p) + 1)}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # Coarse places that no piece spans: before a sign, and between a letter and another character.
        letters = re.compile(r"[^\W\d_]")
        odd = {c for a, b in self.pairs if SPACE not in (a, b) and bool(letters.match(a)) != bool(letters.match(b)) for c in (a, b) if not c.isalpha()}
        safe = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        letter = rf"[^\W\d_{re.escape(''.join(sorted(odd)))}]"
        kind = re.compile(letter)
        safe &= all(SPACE in p or bool(kind.match(p[0])) == bool(kind.match(p[1])) for p in self.pairs)
        self.coarse = re.compile(rf"{SPACE}*(?:{letter}+|(?:(?!{letter})[^{SPACE}])+)|{SPACE}+") if safe else None
        #: The same by code point: 0 for the sign, 1 for letters as above, 2 for the rest.
        self.kinds = np.full(sys.maxunicode + 1, 2, np.uint8)
        for run in re.finditer(f"{letter}+", "".join(map(chr, range(sys.maxunicode + 1)))):
            self.kinds[run.start() : run.end()] = 1
        self.kinds[ord(SPACE)] = 0
        self.known: dict[int, Memory] = {}
        self.table = self._table()
        spelled = [bytes([self.byte[i]]) if i in self.byte else t.replace(SPACE, " ").encode("utf-8") for i, t in enumerate(self.texts)]
        size = np.array([len(x) for x in spelled])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(size) - size, size

    # -- one segment ------------------------------------------------------------------------

    def edges(self, text: str) -> tuple[list[list[tuple]], list]:
        """By end position, (start, score, id or ids) of what may come last there; and the forward pass:
        the best score of reaching each position."""
        begins, size = self.begins, len(text)
        edges: list = [[] for _ in range(size + 1)]
        forward = [0] + [-math.inf] * size
        for start in range(size):
            here = forward[start]
            for end in range(start + 1, size + 1):
                got = begins.get(text[start:end], 0)
                if got == 0:
                    break
                if got is not None:
                    edges[end].append((start, got[1], got[0]))
                    if here + got[1] > forward[end]:
                        forward[end] = here + got[1]
            if begins.get(text[start]) is None:
                spelled = tuple(self.byte_ids[b] for b in text[start].encode("utf-8", "surrogatepass"))
                edges[start + 1].append((start, self.byte_score * len(spelled), spelled))
                forward[start + 1] = max(forward[start + 1], here + self.byte_score * len(spelled))
        return edges, forward

    def search(self, text: str, n: int) -> list[Path]:
        """The n best paths over a text's lattice, best first."""
        return [(score / ONE, ids) for score, _, ids in self._search(text, n)]

    def _search(self, text: str, n: int) -> list[tuple[int, tuple, tuple]]:
        """The n best paths: (score, starts of the pieces from the end, ids).

        The open entries stand in the order of their pieces from the end, longer ones first; an entry's
        successors take its place, so no two paths are ever compared. The rest being exact, each
        entry leads to a path as good as it says and no two to the same one: of the open entries, as
        many as paths are still missing are enough."""
        edges, forward = self.edges(text)
        # known + rest, position, known, path so far from the end
        open_, found = [(forward[-1], len(text), 0, None)], []
        while open_ and len(found) < n:
            k = max(range(len(open_)), key=lambda i: open_[i][0])  # of equal ones the first
            _, at, known, path = open_.pop(k)
            if at == 0:
                ids, starts = [], []
                while path:
                    got, start, path = path
                    ids += (got,) if type(got) is int else got
                    starts.append(start)
                found.append((known, tuple(reversed(starts)), tuple(ids)))
                continue
            open_[k:k] = [(known + score + forward[start], start, known + score, (got, start, path)) for start, score, got in edges[at]]
            if len(open_) > (room := n - len(found)):
                kept = sorted(range(len(open_)), key=lambda i: -open_[i][0])[:room]
                open_ = [open_[i] for i in sorted(kept)]
        return found

    # -- whole texts ------------------------------------------------------------------------

    def _part(self, part: str, n: int) -> list[Ranked]:
        """The n best paths of one part, segment by segment."""
        segments = []
        for s in self.cut(part):
            segments.append(_ranked([(score, starts, array("I", ids).tobytes()) for score, starts, ids in self._search(s, n)]))
        return segments[0] if len(segments) == 1 else _ranked(_together(segments, n))

    def cut(self, text: str) -> list[str]:
        """The segments between places that no piece spans."""
        pairs, out, begin = self.pairs, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                out.append(text[begin:i])
                begin = i
        out.append(text[begin:])
        return out

    def _words(self, text: str) -> list[str]:
        written = SPACE + text.replace(" ", SPACE)
        return self.coarse.findall(written) if self.coarse else self.cut(written)

    def nbest(self, text: str | None, n: int) -> list[Path]:
        """The n best paths of a whole text, by itself and without memory."""
        parts = [self._part(w, n) for w in self._words(text)] if text else []
        return [(score / ONE, tuple(np.frombuffer(ids, "<u4").tolist())) for score, _, ids in _together(parts, n)]

    def encode(self, text: str | None) -> tuple[bytes, float, float]:
        """Best ids as little-endian unsigned 32-bit integers, their score, and how far the second
        best path is below it (infinite if there is none)."""
        (score, ids), *more = self.nbest(text, 2)
        return array("I", ids).tobytes(), score, score - more[0][0] if more else math.inf

    # -- many parts at once -----------------------------------------------------------------

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """An open-addressing table of the pieces by their digests: (digests, ids, scores, probes)."""
        size = 1 << 18
        keys, ids, scores, most = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int32), 0
        for piece, (i, score) in self.ids.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in piece:
                    h = h * _STEP + np.uint64(ord(c) + 1)
                slot, probes = int((h * _SPREAD) >> np.uint64(64 - 18)), 1
            while keys[slot]:
                slot, probes = (slot + 1) % size, probes + 1
            keys[slot], ids[slot], scores[slot], most = h, i, score, max(most, probes)
        return keys, ids, scores, most

    def learn(self, memory: Memory, slots: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """The n best paths of the parts codes[start : start + size]: what ``search`` finds, for all parts of one
        length together. Parts with a character that has no piece, and very long ones, are searched by themselves."""
        alone = [np.flatnonzero(size > _TOGETHER)]
        for n in np.unique(size[size <= _TOGETHER]).tolist():
            some = np.flatnonzero(size == n)
            for at in range(0, len(some), 2048):
                own = some[at : at + 2048]
                alone.append(own[~self._learn(memory, slots[own], codes[start[own] + np.arange(n)[:, None]])])
        for i in np.concatenate(alone).tolist():
            paths = self._part(codes[start[i] : start[i] + size[i]].tobytes().decode("utf-32-le", "surrogatepass"), memory.n)
            best = paths[0][0]
            rows = [(best - s, r, ids) for s, r, ids in paths] + [(_FAR, 0, b"")] * (memory.n - len(paths))
            loss, rank, ids = zip(*rows, strict=True)
            one = [np.array([x], np.int64) for x in (loss, rank, [len(x) // 4 for x in ids])]
            memory.put(slots[i : i + 1], np.array([best]), *one, np.frombuffer(b"".join(ids), "<u4"))

    def _learn(self, memory: Memory, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Learns parts of one length, a column each; which ones: those whose characters all have pieces."""
        paths, (size, n), (keys, ids, scores, probes) = memory.n, codes.shape, self.table
        codes = codes.astype(np.uint64) + _U(1)
        widest = min(self.longest, size)
        none = -(1 << 29)  # lower than any path's score here; sums of three stay in range
        edge = np.full((size + 1, widest + 1, n), none, np.int32)  # by end and width
        name = np.zeros((size + 1, widest + 1, n), np.int32)
        forward = np.full((size + 1, n), none, np.int32)
        forward[0] = 0
        for start in range(size):
            h = np.zeros(n, np.uint64)
            for width in range(1, min(widest, size - start) + 1):
                h = h * _STEP + codes[start + width - 1]
                slot = ((h * _SPREAD) >> _U(64 - 18)).astype(np.int64)
                score, got = edge[start + width, width], name[start + width, width]
                hit = np.flatnonzero(keys[slot] == h)
                score[hit], got[hit] = scores[slot[hit]], ids[slot[hit]]
                away = np.flatnonzero((keys[slot] != h) & (keys[slot] != 0))  # perhaps in a slot behind
                for _ in range(probes - 1):
                    if not len(away):
                        break
                    slot = (slot[away] + 1) & (len(keys) - 1) if len(slot) == n else (slot[further] + 1) & (len(keys) - 1)
                    here = keys[slot]
                    met = np.flatnonzero(here == h[away])
                    score[away[met]], got[away[met]] = scores[slot[met]], ids[slot[met]]
                    further = np.flatnonzero((here != h[away]) & (here != 0))
                    away = away[further]
                np.maximum(forward[start + width], forward[start] + score, out=forward[start + width])
        whole = (edge[1:, 1] > none).all(axis=0)
        used = [w for w in range(widest, 0, -1) if (edge[:, w] > none).any()]
        # The search, one step of all parts at a time. An open entry is one number: the negative of what
        # it loses against the best path, then the ends of its pieces from the end of the part (the
        # complement of a bit for each, so that of equal ones the greatest has the longest pieces),
        # then its place. A successor's number is its entry's plus a number of the edge alone.
        step = np.full((len(used), size + 1, n), _NONE, np.int64)
        for w, out in zip(used, step, strict=True):
            for end in range(w, size + 1):
                lost = (edge[end, w] + forward[end - w] - forward[end]).astype(np.int64)
                np.copyto(out[end], (lost << 30) + (w - (1 << (29 - (size - end) - w))), where=edge[end, w] > none)
        step = step.reshape(len(used), (size + 1) * n)
        every = np.flatnonzero(whole)
        found, count = np.full((paths, n), _NONE, np.int64), np.zeros(n, np.int64)
        best = [np.full(len(every), _NONE, np.int64) for _ in range(paths)]  # open entries, best first
        best[0][:] = _ROOT
        while len(every):
            top = best[0]
            place, live = top & 31, (top > _NONE // 2) & (count[every] < paths)
            done = np.flatnonzero((place == size) & live)
            cols = every[done]
            found[count[cols], cols] = top[done]
            count[cols] += 1
            stay = live & (count[every] < paths)
            if 4 * np.count_nonzero(stay) < 3 * len(stay):
                every, place, live, *best = (x[stay] for x in (every, place, live, *best))
                top = best[0]
            best = [*best[1:], np.full(len(every), _NONE, np.int64)]
            top = np.maximum(top, _NONE)
            at = np.where(live, size - place, 0) * n + every
            for out in step:
                new = top + out.take(at)
                for k in range(paths - 1):
                    best[k], new = np.maximum(best[k], new), np.minimum(best[k], new)
                best[-1] = np.maximum(best[-1], new)
        # pieces in the order of the text, path by path, the paths of a part one after another
        part, rank = np.nonzero(found.T > _NONE // 2)
        key = found[rank, part]
        ends = ((_ROOT | 31) - (key & ((1 << 30) - 1))) >> 5
        row, start = np.nonzero(ends[:, None] >> (24 - size + np.arange(size)) & 1)
        end = np.append(start[1:], size)
        end[:-1][row[1:] != row[:-1]] = size
        taken = name[end, end - start, part[row]].astype(np.uint32)
        # by part and path, those that are not there far behind
        loss, order, n_ids = np.full((n, paths), _FAR, np.int64), np.full((n, paths), 1 << 62, np.int64), np.zeros((n, paths), np.int64)
        loss[part, rank], order[part, rank], n_ids[part, rank] = -(key >> 30), ends, np.bincount(row, minlength=len(key))
        good = np.flatnonzero(whole)
        place = order[good].argsort(axis=1).argsort(axis=1)
        memory.put(slots[good], forward[size][good].astype(np.int64), loss[good], place, n_ids[good], taken)
        return whole

    # -- many texts at once -----------------------------------------------------------------

    def _cut_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points of all texts as they are written, where each part begins, number of parts of each text)."""
        full = [t for t in texts if t]
        codes = np.frombuffer("".join([SPACE + t for t in full]).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        edge = np.zeros(len(codes), bool)
        if self.coarse:
            kind = self.kinds[codes]
            # a run of signs goes with what follows it; then wherever the kind changes
            edge[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        else:
            sizes_of_parts = [len(w) for t in full for w in self._words(t)]
            edge[np.cumsum(sizes_of_parts) - sizes_of_parts] = True
        edge[begins[sizes > 0]] = True
        start = np.flatnonzero(edge)
        return codes, start, np.searchsorted(start, begins + sizes) - np.searchsorted(start, begins)

    def encode_batch(self, texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, np.ndarray]]]]:
        """(ids, ends, scores, others): the best paths' ids one text after another and where each text's end, their
        scores, and of each text the second to the n-th best path: (score, ids). Scores in steps of ``ONE``."""
        memory = self.known.setdefault(n, Memory(n, REMEMBERED, REMEMBERED_IDS))
        codes, start, n_words = self._cut_all(texts)
        end = np.append(start[1:], len(codes))[: len(start)]
        slots, new, which = memory.slots(codes, start, end)
        if len(new):
            self.learn(memory, new, codes, start[which], end[which] - start[which])
        ids, size = memory.ids(slots)
        upto = np.concatenate([[0], np.cumsum(size)])  # where each part's ids begin
        first = np.concatenate([[0], np.cumsum(n_words)])  # where each text's parts begin
        ends, scores = upto[first[1:]], np.zeros(len(texts), np.int64)
        full = np.flatnonzero(n_words)
        others: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
        starts = first[full]
        if len(full):
            scores[full] = np.add.reduceat(memory.score[slots], starts)
        if n == 1 or not len(full):
            return ids, ends, scores, others
        # What a part's second path loses, and of equal losses, which part comes first (see ``_leaving``), in one number
        place = np.arange(len(slots)) - np.repeat(starts, n_words[full])
        late = memory.rank[slots, 1] > memory.rank[slots, 0]
        half = 1 << (_PLACE - 1)
        near = (memory.loss[slots, 1] << _PLACE) + np.where(late, half + place, half - 1 - place)
        leave = []
        for _ in range(n - 1):
            low = np.minimum.reduceat(near, starts)
            at = low & ((1 << _PLACE) - 1)
            at = np.where(at >= half, at - half, half - 1 - at)
            at = np.where(low >> _PLACE < _FAR, at, -1)
            leave.append(at)
            some = at >= 0
            near[starts[some] + at[some]] = _FAR << _PLACE
        for i, begin, *chosen in zip(full.tolist(), starts.tolist(), *(x.tolist() for x in leave), strict=True):
            chosen = sorted(begin + k for k in chosen if k >= 0)
            own = slots[chosen].tolist()
            options = [[(x, r) for x, r in zip(memory.loss[s].tolist(), memory.rank[s].tolist(), strict=True) if x < _FAR] for s in own]
            low, high = int(ends[i - 1]) if i else 0, int(ends[i])
            for lost, _, took in _choices(options, n)[1:]:
                pieces, done = [], low
                for k, s, c in zip(chosen, own, took, strict=True):
                    if c:
                        at = int(memory.at[s, c])
                        pieces += [ids[done : upto[k]], memory.pool[at : at + int(memory.size[s, c])]]
                        done = int(upto[k + 1])
                others[i].append((int(scores[i]) - lost, np.concatenate([*pieces, ids[done:high]])))
        return ids, ends, scores, others

    def nbest_all(self, texts: list[str | None], n: int) -> list[list[Path]]:
        """The n best paths of each text."""
        ids, ends, scores, others = self.encode_batch(texts, n)
        best = np.split(ids, ends[:-1]) if texts else []
        return [[(s / ONE, tuple(p.tolist())) for s, p in [(int(score), own), *more]] for own, score, more in zip(best, scores, others, strict=True)]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts in UTF-8 of ids that stand one text after another, ``ends`` where each ends."""
        data, start, size = self.spelled
        n = size[ids]
        upto = np.cumsum(n)
        at = np.repeat(start[ids] - (upto - n), n)
        at += np.arange(len(at))
        raw = data[at].tobytes()
        cuts = np.concatenate([[0], upto])[np.concatenate([[0], ends])].tolist()
        # the added space goes; bytes that are no text, as only other ids than encoded ones spell, are replaced
        return [raw[a + 1 : b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids) -> str:
        ids = np.array(ids, np.int64)
        return self.decode_all(ids, np.array([len(ids)]))[0].decode("utf-8")


@lru_cache(maxsize=2)
def lattice(path: str | None = None) -> Lattice:
    """One for each Python worker. path: a file of the sentencepiece library."""
    return Lattice(path or public_tokenizers.path(VOCABULARY))


def encode_pieces(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = (), n: int = PATHS) -> DataFrame:
    """doc_id, columns to keep, ids (array of int) and score of the best path, second (score of the
    second best, null if there is no other), others (scores and ids of the second to the n-th best)."""
    if n < 2:
        raise ValueError("n: two paths at least")

    def run(batches):
        model = lattice(path)
        for batch in batches:
            for some in slices(batch, batch.num_columns - 1, 2000, 1 << 19):
                ids, ends, scores, others = model.encode_batch(some.column(some.num_columns - 1).to_pylist(), n)
                more = [p for paths in others for p in paths]
                further = np.concatenate([p[1] for p in more]) if more else np.zeros(0, np.uint32)
                listed = pa.StructArray.from_arrays([pa.array([p[0] / ONE for p in more], pa.float64()), _lists(further, np.cumsum([len(p[1]) for p in more]))], ["score", "ids"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *some.columns[:-1],
                        _lists(ids, ends),
                        pa.array(scores / ONE, pa.float64()),
                        pa.array([paths[0][0] / ONE if paths else None for paths in others], pa.float64()),
                        pa.ListArray.from_arrays(_offsets(np.cumsum([len(paths) for paths in others])), listed),
                    ],
                    names=["doc_id", *keep, "ids", "score", "second", "others"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) if keep else ""
    return map_arrow(rows, run, f"doc_id long, {kept}ids array<int>, score double, second double, others array<struct<score: double, ids: array<int>>>")


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], ends]).astype("i4"))


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(ends), pa.array(ids.view(np.int32)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists one after another, and where each list ends."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    return np.asarray(lists.flatten()), np.cumsum(sizes)


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches):
        model = lattice(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids, ends = _flat(some.column(1))
                texts = [x.decode("utf-8") for x in model.decode_all(ids, ends)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), score, second,
    decoded_sha256 (of the decoded text in UTF-8), n_paths and others_crc32 (of the ids of all paths
    but the best, one after another; null if there is no other)."""

    def run(batches):
        model = lattice(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids, ends = _flat(some.column(1))
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                n_others = np.asarray(some.column(4).value_lengths().fill_null(0))
                other_ids, other_ends = _flat(some.column(4).flatten().field(1))
                other = memoryview(np.ascontiguousarray(other_ids, "<u4")).cast("B")
                upto = np.concatenate([[0], other_ends])[np.concatenate([[0], np.cumsum(n_others)])].tolist()
                cols = {
                    "doc_id": some.column(0),
                    "n_pieces": pa.array(ends - begins, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    "score": some.column(2),
                    "second": some.column(3),
                    "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in model.decode_all(ids, ends)], pa.string()),
                    "n_paths": pa.array(n_others + 1, pa.int64()),
                    "others_crc32": pa.array([zlib.crc32(other[4 * a : 4 * b]) if a < b else None for a, b in zip(upto, upto[1:], strict=False)], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_pieces long, ids_crc32 long, score double, second double, decoded_sha256 string, n_paths long, others_crc32 long"
    return map_arrow(encoded.select("doc_id", "ids", "score", "second", "others"), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
