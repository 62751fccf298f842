"""Byte-level BPE with the tokenizers library, remembering what it returned for recurring pieces.

Byte-level BPE never merges across pre-tokens. A text is cut at places where a pre-token ends whatever
stands around: where the kind of character changes (letter, number, white space, other), but for the one
space that goes with what follows it, and for what follows an apostrophe. Nearly every part is then one
pre-token, and parts recur: all parts of a batch are looked up at once in a bounded memory, and those
that are new are encoded by the library. Forgetting changes the time and never the ids. Which characters
are letters and numbers is asked of the library, whose tables need not be as new as others.

The tokenizer's added tokens (``<|endoftext|>``) are found first, as the library does it: a text is
cut at them, each is its own id, and what lies between is encoded as a text of its own.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .memory import Memory
from .remember import Remembered

VOCABULARY = "byte_bpe_50k.json"

#: What this vocabulary's byte-level pre-tokenizer takes as a pre-token after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Remembered parts, and their ids.
REMEMBERED, REMEMBERED_IDS = 400_000, 4_000_000
#: Remembered numbers of tokens of pre-tokens, of a generation, and the longest pre-token that is remembered.
COUNTED, LONGEST = 200_000, 64

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level BPE writes for each byte: itself where it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in prints else next(others) for b in range(256)}


class Encoder:
    """Texts and pre-tokens -> ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in white space or stand as words only")
        self.added = {t.content: i for i, t in added.items()}
        self.longest_added = max(map(len, self.added), default=0)
        # at a place, the longest of those that begin there
        self.cuts = regex.compile(f"({'|'.join(map(regex.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.space = chr(self.letters[0x20])
        self.memory = Memory(1, REMEMBERED, REMEMBERED_IDS)
        #: The number of tokens of a pre-token.
        self.counts = Remembered(lambda token: len(self._token(token)), COUNTED, LONGEST)
        self.kinds = self._kinds()

    def _kinds(self) -> np.ndarray:
        """By code point: letter, number, white space or other, as the library sees it."""
        out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        # no letters, numbers or white space are assigned behind the third plane's first quarter
        every = "".join(chr(c) for c in range(0x34000) if not 0xD800 <= c < 0xE000)
        points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        for kind, which in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for run in regex.finditer(which, every):
                out[points[run.start() : run.end()]] = kind
        for _, (a, b) in Split(Regex(r"[\p{L}\p{N}\s]+"), "removed").pre_tokenize_str(every):
            out[points[a:b]] = _OTHER
        return out

    def has_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def pre_tokens(self, text: str) -> list[str]:
        if not text:
            return []
        if self.has_added(text):
            return [t for x in self.cuts.split(text) for t in ([x] if x in self.added else self.pre_tokens(x))]
        start = self._cut(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64)).tolist()
        parts = [text[a:b] for a, b in zip(start, [*start[1:], len(text)], strict=True)]
        return [t for x in parts for t in self._apart(x)] if "'" in text else parts

    def _apart(self, part: str) -> tuple[str, ...]:
        """The pre-tokens of a part: one, but for a part in which letters follow an apostrophe."""
        at = part.rfind("'") + 1
        if not 0 < at < len(part) or self.kinds[ord(part[at])] != _LETTER:
            return (part,)
        if at == 1:
            for x in CONTRACTIONS:
                if part.startswith(x, 1):
                    return (part,) if len(part) == 1 + len(x) else (part[: 1 + len(x)], part[1 + len(x) :])
        return part[:at], part[at:]

    def _token(self, token: str) -> list[int]:
        if token in self.added:
            return [self.added[token]]
        return [x.id for x in self.model.tokenize(token.encode().decode("latin1").translate(self.letters))]

    def _part(self, part: str) -> list[int]:
        if part.isascii():  # the usual case: a word, mostly with a space before it
            if part.isalpha():
                return [x.id for x in self.model.tokenize(part)]
            if part[0] == " " and part[1:].isalpha():
                return [x.id for x in self.model.tokenize(self.space + part[1:])]
        if "'" in part:
            return [i for token in self._apart(part) for i in self._token(token)]
        return self._token(part)

    def _cut(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where the parts begin of texts that are not empty, one after another. begins: where each text does."""
        kind = self.kinds[codes]
        space = kind == _SPACE
        first = np.zeros(len(codes), bool)
        first[begins] = True
        # a character's successor in its text is no white space (the end of a text counts as white space)
        follows = np.zeros(len(codes), bool)
        follows[:-1] = ~space[1:] & ~first[1:]
        edge = first.copy()
        a, b, here = space[:-1], space[1:], codes[:-1]
        edge[1:] |= (kind[1:] != kind[:-1]) & ~a & ~((here == 0x27) & (kind[1:] == _LETTER))  # what is no white space ends
        edge[1:] |= a & ~b & (here != 0x20)  # the last white space character, if no space, ends before what follows
        edge[1:] |= a & b & follows[1:]  # the last one is by itself, or goes with what follows
        return np.flatnonzero(edge)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): what the library returns for each text, one after another, and where each text's ids end."""
        if any(t and self.has_added(t) for t in texts):
            return self._with_added(texts)
        codes = np.frombuffer("".join([t for t in texts if t]).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t or "") for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        start = self._cut(codes, begins[sizes > 0])
        end = np.append(start[1:], len(codes))[: len(start)]
        slots, new, which = self.memory.slots(codes, start, end)
        if len(new):
            found = [self._part(codes[a:b].tobytes().decode("utf-32-le")) for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]
            size = np.fromiter(map(len, found), np.int64, len(found))[:, None]
            zero = np.zeros_like(size)
            self.memory.put(new, zero[:, 0], zero, zero, size, np.array([i for x in found for i in x], np.uint32))
        ids, size = self.memory.ids(slots)
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, begins + sizes)]

    def _with_added(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.cuts.split(t) if t else [""] for t in texts]
        ids, ends = self.encode_batch([None if x in self.added else x for own in parts for x in own])
        of = np.concatenate([[0], np.cumsum([len(own) for own in parts])])
        flat = [(int(k), self.added[x]) for k, x in enumerate(x for own in parts for x in own) if x in self.added]
        at = np.array([k for k, _ in flat], np.int64)
        more = np.zeros(len(ends), np.int64)
        more[at] = 1
        ids = np.insert(ids, ends[at], [i for _, i in flat])
        return ids, np.concatenate([[0], ends + np.cumsum(more)])[of[1:]]

    def ids(self, text: str) -> list[int]:
        """What the library returns for one text."""
        return self.encode_batch([text])[0].tolist()


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One for each Python worker. path: a file of the tokenizers library."""
    return Encoder(path or public_tokenizers.path(VOCABULARY))
