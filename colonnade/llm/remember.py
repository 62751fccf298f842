"""A bounded memory of what a function returned, for words that recur by Zipf's law."""

from __future__ import annotations

from collections.abc import Callable


class Remembered(dict):
    """``self[key]`` is ``find(key)``. Two generations: when the young one is full it becomes the old
    one, and what is then still asked for moves back; so frequent keys stay and memory is bounded."""

    def __init__(self, find: Callable, bound: int, longest: int):
        self.find, self.bound, self.longest, self.old = find, bound, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        self.note(key, value)
        return value

    def note(self, key: str, value) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[key] = value
