"""Texts as sums over words, with a bounded memory of the words of a task.

Vocabularies of byte pairs first cut a text into words and never look across
their borders. What is true of a text (its token count, its ids) is therefore
a sum over words, and words repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import regex

MEMO = 300_000  # entries of each of two generations
LONGEST = 64  # characters of what is remembered
#: Fixed: how byte-level vocabularies of this kind cut text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Memo(dict):
    """A dict that works out missing values and forgets what was not used of late."""

    def __init__(self, work_out: Callable[[str], object]):
        super().__init__()
        self.work_out, self.old = work_out, {}

    def __missing__(self, key: str):
        value = self.old[key] if key in self.old else self.work_out(key)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        if len(key) <= LONGEST:
            self[key] = value
        return value


class ByWord:
    """``join`` over the words of a text of ``word(w)``."""

    def __init__(self, word: Callable[[str], object], join: Callable[[Iterable], object]):
        self.join = join
        self.words = Memo(word)
        self.chunks = Memo(self._chunk)

    def forget(self) -> None:
        """Give the memory back: a worker lives on after the task, beside other work."""
        for memo in (self.words, self.chunks):
            memo.clear()
            memo.old = {}

    def _all(self, text: str):
        return self.join(map(self.words.__getitem__, WORDS.findall(text)))

    def _chunk(self, chunk: str):
        """Value of a chunk between blanks; None if white space ties it to its neighbours."""
        if not chunk or chunk[-1].isspace():
            return None
        if chunk[0] == "\n":
            return None if chunk[1].isspace() else self._all(chunk)
        return None if chunk[0].isspace() else self._all(" " + chunk)

    def __call__(self, text: str):
        # no word spans a lone blank or line end between other characters: cut there first
        first, *rest = text.replace("\n", " \n").split(" ")
        if not rest or (first and (first[0].isspace() or first[-1].isspace())):
            return self._all(text)
        try:
            tail = self.join(map(self.chunks.__getitem__, rest))
        except TypeError:  # a None among them: runs of white space
            return self._all(text)
        return self.join((self._all(first), tail)) if first else tail
