"""Cutting a text into chunks that byte-level BPE encodes independently, and encoding each chunk once.

The pre-tokenizer's pattern never joins a non-space character with a space that follows it, and leaves one
space of any run of white space to what comes next. So a text may be cut before every space that is followed
by a character which is not white space: each chunk has the same ids alone as within the text. Words repeat
much more than texts do, hence a bounded cache of chunks per Python worker saves most of the work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

# A space followed by more white space or by the text's end: there, str.split cuts where the pattern doesn't.
_WIDE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
CACHE_CHUNKS, CACHE_CHARS = 150_000, 64


def spaced(text: str) -> list[str]:
    """The text's chunks without the space that all but the first begin with (that is empty if the text begins with such a space)."""
    return _CUT.split(text) if _WIDE.search(text) else text.split(" ")


def chunks(text: str) -> list[str]:
    """The text's chunks in order; joined, they are the text."""
    if not text:
        return []
    parts = spaced(text)
    head = [parts[0]] if parts[0] else []
    return head + [f" {p}" for p in parts[1:]]


def pieces(chunk: str, findall: Callable[[str], list[str]]) -> list[str]:
    """The chunk's pre-tokens: by ``findall`` of the pattern, unless it is a word alone or with one mark behind it, which
    most are and which needs no pattern."""
    word = chunk[1:] if chunk[0] == " " else chunk
    if word.isalpha():
        return [chunk]
    if chunk[-1] in ".,;:!?" and word[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return findall(chunk)


class ChunkCache:
    """Encodings of chunks, in two generations of at most ``limit`` chunks each: when the young one is
    full it becomes the old one, and what is still used returns to the young one."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = CACHE_CHUNKS):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, parts: list[str]) -> list[bytes]:
        """The encoding of each chunk."""
        out = list(map(self.young.get, parts))
        if None not in out:
            return out
        gaps = [i for i, ids in enumerate(out) if ids is None]
        new = {parts[i]: self.old.get(parts[i]) for i in gaps}
        if missing := [p for p, ids in new.items() if ids is None]:
            new.update(zip(missing, self.encode(missing), strict=True))
        for i in gaps:
            out[i] = new[parts[i]]
        if len(self.young) + len(new) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update((p, ids) for p, ids in new.items() if len(p) <= CACHE_CHARS)
        return out
