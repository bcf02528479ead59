"""Cuts of texts at lone spaces, where no match of a byte-level pre-tokenizer pattern can span.

A match of such a pattern holds a space only as its first character or inside a run of white space.  So a text may be
cut before every space that stands between two other characters that are no white space, and each cut may be encoded on
its own and remembered.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable

_RARE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_RARE_ASCII = [c for c in _RARE if c.isascii()]
_LONE = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> tuple[str, list[str]]:
    """The first piece, and the others without the one space that each of them starts with."""
    if "  " in text or " \n" in text or "\n " in text or any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE)):
        first, *rest = _LONE.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


class Memo:
    """What fn makes of strings, remembered in two generations of at most `most` bytes together.

    What is asked for again moves to the young generation; when that is full, it becomes the old one.  So frequent strings
    stay, and rare ones go, whatever their number.  Strings over `longest` characters are not remembered."""

    def __init__(self, fn: Callable[[list[str]], list[bytes]], most: int, longest: int = 200):
        self.fn, self.half, self.longest = fn, most // 2, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def table(self, asked: Iterable[str]) -> dict[str, bytes]:
        """The values of the distinct strings; those not known go through fn together."""
        young, out, later = self.young, {}, []
        for x in asked:
            v = young.get(x)
            if v is None:
                later.append(x)
            else:
                out[x] = v
        old = self.old
        again = {x: v for x in later if (v := old.get(x)) is not None}
        new = [x for x in later if x not in again]
        if new:
            again.update(zip(new, self.fn(new)))
        out.update(again)
        for x, v in again.items():
            if len(x) <= self.longest:
                young[x] = v
                # A slot of the dictionary takes about 100 bytes.
                self.size += sys.getsizeof(x) + sys.getsizeof(v) + 100
                if self.size > self.half:
                    self.old, self.young, self.size = young, {}, 0
                    young = self.young
        return out


class PieceMemo:
    """Memos of first and of other pieces, over one function of whole pieces."""

    def __init__(self, fn: Callable[[list[str]], list[bytes]], most: int):
        self.firsts = Memo(fn, most // 8)
        self.others = Memo(lambda xs: fn([" " + x for x in xs]), most - most // 8)

    def joined(self, cuts: list[tuple[str, list[str]]]) -> list[bytes]:
        """What fn makes of each text's pieces, put together."""
        distinct: set[str] = set()
        for _, rest in cuts:
            distinct.update(rest)
        firsts, get = self.firsts.table({x for x, _ in cuts}), self.others.table(distinct).__getitem__
        return [firsts[first] + b"".join(map(get, rest)) for first, rest in cuts]
