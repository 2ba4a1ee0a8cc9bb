"""Normalized and fuzzy views of a text, with the way back to its code points.

Normalization looks at one code point at a time, so tables from characters to replacements decide
it, filled as characters turn up. Texts without droppable, expanding or combining characters are
translated in one call and keep their offsets; others go through a loop that records them. Texts of
some length are looked up as arrays of code points.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from termsieve.config import FuzzyOptions, NormalizeOptions
from termsieve.functions import tables

_MARK = None
_STAYS, _LOWERS, _BECOMES, _MOVES = range(4)
_UNKNOWN = 255
_LONG = 256
_POINTS = 0x110000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def from_code_points(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


class Gaps:
    """Positions of a folded text before which separators were dropped, told from what was kept of n."""

    def __init__(self, kept: np.ndarray, n: int):
        self.kept, self.n = kept, n

    def __contains__(self, at: int) -> bool:
        before = self.kept[at - 1] if at else -1
        here = self.kept[at] if at < len(self.kept) else self.n
        return here - before > 1


@dataclass
class View:
    """text; the half-open origin of each of its characters; positions after dropped separators.

    Without starts, offsets are the original's; without ends, each character comes from one.
    """

    text: str
    starts: list[int] | np.ndarray | None = None
    ends: list[int] | np.ndarray | None = None
    breaks: frozenset[int] | set[int] | Gaps = frozenset()

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Code points of the original text that view positions start..end come from."""
        n = len(self.text)
        if self.starts is None:
            start = max(0, min(start, n))
            return start, max(start, min(end, n))
        if not n:
            return 0, 0
        start = max(0, min(start, n - 1))
        last = max(start + 1, min(end, n)) - 1
        return int(self.starts[start]), int(self.starts[last]) + 1 if self.ends is None else int(self.ends[last])


class Normalizer:
    """The normalized view under one set of options."""

    def __init__(self, options: NormalizeOptions):
        self.o = options
        self.simple = dict(options.simplified) if options.simplified is not None else tables.common_simplified()
        # Characters by ordinal for str.translate; a missing one is worked out once.
        self.table = _Table(self.replacement)
        # What a character does: stays, is lower-cased, becomes another one, or anything else.
        self.kinds = _Kinds(self.replacement, options.lowercase)
        self.finders: dict[frozenset[str], re.Pattern] = {}
        # The same by code point, for long texts.
        self.kind_of = np.full(_POINTS, _UNKNOWN, np.uint8)
        self.becomes = np.arange(_POINTS, dtype=np.uint32)

    def replacement(self, char: str) -> str | None:
        """What a character becomes: nothing, one or more characters; None for a combining mark."""
        o = self.o
        if o.strip_invisible and tables.is_invisible(char):
            return ""
        if o.unify_whitespace and char in tables.WHITESPACE:
            return " "
        if char.isascii():
            return char.lower() if o.lowercase else char
        if o.strip_combining_marks and char >= "\u0300" and unicodedata.category(char) == "Mn":
            return _MARK
        if "\u4e00" <= char <= "\u9fff":
            return self.simple.get(char, char) if o.simplify_chinese else char
        wide = unicodedata.normalize("NFKC", char) if o.nfkc else char
        if o.lowercase:
            wide = "".join(c.lower() for c in wide) if len(wide) > 1 else wide.lower()
        if o.simplify_chinese:
            wide = "".join(self.simple.get(c, c) for c in wide)
        if o.unify_whitespace:
            wide = "".join(" " if c in tables.WHITESPACE else c for c in wide)
        return wide

    def view(self, text: str) -> View:
        if text.isascii():
            low = text.lower() if self.o.lowercase else text
            return View(low.translate(_ASCII_BLANKS) if self.o.unify_whitespace else low)
        if len(text) >= _LONG:
            return self._long_view(text)
        kinds = self.kinds
        odd = [c for c in set(text) if kinds[c]]
        moving = frozenset(c for c in odd if kinds[c] == _MOVES)
        if moving:
            return self._moved(text, moving)
        if all(kinds[c] == _LOWERS for c in odd):
            return View(text.lower() if odd else text)
        # Few characters are exchanged one after the other, unless one becomes another of them.
        if len(odd) <= 12 and not any(self.table[ord(c)] in odd for c in odd):
            for c in odd:
                text = text.replace(c, self.table[ord(c)])
            return View(text)
        return View(text.translate(self.table))

    def _long_view(self, text: str) -> View:
        points = code_points(text)
        kinds = self.kind_of[points]
        most = kinds.max()
        if most == _UNKNOWN:
            for p in np.unique(points[kinds == _UNKNOWN]).tolist():
                self.kind_of[p] = kind = self.kinds[chr(p)]
                if kind in (_LOWERS, _BECOMES):
                    self.becomes[p] = ord(self.table[p])
            kinds = self.kind_of[points]
            most = kinds.max()
        if most == _STAYS:
            return View(text)
        if most == _MOVES:
            return self._moved(text, frozenset(map(chr, np.unique(points[kinds == _MOVES]).tolist())))
        return View(from_code_points(self.becomes[points]))

    def _moved(self, text: str, moving: frozenset[str]) -> View:
        if moving not in self.finders:
            if len(self.finders) >= 1000:
                self.finders.clear()
            self.finders[moving] = re.compile("[" + "".join(map(re.escape, sorted(moving))) + "]")
        out: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for found in self.finders[moving].finditer(text):
            i = found.start()
            if i > at:
                out.append(text[at:i].translate(self.table))
                starts.extend(range(at, i))
                ends.extend(range(at + 1, i + 1))
            at = i + 1
            r = self.table[ord(text[i])]
            if r is _MARK:
                # A mark belongs to the character before it; without one it goes.
                if out:
                    both = unicodedata.normalize("NFC", out[-1][-1] + text[i])
                    if len(both) == 1:
                        out[-1] = out[-1][:-1] + both
                    ends[-1] = i + 1
            elif r:
                out.append(r)
                starts.extend([i] * len(r))
                ends.extend([i + 1] * len(r))
        out.append(text[at:].translate(self.table))
        starts.extend(range(at, len(text)))
        ends.extend(range(at + 1, len(text) + 1))
        return View("".join(out), starts, ends)

    def string(self, text: str) -> str:
        return self.view(text).text

    def strings(self, texts: list[str]) -> list[str]:
        """The normalized form of each text, in one call for all: nothing combines with the zero character between them."""
        if not texts:
            return []
        whole = "\0".join(texts)
        return self.view(whole).text.split("\0") if whole.count("\0") == len(texts) - 1 else [self.string(t) for t in texts]


_ASCII_BLANKS = {ord(c): " " for c in tables.WHITESPACE if c.isascii()}


class _Table(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: int):
        value = self[key] = self.make(chr(key))
        return value


class _Kinds(dict):
    def __init__(self, replacement, lowercase: bool):
        super().__init__()
        self.replacement, self.lowercase = replacement, lowercase

    def __missing__(self, char: str) -> int:
        r = self.replacement(char)
        # Capital sigma is lower-cased by its place in a word, which a single character doesn't have.
        if r is _MARK or len(r) != 1:
            value = _MOVES
        elif r == char and (not self.lowercase or char.lower() == char):
            value = _STAYS
        elif self.lowercase and char != "\u03a3" and char.lower() == r:
            value = _LOWERS
        else:
            value = _BECOMES
        self[char] = value
        return value


@lru_cache(maxsize=8)
def _folding(leetspeak: bool, strip_separators: bool) -> tuple[dict[int, str | None], np.ndarray, np.ndarray]:
    """A table for str.translate, and by code point what is dropped and what the rest becomes."""
    leet = tables.LEET if leetspeak else {}
    gone = frozenset(tables.SEPARATORS) - frozenset(leet) if strip_separators else frozenset()
    dropped, becomes = np.zeros(_POINTS, dtype=bool), np.arange(_POINTS, dtype=np.uint32)
    dropped[[ord(c) for c in gone]] = True
    for k, v in leet.items():
        becomes[ord(k)] = ord(v)
    return {ord(k): v for k, v in leet.items()} | {ord(c): None for c in gone}, dropped, becomes


def fold(view: View, o: FuzzyOptions) -> View:
    """The fuzzy view of a normalized one: letters for look-alikes, separators dropped, runs collapsed."""
    if o.collapse_repeats or view.breaks:
        return _fold_one_by_one(view, o)
    _, dropped, becomes = _folding(o.leetspeak, o.strip_separators)
    points = code_points(view.text)
    kept = np.flatnonzero(~dropped[points])
    starts = kept if view.starts is None else np.asarray(view.starts)[kept]
    ends = None if view.ends is None else np.asarray(view.ends)[kept]
    return View(from_code_points(becomes[points[kept]]), starts, ends, Gaps(kept, len(view.text)))


def fold_all(texts: list[str], o: FuzzyOptions) -> list[str]:
    """The fuzzy form of each of some normalized texts."""
    whole = "\0".join(texts)
    if o.collapse_repeats or not texts or whole.count("\0") != len(texts) - 1:
        return [fold(View(t), o).text for t in texts]
    return whole.translate(_folding(o.leetspeak, o.strip_separators)[0]).split("\0")


def _fold_one_by_one(view: View, o: FuzzyOptions) -> View:
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    breaks: set[int] = set()
    last = None
    for i, raw in enumerate(view.text):
        if i in view.breaks:
            breaks.add(len(out))
        char = tables.LEET.get(raw, raw) if o.leetspeak else raw
        if o.strip_separators and char == raw and raw in tables.SEPARATORS:
            breaks.add(len(out))
            continue
        # Of a run only the first character counts, also across dropped separators.
        if o.collapse_repeats and char == last:
            continue
        out.append(char)
        starts.append(i if view.starts is None else view.starts[i])
        ends.append(i + 1 if view.ends is None else view.ends[i])
        last = char
    return View("".join(out), starts, ends, breaks)


@lru_cache(maxsize=16)
def normalizer(options: NormalizeOptions) -> Normalizer:
    return Normalizer(options)


def normalize_string(text: str, options: NormalizeOptions = NormalizeOptions()) -> str:  # noqa: B008
    return normalizer(options).string(text)


def fold_string(text: str, options: NormalizeOptions = NormalizeOptions(), fuzzy: FuzzyOptions = FuzzyOptions()) -> str:  # noqa: B008
    return fold(normalizer(options).view(text), fuzzy).text
