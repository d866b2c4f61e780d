"""Which phrases of a registry stand in a text, and where first: one pass of an automaton over the text, however many phrases there are."""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that are written otherwise but count as these, in any case; all are one character for one.
ALIKE = {0x130: "i", 0x131: "i", 0x212A: "k", 0x17F: "s"}
PLURALS = ("", "s", "es")
#: Texts that are Python objects at a time.
STEP = 256
PLACES = "array<struct<text:int,n:int,at:int>>"


@dataclass(frozen=True)
class Pattern:
    """A phrase, in any case and with its plural if so said; or a regular expression."""

    phrase: str = ""
    regex: str = ""
    plural: bool = True


def simple(text: str) -> str:
    """A text in lower case, its characters in their places."""
    if not text.isascii() and any(chr(c) in text for c in ALIKE):
        text = text.translate(ALIKE)
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Matcher:
    """All patterns at once. ``joined``: what makes one word with a neighbour, beside ASCII letters and digits; "word" stands for all that are letters, digits or underscores anywhere."""

    def __init__(self, patterns: Sequence[Pattern], joined: str = ""):
        import ahocorasick

        self.patterns, self.word = patterns, joined == "word"
        self.inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789" + ("" if self.word else joined))
        numbers: dict[str, list[int]] = {}
        for n, p in enumerate(patterns):
            if p.phrase:
                numbers.setdefault(simple(p.phrase), []).append(n)
        self.automaton = ahocorasick.Automaton()
        for phrase, ns in numbers.items():
            self.automaton.add_word(phrase, (len(phrase), ns))
        if numbers:
            self.automaton.make_automaton()
        self.any_phrase = bool(numbers)
        self.regexes = [(n, re.compile(p.regex, re.IGNORECASE)) for n, p in enumerate(patterns) if p.regex]
        # Most texts meet none: one alternation of all tells.
        self.some_regex = re.compile("|".join(f"(?:{p.regex})" for p in patterns if p.regex), re.IGNORECASE) if len(self.regexes) > 1 and not any(r.groups for _, r in self.regexes) else None

    def inside(self, text: str, at: int) -> bool:
        """True if the character there belongs to a word."""
        if not 0 <= at < len(text):
            return False
        c = text[at]
        return c.isalnum() or c == "_" if self.word else c in self.inner

    def places(self, text: str) -> dict[int, int]:
        """The first place of each pattern that stands in the text, by number."""
        out: dict[int, int] = {}
        low = simple(text)
        for end, (size, ns) in self.automaton.iter(low) if self.any_phrase else ():
            start = end + 1 - size
            if self.inside(low, start - 1):
                continue
            ends = [low.startswith(p, end + 1) and not self.inside(low, end + 1 + len(p)) for p in PLURALS]
            for n in ns:
                if ends[0] or self.patterns[n].plural and any(ends):
                    out[n] = min(start, out.get(n, start))
        if self.regexes and (self.some_regex is None or self.some_regex.search(text)):
            for n, r in self.regexes:
                if m := r.search(text):
                    out[n] = m.start()
        return out


_BUILT: dict[tuple, Matcher] = {}


def matcher(patterns: tuple[Pattern, ...], joined: str) -> Matcher:
    """One automaton for each registry in each Python worker."""
    if (patterns, joined) not in _BUILT:
        _BUILT[patterns, joined] = Matcher(patterns, joined)
    return _BUILT[patterns, joined]


def spots(m: Matcher, column: pa.Array) -> pa.Array:
    """``spotted`` of a batch."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows, ns, places = array("q"), array("i"), array("i")
    texts = column.flatten()
    # A few texts at a time are taken out of the batch, and hits are held as numbers: a batch has 10,000 rows.
    for start in range(0, len(texts), STEP):
        for i, text in enumerate(texts.slice(start, STEP).to_pylist(), start):
            if text:
                for n, place in sorted(m.places(text).items()):
                    rows.append(i)
                    ns.append(n)
                    places.append(place)
    at = np.array(rows, np.int64)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(np.bincount(row_of[at], minlength=len(sizes)), out=offsets[1:])
    parts = [at - begins[at], np.array(ns, np.int32), np.array(places, np.int32)]
    values = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in parts], ["text", "n", "at"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def spotted(texts: Column, patterns: Sequence[Pattern], joined: str = "") -> Column:
    """Of an array of texts, array<struct<text, n, at>>: which patterns, by number, stand in which texts, and where each stands first in it (all from 0), in this order.

    A phrase stands where neither neighbour belongs to a word; ``joined`` as for Matcher. Null texts and a null array
    have none. The work on a text is its length and the patterns that are in it, not the patterns that there are.
    """
    held = tuple(patterns)

    @F.arrow_udf(PLACES)
    def found(column: pa.Array) -> pa.Array:
        return spots(matcher(held, joined), column)

    return found(texts)
