"""Token counts of a public tokenizer, huge texts by overlapping chunks that are resynchronised where both agree for certain."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import batches, text_bytes

TOKENIZER = "byte_bpe_50k.json"


@dataclass(frozen=True)
class TokenParams:
    #: A file of public_tokenizers, or a path.
    tokenizer: str = TOKENIZER
    #: Longer texts, in characters, are encoded in chunks that reach so much further each ...
    chunk: int = 1 << 15
    #: ... and overlap by so many characters at first.
    overlap: int = 256
    limit: int = 512
    #: What the table of short units may hold in a process.
    cache_bytes: int = 48 << 20


_LOADED: dict = {}


def load(name: str):
    """The tokenizer, loaded once in a process."""
    if name not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        _LOADED[name] = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _LOADED[name]


_MARGINS: dict = {}


def margin(name: str) -> int | None:
    """How far from a chunk's end its pre-tokens are certain; None if the tokenizer isn't of the kind whose scan is known.

    That kind is byte-level, as it stands, without a normalizer or a space put in front: its pre-tokenizer is a scan from
    left to right, each match of which depends on what stands to its right alone, and on three characters beyond a run at
    the most. Special strings are found first; one that a chunk's end cuts can change what stands up to one character before it.
    """
    if name not in _MARGINS:
        made = json.loads(load(name).to_str())
        pre, added = made["pre_tokenizer"] or {}, made["added_tokens"]
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"])) for a in added)
        known = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and made["normalizer"] is None and plain
        _MARGINS[name] = max([len(a["content"]) for a in added], default=0) + 8 if known else None
    return _MARGINS[name]


#: Tokens of what stands between two single spaces, which nothing around it can change; one table in each process.
_UNITS: dict[str, int] = {}
_HELD = [0]
LONGEST_UNIT = 64
_UNEVEN = re.compile(r" \s|\s ")
_STABLE = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """The text cut at each space between characters that are none: a token starts there, whatever stands further off. The space opens what follows it."""
    first, *rest = _STABLE.split(text) if text[:1] == " " or text[-1:] == " " or _UNEVEN.search(text) else text.split(" ")
    return [first, *map(" ".__add__, rest)]


def by_units(tokenizer, texts: list[list[str]], cache_bytes: int) -> list[int]:
    """Tokens of texts given as units; units not met before are encoded together. Long units aren't kept, and a full table starts anew."""
    if _HELD[0] > cache_bytes:
        _UNITS.clear()
        _HELD[0] = 0
    new = list({u for t in texts for u in t if u not in _UNITS})
    counted = dict(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    short = {u: n for u, n in counted.items() if len(u) <= LONGEST_UNIT}
    _UNITS.update(short)
    _HELD[0] += sum(map(len, short)) * 2 + 150 * len(short)
    get = _UNITS.get
    return [sum(counted[u] if (n := get(u)) is None else n for u in t) for t in texts]


class Chunk:
    """The encoding of text[begin:end]: where its pre-tokens begin, and how many tokens stand before each."""

    def __init__(self, tokenizer, text: str, begin: int, end: int):
        made = tokenizer.encode(text[begin:end], add_special_tokens=False)
        words = made.word_ids
        own = np.array([-i - 2 if w is None else w for i, w in enumerate(words)], np.int64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        offsets = made.offsets
        self.begin, self.end, self.total = begin, end, len(words)
        self.places = np.array([offsets[i][0] for i in first], np.int64) + begin
        self.before = first

    def tokens_before(self, place: int) -> int:
        return int(self.before[np.searchsorted(self.places, place)])


def spliced(tokenizer, text: str, p: TokenParams, safe: int) -> int:
    """Tokens of a huge text: the sum of what overlapping chunks have between the places where they are spliced.

    A chunk that begins where a pre-token begins has the whole text's pre-tokens, but for the last ``safe`` characters.
    The next chunk begins anywhere before that; from the first place on where a pre-token begins in both, both must have
    the same ones, and there they are spliced. If there is none, the overlap widens, at last to the whole chunk.
    """
    n, total = len(text), 0
    if not n:
        return 0
    start, left = 0, Chunk(tokenizer, text, 0, min(p.chunk, n))
    while left.end < n:
        overlap, cut = max(p.overlap, 2 * safe), None
        while cut is None:
            begin = max(start, left.end - overlap)
            right = Chunk(tokenizer, text, begin, min(n, left.end + (p.chunk if begin > start else max(p.chunk, left.end - start))))
            if begin == start:  # the chunk has grown by what it was
                cut = start
                break
            sure = left.end - safe
            mine = left.places[(left.places >= begin) & (left.places <= sure)]
            theirs = right.places[right.places <= sure]
            both = np.intersect1d(mine, theirs, assume_unique=True)
            if len(both) and np.array_equal(mine[mine >= both[0]], theirs[theirs >= both[0]]):
                cut = int(both[0])
            overlap *= 8
        if cut > start:
            total += left.tokens_before(cut) - left.tokens_before(start)
        start, left = cut, right
    return total + left.total - left.tokens_before(start)


def counts(texts: list[str], p: TokenParams) -> list[int]:
    tokenizer, safe = load(p.tokenizer), margin(p.tokenizer)
    if safe is None:  # of another kind: each text as a whole
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    small = by_units(tokenizer, [units(t) if len(t) <= p.chunk else [] for t in texts], p.cache_bytes)
    return [n if len(t) <= p.chunk else spliced(tokenizer, t, p, safe) for t, n in zip(texts, small, strict=True)]


def count_tokens(docs: DataFrame, p: TokenParams = TokenParams()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Null and empty texts have no bytes and no tokens. Whole texts are encoded, as the library does by default; repeated
    rows are counted alike, other columns are not read, and an empty table gives an empty one. Texts of more than a chunk
    are spliced; one without any boundary, such as a run of letters, is encoded as a whole at last. Tokenizers of other
    kinds than byte-level ones encode each text as a whole.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text")
            _, offsets = text_bytes(texts)
            for i, j in batches(offsets, 1 << 18):
                n = counts([t or "" for t in texts.slice(i, j - i).to_pylist()], p)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").slice(i, j - i), "n_bytes": np.diff(offsets[i : j + 1]), "n_tokens": pa.array(n, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > p.limit)


def op3(docs: DataFrame, p: TokenParams = TokenParams()) -> DataFrame:
    return count_tokens(docs, p)
