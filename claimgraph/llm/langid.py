"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter row is a machine word whose bit l belongs to language l, so that one probe of a slot answers for
all languages at once, and the AND of an n-gram's slots is the set of all languages that contain it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import batches, cut, mix, text_bytes

U = np.uint64
UND = "und"


@dataclass(frozen=True)
class LangParams:
    n: tuple[int, ...] = (3, 4)
    #: Bound of the documents learnt from, by language.
    sample_docs: int = 1500
    #: Least number of slots of the filter, each with a bit for every language; and how many slots an n-gram sets.
    slots: int = 1 << 19
    probes: int = 3
    #: There are as many slots as keep the chance under this that an n-gram which no language has passes for one of the language with most n-grams.
    most_false: float = 0.1
    #: A filter of more bytes is refused: then fewer documents are to be learnt from, or more bytes or a greater chance allowed.
    most_bytes: int = 256 << 20
    #: An n-gram is in a language's first filter if the language has it at all, in the others if so many of the language's n-grams are this one.
    levels: tuple[float, ...] = (0.0, 1e-4, 1e-3)
    #: A text is of a learnt language only if that language has so much of its n-grams, chance taken off.
    least_cover: float = 0.35


def _alphabet() -> np.ndarray:
    """Each code point of the basic plane: its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def alphabet() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_alphabet())
    return _TABLE[0]


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts, each run of other characters one 0, a 0 around each text; the number of the text each stands in, and by text the number of letters."""
    n = len(column)
    data, offsets = text_bytes(column)
    starts = (data & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(starts)))[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    mapped = np.insert(alphabet()[chars], before, 0)  # a 0 in front of each text, and one at the end
    doc = np.repeat(np.arange(n + 1), np.diff(np.append(before, before[-1])) + 1)
    keep = mapped != 0
    counts = np.bincount(doc[keep], minlength=n + 1)[:n]
    keep[1:] |= (mapped[1:] == 0) & (mapped[:-1] != 0)
    keep[0] = True
    return mapped[keep].astype(np.uint64), doc[keep], counts


def ngrams(chars: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n characters with no gap between letters inside, and where they begin."""
    if len(chars) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(chars) - n + 1
    h = np.full(size, n, np.uint64)
    inner = np.ones(size, bool)
    for j in range(n):
        part = chars[j : j + size]
        h = h * U(0x9E3779B97F4A7C15) + part
        if 0 < j < n - 1:
            inner &= part != 0
    at = np.flatnonzero(inner)
    return mix(h[at]), at


def slots_of(grams: np.ndarray, probe: int, params: LangParams) -> np.ndarray:
    return (mix(grams + U((probe * 0x632BE59BD9B4E019) % 2**64)) % U(params.slots)).astype(np.int64)


def count_ngrams(langs: list[str], params: LangParams):
    place = {x: i for i, x in enumerate(langs)}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            named, texts = part.column("lang").to_pylist(), part.column("text")
            for lang in sorted(set(named)):
                own = texts.filter(pa.array([x == lang for x in named]))
                for i, j in batches(text_bytes(own)[1], 1 << 20):
                    chars, _, _ = letters(own.slice(i, j - i))
                    for n in params.n:
                        values, counts = np.unique(ngrams(chars, n)[0], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": np.full(len(values), place[lang], np.int32), "gram": values.view(np.int64), "seen": counts.astype(np.int64)})

    return run


def word_type(langs: int) -> type:
    """The smallest word with a bit for every language, or that of 64 bits."""
    return next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if langs <= bits), np.uint64)


def words_for(langs: int) -> int:
    return -(-langs // 64)


def slots_needed(grams: int, params: LangParams) -> int:
    """A power of two, or the least number given, at which ``grams`` n-grams fill so few slots that ``most_false`` is kept."""
    filled = params.most_false ** (1 / params.probes)
    need = math.ceil(-params.probes * grams / math.log(1 - filled))
    return params.slots if need <= params.slots else 1 << (need - 1).bit_length()


#: Slots of the filter that are sent together.
BLOCK = 1 << 16


def fill(totals: np.ndarray, params: LangParams):
    """(block, bits) rows: the bits that a task's n-grams set, block by block. What a task holds is as large as the filter, however many n-grams there are."""
    words, kind = words_for(len(totals)), word_type(len(totals))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((params.slots, len(params.levels) * words), kind)
        for part in parts:
            lang, gram, seen = (part.column(c).to_numpy() for c in ("lang", "gram", "seen"))
            rate, mask = seen / totals[lang], (U(1) << (lang % 64).astype(np.uint64)).astype(kind)
            for level, least in enumerate(params.levels):
                held = rate >= least
                for probe in range(params.probes):
                    np.bitwise_or.at(bits, (slots_of(gram[held].view(np.uint64), probe, params), level * words + lang[held] // 64), mask[held])
        for i in range(0, params.slots, BLOCK):
            if bits[i : i + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([i // BLOCK], pa.int32()), "bits": pa.array([bits[i : i + BLOCK].tobytes()], pa.binary())})

    return run


def united(table: pa.Table) -> pa.Table:
    """All tasks' bits of a block."""
    first, *rest = table.column("bits").to_pylist()
    bits = np.frombuffer(first, np.uint8).copy()
    for more in rest:
        bits |= np.frombuffer(more, np.uint8)
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


@dataclass(frozen=True)
class LangModel:
    params: LangParams
    langs: list[str]
    #: slots x (levels x words of up to 64 languages)
    bits: np.ndarray
    #: levels x languages: the chance that an n-gram that a filter lacks passes all probes.
    false_rate: np.ndarray

    def bit(self, masks: np.ndarray, level: int, lang: int) -> np.ndarray:
        """1 for the n-grams that the language has at the level."""
        kind = self.bits.dtype.type
        return (masks[:, level * words_for(len(self.langs)) + lang // 64] >> kind(lang % 64)) & kind(1)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits: all of them, and by chance some more."""
        out = None
        for probe in range(self.params.probes):
            row = self.bits[slots_of(grams, probe, self.params)]
            out = row if out is None else out & row
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and cover of each text: popcounts by language of the masks of its n-grams, less what chance adds.

        The counts of all levels decide: languages that merely contain each other's n-grams, as in quoted passages, are
        told apart by how common they are. The score is the best language's share of all corrected counts; the cover is
        how much of the text's n-grams it contains at all.
        """
        chars, doc, counts = letters(column)
        n, k = len(column), len(self.langs)
        hits, total = np.zeros((len(self.params.levels), n, k)), np.zeros(n)
        for size in self.params.n:
            grams, at = ngrams(chars, size)
            if not len(grams):
                continue
            masks, own = self.masks(grams), doc[at]
            total += np.bincount(own, minlength=n)[:n]
            for level in range(len(hits)):
                for i in range(k):
                    hits[level, :, i] += np.bincount(own[self.bit(masks, level, i) > 0], minlength=n)[:n]
        false = self.false_rate[:, None, :]
        right = np.clip((hits - false * total[:, None]) / np.maximum(1 - false, 1e-9), 0, None)
        whole = right.sum(axis=0)
        best = whole.argmax(axis=1) if k else np.zeros(n, int)
        most = whole.max(axis=1, initial=0)
        named = (counts > 0) & bool(k)
        score = np.where(named & (most > 0), most / np.maximum(whole.sum(axis=1), 1e-9), 0.0)
        cover = np.where(named, right[0, np.arange(n), best] / np.maximum(total, 1), 0.0) if k else np.zeros(n)
        return [self.langs[b] if x else UND for b, x in zip(best, named, strict=True)], np.clip(score, 0, 1), np.clip(cover, 0, 1)


def train(docs: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """Learns from (text, lang, doc_id) rows; rows without text or lang are passed over.

    At most about ``sample_docs`` documents of each language are read for it, whole, chosen by a hash of id and text.
    The filter is put together on the executors; the driver gets it alone, slots x languages in bits, and two counts for
    each language, never the n-grams. No n-gram is left out, be it rare or shared by all languages; the filter grows with
    the distinct n-grams counted, as a language of thousands of characters has many, so that ``most_false`` holds.
    """
    known = docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs, levels = sorted(sizes), len(params.levels)
    words, kind = words_for(len(langs)), word_type(len(langs))
    if not langs:
        return LangModel(params, [], np.zeros((params.slots, levels), kind), np.zeros((levels, 0)))
    chance = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, params.sample_docs / n))])
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    each = known.filter(dealt < chance[F.col("lang")]).select("text", "lang").mapInArrow(count_ngrams(langs, params), "lang int, gram long, seen long")
    counted = cut(each.groupBy("lang", "gram").agg(F.sum("seen").alias("seen")))
    totals, most = np.ones(len(langs)), 0
    for r in counted.groupBy("lang").agg(F.sum("seen").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        totals[r["lang"]], most = r["n"], max(most, r["kinds"])
    params = replace(params, slots=slots_needed(most, params))
    size = params.slots * levels * words * np.dtype(kind).itemsize
    if size > params.most_bytes:
        raise ValueError(f"{most} n-grams of one language make a filter of {size} bytes, over the {params.most_bytes} of most_bytes; lower sample_docs, or raise most_bytes or most_false")
    blocks = counted.mapInArrow(fill(totals, params), "block int, bits binary").groupBy("block").applyInArrow(united, "block int, bits binary")
    bits = np.zeros((params.slots, levels * words), kind)
    for r in blocks.toLocalIterator():
        held = np.frombuffer(r["bits"], kind).reshape(-1, levels * words)
        bits[r["block"] * BLOCK : r["block"] * BLOCK + len(held)] = held
    filled = [[np.count_nonzero((bits[:, level * words + i // 64] >> kind(i % 64)) & kind(1)) / params.slots for i in range(len(langs))] for level in range(levels)]
    return LangModel(params, langs, bits, np.array(filled) ** params.probes)


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred, score, cover for each row of ``docs``.

    Null texts and texts without a letter get 'und' and score 0, so do all if there was nothing to learn from. Ties go
    to the language that sorts first. Repeated rows are scored alike; other columns of ``docs`` are not read. Long
    texts are read whole; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages: a fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in parts:
            texts = part.column("text")
            _, offsets = text_bytes(texts)
            for i, j in batches(offsets, 1 << 19):
                lang, score, cover = m.predict(texts.slice(i, j - i))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").slice(i, j - i), "lang_pred": lang, "score": score, "cover": cover})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cover double")


def keep_identified(docs: DataFrame, model: LangModel) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is in a learnt language.

    Rejected are texts of 'und' (null, empty, without a letter, or nothing learnt), and those whose predicted language has
    less than ``least_cover`` of their n-grams, as it has of other languages, codes and noise. Repeated rows are judged
    alike, long texts whole, columns other than text pass unread, whatever their names; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least, at = model.params.least_cover, docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at)
            _, offsets = text_bytes(texts)
            for i, j in batches(offsets, 1 << 19):
                lang, _, cover = shared.value.predict(texts.slice(i, j - i))
                yield part.slice(i, j - i).filter(pa.array([x != UND and c >= least for x, c in zip(lang, cover, strict=True)], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(doc_id="doc_id", parts: int = 4, out: int = 2):
    """True for the documents that are kept from training."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == out


def op8(docs: DataFrame, params: LangParams = LangParams()) -> DataFrame:
    """Predicts all documents with a model of those that are not held out."""
    model = train(docs.filter(~F.coalesce(held_out(), F.lit(False))), params)
    return identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "cover")
