"""Helpers shared by the training-data operators: shared storage, block sizing and byte-level hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.storage import stored

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: One random 64-bit value for each byte value, and an odd multiplier with its inverse modulo 2**64.
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
MULT = 0x9E3779B97F4A7C15
MULT_INV = pow(MULT, -1, 2**64)


def cut(df: DataFrame) -> DataFrame:
    """``df`` by way of a table in the shared folder."""
    return stored(df)


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def whole(df: DataFrame, *names: str) -> Column:
    """All columns of a row as one struct, so that no name of an operator's own can clash with theirs."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns if c not in names])


def let(value: Column, body) -> Column:
    """body(value), with ``value`` worked out once and not again for each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def input_bytes(df: DataFrame) -> int:
    """The UTF-8 bytes of all texts: files may be packed many times smaller than what a task has to hold."""
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def blocks_for(size: int, block_bytes: int, least: int = 12) -> int:
    """How many blocks of about ``block_bytes`` ``size`` bytes make; grows with it without a ceiling but Int's."""
    return int(min(max(least, -(-size // block_bytes)), 2**30))


def with_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """(doc_id, text, chunk): rows dealt by a hash of id and text, so that rows without an id, or of one id, don't gather in one block."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {MULT: powers(MULT, 1 << 12), MULT_INV: powers(MULT_INV, 1 << 12)}


def power_table(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, 1 << (n - 1).bit_length())
    return _POWERS[base][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] the polynomial hash of data[:i]; see ``range_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * power_table(MULT, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand."""
    return mix((prefix[end] - prefix[start]) * power_table(MULT_INV, len(prefix))[start] + (end - start).astype(np.uint64))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n + 1 offsets of the texts in it; nulls are empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return whole, at - at[0]


def batches(offsets: np.ndarray, size: int):
    """Ranges (i, j) of texts with about ``size`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the n + 1 offsets of the texts in them. Words never cross texts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return range_hash(prefix_hash(data), start, end), np.searchsorted(start, offsets)


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned values as differences, by byte planes: a count of planes, then each plane."""
    if not len(values):
        return b"\0"
    gaps = np.diff(values, prepend=U(0)).astype("<u8")
    planes = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([planes]) + gaps.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = blob[0]
    if not planes:
        return np.zeros(0, np.uint64)
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(planes, -1)
    wide = np.zeros((body.shape[1], 8), np.uint8)
    wide[:, :planes] = body.T
    return np.cumsum(wide.view("<u8").ravel().astype(np.uint64))
