"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Each byte has a small learned vector; filters of a few bytes' width slide over overlapping chunks that cover the text;
each filter's maximum over a chunk is pooled, and the mean and the maximum over a text's chunks feed one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import batches, cut, text_bytes


@dataclass(frozen=True)
class NetParams:
    #: Bound of the labelled documents learnt from, each with its whole text.
    sample_docs: int = 1_000
    #: Bound of the bytes of those texts: what no longer fits is passed over, as a whole document.
    sample_bytes: int = 64 << 20
    chunk: int = 256
    width: int = 5
    filters: int = 12
    dims: int = 6
    epochs: int = 8
    rate: float = 0.01
    seed: int = 7
    threshold: float = 0.3


@dataclass(frozen=True)
class Net:
    params: NetParams
    #: width x 256 x filters: the vector of each byte times the filter's part for each place.
    table: np.ndarray
    bias: np.ndarray
    #: 2 x filters: weights of the mean and of the maximum over chunks.
    out: np.ndarray
    out_bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        p = self.params
        padded, chunks = chunked(column, p)
        done = np.full(len(chunks), 1 / (1 + np.exp(-self.out_bias)))
        if not chunks.sum():
            return done
        top, _ = best_windows(padded, self.table, p)
        pooled = np.maximum(top + self.bias, 0)
        first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
        some = chunks > 0
        mean = np.add.reduceat(pooled, first[some], axis=0) / chunks[some][:, None]
        high = np.maximum.reduceat(pooled, first[some], axis=0)
        done[some] = 1 / (1 + np.exp(-np.clip(mean @ self.out[0] + high @ self.out[1] + self.out_bias, -30, 30)))
        return done


def chunked(column: pa.Array, p: NetParams) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and how many chunks each has.

    Each text stands behind p.width - 1 zeros and is followed by zeros up to the next step, so that no window of a text,
    not even its last, reaches a byte of the next. Chunks of one text overlap by p.width - 1 bytes and cover the whole of it.
    """
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    step = p.chunk - p.width + 1
    chunks = np.where(size > 0, -(-(size + p.width - 1) // step), 0)
    to = np.concatenate([[0], np.cumsum(chunks * step)])
    padded = np.zeros(to[-1] + p.width - 1, np.uint8)
    padded[np.arange(len(data)) + np.repeat(to[:-1] - offsets[:-1], size) + p.width - 1] = data
    return padded, chunks


def best_windows(padded: np.ndarray, table: np.ndarray, p: NetParams, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """chunks x filters: each filter's largest response in each chunk, and at which byte of ``padded``, if asked for."""
    step = p.chunk - p.width + 1
    many = (len(padded) - p.width + 1) // step
    top = np.empty((many, p.filters), np.float32)
    at = np.empty((many, p.filters), np.int64) if places else None
    for i in range(0, many, 128):
        part = padded[i * step : min(i + 128, many) * step + p.width - 1]
        n = len(part) - p.width + 1
        act = table[0][part[:n]]
        for j in range(1, p.width):
            act += table[j][part[j : j + n]]
        act = act.reshape(-1, step, p.filters)
        if places:
            best = act.argmax(axis=1)
            top[i : i + 128] = np.take_along_axis(act, best[:, None, :], 1)[:, 0]
            at[i : i + 128] = best + (np.arange(len(best)) + i)[:, None] * step
        else:
            top[i : i + 128] = act.max(axis=1)
    return top, at


def fit(texts: pa.Array, labels: np.ndarray, p: NetParams) -> Net:
    """Adam on the log loss over whole texts."""
    rng = np.random.default_rng(p.seed)
    w = {"embed": rng.normal(0, 0.5, (256, p.dims)), "filter": rng.normal(0, (p.width * p.dims) ** -0.5, (p.width * p.dims, p.filters)), "bias": np.zeros(p.filters), "out": rng.normal(0, 0.3, (2, p.filters)), "out_bias": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for _ in range(p.epochs if len(texts) else 0):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 32):
            own = order[i : i + 32]
            padded, n = chunked(texts.take(pa.array(own)), p)
            own, n = own[n > 0], n[n > 0]
            if not len(own):
                continue
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            table = np.einsum("bd,jdf->jbf", w["embed"], w["filter"].reshape(p.width, p.dims, p.filters))
            top, at = best_windows(padded, table, p, True)
            top = top + w["bias"]
            pooled = np.maximum(top, 0)
            mean, high = np.add.reduceat(pooled, first) / n[:, None], np.maximum.reduceat(pooled, first)
            z = mean @ w["out"][0] + high @ w["out"][1] + w["out_bias"]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            g = {"out": np.stack([d @ mean, d @ high]), "out_bias": d.sum(keepdims=True)}
            of = np.repeat(np.arange(len(own)), n)
            dp = d[of][:, None] * (w["out"][0] / n[of][:, None] + w["out"][1] * (pooled == high[of]))
            dp *= top > 0
            g["bias"] = dp.sum(0)
            g["filter"], g["embed"] = np.zeros_like(w["filter"]), np.zeros_like(w["embed"])
            for j in range(p.width):
                byte = padded[at + j]  # chunks x filters
                own_part = slice(j * p.dims, (j + 1) * p.dims)
                g["filter"][own_part] = np.einsum("cfd,cf->df", w["embed"][byte], dp)
                # How much each byte value is asked to change, by filter, then by dimension.
                pull = np.bincount((byte.astype(np.int64) * p.filters + np.arange(p.filters)).ravel(), weights=dp.ravel(), minlength=256 * p.filters).reshape(256, p.filters)
                g["embed"] += pull @ w["filter"][own_part].T
            t += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= p.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    table = np.einsum("bd,jdf->jbf", w["embed"], w["filter"].reshape(p.width, p.dims, p.filters)).astype(np.float32)
    return Net(p, table, w["bias"], w["out"], float(w["out_bias"][0]))


def held_out(parts: int = 5):
    """True for the documents whose labels are never learnt."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == 0


def sample(docs: DataFrame, labels: DataFrame, p: NetParams = NetParams()) -> DataFrame:
    """doc_id, text, quality of the labelled documents to learn from: one row for each id, at most p.sample_docs of them, of p.sample_bytes of text together.

    They are taken by a hash of their id. Rows that repeat an id are brought down to one, the text that sorts first,
    before any of them moves.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    order = F.xxhash64("doc_id", F.lit("quality sample"))
    chosen = known.orderBy(order, "doc_id").limit(p.sample_docs)
    found = docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(chosen), "doc_id")
    own = cut(found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    # At most p.sample_docs sizes; the texts themselves are read once it is known which fit.
    left, fitting = p.sample_bytes, []
    for r in sorted(own.select("doc_id", F.octet_length("text").alias("size"), order.alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= left:
            left -= r["size"]
            fitting.append(r["doc_id"])
    return own.filter(F.col("doc_id").isin(fitting)).select("doc_id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, p: NetParams = NetParams()) -> Net:
    """Learns labels.quality of the documents of ``sample``, from their whole texts.

    Of several labels of a doc_id the largest counts. Labels without a value or a doc_id, of held-out documents, and of
    documents without text, teach nothing; without any, all texts get one score.
    """
    rows = sample(docs, labels, p).toPandas().sort_values(["doc_id", "text"], kind="stable")
    return fit(pa.array(rows.text, pa.string()), rows.quality.to_numpy(np.float32), p)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score for each row: null and empty texts get what the network says of no chunk; repeated rows are scored alike, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 60 KB

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text")
            _, offsets = text_bytes(texts)
            for i, j in batches(offsets, 1 << 19):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").slice(i, j - i), "score": shared.value.scores(texts.slice(i, j - i))})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op9(docs: DataFrame, labels: DataFrame, p: NetParams = NetParams()) -> DataFrame:
    done = score(docs, train(docs, labels, p))
    return done.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
