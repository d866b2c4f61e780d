"""Exact top-k search by inner product as a Voronoi kNN join.

Lifting makes the largest inner products the smallest distances: a vector x gets the further coordinate
sqrt(M - |x|^2), M being the largest |x|^2 of all, a query q gets 0, and |q' - x'|^2 = |q|^2 + M - 2 q.x. In that space
data and queries are grouped by their nearest pivot. What each group's summary says (how many there are, the least and
largest distance to the pivot, and of data the nearest distances) bounds, for a whole group of queries, how far its k-th
neighbour can be: theta. By the triangle inequality a query within ``reach`` of its pivot can have x of another cell
among its k best only if | d(pivot, pivot') - d(x', pivot') | <= reach + theta; only such vectors are replicated to the
group of queries, and it is solved there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgraph.llm.common import U, cut, mix


@dataclass(frozen=True)
class KnnParams:
    k: int = 20
    scale: int = 64
    #: Rows from which the pivots are chosen, and the most pivots: their tables stay under some MB.
    sample: int = 4_000
    most_pivots: int = 1_024
    #: Queries of a group, and vectors of a task: cells of more queries are split, cells of fewer share a group.
    query_rows: int = 4_096
    block_rows: int = 8_192


def to_ints(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors take part, and their floor(scale * x) as floats."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    ints = np.floor(scale * flat)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(ints))])
    keep = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    return keep, [ints[a:b] for a, b in zip(at[:-1][keep], at[1:][keep], strict=True)]


def stack(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which add nothing to an inner product."""
    if rows and len({len(r) for r in rows}) == 1:
        return np.stack(rows)
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def widen(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def unblob(column) -> np.ndarray:
    blobs = column.to_pylist()
    if len({len(b) for b in blobs}) == 1:
        return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return stack([np.frombuffer(b, np.float64) for b in blobs])


def spread_out(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A number below ``parts`` for each id by its hash, so that ids of one remainder, or negative ones, are spread as others."""
    return (mix(ids.astype(np.int64).view(U)) % np.maximum(parts, 1).astype(U)).astype(np.int64)


def lifted(x: np.ndarray, d: int, most: float | None) -> np.ndarray:
    """The vectors in the space of distances: ``most`` for data, None for queries."""
    x = widen(x, d)
    last = np.zeros((len(x), 1)) if most is None else np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]
    return np.concatenate([x, last], axis=1)


def choose_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """A few rounds of k-means over the sample."""
    p = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(6):
        near = nearest(x, p)[0]
        sums, n = np.zeros_like(p), np.bincount(near, minlength=len(p))
        np.add.at(sums, near, x)
        p = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], p)
    return p


def nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = ((p**2).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
    return near, np.sqrt(((x - p[near]) ** 2).sum(1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the ends of long; in floats where those are exact."""
    d = max(q.shape[1], x.shape[1])
    q, x = widen(q, d), widen(x, d)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(d, 1) < 2**53:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    wide = whole(q).astype(object) @ whole(x).astype(object).T
    return np.minimum(np.maximum(wide, -(2**63)), 2**63 - 1).astype(np.int64)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; ids ascend."""
    if len(scores) <= k:
        return np.argsort(~scores, kind="stable")  # ~ turns the order round, without overflow
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > floor)
    level = np.flatnonzero(scores == floor)[: k - len(above)]
    at = np.concatenate([above, level])
    return at[np.lexsort((ids[at], ~scores[at]))]


def _solve(p: KnnParams):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        q_out, v_out, s_out = [], [], []
        if queries.num_rows and data.num_rows:
            ids = data.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], unblob(data.column("v"))[order]
            q_ids, q = queries.column("query_id").to_numpy(), unblob(queries.column("q"))
            for i in range(0, len(q), 256):
                for own, row in zip(q_ids[i : i + 256], products(q[i : i + 256], x), strict=True):
                    a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
                    at = top(row, ids, p.k) if a == b else (lambda other: other[top(row[other], ids[other], p.k)])(np.concatenate([np.arange(a), np.arange(b, len(ids))]))
                    q_out.append(np.full(len(at), own)), v_out.append(ids[at]), s_out.append(row[at])
        join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({"query_id": join(q_out), "vec_id": join(v_out), "score": join(s_out)})

    return run


FOUND = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Plan:
    """For each group of queries, from which cells it needs vectors at which distances, and into how many tasks they are dealt. As large as pivots x pivots."""

    #: Of each cell of queries, the first of its groups and how many it has.
    first: np.ndarray
    groups: np.ndarray
    #: cells of queries x cells of data
    low: np.ndarray
    high: np.ndarray
    #: Of each group, the first of its tasks and how many it has.
    task: np.ndarray
    tasks: np.ndarray


def planned(pivots: np.ndarray, asked: dict, held: dict, near: list[tuple[int, float, int]], p: KnnParams) -> Plan:
    """From the summaries: asked[cell] = (queries, largest distance), held[cell] = (vectors, least, largest distance), near = (cell, distance, vec_id) of each cell's nearest."""
    c = len(pivots)
    gap = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(2), 0))
    reach, theta = np.zeros(c), np.full(c, np.inf)
    cell, far, own = (np.array([x[i] for x in near]) for i in range(3))
    for i, (_, widest) in asked.items():
        reach[i] = widest
        bound = widest + gap[i, cell] + far
        order = np.argsort(bound, kind="stable")
        # The k-th other vector is at most so far; the query's own may be one of them, or several.
        _, at = np.unique(own[order], return_index=True)
        if len(at) > p.k:
            theta[i] = bound[order][np.sort(at)[p.k]]
    width = (reach + theta) * (1 + 1e-9) + 1e-6
    low, high = gap - width[:, None], gap + width[:, None]
    # Cells of few queries share a group with others near them.
    first, groups, left, order = np.zeros(c, np.int64), np.zeros(c, np.int64), set(asked), []
    at = min(left, default=None)
    while left:
        order.append(at)
        left.discard(at)
        at = min(left, key=lambda j: gap[at, j], default=None)
    n, room = 0, 0
    for i in order:
        size = asked[i][0]
        if size > p.query_rows:
            first[i], groups[i], room = n, -(-size // p.query_rows), 0
            n += groups[i]
        else:
            if size > room:
                n, room = n + 1, p.query_rows
            first[i], groups[i], room = n - 1, 1, room - size
    need = np.zeros(max(n, 1))
    for i in order:
        some = sum(m for j, (m, a, b) in held.items() if not (b < low[i, j] or a > high[i, j]))
        need[first[i] : first[i] + groups[i]] = np.maximum(need[first[i] : first[i] + groups[i]], some)
    tasks = np.maximum(1, -(-need // p.block_rows)).astype(np.int64)
    return Plan(first, groups, low, high, np.concatenate([[0], np.cumsum(tasks)[:-1]]), tasks)


def dealt(vectors: DataFrame, queries: DataFrame, p: KnnParams) -> tuple[DataFrame, DataFrame] | None:
    """(task, query_id, q) and (task, vec_id, v): each query in all tasks of its group, and to each group what it needs. None without vectors."""
    spark = vectors.sparkSession

    def ints(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep, rows = to_ints(part.column("embedding"), p.scale)
            sizes = [min(float(r @ r), 1e300) for r in rows]
            yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id").filter(pa.array(keep)), "v": pa.array([r.tobytes() for r in rows], pa.binary()), "size": pa.array(sizes, pa.float64()), "d": pa.array([len(r) for r in rows], pa.int32())})

    whole = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null").mapInArrow(ints, "vec_id long, v binary, size double, d int")
    usable = cut(whole(vectors))
    valid = cut(whole(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")))
    n, most, d = usable.agg(F.count(F.lit(1)), F.max("size"), F.max("d")).first()
    if not n or valid.isEmpty():
        return None
    d = max(d, valid.agg(F.max(F.length("q"))).first()[0] // 8)
    # About p.sample rows, whatever the number of tasks that read them; of few vectors, all.
    dealt_out = F.pmod(F.xxhash64("vec_id", "v", F.lit("pivots")), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.filter(dealt_out < min(1.0, p.sample / n)).select("vec_id", "v").toPandas().sort_values(["vec_id", "v"], kind="stable")
    if not len(picked):
        picked = usable.select("vec_id", "v").orderBy("vec_id", "v").limit(p.sample).toPandas()
    pivots = choose_pivots(lifted(stack([np.frombuffer(b, np.float64) for b in picked.v]), d, most), int(min(p.most_pivots, max(16, n**0.5 / 2))))

    def assign(blob: str, ident: str, largest: float | None):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if part.num_rows:
                    near, far = nearest(lifted(unblob(part.column(blob)), d, largest), pivots)
                    yield pa.RecordBatch.from_pydict({ident: part.column(ident), blob: part.column(blob), "cell": near.astype(np.int32), "far": far})

        return run

    cells = cut(usable.select("vec_id", "v").mapInArrow(assign("v", "vec_id", most), "vec_id long, v binary, cell int, far double"))
    own = cut(valid.mapInArrow(assign("q", "query_id", None), "query_id long, q binary, cell int, far double"))
    count = F.count(F.lit(1)).alias("n")
    held = {r["cell"]: (r["n"], r["a"], r["b"]) for r in cells.groupBy("cell").agg(count, F.min("far").alias("a"), F.max("far").alias("b")).collect()}
    asked = {r["cell"]: (r["n"], r["b"]) for r in own.groupBy("cell").agg(count, F.max("far").alias("b")).collect()}
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id"))
    near = [(r["cell"], r["far"], r["vec_id"]) for r in cells.select("cell", "far", "vec_id").withColumn("r", rank).filter(F.col("r") <= p.k + 1).collect()]
    plan = planned(pivots, asked, held, near, p)
    wanted = sorted(asked)

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cell, ids = part.column("cell").to_numpy(), part.column("query_id").to_numpy()
            group = plan.first[cell] + spread_out(ids, plan.groups[cell])
            yield from spread(part, "query_id", "q", np.arange(part.num_rows), group, None)

    def give(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 2048):
                some = part.slice(i, 2048)
                cell, far = some.column("cell").to_numpy(), some.column("far").to_numpy()
                # What is not known to be too far, such as distances beyond all numbers, is needed.
                away = (far[None, :] < plan.low[wanted][:, cell]) | (far[None, :] > plan.high[wanted][:, cell])
                which, row = np.nonzero(~away)
                which = np.array(wanted)[which]
                rep = plan.groups[which]
                group = np.repeat(plan.first[which], rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
                both = np.unique(np.repeat(row, rep) * (1 << 32) + group)
                yield from spread(some, "vec_id", "v", both >> 32, both & ((1 << 32) - 1), some.column("vec_id").to_numpy())

    def spread(part, ident: str, blob: str, row: np.ndarray, group: np.ndarray, ids: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """The rows for their groups: queries (ids None) to all tasks of the group, data to one."""
        if ids is None:
            rep = plan.tasks[group]
            task = np.repeat(plan.task[group], rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
            row = np.repeat(row, rep)
        else:
            # By a further hash, so that the vectors of a task don't depend on the group that their ids would be in.
            task = plan.task[group] + spread_out(ids[row] ^ 0x5DEECE66D, plan.tasks[group])
        for i in range(0, len(row), 4096):
            at = pa.array(row[i : i + 4096])
            yield pa.RecordBatch.from_pydict({"task": task[i : i + 4096], ident: part.column(ident).take(at), blob: part.column(blob).take(at)})

    return own.mapInArrow(ask, "task long, query_id long, q binary"), cells.mapInArrow(give, "task long, vec_id long, v binary")


def search(vectors: DataFrame, queries: DataFrame, p: KnnParams = KnnParams()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the p.k highest inner products of floor(scale * x) for each of ``queries``.

    Both have vec_id, a long that isn't null, and embedding. A query's own vec_id is no candidate. Vectors that are null
    or hold null or non-finite components take no part; empty vectors score 0, shorter ones count as ended with zeros.
    Scores beyond long's range are held at its ends. Ties go to the smaller vec_id; queries with fewer candidates get all
    of them. Repeated rows are candidates each, but a query_id is asked once (of different vectors, with the one that
    sorts first). Other columns are not read; an empty table gives an empty one.
    """
    sent = dealt(vectors, queries, p)
    if sent is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, data = sent
    found = asked.groupBy("task").cogroup(data.groupBy("task")).applyInArrow(_solve(p), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(embeddings: DataFrame, p: KnnParams = KnnParams()) -> DataFrame:
    return search(embeddings, embeddings.filter("vec_id % 20 = 0"), p)


#: DuckDB: every query against every row.
ORACLE = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, o.vec_id, CAST(list_inner_product(q.v, o.v) AS BIGINT) AS score FROM ok q JOIN ok o ON q.vec_id % 20 = 0 AND q.vec_id <> o.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20"""
