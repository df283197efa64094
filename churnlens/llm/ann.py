"""Approximate nearest neighbours by cross-polytope hashing.

Method: a table's hash rotates a unit vector by three rounds of random signs
and a fast Hadamard transform and names the signed axis nearest to it (2 d
axes for d dimensions); a hash of order two joins the axes of two independent
rotations (4 d^2 buckets).  Queries probe, in each table, the buckets whose
axes have the largest (sums of) signed coordinates; the candidates so collected
are scored exactly in double precision.

Order, number of tables and number of probes are fitted, not fixed: for
``SAMPLE`` queries (by id hash) the true nearest are found by scoring all rows,
the ranks of their buckets among the query's probes are read off, and of all
settings that reach ``RECALL`` on them the one with the least work is taken
(``fit_settings``).  Work counts candidates, so it depends on the number of
rows: more rows make finer buckets pay.  Nearly orthogonal data (random vectors
of many dimensions) need a large share of the rows at any size, clustered data
a small one.  A setting that probes every axis of a table finds everything, so
the recall can always be reached.

Distribution: equal vectors collapse first and keep their ``k + 1`` smallest
ids (no more of them can be in one answer), so a vector that a third of the
rows share is one candidate.  Buckets are joined as blocks: a bucket's
candidates and its queries are both cut into blocks of about ``BLOCK`` rows by
hash, every pair of blocks is one task-sized matrix product, and each query
keeps its ``k`` best per block pair.  Queries that found fewer than ``k``
vectors are answered from all rows, in the same blocks, so the result is
never short.

Inner product on vectors of unequal length: rows and queries are hashed by
direction alone and scored by inner product; the sampled recall is that of the
inner product, so probes rise where lengths differ.  Only vectors of equal
dimension are compared; a dimension that the sampled queries lack is rare among
the queries and is scored whole.

Defined cases: null vectors, vectors that are empty, zero or hold a null or
non-finite component, and rows with a null id take no part (neither as query
nor as candidate); rows that repeat an id and vector count once; ties go to
the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import Scratch

SAMPLE = 64
RECALL = 0.95
#: settings tried; probes follow from the sample
TABLES = (1, 2, 4, 8, 16)
ORDERS = (1, 2)
BLOCK = 4096
#: cost of sending one vector and its best matches through a shuffle, in scored candidates
COPY = 300
SEED = 11


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of the rows (power-of-two width)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def signed_axes(x: np.ndarray, table: int, turn: int = 0) -> np.ndarray:
    """Signed coordinates after the table's rotation: column 2 i for +e_i, 2 i + 1 for -e_i."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng((SEED, table, d, turn))
    for _ in range(3):
        y = _hadamard(y * rng.choice((-1.0, 1.0), d))
    return np.stack((y, -y), axis=2).reshape(len(x), 2 * d)


class Setting(NamedTuple):
    """Rotations joined in a hash, hash tables, buckets probed in each."""

    order: int
    tables: int
    probes: int


def buckets(x: np.ndarray, table: int, order: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of every unit vector, nearest first."""
    first = signed_axes(x, table)
    if order == 1:
        return np.argsort(-first, axis=1, kind="stable")[:, :probes]
    second = signed_axes(x, table, 1)
    axes = first.shape[1]
    # the best ``probes`` sums lie among the best ``probes`` axes of both sides
    m = min(axes, probes)
    a, b = (np.argsort(-s, axis=1, kind="stable")[:, :m] for s in (first, second))
    u, v = np.take_along_axis(first, a, 1), np.take_along_axis(second, b, 1)
    out = np.empty((len(x), min(probes, m * m)), np.int64)
    step = max(1, (1 << 22) // (m * m))
    for i in range(0, len(x), step):
        sums = (u[i : i + step, :, None] + v[i : i + step, None, :]).reshape(-1, m * m)
        top = np.argpartition(-sums, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sums, top, 1), axis=1, kind="stable"), 1)
        out[i : i + step] = np.take_along_axis(a[i : i + step], top // m, 1) * axes + np.take_along_axis(b[i : i + step], top % m, 1)
    return out


def probe_ranks(q: np.ndarray, x: np.ndarray, table: int, order: int) -> np.ndarray:
    """Place of the bucket of ``x[i]`` among the probes of ``q[i]`` (0: probed first)."""
    first, of_x = signed_axes(q, table), signed_axes(x, table)
    mine = np.take_along_axis(first, of_x.argmax(axis=1)[:, None], 1)
    if order == 1:
        return (first > mine).sum(axis=1)
    second, of_x = signed_axes(q, table, 1), signed_axes(x, table, 1)
    total = mine + np.take_along_axis(second, of_x.argmax(axis=1)[:, None], 1)
    second = np.sort(second, axis=1)
    n = second.shape[1]
    # equal sums count as probed before
    return np.array([(n - np.searchsorted(s, t - f - 1e-12)).sum() - 1 for f, s, t in zip(first, second, total[:, 0])])


def fit_settings(q: np.ndarray, x: np.ndarray, rows: int, queries: int, recall: float = RECALL) -> Setting:
    """The cheapest setting that finds the share ``recall`` of the true pairs ``(q[i], x[i])``.

    ``rows`` and ``queries`` are the numbers searched; a query costs the
    candidates of its probes, its copies, and its share of the rows' copies.
    """
    axes = 2 << max(0, int(q.shape[1] - 1).bit_length())
    q, x = _unit(q), _unit(x)
    best: tuple[float, Setting] | None = None
    for order in ORDERS:
        least = None
        for table in range(max(TABLES)):
            ranks = probe_ranks(q, x, table, order)
            least = ranks if least is None else np.minimum(least, ranks)
            if table + 1 in TABLES:
                probes = int(np.sort(least)[max(0, int(np.ceil(recall * len(least))) - 1)]) + 1
                cost = (table + 1) * (probes * (rows / axes**order + COPY) + COPY * rows / max(queries, 1))
                if best is None or cost < best[0]:
                    best = cost, Setting(order, table + 1, probes)
    return best[1]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _bucketed(vectors: DataFrame, settings: dict[int, Setting], probing: bool) -> DataFrame:
    """``vectors(id, dim, vec)`` -> one row per table and probed bucket, with ``bucket``."""

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                high = np.int64(dim) << 44
                if int(dim) not in settings:
                    key = np.full(part.num_rows, high + (1 << 43))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key, pa.int64())], names=[*part.schema.names, "bucket"])
                    continue
                order, tables, probes = settings[int(dim)]
                x = _unit(_matrix(part.column("vec")))
                for t in range(tables):
                    found = buckets(x, t, order, probes if probing else 1)
                    width = max(1, (1 << 17) // found.shape[1])
                    for i in range(0, len(x), width):
                        some = found[i : i + width]
                        out = part.take(pa.array(i + np.repeat(np.arange(len(some)), some.shape[1])))
                        key = high + (np.int64(t) << 38) + some.reshape(-1)
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(key, pa.int64())], names=[*out.schema.names, "bucket"])

    return vectors.select("id", "dim", "vec").mapInArrow(run, "id long, dim int, vec array<double>, bucket long")


def _best(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Block-wise exact scores of every query with every candidate of its bucket; ``k`` best per block pair."""
    blocks = lambda df, n: df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    sizes = blocks(queries, "nq").join(blocks(candidates, "nc"), "bucket")
    left = (
        queries.join(sizes, "bucket")
        .withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq")).cast("int"))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    )
    right = (
        candidates.join(sizes, "bucket")
        .withColumn("cb", F.pmod(F.xxhash64("id"), F.col("nc")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    )

    def score(l: pa.Table, r: pa.Table) -> pa.Table:
        if l.num_rows == 0 or r.num_rows == 0:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(l.column("vec").combine_chunks()), _matrix(r.column("vec").combine_chunks())
        ids = r.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        n = min(k + 1, len(ids))  # one more: the query's own vector may be among them
        out_q, out_i, out_s = [], [], []
        names = l.column("id").to_numpy()
        for a in range(0, len(q), 512):
            s = q[a : a + 512] @ x.T
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            # ties at the edge: take every candidate that equals the n-th score up to rounding
            edge = np.take_along_axis(s, top, 1).min(axis=1) - 1e-12
            row, col = np.nonzero(s >= edge[:, None])
            exact = (q[a : a + 512][row] * x[col]).sum(axis=1)
            pick = np.lexsort((ids[col], -exact, row))
            row, col, exact = row[pick], col[pick], exact[pick]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < n
            out_q.append(names[a : a + 512][row[keep]])
            out_i.append(ids[col[keep]])
            out_s.append(exact[keep])
        return pa.table({"query_id": np.concatenate(out_q), "id": np.concatenate(out_i), "score": np.concatenate(out_s)})

    keys = ["bucket", "qb", "cb"]
    return (
        left.select(*keys, "id", "vec")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "id", "vec").groupBy(*keys))
        .applyInArrow(score, "query_id long, id long, score double")
    )


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.col("dim").cast("long"))


def sampled_settings(points: DataFrame, asked: DataFrame, k: int) -> dict[int, Setting]:
    """A setting for every dimension of the sampled queries.

    The driver receives at most ``SAMPLE`` queries with ``k + 1`` vectors each.
    """
    picked = asked.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE)
    few = [(r["id"], r["dim"], r["vec"]) for r in picked.collect()]
    if not few:
        return {}
    chosen = asked.sparkSession.createDataFrame(few, asked.schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    # pieces of one bucket repeat no pair; a query's own vector comes first among equals and is dropped below
    near = _best(_whole(chosen), _whole(points), k).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    truth = near.join(points.select("id", "vec"), "id").select("query_id", "vec").collect()
    dims = sorted({d for _, d, _ in few})
    n_rows = {r["dim"]: r["count"] for r in points.where(F.col("dim").isin(dims)).groupBy("dim").count().collect()}
    n_asked = {r["dim"]: r["count"] for r in asked.where(F.col("dim").isin(dims)).groupBy("dim").count().collect()}
    vector = {i: v for i, _, v in few}
    out = {}
    for dim in dims:
        pairs = [(vector[r["query_id"]], r["vec"]) for r in truth if len(r["vec"]) == dim and r["vec"] != vector[r["query_id"]]]
        if pairs:
            q, x = (np.array(side, float) for side in zip(*pairs))
            out[dim] = fit_settings(q, x, n_rows[dim], n_asked[dim])
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, settings: dict[int, Setting] | None = None) -> DataFrame:
    """``rows(vec_id, embedding)`` searched for every row of ``queries`` (same columns).

    Result: query_id, rank, vec_id, score; a query's own id is no candidate.
    ``settings`` (by dimension) are fitted on a sample of the queries if not given.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        x = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null")
        fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
        return x.where((F.size("vec") > 0) & fine).distinct().withColumn("dim", F.size("vec"))

    valid = scratch.save(usable(rows), "valid")
    # distinct vectors, each with the k + 1 smallest ids that carry it
    by_vec = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = valid.withColumn("r", by_vec).where(F.col("r") <= k + 1)
    distinct = scratch.save(
        few.groupBy("vec").agg(F.min("vec_id").alias("id"), F.first("dim").alias("dim"), F.array_sort(F.collect_list("vec_id")).alias("ids")),
        "distinct",
    )
    asked = scratch.save(usable(queries).select(F.col("vec_id").alias("id"), "dim", "vec"), "asked")
    points = distinct.select("id", "dim", "vec")
    if settings is None:
        settings = sampled_settings(points, asked, k)
    hits = _best(_bucketed(asked, settings, True), _bucketed(points, settings, False), k)
    hits = scratch.save(hits.groupBy("query_id", "id").agg(F.max("score").alias("score")), "hits")

    def expanded(found: DataFrame) -> DataFrame:
        x = found.join(distinct.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id"))
        return x.where(F.col("vec_id") != F.col("query_id"))

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = expanded(hits).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # queries that are short of k go to all rows, in blocks
    count = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    short = scratch.save(
        asked.join(count, asked["id"] == count["query_id"], "left").where(F.coalesce("found", F.lit(0)) < k).select("id", "dim", "vec"), "short"
    )
    extra = _best(_whole(short), _whole(points), k)
    extra = expanded(extra).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    done = ranked.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return done.unionByName(extra.select(*done.columns)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
