"""Vector code compression: exact integer product codes over Hilbert-sorted flat blocks.

Method: components become integers ``floor(1024 x)`` and vectors are cut into
``PARTS`` equal consecutive parts.  Rows are read in chunks; inside a chunk
every part is sorted along a Hilbert curve and cut into flat blocks of
``BLOCK`` rows, each with its box (minimum and maximum of every component) and
its componentwise sum.  The blocks are written once.  Every round scans them:

* an entry whose smallest squared distance to the box exceeds the largest
  distance of some other entry cannot be nearest for any row of the block, so
  box distances leave a shortlist of entries per block;
* a block with one entry on its list gives its count and stored sum to that
  entry without a look at its rows;
* the other blocks go through a small integer kernel over their shortlist.

All kernels are exact (float64 products only where every value stays under
2^53, else int64), sums are added in decimals, so the codes do not depend on
chunks, partitions or the order of rows.

Distribution: no shuffle of vectors at all.  A task adds up its blocks and
sends one row per part and entry, with counts and sums; Spark adds those up.
Only the codebooks (``ENTRIES`` x dimension integers, bounded by parameters)
pass through the driver.  A vector that a third of the rows share is a run of
one-entry blocks.  The sum over equal labels is joined back in two ways: a label
with over 1 / ``HOT`` of the rows is broadcast (there are fewer than ``HOT``),
the others are joined by shuffle and are thin.

Defined cases: vectors that are null, empty or hold null or non-finite
components are dropped, as are vectors of another dimension than the
smallest kept vec_id's (its longest vector, where the id repeats); a dimension
that ``PARTS`` does not divide is filled up with zeros at its end; components
beyond +-2^24 after scaling count as that bound; rows with a null vec_id are
coded but start no codebook entry; an id that repeats starts one entry, from
its smallest vector, and each of its rows is coded; an empty table gives an
empty result; columns beyond vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import Scratch, lookup
from churnlens.session import ship_package

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 32
CHUNK = 16384
LIMIT = 1 << 24


def integers(x: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """``floor(SCALE * x)`` as int64, filled up with zeros to a multiple of ``parts``."""
    v = np.clip(np.floor(x.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)
    short = -v.shape[1] % parts
    return np.pad(v, ((0, 0), (0, short))) if short else v


def hilbert_keys(v: np.ndarray) -> np.ndarray:
    """Position of every row on a Hilbert curve through the box of all rows (up to 63 bits).

    Components are scaled to a grid of ``63 // d`` bits (one bit for the first
    63 of more components); the transposed index is that of Skilling (2004).
    """
    n, d = v.shape
    d = min(d, 63)
    bits = max(1, min(16, 63 // d))
    v = v[:, :d]
    low, span = v.min(axis=0), np.maximum(np.ptp(v, axis=0), 1)
    x = ((v - low) * ((1 << bits) - 1) // span).astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations, from the top bit down
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def blocks_of(v: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row order, block starts, low, high, sums) of Hilbert-sorted blocks of ``size`` rows."""
    order = np.argsort(hilbert_keys(v), kind="stable")
    starts = np.arange(0, len(v), size)
    s = v[order]
    return order, starts, np.minimum.reduceat(s, starts), np.maximum.reduceat(s, starts), np.add.reduceat(s, starts)


def _exact_dtype(book: np.ndarray, low: np.ndarray, high: np.ndarray) -> type:
    """float64 where every squared distance and product stays an exact integer, else int64."""
    most = max(int(np.abs(book).max(initial=0)), int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0)))
    return np.float64 if book.shape[1] * (2 * most) ** 2 < 1 << 53 else np.int64


def shortlists(book: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """blocks x entries: whether the entry can be nearest (ties included) to some point of the box."""
    least = np.zeros((len(low), len(book)), book.dtype)
    most = np.zeros_like(least)
    for j in range(book.shape[1]):
        under = low[:, j, None] - book[None, :, j]
        over = book[None, :, j] - high[:, j, None]
        out = np.maximum(np.maximum(under, over), 0)
        least += out * out
        far = np.maximum(np.abs(under), np.abs(over))
        most += far * far
    return least <= most.min(axis=1)[:, None]


def nearest_entries(book: np.ndarray, rows: np.ndarray, starts: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row, from its block's shortlist; ties go to the lower entry.

    Blocks that share a shortlist run through one kernel.
    """
    n = len(rows)
    entry, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sizes = np.diff(np.append(starts, n))
    packed = np.packbits(listed, axis=1)
    kinds, kind = np.unique(packed, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    by_kind = np.argsort(kind, kind="stable")
    cuts = np.searchsorted(kind[by_kind], np.arange(len(kinds) + 1))
    norms = (book * book).sum(axis=1)
    for k in range(len(kinds)):
        of = by_kind[cuts[k] : cuts[k + 1]]
        at = np.concatenate([np.arange(starts[b], starts[b] + sizes[b]) for b in of])
        names = np.flatnonzero(listed[of[0]])
        x = rows[at]
        score = norms[names] - 2 * (x @ book[names].T)  # squared distance less the row's own norm
        best = score.argmin(axis=1)
        entry[at] = names[best]
        error[at] = (score[np.arange(len(at)), best] + (x * x).sum(axis=1)).astype(np.int64)
    return entry, error


def _chunks(batches, dim: int):
    """Batches -> (vec_ids, labels, integer matrix) of up to ``CHUNK`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= CHUNK:
            t = pa.Table.from_batches(held)
            yield t.slice(0, CHUNK)
            held, n = t.slice(CHUNK).to_batches(), n - CHUNK
    if n:
        yield pa.Table.from_batches(held)


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    col = t.column("vec").combine_chunks()
    return integers(col.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim))


BLOCKS = "part int, n int, width int, low binary, high binary, sums binary, data binary"


def block_table(valid: DataFrame, dim: int) -> DataFrame:
    """Valid vectors -> flat blocks, one row per block and part (int32 data, int64 sums)."""

    def run(batches):
        for t in _chunks(batches, dim):
            v = _matrix(t, dim)
            width = v.shape[1] // PARTS
            for p in range(PARTS):
                x = np.ascontiguousarray(v[:, p * width : (p + 1) * width])
                order, starts, low, high, sums = blocks_of(x)
                flat = x[order].astype(np.int32)
                ends = np.append(starts[1:], len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(starts), p, np.int32)),
                        pa.array((ends - starts).astype(np.int32)),
                        pa.array(np.full(len(starts), width, np.int32)),
                        pa.array([r.astype(np.int32).tobytes() for r in low], pa.binary()),
                        pa.array([r.astype(np.int32).tobytes() for r in high], pa.binary()),
                        pa.array([r.tobytes() for r in sums], pa.binary()),
                        pa.array([flat[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    names=["part", "n", "width", "low", "high", "sums", "data"],
                )

    return valid.select("vec").mapInArrow(run, BLOCKS)


def _stack(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width).astype(np.int64)


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floor of its parts' mean; unused entries stay."""
    width = books[0].shape[1]

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for p in np.unique(parts):
                b = batch.filter(pa.array(parts == p))
                low, high = _stack(b.column("low"), np.int32, width), _stack(b.column("high"), np.int32, width)
                sums, n = _stack(b.column("sums"), np.int64, width), b.column("n").to_numpy().astype(np.int64)
                kind = _exact_dtype(books[p], low, high)
                book = books[p].astype(kind)
                listed = shortlists(book, low.astype(kind), high.astype(kind))
                alone = listed.sum(axis=1) == 1
                if alone.any():  # the whole block belongs to one entry
                    only = listed[alone].argmax(axis=1)
                    np.add.at(counts[p], only, n[alone])
                    np.add.at(totals[p], only, sums[alone])
                rest = np.flatnonzero(~alone)
                if len(rest):
                    rows = _stack(b.column("data").take(pa.array(rest)), np.int32, width)
                    starts = np.concatenate(([0], np.cumsum(n[rest])[:-1]))
                    entry, _ = nearest_entries(book, rows.astype(kind), starts, listed[rest])
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    counts[p][used] += np.diff(np.append(first, len(entry)))
                    totals[p][used] += np.add.reduceat(rows[order], first)
        for p in range(PARTS):
            used = np.flatnonzero(counts[p])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), p, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array(counts[p][used]),
                    pa.array(list(totals[p][used]), pa.list_(pa.int64())),
                ],
                names=["part", "entry", "n", "total"],
            )

    sent = blocks.mapInArrow(run, "part int, entry int, n long, total array<long>")
    each = sent.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    added = each.groupBy("part", "entry", "at").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    )
    out = [b.copy() for b in books]
    for r in added.collect():  # at most PARTS x ENTRIES x width rows
        out[r["part"]][r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
    return out


CODED = "vec_id long, label int, code string, error long"


def _coded(valid: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """Codes and squared errors of all rows; a chunk's blocks are made again in memory, rows keep their order."""

    def run(batches):
        for t in _chunks(batches, dim):
            v = _matrix(t, dim)
            width = v.shape[1] // PARTS
            codes = np.zeros((len(v), PARTS), np.uint8)
            errors = np.zeros(len(v), np.int64)
            for p in range(PARTS):
                x = np.ascontiguousarray(v[:, p * width : (p + 1) * width])
                order, starts, low, high, _ = blocks_of(x)
                kind = _exact_dtype(books[p], low, high)
                book = books[p].astype(kind)
                listed = shortlists(book, low.astype(kind), high.astype(kind))
                entry, error = nearest_entries(book, x[order].astype(kind), starts, listed)
                codes[order, p] = entry
                errors[order] += error
            text = codes.tobytes().hex()
            step = 2 * PARTS
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("vec_id").combine_chunks(),
                    t.column("label").combine_chunks(),
                    pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()),
                    pa.array(errors),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return valid.select("vec_id", "label", "vec").mapInArrow(run, CODED)


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vec`` of the rows whose vector is whole and finite."""
    x = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec")
    )
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & fine)


def seeds(valid: DataFrame) -> tuple[int, np.ndarray]:
    """Dimension and the integer vectors of the ``ENTRIES`` smallest vec_ids (at most that many rows are collected)."""
    ids = valid.where("vec_id is not null")
    lead = ids.groupBy("vec_id").agg(F.max(F.size("vec")).alias("dim")).orderBy("vec_id").limit(1).collect()
    if not lead:
        return 0, np.zeros((0, 0), np.int64)
    dim = lead[0]["dim"]
    right = ids.where(F.size("vec") == dim)
    first = right.select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES)
    found = right.join(F.broadcast(first), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec")).collect()
    found.sort(key=lambda r: r["vec_id"])
    return dim, integers(np.array([r["vec"] for r in found], np.float64))


def train(blocks: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks (one matrix per part position) after ``rounds`` rounds over the blocks."""
    books = [b.copy() for b in np.split(start, PARTS, axis=1)]
    for _ in range(rounds):
        books = _round(blocks, books)
    return books


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``rows(vec_id, embedding, label)`` -> vec_id, code, error, label_error, codebooks_sha256."""
    spark = rows.sparkSession
    ship_package(spark)
    valid = usable(rows)
    dim, start = seeds(valid)
    if not dim:
        none = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], none)
    valid = valid.where(F.size("vec") == dim)
    scratch = Scratch(spark, "codes")
    blocks = scratch.save(block_table(valid, dim), "blocks")
    books = train(blocks, start, rounds)
    scratch.drop(blocks)
    coded = scratch.save(_coded(valid, books, dim), "coded")
    sums = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    out = lookup(coded, sums, ["label"], "n", total).select("vec_id", "code", "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(codebook_digest(books)))


def _codes_sql() -> str:
    """DuckDB statement: the same rounds, every part against every entry."""
    head = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cuts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x
  FROM kept, range({PARTS}) AS t(p)),
book0 AS MATERIALIZED (
  SELECT p, i, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM cuts) WHERE i < {ENTRIES})"""
    dist = "list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f""",
near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, x, best.i AS i, best.d AS d FROM (
    SELECT c.vec_id, c.label, c.p, any_value(c.x) AS x, min({{'d': CAST({dist} AS BIGINT), 'i': b.i}}) AS best
    FROM cuts c JOIN book{r} b ON b.p = c.p GROUP BY c.vec_id, c.label, c.p))""")
        if r < ROUNDS:
            steps.append(f""",
means{r} AS (
  SELECT p, i, list(m ORDER BY k) AS x FROM (
    SELECT p, i, k, CAST(floor(sum(CAST(x[k] AS BIGINT)) / count(*)) AS BIGINT) AS m
    FROM near{r}, range(1, 1 + (SELECT max(len(x)) FROM cuts)) AS t(k) GROUP BY p, i, k) GROUP BY p, i),
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.i, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.i = b.i)""")
    return head + "".join(steps) + f""",
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', i)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, i)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded, digest"""


CODES_SQL = _codes_sql()
