"""Near-duplicate documents by min-max hashing of word shingles.

Method: a document's set is its distinct five-word shingles.  ``PERMS`` hash
permutations of the set are evaluated once each and both the minimum and the
maximum are kept, so ``2 x PERMS`` signature values cost half the hash
evaluations of plain minwise hashing.  The values are cut into bands; two
documents that agree on a band are candidates, and every candidate is
confirmed on the full sets.  With bands of ``ROWS`` = 4 values and 32 bands a
pair at the threshold of 0.75 escapes all bands with probability
(1 - 0.75^4)^32 = 5e-6.

Copies: documents with equal sets collapse to one node before banding (a
128-bit set fingerprint; map-side combined), so a group of copies costs one
node.  Near copies: each band bucket first links its members to one
representative (linear in the bucket); confirmed links give interim classes,
and only members of *different* classes in a bucket are then paired, so a
large group of near copies never expands into all its pairs while no link
between different classes is lost.  Buckets with more than ``BUCKET`` members
left in different classes are paired through their rarest shingles (the
prefix rule: two sets with similarity >= t share one of the rarest
``n - ceil(t n) + 1`` shingles under any common order, and the ranks of the
first shared one bound the overlap), which is exact and keeps common lines
from pairing everything.

Defined cases: null or empty text has an empty set and is linked with
nothing; fewer than five words make one shingle, the whole sequence; rows
with the same doc_id are one document (linked); rows with a null doc_id
cannot be named in a class: component null, kept true, linked with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.common import Scratch
from churnlens.llm.components import connected_components

PERMS = 64
ROWS = 4
BUCKET = 16

_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, 2 * PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document, sorted inside it, and their offsets."""
    w = T.words_of(data, offsets)
    sh, off = T.shingles_of(w.hashes(), w.first, k)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((sh, doc))
    sh = sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], np.searchsorted(doc[new], np.arange(len(off)))


def _bands(sh: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Band keys (documents x bands) from minima and maxima; every document has shingles."""
    at, n = off[:-1], len(off) - 1
    sig = np.empty((2 * PERMS, n), np.uint64)
    for j in range(PERMS):
        h = sh * _MULT[j]
        h ^= h >> np.uint64(32)
        sig[j] = np.minimum.reduceat(h, at)
        sig[PERMS + j] = np.maximum.reduceat(h, at)
    keys = (sig * _BAND[:, None]).reshape(2 * PERMS // ROWS, ROWS, n).sum(axis=1, dtype=np.uint64)
    keys = T.mix64(keys + np.arange(len(keys), dtype=np.uint64)[:, None])
    return keys.T.view(np.int64)


SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, set size, 128-bit set fingerprint and band keys (null for empty sets)."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for i, j, data, offsets in T.text_chunks(b.column("text")):
                sh, off = _sets(data, offsets, k)
                n = np.diff(off)
                has = np.flatnonzero(n)
                f1, f2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                bands: list = [None] * (j - i)
                if len(has):
                    at = off[:-1][has]
                    f1[has] = np.add.reduceat(T.mix64(sh ^ np.uint64(0x5851F42D4C957F2D)), at)
                    f2[has] = np.add.reduceat(T.mix64(sh + np.uint64(0x14057B7EF767814F)), at)
                    b_keys = _bands(sh, np.append(at, len(sh)))
                    flat = pa.array(b_keys.reshape(-1))
                    at_row = np.zeros(j - i, bool)
                    at_row[has] = True
                    ends = np.concatenate(([0], np.cumsum(at_row))) * b_keys.shape[1]
                    bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(~at_row))
                else:
                    bands = pa.nulls(j - i, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bands],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """``node`` plus its whole shingle set as sorted little-endian 64-bit values in one binary column."""

    def run(batches):
        for b in batches:
            for i, j, data, offsets in T.text_chunks(b.column("text")):
                sh, off = _sets(data, offsets, k)
                raw = [sh[off[d] : off[d + 1]].tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column("node").slice(i, j - i), pa.array(raw, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets satisfy 100 * |A & B| >= percent * |A | B|."""

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            last, left = None, None
            for r, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"))):
                if b.column("a")[r].as_py() != last:
                    last, left = b.column("a")[r].as_py(), np.frombuffer(x.as_buffer(), np.uint64)
                right = np.frombuffer(y.as_buffer(), np.uint64)
                low, high = sorted((len(left), len(right)))
                if 100 * low < percent * high:
                    continue
                both = np.concatenate((left, right))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep[r] = 100 * inter >= percent * (len(left) + len(right) - inter)
            yield pa.RecordBatch.from_arrays(
                [b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"]
            )

    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a"
    )
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each bucket member with the bucket's representative (least by a hash that differs between buckets)."""
    order = F.struct(F.xxhash64("bucket", "node").alias("o"), F.col("node").alias("rep"))
    reps = members.groupBy("bucket").agg(F.min(order).alias("r"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return (
        members.join(reps.select("bucket", F.col("r.rep").alias("rep")), "bucket")
        .where(F.col("node") != F.col("rep"))
        .select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b"))
        .distinct()
    )


def _sized(left, right, percent: int):
    return (100 * F.least(left, right)) >= (percent * F.greatest(left, right))


def _prefix_tokens(hot_nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, token, r): the rarest ``n - ceil(t n) + 1`` shingles of every node, r = 1 the rarest.

    Rarity is counted over ``hot_nodes``; ties go by the shingle's value.  Any
    two similar sets share one of these tokens.
    """

    def run(batches):
        for b in batches:
            size = np.array([len(x.as_buffer()) // 8 if x.is_valid else 0 for x in b.column("shingles")])
            flat = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in b.column("shingles")] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column("node").to_numpy(), size)), pa.array(flat), pa.array(np.repeat(size, size))],
                names=["node", "token", "n"],
            )

    tokens = sets.join(hot_nodes, "node", "left_semi").mapInArrow(run, "node long, token long, n long")
    freq = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = tokens.join(freq, "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    kept = known.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return kept.where("df > 1").select("node", "token", "r")


def _cross_pairs(members: DataFrame, sets: DataFrame, percent: int, bucket_limit: int) -> DataFrame:
    """Pairs of bucket members that are in different interim classes (a > b)."""
    mixed = (
        members.groupBy("bucket")
        .agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("m"))
        .where(F.col("c0") != F.col("c1"))
        .select("bucket", "m")
    )
    rest = members.join(mixed, "bucket")
    few = rest.where(F.col("m") <= bucket_limit).select("bucket", "node", "c", "n")
    many = rest.where(F.col("m") > bucket_limit).select("node", "c", "n").distinct()
    tokens = _prefix_tokens(many.select("node"), sets, percent)
    # a node of a hot bucket meets the others under its rare shingles instead
    split = many.join(tokens, "node").select(F.col("token").alias("bucket"), "node", "c", "n", "r")

    def pairs(side: DataFrame, more) -> DataFrame:
        x, y = side.alias("x"), side.alias("y")
        cond = (
            (F.col("x.bucket") == F.col("y.bucket"))
            & (F.col("x.node") > F.col("y.node"))
            & (F.col("x.c") != F.col("y.c"))
            & _sized(F.col("x.n"), F.col("y.n"), percent)
        )
        return x.join(y, cond & more).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    # the first shingle that two sets share leaves at most this many common ones;
    # 100 i >= p (nx + ny - i)  <=>  (100 + p) i >= p (nx + ny)
    common = F.least(F.col("x.n") - F.col("x.r"), F.col("y.n") - F.col("y.r")) + 1
    reachable = (100 + percent) * common >= percent * (F.col("x.n") + F.col("y.n"))
    return pairs(few, F.lit(True)).unionByName(pairs(split, reachable)).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, bucket_limit: int = BUCKET) -> DataFrame:
    """Every row's ``doc_id, n_shingles, component_id, kept`` (one result row per input row)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    signed = scratch.save(signatures(docs, k), "signatures")
    fp = ["f1", "f2"]
    named = signed.where("n_shingles > 0 and doc_id is not null")
    # one node per distinct set, named by its smallest document
    nodes = scratch.save(
        named.groupBy(*fp).agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    members = scratch.save(nodes.select(F.col("node"), F.col("n"), F.explode("bands").alias("bucket")), "members")
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    members = scratch.save(members.join(crowded, "bucket"), "crowded")
    star = scratch.save(_star_pairs(members.select("bucket", "node")), "star")
    wanted = members.select("node").distinct()
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
        .join(wanted, "node", "left_semi")
    )
    # only the texts that a node is named by: one of each set is enough
    sets = scratch.save(shingle_sets(texts, k).where(F.length("shingles") > 0).distinct(), "sets")
    links = scratch.save(similar(star, sets, percent), "links")
    classes = connected_components(links, scratch)
    placed = members.join(classes, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("c"))
    placed = scratch.save(placed, "placed")
    cross = _cross_pairs(placed, sets, percent, bucket_limit).join(star, ["a", "b"], "left_anti")
    more = similar(cross, sets, percent)
    # rows of one doc_id are one document, also when their sets differ
    of_doc = named.join(nodes.select(*fp, "node"), fp).select("doc_id", "node")
    same = of_doc.where(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    copies = same.join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    final = connected_components(links.unionByName(more).unionByName(copies), scratch)
    final = scratch.save(final, "classes")
    placed_nodes = nodes.select(*fp, "node").join(final, "node", "left").select(*fp, F.coalesce("component", "node").alias("component"))
    out = signed.join(placed_nodes, fp, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
