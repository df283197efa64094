"""Mix sources to target weights at exact word budgets.

Method: every document gets a hash-random key (md5 of its id and a seed).
Inside each source the documents are ordered by that key; the key's leading
digits split the order into ranges, so prefix sums are distributed: word sums
per (source, range), running offsets of the ranges, then running sums inside a
range.  Each source is cut where its running sum meets its budget; a budget
over the source's size takes whole epochs first.  The document at the cut
gives its first words only, so the words taken equal the rounded target.

Targets: sources in code-point order (null last) weigh ``weights``, repeating,
and share ``share`` times all words; a target over ``max_epochs`` times its
source's words stops there and the excess goes to the others by weight.

Defined cases: null text has size 0; null source is a source of its own;
repeated rows are separate documents; equal keys are ordered by id, then by
size, so that rows that still tie are interchangeable; an empty table gives
an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
RANGE_DIGITS = 3  # 16 ** 3 key ranges in each source
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)`` -> adds ``target``; one row per source, so the windows are as small as the source list.

    The level at which no target is above its limit is found in one pass:
    with sources ordered by limit / weight, source i is the first one under
    its limit when the words left after filling all sources before it, shared
    by the weights that remain, do not exceed its limit.
    """
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    x = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size").cast("double") * max_epochs)
        .withColumn("total", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    order = every.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    x = x.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)
    x = x.withColumn("first", first)
    filled = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return x.select(
        "source",
        "source_size",
        F.when(filled, F.col("limit")).otherwise(F.col("first.level") * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry=("doc_id",)) -> DataFrame:
    """Every row's ``carry`` columns and ``source, size, source_size, target, taken`` (taken may be 0).

    With the text among ``carry`` the result is the mix itself: a document
    counts ``taken / size`` times, the last time up to its first words only.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}")))
    rows = docs.select(
        F.struct(*carry).alias("row"),
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    parts = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    o, t = offsets.alias("o"), targets.alias("t")
    plan = o.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.*", "t.source_size", "t.target")
    r, p = rows.alias("r"), plan.alias("p")
    joined = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.range") == F.col("p.range"))).select(
        "r.*", "p.offset", "p.source_size", "p.target"
    )
    inside = (
        Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rest = budget - epochs * F.col("source_size") - start
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    carried = [F.col("row")[c].alias(c) for c in carry if c != "source"]
    return joined.select(*carried, "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


#: The same mix in DuckDB SQL (independent statement for the check).
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#mix-1') AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total,
         CAST(source_size AS DOUBLE) * 2 AS lim
  FROM sources),
weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM ranked),
levels AS (
  SELECT *, lim / weight AS ratio,
         row_number() OVER (ORDER BY lim / weight, rank) AS place,
         (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
cut AS (
  SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN c.place IS NULL OR l.place < c.place THEN l.lim ELSE c.level * l.weight END AS target
  FROM levels l LEFT JOIN cut c ON true),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id NULLS FIRST, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size * size
              + greatest(0, least(size, budget - budget // source_size * source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
