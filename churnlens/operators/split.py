"""Exact, repeatable stratified train/test split by one cut point per class.

Rows are ordered inside each class by ``md5(id || '#seed')``, then by a hash
of the whole row; the first ``round(fraction * class size)`` rows of each
class are the test set.  So each class contributes exactly its share, and the
split is the same for every partitioning, cluster and table size.

The rows themselves are never shuffled or ranked.  Per class only the one key
at which the cut falls is looked for, among the hashes of the ids alone (a scan
of id and label): one aggregate counts the rows of all classes by the leading
digits of their hash (map-side combined), the bucket that holds the cut is
kept, and it is finished among its keys, or by more digits while it holds more
than ``FINISH_ROWS`` rows (a bound on what is ordered at the end, not on the
data).  Only if the cut divides the rows of one id is the hash of whole rows
computed, for the rows of that id.  All rows are then labelled by comparing
their hash with the cut in one narrow map.  Copies that agree in every column
cannot be told apart; where the cut falls among them they are counted and
written out again, as many in test and train as needed, so a third of the
table in one copied row is one row per map task.

Rows with a null label are kept with a null ``split``; a null id counts as
the empty text; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens import schema as S

FINISH_ROWS = 20_000
DIGITS = 4
COPIES_PER_ROW = 10_000


def split_hash(key: str = S.ID, seed: int = S.SPLIT_SEED):
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"#{seed}")))


def _cut_points(x: DataFrame, label: str, wanted, digits: int, finish_rows: int) -> dict:
    """Per class of ``x(label, __key)``: (key at the cut, wanted rows of that key, rows of that key); None where none are wanted.

    ``wanted``: how many rows of a class come before the cut, as a share of
    its size or as numbers by class.  The first aggregate counts all classes by
    the leading digits of their keys, which gives the sizes, too; only where
    the bucket at the cut is large are more digits counted.
    """
    own = Window.partitionBy(label)
    todo: dict = {}  # class -> (known digits, rank among the keys that have them)
    out: dict = {}
    first = True
    while first or todo:
        if first:
            inside, n_known = F.lit(True), F.lit(0)
            if isinstance(wanted, dict):
                rank = F.coalesce(*[F.when(F.col(label) == F.lit(c), F.lit(k)) for c, k in wanted.items()])
            else:
                # Decimal-free half-up rounding, as in the SQL statement of the split
                rank = F.floor(F.lit(wanted) * F.sum("n").over(own) + 0.5)
        else:
            inside = F.lit(False)
            for c, (known, _) in todo.items():
                inside = inside | ((F.col(label) == F.lit(c)) & F.col("__key").startswith(known))
            n_known = F.coalesce(*[F.when(F.col(label) == F.lit(c), F.lit(len(known))) for c, (known, _) in todo.items()])
            rank = F.coalesce(*[F.when(F.col(label) == F.lit(c), F.lit(k)) for c, (_, k) in todo.items()])
        counts = (
            x.where(inside)
            .groupBy(label, F.col("__key").substr(F.lit(1), n_known + digits).alias("part"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("__key").alias("lo"), F.max("__key").alias("hi"))
        )
        # at most classes x 16 ** digits rows
        found = (
            counts.withColumn("upto", F.sum("n").over(own.orderBy("part")))
            .withColumn("rank", rank)
            .where(((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))) | ((F.col("rank") <= 0) & (F.col("upto") == F.col("n"))))
            .collect()
        )
        first, todo = False, {}
        for r in found:
            c, left = r[label], r["rank"] - (r["upto"] - r["n"])
            if r["rank"] <= 0:
                out[c] = None
            elif r["lo"] == r["hi"]:
                out[c] = (r["lo"], left, r["n"])
            elif r["n"] <= finish_rows:
                keys = x.where((F.col(label) == F.lit(c)) & F.col("__key").startswith(r["part"])).groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
                for row in sorted(keys.collect(), key=lambda q: q["__key"]):
                    if left <= row["n"]:
                        out[c] = (row["__key"], left, row["n"])
                        break
                    left -= row["n"]
            else:
                todo[c] = (r["part"], left)
    return out


def stratified_split(
    df: DataFrame,
    label: str = S.LABEL,
    key: str = S.ID,
    test_fraction: float = S.SPLIT_TEST_FRACTION,
    seed: int = S.SPLIT_SEED,
    digits: int = DIGITS,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Add ``split``: 'test', 'train', or null where the label is null.  Runs a few counting jobs."""
    cols = df.columns
    hashed = split_hash(key, seed)
    known = df.where(F.col(label).isNotNull())
    cuts = _cut_points(known.select(label, hashed.alias("__key")), label, test_fraction, digits, finish_rows)
    # only ids that the cut divides are looked at row by row
    divided = {c: cut for c, cut in cuts.items() if cut and cut[1] < cut[2]}
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}))
    rows: dict = {}
    if divided:
        mine = F.lit(False)
        for c, cut in divided.items():
            mine = mine | ((F.col(label) == F.lit(c)) & (hashed == F.lit(cut[0])))
        at_ids = known.where(mine).select(label, row.alias("__key"))
        rows = _cut_points(at_ids, label, {c: cut[1] for c, cut in divided.items()}, digits, finish_rows)
    out, at_cut, n_test = F.lit(None).cast("string"), F.lit(False), F.lit(0)
    for c, cut in cuts.items():
        own = F.col(label) == F.lit(c)
        if cut is None:
            out = F.when(own, F.lit("train")).otherwise(out)
            continue
        test = hashed <= F.lit(cut[0])
        if c in rows:
            last, left, _ = rows[c]
            # the row hash is only computed where the id hash is that of the cut
            test = F.when(hashed < F.lit(cut[0]), True).when(hashed > F.lit(cut[0]), False).otherwise(row < F.lit(last))
            here = own & (hashed == F.lit(cut[0]))
            at_cut = F.when(here, row == F.lit(last)).otherwise(at_cut)
            n_test = F.when(own, F.lit(left)).otherwise(n_test)
        out = F.when(own, F.when(test, F.lit("test")).otherwise(F.lit("train"))).otherwise(out)
    if not rows:
        return df.withColumn("split", out)
    at_cut = F.coalesce(at_cut, F.lit(False))
    whole = df.where(~at_cut).withColumn("split", out)
    copies = df.where(at_cut).groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    sides = F.array(
        F.struct(F.lit("test").alias("split"), n_test.cast("long").alias("m")),
        F.struct(F.lit("train").alias("split"), (F.col("__n") - n_test).alias("m")),
    )
    again = copies.select(*cols, F.explode(sides).alias("__s")).where("__s.m > 0")
    again = again.withColumn("__i", F.explode(F.sequence(F.lit(0), F.floor((F.col("__s.m") - 1) / COPIES_PER_ROW))))
    here = F.least(F.lit(COPIES_PER_ROW), F.col("__s.m") - F.col("__i") * COPIES_PER_ROW).cast("int")
    again = again.withColumn("__j", F.explode(F.sequence(F.lit(1), here)))
    return whole.unionByName(again.select(*cols, F.col("__s.split").alias("split")))


def split_balance(split_df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Rows and positive-class share in train and test (unlabelled rows left out)."""
    return split_df.where(F.col("split").isNotNull()).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("double")).alias("churn_rate")
    )
