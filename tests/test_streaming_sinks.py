import os
import tempfile

from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import model as M
from churnlens.operators import retention, split
from churnlens.operators.features import scorecard
from churnlens.operators.quantile import exact_median
from churnlens.operators.clean import parse_total_charges
from churnlens.plans import modelling as MP
from churnlens.sources import export_results, read_subscribers_csv, subscriber_view, write_report
from churnlens.streaming import start_scoring

from conftest import SF_SMALL


def test_stream_scores_like_batch(spark):
    base = subscriber_view(spark, SF_SMALL)
    median = exact_median(parse_total_charges(base), "total_charges_parsed")
    df = MP.subscribers(spark, SF_SMALL)
    sp = split.stratified_split(df)
    model = M.train(df, sp.where("split = 'train'"), M.GBTParams(rounds=3, depth=3))
    src = tempfile.mkdtemp(prefix="stream-src-")
    base.write.mode("overwrite").parquet(os.path.join(src, "part1"))
    sink = tempfile.mkdtemp(prefix="stream-out-")
    q = start_scoring(spark, os.path.join(src, "part1"), base.schema, model, median,
                      sink, tempfile.mkdtemp(prefix="stream-ckpt-"))
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    batch = M.score(model, df).select(S.ID, F.col(S.PROB).alias("p_batch"))
    joined = out.join(batch, S.ID)
    assert out.count() == df.count() == joined.count()
    assert joined.where(F.abs(F.col(S.PROB) - F.col("p_batch")) > 1e-12).count() == 0


def test_csv_source_and_sinks(spark, tmp_path):
    header = ",".join(src for src, _, _ in S.CSV_COLUMNS)
    line = "0001-A,Male,0,Yes,No,5,Yes,No,DSL,Yes,No,No,No,No,No,Month-to-month,Yes,Mailed check,29.85, ,No"
    p = tmp_path / "subs.csv"
    p.write_text(header + "\n" + line + "\n")
    df = read_subscribers_csv(spark, str(p))
    r = df.first()
    assert r[S.ID] == "0001-A" and r[S.TENURE] == 5 and r[S.MONTHLY] == 29.85 and r[S.TOTAL_RAW] == " "
    out = export_results({"subs": df, "profile": df.groupBy(S.CONTRACT).count()}, str(tmp_path / "export"))
    assert {(x["dataset"], x["rows"]) for x in out.collect()} == {("subs", 1), ("profile", 1)}


def test_write_report(spark, tmp_path):
    sc = scorecard(MP.subscribers(spark, SF_SMALL), "score")
    lines = retention.report_lines(sc)
    write_report(lines, str(tmp_path / "report"))
    text = spark.read.text(str(tmp_path / "report")).collect()
    assert len(text) == lines.count()
    assert any(t["value"].startswith("Total High-Risk Customers: ") for t in text)
