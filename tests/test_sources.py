"""Quarantine of malformed CSV lines, and exports that are whole or not there."""

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.sources import csv_quarantine, csv_rows, export_results, read_export, split_subscribers_csv, subscriber_view
from churnlens.sources.subscribers import csv_lines

from conftest import SF_SMALL

HEADER = ",".join(src for src, _, _ in S.CSV_COLUMNS)
GOOD = "1,Male,0,Yes,No,5,Yes,No,DSL,Yes,No,No,No,No,No,Month-to-month,Yes,Mailed check,29.85, ,No"


def _split(spark, folder, lines, name="in"):
    (folder / name).mkdir()
    (folder / name / "a.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    out = str(folder / f"{name}-out")
    counts = {r["kind"]: r["n_rows"] for r in split_subscribers_csv(spark, str(folder / name), out).collect()}
    return counts, csv_rows(spark, out).collect(), csv_quarantine(spark, out).collect()


def test_malformed_lines_are_set_apart_whole(spark, tmp_path):
    quoted = GOOD.replace("Mailed check", '"check, mailed"')
    missing = GOOD.replace("29.85", "")
    bad_number, bad_int = GOOD.replace("29.85", "29.85 USD"), GOOD.replace(",5,", ",five,")
    short, long = GOOD.rsplit(",", 1)[0], GOOD + ",more"
    counts, rows, bad = _split(spark, tmp_path, [GOOD, bad_number, quoted, short, missing, long, "", bad_int])
    assert counts == {"rows": 3, "quarantine: value": 2, "quarantine: fields": 2}
    assert {r["line"]: r["reason"] for r in bad} == {bad_number: "value", bad_int: "value", short: "fields", long: "fields"}
    assert all(r["file"].endswith("a.csv") for r in bad)
    assert sorted(str(r[S.MONTHLY]) for r in rows) == ["29.85", "29.85", "None"]
    assert {r["payment_method"] for r in rows} == {"Mailed check", "check, mailed"}


def test_only_good_only_bad_and_no_lines(spark, tmp_path):
    assert _split(spark, tmp_path, [GOOD], "good")[0] == {"rows": 1}
    assert _split(spark, tmp_path, ["a,b"], "bad")[0] == {"quarantine: fields": 1}
    assert _split(spark, tmp_path, [], "none")[0] == {}


def test_subscribers_survive_the_csv_layout(spark, tmp_path):
    subs = subscriber_view(spark, SF_SMALL)
    csv_lines(subs).write.text(str(tmp_path / "lines"))
    out = str(tmp_path / "out")
    assert [tuple(r) for r in split_subscribers_csv(spark, str(tmp_path / "lines"), out, header=False).collect()] == [("rows", subs.count())]
    cols = [S.ID, S.TENURE, S.MONTHLY, S.CONTRACT, S.CHURN, "online_backup"]
    assert csv_rows(spark, out).select(*cols).exceptAll(subs.select(*cols)).count() == 0


def _broken(df):
    return df.withColumn("x", F.when(F.col("id") >= 0, F.raise_error(F.lit("lost"))).cast("long"))


def test_export_is_replaced_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "export")
    assert read_export(spark, out) == {}
    two = lambda n: {"a": spark.range(n), "b": spark.range(n * 2)}
    first = export_results(two(3), out).collect()
    assert {(r["dataset"], r["rows"]) for r in first} == {("a", 3), ("b", 6)}
    with pytest.raises(Exception, match="lost"):
        export_results({"a": spark.range(100), "b": _broken(spark.range(5))}, out)
    seen = read_export(spark, out)
    assert {k: v.count() for k, v in seen.items()} == {"a": 3, "b": 6}  # the second table's write died: the old version, whole
    export_results({**two(4), "c": spark.range(1)}, out)
    assert {k: v.count() for k, v in read_export(spark, out).items()} == {"a": 4, "b": 8, "c": 1}
    assert {k: v.count() for k, v in seen.items()} == {"a": 3, "b": 6}  # a reader of the version before can finish
    export_results(two(5), out)
    export_results(two(6), out)
    kept = sorted(p.name for p in (tmp_path / "export").iterdir() if p.name.startswith("version-"))
    manifests = sorted(p.name for p in (tmp_path / "export" / "manifests").iterdir() if p.suffix == ".json")
    assert manifests == ["000000000003.json", "000000000004.json"] and len(kept) <= 3
    assert {k: v.count() for k, v in read_export(spark, out).items()} == {"a": 6, "b": 12}


def test_export_of_empty_tables_is_counted(spark, tmp_path):
    out = export_results({"none": spark.range(0)}, str(tmp_path / "e"))
    assert [(r["dataset"], r["rows"]) for r in out.collect()] == [("none", 0)]
    assert read_export(spark, str(tmp_path / "e"))["none"].columns == ["id"]
