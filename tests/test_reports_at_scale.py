"""Stored search index, pages by key, the file-to-file rollup, and the readers and writers of files."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from skyledger.catalog.core import Inputs
from skyledger.operators import reports as R, search as S
from skyledger.plans import rollups
from skyledger.session import scratch_path
from skyledger.sources import media
from skyledger.streaming import stream as ST


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_stored_index_finds_the_same(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    rows = x.reports.filter("NOT is_duplicate")
    path = scratch_path(spark, "index")
    S.store_index(rows, path, buckets=16)
    index = S.open_index(spark, path)
    for q in ("flod evacuation Patna", "fog", "user 12", "Maharashtra", "बारिश", "nothing at all like it zzzzzz"):
        want = [(r.report_id, round(r.score, 9)) for r in S.search_ranked(rows, q, 40).collect()]
        assert [(r.report_id, round(r.score, 9)) for r in S.search_ranked(None, q, 40, index=index).collect()] == want
    only = rows.filter("report_id % 3 = 0")
    ids = {r.report_id for r in S.search_ranked(None, "fog", 500, only, index=index).collect()}
    assert ids and all(i % 3 == 0 for i in ids)
    plan = plan_of(S.search_ranked(None, "evacuation", 10, index=index))
    opened = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert opened and 0 < len((opened[1] or opened[2]).split(",")) <= 4  # the folders of one word and its near spellings, not all sixteen


def test_pages_by_key(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    rows = x.full_reports.filter("report_id < 333")
    for sort in ("credibility_score", "observed_at"):
        for order in ("asc", "desc"):
            whole = R.page_reports(rows, 1, 100, sort, order)[0].collect()
            whole += [r for p in (2, 3, 4) for r in R.page_reports(rows, p, 100, sort, order)[0].collect()]
            got, start = [], None
            while page := R.seek_reports(rows, start, 100, sort, order).collect():
                got += page
                start = (page[-1][sort], page[-1].report_id)
            assert [r.report_id for r in got] == [r.report_id for r in whole] and len(got) == 333
            starts = {r.page: (r.value, r.id) for r in R.page_starts(rows, 50, sort, order).collect()}
            assert starts == {i // 50 + 1: (r[sort], r.report_id) for i, r in enumerate(whole) if i % 50 == 0}
            jumped = R.seek_reports(rows, starts[5], 50, sort, order, after=False).collect()
            assert [r.report_id for r in jumped] == [r.report_id for r in whole[200:250]]
    assert R.seek_reports(rows.limit(0)).count() == 0 and R.page_starts(rows.limit(0)).count() == 0


def test_rollup_job_reads_the_window_only(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    path, out = scratch_path(spark, "reports"), scratch_path(spark, "rollups")
    x.full_reports.drop("media").write.parquet(path)
    as_of = dt.datetime(2024, 1, 20)
    plan = plan_of(rollups.read_window(spark, path, as_of))
    assert "GreaterThanOrEqual(observed_at" in plan and "ReadSchema: struct<source:string" in plan and "text:" not in plan.split("ReadSchema")[1]
    for _ in range(2):  # the same run twice
        rollups.rollup_job(spark, path, out, 0, as_of, as_of)
    want = rollups.run_rollups(x.reports, as_of)
    for name, df in want.items():
        assert df.exceptAll(rollups.stored_rollup(spark, out, name)).isEmpty() and df.count() == rollups.stored_rollup(spark, out, name).count() > 0
    before = rollups.stored_rollup(spark, out, "hourly").count()
    spark.read.parquet(path).withColumn("credibility_score", F.lit(0.5)).write.parquet(path + "-2")
    rollups.rollup_job(spark, path + "-2", out, 1, as_of, as_of + dt.timedelta(hours=1))  # computed later, so it wins
    after = rollups.stored_rollup(spark, out, "hourly")
    assert after.count() == before and after.filter("avg_credibility <> 0.5").count() == 0


def test_files_in_and_out(spark, sf_dir, tmp_path):
    for name, content in (("a.png", b"12345"), ("b.mp4", b"1" * 10), ("c.exe", b"9"), ("d.JPG", b"")):
        (tmp_path / "in" / "sub").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "sub" / name).write_bytes(content)
    rows = media.catalogue_media(media.read_media(spark, str(tmp_path / "in")), "docs").collect()
    assert {(r.content_type, r["size"]) for r in rows} == {("image/png", 5), ("video/mp4", 10)}
    assert [r.path.rsplit("/", 1)[1] for r in media.read_media(spark, str(tmp_path / "in"), "*.mp4").collect()] == ["b.mp4"]

    export = R.export_reports(Inputs(spark, sf_dir).full_reports, 50)
    for fmt in ("csv", "json"):
        R.write_export(export, str(tmp_path / fmt), fmt)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == export.columns and [r.id for r in back.collect()] == [r.id for r in export.collect()]
    assert [r.id for r in spark.read.json(str(tmp_path / "json")).collect()] == [r.id for r in export.collect()]

    (tmp_path / "landed").mkdir()
    lines = [json.dumps({"source": "s", "external_id": str(i), "text": "t" if i else None}) for i in range(3)] + ["no json"]
    (tmp_path / "landed" / "0.txt").write_text("\n".join(lines))
    posts = ST.read_raw_stream(spark, "text", str(tmp_path / "landed"))
    out = str(tmp_path / "out")
    ST.run_stream(posts, lambda df, i: ST.write_part(df, out, i), str(tmp_path / "check"), None).awaitTermination()
    assert {r.external_id for r in spark.read.parquet(out).collect()} == {"1", "2"}
