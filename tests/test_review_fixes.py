"""Behaviour that earlier versions cut short or lost."""

import datetime as dt

from pyspark.sql import functions as F

from skyledger import fixed_values as V
from skyledger.functions.times import iso_utc
from skyledger.operators import classify, dedup, geo, merge, review

AT = dt.datetime(2024, 1, 1)


def test_bulk_takes_every_id(spark):
    reports = spark.range(300).selectExpr("id AS report_id", "'pending' AS verification_status", "CAST(NULL AS string) AS verification_note")
    ids = spark.range(250).selectExpr("id AS position", "id * 2 AS report_id")
    done = review.apply_bulk(reports, ids, "verified", None, "me", AT)
    row = done.result.first()
    assert (row.updated, row.missing) == (150, 100) and len(row.entity_id.split(",")) == 50
    assert sorted(int(r.id) for r in done.missing.collect()) == list(range(300, 500, 2))
    assert done.reports.filter("verification_status = 'verified'").count() == 150
    none = review.apply_bulk(reports, ids.limit(0), "verified", None, "me", AT)
    assert none.result.first()[:2] == (0, 0) and none.audit.count() == 0 and none.missing.count() == 0


def test_rule_with_a_known_term_and_its_own_pattern(spark):
    rules = [("rainfall", 1.0, 0, "rain", "drizzle")]
    assert spark.sql("SELECT 'drizzle today' AS text").select(classify.rule_hits(F.col("text"), rules).alias("h")).first().h == [0]


def test_times_are_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        row = spark.sql("SELECT timestamp_seconds(0) AS a, TIMESTAMP_NTZ '2024-01-02 03:04:05.5' AS b").select(iso_utc(F.col("a")), iso_utc(F.col("b"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(row) == ("1970-01-01T00:00:00+00:00", "2024-01-02T03:04:05.500000+00:00")


def test_box_is_read_and_checked():
    assert geo.parse_bbox("72.5, 18,73,19.25") == (72.5, 18.0, 73.0, 19.25)
    for wrong in ("", "1,2,3", "1,2,3,x", "200,0,1,1", "0,-91,1,1", "nan,0,1,1"):
        try:
            geo.parse_bbox(wrong)
        except ValueError:
            continue
        raise AssertionError(wrong)


def test_stored_duplicate_points_at_the_original(spark):
    from skyledger.streaming.reportlog import REPORT

    empty = spark.createDataFrame([], REPORT)
    row = {f.name: None for f in empty.schema}
    base = row | {"source": "rss", "text": "t", "observed_at": AT, "media": [], "is_duplicate": False, "credibility_features": "{}", "plausibility": "{}"}
    batch = spark.createDataFrame(
        [base | {"external_id": "a"}, base | {"external_id": "b", "is_duplicate": True, "duplicate_of": "rss:a"}, base | {"external_id": "c", "is_duplicate": True, "duplicate_of": "rss:gone"}],
        empty.schema,
    ).withColumns({"geocode_method": F.lit(None).cast("string"), "dedup_score": F.lit(None).cast("double")})
    stored = merge.merge_reports(empty, batch, "observed_at", AT)
    rows = {r.external_id: r for r in stored.collect()}
    assert rows["b"].duplicate_of == rows["a"].id and rows["a"].duplicate_of is None and rows["c"].duplicate_of is None
    assert rows["a"].credibility_features == "{}" and rows["a"].plausibility == "{}"


def test_a_future_dated_post_expires_nothing(spark):
    text = "heavy rain in the city since the early morning hours of today"
    shape = "source string, external_id string, text string, observed_at timestamp"
    day = lambda n: AT + dt.timedelta(days=n)
    first, registry = dedup.dedup_batch(spark.createDataFrame([("rss", "a", text, day(0))], shape), "observed_at")
    assert V.DEDUP_TTL_DAYS == 7
    batch = [("rss", "b", text, day(1)), ("rss", "far", "something else entirely, far ahead of its time", day(2000)), ("rss", "late", text, day(8)), ("rss", "later", text, day(9))]
    out, _ = dedup.dedup_batch(spark.createDataFrame(batch, shape), "observed_at", registry)
    assert {r.external_id: r.duplicate_of for r in out.collect()} == {"b": "rss:a", "far": None, "late": None, "later": "rss:late"}
