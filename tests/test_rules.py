"""Known facts about classification, credibility, plausibility and contracts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyledger import fixed_values as V
from skyledger.operators import classify as C, contracts as K, credibility as R, merge as M, plausibility as P, search as S

SAMPLES = [
    ("rainfall", "Intense rain over Pune all night, 90 mm in the gauge"),
    ("rainfall", "मूसलाधार बारिश से सड़कें बंद"),
    ("flooding", "Flood waters enter homes, families evacuated"),
    ("flooding", "गांव में बाढ़, राहत शिविर खुले"),
    ("thunderstorm", "Lightning strikes a tree during thunder"),
    ("thunderstorm", "वज्रपात और गरज"),
    ("heatwave", "Heat wave grips the plains, scorching noon"),
    ("heatwave", "भीषण गर्मी और लू"),
    ("fog", "Thick fog and poor visibility on the highway"),
    ("fog", "घना कोहरा छाया"),
    ("dust_storm", "A dust storm covers the town"),
    ("dust_storm", "धूल भरी आंधी आई"),
    ("strong_winds", "Winds of 70 km/h, squalls expected"),
    ("strong_winds", "तेज हवा चली"),
    ("other", "A quiet picnic by the lake"),
]


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(i, c, t) for i, (c, t) in enumerate(SAMPLES)]
    return C.classify_text(spark.createDataFrame(rows, "i int, want string, text string")).orderBy("i").collect()


def test_categories(classified):
    assert [r.event_category for r in classified] == [c for c, _t in SAMPLES]
    assert all(0.3 <= r.category_confidence <= 0.97 for r in classified)


def test_no_hit_is_other(classified):
    r = classified[-1]
    assert (r.event_category, r.category_confidence, r.severity, r.matched_terms) == ("other", 0.3, "unknown", [])
    assert set(r.rule_scores.asDict()) == set(V.CATEGORIES)


def test_prefilter_never_hides_a_match(spark):
    words = [" ".join(n) for n in C.NEEDLES.values()] + [t for _c, t in SAMPLES] + ["heavyrain", "ſtorm", "WİND and RAIN", "20mm", "ＲＡＩＮ"]
    df = spark.createDataFrame([(w,) for w in words], "text string")
    same = df.select(C.rule_hits(F.col("text")).alias("a"), C.rule_hits(F.col("text"), needles={}).alias("b"))
    assert same.filter("a <> b").count() == 0


def test_tie_goes_to_the_first_group(spark):
    rules = [("b", 1.0, 0, "x", "x"), ("a", 1.0, 0, "y", "y")]
    df = spark.createDataFrame([("x y",)], "text string")
    hits = C.rule_hits(F.col("text"), rules, {})
    assert df.select(C.winning_category(C.ranking(hits, rules)).alias("c")).first().c == "b"


def posts(spark, texts):
    rows = [("mastodon", t, None, None, None) for t in texts]
    return spark.createDataFrame(rows, "source string, text string, city string, lat double, lang string")


def test_credibility_order_and_bounds(spark):
    official = "Orange warning for heavy rain over the coast, see mausam.imd.gov.in for the bulletin"
    spam = "SHOCKING VIDEO!!! you won't believe http://x.example WIN MONEY MONEY MONEY NOW"
    a, b = R.credibility(posts(spark, [official, spam])).collect()
    assert a.credibility_score > b.credibility_score and a.credibility_score >= 0.5 >= b.credibility_score >= 0.05
    assert a.credibility_features.official_domain and not b.credibility_features.official_domain
    assert b.credibility_features.has_source_url and b.credibility_features.repeated_token
    assert b.credibility_features.lexicon_hits == ["you won't believe", "shocking video"]


def test_plausibility_reasons_and_limit(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "fog", 28.6, 77.2), (2, "rainfall", None, None), (3, "rainfall", 28.6, 77.2), (4, "heatwave", 10.0, 70.0), (5, "rainfall", 28.6, 179.95)]
    df = spark.createDataFrame([(*r, at) for r in rows], "id int, event_category string, lat double, lon double, observed_at timestamp_ntz")
    obs = spark.createDataFrame(
        [("p", "near", 28.7, 77.2, at, 30.0, 9.0, 5.0), ("p", "early", 28.7, 77.2, at - dt.timedelta(hours=4), 30.0, 1.0, 5.0),
         ("p", "over", 28.6, -179.95, at, 30.0, 7.0, 5.0), ("p", "late", 28.6, 77.2, at + dt.timedelta(hours=4, seconds=1), 30.0, 0.0, 5.0)],
        "provider string, station string, lat double, lon double, observed_at timestamp_ntz, temp_c double, precip_mm double, wind_kph double",
    )
    got = {r.id: r.plausibility for r in P.plausibility(df, obs).collect()}
    assert [got[i].reason for i in (1, 2, 4)] == ["no_reference_rule", "no_location", "no_reference_observation"]
    assert (got[3].station, got[3].agrees, got[3].observed) == ("early", False, 1.0)
    assert (got[5].station, got[5].agrees) == ("over", True)
    few = {r.id: r.plausibility for r in P.plausibility(df, obs, limit=50).collect()}
    assert few[3].station == "early" and few[5].station == "over"
    reuse = {r.id: r.plausibility for r in P.plausibility(df, obs, reuse=True).collect()}
    assert reuse[3].station == "early" and reuse[1].reason == "no_reference_rule"


def test_submissions(spark):
    rows = [("short", None, None), ("a long enough description", "meteor", None), ("a long enough description", "rainfall", "x"), (" a long enough description ", None, "28.6")]
    df = spark.createDataFrame([(t, None, None, la, None, c) for t, c, la in rows], "text string, city string, state string, lat string, lon string, event_category string")
    good, bad = K.check_submissions(df)
    assert [r.text for r in good.collect()] == ["a long enough description"]
    assert sorted(r.reasons for r in bad.collect()) == ["event_category: not an allowed value", "lat: invalid coordinate", "text: at least 10 characters"]


def test_raw_folding(spark):
    rows = [('{"a":{"b":1},"city_hint":"old"}', "Pune"), ("nope", None), ("[1]", "Pune"), (None, None)]
    df = spark.createDataFrame(rows, "raw string, city string")
    got = [r.j for r in df.select(M.fold_raw(F.col("raw"), F.col("city"), F.lit("")).alias("j")).collect()]
    assert got == ['{"a":{"b":1},"city_hint":"Pune"}', '{"_unparsed":"nope"}', '{"city_hint":"Pune"}', "{}"]


def test_search_order(spark):
    rows = [(1, "flood in town", ["#Rain"], "Pune", "Maharashtra"), (2, "flod in town", [], "Pune", "Maharashtra"), (3, "sunny day", ["#Sun"], "Goa", "Goa"), (4, "nothing", [], "floods", "x")]
    df = spark.createDataFrame(rows, "report_id int, text string, hashtags array<string>, city string, state string")
    ids = [r.report_id for r in S.search_ranked(df, "flood", 10).collect()]
    assert ids[:2] == [1, 2] and set(ids) == {1, 2, 4}
    only = df.filter("report_id <> 1")
    assert [r.report_id for r in S.search_ranked(df, "flood", 1, allowed=only).collect()] == [2]
