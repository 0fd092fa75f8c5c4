"""Report queries, analytics, maps and rollups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skyledger import fixed_values as V
from skyledger.catalog.core import AS_OF, AS_OF_SQL, Inputs, iso_sql, mean3_sql, query, share1_sql
from skyledger.operators import analytics as A, geo as G, reports as R
from skyledger.operators.reports import ReportFilter
from skyledger.plans import rollups as P
from skyledger.session import materialise, scratch_path

_BASE = "report_id, source, external_id, observed_at, state, city, lat, lon, event_category, verification_status, credibility_score, is_duplicate, lang, text"
_B = [c.strip() for c in _BASE.split(",")]
_TAGS = "(CASE WHEN hashtags_csv IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(hashtags_csv, ',') END)"
_CAT, _STATE = "coalesce(event_category, 'other')", "coalesce(state, 'Unknown')"


# -- filters ----------------------------------------------------------------
@query("i1_dates", ["reports"], f"""SELECT {_BASE} FROM reports
 WHERE observed_at >= TIMESTAMP '2024-01-05 00:00:00' AND observed_at <= TIMESTAMP '2024-01-12 23:59:59'""")
def _(x: Inputs):
    return R.date_bounds(x.reports, "2024-01-05", "2024-01-12").select(*_B)


@query("i2_ilike", ["reports"], f"""SELECT {_BASE} FROM reports WHERE state ILIKE 'maha%' AND city ILIKE 'MUMBA_'""")
def _(x: Inputs):
    return R.place_filter(x.reports, "maha%", "MUMBA_").select(*_B)


@query("i3_equality", ["reports"], f"""SELECT {_BASE} FROM reports
 WHERE event_category = 'fog' AND lang = 'hi' AND verification_status <> 'rejected'""")
def _(x: Inputs):
    return R.equality_filter(x.reports, category="fog", lang="hi", include_rejected=False).select(*_B)


@query("i4_dups_mincred", ["reports"], f"""SELECT {_BASE} FROM reports
 WHERE is_duplicate = FALSE AND credibility_score >= 0.6e0 AND source = 'rss' AND verification_status = 'verified'
   AND observed_at >= TIMESTAMP '2024-01-03 06:00:00'""")
def _(x: Inputs):
    f = ReportFilter(date_from="2024-01-03T06:00:00Z", source="rss", verification_status="verified", min_credibility=0.6)
    return R.filter_reports(x.reports, f).select(*_B)


@query("i5_page", ["full_reports"], """
 SELECT p.*, m.total, (m.total + 24) // 25 AS pages FROM (
   SELECT report_id, observed_at, credibility_score, text FROM full_reports WHERE is_duplicate = FALSE
   ORDER BY credibility_score DESC NULLS FIRST, report_id LIMIT 25 OFFSET 25) p
 JOIN (SELECT count(*) AS total FROM full_reports WHERE is_duplicate = FALSE) m ON TRUE""")
def _(x: Inputs):
    rows, meta = R.page_reports(R.filter_reports(x.full_reports), 2, 25, "credibility_score", "desc")
    return rows.select("report_id", "observed_at", "credibility_score", "text").withColumns(
        {"total": meta.select("total").scalar(), "pages": meta.select("pages").scalar()}
    )


@query("i5_jump", ["full_reports"], """SELECT report_id, credibility_score FROM full_reports WHERE is_duplicate = FALSE
 ORDER BY credibility_score DESC NULLS FIRST, report_id LIMIT 25 OFFSET 475""")
def _(x: Inputs):
    """Page 20 by its stored start: one page is gathered, not twenty."""
    reports = R.filter_reports(x.full_reports)
    starts = materialise(R.page_starts(reports, 25, "credibility_score"), "page-starts")
    found = starts.filter("page = 20").first()
    rows = R.seek_reports(reports, (found.value, found.id) if found else None, 25 if found else 0, "credibility_score", after=False)
    return rows.select("report_id", "credibility_score")


@query("i5_page_asc", ["full_reports"], """SELECT report_id, ingested_at, credibility_score FROM full_reports
 WHERE is_duplicate = FALSE AND lang = 'en' ORDER BY credibility_score ASC NULLS LAST, report_id LIMIT 100 OFFSET 0""")
def _(x: Inputs):
    rows, _meta = R.page_reports(R.filter_reports(x.full_reports, ReportFilter(lang="en")), 1, 100, "credibility_score", "asc")
    return rows.select("report_id", "ingested_at", "credibility_score")


@query("i7_search_like", ["reports"], f"""SELECT {_BASE} FROM reports WHERE is_duplicate = FALSE AND (
   text ILIKE '%flood%' OR coalesce(replace(hashtags_csv, ',', ' '), '') ILIKE '%flood%'
   OR coalesce(city, '') ILIKE '%flood%' OR coalesce(state, '') ILIKE '%flood%')""")
def _(x: Inputs):
    return R.search_like(x.reports, "flood").select(*_B)


@query("i8_detail", ["full_reports"], """SELECT report_id, source, external_id, observed_at, ingested_at, district, severity,
  confidence, credibility_score, verification_status, author, source_url, text FROM full_reports WHERE report_id IN (3, 77, 501)""")
def _(x: Inputs):
    return R.report_detail(x.full_reports, [3, 77, 501]).select(
        "report_id", "source", "external_id", "observed_at", "ingested_at", "district", "severity", "confidence",
        "credibility_score", "verification_status", "author", "source_url", "text",
    )


@query("i9_track", ["full_reports", "tokens"], """SELECT t.token, r.report_id, r.verification_status, r.verification_note, r.observed_at,
  r.city, r.state, r.event_category FROM tokens t JOIN full_reports r ON t.report_id = r.report_id""")
def _(x: Inputs):
    return R.track(x.derived("tokens"), x.full_reports)


@query("i10_media", ["full_reports"], """SELECT report_id, concat('k/', source, '/', external_id, '-2.jpg') AS key, 'image/jpeg' AS content_type,
  length(concat(source, '/', external_id)) + 2 AS size FROM full_reports WHERE media_n >= 2 AND lang = 'en'""")
def _(x: Inputs):
    df = x.full_reports
    keys = df.filter("lang = 'en'").select("report_id", F.concat(F.lit("k/"), "source", F.lit("/"), "external_id", F.lit("-2.jpg")).alias("key"))
    return R.report_media(df, keys).select("report_id", "key", "content_type", "size")


@query("i11_queue", ["full_reports"], """SELECT report_id, observed_at, is_duplicate, text FROM full_reports
 WHERE verification_status = 'pending' ORDER BY observed_at DESC, report_id LIMIT 200""")
def _(x: Inputs):
    rows, _meta = R.review_queue(x.full_reports, page=1, size=200)
    return rows.select("report_id", "observed_at", "is_duplicate", "text")


# -- exports and projections ------------------------------------------------
_EXPORT_SQL = ", ".join(
    iso_sql(c) + f" AS {c}" if c in ("observed_at", "ingested_at")
    else "translate(text, chr(10) || chr(13), '  ') AS text" if c == "text" else c
    for c in V.EXPORT_COLUMNS
)


@query("a8_export", ["full_reports"], f"""SELECT {_EXPORT_SQL} FROM (SELECT * FROM full_reports WHERE is_duplicate = FALSE
  ORDER BY observed_at DESC NULLS FIRST, id LIMIT 10000) n""")
def _(x: Inputs):
    return R.export_reports(x.full_reports)


@query("a9_search_docs", ["full_reports"], f"""SELECT id, source, author, text, lang, coalesce(hashtags_csv, '') AS hashtags,
  city, district, state, event_category, severity, verification_status, is_duplicate, coalesce(credibility_score, 0e0) AS credibility_score,
  lat, lon, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN TRUE ELSE FALSE END AS located,
  {iso_sql('observed_at')} AS observed_at, {iso_sql('ingested_at')} AS ingested_at, CAST(media_n AS BIGINT) AS media_count FROM full_reports""")
def _(x: Inputs):
    docs = R.to_search_docs(x.full_reports)
    return docs.withColumns(
        {"hashtags": F.array_join("hashtags", ","), "located": F.col("location").isNotNull()}
    ).drop("location")


@query("a10_live_feed", ["full_reports"], f"""SELECT id, source, city, state, event_category, severity, confidence, credibility_score,
  substring(text, 1, 280) AS text, lat, lon, {iso_sql('observed_at')} AS observed_at FROM full_reports WHERE is_duplicate = FALSE""")
def _(x: Inputs):
    return R.live_feed(x.full_reports)


@query("a10_live_tail", ["full_reports"], f"""SELECT id, {iso_sql('observed_at')} AS observed_at FROM full_reports WHERE is_duplicate = FALSE
  ORDER BY full_reports.observed_at DESC, id LIMIT 30""")
def _(x: Inputs):
    return R.live_tail(R.live_feed(x.full_reports)).select("id", "observed_at")


@query("b14_relabel", ["reports"], """SELECT source, count(*) AS n FROM (
  SELECT CASE WHEN external_id LIKE 'x-1%' THEN 'loadtest' ELSE source END AS source FROM reports) s GROUP BY source""")
def _(x: Inputs):
    return R.count_by_source(R.relabel(x.reports, "x-1%"))


# -- analytics --------------------------------------------------------------
@query("j1_summary", ["reports"], f"""SELECT count(*) AS total_reports,
  count(*) FILTER (WHERE verification_status = 'pending') AS pending, count(*) FILTER (WHERE verification_status = 'verified') AS verified,
  count(*) FILTER (WHERE verification_status = 'rejected') AS rejected, count(*) FILTER (WHERE verification_status = 'disputed') AS disputed,
  {share1_sql("count(*) FILTER (WHERE verification_status = 'verified')", 'count(*)')} AS verified_pct,
  coalesce({mean3_sql()}, 0e0) AS avg_credibility,
  count(*) FILTER (WHERE observed_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS reports_last_24h,
  count(*) FILTER (WHERE observed_at >= {AS_OF_SQL} - INTERVAL 1 HOUR) AS reports_last_hour,
  count(DISTINCT state) AS states_covered,
  (SELECT string_agg(concat(category, ':', n), ',' ORDER BY n DESC, category) FROM (
     SELECT {_CAT} AS category, count(*) AS n FROM reports WHERE is_duplicate = FALSE GROUP BY 1) c) AS categories,
  (SELECT count(*) FROM (SELECT DISTINCT event_type FROM events) s WHERE event_type <> 'error') AS sources_enabled
 FROM reports WHERE is_duplicate = FALSE""")
def _(x: Inputs):
    sources = x.table("events").select(F.col("event_type").alias("name")).distinct().withColumn("enabled", F.col("name") != "error")
    return A.summary(x.reports, sources, AS_OF)


for _bucket, _key, _col in (
    ("hour", "category", _CAT), ("day", "state", _STATE), ("week", "source", "source"),
    ("day", "city", "coalesce(city, 'Unknown')"), ("day", "lang", "coalesce(lang, 'unknown')"),
):
    @query(
        "j2_timeseries" if _key == "category" else f"j2_timeseries_{_bucket}_{_key}", ["reports"],
        f"""SELECT date_trunc('{_bucket}', observed_at) AS bucket, {_col} AS key, count(*) AS n FROM reports
            WHERE is_duplicate = FALSE GROUP BY 1, 2""",
    )
    def _(x: Inputs, bucket=_bucket, key=_key):
        return A.timeseries(x.reports, bucket, key)


@query("j3_by_state", ["reports"], f"""SELECT {_STATE} AS state, count(*) AS n, count(*) FILTER (WHERE verification_status = 'verified') AS verified,
  coalesce({mean3_sql()}, 0e0) AS avg_credibility, max(observed_at) AS last_seen FROM reports WHERE is_duplicate = FALSE
  GROUP BY 1 ORDER BY n DESC, state LIMIT 36""")
def _(x: Inputs):
    return A.by_state(x.reports)


@query("j4_by_category_trend", ["reports"], f"""SELECT m.category, m.n, coalesce(m.a, 0e0) AS avg_credibility, coalesce(t.c, 0) AS last_24h,
  coalesce(t.p, 0) AS prev_24h, coalesce(t.c, 0) - coalesce(t.p, 0) AS trend FROM (
   SELECT {_CAT} AS category, count(*) AS n, {mean3_sql()} AS a FROM reports WHERE is_duplicate = FALSE GROUP BY 1) m
  LEFT JOIN (SELECT {_CAT} AS category, count(*) FILTER (WHERE observed_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) AS c,
   count(*) FILTER (WHERE observed_at >= {AS_OF_SQL} - INTERVAL 48 HOUR AND observed_at < {AS_OF_SQL} - INTERVAL 24 HOUR) AS p
   FROM reports GROUP BY 1) t ON m.category = t.category""")
def _(x: Inputs):
    return A.by_category(x.reports, AS_OF)


@query("j5_by_source", ["reports"], f"""SELECT source, n, {share1_sql('n', 'CAST(sum(n) OVER () AS BIGINT)')} AS share_pct, coalesce(a, 0e0) AS avg_credibility
  FROM (SELECT source, count(*) AS n, {mean3_sql()} AS a FROM reports WHERE is_duplicate = FALSE GROUP BY 1) s""")
def _(x: Inputs):
    return A.by_source(x.reports)


@query("j6_top_hashtags", ["reports"], f"""SELECT lower(tag) AS tag, count(*) AS n FROM (
  SELECT unnest({_TAGS}) AS tag FROM reports WHERE is_duplicate = FALSE AND observed_at >= {AS_OF_SQL} - INTERVAL 7 DAY) u
  GROUP BY 1 ORDER BY n DESC, tag LIMIT 20""")
def _(x: Inputs):
    return A.top_hashtags(x.reports, AS_OF)


@query("j7_filter_options", ["reports"], """
  (SELECT DISTINCT 'state' AS kind, state AS value FROM reports WHERE state IS NOT NULL ORDER BY 2 LIMIT 100)
  UNION ALL (SELECT DISTINCT 'city', city FROM reports WHERE city IS NOT NULL ORDER BY 2 LIMIT 200)
  UNION ALL (SELECT DISTINCT 'source', source FROM reports WHERE source IS NOT NULL)
  UNION ALL (SELECT DISTINCT 'lang', lang FROM reports WHERE lang IS NOT NULL)""")
def _(x: Inputs):
    return A.filter_options(x.reports)


@query("j8_series_total", ["reports"], f"""SELECT date_trunc('hour', observed_at) AS bucket, count(*) AS n FROM reports WHERE is_duplicate = FALSE
  GROUP BY 1 ORDER BY bucket DESC LIMIT 200""")
def _(x: Inputs):
    return A.series_total(A.timeseries(x.reports, "hour", "category"))


@query("j8_top_bars", ["reports"], f"""SELECT {_CAT} AS label, count(*) AS value FROM reports WHERE is_duplicate = FALSE
  GROUP BY 1 ORDER BY value DESC, label LIMIT 8""")
def _(x: Inputs):
    return A.top_bars(A.by_category(x.reports, AS_OF), "category")


# -- maps -------------------------------------------------------------------
@query("k1_bbox", ["reports"], f"""SELECT {_BASE} FROM reports WHERE lon >= 72.5e0 AND lon <= 78e0 AND lat >= 17e0 AND lat <= 24e0""")
def _(x: Inputs):
    return G.within_bbox(x.reports, *G.parse_bbox("72.5,17,78,24")).select(*_B)


@query("k2_radius", ["reports"], f"""SELECT {_BASE} FROM reports WHERE lat IS NOT NULL AND lon IS NOT NULL AND 6371 * acos(least(1.0, cos(radians(19.0)) * cos(radians(lat))
  * cos(radians(lon) - radians(73.0)) + sin(radians(19.0)) * sin(radians(lat)))) <= 650""")
def _(x: Inputs):
    return G.within_radius(x.reports, 19.0, 73.0, 650.0).select(*_B)


@query("k3_features", ["full_reports"], f"""SELECT id, lon, lat, source, city, event_category, severity, confidence,
  coalesce(credibility_score, 0e0) AS credibility_score, CAST(media_n AS BIGINT) AS media_count, {iso_sql('observed_at')} AS observed_at,
  substring(text, 1, 200) AS text, count(*) OVER () = 2000 AS truncated
  FROM (SELECT * FROM full_reports WHERE is_duplicate = FALSE AND lat IS NOT NULL AND lon IS NOT NULL
  ORDER BY observed_at DESC, id LIMIT 2000) n""")
def _(x: Inputs):
    features = G.to_features(R.filter_reports(x.full_reports), V.MAP_LIMIT)
    p = F.col("properties")
    return features.select(
        *[p[c].alias(c) for c in ("id", "source", "city", "event_category", "severity", "confidence",
                                  "credibility_score", "media_count", "observed_at", "text")],
        F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"),
        G.feature_meta(features, V.MAP_LIMIT).select("truncated").scalar().alias("truncated"),
    )


# -- rollups ----------------------------------------------------------------
def rollup_sql(bucket: str, where: str = "TRUE", source: str = "reports") -> str:
    return f"""SELECT date_trunc('{bucket}', observed_at) AS bucket_start, {_STATE} AS state, {_CAT} AS event_category, source,
  count(*) AS report_count, count(*) FILTER (WHERE verification_status = 'verified') AS verified_count,
  count(*) FILTER (WHERE is_duplicate) AS duplicate_count,
  CASE WHEN count(credibility_score) > 0 THEN CAST(sum(CAST(round(credibility_score * 1000) AS BIGINT)) AS DOUBLE)
    / CAST(count(credibility_score) * 1000 AS DOUBLE) END AS avg_credibility
  FROM {source} WHERE {where} GROUP BY 1, 2, 3, 4"""


@query("m1_hourly", ["reports"], rollup_sql("hour"))
def _(x: Inputs):
    return P.rollup(x.reports, "hour")


@query("m2_daily", ["reports"], rollup_sql("day"))
def _(x: Inputs):
    return P.finish(P.coarsen(P.sums(x.reports, "hour"), "day"))


@query("m3_window", ["reports"], " UNION ALL ".join(
    f"SELECT '{n}' AS grain, w.* FROM ({rollup_sql(b, cut)}) w" for n, b, cut in (
        ("hourly", "hour", f"observed_at >= {AS_OF_SQL} - INTERVAL 47 HOUR"),
        ("daily", "day", f"observed_at >= {AS_OF_SQL} - INTERVAL 48 HOUR"))))
def _(x: Inputs):
    made = P.run_rollups(x.reports, AS_OF + dt.timedelta(minutes=25), 47, "hourly") | P.run_rollups(x.reports, AS_OF, 48, "daily")
    hourly, daily = (made[n].select(F.lit(n).alias("grain"), "*") for n in ("hourly", "daily"))
    return hourly.unionByName(daily)


@query("m5_rollup_job", ["reports"], rollup_sql("hour", f"observed_at >= {AS_OF_SQL} - INTERVAL 48 HOUR"))
def _(x: Inputs):
    """From files to files: two runs over trailing windows that overlap, and what is stored then."""
    path, out = scratch_path(x.spark, "m5-reports"), scratch_path(x.spark, "m5-rollups")
    x.reports.write.parquet(path)
    for run, as_of in enumerate((AS_OF, AS_OF + dt.timedelta(hours=6))):
        P.rollup_job(x.spark, path, out, run, as_of, as_of, 48, "hourly")
    return P.stored_rollup(x.spark, out, "hourly")


@query("a2_window_read", ["reports"], f"""SELECT state, event_category, source, verification_status, is_duplicate, credibility_score, observed_at
  FROM reports WHERE observed_at >= {AS_OF_SQL} - INTERVAL 48 HOUR""")
def _(x: Inputs):
    return P.trailing_window(x.reports, AS_OF, 48)
