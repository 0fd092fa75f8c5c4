"""Contracts, merges, review workflow and operations tables."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, functions as F

from skyledger import fixed_values as V
from skyledger.catalog.core import AS_OF, Inputs, query
from skyledger.operators import contracts as C, merge as M, ops as O, review as W
from skyledger.plans import rollups as P
from skyledger.catalog.reporting import rollup_sql
from skyledger.session import scratch_path
from skyledger.sources import feeds
from skyledger.streaming.seenstore import SeenStore

_LATER = dt.datetime(2024, 2, 1)
_LATER_SQL = "TIMESTAMP '2024-02-01 00:00:00'"

# -- contracts --------------------------------------------------------------
_OBJ = "json_valid(value)"
_GET = "json_extract_string({0}, '$.{1}')"


def _g(name: str) -> str:
    return f"(CASE WHEN {_OBJ} THEN json_extract_string(CASE WHEN {_OBJ} THEN value ELSE '{{}}' END, '$.{name}') END)"


_ERRORS_SQL = f"""concat_ws('; ',
  CASE WHEN NOT {_OBJ} THEN 'payload: not a JSON object' END,
  CASE WHEN {_OBJ} AND {_g('source')} IS NULL THEN 'source: field required' END,
  CASE WHEN {_OBJ} AND trim({_g('text')}) = '' THEN 'text: must not be empty' END,
  CASE WHEN {_OBJ} AND TRY_CAST({_g('observed_at')} AS TIMESTAMPTZ) IS NULL THEN 'observed_at: not a datetime' END,
  CASE WHEN {_OBJ} AND {_g('lat')} IS NOT NULL AND TRY_CAST({_g('lat')} AS DOUBLE) IS NULL THEN 'lat: not a number' END)"""
_CHECKED = {"checked": f"SELECT *, {_ERRORS_SQL} AS errors FROM messages"}


@query("c1_raw_contract", ["messages"], f"""SELECT report_id, {_g('source')} AS source, {_g('external_id')} AS external_id,
  trim({_g('text')}) AS text, CAST(replace({_g('observed_at')}, 'Z', '') AS TIMESTAMP) AS observed_at, TRY_CAST({_g('lat')} AS DOUBLE) AS lat,
  CASE WHEN report_id % 3 = 0 THEN '#IMD,#Rain' ELSE '' END AS hashtags, {_g('city_hint')} AS city_hint,
  CASE WHEN report_id % 5 = 0 THEN '{{"channel":"sms"}}' END AS extra FROM checked WHERE errors = ''""", extra=_CHECKED)
def _(x: Inputs):
    good, _dead = C.raw_contract(x.spread(x.derived("messages")))
    return good.select(
        "report_id", "source", "external_id", "text", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "lat",
        F.array_join("hashtags", ",").alias("hashtags"), "city_hint", "extra",
    )


@query("a7_contract_split", ["messages"], """SELECT 'weather.raw.posts' AS topic, 'raw' AS stage,
  substring(concat('ValidationError: ', errors), 1, 2000) AS error, value AS payload FROM checked WHERE errors <> ''""", extra=_CHECKED)
def _(x: Inputs):
    _good, dead = C.raw_contract(x.spread(x.derived("messages")))
    return dead


_DEDUPED = """SELECT report_id, source, external_id, text, city, 'deduped' AS stage, FALSE AS is_duplicate,
  CAST(NULL AS VARCHAR) AS duplicate_of, CAST(NULL AS DOUBLE) AS dedup_score FROM reports WHERE report_id % 11 <> 0"""


@query("c2_stage_chain", ["reports"], _DEDUPED)
def _(x: Inputs):
    enriched = C.advance_stage(
        x.reports.drop("is_duplicate").withColumn("text", F.when(F.col("report_id") % 11 == 0, F.lit("  ")).otherwise(F.col("text"))),
        "enriched",
    )
    good, _dead = C.split_contract(enriched, C.stage_checks("deduped"), "weather.enriched.posts", "dedup")
    return C.advance_stage(good, "deduped").select(
        "report_id", "source", "external_id", "text", "city", "stage", "is_duplicate", "duplicate_of", "dedup_score"
    )


_BAD_ENUMS = """SELECT report_id, CASE WHEN report_id % 10 = 3 THEN 'meteor' ELSE coalesce(event_category, 'other') END AS event_category,
  CASE WHEN report_id % 7 = 2 THEN 'catastrophic' ELSE severity END AS severity FROM full_reports"""


@query("c3_enums", ["full_reports"], """SELECT report_id, concat('ValidationError: ', concat_ws('; ',
   CASE WHEN event_category = 'meteor' THEN 'event_category: not an allowed value' END,
   CASE WHEN severity = 'catastrophic' THEN 'severity: not an allowed value' END)) AS error
  FROM bad WHERE event_category = 'meteor' OR severity = 'catastrophic'""", extra={"bad": _BAD_ENUMS})
def _(x: Inputs):
    _good, dead = C.enum_contract(x.sql(["full_reports"], _BAD_ENUMS))
    return dead.select(F.get_json_object("payload", "$.report_id").cast("bigint").alias("report_id"), "error")


_SUBMISSIONS = """SELECT report_id, CASE report_id % 8
   WHEN 0 THEN '  short  ' WHEN 1 THEN concat(text, ' http://a http://b HTTP://c https://d http://e')
   WHEN 2 THEN concat(text, ' <SCRIPT>alert()') WHEN 3 THEN repeat(concat(text, ' '), 100) ELSE concat('  ', text, ' ') END AS text,
  city, state, CASE report_id % 9 WHEN 0 THEN 'north' WHEN 1 THEN '' ELSE '21.5' END AS lat, '77.1' AS lon,
  CASE WHEN report_id % 13 = 5 THEN 'meteor' ELSE event_category END AS event_category FROM reports"""
_REASONS = """concat_ws('; ', CASE WHEN length(trim(text)) < 10 THEN 'text: at least 10 characters' END,
  CASE WHEN length(text) > 4000 THEN 'text: at most 4000 characters' END,
  CASE WHEN len(regexp_extract_all(text, '(?i)https?://')) > 4 THEN 'text: too many links' END,
  CASE WHEN contains(lower(text), '<script') THEN 'text: invalid content' END,
  CASE WHEN lat <> '' AND TRY_CAST(lat AS DOUBLE) IS NULL THEN 'lat: invalid coordinate' END,
  CASE WHEN event_category = 'meteor' THEN 'event_category: not an allowed value' END)"""


@query("b10_submission_checks", ["reports"], f"""SELECT report_id, CASE WHEN {_REASONS} = '' THEN trim(text) END AS accepted_text,
  CASE WHEN {_REASONS} <> '' THEN {_REASONS} END AS reasons FROM sub""", extra={"sub": _SUBMISSIONS})
def _(x: Inputs):
    good, rejected = C.check_submissions(x.sql(["reports"], _SUBMISSIONS))
    return good.select("report_id", F.col("text").alias("accepted_text"), F.lit(None).cast("string").alias("reasons")).unionByName(
        rejected.select("report_id", F.lit(None).cast("string").alias("accepted_text"), "reasons")
    )


# -- merges -----------------------------------------------------------------
_TARGET = "SELECT source, external_id FROM reports WHERE report_id % 3 = 0"
_POSTS = """SELECT report_id, source, external_id, text, observed_at, lat, lon, city AS city_hint,
  CASE WHEN report_id % 2 = 0 THEN state ELSE '' END AS state_hint,
  CASE report_id % 4 WHEN 0 THEN '{"n":1}' WHEN 1 THEN 'not json {' WHEN 2 THEN NULL ELSE '{"a":[1,2],"city_hint":"old"}' END AS raw FROM reports"""
_A3_ORACLE = """SELECT source, external_id, text, observed_at, verification_status, is_duplicate, n_raw, raw_city, raw_state, raw_rest FROM (
 SELECT p.source, p.external_id, p.text, p.observed_at, 'pending' AS verification_status, FALSE AS is_duplicate,
  row_number() OVER (PARTITION BY p.source, p.external_id ORDER BY p.observed_at, p.report_id) AS k,
  CAST((CASE WHEN report_id % 4 = 2 THEN 0 WHEN report_id % 4 = 3 AND city_hint IS NOT NULL THEN 1 WHEN report_id % 4 = 3 THEN 2 ELSE 1 END)
   + (CASE WHEN city_hint IS NULL THEN 0 ELSE 1 END) + (CASE WHEN coalesce(state_hint, '') = '' THEN 0 ELSE 1 END) AS BIGINT) AS n_raw,
  coalesce(city_hint, CASE WHEN report_id % 4 = 3 THEN 'old' END) AS raw_city, nullif(state_hint, '') AS raw_state,
  CASE report_id % 4 WHEN 0 THEN '1' WHEN 1 THEN 'not json {' WHEN 3 THEN '[1,2]' END AS raw_rest
 FROM posts p LEFT JOIN target t ON p.source = t.source AND p.external_id = t.external_id WHERE t.source IS NULL) s WHERE k = 1"""


@query("a3_insert_if_absent", ["reports"], _A3_ORACLE, extra={"target": _TARGET, "posts": _POSTS})
def _(x: Inputs):
    posts = x.sql(["reports"], _POSTS).withColumns(
        {"source_url": F.lit(None).cast("string"), "author": F.lit(None).cast("string"), "hashtags": F.lit(None).cast("array<string>")}
    )
    new = M.insert_if_absent(posts, x.sql(["reports"], _TARGET), ["observed_at", "report_id"])

    def member(path: str):
        return F.get_json_object("raw", f"$.{path}")

    return new.select(
        "source", "external_id", "text", "observed_at", "verification_status", "is_duplicate",
        F.coalesce(F.json_array_length(F.to_json(F.json_object_keys("raw"))), F.lit(0)).cast("bigint").alias("n_raw"),
        member("city_hint").alias("raw_city"), member("state_hint").alias("raw_state"),
        F.coalesce(member("n"), member("_unparsed"), member("a")).alias("raw_rest"),
    )


_OLD_WHERE, _NEW_WHERE = "report_id % 2 = 0", "observed_at >= TIMESTAMP '2024-01-15 00:00:00'"


@query("a4_merge_rollup", ["reports"], f"""SELECT * FROM (
  SELECT n.*, TIMESTAMP '2024-01-30 00:00:00' AS computed_at FROM ({rollup_sql('hour', _NEW_WHERE)}) n UNION ALL
  SELECT o.*, TIMESTAMP '2024-01-01 00:00:00' AS computed_at FROM ({rollup_sql('hour', _OLD_WHERE)}) o
  LEFT JOIN ({rollup_sql('hour', _NEW_WHERE)}) n ON o.bucket_start = n.bucket_start AND o.state = n.state
   AND o.event_category = n.event_category AND o.source = n.source WHERE n.source IS NULL) u""")
def _(x: Inputs):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    old = P.rollup(x.reports.filter(_OLD_WHERE), "hour").withColumn("computed_at", stamp)
    return M.merge_rollup(old, P.rollup(x.reports.filter(_NEW_WHERE), "hour"), AS_OF)


_OBS_BATCH = """SELECT provider, station, observed_at, lat + 1 AS lat, lon + 1 AS lon, temp_c + k AS temp_c, precip_mm, wind_kph + k AS wind_kph, humidity_pct, k
  FROM (SELECT o.*, 1 AS k FROM observations o WHERE temp_c >= 25 UNION ALL SELECT o.*, 2 AS k FROM observations o WHERE temp_c >= 35) u"""


@query("a6_merge_observations", ["observations"], """SELECT o.provider, o.station, o.observed_at, o.lat, o.lon,
   CASE WHEN temp_c >= 35 THEN temp_c + 2 WHEN temp_c >= 25 THEN temp_c + 1 ELSE temp_c END AS temp_c, precip_mm,
   CASE WHEN temp_c >= 35 THEN wind_kph + 2 WHEN temp_c >= 25 THEN wind_kph + 1 ELSE wind_kph END AS wind_kph, humidity_pct
   FROM observations o WHERE wind_kph < 30
  UNION ALL SELECT o.provider, o.station, o.observed_at, o.lat + 1, o.lon + 1, CASE WHEN temp_c >= 35 THEN temp_c + 2 ELSE temp_c + 1 END, precip_mm,
   CASE WHEN temp_c >= 35 THEN wind_kph + 2 ELSE wind_kph + 1 END, humidity_pct FROM observations o WHERE NOT wind_kph < 30 AND temp_c >= 25""")
def _(x: Inputs):
    return M.merge_observations(x.observations.filter("wind_kph < 30"), x.sql(["observations"], _OBS_BATCH), ["k"])


_TABLE = """SELECT r.* FROM full_reports r JOIN (SELECT source, external_id, min(report_id) AS report_id FROM full_reports
  WHERE report_id % 3 <> 1 GROUP BY source, external_id) f ON r.report_id = f.report_id"""
_A5_COLS = ["text", "lang", "city", "state", "event_category", "severity", "confidence", "credibility_score", "is_duplicate", "observed_at"]
_A5_ORACLE = f"""
 SELECT coalesce(t.source, b.source) AS source, coalesce(t.external_id, b.external_id) AS external_id,
  {', '.join(f'CASE WHEN b.source IS NOT NULL THEN b.{c} ELSE t.{c} END AS {c}' for c in _A5_COLS)},
  coalesce(b.url, t.source_url) AS source_url, coalesce(b.writer, t.author) AS author,
  CAST(CASE WHEN t.media_n > 0 THEN t.media_n ELSE coalesce(b.media, t.media_n, 0) END AS BIGINT) AS media_count,
  CASE WHEN t.source IS NULL THEN 'pending' ELSE t.verification_status END AS verification_status,
  CASE WHEN t.source IS NULL THEN {_LATER_SQL} ELSE t.ingested_at END AS ingested_at,
  CASE WHEN b.source IS NOT NULL THEN b.duplicate_of END AS raw_duplicate_of,
  CASE WHEN b.source IS NOT NULL THEN 'text' END AS raw_method
 FROM target t FULL OUTER JOIN (
  SELECT a.*, k.url, k.writer, k.media FROM arrivals a JOIN (
    SELECT source, external_id, max(arrival) AS arrival, arg_max(source_url, arrival) FILTER (WHERE source_url IS NOT NULL) AS url,
     arg_max(author, arrival) FILTER (WHERE author IS NOT NULL) AS writer, arg_min(media_n, arrival) FILTER (WHERE media_n > 0) AS media
    FROM arrivals GROUP BY 1, 2) k ON a.arrival = k.arrival) b ON t.source = b.source AND t.external_id = b.external_id"""


@query("a5_merge_reports", ["arrivals"], _A5_ORACLE, extra={"target": _TABLE})
def _(x: Inputs):
    target = x.with_media(x.sql(["full_reports"], _TABLE))
    merged = M.merge_reports(target, x.with_media(x.derived("arrivals")), "arrival", _LATER)
    return merged.select(
        "source", "external_id", *_A5_COLS, "source_url", "author", F.size("media").cast("bigint").alias("media_count"),
        "verification_status", "ingested_at", F.get_json_object("raw", "$.duplicate_of").alias("raw_duplicate_of"),
        F.get_json_object("raw", "$.geocode_method").alias("raw_method"),
    )


@query("e10_resolve", ["full_reports", "arrivals"], """SELECT a.arrival, a.duplicate_of, t.id AS duplicate_id FROM arrivals a LEFT JOIN target t
  ON a.is_duplicate AND t.source = 'rss' AND a.duplicate_of = concat('rss:', t.external_id)""", extra={"target": _TABLE})
def _(x: Inputs):
    return M.resolve_duplicates(x.derived("arrivals"), x.sql(["full_reports"], _TABLE)).select("arrival", "duplicate_of", "duplicate_id")


# -- citizen queue, seen filter, runs --------------------------------------
@query("b9_citizen_drain", ["full_reports"], """SELECT id AS external_id, text, coalesce(author, 'citizen') AS author, city AS city_hint, state AS state_hint,
  CAST(media_n AS BIGINT) AS media_links, concat('{"n":', id, '}') AS raw, (SELECT count(*) FROM full_reports
    WHERE source = 'citizen' AND raw LIKE '%pending%') - 50 AS still_pending
  FROM full_reports WHERE source = 'citizen' AND raw LIKE '%pending%' ORDER BY ingested_at, id LIMIT 50""")
def _(x: Inputs):
    posts, cleared = feeds.drain_citizen_queue(x.full_reports)
    left = cleared.filter(F.get_json_object("raw", "$.citizen_pending_publish") == "true").agg(F.count(F.lit(1)).alias("n"))
    return posts.select(
        "external_id", "text", "author", "city_hint", "state_hint", F.size("media_urls").cast("bigint").alias("media_links"), "raw",
        left.scalar().alias("still_pending"),
    )


_SEEN = "SELECT DISTINCT source, external_id FROM reports WHERE report_id % 2 = 0"
_REFRESHED = "SELECT source, CASE WHEN source = 'rss' THEN TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '2024-01-25 00:00:00' END AS at FROM (SELECT DISTINCT source FROM reports) d"


@query("b11_seen_filter", ["reports"], """SELECT s.source, s.external_id, min(s.report_id) AS report_id, (SELECT count(*) FROM (
    SELECT source, external_id FROM seen WHERE source <> 'rss' UNION SELECT source, external_id FROM reports) n) AS seen_after
  FROM reports s LEFT JOIN (SELECT * FROM seen WHERE source <> 'rss') k ON s.source = k.source AND s.external_id = k.external_id
  WHERE k.source IS NULL GROUP BY 1, 2""", extra={"seen": _SEEN})
def _(x: Inputs):
    kept, seen, _renewed = feeds.filter_seen(
        x.reports, x.sql(["reports"], _SEEN), x.sql(["reports"], _REFRESHED), AS_OF, ["report_id"]
    )
    return kept.select("source", "external_id", "report_id", seen.agg(F.count(F.lit(1))).scalar().alias("seen_after"))


_SEEN_TTL = dt.timedelta(days=V.SEEN_TTL_DAYS)
_RUNS = """SELECT report_id, source, CAST(report_id % 700 AS VARCHAR(20)) AS external_id, report_id // 7 % 4 AS run FROM reports WHERE source <> 'rss' OR report_id // 7 % 4 <> 1"""


@query("b11_seen_stored", ["reports"], """SELECT source, external_id, arg_min(report_id, struct_pack(run, report_id)) AS report_id, CAST(min(run) AS BIGINT) AS run FROM runs
  GROUP BY source, external_id, CASE WHEN source = 'rss' AND run >= 2 THEN 1 ELSE 0 END""", extra={"runs": _RUNS})
def _(x: Inputs):
    """Four runs, the second compacted; 'rss' misses the second and has lost its keys at the third."""
    store = SeenStore(x.spark, scratch_path(x.spark, "b11"))
    posts = x.sql(["reports"], _RUNS.replace("report_id // 7", "report_id div 7"))
    starts = [AS_OF, AS_OF + 0.9 * _SEEN_TTL, AS_OF + 1.8 * _SEEN_TTL, AS_OF + 2.5 * _SEEN_TTL]
    kept = []
    for run, now in enumerate(starts):
        kept.append(store.publish(posts.filter(F.col("run") == run), run, now, ["report_id"]))
        if run == 1:
            store.compact(run)
    return functools.reduce(DataFrame.unionByName, kept).select("source", "external_id", "report_id", F.col("run").cast("bigint").alias("run"))


@query("b12_runs", ["reports"], """SELECT 'rss' AS source, 'success' AS status, count(*) AS fetched, count(DISTINCT external_id) AS published,
  count(*) - count(DISTINCT external_id) AS duplicates, CAST(0 AS BIGINT) AS errors FROM reports WHERE source = 'rss'""")
def _(x: Inputs):
    posts = x.reports.filter("source = 'rss'")
    run = O.record_run(posts, M.first_per_key(posts, M.KEY, ["report_id"]), "rss", AS_OF, _LATER)
    return run.select("source", "status", "fetched", "published", "duplicates", "errors")


# -- review -----------------------------------------------------------------
_DECISIONS = """SELECT report_id, status, note, reviewer, TIMESTAMP '2024-02-01 00:00:00' AS decided_at, decision_id FROM decisions
 UNION ALL SELECT report_id, 'disputed', 'second look', 'u9', TIMESTAMP '2024-02-01 02:30:00', decision_id + 1000000 FROM decisions WHERE decision_id % 2 = 0
 UNION ALL SELECT report_id, 'verified', NULL, 'u8', TIMESTAMP '2024-02-01 02:40:00', decision_id + 2000000 FROM decisions WHERE decision_id % 4 = 0"""


def _decided(x: Inputs):
    return W.apply_decisions(x.full_reports, x.sql(["decisions"], _DECISIONS))


@query("l1_set_verification", ["full_reports", "decisions"], """SELECT r.report_id, coalesce(d.status, r.verification_status) AS verification_status,
  CASE WHEN d.report_id IS NULL THEN r.verification_note ELSE d.note END AS verification_note, d.reviewer AS verified_by, d.decided_at AS verified_at
  FROM full_reports r LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY decided_at DESC, decision_id DESC) AS k
   FROM dd) q WHERE k = 1) d ON r.report_id = d.report_id""", extra={"dd": _DECISIONS})
def _(x: Inputs):
    after, _audit = _decided(x)
    return after.select("report_id", "verification_status", "verification_note", "verified_by", "verified_at")


_AUDIT = """SELECT d.reviewer AS user_id, concat('verification:', d.status) AS action, CAST(r.report_id AS VARCHAR) AS entity_id,
  coalesce(lag(d.status) OVER w, r.verification_status) AS status_before, d.status AS status_after,
  CASE WHEN lag(d.status) OVER w IS NULL THEN r.verification_note ELSE lag(d.note) OVER w END AS note_before, d.decided_at AS created_at
  FROM dd d JOIN full_reports r ON r.report_id = d.report_id WINDOW w AS (PARTITION BY d.report_id ORDER BY d.decided_at, d.decision_id)"""


def _audit_flat(audit):
    return audit.select(
        "user_id", "action", "entity_id", F.get_json_object("before", "$.verification_status").alias("status_before"),
        F.get_json_object("after", "$.verification_status").alias("status_after"),
        F.get_json_object("before", "$.verification_note").alias("note_before"), "created_at",
    )


@query("l1_audit", ["full_reports", "decisions"], _AUDIT, extra={"dd": _DECISIONS})
def _(x: Inputs):
    return _audit_flat(_decided(x)[1])


@query("l3_audit", ["full_reports", "decisions"], f"""SELECT * FROM ({_AUDIT}) a WHERE action = 'verification:disputed'
  ORDER BY created_at DESC, entity_id LIMIT 100""", extra={"dd": _DECISIONS})
def _(x: Inputs):
    return _audit_flat(W.audit_entries(_decided(x)[1], "verification:disputed", 100))


_BULK = "SELECT doc_id AS position, doc_id * 26 AS report_id FROM labels"


def _bulk(x: Inputs) -> W.Bulk:
    return W.apply_bulk(x.full_reports, x.sql([], _BULK), "disputed", "storm", "u1", _LATER)


@query("l2_bulk", ["reports"], """SELECT count(r.report_id) AS updated, count(*) - count(r.report_id) AS missing, 'disputed' AS status,
   (SELECT string_agg(CAST(report_id AS VARCHAR), ',' ORDER BY position) FROM (SELECT b2.* FROM bulk b2 SEMI JOIN reports r2 ON b2.report_id = r2.report_id
     ORDER BY position LIMIT 50) f) AS entity_id,
   (SELECT count(*) FROM reports WHERE verification_status = 'disputed' OR report_id IN (SELECT report_id FROM bulk)) AS disputed_after
  FROM bulk b LEFT JOIN reports r ON b.report_id = r.report_id""", extra={"bulk": _BULK})
def _(x: Inputs):
    done = _bulk(x)
    return done.result.withColumn("disputed_after", done.reports.filter("verification_status = 'disputed'").agg(F.count(F.lit(1))).scalar())


@query("l2_missing", ["reports"], "SELECT position, CAST(report_id AS VARCHAR) AS id FROM bulk b ANTI JOIN reports r ON b.report_id = r.report_id", extra={"bulk": _BULK})
def _(x: Inputs):
    return _bulk(x).missing


@query("l2_audit", ["reports"], """SELECT 'bulk_verification:disputed' AS action, count(*) AS ids, string_agg(CAST(report_id AS VARCHAR), ',' ORDER BY position) FILTER (n <= 50) AS entity_id
  FROM (SELECT *, row_number() OVER (PARTITION BY position // 1000 ORDER BY position) AS n FROM bulk b SEMI JOIN reports r ON b.report_id = r.report_id) q
  GROUP BY position // 1000""", extra={"bulk": _BULK})
def _(x: Inputs):
    return _bulk(x).audit.select("action", F.size(F.from_json("after", "ids array<string>")["ids"]).cast("bigint").alias("ids"), "entity_id")


@query("l4_runs", ["runs"], "SELECT id, source, status, started_at, finished_at, fetched, published, duplicates, errors, last_error FROM runs WHERE source = 'rss' ORDER BY started_at DESC, id LIMIT 50")
def _(x: Inputs):
    return W.recent_runs(x.derived("runs"), "rss")


@query("l4_last_runs", ["runs"], "SELECT id, source, status, started_at FROM runs ORDER BY started_at DESC, id LIMIT 10")
def _(x: Inputs):
    return W.recent_runs(x.derived("runs"), limit=10).select("id", "source", "status", "started_at")


@query("l5_lag", ["offsets"], """SELECT consumer_group, CAST(sum(greatest(coalesce(end_offset - committed, 0), 0)) AS BIGINT) AS lag,
  CAST(sum(sum(greatest(coalesce(end_offset - committed, 0), 0))) OVER () AS BIGINT) AS total FROM offsets GROUP BY consumer_group""")
def _(x: Inputs):
    offsets = x.derived("offsets")
    ends = offsets.filter("end_offset IS NOT NULL").select("topic", "partition_id", "end_offset")
    return W.consumer_lag(offsets.drop("end_offset"), ends)
