"""Streams, loaders, media, search and language."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from skyledger import fixtures
from skyledger.catalog.core import Inputs, query
from skyledger.catalog.reporting import rollup_sql
from skyledger.operators import language as LG, ops as O, search as S
from skyledger.session import scratch_path
from skyledger.sources import dims, media
from skyledger.streaming import stream as ST
from skyledger.streaming.reportlog import report_log, reports, versions

_NOW = dt.datetime(2024, 2, 1)


def _stream(x: Inputs, name: str) -> DataFrame:
    return fixtures.run_sql(x.spark, x.sf_dir, fixtures.with_sql([name], f"SELECT * FROM {name}"), stream=True)


def _drain(df: DataFrame, batch, path: str, mode: str = "append") -> None:
    ST.run_stream(df, batch, f"{path}-checkpoint", None, mode).awaitTermination()


_POST_KEYS = """FROM messages WHERE json_valid(value) AND report_id % 23 <> 0"""


@query("a1_stream_read", ["messages"], f"""SELECT external_id, text, hashtags FROM (
   SELECT json_extract_string(value, '$.external_id') AS external_id, json_extract_string(value, '$.text') AS text,
    CASE WHEN report_id % 3 = 0 THEN '#IMD,#Rain' END AS hashtags {_POST_KEYS}) p""")
def _(x: Inputs):
    path = scratch_path(x.spark, "a1")
    posts = ST.raw_posts(_stream(x, "messages"))
    _drain(posts, lambda df, i: ST.write_part(df, path, i), path)
    return ST.read_parts(x.spark, path, posts_like(x)).select("external_id", "text", F.array_join("hashtags", ",").alias("hashtags"))


def posts_like(x: Inputs) -> DataFrame:
    return ST.raw_posts(x.derived("messages"))


@query("n1_stream_insert", ["messages"], f"""SELECT source, external_id, 'pending' AS verification_status FROM (
   SELECT DISTINCT json_extract_string(value, '$.source') AS source, json_extract_string(value, '$.external_id') AS external_id {_POST_KEYS}) p""")
def _(x: Inputs):
    path = scratch_path(x.spark, "n1")
    _drain(ST.raw_posts(_stream(x, "messages")), ST.insert_sink(path, ["observed_at", "text"]), path)
    return x.spark.read.option("basePath", path).parquet(path).select("source", "external_id", "verification_status")


@query("n4_state_ttl", ["reports"], "SELECT DISTINCT source, external_id FROM reports")
def _(x: Inputs):
    path = scratch_path(x.spark, "n4")
    posts = _stream(x, "reports").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    fresh = ST.state_ttl(posts.select("source", "external_id", "observed_at"))
    _drain(fresh, lambda df, i: ST.write_part(df, path, i), path)
    return x.spark.read.option("basePath", path).parquet(path).select("source", "external_id")


@query("m4_streaming", ["reports"], rollup_sql("hour"))
def _(x: Inputs):
    path = scratch_path(x.spark, "m4")
    _drain(ST.stream_rollup(_stream(x, "reports"), "hour"), ST.rollup_sink(path), path, "update")
    return ST.latest_rollup(x.spark, path).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query("n3_stages")
def _(x: Inputs):
    root = scratch_path(x.spark, "n3")
    observations = x.observations.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    values = _stream(x, "messages").select("value")
    ST.build_stream(values, root, x.gazetteer, observations, _NOW, None).awaitTermination()
    return reports(ST.Sinks(x.spark, root).reports).select(
        "source", "external_id", "city", "state", "event_category", "severity", "credibility_score", "is_duplicate", "verification_status"
    )


def _planted(x: Inputs) -> str:
    """Root of a stream over the planted posts."""
    root = scratch_path(x.spark, "planted")
    observations = x.observations.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    values = _stream(x, "planted").select("value")
    ST.build_stream(values, root, x.gazetteer, observations, _NOW, None).awaitTermination()
    return root


@query("n2_dead_letters", ["planted"], """SELECT 'weather.raw.posts' AS topic, CASE WHEN event_id % 100 IN (19, 39) THEN 'raw' ELSE 'enrich' END AS stage,
   concat('ValidationError: ', CASE event_id % 100 WHEN 19 THEN 'payload: not a JSON object' WHEN 39 THEN 'text: must not be empty'
    WHEN 9 THEN 'lat: outside -90 to 90' ELSE 'lon: outside -180 to 180' END) AS error,
   CASE WHEN event_id % 100 = 19 THEN value ELSE CAST(event_id AS VARCHAR) END AS post, TIMESTAMP '2024-02-01 00:00:00' AS failed_at
  FROM planted WHERE event_id % 100 IN (9, 19, 29, 39)""")
def _(x: Inputs):
    dead = x.spark.read.parquet(f"{_planted(x)}/dlq")
    named = F.coalesce(F.get_json_object("payload", "$.external_id"), F.col("payload"))
    return dead.select("topic", "stage", "error", named.alias("post"), F.col("failed_at").cast("timestamp_ntz").alias("failed_at"))


@query("l6_counters", ["planted"], """SELECT name, CAST(sum(n) AS BIGINT) AS total FROM (
   SELECT unnest(['raw_in', 'raw_failed', 'enrich_failed', 'dedup_failed', 'dedup_exact', 'dedup_near', 'dedup_unique', 'classify_failed', 'classify_done', 'sink_saved', 'sink_duplicate', 'late']) AS name,
    unnest([1, raw, place, 0, copy, near, good - copy - near, 0, good, good - copy - near, copy + near, 0]) AS n
   FROM (SELECT CAST(event_id % 100 IN (19, 39) AS INT) AS raw, CAST(event_id % 100 IN (9, 29) AS INT) AS place, CAST(event_id % 100 NOT IN (9, 19, 29, 39) AS INT) AS good,
     CAST(event_id % 10 = 6 AND event_id > 0 AS INT) AS copy, CAST(event_id % 10 = 8 AS INT) AS near FROM planted) p) c GROUP BY name""")
def _(x: Inputs):
    return O.pipeline_counters(ST.Sinks(x.spark, _planted(x)).counters.read())


@query("n5_report_log", ["full_reports"], """SELECT source, external_id, arg_max(struct_pack(c := text), k).c AS text, arg_max(struct_pack(c := city), k).c AS city, arg_max(source_url, k) FILTER (coalesce(source_url, '') <> '') AS source_url,
   arg_max(author, k) FILTER (coalesce(author, '') <> '') AS author, coalesce(arg_min(media_n, k) FILTER (media_n > 0), 0) AS media_n,
   CAST(min(k) AS BIGINT) AS inserted_by FROM (SELECT *, report_id // 5 % 4 AS k FROM full_reports) r GROUP BY source, external_id""")
def _(x: Inputs):
    """Four batches, a compaction after the third, a replay of the last."""
    log = report_log(x.spark, scratch_path(x.spark, "n5"))
    none = {"geocode_method": "string", "duplicate_of": "string", "dedup_score": "double", "credibility_features": "string", "plausibility": "string"}
    rows = x.full_reports.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    for batch in (0, 1, 2, 3, 3):
        part = versions(rows.filter(F.expr("report_id div 5 % 4") == batch), batch, _NOW + dt.timedelta(days=batch))
        log.append(part, batch, F.col("last.observed_at"))
        if batch == 2:
            log.compact(2)
    inserted = F.datediff("ingested_at", F.lit(_NOW)).cast("bigint").alias("inserted_by")
    return reports(log).select("source", "external_id", "text", "city", "source_url", "author", F.size("media").alias("media_n"), inserted)


# -- loaders ----------------------------------------------------------------
_PLACES = """SELECT c_custkey, concat(c_name, ',', c_mktsegment, ',', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('D', CAST(c_nationkey AS VARCHAR(9))) END, ',',
  CASE WHEN c_custkey % 10 = 0 THEN 'bad' ELSE CAST(c_custkey % 60 AS VARCHAR(9)) END, ',', CAST(c_custkey % 90 AS VARCHAR(9))) AS line FROM customer"""


@query("a11_dims", None, """SELECT c_name AS city, c_mktsegment AS state, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat('D', CAST(c_nationkey AS VARCHAR)) END AS district,
  CAST(c_custkey % 60 AS DOUBLE) AS lat, CAST(c_custkey % 90 AS DOUBLE) AS lon FROM customer WHERE c_custkey % 10 <> 0""")
def _(x: Inputs):
    path = scratch_path(x.spark, "a11")
    lines = x.sql([], _PLACES).select("c_custkey", "line")
    head = x.spark.createDataFrame([(-1, "city,state,district,lat,lon")], "c_custkey bigint, line string")
    lines.unionByName(head).coalesce(1).sortWithinPartitions("c_custkey").select("line").write.text(path)
    return dims.load_gazetteer(x.spark, path).drop("ord")


@query("a12_media", None, """SELECT 'media' AS bucket, concat('docs/', substring(sha256(text), 1, 16), CASE doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.mp4' END) AS key,
  CASE doc_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' ELSE 'video/mp4' END AS content_type, sha256(text) AS sha256, strlen(text) AS size
  FROM documents WHERE doc_id % 5 < 3 AND strlen(text) > 0""")
def _(x: Inputs):
    ext = F.element_at(F.array(*[F.lit(e) for e in ("JPG", "png", "mp4", "exe", "html")]), (F.col("doc_id") % 5 + 1).cast("int"))
    files = x.table("documents").select(
        F.concat(F.lit("/landing/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("bigint").alias("length"),
    )
    return media.catalogue_media(files, "docs").drop("source_url")


# -- search and language ----------------------------------------------------
@query("i6_ranked")
def _(x: Inputs):
    reports = x.spread(x.reports.filter("NOT is_duplicate"))
    index = S.store_index(reports, scratch_path(x.spark, "i6"))
    return S.search_ranked(None, "flod evacuation Patna", 50, index=index)


_BY_SCRIPT = " ".join(f"WHEN 2 * length(regexp_replace(text, '[^{block}]', '', 'g')) > length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}]', '', 'g')) THEN '{lang}'" for lang, block in reversed(LG.SCRIPTS))


@query("d3_lang", None, f"""SELECT d.doc_id, d.lang, CASE {_BY_SCRIPT} WHEN regexp_matches(text, '\\p{{L}}') THEN b.lang END AS detected
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id""", extra={
    "kept": "SELECT * FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}]+')) AS word FROM documents) s WHERE word <> ''",
    "cut": "SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substring(concat(' ', word, ' '), i, 3))) AS gram FROM (SELECT DISTINCT word FROM kept) v",
    "taught": "SELECT lang, word, count(*) AS n FROM kept WHERE lang IS NOT NULL GROUP BY lang, word",
    "counts": "SELECT lang, gram, sum(n) AS n FROM taught JOIN cut USING (word) GROUP BY lang, gram",
    "rooms": "SELECT lang, CAST(sum(n) + count(*) + 1 AS DOUBLE) AS room FROM counts GROUP BY lang",
    "unseen": "SELECT lang, room, CAST(round(ln(1e0 / room) * 1e6) AS BIGINT) AS none FROM rooms",
    "gains": "SELECT lang, gram, CAST(round((ln((n + 1) / room) - ln(1e0 / room)) * 1e6) AS BIGINT) AS gain FROM counts JOIN unseen USING (lang)",
    "by_word": "SELECT word, u.lang, sum(u.none + coalesce(g.gain, 0)) AS score FROM cut c CROSS JOIN unseen u LEFT JOIN gains g ON g.gram = c.gram AND g.lang = u.lang GROUP BY word, u.lang",
    "best": "SELECT doc_id, max(struct_pack(score, lang)).lang AS lang FROM (SELECT doc_id, w.lang, sum(score) AS score FROM kept k JOIN by_word w USING (word) GROUP BY doc_id, w.lang) s GROUP BY doc_id",
})
def _(x: Inputs):
    docs = x.spread(x.table("documents"))
    profiles = LG.train_profiles(docs)
    return LG.detect_lang(docs, profiles, "doc_id", given=None).select("doc_id", "lang", "detected")
