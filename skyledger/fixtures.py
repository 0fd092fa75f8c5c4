"""Weather tables derived from the given ``events``/``labels``/``nation`` tables.

Each entry is one portable SELECT that Spark and the SQL check engine both run,
so every row grows with the given tables.  ``with_sql`` puts the ones a query
needs (and what they need) in front of a statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30 00:00:00"

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

_CITIES8 = (
    "(VALUES (0,'Mumbai','Maharashtra',19.0760e0,72.8777e0),(1,'Delhi','Delhi',28.6139e0,77.2090e0),"
    "(2,'Bengaluru','Karnataka',12.9716e0,77.5946e0),(3,'Chennai','Tamil Nadu',13.0827e0,80.2707e0),"
    "(4,'Kolkata','West Bengal',22.5726e0,88.3639e0),(5,'Hyderabad','Telangana',17.3850e0,78.4867e0),"
    "(6,'Ahmedabad','Gujarat',23.0225e0,72.5714e0),(7,'Patna','Bihar',25.5941e0,85.1376e0)) "
    "AS c(k, city, state, lat, lon)"
)

# name -> (names it reads, SELECT text)
DERIVED: dict[str, tuple[list[str], str]] = {}


def invented(key: str) -> str:
    """A place name of five syllables by rule from the digits of a key's hash; each key has its own for all practical sizes."""
    consonants, vowels = (f"translate(md5(CAST({key} AS VARCHAR(20))), '0123456789abcdef', '{letters}')" for letters in ("bdfghjklmnprstvy", "aaaeeeiiiooouuue"))
    letters = [f"substring({vowels if i % 2 == 0 else consonants}, {i}, 1)" for i in range(1, 11)]
    return f"concat(upper({letters[0]}), {', '.join(letters[1:])})"


def misspelled(name: str) -> str:
    """The name with its fifth letter doubled."""
    return f"concat(substring({name}, 1, 5), substring({name}, 5))"


# the gazetteer: the places that the reports name, and one of every customer
DERIVED["cities"] = ([], f"""
SELECT CAST(c.k AS BIGINT) AS ord, c.city, c.state, concat(c.city, ' District') AS district, c.lat, c.lon FROM {_CITIES8}
UNION ALL SELECT c_custkey + 8, name, n_name, concat(name, ' Rural'), 8e0 + CAST((c_custkey * 7919) % 25013 AS DOUBLE) / 1000e0, 69e0 + CAST((c_custkey * 104729) % 27011 AS DOUBLE) / 1000e0
FROM (SELECT c_custkey, c_nationkey, {invented('c_custkey')} AS name FROM customer) t JOIN nation ON n_nationkey = c_nationkey""")

# other names of places and states, as they stand in an alias file
DERIVED["alias_rows"] = ([], f"""
SELECT CAST(a.ord AS BIGINT) AS ord, a.alias, a.kind, a.target FROM (VALUES (0,'Bangalore','city','Bengaluru'),(1,'Bombay','city','Mumbai'),(2,'Madras','city','Chennai'),
  (3,'हैदराबाद','city','Hyderabad'),(4,'पटना','city','Patna'),(5,'बिहार','state','Bihar'),(6,'Orissa','state','Odisha'),(7,' BOMBAY ','city','Chennai')) AS a(ord, alias, kind, target)
UNION ALL SELECT c_custkey + 8, concat('Old ', name), 'city', name FROM (SELECT c_custkey, {invented('c_custkey')} AS name FROM customer WHERE c_custkey % 10 = 3) t""")

DERIVED["reports"] = ([], f"""
SELECT e.event_id AS report_id,
  CASE e.event_type WHEN 'signup' THEN 'citizen' WHEN 'purchase' THEN 'rss' WHEN 'view' THEN 'reddit' WHEN 'click' THEN 'mastodon' ELSE 'imd' END AS source,
  concat('x-', CAST(e.event_id - (CASE WHEN e.event_id % 50 = 49 THEN 5 ELSE 0 END) AS VARCHAR(20))) AS external_id,
  e.ts AS observed_at,
  CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE c.state END AS state,
  CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE c.city END AS city,
  CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE c.lat + CAST((e.event_id * 37) % 161 - 80 AS DOUBLE) / 1000e0 END AS lat,
  CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE c.lon + CAST((e.event_id * 53) % 161 - 80 AS DOUBLE) / 1000e0 END AS lon,
  CASE e.event_id % 9 WHEN 0 THEN 'rainfall' WHEN 1 THEN 'flooding' WHEN 2 THEN 'thunderstorm' WHEN 3 THEN 'heatwave' WHEN 4 THEN 'fog' WHEN 5 THEN 'dust_storm' WHEN 6 THEN 'strong_winds' WHEN 7 THEN 'other' ELSE NULL END AS event_category,
  CASE e.user_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'verified' WHEN 2 THEN 'rejected' ELSE 'disputed' END AS verification_status,
  CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE CAST((e.event_id * 31) % 1000 AS DOUBLE) / 1000e0 END AS credibility_score,
  (e.event_id % 7 = 0) AS is_duplicate,
  CASE e.event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' ELSE NULL END AS lang,
  CASE e.event_id % 4 WHEN 0 THEN '#IMD,#Rain' WHEN 1 THEN '#imd,#Weather' WHEN 2 THEN '#Flood' ELSE NULL END AS hashtags_csv,
  CASE e.event_id % 10
    WHEN 0 THEN concat('Heavy rain lashing ', c.city, ' since morning, ', CAST(40 + e.event_id % 140 AS VARCHAR(9)), ' mm recorded #IMD')
    WHEN 1 THEN concat('Flash floods after river overflow, evacuation underway in ', c.city)
    WHEN 2 THEN concat('Severe thunderstorm with lightning strikes near ', c.city, ' user ', CAST(e.user_id AS VARCHAR(9)))
    WHEN 3 THEN concat('Heatwave continues, temperature hits 44 in ', c.city)
    WHEN 4 THEN concat('Dense fog, low visibility on roads to ', c.city, '!!!')
    WHEN 5 THEN concat('Dust storm warning for ', c.state, ' https://mausam.imd.gov.in/', CAST(e.event_id AS VARCHAR(20)))
    WHEN 6 THEN concat('Gusty winds at 60 kmph uproot trees across ', c.city)
    WHEN 7 THEN concat('You won''t believe this SHOCKING VIDEO of ', c.city, ', please share widely')
    WHEN 8 THEN concat('भारी बारिश ', c.city, ' बाढ़ ', CAST(e.user_id AS VARCHAR(9)))
    ELSE concat('Pleasant evening in ', c.city, ' ', CAST(e.event_id AS VARCHAR(20))) END AS text
FROM events e JOIN {_CITIES8} ON c.k = e.user_id % 8""")

# the wide form with the columns exports, pages and merges need
DERIVED["full_reports"] = (["reports"], """
SELECT r.*, CAST(r.report_id AS VARCHAR(20)) AS id,
  r.observed_at + INTERVAL '90' SECOND AS ingested_at,
  CASE WHEN r.city IS NULL THEN NULL ELSE concat(r.city, ' District') END AS district,
  CASE r.report_id % 5 WHEN 0 THEN 'extreme' WHEN 1 THEN 'severe' WHEN 2 THEN 'moderate' WHEN 3 THEN 'mild' ELSE 'unknown' END AS severity,
  CASE WHEN r.report_id % 19 = 0 THEN NULL ELSE CAST((r.report_id * 17) % 10000 AS DOUBLE) / 10000e0 END AS confidence,
  CASE WHEN r.report_id % 6 = 0 THEN NULL ELSE concat('author-', CAST(r.report_id % 40 AS VARCHAR(9))) END AS author,
  CASE WHEN r.report_id % 4 = 0 THEN NULL ELSE concat('https://example.org/r/', CAST(r.report_id AS VARCHAR(20))) END AS source_url,
  CAST(NULL AS VARCHAR(20)) AS verification_note,
  CAST(r.report_id % 4 AS INT) AS media_n,
  CASE WHEN r.source = 'citizen' AND r.report_id % 3 = 0 THEN concat('{"citizen_pending_publish":true,"n":', CAST(r.report_id AS VARCHAR(20)), '}')
    WHEN r.report_id % 3 = 1 THEN concat('{"n":', CAST(r.report_id AS VARCHAR(20)), '}') ELSE NULL END AS raw
FROM reports r""")

# hourly station observations: one per (station, hour)
DERIVED["observations"] = (["reports"], f"""
SELECT 'obs' AS provider, c.city AS station, max(c.lat) AS lat, max(c.lon) AS lon,
  date_trunc('hour', e.ts) AS observed_at,
  CAST(max(20 + (e.event_id * 7) % 280 / 10e0) AS DOUBLE) AS temp_c,
  CASE WHEN min(e.event_id) % 11 = 0 THEN NULL ELSE CAST(max((e.event_id * 3) % 240) AS DOUBLE) / 10e0 END AS precip_mm,
  CAST(max((e.event_id * 5) % 600) AS DOUBLE) / 10e0 AS wind_kph,
  CAST(max((e.event_id * 11) % 100) AS DOUBLE) AS humidity_pct
FROM events e JOIN {_CITIES8} ON c.k = e.user_id % 8
WHERE e.event_type = 'error'
GROUP BY c.city, date_trunc('hour', e.ts)""")

# classified posts that arrive for keys the report table may already hold
DERIVED["arrivals"] = (["full_reports"], """
SELECT source, concat('x-', CAST(report_id - report_id % 4 AS VARCHAR(20))) AS external_id, report_id AS arrival,
  CASE WHEN report_id % 4 = 3 THEN NULL ELSE source_url END AS source_url, author, text, lang, hashtags_csv, lat, lon, city, district, state,
  event_category, severity, confidence, credibility_score, (report_id % 5 = 0) AS is_duplicate,
  CASE WHEN report_id % 5 = 0 THEN concat('rss:x-', CAST(report_id - 5 AS VARCHAR(20))) ELSE NULL END AS duplicate_of,
  CASE WHEN report_id % 5 = 0 THEN 0.9e0 ELSE NULL END AS dedup_score, 'text' AS geocode_method,
  CAST(report_id % 3 AS INT) AS media_n, observed_at + INTERVAL '60' SECOND AS observed_at, raw
FROM full_reports WHERE report_id % 2 = 1 OR report_id % 9 = 0""")

# landed raw posts as JSON text, some of them broken in known ways
DERIVED["messages"] = (["reports"], """
SELECT report_id, CASE WHEN report_id % 41 = 0 THEN concat('{"source": oops ', CAST(report_id AS VARCHAR(20))) ELSE concat(
  '{"source":', CASE WHEN report_id % 23 = 0 THEN 'null' ELSE concat('"', source, '"') END,
  ',"external_id":"', external_id, '","text":"', CASE WHEN report_id % 29 = 0 THEN '   ' ELSE concat(' ', replace(text, '"', ''), ' ') END,
  '","observed_at":"', CASE WHEN report_id % 37 = 0 THEN 'yesterday' ELSE concat(CAST(date_trunc('second', observed_at) AS VARCHAR(30)), 'Z') END,
  '","lat":', CASE WHEN report_id % 31 = 0 THEN '"abc"' WHEN lat IS NULL THEN 'null' ELSE '21.5' END,
  CASE WHEN report_id % 3 = 0 THEN ',"hashtags":["#IMD","#Rain"]' ELSE '' END,
  CASE WHEN report_id % 7 = 0 THEN ',"city_hint":"Mumbai","raw":{"n":1}' WHEN report_id % 7 = 1 THEN ',"raw":"not json"' ELSE '' END,
  CASE WHEN report_id % 5 = 0 THEN ',"channel":"sms"' ELSE '' END, '}') END AS value FROM reports""")

# landed posts with planted copies (6 repeats 5, 8 has the shingles of 7) and rows that fail the contract (19, 39) or have no place on the globe (9, 29)
DERIVED["planted"] = ([], """
SELECT event_id, CASE WHEN event_id % 100 = 19 THEN concat('{"oops ', CAST(event_id AS VARCHAR(20))) ELSE concat(
  '{"source":"rss","external_id":"', CAST(event_id AS VARCHAR(20)), '","text":"', CASE WHEN event_id % 100 = 39 THEN ' '
    WHEN event_id % 10 = 6 THEN concat('report ', md5(CAST(event_id - 1 AS VARCHAR(20))))
    WHEN event_id % 10 = 7 THEN repeat(substring(md5(CAST(event_id AS VARCHAR(20))), 1, 12), 6)
    WHEN event_id % 10 = 8 THEN repeat(substring(md5(CAST(event_id - 1 AS VARCHAR(20))), 1, 12), 7)
    ELSE concat('report ', md5(CAST(event_id AS VARCHAR(20)))) END,
  '","observed_at":"', CAST(TIMESTAMP '2024-01-01 00:00:00' + event_id * INTERVAL '1' SECOND AS VARCHAR(30)), 'Z"',
  CASE event_id % 100 WHEN 9 THEN ',"lat":1e12,"lon":7' WHEN 29 THEN ',"lat":20,"lon":-180.5' ELSE '' END, '}') END AS value FROM events""")

DERIVED["tokens"] = (["reports"], """
SELECT concat('t', CAST(report_id AS VARCHAR(20))) AS token, report_id FROM reports WHERE source = 'citizen'""")

# review decisions: ids above the report range form the missing list
DERIVED["decisions"] = ([], """
SELECT doc_id * 13 AS report_id, CASE WHEN quality = 1 THEN 'verified' ELSE 'rejected' END AS status,
  CASE WHEN toxic = 1 THEN 'toxic wording' ELSE NULL END AS note, concat('u', CAST(doc_id % 3 AS VARCHAR(9))) AS reviewer,
  doc_id AS decision_id
FROM labels""")

DERIVED["offsets"] = ([], """
SELECT CASE e.event_id % 4 WHEN 0 THEN 'pipeline-enrich' WHEN 1 THEN 'pipeline-dedup' WHEN 2 THEN 'pipeline-classify' ELSE 'pipeline-sink' END AS consumer_group,
  concat('topic-', CAST(e.event_id % 4 AS VARCHAR(9))) AS topic, CAST(e.user_id % 4 AS BIGINT) AS partition_id,
  CAST(max(e.event_id) - min(e.event_id) % 97 AS BIGINT) AS committed,
  CASE WHEN e.user_id % 4 = 3 AND e.event_id % 4 = 2 THEN NULL ELSE CAST(max(e.event_id) + count(*) % 7 - 40 AS BIGINT) END AS end_offset
FROM events e GROUP BY e.event_id % 4, e.user_id % 4""")

DERIVED["runs"] = ([], """
SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'citizen' WHEN 'purchase' THEN 'rss' WHEN 'view' THEN 'reddit' WHEN 'click' THEN 'mastodon' ELSE 'imd' END AS source,
  CASE WHEN event_id % 9 = 0 THEN 'failed' WHEN event_id % 9 = 1 THEN 'partial' ELSE 'success' END AS status,
  ts AS started_at, ts + INTERVAL '5' SECOND AS finished_at,
  CAST(user_id AS BIGINT) AS fetched, CAST(user_id - user_id % 3 AS BIGINT) AS published, CAST(user_id % 3 AS BIGINT) AS duplicates,
  CASE WHEN event_id % 9 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS errors,
  CASE WHEN event_id % 9 = 0 THEN 'timeout' ELSE NULL END AS last_error
FROM events""")


def _needed(names: list[str]) -> list[str]:
    order: list[str] = []
    for name in names:
        for dep in [*_needed(DERIVED[name][0]), name]:
            if dep not in order:
                order.append(dep)
    return order


def with_sql(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Statement with the derived tables (and ``extra`` named SELECTs) in front."""
    parts = [f"{n} AS ({DERIVED[n][1]})" for n in _needed(names)]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str, body: str | None = None) -> DataFrame:
    """The derived table (or ``body`` over it) as a DataFrame."""
    return run_sql(spark, sf_dir, with_sql([name] if name else [], body or f"SELECT * FROM {name}"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    shape = table(spark, sf_dir, name).schema
    return spark.readStream.schema(shape).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, stream: bool = False) -> DataFrame:
    """Run a statement over the given tables through per-folder views."""
    tag = ("stream_" if stream else "") + re.sub(r"\W", "_", sf_dir.strip("/"))
    for name in TABLES:
        reads = re.compile(rf"\b(FROM|JOIN) {name}\b")
        if reads.search(sql):
            view = f"{name}__{tag}"
            (table_stream if stream else table)(spark, sf_dir, name).createOrReplaceTempView(view)
            sql = reads.sub(rf"\1 {view}", sql)
    return spark.sql(sql)
