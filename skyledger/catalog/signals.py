"""Duplicates, classification, credibility, plausibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixed_values as V
from skyledger.catalog.core import Inputs, iso_sql, query
from skyledger.functions import geo, text as X
from skyledger.operators import classify as C, credibility as R, dedup as D, plausibility as P
from skyledger.plans import enrich as E


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


# -- duplicates -------------------------------------------------------------
_NORM = "trim(regexp_replace(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^a-z0-9ऀ-ॿ]+', ' ', 'g'))"
_ALL_TEXTS = "SELECT concat('r', CAST(report_id AS VARCHAR(20))) AS id, text FROM reports UNION ALL SELECT concat('d', CAST(doc_id AS VARCHAR(20))), text FROM documents"
_CHARS = "string_split(norm, '')"
_SHINGLES = f"""(CASE WHEN norm = '' THEN CAST([] AS VARCHAR[]) WHEN length(norm) < 4 THEN [norm]
  ELSE list_distinct([c[i] || c[i+1] || c[i+2] || c[i+3] FOR i IN range(1, len(c) - 2)]) END)"""


@query("e1_norm", ["reports"], f"SELECT id, {_NORM} AS norm FROM texts", extra={"texts": _ALL_TEXTS})
def _(x: Inputs):
    return x.spread(x.sql(["reports"], _ALL_TEXTS)).select("id", X.norm_text(F.col("text")).alias("norm"))


@query("e2_hash", ["reports"], f"SELECT id, sha256({_NORM}) AS digest FROM texts", extra={"texts": _ALL_TEXTS})
def _(x: Inputs):
    return x.spread(x.sql(["reports"], _ALL_TEXTS)).select("id", X.content_hash(X.norm_text(F.col("text"))).alias("digest"))


@query("e3_shingles", ["reports"], f"""SELECT id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS fingerprint FROM (
   SELECT id, {_SHINGLES} AS s FROM (SELECT id, norm, {_CHARS} AS c FROM (SELECT id, {_NORM} AS norm FROM texts) a) b) t""", extra={"texts": _ALL_TEXTS})
def _(x: Inputs):
    df = x.spread(x.sql(["reports"], _ALL_TEXTS)).withColumn("norm", X.norm_text(F.col("text")))
    grams = df.select("id", X.shingles(F.col("norm")).alias("s"))
    return grams.select("id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("fingerprint"))


@query("e4_minhash")
def _(x: Inputs):
    docs = x.spread(x.table("documents")).select("doc_id", X.norm_text(F.col("text")).alias("norm"))
    sig = D.minhash(docs, "doc_id", F.col("norm"))
    return sig.select("doc_id", F.array_join(F.transform("sig", lambda v: v.cast("string")), ",").alias("sig"))


@query("e5_bands")
def _(x: Inputs):
    docs = x.spread(x.table("documents")).select("doc_id", X.norm_text(F.col("text")).alias("norm"))
    return D.lsh_bands(D.minhash(docs, "doc_id", F.col("norm")), "doc_id")


@query("e6_jaccard", None, f"""SELECT a.doc_id, CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0e0 ELSE CAST(len(list_intersect(a.s, b.s)) AS DOUBLE)
   / CAST(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS DOUBLE) END AS jaccard
  FROM sets a JOIN sets b ON b.doc_id = a.doc_id + 1""",
       extra={"sets": f"SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, norm, {_CHARS} AS c FROM (SELECT doc_id, {_NORM} AS norm FROM documents) a) b"})
def _(x: Inputs):
    sets = x.spread(x.table("documents")).select("doc_id", X.norm_text(F.col("text")).alias("norm")).select("doc_id", X.shingles(F.col("norm")).alias("s"))
    after = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("s2"))
    return sets.join(after, "doc_id").select("doc_id", X.jaccard(F.col("s"), F.col("s2")).alias("jaccard"))


_ARRIVED = """SELECT concat('doc:', CAST(doc_id AS VARCHAR(20))) AS key, text, TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 720) * INTERVAL '1' HOUR AS seen_at FROM documents
  UNION ALL SELECT concat(source, ':', external_id), text, observed_at FROM reports
  UNION ALL SELECT concat('lost:', CAST(doc_id AS VARCHAR(20))), text, CAST(NULL AS TIMESTAMP) FROM documents WHERE doc_id % 40 = 0"""
_OWNERS = f"""WITH RECURSIVE posts AS (SELECT key, sha256({_NORM}) AS digest, seen_at FROM arrived WHERE seen_at IS NOT NULL),
  own AS (SELECT digest, min(struct_pack(t := seen_at, k := key)) AS o FROM posts GROUP BY digest
   UNION ALL SELECT p.digest, min(struct_pack(t := p.seen_at, k := p.key)) FROM own w JOIN posts p ON p.digest = w.digest AND p.seen_at >= w.o.t + INTERVAL 7 DAY GROUP BY p.digest)
  SELECT p.key, p.seen_at, CASE WHEN w.o.k <> p.key THEN w.o.k END AS duplicate_of FROM posts p JOIN own w ON p.digest = w.digest
   AND p.seen_at >= w.o.t AND p.seen_at < w.o.t + INTERVAL 7 DAY
  UNION ALL SELECT key, seen_at, NULL FROM arrived WHERE seen_at IS NULL"""


def _exact(x: Inputs):
    posts = x.spread(x.sql(["reports"], _ARRIVED)).select("key", F.col("seen_at").alias("at"), X.content_hash(X.norm_text(F.col("text"))).alias("digest"))
    return D.exact_duplicates(posts).select("key", F.col("at").alias("seen_at"), "duplicate_of")


@query("e7_exact", ["reports"], f"SELECT * FROM ({_OWNERS}) o", extra={"arrived": _ARRIVED})
def _(x: Inputs):
    return _exact(x)


@query("e11_stats", ["reports"], f"SELECT CASE WHEN duplicate_of IS NULL THEN 'unique' ELSE 'exact' END AS dedup_kind, count(*) AS n FROM ({_OWNERS}) o GROUP BY 1",
       extra={"arrived": _ARRIVED})
def _(x: Inputs):
    kind = F.when(F.col("duplicate_of").isNull(), F.lit("unique")).otherwise(F.lit("exact"))
    return D.dedup_stats(_exact(x).withColumn("dedup_kind", kind))


_KIND = "CASE WHEN event_id % 10 = 6 THEN 'exact' WHEN event_id % 10 = 8 THEN 'near' ELSE 'unique' END"


def _planted(x: Inputs):
    """Posts of which some are planted copies, by minute."""
    posts = x.derived("planted").filter("event_id % 100 NOT IN (19, 39)").select("event_id", F.get_json_object("value", "$.text").alias("text"))
    return posts.select(
        F.lit("rss").alias("source"), F.col("event_id").cast("string").alias("external_id"), "text",
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + event_id * INTERVAL '1' MINUTE").alias("observed_at"),
    )


@query("e11_kinds", ["planted"], f"SELECT {_KIND} AS dedup_kind, count(*) AS n FROM planted WHERE event_id % 100 NOT IN (19, 39) GROUP BY 1")
def _(x: Inputs):
    return D.dedup_stats(D.dedup_assign(_planted(x)))


@query("e9_assign_planted", ["planted"], f"""SELECT CAST(event_id AS VARCHAR) AS external_id, kind <> 'unique' AS is_duplicate, CASE WHEN kind <> 'unique' THEN concat('rss:', event_id - 1) END AS duplicate_of,
   CASE WHEN kind <> 'unique' THEN 1e0 END AS dedup_score, kind AS dedup_kind FROM (SELECT *, {_KIND} AS kind FROM planted WHERE event_id % 100 NOT IN (19, 39)) p""")
def _(x: Inputs):
    return D.dedup_assign(_planted(x)).select("external_id", "is_duplicate", "duplicate_of", "dedup_score", "dedup_kind")


@query("e8_near_planted", ["planted"], "SELECT concat('rss:', event_id) AS key, concat('rss:', event_id - 1) AS near_of, 1e0 AS score FROM planted WHERE event_id % 10 = 8")
def _(x: Inputs):
    return D.near_matches(_planted(x))


def _document_posts(x: Inputs):
    docs = x.spread(x.table("documents"))
    return docs.select(
        F.lit("doc").alias("source"), F.col("doc_id").cast("string").alias("external_id"), "text",
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE").alias("observed_at"),
    )


@query("e8_near_pairs")
def _(x: Inputs):
    return D.near_matches(_document_posts(x))


@query("e9_assign")
def _(x: Inputs):
    out = D.dedup_assign(_document_posts(x))
    return out.select("external_id", "is_duplicate", "duplicate_of", "dedup_score", "dedup_kind")


@query("e9_assign_reports")
def _(x: Inputs):
    out = D.dedup_assign(x.spread(x.reports).select("report_id", "source", "external_id", "text", "observed_at"))
    return out.select("report_id", "is_duplicate", "duplicate_of", "dedup_score", "dedup_kind")


# -- classification ---------------------------------------------------------
_SUFFIXES = [
    "", " river embankment has breached", " 43.5 °C and scorching", " घना कोहरा और लू", " waterlogged lanes, relief camps open", " winds of 75 km/h in a squall",
    " sandstorm hazes dusty", " heat stroke WARNING FOR ALL DISTRICTS NOW", " मूसलाधार बारिश से नदी में भारी उफन", " NDRF measured, forwarded many times alert alert alert",
    " monsoon showers!!! what? https://nic.in/x", " cloudburst, downpour then a flood",
]
_CLAIMS = "SELECT r.*, concat(r.text, CASE r.report_id % 12 " + " ".join(
    f"WHEN {i} THEN {_q(s)}" for i, s in enumerate(_SUFFIXES)
) + " END) AS claim FROM reports r"
_GROUPS = C.group_order()
_RULE = {i: f"regexp_matches(claim, {_q('(?i)' + r[4])})" for i, r in enumerate(V.RULES)}
_HIT_COLUMNS = "SELECT *, " + ", ".join(f"{sql} AS r{i}" for i, sql in _RULE.items()) + " FROM claims"
_SCORED = "SELECT *, " + ", ".join(
    "(0e0" + "".join(f" + CASE WHEN r{i} THEN {r[1]}e0 ELSE 0e0 END" for i, r in enumerate(V.RULES) if r[0] == g) + f") AS s_{g}" for g in _GROUPS
) + ", " + ", ".join(
    "greatest(" + ", ".join(f"CASE WHEN r{i} THEN {r[2]} ELSE -1 END" for i, r in enumerate(V.RULES) if r[0] == g) + f") AS t_{g}" for g in _GROUPS
) + " FROM hit"
_RANKED = f"""SELECT *, CASE WHEN top = 0 THEN 'other' {' '.join(f"WHEN s_{g} = top THEN '{g}'" for g in _GROUPS)} END AS winner,
   CASE WHEN top = 0 THEN -1 {' '.join(f"WHEN s_{g} = top THEN t_{g}" for g in _GROUPS)} END AS tier FROM (
   SELECT *, l[1] AS top, l[2] AS second FROM (SELECT *, list_reverse_sort([{', '.join(f's_{g}' for g in _GROUPS)}]) AS l FROM scored) a) b"""
_F = {"claims": _CLAIMS, "hit": _HIT_COLUMNS, "scored": _SCORED, "ranked": _RANKED}
_CONFIDENCE = """(CASE WHEN top = 0 THEN 0.3e0 ELSE CAST(printf('%.3f', least(0.97e0, greatest(0.3e0, CASE WHEN top < 1 THEN least(raw, 0.5e0) ELSE raw END))) AS DOUBLE) END)"""
_RAW = "(0.45e0 + 0.45e0 * (CASE WHEN top <> 0 THEN (top - second) / top ELSE 0e0 END)) + (0.05e0 * least(top, 3e0)) / 3e0"
_SEVERITY = "(CASE WHEN top = 0 THEN 'unknown' WHEN tier >= 2 THEN 'extreme' WHEN tier = 1 OR top >= 2 THEN 'severe' WHEN top >= 1 THEN 'moderate' ELSE 'mild' END)"
_TERMS = "concat_ws(',', " + ", ".join(f"CASE WHEN r{i} THEN {_q(r[3])} END" for i, r in enumerate(V.RULES)) + ")"


def _claims(x: Inputs):
    df = x.sql(["reports"], "SELECT * FROM claims", {"claims": _CLAIMS})
    return x.spread(df.drop("text").withColumnRenamed("claim", "text"))


@query("f1_rule_hits", ["reports"], "SELECT report_id, concat_ws(',', " + ", ".join(f"CASE WHEN r{i} THEN '{i}' END" for i in _RULE) + ") AS hits FROM hit", extra=_F)
def _(x: Inputs):
    hits = F.transform(C.rule_hits(F.col("text"), folded=F.col("folded")), lambda i: i.cast("string"))
    return _claims(x).withColumn("folded", C.fold(F.col("text"))).select("report_id", F.array_join(hits, ",").alias("hits"))


@query("f2_scores", ["reports"], "SELECT report_id, " + ", ".join(f"round(s_{g}, 2) AS {g}" for g in _GROUPS) + ", 0e0 AS other FROM scored", extra=_F)
def _(x: Inputs):
    return C.classify_text(_claims(x)).select("report_id", "rule_scores.*")


@query("f3_winner", ["reports"], "SELECT report_id, winner AS event_category FROM ranked", extra=_F)
def _(x: Inputs):
    return C.classify_text(_claims(x).drop("event_category")).select("report_id", "event_category")


@query("f4_confidence", ["reports"], f"SELECT report_id, {_CONFIDENCE} AS category_confidence FROM (SELECT *, {_RAW} AS raw FROM ranked) q", extra=_F)
def _(x: Inputs):
    return C.classify_text(_claims(x)).select("report_id", "category_confidence")


@query("f5_severity", ["reports"], f"SELECT report_id, {_SEVERITY} AS severity FROM ranked", extra=_F)
def _(x: Inputs):
    return C.classify_text(_claims(x)).select("report_id", "severity")


@query("f6_terms", ["reports"], f"SELECT report_id, {_TERMS} AS terms FROM hit", extra=_F)
def _(x: Inputs):
    return C.classify_text(_claims(x)).select("report_id", F.array_join("matched_terms", ",").alias("terms"))


# -- credibility ------------------------------------------------------------
_WEIGHT = "(CASE source " + " ".join(f"WHEN '{s}' THEN {w}e0" for s, w in V.SOURCE_WEIGHTS.items()) + " ELSE 0.5e0 END)"
_LEX_RAW = "(0e0" + "".join(f" + CASE WHEN contains(lower(claim), {_q(t)}) THEN {w}e0 ELSE 0e0 END" for w, t in V.LEXICON) + ")"
_DELTA = f"(greatest(-0.25e0, least(0.25e0, -{_LEX_RAW})) + 0e0)"
_LEX_TERMS = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(claim), {_q(t)}) THEN {_q(t)} END" for _w, t in V.LEXICON) + ")"
_LETTERS = "length(regexp_replace(claim, '[^\\p{L}]', '', 'g'))"
_CAPS = f"(CASE WHEN {_LETTERS} > 0 THEN CAST(length(regexp_replace(claim, '[^\\p{{Lu}}]', '', 'g')) AS DOUBLE) / CAST({_LETTERS} AS DOUBLE) ELSE 0e0 END)"
_MARKS = "length(regexp_replace(claim, '[^!?]', '', 'g'))"
_OFFICIAL = f"regexp_matches(claim, {_q('(?i)' + V.OFFICIAL_DOMAIN)})"
_FEATURES = f"""SELECT *, {_WEIGHT} AS w, (coalesce(city, '') <> '' OR coalesce(state, '') <> '' OR lat IS NOT NULL) AS placed, {_OFFICIAL} AS official,
  regexp_matches(claim, '(?i)https?://') AS url, length(claim) AS chars, {_CAPS} AS caps, {_MARKS} AS marks, contains(claim, 'alert alert alert') AS repeated, {_DELTA} AS delta FROM claims"""
_SCORE = """CAST(printf('%.3f', greatest(0.05e0, least(0.98e0, 0.15e0 + 0.35e0 * w + CASE WHEN placed THEN 0.12e0 ELSE 0e0 END
  + CASE WHEN official THEN 0.15e0 WHEN url THEN 0.02e0 ELSE 0e0 END + CASE WHEN coalesce(lang, '') <> '' THEN 0.05e0 ELSE 0e0 END
  + CASE WHEN chars BETWEEN 40 AND 2000 THEN 0.05e0 ELSE 0e0 END + delta + CASE WHEN caps > 0.5e0 AND chars > 30 THEN -0.12e0 ELSE 0e0 END
  + CASE WHEN marks >= 3 THEN -0.10e0 ELSE 0e0 END + CASE WHEN repeated THEN -0.08e0 ELSE 0e0 END + CASE WHEN chars < 40 THEN -0.05e0 ELSE 0e0 END))) AS DOUBLE)"""
_G = {"claims": _CLAIMS, "feat": _FEATURES}


@query("g1_source_weight", ["reports"], f"SELECT report_id, source, {_WEIGHT} AS weight FROM reports")
def _(x: Inputs):
    return x.reports.select("report_id", "source", R.source_weight(F.col("source")).alias("weight"))


@query("g2_lexicon", ["reports"], f"SELECT report_id, {_DELTA} AS delta, {_LEX_TERMS} AS terms FROM claims", extra=_G)
def _(x: Inputs):
    hits = R.lexicon_hits(F.col("low"))
    return _claims(x).withColumn("low", F.lower("text")).select("report_id", R.lexicon_delta(hits).alias("delta"), F.array_join(R.lexicon_terms(hits), ",").alias("terms"))


@query("g3_text_features", ["reports"], "SELECT report_id, caps AS caps_ratio, marks AS exclamation_count, repeated AS repeated_token, url AS has_url, official AS official_domain, chars AS text_length FROM feat", extra=_G)
def _(x: Inputs):
    return _claims(x).select("report_id", R.text_features(F.col("text"), F.lower("text")).alias("f")).select("report_id", "f.*")


@query("g4_score", ["reports"], f"SELECT report_id, {_SCORE} AS credibility_score FROM feat", extra=_G)
def _(x: Inputs):
    return R.credibility(_claims(x).drop("credibility_score")).select("report_id", "credibility_score")


@query("g5_explain", ["reports"], f"""SELECT report_id, source, w AS source_weight, placed AS has_location, FALSE AS has_media, url AS has_source_url, official AS official_domain,
  coalesce(lang, '') <> '' AS has_lang, chars AS text_length, CAST(printf('%.3f', caps) AS DOUBLE) AS caps_ratio, marks AS exclamation_count, repeated AS repeated_token,
  {_LEX_TERMS} AS lexicon_hits, CAST(printf('%.3f', delta) AS DOUBLE) + 0e0 AS lexicon_delta FROM feat""", extra=_G)
def _(x: Inputs):
    out = R.credibility(_claims(x).drop("credibility_score")).select("report_id", "credibility_features.*")
    return out.withColumn("lexicon_hits", F.array_join("lexicon_hits", ","))


# -- plausibility -----------------------------------------------------------
_KM = """2 * 6371e0 * asin(sqrt(least(1e0, power(sin(radians(o.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(o.lat)) * power(sin(radians(o.lon - r.lon) / 2), 2))))"""
_RULE_SQL = "(VALUES " + ", ".join(f"('{c}', '{m}', {t}e0, '{o}', '{e}')" for c, m, t, o, e in V.PLAUSIBILITY_RULES) + ") AS k(event_category, metric, threshold, operator, expectation)"
_PAIRS = f"""SELECT r.report_id, o.provider, o.station, o.observed_at AS obs_at, o.temp_c, o.precip_mm, o.wind_kph, {_KM} AS km FROM reports r
  JOIN observations o ON o.observed_at BETWEEN r.observed_at - INTERVAL 4 HOUR AND r.observed_at + INTERVAL 4 HOUR WHERE r.lat IS NOT NULL AND r.lon IS NOT NULL"""
_NEAREST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY km, obs_at, provider, station) AS n FROM pairs WHERE km < 101) q WHERE n = 1"
_H = {"pairs": _PAIRS, "best": _NEAREST}
_VERDICT = f"""SELECT r.report_id, (k.metric IS NOT NULL AND r.lat IS NOT NULL AND b.report_id IS NOT NULL AND v.value IS NOT NULL) AS checked,
   CASE WHEN k.metric IS NULL THEN 'no_reference_rule' WHEN r.lat IS NULL THEN 'no_location' WHEN b.report_id IS NULL THEN 'no_reference_observation' WHEN v.value IS NULL THEN 'metric_missing' END AS reason,
   CASE WHEN k.metric IS NOT NULL AND b.report_id IS NOT NULL THEN k.metric END AS metric, CAST(printf('%.2f', v.value) AS DOUBLE) AS observed,
   CASE WHEN v.value IS NOT NULL THEN k.threshold END AS threshold, v.value >= k.threshold AS agrees, CASE WHEN v.value IS NOT NULL THEN b.station END AS station,
   CASE WHEN v.value IS NOT NULL THEN {iso_sql('b.obs_at')} END AS reference_at, CASE WHEN v.value IS NOT NULL THEN CAST(printf('%.1f', b.km) AS DOUBLE) END AS distance_km
  FROM reports r LEFT JOIN {_RULE_SQL} ON r.event_category = k.event_category LEFT JOIN best b ON r.report_id = b.report_id
  LEFT JOIN (SELECT b2.report_id, CASE k2.metric WHEN 'precip_mm' THEN b2.precip_mm WHEN 'temp_c' THEN b2.temp_c ELSE b2.wind_kph END AS value
    FROM best b2 JOIN reports r2 ON b2.report_id = r2.report_id JOIN {_RULE_SQL.replace(' k(', ' k2(')} ON r2.event_category = k2.event_category) v ON r.report_id = v.report_id"""


@query("h1_rules", ["reports"], f"SELECT r.report_id, k.metric, k.threshold, k.operator, k.expectation FROM reports r JOIN {_RULE_SQL} ON r.event_category = k.event_category")
def _(x: Inputs):
    return x.reports.join(P.plausibility_rules(x.spark), "event_category").select("report_id", "metric", "threshold", "operator", "expectation")


@query("h2_haversine", ["reports"], "SELECT r.report_id, round(" + _KM.replace("o.lat", "28.6139e0").replace("o.lon", "77.209e0") + ", 6) AS km FROM reports r WHERE r.lat IS NOT NULL")
def _(x: Inputs):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(28.6139), F.lit(77.209))
    return x.reports.filter("lat IS NOT NULL").select("report_id", F.round(km, 6).alias("km"))


def _probes(x: Inputs):
    return x.reports.filter("lat IS NOT NULL AND lon IS NOT NULL")


@query("h3_interval_join", ["reports", "observations"], "SELECT report_id, station, obs_at, round(km, 6) AS km FROM pairs WHERE km < 101", extra=_H)
def _(x: Inputs):
    pairs = P.interval_candidates(_probes(x).select("report_id", *P.PROBE), x.observations)
    return pairs.select("report_id", "station", "obs_at", F.round("km", 6).alias("km"))


@query("h3_oldest", ["reports", "observations"], """SELECT report_id, station, obs_at, round(km, 6) AS km FROM (
   SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY obs_at, provider, station) AS n FROM pairs) q WHERE n <= 5 AND km < 101""", extra=_H)
def _(x: Inputs):
    pairs = P.interval_candidates(_probes(x).select("report_id", *P.PROBE), x.observations, limit=5)
    return pairs.select("report_id", "station", "obs_at", F.round("km", 6).alias("km"))


@query("h4_nearest", ["reports", "observations"], "SELECT report_id, station, obs_at, round(km, 6) AS km FROM best", extra=_H)
def _(x: Inputs):
    probes = _probes(x)
    best = P.nearest_observation(P.interval_candidates(probes.select(*P.PROBE).distinct(), x.observations))
    return probes.join(best, P.PROBE).select("report_id", "best.station", "best.obs_at", F.round("best.km", 6).alias("km"))


@query("h5_verdict", ["reports", "observations"], _VERDICT, extra=_H)
def _(x: Inputs):
    out = P.plausibility(x.reports, x.observations).select("report_id", "plausibility.*")
    return out.select("report_id", "checked", "reason", "metric", "observed", "threshold", "agrees", "station", "reference_at", "distance_km")


# rows of a category, hundredth of a degree and half hour take the place and time of the earliest of them
_SHARED = """SELECT r.report_id, r.event_category, coalesce(g.o.t, r.observed_at) AS observed_at, coalesce(g.o.lat, r.lat) AS lat, coalesce(g.o.lon, r.lon) AS lon
  FROM reports r LEFT JOIN (SELECT event_category, round(lat, 2) AS a, round(lon, 2) AS b, epoch(observed_at) // 1800 AS h,
    min(struct_pack(t := observed_at, lat := lat, lon := lon)) AS o FROM reports WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2, 3, 4) g
  ON g.event_category = r.event_category AND g.a = round(r.lat, 2) AND g.b = round(r.lon, 2) AND g.h = epoch(r.observed_at) // 1800"""


@query("h6_reuse", ["reports", "observations"], f"""SELECT report_id, checked, reason, station, distance_km FROM ({_VERDICT.replace("FROM reports r", "FROM shared r").replace("JOIN reports r2", "JOIN shared r2")}) v""",
       extra={"shared": _SHARED, "pairs": _PAIRS.replace("FROM reports r", "FROM shared r"), "best": _NEAREST})
def _(x: Inputs):
    out = P.plausibility(x.reports, x.observations, reuse=True).select("report_id", "plausibility.*")
    return out.select("report_id", "checked", "reason", "station", "distance_km")


# classification, credibility and plausibility of a post together
@query("f7_classified", ["reports", "observations"], f"""SELECT c.report_id, c.winner AS event_category, c.category_confidence, c.severity, c.terms, g.credibility_score, v.checked, v.reason, v.agrees
  FROM (SELECT *, {_CONFIDENCE} AS category_confidence, {_SEVERITY} AS severity, {_TERMS} AS terms FROM (SELECT *, {_RAW} AS raw FROM ranked) q) c
  JOIN (SELECT report_id, {_SCORE} AS credibility_score FROM feat) g ON c.report_id = g.report_id JOIN verdicts v ON v.report_id = c.report_id""",
       extra={**_F, **_G, **_H, "classed": "SELECT report_id, observed_at, lat, lon, winner AS event_category FROM ranked",
              "verdicts": _VERDICT.replace("FROM reports r", "FROM classed r").replace("JOIN reports r2", "JOIN classed r2")})
def _(x: Inputs):
    posts = _claims(x).drop("event_category", "credibility_score")
    out = E.classify(posts, x.observations)
    return out.select(
        "report_id", "event_category", "category_confidence", "severity", F.array_join("credibility_features.matched_terms", ",").alias("terms"),
        "credibility_score", "plausibility.checked", "plausibility.reason", "plausibility.agrees",
    )
