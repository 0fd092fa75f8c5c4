"""Geocoding, enrichment and feed normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixed_values as V
from skyledger.catalog.core import AS_OF, Inputs, query
from skyledger.fixtures import invented, misspelled
from skyledger.functions import text as X
from skyledger.operators import geocode as G
from skyledger.sources import feeds


def _quoted(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) + ("e0" if isinstance(v, float) else "")


def _values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(_quoted(v) for v in (i, *r)) + ")" for i, r in enumerate(rows))
    return f"SELECT * FROM (VALUES {body}) AS v(ord, {names})"


_NORM = "regexp_replace(lower({0}), '[^a-z0-9ऀ-ॿ]+', '', 'g')"


def _norm(column: str) -> str:
    return _NORM.format(column)


PLACES = ["cities", "alias_rows"]
DIMS = {
    "aliases": f"SELECT min(ord) AS ord, kind, {_norm('alias')} AS key, arg_min(target, ord) AS target FROM alias_rows GROUP BY kind, 3",
    "lookup": f"""SELECT key, min(pos) AS pos, coalesce(arg_max(city, pos) FILTER (WHERE tier = 0), arg_min(city, pos) FILTER (WHERE tier = 1)) AS city FROM (
      SELECT {_norm('city')} AS key, 2 * ord AS pos, city, 0 AS tier FROM cities
      UNION ALL SELECT {_norm('district')}, 2 * ord + 1, city, 0 FROM cities
      UNION ALL SELECT a.key, 1099511627776 + a.ord, c.city, 1 FROM aliases a JOIN cities c ON a.kind = 'city' AND a.target = c.city) u GROUP BY key""",
}


def resolved(source: str, column: str, fuzzy: str = "NULL") -> str:
    """name -> city for the distinct names of a column."""
    return f"""SELECT name, city FROM (SELECT n.name, coalesce(e.city, (SELECT arg_min(l.city, l.pos) FROM lookup l
       WHERE starts_with(n.key, l.key) OR starts_with(l.key, n.key)), {fuzzy}) AS city
      FROM (SELECT DISTINCT {column} AS name, {_norm(column)} AS key FROM {source} WHERE {column} IS NOT NULL AND {column} <> '') n
      LEFT JOIN lookup e ON n.key = e.key WHERE n.key <> '') r WHERE city IS NOT NULL"""


def nearest(source: str, key: str, lat: str, lon: str) -> str:
    return f"""SELECT {key}, city FROM (SELECT s.{key}, c.city, row_number() OVER (PARTITION BY s.{key} ORDER BY
       (c.lat - {lat}) * (c.lat - {lat}) + ((c.lon - {lon}) * 0.85e0) * ((c.lon - {lon}) * 0.85e0), c.ord) AS k
      FROM {source} s JOIN cities c ON (c.lat - {lat}) * (c.lat - {lat}) + ((c.lon - {lon}) * 0.85e0) * ((c.lon - {lon}) * 0.85e0)
       < (75e0 / 111e0) * (75e0 / 111e0)) q WHERE k = 1"""


# -- single lookups ---------------------------------------------------------
_POINTS = "SELECT report_id, lat + (report_id % 3) * 0.4e0 AS lat, lon - (report_id % 4) * 0.3e0 AS lon FROM reports"


@query("d5_nearest_city", ["reports", *PLACES], "SELECT p.report_id, n.city FROM points p LEFT JOIN near n ON p.report_id = n.report_id",
       extra={**DIMS, "points": _POINTS, "near": nearest("points", "report_id", "s.lat", "s.lon")})
def _(x: Inputs):
    df = G.nearest_city(x.sql(["reports"], _POINTS), x.gazetteer, F.col("lat"), F.col("lon"))
    return df.select("report_id", F.col("near.city").alias("city"))


_MISSPELLED = f"CASE n.name WHEN 'Hyderabaad' THEN 'Hyderabad' ELSE (SELECT min(c.city) FROM cities c WHERE {misspelled('c.city')} = n.name) END"
_HINTS = f"""SELECT report_id, CASE report_id % 12 WHEN 0 THEN city WHEN 1 THEN lower(city) WHEN 2 THEN 'Bangalore' WHEN 3 THEN 'Mum'
  WHEN 4 THEN concat(coalesce(city, ''), ' North') WHEN 5 THEN 'Hyderabaad' WHEN 6 THEN concat('Atlantis ', CAST(report_id % 50 AS VARCHAR(9)))
  WHEN 7 THEN 'पटना' WHEN 8 THEN {invented('report_id % 140')} WHEN 9 THEN {misspelled(invented('report_id % 140'))}
  WHEN 10 THEN concat({invented('report_id % 140')}, ' rural') ELSE NULL END AS hint FROM reports"""


@query("d6_city_by_name", ["reports", *PLACES], "SELECT h.report_id, h.hint, r.city FROM hints h LEFT JOIN found r ON h.hint = r.name",
       extra={**DIMS, "hints": _HINTS, "found": resolved("hints", "hint", _MISSPELLED)})
def _(x: Inputs):
    df = G.find_city(x.sql(["reports"], _HINTS), x.gazetteer, "hint")
    return df.select("report_id", "hint", F.col("by_name.city").alias("city"))


_STATES = """SELECT report_id, CASE report_id % 6 WHEN 0 THEN state WHEN 1 THEN upper(state) WHEN 2 THEN 'Orissa' WHEN 3 THEN 'बिहार'
  WHEN 4 THEN 'Nowhere' ELSE concat('nation ', CAST(report_id % 30 AS VARCHAR(9))) END AS name FROM reports"""


@query("d7_state_by_name", ["reports", *PLACES], f"""SELECT n.report_id, n.name, coalesce(
   (SELECT any_value(a.target) FROM aliases a WHERE a.kind = 'state' AND a.key = {_norm('n.name')}),
   (SELECT any_value(c.state) FROM cities c WHERE {_norm('c.state')} = {_norm('n.name')})) AS state_found FROM names n""",
       extra={**DIMS, "names": _STATES})
def _(x: Inputs):
    return G.find_state(x.sql(["reports"], _STATES), x.gazetteer, "name")


_TEXTS = f"""SELECT report_id, lat, lon, state, CASE report_id % 11 WHEN 0 THEN concat('storm in BANGA-LORE ', CAST(report_id AS VARCHAR(20)))
  WHEN 1 THEN 'बिहार में बाढ़' WHEN 2 THEN 'rain over Tamil Nadu coast' WHEN 3 THEN concat('calm day ', CAST(report_id % 30 AS VARCHAR(9)))
  WHEN 4 THEN 'Pune to mumbai road closed' WHEN 5 THEN 'हैदराबाद में बारिश'
  WHEN 6 THEN concat('hail near ', {invented('report_id % 140')}) WHEN 7 THEN concat('snow over NATION_', CAST(report_id % 30 AS VARCHAR(9)))
  WHEN 8 THEN concat('fog, old-', lower({invented('report_id % 140')}), ' and ', {invented('report_id % 130')}) ELSE text END AS text FROM reports"""
_IN_TEXT = """SELECT text, arg_min(city, struct_pack(a := -length(city), b := ord)) AS city FROM (SELECT DISTINCT text, lower(text) AS low FROM texts) t
  JOIN (SELECT *, lower(city) AS name FROM cities WHERE length(city) >= 4) c ON contains(t.low, c.name) GROUP BY text"""
_ALIASED = f"""SELECT text, arg_min(place, struct_pack(a := tier, b := ord)) AS place, arg_min(state, struct_pack(a := tier, b := ord)) AS state,
   min(tier) AS tier FROM (SELECT DISTINCT text, {_norm('text')} AS squeezed FROM texts) t JOIN (
   SELECT 0 AS tier, a.ord, a.key, c.city AS place, c.state FROM aliases a JOIN cities c ON a.kind = 'city' AND a.target = c.city
     WHERE length(a.key) >= CASE WHEN regexp_full_match(a.key, '[a-z0-9]+') THEN 5 ELSE 4 END
   UNION ALL SELECT 1, a.ord, a.key, a.target, a.target FROM aliases a WHERE a.kind = 'state'
     AND length(a.key) >= CASE WHEN regexp_full_match(a.key, '[a-z0-9]+') THEN 5 ELSE 4 END
   UNION ALL SELECT 2, min(ord), regexp_replace(lower(state), '[^a-z0-9]+', '', 'g'), state, state FROM cities WHERE length(state) >= 5 GROUP BY state) n
  ON contains(t.squeezed, n.key) GROUP BY text"""


@query("d8_city_in_text", ["reports", *PLACES], "SELECT t.report_id, f.city FROM texts t LEFT JOIN found f ON t.text = f.text",
       extra={**DIMS, "texts": _TEXTS, "found": _IN_TEXT})
def _(x: Inputs):
    df = G.city_in_text(x.spread(x.sql(["reports"], _TEXTS)), x.gazetteer, F.col("text"))
    return df.select("report_id", F.col("named.city").alias("city"))


@query("d9_alias_in_text", ["reports", *PLACES], "SELECT t.report_id, f.place, f.state FROM texts t LEFT JOIN found f ON t.text = f.text",
       extra={**DIMS, "texts": _TEXTS, "found": _ALIASED})
def _(x: Inputs):
    df = G.alias_in_text(x.spread(x.sql(["reports"], _TEXTS).drop("state")), x.gazetteer, F.col("text"))
    return df.select("report_id", F.col("aliased.city").alias("place"), F.col("aliased.state").alias("state"))


_POSTS = f"""SELECT t.report_id, t.text, CASE WHEN t.report_id % 4 = 1 THEN t.lat + 10 ELSE t.lat END AS lat,
  CASE WHEN t.report_id % 35 = 0 THEN 77.5e0 ELSE t.lon END AS lon, CASE WHEN t.report_id % 2 = 0 THEN h.hint END AS city_hint,
  CASE WHEN t.report_id % 10 = 3 THEN 'Hinted State' END AS state_hint FROM ({_TEXTS}) t JOIN ({_HINTS}) h ON t.report_id = h.report_id"""


@query("d10_geocode", ["reports", *PLACES], """SELECT p.report_id, coalesce(p.lat, c.lat) AS lat, coalesce(p.lon, c.lon) AS lon, c.city, c.district,
   coalesce(c.state, CASE WHEN m = 'text' THEN a_state END, p.state_hint) AS state, m AS geocode_method FROM (
    SELECT p.*, a.state AS a_state, CASE WHEN g.city IS NOT NULL THEN 'gps' WHEN h.city IS NOT NULL THEN 'hint'
      WHEN t.city IS NOT NULL OR a.text IS NOT NULL THEN 'text' ELSE 'none' END AS m,
     CASE WHEN g.city IS NOT NULL THEN g.city WHEN h.city IS NOT NULL THEN h.city WHEN t.city IS NOT NULL THEN t.city
      WHEN a.tier = 0 THEN a.place END AS chosen
    FROM posts p LEFT JOIN near g ON p.report_id = g.report_id LEFT JOIN found h ON p.city_hint = h.name
     LEFT JOIN in_text t ON p.text = t.text LEFT JOIN aliased a ON p.text = a.text) p
  LEFT JOIN cities c ON p.chosen = c.city""",
       extra={**DIMS, "texts": _TEXTS, "posts": _POSTS, "near": nearest("posts", "report_id", "s.lat", "s.lon"),
              "found": resolved("posts", "city_hint", _MISSPELLED), "in_text": _IN_TEXT, "aliased": _ALIASED})
def _(x: Inputs):
    df = G.geocode(x.spread(x.sql(["reports"], _POSTS)), x.gazetteer)
    return df.select("report_id", "lat", "lon", "city", "district", "state", "geocode_method")


# -- enrichment -------------------------------------------------------------
@query("d4_norm_place", ["reports"], f"SELECT report_id, {_norm('text')} AS key FROM reports")
def _(x: Inputs):
    return x.reports.select("report_id", X.norm_place(F.col("text")).alias("key"))


_TAGGED = """SELECT report_id, concat(text, ' <b>##Rain</b> #rain &amp; #बाढ़_2024 a#b#c ', CASE WHEN report_id % 2 = 0 THEN '#Imd#alert' ELSE '' END) AS text,
  CASE report_id % 3 WHEN 0 THEN '#IMD,#Rain,imd' WHEN 1 THEN '#ALERT' ELSE NULL END AS given FROM reports"""
_WORDS = "[concat('#', w) FOR w IN regexp_extract_all(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '#+([\\p{L}\\p{N}_ऀ-ॿ]+)', 1)]"


@query("d1_hashtags", ["reports"], f"SELECT report_id, array_to_string({_WORDS}, ',') AS tags FROM tagged", extra={"tagged": _TAGGED})
def _(x: Inputs):
    tags = X.extract_hashtags(X.clean_html(F.col("text")))
    return x.sql(["reports"], _TAGGED).select("report_id", F.array_join(tags, ",").alias("tags"))


@query("d2_merge_tags", ["reports"], f"""SELECT report_id, string_agg(tag, ',' ORDER BY pos) AS tags FROM (
   SELECT report_id, lower(tag) AS low, min(pos) AS pos, arg_min(tag, pos) AS tag FROM (
     SELECT report_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM (
       SELECT report_id, list_concat(CASE WHEN given IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(given, ',') END, {_WORDS}) AS tags FROM tagged) a) b
   GROUP BY 1, 2) c GROUP BY report_id""", extra={"tagged": _TAGGED})
def _(x: Inputs):
    merged = X.merge_hashtags(F.split("given", ","), X.extract_hashtags(X.clean_html(F.col("text"))))
    return x.sql(["reports"], _TAGGED).select("report_id", F.array_join(merged, ",").alias("tags"))


_LINKED = """SELECT report_id, source, external_id, CAST(report_id % 7 AS INT) AS n FROM reports"""


@query("d11_media_todo", ["full_reports"], """SELECT l.report_id, CAST(least(l.n, 4) AS BIGINT) AS links FROM linked l
   LEFT JOIN (SELECT DISTINCT source, external_id FROM full_reports WHERE media_n > 0 AND report_id % 2 = 0) d
   ON l.source = d.source AND l.external_id = d.external_id WHERE l.n > 0 AND d.source IS NULL""", extra={"linked": _LINKED})
def _(x: Inputs):
    urls = F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.concat(F.lit("https://example.org/"), i.cast("string")))
    posts = x.sql(["reports"], _LINKED).withColumn("media_urls", F.when(F.col("n") > 0, urls).otherwise(F.slice(urls, 1, 0)))
    todo = G.media_todo(posts, x.full_reports.filter("report_id % 2 = 0"))
    return todo.select("report_id", F.size("media_urls").cast("bigint").alias("links"))


def _clean_sql(column: str) -> str:
    t = f"regexp_replace({column}, '(?i)<br\\s*/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)</p>|</div>|</li>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for entity, char in X.COMMON_ENTITIES:
        t = f"replace({t}, {_quoted(entity)}, {_quoted(char)})"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"


@query("b13_clean_html", None, f"SELECT page_id, {_clean_sql('html')} AS text FROM pages")
def _(x: Inputs):
    return x.spread(x.table("pages")).select("page_id", X.clean_html(F.col("html")).alias("text"))


# -- feeds ------------------------------------------------------------------
_HOUR = AS_OF.strftime("%Y%m%d%H")
_SAMPLE_SQL = f"""SELECT row_number() OVER (ORDER BY coalesce(p.ord, 1000000000), c.ord) - 1 AS pos, c.city, c.state, c.lat, c.lon FROM cities c
  LEFT JOIN ({_values([(p,) for p in V.PRIORITY_CITIES], 'city')}) p ON c.city = p.city ORDER BY pos LIMIT 40"""


@query("b5_priority_cities", PLACES, f"""SELECT s.pos, s.city, s.state, count(e.event_id) AS hits FROM sample s LEFT JOIN events e ON e.user_id % 45 = s.pos
   GROUP BY 1, 2, 3""", extra={**DIMS, "sample": _SAMPLE_SQL})
def _(x: Inputs):
    sample = G.priority_cities(x.gazetteer.cities, V.PRIORITY_CITIES)
    hits = x.table("events").groupBy((F.col("user_id") % 45).alias("pos")).agg(F.count(F.lit(1)).alias("hits"))
    return sample.join(hits, "pos", "left").select("pos", "city", "state", F.coalesce("hits", F.lit(0)).alias("hits"))


_WARNINGS = """SELECT report_id, CASE report_id % 6 WHEN 0 THEN city WHEN 1 THEN upper(city) WHEN 2 THEN concat(' ', coalesce(city, 'Delhi'), ' District') WHEN 3 THEN 'Nowhere'
   WHEN 4 THEN ' ' ELSE 'Bombay' END AS "District", CASE report_id % 4 WHEN 0 THEN '2,16' WHEN 1 THEN '0' WHEN 2 THEN '9' ELSE NULL END AS "Day_1",
  CASE report_id % 3 WHEN 0 THEN '17, 4' WHEN 1 THEN '99' ELSE '' END AS "Day_2", '' AS "Day_3", CASE report_id % 5 WHEN 0 THEN '8,6,15' ELSE '0' END AS "Day_4",
  NULL AS "Day_5", CASE WHEN report_id % 2 = 0 THEN '2024-01-31' END AS "Date", CASE WHEN report_id % 8 = 3 THEN NULL ELSE CAST(lat AS VARCHAR(30)) END AS "Latitude",
  CAST(lon AS VARCHAR(30)) AS "Longitude" FROM reports"""
_CODES = _values(V.WARNING_CODES, "code, category, wording")


def _placed(base: str, name: str) -> dict[str, str]:
    """CTEs for name-or-nearest places of a feed."""
    return {
        "found": resolved(base, name),
        "spots": f"""SELECT report_id, coalesce(nullif(TRY_CAST("Latitude" AS DOUBLE), 0), 22e0) AS lat,
            coalesce(nullif(TRY_CAST("Longitude" AS DOUBLE), 0), 79e0) AS lon FROM {base}""",
        "near": nearest("spots", "report_id", "s.lat", "s.lon"),
    }


@query("b1_district_warnings", ["reports", *PLACES], f"""SELECT concat('dw-', replace(lower(g.district), ' ', '-'), '-', day, '-', coalesce(date, '2024-01-30')) AS external_id,
   concat('IMD ', labels, ' for ', g.district, ' district (', replace(day, '_', ' '), ')') AS text, coalesce(c.city, g.district) AS city_hint, c.state AS state_hint,
   c.lat, c.lon, category, concat('#IMD,#IMDAlert,', tags) AS hashtags FROM (
     SELECT w.report_id, trim(w."District") AS district, w."Date" AS date, d.day, string_agg(k.wording, ', ' ORDER BY d.i) AS labels,
      string_agg(concat('#', k.code), ',' ORDER BY d.i) AS tags,
      CASE WHEN count(*) FILTER (WHERE k.category = 'flooding') > 0 THEN 'flooding' ELSE min(k.category) END AS category
     FROM warnings w JOIN (SELECT report_id, day, unnest(string_split(codes, ',')) AS code, unnest(range(len(string_split(codes, ',')))) AS i FROM (
        SELECT report_id, 'Day_1' AS day, "Day_1" AS codes FROM warnings UNION ALL SELECT report_id, 'Day_2', "Day_2" FROM warnings
        UNION ALL SELECT report_id, 'Day_4', "Day_4" FROM warnings) u) d ON w.report_id = d.report_id
     JOIN codes k ON k.code = trim(d.code) WHERE trim(w."District") <> '' GROUP BY 1, 2, 3, 4) g
   LEFT JOIN found f ON g.district = f.name LEFT JOIN near n ON g.report_id = n.report_id
   LEFT JOIN cities c ON c.city = coalesce(f.city, n.city)""",
       extra={**DIMS, "raw_warnings": _WARNINGS, "warnings": 'SELECT * REPLACE (trim("District") AS "District") FROM raw_warnings', "codes": _CODES, **_placed("warnings", '"District"')})
def _(x: Inputs):
    df = x.sql(["reports"], _WARNINGS.replace('"', "`")).withColumn("Day_5", F.lit(None).cast("string"))
    df = df.withColumns({f"Day{i}_Color": F.lit("3") for i in range(1, 6)})
    posts = feeds.normalise_district_warnings(df, x.gazetteer, AS_OF)
    return posts.select(
        "external_id", "text", "city_hint", "state_hint", "lat", "lon", F.get_json_object("raw", "$.category_hint").alias("category"),
        F.array_join("hashtags", ",").alias("hashtags"),
    )


_WX = """SELECT report_id, CASE report_id % 4 WHEN 0 THEN city WHEN 1 THEN concat('Met Office ', CAST(report_id % 20 AS VARCHAR(9))) WHEN 2 THEN '' ELSE 'Madras' END AS "Station",
  CASE WHEN report_id % 17 = 0 THEN 'n/a' ELSE CAST(25 + report_id % 20 AS VARCHAR(9)) END AS "Temperature", CAST((report_id * 7) % 60 AS VARCHAR(9)) AS "Wind Speed",
  CASE WHEN report_id % 6 = 0 THEN '70.25' ELSE NULL END AS "Last 24 hrs Rainfall", CAST((report_id * 3) % 100 AS VARCHAR(9)) AS "Weather Code",
  CAST(lat AS VARCHAR(30)) AS "Latitude", CASE WHEN report_id % 3 = 0 THEN '' ELSE CAST(lon AS VARCHAR(30)) END AS "Longitude" FROM reports"""


def _in(codes) -> str:
    return "(" + ", ".join(map(str, codes)) + ")"


@query("b2_station_weather", ["reports", *PLACES], f"""SELECT concat('cw-', replace(lower(station), ' ', '-'), '-{_HOUR}') AS external_id, category, CASE category
   WHEN 'rainfall' THEN concat('IMD station ', station, ': ', printf('%.1f', rain), ' mm rainfall in last 24 hrs')
   WHEN 'thunderstorm' THEN concat('IMD nowcast: thunderstorm at ', station) WHEN 'heatwave' THEN concat('IMD station ', station, ': ', printf('%.1f', temp), '°C - heat wave')
   WHEN 'dust_storm' THEN concat('IMD nowcast: dust storm conditions at ', station) WHEN 'fog' THEN concat('IMD nowcast: fog at ', station)
   ELSE concat('IMD station ', station, ': wind ', printf('%.0f', wind), ' km/h') END AS text,
   coalesce(TRY_CAST(nullif("Latitude", '') AS DOUBLE), c.lat) AS lat, coalesce(TRY_CAST(nullif("Longitude", '') AS DOUBLE), c.lon) AS lon,
   coalesce(c.city, station) AS city_hint, c.state AS state_hint FROM (
    SELECT *, CASE WHEN rain >= 64.5 THEN 'rainfall' WHEN code IN {_in(V.STATION_THUNDER)} THEN 'thunderstorm' WHEN temp >= 40 THEN 'heatwave'
     WHEN code IN {_in(V.STATION_DUST)} THEN 'dust_storm' WHEN code IN {_in(V.STATION_FOG)} THEN 'fog' WHEN wind >= 40 THEN 'strong_winds' END AS category FROM (
     SELECT *, "Station" AS station, TRY_CAST("Temperature" AS DOUBLE) AS temp, CAST("Wind Speed" AS DOUBLE) AS wind,
      coalesce(CAST("Last 24 hrs Rainfall" AS DOUBLE), 0e0) AS rain, CAST("Weather Code" AS INT) AS code FROM wx WHERE "Station" <> '') a WHERE temp IS NOT NULL) b
   LEFT JOIN found f ON b.station = f.name LEFT JOIN near n ON b.report_id = n.report_id LEFT JOIN cities c ON c.city = coalesce(f.city, n.city)
   WHERE category IS NOT NULL""", extra={**DIMS, "wx": _WX, **_placed("wx", '"Station"')})
def _(x: Inputs):
    posts = feeds.normalise_station_weather(x.sql(["reports"], _WX.replace('"', "`")), x.gazetteer, AS_OF)
    return posts.select(
        "external_id", F.get_json_object("raw", "$.category_hint").alias("category"), "text", "lat", "lon", "city_hint", "state_hint"
    )


# five response batches per fetch, one for each of the first sampled cities
_READ = """SELECT event_id, {i} AS pos, CASE WHEN (event_id + {i}) % 13 = 0 THEN NULL ELSE CAST(28 + (event_id + {i}) % 16 AS VARCHAR(9)) END AS temp,
  CASE WHEN (event_id + {i}) % 19 = 0 THEN 'bad' ELSE concat(CAST((event_id + {i}) % 9 AS VARCHAR(9)), '.25') END AS precip,
  CAST((event_id * 7 + {i}) % 60 AS VARCHAR(9)) AS wind, CAST(event_id % 100 AS VARCHAR(9)) AS humidity, CAST((event_id * 3 + {i}) % 100 AS VARCHAR(9)) AS code FROM events"""
_READINGS = " UNION ALL ".join(_READ.format(i=i) for i in range(5))
_USABLE = """SELECT r.event_id, s.city, s.state, s.lat, s.lon, CAST(temp AS DOUBLE) AS temp, CAST(precip AS DOUBLE) AS precip, CAST(wind AS DOUBLE) AS wind,
   CAST(humidity AS DOUBLE) AS humidity, CAST(code AS INT) AS code FROM readings r JOIN sample s ON r.pos = s.pos WHERE temp IS NOT NULL AND precip <> 'bad'"""


def _fetches(x: Inputs):
    e = F.col("event_id")
    batch = [
        F.struct(
            F.when((e + i) % 13 != 0, (28 + (e + i) % 16).cast("string")).alias("temp"),
            F.when((e + i) % 19 == 0, F.lit("bad")).otherwise(F.concat(((e + i) % 9).cast("string"), F.lit(".25"))).alias("precip"),
            ((e * 7 + i) % 60).cast("string").alias("wind"), (e % 100).cast("string").alias("humidity"),
            ((e * 3 + i) % 100).cast("string").alias("code"),
        )
        for i in range(5)
    ]
    return x.table("events").select("event_id", F.array(*batch).alias("batches"))


@query("b3_threshold_posts", PLACES, f"""SELECT concat('om-', replace(lower(city), ' ', '-'), '-{_HOUR}') AS external_id, lat, lon, city AS city_hint, state AS state_hint, category,
  CASE category WHEN 'rainfall' THEN concat('Heavy rain in ', city, ': ', printf('%.1f', precip), ' mm/h recorded (auto-observation, ', printf('%.0f', humidity), '% RH)')
   WHEN 'thunderstorm' THEN concat('Thunderstorm ongoing over ', city, ' (WMO code ', CAST(code AS VARCHAR), '), wind ', printf('%.0f', wind), ' km/h')
   WHEN 'heatwave' THEN concat('Heatwave conditions in ', city, ': ', printf('%.1f', temp), '°C recorded')
   WHEN 'fog' THEN concat('Dense fog reported over ', city, ' (visibility reduced)') ELSE concat('Strong winds in ', city, ': ', printf('%.0f', wind), ' km/h, dry conditions') END AS text
  FROM (SELECT *, CASE WHEN precip >= 7.5 THEN 'rainfall' WHEN code IN {_in(V.MODEL_THUNDER)} THEN 'thunderstorm' WHEN temp >= 40 THEN 'heatwave'
   WHEN code IN {_in(V.MODEL_FOG)} THEN 'fog' WHEN wind >= 40 AND precip < 1 THEN 'strong_winds' END AS category FROM usable) u WHERE category IS NOT NULL""",
       extra={**DIMS, "sample": _SAMPLE_SQL, "readings": _READINGS, "usable": _USABLE})
def _(x: Inputs):
    sample = G.priority_cities(x.gazetteer.cities, V.PRIORITY_CITIES)
    posts = feeds.normalise_threshold_posts(_fetches(x), sample, AS_OF)
    return posts.select("external_id", "lat", "lon", "city_hint", "state_hint", F.get_json_object("raw", "$.category_hint").alias("category"), "text")


@query("b4_observations", PLACES, """SELECT 'open_meteo' AS provider, city AS station, lat, lon, temp AS temp_c, precip AS precip_mm, wind AS wind_kph, humidity AS humidity_pct,
  concat('{"wmo_code":', code, '}') AS payload FROM usable""", extra={**DIMS, "sample": _SAMPLE_SQL, "readings": _READINGS, "usable": _USABLE})
def _(x: Inputs):
    sample = G.priority_cities(x.gazetteer.cities, V.PRIORITY_CITIES)
    return feeds.normalise_observations(_fetches(x), sample, AS_OF).drop("observed_at")


_TIMELINE = """SELECT report_id, 'https://example.social' AS instance, 'rain' AS tag, concat('[{"id":"', CAST(report_id AS VARCHAR(20)),
  '","content":"<p>', CASE WHEN report_id % 5 = 0 THEN 'Quiet &eacute;vening' ELSE replace(text, '"', '') END, '</p>","created_at":"2024-01-05T10:00:00.000Z","language":"en","url":',
  CASE WHEN report_id % 3 = 0 THEN 'null' ELSE '"https://example.social/x"' END, ',"account":{"acct":"a', CAST(report_id % 9 AS VARCHAR(9)), '"},"tags":[{"name":"',
  CASE WHEN report_id % 10 = 0 THEN 'Monsoon' ELSE '#Sky' END, '"}],"media_attachments":[{"type":"image","url":"https://example.social/i"},{"type":"audio","url":"https://example.social/a"},',
  '{"type":null,"url":null,"preview_url":"https://example.social/p"}]}]') AS payload FROM reports"""


@query("b6_timeline", ["reports"], """SELECT concat('example.social:', CAST(report_id AS VARCHAR)) AS external_id,
   CASE WHEN report_id % 5 = 0 THEN 'Quiet évening' ELSE trim(text) END AS text,
   CASE WHEN report_id % 3 = 0 THEN concat('https://example.social/@a', report_id % 9, '/', report_id) ELSE 'https://example.social/x' END AS source_url,
   concat('a', report_id % 9) AS author, CASE WHEN report_id % 10 = 0 THEN '#Monsoon' ELSE '#Sky' END AS hashtags,
   'https://example.social/i,https://example.social/p' AS media FROM reports
   WHERE report_id % 10 = 0 OR (report_id % 5 <> 0 AND regexp_matches(text, '(?i)rain|flood|storm|cyclone|heat|fog|hail|wind|weather|monsoon|thunder|lightning|waterlog|मौसम|बारिश|बाढ़|तूफान|चक्रवात|ओला|कोहरा'))""")
def _(x: Inputs):
    posts = feeds.normalise_timeline(x.spread(x.sql(["reports"], _TIMELINE)), AS_OF)
    return posts.select(
        "external_id", "text", "source_url", "author", F.array_join("hashtags", ",").alias("hashtags"), F.array_join("media_urls", ",").alias("media")
    )


_LISTINGS = """SELECT report_id, 'weather' AS sub, concat('{"data":{"children":[{"data":{"id":"p', CAST(report_id AS VARCHAR(20)), '","title":"',
  CASE WHEN report_id % 4 = 0 THEN 'Photo of the day' ELSE replace(text, '"', '') END, '","selftext":"', CASE WHEN report_id % 3 = 0 THEN 'Seen near the <b>river</b>' ELSE '' END,
  '","author":"u', CAST(report_id % 9 AS VARCHAR(9)), '","permalink":"/r/weather/', CAST(report_id AS VARCHAR(20)), '","over_18":', CASE WHEN report_id % 8 = 1 THEN 'true' ELSE 'false' END,
  ',"created_utc":', CAST(1704067200 + report_id AS VARCHAR(20)), '.0,"score":5,"num_comments":2}}]}}') AS payload FROM reports"""
_TITLE = "CASE WHEN report_id % 4 = 0 THEN 'Photo of the day' ELSE text END"


@query("b7_forum", ["reports"], f"""SELECT concat('p', CAST(report_id AS VARCHAR)) AS external_id, text, concat('https://www.reddit.com/r/weather/', CAST(report_id AS VARCHAR)) AS source_url,
   concat('u', report_id % 9) AS author, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(report_id) AS observed_at FROM (
   SELECT report_id, concat({_TITLE}, chr(10), CASE WHEN report_id % 3 = 0 THEN 'Seen near the river' ELSE {_TITLE} END) AS text FROM reports WHERE report_id % 8 <> 1) s
   WHERE regexp_matches(text, '(?i){V.FORUM_WORDS}')""")
def _(x: Inputs):
    posts = feeds.normalise_forum(x.spread(x.sql(["reports"], _LISTINGS)))
    return posts.select("external_id", "text", "source_url", "author", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


_ENTRIES = """SELECT report_id, i, CASE WHEN (report_id + i) % 7 = 0 THEN '' ELSE text END AS title, CASE WHEN i % 2 = 0 THEN text ELSE 'More on the &lt;fog&gt; bulletin' END AS summary,
  concat('https://example.org/n/', CAST(report_id AS VARCHAR(20)), '-', CAST(i AS VARCHAR(9))) AS link,
  CASE i % 4 WHEN 0 THEN 'Fri, 05 Jan 2024 10:00:00 GMT' WHEN 1 THEN '05 Jan 2024 15:30:00 +0530' WHEN 2 THEN 'soon' ELSE NULL END AS published,
  CASE WHEN i % 3 = 0 THEN 'Daily' END AS publisher FROM reports"""
_NEWS_CASE = " ".join(
    "WHEN " + " OR ".join(f"contains(hay, {_quoted(w)})" for w in words) + f" THEN '{name}'" for name, words in V.NEWS_WORDS
)


@query("b8_news", ["reports"], f"""SELECT concat('gn-', substring(sha1(link), 1, 24)) AS external_id, concat(title, CASE WHEN body <> title THEN concat(' - ', body) ELSE '' END) AS text,
   coalesce(publisher, 'Google News') AS author, CASE WHEN i % 4 < 2 THEN TIMESTAMP '2024-01-05 10:00:00' ELSE TIMESTAMP '2024-01-30 00:00:00' END AS observed_at, category FROM (
   SELECT *, CASE {_NEWS_CASE} END AS category FROM (SELECT *, lower(concat(title, ' ', body)) AS hay FROM (
     SELECT *, replace(replace(summary, '&lt;', '<'), '&gt;', '>') AS body FROM entries WHERE title <> '') a) b) c WHERE category IS NOT NULL""",
       extra={"entries": " UNION ALL ".join(f"SELECT * FROM ({_ENTRIES.replace('reports', f'(SELECT *, {i} AS i FROM reports) r')}) e{i}" for i in range(15))})
def _(x: Inputs):
    def entry(i):
        text, odd = F.col("text"), F.lit(i % 2 == 1)
        dates = [F.lit("Fri, 05 Jan 2024 10:00:00 GMT"), F.lit("05 Jan 2024 15:30:00 +0530"), F.lit("soon"), F.lit(None).cast("string")]
        return F.struct(
            F.when((F.col("report_id") + i) % 7 == 0, F.lit("")).otherwise(text).alias("title"),
            F.when(odd, F.lit("More on the &lt;fog&gt; bulletin")).otherwise(text).alias("summary"),
            F.concat(F.lit("https://example.org/n/"), F.col("report_id").cast("string"), F.lit(f"-{i}")).alias("link"),
            dates[i % 4].alias("published"), F.lit("Daily" if i % 3 == 0 else None).cast("string").alias("publisher"),
        )

    feed = x.spread(x.reports.select("report_id", "text")).select("report_id", F.lit("rainfall").alias("hint"), F.array(*[entry(i) for i in range(17)]).alias("entries"))
    posts = feeds.normalise_news(feed, AS_OF)
    return posts.select(
        "external_id", "text", "author", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"),
        F.get_json_object("raw", "$.category_hint").alias("category"),
    )
