"""Landed feed payloads to raw posts.

Each normaliser is narrow apart from the place lookups, takes ``as_of`` for the
fetch time, and returns the raw-post columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from skyledger import fixed_values as V
from skyledger.functions.json import empty_object, json_object, without
from skyledger.functions.numbers import fixed
from skyledger.functions.plan import once
from skyledger.functions.text import clean_html, slug, strip
from skyledger.operators.geocode import Gazetteer, find_city, nearest_city

POST = [
    "source", "external_id", "text", "source_url", "author", "observed_at", "hashtags", "lat", "lon", "city_hint",
    "state_hint", "media_urls", "lang", "raw",
]
_NO_TEXTS = "CAST(array() AS array<string>)"


def _post(df: DataFrame, **columns: Column) -> DataFrame:
    """Raw-post columns; what a feed does not have is null or empty."""
    types = {"lat": "double", "lon": "double"}
    out = []
    for name in POST:
        value = columns.get(name)
        if value is None:
            value = F.expr(_NO_TEXTS) if name in ("hashtags", "media_urls") else F.lit(None).cast(types.get(name, "string"))
        out.append(value.alias(name))
    return df.select(*out)


def _at(as_of: dt.datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp")


def _number(col: Column) -> Column:
    """Missing or empty counts as 0; text that is no number is null."""
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit(0.0)).otherwise(col.try_cast("double"))


def _or_default(col: Column, default: float) -> Column:
    value = F.coalesce(col.try_cast("double"), F.lit(0.0))
    return F.when(value == 0, F.lit(default)).otherwise(value)


def _station_place(df: DataFrame, gaz: Gazetteer, name: str, fuzzy: bool) -> DataFrame:
    """``place`` by name, else the city nearest to the row's coordinates."""
    named = find_city(df, gaz, name, "_named", fuzzy)
    open_row = F.col("_named").isNull()
    lat = F.when(open_row, _or_default(F.col("Latitude"), V.DEFAULT_LAT))
    lon = F.when(open_row, _or_default(F.col("Longitude"), V.DEFAULT_LON))
    return nearest_city(named, gaz, lat, lon, "_near").withColumn("place", F.coalesce("_named", "_near"))


def normalise_district_warnings(df: DataFrame, gaz: Gazetteer, as_of: dt.datetime, fuzzy: bool = True) -> DataFrame:
    """Warning rows with columns District, Day_1..Day_5, Day1_Color..Day5_Color,
    Date, Latitude, Longitude; one post per district and warned day."""
    categories = F.create_map(*[F.lit(v) for code, cat, _w in V.WARNING_CODES for v in (code, cat)])
    wording = F.create_map(*[F.lit(v) for code, _c, words in V.WARNING_CODES for v in (code, words)])
    known = [code for code, _c, _w in V.WARNING_CODES]
    days = F.explode(
        F.array(*[F.struct(F.lit(f"Day_{i}").alias("day"), F.col(f"Day_{i}").alias("codes"), F.col(f"Day{i}_Color").alias("color")) for i in range(1, 6)])
    )
    named = df.withColumn("district", strip(F.col("District"))).filter("district <> ''")
    daily = named.select("district", "Date", "Latitude", "Longitude", days.alias("d")).select("*", "d.*").drop("d")
    codes = F.filter(F.transform(F.split("codes", ","), lambda c: F.trim(c)), lambda c: c.isin(known))
    warned = once(daily, matched=codes).filter(F.size("matched") > 0)
    cats = F.transform("matched", lambda c: categories[c])
    warned = warned.withColumns(
        {
            "category": F.when(F.array_contains(cats, "flooding"), F.lit("flooding")).otherwise(F.array_min(cats)),
            "labels": F.array_join(F.transform("matched", lambda c: wording[c]), ", "),
        }
    )
    placed = _station_place(warned, gaz, "district", fuzzy)
    today = F.lit(as_of.strftime("%Y-%m-%d"))
    raw = F.struct(F.col("matched").alias("warning_codes"), F.coalesce("color", F.lit("")).alias("color"), F.col("category").alias("category_hint"))
    return _post(
        placed,
        source=F.lit("imd"),
        external_id=F.concat_ws("-", F.lit("dw"), slug(F.col("district")), "day", F.coalesce("Date", today)),
        text=F.concat(F.lit("IMD "), "labels", F.lit(" for "), "district", F.lit(" district ("), F.replace("day", F.lit("_"), F.lit(" ")), F.lit(")")),
        source_url=F.lit(V.AGENCY_URL),
        author=F.lit("IMD"),
        observed_at=_at(as_of),
        hashtags=F.concat(F.array(F.lit("#IMD"), F.lit("#IMDAlert")), F.transform("matched", lambda c: F.concat(F.lit("#"), c))),
        lat=F.col("place.lat"),
        lon=F.col("place.lon"),
        city_hint=F.coalesce("place.city", "district"),
        state_hint=F.col("place.state"),
        lang=F.lit("en"),
        raw=F.to_json(raw),
    )


def normalise_station_weather(df: DataFrame, gaz: Gazetteer, as_of: dt.datetime, fuzzy: bool = True) -> DataFrame:
    """Station rows (Station, Temperature, Wind Speed, Last 24 hrs Rainfall,
    Weather Code, Latitude, Longitude as text): at most one event per row."""
    read = df.withColumns(
        {
            "station": strip(F.col("Station")), "temp": _number(F.col("Temperature")), "wind": _number(F.col("Wind Speed")),
            "rain": _number(F.col("Last 24 hrs Rainfall")),
            "code": F.when(F.coalesce("Weather Code", F.lit("")) == "", F.lit(0)).otherwise(F.col("Weather Code").try_cast("int")),
        }
    ).filter("station <> '' AND temp IS NOT NULL AND wind IS NOT NULL AND rain IS NOT NULL AND code IS NOT NULL")
    station = F.col("station")
    rules = [
        (F.col("rain") >= V.STATION_RAIN_24H_MM, "rainfall", F.concat(F.lit("IMD station "), station, F.lit(": "), fixed(F.col("rain"), 1), F.lit(" mm rainfall in last 24 hrs"))),
        (F.col("code").isin(V.STATION_THUNDER), "thunderstorm", F.concat(F.lit("IMD nowcast: thunderstorm at "), station)),
        (F.col("temp") >= V.HEAT_C, "heatwave", F.concat(F.lit("IMD station "), station, F.lit(": "), fixed(F.col("temp"), 1), F.lit("°C - heat wave"))),
        (F.col("code").isin(V.STATION_DUST), "dust_storm", F.concat(F.lit("IMD nowcast: dust storm conditions at "), station)),
        (F.col("code").isin(V.STATION_FOG), "fog", F.concat(F.lit("IMD nowcast: fog at "), station)),
        (F.col("wind") >= V.WIND_KPH, "strong_winds", F.concat(F.lit("IMD station "), station, F.lit(": wind "), fixed(F.col("wind"), 0), F.lit(" km/h"))),
    ]
    event = _first_rule(rules)
    hits = read.withColumn("event", event).filter("event IS NOT NULL")
    placed = _station_place(hits, gaz, "station", fuzzy)
    given_lat = F.when(F.coalesce("Latitude", F.lit("")) != "", F.col("Latitude").try_cast("double"))
    given_lon = F.when(F.coalesce("Longitude", F.lit("")) != "", F.col("Longitude").try_cast("double"))
    return _post(
        placed,
        source=F.lit("imd"),
        external_id=F.concat_ws("-", F.lit("cw"), slug(station), F.lit(as_of.strftime("%Y%m%d%H"))),
        text=F.col("event.text"),
        source_url=F.lit(V.AGENCY_URL),
        author=F.lit("IMD"),
        observed_at=_at(as_of),
        hashtags=F.array(F.lit("#IMD"), F.lit("#Weather"), F.concat(F.lit("#"), "event.category")),
        lat=F.coalesce(given_lat, "place.lat"),
        lon=F.coalesce(given_lon, "place.lon"),
        city_hint=F.coalesce("place.city", "station"),
        state_hint=F.col("place.state"),
        lang=F.lit("en"),
        raw=F.to_json(F.struct(F.col("event.category").alias("category_hint"))),
    )


def _first_rule(rules: list[tuple[Column, str, Column]]) -> Column:
    out = None
    for cond, category, text in rules:
        row = F.struct(F.lit(category).alias("category"), text.alias("text"))
        out = F.when(cond, row) if out is None else out.when(cond, row)
    return out


def zip_readings(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Response batches (array ``batches`` of structs with text members temp,
    precip, wind, humidity, code) joined with the sampled cities by position."""
    rows = df.select("*", F.posexplode("batches").alias("pos", "b")).drop("batches")
    read = rows.withColumns(
        {
            "temp": F.col("b.temp").try_cast("double"), "precip": _number(F.col("b.precip")), "wind": _number(F.col("b.wind")),
            "humidity": _number(F.col("b.humidity")),
            "code": F.when(F.coalesce("b.code", F.lit("")) == "", F.lit(0)).otherwise(F.col("b.code").try_cast("int")),
        }
    ).drop("b")
    usable = read.filter("temp IS NOT NULL AND precip IS NOT NULL AND wind IS NOT NULL AND humidity IS NOT NULL AND code IS NOT NULL")
    return usable.join(sample, "pos")


def normalise_threshold_posts(df: DataFrame, sample: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Posts for the sampled cities whose readings pass a threshold."""
    city = F.col("city")
    rules = [
        (F.col("precip") >= V.MODEL_RAIN_MM, "rainfall", F.concat(F.lit("Heavy rain in "), city, F.lit(": "), fixed(F.col("precip"), 1), F.lit(" mm/h recorded (auto-observation, "), fixed(F.col("humidity"), 0), F.lit("% RH)"))),
        (F.col("code").isin(V.MODEL_THUNDER), "thunderstorm", F.concat(F.lit("Thunderstorm ongoing over "), city, F.lit(" (WMO code "), F.col("code").cast("string"), F.lit("), wind "), fixed(F.col("wind"), 0), F.lit(" km/h"))),
        (F.col("temp") >= V.HEAT_C, "heatwave", F.concat(F.lit("Heatwave conditions in "), city, F.lit(": "), fixed(F.col("temp"), 1), F.lit("°C recorded"))),
        (F.col("code").isin(V.MODEL_FOG), "fog", F.concat(F.lit("Dense fog reported over "), city, F.lit(" (visibility reduced)"))),
        ((F.col("wind") >= V.WIND_KPH) & (F.col("precip") < 1.0), "strong_winds", F.concat(F.lit("Strong winds in "), city, F.lit(": "), fixed(F.col("wind"), 0), F.lit(" km/h, dry conditions"))),
    ]
    hits = zip_readings(df, sample).withColumn("event", _first_rule(rules)).filter("event IS NOT NULL")
    current = F.struct("temp", "precip", "wind", "humidity", "code")
    return _post(
        hits,
        source=F.lit("open_meteo"),
        external_id=F.concat_ws("-", F.lit("om"), slug(city), F.lit(as_of.strftime("%Y%m%d%H"))),
        text=F.col("event.text"),
        source_url=F.lit(V.MODEL_URL),
        author=F.lit("open-meteo"),
        observed_at=_at(as_of),
        hashtags=F.array(F.lit("#IMD"), F.lit("#Weather"), F.concat(F.lit("#"), "event.category")),
        lat=F.col("lat"),
        lon=F.col("lon"),
        city_hint=city,
        state_hint=F.col("state"),
        lang=F.lit("en"),
        raw=F.to_json(F.struct(current.alias("current"), F.col("event.category").alias("category_hint"), F.lit("open-meteo").alias("provider"))),
    )


def normalise_observations(df: DataFrame, sample: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Observation rows of all stations with a temperature, event or not."""
    return zip_readings(df, sample).select(
        F.lit("open_meteo").alias("provider"), F.col("city").alias("station"), "lat", "lon", _at(as_of).alias("observed_at"),
        F.col("temp").alias("temp_c"), F.col("precip").alias("precip_mm"), F.col("wind").alias("wind_kph"),
        F.col("humidity").alias("humidity_pct"), F.to_json(F.struct(F.col("code").alias("wmo_code"))).alias("payload"),
    )


STATUSES = (
    "array<struct<id:string,content:string,url:string,created_at:string,language:string,account:struct<acct:string>,"
    "tags:array<struct<name:string>>,reblogs_count:bigint,favourites_count:bigint,"
    "media_attachments:array<struct<type:string,url:string,preview_url:string>>>>"
)


def normalise_timeline(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Timeline fetches (instance, tag, payload = JSON list of statuses)."""
    rows = df.select("instance", "tag", F.explode(F.from_json("payload", STATUSES)).alias("s")).select("instance", "tag", "s.*")
    none = F.expr(_NO_TEXTS)
    read = once(
        rows,
        body=clean_html(F.coalesce("content", F.lit(""))),
        names=F.coalesce(F.transform("tags", lambda t: F.coalesce(t["name"], F.lit(""))), none),
        host=F.regexp_replace("instance", "^.*?//", ""),
    )
    words = f"(?iu){V.TIMELINE_WORDS}"
    about = F.col("body").rlike(words) | F.exists("names", lambda n: n.rlike(words))
    kept = read.filter((F.col("body") != "") & about)

    def link(m: Column) -> Column:
        return F.when(F.coalesce(m["url"], F.lit("")) != "", m["url"]).otherwise(m["preview_url"])

    media = F.filter(
        F.coalesce("media_attachments", F.expr("CAST(array() AS array<struct<type:string,url:string,preview_url:string>>)")),
        lambda m: (F.coalesce(link(m), F.lit("")) != "") & (m["type"].isNull() | m["type"].isin(V.TIMELINE_MEDIA_KINDS)),
    )
    address = F.concat("instance", F.lit("/@"), F.coalesce("account.acct", F.lit("")), F.lit("/"), "id")
    return _post(
        kept,
        source=F.lit("mastodon"),
        external_id=F.concat_ws(":", "host", "id"),
        text=F.col("body"),
        source_url=F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(address),
        author=F.col("account.acct"),
        observed_at=F.coalesce(F.col("created_at").try_cast("timestamp"), _at(as_of)),
        hashtags=F.transform("names", lambda n: F.concat(F.lit("#"), F.regexp_replace(n, "^#+", ""))),
        media_urls=F.transform(media, link),
        lang=F.col("language"),
        raw=F.to_json(F.struct(F.col("host").alias("instance"), "tag", F.col("reblogs_count").alias("reblogs"), F.col("favourites_count").alias("favourites"))),
    )


LISTING = (
    "struct<data:struct<children:array<struct<data:struct<id:string,title:string,selftext:string,author:string,"
    "permalink:string,over_18:boolean,created_utc:double,score:bigint,num_comments:bigint>>>>>"
)


def normalise_forum(df: DataFrame) -> DataFrame:
    """Forum fetches (sub, payload = JSON listing)."""
    children = F.explode(F.from_json("payload", LISTING)["data"]["children"])
    rows = df.select("sub", children.alias("c")).select("sub", "c.data.*")
    title = F.coalesce("title", F.lit(""))
    body = clean_html(F.when(F.coalesce("selftext", F.lit("")) != "", F.col("selftext")).otherwise(title))
    full = strip(F.concat(title, F.lit("\n"), body))
    kept = once(rows, full=full).filter(
        (F.col("full") != "") & F.col("full").rlike(f"(?iu){V.FORUM_WORDS}") & ~F.coalesce("over_18", F.lit(False))
    )
    return _post(
        kept,
        source=F.lit("reddit"),
        external_id=F.col("id"),
        text=F.substring("full", 1, V.POST_MAX_CHARS),
        source_url=F.concat(F.lit("https://www.reddit.com"), F.coalesce("permalink", F.lit(""))),
        author=F.col("author"),
        observed_at=F.timestamp_seconds(F.coalesce("created_utc", F.lit(0.0))),
        hashtags=F.array(F.lit("#reddit"), F.concat(F.lit("#"), "sub"), F.lit("#Weather")),
        lang=F.lit("en"),
        raw=F.to_json(F.struct(F.col("sub").alias("subreddit"), "score", "num_comments")),
    )


def mail_date(text: Column) -> Column:
    """Mail-style date (``Mon, 01 Jan 2024 10:00:00 +0530``); null if malformed."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    shaped = F.when(zoned.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), zoned)
    return F.try_to_timestamp(shaped, F.lit("d MMM yyyy HH:mm:ss Z"))


def normalise_news(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Feed fetches (hint, entries = array of structs title, summary, link,
    published, publisher); the first fifteen entries of each fetch."""
    entries = F.explode(F.slice("entries", 1, V.NEWS_ENTRIES_PER_FEED))
    rows = df.select("hint", entries.alias("e")).select("hint", "e.*")
    read = once(
        rows, head=clean_html(F.coalesce("title", F.lit(""))), body=clean_html(F.coalesce("summary", F.lit("")))
    ).filter("head <> '' AND coalesce(link, '') <> ''")
    read = once(read, hay=F.lower(F.concat_ws(" ", "head", "body")))
    hay = F.col("hay")
    category = None
    for name, words in V.NEWS_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(hay, F.lit(w))
        category = F.when(hit, F.lit(name)) if category is None else category.when(hit, F.lit(name))
    kept = read.withColumn("category", category).filter("category IS NOT NULL")
    more = F.when((F.col("body") != "") & (F.col("body") != F.col("head")), F.concat(F.lit(" - "), "body")).otherwise(F.lit(""))
    publisher = F.coalesce("publisher", F.lit(""))
    return _post(
        kept,
        source=F.lit("rss"),
        external_id=F.concat(F.lit("gn-"), F.substring(F.sha1("link"), 1, 24)),
        text=F.substring(F.concat("head", more), 1, V.POST_MAX_CHARS),
        source_url=F.col("link"),
        author=F.when(publisher != "", publisher).otherwise(F.lit("Google News")),
        observed_at=F.coalesce(mail_date(F.col("published")), _at(as_of)),
        hashtags=F.array(F.lit("#IMD"), F.lit("#Weather"), F.concat(F.lit("#"), "category")),
        lang=F.lit("en"),
        raw=F.to_json(F.struct(F.col("hint").alias("query_hint"), F.col("category").alias("category_hint"), publisher.alias("publisher"))),
    )


PENDING_FLAG = "citizen_pending_publish"


def drain_citizen_queue(reports: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The oldest pending citizen reports as posts, and all reports with the
    flag cleared on exactly those."""
    pending = (F.col("source") == "citizen") & (F.get_json_object("raw", f"$.{PENDING_FLAG}") == "true")
    due = reports.filter(pending).orderBy("ingested_at", "id").limit(n)
    cleaned = F.to_json(without(F.coalesce(json_object(F.col("raw")), empty_object()), PENDING_FLAG))
    links = F.filter(F.transform("media", lambda m: m["source_url"]), lambda u: F.coalesce(u, F.lit("")) != "")
    posts = _post(
        due,
        source=F.lit("citizen"), external_id=F.col("id").cast("string"), text=F.col("text"), source_url=F.col("source_url"),
        author=F.when(F.coalesce("author", F.lit("")) != "", F.col("author")).otherwise(F.lit("citizen")),
        observed_at=F.col("observed_at"), hashtags=F.coalesce("hashtags", F.expr(_NO_TEXTS)), lat=F.col("lat"), lon=F.col("lon"),
        city_hint=F.col("city"), state_hint=F.col("state"), media_urls=F.coalesce(links, F.expr(_NO_TEXTS)), raw=cleaned,
    )
    taken = due.select("id", F.lit(True).alias("_taken"))
    marked = reports.join(taken, "id", "left")
    cleared = marked.withColumn("raw", F.when(F.col("_taken").isNotNull(), cleaned).otherwise(F.col("raw")))
    return posts, cleared.select(*reports.columns)


def filter_seen(
    posts: DataFrame, seen: DataFrame, refreshed: DataFrame, as_of: dt.datetime, arrival: list[str],
    ttl_days: int = V.SEEN_TTL_DAYS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts not published before, and the new ``seen`` and ``refreshed`` tables.

    ``seen``: source, external_id.  ``refreshed``: source, at.  A source's whole
    set lives until no run touched it for the TTL; each run renews it.
    """
    from skyledger.operators.merge import KEY, first_per_key

    now = F.lit(as_of.isoformat(sep=" ")).cast(refreshed.schema["at"].dataType)
    alive = refreshed.filter(F.col("at") > now - F.expr(f"INTERVAL '{ttl_days}' DAY"))
    live = seen.join(alive.select("source"), "source", "left_semi")
    kept = first_per_key(posts, KEY, arrival).join(live, KEY, "left_anti")
    ran = posts.select("source").distinct().withColumn("at", now)
    renewed = alive.join(ran, "source", "left_anti").unionByName(ran)
    return kept, live.unionByName(kept.select(*KEY)), renewed
