"""Key merges: insert-if-absent and upserts as joins.

All of them reduce the incoming batch to one row per key with a combinable
aggregate first, so copies of one key collapse before the shuffle, and then join
the target once on its key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions.json import empty_object, json_object, member, member_or_null, put

KEY = ["source", "external_id"]
UNPARSED_CHARS = 1000


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: list[str], chooser, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = chooser(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, "row.*").select(*df.columns)


def fold_raw(raw: Column, city_hint: Column, state_hint: Column) -> Column:
    """Raw JSON text with the hints folded in; text that is no object is kept
    under ``_unparsed``."""
    parsed = json_object(raw)
    broken = raw.isNotNull() & F.try_parse_json(raw).isNull()
    unparsed = F.create_map(F.lit("_unparsed"), F.substring(raw, 1, UNPARSED_CHARS).cast("variant"))
    base = F.when(broken, unparsed).otherwise(F.coalesce(parsed, empty_object()))
    return F.to_json(put(base, member("city_hint", city_hint), member("state_hint", state_hint)))


def insert_if_absent(batch: DataFrame, target: DataFrame, arrival: list[str]) -> DataFrame:
    """New report rows of a raw batch; rows whose key the target holds are left out."""
    fresh = first_per_key(batch, KEY, arrival).join(target.select(*KEY), KEY, "left_anti")
    return fresh.select(
        *KEY, "text", "source_url", "author", "observed_at",
        F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"),
        "lat", "lon",
        fold_raw(F.col("raw"), F.col("city_hint"), F.col("state_hint")).alias("raw"),
        F.lit("pending").alias("verification_status"),
        F.lit(False).alias("is_duplicate"),
    )


ROLLUP_KEY = ["bucket_start", "state", "event_category", "source"]


def merge_rollup(old: DataFrame, new: DataFrame, computed_at: dt.datetime) -> DataFrame:
    """Rollup table after a run: the last computation of a group wins."""
    stamped = new.withColumn("computed_at", F.lit(computed_at.isoformat(sep=" ")).cast(old.schema["computed_at"].dataType))
    same = [old[c].eqNullSafe(stamped[c]) for c in ROLLUP_KEY]
    return old.join(stamped, same, "left_anti").unionByName(stamped.select(*old.columns))


OBSERVATION_KEY = ["provider", "station", "observed_at"]


def merge_observations(target: DataFrame, batch: DataFrame, arrival: list[str]) -> DataFrame:
    """Observations after a batch: measures and payload replaced, place kept."""
    replaced = [c for c in ("temp_c", "precip_mm", "wind_kph", "humidity_pct", "payload") if c in target.columns]
    latest = last_per_key(batch, OBSERVATION_KEY, arrival).withColumn("_in", F.lit(True))
    t, b = target.withColumn("_old", F.lit(True)).alias("t"), latest.alias("b")
    joined = t.join(b, OBSERVATION_KEY, "full_outer")
    taken = F.col("_in").isNotNull()

    def pick(c: str) -> Column:
        if c in OBSERVATION_KEY:
            return F.col(c)
        new = taken if c in replaced else F.col("_old").isNull()
        return F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return joined.select(*[pick(c) for c in target.columns])


ANALYSIS_COLUMNS = [
    "text", "lang", "hashtags", "lat", "lon", "city", "district", "state", "event_category", "severity", "confidence",
    "credibility_score", "is_duplicate", "observed_at",
]
KEPT_IF_EMPTY = ["source_url", "author"]
REVIEW_COLUMNS = ["verification_status", "verification_note"]


def report_key(source: Column, external_id: Column) -> Column:
    return F.concat(source, F.lit(":"), external_id)


def stable_id(source: Column, external_id: Column) -> Column:
    """An id that a retried task computes again."""
    return F.substring(F.sha2(report_key(source, external_id), 256), 1, 32)


def merge_reports(target: DataFrame, batch: DataFrame, arrival: str, ingested_at: dt.datetime) -> DataFrame:
    """Reports after a classified batch.

    Analysis columns take the last row of the batch; ``source_url`` and
    ``author`` keep the previous value when the new one is empty, ``media`` the
    first non-empty list; review columns and ``ingested_at`` are never touched.
    The three dedup/geocode facts are written into ``raw``.  ``duplicate_of``
    becomes the id of the report that a duplicate points at, null if there is
    none or the row is no duplicate.
    """
    extra = [c for c in ("credibility_features", "plausibility") if c in target.columns and c in batch.columns]
    replaced = ANALYSIS_COLUMNS + extra
    order = F.col(arrival)

    def filled(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", order)

    facts = ["raw", "geocode_method", "duplicate_of", "dedup_score"]
    folded = batch.groupBy(*KEY).agg(
        F.max_by(F.struct(*replaced, *facts), order).alias("last"),
        *[F.max_by(c, filled(c)).alias(c) for c in KEPT_IF_EMPTY],
        F.min_by("media", F.when(F.size("media") > 0, order)).alias("media"),
    )
    facts_raw = put(
        F.coalesce(json_object(F.col("last.raw")), empty_object()),
        *[member_or_null(c, F.col(f"last.{c}")) for c in facts[1:]],
    )
    incoming = folded.select(
        *KEY, *[F.col(f"last.{c}").alias(c) for c in replaced], *KEPT_IF_EMPTY, "media", F.to_json(facts_raw).alias("raw"),
        F.when(F.col("last.is_duplicate"), F.col("last.duplicate_of")).alias("_points_at"), F.lit(True).alias("_in"),
    )
    joined = target.alias("t").join(incoming.alias("b"), KEY, "full_outer")
    taken = F.col("_in").isNotNull()
    stamp = F.lit(ingested_at.isoformat(sep=" ")).cast(target.schema["ingested_at"].dataType)
    is_new = F.col("t.id").isNull()

    def pick(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"b.{c}")
        if c in KEY:
            return F.col(c)
        if c == "id":
            return F.coalesce(old, stable_id(F.col("source"), F.col("external_id"))).alias(c)
        if c in KEPT_IF_EMPTY:
            return F.coalesce(new, old).alias(c)
        if c == "media":
            return F.when(F.size(old) > 0, old).otherwise(F.coalesce(new, old, F.array().cast(target.schema[c].dataType))).alias(c)
        if c in replaced or c == "raw":
            return F.when(taken, new).otherwise(old).alias(c)
        if c == "verification_status":
            return F.when(is_new, F.lit("pending")).otherwise(old).alias(c)
        if c == "ingested_at":
            return F.when(is_new, stamp).otherwise(old).alias(c)
        return old.alias(c)

    # a key of its own for rows that point nowhere, so that they spread
    nowhere = F.concat(F.lit("\u0000"), report_key(F.col("source"), F.col("external_id")))
    merged = joined.select(*[pick(c) for c in target.columns], F.coalesce("_points_at", nowhere).alias("_points_at"), taken.alias("_taken"))
    if "duplicate_of" not in target.columns:
        return merged.drop("_points_at", "_taken")
    ids = merged.select(report_key(F.col("source"), F.col("external_id")).alias("_points_at"), F.col("id").cast(target.schema["duplicate_of"].dataType).alias("_original"))
    resolved = F.when(F.col("_taken"), F.col("_original")).otherwise(F.col("duplicate_of")).alias("duplicate_of")
    return merged.join(ids, "_points_at", "left").select(*[resolved if c == "duplicate_of" else c for c in target.columns])


def resolve_duplicates(df: DataFrame, reports: DataFrame, id_column: str = "id") -> DataFrame:
    """Id of the report a duplicate points at (``source:external_id`` cut at the
    first colon); null when there is none.  The lookup keys are made distinct
    first, so that many copies of one report are looked up once."""
    pointed = F.col("is_duplicate") & F.col("duplicate_of").contains(":")
    src = F.substring_index("duplicate_of", ":", 1)
    ext = F.expr("substring(duplicate_of, instr(duplicate_of, ':') + 1)")
    asked = df.filter(pointed).select("duplicate_of", src.alias("source"), ext.alias("external_id")).distinct()
    found = asked.join(reports.select(*KEY, F.col(id_column).alias("duplicate_id")), KEY).select("duplicate_of", "duplicate_id")
    keyed = F.when(pointed, F.col("duplicate_of"))
    return (
        df.withColumn("_asked", keyed)
        .join(found.withColumnRenamed("duplicate_of", "_asked"), "_asked", "left")
        .drop("_asked")
    )
