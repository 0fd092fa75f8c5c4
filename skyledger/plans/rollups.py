"""Hourly and daily rollups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.functions.times import ts_literal
from skyledger.streaming.daylog import DayLog

DIMS = ["bucket_start", "state", "event_category", "source"]
MEASURES = ["report_count", "verified_count", "duplicate_count", "avg_credibility"]
WINDOW_COLUMNS = [
    "state", "event_category", "source", "verification_status", "is_duplicate", "credibility_score", "observed_at",
]


def read_window(spark: SparkSession, path: str, as_of: dt.datetime, hours: int = 48) -> DataFrame:
    """The seven rollup columns of the trailing window, pruned in the scan."""
    return trailing_window(spark.read.parquet(path), as_of, hours)


def trailing_window(df: DataFrame, as_of: dt.datetime, hours: int = 48, align: str | None = None) -> DataFrame:
    """Rows with ``observed_at >= as_of - hours``.

    ``align`` moves the cutoff down to a bucket start, so that the oldest bucket
    of a rollup is whole and not a partial count.
    """
    cutoff = as_of - dt.timedelta(hours=hours)
    if align == "hour":
        cutoff = cutoff.replace(minute=0, second=0, microsecond=0)
    elif align == "day":
        cutoff = cutoff.replace(hour=0, minute=0, second=0, microsecond=0)
    ntz = df.schema["observed_at"].dataType.typeName() == "timestamp_ntz"
    low = ts_literal(cutoff) if ntz else F.lit(cutoff.replace(tzinfo=dt.timezone.utc))
    return df.select(*WINDOW_COLUMNS).filter(F.col("observed_at") >= low)


def dimensions(df: DataFrame, bucket: str) -> list:
    return [
        F.date_trunc(bucket, "observed_at").cast(df.schema["observed_at"].dataType).alias("bucket_start"),
        F.coalesce("state", F.lit("Unknown")).alias("state"),
        F.coalesce("event_category", F.lit("other")).alias("event_category"),
        F.col("source"),
    ]


def sums(df: DataFrame, bucket: str) -> DataFrame:
    """Additive form: score sum in thousandths and its count, so that coarser
    buckets and streams can be built from finer ones."""
    return df.groupBy(*dimensions(df, bucket)).agg(
        F.count(F.lit(1)).alias("report_count"),
        F.count_if(F.col("verification_status") == "verified").alias("verified_count"),
        F.count_if(F.col("is_duplicate")).alias("duplicate_count"),
        F.sum(F.round(F.col("credibility_score") * 1000).cast("bigint")).alias("score_sum"),
        F.count("credibility_score").alias("score_count"),
    )


def finish(added: DataFrame) -> DataFrame:
    mean = F.col("score_sum").cast("double") / (F.col("score_count") * 1000).cast("double")
    return added.withColumn("avg_credibility", F.when(F.col("score_count") > 0, mean)).select(*DIMS, *MEASURES)


def rollup(df: DataFrame, bucket: str = "hour") -> DataFrame:
    return finish(sums(df, bucket))


def coarsen(hourly_sums: DataFrame, bucket: str = "day") -> DataFrame:
    """Day sums from hour sums: far fewer rows than the reports."""
    start = F.date_trunc(bucket, "bucket_start").cast(hourly_sums.schema["bucket_start"].dataType).alias("bucket_start")
    added = ["report_count", "verified_count", "duplicate_count", "score_sum", "score_count"]
    return hourly_sums.groupBy(start, "state", "event_category", "source").agg(*[F.sum(c).alias(c) for c in added])


def run_rollups(df: DataFrame, as_of: dt.datetime, hours: int = 48, mode: str = "all") -> dict[str, DataFrame]:
    """Rollups of the trailing window by name."""
    if mode not in ("hourly", "daily", "all"):
        raise ValueError("mode must be hourly, daily or all")
    out = {}
    if mode in ("hourly", "all"):
        out["hourly"] = rollup(trailing_window(df, as_of, hours, "hour"), "hour")
    if mode in ("daily", "all"):
        out["daily"] = finish(coarsen(sums(trailing_window(df, as_of, hours, "day"), "hour"), "day"))
    return out


_STORED = "bucket_start {}, state string, event_category string, source string, report_count bigint, verified_count bigint, duplicate_count bigint, avg_credibility double, computed_at timestamp"


def _last_computed(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in DIMS]
    best = F.max_by(F.struct(*rest), "computed_at").alias("r")
    return rows.groupBy(*DIMS).agg(best).select(*DIMS, "r.*").select(*rows.columns)


def _log(spark: SparkSession, path: str, name: str, kind: str) -> DayLog:
    return DayLog(spark, f"{path}/{name}", _STORED.format(kind), _last_computed)


def rollup_job(
    spark: SparkSession, reports_path: str, path: str, run: int, as_of: dt.datetime, computed_at: dt.datetime, hours: int = 48, mode: str = "all",
) -> None:
    """One run from files to files: read the trailing window of the report table, aggregate, store under ``path``.

    The window is read with pushed filters and the seven columns it needs.  A run adds its groups as parts by day and rewrites nothing;
    repeating run number ``run`` replaces them, and on read the last computation of a group wins.
    """
    reports = read_window(spark, reports_path, as_of - dt.timedelta(days=1), hours)
    for name, df in run_rollups(reports, as_of, hours, mode).items():
        kind = df.schema["bucket_start"].dataType.simpleString()
        stamp = F.lit(computed_at if computed_at.tzinfo else computed_at.replace(tzinfo=dt.timezone.utc))
        _log(spark, path, name, kind).append(df.withColumn("computed_at", stamp), run, F.col("bucket_start"))


def stored_rollup(spark: SparkSession, path: str, name: str, kind: str = "timestamp_ntz", since: dt.date | None = None) -> DataFrame:
    """The stored rollup ``name`` (hourly or daily); days before ``since`` are not opened."""
    return _last_computed(_log(spark, path, name, kind).read(since=since)).select(*DIMS, *MEASURES)
