"""Dashboard aggregates.  Every function takes ``as_of`` instead of a clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skyledger import fixed_values as V
from skyledger.functions.numbers import mean3, share1
from skyledger.operators.reports import ReportFilter, _as_type, filter_reports
from skyledger.session import materialise

GROUP_DEFAULTS = {
    "category": ("event_category", "other"), "state": ("state", "Unknown"), "source": ("source", None),
    "city": ("city", "Unknown"), "lang": ("lang", "unknown"),
}


def group_key(name: str) -> Column:
    column, default = GROUP_DEFAULTS[name]
    return F.col(column) if default is None else F.coalesce(F.col(column), F.lit(default))


def _since(df: DataFrame, as_of: dt.datetime, **age) -> Column:
    return F.col("observed_at") >= _as_type(df, "observed_at", as_of - dt.timedelta(**age))


def _shown(mean: Column) -> Column:
    return F.coalesce(mean, F.lit(0.0))


def summary(df: DataFrame, sources: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row of headline numbers from a single aggregate over the reports.

    Counts per category, status and state are the only thing shuffled; they are
    written, and the totals and the distinct states are aggregates over them.
    """
    live = df.filter(~F.col("is_duplicate"))
    score = F.round(F.col("credibility_score") * 1000).cast("bigint")
    cells = live.groupBy(group_key("category").alias("category"), "verification_status", "state").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(score).alias("score"),
        F.count("credibility_score").alias("scored"),
        F.count_if(_since(df, as_of, hours=24)).alias("n24"),
        F.count_if(_since(df, as_of, hours=1)).alias("n1"),
    )
    cells = materialise(cells, "summary")
    states = cells.filter("state IS NOT NULL").groupBy("state").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n"))
    by_category = cells.groupBy("category").agg(
        F.sum("n").alias("n"), F.sum("score").alias("score"), F.sum("scored").alias("scored"),
        F.sum("n24").alias("n24"), F.sum("n1").alias("n1"),
        *[
            F.sum(F.when(F.col("verification_status") == s, F.col("n")).otherwise(0)).alias(s)
            for s in V.VERIFICATION_STATUSES
        ],
    )
    total, scored = F.sum("n"), F.sum("scored")
    entry = F.struct((-F.col("n")).alias("neg"), F.col("category").alias("category"))
    ordered = F.array_sort(F.collect_list(entry))
    headline = by_category.agg(
        F.coalesce(total, F.lit(0)).alias("total_reports"),
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in V.VERIFICATION_STATUSES],
        F.coalesce(share1(F.sum("verified"), total), F.lit(0.0)).alias("verified_pct"),
        _shown(
            F.when(scored > 0, F.floor((F.sum("score") * 2 + scored) / (scored * 2)).cast("double") / 1000)
        ).alias("avg_credibility"),
        F.coalesce(F.sum("n24"), F.lit(0)).alias("reports_last_24h"),
        F.coalesce(F.sum("n1"), F.lit(0)).alias("reports_last_hour"),
        F.array_join(
            F.transform(ordered, lambda e: F.concat_ws(":", e["category"], (-e["neg"]).cast("string"))), ","
        ).alias("categories"),
    )
    enabled = sources.filter("enabled").agg(F.count(F.lit(1)).alias("sources_enabled"))
    return headline.withColumns({"states_covered": states.scalar(), "sources_enabled": enabled.scalar()})


def timeseries(df: DataFrame, bucket: str = "hour", key: str = "category", f: ReportFilter = ReportFilter()) -> DataFrame:
    if bucket not in ("hour", "day", "week"):
        raise ValueError("bucket must be hour, day or week")
    return (
        filter_reports(df, f)
        .groupBy(F.date_trunc(bucket, "observed_at").cast(df.schema["observed_at"].dataType).alias("bucket"), group_key(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def by_state(df: DataFrame, limit: int = 36, f: ReportFilter = ReportFilter()) -> DataFrame:
    return (
        filter_reports(df, f)
        .groupBy(group_key("state").alias("state"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("verification_status") == "verified").alias("verified"),
            _shown(mean3(F.col("credibility_score"))).alias("avg_credibility"),
            F.max("observed_at").alias("last_seen"),
        )
        .orderBy(F.desc("n"), "state")
        .limit(limit)
    )


def by_category(df: DataFrame, as_of: dt.datetime, f: ReportFilter = ReportFilter()) -> DataFrame:
    """Counts of the filtered rows with a trend over all rows, in one pass.

    The trend counts ignore the filter (duplicates included); a category
    without a filtered row is not listed.
    """
    kept = _matches(df, f)
    day, two = _since(df, as_of, hours=24), _since(df, as_of, hours=48)
    score = F.when(F.col("kept"), F.col("credibility_score"))
    out = (
        df.withColumn("kept", kept)
        .groupBy(group_key("category").alias("category"))
        .agg(
            F.count_if(F.col("kept")).alias("n"),
            _shown(mean3(score)).alias("avg_credibility"),
            F.count_if(day).alias("last_24h"),
            F.count_if(two & ~day).alias("prev_24h"),
        )
        .filter(F.col("n") > 0)
    )
    return out.withColumn("trend", F.col("last_24h") - F.col("prev_24h")).orderBy(F.desc("n"), "category")


def _matches(df: DataFrame, f: ReportFilter) -> Column:
    """The report filter as one boolean (date bounds and duplicates only)."""
    from skyledger.functions.times import bound

    ok = F.lit(True) if f.include_duplicates else ~F.col("is_duplicate")
    low, high = bound(f.date_from), bound(f.date_to, end_of_day=True)
    if low is not None:
        ok = ok & (F.col("observed_at") >= _as_type(df, "observed_at", low))
    if high is not None:
        ok = ok & (F.col("observed_at") <= _as_type(df, "observed_at", high))
    return F.coalesce(ok, F.lit(False))


def by_source(df: DataFrame, f: ReportFilter = ReportFilter()) -> DataFrame:
    """Share of each source; the total is taken over the few grouped rows."""
    groups = (
        filter_reports(df, f)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), _shown(mean3(F.col("credibility_score"))).alias("avg_credibility"))
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return groups.withColumn("share_pct", share1(F.col("n"), total)).orderBy(F.desc("n"), "source")


def top_hashtags(df: DataFrame, as_of: dt.datetime, days: int = 7, limit: int = 20) -> DataFrame:
    if not 1 <= days <= 90 or not 1 <= limit <= 100:
        raise ValueError("days within 1..90 and limit within 1..100 expected")
    return (
        df.filter(~F.col("is_duplicate") & _since(df, as_of, days=days))
        .select(F.explode("hashtags").alias("tag"))
        .groupBy(F.lower("tag").alias("tag"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "tag")
        .limit(limit)
    )


def filter_options(df: DataFrame) -> DataFrame:
    """Choices for the filter form as (kind, value), from one scan.

    States and cities are bounded reports (first 100 and 200 in order); the
    bound is applied before the shuffle as a per-kind top-k.
    """
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("state", "city", "source", "lang")])
        ).alias("p")
    ).select("p.*")
    distinct = pairs.filter(F.coalesce(F.col("value"), F.lit("")) != "").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("value"))
    bounded = distinct.filter(F.col("kind").isin("state", "city")).withColumn("place", place)
    bounded = bounded.filter(F.col("place") <= 200).filter((F.col("kind") == "city") | (F.col("place") <= 100))
    return bounded.drop("place").unionByName(distinct.filter(F.col("kind").isin("source", "lang")))


def series_total(series: DataFrame, last: int = 200) -> DataFrame:
    """Sum a time series over its keys; only the last buckets are shown."""
    return series.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("bucket")).limit(last)


def top_bars(df: DataFrame, label: str, n: int = 8) -> DataFrame:
    return df.select(F.col(label).alias("label"), F.col("n").alias("value")).orderBy(F.desc("value"), "label").limit(n)
