"""Filters, pages, lookups and exports over the report table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skyledger import fixed_values as V
from skyledger.functions.times import bound, iso_utc, ts_literal
from skyledger.session import materialise

SORT_COLUMNS = ("observed_at", "ingested_at", "credibility_score")


@dataclass(frozen=True)
class ReportFilter:
    """Clauses shared by every report query; unset members do nothing.

    Duplicates are left out unless asked for, rejected rows are kept.
    """

    date_from: str | dt.datetime | None = None
    date_to: str | dt.datetime | None = None
    state: str | None = None
    city: str | None = None
    category: str | None = None
    source: str | None = None
    verification_status: str | None = None
    lang: str | None = None
    include_duplicates: bool = False
    include_rejected: bool = True
    min_credibility: float | None = None


def date_bounds(df: DataFrame, date_from=None, date_to=None, column: str = "observed_at") -> DataFrame:
    """Inclusive bounds; both reach the scan as pushed filters."""
    low, high = bound(date_from), bound(date_to, end_of_day=True)
    if low is not None:
        df = df.filter(F.col(column) >= _as_type(df, column, low))
    if high is not None:
        df = df.filter(F.col(column) <= _as_type(df, column, high))
    return df


def _as_type(df: DataFrame, column: str, value: dt.datetime) -> Column:
    """Literal of the column's own type, so that no cast blocks the pushdown."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return ts_literal(value)
    return F.lit(value.replace(tzinfo=dt.timezone.utc))


def place_filter(df: DataFrame, state: str | None = None, city: str | None = None) -> DataFrame:
    """Case-insensitive match; ``%`` and ``_`` in the value act as wildcards."""
    if state:
        df = df.filter(F.col("state").ilike(state))
    if city:
        df = df.filter(F.col("city").ilike(city))
    return df


def equality_filter(
    df: DataFrame, category=None, source=None, verification_status=None, lang=None, include_rejected: bool = True
) -> DataFrame:
    wanted = {"event_category": category, "source": source, "verification_status": verification_status, "lang": lang}
    for column, value in wanted.items():
        if value:
            df = df.filter(F.col(column) == value)
    if not verification_status and not include_rejected:
        df = df.filter(F.col("verification_status") != "rejected")
    return df


def quality_filter(df: DataFrame, include_duplicates: bool = False, min_credibility: float | None = None) -> DataFrame:
    if not include_duplicates:
        df = df.filter(~F.col("is_duplicate"))
    if min_credibility is not None:
        df = df.filter(F.col("credibility_score") >= min_credibility)
    return df


def filter_reports(df: DataFrame, f: ReportFilter = ReportFilter()) -> DataFrame:
    df = date_bounds(df, f.date_from, f.date_to)
    df = place_filter(df, f.state, f.city)
    df = equality_filter(df, f.category, f.source, f.verification_status, f.lang, f.include_rejected)
    return quality_filter(df, f.include_duplicates, f.min_credibility)


def page_reports(
    df: DataFrame, page: int = 1, size: int = 25, sort: str = "observed_at", order: str = "desc",
    id_column: str = "report_id", max_size: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """One page and its one-row meta (page, page_size, total, pages).

    Nulls come first on descending and last on ascending order; the id breaks
    ties.  The page is a top-k, so no full sort is shuffled.
    """
    if page < 1 or not 1 <= size <= max_size:
        raise ValueError(f"page >= 1 and 1 <= size <= {max_size} expected")
    key = _sorting(sort, order)
    rows = df.orderBy(key, F.col(id_column)).offset((page - 1) * size).limit(size)
    meta = df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        "total",
        F.floor((F.col("total") + size - 1) / size).cast("bigint").alias("pages"),
    )
    return rows, meta


def _sorting(sort: str, order: str) -> Column:
    if sort not in SORT_COLUMNS or order not in ("asc", "desc"):
        raise ValueError(f"sort by one of {SORT_COLUMNS}, asc or desc")
    return F.col(sort).asc_nulls_last() if order == "asc" else F.col(sort).desc_nulls_first()


def seek_reports(
    df: DataFrame, start: tuple | None = None, size: int = 25, sort: str = "observed_at", order: str = "desc", id_column: str = "report_id", after: bool = True,
) -> DataFrame:
    """The page behind the row ``start`` (its sort value, its id) in the order of :func:`page_reports`, or from it on if not ``after``.

    Only rows from there on compete for the page, so any page is gathered as ``size`` rows, and a sort column that the files are ordered
    by lets the scan skip what lies before.
    """
    key = _sorting(sort, order)
    if start is not None:
        value, own = start
        later = F.col(id_column) > F.lit(own) if after else F.col(id_column) >= F.lit(own)
        at = F.lit(value).cast(df.schema[sort].dataType)
        if value is None:
            rest = (F.col(sort).isNull() & later) | (F.col(sort).isNotNull() if order == "desc" else F.lit(False))
        elif order == "desc":
            rest = (F.col(sort) < at) | ((F.col(sort) == at) & later)
        else:
            rest = (F.col(sort) > at) | F.col(sort).isNull() | ((F.col(sort) == at) & later)
        df = df.filter(rest)
    return df.orderBy(key, F.col(id_column)).limit(size)


def page_starts(df: DataFrame, size: int = 25, sort: str = "observed_at", order: str = "desc", id_column: str = "report_id") -> DataFrame:
    """page, value, id: the first row of every page, to be stored and jumped to with :func:`seek_reports`.

    Rows are numbered by ranges of the sort key: counts of the ranges tell where each begins.
    """
    _sorting(sort, order)
    ranged = df.select(F.col(sort).alias("value"), F.col(id_column).alias("id"))
    by = [F.col("value").asc_nulls_last() if order == "asc" else F.col("value").desc_nulls_first(), F.col("id")]
    ranged = materialise(ranged.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    begins = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))  # a row per range
    number = F.row_number().over(Window.partitionBy("part").orderBy(*by)) + F.col("begin") - 1
    numbered = ranged.join(begins, "part").withColumn("number", number)
    return numbered.filter(F.col("number") % size == 0).select((F.expr(f"number div {size}") + 1).alias("page"), "value", "id")


def review_queue(
    df: DataFrame, f: ReportFilter | None = None, page: int = 1, size: int = 25, id_column: str = "report_id"
) -> tuple[DataFrame, DataFrame]:
    """Pending rows by default, duplicates included, pages of up to 200."""
    f = f or ReportFilter(verification_status="pending", include_duplicates=True)
    return page_reports(filter_reports(df, f), page, size, "observed_at", "desc", id_column, max_size=200)


def search_like(df: DataFrame, q: str, f: ReportFilter = ReportFilter()) -> DataFrame:
    """Substring search on text, joined hashtags, city and state."""
    like = f"%{q}%"
    fields = [F.col("text"), F.array_join("hashtags", " "), F.col("city"), F.col("state")]
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(field, F.lit("")).ilike(like)
    return filter_reports(df, f).filter(hit)


def report_detail(df: DataFrame, ids: list, id_column: str = "report_id") -> DataFrame:
    return df.filter(F.col(id_column).isin(ids))


def track(tokens: DataFrame, reports: DataFrame, id_column: str = "report_id") -> DataFrame:
    """Tracking rows of many tokens at once."""
    columns = [
        id_column, "verification_status", "verification_note", "observed_at", "city", "state", "event_category",
    ]
    return tokens.select("token", id_column).join(reports.select(*columns), id_column)


def report_media(df: DataFrame, keys: DataFrame | str, id_column: str = "report_id") -> DataFrame:
    """Media references of reports, one row each; ``keys`` narrows them."""
    refs = df.select(id_column, F.inline("media"))
    if isinstance(keys, str):
        return refs.filter(F.col("key") == keys)
    return refs.join(keys, [id_column, "key"], "left_semi")


def export_reports(
    df: DataFrame, limit: int = V.EXPORT_LIMIT, f: ReportFilter = ReportFilter()
) -> DataFrame:
    """The fixed export columns, newest first, as they go into a file."""
    if not 1 <= limit <= V.EXPORT_LIMIT_MAX:
        raise ValueError(f"limit must be within 1..{V.EXPORT_LIMIT_MAX}")
    newest = filter_reports(df, f).orderBy(F.col("observed_at").desc_nulls_first(), "id").limit(limit)
    shown = {
        "observed_at": iso_utc(F.col("observed_at")),
        "ingested_at": iso_utc(F.col("ingested_at")),
        "text": F.translate("text", "\n\r", "  "),
    }
    return newest.select(*[shown.get(c, F.col(c)).alias(c) for c in V.EXPORT_COLUMNS])


def write_export(export: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the (bounded) export as one ordered CSV or JSON-lines file."""
    out = export.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        out.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        out.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError("fmt must be csv or json")


def to_search_docs(df: DataFrame) -> DataFrame:
    """Search-index documents: location only with both coordinates."""
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return df.select(
        "id", "source", "author", "text", "lang",
        F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"),
        "city", "district", "state", "event_category", "severity", "verification_status",
        F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"),
        F.coalesce(F.col("credibility_score").cast("double"), F.lit(0.0)).alias("credibility_score"),
        "lat", "lon",
        F.when(both, F.struct("lat", "lon")).alias("location"),
        iso_utc(F.col("observed_at")).alias("observed_at"),
        iso_utc(F.col("ingested_at")).alias("ingested_at"),
        media_count(F.col("media")).alias("media_count"),
    )


def media_count(media: Column) -> Column:
    return F.coalesce(F.size(media), F.lit(0)).cast("bigint")


def live_feed(df: DataFrame) -> DataFrame:
    """Events for the live view; works on batches and on streams."""
    return df.filter(~F.col("is_duplicate")).select(
        "id", "source", "city", "state", "event_category", "severity", "confidence", "credibility_score",
        F.substring("text", 1, V.LIVE_TEXT_CHARS).alias("text"),
        "lat", "lon", iso_utc(F.col("observed_at")).alias("observed_at"),
    )


def live_tail(df: DataFrame, n: int = V.LIVE_TAIL) -> DataFrame:
    return df.orderBy(F.col("observed_at").desc_nulls_first(), "id").limit(n)


def relabel(df: DataFrame, pattern: str = "load-%", source: str = "loadtest") -> DataFrame:
    """Give rows whose external id matches the pattern another source."""
    return df.withColumn(
        "source", F.when(F.col("external_id").like(pattern), F.lit(source)).otherwise(F.col("source"))
    )


def count_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")
