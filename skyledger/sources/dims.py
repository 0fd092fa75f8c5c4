"""Reference tables: gazetteer, aliases, lexicon and hashtag vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.functions.text import norm_place, strip


def normal_aliases(raw: DataFrame) -> DataFrame:
    """Normalised aliases of rows (ord, alias, kind, target); the first row of an alias (per kind) wins."""
    clean = raw.select(
        "ord", norm_place(F.coalesce("alias", F.lit(""))).alias("alias"), F.lower(F.trim("kind")).alias("kind"),
        F.trim("target").alias("target"),
    ).filter("alias <> '' AND target <> '' AND kind IN ('city', 'state')")
    first = F.min_by(F.struct("ord", "target"), "ord").alias("f")
    return clean.groupBy("alias", "kind").agg(first).select("f.ord", "alias", "kind", "f.target")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with numbers that grow along it, 0 for the first; the splits of a large file are read by many tasks.

    A number is twice the byte at which the line's split starts plus its place among the lines of the split, of which there are
    no more than bytes and one.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    first = lines.groupBy("start").agg(F.min("at").alias("first"))
    return lines.join(first, "start").select((2 * F.col("start") + F.col("at") - F.col("first")).alias("ord"), "line")


def load_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``city,state,district,lat,lon``; rows with bad numbers are skipped."""
    lines = _numbered_lines(spark, path)
    fields = F.from_csv("line", "city string, state string, district string, lat string, lon string")
    rows = lines.filter("ord > 0 AND line <> ''").select("ord", fields.alias("c")).select("ord", "c.*")
    out = rows.select(
        "ord", F.trim("city").alias("city"), F.trim("state").alias("state"),
        F.trim(F.coalesce("district", F.lit(""))).alias("district"),
        F.trim("lat").try_cast("double").alias("lat"), F.trim("lon").try_cast("double").alias("lon"),
    )
    return out.filter("city IS NOT NULL AND state IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``alias,kind,target``; lines starting with ``#`` are comments."""
    lines = _numbered_lines(spark, path).filter(~F.ltrim("line").startswith("#"))
    fields = F.from_csv("line", "alias string, kind string, target string")
    return normal_aliases(lines.filter("ord > 0").select("ord", fields.alias("c")).select("ord", "c.*"))


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``weight<TAB>term`` lines; comments and malformed rows are skipped."""
    lines = _numbered_lines(spark, path).select("ord", strip(F.col("line")).alias("line"))
    parts = F.split("line", "\t")
    rows = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#") & (F.size(parts) == 2))
    return rows.select(
        "ord", parts[0].try_cast("double").alias("weight"), F.lower(parts[1]).alias("term")
    ).filter("weight IS NOT NULL")


def load_hashtags(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case tags; lines starting with ``# `` are comments."""
    lines = _numbered_lines(spark, path).select(strip(F.col("line")).alias("line"))
    rows = lines.filter((F.col("line") != "") & ~F.col("line").startswith("# "))
    return rows.select(F.lower(F.regexp_replace("line", "^#+", "")).alias("tag")).distinct()


LEXICON_MAX = 5_000


def lexicon_rows(lexicon: DataFrame) -> list[tuple[float, str]]:
    """The lexicon as rows for an expression; refuses one that is not small."""
    rows = lexicon.orderBy("ord").select("weight", "term").limit(LEXICON_MAX + 1).collect()
    if len(rows) > LEXICON_MAX:
        raise ValueError(f"lexicon larger than {LEXICON_MAX} terms")
    return [(r.weight, r.term) for r in rows]
