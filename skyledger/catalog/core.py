"""Registry of runnable queries and their check statements."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger import fixtures
from skyledger.operators.geocode import Gazetteer
from skyledger.session import materialise
from skyledger.sources.dims import normal_aliases

AS_OF = dt.datetime.fromisoformat(fixtures.AS_OF)
AS_OF_SQL = f"TIMESTAMP '{fixtures.AS_OF}'"

#: Tasks of heavy row work for each file split of a table that has several.
TASKS_PER_SPLIT = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_gazetteers: dict[tuple[str, str], Gazetteer] = {}


class Inputs:
    """The given tables and the weather tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def sql(self, names: list[str], body: str, extra: dict[str, str] | None = None) -> DataFrame:
        return fixtures.run_sql(self.spark, self.sf_dir, fixtures.with_sql(names, body, extra))

    def derived(self, name: str) -> DataFrame:
        return fixtures.derive(self.spark, self.sf_dir, name)

    @staticmethod
    def spread(df: DataFrame) -> DataFrame:
        """Use all cores for heavy row work, in tasks of a share of a file split.

        A split holds as many rows as compression lets it, so a table of a dozen splits would keep every core in one long task.
        Tables of many splits for each core are left as they are.
        """
        cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
        if splits >= TASKS_PER_SPLIT * cores:
            return df
        return df.repartition(max(cores, TASKS_PER_SPLIT * splits if splits > 1 else 0))

    @cached_property
    def reports(self) -> DataFrame:
        return self.derived("reports").withColumn("hashtags", F.split("hashtags_csv", ",")).drop("hashtags_csv")

    @cached_property
    def full_reports(self) -> DataFrame:
        """Reports with every column of the table, ``media`` included."""
        return self.with_media(self.derived("full_reports"))

    @staticmethod
    def with_media(df: DataFrame) -> DataFrame:
        """Turn the flat fixture columns into the array columns."""
        df = df.withColumn("hashtags", F.split("hashtags_csv", ","))
        key = F.concat("source", F.lit("/"), "external_id")
        ref = F.transform(
            F.sequence(F.lit(1), F.greatest("media_n", F.lit(1))),
            lambda i: F.struct(
                F.lit("media").alias("bucket"),
                F.concat(F.lit("k/"), key, F.lit("-"), i.cast("string"), F.lit(".jpg")).alias("key"),
                F.lit("image/jpeg").alias("content_type"),
                F.sha2(F.concat(key, i.cast("string")), 256).alias("sha256"),
                (F.length(key) + i).cast("bigint").alias("size"),
                F.concat(F.lit("https://example.org/m/"), key, F.lit("/"), i.cast("string")).alias("source_url"),
            ),
        )
        return df.withColumn("media", F.when(F.col("media_n") > 0, ref).otherwise(F.slice(ref, 1, 0))).drop("hashtags_csv", "media_n")

    @property
    def gazetteer(self) -> Gazetteer:
        """The places of the given tables; its lookup tables are written once per session and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _gazetteers:
            cities, aliases = self.derived("cities"), normal_aliases(self.derived("alias_rows"))
            _gazetteers[key] = Gazetteer(materialise(cities, "cities"), materialise(aliases, "aliases"))
        return _gazetteers[key]

    @cached_property
    def observations(self) -> DataFrame:
        return self.derived("observations")


def query(key: str, needs: list[str] | None = None, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(inputs) -> DataFrame`` and, if given, its check statement."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = fixtures.with_sql(needs or [], oracle, extra)
        return fn

    return wrap


def mean3_sql(column: str = "credibility_score") -> str:
    """Check-side mean in integer thousandths, half up to three decimals."""
    s, n = f"sum(CAST(round({column} * 1000) AS BIGINT))", f"count({column})"
    return f"(CASE WHEN {n} > 0 THEN CAST((2 * {s} + {n}) // (2 * {n}) AS DOUBLE) / 1000e0 END)"


def share1_sql(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN CAST((2000 * {part} + {whole}) // (2 * {whole}) AS DOUBLE) / 10e0 ELSE 0e0 END)"


def iso_sql(column: str) -> str:
    return (
        f"concat(strftime({column}, '%Y-%m-%dT%H:%M:%S'), "
        f"CASE WHEN strftime({column}, '%f') = '000000' THEN '' ELSE concat('.', strftime({column}, '%f')) END, '+00:00')"
    )
