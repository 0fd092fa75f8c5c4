"""Line deduplication with levelled sorted runs of line hashes.

Documents arrive in batches.  Of each batch the hashes of its lines are counted and written as a run, bucketed and sorted
by hash.  A merge join with the runs that are there tells new hashes (those that an anti join keeps: the batch owns
them) from known ones (which only add to the count).  When a level holds ``fanout`` runs they are compacted into one run of the
next level, so a hash lies in few runs and each is rewritten a logarithmic number of times.  Buckets are equal in all
runs, so joins and compactions read them in order without a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.llm.common import BLANKS, lower_ascii
from skyledger.session import materialise, scratch_path

LEAST_CHARS = 40
LEAST_DOCS = 5

RUN = "hash binary, n_docs bigint, owner bigint, owned boolean"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column, least_chars: int) -> Column:
    """Per line the 128-bit hash of its key; null where the key is shorter than ``least_chars`` code points."""

    def key(line: Column) -> Column:
        line = F.trim(line, F.lit(BLANKS))
        return F.when(F.char_length(line) >= least_chars, F.unhex(F.md5(line)))

    return F.transform(lines_of(lower_ascii(text)), key)


class LineRuns:
    """Runs of (hash, n_docs, owner, owned) in levels, written as bucketed tables under ``spark.checkpoint.dir``.

    ``owner`` is the largest doc_id of the batch that brought the hash; ``owned`` is set in that run only.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.tables: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        # one task per bucket, so a run is one sorted file per bucket
        df = df.repartition(self.buckets, "hash")
        df.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", scratch_path(self.spark, "runs")).saveAsTable(name)
        self.tables.append(name)
        return name

    def _read(self, names: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], RUN) if not names else self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionAll(self.spark.table(name))
        return out

    def runs(self) -> DataFrame:
        return self._read([name for level in self.levels for name in level])

    def add(self, lines: DataFrame) -> None:
        """Take the lines (hash, doc_id) of a batch; a document counts once for each of its hashes."""
        own = lines.groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
        live = [name for level in self.levels for name in level]
        if live:
            known = self._read(live).filter("owned").select("hash", F.lit(True).alias("known"))  # each hash once: it has one owner
            own = own.join(known.hint("merge"), "hash", "left").withColumn("owned", F.col("known").isNull()).drop("known")
        else:
            own = own.withColumn("owned", F.lit(True))
        self.levels[0].append(self._write(own.withColumn("owner", F.when(F.col("owned"), F.col("owner")))))
        self.compact()

    def compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._write(self.merged(level))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merged)
                level.clear()

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """One row per hash over the given runs, or over all."""
        runs = self.runs() if names is None else self._read(names)
        return runs.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"), F.max("owned").alias("owned"))

    def close(self) -> None:
        """Forget the tables' names; their files are scratch of the session."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def doc_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """hash, doc_id: every long line's hash once per document."""
    keys = F.array_distinct(keys_of(F.col("text"), least_chars))
    return docs.select("doc_id", F.explode(keys).alias("hash")).filter("hash IS NOT NULL")


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = 4, fanout: int = 2) -> DataFrame:
    """hash, owner: line hashes found in ``least_docs`` documents or more, with the largest doc_id that holds them.

    The batches are ranges of doc_id, largest first, so the batch that brings a hash holds its owner.
    """
    spark = docs.sparkSession
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)), reverse=True)
    cuts = [int(c) for c in cuts]
    runs = LineRuns(spark, fanout)
    upper = None
    for lower in [*cuts, None]:
        part = docs
        if lower is not None:
            part = part.filter(F.col("doc_id") > lower)
        if upper is not None:
            part = part.filter((F.col("doc_id") <= upper) if lower is not None else ((F.col("doc_id") <= upper) | F.col("doc_id").isNull()))
        runs.add(doc_lines(part, least_chars))
        upper = lower
    # written, so that what joins it shuffles both sides itself and Spark can split the places of a very common line
    found = materialise(runs.merged().filter(F.col("n_docs") >= least_docs).select("hash", "owner"), "repeated-lines")
    runs.close()
    return found


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = 4, fanout: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, text (the kept lines) for every row of ``docs`` (doc_id, text; other columns ignored).

    A null or empty text is one empty line.  Every row is a document: rows that share a doc_id count one by one, and if that is the
    largest doc_id of a line they all keep it.  A null doc_id is below all others; a line found under null ids only is kept
    there.  A line that occurs several times in its last document keeps all its places.  An empty table gives no rows.
    """
    repeated = repeated_lines(docs, least_chars, least_docs, batches, fanout)
    places = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(keys_of(F.col("text"), least_chars)).alias("pos", "hash"))
    places = places.filter("hash IS NOT NULL").join(repeated, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
    drops = places.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drops"))  # no more than the lines of one text
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text").alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.version") == F.col("x.version"))
    rows = rows.join(drops.alias("x"), on, "left").select("d.doc_id", "d.text", "x.drops")
    lines = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return rows.select(
        "doc_id",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        text.alias("text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The kept text as its checksum."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM numbered),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
marked AS (
  SELECT k.*, r.key IS NOT NULL AND r.owner IS DISTINCT FROM k.doc_id AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
