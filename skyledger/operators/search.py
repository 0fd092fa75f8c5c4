"""Ranked search over report fields."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions.plan import once
from skyledger.session import materialise

K1, B = 1.2, 0.75
TEXT_BOOST = 2.0
KEYWORD_FIELDS = ["hashtags", "city", "state", "author"]
MAX_QUERY_CHARS = 200
#: Bytes of text, and of a row beside its text, in a task that makes or sorts postings.
TEXT_PER_TASK, ROW_BYTES = 8 << 20, 64


def tokens(col: Column) -> Column:
    """Words of a text in lower case (letters, marks, numbers, underscore)."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))


def query_terms(q: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[\wऀ-ൿ]+", q.lower())))


def max_edits(term: str) -> int:
    """Allowed edits by term length: up to 2 none, up to 5 one, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def inverted_index(df: DataFrame, id_column: str = "report_id") -> DataFrame:
    """Postings (field, term, id, tf, length) of the text and keyword fields.

    ``text`` is split into words; a keyword field is one term per value.  The
    words of one report are counted before the shuffle.  :func:`store_index`
    writes it for many queries.
    """
    text = once(df.select(id_column, "text"), words=tokens(F.col("text")))
    terms = text.select(id_column, F.size("words").alias("length"), F.explode("words").alias("term"))
    words = terms.groupBy(id_column, "term", "length").agg(F.count(F.lit(1)).alias("tf"))
    out = words.select(F.lit("text").alias("field"), "term", id_column, "tf", F.col("length").cast("bigint").alias("length"))
    none = F.expr("CAST(array() AS array<string>)")
    names = [f for f in KEYWORD_FIELDS if f in df.columns]
    values = [F.coalesce(F.col(f), none) if f == "hashtags" else F.array(F.col(f)) for f in names]
    pairs = [F.transform(v, _named(n)) for n, v in zip(names, values)]
    keys = df.select(id_column, F.explode(F.concat(*pairs)).alias("p")).select(id_column, "p.*").filter("term IS NOT NULL").distinct()
    return out.unionByName(
        keys.select("field", "term", id_column, F.lit(1).cast("bigint").alias("tf"), F.lit(1).cast("bigint").alias("length"))
    )


def _named(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("term"))


@dataclass(frozen=True, eq=False)
class Index:
    """postings (field, term, id, tf, length), terms (field, term, df) and fields (field, docs, mean_length).

    A stored index has its postings in folders by a hash of field and term, sorted inside, and its terms in folders by field and length:
    a query opens the lengths that its terms can be misspelled to, and the folders of the terms found there.
    """

    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    stored: bool = False


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def _statistics(postings: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    docs = postings.groupBy("field", id_column).agg(F.max("length").alias("length"))
    return _terms(postings), docs.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length"))


def _field_statistics(df: DataFrame, id_column: str, tasks: int) -> DataFrame:
    """What :func:`_statistics` says of fields, from the rows; only lengths are shuffled."""
    names = [f for f in KEYWORD_FIELDS if f in df.columns]
    text = F.when(F.size(tokens(F.col("text"))) > 0, F.size(tokens(F.col("text"))))
    one = [F.when(F.exists(f, lambda v: v.isNotNull()) if f == "hashtags" else F.col(f).isNotNull(), F.lit(1)) for f in names]
    lengths = df.select(id_column, *[c.cast("bigint").alias(f"_{f}") for f, c in zip(["text", *names], [text, *one])])
    docs = lengths.repartition(tasks, id_column).groupBy(id_column).agg(*[F.max(f"_{f}").alias(f"_{f}") for f in ["text", *names]])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("length")) for f in ["text", *names]])
    rows = docs.select(F.inline(pairs)).filter("length IS NOT NULL")
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length"))


def _tasks(df: DataFrame) -> int:
    """Tasks for the postings of ``df``: a bounded share of its text each."""
    held = df.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + ROW_BYTES)).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(held / TEXT_PER_TASK))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("field", "term"), F.lit(buckets)).cast("int")


def store_index(df: DataFrame, path: str, id_column: str = "report_id", buckets: int = 64) -> Index:
    """Write the index of ``df`` under ``path`` and open it; the postings of a very common term are spread over tasks by id.

    Rows meet by id before their words are told apart, and tasks grow in number with the text, so none holds more than its share of it.
    """
    tasks = _tasks(df)
    postings = inverted_index(df.repartition(tasks, id_column), id_column).withColumn("bucket", _bucket(buckets))
    ranged = postings.repartitionByRange(tasks, "bucket", "field", "term", id_column).sortWithinPartitions("bucket", "field", "term", id_column)
    ranged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms = _terms(df.sparkSession.read.parquet(f"{path}/postings"))
    fields = _field_statistics(df, id_column, tasks)
    terms = terms.select("*", _bucket(buckets).alias("bucket"), F.length("term").alias("size"))
    terms.write.mode("overwrite").partitionBy("field", "size").parquet(f"{path}/terms")
    fields.write.mode("overwrite").parquet(f"{path}/fields")
    return open_index(df.sparkSession, path, df.schema[id_column].dataType.simpleString(), id_column)


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", id_column: str = "report_id") -> Index:
    schemas = {
        "postings": f"field string, term string, {id_column} {id_type}, tf bigint, length bigint, bucket int", "terms": "term string, df bigint, bucket int, field string, size int",
        "fields": "field string, docs bigint, mean_length double",
    }
    return Index(*[spark.read.schema(s).parquet(f"{path}/{n}") for n, s in schemas.items()], stored=True)


def search_ranked(
    df: DataFrame | None, q: str, k: int = 25, allowed: DataFrame | None = None, id_column: str = "report_id",
    index: Index | None = None,
) -> DataFrame:
    """Top ``k`` reports for a query, best field first.

    Each field is scored alone (text doubled) and the best field counts.  Text
    is matched word by word, keyword fields as a whole, both with a few edits
    allowed; the more edits, the less a match counts.  Only rows in ``allowed``
    are ranked.  Spelling distance is computed on distinct terms, not on reports.
    With an ``index`` its statistics count, whatever is ``allowed``, and ``df`` is not read.
    """
    if not 1 <= len(q) <= MAX_QUERY_CHARS:
        raise ValueError(f"query of 1..{MAX_QUERY_CHARS} characters expected")
    if index is None:
        postings = inverted_index(df, id_column)
        if allowed is not None:
            postings = postings.join(allowed.select(id_column), id_column, "left_semi")
        index = Index(postings, *_statistics(postings, id_column))
    elif allowed is not None and not index.stored:
        index = replace(index, postings=index.postings.join(allowed.select(id_column), id_column, "left_semi"))
    asked = query_terms(q)
    probes = [("text", t, max_edits(t)) for t in asked] + [(f, q, max_edits(q)) for f in KEYWORD_FIELDS]
    matches = []
    for i, (field, term, edits) in enumerate(probes):
        distance = F.levenshtein(F.col("term"), F.lit(term), edits) if edits else F.when(F.col("term") == term, F.lit(0)).otherwise(F.lit(-1))
        closeness = F.lit(1.0) - distance / F.greatest(F.lit(1.0), F.least(F.length("term"), F.lit(len(term))).cast("double"))
        row = F.struct(F.lit(i).alias("probe"), closeness.alias("closeness"))
        matches.append(F.when((F.col("field") == field) & (distance >= 0), row))
    vocabulary, postings = index.terms, index.postings
    if index.stored:
        within = [(F.col("field") == f) & F.col("size").between(len(t) - e, len(t) + e) for f, t, e in probes]
        vocabulary = vocabulary.filter(functools.reduce(lambda a, b: a | b, within))
    near = F.explode(F.array_compact(F.array(*matches))).alias("m")
    hit_terms = vocabulary.select("field", "term", "df", *(["bucket"] if index.stored else []), near).select("*", "m.*").drop("m").filter("closeness > 0")
    if index.stored:
        hit_terms = materialise(hit_terms, "terms-found")
        buckets = [r[0] for r in hit_terms.select("bucket").distinct().collect()]  # no more than there are folders
        postings = postings.filter(F.col("bucket").isin(buckets)).drop("bucket")
        hit_terms = hit_terms.drop("bucket")
        if allowed is not None:
            postings = postings.join(allowed.select(id_column), id_column, "left_semi")
    scored = postings.join(hit_terms, ["field", "term"]).join(index.fields, "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    boost = F.when(F.col("field") == "text", F.lit(TEXT_BOOST)).otherwise(F.lit(1.0))
    part = scored.withColumn("part", boost * idf * saturation * F.col("closeness"))
    per_probe = part.groupBy(id_column, "field", "probe").agg(F.max("part").alias("part"))
    per_field = per_probe.groupBy(id_column, "field").agg(F.sum("part").alias("score"))
    best = per_field.groupBy(id_column).agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), id_column).limit(k)
