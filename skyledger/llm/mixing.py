"""Mixing sources to target weights by prefix sums in a hash-random order.

Every document gets a random key (a digest of seed and doc_id).  Rows are sorted by key within their source, in equal-width
key ranges so that a source of any size spreads over many tasks; sums of the ranges give each range its start, sums inside
a range give each document its own.  A source takes all its documents as often as its budget allows, and then the
documents in key order until the budget is used up to the word: the last one is taken in part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F


from skyledger.session import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Documents that a key range holds on average, at most.
RANGE_ROWS = 20_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target for one row (source, source_size) per source.

    Sources in code point order, null last, weigh ``weights``, repeating.  The level that spends share * total with no target above
    most * source_size is found from the sorted ratios size / weight: the sources below it are full.  Windows here see one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.select("*", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).alias("w"))
    ratio = (F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = W.orderBy(*ratio).rowsBetween(W.unboundedPreceding, -1), W.orderBy(*ratio).rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    steps = weighed.select(
        "*",
        (F.sum("source_size").over(whole) * share).alias("total"),
        (F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most).alias("full"),
        F.sum("w").over(after).alias("rest"),
    )
    open_here = (F.col("total") - F.col("full")) * F.col("w") <= F.col("source_size") * most * F.col("rest")
    level = F.row_number().over(W.orderBy(open_here.desc(), *ratio))  # the first open one by ratio, if any
    best = steps.select("*", open_here.alias("open"), level.alias("level"))
    first = W.orderBy("level").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left, rest, found = (F.first(c).over(first) for c in (F.col("total") - F.col("full"), F.col("rest"), F.col("open")))
    cap = (F.col("source_size") * most).cast("double")
    return best.select("source", "source_size", F.when(found, F.least(left * F.col("w") / rest, cap)).otherwise(cap).cast("double").alias("target"))


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, key: words per document and its place in the random order."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("bigint")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source; other columns ignored).

    taken: words that the mix takes of the row, repeats counted; each source's sum to its target, rounded to a whole word.  A null or
    blank text has size 0 and nothing is taken; a null source is a source of its own.  Equal keys (repeated doc_ids) are ordered by
    size.  A source of size 0 has target 0.  An empty table gives no rows.
    """
    rows = materialise(sizes(docs, seed), "sizes")
    aim = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    aim = materialise(aim.select("*", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest")), "targets")

    digits = max(1, math.ceil(math.log(max(1, rows.count() / RANGE_ROWS), 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    starts = by_range.select("source", "range", (F.sum("n").over(W.partitionBy("source").orderBy("range")) - F.col("n")).alias("start"))
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rows.withColumn("upto", F.sum("size").over(inside))
    joined = summed.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.range") == F.col("s.range")))
    joined = joined.select("r.doc_id", "r.source", "r.size", (F.col("start") + F.col("upto") - F.col("r.size")).alias("before"))
    out = joined.alias("r").join(aim.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("bigint").alias("taken"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: the rows of ``docs``, repeated or cut to what :func:`mix` takes, with all their columns.

    A document that is taken in part keeps its first words, joined by one space, and ``n_chars`` (if there) follows.  Rows of which
    nothing is taken go.  Repeats of a doc_id are matched in order of their size.
    """
    names = docs.columns
    nth = lambda size: F.row_number().over(W.partitionBy("doc_id", size).orderBy(size))
    taken = mix(docs, **how).select("doc_id", "size", "taken")
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("bigint")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", size.alias("size"))
    left = left.withColumn("nth", nth("size")).alias("d")
    right = taken.withColumn("nth", nth("size")).alias("t")
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.size") == F.col("t.size")) & (F.col("d.nth") == F.col("t.nth"))
    copies = left.join(right, on).filter("taken > 0")
    per = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(taken - 1) div d.size")))
    copies = copies.select("row", F.col("d.size").alias("size"), "taken", per.alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    text = F.col("row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), 1, words.cast("int")), " ")
    copies = copies.withColumn("text", F.when(words < F.col("size"), cut).otherwise(text))
    change = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return copies.select(*[change[c].alias(c) if c in change else F.col(f"row.`{c}`").alias(c) for c in names])


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS size,
    md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM sources),
steps AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 AS total,
    2 * coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
    sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
level AS (
  SELECT total - full_size AS remaining, rest FROM steps WHERE (total - full_size) * w <= source_size * 2 * rest
  ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST LIMIT 1),
aims AS (
  SELECT source, source_size,
    CASE WHEN rest IS NULL THEN CAST(2 * source_size AS DOUBLE) ELSE least(CAST(remaining AS DOUBLE) * w / rest, CAST(2 * source_size AS DOUBLE)) END AS target
  FROM weighed LEFT JOIN level ON true),
budgets AS (
  SELECT *, CAST(floor(target + 0.5e0) AS BIGINT) AS budget FROM aims),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM sized)
SELECT o.doc_id, CAST(o.size AS BIGINT) AS size, b.source_size, b.target,
  CAST(CASE WHEN b.source_size = 0 THEN 0 ELSE (b.budget // b.source_size) * o.size
    + greatest(0, least(o.size, b.budget - (b.budget // b.source_size) * b.source_size - o.before)) END AS BIGINT) AS taken
FROM ordered o JOIN budgets b ON o.source IS NOT DISTINCT FROM b.source
"""
