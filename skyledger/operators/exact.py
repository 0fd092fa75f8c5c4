"""Exact copies with a time limit, by successor pointers.

A digest's owner lasts for the limit after its last unbroken delivery; the next post after that becomes the owner.  So every post that
could own its digest points at the post that would follow it, and the owners of a digest are what its first post reaches.  Pointers are
doubled, so owners are found in rounds logarithmic in the longest chain of owners: ten for ten years of weeks.

Scale: no digest is gathered.  Windows see an hour of a digest, or one row per hour or limit of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skyledger import fixed_values as V
from skyledger.session import materialise

HOUR = 3_600_000_000
DAY = 24 * HOUR


def micros(at: Column) -> Column:
    """Microseconds of a time; of an instant those of its local time, because a day is one of the session's calendar."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def _slot(us: str, width: int) -> Column:
    return F.expr(f"({us} - pmod({us}, {width}L)) div {width}L")


def exact_duplicates(df: DataFrame, ttl_days: int = V.DEDUP_TTL_DAYS) -> DataFrame:
    """Every row of ``df`` (key, digest, at) with ``duplicate_of``, the key of the registered post it copies.

    ``duplicate_of`` is null for a registered post and its deliveries, and for a row with a null key, digest or time: such a row is
    unique and registers nothing.  Posts are taken by time, then key; repeated rows stay and share their answer.
    """
    ttl = ttl_days * DAY
    timed = materialise(df.withColumn("_us", micros(F.col("at"))), "exact-rows")  # read twice, and digests are dear
    posts = timed.select("digest", "key", F.col("_us").alias("us")).dropna().distinct()
    posts = materialise(posts, "exact-posts")
    several = posts.groupBy("digest").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a < b").select("digest")
    posts = materialise(posts.join(several, "digest", "left_semi"), "exact-repeated")
    owners = materialise(_owners(posts, ttl), "exact-owners")

    # owners of a digest lie a limit apart, so a slot of that width holds one registration at most
    asked = posts.select("digest", "key", "us", _slot("us", ttl).alias("slot"))
    taken = owners.select("digest", _slot("us", ttl).alias("slot"), F.struct("us", "key").alias("here"))
    slots = asked.select("digest", "slot", F.lit(None).cast(taken.schema["here"].dataType).alias("here")).unionAll(taken)
    slots = slots.groupBy("digest", "slot").agg(F.max("here").alias("here"))
    before = F.last("here", ignorenulls=True).over(Window.partitionBy("digest").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("before", before)
    owner = F.when(F.col("here") <= F.struct("us", "key"), F.col("here.key")).otherwise(F.col("before.key"))
    found = asked.join(slots, ["digest", "slot"]).withColumn("owner", owner).filter("owner <> key")
    found = found.select("digest", "key", F.col("us").alias("_us"), F.col("owner").alias("duplicate_of"))
    return timed.join(found, ["digest", "key", "_us"], "left").select(*df.columns, "duplicate_of")


def _owners(posts: DataFrame, ttl: int) -> DataFrame:
    """digest, us, key of the posts that register their digest."""
    chains = materialise(_deliveries(posts, ttl), "exact-chains")
    nexts = materialise(_next_posts(posts, chains.select("digest", "until").distinct()), "exact-nexts")
    reached = posts.groupBy("digest").agg(F.min(F.struct("us", "key")).alias("p")).select("digest", "p.us", "p.key")
    starts = reached.unionAll(nexts.select("digest", "us", "key")).distinct()
    held = starts.join(chains, ["digest", "key"]).filter("us BETWEEN first AND last").select("digest", "us", "key", "until")
    follow = nexts.select("digest", "until", F.col("us").alias("to_us"), F.col("key").alias("to_key"))
    jumps = held.join(follow, ["digest", "until"]).drop("until")
    while True:  # after n rounds ``reached`` holds the first 2^n owners of every digest and ``jumps`` goes 2^n owners on
        jumps = materialise(jumps, "exact-jumps")
        if jumps.isEmpty():
            return reached
        on = reached.join(jumps, ["digest", "us", "key"]).select("digest", F.col("to_us").alias("us"), F.col("to_key").alias("key"))
        reached = materialise(reached.unionAll(on), "exact-reached")
        far = jumps.select("digest", F.col("us").alias("to_us"), F.col("key").alias("to_key"), F.col("to_us").alias("far_us"), F.col("to_key").alias("far_key"))
        jumps = jumps.join(far, ["digest", "to_us", "to_key"]).select("digest", "us", "key", F.col("far_us").alias("to_us"), F.col("far_key").alias("to_key"))


def _deliveries(posts: DataFrame, ttl: int) -> DataFrame:
    """digest, key, first, last, until of each unbroken chain of deliveries of one key and digest.

    Deliveries are reduced to hours first (gaps inside an hour cannot break a chain), which bounds what a window sees for one key.
    """
    hours = posts.groupBy("digest", "key", _slot("us", HOUR).alias("hour")).agg(F.min("us").alias("low"), F.max("us").alias("high"))
    w = Window.partitionBy("digest", "key").orderBy("hour")
    marked = hours.withColumn("breaks", F.when(F.col("low") >= F.lag("high").over(w) + ttl, 1).otherwise(0)).withColumn("chain", F.sum("breaks").over(w))
    chains = marked.groupBy("digest", "key", "chain").agg(F.min("low").alias("first"), F.max("high").alias("last"))
    return chains.select("digest", "key", "first", "last", (F.col("last") + ttl).alias("until"))


def _next_posts(posts: DataFrame, marks: DataFrame) -> DataFrame:
    """digest, until, us, key: the first post of the digest at or after ``until``, if there is one.

    It is looked for in the hour of ``until``, and then among the first posts of the later hours.
    """
    post = F.struct("us", "key").alias("post")
    none = F.lit(None).cast("struct<us: bigint, key: string>")
    hour = _slot("us", HOUR).alias("hour")
    events = posts.select("digest", hour, "us", F.lit(False).alias("mark"), post)
    asks = marks.select("digest", _slot("until", HOUR).alias("hour"), F.col("until").alias("us"), F.lit(True).alias("mark"), none.alias("post"))
    within = Window.partitionBy("digest", "hour").orderBy(F.desc("us"), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.unionAll(asks).withColumn("next", F.min("post").over(within)).filter("mark")
    seen = materialise(seen.select("digest", "hour", F.col("us").alias("until"), "next"), "exact-within")

    firsts = posts.groupBy("digest", hour).agg(F.min(F.struct("us", "key")).alias("post")).select("digest", "hour", F.lit(False).alias("mark"), "post")
    open_hours = seen.filter("next IS NULL").select("digest", "hour").distinct().select("digest", "hour", F.lit(True).alias("mark"), none.alias("post"))
    later = Window.partitionBy("digest").orderBy(F.desc("hour"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.unionAll(open_hours).withColumn("later", F.min("post").over(later)).filter("mark AND later IS NOT NULL").select("digest", "hour", "later")
    found = seen.join(after, ["digest", "hour"], "left").withColumn("p", F.coalesce("next", "later")).filter("p IS NOT NULL")
    return found.select("digest", "until", "p.us", "p.key")
