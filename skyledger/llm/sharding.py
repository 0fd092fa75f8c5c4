"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 60-bit hashes.  A row belongs to the next point clockwise of its hash; the
hash is that of the text, so equal texts stand together.  A shard takes rows up to its capacity; what does not fit continues
clockwise to the next point, and so on.  Capacities sum up to the number of rows, so counts differ by one at most (law
``rows``) and only rows in overfull arcs move away from home.

The rows are range-sorted by hash, which gives each one its rank within its arc.  The walk round the ring then needs
nothing but the number of rows per arc (``shards * vnodes + 1`` numbers, whatever the size of the corpus): each arc's rows
split into few pieces of consecutive ranks, and a row finds its piece by (arc, rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from skyledger.session import materialise

RING_BITS = 60
CELL_BITS = 12
_LOW = (1 << 33) - 1


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """arc, lo, hi, shard: the hashes lo <= h < hi belong to the point at hi.

    The arc after the last point belongs to the first point, and the walk continues with arc 0 from there.
    """
    digest = F.md5(F.concat_ws("/", F.lit("shard"), F.col("shard"), F.col("vnode")))
    points = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("vnode"))
    points = points.withColumn("hi", F.conv(F.substring(digest, 1, RING_BITS // 4), 16, 10).cast("bigint"))
    # one row per virtual node: a window over a table whose size is a parameter
    order = W.orderBy("hi", "shard", "vnode")
    arcs = points.select(
        (F.row_number().over(order) - 1).alias("arc"), F.lag("hi", 1, 0).over(order).alias("lo"), "hi", "shard", F.first("shard").over(order).alias("first"), F.lead("hi").over(order).alias("next")
    )
    last = arcs.filter("next IS NULL").select((F.col("arc") + 1).alias("arc"), F.col("hi").alias("lo"), F.lit(1 << RING_BITS).alias("hi"), F.col("first").alias("shard"))
    return arcs.select("arc", "lo", "hi", "shard").union(last)


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, from rank, to rank, shard, first slot) of a walk round the ring.

    ``counts`` rows start in each arc, whose point belongs to shard ``owner``; ``room`` is each shard's capacity.  In step d
    every arc offers what it has left to the point d further on, arcs in ring order, lower ranks first.  Ends when all rows have
    a place, after at most one round, since the walk then has met every shard.
    """
    n, used, placed, pieces = len(counts), [0] * len(room), [0] * len(counts), []
    waiting = [a for a in range(n) if counts[a]]
    for step in range(n):
        still = []
        for arc in waiting:
            shard = owner[(arc + step) % n]
            take = min(counts[arc] - placed[arc], room[shard] - used[shard])
            if take > 0:
                pieces.append((arc, placed[arc], placed[arc] + take, shard, used[shard]))
                placed[arc] += take
                used[shard] += take
            if placed[arc] < counts[arc]:
                still.append(arc)
        waiting = still
        if not waiting:
            break
    return pieces


def shard_rows(docs: DataFrame, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text; other columns ignored).

    size: UTF-8 bytes of the text plus 8; a null text counts as empty (its checksum is 0) but hashes to a place of its own.
    Ties on the ring are ordered by doc_id (nulls first), checksum and size; fully equal rows may swap places.  Repeated rows each
    get a slot.  An empty table gives no rows; fewer rows than shards leave some shards empty.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.xxhash64("text").bitwiseAND((1 << RING_BITS) - 1).alias("h"),
    )
    key = ["h", "doc_id", "text_crc32", "size"]
    at = F.monotonically_increasing_id()  # partition and place in it
    ranged = materialise(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", at), "ring")

    arcs = ring(spark, shards, vnodes)
    shift = RING_BITS - CELL_BITS
    cells = arcs.select("arc", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell"))
    homed = (
        ranged.withColumn("cell", F.shiftright("h", shift))
        .join(F.broadcast(cells), "cell")  # at most 2 ** CELL_BITS + arcs rows
        .filter("lo <= h AND h < hi")
        .select("doc_id", "size", "text_crc32", "arc", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(_LOW).alias("idx"))
    )
    runs = materialise(homed.groupBy("arc", "part").agg(F.count("*").alias("n"), F.min("idx").alias("start")), "runs")
    before = F.coalesce(F.sum("n").over(W.partitionBy("arc").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select("arc", "part", (before - F.col("start")).alias("shift"))

    owner = [r.shard for r in arcs.orderBy("arc").collect()]  # shards * vnodes + 1 rows
    counts = [0] * len(owner)
    for r in runs.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # as many at most
        counts[r.arc] = r.n
    pieces = walk(counts, owner, capacities(sum(counts), shards)) or [(-1, 0, 0, 0, 0)]
    values = ", ".join(f"({a}, {lo}L, {hi}L, {s}, {slot}L)" for a, lo, hi, s, slot in pieces)
    placed = spark.sql(f"SELECT * FROM VALUES {values} AS t(arc, first, past, shard, slot0)")

    rank = (F.col("shift") + F.col("idx")).alias("rank")
    ranked = homed.join(offsets, ["arc", "part"]).select("doc_id", "size", "text_crc32", "arc", rank)
    # a piece ends where its arc or a shard's room ends, so their number follows arcs and shards, not rows
    return ranked.join(F.broadcast(placed), (ranked.arc == placed.arc) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
