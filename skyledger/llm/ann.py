"""Nearest neighbours by inner product over several shifted Hilbert curves.

Equal vectors are one class.  Each ordering projects the vectors at random, shifts them, and sorts them along a Hilbert curve by
range partitions; a query looks at its window of ranks in every ordering.  To turn the largest inner product into the smallest
distance, vectors get one more component that brings them all to the same length, and queries have 0 there.

How far a window must reach depends on the data: it is measured with a bounded set of queries against all rows, as the distance in
ranks to their true neighbours.  Candidates of all windows are ranked again by the exact product in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from skyledger.session import materialise

NEAREST = 20
ORDERINGS = 8
DIMENSIONS = 4
#: Queries that measure the window, and the share of their neighbours that it must hold.
PILOTS = 128
HELD = 0.97
#: Ranks per task, and queries that a task compares at once.
CELL = 1 << 15
QUERY_BLOCK = 1 << 12
AT_ONCE = 128


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows) along a Hilbert curve of ``bits`` bits per axis."""
    x = points.T.astype(np.int64).copy()
    for level in range(bits - 1, -1, -1):  # undo the turns of each subcube
        q, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low) if level else np.zeros_like(x[0])
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> level) & 1)
    return key


class Curves:
    """Random projections and shifts of all orderings."""

    def __init__(self, size: int, longest: float, orderings: int, dimensions: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.longest, self.bits, self.dimensions = longest, min(15, 62 // dimensions), dimensions
        dimensions = min(dimensions, size + 1)
        self.axes = [np.linalg.qr(rng.normal(size=(size + 1, dimensions)))[0] for _ in range(orderings)]
        self.shifts = rng.random((orderings, dimensions))

    def keys(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """One row of keys per ordering."""
        squares = (vectors**2).sum(1)
        if queries:  # the length of a query changes no order
            whole = np.concatenate([vectors * (self.longest / np.sqrt(squares))[:, None], np.zeros((len(vectors), 1))], 1)
        else:
            whole = np.concatenate([vectors, np.sqrt(np.maximum(self.longest**2 - squares, 0))[:, None]], 1)
        out = []
        for axes, shift in zip(self.axes, self.shifts):
            unit = ((whole @ axes / self.longest + 1) / 2 + shift) / 2
            cells = np.clip(unit * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
            out.append(hilbert_keys(cells, self.bits))
        return np.stack(out)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors packed as little-endian doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` highest scores, ties by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows with an id and a non-zero vector of finite components, of the most frequent length; equal rows once."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(finite & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.filter(F.size("embedding") == (size["size"] if size else 0))
    return rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v")).distinct()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("v")
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("least"), pa.array([r.astype("<f8").tobytes() for r in values], pa.binary())], names=["least", "vec"])


def classes_of(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(cid, least, vec: distinct vectors; cid, vec_id: the smallest k + 1 ids of each)"""
    vectors = rows.groupBy("v").agg(F.min("vec_id").alias("least"))
    vectors = materialise(vectors.mapInArrow(_packed, "least bigint, vec binary").withColumn("cid", F.monotonically_increasing_id()), "vectors")
    packed = rows.withColumnRenamed("vec_id", "least").mapInArrow(_packed, "least bigint, vec binary").withColumnRenamed("least", "vec_id")
    members = materialise(packed.join(vectors.select("cid", "vec"), "vec").select("cid", "vec_id"), "members")
    return vectors, members


def nearest(vectors: DataFrame, every: int = 20, k: int = NEAREST, orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, held: float = HELD) -> DataFrame:
    """query_id, rank, vec_id, score for ``vectors`` (vec_id, embedding; other columns ignored).

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the query's own; the ``k`` largest inner products that
    were found, nearest first, ties by the smaller vec_id.  Vectors that are null, zero, not finite, without an id or of another length
    than most take no part.  Fully equal rows are one; rows that share a vec_id are candidates one by one.  No query, no row.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "usable")
    classes, members = classes_of(rows, k)
    # a query's own class may come first, and so may its own id
    asked = materialise(members.filter(F.col("vec_id") % every == 0), "asked")
    queries = materialise(classes.join(asked.select("cid").distinct(), "cid", "left_semi"), "queries")
    first = classes.select("vec").first()
    if first is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size = len(first.vec) // 8

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((matrix(batch.column("vec")) ** 2).sum(1)).max())])], names=["n"])

    curves = Curves(size, classes.select("vec").mapInArrow(longest, "n double").agg(F.max("n")).first()[0], orderings, dimensions)

    def keyed(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                for o, keys in enumerate(curves.keys(matrix(batch.column("vec")), is_query)):
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, o, np.int32)), pa.array(keys), batch.column("cid"), pa.array(np.full(n, is_query))], names=["o", "key", "cid", "is_query"]
                    )

        return run

    shape = "o int, key bigint, cid bigint, is_query boolean"
    places = classes.mapInArrow(keyed(False), shape).unionAll(queries.mapInArrow(keyed(True), shape))
    by = ["o", "key", "cid", "is_query"]
    sorted_places = materialise(places.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "curves")
    part = F.shiftright("at", 33).alias("part")
    runs = sorted_places.groupBy("o", part).agg(F.count("*").alias("n"), F.min("at").alias("start"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("o").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = runs.select("o", "part", (before - F.col("start")).alias("shift"))
    ranked = sorted_places.withColumn("part", part).join(shift, ["o", "part"])
    ranked = materialise(ranked.select("o", "cid", "is_query", (F.col("at") + F.col("shift")).alias("rank")), "ranked")

    reach = measured_reach(classes, queries, ranked, k, held)
    found = windows(classes, queries, ranked, reach, k)

    # classes to rows: each class brings its smallest ids, since no more can be among the nearest
    few = W.partitionBy("cid").orderBy("vec_id")
    ids = members.withColumn("nth", F.row_number().over(few)).filter(F.col("nth") <= k + 1).drop("nth")
    by_score = [F.desc("score"), "vec_id"]
    near = found.join(ids, "cid").withColumn("nth", F.row_number().over(W.partitionBy("qcid").orderBy(*by_score))).filter(F.col("nth") <= k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qcid")).join(near.select("qcid", "vec_id", "score"), "qcid")
    answers = answers.filter("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*by_score))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def measured_reach(classes: DataFrame, queries: DataFrame, ranked: DataFrame, k: int, held: float) -> int:
    """Ranks within which the share ``held`` of the pilots' true neighbours lies in some ordering."""
    pilots = queries.orderBy(F.xxhash64("cid"), "cid").limit(PILOTS).select("cid", "vec").collect()
    if not pilots:
        return 0
    ids, block = np.array([p.cid for p in pilots]), np.stack([np.frombuffer(p.vec, "<f8") for p in pilots])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cids, scores = batch.column("cid").to_numpy(zero_copy_only=False), block @ matrix(batch.column("vec")).T
            best = [top(np.where(cids == own, -np.inf, s), cids, min(k, len(cids))) for own, s in zip(ids, scores)]
            n = np.array([len(b) for b in best])
            flat = np.concatenate(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n)), pa.array(cids[flat]), pa.array(np.concatenate([s[b] for s, b in zip(scores, best)]))], names=["qcid", "cid", "score"]
            )

    true = classes.select("cid", "vec").mapInArrow(exact, "qcid bigint, cid bigint, score double").filter("qcid != cid")
    true = true.withColumn("nth", F.row_number().over(W.partitionBy("qcid").orderBy(F.desc("score"), "cid"))).filter(F.col("nth") <= k)
    here = ranked.filter("NOT is_query").select("o", "cid", "rank")
    there = ranked.filter("is_query").select("o", F.col("cid").alias("qcid"), F.col("rank").alias("qrank"))
    apart = F.min(F.abs(F.col("rank") - F.col("qrank"))).alias("apart")
    far = true.select("qcid", "cid").join(here, "cid").join(there, ["o", "qcid"]).groupBy("qcid", "cid").agg(apart)  # PILOTS * k rows
    return int(far.agg(F.percentile("apart", F.lit(held))).first()[0] or 0) + k


def windows(classes: DataFrame, queries: DataFrame, ranked: DataFrame, reach: int, k: int) -> DataFrame:
    """qcid, cid, score: the k + 1 best classes among those within ``reach`` ranks of a query in any ordering.

    Ranks are cut into cells of fixed size; a query visits the cells its windows touch, in blocks of queries where many do.
    """
    cell = F.floor(F.col("rank") / CELL).cast("bigint")
    total, asked = classes.count(), queries.count()
    visits = asked * (2 * reach + CELL) / max(1, total)
    salts = max(1, -(-int(visits) // QUERY_BLOCK))
    data = ranked.filter("NOT is_query").join(classes, "cid").select("o", cell.alias("cell"), "rank", "cid", "least", "vec")
    data = data.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ends = [F.floor(F.greatest(F.lit(0), F.col("rank") - reach) / CELL), F.floor((F.col("rank") + reach) / CELL)]
    asks = ranked.filter("is_query").join(queries, "cid").select("o", "rank", "cid", "vec", F.explode(F.sequence(*[e.cast("bigint") for e in ends])).alias("cell"))
    asks = asks.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(salts)).cast("int"))
    asks = asks.toDF(*[f"q_{c}" for c in asks.columns])  # both sides come from the same table

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left, right = left.sort_values(["rank", "cid"]), right.sort_values(["q_rank", "q_cid"])
            stack = lambda column: np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)
            vectors, asking = stack(left["vec"]), stack(right["q_vec"])
            rank, cids, least = (left[c].to_numpy() for c in ("rank", "cid", "least"))
            qrank, qcids = right["q_rank"].to_numpy(), right["q_cid"].to_numpy()
            for lo in range(0, len(asking), AT_ONCE):
                q = slice(lo, lo + AT_ONCE)
                a, b = np.searchsorted(rank, qrank[q][0] - reach), np.searchsorted(rank, qrank[q][-1] + reach, side="right")
                if a == b:
                    continue
                for qcid, scores in zip(qcids[q], asking[q] @ vectors[a:b].T):
                    some = top(scores, least[a:b], k + 1)
                    out.append((np.full(len(some), qcid), cids[a:b][some], least[a:b][some], scores[some]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], [], []]
        return pd.DataFrame(dict(zip(("qcid", "cid", "least", "score"), columns)))

    keys = ["o", "cell", "salt"]
    found = data.groupBy(*keys).cogroup(asks.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(best, "qcid bigint, cid bigint, least bigint, score double")
    found = found.groupBy("qcid", "cid").agg(F.max("score").alias("score"), F.first("least").alias("least"))
    order = W.partitionBy("qcid").orderBy(F.desc("score"), "least")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).select("qcid", "cid", "score")
