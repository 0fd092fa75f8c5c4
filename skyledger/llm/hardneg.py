"""Hard negatives from anchor clusters that share sorted candidate lists.

Anchors with similar directions form a cluster.  By the triangle inequality for angles, no member's product with a candidate is
above |member| * |candidate| * cos(angle to the centre - largest angle of a member to the centre).  A cluster sorts a block of
candidates by that bound once, and every member walks the same list until the bound of what is left is below what it still needs: the
last of its best positives first, and then, for each positive, the last negative it has found under that positive's score.

Candidates are packed into blocks where they lie and never move; anchors come to them in groups whose size a parameter bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.session import materialise

#: Rows of integer vectors packed into one block, anchors of a cluster's part, and parts that meet the candidates in one pass.
BLOCK_ROWS = 8192
PART_ROWS = 256
GROUP_PARTS = 32
#: Anchors that the cluster centres are fitted on, at most, and the number of centres, at most.
FIT_ROWS = 4096
CENTRES = 64
#: Candidates of a list that its members walk in one step.
STEP = 512
#: Vectors this long or longer take no part: a score need not fit a long.  Below EXACT all products are exact in double precision.
LONGEST = float(1 << 31)
EXACT = float(1 << 53)
#: What rounding can add to a cosine or product of lengths, with a wide margin.
SLACK = 1e-6

BLOCK = "rows long, width long, vec_ids binary, labels binary, vectors binary"
PART = "part string, radius double, centre binary, " + BLOCK


def integer_rows(embeddings: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label, vector (array<bigint>): one row per vec_id that takes part, components floored after scaling."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("wide", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LONGEST / scale))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), wide.alias("wide"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND wide IS NOT NULL").filter(~bad)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "wide")).alias("r")).select("vec_id", "r.label", F.transform("r.wide", lambda x: F.floor(x * scale)).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return one.filter(square < LONGEST * LONGEST)


def _matrix(vectors: list) -> np.ndarray:
    """Rows of integers; a shorter vector goes on with zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> dict:
    return {"rows": len(ids), "width": matrix.shape[1], "vec_ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "vectors": matrix.astype("<i4").tobytes()}


def _unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[prefix + c], "<i8") for c in ("vec_ids", "labels"))
    return ids, labels, np.frombuffer(row[prefix + "vectors"], "<i4").reshape(row[prefix + "rows"], row[prefix + "width"])


def _pack_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            ids, labels = (np.array(part.column(c)) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_pylist([_packed(ids, labels, _matrix(part.column("vector").to_pylist()))], pa.schema(_schema(BLOCK)))


def _schema(ddl: str) -> list[pa.Field]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))]


def _directions(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and lengths; a zero row stays zero."""
    matrix = matrix.astype(np.float64)
    length = np.sqrt((matrix * matrix).sum(1))
    return matrix / np.where(length > 0, length, 1)[:, None], length


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def fit_centres(anchors: DataFrame, rows: int, most: int = CENTRES, sample: int = FIT_ROWS) -> np.ndarray:
    """Unit centres by a few spherical k-means steps on at most ``sample`` anchors in hash order; ``rows`` is the number of anchors."""
    seen = anchors.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    units, _ = _directions(_matrix([r.vector for r in seen]))
    centres = units[: max(1, min(most, len(units), -(-rows // PART_ROWS)))].copy()
    for _ in range(8 if len(units) else 0):
        near = np.argmax(units @ centres.T, axis=1)
        for k in range(len(centres)):
            mean = units[near == k].sum(0)
            if (size := np.sqrt(mean @ mean)) > 0:
                centres[k] = mean / size
    return centres


def _parts(anchors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Anchors packed into parts of one cluster, by their angle to its centre, so that a part is a shell."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("vector").to_pylist())
            width = max(matrix.shape[1], centres.shape[1])
            cosines = _directions(_wide(matrix, width))[0] @ _wide(centres, width).T
            best = np.argmax(cosines, axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(-cosines[np.arange(len(best)), best])], [*batch.schema.names, "cluster", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made():
            ids, labels = (np.array([r[c] for r in held], np.int64) for c in ("vec_id", "label"))
            matrix = _matrix([r["vector"] for r in held])
            units, _ = _directions(matrix)
            centre = units.sum(0)
            centre = centre / size if (size := np.sqrt(centre @ centre)) > 0 else centre
            radius = float(np.arccos(np.clip(units @ centre, -1, 1)).max()) if size > 0 and (matrix != 0).any(1).all() else np.pi
            return pa.RecordBatch.from_pylist([{"part": f"{held[0]['cluster']}:{ids[0]}", "radius": radius, "centre": centre.tobytes()} | _packed(ids, labels, matrix)], pa.schema(_schema(PART)))

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == PART_ROWS or row["cluster"] != held[0]["cluster"]):
                    yield made()
                    held.clear()
                held.append(row)
        if held:
            yield made()

    dealt = materialise(anchors.mapInArrow(near, "vec_id long, label long, vector array<long>, cluster long, far double"), "dealt")
    return dealt.repartitionByRange("cluster", "far", "vec_id").sortWithinPartitions("cluster", "far", "vec_id").mapInArrow(pack, PART)


class Best:
    """The best ``keep`` rows per slot seen so far, by score and then by smaller vec_id."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.count = np.zeros(slots, np.int64)
        self.score = np.zeros((slots, keep), object)
        self.ids = np.zeros((slots, keep), np.int64)
        self.floor = np.full(slots, -np.inf)  # the score that a further row must reach

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows (slot, score, id) join; scores are integers."""
        for s in np.unique(slot):
            here = slot == s
            n = self.count[s]
            scores, names = np.concatenate([self.score[s, :n].astype(np.int64), score[here]]), np.concatenate([self.ids[s, :n], ids[here]])
            order = np.lexsort((names, -scores))[: self.keep]
            self.count[s] = len(order)
            self.score[s, : len(order)], self.ids[s, : len(order)] = scores[order], names[order]
            if len(order) == self.keep:
                self.floor[s] = max(self.floor[s], float(scores[order[-1]]))

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for s in range(len(self.count)):
            for i in range(self.count[s]):
                yield s, int(self.ids[s, i]), int(self.score[s, i])


def _products(members: np.ndarray, candidates: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products of all rows, in doubles where these are exact and else in longs."""
    if exact:
        return members.astype(np.float64) @ candidates.astype(np.float64).T
    return members.astype(np.int64) @ candidates.astype(np.int64).T


def walk(row: dict, hits, need) -> None:
    """One cluster part and one block of candidates: sort the block by the part's bound, let every member walk the list.

    ``need()`` gives, per member, the score below which nothing matters to it; ``hits(members, scores, ids, labels)`` takes the scores of
    one step of the list for the members still walking.
    """
    ids, labels, candidates = _unpacked(row)
    _, _, members = _unpacked(row, "a_")
    centre = np.frombuffer(row["a_centre"])
    width = max(candidates.shape[1], members.shape[1], len(centre))
    candidates, members, centre = _wide(candidates, width), _wide(members, width), _wide(centre[None], width)[0]
    units, lengths = _directions(candidates)
    sizes = _directions(members)[1]
    angle = np.arccos(np.clip(units @ centre, -1, 1))
    bound = lengths * np.minimum(1, np.cos(np.maximum(0, angle - row["a_radius"])) + SLACK)  # per unit of the member's length
    order = np.argsort(-bound, kind="stable")
    exact = lengths.max(initial=0) * sizes.max(initial=0) * (1 + SLACK) < EXACT
    active = np.arange(len(members))
    for start in range(0, len(order), STEP):
        most = bound[order[start]]
        active = active[sizes[active] * most + SLACK * (1 + sizes[active] * abs(most)) >= need()[active]]
        if not len(active):
            break  # certified for all: nothing further down can score as much as they need
        step = order[start : start + STEP]
        hits(active, _products(members[active], candidates[step], exact), ids[step], labels[step])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _find_positives(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Best] = {}
        anchors: dict[str, np.ndarray] = {}
        for row in _pairs(batches):
            names, marks, _ = _unpacked(row, "a_")
            best = found.setdefault(row["a_part"], Best(len(names), keep))
            anchors[row["a_part"]] = names

            def hits(active, scores, ids, labels, best=best, names=names, marks=marks):
                good = (labels == marks[active][:, None]) & (ids != names[active][:, None]) & (scores >= best.floor[active][:, None])
                who, what = np.nonzero(good)
                best.add(active[who], scores[who, what].astype(np.int64), ids[what])

            walk(row, hits, lambda best=best: best.floor)
        for part, best in found.items():
            rows = [(int(anchors[part][s]), i, score) for s, i, score in best.rows()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64"), preserve_index=False)

    return run


def _find_negatives(keep: int, low: int, high: int):
    """Per anchor and positive the best ``keep`` rows of other labels with low * positive <= 100 * score <= high * positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[Best, np.ndarray]] = {}
        for row in _pairs(batches):
            _, marks, _ = _unpacked(row, "a_")
            caps = [[(int(p["positive_id"]), int(p["positive_score"])) for p in own] for own in row["a_caps"]]
            slots = [(m, p, s) for m, own in enumerate(caps) for p, s in own]
            member = np.array([m for m, _, _ in slots], np.int64)
            top = np.array([high * s // 100 for _, _, s in slots], np.int64)
            bottom = np.array([-(-low * s // 100) for _, _, s in slots], np.int64)
            if row["a_part"] not in found:
                best = Best(len(slots), keep)
                best.floor[:] = np.where(bottom <= top, bottom, np.inf)  # an empty range needs nothing
                names = _unpacked(row, "a_")[0]
                found[row["a_part"]] = best, np.array([(names[m], p, s) for m, p, s in slots], np.int64).reshape(-1, 3)
            best = found[row["a_part"]][0]

            def need(best=best, member=member, count=len(marks)):
                least = np.full(count, np.inf)
                np.minimum.at(least, member, best.floor)
                return least

            def hits(active, scores, ids, labels, best=best, member=member, top=top, marks=marks):
                place = np.full(len(marks), -1)
                place[active] = np.arange(len(active))
                for nth in range(max(map(len, caps), default=0)):
                    which = np.array([i for i in starts[nth] if place[member[i]] >= 0], np.int64)
                    if not len(which):
                        continue
                    mine = scores[place[member[which]]]
                    good = (labels != marks[member[which]][:, None]) & (mine <= top[which][:, None]) & (mine >= best.floor[which][:, None])
                    who, what = np.nonzero(good)
                    best.add(which[who], mine[who, what].astype(np.int64), ids[what])

            starts: list[list[int]] = [[] for _ in range(max(map(len, caps), default=0))]
            at = 0
            for own in caps:
                for nth in range(len(own)):
                    starts[nth].append(at + nth)
                at += len(own)
            walk(row, hits, need)
        for best, slots in found.values():
            rows = [(*map(int, slots[s]), i, score) for s, i, score in best.rows()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64"), preserve_index=False)

    return run


def _meet(blocks: DataFrame, parts: DataFrame, run, schema: str, group_parts: int) -> DataFrame:
    """Rows that ``run`` makes of all (block, part): one pass over the blocks, which stay where they are, per group of parts.

    A group holds at most ``group_parts`` parts of at most PART_ROWS anchors, which bounds what is broadcast.
    """
    number = F.row_number().over(W.orderBy("part")) - 1
    numbers = parts.select("part", F.expr("1").alias("one")).select("part", F.floor(number / group_parts).alias("group"))
    grouped = materialise(parts.join(numbers, "part").select("group", *[F.col(c).alias(f"a_{c}") for c in parts.columns]), "groups")
    passes = (grouped.agg(F.max("group")).first()[0] or 0) + 1
    out = None
    for i in range(passes):
        own = F.broadcast(grouped.filter(F.col("group") == i))
        held = blocks.withColumn("group", F.explode(F.array(F.lit(i).cast("bigint"))))
        made = held.join(own, "group").drop("group").mapInArrow(run, schema)
        made = materialise(made, "met")
        out = made if out is None else out.unionAll(made)
    return out


def _first(rows: DataFrame, by: list[str], score: str, name: str, keep: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), name))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= keep)


def mine(embeddings: DataFrame, label: Column | None = None, every: int = 100, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, group_parts: int = GROUP_PARTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``embeddings`` (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by ``every``; scores are products of the vectors, scaled and floored to integers.  Each
    anchor has its ``positives`` best other rows of its label; each of these has the ``negatives`` best rows of other labels between
    ``low`` and ``high`` percent of its score.  Ties go to the smaller vec_id.

    Rows with a null vec_id, label or vector, with a null or non-finite component, or with an integer vector of length 2^31 or more take no
    part.  Of several rows with one vec_id the smallest (label, vector) counts.  A shorter vector goes on with zeros; zero vectors score 0.
    An empty table, or one without anchors, gives no rows.
    """
    rows = materialise(integer_rows(embeddings, F.col("label") if label is None else label, scale), "integers")
    blocks = materialise(rows.mapInArrow(_pack_block, BLOCK), "blocks")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    shape = "anchor_id long, positive_id long, positive_score long"
    parts = materialise(_parts(anchors, fit_centres(anchors, anchors.count())), "parts")
    near = _first(_meet(blocks, parts, _find_positives(positives), shape, group_parts), ["anchor_id"], "positive_score", "positive_id", positives)
    caps = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("caps"))

    shape += ", negative_id long, negative_score long"
    found = _meet(blocks, _with_caps(parts, materialise(caps, "caps")), _find_negatives(negatives, low, high), shape, group_parts)
    best = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _with_caps(parts: DataFrame, caps: DataFrame) -> DataFrame:
    """Parts with one list of (positive_id, positive_score) per member, in the members' order."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = np.frombuffer(row["vec_ids"], "<i8")
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(names)), "place": pa.array(range(len(names)), pa.int64()), "anchor_id": pa.array(names)})

    places = parts.select("part", "vec_ids").mapInArrow(ids, "part string, place long, anchor_id long")
    own = places.join(caps, "anchor_id", "left").select("part", "place", F.coalesce("caps", F.array().cast(caps.schema["caps"].dataType)).alias("caps"))
    lists = own.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "caps"))).alias("all"))
    return parts.join(lists.select("part", F.transform("all", lambda x: x["caps"]).alias("caps")), "part")


def shifted_label() -> Column:
    """The label, one further (mod 10) where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


SQL = """
WITH one AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM one a JOIN one c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank,
    s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
