"""Prefix trie of conversations by SQL ROLLUP over positional turn-id columns.

A turn is known by a 128-bit id of its role and whole text.  Conversations are laid out in blocks of ``WIDTH`` turn-id columns; one
``GROUP BY block, prior, ROLLUP (t1, ..., t8)`` aggregates all prefixes together, and ``grouping_id`` tells how long each is.  A long
conversation continues in further blocks keyed by ``prior``, the key of the node that the block before it ended in, so its length needs
neither more columns nor rounds.  A node's key is its depth and the exclusive or of two 64-bit hashes of (position, turn id) over its path.

Sums over subtrees come out of the same ROLLUP, as sums over a node's members.  The nodes whose smallest member is c are the end of c's
path, from some depth on; c carries the text length and the leaf it so owns, and a node adds up what its members own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.session import materialise

#: Turn-id columns per block.
WIDTH = 8
#: Turns, and blocks, that one window task numbers or adds up; longer conversations take several.
SEGMENT = 512
#: Ids in one piece of a list that is hashed.
PIECE = 4096
#: Conversations in a family that share first turns, and the number of lengths a shared start can have.
FAMILY = 100
LENGTHS = 6

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, a, b, chars: every turn with its place from 1 (by turn, null first), its 128-bit id and the code points of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    segment = F.coalesce(F.expr(f"turn div {SEGMENT}"), F.lit(-(1 << 63)))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("id"), F.char_length(text).cast("bigint").alias("chars"), segment.alias("segment")
    )
    rows = materialise(rows, "turns")
    sizes = rows.groupBy("conv_id", "segment").agg(F.count("*").alias("n"))
    starts = sizes.select("conv_id", "segment", (F.sum("n").over(W.partitionBy("conv_id").orderBy("segment")) - F.col("n")).alias("start"))
    inside = F.row_number().over(W.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_first(), "id"))
    placed = rows.withColumn("inside", inside).join(starts, ["conv_id", "segment"])
    return placed.select("conv_id", (F.col("start") + F.col("inside")).alias("pos"), F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), "chars")


def rebuild(turns: DataFrame, family: int = FAMILY, lengths: int = LENGTHS) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of the rebuilt conversations.

    Conversation c gets the first h turns of conversation c - c % ``family`` and then its own after its first h, h = crc32(c) % ``lengths``.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % lengths
    own = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("family"), h.alias("h"))
    heads = sizes.filter(f"conv_id % {family} = 0").select(F.col("conv_id").alias("family"), F.col("n").alias("head"))
    own = own.join(heads, "family", "left").select("conv_id", "family", "h", F.least("h", F.coalesce("head", F.lit(0))).alias("taken"))
    own = materialise(own, "members")
    starts = turns.filter(f"conv_id % {family} = 0 AND pos < {lengths}").withColumnRenamed("conv_id", "family")
    shared = own.join(starts, "family").filter("pos <= taken").select("conv_id", "pos", "a", "b", "chars")
    rest = turns.join(own, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "chars")
    return shared.unionAll(rest), own.select("conv_id")


def _marks(pos: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at its place."""
    return F.xxhash64(pos, a, b), F.xxhash64(a, b, pos, F.lit(2))


def _xor(*columns: Column) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def lay_out(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (conv_id, block, p1, p2, before, t1, ...) and whole conversations (conv_id, len, total, x1, x2); both written.

    p1, p2: the key of the node before the block; before: the code points up to there.
    """
    slot, (m1, m2) = F.col("pos") - 1, _marks(F.col("pos"), F.col("a"), F.col("b"))
    slots = turns.select("*", F.expr(f"(pos - 1) div {WIDTH}").alias("block"), (slot % WIDTH).alias("slot"), m1.alias("m1"), m2.alias("m2"))
    cells = [F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}{i + 1}") for i in range(WIDTH) for c in ("a", "b", "chars")]
    wide = slots.groupBy("conv_id", "block").agg(*cells, F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"), F.sum("chars").alias("chars"), F.count("*").alias("n"))
    turn = lambda i: F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"chars{i}").alias("chars")))
    wide = wide.select("conv_id", "block", F.expr(f"block div {SEGMENT}").alias("segment"), "m1", "m2", "chars", "n", *[turn(i).alias(f"t{i}") for i in range(1, WIDTH + 1)])
    wide = materialise(wide, "wide")

    sums = wide.groupBy("conv_id", "segment").agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"), F.sum("chars").alias("s"), F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    over = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("conv_id", "segment", zero(F.bit_xor("s1").over(over)).alias("q1"), zero(F.bit_xor("s2").over(over)).alias("q2"), zero(F.sum("s").over(over)).alias("q"))
    inside = W.partitionBy("conv_id", "segment").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ran = wide.select("*", zero(F.bit_xor("m1").over(inside)).alias("r1"), zero(F.bit_xor("m2").over(inside)).alias("r2"), zero(F.sum("chars").over(inside)).alias("r"))
    names = [f"t{i}" for i in range(1, WIDTH + 1)]
    blocks = ran.join(starts, ["conv_id", "segment"]).select("conv_id", "block", F.col("q1").bitwiseXOR(F.col("r1")).alias("p1"), F.col("q2").bitwiseXOR(F.col("r2")).alias("p2"), (F.col("q") + F.col("r")).alias("before"), *names)

    ends = sums.groupBy("conv_id").agg(F.sum("n").alias("len"), F.sum("s").alias("total"), F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"))
    whole = members.join(ends, "conv_id", "left").select("conv_id", *[zero(F.col(c)).alias(c) for c in ("len", "total", "x1", "x2")])
    whole = materialise(whole, "whole")
    empty = {"block": "0L", "p1": "0L", "p2": "0L", "before": "0L"}
    types = dict(blocks.dtypes)
    turnless = whole.filter("len = 0").select("conv_id", *[F.expr(v).alias(k) for k, v in empty.items()], *[F.lit(None).cast(types[t]).alias(t) for t in names])
    return materialise(blocks.unionAll(turnless), "blocks"), whole


def roll_up(blocks: DataFrame, values: dict[str, str]) -> DataFrame:
    """One row per node: depth, key (x1, x2), key of its parent (y1, y2), chars of its turn, chars before it, and ``values``.

    values: aggregate per result name ('min', 'max' or 'sum' of the column of that name).  Equal blocks are made one before the ROLLUP.
    """
    names = [f"t{i}" for i in range(1, WIDTH + 1)]
    by = ["block", "p1", "p2", "before"]
    same = blocks.groupBy(*by, *names).agg(*[F.expr(f"{f}({c})").alias(c) for c, f in values.items()])
    rolled = blocks.sparkSession.sql(
        f"SELECT {', '.join(by + names)}, {WIDTH} - bit_count(grouping_id()) AS level, {', '.join(f'{f}({c}) AS {c}' for c, f in values.items())} "
        f"FROM {{same}} GROUP BY {', '.join(by)}, ROLLUP ({', '.join(names)})",
        same=same,
    )
    last = F.element_at(F.array(*names), F.greatest("level", F.lit(1)))
    # the empty prefix of a block is the root or was the last node of the block before; a prefix that ends in an absent turn is none
    nodes = rolled.select("*", last.alias("last")).filter("CASE WHEN level = 0 THEN block = 0 ELSE last IS NOT NULL END")
    depth = F.col("block") * WIDTH
    marks = [_marks(depth + i, F.col(f"t{i}.a"), F.col(f"t{i}.b")) for i in range(1, WIDTH + 1)]
    upto = lambda k, most: _xor(F.col(f"p{k + 1}"), *[F.when(F.lit(i) <= most, marks[i - 1][k]).otherwise(0) for i in range(1, WIDTH + 1)])
    level, above = F.col("level"), F.col("level") - 1
    before = F.col("before") + sum((F.when(F.lit(i) < level, F.col(f"t{i}.chars")).otherwise(0) for i in range(1, WIDTH)), F.lit(0))
    return nodes.select(
        (depth + level).alias("depth"),
        *[upto(k, level).alias(f"x{k + 1}") for k in (0, 1)],
        *[upto(k, above).alias(f"y{k + 1}") for k in (0, 1)],
        F.when(level > 0, F.col("last.chars")).otherwise(0).alias("chars"),
        before.alias("before"),
        *values,
    )


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per (conv_id, depth) of its pieces, which come in order; only the hash's state is held."""
    at, state = None, None

    def made(rows):
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "depth": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})

    for batch in batches:
        rows = []
        for conv_id, depth, piece in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "depth", "piece")]):
            if (conv_id, depth) != at:
                if at:
                    rows.append((*at, state.hexdigest()))
                at, state = (conv_id, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield made(rows)
    if at:
        yield made([(*at, state.hexdigest())])


def hash_ends(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 from (conv_id, depth, member): the members in numeric order, joined by commas, as SHA-256.

    Members are first joined in pieces of ``PIECE`` neighbouring ids, so a list of any length reaches its hash as a few rows.
    """
    ids = F.transform(F.array_sort(F.collect_list("member")), lambda i: i.cast("string"))
    pieces = ends.groupBy("conv_id", "depth", F.expr(f"member div {PIECE}").alias("part")).agg(F.array_join(ids, ",").alias("piece"))
    ordered = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    return ordered.mapInArrow(_hash_lists, "conv_id bigint, depth bigint, ends_sha256 string")


def nodes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The trie's nodes, ``COLUMNS``, of conversations ``members`` (conv_id) with ``turns`` (conv_id, pos, a, b, chars)."""
    blocks, whole = lay_out(turns, members)
    first = blocks.join(whole.select("conv_id", "len"), "conv_id")
    first = materialise(roll_up(first, {"conv_id": "min", "len": "max"}), "nodes")

    owners = first.groupBy("conv_id").agg(
        F.min("depth").alias("own"), F.sum("chars").alias("owned"), F.max(F.when(F.col("len") == F.col("depth"), 1).otherwise(0)).alias("leaf"), F.min_by(F.struct("y1", "y2"), "depth").alias("y")
    )
    owners = materialise(owners, "owners")
    # the nodes where owned paths branch off, and those where conversations end
    branches = owners.filter("own > 0").select(F.col("conv_id").alias("member"), F.lit(True).alias("branch"), (F.col("own") - 1).alias("depth"), F.col("y.y1").alias("x1"), F.col("y.y2").alias("x2"))
    ends = whole.select(F.col("conv_id").alias("member"), F.lit(False), F.col("len"), "x1", "x2")
    found = materialise(branches.unionAll(ends).join(first.select("conv_id", "depth", "x1", "x2"), ["depth", "x1", "x2"]).select("conv_id", "depth", "member", "branch"), "found")
    parents = found.filter("branch").select(F.col("member").alias("conv_id"), F.col("conv_id").alias("parent"))
    children = found.filter("branch").groupBy("conv_id", "depth").agg(F.count("*").alias("branches"))
    digests = hash_ends(found.filter("NOT branch"))

    stats = whole.join(owners.drop("y"), "conv_id", "left").select("conv_id", "len", "total", "own", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("owned", "leaf")])
    stats = materialise(stats, "stats")
    second = blocks.join(stats.select("conv_id", "total", "owned", F.col("leaf").cast("bigint").alias("leaf"), F.lit(1).cast("bigint").alias("n")), "conv_id")
    second = roll_up(second, {"conv_id": "min", "n": "sum", "total": "sum", "owned": "sum", "leaf": "sum"})

    mine = stats.join(parents, "conv_id", "left").select("conv_id", "len", "own", "parent", F.col("owned").alias("my_owned"), F.col("total").alias("my_total"))
    out = second.join(mine, "conv_id").join(children, ["conv_id", "depth"], "left").join(digests, ["conv_id", "depth"], "left")
    below = F.col("owned") - F.col("my_owned") + F.col("my_total") - F.col("before")  # code points of all nodes of the subtree
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("own"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.when(F.col("len") > F.col("depth"), 1).otherwise(0) + F.coalesce("branches", F.lit(0))).cast("bigint").alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        (F.col("total") - F.col("n") * F.col("before") - below).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text; other columns ignored) as they are: ``COLUMNS`` per node.

    Turns go by turn, null first, ties by the SHA-256 of role and text; repeated rows are turns of their own.  A null role or text is an
    empty one.  Rows without a conv_id belong to no conversation and take no part.  An empty table has no nodes, not even a root.
    """
    turns = materialise(number_turns(conversations), "numbered")
    return nodes(turns, turns.select("conv_id").distinct())


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations of :func:`rebuild`; odd rows as in :func:`prefix_trie`.

    A family without its first conversation shares nothing.  A conversation of which nothing is left is a member of the root alone.
    """
    return nodes(*rebuild(materialise(number_turns(conversations), "numbered")))


SQL = f"""
WITH RECURSIVE bytes AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
ids AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, s, 1 AS i, CAST(4294967295 AS BIGINT) AS c FROM ids
  UNION ALL
  SELECT conv_id, s, i + 1, xor(c >> 8, t[xor(c & 255, ascii(substr(s, i, 1))) + 1]) FROM crc, bytes WHERE i <= length(s)),
heads AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS family, xor(c, 4294967295) % {LENGTHS} AS h FROM crc WHERE i = length(s) + 1),
named AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS p FROM named),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
rebuilt AS (
  SELECT h.conv_id, o.p, o.id, o.chars FROM heads h JOIN own o ON o.conv_id = h.family AND o.p <= h.h
  UNION ALL
  SELECT h.conv_id, o.p + 1000000, o.id, o.chars FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.p > h.h),
paths AS (
  SELECT h.conv_id, string_agg(r.id, '' ORDER BY r.p) AS path, list(r.chars ORDER BY r.p) AS chars, count(r.p) AS len
  FROM heads h LEFT JOIN rebuilt r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
prefixes AS (
  SELECT conv_id, len, d, coalesce(substr(path, 1, 64 * d), '') AS id, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars
  FROM (SELECT *, unnest(range(len + 1)) AS d FROM paths)),
nodes AS (
  SELECT d, id, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, max(len) = d AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends
  FROM prefixes GROUP BY d, id),
children AS (SELECT d - 1 AS d, substr(id, 1, 64 * (d - 1)) AS id, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
below AS (
  SELECT a AS d, substr(id, 1, 64 * a) AS id, sum((n - 1) * chars) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM nodes) GROUP BY 1, 2)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN below b ON b.d = v.d AND b.id = v.id LEFT JOIN children c ON c.d = v.d AND c.id = v.id
LEFT JOIN nodes p ON p.d = v.d - 1 AND p.id = substr(v.id, 1, 64 * (v.d - 1))
"""
