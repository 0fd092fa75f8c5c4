"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link if they differ in at most RADIUS of 64 bits.  The bits are dealt to PARTS parts, correlated ones together.  If
thresholds of the parts add up to RADIUS - PARTS + 1 (-1 leaves a part out), two linked fingerprints are within the threshold in
some part.  Every fingerprint chooses its thresholds by dynamic programming on the candidates that they would bring, probes all
values within the threshold of its own, and verifies the whole fingerprint.

Equal fingerprints are one class from the start.  Where a crowd of similar fingerprints leaves no cheap choice, its members link
exactly through the values at distance one: two fingerprints within distance 2 share such a value, so hanging every member on the
smallest one at each value gives all links' components without forming pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.llm.common import slices, text_bytes
from skyledger.llm.components import components
from skyledger.session import materialise

SHINGLE = 3
RADIUS = 2
PARTS = 3
BITS = 64
SEED = 42
#: A fingerprint whose probes would meet more candidates than this links through the values at distance one.
CROWD = 256

SLICE_BYTES = 2_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    words = text.translate(_FOLD).split() if text else []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    past = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *past[: len(words) - size].tolist()]
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], SEED) for a, b in zip(starts, (past[size - 1 :] - 1).tolist())]


def fingerprints_of(texts: list[bytes | None], size: int) -> np.ndarray:
    """Bit by bit whether more than half of a text's shingle hashes have it."""
    hashes = [shingle_hashes(t, size) for t in texts]
    n = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(n.sum()))
    some = n > 0
    out = np.zeros(len(texts), np.uint64)
    if some.any():
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, version, fp of every row: the fingerprint as a signed long, and a hash that tells texts with one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in slices([len(t) if t else 0 for t in texts], SLICE_BYTES):
                part = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "version")]
                yield pa.RecordBatch.from_arrays([*part, pa.array(fingerprints_of(texts[lo:hi], size).view(np.int64))], names=["doc_id", "version", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, "doc_id bigint, version bigint, fp bigint")


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of nearly equal size, each grown from its most correlated free bit."""
    strength = np.abs(np.nan_to_num(correlation))
    np.fill_diagonal(strength, 0)
    free, out = list(range(len(strength))), []
    for k in range(parts):
        room = len(strength) // parts + (k < len(strength) % parts)
        part = [max(free, key=lambda b: (strength[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < room:
            nearest = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(nearest)
            free.remove(nearest)
        out.append(sorted(part))
    return out


def bit_parts(classes: DataFrame, parts: int) -> list[list[int]]:
    """The parts from the correlation of the bits over all classes; tasks send 65 x 64 sums each, which Spark adds up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS + 1, BITS))
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fps), 100_000):
                block = np.ascontiguousarray(fps[lo : lo + 100_000])
                sign = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1
                both[:BITS] += sign.T @ sign
                both[BITS] += sign.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.size)), pa.array(both.ravel())], names=["cell", "v"])

    rows = classes.select("fp").mapInArrow(sums, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    both = np.zeros((BITS + 1) * BITS)
    for r in rows:
        both[r.cell] = r.v
    both = both.reshape(BITS + 1, BITS)
    n = max(1.0, both[0, 0])
    mean = both[BITS] / n
    spread = np.sqrt(np.maximum(1 - mean**2, 1e-12))
    return group_bits((both[:BITS] / n - np.outer(mean, mean)) / np.outer(spread, spread), parts)


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> b) & 1) << k
    return out


def balls(width: int, radius: int) -> list[np.ndarray]:
    """Masks that turn a value into those at distance 0, 1, ... radius."""
    return [np.array([sum(1 << b for b in flips) for flips in itertools.combinations(range(width), r)], np.int64) for r in range(radius + 1)]


def allocate(counts: np.ndarray, widths: list[int], classes: int, radius: int) -> np.ndarray:
    """Thresholds per row and part with the least estimated work, by dynamic programming over parts.

    ``counts`` says how many classes share a row's value in each part.  A threshold t is charged for its probes and for the classes they
    would meet: those of the own value, and the mean of all possible values for the others.
    """
    rows, parts = counts.shape
    total = radius - parts + 1
    low, high = -parts, radius
    best = np.full((rows, high - low + 1), np.inf)
    best[:, -low] = 0
    choices = []
    for k, width in enumerate(widths):
        mean = classes / 2.0**width
        cost = [np.zeros(rows)]
        probes = 1.0
        for t in range(radius + 1):
            cost.append(counts[:, k] + probes + (probes - 1) * mean)
            probes += len(list(itertools.combinations(range(width), t + 1)))
        following = np.full_like(best, np.inf)
        choice = np.zeros(best.shape, np.int8)
        for t in range(-1, radius + 1):
            for s in range(best.shape[1]):
                if 0 <= s + t < best.shape[1]:
                    value = best[:, s] + cost[t + 1]
                    better = value < following[:, s + t]
                    following[better, s + t] = value[better]
                    choice[better, s + t] = t
        choices.append(choice)
        best = following
    out, at = np.empty((rows, parts), np.int64), np.full(rows, total - low)
    for k in range(parts - 1, -1, -1):
        out[:, k] = choices[k][np.arange(rows), at]
        at -= out[:, k]
    return out


def links(classes: DataFrame, radius: int = RADIUS, parts: int = PARTS, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``classes`` (fp) within ``radius`` bits; crowds as stars with the same components."""
    if radius != 2:
        raise ValueError("the links of crowds are exact for a radius of 2")
    bits = bit_parts(classes, parts)
    widths = [len(b) for b in bits]
    total = classes.count()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for k, own in enumerate(bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int32)), pa.array(part_values(fps, own)), batch.column("fp")], names=["part", "value", "fp"])

    index = classes.select("fp").mapInArrow(split, "part int, value bigint, fp bigint")
    sizes = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    index = materialise(index.join(sizes, ["part", "value"]), "index")
    own = [F.max(F.when(F.col("part") == k, F.col("n"))).alias(f"n{k}") for k in range(parts)]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [[np.concatenate(balls(w, t)[: t + 1]) for t in range(radius + 1)] for w in widths]
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            counts = np.stack([batch.column(f"n{k}").to_numpy(zero_copy_only=False) for k in range(parts)], 1).astype(float)
            chosen = allocate(counts, widths, total, radius)
            for k, own_bits in enumerate(bits):
                value = part_values(fps, own_bits)
                for t in range(radius + 1):
                    some = np.flatnonzero(chosen[:, k] == t)
                    for lo in range(0, len(some), 10_000):
                        here = some[lo : lo + 10_000]
                        near = (value[here, None] ^ masks[k][t][None, :]).ravel()
                        who = np.repeat(fps[here], len(masks[k][t]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), k, np.int32)), pa.array(near), pa.array(who)], names=["part", "value", "fp"])

    probes = index.groupBy("fp").agg(*own).mapInArrow(probe, "part int, value bigint, fp bigint")
    filled = index.groupBy("part", "value").agg(F.first("n").alias("n"))
    probes = materialise(probes.join(filled, ["part", "value"]), "probes")  # those that meet anything
    crowded = materialise(probes.groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") > crowd).select("fp"), "crowded")
    calm = probes.join(crowded, "fp", "left_anti").select("part", "value", F.col("fp").alias("a"))
    # no calm fingerprint probes a value that more than ``crowd`` share
    shared = index.filter((F.col("n") <= crowd)).select("part", "value", F.col("fp").alias("b"))
    near = calm.join(shared, ["part", "value"]).filter("a != b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")

    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("bigint") for b in range(BITS)])
    spread = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("z"))
    heads = spread.groupBy("z").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).filter("b < most").drop("most")
    stars = spread.join(heads, "z").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return near.unionAll(stars)


def classified(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, fp of all rows; fp, root of all fingerprints, where linked ones have one root)"""
    prints = materialise(fingerprints(docs, size), "prints")
    classes = materialise(prints.select("fp").distinct(), "classes")
    roots = components(links(classes, radius)).withColumnRenamed("node", "fp")
    return prints, classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text; other columns ignored).

    Texts without words have fingerprint zero and link like any other.  component_id is the smallest doc_id reachable over links; rows
    with a null doc_id link too but give no id, so it is null where all are null.  Repeated doc_ids are rows of their own.  An empty
    table gives no rows.
    """
    prints, roots = classified(docs, size, radius)
    roots = materialise(roots, "roots")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    ids = roots.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of every group of near-duplicates, with all columns: that of the smallest doc_id (nulls last, then by a hash of the text)."""
    prints, roots = classified(docs, size, radius)
    named = prints.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version").alias("row"), "fp")
    best = named.groupBy("fp").agg(F.min("row").alias("row")).join(roots, "fp").groupBy("root").agg(F.min("row").alias("row"))
    # keys without nulls, under names that no table has
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("version")]
    kept = best.select("row.doc_id", "row.version").select(*[c.alias(f"__keep_{i}") for i, c in enumerate(key)])
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), key[0].alias("__keep_0"), F.xxhash64("text").alias("__keep_1")]
    found = docs.select(*whole).join(kept, ["__keep_0", "__keep_1"], "left_semi")
    one = found.groupBy("__keep_0", "__keep_1").agg(F.first("__row").alias("__row"))  # of fully equal rows one stays
    return one.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
