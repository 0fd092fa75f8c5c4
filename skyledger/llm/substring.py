"""Substring deduplication by seed and extend on winnowed anchors.

A window is LENGTH consecutive words.  Of its k-word grams the one with the lowest hash is its anchor, so equal windows have equal
anchors, and neighbouring windows mostly share one.  An anchor's occurrence stands for the windows it was chosen by; its extent is
the text they span.  Documents meet on their anchors:

* All occurrences of an anchor have the same extent: the smallest doc_id owns it, the others repeat all of it.
* Extents differ (a copy ends or was edited here): occurrences with equal extents settle among themselves as above.  Of each
  kind of extent only the owner's windows are compared one by one, by hash, which cuts the matches at the exact word.

No pair of documents is formed; a passage shared by a third of the corpus costs one row per document and anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.llm.common import slices, text_bytes
from skyledger.session import materialise

LENGTH = 50
GRAM = 18
SLICE_BYTES = 4_000_000

# A mark is one long: 23 bits of the text's hash, 34 bits of the first window's place, 6 bits for the number of windows less 1.
_VERSION_SHIFT, _COUNT_BITS = 40, 6
_MOST_WINDOWS = 1 << _COUNT_BITS

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses modulo 2 ** 64


def version(text: Column) -> Column:
    """Tells texts apart that share a doc_id."""
    return F.xxhash64(text).bitwiseAND((1 << 23) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """Words of several texts as hashes in a row, with hashes of any range from prefix sums."""

    def __init__(self, texts: pa.Array):
        trimmed = pc.ascii_trim_whitespace(texts.cast(pa.string()).fill_null(""))
        split = pc.ascii_split_whitespace(trimmed)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        counts[pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0] = 0
        flat = split.flatten()
        coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.hash = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.uint64)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ranges(self, start: np.ndarray, past: np.ndarray, base: int = 0) -> np.ndarray:
        """A hash of the words [start, past), wherever they stand."""
        if base not in self.sums:
            n = len(self.hash)
            power, inverse = (np.full(n + 1, b % (1 << 64), np.uint64) for b in (_BASES[base], pow(_BASES[base], -1, 1 << 64)))
            power[0] = inverse[0] = 1
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            self.sums[base] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * power[:-1], dtype=np.uint64)]), inverse
        total, inverse = self.sums[base]
        return _mixed((total[past] - total[start]) * inverse[start])

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """(document, anchor hash, extent hash, first window's place in the document, number of windows) per occurrence."""
        n = len(self.hash)
        if n < length:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        first = np.arange(n - gram + 1)
        grams = self.ranges(first, first + gram)
        doc = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        at = np.arange(n - length + 1)
        window = at[at + length <= self.ends[doc[at]]]
        choice = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).argmin(1)[window] + window
        runs = np.flatnonzero(np.diff(choice, prepend=-1))
        # a long run is several occurrences of its anchor, so that each one's number of windows fits its mark
        pieces = -(-np.diff(runs, append=len(window)) // _MOST_WINDOWS)
        runs = np.repeat(runs, pieces) + _MOST_WINDOWS * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.diff(runs, append=len(window))
        start, anchor = window[runs], choice[runs]
        extent = self.ranges(start, start + size - 1 + length, 1) ^ _mixed((anchor - start).astype(np.uint64) + np.uint64(1))
        d = doc[start]
        return d, grams[anchor], extent, start - self.starts[d], size


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).fill_null(0).to_pylist()
        for lo, hi in slices(sizes, SLICE_BYTES):
            yield batch.slice(lo, hi - lo)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, extent, doc_id, mark: one row per occurrence of an anchor; rows without doc_id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            d, anchor, extent, place, size = Words(batch.column("text")).anchors(length, gram)
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "version"))
            mark = (versions[d] << _VERSION_SHIFT) | (place << _COUNT_BITS) | (size - 1)
            yield pa.RecordBatch.from_arrays([_long(anchor), _long(extent), pa.array(ids[d]), pa.array(mark)], names=["anchor", "extent", "doc_id", "mark"])

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", version(F.col("text")).alias("version"), "text")
    return rows.mapInArrow(run, "anchor bigint, extent bigint, doc_id bigint, mark bigint")


def marks(seeds: DataFrame) -> DataFrame:
    """doc_id, mark, whole: occurrences that repeat a smaller doc_id's as a whole, and owners whose windows are to be compared."""
    kinds = seeds.groupBy("anchor", "extent").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    kinds = materialise(kinds, "kinds")
    met = kinds.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("extents")).filter("n > 1")
    # what is known of an anchor and extent is settled in tables of one row each, so seeds meet it once and a very common one can be split
    known = kinds.drop("n").join(met.select("anchor", "extents"), "anchor")
    met = seeds.join(materialise(known, "met"), ["anchor", "extent"])
    return met.filter("extents > 1 OR doc_id > owner").select("doc_id", "mark", (F.col("doc_id") > F.col("owner")).alias("whole"))


def _listed(found: DataFrame) -> DataFrame:
    """All marks of a text in one row: as many as it has windows, at most."""
    return found.groupBy("doc_id", F.shiftright("mark", _VERSION_SHIFT).alias("version")).agg(F.collect_set("mark").alias("marks"))


def _ranges(listed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of marks"""
    mark = np.array(listed, np.int64)
    return (mark >> _COUNT_BITS) & ((1 << (_VERSION_SHIFT - _COUNT_BITS)) - 1), (mark & ((1 << _COUNT_BITS) - 1)) + 1


def windows(texts: DataFrame, length: int) -> DataFrame:
    """w1, w2, doc_id, mark: every window of the marked occurrences by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            batch = batch.filter(pc.is_valid(batch.column("marks")))
            if not batch.num_rows:
                continue
            words = Words(batch.column("text"))
            starts, owner = [], []
            for d, listed in enumerate(batch.column("marks").to_pylist()):
                first, n = _ranges(listed)
                place = np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                starts.append(words.starts[d] + place)
                owner.append(np.full(len(place), d))
            start, d = np.concatenate(starts), np.concatenate(owner)
            ids, versions = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "version"))
            mark = (versions[d] << _VERSION_SHIFT) | ((start - words.starts[d]) << _COUNT_BITS)
            hashes = [_long(words.ranges(start, start + length, base)) for base in (0, 1)]
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(ids[d]), pa.array(mark)], names=["w1", "w2", "doc_id", "mark"])

    return texts.mapInArrow(run, "w1 bigint, w2 bigint, doc_id bigint, mark bigint")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans, text for every row of ``docs`` (doc_id, text; other columns ignored).

    spans are the merged ranges [start, past) of removed words, the maximal repeats of smaller doc_ids; text is what is kept, joined by
    one space.  Windows are judged on the input.  Null and short texts have no window and lose nothing.  A null doc_id is neither smaller
    nor larger than any: such rows lose nothing and take nothing.  Rows that share a doc_id don't take from each other.  An empty
    table gives no rows.

    Any ``length`` from 1 gives the same result for any ``gram`` up to it; the default is GRAM, or half of a short length.
    """
    gram = gram or max(1, min(GRAM, length // 2))
    if not 1 <= gram <= length:
        raise ValueError("gram must be from 1 to length")
    found = materialise(marks(materialise(anchors(docs, length, gram), "anchors")), "marks")
    base = docs.select("doc_id", version(F.col("text")).alias("version"), "text")
    on = ["doc_id", "version"]
    # both joins keep all of ``base`` and no other column, so its shuffle is made once and read twice
    seen = windows(base.join(_listed(found.filter("NOT whole")), on, "left"), length)
    owners = seen.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    parts = seen.join(owners, ["w1", "w2"]).filter("doc_id > least").select("doc_id", "mark")
    repeats = _listed(found.filter("whole").select("doc_id", "mark").unionAll(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("past", pa.int64())]))
        for batch in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, listed in zip(text_bytes(batch.column("text")), batch.column("marks").to_pylist()):
                words = text.split() if text else []
                n_words.append(len(words))
                here = []
                if listed:
                    first, n = _ranges(listed)
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + n - 1 + length, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
                    here = [{"start": a, "past": b} for a, b in zip(edges[::2], edges[1::2])]
                    words = [w for w, out in zip(words, gone.tolist()) if not out]
                spans.append(here)
                n_removed.append(sum(s["past"] - s["start"] for s in here))
                kept.append(b" ".join(words))
            sums = [hashlib.sha256(t).hexdigest() for t in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text"],
            )

    shape = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,past:bigint>>, text string"
    return base.join(repeats, on, "left").mapInArrow(run, shape)


def digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = """
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
places AS (SELECT rid, doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM split WHERE len(ws) >= 50),
windows AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS w FROM places),
least AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT rid, unnest(generate_series(i, i + 49)) AS i FROM windows JOIN least USING (w) WHERE doc_id > least),
words AS (SELECT rid, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM split),
kept AS (
  SELECT w.rid, count(g.i) AS n_removed, string_agg(w.word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS t
  FROM words w LEFT JOIN gone g ON w.rid = g.rid AND w.i = g.i GROUP BY w.rid)
SELECT s.doc_id, CAST(len(s.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.rid = k.rid
"""
