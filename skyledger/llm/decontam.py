"""Benchmark decontamination: an FM-index over the words of each training shard, searched for all windows of the test items.

A task cuts its documents into shards of bounded size and numbers the words of a shard.  The windows of the test items (10 words;
all words of a shorter item) go through backward search together; rows of the hits are located through sampled suffix positions,
mapped to documents, and merged to spans.  The documents never move; the items come in blocks of bounded size.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import text_bytes
from skyledger.llm.fmindex import FMIndex

WINDOW = 10
#: Text of a shard, and of the test items that are searched at once.
SHARD_BYTES = 6_000_000
BLOCK_BYTES = 8_000_000

#: Lower-cases A-Z and blanks out what is no word: all ASCII but digits and letters.
_FOLD = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters + string.digits or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))

REPORT = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,past:bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Windows:
    """The windows of a block of items: by length a matrix of word numbers, and for each row the items it comes from."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        found: dict[tuple[bytes, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)} | {None: len(self.names)}
        for name, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(number[name])
        self.words = sorted({w for window in found for w in window})
        place = {w: i for i, w in enumerate(self.words)}
        self.groups = []
        for length in sorted({len(window) for window in found}):
            rows = [(window, owners) for window, owners in found.items() if len(window) == length]
            matrix = np.array([[place[w] for w in window] for window, _ in rows], np.int64)
            owner = np.array([(i, o) for i, (_, owners) in enumerate(rows) for o in sorted(owners)], np.int64)
            self.groups.append((matrix, owner))


class Shard:
    """Documents with an index over all their words."""

    def __init__(self, texts: list[bytes | None]):
        numbers: dict[bytes, int] = {}
        symbols: list[int] = []
        ends = []
        for text in texts:
            symbols += [numbers.setdefault(w, len(numbers) + 2) for w in words_of(text)]
            ends.append(len(symbols))
            symbols.append(1)  # stands between documents
        symbols.append(0)
        self.numbers, self.ends = numbers, np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.index = FMIndex(np.array(symbols, np.int64))

    def hits(self, windows: Windows) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(positions, length, document and item of each occurrence's items) per window length"""
        number = np.array([self.numbers.get(w, -1) for w in windows.words], np.int64)
        for matrix, owner in windows.groups:
            patterns = number[matrix]
            known = np.flatnonzero((patterns >= 0).all(1))
            lo, hi = self.index.search(patterns[known])
            n = hi - lo
            if not n.sum():
                continue
            window = np.repeat(known, n)
            rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            positions = self.index.locate(rows)
            doc = np.searchsorted(self.ends, positions, side="right")
            pairs = np.unique(np.stack([window, doc], 1), axis=0)
            # a window has few items; each pair of document and window brings them all
            left, right = np.searchsorted(owner[:, 0], pairs[:, 0]), np.searchsorted(owner[:, 0], pairs[:, 0], side="right")
            many = right - left
            items = owner[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(int(many.sum())), 1]
            yield positions, matrix.shape[1], np.repeat(pairs[:, 1], many), items


def _scan(texts: list[bytes | None], blocks) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]], list[int]]:
    shard = Shard(texts)
    total = int(shard.ends[-1]) + 1
    cover = np.zeros(total + 1, np.int64)
    items: list[set[str | None]] = [set() for _ in texts]
    for block in blocks:
        windows = block.value
        for positions, length, docs, owners in shard.hits(windows):
            np.add.at(cover, positions, 1)
            np.add.at(cover, positions + length, -1)
            for pair in np.unique(docs * (len(windows.names) + 1) + owners).tolist():
                doc, item = divmod(pair, len(windows.names) + 1)
                items[doc].add(windows.names[item] if item < len(windows.names) else None)
    hit = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    first, past = edges[::2], edges[1::2]
    spans: list[list[dict]] = [[] for _ in texts]
    for d, a, b in zip(np.searchsorted(shard.ends, first, side="right").tolist(), first.tolist(), past.tolist()):
        start = int(shard.starts[d])
        spans[d].append({"start": a - start, "past": b - start})
    summed = np.concatenate([[0], np.cumsum(hit)])
    n_hit = summed[shard.ends] - summed[shard.starts]
    return shard.ends - shard.starts, n_hit, [sorted(x for x in s if x is not None) for s in items], spans, [len(s) for s in items]


def item_blocks(benchmark: DataFrame, width: int, block_bytes: int) -> list:
    """Broadcasts of the items' windows, each of at most ``block_bytes`` of text or one item; the driver holds one at a time."""
    context = benchmark.sparkSession.sparkContext
    blocks, open_items, held = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").toLocalIterator():
        text = row.text.encode()
        if open_items and held + len(text) > block_bytes:
            blocks.append(context.broadcast(Windows(open_items, width)))
            open_items, held = [], 0
        open_items.append((row.item_id, text))
        held += len(text)
    if open_items:
        blocks.append(context.broadcast(Windows(open_items, width)))
    return blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans for every row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    Other columns are ignored.  spans are merged ranges [start, past) of hit words; items are the ids, sorted as strings, of the items with a
    window in the text.  Rows of the benchmark that share an item_id are one item; items without an id hit and count as one item
    but are not listed.  Null texts have no words.  An item of fewer words than ``width`` is one window, one without words none.
    Empty tables give no rows, or rows without hits.
    """
    blocks = item_blocks(benchmark, width, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        held = 0

        def scanned() -> pa.RecordBatch:
            n_words, n_hit, items, spans, n_items = _scan(texts, blocks)
            span = pa.list_(pa.struct([("start", pa.int64()), ("past", pa.int64())]))
            out = [pa.array(ids, pa.int64()), pa.array(n_words), pa.array(n_hit), pa.array(n_items, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_hit", "n_items", "items", "spans"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                if texts and held + len(text or b"") > shard_bytes:
                    yield scanned()
                    held = 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text or b"")
        if texts:
            yield scanned()

    return docs.select("doc_id", "text").mapInArrow(run, REPORT.replace("n_hit bigint,", "n_hit bigint, n_items bigint,"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs, benchmark)
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    blocks = item_blocks(benchmark, width, BLOCK_BYTES)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(at))
            start = held = 0
            for i, text in enumerate([*texts, None]):
                if i == len(texts) or (i > start and held + len(text or b"") > shard_bytes):
                    if i > start:
                        n_hit = _scan(texts[start:i], blocks)[1]
                        yield batch.slice(start, i - start).filter(pa.array(n_hit == 0))
                    start, held = i, 0
                held += len(text or b"")

    return docs.mapInArrow(run, docs.schema)


SQL = """
WITH folded AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL),
starts AS (SELECT item, ws, least(10, len(ws)) AS m, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS w FROM starts),
places AS (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM folded),
hits AS (
  SELECT p.rid, p.i, k.m, x.item FROM places p JOIN (SELECT DISTINCT m FROM windows) k ON p.i + k.m - 1 <= len(p.ws)
  JOIN windows x ON x.m = k.m AND x.w = array_to_string(p.ws[p.i:p.i + k.m - 1], ' ')),
covered AS (SELECT DISTINCT rid, unnest(generate_series(i, i + m - 1)) AS i FROM hits),
counted AS (SELECT rid, count(*) AS n FROM covered GROUP BY rid),
listed AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT f.doc_id, CAST(len(f.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(l.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM folded f LEFT JOIN counted c ON f.rid = c.rid LEFT JOIN listed l ON f.rid = l.rid
"""
