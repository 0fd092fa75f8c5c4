"""Language identification by prediction by partial matching (PPM) over bytes.

Training counts, per language, every byte after its contexts of 3, 2, 1 and 0 bytes.  A byte's probability comes from its longest
known context (method C: a context seen T times with q different successors gives the share q / (T + q) to the escape); after an
escape the shorter context shares that among the bytes not excluded yet.  The statistics are frozen, so the probabilities of all
successors of a context are worked out once, and a text's code length in a language is a sum of table entries: exact, not sampled.
The shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.llm.common import slices, text_bytes

ORDER = 3
#: Labelled documents that training reads per language, at most.
TRAIN_DOCS = 400
#: A text that costs more bits per byte than this in its best language is in none of them: well above the 8 of raw bytes, since a
#: short sentence around a random token comes near those.
MOST_BITS = 10.0

SLICE_BYTES = 4_000_000
POSITIONS = 1 << 20
_LETTER = regex.compile(r"\p{L}")


class Model:
    """Code lengths (nats) as a table by context state, next byte and language.

    Bytes are renumbered 1..; 0 stands for bytes that training did not see and for the start of a text.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, lang: np.ndarray, n: np.ndarray):
        """``n`` times language ``lang`` had the four bytes ``grams`` (big-endian; zero bytes before the start of a text)."""
        self.langs = langs
        bytes_of = np.stack([(grams >> s) & 255 for s in (24, 16, 8, 0)], 1)
        seen = np.unique(bytes_of)
        self.code = np.zeros(256, np.int64)
        self.code[seen[seen > 0]] = np.arange(1, (seen > 0).sum() + 1)
        a = self.width = int(self.code.max()) + 1
        c = self.code[bytes_of]
        pair, triple = c[:, 1] * a + c[:, 2], (c[:, 0] * a + c[:, 1]) * a + c[:, 2]
        pairs, triples = np.unique(pair), np.unique(triple)
        # states: a contexts of one byte, then those of two, then those of three
        two = np.tile(np.arange(a), a)
        two[pairs] = a + np.arange(len(pairs))
        three = np.tile(two, a)
        three[triples] = a + len(pairs) + np.arange(len(triples))
        self.state = three.astype(np.int32)
        states = a + len(pairs) + len(triples)
        self.cost = np.empty((states * a, len(langs)), np.float32)
        for k in range(len(langs)):
            mine = lang == k
            successor, weight = c[mine, 3], n[mine].astype(float)
            uniform = np.full((1, a), 1.0 / a)
            zero = self._step(np.zeros(int(mine.sum()), np.int64), successor, weight, 1, uniform)
            one = self._step(c[mine, 2], successor, weight, a, np.broadcast_to(zero, (a, a)))
            at, known = self._find(pairs, pair[mine])
            second = self._step(at[known], successor[known], weight[known], len(pairs), one[pairs % a])
            shorter = np.concatenate([one, second])[two]
            at, known = self._find(triples, triple[mine])
            third = self._step(at[known], successor[known], weight[known], len(triples), shorter[triples % (a * a)])
            self.cost[:, k] = -np.log(np.concatenate([one, second, third])).ravel()

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def _step(self, context: np.ndarray, successor: np.ndarray, weight: np.ndarray, contexts: int, shorter: np.ndarray) -> np.ndarray:
        """Distributions of ``contexts`` contexts, escaping to the rows of ``shorter``."""
        a = self.width
        counts = np.bincount(context * a + successor, weight, contexts * a).reshape(contexts, a)
        kinds, total = (counts > 0).sum(1, keepdims=True), counts.sum(1, keepdims=True)
        left = np.where(counts > 0, 0.0, shorter)
        room = left.sum(1, keepdims=True)
        whole = np.where(room > 0, total + kinds, total)  # nothing left to escape to
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(total > 0, np.where(counts > 0, counts / whole, kinds / whole * left / room), shorter)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of each text in each language, in nats."""
        out = np.zeros((len(texts) + 1, len(self.langs)))
        gap = bytes(ORDER)
        codes = self.code[np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)]
        sizes = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.stack([np.arange(len(texts)), np.full(len(texts), len(texts))], 1).ravel(), np.stack([sizes, np.full(len(texts), ORDER)], 1).ravel())
        a = self.width
        for lo in range(0, len(owner), POSITIONS):
            part = codes[lo : lo + POSITIONS + ORDER]
            context = (part[:-3] * a + part[1:-2]) * a + part[2:-1]
            cost = self.cost[self.state[context].astype(np.int64) * a + part[3:]]
            here = owner[lo : lo + POSITIONS]
            first, last = int(here[:-1].min(initial=here[0])), len(texts) + 1
            for k in range(len(self.langs)):
                out[first:, k] += np.bincount(here - first, cost[:, k], last - first)
        return out[:-1]

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, its share among the languages, bits per byte in it) per text."""
        lettered = np.array([bool(t) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], bool)
        lang, score, bits = np.full(len(texts), "und", object), np.zeros(len(texts)), np.full(len(texts), np.nan)
        if self.langs and lettered.any():
            some = [t for t, ok in zip(texts, lettered) if ok]
            cost = self.lengths(some)
            best = cost.argmin(1)  # the first by name, if equal
            low = cost[np.arange(len(some)), best]
            lang[lettered] = np.array(self.langs, object)[best]
            score[lettered] = 1 / np.exp(low[:, None] - cost).sum(1)
            bits[lettered] = low / np.log(2) / np.array([len(t) for t in some])
        return lang.tolist(), score, bits


def in_training() -> Column:
    """Two of three documents, by the checksum of their doc_id; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, lang in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist()):
            b = np.frombuffer(bytes(ORDER) + text, np.uint8).astype(np.int64)
            grams, n = np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model of the labelled documents (doc_id, text, lang) outside the held-out fold.

    Per language it reads the ``most`` documents whose doc_ids hash lowest, whole; what comes to the driver are their n-gram counts.  Rows
    without doc_id, text or lang teach nothing; of rows that repeat a doc_id the least (lang, text) does.  Without any, the model knows no language.
    """
    fold = docs.filter("text IS NOT NULL AND text != '' AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(in_training())
    fold = fold.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"))
    lowest = W.partitionBy("lang").orderBy("h")
    bound = fold.select("lang", "h").withColumn("place", F.row_number().over(lowest)).filter(F.col("place") <= most).groupBy("lang").agg(F.max("h").alias("most"))
    sample = fold.join(F.broadcast(bound), "lang").filter("h <= most")  # one row per language
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).select("one.*")
    rows = sample.mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    numbers = {name: k for k, name in enumerate(langs)}
    return Model(langs, rows["gram"].to_numpy(np.int64), rows["lang"].map(numbers).to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every row of ``docs`` (doc_id, text, and lang to train on; others ignored).

    A text that is null or has no letter is ``und`` with score 0.  score is the share of the best language if all are as likely beforehand;
    equal code lengths go to the first name.  A null doc_id is not held out and teaches nothing.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # its size follows TRAIN_DOCS, not the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in slices([len(t) if t else 0 for t in texts], SLICE_BYTES):
                lang, score, bits = shared.value.predict(texts[lo:hi])
                part = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [*part, pa.array(lang, pa.string()), pa.array(score), pa.array(bits, from_pandas=True)],
                    names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
                )

    rows = docs.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep(docs: DataFrame, model: Model | None = None, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` in a known language, with all their columns; ``und`` and texts of more than ``most_bits`` per byte go."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(at))
            for lo, hi in slices([len(t) if t else 0 for t in texts], SLICE_BYTES):
                lang, _, bits = shared.value.predict(texts[lo:hi])
                known = [name != "und" and b <= most_bits for name, b in zip(lang, bits)]
                yield batch.slice(lo, hi - lo).filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
