"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch stand in one array of symbols.  Each round finds, for every sequence at once, the pair of
neighbours with the lowest merge rank, merges all its places in the sequence, and drops the sequences that have no pair left; the
number of symbols that survive is the number of tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skyledger.llm.common import fitting, slices, text_bytes
from skyledger.llm.tokenpack import byte_alphabet

LIMIT = 1024
SLICE_BYTES = 4_000_000
#: Pre-tokens whose count a task remembers, and symbols that merge at once.
REMEMBERED = 500_000
MERGED_AT_ONCE = 2_000_000

# fixed values: the split of byte-level vocabularies, with the white space of its engine written out
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# fixed values: the text handling and the model settings that files of this kind have
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_PLAIN_BPE = {"dropout": None, "unk_token": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
_NONE = np.iinfo(np.int64).max


class Merges:
    """Merge ranks of a byte-level vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = fitting(json.load(file), path, None, _BYTE_LEVEL, **_PLAIN_BPE)
        vocab = content["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        self.specials = [t["content"] for t in content["added_tokens"]]
        self.size = np.int64(max(vocab.values()) + 1)
        letters = byte_alphabet()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        left, right, both = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.symbol = keys[order], order.astype(np.int64), both

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols of each (non-empty) sequence after all merges."""
        out = np.fromiter(map(len, sequences), np.int64, len(sequences))
        symbols = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), out)
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            ranks = np.full(len(symbols), _NONE)
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
            ranks[first[1:] - 1] = _NONE  # no pair across sequences
            low = np.minimum.reduceat(ranks, first)
            size = np.diff(first, append=len(symbols))
            out[owner[first]] = size
            low = np.repeat(low, size)
            hits = np.flatnonzero((ranks == low) & (low != _NONE))
            if not len(hits):
                break
            # in a run of equal symbols every second place merges, from the left
            new_run = np.diff(hits, prepend=-2) != 1
            run = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
            symbols[hits] = self.symbol[ranks[hits]]
            stay = low != _NONE
            stay[hits + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return out


@lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Tokens per text, with the counts of pre-tokens remembered between batches."""

    def __init__(self, path: str):
        self.merges = merges(path)
        self.known: dict[str, int] = {}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.merges.specials, key=len, reverse=True))) or r"(?!)")

    def learn(self, new: list[str]) -> None:
        start = size = 0
        for i, token in enumerate([*new, ""]):
            if i == len(new) or size > MERGED_AT_ONCE:
                if chunk := new[start:i]:
                    self.known.update(zip(chunk, self.merges.counts([t.encode() for t in chunk]).tolist()))
                start, size = i, 0
            size += 4 * len(token)

    def __call__(self, texts: list[str | None]) -> list[int]:
        found, special = [], []
        for text in texts:
            if text and self.specials.search(text):
                parts = self.specials.split(text)
                special.append(len(parts) - 1)
                found.append([t for part in parts for t in _SPLIT.findall(part)])
            else:
                special.append(0)
                found.append(_SPLIT.findall(text) if text else [])
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*found)
        self.learn(list(new))
        return [sum(map(self.known.__getitem__, tokens)) + extra for tokens, extra in zip(found, special)]


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text; other columns ignored).

    Counts equal those of the tokenizers library without added special tokens; special strings inside a text are one token.  A null or empty
    text has no bytes and no tokens.  A file whose normalizer, pre-tokenizer or model is of another kind is refused.  Repeated rows and null doc_ids are counted like any other; an empty table gives no rows.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    counter(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            sizes = [len(t) if t else 0 for t in texts]
            for lo, hi in slices(sizes, SLICE_BYTES):
                n = pa.array(count([t.decode("utf-8", "replace") if t else None for t in texts[lo:hi]]), pa.int64())
                size = pa.array(sizes[lo:hi], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", counted.n_tokens > limit)
