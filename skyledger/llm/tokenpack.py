"""Token ids of a corpus in Simple-8b blocks, in ascending doc_id order.

Rows are range-partitioned by doc_id and sorted; each task tokenizes its range and writes blocks of whole documents.  A block
(:data:`BLOCK`) says where it stands (part, place and ids before it in the part), which documents it holds, and how many ids each
has; with these offsets any block decodes on its own.  The blocks are rows of a Parquet table, so Spark's writer commits them.
"""

from __future__ import annotations

import gc
import itertools
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from skyledger.llm import simple8b
from skyledger.llm.common import fitting, slices
from skyledger.session import scratch_path

END_ID = 1
#: A block closes with the document that brings it to so many ids.
BLOCK_IDS = 65_536
#: Text that is tokenized at once, and pieces whose ids a task remembers.
SLICE_BYTES = 12_000_000
REMEMBERED = 800_000

BLOCK = "part int, block int, ids_before bigint, n_ids bigint, doc_ids array<bigint>, doc_ids_n array<bigint>, words binary, escaped binary"

# fixed values: what the file's pre-tokenizer does after folding case; \s written out as its engine has it below U+0250
# and with the line ends between words as pieces of their own
_PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MODEL = {"dropout": None, "unk_token": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
#: Above this code point (composition, other alphabets) and for special tokens, the library takes the word as a whole.
_PLAIN = regex.compile(r"[^\u0250-\U0010ffff]*")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters as they are, other bytes from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Store:
    """Runs of ids by number: run i is ``ids[start[i] : start[i] + length[i]]``."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray):
        self.length, self.ids = lengths, ids
        self.start = np.cumsum(lengths) - lengths

    def gather(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the given runs in a row; where each run ends)"""
        length = self.length[runs]
        ends = np.cumsum(length)
        place = np.repeat(self.start[runs] - (ends - length), length)
        place += np.arange(len(place))
        return self.ids[place], ends

    def more(self, found: list[list[int]]) -> Store:
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(length.sum()))
        return Store(np.concatenate([self.length, length]), np.concatenate([self.ids, flat]))


class WordIds:
    """Ids of whole texts by way of their distinct words between blanks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words.  The pieces of the words go through
    the library's model, and their ids are remembered; words with rarer characters or special tokens go through its whole chain.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            fitting(json.load(file), path, _NORMALIZER, _PRE_TOKENIZER, **_MODEL)
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = byte_alphabet()
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {"\n": 0, ".": 1, ",": 2}
        self.pieces = Store(np.zeros(1, np.int64), np.zeros(0, np.uint32)).more(self._tokenize([".", ","]))

    def _tokenize(self, pieces: list[str]) -> list[list[int]]:
        stand_ins = "\n".join(pieces).encode().decode("latin-1").translate(self.letters).split(self.letters[ord("\n")])
        return [[t.id for t in tokens] for tokens in map(self.library.model.tokenize, stand_ins)]

    def _slots(self, *coded: pa.DictionaryArray) -> list[np.ndarray]:
        """The slots of pieces, after learning those that are new."""
        distinct = [c.dictionary.to_pylist() for c in coded]
        new = {p for ps in distinct for p in ps if p not in self.slot}
        if len(self.slot) + len(new) > REMEMBERED:
            self.clear()
            new = {p for ps in distinct for p in ps if p not in self.slot}
        if new:
            base = len(self.slot)
            self.slot.update((p, base + i) for i, p in enumerate(new))
            self.pieces = self.pieces.more(self._tokenize(list(new)))
        slots = [np.fromiter(map(self.slot.__getitem__, ps), np.int64, len(ps)) for ps in distinct]
        return [s[c.indices.to_numpy(zero_copy_only=False)] for s, c in zip(slots, coded)]

    def _plain(self, joined: str) -> Store:
        """A run for every line of ``joined``; most are letters and perhaps a full stop or comma, which need no pattern."""
        words = pc.split_pattern(pa.array([joined.lower()]), "\n").flatten()
        letters = pc.utf8_rtrim(words, ".,")
        cut = (pc.binary_length(words).to_numpy() - pc.binary_length(letters).to_numpy()).astype(np.int64)
        simple = pc.utf8_is_alpha(letters).to_numpy(zero_copy_only=False) & (cut <= 1)
        mark = np.where(cut == 0, 0, np.where(pc.ends_with(words, ".").to_numpy(zero_copy_only=False), 1, 2))
        rest = "\n".join([*words.filter(pa.array(~simple)).to_pylist(), ""])
        head, found = self._slots(letters.filter(pa.array(simple)).dictionary_encode(), pa.array(_PIECES.findall(rest), pa.string()).dictionary_encode())
        runs = np.zeros(len(found) + 2 * len(head), np.int64)
        runs[: 2 * len(head)] = np.stack([head, mark[simple]], 1).ravel()
        runs[2 * len(head) :] = found
        ids, ends = self.pieces.gather(runs)
        word_ends = np.concatenate([ends[1 : 2 * len(head) : 2], ends[2 * len(head) :][found == 0]])
        both = Store(np.diff(word_ends, prepend=0), ids)
        order = np.empty(len(words), np.int64)
        order[simple], order[~simple] = np.arange(len(head)), np.arange(len(head), len(words))
        ids, ends = both.gather(order)
        return Store(np.diff(ends, prepend=0), ids)

    def _words(self, words: pa.Array) -> Store:
        """A run for every word."""
        if not len(words):
            return Store(np.zeros(0, np.int64), np.zeros(0, np.uint32))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py()
        if _PLAIN.fullmatch(joined) and not any(s in joined for s in self.specials):
            return self._plain(joined)
        listed = joined.split("\n")
        rare = [i for i, w in enumerate(listed) if not _PLAIN.fullmatch(w) or any(s in w for s in self.specials)]
        found = [self.library.encode(listed[i], add_special_tokens=False).ids for i in rare]
        for i in rare:
            listed[i] = ""  # has no ids; those found follow the last line
        both = self._plain("\n".join(listed)).more(found)
        order = np.arange(len(listed))
        order[rare] = np.arange(len(listed), len(listed) + len(rare))
        ids, ends = both.gather(order)
        return Store(np.diff(ends, prepend=0), ids)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with its end id; ids per text)"""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = self._words(coded.dictionary)
        # the end mark is one more word, after those of each text
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False) + 1) - 1
        is_end = np.zeros(len(coded) + len(texts), bool)
        is_end[ends] = True
        runs = np.empty(len(is_end), np.int64)
        runs[is_end], runs[~is_end] = len(words.length), coded.indices.to_numpy(zero_copy_only=False)
        ids, ends_at = words.more([[END_ID]]).gather(runs)
        return ids, np.diff(ends_at[ends], prepend=0)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_ids(path), TaskContext.get().partitionId()
        gc.freeze()  # the table of pieces is no garbage: don't scan it again and again
        schema = pa.schema(
            [("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
             ("doc_ids_n", pa.list_(pa.int64())), ("words", pa.binary()), ("escaped", pa.binary())]
        )
        block = before = held = 0
        open_docs: list[int | None] = []
        open_n: list[np.ndarray] = []
        open_ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, before, held
            words, escaped = simple8b.encode(np.concatenate(open_ids))
            row = [part, block, before, held, list(open_docs), np.concatenate(open_n).tolist(), words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes()]
            block, before, held = block + 1, before + held, 0
            for one in (open_docs, open_n, open_ids):
                one.clear()
            return pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(schema, row)}, schema=schema)

        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for lo, hi in slices(pc.binary_length(texts).fill_null(0).to_pylist(), SLICE_BYTES):
                ids, n = encode(texts.slice(lo, hi - lo))
                ends, done = np.cumsum(n), 0
                while done < hi - lo:
                    # the first document that fills the open block closes it
                    taken = int(ends[done - 1]) if done else 0
                    last = min(int(np.searchsorted(ends, taken + BLOCK_IDS - held)), hi - lo - 1)
                    open_docs += doc_ids[lo + done : lo + last + 1]
                    open_n.append(n[done : last + 1])
                    open_ids.append(ids[taken : int(ends[last])])
                    held += int(ends[last]) - taken
                    done = last + 1
                    if held >= BLOCK_IDS:
                        yield close()
        if open_docs:
            yield close()

    return run


def write_ids(docs: DataFrame, folder: str, path: str) -> None:
    """Write the ids of ``docs`` (doc_id, text; other columns ignored) as blocks into ``folder``.

    ``path`` is the tokenizer's file; one whose normalizer, pre-tokenizer or model is of another kind is refused.  A null text is empty and has the end id alone.  Null doc_ids come first; equal doc_ids are ordered by
    a hash of their texts.  An empty table gives no blocks.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    word_ids(path)
    ordered.mapInArrow(_blocks(path), BLOCK).write.parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words, escaped = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escaped"], "<u8")
            ids = simple8b.decode(words, escaped, row["n_ids"]).astype("<u4")
            n = np.array(row["doc_ids_n"], np.int64)
            starts = np.cumsum(n) - n
            sums = [zlib.crc32(ids[a : a + b]) for a, b in zip(starts.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(n), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the blocks of ``folder``."""
    blocks = spark.read.schema(BLOCK).parquet(folder)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per part
    bases = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    placed = blocks.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("ids_before"))  # parts are tasks, not rows
    chosen = placed.select("start", "n_ids", "doc_ids", "doc_ids_n", "words", "escaped")
    return chosen.mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the blocks to the shared scratch folder and describe what is read back."""
    folder = scratch_path(docs.sparkSession, "token-blocks")
    write_ids(docs, folder, path or public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(docs.sparkSession, folder)
