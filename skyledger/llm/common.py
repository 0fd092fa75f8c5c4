"""Expressions and small helpers shared by the corpus operators."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that end a word: [\x20\x09-\x0D].  ``bytes.split()`` without arguments splits at exactly these.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` does the same on ASCII-only texts and is much faster there than ``translate``.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, row by row."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def fitting(content: dict, path: str, normalizer, pre_tokenizer, **model) -> dict:
    """The tokenizer file ``content``, if its text handling and the given settings of its model are those that the caller works by."""
    found = {"normalizer": content.get("normalizer"), "pre_tokenizer": content.get("pre_tokenizer")} | {k: content["model"].get(k) for k in ("type", *model)}
    wanted = {"normalizer": normalizer, "pre_tokenizer": pre_tokenizer, "type": "BPE"} | model
    other = [k for k in wanted if found[k] != wanted[k]]
    if other:
        raise ValueError(f"{path}: not a file for this operator, it differs in {', '.join(other)}")
    return content


def slices(sizes: list[int], limit: int):
    """Consecutive (from, to) row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
