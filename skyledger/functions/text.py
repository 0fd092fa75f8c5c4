"""Text expressions.  All of them stay in the JVM."""

from __future__ import annotations

import html
import html.entities
import json

from pyspark.sql import Column, functions as F

from skyledger import fixed_values as V

# Entities decoded by plain replacement; "&amp;" has to come last.
COMMON_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
    ("&copy;", "©"), ("&middot;", "·"), ("&deg;", "°"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
]
_OTHER_ENTITY = "&(?!(?:" + "|".join(e.strip("&;") for e, _c in COMMON_ENTITIES) + ");)[#A-Za-z]"
# What a reference may look like; the name is resolved afterwards.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that count without a semicolon, and at the start of a longer word.
_BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
# Numbers below this one have meanings of their own (control characters, Windows-1252).
_LOW_NUMBERS = 160


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The value of ``key`` in a table that is part of the plan as one folded literal."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def _character(number: Column) -> Column:
    """The text that a numeric reference stands for; null (too large) is the replacement character."""
    low = {str(n): html.unescape(f"&#{n};") for n in range(_LOW_NUMBERS)}
    out_of_range = number.isNull() | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    nothing = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when(out_of_range, F.lit("\ufffd")).when(number < _LOW_NUMBERS, _lookup(low, number.cast("string")))
        .when(nothing, F.lit("")).otherwise(char)
    )


def _resolved(entity: Column) -> Column:
    """The text that one reference (with its ampersand) stands for; itself, if it names nothing."""
    name = F.substr(entity, F.lit(2))
    digits = F.regexp_extract(entity, "^&#0*([0-9]{1,9});?$", 1)
    hexes = F.regexp_extract(entity, "^&#[xX]0*([0-9a-fA-F]{1,7});?$", 1)
    zero = entity.rlike("^&#[xX]?0+;?$")
    number = F.when(zero, F.lit(0)).when(digits != "", digits.try_cast("bigint")).when(hexes != "", F.conv(hexes, 16, 10).cast("bigint"))
    start = F.regexp_extract(name, "^(?:" + "|".join(_BARE) + ")", 0)
    by_start = F.when(start != "", F.concat(_lookup({n: html.entities.html5[n] for n in _BARE}, start), F.substr(name, F.length(start) + 1)))
    return F.when(entity.startswith("&#"), _character(number)).otherwise(F.coalesce(_lookup(html.entities.html5, name), by_start, entity))


def unescape_html(col: Column) -> Column:
    """Decode entities.  Common ones are replaced; a text with any other one is cut at its references, each is looked
    up in the standard table, and the pieces are joined again."""
    between = F.split(col, _ENTITY, -1)
    found = F.transform(F.regexp_extract_all(col, F.lit(_ENTITY), F.lit(0)), _resolved)
    whole = F.array_join(F.zip_with(between, found, lambda t, e: F.concat(t, F.coalesce(e, F.lit("")))), "")
    return F.when(col.rlike(_OTHER_ENTITY), whole).otherwise(unescape_common(col))


def unescape_common(col: Column) -> Column:
    for entity, char in COMMON_ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def clean_html(col: Column, unescape=unescape_html) -> Column:
    """Plain text of an HTML fragment.

    Text without a tag or an entity skips those steps; the blank pattern only
    matches runs that change.
    """
    tags = F.regexp_replace(col, r"(?iU)<br\s*/?>|</p>|</div>|</li>", "\n")
    tags = F.regexp_replace(tags, r"<[^>]+>", " ")
    t = F.when(F.contains(col, F.lit("<")), tags).otherwise(col)
    t = F.when(F.contains(col, F.lit("&")), unescape(t)).otherwise(t)
    t = F.regexp_replace(t, r"\t[ \t]*| [ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def norm_text(col: Column) -> Column:
    """Comparison form: lower case, no links, only a-z, digits, Devanagari."""
    low = F.lower(col)
    linked = F.contains(low, F.lit("://")) | F.contains(low, F.lit("www."))
    t = F.when(linked, F.regexp_replace(low, r"(?U)https?://\S+|www\.\S+", " ")).otherwise(low)
    return F.trim(F.regexp_replace(t, f"[^a-z0-9{V.DEVANAGARI}]+", " "))


def norm_place(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), f"[^a-z0-9{V.DEVANAGARI}]+", "")


def content_hash(norm: Column) -> Column:
    return F.sha2(norm, 256)


def shingles(norm: Column, k: int = V.SHINGLE_LENGTH) -> Column:
    """Distinct character k-grams; shorter text is its own only shingle.

    The zero-width lookahead walks the text once, so long texts stay linear.
    """
    grams = F.array_distinct(F.regexp_extract_all(norm, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))
    return (
        F.when(F.length(norm) == 0, F.array().cast("array<string>"))
        .when(F.length(norm) < k, F.array(norm))
        .otherwise(grams)
    )


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard of two distinct arrays; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common.cast("double") / (F.size(a) + F.size(b) - common).cast("double")
    )


def extract_hashtags(cleaned: Column) -> Column:
    """Hashtags of an HTML-cleaned text, each with exactly one ``#``."""
    words = F.regexp_extract_all(cleaned, F.lit(rf"#+([\p{{L}}\p{{N}}_{V.INDIC}]+)"), F.lit(1))
    return F.transform(words, lambda w: F.concat(F.lit("#"), w))


def merge_hashtags(given: Column, found: Column) -> Column:
    """Case-insensitive distinct; the first spelling and the order are kept."""
    none = F.array().cast("array<string>")

    def add(kept: Column, tag: Column) -> Column:
        known = F.exists(kept, lambda k: F.lower(k) == F.lower(tag))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(tag)))

    return F.aggregate(F.concat(F.coalesce(given, none), F.coalesce(found, none)), none, add)


def slug(col: Column) -> Column:
    return F.replace(F.lower(col), F.lit(" "), F.lit("-"))
