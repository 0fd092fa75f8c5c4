"""Places: nearest city, names, aliases, and the cascade over all of them.

No step broadcasts by hand.  Each lookup is an equi-join against a table unique
on its key, so Spark broadcasts it while it is small (by its measured size) and
shuffles it, splitting skewed keys, when it is not.  Names are found in texts
by equality as well: from every place in a text, as many characters as a name
of that beginning can have.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skyledger import fixed_values as V
from skyledger.functions.geo import flat_metric
from skyledger.functions.plan import once
from skyledger.functions.text import norm_place
from skyledger.session import materialise

#: Characters that a name and a place in a text must share before lengths are tried, at most, and characters of a text that one row searches.
LEAD = 4
CHUNK_CHARS = 10_000
#: Cities that a cell holds unless it is split, and the level at which cells are split no more (a hundred-thousandth of a degree).
FEW = 16
DEEPEST = 17

PLACE = ["city", "state", "district", "lat", "lon"]


def _settled(df: DataFrame) -> DataFrame:
    """A lookup table written once, so that no query builds it again and Spark knows its size."""
    return materialise(df, "gazetteer")


@dataclass(frozen=True, eq=False)
class Gazetteer:
    """Cities in file order (``ord`` and the place columns) and normalised aliases."""

    cities: DataFrame
    aliases: DataFrame

    @cached_property
    def by_name(self) -> DataFrame:
        """City per exact name; of equal names the last in the file."""
        return self.cities.groupBy(F.col("city").alias("target")).agg(F.max_by(F.struct(*PLACE), "ord").alias("place"))

    @cached_property
    def city_aliases(self) -> DataFrame:
        alias = self.aliases.filter("kind = 'city'").join(self.by_name, "target")
        return alias.select("ord", F.col("alias").alias("key"), "place")

    @cached_property
    def lookup(self) -> DataFrame:
        """key -> place.  A key keeps its first position but its last place;
        aliases only add keys that names and districts do not have."""
        place = F.struct(*PLACE)
        own = self.cities.select(
            F.explode(
                F.array(
                    F.struct((F.col("ord").cast("bigint") * 2).alias("pos"), norm_place(F.col("city")).alias("key")),
                    F.struct((F.col("ord").cast("bigint") * 2 + 1).alias("pos"), norm_place(F.col("district")).alias("key")),
                )
            ).alias("k"),
            place.alias("place"),
        ).select("k.pos", "k.key", "place", F.lit(0).alias("tier"))
        after = F.lit(1 << 40) + F.col("ord")
        alias = self.city_aliases.select(after.alias("pos"), "key", "place", F.lit(1).alias("tier"))
        merged = own.unionByName(alias).filter("key <> ''").groupBy("key").agg(
            F.min("pos").alias("pos"),
            F.max_by("place", F.when(F.col("tier") == 0, F.col("pos"))).alias("own"),
            F.min_by("place", F.when(F.col("tier") == 1, F.col("pos"))).alias("alias"),
        )
        return _settled(merged.select("key", "pos", F.coalesce("own", "alias").alias("place")))

    @cached_property
    def starts(self) -> DataFrame:
        """Every beginning of a key -> the first key that starts so."""
        hit = F.struct("pos", "place")
        rows = self.lookup.select(_beginnings().alias("start"), "pos", "place")
        return _settled(rows.groupBy("start").agg(F.min_by(hit, "pos").alias("longer")))

    @cached_property
    def states(self) -> DataFrame:
        """Normalised state name or alias -> state; aliases go first."""
        alias = self.aliases.filter("kind = 'state'").select(
            F.col("alias").alias("key"), F.col("target").alias("found"), F.struct(F.lit(0).alias("tier"), "ord").alias("rank")
        )
        own = self.cities.select(
            norm_place(F.col("state")).alias("key"), F.col("state").alias("found"),
            F.struct(F.lit(1).alias("tier"), "ord").alias("rank"),
        )
        both = alias.unionByName(own).filter("key <> ''")
        return _settled(both.groupBy("key").agg(F.min_by("found", "rank").alias("state_found")))

    @cached_property
    def text_names(self) -> list[tuple[bool, DataFrame]]:
        """Ordered name lists for the search in text: (on squeezed text, names).

        A state name may be short once it is squeezed ('N.S.W.' -> 'nsw') and is
        found as it is; one of which nothing is left is no name.
        """
        whole = self.cities.filter(F.length("city") >= 4).select(
            F.struct((-F.length("city")).alias("a"), F.col("ord").alias("b")).alias("rank"),
            F.lower("city").alias("name"), F.struct(*PLACE).alias("place"),
        )
        long_enough = F.when(F.col("key").rlike(r"\A\p{ASCII}+\z"), F.length("key") >= 5).otherwise(F.length("key") >= 4)
        city_alias = self.city_aliases.filter(long_enough).select(
            F.struct(F.lit(0).alias("a"), F.col("ord").alias("b")).alias("rank"), F.col("key").alias("name"), "place"
        )
        state_alias = self.aliases.filter("kind = 'state'").withColumnRenamed("alias", "key").filter(long_enough).select(
            F.struct(F.lit(1).alias("a"), F.col("ord").alias("b")).alias("rank"), F.col("key").alias("name"),
            _state_place(F.col("target")).alias("place"),
        )
        state_name = (
            self.cities.groupBy(F.lower("state").alias("low"))
            .agg(F.min("ord").alias("ord"), F.max_by("state", "ord").alias("state"))
            .filter(F.length("low") >= 5)
            .select(
                F.struct(F.lit(2).alias("a"), F.col("ord").alias("b")).alias("rank"),
                F.regexp_replace("low", "[^a-z0-9]+", "").alias("name"), _state_place(F.col("state")).alias("place"),
            )
        )
        squeezed = city_alias.unionByName(state_alias).unionByName(state_name).filter("name <> ''")
        return [(False, whole), (True, squeezed)]

    @cached_property
    def searched(self) -> list[tuple[bool, NameList]]:
        """The name lists ready for the search: (on squeezed text, list)."""
        return [(squeezed, NameList.of(names)) for squeezed, names in self.text_names]

    @cached_property
    def cells(self) -> list[DataFrame]:
        """Per level the cells of half the width before (level 0: 1 degree) with their cities, at most ``FEW``, or null if the next level splits them.

        Of cities at one point the first in the file counts.
        """
        point = F.min(F.struct("ord", "city", "state", "district")).alias("c")
        rest = _settled(self.cities.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(point).select(F.struct("c.ord", "c.city", "c.state", "c.district", "lat", "lon").alias("c")))
        out = []
        for level in range(DEEPEST + 1):
            keyed = rest.withColumns({"y": _cell(F.col("c.lat"), level), "x": _cell(F.col("c.lon"), level)})
            sizes = keyed.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))
            full = _settled(sizes.filter(F.lit(level < DEEPEST) & (F.col("n") > FEW)).select("y", "x"))
            few = keyed.join(full, ["y", "x"], "left_anti").groupBy("y", "x").agg(F.array_sort(F.collect_list("c")).alias("held"))
            out.append(_settled(few.unionByName(full.withColumn("held", F.lit(None).cast(few.schema["held"].dataType)))))
            if full.isEmpty():
                break
            rest = _settled(keyed.join(full, ["y", "x"], "left_semi").select("c"))
        return out


def _cell(degrees: Column, level: int) -> Column:
    """Number of the cell of 2^-level degrees."""
    return F.floor(degrees * float(1 << level)).cast("bigint")


def _beginnings() -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring("key", F.lit(1), i)))


def _state_place(state: Column) -> Column:
    return F.struct(
        state.alias("city"), state.alias("state"), F.lit("").alias("district"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")
    )


# -- nearest ----------------------------------------------------------------
def nearest_city(df: DataFrame, gaz: Gazetteer, lat: Column, lon: Column, name: str = "near") -> DataFrame:
    """Add the nearest city within the radius as a struct (null if none); of equally near ones the first in the file.

    Distinct places go down the levels of ``gaz.cells`` together.  At each level a place keeps the cells that can still hold its nearest
    city: nearer than the radius and than the farthest corner of any cell it keeps.  Where cities are dense few cells are left, so
    no place meets more than a handful of lists of at most ``FEW``, and the rows of ``df`` are joined once.
    """
    keyed = df.withColumns({"_lat": lat, "_lon": lon})
    places = materialise(keyed.select("_lat", "_lon").filter("_lat IS NOT NULL AND _lon IS NOT NULL").distinct(), "places")
    reach = F.explode(F.array(*[F.struct((_cell(F.col("_lat"), 0) + i).alias("y"), (_cell(F.col("_lon"), 0) + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = places.withColumn("cell", reach).select("_lat", "_lon", "cell.*", F.lit(float(V.NEAREST_CITY_DEGREES**2)).alias("most"))
    found = []
    for level, cells in enumerate(gaz.cells):
        met = materialise(asked.join(cells, ["y", "x"]), "cells-met")
        measured = F.transform("held", lambda c: F.struct(flat_metric(F.col("_lat"), F.col("_lon"), c["lat"], c["lon"]).alias("d2"), c["ord"].alias("ord"), *[c[p].alias(p) for p in PLACE]))
        found.append(met.filter("held IS NOT NULL").select("_lat", "_lon", F.array_min(F.filter(measured, lambda m: m["d2"] < V.NEAREST_CITY_DEGREES**2)).alias("best")))
        if level + 1 == len(gaz.cells):
            break
        # a cell that is split holds a city, so the nearest one is no farther than its farthest corner
        near, far = _corners(level)
        most = F.least(F.min(F.when(F.col("held").isNull(), far)), F.min("most"))
        least = met.groupBy("_lat", "_lon").agg(most.alias("least"))
        child = F.explode(F.array(*[F.struct((F.col("y") * 2 + i).alias("y"), (F.col("x") * 2 + j).alias("x")) for i in (0, 1) for j in (0, 1)]))
        split = met.filter("held IS NULL").join(least, ["_lat", "_lon"]).filter(near <= F.col("least") * (1 + 1e-9))
        asked = split.select("_lat", "_lon", F.col("least").alias("most"), child.alias("cell")).select("_lat", "_lon", "cell.*", "most")
        asked = asked.filter(_corners(level + 1)[0] <= F.col("most") * (1 + 1e-9))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.filter("best IS NOT NULL").groupBy("_lat", "_lon").agg(F.min("best").alias("best"))
    best = materialise(best.select("_lat", "_lon", F.struct(*[F.col(f"best.{p}").alias(p) for p in PLACE]).alias(name)), "nearest")
    return keyed.join(best, ["_lat", "_lon"], "left").select(*[keyed[c] for c in df.columns], name)


def _corners(level: int) -> tuple[Column, Column]:
    """Least and largest squared distance from (_lat, _lon) to the cell (y, x), as ``flat_metric`` measures it."""
    width = 1.0 / (1 << level)

    def gaps(at: str, cell: str, scale: float = 1.0) -> tuple[Column, Column]:
        low, high = F.col(cell) * width, (F.col(cell) + 1) * width
        near = F.greatest(low - F.col(at), F.col(at) - high, F.lit(0.0))
        return near * scale, F.greatest(F.abs(F.col(at) - low), F.abs(high - F.col(at))) * scale

    (near_y, far_y), (near_x, far_x) = gaps("_lat", "y"), gaps("_lon", "x", V.LON_SHRINK)
    return near_y * near_y + near_x * near_x, far_y * far_y + far_x * far_x


# -- by name ----------------------------------------------------------------
def resolve_names(names: DataFrame, gaz: Gazetteer, fuzzy: bool = True) -> DataFrame:
    """place for distinct ``name`` values: exact key, prefix either way (first
    in table order), closest spelling.  Names that stay unknown are left out."""
    keyed = names.select("name", norm_place(F.col("name")).alias("key")).filter("key <> ''")
    exact = keyed.join(gaz.lookup.select("key", F.col("place").alias("exact")), "key", "left")

    hit = F.struct("pos", "place")
    rest = exact.filter("exact IS NULL")
    shorter = (
        rest.select("key").distinct().select("key", _beginnings().alias("start"))
        .join(gaz.lookup.select(F.col("key").alias("start"), "pos", "place"), "start")
        .groupBy("key").agg(F.min_by(hit, "pos").alias("shorter"))
    )
    tried = rest.join(gaz.starts.withColumnRenamed("start", "key"), "key", "left").join(shorter, "key", "left")
    first = F.array_min(F.array_compact(F.array("longer", "shorter")))
    tried = tried.select("name", "key", first["place"].alias("place"))
    parts = [exact.filter("exact IS NOT NULL").select("name", F.col("exact").alias("place"))]
    if fuzzy:
        unknown = tried.filter("place IS NULL").select("name", "key")
        near = closest_keys(unknown.select("key").distinct(), gaz.lookup.select("key"))
        spelled = unknown.join(near, "key").select("name", F.col("near").alias("key"))
        parts.append(spelled.join(gaz.lookup, "key").select("name", "place"))
    parts.append(tried.filter("place IS NOT NULL").select("name", "place"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closest_keys(unknown: DataFrame, keys: DataFrame, cutoff: float = V.FUZZY_PLACE_RATIO) -> DataFrame:
    """key, near: for each ``key`` of ``unknown`` the most similar one of ``keys`` (equal ratios: the last by code point),
    if the standard library's string ratio reaches ``cutoff``.

    With a ratio of 2 M / T above 0.8 fewer than T / 5 characters are unmatched, and so few gaps leave a block of two
    characters or more: similar keys share a bigram, have lengths in a band, and are within T - 2 M edits.  An equi-join on
    bigram and length brings all of them, the edit distance thins them out, and only those pairs get the exact ratio.
    """
    if not 0.8 < cutoff <= 1:
        raise ValueError("a ratio above 0.8, at most 1 expected")

    def grams(df: DataFrame, name: str) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all(name, F.lit("(?s)(?=(.{2}))"), F.lit(1)))
        return once(df.select(F.col("key").alias(name)), _g=found).select(name, F.explode("_g").alias("gram"))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)], dtype="float64")

    size = F.length("key")
    ends = F.ceil(size * cutoff / (2 - cutoff) - 1e-9), F.floor(size * (2 - cutoff) / cutoff + 1e-9)
    asked = grams(unknown, "key").withColumn("size", F.explode(F.sequence(*[e.cast("int") for e in ends])))
    pairs = asked.join(grams(keys, "near").withColumn("size", F.length("near")), ["gram", "size"])
    most = (F.length("key") + F.length("near")) * (1 - cutoff) + 1e-9
    close = pairs.filter(F.levenshtein("key", "near") <= most).select("key", "near").distinct()
    scored = close.withColumn("r", ratio("key", "near")).filter(F.col("r") >= cutoff)
    return scored.groupBy("key").agg(F.max_by("near", F.struct("r", "near")).alias("near"))


def find_city(df: DataFrame, gaz: Gazetteer, column: str, name: str = "by_name", fuzzy: bool = True) -> DataFrame:
    """Add the city a free-text name means.  Distinct names are written and resolved once, whatever ``df`` is computed from."""
    names = materialise(df.select(F.col(column).alias("name")).filter(F.coalesce("name", F.lit("")) != "").distinct(), "names")
    known = materialise(resolve_names(names, gaz, fuzzy), "known-names")
    return df.join(known.select(F.col("name").alias(column), F.col("place").alias(name)), column, "left")


def find_state(df: DataFrame, gaz: Gazetteer, column: str, name: str = "state_found") -> DataFrame:
    known = gaz.states.select(F.col("key").alias("_state_key"), F.col("state_found").alias(name))
    return df.withColumn("_state_key", norm_place(F.col(column))).join(known, "_state_key", "left").drop("_state_key")


# -- in text ----------------------------------------------------------------
def squeeze(low: Column) -> Column:
    return F.regexp_replace(low, f"[^a-z0-9{V.DEVANAGARI}]+", "")


@dataclass(frozen=True, eq=False)
class NameList:
    """Names with rank and place, the name lengths there are per ``lead`` first characters, and the longest name."""

    names: DataFrame
    lengths: DataFrame
    lead: int
    longest: int

    @staticmethod
    def of(names: DataFrame) -> NameList:
        one = _settled(names.groupBy("name").agg(F.min_by("place", "rank").alias("place"), F.min("rank").alias("rank")))
        shortest, longest = one.agg(F.min(F.length("name")), F.max(F.length("name"))).first()
        lead = min(LEAD, shortest or LEAD)
        lengths = one.groupBy(F.substring("name", 1, lead).alias("start")).agg(F.collect_set(F.length("name")).alias("lengths"))
        return NameList(one, _settled(lengths), lead, longest or lead)


def _first_name(df: DataFrame, text: Column, listed: NameList, out: str) -> DataFrame:
    """Add the place of the first name (by rank) that the text contains.

    Distinct texts are read once.  From every place of a text its next characters are taken, as many as the longest name has; a join on
    the first few tells which lengths can occur there, a second one on the whole name decides.  So a text meets only names that
    begin like some part of it, whatever the size of the list, and no text is searched name by name.
    """
    texts = df.select(text.alias("_t")).filter(F.length("_t") >= listed.lead).distinct()
    texts = materialise(texts.select("_t", F.monotonically_increasing_id().alias("_id")), "texts")
    chunk = F.explode(F.sequence(F.lit(0), F.expr(f"(length(_t) - 1) div {CHUNK_CHARS}").cast("int")))
    chunks = texts.select("_id", "_t", chunk.alias("_n")).select("_id", F.substr("_t", F.col("_n") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS + listed.longest - 1)).alias("_t"))
    tails = F.array_distinct(F.regexp_extract_all("_t", F.lit(f"(?s)(?=(.{{{listed.lead},{listed.longest}}}))"), F.lit(1)))
    places = once(chunks, _tails=tails).select("_id", F.explode("_tails").alias("tail"))
    tried = places.withColumn("start", F.substring("tail", 1, listed.lead)).join(listed.lengths, "start").select("_id", "tail", F.explode("lengths").alias("n"))
    pieces = tried.filter(F.length("tail") >= F.col("n")).select("_id", F.substr("tail", F.lit(1), F.col("n")).alias("name"))
    found = pieces.join(listed.names, "name").groupBy("_id").agg(F.min_by("place", "rank").alias(out))
    known = materialise(texts.join(found, "_id").select("_t", out), "named")
    return df.withColumn("_t", text).join(known, "_t", "left").drop("_t")


def place_in_text(df: DataFrame, gaz: Gazetteer, text: Column, name: str = "in_text", when: Column | None = None) -> DataFrame:
    """Place named in the text: city names (longest first), then city aliases,
    state aliases and state names on the text without separators."""
    low = F.lower(text if when is None else F.when(when, text))
    for i, (squeezed, listed) in enumerate(gaz.searched):
        df = _first_name(df, squeeze(low) if squeezed else low, listed, f"_list{i}")
    return df.withColumn(name, F.coalesce("_list0", "_list1")).drop("_list0", "_list1")


def city_in_text(df: DataFrame, gaz: Gazetteer, text: Column, name: str = "named") -> DataFrame:
    return _first_name(df, F.lower(text), gaz.searched[0][1], name)


def alias_in_text(df: DataFrame, gaz: Gazetteer, text: Column, name: str = "aliased") -> DataFrame:
    return _first_name(df, squeeze(F.lower(text)), gaz.searched[1][1], name)


# -- cascade ----------------------------------------------------------------
def geocode(df: DataFrame, gaz: Gazetteer, fuzzy: bool = True) -> DataFrame:
    """Add city, district, state, geocode_method and filled coordinates.

    Coordinates first, then the hint, then the text; a row that is resolved is
    not looked up again.  Given coordinates are kept, each one on its own.
    """
    has_gps = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    step = nearest_city(df, gaz, F.when(has_gps, F.col("lat")), F.when(has_gps, F.col("lon")), "_gps")
    step = step.withColumn("_hint", F.when(F.col("_gps").isNull(), F.col("city_hint")))
    step = find_city(step, gaz, "_hint", "_named", fuzzy)
    open_row = F.col("_gps").isNull() & F.col("_named").isNull()
    step = place_in_text(step, gaz, F.col("text"), "_text", open_row)
    method = (
        F.when(F.col("_gps").isNotNull(), F.lit("gps"))
        .when(F.col("_named").isNotNull(), F.lit("hint"))
        .when(F.col("_text").isNotNull(), F.lit("text"))
        .otherwise(F.lit("none"))
    )
    place = F.coalesce("_gps", "_named", "_text")
    state_only = (place["lat"] == 0) & (place["lon"] == 0)
    city = F.when(~F.coalesce(state_only, F.lit(True)), place)
    keep = [c for c in df.columns if c not in ("city", "district", "state", "geocode_method", "lat", "lon")]
    return step.select(
        *keep,
        F.coalesce("lat", city["lat"]).alias("lat"),
        F.coalesce("lon", city["lon"]).alias("lon"),
        city["city"].alias("city"),
        F.when(city["district"] != "", city["district"]).alias("district"),
        F.coalesce(place["state"], F.col("state_hint")).alias("state"),
        method.alias("geocode_method"),
    )


def media_todo(df: DataFrame, reports: DataFrame) -> DataFrame:
    """Posts whose media still have to be stored, with their first four links."""
    done = reports.filter(F.size("media") > 0).select("source", "external_id")
    return (
        df.filter(F.size("media_urls") > 0)
        .withColumn("media_urls", F.slice("media_urls", 1, V.MEDIA_PER_POST))
        .join(done, ["source", "external_id"], "left_anti")
    )


def priority_cities(cities: DataFrame, priority: list[str], n: int = V.PRIORITY_SAMPLE) -> DataFrame:
    """Named cities in the given order, then the others in file order; ``pos``
    numbers the sample.  Of equal names the first counts (the last, if named)."""
    wanted = cities.sparkSession.createDataFrame([(p, i) for i, p in enumerate(priority)], "city string, prio int")
    one = cities.groupBy("city").agg(
        F.min_by(F.struct("ord", *PLACE[1:]), "ord").alias("first"), F.max_by(F.struct("ord", *PLACE[1:]), "ord").alias("last")
    )
    joined = one.join(wanted, "city", "left")
    chosen = F.when(F.col("prio").isNotNull(), F.col("last")).otherwise(F.col("first"))
    rank = F.struct(F.coalesce("prio", F.lit(1 << 30)).alias("p"), F.col("first.ord").alias("o"))
    top = joined.select("city", chosen.alias("c"), rank.alias("rank")).orderBy("rank").limit(n)
    ordered = top.agg(F.array_sort(F.collect_list(F.struct("rank", "city", "c"))).alias("all"))
    return ordered.select(F.posexplode("all").alias("pos", "e")).select("pos", "e.city", *[f"e.c.{p}" for p in PLACE[1:]])
