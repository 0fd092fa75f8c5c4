"""Published keys of all runs, stored by the day they were added, with a bit summary per day that tells which days can hold a key.

A day's summary is a Bloom filter cut into bitmaps of 4 KB, written by the batch that adds the keys and joined by OR when days are compacted.
A run looks its keys up in the summaries first and opens the folders of the days that may hold one; the others stay closed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger import fixed_values as V
from skyledger.operators.merge import KEY, first_per_key
from skyledger.session import materialise
from skyledger.streaming.daylog import DayLog

#: Bits of one bitmap, as Spark's bitmap functions have them, and bits that a key sets.
BITMAP_BITS = 32_768
HASHES = 4


def _instant(now: dt.datetime) -> Column:
    return F.lit(now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc))


def _or_bits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "slot").agg(F.bitmap_or_agg("bits").alias("bits")).select("slot", "bits", "day")


def _last_life(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("since", "at", "day"), "at").alias("r")
    return rows.groupBy("source").agg(last).select("source", "r.since", "r.at", "r.day")


@dataclass(frozen=True, eq=False)
class SeenStore:
    """``slots`` bitmaps a day: about eight bits for each key that a day may get keep nearly all other days closed, and a
    fuller day costs reads, never answers.  The number is one of the store, so it must not change under a path."""

    spark: SparkSession
    path: str
    slots: int = 1024
    ttl: dt.timedelta = dt.timedelta(days=V.SEEN_TTL_DAYS)

    @property
    def keys(self) -> DayLog:
        return DayLog(self.spark, f"{self.path}/keys", "source string, external_id string, added timestamp")

    @property
    def marks(self) -> DayLog:
        return DayLog(self.spark, f"{self.path}/marks", "slot bigint, bits binary", _or_bits)

    @property
    def lives(self) -> DayLog:
        return DayLog(self.spark, f"{self.path}/lives", "source string, since timestamp, at timestamp", _last_life)

    def _positions(self) -> Column:
        """The bits of a key; parts are hashed apart, so no two keys run into one another."""
        size = F.lit(self.slots * BITMAP_BITS)
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), F.xxhash64("source"), F.xxhash64("external_id")), size) for i in range(HASHES)])

    def possible_days(self, wanted: DataFrame, before: int | None = None) -> list[str]:
        """Days whose summary has all bits of some key of ``wanted``; no more than there are days."""
        bits = wanted.select(*KEY, F.explode(F.array_distinct(self._positions())).alias("at"))
        bits = bits.select(*KEY, F.shiftright("at", 15).alias("slot"), F.col("at").bitwiseAND(BITMAP_BITS - 1).alias("bit"), F.size(F.array_distinct(self._positions())).alias("needed"))
        met = bits.join(self.marks.read(before, with_day=True), "slot")
        byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("bigint")
        hit = met.filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
        # the parts of one day that batches wrote apart count as one summary
        per_key = hit.groupBy(*KEY, "day").agg(F.count_distinct("slot", "bit").alias("n"), F.first("needed").alias("needed")).filter("n = needed")
        return sorted(str(r.day) for r in per_key.select("day").distinct().collect())

    def find(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """Stored rows (source, external_id, added) of the days that may hold a key of ``wanted``."""
        return self.keys.read(before, days=self.possible_days(wanted, before))

    def publish(self, posts: DataFrame, batch_id: int, now: dt.datetime, arrival: list[str]) -> DataFrame:
        """Posts not published before, first of each key by ``arrival``; they count as published from now on.

        A source's keys live until no run touched the source for the time limit; each run renews it.  What a source published in an
        earlier life does not come back.  Posts with a null in the key are never known.  A replay of a batch gives the same.
        """
        first = materialise(first_per_key(posts, KEY, arrival), "seen-arrived")
        lives = _last_life(self.lives.read(batch_id, with_day=True))
        alive = lives.filter(F.col("at") > _instant(now) - F.lit(self.ttl)).select("source", "since")
        alive = materialise(alive, "seen-alive")
        wanted = first.select(*KEY).join(alive, "source", "left_semi")
        known = self.find(wanted, batch_id).join(alive, "source").filter("added >= since")
        kept = materialise(first.join(known.select(*KEY), KEY, "left_anti"), "seen-kept")
        added = kept.select(*KEY, _instant(now).alias("added")).filter("source IS NOT NULL AND external_id IS NOT NULL")
        self.keys.append(added, batch_id, F.col("added"))
        bits = added.select(F.to_date("added").alias("of"), F.explode(self._positions()).alias("at"))
        marks = bits.groupBy("of", F.shiftright("at", 15).alias("slot")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(BITMAP_BITS - 1)).alias("bits"))
        self.marks.append(marks, batch_id, F.col("of"))
        ran = first.filter("source IS NOT NULL").select("source").distinct().join(alive, "source", "left")
        self.lives.append(ran.select("source", F.coalesce("since", _instant(now)).alias("since"), _instant(now).alias("at")), batch_id, F.col("at"))
        return kept

    def compact(self, upto: int) -> None:
        """Join the parts of the batches up to ``upto``, day by day."""
        for log in (self.keys, self.marks, self.lives):
            log.compact(upto)
