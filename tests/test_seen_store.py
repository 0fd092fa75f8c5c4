"""Published keys stored by day: which days are opened, what is published, replays and compaction."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyledger.streaming.seenstore import SeenStore

START = dt.datetime(2024, 1, 1)


def posts(spark, rows):
    return spark.createDataFrame([(s, e, i) for i, (s, e) in enumerate(rows)], "source string, external_id string, n bigint")


def test_only_days_that_may_hold_a_key_are_opened(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path), slots=2, ttl=dt.timedelta(days=30))
    for day in range(6):
        keys = spark.range(200).select(F.lit("rss").alias("source"), F.concat(F.lit(f"{day}-"), "id").alias("external_id"), "id")
        assert store.publish(keys, day, START + dt.timedelta(days=day), ["id"]).count() == 200
        if day == 3:
            store.compact(3)
    wanted = posts(spark, [("rss", "1-7"), ("rss", "5-9"), ("rss", "new"), (None, "1-7"), ("rss", None)])
    assert {"2024-01-02", "2024-01-06"} <= set(store.possible_days(wanted)) and len(store.possible_days(wanted)) <= 3
    files = store.find(wanted).inputFiles()
    assert len(files) < len(store.keys.read().inputFiles()) and all(any(f"day={d}" in f for d in store.possible_days(wanted)) for f in files)
    assert store.possible_days(posts(spark, [("rss", f"unheard-of-{i}") for i in range(20)])) == []
    assert store.find(posts(spark, [("rss", "unheard-of-1")])).inputFiles() == []


@pytest.mark.parametrize("slots", [1, 64])
def test_as_one_by_one(spark, tmp_path, slots):
    rnd = random.Random(slots)
    store, ttl = SeenStore(spark, str(tmp_path), slots=slots, ttl=dt.timedelta(days=7)), dt.timedelta(days=7)
    seen, touched, now = {}, {}, START
    for batch in range(5):
        now += dt.timedelta(days=rnd.choice([1, 5, 8]))
        rows = [(rnd.choice(["a", "b", "c", None][: 1 + batch % 4]), rnd.choice([*map(str, range(12)), None, ""])) for _ in range(30)]
        want = []
        for source in {s for s, _ in rows if s}:
            if source not in touched or now - touched[source] >= ttl:
                seen[source] = set()
            touched[source] = now
        here = set()
        for key in rows:
            known = None not in key and key[1] in seen.get(key[0], ())
            if key not in here and not known:
                want.append(key)
            here.add(key)
        for s, e in want:
            if s and e is not None:
                seen[s].add(e)
        for _again in range(2 if batch == 3 else 1):
            got = store.publish(posts(spark, rows), batch, now, ["n"])
            assert sorted(((r.source, r.external_id) for r in got.collect()), key=str) == sorted(want, key=str)
        if batch == 2:
            store.compact(batch)


def test_an_empty_run(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path))
    assert store.publish(posts(spark, []), 0, START, ["n"]).count() == 0
    assert store.publish(posts(spark, [("a", "1")]), 1, START, ["n"]).count() == 1
    assert store.publish(posts(spark, [("a", "1")]), 2, START, ["n"]).count() == 0
