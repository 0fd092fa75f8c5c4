"""Conversation trie, hard negatives and URL verdicts on odd rows, against SQL and one-by-one versions."""

import math
import random

import check
import pytest
from test_operators import by_sql, same

from skyledger.llm import hardneg, turntrie, urlfilter

CONVS = "conv_id long, turn long, role string, text string, block string, depth string, t1 long"
VECS = "vec_id long, embedding array<float>, label int, rows string, part long"
PAGES = "page_id long, url string, html string, host string, bound string"
LABELS = "doc_id long, quality int, toxic int, n string"


def conversations():
    out = []

    def talk(conv, *turns):
        out.extend((conv, i, role, text) for i, (role, text) in enumerate(turns))

    for conv in range(100, 130):
        talk(conv, ("system", "be kind"), ("user", f"question {conv % 4}"), ("assistant", "Ünïcode 中文 answer"), ("user", f"more {conv % 2}"))
    talk(200, *[("user", f"a turn {i}") for i in range(70)])
    for conv in (201, 202, 203, 207):
        talk(conv, *[("user", f"a turn {i}") for i in range(60 + conv % 3)], ("user", ""))
    talk(301, ("user", "no family head"))
    talk(-7, ("user", "negative"), ("user", "id"))
    talk(0, ("user", "x" * 50_000), ("", "ab"), ("a", "b"))
    out += [(5, None, "user", "null turn first"), (5, 3, None, None), (5, 3, "user", "tie"), (5, 3, "user", "tie"), (5, -4, "user", "below zero")]
    out += [(None, 1, "user", "no id"), (None, None, None, None), (6, None, None, None), (4096, 0, "u", "far"), (9000, 0, "u", "far")]
    return [(*row, "z", "y", i) for i, row in enumerate(out)]


def test_trie(spark):
    convs = spark.createDataFrame(conversations(), CONVS).repartition(5)
    want = by_sql(turntrie.SQL, conversations=convs)
    same(turntrie.digest(convs), want)
    assert any(r[want[0].index("depth")] == repr(70.0) for r in want[1])
    plain = turntrie.prefix_trie(convs)
    assert plain.columns == turntrie.COLUMNS
    none = spark.createDataFrame([], CONVS)
    assert turntrie.digest(none).count() == turntrie.prefix_trie(none).count() == 0


def test_trie_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "SEGMENT", 3)
    monkeypatch.setattr(turntrie, "WIDTH", 2)
    monkeypatch.setattr(turntrie, "PIECE", 2)
    convs = spark.createDataFrame(conversations(), CONVS)
    same(turntrie.digest(convs), by_sql(turntrie.SQL, conversations=convs))


def plain_trie(talks):
    """Nodes by conversation and depth from {conv_id: [(role, text)]}."""
    members = {}
    for conv, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = {}
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        out[min(convs), len(path)] = (min(members[path[:-1]]) if path else None, len(convs), len(kids), len(leaves), saved)
    return out


def test_trie_one_by_one(spark):
    rng = random.Random(3)
    talks = {c: [(rng.choice("ab"), rng.choice(["x", "yy"])) for _ in range(rng.randrange(1, 20))] for c in range(60)}
    rows = [(c, i, role, text, "z", "y", 0) for c, turns in talks.items() for i, (role, text) in enumerate(turns)]
    got = turntrie.prefix_trie(spark.createDataFrame(rows, CONVS)).collect()
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got} == plain_trie(talks)
    assert len(got) == len({(r.conv_id, r.depth) for r in got})


def vectors(spark, n=900, copies=300):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.randrange(10)) for i in range(n)]
    rows += [(n + i, [0.5] * 6, i % 3) for i in range(copies)]  # ties
    rows += [(5000, [0.0] * 6, 1), (5100, [-1.0] * 6, 2), (5001, [1e7] * 6, 3), (5200, [1e6] * 6, 3), (5300, [1e30] * 6, 3)]
    rows += [(6000, None, 1), (6100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (6200, [math.nan] * 6, 1), (6300, [math.inf] * 6, 1), (6400, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(100, [0.25] * 6, 4), (200, rows[200][1], rows[200][2]), (200, rows[200][1], rows[200][2])]  # repeated ids
    return spark.createDataFrame([(*r, "z", 0) for r in rows], VECS)


def fitting(df):
    """Without vectors so long that they take no part."""
    return df.filter("vec_id IS NULL OR vec_id NOT IN (5001, 5300)")


@pytest.mark.parametrize("part_rows, group_parts, step", [(256, 32, 512), (2, 1, 7)])
def test_hard_negatives(spark, monkeypatch, part_rows, group_parts, step):
    monkeypatch.setattr(hardneg, "PART_ROWS", part_rows)
    monkeypatch.setattr(hardneg, "STEP", step)
    vecs = vectors(spark)
    got = hardneg.mine(vecs, hardneg.shifted_label(), group_parts=group_parts)
    same(got, by_sql(hardneg.SQL, embeddings=fitting(vecs)))


def test_hard_negatives_of_nothing(spark):
    assert hardneg.mine(spark.createDataFrame([], VECS)).count() == 0
    assert hardneg.mine(vectors(spark).filter("vec_id % 100 = 1")).count() == 0


def test_hard_negatives_of_other_lengths(spark):
    rows = [(0, [1.0, 1.0], 1), (1, [1.0], 1), (2, [0.9, 0.0, 7.0], 2), (3, [], 2), (4, [1.0, 1.0], 2)]
    got = hardneg.mine(spark.createDataFrame([(*r, "z", 0) for r in rows], VECS)).collect()
    assert [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got] == [(0, 1, 1, 2, 65536, 230 * 256)]


def test_a_walk_stops_when_certified():
    """Members of a narrow cluster leave the list long before its end, with the same best rows."""
    import numpy as np

    rng = np.random.default_rng(0)
    candidates = rng.integers(-200, 200, (4000, 8))
    members = candidates[:3] + rng.integers(-3, 3, (3, 8))
    units, _ = hardneg._directions(members[:1] + np.zeros((3, 8), np.int64))
    centre = units[0]
    radius = float(np.arccos(np.clip(hardneg._directions(members)[0] @ centre, -1, 1)).max())
    ids = np.arange(4000)
    row = hardneg._packed(ids, ids, candidates) | {f"a_{k}": v for k, v in hardneg._packed(np.arange(3), np.arange(3), members).items()} | {"a_centre": centre.tobytes(), "a_radius": radius}
    best, seen = hardneg.Best(3, 5), []

    def hits(active, scores, ids, labels):
        seen.append(len(ids) * len(active))
        who, what = np.nonzero(scores >= best.floor[active][:, None])
        best.add(active[who], scores[who, what].astype(np.int64), ids[what])

    hardneg.walk(row, hits, lambda: best.floor)
    assert sum(seen) < 3 * 4000
    for m in range(3):
        scores = candidates @ members[m]
        assert best.ids[m].tolist() == np.lexsort((ids, -scores))[:5].tolist()


URLS = [
    None, "", "no scheme", "://", "http://", "http://Example.NET", "http://example.net/", "http://example.net/en/x?y#z", "http://a.b.example.net/en/", "http://notexample.net/en/1",
    "http://example.com/de", "http://EXAMPLE.com/de/1", "http://x.org/fr/9#q", "http://org/fr/", "http://x.org?/fr/", "http://ÄB.de/Ä", "http://10.0.0.1:80/x", "http://u@h.co.uk:8/x", "http://a.co.uk./",
    "a://b://c/d", "http://" + "a." * 3000 + "net/" + "p" * 20_000, "http://[::1]:80/x", "http://\nx/\ny",
]


def test_urls(spark):
    rng = random.Random(5)
    pages = [(i, u, "<p>", "z", "y") for i, u in enumerate(URLS)] + [(None, URLS[7], None, None, None), (3, URLS[9], None, None, None), (3, URLS[9], None, None, None)]
    pages += [(1000 + i, f"http://h{i % 7}.example.info/{i}", None, None, None) for i in range(400)]
    labels = [(p, rng.randrange(2), rng.choice([0, 0, 0, 1]), "z") for p in range(0, 1400, 2)] + [(3, None, None, "z"), (5, None, 1, "z"), (7, 0, None, "z"), (None, 0, 1, "z"), (8, 1, 0, "z"), (8, 0, 0, "z")]
    pages, labels = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    rules = urlfilter.rule_table(spark)
    got = urlfilter.judge(pages, urlfilter.label_outcomes(labels), rules)
    same(got, by_sql(urlfilter.SQL, pages=pages, labels=labels))
    assert got.count() == pages.count()
    none = labels.limit(0)
    assert urlfilter.judge(pages, urlfilter.label_outcomes(none), rules).filter("rule IS NULL AND verdict <> 'allow'").count() == 0
    assert urlfilter.judge(pages.limit(0), urlfilter.label_outcomes(labels), rules).count() == 0
    assert urlfilter.judge(pages, urlfilter.label_outcomes(labels), urlfilter.rule_table(spark, ())).filter("rule IS NOT NULL").count() == 0


def test_reputation_needs_evidence(spark):
    """A host with many bad pages is blocked; one with two is not, and neither are the good hosts beside them."""
    rows, bad = [], []

    def host(name, n, n_bad):
        for i in range(n):
            rows.append((len(rows), f"https://{name}/{i}", None, None, None))
            bad.append((len(rows) - 1, 1, int(i < n_bad), None))

    for i in range(40):
        host(f"h{i}.good{i % 5}.example", 50, 3)
    host("spam.mixed.example", 200, 180)
    host("two.good0.example", 2, 2)
    host("fine.mixed.example", 200, 5)
    for i in range(8):
        host(f"s{i}.farm.test", 30, 29)
    host("new.farm.test", 1, 0)
    out = urlfilter.judge(spark.createDataFrame(rows, PAGES), urlfilter.label_outcomes(spark.createDataFrame(bad, LABELS)), urlfilter.rule_table(spark, ()))
    verdicts = {(r.host, r.verdict) for r in out.collect()}
    blocked = {h for h, v in verdicts if v == "block"}
    assert {"spam.mixed.example"} | {f"s{i}.farm.test" for i in range(8)} <= blocked
    assert not {"two.good0.example", "fine.mixed.example"} & blocked and not any("good" in h for h in blocked)


def test_rules_like_one_by_one(spark):
    rng = random.Random(9)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "com", "a", "xa.com"]
    paths = ["", "/", "/p", "/p/q", "/p/qr", "/pq/"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(40)]
    urls = [(h, p) for h in hosts for p in paths]

    def plain(host, path):
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else None

    got = urlfilter.match_rules(spark.createDataFrame(urls, "host string, path string"), spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert {(r.host, r.path): (r.rule, r.ruled) for r in got.collect()} == {(h, p): plain(h, p) for h, p in urls if plain(h, p)}
