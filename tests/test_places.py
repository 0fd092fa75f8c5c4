"""Places, loaders, feeds and text cleaning."""

import difflib
import html
import html.entities

from pyspark.sql import functions as F

from skyledger import fixed_values as V
from skyledger.functions import text as X
from skyledger.operators import geocode as G
from skyledger.operators.geocode import Gazetteer
from skyledger.sources import dims, feeds


def names(spark, gaz, values):
    df = spark.createDataFrame([(v,) for v in values], "hint string")
    return {r.hint: r.by_name.city if r.by_name else None for r in G.find_city(df, gaz, "hint").collect()}


def test_names(spark, gaz):
    got = names(spark, gaz, ["Mumbai", "BANGALORE", "दरभंगा", "Hyderabaad", "Atlantis", "Mum", "Pune City", "!!!"])
    assert got == {
        "Mumbai": "Mumbai", "BANGALORE": "Bengaluru", "दरभंगा": "Darbhanga", "Hyderabaad": "Hyderabad", "Atlantis": None,
        "Mum": "Mumbai", "Pune City": "Pune", "!!!": None,
    }


def test_closest_keys_as_one_by_one(spark):
    keys = ["mumbai", "hyderabad", "hyderabat", "bengaluru", "pune", "puna", "thiruvananthapuram", "ab", "abc", "दरभंगा", "aaaaaaaaaa", "newdelhi"]
    unknown = ["mumbay", "mumbbai", "hyderabaad", "hyderaba", "bangaluru", "pun", "punee", "thiruvanantapuram", "thiruvanthapurm", "xyz", "a", "दरभगा", "aaaaaaaaa", "newdehli", "wendelhi"]
    got = G.closest_keys(*[spark.createDataFrame([(k,) for k in ks], "key string") for ks in (unknown, keys)])
    want = {u: m[0] for u in unknown if (m := difflib.get_close_matches(u, keys, n=1, cutoff=V.FUZZY_PLACE_RATIO))}
    assert {r.key: r.near for r in got.collect()} == want and len(want) >= 6


def test_states(spark, gaz):
    df = spark.createDataFrame([("बिहार",), ("Tamil Nadu",), ("Orissa",), ("x",)], "s string")
    got = {r.s: r.state_found for r in G.find_state(df, gaz, "s").collect()}
    assert got == {"बिहार": "Bihar", "Tamil Nadu": "Tamil Nadu", "Orissa": "Odisha", "x": None}


def test_nearest(spark, gaz):
    df = spark.createDataFrame([(19.076, 72.8777), (0.0, 0.0)], "lat double, lon double")
    got = [r.near.city if r.near else None for r in G.nearest_city(df, gaz, F.col("lat"), F.col("lon")).collect()]
    assert sorted(got, key=str) == ["Mumbai", None]


def test_long_name_lists_give_the_same(spark, gaz, monkeypatch):
    texts = ["rain in mumbai and pune", "बिहार में बाढ़", "storm in Banga-lore", "over Tamil Nadu", "nothing", "Thiruvananthapuram to Kochi"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {r.t: r.in_text for r in G.place_in_text(df, gaz, F.col("t")).collect()}
    more = spark.range(100_000).select(
        (F.col("id") + 1000).cast("int").alias("ord"), F.concat(F.lit("Puram "), F.sha2(F.col("id").cast("string"), 256).substr(F.lit(1), (F.col("id") % 9 + 8).cast("int"))).alias("city"),
        F.lit("Far").alias("state"), F.lit("").alias("district"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"),
    )
    other = Gazetteer(gaz.cities.unionByName(more), gaz.aliases)
    monkeypatch.setattr(G, "CHUNK_CHARS", 7)  # texts are searched in many overlapping parts
    got = {r.t: r.in_text for r in G.place_in_text(df, other, F.col("t")).collect()}
    assert got == want and want["nothing"] is None and want["storm in Banga-lore"].city == "Bengaluru"
    named = more.filter("ord IN (1005, 1017, 90000)").select("ord", F.concat(F.lit("x" * 30), F.lower("city"), F.lit("!")).alias("t"))
    found = G.city_in_text(named, other, F.col("t")).join(more.select("ord", F.col("city").alias("wanted")), "ord").collect()
    assert len(found) == 3 and all(r.named.city == r.wanted for r in found)


def test_nearest_among_very_many(spark):
    """Cities crowded in a corner and spread thin elsewhere: the nearest is that of comparing with all, and no list grows with the crowd."""
    import random

    rnd = random.Random(8)
    crowd = [(10 + rnd.random() * 0.01, 20 + rnd.random() * 0.01) for _ in range(3000)] + [(10.5, 20.5)] * 200 + [(rnd.uniform(8, 12), rnd.uniform(18, 22)) for _ in range(200)]
    cities = [(i, f"c{i}", "s", "", a, b) for i, (a, b) in enumerate(crowd)]
    gaz = Gazetteer(spark.createDataFrame(cities, "ord int, city string, state string, district string, lat double, lon double"), None)
    asked = [(rnd.uniform(7, 13), rnd.uniform(17, 23)) for _ in range(150)] + [(10 + rnd.random() * 0.02, 20 + rnd.random() * 0.02) for _ in range(100)] + [(10.5, 20.5), (None, 3.0), (-89.9, 179.9)]
    df = spark.createDataFrame(asked * 2, "a double, b double")
    got = G.nearest_city(df, gaz, F.col("a"), F.col("b")).collect()
    assert len(got) == len(asked) * 2 and df.columns + ["near"] == G.nearest_city(df, gaz, F.col("a"), F.col("b")).columns
    for r in got:
        best = min(((a - r.a) ** 2 + ((b - r.b) * V.LON_SHRINK) ** 2, i) for i, (a, b) in enumerate(crowd)) if r.a is not None else (9e9, 0)
        assert (r.near and r.near.city) == (f"c{best[1]}" if best[0] < V.NEAREST_CITY_DEGREES**2 else None)
    assert len(gaz.cells) > 5 and all((c.agg(F.max(F.size("held"))).first()[0] or 0) <= G.FEW for c in gaz.cells)


def test_short_and_empty_squeezed_names(spark, gaz):
    places = [(0, "Sydney", "N.S.W.", "", -33.9, 151.2), (1, "Patna", "बिहार राज्य", "", 25.6, 85.1), (2, "Perth", "W. A. !", "", -31.9, 115.9)]
    cities = spark.createDataFrame(places, "ord int, city string, state string, district string, lat double, lon double")
    texts = ["floods in N.S.W. today", "nsw", "dry in w.a.", "Sydney", "nothing", "", "ns", "over Tamil Nadu"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    small = Gazetteer(cities, gaz.aliases)
    got = {r.t: r.p.city if r.p else None for r in G.place_in_text(df, small, F.col("t"), "p").collect()}
    assert got == {
        "floods in N.S.W. today": "N.S.W.", "nsw": "N.S.W.", "dry in w.a.": "W. A. !", "Sydney": "Sydney", "nothing": None, "": None, "ns": None,
        "over Tamil Nadu": None,
    }
    named = {r.t: r.p.city if r.p else None for r in G.alias_in_text(df, small, F.col("t"), "p").collect()}
    assert named == got | {"Sydney": None}


def test_clean_html(spark):
    rows = ["<p>a &amp;lt; b</p><br/>c&nbsp;d", "x&eacute;&#8217;y &copy z", " \t plain \n\n\n\n text  ", "&lt;b&gt; &unknown; 1 < 2"]
    got = [r.c for r in spark.createDataFrame([(r,) for r in rows], "t string").select(X.clean_html(F.col("t")).alias("c")).collect()]
    assert got[0] == "a &lt; b\n\nc d" and got[1] == html.unescape("x&eacute;&#8217;y &copy z")
    assert got[2] == "plain \n\n text" and got[3] == "<b> &unknown; 1 < 2"


def test_entities_as_the_standard_table_has_them(spark):
    rows = ["&notit; &amp;lt; &", "&#0;&#128;&#x80;&#xD800;&#x110000;&#99999999999999;&#x1F600;", "&#1;&#11;&#xfdd0;&#x1ffff;&#x00041;&#0065 ", "&;&#;&#x;&&eacute", "&lt&gt;&ampx", ""]
    rows += [f"&{name} z &{name}" for name in html.entities.html5] + [f"&#{n};" for n in [*range(300), 0xFFFE, 0x10FFFE]]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", X.unescape_html(F.col("t")).alias("c"))
    assert [(r.t, r.c) for r in df.collect() if r.c != html.unescape(r.t)] == []


def test_loaders(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("# c\n+0.3\tHuge Claim\nbad line\nx\ty\n-0.2\tmeasured\n", encoding="utf-8")
    (tmp_path / "tags.txt").write_text("# note\n#Rain\n\n##rain\n#बाढ़\n", encoding="utf-8")
    (tmp_path / "alias.csv").write_text("alias,kind,target\n# c\nBombay,city,Mumbai\nbombay,CITY,Pune\nx,river,y\n", encoding="utf-8")
    lex = dims.lexicon_rows(dims.load_lexicon(spark, str(tmp_path / "lex.txt")))
    assert lex == [(0.3, "huge claim"), (-0.2, "measured")]
    assert {r.tag for r in dims.load_hashtags(spark, str(tmp_path / "tags.txt")).collect()} == {"rain", "बाढ़"}
    assert [(r.alias, r.kind, r.target) for r in dims.load_aliases(spark, str(tmp_path / "alias.csv")).collect()] == [("bombay", "city", "Mumbai")]


def test_a_large_file_is_read_in_splits(spark, tmp_path):
    lines = ["" if i % 7 == 0 else "x" * (i % 50) + str(i) for i in range(3_000)]
    (tmp_path / "lines.txt").write_text("\n".join(lines) + "\n" * 2_000, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path / "lines.txt")).rdd.getNumPartitions() > 20
        got = sorted((r.ord, r.line) for r in dims._numbered_lines(spark, str(tmp_path / "lines.txt")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [line for _ord, line in got][:3_000] == lines and len({n for n, _line in got}) == len(got) == 4_999 and got[0][0] == 0


def test_mail_dates(spark):
    rows = ["Mon, 01 Jan 2024 10:00:00 +0530", "1 Feb 2024 00:00:00 GMT", "soon", None]
    got = [r.d for r in spark.createDataFrame([(r,) for r in rows], "t string").select(feeds.mail_date(F.col("t")).cast("timestamp_ntz").cast("string").alias("d")).collect()]
    assert got == ["2024-01-01 04:30:00", "2024-02-01 00:00:00", None, None]
