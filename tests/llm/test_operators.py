"""The ten operators on the edge table (nulls, blanks, long texts, ties, repeats, clashing names) against one-by-one versions."""

import hashlib
import re
import types
import zlib
from collections import Counter, defaultdict

import check
import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from skyledger.llm import ann, components, decontam, fmindex, langid, linededup, mixing, sharding, simhash, simple8b, substring, tokencount, tokenpack

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def by_sql(sql, **tables):
    """Rows of a check statement over DataFrames."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    return check.rows_of([d[0] for d in cur.description], cur.fetchall())


def same(df, want):
    assert check.rows_of(df.columns, df.collect()) == want


def pairs(edge):
    return [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]


@pytest.mark.parametrize("run, sql", [(substring.digest, substring.SQL), (linededup.digest, linededup.SQL), (mixing.mix, mixing.SQL)], ids=["substring", "lines", "mixing"])
def test_edges_by_sql(edge, nothing, run, sql):
    same(run(edge), by_sql(sql, documents=edge.select("doc_id", "text", "source")))
    assert run(nothing).count() == 0


@pytest.mark.parametrize("length", [1, 2, 5, 10, 49, 100, 200, 300])
def test_substrings_of_any_length(spark, length):
    """Shared passages, edited copies and texts of one repeated word, against windows one by one."""
    def w(seed, n):
        return [f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n)]

    base = w(1, 450)
    texts = [base, w(2, 30) + base[:400], base[25:430] + w(3, 40), base[:200] + ["edit"] + base[201:], ["same"] * 700, ["same"] * 350 + ["end"], w(4, 20) + ["same"] * 310, base]
    docs = spark.createDataFrame([(10 - i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in substring.dedup_substrings(docs, length=length).collect()}
    first: dict = {}
    by_id = {10 - i: t for i, t in enumerate(texts)}
    for doc_id in sorted(by_id):
        for i in range(len(by_id[doc_id]) - length + 1):
            first.setdefault(tuple(by_id[doc_id][i : i + length]), doc_id)
    for doc_id, t in by_id.items():
        gone = set()
        for i in range(len(t) - length + 1):
            if first[tuple(t[i : i + length])] < doc_id:
                gone.update(range(i, i + length))
        assert got[doc_id] == (len(gone), " ".join(x for i, x in enumerate(t) if i not in gone)), (length, doc_id)


def test_decontamination(edge, nothing, items):
    # items without an id count but are not listed
    want = by_sql(decontam.SQL, documents=edge.select("doc_id", "text"), benchmark=items)
    same(decontam.digest(edge, items), want)
    assert decontam.digest(nothing, items).count() == 0
    assert decontam.digest(edge, items.limit(0)).filter("contaminated OR n_items > 0").count() == 0
    kept = decontam.clean(edge, items)
    assert kept.columns == edge.columns
    assert kept.count() == sum(1 for r in decontam.digest(edge, items).collect() if not r.contaminated)
    small = decontam.find_leaks(edge, items, shard_bytes=200, block_bytes=10)  # many shards and blocks
    assert Counter((r.doc_id, r.n_hit, r.n_items) for r in small.collect()) == Counter((r.doc_id, r.n_hit, r.n_items) for r in decontam.find_leaks(edge, items).collect())


@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_index_finds_all_places(text, pattern):
    symbols = np.array([*text, 0], np.int64)
    assert fmindex.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
    if max(pattern) <= symbols.max():
        index = fmindex.FMIndex(symbols, sample=3)
        lo, hi = index.search(np.array([pattern]))
        want = [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


@given(st.lists(st.integers(1, 3), max_size=60))
@settings(max_examples=60, deadline=None)
def test_suffixes_of_large_symbols(text):
    symbols = np.array([*((x * 7) << 21 | x for x in text), 0], np.int64)
    assert fmindex.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())


def test_a_document_of_very_many_distinct_words():
    """More than 2 ** 21 distinct words: every window is found where it stands."""
    count = (1 << 21) + 200_000
    text = b" ".join(b"%x" % i for i in range(count))
    item = b" ".join(b"%x" % i for i in range(count - 60, count - 40))
    windows = decontam.Windows([("1", item)], decontam.WINDOW)
    n_words, n_hit, items, spans, _ = decontam._scan([b"a b c", text], [types.SimpleNamespace(value=windows)])
    assert n_words.tolist() == [3, count] and n_hit.tolist() == [0, 20] and items == [[], ["1"]]
    assert spans == [[], [{"start": count - 60, "past": count - 40}]]


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.integers(0, 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(ids):
    words, escaped = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(words, escaped, len(ids)).tolist() == ids


def test_token_blocks(edge, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(tokenpack.round_trip(edge).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in pairs(edge)), key=lambda i: (i is not None, i))
    want = Counter()
    for i, t in pairs(edge):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert tokenpack.round_trip(nothing).count() == 0


def test_token_counts(edge, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(edge))
    got = tokencount.count_tokens(edge).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokencount.count_tokens(nothing).count() == 0


@given(st.lists(st.text(st.sampled_from("ab AB'sStT1²éÉßİΣſ中 \x1c\x85\xa0\n.,!<|>"), max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_tokenizers_agree_on_odd_texts(texts):
    import pyarrow as pa

    texts = [*texts, "x<|endoftext|>y", "aaaaaaaaaaaaaaa"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokencount.Counter(path)(texts) == [len(e.ids) for e in LIBRARY[path].encode_batch(texts, add_special_tokens=False)]
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, n = tokenpack.word_ids(path)(pa.array(texts))
    assert ids.tolist() == [i for e in LIBRARY[path].encode_batch(texts, add_special_tokens=False) for i in [*e.ids, 1]]


LIBRARY = {p: Tokenizer.from_file(p) for p in map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))}


def test_language(spark, sf_dir, edge, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = dict(docs.select("doc_id", "lang").collect())
    got = langid.predict(docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    model = langid.train(docs)
    by_doc = defaultdict(list)
    for r in langid.predict(edge, model).collect():
        by_doc[r.doc_id].append(r)
        assert 0 <= r.score <= 1
    assert all(by_doc[i][0].lang_pred == "und" and by_doc[i][0].score == 0 for i in (1, 2, 3, 4))
    assert by_doc[5][0].lang_pred in model.langs and not by_doc[None][0].held_out
    assert langid.keep(edge, model).columns == edge.columns
    assert langid.predict(nothing).count() == 0
    assert {r.lang_pred for r in langid.predict(edge.drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


def test_language_probabilities_sum_to_one(spark, sf_dir):
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = np.exp(-model.cost.reshape(-1, model.width, len(model.langs)).astype(float)).sum(1)
    assert np.allclose(rows, 1, atol=1e-3)


def shards_one_by_one(docs, shards, vnodes):
    """The walk of single rows, home arcs first, one step further per round."""
    points = sorted((int(hashlib.md5(f"shard/{s}/{v}".encode()).hexdigest()[:15], 16), s, v) for s in range(shards) for v in range(vnodes))
    owner = [s for _, s, _ in points] + [points[0][1]]
    room = sharding.capacities(len(docs), shards)
    at = [p for p, _, _ in points]
    waiting = [(int(np.searchsorted(at, r[0], side="right")), r) for r in sorted(docs, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3]))]
    placed, step = Counter(), 0
    while waiting:
        still = []
        for arc, row in waiting:
            shard = owner[(arc + step) % len(owner)]
            if room[shard]:
                room[shard] -= 1
                placed[row[1], row[2], shard] += 1
            else:
                still.append((arc, row))
        waiting, step = still, step + 1
    return placed


def test_sharding(spark, sf_dir, edge, nothing):
    from pyspark.sql import functions as F

    for docs in (edge, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = sharding.shard_rows(docs).collect()
        counts = Counter(r.shard for r in got)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        rows = docs.select((F.xxhash64("text").bitwiseAND((1 << 60) - 1)).alias("h"), "doc_id", "text").collect()
        plain = [(r.h, r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in rows]
        assert Counter((r.doc_id, r.text_crc32, r.shard) for r in got) == shards_one_by_one(plain, 24, 64)
        assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for _, i, _, n in plain)
    assert sharding.shard_rows(nothing).count() == 0


def test_mixing_totals_and_repeats(edge, nothing):
    got = mixing.mix(edge).collect()
    source = {(i, n): s for s, i, n in ((r.source, r.doc_id, len(SPLIT.findall(r.text or ""))) for r in edge.collect())}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id, r.size]] += r.taken
        target[source[r.doc_id, r.size]] = r.target
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    words = lambda t: SPLIT.findall(t or "")
    whole = Counter()
    for r in mixing.take(edge).collect():
        whole[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert +whole == +want
    assert mixing.take(edge).columns == edge.columns and mixing.take(nothing).count() == 0


def fingerprint(text):
    words = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """Root by value, one pair at a time."""
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {f: new if r == old else r for f, r in root.items()}
    return root


def test_simhash(edge, nothing):
    docs = pairs(edge)
    fps = [fingerprint(t) for _, t in docs]
    root = linked(set(fps))
    least = {}
    for (i, _), f in zip(docs, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(docs, fps))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edge).collect()) == want
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(root[fingerprint(r.text)] for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


@pytest.mark.parametrize("crowd", [0, 3, 10_000])
def test_simhash_links_of_crowds(spark, crowd):
    rng = np.random.default_rng(crowd)
    centres = rng.integers(0, 2**63, 6, dtype=np.int64)
    fps = {0, -1}
    for c in centres.tolist():
        for _ in range(40):
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                c ^= (1 << b) - (1 << 64 if b == 63 else 0)
            fps.add(c)
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(classes, crowd=crowd)).collect()}
    want = linked({f % (1 << 64) for f in fps})
    groups = lambda d: Counter(frozenset(k for k in d if d[k] == v) for v in set(d.values()))
    got = {f % (1 << 64): roots.get(f, f) for f in fps}
    assert groups(got) == groups(want)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_thresholds_are_the_best():
    import itertools

    rng = np.random.default_rng(0)
    counts = rng.integers(1, 500, (50, 3)).astype(float)
    widths, n = [22, 21, 21], 10_000

    def cost(row, t):
        probes = [1, 1 + widths[0], 0]
        total = 0.0
        for c, w, r in zip(row, widths, t):
            if r >= 0:
                probes = sum(len(list(itertools.combinations(range(w), k))) for k in range(r + 1))
                total += c + probes + (probes - 1) * n / 2**w
        return total

    options = [t for t in itertools.product(range(-1, 3), repeat=3) if sum(t) == 0]
    for row, t in zip(counts, simhash.allocate(counts, widths, n, 2)):
        assert sum(t) == 0 and cost(row, t) == pytest.approx(min(cost(row, o) for o in options))


def test_hilbert_curve_visits_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = ann.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def exact_nearest(rows, k=20):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            order = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i))[:k]
            out[i] = [j for _, j in order]
    return out


def test_nearest(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    want, got = exact_nearest(rows), defaultdict(list)
    vectors = dict(rows)
    for r in sorted(ann.nearest(table).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and abs(np.dot(vectors[r.query_id], vectors[r.vec_id]) - r.score) < 1e-12
    found = sum(len(set(want[q]) & set(got[q])) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))


def test_nearest_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    same = [1.0, 2.0, 0.5, 0.0]
    rows = [(i, same, "z") for i in range(60)] + [(100 + i, rng.normal(size=4).tolist(), "z") for i in range(40)]
    odd = [(200, None, "z"), (220, [0.0] * 4, "z"), (240, [float("nan"), 1.0, 1.0, 1.0], "z"), (260, [float("inf"), 0.0, 0.0, 0.0], "z"), (280, [None, 1.0, 1.0, 1.0], "z"), (None, same, "z"), (300, [1.0], "z"), (0, same, "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert dict(got) == exact_nearest([(i, np.array(v)) for i, v, _ in rows])
    assert ann.nearest(df.limit(0)).count() == 0


def test_other_tokenizer_files_are_refused(edge):
    for path in (public_tokenizers.path("word_bpe_49k.json"),):
        with pytest.raises(ValueError, match="pre_tokenizer"):
            tokencount.count_tokens(edge, path)
    with pytest.raises(ValueError, match="pre_tokenizer"):
        tokenpack.round_trip(edge, public_tokenizers.path("byte_bpe_50k.json"))


def test_line_runs_leave_no_table(edge):
    spark = edge.sparkSession
    before = {t.name for t in spark.catalog.listTables()}
    assert linededup.dedup_lines(edge).count() == edge.count()
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")} <= before


def plain_ppm(trained, langs, text):
    """Code lengths (nats) of a text by PPM with escape method C and exclusion, byte by byte from counts in dictionaries."""
    seen = sorted({b for _, t in trained for b in t})
    code = {b: i + 1 for i, b in enumerate(seen)}
    width = len(seen) + 1
    counts = {lang: [defaultdict(Counter) for _ in range(4)] for lang in langs}
    for lang, t in trained:
        c = [0, 0, 0, *(code[b] for b in t)]
        for i in range(3, len(c)):
            for order in range(4):
                counts[lang][order][tuple(c[i - order : i])][c[i]] += 1

    def shares(lang, context):
        out = {s: 1 / width for s in range(width)}
        for order in range(4):
            tail = context[3 - order :]
            after = counts[lang][order].get(tail)
            if not after:
                continue
            room = sum(p for s, p in out.items() if s not in after)
            whole = sum(after.values()) + (len(after) if room else 0)
            out = {s: after[s] / whole if s in after else len(after) / whole * p / room for s, p in out.items()}
        return out

    c = [0, 0, 0, *(code.get(b, 0) for b in text)]
    return [-sum(np.log(shares(lang, tuple(c[i - 3 : i]))[c[i]]) for i in range(3, len(c))) for lang in langs]


def test_code_lengths_are_those_of_a_plain_coder():
    trained = [("a", b"the cat sat on the mat, the cat sat"), ("a", b"that hat"), ("b", b"der Hund und der Hase und der Hahn"), ("b", "größer".encode()), ("c", b"x")]
    rows = Counter()
    for lang, t in trained:
        b = b"\0\0\0" + t
        for i in range(3, len(b)):
            rows["abc".index(lang), int.from_bytes(b[i - 3 : i + 1], "big")] += 1
    keys = sorted(rows)
    model = langid.Model(["a", "b", "c"], np.array([g for _, g in keys]), np.array([k for k, _ in keys]), np.array([rows[k] for k in keys]))
    texts = [b"the hat", b"der Hut und", "übergroß zzz".encode(), b"x", b"th", b"cat sat on the mat, the cat"]
    for text, got in zip(texts, model.lengths(texts)):
        assert np.allclose(got, plain_ppm(trained, "abc", text), rtol=1e-5), text


def test_repeated_ids_teach_the_same_in_any_order(spark):
    rows = [(i, f"text number {i} in words", "en") for i in range(30)] + [(i, f"anders {i} gesagt", "de") for i in range(30)]
    models = [langid.train(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n)) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert models[0].langs == models[1].langs and np.array_equal(models[0].cost, models[1].cost)
