"""The pipeline's stages on the given documents, each against a plain version on its own input."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from skyledger.session import materialise

import __spark_entry__ as E

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir):
    from test_operators import fingerprint, linked

    docs = pipeline.table(spark, sf_dir, "documents")
    columns, steps = docs.columns, dict(pipeline.STAGES)
    known = materialise(steps["language"](spark, docs, sf_dir), "t")
    assert known.columns == columns and known.count() == docs.filter("text RLIKE '\\\\p{L}'").count()

    one = materialise(steps["near_duplicates"](spark, known, sf_dir), "t")
    fps = {r.doc_id: fingerprint(r.text) for r in known.collect()}
    root, least = linked(set(fps.values())), {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(least.values())

    clean = materialise(steps["decontaminate"](spark, one, sf_dir), "t")
    fold = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)).translate({c: c + 32 for c in range(65, 91)}) + " "
    windows = set()
    for r in pipeline.table(spark, sf_dir, "benchmark").collect():
        w = fold(r.text).split()
        windows |= {f" {' '.join(w[i : i + 10])} " for i in range(max(1, len(w) - 9)) if w}
    want = sorted(r.doc_id for r in one.collect() if not any(x in fold(r.text) for x in windows))
    assert sorted(r.doc_id for r in clean.collect()) == want

    mixed = materialise(steps["mix"](spark, clean, sf_dir), "t")
    n = lambda df: sum(len(WORD.findall(r.text)) for r in df.collect())
    assert mixed.columns == columns and abs(n(mixed) - 1.5 * n(clean)) <= 20

    out = steps["shard"](spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())


def test_run_is_registered(spark, sf_dir):
    assert E.queries()["pipeline"] is pipeline.run
    assert pipeline.run(spark, sf_dir).count() > 0


def test_junk_leaves_the_language_stage(spark, sf_dir):
    """Texts of no learned language go, clean ones stay; empty tables and clashing columns pass."""
    import base64
    import random

    from skyledger.llm import langid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    rnd = random.Random(0)
    junk = [
        "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(300)), " ".join("".join(chr(rnd.randrange(0x430, 0x450)) for _ in range(7)) for _ in range(60)),
        base64.b64encode(rnd.randbytes(600)).decode(), "".join(chr(rnd.randrange(0xAC00, 0xD7A3)) for _ in range(200)), "1234 5678 --- !!!", "", None,
    ]
    rows = spark.createDataFrame([(i, t, "z", "y") for i, t in enumerate(junk)], "doc_id long, text string, bits string, lang_pred string")
    left = [r.doc_id for r in langid.keep(rows, model).collect()]
    assert left == []
    clean = docs.filter("text RLIKE '[A-Za-z]{3}'")
    assert langid.keep(clean, model).count() == clean.count()
    none = langid.keep(rows.limit(0), model)
    assert none.columns == rows.columns and none.count() == 0
    assert langid.keep(docs.limit(0)).count() == 0
