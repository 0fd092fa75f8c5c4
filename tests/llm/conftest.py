import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # columns whose names the operators use inside
    + [T.StructField(c, T.StringType()) for c in ("size", "key", "fp", "mark", "version", "hash", "row", "taken", "rank", "held_out")]
)


def words(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


PASSAGE = words(5, 70)


def rows():
    texts = {
        0: "Hello there, World.\nA line that is long enough to be counted as repeated.\nend",
        1: None, 2: "", 3: " \t\n ", 4: "!!! 123 ???", 5: "one", 6: words(1, 60), 7: words(1, 60), 8: words(1, 60) + " tail",
        9: words(2, 30) + " " + PASSAGE + " " + words(3, 30), 10: words(4, 20) + "\n" + PASSAGE, 11: PASSAGE, 12: "a" * 5000,
        13: words(6, 20_000), 14: "Ünïcode Éa İ ſ <|endoftext|> 中文 aaaaaaaaaa", 15: "x\x00y \x1c z", 16: words(2, 49), 17: words(2, 50),
    }
    line = "   a LINE that is long enough to be counted as repeated.\t"
    out = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 3}") for i, t in texts.items()]
    out += [(20 + i, f"{line}\nother {i}\n{line}", "de", "s9") for i in range(6)]
    out += [(None, words(1, 60), "en", "s1"), (None, line, None, None), (26, "twice", "en", "s1"), (26, "twice", "en", "s1"), (26, words(7, 55), "en", "s1")]
    return [(i, t, lang, source, None if t is None else len(t), *("z" * 10)) for i, t, lang, source in out]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def items(spark):
    shape = "item_id long, text string, answer string"
    ten = " ".join(PASSAGE.split()[30:55])
    return spark.createDataFrame([(1, ten, "a"), (2, "Hello there world", "b"), (3, None, "c"), (4, "", None), (None, "twice", "d"), (2, "123", "e"), (10, "w0 nowhere", "f")], shape)
