import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
EXTRA = ["uid", "raw", "score", "passes", "pass", "level", "name", "bits", "kept", "n"]


def prose(rng: random.Random, words: int) -> str:
    common = "the of and to in is that for it was on are as with be by at this from or".split()
    made = ["".join(rng.choice(["an", "er", "th", "on", "in", "es", "ti"]) for _ in range(rng.randint(1, 4)))
            for _ in range(200)]
    out = []
    for i in range(words):
        out.append(rng.choice(common) if rng.random() < 0.45 else rng.choice(made))
        if i % 12 == 11:
            out[-1] += ".\n" if i % 36 == 35 else "."
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def table(spark):
    """Rows of (doc_id, text[, lang, source]) to a documents table with extra columns whose names the operators use
    inside, in a few partitions."""
    def make(rows, parts: int = 3):
        full = [(r + ("en", "src0")[len(r) - 2:] if len(r) < 4 else r) for r in rows]
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                               T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
        df = spark.createDataFrame(full, schema).repartition(parts, "doc_id")
        return df.select("*", *(F.lit(c).alias(c) for c in EXTRA))
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space only, a very long text, repeated rows, a null id, other scripts."""
    rng = random.Random(3)
    long = prose(rng, 40_000)
    text = prose(rng, 120)
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, text), (6, text), (6, text), (None, text), (7, "one"),
            (8, "日本語 текст 🙂 ñandú x y"), (9, text.replace("the", "THE")), (10, "x" * 3000), (None, None)]


@pytest.fixture(scope="session")
def no_rows(table):
    return table([])


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
