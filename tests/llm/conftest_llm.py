import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that operators use for their own results.
        *[T.StructField(c, T.StringType()) for c in ("kept", "keep_id", "group", "fp", "ids", "score", "row", "size", "copies", "n")],
    ]
)


def make_docs(spark, rows, schema=DOCS):
    """Documents from (doc_id, text, lang, source); other columns hold text of their own."""
    return spark.createDataFrame([(*r, *["other"] * (len(schema) - len(r))) for r in rows], schema)


def sample_rows(seed=1, count=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "eta", "naïve", "x1", "don't", "12.5", "日本語", "🙂"]
    rows = []
    for i in range(count):
        text = rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 60, 300])))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])))
    rows += [(1000 + i, rows[7][1].replace(" ", "\t"), "en", "a") for i in range(40)]
    rows += [(2000, None, "en", "b"), (2001, "", "fr", "b"), (2002, " \n\t ", None, None), (None, "no id here at all", "en", "c")]
    rows += [rows[3], rows[3], (2003, "long " * 40000, "en", "a"), (2004, "z" * 70000, "fr", "b"), (2005, "long " * 40000, "en", "a")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return make_docs(spark, sample_rows()).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
