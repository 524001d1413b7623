import pytest
from pyspark.sql import types as T

#: Columns that operators use inside, to see that they don't get in the way.
CLASHES = ("line", "lines", "pos", "key", "h1", "version", "drops", "carried", "rep", "path", "paths", "component", "anchor", "at", "marks", "seed", "stretches", "words", "n", "id", "item_id", "score")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) rows, with columns of clashing names."""

    def make(rows):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in CLASHES)])
        return spark.createDataFrame([(i, t, "en", "src", len(t or ""), *[7] * len(CLASHES)) for i, t in rows], schema)

    return make


def words(seed, n, vocabulary=400):
    import random

    rnd = random.Random(seed)
    return [f"w{int(rnd.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, "One."), (5, "One."), (None, "A row without an id, of some words.\nSecond line here"), (None, None),
    (6, "Long " * 20000 + "\n" + "x" * 50000), (7, "Àé ñ 日本語   𝒳 naïve\nÀé ñ 日本語   𝒳 naïve\n"), (8, "\n\n\n"), (-9, "Same line, twice over\nSame line, twice over"), (9, "same LINE, twice over  \nother"),
]


@pytest.fixture(scope="session")
def edges():
    return list(EDGES)
