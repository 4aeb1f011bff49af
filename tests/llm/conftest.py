import pytest
from pyspark.sql import types as T

LONG = "word " * 30_000
MESSY = [
    (1, "The same text twice over, the same text twice over, and a little more of it to read.", "en", "s1", 84, "x"),
    (1, "The same text twice over, the same text twice over, and a little more of it to read.", "en", "s1", 84, "x"),
    (2, None, "en", None, None, None),
    (3, "", None, "s1", 0, ""),
    (4, " \t\n\x0b\x0c\r ", "fr", "s2", 7, "y"),
    (5, LONG, "en", "s1", len(LONG), "z"),
    (None, "Null id, mail a.b@c.example.com or call +1 (523) 555-1055.", "de", "s2", 58, None),
    (6, "日本語 ▁ 😀 ﬁ x y\x1cz", "xx", "", 12, "q"),
    (7, "one two", "en", "s3", 7, "q"),
]
#: Names that operators use inside, or give to what they add.
INSIDE = "chunk bucket id _types _attempts _mix_time _mix_key _stay _stays _row k t n_words size times types print key bytes h i label score predicted c0 c1 _t _w _place _s time_1 copies".split()
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(n, T.StringType()) for n in INSIDE),
    ]
)


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame([(*row, *[None] * (len(INSIDE) - 1)) for row in MESSY], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
