import pytest
from pyspark.sql import types as T

FIELDS = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
# Extra columns with names that the operators use inside.
CLASHING = ["key", "drops", "text_hash", "fp", "uid", "ids", "spans", "shard", "_id", "_hash", "_gone_id", "n_dropped", "h1", "score"]
SCHEMA = T.StructType(FIELDS + [T.StructField(c, T.StringType()) for c in CLASHING])
LINE = "this line stands in more than two documents"
LONG = " ".join(f"word{i % 977} and{i % 13}," for i in range(20_000))


def rows(texts):
    return [(i, t, "en", None, None, *["x"] * len(CLASHING)) for i, t in texts]


ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n \n"), (4, "\n\n"), (5, f"{LINE}\nalone 5"), (6, f"  {LINE.upper()}\t\nalone 6\n{LINE}"), (7, f"x\n{LINE}"),
    (8, "É'S it's don'T 12,34 <|endoftext|> 日本語。 ﬁ\x85"), (9, "a@b.co 1.2.3.4; 4111 1111 1111 1111; +1 (202) 555-0143"), (10, LONG), (11, LONG),
    (None, f"{LINE}\nno id"), (12, "!!! 123 …"), (5, f"{LINE}\nalone 5"), (13, "a" * 9000), (14, "the the the"), (15, "the the the"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(ODD_TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
