import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("label", T.StringType()),  # a clashing name
        T.StructField("size", T.StringType()),
    ]
)

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    "One two three four five six seven eight nine ten.",
    "one  two three\tfour five six seven eight nine ten.",
    "One two three four five six seven eight nine ten.",
    "",
    None,
    "   \n\t ",
    "été à la plage, mail a.b@c-d.example.org and 4111 1111 1111 1111",
    LONG,
    LONG + " end",
    "idiot clown!! WHAT!! A!! DAY!!",
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "a", "b")[i % 3], "x", "y") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "null id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
