import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: Nulls in every column, empty and long texts, ties, repeated rows.
ODD = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
    (1, "the cat sat on the mat and looked at the dog", "en", "a", 44),
    (2, "the cat sat on the mat and looked at the dog", None, None, None),
    (3, None, "en", "a", 0),
    (4, "", "en", "a", 0),
    (5, "", None, "b", 0),
    (None, "le chat dort sur le tapis et la porte est ouverte", "fr", "b", 50),
    (None, None, None, None, None),
    (6, "🤦 ünïcode\u0000 text 漢字 123 !!", "fr", "b", 20),
    (7, "lorem ipsum dolor sit amet " * 9000, "fr", "c", 243000),
    (8, "x" * 120_000, "en", "c", 120000),
    (9, "   \n\t ", "en", "c", 6),
    (10, "12345 67890", "en", "c", 11),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCUMENTS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def clashing(odd):
    """More columns, named as what the operators add."""
    from pyspark.sql import functions as F

    names = ["shard", "slot", "size", "secret_spans", "lang_pred", "lang_score", "ids", "decoded", "key_a", "secret_key", "class_id", "piece", "word", "row"]
    return odd.select("*", *[F.lit("own").alias(n) for n in names])

