import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text), with its other columns."""
    from tallyforge.llm.shared import ship

    ship(spark)

    def build(rows, parts=3):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, ties, repeated rows, rare characters, one very long text."""
    return [
        (1, "Plain words, and a few more of them."), (2, None), (3, ""), (4, "   "), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "no id at all"),
        (7, "tab\tand \n newline   runs\r\n\x0b\x0c end "), (8, "ünïcödé ß ñ 日本語 😀 \u00a0\u2003x\x1cy\x85z ²½ ⅷ"), (9, "<|endoftext|> inside<|endoftext|>"), (10, "a" * 5000 + " " + "long tail " * 3000),
        (11, "it's they'll 123 4567 !!! ___ --- \x00 nul"),
    ]
