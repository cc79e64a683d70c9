import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PHRASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def hard_texts():
    """Nulls, empty, blank, very long, tied, repeated, odd white space and characters."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = " ".join(f"term{i}" for i in range(120))
    return [
        None, "", "   \n\t ", "one", "one two three four", "a b c a b c a b c", "L1 here\nL2\nL1 here\n\nL1 here", long,
        base, base, base.replace("term7", "other"), base + " tail words here", PHRASE.upper(), "start " + PHRASE + " end", "x " * 300 + PHRASE + " y" * 400,
        "café naïve nbsp em  double   triple \t tab\t \r\n crlf é combining", "#*$%&|<> <|endoftext|> it's we'll 123,456 !!", "你好 世界 \U0001f600 emoji", "end with space ", "\x1c\x1d odd\x0bcontrol\x0c",
        "İstanbul ΣΣ ss", "2024-01-01 $5.00", "½ ² ①", "Ⅷ ٣ — …",
    ]


@pytest.fixture(scope="session")
def hard_docs(spark):
    rows = [(i * 3 + 1, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(hard_texts())]
    rows.append((1000, "repeated row", "en", None, 1))
    rows.append((1000, "repeated row", "en", None, 1))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
