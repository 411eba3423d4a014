import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")

#: doc_id, text, lang, source: nulls, empty and long texts, ties, repeated rows.
ROWS = [
    (1, "Hello world, this is a plain sentence. It has a second one.\nAnd a line more.", "en", "a"),
    (2, "Hello world, this is a plain sentence. It has a second one.\nAnd a line more.", "en", "a"),
    (3, "", None, None),
    (4, None, "en", "b"),
    (5, "Écrivez à jean.dupont@example.co.uk ou +33 6 12 34 56 78, merci; carte 4111 1111 1111 1111, hôte 10.0.0.255 et 10.0.0.256.", "fr", "b"),
    (6, "a@b.c@d.e x+y@z.w-1.com card 4012888888881881 not 4012888888881882 ip 1.2.3.4.5 +1-2 +12345678 +1 (234) 567-89-01.", None, "b"),
    (7, "word " * 6000, "en", "c"),
    (8, "中文字符。第二句！  tabs\t\tand\u3000spaces \u2581 mark <|endoftext|> 'tis we'll", None, "c"),
    (9, "IBAN account GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, ssn 123-45-6789", "en", "d"),
    (9, "IBAN account GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, ssn 123-45-6789", "en", "d"),
    (10, "x" * 5000, "de", "d"),
    (11, "The quick brown fox jumps over the lazy dog and then the quick brown fox sleeps", "en", "d"),
    (12, "the QUICK brown fox jumps over the lazy dog and then the quick brown fox sleeps ", "en", "d"),
    (None, "no identifier here", "en", "e"),
    (13, "12345 67890", "en", "e"),
]
DDL = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with extra columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(ROWS, DDL)
    return df.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars", "1 as id", "'x' as digest", "2 as row", "3 as fp", "'y' as word", "4 as n", "5 as `__0`")


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, DDL).selectExpr("*", "cast(length(text) as long) as n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DDL + ", n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)
