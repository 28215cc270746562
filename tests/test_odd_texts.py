"""Queries over documents without text, without words or with rare spaces, beside their SQL."""

import random

import compare
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries

TEXTS = ["", " ", None, "\u00a0", "a\u00a0b c", "\t a", "a\u000bb", "\f", "\u00a0 \u00a0", "a", "a  b", "a b\nc d", "\u00a0 b c d e " * 9]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick = random.Random(3)
    rows = [(i, pick.choice(TEXTS), pick.choice(["en", "de"]), pick.choice(["web", "mail", "book"])) for i in range(4_000)]
    path = tmp_path_factory.mktemp("odd")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    df = df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    df.coalesce(1).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def connection(folder):
    import duckdb

    found = duckdb.connect()
    found.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return found


@pytest.mark.parametrize("name", [
    "presence_score", "presence_score_gold", "prediction_only_frames", "word_error", "char_error", "frame_text_score", "stratify",
])
def test_query_on_odd_texts(spark, connection, folder, name):
    _, _, problem = compare.compare(spark, connection, name, queries()[name], oracle_sql()[name], folder)
    assert problem is None
