import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    from tickloom.llm.common import workers_find_us

    workers_find_us(session)
    return session


def documents(spark, rows, schema="doc_id long, text string, n_tokens string, fp string, words string"):
    """A small table of documents, with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], schema)


EDGE_TEXTS = [(1, None), (2, ""), (3, " "), (4, "one"), (5, "one two"), (6, "one two three"), (7, "one two three"), (7, "one two three"), (None, "one two three"), (8, "lorem ipsum " * 20_000), (9, "a\n b \n\n c  　x <|endoftext|> y<|endoftext|>")]
