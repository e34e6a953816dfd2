import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import types as T

from tests.conftest import DATA

#: Columns that operators use themselves, as extra columns of the input.
CLASHING = ("digest", "block", "score", "_text", "_doc", "key", "shard", "sig", "part", "row")


@pytest.fixture(scope="module")
def duck():
    """The test tables as views of a database."""
    con = duckdb.connect()
    for file in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of (doc_id, text) pairs, with the other columns and some that clash."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ])

    def make(pairs, slices=3):
        rows = [
            (i, t, None if t is None else "en", "s", None if t is None else len(t), *CLASHING)
            for i, t in pairs
        ]
        return spark.createDataFrame(rows, schema).repartition(slices)

    return make


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60_000))
    return [
        (None, "no id here"), (None, None), (1, None), (2, ""), (3, "Hello World"),
        (3, "Hello World"), (4, "hello world"), (5, long), (6, long.upper()), (7, " \n\t "),
        (8, "émoji 😀 ▁ \u0000 x"), (9, "9" * 30_000), (10, "a"), (-4, "a@b.c 1.2.3.4"),
    ]
