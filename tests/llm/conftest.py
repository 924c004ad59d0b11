from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import types as T

DATA = Path("/root/testdata/sf0.001")

#: Columns beside the named ones, two of which clash with them but for case.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("TEXT", T.StringType()), T.StructField("Doc_Id", T.StringType()), T.StructField("score", T.DoubleType())])
WORDS = "the of and is a reed lane stone water fire over under slow quick bright".split()


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.7) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows and ids, other scripts."""
    long = prose(60_000, 1)
    rows = [
        (1, prose(80, 2), "x", None, 1.0),
        (1, prose(80, 2), "x", None, 1.0),
        (2, None, None, "2", None),
        (None, prose(80, 3), "y", None, 0.0),
        (None, None, None, None, None),
        (3, "", "", "", 0.0),
        (4, " \n\t ", "", "", 0.0),
        (5, long, "", "", 0.0),
        (6, "a", "", "", 0.0),
        (7, "héllo wörld ß ½ ² 日本語 👩‍👩‍👧   end", "", "", 0.0),
        (8, prose(80, 2), "", "", 0.0),
        (9, prose(80, 2), "", "", 0.0),
        (9, "another text under the same id", "", "", 0.0),
        (10, "x" * 20_000, "", "", 0.0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tables(spark):
    if not DATA.exists():
        pytest.skip("no tables")
    return {p.stem: spark.read.parquet(str(p)) for p in DATA.glob("*.parquet")}
