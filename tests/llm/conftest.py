from __future__ import annotations

import random

import pytest

#: Columns whose names are those the operators use inside.
CLASHING = {"id": 7, "c0": "x", "n": 1, "sig": "s", "a": 1, "b": 2, "key": "k", "cls": 3, "sides": 1, "suffix": "s", "kind": "k", "k": 0, "t": "t", "u": 1, "v": 2, "ids": "i", "set_a": 1, "class_id": 4, "prompt": "p", "size": 1}


@pytest.fixture
def clashing(spark):
    """A table with the given columns, and others whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def of(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: F.lit(v) for c, v in CLASHING.items() if c not in df.columns})

    return of


@pytest.fixture
def words():
    r = random.Random(5)
    pool = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(400)]
    return lambda n, seed: [random.Random(seed * 7919 + k).choice(pool) for k in range(n)]
