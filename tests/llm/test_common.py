"""Helpers that the operators share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import common


@pytest.mark.parametrize("literals", [512, 0])
def test_ranges_are_the_same_however_they_are_found(spark, monkeypatch, literals):
    common.ship(spark)
    monkeypatch.setattr(common, "LITERALS", literals)
    bounds = [-5, 0, 7, 2**60, 2**60 + 1, 2**62]
    ids = [None, -9, -5, -4, 0, 6, 7, 8, 2**60 - 1, 2**60, 2**60 + 1, 2**62 + 5, None]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = [r.n for r in frame.select(common.range_of(F.col("doc_id"), bounds).alias("n")).collect()]
    assert got == [0 if i is None else int(np.searchsorted(bounds, i, side="right")) for i in ids]


def test_plans_do_not_grow_with_the_number_of_ranges(spark):
    frame = spark.range(10).withColumnRenamed("id", "doc_id")
    plans = [frame.select(common.range_of(F.col("doc_id"), list(range(n))).alias("n")) for n in (1000, 60_000)]
    sizes = [len(p._jdf.queryExecution().analyzed().toString()) for p in plans]
    assert abs(sizes[0] - sizes[1]) < 50
