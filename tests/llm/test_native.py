"""Operators that must stay in DataFrame functions."""

import re

import pytest

from ledgerloom.llm import exact_dedup, mixing


@pytest.mark.parametrize("op", [exact_dedup.decide, exact_dedup.keep_rows, mixing.poisson_mix])
def test_no_python_in_the_plan(spark, sf, op):
    p = op(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|ExistingRDD|MapPartitions", p)
