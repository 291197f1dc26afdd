"""Rounding that agrees with the exact binary value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(c: Column, places: int) -> Column:
    """Round half to even on the exact value of the double, where the engine's round goes by its shortest decimal form."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if v is None or v != v else round(float(v), places) for v in b], dtype="float64")

    return F.pandas_udf(work, "double")(c)
