"""User extension points: rolling functions and ordered kernels that built-ins cannot express."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import c, past


def rolling_apply(fn: Callable[[pd.Series], float], x, n: int, w) -> Column:
    """A user function over the last ``n`` values, as an Arrow grouped-aggregate over a bounded frame.

    Prefer built-ins and array functions; this ships every frame to Python.
    """
    @F.pandas_udf("double")
    def agg(values: pd.Series) -> float:
        return float(fn(values))

    return F.when(F.count(c(x)).over(past(w, n)) == n, agg(c(x)).over(past(w, n)))


def per_chunk(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key=("symbol",)) -> DataFrame:
    """An ordered user kernel on every chunk of a chunked frame; halo rows give it its warm-up."""
    return df.groupBy(*key, "_chunk").applyInPandas(lambda part: fn(part.sort_values("_rn")), schema)


def ordered_kernel(df: DataFrame, kernel: type, schema: str, key, order) -> DataFrame:
    """A sequential user kernel as a table function: one instance per ``key``, rows come in ``order`` one by one.

    ``kernel.eval(row)`` yields output tuples and keeps its state in the instance, so a key costs the memory of its state, not of its rows.
    A key is one task's work: choose one that bounds it, such as symbol and day.
    """
    return F.udtf(kernel, returnType=schema)(df.asTable().partitionBy(*key).orderBy(*order))


def cusum(limit: float) -> type:
    """Kernel of two running sums of ``r``, one above and one below zero; leaving the band is an event and restarts that sum."""
    class Cusum:
        def __init__(self):
            self.up = self.down = 0.0

        def eval(self, row):
            self.up, self.down = max(0.0, self.up + row["r"]), min(0.0, self.down + row["r"])
            if self.up > limit:
                self.up = 0.0
                yield row["symbol"], row["ts"], 1
            elif self.down < -limit:
                self.down = 0.0
                yield row["symbol"], row["ts"], -1

    return Cusum
