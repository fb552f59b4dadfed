"""Query registry: a Spark job and, where SQL can say it, the same result in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with the SQL it must agree with."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def report(df: DataFrame, *columns, digits: int = 6) -> DataFrame:
    """Final projection: stamps as text, counts as bigint, measures rounded ('name:2' sets the places)."""
    places = dict(x.split(":") for x in columns if isinstance(x, str) and ":" in x)
    columns = [x.split(":")[0] if isinstance(x, str) else x for x in columns]
    df = df.select(*columns) if columns else df
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c, int(places.get(field.name, digits))) + F.lit(0.0)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)
