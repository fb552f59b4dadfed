"""Small helpers of the operators: reading, word expressions, Arrow slices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of words: space and the five ASCII controls, written for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shingle_hashes(of: DataFrame, words_column: str, size: int, to: str) -> DataFrame:
    """Adds ``to``: a 64-bit hash of every run of ``size`` (5 or 8) words; fewer words: none.

    Runs of 2, 4 and then ``size`` words are combined from neighbours, so every step is one pass over an array.
    """
    h = "xxhash64"
    of = of.withColumn("_h1", F.expr(f"transform({words_column}, w -> {h}(w))"))
    for a, b, shift, name in ((1, 1, 1, "_h2"), (2, 2, 2, "_h4"), *(((4, 4, 4, to),) if size == 8 else ((4, 1, 4, to),))):
        left, right = f"_h{a}", f"_h{b}"
        of = of.withColumn(name, F.expr(
            f"CASE WHEN size({right}) > {shift} THEN zip_with(slice({left}, 1, size({right}) - {shift}), "
            f"slice({right}, {shift + 1}, size({right}) - {shift}), (x, y) -> {h}(x, y)) "
            f"ELSE cast(array() AS array<bigint>) END"))
    return of.drop("_h1", "_h2", "_h4")


def settled(of: DataFrame) -> DataFrame:
    """The same rows, computed here: filters above are not pushed into (and expanded with) the expressions below."""
    return of.select(F.inline_outer(F.array(F.struct(*of.columns))))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a slice holds about ``most`` bytes of a text column (one row at least)."""
    import pyarrow.compute as pc
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or of a plain path; None for other stores."""
    m = re.match(r"file:/*(/.*)", uri)
    if m:
        return m[1]
    return uri if "://" not in uri else None


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v of the rows whose vector is neither null nor empty nor holds null or non-finite entries, of the usual length.

    v keeps single precision where the table has it, else it holds doubles. The usual length is that of most vectors (ties: the longer).
    """
    kind = next((f.dataType for f in rows.schema.fields if f.name == "embedding"), None)
    single = getattr(getattr(kind, "elementType", None), "typeName", lambda: "")() == "float"
    v = F.col("embedding").cast(f"array<{'float' if single else 'double'}>")
    finite = F.expr("forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") > 0).where(finite)
    usual = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found.where(F.size("v") == (usual[0].d if usual else 0))


def matrix(column: pa.Array, dim: int):
    """The rows of a list column without nulls, as a numpy matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
