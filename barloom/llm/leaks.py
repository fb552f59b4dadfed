"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

The chance that the MinHash of an item (its shingle of least hash) is in a document equals the item's containment, however
long the document is; a signature of the document would drown a short item. Items are partitioned by set size into
powers of two. The sketch of an item is its ``k`` least hashes (bottom-k MinHash), with ``k`` set per partition from the
largest size ``u`` in it: of ``u`` shingles at most ``u - ceil(t u)`` may be missing, so one more than that can't all be
missing, and every document with containment ``t`` holds one hash of the sketch. Documents with fewer words than the
least item of a partition needs are pruned. Candidates are then verified on the whole shingle sets.

A shingle is five lower-case (A-Z) words; a text of one to four words is one shingle; no word, no shingle, no match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

from .common import ascii_lower, shingle_hashes, texts, words

THRESHOLD = 75
#: A side of a join is broadcast only if its rows have been counted and are no more than this; else it is shuffled.
BROADCAST_ROWS = 1_000_000


def shingles(of: DataFrame, key: str) -> DataFrame:
    """``key`` and the array ``_shingles`` of every row (in text order, with repeats)."""
    of = of.select(key, words(ascii_lower(F.coalesce(F.col("text"), F.lit("")))).alias("_w"))
    of = shingle_hashes(of, "_w", 5, "_runs")
    return of.select(key, F.when(F.size("_w").between(1, 4), F.array(F.xxhash64("_w"))).otherwise(F.col("_runs")).alias("_shingles"))


def small(side: DataFrame, n: int) -> DataFrame:
    return F.broadcast(side) if n <= BROADCAST_ROWS else side


def find(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_common, containment of all pairs with ``threshold`` per cent or more.

    Null or empty texts on either side match nothing. Rows that repeat a ``doc_id`` count once, with their largest
    overlap; null ids are one id. Repeated items are one item. Other columns are ignored. Empty tables give no rows.
    """
    items = cut_lineage(shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id")
                        .select("item_id", F.array_sort(F.array_distinct("_shingles")).alias("_item"))
                        .where(F.size("_item") > 0).distinct()
                        .withColumn("_need", F.expr(f"cast(ceil(size(_item) * {threshold} / 100.0d) AS int)"))
                        .withColumn("_size_class", F.expr("cast(floor(log2(size(_item))) AS int)")))
    largest = items.groupBy("_size_class").agg(F.max(F.expr("size(_item) - _need + 1")).alias("_k"))
    sketch = (items.join(largest, "_size_class")
              .select("item_id", "_need", F.explode(F.expr("slice(_item, 1, _k)")).alias("_hash")))
    n_items, n_sketch = items.count(), sketch.count()

    rows = shingles(texts(docs), "doc_id")
    # explode_outer: a filter on the array would be pushed below and compute it a second time
    hashes = rows.select("doc_id", F.size("_shingles").alias("_n"), F.explode_outer("_shingles").alias("_hash"))
    sketch = small(sketch, n_sketch)
    pairs = cut_lineage(hashes.join(sketch, (hashes["_hash"] == sketch["_hash"]) & (hashes["_n"] >= sketch["_need"]))
                        .select("doc_id", "item_id").distinct())

    wanted = pairs.select("doc_id").distinct()
    there = texts(docs)
    there = there.join(wanted, there["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    sets = shingles(there, "doc_id").withColumn("_shingles", F.array_distinct("_shingles"))
    sides = pairs.join(small(items, n_items), "item_id")
    both = sides.join(sets, sides["doc_id"].eqNullSafe(sets["doc_id"])).select(
        sides["doc_id"], "item_id", F.size("_item").cast("long").alias("n_item_shingles"),
        F.size(F.array_intersect("_item", "_shingles")).cast("long").alias("n_common"))
    return (both.groupBy("doc_id", "item_id", "n_item_shingles").agg(F.max("n_common").alias("n_common"))
            .where(F.col("n_common") * 100 >= F.col("n_item_shingles") * threshold)
            .withColumn("containment", F.col("n_common") / F.col("n_item_shingles")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without the documents that contain an item."""
    found = find(docs, benchmark, threshold).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_leaked"]), "left_anti")
