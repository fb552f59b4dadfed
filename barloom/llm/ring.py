"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 2^32 places; a document belongs to the first point at or after its own.
A shard takes as many documents as its capacity; the rest of an arc goes on clockwise to the next points. Capacities
add up to the number of documents and differ by one at most, so shard counts do as well, and only the overflow moves.

Spark counts the documents of each arc (``shards * vnodes`` rows at most, whatever the data). The overflow is settled on
these counts; each arc then is a list of rank ranges with a shard and a first slot, which Spark applies to the ranks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

SHARDS, VNODES = 40, 64
_PLACES = 1 << 32
#: The ring is looked up by the upper bits of a place.
_INDEX_BITS = 12


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            place = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=4).digest(), "big")
            points.setdefault(place, s)
    return sorted(points.items())


def settle(points: list[tuple[int, int]], counts: list[int], shards: int) -> list[list[tuple[int, int, int]]]:
    """For each arc its rank ranges as (first rank, shard, first slot).

    In each round every arc gives its waiting ranges to its shard while that has room and passes the rest on.
    """
    whole, more = divmod(sum(counts), shards)
    room = [whole + (s < more) for s in range(shards)]
    used = [0] * shards
    out: list[list[tuple[int, int, int]]] = [[] for _ in points]
    waiting = {i: [(i, 0, n)] for i, n in enumerate(counts) if n}
    while waiting:
        passed: dict[int, list[tuple[int, int, int]]] = {}
        for i in sorted(waiting):
            shard = points[i][1]
            for arc, first, end in waiting[i]:
                n = min(end - first, room[shard] - used[shard])
                if n:
                    out[arc].append((first, shard, used[shard]))
                    used[shard] += n
                if first + n < end:
                    passed.setdefault((i + 1) % len(points), []).append((arc, first + n, end))
        waiting = passed
    return [sorted(x) for x in out]


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null) of every row.

    ``size`` is 16 plus the UTF-8 bytes of the text. Null and empty texts count as empty; a null ``doc_id`` has a
    place of its own on the ring; repeated rows are counted, not moved, and take neighbouring ranks; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    step = _PLACES >> _INDEX_BITS
    index, at = [], 0
    for b in range(1 << _INDEX_BITS):
        inside = []
        while at < len(points) and points[at][0] < (b + 1) * step:
            inside.append(points[at][0])
            at += 1
        index.append((b, at - len(inside), inside))
    # Fixed sizes: 2^12 index rows and shards * vnodes arcs.
    lookup = F.broadcast(spark.createDataFrame(index, "_part int, _before int, _inside array<long>"))
    rows = (texts(docs).select("doc_id", (F.octet_length("text") + F.lit(16)).cast("long").alias("size"),
                               F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
            .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
            .withColumn("_place", F.pmod(F.xxhash64(F.lit("ring"), "doc_id"), F.lit(_PLACES)))
            .withColumn("_part", F.expr(f"cast(_place div {step} as int)"))
            .join(lookup, "_part")
            .withColumn("_arc", F.expr(f"(_before + size(filter(_inside, p -> p < _place))) % {len(points)}"))
            .drop("_part", "_before", "_inside"))
    counts = [0] * len(points)
    for arc, n in rows.groupBy("_arc").agg(F.sum("_n")).collect():
        counts[arc] = n
    plan = [(arc, *map(list, zip(*ranges))) for arc, ranges in enumerate(settle(points, counts, shards)) if ranges]
    plan = F.broadcast(spark.createDataFrame(plan, "_arc int, _firsts array<long>, _shards array<int>, _slots array<long>"))
    order = Window.partitionBy("_arc").orderBy("_place", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (rows.withColumn("_first", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
            .withColumn("_rank", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)))
            .join(plan, "_arc")
            .withColumn("_k", F.expr("size(filter(_firsts, f -> f <= _rank)) - 1"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr("_shards[_k]").alias("shard"),
                    F.expr("_slots[_k] + _rank - _firsts[_k]").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
