"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Only the number of pieces of each length decides a packing, and there are at most ``capacity`` lengths. Spark counts
them; the reduction and the best fit run on that histogram and give patterns (the lengths of one sequence) with a
multiplicity; Spark then hands the pieces of each length out to the places of that length by rank.

Reduction: for the largest length ``x`` left, a set holding ``x`` that dominates all other feasible sets with ``x`` is
fixed for as many sequences as its counts allow:
  * nothing fits beside ``x``: ``{x}``;
  * one piece fills the rest exactly, or no two pieces fit: ``{x, y}`` with the largest ``y`` that fits;
  * no three pieces fit and every pair that fits sums to ``y`` at most: ``{x, y}``;
  * no three pieces fit, and with the largest ``y`` goes a ``b`` at least as large as the smaller of any pair: ``{x, y, b}``.
What no rule fixes is packed best-fit in decreasing length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

from .common import slices, texts
from .tokens import encoder

CAPACITY = 4096
END_ID = 1
#: Ranks within a length are counted in this many hash buckets, so that a frequent length is no single task.
BUCKETS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document: ids of the whole text and ``end_id``, cut only where longer than ``capacity``.

    Null and empty texts give one piece with the end id alone; a null ``doc_id`` stays null; repeated rows give
    repeated pieces; other columns are ignored; an empty table gives no rows.
    """
    import zlib
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in slices(batches):
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            a = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[0], pa.int64()), pa.array(a[1], pa.int32()), *(pa.array(x, pa.int64()) for x in a[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, PIECES)


def reduce_lengths(count: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Patterns fixed by dominance, with multiplicities, and the counts left over."""
    left = {k: n for k, n in count.items() if n > 0}
    lengths = sorted(left)
    fixed: list[tuple[list[int], int]] = []

    def take(pattern: list[int]) -> None:
        need: dict[int, int] = defaultdict(int)
        for k in pattern:
            need[k] += 1
        m = min(left[k] // c for k, c in need.items())
        fixed.append((pattern, m))
        for k, c in need.items():
            left[k] -= m * c
            if not left[k]:
                del left[k]
                lengths.pop(bisect.bisect_left(lengths, k))

    def smallest(n: int, without: int) -> list[int]:
        """The n smallest pieces, one piece of length ``without`` aside."""
        out: list[int] = []
        for k in lengths:
            out += [k] * min(n - len(out), left[k] - (k == without))
            if len(out) == n:
                break
        return out

    def largest(limit: int, without: list[int]) -> int:
        """The largest length up to a limit of which a piece is left beside those named, or 0."""
        i = bisect.bisect_right(lengths, limit) - 1
        while i >= 0:
            if left[lengths[i]] > without.count(lengths[i]):
                return lengths[i]
            i -= 1
        return 0

    todo = list(lengths)
    while todo:
        x = todo[-1]
        if x not in left:
            todo.pop()
            continue
        room = capacity - x
        few = smallest(3, x)
        y = largest(room, [x])
        if not y:
            take([x])
        elif y == room or len(few) < 2 or few[0] + few[1] > room:
            take([x, y])
        elif len(few) == 3 and sum(few) <= room:
            todo.pop()  # four or more pieces fit: left to the best fit
        else:
            pair, second = 0, 0
            for b in lengths:  # the best pair, and the largest smaller member of any pair
                if 2 * b > room:
                    break
                if left[b] - (b == x) < 1:
                    continue
                a = largest(room - b, [x, b])
                if a >= b:
                    pair, second = max(pair, a + b), max(second, b)
            b = largest(room - y, [x, y])
            if y >= pair:
                take([x, y])
            elif b and b >= second:
                take([x, y, b])
            else:
                todo.pop()
    return fixed, left


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit in decreasing length, for all pieces of a length at once."""
    open_: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by free room
    rooms: list[int] = []

    def put(pattern: list[int], m: int, room: int) -> None:
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room].append((pattern, m))

    for x in sorted(count, reverse=True):
        n = count[x]
        while n:
            i = bisect.bisect_left(rooms, x)
            if i < len(rooms):
                room = rooms[i]
                pattern, m = open_[room].pop()
                if not open_[room]:
                    rooms.pop(i)
            else:
                room, pattern, m = capacity, [], n
            k = min(room // x, n)  # a sequence that took one is the tightest for the next
            use = min(m, n // k)
            if use < m and pattern:
                put(pattern, m - use, room)
            put(pattern + [x] * k, use, room - k * x)
            n -= use * k
    return [(p, m) for room in rooms for p, m in open_[room]]


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, places per sequence, first entry in offsets; and the offsets."""
    out: dict[int, list] = defaultdict(lambda: [0, [], [], [], [], []])
    sequence = 0
    for pattern, m in patterns:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for k in pattern:
            offsets[k].append(at)
            at += k
        for k, o in offsets.items():
            p = out[k]
            for held, value in zip(p[1:5], (p[0], sequence, len(o), len(p[5]))):
                held.append(value)
            p[5].extend(o)
            p[0] += m * len(o)
        sequence += m
    return {k: tuple(np.asarray(x, np.int64) for x in p[1:]) for k, p in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id``, ``piece`` and ``length`` (1 to ``capacity``).

    The driver holds the counts of at most ``capacity`` lengths and the patterns made from them. Ties and repeated
    rows take any of the places of their length; an empty table gives no rows.
    """
    parts = cut_lineage(parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")))
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count("*")).collect()}
    fixed, rest = reduce_lengths(counts, capacity)
    plan = places(fixed + best_fit(rest, capacity))

    before = (parts.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
              .select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
                      .alias("_before")))
    ranked = (parts.withColumn("_row", F.row_number().over(
        Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")))
        .join(before, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before"))
    names = [c for c in ranked.columns if c != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for k in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(k):
                    continue
                first, seq, per, entry, offsets = plan[int(length[k[0]])]
                i = np.searchsorted(first, rank[k], side="right") - 1
                at = rank[k] - first[i]
                sequence[k] = seq[i] + at // per[i]
                offset[k] = offsets[entry[i] + at % per[i]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
