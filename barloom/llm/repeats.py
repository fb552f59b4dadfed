"""Removal of long repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Suffixes are only worth comparing where
their first ``LENGTH`` bytes can be equal, so each such start, a window, gets an anchor: the place in the window whose
``GRAM`` bytes have the least hash (the last one among equals). Equal windows have equal anchors at the same distance, and
the windows of one anchor are neighbours: together they cover a region of the text. Then
  1. anchors whose gram occurs once are dropped (counts by gram);
  2. regions that occur as a whole twice or more need no further comparison: all their windows repeat;
  3. of the different regions around one gram, one each is fetched, and the suffixes at their windows are sorted
     group by group: a mergesort whose comparisons find the common extension of two suffixes by binary search over
     prefix polynomial hashes (mod 2^64), so a comparison takes log(LENGTH) steps. Neighbours with a common extension of
     ``LENGTH`` bytes repeat; their bytes are compared, and a group with a collision is sorted again on its bytes;
  4. a gram with more than ``CROWDED`` different regions is shared out first: its regions are cut into blocks of windows at
     the same distances to the anchor, and the bytes that all windows of a block have in common take the place of the
     gram. Steps 2 and 3 then hold for the blocks; a core that is still crowded is cut again, down to single windows.
Only anchors (about one for 168 bytes), the regions of step 3 and texts by document are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

from .common import slices, texts

LENGTH, GRAM, CROWDED = 400, 64, 1024
#: Windows in a block of a crowded gram, then of a crowded core.
BLOCKS = (64, 8, 1)
#: Windows of a text handled at once, and windows sorted at once (groups stay whole).
BLOCK, SORTED = 1 << 22, 400_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_LOW = np.uint64((1 << 24) - 1)


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) mod 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.cumprod(known)
    return known[:n]


def _prefix(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """First and last window, anchor and gram hash of every region; strings lie in [starts, ends) of data."""
    n = len(data)
    if n < length:
        return None
    prefix = _prefix(data)
    grams = _mix((prefix[gram:] - prefix[:-gram]) * _power(_INVERSE, n - gram + 1))
    key = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    best = _sliding_min(key, length - gram + 1)
    at = (_LOW - (best & _LOW)).astype(np.int64)
    p = np.arange(len(at))
    owner = np.searchsorted(starts, p, side="right") - 1
    p = p[p + length <= ends[owner]]
    if not len(p):
        return None
    a = at[p]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    lo, hi = p[new], p[np.append(new[1:], len(p)) - 1]
    return lo, hi, a[new], grams[a[new]], owner[lo], prefix


def anchors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, hash of the text, lo and hi (first and last window), at (anchor), g (gram) and two hashes of the region."""
    def run(batches):
        import xxhash
        for batch in slices(batches, most=1 << 20):
            column = batch.column("text").cast(pa.binary())
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
            offsets = offsets - offsets[0]
            ids, hashes = (batch.column(c).to_pylist() for c in ("doc_id", "hash"))
            # all texts at once, or one long text in blocks that share length - 1 bytes
            for base in range(0, max(len(data) - length + 1, 1), BLOCK):
                part = data[base:base + BLOCK + length - 1]
                first = np.maximum(offsets[:-1] - base, 0)
                found = _anchors(part, first, offsets[1:] - base, length, gram)
                if found is None:
                    continue
                lo, hi, at, g, owner, prefix = found
                r1 = _mix((prefix[hi + length] - prefix[lo]) * _power(_INVERSE, len(part))[lo] + (hi - lo).astype(np.uint64))
                raw = part.tobytes()
                r2 = [xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(lo.tolist(), (hi + length).tolist())]
                shift = base - offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in owner.tolist()], pa.int64()), pa.array([hashes[i] for i in owner.tolist()], pa.int64()),
                     pa.array(lo + shift), pa.array(hi + shift), pa.array(at + shift), pa.array(g.view(np.int64)), pa.array(r1.view(np.int64)),
                     pa.array(np.array(r2, np.uint64).view(np.int64))], names=["doc_id", "hash", "lo", "hi", "at", "g", "r1", "r2"])

    return rows.mapInArrow(run, "doc_id long, hash long, lo long, hi long, at long, g long, r1 long, r2 long")


class Suffixes:
    """Suffixes of a byte string, compared over their first ``length`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = _prefix(data)
        self.inverse = _power(_INVERSE, len(data) + 1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at x and y, up to length: binary search on equal prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        px, py, ix, iy = self.prefix[x], self.prefix[y], self.inverse[x], self.inverse[y]
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[x + middle] - px) * ix == (self.prefix[y + middle] - py) * iy
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Below 0, 0 or above 0 as the suffix at x stands before, with or after the one at y."""
        n = self.common(x, y)
        inside = n < self.length
        step = np.where(inside, n, 0)
        return np.where(inside, self.data[x + step].astype(np.int16) - self.data[y + step], 0)

    def sort(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes at ``at`` within ascending segments: a bottom-up mergesort of all segments together.

        In each round every element looks up its rank in the run that its own run is merged with.
        """
        order = np.arange(len(at))
        new = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(new, len(at)))
        first, q, n = np.repeat(new, size), np.arange(len(at)) - np.repeat(new, size), np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            i = np.flatnonzero(n > width)
            block, right = q[i] // (2 * width) * (2 * width), (q[i] // width) & 1
            start = block + np.where(right == 1, 0, width)
            end = np.minimum(start + width, n[i])
            i, block, right, start, end = (c[end > start] for c in (i, block, right, start, end))
            own, low, high = at[order[i]], start.copy(), end.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                c = self.compare(at[order[first[i[open_]] + middle]], own[open_])
                # the left run's elements go before equal ones of the right run
                before = np.where(right[open_] == 1, c <= 0, c < 0)
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            to = first[i] + block + (q[i] - block - right * width) + (low - start)
            moved = order[i]
            order[to] = moved
            width *= 2
        return order

    def repeated(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Which of the suffixes share their first ``length`` bytes with another one of their segment."""
        out = np.zeros(len(at), bool)
        order = self.sort(at, segment)
        i = np.flatnonzero(segment[1:] == segment[:-1])
        x, y = at[order[i]], at[order[i + 1]]
        equal = self.common(x, y) == self.length
        i, x, y = i[equal], x[equal], y[equal]
        span = np.arange(self.length)
        wrong: set[int] = set()
        for k in range(0, len(i), 10_000):
            part = slice(k, k + 10_000)
            same = (self.data[x[part, None] + span] == self.data[y[part, None] + span]).all(axis=1)
            wrong.update(segment[i[part][~same]].tolist())
        out[order[i]] = out[order[i + 1]] = True
        for s in wrong:  # a collision of hashes: this group again, on the bytes
            members = np.flatnonzero(segment == s)
            strings = [self.data[a:a + self.length].tobytes() for a in at[members].tolist()]
            counts: dict[bytes, int] = {}
            for b in strings:
                counts[b] = counts.get(b, 0) + 1
            out[members] = [counts[b] > 1 for b in strings]
        return out


def _runs(flags: np.ndarray, starts: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """For each region (rows from starts[i] to starts[i + 1]) the first and last places of its runs of true flags."""
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        f = np.concatenate([[0], flags[a:b].astype(np.int8), [0]])
        d = np.diff(f)
        out.append((np.flatnonzero(d == 1).tolist(), (np.flatnonzero(d == -1) - 1).tolist()))
    return out


_FOUND = "g long, r1 long, r2 long, first array<int>, last array<int>"


def _sort_groups(length: int):
    """Sorts the suffixes of whole groups (rows come sorted by g)."""
    def work(rows: dict[str, list]):
        regions = rows["region"]
        size = np.array([len(r) for r in regions])
        n = size - length + 1
        data = np.frombuffer(b"".join(regions), np.uint8)
        begin, starts = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(n)])
        inner = np.arange(starts[-1]) - np.repeat(starts[:-1], n)
        at = np.repeat(begin, n) + inner
        g = np.unique(np.array(rows["g"]), return_inverse=True)[1]
        # windows are compared at the same distance to the anchor only
        segment = np.repeat(g, n) * (2 * length) + (np.repeat(np.array(rows["off"]), n) - inner) + length
        by = np.argsort(segment, kind="stable")
        flags = np.zeros(len(at), bool)
        alone = np.ones(len(at), bool)
        s = segment[by]
        alone[1:] &= s[1:] != s[:-1]
        alone[:-1] &= s[:-1] != s[1:]
        by = by[~alone]
        if len(by):
            flags[by] = Suffixes(data, length).repeated(at[by], segment[by])
        first, last = zip(*_runs(flags, starts))
        keep = [bool(f) for f in first]
        pick = lambda c: [x for x, k in zip(c, keep) if k]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(pick(rows[c]), pa.int64()) for c in ("g", "r1", "r2")), pa.array(pick(first), pa.list_(pa.int32())),
             pa.array(pick(last), pa.list_(pa.int32()))], names=["g", "r1", "r2", "first", "last"])

    def run(batches):
        held: dict[str, list] = {c: [] for c in ("g", "r1", "r2", "off", "region")}
        windows = 0

        def flush(n: int):
            nonlocal windows
            part = {c: v[:n] for c, v in held.items()}
            for c in held:
                held[c] = held[c][n:]
            windows = sum(len(r) - length + 1 for r in held["region"])
            return work(part)

        for batch in batches:
            for c in held:
                held[c].extend(batch.column(c).to_pylist())
            windows += sum(len(r) - length + 1 for r in held["region"][len(held["region"]) - batch.num_rows:])
            while windows > SORTED:
                g, total, cut = held["g"], 0, 0
                for i, r in enumerate(held["region"]):
                    if i and g[i] != g[i - 1]:
                        cut = i
                        if total > SORTED:
                            break
                    total += len(r) - length + 1
                if not cut:
                    break  # the last group may go on
                yield flush(cut)
        if held["g"]:
            yield flush(len(held["g"]))
    return run


def _blocks(length: int, block: int):
    """Cuts regions into blocks of windows: the region and first window of each block, then the block as a region of its own."""
    def run(batches):
        import xxhash
        for batch in slices(batches, "region", 1 << 20):
            rows = [batch.column(c).to_pylist() for c in ("g", "r1", "r2", "off", "region")]
            out: list[tuple] = []
            for g, r1, r2, off, region in zip(*rows):
                n = len(region) - length + 1
                for b in range(max(off - n + 1, 0) // block, off // block + 1):
                    first, last = max(off - b * block - block + 1, 0), min(off - b * block, n - 1)
                    core = region[off - b * block:off - b * block - block + 1 + length]
                    part = region[first:last + length]
                    both = xxhash.xxh3_128_digest(part, seed=off - first)
                    out.append((g, r1, r2, first, _signed(xxhash.xxh3_64_digest(core, seed=(g + b) & (1 << 64) - 1)), _signed(both[:8]), _signed(both[8:]),
                                off - first, part))
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:8]), pa.array(c[8], pa.binary())],
                                             names=["_g", "_r1", "_r2", "_i", *_REGION, "off", "region"])
    return run


def _signed(b: bytes) -> int:
    return int.from_bytes(b, "big", signed=True)


_REGION = ["g", "r1", "r2"]


def _marks(cuts: DataFrame, length: int, crowded: int, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """g, r1, r2, first, last: runs of repeated windows in the different regions around one gram (k of them)."""
    few = cuts if not blocks else cuts.where(F.col("k") <= crowded)
    few = few.repartition("g").sortWithinPartitions("g").mapInArrow(_sort_groups(length), _FOUND)
    if not blocks:
        return few
    parts = cut_lineage(cuts.where(F.col("k") > crowded).mapInArrow(
        _blocks(length, blocks[0]), "_g long, _r1 long, _r2 long, _i long, g long, r1 long, r2 long, off long, region binary"))
    if parts.isEmpty():
        return few
    kinds = cut_lineage(parts.groupBy(*_REGION).agg(F.count("*").alias("n"), F.first("off").alias("off"), F.first("region").alias("region")))
    inner = _marks(kinds.join(_several(kinds), "g"), length, crowded, blocks[1:])
    n = F.size("first")
    marks = kinds.where("n > 1").select(*_REGION, F.lit(0).alias("_lo"), (F.length("region") - length).alias("_hi")).join(inner, _REGION, "full").select(
        *_REGION, F.when(F.col("_lo").isNotNull(), F.array("_lo")).otherwise(F.col("first")).alias("first"),
        F.when(F.col("_lo").isNotNull(), F.array("_hi")).otherwise(F.col("last")).alias("last")).where(n > 0)
    back = parts.drop("off", "region").join(marks, _REGION).groupBy("_g", "_r1", "_r2").agg(
        *(F.flatten(F.collect_list(F.expr(f"transform({c}, x -> cast(x + _i AS int))"))).alias(c) for c in ("first", "last")))
    return few.union(back)


def _several(kinds: DataFrame) -> DataFrame:
    """Grams with k > 1 different regions. Written, so that the join on them can split a crowded gram."""
    return cut_lineage(kinds.groupBy("g").agg(F.count("*").alias("k")).where("k > 1"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """doc_id, hash of the text, and arrays first and last: windows from first to last repeat somewhere."""
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    found = cut_lineage(anchors(rows, length, gram))
    twice = cut_lineage(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"))
    found = cut_lineage(found.join(twice, "g", "left_semi"))
    region = _REGION
    kinds = cut_lineage(found.groupBy(*region).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "hash", "lo", "at", "hi")).alias("one")))
    several = _several(kinds)

    # one text per kind of region, cut from the documents
    wanted = kinds.join(several, "g").groupBy(F.col("one.doc_id").alias("_doc"), F.col("one.hash").alias("_hash")).agg(
        F.collect_list(F.struct(*region, "k", F.col("one.lo").alias("lo"), F.col("one.at").alias("at"), F.col("one.hi").alias("hi"))).alias("parts"))

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("g", "r1", "r2", "k", "off", "region")}
            for text, parts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("parts").to_pylist()):
                for p in parts:
                    for c in ("g", "r1", "r2", "k"):
                        out[c].append(p[c])
                    out["off"].append(p["at"] - p["lo"])
                    out["region"].append(text[p["lo"]:p["hi"] + length])
            yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("g", "r1", "r2", "k", "off")), pa.array(out["region"], pa.binary())],
                                             names=list(out))

    cuts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_doc"]) & (rows["hash"] == wanted["_hash"])).select("text", "parts")
    cuts = cut_lineage(cuts.mapInArrow(cut, "g long, r1 long, r2 long, k long, off long, region binary"))
    parts = _marks(cuts, length, crowded)
    whole = kinds.where("n > 1").select(*region, F.lit(True).alias("whole"))
    marks = whole.join(parts, region, "full")

    spans = found.join(marks, region).select(
        "doc_id", "hash", F.when(F.col("whole"), F.array("lo")).otherwise(F.expr("transform(first, x -> lo + x)")).alias("first"),
        F.when(F.col("whole"), F.array("hi")).otherwise(F.expr("transform(last, x -> lo + x)")).alias("last"))
    return spans.groupBy("doc_id", "hash").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row.

    Null texts count as empty; texts shorter than ``length`` keep all; repeated rows are documents of their own, so both
    lose what they share; null ids are told apart by their texts; other columns are ignored; an empty table gives no rows.
    The kept bytes are binary: a removed string may end inside a character.
    """
    rows = texts(docs).withColumn("hash", F.xxhash64("text"))
    spans = repeated_spans(docs, length, gram, crowded).withColumnsRenamed({"doc_id": "_doc", "hash": "_hash"})
    both = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_doc"]) & (rows["hash"] == spans["_hash"]), "left").select("doc_id", "text", "first", "last")

    def run(batches):
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text, first, last in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(),
                                              batch.column("first").to_pylist(), batch.column("last").to_pylist()):
                kept, at, n_spans = [], 0, 0
                end = -1
                for a, b in sorted(zip(first, last)) if first else ():
                    if a > end:
                        n_spans += 1
                        kept.append(text[at:a])
                    end = max(end, b + length)
                    at = end
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((doc, len(text), len(text) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest))
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string()), pa.array(c[5], pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
