"""Periodic runs of words, found on a Re-Pair grammar of every text.

A run is a stretch of consecutive words with smallest period q that no neighbour extends and that is long enough
(``max(LEAST, FOLD * q)`` words). Per text, in whole-array steps over a slice of texts:

1. Re-Pair: the most frequent pairs of neighbouring symbols become nonterminals until no pair occurs twice. A round takes every
   pair occurrence that is more frequent than the two it overlaps, so the most frequent pair of a text is always taken. The
   occurrences taken are all places where the nonterminal stands in the derivation. What is left of a text is halved down
   to its symbols.
2. The lowest node that holds a run is crossed by it at its boundary. So runs across the boundary are computed once a node, on
   one of its occurrences: for a period q, q words after (or before) the boundary equal the q words beside them; prefix
   hashes test that, and binary search on them gives how far the period reaches inside the node.
3. They are carried to all occurrences, and those of one period that share q words or more are merged to the maximal one.

The runs are verified word by word; hashes that failed would be drawn anew.

Work grows as n log n in the words of a text, memory with the words of a slice (one text at least). Texts are independent, so no row moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

LEAST, FOLD = 6, 4
#: Period candidates tested at once; it bounds memory only.
BLOCK = 1 << 21
#: Bytes of text handled at once, one text at least.
SLICE = 4 << 20
PRIME = (1 << 31) - 1

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated by their counts, and 0, 1, .. within each."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


class Grammar:
    """Nodes (lo, mid, hi) of the derivations: one a nonterminal, with all its occurrences, and those of the halved rest."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, ends: np.ndarray):
        self.nodes: list = []
        self.places: list = []
        self.n_rules = 0
        rest = self._pair(np.unique(doc * (int(ids.max()) + 1) + ids, return_inverse=True)[1].astype(np.int64), doc)
        self._halve(*rest, ends)
        self.lo, self.mid, self.hi = (np.concatenate(x) for x in zip(*self.nodes))
        rule, place = (np.concatenate(x) for x in zip(*self.places)) if self.places else (np.empty(0, np.int64),) * 2
        order = np.argsort(rule, kind="stable")
        self.place, self.first = place[order], np.searchsorted(rule[order], np.arange(self.n_rules + 1))

    def _pair(self, sym: np.ndarray, doc: np.ndarray):
        at, size = np.arange(len(sym)), np.ones(len(sym), np.int64)
        names, done = int(sym.max()) + 1, []
        while len(sym):
            i = np.flatnonzero(doc[1:] == doc[:-1])
            key = sym[i] * names + sym[i + 1]
            # In a a a the pairs overlap: every second one counts.
            again = np.zeros(len(i), bool)
            again[1:] = (key[1:] == key[:-1]) & (i[1:] == i[:-1] + 1)
            start = np.maximum.accumulate(np.where(again, 0, np.arange(len(i))))
            even = (np.arange(len(i)) - start) % 2 == 0
            i, key = i[even], key[even]
            pairs, pair, count = np.unique(key, return_inverse=True, return_counts=True)
            mixed = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (pairs.astype(np.uint64) >> np.uint64(7))
            rank = np.empty(len(pairs), np.int64)
            rank[np.lexsort((mixed, count))] = np.arange(1, len(pairs) + 1)
            rank[count < 2] = 0
            weight = np.zeros(len(sym) + 2, np.int64)
            weight[i + 1] = rank[pair]
            own = weight[i + 1]
            taken = (own > 0) & (own > weight[i]) & (own > weight[i + 2])
            taken &= np.bincount(pair[taken], minlength=len(pairs))[pair] >= 2
            open_docs = np.zeros(int(doc[-1]) + 1, bool)
            open_docs[doc[i[taken]]] = True
            is_open = open_docs[doc]
            done.append((doc[~is_open], at[~is_open]))
            if not taken.any():
                break
            i, pair = i[taken], pair[taken]
            rules, one, rule = np.unique(pair, return_index=True, return_inverse=True)
            lo = at[i[one]]
            mid = lo + size[i[one]]
            self.nodes.append((lo, mid, mid + size[i[one] + 1]))
            self.places.append((self.n_rules + rule, at[i]))
            self.n_rules += len(rules)
            sym[i], size[i] = names + rule, size[i] + size[i + 1]
            names += len(rules)
            is_open[i + 1] = False
            sym, doc, at, size = sym[is_open], doc[is_open], at[is_open], size[is_open]
            # Names are made dense again, so that two of them fit one key.
            sym = np.unique(sym, return_inverse=True)[1].astype(np.int64)
            names = int(sym.max()) + 1
        doc, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at, kind="stable")
        return doc[order], at[order]

    def _halve(self, doc: np.ndarray, at: np.ndarray, ends: np.ndarray) -> None:
        first = np.searchsorted(doc, doc)
        number, last = np.arange(len(doc)) - first, np.searchsorted(doc, doc, "right")
        step = 1
        while step <= int(number.max()):
            j = np.flatnonzero(number % (2 * step) == step)
            right = np.minimum(j + step, last[j])
            hi = np.where(right < last[j], at[np.minimum(right, len(at) - 1)], ends[doc[j]])
            self.nodes.append((at[j - step], at[j], hi))
            step *= 2
        self.nodes.append((np.empty(0, np.int64),) * 3)


class Hashes:
    """Equality of word stretches a distance q apart, by two polynomial prefix hashes."""

    def __init__(self, ids: np.ndarray, longest: int, seed: int):
        rng = np.random.default_rng(seed)
        self.ids = ids
        n = len(ids)
        values = rng.integers(1, PRIME, int(ids.max()) + 1).astype(np.uint64)[ids]
        wide, narrow = np.uint64(int(rng.integers(1 << 62)) * 2 + 1), int(rng.integers(1 << 20, PRIME))
        self.wide = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, wide))), dtype=np.uint64)
        power = np.ones(1, np.uint64)
        while len(power) <= n:
            power = np.concatenate((power, power * np.uint64(pow(narrow, len(power), PRIME)) % np.uint64(PRIME)))
        self.narrow = power[:n + 1]
        zero = np.zeros(1, np.uint64)
        self.h_wide = np.concatenate((zero, np.cumsum(values * self.wide[:n], dtype=np.uint64)))
        self.h_narrow = np.concatenate((zero, np.cumsum(values * self.narrow[:n] % np.uint64(PRIME), dtype=np.uint64)))

    def same(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether words [x, x + n) equal words [x + q, x + q + n)."""
        a, b = self.h_wide, self.h_narrow
        out = (a[x + n] - a[x]) * self.wide[q] == a[x + q + n] - a[x + q]
        p = np.uint64(PRIME)
        out &= (b[x + n] - b[x]) % p * self.narrow[q] % p == (b[x + q + n] - b[x + q]) % p
        return out

    def reach(self, x: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest n <= most for which the n words from x on (or before x) equal those q further."""
        low, high = np.zeros(len(x), np.int64), most.copy()
        while len(x) and (low < high).any():
            n = (low + high + 1) // 2
            good = self.same(x - n if back else x, n, q)
            low, high = np.where(good, n, low), np.where(good, high, n - 1)
        return low


def _crossing(h: Hashes, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray):
    """(node, start, end, period) of the periodic stretches at the boundaries, maximal within their node."""
    w, found = h.ids, []
    least = (hi - lo) // FOLD
    for back in (False, True):
        most = np.minimum((mid - lo if back else hi - mid) // 2, least)
        most[hi - lo < LEAST] = 0
        node = np.flatnonzero(most > 0)
        before = np.cumsum(most[node])
        start = 0
        while start < len(node):
            stop = max(start + 1, int(np.searchsorted(before, (before[start - 1] if start else 0) + BLOCK, "right")))
            row, q = _ragged(most[node[start:stop]])
            row, q = node[start:stop][row], q + 1
            x = mid[row] - 2 * q if back else mid[row]
            keep = (w[x] == w[x + q]) & (w[x + q - 1] == w[x + 2 * q - 1])
            row, q, x = row[keep], q[keep], x[keep]
            keep = h.same(x, q, q)
            found.append((row[keep], q[keep], x[keep]))
            start = stop
    if not found:
        return (np.empty(0, np.int64),) * 4
    row, q, x = (np.concatenate(p) for p in zip(*found))
    start = x - h.reach(x, q, x - lo[row], True)
    end = x + q + h.reach(x, q, hi[row] - q - x, False)
    keep = end - start >= np.maximum(LEAST, FOLD * q)
    row, q, start, end = row[keep], q[keep], start[keep], end[keep]
    order = np.lexsort((q, end, start, row))
    row, q, start, end = row[order], q[order], start[order], end[order]
    # The same stretch with a larger period: a multiple of the smallest one.
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return row[keep], start[keep], end[keep], q[keep]


def runs_of(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period), by start and then period, of the runs of word numbers ``ids``; text k ends before ``ends[k]``."""
    none = (np.empty(0, np.int64),) * 3
    if not len(ids):
        return none
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    grammar = Grammar(ids, doc, ends)
    if not len(grammar.lo):
        return none
    seed = 0
    while True:
        h = Hashes(ids, len(ids), seed)
        node, start, end, q = _crossing(h, grammar.lo, grammar.mid, grammar.hi)
        ruled = node < grammar.n_rules
        r = node[ruled]
        row, k = _ragged(grammar.first[r + 1] - grammar.first[r])
        shift = grammar.place[grammar.first[r[row]] + k] - grammar.lo[r[row]]
        start = np.concatenate((start[~ruled], start[ruled][row] + shift))
        end = np.concatenate((end[~ruled], end[ruled][row] + shift))
        q = np.concatenate((q[~ruled], q[ruled][row]))
        order = np.lexsort((end, start, q))
        start, end, q = start[order], end[order], q[order]
        if not len(q):
            return none
        level = np.unique(q, return_inverse=True)[1] * (len(ids) + 1)
        furthest = np.maximum.accumulate(end + level) - level
        opens = np.ones(len(q), bool)
        opens[1:] = (q[1:] != q[:-1]) | (start[1:] > furthest[:-1] - q[1:])
        begins = np.flatnonzero(opens)
        start, q, end = start[begins], q[begins], np.maximum.reduceat(end, begins)
        if all(np.array_equal(ids[a:b - p], ids[a + p:b]) for a, b, p in zip(start.tolist(), end.tolist(), q.tolist())):
            order = np.lexsort((q, start))
            return start[order], end[order], q[order]
        seed += 1


def _slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
    words = [t.split() for t in raw]  # splits bytes at the space and the five controls only
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts)
    flat = pa.array([w for x in words for w in x], pa.binary()).dictionary_encode()
    start, end, q = runs_of(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends)
    base = ends - counts
    doc = np.searchsorted(ends, start, "right")
    offsets = np.searchsorted(doc, np.arange(len(words) + 1)).astype(np.int32)
    for k in np.unique(doc).tolist():
        change = np.zeros(counts[k] + 1, np.int64)
        mine = slice(offsets[k], offsets[k + 1])
        np.add.at(change, start[mine] + q[mine] - base[k], 1)
        np.add.at(change, end[mine] - base[k], -1)
        words[k] = [w for w, again in zip(words[k], np.cumsum(change).tolist()) if not again]
    fields = [pa.array(x) for x in (start - base[doc], end - start, q)]
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(counts),
        pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
        pa.array([b" ".join(x).decode() for x in words], pa.string()),
    ], ["doc_id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and the text without the repeats of its runs.

    ``collapsed`` holds, joined by one space, the words that no run contains after its first period. A null or empty text, and one
    of white space, has no words, no runs and an empty ``collapsed``. A row whose doc_id is null, and every repeated row, is
    handled like any other. Columns besides doc_id and text are left out. An empty table gives an empty one. Texts of any
    length are taken whole; a text is one step of one task.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            yield _slice(batch)

    return texts(docs).mapInArrow(work, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """One row a text: count, run of the greatest exponent (ties: smallest start, then period), and digests of runs and text."""
    better = "(x, y) -> CASE WHEN x.length * y.period <> y.length * x.period THEN y.length * x.period - x.length * y.period " \
             "WHEN x.start <> y.start THEN x.start - y.start ELSE x.period - y.period END"
    best: Column = F.expr(f"get(array_sort(runs, (x, y) -> cast(signum({better.split('-> ', 1)[1]}) AS int)), 0)")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
