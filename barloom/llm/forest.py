"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Equal sets are one node. Every node has ``TREES`` sorted orders, each by ``DEPTH`` minhash values in turn. In the sorted order
those with the longest common prefix stand next to each other, and a node's neighbours with a prefix of ``LEAST`` values or
more are its candidates; how deep that prefix is depends on how crowded the region is. A pair of similarity 0.75 shares
two values in one of 16 orders at least but for 2 in a million.

In a crowded region (more nodes with one prefix than there are neighbours) most neighbours are copies of a common
original that are less like each other than like it. So at depths 2, 4 and 6 each such region also has pivots, the nodes
that have most neighbours with equal values in all orders, as an original has, and each member is a candidate with them.
The first pivots are confirmed first; then only candidates that those links leave in different components are made.

Candidates are thinned by a sketch of 192 one-byte minhashes (a similarity of 0.75 falls below the limit in one pair of a
million), then confirmed by the exact size of the intersection: first each node's best candidates, then all pairs that
still join two components.

A region of no more nodes than there are neighbours has all its pairs made. What may be missed lies in crowded regions that still
hold two components, and for the nodes of these an exact join follows. Two nodes of different components can share only shingles
that are seen in two components. Spark counts these; a node with fewer than three quarters of its set among them has no link. Nodes
with the same such shingles and the same size are alike to all others in the same way, so they are one class, however many
share a template. Classes are joined on their rarest shingles (the smallest one two similar sets have in common
lies in the first quarter of the larger set and in the first seventh of the smaller one), in blocks, and confirmed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage, only_result

from .common import slices, texts
from .graph import components

THRESHOLD, WORDS = 75, 5
TREES, DEPTH, LEAST, NEIGHBOURS = 16, 6, 2, 4
PIVOT_DEPTHS = (2, 4, 6)
SKETCH, SKETCH_LEAST = 192, 0.60
#: Best candidates of a node that are confirmed first.
FIRST = 2
#: Pivots that a node is compared with first, and classes of one shingle in one block of the exact join.
TOP, BLOCK = 2, 256

_MASK = (1 << 64) - 1
_RANDOM = np.random.RandomState(20240229)
_FACTORS = (_RANDOM.randint(0, 1 << 62, SKETCH).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_SPREAD = (_RANDOM.randint(0, 1 << 62, WORDS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


class _Known(dict):
    """64-bit hashes of words; emptied when large, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_KNOWN = _Known()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(strings: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of each text (A-Z lowered, split at ASCII white space)."""
    split = [s.encode().lower().split() for s in strings]
    n = [len(w) for w in split]
    h = np.fromiter((_KNOWN[w] for ws in split for w in ws), np.uint64, sum(n))
    if len(h) >= WORDS:
        m = len(h) - WORDS + 1
        runs = np.zeros(m, np.uint64)
        for i in range(WORDS):
            runs += h[i:i + m] * _SPREAD[i]
        runs = _mix(runs)
    out, at = [], 0
    for ws, k in zip(split, n):
        if k >= WORDS:
            out.append(np.unique(runs[at:at + k - WORDS + 1]))
        elif k:
            import xxhash
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def _minhashes(s: np.ndarray) -> np.ndarray:
    best = np.full(SKETCH, _MASK, np.uint64)
    for i in range(0, len(s), 512):
        best = np.minimum(best, (s[i:i + 512, None] * _FACTORS).min(axis=0))
    return best


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, hash of the set, tree keys (big-endian, 4 bytes a value) and sketch of every document."""
    def run(batches):
        import xxhash
        for batch in slices(batches, most=2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist())
            keys, sketches, a, b = [], [], [], []
            for s in sets:
                digest = xxhash.xxh3_128_digest(s.tobytes())
                a.append(int.from_bytes(digest[:8], "big", signed=True))
                b.append(int.from_bytes(digest[8:], "big", signed=True))
                m = _minhashes(s)
                keys.append((m[:TREES * DEPTH] >> np.uint64(32)).astype(">u4").tobytes())
                sketches.append((m >> np.uint64(16)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "keys", "sketch"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys binary, sketch binary")


def _crowds(batches):
    """Streams one range of the sorted orders: kind 1 a member (region, node), 2 a weight (node, neighbours alike)."""
    return _stream(batches, pairs=False)


def _neighbours(batches):
    """Streams one range of the sorted orders: kind 0, a pair of neighbours in different components."""
    return _stream(batches, pairs=True)


def _stream(batches, pairs: bool):
    reach = NEIGHBOURS + 1
    held: tuple | None = None

    def table(batch):
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint64)
        rest = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "rep", "n_shingles", "component")]
        return (np.column_stack([rest[0].astype(np.uint64), keys]), *rest[1:])

    def emit(t, first: int, end: int):
        """Rows from first to end; those around them are context."""
        keys, rep, size, component = t
        none = np.zeros(0, np.int64)
        out = [(none, none, none)]
        after, before = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
        crowd = {d: np.zeros(len(rep), bool) for d in PIVOT_DEPTHS}
        for j in range(1, reach + 1):
            if len(rep) <= j:
                break
            same = np.logical_and.accumulate(keys[j:] == keys[:-j], axis=1)
            depth = same.sum(axis=1) - 1  # the tree is the first column
            if pairs and j <= NEIGHBOURS:
                lo, hi = np.minimum(size[j:], size[:-j]), np.maximum(size[j:], size[:-j])
                i = np.flatnonzero((depth >= LEAST) & (100 * lo >= THRESHOLD * hi) & (component[j:] != component[:-j])) + j
                i = i[(i >= first) & (i < end)]
                a, b = rep[i], rep[i - j]
                out.append((np.zeros(len(i), np.int64), np.minimum(a, b), np.maximum(a, b)))
            if pairs:
                continue
            whole = np.flatnonzero(depth == DEPTH)
            before[whole + j] += 1
            after[whole] += 1
            if j == reach:
                for d in PIVOT_DEPTHS:
                    # the rows from i - reach to i have one prefix: the region is crowded for all of them
                    hit = np.zeros(len(rep) + 1, np.int64)
                    i = np.flatnonzero(depth >= d)
                    np.add.at(hit, i, 1)
                    np.add.at(hit, i + reach + 1, -1)
                    crowd[d] |= np.cumsum(hit[:-1]) > 0
        own = np.zeros(len(rep), bool)
        own[first:end] = True
        for d in () if pairs else PIVOT_DEPTHS:
            i = np.flatnonzero(own & crowd[d])
            if len(i):
                region = np.full(len(i), d, np.uint64)
                for c in range(d + 1):
                    region = _mix(region * np.uint64(0x9E3779B97F4A7C15) + keys[i, c])
                out.append((np.ones(len(i), np.int64), region.astype(np.int64), rep[i]))
        i = np.flatnonzero(own & crowd[PIVOT_DEPTHS[0]])  # empty if pairs are wanted
        out.append((np.full(len(i), 2, np.int64), rep[i], np.maximum(before, after)[i]))
        kind, x, y = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y)], names=["kind", "x", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = table(batch)
        if held is None:
            t, first = new, 0
        else:
            t, first = tuple(np.concatenate([o, n]) for o, n in zip(held[0], new)), held[1]
        end = max(len(t[1]) - reach, first)  # later rows wait for their followers
        yield emit(t, first, end)
        keep = max(end - reach, 0)
        held = (tuple(c[keep:] for c in t), end - keep)
    if held is not None:
        yield emit(held[0], held[1], len(held[0][1]))


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, est of the pairs whose sketches are alike enough and whose sizes allow the similarity."""
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("rep").alias(side), F.col("sketch").alias(f"s{side}"), F.col("n_shingles").alias(f"n{side}")), side)
    pairs = pairs.where(100 * F.least("nu", "nv") >= THRESHOLD * F.greatest("nu", "nv"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("su", "sv"))
                share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                keep = share >= SKETCH_LEAST
                yield pa.RecordBatch.from_arrays([*(pa.array(batch.column(c).to_numpy()[keep]) for c in ("u", "v", "nu", "nv")), pa.array(share[keep])],
                                                 names=["u", "v", "nu", "nv", "est"])

    return pairs.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long, nu long, nv long, est double")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and the whole shingle set of the wanted nodes."""
    def run(batches):
        for batch in slices(batches, most=2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "shingles"])

    rows = texts(docs)
    return rows.join(wanted, rows["doc_id"] == wanted["rep"], "left_semi").mapInArrow(run, "rep long, shingles array<bigint>")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v, nu, nv) whose full sets reach the threshold."""
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("_a")), "u").join(
        sets.select(F.col("rep").alias("v"), F.col("shingles").alias("_b")), "v")
    both = both.select("u", "v", "nu", "nv", F.size(F.array_intersect("_a", "_b")).alias("_common"))
    return both.where(100 * F.col("_common") >= THRESHOLD * (F.col("nu") + F.col("nv") - F.col("_common"))).select("u", "v")


_FOUND = "kind long, x long, y long"


def _orders(nodes: DataFrame) -> DataFrame:
    """All sorted orders of the nodes (rep, n_shingles, keys, component), in ranges."""
    cut = F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(keys, {4 * DEPTH} * t + 1, {4 * DEPTH}))")
    orders = nodes.select(F.posexplode(cut).alias("tree", "key"), "rep", "n_shingles", "component")
    return orders.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("rep")).distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """The pairs that are among the FIRST most alike of one of their ends."""
    ends = pairs.select("u", "v", "nu", "nv", "est", F.explode(F.array("u", "v")).alias("end"))
    ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("end").orderBy(F.desc("est"), "u", "v")))
    return ranked.where(F.col("r") <= FIRST).select("u", "v", "nu", "nv").distinct()


def _placed(rows: DataFrame, key: str, near: DataFrame) -> DataFrame:
    """Adds the component of a node; a node without links is its own."""
    at = near.select(F.col("node").alias(key), F.col("component").alias("_c"))
    return rows.join(at, key, "left").withColumn("component", F.coalesce("_c", key)).drop("_c")


def _open_links(docs: DataFrame, members: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (u, v) that join all nodes of crowded regions which are at the threshold and lie in different components."""
    at = members.join(placed.select("rep", "component"), "rep")
    regions = at.groupBy("region").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("region")
    open_nodes = cut_lineage(at.join(regions, "region").select("rep", "component").distinct())
    rows = cut_lineage(_sets(docs, open_nodes.select("rep")).join(open_nodes, "rep"))
    own = rows.select("rep", "component", F.explode("shingles").alias("shingle"))
    shared = own.groupBy("shingle").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("df"))
    seen = own.join(shared.where("_a <> _b").select("shingle", "df"), "shingle").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("_s"))
    least = F.ceil(F.col("n") * THRESHOLD / 100)
    able = seen.join(rows.select("rep", "component", F.size("shingles").alias("n")), "rep").where(F.size("_s") >= least)
    able = cut_lineage(able.select("rep", "component", "n", F.expr("transform(_s, x -> x.shingle)").alias("common"),
                                   F.xxhash64("_s").alias("k1"), F.xxhash64(F.lit(1), "_s").alias("k2")))
    keys = ["k1", "k2", "n"]
    classes = able.groupBy(*keys).agg(F.min("rep").alias("cls"), F.min("component").alias("low"), F.max("component").alias("high"))
    classes = cut_lineage(classes.join(able.select("rep", "common"), F.col("cls") == F.col("rep")).drop("rep").withColumn("f", F.size("common")))

    within = classes.where(f"low <> high AND 100 * f >= {THRESHOLD} * (2 * n - f)").select(F.col("cls").alias("u"), F.col("cls").alias("v"))
    ordered = classes.select("cls", "n", "f", "low", "high", F.posexplode("common").alias("at", "shingle")).where(F.col("at") <= F.col("f") - least)
    crowd = ordered.groupBy("shingle").agg(F.count("*").alias("_n")).where("_n > 1").select("shingle", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    seen = cut_lineage(ordered.join(crowd, "shingle").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    names = ("cls", "n", "f", "low", "high", "at")
    small = seen.where(F.col("at") <= F.col("f") - F.ceil(F.col("n") * (2 * THRESHOLD) / (100 + THRESHOLD)))
    small = small.select("shingle", F.col("block").alias("i"), every.alias("j"), *(F.col(c).alias(f"{c}_u") for c in names))
    large = seen.select("shingle", every.alias("i"), F.col("block").alias("j"), *(F.col(c).alias(f"{c}_v") for c in names))
    met = small.join(large, ["shingle", "i", "j"]).where(
        "(n_u < n_v OR n_u = n_v AND cls_u < cls_v) AND NOT (low_u = high_u AND low_v = high_v AND low_u = low_v)"
        f" AND 100 * n_u >= {THRESHOLD} * n_v AND {100 + THRESHOLD} * least(f_u - at_u, f_v - at_v) >= {THRESHOLD} * (n_u + n_v)")
    pairs = met.select(F.col("cls_u").alias("u"), F.col("cls_v").alias("v")).distinct()
    for side in ("u", "v"):
        pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("n").alias(f"n{side}"), F.col("common").alias(f"_{side}")), side)
    pairs = pairs.select("u", "v", "nu", "nv", F.size(F.array_intersect("_u", "_v")).alias("_common"))
    joined = cut_lineage(pairs.where(100 * F.col("_common") >= THRESHOLD * (F.col("nu") + F.col("nv") - F.col("_common"))).select("u", "v").union(within))
    # All members of a class that has a link are joined by it, whatever component each is in.
    linked = _ends(joined).join(classes.select(F.col("cls").alias("rep"), *keys), "rep").select(F.col("rep").alias("u"), *keys)
    return joined.where("u <> v").union(able.join(linked, keys).select("u", F.col("rep").alias("v")).where("u <> v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Two documents are linked if 100 * common shingles >= 75 * all shingles of both; a component holds what links reach.
    Null texts, empty texts and texts without a word have no shingle, are linked with nothing and stay. Rows with
    equal text are one node, rows that share a ``doc_id`` as well. A null id never names a component (a component of null
    ids alone has a null id, and its rows stay). Other columns are ignored; an empty table gives no rows.
    """
    return only_result(docs.sparkSession, lambda: _near_duplicates(docs))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    table = cut_lineage(signatures(docs))
    full = table.where("n_shingles > 0")
    groups = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    first = full.where("doc_id IS NOT NULL")
    nodes = cut_lineage(first.join(groups.where("rep IS NOT NULL"), ["f1", "f2"]).where("doc_id = rep")
                        .select("rep", "n_shingles", "keys", "sketch").dropDuplicates(["rep"]))

    found = cut_lineage(_orders(nodes.withColumn("component", F.col("rep"))).mapInArrow(_crowds, _FOUND))
    weights = found.where("kind = 2").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("weight"))
    members = found.where("kind = 1").select(F.col("x").alias("region"), F.col("y").alias("rep"))
    heaviest = members.join(weights, "rep").groupBy("region").agg(F.min(F.struct(-F.col("weight"), "rep")).alias("p")).select("region", F.col("p.rep").alias("pivot"))
    pairs = members.join(heaviest, "region").where("rep <> pivot").groupBy("rep", "pivot").count()
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("count"), "pivot"))).where(F.col("r") <= TOP)
    pairs = pairs.select(F.least("rep", "pivot").alias("u"), F.greatest("rep", "pivot").alias("v")).distinct()
    pairs = cut_lineage(_alike(pairs, nodes).select("u", "v", "nu", "nv"))
    links = cut_lineage(_confirm(pairs, _sets(docs, _ends(pairs))))

    placed = cut_lineage(_placed(nodes, "rep", components(links)))
    pairs = _orders(placed).mapInArrow(_neighbours, _FOUND).select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
    pairs = cut_lineage(_alike(pairs, nodes))
    sets = cut_lineage(_sets(docs, _ends(pairs)))
    links = cut_lineage(links.union(_confirm(_best(pairs), sets)))
    near = components(links)
    rest = pairs
    for side in ("u", "v"):
        rest = _placed(rest, side, near).withColumnRenamed("component", f"c{side}")
    links = cut_lineage(links.union(_confirm(rest.where("cu <> cv").select("u", "v", "nu", "nv"), sets)))
    near = cut_lineage(components(links))
    missed = cut_lineage(_open_links(docs, members, _placed(nodes.select("rep"), "rep", near)))
    if not missed.isEmpty():
        near = components(links.union(missed))

    groups = groups.join(near, groups["rep"] == near["node"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"), F.lit(1).alias("_some"))
    out = table.select("doc_id", "n_shingles", "f1", "f2").join(groups, ["f1", "f2"], "left")
    component = F.when(F.col("_some").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows whose ``kept`` is false; all columns stay. Rows that repeat the kept id all stay."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")
