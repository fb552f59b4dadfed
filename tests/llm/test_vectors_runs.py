"""Nearest neighbours, whitening and periodic runs against brute force and on odd rows."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from barloom.llm import queries, runs, vantage, whitening

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]),
       (None, [1.0, 2.0]), (10, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [3.0, -1.0]), (12, [3.0, -1.0]), (13, [5.0, 0.5]), (14, [1e100, 1.0])]
KIND = "vec_id long, embedding array<double>, text string, v int, x int"


def odd(spark, rows):
    return spark.createDataFrame([(i, e, "t", 1, 2) for i, e in rows], KIND)


# runs

def brute_runs(words):
    names = {}
    w = np.array([names.setdefault(x, len(names)) for x in words], np.int64)
    found = {}
    for q in range(1, len(w) // 4 + 1):
        same = np.diff(np.concatenate(([0], (w[:-q] == w[q:]).astype(int), [0])))
        for a, b in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((a, b + q), q)
    return sorted((a, q, b - a) for (a, b), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, q, n in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1])) if found else None
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return (doc_id, len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, q, n in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_equals_brute_force_on_whole_texts(spark):
    got = sorted(tuple(r) for r in queries.op12_grammar_runs(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(brute_row(*r) for r in docs)
    assert any(r[1] for r in got)


def test_runs_of_many_shapes():
    rng = np.random.default_rng(3)
    shapes = [lambda n: rng.integers(0, 2, n), lambda n: rng.integers(0, 3, n), lambda n: np.zeros(n, int),
              lambda n: np.tile(rng.integers(0, 4, rng.integers(1, 9)), 20)[:n],
              lambda n: np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 6)), rng.integers(1, 9)) for _ in range(5)])]
    for _ in range(150):
        docs = [shapes[rng.integers(len(shapes))](int(rng.integers(0, 120))) for _ in range(rng.integers(1, 7))]
        ends = np.cumsum([len(d) for d in docs])
        start, end, q = runs.runs_of(np.concatenate(docs).astype(np.int64), ends)
        first = ends - [len(d) for d in docs]
        doc = np.searchsorted(ends, start, "right")
        for k, d in enumerate(docs):
            mine = doc == k
            got = sorted(zip((start[mine] - first[k]).tolist(), q[mine].tolist(), (end[mine] - start[mine]).tolist()))
            assert got == brute_runs(d.tolist())


def test_runs_fibonacci_and_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    long = np.concatenate([np.tile(np.arange(700), 5), np.zeros(4000, int), np.tile([0, 0, 1], 2000)])
    for w in (np.array(b), long):
        start, end, q = runs.runs_of(w.astype(np.int64), np.array([len(w)]))
        assert sorted(zip(start.tolist(), q.tolist(), (end - start).tolist())) == brute_runs(w.tolist())


def test_runs_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x " * 5000), (5, "é é " * 8), (6, "a b a b a b a b c")]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find(docs).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a"), (None, 5000, [(0, 5000, 1)], "x"),
        (5, 8, [(0, 8, 1)], "é é"), (6, 9, [(0, 8, 2)], "a b c")], key=str)
    assert runs.digest(runs.find(docs.where("false"))).collect() == []


# nearest neighbours

def brute_nearest(rows, k, asked):
    """rows: id -> vector."""
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    out = set()
    for i in asked:
        d = np.sqrt(((x - np.array(rows[i], float)) ** 2).sum(1))
        best = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out |= {(i, rank + 1, int(ids[j]), round(float(d[j]), 10)) for rank, j in enumerate(best)}
    return out


def rounded(found):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 10)) for r in found.collect()}


def table_vectors(spark, folder):
    return {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}


@pytest.mark.parametrize("shard_bytes,block_bytes", [(1 << 22, 1 << 23), (1 << 15, 1 << 10)])
def test_nearest_factor_one_is_exact(spark, shard_bytes, block_bytes):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    trees = vantage.index(rows, shard_bytes)
    assert trees.selectExpr("sum(length(ids) div 8)").first()[0] == rows.count()
    got = vantage.search(trees, rows.where("vec_id % 20 = 0"), 10, 1.0, block_bytes)
    all_rows = table_vectors(spark, SF)
    assert rounded(got) == brute_nearest(all_rows, 10, [i for i in all_rows if i % 20 == 0])


def test_nearest_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    all_rows = table_vectors(spark, folder)
    exact = brute_nearest(all_rows, 10, [i for i in all_rows if i % 100 == 0])
    got = rounded(queries.op11_vantage_points(spark, folder))
    assert len(got) == len(exact)
    pairs = lambda found: {(a, b) for a, _, b, _ in found}
    assert len(pairs(got) & pairs(exact)) >= 0.9 * len(exact)


def test_nearest_odd_rows(spark):
    rows = odd(spark, ODD)
    got = vantage.search(vantage.index(rows), rows, 3, 1.0)
    valid = {i: e for i, e in ODD if i in (10, 11, 12, 13, 14)}
    assert {r[:3] for r in rounded(got)} == {r[:3] for r in brute_nearest(valid, 3, valid)}
    assert got.where("query_id = 11 AND rank = 1 AND vec_id = 12 AND score = 0").count() == 1
    assert vantage.search(vantage.index(rows.where("false")), rows, 3).count() == 0
    assert vantage.search(vantage.index(rows), rows.where("false"), 3).count() == 0
    assert vantage.search(vantage.index(rows.where("vec_id = 11")), rows.where("vec_id = 11"), 3).count() == 0


def test_nearest_many_copies_of_one_vector(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(600)], "vec_id long, embedding array<float>")
    got = vantage.search(vantage.index(rows, 1 << 11), rows.where("vec_id % 50 = 0"), 5, 1.0)
    all_rows = {i: [1.0, 2.0] if i % 3 else [float(i), 1.0] for i in range(600)}
    assert rounded(got) == brute_nearest(all_rows, 5, [i for i in all_rows if i % 50 == 0])


# whitening

def check_whitening(rows, got, k):
    """rows: (id, vector); got: collected rows."""
    x = np.floor(256 * np.array([v for _, v in rows], float))
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    cov = (u - s / n).T @ (u - s / n) / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    want = (x - s / n) @ (q[:, :k] / np.sqrt(e[:k]))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    have = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i, _ in rows])
    assert np.allclose(have * np.sign((have * want).sum(0)), want, atol=1e-8)
    assert all(r.n == n and r.identity_error <= 1e-4 for r in got) and len({r.identity_error for r in got}) == 1
    for c in range(1, k + 1):
        assert abs(by[rows[0][0]][c].explained / (e[c - 1] / np.trace(cov)) - 1) < 1e-9
    for (i, _), v in zip(rows, x):
        assert by[i][1].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))


def test_whitening_equals_dense_eigenvectors(spark):
    got = queries.op13_chebyshev_whitening(spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert len(got) == 4 * len(rows)
    check_whitening(rows, got, 4)


def test_whitening_small_block_low_degree_and_hot_vector(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.5, 12)
    rows = [(i, (base[i] if i % 3 else base[0]).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_whitening(rows, whitening.whiten(frame, 3, 1, 3).collect(), 3)


def test_whitening_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 14]
    got = whitening.whiten(odd(spark, rows)).collect()
    kept = [(i, e) for i, e in rows if i in (6, 11, 12, 13)]
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == [6, 10, 11, 12, 13]
    assert sum(r.vec_id == 10 for r in got) == 4 and sum(r.vec_id is None for r in got) == 2
    check_whitening(kept + [(10, [1.0, 2.0])], [r for r in got], 2)
    for none in (rows[:5], rows[8:9], []):
        assert whitening.whiten(odd(spark, none)).collect() == []


def test_whitening_entries_beyond_a_long(spark):
    rows = [(i, [float(i), (-1.0) ** i * 1e18]) for i in range(1, 7)]
    got = whitening.whiten(odd(spark, rows), 1).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got)
