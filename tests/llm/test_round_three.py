"""Whitening, periodic runs and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from decimal import Decimal

import numpy as np
import pytest
from fixtures import bytes_words
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from graphspan.llm import cross_polytope, periodic_runs, whitening

VECTORS = "vec_id long, embedding array<double>, label int"


def _odd_vectors() -> list[tuple]:
    return [
        (900, None, 1), (901, [], 1), (902, [float("nan")] + [1.0] * 11, 1), (903, [None] + [1.0] * 11, 1), (904, [float("inf")] + [1.0] * 11, 1),
        (905, [1.0, 2.0], 1), (None, [0.5] * 12, 1),
    ]


def _whitened(rows: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """x, its leading components, deviations and eigenvalues, plainly."""
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, _ in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(((n * r - total) ** 2).sum()) for r in x]
    c = (n * x - total).astype(float) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1], basis[:, ::-1]
    return c @ basis[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), deviation, values


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(2)
    scale = 3.0 ** -np.arange(12)
    rows = [(i, (rng.normal(size=12) * scale + 0.1).tolist(), i % 3) for i in range(300)]
    rows += [(300 + i, rows[5][1], 1) for i in range(50)] + [rows[7], (8, rows[9][1], 2)]
    df = spark.createDataFrame(rows + _odd_vectors()[:6], VECTORS).repartition(5).withColumn("component", F.lit("x"))
    got = whitening.whiten(df, 6).collect()
    want, explained, deviation, _ = _whitened(rows, 6)
    assert len(got) == 6 * len(rows) and {r["n"] for r in got} == {len(rows)}
    by_id: dict = {}
    for r in got:
        by_id.setdefault(r["id"], {}).setdefault(r["component"], []).append(r)
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    ids = [r[0] for r in rows]
    for j in range(6):
        sign = np.sign(by_id[0][j + 1][0]["whitened"] * want[0, j])
        for i in set(ids):
            mine = sorted(r["whitened"] for r in by_id[i][j + 1])
            assert np.allclose(mine, sorted(sign * want[a, j] for a, x in enumerate(ids) if x == i), atol=1e-8)
            assert sorted(r["deviation"] for r in by_id[i][j + 1]) == sorted(Decimal(deviation[a]) for a, x in enumerate(ids) if x == i)


@pytest.mark.parametrize("rows", [[], _odd_vectors()[:5], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1)] * 4])
def test_whitening_of_nothing_that_varies(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_whitening_of_fewer_dimensions_than_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(a), 7.0, float(b)], 0) for i, (a, b) in enumerate(rng.integers(0, 9, (40, 2)))]
    got = whitening.whiten(spark.createDataFrame([*rows, (None, [1.0, 1.0, 7.0, 2.0], 0), (99, [2.0**40, 0.0, 0.0, 0.0], 0)], VECTORS)).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 82 and {r["n"] for r in got} == {41}
    assert sum(r["id"] is None for r in got) == 2


def test_deviations_beyond_64_bits():
    y = np.array([[1 << 24, -5], [3, 1 << 23], [1 << 45, 0]])
    got = whitening._deviations(y, 1 << 33, np.array([7, 9])).to_pylist()
    want = [sum(((1 << 33) * int(a) - r) ** 2 for a, r in zip(row, (7, 9))) for row in y]
    assert [int(x) for x in got[:2]] == want[:2] and got[2] is None


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(d + 3, d)) * 10.0 ** -np.arange(d).clip(max=9)
    a = x.T @ x
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
    assert (np.diff(values) <= 0).all()


def test_jacobi_small_eigenvalues():
    scale = 10.0 ** -np.arange(8)
    core = np.eye(8) + 0.1 * (1 - np.eye(8))
    values, vectors = whitening.jacobi(core * scale[:, None] * scale)
    # the determinant of the core is known: its eigenvalues are 0.9 (seven times) and 1.7
    assert np.isclose(np.log(values).sum(), np.log(0.9**7 * 1.7) + 2 * np.log(scale).sum(), rtol=1e-13)


def _runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    out, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q) and not any(all(w[a] == w[a + p] for a in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5), st.sampled_from([2, 4, 12]))
def test_find_runs(texts, least):
    ids, bounds = np.array([x for t in texts for x in t], dtype=np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    text, start, length, period = (x.tolist() for x in periodic_runs.find_runs(ids, bounds, least))
    assert list(zip(text, start, length, period)) == [(i, *r) for i, t in enumerate(texts) for r in _runs(t, least)]


@pytest.mark.parametrize("few", [0, 10**9])
def test_few_and_many_positions_alike(monkeypatch, few):
    """The step with arrays and the one without give the same runs."""
    monkeypatch.setattr(periodic_runs, "_FEW", few)
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.randrange(3) for _ in range(rng.randint(2, 90))]
        a = rng.randrange(len(w))
        w += w[a:] * rng.randrange(4)
        got = periodic_runs.find_runs(np.array(w), np.array([0, len(w)]), 2)
        assert list(zip(*(x.tolist() for x in got[1:]))) == _runs(w, 2)


def test_runs_of_positions_beyond_the_packed_ones(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_BITS", 3)
    monkeypatch.setattr(periodic_runs, "_FEW", 0)
    w = [1, 2, 3, 1, 2, 3, 1, 2, 9, 9, 9, 9, 1, 2] * 4
    got = periodic_runs.find_runs(np.array(w), np.array([0, len(w)]), 2)
    assert list(zip(*(x.tolist() for x in got[1:]))) == _runs(w, 2)


def test_a_long_text_takes_n_log_n():
    base = np.random.default_rng(0).integers(0, 50_000, 70_000)
    w = base[np.arange(300_000) % 70_000]
    got = periodic_runs.find_runs(w, np.array([0, len(w)]))
    assert [x.tolist() for x in got[1:]] == [[0], [300_000], [70_000]]


def _op12(doc_id, text) -> tuple:
    w = bytes_words(text)
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def _run_texts() -> list[tuple]:
    rng, rows = random.Random(8), []
    for i in range(150):
        w = [rng.choice(["a", "b", "é", "漢", "xy"]) if i % 3 else f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 5, 11, 12, 40, 90]))]
        if w and i % 4 == 0:
            w += w[-rng.randint(1, len(w)) :] * rng.randint(1, 5)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "la " * 30), (203, "la " * 30), (203, "la " * 31), (204, "nbsp nbsp " * 20), rows[8], (-5, "x y " * 9)]
    return rows


def test_op12_matches_brute_force(spark, tmp_path):
    rows = _run_texts()
    spark.createDataFrame([(*r, "n_runs") for r in rows], "doc_id long, text string, Runs string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic_runs.op12(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((_op12(*r) for r in rows), key=repr)
    assert sum(_op12(*r)[1] for r in rows) > 30


def test_periodic_runs_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 8, "mine", 3), (None, None, None, None)], "doc_id long, text string, Collapsed string, n int")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[1].asDict(True) == {"doc_id": 1, "text": "a b " * 8, "n": 3, "n_words": 16, "runs": [{"start": 0, "length": 16, "period": 2}], "collapsed": "a b"}
    assert got[None]["n_words"] == 0 and got[None]["runs"] == [] and got[None]["collapsed"] == ""
    assert periodic_runs.periodic_runs(docs.filter("false")).count() == 0


def test_runs_of_blocks_and_very_long_texts(spark, monkeypatch):
    """Texts over several blocks, one of them of two million words (over 8 MB) alone in its own."""
    long = " ".join(f"{i % 700_001:06d}" for i in range(1_500_000))
    docs = spark.createDataFrame([(i, "p q r " * 10 if i % 2 else "s") for i in range(50)] + [(99, long)], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).select("doc_id", "runs", "n_words", F.length("collapsed").alias("n")).collect()}
    assert [tuple(x) for x in got[99]["runs"]] == [(0, 1_500_000, 700_001)] and got[99]["n"] == 7 * 700_001 - 1
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 30, 3)] and got[0]["runs"] == []


def _search(rows: list[tuple], queries: list[tuple], k: int) -> dict:
    """Answers by (id, vector) of the query, plainly."""
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    mine = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and ok(v)})
    out: dict = {}
    for i, v, _ in queries:
        if i is None or not ok(v):
            continue
        scored = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in mine if len(w) == len(v) and (j, w) != (i, tuple(v)))
        out[i, tuple(v)] = scored[:k]
    return out


def _clustered(seed: int = 3, n: int = 600, scale: float = 0.3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(20, 12))
    rows = [(i, (centre[i % 20] + rng.normal(scale=scale, size=12)).tolist(), 0) for i in range(n)]
    rows += [(1000 + i, rows[4][1], 0) for i in range(120)] + [rows[20], (40, rows[3][1], 0), (2000, (np.array(rows[4][1]) * 40).tolist(), 0), (2100, [0.0] * 12, 0)]
    return rows + _odd_vectors()


@pytest.mark.parametrize("settings", [{}, {"aim": 8, "tables": 3}, {"part": 16, "aim": 64}])
def test_search_finds_the_nearest(spark, settings):
    rows = _clustered()
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    got: dict = {}
    for r in cross_polytope.search(df, df.filter("vec_id % 10 = 0"), 5, **settings).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["id"]))
    want = _search(rows, asked, 5)
    hits = total = 0
    for i in {i for i, _ in want}:
        told = [x for (j, _), answers in want.items() if j == i for x in answers]
        assert len(got[i]) == len(told) and sorted(r for r, _, _ in got[i]) == sorted(a + 1 for (j, _), answers in want.items() if j == i for a in range(len(answers)))
        total += len(told)
        left = list(told)
        for _, score, j in got[i]:
            if (score, j) in left:
                left.remove((score, j))
                hits += 1
    assert hits >= 0.93 * total
    # copies: the nearest of one of them are the others with the smallest ids
    assert sorted(got[1050]) == [(1, 0.0, 4), (2, 0.0, 1000), (3, 0.0, 1001), (4, 0.0, 1002), (5, 0.0, 1003)]
    assert sorted(got[1000])[:2] == [(1, 0.0, 4), (2, 0.0, 1001)]


def test_search_of_few_rows_gives_all_others(spark):
    rows = [(100, [1.0, 0.0], 0), (200, [-1.0, 0.0], 0), (3, [0.0, 1e-3], 0), (3, [0.0, 1e-3], 0), (4, [0.0, 0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, cross_polytope.search(df, df.filter("vec_id % 100 = 0")).collect()))
    far = float(np.sqrt(1 + 1e-6))
    assert got == [(100, 1, 3, far), (100, 2, 200, 2.0), (200, 1, 3, far), (200, 2, 100, 2.0)]
    assert cross_polytope.search(df.filter("false"), df.filter("false")).count() == 0
    assert cross_polytope.search(df, df.filter("false")).count() == 0


def test_search_of_all_rows_where_buckets_hold_too_few(spark, monkeypatch):
    """One visit a query: what it misses is searched in blocks, and ranks are whole."""
    monkeypatch.setattr(cross_polytope, "plan_visits", lambda *a: (4096.0, 1, 0))
    monkeypatch.setattr(cross_polytope, "_BLOCK", 7)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(200)]
    df = spark.createDataFrame(rows, VECTORS)
    got = cross_polytope.search(df, df.filter("vec_id % 10 = 0"), 10, aim=4).collect()
    want = _search(rows, [r for r in rows if r[0] % 10 == 0], 10)
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == sorted((i, a + 1, j, s) for (i, _), found in want.items() for a, (s, j) in enumerate(found))


def test_polytopes_and_visits():
    x = np.random.default_rng(1).normal(size=(50, 12))
    for buckets in (1, 2, 30, 300, 5000):
        p = cross_polytope.Polytopes(12, 0, buckets)
        every = int(np.prod([2 * a for a in p.axes]))
        assert every >= buckets
        seen = p.visits(x, every)
        assert (np.sort(seen, axis=1) == np.arange(every)).all() and (seen[:, 0] == p.bucket(x)).all()
        assert (p.visits(x, 5) == seen[:, :5]).all()
    for y in cross_polytope.Polytopes(12, 0, 32).turned(x):
        assert np.allclose((y**2).sum(axis=1), 1)


def test_the_thin_queries_over_a_table_of_floats(spark, tmp_path):
    """op11 and op13 over single precision, extra columns and odd rows, by their contracts."""
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32)], i % 2) for i in range(320)]
    spark.createDataFrame(rows + _odd_vectors()[:5], "vec_id long, embedding array<float>, rank int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    white = whitening.op11(spark, str(tmp_path))
    assert dict(white.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    want, explained, deviation, _ = _whitened(rows, 8)
    got = {(r["vec_id"], r["component"]): r for r in white.collect()}
    assert len(got) == 8 * 320 and all(got[i, 1]["deviation"] == deviation[i] for i in range(320))
    for j in range(8):
        mine = np.array([got[i, j + 1]["whitened"] for i in range(320)])
        assert np.allclose(mine * np.sign(mine[0] * want[0, j]), want[:, j], atol=1e-8) and abs(got[0, j + 1]["explained"] / explained[j] - 1) < 1e-9
    found = cross_polytope.op13(spark, str(tmp_path))
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    exact = _search(rows, [rows[0], rows[100], rows[200], rows[300]], 10)
    told = {(r["query_id"], r["rank"]): (r["score"], r["vec_id"]) for r in found.collect()}
    assert len(told) == 40
    hits = sum((s, j) in {told[i, a] for a in range(1, 11)} for (i, _), answers in exact.items() for s, j in answers)
    assert hits >= 36
