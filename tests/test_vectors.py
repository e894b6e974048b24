"""Pairs of vectors, made within blocks, against plain NumPy."""

import numpy as np
import pytest

from scriptorium.operators import vectors as V


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.integers(-3, 4, 6).astype(float) + 0.5 for i in range(260)}
    rows |= {i: rows[i - 7] for i in range(20, 60, 3)}  # equal vectors
    rows[9], rows[50] = None, np.zeros(6)  # a missing vector, and a query of zeros
    return rows, spark.createDataFrame([(i, i % 4, None if v is None else v.tolist()) for i, v in rows.items()], "vec_id long, label int, embedding array<double>")


def test_nearest_of_all(table, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_BYTES", 16 * 6 * 8)
    rows, frame = table
    got = {}
    for r in V.nearest(frame).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["d"]))
    for q in range(0, 260, 50):
        far = sorted((round(float(np.sqrt(((rows[q] - v) ** 2).sum())), 6), i) for i, v in rows.items() if i != q and v is not None)
        assert sorted(got.pop(q)) == [(k + 1, i, pytest.approx(d, abs=1e-9)) for k, (d, i) in enumerate(far[:5])]
    assert not got


def test_pairs_of_zeros_and_missing_vectors(table):
    rows, frame = table
    got = {(r["query_id"], r["vec_id"]): r for r in V.distances(frame).collect()}
    assert len(got) == 6 * 259 and got[0, 9]["euclidean"] is None and got[50, 3]["cosine"] == 0
    for (q, i), r in got.items():
        if i != 9:
            assert r["manhattan"] == pytest.approx(np.abs(rows[q] - rows[i]).sum()) and r["euclidean"] == pytest.approx(np.sqrt(((rows[q] - rows[i]) ** 2).sum()), abs=1e-6)
    shares = {(r["query_id"], r["vec_id"]): r["jsd"] for r in V.divergences(frame).collect()}
    p, w = (np.abs(rows[i]) / np.abs(rows[i]).sum() for i in (100, 3))
    assert shares[100, 3] == pytest.approx(0.5 * sum((a * np.log(2 * a / (p + w))).sum() for a in (p, w)), abs=1e-6) and np.isnan(shares[50, 3])


def test_work_is_dealt_out_whatever_the_files(table):
    plan = V.distances(table[1].coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "RoundRobinPartitioning" in plan
