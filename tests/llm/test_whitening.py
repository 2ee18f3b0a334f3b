import math
import random

import numpy as np
import pytest

from splitlift.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n long, v string, dims int"


@pytest.fixture(scope="module")
def vectors(spark):
    def build(rows, kind="float"):
        schema = SCHEMA.replace("float", kind)
        return spark.createDataFrame([(i, v, 7, "x", 9) for i, v in rows], schema)
    return build


def whole(rows):
    """Kept (id, x) in plain Python."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in kept]


def single(v):
    return [None if c is None else float(np.float32(c)) for c in v] if v is not None else None


def check(got, rows, most=32):
    kept = whole(rows)
    n, dims = len(kept), len(kept[0][1])
    x = np.array([v for _, v in kept], dtype=object)
    s = x.sum(axis=0)
    centred = (n * x - s) / n
    cov = (centred.T @ centred / n).astype(float)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > e[0] * dims * 2.3e-16).sum()))
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert sum(map(len, by_id.values())) == n * k
    sign = None
    for (i, _), row, mid in zip(kept, x, centred.astype(float)):
        mine = sorted(by_id[i], key=lambda r: r.component)[:k]
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert {r.n for r in mine} == {n} and {r.deviation for r in mine} == {sum((n * a - b) ** 2 for a, b in zip(row, s))}
        want = mid @ u[:, :k] / np.sqrt(e[:k])
        have = np.array([r.whitened for r in mine])
        sign = np.where(np.sign(want) == np.sign(have), 1, -1) if sign is None else sign
        assert np.allclose(have, sign * want, atol=1e-7)
        assert np.allclose([r.explained for r in mine], e[:k] / np.trace(cov), rtol=1e-9)
        assert max(r.identity_error for r in mine) < 1e-8
    return k


def test_popcounts_give_exact_cross_products():
    rng = np.random.default_rng(3)
    for low, high, rows in ((0, 2, 5), (-50, 70, 200), (10 ** 6, 10 ** 6 + 1, 64), (-2 ** 62, 2 ** 62, 130)):
        x = rng.integers(low, high, size=(rows, 6))
        ones = np.concatenate([x, np.ones((rows, 1), np.int64)], axis=1).astype(object)
        assert (W.cross_products(x) == ones.T @ ones).all()


def test_against_plain_covariance(vectors):
    rng = random.Random(5)
    rows = [(i, single([rng.gauss(0, 1 + d / 4) + d for d in range(6)])) for i in range(300)]
    rows += [(400, None), (401, [1.0] * 5 + [None]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5)]
    assert check(W.whitened_rows(W.whiten(vectors(rows))).collect(), rows) == 6
    assert check(W.whitened_rows(W.whiten(vectors(rows), most=2)).collect(), rows, 2) == 2


def test_whitened_covariance_is_the_identity(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = W.whiten(table).collect()
    w = np.array([r.whitened for r in got])
    assert w.shape == (table.count(), 32)
    off = np.cov(w.T, bias=True) - np.eye(32)
    assert abs(off).max() < 1e-9 and got[0].identity_error < 1e-9
    assert np.allclose(w.mean(axis=0), 0, atol=1e-9)


def test_large_entries_stay_exact(vectors):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1e15, 1e15), rng.uniform(-1, 1), 3e9 * rng.random()]) for i in range(40)]
    df = vectors(rows, "double")
    got = W.whiten(df).collect()
    kept = whole(rows)
    s = [sum(v[d] for _, v in kept) for d in range(3)]
    want = {i: sum((40 * a - b) ** 2 for a, b in zip(v, s)) for i, v in kept}
    assert {r.vec_id: int(r.deviation) for r in got} == want
    assert all(r.deviation is None for r in W.whitened_rows(W.whiten(df)).collect() if want[r.vec_id] >= 2 ** 63)


def test_constant_dimension_copies_lengths_and_empty_tables(vectors):
    rows = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (None, [1.0, 3.0, 5.0]), (4, [1.0, 7.0, -5.0])]
    got = W.whitened_rows(W.whiten(vectors(rows + [(9, [1.0]), (8, [])]))).collect()
    assert {r.component for r in got} == {1, 2}  # the constant dimension adds none
    assert sum(r.vec_id == 1 for r in got) == 4 and sum(r.vec_id is None for r in got) == 2
    assert 9 not in {r.vec_id for r in got}
    for nothing in ([], [(1, None)], [(1, [])], [(1, [2.0, 2.0])], [(1, [2.0]), (2, [2.0])]):
        out = W.whitened_rows(W.whiten(vectors(nothing)))
        assert out.collect() == []
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_slices_and_tasks_do_not_change_the_sums(vectors, monkeypatch):
    rows = [(i, [i * 0.37 % 5, i * 1.7 % 3, -i * 0.01]) for i in range(500)]
    usable = W.usable_vectors(vectors(rows), "vec_id", "embedding")
    one = W.scatter(usable.coalesce(1), 3)
    assert (W.scatter(usable.repartition(5), 3) == one).all()
    monkeypatch.setattr(W, "SLICE_ROWS", 37)  # in this process, so the task's function runs here
    batches = usable.toArrow().to_batches(max_chunksize=60)
    out = [r for b in W.scatter_rows(3)(iter(batches)) for r in b.to_pylist()]
    assert len(out) == 10  # one row per pair
    for r in out:
        assert sum(r[f"l{k}"] << 32 * k for k in range(W.LIMBS)) == one[r["i"], r["j"]]
