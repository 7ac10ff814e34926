import os

import numpy as np
import pyarrow.dataset as ds
import pytest

from lakescan.llm.ann import Places, hilbert, nearest
from lakescan.llm.queries import op9_nearest

from .helpers import CLASHING


def brute(ids, x, k=10):
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[ids == ids[q]] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]
    return out


def check(got, want, recall):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1))
        assert [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & {i for i, _ in want[q]})
        total += len(want[q])
    assert hits >= recall * total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    t = ds.dataset(f"{d}/embeddings.parquet").to_table().to_pandas()
    check(op9_nearest(spark, d).collect(), brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)), 0.9)


def save(spark, tmp_path, rows, name="e"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    df.withColumns({c: F.lit(c) for c in CLASHING}).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return os.path.join(tmp_path, name)


def structured(n, seed=2):
    """Vectors of 64 numbers that lie near a surface of four dimensions, as those of most models lie near few."""
    r = np.random.default_rng(seed)
    x = np.tanh(r.normal(size=(n, 4)) @ r.normal(size=(4, 64))) + r.normal(size=(n, 64)) * 0.01
    return np.arange(n) * 5, x


def test_small_windows_serve_vectors_with_structure(spark, tmp_path):
    """400 rows of each of eight orders, 16 % of 20,000 rows at most, and the recall stays."""
    ids, x = structured(20_000)
    x = x.astype(np.float32).astype(float)
    got = nearest(spark.read.parquet(f"{save(spark, tmp_path, [(int(i), v.tolist(), 0) for i, v in zip(ids, x)])}/embeddings.parquet"))
    check(got.collect(), brute(ids, x), 0.9)


def test_places_deal_windows_to_parts():
    """Two curves of 6 rows in parts of 4, 2, 1 and 5: each query goes to every part that its window meets, others to every block."""
    import pyarrow as pa

    p = Places([3, 5, 6, 9], [4, 2, 1, 5], 2, 4, 0.0)
    rows = [(3, 0, 0, 100, True), (3, 3, 0, 1, False), (5, 1, 0, 200, True), (6, 0, 1, 300, True), (9, 4, 1, 2, False)]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), pa.array([[1.0]] * 5)], ["part", "place", "curve", "id", "query", "v"])
    got = pa.Table.from_batches(p.deal([batch], 2)).to_pylist()
    asked = {(r["id"], r["part"], r["at"], r["low"], r["high"]) for r in got if r["kind"] == 0}
    assert asked == {(100, 3, 0, 0, 2), (200, 3, 5, 3, 5), (200, 5, 5, 3, 5), (300, 6, 6, 6, 8), (300, 9, 6, 6, 8)}
    assert sorted((r["id"], r["part"], r["block"], r["at"]) for r in got if r["kind"]) == [(1, 3, 0, 3), (1, 3, 1, 3), (2, 9, 0, 11), (2, 9, 1, 11)]


def test_odd_rows_and_equal_vectors(spark, tmp_path):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5)).astype(np.float32).astype(float)
    x[20:55] = x[3]
    ids = np.array([i * 20 for i in range(60)])
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x)]
    odd = [(1, None, 0), (3, [0.0] * 5, 0), (100000, [1.0, None, 1.0, 1.0, 1.0], 0), (5, [float("nan")] * 5, 0), (200000, [float("inf")] * 5, 0), (None, [1.0] * 5, 0), (7, [1.0, 2.0], 0), (9, [], 0), rows[0], rows[25]]
    got = op9_nearest(spark, save(spark, tmp_path, rows + odd)).collect()
    want = brute(ids, x)
    check(got, want, 1.0)
    for g in got:
        assert g.score == pytest.approx(dict(want[g.query_id])[g.vec_id], abs=1e-12)


def test_few_rows(spark, tmp_path):
    assert op9_nearest(spark, save(spark, tmp_path, [], "a")).count() == 0
    assert op9_nearest(spark, save(spark, tmp_path, [(100, [1.0], 0)], "b")).count() == 0
    got = op9_nearest(spark, save(spark, tmp_path, [(100, [1.0], 0), (1, [3.0], 0)], "c")).collect()
    assert [tuple(g) for g in got] == [(100, 1, 1, 2.0)]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_is_a_path(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
