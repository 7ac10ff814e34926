"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, once for each curve, shifted at random and ordered by their place on a
Hilbert curve. Each order is range-partitioned by Spark; a query goes to the parts that its window of ranks meets, and
there all of the window's rows are ranked again by distance between the original vectors, in double precision. The
windows of all curves are merged.

A window is ``window`` rows of each order, or a ``share`` of all rows where that is more. Vectors with structure (most
embeddings) have good orders, and windows of a fixed size serve tables of any size. Vectors without structure have no
good order in few dimensions: there only a share of all rows keeps recall as the table grows, and with it nearly all
rows are looked at for each query (see the README for figures).

Of equal vectors only the ``k`` + 1 smallest ids can be results; the others are not candidates. Vectors that are null,
zero, of another length than most (the shortest of equally frequent ones), or that hold nulls or non-finite numbers
take no part, nor do rows without an id. Repeated rows, and rows with a query's own id, count once and not for that
query. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve (Skilling's transform) of rows of integers below 2 ** bits."""
    x = points.astype(np.uint64)
    n, dims = x.shape
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        low = q - one
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip, q = np.zeros(n, np.uint64), np.uint64(1 << (bits - 1))
    while q > one:
        flip ^= np.where((x[:, -1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << one | (x[:, i] >> np.uint64(b)) & one
    return key.astype(np.int64)


class Curves:
    """Projections and shifts; the cube of each is twice as wide as the data, so that a shift moves all cuts."""

    def __init__(self, length: int, curves: int, dims: int, seed: int):
        r = np.random.default_rng(seed)
        self.dims, self.bits = min(dims, length), min(10, 62 // min(dims, length))
        self.axes = np.concatenate([np.linalg.qr(r.normal(size=(length, self.dims)))[0] for _ in range(curves)], axis=1)
        self.shift, self.curves = r.random(curves * self.dims), curves
        self.low = self.high = np.zeros(curves * self.dims)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One row of keys for each vector."""
        y = ((x @ self.axes - self.low) / np.where(self.high > self.low, self.high - self.low, 1) + self.shift) / 2
        cells = np.clip(y * 2**self.bits, 0, 2**self.bits - 1).astype(np.int64)
        return np.stack([hilbert(cells[:, c * self.dims : (c + 1) * self.dims], self.bits) for c in range(self.curves)], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def is_query(vec_id: Column) -> Column:
    return vec_id % 100 == 0


def nearest(
    vectors: DataFrame, queries: Column | None = None, k: int = 10, curves: int = 8, dims: int = 4, window: int = 400, share: float = 0.0, seed: int = 11, block: int = 20_000
) -> DataFrame:
    """query_id, rank, vec_id, score: up to k nearest of each query of (vec_id, embedding).

    queries: a condition on vec_id; window, share: rows of each order that are looked at for a query, a number or a part
    of all, whichever is more; block: queries that a task holds at once.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    good = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(good)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == lengths.n)
    made = Curves(lengths.n, curves, dims, seed)
    made.low, made.high = _ranges(rows, made)
    asked = rows.where(is_query(F.col("id")) if queries is None else queries).distinct()
    first = Window.partitionBy("v").orderBy("id")
    kept = rows.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    ordered = _ordered(kept.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True))), made)

    counts = sorted((r.part, r.n, r.q) for r in ordered.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("int")).alias("q")).collect())
    places = Places([c[0] for c in counts], [c[1] for c in counts], curves, window, share)  # two numbers for each write task
    blocks = max(1, -(-2 * sum(c[2] for c in counts) // (curves * block)))
    shared = spark.sparkContext.broadcast(places)
    dealt = ordered.select("part", "place", "curve", "id", "query", "v").mapInArrow(lambda b: shared.value.deal(b, blocks), "part int, block int, kind int, id long, at long, low long, high long, v array<double>")
    dealt = dealt.repartition(len(counts) * blocks, "part", "block").sortWithinPartitions("part", "block", "kind", "at")
    found = dealt.mapInArrow(lambda b: _windows(b, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Places:
    """Where each part of the orders begins, all curves one after another; and to which parts a row has to go."""

    def __init__(self, parts: list[int], sizes: list[int], curves: int, window: int, share: float):
        self.parts, self.starts = np.array(parts, np.int64), np.cumsum([0, *sizes])
        self.total = int(self.starts[-1]) // curves
        self.half = max(int(share * self.total / 2), window // 2)

    def deal(self, batches, blocks: int):
        """Of (part, place, curve, id, query, v): a query for each part that its window meets, others for each block."""
        for b in batches:
            part, place, curve, ids = (b.column(i).to_numpy().astype(np.int64) for i in range(4))
            query = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            at = self.starts[np.searchsorted(self.parts, part)] + place
            low = np.maximum(at - self.half, curve * self.total)
            high = np.minimum(at + self.half, (curve + 1) * self.total - 1)
            first = np.where(query, np.searchsorted(self.starts, low, "right") - 1, 0)
            last = np.where(query, np.searchsorted(self.starts, high, "right") - 1, blocks - 1)
            copies = last - first + 1
            of = np.repeat(np.arange(len(at)), copies)
            step = np.arange(len(of)) - np.repeat(np.cumsum(copies) - copies, copies) + first[of]
            asked = query[of]
            to = np.where(asked, self.parts[np.where(asked, step, 0)], part[of])
            block = np.where(asked, ids[of] * 0x9E3779B1 % (1 << 32) * blocks >> 32, step)
            for i in range(0, len(of), 10_000):  # copies of a row may be many
                k = slice(i, i + 10_000)
                columns = [pa.array(x[k].astype(np.int32)) for x in (to, block, ~asked)] + [pa.array(x[of[k]]) for x in (ids, at, low, high)]
                yield pa.RecordBatch.from_arrays([*columns, b.column(5).take(pa.array(of[k]))], ["part", "block", "kind", "id", "at", "low", "high", "v"])


def _ranges(rows: DataFrame, made: Curves) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest projections of all vectors; one row for each task and axis."""

    def run(batches):
        low = high = None
        for b in batches:
            if b.num_rows:
                y = _matrix(b.column(0)) @ made.axes
                a, z = y.min(axis=0), y.max(axis=0)
                low, high = (a, z) if low is None else (np.minimum(low, a), np.maximum(high, z))
        n = 0 if low is None else len(low)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int64()), pa.array(low if n else [], pa.float64()), pa.array(high if n else [], pa.float64())], ["axis", "low", "high"])

    found = rows.select("v").mapInArrow(run, "axis long, low double, high double").groupBy("axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("axis").collect()
    return np.array([r.low for r in found]), np.array([r.high for r in found])


def _ordered(rows: DataFrame, made: Curves) -> DataFrame:
    """part, place, curve, id, query, v: all curves one after another, parts and places in them ascending."""

    def keys(batches):
        for b in batches:
            found = made.keys(_matrix(b.column(1))) if b.num_rows else np.zeros((0, made.curves), np.int64)
            for c in range(made.curves):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(found[:, c]), b.column(0), b.column(1), b.column(2)], ["curve", "key", "id", "v", "query"])

    def places(batches):
        part, place = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), *b.columns], ["part", "place", "curve", "id", "query", "v"])
            place += n

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("id", "v", "query").mapInArrow(keys, "curve int, key long, id long, v array<double>, query boolean")
    sorted_ = dealt.repartitionByRange(parts, "curve", "key", "id", "query").sortWithinPartitions("curve", "key", "id", "query")
    return written(sorted_.select("curve", "id", "query", "v").mapInArrow(places, "part int, place long, curve int, id long, query boolean, v array<double>"), "curves")


class _Best:
    """The nearest so far of the queries of one part."""

    def __init__(self, rows: list[tuple[np.ndarray, ...]], k: int):
        self.k = k
        self.id, _, self.low, self.high, self.x = (np.concatenate(c) for c in zip(*rows))
        self.norm = (self.x**2).sum(axis=1)
        self.ids = np.zeros((len(self.id), 0), np.int64)
        self.scores = np.zeros((len(self.id), 0))

    def look(self, ids: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        inside = (at[None] >= self.low[:, None]) & (at[None] <= self.high[:, None]) & (ids[None] != self.id[:, None])
        near = np.where(inside, self.norm[:, None] + (y**2).sum(axis=1)[None] - 2 * self.x @ y.T, np.inf)
        n = min(self.k + 22, near.shape[1])
        pick = np.argpartition(near, n - 1, axis=1)[:, :n]
        exact = np.sqrt(((self.x[:, None] - y[pick]) ** 2).sum(axis=2))
        exact[~np.take_along_axis(inside, pick, axis=1)] = np.inf
        scores, all_ids = np.concatenate([self.scores, exact], axis=1), np.concatenate([self.ids, ids[pick]], axis=1)
        order = np.lexsort((all_ids, scores), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)

    def batch(self) -> pa.RecordBatch:
        there = np.isfinite(self.scores)
        of = np.repeat(self.id, there.sum(axis=1)) if there.size else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(self.ids[there], pa.int64()), pa.array(self.scores[there], pa.float64())], ["query_id", "vec_id", "score"])


def _windows(batches, k: int, chunk: int = 1024):
    """For sorted rows of parts, queries first: the nearest of each query among the part's rows in its window."""
    group, asked, best, held, n = None, [], None, [], 0

    def look():
        nonlocal n
        if held and best is not None:
            best.look(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        n = 0

    for b in batches:
        if not b.num_rows:
            continue
        part, block, kind, *numbers = (b.column(i).to_numpy() for i in range(7))
        rows = [*numbers, _matrix(b.column(7))]
        new = (part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if (part[start], block[start]) != group:
                look()
                if best is not None:
                    yield best.batch()
                group, asked, best = (part[start], block[start]), [], None
            if kind[start] == 0:
                asked.append(tuple(c[start:stop] for c in rows))
                continue
            if asked:
                best, asked = _Best(asked, k), []
            if best is None:
                continue
            most = max(64, min(chunk, 2_000_000 // max(len(best.id), 1)))
            while start < stop:
                end = min(stop, start + most - n)
                held.append((rows[0][start:end], rows[1][start:end], rows[4][start:end]))
                n, start = n + end - start, end
                if n >= most:
                    look()
    look()
    if best is not None:
        yield best.batch()
