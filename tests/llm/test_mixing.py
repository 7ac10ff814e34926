import hashlib
import random
import re

import duckdb
import pytest

from lakescan.llm import mixing
from lakescan.llm.mixing import mix, mixed_documents, targets, words
from lakescan.llm.queries import ORACLE_SQL, op4_mixing

from .helpers import ODD, at, odd


def oracle(folder):
    c = duckdb.connect()
    import os

    p = f"{folder}/documents.parquet"
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return sorted(c.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE_SQL['op4_mixing']})").fetchall(), key=str)


def test_query_equals_sql(spark, small, tmp_path):
    more = [(100 + i, "w " * (i * 7 % 50), None, f"src{i % 7}", 0) for i in range(80)]
    for d in (small, "/root/testdata/sf0.01", at(spark, tmp_path, documents=odd(spark, ODD + more).repartition(3))):
        assert sorted(map(tuple, op4_mixing(spark, d).collect()), key=str) == oracle(d)


def test_plan_is_native(spark, small):
    plan = op4_mixing(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_taken_comes_near_targets(spark):
    rows = mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r.size <= 3 * r.size
    total = sum(r.size for r in rows)
    assert sum(x[0].target for x in by.values()) == pytest.approx(total)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target


@pytest.mark.parametrize(("n", "short", "long"), [(200, 300, 60_000), (500, 400, 20_000)])
def test_a_long_document_at_the_cut_is_passed_by(spark, n, short, long):
    rows = [(i, "w " * (long if i == 0 else short), "en", "a", 0) for i in range(n + 1)] + [(1000, "w " * ((n * short + long) // 2), "en", "b", 0)]  # half of a's words are its target
    docs = odd(spark, rows).drop("size")
    for seed in ("1", "2", "3"):
        goal = {r.source: r.target for r in mix(docs, seed=seed).select("source", "target").distinct().collect()}
        taken = {}
        for r in mixed_documents(docs, seed=seed).select("source", words("text").alias("n")).collect():
            taken[r.source] = taken.get(r.source, 0) + r.n
        assert abs(taken["a"] - goal["a"]) <= 0.01 * goal["a"]


def chances(sizes, extra):
    """Inclusion probabilities: a level times 2^class, at most 1, found by bisection."""
    cls = [(n.bit_length() - 1) // 2 for n in sizes]
    low, high = 0.0, 1.0
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(1, level * 2.0**c) * n for c, n in zip(cls, sizes)) < extra else (low, level)
    return [1.0 if 1 - (p := low * 2.0**c) < 1e-12 else p for c in cls]


def plain_sample(sizes, extra, target, u, near=mixing.NEAR):
    """Which documents get one more copy: the certain ones, then down the Pareto order while they fit."""
    p = chances(sizes, extra)
    taken = [x == 1 for x in p]
    room = int(extra - sum(n for n, t in zip(sizes, taken) if t) + 1e-9)
    order = sorted((i for i, t in enumerate(taken) if not t), key=lambda i: (u[i] / (1 - u[i]) * (1 - p[i]) / p[i], i))
    for i in order:
        if sizes[i] <= room and room > near * target:
            taken[i] = True
            room -= sizes[i]
    if room > near * target and (more := [i for i in order if not taken[i] and sizes[i] < 2 * room]):
        taken[min(more, key=lambda i: abs(sizes[i] - room))] = True
    return p, taken


def mixed_sizes(n, seed):
    r = random.Random(seed)
    return [min(int(r.lognormvariate(4, 1.3)) + 1, 5000) for _ in range(n)]


def test_sample_equals_a_plain_walk(spark):
    sizes = mixed_sizes(150, 1)
    rows = [(i, "w " * n, "en", "a", 0) for i, n in enumerate(sizes)] + [(1000, "w " * (sum(sizes) // 2), "en", "b", 0), (1001, "", "en", "a", 0)]
    for seed in ("x", "y"):
        got = [r for r in mix(odd(spark, rows).drop("size"), seed=seed).collect() if r.source == "a" and r.size]
        got.sort(key=lambda r: r.doc_id)
        u = [(int(hashlib.md5(f"{seed}:{i}:{n}:1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for i, n in enumerate(sizes)]
        certain = int(got[0].target // sum(sizes))
        _, want = plain_sample(sizes, got[0].target - certain * sum(sizes), got[0].target, u)
        assert [r.copies - certain for r in got] == [int(x) for x in want]


def test_inclusion_probabilities_are_unequal_and_met():
    """Over many orders: every class of sizes is included about as often as it should be, and totals come near."""
    sizes, r, n = mixed_sizes(400, 2), random.Random(3), 600
    extra, often, off = 0.4 * sum(sizes), [0] * 400, []
    for _ in range(n):
        p, taken = plain_sample(sizes, extra, sum(sizes), [r.random() for _ in sizes])
        often = [a + b for a, b in zip(often, taken)]
        off.append(abs(sum(s for s, t in zip(sizes, taken) if t) - extra) / sum(sizes))
    assert max(off) < 0.01 and len({round(x, 6) for x in p}) >= 4
    for chance in set(p):
        own = [a / n for a, x in zip(often, p) if x == chance]
        assert sum(own) / len(own) == pytest.approx(chance, abs=0.03)


def test_more_sources_than_are_broadcast_join_by_salted_keys(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = ("doc_id", "copy_of", "size", "target", "taken")
    want = sorted(map(tuple, mix(docs).select(*columns).collect()), key=str)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, mix(docs).select(*columns).collect()), key=str) == want


def plain_targets(sizes, most=3.0):
    """Shares by weight; caps; the excess again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped |= over


def test_targets_are_those_of_resharing(spark):
    for sizes in ({"a": 1, "b": 10, "c": 1000, "d": 5, None: 40}, {"a": 100}, {"a": 0, "b": 7, "é": 3}, {chr(97 + i): (i * 37) % 101 + 1 for i in range(20)}):
        got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(plain_targets(sizes))


def test_empty_table(spark, tmp_path):
    assert op4_mixing(spark, at(spark, tmp_path, documents=odd(spark, []))).count() == 0
