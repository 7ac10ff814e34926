import random

import numpy as np
import pytest

from lakescan.llm.components import components
from lakescan.llm.near_dedup import Signer, near_duplicates, sig_of
from lakescan.llm.queries import op3_near_dedup

from .helpers import ODD, at, odd


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """Sets, all pairs that share a shingle, union-find over rows."""
    sets, up, by = [shingles(d.text) for d in docs], list(range(len(docs))), {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in by.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            by[x].append(i)
        for j, n in near.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i].doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((d.doc_id, len(s), least[find(i)], d.doc_id == least[find(i)]) for i, (d, s) in enumerate(zip(docs, sets))), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    assert rows(op3_near_dedup(spark, d)) == brute(spark.read.parquet(f"{d}/documents.parquet").collect())
    more = [(11, "ONE two THREE four five six seven eight. nine ten eleven", "en", "s", 0), (12, "ab cd", "en", "s", 0), (13, "AB\tcd", "en", "s", 0), (14, "Éa", "", "", 0), (15, "éa", "", "", 0)]
    d = at(spark, tmp_path, documents=odd(spark, ODD + more).repartition(3))
    assert rows(op3_near_dedup(spark, d)) == brute(spark.read.parquet(f"{d}/documents.parquet").collect())


def test_chains_families_and_shared_passages(spark, monkeypatch):
    """Copies of copies, families whose members are not all alike, and documents that share half their text."""
    monkeypatch.setattr("lakescan.llm.near_dedup.BLOCK", 7)
    r = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    out, common = [], r.choices(words, k=60)
    for family in range(6):
        text = r.choices(words, k=120)
        for _ in range(25):
            out.append(list(text))
            k = r.randrange(len(text))
            text = list(text) if family % 2 else text
            text[k] = r.choice(words)
            if family % 2 == 0 and r.random() < 0.5:
                text = list(text)
    out += [common + r.choices(words, k=50) for _ in range(60)]
    docs = odd(spark, [(i * 7 % 1009, " ".join(w), "en", "s", 0) for i, w in enumerate(out)]).repartition(4)
    want = brute(docs.collect())
    assert rows(near_duplicates(docs)) == want
    assert rows(near_duplicates(docs, tried=1)) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (7, 6), (300, 301), (301, 302)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_minima_estimate_similarity():
    s = Signer()
    a = s.shingles(" ".join(f"x{i}" for i in range(400)))
    b = s.shingles(" ".join(f"x{i}" for i in range(50, 450)))
    j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert (s.minima(a) == s.minima(b)).mean() == pytest.approx(j, abs=0.12)


def test_empty_table(spark, tmp_path):
    assert op3_near_dedup(spark, at(spark, tmp_path, documents=odd(spark, []))).count() == 0


@pytest.mark.parametrize("n", [20, 350, 1000, 3000, 20_000])
def test_signatures_of_unrelated_sets_do_not_agree(n):
    """And those of similar ones do, as often as their minima."""
    signer, r = Signer(), np.random.default_rng(n)
    draw = lambda k: np.unique(r.integers(0, 2**64, k, dtype=np.uint64))
    shared = draw(n)
    minima = [signer.minima(np.union1d(shared, draw(n // 7))) for _ in range(6)]  # a similarity of about 0.78
    other = [signer.minima(draw(n)) for _ in range(6)]
    agree = lambda x, y: np.mean(np.frombuffer(sig_of(x), np.uint8) == np.frombuffer(sig_of(y), np.uint8))
    for i in range(5):
        assert agree(other[i], other[i + 1]) < 0.05
        assert agree(minima[i], minima[i + 1]) >= np.mean(minima[i] == minima[i + 1]) > 0.58


def test_very_long_documents_that_share_most_of_their_shingles(spark):
    """Copies of 100,000 words, edited here and there, moved, cut to the similarity that counts and a little below it."""
    r = random.Random(6)
    words = [f"w{r.randint(0, 9000)}" for _ in range(100_000)]
    edited = [f"x{i}" if i % 200 == 199 else w for i, w in enumerate(words)]
    near, far = words[:76_000], words[:74_000]
    own = [f"y{i}" for i in range(100_000)]
    texts = [words, edited, words[50_000:] + words[:50_000], near, own, far[:1000] + own[1000:], ["one"] * 100_000, ["one"] * 50_000]
    df = odd(spark, [(i, " ".join(w), "en", "s", 0) for i, w in enumerate(texts)])
    assert rows(near_duplicates(df)) == brute(df.select("doc_id", "text").collect())
