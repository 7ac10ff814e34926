import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakescan.llm import hashing
from lakescan.llm.queries import op7_substring_dedup
from lakescan.llm.substring_dedup import Automaton, covered_in_shard, remove_repeats

from .helpers import ODD, at, odd


def brute(docs, window=50):
    first = {}
    words = [(d.doc_id if d.doc_id is not None else -1, (d.text or "").encode().split()) for d in docs]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = b" ".join(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for d, (i, w) in zip(docs, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[b" ".join(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d.doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, small, tmp_path):
    assert digests(op7_substring_dedup(spark, small)) == brute(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    d = at(spark, tmp_path, documents=odd(spark, [*ODD, (11, "word " * 200, "en", "s", 0), (None, "word " * 60, "en", "s", 0)]))
    assert digests(op7_substring_dedup(spark, d)) == brute(spark.read.parquet(f"{d}/documents.parquet").collect())


@pytest.mark.parametrize("most", [500, 2])
def test_shared_passages(spark, most):
    r = random.Random(most)
    passages = [[f"w{r.randint(0, 300)}" for _ in range(r.randint(8, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randint(1, 4)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            w += p[a : len(p) - r.randint(0, len(p) // 3)] + [f"u{r.randint(0, 5)}"] * r.randint(0, 2)
        rows.append((r.randint(0, 90), " ".join(w), "en", "s", 0))
    df = odd(spark, rows).repartition(5)
    assert digests(remove_repeats(df, window=12, most=most)) == brute(df.collect(), 12)


def test_very_long_documents_that_share_most_of_their_words(spark):
    r = random.Random(4)
    words = [f"w{r.randint(0, 5000)}" for _ in range(200_000)]
    edited = [f"x{i}" if i % 1000 == 999 else w for i, w in enumerate(words)]
    turned = words[100_000:] + words[:100_000]
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in enumerate((words, edited, turned, words, ["one"] * 200_000, ["one"] * 1000))]
    df = odd(spark, rows)
    got = remove_repeats(df, with_text=False)
    assert digests(got) == brute(df.select("doc_id", "text").collect())
    assert got.where("kept IS NOT NULL").isEmpty()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", max_size=25), max_size=5), st.text("abc", max_size=25))
def test_matching_statistics(texts, query):
    a = Automaton()
    for t in texts:
        a.separate()
        for c in t:
            a.add(c)
    for end, n in enumerate(a.matches(list(query)), 1):
        assert n == max((k for k in range(end + 1) if any(query[end - k : end] in t for t in texts)), default=0)


def test_shards_look_at_smaller_ids_only():
    w = list("abcdefgh")
    assert covered_in_shard([(1, 5, w), (1, 5, w), (2, 5, w)], 4) == [[], [], [0, 1, 2, 3, 4]]


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n\t\x0b\x1c\xa0é", max_size=60), st.sampled_from([7, 1 << 20]))
def test_word_hashes_tell_words_apart(text, block):
    hashing.BLOCK, before = block, hashing.BLOCK
    try:
        data = text.encode()
        words, found = data.split(), hashing.word_hashes(data).tolist()
        assert len(found) == len(words) and len(set(zip(words, found))) == len(set(words)) == len(set(found))
        for size in (1, 2, 3):
            got = hashing.spans(np.array(found, np.uint64), size).tolist()
            want = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
            assert len(got) == len(want) and len(set(zip(got, want))) == len(set(got)) == len(set(want))
    finally:
        hashing.BLOCK = before


def test_empty_table(spark, tmp_path):
    assert op7_substring_dedup(spark, at(spark, tmp_path, documents=odd(spark, []))).count() == 0
