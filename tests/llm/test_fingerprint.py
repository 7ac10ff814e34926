import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakescan.llm.fingerprint import PRIMES, Document, PrefixHash, likeness, parse
from lakescan.llm.queries import op2_fingerprints

from .helpers import at, odd


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60))
def test_spans_and_extensions(x, y):
    a, b = PrefixHash(points(x)), PrefixHash(points(y))
    r = random.Random(len(x) * 61 + len(y))
    for _ in range(10):
        i, j = r.randint(0, len(x)), r.randint(0, len(y))
        n = r.randint(0, min(len(x) - i, len(y) - j))
        assert (a.span(i, i + n) == b.span(j, j + n)) == (x[i : i + n] == y[j : j + n])
        common = next((k for k in range(min(len(x) - i, len(y) - j)) if x[i + k] != y[j + k]), min(len(x) - i, len(y) - j))
        assert a.common(i, b, j) == common
        assert a.then(i, b, j) == PrefixHash(points(x[:i] + y[:j])).span(0, i + j)


def test_primes():
    assert all(all(p % d for d in range(2, 46341)) for p in PRIMES)


def test_edited_print_is_that_of_the_edited_text():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choices("abcde fgh", k=r.choice([0, 1, 5, 11, 12, 13, 40, 300]))) for _ in range(2))
        x, y = Document(1, a), Document(2, b)
        text, found = x.edited(y)
        assert text == a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert str(found) == str(Document(3, text).print) and str(parse(str(found))) == str(found)


def check(docs, got):
    rows = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    want = []
    for i, r in enumerate(rows):
        t, nxt = r.text or "", rows[(i + 1) % len(rows)].text or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = (Document(0, x).print for x in (t, edited, nxt))
        want.append((r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), likeness(a, b), likeness(a, c)))
    assert sorted((tuple(g)[:7] for g in got), key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = op2_fingerprints(spark, small).collect()
    check(docs, got)
    assert np.mean([g.near_edited for g in got]) > 0.4 > 0.2 > np.mean([g.near_next for g in got])
    check(odd(spark).collect(), op2_fingerprints(spark, at(spark, tmp_path, documents=odd(spark).repartition(3))).collect())


def test_one_and_no_document(spark, tmp_path):
    one = odd(spark, [(1, "abcdefgh" * 9, "en", "s", 0)])
    check(one.collect(), op2_fingerprints(spark, at(spark, tmp_path, documents=one)).collect())
    assert op2_fingerprints(spark, at(spark, tmp_path, documents=odd(spark, []))).count() == 0
