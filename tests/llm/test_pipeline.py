import corpus_pipeline as P
from lakescan.llm.mixing import mix, mixed_documents
from lakescan.llm.secret_scan import base_spans, redact, scan

from .helpers import ODD, at, odd
from .test_near_dedup import brute
from .test_tokens import check_pieces

D = "/root/testdata/sf0.01"


def columns(df):
    return sorted(tuple(r[c] for c in P.COLUMNS) for r in df.collect())


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    before = columns(docs)
    kept = []
    for name, stage in P.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        out = stage(spark, docs, D)
        assert out.columns == list(P.COLUMNS)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = columns(docs)
        if name == "language":
            lost = set(before) - set(after)
            assert set(after) <= set(before) and all(sum(c.isalpha() for c in t[1]) < 5 for t in lost)
        elif name == "near_dedup":
            rows = [r for r in spark.read.parquet(f"{tmp_path}/language").collect()]
            least = {x[0] for x in brute(rows) if x[3]}
            assert after == [t for t in before if t[0] in least] and len(after) < len(before)
        elif name == "secrets":
            assert [t[0] for t in after] == [t[0] for t in before]
            changed = [(a, b) for a, b in zip(before, after) if a != b]
            assert changed and all(base_spans(a[1]) and not base_spans(b[1]) and b[4] == len(b[1]) for a, b in changed)
            assert not any(base_spans(t[1]) for t in after)
        else:
            want = {(r.doc_id): r.copies for r in mix(spark.read.parquet(f"{tmp_path}/secrets")).collect()}
            kept = [t for t in before for _ in range(want[t[0]])]
            assert after == sorted(kept)
        before = after
    pieces = P.STAGES[-1][1](spark, docs, D).collect()
    total, padding, _ = check_pieces(pieces, docs.collect())
    assert padding == 0


def test_whole_run(spark, small):
    assert P.run(spark, small).count() > 100


def test_odd_rows(spark, tmp_path):
    d = at(spark, tmp_path, documents=odd(spark, [*ODD, (30, 'token = "abcdefgh1234"', "en", "src0", None)]))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs, d).count() > 0
    assert P.run(spark, d).count() > 0
    red = {r.doc_id: r for r in P.secrets(spark, docs, d).collect()}
    assert red[30].text == '[SECRET]"' and red[30].n_chars is None and red[3].text is None and red[8].n_chars == 30000
    empty = at(spark, f"{tmp_path}/e", documents=odd(spark, []))
    assert P.run(spark, empty).count() == 0


def test_redaction_follows_the_scan(spark):
    import random

    r = random.Random(9)
    rows = [(i, f"plain words here {''.join(r.choices('abcDEF0123ghiJKL', k=60)) if i % 10 == 0 else 'RiverStoneHouseGarden2024'} end", "en", "s", 5) for i in range(80)]
    docs = odd(spark, rows)
    spans = {x.doc_id: x.spans for x in scan(docs).collect()}
    for x in redact(docs, "#").collect():
        want = rows[x.doc_id][1]
        for s in reversed(spans[x.doc_id]):
            want = want[: s.start] + "#" + want[s.end :]
        assert x.text == want and x.size == "size"


def test_equal_rows_share_the_copies(spark):
    rows = [(1, "a b c", "en", "x", 1)] * 7 + [(2, "d e f", "en", None, 1), (3, "g " * 40, "en", "y", 1), (4, None, "en", "y", 1)]
    docs = odd(spark, rows)
    want = {}
    for m in mix(docs).collect():
        want[m.doc_id] = want.get(m.doc_id, 0) + m.copies
    got = {}
    for x in mixed_documents(docs).collect():
        got[x.doc_id] = got.get(x.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
