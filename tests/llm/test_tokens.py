import random
import zlib
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from lakescan.llm.packing import Packer, Piece, pack_documents
from lakescan.llm.queries import op5_packing, op6_token_files
from lakescan.llm.token_files import read_tokens, write_tokens
from lakescan.llm.tokenize import PieceEncoder, tokenizer_path

from .helpers import at, odd

PARTS = ["a", "a.b", "it's.", "Ab!?*", ")", "é,", "B", "é", "é", "İ", "ΑΣ ", "'s", "it's", "'LL", " ", "  ", "\n", "\t\n", "\x85", "\xa0", "\x1c", "\x01", "x\x01y", "１2", "½", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext", "|>", "</w>", "日本", "🙂", ".", "***", "\r\n", "\x00", "ſ"]


@cache
def tokenizer(name):
    return Tokenizer.from_file(tokenizer_path(name))


def encode(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_pieces_give_the_ids_of_whole_texts(name, kind):
    r = random.Random(1)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 30))) for _ in range(2000)] + [None]
    t = tokenizer(name)
    enc = PieceEncoder(tokenizer_path(name), kind, limit=500)
    for a in range(0, len(texts), 300):
        ids, stops = enc.encode(texts[a : a + 300], 7)
        for text, own in zip(texts[a : a + 300], np.split(ids, stops[:-1])):
            assert own.tolist() == t.encode(text or "", add_special_tokens=False).ids + [7]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_letters_skip_the_slow_rules(name, kind, monkeypatch):
    """Words of Latin-1 letters are cut at spaces only, which costs half of the general rules, and get the library's ids."""
    slow, together = [], PieceEncoder._together
    monkeypatch.setattr(PieceEncoder, "_together", lambda self, pieces, *most: slow.extend(pieces) or together(self, pieces, *most))
    letters = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(192, 256)] if c not in (215, 247))
    small = letters.lower() if kind == "word" else letters
    r = random.Random(3)
    words = [*small, *("".join(r.choices(small, k=r.randint(1, 12))) for _ in range(4000))]
    texts = ["\n" + " ".join(["", *words[a : a + 400]]) for a in range(0, len(words), 400)]
    enc = PieceEncoder(tokenizer_path(name), kind)
    others = [" ".join(["", *r.choices(letters, k=9), "e\u0301e e\u0301", "\xb5 \xaa\xba a\xd7b \xf7", "\u0178\xff"]) for _ in range(50)]
    for given in (texts, others):
        ids, stops = enc.encode(given, 7)
        for text, own in zip(given, np.split(ids, stops[:-1])):
            assert own.tolist() == encode(name, text) + [7]
        if given is texts:
            assert not any(p.strip().isalpha() for p in slow)


def test_other_rules_are_followed(tmp_path):
    """A vocabulary that takes accents off has no short way for letters."""
    from tokenizers import normalizers

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    t.save(f"{tmp_path}/t.json")
    ids, _ = PieceEncoder(f"{tmp_path}/t.json", "word").encode(["\xe9t\xe9 na\xefve caf\xe9."], 7)
    assert ids.tolist() == t.encode("\xe9t\xe9 na\xefve caf\xe9.", add_special_tokens=False).ids + [7]


def test_added_tokens_with_rules_of_their_own(tmp_path):
    """Added tokens that take white space with them, or are matched in normalized text: whole texts go to the library."""
    from tokenizers import AddedToken

    for k, token in enumerate((AddedToken("<s>", lstrip=True), AddedToken("<S>", normalized=True, special=False))):
        t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
        t.add_tokens([token])
        t.save(f"{tmp_path}/{k}.json")
        texts = ["a  <s> b", "a <S>b <s>", None, "", "c"]
        ids, stops = PieceEncoder(f"{tmp_path}/{k}.json", "word").encode(texts, 7)
        for text, own in zip(texts, np.split(ids, stops[:-1])):
            assert own.tolist() == t.encode(text or "", add_special_tokens=False).ids + [7]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_every_document(spark, tmp_path):
    docs = odd(spark).repartition(3)
    got = op6_token_files(spark, at(spark, tmp_path, documents=docs)).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = encode("byte_bpe_50k.json", r.text) + [0]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_files_layout(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    write_tokens(odd(spark), f"{tmp_path}/t", page_rows=2)
    (file,) = [f for f in glob.glob(f"{tmp_path}/t/*.parquet") if pq.ParquetFile(f).metadata.num_rows][:1]
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    plan = read_tokens(spark, f"{tmp_path}/t").select("doc_id", "start").where("doc_id = 5")
    assert ",tokens:array" not in plan._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark, tmp_path):
    d = at(spark, tmp_path, documents=odd(spark, []))
    assert op6_token_files(spark, d).count() == op5_packing(spark, d).count() == 0


def check_pieces(rows, docs):
    of, by_sequence = {}, {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(of) == {d.doc_id for d in docs}
    for d in docs:
        ids = encode("word_bpe_49k.json", d.text) + [1]
        copies = sum(x.doc_id == d.doc_id for x in docs)
        pieces = sorted(of[d.doc_id], key=lambda r: r.start)
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    total, padding, bound = 0, 0, []
    for s in by_sequence.values():
        at_ = 0
        for p in sorted(s, key=lambda r: r.offset):
            assert p.offset == at_
            at_ += p.length
        assert at_ <= 2048
        loss = [p.length - max(min(p.doc_tokens // 8 - p.start, p.length), 0) for p in s]
        assert len(s) <= 32 and sum(loss) <= 1920
        bound.append((len(s) == 32, sum(loss) == 1920))
        total += at_
        padding += 0 if at_ & (at_ - 1) == 0 else 2048 - at_
    return total, padding, [sum(x) for x in zip(*bound)]


def test_packing_places_every_token_once(spark, small, tmp_path):
    for d in (small, at(spark, tmp_path, documents=odd(spark))):
        docs = spark.read.parquet(f"{d}/documents.parquet").collect()
        total, padding, _ = check_pieces(op5_packing(spark, d).collect(), docs)
        assert padding == 0 and total > 0


def test_all_three_limits_bind_in_the_query(spark, small, tmp_path):
    """Empty documents reach the limit on segments, the insides of long ones that on loss-bearing tokens."""
    short = spark.range(3000).selectExpr("id + 100000 AS doc_id", "'' AS text")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(short).coalesce(1)
    d = at(spark, tmp_path, documents=docs)
    total, padding, bound = check_pieces(op5_packing(spark, d).collect(), docs.collect())
    assert padding == 0 and min(bound) > 0


def test_loss_free_tokens_from_a_column(spark):
    rows = [(i, "word " * 300, n) for i, n in enumerate([0, None, -5, 100, 301, 9999] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt int").coalesce(1)
    got = pack_documents(docs, size=256, segments=4, loss=64, loss_free="prompt").collect()
    loss, tokens, free = {}, {}, {i: max(n or 0, 0) for i, _, n in rows}
    for p in got:
        own = p.length - max(min(free[p.doc_id] - p.start, p.length), 0)
        loss[p.sequence_id], tokens[p.doc_id] = loss.get(p.sequence_id, 0) + own, tokens.get(p.doc_id, 0) + p.length
    assert set(tokens.values()) == {301} and max(loss.values()) == 64


def test_limits_hold_together():
    r = np.random.default_rng(0)
    packer, got, given = Packer(size=100, segments=5, loss=40, window=50), [], []
    for k in range(400):
        n = int(r.integers(1, 250))
        flags = np.concatenate([[0], np.cumsum(r.random(n) < 0.4)])
        given.append(n)
        got += packer.add(Piece(k, 0, n, flags))
    got += packer.finish()
    seen = {}
    for b in got:
        assert sum(p.length for p, _ in b) <= 100 and len(b) <= 5 and sum(p.loss_tokens() for p, _ in b) <= 40
        assert [o for _, o in b] == np.cumsum([0] + [p.length for p, _ in b])[:-1].tolist()
        for p, _ in b:
            seen.setdefault(p.key, []).append((p.start, p.start + p.length))
    for k, n in enumerate(given):
        spans = sorted(seen[k])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_long_documents_do_not_pile_up():
    """Whatever waits is bounded in tokens too, and a lone document of a million tokens is packed."""
    packer, placed = Packer(held=50_000), 0
    for k, n in enumerate([40_000] * 30 + [1_000_000] + [5] * 50):
        placed += sum(p.length for b in packer.add(Piece(k, 0, n, free=n // 8)) for p, _ in b)
        assert sum(p.length for p in packer.waiting) == packer._tokens < 50_000 + 1
    got = list(packer.finish())
    assert placed + sum(p.length for b in got for p, _ in b) == 40_000 * 30 + 1_000_000 + 250
    assert all((n := sum(p.length for p, _ in b)) & (n - 1) == 0 for b in got) and not packer.waiting


def test_whole_examples_are_not_cut():
    packer = Packer(size=100, segments=3, loss=100, cut=False, window=4)
    got = [b for n in (60, 50, 40, 50, 30, 10, 9, 8) for b in packer.add(Piece(n, 0, n))]
    got += packer.finish()
    assert sorted(p.length for b in got for p, _ in b) == sorted((60, 50, 40, 50, 30, 10, 9, 8))
    assert all(sum(p.length for p, _ in b) <= 100 and len(b) <= 3 for b in got)
    with pytest.raises(ValueError):
        list(packer.add(Piece(0, 0, 101)))
