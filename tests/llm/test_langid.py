import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lakescan.llm.langid import CLASSES, Grams, _hash, fit, held_out, packed, predict, unpacked
from lakescan.llm.queries import op10_language_id

from .helpers import ODD, at, odd


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text").collect()}
    rows = op10_language_id(spark, d).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows if len(docs[r.doc_id].text) > 20]) < 0.01


def test_odd_rows(spark, tmp_path):
    got = op10_language_id(spark, at(spark, tmp_path, documents=odd(spark))).collect()
    assert len(got) == len(ODD)
    for g in got:
        if g.doc_id in (3, 4, 7):
            assert (g.lang_pred, g.score, g.rejected) == ("und", 0.0, True)
        else:
            assert g.lang_pred in ("en", "fr") and 0 <= g.score <= 1


def test_nothing_to_learn(spark, tmp_path):
    rows = [(1, "some text", None, "s", 1), (2, None, "en", "s", 1)]
    got = op10_language_id(spark, at(spark, tmp_path, documents=odd(spark, rows))).collect()
    assert {g.lang_pred for g in got} == {"und"}
    assert op10_language_id(spark, at(spark, tmp_path, documents=odd(spark, []))).count() == 0


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs)
    new = [(1, "жжж ффф ЖФЫ щщщ эюя " * 20, None, None, 0), (2, "zqxjk vwwqz kkjxq zzzxq " * 20, None, None, 0)]
    assert all(r.rejected for r in predict(odd(spark, new), model, ["doc_id"]).collect())


def test_every_language_is_learnt(spark):
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x5E00 + i)} " * 9, f"l{i:03}", "s", 0) for i in range(205)]
    assert fit(odd(spark, rows)).langs == [f"l{i:03}" for i in range(205)]


def test_long_texts_are_learnt_whole(spark):
    rows = [(i, "abc bca cab " * 2500 + "xyz zyx yzx " * 2500, "aa", "s", 0) for i in range(6)]
    model = fit(odd(spark, rows))
    (got,) = predict(odd(spark, [(1, "xyz zyx yzx " * 50, None, None, 0)]), model, ["doc_id"]).collect()
    assert got.score > 0.4


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_random_letters_are_rejected_and_documents_are_not(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(1)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz    ", k=k)) for k in (14_000, 110)]
    model = fit(docs.where(~held_out()))
    assert all(g.rejected for g in predict(odd(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model, ["doc_id"]).collect())
    gone = predict(docs.where(held_out()), model, ["doc_id"], with_text=True).where("rejected").collect()
    assert all(sum(c.isalpha() for c in x.text or "") < 5 for x in gone)


def plain_grams(text, slots=4096):
    """How often each slot's n-grams stand in a text: a loop over letters, with the hash in whole numbers."""
    mask, letters, inside = (1 << 64) - 1, [0], False
    for c in (text or "").lower():
        if c.isalpha():
            letters.append(ord(c))
        elif letters[-1]:
            letters.append(0)
        inside |= c.isalpha()
    if not inside:
        return Counter()
    if letters[-1]:
        letters.append(0)
    out = Counter()
    for k in range(len(letters)):
        h = 0
        for step, (x, factor) in enumerate(zip(letters[k : k + 3], (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))):
            h = x * factor & mask if not step else ((h ^ h >> 29) * factor + x) & mask
            out[((h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask) >> 40 & slots - 1] += 1
    return out


def test_predictions_are_those_of_a_plain_nearest_centroid_search(spark):
    """Document frequencies, TF-IDF vectors, cosines and the nearest centroid again, text by text and slot by slot."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    model = fit(docs)
    grams = {r.doc_id: plain_grams(r.text) for r in rows}
    learnt = [grams[r.doc_id] for r in rows if r.lang is not None and grams[r.doc_id]]
    df = Counter(s for g in learnt for s in g)
    idf = [math.log((1 + len(learnt)) / (1 + df[s])) + 1 for s in range(4096)]
    assert model.idf.tolist() == pytest.approx(idf, rel=1e-5)
    assert sorted(set(model.langs)) == model.langs and len(model.of) <= 4 * len(model.langs)
    assert np.linalg.norm(model.centroids, axis=1).tolist() == pytest.approx([1] * len(model.of), abs=1e-4)
    for g in predict(docs, model, ["doc_id"]).collect():
        x = {s: math.log1p(n) * idf[s] for s, n in grams[g.doc_id].items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        if not x:
            assert (g.lang_pred, g.score, g.rejected) == ("und", 0.0, True)
            continue
        cosines = [sum(v * float(c[s]) for s, v in x.items()) / norm for c in model.centroids]
        assert g.score == pytest.approx(max(cosines), abs=1e-4)
        near = {model.langs[model.of[i]] for i, c in enumerate(cosines) if c > max(cosines) - 1e-4}
        assert g.lang_pred in near


def test_one_id_with_many_rows_is_one_row_of_the_sample(spark):
    rows = [(7, f"abc bca {'x' * (i % 3)}", "aa", "s", 0) for i in range(3000)] + [(i, "klm mlk lkm", "bb", "s", 0) for i in range(10, 40)]
    model = fit(odd(spark, rows), per_lang=10)
    assert model.langs == ["aa", "bb"] and (model.of == 0).sum() == 1


#: About 110 letters each, of languages that the tables do not have.
NEAR_LANGUAGES = {
    "it": "La mattina seguente il vecchio pescatore tornò al porto con la barca piena e raccontò a tutti quello che aveva visto nella notte sul mare calmo",
    "pt": "Na manhã seguinte o velho pescador voltou ao porto com o barco cheio e contou a todos o que tinha visto durante a noite no mar tão calmo",
    "nl": "De volgende ochtend kwam de oude visser terug in de haven met een volle boot en vertelde iedereen wat hij die nacht op de kalme zee zag",
    "pl": "Następnego ranka stary rybak wrócił do portu z pełną łodzią i opowiedział wszystkim co widział w nocy na spokojnym morzu pod gwiazdami",
    "fi": "Seuraavana aamuna vanha kalastaja palasi satamaan vene täynnä kalaa ja kertoi kaikille mitä hän oli yöllä nähnyt tyynellä merellä yksin",
    "tr": "Ertesi sabah yaşlı balıkçı dolu teknesiyle limana döndü ve o gece sakin denizde gördüklerini bütün köylülere uzun uzun anlattı durdu",
}


def test_languages_that_were_not_learnt(spark):
    """Random letters and far scripts go at any length; of near languages in Latin letters, long texts go sooner than short."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    texts = [(100 * i + n, f"{t} " * n, k, "s", 0) for i, (k, t) in enumerate(NEAR_LANGUAGES.items()) for n in (1, 8, 40)]
    got = {r.doc_id: r for r in predict(odd(spark, texts), model, ["doc_id"]).collect()}
    gone = {n: sum(got[100 * i + n].rejected for i in range(len(NEAR_LANGUAGES))) for n in (1, 8, 40)}
    print({d: (round(r.score, 3), r.rejected) for d, r in sorted(got.items())})
    assert gone[1] <= gone[8] <= gone[40]


def test_gram_counts_are_those_of_a_plain_loop():
    g = Grams(1 << 16)
    x = g.letters("Ab, c1é!")
    assert [int(c) for c in x] == [0, 97, 98, 0, 99, 0, 233, 0]
    assert g.counts(x).sum() == len(x) + len(x) - 1 + len(x) - 2
    assert len(g.letters("12 !?")) == len(g.letters(None)) == 0


def test_centroids_and_bounds_come_from_all_training_documents(spark):
    """One centroid a language, so that it, those of the halves and all bounds are plain means and quantiles; English has over 400."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL").select("doc_id", "text", "lang")
    model, g = fit(docs, centroids=1), Grams(4096)
    rows = [(r.lang, r.h & 1, x) for r in docs.withColumn("h", _hash(17)).collect() if len(x := g.letters(r.text))]
    assert sum(lang == "en" for lang, _, _ in rows) > 400

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    def vectors(counts):
        return unit(np.log1p(np.stack(counts)) * model.idf.astype(float))

    def means(part):
        own = {lang: [g.counts(x) for l, h, x in rows if l == lang and part in (h, 2)] for lang in model.langs}
        return np.stack([unit(vectors(own[lang]).sum(axis=0)) for lang in model.langs])

    assert np.abs(model.centroids - means(2)).max() < 1e-4
    halves, found = [means(0), means(1)], {}
    for lang, h, x in rows:
        for k in range(CLASSES):
            if len(x) >= max((1 << k) // 2, 1):
                cosine = (vectors([g.counts(x[: (1 << k) // 2 + 2])]) @ halves[1 - h].T).max()
                found.setdefault(k, []).append((cosine, lang))
    for k in range(CLASSES):
        if len(found.get(k, [])) >= 200:
            low = np.quantile([c for c, _ in found[k]], 0.001)
            for i, lang in enumerate(model.langs):
                own = np.quantile([c for c, l in found[k] if l == lang], 0.02)
                assert model.bounds[i, k] == pytest.approx(min(low, own), abs=1e-3)


def test_the_model_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    a, b = fit(docs), fit(docs.orderBy(held_out(), "text").repartition(3))
    assert np.abs(a.centroids - b.centroids).max() < 1e-6 and np.abs(a.bounds - b.bounds).max() < 1e-4


def test_packed_counts():
    rows = np.zeros((3, 70), np.int64)
    rows[0, [0, 69]], rows[1, 5], rows[2, :] = (255, 1), 70_000, 3
    bits, values = zip(*(packed(x) for x in rows))
    assert unpacked(bits, values, 70).tolist() == rows.tolist()


def test_counts_of_beginnings():
    g = Grams(4096)
    x = g.letters("Ab, c1é! and more words")
    lengths = [1, 2, 3, 9, len(x)]
    slots, rows = g.beginnings(x, lengths)
    assert rows.sum() == sum(3 * n - 3 if n > 1 else 1 for n in lengths)
    for n, row in zip(lengths, rows):
        assert row.tolist() == g.counts(x[:n])[slots].tolist()
