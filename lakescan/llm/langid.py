"""Language identification: nearest of several centroids per language, by cosine of normalised TF-IDF n-gram vectors.

Texts become counts of hashed letter n-grams (1 to 3 letters, lower case, word ends as one mark). Document frequencies,
centroids and bounds come from all training documents, of their whole texts: the counts are written once, and each round
of spherical k-means is a pass over them whose tasks add their documents up. A document is rejected when its cosine to
the nearest centroid is below a low quantile of what texts of that length have with centroids that were not learnt from them.

Null texts and texts without a letter get ``und``, score 0, and are rejected. A null language is no training label; a
null id takes no part in training and counts as not held out. Of equally near centroids that of the first language by
name counts. Repeated rows count each. Extra columns are passed by. With no training document every text is ``und``; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_texts, written

UND = "und"
#: Letters of a text by powers of two: a length class has its own bound for rejection.
CLASSES = 18
#: Documents whose vectors a task holds at once. Vectors are added up in units of 1 / UNIT: DOCS of them are whole numbers
#: that a float32 holds, so sums don't depend on the order of rows.
DOCS, UNIT = 256, 1 << 15
#: Cosines are counted in steps of 1 / STEPS, rounded down.
STEPS = 1 << 16


class Grams:
    """Counts of hashed letter n-grams."""

    def __init__(self, slots: int):
        self.slots = slots
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def letters(self, text: str | None) -> np.ndarray:
        """Code points of the lower-case letters, with 0 for each stretch of others; empty if there is no letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        mask = self.is_letter[points]
        if not mask.any():
            return np.zeros(0, np.uint64)
        mask = np.concatenate([[False], mask, [False]])
        points = np.where(mask, np.concatenate([[0], points, [0]]), 0).astype(np.uint64)
        return points[np.append(mask[1:] | mask[:-1], True)]

    def keys(self, letters: np.ndarray) -> list[np.ndarray]:
        """Slots of the n-grams of one, two and three letters, by where they begin."""
        a = letters * np.uint64(0x9E3779B97F4A7C15)
        b = (a[:-1] ^ (a[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + letters[1:]
        c = (b[:-1] ^ (b[:-1] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + letters[2:]
        mixed = ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40) for x in (a, b, c))
        if self.slots & (self.slots - 1):
            return [(x % np.uint64(self.slots)).view(np.int64) for x in mixed]
        return [(x & np.uint64(self.slots - 1)).view(np.int64) for x in mixed]  # the same, and much faster

    def counts(self, letters: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate(self.keys(letters)), minlength=self.slots)

    def beginnings(self, letters: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The slots that the text has, and a row of their counts for each of the ascending lengths."""
        keys = self.keys(letters)
        slots = np.flatnonzero(np.bincount(np.concatenate(keys), minlength=self.slots))
        place = np.zeros(self.slots, np.int64)
        place[slots] = np.arange(len(slots))
        first, at = np.arange(len(lengths)) * len(slots), []
        for i, x in enumerate(keys):
            new = np.clip(np.array(lengths) - i, 0, len(x))
            n = new[-1]
            new[1:] -= new[:-1].copy()
            at.append(place[x[:n]] + np.repeat(first, new))
        rows = np.bincount(np.concatenate(at), minlength=len(lengths) * len(slots)).reshape(len(lengths), -1).astype(np.float32)
        for before, row in zip(rows, rows[1:]):
            row += before
        return slots, rows


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Which slots have a count, as bits, and those counts, in one byte each or, if one is larger, in four."""
    held = counts > 0
    values = counts[held]
    return np.packbits(held).tobytes(), values.astype(np.uint8 if values.max() < 256 else "<u4").tobytes()


def unpacked(bits: list[bytes], values: list[bytes], slots: int) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1, count=slots).view(bool)
    counts = np.zeros(held.shape, np.float32)
    counts[held] = np.concatenate([np.frombuffer(v, np.uint8 if len(v) == n else "<u4") for v, n in zip(values, held.sum(axis=1))])
    return counts


@dataclass
class Model:
    """Centroids (unit rows) with the language of each, weights of the slots, and bounds by language and length class."""

    slots: int
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    langs: list[str]
    bounds: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32, copy=False)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and cosine of the nearest centroid, for rows of counts."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        return self.of[best], cosines[np.arange(len(best)), best]


def length_class(n_letters: int) -> int:
    return min(int(n_letters).bit_length(), CLASSES - 1)


def fit(training: DataFrame, slots: int = 4096, centroids: int = 4, per_lang: int | None = None, low: float = 0.001, own_low: float = 0.02, seed: int = 17) -> Model:
    """Learn from all of (doc_id, text, lang); low, own_low: which quantile of cosines of texts not learnt from a text must
    reach, of those of all languages and of its own; the lower one counts. per_lang: only on request, centroids and bounds
    from so many documents of each language; no query asks for it."""
    rows = training.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = written(_counts(rows, slots, seed), "langid-counts")
    model = Model(slots, _idf(counts, slots), np.zeros((0, slots), np.float32), np.zeros(0, int), [], np.zeros((0, CLASSES)))
    asked = None if per_lang is None else written(_few(rows, per_lang, seed), "langid-few")
    if asked is not None:
        forget(counts)
        rows, counts = asked, written(_counts(asked, slots, seed), "langid-counts")
    *halves, model = _models(counts, model, centroids)
    forget(counts)
    if model.langs:
        model.bounds = _bounds(rows, halves, model.langs, low, own_low, seed)
    if asked is not None:
        forget(asked)
    return model


def _hash(seed: int) -> Column:
    """Of the text, so equal texts are in the same half."""
    return F.xxhash64(F.lit(seed), "text")


def _few(rows: DataFrame, per_lang: int, seed: int) -> DataFrame:
    """The documents of each language with the smallest hash of their id, one row of an id."""
    one = F.row_number().over(Window.partitionBy("lang", "doc_id").orderBy(F.xxhash64("text")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id")))
    return rows.withColumn("_one", one).where("_one = 1").withColumn("_n", first).where(F.col("_n") <= per_lang).select("doc_id", "text", "lang")


def _counts(rows: DataFrame, slots: int, seed: int) -> DataFrame:
    """lang, h, bits, n: the counts of each text with a letter, as packed() gives them, and the hash of the text."""

    def make():
        grams = Grams(slots)

        def step(texts, keys):
            letters = [grams.letters(t) for t in texts]
            pairs = [packed(grams.counts(x)) if len(x) else (None, None) for x in letters]
            return keys | {"bits": [b for b, _ in pairs], "n": [n for _, n in pairs]}

        return step

    return map_texts(rows.withColumn("h", _hash(seed)), ["lang", "h"], "text", make, "lang string, h long, bits binary, n binary").where("bits IS NOT NULL")


def _idf(counts: DataFrame, slots: int) -> np.ndarray:
    """Each task gives one row per slot, and one for the number of its documents."""

    def run(batches):
        seen = np.zeros(slots + 1, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, DOCS):
                bits = b"".join(b.column(0)[i : i + DOCS].to_pylist())
                held = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, -(-slots // 8)), axis=1, count=slots)
                seen[:-1] += held.sum(axis=0, dtype=np.int64)
                seen[-1] += len(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots + 1, dtype=np.int32)), pa.array(seen)], ["slot", "n"])

    found = counts.select("bits").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(slots + 1)
    for r in found:
        seen[r.slot] = r.n
    return (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)


def _models(counts: DataFrame, empty: Model, centroids: int, rounds: int = 12) -> list[Model]:
    """Models without bounds of half 0, half 1 and all documents; a language without one half has all in its place.

    Spherical k-means of each language in each of the three parts, all in the same passes. It begins as k-means++ does,
    with draws from all documents, and ends when no centroid changes or after so many rounds."""
    centres: dict[tuple[str, int], np.ndarray] = {}
    for i in range(centroids):
        drawn = _drawn(counts, empty, centres, i)
        for key, x in drawn.items():
            centres[key] = np.concatenate([centres[key], x]) if key in centres else x
    for _ in range(rounds if centres else 0):
        before, centres = centres, _moved(counts, empty, centres)
        if all(np.array_equal(before[key], centres[key]) for key in centres):
            break
    langs = sorted({lang for lang, _ in centres})

    def model(part: int) -> Model:
        own = [centres.get((lang, part), centres[lang, 2]) for lang in langs]
        vectors = np.concatenate(own) if own else empty.centroids
        return Model(empty.slots, empty.idf, vectors, np.repeat(np.arange(len(langs)), [len(x) for x in own]), langs, np.zeros((len(langs), CLASSES)))

    return [model(part) for part in range(3)]


def _groups(batches):
    """From batches of (lang, h, bits, n) slices of documents, and (language, part, rows of the slice) of each."""
    for b in batches:
        for i in range(0, b.num_rows, DOCS):
            lang, h, bits, n = (c.slice(i, DOCS).to_pylist() for c in b.columns)
            h = np.array(h, np.int64).view(np.uint64)
            langs, of = np.unique(np.array(lang, object), return_inverse=True)
            groups = []
            for k, name in enumerate(langs):
                own = np.flatnonzero(of == k)
                groups += [(name, part, x) for part in (0, 1) if len(x := own[h[own] & np.uint64(1) == part])] + [(name, 2, own)]
            yield groups, h, bits, n


def _drawn(counts: DataFrame, model: Model, centres: dict[tuple[str, int], np.ndarray], turn: int) -> dict[tuple[str, int], np.ndarray]:
    """By language and part a document drawn with a probability in proportion to 1 - its cosine to the nearest centre, if
    not all documents are at one: that with the least -log(u) / weight, where u is made of the hash of its text."""
    shared = counts.sparkSession.sparkContext.broadcast((model, centres))

    def run(batches):
        model, centres = shared.value
        best = {}
        for groups, h, bits, n in _groups(batches):
            x = model.vectors(unpacked(bits, n, model.slots)) if turn else None
            u = (h >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn + 1) * 0xD1342543DE82EF95 % 2**64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                u = (u ^ u >> np.uint64(shift)) * np.uint64(factor)
            far = -np.log(((u ^ u >> np.uint64(31)) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)
            for lang, part, rows in groups:
                key = far[rows]
                if turn:
                    weight = 1 - (x[rows] @ centres[lang, part].T).max(axis=1).astype(float)
                    key = np.where(weight > 1e-5, key / np.maximum(weight, 1e-5), math.inf)
                i = int(key.argmin())
                if key[i] < min(best.get((lang, part), (math.inf,))[0], math.inf):
                    best[lang, part] = (float(key[i]), bits[rows[i]], n[rows[i]])
        if best:
            columns = [[k[0] for k in best], [k[1] for k in best], *zip(*best.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64(), pa.binary(), pa.binary()))], ["lang", "part", "key", "bits", "n"])

    found = counts.mapInArrow(run, "lang string, part int, key double, bits binary, n binary").groupBy("lang", "part").agg(F.min(F.struct("key", "bits", "n")).alias("x"))
    return {(r.lang, r.part): model.vectors(unpacked([bytes(r.x.bits)], [bytes(r.x.n)], model.slots)) for r in found.collect()}


def _moved(counts: DataFrame, model: Model, centres: dict[tuple[str, int], np.ndarray], most: int = 1000) -> dict[tuple[str, int], np.ndarray]:
    """Each centre at the mean direction of the documents that are nearest to it, or where it was if there are none.

    A task holds at most about ``most`` sums and those of one slice; then it gives them away."""
    shared = counts.sparkSession.sparkContext.broadcast((model, centres))
    names, kinds = ["lang", "part", "place", "x"], (pa.string(), pa.int32(), pa.int32(), pa.binary())

    def batch(sums: dict) -> pa.RecordBatch:
        columns = [*zip(*sums), [x.tobytes() for x in sums.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def add(batches):
        model, centres = shared.value
        sums = {}
        for groups, _, bits, n in _groups(batches):
            x = model.vectors(unpacked(bits, n, model.slots))
            keys, which = [], []
            for lang, part, rows in groups:
                to = (x[rows] @ centres[lang, part].T).argmax(axis=1)
                for place in np.unique(to):
                    keys.append((lang, part, int(place)))
                    which.append(rows[to == place])
            members = np.zeros((len(keys), len(x)), np.float32)
            for row, own in zip(members, which):
                row[own] = 1
            for key, total in zip(keys, members @ np.rint(x * UNIT)):
                sums[key] = sums[key] + total if key in sums else total.astype(np.float64)
            if len(sums) > most:
                yield batch(sums)
                sums = {}
        if sums:
            yield batch(sums)

    def whole(batches):
        sums = {}
        for b in batches:
            for *key, x in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(x)
                sums[tuple(key)] = sums[tuple(key)] + x if tuple(key) in sums else x
        if sums:
            yield batch({key: (x / max(np.linalg.norm(x), 1e-12)).astype("<f4") for key, x in sums.items()})

    schema = "lang string, part int, place int, x binary"
    found = {key: x.copy() for key, x in centres.items()}
    for r in counts.mapInArrow(add, schema).repartition("lang", "part", "place").mapInArrow(whole, schema).collect():
        found[r.lang, r.part][r.place] = np.frombuffer(r.x, "<f4")
    return found


def _cosines(rows: DataFrame, halves: list[Model], seed: int) -> DataFrame:
    """lang, class, at: cosines in steps of the beginnings of each text, at the least length of each class, by the half that
    it is not in."""
    shared = rows.sparkSession.sparkContext.broadcast(halves)

    def make():
        models = shared.value
        grams, across = Grams(models[0].slots), [np.ascontiguousarray(m.centroids.T) for m in models]

        def step(texts, keys):
            out = {"lang": [], "class": [], "at": []}
            for text, lang, h in zip(texts, keys["lang"], keys["h"]):
                x = grams.letters(text)
                own = [k for k in range(CLASSES) if len(x) >= max((1 << k) // 2, 1)]
                if own:
                    slots, counts = grams.beginnings(x[: (1 << own[-1]) // 2 + 2], [(1 << k) // 2 + 2 for k in own])
                    vectors = np.log1p(counts) * models[0].idf[slots]
                    cosines = (vectors @ across[1 - (h & 1)][slots]).max(axis=1) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
                    out["lang"] += [lang] * len(own)
                    out["class"] += own
                    out["at"] += np.floor(cosines * STEPS).astype(int).tolist()
            return out

        return step

    return map_texts(rows.withColumn("h", _hash(seed)), ["lang", "h"], "text", make, "lang string, class int, at int")


def _quantiles(steps: DataFrame, keys: list[str], share: float) -> list:
    """keys, low, total: the quantile of (at, n), as F.percentile gives it; a task holds steps, however many documents they count."""
    by = Window.partitionBy(*keys)
    place = F.lit(share) * (F.col("total") - 1)
    counted = steps.groupBy(*keys, "at").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by.orderBy("at"))).withColumn("total", F.sum("n").over(by))
    ends = [F.min(F.when(F.col("upto") > end, F.col("at"))) for end in (F.floor(place), F.ceil(place))]
    found = counted.groupBy(*keys, "total").agg(ends[0].alias("a"), ends[1].alias("b"))
    return found.select(*keys, "total", ((F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))) / STEPS).alias("low")).collect()


def _bounds(rows: DataFrame, halves: list[Model], langs: list[str], low: float, own_low: float, seed: int, least: int = 200) -> np.ndarray:
    """By language and length class, from all rows: the ``low`` quantile over all languages, of classes that have
    ``least`` documents, but not above the language's own ``own_low`` quantile, so that no language goes as a whole.
    What a class lacks is taken from the next shorter one."""
    steps = written(_cosines(rows, halves, seed).groupBy("lang", "class", "at").agg(F.count("*").alias("n")), "langid-cosines")
    pooled = {r["class"]: r.low for r in _quantiles(steps, ["class"], low) if r.total >= least}
    own = {(r.lang, r["class"]): r.low for r in _quantiles(steps, ["lang", "class"], own_low)}
    forget(steps)
    bounds = np.zeros((len(langs), CLASSES))
    for i, lang in enumerate(langs):
        usual = most = math.inf
        for k in range(CLASSES):
            usual, most = pooled.get(k, usual), own.get((lang, k), most)
            if min(usual, most) < math.inf:
                bounds[i, k] = min(usual, most)
    return bounds


def predict(docs: DataFrame, model: Model, keys: list[str], with_text: bool = False) -> DataFrame:
    """keys, lang_pred, score (cosine, 0 to 1), rejected, and text if asked for: one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * centroids * slots floats

    def make():
        m = shared.value
        grams = Grams(m.slots)

        def step(texts, own):
            letters = [grams.letters(t) for t in texts]
            known = [i for i, x in enumerate(letters) if len(x)] if m.langs else []
            lang, score, rejected = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known:
                which, cosines = m.nearest(np.stack([grams.counts(letters[i]) for i in known]))
                for i, w, c in zip(known, which, cosines):
                    lang[i], score[i] = m.langs[w], min(max(float(c), 0.0), 1.0)
                    rejected[i] = c < m.bounds[w, length_class(len(letters[i]))]
            return own | {"lang_pred": lang, "score": score, "rejected": rejected} | ({"text": texts} if with_text else {})

        return step

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return map_texts(docs, keys, "text", make, f"{kinds}, lang_pred string, score double, rejected boolean" + ", text string" * with_text)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_unheld(docs: DataFrame, **options) -> Model:
    """Learn from the labelled documents that are not held out."""
    return fit(docs.where(~held_out()), **options)


