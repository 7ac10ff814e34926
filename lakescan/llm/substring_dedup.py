"""Exact substring removal: words in windows of 50 words that also start in a document with a smaller id.

The work is split by anchors. Of the 43 spans of 8 words in a window the one with the smallest hash is its anchor: the
same windows have the same anchor at the same place, so each anchor is a shard of its own. Consecutive windows with one
anchor make a run, and runs are what is dealt:

1. all runs are written once; anchors that occur in documents with different ids are found by a minimum and a maximum
   (combined before the shuffle), and a bitmap of them, of fixed size, keeps all other runs from being shuffled;
2. equal runs of an anchor are reduced to their smallest id: all windows of the others are covered by it;
3. what is left, different runs of one anchor, goes to suffix automata: a shard's runs come by document id, each is
   streamed through the automaton of those before it (matching statistics), and then extends it. An automaton holds at
   most ``most`` runs, which bounds a task's memory; in larger shards windows are told apart by hashes of all their
   words, and the smallest id of each that is there again is found, so that a hot anchor is no large group;
4. what each document's runs lose is joined to its text, and the covered words are removed.

The corpus is its own reference, so its automata can't be sent to every task: that grows with the data. They are built
where their shard's runs are instead.

Null and empty texts have no words. Rows with the same id never cover one another; a null id is smaller than all
others. Repeated rows are each returned. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_texts, text_slices, written
from .hashing import Bitmap, mixed, spans, word_hashes, words_of

ANCHOR = 8
NO_ID = -(2**63)


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """For each span of ``width`` keys the place of its smallest one (by the upper 40 bits), the leftmost of equal ones."""
    places, n = np.uint64(24), len(keys) - width + 1
    if len(keys) >> 24:
        order = np.argsort(keys >> places, kind="stable")
        low = np.empty(len(keys), np.uint64)
        low[order] = np.arange(len(keys), dtype=np.uint64)
    else:
        order, low = None, (keys >> places << places) | np.arange(len(keys), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    low = np.minimum(low[:n], low[width - done : width - done + n])
    return order[low] if order is not None else (low & np.uint64((1 << 24) - 1)).astype(np.int64)


class Runs:
    """The runs of a text: anchors, first windows, numbers of windows, and hashes of all their words."""

    def __init__(self, hashes: np.ndarray, window: int):
        self.n = max(len(hashes) - window + 1, 0)
        empty = np.zeros(0, np.int64)
        self.first, self.count, self.anchor, self.key = empty, empty, empty, empty
        if not self.n:
            return
        keys = spans(hashes, ANCHOR)
        at = least_of(keys, window - ANCHOR + 1)
        self.first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        self.count = np.diff(np.append(self.first, self.n))
        self.anchor = keys[at[self.first]].view(np.int64)
        # The first and the last window overlap: their hashes fix all words of the run.
        whole = spans(hashes, window)
        last = self.first + self.count - 1
        self.key = mixed(whole[self.first] + mixed(whole[last] + mixed(self.count.astype(np.uint64)))).view(np.int64)


class Automaton:
    """Suffix automaton of words, grown word by word; documents are separated."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def separate(self) -> None:
        self.last = 0

    def add(self, word) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        if word in nxt[p]:
            q = nxt[p][word]
            if length[q] == length[p] + 1:
                self.last = q
                return
            self.last = self._clone(p, q, word)
            return
        cur = len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, word)
        self.last = cur

    def _clone(self, p: int, q: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = new
            p = link[p]
        link[q] = new
        return new

    def matches(self, words: list) -> list[int]:
        """Matching statistics: for each word the longest span ending there that the automaton has."""
        out, state, n = [], 0, 0
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def covered_in_shard(runs: list[tuple[int, int, list]], window: int) -> list[list[int]]:
    """For runs (id, number of windows, words) by id: the windows that a run with a smaller id has too."""
    automaton, out, i = Automaton(), [], 0
    while i < len(runs):
        j = i
        while j < len(runs) and runs[j][0] == runs[i][0]:
            j += 1
        same = runs[i:j]
        found = [[k - window + 1 for k, n in enumerate(automaton.matches(words)) if n >= window] for _, _, words in same] if i else [[] for _ in same]
        out += found
        if j < len(runs):
            for (_, count, words), hit in zip(same, found):
                if len(hit) < count:
                    automaton.separate()
                    for w in words:
                        automaton.add(w)
        i = j
    return out


RUN = "doc long, row long, anchor long, key long, first int, count int"


def _scan(docs: DataFrame, window: int, words_of_runs: tuple[Bitmap, Bitmap] | None = None) -> DataFrame:
    """One row per run: doc, row (hash of the text), anchor, key, first, count.

    words_of_runs: (documents, keys); only their runs, and with their words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words_of_runs) if words_of_runs else None
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)

    def make():
        own, keys = shared.value if shared else (None, None)

        def step(texts, ids):
            out, texts_out = [[] for _ in range(6)], []
            wanted = own.has(np.array(ids["doc"], np.int64)) if own else np.ones(len(texts), bool)
            for doc, row, text, there in zip(ids["doc"], ids["row"], texts, wanted.tolist()):
                if not there:
                    continue
                r = Runs(word_hashes((text or "").encode("utf-8", "surrogatepass")), window)
                which = np.arange(len(r.first)) if keys is None else np.flatnonzero(keys.has(r.key))
                if not len(which):
                    continue
                for c, v, k in zip(out, (np.full(len(which), doc), np.full(len(which), row), r.anchor[which], r.key[which], r.first[which], r.count[which]), kinds):
                    c.append(v.astype(k))
                if keys is not None:
                    all_words = words_of(text)
                    texts_out += [b" ".join(all_words[r.first[k] : r.first[k] + r.count[k] + window - 1]) for k in which]
            found = {n: np.concatenate(c) if c else np.zeros(0, k) for n, c, k in zip(("doc", "row", "anchor", "key", "first", "count"), out, kinds)}
            return found | ({"words": texts_out} if keys is not None else {})

        return step

    return map_texts(_ids(docs), ["doc", "row"], "text", make, RUN + (", words binary" if words_of_runs else ""))


def _of_anchors(runs: DataFrame, anchors: Bitmap) -> DataFrame:
    shared = runs.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        bitmap = shared.value
        for b in batches:
            yield b.filter(pa.array(bitmap.has(b.column(2).to_numpy())))

    return runs.mapInArrow(run, RUN)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text")


def _by_shard(runs: DataFrame, window: int) -> DataFrame:
    """anchor, key, covered (windows of the run): shards are read one after another from sorted rows."""

    def run(batches):
        shard, at, out = [], None, ([], [], [])

        def close():
            if shard:
                for (_, _, _, anchor, key), hit in zip(shard, covered_in_shard([x[:3] for x in shard], window)):
                    if hit:
                        for c, v in zip(out, (anchor, key, hit)):
                            c.append(v)

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["anchor", "key", "covered"])
            for c in out:
                c.clear()
            return made

        for b in batches:
            for anchor, doc, key, count, words in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != at:
                    close()
                    shard, at = [], anchor
                shard.append((doc, count, words.split(b" "), anchor, key))
                if len(out[0]) > 2000:
                    yield batch()
        close()
        yield batch()

    ordered = runs.repartition("anchor").sortWithinPartitions("anchor", "doc", "key").select("anchor", "doc", "key", "count", "words")
    return ordered.mapInArrow(run, "anchor long, key long, covered array<int>")


def _by_window(runs: DataFrame, window: int) -> DataFrame:
    """The same for shards of any size, by hashes of windows; windows never become rows, but those that stand first.

    Of a window that is there again all but those of its smallest id are covered. A bitmap says which are there again;
    the smallest id of each is found (combined in batches and before the shuffle), and a document gets the list of those
    that are its own. What is only taken for there again has its own id as the smallest.
    """

    def hashes(words: bytes) -> np.ndarray:
        return spans(word_hashes(words), window)

    again = runs.sparkSession.sparkContext.broadcast(Bitmap.repeated(runs, "words", hashes))

    def firsts(batches):
        for b in batches:
            own = [hashes(w.as_py()) for w in b.column(1)]
            docs = np.repeat(b.column(0).to_numpy(), [len(x) for x in own])
            flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
            there = again.value.has(flat)
            flat, docs = flat[there], docs[there]
            order = np.lexsort((docs, flat))
            flat, docs = flat[order], docs[order]
            new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[new].view(np.int64)), pa.array(docs[new])], ["hash", "doc"])

    first = runs.select("doc", "words").mapInArrow(firsts, "hash long, doc long").groupBy("hash").agg(F.min("doc").alias("doc"))
    lists = first.groupBy("doc").agg(F.collect_list("hash").alias("firsts"))

    def run(batches):
        for b in batches:
            anchors, keys, out = [], [], []
            for anchor, key, words, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                h = hashes(words.as_py())
                lost = again.value.has(h)
                if own.is_valid:
                    lost &= ~np.isin(h, own.values.to_numpy().view(np.uint64))
                if lost.any():
                    anchors.append(anchor)
                    keys.append(key)
                    out.append(np.flatnonzero(lost).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["anchor", "key", "covered"])

    return runs.join(lists, "doc", "left").select("anchor", "key", "words", "firsts").mapInArrow(run, "anchor long, key long, covered array<int>")


def covered_windows(docs: DataFrame, window: int = 50, most: int = 500) -> DataFrame:
    """doc, row, runs: array of (first, count, places): of the windows from first on, those at places, or all if null,
    start in a document with a smaller id too."""
    every = written(_scan(docs, window), "all-runs")
    shared = every.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
    runs = written(_of_anchors(every, Bitmap.of(shared, "anchor")), "runs")
    forget(every)
    least = runs.groupBy("anchor", "key").agg(F.min("doc").alias("least"))
    sizes = least.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    open_ = written(least.join(sizes, "anchor"), "open-runs")
    with_words = _scan(docs, window, (Bitmap.of(open_, "least"), Bitmap.of(open_, "key"))).withColumnRenamed("doc", "least")
    once = with_words.join(open_, ["anchor", "key", "least"]).dropDuplicates(["anchor", "key", "least"])
    texts = written(once.select("anchor", "key", F.col("least").alias("doc"), "count", "words", "n"), "open-words")
    forget(open_)
    covered, hot = _by_shard(texts.where(F.col("n") <= most), window), texts.where(F.col("n") > most)
    if not hot.isEmpty():
        covered = covered.unionByName(_by_window(hot, window))
    found = least.join(covered, ["anchor", "key"], "left")
    lost = runs.join(found, ["anchor", "key"]).where("doc > least OR covered IS NOT NULL")
    places = F.when(F.col("doc") <= F.col("least"), F.col("covered"))
    # Equal rows have equal runs; both aggregations use the one partitioning, and the join with texts too.
    once = lost.select("doc", "row", "first", "count", places.alias("places")).repartition("doc", "row").dropDuplicates(["doc", "row", "first"])
    return once.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "count", "places")).alias("runs"))


def _lost(n_words: int, first: np.ndarray, count: np.ndarray, places: pa.Array, window: int) -> np.ndarray:
    """Which words of a text the covered windows of its runs hold."""
    whole = places.is_null().to_numpy(zero_copy_only=False)
    some = places.filter(places.is_valid())
    starts = np.concatenate([first[whole], np.repeat(first[~whole], np.diff(some.offsets.to_numpy())) + some.flatten().to_numpy()])
    ends = np.concatenate([first[whole] + count[whole], starts[int(whole.sum()) :] + 1]) + window - 1
    edges = np.bincount(starts, minlength=n_words + 1) - np.bincount(ends, minlength=n_words + 1)
    return np.cumsum(edges)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = 50, most: int = 500, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the kept words, joined by a space), kept_sha256.

    with_text=False leaves kept null.
    """
    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = _ids(docs).join(covered_windows(docs, window, most), ["doc", "row"], "left")

    def run(batches):
        for b in batches:
            runs = b.column(2)
            offsets, there = runs.offsets.to_numpy(), runs.is_valid().to_numpy(zero_copy_only=False)
            first, count, places = (runs.values.field(k) for k in range(3))
            first, count = first.to_numpy(), count.to_numpy()
            for start, stop in text_slices(b.column(1)):
                out = [[] for _ in names]
                docs_, texts = (b.column(k).slice(start, stop - start).to_pylist() for k in (0, 1))
                for i, doc, text in zip(range(start, stop), docs_, texts):
                    words, removed = words_of(text), 0
                    if there[i]:
                        own = slice(offsets[i], offsets[i + 1])
                        lost = _lost(len(words), first[own], count[own], places.slice(own.start, own.stop - own.start), window)
                        n, removed = len(words), int(lost.sum())
                        kept = b" ".join(compress(words, (~lost).tolist()))
                    else:
                        n, kept = len(words), b" ".join(words)
                    text = kept.decode("utf-8", "surrogatepass") if with_text else None
                    for c, v in zip(out, (None if doc == NO_ID else doc, n, removed, text, hashlib.sha256(kept).hexdigest())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    return rows.select("doc", "text", "runs").mapInArrow(run, schema)


#: DuckDB SQL of the query: all windows of all documents, with the smallest id of each.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS w FROM starts),
least AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
hit AS (SELECT doc_id, i FROM windows JOIN least USING (w) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
each_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
