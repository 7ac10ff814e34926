"""Near-duplicate documents: MinHash signatures, banding, exact verification, connected components.

Texts with the same set of 5-word shingles are one class from the start. Each class has 200 minima of universal hashes
in 40 bands of 5; at a similarity of 0.75 a pair shares no band once in 50,000 pairs.

1. Buckets with more than one class are found by a minimum and a maximum (combined before the shuffle), and a bitmap of
   fixed size keeps all others from being dealt.
2. In a bucket every class is paired with one leader only. The pairs that share most bands are confirmed on the full
   sets and joined to components: that settles large groups of copies without listing their pairs.
3. Buckets that still hold more than one component are compared in blocks, of which no task holds more than two. First
   every class gets the partners in other components whose signatures (a byte for each minimum) agree most with its own:
   a family whose members are only like their origin meets there. Then all pairs of different components, of sizes that
   allow the similarity, whose signatures agree enough are compared on the full sets: of the pairs that share a bucket,
   no link between two components is lost.

Null texts and texts without words have an empty set and are linked with nothing. Rows with the same id are each
returned; a null id is larger than all others. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, forget, map_texts, written
from .components import components
from .hashing import Bitmap, mixed, spans, word_hashes

SHINGLE, BANDS, ROWS = 5, 40, 5
LAST = 2**63 - 1
#: Of a bucket, a task holds two blocks of about so many classes and shingles.
BLOCK, BLOCK_SHINGLES = 2000, 2_000_000


class Signer:
    """Shingle sets and signatures of texts."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = (r.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * 2 + 1)[:, None]
        self.b = r.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]

    def shingles(self, text: str | None) -> np.ndarray:
        """Hashes of the set, sorted; ASCII letters count in lower case."""
        words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
        return np.unique(spans(words, min(SHINGLE, len(words)))) if len(words) else np.zeros(0, np.uint64)

    def minima(self, shingles: np.ndarray, step: int = 512) -> np.ndarray:
        x, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
        for i in range(0, len(x), step):
            np.minimum(out, (self.a * x[i : i + step] + self.b).min(axis=1), out=out)
        return out

    @staticmethod
    def keys(minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return key.view(np.int64)


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def sig_of(minima: np.ndarray) -> bytes:
    """The low byte of each minimum: minima crowd towards 0 as sets grow, so their upper bytes agree by chance."""
    return (minima & np.uint32(255)).astype(np.uint8).tobytes()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """doc, n, node (which set), keys (of bands), sig (a byte for each minimum); node is null for empty sets."""

    def make():
        signer = Signer()

        def step(texts, own):
            sets = [signer.shingles(t) for t in texts]
            minima = [signer.minima(s) if len(s) else None for s in sets]
            return own | {
                "n": [len(s) for s in sets],
                "node": [node_of(s) if len(s) else None for s in sets],
                "keys": [Signer.keys(m) if m is not None else [] for m in minima],
                "sig": [sig_of(m) if m is not None else None for m in minima],
            }

        return step

    return map_texts(_rows(docs), ["doc"], "text", make, "doc long, n long, node binary, keys array<long>, sig binary")


def _buckets(signed: DataFrame) -> DataFrame:
    """key, node, n: classes in buckets with more than one class."""
    # Which class is the least or the largest does not matter, and 8 bytes tell classes apart well enough to look.
    short = F.xxhash64("node").alias("h")
    several = signed.where("node IS NOT NULL").select(short, F.explode("keys").alias("key")).groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    keep = signed.sparkSession.sparkContext.broadcast(Bitmap.of(several.where("a < b"), "key"))

    def run(batches):
        bitmap = keep.value
        for b in batches:
            nodes, n, keys = b.column(0), b.column(1), b.column(2)
            flat = keys.flatten().to_numpy()
            of = np.repeat(np.arange(b.num_rows), np.diff(keys.offsets.to_numpy()))
            hit = np.flatnonzero(bitmap.has(np.ascontiguousarray(flat))) if len(flat) else np.zeros(0, np.int64)
            at = pa.array(of[hit])
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit], pa.int64()), nodes.take(at), n.take(at)], ["key", "node", "n"])

    found = signed.where("node IS NOT NULL").select("node", "n", "keys").mapInArrow(run, "key long, node binary, n long")
    return written(found.distinct(), "buckets")


def _alike(n: str, m: str, percent: int):
    """Sizes that allow the similarity."""
    return (100 * F.least(n, m)) >= percent * F.greatest(n, m)


def _leaders(buckets: DataFrame, percent: int, tried: int) -> DataFrame:
    """a, b: each class with the leaders of its buckets that share most of them."""
    leader = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("b"), F.col("n").alias("m"))).alias("x")
    pairs = buckets.join(buckets.groupBy("key").agg(leader).select("key", "x.b", "x.m"), "key").where(F.col("node") != F.col("b"))
    counted = pairs.where(_alike("n", "m", percent)).groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("bands"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("bands"), "b"))
    return written(counted.withColumn("r", best).where(F.col("r") <= tried).select("a", "b"), "pairs")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set (sorted hashes of its shingles), made again from the texts of one document of each node."""
    wanted = nodes.distinct().join(classes, "node").select("node", "least")
    head = F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("bigint")
    wanted = written(wanted.withColumn("h", head.bitwiseXOR(F.col("least"))), "wanted")
    keep = docs.sparkSession.sparkContext.broadcast(Bitmap.of(wanted, "h"))

    def make():
        signer, bitmap = Signer(), keep.value

        def step(texts, own):
            sets = [signer.shingles(t) for t in texts]
            nodes = [node_of(s) for s in sets]
            heads = np.array([int.from_bytes(x[:7], "big") ^ d for x, d in zip(nodes, own["doc"])], np.int64)
            hit = [i for i in np.flatnonzero(bitmap.has(heads)).tolist() if len(sets[i])]
            return {"doc": [own["doc"][i] for i in hit], "node": [nodes[i] for i in hit], "set": [sets[i].astype("<u8").tobytes() for i in hit]}

        return step

    with batches_of(docs.sparkSession, 1000):
        some = map_texts(_rows(docs), ["doc"], "text", make, "doc long, node binary, set binary")
        sets = written(some.join(wanted.select("node", F.col("least").alias("doc")), ["node", "doc"]).dropDuplicates(["node", "doc"]).select("node", "set"), "sets")
    forget(wanted)
    return sets


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs whose full sets have the similarity."""
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sets = _sets(docs, classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def compare(batches):
        for b in batches:
            hit = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                if _similar(*(np.frombuffer(v.as_buffer(), "<u8") for v in (x, y)), percent):
                    hit.append(i)
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["u", "v"])

    with batches_of(docs.sparkSession, 200):  # a row is two whole sets
        links = written(both.select("a", "b", "x", "y").mapInArrow(compare, "u binary, v binary"), "links")
    forget(sets)
    return links


ROW = "key long, i int, j int, node binary, n long, root binary, own int, sig binary, keys array<long>"


def _open_blocks(buckets: DataFrame, roots: DataFrame, signed: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ROW, a table that it reads): the classes of buckets with several components, each bucket in blocks, each pair of blocks (i, j) once."""
    labelled = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = labelled.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size"), F.sum("n").alias("all"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    rows = written(labelled.join(sizes.where("a < b").select("key", blocks.alias("blocks")), "key"), "open-buckets")
    nodes = rows.select("node").distinct().join(classes, "node").select("node", F.col("least").alias("doc"))
    sigs = signed.select("node", "doc", "sig", "keys").join(nodes, ["node", "doc"]).dropDuplicates(["node", "doc"]).select("node", "sig", "keys")
    placed = rows.join(sigs, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _together(dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*(x.split()[0] for x in ROW.split(", ")))), rows


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node")


def _groups(batches, use):
    """What use(key, rows) gives for each run of equal (key, i, j)."""
    group, at = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:3] != at:
                if len(group) > 1:
                    yield use(group)
                group, at = [], row[:3]
            group.append(row)
    if len(group) > 1:
        yield use(group)


def _agreeing(group: list[tuple], percent: int, agree: float, best: int | None):
    """(row, agreeing rows) of rows by n, of different components; across blocks if there are two.

    best: only so many, those that agree most, for every row; else each pair once, in the first bucket that it shares.
    """
    key, _, _, _, n, roots, own, sigs, keys = list(zip(*group))[:9]
    sig, keys = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(group), -1), np.array(keys)
    n, own = np.array(n, np.int64), np.array(own)
    code: dict[bytes, int] = {}
    root = np.array([code.setdefault(r, len(code)) for r in roots])
    upto, two, least = np.searchsorted(n, 100 * n // percent, "right"), len(set(own.tolist())) > 1, agree * sig.shape[1]
    down = np.searchsorted(n, -(-percent * n // 100), "left") if best else np.arange(1, len(n) + 1)
    band = int((keys[0] == key[0]).argmax())
    for i in range(len(group)):
        j = np.arange(down[i], upto[i])
        j = j[(root[j] != root[i]) & ((own[j] != own[i]) if two else True)]
        if not best and len(j):
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
        if len(j):
            same = (sig[j] == sig[i]).sum(axis=1)
            hit = same >= least
            j = j[hit][np.argsort(-same[hit], kind="stable")[:best]] if best else j[hit]
            if len(j):
                yield i, j


def _partners(rows: DataFrame, percent: int, agree: float, best: int) -> DataFrame:
    """a, b: every class with those of its blocks that agree most."""

    def use(group):
        pairs = [sorted((group[i][3], group[k][3])) for i, js in _agreeing(group, percent, agree, best) for k in js.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(lambda b: _groups(b, use), "a binary, b binary").distinct()


def _all_links(docs: DataFrame, classes: DataFrame, rows: DataFrame, percent: int, agree: float) -> DataFrame:
    """u, v: all links between components. Signatures leave the rows with a partner; these are compared on full sets.

    Both steps are a row per class and bucket; pairs are never dealt.
    """
    names = [x.split()[0] for x in ROW.split(", ")]

    def flag(group):
        some = sorted({x for i, js in _agreeing(group, percent, agree, None) for x in (i, *js.tolist())})
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([group[x][c] for x in some], k) for c, k in enumerate(kinds)], names)

    some = written(rows.mapInArrow(lambda b: _groups(b, flag), ROW), "flagged")
    if some.isEmpty():
        return some.select(F.col("node").alias("u"), F.col("node").alias("v"))

    def compare(group):
        sets, u, v = [np.frombuffer(r[9], "<u8") for r in group], [], []
        for i, js in _agreeing(group, percent, agree, None):
            for k in js.tolist():
                if _similar(sets[i], sets[k], percent):
                    u.append(group[i][3])
                    v.append(group[k][3])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    with batches_of(docs.sparkSession, 500):
        sets = _sets(docs, classes, some.select("node"))
        whole = _together(some.join(sets, "node").select(*names, "set"))
        links = written(whole.mapInArrow(lambda b: _groups(b, compare), "u binary, v binary").distinct(), "links")
    forget(sets, some)
    return links


def near_duplicates(docs: DataFrame, percent: int = 75, tried: int = 2, agree: float = 0.58) -> DataFrame:
    """doc_id, n_shingles, component_id (least id linked, directly or not), kept (it is the document of that id).

    tried: leaders, and then best partners, that a class is compared with; agree: share of a signature that must agree
    before sets are read.
    """
    with batches_of(docs.sparkSession, 1000):
        signed = written(signatures(docs), "signatures")
    classes = written(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("least")), "classes")
    buckets = _buckets(signed)
    pairs = _leaders(buckets, percent, tried)
    links = _confirmed(docs, classes, pairs, percent)
    roots = written(components(links), "roots")
    blocks, read = _open_blocks(buckets, roots, signed, classes)
    again = written(_partners(blocks, percent, agree, tried).join(_ordered(pairs), ["a", "b"], "left_anti"), "pairs")
    forget(read, roots)
    links = links.unionByName(_confirmed(docs, classes, again, percent))
    roots = written(components(links), "roots")
    blocks, read = _open_blocks(buckets, roots, signed, classes)
    more = _all_links(docs, classes, blocks, percent, agree)
    if not more.isEmpty():
        roots = written(components(links.unionByName(more)), "roots")
    forget(read, buckets, pairs, again)
    smallest = roots.join(classes, "node").groupBy("root").agg(F.min("least").alias("component"))
    known = classes.join(roots, "node", "left").join(smallest, "root", "left")
    known = known.select("node", F.coalesce("component", "least").alias("component"))
    found = signed.select("doc", "n", "node").join(known, "node", "left")
    doc, component = (F.when(F.col(c) != LAST, F.col(c)) for c in ("doc", "component"))
    component = F.when(F.col("node").isNull(), doc).otherwise(component)
    return found.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), doc.eqNullSafe(component).alias("kept"))


#: DuckDB SQL of the query: every pair that shares a shingle, and all that is reachable over links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least ON least.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""
