"""Document fingerprints from modular prefix arrays of polynomial hashes.

S[k] = sum of (c_j + 1) * B^j over j < k, modulo a prime, for two primes at once. Any span's hash is a difference of
two entries, brought to a common power; equal spans are found without reading them, and the longest common extension
of two positions by binary search. A fingerprint is the whole text's hash and length, and the smallest of the mixed
hashes of all its spans of ``WIDTH`` code points. The fingerprint of an edited text comes from the prefix arrays of
its two parts and of the few spans across the seam.

Null texts count as empty. Rows with the same id are ordered by text; null ids come first, texts that are null before
empty ones. Repeated rows follow one another. Extra columns are not read. One document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Primes below 2^31, and bases drawn once.
PRIMES = (2147483647, 2147483629)
BASES = (1000003337, 1342177523)
WIDTH, KEPT, BLOCK = 12, 48, 1 << 18


class _Powers:
    """Powers of a base and of its inverse, grown as texts ask for them."""

    def __init__(self, base: int, prime: int):
        self.prime, self.base, self.inverse = prime, base, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) <= n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, self.prime)) % np.uint64(self.prime)])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, self.prime)) % np.uint64(self.prime)])


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]


class PrefixHash:
    """Prefix arrays of a text: 8 bytes for each code point."""

    def __init__(self, points: np.ndarray):
        self.n, self.sums = len(points), []
        for x in _POWERS:
            x.upto(self.n)
            p, carry = np.uint64(x.prime), np.uint64(0)
            sums = np.zeros(self.n + 1, np.uint32)
            for a in range(0, self.n, BLOCK):
                part = (points[a : a + BLOCK].astype(np.uint64) + np.uint64(1)) * x.up[a : min(a + BLOCK, self.n)] % p
                part = (np.cumsum(part) + carry) % p
                sums[a + 1 : a + 1 + len(part)] = part
                carry = part[-1]
            self.sums.append(sums)

    def span(self, a: int, b: int) -> int:
        """The hash of points[a:b], the same wherever the span stands."""
        return sum(((int(s[b]) - int(s[a])) * int(x.down[a]) % x.prime) << (31 * i) for i, (s, x) in enumerate(zip(self.sums, _POWERS)))

    def then(self, n: int, other: PrefixHash, m: int) -> int:
        """The hash of this text's first n code points followed by the other's first m."""
        return sum(
            ((int(s[n]) + int(x.up[n]) * int(o[m])) % x.prime) << (31 * i) for i, (s, o, x) in enumerate(zip(self.sums, other.sums, _POWERS))
        )

    def common(self, a: int, other: PrefixHash, b: int) -> int:
        """The longest common extension of position a and the other's position b."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            k = (low + high + 1) // 2
            if self.span(a, a + k) == other.span(b, b + k):
                low = k
            else:
                high = k - 1
        return low

    def windows(self, width: int) -> np.ndarray:
        """Mixed 32-bit hashes of all spans of that width; of the whole text, if it is shorter."""
        width = min(width, self.n)
        n = self.n - width + 1
        out = np.zeros(n, np.uint32)
        for a in range(0, n, BLOCK):
            b, key = min(a + BLOCK, n), np.zeros(min(BLOCK, n - a), np.uint64)
            for s, x in zip(self.sums, _POWERS):
                p = np.uint64(x.prime)
                d = (s[a + width : b + width].astype(np.uint64) + p - s[a:b]) * x.down[a:b] % p
                key = key << np.uint64(31) ^ d
            key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            key = (key ^ key >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
            out[a:b] = key >> np.uint64(32)
        return out


def smallest(keys: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The smallest different keys, in order."""
    if len(keys) > 8 * kept:
        few = np.unique(keys[keys <= np.uint32(min(2**32 - 1, 2**32 * 4 * kept // len(keys)))])
        if len(few) >= kept:
            return few[:kept]
    return np.unique(keys)[:kept]


@dataclass
class Print:
    whole: int
    length: int
    sketch: np.ndarray

    def __str__(self) -> str:
        return f"{self.length:x}.{self.whole:016x}.{self.sketch.astype('>u4').tobytes().hex()}"


def parse(fingerprint: str) -> Print:
    n, whole, sketch = fingerprint.split(".")
    return Print(int(whole, 16), int(n, 16), np.frombuffer(bytes.fromhex(sketch), ">u4").astype(np.uint32))


def likeness(a: Print, b: Print) -> float:
    """The share of spans in common, 2 |A & B| / (|A| + |B|), estimated from the smallest of both; 1 for equal texts."""
    if (a.whole, a.length) == (b.whole, b.length):
        return 1.0
    union = np.union1d(a.sketch, b.sketch)[: max(len(a.sketch), len(b.sketch))]
    both = np.intersect1d(a.sketch, b.sketch, assume_unique=True)
    j = int(np.isin(union, both, assume_unique=True).sum()) / max(len(union), 1)
    return 2 * j / (1 + j)


class Document:
    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.hash = PrefixHash(self.points)
        self.keys = self.hash.windows(WIDTH)
        self.print = Print(self.hash.span(0, self.hash.n), self.hash.n, smallest(self.keys))

    def edited(self, following: Document) -> tuple[str, Print]:
        """The text whose last half is replaced by as much of the following one's beginning, and its fingerprint."""
        n = self.hash.n
        head, tail = n - n // 2, min(n // 2, following.hash.n)
        text, size = self.text[:head] + following.text[:tail], head + tail
        if min(head, tail) < WIDTH:
            keys = PrefixHash(np.concatenate([self.points[:head], following.points[:tail]])).windows(WIDTH)
        else:
            seam = np.concatenate([self.points[head - WIDTH + 1 : head], following.points[: WIDTH - 1]])
            keys = np.concatenate([self.keys[: head - WIDTH + 1], PrefixHash(seam).windows(WIDTH), following.keys[: tail - WIDTH + 1]])
        return text, Print(self.hash.then(head, following.hash, tail), size, smallest(keys))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long"


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: SCHEMA. common_edited: the longest common prefix with the edited text.

    Documents are dealt by ranges of doc_id, once. The first rows of a range go to the range before it too, so that
    its last document finds the next one; those are as many as there are ranges.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"))
    cuts = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @pandas_udf("int")
    def part(at):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, at.to_numpy(), "left").astype(np.int32))

    placed = rows.withColumn("part", part("at"))
    firsts = sorted((r.part, r.first) for r in placed.groupBy("part").agg(F.min("at").alias("first")).collect())  # at most ``parts`` rows
    before = {at: firsts[i - 1][0] for i, (_, at) in enumerate(firsts)}  # the range before the first is the last

    @pandas_udf("int")
    def also(at):
        import pandas as pd

        return pd.Series([before.get(x, -1) for x in at.tolist()], dtype="int32")

    copies = F.filter(F.array(F.struct(F.col("part"), F.lit(0).alias("copy")), F.struct(F.col("also").alias("part"), F.lit(1).alias("copy"))), lambda x: x["part"] >= 0)
    dealt = placed.withColumn("also", also("at")).select("doc_id", "text", "at", F.explode(copies).alias("x")).select("x.part", "x.copy", "at", "doc_id", "text")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "copy", "at", "text")
    return ordered.select("part", "copy", "doc_id", "text").mapInArrow(_rows, SCHEMA)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, last_part, out = None, None, []
    for b in batches:
        for part, copy, doc_id, text in zip(*(b.column(i) for i in range(4))):
            if copy.as_py() and (last is None or last_part != part.as_py()):
                continue  # the range's documents have all found their next one
            own = Document(doc_id.as_py(), text.as_py())
            if last is not None and last_part == part.as_py():
                out.append(_row(last, own))
            last, last_part = (None if copy.as_py() else own), part.as_py()
            if len(out) >= 500:
                yield _batch(out)
                out = []
    yield _batch(out)


def _row(own: Document, following: Document) -> tuple:
    text, edited = own.edited(following)
    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    head = own.hash.n - own.hash.n // 2
    common = head + min(own.hash.common(head, following.hash, 0), own.hash.n // 2)
    return own.doc_id, own.hash.n, sha, str(own.print), str(edited), likeness(own.print, edited), likeness(own.print, following.print), common


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])
