"""Word and span hashes, and bitmaps of hash sets, that the dedup operators share.

Hashes are polynomials modulo 2^64 with an odd base, taken from prefix sums: a span's is a difference of two entries,
brought to a common power by the inverse base. Bytes stand for random 64-bit numbers, and results are mixed.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_NEXT_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
BLOCK = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown to the longest block so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) <= n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(BASE, k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(INVERSE, k, 1 << 64))])
        return cls.up, cls.down


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _Powers.upto(len(values))[0][: len(values)], out=out[1:])
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of bytes.split(), in order."""
    if len(data) <= BLOCK:
        return _block_hashes(data)
    out, at = [], 0
    while at < len(data):
        m = _NEXT_SPACE.search(data, min(at + BLOCK, len(data)))
        end = m.start() if m else len(data)
        out.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def _block_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = _sums(_BYTES[b])
    return mixed((sums[ends] - sums[starts]) * _Powers.down[starts] + (ends - starts).astype(np.uint64))


def spans(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of so many entries."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        part = hashes[a : a + BLOCK + size - 1]
        sums = _sums(part)
        k = len(part) - size + 1
        out[a : a + k] = mixed((sums[size:] - sums[:k]) * _Powers.down[:k])
    return out


class Bitmap:
    """Which hashes are in a set, with false positives: one bit each in a table of fixed size."""

    def __init__(self, bits: int = 26):
        self.bits, self.table = bits, np.zeros(1 << (bits - 3), np.uint8)

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int = 26) -> Bitmap:
        """From a column of longs; tables of 8 KB come to the driver, as many as the size allows and no more."""
        low, out = 16, cls(bits)

        def build(rows):
            table = np.zeros(1 << (low - 3), np.uint8)
            at = rows["bit"].to_numpy() & ((1 << low) - 1)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
            import pandas as pd

            return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "table": [table.tobytes()]})

        bit = F.expr(f"{column} & {(1 << bits) - 1}")
        found = df.select(bit.alias("bit")).distinct().withColumn("part", F.expr(f"bit >> {low}")).groupBy("part").applyInPandas(build, "part long, table binary")
        for r in found.collect():
            out.table[r.part << (low - 3) : (r.part + 1) << (low - 3)] = np.frombuffer(r.table, np.uint8)
        return out

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @classmethod
    def repeated(cls, df: DataFrame, column: str, hashes, bits: int = 26, low: int = 20, held: int = 1 << 20) -> Bitmap:
        """Of hashes that stand more than once: hashes(value) gives those of each value of a column, and they never
        become rows. Tasks send the bits that they meet, packed by parts of the table; a part's come to one task, which
        holds two tables of its size; the driver gets the table."""
        import pyarrow as pa

        schema = "part int, data binary"

        def batch(parts, data):
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

        def packed(found: list[np.ndarray]):
            at = np.sort(np.concatenate(found) & np.uint64((1 << bits) - 1))
            cuts = np.searchsorted(at, np.arange(1, 1 << (bits - low), dtype=np.uint64) << np.uint64(low))
            lows = [(x & np.uint64((1 << low) - 1)).astype("<u4") for x in np.split(at, cuts)]
            there = [i for i, x in enumerate(lows) if len(x)]
            return batch(there, [lows[i].tobytes() for i in there])

        def send(batches):
            found, n = [], 0
            for b in batches:
                for value in b.column(0):
                    found.append(hashes(value.as_py()))
                    n += len(found[-1])
                    if n >= held:
                        yield packed(found)
                        found, n = [], 0
            if n:
                yield packed(found)

        def merge(batches):
            at, once, twice = None, None, None
            for b in batches:
                for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if part != at:
                        if at is not None:
                            yield batch([at], [np.packbits(twice, bitorder="little").tobytes()])
                        at, once, twice = part, np.zeros(1 << low, bool), np.zeros(1 << low, bool)
                    own, n = np.unique(np.frombuffer(data, "<u4"), return_counts=True)
                    twice[own[(n > 1) | once[own]]] = True
                    once[own] = True
            if at is not None:
                yield batch([at], [np.packbits(twice, bitorder="little").tobytes()])

        sent = df.select(column).mapInArrow(send, schema)
        out = cls(bits)
        for r in sent.repartition("part").sortWithinPartitions("part").mapInArrow(merge, schema).collect():
            out.table[r.part << (low - 3) : (r.part + 1) << (low - 3)] = np.frombuffer(r.data, np.uint8)
        return out
