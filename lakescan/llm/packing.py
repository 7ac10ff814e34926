"""Packing token sequences as vector bin packing: tokens, segments and loss-bearing tokens at once.

An open sequence has a vector of what is left of each limit; of the waiting pieces that fit, the one with the largest
dot product of its own vector (as shares of the limits) with that rest goes in next. When none fits whole, or the
segments left would not fill the sequence with such, the one whose beginning has the largest dot product is cut. Each task packs the documents of its own partition in a bounded window, so nothing is
shuffled, no group is gathered and a task that runs again gives the same sequences.

A sequence is 2048 tokens or a smaller power of two: what the limit on segments or loss tokens keeps from being filled,
and what is left at the end of a task, is cut at one, and the rest goes on waiting. So nothing is padded.

Which tokens bear loss: all but the first ``context`` part of each document (an eighth: what the rest is read in the
light of), if no column of numbers of loss-free leading tokens is named. At most 15/16 of a sequence bear loss, so that
the inside of a long document has to share its sequences with the beginnings of others.

Null and empty texts give the end id alone, as one piece. Repeated rows and ids are packed each for itself (their pieces
have the same doc_id). A null or negative number of loss-free tokens counts as 0. Extra columns are not read. An empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .tokenize import encoder, tokenizer_path


@dataclass
class Piece:
    """``length`` tokens of document ``key`` from ``start``. Loss is borne by all but the document's first ``free``
    tokens, or as ``loss`` has it: running sums of the document's flags, from 0."""

    key: object
    start: int
    length: int
    loss: np.ndarray | None = None
    free: int = 0

    def loss_tokens(self, length: int | None = None) -> int:
        n = self.length if length is None else length
        if self.loss is not None:
            return int(self.loss[self.start + n] - self.loss[self.start])
        return n - min(max(self.free - self.start, 0), n)

    def upto(self, loss: float) -> int:
        """The most tokens from the start of the piece with no more loss than that."""
        if self.loss is not None:
            return min(self.length, int(np.searchsorted(self.loss[self.start :], self.loss[self.start] + loss, "right")) - 1)
        return min(self.length, max(self.free - self.start, 0) + int(loss))

    def split(self, n: int) -> tuple[Piece, Piece | None]:
        rest = Piece(self.key, self.start + n, self.length - n, self.loss, self.free) if n < self.length else None
        return Piece(self.key, self.start, n, self.loss, self.free), rest


@dataclass
class Packer:
    """Takes pieces, gives closed sequences as lists of (piece, offset); keeps at most ``window`` pieces waiting, and
    ``held`` tokens and one piece."""

    size: int = 2048
    segments: int = 32
    loss: int = 1920
    window: int = 1024
    held: int = 1 << 21
    cut: bool = True
    waiting: list[Piece] = field(default_factory=list)

    def __post_init__(self):
        if min(self.size, self.segments, self.loss) < 1:
            raise ValueError("limits are at least 1")
        self._flagged, self._tokens = False, 0

    def add(self, piece: Piece) -> Iterator[list[tuple[Piece, int]]]:
        while self.cut and piece.length >= self.size <= self.loss:
            head, piece = piece.split(self.size)
            yield [(head, 0)]
            if piece is None:
                return
        if not self.cut and (piece.length > self.size or piece.loss_tokens() > self.loss):
            raise ValueError(f"{piece.key}: longer than a sequence, and cutting is off")
        self._flagged = self._flagged or piece.loss is not None
        self.waiting.append(piece)
        self._tokens += piece.length
        if len(self.waiting) >= self.window or (self.cut and self._tokens >= self.held):
            yield from self._pack(self.window // 2)

    def finish(self) -> Iterator[list[tuple[Piece, int]]]:
        yield from self._pack(0)

    def _pack(self, leave: int) -> Iterator[list[tuple[Piece, int]]]:
        """Close sequences until no more than ``leave`` pieces and half of ``held`` tokens wait, or what waits fills none."""
        items = self.waiting
        need = np.array([(p.length, 1, p.loss_tokens()) for p in items], float).reshape(-1, 3)
        limits = np.array([self.size, self.segments, self.loss], float)
        share, alive = need / limits**2, np.ones(len(items), bool)
        left, tokens = len(items), float(need[:, 0].sum())
        while (left > leave or (self.cut and left and tokens > self.held // 2)) and not (self.cut and leave and tokens < self.size):
            rest, bin_ = limits.copy(), []
            while left and rest[0] > 0 and rest[1] > 0:
                fits = (need[:, 0] <= rest[0]) & (need[:, 2] <= rest[2]) & alive  # of segments one is left
                score = np.where(fits, share @ rest, -1.0)
                best = int(score.argmax())
                at = self.size - int(rest[0])
                n = 0
                if self.cut and (score[best] < 0 or need[best, 0] * rest[1] < rest[0]):  # or too few segments are left to fill it
                    other, n = self._to_cut(items, need, alive, rest)
                if n and (score[best] < 0 or n > need[best, 0]):
                    piece, items[other] = items[other].split(n)
                    need[other] = (items[other].length, 1, items[other].loss_tokens())
                    share[other] = need[other] / limits**2
                elif score[best] >= 0:
                    piece = items[best]
                    alive[best] = False
                    left -= 1
                else:
                    break
                bin_.append((piece, at))
                rest -= (piece.length, 1, piece.loss_tokens())
            filled = self.size - int(rest[0])
            if self.cut and filled & (filled - 1):  # the size itself may be no power of two
                bin_, back = self._closed(bin_, filled) if rest[0] else (bin_, [])
                if back:
                    items = items + back
                    more = np.array([(p.length, 1, p.loss_tokens()) for p in back], float)
                    need, share = np.concatenate([need, more]), np.concatenate([share, more / limits**2])
                    alive, left = np.append(alive, np.ones(len(back), bool)), left + len(back)
            tokens -= sum(p.length for p, _ in bin_)
            yield bin_
        self.waiting, self._tokens = [p for p, a in zip(items, alive) if a], int(tokens)

    def _closed(self, bin_: list[tuple[Piece, int]], filled: int) -> tuple[list[tuple[Piece, int]], list[Piece]]:
        """The sequence cut at a power of two, and what is behind."""
        size, kept, back = 1 << (filled.bit_length() - 1), [], []
        for p, at in bin_:
            if at + p.length <= size:
                kept.append((p, at))
            elif at >= size:
                back.append(p)
            else:
                head, rest = p.split(size - at)
                kept.append((head, at))
                back.append(rest)
        return kept, back

    def _to_cut(self, items: list[Piece], need: np.ndarray, alive: np.ndarray, rest: np.ndarray) -> tuple[int, int]:
        """The piece whose longest beginning that fits has the largest dot product with what is left, and its length."""
        free = np.maximum(need[:, 0] - need[:, 2], 0)  # of leading tokens, if there are no flags
        fit = np.minimum(np.minimum(rest[0], need[:, 0] - 1), free + rest[2])
        own = fit - np.minimum(free, fit)
        for i in np.flatnonzero(alive & (need[:, 0] > 1)).tolist() if self._flagged else ():
            if items[i].loss is not None:
                fit[i] = min(rest[0], items[i].length - 1, items[i].upto(rest[2]))
                own[i] = items[i].loss_tokens(int(fit[i]))
        score = np.where(alive & (fit > 0), fit * rest[0] / self.size**2 + own * rest[2] / self.loss**2, -1.0)
        best = int(score.argmax())
        return best, int(fit[best]) if score[best] > 0 else 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    kind: str = "word",
    end: int = 1,
    size: int = 2048,
    segments: int = 32,
    loss: int = 1920,
    context: float = 0.125,
    loss_free: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    loss_free: a column with the number of leading tokens of a document that bear no loss (its prompt); without one it is
    the ``context`` part of them, rounded down. sequence_id: the task in the upper bits, the sequence in the lower 33.
    with_ids=False leaves ids null.
    """
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        enc, packer = encoder(tokenizer, kind), Packer(size, segments, loss)
        sequence = TaskContext.get().partitionId() << 33

        def rows(bins):
            nonlocal sequence
            cols = [[] for _ in names]
            for b in bins:
                for p, at in b:
                    doc_id, ids = p.key
                    own = ids[p.start : p.start + p.length]
                    for c, v in zip(cols, (doc_id, p.start, p.length, zlib.crc32(own.tobytes()), len(ids), sequence, at, own.view(np.int32) if with_ids else None)):
                        c.append(v)
                sequence += 1
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            heads = batch.column(2).to_pylist() if loss_free else None
            for a, b in text_slices(texts):
                ids, stops = enc.encode(texts.slice(a, b - a).to_pylist(), end)
                bins, begin = [], 0
                for i, stop in zip(range(a, b), stops):
                    own = ids[begin:stop].copy()  # not a view: a waiting piece would hold the ids of all
                    free = max(heads[i] or 0, 0) if heads else int(context * len(own))
                    bins.extend(packer.add(Piece((keys[i], own), 0, len(own), free=free)))
                    begin = stop
                yield rows(bins)
        yield rows(packer.finish())

    heads = [F.col(loss_free).cast("long")] if loss_free else []
    return docs.select(F.col("doc_id").cast("long"), "text", *heads).mapInArrow(run, SCHEMA)
