"""Thrift's compact protocol, read into plain values: structs are dicts by field id (unknown fields stay there too), maps are pairs."""

from __future__ import annotations

import struct

from lakescan.errors import CorruptFooter

# Type numbers of the compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT, UUID = range(1, 14)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise CorruptFooter(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value
            if shift > 63:
                raise CorruptFooter("varint of more than 64 bits")

    def zigzag(self, bits: int) -> int:
        v = self.varint()
        v = (v >> 1) ^ -(v & 1)
        if not -(1 << (bits - 1)) <= v < 1 << (bits - 1):
            raise CorruptFooter(f"{v} has more than {bits} bits")
        return v

    def value(self, kind: int, depth: int):
        if depth > 64:
            raise CorruptFooter("nested too deep")
        if kind in (TRUE, FALSE):
            return kind == TRUE
        if kind == BYTE:
            return struct.unpack("b", self.take(1))[0]
        if kind in (I16, I32, I64):
            return self.zigzag({I16: 16, I32: 32, I64: 64}[kind])
        if kind == DOUBLE:
            return struct.unpack("<d", self.take(8))[0]
        if kind == BINARY:
            return self.take(self.varint())
        if kind in (LIST, SET):
            head = self.take(1)[0]
            n = self.varint() if head >> 4 == 15 else head >> 4
            of = head & 15
            if n > len(self.data):
                raise CorruptFooter(f"list of {n}")
            if of in (TRUE, FALSE):
                return [self.take(1)[0] == TRUE for _ in range(n)]
            return [self.value(of, depth + 1) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.take(1)[0] if n else 0
            if n > len(self.data):
                raise CorruptFooter(f"map of {n}")
            return [(self.value(kinds >> 4, depth + 1), self.value(kinds & 15, depth + 1)) for _ in range(n)]
        if kind == STRUCT:
            return self.struct(depth + 1)
        if kind == UUID:
            return self.take(16)
        raise CorruptFooter(f"type {kind}")

    def struct(self, depth: int = 0) -> dict[int, object]:
        out, field = {}, 0
        while head := self.take(1)[0]:
            field = field + (head >> 4) if head >> 4 else self.zigzag(16)
            out[field] = self.value(head & 15, depth)
        return out


def fitted(value: dict, kinds: dict) -> dict:
    """A struct without the fields that have another type of value than ``kinds`` says; fields not named there stay."""
    out = {}
    for field, x in value.items():
        kind = kinds.get(field)
        if kind is None:
            out[field] = x
        elif isinstance(kind, list):
            if isinstance(x, list) and all(_has(e, kind[0]) for e in x):
                out[field] = [fitted(e, kind[0]) if isinstance(e, dict) else e for e in x]
        elif _has(x, kind):
            out[field] = fitted(x, kind) if isinstance(x, dict) else x
    return out


def _has(value, kind) -> bool:
    return isinstance(value, dict) if isinstance(kind, dict) else type(value) is kind
