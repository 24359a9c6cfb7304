"""Elias-Fano coding of non-decreasing integers, and files of token ids whose document boundaries are coded so.

n values of at most u take about n * (2 + log2(u / n)) bits: the low bits of each in a packed array, the high bits in
unary in a bit vector whose i-th one stands at high_i + i. ``select`` finds that one through a 32-bit sample of every 256th
and popcounts from there on; no table of 64-bit offsets is kept."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256


class EliasFano:
    """Non-decreasing integers from 0."""

    head = struct.Struct("<QQB")

    def __init__(self, n: int, top: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.samples = n, top, low_bits, np.frombuffer(low, np.uint8), samples
        self.words = np.frombuffer(high, "<u8")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = np.empty((n, low_bits), np.uint8)  # a byte a bit at most, plane by plane
        for b in range(low_bits):
            bits[:, b] = values >> np.uint64(b) & np.uint64(1)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(-(-(n + (top >> low_bits) + 1) // 64) * 64, np.uint8)
        vector[ones] = 1
        return cls(n, top, low_bits, low, np.packbits(vector, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.head.pack(self.n, self.top, self.low_bits) + self.low.tobytes() + self.words.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The coded integers at a place, and the place behind them."""
        n, top, low_bits = cls.head.unpack_from(data, at)
        a = at + cls.head.size
        b = a + -(-n * low_bits // 8)
        c = b + -(-(n + (top >> low_bits) + 1) // 64) * 8
        d = c + -(-n // SAMPLE) * 4
        return cls(n, top, low_bits, data[a:b], data[b:c], np.frombuffer(data[c:d], "<u4")), d

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little")
        return word >> a % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, todo = int(self.samples[i // SAMPLE]), i % SAMPLE  # a one's place, and how many ones to go
        w = at // 64
        word = int(self.words[w]) >> at % 64 << at % 64
        while (ones := word.bit_count()) <= todo:
            todo, w = todo - ones, w + 1
            word = int(self.words[w])
        for _ in range(todo):
            word &= word - 1
        place = w * 64 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All of them, in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        for b in range(self.low_bits):
            high |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return high


class IdFile:
    """A file of documents: magic, id width in bytes, how many documents have a null id (they come first), the smallest id,
    then Elias-Fano coded ids less that smallest one, Elias-Fano coded ends of the documents, and all token ids."""

    MAGIC = b"TWIDS\x001\n"
    head = struct.Struct("<BQq")

    def __init__(self, data: bytes):
        if data[: len(self.MAGIC)] != self.MAGIC:
            raise ValueError("not a token-id file")
        at = len(self.MAGIC)
        width, self.nulls, self.least = self.head.unpack_from(data, at)
        self.keys, at = EliasFano.from_bytes(data, at + self.head.size)
        self.ends, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", offset=at)

    @classmethod
    def build(cls, keys: list[int | None], documents: list[np.ndarray], width: int) -> bytes:
        """keys: ascending, nulls first."""
        real = np.array([k for k in keys if k is not None], np.int64)
        least = int(real[0]) if len(real) else 0
        ends = np.cumsum([len(x) for x in documents], dtype=np.int64)
        body = np.concatenate(documents).astype(f"<u{width}").tobytes() if documents else b""
        # differences of signed 64-bit ids fit unsigned ones
        coded = EliasFano.encode(real.view(np.uint64) - np.int64(least).view(np.uint64)) if len(real) else EliasFano.encode(real)
        head = cls.MAGIC + cls.head.pack(width, len(keys) - len(real), least)
        return head + coded.to_bytes() + EliasFano.encode(ends).to_bytes() + body

    def __len__(self) -> int:
        return self.ends.n

    def key(self, i: int) -> int | None:
        if i < self.nulls:
            return None
        value = (self.keys.select(i - self.nulls) + self.least) % (1 << 64)
        return value - (1 << 64) if value >> 63 else value

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]
