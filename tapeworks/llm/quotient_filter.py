"""Counting quotient filters over packed n-grams of word ids: lossless, sorted, mergeable.

An n-gram's ids are packed into lanes of at most 64 bits. The first lane is permuted by a bijection that takes the other lanes
in, so its values spread evenly; its leading bits are the quotient, and its other bits with the other lanes the remainder,
kept in full: the n-gram can be had back. Entries are sorted, so equal quotients are runs; what is stored of them is one bit
string with a one for each entry and a zero for each step of the quotient, the remainders' bytes, and the counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Layout:
    """How n-grams of ``words`` ids of ``bits`` bits each (1 to 64) are packed."""

    words: int
    bits: int

    @property
    def each(self) -> int:
        return min(self.words, 64 // self.bits)

    @property
    def sizes(self) -> list[int]:
        """Bits of each lane."""
        return [self.bits * min(self.each, self.words - i) for i in range(0, self.words, self.each)]

    @property
    def lead(self) -> int:
        return self.sizes[0]

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """The permuted lanes of n-grams, given the first, second, ... id of each."""
        lanes = []
        for i in range(0, self.words, self.each):
            lane = ids[i].astype(U)
            for x in ids[i + 1 : i + self.each]:
                lane = (lane << U(self.bits)) | x.astype(U)
            lanes.append(lane)
        lanes[0] = self._mix(lanes[0] ^ self._fold(lanes))
        return lanes

    def unpack(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        lanes = [self._unmix(lanes[0]), *lanes[1:]]
        lanes[0] = lanes[0] ^ self._fold(lanes)
        out, mask = [], U(2**self.bits - 1)
        for i in range(self.words):
            lane, place = divmod(i, self.each)
            held = self.sizes[lane] // self.bits
            out.append((lanes[lane] >> U(self.bits * (held - 1 - place))) & mask)
        return out

    def _fold(self, lanes: list[np.ndarray]) -> np.ndarray:
        """A hash of the lanes after the first, of the first one's size."""
        h = np.zeros(len(lanes[0]), U)
        for x in lanes[1:]:
            h = (h ^ x) * U(_FACTORS[0])
            h ^= h >> U(32)
        return h >> U(64 - self.lead)

    def _mix(self, x: np.ndarray) -> np.ndarray:
        mask, half = U(2**self.lead - 1), U(max(1, self.lead // 2))
        for f in _FACTORS:
            x = (x * U(f)) & mask
            x = x ^ (x >> half)
        return x

    def _unmix(self, x: np.ndarray) -> np.ndarray:
        mask, half = U(2**self.lead - 1), max(1, self.lead // 2)
        for f in reversed(_FACTORS):
            was = x
            for _ in range(self.lead // half + 1):
                x = was ^ (x >> U(half))
            x = (x * U(pow(f, -1, 2**64))) & mask
        return x


def sort_unique(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each run of equal entries in it)."""
    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in lanes:
        s = x[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _planes(x: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits, byte by byte of their weight."""
    return b"".join(((x >> U(8 * i)) & U(255)).astype(np.uint8).tobytes() for i in range(-(-bits // 8)))


def _joined(data: memoryview, n: int, bits: int) -> tuple[np.ndarray, memoryview]:
    x = np.zeros(n, U)
    for i in range(-(-bits // 8)):
        x |= np.frombuffer(data[:n], np.uint8).astype(U) << U(8 * i)
        data = data[n:]
    return x, data


def encode(layout: Layout, lanes: list[np.ndarray], counts: np.ndarray, start: int, quotient: int) -> bytes:
    """The filter of sorted, distinct entries whose first lanes lie at or above ``start`` << (lead - quotient); quotient: bits."""
    n, rest = len(counts), layout.lead - quotient
    steps = (lanes[0] >> U(rest)).astype(np.int64) - start
    ones = np.zeros(int(steps[-1]) + n if n else 0, np.uint8)
    ones[steps + np.arange(n)] = 1
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<i8")
    head = np.array([n, start, quotient, len(ones), len(large)], "<i8")
    own = _planes(lanes[0] & U(2**rest - 1), rest) if rest else b""
    others = b"".join(_planes(x, bits) for x, bits in zip(lanes[1:], layout.sizes[1:], strict=True))
    return b"".join((head.tobytes(), np.packbits(ones).tobytes(), small.tobytes(), large.tobytes(), own, others))


def decode(layout: Layout, data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """(lanes, counts) of a filter."""
    data = memoryview(data)
    n, start, quotient, width, more = np.frombuffer(data[:40], "<i8").tolist()
    data, size = data[40:], -(-width // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data[:size], np.uint8), count=width))
    data = data[size:]
    counts = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n : n + 8 * more], "<i8")
    data, rest = data[n + 8 * more :], layout.lead - quotient
    lead = (ones - np.arange(n) + start).astype(U) << U(rest)
    if rest:
        low, data = _joined(data, n, rest)
        lead |= low
    lanes = [lead]
    for bits in layout.sizes[1:]:
        x, data = _joined(data, n, bits)
        lanes.append(x)
    return lanes, counts
