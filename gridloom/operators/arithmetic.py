"""Arithmetic coding with a choice of models: raw bits, static and adaptive bits, static and adaptive symbols.

An interval of 32 bits is narrowed by (a, b, total): the share from a to b of total. A model says which share a symbol has
(``span``), which symbol lies at a place (``find``), and learns (``add``)."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

TOP, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30
MOST = 1 << 16  # largest total, so that every share of the narrowest interval (QUARTER) is a whole number above 0


class StaticSymbols:
    """Fixed probabilities, rounded to whole shares of which every symbol has one at least."""

    def __init__(self, weights: Sequence[float]) -> None:
        whole = sum(weights)
        self.edges = [0]
        for w in weights:
            self.edges.append(self.edges[-1] + max(1, round(w / whole * (MOST - len(weights)))))
        self.total = self.edges[-1]

    def span(self, s: int) -> tuple[int, int]:
        return self.edges[s], self.edges[s + 1]

    def find(self, at: int) -> int:
        low, high = 0, len(self.edges) - 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.edges[mid] <= at else (low, mid)
        return low

    def add(self, s: int) -> None:
        pass


class AdaptiveSymbols:
    """Counts in a binary indexed tree: each symbol seen counts ``step`` more; all counts are halved when their total exceeds MOST."""

    def __init__(self, n: int, step: int = 32) -> None:
        self.counts, self.step = [1] * n, step
        self.top = 1 << (n - 1).bit_length()
        self._build()

    def _build(self) -> None:
        self.total = sum(self.counts)
        self.tree = [0, *self.counts]
        for i in range(1, len(self.tree)):
            up = i + (i & -i)
            if up < len(self.tree):
                self.tree[up] += self.tree[i]

    def span(self, s: int) -> tuple[int, int]:
        i, low = s, 0
        while i:
            low += self.tree[i]
            i &= i - 1
        return low, low + self.counts[s]

    def find(self, at: int) -> int:
        place, step = 0, self.top
        while step:
            if place + step < len(self.tree) and self.tree[place + step] <= at:
                place += step
                at -= self.tree[place]
            step >>= 1
        return place

    def add(self, s: int) -> None:
        self.counts[s] += self.step
        self.total += self.step
        if self.total > MOST:
            self.counts = [(c + 1) // 2 for c in self.counts]
            self._build()
            return
        i = s + 1
        while i < len(self.tree):
            self.tree[i] += self.step
            i += i & -i


class StaticBit(StaticSymbols):
    """A bit that is 0 with a given probability."""

    def __init__(self, zero: float = 0.5) -> None:
        super().__init__([zero, 1 - zero])


class AdaptiveBit(AdaptiveSymbols):
    def __init__(self) -> None:
        super().__init__(2)


def _pack(bits: list[str]) -> bytes:
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


class Encoder:
    def __init__(self) -> None:
        self.low, self.high, self.pending, self.bits = 0, TOP, 0, []

    def _emit(self, bit: int) -> None:
        self.bits.append(str(bit) + str(1 - bit) * self.pending)
        self.pending = 0

    def put(self, a: int, b: int, total: int) -> None:
        width = self.high - self.low + 1
        low, high = self.low + width * a // total, self.low + width * b // total - 1
        while True:
            if high < HALF:
                self._emit(0)
            elif low >= HALF:
                self._emit(1)
                low, high = low - HALF, high - HALF
            elif low >= QUARTER and high < HALF + QUARTER:
                self.pending += 1
                low, high = low - QUARTER, high - QUARTER
            else:
                break
            low, high = low << 1, high << 1 | 1
        self.low, self.high = low, high

    def symbol(self, model, s: int) -> None:
        self.put(*model.span(s), model.total)
        model.add(s)

    def raw(self, value: int, bits: int) -> None:
        """The low ``bits`` of a value, 16 at a time from the lowest."""
        for at in range(0, bits, 16):
            n = min(16, bits - at)
            part = value >> at & (1 << n) - 1
            self.put(part, part + 1, 1 << n)

    def finish(self) -> bytes:
        self.pending += 1
        self._emit(int(self.low >= QUARTER))
        return _pack(self.bits)


class Decoder:
    def __init__(self, code: bytes) -> None:
        self.code, self.at = code, 0
        self.low, self.high, self.value = 0, TOP, 0
        for _ in range(32):
            self.value = self.value << 1 | self._bit()

    def _bit(self) -> int:
        i, self.at = self.at, self.at + 1
        return self.code[i >> 3] >> (7 - (i & 7)) & 1 if i >> 3 < len(self.code) else 0

    def place(self, total: int) -> int:
        return ((self.value - self.low + 1) * total - 1) // (self.high - self.low + 1)

    def take(self, a: int, b: int, total: int) -> None:
        width = self.high - self.low + 1
        low, high, value = self.low + width * a // total, self.low + width * b // total - 1, self.value
        while True:
            if high < HALF:
                shift = 0
            elif low >= HALF:
                shift = HALF
            elif low >= QUARTER and high < HALF + QUARTER:
                shift = QUARTER
            else:
                break
            low, high, value = (low - shift) << 1, (high - shift) << 1 | 1, (value - shift) << 1 | self._bit()
        self.low, self.high, self.value = low, high, value

    def symbol(self, model) -> int:
        s = model.find(self.place(model.total))
        self.take(*model.span(s), model.total)
        model.add(s)
        return s

    def raw(self, bits: int) -> int:
        out = 0
        for at in range(0, bits, 16):
            n = min(16, bits - at)
            part = self.place(1 << n)
            self.take(part, part + 1, 1 << n)
            out |= part << at
        return out


def encode_symbols(data: bytes, weights: Sequence[float] | None = None) -> bytes:
    """Bytes by a static model of given weights (all alike, if none are given); length and CRC-32 go first."""
    coder, model = Encoder(), StaticSymbols(weights or [1.0] * 256)
    for s in data:
        coder.symbol(model, s)
    return len(data).to_bytes(4, "big") + zlib.crc32(data).to_bytes(4, "big") + coder.finish()


def decode_symbols(code: bytes, weights: Sequence[float] | None = None) -> bytes:
    coder, model = Decoder(code[8:]), StaticSymbols(weights or [1.0] * 256)
    out = bytes(coder.symbol(model) for _ in range(int.from_bytes(code[:4], "big")))
    if zlib.crc32(out) != int.from_bytes(code[4:8], "big"):
        raise ValueError("checksum of the decoded bytes is wrong")
    return out


def encode_bits(data: bytes, adaptive: bool = True, zero: float = 0.5) -> bytes:
    """Bytes bit by bit, highest first, each place with a model of its own."""
    coder = Encoder()
    models = [AdaptiveBit() if adaptive else StaticBit(zero) for _ in range(8)]
    for s in data:
        for k in range(8):
            coder.symbol(models[k], s >> (7 - k) & 1)
    return len(data).to_bytes(4, "big") + coder.finish()


def decode_bits(code: bytes, adaptive: bool = True, zero: float = 0.5) -> bytes:
    coder = Decoder(code[4:])
    models = [AdaptiveBit() if adaptive else StaticBit(zero) for _ in range(8)]
    out = bytearray()
    for _ in range(int.from_bytes(code[:4], "big")):
        s = 0
        for k in range(8):
            s = s << 1 | coder.symbol(models[k])
        out.append(s)
    return bytes(out)
