"""The arithmetic coder over many byte strings at once: a string is a lane, and a numpy step codes one symbol of every lane.

Codes are byte for byte those of ``arithmetic`` and ``codecs``. Emitted and pending bits are the top of one whole number
A, the sum of the shares' starts, each shifted by all later shifts; the code is (A >> 30) + 1. So a lane keeps the low 31 bits of A
(``low``), some bits above (``top``, of which ``held`` are not yet written) and the interval's width; carries into written
digits are added at the end."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np

from gridloom.operators.arithmetic import MOST, StaticBit, StaticSymbols

# Whole numbers of numpy, which it takes faster than Python's.
M31, M32, M63, M31_BITS, TOP_BIT, BIAS = (np.int64(x) for x in ((1 << 31) - 1, (1 << 32) - 1, (1 << 63) - 1, 31, 63, 1054))
ONE, EXPONENT = np.int64(1), np.int64(52)
SHIFT = 18  # the most that an interval is shifted at once: it is wider than QUARTER, and a share is 1 of about MOST at least
LANES, BYTES = 1 << 14, 1 << 25  # most strings and bytes coded together (more bytes only for a single string)
STEP = 32.0  # what AdaptiveSymbols adds by default


def _shift(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """How far the interval is shifted until it holds the middle and more than a quarter: the equal leading bits, then the places where low has 1 and high 0."""
    x = low + width
    x -= ONE
    x ^= low
    y = low & x
    y += y
    x ^= y
    e = x.astype(np.float64).view(np.int64)
    e >>= EXPONENT
    return np.subtract(BIAS, e, out=e)


class LaneEncoder:
    def __init__(self, n: int) -> None:
        self.all = [np.zeros(n, np.int64), np.full(n, 1 << 32, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)]
        self.lane, self.digit, self.used, self.full = np.empty(1 << 16, np.uint16), np.empty(1 << 16, np.int64), 0, []
        self.keep(n)

    def keep(self, m: int) -> None:
        """From now on only the first m lanes go on."""
        self.low, self.width, self.top, self.held = (a[:m] for a in self.all)

    def _write(self, lanes: np.ndarray, digits: np.ndarray) -> None:
        if self.used + len(lanes) > len(self.lane):
            self.full.append((self.lane[: self.used], self.digit[: self.used]))
            size = max(1 << 20, len(lanes))
            self.lane, self.digit, self.used = np.empty(size, np.uint16), np.empty(size, np.int64), 0
        at = slice(self.used, self.used + len(lanes))
        self.lane[at], self.digit[at], self.used = lanes, digits, at.stop

    def _flush(self) -> None:
        """A digit of 32 bits, and maybe a carry, of every lane that holds as much."""
        ready = (self.held > 31).nonzero()[0]
        top, held = self.top[ready], self.held[ready]
        held -= 32
        digits = top >> held
        self.held[ready] = held
        self.top[ready] = top - (digits << held)
        self._write(ready, digits)

    def put(self, start: np.ndarray, width: np.ndarray) -> None:
        """Narrows every lane's interval to a share of it, given by start and width; start is used up."""
        start += self.low
        shift = _shift(start, width)
        start <<= shift
        np.bitwise_and(start, M31, out=self.low)
        np.left_shift(width, shift, out=self.width)
        start >>= M31_BITS
        self.top <<= shift
        self.top += start
        self.held += shift
        if self.held.max() > 63 - 1 - SHIFT:
            self._flush()

    def finish(self) -> list[bytes]:
        n = len(self.all[0])
        self.keep(n)
        self._flush()
        last = ((self.top << 1 | self.low >> 30) + 1) << (32 - self.held)  # 33 bits
        self._write(np.arange(n), last >> 1)
        self._write(np.arange(n), (last & 1) << 31)
        self.full.append((self.lane[: self.used], self.digit[: self.used]))
        lane, digit = (np.concatenate(x) for x in zip(*self.full, strict=True))
        digit = digit[np.argsort(lane, kind="stable")]
        while (carry := digit >> 32).any():  # a lane's first digit never has one
            digit &= M32
            digit[:-1] += carry[1:]
        code, sizes = digit.astype(">u4").tobytes(), np.bincount(lane, minlength=n) * 4
        ends = np.cumsum(sizes)
        stops = ends - 8 + (self.held + 8 >> 3)
        return [code[a:b] for a, b in zip((ends - sizes).tolist(), stops.tolist(), strict=True)]


class LaneDecoder:
    def __init__(self, codes: Sequence[bytes]) -> None:
        sizes = np.array([len(c) // 4 + 2 for c in codes])
        self.words = np.frombuffer(b"".join([c.ljust(4 * n, b"\0") for c, n in zip(codes, sizes.tolist(), strict=True)]), ">u4").astype(np.int64)
        ends, n = np.cumsum(sizes), len(codes)
        # low bits, width, the value less low, 63 bits to come (the highest first), how many of them are read, the next word, the last word (zero, for ever)
        self.all = [np.zeros(n, np.int64), np.full(n, 1 << 32, np.int64), self.words[ends - sizes], np.zeros(n, np.int64), np.zeros(n, np.int64), ends - sizes + 1, ends - 1]
        self.keep(n)
        self._fill()

    def keep(self, m: int) -> None:
        self.low, self.width, self.value, self.bits, self.left, self.word, self.end = (a[:m] for a in self.all)

    def _fill(self) -> None:
        ready = (self.left < 32).nonzero()[0]
        word, left = self.word[ready], self.left[ready]
        self.bits[ready] |= self.words[np.minimum(word, self.end[ready])] << 31 - left
        self.left[ready] = left + 32
        self.word[ready] = word + 1

    def take(self, start: np.ndarray, width: np.ndarray) -> None:
        self.value -= start
        start += self.low
        shift = _shift(start, width)
        start <<= shift
        np.bitwise_and(start, M31, out=self.low)
        np.left_shift(width, shift, out=self.width)
        self.value <<= shift
        self.left -= shift
        np.subtract(TOP_BIT, shift, out=start)
        np.right_shift(self.bits, start, out=start)
        self.value |= start
        self.bits <<= shift
        self.bits &= M63
        if self.left.min() < SHIFT:
            self._fill()


def _steps(sizes: np.ndarray):
    """Of falling sizes: each place with the number of lanes that have it."""
    ends = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left") if len(sizes) else []
    return enumerate(np.asarray(ends).tolist())


STEP_BITS = np.float64(STEP).view(np.int64)
PLACES = np.arange(7, -1, -1)[:, None]


class _Bits:
    """Eight models of a bit for every lane, one a place of the byte: counts of zeros and totals."""

    def __init__(self, n: int, adaptive: bool, zero: float) -> None:
        self.adaptive, model = adaptive, StaticBit(zero)
        self.zeros = np.full((8, n), 1.0 if adaptive else float(model.edges[1]))
        self.total = np.full((8, n), 2.0 if adaptive else float(model.total))
        self.most = 2.0 if adaptive else 0.0

    def keep(self, m: int) -> None:
        self.rows = [(self.zeros[k, :m], self.total[k, :m]) for k in range(8)]
        self.live = self.zeros[:, :m], self.total[:, :m]

    def share(self, k: int, width: np.ndarray) -> np.ndarray:
        """How much of the width a 0 has."""
        zeros, total = self.rows[k]
        part = width.astype(np.float64)
        part *= zeros
        part /= total
        return part.astype(np.int64)

    def add(self, ones: np.ndarray) -> None:
        """A byte of every lane, as -1 for a 1 by place. The largest total is known or overrated, so that totals are seldom looked at."""
        if not self.adaptive:
            return
        zeros, total = self.live
        zeros += (~ones & STEP_BITS).view(np.float64)
        total += STEP
        self.most += STEP
        if self.most > MOST:
            over = total > MOST
            ones = (total[over] - zeros[over] + 1) // 2
            zeros[over] = (zeros[over] + 1) // 2
            total[over] = zeros[over] + ones
            self.most = float(total.max())


def _narrow(share: np.ndarray, ones: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Width of the interval's part below the share, or above it for ones; share becomes that part's start."""
    rest = width - share
    rest ^= share
    rest &= ones
    rest ^= share
    share &= ones
    return rest


def encode_bits(data: Sequence[bytes], adaptive: bool = True, zero: float = 0.5) -> list[bytes]:
    """``arithmetic.encode_bits`` of every string; strings by falling length."""
    sizes = np.array([len(b) for b in data])
    flat, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes
    coder, model, m = LaneEncoder(len(data)), _Bits(len(data), adaptive, zero), -1
    for _, lanes in _steps(sizes):
        if lanes != m:
            m = lanes
            coder.keep(m)
            model.keep(m)
            at = at[:m]
        ones = flat[at].astype(np.int64) >> PLACES
        ones &= ONE
        np.negative(ones, out=ones)
        at += 1
        for k in range(8):
            share = model.share(k, coder.width)
            coder.put(share, _narrow(share, ones[k], coder.width))
        model.add(ones)
    return [n.to_bytes(4, "big") + c for n, c in zip(sizes.tolist(), coder.finish(), strict=True)]


def decode_bits(codes: Sequence[bytes], adaptive: bool = True, zero: float = 0.5) -> list[bytes]:
    """``arithmetic.decode_bits`` of every code; codes by falling length of their strings."""
    sizes = np.array([int.from_bytes(c[:4], "big") for c in codes])
    at, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.uint8)
    starts = at.tolist()
    coder, model, m = LaneDecoder([c[4:] for c in codes]), _Bits(len(codes), adaptive, zero), -1
    for _, lanes in _steps(sizes):
        if lanes != m:
            m = lanes
            coder.keep(m)
            model.keep(m)
            at = at[:m]
            ones = np.empty((8, m), np.int64)
        for k in range(8):
            share, one = model.share(k, coder.width), ones[k]
            np.less_equal(share, coder.value, out=one, casting="unsafe")
            np.negative(one, out=one)
            coder.take(share, _narrow(share, one, coder.width))
        out[at] = np.packbits(ones.view(bool)[:, ::8], axis=0)[0]
        at += 1
        model.add(ones)
    whole = out.tobytes()
    return [whole[a : a + n] for a, n in zip(starts, sizes.tolist(), strict=True)]


def _slice(total: np.ndarray | np.float64, width: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of the part of a width that the places from low on, count of them, have of total."""
    unit = width.astype(np.float64)
    start = unit * low
    start /= total
    start = start.astype(np.int64)
    unit *= low + count
    unit /= total
    end = unit.astype(np.int64)
    end -= start
    return start, end


def _place(value: np.ndarray, total: np.ndarray | np.float64, width: np.ndarray) -> np.ndarray:
    """The place below total at which a value of the interval lies."""
    at = (value + ONE).astype(np.float64)
    at *= total
    at -= 1.0
    at /= width
    return at.astype(np.int64)


class _Static:
    """One static model of bytes for all lanes."""

    def __init__(self, weights: Sequence[float] | None) -> None:
        edges = np.array(StaticSymbols(weights or [1.0] * 256).edges)
        self.low, self.count, self.total = edges[:-1].astype(np.float64), np.diff(edges).astype(np.float64), np.float64(edges[-1])
        self.symbols = np.repeat(np.arange(len(edges) - 1, dtype=np.uint8), np.diff(edges))

    def keep(self, m: int) -> None:
        pass

    def pick(self, before: np.ndarray) -> np.float64:
        return self.total

    def span(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.low[s], self.count[s]

    def find(self, at: np.ndarray) -> np.ndarray:
        return self.symbols[at].astype(np.int64)

    def add(self, s: np.ndarray) -> None:
        pass


class _Adaptive:
    """Adaptive models of bytes, some for every lane. Counts stand in groups of 16; running sums before each group and, within it, each symbol."""

    AFTER = np.where(np.arange(16)[:, None] < np.arange(16), int(STEP), 0).astype(np.uint16)

    def __init__(self, n: int, models: int) -> None:
        self.models = models
        self.counts = np.ones((n * models, 256), np.uint16)  # 16 bits do: the other symbols have one at least
        self.total = np.full(n * models, 256, np.int32)
        self.groups, self.within = np.empty((n * models, 16), np.int32), np.empty((n * models * 16, 16), np.uint16)
        self.groups[:], self.within[:] = np.arange(0, 256, 16), np.arange(16)
        self.flat, self.most = self.counts.reshape(-1), 256

    def keep(self, m: int) -> None:
        self.base = np.arange(m) * self.models

    def pick(self, before: np.ndarray) -> np.ndarray:
        """The models after these bytes, and their totals."""
        self.row = self.base + (before & self.models - 1)
        self.totals = self.total.take(self.row)
        self.group = self.groups.take(self.row, axis=0)
        return self.totals

    def _within(self, g: np.ndarray) -> np.ndarray:
        self.at = (self.row << 4) + g
        self.inner = self.within.take(self.at, axis=0)
        self.g = g
        return self.inner

    def span(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, lane = s >> 4, np.arange(len(s)) << 4
        low = self.group.reshape(-1).take(lane + g)
        low += self._within(g).reshape(-1).take(lane + (s & 15))
        self.cell = (self.row << 8) + s
        self.count = self.flat.take(self.cell)
        return low, self.count

    def find(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int32)
        g = _below(self.group, at)
        low = self.group.reshape(-1).take((np.arange(len(at)) << 4) + g)
        inside = self._within(g)
        return (g << 4) + _below(inside, at - low)

    def add(self, s: np.ndarray) -> None:
        self.flat[self.cell] = self.count + np.int32(STEP)
        self.group += self.AFTER.take(self.g, axis=0)
        self.groups[self.row] = self.group
        self.inner += self.AFTER.take(s & 15, axis=0)
        self.within[self.at] = self.inner
        self.totals += np.int32(STEP)
        self.total[self.row] = self.totals
        self.most += int(STEP)
        if self.most > MOST:
            over = self.row[self.totals > MOST]
            counts = (self.counts[over] + 1) // 2
            self.counts[over] = counts
            by_group = counts.reshape(-1, 16, 16)
            sums = np.cumsum(by_group, axis=2, dtype=np.int32)
            self.within.reshape(-1, 16, 16)[over] = sums - by_group
            whole = sums[:, :, -1]
            ends = np.cumsum(whole, axis=1, dtype=np.int32)
            self.groups[over], self.total[over] = ends - whole, ends[:, -1]
            self.most = int(self.total.max())


def _below(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last of 16 rising sums that is not above: the bools of a row are counted as bits of two words."""
    n = np.bitwise_count((sums <= at[:, None]).view(np.uint64))
    return (n[:, 0] + n[:, 1]).astype(np.int64) - ONE


def _encode(data: Sequence[bytes], sizes: np.ndarray, model: _Static | _Adaptive) -> list[bytes]:
    flat, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes
    coder, m, s = LaneEncoder(len(data)), -1, np.zeros(len(data), np.int64)
    for _, lanes in _steps(sizes):
        if lanes != m:
            m = lanes
            coder.keep(m)
            model.keep(m)
            at, s = at[:m], s[:m]
        total = model.pick(s)
        s = flat[at].astype(np.int64)
        at += 1
        coder.put(*_slice(total, coder.width, *model.span(s)))
        model.add(s)
    return coder.finish()


def _decode(codes: Sequence[bytes], sizes: np.ndarray, checks: Sequence[int], model: _Static | _Adaptive) -> list[bytes]:
    at, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.uint8)
    starts = at.tolist()
    coder, m, s = LaneDecoder(codes), -1, np.zeros(len(codes), np.int64)
    for _, lanes in _steps(sizes):
        if lanes != m:
            m = lanes
            coder.keep(m)
            model.keep(m)
            at, s = at[:m], s[:m]
        total = model.pick(s)
        s = model.find(_place(coder.value, total, coder.width))
        coder.take(*_slice(total, coder.width, *model.span(s)))
        model.add(s)
        out[at] = s
        at += 1
    whole = out.tobytes()
    found = [whole[a : a + n] for a, n in zip(starts, sizes.tolist(), strict=True)]
    if any(zlib.crc32(b) != c for b, c in zip(found, checks, strict=True)):
        raise ValueError("checksum of the decoded bytes is wrong")
    return found


def encode_symbols(data: Sequence[bytes], weights: Sequence[float] | None = None) -> list[bytes]:
    """``arithmetic.encode_symbols`` of every string; strings by falling length."""
    codes = _encode(data, np.array([len(b) for b in data]), _Static(weights))
    return [len(b).to_bytes(4, "big") + zlib.crc32(b).to_bytes(4, "big") + c for b, c in zip(data, codes, strict=True)]


def decode_symbols(codes: Sequence[bytes], weights: Sequence[float] | None = None) -> list[bytes]:
    sizes = np.array([int.from_bytes(c[:4], "big") for c in codes])
    return _decode([c[8:] for c in codes], sizes, [int.from_bytes(c[4:8], "big") for c in codes], _Static(weights))


def encode_bytes(data: Sequence[bytes], models: int = 1) -> list[bytes]:
    """``codecs.arithmetic_encode`` of every string; strings by falling length."""
    codes = _encode(data, np.array([len(b) for b in data]), _Adaptive(len(data), models))
    return [struct.pack(">IIB", len(b), zlib.crc32(b), models) + c for b, c in zip(data, codes, strict=True)]


def decode_bytes(codes: Sequence[bytes]) -> list[bytes]:
    heads = [struct.unpack(">IIB", c[:9]) for c in codes]
    out = [b""] * len(codes)
    for models in {h[2] for h in heads}:
        same = [i for i, h in enumerate(heads) if h[2] == models]
        found = _decode([codes[i][9:] for i in same], np.array([heads[i][0] for i in same]), [heads[i][1] for i in same], _Adaptive(len(same), models))
        for i, b in zip(same, found, strict=True):
            out[i] = b
    return out


def apply(run: Callable[[Sequence[bytes]], list[bytes]], one: Callable[[bytes], bytes], data: Sequence[bytes | None], size: Callable[[bytes], int], step: float) -> list[bytes | None]:
    """``run`` over all strings that are not null, by falling size and a bounded part at a time.

    A numpy step costs as much as ``step`` symbols coded one by one, so the few longest strings go to ``one`` where that is cheaper."""
    out: list[bytes | None] = [None] * len(data)
    sizes = {i: size(b) for i, b in enumerate(data) if b is not None}
    order = sorted(sizes, key=sizes.get, reverse=True)
    n = max(-(-len(order) // LANES), -(-sum(sizes.values()) // BYTES))
    for part in (order[k::n] for k in range(n)):  # each has its share of the long ones
        length = np.array([sizes[i] for i in part] + [0], dtype=np.float64)
        alone = int(np.argmin(np.cumsum(length) - length + step * length))
        for i in part[:alone]:
            out[i] = one(data[i])
        if part[alone:]:
            for i, b in zip(part[alone:], run([data[i] for i in part[alone:]]), strict=True):
                out[i] = b
    return out
