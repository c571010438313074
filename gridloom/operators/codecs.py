"""Lossless codecs on byte strings, as Python functions and as Arrow-batched columns (``encode`` / ``decode``).

The run-length code follows the documented byte format; the others keep the method and round-trip exactly but use
layouts of their own (a one-byte parameter or table, then a bit string, most significant bit first)."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import lanes
from gridloom.operators.arithmetic import AdaptiveSymbols, Decoder, Encoder, decode_bits, decode_symbols, encode_bits, encode_symbols


# run lengths
def rle_encode(data: bytes) -> bytes:
    """First the marker (the rarest byte); then runs: up to three literally, longer ones as marker, length - 1 in one or two bytes, symbol."""
    if not data:
        return b""
    n = Counter(data)
    marker = min(range(256), key=lambda b: (n[b], b))
    out = bytearray([marker])
    i = 0
    while i < len(data):
        j = i
        while j < len(data) and data[j] == data[i] and j - i < 32768:
            j += 1
        symbol, count = data[i], j - i
        i = j
        if count <= 3:
            out += bytes([marker, count - 1]) if symbol == marker else bytes([symbol]) * count
        else:
            c = count - 1
            out += bytes([marker]) + (bytes([c >> 8 | 0x80]) if c >= 128 else b"") + bytes([c & 255, symbol])
    return bytes(out)


def rle_decode(code: bytes) -> bytes:
    if not code:
        return b""
    marker, out, i = code[0], bytearray(), 1
    while i < len(code):
        if code[i] != marker:
            out.append(code[i])
            i += 1
            continue
        c = code[i + 1]
        if c <= 2:
            out += bytes([marker]) * (c + 1)
            i += 2
        else:
            if c & 0x80:
                c, i = (c & 0x7F) << 8 | code[i + 2], i + 1
            out += bytes([code[i + 2]]) * (c + 1)
            i += 3
    return bytes(out)


def _pack(bits: list[str]) -> bytes:
    s = "".join(bits)
    s += "0" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big") if s else b""


def _unpack(data: bytes) -> str:
    return bin(int.from_bytes(b"\1" + data, "big"))[3:]


# prefix codes: the table is kept as each symbol's code length, and codes are assigned in order of (length, symbol)
def huffman_lengths(n: dict[int, int]) -> dict[int, int]:
    heap = [(c, s, (s,)) for s, c in sorted(n.items())]
    heapq.heapify(heap)
    depth = dict.fromkeys(n, 0)
    tick = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
        tick += 1
    return {s: max(1, d) for s, d in depth.items()}


def shannon_fano_lengths(n: dict[int, int]) -> dict[int, int]:
    """Symbols by falling count are cut in two where the halves are most equal, again and again."""
    out: dict[int, int] = {}
    todo = [(sorted(n, key=lambda s: (-n[s], s)), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            out[group[0]] = max(1, depth)
            continue
        total, run, best = sum(n[s] for s in group), 0, (float("inf"), 1)
        for i, s in enumerate(group[:-1], 1):
            run += n[s]
            best = min(best, (abs(total - 2 * run), i))
        todo += [(group[: best[1]], depth + 1), (group[best[1] :], depth + 1)]
    return out


def _codes(lengths: dict[int, int]) -> dict[int, str]:
    code, last, out = 0, 0, {}
    for size, s in sorted((v, k) for k, v in lengths.items()):
        code <<= size - last
        out[s], last = format(code, f"0{size}b"), size
        code += 1
    return out


def _prefix_encode(data: bytes, lengths_of: Callable[[dict[int, int]], dict[int, int]]) -> bytes:
    if not data:
        return b""
    lengths = lengths_of(Counter(data))
    codes = _codes(lengths)
    return struct.pack(">I", len(data)) + bytes(lengths.get(s, 0) for s in range(256)) + _pack([codes[b] for b in data])


def _prefix_decode(code: bytes) -> bytes:
    if not code:
        return b""
    (n,) = struct.unpack(">I", code[:4])
    symbols = {c: s for s, c in _codes({s: v for s, v in enumerate(code[4:260]) if v}).items()}
    out, word = bytearray(), ""
    for bit in _unpack(code[260:]):
        word += bit
        if word in symbols:
            out.append(symbols[word])
            word = ""
            if len(out) == n:
                break
    return bytes(out)


def huffman_encode(data: bytes) -> bytes:
    return _prefix_encode(data, huffman_lengths)


def shannon_fano_encode(data: bytes) -> bytes:
    return _prefix_encode(data, shannon_fano_lengths)


# Rice: the parameter follows the mean bit length of the last 16 words
HISTORY, ESCAPE = 16, 8


def _rice_parameters(bits: list[int]) -> Iterator[int]:
    first = bits[:HISTORY]
    start = max(1, (sum(first) + len(first) // 2) // len(first))
    for i in range(len(bits)):
        yield start if i < HISTORY else (sum(bits[i - HISTORY : i]) + HISTORY // 2) // HISTORY


def rice_encode(data: bytes) -> bytes:
    if not data:
        return b""
    bits = [b.bit_length() for b in data]
    out = []
    for b, k in zip(data, _rice_parameters(bits), strict=True):
        q = b >> k
        if q < ESCAPE:
            out.append("1" * q + "0")
        else:
            r = q - ESCAPE
            out.append("1" * (ESCAPE + r.bit_length()) + "0" + (bin(r)[3:] if r else ""))
        out.append(format(b & (1 << k) - 1, f"0{k}b") if k else "")
    first = bits[:HISTORY]
    return struct.pack(">IB", len(data), max(1, (sum(first) + len(first) // 2) // len(first))) + _pack(out)


def rice_decode(code: bytes) -> bytes:
    if not code:
        return b""
    n, start = struct.unpack(">IB", code[:5])
    bits, at, out, seen = _unpack(code[5:]), 0, bytearray(), []
    for i in range(n):
        k = start if i < HISTORY else (sum(seen[-HISTORY:]) + HISTORY // 2) // HISTORY
        end = bits.index("0", at)
        q, at = end - at, end + 1
        if q >= ESCAPE:
            size = q - ESCAPE
            q = ESCAPE
            if size:
                q += int("1" + bits[at : at + size - 1], 2)
                at += size - 1
        b = q << k | (int(bits[at : at + k], 2) if k else 0)
        at += k
        out.append(b)
        seen.append(b.bit_length())
    return bytes(out)


# LZ77 with a table of the last places of three-byte strings, or by trying all offsets
def _varint(x: int) -> bytes:
    out = [x & 127]
    while x := x >> 7:
        out.append(x & 127 | 128)
    return bytes(reversed(out))


def _read_varint(code: bytes, at: int) -> tuple[int, int]:
    x = 0
    while True:
        b = code[at]
        x, at = x << 7 | b & 127, at + 1
        if not b & 128:
            return x, at


def _match(data: bytes, a: int, b: int) -> int:
    n = 0
    while b + n < len(data) and data[a + n] == data[b + n]:
        n += 1
    return n


def lz_encode(data: bytes, fast: bool = True, window: int = 100_000) -> bytes:
    """Marker byte, then literals (the marker doubled as marker, 0) and marker, length, offset in seven-bit groups."""
    if not data:
        return b""
    n = Counter(data)
    marker = min(range(256), key=lambda b: (n[b], b))
    out, places, i = bytearray([marker]), {}, 0

    def note(a: int, b: int) -> None:
        for p in range(a, min(b, len(data) - 2)):
            places.setdefault(data[p : p + 3], []).append(p)

    while i < len(data):
        if fast:
            near = [p for p in places.get(data[i : i + 3], [])[-32:] if i - p <= window]
        else:
            near = range(max(0, i - window), i)
        best = max(((_match(data, p, i), p) for p in near), default=(0, 0))
        cost = 1 + len(_varint(best[0])) + len(_varint(i - best[1]))
        step = best[0] if best[0] > cost else 1
        if best[0] > cost:
            out += bytes([marker]) + _varint(best[0]) + _varint(i - best[1])
        else:
            out += bytes([marker, 0]) if data[i] == marker else data[i : i + 1]
        note(i, i + step)
        i += step
    return bytes(out)


def lz_decode(code: bytes) -> bytes:
    if not code:
        return b""
    marker, out, i = code[0], bytearray(), 1
    while i < len(code):
        if code[i] != marker:
            out.append(code[i])
            i += 1
            continue
        length, i = _read_varint(code, i + 1)
        if length == 0:
            out.append(marker)
            continue
        offset, i = _read_varint(code, i)
        for _ in range(length):
            out.append(out[-offset])
    return bytes(out)


def arithmetic_encode(data: bytes, models: int = 1) -> bytes:
    """Interval coding with ``models`` adaptive byte models (a power of two) picked by the byte before; length and CRC-32 go first."""
    table = [AdaptiveSymbols(256) for _ in range(models)]
    coder, before = Encoder(), 0
    for s in data:
        coder.symbol(table[before & models - 1], s)
        before = s
    return struct.pack(">IIB", len(data), zlib.crc32(data), models) + coder.finish()


def arithmetic_decode(code: bytes) -> bytes:
    n, crc, models = struct.unpack(">IIB", code[:9])
    table = [AdaptiveSymbols(256) for _ in range(models)]
    coder, out, before = Decoder(code[9:]), bytearray(), 0
    for _ in range(n):
        before = coder.symbol(table[before & models - 1])
        out.append(before)
    if zlib.crc32(out) != crc:
        raise ValueError("checksum of the decoded bytes is wrong")
    return bytes(out)


# reversible wavelet: pairs to means and differences, differences less a prediction from neighbouring means
def _prediction(low: np.ndarray, nh: int) -> np.ndarray:
    d = np.zeros(nh, dtype=np.int64)
    if len(low) > 1:
        d[0] = (low[0] - low[1]) >> 2
        for i in range(1, nh):
            d[i] = (low[i - 1] - low[min(i + 1, len(low) - 1)] + 2) >> 2
    return d


def wavelet_forward(x: np.ndarray, levels: int = 6) -> list[np.ndarray]:
    """Low band, then the high bands from the coarsest; whole numbers, exactly reversible."""
    bands, low = [], np.asarray(x, dtype=np.int64)
    for _ in range(levels):
        if len(low) < 4:
            break
        even, odd = low[0::2], low[1::2]
        mean = even.copy()
        mean[: len(odd)] = (even[: len(odd)] + odd) >> 1
        bands.append(even[: len(odd)] - odd - _prediction(mean, len(odd)))
        low = mean
    return [low, *reversed(bands)]


def wavelet_inverse(bands: list[np.ndarray]) -> np.ndarray:
    low = bands[0]
    for high in bands[1:]:
        diff = high + _prediction(low, len(high))
        even = low.copy()
        even[: len(high)] = low[: len(high)] + ((diff + 1) >> 1)
        out = np.empty(len(low) + len(high), dtype=np.int64)
        out[0::2], out[1::2] = even, even[: len(high)] - diff
        low = out
    return low


# How much of the context stays, and what a coefficient's bit length adds to it.
STAYS, ADDS = 0.9, 0.2
CONTEXTS = 16


def contexts(sizes: Sequence[int]) -> list[float]:
    """The context before each of a sequence of bit lengths: a running mean that fades by STAYS and takes ADDS of each."""
    out, context = [], 0.0
    for n in sizes:
        out.append(context)
        context = STAYS * context + ADDS * n
    return out


def _wave_parts(data: bytes) -> tuple[int, np.ndarray] | None:
    """Channels and samples of a 16-bit RIFF file with a 44-byte header; None for anything else."""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE" or struct.unpack_from("<H", data, 34)[0] != 16:
        return None
    channels = struct.unpack_from("<H", data, 22)[0]
    if not channels:
        return None
    frames = (len(data) - 44) // (2 * channels)
    return channels, np.frombuffer(data, "<i2", frames * channels, 44).astype(np.int64).reshape(frames, channels)


def wav_encode(data: bytes) -> bytes:
    """A 16-bit wave file by channel: wavelet coefficients as bit length (an adaptive model picked by the fading mean of lengths before), sign and raw bits. Header and odd ends, and files of another kind, as plain bytes."""
    parts = _wave_parts(data)
    if parts is None:
        return b"\0" + arithmetic_encode(data)
    channels, samples = parts
    end = 44 + samples.size * 2
    coder = Encoder()
    for c in range(channels):
        models, context = [AdaptiveSymbols(40) for _ in range(CONTEXTS)], 0.0
        for v in np.concatenate(wavelet_forward(samples[:, c])).tolist():
            n = abs(v).bit_length()
            coder.symbol(models[min(CONTEXTS - 1, int(context))], n)
            if n:
                coder.raw(v < 0, 1)
                coder.raw(abs(v), n - 1)  # the highest bit is known
            context = STAYS * context + ADDS * n
    rest = data[end:]
    return b"\1" + data[:44] + struct.pack(">II", len(samples), len(rest)) + rest + coder.finish()


def wav_decode(code: bytes) -> bytes:
    if code[:1] == b"\0":
        return arithmetic_decode(code[1:])
    header = code[1:45]
    frames, n_rest = struct.unpack_from(">II", code, 45)
    channels = struct.unpack_from("<H", header, 22)[0]
    coder = Decoder(code[53 + n_rest :])
    samples = np.zeros((frames, channels), dtype=np.int64)
    for c in range(channels):
        models, context, found = [AdaptiveSymbols(40) for _ in range(CONTEXTS)], 0.0, []
        for _ in range(frames):
            n = coder.symbol(models[min(CONTEXTS - 1, int(context))])
            negative = coder.raw(1) if n else 0
            size = coder.raw(n - 1) | 1 << n - 1 if n else 0
            found.append(-size if negative else size)
            context = STAYS * context + ADDS * n
        shapes = [len(b) for b in wavelet_forward(np.zeros(frames))]
        bands = np.split(np.array(found, dtype=np.int64), np.cumsum(shapes)[:-1])
        samples[:, c] = wavelet_inverse(bands)
    return header + samples.astype("<i2").tobytes() + code[53 : 53 + n_rest]


CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "rle": (rle_encode, rle_decode),
    "huffman": (huffman_encode, _prefix_decode),
    "shannon_fano": (shannon_fano_encode, _prefix_decode),
    "rice": (rice_encode, rice_decode),
    "lz": (lambda d: lz_encode(d, fast=False), lz_decode),
    "lz_fast": (lz_encode, lz_decode),
    "arithmetic": (arithmetic_encode, arithmetic_decode),
    "arithmetic_static": (encode_symbols, decode_symbols),
    "arithmetic_bits": (encode_bits, decode_bits),
    "arithmetic_static_bits": (lambda d: encode_bits(d, adaptive=False), lambda c: decode_bits(c, adaptive=False)),
    "wav": (wav_encode, wav_decode),
    "arithmetic_context": (lambda d: arithmetic_encode(d, 16), arithmetic_decode),
    "deflate": (lambda d: zlib.compress(d, wbits=-15), lambda d: zlib.decompress(d, wbits=-15)),
    "zlib": (zlib.compress, zlib.decompress),
}


# The arithmetic coder over a batch of strings: the same codes; how long a code's string is; symbols that cost as much one by one as a numpy step.
BATCHES: dict[str, tuple[Callable[[Sequence[bytes]], list[bytes]], Callable[[Sequence[bytes]], list[bytes]], Callable[[bytes], int], float]] = {
    "arithmetic": (lanes.encode_bytes, lanes.decode_bytes, lambda c: struct.unpack(">IIB", c[:9])[0], 20),
    "arithmetic_context": (lambda d: lanes.encode_bytes(d, 16), lanes.decode_bytes, lambda c: struct.unpack(">IIB", c[:9])[0], 20),
    "arithmetic_static": (lanes.encode_symbols, lanes.decode_symbols, lambda c: int.from_bytes(c[:4], "big"), 15),
    "arithmetic_bits": (lanes.encode_bits, lanes.decode_bits, lambda c: int.from_bytes(c[:4], "big"), 11),
}


def code_all(data: Sequence[bytes | None], codec: str, side: int) -> list[bytes | None]:
    """Encodes (side 0) or decodes (side 1) many strings; null stays null."""
    one = CODECS[codec][side]
    if codec not in BATCHES:
        return [None if b is None else one(bytes(b)) for b in data]
    *both, length, step = BATCHES[codec]
    return lanes.apply(both[side], one, [None if b is None else bytes(b) for b in data], length if side else len, step)


def _apply(df: DataFrame, column: str, into: str, codec: str, side: int) -> DataFrame:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(code_all(s.tolist(), codec, side), index=s.index, dtype=object)

    return df.withColumn(into, run(F.col(column)))


def encode(df: DataFrame, column: str, codec: str, into: str = "code") -> DataFrame:
    """Adds the encoded bytes of a binary column; null stays null."""
    return _apply(df, column, into, codec, 0)


def decode(df: DataFrame, column: str, codec: str, into: str = "data") -> DataFrame:
    return _apply(df, column, into, codec, 1)
