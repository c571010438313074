"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = 1e7  # values from half of this on count as unset


def distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt(squared_distance(x1, y1, x2, y2))


def squared_distance(x1, y1, x2, y2) -> Column:
    dx, dy = F.col(x1) - F.col(x2) if isinstance(x1, str) else x1 - x2, F.col(y1) - F.col(y2) if isinstance(y1, str) else y1 - y2
    return dx * dx + dy * dy


def descriptor_distance(a, b) -> Column:
    """Squared L2 distance of two arrays, added in order."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def safe_acos(x: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)))


def angle(ax, ay, bx, by, cx, cy) -> Column:
    """Angle ABC in radians; the product of the side lengths is lifted by 1e-5."""
    ux, uy, wx, wy = bx - ax, by - ay, bx - cx, by - cy
    return safe_acos((ux * wx + uy * wy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(wx * wx + wy * wy) + F.lit(1e-5)))


def buffer_size(nx: Column, ny: Column) -> Column:
    """Smallest power of two strictly above both sides (exact: by bit length)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.greatest(nx, ny).cast("long"))))


def project(h: Sequence[float] | Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 homography, row-major."""
    m = [h[i] if isinstance(h, Column) else F.lit(float(h[i])) for i in range(9)]
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def inverse_homography(h: Sequence[float]) -> list[float]:
    """The inverse by cofactors."""
    a, b, c, d, e, f, g, i, j = (float(v) for v in h)
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    adj = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    return [v / det for v in adj]


def file_extension(name: Column) -> Column:
    """What follows the last dot; '' without one."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")


def file_stem(name: Column) -> Column:
    """What precedes the last dot; '' without one."""
    return F.regexp_extract(name, r"^(.*)\.", 1)


def trailing_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)$", 1).try_cast("int")


def bit_length(x: Column) -> Column:
    """Bits of a non-negative integer, 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x.cast("long"))))


def split_integer(n: Column) -> tuple[Column, Column]:
    """A signed integer as its magnitude's bit length and the rest, sign last."""
    a = F.abs(n)
    bits = bit_length(a)
    return bits, F.when(n == 0, 0).otherwise(a + a - F.call_function("shiftleft", F.lit(1), bits) + (n < 0).cast("int"))


def restore_integer(bits: Column, data: Column) -> Column:
    v = F.shiftright(data + F.call_function("shiftleft", F.lit(1), bits), 1)
    return F.when(data.bitwiseAND(1) == 1, -v).otherwise(v)


def variable_size(x: Column) -> Column:
    """Hex of an unsigned integer in groups of seven bits, most significant first; all but the last have bit 8 set."""
    groups = F.greatest(F.lit(1), F.ceil(bit_length(x) / 7)).cast("int")
    each = F.transform(
        F.sequence(groups - 1, F.lit(0)),
        lambda i: F.lpad(F.hex(F.pmod(F.floor(x / F.pow(F.lit(2.0), i * 7)).cast("long"), F.lit(128)) + F.when(i > 0, 128).otherwise(0)), 2, "0"),
    )
    return F.array_join(each, "")


def adler32(data: Column) -> Column:
    """Adler-32 of a byte array column (integers 0 to 255)."""
    step = F.aggregate(
        data,
        F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        lambda s, v: F.struct(((s["a"] + v) % 65521).alias("a"), ((s["b"] + (s["a"] + v) % 65521) % 65521).alias("b")),
    )
    return step["b"] * 65536 + step["a"]


# The generator words of the reflected CRC, one for each bit of a byte.
CRC_GENERATOR = (0xEC1A5A3E, 0x5975F5D7, 0xB2EBEBAE, 0xE49696F7, 0x486C6C45, 0x90D8D88A, 0xA0F0F0BF, 0xC0A0A0D5)


def crc_table() -> list[int]:
    """The byte table spanned by the generator words: entry n is the XOR of those at n's bits."""
    return [_xor([g for k, g in enumerate(CRC_GENERATOR) if n >> k & 1]) for n in range(256)]


def _xor(values: Sequence[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def buffer_crc(data: Column) -> Column:
    """The custom reflected CRC of a byte array column, starting from 0."""
    table = F.array(*[F.lit(v).cast("long") for v in crc_table()])
    return F.aggregate(
        data,
        F.lit(0).cast("long"),
        lambda c, b: F.shiftright(c, 8).bitwiseXOR(F.element_at(table, (c.bitwiseAND(255).bitwiseXOR(b.cast("long")) + 1).cast("int"))),
    )


def paeth(a: Column, b: Column, c: Column) -> Column:
    """The Paeth predictor of left, above and above-left."""
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def little_endian_hex(x: Column) -> Column:
    """Four little-endian bytes of a 32-bit word, as hex."""
    h = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def swap_bytes(h: Column) -> Column:
    """A hex string with its bytes in reverse order."""
    return F.array_join(F.reverse(F.regexp_extract_all(h, F.lit("(..)"), 1)), "")


def wrap_distance(c: Column, length: Column) -> Column:
    return F.least(F.abs(c), F.abs(length - F.abs(c)))


def filter_size(n: Column) -> Column:
    """The odd filter size at or below n, from 1 to 9."""
    return F.when(n < 3, 1).when(n < 5, 3).when(n < 7, 5).when(n < 9, 7).otherwise(9)


def guarded_divide(a: Column, b: Column) -> Column:
    """a / b; a itself where b is about 0."""
    return F.when(F.abs(b) > 1e-7, a / b).otherwise(a)


def log_map(v: Column) -> Column:
    return F.when(v >= 1, F.ln(v)).otherwise(0.0)


def rainbow(t: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a value in 0..1 on the rainbow colour map."""
    v = F.lit(4.4) * t + F.lit(0.8)
    tent = lambda base, p, q: F.greatest(F.lit(0.0), (F.lit(base) - F.abs(v - p) - F.abs(v - q)) / 2)
    return tent(3.0, 4, 5), tent(4.0, 2, 4), tent(3.0, 1, 2)


def mirrored(i: Column, n: Column) -> Column:
    """An index folded into 0..n-1: -i below, 2n - i - 1 from n on."""
    return F.when(i < 0, -i).when(i >= n, n * 2 - i - 1).otherwise(i)
