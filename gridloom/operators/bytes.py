"""Byte strings as rows (doc_id, data): histograms, runs, code costs, checksums; and byte-wise operations on rasters.

Each string is one row and is worked on inside it, vectorised over Arrow batches, so bytes are never rows of a shuffle; what
follows from a string's 256 counts is array functions. A null string counts as empty. Memory is in proportion to a
batch's longest string."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar

NBITS = np.array([v.bit_length() for v in range(256)], dtype=np.int64)


def _each(make: Callable[[np.ndarray], object], kind: str) -> Callable[[str], Column]:
    """A column function of a byte string, given what to make of its bytes."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for strings in batches:
            yield pd.Series([make(np.frombuffer(b or b"", dtype=np.uint8)) for b in strings])

    return lambda column: run(F.col(column))


def values(column: str) -> Column:
    """A byte string's bytes as an array of numbers."""
    return _each(lambda a: a.astype(np.int32), "array<int>")(column)


def counts(strings: DataFrame) -> DataFrame:
    """doc_id, counts (array of 256): how often each byte value stands in the string."""
    count = _each(lambda a: np.bincount(a, minlength=256), "array<long>")
    return strings.select("doc_id", count("data").alias("counts"))


def histogram(strings: DataFrame) -> DataFrame:
    """doc_id, byte, n for each of the 256 byte values."""
    return counts(strings).select("doc_id", F.posexplode("counts").alias("byte", "n"))


def least_common(strings: DataFrame) -> DataFrame:
    """The rarest byte, the lowest on ties."""
    return counts(strings).select("doc_id", (F.array_position("counts", F.array_min("counts")) - 1).cast("int").alias("byte"))


def by_count(strings: DataFrame) -> DataFrame:
    """Symbols in use ranked by falling count, lower symbols first on ties."""
    symbols = F.array_sort(F.filter(F.transform("counts", lambda n, b: F.struct((-n).alias("less"), b.alias("byte"))), lambda s: s["less"] < 0))
    ranked = counts(strings).select("doc_id", F.posexplode(symbols).alias("at", "s"))
    return ranked.select("doc_id", F.col("s.byte").alias("byte"), (-F.col("s.less")).alias("n"), (F.col("at") + 1).alias("rank"))


def entropy(strings: DataFrame) -> DataFrame:
    """Bits per symbol of the distribution; null for an empty string."""
    n = F.transform("counts", lambda x: x.cast("double"))
    total = F.aggregate(n, F.lit(0.0), lambda s, x: s + x)
    part = F.aggregate(n, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    return counts(strings).select("doc_id", F.when(total > 0, F.log2(total) - part / total).alias("entropy"))


def run_table(a: np.ndarray, longest: int = 32768) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, byte and length of each run of equal bytes; longer ones are cut every ``longest`` bytes."""
    if not len(a):
        return (np.empty(0, dtype=np.int64),) * 3
    begin = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    size = np.diff(np.append(begin, len(a)))
    parts = -(-size // longest)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(begin, parts) + nth * longest
    return start, a[start].astype(np.int64), np.minimum(longest, np.repeat(begin + size, parts) - start)


def runs(strings: DataFrame, longest: int = 32768) -> DataFrame:
    """Runs of equal bytes: doc_id, start, byte, length; runs end at ``longest``."""
    shape = "doc_id long, start int, byte int, length int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for doc_id, data in zip(pdf["doc_id"], pdf["data"], strict=True):
                start, byte, length = run_table(np.frombuffer(data or b"", dtype=np.uint8), longest)
                yield pd.DataFrame({"doc_id": doc_id, "start": start, "byte": byte, "length": length})

    return strings.select("doc_id", "data").mapInPandas(run, shape)


def run_lengths(strings: DataFrame, longest: int = 32768) -> DataFrame:
    """Runs of a string by byte and length: doc_id, byte, length, n (how many), first (start of the first)."""

    def tally(a: np.ndarray) -> list[dict]:
        start, byte, length = run_table(a, longest)
        key, first, n = np.unique(byte * (longest + 1) + length, return_index=True, return_counts=True)
        rows = zip((key // (longest + 1)).tolist(), (key % (longest + 1)).tolist(), n.tolist(), start[first].tolist(), strict=True)
        return [dict(zip(("byte", "length", "n", "first"), r, strict=True)) for r in rows]

    found = _each(tally, "array<struct<byte:int,length:int,n:bigint,first:int>>")
    return strings.select("doc_id", F.explode(found("data")).alias("r")).select("doc_id", "r.*")


def run_length_size(strings: DataFrame) -> DataFrame:
    """Bytes of the run-length code with the string's rarest byte as marker: literal up to three, else marker, count in one or two bytes, symbol; the marker itself always takes a pair."""

    def size(a: np.ndarray) -> int:
        _, byte, n = run_table(a)
        marker = np.argmin(np.bincount(a, minlength=256))
        short = np.where(byte == marker, 2, n)
        return int(np.where(n <= 3, short, np.where(n > 128, 4, 3)).sum()) + 1

    return strings.select("doc_id", _each(size, "long")("data").alias("size"))


def rice_words(a: np.ndarray, history: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Bit length and parameter k of each word: the rounded mean bit length of the previous 16 words, for the first 16 that of the first ones (1 at least)."""
    nbits = NBITS[a]
    ahead = np.concatenate([[0], np.cumsum(nbits)])
    c = min(history, len(a))
    k = np.full(len(a), max(1, (int(ahead[c]) + c // 2) // c) if c else 0)
    if len(a) > history:
        k[history:] = (ahead[history:-1] - ahead[: -history - 1] + history // 2) // history
    return nbits, k


def rice_parameters(strings: DataFrame, history: int = 16) -> DataFrame:
    """doc_id, pos, byte, nbits, k of each word of a string."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for doc_id, data in zip(pdf["doc_id"], pdf["data"], strict=True):
                a = np.frombuffer(data or b"", dtype=np.uint8)
                nbits, k = rice_words(a, history)
                yield pd.DataFrame({"doc_id": doc_id, "pos": np.arange(len(a)), "byte": a, "nbits": nbits, "k": k})

    return strings.select("doc_id", "data").mapInPandas(run, "doc_id long, pos int, byte int, nbits int, k int")


def rice_code(strings: DataFrame, history: int = 16, limit: int = 8) -> DataFrame:
    """doc_id, sums of k and nbits over a string's words, and bits of its Rice code: quotient in unary below ``limit``, else an escape with the quotient's bit length."""

    def cost(a: np.ndarray) -> list[int]:
        nbits, k = rice_words(a, history)
        q = a.astype(np.int64) >> k
        over = NBITS[np.maximum(q - limit, 0)]
        bits = np.where(q < limit, q + 1, limit + over + 1 + np.maximum(0, over - 1)) + k
        return [int(k.sum()), int(nbits.sum()), int(bits.sum()) + 8]

    return strings.select("doc_id", _each(cost, "array<long>")("data").alias("c")).select("doc_id", *[F.col("c")[i].alias(n) for i, n in enumerate(("k", "nbits", "bits"))])


def adler32(strings: DataFrame) -> DataFrame:
    """Adler-32 of each string."""
    return strings.select("doc_id", _each(lambda a: zlib.adler32(a), "long")("data").alias("adler"))


def filter_rows(raster: DataFrame, kind: str) -> DataFrame:
    """Scanline filter of a gray raster (0..255): none, sub, up, average or paeth; outside counts as 0."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    r = raster.withColumn("v", F.col("v").cast("int"))
    r = r.withColumn("a", F.coalesce(F.lag("v").over(row), F.lit(0))).withColumn("b", F.coalesce(F.lag("v").over(col), F.lit(0)))
    r = r.withColumn("c", F.coalesce(F.lag("b").over(row), F.lit(0)))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    guess = {"none": F.lit(0), "sub": a, "up": b, "average": F.floor((a + b) / 2), "paeth": scalar.paeth(a, b, c)}[kind]
    return r.select("image_id", "x", "y", F.pmod(F.col("v") - guess, F.lit(256)).cast("int").alias("v"))


def interlace_pass(raster: DataFrame) -> DataFrame:
    """Adds the Adam7 pass (1 to 7) of each pixel."""
    x, y = F.col("x") % 8, F.col("y") % 8
    p = (
        F.when((x == 0) & (y == 0), 1)
        .when((x == 4) & (y == 0), 2)
        .when((x % 4 == 0) & (y == 4), 3)
        .when((x % 4 == 2) & (y % 4 == 0), 4)
        .when((x % 2 == 0) & (y % 4 == 2), 5)
        .when((x % 2 == 1) & (y % 2 == 0), 6)
        .otherwise(7)
    )
    return raster.withColumn("pass", p)


def wavelet_level(signal: DataFrame) -> DataFrame:
    """One level of the reversible S transform: per pair of whole samples (idx 2i, 2i + 1) low = floor of their mean and high = their difference; a last odd sample is its own low."""
    s = signal.select("series_id", F.expr("cast(idx div 2 as int)").alias("i"), (F.col("idx") % 2).alias("odd"), F.col("v").cast("int").alias("v"))
    g = s.groupBy("series_id", "i").agg(F.max(F.when(F.col("odd") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("odd") == 1, F.col("v"))).alias("b"))
    return g.select("series_id", "i", F.floor((F.col("a") + F.coalesce("b", "a")) / 2).cast("int").alias("low"), (F.col("a") - F.col("b")).alias("high"))
