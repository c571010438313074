"""What several operators share: the shared folder, words and vectorised hashing of texts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_folder

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder's path under the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc_id", n: int | None = None) -> DataFrame:
    """``rows`` joined to ``ids``, a checkpointed table of fixed-width keys (numbers, digests): left_semi, left_anti or inner.

    The ids are counted first, unless n is their number: up to BROADCAST_IDS (of some 100 bytes at most) are broadcast, so that wide rows stay where
    they are; more go through a shuffle join. Both give the same rows."""
    return rows.join(F.broadcast(ids) if (ids.count() if n is None else n) <= BROADCAST_IDS else ids, on, how)


def text_key(text: str = "text") -> Column:
    """128 bits that stand for a text; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE^0 .. BASE^(n-1) modulo 2^64."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1:] * BASE)])
    return _POWERS[:n]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true values."""
    at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        at = np.concatenate([[0], at])
    if inside[-1]:
        at = np.append(at, len(inside))
    return at[0::2], at[1::2]


def word_hashes(raw: np.ndarray, inside: np.ndarray, prefixes: Sequence[int] = ()) -> tuple[np.ndarray, ...]:
    """Start, end and 64-bit hash of each run of ``inside`` bytes of ``raw``, and for each of ``prefixes`` the hash of so many first bytes.

    A hash is a polynomial of the bytes modulo 2^64 and the length, finalised."""
    if not len(raw) or not inside.any():
        none, at = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        return (at, at, none, *[none for _ in prefixes])
    starts, ends = runs(inside)
    place = np.arange(len(raw), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(raw))))
    place[: starts[0]] = 0
    term = (raw.astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
    term[~inside] = 0
    size = (ends - starts).astype(np.uint64)
    out = [mix64(np.add.reduceat(term, starts) + size * MIX_B)]
    for n in sorted(prefixes, reverse=True):
        term[place >= n] = 0
        out.append(mix64(np.add.reduceat(term, starts) ^ np.uint64(int(MIX_B) * n % 2**64)))
    return (starts, ends, *out)


def blank_separated(text: str) -> tuple[np.ndarray, ...]:
    """Words between spaces and \\t..\\r, with A-Z as a-z: starts, ends, hashes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return word_hashes(LOWER[raw], ~SPACES[raw])


def plain_words(text: str, prefixes: Sequence[int] = ()) -> tuple[np.ndarray, ...]:
    """Words of letters and digits of the lower-cased text (every other ASCII sign separates): starts, ends, hashes and hashes of prefixes, longest first."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return word_hashes(raw, WORD_BYTES[raw], prefixes)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every run of k word hashes; of the whole sequence, if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * MIX_A + words[i : n - k + 1 + i]
    return mix64(out + np.uint64(k))
