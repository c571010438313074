"""One-dimensional signals (series_id, idx, v): persistence pairs, peaks, layer choice. Kernels per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.codecs import contexts


def persistence(v: Sequence[float]) -> tuple[list[tuple[int, int, float]], int]:
    """Pairs (index of the minimum, index of the maximum, persistence) by persistence, then minimum; and the global minimum's index.

    Samples are taken by value; where two basins meet, the one with the larger minimum ends (the right one on ties)."""
    n = len(v)
    order = sorted(range(n), key=lambda i: (v[i], i))
    root = list(range(n))
    low = list(range(n))
    there = [False] * n

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = []
    for i in order:
        there[i] = True
        left = find(i - 1) if i and there[i - 1] else None
        right = find(i + 1) if i + 1 < n and there[i + 1] else None
        if left is not None and right is not None:
            ends, stays = (left, right) if v[low[right]] < v[low[left]] else (right, left)
            pairs.append((low[ends], i, v[i] - v[low[ends]]))
            root[ends] = stays
            root[i] = stays
        elif left is not None or right is not None:
            root[i] = left if left is not None else right
    return sorted(pairs, key=lambda p: (p[2], p[0])), order[0] if n else -1


def persistence_pairs(signal: DataFrame, threshold: float = 0.0) -> DataFrame:
    """series_id, min_idx, max_idx, persistence of pairs of at least the threshold (idx values as given)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        idx = pdf["idx"].to_numpy()
        rows = [(pdf["series_id"].iloc[0], idx[a], idx[b], p) for a, b, p in persistence(pdf["v"].tolist())[0] if p >= threshold]
        return pd.DataFrame(rows, columns=["series_id", "min_idx", "max_idx", "persistence"])

    if threshold < 0:
        return signal.sparkSession.createDataFrame([], "series_id string, min_idx int, max_idx int, persistence double")
    return signal.groupBy("series_id").applyInPandas(run, "series_id string, min_idx int, max_idx int, persistence double")


def extrema(pairs: DataFrame) -> DataFrame:
    """All indices of paired extrema: series_id, idx, kind."""
    low = pairs.select("series_id", F.col("min_idx").alias("idx"), F.lit("min").alias("kind"))
    return low.unionByName(pairs.select("series_id", F.col("max_idx").alias("idx"), F.lit("max").alias("kind"))).distinct()


def global_minimum(signal: DataFrame) -> DataFrame:
    """Index and value of each series' least sample, the first on ties."""
    return signal.groupBy("series_id").agg(F.min_by("idx", F.struct("v", "idx")).alias("idx"), F.min("v").alias("v"))


def leg_end(x: np.ndarray, start: int, delta: float) -> int | None:
    """Place of the first highest sample of the leg from ``start`` on, which ends where a sample lies more than delta below it; None if it does not end."""
    width = 64
    while True:
        part = x[start : start + width]
        fallen = np.flatnonzero(part < np.maximum.accumulate(part) - delta)
        if len(fallen):
            return start + int(np.argmax(part[: fallen[0]]))
        if start + width >= len(x):
            return None
        width *= 2


def peaks(v: Sequence[float], delta: float, maximum_first: bool = False) -> list[int]:
    """Maxima of the zigzag of tolerance delta: legs go up and down in turn, each beginning at the extremum that ended the one before."""
    legs = {True: np.asarray(v, dtype=np.float64)}
    legs[False] = -legs[True]
    turns: list[int] = []
    up, at = maximum_first, 0
    while (end := leg_end(legs[up], at, delta)) is not None:
        turns += [end] if up else []
        up, at = not up, end
    return turns


# Where the search for a number of peaks or layers begins, its step, and how often it is tried.
FIRST_DELTA, SHRINK, TRIES, HALVINGS = 0.1, 0.9, 1000, 50


def peaks_of_count(v: Sequence[float], count: int, tries: int = TRIES) -> list[int]:
    """Peaks at the delta, shrunk or grown step by step from FIRST_DELTA, at which there are ``count``."""
    delta, found = FIRST_DELTA, []
    for _ in range(tries):
        found = peaks(v, delta)
        if len(found) == count:
            break
        delta = delta * SHRINK if len(found) < count else delta / SHRINK
    return found


def layers_by_drop(upper: Sequence[float], drop: float, gap: int) -> list[int]:
    """Levels at which the upper mass has fallen by more than ``drop`` since the last one, at least ``gap`` apart."""
    out, at = [], 0
    for i in range(1, len(upper)):
        if i - at >= gap and upper[at] - upper[i] > drop:
            out.append(i)
            at = i
    return out


def layers_of_count(upper: Sequence[float], count: int, gap: int, steps: int = HALVINGS) -> list[int]:
    """Levels at the drop, found by halving [0, 0.5], that gives ``count`` of them."""
    low, high, drop = 0.0, 0.5, 0.5
    for _ in range(steps):
        n = len(layers_by_drop(upper, drop, gap))
        if n == count:
            break
        low, high = (low, drop) if n < count else (drop, high)
        drop = (low + high) / 2
    return layers_by_drop(upper, drop, gap)


def detect_peaks(signal: DataFrame, delta: float | None = None, count: int | None = None) -> DataFrame:
    """series_id, idx of peaks at a delta, or at the delta that gives a number of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v = pdf["v"].tolist()
        found = peaks(v, delta) if delta is not None else peaks_of_count(v, count)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "idx": pdf["idx"].to_numpy()[found] if found else np.empty(0, dtype=np.int32)})

    return signal.groupBy("series_id").applyInPandas(run, "series_id string, idx int")


def choose_layers(upper: DataFrame, count: int, gap: int = 5, method: str = "cumulative") -> DataFrame:
    """Gray levels that represent an image, from (image_id, level, up, relative): by cumulative mass, or local maxima of the histogram."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("level")
        found = layers_of_count(pdf["up"].tolist(), count, gap) if method == "cumulative" else peaks_of_count(pdf["relative"].tolist(), count)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "level": np.array(found, dtype=np.int32)})

    return upper.select("image_id", "level", "up", "relative").groupBy("image_id").applyInPandas(run, "image_id string, level int")


def exponential_context(signal: DataFrame) -> DataFrame:
    """series_id, idx, context: before each sample the fading mean of the bit lengths of the whole parts so far."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        sizes = [abs(int(v)).bit_length() for v in pdf["v"]]
        return pd.DataFrame({"series_id": pdf["series_id"], "idx": pdf["idx"], "context": contexts(sizes)})

    return signal.groupBy("series_id").applyInPandas(run, "series_id string, idx int, context double")
