"""Toxicity by compression distance.

Words are coded as 24 bytes, fingerprints of the word and of its first seven and first five bytes, so a word that a
dictionary knows costs about three bytes and an unknown one its full width, however short it is, and a word
that shares its stem with a known one a part of it. Two zstandard dictionaries are trained on coded text, one on
ordinary documents and one on what sets toxic documents apart: the words whose codes a test of document counts finds commoner
there (a dictionary of all their text spends its bytes on ordinary language, and its lengths tell less). The toxic
side's dictionary is followed by the ordinary one, so both know ordinary language equally well. A document's windows
are compressed with both; the differences of the lengths (largest, mean, share and number of large ones) go
through a logistic calibration to a score in [0, 1].

Training reads a bounded sample of labelled rows (``max_docs`` of each class in the order of a
hash of doc_id, one text each, those of at most ``max_chars`` characters); scoring covers every document, window by window.

Edge cases: null and empty texts get the score of a document without words; without labelled rows of both
classes every score is 0; null labels are left out and repeated ones count once (toxic wins); repeated
documents score alike; of the texts of a repeated doc_id the training takes the least; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import plain_words

PREFIXES = (7, 5)  # bytes
WIDTH = 8 * (1 + len(PREFIXES))  # bytes of a word's code
LEVEL = 6
WINDOW = 32  # words
LARGE = 6  # bytes saved in one window


def coded(text: str) -> np.ndarray:
    """One row of 64-bit codes for each word."""
    return np.stack(plain_words(text, PREFIXES)[2:], axis=1)


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=WIDTH * WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0
            )
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return out

    def scorer(self):
        one, two = self.compressors()

        def score(text: str | None) -> float:
            z = (features(coded(text or ""), one, two) - self.centre) / self.scale
            return float(1.0 / (1.0 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -500, 500))))

        return score


def features(codes: np.ndarray, one, two) -> np.ndarray:
    data = codes.tobytes()
    step = WIDTH * WINDOW
    saved = [len(one.compress(data[i : i + step])) - len(two.compress(data[i : i + step])) for i in range(0, len(data), step)] or [0]
    g = np.sort(np.array(saved, dtype=np.float64))
    large = int((g >= LARGE).sum())
    return np.array([g[-1], g.mean(), large / len(g), np.log1p(large), np.log(len(g)), g[-3:].mean()])


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps of a ridge-penalised logistic regression in which both classes weigh the same."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - centre) / scale]
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        h = (z * (share * p * (1 - p))[:, None]).T @ z + np.eye(len(w)) * ridge
        w -= np.linalg.solve(h, z.T @ (share * (p - y)) + ridge * w)
    return centre, scale, w


def _document_counts(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the number of documents that hold each."""
    return np.unique(np.concatenate([np.unique(c) for c in codes] or [np.empty(0, dtype=np.uint64)]), return_counts=True)


def _apart(codes: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Codes that are clearly commoner in toxic documents: in three at least, by four standard deviations and fourfold."""
    ordinary, m_all = _document_counts([c for c, label in zip(codes, y, strict=True) if not label])
    toxic, n = _document_counts([c for c, label in zip(codes, y, strict=True) if label])
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if not len(toxic):
        return toxic
    m = np.zeros(len(toxic))
    if len(ordinary):
        at = np.minimum(np.searchsorted(ordinary, toxic), len(ordinary) - 1)
        m = np.where(ordinary[at] == toxic, m_all[at], 0)
    p = (n + m) / (n0 + n1)
    z = (n - p * n1) / np.sqrt(p * n1 * (1 - p) + 1e-9)
    return toxic[(n >= 3) & (z >= 4) & (n / n1 > 4 * (m + 0.5) / n0)]


def fit(texts: list[str], toxic: list[int], ordinary_bytes: int = 8192, toxic_bytes: int = 4096) -> Model | None:
    """Dictionaries and calibration from labelled texts; None unless both classes are there."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return None
    codes = [coded(t or "") for t in texts]
    apart_codes = _apart(codes, y)
    marked = [c[np.isin(c, apart_codes).any(axis=1)].tobytes() for c, label in zip(codes, y, strict=True) if label]
    plain = [c[i : i + 16].tobytes() for c, label in zip(codes, y, strict=True) if not label for i in range(0, len(c), 16)]
    # evenly spaced windows of all ordinary documents
    plain = plain[:: max(1, len(plain) // 40000)]
    model = Model(_trained(plain, ordinary_bytes), _trained([m for m in marked if m] * 4, toxic_bytes), np.zeros(6), np.ones(6), np.zeros(7))
    one, two = model.compressors()
    x = np.array([features(c, one, two) for c in codes])
    model.centre, model.scale, model.weights = _fit_logistic(x, y.astype(float))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, max_chars: int = 50_000) -> DataFrame:
    """The bounded training sample, none of it held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = None
    for label in (1, 0):
        some = known.filter(F.col("toxic") == label).orderBy(*order).limit(max_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most two times max_docs ids: broadcast, so that no other text is shuffled; copies are merged before the shuffle
    found = docs.select("doc_id", "text").filter(F.char_length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, **sample) -> Model | None:
    """Fits the model in one task on the bounded sample, so that only dictionaries and weights reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "toxic": []}), *frames]).sort_values(["toxic", "doc_id", "text"], ascending=[False, True, True])
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["toxic"].astype(int).tolist()))]})

    found = training_rows(docs, labels, **sample).repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else None


def score_column(text: Column, model: Model | None) -> Column:
    """The score of a text column; only that column goes to Python."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer() if model is not None else (lambda text: 0.0)
        for t in texts:
            yield t.map(score).astype("float64")

    return run(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """Trains on the labelled rows that aren't held out and scores all documents."""
    return score_documents(docs, train(docs, labels, **sample))


def drop_toxic(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they are."""
    model = train(docs, labels, **sample)
    return docs.filter(score_column(F.col("text"), model) < 0.5)
