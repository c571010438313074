"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

Terms are pairs of neighbouring words, so common language alone scores little. An item's BM25 impacts are
divided by their sum: a passage that holds a whole item scores 1 for it, whatever the item's length.
Every document is cut into overlapping passages of twice the longest item's words, so that any item's text
lies whole in one of them. Each passage queries the index for all items that score ``threshold`` or more:

1. screen: the sum of the maximal impacts of the passage's terms (WAND's upper bound) is made for all
   passages of a document at once, with terms split into essential ones and those that together cannot lift
   any item to the threshold; passages whose bound is below the threshold are done;
2. block-max WAND: the others walk the posting lists document at a time, pivoting on term maxima and skipping
   blocks of postings whose block maxima cannot reach the threshold.

A retrieved item counts as leaked if both its question and its answer are there: of the 5-word shingles of
each part, 80 % or more occur in the passage. Where the benchmark has one text column, the last quarter of an
item's words (one at least; an item of one word is all question) is its answer. The 80 % are then asked of the whole item, and
of each part what it can still have after one changed word, which takes five shingles; and an item of five words or
more has leaked too if the passage holds it with one word changed, left out or put in, which takes more than 20 % of a
short item's shingles. The score is asked for in any case.

Number of items, document frequencies, average length and the longest item are counted over the whole benchmark, by
Spark aggregates. The index itself is held in blocks of items, each block's text about ``block_bytes``, so that no
index outgrows an executor (a block takes about 20 times its text in a worker's memory): the driver passes on a block's word hashes
and their frequencies, one block at a time, and workers build its index. A block's scores and passages are those of one
index over all items, so ``block_bytes`` does not change a result. Documents are read once per block: 63 times for
a GB of benchmark. They aren't shuffled; a document of any length is one row.

Edge cases: null or empty texts, items without words and empty tables give no pairs; a null question counts as empty,
an empty part as found, a null answer as absent (the question is split); items with fewer than five words (or parts of them)
are compared as a whole; repeated items or documents give a pair each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import MIX_A, by_ids, mix64, plain_words, shingle_hashes, text_key
from gridloom.session import durable

K1, B = 1.2, 0.75
POSTINGS_PER_BLOCK = 16
SHINGLE = 5
FILTER_BITS = 22
BLOCK_BYTES = 16_000_000
LEAK = "item_id: bigint, score: double, question_overlap: double, answer_overlap: double, passage_start: bigint"
FIELDS = [f.split(":")[0] for f in LEAK.split(", ")]
PAIRS = "doc_id: bigint, " + LEAK


def pair_terms(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; of the word itself, if there is only one."""
    return mix64(words) if len(words) < 2 else mix64(words[:-1] * MIX_A + words[1:])


@dataclass
class Statistics:
    """What BM25 and the passages need to know of the whole benchmark; terms (sorted) and their frequencies may be those of a block."""

    n: int
    average: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Inverted index over test items with term and block maxima of normalised BM25 impacts; statistics are those of the items, if no others are given."""

    def __init__(
        self,
        item_ids: list[int],
        questions: list[np.ndarray],
        answers: list[np.ndarray],
        threshold: float,
        one_text: list[bool] | None = None,
        statistics: Statistics | None = None,
    ):
        self.item_ids, self.threshold = item_ids, threshold
        self.one_text = one_text or [False] * len(item_ids)
        self.parts = [(np.unique(shingle_hashes(q, SHINGLE)), np.unique(shingle_hashes(a, SHINGLE))) for q, a in zip(questions, answers, strict=True)]
        self.widths = [(min(SHINGLE, len(q)), min(SHINGLE, len(a))) for q, a in zip(questions, answers, strict=True)]
        words = [np.concatenate([q, a]) for q, a in zip(questions, answers, strict=True)]
        self.words = words
        self.whole = [np.unique(shingle_hashes(w, SHINGLE)) for w in words]
        self.longest = statistics.longest if statistics else max([len(w) for w in words], default=0)
        terms = [pair_terms(w) for w in words]
        n = len(words)
        item = np.repeat(np.arange(n), [len(t) for t in terms])
        flat = np.concatenate(terms) if terms else np.empty(0, dtype=np.uint64)
        self.terms, term = np.unique(flat, return_inverse=True)
        key, tf = np.unique(term * max(1, n) + item, return_counts=True)
        term, item = key // max(1, n), key % max(1, n)
        length = np.array([len(t) for t in terms], dtype=float)
        if statistics:
            n_all, average, df = statistics.n, statistics.average, statistics.df[np.searchsorted(statistics.terms, self.terms)]
        else:
            n_all, average, df = n, max(1.0, length.sum() / max(1, n)), np.bincount(term, minlength=len(self.terms))
        impact = np.log1p((n_all - df + 0.5) / (df + 0.5))[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / average))
        whole = np.bincount(item, impact, n)
        impact = impact / np.maximum(whole[item], 1e-12)
        # postings are sorted by term, then item
        self.items, self.impacts = item.astype(np.int32), impact
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, term, impact)
        # as many of the commonest terms are non-essential as cannot lift any item to the threshold together
        order = np.argsort(-df, kind="stable")
        self.essential, self.slack = np.ones(len(self.terms), dtype=bool), 0.0
        low, high = 0, len(order)
        while low < high:
            mid = (low + high + 1) // 2
            if self._mass(term, order[:mid], n) < 0.5 * threshold:
                low = mid
            else:
                high = mid - 1
        self.essential[order[:low]] = False
        self.slack = self._mass(term, order[:low], n)
        self.weight = np.where(self.essential, self.most, 0.0)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.terms >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _mass(self, term: np.ndarray, chosen: np.ndarray, n: int) -> float:
        among = np.isin(term, chosen)
        return float(np.bincount(self.items[among], self.impacts[among], n).max(initial=0.0))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold an index term, and the terms' numbers."""
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        real = self.terms[at] == hashes[maybe]
        return maybe[real], at[real]

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Items of score >= threshold for a query of distinct term numbers, by block-max WAND."""
        lists = [[int(self.first[t]), int(self.first[t + 1]), int(self.first[t]), float(self.most[t])] for t in terms]  # at, end, begin, maximum
        items, impacts, found = self.items, self.impacts, []
        need = self.threshold - 1e-12
        while lists:
            lists.sort(key=lambda x: items[x[0]])
            bound, pivot = 0.0, None
            for i, x in enumerate(lists):
                bound += x[3]
                if bound >= need:
                    pivot = i
                    break
            if pivot is None:
                break
            target = items[lists[pivot][0]]
            while pivot + 1 < len(lists) and items[lists[pivot + 1][0]] == target:
                pivot += 1
            # block maxima of the lists that may hold the pivot
            best, next_item = 0.0, None
            for x in lists[: pivot + 1]:
                at = x[0] + int(np.searchsorted(items[x[0] : x[1]], target))
                if at < x[1]:
                    start = x[2] + (at - x[2]) // POSTINGS_PER_BLOCK * POSTINGS_PER_BLOCK
                    end = min(x[1], start + POSTINGS_PER_BLOCK)
                    best += float(impacts[start:end].max())
                    next_item = int(items[end - 1]) + 1 if next_item is None else min(next_item, int(items[end - 1]) + 1)
            if best >= need:
                parts = []
                for x in lists[: pivot + 1]:
                    x[0] += int(np.searchsorted(items[x[0] : x[1]], target))
                    if x[0] < x[1] and items[x[0]] == target:
                        parts.append(float(impacts[x[0]]))
                        x[0] += 1
                score = math.fsum(parts)  # the same in any order
                if score >= need:
                    found.append((int(target), score))
            else:
                beyond = int(items[lists[pivot + 1][0]]) if pivot + 1 < len(lists) else None
                to = max(int(target) + 1, min(v for v in (next_item, beyond) if v is not None) if next_item is not None or beyond is not None else int(target) + 1)
                for x in lists[: pivot + 1]:
                    x[0] += int(np.searchsorted(items[x[0] : x[1]], to))
            lists = [x for x in lists if x[0] < x[1]]
        return found

    def passages(self, n_words: int) -> list[tuple[int, int]]:
        """Start and end words of passages; any run of ``longest`` words lies in one."""
        step = max(1, self.longest)
        return [(s, min(n_words, s + 2 * step)) for s in range(0, max(1, n_words - step), step)]

    def leaks(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, passage start) of each leaked item, best passage first found."""
        if not len(self.terms) or not text:
            return []
        _, _, words = plain_words(text)
        if not len(words):
            return []
        at, term = self.look_up(pair_terms(words))
        need = self.threshold - 1e-6  # sums of bounds are rounded
        if not len(at) or (self.weight[term].sum() + self.slack) < need:
            return []
        spans = np.array(self.passages(len(words)))
        ahead = np.concatenate([[0.0], np.cumsum(self.weight[term])])
        low, high = np.searchsorted(at, spans[:, 0]), np.searchsorted(at, np.maximum(spans[:, 1] - 1, spans[:, 0] + 1))
        bound = self.slack + ahead[high] - ahead[low]
        best: dict[int, tuple[int, float, float, float, int]] = {}
        for i in np.flatnonzero((bound >= need) & (high > low)):
            there = np.unique(term[low[i] : high[i]])
            for item, score in self.search(there):
                passage = words[spans[i, 0] : spans[i, 1]]
                q, a = self.overlaps(item, passage)
                if self.leaked(item, passage, q, a) and (item not in best or score > best[item][1]):
                    best[item] = (self.item_ids[item], score, q, a, int(spans[i, 0]))
        return [best[k] for k in sorted(best)]

    def leaked(self, item: int, passage: np.ndarray, question: float, answer: float) -> bool:
        """Whether the passage holds question and answer, whose shares of shingles there are given."""
        if min(question, answer) >= 0.8:
            return True
        if not self.one_text[item]:
            return False
        words, whole = self.words[item], self.whole[item]
        least = [min(0.8, 1 - SHINGLE / max(SHINGLE, len(x))) for x in self.parts[item]]
        width = min(SHINGLE, len(words))
        if question >= least[0] - 1e-12 and answer >= least[1] - 1e-12 and len(passage) >= width and np.isin(whole, shingle_hashes(passage, width)).mean() >= 0.8:
            return True
        return len(words) >= SHINGLE and one_edit_away(words, passage)

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float]:
        out = []
        for shingles, width in zip(self.parts[item], self.widths[item], strict=True):
            if width == 0:
                out.append(1.0)
            elif len(words) < width:
                out.append(0.0)
            else:
                out.append(float(np.isin(shingles, shingle_hashes(words, width)).mean()))
        return out[0], out[1]


def one_edit_away(words: np.ndarray, passage: np.ndarray) -> bool:
    """Whether the words stand in the passage, with one of them at most replaced, left out or put in."""
    n, m = len(words), len(passage)
    if m < n - 1:
        return False
    same = np.zeros((m + n + 1, n), dtype=bool)
    same[:m] = passage[:, None] == words[None, :]
    j, s = np.arange(n), np.arange(m + 1)
    ahead = np.cumprod(same[s[:, None] + j, j], axis=1).sum(axis=1)  # words that match from place s on
    back = s[:, None] - 1 - j
    behind = np.cumprod((back >= 0) & same[np.maximum(back, 0), n - 1 - j], axis=1).sum(axis=1)  # that match up to place s
    return any(bool((ahead[: m + 1 - size] + behind[size:] >= need).any()) for size, need in ((n, n - 1), (n - 1, n - 1), (n + 1, n)) if size <= m)


def split_item(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer."""
    words = plain_words(text)[2]
    n = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words[:n], words[n:]


@dataclass
class Block:
    """A bounded part of the benchmark as workers get it; the index is built once in each worker."""

    items: list[tuple]
    threshold: float
    statistics: Statistics

    @cached_property
    def index(self) -> Index:
        return _index(self.items, self.threshold, self.statistics)


def _index(items: list[tuple], threshold: float, statistics: Statistics | None = None) -> Index:
    ids, questions, answers, one_text = map(list, zip(*items, strict=True))
    return Index(ids, questions, answers, threshold, one_text, statistics)


def hashed_items(benchmark: DataFrame, question_col: str | None = None, answer_col: str | None = None) -> DataFrame:
    """Items with words: item_id, question, answer (hashes of words), one_text, terms (distinct), length (in terms), bytes."""
    two = question_col is not None and answer_col is not None
    cols = [F.col(question_col), F.col(answer_col)] if two else [F.col("text"), F.lit(None).cast("string")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, q, a in zip(pdf["item_id"], pdf["q"], pdf["a"], strict=True):
                parts = split_item(q or "") if a is None else (plain_words(q or "")[2], plain_words(a)[2])
                words = np.concatenate(parts)
                if len(words):
                    terms = pair_terms(words)
                    rows.append((k, *[p.view(np.int64) for p in parts], a is None, np.unique(terms).view(np.int64), len(terms), len(q or "") + len(a or "")))
            yield pd.DataFrame(rows, columns=["item_id", "question", "answer", "one_text", "terms", "length", "bytes"])

    # ids as text, so that nulls beside them do not make them fractions
    given = benchmark.select(F.col("item_id").cast("string"), cols[0].alias("q"), cols[1].alias("a"))
    shape = "item_id string, question array<long>, answer array<long>, one_text boolean, terms array<long>, length long, bytes long"
    return given.mapInPandas(run, shape).withColumn("item_id", F.col("item_id").cast("long"))


def blocks_of(benchmark: DataFrame, threshold: float, block_bytes: int, **columns) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time, with statistics over all of it."""
    items = durable(hashed_items(benchmark, **columns))
    total = items.agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.max(F.size("question") + F.size("answer")).alias("longest"), F.sum("bytes").alias("bytes")).first()
    if not total["n"]:
        return
    n_blocks = max(1, -(-total["bytes"] // block_bytes))
    # the checkpoint's rows have lasting places, so copies of an item spread over the blocks
    items = items.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))
    terms = items.select("block", F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    known = durable(terms.distinct().join(df, "term"))
    for b in range(n_blocks):
        rows = items.filter(F.col("block") == b).select("item_id", "question", "answer", "one_text").toArrow().to_pylist()
        if not rows:
            continue
        hashes = lambda v: np.array(v, dtype=np.int64).view(np.uint64)
        held = [(r["item_id"], hashes(r["question"]), hashes(r["answer"]), r["one_text"]) for r in rows]
        found = known.filter(F.col("block") == b).select("term", "df").toPandas()
        term, count = found["term"].to_numpy().view(np.uint64), found["df"].to_numpy()
        order = np.argsort(term)
        yield Block(held, threshold, Statistics(total["n"], max(1.0, total["length"] / total["n"]), total["longest"], term[order], count[order]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES, **columns) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, score, question_overlap, answer_overlap, passage_start (in words)."""
    found = None
    for block in blocks_of(benchmark, threshold, block_bytes, **columns):
        part = docs.select("doc_id", F.explode(_leaks_of(docs, block)(F.col("text"))).alias("leak")).select("doc_id", "leak.*")
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], PAIRS) if found is None else found


def _leaks_of(docs: DataFrame, block: Block):
    """A function from a text column to its leaks, as an array of structs; only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_bytes

    @F.pandas_udf(f"array<struct<{LEAK}>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value.index
        for t in texts:
            yield t.map(lambda text: [dict(zip(FIELDS, leak, strict=True)) for leak in index.leaks(text)])

    return lambda text: run(F.coalesce(text, F.lit("")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES, **columns) -> DataFrame:
    """The documents in which no item of the benchmark leaked, with their columns as they are.

    With one block this is a filter. With more, the digests of leaked texts are gathered over all blocks and their
    documents are left out by an anti-join, so that a worker holds one index at a time; the result is the same."""
    blocks = blocks_of(benchmark, threshold, block_bytes, **columns)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.filter(F.size(_leaks_of(docs, first)(F.col("text"))) == 0)
    leaked = None
    for block in chain((first, second), blocks):
        part = docs.filter(F.size(_leaks_of(docs, block)(F.col("text"))) > 0).select(text_key().alias("__leaked"))
        leaked = part if leaked is None else leaked.unionByName(part)
    return by_ids(docs.withColumn("__leaked", text_key()), durable(leaked.distinct()), "left_anti", "__leaked").select(*docs.columns)

