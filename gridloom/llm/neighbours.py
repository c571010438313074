"""Approximate nearest neighbours (largest inner product) by a hierarchical k-means tree.

The upper levels of the tree are fitted on a bounded sample (at most ``max_sample`` vectors, those of the smallest hashes
of their ids); its leaves are cells of about ``cell_rows`` rows (more, once that would ask for more than a cell for
every eight vectors of the sample). Every vector is indexed: it descends to the cell of its nearest centres, and the
rows of a cell are split on by k-means where they lie, down to leaves of ``leaf_rows`` at most, so leaves do
not grow with the table.

A query walks the upper levels best bin first: a priority queue holds nodes by the inner product of the query and their
centres, and cells are visited as they come up, until the queue's best falls a margin below the query's bound (a
lower bound of its k-th score, from the sample). In a cell it meets the leaves whose centres come within a
second margin of the bound, and only rows that reach the bound come back. The margins are calibrated: for
``calibration`` queries the exact neighbours among all rows are found by brute force (blocks of rows against this
small query set), and the margins are widened until the leaves visited hold ``recall`` of them. Scores are inner
products of the original vectors in double precision, added in order of the components. A query that found fewer
than k rows that reach its bound is given the rows of the sample that the bound is made of as well.

Hot groups: equal vectors are merged before the shuffle to their 21 smallest ids, more of which no result
can hold, so a group of copies of any size is a few rows (Spark limits the groups before their shuffle as well); a cell
with more than ``block`` rows is dealt to several groups, each of which its queries visit. Vectors of a group
are held one block at a time while its queries stream past.

Edge cases: vectors that are null, zero, of another length than most of the sample's, or that hold null or
non-finite components take no part; fewer candidates than k give fewer rows; ties go to the smaller id;
repeated (id, vector) rows count once; of an id with several vectors the best score counts, and it never finds its own
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import durable

FOUND = "query_id long, vec_id long, score double"
PLACED = "leaf int, block int, kind int, sub int, id long, vec binary, bound double, floor double"
CENTRE, ROW, QUERY = 0, 1, 2  # the order in which the kinds of a group stream past


@dataclass
class Tree:
    """Nodes in lists: centre, children (empty for leaves) and, for leaves, the leaf number."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    n_leaves: int = 0
    fans: list[np.ndarray | None] = field(default_factory=list)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        out = np.empty(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.fans[node]
            near = np.argmin((c * c).sum(1) - 2 * (x[rows] @ c.T), axis=1)
            todo += [(k, rows[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, float]]:
        """Leaves best bin first, each with the least value that the walk had come down to."""
        heap, reached = [(-np.inf, 0)], np.inf
        while heap:
            value, node = heapq.heappop(heap)
            reached = min(reached, -value)
            kids = self.children[node]
            if kids:
                for k, v in zip(kids, self.fans[node] @ q, strict=True):
                    heapq.heappush(heap, (-float(v), k))
            else:
                yield self.leaf[node], reached

    def pack(self) -> None:
        """Centres of each node's children as one matrix."""
        self.fans = [np.stack([self.centres[k] for k in kids]) if kids else None for kids in self.children]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """Labels of Lloyd's algorithm from k distinct rows; fewer labels where there are fewer distinct rows."""
    c = np.unique(x[rng.choice(len(x), min(len(x), 4 * k), replace=False)], axis=0)
    c = c[rng.permutation(len(c))[:k]]
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(steps):
        label = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(label, minlength=len(c))
        total = (label == np.arange(len(c))[:, None]).astype(np.float64) @ x
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return label


def build_tree(x: np.ndarray, leaf_rows: int, branching: int = 8, seed: int = 2) -> Tree:
    """Splits nodes until none holds more than leaf_rows of the sample (or its rows are all the same)."""
    rng = np.random.default_rng(seed)
    tree = Tree()

    def add(rows: np.ndarray) -> int:
        node = len(tree.centres)
        tree.centres.append(x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1]))
        tree.children.append([])
        tree.leaf.append(-1)
        parts = []
        if len(rows) > leaf_rows:
            label = kmeans(x[rows], min(branching, -(-len(rows) // leaf_rows) + 1), rng)
            parts = [rows[label == i] for i in np.unique(label)]
        if len(parts) > 1:
            for p in parts:
                tree.children[node].append(add(p))
        else:
            tree.leaf[node] = tree.n_leaves
            tree.n_leaves += 1
        return node

    add(np.arange(len(x)))
    tree.pack()
    return tree


def sums_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, components added first to last, so equal vectors score equally everywhere."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def best_of_block(qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows of a block (ties to the smaller id) that reach its bound: query numbers, row numbers, scores."""
    rows, cols = [], []
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ x.T
        scores[ids[None, :] == qids[at : at + 256, None]] = -np.inf
        least = bounds[at : at + 256].copy()
        if scores.shape[1] > k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            least = np.maximum(least, kth - 1e-9 * np.maximum(1.0, np.abs(kth)))
        r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        rows.append(r + at)
        cols.append(c)
    row, col = (np.concatenate(v) if v else np.empty(0, dtype=np.int64) for v in (rows, cols))
    score = sums_in_order(q[row], x[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k], score[nth < k]


@dataclass
class Searcher:
    """What queries need to be routed: the upper tree, a sample for bounds, the calibrated margins and the rows of each cell."""

    tree: Tree
    sample: np.ndarray
    sample_ids: np.ndarray
    k: int
    margin: float = np.inf
    leaf_margin: float = np.inf
    held: dict[int, int] = field(default_factory=dict)
    block: int = 32768

    @property
    def width(self) -> int:
        return self.sample.shape[1]

    def blocks(self, cell: int) -> int:
        return -(-self.held.get(cell, 0) // self.block)

    def in_sample(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Lower bound of each query's k-th score, its k-th best in the sample without itself (none: -inf), and the best themselves."""
        row, col, score = best_of_block(ids, x, np.full(len(x), -np.inf), self.sample_ids, self.sample, self.k)
        out = np.full(len(x), -np.inf)
        full = np.bincount(row, minlength=len(x)) >= self.k
        least = np.full(len(x), np.inf)
        np.minimum.at(least, row, score)
        out[full] = least[full] - 1e-9 * np.maximum(1.0, np.abs(least[full]))
        return out, (row, self.sample_ids[col], score)

    def cells(self, q: np.ndarray, floor: float) -> list[int]:
        """Cells down to the floor, best bin first."""
        out = []
        for cell, reached in self.tree.walk(q):
            if reached < floor:
                break
            out.append(cell)
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows that take part, vectors as bytes of doubles: no nulls, all components finite, not all zero."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [np.asarray(v, dtype=np.float64) for v in pdf["vec"]]
            fine = np.array([bool(v.any() and np.isfinite(v).all()) for v in found], dtype=bool)
            yield pd.DataFrame({"id": pdf["id"][fine], "vec": [v.tobytes() for v, ok in zip(found, fine, strict=True) if ok]})

    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return given.filter("id IS NOT NULL AND vec IS NOT NULL").mapInPandas(run, "id long, vec binary")


def merged_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids: no query can return more of them."""
    w = Window.partitionBy("vec").orderBy("id")
    return rows.dropDuplicates(["vec", "id"]).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k + 1).drop("__n")


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, width) if len(column) else np.empty((0, width))


def some_of(rows: DataFrame, n: int, most: int, seed: int) -> pd.DataFrame:
    """The at most ``most`` of n rows with the smallest hashes of their ids; no task holds many more than that."""
    order = F.xxhash64(F.lit(seed), "id")
    if n > 4 * most:  # the smallest hashes lie below this limit but once in very many cases, in which there are a few fewer
        rows = rows.filter(order < F.lit(int(-(2**63) + 2**64 * 2 * most / n)))
    return rows.orderBy(order, "id", "vec").limit(most).toPandas()


def fit(rows: DataFrame, n: int, k: int, max_sample: int, cell_rows: int, block: int, seed: int) -> Searcher | None:
    """Sample and upper tree; None without rows."""
    some = some_of(rows, n, max_sample, seed)
    if not len(some):
        return None
    lengths = some["vec"].map(len)
    some = some[lengths == lengths.mode()[0]]
    x = _matrix(some["vec"], len(some["vec"].iloc[0]) // 8)
    cells = max(1, -(-n // cell_rows))
    tree = build_tree(x, max(8, -(-len(x) // cells)), seed=seed)
    few = min(len(x), -(-n // 4))  # a quarter of a small table gives bounds that some 4 k rows reach, so that its tree is searched
    return Searcher(tree, x[:few], some["id"].to_numpy()[:few], k, block=block)


def index_rows(rows: DataFrame, s: Searcher, leaf_rows: int) -> DataFrame:
    """All rows by cell, block and leaf, and the centres of the leaves, as PLACED rows; counts the rows of cells."""
    width, tree = s.width, s.tree

    def descend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(leaf=tree.assign(_matrix(pdf["vec"], width)))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = _matrix(pdf["vec"], width)
        inner = build_tree(x, leaf_rows, branching=16)
        sub = inner.assign(x)
        at = np.unique(sub)
        centres = [x[sub == i].mean(axis=0).tobytes() for i in at]
        both = {"kind": [CENTRE] * len(at) + [ROW] * len(x), "sub": np.append(at, sub), "id": np.append(at, pdf["id"]), "vec": centres + list(pdf["vec"])}
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[0], "block": pdf["block"].iloc[0], **both, "bound": np.nan, "floor": np.nan})

    placed = durable(rows.filter(F.octet_length("vec") == 8 * width).mapInPandas(descend, "id long, vec binary, leaf int"))
    s.held = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row per cell
    blocks = placed.sparkSession.createDataFrame([(c, s.blocks(c)) for c in s.held] or [(0, 1)], "leaf int, blocks int")
    placed = placed.join(F.broadcast(blocks), "leaf")
    placed = placed.select("leaf", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "vec")
    return durable(placed.groupBy("leaf", "block").applyInPandas(split, PLACED))


def calibrate(indexed: DataFrame, s: Searcher, qids: np.ndarray, q: np.ndarray, recall: float) -> None:
    """Sets the margins at which the leaves visited hold ``recall`` of the calibration queries' true neighbours."""
    bounds, _ = s.in_sample(qids, q)
    width, k = s.width, s.k

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            row, col, score = best_of_block(qids, q, bounds, pdf["id"].to_numpy(), _matrix(pdf["vec"], width), k)
            yield pd.DataFrame({"query": row, "vec_id": pdf["id"].to_numpy()[col], "score": score, **{c: pdf[c].to_numpy()[col] for c in ("leaf", "block", "sub")}})

    near = indexed.filter(F.col("kind") == ROW).mapInPandas(run, "query int, vec_id long, score double, leaf int, block int, sub int")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    truth = durable(near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("query", "leaf", "block", "sub"))
    # at most k rows for each calibration query
    centres = indexed.filter(F.col("kind") == CENTRE).join(F.broadcast(truth), ["leaf", "block", "sub"]).select("query", "leaf", "vec").toPandas()
    if not len(centres) or not np.isfinite(bounds).all():
        return
    at = centres["query"].to_numpy()
    upper = np.empty(len(at))
    for i, cells in centres.groupby("query")["leaf"]:
        reached = dict(s.tree.walk(q[i]))
        upper[cells.index] = [bounds[i] - reached[c] for c in cells]
    inner = bounds[at] - (q[at] * _matrix(centres["vec"], width)).sum(axis=1)
    # the upper walk may lose a third of what may be lost, the leaves the rest
    s.margin = float(np.sort(upper)[min(len(upper) - 1, int(np.ceil((1 - (1 - recall) / 3) * len(upper))))])
    inner = np.sort(np.where(upper <= s.margin, inner, np.inf))
    s.leaf_margin = float(inner[min(len(inner) - 1, int(np.ceil(recall * len(inner))))])


def meet(s: Searcher):
    """A function over the frames of groups in order (centres by leaf, rows by leaf, queries) to what the queries find there."""
    width, k = s.width, s.k

    def search(centres: np.ndarray, subs: np.ndarray, x: np.ndarray, row_subs: np.ndarray, ids: np.ndarray, asked: pd.DataFrame) -> pd.DataFrame:
        qids, q = asked["id"].to_numpy(), _matrix(asked["vec"], width)
        bound, floor = asked["bound"].to_numpy(), asked["floor"].to_numpy()
        wanted = q @ centres.T >= floor[:, None]
        first = np.searchsorted(row_subs, subs)
        last = np.searchsorted(row_subs, subs, side="right")
        rows, cols, found = [], [], []
        for i in range(len(subs)):
            mine = np.flatnonzero(wanted[:, i])
            scores = q[mine] @ x[first[i] : last[i]].T
            r, c = np.nonzero(scores >= bound[mine][:, None])
            rows.append(mine[r])
            cols.append(c + first[i])
            found.append(scores[r, c])
        row, col = np.concatenate(rows), np.concatenate(cols)
        other = qids[row] != ids[col]
        row, col, score = row[other], col[other], np.concatenate(found)[other]
        # the k best as these products have it, with a little more for ties, then exactly
        order = np.lexsort((-score, row))
        row, col, score = row[order], col[order], score[order]
        begin = np.searchsorted(row, row)
        nth = np.arange(len(row)) - begin
        kth = score[np.minimum(begin + k - 1, np.searchsorted(row, row, side="right") - 1)] if len(row) else score
        near = (nth < k) | (score >= kth - 1e-9 * np.maximum(1.0, np.abs(kth)))
        row, col = row[near], col[near]
        score = sums_in_order(q[row], x[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"query_id": qids[row[best]], "vec_id": ids[col[best]], "score": score[best]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, ready = None, {}, None
        for pdf in frames:
            keys = pdf[["leaf", "block", "kind"]].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(pdf)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                some, kind = pdf.iloc[a:b], keys[a][2]
                if at != (keys[a][0], keys[a][1]):
                    at, parts, ready = (keys[a][0], keys[a][1]), {CENTRE: [], ROW: []}, None
                if kind != QUERY:
                    parts[kind].append((some["sub"].to_numpy(), _matrix(some["vec"], width), some["id"].to_numpy()))
                    continue
                if ready is None and parts[ROW]:
                    subs, centres, _ = (np.concatenate(v) for v in zip(*parts[CENTRE], strict=True))
                    row_subs, x, ids = (np.concatenate(v) for v in zip(*parts[ROW], strict=True))
                    ready = (centres, subs, x, row_subs, ids)
                if ready is not None:
                    for i in range(0, len(some), 1024):
                        yield search(*ready, some.iloc[i : i + 1024])

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    max_sample: int = 16384,
    cell_rows: int = 2048,
    leaf_rows: int = 64,
    calibration: int = 256,
    block: int = 32768,
    seed: int = 2,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which ``is_query`` (over its id, named ``id``) holds."""
    spark = vectors.sparkSession
    given = usable(vectors, id_col, vec_col)
    rows = durable(merged_copies(given, k))
    queries = usable(vectors.filter(F.col(id_col).isNotNull()).withColumn("id", F.col(id_col).cast("long")).filter(is_query), id_col, vec_col)
    queries = queries.dropDuplicates(["id", "vec"])
    s = fit(rows, rows.count(), k, max_sample, cell_rows, block, seed)
    if s is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = s.width
    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bounds, (row, ids, score) = s.in_sample(pdf["id"].to_numpy(), _matrix(pdf["vec"], width))
            ends = np.searchsorted(row, np.arange(1, len(pdf)))
            yield pdf.assign(bound=bounds, near=np.split(ids, ends), scores=np.split(score, ends))

    asked = queries.filter(F.octet_length("vec") == 8 * width)
    asked = durable(asked.mapInPandas(bounded, "id long, vec binary, bound double, near array<long>, scores array<double>"))
    indexed = index_rows(rows, s, leaf_rows)
    some = some_of(asked.select("id", "vec"), asked.count(), calibration, seed + 1)
    if len(some):
        calibrate(indexed, s, some["id"].to_numpy(), _matrix(some["vec"], width), recall)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x, bounds = _matrix(pdf["vec"], width), pdf["bound"].to_numpy()
            out = [(i, cell, b) for i in range(len(x)) for cell in s.cells(x[i], bounds[i] - s.margin) for b in range(s.blocks(cell))]
            at = np.array([o[0] for o in out], dtype=np.int64)
            key = {"leaf": [o[1] for o in out], "block": [o[2] for o in out], "kind": QUERY, "sub": 0}
            yield pd.DataFrame({**key, "id": pdf["id"].to_numpy()[at], "vec": pdf["vec"].to_numpy()[at], "bound": bounds[at], "floor": bounds[at] - s.leaf_margin})

    together = indexed.unionByName(asked.select("id", "vec", "bound").mapInPandas(route, PLACED))
    together = together.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind", "sub")
    sampled = asked.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "scores")).alias("s")).select("query_id", F.col("s.near").alias("vec_id"), F.col("s.scores").alias("score"))
    found = together.mapInPandas(meet(s), FOUND).withColumn("visited", F.lit(1)).unionByName(sampled.withColumn("visited", F.lit(0)))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("visited").alias("visited"))
    # a handful of rows for each query: k of a block at most, of which few reach the bound
    best = best.withColumn("n", F.sum("visited").over(Window.partitionBy("query_id"))).filter((F.col("visited") == 1) | (F.col("n") < k))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
