"""Near-duplicate documents by MinHash.

A document's set is its distinct shingles of five words (words are runs of bytes other than space and
\\t..\\r, with A-Z lower-cased; fewer words make one shingle; no words, no set). Steps:

1. documents with equal sets form a class, represented by its smallest doc_id;
2. each class has a signature of universal hash minima, cut into bands of 4, as many as miss a pair at the
   threshold with a probability of 1e-7 (22 bands for 0.85, 31 for 0.8); classes that agree in a band meet in a bucket;
3. in each bucket every class is paired with the smallest; pairs pass if enough of their signatures agree
   (about five standard deviations below the threshold) and are then confirmed on the full sets; confirmed links give
   components by alternating large-star and small-star;
4. buckets of three or more classes that now lie in several components are searched for the links that stars do
   not show. In small buckets all pairs across components whose signatures agree are confirmed. Classes of a
   large bucket are compared through its smallest class P: with D(A) what A and P don't share, 100 |A n B| >=
   t |A u B| means |D(A) - D(B)| + |D(B) - D(A)| <= H = (|A| + |B|) (100 - t) / (100 + t). Either
   |D(A)| + |D(B)| <= H, then both are linked to P itself, or the two share a shingle among the first
   H_max + 1 of their D in one fixed order (prefix filter), far enough to the front for the rest to add up
   (positional filter). In that order rare shingles come first, mostly edits that no other copy has, so copies that
   differ too much from each other hardly ever meet, though each resembles P;
5. components of all confirmed links are spread to the documents.

No group is gathered: stars are joins, copies of any number are one class, and the pairs of step 4 leave out
whatever is connected already. Texts are not shuffled while the classes that share a bucket are up to a million
(their ids are counted, then broadcast), and once beyond that; from then on only sets of those classes move.

Joins are sort-merge joins by hint: a broadcast, however small, is built in the driver's memory. Only counted ids are broadcast.

Small and large buckets (LARGE_BUCKET) are searched in different ways, both exact: the same classes end up connected.

Edge cases: null, empty and blank texts have n_shingles 0 and are their own component; a null doc_id gets no
component; repeated rows are one document (each row is returned); different texts of one doc_id are classes of their own,
each in its own component; thresholds are percentages from 40; an empty table gives an empty result; very long texts are hashed in pieces; columns other than doc_id and text are ignored by
near_duplicates and kept by drop_near_duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blank_separated, by_ids, shingle_hashes, text_key
from gridloom.llm.components import stars as stars_of
from gridloom.session import durable, kept_on_disk

ROWS = 4
WORDS = 5
LEAST_THRESHOLD = 40
LARGE_BUCKET = 64
COMMON = 32
PIECE = 1024


@lru_cache
def coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal hashes, as columns."""
    rng = np.random.default_rng(20240501)
    return (rng.integers(0, 2**31, (hashes, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)), rng.integers(0, 2**32, (hashes, 1), dtype=np.uint32)


def bands_for(threshold: int) -> int:
    """As few bands as miss a pair at the threshold (in percent) with a probability of at most 1e-7."""
    if not LEAST_THRESHOLD <= threshold < 100:
        raise ValueError(f"a threshold is a percentage from {LEAST_THRESHOLD} to 99")
    return math.ceil(math.log(1e-7) / math.log(1 - (threshold / 100) ** ROWS))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    return np.unique(shingle_hashes(blank_separated(text or "")[2], WORDS))


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of each of the first hashes a x + b mod 2^32 over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    multipliers, offsets = coefficients(hashes)
    least = np.full(hashes, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), PIECE):
        np.minimum(least, (multipliers * x[None, at : at + PIECE] + offsets).min(axis=1), out=least)
    return least


def set_digest(shingles: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums that stand for a set."""
    return len(shingles), int(shingles.sum(dtype=np.uint64).astype(np.int64)), int((shingles * (shingles | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64))


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, digest of the text (key), size and digest of the set (n, d1, d2) and signature of every row."""
    hashes = ROWS * bands

    @F.pandas_udf("n bigint, d1 bigint, d2 bigint, sig array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            sets = [shingle_set(text) for text in t]
            out = pd.DataFrame([set_digest(s) for s in sets], columns=["n", "d1", "d2"])
            yield out.assign(sig=[signature(s, hashes).view(np.int32) if len(s) else None for s in sets])

    return docs.select("doc_id", text_key().alias("key"), run("text").alias("s")).select("doc_id", "key", "s.*")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, size and digest of the set and the set of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sets = [shingle_set(t) for t in pdf["text"]]
            out = pd.DataFrame([set_digest(s) for s in sets], columns=["n", "d1", "d2"])
            yield out.assign(least=pdf["doc_id"].to_numpy(), set=[s.view(np.int64) for s in sets])

    return docs.select("doc_id", "text").mapInPandas(run, "least long, n long, d1 long, d2 long, set array<long>")


def _agree(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _buckets(reps: DataFrame, bands: int) -> DataFrame:
    """One row per class and band: id, band, key."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", ROWS * i + 1, ROWS)) for i in range(bands)])
    return reps.select("id", F.posexplode(keys).alias("band", "key"))


def _least_agreement(threshold: int) -> int:
    """Equal hashes that pairs at the threshold reach but once in millions: about five standard deviations below."""
    return (threshold - 20) * ROWS * bands_for(threshold) // 100


def _similar(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree well enough."""
    least = _least_agreement(threshold)
    left = reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(_agree("sig_a", "sig_b") >= least).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough: 100 |A n B| >= threshold |A u B|."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.filter(common.cast("long") * 100 >= union.cast("long") * threshold).select("a", "b")


def _across(open_rows: DataFrame, by: list[str], threshold: int) -> DataFrame:
    """All pairs in the same group ``by`` that lie in different components and whose signatures agree; a pair may repeat."""
    least = _least_agreement(threshold)
    left = open_rows.select(*by, F.col("id").alias("a"), F.col("component").alias("ca"), F.col("sig").alias("sig_a"))
    right = open_rows.select(*by, F.col("id").alias("b"), F.col("component").alias("cb"), F.col("sig").alias("sig_b"))
    met = left.join(right.hint("merge"), by).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (_agree("sig_a", "sig_b") >= least))
    return met.select("a", "b")


def _beyond_pivot(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of (head, id, component) rows that may be linked though not both to their head: exact, by prefix and positional filters on what each does not share with the head."""
    t = threshold
    heads = sets.select(F.col("id").alias("head"), F.col("set").alias("set_h"))
    rest = F.concat(F.array_except("set", "set_h"), F.array_except("set_h", "set"))
    d = members.join(sets.hint("merge"), "id").join(heads.hint("merge"), "head").select("head", "id", "component", F.size("set").cast("long").alias("n"), rest.alias("rest"))
    d = durable(d.repartition("head", "id"))
    # one order for all of a head's members: first what few of them have, then what COMMON or more have, rarest first
    counts = d.select("head", F.explode("rest").alias("shingle")).groupBy("head", "shingle").agg(F.count("*").alias("df")).filter(F.col("df") >= COMMON)
    counts = counts.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "shingle"))), lambda s: s["shingle"]).alias("common"))
    d = d.join(counts.hint("merge"), "head", "left").withColumn("common", F.coalesce("common", F.expr("cast(array() as array<bigint>)")))
    order = F.concat(F.array_except("rest", "common"), F.array_intersect("common", "rest"))
    # no partner is larger than n * 100 / t, so no more than this many shingles may differ
    most = F.floor(F.col("n") * (100 - t) * (100 + t) / ((100 + t) * t)).cast("int")
    d = d.select("head", "id", "component", "n", F.size("rest").cast("long").alias("size"), F.slice(order, 1, most + 1).alias("front")).repartition("head", "id")
    front = durable(d.select("head", "id", "component", "n", "size", F.posexplode("front").alias("at", "shingle")))
    other = front.select("head", "shingle", *[F.col(c).alias(f"{c}2") for c in ("id", "component", "n", "size", "at")])
    differ = F.floor((F.col("n") + F.col("n2")) * (100 - t) / (100 + t))
    common = (F.col("size") + F.col("size2") - differ) / 2
    reach = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    fits = (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * t) & (reach >= common)
    met = front.join(other.hint("merge"), ["head", "shingle"]).filter((F.col("id") < F.col("id2")) & (F.col("component") != F.col("component2")) & fits)
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def links(reps: DataFrame, docs: DataFrame, threshold: int, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """Links (a, b) between classes (id, least, n, d1, d2, sig), which connect the classes that confirmed links connect and no others.

    The links found through buckets' smallest classes are given as the stars of their components.
    ``keep`` holds the tables that are read several times for as long as the result is needed."""
    rows = _buckets(reps, bands_for(threshold))
    heads = rows.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("id").alias("head")).filter("m > 1")
    shared = keep(rows.join(heads.hint("merge"), ["band", "key"]))
    needed = durable(reps.drop("sig").join(shared.select("id").distinct().hint("merge"), "id"))
    n = needed.count()
    texts = by_ids(docs, needed.select(F.col("least").alias("doc_id")), "left_semi", n=n)
    # of rows with one doc_id and several texts those of the class
    sets = keep(by_ids(shingle_sets(texts), needed, "inner", ["least", "n", "d1", "d2"], n).select("id", "set").dropDuplicates(["id"]))
    stars = shared.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    found = stars_of(_confirmed(_similar(stars, reps, threshold), sets, threshold))
    first = found.withColumnRenamed("node", "id")
    labelled = shared.filter("m > 2").join(first.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = durable(labelled.select("band", "key", "m", "head", "id", "component"))
    mixed = labelled.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    # a bucket's smallest class has been compared with all others
    rest = durable(labelled.join(mixed.select("band", "key").hint("merge"), ["band", "key"], "left_semi").filter("id != head"))
    small = rest.filter(F.col("m") <= LARGE_BUCKET).join(reps.select("id", "sig").hint("merge"), "id")
    large = rest.filter(F.col("m") > LARGE_BUCKET).select("head", "id", "component").distinct()
    beyond = _similar(_beyond_pivot(large, sets, threshold), reps, threshold)
    more = _across(small, ["band", "key"], threshold).unionByName(beyond).distinct()
    return found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(_confirmed(more, sets, threshold))


def classes_of(signed: DataFrame) -> tuple[DataFrame, bool]:
    """Classes of equal sets: n, d1, d2, least (the smallest doc_id) and id, which is least or, where that has several sets, a number below all doc_ids for all but one of them.

    The second value tells whether there is such a number."""
    classes = durable(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("least")))
    first = classes.groupBy("least").agg(F.min(F.struct("n", "d1", "d2")).alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    if not first.count():
        return classes.withColumn("id", F.col("least")), False
    others = durable(classes.join(first, "least").filter(F.struct("n", "d1", "d2") != F.col("first")).drop("first"))
    below = classes.agg(F.min("least")).first()[0]
    named = others.select("n", "d1", "d2", (F.lit(below - 1) - F.monotonically_increasing_id()).alias("other"))
    return durable(classes.join(named, ["n", "d1", "d2"], "left").withColumn("id", F.coalesce("other", "least")).drop("other")), True


def labelled(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, key, n_shingles, component_id of every row."""
    signed = durable(signatures(docs, bands_for(threshold)))
    classes, numbered = classes_of(signed)
    rows = signed.filter("n > 0").join(classes.withColumnRenamed("least", "doc_id").hint("merge"), ["doc_id", "n", "d1", "d2"])  # by the class's own doc_id, so a class of many copies is no hot key
    with kept_on_disk() as keep:
        reps = keep(rows.select("id", F.col("doc_id").alias("least"), "n", "d1", "d2", "sig").dropDuplicates(["id"]))
        found = stars_of(links(reps, docs, threshold, keep))
    of = classes.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    if numbered:  # a component is called by the smallest doc_id of its classes, not by a number of theirs
        of = durable(of)
        names = of.groupBy("component").agg(F.min("least").alias("name"))
        of = of.join(names, "component").withColumn("component", F.col("name"))
    final = durable(of.select("n", "d1", "d2", F.col("component").alias("component_id")))
    out = signed.select("doc_id", "key", "n", "d1", "d2").join(final.hint("merge"), ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return labelled(docs, threshold).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The documents of which one stays of each group, the one of the smallest doc_id, with their columns as they are.

    Of several texts of that doc_id in the group the one with the smallest digest stays; texts of a doc_id that lie in different
    groups are decided each by itself. Of rows with the same doc_id and text one stays. Rows without a doc_id stay."""
    each = durable(labelled(docs, threshold).filter("doc_id IS NOT NULL").groupBy("doc_id", "key", "component_id", "n_shingles").agg(F.count("*").alias("m")))
    # a doc_id's texts in its own group; texts without words are in no group
    own = each.filter("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").agg(F.min("key").alias("first"), F.count("*").alias("texts")).filter("texts > 1")
    lost = each.filter("n_shingles > 0 AND doc_id != component_id").select("doc_id", "key")
    lost = lost.unionByName(each.filter("n_shingles > 0 AND doc_id = component_id").join(own, "doc_id").filter("key != first").select("doc_id", "key"))
    gone = durable(lost.withColumn("m", F.lit(0).cast("long")).unionByName(each.filter("m > 1").select("doc_id", "key", "m")).groupBy("doc_id", "key").agg(F.min("m").alias("m")))
    gone = gone.select(F.struct("doc_id", "key").alias("__row"), "m")
    marked = docs.withColumn("__row", F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key")))
    once = by_ids(marked, gone.select("__row"), "left_anti", "__row")
    repeated = by_ids(marked, gone.filter("m > 0").select("__row"), "left_semi", "__row").dropDuplicates(["__row"])
    return once.unionByName(repeated).select(*docs.columns)
