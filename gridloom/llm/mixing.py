"""Mixing sources to target weights by a time-varying curriculum.

Each source has a linear weight schedule over training time u in [0, 1]. Its integral is the source's
weight, which fixes the source's share of the word budget; shares above ``cap`` times the source's size
stop there and the excess is dealt to the others by weight (water-filling, solved in closed form over the
sorted ratios). Documents of a source are put in a reproducible hash order; running word counts place each
occurrence of a document on its source's demand axis, and inverting the cumulative demand
``D(u) = target * (a u + (b - a) u^2 / 2) / ((a + b) / 2)`` gives its training position, by which the
result is range-sorted. The document that straddles the target is taken in part, so a source's taken words
equal its rounded target.

DataFrame code throughout. A source may hold any share of the rows: running sums are made within
(source, hash bucket) and only sums per bucket are added up per source.

Edge cases: null sources form one source, ordered last; null or blank texts have size 0 and are never
taken; repeated rows count as separate documents; an empty table gives an empty result; columns of the
input that clash with added ones are replaced, all others are kept, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import durable

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  # hex digits: 4096 buckets in each source
ADDED = ["size", "source_size", "target", "taken", "position", "positions"]


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """One row per source key from (skey, source, size): adds weight, source_size, target, rank.

    The table has one row per source, so its windows are small whatever the corpus' size."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("rank", F.row_number().over(w)).withColumn(
        "weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    all_rows = Window.partitionBy(F.lit(0))
    s = s.withColumn("__budget", F.lit(budget) * F.sum("source_size").over(all_rows)).withColumn("__cap", F.lit(cap) * F.col("source_size"))
    s = s.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    before = Window.partitionBy(F.lit(0)).orderBy("__ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("__level", left / free)
    # the level once all sources with smaller ratios are capped; the largest admissible one is the solution
    level = F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(all_rows)
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("weight"), F.col("__cap")))
    return s.withColumn("target", target).select("skey", "rank", "weight", "source_size", "target")


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    tilt: float = 0.5,
    seed: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The input's columns plus size, source_size, target, taken, position (of the first occurrence, null if
    not taken) and positions (of all). Sources of odd rank fade from (1 + tilt) to (1 - tilt) of their
    weight, those of even rank the other way round."""
    kept = [c for c in docs.columns if c not in ADDED]
    row = F.struct(*[F.col(c) for c in kept]).alias("__row")  # whatever its columns are called, a row stays as it is
    base = docs.select(row, *_measures(id_col, text_col, source_col, seed))
    return _placed(base, weights, budget, cap, tilt).select("__row.*", *ADDED)


def _measures(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """size, __source, __key (of the source), __order and __bucket of a row."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    source = F.col(source_col).cast("string")
    return [
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        source.alias("__source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("__key"),
        order.alias("__order"),
        F.substring(order, 1, BUCKET_DIGITS).alias("__bucket"),
    ]


def _placed(base: DataFrame, weights: Sequence[float], budget: float, cap: float, tilt: float) -> DataFrame:
    """The rows of ``base`` (columns of _measures and others of private names) with ADDED."""
    # a row for each source and bucket; kept, so that texts are read once for it and once for the plan
    buckets = durable(base.groupBy("__key", "__bucket").agg(F.sum("size").alias("__sum"), F.first("__source").alias("source")))
    sizes = buckets.groupBy(F.col("__key").alias("skey")).agg(F.sum("__sum").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes, weights, budget, cap)
    ahead = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("__start", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).select(
        F.col("__key").alias("skey"), F.col("__bucket").alias("sbucket"), "__start"
    )
    starts = starts.join(targets, "skey")
    within = Window.partitionBy("__key", "__bucket").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, (F.col("__key") == F.col("skey")) & (F.col("__bucket") == F.col("sbucket")))
    size, total = F.col("size"), F.col("source_size")
    goal = F.round("target").cast("long")
    passes = F.when(total > 0, F.floor(goal / total)).otherwise(F.lit(0)).cast("long")
    at = F.col("__start") + F.col("__before")
    part = F.greatest(F.lit(0), F.least(size, goal - passes * total - at))
    placed = placed.withColumn("taken", (passes * size + part).cast("long"))
    times = F.when(size > 0, passes + F.when(part > 0, 1).otherwise(0)).otherwise(0)
    a = F.col("weight") * F.when(F.col("rank") % 2 == 1, 1 + tilt).otherwise(1 - tilt)
    b = F.lit(2.0) * F.col("weight") - a

    def position(lap):
        area = (lap * total + at) / F.greatest(F.col("target"), F.lit(1e-9)) * F.col("weight")
        return F.least(F.lit(1.0), F.lit(2.0) * area / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + F.lit(2.0) * (b - a) * area))))

    laps = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))
    placed = placed.withColumn("positions", F.transform(laps, position))
    return placed.withColumn("position", F.when(F.size("positions") > 0, F.col("positions")[0]))


def mix_plan_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, tilt: float = 0.5, seed: int = 4) -> DataFrame:
    """One narrow row per document, range-sorted by training position: doc_id, size, source_size, target, taken, position.

    Texts are read once, to count their words."""
    base = durable(docs.select("doc_id", *_measures("doc_id", "text", "source", seed)))
    plan = _placed(base, weights, budget, cap, tilt)
    # documents that are not taken follow in a hash order, so that they do not share one place
    order = F.coalesce("position", F.lit(1.0) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20))
    out = plan.select("doc_id", "size", "source_size", "target", "taken", "position", order.alias("__place"))
    return out.repartitionByRange("__place").sortWithinPartitions("__place", "doc_id").drop("__place")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The training stream: each document once per occurrence in the mix, whole, in order of training position.

    A document that the target cuts through is kept whole. Columns are those of ``docs``."""
    names = [options.pop(f"{k}_col", d) for k, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))]
    settings = {"weights": (5, 2, 1), "budget": 1.5, "cap": 2.0, "tilt": 0.5, "seed": 4} | options
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    base = docs.select(row, *_measures(*names, settings.pop("seed")))
    plan = _placed(base, **settings).select("__row", F.explode("positions").alias("__position"))
    return plan.repartitionByRange("__position").sortWithinPartitions("__position").select("__row.*")
