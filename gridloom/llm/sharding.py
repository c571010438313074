"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get a global number in the order of ``order_by``; a keyed permutation of [0, N) maps the number
to a shuffled position p; ``shard = p mod n_shards`` and ``slot = p div n_shards``. Shard and slot of any
row number can be computed without reading the data, shard sizes differ by one row at most, and slots have
no gaps. Everything is DataFrame code: one range shuffle of the narrow rows, then codegen'd arithmetic.

Edge cases: an empty table gives an empty result; null or tied keys are legal (nulls sort first, wholly
equal rows are interchangeable); extra columns are carried along untouched unless they are called
``row_number``, ``shard`` or ``slot``, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import durable, shuffle_partitions

PRIME = 2147483647  # 2^31 - 1: residues below it multiply inside a signed 64-bit integer
SECOND_PRIME = 2147483629
ROUNDS = 6
MAX_WALK = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Multiplier, offset and second multiplier of each round, from SHA-256 of the seed."""
    out = []
    for i in range(rounds):
        d = hashlib.sha256(f"feistel:{seed}:{i}".encode()).digest()
        a, b, c = (int.from_bytes(d[k : k + 8], "big") for k in (0, 8, 16))
        out.append((a % (PRIME - 1) + 1, b % PRIME, c % (SECOND_PRIME - 1) + 1))
    return out


def domain(n: int) -> tuple[int, int]:
    """Smallest a x b grid over [0, n) with a = ceil(sqrt(n)); fewer than a cells lie outside [0, n)."""
    a = max(1, math.isqrt(n - 1) + 1) if n > 0 else 1
    return a, max(1, -(-n // a))


def permute_int(x: int, n: int, seed: int) -> int:
    """Where row number x of n goes: the permutation for one number in plain Python."""
    a, b = domain(n)
    while True:
        left, right = x // b, x % b
        for i, (mul, add, mix) in enumerate(round_keys(seed)):
            t = ((right if i % 2 == 0 else left) * mul + add) % PRIME * mix % SECOND_PRIME
            if i % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        x = left * b + right
        if x < n:
            return x


def once_sql(x: str, n: int, seed: int, div: str = "div") -> str:
    """One application of the Feistel network to the SQL integer expression ``x``."""
    a, b = domain(n)
    left, right = f"({x} {div} {b}L)", f"({x} % {b}L)"
    if div != "div":
        left, right = left.replace("L)", ")"), right.replace("L)", ")")
    for i, (mul, add, mix) in enumerate(round_keys(seed)):
        t = f"((({right if i % 2 == 0 else left} * {mul} + {add}) % {PRIME}) * {mix} % {SECOND_PRIME})"
        if i % 2 == 0:
            left = f"(({left} + {t}) % {a})"
        else:
            right = f"(({right} + {t}) % {b})"
    return f"({left} * {b} + {right})"


def permutation(row_number: str, n: int, seed: int) -> Column:
    """Spark expression of the permutation of [0, n): the network once, then cycle walking.

    A walk of over MAX_WALK steps (fewer than one in sqrt(n) numbers walk at all) raises an error."""
    first, again = once_sql(row_number, n, seed), once_sql("p", n, seed)
    return F.expr(
        f"CASE WHEN {first} < {n} THEN {first} ELSE aggregate(sequence(1, {MAX_WALK}), {first}, "
        f"(p, i) -> CASE WHEN p < {n} THEN p ELSE {again} END, "
        f"p -> CASE WHEN p < {n} THEN p ELSE raise_error('cycle walk too long: choose another seed') END) END"
    )


def number_rows(rows: DataFrame, order_by: Sequence[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Adds each row's rank (from 0) in the global order of ``order_by``; returns the rows and their count.

    Range-partitioned rows are written to the shared checkpoint folder once, so that the counts of the
    partitions and the rows themselves come from the same partitioning, also after a lost executor. Only
    one count per partition reaches the driver."""
    spark = rows.sparkSession
    keys = [F.col(c) for c in order_by]
    kept = durable(rows.drop(name).repartitionByRange(max(1, shuffle_partitions(spark)), *keys).sortWithinPartitions(*keys))
    kept = kept.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33).cast("int"))
    counts = sorted((r["__part"], r["n"]) for r in kept.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    at = spark.createDataFrame(starts, "__part int, __start long")  # one row per partition
    out = kept.join(F.broadcast(at), "__part").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1))
    return out.drop("__at", "__part", "__start"), total


def assign_shards(rows: DataFrame, n_shards: int, order_by: Sequence[str], seed: int = 9) -> DataFrame:
    """Adds ``row_number`` (long), ``shard`` (int) and ``slot`` (long) to the rows."""
    numbered, n = number_rows(rows.drop("shard", "slot"), order_by)
    if n == 0:
        return numbered.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    placed = numbered.withColumn("__p", permutation("row_number", n, seed))
    return placed.select(*numbered.columns, F.expr(f"cast(__p % {n_shards} as int)").alias("shard"), F.expr(f"__p div {n_shards}").alias("slot"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows for sharding: doc_id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32 (null: that of no bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 9) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null), row_number."""
    placed = assign_shards(measured(docs), n_shards, ["doc_id", "text_crc32", "size"], seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
