r"""Line dedup by content-defined chunks.

A text's lines (split at ``\n``) are hashed; a rolling polynomial hash over each line and its
predecessor decides whether a chunk ends there, so boundaries depend on nearby content only and find
each other again after an insertion. Chunks of two or more lines, and single lines of 50 or more words, that
occur more than once anywhere in the corpus are removed from all places but the first (smallest doc_id, then
earliest chunk). Candidates are found by 64-bit hashes; the texts of those that share a hash are then compared
byte by byte by grouping on the text itself.

DataFrame functions only. Shuffled are narrow chunk rows, each document's text once (the same exchange
serves the comparison and the result) and the texts of repeated chunks, merged before the shuffle, so that a
chunk that stands in a third of all documents ships one text per task for the comparison; the joins on chunk
hashes and texts are sort-merge joins, whose hot partitions adaptive execution splits.

``dedup_passages`` (query op1_passage_dedup) also removes every later occurrence of any run of adjacent lines that
holds 50 words or more, whatever stands around it. Beside the chunks its candidates are, for every line with words, the
shortest run of 50 words that begins with it and the one that ends with it: they depend on the run's own lines
only, and those inside a repeated run cover all its lines. (Blank lines at its ends or between two lines
of 50 words may stay.) Its candidates overlap, so SHA-256 digests are compared in place of texts. Where an occurrence
overlaps the first one, the lines of the first stay.

Edge cases: a null text stays null with 0 lines; an empty text is one empty line and is kept; rows with equal
doc_id and text count as one document and come out alike; null doc_ids sort first; empty tables give an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647
BASE = 1103515245
DIVISOR = 3  # one boundary in so many lines on average
LONG_LINE_WORDS = 50


def _line_numbers(lines: Column) -> Column:
    """31-bit hashes of lines."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % PRIME)


def with_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Adds lines and chunks (array of chunk, start, n: number of the chunk, its first line and its count of lines)."""
    out = docs.withColumn("lines", F.split("text", "\n", -1)).withColumn("__h", _line_numbers(F.col("lines")))
    last = F.size("__h") - 1

    def is_end(i: Column) -> Column:
        before = F.coalesce(F.get("__h", i - 1), F.lit(0))
        return (i == last) | ((before * F.lit(BASE) + F.get("__h", i)) % F.lit(PRIME) % F.lit(divisor) == 0)

    out = out.withColumn("__ends", F.filter(F.sequence(F.lit(0), last), is_end))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("__ends", 1, F.size("__ends") - 1), lambda e: e + 1))
    out = out.withColumn("__starts", starts)
    spans = F.transform("__ends", lambda e, i: F.struct(i.alias("chunk"), F.get("__starts", i).alias("start"), (e - F.get("__starts", i) + 1).alias("n")))
    return out.withColumn("chunks", spans).drop("__h", "__ends", "__starts")


def _keyed(docs: DataFrame) -> DataFrame:
    # 128 bits stand for a row; one key for both joins on it, so that its texts are shuffled once
    return docs.select("doc_id", "text", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id").alias("b")).alias("rk"))


def _chunk_text(lines: str, at: Column) -> Column:
    return F.array_join(F.slice(lines, at["start"] + 1, at["n"]), "\n")


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Chunks to remove, from (doc_id, text, rk) rows: rk, gone (array of chunk, start, n)."""
    chunked = with_chunks(docs.filter(F.col("text").isNotNull()), divisor)
    worth = F.filter(
        "chunks",
        lambda c: (c["n"] > 1) | (F.regexp_count(F.get("lines", c["start"]), F.lit(r"[^ \t]+")) >= LONG_LINE_WORDS),
    )
    hashed = chunked.withColumn("chunks", worth).select(
        "doc_id", "rk", F.explode(F.transform("chunks", lambda c: F.struct(c.alias("at"), F.xxhash64(_chunk_text("lines", c)).alias("h")))).alias("c")
    )
    hashed = hashed.select("doc_id", "rk", F.col("c.at").alias("at"), F.col("c.h").alias("h"))
    shared = hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    wanted = hashed.join(shared, "h").groupBy("rk").agg(F.collect_set("at").alias("cand"))
    texts = docs.join(wanted, "rk")
    texts = texts.withColumn("lines", F.split("text", "\n", -1)).select("doc_id", "rk", "lines", F.explode("cand").alias("at"))
    texts = texts.select("doc_id", "rk", "at", _chunk_text("lines", F.col("at")).alias("body"))
    # grouping and joining on the text itself compares bytes
    first = texts.groupBy("body").agg(F.min(F.struct("doc_id", "rk", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = texts.join(first, "body").filter(~F.struct("doc_id", "rk", "at").eqNullSafe(F.col("first")))
    return later.groupBy("rk").agg(F.collect_set("at").alias("gone"))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """One row per document: doc_id, n_lines, removed_chunks, removed_lines and the text without them."""
    rows = _keyed(docs)
    gone = repeated_chunks(rows, divisor)
    none = F.expr("cast(array() as array<struct<chunk: int, start: int, n: int>>)")
    out = rows.join(gone, "rk", "left").select("doc_id", "text", F.array_sort(F.coalesce("gone", none)).alias("gone"))
    out = out.withColumn("lines", F.split("text", "\n", -1)).withColumn("removed", F.aggregate("gone", F.lit(0), lambda n, c: n + c["n"]))

    def before(i: Column) -> Column:
        """The lines between the chunk removed before number i and that one (or the text's end)."""
        last = F.get("gone", i - 1)
        begin = F.when(i == 0, 0).otherwise(last["start"] + last["n"])
        end = F.coalesce(F.get("gone", i)["start"], F.size("lines"))
        return F.slice("lines", begin + 1, end - begin)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), before))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("removed_chunks"),
        F.col("removed").cast("long").alias("removed_lines"),
        F.when(F.col("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


def passages() -> Column:
    """Runs (start, n) of lines: for each line with words the shortest of LONG_LINE_WORDS that begins or ends with it. Needs __line_of."""
    of, last, reach = F.col("__line_of"), F.size("__line_of") - 1, LONG_LINE_WORDS - 1

    def run(p: Column, q: Column) -> Column:
        return F.struct(F.get(of, p).alias("start"), (F.get(of, q) - F.get(of, p) + 1).alias("n"))

    begins = F.filter(F.sequence(F.lit(0), last - reach), lambda p: (p == 0) | (F.get(of, p - 1) != F.get(of, p)))
    ends = F.filter(F.sequence(F.lit(reach), last), lambda q: (q == last) | (F.get(of, q + 1) != F.get(of, q)))
    found = F.concat(F.transform(begins, lambda p: run(p, p + reach)), F.transform(ends, lambda q: run(q - reach, q)))
    return F.when(last >= reach, found).otherwise(F.expr("cast(array() as array<struct<start: int, n: int>>)"))


def repeated_passages(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Lines to remove, from (doc_id, text, rk) rows: rk, gone (array of first and last line)."""
    out = with_chunks(docs.filter(F.col("text").isNotNull()), divisor)
    words = F.transform("lines", lambda x, i: F.array_repeat(i, F.regexp_count(x, F.lit(r"[^ \t]+"))))  # a line's number for each of its words
    out = out.withColumn("__line_of", F.flatten(words)).withColumn("__h", F.transform("lines", lambda x: F.xxhash64(x)))
    short = F.transform(F.filter("chunks", lambda c: c["n"] > 1), lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n")))
    out = out.select("doc_id", "rk", "__h", F.array_distinct(F.concat(short, passages())).alias("runs"))
    # one line may stand in many runs, so a run is hashed by its lines' hashes
    hashed = out.select("rk", F.explode(F.transform("runs", lambda c: F.struct(c.alias("at"), F.xxhash64(F.slice("__h", c["start"] + 1, c["n"])).alias("h")))).alias("c"))
    hashed = hashed.select("rk", F.col("c.at").alias("at"), F.col("c.h").alias("h"))
    shared = hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    wanted = hashed.join(shared, "h").groupBy("rk").agg(F.collect_set("at").alias("cand"))
    texts = docs.join(wanted, "rk").withColumn("lines", F.split("text", "\n", -1))
    body = lambda c: F.unhex(F.sha2(_chunk_text("lines", c), 256))
    texts = texts.select("doc_id", "rk", F.explode(F.transform("cand", lambda c: F.struct(c.alias("at"), body(c).alias("body")))).alias("c"))
    texts = texts.select("doc_id", "rk", F.col("c.at.start").alias("start"), F.col("c.at.n").alias("n"), F.col("c.body").alias("body"))
    first = texts.groupBy("body").agg(F.min(F.struct("doc_id", "rk", "start")).alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    later = texts.join(first, "body").filter(~F.struct("doc_id", "rk", "start").eqNullSafe(F.col("first")))
    begin = F.when(F.col("rk") == F.col("first.rk"), F.greatest("start", F.col("first.start") + F.col("n"))).otherwise(F.col("start"))
    return later.groupBy("rk").agg(F.collect_set(F.struct(begin.alias("begin"), (F.col("start") + F.col("n") - 1).alias("end"))).alias("gone"))


def dedup_passages(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """One row per document: doc_id, n_lines, removed_lines and the text without repeated chunks and passages."""
    rows = _keyed(docs)
    none = F.expr("cast(array() as array<struct<begin: int, end: int>>)")
    out = rows.join(repeated_passages(rows, divisor), "rk", "left").select("doc_id", "text", F.coalesce("gone", none).alias("gone"))
    dropped = F.array_distinct(F.flatten(F.transform("gone", lambda c: F.sequence(c["begin"], c["end"]))))
    out = out.withColumn("lines", F.split("text", "\n", -1)).withColumn("dropped", dropped)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda i: F.get("lines", i))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("removed_lines"),
        F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
