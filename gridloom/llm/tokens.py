"""Token counts behind a digest cache.

The key of a count is (SHA-256 of the normalised text, SHA-256 of the tokenizer's file and name of its
library). Normalisation only turns a null text into the empty one: a byte-level tokenizer's counts depend on
every byte. Digests, which are narrow, are joined to the stored counts first; each distinct missing text is encoded once,
stored ones do not move, and the new counts are appended to the cache, a parquet table in the shared folder; the documents' digests are then
joined to the whole cache. Byte-level tokenizers encode the pieces of a fixed pattern one by one, so the encoder
remembers the counts of pieces, each of which the library has encoded, for texts whose split is beyond doubt.

Copies of a text meet by digest: they are merged before the shuffle, so a large group of copies ships one
text per task. The table of counts is joined by sort-merge (or broadcast where Spark knows it is small).

Edge cases: null and empty texts have 0 tokens and 0 bytes; repeated rows each get a row; an empty table
gives an empty result; special tokens' strings inside a text count as the library's default has it; other
columns of the input are ignored. Appending twice (two runs at once) can store a key twice, always with
the same count, so the read side takes one per key.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_IDS
from gridloom.session import durable

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
BATCH_BYTES = 4_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer: its file's bytes and its library."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def _counter(path: str):
    """Counts of a list of texts, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return _by_pieces(whole, [t["content"] for t in spec.get("added_tokens", [])]) if _splits_by_pattern(spec) else whole


def _splits_by_pattern(spec: dict) -> bool:
    """Whether a tokenizer encodes the pieces of the usual byte-level pattern one by one, so that counts of pieces add up."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = spec.get("normalizer") is None and not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", []))
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return plain and byte_level and model.get("type") == "BPE" and not model.get("dropout")


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[\\t\\n -~{LETTERS}]*")
PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
MOST_PIECES = 500_000


def _by_pieces(whole: Callable[[list[str]], list[int]], special: list[str]) -> Callable[[list[str]], list[int]]:
    """Counts through a bounded memo of pieces, each encoded by the library.

    Only for texts of printable ASCII, tabs, line ends and Latin-1 letters, where classes of characters are beyond
    doubt, and without special strings; all others go to the library whole."""
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        out: list[int | None] = [None] * len(texts)
        pieces = {i: PIECES.findall(t) for i, t in enumerate(texts) if PLAIN.fullmatch(t) and not any(x in t for x in special)}
        if len(known) > MOST_PIECES:
            known.clear()
        fresh = list(set().union(*pieces.values()) - known.keys())
        known.update(zip(fresh, whole(fresh), strict=True))
        for i, p in pieces.items():
            out[i] = sum(map(known.__getitem__, p))
        rest = [i for i, n in enumerate(out) if n is None]
        for i, n in zip(rest, whole([texts[i] for i in rest]), strict=True):
            out[i] = n
        return out

    return count


def digested(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("__text", text).withColumn("__digest", F.unhex(F.sha2(text, 256)))


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent table is an empty one."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def encode_misses(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, text) rows to (digest, n_tokens), in batches of bounded size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(tokenizer)
        for pdf in frames:
            out, batch, n = [], [], 0
            for t in pdf["text"]:
                batch.append(t)
                n += len(t)
                if n > BATCH_BYTES:
                    out += count(batch)
                    batch, n = [], 0
            out += count(batch) if batch else []
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": out})

    return texts.mapInPandas(run, "digest binary, n_tokens long")


def missing_texts(rows: DataFrame, misses: DataFrame) -> DataFrame:
    """(digest, text) of each digest of ``misses``; texts whose counts are stored do not move.

    Up to BROADCAST_IDS digests are broadcast, so that other texts are left out before the copies of a text are merged; more meet
    the merged texts, which then lie where the digests do. Both give the same."""
    texts = rows.select(F.col("__digest").alias("digest"), "__text")
    if misses.count() <= BROADCAST_IDS:
        return texts.join(F.broadcast(misses), "digest", "left_semi").groupBy("digest").agg(F.first("__text").alias("text"))
    return texts.groupBy("digest").agg(F.first("__text").alias("text")).join(misses, "digest", "left_semi")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; appends what it had to encode to ``cache``.

    ``tokenizer`` is a path that every executor has; ``cache`` is a folder that all of them share."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    rows = digested(docs)
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest")
    misses = durable(rows.select(F.col("__digest").alias("digest")).distinct().join(known, "digest", "left_anti"))
    encode_misses(missing_texts(rows, misses), tokenizer).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    narrow = rows.select("doc_id", F.col("__digest").alias("digest"), F.octet_length("__text").cast("long").alias("n_bytes"))
    return narrow.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
