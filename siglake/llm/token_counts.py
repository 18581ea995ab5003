"""Token counts by a digest cache.

Each text is reduced to the digest of its normalised content; counts are stored by that digest and the digest of the
tokenizer's file. A run joins its digests to the store, encodes one text of each distinct miss, appends the counts to the
store, and joins again. Normalising must not change a count: it lower-cases a text and turns ASCII white space into single
blanks, both of which the tokenizer does itself. Texts with `<|` (special strings are case-sensitive) or with characters
beyond Latin-1 stay as they are, for there a capital may compose with a mark where its small letter does not.

Null text: empty, zero bytes and tokens. Repeated rows and copies: one encoding, a row each. Empty tables give no rows.
Null doc_id: kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import small_batches, written
from siglake.llm.tokens import default_tokenizer_path, encoder, file_digest

LIMIT = 2048
STORE = "content string, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    """What decides the count, in passes that are only made over the texts that need them."""
    plain = ~text.contains("<|") & ((F.octet_length(text) == F.length(text)) | ~text.rlike("[^\\x00-\\xff]"))
    blank = F.lower(text)
    for mark in "\n\t\r\x0b\x0c":
        blank = F.replace(blank, F.lit(mark), F.lit(" "))
    single = F.trim(F.when(blank.contains("  "), F.regexp_replace(blank, "  +", " ")).otherwise(blank))
    return F.when(plain, single).otherwise(text)


def content_digest(text: Column) -> Column:
    """SHA-256 of what decides the count."""
    return F.sha2(normalised(text).cast("binary"), 256)


def stored(docs: DataFrame, store: str) -> DataFrame:
    """The store's rows, none if it isn't there yet."""
    spark = docs.sparkSession
    try:
        return spark.read.schema(STORE).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)


def token_counts(docs: DataFrame, store: str, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row. store: folder of the cache, appended to."""
    path = tokenizer or default_tokenizer_path()
    version = file_digest(path)
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    keyed = written(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("content"), F.xxhash64("text").alias("hash")), "token-keys")
    known = stored(docs, store).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    missed = keyed.groupBy("content").agg(F.min(F.struct("doc_id", "hash")).alias("first")).join(known, "content", "left_anti")
    wanted = missed.select(F.col("first.doc_id").alias("first"), F.col("first.hash").alias("hash"), "content").hint("shuffle_hash")
    texts = docs.withColumn("own", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("own") == F.col("hash")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            known: dict[str, int] = {}  # rows of one doc_id and text stand next to each other
            for content, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if content not in known:
                    known[content] = len(own.packed(t)) // 4
            n = [known[content] for content in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    texts.select("content", "text").mapInArrow(encode, STORE).dropDuplicates(["content"]).write.mode("append").parquet(store)
    # Written first, so that the join below has exchanges of its own on both sides: then many copies of one text can be split.
    counts = written(stored(docs, store).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
