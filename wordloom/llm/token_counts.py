"""Token counts through a cache of digests.

A text is normalised (line ends become newlines, white space at its end goes) and
digested; the tokenizer's version is the digest of its vocabulary and pattern.
Counts stored under both digests are joined to the documents. Of the texts whose
digests the cache does not hold, each distinct one is encoded once, and its count
is appended to the cache, so that the next run finds it.

The cache is a Parquet table (digest, version, n_tokens) in a folder all
executors share. Appending is Spark's own committed write: a lost executor leaves
no half-written rows. Two runs at once may append the same digest; equal rows
count once.

Defined cases: a null text has a null count, an empty one 0; rows repeat their
counts; rows without a doc_id are counted too, and so are several texts of one. Texts
of any length are encoded whole. Only doc_id and text are read, whatever the names
of other columns. An empty table appends nothing.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import regex
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, VOCABULARY, vocabulary
from .common import lean, shared_dir, small_side, written

CACHE = "digest binary, version string, n_tokens long"
#: Words whose counts one task remembers; beyond, it starts anew.
REMEMBERED = 1_000_000


def version(path: str = VOCABULARY) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + PATTERN.encode()).hexdigest()


def normalised(text: Column) -> Column:
    return F.rtrim(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" \t\n"))


def _counter(spark: SparkSession, path: str):
    # the driver reads the vocabulary; tasks need not have the file
    state, ranks = {}, spark.sparkContext.broadcast(vocabulary(path))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        if not state:
            whole = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})

            class Known(dict):
                def __missing__(self, word: str) -> int:
                    self[word] = n = len(whole.encode_ordinary(word))
                    return n

            state["known"], state["find"] = Known(), regex.compile(PATTERN).findall
        known, find, out = state["known"], state["find"], []
        for text in texts:
            text = text.as_py()
            out.append(None if text is None else sum(map(known.__getitem__, find(text))))
            if len(known) > REMEMBERED:
                known.clear()
        return pa.array(out, pa.int64())

    return count


def read_cache(spark, path: str) -> DataFrame:
    """What is stored; nothing where no run has stored anything yet."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def counted(docs: DataFrame, cache_path: str, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs; appends the new counts to the cache."""
    spark, now = docs.sparkSession, version(path)
    texts = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    keyed = written(texts.select("doc_id", digest.alias("digest")), "digests")
    stored = read_cache(spark, cache_path).where(F.col("version") == now).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    distinct = keyed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    misses = written(distinct.join(stored, "digest", "left_anti"), "misses")
    # all rows but the first of each missing digest need no encoding: they are fewer than the texts
    skip = keyed.join(misses.withColumnRenamed("first", "encoded"), "digest", "left").where("encoded is null or doc_id <> encoded").select("doc_id", "digest").distinct()
    skip = written(skip, "skipped")
    skip = small_side(skip, skip.count())
    fresh = texts.where("text is not null").withColumn("digest", digest).join(skip, ["doc_id", "digest"], "left_anti")
    # rows that repeat a doc_id repeat its digest
    new = fresh.select("digest", _counter(spark, path)("text").alias("n_tokens")).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    if not misses.isEmpty():
        new.select("digest", F.lit(now).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)

    known = read_cache(spark, cache_path).where(F.col("version") == now).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(known, "digest", "left").select("doc_id", "n_tokens")


def counted_twice(docs: DataFrame, cache_path: str) -> DataFrame:
    """counted() again after a first run has filled the cache: nothing is encoded then, and nothing appended."""
    written(counted(docs, cache_path), "counts")
    return counted(docs, cache_path)


def new_cache(spark) -> str:
    """A place in the shared folder for a cache that begins empty."""
    return f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
