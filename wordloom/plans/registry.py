"""What the modules of registered queries share: the two books, and tables in the forms that queries take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, matrices, models, slabs
from ..sources.shared import written
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPACE = models.Space(S.DIM, S.SEED)


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def coo(df: DataFrame) -> DataFrame:
    return df.select("object", "dim", rounded(F.col("val")).alias("val"))


def space(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Postings and vocabulary of the documents."""
    return models.corpus_space(table(spark, d, "documents"), S.LEAST)


def weights(spark: SparkSession, d: str, kind: str = "idf") -> DataFrame:
    tf, vocabulary = space(spark, d)
    n = tf.agg(F.count_distinct("doc_id").alias("n"))
    return vocabulary.crossJoin(F.broadcast(n)).select("term", T.global_weight(kind, F.col("gf"), F.col("df"), F.col("n")).alias("weight"))


def numbered(spark: SparkSession, d: str) -> slabs.Vocabulary | None:
    """The documents' vocabulary by number, with idf weights; None where ids repeat or it is too large to be held by every task."""
    docs = table(spark, d, "documents")
    if not slabs.unrepeated(docs):
        return None
    counted = written(slabs.counts(docs), "counts")
    kept = corpus.filtered(counted, S.LEAST, min_length=2)
    if kept.count() > slabs.MOST_TERMS:
        return None
    n = docs.where(F.lower("text").rlike(r"\p{L}")).count()
    return slabs.vocabulary(kept, T.global_weight("idf", F.col("gf"), F.col("df"), F.lit(n)), models.places(F.col("term"), SPACE))


#: How term vectors come about: from the documents' elemental vectors.
ELEMENTAL = matrices.Documents("elemental", SPACE)


def indexed(spark: SparkSession, d: str) -> matrices.Index | None:
    """The documents' packed postings; None where numbered() is or the terms' matrix is too large to be held by every task."""
    held = numbered(spark, d)
    if held is None or len(held.words) > matrices.MOST_TERMS:
        return None
    return matrices.index(table(spark, d, "documents"), held)


def terms(spark: SparkSession, d: str) -> DataFrame:
    ix = indexed(spark, d)
    if ix is not None:
        return matrices.terms(ix, ELEMENTAL)
    tf, vocabulary = space(spark, d)
    return models.normalised(models.term_vectors(tf, vocabulary, SPACE))


def weighted_terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The term vectors as a store, written once, and the terms' weights."""
    ix = indexed(spark, d)
    if ix is None:
        return models.dense(terms(spark, d), SPACE), weights(spark, d)
    found = written(matrices.term_store(ix, ELEMENTAL), "store")
    return found.select("object", "vec"), found.select(F.col("object").alias("term"), "weight")


def store(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("object"), F.col("embedding").cast("array<double>").alias("vec"))


def pairs_of_store(spark: SparkSession, d: str) -> DataFrame:
    """Each row beside the row of the next object: (object, a, b)."""
    s = store(spark, d)
    return s.withColumnRenamed("vec", "a").join(s.select((F.col("object") - 1).alias("object"), F.col("vec").alias("b")), "object")


def entries(df: DataFrame, vec: Column, digits: int = 6) -> DataFrame:
    """(object, i, val) of an array, the form that both engines hash alike."""
    return df.select("object", F.posexplode(vec).alias("i", "val")).select("object", "i", (F.round(F.col("val").cast("double"), digits) + F.lit(0.0)).alias("val"))
