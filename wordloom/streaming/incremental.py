"""Random indexing over a stream of documents.

Term vectors are sums, so a model may grow by batches: each micro-batch of new documents
gives its own sums (object, dim, val), which are written under the batch's number. A
batch that is tried again after a failure overwrites its own folder, so nothing counts
twice. The model is the sum of all batches; compacting replaces them by their sum.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus, models

SUMS = "object string, dim int, val double"


def batch_sums(docs: DataFrame, space: models.Space) -> DataFrame:
    """The sums of one batch over all its terms; which terms count is decided when the model is read."""
    tf = corpus.postings(docs).withColumnRenamed("term", "object")
    return models.summed(models.elemental(tf, F.col("doc_id"), space), F.col("tf") * F.col("sign"))


def train(docs: DataFrame, path: str, checkpoint: str, space: models.Space, available_now: bool = True) -> StreamingQuery:
    """Starts a stream of documents (doc_id, text) into the model at a path of the shared folder."""
    def add(batch: DataFrame, number: int) -> None:
        batch_sums(batch, space).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sums(spark: SparkSession, path: str) -> DataFrame:
    """(object, dim, val): the sum of all batches; nothing where there are none yet."""
    try:
        found = spark.read.schema(SUMS).parquet(f"{path}/batch=*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], SUMS)
    return found.groupBy("object", "dim").agg(F.sum("val").alias("val"))


def model(spark: SparkSession, path: str) -> DataFrame:
    """The normalised term vectors of all documents so far."""
    return models.normalised(sums(spark, path))
