"""The vector index kept up to date: a batch job that resumes, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.glossary import missing_terms
from termloom.providers import Embedder, embed_column
from termloom.session import cut

_SCHEMA = "pos bigint, term string, embedding array<float>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index at a path; empty if nothing was written yet."""
    try:
        return spark.read.schema(_SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _SCHEMA)


def build_index(spark: SparkSession, glossary: DataFrame, path: str, embedder: Embedder, parallel: int = 4) -> int:
    """Append vectors of the terms that have none and return their number.

    Terms whose embedding failed stay missing, so the next run takes them up;
    a run that breaks off has written nothing or a whole append.
    """
    index = read_index(spark, path)
    todo = missing_terms(glossary, index)
    base = index.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("b")).first().b
    low = todo.agg(F.min("ord").alias("o")).first().o
    if low is None:
        return 0
    new = embed_column(todo, "term", embedder, parallel=parallel).filter("embedding is not null")
    # Embedded once: the written batch is counted and appended.
    batch = cut(new.select((F.lit(base) + F.col("ord") - F.lit(low)).alias("pos"), "term", "embedding"), "index-batch")
    batch.write.mode("append").parquet(path)
    return batch.count()


def stream_index(entries: DataFrame, path: str, checkpoint: str, embedder: Embedder) -> StreamingQuery:
    """Index entries (ord, term, translation) of a stream as they come; a replayed batch adds no term twice."""

    def one(batch: DataFrame, _: int) -> None:
        build_index(batch.sparkSession, batch.dropDuplicates(["term"]), path, embedder)

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
