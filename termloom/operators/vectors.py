"""Vector arithmetic as columns, and exact top-k of a query set in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.session import shared_folder

#: Query vectors that go to every executor at once; larger query sets take several passes.
QUERY_BLOCK = 4096


def l2_norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 with a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot / n).otherwise(0.0)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, v) of the vectors of ``width`` numbers without nulls or not finite numbers."""
    v = F.col(vector)
    return df.filter((F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(F.col(key).cast("bigint").alias("key"), v.cast("array<double>").alias("v"))


def top_k(queries: DataFrame, base: DataFrame, key: str, vector: str, width: int, k: int = 3, query_key: str | None = None, query_vector: str | None = None) -> DataFrame:
    """(query, key, score, rank): the ``k`` rows of ``base`` most similar to each query by cosine, exactly.

    Blocks of QUERY_BLOCK queries meet all rows, task by task; a task keeps
    ``k`` rows per query, so the shuffle holds queries x tasks x k rows. The
    driver holds one block at a time: a block's last key is found first, then
    only its own vectors are fetched, and with several blocks each one's
    result is written before the next. Ties rank by the smaller key. Vectors
    of another width and null vectors take no part; zero vectors score 0; no
    queries give no rows.
    """
    q = usable(queries, query_key or key, query_vector or vector, width).withColumnRenamed("key", "query")
    rows = usable(base, key, vector, width)
    spark = base.sparkSession
    schema = "query bigint, key bigint, score double, rank int"
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    rest, path = q, None
    while True:
        last, n = rest.select("query").orderBy("query").limit(QUERY_BLOCK).agg(F.max("query"), F.count("query")).first()
        if not n:
            break
        part = rest.filter(F.col("query") <= last).toArrow()
        m = _matrix(part.column("v").combine_chunks(), width)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        block = spark.sparkContext.broadcast((part.column("query").to_numpy(), m / np.where(norm > 0, norm, 1)))
        got = rows.mapInArrow(_scan(block, width, k), "query bigint, key bigint, score double")
        # Scores equal to twelve places are ties: rounding hides the order of additions.
        got = got.withColumn("score", F.round("score", 12)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if n < QUERY_BLOCK and path is None:
            return got
        path = path or shared_folder(spark, "nearest")
        got.write.mode("append").parquet(path)
        block.destroy()
        if n < QUERY_BLOCK:
            break
        rest = q.filter(F.col("query") > last)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def _scan(block, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = block.value
        best_s = np.zeros((len(ids), k)) - np.inf
        best_k = np.full((len(ids), k), np.iinfo(np.int64).max)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), width)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            u, keys = (v / np.where(n > 0, n, 1)).T, b.column(0).to_numpy()
            for i in range(0, len(ids), 256):
                s = np.round(q[i : i + 256] @ u, 12)
                # what reaches a query's k-th best so far; all of its ties stay in
                m = min(k, s.shape[1])
                floor = np.maximum(-np.partition(-s, m - 1, axis=1)[:, m - 1], best_s[i : i + 256, -1])
                r, c = np.nonzero(s >= floor[:, None])
                row = np.concatenate([np.repeat(np.arange(len(s)), k), r])
                score, key = np.concatenate([best_s[i : i + 256].ravel(), s[r, c]]), np.concatenate([best_k[i : i + 256].ravel(), keys[c]])
                # smaller keys first among equals
                o = np.lexsort((key, -score, row))
                at = np.arange(len(o)) - np.searchsorted(row[o], row[o])
                o = o[at < k]
                best_s[i : i + 256], best_k[i : i + 256] = score[o].reshape(-1, k), key[o].reshape(-1, k)
        there = np.isfinite(best_s)
        if there.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(1))), pa.array(best_k[there]), pa.array(best_s[there])], names=["query", "key", "score"])

    return run
