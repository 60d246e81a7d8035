"""Glossary files (JSON object, CSV without a header) and vector indexes (.npy with a term list)."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.glossary import last_wins


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(ord, term, translation) of a JSON object term -> translation, in file order."""
    texts = spark.read.text(path, wholetext=True)
    pairs = texts.select(F.map_entries(F.from_json("value", "map<string,string>")).alias("m"))
    return pairs.select(F.posexplode("m").alias("ord", "e")).select(F.col("ord").cast("bigint"), F.col("e.key").alias("term"), F.col("e.value").alias("translation"))


def write_json(glossary: DataFrame, path: str) -> None:
    """The glossary as a JSON object, entry by entry in order; for files of an editor's size."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for i, r in enumerate(glossary.orderBy("ord").toLocalIterator()):
            f.write(",\n    " if i else "\n    ")
            f.write(json.dumps(r.term, ensure_ascii=False) + ": " + json.dumps(r.translation, ensure_ascii=False))
        f.write("\n}\n")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, term, translation) of CSV rows with two fields or more: fields stripped, the last of a repeated term wins at the first's place.

    A header counts as a term. Files are parsed whole, one per task, so
    quoted line breaks are safe.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = [(path, i, r[0].strip(), r[1].strip()) for i, r in enumerate(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig")))) if len(r) >= 2]
                yield pd.DataFrame(rows, columns=["path", "line", "term", "translation"])

    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, line bigint, term string, translation string")
    # Files follow one another by name; a file's rank times 2^40 plus the line orders all rows.
    rank = lines.select("path").distinct().select("path", F.dense_rank().over(_by_path()).alias("r"))
    return last_wins(lines.join(F.broadcast(rank), "path").select((F.col("r") * F.lit(1 << 40) + F.col("line")).alias("ord"), "term", "translation"))


def _by_path():
    from pyspark.sql.window import Window

    return Window.orderBy("path")  # a row per file


def write_npy(index: DataFrame, vectors_path: str, terms_path: str) -> None:
    """An index (pos, term, embedding) of one width as a float32 matrix and a JSON list of terms, row by row: never all of it in memory."""
    n, width = index.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if n:
        m = np.lib.format.open_memmap(vectors_path, "w+", np.float32, (n, max(width, 0)))
    else:
        np.save(vectors_path, np.zeros((0, 0), np.float32))
    with open(terms_path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(index.orderBy("pos").select("term", "embedding").toLocalIterator()):
            m[i] = r.embedding
            f.write((",\n    " if i else "\n    ") + json.dumps(r.term, ensure_ascii=False))
        f.write("\n]\n")
    if n:
        m.flush()


def read_npy(spark: SparkSession, vectors_path: str, terms_path: str | None, glossary: DataFrame | None = None) -> DataFrame:
    """(pos, term, embedding) of a matrix file, read in slices; terms beyond the matrix keep a null vector and the other way round.

    Without a term list, the glossary's terms stand in for it.
    """
    import os

    if terms_path and os.path.exists(terms_path):
        with open(terms_path, encoding="utf-8") as f:
            terms = spark.createDataFrame(list(enumerate(json.load(f))), "pos bigint, term string")
    elif glossary is not None:
        terms = glossary.select(F.col("ord").alias("pos"), "term")
    else:
        terms = spark.createDataFrame([], "pos bigint, term string")
    try:
        n = len(np.load(vectors_path, mmap_mode="r"))
    except (OSError, ValueError):
        return terms.withColumn("embedding", F.lit(None).cast("array<float>"))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.load(vectors_path, mmap_mode="r")
        for b in batches:
            ids = b["id"].to_numpy()
            yield pd.DataFrame({"pos": ids, "embedding": list(np.asarray(m[ids], np.float32))})

    vecs = spark.range(n).mapInPandas(load, "pos bigint, embedding array<float>")
    return terms.join(vecs, "pos", "full_outer").select("pos", "term", "embedding")
