"""Operations on string tables (row_idx, id, source, dest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def translatable(rows: DataFrame) -> DataFrame:
    """Rows with a source; white space counts, an existing dest doesn't matter."""
    return rows.filter("source is not null and source <> ''")


def selected(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Translatable rows among the chosen row_idx."""
    return translatable(rows).join(chosen.select("row_idx"), "row_idx", "left_semi")


def dedup_plan(rows: DataFrame) -> DataFrame:
    """(source, rep_row_idx, n_rows): each distinct source once, its first row standing for all.

    Only a count and a minimum travel per source, never the list of rows, so
    a source that a third of the rows share costs no more than others.
    """
    return translatable(rows).groupBy("source").agg(F.min("row_idx").alias("rep_row_idx"), F.count(F.lit(1)).alias("n_rows"))


def dedup_stats(rows: DataFrame) -> DataFrame:
    """(total, uniq, saved): rows, distinct sources, and calls saved by translating each once."""
    plan = dedup_plan(rows)
    return plan.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("uniq")).withColumn("saved", F.col("total") - F.col("uniq"))


def fan_out(rows: DataFrame, done: DataFrame) -> DataFrame:
    """(row_idx, source, translation): a translation per distinct source (source, translation) given to all its rows."""
    return translatable(rows).join(done.select("source", "translation"), "source").select("row_idx", "source", "translation")


def fill_dest(dest: Column, translation: Column, overwrite: bool = False) -> Column:
    """The translation where dest is empty or ``overwrite``; null translations count as empty."""
    new = F.coalesce(translation, F.lit(""))
    return new if overwrite else F.when(F.coalesce(dest, F.lit("")) == "", new).otherwise(dest)


def clear_dest(rows: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Rows with an empty dest, for all rows or the chosen row_idx."""
    if chosen is None:
        return rows.withColumn("dest", F.lit(""))
    mark = chosen.select("row_idx", F.lit(True).alias("_chosen")).distinct()
    return rows.join(mark, "row_idx", "left").withColumn("dest", F.when(F.col("_chosen"), "").otherwise(F.coalesce("dest", F.lit("")))).drop("_chosen")


def coalesce_id(attr_edid: Column, child_edid: Column, attr_id: Column) -> Column:
    """The EDID attribute if present, even empty, else a non-empty EDID child, else the id attribute, else nothing."""
    return F.coalesce(attr_edid, F.when(child_edid != "", child_edid), attr_id, F.lit(""))


_RESULT = "row_idx bigint, source string, translation string"


def append_results(results: DataFrame, path: str) -> None:
    """Results (row_idx, source, translation) added to the table that readers follow; a batch shows whole or not at all."""
    results.select(F.col("row_idx").cast("bigint"), "source", "translation").write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All results so far."""
    return spark.read.schema(_RESULT).parquet(path)
