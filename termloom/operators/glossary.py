"""Operations on a glossary (ord, term, translation), unique by term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T

PAGE = 200


def lookup(glossary: DataFrame) -> DataFrame:
    """(norm, term): normalised key to the first spelling; empty keys dropped."""
    return glossary.filter("term is not null").withColumn("norm", T.norm_key(F.col("term"))).filter("norm <> ''").groupBy("norm").agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord"))


def last_wins(entries: DataFrame) -> DataFrame:
    """Entries (ord, term, translation) with repeated terms: the last translation at the first position."""
    return entries.filter("term is not null").groupBy("term").agg(F.min("ord").alias("ord"), F.max_by(F.coalesce("translation", F.lit("")), "ord").alias("translation")).select("ord", "term", "translation")


def upsert(glossary: DataFrame, entries: DataFrame) -> DataFrame:
    """The glossary with entries written over it: known terms keep their position, new ones follow in order."""
    new = last_wins(entries).withColumnsRenamed({"ord": "new_ord", "translation": "new_tr"})
    top = glossary.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("base"))  # one row
    low = new.agg(F.coalesce(F.min("new_ord"), F.lit(0)).alias("low"))  # one row
    both = glossary.join(new, "term", "full_outer").join(F.broadcast(top)).join(F.broadcast(low))
    return both.select(
        F.coalesce("ord", F.col("base") + F.col("new_ord") - F.col("low")).alias("ord"), "term",
        F.coalesce("new_tr", "translation", F.lit("")).alias("translation"),
    )


def delete(glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """The glossary without the listed terms."""
    return glossary.join(terms.select("term"), "term", "left_anti").select("ord", "term", "translation")


def valid_entries(entries: DataFrame) -> DataFrame:
    """Entries with something on both sides, stripped."""
    e = entries.withColumn("term", T.strip(F.col("term"))).withColumn("translation", T.strip(F.col("translation")))
    return e.filter("term <> '' and translation <> ''")


def search(glossary: DataFrame, query: str) -> DataFrame:
    """Entries whose display string holds the query without regard to case; an empty query finds all."""
    if not query:
        return glossary
    return glossary.filter(F.lower(T.display_string(F.col("term"), F.col("translation"))).contains(query.lower()))


def page_count(glossary: DataFrame, size: int = PAGE) -> DataFrame:
    """(n_terms, n_pages): at least one page."""
    return glossary.agg(F.count(F.lit(1)).alias("n_terms")).withColumn("n_pages", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / size)).cast("bigint"))


def page(glossary: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """One page in order; a number out of range is moved to the nearest page."""
    n = glossary.count()
    pages = max(1, -(-n // size))
    return glossary.orderBy("ord").offset((min(max(1, number), pages) - 1) * size).limit(size)


def missing_terms(glossary: DataFrame, index: DataFrame) -> DataFrame:
    """Glossary entries whose term has no vector."""
    have = index.filter("embedding is not null").select("term").distinct()
    return glossary.filter("term is not null").join(have, "term", "left_anti")


def delete_from_index(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The index (pos, term, embedding) without the first entry of each listed term."""
    first = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.min("pos").alias("pos"))
    return index.join(first.select("pos"), "pos", "left_anti")


def integrity(glossary: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """One row of counts: entries, terms without a vector, entries without a term, repeated terms, other widths."""
    per = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    both = glossary.select("term").withColumn("in_g", F.lit(1)).join(per, "term", "full_outer")
    counts = both.agg(
        F.coalesce(F.sum("in_g"), F.lit(0)).alias("n_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("in_g").isNull(), 1)).alias("n_orphans"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"),
    )
    widths = index.agg(F.count(F.when(F.coalesce(F.size("embedding"), F.lit(-1)) != width, 1)).alias("n_other_width"))  # one row
    return counts.join(F.broadcast(widths))


def append_vectors(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """New vectors (term, embedding, ord) below the old ones, positions counted on in the order of ``ord``."""
    base = index.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("base"), F.lit(1).alias("one"))  # one row
    # ord is unique, so positions follow from it without one task that sorts everything
    low = fresh.agg(F.coalesce(F.min("ord"), F.lit(0)).alias("low"))  # one row
    new = fresh.join(F.broadcast(base)).join(F.broadcast(low)).select((F.col("base") + F.col("ord") - F.col("low")).alias("pos"), "term", "embedding")
    return index.select("pos", "term", "embedding").unionByName(new)
