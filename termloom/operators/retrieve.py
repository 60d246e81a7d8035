"""Terminology retrieval: exact, containment and vector matches of keywords, merged into ranked slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.functions import text as T
from termloom.operators import glossary as G
from termloom.operators import vectors as V
from termloom.session import cut, small_side

TOP_CONTAINED, TOP_VECTOR, SLOTS, THRESHOLD, LONGEST_TERM = 5, 3, 30, 0.75, 100
#: Characters of the substrings that bring longer keywords and terms together.
GRAM = 8


def keywords(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kw_pos, keyword): proper nouns of every text in order."""
    return rows.select(key, F.posexplode(T.proper_nouns(F.col(text))).alias("kw_pos", "keyword"))


def exact(kws: DataFrame, glossary: DataFrame) -> DataFrame:
    """Keyword rows with the glossary term of the same normalised key."""
    return kws.withColumn("norm", T.norm_key(F.col("keyword"))).join(G.lookup(glossary).select("norm", "term", "ord").hint("merge"), "norm").drop("norm")


def _grams(low: Column, n: int) -> Column:
    """Substrings of ``n`` characters."""
    return F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _posted(terms: DataFrame, sizes: list[int]) -> DataFrame:
    """(ord, gram): substrings of these sizes of all terms (ord, low).

    The planner takes these rows for as small as the file that they come from,
    so they are never left to it to broadcast.
    """
    return terms.select("ord", F.explode(F.concat(*(_grams(F.col("low"), n) for n in sizes))).alias("gram")).hint("merge")


def contained(kws: DataFrame, terms: DataFrame) -> DataFrame:
    """(keyword, ord, term): distinct non-empty keywords with all terms that hold them, case ignored.

    Instead of every keyword against every term, a keyword of up to GRAM
    characters meets the terms that have it among their substrings of that
    size, a longer one those that share its rarest substring of GRAM
    characters; the containment itself is then checked. One-sided hot
    substrings stay cheap because the rarest is chosen from counts over all
    terms. The keywords' substrings are written once and broadcast only if
    they were measured to be few.
    """
    t = terms.filter("term is not null").select("ord", "term", F.lower("term").alias("low"))
    k = kws.select("keyword").filter("keyword <> ''").distinct().withColumn("klow", F.lower("keyword"))
    k = k.select("keyword", "klow", F.explode(F.when(F.length("klow") > GRAM, _grams(F.col("klow"), GRAM)).otherwise(F.array("klow"))).alias("gram"))
    df = _posted(t, [GRAM]).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # A gram that no term has rules its keyword out, so its count must survive the join.
    rarest = k.join(df.hint("merge"), "gram", "left").groupBy("keyword", "klow").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r"))
    anchors = cut(rarest.filter((F.length("klow") <= GRAM) | (F.col("r.df") > 0)).select("keyword", "klow", F.col("r.gram").alias("gram")), "anchors")
    sizes = sorted(n for (n,) in anchors.select(F.length("gram")).distinct().collect())  # at most GRAM rows
    # Postings are numbers: terms join again only where a keyword's substring stands.
    hits = _posted(t, sizes or [GRAM]).join(small_side(anchors), "gram").select("ord", "keyword", "klow").distinct()
    return hits.join(t.hint("merge"), "ord").filter(F.col("low").contains(F.col("klow"))).select("keyword", "ord", "term")


def indexed_glossary(glossary: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """The glossary with the first usable vector of each term; entries whose term is gone and repeated entries are left out.

    Written once: retrieval reads it several times.
    """
    first = index.filter(F.size("embedding") == width).groupBy("term").agg(F.min_by("embedding", "pos").alias("embedding"))
    return cut(glossary.join(first.hint("merge"), "term", "left").select("ord", "term", "translation", "embedding"), "indexed")


def tiered(kws: DataFrame, base: DataFrame, width: int, threshold: float = THRESHOLD, slots: int = SLOTS, k: int = TOP_VECTOR) -> DataFrame:
    """(kw_id, keyword, slot, term, translation, tier, score) of every keyword.

    ``kws`` is (kw_id, keyword, embedding), ``base`` an indexed glossary.
    Tier 0 is the exact match, tier 1 up to five terms that hold the keyword,
    by similarity (terms without a vector last), tier 2 the ``k`` most
    similar, those under ``threshold`` dropped. A term takes its first place
    only; ``slots`` of 0 or less gives nothing. The planner takes a glossary
    for as small as its file, so no join leaves it the choice to broadcast
    one: keywords and what they hit are written and measured instead.
    """
    if slots <= 0:
        slots = 0
    unit = base.select("ord", "term", "translation", "embedding")
    kws = cut(kws.select("kw_id", "keyword", "embedding"), "keywords")
    hits0 = exact(kws.select("kw_id", "keyword"), unit).select("kw_id", "keyword", "ord", F.lit(0).alias("tier"), F.lit(1).alias("rank"), F.lit(None).cast("double").alias("score"))
    pairs = cut(contained(kws, unit).select("keyword", "ord").hint("merge").join(small_side(kws.select("kw_id", "keyword")), "keyword"), "held")
    held = unit.select("ord", F.col("embedding").alias("ve")).hint("merge").join(small_side(pairs), "ord")
    held = held.hint("merge").join(small_side(kws.select("kw_id", "embedding")), "kw_id")
    held = held.withColumn("score", F.when(F.col("ve").isNotNull() & (F.size("embedding") == width), F.round(V.cosine(F.col("embedding"), F.col("ve")), 12)))
    w1 = Window.partitionBy("kw_id").orderBy(F.col("score").desc_nulls_last(), "ord")
    hits1 = held.withColumn("rank", F.row_number().over(w1)).filter(F.col("rank") <= TOP_CONTAINED).select("kw_id", "keyword", "ord", F.lit(1).alias("tier"), "rank", "score")
    near = V.top_k(kws, unit, "ord", "embedding", width, k, "kw_id", "embedding").filter(F.col("score") >= threshold)
    hits2 = near.hint("merge").join(small_side(kws.select(F.col("kw_id").alias("query"), "keyword")), "query").select(F.col("query").alias("kw_id"), "keyword", F.col("key").alias("ord"), F.lit(2).alias("tier"), "rank", "score")
    every = hits0.unionByName(hits1).unionByName(hits2)
    one = every.groupBy("kw_id", "keyword", "ord").agg(F.min(F.struct("tier", "rank", "score")).alias("b"))
    w = Window.partitionBy("kw_id").orderBy("b.tier", "b.rank")
    ranked = one.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= slots)
    return ranked.join(unit.select("ord", "term", F.coalesce("translation", F.lit("")).alias("translation")).hint("merge"), "ord").select("kw_id", "keyword", "slot", "term", "translation", F.col("b.tier").alias("tier"), F.col("b.score").alias("score"))


def mentions(texts: DataFrame, matched: DataFrame, glossary: DataFrame) -> DataFrame:
    """(key, term, ord, mentioned, place): matched terms (key, first, term) of each text, those that the text holds first.

    Terms of 100 characters or more are left out; ``first`` is where a term
    was first matched and orders each group.
    """
    m = matched.groupBy("key", "term").agg(F.min("first").alias("first")).filter(F.length("term") < LONGEST_TERM)
    # Texts are lowered once each, and leave before the glossary joins, which is never broadcast unmeasured.
    m = m.join(texts.select("key", F.lower("text").alias("low")), "key").select("key", "term", "first", F.col("low").contains(F.lower("term")).alias("mentioned"))
    m = m.join(glossary.select("term", "ord", "translation").hint("merge"), "term")
    w = Window.partitionBy("key").orderBy(F.col("mentioned").desc(), "first", "ord")
    return m.withColumn("place", F.row_number().over(w)).select("key", "term", "ord", F.coalesce("translation", F.lit("")).alias("translation"), "mentioned", "place")


HEADER = "## Glossary"


def glossary_block(placed: DataFrame, header: str = HEADER) -> DataFrame:
    """(key, block): a header and a line ``- term : translation`` per term in order."""
    lines = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("- "), F.col("term"), F.lit(" : "), F.col("translation")).alias("line")))).alias("l"))
    return lines.select("key", F.concat(F.lit(header + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("block"))


def messages(system: Column, block: Column, user: Column) -> Column:
    """Chat messages: the system prompt with the glossary block, then the text."""
    full = F.when(F.coalesce(block, F.lit("")) == "", system).otherwise(F.concat_ws("\n\n", system, block))
    return F.array(F.struct(F.lit("system").alias("role"), full.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
