"""Problem 2: items over a size limit, cut at natural boundaries with an overlap.

One regular expression with bounded quantifiers takes an item apart. Its
alternatives stand in the order of boundary strength (paragraph or page,
line, sentence, clause, blank, any character); each consumes as much as fits
up to its boundary, the last falls back to single characters. A cut is only
taken where neither it nor the start of the overlap before it stands inside
markup or a placeholder, and never before a combining mark, while anything
else is possible. Lookback offsets then give each piece the overlap with the
piece before it. All of it is SQL functions on arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import cut, small_side

def _pattern(step: Column, overlap: Column) -> Column:
    """The cutting expression for cores of at most ``step`` characters; markup and placeholders of up to ``step`` stay whole."""
    inside = r"[^<>\[\]{}]{0,@n}[>\]}]"
    # not inside markup here, and not where the overlap of the next piece begins
    ok_here = rf"(?<![<\[{{][^<>\[\]{{}}]{{0,@n}}(?={inside}))"
    ok_back = rf"(?<![<\[{{][^<>\[\]{{}}]{{0,@n}}(?={inside})[\s\S]{{@o}})"
    mark = r"(?!\p{M})"
    strong = [r"(?<=\n\s{0,3}\n|\[pagebreak\]\n?)", r"(?<=\n)", r"(?<=[.!?…][\"'”’»)\]]{0,2}\s|[。！？][”」』）]{0,2}|[।॥]\s)(?![”」』）])", r"(?<=[,;:—]\s|[，；、：])", r"(?<=\s)(?=\S)"]
    parts = [r".{1,@n}\z", *(".{@h,@n}" + b + ok_here + "@b" + mark for b in strong), r".{1,@n}(?<=\s)(?=\S)" + ok_here + "@b", ".{1,@n}" + ok_here + "@b" + mark, ".{1,@n}" + mark, ".{1,@n}"]
    out = F.replace(F.lit("(?s)(?:" + "|".join(parts) + ")"), F.lit("@b"), F.when(overlap > 0, ok_back).otherwise(""))
    for k, v in {"@n": step, "@o": overlap, "@h": F.greatest(F.lit(1), (step / 2).cast("int"))}.items():
        out = F.replace(out, F.lit(k), v.cast("string"))
    return out


def split_items(df: DataFrame, limits: DataFrame, key: str, text: str, provider: str) -> DataFrame:
    """Pieces of every non-empty item of ``df``.

    ``limits`` holds (provider, max_chars, overlap_chars), one row for each
    provider, ``*`` for items without one; it is a small table that an
    operator's settings fix. Gives (key, piece, n_pieces, start_char,
    overlap, text): ``piece`` counts from 0, ``start_char`` is the offset of
    the piece in code points, ``overlap`` the characters it shares with the
    piece before. Joining the pieces without their overlaps gives the item.

    No piece is longer than ``max_chars``; the overlap is exact wherever the
    piece before is long enough. Null and empty texts give no piece, a
    provider without a limit takes that of ``*``, and a limit that is null,
    or no ``*`` for those that need it, leaves the item whole. An overlap as
    large as the limit counts as half the limit.
    """
    lim = limits.select(F.col("provider").alias("_p"), F.col("max_chars").cast("int").alias("_max"), F.coalesce(F.col("overlap_chars").cast("int"), F.lit(0)).alias("_o"))
    lim = lim.filter("_p is not null and _max > 0").dropDuplicates(["_p"])
    lim = lim.withColumn("_over", F.greatest(F.lit(0), F.least(F.col("_o"), (F.col("_max") / 2).cast("int"))))
    # The expression depends on the limits alone: it is put together once per limit, not per item.
    lim = lim.withColumn("_cut", _pattern(F.col("_max") - F.col("_over"), F.col("_over")))
    lim = cut(lim.select("_p", F.struct("_max", "_over", "_cut").alias("_r")), "split-limits")
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.coalesce(F.col(provider), F.lit("*")).alias("_p")).filter(F.length("_t") > 0)
    rows = rows.join(small_side(lim), "_p", "left")
    star = lim.filter("_p = '*'").first()
    if star:
        rows = rows.withColumn("_r", F.coalesce("_r", F.struct(*[F.lit(star["_r"][c]).alias(c) for c in ("_max", "_over", "_cut")])))
    rows = rows.select("_k", "_t", "_r")
    large = F.length("_t") > F.col("_r._max")
    # The first piece has no overlap, so its core might take the whole limit; it is cut like the others to keep one pattern.
    cores = F.when(large, F.regexp_extract_all("_t", F.col("_r._cut"), F.lit(0))).otherwise(F.array("_t"))
    rows = rows.select("_k", "_t", F.coalesce(F.col("_r._over"), F.lit(0)).alias("_over"), cores.alias("_cores"))
    lens = F.transform("_cores", lambda c: F.length(c))
    # running offsets of the cores
    offs = F.aggregate(lens, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    rows = rows.withColumn("_offs", offs).select("_k", "_t", "_over", F.size("_cores").alias("n_pieces"), F.posexplode("_cores").alias("piece", "_core"), "_offs")
    at = F.element_at("_offs", F.col("piece") + 1)
    back = F.least(F.col("_over"), at)
    return rows.select(
        F.col("_k").alias(key), "piece", "n_pieces", (at - back).alias("start_char"), back.alias("overlap"),
        F.substring("_t", at - back + 1, back + F.length("_core")).alias("text"),
    )
