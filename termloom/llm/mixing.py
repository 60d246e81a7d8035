"""Problem 9: sources mixed to target shares of tokens.

Entropy balancing: document rates stay as close as possible to one base rate
(in the entropy that keeps a rate between 0 and its source's cap) while the
expected tokens of every source meet its target. The solution tilts rates
exponentially in document length; the multipliers, one per source, solve a
convex dual by Newton steps whose sums are aggregated over the cluster from
a histogram of document lengths. Rates become whole copies by rounding
against a hash of the document, with a threshold per source that makes the
tokens drawn meet the target.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.session import cut

#: Pattern of words in that vocabulary's format; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretch that goes to the tokenizer at once, if the text has a place there where the pattern always parts words.
_PART = 100_000


def _counter(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            ns = [len(enc.encode_ordinary(t)) if len(t) <= _PART else sum(len(enc.encode_ordinary(x)) for x in _parts(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int64())], names=["key", "source", "tokens"])

    return run


def _parts(t: str) -> Iterator[str]:
    """Stretches whose tokens are those of the whole: a cut stands between a letter and what is no letter or digit, where words always part."""
    free = lambda i: t[i - 1].isalpha() and not t[i].isalnum()
    at = 0
    while at < len(t):
        end = min(len(t), at + _PART)
        if end < len(t):
            # the last such place before the end, else the first one after it
            i = next((i for i in range(end, at + 1, -1) if free(i)), None) or next((i for i in range(end + 1, len(t)) if free(i)), len(t))
            end = i
        yield t[at:end]
        at = end


def count_tokens(df: DataFrame, key: str, source: str, text: str, vocabulary: str) -> DataFrame:
    """(key, source, tokens) of every document with a text; the ``vocabulary`` file goes to all executors."""
    sc = df.sparkSession.sparkContext
    sc.addFile(vocabulary)
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).filter("text is not null and text <> ''").mapInArrow(_counter(os.path.basename(vocabulary)), "key bigint, source string, tokens bigint")


def _rate(x: Column, lam: Column, base: Column, cap: Column) -> Column:
    """Tilted rate between 0 and cap; equal to base where lam is 0."""
    z = F.log(base / (cap - base)) + lam * x
    return cap / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))


def mix(docs: DataFrame, targets: DataFrame, key: str, source: str, text: str, vocabulary: str, total: float | None = None, steps: int = 40, slack: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares).

    ``targets`` holds (source, target_share, max_repeats), a small table that
    the user writes. ``drawn`` has (key, source, tokens, rate, copies) of
    every document with a copy; ``shares`` has for each source its target,
    tokens available and drawn, actual share, documents drawn and most
    copies. ``total`` is the size of the mix in tokens; without it, the size
    of the corpus or, if less, the largest mix that every source can fill
    within its cap, less ``slack``. A larger ``total`` than that is an error.
    ``vocabulary`` is a public tokenizer's file of byte pairs and ranks.

    Documents without text, without a source or of a source without a target
    are not drawn; a source with a target but no documents has none drawn and
    its share goes to the others in proportion; null shares and caps below 1
    count as none.
    """
    spark = docs.sparkSession
    tokens = cut(count_tokens(docs, key, source, text, vocabulary), "mix-tokens")
    want = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.select("source", "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats >= 1").collect()}
    # The histogram has a row per source and distinct length, whatever the number of documents.
    hist = cut(tokens.filter(F.col("source").isin(list(want)) & (F.col("tokens") > 0)).groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "mix-hist")
    have = {r.source: (r.docs, float(r.tokens)) for r in hist.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("tokens")).alias("tokens")).collect()}
    live = {s: v for s, v in want.items() if s in have}
    if not live:
        empty = spark.createDataFrame([], "key bigint, source string, tokens bigint, rate double, copies int")
        return empty, _shares(empty, want, have, targets)
    whole = sum(v[0] for v in live.values())
    share = {s: v[0] / whole for s, v in live.items()}
    most = min(live[s][1] * have[s][1] / share[s] for s in live)
    if total is not None and total > most:
        raise ValueError(f"a mix of {total:.0f} tokens: the sources fill {most:.0f} at most within their caps")
    size = min(sum(t for _, t in have.values()), most * (1 - slack)) if total is None else total
    goal = {s: share[s] * size for s in live}
    base = {s: min(size / sum(t for _, t in have.values()), 0.5 * live[s][1]) for s in live}
    mean = {s: have[s][1] / have[s][0] for s in live}
    lam, lo, hi = dict.fromkeys(live, 0.0), dict.fromkeys(live, -math.inf), dict.fromkeys(live, math.inf)
    for _ in range(steps):
        at = _params(spark, {s: (lam[s], base[s], float(live[s][1]), mean[s]) for s in live})
        h = hist.join(F.broadcast(at), "source")
        x = F.col("tokens") / F.col("mean")
        r = _rate(x, F.col("lam"), F.col("base"), F.col("cap"))
        got = h.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens") * r).alias("f"), F.sum(F.col("n") * F.col("tokens") * x * r * (1 - r / F.col("cap"))).alias("d")).collect()
        worst = 0.0
        for g in got:
            s, gap = g.source, g.f - goal[g.source]
            worst = max(worst, abs(gap) / goal[s])
            if abs(gap) < 1e-6 * goal[s]:
                continue  # solved: its interval has closed
            if gap < 0:
                lo[s] = lam[s]
            else:
                hi[s] = lam[s]
            step = lam[s] - gap / g.d if g.d > 1e-12 * goal[s] else math.nan
            # Newton, kept inside the interval that must hold the root
            if not (lo[s] < step < hi[s]) or abs(step - lam[s]) > 4:
                step = (lo[s] + hi[s]) / 2 if math.isfinite(lo[s]) and math.isfinite(hi[s]) else lam[s] + (2.0 if gap < 0 else -2.0)
            lam[s] = step
        if worst < 1e-6:
            break
    at = _params(spark, {s: (lam[s], base[s], float(live[s][1]), mean[s]) for s in live})
    rated = tokens.filter("tokens > 0").join(F.broadcast(at), "source").withColumn("rate", _rate(F.col("tokens") / F.col("mean"), F.col("lam"), F.col("base"), F.col("cap")))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("z", F.col("rate") - F.col("whole") - F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40))
    # One more copy where z is over a threshold; a histogram of z places it so that the tokens meet the goal.
    bins = 4096
    cell = F.floor((F.col("z") + 1) / 2 * bins)
    rated = rated.withColumn("cell", F.greatest(F.lit(0), F.least(cell, F.lit(bins - 1))))
    sums = rated.groupBy("source", "cell").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("whole")).alias("w"))  # sources x bins rows
    by: dict[str, list] = {}
    for g in sums.collect():
        by.setdefault(g.source, []).append((g.cell, float(g.t), float(g.w)))
    cutoff = {}
    for s, cells in by.items():
        left = goal[s] - sum(w for _, _, w in cells)
        c = bins
        for k, t, _ in sorted(cells, reverse=True):
            if left < t / 2:
                break
            left, c = left - t, k
        cutoff[s] = c
    cuts = spark.createDataFrame(list(cutoff.items()), "source string, cutoff bigint")
    drawn = rated.join(F.broadcast(cuts), "source").withColumn("copies", (F.col("whole") + (F.col("cell") >= F.col("cutoff")).cast("int")).cast("int"))
    drawn = drawn.withColumn("copies", F.least(F.col("copies"), F.col("cap").cast("int"))).filter("copies > 0").select("key", "source", "tokens", "rate", "copies")
    return drawn, _shares(drawn, want, have, targets)


def _params(spark, values: dict) -> DataFrame:
    return spark.createDataFrame([(s, *v) for s, v in values.items()], "source string, lam double, base double, cap double, mean double")


def _shares(drawn: DataFrame, want: dict, have: dict, targets: DataFrame) -> DataFrame:
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    known = drawn.sparkSession.createDataFrame([(s, have.get(s, (0, 0.0))[0], int(have.get(s, (0, 0.0))[1])) for s in want] or [("", 0, 0)], "source string, corpus_docs bigint, corpus_tokens bigint")
    t = targets.filter("source is not null").select("source", "target_share", "max_repeats").join(known, "source", "left").join(got, "source", "left")
    t = t.na.fill(0, ["drawn_tokens", "n_docs", "most_copies", "corpus_docs", "corpus_tokens"])
    every = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))  # a row per target
    return t.withColumn("actual_share", F.when(every > 0, F.col("drawn_tokens") / every).otherwise(0.0))
