"""Glossary, string table, vector and retrieval operations on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import glossary as G
from termloom.operators import qa, retrieve
from termloom.operators import strings as S
from termloom.operators import vectors as V

ENTRY = "ord bigint, term string, translation string"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_upsert_keeps_first_position(spark):
    old = spark.createDataFrame([(0, "a", "1"), (1, "b", "2")], ENTRY)
    new = spark.createDataFrame([(0, "c", "3"), (1, "a", "9"), (2, "a", "8"), (3, "d", None)], ENTRY)
    got = G.upsert(old, new)
    assert [(t, x) for _, t, x in rows(got, "ord")] == [("a", "8"), ("b", "2"), ("c", "3"), ("d", "")]
    again = G.upsert(got, new)
    assert rows(again.select("term", "translation"), "term") == rows(got.select("term", "translation"), "term")


def test_empty_tables(spark):
    e = spark.createDataFrame([], ENTRY)
    ix = spark.createDataFrame([], "pos bigint, term string, embedding array<float>")
    assert rows(G.upsert(e, e)) == [] and rows(G.lookup(e)) == [] and rows(G.missing_terms(e, ix)) == []
    assert rows(G.page_count(e)) == [(0, 1)] and rows(G.page(e, 3)) == []
    assert rows(G.integrity(e, ix, 4)) == [(0, 0, 0, 0, 0, 0)]
    assert rows(V.top_k(ix, ix, "pos", "embedding", 4)) == []


@pytest.mark.parametrize("n,pages", [(0, 1), (200, 1), (201, 2)])
def test_pages(spark, n, pages):
    g = spark.range(n).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("term"), F.lit("x").alias("translation"))
    assert rows(G.page_count(g)) == [(n, pages)]
    assert sum(G.page(g, i + 1).count() for i in range(pages)) == n


def test_delete_from_index_takes_first_entry(spark):
    ix = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [1.0]), (2, "a", [2.0])], "pos bigint, term string, embedding array<float>")
    assert rows(G.delete_from_index(ix, spark.createDataFrame([("a",), ("a",)], "term string")).select("pos"), "pos") == [(1,), (2,)]


def test_dest(spark):
    r = spark.createDataFrame([(1, "s", ""), (2, "s", "d"), (3, "", None)], "row_idx bigint, source string, dest string")
    assert rows(r.select(S.fill_dest(F.col("dest"), F.lit("n"))), ) == [("n",), ("d",), ("n",)]
    assert rows(r.select(S.fill_dest(F.col("dest"), F.lit(None).cast("string"), True))) == [("",)] * 3
    assert rows(S.clear_dest(r, r.filter("row_idx = 2")).select("row_idx", "dest"), "row_idx") == [(1, ""), (2, ""), (3, "")]
    assert rows(S.dedup_stats(r)) == [(2, 1, 1)]


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert rows(df.select(V.cosine(F.col("a"), F.col("b")))) == [(0.0,), (1.0,)]


def test_top_k_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 8))
    m[7] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(90, None), (91, [1.0]), (92, [float("nan")] * 8)], "pos bigint, embedding array<double>").repartition(5)
    got = V.top_k(df.filter("pos < 10"), df, "pos", "embedding", 8, 4).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    for q in range(10):
        assert [r.key for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == np.lexsort((np.arange(60), -s[q]))[:4].tolist()


def test_containment_like_brute_force(spark):
    words = ["a", "ab", "abc", "Abcd", "b%c", "xyz", "_", "bcd", "ß", "鉄", "鉄の剣の"]
    terms = [(i, t, "") for i, t in enumerate(["Abcd", "xABCx", "b%c", "a_b", "鉄の剣の鞘", "ß", "zz", "bcda", "", None])]
    t = spark.createDataFrame(terms, ENTRY)
    k = spark.createDataFrame([(w,) for w in [*words, ""]], "keyword string")
    got = {(r.keyword, r.ord) for r in retrieve.contained(k, t).collect()}
    assert got == {(w, i) for w in words for i, x, _ in terms if x is not None and w.lower() in x.lower()}


def test_tiers(spark):
    base = spark.createDataFrame([(0, "Gate", "t", [1.0, 0.0]), (1, "Iron Gate", None, [0.9, 0.1]), (2, "gate ", "u", None), (3, "Door", "v", [0.99, 0.0]), (4, "Far", "w", [0.0, 1.0])], "ord bigint, term string, translation string, embedding array<float>")
    kws = spark.createDataFrame([(7, " GATE", [1.0, 0.0])], "kw_id bigint, keyword string, embedding array<float>").withColumn("keyword", F.col("keyword"))
    got = rows(retrieve.tiered(kws.withColumn("keyword", F.trim("keyword")), base, 2).select("slot", "term", "tier", "translation"), "slot")
    assert got == [(1, "Gate", 0, "t"), (2, "Iron Gate", 1, ""), (3, "gate ", 1, "u"), (4, "Door", 2, "v")]
    assert rows(retrieve.tiered(kws, base, 2, slots=0)) == []


def test_retry(spark):
    df = spark.createDataFrame([("Iron Sword", "Iron Sword", 0), ("Iron Sword here", "铁的剑和别的剑 sword 剑", 0), ("Iron", "铁", 0), ("Iron Sword", "Iron Sword", 2)], "s string, t string, n int")
    assert rows(df.select(qa.retry_decision(F.col("s"), F.col("t"), F.col("n")))) == [("retry_generic",), ("retry_fragments",), ("accept",), ("exhausted",)]
