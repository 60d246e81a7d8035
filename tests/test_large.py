"""Plans that hold on tables which the planner takes for smaller than they are."""

import pytest
from pyspark.sql import functions as F

from termloom.operators import retrieve
from termloom.operators import vectors as V
from termloom.plans import catalog


@pytest.fixture()
def names(spark, tmp_path):
    """A glossary in a file so small that the planner would broadcast it, and keywords from a larger one."""
    g = spark.range(400).select(F.col("id").alias("ord"), F.concat(F.lit("Order of Garbelgar "), F.col("id")).alias("term"), F.lit("x").alias("translation"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    g.write.parquet(f"{tmp_path}/g")
    spark.range(100).select(F.explode(F.split(F.concat_ws(" ", F.lit("Order Garbelgar Morgarbel"), F.expr("repeat('Filler ', 500)")), " ")).alias("keyword"), F.uuid().alias("pad")).write.parquet(f"{tmp_path}/k")
    return spark.read.parquet(f"{tmp_path}/k"), spark.read.parquet(f"{tmp_path}/g")


def unmeasured(df) -> list[str]:
    """Scans and generated rows that the planner broadcasts without a shuffle that measures them first."""
    out, under = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if under is not None and depth <= under:
            under = None
        name = line.lstrip(" :+-*")
        if name.startswith("BroadcastExchange"):
            under = depth
        elif under is not None and name.startswith("Exchange"):
            under = None
        elif under is not None and (name.startswith("Generate") or "/g]" in name):
            out.append(name[:60])
    return out


def test_postings_are_not_broadcast(spark, names):
    k, g = names
    got = retrieve.contained(k, g)
    assert unmeasured(got) == []
    assert got.groupBy("keyword").count().orderBy("keyword").collect() == [("Garbelgar", 400), ("Order", 400)]


def test_long_keywords_and_repeats_like_brute_force(spark):
    words = ["aaaa", "Garbelga", "garbelgar", "Garbelgar Mor", "belgar morm", "鉄の剣の鞘の中の刃", "aaaaaaaaa", "Garbelgarx", "𝒳y"]
    terms = [(i, t, "") for i, t in enumerate(["Order of Garbelgar Mormir", "GARBELGAR", "aaaaaaaaaaaa aaaaaaaaa", "鉄の剣の鞘の中の刃だ", "𝒳Yz", "garbelga", ""])]
    t = spark.createDataFrame(terms, "ord bigint, term string, translation string")
    rows = [(r.keyword, r.ord) for r in retrieve.contained(spark.createDataFrame([(w,) for w in words], "keyword string"), t).collect()]
    assert sorted(rows) == sorted((w, i) for w in words for i, x, _ in terms if w.lower() in x.lower())


def test_few_candidates_for_keywords_of_hot_substrings(spark, monkeypatch):
    """Keywords made of syllables that all terms hold meet only terms that hold the keyword."""
    met = []
    real = retrieve.small_side
    monkeypatch.setattr(retrieve, "small_side", lambda a: met.append(a) or real(a))
    terms = spark.createDataFrame([(i, f"garbel belmor morgar {i}", "") for i in range(50)], "ord bigint, term string, translation string")
    assert retrieve.contained(spark.createDataFrame([("garmor",), ("belgar",), ("morbelgarbel",)], "keyword string"), terms).count() == 0
    low = [r.term for r in terms.collect()]
    assert sum(r.gram in x for r in met[0].collect() for x in low) == 0


def test_mentions_do_not_broadcast_the_glossary(spark, names):
    _, g = names
    texts = spark.range(30).select(F.col("id").alias("key"), F.concat(F.lit("the ORDER OF garbelgar "), F.col("id")).alias("text"))
    # "7" is mentioned by the text of key 7 only; a term of 100 characters takes no part.
    matched = spark.range(30).select(F.col("id").alias("key"), F.explode(F.array(F.lit("Order of Garbelgar 7"), F.lit("Order of Garbelgar 399"), F.lit("x" * 100))).alias("term"), F.lit(1).alias("first"))
    got = retrieve.mentions(texts, matched, g)
    plan = got._jdf.queryExecution().executedPlan().toString()
    glossary = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "SortMergeJoin [term" in plan and glossary
    rows = sorted((r.key, r.ord, r.mentioned, r.place) for r in got.collect())
    assert rows == sorted((k, o, o == 7 and k == 7, i + 1) for k in range(30) for i, o in enumerate((7, 399)))


def test_tiers_do_not_broadcast_postings(spark, names, monkeypatch):
    _, g = names
    seen = []
    real = retrieve.contained
    monkeypatch.setattr(retrieve, "contained", lambda *a: seen.append(real(*a)) or seen[-1])
    kws = spark.createDataFrame([(7, "Garbelgar 7", [1.0, 0.0])], "kw_id bigint, keyword string, embedding array<float>")
    got = retrieve.tiered(kws, g, 2)
    assert unmeasured(seen[0]) == []
    assert [r.term for r in got.orderBy("slot").collect()][:3] == ["Order of Garbelgar 7", "Order of Garbelgar 70", "Order of Garbelgar 71"]


def broadcast_glossaries(df) -> list[str]:
    """Scans of a glossary anywhere under a broadcast that the planner chose before it ran."""
    out, under = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if under is not None and depth <= under:
            under = None
        name = line.lstrip(" :+-*")
        if name.startswith("BroadcastExchange") and under is None:
            under = depth
        elif under is not None and name.startswith("FileScan") and "term#" in name:
            out.append(name[:80])
    return out


def check_no_glossary_broadcast(query, spark, data, monkeypatch):
    steps = []
    real = retrieve.cut
    monkeypatch.setattr(retrieve, "cut", lambda df, *a: steps.append(df) or real(df, *a))
    steps.append(query(spark, data))
    assert len(steps) > 1
    assert [x for df in steps for x in broadcast_glossaries(df)] == []


def test_retrieve_tiered_broadcasts_no_glossary(spark, data, monkeypatch):
    check_no_glossary_broadcast(catalog.retrieve_tiered, spark, data, monkeypatch)


def test_retrieved_terms_broadcasts_no_glossary(spark, data, monkeypatch):
    check_no_glossary_broadcast(catalog.retrieved_terms, spark, data, monkeypatch)


def test_driver_holds_one_block_of_queries(spark, monkeypatch):
    """No block's vectors stay in the driver when the next is fetched, and no block comes with the others' vectors."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 10)
    live, most = set(), []
    real = type(spark.sparkContext).broadcast

    def broadcast(sc, value):
        b = real(sc, value)
        gone = b.destroy
        b.destroy = lambda *a: live.discard(id(b)) or gone(*a)
        live.add(id(b))
        most.append((len(live), len(value[0])))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    df = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.cos(i * F.col("id"))).alias("v")).repartition(8).cache()
    got = V.top_k(df.filter("id < 35"), df, "id", "v", 8, 3)
    assert most == [(1, 10)] * 3 + [(1, 5)] and not live
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    several = sorted(got.collect())
    monkeypatch.setattr(V, "QUERY_BLOCK", 4096)
    assert several == sorted(V.top_k(df.filter("id < 35"), df, "id", "v", 8, 3).collect()) and len(several) == 105
    # A last block that is full leaves an empty one behind.
    monkeypatch.setattr(V, "QUERY_BLOCK", 35)
    assert sorted(V.top_k(df.filter("id < 35"), df, "id", "v", 8, 3).collect()) == several
