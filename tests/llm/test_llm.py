"""The ten problems' operators on small fixtures: brute force, round trips, held-out cases, and every odd input."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import charlm, copies, encoding, forms, leaks, mixing, neighbours, pairs, sentences, splitting
from termloom.llm.queries import VOCABULARY

ROW = "row_idx bigint, plugin string, source string, dest string"


# -- 1 ------------------------------------------------------------------------

CLEAN = ["Die Tür von Öland ist größer als die Brücke über den Fluss.", "El niño llevó la espada a la montaña según la canción.", "Когда зазвонит колокол, отдайте старый меч стражу из селения.", "鐘が鳴ったら、古いランタンを衛兵に渡してください。", "钟声响起时，把密封的信交给来自北方的守卫。", "종이 울리면 낡은 등불을 경비병에게 주십시오.", "L’épée de fer est à côté du château brûlé.", "The guard’s café opens at dawn near the old mill."]
CHAINS = [("utf-8", "cp1252"), ("cp932", "cp1252"), ("gbk", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp949", "cp1252"), ("utf-8", "cp1251")]


def garble(text, right, wrong):
    try:
        raw = text.encode(right)
    except UnicodeEncodeError:
        return None
    t = encoding._ONE_BYTE[wrong]
    back = {b: c for c, b in reversed(t.items())}
    return "".join(back.get(b, chr(b)) if b > 127 else chr(b) for b in raw)


def test_garbled_round_trip(spark):
    random.seed(1)
    rows, want, n = [], {}, 0
    for _ in range(60):
        for t in CLEAN:
            rows.append((n, "p", t, None))
            n += 1
    for right, wrong in CHAINS:
        for t in CLEAN:
            g = garble(t, right, wrong)
            if g and g != t and "�" not in g:
                want[n] = t
                rows.append((n, "q", g, t))
                n += 1
    rows += [(n, None, "lost � here", ""), (n + 1, None, None, None), (n + 2, "p", "", " "), (n + 3, "p", "é" * 5000, None), (n + 4, "q", "Äpfel – «gut» ½ ™ naïve", None)]
    want[n] = "lost � here"
    df = spark.createDataFrame(rows, ROW).withColumn("key", F.lit("x")).withColumn("field", F.lit("y"))
    got = {(r.row_idx, r.field): r for r in encoding.garbled(df, "row_idx", "plugin", ["source", "dest"]).collect()}
    assert {f for _, f in got} == {"source"}
    found = {k for k, _ in got}
    assert len(found & set(want)) >= 0.95 * len(want) and len(found - set(want)) <= 1
    right = sum(got[k, "source"].restored == t for k, t in want.items() if (k, "source") in got)
    assert right >= 0.9 * len(want)


def test_weak_evidence_is_pooled(spark):
    """Words of two or three letters: too little on their own, plenty for a source that garbles most of them."""
    short = ["Да", "Нет", "Ты", "Мы", "Он", "Лук", "Щит", "Нож", "Дом", "Лес", "Сон", "Мир"]
    rows = [(i, "clean", t, None) for i, t in enumerate((CLEAN + short * 4) * 40)]
    n = len(rows)
    rows += [(n + i, "worn", short[i % 12] if i % 5 == 0 else garble(short[i % 12], "koi8_r", "cp1251"), None) for i in range(600)]
    df = spark.createDataFrame(rows, ROW)
    want = {n + i for i in range(600) if i % 5}
    alone = {r.row_idx for r in encoding.garbled(df, "row_idx", "plugin", ["source", "dest"], most=0).collect()}
    pooled = {r.row_idx: r for r in encoding.garbled(df, "row_idx", "plugin", ["source", "dest"]).collect()}
    print(len(alone & want), len(pooled.keys() & want), len(want), len(pooled.keys() - want))
    assert len(alone & want) < 0.5 * len(want) and len(pooled.keys() & want) > 0.9 * len(want) and len(pooled.keys() - want) < 0.02 * len(want)


def test_more_chains(spark):
    ru = "Когда зазвонит колокол, отдайте старый меч стражу из селения."
    pairs_ = [("koi8_r", garble(ru, "utf-8", "koi8_r")), ("gbk", ru.encode().decode("gbk", "replace")), ("cp932", ru.encode().decode("cp932", "replace"))]
    rows = [(i, "p", t, None) for i, t in enumerate(CLEAN * 60)] + [(9000 + i, "q", t, None) for i, (_, t) in enumerate(pairs_)]
    got = {r.row_idx: r.chain for r in encoding.garbled(spark.createDataFrame(rows, ROW), "row_idx", "plugin", ["source", "dest"]).collect()}
    assert set(got) == {9000, 9001, 9002} and got[9000] == "utf_8>koi8_r" and got[9001] == "utf_8>gbk"


def test_garbled_empty(spark):
    assert encoding.garbled(spark.createDataFrame([], ROW), "row_idx", "plugin", ["source", "dest"]).count() == 0


def test_charlm_prefers_seen_text():
    c = charlm.Counter()
    c.add(charlm.fold(charlm.codes(["the old mill"] * 50)[0]))
    m = charlm.Model(*c.rows())
    a, b = m.score(["the old mill", "llim dlo eht"])
    assert a > b


# -- 2 ------------------------------------------------------------------------


def test_split_invariants(spark):
    random.seed(2)
    words = ["alpha", "beta.", "<font color='#aa1122'>name</font>", "{0}", "[pagebreak]", "gamma,", "delta!\n", "end.\n\n", "字" * 30, "é"]
    texts = [" ".join(random.choices(words, k=random.randint(1, 120))) for _ in range(60)] + ["x" * 500, "", None, " ", "a😀" * 200, "<" * 300]
    limits = spark.createDataFrame([("a", 100, 20), ("*", 60, 0), ("b", 10, 50), ("c", None, 5)], "provider string, max_chars int, overlap_chars int")
    rows = [(i, t, random.choice(["a", "b", None, "unknown"])) for i, t in enumerate(texts)] + [(900, "y" * 200, "c")]
    df = spark.createDataFrame(rows, "k bigint, t string, p string").withColumn("piece", F.lit(1)).withColumn("_t", F.lit(2))
    got = {}
    for r in splitting.split_items(df, limits, "k", "t", "p").orderBy("k", "piece").collect():
        got.setdefault(r.k, []).append(r)
    lim = {"a": (100, 20), "b": (10, 5), None: (60, 0), "unknown": (60, 0), "c": (60, 0)}
    for k, t, p in rows:
        if not t:
            assert k not in got
            continue
        m, o = lim[p]
        assert "".join(r.text[r.overlap :] for r in got[k]) == t
        assert all(len(r.text) <= m and t[r.start_char : r.start_char + len(r.text)] == r.text for r in got[k])
        assert all(r.overlap == min(o, r.start_char + r.overlap) for r in got[k][1:]) and got[k][0].overlap == 0
        assert (len(got[k]) > 1) == (len(t) > m)


def test_long_markup_stays_whole(spark):
    tag = "<font color='#aa1122' face='" + "Old Script " * 14 + "'>"
    text = ("some words of a page and " * 4 + tag) * 6
    df = spark.createDataFrame([(1, text, "a")], "k bigint, t string, p string")
    got = splitting.split_items(df, spark.createDataFrame([("a", 400, 40)], "provider string, max_chars int, overlap_chars int"), "k", "t", "p").orderBy("piece").collect()
    assert "".join(r.text[r.overlap :] for r in got) == text and len(got) > 3 and all(len(r.text) <= 400 for r in got)
    assert sum(r.text.count(tag) for r in got) >= 6 and all(r.text.count("<") == r.text.count(">") for r in got)


# -- 3 ------------------------------------------------------------------------


def brute(m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    return {i: np.lexsort((np.arange(len(m)), -s[i]))[:k].tolist() for i in range(len(m))}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24))
    m = np.concatenate([c + 0.3 * rng.standard_normal((30, 24)) for c in centres] + [rng.standard_normal((200, 24)), np.repeat(rng.standard_normal((1, 24)), 150, 0)])
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [1.0] * 23), (5004, [float("nan")] * 24)]
    df = spark.createDataFrame(rows, "pos bigint, e array<float>").withColumn("key", F.lit(1)).repartition(6)
    got = {}
    for r in neighbours.nearest(df, "pos", "e", 24).orderBy("pos", "rank").collect():
        got.setdefault(r.pos, []).append(r.other)
    want = brute(m.astype(np.float32).astype(np.float64), 5)
    assert set(got) == set(want)
    hit = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert got[len(m) - 1] == [len(m) - 150 + i for i in range(5)]  # equal vectors: smallest positions
    units = neighbours.usable(df, "pos", "e", 24)
    nodes, _ = neighbours.distinct_vectors(units)
    graph = neighbours.knn_graph(nodes, 24)
    asked = units.filter("key % 100 = 0").select(F.col("key").alias("query"), "v")
    walk = neighbours.greedy_search(asked, nodes, graph, 6).filter("query <> node").collect()
    distinct = len(m) - 150
    qs = [q for q in range(0, distinct, 100)]
    near = {q: [i for i in brute(m[: distinct + 1].astype(np.float32).astype(np.float64), 5)[q]] for q in qs}
    assert sum(len({r.node for r in walk if r.query == q} & set(near[q])) for q in qs) >= 0.9 * 5 * len(qs)


def test_neighbours_go_on_until_lists_stay(spark, monkeypatch):
    # Two trees with one bit place few neighbours in a small block, so three rounds aren't enough.
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    r = np.random.default_rng(5)
    m = r.normal(size=(2000, 6)) @ r.normal(size=(6, 24))
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m / np.linalg.norm(m, axis=1, keepdims=True))], "key bigint, v array<double>").repartition(3)
    shares, changed = [], neighbours._changed
    monkeypatch.setattr(neighbours, "_changed", lambda g: shares.append(changed(g)) or shares[-1])
    assert neighbours.knn_graph(units, 24, trees=2, bits=1).count() == 12 * 2000
    assert len(shares) > 4 and shares[-1] <= 0.001 < min(shares[:-1])


def test_search_reaches_clusters_and_repeats(spark):
    # 200 clusters without links between them, each vector twice
    r = np.random.default_rng(5)
    one = np.repeat(r.normal(size=(200, 24)), 13, 0) + 0.2 * r.normal(size=(2600, 24))
    m = np.concatenate([one, one])
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m / np.linalg.norm(m, axis=1, keepdims=True))], "pos bigint, e array<double>").repartition(3)
    units = neighbours.usable(units, "pos", "e", 24)
    nodes, members = neighbours.distinct_vectors(units)
    near = brute(m, 5)
    asked = units.filter("key % 20 = 0").select(F.col("key").alias("query"), "v")
    edges = [(a, b, float(-abs(a - b))) for a in range(2600) for b in range(a // 13 * 13, a // 13 * 13 + 13) if a != b]
    graph = spark.createDataFrame(edges, "a bigint, b bigint, sim float")
    got = {}
    for x in neighbours.rows_of(neighbours.greedy_search(asked, nodes, graph, 6), members, 5).collect():
        got.setdefault(x.query, []).append(x.node)
    assert set(got) == set(range(0, 5200, 20)) and all(len(v) == 5 and (q + 2600) % 5200 in v for q, v in got.items())
    assert sum(len(set(got[q]) & set(near[q])) for q in got) >= 0.9 * 5 * len(got)


def test_projections_grow():
    sizes = [neighbours._projections(n) for n in (1, 5_000, 50_000, 500_000)]
    assert sizes[0] == (4, 4) and sizes == sorted(sizes) and len({t for t, _ in sizes[1:]}) == len({b for _, b in sizes[1:]}) == 3


def test_neighbours_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], "pos bigint, e array<float>"), "pos", "e", 4).count() == 0


# -- 4 ------------------------------------------------------------------------


def test_copies(spark):
    random.seed(4)
    base = ["".join(random.choices("abcde", k=random.randint(1, 90))) for _ in range(300)]
    rows = []
    for i in range(3000):
        t = base[0] if i % 3 == 0 else random.choice(base)
        rows.append((i, "Id-" + t[:3], random.choice([t, t.upper(), " ".join(t), t + "!?"])))
    rows += [(9000, None, "x"), (9001, "x", None), (9002, "", "x"), (9003, "..", "x"), (9004, "a", "z" * 30000), (9005, "A", "Z" * 30000 + " ")]
    df = spark.createDataFrame(rows, "key bigint, id string, t string").repartition(5)
    rec = df.withColumn("tbl", F.lit("t")).withColumn("kb", F.lit("other"))
    groups, members = copies.copies(rec, ["id", "t"], bucket_bytes=500)
    want = {}
    for k, i, t in rows:
        a, b = (re.sub(r"[\W_]+", "", x or "").lower() for x in (i, t))
        if a and b:
            want.setdefault((a, b), []).append(k)
    assert {(r.key_a, r.key_b) for r in members.collect()} == {(min(v), x) for v in want.values() for x in v if x != min(v)}
    assert sorted((r.least, r.n) for r in groups.collect()) == sorted((min(v), len(v)) for v in want.values())


def test_trie_like_dictionary():
    random.seed(5)
    t, d = copies.Trie(), {}
    for i in range(2000):
        k = bytes(random.choices(b"ab", k=random.randint(0, 40)))
        t.add(k, 1, i)
        n, m = d.get(k, (0, i))
        d[k] = (n + 1, min(m, i))
    assert {k: (n, m) for k, n, m in t.terminals()} == d and t.size == len(d)


def test_radix_splits_until_buckets_fit(spark):
    random.seed(6)
    # A long stretch that all keys share, one hot key, keys of all lengths.
    keys = sorted({b"x" * 400 + bytes(random.choices(b"abc", k=random.randint(0, 12))) for _ in range(3000)}) + [b"x" * 400] * 50 + [b"yy" * 900] * 40
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "kb binary").repartition(4)
    got, splits = copies.radix_buckets(df, 5000)
    rows = got.collect()
    assert 2 <= splits <= 8 and sorted(bytes(r.kb) for r in rows) == sorted(keys)
    buckets = {}
    for r in rows:
        assert bytes(r.kb).startswith(bytes(r["_b"]))
        buckets.setdefault(bytes(r["_b"]), []).append(bytes(r.kb))
    assert all(sum(map(len, v)) <= 5000 or len(set(v)) == 1 for v in buckets.values())


def test_folds_are_given_out(spark, monkeypatch):
    monkeypatch.setattr(copies, "FOLD_ROWS", 7)
    f = lambda rows: copies._scan(iter([pa.RecordBatch.from_arrays([pa.array(["t"] * len(r)), pa.array([k for k, _ in r]), pa.array([x for _, x in r])], names=["tbl", "key", "t0"]) for r in rows]))
    got = [x for b in f([[(i, "A-b") for i in range(10)], [(20, "ab"), (21, "c")]]) for x in b.to_pylist()]
    assert [(x["kb"], x["n"], x["least"]) for x in got if x["kb"]] == [(b"ab", 10, 0), (b"ab", 1, 20), (b"c", 1, 21)]
    assert [(x["key"], x["least"]) for x in got if not x["kb"]] == [(i, 0) for i in range(1, 10)]


def test_parse(spark):
    xml = ['<String EDID="" id="i"><EDID>c</EDID><Source>a</Source></String>', '<String id="i"><Source><![CDATA[x & y]]></Source><EDID>c</EDID></String>', '<String id="i"><EDID/><Source>&#65;&amp;</Source></String>', "<String><Source>a", '<String id="i"><Dest>d</Dest></String>', "", None, '<String id="i"><Source/></String>', "<String><Source>s</Source></String>"]
    df = spark.createDataFrame(list(enumerate(xml)), "rec_id bigint, xml string")
    got = {r.key: (r.id, r.source) for r in copies.parse_records(df, "rec_id", "xml").collect()}
    assert got == {0: ("", "a"), 1: ("c", "x & y"), 2: ("i", "A&"), 7: ("i", ""), 8: (None, "s")}


def test_copies_empty(spark):
    groups, members = copies.copies(spark.createDataFrame([], "tbl string, key bigint, t string"), ["t"])
    assert groups.count() == 0 and members.count() == 0


# -- 5, 6 ---------------------------------------------------------------------

PAIR = "key bigint, src string, prompt string, response string, prompt_lang string, lang string"
EN = ["The guard waits at the old mill for the rider.", "Bring the iron sword to the tower before the snow comes.", "Nobody in the valley remembers who forged the ring.", "At night the miner walks along the walls and counts the torches."]
DE = ["Die Wache wartet an der alten Mühle auf den Reiter.", "Bringt das Eisenschwert zum Turm, bevor der Schnee kommt.", "Niemand im Tal weiß noch, wer den Ring geschmiedet hat.", "Nachts geht der Bergmann die Mauern entlang und zählt die Fackeln."]
FR = ["La garde attend le cavalier au vieux moulin.", "Apportez l’épée de fer à la tour avant la neige.", "Personne dans la vallée ne sait qui a forgé l’anneau.", "La nuit, le mineur longe les murs et compte les torches."]


def test_defects(spark):
    rows, n = [], 0
    for _ in range(30):
        for e, d, f in zip(EN, DE, FR):
            rows += [(n, "a", e, d, "en", "de"), (n + 1, "b", d, f, "de", "fr"), (n + 2, "b", f, e, "fr", "en")]
            n += 3
    odd = [
        (EN[0], "", "empty"), (EN[0], " \t", "empty"), (EN[1], "N/A", "empty"), (EN[1], '{"translation": ""}', "empty"), (EN[1], None, "empty"),
        (EN[0], "I'm sorry, but I can't translate this content.", "refusal"), (EN[0], '"Es tut mir leid, diesen Text kann ich nicht übersetzen."', "refusal"),
        (EN[2], EN[2].upper(), "copy"), ("Iron Sword", "»iron sword«", "copy"), (EN[1], DE[1][:33], "truncated"),
        (EN[3], FR[3], "wrong_language"), ("HUD", "HUD", None), ("%d / {0}", "", "empty"), ("12 / 5", "", None), (None, "", None), ("Iron Sword", "Eisenschwert", None),
        ("I'm sorry, I can't translate this text for you.", "Es tut mir leid, ich kann diesen Text nicht für Euch übersetzen.", None), (EN[0][:-1], DE[0][:-1], None), (EN[0] * 400, DE[0] * 400, None), (EN[0] + " " * 30_000, DE[0] + " \n" * 30_000, None), (EN[0], "<b>" * 9000 + DE[0][:20] + "</b>" * 9000, "truncated"),
    ]
    rows += [(10_000 + i, "c", p, r, "en", "de") for i, (p, r, _) in enumerate(odd)]
    df = spark.createDataFrame(rows, PAIR).withColumn("low", F.lit(1)).withColumn("kind", F.lit("z"))
    got = {r.key: r.defect for r in pairs.defects(df).collect()}
    assert got == {10_000 + i: d for i, (_, _, d) in enumerate(odd) if d}


def test_spikes_find_cut_lengths(spark):
    random.seed(6)
    full = ["".join(random.choices("abcdefgh ", k=random.randint(30, 200))) + "." for _ in range(1500)]
    rows = [(i, "cuts", None, t[:80] if len(t) > 80 and i % 2 else t) for i, t in enumerate(full)] + [(9000 + i, "clean", None, t) for i, t in enumerate(full)]
    df = spark.createDataFrame(rows, "key bigint, src string, prompt string, response string")
    lens = {(r.src, r.kind, r.len) for r in pairs.spikes(df, "src", "response").collect()}
    assert ("cuts", "chars", 80) in lens and not [x for x in lens if x[0] == "clean"]
    got = {r.key for r in pairs.cut_off(df).collect()}
    want = {k for k, _, _, t in rows if len(t) == 80 and not t.endswith(".")}
    assert len(got & want) >= 0.9 * len(want) and got <= want


def _cut_pairs():
    """Providers that cut at 80 characters, anywhere, and never; prompts with a closing mark; names without one."""
    random.seed(16)
    syllables = ["to", "mal", "keni", "dra", "vo", "linn", "gar", "e"]
    sentence = lambda: " ".join("".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(random.randint(8, 30))) + "end."
    rows, want = [], {}
    for i in range(1800):
        prompt, whole = sentence(), ""
        while abs(len(whole) - len(prompt)) > 6:
            whole = sentence()
        t, src = whole, ("spike", "any", "clean")[i % 3]
        if src == "spike" and len(t) > 80:
            t = t[:80]
        elif src == "any" and i % 2:
            t = t[: random.randint(len(t) // 3, len(t) * 2 // 3)]
        rows.append((i, src, prompt, t, "x", "y"))
        if t != whole:
            want[i] = src
    rows += [(5000 + i, ("spike", "any", "clean")[i % 3], "Torvos Ken", " ".join("".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(random.randint(1, 3))), "x", "y") for i in range(600)]
    return rows, want


def test_cut_needs_its_evidence(spark):
    rows, want = _cut_pairs()
    df = spark.createDataFrame(rows, PAIR)
    assert {r.key for r in pairs.cut_off(df).collect()} == set(want)
    # Without prompts the text alone decides: spikes find what is cut at a length, ends and lengths the rest.
    alone = pairs._measured() | {"p_shut": F.lit(None).cast("boolean")}
    m = pairs.cut(df.select("key", "src", "prompt_lang", "lang", *[c.alias(k) for k, c in alone.items()]), "test")
    flagged = {}
    for use in ("ser", "s", "er"):
        got = {r.key for r in pairs.judged(m, use).filter("posterior > 0.5").collect()}
        flagged[use] = {src: sum(want.get(k) == src for k in got) / sum(x == src for x in want.values()) for src in ("spike", "any")} | {"wrong": len(got - set(want))}
    assert flagged["s"]["spike"] == 1 and flagged["s"]["any"] == 0
    # Spikes keep names apart from cut texts, which look alike by their ends.
    assert flagged["ser"]["spike"] == 1 and flagged["ser"]["wrong"] < 0.2 * flagged["er"]["wrong"]


def test_prompt_settles_the_language():
    # The response speaks a little more for language 1 than for its target 0; only the prompt tells a stray from chance.
    response = np.array([[-20.0, -12.0, -40.0]] * 2)
    prompt = np.array([[-60.0, -10.0, -60.0], [-60.0, -60.0, -10.0]])
    asked, got = pairs.language_posteriors(prompt, response, np.array([-1, -1]), np.array([0, 0]), strays=0.02)
    assert asked.argmax(1).tolist() == [1, 2]
    assert 1 - got[0, 0] > 0.34 and 1 - got[0, 0] > 2 * (1 - got[1, 0])
    # A prompt that is in the target language already says nothing against the response.
    _, same = pairs.language_posteriors(np.array([[-10.0, -60.0, -60.0]]), response[:1], np.array([0]), np.array([0]))
    assert same[0].argmax() == 0


def test_pairs_empty(spark):
    e = spark.createDataFrame([], PAIR)
    assert pairs.defects(e).count() == 0 and pairs.truncated(e).count() == 0


# -- 7 ------------------------------------------------------------------------

FORMS = [
    ("Ｉｒｏｎ", "Iron"), ("café", "café"), ("Ir​on", "Iron"), ("a b", "a b"), ("Irоn Swоrd", "Iron Sword"), ("Frost Staﬀ", "Frost Staff"), ("ﾄﾞｱ", "ドア"), ("⻑い", "長い"), ("Кoлокол", "Колокол"), ("Νame", "Name"), ("﻿x", "x"), ("x　y", "x y"),
    ("plain", None), ("“quoted” – …", None), ("Guild™ ½", None), ("Ключ от дома", None), ("（全角、句読点）", None), ("tab\tline\n", None), ("Größe", None), ("RUNE Ω", None), ("", None), (None, None), ("é" * 20000, None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS)], "k bigint, t string").withColumn("key", F.lit("c")).withColumn("form", F.lit("c"))
    got = {r.key: r.form for r in forms.odd_forms(df, "k", "t").collect()}
    assert got == {i: w for i, (_, w) in enumerate(FORMS) if w is not None}
    again = spark.createDataFrame([(k, v) for k, v in got.items()], "k bigint, t string")
    assert forms.odd_forms(again, "k", "t").count() == 0
    assert forms.odd_forms(df.limit(0), "k", "t").count() == 0


# -- 8 ------------------------------------------------------------------------


def test_leaks_like_brute_force(spark, monkeypatch):
    random.seed(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choices(vocab, k=30)), "en") for i in range(12)] + [(50, "".join(random.choices("甲乙丙丁戊己庚辛", k=60)), "zh"), (51, "short one", "en"), (52, None, "en"), (53, "", None), (54, "甲乙 AlphaBetaGammaDeltaEpsilonZeta 丙", "zh")]
    docs = []
    for i in range(150):
        t = " ".join(random.choices(vocab, k=40))
        if i % 3 == 0:
            ws = items[i % 12][1].split()
            a = random.randint(0, 18)
            t += ", " + "; ".join(ws[a : a + random.choice([11, 12, 13, 20])]).upper() + " " + t
        if i % 10 == 0:
            t += items[12][1][5 : 5 + random.choice([19, 20, 30])]
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, " ".join(items[0][1].split()[:12])), (903, "x " * 20000), (904, "see AlphaBetaGammaDeltaEpsilonZeta here"), (904, "another text"), (905, "甲alphabetagammadeltaeps")]
    ddf = spark.createDataFrame(docs, "d bigint, t string").withColumn("terms", F.lit(1))
    idf = spark.createDataFrame(items, "i bigint, t string, l string")
    got = {(r.doc, r.item) for r in leaks.leaked(ddf, idf, "d", "t", "i", "t", "l").filter("kind = 'phrase'").collect()}
    want = set()
    for d, t in docs:
        for i, x, lang in items:
            if not t or not x:
                continue
            n = 20 if lang == "zh" else 12
            a, b = leaks.words(t), leaks.words(x)
            if lang == "zh":
                a, b = list("".join(a)), list("".join(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
            if any(tuple(a[j : j + n]) in grams for j in range(len(a) - n + 1)):
                want.add((d, i))
    assert got == want and want and (904, 54) in want
    # Items that don't fit at once take several passes, small shards change nothing either.
    monkeypatch.setattr(leaks, "SHARD_POSTINGS", 50)
    again = {(r.doc, r.item) for r in leaks.leaked(ddf, idf, "d", "t", "i", "t", "l", slack=0, item_chars=400).collect()}
    assert again == want
    assert leaks.leaked(ddf.limit(0), idf, "d", "t", "i", "t", "l").count() == 0
    assert leaks.leaked(ddf, idf.limit(0), "d", "t", "i", "t", "l").count() == 0


def test_anchors_are_rare_and_lists_are_needed():
    its = leaks.load_items([(1, "a b c d e f", "en")], 3, 20, ("zh",))
    leaks.choose_anchors(its, {t: n for t, n in zip(its.terms[1], [9, 1, 9, 9, 2, 9])})
    assert sorted(j for x in its.anchors.values() for _, j in x) == [1, 4]
    # A term that no document holds rules its stretches out.
    leaks.choose_anchors(its, {t: n for t, n in zip(its.terms[1], [9, 1, 9, 0, 2, 9])})
    assert sorted(j for x in its.anchors.values() for _, j in x) == [1]


def test_every_near_passage(spark):
    item = " ".join(f"w{i}" for i in range(40))
    near = lambda a: " ".join(f"w{i}" + (" oh" if i == a + 6 else "") for i in range(a, a + 14))
    docs = spark.createDataFrame([(1, f"{near(0)} gap gap gap gap {near(20)} gap gap gap gap {' '.join(f'w{i}' for i in range(0, 13))}")], "d bigint, t string")
    got = leaks.leaked(docs, spark.createDataFrame([(1, item, "en")], "i bigint, t string, l string"), "d", "t", "i", "t", "l").collect()
    assert sorted((r.kind, r.item_term) for r in got) == [("phrase", 0), ("proximity", 0), ("proximity", 20)]


def test_proximity(spark):
    item = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, "x a b c d e oh f g h i j k l m n"), (2, "a c e g i k m")], "d bigint, t string")
    its = spark.createDataFrame([(1, item, "en")], "i bigint, t string, l string")
    assert [(r.doc, r.kind) for r in leaks.leaked(docs, its, "d", "t", "i", "t", "l").collect()] == [(1, "proximity")]


# -- 9 ------------------------------------------------------------------------


def test_mix(spark):
    random.seed(9)
    rows = [(i, " ".join(["word"] * random.randint(5, 200)), random.choice("aabc")) for i in range(3000)] + [(9000, None, "a"), (9001, "", "b"), (9002, "x y", None), (9003, "x", "other")]
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.2, 1), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.mix(spark.createDataFrame(rows, "d bigint, t string, s string"), t, "d", "s", "t", VOCABULARY)
    cap = {"a": 2, "b": 4, "c": 1}
    assert all(0 < r.copies <= cap[r.source] for r in drawn.collect())
    for r in shares.collect():
        assert abs(r.actual_share - r.target_share) < 0.005 and r.most_copies <= r.max_repeats
    empty, none = mixing.mix(spark.createDataFrame([], "d bigint, t string, s string"), t, "d", "s", "t", VOCABULARY)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows, "d bigint, t string, s string"), t, "d", "s", "t", VOCABULARY, total=1e9)
    assert empty.count() == 0 and none.count() == 4


def test_parts_keep_tokens(monkeypatch):
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    monkeypatch.setattr(mixing, "_PART", 50)
    random.seed(19)
    for t in ["some words here " * 40, "x" * 300, "字字。" * 60, "12345 " * 40, "".join(random.choices("ab 'é字.1\n", k=600)), "a" * 70 + "'s " + "b" * 70]:
        assert "".join(mixing._parts(t)) == t
        assert sum(len(enc.encode_ordinary(x)) for x in mixing._parts(t)) == len(enc.encode_ordinary(t))


# -- 10 -----------------------------------------------------------------------

SENTENCES = [
    ("en", ["Mr. Hol weighs approx. 9.5 stone.", "He said so."]),
    ("en", ["Sgt. Quin patrols from 9 p.m. to 4:30 a.m. every night.", "“Put it down!” shouted Ann from the stairs.", "It is v1.2."]),
    ("en", ["He answered, “Ask Bel...” and then he slept.", "Well... Kel never did come back.", "They took rope, etc.", "Day 4: Is that you?!"]),
    ("de", ["Am 3. Tag des Frostmonds kam Dr. Holm um 4.30 Uhr.", "„Halt!“, rief er, „die Brücke bricht!“", "Das ist z. B. ein Haus."]),
    ("fr", ["M. Hol et Mme Kel vivent ici.", "« Est-ce fini ? » demanda-t-il.", "Attention !", "Qui a pris la clé... personne ne le sait."]),
    ("es", ["La Sra. Hol vive en la Avda. del Roble, n.º 30.", "«¿Dónde está?», preguntó en voz baja.", "¡Cuidado!"]),
    ("ru", ["И. О. Хол служил у проф. Кел помощником.", "«Стой!» — крикнул он с башни.", "Цена выросла, т. е. почти вдвое."]),
    ("hi", ["डॉ. Hol ने तलवार लौटा दी।", "“रुको!” पहरेदार ने चिल्लाकर कहा।", "सावधान!"]),
    ("ko", ["“검을 내려놓으시오!”라고 홀이 외쳤다.", "가격은 약 1,072.5닢입니다!"]),
]


@pytest.mark.parametrize("lang,units", SENTENCES)
def test_sentences_with_blanks(lang, units):
    t = " ".join(units)
    assert [t[a:b] for a, b in sentences.units(t, lang)] == units


@pytest.mark.parametrize("units", [["他等了很久……莫恩没有回来。", "“把剑放下！”温在楼梯上喊道。", "他低声问：“走了吗？”", "你是谁？！"], ["「剣を置け！」と彼が叫んだ。", "彼は「来るな……」と言い、眠った。", "値段は1,048.5枚です！"]])
def test_sentences_without_blanks(units):
    t = "".join(units)
    assert [t[a:b] for a, b in sentences.units(t)] == units


def test_sentence_layout():
    t = "The Road\n\n1. First item (half burnt, no.\n9) read.\n2. Next.\n• Bullet one.\n* two\n\nA wrapped\nline. Next one."
    want = ["The Road", "1. First item (half burnt, no.\n9) read.", "2. Next.", "• Bullet one.", "* two", "A wrapped\nline.", "Next one."]
    assert [t[a:b] for a, b in sentences.units(t)] == want
    th = "หิมะตกหนัก เขาพบ 20 เหรียญ ประตูปิด"
    assert [th[a:b] for a, b in sentences.units(th)] == ["หิมะตกหนัก", "เขาพบ 20 เหรียญ", "ประตูปิด"]


@pytest.mark.parametrize("n", [3, 60, 2000])
def test_long_quotations_and_brackets(n):
    # What a rule needs may stand any distance back: the opening of a quotation, an open bracket.
    said = "“" + "他等了很久，" * n + "把剑放下！”林在楼梯上喊道。"
    t = said + "他走了。"
    assert [t[a:b] for a, b in sentences.units(t)] == [said, "他走了。"]
    noted = "1. One (" + "half of the letter was burnt, " * n + "no.\n2) read."
    t = noted + "\n2. Two."
    assert [t[a:b] for a, b in sentences.units(t, "en")] == [noted, "2. Two."]


def test_plain_marks_agree_with_the_cascade(monkeypatch):
    random.seed(10)
    bits = ["Mr", "word", "etc", "XI", "a", "Haus", "9", "т", "век", "字", "»", ")", "\"", ".", ".", "!", "?", "。", "…", " ", " ", "\n", ", ", "k."]
    texts = ["".join(random.choices(bits, k=40)) for _ in range(3000)]
    fast = [sentences.units(t, lang) for t in texts for lang in ("en", "de", "ru")]
    monkeypatch.setattr(sentences, "_plain", lambda *a: False)
    assert fast == [sentences.units(t, lang) for t in texts for lang in ("en", "de", "ru")]


def test_sentence_table(spark):
    rows = [(1, "One. Two.", "xx"), (2, None, None), (3, "", "en"), (4, " \n ", "en"), (5, "word " * 30000, None), (1, "One. Two.", "xx")]
    df = spark.createDataFrame(rows, "d bigint, t string, l string").withColumn("unit", F.lit(1)).withColumn("start_char", F.lit(1))
    got = sentences.sentence_units(df, "d", "t", "l").select("d", "start_char", "end_char").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (5, 0, 149999)]
    assert sentences.sentence_units(df.limit(0), "d", "t").count() == 0
