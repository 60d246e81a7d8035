"""Files in and out, settings, providers, the index job and its stream."""

import json

import pytest

from termloom import providers as P
from termloom.sources import config as C
from termloom.sources import glossary_io as GI
from termloom.sources import xml as X
from termloom.streaming import index_stream as IS

XML = """<?xml version="1.0" encoding="utf-8"?>
<Root><Content>
  <String EDID="A1" id="x"><Source>Iron Gate</Source><Dest></Dest></String>
  <String id="i2"><EDID>C2</EDID><Source>two</Source><Dest>zwei</Dest></String>
  <String id="i3"><EDID></EDID><Source> two </Source></String>
  <String id="i4"><Dest>no source</Dest></String>
  <String EDID="" id="i5"><Source/><Dest>d</Dest></String>
</Content></Root>"""
WANT = [("A1", "Iron Gate", ""), ("C2", "two", "zwei"), ("i3", " two ", ""), ("", "", "d")]


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML, encoding="utf-8")
    got = X.read_strings(spark, str(tmp_path / "a.xml"))
    assert [tuple(r)[1:] for r in got.orderBy("row_idx").collect()] == WANT
    X.write_strings(got.coalesce(1), str(tmp_path / "out"))
    again = X.read_strings(spark, str(tmp_path / "out"))
    assert sorted(tuple(r)[1:] for r in again.collect()) == sorted(WANT)


def test_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text('term,translation\n" Gate "," Tor "\nsolo\nx,\na,1\na,2\n"p,q",r,extra\ny,,extra\n"m\nn",z\n', encoding="utf-8")
    got = [(r.term, r.translation) for r in GI.read_csv(spark, str(tmp_path / "g.csv")).orderBy("ord").collect()]
    assert got == [("term", "translation"), ("Gate", "Tor"), ("x", ""), ("a", "2"), ("p,q", "r"), ("y", ""), ("m\nn", "z")]


def test_json_and_npy(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"b": "2", "a": "中"}), encoding="utf-8")
    g = GI.read_json(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in g.orderBy("ord").collect()] == [(0, "b", "2"), (1, "a", "中")]
    GI.write_json(g, str(tmp_path / "h.json"))
    assert json.loads((tmp_path / "h.json").read_text(encoding="utf-8")) == {"b": "2", "a": "中"}
    ix = spark.createDataFrame([(0, "b", [1.0, 2.0]), (1, "a", [3.0, 4.0])], "pos bigint, term string, embedding array<float>")
    GI.write_npy(ix, str(tmp_path / "v.npy"), str(tmp_path / "t.json"))
    back = GI.read_npy(spark, str(tmp_path / "v.npy"), str(tmp_path / "t.json"))
    assert [tuple(r) for r in back.orderBy("pos").collect()] == [tuple(r) for r in ix.orderBy("pos").collect()]
    assert GI.read_npy(spark, str(tmp_path / "none.npy"), None, g).filter("embedding is null").count() == 2


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"llm": {"max_retries": 9}, "own": {"k": 1}}')
    c = C.Config(str(p))
    assert c.get("llm", "max_retries") == 9 and c.get("llm", "backoff_base") == 0.5 and c.get("own", "k") == 1 and c.get("x", "y", 3) == 3
    c.set("own", "k", 2)
    assert C.Config(str(p)).get("own", "k") == 2
    p.write_text("{broken")
    assert C.Config(str(p)).get("rag", "max_terms") == 30


def test_prompts(tmp_path):
    (tmp_path / "translator.base.json").write_text('{"system": "s", "retry": {"a": "1"}}')
    (tmp_path / "de").mkdir()
    (tmp_path / "de" / "x.json").write_text('{"no": 1}')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y.json").write_text('{"translator": {"retry": {"b": "2"}}}')
    (tmp_path / "bad.json").write_text("{")
    t = C.Prompts(str(tmp_path))
    assert t.get("translator.system") == "s" and t.get("translator.retry") == {"a": "1", "b": "2"} and t.get("no", 5) == 5
    assert not t.reload_if_changed()


def test_log(tmp_path):
    f, seen = tmp_path / "l.txt", []
    assert C.log("x", "debug", "INFO", str(f), seen.append) is None
    assert C.log("y", "odd", "INFO", str(f), seen.append).endswith("y") and f.read_text().count("\n") == 1
    f.write_text("".join(f"line {i}\n" for i in range(30_000)))
    assert C.log_tail(str(f), 3) == ["line 29997", "line 29998", "line 29999"] and C.log_tail(str(tmp_path / "no")) == []
    assert C.styles(["b", "nsfw", "a", "default"]) == ["default", "nsfw", "a", "b"] and C.pick_style("q", ["b", "a"]) == "a"


def test_backoff_and_params():
    assert [P.backoff(i, 0.5, rnd=lambda: 0) for i in (1, 2, 3)] == [0.5, 1.0, 2.0]
    assert P.merge_params({"a": 1, "b": None}, b=2, c=None) == {"a": 1, "b": 2}
    waits, calls = [], []

    def call():
        calls.append(1)
        raise P.TransientError

    with pytest.raises(P.TransientError):
        P.with_retry(call, 3, 0.5, waits.append)
    assert len(calls) == 4 and len(waits) == 3


def test_index_resumes(spark, tmp_path):
    class Half(P.HashEmbedder):
        """Fails for one term."""

        def embed(self, texts):
            return [None if t == "b" else v for t, v in zip(texts, super().embed(texts))]

    g = spark.createDataFrame([(0, "a", ""), (1, "b", ""), (2, "c", "")], "ord bigint, term string, translation string")
    path = str(tmp_path / "ix")
    assert IS.build_index(spark, g, path, Half(8)) == 2
    assert IS.build_index(spark, g, path, P.HashEmbedder(8)) == 1
    assert IS.build_index(spark, g, path, P.HashEmbedder(8)) == 0
    got = IS.read_index(spark, path).collect()
    assert sorted(r.term for r in got) == ["a", "b", "c"] and len({r.pos for r in got}) == 3


def test_stream(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "ix")
    spark.createDataFrame([(0, "a", "1"), (1, "b", "2")], "ord bigint, term string, translation string").write.parquet(src)
    for _ in range(2):
        s = spark.readStream.schema("ord bigint, term string, translation string").parquet(src)
        IS.stream_index(s, path, str(tmp_path / "cp"), P.HashEmbedder(8)).awaitTermination()
    assert sorted(r.term for r in IS.read_index(spark, path).collect()) == ["a", "b"]


def test_translate_keeps_failed_rows(spark):
    class Fails(P.EchoTranslator):
        def complete(self, messages):
            if messages[-1]["content"] == "x":
                raise ValueError("no")
            return super().complete(messages)

    df = spark.createDataFrame([(1, [{"role": "user", "content": "x"}]), (2, [{"role": "user", "content": "y"}])], "id bigint, m array<map<string,string>>").selectExpr("id", "transform(m, e -> struct(e['role'] as role, e['content'] as content)) as m")
    got = {r.id: r for r in P.translate_column(df, "m", Fails()).collect()}
    assert got[1].response is None and got[1].error.startswith("ValueError") and got[2].error is None
