"""Exchanges with a chat model, branch by branch, and the HTTP client over a stand-in transport."""

import json

import pytest

from termloom import dialogue as D
from termloom import providers as P
from termloom.functions import text as T
from termloom.sources import xml as X


class Scripted:
    """Replies in turn; an exception is raised."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def complete(self, messages):
        self.asked.append(messages)
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return r


S = D.Settings()
ASKED = D.messages("Iron Gate", None, S)
say = lambda t: json.dumps({"translation": t}, ensure_ascii=False)


def run(*replies, source="Iron Gate near the mill"):
    m = Scripted(*replies)
    return D.translate(source, D.messages(source, None, S), m, S), m


def test_blank_needs_no_call():
    for t in (None, "", " \n"):
        assert D.translate(t, ASKED, Scripted(), S) == D.Outcome("", "blank", 0)


def test_accepted_at_once_or_later():
    got, m = run(say("磨坊旁的铁门"))
    assert got == D.Outcome("磨坊旁的铁门", "accepted", 1) and m.asked[0][-1]["role"] == "user"
    got, m = run(say("Iron Gate near the mill"), say("磨坊旁的铁门"))
    assert got.status == "accepted" and got.calls == 2 and m.asked[1][-1]["content"] == "This is not a translation into Simplified Chinese. Translate the whole text."
    got, m = run(say("靠近磨坊的大门旁边有一扇 gate 和 iron 铁门很大很大"), say("磨坊旁的铁门"))
    assert got.calls == 2 and "gate, iron" in m.asked[1][-1]["content"] and len(m.asked[1]) == 3


def test_last_call_stands():
    got, _ = run(*[say("Iron Gate near the mill")] * 3)
    assert got == D.Outcome("Iron Gate near the mill", "exhausted", 3)
    got, _ = run(ValueError("x"), ValueError("x"), ValueError("x"))
    assert got == D.Outcome("Iron Gate near the mill", "failed", 3)
    got, _ = run(ValueError("x"), "[1]", say("铁门"))
    assert got == D.Outcome("铁门", "accepted", 3)
    assert run(say("铁门"), source="x")[0].calls == 1


@pytest.mark.parametrize("reply,again,want", [
    ('```json\n{"translation": "铁门"}\n```', None, "铁门"), ('{"other": 1}', None, "SRC"), ('Here: {"translation": "铁门"} ok', None, "铁门"),
    ("铁门", say("门"), "门"), ("铁门", say('reformat this: {"translation"'), "铁门"), ("铁门", "no json", "铁门"), ("铁门", ValueError("x"), "铁门"), (" 铁门 ", say(""), "铁门"),
])
def test_read_reply(reply, again, want):
    m = Scripted(*([again] if again is not None else []))
    assert D.read_reply(reply, "SRC", ASKED, m, S) == want
    assert not m.asked or "SRC" not in str(m.asked) and ASKED[0]["content"] not in str(m.asked)


def test_messages_by_style():
    s = D.Settings(styles={"b": "B {target_language_code}", "default": "D {target_language} {other}"}, user="Input ({source_language}): {text}")
    assert D.messages("t", "## G\n- a : b", s) == [{"role": "system", "content": "D Simplified Chinese {other}\n\n## G\n- a : b\n\nUse these terms wherever they occur."}, {"role": "user", "content": "Input (auto-detect (LLM decides)): t"}]
    s.style = "gone"
    assert D.messages("t", None, s)[0]["content"].startswith("D ")
    del s.styles["default"]
    assert D.messages("t", None, s)[0]["content"] == "B zh"


def test_checks_agree_with_columns(spark):
    pairs = [("Iron npc Sword", "铁 sword npc"), ("Hello", " hello "), ("Hello there", "你好"), ("Good morning everyone", "Bonjour tout le monde"), ("<b>Iron</b> %d [TAG] gate", "铁 gate iron"), ("", "x"), ("a long text here", "so a long text here is")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", T.likely_untranslated(df.a, df.b), T.untranslated_fragments(df.a, df.b)).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [(D.untranslated(a, b), D.fragments(a, b)) for a, b in pairs]


def test_rows(spark):
    df = spark.createDataFrame([(1, "Iron Gate"), (2, None), (3, " ")], "k int, source string")
    got = {r.k: (r.translation, r.status, r.calls) for r in D.translate_rows(df, "source", None, P.RepeatTranslator(), parallel=2).collect()}
    assert got == {1: ("Iron Gate", "exhausted", 3), 2: ("", "blank", 0), 3: ("", "blank", 0)}
    assert D.translate_rows(df.limit(0), "source", None, P.RepeatTranslator()).count() == 0


def test_http_client():
    seen, replies = [], [(429, {}), (200, {"choices": [{"message": {"content": "hi"}}]}), (200, {"data": [{"embedding": [1.0]}]}), (400, {}), (400, {"error": "x"})]
    send = lambda url, headers, body: seen.append((url, headers, body)) or replies.pop(0)
    c = P.HttpClient("http://host/v1/", "k", "m", {"temperature": 0.5, "top_p": None}, send=send, sleep=lambda s: None)
    assert c.complete([{"role": "user", "content": "x"}], max_tokens=7) == "hi"
    assert seen[1][0] == "http://host/v1/chat/completions" and seen[1][2] == {"model": "m", "messages": [{"role": "user", "content": "x"}], "temperature": 0.5, "max_tokens": 7} and seen[1][1]["Authorization"] == "Bearer k"
    assert c.embed(["a", "b"]) == [[1.0], None]
    with pytest.raises(ValueError):
        c.complete([])
    lone = P.HttpClient("http://host", "", "m", send=send)
    with pytest.raises(ValueError):
        lone.complete([])
    replies.append((200, {"choices": [{"message": {"content": "by the other"}}]}))
    assert P.HttpClient("http://host", "", "m", fallback=c).complete([]) == "by the other"


DOC = """<?xml version="1.0" encoding="utf-8"?>
<Root v="1"><!-- note --><Params><Lang>en</Lang></Params><Content>
  <String EDID="A1" id="x" List="0"><Source>Iron Gate</Source><Dest></Dest><Extra a="1">kept</Extra></String>
  <Group><String id="i2"><EDID>C2</EDID><Source>two</Source><String EDID="in"><Source>three</Source></String></String></Group>
  <String id="i4"><Dest>no source</Dest></String>
</Content></Root>"""


def test_documents_keep_other_nodes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.xml").write_text(DOC, encoding="utf-8")
    (tmp_path / "in" / "broken.xml").write_text("<Root><String>", encoding="utf-8")
    rows = X.read_documents(spark, str(tmp_path / "in" / "a*.xml"))
    assert [tuple(r)[1:] for r in rows.orderBy("nth").collect()] == [(0, "A1", "Iron Gate", ""), (1, "C2", "two", ""), (2, "in", "three", "")]
    assert X.read_documents(spark, str(tmp_path / "in" / "broken.xml")).count() == 0
    done = rows.filter("nth <> 1").selectExpr("path", "nth", "case when nth = 0 then '铁门 & 门' end as dest")
    assert [r.n for r in X.write_documents(spark, str(tmp_path / "in" / "a*.xml"), done, str(tmp_path / "out")).collect()] == [2]
    text = (tmp_path / "out" / "a b.xml").read_text(encoding="utf-8")
    assert all(x in text for x in ("<!-- note -->", "<Lang>en</Lang>", '<Extra a="1">kept</Extra>', "<Dest>铁门 &amp; 门</Dest>", 'List="0"', "no source"))
    again = X.read_documents(spark, str(tmp_path / "out"))
    assert [tuple(r)[1:] for r in again.orderBy("nth").collect()] == [(0, "A1", "Iron Gate", "铁门 & 门"), (1, "C2", "two", ""), (2, "in", "three", "")]
