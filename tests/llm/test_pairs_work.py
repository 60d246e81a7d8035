"""What the judgement of pairs leaves out to save work changes no result."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from termloom.llm import encoding, langid, pairs

EN, DE = ["the old mill by the river", "she went to the house", "where is the king"], ["die alte Mühle am Fluss", "sie ging zu dem Haus", "wo ist der König"]


class Scored(langid.NaiveBayes):
    """Counts the texts that were scored."""

    n = 0

    def score(self, texts):
        self.n += len(texts)
        return super().score(texts)


def test_prompts_are_scored_only_where_the_answer_may_stray():
    nb = Scored((EN + DE) * 20, ["en", "en", "en", "de", "de", "de"] * 20)
    model = type("B", (), {"value": nb})
    nb.n = 0
    rows = [(i, "en", "de", EN[i % 3], DE[i % 3]) for i in range(50)] + [(99, "en", "de", EN[0], EN[0])]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=list("abcde"))
    got = [r for b in pairs._judge(model)([batch]) for r in b.to_pylist()]
    assert [(r["key"], r["best"], r["prompt"]) for r in got] == [(99, "en", "en")]
    assert nb.n <= len(rows) + 2


def test_no_stray_answer_is_left_out():
    r = np.random.default_rng(1)
    for k in (1, 2, 5, 11):
        asked, got = r.normal(0, 8, (4000, k)), r.normal(0, 8, (4000, k))
        dst = r.integers(0, k, 4000)
        post = pairs.language_posteriors(asked, got, r.integers(-1, k, 4000), dst)[1]
        wrong = 1 - post[np.arange(4000), dst] > 0.5
        assert not (wrong & ~pairs._may_stray(got, dst)).any()


def test_bytes_that_read_as_utf8_like_the_expressions():
    r = np.random.default_rng(2)
    heads = np.array([0x20, 0x41, 0x80, 0xBF, 0xC1, 0xC2, 0xD0, 0xD1, 0xD2, 0xDF, 0xE0, 0xE1, 0xE2, 0xEF, 0xF0, 0x0A], np.uint8)
    lines = r.choice(heads, 4000, p=[0.02] * 2 + [0.2, 0.2] + [0.04] * 11 + [0.12]).tobytes().split(b"\n")
    line = np.cumsum(np.frombuffer(b"\n".join(lines), np.uint8) == 10)
    three, seq = (set(line[x].tolist()) for x in encoding._utf8_at(np.frombuffer(b"\n".join(lines), np.uint8)))
    assert three == {i for i, x in enumerate(lines) if encoding._THREE.search(x)} and three
    assert seq == {i for i, x in enumerate(lines) if encoding._SEQ.search(x)} and seq


def test_last_character_and_stems_like_the_whole_text(spark):
    texts = ["", "Iron Sword", "Done.", "Done.</b>", "Done. [/b]", "Done.\n\n", "<i a='x.'>no", "Done.”", "終わり。", "終わり", "a.<font color='#ffffff' size='20' face='x'>", "39.", "x)", "AI", "an AI here", "said", "политика", "ИИ", "翻訳", "この", "번역", "ÜBERSETZEN", "k i", "Content", "текст и ИИ."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", pairs.closed(F.col("t")).alias("c"), F.col("t").rlike(pairs._CLOSED).alias("c0"), F.lower("t").alias("low"), pairs._any_stem(F.lower("t"), list(pairs._STEMS)).alias("s")).collect()
    stems = [x.lower() for v in pairs._STEMS.values() for x in v.split(",")]
    alone = re.compile(r"(?<![^\W\d_])(?:ai|ia|ki|ии)(?![a-zа-я])")
    for r in got:
        assert r.c == r.c0, r.t
        assert r.s == (any(x in r.low for x in stems if x not in ("ai", "ia", "ki", "ии")) or bool(alone.search(r.low))), r.t
