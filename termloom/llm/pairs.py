"""Problems 5 and 6: translations that are cut off, and pairs that are no translation.

Cut texts. Length histograms (characters and bytes) per source and column
show where a source cuts: a length at which texts without terminal
punctuation pile up beyond the lengths around it. Transfers that break
anywhere leave no spike, so an unclosed text is judged by three kinds of
evidence: whether it sits at a spike, how likely its last letters are at the
end of whole texts against at a break anywhere (n-grams with back-off), and
its length against its prompt's. Their weights and how often each source cuts
come from EM over all unclosed texts. The prompt enters as a fourth kind, and
an unclosed prompt excuses its response.

Broken pairs. Empty and stand-in answers, refusals, copies, cut answers and
answers in another language are told apart in this order, so each pair has
one defect. The language test compares the posteriors of prompt and response
from a character n-gram naive Bayes model.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm import langid
from termloom.llm.copies import canonical
from termloom.session import cut

#: Closing quotes, brackets, emphasis, markup and blanks that may follow a sentence's last mark.
_TRAIL = r"(?:[\s\p{Z}\"'”’»“›」』】〉》)）\]}*_~`|]++|</?\w+[^<>]*>|\[/?\w+\])*+"
_CLOSED = rf"[.!?…。！？।؟｡]{_TRAIL}\z"
#: Characters that a closed text may end in, and what a run of closing marks may start with.
_LAST = r"[.!?…。！？।؟｡\s\p{Z}\"'”’»“›」』】〉》)）\]}*_~`|>]"
_SIGN = r"(?=[\p{P}\p{S}\s\p{Z}])"
_MARKUP = r"<[^<>]{0,200}>|\[[^\[\]]{0,80}\]|\{[^{}]{0,40}\}|%[-+0-9.]*[a-zA-Z]|\\[nrt]"


def closed(text: Column) -> Column:
    """Whether the last sentence of a text is closed."""
    # The end decides, for most open texts their last character; only where it is all closing marks must the whole text be read.
    tail = F.substring(text, -24, 24)
    return F.when(~F.substring(text, -1, 1).rlike(_LAST), False).when(tail.rlike(_CLOSED), True).when(tail.rlike(rf"\A[^<\[]*(?:[<\[][^>\]]*)?[>\]]?{_TRAIL}\z") | tail.rlike(rf"\A{_TRAIL}\z"), text.rlike(_CLOSED)).otherwise(False)


def spikes(texts: DataFrame, source: str, text: str, least: int = 8, factor: float = 4.0, reach: int = 12) -> DataFrame:
    """(source, kind, len): lengths at which a source cuts its texts.

    ``kind`` is ``chars`` or ``bytes``. A length is a spike where unclosed
    texts are at least ``least``, ``factor`` times the mean of the lengths
    within ``reach`` around it, and most of the texts of that length. A limit
    in bytes cuts up to three bytes early, so byte lengths count as a sum
    over the four lengths up to the limit.
    """
    t = F.col(text)
    return _spikes(texts.select(F.col(source).alias("src"), closed(t).alias("shut"), F.length(t).alias("n_chars"), F.octet_length(t).alias("n_bytes")), least, factor, reach)


def _spikes(measured: DataFrame, least: int = 8, factor: float = 4.0, reach: int = 12) -> DataFrame:
    # Rows count together before the two kinds of length part.
    both = measured.groupBy("src", "n_chars", "n_bytes").agg(F.sum((~F.col("shut")).cast("int")).alias("open"), F.count(F.lit(1)).alias("all"))
    hist = (
        both.select("src", "open", "all", F.explode(F.array(F.struct(F.lit("chars").alias("kind"), F.col("n_chars").alias("len")), F.struct(F.lit("bytes").alias("kind"), F.col("n_bytes").alias("len")))).alias("x"))
        .groupBy("src", "x.kind", "x.len").agg(F.sum("open").alias("open"), F.sum("all").alias("all"))
    )
    w = Window.partitionBy("src", "kind").orderBy("len")
    near, up = w.rangeBetween(-reach, reach), w.rangeBetween(-3, 0)
    h = hist.withColumn("around", F.sum("open").over(near))
    h = h.withColumn("here", F.when(F.col("kind") == "bytes", F.sum("open").over(up)).otherwise(F.col("open"))).withColumn("here_all", F.when(F.col("kind") == "bytes", F.sum("all").over(up)).otherwise(F.col("all")))
    width = F.when(F.col("kind") == "bytes", 4).otherwise(1)
    rest = (F.col("around") - F.col("here")) / (F.lit(2 * reach + 1) - width) * width
    peak = h.filter((F.col("len") > reach) & (F.col("here") >= least) & (F.col("here") > factor * rest) & (F.col("here") * 2 > F.col("here_all")))
    # Of neighbouring lengths, the one with most unclosed texts is the limit.
    best = Window.partitionBy("src", "kind").orderBy("len").rangeBetween(-reach, reach)
    top = peak.withColumn("top", F.max("here").over(best)).filter("here = top")
    lens = F.when(F.col("kind") == "bytes", F.sequence(F.col("len") - 3, F.col("len"))).otherwise(F.array("len"))
    return top.select("src", "kind", F.explode(lens).alias("len")).distinct()


#: Slots of the tables of end-of-text n-grams: their documented size bound.
GRAM_SLOTS = 1 << 17
#: Whole texts that a shorter n-gram's likelihood ratio weighs against those of a longer one.
_BACK_OFF = 4.0


def _slot(text: Column, n: int) -> Column:
    """Slot of a text's last ``n`` letters, closing marks aside."""
    v = F.regexp_replace(F.substring(text, -24, 24), rf"{_SIGN}[\p{{P}}\p{{S}}\s]*{_TRAIL}\z", "")
    return F.pmod(F.xxhash64(F.substring(v, -n, n)), F.lit(GRAM_SLOTS)).cast("int") + (0 if n == 4 else GRAM_SLOTS)


def _measured() -> dict[str, Column]:
    """What the evidence of a cut is made of, in numbers: no later step reads the texts."""
    r, q = F.col("response"), F.col("prompt")
    # A number broken at its point: "39." where the prompt has 39.8, or a point in scripts that close with another mark.
    end = F.substring(r, -24, 24)
    tail = F.regexp_extract(end, r"(\d+)[.,]?\z", 1)
    broken = end.rlike(r"\d\.\z") & (q.rlike(r"\d[.,]\d") & F.coalesce(F.instr(q, F.concat(tail, F.lit("."))) + F.instr(q, F.concat(tail, F.lit(","))) > 0, F.lit(False)) | r.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}][^.]*\d\.\z"))
    n = F.length(r)
    # Where a break at random would have left the text.
    at = F.pmod(F.xxhash64("key", F.lit("cut")), F.greatest(n - 1, F.lit(1))).cast("int") + 1
    middle = F.substr(r, F.greatest(at - 23, F.lit(1)), F.least(at, F.lit(24)))
    return {
        "n_chars": n, "n_bytes": F.octet_length(r), "p_chars": F.length(q), "shut": closed(r) & ~F.coalesce(broken, F.lit(False)),
        "p_shut": F.when(q.isNotNull(), closed(q)), "e4": _slot(r, 4), "e2": _slot(r, 2), "m4": _slot(middle, 4), "m2": _slot(middle, 2),
    }


# Cells of the evidence: prompt (0 unknown, 1 open, 2 closed), spike, end of text, length against the prompt's.
_ENDS, _RATIOS = 7, 9


def evidence(m: DataFrame) -> DataFrame:
    """(key, src, p, s, e, r) of every unclosed response of a written table of measures.

    ``s`` is 1 at a spike of its source. ``e`` is the likelihood ratio of the
    last letters (in nats, from 0 to 6, 3 is even): how texts broken anywhere
    end, against how whole texts end. ``r`` is the logarithm of the length
    against the prompt's, in deviations of its pair of languages (0 to 8).
    """
    whole = m.filter("shut")
    grams = whole.select(F.explode(F.array(*[F.struct(F.col(c).alias("slot"), F.lit(int(c[0] == "m")).alias("mid")) for c in ("e4", "e2", "m4", "m2")])).alias("g"))
    # At most GRAM_SLOTS rows of each length, whatever the table holds.
    table = cut(grams.groupBy("g.slot").agg(F.sum("g.mid").alias("mid"), F.sum(1 - F.col("g.mid")).alias("end")), "pairs-grams")
    c4, c2 = (F.broadcast(table.filter(mine).select(F.col("slot").alias(f"e{n}"), F.col("mid").alias(f"mid{n}"), F.col("end").alias(f"end{n}"))) for n, mine in ((4, F.col("slot") < GRAM_SLOTS), (2, F.col("slot") >= GRAM_SLOTS)))
    ratio = F.log(F.col("n_chars") / F.col("p_chars"))
    langs = [F.coalesce(x, F.lit("")).alias(x) for x in ("prompt_lang", "lang")]
    usual = whole.filter("p_shut and p_chars > 0").select(*langs, ratio.alias("x")).groupBy("prompt_lang", "lang").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    at = _spikes(m)
    lens = at.groupBy("src").agg(F.collect_set(F.when(F.col("kind") == "chars", F.col("len"))).alias("c"), F.collect_set(F.when(F.col("kind") == "bytes", F.col("len"))).alias("b"))
    left = m.filter("not shut").select("key", "src", "n_chars", "n_bytes", "p_chars", "p_shut", "e4", "e2", *langs)
    left = left.join(c4, "e4", "left").join(c2, "e2", "left").join(usual, ["prompt_lang", "lang"], "left").join(lens, "src", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    two = (n("mid2") + _BACK_OFF) / (n("end2") + _BACK_OFF)
    llr = F.log((n("mid4") + _BACK_OFF * two) / (n("end4") + _BACK_OFF))
    z = F.coalesce((ratio - F.col("mean")) / F.greatest(F.col("sd"), F.lit(0.05)), F.lit(0.0))
    return left.select(
        "key", "src", F.when(F.col("p_shut").isNull(), 0).when(F.col("p_shut"), 2).otherwise(1).alias("p"),
        F.coalesce(F.array_contains("c", F.col("n_chars")) | F.array_contains("b", F.col("n_bytes")), F.lit(False)).cast("int").alias("s"),
        F.greatest(F.lit(0), F.least(F.lit(_ENDS - 1), F.round(llr) + _ENDS // 2)).cast("int").alias("e"),
        F.greatest(F.lit(0), F.least(F.lit(_RATIOS - 1), F.round(z) + _RATIOS // 2)).cast("int").alias("r"),
    )


#: What is taken for granted before any data, in rows: cut texts sit at spikes, end anywhere, are short, and their prompts are closed.
_BEFORE = {
    "p": ([5.0, 0.5, 4.5], [5.0, 4.7, 0.3]), "s": ([5.0, 5.0], [9.9, 0.1]),
    "e": (np.exp(0.5 * (np.arange(_ENDS) - _ENDS // 2)), np.exp(-0.5 * (np.arange(_ENDS) - _ENDS // 2))),
    "r": (np.where(np.arange(_RATIOS) < _RATIOS // 2, 1.8, 0.3), np.where(np.abs(np.arange(_RATIOS) - _RATIOS // 2) < 2, 2.5, 0.4)),
}


def fit_cut(cells: list[tuple[int, int, int, int, int]], use: str = "pser", most: int = 200) -> tuple[float, dict[str, np.ndarray]]:
    """Prior and log-likelihood ratios (cut against whole) of each kind of evidence, by EM until nothing moves.

    ``cells`` are (p, s, e, r, n): a table of at most 3 x 2 x 7 x 9 counts.
    ``use`` names the kinds of evidence that count.
    """
    x = np.array([c[:4] for c in cells], int).reshape(-1, 4)
    n = np.array([c[4] for c in cells], float)
    names = "pser"
    before = {k: [np.asarray(v, float) / np.sum(v) * 10 for v in _BEFORE[k]] for k in names}
    llr = {k: np.log(before[k][0] / before[k][1]) if k in use else np.zeros(len(before[k][0])) for k in names}
    prior, last = 0.5, None
    for _ in range(most):
        odds = np.log(prior / (1 - prior)) + sum(llr[k][x[:, i]] for i, k in enumerate(names))
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        prior = float((post @ n + 1) / (n.sum() + 2))
        for i, k in enumerate(names):
            if k in use:
                a, b = (np.bincount(x[:, i], w * n, len(before[k][0])) + before[k][j] for j, w in enumerate((post, 1 - post)))
                llr[k] = np.log(a / a.sum()) - np.log(b / b.sum())
        if last is not None and np.abs(post - last).max(initial=0) < 1e-6:
            break
        last = post
    return prior, llr


def judged(m: DataFrame, use: str = "pser", alpha: float = 50.0) -> DataFrame:
    """(key, p, s, e, r, posterior) of every unclosed response: how probably it is cut.

    Kinds of evidence are weighed by what all sources show; how often a
    source cuts leans on all sources with the weight of ``alpha`` rows.
    """
    seen = cut(evidence(m), "pairs-evidence")
    counts = seen.groupBy("p", "s", "e", "r").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 378 rows
    prior, llr = fit_cut([tuple(c) for c in counts], use)
    odds = sum((F.element_at(F.array(*[F.lit(float(v)) for v in llr[k]]), F.col(k) + 1) for k in "pser"), F.lit(0.0))
    post = lambda base: 1 / (1 + F.exp(-(F.log(base / (1 - base)) + F.col("odds"))))
    scored = seen.withColumn("odds", odds)
    rates = scored.groupBy("src").agg(((F.sum(post(F.lit(prior))) + alpha * prior) / (F.count(F.lit(1)) + alpha)).alias("rate"))
    return scored.join(rates, "src").select("key", "p", "s", "e", "r", post(F.col("rate")).alias("posterior"))


def _cut_keys(m: DataFrame) -> DataFrame:
    # A prompt that is itself open excuses its response, whatever the evidence.
    return judged(m).filter("posterior > 0.5 and p <> 1").select("key")


def cut_off(pairs: DataFrame) -> DataFrame:
    """Keys of cut responses among ``pairs`` (key, src, prompt, response[, prompt_lang, lang]).

    A cut response is unclosed and more probably cut than whole by its
    length (spikes, and against its prompt) and its last letters; a prompt
    that isn't closed either excuses it. Blank and null responses are not
    cut. With a null prompt the response alone decides; a null ``src`` is a
    source of its own, null languages are one of their own.
    """
    p = pairs.filter("response is not null").filter(F.regexp_replace("response", r"[^\p{L}\p{N}]+", "") != "")
    langs = [F.col(x) if x in pairs.columns else F.lit(None).cast("string").alias(x) for x in ("prompt_lang", "lang")]
    return _cut_keys(cut(p.select("key", F.coalesce("src", F.lit("")).alias("src"), *langs, *[c.alias(k) for k, c in _measured().items()]), "pairs-measured"))


# Stand-ins for an empty value, lower case.
STAND_INS = ["null", "none", "nil", "n/a", "n.a", "na", "nan", "undefined", "empty", "blank", "tbd", "todo", "no translation", "not available", "missing", "void"]
_STAND = r"(?i)\A[^\p{L}\p{N}]*(?:(?:translation|text|result|output|dest)[^\p{L}\p{N}]+)?(?:" + "|".join(x.replace(".", r"\.") for x in STAND_INS) + r")?[^\p{L}\p{N}]*\z"
_JSON_EMPTY = r"(?i)\A[^\p{L}\p{N}]*(?:translation|text|result|output|dest)[^\p{L}\p{N}]*:[^\p{L}\p{N}]*\z"

# Ways to decline, by language: (inability or apology, what is declined).
_DECLINE = {
    "en": (r"sorry|apolog|cannot|can['’]?t|can not|unable|not able|won['’]?t|will not|decline|refuse|must not|not (?:allowed|permitted|comfortable)|violat|against (?:my|the|our)|not provide|no translation", r"translat|language model|\bAI\b|assistant|(?:content|usage|safety) polic|guideline|render (?:this|the|that)|(?:this|that|your) (?:request|content|prompt|passage|text|material|line)|comply"),
    "de": (r"leid|leider|entschuldig|kann (?:ich|das|diese|dies)|nicht (?:möglich|übersetz|bearbeit|helfen|erlaubt)|darf|verweiger|ablehn", r"übersetz|sprachmodell|\bKI\b|richtlinie|anfrage|inhaltsrichtlinie"),
    "fr": (r"désolé|pardon|regrett|ne peux|ne suis pas|impossible|incapable|refuse|ne puis|dois (?:refuser|décliner)", r"tradui|traduc|modèle de langage|\bIA\b|politique|(?:cette|votre) (?:demande|requête)|ce (?:contenu|texte|passage)"),
    "es": (r"siento|disculp|perd[oó]n|no puedo|no me es posible|no es posible|incapaz|me niego|rechaz|debo", r"traduc|modelo de lenguaje|\bIA\b|política|solicitud|petición|este (?:texto|contenido|pasaje)"),
    "ru": (r"извин|прост|сожален|не могу|не в состоянии|невозможно|вынужден|отказ|не вправе", r"перев[её]?[сдо]|языковая модель|\bИИ\b|политик|запрос|этот текст|содержани[ея]м?\b|контент"),
    "zh": (r"抱歉|对不起|無法|无法|不能|拒绝|恕|不便|不可以|不提供", r"翻译|翻譯|译文|譯文|语言模型|語言模型|人工智能|政策|请求|內容|内容|该文本|此文本"),
    "ja": (r"申し訳|すみません|ごめん|できません|できかね|致しかね|お断り|不可能|お応え", r"翻訳|言語モデル|AI|ポリシー|リクエスト|ご要望|この(?:内容|文|テキスト)|コンテンツ"),
    "ko": (r"죄송|미안|유감|수 없|불가능|거절|거부|어렵", r"번역|언어 모델|AI|정책|요청|이 (?:내용|텍스트|문장)|콘텐츠"),
}
# Short whole answers that decline without naming what.
_SHORT = r"(?i)\A[^\p{L}]*(?:note|notice|assistant|answer|translation|anmerkung|hinweis|注|备注|注意)?[^\p{L}]*(?:(?:i['’]m|i am) (?:very |so )?sorry[,.;]?\s*(?:but )?)?(?:sorry[,.;]?\s*(?:but )?)?(?:i (?:cannot|can['’]?t|can not|am unable to|won['’]?t|am not able to) (?:help|assist|do|comply|continue)(?: you)?(?: with)?(?: (?:that|this|it|your request|this request|the request))?|unable to comply.{0,60}|request (?:denied|refused|declined)|i must (?:decline|refuse).{0,60}|i (?:decline|refuse).{0,60}|(?:leider )?(?:kann|darf) ich (?:dabei |das |ihnen |dir |euch )*nicht (?:helfen|tun|machen)|je ne peux pas (?:vous |t['’])?(?:aider|faire cela)|no puedo (?:ayudar(?:te|le|os)?|hacer)(?: con (?:eso|esto))?|(?:с этим )?(?:я )?не могу (?:с этим |вам |тебе )*помочь|我?(?:无法|不能)(?:为您|为你)?(?:帮助|协助|提供帮助)(?:您|你)?|お手伝いできません|도와드릴 수 없습니다)[^\p{L}]*\z"


# Parts of words of which each language's refusals hold at least one; a plain look for them comes before the expressions.
_STEMS = {
    "en": "translat,language model,AI,assistant,polic,guideline,render,request,content,prompt,passage,text,material,line,comply",
    "de": "bersetz,sprachmodell,KI,richtlinie,anfrage",
    "fr": "tradu,langage,IA,politique,demande,requête,ce contenu,ce texte,ce passage",
    "es": "traduc,lenguaje,IA,política,solicitud,petición,este texto,este contenido,este pasaje",
    "ru": "перев,языковая,ИИ,политик,запрос,этот текст,содержани,контент",
    "zh": "翻译,翻譯,译文,譯文,语言模型,語言模型,人工智能,政策,请求,內容,内容,文本",
    "ja": "翻訳,言語モデル,AI,ポリシー,リクエスト,要望,この,コンテンツ",
    "ko": "번역,언어 모델,AI,정책,요청,이 내용,이 텍스트,이 문장,콘텐츠",
}


def _any_stem(low: Column, langs: list[str]) -> Column:
    """Whether lower-case text holds a stem: plain searches, and one expression for stems of two letters, which must stand alone.

    A text in which no two Latin letters meet is not searched for stems that
    hold two, a text in ASCII only for those.
    """
    stems = {x.lower() for lang in langs for x in _STEMS[lang].split(",")}
    short = sorted(x for x in stems if len(x) == 2 and x.isalpha() and (x.isascii() or x == "ии"))
    # a stem that holds another one adds nothing
    plain = sorted(x for x in stems - set(short) if not any(y != x and y in x for y in stems - set(short)))
    held = lambda xs: functools.reduce(operator.or_, (low.contains(x) for x in xs), F.lit(False))
    latin = lambda xs: [x for x in xs if re.search("[a-z]{2}", x)]
    signs = lambda xs: [x for x in xs if x not in latin(xs) and not x.isascii()]
    assert all(len(latin(xs)) + len(signs(xs)) == len(xs) for xs in (short, plain))
    alone = low.rlike(rf"(?<!\p{{L}})(?:{'|'.join(short)})(?![a-zа-я])") if short else F.lit(False)
    either = lambda part: held(part(plain)) | held(part(short)) & alone
    return (F.octet_length(low) > F.length(low)) & either(signs) | low.rlike("[a-z]{2}") & either(latin)


def _long_refusal(text: Column, low: Column) -> Column:
    out = F.lit(False)
    for lang, (a, b) in _DECLINE.items():
        # both in one sentence or its neighbour
        out = out | _any_stem(low, [lang]) & text.rlike(f"(?iu)(?:{a})[\\s\\S]{{0,90}}(?:{b})|(?:{b})[\\s\\S]{{0,90}}(?:{a})")
    return _any_stem(low, list(_DECLINE)) & out


def _refusal(text: Column, low: Column) -> Column:
    return text.rlike(_SHORT) | _long_refusal(text, low)


def _declines(text: Column) -> Column:
    """Whether a prompt itself speaks of declining a translation or a request."""
    return F.coalesce(_long_refusal(text, F.lower(text)), F.lit(False))


def _repeatable(text: Column) -> Column:
    """Sources whose letters stand only in placeholders, markup or all-capital abbreviations."""
    bare = F.regexp_replace(text, _MARKUP, " ")
    return ~bare.rlike(r"\p{L}") | bare.rlike(r"\A[^\p{L}]*\p{Lu}[\p{Lu}\p{N}]{0,4}[^\p{L}]*\z") | bare.rlike(r"\A[^\p{L}]*\p{Lu}[\p{Lu}\p{N}]{0,3}(?:\s*[^\p{L}\s]+\s*\p{Lu}[\p{Lu}\p{N}]{0,3})+[^\p{L}]*\z")


_LANG_OUT = "key bigint, best string, posterior double, prompt string"
_LANG_ARROW = pa.schema([("key", pa.int64()), ("best", pa.string()), ("posterior", pa.float64()), ("prompt", pa.string())])
#: Bigrams and trigrams tell of the same letters, so their sum counts half.
_TEMPER = 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def language_posteriors(prompts: np.ndarray, responses: np.ndarray, src: np.ndarray, dst: np.ndarray, strays: float = 0.01, labelled: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of prompt and response languages from their log-likelihoods (rows x languages).

    ``src`` and ``dst`` number the labelled languages, -1 where unknown. A
    prompt is in its labelled language with a prior of ``labelled``. A
    response is in ``dst`` unless it strays (prior ``strays``): then it stays
    in the prompt's language, weighed by the prompt's posterior, as often as
    it falls into any other.
    """
    n, k = responses.shape
    row = np.arange(n)
    prior = np.full((n, k), (1 - labelled) / max(k - 1, 1))
    prior[row[src >= 0], src[src >= 0]] = labelled
    prior[src < 0] = 1 / k
    asked = _softmax(_TEMPER * prompts + np.log(prior))
    away = 0.5 * asked + 0.5 / k
    away[row, dst] = 0
    away *= strays / away.sum(1, keepdims=True) if k > 1 else 0
    away[row, dst] = 1 - strays
    with np.errstate(divide="ignore"):
        return asked, _softmax(_TEMPER * responses + np.log(away))


def _may_stray(responses: np.ndarray, dst: np.ndarray, strays: float = 0.01) -> np.ndarray:
    """Whether some prompt could make a response more probably strayed than not.

    Before the response is seen, no single other language has more than
    ``strays`` x (k + 1) / (k - 1), which a prompt surely in it would give.
    """
    n, k = responses.shape
    if k < 2:
        return np.zeros(n, bool)
    like = np.exp(_TEMPER * (responses - responses.max(1, keepdims=True)))
    own = like[np.arange(n), dst]
    # a little more than the bound, for rounding
    return 1.001 * strays * (k + 1) / (k - 1) * (like.sum(1) - own) >= (1 - strays) * own


def _judge(model_b):
    """Responses (key, prompt_lang, lang, prompt, response) that are more probably in a language other than ``lang``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nb: langid.NaiveBayes = model_b.value
        at = {x: i for i, x in enumerate(nb.langs)}
        for b in batches:
            keys, srcs, langs, prompts, responses = (c.to_pylist() for c in b.columns)
            # Without a known target no language is wrong.
            rows = [i for i, x in enumerate(langs) if x in at]
            if not rows:
                continue
            dst = np.array([at[langs[i]] for i in rows])
            scored = nb.score([responses[i] for i in rows])
            # Most responses need no look at their prompts.
            may = np.flatnonzero(_may_stray(scored, dst))
            if not len(may):
                continue
            rows, dst, scored = [rows[i] for i in may], dst[may], scored[may]
            asked, got = language_posteriors(nb.score([prompts[i] or "" for i in rows]), scored, np.array([at.get(srcs[i], -1) for i in rows]), dst)
            wrong = 1 - got[np.arange(len(rows)), dst]
            hit = np.flatnonzero(wrong > 0.5)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array([keys[rows[i]] for i in hit], pa.int64()), pa.array([nb.langs[j] for j in np.argmax(got[hit], 1)]), pa.array(wrong[hit]), pa.array([nb.langs[j] for j in np.argmax(asked[hit], 1)])], schema=_LANG_ARROW)

    return run


def fit_languages(labelled: DataFrame, per_language: int = langid.SAMPLE_PER_LANGUAGE) -> langid.NaiveBayes | None:
    """A model from (lang, text, h), the ``per_language`` texts with the smallest hash ``h`` of each language."""
    ok = labelled.filter("lang is not null and text is not null and text <> ''")
    # A row per language code. Hashes below a language's fraction leave about twice the sample, whatever its size.
    n = ok.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    near = ok.join(F.broadcast(n), "lang").filter(F.pmod("h", F.lit(1 << 30)) * F.col("n") < F.lit(float(1 << 30) * 2 * per_language))
    w = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text")
    got = near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_language).select("lang", "text").toPandas()
    return langid.NaiveBayes(got["text"].tolist(), got["lang"].tolist()) if len(got) else None


def _staged(pairs: DataFrame, texts: bool) -> DataFrame:
    """Pairs with a letter in the prompt: the defect that the pair itself shows, if any, and the measures of a cut.

    The texts themselves are kept only where ``texts`` asks for them.
    """
    p = pairs.filter(F.col("prompt").rlike(r"\p{L}")).withColumn("response", F.coalesce("response", F.lit(""))).withColumn("low", F.lower("response"))
    r, q = F.col("response"), F.col("prompt")
    empty = ~r.rlike(r"[\p{L}\p{N}]") | r.rlike(_STAND) | r.rlike(_JSON_EMPTY)
    lead = lambda c: F.lower(F.regexp_extract(c, r"[\p{L}\p{N}]", 0))
    # Copies agree in their first letter, which rules most pairs out before whole texts are compared.
    copy = (lead(r) == lead(q)) & (canonical(r) == canonical(q))
    first = F.when(empty, "empty").when(_refusal(r, F.col("low")) & ~_declines(q), "refusal").when(copy, F.when(_repeatable(q), "fine").otherwise("copy"))
    kept = ["prompt", "response"] if texts else []
    return cut(p.select("key", F.coalesce("src", F.lit("")).alias("src"), *kept, "lang", "prompt_lang", first.alias("kind"), *[c.alias(k) for k, c in _measured().items()]), "pairs-staged")


def truncated(pairs: DataFrame) -> DataFrame:
    """Keys of responses that stop early, among pairs whose response is an answer at all."""
    return _cut_keys(_staged(pairs, False).filter("kind is null"))


def defects(pairs: DataFrame) -> DataFrame:
    """(key, defect) of every defective pair.

    ``pairs`` holds (key, src, prompt, response, prompt_lang, lang): ``src``
    is who delivered the response, ``lang`` the language it should be in
    (null: any). A prompt without letters is no case, null or not; a null
    response counts as empty; repeated rows with one key give one row.
    """
    staged = _staged(pairs, True)
    rest = staged.filter("kind is null")
    # Spikes and endings come from all texts that are answers at all.
    short = cut(_cut_keys(rest), "pairs-short")
    model = fit_languages(_labelled(rest))
    out = staged.filter("kind is not null and kind <> 'fine'").select("key", F.col("kind").alias("defect")).unionByName(short.select("key", F.lit("truncated").alias("defect")))
    if model is not None:
        model_b = pairs.sparkSession.sparkContext.broadcast(model)
        bare = F.trim(F.regexp_replace("response", _MARKUP, " "))
        other = rest.select("key", "prompt_lang", "lang", "prompt", bare.alias("t")).filter(F.col("t").rlike(r"\p{L}")).mapInArrow(_judge(model_b), _LANG_OUT)
        out = out.unionByName(other.join(short, "key", "left_anti").select("key", F.lit("wrong_language").alias("defect")))
    return out.distinct()


def _labelled(rest: DataFrame) -> DataFrame:
    side = lambda lang, text: rest.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64("key", F.lit(text)).alias("h"))
    return side("lang", "response").unionByName(side("prompt_lang", "prompt"))
