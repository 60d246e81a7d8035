"""Problem 10: sentence units in ten languages.

Segmentation rules are pairs of regular expressions, one for the text before
a position and one for the text after it, with the verdict break or no break.
At every candidate position the first pair of the language's ordered table
that matches decides. Tables cascade: rules of all scripts, rules of the
language, then the default. Languages are told apart by the script of the
text itself, and where scripts are shared by common words; the stored
language only settles what the text leaves open.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters before a mark within which every rule but those of quotations finds what it needs.
REACH = 32

# „…“ closes with the mark that opens “…”: it closes where no word follows.
_CLOSE = r"(?:[\"'”’»›\)\]）】」』〉》\*_]|“(?![^\W_]|[「『{<\[]))"
_END = r"[.!?…。！？।॥｡]"
_ENDS = rf"{_END}+(?:(?:[  ]?»|{_CLOSE}|</\w+>)*{_END}+)*"
#: A candidate: closing marks with what they close, or any blank between Thai characters.
_CANDIDATE = re.compile(rf"{_ENDS}(?:[  \s]?»|{_CLOSE}|</\w+>)*|(?<=[฀-๿])\s+(?=[฀-๿])")
_THAI_GAP = re.compile(r"\s")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n\s*")
# A line break before which a unit may end because a list item follows.
_MARKER = re.compile(r"\n[^\S\n]*(?=(?:[-•*–—·▪‣◦]|(?P<open>\()?(?P<n>\d{1,3})[.)、]|[a-zA-Z]\))[^\S\n]+\S)")

# Abbreviations after which a sentence goes on whatever follows (titles and the like) ...
_ALWAYS = {
    "en": "Mr Mrs Ms Dr Prof Capt Sgt St Lt Col Gen Rev Hon Maj Cmdr Fr Sr Jr Mt Messrs Gov Sen vs i.e e.g viz cf al approx",
    "de": "Dr Prof Hr Fr Frl St Hauptm Hptm Lt Gen Ing Mag bzw z.B d.h u.a z.T o.ä i.d.R ca vgl sog Nr Abs Kap Abb Bd Art Str inkl exkl evtl ggf Sankt dt engl geb gest Jh Mio Mrd S Aufl",
    "fr": "M MM Mme Mmes Mlle Mlles Me Dr Pr St Ste Mgr cf env p.ex c.-à-d vol chap fig pp av apr éd réf tél no nº art",
    "es": "sr sra dr dra Sr Sra Sres Srta Dr Dra D Dña Ud Uds Avda Av aprox p.ej pág págs cap Cap fig núm vol art n tel St Sto Sta Prof Lic Ing Gral Cnel Cap izq dcha",
    "ru": "проф акад доц г-н г-жа т.е т.к т.н т.п ок см См стр рис табл гл им ул пл д корп обл р руб коп тыс млн млрд св ср напр и.о с т г п ст",
    "hi": "डॉ श्री श्रीमती सुश्री प्रो पं रु मि",
}
# ... and those after which it goes on only with a number or a small letter.
_MAYBE = {
    "en": "no nos vol vols p pp fig figs Fig Figs tab Tab tabs ch chap sec Sec art ed eds etc a.m p.m ca c ft lb oz in min max sq est dept Inc Ltd Co Corp Ave Rd Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "usw etc Tab Fig Anm Jan Feb Mrz Apr Jun Jul Aug Sep Okt Nov Dez Std Min Sek Tel",
    "fr": "p col etc janv févr avr juil sept oct nov déc min sec",
    "es": "etc a.m p.m p a ed ene feb mar abr jun jul ago sep oct nov dic min seg",
    "ru": "т.д др пр в вв гг л м мин сек час",
    "hi": "",
}
# Words of speech that follow a quotation in scripts without capitals.
_SPEECH = {"zh": "说|道|喊|问|答|叫|吼|嚷|喝|念|嘟囔|低语", "ja": "言|叫|聞|尋|答|呟|つぶや|ささや", "hi": "कहा|पूछा|चिल्ला|बोल|पुकार|फुसफुसा|कहते|कहती", "th": "พูด|ถาม|ตะโกน|กล่าว|บอก|ตอบ", "ko": "말했|물었|외쳤|대답|소리쳤|속삭"}
# Frequent words that tell languages of one script apart.
_COMMON = {
    "en": "the of and to is was for with that from has you are his her who it at by in on not",
    "de": "der die das und ist nicht ein eine zu den dem von mit auf für sich wer aus wie ich es im an des hat",
    "fr": "le la les de des et est un une du que qui dans pour pas sur au aux ne se vous je ce par avec",
    "es": "el la los las de y que en un una es por con no se del para su al lo más te tu le",
}
_COMMON_OF: dict[str, str] = {}
for _l, _w in _COMMON.items():
    for _x in _w.split():
        _COMMON_OF[_x] = _COMMON_OF.get(_x, "") + _l + " "


def _words(s: str) -> str:
    # Spaces may stand inside an abbreviation of several parts.
    parts = sorted(s.split(), key=len, reverse=True)
    return "|".join(re.escape(p).replace(r"\.", r"\.\s?") for p in parts)


def _abbreviation(words: str) -> str:
    return rf"(?:^|[^\w.])(?:{words})\.\Z" if words else r"(?!)"


def _rule(verdict: bool, before: str, after: str, quoted: bool = False) -> tuple[bool, re.Pattern, re.Pattern, bool]:
    """``before`` ends at a position, ``after`` begins there; ``quoted`` rules look back to the opening of a quotation."""
    return verdict, re.compile(before), re.compile(after), quoted


_QUOTES = re.compile(r"[“”「」『』\"]")


_ANY = r"(?s:.)?"
_SMALL = r"\s*[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ]"


def _common_head() -> list:
    return [
        # white space between Thai characters
        _rule(True, r"[฀-๿]\Z", r"\s+[฀-๿]"),
        # marks of trailing off, also inside closing quotes, within a line of text
        _rule(False, rf"(?:\.\.+|…+)(?:[  ]?»|{_CLOSE})*\Z", r"[^\S\n]*\n?[^\S\n]*\S"),
        # a point inside a number, a version or a name of a file
        _rule(False, r"\w[.!?]\Z", r"[\d_]"),
        _rule(False, r"(?:^|\s)\.\Z", r"\w"),
        _rule(False, r"\w\.\Z", r"[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ-๿　-퟿]"),
        # the number of a list item or of a heading belongs to what follows
        _rule(False, r"(?:^|\n)[^\S\n]*\(?\d{1,3}\.\Z", r"[^\S\n]+\S"),
        # a closed quotation or bracket that its own sentence goes on from
        _rule(False, rf"{_END}(?:[  \s]?»|{_CLOSE})+\Z", r"\s*[,;:，、；：—–-]"),
        _rule(False, rf"[.!?](?:[  \s]?»|{_CLOSE})+\Z", r"\s+[a-zß-öø-ÿа-яё]"),
        _rule(False, rf"[!?](?:</\w+>)+\Z", r"\s+[a-zß-öø-ÿа-яё]"),
    ]


def _tables(lang: str) -> list:
    rules = _common_head()
    # titles and the like of all languages, as documents quote one another
    rules.append(_rule(False, _abbreviation(_words(" ".join(w for x in _ALWAYS.values() for w in x.split() if len(w) > 1 and w[0].isupper()) + " " + _ALWAYS["ru"] + " " + _ALWAYS["hi"])), r"\s*\S"))
    if lang in _ALWAYS:
        rules += [
            _rule(False, _abbreviation(_words(_ALWAYS[lang])), r"\s*\S"),
            _rule(False, _abbreviation(_words(_MAYBE[lang])), rf"(?:\s*\d|\s*[,;:)]|{_SMALL}|\s*[IVXLC]+\b)"),
            # initials and abbreviations of single letters
            _rule(False, r"(?:^|[^\w’'-])[A-ZÀ-ÖØ-ÞА-ЯЁ]\.\Z", r"\s*(?:[A-ZÀ-ÖØ-ÞА-ЯЁ][\w.]|[a-zß-öø-ÿа-яё])"),
            _rule(False, r"(?:[^\W\d_]\.){2,}\Z", _SMALL),
            _rule(False, r"(?:^|\W)[^\W\d_]\.\Z", r"\s?[^\W\d_]\."),
        ]
    if lang == "de":
        rules += [
            _rule(False, r"(?i:\b(?:am|der|die|das|dem|den|des|im|vom|zum|zur|beim|bis|ab|seit|und|jede[rnms]?|diese[rnms]?|sein(?:e[rnms]?)?)\s(?:\d{1,3}|[ivxlc]+))\.\Z", r"\s+\S"),
            _rule(False, r"\d\.\Z", r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Tag|Woche|Monat|Jahr|Stunde|Kapitel|Stock|Klasse)"),
        ]
    if lang in ("zh", "ja", "hi", "th", "ko"):
        speech = _SPEECH[lang]
        rules += [
            # a quotation that follows a colon or words of its sentence closes it
            _rule(True, r"[：:]\s*[“「『\"][^“”「」『』\"]*[。！？।!?.]+[”」』\"]\Z", r"\s*[^\s，、,]", True),
            # particles of quotation
            _rule(False, rf"{_END}[”」』\"]\Z", r"(?:と|って|라고|이라고|라며|하고|고)"),
            _rule(False, rf"(?:^|[\s。！？।!?.\n”」』）\)]|\d[.)]\s|[•*-]\s)[“「『\"][^“”「」『』\"]*[。！？।!?.]+[”」』\"]\Z", rf"\s*[^。！？।!?\n“”「」『』：:]{{0,60}}(?:{speech})", True),
            _rule(False, rf"[。！？][）\)]\Z", r"(?:は|が|を|に|の|と|で|も)"),
        ]
    rules += [
        # default: closing marks before a blank, or anywhere in scripts without blanks
        _rule(True, rf"[。！？।॥｡]+(?:{_CLOSE}|{_END})*\Z", _ANY),
        _rule(True, rf"{_END}(?:[  \s]?»|{_CLOSE}|</\w+>)*\Z", r"\s|\Z"),
        # a missing blank: two words, the second with a capital or in a script without any
        _rule(True, r"[^\W_]{2,}[”»\"')\]]*[.!?]+[”»“\"')\]]*\Z", r"[“„«¿¡(\[<]*(?:[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\dA-ZА-ЯЁ]|[ऀ-๿　-퟿])"),
        _rule(True, r"[!?]+[”»\"')\]]*\Z", r"[“„«¿¡(\[<]*[A-ZÀ-ÖØ-ÞА-ЯЁ\[]"),
        _rule(True, r"[^\W_]{2,}[.!?]+\Z", r"[“„«¿¡(\[<{]"),
    ]
    return rules


_RULES: dict[str, list] = {}
_SCRIPTS = [("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ko", re.compile("[가-힣]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")), ("ru", re.compile("[Ѐ-ӿ]"))]
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_WORD = re.compile(r"[^\W\d_]+")


def language(text: str, given: str | None = None) -> str:
    """Language of a text by its script and common words; ``given`` settles a draw."""
    latin = len(_LATIN.findall(text))
    if not text.isascii():
        n = {lang: len(rx.findall(text)) for lang, rx in _SCRIPTS}
        # A sign of these scripts says as much as several Latin letters.
        if n["ja"] * 8 > n["zh"]:
            n["ja"] += n["zh"]
            n["zh"] = 0
        top = max(n, key=n.get)
        if n[top] * (1 if top == "ru" else 2) > latin:
            return top
    if not latin:
        return given if given in _SPEECH or given in _ALWAYS else "en"
    votes = dict.fromkeys(_COMMON, 0.0)
    for w in _WORD.findall(text.lower()):
        for lang in _COMMON_OF.get(w, "").split():
            votes[lang] += 1
    top = max(votes.values())
    best = [x for x in votes if votes[x] == top]
    return given if given in best else best[0]


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines."""
    at = 0
    for m in _BLANK_LINE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


#: What decides a line break before a list item: break, no break, or (None) whether the item's number counts on from the last one.
_LINE_RULES = [
    # a number inside an open bracket that closes after it
    (False, re.compile(r"\([^()]*\Z"), re.compile(r"\s*\d[^()]{0,3}\)")),
    (None, re.compile(r"\Z"), re.compile(r"\s*\(?\d")),
    # a dash at a wrapped line's start
    (True, re.compile(r"[.!?…。！？।:：][^\S\n]*\Z"), re.compile(r"\s*[–—]")),
    (False, re.compile(r"\Z"), re.compile(r"\s*[–—]")),
    (True, re.compile(r"\Z"), re.compile(r"\s*\S")),
]
_ENDED = re.compile(r"(?:[.!?…。！？।:：»”\"]|\A|\n)[^\S\n]*\Z")
_HEAD = re.compile(r"\s*\(?(\d{1,3})[.)]")


def _list_starts(text: str) -> list[int]:
    """Line breaks of a block before which a unit ends because a list item follows."""
    out: list[int] = []
    head = _HEAD.match(text)
    last = int(head[1]) if head else None
    bracket, seen = -1, 0  # where the bracket stands that is open
    for m in _MARKER.finditer(text):
        at = m.start()
        shut, opened = text.rfind(")", seen, at), text.rfind("(", seen, at)
        bracket, seen = opened if opened > shut else -1 if shut >= 0 else bracket, at
        for verdict, before, after in _LINE_RULES:
            # a bracket is looked for where it opens, other marks stand next to the break
            lo = (bracket if bracket >= 0 else at) if "(" in before.pattern[:2] else max(0, at - REACH)
            if not (after.match(text, at) and before.search(text, lo, at)):
                continue
            if verdict is None:
                # A wrapped line may begin with a number: the first one follows a closed line.
                n = int(m["n"])
                verdict = n == last + 1 if last is not None else n in (0, 1) and _ENDED.search(text, max(0, at - REACH), at) is not None
                last = n if verdict else last
            if verdict:
                out.append(at)
            break
    return out


#: Marks that close a sentence wherever they stand alone.
_PLAIN = set("。！？।॥｡")
#: Last parts of all abbreviations: words that may stand before a point inside a sentence.
_LAST_PARTS = {re.findall(r"[^\W\d_]+", w)[-1] for t in (_ALWAYS, _MAYBE) for ws in t.values() for w in ws.split()}
_ROMAN = set("ivxlcIVXLC")


def _plain(text: str, mark: int, p: int) -> bool:
    """Whether a candidate of one mark is a break by the default rules and no other rule can apply: what most marks are."""
    if p - mark != 1:
        return False
    if text[mark] in _PLAIN:
        return True
    if text[mark] not in ".!?" or not text[p].isspace():
        return False
    lo = max(0, mark - REACH)
    at = text.rfind(" ", lo, mark)
    if at < 0 < lo:
        return False
    word = text[max(at + 1, lo) : mark]
    return len(word) > 1 and word.isalpha() and word not in _LAST_PARTS and not _ROMAN.issuperset(word)


def units(text: str | None, given: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, in code points, without surrounding white space."""
    if not text or text.isspace():
        return []
    return _units(text, language(text, given))


def _units(text: str, lang: str) -> list[tuple[int, int]]:
    rules = _RULES.get(lang)
    if rules is None:
        rules = _RULES[lang] = _tables(lang)
    out: list[tuple[int, int]] = []
    for a, b in _blocks(text):
        block, n = text[a:b], b - a
        cuts = _list_starts(block) if "\n" in block else []
        quotes: list[int] | None = None
        for m in _CANDIDATE.finditer(block):
            mark = m.start()
            p = mark if block[mark].isspace() else m.end()
            if p >= n:
                continue
            if _plain(block, mark, p):
                cuts.append(p)
                continue
            for verdict, rb, ra, quoted in rules:
                if not ra.match(block, p):
                    continue
                lo = max(0, mark - REACH)
                if quoted:
                    # from the quotation's opening mark, however far back it stands
                    if quotes is None:
                        quotes = [q.start() for q in _QUOTES.finditer(block)]
                    i = bisect_left(quotes, mark)
                    if not i:
                        continue
                    lo = max(0, quotes[i - 1] - REACH)
                if rb.search(block, lo, p):
                    if verdict:
                        cuts.append(p)
                    break
        at = a
        for c in [*sorted({a + x for x in cuts}), b]:
            s, e = at, c
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((s, e))
            at = c
    return out


_ARROW = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for k, t, given in zip(*(c.to_pylist() for c in b.columns)):
            if t.isspace():
                continue
            lang = language(t, given)
            u = _units(t, lang)
            out.append((k, lang, [x for x, _ in u], [y for _, y in u]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def sentence_units(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """(key, unit, start_char, end_char, lang) of every sentence unit of every document.

    Offsets count code points, ``start_char`` from 0, ``end_char`` exclusive.
    ``lang`` names the column with the stored language, which may be null or
    wrong. Null, empty and blank texts give no unit; repeated rows each give
    theirs; no shuffle takes place, whatever the number of documents.
    """
    given = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    got = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t"), given.alias("l")).filter("t is not null and t <> ''").mapInArrow(_run, "key bigint, lang string, starts array<bigint>, ends array<bigint>")
    return got.select("key", "lang", F.posexplode(F.arrays_zip("starts", "ends")).alias("unit", "_u")).select(F.col("key").alias(key), "unit", F.col("_u.starts").alias("start_char"), F.col("_u.ends").alias("end_char"), "lang")
