"""Problem 7: text that looks alike brought to one form.

DuckDB runs inside every Arrow batch: one SQL statement composes accents
(``nfc_normalize``), maps compatibility forms and look-alike letters
(``translate``) and drops or replaces invisible characters and odd blanks
(regular expressions). Which characters are compatibility forms follows from
Unicode's own tables by the rules below; only look-alike letters, for which
Unicode's core tables have none, are a fixed list.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter, and that letter.
CYRILLIC_LIKE = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}
GREEK_LIKE = {"α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}

# Radicals without a decomposition in Unicode's tables, and the ideograph of the same look.
_RADICALS = "⺁厂⺂乛⺃乚⺄乙⺅亻⺆冂⺇几⺈刀⺉刂⺊卜⺋㔾⺌小⺍小⺎兀⺏尣⺐尢⺑尣⺒巳⺓幺⺔彑⺕彐⺖忄⺗心⺘扌⺙攵⺛旡⺜日⺝月⺞歺⺠民⺡氵⺢氺⺣灬⺤爫⺥爫⺦丬⺧牛⺨犭⺩王⺪疋⺫罒⺬示⺭礻⺮竹⺯糹⺰纟⺱罓⺲罒⺳㓁⺴冗⺵罒⺶羊⺷羊⺸羋⺹耂⺺肀⺻聿⺼月⺽臼⺾艹⺿艹⻀艹⻁虎⻂衤⻃覀⻄西⻅见⻆角⻇角⻈讠⻉贝⻊足⻋车⻌辶⻍辶⻎辶⻏阝⻐钅⻑長⻒镸⻓长⻔门⻕阜⻖阝⻗雨⻘青⻙韦⻚页⻛风⻜飞⻝食⻞食⻟飠⻠饣⻡首⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄⻪黾⻫斉⻬齐⻭歯⻮齿⻯竜⻰龙⻱龜⻲亀"
RADICAL_LIKE = dict(zip(_RADICALS[::2], _RADICALS[1::2]))

#: Compatibility forms that are ordinary letters of their own script.
_ORDINARY = {0x0E33, 0x0EB3, 0x0EDC, 0x0EDD, 0x00B5, 0x0F77, 0x0F79}
#: Kinds of compatibility that make a sign, not a letter in another dress.
_SIGNS = ("<super>", "<sub>", "<fraction>", "<square>")
BLANKS = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
NOTHING = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"


@lru_cache(1)
def compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility forms of letters and digits: those that map to one character, and the rest."""
    one, more = dict(RADICAL_LIKE), {}
    for cp in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1F100, 0x1F1AD), *range(0x1FBF0, 0x1FBFA), *range(0x2F800, 0x2FA20)]:
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if not d or cp in _ORDINARY or unicodedata.normalize("NFC", c) != c:
            continue  # what NFC changes, nfc_normalize does
        kind = d.split()[0]
        cat = unicodedata.category(c)
        if not kind.startswith("<") or kind in _SIGNS or 0x3131 <= cp <= 0x318E:
            continue
        to = unicodedata.normalize("NFKC", c)
        letters = cat[0] == "L" or cat in ("Nd", "Nl") or cat == "So" and (kind == "<compat>" and 0x2E80 <= cp <= 0x2FDF or 0x1F100 <= cp)
        if letters and all(unicodedata.category(x)[0] in "LNM" for x in to):
            (one if len(to) == 1 else more)[c] = to
    return one, more


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: dict[str, str]) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


@lru_cache(1)
def form_sql() -> str:
    """SQL that gives (key, form, odd) for the Arrow batch ``texts`` (key, t)."""
    one, more = compatible()
    src, dst = "".join(one), "".join(one.values())
    look = CYRILLIC_LIKE | GREEK_LIKE
    lsrc, ldst = "".join(look), "".join(look.values())
    back = {v: k for k, v in reversed(CYRILLIC_LIKE.items())}
    rsrc, rdst = "".join(back), "".join(back.values())
    pairs = ", ".join(f"{_q(k)}: {_q(v)}" for k, v in more.items())
    word = r"[\p{L}\p{M}]+"
    mixed = r"[\p{Latin}]\p{M}*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}]\p{M}*[\p{Latin}]|\p{Greek}\p{M}*\p{Cyrillic}|\p{Cyrillic}\p{M}*\p{Greek}"
    # A word of two scripts is written in that of most of its letters; on a tie, in Latin.
    latin, cyr = r"length(regexp_replace(w, '[^\p{Latin}]', '', 'g'))", r"length(regexp_replace(w, '[^\p{Cyrillic}]', '', 'g'))"
    # Letters that exist in one script only settle it: a Cyrillic letter without a Latin twin, or the other way round.
    only_cyr, only_lat = f"length(regexp_replace(translate(w, {_q(lsrc)}, ''), '[^\\p{{Cyrillic}}]', '', 'g'))", f"length(regexp_replace(translate(w, {_q(rsrc)}, ''), '[^\\p{{Latin}}]', '', 'g'))"
    fixed = f"CASE WHEN NOT regexp_matches(w, {_q(mixed)}) THEN w WHEN {only_cyr} > 0 AND {only_lat} = 0 OR {only_cyr} > 0 AND {cyr} > {latin} OR {only_lat} = 0 AND {cyr} > {latin} THEN translate(w, {_q(rsrc)}, {_q(rdst)}) ELSE translate(w, {_q(lsrc)}, {_q(ldst)}) END"
    return f"""
    WITH a AS (
      SELECT key, t,
        CASE WHEN regexp_matches(t, {_q(_class(more))})
          THEN array_to_string(list_transform(string_split(t, ''), lambda c: coalesce(MAP {{{pairs}}}[c], c)), '') ELSE t END AS t1
      FROM texts WHERE regexp_matches(t, '[^ -~\\n\\t\\r]')
    ), b AS (
      SELECT key, t, nfc_normalize(translate(regexp_replace(regexp_replace(t1, {_q(NOTHING)}, '', 'g'), {_q(BLANKS)}, ' ', 'g'), {_q(src)}, {_q(dst)})) AS t2 FROM a
    )
    SELECT key, CASE WHEN regexp_matches(t2, {_q(mixed)})
        THEN list_aggregate(list_transform(regexp_extract_all(t2, {_q(word + r"|[^\p{L}\p{M}]+")}), lambda w: {fixed}), 'string_agg', '')
        ELSE t2 END AS form
    FROM b WHERE t2 <> t OR regexp_matches(t2, {_q(mixed)})
    """


_OUT = "key bigint, form string"
_ARROW = pa.schema([("key", pa.int64()), ("form", pa.string())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
    sql = form_sql()
    for b in batches:
        if not b.num_rows:
            continue
        con.register("texts", pa.Table.from_batches([b.rename_columns(["key", "t"])]))
        got = con.execute(sql).to_arrow_table()
        con.unregister("texts")
        for r in got.cast(_ARROW).to_batches():
            if r.num_rows:
                yield r
    con.close()


def odd_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form): the consistent form of every text of ``df`` that isn't in it.

    Texts that are missing from the result are in that form already; null
    and empty texts never appear. Repeated keys give a row for each text.
    """
    # ASCII is always in form: only other texts travel to Python.
    t = F.col(text)
    return df.select(F.col(key).cast("bigint").alias("key"), t.alias("t")).filter(t.isNotNull() & (F.octet_length(t) > F.length(t))).mapInArrow(_run, _OUT)
