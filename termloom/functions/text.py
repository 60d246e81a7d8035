"""Scalar functions on text as Spark columns: no Python runs for any of them.

Letters, digits and blanks follow Unicode; ``word characters`` are letters,
numbers and the underscore. All functions give null for null unless said
otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
_EDGE_L, _EDGE_R = rf"(?<!{W})", rf"(?!{W})"

# English function words that are no proper nouns at a sentence's start.
STOP_WORDS = (
    "the and but for nor yet not are was were has had have his her its our their your you she him they them who whom "
    "whose what which when where why how this that these those there here with without from into onto upon over under "
    "after before while until since then than only also just very some any all each every both few more most other such "
    "did does done can could will would shall should may might must let one two day step note nobody please yes"
).split()

# Short words that a translation may keep.
KEPT_WORDS = "ok no yes hp mp sp xp npc pc id ui ai mod bug app api url xml json html boss buff debuff dps tank healer pvp pve cm mm kg km gb mb kb".split()

# Names of languages by code.
LANGUAGE_NAMES = {
    "auto": "auto-detect (LLM decides)", "en": "English", "zh": "Simplified Chinese", "zh-Hant": "Traditional Chinese",
    "ja": "Japanese", "ko": "Korean", "fr": "French", "de": "German", "es": "Spanish", "ru": "Russian",
}


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    b = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"
    # the look back keeps long blanks inside a text from being tried from each of their characters
    return F.regexp_replace(x, rf"\A{b}+|(?<!{b}){b}+\z", "")


def norm_key(x: Column) -> Column:
    """The key of the glossary lookup."""
    return F.lower(strip(x))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distinct_ci(words: Column) -> Column:
    """Distinct without regard to case, the first spelling kept, order kept."""
    none = F.array().cast("array<string>")
    # A fold names the list once; a filter that looks things up in the list would compute it for every word.
    return F.aggregate(
        words, F.struct(none.alias("kept"), none.alias("low")),
        lambda acc, w: F.when(F.array_contains(acc["low"], F.lower(w)), acc).otherwise(
            F.struct(F.array_append(acc["kept"], w).alias("kept"), F.array_append(acc["low"], F.lower(w)).alias("low"))
        ),
        lambda acc: acc["kept"],
    )


def proper_nouns(text: Column, stop_words: list[str] | None = None) -> Column:
    """Capitalised ASCII words of three letters or more, stop words left out, distinct without regard to case."""
    found = F.regexp_extract_all(text, F.lit(rf"{_EDGE_L}[A-Z][a-z]{{2,}}{_EDGE_R}"), F.lit(0))
    stop = STOP_WORDS if stop_words is None else stop_words
    if stop:
        listed = F.array(*[F.lit(w) for w in stop])
        found = F.filter(found, lambda w: ~F.array_contains(listed, F.lower(w)))
    return distinct_ci(found)


def strip_possessive(kw: Column) -> Column:
    """What stands before ``'s`` inside a phrase (null if nothing does), or without ``'s`` at its end."""
    head = strip(F.element_at(F.split(kw, r"'\s*s\s+", 2), 1))
    return F.when(F.instr(kw, "'s ") > 0, F.when(head != "", head)).when(kw.endswith("'s"), strip(F.substring(kw, F.lit(1), F.length(kw) - 2))).otherwise(kw)


def strip_fence(x: Column) -> Column:
    """Without code fences."""
    return strip(F.regexp_replace(x, r"```(?:json)?", ""))


def clean_keywords(words: Column) -> Column:
    """Keywords stripped, blanks dropped, possessives resolved, distinct without regard to case."""
    kept = F.filter(F.transform(words, lambda w: strip(w)), lambda w: w.isNotNull() & (w != ""))
    return distinct_ci(F.filter(F.transform(kept, strip_possessive), lambda w: w.isNotNull()))


def parse_keyword_array(response: Column) -> Column:
    """A JSON list of strings from a model's reply; a list cut short gives its complete strings, anything else none."""
    r = strip_fence(response)
    whole = F.from_json(r, "array<string>")
    shut = r.startswith("[") & r.endswith("]")
    # up to the last string that a comma or bracket follows
    cut = F.regexp_extract(r, r'(?s)\A(\[.*"(?:[^"\\]++|\\.)*+")\s*[,\]]', 1)
    saved = F.from_json(F.concat(cut, F.lit("]")), "array<string>")
    out = F.when(shut & whole.isNotNull(), whole).when(r.startswith("[") & (cut != ""), saved)
    return F.coalesce(F.filter(out, lambda w: w.isNotNull()), F.array().cast("array<string>"))


def parse_translation(response: Column, source: Column) -> Column:
    """The ``translation`` of a model's reply: the JSON itself, else the span from the first to the last brace, else the reply."""
    r = strip_fence(response)
    is_object = F.from_json(r, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull() & r.startswith("{") & r.endswith("}")
    inner = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    inner_map = F.from_json(inner, "map<string,string>")
    inner_ok = (inner != "") & inner_map.isNotNull()
    return (
        F.when(is_object, F.coalesce(F.get_json_object(r, "$.translation"), source))
        .when(inner_ok, F.coalesce(F.get_json_object(inner, "$.translation"), strip(response)))
        .otherwise(strip(response))
    )


def strip_tags(x: Column) -> Column:
    """Without markup tags."""
    return F.regexp_replace(x, r"<[^>]+>", "")


def strip_placeholders(x: Column) -> Column:
    """Without placeholders like %d, {0} and [TAG]."""
    return F.regexp_replace(x, rf"%{W}+|\{{\p{{Nd}}+\}}|\[[^\]]*\]", "")


def english_words(text: Column) -> Column:
    """Distinct lower-case ASCII words of two letters or more, outside tags and placeholders, sorted."""
    low = F.lower(strip_placeholders(strip_tags(text)))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(rf"{_EDGE_L}[a-z]{{2,}}{_EDGE_R}"), F.lit(0))))


def detect_language(text: Column) -> Column:
    """zh, ja, ko or ru by the first character of those scripts, else en."""
    c = F.regexp_extract(text, r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}]", 0)
    return (
        F.when(c.rlike(r"[\x{4e00}-\x{9fff}]"), "zh").when(c.rlike(r"[\x{3040}-\x{30ff}]"), "ja")
        .when(c.rlike(r"[\x{ac00}-\x{d7af}]"), "ko").when(c.rlike(r"[\x{0400}-\x{04ff}]"), "ru").otherwise("en")
    )


def language_display_name(code: Column) -> Column:
    """Name of a language code; unknown codes stand for themselves."""
    out = code
    for k, v in LANGUAGE_NAMES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def apply_vars(template: Column, variables: dict[str, Column | str]) -> Column:
    """``{name}`` replaced in the order of ``variables``; other braces stay."""
    for k, v in variables.items():
        template = F.replace(template, F.lit("{" + k + "}"), v if isinstance(v, Column) else F.lit(v))
    return template


TOKEN = r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}][\p{L}\p{N}_']*"


def tokens(text: Column) -> Column:
    """Tokens: a CJK ideograph, or a run that starts with a letter or digit."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens."""
    return F.size(tokens(text))


def find_anchor(text: Column, anchors: Column) -> Column:
    """0-based position of the first anchor, in list order, that the text holds; anchors under two characters don't count; null if none."""
    low = F.lower(text)
    hits = F.filter(F.transform(F.filter(F.transform(anchors, strip), lambda a: F.length(a) >= 2), lambda a: F.position(F.lower(a), low) - 1), lambda p: p >= 0)
    return F.get(hits, F.lit(0))


def truncate_reference(text: Column, anchors: Column, n: int) -> Column:
    """At most ``n`` tokens of a text around its first found anchor, which stands about 40 % in; ``…`` on each cut side.

    ``n`` of 0 or less, and texts within ``n`` tokens, leave the text as it is.
    """
    if n <= 0:
        return text
    # Lengths of tokens and of what stands before each give every token's span.
    spans = F.aggregate(
        F.zip_with(F.split(text, TOKEN), tokens(text), lambda g, t: F.struct(F.length(g).alias("gap"), F.length(t).alias("len"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("s")),
        lambda acc, p: F.when(p["len"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + p["gap"] + p["len"]).alias("at"),
                F.array_append(acc["s"], F.struct((acc["at"] + p["gap"]).alias("a"), (acc["at"] + p["gap"] + p["len"]).alias("b"))).alias("s"),
            )
        ),
        lambda acc: acc["s"],
    )

    def place(v: Column) -> Column:
        count = F.size(v["s"])
        inside = F.greatest(F.size(F.filter(v["s"], lambda x: x["a"] <= v["pos"])) - 1, F.lit(0))
        first = F.when(v["pos"].isNull(), 0).otherwise(inside - int(n * 0.4))
        first = F.least(F.greatest(first, F.lit(0)), count - n)
        return F.when(count > n, F.struct(F.element_at(v["s"], first + 1)["a"].alias("a"), F.element_at(v["s"], first + n)["b"].alias("b")))

    span = let(F.struct(spans.alias("s"), find_anchor(text, anchors).alias("pos")), place)

    def piece(v: Column) -> Column:
        cut = F.concat(F.when(v["a"] > 0, "…").otherwise(""), F.substring(text, v["a"] + 1, v["b"] - v["a"]), F.when(v["b"] < F.length(text), "…").otherwise(""))
        return F.when(v.isNull(), text).otherwise(cut)

    return let(span, piece)


def likely_untranslated(source: Column, translation: Column, cjk_target: bool = True) -> Column:
    """Whether a translation is its source, holds it or is held by it, or has far more Latin letters than ideographs.

    The last test assumes a target written in ideographs; ``cjk_target=False`` leaves it out.
    """
    s, t = F.lower(strip(source)), F.lower(strip(translation))
    same = s == t
    part = (F.length(s) > 10) & (F.length(t) > 10) & (t.contains(s) | s.contains(t))
    out = same | part
    if cjk_target:
        bare = strip_placeholders(strip_tags(translation))
        cjk, alpha = F.regexp_count(bare, F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count(bare, F.lit("[a-zA-Z]"))
        out = out | (F.length(bare) > 5) & (cjk + alpha > 5) & (alpha > cjk * 2)
    return F.coalesce((source != "") & (translation != "") & out, F.lit(False))


def untranslated_fragments(source: Column, translation: Column) -> Column:
    """English words of three letters or more that both hold, kept words aside, sorted."""
    kept = F.array(*[F.lit(w) for w in KEPT_WORDS])
    both = F.array_except(F.array_intersect(english_words(source), english_words(translation)), kept)
    return F.array_sort(F.filter(both, lambda w: F.length(w) > 2))


def suspicious_fragments(source: Column, translation: Column) -> Column:
    """Untranslated fragments that touch an ideograph in the translation."""
    low = F.lower(translation)
    c = r"[\x{4e00}-\x{9fff}]"
    touching = [F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in (rf"(?<={c})[a-z]+", rf"(?<![a-z])[a-z]+(?={c})")]
    return F.array_intersect(untranslated_fragments(source, translation), F.concat(*touching))


def display_string(term: Column, translation: Column) -> Column:
    """``term -> translation``."""
    return F.concat(term, F.lit(" -> "), F.coalesce(translation, F.lit("")))


def term_of_display(x: Column) -> Column:
    """What stands before the first `` -> ``."""
    return F.substring_index(x, " -> ", 1)


def progress(done: Column, total: Column) -> Column:
    """Whole percent, cut; 0 of nothing."""
    return F.when(total > 0, F.floor(done / total * 100)).otherwise(0).cast("int")


def log_line(level: Column, message: Column, module: Column, func: Column, at: Column) -> Column:
    """One formatted log line."""
    return F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), F.upper(level), F.lit("] ["), F.concat_ws(":", module, func), F.lit("] "), message)


LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}


def should_emit(level: Column, configured: str) -> Column:
    """Whether a level is at or over the configured one; unknown levels count as INFO."""
    def rank(x: Column) -> Column:
        out = F.lit(LEVELS["INFO"])
        for k, v in LEVELS.items():
            out = F.when(F.upper(x) == k, v).otherwise(out)
        return out

    return rank(level) >= LEVELS.get(configured.upper(), LEVELS["INFO"])
