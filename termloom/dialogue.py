"""Translation of texts by a chat model: messages, replies, checks and repeated calls.

``translate`` runs the whole exchange for one text; ``translate_rows`` does so
for a table, each distinct exchange where its row stands. All of it works
with any ``Translator`` (see providers), a stub included.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from termloom.functions.text import KEPT_WORDS, LANGUAGE_NAMES
from termloom.providers import Translator
from termloom.sources.config import pick_style

Messages = list[dict[str, str]]


@dataclass
class Settings:
    """What an exchange says; texts hold ``{name}`` for what is filled in."""

    styles: dict[str, str] = field(default_factory=dict)
    style: str | None = "default"
    source_language: str = "auto"
    target_language: str = "zh"
    system: str = 'Translate into {target_language}. Keep markup, placeholders and blanks. Answer as JSON: {"translation": "..."}'
    user: str = "{text}"
    glossary_note: str = "\n\nUse these terms wherever they occur."
    ask_again: str = "This is not a translation into {target_language}. Translate the whole text."
    ask_words: str = "These words are not translated: {fragments}. Translate the whole text into {target_language}."
    reformat_system: str = "You turn answers into JSON."
    reformat: str = 'Text: {text}\nAnswer: {reply}\nGive the translation in the answer as JSON: {"translation": "..."}'
    retries: int = 2
    named: int = 5


def _fill(template: str, **values: str) -> str:
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template


def _languages(s: Settings) -> dict[str, str]:
    return {"source_language_code": s.source_language, "target_language_code": s.target_language, "source_language": LANGUAGE_NAMES.get(s.source_language, s.source_language), "target_language": LANGUAGE_NAMES.get(s.target_language, s.target_language)}


def messages(text: str, block: str | None, s: Settings) -> Messages:
    """The configured style's prompt (else the first style's, else the default), the glossary block, and the text."""
    style = pick_style(s.style, list(s.styles))
    system = _fill(s.styles[style] if style else s.system, **_languages(s))
    if block:
        system += "\n\n" + block + _fill(s.glossary_note, **_languages(s))
    return [{"role": "system", "content": system}, {"role": "user", "content": _fill(s.user, **_languages(s), text=text)}]


_FENCE = re.compile(r"```(?:json)?")
_OBJECT = re.compile(r"\{.*\}", re.S)
#: Signs that a reformatted answer repeats its instruction.
_LEAKS = ("reformat", '{"translation"', "as JSON", "Give the", "Answer:")


def _field(text: str, default: str) -> str | None:
    """``translation`` of a JSON object; ``default`` where it is missing, null where there is no object."""
    try:
        data = json.loads(text)
    except ValueError:
        return None
    return str(data.get("translation", default)) if isinstance(data, dict) else None


def read_reply(reply: str, source: str, asked: Messages, model: Translator, s: Settings) -> str:
    """The translation in a reply: its JSON, else the object inside it, else what one more call makes of it, else all of it.

    A call that repeats its own instruction, or fails, counts for nothing.
    JSON that is no object is an error, which the exchange repeats.
    """
    bare = _FENCE.sub("", reply).strip()
    got = _field(bare, source)
    if got is not None:
        return got
    try:
        json.loads(bare)
    except ValueError:
        pass
    else:
        raise ValueError("a reply that is no JSON object")
    inner = _OBJECT.search(reply)
    got = _field(inner.group(), reply.strip()) if inner else None
    if got is not None:
        return got
    # Only the text itself goes along, never the system prompt.
    text = next((m["content"] for m in asked if m["role"] == "user"), "")
    try:
        again = model.complete([{"role": "system", "content": s.reformat_system}, {"role": "user", "content": _fill(s.reformat, text=text, reply=reply)}])
        got = _field(_FENCE.sub("", again).strip(), "")
    except Exception:
        got = None
    return got if got and not any(x in got for x in _LEAKS) else reply.strip()


_TAG, _HOLDER = re.compile(r"<[^>]+>"), re.compile(r"%\w+|\{\d+\}|\[[^\]]*\]")
_ENGLISH = re.compile(r"\b[a-z]{2,}\b")
_IDEOGRAPH = re.compile(r"[一-鿿]")


def _words(text: str) -> set[str]:
    return set(_ENGLISH.findall(_HOLDER.sub("", _TAG.sub("", text)).lower()))


def fragments(source: str, translation: str) -> list[str]:
    """English words of three letters or more that both hold, kept words aside."""
    return sorted(w for w in _words(source) & _words(translation) - set(KEPT_WORDS) if len(w) > 2)


def untranslated(source: str, translation: str) -> bool:
    """Whether a translation is its source, holds it or is held by it, or is mostly Latin letters (for targets in ideographs)."""
    if not source or not translation:
        return False
    a, b = source.strip().lower(), translation.strip().lower()
    if a == b or len(a) > 10 and len(b) > 10 and (a in b or b in a):
        return True
    bare = _HOLDER.sub("", _TAG.sub("", translation))
    cjk, latin = len(_IDEOGRAPH.findall(bare)), len(re.findall("[a-zA-Z]", bare))
    return len(bare) > 5 and cjk + latin > 5 and latin > cjk * 2


@dataclass
class Outcome:
    """A translation, how the exchange ended, and its number of calls (of reformatting aside)."""

    translation: str
    status: str
    calls: int


def translate(source: str | None, asked: Messages, model: Translator, s: Settings) -> Outcome:
    """The exchange for one text.

    ``status`` is ``blank`` (nothing to translate, no call), ``accepted``,
    ``exhausted`` (the last call's result stands although it fails a check)
    or ``failed`` (the last call raised: the source stands).
    """
    if not source or not source.strip():
        return Outcome("", "blank", 0)
    more: list[dict[str, str]] = []
    got = source
    for n in range(s.retries + 1):
        last = n == s.retries
        try:
            got = read_reply(model.complete(asked + more), source, asked, model, s)
        except Exception:
            # What the last answer lacked is asked for again.
            if last:
                return Outcome(source, "failed", n + 1)
            more = more or [{"role": "user", "content": _fill(s.ask_again, **_languages(s))}]
            continue
        words: list[str] = []
        if not untranslated(source, got):
            words = fragments(source, got)
            if not words:
                return Outcome(got, "accepted", n + 1)
        ask = _fill(s.ask_words, **_languages(s), fragments=", ".join(words[: s.named])) if words else _fill(s.ask_again, **_languages(s))
        more = [{"role": "user", "content": ask}]
    return Outcome(got, "exhausted", s.retries + 1)


def translate_rows(df: DataFrame, source: str, block: str | None, model: Translator, settings: Settings | None = None, parallel: int | None = None) -> DataFrame:
    """``df`` with ``translation``, ``status`` and ``calls``; ``parallel`` exchanges run at a time. Null and blank sources give an empty translation."""
    s = settings or Settings()
    if parallel:
        df = df.repartition(parallel)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", translation string, status string, calls int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blocks = b[block] if block else [None] * len(b)
            out = [translate(t, messages(t or "", g, s), model, s) for t, g in zip(b[source], blocks)]
            yield b.assign(translation=[o.translation for o in out], status=[o.status for o in out], calls=[o.calls for o in out])

    return df.mapInPandas(run, schema)
