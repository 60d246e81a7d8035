"""Quality checks of translations as columns over (source, translation, attempt)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import text as T

MAX_RETRIES = 2


def retry_decision(source: Column, translation: Column, attempt: Column, max_retries: int = MAX_RETRIES) -> Column:
    """accept, retry_generic, retry_fragments or exhausted after ``attempt`` (from 0)."""
    flagged = T.likely_untranslated(source, translation)
    parts = F.size(T.untranslated_fragments(source, translation)) > 0
    bad = F.when(flagged, "retry_generic").when(parts, "retry_fragments")
    return F.when(bad.isNull(), "accept").when(attempt >= max_retries, "exhausted").otherwise(bad)


def named_fragments(source: Column, translation: Column, n: int = 5) -> Column:
    """The fragments that a retry names, at most ``n``, joined by commas."""
    return F.array_join(F.slice(T.untranslated_fragments(source, translation), 1, n), ", ")
