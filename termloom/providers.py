"""Interfaces to remote models, offline stand-ins, and how their calls are distributed."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TransientError(Exception):
    """An error of a provider that may pass: rate limits, connections, server errors."""


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """A vector for each text; null where it failed."""


class Translator(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> str:
        """The reply to chat messages."""


class HashEmbedder:
    """Vectors from character trigrams by hashing: deterministic, offline; like texts get like vectors."""

    def __init__(self, width: int = 96) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(self.width)
            s = f"  {t.lower()} "
            for i in range(len(s) - 2):
                h = int.from_bytes(hashlib.blake2b(s[i : i + 3].encode(), digest_size=8).digest(), "little")
                v[h % self.width] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class EchoTranslator:
    """Replies with the last message as a JSON translation."""

    def complete(self, messages: list[dict[str, str]]) -> str:
        import json

        return json.dumps({"translation": messages[-1]["content"]}, ensure_ascii=False)


class RepeatTranslator:
    """Replies with the text itself, however often it is asked."""

    def complete(self, messages: list[dict[str, str]]) -> str:
        import json

        return json.dumps({"translation": next(m["content"] for m in messages if m["role"] == "user")}, ensure_ascii=False)


def backoff(attempt: int, base: float = 0.5, jitter: float = 0.1, rnd: Callable[[], float] = random.random) -> float:
    """Seconds before the retry after ``attempt`` (from 1): doubling, plus up to a tenth."""
    delay = base * 2 ** (attempt - 1)
    return delay + rnd() * jitter * delay


def with_retry(call: Callable[[], Any], max_retries: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result; transient errors are retried, the last one is raised."""
    attempt = 0
    while True:
        try:
            return call()
        except TransientError:
            attempt += 1
            if attempt > max_retries:
                raise
            sleep(backoff(attempt, base))


def merge_params(stored: dict[str, Any] | None, **overrides: Any) -> dict[str, Any]:
    """Stored parameters, then overrides, nulls left out."""
    return {k: v for k, v in (stored or {}).items() if v is not None} | {k: v for k, v in overrides.items() if v is not None}


def embed_column(df: DataFrame, text: str, embedder: Embedder, batch: int = 50, parallel: int | None = None) -> DataFrame:
    """``df`` with ``embedding``; each distinct text is asked for once, ``parallel`` requests run at a time."""
    uniq = df.select(F.col(text).alias("_t")).filter("_t is not null").distinct()
    if parallel:
        uniq = uniq.repartition(parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                yield pd.DataFrame({"_t": part["_t"].to_numpy(), "embedding": embedder.embed(part["_t"].tolist())})

    vecs = uniq.mapInPandas(run, "_t string, embedding array<float>")
    return df.join(vecs, df[text] == vecs["_t"], "left").drop("_t")


def translate_column(df: DataFrame, messages: str, translator: Translator, parallel: int | None = None, max_retries: int = 3) -> DataFrame:
    """``df`` with ``response`` and ``error``; a failed call keeps its row."""
    if parallel:
        df = df.repartition(parallel)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", response string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got, err = [], []
            for m in b[messages]:
                try:
                    got.append(with_retry(lambda m=m: translator.complete([dict(x) if isinstance(x, dict) else x.asDict() for x in m]), max_retries))
                    err.append(None)
                except Exception as e:
                    got.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            yield b.assign(response=got, error=err)

    return df.mapInPandas(run, schema)


class HttpClient:
    """Embeddings and chat of a service with the common JSON interface (``/embeddings``, ``/chat/completions``).

    ``send(url, headers, body)`` gives (status, reply); the default posts by
    urllib. Statuses 408, 409, 429 and from 500, and broken connections, are
    transient and repeated. ``fallback`` serves where this client has no key.
    """

    def __init__(self, base_url: str, key: str, model: str, parameters: dict[str, Any] | None = None, max_retries: int = 3, base: float = 0.5, send: Callable[[str, dict, dict], tuple[int, dict]] | None = None, sleep: Callable[[float], None] = time.sleep, fallback: HttpClient | None = None) -> None:
        self.base_url, self.key, self.model, self.parameters = base_url.rstrip("/"), key, model, parameters
        self.max_retries, self.base, self.send, self.sleep, self.fallback = max_retries, base, send or _post, sleep, fallback

    def _call(self, path: str, body: dict[str, Any], retries: int) -> dict[str, Any]:
        if not self.key:
            raise ValueError("a client without a key")

        def once() -> dict[str, Any]:
            status, reply = self.send(self.base_url + path, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}, body)
            if status in (408, 409, 429) or status >= 500:
                raise TransientError(f"status {status}")
            if status >= 400:
                raise ValueError(f"status {status}: {reply}")
            return reply

        return with_retry(once, retries, self.base, self.sleep)

    def complete(self, messages: list[dict[str, str]], **overrides: Any) -> str:
        """The reply to chat messages; overrides go over the stored parameters."""
        if not self.key and self.fallback:
            return self.fallback.complete(messages, **overrides)
        body = {"model": self.model, "messages": messages} | merge_params(self.parameters, **overrides)
        return self._call("/chat/completions", body, self.max_retries)["choices"][0]["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """A vector for each text, one request each and without repeats; null where it failed."""
        out: list[list[float] | None] = []
        for t in texts:
            try:
                out.append(self._call("/embeddings", {"model": self.model, "input": t}, 0)["data"][0]["embedding"])
            except Exception:
                out.append(None)
        return out


def _post(url: str, headers: dict, body: dict) -> tuple[int, dict]:
    import json
    from urllib import error, request

    try:
        with request.urlopen(request.Request(url, json.dumps(body).encode(), headers), timeout=120) as r:
            return r.status, json.loads(r.read())
    except error.HTTPError as e:
        return e.code, {"error": e.read().decode("utf-8", "replace")}
    except (error.URLError, TimeoutError) as e:
        raise TransientError(str(e)) from e
