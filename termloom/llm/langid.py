"""Language posteriors from a character n-gram naive Bayes model in hashed tables of a fixed size."""

from __future__ import annotations

import numpy as np

from termloom.llm import charlm

#: Slots per language for bigrams and trigrams together.
SLOTS = 1 << 17
#: Labelled texts that the model is fitted on at most, per language and role.
SAMPLE_PER_LANGUAGE = 3000


def _slots(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = a.astype(np.uint64)
    two = ((b[:-1] * np.uint64(0x9E3779B1) + b[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 17)
    three = ((b[:-2] * np.uint64(0x85EBCA77) + b[1:-1] * np.uint64(0x9E3779B1) + b[2:]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 17)
    return two.astype(np.int64), three.astype(np.int64)


def _ready(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded codes of the texts, where each starts, and its length."""
    texts = [f" {t.lower()} " for t in texts]
    a, starts = charlm.codes(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return charlm.fold(a), starts, lens


class NaiveBayes:
    """Log-likelihoods of texts under every language."""

    def __init__(self, texts: list[str], labels: list[str], rounds: int = 2) -> None:
        self.langs = sorted(set(labels))
        y = np.array([self.langs.index(x) for x in labels])
        keep = np.ones(len(texts), bool)
        for i in range(rounds):
            self._fit([t for t, k in zip(texts, keep) if k], y[keep])
            if i + 1 < rounds:
                # Labels that the first fit contradicts are left out of the next.
                keep = np.argmax(self.score(texts), 1) == y

    def _fit(self, texts: list[str], y: np.ndarray) -> None:
        n = len(self.langs)
        table = np.full((SLOTS, n), 0.1, np.float64)
        for i in range(n):
            mine = [t for t, j in zip(texts, y) if j == i]
            if mine:
                two, three = _slots(_ready(mine)[0])
                table[:, i] += np.bincount(two, minlength=SLOTS) + np.bincount(three, minlength=SLOTS)
        self.table = np.log(table / table.sum(0)).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """A row per text, a column per language."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        a, starts, lens = _ready(texts)
        two, three = _slots(a)
        # Pairs and triples that reach over the edge of a text are cut off.
        s = self.table[two]
        s[:-1] += self.table[three]
        ends = starts + lens
        s[ends[:-1]] = 0
        out = np.add.reduceat(s, starts, axis=0)
        return out.astype(np.float64)
