"""A character bigram model in fixed-size hashed tables, counted over all texts.

The tables have a fixed number of slots, so what is collected and broadcast
never grows with the corpus.
"""

from __future__ import annotations

import numpy as np

#: Slots of the bigram table and of the unigram table: the documented size bound.
BIGRAM_SLOTS = 1 << 21
UNIGRAM_SLOTS = 1 << 16
_SEP = 10  # the line break stands for the edge of a text


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with an edge on both sides, and where each text starts."""
    joined = "\n".join(["", *texts, ""])
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return a, starts


def fold(a: np.ndarray) -> np.ndarray:
    """Digits count as one character, and so do all beyond the basic plane."""
    return np.where((a >= 48) & (a <= 57), np.uint32(48), np.minimum(a, np.uint32(0xFFFE)))


def bigram_slots(a: np.ndarray) -> np.ndarray:
    """Slot of each pair of neighbouring characters."""
    b = a.astype(np.uint64)
    h = (b[:-1] * np.uint64(0x9E3779B1) + b[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(64 - 21)).astype(np.int64)


def unigram_slots(a: np.ndarray) -> np.ndarray:
    """Slot of each character."""
    return np.minimum(a, np.uint32(0xFFFE)).astype(np.int64)


def _class_of(cp: int) -> int:
    """Coarse class of a character: script and case, or kind of sign."""
    c = chr(cp)
    if c == "\n":
        return 0
    if c == " ":
        return 1
    if c in "0123456789":
        return 2
    if cp < 128:
        return 3 if c.islower() else 4 if c.isupper() else 7
    if 0x80 <= cp < 0xA0:
        return 21
    if 0x10D0 <= cp < 0x3000 and not (0x2010 <= cp <= 0x203A):
        return 20 if cp >= 0x2190 else 24
    if 0x2010 <= cp <= 0x203A or c in "«»¿¡·":
        return 8
    if cp < 0x250:
        return 5 if c.islower() else 6 if c.isupper() else 19
    if 0x370 <= cp < 0x400:
        return 18
    if 0x400 <= cp < 0x530:
        basic = 0x410 <= cp <= 0x44F or cp in (0x401, 0x451)
        return (9 if c.islower() else 10) if basic else 11
    if 0x3400 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00:
        return 12
    if 0x3040 <= cp < 0x30A0:
        return 13
    if 0x30A0 <= cp < 0x3100:
        return 14
    if 0xAC00 <= cp < 0xD7B0:
        return 15
    if 0x3000 <= cp < 0x3040 or 0xFF00 <= cp < 0xFF61 or 0xFFE0 <= cp < 0xFFF0:
        return 16
    if 0xFF61 <= cp < 0xFFE0:
        return 17
    if 0xE000 <= cp < 0xF900:
        return 22
    return 23 if cp == 0xFFFD else 24


CLASSES = 25
_CLASS: list[np.ndarray] = []


def classes(u: np.ndarray) -> np.ndarray:
    """Class of each unigram slot."""
    if not _CLASS:
        _CLASS.append(np.fromiter(map(_class_of, range(UNIGRAM_SLOTS)), np.int64, UNIGRAM_SLOTS))
    return _CLASS[0][u]


class Counter:
    """Bigram, unigram and class-pair counts of one task."""

    def __init__(self) -> None:
        self.bi = np.zeros(BIGRAM_SLOTS, np.int64)
        self.waiting: list[np.ndarray] = []
        self.uni = np.zeros(UNIGRAM_SLOTS, np.int64)
        self.pair = np.zeros(CLASSES * CLASSES, np.int64)

    def add(self, folded: np.ndarray, keep: np.ndarray | None = None) -> None:
        """Count the pairs of a batch; ``keep`` leaves pairs out."""
        if len(folded) < 2:
            return
        slots, u = bigram_slots(folded), unigram_slots(folded)
        k = classes(u)
        pairs = k[:-1] * CLASSES + k[1:]
        if keep is not None:
            slots, u, pairs = slots[keep], u[1:][keep], pairs[keep]
        # A count goes through all slots: batches wait until they hold as many pairs.
        self.waiting.append(slots.astype(np.int32))
        if sum(map(len, self.waiting)) >= BIGRAM_SLOTS:
            self._drain()
        self.uni += np.bincount(u, minlength=UNIGRAM_SLOTS)
        self.pair += np.bincount(pairs, minlength=CLASSES * CLASSES)

    def _drain(self) -> None:
        if self.waiting:
            self.bi += np.bincount(np.concatenate(self.waiting), minlength=BIGRAM_SLOTS)
            self.waiting = []

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Slot numbers (bigrams, unigrams, class pairs) and counts, empty slots left out."""
        self._drain()
        every = np.concatenate([self.bi, self.uni, self.pair])
        at = np.flatnonzero(every)
        return at, every[at]


class Model:
    """Log-probabilities: bigrams, backing off to class pairs times characters within a class."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray, kappa: float = 5.0) -> None:
        every = np.zeros(BIGRAM_SLOTS + UNIGRAM_SLOTS + CLASSES * CLASSES, np.float64)
        every[slots] = counts
        self.bi = every[:BIGRAM_SLOTS].astype(np.float32)
        uni, pair = every[BIGRAM_SLOTS : BIGRAM_SLOTS + UNIGRAM_SLOTS], every[BIGRAM_SLOTS + UNIGRAM_SLOTS :].reshape(CLASSES, CLASSES)
        self.total = float(uni.sum())
        k = classes(np.arange(UNIGRAM_SLOTS))
        in_class = np.bincount(k, weights=uni + 0.5, minlength=CLASSES)
        self.within = ((uni + 0.5) / in_class[k]).astype(np.float32)
        self.trans = ((pair + 0.02) / (pair.sum(1, keepdims=True) + 0.02 * CLASSES)).astype(np.float32).ravel()
        self.uni, self.k, self.kappa = uni.astype(np.float32), k, np.float32(kappa)

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text, both edges counted."""
        if not texts:
            return np.zeros(0)
        a, starts = codes(texts)
        a = fold(a)
        u = unigram_slots(a)
        k = self.k[u]
        q = self.trans[k[:-1] * CLASSES + k[1:]] * self.within[u[1:]]
        lp = np.log((self.bi[bigram_slots(a)] + self.kappa * q) / (self.uni[u[:-1]] + self.kappa))
        return np.add.reduceat(lp.astype(np.float64), starts)
