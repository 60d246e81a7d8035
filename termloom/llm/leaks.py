"""Problem 8: passages of held-out items inside a corpus.

The corpus becomes a positional inverted index in shards of documents: for
every term of the held-out items that a shard holds, its postings, that is
documents and positions in order. Words are terms; for items in scripts
without blanks, terms are overlapping runs of three letters or digits, so no
script has to be told from another. Shards are rows of a written table, and
all later work stays inside a shard: nothing of the corpus is shuffled.

Document frequencies of the terms come from the index. Every stretch of
``run`` terms of an item has one anchor, the rarest term in it. Only the
anchors' lists are looked up; they give offsets between document and item,
and the lists of the terms around an anchor, shifted by their distance, are
intersected on those offsets, outwards, as long as any is left. A passage is
an exact phrase if the intersection is unbroken for ``run`` terms, a
proximity match if the same terms stand in order with a few others between
them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import cut

_WORD = re.compile(r"[^\W_]+")

#: Characters of held-out items that go to every executor at once; more items are looked up in as many passes as they need.
ITEM_CHARS = 20_000_000
#: Letters or digits of a term where words aren't told apart.
SIGN_GRAM = 3
#: Postings after which a shard is closed.
SHARD_POSTINGS = 1_000_000


@dataclass
class Items:
    """Held-out items as lists of term ids; ids of words are even, those of signs odd."""

    word_ids: dict[str, int] = field(default_factory=dict)
    sign_ids: dict[str, int] = field(default_factory=dict)
    terms: dict[int, list[int]] = field(default_factory=dict)
    #: consecutive terms that make a passage
    runs: dict[int, int] = field(default_factory=dict)
    #: words or signs of a passage beyond its number of terms
    more: dict[int, int] = field(default_factory=dict)
    #: term id -> (item, position) of its anchors
    anchors: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    gram: int = SIGN_GRAM


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, case ignored."""
    return _WORD.findall(text.lower())


def load_items(rows: list[tuple[int, str, str]], run: int, sign_run: int, sign_langs: tuple[str, ...]) -> Items:
    """Items with enough terms."""
    out = Items(gram=min(SIGN_GRAM, sign_run))
    for item, text, lang in rows:
        if not text:
            continue
        by_sign = lang in sign_langs
        terms = words(text)
        if by_sign:
            s = "".join(terms)
            terms = [s[i : i + out.gram] for i in range(len(s) - out.gram + 1)]
        least = sign_run - out.gram + 1 if by_sign else run
        if len(terms) < least:
            continue
        ids = out.sign_ids if by_sign else out.word_ids
        for t in terms:
            if t not in ids:
                ids[t] = 2 * len(ids) + by_sign
        out.terms[item] = [ids[t] for t in terms]
        out.runs[item], out.more[item] = least, out.gram - 1 if by_sign else 0
    return out


def choose_anchors(items: Items, df: dict[int, int]) -> None:
    """The rarest term of every stretch; terms that no document holds rule their stretch out."""
    items.anchors = {}
    for item, terms in items.terms.items():
        n = items.runs[item]
        freq = [df.get(t, 0) for t in terms]
        chosen: set[int] = set()
        for i in range(len(terms) - n + 1):
            best = min(range(i, i + n), key=lambda j: (freq[j], j))
            if freq[best]:
                chosen.add(best)
        for j in chosen:
            items.anchors.setdefault(terms[j], []).append((item, j))


# A shard: its documents' keys, the terms in order, where each term's postings end, its documents, and the postings.
_SHARD = "keys array<bigint>, terms array<int>, ends array<int>, dfs array<int>, docs array<int>, positions array<int>"
_SHARD_ARROW = pa.schema([("keys", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))])


def _sign_hits(text: str, gram: int, ids: dict[str, int], filt: np.ndarray) -> list[tuple[int, int]]:
    """(term, position) of the sign terms of a text; a bitmap of hashes rules most positions out before the dictionary is asked."""
    if len(text) < gram:
        return []
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = _hash(np.stack([a[i : len(a) - gram + 1 + i] for i in range(gram)]))
    out = []
    for i in np.flatnonzero(filt[h]).tolist():
        t = ids.get(text[i : i + gram])
        if t is not None:
            out.append((t, i))
    return out


def _hash(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(grams.shape[1], np.uint64)
    for g in grams:
        h = (h + g) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - 22)).astype(np.int64)


def _filter(items: Items) -> np.ndarray:
    out = np.zeros(1 << 22, bool)
    if items.sign_ids:
        codes = np.array([[ord(c) for c in t] for t in items.sign_ids], np.uint64).T
        out[_hash(codes)] = True
    return out


def _indexer(items_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_b.value
        w, s, filt = items.word_ids, items.sign_ids, _filter(items_b.value)
        least = [min((n for i, n in items.runs.items() if items.terms[i][0] % 2 == odd), default=0) for odd in (0, 1)]
        keys: list[int] = []
        terms: list[int] = []
        docs: list[int] = []
        at: list[int] = []

        def shard() -> pa.RecordBatch:
            t, d, p = np.array(terms, np.int32), np.array(docs, np.int32), np.array(at, np.int32)
            order = np.lexsort((p, d, t))
            t, d, p = t[order], d[order], p[order]
            last = np.flatnonzero(np.append(t[1:] != t[:-1], True))
            fresh = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))
            dfs = np.diff(np.append(0, np.cumsum(fresh)[last]))
            row = [np.array(keys, np.int64), t[last], (last + 1).astype(np.int32), dfs.astype(np.int32), d, p]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in row], schema=_SHARD_ARROW)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                tokens = words(text)
                hit = [(w[t], i) for i, t in enumerate(tokens) if t in w] if w else []
                if len(hit) < least[0]:
                    hit = []
                if s:
                    more = _sign_hits("".join(tokens), items.gram, s, filt)
                    if len(more) >= least[1]:
                        hit += more
                if hit:
                    terms += [x for x, _ in hit]
                    at += [i for _, i in hit]
                    docs += [len(keys)] * len(hit)
                    keys.append(doc)
                if len(terms) >= SHARD_POSTINGS:
                    yield shard()
                    keys, terms, docs, at = [], [], [], []
        if terms:
            yield shard()

    return run


_HITS = "doc bigint, item bigint, kind string, doc_term int, item_term int, n_terms int"
_HITS_ARROW = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("kind", pa.string()), ("doc_term", pa.int32()), ("item_term", pa.int32()), ("n_terms", pa.int32())])
_SHIFT = 32


class _Shard:
    """Postings lists of one shard by term, as sorted numbers: document, then position."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, positions: np.ndarray) -> None:
        self.at = {t: i for i, t in enumerate(terms.tolist())}
        self.starts = np.append(0, ends)
        self.docs, self.positions, self.terms, self.ends = docs, positions, terms, ends
        self.codes = (docs.astype(np.int64) << _SHIFT) + positions

    def list(self, term: int) -> np.ndarray:
        i = self.at.get(term)
        return self.codes[:0] if i is None else self.codes[self.starts[i] : self.starts[i + 1]]

    def holds(self, term: int, codes: np.ndarray) -> np.ndarray:
        """Which of ``codes`` stand in the term's list."""
        own = self.list(term)
        if not len(own):
            return np.zeros(len(codes), bool)
        return own[np.minimum(np.searchsorted(own, codes), len(own) - 1)] == codes

    def around(self, doc: int, odd: int) -> dict[int, int]:
        """Position -> term of one document."""
        if not hasattr(self, "by_doc"):
            self.by_doc = np.argsort(self.docs, kind="stable")
            self.sorted_docs = self.docs[self.by_doc]
            self.term_of = np.repeat(self.terms, np.diff(self.starts))
        a, b = np.searchsorted(self.sorted_docs, [doc, doc + 1])
        mine = self.by_doc[a:b]
        mine = mine[self.term_of[mine] % 2 == odd]
        return dict(zip(self.positions[mine].tolist(), self.term_of[mine].tolist()))


def _phrases(shard: _Shard, terms: list[int], j: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor codes, first item position, one past the last) of every occurrence of the anchor ``j``, as far as the lists around it go on."""
    start = shard.list(terms[j])
    ends = []
    for step in (-1, 1):
        reach, live, k = np.zeros(len(start), np.int64), np.arange(len(start)), j + step
        while len(live) and 0 <= k < len(terms):
            live = live[shard.holds(terms[k], start[live] + (k - j))]
            reach[live] += 1
            k += step
        ends.append(reach)
    return start, j - ends[0], j + ends[1] + 1


def _near(terms: list[int], j: int, n: int, at: dict[int, int], p: int, slack: int) -> tuple[int, int, int, int, int]:
    """(terms in order, document span, item span) of the stretch around item position ``j`` that stands around document position ``p``."""
    got, spans = 1, {1: (p, j), -1: (p, j)}
    for step in (1, -1):
        here, left, k = p, slack, j + step
        while 0 <= k < len(terms) and abs(k - j) < n:
            d = 1
            while d <= left + 1 and at.get(here + step * d) != terms[k]:
                d += 1
            if d <= left + 1:
                here, left, got = here + step * d, left - (d - 1), got + 1
                spans[step] = (here, k)
            else:
                left -= 1
                if left < 0:
                    break
            k += step
    return got, spans[-1][0], spans[1][0], spans[-1][1], spans[1][1]


def _matches(shard: _Shard, items: Items, slack: int) -> Iterator[tuple]:
    """(document of the shard, item, kind, first position in both, number of terms), each passage once."""
    exact: dict[tuple[int, int], set] = {}
    rest: dict[tuple[int, int], list] = {}
    for t in items.anchors.keys() & shard.at.keys():
        for item, j in items.anchors[t]:
            n = items.runs[item]
            codes, lo, hi = _phrases(shard, items.terms[item], j, n)
            full = hi - lo >= n
            docs, pos = codes >> _SHIFT, codes & ((1 << _SHIFT) - 1)
            for i in np.flatnonzero(full).tolist():
                exact.setdefault((int(docs[i]), item), set()).add((int(pos[i]) - j + int(lo[i]), int(lo[i]), int(hi[i] - lo[i])))
            if slack:
                for i in np.flatnonzero(~full).tolist():
                    rest.setdefault((int(docs[i]), item), []).append((j, int(pos[i])))
    for (doc, item), found in exact.items():
        for p, j, n in found:
            yield doc, item, "phrase", p, j, n + items.more[item]
    at: dict[int, int] = {}
    last = None
    for (doc, item), anchors in sorted(rest.items()):
        odd = items.terms[item][0] % 2
        if last != (doc, odd):
            at, last = shard.around(doc, odd), (doc, odd)
        near = []
        for j, p in anchors:
            n, a, b, i, k = _near(items.terms[item], j, items.runs[item], at, p, slack)
            if n >= items.runs[item]:
                near.append((-n, a, b, i, k))
        # Of matches that overlap in document and item, the longest; none over an exact phrase.
        kept = [(p, p + n - 1, j, j + n - 1) for p, j, n in exact.get((doc, item), ())]
        for n, a, b, i, k in sorted(set(near)):
            if not any(a <= y and x <= b and i <= v and u <= k for x, y, u, v in kept):
                kept.append((a, b, i, k))
                yield doc, item, "proximity", a, i, -n + items.more[item]


def _matcher(items_b, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_b.value
        for b in batches:
            for r in range(b.num_rows):
                keys, terms, ends, _, docs, positions = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(6))
                out = [(int(keys[d]), *x) for d, *x in _matches(_Shard(terms, ends, docs, positions), items, slack)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _HITS_ARROW)], schema=_HITS_ARROW)

    return run


def leaked(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, item_lang: str, run: int = 12, sign_run: int = 20, sign_langs: tuple[str, ...] = ("zh", "ja"), slack: int = 3, item_chars: int = ITEM_CHARS) -> DataFrame:
    """Every passage of ``items`` in ``docs``: (doc, item, kind, doc_term, item_term, n_terms).

    ``kind`` is ``phrase`` (``run`` consecutive words, or ``sign_run``
    letters and digits for items in ``sign_langs``) or ``proximity`` (as many
    terms in order with up to ``slack`` others on either side; none if
    ``slack`` is 0; of overlapping ones the longest). ``doc_term`` and
    ``item_term`` count words, or letters and digits, from 0.

    Null and empty texts match nothing, an item shorter than a run neither;
    repeated documents give their own rows; an empty table gives none. Items
    go to every executor, up to ``item_chars`` characters of them at once;
    the documents stay where they are.
    """
    its = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t"), F.col(item_lang).alias("l")).filter("i is not null and t <> ''")
    passes = int((its.agg(F.sum(F.length("t").cast("bigint"))).first()[0] or 0) // item_chars) + 1
    found = []
    for n in range(passes):
        part = its if passes == 1 else its.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == n)
        found.append(_leaked(docs, load_items([tuple(r) for r in part.collect()], run, sign_run, sign_langs), key, text, slack))
    return reduce(DataFrame.unionByName, found)


def _leaked(docs: DataFrame, its: Items, key: str, text: str, slack: int) -> DataFrame:
    spark = docs.sparkSession
    first = spark.sparkContext.broadcast(its)
    index = cut(docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("text is not null and text <> ''").mapInArrow(_indexer(first), _SHARD), "leaks-index")
    # As many rows as the items have distinct terms.
    df = {r.t: r.n for r in index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.dfs").alias("n")).collect()}
    choose_anchors(its, df)
    return index.mapInArrow(_matcher(spark.sparkContext.broadcast(its), slack), _HITS)
