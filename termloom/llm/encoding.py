"""Problem 1: text decoded with the wrong character encoding, found and put right.

A record's text is taken as the result of an unknown (latent) *chain*: bytes
of one encoding read as another, perhaps twice, or no chain at all. A chain
can be inverted, so the likelihood of a text under a chain is the likelihood
of the inverted text under a character model of clean text. How often each
source (plugin and field) uses each chain is unknown as well;
expectation-maximization alternates between the posterior of every record's
chain and the rates of each source until they stay, which pools evidence too
weak in a single record. Rates of small sources lean on the rates of all
sources.

One pass over the table counts the character model (on texts without a
structural trace of a chain) and keeps the few texts that some chain can
invert; the model has a fixed number of slots. All later steps touch only
the kept texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import charlm
from termloom.session import cut

LOSSY = "lost bytes"
#: Log-likelihood that a text loses for every place where putting it right would glue two scripts together.
MIXED_COST = 6.0


def _table(name: str) -> dict[str, int]:
    """Character -> byte of a one-byte encoding; unassigned bytes show as C1 controls."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if name == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


_ONE_BYTE = {n: _table(n) for n in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866")}
_MANY_BYTE = ("cp932", "gbk", "cp949")


def _cls(table: dict[str, int], lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"


def _utf8_pattern(t: dict[str, int]) -> re.Pattern:
    tail = _cls(t, 0x80, 0xBF)
    if "а" in t:
        # Cyrillic letters are lead and tail bytes themselves: one pair may be chance, unless its tail is a sign.
        sign = "[" + "".join(re.escape(c) for c, b in t.items() if 0x80 <= b <= 0xBF and not c.isalpha()) + "]"
        two = f"(?:{_cls(t, 0xC2, 0xDF)}{tail}|{_cls(t, 0xE1, 0xEF)}{tail}{{2}})"
        # Beside a Latin letter a pair is no chance either.
        return re.compile(f"{two}(?:[ -~]?{two})+|{_cls(t, 0xC2, 0xDF)}{sign}|(?<=[A-Za-z]){two}|{two}(?=[A-Za-z])" if t["а"] >= 0xC0 else f"(?:{_cls(t, 0xC2, 0xDF)}{tail})+")
    return re.compile(f"(?:{_cls(t, 0xC2, 0xDF)}{tail}|{_cls(t, 0xE0, 0xEF)}{tail}{{2}}|{_cls(t, 0xF0, 0xF4)}{tail}{{3}})+")


_UTF8_IN = {n: _utf8_pattern(t) for n, t in _ONE_BYTE.items()}
_UTF8_BYTES = re.compile(rb"(?:[\xe1-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[ -~]{1,3}(?=[\xc2-\xef]))+")
# Two three-byte signs in a row, or four Cyrillic letters.
_THREE = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}){2}|(?:[\xd0\xd1][\x80-\xbf]){4}")
_SEQ = re.compile(rb"[\xe2-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]")
_RUN_1252 = re.compile("[" + "".join(re.escape(c) for c in _ONE_BYTE["cp1252"]) + "]" + "(?:[ -~\n\t" + "".join(re.escape(c) for c in _ONE_BYTE["cp1252"]) + "]*[" + "".join(re.escape(c) for c in _ONE_BYTE["cp1252"]) + "])?[@-~]?")
_CYR_ODD = re.compile("[а-яё][А-ЯЁ]|[Ѐ-ЏѐЂђ-џ─-◿⌠⌡≈∙√]")
_CYR = re.compile("[Ѐ-ӿ]")
_MIXED = re.compile("[A-Za-zÀ-ÿ][Ѐ-ӿ一-鿿가-힣]|[Ѐ-ӿ一-鿿가-힣][A-Za-zÀ-ÿ]")
#: KOI8 and Windows-1251 swap small and capital letters; code page 866 leaves signs.
_CYR_SWAPPED = re.compile("[а-яё][А-ЯЁ]+|[А-ЯЁ]{2,}")
_CYR_SIGNED = re.compile("[^\\s!-~А-яЁё«»“”„’–—…]")
_CJK = re.compile("[⺀-퟿豈-﫿｡-ﾟ-]")
_RARE = re.compile("[^\u0000-\u024f\u0300-\u036f\u0400-\u045f\u2000-\u203a\u20ac\u2122\u3000-\u30ff\u3400-\u9fff\uac00-\ud7a3\uff01-\uffe5\ufeff\ufffd]")
_LATIN = re.compile("[A-Za-z]")
_LETTER = re.compile("[^\\W\\d_]")


#: Signs and spaces of ordinary typography: on their own no trace of a wrong encoding.
_ORDINARY = "’‘‚“”„‹›«»…–—·¿¡\xa0\xad©®™•§¶°"


def _west(w: str, r: str) -> tuple[dict[int, str], str, str]:
    """A western encoding read as another: the way back, signs that stood for letters, capitals that did."""
    back, signs, capitals = {}, "", ""
    for c, b in _ONE_BYTE[w].items():
        try:
            to = bytes([b]).decode(r)
        except UnicodeDecodeError:
            continue
        back[ord(c)] = to
        if to.isalpha() or to in "’“”–…«»¿¡":
            if "LATIN" not in _name(c) or not c.isalpha():
                signs += "" if c in _ORDINARY else c
            elif c.isupper():
                capitals += c
    return back, signs, capitals


def _name(c: str) -> str:
    import unicodedata

    return unicodedata.name(c, "")


_WEST_ALL = {f"cp1252>{w}": _west(w, "cp1252") for w in ("cp437", "cp850", "mac_roman")} | {"mac_roman>cp1252": _west("cp1252", "mac_roman")}
_WEST = {k: v[0] for k, v in _WEST_ALL.items()}
_WEST_GATES = {k: v[1:] for k, v in _WEST_ALL.items()}
_CYR_PAIRS = [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "koi8_r"), ("koi8_r", "cp866")]
_CYR_BACK = {f"{r}>{w}": {ord(c): bytes([b]).decode(r, "replace") for c, b in _ONE_BYTE[w].items()} for w, r in _CYR_PAIRS}
#: Encodings whose bytes were read as Windows-1252 or Latin-1.
_LEGACY = ("cp932", "gbk", "cp949", "euc_jp", "big5", "cp1251", "koi8_r", "cp866")


#: Characters of each one-byte encoding to those of the same number as their byte.
_AS_BYTE = {w: {ord(c): b for c, b in t.items()} for w, t in _ONE_BYTE.items()}


def _from_utf8(w: str):
    t = _AS_BYTE[w]

    def back(m: re.Match) -> str:
        return m.group().translate(t).encode("latin-1").decode("utf-8", "replace")

    return back


_BACK = {w: _from_utf8(w) for w in _UTF8_IN}


def _bytes_1252(s: str) -> bytes:
    return s.translate(_AS_BYTE["cp1252"]).encode("latin-1")


_WIDTHS: dict[str, np.ndarray] = {}


def _widths(w: str) -> np.ndarray:
    """Bytes of every character in a many-byte encoding; one for those that it lacks."""
    if w not in _WIDTHS:
        _WIDTHS[w] = np.fromiter((len(chr(i).encode(w, "replace")) for i in range(charlm.UNIGRAM_SLOTS)), np.int64, charlm.UNIGRAM_SLOTS)
    return _WIDTHS[w]


def _stretches(text: str, w: str) -> str | None:
    """UTF-8 read as a many-byte encoding: each stretch that reads as UTF-8 again is put back."""
    raw = text.encode(w, "replace")
    ends_a = np.cumsum(_widths(w)[charlm.unigram_slots(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))])
    ends = ends_a
    out, at = [], 0
    latin = len(_LATIN.findall(text)) * 2 > len(_LETTER.findall(text))
    for m in _UTF8_BYTES.finditer(raw):
        if len(_SEQ.findall(m.group())) < (1 if latin else 2):
            continue
        i = int(np.searchsorted(ends_a, m.start(), side="right"))
        j = int(np.searchsorted(ends_a, m.end(), side="left")) + 1
        if i < at or m.end() == m.start():
            continue
        lead = m.start() - (int(ends[i - 1]) if i else 0)
        out += [text[at:i], "�" * (lead > 0), m.group().decode("utf-8", "replace")]
        at = min(j, len(text))
    if not out:
        return None
    return "".join(out) + text[at:]


#: Bits of a text's traces; the one-byte encodings that may hide UTF-8 come first.
_W8 = list(_UTF8_IN)
_B_LEGACY, _B_CYR, _B_CJK, _B_LOST = (1 << (len(_W8) + len(_WEST) + i) for i in range(4))
_GATES: list[np.ndarray] = []


def _gates() -> tuple[np.ndarray, ...]:
    """Per character: bits of encodings in which it is a lead or a tail byte of UTF-8, and other classes."""
    if not _GATES:
        n = charlm.UNIGRAM_SLOTS
        lead, tail, odd, up, one, high = (np.zeros(n, np.uint32) for _ in range(6))
        for i, w in enumerate(_W8):
            for c, b in _ONE_BYTE[w].items():
                if 0xC2 <= b <= 0xF4:
                    lead[ord(c)] |= 1 << i
                if 0x80 <= b <= 0xBF:
                    tail[ord(c)] |= 1 << i
        for i, (signs, capitals) in enumerate(_WEST_GATES.values()):
            for c in signs:
                odd[ord(c)] |= 1 << (len(_W8) + i)
            for c in capitals:
                up[ord(c)] |= 1 << (len(_W8) + i)
        for c in _ONE_BYTE["cp1252"]:
            high[ord(c)] = 1
        for cp in range(n):
            c = chr(cp)
            if _CJK.match(c):
                one[cp] |= _B_CJK
            elif 0x400 <= cp < 0x530 and not ("а" <= c <= "я" or "А" <= c <= "Я" or c in "ёЁ") or 0x2500 <= cp < 0x2580:
                one[cp] |= _B_CYR
        one[0xFFFD] |= _B_LOST
        letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        lower = np.fromiter((chr(i).islower() for i in range(n)), bool, n)
        cyr_low, cyr_up = np.zeros(n, bool), np.zeros(n, bool)
        cyr_low[0x430:0x450] = cyr_low[0x451] = cyr_up[0x410:0x430] = cyr_up[0x401] = True
        _GATES.extend([lead, tail, odd, up, one, high, letter, lower, cyr_low, cyr_up])
    return tuple(_GATES)


def traces(a: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Bits of each text of a batch that say which inversions are worth a try."""
    lead, tail, odd, up, one, high, letter, lower, cyr_low, cyr_up = _gates()
    u = charlm.unigram_slots(a)
    c = u[1:]
    sign, abc, h = odd[u], letter[u], high[u]
    bits = one[c] | (lead[u[:-1]] & tail[c])
    bits |= sign[1:] * abc[:-1] | sign[:-1] * abc[1:] | up[c] * lower[u[:-1]]
    bits |= (cyr_low[u[:-1]] & cyr_up[c]) * np.uint32(_B_CYR)
    n_high = np.add.reduceat(h[1:], starts)
    n_near = np.add.reduceat(h[:-1] & h[1:], starts)
    out = np.bitwise_or.reduceat(bits, starts)
    out |= np.where((n_near > 0) | (n_high * 4 >= np.maximum(lens, 2)) & (n_high > 1), np.uint32(_B_LEGACY), np.uint32(0))
    return out


def _utf8_at(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where matches of _THREE and of _SEQ start in bytes."""
    b = np.concatenate([raw, np.zeros(8, np.uint8)])
    n = len(raw)
    tail = (b & 0xC0) == 0x80
    three = (b[: n + 4] & 0xF0 == 0xE0) & tail[1 : n + 5] & tail[2 : n + 6]
    pair = (b[: n + 7] & 0xFE == 0xD0) & tail[1 : n + 8]
    strong = three[:n] & three[3 : n + 3] | pair[:n] & pair[2 : n + 2] & pair[4 : n + 4] & pair[6 : n + 6]
    lead = b[:n]
    seq = three[:n] & (lead >= 0xE2) | (lead >= 0xC2) & (lead <= 0xDF) & tail[1 : n + 1]
    return np.flatnonzero(strong), np.flatnonzero(seq)


def _drop_plain_cjk(texts: list[str], bits: np.ndarray, a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Without the texts whose only trace is a script that hides UTF-8 read as a many-byte encoding, if it doesn't.

    The texts of a batch are encoded at once, one line each. Only texts that
    are mostly Latin letters may hide a single character; others hide two in
    a row.
    """
    only = np.flatnonzero(bits == _B_CJK)
    if not len(only):
        return bits
    latin = ((a | 32) >= 97) & ((a | 32) <= 122)
    letters = latin | _gates()[6][charlm.unigram_slots(a)]
    mostly = np.add.reduceat(latin[1:].astype(np.int32), starts) * 2 > np.add.reduceat(letters[1:].astype(np.int32), starts)
    at = only.tolist()
    lines = "\n".join(texts[i].replace("\n", " ").replace("\r", " ") for i in at)
    hit = np.zeros(len(at), bool)
    for w in _MANY_BYTE:
        raw = np.frombuffer(lines.encode(w, "replace"), np.uint8)
        three, seq = _utf8_at(raw)
        line = np.cumsum(raw == 10)
        hit[line[three]] = True
        some = np.zeros(len(at), bool)
        some[line[seq]] = True
        hit |= some & mostly[only]
    out = bits.copy()
    out[only[~hit]] = 0
    return out


def inversions(text: str, bits: int) -> tuple[list[tuple[str, str]], bool]:
    """Every chain that could have made ``text``, with the text it was made of,
    and whether the trace is structural (such texts don't train the character model)."""
    out: list[tuple[str, str]] = []
    strong = bool(bits & _B_LOST)
    for i, w in enumerate(_W8):
        if bits >> i & 1:
            got, times = text, 0
            while times < 3:
                new = _UTF8_IN[w].sub(_BACK[w], got)
                if new == got:
                    break
                got, times = new, times + 1
                out.append((f"utf_8>{w}" + f" x{times}" * (times > 1), got))
            # Two neighbouring letters may read as some letter of a rare script: that alone is no structure.
            strong |= times > 0 and w != "cp1251" and not _RARE.search("".join(set(got) - set(text)))
    if bits & _B_LEGACY:
        t = _ONE_BYTE["cp1252"]
        runs = [m for m in _RUN_1252.finditer(text) if len(m.group()) > 1 and sum(c in t for c in m.group()) * 10 >= 3 * len(m.group())]
        if runs:
            strong |= sum(len(m.group()) for m in runs) > 5
            raws = [_bytes_1252(m.group()) for m in runs]
            for r in _LEGACY:
                parts, at = [], 0
                for m, raw in zip(runs, raws):
                    parts += [text[at : m.start()], raw.decode(r, "replace")]
                    at = m.end()
                got = "".join(parts) + text[at:]
                if got.count("�") <= max(1, len(got) // 12) + text.count("�"):
                    out.append((f"{r}>cp1252", got))
    for i, (chain, back) in enumerate(_WEST.items(), len(_W8)):
        if bits >> i & 1:
            out.append((chain, text.translate(back)))
            strong = True
    if bits & _B_CYR and len(_CYR.findall(text)) * 2 >= len(_LETTER.findall(text)):
        for chain, back in _CYR_BACK.items():
            out.append((chain, text.translate(back)))
            # a part of the text: from the first trace to the last
            spans = [m.span() for m in (_CYR_SIGNED if "cp866" in chain else _CYR_SWAPPED).finditer(text)]
            if spans:
                a, b = spans[0][0], spans[-1][1]
                if "cp866" in chain:  # signs stand inside words: take the words whole
                    a, b = text.rfind(" ", 0, a) + 1, (text + " ").find(" ", b)
                part = text[:a] + text[a:b].translate(back) + text[b:]
                if part not in (text, out[-1][1]):
                    out.append((chain, part))
    if bits & _B_CJK:
        latin = len(_LATIN.findall(text)) * 2 > len(_LETTER.findall(text))
        for w in _MANY_BYTE:
            raw = text.encode(w, "replace")
            if _THREE.search(raw) or latin and _SEQ.search(raw):
                got = _stretches(text, w)
                if got and got != text:
                    out.append((f"utf_8>{w}", got))
                    strong |= got.count("�") * 3 < len(got)
    if bits & _B_LOST:
        out.append((LOSSY, text))
    return [(c, t) for c, t in out if t != text or c == LOSSY], strong


_PASS1 = "kind byte, slot bigint, n bigint, key bigint, field string, src string, text string, chains array<string>, inverted array<string>"
_ARROW1 = pa.schema([("kind", pa.int8()), ("slot", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("field", pa.string()), ("src", pa.string()), ("text", pa.string()), ("chains", pa.list_(pa.string())), ("inverted", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: slots of the character model; 1: texts that some chain inverts; 2: texts per source."""
    counter = charlm.Counter()
    per: dict[tuple, int] = {}
    for b in batches:
        keys, srcs = b.column(0).to_pylist(), b.column(1).to_pylist()
        rows: list[tuple] = []
        for at in range(2, b.num_columns):
            field = b.schema.names[at]
            live = [(k, s, t) for k, s, t in zip(keys, srcs, b.column(at).to_pylist()) if t]
            if not live:
                continue
            for s, n in Counter(s for _, s, _ in live).items():
                per[field, s] = per.get((field, s), 0) + n
            texts = [t for _, _, t in live]
            a, starts = charlm.codes(texts)
            lens = np.diff(np.append(starts, len(a) - 1)) - 1
            bits = traces(a, starts, lens)
            bad: list[int] = []
            bits = _drop_plain_cjk(texts, bits, a, starts)
            for i in np.flatnonzero(bits).tolist():
                k, s, t = live[i]
                found, strong = inversions(t, int(bits[i]))
                if found:
                    rows.append((k, field, s, t, [c for c, _ in found], [x for _, x in found]))
                if strong:
                    bad.append(i)
            keep = None
            if bad:
                keep = np.ones(len(a) - 1, bool)
                for i in bad:
                    keep[starts[i] : starts[i] + lens[i] + 1] = False
            counter.add(charlm.fold(a), keep)
        if rows:
            k, f, s, t, c, x = map(list, zip(*rows))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int8()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(k, pa.int64()), pa.array(f), pa.array(s, pa.string()), pa.array(t), pa.array(c, pa.list_(pa.string())), pa.array(x, pa.list_(pa.string()))], schema=_ARROW1)
    slots, counts = counter.rows()
    for i in range(0, len(slots), 100_000):
        n = len(slots[i : i + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int8()), pa.array(slots[i : i + 100_000]), pa.array(counts[i : i + 100_000]), *(pa.nulls(n, f.type) for f in list(_ARROW1)[3:])], schema=_ARROW1)
    if per:
        n = len(per)
        yield pa.RecordBatch.from_arrays([pa.array([2] * n, pa.int8()), pa.nulls(n, pa.int64()), pa.array(list(per.values()), pa.int64()), pa.nulls(n, pa.int64()), pa.array([f for f, _ in per]), pa.array([s for _, s in per], pa.string()), *(pa.nulls(n, f.type) for f in list(_ARROW1)[6:])], schema=_ARROW1)


_SCORED = "key bigint, field string, src string, chains array<string>, llr array<double>, inverted array<string>"


def _scorer(model_b):
    arrow = pa.schema([("key", pa.int64()), ("field", pa.string()), ("src", pa.string()), ("chains", pa.list_(pa.string())), ("llr", pa.list_(pa.float64())), ("inverted", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = charlm.Model(*model_b.value)
        for b in batches:
            keys, fields, srcs, texts, chains, inverted = (c.to_pylist() for c in b.columns)
            base, got = model.score(texts), model.score([x for xs in inverted for x in xs])
            ratios, at = [], 0
            mixed = lambda x: len(_MIXED.findall(x))
            for i, (cs, xs) in enumerate(zip(chains, inverted)):
                # A lost character is certain where bytes are lost; clean text holds one in all characters seen at most.
                glued = mixed(texts[i])
                llr = [math.log(model.total + 1) if c == LOSSY else float(got[j] - base[i]) - MIXED_COST * max(0, mixed(x) - glued) for j, (c, x) in enumerate(zip(cs, xs), at)]
                at += len(cs)
                top = max(llr)
                ratios.append([min(top, 60.0) - (top - v) for v in llr])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys, fields, srcs, chains, ratios, inverted), arrow)], schema=arrow)

    return run


def _posterior(llr: str, rate: str) -> Column:
    """Posterior of each listed chain: rate times likelihood ratio, over all chains and no chain."""
    w = F.zip_with(F.col(llr), F.col(rate), lambda v, p: p * F.exp(v))
    return F.transform(w, lambda x: x / (F.aggregate(w, F.lit(0.0), lambda a, y: a + y) + F.lit(1.0)))


def garbled(df: DataFrame, key: str, source: str, fields: list[str], most: int = 50, moved: float = 1e-3, alpha: float = 50.0) -> DataFrame:
    """Fields of ``df`` that hold wrongly decoded text, with the text put right.

    ``key`` is a unique bigint, ``source`` names where a record comes from and
    ``fields`` are text columns. Gives (key, field, chain, posterior, restored)
    for every field whose most probable explanation is a chain; ``restored``
    keeps U+FFFD where bytes are lost. ``alpha`` is the number of records that
    the rates of all sources weigh against those of one source. EM goes on
    until at most a share ``moved`` of the records found changes its chain in a
    turn, and ``most`` times at most.

    A null source is a source of its own; null and empty texts are never
    cases; repeated rows each give their row; other columns, whatever their
    names, are ignored; an empty table gives an empty result.
    """
    cols = [F.col(key).cast("bigint").alias("k"), F.col(source).cast("string").alias("s"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields))]
    scanned = cut(df.select(*cols).mapInArrow(_scan, _PASS1), "encoding-scan")
    spark = df.sparkSession
    # At most charlm's fixed number of slots reach the driver and the executors.
    lm = scanned.filter("kind = 0").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    model_b = spark.sparkContext.broadcast((lm["slot"].to_numpy(np.int64), lm["n"].to_numpy(np.float64)))
    cand = cut(scanned.filter("kind = 1").select("key", "field", F.coalesce("src", F.lit("")).alias("src"), "text", "chains", "inverted").mapInArrow(_scorer(model_b), _SCORED), "encoding-scored")
    sizes = cut(scanned.filter("kind = 2").groupBy("field", F.coalesce("src", F.lit("")).alias("src")).agg(F.sum("n").alias("size")), "encoding-sizes")
    total = F.broadcast(sizes.groupBy("field").agg(F.sum("size").alias("all_size")))  # a row per field
    # EM on histograms: records of a source with the same chains and rounded ratios count together; what is beyond e^-20 counts as that.
    hist = cut(cand.groupBy("field", "src", "chains", F.transform("llr", lambda v: F.greatest(F.round(v), F.lit(-20.0))).alias("llr")).agg(F.count(F.lit(1)).alias("n")), "encoding-hist")
    flat = lambda d: d.withColumn("rate", F.transform("chains", lambda c: F.lit(1e-4)))
    post, rates, before = flat(hist), None, None
    for _ in range(most):
        e = post.withColumn("r", _posterior("llr", "rate")).select("field", "src", F.col("n").alias("n"), F.explode(F.arrays_zip("chains", "r")).alias("x"))
        own = cut(e.groupBy("field", "src", F.col("x.chains").alias("chain")).agg(F.sum(F.col("x.r") * F.col("n")).alias("mass")), "encoding-mass")
        pooled = own.groupBy("field", "chain").agg(F.sum("mass").alias("all_mass"))
        now = {(r.field, r.chain): r.all_mass for r in pooled.collect()}  # a row per field and chain
        if before is not None and sum(abs(v - before.get(k, 0.0)) for k, v in now.items()) <= moved * sum(now.values()):
            break
        before = now
        rate = (
            own.join(F.broadcast(pooled), ["field", "chain"]).join(total, "field").join(sizes, ["field", "src"])
            .withColumn("rate", (F.col("mass") + alpha * F.col("all_mass") / F.col("all_size")) / (F.col("size") + alpha))
            .withColumn("rate", F.greatest(F.least(F.col("rate"), F.lit(0.95)), F.lit(1e-7)))
            .withColumn("rate", F.col("rate") / (1.0 - F.least(F.col("rate"), F.lit(0.9))))
        )
        rates = cut(rate.groupBy("field", "src").agg(F.map_from_entries(F.collect_list(F.struct("chain", "rate"))).alias("rates")), "encoding-rates")
        post = _with_rates(hist, rates)
    final = (
        (flat(cand) if rates is None else _with_rates(cand, rates)).withColumn("r", _posterior("llr", "rate"))
        .withColumn("sum", F.aggregate("r", F.lit(0.0), lambda a, x: a + x))
        .withColumn("best", F.array_position("r", F.array_max("r")).cast("int"))
        .filter("sum > 0.5")
    )
    return final.select(F.col("key").alias(key), F.when(F.lit(False), "").otherwise(_field_name(fields)).alias("field"), F.element_at("chains", F.col("best")).alias("chain"), F.col("sum").alias("posterior"), F.element_at("inverted", F.col("best")).alias("restored"))


def _field_name(fields: list[str]) -> Column:
    out = F.lit(fields[0])
    for i, f in enumerate(fields[1:], 1):
        out = F.when(F.col("field") == f"f{i}", f).otherwise(out)
    return out


def _with_rates(df: DataFrame, rates: DataFrame) -> DataFrame:
    return df.join(rates, ["field", "src"]).withColumn("rate", F.transform("chains", lambda c: F.coalesce(F.element_at("rates", c), F.lit(1e-7))))
