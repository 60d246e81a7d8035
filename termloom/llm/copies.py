"""Problem 4: records that differ only in layout, collapsed and counted.

Each record becomes canonical bytes: the letters and digits of its id and of
its text, lower-cased, whole. Keys are partitioned by radix: a bucket is the
set of keys with one prefix; a bucket over ``bucket_bytes`` is split by the
bytes that follow what all its keys share, again and again, until each fits
or holds a single key. Every task counts the keys of its buckets in a trie
whose terminals hold a counter and the smallest record key.

Before any shuffle, each scan task folds its own rows with the same trie, so
a group that holds a third of all records reaches its bucket as one row per
task. Only there do canonical bytes travel; members are told by numbers: a
record points to the smallest of its task, and that to the smallest of all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.session import cut, small_side

#: Bytes of keys up to which a bucket is not split: they stay within the second-level cache of a core.
BUCKET_BYTES = 1 << 18
#: Bytes by which an oversized bucket is split, beyond what its keys share.
RADIX_STEP = 2
#: Bytes of one trie edge.
EDGE = 8
#: Rows, and bytes of keys, that a scan task folds at once.
FOLD_ROWS, FOLD_BYTES = 300_000, 64 << 20


def canonical(col: Column) -> Column:
    """Letters and digits, lower-cased; null stays null."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


_ODD = re.compile(r"[\W_]+")
_ASCII_LOW = bytes(range(256)).lower()
_ASCII_OFF = bytes(c for c in range(128) if not chr(c).isalnum())


def canonical_bytes(text: str) -> bytes:
    """The same as bytes."""
    if text.isascii():
        return text.encode().translate(_ASCII_LOW, _ASCII_OFF)
    return _ODD.sub("", text.lower()).encode("utf-8", "surrogatepass")


class Trie:
    """Byte strings by edges of EDGE bytes; a terminal holds [key, count, smallest record key].

    A terminal hangs on the first edge that no other key shares and moves
    down only when another key needs that edge.
    """

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, key: bytes, n: int, least: int) -> list:
        """Count a key and give its terminal."""
        node, at = self.root, 0
        while True:
            edge = key[at : at + EDGE]
            x = node.get(edge)
            if x is None:
                x = node[edge] = [key, n, least]
                self.size += 1
                return x
            at += EDGE
            if type(x) is list:
                if x[0] == key:
                    x[1] += n
                    if least < x[2]:
                        x[2] = least
                    return x
                node[edge] = {x[0][at : at + EDGE]: x}
            node = node[edge]

    def terminals(self) -> Iterator[list]:
        """Every [key, counter, smallest record key]."""
        stack = [self.root]
        while stack:
            for x in stack.pop().values():
                if type(x) is list:
                    yield x
                else:
                    stack.append(x)


# A key with its count and smallest record (kb set), or a record with the smallest of its group (kb null).
_FOLD = "tbl string, kb binary, n bigint, key bigint, least bigint"
_ARROW = pa.schema([("tbl", pa.string()), ("kb", pa.binary()), ("n", pa.int64()), ("key", pa.int64()), ("least", pa.int64())])


class _Folder:
    """Tries by table, and the rows that went in."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.tries: dict[str, Trie] = {}
        self.rows: list[tuple[str, int, list]] = []
        self.bytes = 0

    def add(self, tbl: str, kb: bytes, n: int, key: int) -> None:
        t = self.tries.get(tbl)
        if t is None:
            t = self.tries[tbl] = Trie()
        self.rows.append((tbl, key, t.add(kb, n, key)))
        self.bytes += len(kb)

    def give(self) -> Iterator[pa.RecordBatch]:
        """Keys, then the rows that aren't the smallest of theirs."""
        part: list[tuple] = []
        for tbl, t in self.tries.items():
            for kb, n, least in t.terminals():
                part.append((tbl, kb, n, least, least))
                if len(part) >= 20_000:
                    yield _batch(part)
                    part = []
        for tbl, key, x in self.rows:
            if key != x[2]:
                part.append((tbl, None, None, key, x[2]))
                if len(part) >= 20_000:
                    yield _batch(part)
                    part = []
        if part:
            yield _batch(part)
        self.clear()


def _batch(part: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*part), _ARROW)], schema=_ARROW)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tbl, key, parts...) folded as they come."""
    f = _Folder()
    for b in batches:
        tbls, keys, *parts = (c.to_pylist() for c in b.columns)
        for tbl, key, *texts in zip(tbls, keys, *parts):
            if None in texts:
                continue
            can = [canonical_bytes(x) for x in texts]
            if all(can):
                f.add(tbl, b"\x1f".join(can), 1, key)
        if len(f.rows) > FOLD_ROWS or f.bytes > FOLD_BYTES:
            yield from f.give()
    yield from f.give()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys (tbl, kb, n, least, bucket) sorted by bucket; a bucket's tries are given out when it ends."""
    f, bucket = _Folder(), None
    for b in batches:
        for tbl, kb, n, least, mark in zip(*(c.to_pylist() for c in b.columns)):
            if mark != bucket:
                # Small buckets share a trie.
                if f.bytes > BUCKET_BYTES:
                    yield from f.give()
                bucket = mark
            f.add(tbl, kb, n, least)
    yield from f.give()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, next): how far the smallest and the largest key of a bucket agree, and a step more."""
    for b in batches:
        out = []
        for p, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
            n = next((i for i, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
            out.append((p, n + RADIX_STEP))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([n for _, n in out], pa.int32())], names=["p", "next"])


def radix_buckets(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """``keys`` (kb, ...) of a written table with their bucket ``_b``, and the number of splits that it took.

    A bucket over ``bucket_bytes`` that holds more than one key is split. The
    prefixes of such buckets stay in written tables; they are looked up by
    joins, broadcast only while they are small.
    """
    prefix = F.substr(F.col("kb"), F.lit(1), F.col("_d"))
    placed = keys.withColumn("_d", F.lit(RADIX_STEP))
    live = placed.select("kb", "_d")
    splits = 0
    while True:
        counted = live.groupBy(prefix.alias("p")).agg(F.sum(F.octet_length("kb")).alias("size"), F.min(F.octet_length("kb")).alias("short"), F.max(F.octet_length("kb")).alias("long"), F.min(F.xxhash64("kb")).alias("one"), F.max(F.xxhash64("kb")).alias("other"))
        many = (F.col("short") != F.col("long")) | (F.col("one") != F.col("other"))
        over = cut(counted.filter((F.col("size") > bucket_bytes) & many).select("p"), "copies-over")
        if over.isEmpty():
            return placed.withColumn("_b", prefix).drop("_d"), splits
        splits += 1
        live = live.withColumn("p", prefix).join(small_side(over), "p")
        # Only keys of oversized buckets are compared: they share their prefix, and often much more.
        ends = live.groupBy("p").agg(F.min("kb").alias("lo"), F.max("kb").alias("hi"))
        deeper = small_side(cut(ends.mapInArrow(_shared, "p binary, next int"), "copies-deeper"))
        live = live.join(deeper, "p").select("kb", F.col("next").alias("_d"))
        placed = placed.withColumn("p", prefix).join(deeper, "p", "left").withColumn("_d", F.coalesce("next", "_d")).drop("p", "next")


def copies(records: DataFrame, parts: list[str], bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(groups, members): (tbl, least, n) for each distinct record with its
    smallest key and its number of copies, and (tbl, key_a, key_b) for every
    record but the first of a group.

    ``records`` holds tbl, key (unique within a tbl) and the text columns
    ``parts``; other columns are ignored. Records are copies when the letters
    and digits of all parts agree, case aside. Records with a null part, or
    one without a letter or digit, belong to no group. An empty table gives
    no groups.
    """
    start = records.select("tbl", F.col("key").cast("bigint").alias("key"), *[F.col(p).alias(f"t{i}") for i, p in enumerate(parts)])
    local = cut(start.mapInArrow(_scan, _FOLD), "copies-local")
    placed, _ = radix_buckets(local.filter("kb is not null").select("tbl", "kb", "n", "least"), bucket_bytes)
    counted = cut(placed.repartition("_b").sortWithinPartitions("_b").select("tbl", "kb", "n", "least", "_b").mapInArrow(_count, _FOLD), "copies-groups")
    groups = counted.filter("kb is not null").select("tbl", "least", "n")
    # (key, least): smallest records of a task that aren't the smallest of all.
    moved = counted.filter("kb is null").select("tbl", "key", "least")
    first = local.filter("kb is null").select("tbl", "key", F.col("least").alias("_l"))
    own = first.join(moved.select("tbl", F.col("key").alias("_l"), "least"), ["tbl", "_l"], "left").select("tbl", "key", F.coalesce("least", "_l").alias("least"))
    return groups, own.unionByName(moved).select("tbl", F.col("least").alias("key_a"), F.col("key").alias("key_b"))


_XML = "key bigint, id string, source string"
_XML_ARROW = pa.schema([("key", pa.int64()), ("id", pa.string()), ("source", pa.string())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xml.etree import ElementTree as ET

    for b in batches:
        out = []
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not x:
                continue
            try:
                e = ET.fromstring(x)
            except (ET.ParseError, ValueError, UnicodeError):
                continue
            if e.tag != "String":
                e = e.find(".//String")
                if e is None:
                    continue
            src = e.find("Source")
            if src is None:
                continue
            rid = e.get("EDID")
            if rid is None:
                child = e.find("EDID")
                rid = child.text if child is not None and child.text else e.get("id")
            out.append((k, rid, "".join(src.itertext())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _XML_ARROW)], schema=_XML_ARROW)


def parse_records(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, id, source) of every well-formed ``<String>`` with a Source.

    The id is the EDID attribute if present, even empty, else a non-empty
    EDID child, else the id attribute; a record without any has a null id.
    Null, empty and malformed records give no row.
    """
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(xml).alias("xml")).filter("xml is not null").mapInArrow(_parse, _XML)
