"""Problem 3: the most similar vectors of every vector.

NN-descent: a graph of neighbour lists starts from random-projection blocks
and improves by joins of neighbours of neighbours, since a neighbour of a
neighbour is likely a neighbour. A round gives every node its members (its
list, and a bounded sample of the nodes that list it), compares all members
with one another, and keeps what improves a list, until hardly a list
changes. Nodes that follow one another in a projection's order form a cell;
rounds ship numbers of nodes, and every cell gets each int8 vector that its
nodes' members need once. Blocks stay as small as they are while the table
grows: projections get more bits and there are more of them. The last step
compares the exact vectors. Queries walk the graph: from the nodes next to
them in the projections' orders they move to the neighbours closest to them
until nothing closer turns up.

Vectors that are equal count once in the graph; their positions come back at
the end, so a vector that a third of all rows share is one node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.session import cut

#: Rows of a start block that are compared with one another.
BLOCK = 512
#: Nodes of a cell.
CELL = 2048
#: Rows of a partition that are worked on at once.
_CHUNK = 100_000


def usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, v, sig) of the vectors of ``width`` numbers that aren't all zero; others, null and not finite ones are left out.

    Vectors of one direction (to six digits) have one ``sig``.
    """
    arrow = pa.schema([("key", pa.int64()), ("v", pa.list_(pa.float64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1))
            n = np.sqrt((m * m).sum(1))
            ok = np.isfinite(n) & (n > 0)
            whole = np.rint(m[ok] / n[ok, None] * 1e6).astype(np.int32)
            sig = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in whole]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), _lists(m[ok], pa.float64()), pa.array(sig, pa.binary())], schema=arrow)

    v = F.col(vector)
    return df.filter(F.size(v) == width).select(F.col(key).cast("bigint").alias("key"), v.cast("array<double>").alias("v")).filter("key is not null").mapInArrow(run, "key bigint, v array<double>, sig binary").select("key", F.col("v").cast("array<float>").alias("v"), "sig")


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of fixed width, as double precision numbers; nulls become NaN."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _pack(u: np.ndarray) -> list[bytes]:
    """Vectors as int8, each scaled to its largest entry; similarity needs directions only."""
    q = np.rint(u / np.abs(u).max(1, keepdims=True) * 127).astype(np.int8)
    return [r.tobytes() for r in q]


def _unpack(cells: list[bytes] | pa.Array) -> np.ndarray:
    raw = b"".join(cells.to_pylist() if isinstance(cells, (pa.Array, pa.ChunkedArray)) else cells)
    q = np.frombuffer(raw, np.int8).reshape(len(cells), -1).astype(np.float32)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def _projections(n: int) -> tuple[int, int]:
    """(trees, bits) for ``n`` nodes: a code holds about half a block, and orders multiply with log n since each separates more."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / BLOCK * 2)))
    return max(4, bits), bits


def _packer(trees: int, bits: int, width: int, seed: int):
    """(tree, code, proj, a, q): a row's place in every random-projection order."""
    arrow = pa.schema([("tree", pa.int32()), ("code", pa.int64()), ("proj", pa.float64()), ("a", pa.int64()), ("q", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((trees, bits + 1, width))
        for b in batches:
            if not b.num_rows:
                continue
            u = _units(_matrix(b.column(1)))
            q = pa.array(_pack(u), pa.binary())
            for t in range(trees):
                d = u @ planes[t].T
                code = ((d[:, :bits] > 0) << np.arange(bits)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t, np.int32)), pa.array(code.astype(np.int64)), pa.array(d[:, bits]), b.column(0), q], schema=arrow)

    return run


# -- neighbour lists: a row per node ------------------------------------------

_LIST = "a bigint, b array<bigint>, sim array<float>, fresh array<boolean>"
_LIST_ARROW = pa.schema([("a", pa.int64()), ("b", pa.list_(pa.int64())), ("sim", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_()))])


def _first(a: np.ndarray, *order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first ``most`` entries of each ``a`` by ``order``, and where each ``a`` starts among them."""
    o = np.lexsort((*reversed(order), a))
    s = a[o]
    new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    o = o[rank < most]
    s = a[o]
    return o, np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best distinct edges of every node: (a, starts, b, sim, fresh); ties go to the smaller neighbour.

    An edge that was there before isn't fresh.
    """
    o = np.lexsort((fresh, b, a))
    a, b, sim, fresh = a[o], b[o], sim[o], fresh[o]
    one = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    a, b, sim, fresh = a[one], b[one], sim[one], fresh[one]
    o, starts = _first(a, -sim, b, most=k)
    return a[o][starts], starts, b[o], sim[o], fresh[o]


def _list_batch(a: np.ndarray, starts: np.ndarray, b: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    off = pa.array(np.append(starts, len(b)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(a), *(pa.ListArray.from_arrays(off, pa.array(x)) for x in (b, sim.astype(np.float32), fresh))], schema=_LIST_ARROW)


def _flat(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, sim, fresh) of rows of lists."""
    t = t.combine_chunks() if isinstance(t, pa.Table) else t
    cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in t.columns]
    if not t.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)
    n = cols[1].value_lengths().to_numpy()
    return np.repeat(cols[0].to_numpy(), n), *(c.flatten().to_numpy(zero_copy_only=False) for c in cols[1:])


def _merge(k: int):
    """Rows of lists sorted by node, merged to one list per node.

    What is held of a node never exceeds a chunk and its list, however many
    rows it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            got = _best(*(np.concatenate(x) for x in zip(*held)), k)
            a, starts, b, sim, fresh = got
            # The last node may go on in the next rows.
            keep = len(a) if last else len(a) - 1
            if keep > 0:
                end = starts[keep] if keep < len(a) else len(b)
                yield _list_batch(a[:keep], starts[:keep], b[:end], sim[:end], fresh[:end])
            at = starts[keep] if keep < len(a) else len(b)
            held = [(np.full(len(b) - at, a[-1]), b[at:], sim[at:], fresh[at:])] if at < len(b) else []
            n = len(b) - at

        for x in batches:
            edges = _flat(x)
            if len(edges[0]):
                held.append(edges)
                n += len(edges[0])
            if n > _CHUNK:
                yield from give(False)
        if held:
            yield from give(True)

    return run


def _top_edges(ids: np.ndarray, u: np.ndarray, k: int) -> pa.RecordBatch | None:
    n = len(ids)
    if n < 2:
        return None
    s = u @ u.T
    np.fill_diagonal(s, -2)
    m = min(k, n - 1)
    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
    return _list_batch(ids, np.arange(n) * m, ids[top.ravel()], np.take_along_axis(s, top, 1).ravel(), np.ones(n * m, bool))


def _blocks(k: int):
    """Edges inside blocks of rows that follow one another in the order of a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, u = None, np.zeros(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            trees, new, v = b.column(0).to_numpy(), b.column(1).to_numpy(), _unpack(b.column(2))
            for t in np.unique(trees).tolist():
                mine = trees == t
                if t != tree:
                    if u is not None and (got := _top_edges(ids, u, k)) is not None:
                        yield got
                    tree, ids, u = t, new[mine], v[mine]
                else:
                    ids, u = np.concatenate([ids, new[mine]]), np.concatenate([u, v[mine]])
                while len(ids) > BLOCK:
                    yield _top_edges(ids[:BLOCK], u[:BLOCK], k)
                    # half a block overlaps with the next, so neighbours on a border meet
                    ids, u = ids[BLOCK // 2 :], u[BLOCK // 2 :]
        if u is not None and (got := _top_edges(ids, u, k)) is not None:
            yield got

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, a) of rows in the order of a tree; a cell is named by its first node."""
    n, name = 0, 0
    for b in batches:
        ids = b.column(0).to_numpy()
        out = np.empty(len(ids), np.int64)
        at = 0
        while at < len(ids):
            if n == 0:
                name = ids[at]
            step = min(CELL - n, len(ids) - at)
            out[at : at + step] = name
            at, n = at + step, (n + step) % CELL
        yield pa.RecordBatch.from_arrays([pa.array(out), b.column(0)], names=["cell", "a"])


_MEMBER = "c bigint, m bigint, fresh boolean, mix bigint"
_MEMBER_ARROW = pa.schema([("c", pa.int64()), ("m", pa.int64()), ("fresh", pa.bool_()), ("mix", pa.int64())])


def _listed_by(k: int, turn: int):
    """(c, m, fresh, mix): for every listed node at most ``k`` of those that list it, new ones first, drawn anew each turn; before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def give() -> pa.RecordBatch:
            a, b, _, fresh = (np.concatenate(x) for x in zip(*held))
            with np.errstate(over="ignore"):
                h = (a.astype(np.uint64) + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
            mix = (h >> np.uint64(2)).astype(np.int64)
            o, _ = _first(b, ~fresh, mix, most=k)
            return pa.RecordBatch.from_arrays([pa.array(b[o]), pa.array(a[o]), pa.array(fresh[o]), pa.array(mix[o])], schema=_MEMBER_ARROW)

        for x in batches:
            if x.num_rows:
                held.append(_flat(x))
                n += len(held[-1][0])
            if n > 5 * _CHUNK:
                yield give()
                held, n = [], 0
        if held:
            yield give()

    return run


def _meet_members(m: int):
    """All members of a cell's nodes compared, node by node; for each member its ``m`` best that beat its list's last, as lists.

    ``plan`` is (cell, c, m, fresh) with lists, ``need`` (to, m, q, floor).
    """

    def run(plan: pa.Table, need: pa.Table) -> pa.Table:
        ids = need.column("m").to_numpy()
        order = np.argsort(ids)
        ids, floor, u = ids[order], need.column("floor").to_numpy()[order], _unpack(need.column("q"))[order]
        plan = plan.combine_chunks()
        lens = plan.column("m").combine_chunks().value_lengths().to_numpy()
        width = int(lens.max(initial=0))
        found: list[tuple] = []
        flat = np.searchsorted(ids, plan.column("m").combine_chunks().flatten().to_numpy())
        new = plan.column("fresh").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lens)
        for i in range(0, len(lens), 256):
            n = lens[i : i + 256]
            lo, hi = ends[i] - n[0], ends[min(i + 255, len(lens) - 1)]
            there = np.arange(width) < n[:, None]
            at, f = np.zeros(there.shape, np.int64), np.zeros(there.shape, bool)
            at[there], f[there] = flat[lo:hi], new[lo:hi]
            v = u[at]
            s = v @ v.transpose(0, 2, 1)
            # pairs of two old members met before
            off = ~(there[:, :, None] & there[:, None, :] & (f[:, :, None] | f[:, None, :])) | (at[:, :, None] == at[:, None, :])
            s[off] = -3
            s[s <= floor[at][:, :, None]] = -3
            k = min(m, width - 1)
            if k < 1:
                continue
            top = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
            got = np.take_along_axis(s, top, 2)
            keep = got > -3
            a = np.broadcast_to(at[:, :, None], got.shape)[keep]
            b = np.take_along_axis(np.broadcast_to(at[:, None, :], s.shape), top, 2)[keep]
            found.append((ids[a], ids[b], got[keep].astype(np.float32)))
        if not found:
            return pa.Table.from_batches([], _LIST_ARROW)
        a, b, sim = (np.concatenate(x) for x in zip(*found))
        # A cell gives each node one list, so a node that many list gets a row per cell.
        return pa.Table.from_batches([_list_batch(*_best(a, b, sim, np.ones(len(a), bool), 2 * m))])

    return run


_PLAN = "cell bigint, c bigint, m array<bigint>, fresh array<boolean>"


def _plan(k: int):
    """Members (cell, c, m, fresh, mix, own) sorted by cell and node, as lists: all of its own list, at most ``k`` of the others."""
    arrow = pa.schema([("cell", pa.int64()), ("c", pa.int64()), ("m", pa.list_(pa.int64())), ("fresh", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            cell, c, m, fresh, mix, own = (np.concatenate(x) for x in zip(*held))
            open_end = c[-1]
            o, _ = _first(c * 2 + own, ~fresh, mix, most=k)  # forward lists hold no more than k
            cell, c, m, fresh, mix, own = (x[o] for x in (cell, c, m, fresh, mix, own))
            rest = c == open_end if not last else np.zeros(len(c), bool)
            held = [[x[rest] for x in (cell, c, m, fresh, mix, own)]] if rest.any() else []
            n = int(rest.sum())
            cell, c, m, fresh = (x[~rest] for x in (cell, c, m, fresh))
            o = np.lexsort((~fresh, m, c))
            cell, c, m, fresh = cell[o], c[o], m[o], fresh[o]
            one = np.append(True, (c[1:] != c[:-1]) | (m[1:] != m[:-1])) if len(c) else np.zeros(0, bool)
            cell, c, m, fresh = cell[one], c[one], m[one], fresh[one]
            starts = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
            if len(starts):
                # Nodes without a new member have nothing left to compare.
                live = np.logical_or.reduceat(fresh, starts) & (np.diff(np.append(starts, len(c))) > 1)
                off = pa.array(np.append(starts, len(c)).astype(np.int32))
                t = pa.RecordBatch.from_arrays([pa.array(cell[starts]), pa.array(c[starts]), pa.ListArray.from_arrays(off, pa.array(m)), pa.ListArray.from_arrays(off, pa.array(fresh))], schema=arrow)
                yield t.filter(pa.array(live))

        for b in batches:
            if b.num_rows:
                held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
                n += b.num_rows
            if n > _CHUNK:
                yield from give(False)
        if held:
            yield from give(True)

    return run


def _placed(nodes: DataFrame, width: int, trees: int | None, bits: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(tree, code, proj, a, q) of every node in every order, and (cell, a)."""
    n_part = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grown = _projections(nodes.count())
    placed = cut(nodes.select("key", "v").mapInArrow(_packer(trees or grown[0], bits or grown[1], width, seed), "tree int, code bigint, proj double, a bigint, q binary"), "knn-placed")
    first = placed.filter("tree = 0").select("code", "proj", "a").repartitionByRange(n_part, "code", "proj", "a").sortWithinPartitions("code", "proj", "a")
    return placed, cut(first.select("a").mapInArrow(_cells, "cell bigint, a bigint"), "knn-cells")


def _graph(placed: DataFrame, cells: DataFrame, k: int, delta: float) -> DataFrame:
    """Neighbour lists (a, b, sim, fresh) of every node, by rounds until at most a share ``delta`` of all edges is new."""
    n_part = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = placed.filter("tree = 0").select(F.col("a").alias("m"), "q")
    # A range order has no hot bucket: equal codes are told apart by the projection.
    order = placed.repartitionByRange(n_part, "tree", "code", "proj", "a").sortWithinPartitions("tree", "code", "proj", "a")
    together = lambda lists: lists.repartition(n_part, "a").sortWithinPartitions("a").mapInArrow(_merge(k), _LIST)
    graph = cut(together(order.select("tree", "a", "q").mapInArrow(_blocks(k), _LIST)), "knn-start")
    turn = 0
    while _changed(graph) > delta:
        own = graph.select(F.col("a").alias("c"), F.explode(F.arrays_zip(F.col("b").alias("m"), "fresh")).alias("x")).select("c", F.col("x.m").alias("m"), F.col("x.fresh").alias("fresh"), F.lit(0).cast("bigint").alias("mix"), F.lit(True).alias("own"))
        both = own.unionByName(graph.mapInArrow(_listed_by(k, turn), _MEMBER).withColumn("own", F.lit(False)))
        members = both.join(cells.withColumnRenamed("a", "c"), "c").select("cell", "c", "m", "fresh", "mix", F.col("own").cast("bigint").alias("own"))
        plan = cut(members.repartition(n_part, "cell").sortWithinPartitions("cell", "c").mapInArrow(_plan(k), _PLAN), "knn-plan")
        floor = graph.select(F.col("a").alias("m"), F.when(F.size("sim") >= k, F.array_min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        need = plan.select("cell", F.explode("m").alias("m")).distinct().join(packed.join(floor, "m", "left"), "m").select(F.col("cell").alias("to"), "m", "q", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"))
        found = plan.groupBy("cell").cogroup(need.groupBy("to")).applyInArrow(_meet_members(max(4, k // 2)), _LIST)
        graph = cut(together(graph.select("a", "b", "sim", F.transform("fresh", lambda x: F.lit(False)).alias("fresh")).unionByName(found)), "knn-round")
        turn += 1
    return graph


def knn_graph(nodes: DataFrame, width: int, k: int = 12, delta: float = 0.001, trees: int | None = None, bits: int | None = None, seed: int = 7) -> DataFrame:
    """(a, b, sim): about the ``k`` nearest nodes of every node of ``nodes`` (key, v), similarities from int8 vectors.

    Rounds go on until at most a share ``delta`` of all edges is new; lists
    only improve, so they end. ``trees`` and ``bits`` grow with the table
    unless they are given.
    """
    placed, cells = _placed(nodes, width, trees, bits, seed)
    return _graph(placed, cells, k, delta).select("a", F.explode(F.arrays_zip("b", "sim")).alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.sim").alias("sim"))


def _changed(graph: DataFrame) -> float:
    """Share of a written graph's edges that its last round brought."""
    n, fresh = graph.agg(F.sum(F.size("b")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
    return (fresh or 0) / max(n or 0, 1)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of ``vectors`` (key, v, sig): one (key, v) per distinct direction, its smallest key; and (key, rep) of every row."""
    reps = vectors.groupBy("sig").agg(F.min("key").alias("rep"))
    members = vectors.select("key", "sig").join(reps, "sig").select("key", "rep")
    nodes = vectors.join(reps.select(F.col("rep").alias("key")), "key", "left_semi").select("key", "v")
    return nodes, members


def _exact_lists(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``k`` best of each node's list by exact cosines, equal ones by the smaller neighbour; ``need`` is (to, m, v)."""

    def run(lists: pa.Table, need: pa.Table) -> pa.Table:
        ids = need.column("m").to_numpy()
        order = np.argsort(ids)
        u = _units(_matrix(need.column("v").combine_chunks()))[order]
        a, b, sim, fresh = _flat(lists.select(["a", "b", "sim", "fresh"]))
        if len(a):
            i, j = np.searchsorted(ids[order], a), np.searchsorted(ids[order], b)
            sim = np.concatenate([np.einsum("ij,ij->i", u[i[n : n + _CHUNK]], u[j[n : n + _CHUNK]]) for n in range(0, len(i), _CHUNK)])
        # Cosines that differ by less than rounding are equal.
        o, _ = _first(a, -np.round(sim, 12), b, most=k)
        return pa.table([pa.array(a[o]), pa.array(b[o]), pa.array(np.asarray(sim[o], np.float64))], names=["a", "b", "sim"])

    return run


def nearest(df: DataFrame, key: str, vector: str, width: int, k: int = 5, graph_k: int = 16) -> DataFrame:
    """(key, other, cosine, rank): the ``k`` most similar others of every vector of ``width`` numbers.

    Vectors of another width, null, empty, with nulls or not finite, and
    all-zero vectors take no part. Similarities are exact cosines; which
    pairs are compared is approximate. Equal similarities rank by the smaller
    key; a repeated vector's copies are each other's neighbours. Keys must be
    unique; an empty table gives an empty result.
    """
    vectors = cut(usable(df, key, vector, width), "knn-vectors")
    nodes, members = distinct_vectors(vectors)
    nodes, members = cut(nodes, "knn-nodes"), cut(members, "knn-members")
    placed, cells = _placed(nodes, width, None, None, 7)
    lists = cut(_graph(placed, cells, graph_k, 0.001).join(cells, "a"), "knn-lists")
    need = lists.select("cell", F.explode(F.concat("b", F.array("a"))).alias("m")).distinct().join(nodes.withColumnRenamed("key", "m"), "m").select(F.col("cell").alias("to"), "m", "v")
    sims = lists.groupBy("cell").cogroup(need.groupBy("to")).applyInArrow(_exact_lists(k + 1), "a bigint, b bigint, sim double")
    by_node = sims.unionByName(nodes.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("sim")))
    # Of a repeated vector only its k + 1 smallest keys can be in anyone's list.
    w = Window.partitionBy("rep").orderBy("key")
    firsts = members.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1)
    # Lists of nodes, written out in positions: at most k + 1 of each neighbour, then the best k + 1 of all.
    w2 = Window.partitionBy("a").orderBy(F.round("sim", 12).desc(), "other")
    rows = by_node.join(firsts.select(F.col("rep").alias("b"), F.col("key").alias("other")), "b").withColumn("rn", F.row_number().over(w2)).filter(F.col("rn") <= k + 1)
    per = rows.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rn", "other", "sim"))).alias("l"))  # k + 1 entries
    got = members.join(per, members["rep"] == per["a"]).select("key", F.slice(F.filter("l", lambda x: x["other"] != F.col("key")), 1, k).alias("l"))
    return got.select(F.col("key").alias(key), F.posexplode("l").alias("rank", "x")).select(key, F.col("x.other").alias("other"), F.col("x.sim").alias("cosine"), (F.col("rank") + 1).alias("rank"))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            s = np.einsum("ij,ij->i", _units(_matrix(b.column(2))), _units(_matrix(b.column(3))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["a", "b", "sim"])


def _meet(k: int):
    """(query, node) of each query's ``k`` best nodes in its block of every order."""
    arrow = pa.schema([("query", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        qs: list[bytes] = []
        asked: list[tuple[int, bytes, int]] = []
        tree = None

        def flush() -> Iterator[pa.RecordBatch]:
            u, m = _unpack(qs) if ids and asked else None, min(k, len(ids))
            for at in range(0, len(asked) if m else 0, 4096):
                some = asked[at : at + 4096]
                top = np.argpartition(-(_unpack([x[1] for x in some]) @ u.T), m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[0] for x in some], np.int64), m)), pa.array(np.array(ids, np.int64)[top.ravel()])], schema=arrow)

        for b in batches:
            for t, asks, a, q in zip(*(x.to_pylist() for x in b.columns)):
                if t != tree or not asks and len(ids) >= BLOCK:
                    yield from flush()
                    half = BLOCK // 2
                    # what stands in the second half meets the next nodes too
                    ids, qs, asked = (ids[half:], qs[half:], [(x, y, n - half) for x, y, n in asked if n > half]) if t == tree else ([], [], [])
                    tree = t
                if asks:
                    asked.append((a, q, len(ids)))
                else:
                    ids.append(a)
                    qs.append(q)
        yield from flush()

    return run


def _entries(queries: DataFrame, nodes: DataFrame, per_tree: int, seed: int) -> DataFrame:
    """(query, node): nodes next to each query in the orders of random projections."""
    spark = queries.sparkSession
    first = nodes.select(F.size("v")).first()
    if first is None:
        return spark.createDataFrame([], "query bigint, node bigint")
    trees, bits = _projections(nodes.count())
    placed = lambda df: df.mapInArrow(_packer(trees, bits, first[0], seed), "tree int, code bigint, proj double, a bigint, q binary")
    both = placed(nodes.select("key", "v")).withColumn("asks", F.lit(False)).unionByName(placed(queries.select("query", "v")).withColumn("asks", F.lit(True)))
    at = ["tree", "code", "proj", "a", "asks"]
    order = both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *at).sortWithinPartitions(*at)
    return order.select("tree", "asks", "a", "q").mapInArrow(_meet(per_tree), "query bigint, node bigint")


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, k: int = 5, beam: int = 16, entries: int = 48, seed: int = 11) -> DataFrame:
    """(query, node, cosine): the ``k`` best nodes that walking the graph finds for each query.

    ``queries`` is (query, v), ``nodes`` (key, v), ``graph`` (a, b). A
    query keeps its ``beam`` best nodes and expands those it hasn't expanded;
    a round is two joins, and only a walk without new nodes is over. It starts
    from nodes next to the query in random projections, and from ``entries``
    fixed ones, so that no query is without an entry.
    """
    q = queries.select("query", F.col("v").alias("uq"))
    n = nodes.select(F.col("key").alias("node"), F.col("v").alias("un"))
    # Edges are walked both ways; hubs offer their closest nodes only.
    w0 = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    both = graph.select("a", "b", "sim").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).distinct()
    steps_from = cut(both.withColumn("rn", F.row_number().over(w0)).filter(F.col("rn") <= 2 * beam).select("a", "b"), "walk-edges")
    start = n.orderBy(F.xxhash64("node", F.lit(seed))).limit(entries)  # the fixed entry nodes
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "node")

    def scored(pairs: DataFrame) -> DataFrame:
        s = pairs.select("query", "node", "uq", "un").mapInArrow(_exact, "a bigint, b bigint, sim double")
        return s.select(F.col("a").alias("query"), F.col("b").alias("node"), F.col("sim").alias("cosine"))

    near = _entries(queries, nodes, beam // 2, seed).unionByName(q.select("query").join(F.broadcast(start.select("node")))).distinct()
    best = cut(scored(near.join(n, "node").join(q, "query")).withColumn("done", F.lit(False)).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= beam).drop("rn"), "walk-start")
    while not best.filter("not done").isEmpty():
        new = best.filter("not done").join(steps_from, F.col("node") == F.col("a")).select("query", F.col("b").alias("node")).distinct()
        new = new.join(best.select("query", "node"), ["query", "node"], "left_anti")
        found = scored(new.join(n, "node").join(q, "query")).withColumn("done", F.lit(False))
        best = cut(best.withColumn("done", F.lit(True)).unionByName(found).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= beam).drop("rn"), "walk-step")
    return best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("query", "node", "cosine")


def rows_of(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query, node, cosine): the ``k`` best rows among all rows of the nodes found, the query itself left out.

    ``found`` is (query, node, cosine) with a query's ``k`` + 1 best nodes,
    ``members`` (key, rep) of every row. Equal cosines rank by the smaller key.
    """
    w = Window.partitionBy("rep").orderBy("key")
    firsts = members.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1).select(F.col("rep").alias("node"), "key")
    w2 = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "key")
    rows = found.join(firsts, "node").filter("key <> query").withColumn("rn", F.row_number().over(w2)).filter(F.col("rn") <= k)
    return rows.select("query", F.col("key").alias("node"), "cosine")
