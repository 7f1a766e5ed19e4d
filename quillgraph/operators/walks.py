"""Directed walks from many roots over a graph of typed nodes with integer keys, without a shuffle of the walks.

Pairs ``(head, tail)`` travel as blocks: sorted, distinct, compressed arrays of some millions of pairs in one row. The
pairs of a level are blocks by root and the edges of a step are blocks by target, so a root and a target meet in
one block of each, and what a block of roots reaches in a block of targets is made distinct where it is found. Only
distinct pairs are ever written, and the pairs of the last level not even that. The price is that every block of
roots is read with every block of targets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import Scratch

#: Pairs in a block of roots and edges in a block of targets, on average; walks unfolded and rows scattered at once; ids in a list.
PAIRS, EDGES, WALKS, ROWS, LIST = 2_000_000, 4_000_000, 1_000_000, 1_000_000, 10_000
_PART, _BLOCK = "b int, h binary, t binary", "b int, heads binary, ends binary, codes binary, tails binary"
_LISTS = "root string, ids array<string>"


def _thin(x: np.ndarray, rising: bool = True) -> bytes:
    """Integers by bytes of equal weight, compressed; rising ones by their differences."""
    x = x.astype(np.int64, copy=False)
    x = np.diff(x, prepend=np.int64(0)) if rising else x
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _full(b: bytes, rising: bool = True) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, "zstd"), np.uint8).reshape(8, n)
    x = np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)
    return np.cumsum(x) if rising else x


def _batch(kind: str, *columns) -> pa.RecordBatch:
    names = [c.split()[0] for c in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)


def _scattered(heads: np.ndarray, tails: np.ndarray, by_head: bool, n: int):
    """Parts of n buckets by a hash of the head or the tail, each sorted by head."""
    by = (heads if by_head else tails).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((by >> np.uint64(32)) % np.uint64(n)).astype(np.uint16 if n < 2**16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    for b in np.flatnonzero(np.diff(ends, prepend=0)):
        at = order[ends[b - 1] if b else 0 : ends[b]]
        h, t = heads[at], tails[at]
        at = np.argsort(h)
        yield _batch(_PART, [b], [_thin(h[at])], [_thin(t[at], False)])


def _scatter(pairs: DataFrame, by_head: bool, n: int) -> DataFrame:
    """Parts of blocks of the rows ``(head, tail)``, or of parts ``(h, t)`` as they are found."""
    packed = "h" in pairs.columns

    def run(batches):
        held, rows = [], 0
        for b in batches:
            for h, t in [(_full(r["h"]), _full(r["t"], False)) for r in b.to_pylist()] if packed else [(b["head"].to_numpy(), b["tail"].to_numpy())]:
                held.append((h, t))
                rows += len(h)
                if rows >= ROWS:
                    yield from flush(held)
                    held, rows = [], 0
        if rows:
            yield from flush(held)

    def flush(held):
        yield from _scattered(*(np.concatenate(x) for x in zip(*held)), by_head, n)

    return pairs.select(*(("h", "t") if packed else ("head", "tail"))).mapInArrow(run, _PART)


def _gather(pairs: DataFrame, by_head: bool, n: int) -> DataFrame:
    """The pairs as n blocks by head or tail, each pair once, by head and tail: distinct heads, where the tails of each end,
    and these as places among the distinct tails. Tasks are several to a block and not merged, so that most blocks
    lie in files of their own and are read apart."""

    def run(t: pa.Table) -> pa.Table:
        h = np.concatenate([_full(x.as_py()) for x in t["h"]])
        ends_in = np.concatenate([_full(x.as_py(), False) for x in t["t"]])
        heads, h = np.unique(h, return_inverse=True)
        tails, x = np.unique(ends_in, return_inverse=True)
        key = np.sort(h.astype(np.int64) << 32 | x)
        key = key[np.diff(key, prepend=-1) != 0]
        ends = np.cumsum(np.bincount(key >> 32, minlength=len(heads)))
        return pa.Table.from_batches([_batch(_BLOCK, [t["b"][0].as_py()], [_thin(heads)], [_thin(ends)], [_thin(key & 0xFFFFFFFF, False)], [_thin(tails)])])

    return _scatter(pairs, by_head, n).repartition(3 * n, "b").groupBy("b").applyInArrow(run, _BLOCK)


def _open(row: dict) -> tuple[np.ndarray, ...]:
    return _full(row["heads"]), _full(row["ends"]), _full(row["codes"], False).astype(np.int32), _full(row["tails"])


def _met(pairs: tuple, edges: tuple):
    """Distinct pairs that one step leads to, as places of roots and of targets, a bounded number of walks at a time."""
    roots, ends, codes, ids = pairs
    heads, stops, to, targets = edges
    at = np.minimum(np.searchsorted(heads, ids), len(heads) - 1)
    starts = np.concatenate([[0], stops[:-1]])
    n_id = np.where(heads[at] == ids, stops[at] - starts[at], 0)
    n, first = n_id[codes], starts[at][codes]
    some = n > 0
    n, first, root = n[some], first[some], np.repeat(np.arange(len(roots)), np.diff(ends, prepend=0))[some]
    total = np.concatenate([[0], np.cumsum(n)])
    bits = max(1, int(len(targets) - 1).bit_length())

    def unfold(lo, hi):
        """Where the walks of these pairs lead, and how many each has."""
        c = n[lo:hi]
        return to[np.repeat(first[lo:hi] - (total[lo:hi] - total[lo]), c) + np.arange(total[hi] - total[lo])], c

    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + WALKS, "right")) - 1)
        if hi < len(n):
            hi = int(np.searchsorted(root, root[hi]))  # roots are whole
        if hi > lo:
            t, c = unfold(lo, hi)
            r = root[lo:hi] - root[lo]
            kind = np.uint32 if (int(r[-1]) + 1) << bits <= 2**32 else np.uint64
            key = np.repeat(r.astype(kind) << kind(bits), c) | t.astype(kind)
            key.sort()
            keep = np.empty(len(key), bool)
            keep[:1] = True
            np.not_equal(key[1:], key[:-1], out=keep[1:])
            key = key[keep]
            yield (key >> kind(bits)).astype(np.int64) + root[lo], (key & kind((1 << bits) - 1)).astype(np.int64)
        else:  # one root with more walks than are unfolded at once
            hi = int(np.searchsorted(root, root[lo], "right"))
            seen = np.zeros(len(targets), bool)
            k = lo
            while k < hi:
                m = min(hi, max(k + 1, int(np.searchsorted(total, total[k] + WALKS, "right")) - 1))
                seen[unfold(k, m)[0]] = True
                k = m
            t = np.flatnonzero(seen)
            yield np.full(len(t), root[lo]), t
        lo = hi


def _named(keys: np.ndarray, name: str | None) -> pa.Array:
    """Ids of keys of a type; without a type there is no id."""
    if name is None:
        return pa.nulls(len(keys), pa.string())
    return pc.binary_join_element_wise(name, pc.cast(pa.array(keys), pa.string()), "")


def _lists(roots: pa.Array, r: np.ndarray, ids: pa.Array, t: np.ndarray):
    """Rows ``(root, ids)`` of pairs of places, of which those of a root stand together."""
    change = np.flatnonzero(np.diff(r, prepend=-1))
    starts = np.union1d(change, np.arange(0, len(r), LIST))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(r)), pa.int32()), ids.take(pa.array(t)))
    yield pa.RecordBatch.from_arrays([roots.take(pa.array(r[starts])), lists], ["root", "ids"])


def _unfolded(lists: DataFrame, depth: int) -> DataFrame:
    """``(root, id, depth)``; the JVM unfolds lists with less work than it reads rows from Python."""
    return lists.select("root", F.explode("ids").alias("id"), F.lit(depth).alias("depth"))


def _unpacked(blocks: DataFrame, root_name: str, name: str | None) -> DataFrame:
    """The lists of blocks of pairs."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                roots, ends, codes, ids = _open(row)
                place = np.repeat(np.arange(len(roots)), np.diff(ends, prepend=0))
                roots, ids = _named(roots, root_name), _named(ids, name)
                for lo in range(0, len(codes), WALKS):
                    yield from _lists(roots, place[lo : lo + WALKS], ids, codes[lo : lo + WALKS])

    return blocks.mapInArrow(run, _LISTS)


def _pairs(pairs: tuple, edges: tuple, met):
    """Parts of the pairs that are reached, for another step."""
    for r, t in met:
        yield pa.RecordBatch.from_arrays([pa.array([len(r)], pa.int64()), pa.array([_thin(pairs[0][r])], pa.binary()), pa.array([_thin(edges[3][t], False)], pa.binary())], ["n", "h", "t"])


def _ids(root_name: str, name: str | None):
    """Lists of what is reached."""

    def use(pairs, edges, met):
        roots, ids = _named(pairs[0], root_name), _named(edges[3], name)
        for r, t in met:
            yield from _lists(roots, r, ids, t)

    return use


def _step(pairs: DataFrame, edges: DataFrame, kind: str, use) -> DataFrame:
    """What ``use(pairs, edges, met)`` makes of the distinct pairs that every two blocks lead to."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                p, e = _open({k[2:]: v for k, v in row.items() if k[0] == "p"}), _open({k[2:]: v for k, v in row.items() if k[0] == "e"})
                yield from use(p, e, _met(p, e))

    names = ("heads", "ends", "codes", "tails")
    both = pairs.select(*(F.col(c).alias(f"p_{c}") for c in names)).crossJoin(edges.select(*(F.col(c).alias(f"e_{c}") for c in names)))
    return both.mapInArrow(run, kind)


def _blocks(spark, n: int, most: int) -> int:
    """Blocks for n pairs: by their size, or where that makes few, as many as keep the cores busy."""
    return max(-(-n // most), min(spark.sparkContext.defaultParallelism, -(-n // 10_000)))


def lineage(layers: list[tuple[str, str, DataFrame]], roots: DataFrame, root_type: str, depth: int, scratch: Scratch) -> DataFrame:
    """``(root, id, depth)`` of directed walks of 1..depth steps (at most 5) from each root ``(key)``.

    ``layers`` are edges ``(head, tail)`` from one type of nodes to another, ``(type, type, edges)``; keys are integers,
    and an id is the type and the key. A tail that is null is reached as a null id. An edge may be there more than once.
    """

    def whole(df, *columns):
        odd = [c for c in columns if df.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long")]
        if odd:
            raise TypeError(f"keys must be integers: {odd}")
        return df.select(*(F.col(c).cast("long").alias(c) for c in columns))

    steps = []
    for a, b, e in layers:
        e = whole(e, "head", "tail")
        odd = e.where("head is not null and tail is null").select("head", F.lit(0).cast("long").alias("tail"))
        # both counts are read from the footers of parquet files where these tell
        n, odd_n = e.count(), odd.count()
        steps += [(a, b, e.where("head is not null and tail is not null"), n)] if n > odd_n else []
        steps += [(a, None, odd, odd_n)] if odd_n else []
    start = whole(roots, "key").where("key is not null").select(F.col("key").alias("head"), F.col("key").alias("tail"))
    count = start.count()
    at = {root_type: scratch.keep(_gather(start, True, _blocks(scratch.spark, count, PAIRS)))} if count else {}
    out = []
    most = min(max(depth, 1), 5)
    for d in range(1, most + 1):
        ways = [s for s in steps if s[0] in at]
        reached = {}
        for a, b, e, n in ways:
            edges = scratch.keep(_gather(e, False, -(-n // EDGES)))
            if d == most and sum(w[1] == b for w in ways) == 1:
                out.append(_unfolded(_step(at[a], edges, _LISTS, _ids(f"{root_type}:", b and f"{b}:")), d))
            else:
                reached.setdefault(b, []).append(scratch.keep(_step(at[a], edges, "n long, h binary, t binary", _pairs)))
                scratch.drop(edges)
        at = {}
        for b, parts in reached.items():
            found = reduce(DataFrame.unionByName, parts)
            count = found.agg(F.sum("n")).first()[0]
            if count:
                at[b] = scratch.keep(_gather(found, True, _blocks(scratch.spark, count, PAIRS)))
            for p in parts:
                scratch.drop(p)
        for b in at:
            out.append(_unfolded(_unpacked(at[b], f"{root_type}:", b and f"{b}:"), d))
    none = scratch.spark.createDataFrame([], "root string, id string, depth int")
    return reduce(DataFrame.unionByName, out) if out else none
