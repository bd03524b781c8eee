"""Exact dense search in blocks, and what searches share: packed vectors, the best of a block, merged lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of the stored rows and of the queries that meet in one task at most.
GROUP_NUMBERS, QUERY_NUMBERS = 65_536 * 64, 131_072 * 64
#: Numbers of a block of similarities.
BLOCK = 4_000_000


def usable(vector: Column, dims: int) -> Column:
    """Of ``dims`` finite numbers, not all zero."""
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array, dims: int) -> np.ndarray:
    """The unit vectors of a column of usable ones."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes of their own precision."""
    return binary(np.ascontiguousarray(x), np.arange(0, len(x) + 1) * (x.shape[1] * x.itemsize))


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``data`` between the offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def joined_bytes(column: pa.Array | pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(joined_bytes(column), kind).reshape(len(column), -1)


def kth_bound(sims: np.ndarray, k: int, group: int = 16) -> np.ndarray:
    """A lower bound of each row's k-th largest number: that of the maxima of groups of columns. Rows of
    fewer than k numbers have none."""
    if sims.shape[1] < k:
        return np.full(len(sims), -np.inf, sims.dtype)
    whole = sims.shape[1] // group * group
    if whole // group > 4 * k:
        sims = np.concatenate([sims[:, :whole].reshape(len(sims), -1, group).max(2), sims[:, whole:]], axis=1)
    return -np.partition(-sims, k - 1, axis=1)[:, k - 1]


class Best:
    """The k best candidates of each of ``size`` queries, kept while blocks of similarities come in."""

    def __init__(self, size: int, k: int, least: float = -np.inf) -> None:
        self.k, self.bound = k, np.full(size, least - 2e-6)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = self.pruned = 0

    def add(self, queries: np.ndarray, ids: np.ndarray, sims: np.ndarray, tighten: bool) -> None:
        """Take in sims (queries x ids); ``tighten`` finds the k-th best of the block first."""
        bound = self.bound[queries]
        if tighten:
            bound = np.maximum(bound, kth_bound(sims, self.k) - 2e-6)
        r, c = np.nonzero(sims >= bound[:, None].astype(sims.dtype))
        self.add_pairs(queries[r], ids[c], sims[r, c].astype(np.float64))

    def add_pairs(self, queries: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Take in a similarity of each (query, id)."""
        self.held.append((queries, ids, np.round(sims, 6)))  # ties are then the same on every machine
        self.count += len(queries)
        if self.count > 2 * self.k * len(self.bound) + BLOCK // 4:
            self.prune()

    def prune(self) -> None:
        if not self.held:
            self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        q, other, value = (np.concatenate(z) for z in zip(*self.held, strict=True))
        kept, q, other, value, place = ranked(q, other, value, self.k)
        self.held, self.count, self.pruned = [(q, other, value)], len(q), len(q)
        last = place == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], value[last] - 2e-6)

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, similarity), best first."""
        self.prune()
        return self.held[0]


def ranked(q: np.ndarray, other: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(order, q, other, value, place) of the k best per query, ties by id, impossible ones (-inf) left out."""
    order = np.lexsort((other, -value, q))
    order = order[np.isfinite(value[order])]
    q = q[order]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    start = np.flatnonzero(new)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    kept = place < k
    order = order[kept]
    return order, q[kept], other[order], value[order], place[kept]


#: What a task returns of a query: its best candidates there.
FOUND = "id bigint, near binary"
CANDIDATE = np.dtype([("sim", "<f8"), ("id", "<i8")])


def found_rows(ids: np.ndarray, q: np.ndarray, other: np.ndarray, value: np.ndarray) -> pa.Table:
    """Rows of FOUND of candidates that stand in order of ``q``, an index into ``ids``."""
    asking, start = np.unique(q, return_index=True)
    near = np.empty(len(q), CANDIDATE)
    near["sim"], near["id"] = value, other
    return pa.table({"id": pa.array(ids[asking], pa.int64()), "near": binary(near, np.append(start, len(q)) * CANDIDATE.itemsize)})


def merged(found: DataFrame, k: int) -> DataFrame:
    """(id, rk, other, score): the k best of each id's candidates from all tasks. They are sorted by id, and
    one batch after the other is merged, so a task holds one batch."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            raw = batch["near"].to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // CANDIDATE.itemsize
            near = np.frombuffer(b"".join(raw), CANDIDATE)
            now = (np.repeat(batch["id"].to_numpy(), sizes), near["id"], near["sim"])
            if held is not None:
                now = tuple(np.concatenate(z) for z in zip(held, now, strict=True))
            if not len(now[0]):
                held = None
                continue
            open_ = now[0] == now[0][-1]  # its rows may go on in the next batch
            done = tuple(z[~open_] for z in now)
            held = tuple(z[open_] for z in now)
            if len(held[0]) > 64 * k:
                held = ranked(*held, k)[1:4]
            if len(done[0]):
                yield rows(done)
        if held is not None and len(held[0]):
            yield rows(held)

    def rows(some: tuple) -> pa.RecordBatch:
        _, q, other, value, place = ranked(*some, k)
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array((place + 1).astype(np.int32)), pa.array(other), pa.array(value)], names=["id", "rk", "other", "score"])

    return found.repartition("id").sortWithinPartitions("id").mapInArrow(merge, "id bigint, rk int, other bigint, score double")


def with_units(rows: DataFrame, id_col: str, vector: Column, dims: int) -> DataFrame:
    """(id, v): usable vectors as unit vectors in double precision, packed."""
    base = rows.where(usable(vector, dims)).select(F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v")).where("id is not null")

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["id"], packed(unit_rows(batch["v"], dims))], names=["id", "v"])

    return base.mapInArrow(pack, "id bigint, v binary")


def exact_nearest(stored: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    """(q_id, id, rk, score) from 1: the k best cosines of each query over all stored rows but itself,
    ties by id. Both have (id, v) of with_units; every block of queries meets every block of rows."""
    groups, blocks = max(1, -(-stored.count() * dims // GROUP_NUMBERS)), max(1, -(-queries.count() * dims // QUERY_NUMBERS))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = stored.select("id", "v", own(groups).alias("g"), F.lit(0).alias("kind"), all_(blocks).alias("q")).unionByName(
        queries.select("id", "v", all_(groups).alias("g"), F.lit(1).alias("kind"), own(blocks).alias("q"))
    )

    def compare(table: pa.Table) -> pa.Table:
        kind, ids = table["kind"].to_numpy(), table["id"].to_numpy()
        s, q = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        x = unpacked(table["v"], np.float64)
        best = Best(len(q), k)
        if len(s) and len(q):
            xs = x[s]
            step = max(1, BLOCK // len(s))
            for at in range(0, len(q), step):
                mine = np.arange(at, min(at + step, len(q)))
                sims = x[q[mine]] @ xs.T
                sims[ids[q[mine]][:, None] == ids[s][None, :]] = -np.inf
                best.add(mine, ids[s], sims, True)
        return found_rows(ids[q], *best.lists())

    near = merged(both.groupBy("g", "q").applyInArrow(compare, FOUND), k)
    return near.select(F.col("id").alias("q_id"), F.col("other").alias("id"), "rk", "score")
