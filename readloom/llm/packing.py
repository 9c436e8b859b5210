"""Containers of fixed capacity, filled by best-fit decreasing and certified by lower bounds.

Documents are spread over partitions of bounded size. Each partition packs its documents best-fit decreasing and
computes a lower bound of its container count from dual-feasible functions. A partition whose count meets the bound is
certified: no packing of its documents needs fewer. One with a gap packs again, container by container to the brim; if
the gap stays it gives up the documents of its containers that are not full. Those are exchanged with other partitions
and packed again, in fewer partitions each round, until no gap is left or a round saves nothing. Every round leaves a
certificate per partition, and the sizes of all documents give one bound for the whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.plans.runtime import materialize, n_shuffle

CAPACITY = 2048
#: Documents one packing task holds; the number of partitions follows from it, so a task never grows with the data.
PER_PARTITION = 20_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item (sizes must be descending) and the free space of each container.

    Open containers are kept by free space; a bit set over the free spaces finds the tightest fit in one step.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, free = 0, []
    where = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fit = bits >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                bits &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(0)
        room -= s
        free[b] = room
        if room:
            stacks[room].append(b)
            bits |= 1 << room
        where[i] = b
    return where, np.array(free, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int, ks: int = 12) -> int:
    """Containers that any packing needs: the best of a family of dual-feasible functions.

    The first kind, for k = 1, 2, …, maps x (a share of the capacity) to x if (k + 1) x is whole, else to
    floor((k + 1) x) / k. The second, for each threshold e up to a half, drops items below e and counts items above
    1 - e as whole containers. Their composition is dual feasible as well.
    """
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity, ks)


def bound_of_counts(count: np.ndarray, capacity: int, ks: int = 12) -> int:
    """:func:`lower_bound` of items of which there are ``count[s]`` of size s."""
    if not count.any():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    eps = np.unique(np.concatenate([[0], np.flatnonzero(count[: capacity // 2 + 1])]))
    for k in range(0, ks + 1):
        if k:  # values in units of 1 / (k * capacity)
            y = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
            unit = k * capacity
        else:
            y, unit = x, capacity
        mass = np.concatenate([[0], np.cumsum(count * y)])  # of sizes below an index
        many = np.concatenate([[0], np.cumsum(count)])
        # sizes > capacity - e count whole, sizes from e to capacity - e by y, smaller ones not at all
        whole = many[capacity + 1] - many[capacity - eps + 1]
        mid = mass[capacity - eps + 1] - mass[eps]
        best = max(best, int(np.max(whole + -(-mid // unit))))
    return best


def fill_to_the_brim(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`best_fit_decreasing`, but container after container: the largest item left, then the set of others
    that leaves least room, large ones first. Reachable sums are a bit set."""
    items: dict[int, list[int]] = {}
    for i, s in enumerate(sizes.tolist()):
        items.setdefault(s, []).append(i)
    order = sorted(items, reverse=True)
    where, free = np.empty(len(sizes), np.int64), []
    while order:
        room = capacity - order[0]
        chosen = [items[order[0]].pop()]
        bits, stages, mask = 1, [], (1 << (room + 1)) - 1
        for s in order:
            if s > room or not items[s]:
                continue
            stages.append((s, bits))
            left, k = min(len(items[s]), room // s), 1
            while left:  # 1, 2, 4, … copies at once
                k = min(k, left)
                bits |= (bits << (k * s)) & mask
                left -= k
                k *= 2
            if bits >> room:
                break
        at = bits.bit_length() - 1
        room -= at
        for s, was in reversed(stages):
            while not was >> at & 1:
                at -= s
                chosen.append(items[s].pop())
        where[chosen] = len(free)
        free.append(room)
        order = [s for s in order if items[s]]
    return where, np.array(free, np.int64)


def _pack(round_no: int, capacity: int, last: bool):
    def run(t: pa.Table) -> pa.Table:
        size = t.column("size").to_numpy()
        order = np.lexsort((t.column("piece_no").to_numpy(), t.column("doc").to_numpy(), -size))
        bound = lower_bound(size, capacity)
        placed, free = best_fit_decreasing(size[order], capacity)
        if len(free) > bound:
            again = fill_to_the_brim(size[order], capacity)
            if len(again[1]) < len(free):
                placed, free = again
        where = np.empty(len(size), np.int64)
        where[order] = placed
        part = t.column("part")[0].as_py()
        # A certified partition only offers containers less than half full; one with a gap offers all that are not full.
        given = np.zeros(len(free), bool) if last else free > (capacity // 2 if len(free) <= bound else 0)
        names = np.array([f"r{round_no}p{part}b{i}" for i in range(len(free))], object)
        n = len(size)
        return pa.table({
            "doc": t.column("doc"), "piece_no": t.column("piece_no"), "ids_from": t.column("ids_from"), "size": t.column("size"),
            "container_id": pa.array(names[where], pa.string()), "open": pa.array(given[where]),
            "part": t.column("part"), "n_bins": pa.array(np.full(n, len(free))), "n_given": pa.array(np.full(n, given.sum())), "bound": pa.array(np.full(n, bound)),
        })

    return run


_SCHEMA = "doc bigint, piece_no int, ids_from bigint, size bigint, container_id string, open boolean, part int, n_bins bigint, n_given bigint, bound bigint"


def pack(sizes: DataFrame, id_col: str = "doc_id", n_col: str = "n_ids", capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """``id, piece_no, container_id, ids_from, n_ids`` for every document with a size of 1 or more.

    A document over the capacity fills containers of its own and leaves its remainder as one more item; others are
    never split. Documents with size null or 0 get no container. Order does not matter: ties go by id, so the same table
    packs the same way. ``id`` is a unique BIGINT. An empty table gives no rows.
    """
    return pack_certified(sizes, id_col, n_col, capacity, per_partition)[0]


def pack_certified(sizes: DataFrame, id_col: str = "doc_id", n_col: str = "n_ids", capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> tuple[DataFrame, DataFrame, int]:
    """What :func:`pack` gives, the certificates, and the containers that any packing of all documents needs.

    A certificate, ``round_no, part, n_items, n_bins, n_given, bound, certified``, says how many containers a partition
    made, how many of them it gave up for the next round, and how many its items need at least.
    """
    base = materialize(sizes.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{n_col}`").cast("bigint").alias("size")).where("size > 0"))
    full = base.where(F.col("size") >= capacity).select("doc", "size", F.explode(F.expr(f"sequence(0L, size div {capacity} - 1)")).alias("piece_no"))
    full = full.select("doc", F.col("piece_no").cast("int").alias("piece_no"), F.concat(F.lit("d"), "doc", F.lit("n"), "piece_no").alias("container_id"), (F.col("piece_no") * capacity).alias("ids_from"), F.lit(capacity).cast("bigint").alias("size"))
    item = base.where(F.col("size") % capacity > 0).select("doc", F.expr(f"cast(size div {capacity} as int)").alias("piece_no"), F.expr(f"size div {capacity} * {capacity}").alias("ids_from"), (F.col("size") % capacity).alias("size"))
    # Sizes are at most as many as the capacity: one bound for all documents.
    by_size = np.zeros(capacity + 1, np.int64)
    for row in item.groupBy("size").agg(F.count("*").alias("k")).collect():
        by_size[row["size"]] = row.k
    whole = base.agg(F.sum(F.expr(f"size div {capacity}")).alias("k")).first().k or 0
    bound = bound_of_counts(by_size, capacity) + whole
    done, todo, n, r, sheets = [full], item, int(by_size.sum()), 0, []
    before = None
    while n:
        parts = max(1, -(-n // per_partition))
        last = parts == 1 or (before is not None and n >= before)
        spread = F.pmod(F.xxhash64(F.lit(r), "doc", "piece_no"), F.lit(parts)).cast("int")
        # A number of its own, so that partitions of few bytes but much work are not put together into one task.
        placed = todo.withColumn("part", spread).repartition(min(parts, n_shuffle(base.sparkSession)), "part")
        packed = materialize(placed.groupBy("part").applyInArrow(_pack(r, capacity, last), _SCHEMA))
        sheet = packed.groupBy("part").agg(F.count("*").alias("n_items"), F.first("n_bins").alias("n_bins"), F.first("n_given").alias("n_given"), F.first("bound").alias("bound"))
        sheets.append(sheet.select(F.lit(r).alias("round_no"), "*", (F.col("n_bins") <= F.col("bound")).alias("certified")))
        done.append(packed.where("not open").select("doc", "piece_no", "container_id", "ids_from", "size"))
        todo = packed.where("open").select("doc", "piece_no", "ids_from", "size")
        before, n, r = n, 0 if last else todo.count(), r + 1
    out = reduce(DataFrame.unionByName, done).select(F.col("doc").alias(id_col), "piece_no", "container_id", "ids_from", F.col("size").alias(n_col))
    none = base.sparkSession.createDataFrame([], "round_no int, part int, n_items bigint, n_bins bigint, n_given bigint, bound bigint, certified boolean")
    return out, reduce(DataFrame.unionByName, sheets) if sheets else none, int(bound)
