"""Per-key results when a few keys hold most rows.

Keys never decide where a row is processed. Each input split dictionary-encodes its own keys and adds every row
into dense arrays (``numpy.bincount`` and scatter-reduce), so that the work of a task depends on the size of its
split alone. The arrays then leave the split cut into key blocks, and a distributed reduction adds the arrays of a
block as a tree: no task adds up more than a fixed number of them, however many splits there are. A key that holds a third of all rows costs one array
slot per split, like any other key.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.plans.runtime import n_shuffle

#: Keys a split holds before it hands its arrays on; handing on early costs rows, never results.
FLUSH_KEYS = 200_000
_LO, _HI = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_PARTIAL = (
    "block int, part int, keys array<string>, rows array<bigint>, "
    "counts array<array<bigint>>, sums array<array<bigint>>, mins array<array<bigint>>, maxs array<array<bigint>>"
)


class _Dense:
    """Growing dense accumulators: one slot per key, one row per measure."""

    def __init__(self, m: int):
        self.m, self.slots = m, {}
        self._alloc(1024)

    def _alloc(self, n: int) -> None:
        old = getattr(self, "rows", None)
        fresh = {
            "rows": np.zeros(n, np.int64),
            "counts": np.zeros((self.m, n), np.int64),
            "sums": np.zeros((self.m, n), np.int64),
            "mins": np.full((self.m, n), _HI, np.int64),
            "maxs": np.full((self.m, n), _LO, np.int64),
        }
        for k, v in fresh.items():
            if old is not None:
                v[..., : len(old)] = getattr(self, k)
            setattr(self, k, v)

    def codes(self, keys: list) -> np.ndarray:
        out = np.fromiter((self.slots.setdefault(k, len(self.slots)) for k in keys), np.int64, len(keys))
        while len(self.slots) > len(self.rows):
            self._alloc(2 * len(self.rows))
        return out

    def add_batch(self, key: pa.Array, values: list[pa.Array]) -> None:
        enc = key.dictionary_encode(null_encoding="encode")
        local = enc.indices.to_numpy(zero_copy_only=False)
        k = len(enc.dictionary)
        slot = self.codes(enc.dictionary.to_pylist())
        self.rows[slot] += np.bincount(local, minlength=k)
        for i, v in enumerate(values):
            ok = pc.is_valid(v).to_numpy(zero_copy_only=False)
            at, x = local[ok], pc.drop_null(v).cast(pa.int64()).to_numpy(zero_copy_only=False)
            s, lo, hi = np.zeros(k, np.int64), np.full(k, _HI), np.full(k, _LO)
            np.add.at(s, at, x)
            np.minimum.at(lo, at, x)
            np.maximum.at(hi, at, x)
            self.counts[i, slot] += np.bincount(at, minlength=k)
            self.sums[i, slot] += s
            self.mins[i, slot] = np.minimum(self.mins[i, slot], lo)
            self.maxs[i, slot] = np.maximum(self.maxs[i, slot], hi)

    def blocks(self, part: int, n_blocks: int):
        keys = list(self.slots)
        where = np.fromiter(((zlib.crc32(k.encode()) if k is not None else 0) % n_blocks for k in keys), np.int64, len(keys))
        for b in np.unique(where):
            at = np.flatnonzero(where == b)
            many = lambda x: [r[at].tolist() for r in x]  # noqa: E731, B023
            yield {
                "block": int(b), "part": part, "keys": [keys[i] for i in at], "rows": self.rows[at].tolist(),
                "counts": many(self.counts), "sums": many(self.sums), "mins": many(self.mins), "maxs": many(self.maxs),
            }

    def merge(self, table: pa.Table) -> None:
        for t in table.to_batches():
            col = {n: t.column(n) for n in t.schema.names}
            enc = col["keys"].flatten().dictionary_encode(null_encoding="encode")
            slot = self.codes(enc.dictionary.to_pylist())[enc.indices.to_numpy()]
            np.add.at(self.rows, slot, col["rows"].flatten().to_numpy())
            n = col["keys"].value_lengths().to_numpy()
            size, first = np.repeat(n, n), np.repeat(np.cumsum(n) - n, n)
            for i in range(self.m):  # a row holds one list of its keys' numbers per measure
                at = self.m * first + i * size + np.arange(len(size)) - first
                many = lambda c: col[c].flatten().flatten().to_numpy()[at]  # noqa: E731, B023
                np.add.at(self.counts[i], slot, many("counts"))
                np.add.at(self.sums[i], slot, many("sums"))
                np.minimum.at(self.mins[i], slot, many("mins"))
                np.maximum.at(self.maxs[i], slot, many("maxs"))


def key_profile(df: DataFrame, key: str, measures: list[str], n_blocks: int | None = None, fan_in: int = 64) -> DataFrame:
    """One row per value of ``key``: ``key_value, n_rows`` and, per measure m, ``m_count, m_sum, m_min, m_max``.

    ``key`` is read as a string and each measure as a BIGINT. Null is a key like any other and comes out as a null
    ``key_value``; the empty string is its own key. Null measures count in ``n_rows`` only; a key whose measures are
    all null gets count 0 and null sum, min and max. Repeated rows count each time they occur. An empty table gives
    no rows. ``fan_in`` bounds how many splits one reduction task adds up at once.
    """
    m = len(measures)
    blocks = n_blocks or max(1, n_shuffle(df.sparkSession))
    cols = [F.col(f"`{key}`").cast("string").alias("k"), *(F.col(f"`{x}`").cast("bigint").alias(f"v{i}") for i, x in enumerate(measures))]
    schema = pa.schema(
        [("block", pa.int32()), ("part", pa.int32()), ("keys", pa.list_(pa.string())), ("rows", pa.list_(pa.int64()))]
        + [(c, pa.list_(pa.list_(pa.int64()))) for c in ("counts", "sums", "mins", "maxs")]
    )

    def split(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        acc = _Dense(m)
        for b in batches:
            acc.add_batch(b.column(0), [b.column(1 + i) for i in range(m)])
            if len(acc.slots) > FLUSH_KEYS:
                yield pa.RecordBatch.from_pylist(list(acc.blocks(part, blocks)), schema)
                acc = _Dense(m)
        if acc.slots:
            yield pa.RecordBatch.from_pylist(list(acc.blocks(part, blocks)), schema)

    def reduce_group(t: pa.Table) -> pa.Table:
        acc = _Dense(m)
        acc.merge(t)
        row = next(acc.blocks(t.column("part")[0].as_py() // fan_in, 1))
        return pa.Table.from_pylist([row | {"block": t.column("block")[0].as_py()}], schema)

    flat = [("key_value", pa.string()), ("n_rows", pa.int64())]
    for x in measures:
        flat += [(f"{x}_{s}", pa.int64()) for s in ("count", "sum", "min", "max")]

    def final(t: pa.Table) -> pa.Table:
        acc = _Dense(m)
        acc.merge(t)
        n = len(acc.slots)
        out = [pa.array(list(acc.slots), pa.string()), pa.array(acc.rows[:n])]
        for i in range(m):
            none = acc.counts[i, :n] == 0
            out += [pa.array(acc.counts[i, :n])] + [pa.array(x[i, :n], mask=none) for x in (acc.sums, acc.mins, acc.maxs)]
        return pa.Table.from_arrays(out, schema=pa.schema(flat))

    rows = df.select(*cols)
    partial, parts = rows.mapInArrow(split, _PARTIAL), rows.rdd.getNumPartitions()
    while parts > fan_in:
        partial = partial.groupBy("block", F.expr(f"part div {fan_in}")).applyInArrow(reduce_group, _PARTIAL)
        parts = -(-parts // fan_in)
    return partial.groupBy("block").applyInArrow(final, ", ".join(f"`{n}` {'string' if t == pa.string() else 'bigint'}" for n, t in flat))


def heavy_keys(profile: DataFrame, share_num: int, share_den: int, no_keys: tuple[str, ...] = ()) -> DataFrame:
    """Keys of a profile with ``field_name`` that hold at least ``share_num / share_den`` of their field's rows.

    Null and the values of ``no_keys`` are never keys, yet their rows are in the total. Ties need no rule: every key
    at or over the share comes out. The totals are one row per field and joined on it.
    """
    total = profile.groupBy("field_name").agg(F.sum("n_rows").alias("_total"))
    hit = profile.where(F.col("key_value").isNotNull() & ~F.col("key_value").isin(*no_keys)) if no_keys else profile.where("key_value is not null")
    return hit.join(total, "field_name").where(F.col("n_rows") * share_den >= F.col("_total") * share_num).drop("_total")
