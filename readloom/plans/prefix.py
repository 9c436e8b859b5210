"""Scans in the order of all rows, without a task that sees them all.

Rows are range-sorted over all partitions and scanned once inside their partition, where they lie in order: a running sum
or a running maximum per group, and the place of the row before. A group that crosses a partition border needs what the
partitions before it found; there are fewer such groups than partitions, so these carries are broadcast. The rows
themselves move once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from readloom.plans.runtime import materialize, n_shuffle


def _new_group(cols: list[pa.Array], n: int) -> np.ndarray:
    """Where a row's group is not that of the row before; null is a group like any other."""
    new = np.zeros(n, bool)
    for c in cols:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def scan(df: DataFrame, group: list[str], order: list[str], value: str, kind: str = "sum", prev: str | None = None) -> DataFrame:
    """``df`` written in order, with ``_pid``, the partition; ``_scan``, per group and partition the sum of the BIGINT
    ``value`` up to the row, or with ``kind='max'`` its largest before the row (null if there is none); and ``_prev``, the
    BIGINT column ``prev`` of the row before (null if there is none)."""
    x = df.repartitionByRange(n_shuffle(df.sparkSession), *group, *order).sortWithinPartitions(*group, *order)
    names = x.columns
    g, v = [names.index(c) for c in group], names.index(value)
    p = names.index(prev) if prev else None

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        key, acc, before = None, 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = _new_group([b.column(i) for i in g], n)
            new[0] = key is None or key != tuple(b.column(i)[0].as_py() for i in g)
            key = tuple(b.column(i)[n - 1].as_py() for i in g)
            x = pc.fill_null(b.column(v).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            seg = np.cumsum(new)
            if kind == "sum":
                c = np.cumsum(x)
                start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
                out = c - (c - x)[start] + np.where(seg == 0, acc, 0)
                acc, out = int(out[-1]), pa.array(out)
            else:
                best = pd.Series(x).groupby(seg).cummax().to_numpy()
                best = np.where(seg == 0, np.maximum(best, acc), best)
                out = pa.array(np.concatenate([[acc], best[:-1]]), pa.int64(), mask=new)
                acc = int(best[-1])
            last = pa.nulls(n, pa.int64())
            if p is not None:
                at = b.column(p).cast(pa.int64())
                last = pc.if_else(pa.array(~new), pa.concat_arrays([pa.array([before], pa.int64()), at.slice(0, n - 1)]), pa.scalar(None, pa.int64()))
                before = at[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, np.int32)), out, last], names=[*names, "_pid", "_scan", "_prev"])

    schema = t.StructType([*x.schema.fields, t.StructField("_pid", t.IntegerType()), t.StructField("_scan", t.LongType()), t.StructField("_prev", t.LongType())])
    return materialize(x.mapInArrow(run, schema))


def carried(rows: DataFrame, group: list[str], **aggregates: Column) -> DataFrame:
    """``rows`` of :func:`scan` with what the partitions before hold of the row's group: for each name an aggregate over
    the partitions before of the same aggregate within a partition, null where there is none.

    An aggregate is a function of a column, such as ``(F.max, 't')``.
    """
    part = rows.groupBy("_pid", *(F.col(f"`{c}`") for c in group)).agg(*(f(c).alias(n) for n, (f, c) in aggregates.items()))
    w = Window.partitionBy(*(F.col(f"`{c}`") for c in group) if group else [F.lit(0)]).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(F.col("_pid").alias("_q"), *(F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group)), F.count("*").over(w).alias("_many"), *(f(n).over(w).alias(n) for n, (f, _) in aggregates.items())).where("_many > 0").drop("_many")
    on = F.col("_pid") == F.col("_q")
    for i, c in enumerate(group):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    # At most one row per partition: only the first group of a partition began before it.
    return rows.join(F.broadcast(carry), on, "left").drop("_q", *(f"_g{i}" for i in range(len(group))))


def running_sum(df: DataFrame, order: list[str], value: str, group: list[str] | None = None) -> DataFrame:
    """``df`` with ``upto``, the sum of ``value`` over its group's rows up to this one by ``order``, and ``total``. Null is
    a group like any other; ties in ``order`` are summed in no set order."""
    group = group or []
    r = scan(df, group, order, value)
    x = carried(r, group, _before=(F.sum, value)).withColumn("upto", F.coalesce("_before", F.lit(0)) + F.col("_scan"))
    if group:
        every = r.groupBy(*(F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group))).agg(F.sum(value).alias("total"))
        on = [F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
        x = x.join(every, on).drop(*(f"_g{i}" for i in range(len(group))))
    else:
        x = x.withColumn("total", F.lit(r.agg(F.sum(value)).first()[0]).cast("bigint"))
    return x.drop("_pid", "_scan", "_prev", "_before")
