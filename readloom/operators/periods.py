"""Continuous periods and gaps of overlapping intervals, without a task per entity.

Rows are range-sorted over all partitions by entity and start. A partition is summarised by the largest end of each
entity in it; a prefix over these summaries tells each partition the largest end seen before it. Only entities that
cross a partition border have such a carry, hence there are fewer carries than partitions, and they are broadcast.
A rescan with the carried end then marks the rows that open a period. No step gathers all rows of an entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.plans.prefix import carried, scan
from readloom.plans.runtime import materialize


def opened_periods(df: DataFrame, entity: list[str], start: str, end: str, join_touching: bool = True) -> DataFrame:
    """The rows that open a period: ``entity…, _start, _before, _end``.

    ``_before`` is the largest end of the entity before the row (null for its first period), ``_end`` the end of the
    period the row opens. Rows with a null bound or with start after end cover nothing and are left out; null is an
    entity value like any other; repeated and nested rows change nothing.
    """
    e = [f"e{i}" for i in range(len(entity))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(entity, e)), F.col(f"`{start}`").cast("bigint").alias("s"), F.col(f"`{end}`").cast("bigint").alias("t")).where("s <= t")
    placed = scan(rows, e, ["s", "t"], "t", kind="max")
    # Largest end per entity and partition; the carry is what earlier partitions hold of an entity that crosses a border.
    sums = placed.groupBy(F.col("_pid").alias("pid"), *e).agg(F.max("t").alias("mx"))
    marked = carried(placed, e, _carry=(F.max, "t")).withColumn("before", F.greatest("_scan", "_carry"))
    slack = 1 if join_touching else 0
    opens = marked.where(F.col("before").isNull() | (F.col("s") > F.col("before") + slack)).select(F.col("_pid").alias("pid"), *e, "s", "before")
    opens = materialize(opens)

    # The end of a period is what is known just before the next one opens, here or in a later partition.
    nxt = Window.partitionBy("pid", *e).orderBy("s")
    firsts = opens.groupBy("pid", *e).agg(F.min("before").alias("mn"))
    pieces = sums.alias("a").join(firsts.alias("b"), (F.col("a.pid") == F.col("b.pid")) & _same("a", "b", e), "left").select("a.*", "b.mn")
    later = Window.partitionBy(*e).orderBy("pid").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy(*e)
    ends = pieces.select("pid", *e, F.coalesce(F.min("mn").over(later), F.max("mx").over(every)).alias("tail"))
    o, d = opens.withColumn("here", F.lead("before").over(nxt)).alias("o"), ends.alias("d")
    joined = o.join(d, (F.col("o.pid") == F.col("d.pid")) & _same("o", "d", e))
    out = [F.col(f"o.{n}").alias(x) for n, x in zip(e, entity)]
    return joined.select(*out, F.col("o.s").alias("_start"), F.col("o.before").alias("_before"), F.coalesce("o.here", "d.tail").alias("_end"))


def _same(a: str, b: str, cols: list[str]):
    cond = F.lit(True)
    for x in cols:
        cond = cond & F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}"))
    return cond


def periods(df: DataFrame, entity: list[str], start: str, end: str, join_touching: bool = True) -> DataFrame:
    """Continuous periods: ``entity…, period_start, period_end``; both bounds inclusive.

    Touching intervals (end + 1 = next start) form one period unless ``join_touching`` is false. See
    :func:`opened_periods` for nulls and reversed bounds; an empty table gives no rows.
    """
    return opened_periods(df, entity, start, end, join_touching).select(*(F.col(f"`{c}`") for c in entity), F.col("_start").alias("period_start"), F.col("_end").alias("period_end"))


def gaps(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """Longest uncovered runs between an entity's first start and last end: ``entity…, gap_start, gap_end``."""
    o = opened_periods(df, entity, start, end).where("_before is not null")
    return o.select(*(F.col(f"`{c}`") for c in entity), (F.col("_before") + 1).alias("gap_start"), (F.col("_start") - 1).alias("gap_end"))
