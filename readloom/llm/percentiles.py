"""Percentiles per group from group-value counts, with a stated error and mergeable state.

The state is a table of counts per group and value bucket: adding the tables of two days or partitions gives the table
of both, so merging is a sum and loses nothing. Buckets are exact below ``2 ** SIG_BITS`` and as wide as needed above
to keep SIG_BITS significant bits; the state of a group is bounded by the number of buckets (under 55,000), not by its
rows. Percentiles come from cumulative frequencies: the counts are range-sorted by group and bucket over all
partitions, running sums within a partition are shifted by the sums of the partitions before it, and the first bucket
that reaches the target rank is picked. A group with a third of all rows is one more run of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.plans.runtime import materialize, n_shuffle

#: Significant bits kept of a value: exact below 2,048, else off by at most 1 in 4,096 (half a bucket).
SIG_BITS = 11
PERCENTILES = (1, 25, 50, 75, 95, 99)


def _width(v: Column, bits: int) -> Column:
    """Bucket width of a value, a power of two; 1 where the value is exact."""
    one = F.lit(1).cast("bigint")
    return F.when(v < (1 << bits), one).otherwise(F.call_function("shiftleft", one, F.length(F.bin(v)) - bits))


def bucket(v: Column, bits: int = SIG_BITS) -> Column:
    """Lower bound of the bucket of a value from 0 on."""
    return v - v % _width(v, bits)


def value_counts(df: DataFrame, groups: list[str], metrics: dict[str, Column], once: str | None = None, bits: int = SIG_BITS) -> DataFrame:
    """The mergeable state: ``groups…, metric, bucket, cnt``.

    ``metrics`` are non-negative BIGINT expressions, null for "none". With ``once`` rows of one id count once (the
    same content is assumed; a null id counts every time). Null is a group value like any other. An empty table or a
    metric without values gives no rows.
    """
    names = list(metrics)
    x = df.select(*(F.col(f"`{g}`") for g in groups), *(e.cast("bigint").alias(f"m{i}") for i, e in enumerate(metrics.values())), *([F.col(f"`{once}`").alias("_id")] if once else []))
    x = x.select(*(F.col(f"`{g}`") for g in groups), *(F.when(F.col(f"m{i}") >= 0, bucket(F.col(f"m{i}"), bits)).alias(f"m{i}") for i in range(len(names))), *(["_id"] if once else []))
    if once:
        # Ids spread evenly, so this shuffle has no hot key; all columns are keys of a hash aggregation.
        x = x.where("_id is not null").distinct().unionByName(x.where("_id is null"))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("bucket")) for i, n in enumerate(names)))).alias("p")
    long = x.select(*(F.col(f"`{g}`") for g in groups), pairs).select(*(F.col(f"`{g}`") for g in groups), "p.metric", "p.bucket").where("bucket is not null")
    return long.groupBy(*(F.col(f"`{g}`") for g in groups), "metric", "bucket").agg(F.count("*").alias("cnt"))


def merge_counts(*states: DataFrame) -> DataFrame:
    """One state of several: partitions, days or earlier runs."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    keys = [c for c in out.columns if c != "cnt"]
    return out.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.sum("cnt").alias("cnt"))


def percentiles(counts: DataFrame, groups: list[str], ps: tuple[float, ...] = PERCENTILES, bits: int = SIG_BITS) -> DataFrame:
    """``groups…, n, percentile, value, max_error`` for each group of a state (``metric`` is one of ``groups``).

    The percentile p of n values is the value of rank ceil(p * n / 100), so ties need no rule. ``value`` is the middle
    of its bucket and off by at most ``max_error`` (0 below ``2 ** bits``). Groups without values do not occur.
    """
    spark = counts.sparkSession
    g = [f"g{i}" for i in range(len(groups))]
    h = counts.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(groups, g)), "bucket", "cnt").groupBy(*g, "bucket").agg(F.sum("cnt").alias("cnt"))
    r = materialize(h.repartitionByRange(n_shuffle(spark), *g, "bucket").withColumn("pid", F.spark_partition_id()))
    part = r.groupBy("pid", *g).agg(F.sum("cnt").alias("here"))
    w = Window.partitionBy(*g)
    part = part.select("pid", *g, F.coalesce(F.sum("here").over(w.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("here").over(w).alias("n"))
    a, b = r.alias("a"), part.alias("b")
    on = F.col("a.pid") == F.col("b.pid")
    for c in g:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    run = Window.partitionBy("pid", *g).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    x = a.join(b, on).select("a.*", "b.before", "b.n").withColumn("upto", F.col("before") + F.sum("cnt").over(run))
    rank = lambda p: F.ceil(F.col("n") * F.lit(p).cast("decimal(9,4)") / 100).cast("bigint")
    hit = F.array(*(F.when((rank(p) > F.col("upto") - F.col("cnt")) & (rank(p) <= F.col("upto")), F.lit(float(p))) for p in ps))
    x = x.withColumn("percentile", F.explode(F.filter(hit, lambda v: v.isNotNull())))
    wide = _width(F.col("bucket"), bits)
    half = F.when(wide == 1, F.lit(0.0)).otherwise(wide / 2)
    return x.select(*(F.col(n).alias(c) for n, c in zip(g, groups)), "n", "percentile", (F.col("bucket") + half).alias("value"), half.alias("max_error"))
