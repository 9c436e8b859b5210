"""Depth of coverage from interval ends, without a row per base.

Each interval gives +1 at its start and -1 behind its end. Ends are summed per position and range-sorted over all
partitions; running sums within a partition, shifted by the sums of the partitions before it, give runs of equal depth.
A sequence that holds most intervals is spread over partitions like any other range of positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.plans.prefix import carried, scan

#: Largest depth kept; higher ones count as this.
MAX_DEPTH = 0xFFFE


def depth_runs(intervals: DataFrame, seq: str, start: str, end: str, cap: int = MAX_DEPTH) -> DataFrame:
    """``seq_name, start_pos, end_pos, depth``: longest runs between interval ends, depth 1 or more.

    Intervals with null bounds or start after end cover nothing.
    """
    x = intervals.where(F.col(start) <= F.col(end)).select(F.col(seq).alias("seq_name"), F.explode(F.array(F.struct(F.col(start).cast("bigint").alias("pos"), F.lit(1).alias("d")), F.struct((F.col(end).cast("bigint") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    e = x.groupBy("seq_name", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    return _from_deltas(e).withColumn("depth", F.least(F.col("depth"), F.lit(cap)))


def histogram(runs: DataFrame) -> DataFrame:
    """``depth, bases, fraction, cumulative``: bases at a depth, their share, and the share at this depth or less."""
    h = runs.groupBy("depth").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("bases"))
    w = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # at most MAX_DEPTH rows
    every = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return h.select("depth", "bases", (F.col("bases") / F.sum("bases").over(every)).alias("fraction"), (F.sum("bases").over(w) / F.sum("bases").over(every)).alias("cumulative"))


def per_sequence(runs: DataFrame, sequences: DataFrame) -> DataFrame:
    """``seq_name, covered, total, mean_depth`` for each sequence of a reference."""
    n = F.col("end_pos") - F.col("start_pos") + 1
    c = runs.groupBy("seq_name").agg(F.sum(n).alias("covered"), F.sum(n * F.col("depth")).alias("bases"))
    return sequences.join(c, "seq_name", "left").select("seq_name", F.coalesce("covered", F.lit(0)).alias("covered"), F.col("seq_length").alias("total"), (F.coalesce("bases", F.lit(0)) / F.col("seq_length")).alias("mean_depth"))


def binned(runs: DataFrame, size: int) -> DataFrame:
    """``seq_name, bin, bases``: covering bases per bin of ``size`` positions."""
    x = runs.withColumn("bin", F.explode(F.sequence(F.expr(f"start_pos div {size}"), F.expr(f"end_pos div {size}"))))
    part = F.least(F.col("end_pos"), (F.col("bin") + 1) * size - 1) - F.greatest(F.col("start_pos"), F.col("bin") * size) + 1
    return x.groupBy("seq_name", "bin").agg(F.sum(part * F.col("depth")).alias("bases"))


def on_targets(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """``target_id, covered, bases`` of named ranges."""
    from readloom.operators.intervals import overlap_join, touches

    t = targets.select("target_id", F.col("seq_name").alias("t_seq"), F.col("start_pos").alias("t_start"), F.col("end_pos").alias("t_end"))
    h = overlap_join(runs, t, ("seq_name", "start_pos", "end_pos"), ("t_seq", "t_start", "t_end"), predicate=touches)
    n = F.least("end_pos", "t_end") - F.greatest("start_pos", "t_start") + 1
    return h.groupBy("target_id").agg(F.sum(n).alias("covered"), F.sum(n * F.col("depth")).alias("bases"))


def combine(*runs: DataFrame, cap: int = MAX_DEPTH) -> DataFrame:
    """Depth runs of several inputs added up; depths over ``cap`` count as it, as in :func:`depth_runs`."""
    out = None
    for r in runs:
        one = r.select("seq_name", "start_pos", "end_pos", "depth")
        out = one if out is None else out.unionByName(one)
    # Each run is as many intervals as its depth; weights stay numbers.
    x = out.select("seq_name", F.explode(F.array(F.struct(F.col("start_pos").alias("pos"), F.col("depth").alias("d")), F.struct((F.col("end_pos") + 1).alias("pos"), (-F.col("depth")).alias("d")))).alias("e"))
    e = x.groupBy("seq_name", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    return _from_deltas(e).withColumn("depth", F.least(F.col("depth"), F.lit(cap)))


def _from_deltas(e: DataFrame) -> DataFrame:
    # A change of depth closes the run that the change before it opened.
    r = carried(scan(e, ["seq_name"], ["pos"], "d", prev="pos"), ["seq_name"], _before=(F.sum, "d"), _at=(F.max, "pos"))
    depth = F.coalesce("_before", F.lit(0)) + F.col("_scan") - F.col("d")
    return r.select("seq_name", F.coalesce("_prev", "_at").alias("start_pos"), (F.col("pos") - 1).alias("end_pos"), depth.alias("depth")).where("depth > 0 and start_pos is not null")
