"""Scores of mappings, pairing of ends by insert size, mapping qualities and insert-size distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import mapping as M
from readloom.plans.prefix import running_sum
from readloom.plans.runtime import computed

# Fixed values.
MAX_QUALITY, INDEL_PENALTY, MISSING_QUALITY, MAX_SCORE = 42, 40, 30, 0xFFFF


def distance_score(blocks: Column, quals: Column, offset: int = 33, indel: int = INDEL_PENALTY, missing: int = MISSING_QUALITY) -> Column:
    """Sum of base qualities at mismatches (each capped), plus a penalty per insertion or deletion; capped as a whole."""

    def cost(b):
        q = lambda o: F.when(quals.isNull() | (quals == ""), F.lit(missing)).otherwise(F.least(F.greatest(F.ascii(F.substring(quals, o["pos"].cast("int") + 1, F.lit(1))) - offset, F.lit(0)), F.lit(MAX_QUALITY)))
        return F.aggregate(b["misms"], F.lit(0).cast("bigint"), lambda a, o: a + F.when(o["type"] == "MISMS", q(o)).otherwise(indel))

    return F.least(F.aggregate(blocks, F.lit(0).cast("bigint"), lambda a, b: a + cost(b)), F.lit(MAX_SCORE).cast("bigint"))


def pack(end1: Column, end2: Column, insert: Column | None = None) -> Column:
    """One BIGINT: bits 0-15 end 1, 16-31 end 2, 32-39 the insert size's Phred value."""
    v = end1.bitwiseOR(F.shiftleft(end2.cast("bigint"), 16))
    return v if insert is None else v.bitwiseOR(F.shiftleft(insert.cast("bigint"), 32))


def unpack(score: Column) -> Column:
    low = lambda k, m: F.shiftright(score, k).bitwiseAND(F.lit(m).cast("bigint"))
    return F.struct(low(0, 0xFFFF).alias("end1"), low(16, 0xFFFF).alias("end2"), low(32, 0xFF).alias("insert"))


def insert_cuts(sizes: DataFrame, cutoff: float = 0.01) -> DataFrame:
    """``x, y, phred`` of the central part of a distribution ``(x, y)``: between its cutoff and 1 - cutoff quantiles."""
    c = running_sum(sizes, ["x"], "y").withColumnRenamed("upto", "z").withColumnRenamed("total", "t")
    keep = c.where((F.col("z") >= F.col("t") * cutoff) & (F.col("z") < F.col("t") * (1 - cutoff)))
    share = F.col("y") / F.col("t")
    phred = F.when(share > 0, F.least(F.floor(-10 * F.log10(share) + 0.5), F.lit(255))).otherwise(255)
    return keep.select("x", "y", phred.cast("bigint").alias("phred"))


def pair_ends(left: DataFrame, right: DataFrame, lo: int, hi: int, key: str = "tag", bin_size: int | None = None) -> DataFrame:
    """Pairs of mappings of two ends on opposite strands of one sequence, whose insert size lies in [lo, hi].

    ``left`` and ``right`` have ``key, m`` (a mapping). The join is on key, sequence and bins of the place that the insert
    size is measured from, so a key with a third of all rows never meets itself whole and split ends meet however long
    their introns. ``bin_size`` defaults to a width that no pair in range spans twice.
    """
    width = bin_size or max(1 << 10, hi - lo + 1)
    # The insert size is the difference of the two. A mapping's text is parsed once, and not in filters before.
    anchor = M.insert_anchor(F.col("m.strand"), F.col("m.blocks"))
    placed = lambda x, to: computed(computed(x.select(key, "m"), "m", F.col("m")), to, anchor)
    a = placed(left, "_p").select(F.col(key), F.col("m").alias("m1"), "_p").withColumn("_b", F.floor(F.col("_p") / width))
    b = placed(right, "_q").select(F.col(key).alias("_k"), F.col("m").alias("m2"), "_q")
    # Where the place of the other end must lie, by the strand of this one: two bins at most.
    near, far = F.when(F.col("m2.strand") == "+", F.col("_q") + lo).otherwise(F.col("_q") - hi), F.when(F.col("m2.strand") == "+", F.col("_q") + hi).otherwise(F.col("_q") - lo)
    b = b.withColumn("_c", F.explode(F.sequence(F.floor(near / width), F.floor(far / width))))
    on = (a[key] == b["_k"]) & (F.col("m1.seq_name") == F.col("m2.seq_name")) & (F.col("_b") == F.col("_c")) & (F.col("m1.strand") != F.col("m2.strand"))
    x = F.when(F.col("m1.strand") == "+", F.col("_q") - F.col("_p")).otherwise(F.col("_p") - F.col("_q"))
    return a.join(b, on).withColumn("insert_size", x).where(F.col("insert_size").between(lo, hi)).drop("_k", "_b", "_c", "_p", "_q")


def unpaired(ends: DataFrame, pairs: DataFrame, end_no: int, key: str = "tag", id_field: str = "map_id") -> DataFrame:
    """Mappings of one end that no pair holds, in the shape of :func:`pair_ends`: the other end and the insert size are
    null. ``id_field`` names the field of ``m`` that tells mappings apart."""
    used = pairs.select(F.col(f"m{end_no}.{id_field}").alias("_id")).distinct()
    x = ends.select(F.col(key), F.col("m"), F.col(f"m.{id_field}").alias("_own")).join(used, F.col("_own") == F.col("_id"), "left_anti")
    none = F.lit(None).cast(ends.schema["m"].dataType)
    m1, m2 = (F.col("m"), none) if end_no == 1 else (none, F.col("m"))
    return x.select(key, m1.alias("m1"), m2.alias("m2"), F.lit(None).cast("bigint").alias("insert_size"))


def pair_reads(left: DataFrame, right: DataFrame, lo: int, hi: int, key: str = "tag", id_field: str = "map_id") -> DataFrame:
    """All pairs by insert size, and every mapping of either end that found no partner."""
    pairs = pair_ends(left, right, lo, hi, key)
    return pairs.unionByName(unpaired(left, pairs, 1, key, id_field)).unionByName(unpaired(right, pairs, 2, key, id_field))


def mapping_quality(df: DataFrame, template: list[str], location: list[str], score: str) -> DataFrame:
    """``template…, location…, phred``: mapping quality of each distinct location of a template.

    The probability of a location is the softmax of -score/10 (base 10) among the template's; ``phred`` is
    ``-10 log10(1 - p)`` rounded, at most 254. Sums are grouped with partial aggregation, so no template is one task.
    """
    one = df.groupBy(*template, *location).agg(F.min(score).alias("_s"))
    low = one.groupBy(*template).agg(F.min("_s").alias("_lo"))
    p = one.join(low, template).withColumn("_e", F.pow(F.lit(10.0), -(F.col("_s") - F.col("_lo")) / 10))
    # What the best location leaves is summed by itself: beside it a small rest would drown in rounding.
    best = F.col("_s") == F.col("_lo")
    z = p.groupBy(*template).agg(F.count(F.when(best, 1)).alias("_k"), F.coalesce(F.sum(F.when(~best, F.col("_e"))), F.lit(0.0)).alias("_t"))
    rest = F.when(best, (F.col("_k") - 1 + F.col("_t")) / (F.col("_k") + F.col("_t"))).otherwise(1 - F.col("_e") / (F.col("_k") + F.col("_t")))
    phred = F.when(rest < 1e-255, 254).otherwise(F.least(F.floor(0.5 - 10 * F.log10(rest)), F.lit(254))).cast("int")
    return p.join(z, template).select(*template, *location, phred.alias("phred"))


def class_quality(uniq: Column, best: Column, nxt: Column) -> Column:
    """A coarse quality class: unique, unique with neighbours, tie, none."""
    return F.when(best.isNull(), F.lit("none")).when(uniq < 0, F.lit("tie")).when(nxt.isNull(), F.lit("unique")).otherwise(F.lit("unique_near"))
