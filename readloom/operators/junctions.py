"""Splice junctions: from annotation, from split mappings, and their support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SITE = ["seq1", "strand1", "pos1", "seq2", "strand2", "pos2"]


def from_annotation(features: DataFrame) -> DataFrame:
    """Sites between consecutive exons of a transcript, in reading direction of its strand; each once."""
    w = Window.partitionBy("transcript_id").orderBy("start_pos", "end_pos", "ann_id")
    x = features.where("feature_type = 'exon' and transcript_id is not null and start_pos <= end_pos").select("seq_name", "strand", F.lag("end_pos").over(w).alias("e"), F.lag("seq_name").over(w).alias("s"), "start_pos")
    x = x.where("s = seq_name")
    fwd = F.col("strand") != "-"
    return x.select(F.col("seq_name").alias("seq1"), F.col("strand").alias("strand1"), F.when(fwd, F.col("e")).otherwise(F.col("start_pos")).alias("pos1"), F.col("seq_name").alias("seq2"), F.col("strand").alias("strand2"), F.when(fwd, F.col("start_pos")).otherwise(F.col("e")).alias("pos2")).distinct()


def from_mappings(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``seq_name, left, right, support`` of splices in mappings (``keys…, seq_name, block_no, b_start, b_end``)."""
    w = Window.partitionBy(*keys).orderBy("b_start", "block_no")
    x = blocks.withColumn("left", F.lag("b_end").over(w)).where("left is not null")
    return x.groupBy("seq_name", "left", F.col("b_start").alias("right")).agg(F.count("*").alias("support"))


def transcript_junctions(features: DataFrame) -> DataFrame:
    """``seq_name, left, right, support`` of the junctions between consecutive exons; support counts transcripts."""
    w = Window.partitionBy("transcript_id").orderBy("start_pos", "end_pos", "ann_id")
    x = features.where("feature_type = 'exon' and transcript_id is not null and start_pos <= end_pos").select("seq_name", F.lag("end_pos").over(w).alias("left"), F.lag("seq_name").over(w).alias("s"), F.col("start_pos").alias("right"))
    return x.where("s = seq_name").groupBy("seq_name", "left", "right").agg(F.count("*").alias("support"))


def supported(found: DataFrame, annotated: DataFrame, coverage: int) -> DataFrame:
    """Junctions with enough support, or with one side at an annotated site."""
    sites = annotated.select(F.col("seq1").alias("q"), F.col("pos1").alias("p")).unionByName(annotated.select(F.col("seq2").alias("q"), F.col("pos2").alias("p"))).distinct()
    by = lambda c: found.join(sites, (found["seq_name"] == sites["q"]) & (found[c] == sites["p"]), "left_semi").select("seq_name", "left", "right")
    known = by("left").unionByName(by("right")).distinct().withColumn("known", F.lit(True))
    x = found.join(known, ["seq_name", "left", "right"], "left")
    return x.where((F.col("support") >= coverage) | F.col("known")).select("seq_name", "left", "right", "support", F.coalesce("known", F.lit(False)).alias("known"))


def normal(j: DataFrame) -> DataFrame:
    """Sites in order of position; a swapped site has both strands flipped."""
    swap = F.col("pos1") > F.col("pos2")
    flip = lambda c: F.when(F.col(c) == "+", "-").otherwise("+")
    return j.select(
        F.when(swap, F.col("seq2")).otherwise(F.col("seq1")).alias("seq1"), F.when(swap, flip("strand2")).otherwise(F.col("strand1")).alias("strand1"), F.when(swap, F.col("pos2")).otherwise(F.col("pos1")).alias("pos1"),
        F.when(swap, F.col("seq1")).otherwise(F.col("seq2")).alias("seq2"), F.when(swap, flip("strand1")).otherwise(F.col("strand2")).alias("strand2"), F.when(swap, F.col("pos1")).otherwise(F.col("pos2")).alias("pos2"),
    )


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0].select(*SITE)
    for s in sets[1:]:
        out = out.unionByName(s.select(*SITE))
    return out.distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*SITE), SITE, "left_anti")


def by_distance(j: DataFrame, lo: int, hi: int) -> DataFrame:
    return j.where(F.abs(F.col("pos1") - F.col("pos2")).between(lo, hi))


def on_sequences(j: DataFrame, names: DataFrame) -> DataFrame:
    """Junctions whose both sequences occur in ``names.seq_name``."""
    a = names.select(F.col("seq_name").alias("seq1")).distinct()
    return j.join(a, "seq1", "left_semi").join(a.withColumnRenamed("seq1", "seq2"), "seq2", "left_semi").select(*SITE)


def with_strand(templates: DataFrame, key: str, chunks: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Templates whose split mappings tell, in a field ``xs``, the strand that the bases of the reference at their first
    junction speak for; others have ``0``. ``chunks`` are those of :func:`readloom.sources.fastx.reference_chunks`."""
    from readloom.functions import mapping as M
    from readloom.sources.fastx import sequence_at

    j = templates.select(F.col(key).alias("_key"), F.posexplode("maps").alias("_no", "m")).where(F.size("m.blocks") > 1)
    first = F.get(M.splices(F.col("m.blocks")), F.lit(0))
    five = F.lit(5).cast("bigint")
    j = j.select("_key", "_no", F.col("m.seq_name").alias("_on"), first["s"].alias("_from"), (first["e"] - 4).alias("_to"), five.alias("_five")).where("_from is not null")
    a = sequence_at(j, chunks, "_on", "_from", "_five", size=size).withColumnRenamed("sequence", "_donor")
    b = sequence_at(a, chunks, "_on", "_to", "_five", size=size)
    xs = b.select("_key", F.struct("_no", motif_strand(F.col("_donor"), F.col("sequence")).alias("xs")).alias("x")).groupBy("_key").agg(F.map_from_entries(F.collect_list("x")).alias("_xs"))
    t = templates.join(xs, templates[key] == xs["_key"], "left")
    say = lambda i: F.coalesce(F.try_element_at(F.col("_xs"), i), F.lit("0"))
    return t.withColumn("maps", F.transform("maps", lambda m, i: m.withField("xs", say(i)))).drop("_key", "_xs")


# Motifs of splice sites on the forward strand (donor, acceptor), and read from the other strand.
FORWARD = (("GT", "AG"), ("GC", "AG"), ("ATATC", "A."), ("GTATC", "AT"))
REVERSE = (("CT", "AC"), ("CT", "GC"), (".T", "GATAT"), ("AT", "GATAC"))


def motif_strand(donor, acceptor):
    """Strand that the bases behind a block and before the next one tell: + or -, 0 if none or both kinds of motif fit."""
    plus = minus = F.lit(False)
    for d, a in FORWARD:
        plus = plus | (donor.rlike(f"^{d}") & acceptor.rlike(f"{a}$"))
    for d, a in REVERSE:
        minus = minus | (donor.rlike(f"^{d}") & acceptor.rlike(f"{a}$"))
    return F.when(plus & ~minus, "+").when(minus & ~plus, "-").otherwise("0")
