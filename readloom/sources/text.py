"""Line-oriented formats: MAP, SAM, GTF, junctions, insert-size distributions, coverage ranges; and format detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import mapping as M
from readloom.functions import sequence as S
from readloom.operators import templates as T
from readloom.sources import fastx

_EXTENSIONS = {"fasta": "fasta", "fa": "fasta", "fastq": "fastq", "fq": "fastq", "map": "map", "sam": "sam", "bam": "bam", "gtf": "gtf", "gff": "gtf"}


def guess_format(path: str) -> str | None:
    """Format by extension, compression aside."""
    name = re.sub(r"\.(gz|bz2)$", "", path.lower())
    return _EXTENSIONS.get(name.rsplit(".", 1)[-1])


def detect_format(spark: SparkSession, path: str) -> str | None:
    """Format by the first line: FASTA, FASTQ, SAM, GTF or MAP; reads one line."""
    first = fastx.read_lines(spark, path).limit(1).collect()
    if not first:
        return guess_format(path)
    s = first[0][0]
    c = s.split("\t")
    if s.startswith(">"):
        return "fasta"
    if re.match(r"@[A-Z]{2}\t", s) or (len(c) >= 11 and c[1].isdigit()):
        return "sam"
    if s.startswith("@"):
        return "fastq"
    if s.startswith("#") or (len(c) == 9 and c[3].isdigit() and c[4].isdigit()):
        return "gtf"
    return "map" if len(c) in (4, 5) else guess_format(path)


def find_pair(path: str) -> str | None:
    """Name of the file with the second ends, told by the usual suffixes of the first."""
    m = re.fullmatch(r"(.*[._-])([1A])([._-]?.*?)(\.(?:fastq|fq|map|fasta|fa|sam)(?:\.gz|\.bz2)?)", path)
    return f"{m[1]}{'2' if m[2] == '1' else 'B'}{m[3]}{m[4]}" if m else None


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Templates of MAP files (plain, gz, bz2)."""
    return T.from_map_lines(fastx.read_lines(spark, path), "value")


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """Blocks of a CIGAR: M, = and X match; I, S, H and P take up read (DEL); D takes up reference (INS); N opens a block."""
    edits = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(cigar, r"([0-9]+)[M=X]", "$1~"), r"([0-9]+)[ISHP]", ">$1-"), r"([0-9]+)D", ">$1+"), r"([0-9]+)N", ">$1*")
    return F.when(cigar.rlike(r"^([0-9]+[MIDNSHP=X])+$"), M.parse_blocks(pos, edits))  # the marks between numbers are no tokens


def sam_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """SAM records as typed columns with blocks and optional fields; header lines are left out."""
    c = F.split(F.col(line), "\t")
    at = lambda i: F.get(c, F.lit(i))
    x = lines.where(~F.col(line).rlike(r"^@[A-Z]{2}\t") & (F.size(c) >= 11))
    opt = F.filter(F.slice(c, 12, 1_000_000), lambda s: s.rlike("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))
    pos = at(3).try_cast("bigint")
    return x.select(
        at(0).alias("qname"), at(1).try_cast("int").alias("flag"), at(2).alias("rname"), pos.alias("pos"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"), at(6).alias("rnext"),
        at(7).try_cast("bigint").alias("pnext"), at(8).try_cast("bigint").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform(opt, lambda s: F.left(s, F.lit(2)))), lambda t: F.struct(t.alias("k"), F.substring(F.get(F.filter(opt, lambda s: F.left(s, F.lit(2)) == t), F.lit(0)), F.lit(6), F.lit(1 << 20)).alias("v")))).alias("tags"),
        cigar_blocks(pos, at(5)).alias("blocks"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return sam_table(fastx.read_lines(spark, path))


def sam_templates(sam: DataFrame) -> DataFrame:
    """Templates of SAM records: ``tag, end_no, read, quals, counters, mcs, not_unique, maps, phreds``, one per read end.

    All records of one end (0 for single ends) are put together: the primary one tells read and qualities, turned back
    where it lies on the reverse strand, and every mapped one, and those listed in XA, a mapping. ``phreds`` are their
    mapping qualities (null for XA). Records without sequence have an empty read.
    """
    f = F.col("flag")
    bit = lambda n: f.bitwiseAND(F.lit(n)) != 0
    end = F.when(bit(64), 1).when(bit(128), 2).otherwise(0)
    strand = F.when(bit(16), "-").otherwise("+")

    def mapping(seq, strand, pos, blocks, phred, order):
        edits = F.when(strand == "-", M.render_edits(M.reverse_blocks(blocks))).otherwise(M.render_edits(blocks))
        return F.struct(order.alias("o"), F.concat_ws(":", seq, strand, pos.cast("string"), edits).alias("txt"), phred.cast("int").alias("phred"))

    own = F.when(~bit(4) & F.col("blocks").isNotNull() & F.col("pos").isNotNull(), F.array(mapping(F.col("rname"), strand, F.col("pos"), F.col("blocks"), F.col("mapq"), bit(256).cast("int")))).otherwise(F.array())
    other = F.transform(F.coalesce(alternative_hits(F.col("tags")), F.expr("array()")), lambda a: mapping(a["seq_name"], a["strand"], a["pos"], cigar_blocks(a["pos"], a["cigar"]), F.lit(None), F.lit(2)))
    seq = F.when(F.col("seq") != "*", F.col("seq"))
    qual = F.when(F.col("qual") != "*", F.col("qual"))
    x = sam.select(
        "qname", end.alias("end_no"), F.when(~bit(256), F.when(bit(16), S.reverse_complement(F.upper(seq))).otherwise(F.upper(seq))).alias("_r"), F.when(~bit(256), F.when(bit(16), F.reverse(qual)).otherwise(qual)).alias("_q"),
        F.concat(own.cast("array<struct<o: int, txt: string, phred: int>>"), other.cast("array<struct<o: int, txt: string, phred: int>>")).alias("_m"),
    )
    g = x.groupBy("qname", "end_no").agg(F.coalesce(F.max("_r"), F.lit("")).alias("read"), F.max("_q").alias("quals"), F.array_distinct(F.array_sort(F.flatten(F.collect_list("_m")))).alias("_m"))
    y = g.select(F.col("qname").alias("tag"), "end_no", "read", "quals", F.transform("_m", lambda m: M.parse_map(m["txt"])).alias("maps"), F.transform("_m", lambda m: m["phred"]).alias("phreds"))
    y = T.recount(y.withColumn("not_unique", F.lit(False)))
    return y.withColumn("mcs", F.size("counters"))


def flags(f: Column) -> Column:
    """The bits of a SAM flag by name."""
    names = ["paired", "proper", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first", "last", "secondary", "failed", "duplicate"]
    return F.struct(*((f.bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(names)))


def alternative_hits(tags: Column) -> Column:
    """Mappings listed in the XA field: ``seq, strand, pos, cigar, nm``."""
    one = lambda s: F.struct(F.get(F.split(s, ","), F.lit(0)).alias("seq_name"), F.left(F.get(F.split(s, ","), F.lit(1)), F.lit(1)).alias("strand"), F.substring(F.get(F.split(s, ","), F.lit(1)), F.lit(2), F.lit(20)).try_cast("bigint").alias("pos"), F.get(F.split(s, ","), F.lit(2)).alias("cigar"), F.get(F.split(s, ","), F.lit(3)).try_cast("int").alias("nm"))
    return F.transform(F.filter(F.split(F.try_element_at(tags, F.lit("XA")), ";"), lambda s: s != ""), one)


def solve_mates(sam: DataFrame) -> DataFrame:
    """Records with their mate: ``rnext`` and ``pnext`` of one end name the position of the other."""
    f = flags(F.col("flag"))
    x = sam.withColumn("_f", f).where("_f.paired and not _f.unmapped and not _f.mate_unmapped")
    a = x.where("_f.first").select("qname", F.col("rname").alias("rname1"), F.col("pos").alias("pos1"), F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")).alias("n1"), F.col("pnext").alias("q1"), F.col("blocks").alias("blocks1"))
    b = x.where("_f.last").select("qname", F.col("rname").alias("rname2"), F.col("pos").alias("pos2"), F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")).alias("n2"), F.col("pnext").alias("q2"), F.col("blocks").alias("blocks2"))
    on = (a["qname"] == b["qname"]) & (F.col("n1") == F.col("rname2")) & (F.col("q1") == F.col("pos2")) & (F.col("n2") == F.col("rname1")) & (F.col("q2") == F.col("pos1"))
    return a.join(b, on).select(a["qname"], "rname1", "pos1", "rname2", "pos2", "blocks1", "blocks2")


def pair_by_position(ends1: Column, ends2: Column) -> Column:
    """Mappings of two ends paired in the order they are listed, as some mappers print them; the shorter list is padded with null."""
    return F.transform(F.arrays_zip(ends1.alias("a"), ends2.alias("b")), lambda z: F.struct(z["a"].alias("m1"), z["b"].alias("m2")))


def gtf_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """GTF records as typed columns; comment lines are left out."""
    c = F.split(F.col(line), "\t")
    at = lambda i: F.get(c, F.lit(i))
    attr = lambda k: F.nullif(F.regexp_extract(at(8), rf'(?:^|; *| ){k} "([^"]*)"', 1), F.lit(""))
    x = lines.where(~F.col(line).startswith("#") & (F.size(c) == 9))
    return x.select(
        at(0).alias("seq_name"), at(1).alias("source"), at(2).alias("feature_type"), at(3).try_cast("bigint").alias("start_pos"), at(4).try_cast("bigint").alias("end_pos"), at(5).alias("score"), at(6).alias("strand"), at(7).alias("frame"),
        attr("gene_id").alias("gene_id"), attr("transcript_id").alias("transcript_id"), F.coalesce(attr("gene_type"), attr("gene_biotype")).alias("gene_type"),
    )


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return gtf_table(fastx.read_lines(spark, path))


def read_junctions(spark: SparkSession, path: str) -> DataFrame:
    """Six tab-separated columns; sites in order of position, strands flipped where they were swapped."""
    from readloom.operators.junctions import normal

    s = "seq1 string, strand1 string, pos1 bigint, seq2 string, strand2 string, pos2 bigint"
    return normal(spark.read.schema(s).option("sep", "\t").option("comment", "#").csv(path))


def read_insert_distribution(spark: SparkSession, path: str) -> DataFrame:
    """``x, y`` of an insert-size table in either of its header variants (the second column, or Paired)."""
    x = spark.read.option("sep", "\t").option("header", True).csv(path)
    y = "Paired" if "Paired" in x.columns else x.columns[1]
    return x.select(F.col(x.columns[0]).try_cast("bigint").alias("x"), F.col(y).try_cast("bigint").alias("y")).where("x is not null and y is not null")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``seq_name, start_pos, end_pos, name``; rows whose start is under 1 or whose end is before it are left out."""
    s = "seq_name string, start_pos bigint, end_pos bigint, name string"
    return spark.read.schema(s).option("sep", "\t").csv(path).where("start_pos >= 1 and end_pos >= start_pos")


def spool(spark: SparkSession, stream) -> str:
    """A stream of bytes, such as standard input, as a file in the shared folder, which any reader can split."""
    from readloom.plans.runtime import shared_path

    path = shared_path(spark)
    f, p = fastx._filesystem(path)
    with f.open_output_stream(p, compression=None) as out:
        while block := stream.read(1 << 20):
            out.write(block)
    return path


def load(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Any of the formats, told by the first line unless named; SAM comes as templates, like MAP. ``-`` is standard input."""
    if path == "-":
        import sys

        path = spool(spark, sys.stdin.buffer)
    kind = format or detect_format(spark, path)
    readers = {"fastq": fastx.read_fastq, "fasta": fastx.read_fasta, "map": read_map, "sam": lambda s, p: sam_templates(read_sam(s, p)), "gtf": read_gtf}
    if kind not in readers:
        raise ValueError(f"no reader for {kind or 'this format'}: {path}")
    return readers[kind](spark, path)
