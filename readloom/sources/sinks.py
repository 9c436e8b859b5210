"""Printers: records as lines of text, and writers of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M
from readloom.functions import sequence as S
from readloom.operators import templates as T


def map_lines(df: DataFrame, max_maps: int | None = None, compact: bool = True, scores: bool = True) -> DataFrame:
    """MAP text of templates: mappings by stratum, counters with compact zeros, ``!`` for those flagged."""
    x = T.sort_maps(df)
    maps = F.col("maps") if max_maps is None else F.slice("maps", 1, max_maps)
    one = lambda m: M.render_map(m) if scores else F.substring_index(M.render_map(m), ":::", 1)
    text = F.when(F.size(maps) == 0, F.lit("-")).otherwise(F.array_join(F.transform(maps, one), ","))
    counters = F.when(F.col("not_unique"), F.lit("!")).otherwise(C.render_counters(F.col("counters"), F.col("mcs"), compact))
    return x.select(F.concat_ws("\t", "tag", "read", "quals", counters, text).alias("value"))


def consistent(df: DataFrame) -> Column:
    """Whether the counters agree with the mappings printed: no more mappings of a stratum than counted."""
    d = T.distances(F.col("maps"))
    return F.forall(F.transform(F.array_distinct(d), lambda k: F.size(F.filter(d, lambda v: v == k)) <= F.coalesce(F.get("counters", k.cast("int")), F.lit(0))), lambda ok: ok)


def fastq_lines(df: DataFrame, tag: str = "tag", read: str = "read", quals: str = "quals") -> DataFrame:
    """One value per record, with its line breaks; FASTA where qualities are null."""
    fq = F.concat(F.lit("@"), F.col(tag), F.lit("\n"), F.col(read), F.lit("\n+\n"), F.col(quals))
    fa = F.concat(F.lit(">"), F.col(tag), F.lit("\n"), F.col(read))
    return df.select(F.coalesce(fq, fa).alias("value"))


def fasta_lines(df: DataFrame, name: str = "name", sequence: str = "sequence", width: int = 70) -> DataFrame:
    wrapped = F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?!$)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped).alias("value"))


# ---- SAM ------------------------------------------------------------------------------------------------------------


def flag_single(mapped: Column, reverse: Column, secondary: Column | bool = False, failed: bool = False, duplicate: bool = False) -> Column:
    """Flag of a single-end record."""
    bit = lambda c, v: F.when(c, v).otherwise(0)
    sec = secondary if isinstance(secondary, Column) else F.lit(secondary)
    return (bit(~mapped, 4) + bit(mapped & reverse, 16) + bit(mapped & sec, 256) + F.lit(512 * failed + 1024 * duplicate)).cast("int")


def flag_paired(mapped: Column, reverse: Column, mate_mapped: Column, mate_reverse: Column, first: Column, secondary: Column | bool = False) -> Column:
    """Flag of one end of a pair; properly aligned if both ends are mapped."""
    bit = lambda c, v: F.when(c, v).otherwise(0)
    sec = secondary if isinstance(secondary, Column) else F.lit(secondary)
    return (1 + bit(mapped & mate_mapped, 2) + bit(~mapped, 4) + bit(~mate_mapped, 8) + bit(mapped & reverse, 16) + bit(mate_mapped & mate_reverse, 32) + bit(first, 64) + bit(~first, 128) + bit(mapped & sec, 256)).cast("int")


def _cigar(m: Column) -> Column:
    """CIGAR in reference order: mappings on the reverse strand list their blocks as the read runs."""
    return F.when(m["strand"] == "-", M.cigar(M.reverse_blocks(m["blocks"]))).otherwise(M.cigar(m["blocks"]))


# SAM mapping qualities by class of a mapping: unique without others, unique with others in further strata,
# one of several in the best stratum, in a further stratum.
UNIQUE, UNIQUE_WITH_OTHERS, TIE, NEXT_STRATUM = 254, 180, 119, 110


def mapping_class(counters: Column, primary: Column) -> Column:
    """Mapping quality by the counters. Mappings of one stratum count as a tie, their scores are not compared; a mapping
    that is not the primary one counts as of a further stratum. 255 would mean that none is known."""
    return F.when(~primary, NEXT_STRATUM).when(C.uniq_degree(counters) < 0, TIE).when(C.reduce_sum(counters) == 1, UNIQUE).otherwise(UNIQUE_WITH_OTHERS)


#: Functional fields by name: ``fn(df columns)`` of a mapping ``m`` of a template.
FIELDS = {
    "NH": lambda m: F.concat(F.lit("NH:i:"), F.size("maps").cast("string")),
    "NM": lambda m: F.concat(F.lit("NM:i:"), (M.levenshtein(m["blocks"]) - M.left_trim(m["blocks"]) - F.when(F.size(m["blocks"]["misms"]) > 0, M.right_trim(m["blocks"])).otherwise(0)).cast("string")),
    "XT": lambda m: F.concat(F.lit("XT:A:"), F.when(C.uniq_degree(F.col("counters")) != -1, "U").otherwise("R")),
    "md": lambda m: F.concat(F.lit("md:Z:"), M.render_edits(m["blocks"])),
    "cs": lambda m: F.when(S.parse_tag(F.col("tag"))["casava"] != "", F.concat(F.lit("cs:Z:"), S.parse_tag(F.col("tag"))["casava"])),
    "XS": lambda m: F.when(F.size(m["blocks"]) > 1, F.concat(F.lit("XS:A:"), m["xs"])),
    "MQ": lambda m: F.concat(F.lit("MQ:i:"), F.coalesce(m["score"], F.lit(0).cast("bigint")).bitwiseAND(F.lit(0xFF).cast("bigint")).cast("string")),
    "UQ": lambda m: F.concat(F.lit("UQ:i:"), F.coalesce(m["score"], F.lit(0).cast("bigint")).bitwiseAND(F.lit(0xFFFF).cast("bigint")).cast("string")),
    "PQ": lambda m: F.concat(F.lit("PQ:i:"), F.shiftright(F.coalesce(m["score"], F.lit(0).cast("bigint")), 32).bitwiseAND(F.lit(0xFF).cast("bigint")).cast("string")),
}


def read_group(name: str) -> None:
    """Makes ``RG`` a field that names this read group."""
    FIELDS["RG"] = lambda m: F.lit(f"RG:Z:{name}")


def sam_header(sequences: DataFrame, read_groups: list[dict] = (), program: str = "readloom") -> DataFrame:
    """Header lines: HD, one SQ per sequence, RG, PG; the sequence list is the reference's own."""
    sq = sequences.select(F.lit(1).alias("o"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "seq_name"), F.concat(F.lit("LN:"), F.col("seq_length").cast("string"))).alias("value"))
    spark = sequences.sparkSession
    rest = [(0, "@HD\tVN:1.0\tSO:unsorted")] + [(2, "\t".join(["@RG", *(f"{k}:{v}" for k, v in g.items())])) for g in read_groups] + [(3, f"@PG\tID:{program}")]
    return sq.unionByName(spark.createDataFrame(rest, "o int, value string"))


def sam_lines(df: DataFrame, fields: tuple[str, ...] = ("NH", "NM", "XT"), compact: bool = False) -> DataFrame:
    """SAM records of single-end templates: the first mapping is primary, others secondary (or listed in XA if ``compact``).

    Reads and qualities are turned on the reverse strand. Unmapped templates give one record with flag 4. The mapping
    quality is that of ``mapping_class``, from the counters. ``XS`` needs mappings with the field ``xs``
    (:func:`readloom.operators.junctions.with_strand`).
    """
    some = F.size("maps") > 0
    rows = df.withColumn("m_no", F.explode(F.when(some, F.sequence(F.lit(0), F.when(F.lit(compact), 0).otherwise(F.size("maps") - 1))).otherwise(F.array(F.lit(0)))))
    m = F.get("maps", F.col("m_no"))
    rev = m["strand"] == "-"
    flag = flag_single(some, F.coalesce(rev, F.lit(False)), F.col("m_no") > 0)
    seq = F.when(rev, S.reverse_complement(F.col("read"))).otherwise(F.col("read"))
    q = F.coalesce(F.when(F.col("quals") != "", F.when(rev, F.reverse("quals")).otherwise(F.col("quals"))), F.lit("*"))
    opt = [F.when(some, FIELDS[f](m)) for f in fields]
    if compact:
        xa = F.array_join(F.transform(F.slice("maps", F.lit(2), F.greatest(F.size("maps") - 1, F.lit(0))), lambda a: F.concat_ws(",", a["seq_name"], F.concat(a["strand"], a["pos"].cast("string")), _cigar(a), M.levenshtein(a["blocks"]).cast("string"))), ";")
        opt.append(F.when(F.size("maps") > 1, F.concat(F.lit("XA:Z:"), xa)))
    mapq = F.when(some, mapping_class(F.col("counters"), F.col("m_no") == 0)).otherwise(0)
    core = [S.sam_qname(F.col("tag")), flag.cast("string"), F.coalesce(m["seq_name"], F.lit("*")), F.coalesce(m["pos"], F.lit(0)).cast("string"), mapq.cast("string"), F.coalesce(_cigar(m), F.lit("*")), F.lit("*"), F.lit("0"), F.lit("0"), seq, q]
    return rows.select(F.concat_ws("\t", *core, *opt).alias("value"))


# ---- other writers --------------------------------------------------------------------------------------------------


def junction_lines(j: DataFrame) -> DataFrame:
    return j.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("seq1", "strand1", "pos1", "seq2", "strand2", "pos2"))).alias("value"))


def count_lines(counts: DataFrame, weighted: bool = False) -> DataFrame:
    """``gene_id TAB n``: whole numbers, or four decimals if weighted."""
    n = F.format_string("%.4f", F.col("n").cast("double")) if weighted else F.col("n").cast("bigint").cast("string")
    return counts.select(F.concat_ws("\t", "gene_id", n).alias("value"))


def pretty(df: DataFrame) -> DataFrame:
    """Read and edit text of each mapping above each other, for reading by eye."""
    x = T.map_rows(df, ("tag", "read"))
    return x.select(F.concat_ws("\n", "tag", F.concat(F.lit("  "), "read"), F.concat(F.lit("  "), F.concat_ws(":", F.col("m.seq_name"), F.col("m.strand"), F.col("m.pos").cast("string")), F.lit(" "), M.render_edits(F.col("m.blocks")))).alias("value"))


def write_text(lines: DataFrame, path: str, compression: str | None = None, order: list[str] | None = None) -> None:
    """Lines as text files, one per partition; ``order`` range-sorts them, so that files in name order are in order."""
    x = lines if not order else lines.orderBy(*order)
    w = x.select("value").write.mode("errorifexists")
    (w.option("compression", compression) if compression else w).text(path)


def split_discarded(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Records kept and records discarded, for two writers."""
    ok = F.coalesce(keep, F.lit(False))
    return df.where(ok), df.where(~ok)


def write(df: DataFrame, path: str, format: str, compression: str | None = None, **kw) -> None:
    """Templates or reads in a format by name."""
    lines = {"map": map_lines, "sam": sam_lines, "fastq": fastq_lines, "fasta": fasta_lines, "junctions": junction_lines, "counts": count_lines}
    if format not in lines:
        raise ValueError(f"no writer for {format}")
    write_text(lines[format](df, **kw), path, compression)
