"""Paired templates: one row per read pair with its paired mappings nested.

A paired mapping is ``STRUCT<txt, m1, m2, score>``; either end may be null. Its distance is the sum of those of its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M
from readloom.plans.runtime import computed

_ONE = rf"[^:,\t]+:[-+FR]:[0-9]+:{M.EDITS_RE}"
PAIR_RE = rf"(?:{_ONE})?::(?:{_ONE})?(?::::(?:0x[0-9a-fA-F]+|[0-9]+))?"


def parse_pair(txt: Column) -> Column:
    """``end1::end2[:::score]``; an empty end is null."""
    part = lambda i: F.regexp_extract(txt, rf"^((?:{_ONE})?)::((?:{_ONE})?)(?::::(0x[0-9a-fA-F]+|[0-9]+))?$", i)
    end = lambda i: M.once(part(i), lambda t: F.when(t != "", M.parse_map(t)))
    return F.struct(txt.alias("txt"), end(1).alias("m1"), end(2).alias("m2"), M.parse_score(part(3)).alias("score"))


def from_map_lines(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Paired templates of MAP text: read and qualities hold both ends, joined by one character that is no base."""
    c = F.split(F.col(line), "\t")
    n = F.size(c)
    col = lambda i: F.try_element_at(c, F.lit(i))
    text, maps = col(-2), col(-1)
    x = lines.where(n.isin(4, 5) & col(2).rlike("^[ACGTN]+[^ACGTN\t][ACGTN]+$") & text.rlike(f"^{M.COUNTERS_RE}$") & maps.rlike(f"^(?:-|{PAIR_RE}(?:,{PAIR_RE})*)$"))
    cut = F.length(F.regexp_extract(col(2), "^([ACGTN]+)", 1))
    halves = lambda s: F.array(F.left(s, cut), F.substring(s, cut + 2, F.length(s)))
    texts = F.filter(F.split(maps, ","), lambda t: t != "-")
    x = computed(x, "mmaps", F.transform(texts, parse_pair))
    return x.select(
        *keep, col(1).alias("tag"), halves(col(2)).alias("reads"), F.when(n == 5, halves(col(3))).alias("quals"), C.parse_counters(text).alias("counters"), C.parse_mcs(text).alias("mcs"),
        C.not_unique(text).alias("not_unique"), "mmaps",
    )


def distance(p: Column) -> Column:
    one = lambda m: F.coalesce(M.global_distance(m["blocks"]), F.lit(0).cast("bigint"))
    return one(p["m1"]) + one(p["m2"])


def strands(p: Column) -> Column:
    """FR, RF, FF or RR; null with one end only."""
    letter = lambda m: F.when(m["strand"] == "+", "F").when(m["strand"] == "-", "R")
    return F.concat(letter(p["m1"]), letter(p["m2"]))


def insert_size(p: Column) -> Column:
    a, b = p["m1"], p["m2"]
    return M.insert_size(a["seq_name"], a["strand"], a["blocks"], b["seq_name"], b["strand"], b["blocks"])


def keep_where(df: DataFrame, cond) -> DataFrame:
    return df.withColumn("mmaps", F.filter("mmaps", lambda p: F.coalesce(cond(p), F.lit(False))))


def on_strands(df: DataFrame, allowed: list[str]) -> DataFrame:
    return keep_where(df, lambda p: strands(p).isin(*allowed))


def insert_between(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Insert size in range; where it has no meaning it counts as 0."""
    return keep_where(df, lambda p: F.coalesce(insert_size(p), F.lit(0)).between(lo, hi))


def on_sequences(df: DataFrame, names: list[str]) -> DataFrame:
    return keep_where(df, lambda p: p["m1"]["seq_name"].isin(*names) & p["m2"]["seq_name"].isin(*names))


def coherent(df: DataFrame) -> DataFrame:
    return keep_where(df, lambda p: p["m1"].isNull() | p["m2"].isNull() | M.coherent(p["m1"]["blocks"], p["m2"]["blocks"]))


def reduce_to_pairs(df: DataFrame) -> DataFrame:
    """Templates without a mapping of both ends lose all mappings."""
    paired = F.exists("mmaps", lambda p: p["m1"].isNotNull() & p["m2"].isNotNull())
    return recount(df.withColumn("mmaps", F.when(paired, F.col("mmaps")).otherwise(F.slice("mmaps", 1, 0))))


def recount(df: DataFrame) -> DataFrame:
    return df.withColumn("counters", C.counters_of(F.transform("mmaps", distance)))


def sort_pairs(df: DataFrame) -> DataFrame:
    """By distance ascending, score descending, then as they were."""
    keys = F.array_sort(F.transform("mmaps", lambda p, i: F.struct(distance(p).alias("d"), (-F.coalesce(p["score"], F.lit(0).cast("bigint"))).alias("s"), i.alias("i"))))
    return df.withColumn("mmaps", F.transform(keys, lambda k: F.get(F.col("mmaps"), k["i"])))


def ends(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per end of each paired mapping: ``keep…, map_no, end_no, m``."""
    x = df.select(*keep, F.posexplode("mmaps").alias("map_no", "p"))
    both = F.array(F.struct(F.lit(1).alias("end_no"), F.col("p.m1").alias("m")), F.struct(F.lit(2).alias("end_no"), F.col("p.m2").alias("m")))
    return x.select(*keep, "map_no", F.explode(both).alias("e")).select(*keep, "map_no", "e.end_no", "e.m").where("m is not null")


def map_lines(df: DataFrame) -> DataFrame:
    """Paired MAP text: reads and qualities of both ends joined by a blank, mappings by stratum."""
    x = sort_pairs(df)
    both = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, " "))
    one = lambda m: F.when(m.isNull(), "").otherwise(F.concat_ws(":", m["seq_name"], m["strand"], m["pos"].cast("string"), M.render_edits(m["blocks"])))
    text = F.transform("mmaps", lambda p: F.concat(one(p["m1"]), F.lit("::"), one(p["m2"]), F.when(p["score"].isNotNull(), F.concat(F.lit(":::"), p["score"].cast("string"))).otherwise("")))
    maps = F.when(F.size("mmaps") == 0, "-").otherwise(F.array_join(text, ","))
    counters = F.when(F.col("not_unique"), F.lit("!")).otherwise(C.render_counters(F.col("counters"), F.col("mcs")))
    return x.select(F.concat_ws("\t", "tag", F.array_join("reads", " "), both("quals"), counters, maps).alias("value"))


def sam_lines(df: DataFrame) -> DataFrame:
    """SAM records of pairs: each mapping gives a line per end, the first mapping primary, with mate and template size."""
    from readloom.functions import sequence as S
    from readloom.sources.sinks import _cigar, flag_paired, mapping_class

    some = F.size("mmaps") > 0
    none = F.lit(None).cast(df.schema["mmaps"].dataType.elementType.simpleString())
    x = df.select("tag", "reads", "quals", "counters", F.posexplode(F.when(some, F.col("mmaps")).otherwise(F.array(none))).alias("no", "p"))
    x = x.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("end"))
    first = F.col("end") == 0
    m = F.when(first, F.col("p.m1")).otherwise(F.col("p.m2"))
    mate = F.when(first, F.col("p.m2")).otherwise(F.col("p.m1"))
    is_rev = lambda v: F.coalesce(v["strand"] == "-", F.lit(False))
    flag = flag_paired(m.isNotNull(), is_rev(m), mate.isNotNull(), is_rev(mate), first, F.col("no") > 0)
    read, q = F.get("reads", F.col("end")), F.get("quals", F.col("end"))
    seq = F.when(is_rev(m), S.reverse_complement(read)).otherwise(read)
    qual = F.coalesce(F.when(is_rev(m), F.reverse(q)).otherwise(q), F.lit("*"))
    tlen = F.coalesce(M.observed_template_size(m["seq_name"], m["blocks"], mate["seq_name"], mate["blocks"]), F.lit(0))
    rnext = F.when(mate.isNull(), "*").when(mate["seq_name"] == m["seq_name"], "=").otherwise(mate["seq_name"])
    mapq = F.when(m.isNull(), "0").otherwise(mapping_class(F.col("counters"), F.col("no") == 0).cast("string"))
    core = [S.sam_qname(F.col("tag")), flag.cast("string"), F.coalesce(m["seq_name"], F.lit("*")), F.coalesce(m["pos"], F.lit(0)).cast("string"), mapq, F.coalesce(_cigar(m), F.lit("*")), rnext, F.coalesce(mate["pos"], F.lit(0)).cast("string"), tlen.cast("string"), seq, qual]
    return x.select(F.concat_ws("\t", *core).alias("value"))
