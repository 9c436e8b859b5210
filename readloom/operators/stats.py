"""Histograms and counters over reads, templates, mappings and pairs.

Every statistic is a grouped count with map-side partial sums: partial results of files, days or threads merge by
adding. Long tables ``(metric, bucket, value)`` put together with :func:`merge`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M

# Upper bounds of the buckets; larger values go to "more".
LENGTHS = (5, 40, 80, 100, 150, 300, 800, 1000, 2000, 5000)
MULTIMAPS = (0, 1, 5, 10, 50, 100, 500, 1000)
UNIQUENESS = (0, 1, 2, 3, 10, 50, 100, 500)
ERRORS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 50)
JUNCTIONS = (1, 2, 3)
JUNCTION_LENGTHS = (100, 1000, 5000, 10000, 50000)


def bucket(v: Column, bounds: Sequence[int], more: str = "more") -> Column:
    """Name of the first bound that is not exceeded."""
    out = None
    for b in bounds:
        out = F.when(v <= b, str(b)) if out is None else out.when(v <= b, str(b))
    return out.otherwise(F.when(v.isNotNull(), more))


def error_bucket(errors: Column, read_length: Column) -> Column:
    """Errors as a percentage of the read: 0, or the first percentage whose whole number of bases is not exceeded."""
    out = F.when(errors == 0, "0")
    for b in ERRORS[1:]:
        out = out.when(errors <= F.floor(F.lit(b) * (read_length / 100.0)), str(b))
    return out.otherwise("more")


def insert_bucket(x: Column, lo: int = -1000, hi: int = 50010, step: int = 10) -> Column:
    last = (hi - lo) // step - 1
    return F.when(x < lo, 0).when(x >= hi, last).otherwise(F.floor((x - lo) / step)).cast("bigint")


def hist(df: DataFrame, metric: str, b: Column) -> DataFrame:
    """``metric, bucket, value`` of one bucket expression; null buckets are left out."""
    return df.select(F.lit(metric).alias("metric"), b.cast("string").alias("bucket")).where("bucket is not null").groupBy("metric", "bucket").agg(F.count("*").alias("value"))


def merge(*parts: DataFrame) -> DataFrame:
    """Statistics of several inputs added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("metric", "bucket").agg(F.sum("value").alias("value"))


def step_hist(df: DataFrame, dims: dict[str, tuple[Column, int, int, int]]) -> DataFrame:
    """Nested histogram: for each dimension ``(value, from, to, step)``; out of range values go to -1 and the last + 1."""
    cols = []
    for name, (v, lo, hi, step) in dims.items():
        cols.append(F.when(v < lo, -1).when(v >= hi, (hi - lo) // step).otherwise(F.floor((v - lo) / step)).cast("bigint").alias(name))
    return df.select(*cols).groupBy(*dims).agg(F.count("*").alias("value"))


def general(templates: DataFrame) -> DataFrame:
    """Lengths, bases, mapped reads and mappings of templates in one pass."""
    n = F.length("read").cast("bigint")
    maps = F.size("maps").cast("bigint")
    aligned = F.coalesce(M.bases_aligned(F.get("maps", F.lit(0))["blocks"]), F.lit(0))
    hit = F.when(maps > 0, 1)
    return templates.agg(
        F.count("*").alias("reads"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.sum(n).alias("bases"), F.count(hit).alias("mapped"), F.sum(maps).alias("maps"),
        F.min(F.when(maps > 0, n)).alias("mapped_min_length"), F.max(F.when(maps > 0, n)).alias("mapped_max_length"), F.sum(aligned).alias("bases_aligned"),
    )


def profile(templates: DataFrame, first_only: bool = False) -> DataFrame:
    """``metric, bucket, value``: the profiles of templates and their mappings in one pass and one grouped count.

    Metrics: length, multimaps, uniqueness; per mapping mismatches, levenshtein, insertions, deletions and events as
    shares of the read, strand, junctions and junction_length. With ``first_only`` a template has its first mapping only.
    Profiles of several inputs add up with :func:`merge`.
    """
    t = templates.withColumn("maps", F.slice("maps", 1, 1)) if first_only else templates
    n = F.length("read")
    entry = lambda metric, b: F.struct(F.lit(metric).alias("metric"), b.cast("string").alias("bucket"))
    uniq = C.uniq_degree(C.counters_of(F.transform("maps", lambda m: M.global_distance(m["blocks"]))))
    own = F.array(entry("length", bucket(n, LENGTHS)), entry("multimaps", bucket(F.size("maps"), MULTIMAPS)), entry("uniqueness", F.when(F.size("maps") > 0, F.when(uniq < 0, "X").otherwise(bucket(uniq, UNIQUENESS)))))

    def of(m):
        b = m["blocks"]
        errors = {"mismatches": M.n_mismatches(b), "levenshtein": M.levenshtein(b), "insertions": M.total_ins(b), "deletions": M.total_dels(b), "events": M.global_distance(b)}
        k = F.size(b) - 1
        return F.array(*(entry(name, error_bucket(v, n)) for name, v in errors.items()), entry("strand", m["strand"]), entry("junctions", F.when(k > 0, bucket(k, JUNCTIONS))))

    lengths = F.transform(F.filter(F.flatten(F.transform("maps", lambda m: F.transform(m["blocks"], lambda b: b["junction"]))), lambda j: j > 0), lambda j: entry("junction_length", bucket(j, JUNCTION_LENGTHS)))
    x = t.select(F.explode(F.concat(own, F.flatten(F.transform("maps", of)), lengths)).alias("p")).select("p.*")
    return x.where("bucket is not null").groupBy("metric", "bucket").agg(F.count("*").alias("value"))


def to_text_report(stats: DataFrame) -> DataFrame:
    """``metric, bucket, value, share`` as lines of text; the share is of all values of the metric."""
    total = stats.groupBy("metric").agg(F.sum("value").alias("_all"))
    x = stats.join(total, "metric")
    return x.select("metric", "bucket", F.concat_ws("\t", "metric", "bucket", F.col("value").cast("string"), F.format_string("%.2f%%", F.col("value") / F.col("_all") * 100)).alias("value"))


def read_counters(templates: DataFrame, maps: str = "maps", ends: int = 1) -> DataFrame:
    """``reads, unmapped, unique, mappings`` of templates with ``ends`` ends; reads are counted by their ends."""
    k = F.size(maps)
    n = lambda c: (F.count(F.when(c, 1)) * ends).alias
    return templates.agg((F.count("*") * ends).alias("reads"), n(k == 0)("unmapped"), n(k == 1)("unique"), F.sum(k.cast("bigint")).alias("mappings"))


def nucleotides(reads: DataFrame, read: str = "read_seq") -> DataFrame:
    """``base, value``: counted per read first, so a row is never blown up into one row per base."""
    one = lambda b: F.length(read) - F.length(F.regexp_replace(F.upper(read), b, ""))
    sums = reads.agg(*(F.sum(one(b).cast("bigint")).alias(b) for b in "ACGTN"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.coalesce(F.col(b), F.lit(0)).alias("value")) for b in "ACGTN"))).alias("x")).select("x.*")


def per_cycle(reads: DataFrame, read: str = "read_seq") -> DataFrame:
    """``cycle, base, value``: bases by position in the read."""
    x = reads.select(F.posexplode(F.filter(F.split(read, ""), lambda c: c != "")).alias("cycle", "base"))
    return x.groupBy("cycle", "base").agg(F.count("*").alias("value"))


def per_cycle_quality(reads: DataFrame, read: str = "read_seq", quals: str = "qualities") -> DataFrame:
    """``cycle, qual, value`` of reads with one quality character per base."""
    x = reads.where(F.length(read) == F.length(quals)).select(F.posexplode(F.filter(F.split(quals, ""), lambda c: c != "")).alias("cycle", "q"))
    return x.groupBy("cycle", F.ascii("q").alias("qual")).agg(F.count("*").alias("value"))


def mismatches(templates: DataFrame, keep: tuple[str, ...] = ("line_id",), first_only: bool = False) -> DataFrame:
    """One row per edit operation of each mapping: ``keep…, map_no, type, read_pos, base, size`` and the bases of the read around it."""
    maps = F.slice("maps", 1, 1) if first_only else F.col("maps")
    x = templates.select(*keep, "read", "quals", F.posexplode(maps).alias("map_no", "m"))
    starts = F.transform(F.col("m.blocks"), lambda b, i: F.aggregate(F.slice(F.col("m.blocks"), F.lit(1), i), F.lit(0).cast("bigint"), lambda a, c: a + c["base_length"]))
    ops = F.flatten(F.transform(F.col("m.blocks"), lambda b, i: F.transform(b["misms"], lambda o: F.struct(o["type"].alias("type"), (o["pos"] + F.get(starts, i)).alias("read_pos"), o["base"].alias("base"), o["size"].alias("size")))))
    x = x.select(*keep, "map_no", "read", "quals", F.explode(ops).alias("o")).select(*keep, "map_no", "read", "quals", "o.*")
    at = F.col("read_pos").cast("int")
    return x.withColumn("read_base", F.substring("read", at + 1, F.lit(1))).withColumn("prev_base", F.when(at > 0, F.substring("read", at, F.lit(1)))).withColumn("next_base", F.substring("read", at + 2, F.lit(1))).withColumn("qual", F.ascii(F.substring("quals", at + 1, F.lit(1)))).drop("read", "quals")


def population(rows: DataFrame, template: str, seq: str) -> DataFrame:
    """``template, n_maps, diversity, dominant``: distinct sequences and the share of the most frequent one, from counts
    per template and sequence (partial sums first, so a template with a third of all rows is no single task)."""
    c = rows.groupBy(template, seq).agg(F.count("*").alias("n"))
    return c.groupBy(template).agg(F.sum("n").alias("n_maps"), F.count("*").alias("diversity"), F.max("n").alias("dominant"))


def to_json_report(stats: DataFrame) -> DataFrame:
    """One JSON text per metric: its buckets and values."""
    x = stats.groupBy("metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "value")))).alias("m"))
    return x.select("metric", F.to_json("m").alias("json"))


# ---- duplicates -----------------------------------------------------------------------------------------------------


def pair_classes(rows: DataFrame, template: str, end: str, seq: str, strand: str) -> DataFrame:
    """``kind, n`` of templates with one mapping of either end: DS on different strands of a sequence, SS on the same
    one, MM on different sequences. One grouped pass; a template with any number of mappings is one row of sums."""
    first, second = F.col(end) == 1, F.col(end) == 2
    only = lambda c, e: F.max(F.when(e, F.col(c)))
    g = rows.groupBy(template).agg(F.count(F.when(first, 1)).alias("_n1"), F.count(F.when(second, 1)).alias("_n2"), only(seq, first).alias("_q1"), only(seq, second).alias("_q2"), only(strand, first).alias("_s1"), only(strand, second).alias("_s2"))
    kind = F.when(F.col("_q1") != F.col("_q2"), "MM").when(F.col("_s1") == F.col("_s2"), "SS").otherwise("DS")
    return g.where("_n1 = 1 and _n2 = 1").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def duplicate_classes(rows: DataFrame, keys: list[str], tile: str, strand: str) -> DataFrame:
    """Pairs of rows at one location by class: same tile and strand, same tile, same strand, neither; and group sizes.

    From counts per location, tile and strand, so pairs are computed, never listed.
    """
    c = rows.groupBy(*keys, tile).agg(F.sum((F.col(strand) == "+").cast("bigint")).alias("_p"), F.sum((F.col(strand) != "+").cast("bigint")).alias("_m"))
    half = lambda x: x * (x - 1) / 2
    g = c.groupBy(*keys).agg(
        F.sum(F.col("_p") + F.col("_m")).alias("k"), F.sum(half(F.col("_p")) + half(F.col("_m"))).alias("a"), F.sum(F.col("_p") * F.col("_m")).alias("b"),
        F.sum("_p").alias("ps"), F.sum("_m").alias("ms"), F.sum(F.col("_p") * F.col("_p") + F.col("_m") * F.col("_m")).alias("sq"),
    )
    cross_same = (F.col("ps") * F.col("ps") + F.col("ms") * F.col("ms") - F.col("sq")) / 2
    cross_diff = F.col("ps") * F.col("ms") - F.col("b")
    return g.groupBy("k").agg(F.count("*").alias("groups"), F.sum("a").cast("bigint").alias("same_tile_strand"), F.sum("b").cast("bigint").alias("same_tile"), F.sum(cross_same).cast("bigint").alias("same_strand"), F.sum(cross_diff).cast("bigint").alias("neither"))


def duplicate_rate(classes: DataFrame, total: int | None = None) -> dict[str, float]:
    """Duplicate rate, optical share and estimated number of fragments, from the small table of duplicate classes."""
    import math

    s = classes.agg(F.sum("groups").alias("g"), F.sum(F.col("groups") * F.col("k")).alias("n"), *(F.sum(c).alias(c) for c in ("same_tile_strand", "same_tile", "same_strand", "neither"))).first()
    a, b, c, d = (float(s[x] or 0) for x in ("same_tile_strand", "same_tile", "same_strand", "neither"))
    if not s["n"] or not a + b + c + d:
        return {"duplicate_rate": 0.0, "optical": 0.0, "fragments": 0.0}
    tot = float(total or s["n"])
    rate = 1.0 - float(s["g"]) / float(s["n"])
    # Pairs of one tile beyond what the strands of pairs across tiles lead to expect are optical.
    beyond = 1.0 - b * c / (a * d) if a * d > 0 else 1.0
    optical = a * beyond / (a + b + c + d)
    distinct = tot * (1.0 - (1.0 - optical) * rate)

    # Drawing tot reads from n fragments shows n * (1 - (1 - 1/n) ** tot) of them; the n that shows ``distinct`` is found by
    # halving the interval, on a logarithmic scale.
    def shown(n: float) -> float:
        return -n * math.expm1(tot * math.log1p(-1.0 / n))

    lo, hi = math.log(max(distinct, 1.0) + 1e-9), math.log(tot) + 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if shown(math.exp(mid)) < distinct else (lo, mid)
    return {"duplicate_rate": rate, "optical": optical, "fragments": math.floor(math.exp(hi) + 0.5)}
