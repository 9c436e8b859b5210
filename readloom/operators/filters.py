"""Predicates over templates, filters over their mappings, and the staged filter pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M
from readloom.functions import sequence as S
from readloom.operators import templates as T

# ---- predicates over whole templates --------------------------------------------------------------------------------


def mapped(c: Column | None = None) -> Column:
    return C.is_mapped(F.col("counters") if c is None else c, F.col("not_unique"))


def unique_at(level: int) -> Column:
    """Unmapped templates pass; mapped ones need a uniqueness degree of at least ``level``."""
    return ~mapped() | (C.uniq_degree(F.col("counters")) >= level)


def strictly_unique(level: int) -> Column:
    """A level over 0 and of at least ``level`` (level 0 never passes)."""
    lv = C.level(F.col("counters"))
    return (lv > 0) & (lv >= level)


def read_length_between(lo: float, hi: float) -> Column:
    n = F.length("read")
    return (n >= S.proportion(lo, n)) & (n <= S.proportion(hi, n))


def maps_between(lo: int, hi: int) -> Column:
    return F.size("maps").between(lo, hi)


def score_or_phred(m: Column, phred: Column | None = None) -> Column:
    """The quality a mapping is filtered by: its Phred score where the record tells one (255 is none), else its own score."""
    own = F.coalesce(m["score"], F.lit(0).cast("bigint"))
    return own if phred is None else F.coalesce(F.when(phred != 255, phred.cast("bigint")), own)


def contains_map(maps: Column, key: Column) -> Column:
    """Whether a mapping strictly equal to the one with ``key`` is there."""
    return F.exists(maps, lambda m: M.map_key(m) == key)


def same_read(tag1: Column, pair1: Column, tag2: Column, pair2: Column) -> Column:
    return (tag1 == tag2) & (pair1 == pair2)


# ---- filters over the mappings of a template ------------------------------------------------------------------------


def keep_where(df: DataFrame, cond) -> DataFrame:
    return df.withColumn("maps", F.filter("maps", cond))


def on_sequences(df: DataFrame, names: list[str]) -> DataFrame:
    return keep_where(df, lambda m: m["seq_name"].isin(*names))


def strata_after_best(df: DataFrame, k: float) -> DataFrame:
    """Mappings in order until the first whose distance exceeds the least matching stratum by more than ``k``, which may
    be a share of the read."""
    best = F.array_min(T.distances(F.col("maps"))) + S.proportion(k, F.length("read"))
    bad = F.transform("maps", lambda m: M.global_distance(m["blocks"]) > best)
    at = F.array_position(bad, True)
    return df.withColumn("maps", F.when(at > 0, F.slice("maps", F.lit(1), (at - 1).cast("int"))).otherwise(F.col("maps")))


def distance_between(df: DataFrame, lo: float, hi: float, splits: bool = True) -> DataFrame:
    d = M.global_distance if splits else M.no_split_distance
    n = F.length("read")
    return keep_where(df, lambda m: d(m["blocks"]).between(S.proportion(lo, n), S.proportion(hi, n)))


def levenshtein_between(df: DataFrame, lo: float, hi: float) -> DataFrame:
    n = F.length("read")
    return keep_where(df, lambda m: M.levenshtein(m["blocks"]).between(S.proportion(lo, n), S.proportion(hi, n)))


def on_strand(df: DataFrame, strand: str) -> DataFrame:
    return keep_where(df, lambda m: m["strand"] == strand)


def score_in(df: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Mappings whose score lies in any of the ranges (no score counts as 0). Templates of SAM records have a column
    ``phreds``, a Phred score per mapping, which goes before the score."""
    phreds = F.col("phreds") if "phreds" in df.columns else None

    def ok(m, i):
        cond = F.lit(False)
        for lo, hi in ranges:
            cond = cond | score_or_phred(m, None if phreds is None else F.get(phreds, i)).between(lo, hi)
        return cond

    if phreds is None:
        return df.withColumn("maps", F.filter("maps", ok))
    both = F.filter(F.transform("maps", lambda m, i: F.struct(ok(m, i).alias("ok"), m.alias("m"), F.get(phreds, i).alias("p"))), lambda x: x["ok"])
    x = df.withColumn("_both", both)
    return x.withColumn("maps", F.transform("_both", lambda b: b["m"])).withColumn("phreds", F.transform("_both", lambda b: b["p"])).drop("_both")


def mismatch_quality(m: Column, quals: Column, mode: str = "last") -> Column:
    """Quality code at the last mismatch of a mapping (``mode='sum'``: of all of them added up)."""
    starts = lambda bs, i: F.aggregate(F.slice(bs, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, b: a + b["base_length"])
    at = F.flatten(F.transform(m["blocks"], lambda b, i: F.transform(F.filter(b["misms"], lambda o: o["type"] == "MISMS"), lambda o: o["pos"] + starts(m["blocks"], i))))
    codes = F.transform(at, lambda p: F.ascii(F.substring(quals, p.cast("int") + 1, F.lit(1))).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(codes, zero, lambda a, x: a + x) if mode == "sum" else F.coalesce(F.try_element_at(codes, F.lit(-1)), zero)


def reduce_by_quality(df: DataFrame, delta: int, mode: str = "last") -> DataFrame:
    """Drops mappings whose mismatch quality is within ``delta`` of the best, but neither it nor zero."""
    q = lambda m: mismatch_quality(m, F.col("quals"), mode)
    top = F.array_max(F.transform("maps", q))
    return keep_where(df, lambda m: F.col("quals").isNull() | ~((q(m) != 0) & (q(m) != top) & (top - q(m) <= delta)))


def first_map(df: DataFrame) -> DataFrame:
    return df.withColumn("maps", F.slice("maps", 1, 1))


def keep_first_if_empty(df: DataFrame, before: Column) -> DataFrame:
    return df.withColumn("maps", F.when(F.size("maps") == 0, F.slice(before, 1, 1)).otherwise(F.col("maps")))


def keep_unique(df: DataFrame, stage) -> DataFrame:
    """A stage that leaves templates with at most one mapping alone and never empties one."""
    x = stage(df.withColumn("_was", F.col("maps")))
    kept = F.when((F.size("_was") <= 1) | (F.size("maps") == 0), F.col("_was")).otherwise(F.col("maps"))
    return x.withColumn("maps", kept).drop("_was")


def splits(df: DataFrame, only: bool) -> DataFrame:
    return keep_where(df, lambda m: M.is_split(m["blocks"]) if only else ~M.is_split(m["blocks"]))


def min_intron_length(df: DataFrame, n: int) -> DataFrame:
    return keep_where(df, lambda m: ~M.is_split(m["blocks"]) | (M.min_intron(m["blocks"]) >= n))


def min_block_length(df: DataFrame, n: int) -> DataFrame:
    return keep_where(df, lambda m: ~M.is_split(m["blocks"]) | (M.min_block(m["blocks"]) >= n))


def max_plain_mismatches(df: DataFrame, n: int) -> DataFrame:
    return keep_where(df, lambda m: M.n_mismatches(m["blocks"]) <= n)


def reduce_to_unique_strata(df: DataFrame, level: int) -> DataFrame:
    return df.withColumn("maps", F.when(C.uniq_degree(F.col("counters")) >= level, F.slice("maps", 1, 1)).otherwise(F.col("maps")))


def reduce_to_max_maps(df: DataFrame, n: int, paired: bool = False) -> DataFrame:
    """Too many mappings: none. A single end may have ``n``, a pair fewer than ``n``."""
    bad = F.size("maps") >= n if paired else F.size("maps") > n
    return df.withColumn("maps", F.when(bad, F.slice("maps", 1, 0)).otherwise(F.col("maps")))


def drop_duplicate_maps(df: DataFrame) -> DataFrame:
    """Strictly equal mappings once: the one of least distance, at the place of the first."""
    key = F.transform("maps", M.map_key)
    x = df.withColumn("_k", key)
    better = lambda m, i: F.exists(F.transform("maps", lambda o, j: F.struct(o.alias("o"), j.alias("j"))), lambda z: (F.get(F.col("_k"), z["j"]) == F.get(F.col("_k"), i)) & ((M.global_distance(z["o"]["blocks"]) < M.global_distance(m["blocks"])) | ((M.global_distance(z["o"]["blocks"]) == M.global_distance(m["blocks"])) & (z["j"] < i))))
    return x.withColumn("maps", F.filter("maps", lambda m, i: ~better(m, i))).drop("_k")


def prune_strata(df: DataFrame, min_strata: int, max_matches: int) -> DataFrame:
    """Mappings of the strata that stay under the caps."""
    kept = C.maps_under_caps(F.col("counters"), min_strata, max_matches)["strata"]
    return keep_where(df, lambda m: M.global_distance(m["blocks"]) < kept)


def max_output(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("maps", F.slice("maps", 1, n))


def hard_trim(df: DataFrame, left: int, right: int, min_length: int = 0) -> DataFrame:
    """Reads, qualities and mappings cut at both ends, where at least ``min_length`` bases remain; the cut is kept in ``trimmed``."""
    ok = F.length("read") - left - right >= max(min_length, 1)
    was = F.struct(F.left("read", F.lit(left)).alias("left"), F.right("read", F.lit(right)).alias("right"), F.left("quals", F.lit(left)).alias("left_quals"), F.right("quals", F.lit(right)).alias("right_quals"))
    x = df.withColumn("trimmed", F.when(ok, was)).withColumn("_ok", ok)
    cut = F.transform("maps", lambda m: m.withField("blocks", M.trim_blocks(m["blocks"], left, right, m["strand"])))
    cut = F.transform(cut, lambda m: m.withField("pos", F.array_min(F.transform(m["blocks"], lambda b: b["pos"]))))
    x = x.withColumn("maps", F.when(F.col("_ok"), cut).otherwise(F.col("maps")))
    for c in ("read", "quals"):
        x = x.withColumn(c, F.when(F.col("_ok"), S.hard_trim(F.col(c), left, right)).otherwise(F.col(c)))
    return x.drop("_ok")


def restore_trim(df: DataFrame) -> DataFrame:
    """Puts back what :func:`hard_trim` cut; mappings get the bases as DEL at their ends."""
    t = F.col("trimmed")
    n = lambda c: F.length(c).cast("bigint")
    back = F.transform("maps", lambda m: m.withField("blocks", M.restore_trim(m["blocks"], n(t["left"]), n(t["right"]))))
    x = df.withColumn("maps", F.when(t.isNotNull(), back).otherwise(F.col("maps")))
    x = x.withColumn("read", F.when(t.isNotNull(), F.concat(t["left"], F.col("read"), t["right"])).otherwise(F.col("read")))
    return x.withColumn("quals", F.when(t.isNotNull(), F.concat(t["left_quals"], F.col("quals"), t["right_quals"])).otherwise(F.col("quals"))).drop("trimmed")


# ---- the staged pipeline --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FilterOptions:
    """Options of :func:`filter_templates`; None or False leaves a filter out. Shares below 1 are of the read length."""

    no_penalty_for_splits: bool = False
    uniform: bool = False
    remove_qualities: bool = False
    add_qualities: bool = False
    mapped: bool = False
    unmapped: bool = False
    unique_level: int | None = None
    length: tuple[float, float] | None = None
    n_maps: tuple[int, int] | None = None
    trim: tuple[int, int] | None = None
    sequences: tuple[str, ...] = ()
    max_strata_after_best: float | None = None
    strata: tuple[float, float] | None = None
    levenshtein: tuple[float, float] | None = None
    strand: str | None = None
    scores: tuple[tuple[int, int], ...] = ()
    reduce_by_quality: int | None = None
    first_map: bool = False
    keep_first_map: bool = False
    keep_unique: bool = False
    only_splits: bool = False
    no_splits: bool = False
    min_intron: int | None = None
    min_block: int | None = None
    to_unique_strata: int | None = None
    to_max_maps: int | None = None
    prune: tuple[int, int] | None = None
    max_output: int | None = None
    extra: tuple = field(default=())

    def with_(self, **kw) -> FilterOptions:
        return replace(self, **kw)


#: Nothing but split mappings.
ONLY_SPLITS = FilterOptions(only_splits=True)


def rnaseq_options(min_intron: int = 0, min_block: int = 0, level: int = -1, max_strata: float = 0, max_maps: int = 0, **extra) -> FilterOptions:
    """The usual filter of RNA mappings; a parameter of 0 (-1 for the level) leaves its filter out."""
    return FilterOptions(min_intron=min_intron or None, min_block=min_block or None, to_unique_strata=level if level >= 0 else None, strata=(0, max_strata) if max_strata else None, to_max_maps=max_maps or None, keep_unique=True, **extra)


def filter_templates(df: DataFrame, o: FilterOptions) -> DataFrame:
    """The stages in their fixed order: recount, edits of the read, predicates, trim, mapping filters, split filters,
    reduction, pruning, recount. One chain of projections and filters, no shuffle."""
    x = df
    if o.no_penalty_for_splits:
        x = T.sort_maps(T.recount(x, False), False)
    if o.uniform:
        x = x.withColumn("read", S.uniform_read(F.col("read"))).where(F.length("read") > 0)
    if o.remove_qualities:
        x = x.withColumn("quals", F.lit(None).cast("string"))
    if o.add_qualities:
        x = x.withColumn("quals", F.coalesce("quals", F.expr("repeat('~', length(read))")))
    if o.mapped:
        x = x.where(mapped())
    if o.unmapped:
        x = x.where(~mapped())
    if o.unique_level is not None:
        x = x.where(unique_at(o.unique_level))
    if o.length:
        x = x.where(read_length_between(*o.length))
    if o.n_maps:
        x = x.where(maps_between(*o.n_maps))
    if o.trim:
        x = hard_trim(x, *o.trim)

    def per_mapping(y):
        y = y.withColumn("_was0", F.col("maps"))
        if o.sequences:
            y = on_sequences(y, list(o.sequences))
        if o.max_strata_after_best is not None:
            y = strata_after_best(y, o.max_strata_after_best)
        if o.strata:
            y = distance_between(y, *o.strata, splits=not o.no_penalty_for_splits)
        if o.levenshtein:
            y = levenshtein_between(y, *o.levenshtein)
        if o.strand:
            y = on_strand(y, o.strand)
        if o.scores:
            y = score_in(y, list(o.scores))
        if o.reduce_by_quality is not None:
            y = reduce_by_quality(y, o.reduce_by_quality)
        if o.first_map:
            y = first_map(y)
        if o.keep_first_map:
            y = keep_first_if_empty(y, F.col("_was0"))
        return y.drop("_was0")

    def per_split(y):
        if o.only_splits or o.no_splits:
            y = splits(y, o.only_splits)
        if o.min_intron is not None:
            y = min_intron_length(y, o.min_intron)
        if o.min_block is not None:
            y = min_block_length(y, o.min_block)
        return y

    for stage in (per_mapping, per_split, *o.extra):
        x = keep_unique(x, stage) if o.keep_unique else stage(x)
    x = T.recount(x)
    if o.to_unique_strata is not None:
        x = reduce_to_unique_strata(x, o.to_unique_strata)
    if o.to_max_maps is not None:
        x = reduce_to_max_maps(x, o.to_max_maps)
    if o.prune:
        x = prune_strata(T.recount(x), *o.prune)
    if o.max_output is not None:
        x = max_output(x, o.max_output)
    return T.recount(x)


# ---- pairs ----------------------------------------------------------------------------------------------------------


def pair_strands(df: DataFrame, allowed: list[str], s1: str = "strand1", s2: str = "strand2") -> DataFrame:
    """Pairs whose strands, written F and R, are one of ``allowed`` (FR, RF, FF, RR)."""
    letter = lambda c: F.when(F.col(c) == "+", "F").otherwise("R")
    return df.where(F.concat(letter(s1), letter(s2)).isin(*allowed))


def insert_sizes(df: DataFrame, lo: int, hi: int, size: str = "insert_size") -> DataFrame:
    """Pairs with an insert size in range; none counts as 0."""
    return df.where(F.coalesce(F.col(size), F.lit(0)).between(lo, hi))


def coherent_pairs(df: DataFrame, m1: str = "m1", m2: str = "m2") -> DataFrame:
    """Pairs whose ends agree on the junctions where they overlap."""
    return df.where(M.coherent(F.col(f"{m1}.blocks"), F.col(f"{m2}.blocks")))
