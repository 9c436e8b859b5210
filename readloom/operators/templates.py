"""Templates: one row per record with its mappings nested, and the views that explode them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M


def from_map_lines(lines: DataFrame, line: str = "raw_line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Templates of MAP text: ``keep…, tag, read, quals, counters_text, counters, mcs, not_unique, maps``.

    Lines with 4 columns have no qualities (null). Lines that are no MAP record are left out here; the record parser
    says why. Everything stays in built-in expressions.
    """
    c = F.split(F.col(line), "\t")
    n = F.size(c)
    col = lambda i: F.try_element_at(c, F.lit(i))
    text = col(-2)
    x = lines.where(n.isin(4, 5) & col(2).rlike("^[ACGTN]+$") & text.rlike(f"^{M.COUNTERS_RE}$") & col(-1).rlike(f"^{M.MAPS_RE}$"))
    return x.select(
        *keep, col(1).alias("tag"), col(2).alias("read"), F.when(n == 5, col(3)).alias("quals"), text.alias("counters_text"), C.parse_counters(text).alias("counters"),
        C.parse_mcs(text).alias("mcs"), C.not_unique(text).alias("not_unique"), M.parse_maps(col(-1)).alias("maps"),
    )


def distances(maps: Column, splits: bool = True) -> Column:
    return F.transform(maps, lambda m: M.global_distance(m["blocks"]) if splits else M.no_split_distance(m["blocks"]))


def recount(df: DataFrame, splits: bool = True) -> DataFrame:
    """Counters as the mappings say (with or without a penalty per splice)."""
    return df.withColumn("counters", C.counters_of(distances(F.col("maps"), splits)))


def sort_maps(df: DataFrame, splits: bool = True) -> DataFrame:
    """Mappings by distance ascending, score descending, then as they were."""
    d = M.global_distance if splits else M.no_split_distance
    keyed = F.transform("maps", lambda m, i: F.struct(d(m["blocks"]).alias("d"), (-F.coalesce(m["score"], F.lit(0).cast("bigint"))).alias("s"), i.alias("i"), m.alias("m")))
    # The struct order of distance, score and position is the sort order.
    plain = F.array_sort(F.transform(keyed, lambda k: F.struct(k["d"].alias("d"), k["s"].alias("s"), k["i"].alias("i"))))
    return df.withColumn("maps", F.transform(plain, lambda k: F.get(F.col("maps"), k["i"])))


def map_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per mapping: ``keep…, map_no, m``."""
    return df.select(*keep, F.posexplode("maps").alias("map_no", "m"))


def block_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per block of each mapping, with its bounds."""
    x = map_rows(df, keep).select(*keep, "map_no", F.col("m.seq_name").alias("seq_name"), F.col("m.strand").alias("strand"), F.size("m.blocks").alias("n_blocks"), F.posexplode("m.blocks").alias("block_no", "b"))
    return x.select(*keep, "map_no", "seq_name", "strand", "n_blocks", "block_no", F.col("b.pos").alias("start_pos"), (F.col("b.pos") + M.block_length(F.col("b")) - 1).alias("end_pos"), "b")


def texts(maps: Column) -> Column:
    """The texts of mappings as one MAP list."""
    return F.when(F.size(maps) == 0, F.lit("-")).otherwise(F.array_join(F.transform(maps, lambda m: m["txt"]), ","))
