"""Set operations and merges of mapping sets: per record over nested mappings, and file against file by tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M
from readloom.operators import templates as T
from readloom.plans.prefix import carried, scan


def _keyed(maps: Column, key, distance) -> Column:
    return F.transform(maps, lambda m: F.struct(key(m).alias("k"), distance(m).alias("d"), m.alias("m")))


def _both(a: Column, b: Column, key, distance, make) -> Column:
    """``make`` of the mappings of both sides with their keys and distances, which are bound once, not computed per pair."""
    sides = F.array(F.struct(_keyed(a, key, distance).alias("a"), _keyed(b, key, distance).alias("b")))
    return F.transform(sides, lambda s: F.transform(make(s["a"], s["b"]), lambda x: x["m"]))[0]


def _union(a: Column, b: Column) -> Column:
    better = lambda x: F.get(F.filter(b, lambda y: (y["k"] == x["k"]) & (y["d"] < x["d"])), F.lit(0))
    return F.concat(F.transform(a, lambda x: F.coalesce(better(x), x)), F.filter(b, lambda y: ~F.exists(a, lambda x: x["k"] == y["k"])))


def _stratum(m: Column) -> Column:
    return M.global_distance(m["blocks"])


def union_maps(a: Column, b: Column) -> Column:
    """Mappings of a, then those of b that are new; a mapping in both is the one of smaller distance."""
    return _both(a, b, M.map_key, _stratum, _union)


def subtract_maps(a: Column, b: Column) -> Column:
    return _both(a, b, M.map_key, lambda m: F.lit(0), lambda x, y: F.filter(x, lambda m: ~F.exists(y, lambda o: o["k"] == m["k"])))


def intersect_maps(a: Column, b: Column) -> Column:
    return _both(a, b, M.map_key, lambda m: F.lit(0), lambda x, y: F.filter(x, lambda m: F.exists(y, lambda o: o["k"] == m["k"])))


def subtract_within(a: Column, b: Column, tolerance: float | Column) -> Column:
    """As :func:`subtract_maps` with tolerant equality, which is not transitive and hence compared pair by pair."""
    return F.filter(a, lambda m: ~F.exists(b, lambda o: M.same_within(m, o, tolerance)))


def intersect_within(a: Column, b: Column, tolerance: float | Column) -> Column:
    return F.filter(a, lambda m: F.exists(b, lambda o: M.same_within(m, o, tolerance)))


def pair_key(p: Column) -> Column:
    """Hashable form of the strict equality of paired mappings: that of both ends."""
    end = lambda m: F.coalesce(M.map_key(m), F.lit(""))
    return F.concat(end(p["m1"]), F.lit("::"), end(p["m2"]))


def union_pairs(a: Column, b: Column) -> Column:
    """As :func:`union_maps` for paired mappings."""
    from readloom.operators.pairs import distance

    return _both(a, b, pair_key, distance, _union)


def pair_union(master: DataFrame, slave: DataFrame, key: str = "tag") -> DataFrame:
    """Records of the master with the paired mappings of both; records only the master has pass through."""
    from readloom.operators.pairs import recount

    b = slave.select(F.col(key).alias("_key"), F.col("mmaps").alias("_other"), F.col("mcs").alias("_mcs"))
    x = master.join(b, master[key] == b["_key"], "left").withColumn("_other", F.coalesce("_other", F.slice("mmaps", 1, 0)))
    return recount(x.withColumn("mmaps", union_pairs(F.col("mmaps"), F.col("_other"))).withColumn("mcs", F.least("mcs", "_mcs")).drop("_key", "_other", "_mcs"))


def _sides(master: DataFrame, slave: DataFrame, key: str, how: str) -> DataFrame:
    b = slave.select(F.col(key).alias("_key"), F.col("maps").alias("maps2"), F.col("mcs").alias("mcs2"))
    empty = F.slice(F.col("maps"), 1, 0)
    x = master.join(b, master[key] == b["_key"], how)
    return x.withColumn("maps2", F.coalesce("maps2", empty)).drop("_key")


def file_union(master: DataFrame, slave: DataFrame, key: str = "tag") -> DataFrame:
    """Records of the master with the mappings of both; records only the master has pass through."""
    x = _sides(master, slave, key, "left").withColumn("maps", union_maps(F.col("maps"), F.col("maps2"))).withColumn("mcs", F.least("mcs", "mcs2"))
    return T.recount(x.drop("maps2", "mcs2"))


def _share(tolerance: float) -> Column | float:
    """A tolerance of up to 1 is a share of the read's length."""
    return F.floor(F.length("read") * F.lit(float(tolerance))) if tolerance <= 1 else tolerance


def file_difference(master: DataFrame, slave: DataFrame, key: str = "tag", tolerance: float | None = None) -> DataFrame:
    """Records of the master with the mappings the slave lacks; equal within ``tolerance`` bases, or within that share of
    the read if it is at most 1."""
    x = _sides(master, slave, key, "left")
    y = subtract_maps(F.col("maps"), F.col("maps2")) if tolerance is None else subtract_within(F.col("maps"), F.col("maps2"), _share(tolerance))
    return T.recount(x.withColumn("maps", y).drop("maps2", "mcs2"))


def file_intersection(master: DataFrame, slave: DataFrame, key: str = "tag", tolerance: float | None = None) -> DataFrame:
    """Records both have, with the mappings both have."""
    x = _sides(master, slave, key, "inner")
    y = intersect_maps(F.col("maps"), F.col("maps2")) if tolerance is None else intersect_within(F.col("maps"), F.col("maps2"), _share(tolerance))
    return T.recount(x.withColumn("maps", y).drop("maps2", "mcs2"))


def file_join(master: DataFrame, slave: DataFrame, key: str = "tag") -> DataFrame:
    """``key, counters_a, counters_b, maps_a, maps_b`` of records both have; counters are those of the mappings."""
    a, b = F.col("maps"), F.col("maps2")
    return _sides(master, slave, key, "inner").select(key, _counted(a).alias("counters_a"), _counted(b).alias("counters_b"), T.texts(a).alias("maps_a"), T.texts(b).alias("maps_b"))


def _counted(maps: Column) -> Column:
    return C.render_counters(C.counters_of(T.distances(maps)), compact=False)


def file_compare(master: DataFrame, slave: DataFrame, key: str = "tag") -> DataFrame:
    """``key, only_a, only_b, both`` of records both have, each with its counters."""
    a, b = F.col("maps"), F.col("maps2")
    sets = {"only_a": subtract_maps(a, b), "only_b": subtract_maps(b, a), "both": intersect_maps(a, b)}
    return _sides(master, slave, key, "inner").select(key, *(_counted(x).alias(f"counters_{n}") for n, x in sets.items()), *(T.texts(x).alias(n) for n, x in sets.items()))


def merge(master: DataFrame, *slaves: DataFrame, key: str = "tag", same_reads: bool = False) -> DataFrame:
    """Master with the mappings of each slave in turn. With ``same_reads`` the inputs must hold the same records, and a
    record that one of them lacks is an error; :func:`unmatched` tells them beforehand."""
    out = master
    for s in slaves:
        if same_reads:
            b = s.select(F.col(key).alias("_key"), F.col("maps").alias("maps2"), F.col("mcs").alias("mcs2"))
            x = out.join(b, out[key] == b["_key"], "full")
            lost = F.col(key).isNull() | F.col("_key").isNull()
            name = F.coalesce(F.col(key).cast("string"), F.col("_key").cast("string"), F.lit("null"))
            both = F.when(lost, F.raise_error(F.concat(F.lit("inputs of the same reads differ at "), name))).otherwise(union_maps(F.col("maps"), F.col("maps2")))
            out = T.recount(x.withColumn("maps", both).withColumn("mcs", F.least("mcs", "mcs2")).drop("_key", "maps2", "mcs2"))
        else:
            out = file_union(out, s, key)
    return out


def unmatched(master: DataFrame, slave: DataFrame, key: str = "tag") -> DataFrame:
    """Records of the master that the slave lacks: what a merge of the same reads would complain about."""
    return master.join(slave.select(key), key, "left_anti")


def compact(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Length, counters and the sequences of the mappings."""
    return df.select(*keep, F.length("read").alias("length"), F.array_join(F.col("counters").cast("array<string>"), ":").alias("counters"), F.array_join(F.transform("maps", lambda m: m["seq_name"]), ",").alias("sequences"))


def rank_within(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``row_no``, the place from 0 of each row in its group by ``order``.

    Rows are range-sorted over all partitions and counted per partition and group, so a group of any size is spread;
    ties in ``order`` get places in no set order. Null is a group like any other.
    """
    r = carried(scan(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, "_one"), group, _before=(F.sum, "_one"))
    return r.withColumn("row_no", F.coalesce("_before", F.lit(0)) + F.col("_scan") - 1).drop("_one", "_pid", "_scan", "_prev", "_before")


def interleave(*inputs: DataFrame, order: str) -> DataFrame:
    """Inputs round robin: the first record of each, then the second of each, by rank in ``order``."""
    out = None
    for i, x in enumerate(inputs):
        y = x.withColumn("file_no", F.lit(i))
        out = y if out is None else out.unionByName(y)
    return rank_within(out, ["file_no"], [order])


def concat(*inputs: DataFrame) -> DataFrame:
    out = inputs[0]
    for x in inputs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def group_chunks(df: DataFrame, segment: str = "segment", tag: str = "tag") -> DataFrame:
    """Chunks of segmented reads (``segment`` is ``number:total``) put together by tag: mappings of all chunks, and whether
    the numbers run from 1 to the total. A tag has as many rows as its read has chunks."""
    n = F.split(segment, ":")
    x = df.withColumn("_n", F.get(n, F.lit(0)).try_cast("int")).withColumn("_t", F.get(n, F.lit(1)).try_cast("int"))
    g = x.groupBy(tag).agg(F.array_sort(F.collect_list(F.struct("_n", "maps"))).alias("c"), F.max("_t").alias("total"))
    numbers = F.transform("c", lambda s: s["_n"])
    return g.select(tag, F.size("c").alias("chunks"), (numbers == F.sequence(F.lit(1), F.greatest("total", F.lit(1)))).alias("complete"), F.flatten(F.transform("c", lambda s: s["maps"])).alias("maps"))
