"""Column functions over strata counters: ``ARRAY<BIGINT>`` whose index is the distance of a stratum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "array<bigint>"
#: A run ``nxm`` of more strata than this is no counter of a read and reads as null.
MAX_RUN = 100_000


def _long(v) -> Column:
    return F.lit(v).cast("bigint")


def parse_counters(text: Column) -> Column:
    """Counters of MAP text: ``n`` and ``nxm`` (m times n) separated by ``:`` or ``+``; ``!`` and null give an empty array.
    A text with a run of more than ``MAX_RUN`` strata gives null and takes no room."""

    def one(t):
        m = F.get(F.split(t, "x"), F.lit(1))
        many = F.when(m.isNull(), F.lit(1)).when(m.rlike("^0*[0-9]{1,9}$") & (m.try_cast("bigint") <= MAX_RUN), m.try_cast("int"))
        return F.when(many.isNotNull(), F.array_repeat(F.get(F.split(t, "x"), F.lit(0)).try_cast("bigint"), many))

    parsed = F.flatten(F.transform(F.split(text, "[:+]"), one))
    return F.when(text.isNull() | text.isin("!", ""), F.array().cast(ZERO)).otherwise(parsed)


def parse_mcs(text: Column) -> Column:
    """Maximum complete strata: how many counters stand before ``+``; all of them if there is none, null for ``!``."""
    return F.when(text == "!", None).otherwise(F.size(parse_counters(F.split(text, r"\+")[0])))


def not_unique(text: Column) -> Column:
    """The flag ``!``: too many mappings to count."""
    return F.coalesce(text == "!", F.lit(False))


def render_counters(c: Column, mcs: Column | None = None, compact: bool = True) -> Column:
    """MAP text of counters, with ``+`` after ``mcs`` strata and runs of two or more zeros written ``0xN``."""
    plain = F.array_join(c.cast("array<string>"), ":")
    if mcs is not None:
        head, tail = F.slice(c, F.lit(1), mcs), F.slice(c, mcs + 1, F.greatest(F.size(c) - mcs, F.lit(0)))
        h, t = (F.array_join(x.cast("array<string>"), ":") for x in (head, tail))
        plain = F.when(mcs.isNull() | (mcs <= 0) | (mcs >= F.size(c)), plain).otherwise(F.concat(h, F.lit("+"), t))
    if compact:
        # Each run of zeros becomes one token, its length counted from the text.
        parts = F.regexp_extract_all(plain, F.lit(r"((?:(?<![0-9])0(?![0-9]):)+0(?![0-9])|[0-9]+|[:+])"), F.lit(1))
        short = F.transform(parts, lambda p: F.when(p.contains(":0"), F.concat(F.lit("0x"), F.floor((F.length(p) + 1) / 2).cast("string"))).otherwise(p))
        plain = F.array_join(short, "")
    return F.when(F.size(c) == 0, F.lit("0")).otherwise(plain)


def reduce_sum(c: Column) -> Column:
    return F.aggregate(c, _long(0), lambda a, x: a + x)


def set_counter(c: Column, stratum: Column, value: Column) -> Column:
    """Counters with one stratum set; the array grows with zeros as needed."""
    grown = F.concat(c, F.array_repeat(_long(0), F.greatest(stratum + 1 - F.size(c), F.lit(0)).cast("int")))
    return F.transform(grown, lambda x, i: F.when(i == stratum, value.cast("bigint")).otherwise(x))


def add_counter(c: Column, stratum: Column, by: int = 1) -> Column:
    return set_counter(c, stratum, F.coalesce(F.get(c, stratum.cast("int")), _long(0)) + by)


def _positive(c: Column) -> Column:
    """Indices of non-zero counters."""
    return F.filter(F.transform(c, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def min_matching_stratum(c: Column) -> Column:
    """1 + index of the first non-zero counter; null if there is none."""
    return F.get(_positive(c), F.lit(0)).cast("bigint") + 1


def next_matching_stratum(c: Column, begin: Column) -> Column:
    """Index and count of the first non-zero counter from ``begin`` on, or null."""
    i = F.get(F.filter(_positive(c), lambda k: k >= begin), F.lit(0))
    return F.when(i.isNotNull(), F.struct(i.cast("bigint").alias("stratum"), F.get(c, i).alias("maps")))


def min_mismatches(c: Column) -> Column:
    """Index of the first non-zero counter, -1 if unmapped."""
    return F.coalesce(min_matching_stratum(c) - 1, _long(-1))


def uniq_degree(c: Column) -> Column:
    """Zero strata behind a first stratum of exactly one mapping; -1 if the first is not one or there is none."""
    nz = _positive(c)
    first, second = F.get(nz, F.lit(0)), F.get(nz, F.lit(1))
    return F.when(first.isNull() | (F.get(c, first) != 1), _long(-1)).otherwise((F.coalesce(second, F.size(c)) - first - 1).cast("bigint"))


def level(c: Column, max_level: int | None = None) -> Column:
    """As :func:`uniq_degree`, but the scan stops once it has seen ``max_level`` zero strata."""
    u = uniq_degree(c)
    return u if max_level is None else F.when(u >= 0, F.least(u, _long(max_level))).otherwise(u)


def maps_under_caps(c: Column, min_strata: int, max_matches: int) -> Column:
    """Strata and mappings kept when scanning stops before the stratum that would exceed ``max_matches``, but not
    before more than ``min_strata`` matching strata were entered."""
    start = F.struct(_long(0).alias("i"), _long(0).alias("acc"), _long(0).alias("strata"), F.lit(False).alias("stop"))

    def step(a, x):
        strata = a["strata"] + F.when((x != 0) | (a["strata"] != 0), 1).otherwise(0)
        stop = a["stop"] | ((a["acc"] + x > max_matches) & (strata > min_strata))
        go = ~stop
        return F.struct(F.when(go, a["i"] + 1).otherwise(a["i"]).alias("i"), F.when(go, a["acc"] + x).otherwise(a["acc"]).alias("acc"), F.when(a["stop"], a["strata"]).otherwise(strata).cast("bigint").alias("strata"), stop.alias("stop"))

    return F.aggregate(c, start, step, lambda a: F.struct(a["i"].alias("strata"), a["acc"].alias("maps")))


def is_mapped(c: Column, many: Column | None = None) -> Column:
    hit = F.exists(c, lambda x: x > 0)
    return hit if many is None else hit | many


def is_unmapped_up_to(c: Column, k: int) -> Column:
    """No mapping in the strata 0..k."""
    return ~F.exists(F.slice(c, 1, k + 1), lambda x: x > 0)


def counters_of(distances: Column) -> Column:
    """Counters of an array of distances (the recount after mappings were filtered)."""
    d = distances
    return F.when(F.size(d) == 0, F.array().cast(ZERO)).otherwise(
        F.transform(F.sequence(F.lit(0), F.array_max(d).cast("int")), lambda i: F.size(F.filter(d, lambda x: x == i)).cast("bigint"))
    )
