"""Column functions over reads and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTNacgtn", "TGCANtgcan"))


def is_dna(s: Column) -> Column:
    return s.rlike("^[ACGTN]+$")


def uniform_read(s: Column, strict: bool = False) -> Column:
    """Upper case, anything but ACGT(N) as N, and N runs at both ends cut off (``strict`` cuts lower case as well)."""
    t = s if strict else F.upper(s)
    return F.regexp_replace(F.regexp_replace(t, "[^ACGTN]", "N"), "^N+|N+$", "")


def proportion(p: float, length: Column) -> Column:
    """Up to 0: 0; from 1 on: the whole part of p; between: that share of the length, rounded down."""
    if p <= 0:
        return F.lit(0).cast("bigint")
    return F.lit(int(p)).cast("bigint") if p >= 1 else F.floor(F.lit(p) * length).cast("bigint")


def hard_trim(s: Column, left: int, right: int) -> Column:
    return F.substring(s, F.lit(left + 1), F.greatest(F.length(s) - left - right, F.lit(0)))


def trim_if(s: Column, left: int, right: int, min_length: int) -> Column:
    """Trim only if at least ``min_length`` bases remain."""
    return F.when(F.length(s) - left - right >= min_length, hard_trim(s, left, right)).otherwise(s)


def shift_qualities(q: Column, by: int) -> Column:
    """Qualities moved by ``by`` code points (31 from offset 33 to 64; 33 is what one old converter used)."""
    lo, hi = 33, 126
    src = "".join(chr(c) for c in range(lo, hi + 1) if lo <= c + by <= hi)
    return F.translate(q, src, "".join(chr(ord(c) + by) for c in src))


def deduce_offset(q: Column) -> Column:
    """33 if a character is under 59, else 64 if one is over 74, else null (either is possible)."""
    return F.when(q.rlike(r"[\x21-\x3a]"), F.lit(33)).when(q.rlike(r"[\x4b-\x7e]"), F.lit(64))


def average_quality(q: Column) -> Column:
    """Whole part of the mean character code; null for empty qualities."""
    codes = F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.when(F.length(q) > 0, F.floor(F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x) / F.length(q))).cast("bigint")


def chunks(s: Column, size: int, step: int, left: int = 0, right: int = 0, min_rest: int = 0) -> Column:
    """Pieces of ``size`` every ``step`` characters of the trimmed read; a last shorter piece if it has ``min_rest``."""
    n = F.length(s) - left - right
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda i: F.struct((i + left).alias("start"), F.substring(s, i + left + 1, F.least(F.lit(size), n - i)).alias("piece")))
    whole = F.filter(pieces, lambda p: F.length(p["piece"]) == size)
    rest = F.filter(pieces, lambda p: (F.length(p["piece"]) < size) & (F.length(p["piece"]) >= max(1, min_rest)))
    return whole if not min_rest else F.concat(whole, F.slice(rest, 1, 1))


def parse_tag(tag: Column) -> Column:
    """Name, pair (0, 1 or 2), the CASAVA part and the rest of a read tag."""
    first = F.split(tag, " ", 2)[0]
    rest = F.coalesce(F.get(F.split(tag, " ", 2), F.lit(1)), F.lit(""))
    casava = F.regexp_extract(rest, r"^([12]:[YN]:[0-9]+:[ACGTN0-9+]*)", 1)
    pair = F.when(first.rlike("/[12]$"), F.right(first, F.lit(1)).cast("int")).when(casava != "", F.left(casava, F.lit(1)).cast("int")).otherwise(F.lit(0))
    extra = F.trim(F.when(casava != "", F.regexp_replace(rest, r"^[12]:[YN]:[0-9]+:[ACGTN0-9+]*", "")).otherwise(rest))
    trims = lambda k: F.regexp_extract(rest, rf"{k}:Z:([0-9]+)", 1).try_cast("int")
    return F.struct(F.regexp_replace(first, "/[12]$", "").alias("name"), pair.alias("pair"), casava.alias("casava"), extra.alias("extra"), trims("lt").alias("left_trim"), trims("rt").alias("right_trim"), F.regexp_extract(rest, r"sr:Z:([0-9]+:[0-9]+)", 1).alias("segment"))


def parse_id(tag: Column) -> Column:
    """Machine, lane, tile and coordinates of an instrument tag ``machine[:run]:lane:tile:x:y``."""
    p = F.split(F.substring_index(tag, " ", 1), ":")
    n = F.size(p)
    at = lambda k: F.when(n >= 5, F.get(p, n - k))
    return F.struct(F.get(p, F.lit(0)).alias("machine"), at(4).alias("lane"), at(3).try_cast("int").alias("tile"), at(2).try_cast("bigint").alias("x"), F.regexp_replace(at(1), "/[12]$", "").try_cast("bigint").alias("y"))


def sam_qname(tag: Column) -> Column:
    return F.substring_index(tag, " ", 1)
