"""Base qualities recorded on different scales, converted to Phred with offset 33.

Spellings of a scale are mapped once per distinct spelling: its phrases are looked up in an inverted index from character
trigrams to the published names of the scales, a weighted edit distance verifies the candidates, and the resulting alias
dictionary is joined to all rows. There is no list of spellings. The conversion itself is a ``translate`` on the JVM side.
"""

from __future__ import annotations

import math
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.plans.runtime import materialize, rows_at_most

# Published names of FASTQ variants and the scale each one means.
P33, P64, SOLEXA, NUMBERS, ERRORS = "phred33", "phred64", "solexa64", "numbers", "errors"
NAMES = {
    P33: ["sanger", "phred 33", "offset 33", "ascii 33", "base 33", "start at !", "illumina 1.8", "illumina 1.9"],
    P64: ["phred 64", "offset 64", "ascii 64", "base 64", "start at @", "illumina", "illumina 1.3", "illumina 1.4", "illumina 1.5", "illumina 1.6", "illumina 1.7"],
    SOLEXA: ["solexa", "log odds", "illumina 1.0", "illumina 1.1", "illumina 1.2"],
    NUMBERS: ["qual", "decimal", "numbers", "numeric"],
    ERRORS: ["error probability", "error prob", "p error", "base error"],
}
#: Lowest and highest character possible under a scale: Phred 0..45, Solexa -5..45.
CHARS = {P33: (33, 78), P64: (64, 109), SOLEXA: (59, 109)}
#: Weighted distance over the greater weight that still counts as the same name.
MAX_DISTANCE = 0.18
#: Words of a phrase, at most.
MAX_WORDS = 4
#: Known spellings up to this many are broadcast; beyond it rows meet them in a join, hot spellings spread over SALTS.
MAX_SENT = 100_000
SALTS = 16
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_LIST = rf"^\s*{_NUMBER}(?:\s*[,;:|\s]\s*{_NUMBER})+\s*$"


def grams(s: str) -> set[str]:
    t = f"  {re.sub(_SIGNS, ' ', s)} "
    return {t[i : i + 3] for i in range(len(t) - 2)}


_SIGNS = r"[^a-z0-9!@]+"
_WORDS = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?|[!@]")


def _weight(c: str) -> float:
    return 4.0 if c.isdigit() or c in "!@" else 0.25 if not c.isalnum() else 1.0


def weight(s: str) -> float:
    return sum(map(_weight, s))


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which digits and the marks ``!`` and ``@`` weigh 4, letters 1, blanks and signs a quarter."""
    prev = [0.0]
    for c in b:
        prev.append(prev[-1] + _weight(c))
    for x in a:
        cur = [prev[0] + _weight(x)]
        for j, y in enumerate(b, 1):
            sub = 0.0 if x == y else max(_weight(x), _weight(y))
            cur.append(min(prev[j] + _weight(x), cur[j - 1] + _weight(y), prev[j - 1] + sub))
        prev = cur
    return prev[-1]


class AliasIndex:
    """Trigram index over the published names; ``find`` verifies its candidates by the weighted distance."""

    def __init__(self, names: dict[str, list[str]] = NAMES):
        self.names = [(n, scale, weight(n), grams(n)) for scale, many in names.items() for n in many]
        self.index: dict[str, list[int]] = {}
        for i, (*_, g) in enumerate(self.names):
            for x in g:
                self.index.setdefault(x, []).append(i)

    def find(self, text: str | None) -> str | None:
        """The scale that ``text`` names, or None.

        Every phrase of up to MAX_WORDS words is looked up. The heaviest name found decides, less its distance, so that a
        name with its version goes before the bare one. Solexa scores have offset 64, so a text that names both means
        Solexa. A text that names two other scales alike names none.
        """
        if not text:
            return None
        low = text.lower()
        words = list(_WORDS.finditer(low))
        best: dict[str, float] = {}
        seen: set[str] = set()
        for i, m in enumerate(words):
            for n in words[i : i + MAX_WORDS]:
                phrase = low[m.start() : n.end()]
                if phrase not in seen:
                    seen.add(phrase)
                    for d, w, scale in self.candidates(phrase):
                        best[scale] = max(best.get(scale, 0.0), w - 2 * d)
        if SOLEXA in best:
            best.pop(P64, None)
        top = max(best.values(), default=0.0)
        found = [s for s, v in best.items() if v == top]
        return found[0] if len(found) == 1 else None

    def candidates(self, phrase: str) -> list[tuple[float, float, str]]:
        """Distance, weight and scale of the names that ``phrase`` spells."""
        g = grams(phrase)
        shared: dict[int, int] = {}
        for x in g:
            for i in self.index.get(x, ()):
                shared[i] = shared.get(i, 0) + 1
        out = []
        for i, k in shared.items():
            n, scale, w, own = self.names[i]
            if 2 * k >= 0.4 * (len(g) + len(own)) and (d := weighted_distance(phrase, n)) <= MAX_DISTANCE * max(w, weight(phrase)):
                out.append((d, w, scale))
        return out


@cache
def published() -> AliasIndex:
    return AliasIndex()


def alias_dictionary(df: DataFrame, *cols: str) -> DataFrame:
    """``spelling, scale`` for every distinct spelling in the columns; unknown spellings have a null scale."""
    spelled = None
    for c in cols:
        one = df.select(F.col(f"`{c}`").cast("string").alias("spelling"))
        spelled = one if spelled is None else spelled.unionAll(one)
    spelled = spelled.where("spelling is not null").distinct()

    @F.pandas_udf("string")
    def scale_of(s: pd.Series) -> pd.Series:
        return s.map(published().find).astype(object).where(lambda x: x.notna(), None)

    return spelled.select("spelling", scale_of("spelling").alias("scale"))


def _fits(q: Column, scale: Column) -> Column:
    """Whether every character of ``q`` is possible under ``scale``."""
    cond = F.lit(False)
    for name, (lo, hi) in CHARS.items():
        cond = cond | ((scale == name) & ~q.rlike(f"[^\\x{lo:02x}-\\x{hi:02x}]"))
    return F.coalesce(cond, F.lit(False))


def solexa_to_phred(q: int) -> int:
    return int(math.floor(10 * math.log10(10 ** (q / 10) + 1) + 0.5))


def common_qualities(df: DataFrame, quals: str = "qualities", read: str = "read_seq", fmt: str = "quality_format", offset: str = "qual_offset", descr: str = "descr") -> DataFrame:
    """Adds ``recorded_as`` and ``phred33`` to all rows of ``df``.

    ``recorded_as`` is one of phred33, phred64, solexa64, numbers, errors; null if there are no qualities (null, empty
    or ``*``), and then ``phred33`` is what was there. The declared scale holds unless a character is impossible under
    it; ``quality_format`` goes before ``qual_offset`` (33 or 64, Phred scale), that before ``descr``. If none holds the
    characters decide: offset 33, else Phred offset 64, else Solexa. A list of numbers (two or more, separated, and
    not as many characters as bases) is told by its text; its values are Phred, or error probabilities if declared so
    or if all lie in 0..1 and one has a decimal point. Values outside 0..45 are clipped to it. Characters possible
    under no scale give ``recorded_as`` null and ``phred33`` null. Repeated rows are kept; a column named ``recorded_as`` or ``phred33`` in
    ``df`` is replaced.
    """
    q, r = F.col(f"`{quals}`"), F.col(f"`{read}`")
    names = materialize(alias_dictionary(df, fmt, descr)).where("scale is not null")  # filtered once written: each spelling is looked up once
    keep = [c for c in df.columns if c not in ("recorded_as", "phred33")]
    base = df.select(*(F.col(f"`{c}`") for c in keep))
    x = base
    few = rows_at_most(names, MAX_SENT)
    for c, out in ((fmt, "_by_format"), (descr, "_by_descr")):
        d = names.select(F.col("spelling").alias("_s"), F.col("scale").alias(out))
        if few:
            x = x.join(F.broadcast(d), F.col(f"`{c}`") == F.col("_s"), "left").drop("_s")
        else:  # a few spellings hold most rows, so each is met in several places
            d = d.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salted = x.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            x = salted.join(d, (F.col(f"`{c}`") == F.col("_s")) & (F.col("_salt") == F.col("_t")), "left").drop("_s", "_t", "_salt")
    there = q.isNotNull() & ~F.trim(q).isin("", "*")
    is_list = there & q.rlike(_LIST) & (q.rlike(r"\s") | (F.length(q) != F.coalesce(F.length(r), F.lit(-1))))
    by_offset = F.when(F.col(f"`{offset}`") == 33, P33).when(F.col(f"`{offset}`") == 64, P64)
    said = [F.col("_by_format"), by_offset, F.col("_by_descr")]
    chars = F.when(_fits(q, said[0]), said[0]).when(_fits(q, said[1]), said[1]).when(_fits(q, said[2]), said[2])
    for s in (P33, P64, SOLEXA):
        chars = chars.when(_fits(q, F.lit(s)), F.lit(s))
    # The first declaration that speaks of lists decides which kind; else the values do.
    lists = [F.when(s.isin(NUMBERS, ERRORS), s) for s in said]
    small = F.forall(_numbers(q), lambda v: (v >= 0) & (v <= 1)) & q.rlike(r"\.|[eE]")
    kind = F.when(small, ERRORS).otherwise(F.coalesce(*lists, F.lit(NUMBERS)))
    kind = F.when((kind == ERRORS) & ~F.forall(_numbers(q), lambda v: (v >= 0) & (v <= 1)), NUMBERS).otherwise(kind)
    x = x.withColumn("recorded_as", F.when(is_list, kind).when(there, chars))
    p64 = F.translate(q, "".join(map(chr, range(64, 110))), "".join(map(chr, range(33, 79))))
    sol = F.translate(q, "".join(map(chr, range(59, 110))), "".join(chr(33 + solexa_to_phred(c - 64)) for c in range(59, 110)))
    of = lambda f: F.concat_ws("", F.transform(_numbers(q), lambda v: F.char((F.least(F.greatest(F.floor(f(v) + 0.5), F.lit(0)), F.lit(45)) + 33).cast("int"))))
    num = of(lambda v: v)
    err = of(lambda v: F.when(v <= 0, F.lit(45.0)).otherwise(-10 * F.log10(v)))
    a = F.col("recorded_as")
    out = F.when(~there | q.isNull(), q).when(a == P33, q).when(a == P64, p64).when(a == SOLEXA, sol).when(a == NUMBERS, num).when(a == ERRORS, err)
    return x.withColumn("phred33", out).select(*(F.col(f"`{c}`") for c in keep), "recorded_as", "phred33")


def _numbers(q: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(q), r"[,;:|\s]+"), lambda s: s != ""), lambda s: s.try_cast("double"))
