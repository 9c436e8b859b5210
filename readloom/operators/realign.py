"""Checks and realignment of reads against the reference: kernels as Arrow functions over batches.

Operations are ``STRUCT<type, pos, base, size>`` with positions in the read, as in mappings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<type: string, pos: bigint, base: string, size: bigint>>"


def op(kind: str, pos: int, base: str | None = None, size: int | None = None) -> dict:
    return {"type": kind, "pos": pos, "base": base, "size": size}


def check(read: str, seq: str, ops: list[dict]) -> str | None:
    """What is wrong with an alignment, or None: every operation must be in place and every other base must match."""
    i = j = 0
    for o in sorted(ops, key=lambda o: o["pos"]):
        run = o["pos"] - i
        if run < 0 or read[i : i + run] != seq[j : j + run] or i + run > len(read) or j + run > len(seq):
            return "mismatch"
        i, j = i + run, j + run
        if o["type"] == "MISMS":
            if i >= len(read) or j >= len(seq):
                return "mismatch out of sequence"
            if read[i] == seq[j]:
                return "no mismatch"
            if o["base"] != seq[j]:
                return "wrong base"
            i, j = i + 1, j + 1
        elif o["type"] == "INS":
            j += o["size"]
        else:
            i += o["size"]
        if i > len(read) or j > len(seq):
            return "gap out of sequence"
    if len(read) - i != len(seq) - j:
        return "lengths differ"
    return None if read[i:] == seq[j:] else "mismatch"


def hamming(read: str, seq: str) -> list[dict]:
    """Mismatches position by position over the shorter of both."""
    n = min(len(read), len(seq))
    a, b = np.frombuffer(read[:n].encode(), np.uint8), np.frombuffer(seq[:n].encode(), np.uint8)
    return [op("MISMS", int(i), seq[i]) for i in np.flatnonzero(a != b)]


def recover(read: str, seq: str, ops: list[dict]) -> list[dict] | None:
    """Known gaps kept, mismatches between them found anew; None if the gaps do not fit."""
    out, i, j = [], 0, 0
    for o in [*sorted((o for o in ops if o["type"] != "MISMS"), key=lambda o: o["pos"]), None]:
        to = len(read) if o is None else o["pos"]
        run = to - i
        if run < 0 or j + run > len(seq):
            return None
        out += [m | {"pos": m["pos"] + i} for m in hamming(read[i:to], seq[j : j + run])]
        i, j = to, j + run
        if o is not None:
            out.append(op(o["type"], o["pos"], None, o["size"]))
            i, j = (i, j + o["size"]) if o["type"] == "INS" else (i + o["size"], j)
    return out if i == len(read) and j == len(seq) else None


def edit_script(read: str, seq: str, free_ends: bool = False, weight=None) -> tuple[list[dict], int, float]:
    """Least-cost operations from ``seq`` to ``read``, where the alignment starts in ``seq``, and the cost.

    Costs are 1 for each gap base and ``weight(read base, sequence base)`` for a pair (0 or 1 by default). With
    ``free_ends`` bases of ``seq`` before and behind the read cost nothing. Of equal ways back a gap in the read is taken
    before a gap in the sequence, that before a mismatch; equal bases always pair. Rows of the table are computed as
    arrays: the left neighbour's influence is a running minimum.
    """
    n, m = len(read), len(seq)
    a = np.frombuffer(read.encode(), np.uint8)
    gaps = np.arange(n + 1, dtype=float)
    table = np.empty((m + 1, n + 1))
    table[0] = gaps
    for i in range(1, m + 1):
        pair = (a != ord(seq[i - 1])).astype(float) if weight is None else np.array([weight(c, seq[i - 1]) for c in read], float)
        row = np.empty(n + 1)
        row[0] = 0.0 if free_ends else float(i)
        row[1:] = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + pair)
        table[i] = np.minimum.accumulate(row - gaps) + gaps
    i = int(table[1:, n].argmin()) + 1 if free_ends and m else m
    j, cost, back = n, float(table[i, n]), []
    while i and j:
        here = table[i, j]
        if read[j - 1] == seq[i - 1] and np.isclose(table[i - 1, j - 1] + (0 if weight is None else weight(read[j - 1], seq[i - 1])), here):
            i, j = i - 1, j - 1
        elif np.isclose(table[i - 1, j] + 1, here):
            back.append(("INS", j, None))
            i -= 1
        elif np.isclose(table[i, j - 1] + 1, here):
            back.append(("DEL", j - 1, None))
            j -= 1
        else:
            back.append(("MISMS", j - 1, seq[i - 1]))
            i, j = i - 1, j - 1
    begin = 0
    if i and free_ends:
        begin = i
    elif i:
        back += [("INS", 0, None)] * i
    back += [("DEL", k, None) for k in range(j - 1, -1, -1)]
    out: list[dict] = []
    for kind, pos, base in reversed(back):
        last = out[-1] if out else None
        if kind == "INS" and last and last["type"] == "INS" and last["pos"] == pos:
            last["size"] += 1
        elif kind == "DEL" and last and last["type"] == "DEL" and last["pos"] + last["size"] == pos:
            last["size"] += 1
        else:
            out.append(op(kind, pos, base, None if kind == "MISMS" else 1))
    return out, begin, cost


def check_column(read: Column, seq: Column, ops: Column) -> Column:
    @F.pandas_udf("string")
    def f(r: pd.Series, s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([check(a, b, [dict(x) for x in c]) if a is not None and b is not None else "no sequence" for a, b, c in zip(r, s, o)], dtype=object)

    return f(read, seq, ops)


def hamming_column(read: Column, seq: Column) -> Column:
    """Mismatches of two strings, in built-in expressions."""
    n = F.least(F.length(read), F.length(seq))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    bad = F.filter(at, lambda i: F.substring(read, i + 1, F.lit(1)) != F.substring(seq, i + 1, F.lit(1)))
    return F.transform(bad, lambda i: F.struct(F.lit("MISMS").alias("type"), i.cast("bigint").alias("pos"), F.substring(seq, i + 1, F.lit(1)).alias("base"), F.lit(None).cast("bigint").alias("size")))


def realign_column(read: Column, seq: Column, free_ends: bool = False, weight=None) -> Column:
    """``STRUCT<ops, begin, cost>``; null where either is null or empty. ``weight`` is a function of two bases."""

    @F.pandas_udf(f"struct<ops: {OPS}, begin: int, cost: double>")
    def f(r: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = [edit_script(a, b, free_ends, weight) if a and b else (None, None, None) for a, b in zip(r, s)]
        return pd.DataFrame(rows, columns=["ops", "begin", "cost"])

    return f(read, seq)


def recover_column(read: Column, seq: Column, ops: Column) -> Column:
    """Known gaps kept and mismatches found anew; null where the gaps do not fit."""

    @F.pandas_udf(OPS)
    def f(r: pd.Series, s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([recover(a, b, [dict(x) for x in c]) if a is not None and b is not None else None for a, b, c in zip(r, s, o)], dtype=object)

    return f(read, seq, ops)
