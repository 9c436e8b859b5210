"""SAM, MAP and GTF lines: typed records, and located syntax errors for the lines that are none.

The grammar is a hand-written recursive descent over one line. An error does not end the parse: the parser notes where
it happened and resumes, after a broken field at the next column, after a broken quote at the next anchor that is a
validated start, of an attribute or of a whole record glued to the line. So one pass tells every fault of a line, and
the records of a line that holds several are recovered, typed like any other. Names are looked up after the parse, so that
a dictionary of the reference and a join with it give the same.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.plans.runtime import materialize, rows_at_most

#: Reference names up to this many go to the parsers as a dictionary; beyond it they are checked by a join.
MAX_DICTIONARY = 200_000

# Fixed values of the formats.
_CIGAR = re.compile(r"([0-9]+)([MIDNSHP=X])")
_DEC = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
_EXP = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_INT = re.compile(r"[+-]?[0-9]+")
_NAT = re.compile(r"[0-9]+")
_SAM_SEQ = re.compile(r"[ACGTNacgtn]+")
_DNA = re.compile(r"[ACGTN]+")
_QUAL = re.compile(r"[!-~]+")
_TAG = re.compile(r"([A-Za-z][A-Za-z0-9]):([AifZHB]):(.*)", re.S)
_COUNT = re.compile(r"[0-9]+(?:x[0-9]+)?")
_EDIT = re.compile(r"\((\d+)\)|(\d+)|([ACGTN])|>(\d+)([-+*])", re.A)
_SCORE = re.compile(r"0x[0-9a-fA-F]+|[0-9]+")
_ATTR = re.compile(r'([A-Za-z0-9_]+) "([^"]*)";')
_ATTR_START = re.compile(r'(?:^|(?<=[ ;]))[A-Za-z0-9_]+ "')
_COUNTERS = r"(?:!|[0-9]+(?:x[0-9]+)?(?:[:+][0-9]+(?:x[0-9]+)?)*)"
#: Starts of records: what the first columns must look like; group 1 is the first, which may begin with the end of the record before.
_START = {
    "sam": re.compile(r"(?:^|(?<=\t))([^\t]*)\t[0-9]+\t[^\t]+\t[0-9]+\t[0-9]+\t(?:\*|[0-9]+[MIDNSHP=X][^\t]*)\t[^\t]+\t[0-9]+\t[-+]?[0-9]+(?=\t)"),
    "map": re.compile(rf"(?:^|(?<=\t))([^\t]*)\t[ACGTN]+\t(?:[!-~]*\t)?{_COUNTERS}(?=\t(?:-|[^\t:]+:[-+FR]:[0-9]+:))"),
    "gtf": re.compile(r"(?:^|(?<=\t))([^\t]*)\t[^\t]*\t[^\t]*\t[0-9]+\t[0-9]+\t[^\t]*\t[-+.]\t[012.](?=\t)"),
}
_TYPED = re.compile(r"[A-Za-z][A-Za-z0-9]:(?:i:[+-]?[0-9]+|f:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)|A:.)|.*:::(?:0x[0-9a-fA-F]+|[0-9]+)", re.S)
_HEADER = re.compile(r"@[A-Z]{2}\t")

Error = tuple[int, str, str]  # offset in the line, field, reason


class LineParser:
    """One line in, a record and its errors out. Names met are kept in ``asks`` as (name, position, offset, field);
    with ``known``, which maps a name to its length, they are looked up, else that is left to a join."""

    def __init__(self, known: dict[str, int] | None):
        self.known = known

    def fail(self, at: int, field: str, why: str) -> None:
        self.errors.append((at, field, why))

    def name(self, at: int, field: str, s: str, pos: int | None = None) -> None:
        self.asks.append((s, pos, at, field))

    def wrong(self, asks: list[tuple]) -> list[Error]:
        """Errors of names, by the dictionary."""
        out = [(at, field, UNKNOWN if s not in self.known else BEYOND) for s, pos, at, field in asks if s not in self.known or (pos is not None and pos > self.known[s])]
        return out

    def number(self, at: int, field: str, s: str, lo: int | None = 0, hi: int | None = None, rx: re.Pattern = _NAT) -> int | None:
        if not rx.fullmatch(s):
            return self.fail(at, field, "not a number")
        digits = s.lstrip("+-").lstrip("0")
        v = int(digits or 0) if len(digits) < 20 else 1 << 64  # beyond any length and any BIGINT
        v = -v if s[0] == "-" else v
        if (lo is not None and v < lo) or (hi is not None and v > hi):
            return self.fail(at, field, "out of range")
        return v

    def parse(self, kind: str | None, line: str | None, number: int | None = 1, noted: str | None = None) -> dict:
        """``status``, ``rec`` (the typed fields as far as they parsed), ``errors``, ``asks``, ``recovered``."""
        self.errors: list[Error] = []
        self.asks: list[tuple] = []
        rec, recovered = {}, []
        if line is None:
            self.fail(0, "line", "no line")
        elif kind == "sam" and _HEADER.match(line) or kind == "gtf" and line.startswith("#"):
            return {"status": "header", "rec": None, "errors": [], "asks": [], "recovered": []}
        elif kind in _START:
            rec = getattr(self, kind)(line)
            if self.errors:
                recovered = self.resume(kind, line)
        else:
            self.fail(0, "file_kind", "unknown kind of file")
        if number is None or number < 1:
            self.fail(0, "current_line_num", "missing" if number is None else "out of range")
        if noted is not None and noted != "*":
            self.name(0, "map_seq_name", noted)
        if self.known is not None:
            self.errors += self.wrong(self.asks)
            recovered = [r for r in recovered if not self.wrong(r["asks"])]
        self.errors.sort()
        return {"status": "rejected" if self.errors else "valid", "rec": rec or None, "errors": self.errors, "asks": self.asks, "recovered": recovered}

    def columns(self, line: str) -> list[tuple[int, str]]:
        out, at = [], 0
        for s in line.split("\t"):
            out.append((at, s))
            at += len(s) + 1
        return out

    # sam := qname flag rname pos mapq cigar rnext pnext tlen seq qual tag*
    def sam(self, line: str) -> dict:
        c = self.columns(line)
        if len(c) < 11:
            self.fail(len(line), "columns", f"{len(c)} columns, 11 needed")
            return {}
        (q0, qname), (f0, flag), (r0, rname), (p0, pos), (m0, mapq), (c0, cigar), (n0, rnext), (x0, pnext), (t0, tlen), (s0, seq), (u0, qual) = c[:11]
        if not qname:
            self.fail(q0, "qname", "empty")
        r = {"name": qname, "flag": self.number(f0, "flag", flag, 0, 4095), "seq_name": rname, "pos": self.number(p0, "pos", pos)}
        r["mapq"] = self.number(m0, "mapq", mapq, 0, 255)
        r["rnext"], r["pnext"] = rnext, self.number(x0, "pnext", pnext)
        if rname != "*":
            self.name(r0, "rname", rname, r["pos"])
        if rnext not in ("*", "="):
            self.name(n0, "rnext", rnext)
        r["tlen"] = self.number(t0, "tlen", tlen, None, None, _INT)
        used = self.cigar(c0, cigar)
        if seq != "*" and not _SAM_SEQ.fullmatch(seq):
            self.fail(s0, "seq", "not a sequence")
        if cigar != "*" and seq != "*" and used is not None and used != len(seq):
            self.fail(c0, "cigar", f"takes up {used} bases of {len(seq)}")
        if qual != "*":
            if not _QUAL.fullmatch(qual):
                self.fail(u0, "qual", "not qualities")
            elif seq != "*" and len(qual) != len(seq):
                self.fail(u0, "qual", f"{len(qual)} qualities for {len(seq)} bases")
        for at, s in c[11:]:
            self.tag(at, s)
        return r | {"cigar": cigar, "read_seq": seq, "qualities": qual, "tags": [s for _, s in c[11:]]}

    def cigar(self, at: int, s: str) -> int | None:
        if s == "*":
            return None
        i = used = 0
        while i < len(s):
            m = _CIGAR.match(s, i)
            if not m:
                return self.fail(at + i, "cigar", "broken operation")
            if m[2] in "MIS=X":
                used += int(m[1])
            i = m.end()
        return used if s else self.fail(at, "cigar", "empty")

    def tag(self, at: int, s: str) -> None:
        m = _TAG.fullmatch(s)
        if not m:
            return self.fail(at, "tag", "not TAG:TYPE:VALUE")
        ok = len(m[3]) == 1 if m[2] == "A" else _INT.fullmatch(m[3]) if m[2] == "i" else _DEC.fullmatch(m[3]) if m[2] == "f" else True
        if not ok:
            self.fail(at + 5, "tag", f"not a value of type {m[2]}")

    # map := tag read [quals] counters maps
    def map(self, line: str) -> dict:
        c = self.columns(line)
        if len(c) not in (4, 5):
            self.fail(len(line), "columns", f"{len(c)} columns, 4 or 5 needed")
            return {}
        (_, tag), (r0, read) = c[:2]
        (n0, counters), (m0, maps) = c[-2:]
        if not _DNA.fullmatch(read):
            self.fail(r0, "read", "not a read")
        if len(c) == 5 and c[2][1]:
            if not _QUAL.fullmatch(c[2][1]):
                self.fail(c[2][0], "quals", "not qualities")
            elif len(c[2][1]) != len(read):
                self.fail(c[2][0], "quals", f"{len(c[2][1])} qualities for {len(read)} bases")
        self.counters(n0, counters)
        first = None
        if maps != "-":
            at = m0
            for one in maps.split(","):
                got = self.mapping(at, one, len(read))
                first = first or got
                at += len(one) + 1
        r = {"name": tag, "read_seq": read, "qualities": c[2][1] if len(c) == 5 else None, "counters": counters, "maps": maps}
        return r | (first or {})

    def counters(self, at: int, s: str) -> None:
        if s == "!":
            return
        i, plus = 0, 0
        while True:
            m = _COUNT.match(s, i)
            if not m:
                return self.fail(at + i, "counters", "not a counter")
            i = m.end()
            if i == len(s):
                return
            plus += s[i] == "+"
            if s[i] not in ":+" or plus > 1:
                return self.fail(at + i, "counters", "not a separator")
            i += 1

    # mapping := seq ':' strand ':' pos ':' edits [':::' score]
    def mapping(self, at: int, s: str, length: int) -> dict | None:
        body, mark, score = s.partition(":::")
        p = body.split(":")
        if len(p) != 4:
            return self.fail(at, "maps", "not seq:strand:pos:edits")
        seq, strand, pos, edits = p
        if mark and not _SCORE.fullmatch(score):
            self.fail(at + len(body) + 3, "maps", "not a score")
        where = at + len(seq) + 1
        if strand not in ("+", "-", "F", "R"):
            self.fail(where, "maps", "not a strand")
        v = self.number(where + len(strand) + 1, "maps", pos, 1)
        self.name(at, "maps", seq, v)
        i = used = 0
        while i < len(edits):
            m = _EDIT.match(edits, i)
            if not m:
                return self.fail(at + len(body) - len(edits) + i, "maps", "broken edit")
            i = m.end()
            used += int(m[1] or m[2] or (m[4] if m[5] == "-" else 0) or 0) if not m[3] else 1
        if used != length:
            self.fail(at + len(body) - len(edits), "maps", f"edits take up {used} bases of {length}")
        return {"seq_name": seq, "strand": strand, "pos": v}

    # gtf := seqname source feature start end score strand frame attributes
    def gtf(self, line: str) -> dict:
        c = self.columns(line)
        if len(c) != 9:
            self.fail(len(line), "columns", f"{len(c)} columns, 9 needed")
            return {}
        (q0, seq), (_, src), (_, feat), (s0, start), (e0, end), (x0, score), (d0, strand), (f0, frame), (a0, attrs) = c
        a, b = self.number(s0, "start", start, 1), self.number(e0, "end", end, 1)
        self.name(q0, "seqname", seq, b)
        if a is not None and b is not None and a > b:
            self.fail(s0, "start", "after the end")
        if score != "." and not _EXP.fullmatch(score):
            self.fail(x0, "score", "not a score")
        if strand not in ("+", "-", "."):
            self.fail(d0, "strand", "not a strand")
        if frame not in ("0", "1", "2", "."):
            self.fail(f0, "frame", "not a frame")
        got = self.attributes(a0, attrs)
        if not any(k == "gene_id" and v for k, v in got):
            self.fail(a0, "attributes", "no gene_id")
        first = {k: v for k, v in reversed(got)}
        return {"seq_name": seq, "name": first.get("gene_id"), "source": src, "feature": feat, "pos": a, "end_pos": b, "score": score, "strand": strand, "frame": frame, "tags": [f"{k}={v}" for k, v in got]}

    # attributes := attribute (' ' attribute)* ' '*      attribute := key ' "' value '";'
    def attributes(self, at: int, s: str) -> list[tuple[str, str]]:
        out, i, end = [], 0, len(s.rstrip(" "))
        while i < end:
            m = _ATTR.match(s, i)
            if m and (m.end() >= end or s[m.end()] == " "):
                out.append((m[1], m[2]))
                i = m.end() + 1
                continue
            self.fail(at + i, "attributes", "broken attribute")
            # Resume at the next attribute start that is itself well formed.
            i = next((k.start() for k in _ATTR_START.finditer(s, i + 1) if _ATTR.match(s, k.start())), end)
        if not s.strip(" "):
            self.fail(at, "attributes", "empty")
        return out

    def resume(self, kind: str, line: str) -> list[dict]:
        """The records of a line that holds several: it is cut at the anchors behind its start, and every stretch that
        parses by itself counts. Where the end of one record and the start of the next share a column, they part where
        the record before is whole; a stretch is parsed a few times at most."""
        found = [m for m in _START[kind].finditer(line) if m.start(1)]
        if not found:
            return []
        sub, cuts = LineParser(None), [(0, 0)]  # start of a record, end of the one before
        for m in found:
            col, begin = m[1], cuts[-1][0]
            options = self.borders(kind, line, begin, m.start(1), col)
            at = next((b for b in options if sub.parse(kind, line[begin:b].rstrip("\t \r"))["status"] == "valid"), options[0])
            cuts.append((at, at))
        ends = [*(e for _, e in cuts[1:]), len(line)]
        out = []
        for (at, _), end in zip(cuts, ends):
            got = sub.parse(kind, line[at:end].rstrip("\t \r") if end < len(line) else line[at:])
            if got["status"] == "valid":
                out.append({"at": at, "rec": got["rec"], "asks": got["asks"]})
        return out

    def borders(self, kind: str, line: str, begin: int, at: int, col: str) -> list[int]:
        """Where in the column ``col`` at ``at`` a record may start, the likeliest first."""
        out = []
        if kind == "gtf":
            i = max(col.rfind(c) for c in ";\" ") + 1
            return [at + i]
        first = line[begin:].split("\t", 1)[0]
        if first and first != col and col.endswith(first):  # a record delivered twice
            out.append(at + len(col) - len(first))
        if m := _TYPED.match(col):
            out.append(at + m.end())
        before = line[begin:at].split("\t")
        if kind == "sam" and len(before) == 11:  # as many qualities as bases
            out.append(at + len(before[9]))
        if kind == "map" and (i := self.taken(col, len(before[1]) if len(before) > 1 else 0)):
            out.append(at + i)
        out = [b for b in out if at < b < at + len(col)]
        return [*out, at, *([at + i] if (i := max(col.rfind(" "), col.rfind("\r")) + 1) else [])]

    def taken(self, col: str, length: int) -> int:
        """Where the last mapping in ``col`` has taken up ``length`` bases."""
        i = col.rfind(",") + 1
        head = re.compile(r"[^:,]+:[-+FR]:[0-9]+:").match(col, i)
        i, used = (head.end(), 0) if head else (0, length + 1)
        while used < length and (m := _EDIT.match(col, i)):
            used += 1 if m[3] else int(m[1] or m[2] or (m[4] if m[5] == "-" else 0) or 0)
            i = m.end()
        return i if used == length else 0


UNKNOWN, BEYOND = "unknown sequence", "beyond the end of the sequence"
_REC = [("name", "string"), ("flag", "int"), ("seq_name", "string"), ("pos", "bigint"), ("end_pos", "bigint"), ("strand", "string"), ("mapq", "int"), ("rnext", "string"), ("pnext", "bigint"), ("tlen", "bigint"), ("cigar", "string"), ("read_seq", "string"), ("qualities", "string"), ("counters", "string"), ("maps", "string"), ("source", "string"), ("feature", "string"), ("score", "string"), ("frame", "string"), ("tags", "array<string>")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
_REC_ARROW = pa.struct([(c, _ARROW[t]) for c, t in _REC])
_ERR = pa.list_(pa.struct([("at", pa.int32()), ("field", pa.string()), ("reason", pa.string())]))
_ASK = pa.list_(pa.struct([("name", pa.string()), ("pos", pa.int64()), ("at", pa.int32()), ("field", pa.string()), ("no", pa.int32())]))
_FOUND = pa.list_(pa.struct([("at", pa.int32()), ("record", _REC_ARROW)]))
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _typed(rec: dict | None) -> dict | None:
    """A record as it goes into a table: numbers beyond a BIGINT are null there, though the line keeps its status."""
    return None if rec is None else {c: (v if not isinstance(v := rec.get(c), int) or _LEAST <= v <= _MOST else None) for c, _ in _REC}


def parse_lines(df: DataFrame, ref: DataFrame, kind: str = "file_kind", line: str = "raw_line", number: str = "current_line_num", noted: str = "map_seq_name", id_col: str = "line_id") -> DataFrame:
    """``id, status, record, errors, recovered`` for every row of ``df``.

    ``status`` is valid, rejected or header (header and comment lines are no records and have neither record nor
    errors). ``errors`` lists offset, field and reason of each fault, by offset; ``record`` has the typed fields as far as
    they parsed; ``recovered`` the offset and typed record of every whole record in a rejected line that holds several. A
    null line or an unknown kind of file is rejected; a null or non-positive line number and an unknown noted name are
    faults, at offset 0. Numbers beyond a BIGINT are null in a record. Repeated lines are parsed each time they occur; an
    empty table gives no rows. Columns other than those named are not read.

    Reference names go to the parsers as a dictionary if there are at most ``MAX_DICTIONARY``; else the parsers list
    the names they met and a join decides, with the same result.
    """
    ref = ref.select("seq_name", "seq_length")
    known = {r[0]: r[1] for r in ref.collect()} if rows_at_most(ref, MAX_DICTIONARY) else None
    cols = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{kind}`").alias("k"), F.col(f"`{line}`").alias("l"), F.col(f"`{number}`").cast("bigint").alias("n"), F.col(f"`{noted}`").alias("s"))
    id_type = cols.schema["id"].dataType.simpleString()
    ask = lambda asks, no: [{"name": s, "pos": None if pos is None else min(pos, _MOST), "at": at, "field": f, "no": no} for s, pos, at, f in asks]

    def run(batches):
        p = LineParser(known)
        for b in batches:
            got = [p.parse(k, text, n, s) for k, text, n, s in zip(*(b.column(i).to_pylist() for i in range(1, 5)))]
            asks = [[] if known is not None else ask(r["asks"], 0) + [a for i, x in enumerate(r["recovered"], 1) for a in ask(x["asks"], i)] for r in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([r["status"] for r in got], pa.string()), pa.array([_typed(r["rec"]) for r in got], _REC_ARROW),
                    pa.array([[{"at": a, "field": f, "reason": w} for a, f, w in r["errors"]] for r in got], _ERR), pa.array(asks, _ASK),
                    pa.array([[{"at": x["at"], "record": _typed(x["rec"])} for x in r["recovered"]] for r in got], _FOUND),
                ],
                names=["id", "status", "record", "errors", "asks", "recovered"],
            )

    record = f"struct<{', '.join(f'`{c}`: {t}' for c, t in _REC)}>"
    schema = f"id {id_type}, status string, record {record}, errors array<struct<at: int, field: string, reason: string>>, asks array<struct<name: string, pos: bigint, at: int, field: string, no: int>>, recovered array<struct<at: int, record: {record}>>"
    out = cols.mapInArrow(run, schema)
    if known is None:
        out = _joined_names(out, ref)
    return out.drop("asks").withColumnRenamed("id", id_col)


def _joined_names(out: DataFrame, ref: DataFrame) -> DataFrame:
    """Faults of names, found by joining the names the parsers met with the reference."""
    keyed = materialize(out.withColumn("row", F.monotonically_increasing_id()))
    asked = keyed.select("row", F.explode("asks").alias("a")).select("row", "a.*")
    bad = asked.join(ref, asked["name"] == ref["seq_name"], "left").where("seq_length is null or pos > seq_length")
    why = F.when(F.col("seq_length").isNull(), UNKNOWN).otherwise(BEYOND)
    own = F.when(F.col("no") == 0, F.struct("at", "field", why.alias("reason")))
    more = bad.groupBy("row").agg(F.collect_list(own).alias("more"), F.collect_set("no").alias("bad"))
    both = keyed.join(more, "row", "left")
    errors = F.concat("errors", F.coalesce("more", F.expr("array()")))
    both = both.withColumn("status", F.when((F.size(errors) > 0) & (F.col("status") == "valid"), "rejected").otherwise(F.col("status")))
    lost = F.coalesce("bad", F.expr("cast(array() as array<int>)"))
    both = both.withColumn("recovered", F.filter("recovered", lambda x, i: ~F.array_contains(lost, i + 1)))
    return both.withColumn("errors", F.array_sort(errors)).drop("row", "more", "bad")
