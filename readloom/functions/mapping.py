"""Column functions over mappings: MAP text to nested blocks, and the metrics of blocks.

A mapping is ``STRUCT<txt, seq_name, strand, pos, score, blocks>``; a block is
``STRUCT<pos, base_length, ins, dels, misms ARRAY<STRUCT<type, pos, base, size>>, junction>`` where ``junction`` is the
distance to the next block (0 for the last). ``>n+`` is INS (takes up reference), ``>n-`` and trims are DEL (take up
read), ``>n*`` opens the next block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OP = "struct<type: string, pos: bigint, base: string, size: bigint>"
BLOCK = f"struct<pos: bigint, base_length: bigint, ins: bigint, dels: bigint, misms: array<{OP}>, junction: bigint>"
#: Tokens of an edit string.
TOKEN = r"(\([0-9]+\)|[0-9]+|[ACGTN]|>[0-9]+[-+*])"
EDITS_RE = r"(?:\([0-9]+\)|[0-9]+|[ACGTN]|>[0-9]+[-+*])+"
MAP_RE = rf"[^:,\t]+:[-+FR]:[0-9]+:{EDITS_RE}(?::::(?:0x[0-9a-fA-F]+|[0-9]+))?"
MAPS_RE = rf"(?:-|{MAP_RE}(?:,{MAP_RE})*)"
COUNTERS_RE = r"(?:!|[0-9]+(?:x[0-9]+)?(?:[:+][0-9]+(?:x[0-9]+)?)*)"


def _l(v) -> Column:
    return F.lit(v).cast("bigint")


def once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_blocks(pos: Column, edits: Column) -> Column:
    """Blocks of an edit string that starts at ``pos``."""
    start = F.struct(
        F.array().cast(f"array<{BLOCK}>").alias("done"), pos.cast("bigint").alias("pos"), _l(0).alias("at"), _l(0).alias("ins"), _l(0).alias("dels"), F.array().cast(f"array<{OP}>").alias("misms")
    )

    def block(a, junction):
        return F.struct(a["pos"].alias("pos"), a["at"].alias("base_length"), a["ins"].alias("ins"), a["dels"].alias("dels"), a["misms"].alias("misms"), junction.cast("bigint").alias("junction")).cast(BLOCK)

    def step(a, t):
        last = F.right(t, F.lit(1))
        n = F.coalesce(F.regexp_extract(t, "[0-9]+", 0).try_cast("bigint"), _l(1))
        base, splice = t.rlike("^[ACGTN]$"), last == "*"
        ins, dele = last == "+", last.isin("-", ")")
        op = F.struct(F.when(base, "MISMS").when(ins, "INS").otherwise("DEL").alias("type"), a["at"].alias("pos"), F.when(base, t).alias("base"), F.when(~base, n).alias("size")).cast(OP)
        closed = F.struct(F.concat(a["done"], F.array(block(a, n))).alias("done"), (a["pos"] + a["at"] + a["ins"] - a["dels"] + n).alias("pos"), _l(0).alias("at"), _l(0).alias("ins"), _l(0).alias("dels"), F.array().cast(f"array<{OP}>").alias("misms"))
        more = F.struct(
            a["done"].alias("done"), a["pos"].alias("pos"), (a["at"] + F.when(ins, 0).otherwise(n)).cast("bigint").alias("at"), (a["ins"] + F.when(ins, n).otherwise(0)).cast("bigint").alias("ins"),
            (a["dels"] + F.when(dele, n).otherwise(0)).cast("bigint").alias("dels"), F.when(base | ins | dele, F.concat(a["misms"], F.array(op))).otherwise(a["misms"]).alias("misms"),
        )
        return F.when(splice, closed).otherwise(more)

    parsed = F.aggregate(F.regexp_extract_all(edits, F.lit(TOKEN), F.lit(1)), start, step, lambda a: F.concat(a["done"], F.array(block(a, _l(0)))))
    # Most mappings are one run of matches; they need no fold over tokens.
    whole = F.struct(pos.cast("bigint").alias("pos"), edits.try_cast("bigint").alias("base_length"), _l(0).alias("ins"), _l(0).alias("dels"), F.array().cast(f"array<{OP}>").alias("misms"), _l(0).alias("junction")).cast(BLOCK)
    return F.when(edits.rlike("^[0-9]{1,18}$"), F.array(whole)).otherwise(parsed)


def leftmost_last(blocks: Column) -> Column:
    """Positions of a split mapping on the reverse strand: blocks are listed as the read runs, so the given position is
    that of the last block and each block lies behind the next one and their junction."""
    n = F.size(blocks)

    def place(b, i):
        rest = F.slice(blocks, i + 2, F.greatest(n - i - 1, F.lit(0)))
        after = F.aggregate(rest, _l(0), lambda a, c: a + c["base_length"] + c["ins"] - c["dels"] + c["junction"])
        return F.struct((F.element_at(blocks, 1)["pos"] + after + b["junction"]).alias("pos"), b["base_length"].alias("base_length"), b["ins"].alias("ins"), b["dels"].alias("dels"), b["misms"].alias("misms"), b["junction"].alias("junction"))

    return F.when(n > 1, F.transform(blocks, place)).otherwise(blocks)


def parse_edits_v0(pos: Column, edits: Column, read_length: Column) -> Column:
    """Blocks of the older notation, whose operations carry 1-based read positions: ``A88C89``, ``<+3>20``, ``<-2>7``, ``<*100>30``."""
    start = F.struct(F.lit("").alias("s"), _l(0).alias("at"))

    def step(a, t):
        to = F.regexp_extract(t, "([0-9]+)$", 1).try_cast("bigint") - 1
        n = F.regexp_extract(t, "^<.([0-9]+)>", 1).try_cast("bigint")
        run = F.when(to > a["at"], (to - a["at"]).cast("string")).otherwise("")
        base, kind = t.rlike("^[ACGTN]"), F.substring(t, F.lit(2), F.lit(1))
        op = F.when(base, F.left(t, F.lit(1))).otherwise(F.concat(F.lit(">"), n.cast("string"), kind))
        return F.struct(F.concat(a["s"], run, op).alias("s"), (to + F.when(base, 1).when(kind == "-", n).otherwise(0)).cast("bigint").alias("at"))

    tokens = F.regexp_extract_all(edits, F.lit(r"([ACGTN][0-9]+|<[-+*][0-9]+>[0-9]+)"), F.lit(1))
    plain = F.aggregate(tokens, start, step, lambda a: F.concat(a["s"], F.when(read_length > a["at"], (read_length - a["at"]).cast("string")).otherwise("")))
    return parse_blocks(pos, plain)


def parse_map_v0(txt: Column, read_length: Column) -> Column:
    """A mapping in the older notation ``seq:F123A88C89[@score/n]``."""
    body = F.split(txt, "@")
    rest = F.get(F.split(F.get(body, F.lit(0)), ":"), F.lit(1))
    strand = F.when(F.left(rest, F.lit(1)).isin("F", "+"), "+").otherwise("-")
    pos = F.regexp_extract(rest, "^[-+FR]([0-9]+)", 1).try_cast("bigint")
    blocks = parse_edits_v0(pos, F.regexp_replace(rest, "^[-+FR][0-9]+", ""), read_length)
    score = F.get(F.split(F.get(body, F.lit(1)), "/"), F.lit(0)).try_cast("bigint")
    return F.struct(txt.alias("txt"), F.substring_index(txt, ":", 1).alias("seq_name"), strand.alias("strand"), pos.alias("pos"), score.alias("score"), F.when(strand == "-", leftmost_last(blocks)).otherwise(blocks).alias("blocks"))


def parse_split_v0(txt: Column, read_length: Column) -> Column:
    """Donor and acceptor of the older split notation ``[26]=chr7:R100~chr7:R50``; of several positions the first counts.

    ``STRUCT<split, seq1, strand1, pos1, seq2, strand2, pos2, length1, length2>``, null if the text is none.
    """
    rx = r"^\[([0-9]+)(?:[-;][0-9]+)*\]=([^:]+):([-+FR])\[?([0-9]+)[^~]*~([^:]+):([-+FR])\[?([0-9]+)"
    g = lambda i: F.regexp_extract(txt, rx, i)
    strand = lambda i: F.when(g(i).isin("F", "+"), "+").otherwise("-")
    cut = g(1).try_cast("bigint")
    return F.when(txt.rlike(rx), F.struct(cut.alias("split"), g(2).alias("seq1"), strand(3).alias("strand1"), g(4).try_cast("bigint").alias("pos1"), g(5).alias("seq2"), strand(6).alias("strand2"), g(7).try_cast("bigint").alias("pos2"), cut.alias("length1"), (read_length - cut).alias("length2")))


def parse_score(text: Column) -> Column:
    """A decimal or hexadecimal score; null if absent."""
    v = F.when(text.startswith("0x"), F.conv(F.substring(text, 3, 40), 16, 10)).otherwise(text)
    return v.try_cast("bigint")


def parse_map(txt: Column) -> Column:
    """One mapping of MAP text ``seq:strand:pos:edits[:::score]``; strands F and R read as + and -."""
    body = F.split(txt, ":::")
    parts = F.split(F.get(body, F.lit(0)), ":")
    f = lambda i: F.get(parts, F.lit(i))
    pos = f(2).try_cast("bigint")
    plus = lambda s: s.isin("F", "+")
    strand = F.when(plus(f(1)), "+").otherwise("-")

    def placed(p):
        parsed = parse_blocks(F.get(p, F.lit(2)).try_cast("bigint"), F.get(p, F.lit(3)))
        # As above, a strand that is missing counts as reverse.
        reverse = ~F.coalesce(plus(F.get(p, F.lit(1))), F.lit(False))
        return F.when(reverse & F.get(p, F.lit(3)).contains("*"), once(parsed, leftmost_last)).otherwise(parsed)

    blocks = once(parts, placed)
    return F.struct(txt.alias("txt"), f(0).alias("seq_name"), strand.alias("strand"), pos.alias("pos"), parse_score(F.get(body, F.lit(1))).alias("score"), blocks.alias("blocks"))


def parse_maps(text: Column) -> Column:
    """All mappings of a record; ``-`` and null give an empty array."""
    texts = F.filter(F.split(text, ","), lambda t: ~t.isin("-", ""))
    return F.coalesce(F.transform(texts, parse_map), F.transform(F.array().cast("array<string>"), parse_map))


def _sum(blocks: Column, f) -> Column:
    return F.aggregate(blocks, _l(0), lambda a, b: a + f(b))


def block_length(b: Column) -> Column:
    """Reference positions a block spans."""
    return b["base_length"] + b["ins"] - b["dels"]


def global_length(blocks: Column) -> Column:
    return _sum(blocks, lambda b: block_length(b) + b["junction"])


def global_base_length(blocks: Column) -> Column:
    return _sum(blocks, lambda b: b["base_length"])


def no_split_distance(blocks: Column) -> Column:
    return _sum(blocks, lambda b: F.size(b["misms"]).cast("bigint"))


def global_distance(blocks: Column) -> Column:
    """The stratum: edit operations and splices."""
    return no_split_distance(blocks) + F.size(blocks) - 1


def n_mismatches(blocks: Column) -> Column:
    return _sum(blocks, lambda b: F.size(F.filter(b["misms"], lambda m: m["type"] == "MISMS")).cast("bigint"))


def n_indels(blocks: Column) -> Column:
    return _sum(blocks, lambda b: F.size(F.filter(b["misms"], lambda m: m["type"] != "MISMS")).cast("bigint"))


def total_ins(blocks: Column) -> Column:
    return _sum(blocks, lambda b: b["ins"])


def total_dels(blocks: Column) -> Column:
    return _sum(blocks, lambda b: b["dels"])


def levenshtein(blocks: Column) -> Column:
    return n_mismatches(blocks) + total_ins(blocks) + total_dels(blocks)


def bases_aligned(blocks: Column) -> Column:
    return global_base_length(blocks) - n_mismatches(blocks) - total_dels(blocks)


def left_trim(blocks: Column) -> Column:
    m = F.get(F.get(blocks, F.lit(0))["misms"], F.lit(0))
    return F.coalesce(F.when((m["type"] == "DEL") & (m["pos"] == 0), m["size"]), _l(0))


def right_trim(blocks: Column) -> Column:
    b = F.element_at(blocks, -1)
    m = F.try_element_at(b["misms"], F.lit(-1))
    return F.coalesce(F.when((m["type"] == "DEL") & (m["pos"] + m["size"] == b["base_length"]), m["size"]), _l(0))


def end_position(blocks: Column) -> Column:
    """Last reference position, whichever block it is in."""
    return F.array_max(F.transform(blocks, lambda b: b["pos"] + block_length(b) - 1))


def begin_position(blocks: Column) -> Column:
    return F.element_at(blocks, 1)["pos"] - left_trim(blocks)


def min_intron(blocks: Column) -> Column:
    return F.array_min(F.filter(F.transform(blocks, lambda b: b["junction"]), lambda j: j > 0))


def min_block(blocks: Column) -> Column:
    return F.array_min(F.transform(blocks, lambda b: b["base_length"]))


def is_split(blocks: Column) -> Column:
    return F.size(blocks) > 1


def reverse_blocks(blocks: Column) -> Column:
    """Blocks read from the other end: order, operations and their positions reversed."""
    n = F.size(blocks)

    def turn(b, i):
        ops = F.reverse(F.transform(b["misms"], lambda m: F.struct(m["type"].alias("type"), F.when(m["type"] == "MISMS", b["base_length"] - 1 - m["pos"]).when(m["type"] == "DEL", b["base_length"] - m["pos"] - m["size"]).otherwise(b["base_length"] - m["pos"]).alias("pos"), m["base"].alias("base"), m["size"].alias("size")).cast(OP)))
        junction = F.when(i == n - 1, _l(0)).otherwise(F.get(blocks, n - 2 - i)["junction"])
        return F.struct(b["pos"].alias("pos"), b["base_length"].alias("base_length"), b["ins"].alias("ins"), b["dels"].alias("dels"), ops.alias("misms"), junction.alias("junction"))

    return F.transform(F.reverse(blocks), turn)


def cigar(blocks: Column) -> Column:
    """CIGAR of blocks: trims as S, DEL as I, INS as D, splices as N. Mismatches are part of M."""

    def one(b):
        start = F.struct(F.lit("").alias("s"), _l(0).alias("at"))

        def step(a, m):
            run = m["pos"] - a["at"]
            head = F.concat(a["s"], F.when(run > 0, F.concat(run.cast("string"), F.lit("M"))).otherwise(""))
            edge = (m["type"] == "DEL") & ((m["pos"] == 0) | (m["pos"] + m["size"] == b["base_length"]))
            letter = F.when(edge, "S").when(m["type"] == "DEL", "I").otherwise("D")
            return F.struct(F.concat(head, m["size"].cast("string"), letter).alias("s"), (m["pos"] + F.when(m["type"] == "DEL", m["size"]).otherwise(0)).cast("bigint").alias("at"))

        indels = F.filter(b["misms"], lambda m: m["type"] != "MISMS")
        return F.aggregate(indels, start, step, lambda a: F.concat(a["s"], F.when(b["base_length"] > a["at"], F.concat((b["base_length"] - a["at"]).cast("string"), F.lit("M"))).otherwise(""), F.when(b["junction"] > 0, F.concat(b["junction"].cast("string"), F.lit("N"))).otherwise("")))

    return F.array_join(F.transform(blocks, one), "")


def render_edits(blocks: Column, b_trim: bool = True) -> Column:
    """Edit string of blocks; the inverse of :func:`parse_blocks` up to trims, which are written ``(n)`` at the ends."""

    def one(b):
        start = F.struct(F.lit("").alias("s"), _l(0).alias("at"))

        def step(a, m):
            run = m["pos"] - a["at"]
            head = F.concat(a["s"], F.when(run > 0, run.cast("string")).otherwise(""))
            edge = F.lit(b_trim) & (m["type"] == "DEL") & ((m["pos"] == 0) | (m["pos"] + m["size"] == b["base_length"]))
            op = F.when(m["type"] == "MISMS", m["base"]).when(edge, F.concat(F.lit("("), m["size"].cast("string"), F.lit(")"))).when(m["type"] == "DEL", F.concat(F.lit(">"), m["size"].cast("string"), F.lit("-"))).otherwise(F.concat(F.lit(">"), m["size"].cast("string"), F.lit("+")))
            return F.struct(F.concat(head, op).alias("s"), (m["pos"] + F.when(m["type"] == "MISMS", 1).when(m["type"] == "DEL", m["size"]).otherwise(0)).cast("bigint").alias("at"))

        return F.aggregate(b["misms"], start, step, lambda a: F.concat(a["s"], F.when(b["base_length"] > a["at"], (b["base_length"] - a["at"]).cast("string")).otherwise(""), F.when(b["junction"] > 0, F.concat(F.lit(">"), b["junction"].cast("string"), F.lit("*"))).otherwise("")))

    return F.array_join(F.transform(blocks, one), "")


def render_map(m: Column) -> Column:
    score = F.when(m["score"].isNotNull(), F.concat(F.lit(":::"), m["score"].cast("string"))).otherwise("")
    return F.concat(F.concat_ws(":", m["seq_name"], m["strand"], m["pos"].cast("string"), render_edits(m["blocks"])), score)


def splices(blocks: Column) -> Column:
    """Junctions in reference order: first and last position between neighbouring blocks."""
    spans = F.array_sort(F.transform(blocks, lambda b: F.struct(b["pos"].alias("s"), (b["pos"] + block_length(b) - 1).alias("e"))))
    between = F.transform(spans, lambda x, i: F.struct((F.get(spans, i - 1)["e"] + 1).alias("s"), (x["s"] - 1).alias("e")))
    return F.slice(between, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))


def coherent(blocks1: Column, blocks2: Column) -> Column:
    """Whether two ends agree on the junctions where they overlap; ends without splices always do."""
    begin = lambda b: F.array_min(F.transform(b, lambda x: x["pos"]))
    end = lambda b: begin(b) + global_length(b)
    lo = F.greatest(begin(blocks1), begin(blocks2))
    hi = F.when(begin(blocks1) <= begin(blocks2), end(blocks1)).otherwise(end(blocks2))
    inside = lambda j: F.size(F.filter(j, lambda x: (x["e"] >= lo) & (x["s"] <= hi)))
    j1, j2 = splices(blocks1), splices(blocks2)
    shared = F.forall(j1, lambda x: ~((x["s"] >= lo) & (x["s"] < hi)) | F.array_contains(j2, x))
    return ((F.size(blocks1) == 1) & (F.size(blocks2) == 1)) | (hi < lo) | ((inside(j1) == inside(j2)) & shared)


def insert_anchor(strand: Column, blocks: Column) -> Column:
    """Place that an insert size is measured from or to: its end on the forward or behind its end on the reverse strand."""
    last = F.element_at(blocks, -1)
    return last["pos"] + global_base_length(blocks) + F.when(strand == "+", -last["base_length"]).otherwise(1)


def insert_size(s1: Column, strand1: Column, blocks1: Column, s2: Column, strand2: Column, blocks2: Column) -> Column:
    """Insert size of two ends on opposite strands of one sequence; null where it has no meaning.

    ``1 + pos_last(R) + bases(R) - (pos_last(F) + bases(F) - bases_last(F))`` with R the end on the reverse strand.
    """

    a, b = insert_anchor(strand1, blocks1), insert_anchor(strand2, blocks2)
    v = F.when(strand1 == "+", b - a).otherwise(a - b)
    return F.when((s1 == s2) & (strand1 != strand2), v)


def observed_template_size(s1: Column, blocks1: Column, s2: Column, blocks2: Column) -> Column:
    """Signed span of two ends as SAM's TLEN: positive for the leftmost end, 0 on different sequences."""
    b1, b2 = (F.array_min(F.transform(b, lambda x: x["pos"])) for b in (blocks1, blocks2))
    span = F.greatest(end_position(blocks1), end_position(blocks2)) - F.least(b1, b2) + 1
    return F.when(s1 != s2, _l(0)).when(b1 <= b2, span).otherwise(-span)


def map_key(m: Column) -> Column:
    """Hashable form of strict equality: sequence, strand and the bounds of every block."""
    spans = F.transform(m["blocks"], lambda b: F.concat_ws("-", b["pos"].cast("string"), (b["pos"] + block_length(b) - 1).cast("string")))
    return F.concat_ws("|", m["seq_name"], m["strand"], F.array_join(spans, ","))


def same_within(a: Column, b: Column, tolerance: float | Column) -> Column:
    """Tolerant equality: one block: begin or end within tolerance; several: begin and end of each block."""
    near = lambda x, y: F.abs(x - y) <= tolerance
    begin = lambda x: x["pos"]
    end = lambda x: x["pos"] + block_length(x) - 1
    one = near(begin(a["blocks"][0]), begin(b["blocks"][0])) | near(end(a["blocks"][0]), end(b["blocks"][0]))
    many = F.forall(F.arrays_zip(a["blocks"].alias("x"), b["blocks"].alias("y")), lambda z: near(begin(z["x"]), begin(z["y"])) & near(end(z["x"]), end(z["y"])))
    return (a["seq_name"] == b["seq_name"]) & (a["strand"] == b["strand"]) & (F.size(a["blocks"]) == F.size(b["blocks"])) & F.when(F.size(a["blocks"]) == 1, one).otherwise(many)


def trim_blocks(blocks: Column, left: int, right: int, strand: Column) -> Column:
    """Mapping of a read of which ``left`` and ``right`` bases were cut off: operations there go, positions follow.

    Only the first and last block are cut, as deep as they reach. On the reverse strand the read runs against the
    reference, so cutting its left side leaves the position alone and cutting its right side moves it.
    """

    def cut(b, n_left, n_right):
        n0, n1 = F.least(n_left, b["base_length"]), F.least(n_right, b["base_length"])
        end = b["base_length"] - n1
        lost_l = F.filter(b["misms"], lambda o: o["pos"] < n0)
        lost_r = F.filter(b["misms"], lambda o: (o["pos"] >= n0) & (o["pos"] >= end))
        kept = F.transform(F.filter(b["misms"], lambda o: (o["pos"] >= n0) & (o["pos"] < end)), lambda o: F.struct(o["type"].alias("type"), (o["pos"] - n0).alias("pos"), o["base"].alias("base"), o["size"].alias("size")))
        total = lambda ops, kind: F.aggregate(F.filter(ops, lambda o: o["type"] == kind), _l(0), lambda a, o: a + o["size"])
        span = lambda n, ops: n + total(ops, "INS") - total(ops, "DEL")
        moved = F.when(strand == "-", span(n1, lost_r)).otherwise(span(n0, lost_l))
        return F.struct((b["pos"] + moved).alias("pos"), (b["base_length"] - n0 - n1).alias("base_length"), total(kept, "INS").alias("ins"), total(kept, "DEL").alias("dels"), kept.alias("misms"), b["junction"].alias("junction"))

    n = F.size(blocks)
    return F.transform(blocks, lambda b, i: cut(b, F.when(i == 0, _l(left)).otherwise(_l(0)), F.when(i == n - 1, _l(right)).otherwise(_l(0))))


def restore_trim(blocks: Column, left: Column, right: Column) -> Column:
    """Mapping of a read whose trimmed bases were put back: they come in as DEL at both ends."""
    n = F.size(blocks)

    def grow(b, i):
        a, z = F.when(i == 0, left).otherwise(_l(0)), F.when(i == n - 1, right).otherwise(_l(0))
        dele = lambda at, k: F.when(k > 0, F.array(F.struct(F.lit("DEL").alias("type"), at.alias("pos"), F.lit(None).cast("string").alias("base"), k.cast("bigint").alias("size")).cast(OP))).otherwise(F.array().cast(f"array<{OP}>"))
        moved = F.transform(b["misms"], lambda o: F.struct(o["type"].alias("type"), (o["pos"] + a).alias("pos"), o["base"].alias("base"), o["size"].alias("size")).cast(OP))
        return F.struct(b["pos"].alias("pos"), (b["base_length"] + a + z).alias("base_length"), b["ins"].alias("ins"), (b["dels"] + a + z).alias("dels"), F.concat(dele(_l(0), a), moved, dele(a + b["base_length"], z)).alias("misms"), b["junction"].alias("junction"))

    return F.transform(blocks, grow)
