"""The general data-preparation operators against brute force, and their edge cases."""

import random
from collections import Counter, defaultdict

import pytest

from readloom.operators import hotkeys, periods, records, units


# ---- per-key profiles ----


def profile(spark, rows, schema, key="k", measures=("v",), **kw):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return {r["key_value"]: r for r in hotkeys.key_profile(df, key, list(measures), **kw).collect()}


def test_profile_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 6 + ["", "*", None, "a", "b", "é"]), rnd.choice([None, -5, 0, 7, 1 << 40])) for _ in range(3000)]
    got = profile(spark, rows, "k string, v bigint", n_blocks=3, fan_in=2)
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert set(got) == set(want)
    for k, vs in want.items():
        x = [v for v in vs if v is not None]
        assert tuple(got[k])[1:] == (len(vs), len(x), sum(x), min(x), max(x))


def test_reduction_is_a_tree(spark):
    """However many splits there are, no task adds up more than ``fan_in`` of them."""
    df = spark.range(0, 4000, 1, 40).selectExpr("string(id % 7) as k", "id as v")
    got = {r["key_value"]: r for r in hotkeys.key_profile(df, "k", ["v"], fan_in=3).collect()}
    assert {k: (r.n_rows, r.v_sum, r.v_min, r.v_max) for k, r in got.items()} == {str(k): (len(x := range(k, 4000, 7)), sum(x), k, x[-1]) for k in range(7)}
    plan = hotkeys.key_profile(df, "k", ["v"], fan_in=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 4  # 40 splits, 14, 5, 2, then one
    assert hotkeys.key_profile(df, "k", [], fan_in=64)._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_profile_of_null_measures_and_empty_table(spark):
    got = profile(spark, [("a", None), ("a", None)], "k string, v bigint")
    assert tuple(got["a"]) == ("a", 2, 0, None, None, None)
    assert profile(spark, [], "k string, v bigint") == {}


def test_profile_flushes_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "FLUSH_KEYS", 10)
    rows = [(str(i % 50), i, "x") for i in range(400)]
    got = profile(spark, rows, "key_value string, n_rows bigint, block string", key="key_value", measures=("n_rows",))
    assert len(got) == 50 and all(r["n_rows"] == 8 for r in got.values())


def test_heavy_keys_at_the_share(spark):
    from pyspark.sql import functions as F

    rows = [("a",)] * 3 + [("b",)] * 2 + [(None,)] * 50 + [("*",)] * 45
    p = hotkeys.key_profile(spark.createDataFrame(rows, "k string"), "k", []).withColumn("field_name", F.lit("k"))
    assert [r.key_value for r in hotkeys.heavy_keys(p, 3, 100, ("", "*")).collect()] == ["a"]


# ---- periods and gaps ----


def islands(rows):
    by = defaultdict(set)
    for k, s, t in rows:
        if s is not None and t is not None and s <= t:
            by[k] |= set(range(s, t + 1))
    p, g = set(), set()
    for k, at in by.items():
        xs = sorted(at)
        start = prev = xs[0]
        for x in xs[1:]:
            if x != prev + 1:
                p.add((k, start, prev))
                g.add((k, prev + 1, x - 1))
                start = x
            prev = x
        p.add((k, start, prev))
    return p, g


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_periods_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(600):
        s = rnd.randint(0, 900)
        rows.append((rnd.choice(["hot"] * 5 + ["a", "b", None]), s, rnd.choice([None, s, s + 1, s + rnd.randint(0, 30), s - 3])))
    rows += rows[:50] + [("hot", 5, 899)] * (seed == 3)
    df = spark.createDataFrame(rows, "k string, s bigint, t bigint").repartition(4)
    p, g = islands(rows)
    assert {tuple(r) for r in periods.periods(df, ["k"], "s", "t").collect()} == p
    got = periods.gaps(df, ["k"], "s", "t").collect()
    assert {tuple(r) for r in got} == g and len(got) == len(g)


def test_periods_touch_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4)], "k string, s int, t int")
    assert [tuple(r) for r in periods.periods(df, ["k"], "s", "t").collect()] == [("a", 1, 4)]
    assert sorted(tuple(r) for r in periods.periods(df, ["k"], "s", "t", join_touching=False).collect()) == [("a", 1, 2), ("a", 3, 4)]
    assert periods.periods(df.limit(0), ["k"], "s", "t").count() == 0
    odd = df.selectExpr("k as pid", "s as e0", "t as carry", "1 as before")
    assert periods.periods(odd, ["pid"], "e0", "carry").count() == 1


# ---- records ----

REF = {"chr1": 1000, "s_2": 50}
SAM = "q\t0\tchr1\t5\t9\t2M1I1D1S\t=\t7\t-3\tACgT\t!!~I"
MAP = "t\tACGT\t!!!!\t0:1+2x3\tchr1:+:5:2C1:::0x1F,s_2:R:1:(1)1>1-1>9*>2+"
GTF = 'chr1\ta b\texon\t1\t10\t-1.5e3\t+\t.\tgene_id "g"; x "a;b"; '


@pytest.mark.parametrize(
    ("kind", "line", "reason"),
    [
        ("sam", SAM, None), ("sam", "@SQ\tx", "header"), ("sam", "@sq\tx", "columns"), ("sam", SAM.replace("\t0\t", "\t4096\t", 1), "flag"), ("sam", SAM.replace("chr1", "chr9"), "rname"),
        ("sam", SAM.replace("\t5\t", "\t1001\t"), "rname"), ("sam", SAM.replace("2M1I", "3M1I"), "cigar"), ("sam", SAM.replace("2M1I", "2M1"), "cigar"), ("sam", SAM.replace("!!~I", "!!~"), "qual"), ("sam", SAM.replace("!!~I", "*"), None),
        ("sam", SAM.replace("\t=\t", "\t*=\t"), "rnext"), ("sam", SAM + "\tNM:i:-3\tXA:A:b\tXF:f:1.5\tXZ:Z:", None), ("sam", SAM + "\tNM:i:x", "tag"), ("sam", SAM + "\tXF:f:1e5", "tag"), ("sam", SAM + "\tNM:i", "tag"), ("sam", "\t" + SAM[2:], "qname"),
        ("sam", SAM.replace("ACgT", "ACXT"), "seq"), ("sam", SAM.replace("\t-3\t", "\t--3\t"), "tlen"), ("sam", SAM.replace("\t5\t", "\t٥\t"), "pos"),
        ("map", MAP, None), ("map", MAP.replace("!!!!\t", ""), None), ("map", MAP.replace("!!!!", ""), None), ("map", MAP.replace("!!!!", "!!!"), "quals"), ("map", MAP.replace("0:1+2x3", "0+1+2"), "counters"), ("map", MAP.replace("0:1+2x3", "!"), None),
        ("map", MAP.replace("2C1", "2C2"), "maps"), ("map", MAP.replace("chr1:+", "chr1:*"), "maps"), ("map", MAP.replace("s_2", "s_3"), "maps"), ("map", MAP.replace(":1:(1)", ":51:(1)"), "maps"), ("map", MAP.replace("0x1F", "0xG"), "maps"), ("map", MAP + ",", "maps"),
        ("map", "t\tACGT\t0\t-", None), ("map", "t\tACXT\t0\t-", "read"), ("map", "t\tACGT\t0", "columns"),
        ("gtf", GTF, None), ("gtf", "# x", "header"), ("gtf", GTF.replace("\t1\t10", "\t11\t10"), "start"), ("gtf", GTF.replace("\t10\t", "\t1001\t"), "seqname"), ("gtf", GTF.replace("-1.5e3", "x"), "score"), ("gtf", GTF.replace("\t.\tgene", "\t3\tgene"), "frame"),
        ("gtf", GTF.replace('"g"', '""'), "attributes"), ("gtf", GTF.replace('"g";', '"g;'), "attributes"), ("gtf", GTF.replace('; x', ';  x'), "attributes"), ("gtf", GTF.replace("gene_id", "gene-id"), "attributes"),
        ("xyz", "a", "file_kind"), ("gtf", None, "line"), ("gtf", "", "columns"),
    ],
)
def test_grammar(kind, line, reason):
    p = records.LineParser(REF)
    got = p.parse(kind, line)
    if reason in (None, "header"):
        assert got["status"] == (reason or "valid"), p.errors
    else:
        assert got["status"] == "rejected" and reason in {f for _, f, _ in p.errors}, p.errors


def test_recovery_behind_a_broken_quote():
    p = records.LineParser(REF)
    p.parse("gtf", 'chr1\ta\texon\t1\t10\t.\t+\t.\tgene_id "g; bad; x "y"; z-z "q"; k "v";')
    assert [e[2] for e in p.errors].count("broken attribute") == 2


RECORDS = {
    "sam": [SAM, SAM.replace("q\t", "read.2:x\t", 1) + "\tNM:i:-3", SAM.replace("q\t", "r3\t", 1) + "\tXZ:Z:a b\tXF:f:-1.5"],
    "map": [MAP, "u 1:N:0\tACGTA\t!\tchr1:+:5:5", "v\tACG\t!\tchr1:R:7:3,s_2:+:9:2T:::77"],
    "gtf": [GTF.strip(), 'chr1\ta\texon\t2\t9\t.\t-\t.\tgene_id "h";', 's_2\tb\tCDS\t3\t9\t1\t.\t0\tgene_id "i"; n "x\'y";'],
}


@pytest.mark.parametrize("kind", ["sam", "map", "gtf"])
def test_glued_records_come_back_typed(kind):
    rnd = random.Random(kind)
    p = records.LineParser(REF)
    for _ in range(60):
        some = [rnd.choice(RECORDS[kind]) for _ in range(rnd.randint(2, 5))]
        for sep in ("\t", " \t") if kind == "map" else ("\t", ""):
            # Without a separator only what tells where it ends can stand before a start.
            if sep == "" and kind == "sam" and any("XZ" in x for x in some):
                some = [x.replace("\tXZ:Z:a b", "") for x in some]
            got = p.parse(kind, sep.join(some))
            assert got["status"] == "rejected"
            assert [x["rec"] for x in got["recovered"]] == [p.parse(kind, x)["rec"] for x in some], (sep, some)


def test_records_around_a_fault_come_back():
    p = records.LineParser(REF)
    ok = RECORDS["gtf"]
    for bad in ('chr1\ta\texon\t1\t10\t.\t+\t.\tgene_id "g; x "y";', 'chr1\ta\texon\t1\t10\t.\t+\t.\tgene_id g'):
        got = p.parse("gtf", bad + ";" + ok[1] + ok[2])["recovered"]
        assert [x["rec"]["name"] for x in got] == ["h", "i"], bad
    got = p.parse("gtf", ok[0] + ok[1].replace("chr1", "chr9") + ok[2])["recovered"]
    assert [x["rec"]["name"] for x in got] == ["g", "i"]  # the middle one lies on an unknown sequence
    assert [x["at"] for x in got] == [0, len(ok[0] + ok[1])]
    assert [x["rec"]["name"] for x in p.parse("sam", SAM + SAM)["recovered"]] == ["q", "q"]
    assert p.parse("sam", SAM + "\tNM:i")["recovered"] == []


def test_numbers_of_any_size():
    p = records.LineParser(REF)
    for n, want in (("9" * 30, None), (str((1 << 63) - 1), (1 << 63) - 1), (str(1 << 63), None), ("0" * 5000 + "7", 7)):
        r = p.parse("sam", SAM.replace("\t-3\t", f"\t-{n}\t").replace("\t7\t", f"\t{n}\t"))
        got = records._typed(r["rec"])
        assert r["status"] == "valid" and got["pnext"] == want and got["tlen"] == (-want if want else -(1 << 63) if n == str(1 << 63) else None)
        assert p.parse("sam", SAM.replace("\t5\t", f"\t{n}\t"))["status"] == ("valid" if want == 7 else "rejected")


def test_parse_lines_dictionary_equals_join(spark, monkeypatch):
    ref = spark.createDataFrame(list(REF.items()), "seq_name string, seq_length bigint")
    rows = [(1, "sam", SAM, 1, "*"), (2, "sam", SAM.replace("chr1", "chr9"), 2, None), (3, "gtf", GTF, None, None), (4, "gtf", GTF, 4, "nope"), (4, "gtf", GTF, 4, "chr1"), (5, "map", MAP.replace("s_2:R:1:", "s_2:R:51:"), 0, ""), (6, "sam", "@CO\tx", -1, "nope"), (7, None, None, 3, None)]
    df = spark.createDataFrame(rows, "line_id bigint, file_kind string, raw_line string, current_line_num bigint, map_seq_name string").selectExpr("*", "1 as errors", "2 as status")
    df = df.unionByName(spark.createDataFrame([(20 + i, k, sep.join(x.replace("chr1", "chr9") if j == 1 else x for j, x in enumerate(RECORDS[k])), 1, None, 1, 2) for i, (k, sep) in enumerate((k, s) for k in RECORDS for s in ("\t", ""))], df.schema))
    read = lambda: sorted(((r.line_id, r.status, str(r.record), str(r.errors), str(r.recovered)) for r in records.parse_lines(df, ref).collect()))

    small = read()
    assert [x[:2] for x in small][:8] == [(1, "valid"), (2, "rejected"), (3, "rejected"), (4, "rejected"), (4, "valid"), (5, "rejected"), (6, "header"), (7, "rejected")]
    assert sum("pnext" in x[4] for x in small) >= 4
    monkeypatch.setattr(records, "MAX_DICTIONARY", 1)
    assert read() == small
    assert records.parse_lines(df.limit(0), ref).count() == 0


# ---- qualities ----


def test_spellings():
    ix = units.AliasIndex()
    for s, want in [
        ("OFFSET_33", "phred33"), ("Phred+64", "phred64"), ("phread33", "phred33"), ("ilumina-1.8", "phred33"), ("solexa-odds", "solexa64"), ("unknown", None), ("", None), (None, None), ("qv base 64; not re-coded", "phred64"), ("phred 65", None),
        ("p-error", "errors"), ("lane ok", None), ("Illumina", "phred64"), ("illumina 1.8+ (casava)", "phred33"), ("written by ilumina 1.5 software", "phred64"), ("scores are odds (solexa), base 64", "solexa64"), ("offset 33 or offset 64", None), ("illumina 1.2", "solexa64"), ("x " * 5000 + "sangr", "phred33"),
    ]:
        assert ix.find(s) == want, s


def test_misspelt_names_are_found():
    """One wrong, lost, added or swapped letter, other separators, other case and words around: at least 9 of 10 are
    found, and none is taken for another scale."""
    rnd = random.Random(4)
    ix, n, hit = units.AliasIndex(), 0, 0
    for scale, many in units.NAMES.items():
        for name in many:
            for _ in range(40):
                at = [i for i, c in enumerate(name) if c.isalpha()]
                s = list(name)
                if len(at) > 5:
                    i = rnd.choice(at[1:-1])
                    how = rnd.randrange(4)
                    s[i] = [rnd.choice("aeiourst"), "", s[i] * 2, s[i + 1] + s[i] if s[i + 1].isalpha() else s[i]][how]
                    if how == 3 and s[i] != name[i]:
                        s[i + 1] = ""
                t = "".join(s).replace(" ", rnd.choice([" ", "-", "_", "", ": "]) if name[-1] not in "!@" else " ")
                t = rnd.choice(["{}", "{} of run 7", "quality: {}", "{}, trimmed"]).format(rnd.choice([t, t.upper(), t.title()]))
                got = ix.find(t)
                assert got in (scale, None), (t, got)
                n, hit = n + 1, hit + (got == scale)
    assert hit >= 0.9 * n, hit / n


def test_common_qualities(spark, monkeypatch):
    rows = [
        (1, "ACGT", "IIII", "Sanger", 64, None, "phred33", "IIII"), (2, "ACGT", "hhhh", None, 64, None, "phred64", "IIII"), (3, "ACGT", "hhhh", "Sanger", None, None, "phred64", "IIII"), (4, "ACGT", ";;hh", "solexa", None, None, "solexa64", '""II'),
        (5, "ACGT", "40 40,40;2", "Sanger", 33, None, "numbers", "III#"), (6, "ACGT", "0.0001 1e-4 0.1 1.0", None, None, None, "errors", "II+!"), (7, "ACGT", None, "Sanger", 33, None, None, None), (8, "ACGT", "*", None, None, None, None, "*"), (9, "ACGT", "", None, None, None, None, ""),
        (10, "ACGT", ";;hh", None, None, None, "solexa64", '""II'), (11, "ACGT", "!!hh", None, None, None, None, None), (12, None, "IIII", "", 0, "scores start at '@'", "phred64", "****"), (13, "ACGT", "5,,5", None, None, None, "phred33", "5,,5"), (14, "ACGT", "0 1 0 1", None, None, None, "numbers", "!\"!\""),
        (14, "ACGT", "0 1 0 1", None, None, None, "numbers", "!\"!\""),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "read_id bigint, read_seq string, qualities string, quality_format string, qual_offset int, descr string").selectExpr("*", "'x' as recorded_as", "'y' as scale", "'z' as spelling")
    got = sorted((r.read_id, r.recorded_as, r.phred33) for r in units.common_qualities(df).collect())
    key = lambda t: (t[0], str(t))
    assert sorted(got, key=key) == sorted([(r[0], r[6], r[7]) for r in rows], key=key)
    assert units.common_qualities(df.limit(0)).count() == 0
    monkeypatch.setattr(units, "MAX_SENT", 1)
    assert sorted(((r.read_id, r.recorded_as, r.phred33) for r in units.common_qualities(df).collect()), key=key) == sorted(got, key=key)


def test_solexa_scale():
    assert [units.solexa_to_phred(q) for q in (-5, 0, 10, 40)] == [1, 3, 10, 40]


def test_entry(spark, sf):
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and entry.entry(spark).count() >= 0
    assert Counter(r.field_name for r in q["p1_found"](spark, sf).collect())["seq_name"] > 0
