"""Functions and operators over templates, mappings and annotation on hand-made vectors."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M
from readloom.functions import sequence as S
from readloom.operators import coverage, filters, intervals, junctions, pairs, realign, scoring, setops, stats
from readloom.operators import templates as T
from readloom.plans.pipeline import Pipeline, PipelineConfig, Step
from readloom.sources import fastx, sinks, text


def value(spark, col, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).select(col.alias("x")).first().x if cols else spark.range(1).select(col.alias("x")).first().x


def arr(*v):
    return F.array(*map(F.lit, v)).cast("array<bigint>")


@pytest.mark.parametrize(("c", "u"), [([], -1), ([0, 0], -1), ([1], 0), ([0, 1], 0), ([1, 0, 0, 1], 2), ([1, 1], 0), ([2], -1), ([0, 1, 0, 0, 3], 2), ([1, 0, 0], 2), ([0, 2, 1], -1)])
def test_uniqueness_degree(spark, c, u):
    assert value(spark, C.uniq_degree(arr(*c))) == u


@pytest.mark.parametrize(("c", "lo", "hi", "want"), [([1, 2, 5], 1, 3, (2, 3)), ([0, 10, 2], 1, 3, (2, 10)), ([0, 10, 2], 0, 3, (1, 0)), ([3, 3, 3], 2, 4, (2, 6))])
def test_maps_under_caps(spark, c, lo, hi, want):
    assert tuple(value(spark, C.maps_under_caps(arr(*c), lo, hi))) == want


@pytest.mark.parametrize(("t", "c", "mcs"), [("0:1+2x3", [0, 1, 2, 2, 2], 2), ("!", [], None), ("0+0:1", [0, 0, 1], 1), ("3", [3], 1)])
def test_counters_text(spark, t, c, mcs):
    assert value(spark, C.parse_counters(F.lit(t))) == c and value(spark, C.parse_mcs(F.lit(t))) == mcs


@pytest.mark.parametrize(("c", "t"), [([0, 0, 0, 2], "0x3:2"), ([1, 0, 4], "1:0:4"), ([10, 0, 0], "10:0x2"), ([], "0")])
def test_counters_render(spark, c, t):
    assert value(spark, C.render_counters(arr(*c))) == t


def test_edit_string(spark):
    m = spark.range(1).select(M.parse_map(F.lit("chr1:F:100:(5)43T46>2+10>1-33>334*10:::0x10")).alias("m"))
    r = m.select("m.*", M.global_distance(F.col("m.blocks")).alias("d"), M.levenshtein(F.col("m.blocks")).alias("lev"), M.end_position(F.col("m.blocks")).alias("end"), M.cigar(F.col("m.blocks")).alias("cigar"), M.render_edits(F.col("m.blocks")).alias("edits"), M.left_trim(F.col("m.blocks")).alias("lt")).first()
    assert (r.seq_name, r.strand, r.pos, r.score, len(r.blocks)) == ("chr1", "+", 100, 16, 2)
    assert (r.d, r.lev, r.lt) == (5, 1 + 2 + 6, 5)
    b = r.blocks[0]
    assert (b.base_length, b.ins, b.dels, b.junction) == (5 + 43 + 1 + 46 + 10 + 1 + 33, 2, 6, 334)
    assert r.blocks[1].pos == 100 + b.base_length + 2 - 6 + 334 and r.end == r.blocks[1].pos + 9
    assert r.cigar == "5S90M2D10M1I33M334N10M" and r.edits == "(5)43T46>2+10>1-33>334*10"


def test_trim_and_restore(spark):
    t = templates(spark, "a\tACGTACGTAC\tABCDEFGHIJ\t1\tchr1:+:5:1T3>2+5,chr1:-:5:1T3>2+5")
    x = filters.hard_trim(t, 2, 1)
    got = x.select("read", "quals", F.transform("maps", lambda m: M.render_map(m)).alias("m")).first()
    assert (got.read, got.quals, got.m) == ("GTACGTA", "CDEFGHI", ["chr1:+:7:3>2+4", "chr1:-:6:3>2+4"])
    y = filters.restore_trim(x).select("read", "quals", F.transform("maps", lambda m: M.render_edits(m["blocks"])).alias("m")).first()
    assert (y.read, y.quals, y.m[0]) == ("ACGTACGTAC", "ABCDEFGHIJ", "(2)3>2+4(1)")
    assert filters.hard_trim(t, 5, 5).select("read").first().read == "ACGTACGTAC"


def test_paired_records(spark):
    line = "r\tACGTAC GTACGT\tIIIIII JJJJJJ\t1:1\tchr1:+:10:6::chr1:-:50:6:::0x10,chr1:+:90:6::,::chr2:-:5:5T"
    t = pairs.from_map_lines(spark.createDataFrame([(line,), ("x\tAC GT\t0\t-",), ("bad\tACGT\t1\tc:+:1:4",)], "value string"))
    assert t.count() == 2
    r = t.where("tag = 'r'").select("reads", "quals", F.transform("mmaps", pairs.strands).alias("s"), F.transform("mmaps", pairs.insert_size).alias("i"), F.transform("mmaps", pairs.distance).alias("d"), F.transform("mmaps", lambda p: p["score"]).alias("c")).first()
    assert (r.reads, r.quals) == (["ACGTAC", "GTACGT"], ["IIIIII", "JJJJJJ"])
    assert (r.s, r.i, r.d, r.c) == (["FR", None, None], [47, None, None], [0, 0, 1], [16, None, None])
    assert pairs.reduce_to_pairs(pairs.insert_between(t, 100, 200)).selectExpr("sum(size(mmaps)) n").first().n == 0
    sam = [x.value.split("\t") for x in pairs.sam_lines(t.where("tag = 'r'")).collect()]
    assert [s[1] for s in sam[:2]] == ["99", "147"] and sam[0][8] == "46" and sam[1][8] == "-46"
    assert pairs.ends(t, ("tag",)).count() == 4


def test_group_chunks(spark):
    t = templates(spark, "a\tACGT\t1\tc:+:1:4", "a\tACGT\t1\tc:+:9:4", "b\tACGT\t0\t-")
    seg = F.when(F.col("tag") == "b", "1:3").when(F.exists("maps", lambda m: m["pos"] == 1), "1:2").otherwise("2:2")
    got = {r.tag: (r.chunks, r.complete, r.n) for r in setops.group_chunks(t.withColumn("segment", seg)).selectExpr("*", "size(maps) n").collect()}
    assert got == {"a": (2, True, 2), "b": (1, False, 0)}


def test_reverse_split_positions(spark):
    m = spark.range(1).select(M.parse_map(F.lit("c:-:100:4>20*6>30*10")).alias("m")).first().m
    assert [b.pos for b in m.blocks] == [100 + 10 + 30 + 6 + 20, 100 + 10 + 30, 100]


def test_older_notations(spark):
    x = spark.range(1).select(M.parse_map_v0(F.lit("chr7:F127708134G27<+5>30A34<-5>40T88"), F.lit(100).cast("bigint")).alias("m"), M.parse_split_v0(F.lit("[31;35]=chr16:R[2503415;2503411]~chr16:R2503271"), F.lit(75)).alias("s"), M.parse_map_v0(F.lit("c:R50<*100>30@10/1"), F.lit(75).cast("bigint")).alias("r"))
    y = x.select("*", M.render_edits(F.col("m.blocks")).alias("e")).first()
    assert (y.m.seq_name, y.m.pos, y.m.strand, y.e) == ("chr7", 127708134, "+", "26G2>5+4A5>5-43T12")
    assert (y.s.split, y.s.seq1, y.s.strand1, y.s.pos1, y.s.pos2, y.s.length2) == (31, "chr16", "-", 2503415, 2503271, 44)
    assert (y.r.score, [b.pos for b in y.r.blocks], [b.base_length for b in y.r.blocks]) == (10, [50 + 46 + 100, 50], [29, 46])


def test_pair_coherence(spark):
    def ok(a, b):
        return spark.range(1).select(M.parse_map(F.lit(a)).alias("a"), M.parse_map(F.lit(b)).alias("b")).select(M.coherent(F.col("a.blocks"), F.col("b.blocks")).alias("x")).first().x

    assert ok("c:+:10:20", "c:-:15:20") and ok("c:+:10:5>20*10", "c:-:12:12>20*3") and ok("c:+:10:5>20*10", "c:-:900:20")
    assert not ok("c:+:10:5>20*10", "c:-:12:20") and not ok("c:+:10:5>20*10", "c:-:12:12>21*3")


def test_reduce_by_annotation(spark):
    f = spark.createDataFrame([(1, "chr1", "exon", 1, 60, "G", "T", "protein_coding"), (2, "chr1", "exon", 50, 60, "H", "U", "x"), (3, "chr1", "exon", 90, 93, "K", "V", "x"), (4, "chr1", "exon", 114, 130, "K", "V", "x")], "ann_id int, seq_name string, feature_type string, start_pos bigint, end_pos bigint, gene_id string, transcript_id string, gene_type string")
    t = templates(spark, LINE, "b\tACGTACGTAC\t1\tchr1:+:52:8,chr1:+:5:10,chr1:+:200:4>20*6,chr1:+:90:4>20*6")
    def got(**k):
        return [r.m for r in intervals.reduce_by_annotation(t, f, "tag", **k).orderBy("tag").select(T.texts(F.col("maps")).alias("m")).collect()]

    assert got(by_gene=True) == [LINE.split("\t")[4], "chr1:+:52:8"]
    assert got(protein_coding=True) == ["chr1:+:5:10", "chr1:+:52:8,chr1:+:5:10"]
    assert got(by_junctions=True)[1] == "chr1:+:52:8,chr1:+:5:10,chr1:+:200:4>20*6,chr1:+:90:4>20*6"


def templates(spark, *lines):
    return T.from_map_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "value")


def kept(df):
    return [r.m for r in df.select(T.texts(F.col("maps")).alias("m")).collect()]


LINE = "a\tACGTACGTAC\t!!!!!!!!!!\t1:1:1\tchr1:+:5:10,chr2:-:7:9T:::9,chr1:+:90:4>20*6"


def test_filters(spark):
    t = templates(spark, LINE)
    assert kept(filters.strata_after_best(t, 0)) == ["chr1:+:5:10"]
    assert kept(filters.on_sequences(t, ["chr2"])) == ["chr2:-:7:9T:::9"]
    assert kept(filters.splits(t, True)) == ["chr1:+:90:4>20*6"]
    assert kept(filters.min_intron_length(t, 21)) == ["chr1:+:5:10,chr2:-:7:9T:::9"]
    assert kept(filters.reduce_to_max_maps(t, 3)) == [LINE.split("\t")[4]] and kept(filters.reduce_to_max_maps(t, 3, paired=True)) == ["-"]
    assert kept(filters.keep_unique(t, lambda x: filters.on_sequences(x, ["none"]))) == [LINE.split("\t")[4]]
    assert kept(filters.filter_templates(t, filters.FilterOptions(strand="-", first_map=True))) == ["chr2:-:7:9T:::9"]
    assert kept(T.sort_maps(t, splits=False))[0].startswith("chr1:+:5:10,chr1:+:90")


def test_mismatch_quality_modes(spark):
    t = templates(spark, "a\tACGT\tABCD\t1\tchr1:+:5:1C1T")
    q = t.select(filters.mismatch_quality(F.col("maps")[0], F.col("quals")).alias("l"), filters.mismatch_quality(F.col("maps")[0], F.col("quals"), "sum").alias("s")).first()
    assert (q.l, q.s) == (ord("D"), ord("B") + ord("D"))


def test_sets_and_merge(spark):
    a = templates(spark, "ID\tACGT\t####\t1\tchr1:-:20:4", "x\tACGT\t0\t-")
    b = templates(spark, "ID\tACGT\t####\t1:1\tchr1:-:20:4,chr9:+:50:2C1")
    m = {r.tag: (r.c, r.t) for r in setops.file_union(a, b).select("tag", F.array_join(F.col("counters").cast("array<string>"), ":").alias("c"), T.texts(F.col("maps")).alias("t")).collect()}
    assert m == {"ID": ("1:1", "chr1:-:20:4,chr9:+:50:2C1"), "x": ("", "-")}
    assert kept(setops.file_difference(b, a)) == ["chr9:+:50:2C1"] and kept(setops.file_intersection(b, a)) == ["chr1:-:20:4"]
    near = templates(spark, "ID\tACGT\t1\tchr1:-:21:4")
    assert kept(setops.file_difference(a.where("tag = 'ID'"), near, tolerance=1)) == ["-"]
    assert [r.tag for r in setops.unmatched(a, b).collect()] == ["x"]


@pytest.mark.parametrize(("q", "f", "hit"), [((50, 100), (100, 200), False), ((50, 101), (100, 200), True), ((200, 250), (100, 200), False), ((199, 250), (100, 200), True), ((100, 100), (100, 200), True), ((200, 200), (100, 200), True), ((90, 110), (100, 100), True), ((90, 100), (100, 100), True), ((100, 110), (100, 100), False)])
def test_overlap_predicate(spark, q, f, hit):
    assert value(spark, intervals.hits(*(F.lit(x) for x in (*q, *f)))) == hit
    a = spark.createDataFrame([("c", *q)], "s string, a bigint, b bigint")
    b = spark.createDataFrame([("c", *f)], "t string, x bigint, y bigint")
    assert (intervals.overlap_join(a, b, ("s", "a", "b"), ("t", "x", "y")).count() == 1) == hit


def test_overlap_join_brute_force(spark):
    r = random.Random(4)
    def some(n, w):
        return [(i, r.choice("ab"), s, s + r.randint(-1, w)) for i in range(n) for s in [r.randint(0, 300_000)]]

    a, b = some(400, 2000), some(300, 90_000)
    x = spark.createDataFrame(a, "i int, s string, a bigint, b bigint")
    y = spark.createDataFrame(b, "j int, t string, x bigint, y bigint")
    got = {(q.i, q.j) for q in intervals.overlap_join(x, y, ("s", "a", "b"), ("t", "x", "y"), predicate=intervals.touches).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]}


def test_gene_counts(spark):
    f = spark.createDataFrame([(1, "c", "gene", 1, 500, "A", None), (2, "c", "exon", 1, 100, "A", "t"), (3, "c", "exon", 201, 300, "A", "t"), (4, "c", "exon", 250, 400, "B", "u")], "ann_id int, seq_name string, feature_type string, start_pos bigint, end_pos bigint, gene_id string, transcript_id string")
    cols = "template string, map_no int, end_no int, block_no int, n_blocks int, seq_name string, b_start bigint, b_end bigint"
    rows = [("split", 0, 1, 0, 2, "c", 50, 100), ("split", 0, 1, 1, 2, "c", 260, 290), ("one", 0, 1, 0, 1, "c", 350, 380), ("intron", 0, 1, 0, 1, "c", 120, 150), ("both", 0, 1, 0, 1, "c", 260, 290), ("pair", 0, 1, 0, 1, "c", 260, 290), ("pair", 0, 2, 0, 1, "c", 350, 390)]
    b = spark.createDataFrame(rows, cols)
    def count(**k):
        return {r.gene_id: r.n for r in intervals.gene_counts(b, f, **k).collect()}

    assert count() == {"A": 2.0, "B": 3.0}  # split and intron: A; one: B; the pair shares B only
    assert count(multi=True) == {"A": 3.0, "B": 4.0}
    assert count(multi=True, weighted=True) == {"A": 2.5, "B": 3.5}
    pat = {r.pattern: r.n for r in intervals.type_patterns(b.where("template <> 'pair'"), f).collect()}
    assert pat == {"exon^exon": 1, "exon": 1, "unknown": 1, "exon_mg": 1}


def test_coverage_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice("aab"), s, s + r.randint(0, 40)) for _ in range(300) for s in [r.randint(1, 500)]] + [("a", 5, 4), ("b", None, 4)]
    runs = coverage.depth_runs(spark.createDataFrame(rows, "q string, s bigint, e bigint").repartition(3), "q", "s", "e").collect()
    want = {}
    for q, s, e in rows:
        for p in range(s, e + 1) if s else ():
            want[q, p] = want.get((q, p), 0) + 1
    assert {(x.seq_name, p): x.depth for x in runs for p in range(x.start_pos, x.end_pos + 1)} == want


def test_scores(spark):
    t = templates(spark, "a\tACGT\t+JJJ\t1\tchr1:+:5:C2>1-", "b\tACGT\t1\tchr1:+:5:3T")
    got = [r.s for r in t.select(scoring.distance_score(F.col("maps")[0]["blocks"], F.col("quals")).alias("s")).collect()]
    assert got == [10 + 40, 30]
    p = scoring.pack(F.lit(7).cast("bigint"), F.lit(9).cast("bigint"), F.lit(200))
    assert value(spark, p) == 7 | 9 << 16 | 200 << 32 and tuple(value(spark, scoring.unpack(p))) == (7, 9, 200)
    q = spark.createDataFrame([("t", "c", 1, 0), ("t", "c", 2, 10), ("u", "c", 1, 5)], "t string, c string, p int, s bigint")
    assert {(r.t, r.p): r.phred for r in scoring.mapping_quality(q, ["t"], ["c", "p"], "s").collect()} == {("t", 1): 10, ("t", 2): 0, ("u", 1): 254}


def test_presets_and_pairing_by_position(spark):
    t = templates(spark, LINE)
    assert kept(filters.filter_templates(t, filters.ONLY_SPLITS)) == ["chr1:+:90:4>20*6"]
    assert kept(filters.filter_templates(t, filters.rnaseq_options(min_intron=30))) == ["chr1:+:5:10,chr2:-:7:9T:::9"]
    assert kept(filters.filter_templates(t, filters.rnaseq_options(level=0))) == ["chr1:+:5:10"]
    z = t.select(text.pair_by_position(F.col("maps"), F.slice("maps", 1, 1)).alias("z")).first().z
    assert [(p.m1 is None, p.m2 is None) for p in z] == [(False, False), (False, True), (False, True)]
    sinks.read_group("g1")
    assert sinks.sam_lines(t, ("RG",)).first().value.endswith("RG:Z:g1")


def test_running_sum(spark):
    from readloom.plans.prefix import running_sum

    r = random.Random(9)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), i, r.randint(-3, 9)) for i in range(400)]
    got = {x.i: (x.upto, x.total) for x in running_sum(spark.createDataFrame(rows, "g string, i int, v int").repartition(5), ["i"], "v", ["g"]).collect()}
    for g, i, _ in rows:
        mine = [(k, v) for h, k, v in rows if h == g]
        assert got[i] == (sum(v for k, v in mine if k <= i), sum(v for _, v in mine))
    plain = running_sum(spark.createDataFrame(rows, "g string, i int, v int"), ["i"], "v").where("i = 399").first()
    assert plain.upto == plain.total == sum(v for _, _, v in rows)


def test_ranks_and_interleaving(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(90)], "g string, i int").repartition(4)
    got = {(x.g, x.i): x.row_no for x in setops.rank_within(df, ["g"], ["i"]).collect()}
    assert all(got[None, i] == i // 3 for i in range(0, 90, 3)) and [got["a", i] for i in range(90) if i % 3] == list(range(60))


def test_duplicates(spark):
    rows = [("c", 1, "t1", "+")] * 2 + [("c", 1, "t1", "-"), ("c", 1, "t2", "+"), ("c", 2, "t1", "+")]
    c = stats.duplicate_classes(spark.createDataFrame(rows, "s string, p int, tile string, strand string"), ["s", "p"], "tile", "strand")
    assert {tuple(r) for r in c.collect()} == {(4, 1, 1, 2, 2, 1), (1, 1, 0, 0, 0, 0)}
    assert stats.duplicate_rate(c)["duplicate_rate"] == pytest.approx(0.6)


def test_junction_rules(spark):
    j = spark.createDataFrame([("c", "-", 90, "c", "-", 10), ("c", "+", 10, "c", "+", 90)], "seq1 string, strand1 string, pos1 bigint, seq2 string, strand2 string, pos2 bigint")
    assert [tuple(r) for r in junctions.union(junctions.normal(j)).collect()] == [("c", "+", 10, "c", "+", 90)]
    for d, a, s in [("GTAAA", "CCCAG", "+"), ("CTAAA", "CCCAC", "-"), ("AAAAA", "CCCCC", "0"), ("ATATC", "CCCAT", "+")]:
        assert value(spark, junctions.motif_strand(F.lit(d), F.lit(a))) == s


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[j - 1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_edit_script():
    r = random.Random(0)
    for _ in range(400):
        a, b = ("".join(r.choice("ACGT") for _ in range(r.randint(1, 10))) for _ in range(2))
        ops, _, cost = realign.edit_script(a, b)
        assert cost == lev(a, b) == sum(o["size"] or 1 for o in ops) and realign.check(a, b, ops) is None
        assert realign.recover(a, b, ops) is not None
        free = realign.edit_script(a, b, True)[2]
        assert free == min(lev(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
    assert realign.check("ACGT", "ACGA", []) == "mismatch"
    assert realign.edit_script("A", "C", weight=lambda x, y: 0.5 * (x != y))[2] == 0.5


def test_fastq_ranges(spark, tmp_path):
    rows = [(f"r{i}", "ACGT" * (i % 5 + 1), "@+II" * (i % 5 + 1)) for i in range(500)]
    sinks.write_text(sinks.fastq_lines(spark.createDataFrame(rows, "tag string, read string, quals string")), str(tmp_path / "q"))
    for size in (64, 1000, 1 << 20):
        assert sorted(map(tuple, fastx.read_fastq(spark, str(tmp_path / "q"), size).collect())) == sorted(rows)


def test_formats(spark, tmp_path):
    assert text.guess_format("x/a.FASTQ.gz") == "fastq" and text.find_pair("r_1.fastq.gz") == "r_2.fastq.gz" and text.find_pair("r.map") is None
    t = templates(spark, "a x\tACGT\t!!!!\t1\tchr1:-:5:4")
    assert [r.value for r in sinks.sam_lines(t).collect()] == ["a\t16\tchr1\t5\t254\t4M\t*\t0\t0\tACGT\t!!!!\tNH:i:1\tNM:i:0\tXT:A:U"]
    sinks.write(t, str(tmp_path / "m"), "map", "gzip")
    assert text.load(spark, str(tmp_path / "m")).count() == 1
    assert [r.value for r in sinks.sam_lines(templates(spark, "a\tACGT\t0\t-")).collect()][0].startswith("a\t4\t*\t0\t0\t*")


def test_reads(spark):
    assert value(spark, S.reverse_complement(F.lit("ACGTN"))) == "NACGT"
    assert value(spark, S.uniform_read(F.lit("nnacxgNN"))) == "ACNG"
    assert [tuple(x) for x in value(spark, S.chunks(F.lit("ABCDEFGH"), 3, 3, min_rest=2))] == [(0, "ABC"), (3, "DEF"), (6, "GH")]
    assert value(spark, S.parse_tag(F.lit("A/1"))).pair == 1 and value(spark, S.parse_tag(F.lit("A 2:N:0:ACGT more"))).extra == "more"


def test_pipeline(spark, tmp_path):
    ran = []

    def one():
        ran.append("one")
        return spark.range(3)

    p = Pipeline(spark, str(tmp_path), [Step("two", lambda a: a.selectExpr("id * 2 as id"), ("one",)), Step("one", one, final=False)])
    assert p.run(dry=True) == ["one", "two"] and p.run() == ["one", "two"] and p.run() == [] and ran == ["one"]
    assert p.table("two").count() == 3 and p.cleanup() == ["one"]
    c = PipelineConfig(output="x", min_intron=5)
    c.save(str(tmp_path / "c.json"))
    assert PipelineConfig.load(str(tmp_path / "c.json")) == c


def test_command_line(spark, tmp_path, monkeypatch):
    from readloom import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda **k: spark)
    (tmp_path / "a.map").write_text(LINE + "\n")
    cli.main(["filter", "-i", str(tmp_path / "a.map"), "-o", str(tmp_path / "out"), "--strand", "-"])
    assert text.read_map(spark, str(tmp_path / "out")).selectExpr("size(maps) n").first().n == 1


def test_rna_pipeline(spark, tmp_path):
    from readloom.plans.pipeline import rna_pipeline

    ann = spark.createDataFrame([(1, "chr1", "exon", 1, 60, "G", "T", "+")], "ann_id int, seq_name string, feature_type string, start_pos bigint, end_pos bigint, gene_id string, transcript_id string, strand string")
    p = rna_pipeline(spark, PipelineConfig(output=str(tmp_path / "rna")), templates(spark, LINE).withColumn("template", F.col("tag")), ann)
    p.run()
    assert {r.gene_id for r in p.table("counts").collect()} == {"G"} and p.table("statistics").first().reads == 1
