"""Sources that tell their faults, long features, pairs and their genes, SAM templates, the pipeline's own parameters."""

import bz2
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.operators import filters as P
from readloom.operators import intervals as I
from readloom.operators import junctions as J
from readloom.operators import pairs as Q
from readloom.operators import setops as U
from readloom.operators import templates as T
from readloom.plans.pipeline import PipelineConfig, rna_pipeline
from readloom.sources import fastx, sinks, text


def maps(spark, *lines):
    return T.from_map_lines(spark.createDataFrame([(s,) for s in lines], "value string"), "value")


def test_fastq_tells_what_is_no_record(spark, tmp_path):
    good = "@a\nACGT\n+\n@@@@\n"
    (tmp_path / "x.fastq").write_text(good + "stray\n" + "@b\nAC\nno plus\n!!\n" + good.replace("a", "c") + "@d\nAC")
    rows = fastx.read_fastq(spark, str(tmp_path / "x.fastq"), faults=True).collect()
    assert [(r.tag, r.read, r.quals) for r in rows if r.fault is None] == [("a", "ACGT", "@@@@"), ("c", "ACGT", "@@@@")]
    assert [(r.at, r.fault) for r in rows if r.fault] == [(15, "no record starts here"), (21, "no line of +"), (24, "no record starts here"), (27, "no record starts here"), (35, "no record starts here"), (53, "truncated")]
    assert [r.tag for r in fastx.read_fastq(spark, str(tmp_path / "x.fastq")).collect()] == ["a", "c"]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress])
def test_compression_is_told_by_the_first_bytes(spark, tmp_path, pack):
    line = "a\tACGT\t1\tchr1:+:5:4\n"
    (tmp_path / "x.map").write_bytes(pack(line.encode()))
    (tmp_path / "y.fq").write_bytes(pack(b"@a\nAC\n+\n!!\n"))
    assert text.load(spark, str(tmp_path / "x.map")).select("tag").collect()[0].tag == "a"
    assert fastx.read_fastq(spark, str(tmp_path / "y.fq")).count() == 1


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"@a\nAC\n+\n!!\n@b\nAC\n+\n!!\n")))
    assert {r.tag for r in text.load(spark, "-").collect()} == {"a", "b"}


def test_features_of_any_length(spark):
    rnd = random.Random(3)
    span = lambda: (s := rnd.randint(1, 1 << 33), s + rnd.choice([0, 5, 1 << 12, 1 << 21, 1 << 24, 1 << 27, 1 << 32]))
    left, right = [(i, *span()) for i in range(150)], [(i, *span()) for i in range(120)]
    a = spark.createDataFrame([(i, "q", s, e) for i, s, e in left], "i int, q string, s bigint, e bigint")
    b = spark.createDataFrame([(i, "q", s, e) for i, s, e in right], "j int, fq string, fs bigint, fe bigint")
    got = [(r.i, r.j) for r in I.overlap_join(a, b, ("q", "s", "e"), ("fq", "fs", "fe"), I.touches).collect()]
    want = {(i, j) for i, s, e in left for j, fs, fe in right if s <= fe and e >= fs}
    assert len(got) == len(set(got)) and set(got) == want
    assert I._cover(F.lit(1), F.lit(2)) is not None


FEATURES = [("chr1", "exon", 1, 500, "A", "A1"), ("chr1", "exon", 600, 800, "B", "B1"), ("chr1", "exon", 900, 1100, "B", "B1"), ("chr1", "exon", 1000, 1200, "C", "C1"), ("chr1", "gene", 600, 1100, "B", None), ("chr1", "gene", 1000, 1500, "C", None)]


def test_genes_of_pairs(spark):
    """Counts of pairs by the rules: both ends, one end, ends that share a gene, several genes, single ends beside pairs."""
    f = spark.createDataFrame(FEATURES, "seq_name string, feature_type string, start_pos bigint, end_pos bigint, gene_id string, transcript_id string")
    read = "A" * 10 + " " + "A" * 10
    one = lambda tag, *pairs: (f"{tag}\t{read}\t{len(pairs)}\t" + ",".join(f"chr1:+:{a}:10::chr1:-:{b}:10" for a, b in pairs),)
    pairs = Q.from_map_lines(spark.createDataFrame([one("p1", (10, 100)), one("p2", (10, 2000)), one("p3", (10, 650)), one("p4", (1010, 1150)), one("p5", (1010, 1050)), one("p6", (10, 60), (610, 660))], "value string"))
    b = I.pair_blocks(pairs, "tag")
    count = lambda x=b, **kw: {r.gene_id: r.n for r in I.gene_counts(x, f, **kw).collect()}
    # p1 both in A; p2 one end in A, the other in none; p3 no gene in common; p4 end 1 in B and C, end 2 in C; p5 both in B and C; p6 A or B
    assert count(paired=True) == {"A": 4, "C": 2}
    assert count(paired=True, single_ends=True) == {"A": 3, "C": 2}
    assert count(paired=True, multi=True) == {"A": 6, "B": 4, "C": 4}
    assert count(paired=True, multi=True, weighted=True) == {"A": 5, "B": 2, "C": 3}
    assert count(paired=True, exon_overlap=1.0) == {"A": 2, "C": 2}
    assert count(paired=True, exon_overlap=0.5) == {"A": 4, "C": 2}
    n = spark.createDataFrame([(f"p{i}", 21) for i in range(1, 7)], "template string, bases int")
    assert count(paired=True, single_ends=True, lengths=n) == {"A": 31, "C": 21}
    single = T.block_rows(maps(spark, "s1\tAAAAAAAAAA\t1\tchr1:+:20:10").withColumn("template", F.col("tag")), ("template",))
    s = single.select("template", "map_no", F.lit(1).alias("end_no"), F.lit(1).alias("n_ends"), "block_no", "n_blocks", "seq_name", "strand", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    both = b.unionByName(s)
    assert count(both, paired=True) == {"A": 4, "C": 2} and count(both, paired=True, single_ends=True) == {"A": 4, "C": 2} and count(both) == {"A": 5, "C": 2}


def test_union_of_pairs_and_shares(spark):
    line = lambda tag, m: (f"{tag}\tACGT ACGT\t1\t{m}",)
    a = Q.from_map_lines(spark.createDataFrame([line("x", "c:+:1:4::c:-:9:4"), line("y", "-")], "value string"))
    b = Q.from_map_lines(spark.createDataFrame([line("x", "c:+:1:4::c:-:9:4,c:+:1:4::"), line("y", "c:+:1:4::c:-:9:4"), line("z", "-")], "value string"))
    got = {r.tag: [p.txt for p in r.mmaps] for r in U.pair_union(a, b).collect()}
    assert got == {"x": ["c:+:1:4::c:-:9:4", "c:+:1:4::"], "y": ["c:+:1:4::c:-:9:4"]}
    x, y = maps(spark, "a\tACGTACGTAC\t1\tc:+:5:10"), maps(spark, "a\tACGTACGTAC\t1\tc:+:7:10")
    left = lambda t: [r.maps for r in U.file_difference(x, y, tolerance=t).select(F.size("maps").alias("maps")).collect()][0]
    assert (left(0.1), left(0.2), left(2), left(None)) == (1, 0, 0, 1)


def test_merge_of_unlike_inputs_fails(spark):
    x, y = maps(spark, "a\tAC\t1\tc:+:5:2", "b\tAC\t0\t-"), maps(spark, "a\tAC\t1\tc:-:5:2")
    with pytest.raises(Exception, match="inputs of the same reads differ at b"):
        U.merge(x, y, same_reads=True).collect()
    assert U.merge(x.where("tag = 'a'"), y, same_reads=True).count() == 1
    assert [r.tag for r in U.unmatched(x, y).collect()] == ["b"]


def test_hostile_counters(spark):
    got = spark.createDataFrame([("1:0x3:2",), ("0x4000000000",), ("1:0x99999999999999999999",), ("0x100001",)], "t string").select(C.parse_counters(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [[1, 0, 0, 0, 2], None, None, None]


def test_sam_becomes_templates(spark, tmp_path):
    lines = ["@HD\tVN:1.0", "q\t16\tchr1\t5\t60\t2M3N2M\t*\t0\t0\tACGG\t!\"#$\tXA:Z:chr2,+7,4M,1;", "q\t272\tchr3\t9\t3\t4M\t*\t0\t0\t*\t*", "u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*"]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    t = {r.tag: r for r in text.load(spark, str(tmp_path / "x.sam")).collect()}
    assert t["q"].read == "CCGT" and t["q"].quals == "$#\"!" and t["u"].maps == [] and t["u"].read == "AC"
    assert [m.txt for m in t["q"].maps] == ["chr1:-:5:2>3*2", "chr3:-:9:4", "chr2:+:7:4"] and t["q"].phreds == [60, 3, None]
    high = P.filter_templates(text.load(spark, str(tmp_path / "x.sam")), P.FilterOptions(scores=((50, 60),)))
    assert {r.tag: (r.n, r.phreds) for r in high.select("tag", F.size("maps").alias("n"), "phreds").collect()} == {"q": (1, [60]), "u": (0, [])}
    out = {r.value.split("\t")[0]: r.value.split("\t") for r in sinks.map_lines(text.load(spark, str(tmp_path / "x.sam"))).collect()}
    assert out["q"][1] == "CCGT" and "chr1:-:5:2>3*2" in out["q"][-1]


def test_fields_of_sam_records(spark):
    t = maps(spark, "r 1:N:0:ACG\tACGTACGT\t1\tchr1:+:3:4>10*4")
    ref = spark.createDataFrame([("chr1", "AAAAAA" + "GTTTTTTTAG" + "CCCC")], "name string, sequence string")
    x = J.with_strand(t, "tag", fastx.reference_chunks(ref, 8), 8)
    assert sinks.sam_lines(x, ("md", "cs", "XS")).collect()[0].value.split("\t")[4:] == ["254", "4M10N4M", "*", "0", "0", "ACGTACGT", "*", "md:Z:4>10*4", "cs:Z:1:N:0:ACG", "XS:A:+"]


def test_strata_options(spark):
    t = maps(spark, "a\tACGTACGTAC\t1:1:0:1\tc:+:1:10,c:+:2:9A,c:+:3:7AAA")
    n = lambda o: P.filter_templates(t, o).select(F.size("maps").alias("n")).first().n
    assert n(P.rnaseq_options(max_strata=1)) == 2 and n(P.rnaseq_options(max_strata=0.3)) == 3 and n(P.rnaseq_options()) == 3
    assert n(P.FilterOptions(max_strata_after_best=0.1)) == 2 and n(P.FilterOptions(max_strata_after_best=3)) == 3


def test_pipeline_uses_its_parameters(spark, tmp_path):
    f = spark.createDataFrame(FEATURES, "seq_name string, feature_type string, start_pos bigint, end_pos bigint, gene_id string, transcript_id string").withColumn("strand", F.lit("+")).withColumn("ann_id", F.monotonically_increasing_id())
    t = maps(spark, "a\tAAAAAAAAAA\t1\tchr1:+:10:10", "b\tAAAAAAAAAA\t1\tchr1:+:495:10", "c\tAAAAAAAAAA\t1\tchr1:+:700:5>90*5", "d\tAAAAAAAAAA\t1\tchr1:+:700:5>190*5").withColumn("template", F.col("tag"))
    pairs = Q.from_map_lines(spark.createDataFrame([("p\tAAAA AAAA\t1\tchr1:+:10:4::chr1:-:50:4",)], "value string")).withColumn("template", F.col("tag"))

    def run(name, **kw):
        c = PipelineConfig(output=f"file://{tmp_path}/{name}", min_intron=0, junction_coverage=1, **kw)
        p = rna_pipeline(spark, c, t, f, pairs)
        p.run()
        return {r.gene_id: r.n for r in p.table("counts").collect()}, {r.right - r.left for r in p.table("junctions").collect()}

    assert run("a", exon_overlap=0.0, count_pairs=False) == ({"A": 2, "B": 2}, {91, 191})
    assert run("b", exon_overlap=1.0, count_pairs=False, junction_distance=(4, 100)) == ({"A": 1, "B": 1}, {91})
    assert run("c", exon_overlap=0.0, junction_distance=(100, 1000)) == ({"A": 2}, {191})
    assert run("d", exon_overlap=0.0, count_pairs=False, extra={"no_splits": True})[0] == {"A": 2}


def test_commands(spark, tmp_path):
    """Every command over small files."""
    from readloom.__main__ import parser

    d = str(tmp_path)
    (tmp_path / "a.map").write_text("r/1 1:N:0:ACG\tACGTACGTAC\t\"\"\"\"\"\"\"\"\"\"\t1:1\tchr1:+:10:10,chr1:-:700:5>90*5\nu\tACGTACGTAC\t\"\"\"\"\"\"\"\"\"\"\t0\t-\n")
    (tmp_path / "b.map").write_text("r/1 1:N:0:ACG\tACGTACGTAC\t\"\"\"\"\"\"\"\"\"\"\t1\tchr1:-:120:10\nu\tACGTACGTAC\t\"\"\"\"\"\"\"\"\"\"\t0\t-\n")
    (tmp_path / "p.map").write_text("p\tACGT ACGT\t1\tchr1:+:10:4::chr1:-:50:4\nq\tACGT ACGT\t1\tchr1:+:10:4::chr1:+:50:4\n")
    (tmp_path / "x.sam").write_text("s\t0\tchr1\t10\t60\t4M\t*\t0\t0\tACGT\t!!!!\n")
    (tmp_path / "g.gtf").write_text("".join(f'{q}\tx\t{t}\t{s}\t{e}\t.\t+\t.\tgene_id "{g}"; transcript_id "{g}1"; gene_type "protein_coding";\n' for q, t, s, e, g in [("chr1", "exon", 1, 500, "A"), ("chr1", "exon", 600, 704, "B"), ("chr1", "exon", 795, 900, "B")]))
    (tmp_path / "t.tsv").write_text("chr1\t1\t100\tt\n")
    (tmp_path / "q.tsv").write_text("chr1\t1000\n")
    (tmp_path / "r.fa").write_text(">chr1\n" + "ACGTAGGT" * 125 + "\n")

    def run(*args, out="o"):
        out = f"{d}/{out}{len(list(tmp_path.iterdir()))}"
        a = parser().parse_args([*args, "-o", out])
        a.run(spark, a)
        return sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(out).collect())

    f = lambda *o: run("filter", "-i", f"{d}/a.map", *o)
    assert len(f()) == 2 and len(f("--mapped")) == 1 and f("--mapped", "--no-split-maps")[0].endswith("\tchr1:+:10:10")
    assert f("--mapped", "--strandedness", "R")[0].endswith("chr1:-:700:5>90*5") and f("--hard-trim", "2,2", "--mapped")[0].split("\t")[1] == "GTACGT"
    assert f("--annotation", f"{d}/g.gtf", "--reduce-by-junctions", "--mapped")[0].count("chr1") == 2 and f("--sequence-list") == ["chr1"]
    assert f("--mapped", "--qualities-to-offset-64")[0].split("\t")[2] == "A" * 10 and len(f("--sample-read", "4,4,0,0")) == 8
    assert run("filter", "-i", f"{d}/x.sam", "--filter-quality", "50,70")[0].endswith("chr1:+:10:4") and f("--display-pretty", "--mapped", "--max-strata", "0")
    f("--mapped", "--discarded-output", f"{d}/gone")
    assert spark.read.text(f"{d}/gone").count() == 1
    assert [x.split("\t")[0] for x in run("filter", "-p", "-i", f"{d}/p.map", "--pair-strandedness", "FR") if x.endswith("4")] == ["p"]
    assert len(run("filter", "-p", "-i", f"{d}/p.map", "--min-inss", "10", "--reduce-to-pairs", "--output-format", "sam")) == 4
    assert run("convert", "-i", f"{d}/x.sam", "--format", "map") == ["s\tACGT\t!!!!\t1\tchr1:+:10:4"]
    sam = run("map2sam", "-i", f"{d}/a.map", "--sequences", f"{d}/q.tsv", "-r", f"{d}/r.fa")
    assert any(x.startswith("@SQ\tSN:chr1") for x in sam) and any("XS:A:" in x for x in sam) and any("md:Z:5>90*5" in x for x in sam)
    assert any(x.startswith("multimaps\t5\t1\t50.00%") for x in run("stats", "-i", f"{d}/a.map")) and any("bases_aligned" in x for x in run("stats", "-i", f"{d}/a.map", "-f", "both"))
    assert run("gtfcount", "-i", f"{d}/p.map", "-a", f"{d}/g.gtf", "-p") == ["A\t4"] and run("gtfcount", "-i", f"{d}/a.map", "-a", f"{d}/g.gtf", "-m", "-w") == ["A\t0.5000", "B\t0.5000"]
    assert len(run("merge", "-i", f"{d}/a.map", f"{d}/b.map", "--same")) == 2 and any("chr1:-:120:10" in x for x in run("mapset", "-i", f"{d}/a.map", f"{d}/b.map", "-C", "union"))
    assert len(run("mapset", "-i", f"{d}/a.map", f"{d}/b.map", "-C", "compare")) == 2
    assert run("scorereads", "-i", f"{d}/a.map", f"{d}/b.map") == ["r\tchr1:+:10:10\tchr1:-:120:10\t121", "r\tchr1:-:700:5>90*5\t0\t*"]
    assert "chr1\t10\t19\t1" in run("coverage", "-i", f"{d}/a.map") and run("coverage", "-i", f"{d}/a.map", "--targets", f"{d}/t.tsv") == ["chr1\t1\t100\tt\t10\t10"]
    assert any('"part":"reads"' in x for x in run("align-stats", "-i", f"{d}/a.map"))
    assert run("gtf-junctions", "-i", f"{d}/g.gtf") == ["chr1\t+\t704\tchr1\t+\t795"] and run("denovo-junctions", "-i", f"{d}/a.map", "-a", f"{d}/g.gtf") == ["chr1\t704\t795\t1"]
    assert run("search", "-a", f"{d}/g.gtf", "chr1:650-660") and len(run("search", "-a", f"{d}/g.gtf", "chr1:650-800", "exon")) == 2
    a = parser().parse_args(["rna-pipeline", "-i", f"{d}/a.map", "-a", f"{d}/g.gtf", "-o", f"file://{d}/pipe", "--dry"])
    a.run(spark, a)
