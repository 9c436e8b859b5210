"""Queries over small tables that hold the cases a narrower query would leave out."""

from collections import Counter



def run(spark, d, name):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, str(d))


def map_table(spark, d, *lines):
    spark.createDataFrame([(i, "map", x) for i, x in enumerate(lines)], "line_id bigint, file_kind string, raw_line string").write.parquet(f"{d}/raw_records.parquet")


def test_errors_of_all_mappings(spark, tmp_path):
    map_table(spark, tmp_path, "a\tACGTACGTAC\tABCDEFGHIJ\t1\tchr1:+:5:2>1+1T6,chr1:-:90:4>20*1A4,chr2:+:7:(2)3C>1-3,chr2:+:9:9T")
    pos = {r.pos: r.value for r in run(spark, tmp_path, "error_positions").collect()}
    assert pos == {2: 1, 3: 1, 5: 2, 0: 1, 6: 1, 9: 1}
    matrix = {(r.read_base, r.ref_base): r.value for r in run(spark, tmp_path, "transition_matrix").collect()}
    assert matrix == {("T", "T"): 1, ("C", "A"): 1, ("C", "C"): 1, ("C", "T"): 1}
    context = Counter({(r.prev_base, r.read_base, r.next_base, r.ref_base): r.value for r in run(spark, tmp_path, "transition_context").collect()})
    assert context == {("G", "T", "A", "T"): 1, ("A", "C", "G", "A"): 1, ("A", "C", "G", "C"): 1, ("A", "C", "", "T"): 1}
    assert {r.qual: r.value for r in run(spark, tmp_path, "mismatch_qualities").collect()} == {ord("D"): 1, ord("F"): 2, ord("J"): 1}


def mappings(spark, d, *rows):
    cols = "map_id bigint, tag string, end_no int, seq_name string, strand string, pos bigint, maps string, n_edits bigint, gt_score bigint, phred_score int, tlen bigint, run_id bigint"
    spark.createDataFrame([(i, tag, end, *m.split(":")[:2], int(m.split(":")[2]), m, 0, score, 0, 0, 1) for i, tag, end, m, score in rows], cols).write.parquet(f"{d}/mappings.parquet")


def test_pairs_of_split_ends(spark, tmp_path):
    # The starts of 5 and 6 lie 200,000 apart; 7 and 8 disagree on the junction.
    mappings(
        spark, tmp_path,
        (1, "a", 1, "chr1:+:1000:10", 0), (2, "a", 2, "chr1:-:1300:10", 0), (3, "b", 1, "chr1:+:1000:10", 0), (4, "b", 2, "chr1:-:1300:4>500*6", 0),
        (5, "c", 1, "chr1:+:1000:10>199980*20", 0), (6, "c", 2, "chr1:-:201000:30", 0), (7, "d", 1, "chr1:+:1000:10>20*20", 0), (8, "d", 2, "chr1:-:1035:14>21*10", 0),
    )
    pairs = {(r.id1, r.id2): r.insert_size for r in run(spark, tmp_path, "pairing_join").collect()}
    assert pairs == {(1, 2): 311, (3, 4): 311, (5, 6): 31, (7, 8): 20}
    assert {(r.id1, r.id2) for r in run(spark, tmp_path, "pair_coherence").collect()} == {(1, 2), (3, 4), (5, 6)}
    t = {r.id1: (r.n1, r.n2, r.distance) for r in run(spark, tmp_path, "paired_templates").collect()}
    assert t == {1: (10, 10, 0), 3: (10, 10, 1), 5: (30, 30, 1), 7: (30, 24, 2)}
    assert {r.id1: r.tlen for r in run(spark, tmp_path, "template_size").collect()} == {1: 310, 3: 810, 5: 200030, 7: 80}


def test_sets_of_whole_inputs(spark, tmp_path):
    line = "a\tACGT\t1\tchr1:+:5:4,chr2:-:7:4"
    map_table(spark, tmp_path, line, line, line, line)
    got = {n: {tuple(r) for r in run(spark, tmp_path, n).collect()} for n in ("set_union", "set_intersection", "set_compare", "set_join", "merge_same_reads", "set_difference", "set_difference_tolerant", "merge_subset")}
    one = {n: {r[1:] for r in rows} for n, rows in got.items()}
    assert all(len(rows) == 4 for rows in got.values())
    assert one["set_union"] == {("chr1:+:5:4,chr2:+:7:4,chr2:-:7:4",)} and one["set_intersection"] == {("chr1:+:5:4",)}
    assert one["set_compare"] == {("1", "1", "1", "chr2:-:7:4", "chr2:+:7:4", "chr1:+:5:4")} and one["set_join"] == {("2", "2", "chr1:+:5:4,chr2:-:7:4", "chr1:+:5:4,chr2:+:7:4")}
    assert one["merge_same_reads"] == one["merge_subset"] == {("chr1:+:5:4,chr2:-:7:4,chr2:+:7:4",)}
    assert one["set_difference"] == one["set_difference_tolerant"] == {("chr2:-:7:4",)}


def test_short_reads(spark, tmp_path):
    reads = [(1, "ACGTACGTACGTACG"), (2, "GTAAAAAG"), (3, "A")]
    spark.createDataFrame(reads, "read_id bigint, read_seq string").write.parquet(f"{tmp_path}/fastq_reads.parquet")
    got = {n: {int(r[0]): r[1] for r in run(spark, tmp_path, n).collect()} for n in ("reference_chunks", "hamming_ops", "realign_levenshtein", "alignment_check", "splice_strand")}
    assert all(set(x) == {1, 2, 3} for x in got.values())
    assert got["reference_chunks"][1] == "CGTAC"
    assert got["hamming_ops"][3] == 0 and got["splice_strand"][2] == "+" and got["alignment_check"][1] is None
