"""Findings of round 2: what the plans of large queries compute, and how often."""

import duckdb

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_pairs_are_written_and_parsed_once(spark):
    lines = plan(entry.queries()["reduce_to_pairs"](spark, DATA))
    # No candidate of the join is written as text, and no mapping is parsed by a filter.
    assert any("Join" in x for x in lines) and not any("RLIKE" in x for x in lines if "Join" in x)
    assert not any("regexp_extract_all" in x for x in lines if "Filter" in x)


def test_type_patterns_plans_the_overlap_join_once(spark):
    text = "\n".join(plan(entry.queries()["type_patterns"](spark, DATA)))
    # Neither the mappings' text nor the join with features is part of the last plan.
    assert "regexp_extract_all" not in text and "shiftright" not in text


def test_type_patterns_of_single_mappings(spark, tmp_path):
    rows = [
        (1, "a", 1, "chr1:+:100:50"), (1, "a", 1, "chr1:+:100:50"),  # delivered twice
        (2, "b", 1, "chr1:+:100:50>400*50"), (3, "c", 1, "chr1:+:100:50"), (4, "c", 1, "chr1:+:9000:50"),  # c has two mappings
        (5, "c", 2, "chr1:+:9000:50"), (6, "d", 1, "-"), (7, "d", 1, "chr1:-:600:50"), (8, None, 1, "chr1:+:100:50"),  # no tag, no template
    ]
    m = spark.createDataFrame(rows, "map_id bigint, tag string, end_no int, maps string").selectExpr("*", "'chr1' seq_name", "substring(maps, 6, 1) strand")
    m.write.parquet(f"{tmp_path}/mappings.parquet")
    f = [(1, "exon", 90, 200, "g"), (2, "exon", 90, 210, "h"), (3, "intron", 500, 620, "g"), (4, "gene", 500, 700, None)]
    f = spark.createDataFrame(f, "ann_id bigint, feature_type string, start_pos bigint, end_pos bigint, gene_id string").selectExpr("*", "'chr1' seq_name", "'+' strand", "'t' transcript_id", "'x' gene_type", "'s' ann_source", "'.' score", "1 loaded_at")
    f.write.parquet(f"{tmp_path}/annotations.parquet")
    got = {r.pattern: r.n for r in entry.queries()["type_patterns"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("mappings", "annotations"):
        con.execute(f"CREATE VIEW {t}_ AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    con.execute("CREATE VIEW mappings AS SELECT *, TRY_CAST(split_part(maps, ':', 3) AS BIGINT) AS pos, 0 AS n_edits, 0 AS gt_score, 0 AS phred_score, 0 AS tlen, '' AS run_id FROM mappings_")
    con.execute("CREATE VIEW annotations AS SELECT * FROM annotations_")
    assert got == dict(con.execute(entry.oracle_sql()["type_patterns"]).fetchall()) and sum(got.values()) == 4
