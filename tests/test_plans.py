"""Plans: only the columns used are read, filters reach the scan, and no join compares all pairs."""

import re

import pytest


def plan(spark, sf, name):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [("stats_strand", {"map_id", "tag", "seq_name", "strand", "maps"}), ("stats_population", {"map_id", "tag", "seq_name", "maps"}), ("nucleotide_counts", {"read_id", "read_seq"}), ("strand_filter", {"line_id", "file_kind", "raw_line"})],
)
def test_read_schema(spark, sf, name, columns):
    read = re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, sf, name))
    assert read and all({c.split(":")[0] for c in r.split(",")} == columns for r in read)


def test_filters_reach_the_scan(spark, sf):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(file_kind,map\)", plan(spark, sf, "strand_filter"))


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p6_found", "interval_join", "pairing_join", "gene_counts", "coverage_targets", "set_union", "reference_chunks", "novel_junction_support"])
def test_no_nested_loops(spark, sf, name):
    p = plan(spark, sf, name)
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_filters_need_no_shuffle(spark, sf):
    for name in ("filter_pipeline", "strata_after_best", "keep_unique", "sort_maps", "reduce_unique_strata"):
        assert "Exchange" not in plan(spark, sf, name)


def test_a_cluster_needs_a_shared_folder(spark):
    """Without one every machine would write to a folder of its own; the package reaches its workers as an archive."""
    from types import SimpleNamespace

    from readloom.plans import runtime

    sent = []
    sc = SimpleNamespace(master="spark://host:7077", applicationId="app-1", environment={}, addPyFile=sent.append)
    cluster = SimpleNamespace(sparkContext=sc, conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(cluster)
    cluster.conf = {"spark.checkpoint.dir": "hdfs:///shared"}
    assert runtime.shared_dir(cluster) == "hdfs:///shared"
    runtime.ship_package(cluster)
    runtime.ship_package(cluster)
    assert len(sent) == 1 and sent[0].endswith("readloom.zip")
    assert runtime.shared_dir(spark).startswith("file:///") and runtime.is_local(spark)
