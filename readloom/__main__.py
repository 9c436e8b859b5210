"""Command line: ``python -m readloom COMMAND …``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import coverage as V
from readloom.operators import filters as P
from readloom.operators import intervals as I
from readloom.operators import junctions as J
from readloom.operators import pairs as Q
from readloom.operators import scoring as R
from readloom.operators import setops as U
from readloom.operators import stats as A
from readloom.operators import templates as T
from readloom.plans.pipeline import PipelineConfig, rna_pipeline
from readloom.plans.runtime import session
from readloom.sources import fastx, sinks, text


def _blocks(t, template: str = "tag"):
    b = T.block_rows(t.withColumn("template", F.col(template)), ("template",))
    return b.select("template", "map_no", F.lit(1).alias("end_no"), F.lit(1).alias("n_ends"), "block_no", "n_blocks", "seq_name", "strand", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))


def _annotation(spark, path):
    return text.read_gtf(spark, path).withColumn("ann_id", F.monotonically_increasing_id())


def _pairs(spark, path):
    return Q.from_map_lines(fastx.read_lines(spark, path), "value")


def _range(lo, hi, least, most):
    return None if lo is None and hi is None else (least if lo is None else lo, most if hi is None else hi)


def filter_options(a) -> P.FilterOptions:
    """The options of the command line as those of :func:`readloom.operators.filters.filter_templates`."""
    two = lambda s, kind=int: tuple(kind(v) for v in s.split(","))
    extra = []
    if a.reduce_by_gene_id or a.reduce_to_protein_coding or a.reduce_by_junctions:
        extra.append(lambda t: I.reduce_by_annotation(t, a.features, "_row", a.reduce_by_gene_id, a.reduce_to_protein_coding, a.reduce_by_junctions))
    return P.FilterOptions(
        no_penalty_for_splits=a.no_penalty_for_splitmaps, uniform=a.uniform_read is not None, remove_qualities=a.remove_qualities, add_qualities=a.add_qualities, mapped=a.mapped, unmapped=a.unmapped,
        unique_level=a.unique_level, length=_range(a.min_length, a.max_length, 0, 1 << 40), n_maps=_range(a.min_maps, a.max_maps, 0, 1 << 30), trim=two(a.hard_trim) if a.hard_trim else None,
        sequences=tuple(a.map_id.split(",")) if a.map_id else (), max_strata_after_best=a.max_strata_after_map, strata=_range(a.min_strata, a.max_strata, 0, 1 << 30), levenshtein=_range(a.min_levenshtein_error, a.max_levenshtein_error, 0, 1 << 30),
        strand={"F": "+", "R": "-"}.get(a.strandedness, a.strandedness), scores=tuple(two(q) for q in a.filter_quality or ()), reduce_by_quality=a.reduce_by_quality, first_map=a.first_map, keep_first_map=a.keep_first_map,
        keep_unique=a.keep_unique, only_splits=a.only_split_maps, no_splits=a.no_split_maps, min_intron=a.min_intron_length, min_block=a.min_block_length, to_unique_strata=a.reduce_to_unique_strata,
        to_max_maps=a.reduce_to_max_maps, prune=None if a.max_decoded_matches is None and a.min_decoded_strata is None else (a.min_decoded_strata or 0, 1 << 30 if a.max_decoded_matches is None else a.max_decoded_matches),
        max_output=a.max_output_matches, extra=tuple(extra),
    )


def filter_(spark, a):
    """Filter records and their mappings."""
    if a.paired_end:
        x = _pairs(spark, a.input)
        if a.mapped or a.unmapped:
            x = x.where((F.size("mmaps") > 0) == F.lit(bool(a.mapped)))
        x = Q.on_sequences(x, a.map_id.split(",")) if a.map_id else x
        x = Q.on_strands(x, a.pair_strandedness.split(",")) if a.pair_strandedness else x
        x = Q.insert_between(x, -(1 << 40) if a.min_inss is None else a.min_inss, 1 << 40 if a.max_inss is None else a.max_inss) if (a.min_inss, a.max_inss) != (None, None) else x
        x = Q.reduce_to_pairs(x) if a.reduce_to_pairs else Q.recount(x)
        sinks.write_text(Q.sam_lines(x) if a.output_format == "sam" else Q.map_lines(x), a.output, a.compression)
        return
    t = text.load(spark, a.input)
    a.features = _annotation(spark, a.annotation) if a.annotation else None
    if a.annotation:
        from readloom.plans.runtime import materialize

        t = materialize(t.withColumn("_row", F.monotonically_increasing_id()))
    if a.max_input_matches is not None:
        t = P.prune_strata(t, 0, a.max_input_matches)
    for by, flag in ((-31, a.qualities_to_offset_33), (31, a.qualities_to_offset_64)):
        t = t.withColumn("quals", S.shift_qualities(F.col("quals"), by)) if flag else t
    t = T.recount(t) if a.make_counters else t
    o = filter_options(a)
    if a.discarded_output:
        keep = F.lit(True)
        for on, cond in ((o.mapped, P.mapped()), (o.unmapped, ~P.mapped()), (o.unique_level is not None, P.unique_at(o.unique_level or 0)), (o.length, P.read_length_between(*(o.length or (0, 0)))), (o.n_maps, P.maps_between(*(o.n_maps or (0, 0))))):
            keep = keep & cond if on else keep
        sinks.write(sinks.split_discarded(t, keep)[1], a.discarded_output, "map", a.compression)
    out = P.filter_templates(t, o)
    out = P.restore_trim(out) if a.restore_trim and "trimmed" in out.columns else out
    if a.group_read_chunks:
        out = U.group_chunks(out.withColumn("segment", S.parse_tag(F.col("tag"))["segment"]).withColumn("tag", S.parse_tag(F.col("tag"))["name"]))
        sinks.write_text(out.select(F.concat_ws("\t", "tag", F.col("chunks").cast("string"), F.col("complete").cast("string"), T.texts(F.col("maps"))).alias("value")), a.output, a.compression)
    elif a.sample_read:
        size, step, left, right, *rest = (int(v) for v in a.sample_read.split(","))
        pieces = out.select("tag", F.explode(S.chunks(F.col("read"), size, step, left, right, *rest)).alias("c"))
        sinks.write_text(pieces.select(F.concat(F.lit(">"), "tag", F.lit(" "), F.col("c.start").cast("string"), F.lit("\n"), F.col("c.piece")).alias("value")), a.output, a.compression)
    elif a.sequence_list:
        names = out.select(F.explode("maps").alias("m")).select(F.col("m.seq_name").alias("value")).distinct()
        sinks.write_text(names, a.output, a.compression)
    elif a.display_pretty:
        sinks.write_text(sinks.pretty(out), a.output, a.compression)
    elif not a.no_output:
        sinks.write(out, a.output, a.output_format, a.compression)


def convert(spark, a):
    """Read any format and write another; SAM is put together to templates first."""
    sinks.write(text.load(spark, a.input), a.output, a.format, a.compression)


def map2sam(spark, a):
    """MAP to SAM with a header of the sequences listed in a table of names and lengths."""
    pairs = _pairs(spark, a.input) if a.paired_end else None
    t = None if a.paired_end else text.read_map(spark, a.input)
    if a.reference and t is not None:
        t = T.recount(t).withColumn("_row", F.monotonically_increasing_id())
        t = J.with_strand(t, "_row", fastx.read_fasta_chunks(spark, a.reference))
    lines = Q.sam_lines(pairs) if a.paired_end else sinks.sam_lines(t, ("NH", "NM", "XT", "md") + (("XS",) if a.reference else ()), compact=a.compact)
    if a.sequences:
        head = sinks.sam_header(spark.read.schema("seq_name string, seq_length bigint").option("sep", "\t").csv(a.sequences)).select("value")
        lines = head.unionByName(lines)
    sinks.write_text(lines, a.output, a.compression)


def stats(spark, a):
    """Profiles of records and mappings, as a report, as JSON or both."""
    t = text.load(spark, a.input)
    p = A.profile(t, a.first_map)
    if a.output_format in ("report", "both"):
        sinks.write_text(A.to_text_report(p), a.output + "/report" if a.output_format == "both" else a.output, order=["metric", "bucket"])
    if a.output_format in ("json", "both"):
        general = A.general(t).select(F.lit("general").alias("metric"), F.to_json(F.struct("*")).alias("json"))
        out = A.to_json_report(p).unionByName(general)
        sinks.write_text(out.select(F.concat(F.lit('{"metric":"'), "metric", F.lit('","values":'), "json", F.lit("}")).alias("value")), a.output + "/json" if a.output_format == "both" else a.output)


def gtfcount(spark, a):
    """Reads per gene, of single ends or of pairs."""
    b = I.pair_blocks(_pairs(spark, a.input), "tag") if a.paired else _blocks(text.load(spark, a.input))
    c = I.gene_counts(b, _annotation(spark, a.annotation), a.multi_maps, a.weighted, a.exon_overlap, a.paired, a.single_end_counts)
    sinks.write_text(sinks.count_lines(c, a.weighted), a.output)


def merge(spark, a):
    """Mappings of several files over the records of the first."""
    first, *rest = [text.load(spark, p) for p in a.input]
    sinks.write(U.merge(first, *rest, same_reads=a.same), a.output, "map", a.compression)


def mapset(spark, a):
    """Set operations of two files."""
    x, y = (text.load(spark, p) for p in a.input)
    tol = a.tolerance
    rows = lambda df: df.select(F.concat_ws("\t", *df.columns).alias("value"))
    out = {
        "union": lambda: sinks.map_lines(U.file_union(x, y)), "intersection": lambda: sinks.map_lines(U.file_intersection(x, y, tolerance=tol)), "difference": lambda: sinks.map_lines(U.file_difference(x, y, tolerance=tol)),
        "join": lambda: rows(U.file_join(x, y)), "compare": lambda: rows(U.file_compare(x, y)), "merge-map": lambda: sinks.map_lines(U.merge(x, y)), "display-compact": lambda: rows(U.compact(x, ("tag",))),
    }[a.operation]()
    sinks.write_text(out, a.output, a.compression)


def scorereads(spark, a):
    """Pair the mappings of two files by insert size; those without a partner come out as well."""
    end = lambda p: text.load(spark, p).select(F.regexp_replace(S.sam_qname(F.col("tag")), "/[12]$", "").alias("tag"), F.posexplode("maps").alias("no", "m")).withColumn("m", F.struct(F.concat_ws("#", "tag", F.col("no").cast("string")).alias("map_id"), "m.txt", "m.seq_name", "m.strand", "m.pos", "m.score", "m.blocks"))
    lo, hi = (int(v) for v in a.insert_size.split(","))
    x = R.pair_reads(end(a.input[0]), end(a.input[1]), lo, hi)
    sinks.write_text(x.select(F.concat_ws("\t", "tag", F.coalesce("m1.txt", F.lit("0")), F.coalesce("m2.txt", F.lit("0")), F.coalesce(F.col("insert_size").cast("string"), F.lit("*"))).alias("value")), a.output, a.compression)


def coverage(spark, a):
    """Depth of coverage: runs of equal depth, or bases on target ranges."""
    runs = V.depth_runs(_blocks(text.load(spark, a.input)), "seq_name", "b_start", "b_end")
    if a.targets:
        t = text.read_ranges(spark, a.targets).withColumn("target_id", F.monotonically_increasing_id())
        runs = V.on_targets(runs, t).join(t, "target_id").select("seq_name", "start_pos", "end_pos", "name", "covered", "bases")
    sinks.write_text(runs.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in runs.columns)).alias("value")), a.output, a.compression)


def align_stats(spark, a):
    """Read counters, error positions and cycles of reads, as JSON lines."""
    t = text.load(spark, a.input)
    one = lambda name, df: df.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row"))
    parts = [one("reads", A.read_counters(t)), one("general", A.general(t)), one("errors", A.mismatches(t, ("tag",)).groupBy("type", "read_pos").agg(F.count("*").alias("value"))), one("cycles", A.per_cycle(t, "read")), one("qualities", A.per_cycle_quality(t, "read", "quals"))]
    sinks.write_text(U.concat(*parts).select(F.concat(F.lit('{"part":"'), "part", F.lit('","row":'), "row", F.lit("}")).alias("value")), a.output)


def rna(spark, a):
    """The restartable chain behind the mapper: filter, count, junctions, statistics."""
    c = PipelineConfig.load(a.config) if a.config else PipelineConfig()
    c.output = a.output
    t = text.load(spark, a.input).withColumn("template", F.col("tag"))
    pairs = _pairs(spark, a.pairs).withColumn("template", F.col("tag")) if a.pairs else None
    p = rna_pipeline(spark, c, t, _annotation(spark, a.annotation), pairs)
    print(json.dumps(p.run(only=a.steps, force=a.force, dry=a.dry)))


def junctions(spark, a):
    """Junctions of an annotation."""
    sinks.write_text(sinks.junction_lines(J.from_annotation(_annotation(spark, a.input))), a.output)


def denovo(spark, a):
    """Junctions of split mappings with enough support, or with a side in the annotation."""
    t = text.load(spark, a.input)
    j = J.supported(J.from_mappings(_blocks(t), ["template", "map_no"]), J.from_annotation(_annotation(spark, a.annotation)), a.coverage)
    j.select(F.concat_ws("\t", "seq_name", F.col("left").cast("string"), F.col("right").cast("string"), F.col("support").cast("string")).alias("value")).write.text(a.output)


def search(spark, a):
    """Features that a place or range hits; all of them."""
    seq, _, span = a.region.partition(":")
    lo, _, hi = span.partition("-")
    x = I.search(_annotation(spark, a.annotation), seq, int(lo), int(hi or lo), a.type).drop("ann_id")
    if a.output:
        x.write.option("sep", "\t").csv(a.output)
        return
    for r in x.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


FLAGS = (
    "paired-end", "no-output", "restore-trim", "qualities-to-offset-33", "qualities-to-offset-64", "remove-qualities", "add-qualities", "mapped", "unmapped", "first-map", "make-counters", "reduce-by-gene-id",
    "reduce-to-pairs", "reduce-to-protein-coding", "reduce-by-junctions", "no-split-maps", "only-split-maps", "group-read-chunks", "sequence-list", "display-pretty",
)
NUMBERS = {
    int: ("unique-level", "min-maps", "max-maps", "max-output-matches", "max-input-matches", "reduce-to-unique-strata", "reduce-by-quality", "reduce-to-max-maps", "min-intron-length", "min-block-length", "min-inss", "max-inss"),
    float: ("min-length", "max-length", "max-strata-after-map", "min-strata", "max-strata", "min-levenshtein-error", "max-levenshtein-error"),
    str: ("annotation", "discarded-output", "hard-trim", "map-id", "pair-strandedness", "sample-read"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description=__doc__)
    p.add_argument("--cpus", default="*")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, fn, many=False):
        c = sub.add_parser(name, help=fn.__doc__)
        c.set_defaults(run=fn)
        if name != "search":
            c.add_argument("-i", "--input", required=True, nargs="+" if many else None)
            c.add_argument("-o", "--output", required=True)
            c.add_argument("--compression", choices=["gzip", "bzip2"])
        return c

    f = command("filter", filter_)
    for flag in FLAGS:
        f.add_argument(*(["-p"] if flag == "paired-end" else []), f"--{flag}", action="store_true")
    for kind, names in NUMBERS.items():
        for name in names:
            f.add_argument(f"--{name}", type=kind)
    f.add_argument("-k", "--keep-first-map", action="store_true")
    f.add_argument("-u", "--keep-unique", action="store_true")
    f.add_argument("-s", "--no-penalty-for-splitmaps", action="store_true")
    f.add_argument("-d", "--max-decoded-matches", type=int)
    f.add_argument("-D", "--min-decoded-strata", type=int)
    f.add_argument("--uniform-read", nargs="?", const="plain")
    f.add_argument("--strandedness", choices=["F", "R", "+", "-"])
    f.add_argument("--filter-quality", action="append", metavar="MIN,MAX")
    f.add_argument("--output-format", "--format", default="map", type=str.lower)
    command("convert", convert).add_argument("--format", required=True)
    m = command("map2sam", map2sam)
    m.add_argument("-p", "--paired-end", action="store_true")
    m.add_argument("-r", "--reference", help="FASTA, for the strand of splices")
    m.add_argument("--sequences", help="names and lengths, for the header")
    m.add_argument("--compact", action="store_true")
    s = command("stats", stats)
    s.add_argument("-f", "--output-format", choices=["report", "json", "both"], default="report")
    s.add_argument("--first-map", action="store_true")
    command("report", stats).set_defaults(output_format="report", first_map=False)
    g = command("gtfcount", gtfcount)
    g.add_argument("-a", "--annotation", required=True)
    g.add_argument("-p", "--paired", action="store_true")
    g.add_argument("-s", "--single-end-counts", action="store_true")
    g.add_argument("-m", "--multi-maps", action="store_true")
    g.add_argument("-w", "--weighted", action="store_true")
    g.add_argument("-e", "--exon-overlap", type=float, default=0.0)
    command("merge", merge, many=True).add_argument("--same", action="store_true")
    m = command("mapset", mapset, many=True)
    m.add_argument("-C", "--operation", required=True, choices=["union", "intersection", "difference", "join", "compare", "merge-map", "display-compact"])
    m.add_argument("--tolerance", type=float)
    command("scorereads", scorereads, many=True).add_argument("--insert-size", default="0,1000")
    command("coverage", coverage).add_argument("--targets")
    command("align-stats", align_stats)
    r = command("rna-pipeline", rna)
    r.add_argument("-a", "--annotation", required=True)
    r.add_argument("--pairs")
    r.add_argument("--config")
    r.add_argument("--steps", nargs="*")
    r.add_argument("--dry", action="store_true")
    r.add_argument("--force", action="store_true")
    command("gtf-junctions", junctions)
    d = command("denovo-junctions", denovo)
    d.add_argument("-a", "--annotation", required=True)
    d.add_argument("--coverage", type=int, default=2)
    s = command("search", search)
    s.add_argument("-a", "--annotation", required=True)
    s.add_argument("-o", "--output")
    s.add_argument("region", help="sequence:start[-end]")
    s.add_argument("type", nargs="?")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(session(cpus=a.cpus), a)


if __name__ == "__main__":
    main()
