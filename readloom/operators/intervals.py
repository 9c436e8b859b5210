"""Overlap joins of intervals with annotated features, gene counts and gene-body coverage.

The join is an equi-join on bins of several widths. An interval of the large side gets one bin: the narrowest that
holds it whole. A feature of the small side is listed in every bin of every width that it touches, if it is shorter than
2 ** LISTED bases. So the large side is neither copied nor deduplicated and each pair meets in exactly one bin.
Longer features, if there are any, are listed once a width from their own on; the large side looks them up with one row
for each of these few widths. No feature needs more than some thousand rows, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.plans.runtime import materialize

#: Bin widths are 2 ** shift.
SHIFTS = (10, 13, 16, 19, 22, 25, 28, 31, 40)
#: Features of 2 ** LISTED bases and more are not listed in bins narrower than themselves.
LISTED = 22


def hits(s: Column, e: Column, fs: Column, fe: Column) -> Column:
    """Overlap of [s, e] with a feature [fs, fe]: one common base at an edge alone is no hit, unless one holds the other."""
    return ((s < fe) & (e > fs)) | ((s >= fs) & (e <= fe)) | ((s < fe) & (e >= fe))


def touches(s: Column, e: Column, fs: Column, fe: Column) -> Column:
    """Plain closed-interval overlap."""
    return (s <= fe) & (e >= fs)


def _home(s: Column, e: Column) -> Column:
    """Narrowest bin that holds [s, e]: its shift and number."""
    out = None
    for k in SHIFTS:
        fit = F.shiftright(s, k) == F.shiftright(e, k)
        one = F.struct(F.lit(k).alias("k"), F.shiftright(s, k).alias("n"))
        out = F.when(fit, one) if out is None else out.when(fit, one)
    return out


def _cover(s: Column, e: Column) -> Column:
    """All bins that [s, e] touches."""

    def level(k):
        return F.transform(F.sequence(F.shiftright(s, k), F.shiftright(e, k)), lambda n: F.struct(F.lit(k).alias("k"), n.alias("n")))

    return F.flatten(F.array(*map(level, SHIFTS)))


def _from(s: Column, e: Column, shifts: tuple[int, ...]) -> Column:
    """The bins of ``shifts`` that hold [s, e] whole, and whether each is the narrowest that does."""
    own = _home(s, e)["k"]
    every = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftright(s, k).alias("n"), (own == k).alias("own")) for k in shifts))
    return F.filter(every, lambda b: b["k"] >= own)


def overlap_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str, str], right_on: tuple[str, str, str], predicate=hits) -> DataFrame:
    """Pairs of ``left`` (the large side) and ``right`` (features) on one sequence for which ``predicate`` holds.

    ``*_on`` name sequence, start and end. Column names of the two sides must differ. Null bounds and start after end
    match nothing. A hot bin is split by adaptive skew handling; nothing is broadcast unless its measured size allows.
    """
    (ls, la, lb), (rs, ra, rb) = left_on, right_on
    a, b = F.col(la).cast("bigint"), F.col(lb).cast("bigint")
    x = left.withColumn("_bin", F.when(a <= b, _home(a, b))).withColumn("_lk", F.col("_bin.k")).withColumn("_ln", F.col("_bin.n")).drop("_bin")
    fa, fb = F.col(ra).cast("bigint"), F.col(rb).cast("bigint")
    features = right.where(fa <= fb)
    long = fb - fa >= 1 << LISTED
    y = features.where(~long).withColumn("_bin", F.explode(_cover(fa, fb))).withColumn("_rk", F.col("_bin.k")).withColumn("_rn", F.col("_bin.n")).drop("_bin")
    on = (F.col(ls) == F.col(rs)) & (F.col("_lk") == F.col("_rk")) & (F.col("_ln") == F.col("_rn")) & predicate(F.col(la), F.col(lb), F.col(ra), F.col(rb))
    out = x.join(y, on).drop("_lk", "_ln", "_rk", "_rn")
    if not features.where(long).take(1):
        return out
    # At the wider of their two widths each of a pair lies in one bin, and in the same one if they overlap.
    wide = tuple(k for k in SHIFTS if k > LISTED)
    z = left.where(a <= b).withColumn("_bin", F.explode(_from(a, b, wide))).select(*left.columns, F.col("_bin.k").alias("_lk"), F.col("_bin.n").alias("_ln"), F.col("_bin.own").alias("_lo"))
    w = features.where(long).withColumn("_bin", F.explode(_from(fa, fb, wide))).select(*right.columns, F.col("_bin.k").alias("_rk"), F.col("_bin.n").alias("_rn"), F.col("_bin.own").alias("_ro"))
    return out.unionByName(z.join(w, on & (F.col("_lo") | F.col("_ro"))).drop("_lk", "_ln", "_lo", "_rk", "_rn", "_ro"))


# ---- annotation as a table ------------------------------------------------------------------------------------------


def exon_order(features: DataFrame) -> DataFrame:
    """Exons with their ordinal, transcript-relative offset and the exon before, by transcript and start.

    ``exon_no`` counts from 0; ``exon_offset`` is the length of the exons before.
    """
    w = Window.partitionBy("transcript_id").orderBy("start_pos", "end_pos", "ann_id")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    x = features.where("feature_type = 'exon' and transcript_id is not null and start_pos <= end_pos")
    return x.select(
        "ann_id", "seq_name", "strand", "gene_id", "transcript_id", "start_pos", "end_pos", (F.row_number().over(w) - 1).alias("exon_no"),
        F.coalesce(F.sum(F.col("end_pos") - F.col("start_pos") + 1).over(upto), F.lit(0)).alias("exon_offset"), F.lag("end_pos").over(w).alias("prev_end"), F.lag("seq_name").over(w).alias("prev_seq"),
    )


def introns(features: DataFrame) -> DataFrame:
    """Synthesised introns: between consecutive exons of a transcript on one sequence."""
    x = exon_order(features).where("prev_seq = seq_name and start_pos - 1 >= prev_end + 1")
    return x.select("seq_name", "strand", "gene_id", "transcript_id", (F.col("prev_end") + 1).alias("start_pos"), (F.col("start_pos") - 1).alias("end_pos"), (F.col("exon_no") - 1).alias("intron_no"))


def children(features: DataFrame) -> DataFrame:
    """Transcripts per gene and exons per gene."""
    x = features.where("gene_id is not null")
    return x.groupBy("gene_id").agg(F.count_distinct("transcript_id").alias("n_transcripts"), F.sum((F.col("feature_type") == "exon").cast("bigint")).alias("n_exons"))


def sort_features(features: DataFrame, by: str = "start_pos") -> DataFrame:
    """Features by sequence, start (or end) and type, range-sorted over all partitions."""
    return features.orderBy("seq_name", by, "feature_type")


def search(features: DataFrame, seq: str, start: int, end: int, kind: str | None = None) -> DataFrame:
    """Features that a single interval hits (the interactive search)."""
    x = features.where((F.col("seq_name") == seq) & hits(F.lit(start), F.lit(end), F.col("start_pos"), F.col("end_pos")))
    return x.where(F.col("feature_type") == kind) if kind else x


# ---- gene counts ----------------------------------------------------------------------------------------------------

_MAP = ["template", "map_no", "end_no"]


def block_hits(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """Hits of blocks (``template, map_no, end_no, block_no, n_blocks, seq_name, b_start, b_end``) with features.

    If blocks also tell ``n_ends``, the ends of their mapping, it need not be counted.
    """
    f = features.select(F.col("seq_name").alias("f_seq"), F.col("feature_type").alias("f_type"), F.col("start_pos").alias("f_start"), F.col("end_pos").alias("f_end"), F.col("gene_id").alias("f_gene"), F.col("transcript_id").alias("f_transcript"))
    # Every grouping behind it has these keys, so the hits move once.
    return overlap_join(blocks, f, ("seq_name", "b_start", "b_end"), ("f_seq", "f_start", "f_end")).repartition("template", "map_no")


def _kind(exon: Column, intron: Column) -> Column:
    return F.when(exon == 1, "exon").when(intron == 1, "intron").when(exon.isNotNull(), "unknown").otherwise("na")


def block_types(blocks: DataFrame, hit: DataFrame) -> DataFrame:
    """Kind of each block: exon, else intron, else unknown, and na without any hit; and its largest exon overlap."""
    share = (F.least("b_end", "f_end") - F.greatest("b_start", "f_start") + 1) / (F.col("b_end") - F.col("b_start") + 1)
    exon = F.col("f_type") == "exon"
    per = hit.groupBy(*_MAP, "block_no").agg(F.max(exon.cast("int")).alias("x"), F.max((F.col("f_type") == "intron").cast("int")).alias("i"), F.max(F.when(exon & F.col("f_gene").isNotNull(), share)).alias("o"), F.count_distinct(F.when(exon, F.col("f_gene"))).alias("exon_genes"))
    kind = _kind(F.col("x"), F.col("i"))
    b = blocks.select(*_MAP, "block_no", (F.col("b_end") - F.col("b_start") + 1).alias("len"))
    return b.join(per, [*_MAP, "block_no"], "left").select(*_MAP, "block_no", "len", kind.alias("kind"), F.coalesce("o", F.lit(0.0)).alias("overlap"), F.coalesce("exon_genes", F.lit(0)).alias("exon_genes"))


def map_genes(blocks: DataFrame, hit: DataFrame) -> DataFrame:
    """Genes of each mapping's end: with exon hits those of the exons, else all; if several, those that all blocks
    share, and of them those with most splice sites at exon bounds."""
    return _map_genes(block_genes(hit.where("f_gene is not null")))


def block_genes(hit: DataFrame) -> DataFrame:
    """Hits summed up by block and gene, null for those without a gene: any of an exon with a gene ``x``, of any exon
    ``exon``, of an intron ``intron``; ``j`` such exons at whose bounds the block starts or ends."""
    exon = (F.col("f_type") == "exon") & F.col("f_gene").isNotNull()
    edge = (F.col("b_start") == F.col("f_start")) | (F.col("b_start") == F.col("f_end")) | (F.col("b_end") == F.col("f_end")) | (F.col("b_end") == F.col("f_start"))
    also = ["n_ends"] if "n_ends" in hit.columns else []
    kinds = (F.max((F.col("f_type") == k).cast("int")).alias(k) for k in ("exon", "intron"))
    return hit.groupBy(*_MAP, *also, "block_no", "n_blocks", "f_gene").agg(F.max(exon.cast("int")).alias("x"), F.sum((exon & edge).cast("int")).alias("j"), *kinds)


def _map_genes(g: DataFrame) -> DataFrame:
    also = ["n_ends"] if "n_ends" in g.columns else []
    w = Window.partitionBy(*_MAP, "block_no")
    g = g.withColumn("any", F.max("x").over(w)).where("x = any")
    per = g.groupBy(*_MAP, *also, "n_blocks", "f_gene").agg(F.count("*").alias("cnt"), F.sum("j").alias("j"), F.max("x").alias("x"))
    m = Window.partitionBy(*_MAP)
    whole = F.col("cnt") == F.col("n_blocks")
    per = per.withColumn("n_genes", F.count("*").over(m)).withColumn("best", F.coalesce(F.max(F.when(whole, F.col("j"))).over(m), F.lit(0)))
    return per.where((F.col("n_genes") == 1) | (whole & ((F.col("best") == 0) | (F.col("j") == F.col("best"))))).select(*_MAP, *also, "f_gene", "x")


def gene_hits(blocks: DataFrame, features: DataFrame, exon_overlap: float = 0.0) -> DataFrame:
    """``template, map_no, gene_id, weight, n_ends``: genes of each mapping or pair of ends, weight 1 for each end that hits.

    A pair keeps the genes its ends share, or those of end 1 if end 2 hits none. With ``exon_overlap`` only mappings
    whose blocks lie in exons by at least that share (mean of both ends) count.
    """
    lax = exon_overlap <= 0
    if "n_ends" not in blocks.columns:
        ends = blocks.groupBy("template", "map_no").agg(F.count_distinct("end_no").alias("n_ends"))
        blocks = blocks.join(ends, ["template", "map_no"])
    hit = block_hits(blocks, features)
    hit = hit if lax else materialize(hit)
    genes = map_genes(blocks, hit)
    by_end = genes.groupBy("template", "map_no", "f_gene").agg(
        F.max("n_ends").alias("n_ends"), F.max((F.col("end_no") == 1).cast("int")).alias("in1"), F.max((F.col("end_no") == 2).cast("int")).alias("in2"),
        F.max(F.when(F.col("end_no") == 1, F.col("x"))).alias("x1"), F.max(F.when(F.col("end_no") == 2, F.col("x"))).alias("x2"),
    )
    x = by_end.withColumn("any2", F.max("in2").over(Window.partitionBy("template", "map_no")))
    # Single ends count whichever end they are; a pair starts from the genes of end 1.
    ok = (F.col("n_ends") == 1) | ((F.col("in1") == 1) & ((F.col("in2") == 1) | (F.col("any2") == 0)))
    weight = F.when((F.col("x1") == 1) | (F.lit(lax) & (F.col("in1") == 1)), 1).otherwise(0) + F.when((F.col("x2") == 1) | (F.lit(lax) & (F.col("in2") == 1)), 1).otherwise(0)
    x = x.where(ok).withColumn("weight", weight).where("weight > 0")
    if not lax:
        t = block_types(blocks, hit)
        ends = t.groupBy(*_MAP).agg((F.sum(F.col("overlap") * F.col("len")) / F.sum("len")).alias("o"))
        over = ends.groupBy("template", "map_no").agg(F.avg("o").alias("overlap")).where(F.col("overlap") >= exon_overlap - 1e-6)
        x = x.join(over, ["template", "map_no"])
    return x.select("template", "map_no", F.col("f_gene").alias("gene_id"), "weight", "n_ends")


def pair_blocks(pairs: DataFrame, template: str) -> DataFrame:
    """Blocks of paired templates as :func:`gene_counts` takes them: both ends of each mapping."""
    from readloom.functions import mapping as M
    from readloom.operators import pairs as P

    e = P.ends(pairs.withColumn("template", F.col(template)).withColumn("mmaps", F.filter("mmaps", lambda p: p["m1"].isNotNull() & p["m2"].isNotNull())), ("template",))
    x = e.select("template", "map_no", "end_no", F.lit(2).alias("n_ends"), F.col("m.seq_name").alias("seq_name"), F.col("m.strand").alias("strand"), F.size("m.blocks").alias("n_blocks"), F.posexplode("m.blocks").alias("block_no", "b"))
    return x.select("template", "map_no", "end_no", "n_ends", "block_no", "n_blocks", "seq_name", "strand", F.col("b.pos").alias("b_start"), (F.col("b.pos") + M.block_length(F.col("b")) - 1).alias("b_end"))


def gene_counts(blocks: DataFrame, features: DataFrame, multi: bool = False, weighted: bool = False, exon_overlap: float = 0.0, paired: bool = False, single_ends: bool = False, lengths: DataFrame | None = None) -> DataFrame:
    """``gene_id, n``: reads per gene. Templates with several genes count if ``multi``, each gene 1/genes if ``weighted``.

    A single end counts 1, a pair 2; with ``single_ends`` a pair counts the ends that hit the gene, the most over its
    mappings. ``paired`` leaves templates of a single end out unless ``single_ends`` is set. With ``lengths``
    (``template, bases``, both ends together) bases are counted in place of reads: all of a pair's, or half of them where
    one end counts.
    """
    per = gene_hits(blocks, features, exon_overlap).groupBy("template", "gene_id").agg(F.max("weight").alias("weight"), F.max("n_ends").alias("n_ends"))
    pair = F.col("n_ends") == 2
    if paired and not single_ends:
        per = per.where(pair)
    n = per.groupBy("template").agg(F.count("*").alias("hits"))
    x = per.join(n, "template")
    if not (multi or weighted):
        x = x.where("hits = 1")
    v = F.when(pair, F.col("weight") if single_ends else F.lit(2)).otherwise(1)
    value = v / F.col("hits") if weighted else v.cast("double")
    if lengths is not None:
        x = x.join(lengths.select(F.col("template"), F.col("bases").cast("bigint").alias("_bases")), "template")
        b = F.when(pair & (v != 2), F.floor(F.col("_bases") / 2)).otherwise(F.col("_bases")).cast("double")
        value = F.when(pair, b * (b / (F.col("_bases") * F.col("hits")))).otherwise(1 / F.col("hits")) if weighted else b
    return x.groupBy("gene_id").agg(F.sum(value).alias("n"))


def type_patterns(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """``pattern, n`` over mappings of single-mapping templates: kinds of blocks joined by ``^``, ``_mg`` for exons of several genes."""
    # Written, as both the genes and the kinds need it; else the plan holds the overlap join and all before it twice.
    per = materialize(block_genes(block_hits(blocks, features)))
    genes = _map_genes(per.where("f_gene is not null")).groupBy("template", "map_no").agg(F.count_distinct("f_gene").alias("g"))
    kinds = per.groupBy(*_MAP, "block_no").agg(F.max("exon").alias("x"), F.max("intron").alias("i"), F.count_distinct(F.when(F.col("exon") == 1, F.col("f_gene"))).alias("exon_genes"))
    t = blocks.select(*_MAP, "block_no").join(kinds, [*_MAP, "block_no"], "left").withColumn("kind", _kind(F.col("x"), F.col("i"))).join(genes, ["template", "map_no"], "left")
    name = F.when((F.col("kind") == "exon") & (F.coalesce("g", F.lit(0)) != 1) & (F.coalesce("exon_genes", F.lit(0)) > 1), F.concat("kind", F.lit("_mg"))).otherwise(F.col("kind"))
    per = t.groupBy("template", "map_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end_no", "block_no", name.alias("k")))), lambda s: s["k"]), "^").alias("pattern"))
    return per.groupBy("pattern").agg(F.count("*").alias("n"))


def annotated_junctions(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """Splices of mappings and how many have both sides in exons of one transcript: ``n_junctions, n_annotated``."""
    return map_junctions(blocks, features).agg(F.sum("n_junctions").alias("n_junctions"), F.sum("n_annotated").alias("n_annotated"))


def map_junctions(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """``template, map_no, end_no, n_junctions, n_annotated`` of split mappings, in reference order of their blocks."""
    w = Window.partitionBy(*_MAP).orderBy("b_start", "block_no")
    j = blocks.withColumn("prev_end", F.lag("b_end").over(w)).where("prev_end is not null").withColumn("j_id", F.monotonically_increasing_id())
    j = materialize(j.select("j_id", *_MAP, "seq_name", "prev_end", "b_start"))
    ex = features.where("feature_type = 'exon' and transcript_id is not null")
    f = ex.select(F.col("seq_name").alias("f_seq"), F.col("start_pos").alias("f_start"), F.col("end_pos").alias("f_end"), F.col("transcript_id").alias("tr"))
    left = overlap_join(j.withColumn("p2", F.col("prev_end")), f, ("seq_name", "prev_end", "p2"), ("f_seq", "f_start", "f_end")).select("j_id", "tr").distinct()
    right = overlap_join(j.withColumn("p2", F.col("b_start")), f, ("seq_name", "b_start", "p2"), ("f_seq", "f_start", "f_end")).select("j_id", "tr").distinct()
    good = left.join(right, ["j_id", "tr"], "left_semi").select("j_id").distinct().withColumn("ok", F.lit(1))
    return j.join(good, "j_id", "left").groupBy(*_MAP).agg(F.count("*").alias("n_junctions"), F.count("ok").alias("n_annotated"))


def reduce_by_annotation(templates: DataFrame, features: DataFrame, key: str, by_gene: bool = False, protein_coding: bool = False, by_junctions: bool = False) -> DataFrame:
    """Templates whose mappings are reduced to those the annotation speaks for; a template without such is left as it is.

    ``by_gene`` keeps mappings of more than one gene (the rule of the tool this follows), ``protein_coding`` those whose
    first block hits a protein-coding feature, ``by_junctions`` drops split mappings with some, but not the largest,
    share of annotated junctions among the template's.
    """
    from readloom.operators.templates import block_rows

    b = block_rows(templates, (key,)).select(F.col(key).alias("template"), "map_no", F.lit(1).alias("end_no"), F.lit(1).alias("n_ends"), "block_no", "n_blocks", "seq_name", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    b = materialize(b)
    maps = b.where("block_no = 0").select("template", "map_no", "seq_name", "b_start", "b_end")
    genes = gene_hits(b, features).groupBy("template", "map_no").agg(F.count_distinct("gene_id").alias("genes"))
    f = features.where("gene_type = 'protein_coding'").select(F.col("seq_name").alias("f_seq"), F.col("start_pos").alias("f_start"), F.col("end_pos").alias("f_end"))
    coding = overlap_join(maps, f, ("seq_name", "b_start", "b_end"), ("f_seq", "f_start", "f_end")).select("template", "map_no").distinct().withColumn("coding", F.lit(True))
    junc = map_junctions(b, features).select("template", "map_no", (F.col("n_annotated") / F.col("n_junctions")).alias("ratio"))
    m = maps.select("template", "map_no").join(genes, ["template", "map_no"], "left").join(coding, ["template", "map_no"], "left").join(junc, ["template", "map_no"], "left")
    m = m.withColumn("best", F.max(F.coalesce("ratio", F.lit(0.0))).over(Window.partitionBy("template")))  # as many rows as the record lists
    ok = F.lit(True)
    if by_gene:
        ok = ok & (F.coalesce("genes", F.lit(0)) > 1)
    if protein_coding:
        ok = ok & F.coalesce("coding", F.lit(False))
    if by_junctions:
        ok = ok & ((F.coalesce("ratio", F.lit(0.0)) <= 0) | (F.col("ratio") == F.col("best")))
    kept = m.where(ok).groupBy("template").agg(F.collect_set("map_no").alias("_kept"))
    x = templates.join(kept, templates[key] == kept["template"], "left").drop("template")
    return x.withColumn("maps", F.when(F.col("_kept").isNull(), F.col("maps")).otherwise(F.filter("maps", lambda v, i: F.array_contains(F.col("_kept"), i)))).drop("_kept")


#: Classes of transcript length for gene-body coverage: (over, up to).
LENGTH_CLASSES = ((0, None), (0, 150), (150, 250), (250, 500), (500, 1000), (1000, 2500), (2500, 5000), (5000, 7500), (7500, 10000), (10000, 15000), (15000, 20000))


def gene_body_coverage(blocks: DataFrame, features: DataFrame, buckets: int = 100, min_length: int = 100) -> DataFrame:
    """``length_class, bucket, n``: blocks over buckets of transcripts, read from the 5' end.

    A block is placed in its exon, scaled to the exon's place on the transcript. Transcripts up to ``min_length`` are left out.
    """
    ex = exon_order(features)
    tr = ex.groupBy(F.col("transcript_id").alias("t_id")).agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("t_len")).where(F.col("t_len") > min_length)
    f = ex.join(tr, ex["transcript_id"] == tr["t_id"]).select(F.col("seq_name").alias("f_seq"), F.col("start_pos").alias("f_start"), F.col("end_pos").alias("f_end"), F.col("strand").alias("f_strand"), "exon_offset", "t_len")
    h = overlap_join(blocks.where("b_end > b_start"), f, ("seq_name", "b_start", "b_end"), ("f_seq", "f_start", "f_end"))
    n = F.col("f_end") - F.col("f_start") + 1
    rel0 = F.greatest(F.col("b_start") - F.col("f_start"), F.lit(0))
    rel1 = F.least(F.col("b_start") - F.col("f_start") + F.col("b_end") - F.col("b_start"), n)
    to = lambda r: F.floor(r / n * 100.0 - 0.5)
    h = h.withColumn("n", n).withColumn("s", to(rel0)).withColumn("e", to(rel1)).where(F.col("s").between(0, buckets - 1) & (F.col("e") >= F.col("s")) & (F.col("e") < buckets))
    rev = F.col("f_strand") == "-"
    h = h.withColumn("s2", F.when(rev, buckets - 1 - F.col("e")).otherwise(F.col("s"))).withColumn("e2", F.when(rev, buckets - 1 - F.col("s")).otherwise(F.col("e")))
    off = F.when(rev, F.col("t_len") - F.col("exon_offset") - F.col("n")).otherwise(F.col("exon_offset"))
    base = F.greatest(F.floor(off / F.col("t_len") * 100.0 - 0.5), F.lit(0))
    scale = F.col("n") / F.col("t_len")
    h = h.withColumn("b0", F.floor(scale * F.col("s2") + base)).withColumn("b1", F.floor(scale * F.col("e2") + base)).where(F.col("b0").between(0, buckets - 1) & (F.col("b1") >= F.col("b0")) & (F.col("b1") < buckets))
    cls = F.filter(F.array(*(F.when(F.lit(True) if hi is None else (F.col("t_len") > lo) & (F.col("t_len") <= hi), F.lit(i)) for i, (lo, hi) in enumerate(LENGTH_CLASSES))), lambda v: v.isNotNull())
    return h.select(F.explode(cls).alias("length_class"), "b0", "b1").select("length_class", F.explode(F.sequence("b0", "b1")).alias("bucket")).groupBy("length_class", "bucket").agg(F.count("*").alias("n"))
