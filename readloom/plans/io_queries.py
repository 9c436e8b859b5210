"""Queries of sources, sinks, realignment and streams: tables written in a format and read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import mapping as M
from readloom.operators import filters as P
from readloom.operators import junctions as J
from readloom.operators import realign as R
from readloom.operators import setops as U
from readloom.operators import templates as T
from readloom.plans.map_queries import features
from readloom.plans.read_queries import templates
from readloom.plans.runtime import shared_path, table
from readloom.plans.sqltext import MAPS, TEXTS, TPL
from readloom.sources import fastx, sinks, text
from readloom.streaming import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _written(lines, compression=None) -> str:
    path = shared_path(lines.sparkSession)
    sinks.write_text(lines, path, compression)
    return path


def _raw(spark, d, kind):
    return table(spark, d, "raw_records").where(F.col("file_kind") == kind).select(F.col("raw_line").alias("value"))


def _reads(spark, d):
    x = table(spark, d, "fastq_reads").select("read_id", "tag", "read_seq", "qualities").distinct()
    return x.where("read_seq <> '' and qualities <> ''").select(F.concat_ws(" ", "tag", F.col("read_id").cast("string")).alias("tag"), F.col("read_seq").alias("read"), F.col("qualities").alias("quals"))


_RD = "WITH rd AS (SELECT DISTINCT read_id, tag, read_seq, qualities FROM fastq_reads WHERE read_seq <> '' AND qualities <> '')"


@query("""WITH rd AS (SELECT DISTINCT read_id, read_seq FROM fastq_reads WHERE read_seq <> '') SELECT CAST(read_id AS VARCHAR) AS seq_name, CAST(i AS BIGINT) AS chunk_no, substr(read_seq, CAST(i * 32 + 1 AS BIGINT), 32) AS chunk FROM (SELECT *, unnest(range(0, (length(read_seq) + 31) // 32)) AS i FROM rd)""")
def source_fasta_chunks(spark, d):
    """Written as FASTA and read back cut into chunks, by the reader and from whole sequences."""
    path = _written(sinks.fasta_lines(_reference(spark, d).where("sequence <> ''"), width=50))
    a = fastx.read_fasta_chunks(spark, path, 32, 1 << 16)
    return a.intersectAll(fastx.reference_chunks(fastx.read_fasta(spark, path), 32))


@query(f"{_RD} SELECT tag || ' ' || read_id AS tag, read_seq AS read, qualities AS quals FROM rd")
def source_fastq(spark, d):
    """Written as FASTQ and read back in small byte ranges."""
    return fastx.read_fastq(spark, _written(sinks.fastq_lines(_reads(spark, d))), 1 << 16)


@query(f"{_RD} SELECT tag || ' ' || read_id AS tag, read_seq AS read, qualities AS quals FROM rd")
def source_fastq_gz(spark, d):
    return fastx.read_fastq(spark, _written(sinks.fastq_lines(_reads(spark, d)), "gzip"))


@query(f"{_RD} SELECT tag || ' ' || read_id AS name, read_seq AS sequence FROM rd")
def source_fasta(spark, d):
    return fastx.read_fasta(spark, _written(sinks.fasta_lines(_reads(spark, d), "tag", "read", 20)), 1 << 14)


@query(f"WITH {TPL} SELECT tag, r AS read, coalesce(q, '') AS quals, CAST(CASE WHEN ms = '-' THEN 0 ELSE len(string_split(ms, ',')) END AS INT) AS n_maps FROM tpl")
def source_map(spark, d):
    return text.read_map(spark, _written(_raw(spark, d, "map"))).select("tag", "read", F.coalesce("quals", F.lit("")).alias("quals"), F.size("maps").alias("n_maps"))


_SAM = "WITH c AS (SELECT string_split(raw_line, chr(9)) AS c FROM raw_records WHERE file_kind = 'sam' AND NOT regexp_matches(raw_line, '^@[A-Z]{2}\\t')), s AS (SELECT c[1] AS qname, TRY_CAST(c[2] AS INT) AS flag, c[3] AS rname, TRY_CAST(c[4] AS BIGINT) AS pos, TRY_CAST(c[5] AS INT) AS mapq, c[6] AS cigar, c[7] AS rnext, TRY_CAST(c[8] AS BIGINT) AS pnext, TRY_CAST(c[9] AS BIGINT) AS tlen, c[10] AS seq, c[11] AS qual, c FROM c WHERE len(c) >= 11)"


@query(f"{_SAM} SELECT qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual FROM s WHERE regexp_full_match(c[2] || c[4] || c[5] || c[8], '[0-9]*')")
def source_sam(spark, d):
    x = _raw(spark, d, "sam").where(F.concat(*(F.coalesce(F.get(F.split("value", "\t"), F.lit(i)), F.lit("")) for i in (1, 3, 4, 7))).rlike("^[0-9]*$"))
    return text.read_sam(spark, _written(x)).drop("tags", "blocks")


@query(f"{_SAM} SELECT qname, flag, (flag & 1) <> 0 AS paired, (flag & 4) <> 0 AS unmapped, (flag & 16) <> 0 AS reverse, (flag & 64) <> 0 AS first, (flag & 256) <> 0 AS secondary FROM s WHERE regexp_full_match(c[2], '[0-9]+')")
def sam_flags(spark, d):
    f = text.flags(F.col("flag"))
    x = text.sam_table(_raw(spark, d, "sam").where(F.get(F.split("value", "\t"), F.lit(1)).rlike("^[0-9]+$")))
    return x.select("qname", "flag", f["paired"].alias("paired"), f["unmapped"].alias("unmapped"), f["reverse"].alias("reverse"), f["first"].alias("first"), f["secondary"].alias("secondary"))


_SUM = "coalesce(CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{o}]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT), 0)"


@query(f"{_SAM} SELECT qname, cigar, CAST(len(regexp_extract_all(cigar, 'N')) + 1 AS INT) AS n_blocks, {_SUM.format(o='MISHP=X')} AS read_bases, {_SUM.format(o='M=XDN')} AS span FROM s WHERE regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') AND regexp_full_match(c[4], '[0-9]+')")
def sam_cigar(spark, d):
    x = text.sam_table(_raw(spark, d, "sam").where(F.get(F.split("value", "\t"), F.lit(3)).rlike("^[0-9]+$"))).where("blocks is not null")
    return x.select("qname", "cigar", F.size("blocks").alias("n_blocks"), M.global_base_length(F.col("blocks")).alias("read_bases"), M.global_length(F.col("blocks")).alias("span"))


@query(r"""WITH c AS (SELECT string_split(raw_line, chr(9)) AS c FROM raw_records WHERE file_kind = 'gtf' AND NOT starts_with(raw_line, '#'))
SELECT c[1] AS seq_name, c[3] AS feature_type, CAST(c[4] AS BIGINT) AS start_pos, CAST(c[5] AS BIGINT) AS end_pos, nullif(regexp_extract(c[9], '(?:^|; *| )gene_id "([^"]*)"', 1), '') AS gene_id, nullif(regexp_extract(c[9], '(?:^|; *| )transcript_id "([^"]*)"', 1), '') AS transcript_id
FROM c WHERE len(c) = 9 AND regexp_full_match(c[4], '[0-9]+') AND regexp_full_match(c[5], '[0-9]+')""")
def source_gtf(spark, d):
    num = lambda i: F.get(F.split("value", "\t"), F.lit(i)).rlike("^[0-9]+$")
    return text.read_gtf(spark, _written(_raw(spark, d, "gtf").where(num(3) & num(4)))).select("seq_name", "feature_type", "start_pos", "end_pos", "gene_id", "transcript_id")


@query("SELECT seq_name, start_pos, end_pos, nullif(name, '') AS name FROM targets WHERE start_pos >= 1 AND end_pos >= start_pos")
def source_ranges(spark, d):
    t = table(spark, d, "targets").select(F.concat_ws("\t", "seq_name", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.coalesce("name", F.lit(""))).alias("value"))
    return text.read_ranges(spark, _written(t))


_FX = "SELECT DISTINCT ann_id, seq_name, start_pos, end_pos, strand, transcript_id FROM annotations WHERE feature_type = 'exon' AND transcript_id IS NOT NULL AND start_pos <= end_pos"


@query(f"""WITH x AS ({_FX}), l AS (SELECT *, lag(end_pos) OVER w AS pe, lag(seq_name) OVER w AS ps FROM x WINDOW w AS (PARTITION BY transcript_id ORDER BY start_pos, end_pos, ann_id)),
s AS (SELECT DISTINCT seq_name, strand, CASE WHEN strand <> '-' THEN pe ELSE start_pos END AS p1, CASE WHEN strand <> '-' THEN start_pos ELSE pe END AS p2 FROM l WHERE ps = seq_name AND strand IS NOT NULL)
SELECT seq_name AS seq1, CASE WHEN p1 <= p2 THEN strand WHEN strand = '+' THEN '-' ELSE '+' END AS strand1, least(p1, p2) AS pos1, seq_name AS seq2, CASE WHEN p1 <= p2 THEN strand WHEN strand = '+' THEN '-' ELSE '+' END AS strand2, greatest(p1, p2) AS pos2 FROM s""")
def source_junctions(spark, d):
    j = J.from_annotation(features(spark, d)).where("strand1 is not null")
    return text.read_junctions(spark, _written(sinks.junction_lines(j)))


@query("SELECT * FROM (VALUES ('fastq', 'fastq'), ('map', 'map'), ('gtf', 'gtf')) t(written, detected)")
def detect_formats(spark, d):
    got = [("fastq", _written(sinks.fastq_lines(_reads(spark, d)))), ("map", _written(sinks.map_lines(templates(spark, d)))), ("gtf", _written(_raw(spark, d, "gtf").where(F.size(F.split("value", "\t")) == 9)))]
    return spark.createDataFrame([(k, text.detect_format(spark, p)) for k, p in got], "written string, detected string")


@query(f"WITH {MAPS} SELECT tag, length(r) AS n, CAST(coalesce(k, 0) AS INT) AS n_maps, coalesce(d, 0) AS total_distance FROM tpl t LEFT JOIN (SELECT line_id, count(*) AS k, CAST(sum(dist) AS BIGINT) AS d FROM m GROUP BY 1) x ON x.line_id = t.line_id")
def sink_map(spark, d):
    """Printed as MAP text and parsed again."""
    x = T.from_map_lines(sinks.map_lines(templates(spark, d)), "value")
    return x.select("tag", F.length("read").cast("bigint").alias("n"), F.size("maps").alias("n_maps"), F.aggregate(T.distances(F.col("maps")), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total_distance"))


_DECLARED = """z AS (SELECT line_id, CASE WHEN ct = '!' THEN [] ELSE flatten(list_transform(string_split_regex(ct, '[:+]'), lambda t: list_resize(CAST([] AS BIGINT[]), CAST(coalesce(nullif(split_part(t, 'x', 2), ''), '1') AS BIGINT), CAST(split_part(t, 'x', 1) AS BIGINT)))) END AS c FROM tpl),
y AS (SELECT line_id, c, coalesce(list_sum(c), 0) AS total, list_filter(range(1, len(c) + 1), lambda i: c[i] > 0) AS nz FROM z), uq AS (SELECT line_id, total, CASE WHEN len(nz) = 0 OR c[nz[1]] <> 1 THEN -1 ELSE coalesce(nz[2], len(c) + 1) - nz[1] - 1 END AS d FROM y),
n AS (SELECT line_id, count(*) AS nh FROM m GROUP BY 1),
r AS (SELECT t.line_id, m.map_no, t.tag, t.r, t.q, m.seq, m.st, m.pos, CASE WHEN m.st = '-' THEN rev ELSE fwd END AS cigar, lev, lt, rt, nh, d, CASE WHEN m.line_id IS NULL THEN 0 WHEN m.map_no > 0 THEN 110 WHEN d < 0 THEN 119 WHEN total = 1 THEN 254 ELSE 180 END AS mapq
  FROM tpl t JOIN uq ON uq.line_id = t.line_id LEFT JOIN m ON m.line_id = t.line_id LEFT JOIN n ON n.line_id = t.line_id LEFT JOIN cg ON cg.line_id = m.line_id AND cg.map_no = m.map_no LEFT JOIN tr ON tr.line_id = m.line_id AND tr.map_no = m.map_no)"""
_CORE = """concat_ws(chr(9), split_part(tag, ' ', 1), CASE WHEN seq IS NULL THEN 4 ELSE CASE WHEN st = '-' THEN 16 ELSE 0 END + CASE WHEN map_no > 0 THEN 256 ELSE 0 END END, coalesce(seq, '*'), coalesce(pos, 0), mapq, coalesce(cigar, '*'), '*', '0', '0',
  CASE WHEN st = '-' THEN reverse(translate(r, 'ACGTN', 'TGCAN')) ELSE r END, coalesce(CASE WHEN q <> '' THEN CASE WHEN st = '-' THEN reverse(q) ELSE q END END, '*'),
  'NH:i:' || nh, CASE WHEN seq IS NOT NULL THEN 'NM:i:' || (lev - coalesce(lt, 0) - coalesce(rt, 0)) END, CASE WHEN seq IS NOT NULL THEN 'XT:A:' || CASE WHEN d <> -1 THEN 'U' ELSE 'R' END END"""


@query(f"WITH {TEXTS}, {_DECLARED} SELECT {_CORE}) AS value FROM r")
def sink_sam(spark, d):
    return sinks.sam_lines(templates(spark, d))


@query(f"""WITH {TEXTS}, {_DECLARED}, xa AS (SELECT line_id, string_agg(concat_ws(',', seq, st || pos, cigar, lev), ';' ORDER BY map_no) AS x FROM r WHERE map_no > 0 GROUP BY 1)
SELECT {_CORE}, CASE WHEN x IS NOT NULL THEN 'XA:Z:' || x END) AS value FROM r LEFT JOIN xa ON xa.line_id = r.line_id WHERE coalesce(map_no, 0) = 0""")
def sink_sam_compact(spark, d):
    return sinks.sam_lines(templates(spark, d), compact=True)


@query("SELECT '@SQ' || chr(9) || 'SN:' || seq_name || chr(9) || 'LN:' || seq_length AS value FROM ref_sequences UNION ALL SELECT unnest(['@HD' || chr(9) || 'VN:1.0' || chr(9) || 'SO:unsorted', '@PG' || chr(9) || 'ID:readloom'])")
def sam_header(spark, d):
    return sinks.sam_header(table(spark, d, "ref_sequences")).select("value")


@query(f"WITH {TEXTS} SELECT tag || chr(10) || '  ' || r || chr(10) || '  ' || seq || ':' || st || ':' || pos || ' ' || edits AS value FROM m JOIN tpl ON tpl.line_id = m.line_id JOIN rn ON rn.line_id = m.line_id AND rn.map_no = m.map_no")
def sink_pretty(spark, d):
    return sinks.pretty(templates(spark, d))


# ---- reference and realignment --------------------------------------------------------------------------------------


def _reference(spark, d):
    x = table(spark, d, "fastq_reads").select("read_id", "read_seq").distinct()
    return x.select(F.col("read_id").cast("string").alias("name"), F.col("read_seq").alias("sequence"))


@query("WITH rd AS (SELECT DISTINCT read_id, read_seq FROM fastq_reads) SELECT CAST(read_id AS VARCHAR) AS seq_name, CASE WHEN read_id % 2 = 0 THEN substr(read_seq, 11, 25) ELSE reverse(translate(substr(read_seq, 11, 25), 'ACGTN', 'TGCAN')) END AS sequence FROM rd")
def reference_chunks(spark, d):
    """Stretches of a chunked reference with strand, over chunk borders."""
    ref = _reference(spark, d)
    want = ref.select(F.col("name").alias("seq_name"), F.lit(11).cast("bigint").alias("s"), F.lit(25).cast("bigint").alias("n"), F.when(F.col("name").cast("bigint") % 2 == 0, "+").otherwise("-").alias("strand"))
    return fastx.sequence_at(want, fastx.reference_chunks(ref, 16), "seq_name", "s", "n", "strand", 16).select("seq_name", "sequence")


@query("WITH rd AS (SELECT DISTINCT read_id, read_seq AS s, reverse(read_seq) AS t FROM fastq_reads) SELECT read_id, len(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) <> substr(t, i, 1))) AS n FROM rd")
def hamming_ops(spark, d):
    x = table(spark, d, "fastq_reads").select("read_id", "read_seq").distinct()
    return x.select("read_id", F.size(R.hamming_column(F.col("read_seq"), F.reverse("read_seq"))).cast("bigint").alias("n"))


@query("WITH rd AS (SELECT DISTINCT read_id, read_seq AS s, substr(read_seq, 4, 20) || 'ACG' || substr(read_seq, 24) AS t FROM fastq_reads) SELECT read_id, CAST(levenshtein(s, t) AS DOUBLE) AS cost FROM rd")
def realign_levenshtein(spark, d):
    x = table(spark, d, "fastq_reads").select("read_id", "read_seq").distinct()
    other = F.concat(F.substring("read_seq", 4, 20), F.lit("ACG"), F.substring(F.col("read_seq"), F.lit(24), F.length("read_seq")))
    return x.select("read_id", R.realign_column(F.col("read_seq"), other)["cost"].alias("cost"))


@query("""WITH rd AS (SELECT DISTINCT read_id, read_seq AS s FROM fastq_reads) SELECT read_id, CASE WHEN s IS NULL OR s = '' THEN 'no sequence' END AS fault,
  CASE WHEN s IS NULL OR s = '' THEN 'no sequence' WHEN left(s, 1) = 'N' THEN NULL ELSE 'mismatch' END AS fault_elsewhere FROM rd""")
def alignment_check(spark, d):
    """Realigned operations pass the check of the alignment they describe, and fail against a sequence of another first base."""
    x = table(spark, d, "fastq_reads").select("read_id", "read_seq").distinct()
    other = F.concat(F.substring("read_seq", 4, 20), F.lit("ACG"), F.substring(F.col("read_seq"), F.lit(24), F.length("read_seq")))
    y = x.select("read_id", "read_seq", other.alias("other"), R.realign_column(F.col("read_seq"), other)["ops"].alias("ops"))
    same = F.transform(F.array("read_seq"), lambda s: F.concat(F.lit("N"), F.substring(s, F.lit(2), F.length(s))))[0]
    none = F.array().cast(R.OPS)
    return y.select("read_id", R.check_column(F.col("read_seq"), F.col("other"), F.coalesce("ops", none)).alias("fault"), R.check_column(F.col("read_seq"), same, none).alias("fault_elsewhere"))


@query(r"""WITH rd AS (SELECT DISTINCT read_id, left(read_seq, 5) AS a, right(read_seq, 5) AS b FROM fastq_reads),
s AS (SELECT read_id, (a LIKE 'GT%' AND b LIKE '%AG') OR (a LIKE 'GC%' AND b LIKE '%AG') OR (a LIKE 'ATATC%' AND b LIKE '%A_') OR (a LIKE 'GTATC%' AND b LIKE '%AT') AS p,
(a LIKE 'CT%' AND b LIKE '%AC') OR (a LIKE 'CT%' AND b LIKE '%GC') OR (a LIKE '_T%' AND b LIKE '%GATAT') OR (a LIKE 'AT%' AND b LIKE '%GATAC') AS m FROM rd)
SELECT read_id, CASE WHEN p AND NOT m THEN '+' WHEN m AND NOT p THEN '-' ELSE '0' END AS xs FROM s""")
def splice_strand(spark, d):
    x = table(spark, d, "fastq_reads").select("read_id", "read_seq").distinct()
    return x.select("read_id", J.motif_strand(F.substring("read_seq", 1, 5), F.right("read_seq", F.lit(5))).alias("xs"))


@query("WITH rd AS (SELECT DISTINCT read_id, read_seq, qualities FROM fastq_reads) SELECT max(length(read_seq)) AS max_read_length FROM rd")
def max_read_length(spark, d):
    return table(spark, d, "fastq_reads").agg(F.max(F.length("read_seq")).cast("bigint").alias("max_read_length"))


@query("WITH s AS (SELECT DISTINCT read_id, tag FROM fastq_reads), o AS (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY read_id) AS segment, count(*) OVER (PARTITION BY tag) AS total FROM s) SELECT tag, segment, total FROM o")
def segment_groups(spark, d):
    """Reads of one tag numbered 1..n, as chunks of a segmented read are; a tag with many reads is spread."""
    x = table(spark, d, "fastq_reads").select("read_id", "tag").distinct()
    n = x.groupBy(F.col("tag").alias("t")).agg(F.count("*").alias("total"))
    r = U.rank_within(x, ["tag"], ["read_id"])
    return r.join(n, r["tag"].eqNullSafe(n["t"])).select("tag", (F.col("row_no") + 1).alias("segment"), "total")


# ---- streams --------------------------------------------------------------------------------------------------------


@query(f"WITH {MAPS}, k AS (SELECT line_id, string_agg(txt, ',' ORDER BY map_no) AS maps FROM m WHERE st = '+' GROUP BY line_id) SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN k ON k.line_id = t.line_id")
def stream_filter(spark, d):
    """The strand filter as a stream of files."""
    path, out, at = shared_path(spark), shared_path(spark), shared_path(spark)
    src = table(spark, d, "raw_records").where("file_kind = 'map'").select("line_id", "raw_line")
    src.repartition(3).write.parquet(path)
    files.run_available(files.stream_parquet(spark, path, src.schema, 1), lambda x: P.on_strand(T.from_map_lines(x, keep=("line_id",)), "+").select("line_id", T.texts(F.col("maps")).alias("maps")), out, at)
    return spark.read.parquet(out)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark, d):
    """Counts per day and type over a stream of event files, late rows included."""
    path, out, at = shared_path(spark), shared_path(spark), shared_path(spark)
    src = table(spark, d, "events").select("ts", "event_type").where("ts is not null")
    src.repartition(3).write.parquet(path)
    files.run_totals(files.stream_parquet(spark, path, src.schema, 1), lambda x: files.windowed_counts(x, "ts", ["event_type"], "1 day", "30 days"), out, at)
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT run_id, count(*) AS n FROM fastq_reads GROUP BY 1")
def stream_run_totals(spark, d):
    """Reads per run over a stream; a second call finds nothing new and changes nothing."""
    path, out, at = shared_path(spark), shared_path(spark), shared_path(spark)
    src = table(spark, d, "fastq_reads").select("run_id")
    src.repartition(2).write.parquet(path)
    for _ in range(2):
        files.run_totals(files.stream_parquet(spark, path, src.schema, 1), lambda x: x.groupBy("run_id").agg(F.count("*").alias("n")), out, at)
    return spark.read.parquet(out)
