"""Queries of the operators over the mapping table, annotations and coverage ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M
from readloom.operators import coverage as V
from readloom.operators import filters as P
from readloom.operators import intervals as I
from readloom.operators import junctions as J
from readloom.operators import pairs as Q2
from readloom.operators import scoring as R
from readloom.operators import setops as U
from readloom.operators import stats as A
from readloom.operators import templates as T
from readloom.plans.read_queries import templates
from readloom.plans.runtime import computed, materialize, table
from readloom.plans.sqltext import BLOCKS, FEATURES, HIT, MAPS, PAIRS, ROWS, SETS, TBLOCKS, TPL, E, united

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COLS = ["map_id", "tag", "end_no", "seq_name", "strand", "pos", "maps", "n_edits", "gt_score", "phred_score", "tlen", "run_id"]


def rows(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Mappings, each map_id once; a repeated delivery has the same content, so the columns used decide."""
    return table(spark, d, "mappings").select("map_id", *(cols or _COLS[1:])).distinct()


def mapped(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    need = dict.fromkeys([*cols, "maps"]) if cols else ()
    return rows(spark, d, *need).where("maps <> '-'").withColumn("m", M.parse_map(F.col("maps")))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(mapped(spark, d, "tag", "end_no", "seq_name", "strand"))


def single_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the read ends with a single mapping, told by narrow rows before any text moves or is parsed."""
    x = table(spark, d, "mappings").where("maps <> '-'").select("map_id", "tag", "end_no", "seq_name", "strand", "maps")
    one = x.groupBy("tag", "end_no").agg(F.min("map_id").alias("map_id"), F.max("map_id").alias("_last")).where("map_id = _last").drop("_last")
    # By map_id too, so that a tag with a tenth of all rows is no task.
    return _blocks(x.join(one, ["tag", "end_no", "map_id"], "left_semi").distinct().withColumn("m", M.parse_map(F.col("maps"))))


def _blocks(maps: DataFrame) -> DataFrame:
    # There is always a block; the outer form keeps the optimizer from parsing a second time to test for one.
    x = maps.select("map_id", F.concat_ws("/", "tag", "end_no").alias("template"), F.col("map_id").alias("map_no"), F.lit(1).alias("end_no"), "seq_name", "strand", F.size("m.blocks").alias("n_blocks"), F.posexplode_outer("m.blocks").alias("block_no", "b"))
    x = x.withColumn("n_ends", F.lit(1))
    return x.select("map_id", "template", "map_no", "end_no", "n_ends", "block_no", "n_blocks", "seq_name", "strand", F.col("b.pos").alias("b_start"), (F.col("b.pos") + M.block_length(F.col("b")) - 1).alias("b_end"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotations").drop("loaded_at", "score", "ann_source").distinct()


def targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "targets")


_PAIR = f"WITH {PAIRS}"


# ---- the mapping table: strata per read ------------------------------------------------------------------------------


@query(f"""WITH {ROWS}, c AS (SELECT tag, end_no, dist, count(*) AS n FROM w GROUP BY ALL), mx AS (SELECT tag, end_no, max(dist) AS d FROM c GROUP BY ALL),
g AS (SELECT tag, end_no, d, unnest(range(0, d + 1)) AS i FROM mx)
SELECT g.tag, g.end_no, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ':' ORDER BY i) AS counters FROM g LEFT JOIN c ON g.tag = c.tag AND g.end_no = c.end_no AND c.dist = g.i GROUP BY g.tag, g.end_no""")
def counters_strata(spark, d):
    """Strata counters of each read end, from counts per stratum."""
    x = mapped(spark, d, "tag", "end_no").select("tag", "end_no", M.global_distance(F.col("m.blocks")).alias("dist")).groupBy("tag", "end_no", "dist").agg(F.count("*").alias("n"))
    # At most one entry per distance; a read with any number of mappings is a short array here.
    g = x.groupBy("tag", "end_no").agg(F.map_from_entries(F.collect_list(F.struct("dist", "n"))).alias("h"), F.max("dist").alias("mx"))
    c = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("mx")), lambda i: F.coalesce(F.try_element_at(F.col("h"), i), F.lit(0).cast("bigint")))
    return g.select("tag", "end_no", F.array_join(c.cast("array<string>"), ":").alias("counters"))


@query(f"""WITH {ROWS}, c AS (SELECT tag, end_no, dist, count(*) AS n FROM w GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY tag, end_no ORDER BY dist) AS k,
  lead(dist) OVER (PARTITION BY tag, end_no ORDER BY dist) AS nx FROM c), uq AS (SELECT CASE WHEN n <> 1 THEN -1 ELSE coalesce(nx, dist + 1) - dist - 1 END AS u FROM o WHERE k = 1)
SELECT 'uniqueness' AS metric, CASE WHEN u < 0 THEN 'X' WHEN u <= 0 THEN '0' WHEN u <= 1 THEN '1' WHEN u <= 2 THEN '2' WHEN u <= 3 THEN '3' WHEN u <= 10 THEN '10' WHEN u <= 50 THEN '50' WHEN u <= 100 THEN '100' WHEN u <= 500 THEN '500' ELSE 'more' END AS bucket, count(*) AS value FROM uq GROUP BY ALL""")
def uniq_hist(spark, d):
    c = counters_strata(spark, d).select(C.uniq_degree(F.transform(F.split("counters", ":"), lambda x: x.cast("bigint"))).alias("u"))
    return A.hist(c, "uniqueness", F.when(F.col("u") < 0, "X").otherwise(A.bucket(F.col("u"), A.UNIQUENESS)))


@query(f"""WITH {ROWS}, c AS (SELECT tag, end_no, sum(CASE WHEN maps <> '-' THEN 1 ELSE 0 END) AS n FROM u GROUP BY ALL)
SELECT 'multimaps' AS metric, CASE WHEN n <= 0 THEN '0' WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '5' WHEN n <= 10 THEN '10' WHEN n <= 50 THEN '50' WHEN n <= 100 THEN '100' WHEN n <= 500 THEN '500' WHEN n <= 1000 THEN '1000' ELSE 'more' END AS bucket, count(*) AS value FROM c GROUP BY ALL""")
def stats_mmap_hist(spark, d):
    c = rows(spark, d, "tag", "end_no", "maps").groupBy("tag", "end_no").agg(F.sum((F.col("maps") != "-").cast("bigint")).alias("n"))
    return A.hist(c, "multimaps", A.bucket(F.col("n"), A.MULTIMAPS))


@query(f"""WITH {ROWS} SELECT tag, end_no, map_id FROM w JOIN (SELECT tag AS t2, end_no AS e2, min(dist) AS lo FROM w GROUP BY ALL) ON tag = t2 AND end_no = e2 WHERE dist = lo""")
def best_stratum(spark, d):
    """Mappings of the best stratum of their read: ranks by joining an aggregate, so hot reads stay splittable."""
    x = mapped(spark, d, "tag", "end_no").select("tag", "end_no", "map_id", M.global_distance(F.col("m.blocks")).alias("dist"))
    lo = x.groupBy("tag", "end_no").agg(F.min("dist").alias("lo"))
    return x.join(lo, ["tag", "end_no"]).where("dist = lo").select("tag", "end_no", "map_id")


@query(f"""WITH {ROWS} SELECT map_id, CASE WHEN n_edits IS NULL THEN 'none' WHEN n_edits = dist - njunc THEN 'edits' WHEN n_edits = dist THEN 'stratum' WHEN n_edits = lev THEN 'levenshtein' ELSE 'other' END AS agrees FROM w""")
def declared_edits(spark, d):
    b = F.col("m.blocks")
    n = F.col("n_edits")
    return mapped(spark, d, "n_edits").select("map_id", F.when(n.isNull(), "none").when(n == M.no_split_distance(b), "edits").when(n == M.global_distance(b), "stratum").when(n == M.levenshtein(b), "levenshtein").otherwise("other").alias("agrees"))


# ---- statistics -----------------------------------------------------------------------------------------------------


@query(f"""WITH {MAPS}, f AS (SELECT line_id, base_len - mism - dels AS al FROM m WHERE map_no = 0), c AS (SELECT line_id, count(*) AS n FROM m GROUP BY 1)
SELECT count(*) AS reads, min(length(r)) AS min_length, max(length(r)) AS max_length, CAST(sum(length(r)) AS BIGINT) AS bases, count(n) AS mapped, CAST(coalesce(sum(n), 0) AS BIGINT) AS maps,
  min(CASE WHEN n > 0 THEN length(r) END) AS mapped_min_length, max(CASE WHEN n > 0 THEN length(r) END) AS mapped_max_length, CAST(sum(coalesce(al, 0)) AS BIGINT) AS bases_aligned
FROM tpl t LEFT JOIN c ON c.line_id = t.line_id LEFT JOIN f ON f.line_id = t.line_id""")
def stats_general(spark, d):
    return A.general(templates(spark, d))


def _case(v: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {v} <= {b} THEN '{b}'" for b in bounds) + " ELSE 'more' END"


@query(f"""WITH rd AS (SELECT DISTINCT read_id, read_seq FROM fastq_reads) SELECT 'length' AS metric, {_case('length(read_seq)', A.LENGTHS)} AS bucket, count(*) AS value FROM rd WHERE read_seq IS NOT NULL GROUP BY ALL""")
def stats_length_hist(spark, d):
    return A.hist(table(spark, d, "fastq_reads").select("read_id", "read_seq").distinct(), "length", A.bucket(F.length("read_seq"), A.LENGTHS))


_ERR = "CASE WHEN {v} = 0 THEN '0' " + " ".join(f"WHEN {{v}} <= floor({b} * (length(r) / 100.0)) THEN '{b}'" for b in A.ERRORS[1:]) + " ELSE 'more' END"


@query(f"WITH {MAPS}, j AS (SELECT m.*, r FROM m JOIN tpl USING (line_id)) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {_ERR.format(v=v)} AS bucket, count(*) AS value FROM j GROUP BY ALL" for n, v in (("mismatches", "mism"), ("levenshtein", "lev"), ("insertions", "ins"), ("deletions", "dels"), ("events", "dist"))))
def stats_error_hist(spark, d):
    b = F.col("m.blocks")
    x = T.map_rows(templates(spark, d), ("line_id", "read"))
    x = x.select(F.length("read").alias("n"), M.n_mismatches(b).alias("mismatches"), M.levenshtein(b).alias("levenshtein"), M.total_ins(b).alias("insertions"), M.total_dels(b).alias("deletions"), M.global_distance(b).alias("events"))
    # One pass: the five values of a mapping become rows of one grouped count.
    names = ["mismatches", "levenshtein", "insertions", "deletions", "events"]
    long = x.select("n", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names))).alias("p")).select("n", "p.*")
    return long.groupBy("metric", A.error_bucket(F.col("v"), F.col("n")).alias("bucket")).agg(F.count("*").alias("value"))


@query(f"""WITH {ROWS}, x AS (SELECT tlen FROM u WHERE tlen IS NOT NULL AND tlen <> 0)
SELECT 'insert' AS metric, CAST(CAST(CASE WHEN tlen < -1000 THEN 0 WHEN tlen >= 50010 THEN 5100 ELSE floor((tlen + 1000) / 10) END AS BIGINT) AS VARCHAR) AS bucket, count(*) AS value FROM x GROUP BY ALL""")
def stats_insert_hist(spark, d):
    return A.hist(rows(spark, d, "tlen").where("tlen is not null and tlen <> 0"), "insert", A.insert_bucket(F.col("tlen")))


@query(f"""WITH {ROWS} SELECT seq_name, strand, count(*) AS n, count(DISTINCT tag) AS tags FROM w GROUP BY ALL""")
def stats_strand(spark, d):
    return rows(spark, d, "tag", "seq_name", "strand", "maps").where("maps <> '-'").groupBy("seq_name", "strand").agg(F.count("*").alias("n"), F.count_distinct("tag").alias("tags"))


@query(f"""WITH {ROWS}, j AS (SELECT njunc, unnest(list_transform(regexp_extract_all(e, '>([0-9]+)[*]', 1), lambda x: CAST(x AS BIGINT))) AS jl FROM w)
SELECT 'junctions' AS metric, {_case('njunc', A.JUNCTIONS)} AS bucket, count(*) AS value FROM w WHERE njunc > 0 GROUP BY ALL
UNION ALL SELECT 'junction_length', {_case('jl', A.JUNCTION_LENGTHS)}, count(*) FROM j GROUP BY ALL""")
def stats_junctions(spark, d):
    x = rows(spark, d, "maps").where("maps like '%*%'").withColumn("m", M.parse_map(F.col("maps")))
    j = x.select(F.explode(F.filter(F.transform("m.blocks", lambda b: b["junction"]), lambda v: v > 0)).alias("jl"))
    return A.hist(x, "junctions", A.bucket(F.size("m.blocks") - 1, A.JUNCTIONS)).unionByName(A.hist(j, "junction_length", A.bucket(F.col("jl"), A.JUNCTION_LENGTHS)))


@query(f"""WITH {ROWS}, c AS (SELECT tag, seq_name, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT tag, sum(n) AS nm, count(*) AS dv, max(n) AS dom FROM c GROUP BY tag)
SELECT CAST(dv AS BIGINT) AS diversity, CAST(floor(dom * 10 / nm) AS BIGINT) AS dominance, count(*) AS reads FROM p GROUP BY ALL""")
def stats_population(spark, d):
    p = A.population(rows(spark, d, "tag", "seq_name", "maps").where("maps <> '-'"), "tag", "seq_name")
    return p.groupBy("diversity", F.floor(F.col("dominant") * 10 / F.col("n_maps")).alias("dominance")).agg(F.count("*").alias("reads"))


@query(f"""WITH {ROWS} SELECT count(DISTINCT seq_name) AS global_diversity, count(DISTINCT run_id) AS runs, count(*) AS mappings FROM w""")
def global_diversity(spark, d):
    return rows(spark, d, "seq_name", "run_id", "maps").where("maps <> '-'").agg(F.count_distinct("seq_name").alias("global_diversity"), F.count_distinct("run_id").alias("runs"), F.count("*").alias("mappings"))


@query("""WITH rd AS (SELECT DISTINCT read_id, upper(read_seq) AS s FROM fastq_reads) SELECT b AS base, CAST(sum(length(s) - length(replace(s, b, ''))) AS BIGINT) AS value FROM rd, (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS b) GROUP BY b""")
def nucleotide_counts(spark, d):
    return A.nucleotides(table(spark, d, "fastq_reads").select("read_id", "read_seq").distinct())


@query("""WITH rd AS (SELECT DISTINCT read_id, read_seq AS s FROM fastq_reads WHERE read_seq IS NOT NULL), x AS (SELECT unnest(range(0, length(s))) AS c, s FROM rd) SELECT CAST(c AS INT) AS cycle, substr(s, c + 1, 1) AS base, count(*) AS value FROM x GROUP BY ALL""")
def per_cycle_bases(spark, d):
    return A.per_cycle(table(spark, d, "fastq_reads").select("read_id", "read_seq").distinct())


@query("""WITH rd AS (SELECT DISTINCT read_id, read_seq, qualities AS q FROM fastq_reads WHERE length(read_seq) = length(qualities)), x AS (SELECT unnest(range(0, length(q))) AS c, q FROM rd) SELECT CAST(c AS INT) AS cycle, ascii(substr(q, c + 1, 1)) AS qual, count(*) AS value FROM x GROUP BY ALL""")
def per_cycle_quality(spark, d):
    return A.per_cycle_quality(table(spark, d, "fastq_reads").select("read_id", "read_seq", "qualities").distinct())


_OPS = rf"""WITH {MAPS}, t AS (SELECT line_id, map_no, unnest(regexp_extract_all(e, '{E}')) AS t, generate_subscripts(regexp_extract_all(e, '{E}'), 1) AS i FROM m),
o AS (SELECT *, right(t, 1) AS c, CASE WHEN regexp_matches(t, '[A-Z]') THEN 1 WHEN right(t, 1) IN ('+', '*') THEN 0 ELSE CAST(regexp_extract(t, '[0-9]+') AS BIGINT) END AS n FROM t),
a AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY line_id, map_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ap FROM o),
every AS (SELECT ap FROM a WHERE c IN ('+', '-', ')') OR regexp_matches(t, '[A-Z]')),
x AS (SELECT a.line_id, map_no, ap, t AS ref, substr(r, ap + 1, 1) AS base, CASE WHEN ap > 0 THEN substr(r, ap, 1) END AS pv, substr(r, ap + 2, 1) AS nx, CASE WHEN substr(q, ap + 1, 1) <> '' THEN ascii(substr(q, ap + 1, 1)) END AS ql
  FROM a JOIN tpl USING (line_id) WHERE regexp_matches(t, '[A-Z]'))"""


def _mismatches(spark, d):
    return A.mismatches(templates(spark, d)).where("type = 'MISMS'")


@query(f"{_OPS} SELECT ap AS pos, count(*) AS value FROM every GROUP BY ALL")
def error_positions(spark, d):
    """Mismatches, indels and trims of all blocks of all mappings, by position in the read."""
    return A.mismatches(templates(spark, d)).groupBy(F.col("read_pos").alias("pos")).agg(F.count("*").alias("value"))


@query(f"{_OPS} SELECT base AS read_base, ref AS ref_base, count(*) AS value FROM x GROUP BY ALL")
def transition_matrix(spark, d):
    return _mismatches(spark, d).groupBy("read_base", F.col("base").alias("ref_base")).agg(F.count("*").alias("value"))


@query(f"{_OPS} SELECT pv AS prev_base, base AS read_base, nx AS next_base, ref AS ref_base, count(*) AS value FROM x GROUP BY ALL")
def transition_context(spark, d):
    return _mismatches(spark, d).groupBy("prev_base", "read_base", "next_base", F.col("base").alias("ref_base")).agg(F.count("*").alias("value"))


@query(f"{_OPS} SELECT ql AS qual, count(*) AS value FROM x GROUP BY ALL")
def mismatch_qualities(spark, d):
    return _mismatches(spark, d).withColumn("qual", F.when(F.col("qual") > 0, F.col("qual"))).groupBy("qual").agg(F.count("*").alias("value"))


@query(f"""WITH {TPL}, x AS (SELECT length(r) AS n, CASE WHEN ms = '-' THEN 0 ELSE len(string_split(ms, ',')) END AS k FROM tpl)
SELECT CAST(CASE WHEN n < 0 THEN -1 WHEN n >= 200 THEN 8 ELSE n // 25 END AS BIGINT) AS length_bin, CAST(CASE WHEN k < 0 THEN -1 WHEN k >= 10 THEN 5 ELSE k // 2 END AS BIGINT) AS maps_bin, count(*) AS value FROM x GROUP BY ALL""")
def nested_histogram(spark, d):
    return A.step_hist(templates(spark, d), {"length_bin": (F.length("read"), 0, 200, 25), "maps_bin": (F.size("maps"), 0, 10, 2)})


@query(f"""WITH {TPL}, x AS (SELECT length(r) AS n, CASE WHEN q <> '' THEN CAST(list_sum(list_transform(string_split(q, ''), lambda c: ascii(c))) AS BIGINT) // length(q) END AS aq, CASE WHEN ms = '-' THEN 0 ELSE len(string_split(ms, ',')) END AS k FROM tpl)
SELECT {_case('n', A.LENGTHS)} AS length_bucket, aq AS avg_quality, {_case('k', A.MULTIMAPS)} AS maps_bucket, count(*) AS value FROM x GROUP BY ALL""")
def length_quality_matrix(spark, d):
    from readloom.functions.sequence import average_quality

    return templates(spark, d).groupBy(A.bucket(F.length("read"), A.LENGTHS).alias("length_bucket"), average_quality(F.col("quals")).alias("avg_quality"), A.bucket(F.size("maps"), A.MULTIMAPS).alias("maps_bucket")).agg(F.count("*").alias("value"))


@query(f"""WITH {ROWS}, rd AS (SELECT DISTINCT read_id, read_seq FROM fastq_reads), c AS (SELECT tag, end_no, sum(CASE WHEN maps <> '-' THEN 1 ELSE 0 END) AS n FROM u GROUP BY ALL),
h AS (SELECT 'length' AS metric, {_case('length(read_seq)', A.LENGTHS)} AS bucket, count(*) AS value FROM rd WHERE read_seq IS NOT NULL GROUP BY ALL UNION ALL SELECT 'multimaps', {_case('n', A.MULTIMAPS)}, count(*) FROM c GROUP BY ALL)
SELECT metric, '{{' || string_agg('"' || bucket || '":' || value, ',' ORDER BY bucket) || '}}' AS json FROM h GROUP BY 1""")
def stats_json(spark, d):
    return A.to_json_report(A.merge(stats_length_hist(spark, d), stats_mmap_hist(spark, d)))


@query(f"""WITH {ROWS}, g AS (SELECT seq_name, pos, abs(tlen) AS dist, CASE WHEN len(string_split(tag, ':')) >= 5 THEN string_split(tag, ':')[-3] END AS tile, tlen > 0 AS fw FROM w WHERE tlen <> 0),
c AS (SELECT seq_name, pos, dist, tile, sum(fw::INT) AS p, sum((NOT fw)::INT) AS m FROM g GROUP BY ALL),
k AS (SELECT seq_name, pos, dist, sum(p + m) AS k, sum(p * (p - 1) / 2 + m * (m - 1) / 2) AS a, sum(p * m) AS b, sum(p) AS ps, sum(m) AS ms, sum(p * p + m * m) AS sq FROM c GROUP BY ALL)
SELECT CAST(k AS BIGINT) AS k, count(*) AS groups, CAST(sum(a) AS BIGINT) AS same_tile_strand, CAST(sum(b) AS BIGINT) AS same_tile, CAST(sum((ps * ps + ms * ms - sq) / 2) AS BIGINT) AS same_strand, CAST(sum(ps * ms - b) AS BIGINT) AS neither FROM k GROUP BY ALL""")
def duplicate_counts(spark, d):
    """Groups of mappings of one place and one distance to the mate; the sign of the distance tells the strand."""
    return A.duplicate_classes(_tiled(spark, d), ["seq_name", "pos", "dist"], "tile", "side")


def _tiled(spark, d):
    p = F.split("tag", ":")
    x = rows(spark, d, "tag", "seq_name", "pos", "tlen", "maps").where("maps <> '-' and tlen <> 0").withColumn("tile", F.when(F.size(p) >= 5, F.get(p, F.size(p) - 3)))
    return x.withColumn("dist", F.abs("tlen")).withColumn("side", F.when(F.col("tlen") > 0, "+").otherwise("-"))


@query(f"""WITH {ROWS}, g AS (SELECT seq_name, pos, abs(tlen) AS dist, CASE WHEN len(string_split(tag, ':')) >= 5 THEN string_split(tag, ':')[-3] END AS tile, tlen > 0 AS fw FROM w WHERE tlen <> 0),
k AS (SELECT seq_name, pos, dist, count(*) AS k FROM g GROUP BY ALL), p AS (SELECT count(*) FILTER (WHERE a.tile IS NOT DISTINCT FROM b.tile AND a.fw = b.fw) AS a, count(*) FILTER (WHERE a.tile IS NOT DISTINCT FROM b.tile AND a.fw <> b.fw) AS b,
  count(*) FILTER (WHERE a.tile IS DISTINCT FROM b.tile AND a.fw = b.fw) AS c, count(*) FILTER (WHERE a.tile IS DISTINCT FROM b.tile AND a.fw <> b.fw) AS d
  FROM (SELECT *, row_number() OVER () AS i FROM g) a JOIN (SELECT *, row_number() OVER () AS i FROM g) b ON a.seq_name = b.seq_name AND a.pos = b.pos AND a.dist = b.dist AND a.i < b.i),
r AS (SELECT 1.0 - count(*)::DOUBLE / sum(k) AS rate FROM k) SELECT CASE WHEN a + b + c + d = 0 THEN 0.0 ELSE rate END AS duplicate_rate, CASE WHEN a + b + c + d = 0 THEN 0.0 ELSE a * (CASE WHEN a * d > 0 THEN 1.0 - b * c / (a * d) ELSE 1.0 END) / (a + b + c + d) END AS optical FROM p, r""")
def duplicate_rate(spark, d):
    """Share of duplicates and of optical ones; the number of fragments, found by halving, is in pytest."""
    r = A.duplicate_rate(duplicate_counts(spark, d))
    return spark.range(1).select(*(F.lit(float(r[k])).alias(k) for k in ("duplicate_rate", "optical")))


@query(f"""WITH {MAPS}, r AS (SELECT line_id, max(njunc) AS mx, min(njunc) AS mn FROM m GROUP BY 1)
SELECT count(*) AS mapped, CAST(coalesce(sum((mx > 0)::INT), 0) AS BIGINT) AS with_splits, CAST(coalesce(sum((mn > 0)::INT), 0) AS BIGINT) AS only_splits, round(100.0 * sum((mx > 0)::INT) / count(*), 6) AS percent_with FROM r""")
def stats_split_reads(spark, d):
    """Mapped reads with some, and with nothing but, split mappings."""
    n = lambda c: F.sum(c.cast("bigint"))
    split = F.transform("maps", lambda m: F.size(m["blocks"]) > 1)
    x = templates(spark, d).where(F.size("maps") > 0).select(F.exists(split, lambda v: v).alias("some"), F.forall(split, lambda v: v).alias("all"))
    return x.agg(F.count("*").alias("mapped"), n(F.col("some")).alias("with_splits"), n(F.col("all")).alias("only_splits"), F.round(100.0 * n(F.col("some")) / F.count("*"), 6).alias("percent_with"))


@query(f"""{_PAIR}, k AS (SELECT tag, count(*) FILTER (WHERE end_no = 1) AS n1, count(*) FILTER (WHERE end_no = 2) AS n2 FROM w GROUP BY 1)
SELECT insert_size, count(*) AS paired, count(*) FILTER (WHERE n1 = 1 AND n2 = 1) AS all_unique, count(*) FILTER (WHERE (n1 = 1) <> (n2 = 1)) AS recovered, count(*) FILTER (WHERE len(j1) + len(j2) > 0) AS split FROM pairs JOIN k USING (tag) GROUP BY 1""")
def insert_by_class(spark, d):
    """Insert sizes by class of pair: all, of unique ends, with one unique end, with a split end."""
    e = F.col("end_no")
    k = rows(spark, d, "tag", "end_no", "maps").where("maps <> '-'").groupBy("tag").agg(F.count(F.when(e == 1, 1)).alias("n1"), F.count(F.when(e == 2, 1)).alias("n2"))
    x = _pairs(spark, d).join(k, "tag")
    u1, u2 = F.col("n1") == 1, F.col("n2") == 1
    split = M.is_split(F.col("m1.blocks")) | M.is_split(F.col("m2.blocks"))
    return x.groupBy("insert_size").agg(F.count("*").alias("paired"), F.count(F.when(u1 & u2, 1)).alias("all_unique"), F.count(F.when(u1 != u2, 1)).alias("recovered"), F.count(F.when(split, 1)).alias("split"))


@query(f"""WITH {ROWS} SELECT count(*) FILTER (WHERE seq_name = 'chrM') AS control, count(*) AS mapped, round(100.0 * count(*) FILTER (WHERE seq_name = 'chrM') / count(*), 6) AS percent FROM w""")
def control_counts(spark, d):
    """Mappings on a control sequence, named by the caller; here the mitochondrial one."""
    x = rows(spark, d, "seq_name", "maps").where("maps <> '-'")
    hit = F.count(F.when(F.col("seq_name") == "chrM", 1))
    return x.agg(hit.alias("control"), F.count("*").alias("mapped"), F.round(100.0 * hit / F.count("*"), 6).alias("percent"))


@query("WITH rd AS (SELECT DISTINCT read_id, run_id, read_seq FROM fastq_reads WHERE read_seq IS NOT NULL) SELECT run_id, count(*) AS reads, CAST(sum(length(read_seq)) AS BIGINT) AS bases, max(length(read_seq)) AS longest FROM rd GROUP BY 1")
def yield_per_run(spark, d):
    x = table(spark, d, "fastq_reads").where("read_seq is not null").select("read_id", "run_id", "read_seq").distinct()
    n = F.length("read_seq").cast("bigint")
    return x.groupBy("run_id").agg(F.count("*").alias("reads"), F.sum(n).alias("bases"), F.max(n).alias("longest"))


# ---- set operations: records with even line numbers' mappings on + against all ----------------------------------------


def _other(spark, d):
    """A second mapping set over the same records: the mappings of the forward strand, and each mapping on the reverse
    strand once more on the forward strand, which the first set lacks."""
    turned = F.transform(F.filter("maps", lambda m: m["strand"] == "-"), lambda m: M.parse_map(F.regexp_replace(m["txt"], ":[-R]:", ":+:")))
    return T.recount(templates(spark, d).withColumn("maps", F.concat(F.filter("maps", lambda m: m["strand"] == "+"), turned)))


#: Counters of the mappings of several sets per record.
_COUNTED = """cn AS (SELECT line_id, w, dist, count(*) AS n FROM ({of}) GROUP BY ALL), cm AS (SELECT line_id, w, unnest(range(0, max(dist) + 1)) AS i FROM cn GROUP BY line_id, w),
cc AS (SELECT cm.line_id, cm.w, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ':' ORDER BY i) AS c FROM cm LEFT JOIN cn ON cn.line_id = cm.line_id AND cn.w = cm.w AND cn.dist = cm.i GROUP BY ALL)"""


def _kept(cond: str) -> str:
    return f"""WITH {SETS}, s AS (SELECT line_id, string_agg(txt, ',' ORDER BY ord) AS maps FROM a WHERE {cond} GROUP BY 1)
SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN s ON s.line_id = t.line_id"""


_NEAR = """EXISTS (SELECT 1 FROM b o WHERE o.line_id = a.line_id AND o.seq = a.seq AND o.st = a.st AND len(o.ss) = len(a.ss) AND CASE WHEN len(a.ss) = 1 THEN abs(o.ss[1] - a.ss[1]) <= 2 OR abs(o.es[1] - a.es[1]) <= 2
  ELSE len(list_filter(range(1, len(a.ss) + 1), lambda i: abs(o.ss[i] - a.ss[i]) > 2 OR abs(o.es[i] - a.es[i]) > 2)) = 0 END)"""


def _txt(df):
    return df.select("line_id", T.texts(F.col("maps")).alias("maps"))


@query(_kept("NOT shared"))
def set_difference(spark, d):
    return _txt(U.file_difference(templates(spark, d), _other(spark, d), "line_id"))


@query(_kept("shared"))
def set_intersection(spark, d):
    return _txt(U.file_intersection(templates(spark, d), _other(spark, d), "line_id"))


@query(f"WITH {SETS}, {united('b', 'a')}")
def set_union(spark, d):
    return _txt(U.file_union(_other(spark, d), templates(spark, d), "line_id"))


@query(f"""WITH {SETS}, {_COUNTED.format(of="SELECT line_id, 'oa' AS w, dist FROM a WHERE NOT shared UNION ALL SELECT line_id, 'ob', dist FROM b WHERE NOT shared UNION ALL SELECT line_id, 'ab', dist FROM a WHERE shared")},
x AS (SELECT line_id, string_agg(txt, ',' ORDER BY ord) FILTER (WHERE NOT shared) AS o, string_agg(txt, ',' ORDER BY ord) FILTER (WHERE shared) AS s FROM a GROUP BY 1),
y AS (SELECT line_id, string_agg(txt, ',' ORDER BY ord) FILTER (WHERE NOT shared) AS o FROM b GROUP BY 1)
SELECT t.line_id, coalesce(oa.c, '0') AS counters_only_a, coalesce(ob.c, '0') AS counters_only_b, coalesce(ab.c, '0') AS counters_both, coalesce(x.o, '-') AS only_a, coalesce(y.o, '-') AS only_b, coalesce(x.s, '-') AS both FROM tpl t LEFT JOIN x ON x.line_id = t.line_id LEFT JOIN y ON y.line_id = t.line_id
LEFT JOIN cc oa ON oa.line_id = t.line_id AND oa.w = 'oa' LEFT JOIN cc ob ON ob.line_id = t.line_id AND ob.w = 'ob' LEFT JOIN cc ab ON ab.line_id = t.line_id AND ab.w = 'ab'""")
def set_compare(spark, d):
    return U.file_compare(templates(spark, d), _other(spark, d), "line_id")


@query(f"""WITH {SETS}, {_COUNTED.format(of="SELECT line_id, src AS w, dist FROM k")}, s AS (SELECT line_id, string_agg(txt, ',' ORDER BY ord) FILTER (WHERE src = 'a') AS a, string_agg(txt, ',' ORDER BY ord) FILTER (WHERE src = 'b') AS b FROM k GROUP BY 1)
SELECT t.line_id, coalesce(ca.c, '0') AS counters_a, coalesce(cb.c, '0') AS counters_b, coalesce(a, '-') AS maps_a, coalesce(b, '-') AS maps_b FROM tpl t LEFT JOIN s ON s.line_id = t.line_id
LEFT JOIN cc ca ON ca.line_id = t.line_id AND ca.w = 'a' LEFT JOIN cc cb ON cb.line_id = t.line_id AND cb.w = 'b'""")
def set_join(spark, d):
    return U.file_join(templates(spark, d), _other(spark, d), "line_id")


@query(_kept(f"NOT {_NEAR}"))
def set_difference_tolerant(spark, d):
    return _txt(U.file_difference(templates(spark, d), _other(spark, d), "line_id", tolerance=2))


@query(f"WITH {SETS}, {united('a', 'b')}")
def merge_same_reads(spark, d):
    return _txt(U.merge(templates(spark, d), _other(spark, d), key="line_id", same_reads=True))


@query(f"WITH {SETS}, {united('a', 'b')}")
def merge_subset(spark, d):
    return _txt(U.merge(templates(spark, d), _other(spark, d), _other(spark, d), key="line_id"))


@query(f"WITH {TPL} SELECT line_id FROM tpl WHERE line_id % 3 = 0")
def merge_unmatched(spark, d):
    return U.unmatched(templates(spark, d), templates(spark, d).where("line_id % 3 <> 0"), "line_id").select("line_id")


@query(f"""WITH {MAPS}, s AS (SELECT line_id, string_agg(seq, ',' ORDER BY map_no) AS sq FROM m GROUP BY 1),
c AS (SELECT line_id, CASE WHEN ct = '!' THEN [] ELSE flatten(list_transform(string_split_regex(ct, '[:+]'), lambda t: list_resize(CAST([] AS BIGINT[]), CAST(coalesce(nullif(split_part(t, 'x', 2), ''), '1') AS BIGINT), CAST(split_part(t, 'x', 1) AS BIGINT)))) END AS c FROM tpl)
SELECT t.line_id, length(r) AS length, array_to_string(c, ':') AS counters, coalesce(sq, '') AS sequences FROM tpl t JOIN c ON c.line_id = t.line_id LEFT JOIN s ON s.line_id = t.line_id""")
def display_compact(spark, d):
    return U.compact(templates(spark, d), ("line_id",)).withColumn("length", F.col("length").cast("bigint"))


@query("""WITH a AS (SELECT line_id, file_kind, row_number() OVER (PARTITION BY file_kind ORDER BY line_id) - 1 AS row_no FROM raw_records WHERE file_kind IN ('sam', 'gtf'))
SELECT line_id, CAST(CASE file_kind WHEN 'sam' THEN 0 ELSE 1 END AS INT) AS file_no, row_no FROM a""")
def interleave(spark, d):
    r = table(spark, d, "raw_records").select("line_id", "file_kind")
    return U.interleave(r.where("file_kind = 'sam'"), r.where("file_kind = 'gtf'"), order="line_id").select("line_id", "file_no", "row_no")


# ---- annotation -----------------------------------------------------------------------------------------------------


@query(f"WITH {BLOCKS}, {FEATURES} SELECT map_id, block_no, ann_id FROM b JOIN f ON seq_name = fq AND {HIT}")
def interval_join(spark, d):
    f = features(spark, d).select("ann_id", F.col("seq_name").alias("fq"), "start_pos", "end_pos")
    return I.overlap_join(blocks(spark, d), f, ("seq_name", "b_start", "b_end"), ("fq", "start_pos", "end_pos")).select("map_id", F.col("block_no").cast("bigint").alias("block_no"), "ann_id")


@query(f"WITH {BLOCKS}, {FEATURES}, p AS (SELECT map_id, seq_name, s, s AS en FROM b WHERE block_no = 0) SELECT map_id, ann_id FROM p JOIN f ON seq_name = fq AND {HIT}")
def point_query(spark, d):
    f = features(spark, d).select("ann_id", F.col("seq_name").alias("fq"), "start_pos", "end_pos")
    p = blocks(spark, d).where("block_no = 0").withColumn("e", F.col("b_start"))
    return I.overlap_join(p, f, ("seq_name", "b_start", "e"), ("fq", "start_pos", "end_pos")).select("map_id", "ann_id")


_FX = "SELECT DISTINCT ann_id, seq_name, start_pos, end_pos, strand, gene_id, transcript_id FROM annotations WHERE feature_type = 'exon' AND transcript_id IS NOT NULL AND start_pos <= end_pos"


@query(f"""WITH x AS ({_FX}) SELECT ann_id, row_number() OVER w - 1 AS exon_no, CAST(coalesce(sum(end_pos - start_pos + 1) OVER (PARTITION BY transcript_id ORDER BY start_pos, end_pos, ann_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS exon_offset FROM x WINDOW w AS (PARTITION BY transcript_id ORDER BY start_pos, end_pos, ann_id)""")
def exon_offsets(spark, d):
    return I.exon_order(features(spark, d)).select("ann_id", F.col("exon_no").cast("bigint").alias("exon_no"), "exon_offset")


@query(f"""WITH x AS ({_FX}), l AS (SELECT *, lag(end_pos) OVER w AS pe, lag(seq_name) OVER w AS ps, row_number() OVER w - 1 AS k FROM x WINDOW w AS (PARTITION BY transcript_id ORDER BY start_pos, end_pos, ann_id))
SELECT seq_name, transcript_id, pe + 1 AS start_pos, start_pos - 1 AS end_pos, k - 1 AS intron_no FROM l WHERE ps = seq_name AND start_pos - 1 >= pe + 1""")
def intron_synthesis(spark, d):
    return I.introns(features(spark, d)).select("seq_name", "transcript_id", "start_pos", "end_pos", F.col("intron_no").cast("bigint").alias("intron_no"))


@query(f"""WITH {FEATURES} SELECT g AS gene_id, count(DISTINCT tr) AS n_transcripts, CAST(sum((ft = 'exon')::INT) AS BIGINT) AS n_exons FROM f WHERE g IS NOT NULL GROUP BY g""")
def gene_children(spark, d):
    return I.children(features(spark, d))


_GENE = f"""WITH {BLOCKS}, {FEATURES}, h AS (SELECT template, map_no, block_no, n_blocks, s, en, ft, fs, fe, g FROM b JOIN f ON seq_name = fq AND {HIT}),
bg AS (SELECT template, map_no, block_no, n_blocks, g, max((ft = 'exon')::INT) AS x, sum((ft = 'exon' AND (s = fs OR s = fe OR en = fe OR en = fs))::INT) AS j FROM h WHERE g IS NOT NULL GROUP BY ALL),
ba AS (SELECT *, max(x) OVER (PARTITION BY template, map_no, block_no) AS anyx FROM bg), bk AS (SELECT * FROM ba WHERE x = anyx),
mg AS (SELECT template, map_no, n_blocks, g, count(*) AS cnt, sum(j) AS j, max(x) AS x FROM bk GROUP BY ALL),
mw AS (SELECT *, count(*) OVER (PARTITION BY template, map_no) AS ng, coalesce(max(CASE WHEN cnt = n_blocks THEN j END) OVER (PARTITION BY template, map_no), 0) AS best FROM mg),
mk AS (SELECT template, map_no, g, x FROM mw WHERE ng = 1 OR (cnt = n_blocks AND (best = 0 OR j = best))),
tg AS (SELECT DISTINCT template, g FROM mk), th AS (SELECT template, count(*) AS hits FROM tg GROUP BY 1)"""


_TGENE = f"""WITH {TBLOCKS}, {FEATURES}, h AS (SELECT line_id, map_no, tb.bno, n_blocks, s, en, ft, fs, fe, g FROM tb JOIN f ON seq = fq AND {HIT}),
bg AS (SELECT line_id, map_no, bno, n_blocks, g, max((ft = 'exon')::INT) AS x, sum((ft = 'exon' AND (s = fs OR s = fe OR en = fe OR en = fs))::INT) AS j FROM h WHERE g IS NOT NULL GROUP BY ALL),
ba AS (SELECT *, max(x) OVER (PARTITION BY line_id, map_no, bno) AS anyx FROM bg), mg AS (SELECT line_id, map_no, n_blocks, g, count(*) AS cnt, sum(j) AS j FROM ba WHERE x = anyx GROUP BY ALL),
mw AS (SELECT *, count(*) OVER (PARTITION BY line_id, map_no) AS ng, coalesce(max(CASE WHEN cnt = n_blocks THEN j END) OVER (PARTITION BY line_id, map_no), 0) AS best FROM mg),
mk AS (SELECT line_id, map_no, g FROM mw WHERE ng = 1 OR (cnt = n_blocks AND (best = 0 OR j = best)))"""


@query(f"{_GENE} SELECT g AS gene_id, CAST(count(*) AS DOUBLE) AS n FROM tg JOIN th USING (template) WHERE hits = 1 GROUP BY g")
def gene_counts(spark, d):
    return I.gene_counts(blocks(spark, d), features(spark, d))


@query(f"{_GENE} SELECT g AS gene_id, CAST(count(*) AS DOUBLE) AS n FROM tg GROUP BY g")
def gene_counts_multimap(spark, d):
    return I.gene_counts(blocks(spark, d), features(spark, d), multi=True)


@query(f"{_GENE} SELECT g AS gene_id, round(sum(1.0 / hits), 6) AS n FROM tg JOIN th USING (template) GROUP BY g")
def gene_counts_weighted(spark, d):
    return I.gene_counts(blocks(spark, d), features(spark, d), multi=True, weighted=True).withColumn("n", F.round("n", 6))


@query(f"""{_GENE}, o AS (SELECT template, map_no, block_no, max(CASE WHEN ft = 'exon' AND g IS NOT NULL THEN (least(en, fe) - greatest(s, fs) + 1)::DOUBLE / (en - s + 1) END) AS o FROM h GROUP BY ALL),
bt AS (SELECT b.template, b.map_no, en - s + 1 AS len, coalesce(o, 0) AS o FROM b LEFT JOIN o ON o.template = b.template AND o.map_no = b.map_no AND o.block_no = b.block_no),
ov AS (SELECT template, map_no, sum(o * len) / sum(len) AS ov FROM bt GROUP BY ALL), xk AS (SELECT DISTINCT template, g FROM mk JOIN ov USING (template, map_no) WHERE x = 1 AND ov >= 0.5 - 1e-6), xh AS (SELECT template, count(*) AS hits FROM xk GROUP BY 1)
SELECT g AS gene_id, CAST(count(*) AS DOUBLE) AS n FROM xk JOIN xh USING (template) WHERE hits = 1 GROUP BY g""")
def gene_counts_overlap(spark, d):
    return I.gene_counts(blocks(spark, d), features(spark, d), exon_overlap=0.5)


@query(f"""{_GENE}, nm AS (SELECT template FROM b GROUP BY 1 HAVING count(DISTINCT map_no) = 1), s1 AS (SELECT template, any_value(g) AS g FROM tg JOIN nm USING (template) GROUP BY 1 HAVING count(*) = 1),
gt AS (SELECT g, min(gt) AS gene_type FROM f WHERE g IS NOT NULL AND gt IS NOT NULL GROUP BY 1) SELECT gene_type, count(*) AS n FROM s1 JOIN gt USING (g) GROUP BY 1""")
def gene_type_counts(spark, d):
    b = blocks(spark, d)
    one = b.groupBy("template").agg(F.count_distinct("map_no").alias("k")).where("k = 1")
    g = I.gene_hits(b.join(one, "template", "left_semi"), features(spark, d)).groupBy("template").agg(F.count_distinct("gene_id").alias("h"), F.first("gene_id").alias("gene_id")).where("h = 1")
    kinds = features(spark, d).where("gene_id is not null and gene_type is not null").groupBy("gene_id").agg(F.min("gene_type").alias("gene_type"))
    return g.join(kinds, "gene_id").groupBy("gene_type").agg(F.count("*").alias("n"))


@query(f"""{_GENE}, nm AS (SELECT template FROM b GROUP BY 1 HAVING count(DISTINCT map_no) = 1), t AS (SELECT template, map_no, block_no, max((ft = 'exon')::INT) AS x, max((ft = 'intron')::INT) AS i, count(DISTINCT CASE WHEN ft = 'exon' THEN g END) AS xg FROM h GROUP BY ALL),
gn AS (SELECT template, map_no, count(DISTINCT g) AS gg FROM mk GROUP BY ALL),
p AS (SELECT b.template, b.map_no, string_agg(CASE WHEN x = 1 THEN 'exon' || CASE WHEN coalesce(gg, 0) <> 1 AND xg > 1 THEN '_mg' ELSE '' END WHEN i = 1 THEN 'intron' WHEN x IS NOT NULL THEN 'unknown' ELSE 'na' END, '^' ORDER BY b.block_no) AS pattern
  FROM b JOIN nm ON nm.template = b.template LEFT JOIN t ON t.template = b.template AND t.map_no = b.map_no AND t.block_no = b.block_no LEFT JOIN gn ON gn.template = b.template AND gn.map_no = b.map_no GROUP BY ALL)
SELECT pattern, count(*) AS n FROM p GROUP BY 1""")
def type_patterns(spark, d):
    return I.type_patterns(materialize(single_blocks(spark, d)), features(spark, d))


@query(f"""WITH {BLOCKS}, {FEATURES}, l AS (SELECT map_id, seq_name, lag(en) OVER (PARTITION BY map_id ORDER BY s, block_no) AS le, s AS ri FROM b), j AS (SELECT row_number() OVER () AS id, * FROM l WHERE le IS NOT NULL),
x AS (SELECT * FROM f WHERE ft = 'exon' AND tr IS NOT NULL), a AS (SELECT DISTINCT id, tr FROM j JOIN x ON seq_name = fq AND le BETWEEN fs AND fe), z AS (SELECT DISTINCT id, tr FROM j JOIN x ON seq_name = fq AND ri BETWEEN fs AND fe)
SELECT (SELECT count(*) FROM j) AS n_junctions, (SELECT count(DISTINCT a.id) FROM a JOIN z ON a.id = z.id AND a.tr = z.tr) AS n_annotated""")
def annotated_junctions(spark, d):
    return I.annotated_junctions(blocks(spark, d), features(spark, d))


_CLASSES = " UNION ALL ".join(f"SELECT {i} AS cls, {lo} AS lo, {hi if hi is not None else 1 << 60} AS hi" for i, (lo, hi) in enumerate(I.LENGTH_CLASSES))


@query(f"""WITH {BLOCKS}, e0 AS ({_FX}), e1 AS (SELECT *, coalesce(sum(end_pos - start_pos + 1) OVER (PARTITION BY transcript_id ORDER BY start_pos, end_pos, ann_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  sum(end_pos - start_pos + 1) OVER (PARTITION BY transcript_id) AS tl FROM e0), ex AS (SELECT seq_name AS fq, start_pos AS fs, end_pos AS fe, strand AS fst, CAST(off AS DOUBLE) AS off, CAST(tl AS DOUBLE) AS tl FROM e1 WHERE tl > 100),
h AS (SELECT s, en, fs, fe, fst, off, tl, CAST(fe - fs + 1 AS DOUBLE) AS n FROM b JOIN ex ON seq_name = fq AND {HIT} WHERE en > s),
r AS (SELECT *, floor(greatest(s - fs, 0) / n * 100.0 - 0.5) AS q0, floor(least(s - fs + en - s, n) / n * 100.0 - 0.5) AS q1 FROM h),
t AS (SELECT *, CASE WHEN fst = '-' THEN 99 - q1 ELSE q0 END AS u0, CASE WHEN fst = '-' THEN 99 - q0 ELSE q1 END AS u1, greatest(floor(CASE WHEN fst = '-' THEN tl - off - n ELSE off END / tl * 100.0 - 0.5), 0) AS base FROM r WHERE q0 BETWEEN 0 AND 99 AND q1 >= q0 AND q1 < 100),
v AS (SELECT tl, CAST(floor(n / tl * u0 + base) AS BIGINT) AS b0, CAST(floor(n / tl * u1 + base) AS BIGINT) AS b1 FROM t), w2 AS (SELECT * FROM v WHERE b0 BETWEEN 0 AND 99 AND b1 >= b0 AND b1 < 100)
SELECT CAST(cls AS INT) AS length_class, bucket, count(*) AS n FROM (SELECT cls, unnest(range(b0, b1 + 1)) AS bucket FROM w2 JOIN ({_CLASSES}) c ON (cls = 0 OR (tl > lo AND tl <= hi))) GROUP BY ALL""")
def gene_body_coverage(spark, d):
    return I.gene_body_coverage(blocks(spark, d), features(spark, d))


@query(f"""{_GENE} SELECT DISTINCT template FROM mk WHERE g = (SELECT g FROM mk GROUP BY g ORDER BY count(*) DESC, g LIMIT 1)""")
def region_filter(spark, d):
    """Reads that hit the gene with most mappings."""
    g = I.gene_hits(blocks(spark, d), features(spark, d))
    top = g.groupBy("gene_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gene_id").limit(1).select("gene_id")
    return g.join(top, "gene_id", "left_semi").select("template").distinct()


@query(f"""{_TGENE}, gc AS (SELECT line_id, map_no, count(DISTINCT g) AS genes FROM mk GROUP BY ALL), x AS (SELECT m.*, coalesce(genes, 0) > 1 AS ok FROM m LEFT JOIN gc ON gc.line_id = m.line_id AND gc.map_no = m.map_no),
s AS (SELECT line_id, coalesce(string_agg(txt, ',' ORDER BY map_no) FILTER (WHERE ok), string_agg(txt, ',' ORDER BY map_no)) AS maps FROM x GROUP BY 1) SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN s ON s.line_id = t.line_id""")
def reduce_by_gene_id(spark, d):
    return _txt(I.reduce_by_annotation(templates(spark, d), features(spark, d), "line_id", by_gene=True))


@query(f"""WITH {TBLOCKS}, {FEATURES}, c AS (SELECT DISTINCT line_id, map_no FROM (SELECT line_id, map_no, seq, s, en FROM tb WHERE bno = 0) x JOIN f ON seq = fq AND gt = 'protein_coding' AND {HIT}),
k AS (SELECT m.line_id, string_agg(txt, ',' ORDER BY m.map_no) AS maps, string_agg(CASE WHEN c.line_id IS NOT NULL THEN txt END, ',' ORDER BY m.map_no) AS coding FROM m LEFT JOIN c ON c.line_id = m.line_id AND c.map_no = m.map_no GROUP BY 1)
SELECT t.line_id, coalesce(coding, maps, '-') AS maps FROM tpl t LEFT JOIN k ON k.line_id = t.line_id""")
def reduce_to_protein_coding(spark, d):
    return _txt(I.reduce_by_annotation(templates(spark, d), features(spark, d), "line_id", protein_coding=True))


@query(f"""WITH {TBLOCKS}, {FEATURES}, l AS (SELECT line_id, map_no, seq, lag(en) OVER (PARTITION BY line_id, map_no ORDER BY s, bno) AS le, s AS ri FROM tb), j AS (SELECT row_number() OVER () AS id, * FROM l WHERE le IS NOT NULL),
x AS (SELECT * FROM f WHERE ft = 'exon' AND tr IS NOT NULL), z AS (SELECT DISTINCT j.id FROM j JOIN x ON j.seq = x.fq AND le BETWEEN x.fs AND x.fe JOIN x y ON j.seq = y.fq AND ri BETWEEN y.fs AND y.fe AND x.tr = y.tr),
r AS (SELECT line_id, map_no, count(z.id)::DOUBLE / count(*) AS ratio FROM j LEFT JOIN z ON z.id = j.id GROUP BY ALL), q AS (SELECT m.line_id, m.map_no, txt, coalesce(ratio, 0) AS ratio, max(coalesce(ratio, 0)) OVER (PARTITION BY m.line_id) AS best FROM m LEFT JOIN r ON r.line_id = m.line_id AND r.map_no = m.map_no),
s AS (SELECT line_id, coalesce(string_agg(txt, ',' ORDER BY map_no) FILTER (WHERE ratio <= 0 OR ratio = best), string_agg(txt, ',' ORDER BY map_no)) AS maps FROM q GROUP BY 1) SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN s ON s.line_id = t.line_id""")
def reduce_by_junctions(spark, d):
    return _txt(I.reduce_by_annotation(templates(spark, d), features(spark, d), "line_id", by_junctions=True))


# ---- junctions ------------------------------------------------------------------------------------------------------


@query(f"""WITH x AS ({_FX}), l AS (SELECT *, lag(end_pos) OVER w AS pe, lag(seq_name) OVER w AS ps FROM x WINDOW w AS (PARTITION BY transcript_id ORDER BY start_pos, end_pos, ann_id))
SELECT DISTINCT seq_name AS seq1, strand AS strand1, CASE WHEN strand IS DISTINCT FROM '-' AND strand IS NOT NULL THEN pe ELSE start_pos END AS pos1, seq_name AS seq2, strand AS strand2, CASE WHEN strand IS DISTINCT FROM '-' AND strand IS NOT NULL THEN start_pos ELSE pe END AS pos2 FROM l WHERE ps = seq_name""")
def junction_sites(spark, d):
    return J.from_annotation(features(spark, d))


_DN = f"""WITH {BLOCKS}, l AS (SELECT seq_name, lag(en) OVER (PARTITION BY map_id ORDER BY s, block_no) AS "left", s AS "right" FROM b), dn AS (SELECT seq_name, "left", "right", count(*) AS support FROM l WHERE "left" IS NOT NULL GROUP BY ALL)"""


_SITES = f"""x AS ({_FX}), la AS (SELECT *, seq_name AS seq1, lag(end_pos) OVER w AS pe, lag(seq_name) OVER w AS ps FROM x WINDOW w AS (PARTITION BY transcript_id ORDER BY start_pos, end_pos, ann_id)),
lm AS (SELECT *, lag(end_pos) OVER w AS mpe, lag(seq_name) OVER w AS mps FROM x WHERE strand = '-' WINDOW w AS (PARTITION BY transcript_id ORDER BY start_pos, end_pos, ann_id)),
st AS (SELECT DISTINCT seq_name AS q, unnest([mpe, start_pos]) AS p FROM lm WHERE mps = seq_name)"""


@query(f"{_DN} SELECT * FROM dn")
def junction_denovo(spark, d):
    return J.from_mappings(blocks(spark, d), ["map_id"])


@query(f"""{_DN}, {_SITES}, al AS (SELECT seq_name, "left", "right", support FROM dn UNION ALL SELECT seq1, pe, start_pos, count(*) FROM la WHERE ps = seq_name GROUP BY ALL), ff AS (SELECT seq_name, "left", "right", CAST(sum(support) AS BIGINT) AS support FROM al GROUP BY ALL)
SELECT ff.*, (seq_name, "left") IN (SELECT (q, p) FROM st) OR (seq_name, "right") IN (SELECT (q, p) FROM st) AS known FROM ff WHERE support >= 2 OR (seq_name, "left") IN (SELECT (q, p) FROM st) OR (seq_name, "right") IN (SELECT (q, p) FROM st)""")
def novel_junction_support(spark, d):
    """Junctions of split mappings and of transcripts that two of them support, or with a side at an annotated site."""
    f = features(spark, d)
    own = J.from_mappings(blocks(spark, d), ["map_id"]).unionByName(J.transcript_junctions(f))
    found = own.groupBy("seq_name", "left", "right").agg(F.sum("support").alias("support"))
    return J.supported(found, J.from_annotation(f.where("strand = '-'")), 2)


@query(f"""{_DN}, {_SITES}, s AS (SELECT seq1, least(pe, start_pos) AS pos1, greatest(pe, start_pos) AS pos2 FROM la WHERE ps = seq_name UNION SELECT seq_name, "left", "right" FROM dn)
SELECT * FROM s WHERE pos2 - pos1 BETWEEN 50 AND 2000""")
def junction_union(spark, d):
    """Junctions of the annotation and of split mappings, each once, of 50 to 2,000 bases."""
    mine = J.from_mappings(blocks(spark, d), ["map_id"]).select(F.col("seq_name").alias("seq1"), F.lit("+").alias("strand1"), F.col("left").alias("pos1"), F.col("seq_name").alias("seq2"), F.lit("+").alias("strand2"), F.col("right").alias("pos2"))
    x = J.by_distance(J.union(J.normal(J.from_annotation(features(spark, d))), J.normal(mine)), 50, 2000)
    return x.select("seq1", "pos1", "pos2").distinct()


# ---- coverage -------------------------------------------------------------------------------------------------------


def _runs(spark, d):
    return V.depth_runs(blocks(spark, d), "seq_name", "b_start", "b_end")


_RUNS = f"""WITH {BLOCKS}, e AS (SELECT seq_name, s AS p, 1 AS d FROM b WHERE s <= en UNION ALL SELECT seq_name, en + 1, -1 FROM b WHERE s <= en), g AS (SELECT seq_name, p, sum(d) AS d FROM e GROUP BY ALL),
r AS (SELECT seq_name, p AS start_pos, lead(p) OVER (PARTITION BY seq_name ORDER BY p) - 1 AS end_pos, CAST(sum(d) OVER (PARTITION BY seq_name ORDER BY p) AS BIGINT) AS depth FROM g), runs AS (SELECT * FROM r WHERE depth > 0)"""


@query(f"{_RUNS} SELECT * FROM runs")
def coverage_depth(spark, d):
    return _runs(spark, d)


@query(f"""{_RUNS}, h AS (SELECT depth, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS bases FROM runs GROUP BY 1)
SELECT depth, bases, round(bases / sum(bases) OVER (), 9) AS fraction, round(sum(bases) OVER (ORDER BY depth) / sum(bases) OVER (), 9) AS cumulative FROM h""")
def coverage_hist(spark, d):
    return V.histogram(_runs(spark, d)).withColumn("fraction", F.round("fraction", 9)).withColumn("cumulative", F.round("cumulative", 9))


@query(f"""{_RUNS}, c AS (SELECT seq_name, sum(end_pos - start_pos + 1) AS cv, sum((end_pos - start_pos + 1) * depth) AS bs FROM runs GROUP BY 1)
SELECT q.seq_name, CAST(coalesce(cv, 0) AS BIGINT) AS covered, seq_length AS total, round(coalesce(bs, 0) / seq_length, 9) AS mean_depth FROM ref_sequences q LEFT JOIN c ON c.seq_name = q.seq_name""")
def contig_summary(spark, d):
    return V.per_sequence(_runs(spark, d), table(spark, d, "ref_sequences")).withColumn("mean_depth", F.round("mean_depth", 9))


@query(f"""{_RUNS}, x AS (SELECT target_id, least(end_pos, te) - greatest(start_pos, ts) + 1 AS n, depth FROM runs JOIN (SELECT target_id, seq_name AS tq, start_pos AS ts, end_pos AS te FROM targets) t ON seq_name = tq AND start_pos <= te AND end_pos >= ts)
SELECT target_id, CAST(sum(n) AS BIGINT) AS covered, CAST(sum(n * depth) AS BIGINT) AS bases FROM x GROUP BY 1""")
def coverage_targets(spark, d):
    return V.on_targets(_runs(spark, d), targets(spark, d))


@query(f"""{_RUNS}, x AS (SELECT *, unnest(range(start_pos // 1000, end_pos // 1000 + 1)) AS bin FROM runs) SELECT seq_name, bin, CAST(sum((least(end_pos, bin * 1000 + 999) - greatest(start_pos, bin * 1000) + 1) * depth) AS BIGINT) AS bases FROM x GROUP BY ALL""")
def coverage_bins(spark, d):
    return V.binned(_runs(spark, d), 1000)


@query("""WITH iv AS (SELECT seq_name, start_pos, end_pos FROM targets WHERE start_pos <= end_pos UNION ALL SELECT seq_name, start_pos, end_pos FROM (SELECT DISTINCT ann_id, seq_name, start_pos, end_pos FROM annotations WHERE feature_type = 'exon' AND start_pos <= end_pos)),
e AS (SELECT seq_name, start_pos AS p, 1 AS d FROM iv UNION ALL SELECT seq_name, end_pos + 1, -1 FROM iv), g AS (SELECT seq_name, p, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0),
r AS (SELECT seq_name, p, CAST(sum(d) OVER (PARTITION BY seq_name ORDER BY p) AS BIGINT) AS depth, lead(p) OVER (PARTITION BY seq_name ORDER BY p) - 1 AS q FROM g) SELECT seq_name, CAST(sum(depth * (q - p + 1)) AS BIGINT) AS bases, max(depth) AS top FROM r WHERE depth > 0 GROUP BY 1""")
def coverage_combine(spark, d):
    """Coverage of the targets and of the exons, added up."""
    r = V.depth_runs(targets(spark, d), "seq_name", "start_pos", "end_pos")
    x = V.depth_runs(features(spark, d).where("feature_type = 'exon'").select("ann_id", "seq_name", "start_pos", "end_pos").distinct(), "seq_name", "start_pos", "end_pos")
    c = V.combine(r, x)
    return c.groupBy("seq_name").agg(F.sum(F.col("depth") * (F.col("end_pos") - F.col("start_pos") + 1)).alias("bases"), F.max("depth").alias("top"))


# ---- pairs and scores -----------------------------------------------------------------------------------------------

def _pairs(spark, d):
    x = mapped(spark, d, "tag", "end_no").withColumn("m", F.struct(F.col("map_id"), F.col("m.seq_name"), F.col("m.strand"), F.col("m.pos"), F.col("m.score"), F.col("m.blocks")))
    return R.pair_ends(x.where("end_no = 1"), x.where("end_no = 2"), 0, 20_000)


@query(f"{_PAIR} SELECT tag, id1, id2, insert_size FROM pairs")
def pairing_join(spark, d):
    return _pairs(spark, d).select("tag", F.col("m1.map_id").alias("id1"), F.col("m2.map_id").alias("id2"), "insert_size")


@query(f"{_PAIR} SELECT id1, id2 FROM pairs WHERE (CASE s1 WHEN '+' THEN 'F' ELSE 'R' END) || (CASE s2 WHEN '+' THEN 'F' ELSE 'R' END) = 'FR' AND insert_size BETWEEN 100 AND 5000")
def pair_strand_filter(spark, d):
    x = _pairs(spark, d).withColumn("strand1", F.col("m1.strand")).withColumn("strand2", F.col("m2.strand"))
    return P.insert_sizes(P.pair_strands(x, ["FR"]), 100, 5000).select(F.col("m1.map_id").alias("id1"), F.col("m2.map_id").alias("id2"))


@query(f"{_PAIR} SELECT id1, id2, CASE WHEN lo1 <= lo2 THEN greatest(hi1, hi2) - lo1 + 1 ELSE -(greatest(hi1, hi2) - lo2 + 1) END AS tlen FROM pairs")
def template_size(spark, d):
    a, b = F.col("m1.blocks"), F.col("m2.blocks")
    x = _pairs(spark, d)
    return x.select(F.col("m1.map_id").alias("id1"), F.col("m2.map_id").alias("id2"), M.observed_template_size(F.col("m1.seq_name"), a, F.col("m2.seq_name"), b).alias("tlen"))


def _paired_text(spark, d):
    """Pairs found by insert size, written as paired MAP records with reads of dots' length."""
    x = _pairs(spark, d)
    text = lambda m: F.concat_ws(":", F.col(f"{m}.seq_name"), F.col(f"{m}.strand"), F.col(f"{m}.pos").cast("string"), M.render_edits(F.col(f"{m}.blocks")))
    read = lambda m: F.expr(f"repeat('A', cast(aggregate({m}.blocks, 0L, (a, b) -> a + b.base_length) as int))")
    line = F.concat_ws("\t", "tag", F.concat(read("m1"), F.lit(" "), read("m2")), F.lit("1"), F.concat(text("m1"), F.lit("::"), text("m2"), F.lit(":::7")))
    x = computed(x, "value", line)
    return Q2.from_map_lines(x.select(F.col("m1.map_id").alias("id1"), F.col("m2.map_id").alias("id2"), "value"), keep=("id1", "id2"))


@query(f"""{_PAIR} SELECT id1, id2, (CASE s1 WHEN '+' THEN 'F' ELSE 'R' END) || (CASE s2 WHEN '+' THEN 'F' ELSE 'R' END) AS strands, insert_size, a.dist + z.dist AS distance, CAST(l1 AS INT) AS n1, CAST(l2 AS INT) AS n2, CAST(7 AS BIGINT) AS score FROM pairs JOIN w a ON a.map_id = id1 JOIN w z ON z.map_id = id2""")
def paired_templates(spark, d):
    p = F.col("mmaps")[0]
    return _paired_text(spark, d).select("id1", "id2", Q2.strands(p).alias("strands"), Q2.insert_size(p).alias("insert_size"), Q2.distance(p).alias("distance"), F.length(F.col("reads")[0]).alias("n1"), F.length(F.col("reads")[1]).alias("n2"), p["score"].alias("score"))


@query(f"""{_PAIR} SELECT (CASE s1 WHEN '+' THEN 'F' ELSE 'R' END) || (CASE s2 WHEN '+' THEN 'F' ELSE 'R' END) AS strands, count(*) AS n FROM pairs GROUP BY 1""")
def pair_strand_counts(spark, d):
    letter = lambda m: F.when(F.col(f"{m}.strand") == "+", "F").otherwise("R")
    return _pairs(spark, d).groupBy(F.concat(letter("m1"), letter("m2")).alias("strands")).agg(F.count("*").alias("n"))


@query(f"{_PAIR} SELECT id1, id2 FROM pairs WHERE insert_size BETWEEN 200 AND 9000 AND s1 = '+'")
def reduce_to_pairs(spark, d):
    x = Q2.reduce_to_pairs(Q2.insert_between(Q2.on_strands(_paired_text(spark, d), ["FR"]), 200, 9000))
    return x.where(F.size("mmaps") > 0).select("id1", "id2")


_PSAM = f"""{_PAIR}, k0 AS (SELECT map_id, unnest(regexp_extract_all(e, '{E}')) AS t, generate_subscripts(regexp_extract_all(e, '{E}'), 1) AS i FROM w),
k1 AS (SELECT *, right(t, 1) AS c, CASE WHEN regexp_matches(t, '^[A-Z]') THEN 1 ELSE CAST(regexp_extract(t, '[0-9]+') AS BIGINT) END AS n, coalesce(sum((right(t, 1) = '*')::INT) OVER (PARTITION BY map_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM k0),
k3 AS (SELECT *, coalesce(sum(CASE WHEN c IN ('+', '*') THEN 0 ELSE n END) OVER (PARTITION BY map_id, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ap, sum(CASE WHEN c IN ('+', '*') THEN 0 ELSE n END) OVER (PARTITION BY map_id, part) AS total FROM k1),
k4 AS (SELECT *, CASE WHEN c = '*' THEN 'N' WHEN c = '+' THEN 'D' WHEN c NOT IN ('-', ')') THEN 'M' WHEN ap = 0 OR ap + n = total THEN 'S' ELSE 'I' END AS o FROM k3 WHERE n > 0 OR c IN ('-', ')', '+', '*')),
k5 AS (SELECT *, sum((o <> 'M')::INT) OVER (PARTITION BY map_id ORDER BY i) AS isl FROM k4), k6 AS (SELECT map_id, o, min(i) AS i, CAST(sum(n) AS BIGINT) AS n FROM k5 GROUP BY map_id, isl, o, part, CASE WHEN o <> 'M' THEN i END),
cg AS (SELECT map_id, CASE WHEN any_value(strand) = '-' THEN string_agg(n || o, '' ORDER BY i DESC) ELSE string_agg(n || o, '' ORDER BY i) END AS cigar FROM k6 JOIN (SELECT map_id AS w_id, strand FROM w) ON w_id = map_id GROUP BY 1),
en AS (SELECT tag, id1 AS own, id2 AS mate, s1 AS st, s2 AS mst, lo1 AS lo, lo2 AS mlo, hi1, hi2, l1 AS len, 64 AS bit FROM pairs UNION ALL SELECT tag, id2, id1, s2, s1, lo2, lo1, hi1, hi2, l2, 128 FROM pairs)
SELECT concat_ws(chr(9), split_part(tag, ' ', 1), 3 + CASE WHEN st = '-' THEN 16 ELSE 0 END + CASE WHEN mst = '-' THEN 32 ELSE 0 END + bit, a.seq_name, a.pos, 254, cigar, '=', z.pos, CASE WHEN lo <= mlo THEN greatest(hi1, hi2) - lo + 1 ELSE -(greatest(hi1, hi2) - mlo + 1) END,
  repeat(CASE WHEN st = '-' THEN 'T' ELSE 'A' END, CAST(len AS INT)), '*') AS value FROM en JOIN (SELECT map_id AS i1, seq_name, pos FROM w) a ON i1 = own JOIN (SELECT map_id AS i2, pos FROM w) z ON i2 = mate JOIN cg ON cg.map_id = own"""


@query(_PSAM)
def paired_sam(spark, d):
    return Q2.sam_lines(_paired_text(spark, d))


@query(f"""{_PAIR}, o AS (SELECT *, greatest(lo1, lo2) AS f, CASE WHEN lo1 <= lo2 THEN lo1 + g1 ELSE lo2 + g2 END AS t FROM pairs)
SELECT id1, id2 FROM o WHERE (len(j1) = 0 AND len(j2) = 0) OR t < f OR (len(list_filter(j1, lambda x: x.e >= f AND x.s <= t)) = len(list_filter(j2, lambda x: x.e >= f AND x.s <= t)) AND len(list_filter(j1, lambda x: x.s >= f AND x.s < t AND NOT list_contains(j2, x))) = 0)""")
def pair_coherence(spark, d):
    """Pairs whose ends agree on the junctions where they overlap; those without splices always do."""
    return P.coherent_pairs(_pairs(spark, d)).select(F.col("m1.map_id").alias("id1"), F.col("m2.map_id").alias("id2"))


@query(f"""WITH {ROWS}, p AS (SELECT a.tag, a.strand AS s1, z.strand AS s2 FROM w a JOIN w z ON a.tag = z.tag AND a.end_no = 1 AND z.end_no = 2 AND a.seq_name = z.seq_name),
k AS (SELECT tag, count(*) FILTER (WHERE end_no = 1) AS n1, count(*) FILTER (WHERE end_no = 2) AS n2 FROM w GROUP BY 1)
SELECT CASE WHEN n1 = 0 OR n2 = 0 THEN 'single' WHEN n1 = 1 AND n2 = 1 THEN 'unique pair' ELSE 'ambiguous pair' END AS kind, count(*) AS n FROM k GROUP BY 1""")
def pair_types(spark, d):
    e = F.col("end_no")
    k = rows(spark, d, "tag", "end_no", "maps").where("maps <> '-'").groupBy("tag").agg(F.sum((e == 1).cast("bigint")).alias("n1"), F.sum((e == 2).cast("bigint")).alias("n2"))
    kind = F.when((F.col("n1") == 0) | (F.col("n2") == 0), "single").when((F.col("n1") == 1) & (F.col("n2") == 1), "unique pair").otherwise("ambiguous pair")
    return k.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {ROWS}, s AS (SELECT map_id, coalesce(gt_score, 0) % 65536 AS a, coalesce(phred_score, 0) AS c FROM u)
SELECT map_id, a | (a << 16) | (CAST(c AS BIGINT) << 32) AS packed, a AS end1, a AS end2, CAST(c AS BIGINT) AS ins FROM s""")
def score_packing(spark, d):
    a = F.coalesce(F.col("gt_score"), F.lit(0).cast("bigint")) % 65536
    x = rows(spark, d, "gt_score", "phred_score").select("map_id", R.pack(a, a, F.coalesce("phred_score", F.lit(0))).alias("packed"))
    u = R.unpack(F.col("packed"))
    return x.select("map_id", "packed", u["end1"].alias("end1"), u["end2"].alias("end2"), u["insert"].alias("ins"))


@query(f"""WITH {ROWS}, o AS (SELECT tag, end_no, seq_name, pos, min(gt_score % 65536) AS s FROM w WHERE gt_score IS NOT NULL GROUP BY ALL), q AS (SELECT *, min(s) OVER (PARTITION BY tag, end_no) AS lo FROM o),
e AS (SELECT *, power(10.0, -(s - lo) / 10.0) AS e FROM q), z AS (SELECT *, count(*) FILTER (WHERE s = lo) OVER p AS k, coalesce(sum(e) FILTER (WHERE s > lo) OVER p, 0) AS t FROM e WINDOW p AS (PARTITION BY tag, end_no)),
y AS (SELECT *, CASE WHEN s = lo THEN (k - 1 + t) / (k + t) ELSE 1 - e / (k + t) END AS rest FROM z)
SELECT tag, end_no, seq_name, pos, CASE WHEN rest < 1e-255 THEN 254 ELSE CAST(least(floor(0.5 - 10 * log10(rest)), 254) AS INT) END AS phred FROM y""")
def mapq_softmax(spark, d):
    x = rows(spark, d, "tag", "end_no", "seq_name", "pos", "gt_score", "maps").where("maps <> '-' and gt_score is not null").withColumn("s", F.col("gt_score") % 65536)
    return R.mapping_quality(x, ["tag", "end_no"], ["seq_name", "pos"], "s")


@query(f"""WITH {ROWS}, h AS (SELECT abs(tlen) AS x, count(*) AS y FROM u WHERE tlen <> 0 GROUP BY 1), c AS (SELECT *, sum(y) OVER (ORDER BY x) AS z, sum(y) OVER () AS t FROM h)
SELECT x, y, CAST(least(floor(-10 * log10(y / t) + 0.5), 255) AS BIGINT) AS phred FROM c WHERE z >= t * 0.01 AND z < t * 0.99""")
def insert_quantiles(spark, d):
    h = rows(spark, d, "tlen").where("tlen <> 0").groupBy(F.abs("tlen").alias("x")).agg(F.count("*").alias("y"))
    return R.insert_cuts(h, 0.01)


@query(rf"""WITH {MAPS}, t AS (SELECT line_id, map_no, unnest(regexp_extract_all(e, '\([0-9]+\)|[0-9]+|[ACGTN]|>[0-9]+[-+*]')) AS t, generate_subscripts(regexp_extract_all(e, '\([0-9]+\)|[0-9]+|[ACGTN]|>[0-9]+[-+*]'), 1) AS i FROM m),
o AS (SELECT *, right(t, 1) AS c, coalesce(TRY_CAST(regexp_extract(t, '[0-9]+') AS BIGINT), 1) AS n, sum((right(t, 1) = '*')::INT) OVER (PARTITION BY line_id, map_no ORDER BY i) AS part FROM t),
a AS (SELECT *, coalesce(sum(CASE WHEN c IN ('+', '*') THEN 0 ELSE n END) OVER (PARTITION BY line_id, map_no, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ap FROM o),
k AS (SELECT a.line_id, map_no, sum(CASE WHEN regexp_full_match(t, '[ACGTN]') THEN CASE WHEN q IS NULL OR q = '' THEN 30 ELSE least(greatest(ascii(substr(q, CAST(ap AS BIGINT) + 1, 1)) - 33, 0), 42) END WHEN c IN ('+', '-', ')') THEN 40 ELSE 0 END) AS sc FROM a JOIN tpl USING (line_id) GROUP BY ALL)
SELECT line_id, CAST(map_no AS INT) AS map_no, CAST(least(sc, 65535) AS BIGINT) AS score FROM k""")
def distance_scores(spark, d):
    x = T.map_rows(templates(spark, d), ("line_id", "quals"))
    return x.select("line_id", "map_no", R.distance_score(F.col("m.blocks"), F.col("quals")).alias("score"))


@query("SELECT seq_name, seq_length, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(seq_name, '([0-9]+)', 1) AS BIGINT), 9223372036854775807), seq_name) AS rank FROM ref_sequences")
def karyotypic_sort(spark, d):
    """Sequences by the number in their name, then by name; ranked over all partitions."""
    n = F.coalesce(F.regexp_extract("seq_name", "([0-9]+)", 1).try_cast("bigint"), F.lit((1 << 63) - 1))
    x = U.rank_within(table(spark, d, "ref_sequences").select("seq_name", "seq_length", n.alias("_n")), [], ["_n", "seq_name"])
    return x.select("seq_name", "seq_length", (F.col("row_no") + 1).alias("rank"))
