"""Queries of paired ends: gene counts, sets, leftovers and classes of pairs; and of SAM records put together to templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.functions import mapping as M
from readloom.operators import intervals as I
from readloom.operators import pairs as P
from readloom.operators import setops as U
from readloom.operators import stats as A
from readloom.operators import templates as T
from readloom.plans import map_queries as Q
from readloom.plans.read_queries import templates
from readloom.plans.runtime import materialize, table
from readloom.plans.sqltext import BLOCKS, FEATURES, HIT, MAPS, PAIRS, ROWS, SETS, TPL
from readloom.sources import sinks, text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- gene counts of pairs -------------------------------------------------------------------------------------------


def _mated(spark, d):
    """Every mapping with a mate of the same shape 300 bases on: the table itself holds few ends that pair."""
    b = Q.blocks(spark, d).withColumn("n_ends", F.lit(2))
    return b.unionByName(b.withColumn("end_no", F.lit(2)).withColumn("b_start", F.col("b_start") + 300).withColumn("b_end", F.col("b_end") + 300))


def _both_lengths(spark, d):
    x = Q.mapped(spark, d, "tag", "end_no").select(F.concat_ws("/", "tag", "end_no").alias("template"), M.global_base_length(F.col("m.blocks")).alias("n"))
    return x.groupBy("template").agg((2 * F.max("n")).alias("bases"))


_PG = f"""WITH {BLOCKS}, {FEATURES}, b2 AS (SELECT template, map_no, 1 AS end_no, block_no, n_blocks, seq_name, s, en FROM b UNION ALL SELECT template, map_no, 2, block_no, n_blocks, seq_name, s + 300, en + 300 FROM b),
h AS (SELECT template, map_no, end_no, block_no, n_blocks, s, en, ft, fs, fe, g FROM b2 JOIN f ON seq_name = fq AND {HIT}),
bg AS (SELECT template, map_no, end_no, block_no, n_blocks, g, max((ft = 'exon')::INT) AS x, sum((ft = 'exon' AND (s = fs OR s = fe OR en = fe OR en = fs))::INT) AS j FROM h WHERE g IS NOT NULL GROUP BY ALL),
ba AS (SELECT *, max(x) OVER (PARTITION BY template, map_no, end_no, block_no) AS anyx FROM bg), mg AS (SELECT template, map_no, end_no, n_blocks, g, count(*) AS cnt, sum(j) AS j, max(x) AS x FROM ba WHERE x = anyx GROUP BY ALL),
mw AS (SELECT *, count(*) OVER (PARTITION BY template, map_no, end_no) AS ng, coalesce(max(CASE WHEN cnt = n_blocks THEN j END) OVER (PARTITION BY template, map_no, end_no), 0) AS best FROM mg),
mk AS (SELECT template, map_no, end_no, g, x FROM mw WHERE ng = 1 OR (cnt = n_blocks AND (best = 0 OR j = best))),
pe AS (SELECT template, map_no, g, max((end_no = 1)::INT) AS in1, max((end_no = 2)::INT) AS in2, coalesce(max(x) FILTER (WHERE end_no = 1), 0) AS x1, coalesce(max(x) FILTER (WHERE end_no = 2), 0) AS x2 FROM mk GROUP BY ALL),
pa AS (SELECT *, max(in2) OVER (PARTITION BY template, map_no) AS any2 FROM pe), ok AS (SELECT * FROM pa WHERE in1 = 1 AND (in2 = 1 OR any2 = 0)),
tg AS (SELECT template, g, max(in1 + in2) AS w FROM ok GROUP BY ALL), th AS (SELECT template, count(*) AS hits FROM tg GROUP BY 1),
ln AS (SELECT tag || '/' || end_no AS template, CAST(2 * max(base_len) AS BIGINT) AS bases FROM w GROUP BY 1)"""


@query(f"{_PG} SELECT g AS gene_id, CAST(2 * count(*) AS DOUBLE) AS n FROM tg JOIN th USING (template) WHERE hits = 1 GROUP BY g")
def gene_counts_paired(spark, d):
    return I.gene_counts(_mated(spark, d), Q.features(spark, d), paired=True)


@query(f"{_PG} SELECT g AS gene_id, CAST(sum(w) AS DOUBLE) AS n FROM tg JOIN th USING (template) WHERE hits = 1 GROUP BY g")
def gene_counts_paired_ends(spark, d):
    """A pair counts the ends that hit."""
    return I.gene_counts(_mated(spark, d), Q.features(spark, d), paired=True, single_ends=True)


@query(f"{_PG} SELECT g AS gene_id, CAST(2 * count(*) AS DOUBLE) AS n FROM tg GROUP BY g")
def gene_counts_paired_multimap(spark, d):
    return I.gene_counts(_mated(spark, d), Q.features(spark, d), multi=True, paired=True)


@query(f"{_PG} SELECT g AS gene_id, round(sum(2.0 / hits), 6) AS n FROM tg JOIN th USING (template) GROUP BY g")
def gene_counts_paired_weighted(spark, d):
    return I.gene_counts(_mated(spark, d), Q.features(spark, d), multi=True, weighted=True, paired=True).withColumn("n", F.round("n", 6))


@query(f"""{_PG}, o AS (SELECT template, map_no, end_no, block_no, max(CASE WHEN ft = 'exon' AND g IS NOT NULL THEN (least(en, fe) - greatest(s, fs) + 1)::DOUBLE / (en - s + 1) END) AS o FROM h GROUP BY ALL),
bt AS (SELECT b2.template, b2.map_no, b2.end_no, en - s + 1 AS len, coalesce(o, 0) AS o FROM b2 LEFT JOIN o ON o.template = b2.template AND o.map_no = b2.map_no AND o.end_no = b2.end_no AND o.block_no = b2.block_no),
oe AS (SELECT template, map_no, end_no, sum(o * len) / sum(len) AS ov FROM bt GROUP BY ALL), ov AS (SELECT template, map_no, avg(ov) AS ov FROM oe GROUP BY ALL),
xk AS (SELECT DISTINCT template, g FROM ok JOIN ov USING (template, map_no) WHERE x1 + x2 > 0 AND ov >= 0.5 - 1e-6), xh AS (SELECT template, count(*) AS hits FROM xk GROUP BY 1)
SELECT g AS gene_id, CAST(2 * count(*) AS DOUBLE) AS n FROM xk JOIN xh USING (template) WHERE hits = 1 GROUP BY g""")
def gene_counts_paired_overlap(spark, d):
    return I.gene_counts(_mated(spark, d), Q.features(spark, d), exon_overlap=0.5, paired=True)


@query(f"{_PG} SELECT g AS gene_id, CAST(sum(CASE WHEN w = 2 THEN bases ELSE bases // 2 END) AS DOUBLE) AS n FROM tg JOIN th USING (template) JOIN ln USING (template) WHERE hits = 1 GROUP BY g")
def gene_counts_paired_bases(spark, d):
    """Bases in place of reads: all of a pair's, or half of them where one end hits."""
    return I.gene_counts(_mated(spark, d), Q.features(spark, d), paired=True, single_ends=True, lengths=_both_lengths(spark, d))


# ---- pairs and what found no partner --------------------------------------------------------------------------------


@query(f"""WITH {PAIRS}, m0 AS (SELECT tag, map_id, end_no FROM an)
SELECT tag, id1, id2, insert_size FROM pairs UNION ALL SELECT tag, map_id, NULL, NULL FROM m0 WHERE end_no = 1 AND map_id NOT IN (SELECT id1 FROM pairs) UNION ALL SELECT tag, NULL, map_id, NULL FROM m0 WHERE end_no = 2 AND map_id NOT IN (SELECT id2 FROM pairs)""")
def pair_reads(spark, d):
    """Pairs by insert size, and every mapping of either end that has none."""
    from readloom.operators import scoring as R

    x = Q.mapped(spark, d, "tag", "end_no").withColumn("m", F.struct(F.col("map_id"), F.col("m.seq_name"), F.col("m.strand"), F.col("m.pos"), F.col("m.score"), F.col("m.blocks")))
    y = R.pair_reads(x.where("end_no = 1"), x.where("end_no = 2"), 0, 20_000)
    return y.select("tag", F.col("m1.map_id").alias("id1"), F.col("m2.map_id").alias("id2"), "insert_size")


_UNIQ = "uq AS (SELECT tag, count(*) FILTER (WHERE end_no = 1) AS n1, count(*) FILTER (WHERE end_no = 2) AS n2 FROM w GROUP BY 1)"


@query(f"""WITH {ROWS}, {_UNIQ} SELECT CASE WHEN a.seq_name <> z.seq_name THEN 'MM' WHEN a.strand = z.strand THEN 'SS' ELSE 'DS' END AS kind, count(*) AS n
FROM uq JOIN w a ON a.tag = uq.tag AND a.end_no = 1 JOIN w z ON z.tag = uq.tag AND z.end_no = 2 WHERE n1 = 1 AND n2 = 1 GROUP BY 1""")
def pair_classes(spark, d):
    """Pairs of ends with one mapping each: on different strands or the same one of a sequence, or on two sequences."""
    return A.pair_classes(Q.rows(spark, d, "tag", "end_no", "seq_name", "strand", "maps").where("maps <> '-'"), "tag", "end_no", "seq_name", "strand")


@query(f"""WITH {SETS}, y AS (SELECT line_id, 0 AS src, map_no AS ord, txt || '::' || txt AS txt, 2 * dist AS dist FROM m UNION ALL SELECT line_id, 1, map_no, txt || '::', dist FROM m WHERE st = '+' UNION ALL SELECT line_id, 1, 1000000 + map_no, txt || '::' || txt, 2 * dist FROM m WHERE st = '-'),
kk AS (SELECT line_id, ord, key FROM a), z AS (SELECT y.*, CASE WHEN y.txt LIKE '%::' THEN key || '::' ELSE key || '::' || key END AS pk FROM y JOIN kk ON kk.line_id = y.line_id AND kk.ord = y.ord % 1000000),
u AS (SELECT line_id, src, ord, txt FROM z WHERE src = 0 UNION ALL SELECT line_id, src, ord, txt FROM z WHERE src = 1 AND NOT EXISTS (SELECT 1 FROM z o WHERE o.src = 0 AND o.line_id = z.line_id AND o.pk = z.pk)),
s AS (SELECT line_id, string_agg(txt, ',' ORDER BY src, ord) AS mmaps, count(*) AS k FROM u GROUP BY 1) SELECT t.line_id, coalesce(mmaps, '') AS mmaps FROM tpl t LEFT JOIN s ON s.line_id = t.line_id""")
def pair_union(spark, d):
    """Two sets of paired mappings over the same records: each mapping paired with itself; and those on + without a
    second end, those on - as before."""
    t = templates(spark, d)
    pair = lambda m, two: F.struct(F.concat(m["txt"], F.lit("::"), m["txt"] if two else F.lit("")).alias("txt"), m.alias("m1"), (m if two else F.when(F.lit(False), m)).alias("m2"), m["score"].alias("score"))
    first = t.withColumn("mmaps", F.transform("maps", lambda m: pair(m, True)))
    fwd, rev = F.filter("maps", lambda m: m["strand"] == "+"), F.filter("maps", lambda m: m["strand"] == "-")
    second = t.withColumn("mmaps", F.concat(F.transform(fwd, lambda m: pair(m, False)), F.transform(rev, lambda m: pair(m, True))))
    return U.pair_union(first, second, "line_id").select("line_id", F.array_join(F.transform("mmaps", lambda p: p["txt"]), ",").alias("mmaps"))


@query(f"""WITH {SETS}, c AS (SELECT a.*, length(r) // 10 AS tol FROM a JOIN tpl USING (line_id)),
s AS (SELECT line_id, string_agg(txt, ',' ORDER BY ord) AS maps FROM c WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.line_id = c.line_id AND o.seq = c.seq AND o.st = c.st AND len(o.ss) = len(c.ss) AND CASE WHEN len(c.ss) = 1 THEN abs(o.ss[1] - c.ss[1]) <= tol OR abs(o.es[1] - c.es[1]) <= tol
  ELSE len(list_filter(range(1, len(c.ss) + 1), lambda i: abs(o.ss[i] - c.ss[i]) > tol OR abs(o.es[i] - c.es[i]) > tol)) = 0 END) GROUP BY 1)
SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN s ON s.line_id = t.line_id""")
def set_difference_share(spark, d):
    """Equal within a tenth of the read."""
    return Q._txt(U.file_difference(templates(spark, d), Q._other(spark, d), "line_id", tolerance=0.1))


# ---- counters of reads ----------------------------------------------------------------------------------------------


@query(f"""WITH {TPL}, x AS (SELECT CASE WHEN ms = '-' THEN 0 ELSE len(string_split(ms, ',')) END AS k FROM tpl)
SELECT 1 AS ends, count(*) AS reads, count(*) FILTER (WHERE k = 0) AS unmapped, count(*) FILTER (WHERE k = 1) AS "unique", CAST(sum(k) AS BIGINT) AS mappings FROM x
UNION ALL SELECT 2, 2 * count(*), 2 * count(*) FILTER (WHERE k = 0), 2 * count(*) FILTER (WHERE k = 1), CAST(sum(k) AS BIGINT) FROM x""")
def read_counters(spark, d):
    """Reads, unmapped and unique ones and mappings; taken as single ends, and as pairs of the same mappings."""
    t = templates(spark, d)
    two = t.withColumn("mmaps", F.transform("maps", lambda m: F.struct(m.alias("m1"), m.alias("m2"))))
    return A.read_counters(t).withColumn("ends", F.lit(1)).unionByName(A.read_counters(two, "mmaps", 2).withColumn("ends", F.lit(2)))


_E = "CASE WHEN {v} = 0 THEN '0' " + " ".join(f"WHEN {{v}} <= floor({b} * (length(r) / 100.0)) THEN '{b}'" for b in A.ERRORS[1:]) + " ELSE 'more' END"


@query(f"""WITH {MAPS}, mj AS (SELECT m.*, r FROM m JOIN tpl USING (line_id)), jl AS (SELECT unnest(list_transform(regexp_extract_all(e, '>([0-9]+)[*]', 1), lambda x: CAST(x AS BIGINT))) AS v FROM m),
x AS (SELECT length(r) AS n, CASE WHEN ms = '-' THEN 0 ELSE len(string_split(ms, ',')) END AS k FROM tpl),
c AS (SELECT line_id, dist, count(*) AS n FROM m GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY dist) AS k, lead(dist) OVER (PARTITION BY line_id ORDER BY dist) AS nx FROM c),
uq AS (SELECT CASE WHEN n <> 1 THEN -1 ELSE coalesce(nx, dist + 1) - dist - 1 END AS u FROM o WHERE k = 1)
SELECT 'length' AS metric, {Q._case('n', A.LENGTHS)} AS bucket, count(*) AS value FROM x GROUP BY ALL UNION ALL SELECT 'multimaps', {Q._case('k', A.MULTIMAPS)}, count(*) FROM x GROUP BY ALL
UNION ALL SELECT 'uniqueness', CASE WHEN u < 0 THEN 'X' ELSE {Q._case('u', A.UNIQUENESS)} END, count(*) FROM uq GROUP BY ALL UNION ALL SELECT 'strand', st, count(*) FROM m GROUP BY ALL
UNION ALL SELECT 'junctions', {Q._case('njunc', A.JUNCTIONS)}, count(*) FROM m WHERE njunc > 0 GROUP BY ALL UNION ALL SELECT 'junction_length', {Q._case('v', A.JUNCTION_LENGTHS)}, count(*) FROM jl GROUP BY ALL
UNION ALL """ + " UNION ALL ".join(f"SELECT '{n}', {_E.format(v=v)}, count(*) FROM mj GROUP BY ALL" for n, v in (("mismatches", "mism"), ("levenshtein", "lev"), ("insertions", "ins"), ("deletions", "dels"), ("events", "dist"))))
def stats_profile(spark, d):
    """All profiles of templates and mappings in one pass."""
    return A.profile(templates(spark, d))


@query(f"""WITH {TPL}, x AS (SELECT CASE WHEN ms = '-' THEN '0' ELSE '1' END AS k FROM tpl), g AS (SELECT k, count(*) AS n FROM x GROUP BY 1)
SELECT 'multimaps' AS metric, k AS bucket, 'multimaps' || chr(9) || k || chr(9) || n || chr(9) || printf('%.2f%%', 100.0 * n / (SELECT sum(n) FROM g)) AS value FROM g""")
def stats_report(spark, d):
    """Text lines of a profile, here of first mappings only and two inputs put together of which one is empty."""
    t = templates(spark, d)
    p = A.merge(A.profile(t, first_only=True), A.profile(t.where("line_id is null")))
    return A.to_text_report(p).where("metric = 'multimaps'")


@query(f"""WITH {PAIRS} SELECT id1, id2 FROM pairs""")
def sink_paired_map(spark, d):
    """Pairs printed as paired MAP text and parsed again."""
    x = materialize(Q._paired_text(spark, d))
    lines = P.map_lines(x.withColumn("tag", F.concat_ws(" ", F.col("id1").cast("string"), F.col("id2").cast("string"))))
    y = P.from_map_lines(materialize(lines), "value").where(F.size("mmaps") == 1)
    part = lambda i: F.get(F.split("tag", " "), F.lit(i)).cast("bigint")
    return y.select(part(0).alias("id1"), part(1).alias("id2"))


# ---- SAM ------------------------------------------------------------------------------------------------------------


def _sam(spark, d):
    return text.sam_table(table(spark, d, "raw_records").where("file_kind = 'sam'").select(F.col("raw_line").alias("value")))


@query(r"""WITH c AS (SELECT string_split(raw_line, chr(9)) AS c FROM raw_records WHERE file_kind = 'sam' AND NOT regexp_matches(raw_line, '^@[A-Z]{2}\t')),
s AS (SELECT c[1] AS tag, CASE WHEN regexp_full_match(trim(c[2]), '[+-]?[0-9]+') THEN TRY_CAST(trim(c[2]) AS INT) END AS f, c[3] AS q, CASE WHEN regexp_full_match(trim(c[4]), '[+-]?[0-9]+') THEN TRY_CAST(trim(c[4]) AS BIGINT) END AS p, c[6] AS cg, c[10] AS sq, c[11] AS ql FROM c WHERE len(c) >= 11),
e AS (SELECT *, CASE WHEN f & 64 <> 0 THEN 1 WHEN f & 128 <> 0 THEN 2 ELSE 0 END AS en, f & 16 <> 0 AS rev, coalesce(f & 256 <> 0, true) AS sec FROM s),
r AS (SELECT tag, en, coalesce(max(CASE WHEN NOT sec AND sq <> '*' THEN CASE WHEN rev THEN reverse(translate(upper(sq), 'ACGTN', 'TGCAN')) ELSE upper(sq) END END), '') AS read, max(CASE WHEN NOT sec AND ql <> '*' THEN CASE WHEN rev THEN reverse(ql) ELSE ql END END) AS quals FROM e GROUP BY ALL),
m AS (SELECT DISTINCT tag, en, q || ':' || CASE WHEN rev THEN '-' ELSE '+' END || ':' || p AS pl, CAST(len(regexp_extract_all(cg, 'N')) AS BIGINT) AS sp FROM e WHERE f & 4 = 0 AND regexp_full_match(cg, '([0-9]+[MIDNSHP=X])+') AND p IS NOT NULL),
k AS (SELECT tag, en, count(*) AS n, string_agg(DISTINCT pl, ',' ORDER BY pl) AS places, CAST(sum(sp) AS BIGINT) AS splices FROM m GROUP BY ALL)
SELECT r.tag, r.en AS end_no, read, quals, coalesce(places, '') AS places, coalesce(splices, 0) AS splices FROM r LEFT JOIN k ON k.tag = r.tag AND k.en = r.en""")
def sam_templates(spark, d):
    t = text.sam_templates(_sam(spark, d))
    places = F.array_join(F.array_sort(F.array_distinct(F.transform("maps", lambda m: F.concat_ws(":", m["seq_name"], m["strand"], m["pos"].cast("string"))))), ",")
    return t.select("tag", "end_no", "read", "quals", places.alias("places"), F.aggregate("maps", F.lit(0).cast("bigint"), lambda a, m: a + F.size(m["blocks"]) - 1).alias("splices"))


@query(f"""WITH {PAIRS}, s AS (SELECT split_part(tag, ' ', 1) AS qname, seq_name AS q, a.pos AS p1, z.pos AS p2 FROM pairs JOIN (SELECT map_id AS i1, pos FROM w) a ON i1 = id1 JOIN (SELECT map_id AS i2, pos FROM w) z ON i2 = id2)
SELECT a.qname, a.q AS rname1, a.p1 AS pos1, b.q AS rname2, b.p2 AS pos2 FROM s a JOIN s b ON a.qname = b.qname AND a.q = b.q AND a.p1 = b.p1 AND a.p2 = b.p2""")
def sam_mates(spark, d):
    """Pairs written as SAM, read back and matched by what each end says of its mate."""
    lines = P.sam_lines(Q._paired_text(spark, d))
    return text.solve_mates(text.sam_table(lines)).drop("blocks1", "blocks2")


@query(f"""WITH {MAPS}, c AS (SELECT line_id, dist, count(*) AS n FROM m GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY dist) AS k, lead(dist) OVER (PARTITION BY line_id ORDER BY dist) AS nx, sum(n) OVER (PARTITION BY line_id) AS tot FROM c),
u AS (SELECT line_id, tot, CASE WHEN n <> 1 THEN -1 ELSE coalesce(nx, dist + 1) - dist - 1 END AS d FROM o WHERE k = 1)
SELECT t.line_id, CAST(coalesce(map_no, 0) AS INT) AS map_no, CASE WHEN m.line_id IS NULL THEN 0 WHEN map_no > 0 THEN 110 WHEN d < 0 THEN 119 WHEN tot = 1 THEN 254 ELSE 180 END AS mapq,
  CASE WHEN regexp_matches(tag, '^[^ ]+ [12]:[YN]:[0-9]+:') THEN regexp_extract(tag, '^[^ ]+ ([12]:[YN]:[0-9]+:[ACGTN0-9+]*)', 1) END AS casava
FROM tpl t LEFT JOIN m ON m.line_id = t.line_id LEFT JOIN u ON u.line_id = t.line_id""")
def sam_fields(spark, d):
    """Mapping quality by class and the CASAVA field of every SAM record of the MAP lines."""
    t = T.recount(templates(spark, d))
    x = t.select("line_id", "tag", "counters", F.posexplode_outer("maps").alias("map_no", "m"))
    q = F.when(F.col("m").isNull(), 0).otherwise(sinks.mapping_class(F.col("counters"), F.col("map_no") == 0))
    return x.select("line_id", F.coalesce("map_no", F.lit(0)).alias("map_no"), q.alias("mapq"), F.regexp_replace(sinks.FIELDS["cs"](F.col("m")), "^cs:Z:", "").alias("casava"))


@query(f"WITH {FEATURES} SELECT ann_id, row_number() OVER (PARTITION BY fq ORDER BY fs NULLS FIRST, ft NULLS FIRST, ann_id) - 1 AS by_start, row_number() OVER (PARTITION BY fq ORDER BY fe NULLS FIRST, ft NULLS FIRST, ann_id) - 1 AS by_end FROM f")
def feature_order(spark, d):
    """Place of each feature on its sequence by start and type, and by end and type."""
    f = Q.features(spark, d).select("ann_id", "seq_name", "feature_type", "start_pos", "end_pos")
    a = U.rank_within(f, ["seq_name"], ["start_pos", "feature_type", "ann_id"]).select("ann_id", F.col("row_no").alias("by_start"))
    b = U.rank_within(f, ["seq_name"], ["end_pos", "feature_type", "ann_id"]).select("ann_id", F.col("row_no").alias("by_end"))
    return a.join(b, "ann_id")
