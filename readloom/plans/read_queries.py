"""Queries of the operators over templates and their mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import counters as C
from readloom.functions import mapping as M
from readloom.functions import sequence as S
from readloom.operators import filters as P
from readloom.operators import templates as T
from readloom.plans.runtime import table
from readloom.plans.sqltext import MAPS, TBLOCKS, TEXTS, TPL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def templates(spark: SparkSession, d: str) -> DataFrame:
    return T.from_map_lines(table(spark, d, "raw_records").where("file_kind = 'map'"), keep=("line_id",))


# ---- counters -------------------------------------------------------------------------------------------------------

_CNT = f"""WITH {TPL}, c AS (SELECT line_id, ct, CASE WHEN ct = '!' THEN [] ELSE flatten(list_transform(string_split_regex(ct, '[:+]'),
  lambda t: list_resize(CAST([] AS BIGINT[]), CAST(coalesce(nullif(split_part(t, 'x', 2), ''), '1') AS BIGINT), CAST(split_part(t, 'x', 1) AS BIGINT)))) END AS c FROM tpl),
z AS (SELECT line_id, ct, c, list_filter(range(1, len(c) + 1), lambda i: c[i] > 0) AS nz FROM c)"""


@query(f"""{_CNT} SELECT line_id, array_to_string(c, ':') AS counters, CASE WHEN ct <> '!' THEN CASE WHEN contains(ct, '+') THEN
  (SELECT len(y.c) FROM (SELECT flatten(list_transform(string_split_regex(split_part(ct, '+', 1), '[:]'), lambda t: list_resize(CAST([] AS BIGINT[]), CAST(coalesce(nullif(split_part(t, 'x', 2), ''), '1') AS BIGINT), CAST(0 AS BIGINT)))) AS c) y)
  ELSE len(c) END END AS mcs, ct = '!' AS not_unique FROM z""")
def counters_parse(spark, d):
    return templates(spark, d).select("line_id", F.array_join(F.col("counters").cast("array<string>"), ":").alias("counters"), F.col("mcs").cast("bigint").alias("mcs"), "not_unique")


@query(f"""{_CNT} SELECT line_id, CAST(coalesce(list_sum(c), 0) AS BIGINT) AS total, nz[1] AS min_stratum, coalesce(nz[1] - 1, -1) AS min_mismatches,
  CASE WHEN len(nz) = 0 OR c[nz[1]] <> 1 THEN -1 ELSE coalesce(nz[2], len(c) + 1) - nz[1] - 1 END AS uniq_degree,
  CASE WHEN len(nz) = 0 OR c[nz[1]] <> 1 THEN -1 ELSE least(2, coalesce(nz[2], len(c) + 1) - nz[1] - 1) END AS level2,
  list_filter(nz, lambda i: i >= 2)[1] - 1 AS next_from_1, c[list_filter(nz, lambda i: i >= 2)[1]] AS next_maps FROM z""")
def counters_scalars(spark, d):
    c = F.col("counters")
    nxt = C.next_matching_stratum(c, F.lit(1))
    return templates(spark, d).select("line_id", C.reduce_sum(c).alias("total"), C.min_matching_stratum(c).alias("min_stratum"), C.min_mismatches(c).alias("min_mismatches"), C.uniq_degree(c).alias("uniq_degree"), C.level(c, 2).alias("level2"), nxt["stratum"].alias("next_from_1"), nxt["maps"].alias("next_maps"))


@query(f"""{_CNT}, x AS (SELECT line_id, len(c) AS n, unnest(CASE WHEN len(c) = 0 THEN [NULL] ELSE c END) AS v, generate_subscripts(CASE WHEN len(c) = 0 THEN [NULL] ELSE c END, 1) AS i FROM z),
y AS (SELECT *, sum(v) OVER w AS cum, coalesce(i - min(CASE WHEN v > 0 THEN i END) OVER w + 1, 0) AS strata FROM x WINDOW w AS (PARTITION BY line_id ORDER BY i)),
s AS (SELECT *, cum > 3 AND strata > 1 AS stop FROM y)
SELECT line_id, CAST(coalesce(min(CASE WHEN stop THEN i - 1 END), any_value(n)) AS BIGINT) AS strata,
  CAST(coalesce(min_by(cum - v, i) FILTER (WHERE stop), max(cum), 0) AS BIGINT) AS maps FROM s GROUP BY line_id""")
def counters_under_caps(spark, d):
    k = C.maps_under_caps(F.col("counters"), 1, 3)
    return templates(spark, d).select("line_id", k["strata"].alias("strata"), k["maps"].alias("maps"))


_REC = f"""WITH {MAPS}, g AS (SELECT line_id, dist, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT line_id, max(dist) AS mx FROM g GROUP BY 1)"""


@query(f"""{_REC} SELECT t.line_id, coalesce(array_to_string((SELECT list(coalesce(n, 0) ORDER BY i) FROM (SELECT unnest(range(0, mx + 1)) AS i) k LEFT JOIN g ON g.line_id = t.line_id AND g.dist = k.i), ':'), '') AS counters
FROM tpl t LEFT JOIN r ON r.line_id = t.line_id""")
def counters_recount(spark, d):
    return T.recount(templates(spark, d)).select("line_id", F.array_join(F.col("counters").cast("array<string>"), ":").alias("counters"))


@query(f"""{_CNT} SELECT line_id, array_to_string(list_transform(list_concat(c, list_resize(CAST([] AS BIGINT[]), greatest(0, 3 - len(c)), CAST(0 AS BIGINT))), lambda x, i: CASE WHEN i = 3 THEN x + 1 ELSE x END), ':') AS counters FROM z""")
def counters_increment(spark, d):
    return templates(spark, d).select("line_id", F.array_join(C.add_counter(F.col("counters"), F.lit(2)).cast("array<string>"), ":").alias("counters"))


# ---- mapping metrics ------------------------------------------------------------------------------------------------


@query(f"""WITH {MAPS} SELECT line_id, CAST(map_no AS INT) AS map_no, seq AS seq_name, st AS strand, pos, score, dist, dist - njunc AS no_split, lev, mism, nindel, CAST(ins AS BIGINT) AS ins, CAST(dels AS BIGINT) AS dels,
  base_len, base_len - mism - dels AS aligned, glen, pos + glen - 1 AS end_pos, CAST(njunc + 1 AS INT) AS n_blocks,
  coalesce(CAST(nullif(regexp_extract(e, '^\\(([0-9]+)\\)', 1), '') AS BIGINT), CAST(nullif(regexp_extract(e, '^>([0-9]+)-', 1), '') AS BIGINT), 0) AS left_trim FROM m""")
def map_metrics(spark, d):
    b = F.col("m.blocks")
    return T.map_rows(templates(spark, d), ("line_id",)).select(
        "line_id", "map_no", "m.seq_name", "m.strand", "m.pos", "m.score", M.global_distance(b).alias("dist"), M.no_split_distance(b).alias("no_split"), M.levenshtein(b).alias("lev"), M.n_mismatches(b).alias("mism"),
        M.n_indels(b).alias("nindel"), M.total_ins(b).alias("ins"), M.total_dels(b).alias("dels"), M.global_base_length(b).alias("base_len"), M.bases_aligned(b).alias("aligned"), M.global_length(b).alias("glen"),
        M.end_position(b).alias("end_pos"), F.size(b).alias("n_blocks"), M.left_trim(b).alias("left_trim"),
    )


@query(f"WITH {TEXTS} SELECT m.line_id, CAST(m.map_no AS INT) AS map_no, edits FROM m JOIN rn ON rn.line_id = m.line_id AND rn.map_no = m.map_no")
def map_render(spark, d):
    return T.map_rows(templates(spark, d), ("line_id",)).select("line_id", "map_no", M.render_edits(F.col("m.blocks")).alias("edits"))


@query(f"WITH {TEXTS} SELECT line_id, CAST(map_no AS INT) AS map_no, fwd AS cigar FROM cg")
def map_cigar(spark, d):
    return T.map_rows(templates(spark, d), ("line_id",)).select("line_id", "map_no", M.cigar(F.col("m.blocks")).alias("cigar"))


@query(f"WITH {TEXTS} SELECT line_id, CAST(map_no AS INT) AS map_no, rev AS cigar FROM cg")
def map_reverse_blocks(spark, d):
    """Blocks and operations from the other end, told by their CIGAR."""
    return T.map_rows(templates(spark, d), ("line_id",)).select("line_id", "map_no", M.cigar(M.reverse_blocks(F.col("m.blocks"))).alias("cigar"))


@query(f"WITH {TBLOCKS} SELECT line_id, CAST(map_no AS INT) AS map_no, seq AS seq_name, st AS strand, CAST(n_blocks AS INT) AS n_blocks, CAST(bno AS INT) AS block_no, s AS start_pos, en AS end_pos FROM tb")
def block_view(spark, d):
    return T.block_rows(templates(spark, d), ("line_id",)).drop("b")


# ---- predicates -----------------------------------------------------------------------------------------------------

_UNIQ = "CASE WHEN len(nz) = 0 OR c[nz[1]] <> 1 THEN -1 ELSE coalesce(nz[2], len(c) + 1) - nz[1] - 1 END"


def _ids(df):
    return df.select("line_id")


@query(f"{_CNT} SELECT line_id FROM z WHERE len(nz) > 0 OR ct = '!'")
def mapped_filter(spark, d):
    return _ids(templates(spark, d).where(P.mapped()))


@query(f"{_CNT} SELECT line_id FROM z WHERE len(nz) = 0 AND ct <> '!'")
def unmapped_filter(spark, d):
    return _ids(templates(spark, d).where(~P.mapped()))


@query(f"{_CNT} SELECT line_id FROM z WHERE (len(nz) = 0 AND ct <> '!') OR {_UNIQ} >= 1")
def unique_level(spark, d):
    return _ids(templates(spark, d).where(P.unique_at(1)))


@query(f"{_CNT} SELECT line_id FROM z WHERE {_UNIQ} >= 1")
def unique_strict(spark, d):
    return _ids(templates(spark, d).where(P.strictly_unique(1)))


@query(f"{_CNT} SELECT line_id FROM z WHERE coalesce(nz[1], 999) > 2")
def unmapped_up_to(spark, d):
    return _ids(templates(spark, d).where(C.is_unmapped_up_to(F.col("counters"), 1)))


@query(f"WITH {TPL} SELECT line_id FROM tpl WHERE length(r) BETWEEN 40 AND 75")
def length_filter(spark, d):
    return _ids(templates(spark, d).where(P.read_length_between(40, 75)))


@query(f"WITH {TPL} SELECT line_id FROM tpl WHERE CASE WHEN ms = '-' THEN 0 ELSE len(string_split(ms, ',')) END BETWEEN 1 AND 2")
def num_maps_filter(spark, d):
    return _ids(templates(spark, d).where(P.maps_between(1, 2)))


# ---- filters over mappings ------------------------------------------------------------------------------------------


def _kept(df):
    return df.select("line_id", T.texts(F.col("maps")).alias("maps"))


def _sql_kept(cond: str, extra: str = "", source: str = "m") -> str:
    return f"""WITH {MAPS}{extra}, k AS (SELECT line_id, string_agg(txt, ',' ORDER BY map_no) AS maps FROM {source} WHERE {cond} GROUP BY line_id)
SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN k ON k.line_id = t.line_id"""


@query(_sql_kept("seq LIKE 'chr%' AND seq IN ('chr1', 'chr2', 'chr4', 'chr11', 'chr17')"))
def map_id_filter(spark, d):
    return _kept(P.on_sequences(templates(spark, d), ["chr1", "chr2", "chr4", "chr11", "chr17"]))


@query(_sql_kept("bad = 0", ", b AS (SELECT *, min(dist) OVER (PARTITION BY line_id) AS lo FROM m), s AS (SELECT *, sum(CASE WHEN dist > lo + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY map_no) AS bad FROM b)", "s"))
def strata_after_best(spark, d):
    return _kept(P.strata_after_best(templates(spark, d), 1))


@query(_sql_kept("dist BETWEEN 1 AND n", ", r AS (SELECT m.*, floor(0.04 * length(r)) AS n FROM m JOIN tpl USING (line_id))", "r"))
def event_distance_filter(spark, d):
    return _kept(P.distance_between(templates(spark, d), 1, 0.04))


@query(_sql_kept("lev <= 2"))
def levenshtein_filter(spark, d):
    return _kept(P.levenshtein_between(templates(spark, d), 0, 2))


@query(_sql_kept("st = '+'"))
def strand_filter(spark, d):
    return _kept(P.on_strand(templates(spark, d), "+"))


@query(_sql_kept("coalesce(score, 0) BETWEEN 100 AND 30000 OR coalesce(score, 0) BETWEEN 100000000000 AND 200000000000"))
def quality_ranges(spark, d):
    return _kept(P.score_in(templates(spark, d), [(100, 30_000), (100_000_000_000, 200_000_000_000)]))


@query(_sql_kept("map_no = 0"))
def first_map(spark, d):
    return _kept(P.first_map(templates(spark, d)))


@query(_sql_kept("st = '+' OR (npos = 0 AND map_no = 0)", ", b AS (SELECT *, sum(CASE WHEN st = '+' THEN 1 ELSE 0 END) OVER (PARTITION BY line_id) AS npos FROM m)", "b"))
def keep_first_map(spark, d):
    x = templates(spark, d).withColumn("was", F.col("maps"))
    return _kept(P.keep_first_if_empty(P.on_strand(x, "+"), F.col("was")))


@query(_sql_kept("st = '+' OR npos = 0 OR n = 1", ", b AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, sum(CASE WHEN st = '+' THEN 1 ELSE 0 END) OVER (PARTITION BY line_id) AS npos FROM m)", "b"))
def keep_unique(spark, d):
    return _kept(P.keep_unique(templates(spark, d), lambda x: P.on_strand(x, "+")))


@query(_sql_kept("njunc > 0"))
def split_only(spark, d):
    return _kept(P.splits(templates(spark, d), True))


@query(_sql_kept("njunc = 0"))
def no_split(spark, d):
    return _kept(P.splits(templates(spark, d), False))


@query(_sql_kept("njunc = 0 OR list_min(list_transform(regexp_extract_all(e, '>([0-9]+)[*]', 1), lambda x: CAST(x AS BIGINT))) >= 20000"))
def min_intron(spark, d):
    return _kept(P.min_intron_length(templates(spark, d), 20_000))


@query(_sql_kept("mism <= 1"))
def max_mismatches(spark, d):
    return _kept(P.max_plain_mismatches(templates(spark, d), 1))


@query(_sql_kept("map_no = 0 OR u < 1", f", c AS (SELECT line_id, CASE WHEN ct = '!' THEN [] ELSE flatten(list_transform(string_split_regex(ct, '[:+]'), lambda t: list_resize(CAST([] AS BIGINT[]), CAST(coalesce(nullif(split_part(t, 'x', 2), ''), '1') AS BIGINT), CAST(split_part(t, 'x', 1) AS BIGINT)))) END AS c FROM tpl), z AS (SELECT line_id, c, list_filter(range(1, len(c) + 1), lambda i: c[i] > 0) AS nz FROM c), uu AS (SELECT line_id, {_UNIQ} AS u FROM z), b AS (SELECT m.*, u FROM m JOIN uu USING (line_id))", "b"))
def reduce_unique_strata(spark, d):
    return _kept(P.reduce_to_unique_strata(templates(spark, d), 1))


@query(_sql_kept("n <= 2", ", b AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM m)", "b"))
def reduce_max_maps(spark, d):
    return _kept(P.reduce_to_max_maps(templates(spark, d), 2))


@query(_sql_kept("map_no < 2"))
def top_n_maps(spark, d):
    return _kept(P.max_output(templates(spark, d), 2))


@query(f"""WITH {TEXTS}, po AS (SELECT line_id, map_no, c, i, CAST(coalesce(sum(used) OVER (PARTITION BY line_id, map_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS abs FROM k3),
lq AS (SELECT po.line_id, map_no, arg_max(CASE WHEN substr(q, abs + 1, 1) = '' THEN 0 ELSE ascii(substr(q, abs + 1, 1)) END, i) AS q FROM po JOIN tpl ON tpl.line_id = po.line_id WHERE regexp_matches(c, '[A-Z]') GROUP BY ALL),
qm AS (SELECT m.line_id, m.map_no, m.txt, coalesce(lq.q, 0) AS v, max(coalesce(lq.q, 0)) OVER (PARTITION BY m.line_id) AS top, tpl.q IS NULL AS none FROM m JOIN tpl ON tpl.line_id = m.line_id LEFT JOIN lq ON lq.line_id = m.line_id AND lq.map_no = m.map_no),
s AS (SELECT line_id, string_agg(txt, ',' ORDER BY map_no) AS maps FROM qm WHERE none OR NOT (v <> 0 AND v <> top AND top - v <= 20) GROUP BY 1) SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN s ON s.line_id = t.line_id""")
def reduce_by_quality(spark, d):
    return _kept(P.reduce_by_quality(templates(spark, d), 20))


@query(f"""WITH {MAPS}, g AS (SELECT line_id, dist, count(*) AS n FROM m GROUP BY ALL), mx AS (SELECT line_id, max(dist) AS top FROM m GROUP BY 1), gi AS (SELECT line_id, top, unnest(range(0, top + 1)) AS i FROM mx),
c AS (SELECT gi.line_id, top, i, coalesce(n, 0) AS v FROM gi LEFT JOIN g ON g.line_id = gi.line_id AND g.dist = gi.i),
y AS (SELECT *, sum(v) OVER w AS cum, i - min(CASE WHEN v > 0 THEN i END) OVER w + 1 AS strata FROM c WINDOW w AS (PARTITION BY line_id ORDER BY i)),
s AS (SELECT line_id, coalesce(min(CASE WHEN cum > 2 AND coalesce(strata, 0) > 1 THEN i END), any_value(top) + 1) AS cut FROM y GROUP BY 1),
k AS (SELECT m.line_id, string_agg(txt, ',' ORDER BY map_no) AS maps FROM m JOIN s ON s.line_id = m.line_id WHERE dist < cut GROUP BY 1)
SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN k ON k.line_id = t.line_id""")
def stratum_pruning(spark, d):
    return _kept(P.prune_strata(T.recount(templates(spark, d)), 1, 2))


@query(f"""WITH {MAPS}, k AS (SELECT line_id, string_agg(txt, ',' ORDER BY dist, coalesce(score, 0) DESC, map_no) AS maps FROM m GROUP BY line_id)
SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN k ON k.line_id = t.line_id""")
def sort_maps(spark, d):
    return _kept(T.sort_maps(templates(spark, d)))


@query(f"""WITH {MAPS}, k AS (SELECT line_id, string_agg(txt, ',' ORDER BY dist - njunc, coalesce(score, 0) DESC, map_no) AS maps FROM m GROUP BY line_id)
SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN k ON k.line_id = t.line_id""")
def sort_maps_no_split(spark, d):
    return _kept(T.sort_maps(templates(spark, d), splits=False))


@query(f"""WITH {TBLOCKS}, sp AS (SELECT line_id, map_no, seq || st || string_agg(s || '-' || en, ',' ORDER BY bno) AS key FROM tb GROUP BY line_id, map_no, seq, st),
o AS (SELECT m.line_id, m.map_no, txt, row_number() OVER (PARTITION BY m.line_id, key ORDER BY dist, m.map_no) AS k FROM m JOIN sp ON sp.line_id = m.line_id AND sp.map_no = m.map_no),
k AS (SELECT line_id, string_agg(txt, ',' ORDER BY map_no) AS maps FROM o WHERE k = 1 GROUP BY 1) SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN k ON k.line_id = t.line_id""")
def dedupe_maps(spark, d):
    return _kept(P.drop_duplicate_maps(templates(spark, d)))


@query(f"""WITH {MAPS}, k AS (SELECT line_id, string_agg(txt, ',' ORDER BY map_no) AS maps, count(*) AS n FROM m WHERE dist <= 3 AND st = '+' GROUP BY line_id)
SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN k ON k.line_id = t.line_id WHERE length(r) >= 40""")
def filter_pipeline(spark, d):
    return _kept(P.filter_templates(templates(spark, d), P.FilterOptions(length=(40, 100_000), strata=(0, 3), strand="+")))


# ---- reads ----------------------------------------------------------------------------------------------------------


def reads(spark, d):
    return table(spark, d, "fastq_reads").select("read_id", "tag", "run_id", "read_seq", "qualities").distinct()


_READS = "WITH rd AS (SELECT DISTINCT read_id, tag, run_id, read_seq, qualities FROM fastq_reads)"


@query(f"{_READS} SELECT read_id, reverse(translate(read_seq, 'ACGTN', 'TGCAN')) AS rc FROM rd")
def revcomp(spark, d):
    return reads(spark, d).select("read_id", S.reverse_complement(F.col("read_seq")).alias("rc"))


@query(f"{_READS} SELECT read_id, substr(read_seq, 6, greatest(length(read_seq) - 15, 0)) AS trimmed, CASE WHEN length(read_seq) - 15 >= 50 THEN substr(read_seq, 6, length(read_seq) - 15) ELSE read_seq END AS trimmed_if FROM rd")
def trim_reads(spark, d):
    return reads(spark, d).select("read_id", S.hard_trim(F.col("read_seq"), 5, 10).alias("trimmed"), S.trim_if(F.col("read_seq"), 5, 10, 50).alias("trimmed_if"))


@query(f"{_READS} SELECT read_id, regexp_replace(regexp_replace(upper(read_seq), '[^ACGTN]', 'N', 'g'), '^N+|N+$', '', 'g') AS uniform, regexp_full_match(read_seq, '[ACGTN]+') AS dna FROM rd")
def uniform_reads(spark, d):
    return reads(spark, d).select("read_id", S.uniform_read(F.col("read_seq")).alias("uniform"), S.is_dna(F.col("read_seq")).alias("dna"))


_SHIFT = "".join(chr(c) for c in range(33, 96)).replace("'", "''")
_TO = "".join(chr(c + 31) for c in range(33, 96)).replace("'", "''")


@query(f"{_READS} SELECT read_id, translate(qualities, '{_SHIFT}', '{_TO}') AS q64, CASE WHEN regexp_matches(qualities, '[!-:]') THEN 33 WHEN regexp_matches(qualities, '[K-~]') THEN 64 END AS off FROM rd WHERE qualities <> ''")
def quality_shift(spark, d):
    x = reads(spark, d).where(F.col("qualities") != "")
    return x.select("read_id", S.shift_qualities(F.col("qualities"), 31).alias("q64"), S.deduce_offset(F.col("qualities")).alias("off"))


@query(f"""{_READS} SELECT read_id, CASE WHEN length(qualities) > 0 THEN CAST(list_sum(list_transform(string_split(qualities, ''), lambda c: ascii(c))) AS BIGINT) // length(qualities) END AS avg_q FROM rd""")
def average_quality(spark, d):
    return reads(spark, d).select("read_id", S.average_quality(F.col("qualities")).alias("avg_q"))


@query(f"""{_READS} SELECT read_id, i AS start, substr(read_seq, i + 1, 20) AS piece FROM (SELECT read_id, read_seq, unnest(range(0, greatest(length(read_seq), 1), 20)) AS i FROM rd WHERE length(read_seq) > 0) WHERE i + 20 <= length(read_seq)""")
def chunk_reads(spark, d):
    return reads(spark, d).select("read_id", F.explode(S.chunks(F.col("read_seq"), 20, 20)).alias("p")).select("read_id", F.col("p.start").cast("bigint").alias("start"), "p.piece")


@query(f"""{_READS}, t AS (SELECT read_id, string_split(tag, ':') AS p FROM rd) SELECT read_id, p[1] AS machine, CASE WHEN len(p) >= 5 THEN p[-4] END AS lane, CASE WHEN len(p) >= 5 THEN TRY_CAST(p[-3] AS INT) END AS tile, CASE WHEN len(p) >= 5 THEN TRY_CAST(p[-2] AS BIGINT) END AS x, CASE WHEN len(p) >= 5 THEN TRY_CAST(p[-1] AS BIGINT) END AS y FROM t""")
def tag_parts(spark, d):
    return reads(spark, d).select("read_id", S.parse_id(F.col("tag")).alias("p")).select("read_id", "p.*")


@query(f"""WITH {TPL}, s AS (SELECT line_id, tag, split_part(tag, ' ', 1) AS f, CASE WHEN contains(tag, ' ') THEN substr(tag, instr(tag, ' ') + 1) ELSE '' END AS rest FROM tpl),
c AS (SELECT *, regexp_extract(rest, '^([12]:[YN]:[0-9]+:[ACGTN0-9+]*)', 1) AS casava FROM s)
SELECT line_id, regexp_replace(f, '/[12]$', '') AS name, CASE WHEN regexp_matches(f, '/[12]$') THEN CAST(right(f, 1) AS INT) WHEN casava <> '' THEN CAST(left(casava, 1) AS INT) ELSE 0 END AS pair, casava,
  trim(CASE WHEN casava <> '' THEN regexp_replace(rest, '^[12]:[YN]:[0-9]+:[ACGTN0-9+]*', '') ELSE rest END) AS extra FROM c""")
def casava_tags(spark, d):
    return templates(spark, d).select("line_id", S.parse_tag(F.col("tag")).alias("t")).select("line_id", "t.name", "t.pair", "t.casava", "t.extra")
