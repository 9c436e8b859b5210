"""Queries of the general data-preparation operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import hotkeys, periods, records, units
from readloom.plans.runtime import table
from readloom.plans.sqltext import METRICS, E

#: A key is hot from 3 in 100 of all rows on.
HOT = (3, 100)
TRANSCRIPT = ["seq_name", "transcript_id"]


def p1_key_profile(spark: SparkSession, d: str) -> DataFrame:
    m = hotkeys.key_profile(table(spark, d, "mappings"), "seq_name", ["pos", "n_edits", "tlen"]).withColumn("field_name", F.lit("seq_name"))
    t = table(spark, d, "targets").withColumn("span", F.col("end_pos") - F.col("start_pos") + 1)
    t = hotkeys.key_profile(t, "name", ["start_pos", "end_pos", "span"]).withColumn("field_name", F.lit("name"))
    return m.unionByName(t, allowMissingColumns=True)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    m = hotkeys.key_profile(table(spark, d, "mappings"), "seq_name", []).withColumn("field_name", F.lit("seq_name"))
    t = hotkeys.key_profile(table(spark, d, "targets"), "name", []).withColumn("field_name", F.lit("name"))
    return hotkeys.heavy_keys(m.unionByName(t), *HOT, no_keys=("", "*")).select("field_name", "key_value")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return records.parse_lines(table(spark, d, "raw_records"), table(spark, d, "ref_sequences"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("status = 'rejected'").select("line_id")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines, typed; the tags of a line joined by tabs, which they cannot hold."""
    return _parsed(spark, d).where("status = 'valid'").select("line_id", "record.*").withColumn("tags", F.array_join("tags", "\t"))


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    e = _parsed(spark, d).where("status = 'rejected'").select("line_id", F.posexplode("errors").alias("error_no", "e"), F.size("recovered").alias("n_recovered"))
    return e.select("line_id", "error_no", F.col("e.at").alias("at"), F.col("e.field").alias("field"), F.col("e.reason").alias("reason"), "n_recovered")


def p2_recovered(spark: SparkSession, d: str) -> DataFrame:
    """The records of rejected lines that hold several, typed, each with its place in the line."""
    r = _parsed(spark, d).where("status = 'rejected'").select("line_id", F.posexplode("recovered").alias("record_no", "r"))
    return r.select("line_id", "record_no", F.col("r.at").alias("at"), "r.record.*")


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields at fault of every rejected line."""
    return _parsed(spark, d).where("status = 'rejected'").select("line_id", F.explode(F.array_distinct("errors.field")).alias("field"))


def _qualities(spark: SparkSession, d: str) -> DataFrame:
    return units.common_qualities(table(spark, d, "fastq_reads").drop("loaded_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("qualities")
    there = q.isNotNull() & ~F.trim(q).isin("", "*")
    return _qualities(spark, d).where(there & ~F.col("recorded_as").eqNullSafe(units.P33)).select("read_id").distinct()


def p5_phred33(spark: SparkSession, d: str) -> DataFrame:
    return _qualities(spark, d).select("read_id", "recorded_as", "phred33").distinct()


def p5_aliases(spark: SparkSession, d: str) -> DataFrame:
    return units.alias_dictionary(table(spark, d, "fastq_reads"), "quality_format", "descr")


def _covered(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations")
    kind = F.coalesce(F.col("feature_type"), F.lit(""))
    return a.where(F.col("transcript_id").isNotNull() & ~kind.isin("gene", "transcript")).select(*TRANSCRIPT, "start_pos", "end_pos")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.gaps(_covered(spark, d), TRANSCRIPT, "start_pos", "end_pos")


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods.periods(_covered(spark, d), TRANSCRIPT, "start_pos", "end_pos")


QUERIES = {f.__name__: f for f in (p1_found, p1_key_profile, p2_found, p2_records, p2_rejects, p2_recovered, p2_fields, p5_found, p5_phred33, p5_aliases, p6_found, p6_periods)}

_M = ["pos", "n_edits", "tlen"]
_T = ["start_pos", "end_pos", "span"]


def _stats(own: list[str], other: list[str]) -> str:
    f = lambda x: f"count({x}) AS {x}_count, CAST(sum({x}) AS BIGINT) AS {x}_sum, CAST(min({x}) AS BIGINT) AS {x}_min, CAST(max({x}) AS BIGINT) AS {x}_max"
    none = lambda x: ", ".join(f"CAST(NULL AS BIGINT) AS {x}_{s}" for s in ("count", "sum", "min", "max"))
    return ", ".join(map(f, own)) + ", " + ", ".join(map(none, other))


_COVERED = """c AS (SELECT seq_name, transcript_id, start_pos s, end_pos t FROM annotations
  WHERE transcript_id IS NOT NULL AND start_pos <= end_pos AND coalesce(feature_type, '') NOT IN ('gene', 'transcript')),
b AS (SELECT *, max(t) OVER (PARTITION BY seq_name, transcript_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM c)"""

_FM = "regexp_full_match"
_P2 = rf"""WITH r AS (SELECT line_id, file_kind AS k, raw_line AS l, current_line_num AS n, map_seq_name AS noted, string_split(raw_line, chr(9)) AS c FROM raw_records
  WHERE NOT (file_kind = 'sam' AND regexp_matches(raw_line, '^@[A-Z]{{2}}\t')) AND NOT (file_kind = 'gtf' AND starts_with(raw_line, '#'))),
q AS (SELECT seq_name AS sq, seq_length AS sl FROM ref_sequences),
sam AS (SELECT line_id, coalesce(len(c) >= 11 AND c[1] <> '' AND {_FM}(c[2], '[0-9]+') AND TRY_CAST(c[2] AS HUGEINT) <= 4095 AND {_FM}(c[4], '[0-9]+') AND {_FM}(c[8], '[0-9]+')
  AND {_FM}(c[5], '[0-9]+') AND TRY_CAST(c[5] AS HUGEINT) <= 255 AND {_FM}(c[9], '[+-]?[0-9]+') AND (c[3] = '*' OR TRY_CAST(c[4] AS HUGEINT) <= a.sl) AND (c[7] IN ('*', '=') OR b.sq IS NOT NULL)
  AND (c[6] = '*' OR {_FM}(c[6], '([0-9]+[MIDNSHP=X])+')) AND (c[10] = '*' OR {_FM}(c[10], '[ACGTNacgtn]+'))
  AND (c[6] = '*' OR c[10] = '*' OR coalesce(list_sum(list_transform(regexp_extract_all(c[6], '([0-9]+)[MIS=X]', 1), lambda x: CAST(x AS BIGINT))), 0) = length(c[10]))
  AND (c[11] = '*' OR ({_FM}(c[11], '[!-~]+') AND (c[10] = '*' OR length(c[11]) = length(c[10]))))
  AND len(list_filter(c[12:], lambda t: NOT {_FM}(t, '[A-Za-z][A-Za-z0-9]:(?:A:.|i:[+-]?[0-9]+|f:[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)|[ZHB]:.*)'))) = 0, false) AS ok
  FROM r LEFT JOIN q a ON a.sq = c[3] LEFT JOIN q b ON b.sq = c[7] WHERE k = 'sam'),
mi AS (SELECT line_id, c[2] AS rd, unnest(string_split(c[-1], ',')) AS t FROM r WHERE k = 'map' AND len(c) IN (4, 5) AND c[-1] <> '-'),
mf AS (SELECT line_id, rd, t, split_part(split_part(t, ':::', 1), ':', 4) AS e FROM mi), mm AS (SELECT *, {METRICS} FROM mf),
mb AS (SELECT line_id, bool_and(coalesce({_FM}(t, '[^:]*:[-+FR]:[0-9]+:(?:{E})*(?::::(?:0x[0-9a-fA-F]+|[0-9]+))?') AND TRY_CAST(split_part(t, ':', 3) AS HUGEINT) BETWEEN 1 AND sl AND matched + mism + dels = length(rd), false)) AS good
  FROM mm LEFT JOIN q ON sq = split_part(t, ':', 1) GROUP BY 1),
map AS (SELECT r.line_id, coalesce(len(c) IN (4, 5) AND {_FM}(c[2], '[ACGTN]+') AND (len(c) = 4 OR c[3] = '' OR ({_FM}(c[3], '[!-~]+') AND length(c[3]) = length(c[2])))
  AND ({_FM}(c[-2], '!|[0-9]+(?:x[0-9]+)?(?:[:+][0-9]+(?:x[0-9]+)?)*') AND length(c[-2]) - length(replace(c[-2], '+', '')) <= 1) AND (c[-1] = '-' OR good), false) AS ok FROM r LEFT JOIN mb ON mb.line_id = r.line_id WHERE k = 'map'),
gtf AS (SELECT line_id, coalesce(len(c) = 9 AND {_FM}(c[4], '[0-9]+') AND {_FM}(c[5], '[0-9]+') AND TRY_CAST(c[4] AS HUGEINT) >= 1 AND TRY_CAST(c[4] AS HUGEINT) <= TRY_CAST(c[5] AS HUGEINT) AND TRY_CAST(c[5] AS HUGEINT) <= sl
  AND (c[6] = '.' OR {_FM}(c[6], '[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?')) AND c[7] IN ('+', '-', '.') AND c[8] IN ('0', '1', '2', '.')
  AND {_FM}(c[9], '[A-Za-z0-9_]+ "[^"]*";(?: [A-Za-z0-9_]+ "[^"]*";)* *') AND regexp_matches(c[9], '(?:^| )gene_id "[^"]+";'), false) AS ok FROM r LEFT JOIN q ON sq = c[1] WHERE k = 'gtf'),
v AS (SELECT * FROM sam UNION ALL SELECT * FROM map UNION ALL SELECT * FROM gtf)
SELECT r.line_id FROM r LEFT JOIN v ON v.line_id = r.line_id LEFT JOIN q ON sq = noted WHERE NOT coalesce(ok, false) OR n IS NULL OR n < 1 OR NOT (noted IS NULL OR noted = '*' OR sq IS NOT NULL)"""

_P2_PARTS, _P2_END = _P2[: _P2.rindex("SELECT r.line_id")], _P2[_P2.rindex("SELECT r.line_id") :]
_BAD_NOTE = "SELECT line_id, 'current_line_num' AS field FROM r WHERE n IS NULL OR n < 1 UNION ALL SELECT line_id, 'map_seq_name' FROM r LEFT JOIN q ON sq = noted WHERE noted <> '*' AND sq IS NULL"


def _bad(fields: dict[str, str]) -> str:
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({cond}, false) THEN '{f}' END" for f, cond in fields.items()) + "], lambda x: x IS NOT NULL)) AS field"


_NUM = lambda c, hi: f"({_FM}({c}, '[0-9]+') AND TRY_CAST({c} AS HUGEINT) <= {hi})"
_SAM_BAD = _bad({
    "qname": "c[1] <> ''", "flag": _NUM("c[2]", 4095), "rname": f"c[3] = '*' OR (a.sl IS NOT NULL AND (NOT {_FM}(c[4], '[0-9]+') OR TRY_CAST(c[4] AS HUGEINT) <= a.sl))", "pos": f"{_FM}(c[4], '[0-9]+')", "mapq": _NUM("c[5]", 255),
    "cigar": f"""(c[6] = '*' OR {_FM}(c[6], '([0-9]+[MIDNSHP=X])+')) AND
      (c[6] = '*' OR c[10] = '*' OR coalesce(list_sum(list_transform(regexp_extract_all(c[6], '([0-9]+)[MIS=X]', 1), lambda x: CAST(x AS BIGINT))), 0) = length(c[10]))""",
    "rnext": "c[7] IN ('*', '=') OR b.sq IS NOT NULL", "pnext": f"{_FM}(c[8], '[0-9]+')", "tlen": f"{_FM}(c[9], '[+-]?[0-9]+')", "seq": f"c[10] = '*' OR {_FM}(c[10], '[ACGTNacgtn]+')",
    "qual": f"c[11] = '*' OR ({_FM}(c[11], '[!-~]+') AND (c[10] = '*' OR length(c[11]) = length(c[10])))",
    "tag": f"len(list_filter(c[12:], lambda t: NOT {_FM}(t, '[A-Za-z][A-Za-z0-9]:(?:A:.|i:[+-]?[0-9]+|f:[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)|[ZHB]:.*)'))) = 0",
})
_MAP_BAD = _bad({
    "read": f"{_FM}(c[2], '[ACGTN]+')", "quals": f"len(c) = 4 OR c[3] = '' OR ({_FM}(c[3], '[!-~]+') AND length(c[3]) = length(c[2]))",
    "counters": f"{_FM}(c[-2], '!|[0-9]+(?:x[0-9]+)?(?:[:+][0-9]+(?:x[0-9]+)?)*') AND length(c[-2]) - length(replace(c[-2], '+', '')) <= 1", "maps": "c[-1] = '-' OR good",
})
_GTF_BAD = _bad({
    "seqname": f"sl IS NOT NULL AND (NOT {_FM}(c[5], '[0-9]+') OR TRY_CAST(c[5] AS HUGEINT) < 1 OR TRY_CAST(c[5] AS HUGEINT) <= sl)",
    "start": f"{_FM}(c[4], '[0-9]+') AND TRY_CAST(c[4] AS HUGEINT) >= 1 AND (NOT {_FM}(c[5], '[0-9]+') OR TRY_CAST(c[5] AS HUGEINT) < 1 OR TRY_CAST(c[4] AS HUGEINT) <= TRY_CAST(c[5] AS HUGEINT))",
    "end": f"{_FM}(c[5], '[0-9]+') AND TRY_CAST(c[5] AS HUGEINT) >= 1", "score": f"c[6] = '.' OR {_FM}(c[6], '[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?')",
    "strand": "c[7] IN ('+', '-', '.')", "frame": "c[8] IN ('0', '1', '2', '.')",
})
#: Attributes of a line in which some are broken are still told, so a gene_id behind a fault counts; the fault itself is one of the field.
_P2_FIELDS = f"""{_P2_PARTS.rstrip().rstrip(',')},
e AS (SELECT line_id, {_SAM_BAD} FROM r LEFT JOIN q a ON a.sq = c[3] LEFT JOIN q b ON b.sq = c[7] WHERE k = 'sam' AND len(c) >= 11
  UNION ALL SELECT r.line_id, {_MAP_BAD} FROM r LEFT JOIN mb ON mb.line_id = r.line_id WHERE k = 'map' AND len(c) IN (4, 5)
  UNION ALL SELECT line_id, {_GTF_BAD} FROM r LEFT JOIN q ON sq = c[1] WHERE k = 'gtf' AND len(c) = 9
  UNION ALL SELECT line_id, 'attributes' FROM r WHERE k = 'gtf' AND len(c) = 9 AND NOT ({_FM}(c[9], '[A-Za-z0-9_]+ "[^"]*";(?: [A-Za-z0-9_]+ "[^"]*";)* *') AND regexp_matches(c[9], '(?:^| )gene_id "[^"]+";'))
  UNION ALL SELECT line_id, CASE WHEN l IS NULL THEN 'line' WHEN k IN ('sam', 'map', 'gtf') THEN 'columns' ELSE 'file_kind' END FROM r
    WHERE l IS NULL OR NOT coalesce((k = 'sam' AND len(c) >= 11) OR (k = 'map' AND len(c) IN (4, 5)) OR (k = 'gtf' AND len(c) = 9), false)
  UNION ALL {_BAD_NOTE})
SELECT DISTINCT line_id, field FROM e"""
_F = "split_part(c[-1], ',', 1)"
_P2_RECORDS = f"""{_P2_PARTS.rstrip().rstrip(',')}, bad AS ({_P2_END})
SELECT r.line_id, CASE WHEN k = 'gtf' THEN regexp_extract(c[9], '(?:^| )gene_id "([^"]*)"', 1) ELSE c[1] END AS name, CASE WHEN k = 'sam' THEN CAST(c[2] AS INT) END AS flag,
  CASE k WHEN 'sam' THEN c[3] WHEN 'gtf' THEN c[1] WHEN 'map' THEN CASE WHEN c[-1] <> '-' THEN split_part({_F}, ':', 1) END END AS seq_name,
  TRY_CAST(CASE WHEN k = 'map' THEN CASE WHEN c[-1] <> '-' THEN split_part({_F}, ':', 3) END ELSE c[4] END AS BIGINT) AS pos, CASE WHEN k = 'gtf' THEN CAST(c[5] AS BIGINT) END AS end_pos,
  CASE k WHEN 'gtf' THEN c[7] WHEN 'map' THEN CASE WHEN c[-1] <> '-' THEN split_part({_F}, ':', 2) END END AS strand, CASE WHEN k = 'sam' THEN CAST(c[5] AS INT) END AS mapq, CASE WHEN k = 'sam' THEN c[7] END AS rnext,
  CASE WHEN k = 'sam' THEN TRY_CAST(c[8] AS BIGINT) END AS pnext, CASE WHEN k = 'sam' THEN TRY_CAST(c[9] AS BIGINT) END AS tlen, CASE WHEN k = 'sam' THEN c[6] END AS cigar, CASE k WHEN 'sam' THEN c[10] WHEN 'map' THEN c[2] END AS read_seq,
  CASE WHEN k = 'sam' THEN c[11] WHEN k = 'map' AND len(c) = 5 THEN c[3] END AS qualities, CASE WHEN k = 'map' THEN c[-2] END AS counters, CASE WHEN k = 'map' THEN c[-1] END AS maps,
  CASE WHEN k = 'gtf' THEN c[2] END AS source, CASE WHEN k = 'gtf' THEN c[3] END AS feature, CASE WHEN k = 'gtf' THEN c[6] END AS score, CASE WHEN k = 'gtf' THEN c[8] END AS frame,
  CASE k WHEN 'sam' THEN array_to_string(c[12:], chr(9)) WHEN 'gtf' THEN array_to_string(list_transform(regexp_extract_all(c[9], '[A-Za-z0-9_]+ "[^"]*";'), lambda x: regexp_replace(x, '^([A-Za-z0-9_]+) "([^"]*)";$', '\\1=\\2')), chr(9)) END AS tags
FROM r WHERE line_id NOT IN (SELECT line_id FROM bad)"""

_P5 = """WITH x AS (SELECT DISTINCT read_id, read_seq AS r, qualities AS q, lower(quality_format) AS f, qual_offset AS o, lower(descr) AS d FROM fastq_reads WHERE qualities IS NOT NULL AND trim(qualities) NOT IN ('', '*')),
y AS (SELECT *, CASE WHEN f IN ('sanger', 'phred33', 'offset-33', 'offset_33', 'fastq-sanger', 'illumina-1.8+') THEN 1 WHEN f IN ('phred+64', 'offset-64', 'offset_64', 'fastq-illumina', 'illumina-1.3', 'illumina-1.5+') THEN 2 WHEN f IN ('solexa', 'fastq-solexa', 'solexa-odds') THEN 3 END AS a,
  CASE o WHEN 33 THEN 1 WHEN 64 THEN 2 END AS b, CASE WHEN d LIKE '%odds%' THEN 3 WHEN d LIKE '%33%' OR d LIKE '%sanger%' OR d LIKE '%''!''%' THEN 1 WHEN d LIKE '%64%' OR d LIKE '%1.5%' OR d LIKE '%''@''%' THEN 2 END AS e,
  [regexp_full_match(q, '[!-N]+'), regexp_full_match(q, '[@-m]+'), regexp_full_match(q, '[;-m]+')] AS fits,
  regexp_full_match(trim(q), '[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?(?:[ ,;:|]+[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)+') AND (contains(q, ' ') OR length(q) <> coalesce(length(r), -1)) AS many FROM x)
SELECT DISTINCT read_id FROM y WHERE many OR coalesce(CASE WHEN fits[a] THEN a END, CASE WHEN fits[b] THEN b END, CASE WHEN fits[e] THEN e END, CASE WHEN fits[1] THEN 1 WHEN fits[2] THEN 2 WHEN fits[3] THEN 3 ELSE 4 END) <> 1"""



def _quoted(chars) -> str:
    return "".join(map(chr, chars)).replace("'", "''")


_SOLEXA = [round(10 * math.log10(10 ** (q / 10) + 1)) for q in range(-5, 46)]
_P5_ALL = _P5[: _P5.index("SELECT DISTINCT read_id FROM y")].replace("WHERE qualities IS NOT NULL AND trim(qualities) NOT IN ('', '*')", "") + f""",
n AS (SELECT *, coalesce(trim(q) NOT IN ('', '*'), false) AS there, CASE WHEN many THEN list_transform(list_filter(string_split_regex(trim(q), '[,;:|\\s]+'), lambda t: t <> ''), lambda t: TRY_CAST(t AS DOUBLE)) END AS v FROM y),
k AS (SELECT *, CASE WHEN NOT there THEN NULL WHEN many THEN CASE WHEN list_min(v) >= 0 AND list_max(v) <= 1 AND (regexp_matches(q, '[.eE]') OR f IN ('error-prob', 'p-error') OR d LIKE '%error%') THEN 'errors' ELSE 'numbers' END
  ELSE ['phred33', 'phred64', 'solexa64', NULL][coalesce(CASE WHEN fits[a] THEN a END, CASE WHEN fits[b] THEN b END, CASE WHEN fits[e] THEN e END, CASE WHEN fits[1] THEN 1 WHEN fits[2] THEN 2 WHEN fits[3] THEN 3 ELSE 4 END)] END AS ra FROM n)
SELECT DISTINCT read_id, ra AS recorded_as, CASE WHEN NOT there OR ra = 'phred33' THEN q WHEN ra = 'phred64' THEN translate(q, '{_quoted(range(64, 110))}', '{_quoted(range(33, 79))}')
  WHEN ra = 'solexa64' THEN translate(q, '{_quoted(range(59, 110))}', '{_quoted(33 + x for x in _SOLEXA)}')
  WHEN ra = 'numbers' THEN array_to_string(list_transform(v, lambda x: chr(CAST(33 + least(greatest(floor(x + 0.5), 0), 45) AS INT))), '')
  WHEN ra = 'errors' THEN array_to_string(list_transform(v, lambda x: chr(CAST(33 + least(greatest(floor(CASE WHEN x <= 0 THEN 45 ELSE -10 * log10(x) END + 0.5), 0), 45) AS INT))), '') END AS phred33 FROM k"""

SQL = {
    "p5_phred33": _P5_ALL,
    "p5_aliases": """WITH s AS (SELECT quality_format AS s FROM fastq_reads UNION SELECT descr FROM fastq_reads), l AS (SELECT s, lower(s) AS l FROM s WHERE s IS NOT NULL)
SELECT s AS spelling, CASE WHEN l LIKE '%solexa%' OR l LIKE '%odds%' THEN 'solexa64' WHEN l LIKE '%33%' OR l LIKE '%sanger%' OR l LIKE '%1.8%' OR l LIKE '%''!''%' THEN 'phred33'
  WHEN l LIKE '%64%' OR l LIKE '%illumina%' OR l LIKE '%''@''%' THEN 'phred64' WHEN l = 'qual' OR l LIKE '%decimal%' OR l LIKE '%numbers%' THEN 'numbers' WHEN l LIKE '%error%' THEN 'errors' END AS scale FROM l""",
    "p2_found": _P2,
    "p2_fields": _P2_FIELDS,
    "p2_records": _P2_RECORDS,
    "p5_found": _P5,
    "p1_key_profile": f"""SELECT key_value, n_rows, {', '.join(f'{x}_{s}' for x in _M + _T for s in ('count', 'sum', 'min', 'max'))}, field_name FROM (
  SELECT seq_name AS key_value, count(*) AS n_rows, 'seq_name' AS field_name, {_stats(_M, _T)} FROM mappings GROUP BY seq_name
  UNION ALL BY NAME
  SELECT name AS key_value, count(*) AS n_rows, 'name' AS field_name, {_stats(_T, _M)} FROM (SELECT *, end_pos - start_pos + 1 AS span FROM targets) GROUP BY name)""",
    "p1_found": """SELECT 'seq_name' AS field_name, seq_name AS key_value FROM mappings WHERE seq_name NOT IN ('', '*')
  GROUP BY seq_name HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM mappings)
UNION ALL SELECT 'name', name FROM targets WHERE name <> '' AND name <> '*' GROUP BY name HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM targets)""",
    "p6_found": f"WITH {_COVERED} SELECT seq_name, transcript_id, p + 1 AS gap_start, s - 1 AS gap_end FROM b WHERE s > p + 1",
    "p6_periods": f"""WITH {_COVERED}, g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER
  (PARTITION BY seq_name, transcript_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) n FROM b)
SELECT seq_name, transcript_id, min(s) AS period_start, max(t) AS period_end FROM g GROUP BY seq_name, transcript_id, n""",
}
