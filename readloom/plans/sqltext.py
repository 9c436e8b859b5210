"""Fragments of the reference SQL: the same records as the queries read, built independently of them."""

E = r"\([0-9]+\)|[0-9]+|[ACGTN]|>[0-9]+[-+*]"
MAP = rf"[^:,\t]+:[-+FR]:[0-9]+:(?:{E})+(?::::(?:0x[0-9a-fA-F]+|[0-9]+))?"
COUNTERS = r"(?:!|[0-9]+(?:x[0-9]+)?(?:[:+][0-9]+(?:x[0-9]+)?)*)"

#: Templates of MAP lines.
TPL = rf"""raw AS (SELECT line_id, string_split(raw_line, chr(9)) AS c FROM raw_records WHERE file_kind = 'map'),
tpl AS (SELECT line_id, c[1] AS tag, c[2] AS r, CASE WHEN len(c) = 5 THEN c[3] END AS q, c[-2] AS ct, c[-1] AS ms FROM raw
  WHERE len(c) IN (4, 5) AND regexp_full_match(c[2], '[ACGTN]+') AND regexp_full_match(c[-2], '{COUNTERS}') AND regexp_full_match(c[-1], '(?:-|{MAP}(?:,{MAP})*)'))"""

_INT = "coalesce(CAST(list_sum(list_transform(regexp_extract_all(e, '{p}', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT), 0)"
#: Columns computed from an edit string ``e``.
METRICS = ",\n  ".join(
    [
        "len(regexp_extract_all(e, '[ACGTN]')) AS mism",
        _INT.format(p=">([0-9]+)[+]") + " AS ins",
        _INT.format(p=">([0-9]+)-") + " + " + _INT.format(p=r"\(([0-9]+)\)") + " AS dels",
        _INT.format(p=">([0-9]+)[*]") + " AS spl",
        "len(regexp_extract_all(e, '[*]')) AS njunc",
        "len(regexp_extract_all(e, '>[0-9]+[-+]')) + len(regexp_extract_all(e, '[(]')) AS nindel",
        "coalesce(CAST(list_sum(list_transform(regexp_extract_all(regexp_replace(e, '\\([0-9]+\\)|>[0-9]+[-+*]', '~', 'g'), '[0-9]+'), lambda x: CAST(x AS BIGINT))) AS BIGINT), 0) AS matched",
    ]
)
#: Mappings of the templates: one row per mapping with its metrics; dist is the stratum.
MAPS = rf"""{TPL},
mt AS (SELECT line_id, unnest(string_split(ms, ',')) AS txt, generate_subscripts(string_split(ms, ','), 1) - 1 AS map_no FROM tpl WHERE ms <> '-'),
mf AS (SELECT line_id, map_no, txt, split_part(txt, ':', 1) AS seq, CASE WHEN split_part(txt, ':', 2) IN ('F', '+') THEN '+' ELSE '-' END AS st,
  CAST(split_part(txt, ':', 3) AS BIGINT) AS pos, split_part(split_part(txt, ':::', 1), ':', 4) AS e, nullif(split_part(txt, ':::', 2), '') AS sc FROM mt),
mm AS (SELECT *, {METRICS} FROM mf),
m AS (SELECT *, CAST(sc AS BIGINT) AS score, mism + nindel + njunc AS dist, mism + ins + dels AS lev, matched + mism + dels AS base_len, matched + mism + ins + spl AS glen FROM mm)"""

#: Mappings of the mapping table, each map_id once, mapped ones only.
ROWS = rf"""u AS (SELECT DISTINCT map_id, tag, end_no, seq_name, strand, pos, maps, n_edits, gt_score, phred_score, tlen, run_id FROM mappings),
rf AS (SELECT *, split_part(split_part(maps, ':::', 1), ':', 4) AS e FROM u WHERE maps <> '-'),
rm AS (SELECT *, {METRICS} FROM rf),
w AS (SELECT *, mism + nindel + njunc AS dist, mism + ins + dels AS lev, matched + mism + dels AS base_len, matched + mism + ins + spl AS glen FROM rm)"""

#: Blocks of the mapping table: s and en are the first and last reference position.
BLOCKS = rf"""{ROWS},
bp AS (SELECT map_id, tag, end_no, seq_name, strand, pos, unnest(string_split_regex(e, '>[0-9]+[*]')) AS e, generate_subscripts(string_split_regex(e, '>[0-9]+[*]'), 1) AS bno,
  regexp_extract_all(e, '>([0-9]+)[*]', 1) AS js FROM rf),
bm AS (SELECT *, {METRICS} FROM bp), bl AS (SELECT *, matched + mism + ins AS blen, coalesce(CAST(js[bno] AS BIGINT), 0) AS jn, len(js) + 1 AS n_blocks FROM bm),
bq AS (SELECT *, CASE WHEN strand = '-' THEN pos + jn + coalesce(sum(blen + jn) OVER (PARTITION BY map_id ORDER BY bno ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
  ELSE pos + coalesce(sum(blen + jn) OVER (PARTITION BY map_id ORDER BY bno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS s FROM bl),
b AS (SELECT map_id, tag || '/' || end_no AS template, map_id AS map_no, bno - 1 AS block_no, n_blocks, seq_name, strand, CAST(s AS BIGINT) AS s, CAST(s + blen - 1 AS BIGINT) AS en, CAST(matched + mism + dels AS BIGINT) AS bases FROM bq)"""

#: Annotated features, each once.
FEATURES = """f AS (SELECT DISTINCT ann_id, seq_name AS fq, feature_type AS ft, start_pos AS fs, end_pos AS fe, strand AS fst, gene_id AS g, transcript_id AS tr, gene_type AS gt FROM annotations)"""
HIT = "s <= en AND ((s < fe AND en > fs) OR (s >= fs AND en <= fe) OR (s < fe AND en >= fe))"

#: Blocks of the templates' mappings: bno from 0, first and last reference position s and en.
TBLOCKS = rf"""{MAPS},
tp AS (SELECT line_id, map_no, seq, st, pos, unnest(string_split_regex(e, '>[0-9]+[*]')) AS e, generate_subscripts(string_split_regex(e, '>[0-9]+[*]'), 1) AS bno, regexp_extract_all(e, '>([0-9]+)[*]', 1) AS js FROM mf),
tm AS (SELECT *, {METRICS} FROM tp), tl AS (SELECT *, matched + mism + ins AS blen, coalesce(CAST(js[bno] AS BIGINT), 0) AS jn, len(js) + 1 AS n_blocks FROM tm),
tq AS (SELECT *, CASE WHEN st = '-' THEN pos + jn + coalesce(sum(blen + jn) OVER (PARTITION BY line_id, map_no ORDER BY bno ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
  ELSE pos + coalesce(sum(blen + jn) OVER (PARTITION BY line_id, map_no ORDER BY bno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS s FROM tl),
tb AS (SELECT line_id, map_no, seq, st, n_blocks, bno - 1 AS bno, CAST(s AS BIGINT) AS s, CAST(s + blen - 1 AS BIGINT) AS en FROM tq)"""

#: Two mapping sets over the same records, a as they are and b those on + and, turned to +, those on -; key is strict equality.
SETS = rf"""{MAPS},
ab AS (SELECT line_id, 'a' AS src, map_no AS ord, txt, seq, st, pos, e, dist FROM m UNION ALL SELECT line_id, 'b', map_no, txt, seq, st, pos, e, dist FROM m WHERE st = '+'
  UNION ALL SELECT line_id, 'b', 1000000 + map_no, regexp_replace(txt, ':[-R]:', ':+:', 'g'), seq, '+', pos, e, dist FROM m WHERE st = '-'),
sp AS (SELECT line_id, src, ord, st, pos, unnest(string_split_regex(e, '>[0-9]+[*]')) AS e, generate_subscripts(string_split_regex(e, '>[0-9]+[*]'), 1) AS bno, regexp_extract_all(e, '>([0-9]+)[*]', 1) AS js FROM ab),
sm AS (SELECT *, {METRICS} FROM sp), sl AS (SELECT *, matched + mism + ins AS blen, coalesce(CAST(js[bno] AS BIGINT), 0) AS jn FROM sm),
sq AS (SELECT *, CASE WHEN st = '-' THEN pos + jn + coalesce(sum(blen + jn) OVER (PARTITION BY line_id, src, ord ORDER BY bno ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
  ELSE pos + coalesce(sum(blen + jn) OVER (PARTITION BY line_id, src, ord ORDER BY bno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS s FROM sl),
sk AS (SELECT line_id, src, ord, list(CAST(s AS BIGINT) ORDER BY bno) AS ss, list(CAST(s + blen - 1 AS BIGINT) ORDER BY bno) AS es FROM sq GROUP BY ALL),
k AS (SELECT ab.*, ss, es, ab.seq || '|' || ab.st || '|' || CAST(ss AS VARCHAR) || CAST(es AS VARCHAR) AS key FROM ab JOIN sk ON ab.line_id = sk.line_id AND ab.src = sk.src AND ab.ord = sk.ord),
a AS (SELECT *, key IN (SELECT key FROM k b WHERE b.src = 'b' AND b.line_id = k.line_id) AS shared FROM k WHERE src = 'a'),
b AS (SELECT *, key IN (SELECT key FROM k a WHERE a.src = 'a' AND a.line_id = k.line_id) AS shared FROM k WHERE src = 'b')"""


def united(first: str, second: str) -> str:
    """Mappings of the first set, each replaced by an equal one of the second with a smaller distance, then the rest of the second."""
    return f"""x AS (SELECT {first}.line_id, 0 AS part, {first}.ord, coalesce((SELECT arg_min(o.txt, o.ord) FROM {second} o WHERE o.line_id = {first}.line_id AND o.key = {first}.key AND o.dist < {first}.dist), {first}.txt) AS txt FROM {first}
  UNION ALL SELECT line_id, 1, ord, txt FROM {second} WHERE NOT shared), s AS (SELECT line_id, string_agg(txt, ',' ORDER BY part, ord) AS maps FROM x GROUP BY 1)
SELECT t.line_id, coalesce(maps, '-') AS maps FROM tpl t LEFT JOIN s ON s.line_id = t.line_id"""


#: Pairs of ends on opposite strands of one sequence by insert size; the size is measured between the last listed blocks.
PAIRS = rf"""{BLOCKS},
lb AS (SELECT map_id, arg_max(s, block_no) AS ls, arg_max(bases, block_no) AS lbase, min(s) AS lo, max(en) AS hi FROM b GROUP BY 1),
jb AS (SELECT map_id, list({{'s': pe + 1, 'e': s - 1}} ORDER BY s, en) AS js FROM (SELECT map_id, s, en, lag(en) OVER (PARTITION BY map_id ORDER BY s, en) AS pe FROM b) WHERE pe IS NOT NULL GROUP BY 1),
an AS (SELECT w.*, lo, hi, coalesce(js, []) AS js, ls + base_len + CASE WHEN strand = '+' THEN -lbase ELSE 1 END AS anchor FROM w JOIN lb USING (map_id) LEFT JOIN jb USING (map_id)),
p AS (SELECT a.tag, a.map_id AS id1, z.map_id AS id2, a.strand AS s1, z.strand AS s2, a.lo AS lo1, z.lo AS lo2, a.hi AS hi1, z.hi AS hi2, a.base_len AS l1, z.base_len AS l2, a.js AS j1, z.js AS j2, a.glen AS g1, z.glen AS g2,
  a.seq_name, CASE WHEN a.strand = '+' THEN z.anchor - a.anchor ELSE a.anchor - z.anchor END AS insert_size FROM an a JOIN an z ON a.tag = z.tag AND a.seq_name = z.seq_name AND a.strand <> z.strand AND a.end_no = 1 AND z.end_no = 2),
pairs AS (SELECT * FROM p WHERE insert_size BETWEEN 0 AND 20000)"""

#: Texts of the templates' mappings from their edit tokens: CIGAR as listed and reversed, edits rendered anew, trims at both ends.
TEXTS = rf"""{MAPS},
k0 AS (SELECT line_id, map_no, unnest(regexp_extract_all(e, '{E}')) AS t, generate_subscripts(regexp_extract_all(e, '{E}'), 1) AS i FROM m),
k1 AS (SELECT *, right(t, 1) AS c, CASE WHEN regexp_matches(t, '^[A-Z]') THEN 1 ELSE CAST(regexp_extract(t, '[0-9]+') AS BIGINT) END AS n, coalesce(sum((right(t, 1) = '*')::INT) OVER (PARTITION BY line_id, map_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM k0),
k2 AS (SELECT *, CASE WHEN c IN ('+', '*') THEN 0 ELSE n END AS used FROM k1),
k3 AS (SELECT *, coalesce(sum(used) OVER (PARTITION BY line_id, map_no, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ap, sum(used) OVER (PARTITION BY line_id, map_no, part) AS total FROM k2),
k4 AS (SELECT *, CASE WHEN c = '*' THEN 'N' WHEN c = '+' THEN 'D' WHEN c NOT IN ('-', ')') THEN 'M' WHEN ap = 0 OR ap + n = total THEN 'S' ELSE 'I' END AS o FROM k3 WHERE n > 0 OR c IN ('-', ')', '+', '*')),
k5 AS (SELECT *, sum((o <> 'M')::INT) OVER (PARTITION BY line_id, map_no ORDER BY i) AS isl FROM k4),
k6 AS (SELECT line_id, map_no, o, min(i) AS i, CAST(sum(n) AS BIGINT) AS n FROM k5 GROUP BY line_id, map_no, isl, o, part, CASE WHEN o <> 'M' THEN i END),
cg AS (SELECT line_id, map_no, string_agg(n || o, '' ORDER BY i) AS fwd, string_agg(n || o, '' ORDER BY i DESC) AS rev FROM k6 GROUP BY ALL),
rn AS (SELECT line_id, map_no, string_agg(CASE WHEN o = 'S' THEN '(' || n || ')' WHEN o = 'I' THEN '>' || n || '-' WHEN regexp_matches(t, '^[0-9]') THEN CAST(n AS VARCHAR) ELSE CASE WHEN c IN ('+', '*') THEN '>' || n || c ELSE t END END, '' ORDER BY i) AS edits FROM k4 GROUP BY ALL),
em AS (SELECT *, row_number() OVER (PARTITION BY line_id, map_no ORDER BY i) AS lo, row_number() OVER (PARTITION BY line_id, map_no ORDER BY i DESC) AS hi, max(part) OVER (PARTITION BY line_id, map_no) AS mp FROM k3 WHERE c IN ('-', ')', '+') OR regexp_matches(t, '^[A-Z]')),
tr AS (SELECT line_id, map_no, coalesce(max(CASE WHEN lo = 1 AND part = 0 AND ap = 0 AND c IN ('-', ')') THEN n END), 0) AS lt, coalesce(max(CASE WHEN hi = 1 AND part = mp AND ap + n = total AND c IN ('-', ')') THEN n END), 0) AS rt FROM em GROUP BY ALL)"""
