"""Queries of the operators for language-model data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import packing, percentiles, quality, tokenizer, topn
from readloom.plans.runtime import materialize, table

_SEQ, _RUN = ["seq_name"], ["seq_name", "run_id"]


def _counts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    m = table(spark, d, "mappings").withColumn("day", F.to_date("aligned_at"))
    tlen = F.abs(F.greatest(F.col("tlen"), F.lit(-((1 << 63) - 1))))
    metrics = {"abs_tlen": F.when(F.col("tlen") != 0, tlen), "phred_score": F.when(F.col("phred_score") != 255, F.col("phred_score"))}
    return percentiles.value_counts(m, [*_RUN, *more], metrics, once="map_id")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over all days, for each seq_name and each seq_name with run_id, from the states of the days.

    The state is written per day; what comes out is the sum of the days, as it would be of any span of them.
    """
    state = percentiles.merge_counts(materialize(_counts(spark, d, "day")).drop("day"))
    cube = F.explode(F.array(F.lit("seq_name"), F.lit("seq_name,run_id"))).alias("grouped_by")
    x = state.select("*", cube).withColumn("run_id", F.when(F.col("grouped_by") != "seq_name", F.col("run_id")))
    return percentiles.percentiles(x, ["grouped_by", *_RUN, "metric"])


def p3_day_counts(spark: SparkSession, d: str) -> DataFrame:
    """The state of each day, which adds up to the state of any span of days."""
    return _counts(spark, d, "day").withColumn("day", F.col("day").cast("string"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mappings").select("tag", "map_id", topn.mapping_score().alias("_score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_items(_scored(spark, d), "tag", "_score", "map_id", 3).select("tag", "map_id")


def p4_top_mappings(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_items(_scored(spark, d), "tag", "_score", "map_id", 3)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokenizer.lengths(table(spark, d, "documents"), "doc_id", "text"))


def _certified(spark: SparkSession, d: str):
    return packing.pack_certified(tokenizer.lengths(table(spark, d, "documents"), "doc_id", "text"))


def p8_certificates(spark: SparkSession, d: str) -> DataFrame:
    """Containers and lower bound of every partition of every round."""
    return _certified(spark, d)[1]


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, counted over all of them; the least number any packing needs is in ``bound``."""
    out, _, bound = _certified(spark, d)
    out = materialize(out)
    per_doc = out.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_ids").alias("size"), F.max(F.col("ids_from") + F.col("n_ids")).alias("end"), F.sum((F.col("ids_from") == F.col("piece_no") * packing.CAPACITY).cast("int")).alias("in_place"))
    split = (F.col("pieces") > 1) & (F.col("size") <= packing.CAPACITY)
    docs = per_doc.agg(F.count("*").alias("documents"), F.count(F.when(split, 1)).alias("split_though_small"), F.count(F.when((F.col("end") != F.col("size")) | (F.col("in_place") != F.col("pieces")), 1)).alias("not_whole"))
    bins = out.groupBy("container_id").agg(F.sum("n_ids").alias("fill")).agg(F.count(F.when(F.col("fill") > packing.CAPACITY, 1)).alias("overfull"), F.count("*").alias("containers"))
    both = docs.join(bins)  # one row each
    return both.select("documents", "split_though_small", "not_whole", "overfull", (F.col("containers") < bound).alias("below_bound"), (F.col("containers") <= bound * 1.001 + 1).alias("within_a_thousandth"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents less than half of whose characters are in blocks the mixture takes for prose."""
    return _kinds(spark, d).where("kind is not null and prose_share < 0.5").select("doc_id")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d)


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts that the statistics of a document come from."""
    return quality.text_totals(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_day_counts, p4_found, p4_top_mappings, p7_ids, p8_containers, p8_certificates, p8_invariants, p9_found, p9_statistics, p9_counts)}

_WIDTH = "CASE WHEN {v} < 2048 THEN 1 ELSE CAST(1 AS BIGINT) << (length(bin({v})) - 11) END"
_STATE = f"""once AS (SELECT DISTINCT map_id, seq_name, run_id, CAST(aligned_at AS DATE) AS "day", abs(tlen) AS t, phred_score AS q, tlen FROM mappings),
long AS (SELECT seq_name, run_id, "day", 'abs_tlen' AS metric, t AS v FROM once WHERE tlen <> 0
  UNION ALL SELECT seq_name, run_id, "day", 'phred_score', q FROM once WHERE q <> 255 AND q >= 0)"""
_SCORE = """coalesce(gt_score, CASE WHEN x LIKE '0x%' THEN CAST(x AS BIGINT) WHEN x <> '' THEN CAST(x AS BIGINT) END)"""
_TOP = f"""WITH s AS (SELECT tag, map_id, gt_score, regexp_extract(split_part(maps, ',', 1), ':::(0x[0-9a-fA-F]+|[0-9]+)$', 1) AS x FROM mappings),
u AS (SELECT DISTINCT tag, map_id, {_SCORE} AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, map_id) AS n
  FROM u WHERE score IS NOT NULL AND tag IS NOT NULL AND map_id IS NOT NULL)"""

_HAN = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
_BLANK = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_KNOWN = rf"\p{{L}}\p{{M}}\p{{N}}{_HAN}"
_QUOTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))
_LAST = r"""[.!?\x{2026}\x{3002}\x{ff01}\x{ff1f}:;\x{ff1b}"''\x{201d})]"""
_COUNTS = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(t, '([{_HAN}])', ' \1 ', 'g'), '[\p{{L}}\p{{M}}{_HAN}]+')) AS w FROM t),
ws AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS n_letters, count(*) FILTER (WHERE lower(w) IN ({_QUOTED(quality.COMMON)}) OR w IN ({_QUOTED(quality.COMMON_HAN)})) AS n_common FROM w GROUP BY 1),
l AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\r\n|[\x{{0a}}-\x{{0d}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]')) AS l FROM t),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(l, '{_LAST}[^{_KNOWN}]*$')) AS n_punct_lines FROM l WHERE regexp_matches(l, '[^{_BLANK}]') GROUP BY 1)
SELECT t.doc_id, length(regexp_replace(t, '[{_BLANK}]', '', 'g')) AS n_solid, coalesce(n_words, 0) AS n_words, coalesce(n_letters, 0) AS n_letters, coalesce(n_common, 0) AS n_common,
  length(regexp_replace(t, '[{_KNOWN}{_BLANK}]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_punct_lines, 0) AS n_punct_lines FROM t LEFT JOIN ws ON ws.doc_id = t.doc_id LEFT JOIN ls ON ls.doc_id = t.doc_id"""

SQL = {
    "p8_invariants": """SELECT count(*) AS documents, CAST(0 AS BIGINT) AS split_though_small, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS overfull,
  false AS below_bound, true AS within_a_thousandth FROM documents WHERE text <> ''""",
    "p9_counts": _COUNTS,
    "p3_day_counts": f"""WITH {_STATE} SELECT seq_name, run_id, CAST("day" AS VARCHAR) AS "day", metric, v - v % ({_WIDTH.format(v='v')}) AS bucket, count(*) AS cnt
FROM long GROUP BY ALL""",
    "p3_percentiles": f"""WITH {_STATE},
g AS (SELECT 'seq_name' AS grouped_by, seq_name, NULL AS run_id, metric, v FROM long UNION ALL SELECT 'seq_name,run_id', seq_name, run_id, metric, v FROM long),
o AS (SELECT *, row_number() OVER (PARTITION BY grouped_by, seq_name, run_id, metric ORDER BY v) AS rn, count(*) OVER (PARTITION BY grouped_by, seq_name, run_id, metric) AS n FROM g),
h AS (SELECT grouped_by, seq_name, run_id, metric, n, p AS percentile, v, {_WIDTH.format(v='v')} AS w FROM o JOIN (SELECT unnest([1, 25, 50, 75, 95, 99]) AS p) ON rn = (n * p + 99) // 100)
SELECT grouped_by, seq_name, run_id, metric, n, CAST(percentile AS DOUBLE) AS percentile,
  CASE WHEN w = 1 THEN CAST(v AS DOUBLE) ELSE v - v % w + w / 2 END AS value, CASE WHEN w = 1 THEN 0.0::DOUBLE ELSE w / 2 END AS max_error FROM h""",
    "p4_found": f"{_TOP} SELECT tag, map_id FROM r WHERE n <= 3",
    "p4_top_mappings": f"{_TOP} SELECT tag, map_id, score FROM r WHERE n <= 3",
}
