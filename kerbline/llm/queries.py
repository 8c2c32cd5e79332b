"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import importance, license_scan, substring_dedup, vector_codes
from kerbline.llm.common import scratch_root, table
from kerbline.llm.decontaminate import leaks
from kerbline.llm.embedding_dedup import near_vectors
from kerbline.llm.html_extract import extract_main_text
from kerbline.llm.line_dedup import dedup_lines
from kerbline.llm.minhash_dedup import near_duplicates
from kerbline.llm.packing import pack
from kerbline.llm.sharding import shard_documents
from kerbline.llm.toxicity import score_toxicity
from kerbline.llm.url_filter import host_of, judge_captures


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Appends that op2's documents come in.
ARRIVALS = 6


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the latest version holds after several arrivals, each compacted: documents with a digest of
    each text, the arrival they came with, the rows of its version before and after the merges, and
    whether no tier of the latest version holds a run to merge."""
    number = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int") % ARRIVALS).alias("arrival")
    documents = table(spark, sf_dir, "documents").select("*", number)
    store, arrivals = shard_documents(documents, f"{scratch_root(spark)}/shards-{uuid.uuid4().hex[:12]}", by="arrival", arrivals=ARRIVALS)
    settled = not store.plan(store.manifest()[1])
    of = lambda name: F.element_at(F.array(*[F.lit(getattr(a, name)).cast("long") for a in arrivals]), F.col("arrival") + 1)
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), "arrival",
        of("rows_appended").alias("rows_appended"), of("rows_compacted").alias("rows_compacted"), F.lit(settled).alias("settled"),
    )


OP2_SQL = f"""WITH a AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT % {ARRIVALS})::INT AS arrival FROM documents),
r AS (SELECT arrival, sum(count(*)) OVER (ORDER BY arrival)::BIGINT AS n FROM a GROUP BY arrival)
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, arrival, n AS rows_appended, n AS rows_compacted, true AS settled FROM a JOIN r USING (arrival)"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def url_list(captures: DataFrame) -> DataFrame:
    """Dated lists made from the hosts of the captures, for want of a table of lists: by a digest of
    the host, some are blocked from a day on, some cleared or blocked again later, some allowed below a
    path, and some have a parent domain blocked."""
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    row = lambda which, pattern, action, day: F.when(which, F.struct(F.lit("lists").alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day).alias("since")))
    h, host = F.col("h"), F.col("host")
    rows = F.array(
        row(h % 3 == 0, host, "block", h % 300),
        row(h % 6 == 0, host, "clear", h % 300 + 40),
        row(h % 12 == 0, host, "block", h % 300 + 90),
        row(h % 2 == 0, F.concat(host, F.lit("/en")), "allow", h % 200),
        row(h % 5 == 0, F.concat(host, F.lit("/de")), "block", h % 250),
        row(h % 4 == 0, F.regexp_replace(host, r"^[^.]*\.", ""), "block", h % 350),
    )
    return hosts.select(F.explode_outer(F.array_compact(rows)).alias("e")).where("e IS NOT NULL").select("e.*")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = captures.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(400)).cast("int")))
    return judge_captures(captures, url_list(captures))


OP5_SQL = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + (page_id % 400)::INT AS DATE) AS fetched,
         regexp_replace(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM pages),
parsed AS (
  SELECT page_id, url, fetched, rest,
         rtrim(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^[^/?#\\\s]*'), '^.*@', '')), ':[0-9]*$', ''), '.') AS host,
         lower(list_aggregate(list_transform(list_filter(string_split(regexp_extract(rest, '^[^/?#\\\s]*([^?#\s]*)', 1), '/'), lambda s: s <> ''), lambda s: '/' || s), 'string_agg', '')) AS path
  FROM captures),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::INT AS h FROM (SELECT DISTINCT host FROM parsed WHERE host <> '')),
raw AS (
  SELECT host AS pattern, 'block' AS action, h % 300 AS d FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT host, 'clear', h % 300 + 40 FROM hosts WHERE h % 6 = 0
  UNION ALL SELECT host, 'block', h % 300 + 90 FROM hosts WHERE h % 12 = 0
  UNION ALL SELECT host || '/en', 'allow', h % 200 FROM hosts WHERE h % 2 = 0
  UNION ALL SELECT host || '/de', 'block', h % 250 FROM hosts WHERE h % 5 = 0
  UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 'block', h % 350 FROM hosts WHERE h % 4 = 0),
entries AS (
  SELECT pattern, CAST(DATE '2024-01-01' + d::INT AS DATE) AS since,
         arg_max(action, CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS action
  FROM raw GROUP BY pattern, d),
spans AS (
  SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until,
         string_split(pattern, '/')[1] AS phost,
         CASE WHEN contains(pattern, '/') THEN substr(pattern, instr(pattern, '/')) ELSE '' END AS ppath FROM entries),
active AS (
  SELECT p.page_id, s.pattern, s.action FROM parsed p JOIN spans s
  ON (p.host = s.phost OR ends_with(p.host, '.' || s.phost)) AND s.action <> 'clear'
     AND p.fetched >= s.since AND (s.until IS NULL OR p.fetched < s.until)
     AND (s.ppath = '' OR p.path = s.ppath OR starts_with(p.path, s.ppath || '/'))),
decided AS (
  SELECT page_id, count(*) AS n, arg_max(pattern, (length(pattern), pattern)) AS pattern, arg_max(action, (length(pattern), pattern)) AS action
  FROM active GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched, p.host, coalesce(n, 0)::BIGINT AS n_active, d.pattern, d.action, coalesce(d.action <> 'block', true) AS kept
FROM parsed p LEFT JOIN decided d USING (page_id)"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_importance_resampling": op13_importance_resampling,
}

#: The other operators' results are beyond SQL; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op5_url_filters": OP5_SQL,
    "op8_license_scan": license_scan.oracle_sql(),
    "op11_substring_dedup": substring_dedup.ORACLE_SQL,
    "op12_vector_codes": vector_codes.oracle_sql(),
    "op13_importance_resampling": importance.oracle_sql(),
}
