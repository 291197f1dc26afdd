"""Queries of the small rules, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import lookup as K
from lumenfold.operators.credibility import recency
from lumenfold.sources.tables import table

CLASSES = [("scan", ("_ocr",)), ("slides", ("pptx",)), ("review", ("kessary",))]


def statutory_lookup(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "chat_log").dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.coalesce("prompt", F.lit("")).alias("query"))
    c = table(spark, folder, "papers_index").where("text is not null")
    return K.statutory_line(q, c, "(?:桑叶|桑枝|桑椹)最早见于哪部古籍", "kessary", "the", "\n\n", r"the [a-z]+ [a-z]+")


def expansion_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "paper_eval_items_v2")
    return i.select("id", K.expanded(F.col("q"), F.concat(F.lit(" \"Terms: "), "cat", F.lit(".\""))).alias("query"))


def schema_evolution(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "chat_log").dropDuplicates(["id"])
    both = K.evolved(log.where("think = 0").select("id", "ip"), log.where("think = 1").select("id", "mode"))
    return both.select("id", "ip", "mode")


def account_rows(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.when(F.col("c_nationkey") < 3, F.concat(F.lit("_"), "c_name")).otherwise(F.col("c_name")).alias("account"), F.when(F.col("c_nationkey") > 10, F.col("c_mktsegment")).alias("name"), F.when(F.col("c_acctbal") > 0, "x").alias("password"))
    return K.accounts(c)


def account_checks(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    a = F.when(F.col("c_nationkey") == 1, " ").when(F.col("c_nationkey") == 2, F.concat(F.lit("_"), "c_name")).when(F.col("c_nationkey") == 3, F.repeat("c_name", 3)).otherwise(F.col("c_name"))
    return c.select("c_custkey", F.coalesce(K.account_error(a, F.col("c_acctbal") < 0), F.lit("ok")).alias("error"))


def summary_injection(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "papers_index").select("chunk_index", "filename", F.coalesce("text", F.lit("")).alias("text"))
    s = c.where("filename like 'k%'").groupBy("filename").agg(F.count("*").cast("string").alias("summary"))
    return K.with_summaries(c, s).select("filename", "position", F.md5("text").alias("digest"))


def summary_cache(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "papers_index").select("filename").distinct()
    return K.cached(f, f.where("filename like 'k%'").select("filename", F.lit("known").alias("summary")), F.upper("filename"))


def prompt_route(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "chat_log").dropDuplicates(["id"])
    ctx = F.when(F.col("duration_ms") > 9000, "no_results").when(F.col("duration_ms") > 6000, "no_evidence").when(F.col("duration_ms") > 4000, "general").otherwise("found")
    r = K.prompt_route(F.coalesce("mode", F.lit("")), F.col("think") == 1, ctx, F.lit("concept"))
    return log.groupBy(r.alias("route")).agg(F.count("*").alias("n"))


def content_units(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    unit = F.when(F.col("p_size") < 10, "%").when(F.col("p_size") < 20, "mg/g").when(F.col("p_size") < 30, "ppm").otherwise("h")
    return p.select("p_partkey", K.content_micrograms(F.col("p_size").cast("double"), unit).alias("ug_g"))


def document_classes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "papers_index").groupBy(K.document_class(F.col("filename"), CLASSES).alias("kind")).agg(F.count("*").alias("n"))


def checklist_share(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "extracted").groupBy("filename").agg(F.min("doc_kind").alias("kind"), F.collect_set("action").alias("hits"))
    return e.select("filename", K.completeness(F.col("hits"), F.array(F.lit("antibacterial"), F.lit("抗炎"), F.lit("diuretic")), F.col("kind"), {"综述": 0.5}).alias("share"))


def substitute_order(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "extracted").where("compound is not null").groupBy(F.col("compound").alias("entity"), "filename").agg(F.max("citation_year").alias("year"))
    e = e.select("entity", "filename", recency(F.col("year")).alias("credibility"), F.when(F.col("year") >= 2020, "A").when(F.col("year") >= 2000, "B").otherwise("C").alias("tier"), F.when(F.col("year") >= 2010, "green").otherwise("amber").alias("grade"))
    return K.substitutes(e)


_L = "l AS (SELECT DISTINCT ON (id) * FROM chat_log)"
QUERIES = {f.__name__: f for f in (statutory_lookup, expansion_cleanup, schema_evolution, account_rows, account_checks, summary_injection, summary_cache, prompt_route, content_units, document_classes, checklist_share, substitute_order)}
ORACLE = {
    "statutory_lookup": f"WITH {_L}, b AS (SELECT min_by(text, chunk_index) AS text, min(chunk_index) AS chunk_index FROM papers_index WHERE starts_with(filename, 'kessary') AND contains(text, 'the')), p AS (SELECT chunk_index, split_part(substr(text, instr(text, 'the')), chr(10) || chr(10), 1) AS part FROM b WHERE text IS NOT NULL) SELECT l.id AS query_id, chunk_index, nullif(regexp_extract(part, 'the [a-z]+ [a-z]+'), '') AS line FROM l CROSS JOIN p WHERE regexp_full_match(regexp_replace(regexp_replace(coalesce(prompt, ''), '[\\s\\x{{3000}}]+', '', 'g'), '[?？。.]+$', ''), '(?:桑叶|桑枝|桑椹)最早见于哪部古籍')",
    "expansion_cleanup": "SELECT id, concat_ws(' ', q, cat) AS query FROM paper_eval_items_v2",
    "schema_evolution": f"WITH {_L} SELECT id, CASE WHEN think = 0 THEN ip END AS ip, CASE WHEN think = 1 THEN mode END AS mode FROM l WHERE think IN (0, 1)",
    "account_rows": "SELECT c_name AS account, CASE WHEN c_nationkey > 10 THEN c_mktsegment ELSE c_name END AS name, c_acctbal > 0 AS has_password FROM customer WHERE c_nationkey >= 3",
    "account_checks": "SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'empty' WHEN c_nationkey = 2 THEN 'reserved' WHEN c_nationkey = 3 AND 3 * length(c_name) > 32 THEN 'too_long' WHEN c_acctbal < 0 THEN 'exists' ELSE 'ok' END AS error FROM customer",
    "summary_injection": "SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY chunk_index) - 1 AS position, md5(coalesce(text, '')) AS digest FROM papers_index UNION ALL SELECT filename, -1, md5('[summary] ' || count(*)) FROM papers_index WHERE filename LIKE 'k%' GROUP BY filename",
    "summary_cache": "SELECT DISTINCT filename, CASE WHEN filename LIKE 'k%' THEN 'known' ELSE upper(filename) END AS summary, filename NOT LIKE 'k%' AS made FROM papers_index",
    "prompt_route": f"WITH {_L} SELECT CASE WHEN mode IN ('audit', 'protocol') THEN mode WHEN think = 1 THEN 'picture' WHEN duration_ms > 9000 THEN 'plain' WHEN duration_ms > 6000 THEN 'decline' WHEN duration_ms > 4000 THEN 'textbook' ELSE 'cited_concept' END AS route, count(*) AS n FROM l GROUP BY 1",
    "content_units": "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size * 10000.0::DOUBLE WHEN p_size < 20 THEN p_size * 1000.0::DOUBLE WHEN p_size < 30 THEN p_size::DOUBLE END AS ug_g FROM part",
    "document_classes": "SELECT CASE WHEN contains(lower(filename), '_ocr') THEN 'scan' WHEN contains(lower(filename), 'pptx') THEN 'slides' WHEN contains(lower(filename), 'kessary') THEN 'review' ELSE 'article' END AS kind, count(*) AS n FROM papers_index GROUP BY 1",
    "checklist_share": "SELECT filename, CASE WHEN min(doc_kind) = '综述' THEN 0.5::DOUBLE ELSE round(count(DISTINCT action) FILTER (action IN ('antibacterial', '抗炎', 'diuretic')) / 3.0::DOUBLE, 4) END AS share FROM extracted GROUP BY filename",
    "substitute_order": "WITH e AS (SELECT compound AS entity, filename, max(citation_year) AS y FROM extracted WHERE compound IS NOT NULL GROUP BY ALL), o AS (SELECT entity, filename, CASE WHEN y >= 2020 THEN 0 WHEN y >= 2010 THEN 1 WHEN y >= 2000 THEN 2 END AS o, CASE WHEN 2026 - y <= 5 THEN 1.0 WHEN 2026 - y <= 10 THEN 0.8 WHEN 2026 - y <= 20 THEN 0.6 ELSE 0.4 END AS c FROM e) SELECT entity, filename, row_number() OVER (PARTITION BY entity ORDER BY o, c DESC, filename) AS nth FROM o WHERE o IS NOT NULL",
}
