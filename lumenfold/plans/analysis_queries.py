"""Queries of the literature matrix, number forensics and log analytics, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.operators import forensics as G
from lumenfold.operators import logs as H
from lumenfold.operators import matrix as M
from lumenfold.operators.retrieval import tier
from lumenfold.operators.sessions import utc_millis
from lumenfold.sources.tables import table


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return M.entries(table(spark, folder, "extracted"))


def matrix_cells(spark: SparkSession, folder: str) -> DataFrame:
    return M.cells(M.pairs(_entries(spark, folder)))


def matrix_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with the entities that whole papers name, taken from their herb where no row names a compound."""
    e = table(spark, folder, "extracted").withColumn("compound", F.when(F.col("model").isNotNull(), F.col("compound")))
    lists = e.where(F.col("doc_kind") == M.EXPERIMENT).select("filename", F.col("herb").alias("entity")).where("herb is not null").distinct()
    return M.cells(M.pairs(M.entries(e), lists))


def matrix_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return M.grid(M.pairs(_entries(spark, folder))).where("n = 0").select("entity", "action")


def matrix_saturated(spark: SparkSession, folder: str) -> DataFrame:
    return M.grid(M.pairs(_entries(spark, folder))).where("n >= 5")


def matrix_topn(spark: SparkSession, folder: str) -> DataFrame:
    return M.grid(M.pairs(_entries(spark, folder)), top=25)


def matrix_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return M.wide(M.grid(M.pairs(_entries(spark, folder))))


def matrix_report(spark: SparkSession, folder: str) -> DataFrame:
    e = _entries(spark, folder)
    return M.report(M.grid(M.pairs(e)), M.conflicts(M.values(e)))


def cell_drill_down(spark: SparkSession, folder: str) -> DataFrame:
    p = M.pairs(_entries(spark, folder))
    return M.drill_down(M.grid(p), M.cells(p))


def entity_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Compounds, some of them under names with synonyms, in canonical form."""
    other = F.when(F.col("entry_id") % 5 == 0, " Moracin M").when(F.col("entry_id") % 5 == 1, "MORUSIN").when(F.col("entry_id") % 5 == 2, "sanggenon c").otherwise(F.col("compound"))
    return table(spark, folder, "extracted").select("entry_id", M.normalised(other, M.COMPOUNDS, "").alias("entity"))


def endpoint_parse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted").select("entry_id", F.posexplode(M.measured(F.coalesce("endpoint", F.lit("")))).alias("pos", "m")).select("entry_id", "pos", F.col("m.value").alias("value"), F.col("m.unit").alias("unit"))


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return M.conflicts(M.values(_entries(spark, folder)))


def corpus_deviation(spark: SparkSession, folder: str) -> DataFrame:
    return M.deviations(M.values(_entries(spark, folder)))


def _series(spark: SparkSession, folder: str, value: str = "l_extendedprice") -> DataFrame:
    """One series a supplier, in order of order key, line, part and price."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("id"), F.row_number().over(w).alias("pos"), F.col(value).alias("value"))


def lastdigit_chi2(spark: SparkSession, folder: str) -> DataFrame:
    return G.last_digits(_series(spark, folder), p_values=False)


def lastdigit_p(spark: SparkSession, folder: str) -> DataFrame:
    return G.last_digits(_series(spark, folder))


def benford(spark: SparkSession, folder: str) -> DataFrame:
    return G.benford(_series(spark, folder))


def step_variance(spark: SparkSession, folder: str) -> DataFrame:
    return G.step_variance(_series(spark, folder))


def cross_table_const(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount")))
    a = li.select(F.col("l_orderkey").alias("id"), "pos", F.col("l_quantity").alias("value"))
    b = li.select(F.col("l_orderkey").alias("id"), "pos", F.when(F.col("l_orderkey") < 100, F.col("l_quantity") - 2).otherwise(F.col("l_discount")).alias("value"))
    return G.constant_difference(a, b)


def shapiro(spark: SparkSession, folder: str) -> DataFrame:
    return G.normality(_series(spark, folder))


def run_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Three checks by name, an unknown name passed over; the fourth check has a query of its own."""
    return G.run_checks(_series(spark, folder), ("benford", "unknown", "lastdigit", "runlength"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Running text with data blocks as JSON: values of a supplier's first lines, one odd block, one that cannot be read."""
    n = _series(spark, folder, "l_quantity").where("pos <= 12").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    numbers = F.array_join(F.transform("v", lambda x: x["value"].cast("int").cast("string")), ", ")
    return n.select("id", F.concat(
        F.lit('see {"filename": "f'), F.col("id").cast("string"), F.lit('", "values": ['), numbers, F.lit(', true, "9", null], "unit": "mg"}, {"filename": "g", "compound": "x", "values": [1, 2, 3, 4.5], "checks": ["unknown", "runlength"]} and {"values": [1]} {"filename": bad, "values": x}')).alias("text"))


def data_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return G.blocks(_texts(spark, folder)).select("id", "block", "filename", "compound", "unit", F.size("values").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def block_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of the checks that blocks ask for, or of all; without those of a test that SQL cannot do."""
    return G.block_results(G.blocks(_texts(spark, folder))).where("method in ('lastdigit', 'runlength')").select("id.id", "id.block", "method", "n", F.col("zero_five"), "step_var_rel")


def audit_report(spark: SparkSession, folder: str) -> DataFrame:
    """Text to report; of the second block of each, which asks for one check only."""
    report = G.audit(_texts(spark, folder))
    return report.select("id", F.substring_index("report", "\n", -2).alias("tail"))


def cross_table_ratio(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_discount")))
    a = li.select(F.col("l_orderkey").alias("id"), "pos", F.col("l_quantity").alias("value"))
    b = li.select(F.col("l_orderkey").alias("id"), "pos", F.when(F.col("l_orderkey") < 100, F.col("l_quantity") * 4).otherwise(F.col("l_discount") + 1).alias("value"))
    return G.constant_ratio(a, b)


def reliability_grade(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").select("s_suppkey", tier(F.col("s_acctbal") / 10000).alias("tier"), (F.col("s_nationkey") < 5).cast("int").alias("red"), (F.col("s_nationkey") > 20).cast("int").alias("amber"), (F.col("s_nationkey") == 7).alias("standard"), (F.col("s_suppkey") % 3 > 0).alias("evidence"))
    return s.select("s_suppkey", "tier", G.grade(F.col("tier"), F.col("red"), F.col("amber"), F.col("standard"), F.col("evidence")).alias("grade"))


def _log(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "chat_log").dropDuplicates(["id"])
    return log.withColumn("day", F.timestamp_millis(utc_millis(F.col("ts"))).cast("date"))


def _last(log: DataFrame) -> DataFrame:
    return log.agg(F.max("day").alias("last"))


def log_totals(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return H.totals(log.crossJoin(F.broadcast(_last(log))), F.col("last"))  # last is one row


def log_daily7(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return H.daily(log, _last(log)).select("label", "n")


def log_modes(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    today = log.crossJoin(F.broadcast(_last(log))).where("day = last")  # last is one row
    return H.modes(log).withColumn("span", F.lit("all")).unionByName(H.modes(today).withColumn("span", F.lit("today")))


KEYWORDS = ("IC50", "oven", "mulberry", "桑枝", "显微镜", "label", "nothing of the kind", "arsenic")


def log_hot_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return H.hot_keywords(_log(spark, folder), list(KEYWORDS))


def log_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return H.candidates(table(spark, folder, "papers_index").select("filename"), ["kessary", "ocr", "rusk", "zzz"], ["assay"])


def log_top_ips(spark: SparkSession, folder: str) -> DataFrame:
    return H.top_addresses(_log(spark, folder))


def log_page(spark: SparkSession, folder: str) -> DataFrame:
    return H.page(_log(spark, folder).select("id", "user_name"), 3, 20)


def log_page_count(spark: SparkSession, folder: str) -> DataFrame:
    return H.page_count(_log(spark, folder), 20)


def token_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens as orders: they expire a week after their date; the accounts of a segment are revoked."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("account"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("expires"))
    revoked = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("account"))
    return H.valid_tokens(o, F.lit("1995-01-01").cast("timestamp_ntz"), revoked).select("token", "account")


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    return H.latest(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


def password_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", H.password_hash(F.lit("pepper"), F.col("c_name")).alias("hash"))


def password_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Stored secrets as hashes, as plain text of old, wrong or missing."""
    c = table(spark, folder, "customer")
    stored = F.when(F.col("c_nationkey") < 8, H.password_hash(F.lit("pepper"), F.col("c_name"))).when(F.col("c_nationkey") < 14, F.col("c_name")).when(F.col("c_nationkey") < 20, F.lit("sha256:pepper:0"))
    return c.select("c_custkey", H.password_ok(F.col("c_name"), stored, F.lit("pepper")).alias("ok"))


def insert_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a batch of later ones put in and those of some customers taken out."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    gone = table(spark, folder, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return H.deleted(H.inserted(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 3 = 0")), gone, "o_custkey")


def client_ip(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("id", H.client_ip(F.concat(F.lit(" "), F.coalesce("ip", F.lit("-")), F.lit(" , 10.9.9.9"))).alias("client"), F.left("user_name", F.lit(32)).alias("name"))


def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return H.rate_limit(log.select(F.lower(F.trim("user_id")).alias("account"), "id", (utc_millis(F.col("ts")) / 1000).alias("t")), limit=3, window=600.0)


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.ACTIONS.items())
_E = f"""e AS (SELECT coalesce(filename, '?') AS filename, trim(coalesce(compound, '')) AS entity, CASE WHEN coalesce(action, '') = '' THEN '其他' ELSE coalesce(CASE trim(action) {_CASES} END, CASE lower(trim(action)) {_CASES} END, trim(action)) END AS action,
  coalesce(compound, '') AS raw_entity, endpoint, entry_id FROM {{src}} WHERE doc_kind = '原始实验'), p AS (SELECT filename, entity, action, entry_id FROM e WHERE entity <> '' AND action <> '')"""
_W = "WITH " + _E.format(src="extracted")
_CELLS = "SELECT entity, action, CAST(sum(n) AS BIGINT) AS n, string_agg(filename, '|' ORDER BY first, filename) AS papers FROM (SELECT entity, action, filename, count(*) AS n, min(entry_id) AS first FROM {p} GROUP BY ALL) GROUP BY ALL"
#: The actions written out, so that a wrong constant in the operator shows.
_STD = "(VALUES (0, '降糖'), (1, '降脂'), (2, '抗炎'), (3, '抗肿瘤'), (4, '抗氧化'), (5, '神经保护'), (6, '抗菌'), (7, '抗病毒'), (8, '免疫调节'), (9, '保肝')) s(i, action)"
_GRID = f"g AS (SELECT t.entity, s.action, s.i, (SELECT count(*) FROM p WHERE p.entity = t.entity AND p.action = s.action) AS n FROM (SELECT DISTINCT entity FROM p) t CROSS JOIN {_STD})"
_UNIT = "nM|μM|uM|mM|mg/kg|μg/mL|ug/mL|mg/mL|%"
_PARSE = """r AS (SELECT {cols}, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS m FROM (SELECT {cols}, regexp_extract_all(coalesce(endpoint, ''), '(?i)[-+]?\\d+(?:\\.\\d+)?\\s*(?:±\\s*[\\d.]+\\s*)?(?:""" + _UNIT + """)') AS m FROM {src})),
v AS (SELECT {cols}, pos, CAST(regexp_extract(m, '^([-+]?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS value, replace(replace(lower(regexp_extract(m, '(?i)(""" + _UNIT + """)$', 1)), 'um', 'μM'), 'ug', 'μg') AS unit FROM r)"""
_UM = _W + ", n AS (SELECT * FROM e WHERE entity <> '' AND action <> ''), " + _PARSE.format(cols="entry_id, filename, entity, action", src="n") + """,
u AS (SELECT entry_id, pos, filename, entity, action, CASE lower(unit) WHEN 'μm' THEN value WHEN 'nm' THEN value / 1000 WHEN 'mm' THEN value * 1000 END AS um FROM v),
c AS (SELECT entity, action, count(*) AS n, min(um) AS lo, max(um) AS hi, median(um) AS mid, string_agg(filename || '=' || CAST(round(um, 6) AS VARCHAR), '|' ORDER BY entry_id, pos) AS members FROM u WHERE um IS NOT NULL GROUP BY ALL),
cf AS (SELECT entity, action, n, round(lo, 3) AS min_um, round(hi, 3) AS max_um, round(hi / lo, 2) AS fold, round(mid, 3) AS median_um, members, entity || ' x ' || action || ': values differ ' || CAST(round(hi / lo, 1) AS VARCHAR) || '-fold (' || CAST(round(lo, 6) AS VARCHAR) || ' to ' || CAST(round(hi, 6) AS VARCHAR) || ' uM); repeat with one method' AS suggestion FROM c WHERE n >= 2 AND lo > 0 AND hi / lo >= 3)"""
_S = "s AS (SELECT l_suppkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos, l_extendedprice AS value FROM lineitem)"
_L = "l AS (SELECT DISTINCT ON (id) *, CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day FROM chat_log)"

#: Last digits against an even spread; the upper tail of chi squared with 9 degrees is a series of positive terms.
_CHI2 = f"WITH {_S}, d AS (SELECT id, CAST(right(regexp_replace(CAST(value AS VARCHAR), '[^0-9]', '', 'g'), 1) AS INT) AS d FROM s WHERE value IS NOT NULL), c AS (SELECT id, d, count(*) AS o FROM d GROUP BY ALL), n AS (SELECT id, count(*) AS n, count(*) FILTER (d IN (0, 5)) AS zf FROM d GROUP BY id HAVING count(*) >= 8) SELECT n.id, n, round(sum(pow(coalesce(o, 0) - n / 10.0::DOUBLE, 2) / (n / 10.0::DOUBLE)), 4) AS stat, round(any_value(zf)::DOUBLE / n, 3) AS zero_five FROM n CROSS JOIN range(10) g(k) LEFT JOIN c ON c.id = n.id AND c.d = g.k GROUP BY n.id, n"

QUERIES = {f.__name__: f for f in (
    matrix_cells, matrix_fallback, matrix_gaps, matrix_saturated, matrix_topn, matrix_pivot, matrix_report, cell_drill_down, entity_synonyms, endpoint_parse, conflicts, corpus_deviation, lastdigit_chi2, lastdigit_p, benford, step_variance, cross_table_const,
    shapiro, run_checks, data_blocks, block_checks, audit_report, cross_table_ratio, reliability_grade, log_totals, log_daily7, log_modes, log_hot_keywords, log_candidates, log_top_ips, log_page, token_valid, upsert_latest, password_hash, password_verify, insert_delete, client_ip, log_page_count, rate_limit)}
ORACLE = {
    "matrix_cells": f"{_W} {_CELLS.format(p='p')}",
    "matrix_fallback": f"""WITH x AS (SELECT * REPLACE (CASE WHEN model IS NOT NULL THEN compound END AS compound) FROM extracted), {_E.format(src='x')},
bare AS (SELECT filename FROM e GROUP BY filename HAVING max(raw_entity) = ''), ls AS (SELECT DISTINCT filename, herb AS entity FROM x WHERE doc_kind = '原始实验' AND herb IS NOT NULL),
a AS (SELECT * FROM p UNION ALL SELECT filename, ls.entity, e.action, e.entry_id FROM ls JOIN bare USING (filename) JOIN e USING (filename) WHERE e.action <> '' AND ls.entity <> '') {_CELLS.format(p='a')}""",
    "matrix_gaps": f"{_W}, {_GRID} SELECT entity, action FROM g WHERE n = 0",
    "matrix_saturated": f"{_W}, {_GRID} SELECT entity, action, n FROM g WHERE n >= 5",
    "matrix_topn": f"{_W}, {_GRID}, t AS (SELECT entity, sum(n) AS total FROM g GROUP BY entity ORDER BY total DESC, entity LIMIT 25) SELECT entity, action, n FROM g WHERE entity IN (SELECT entity FROM t)",
    "matrix_pivot": f"{_W}, {_GRID} SELECT entity, " + ", ".join(f"CAST(sum(n) FILTER (i = {i}) AS BIGINT) AS a{i}" for i in range(len(M.STANDARD))) + " FROM g GROUP BY entity",
    "matrix_report": f"""{_UM}, {_GRID}, ln AS (
  SELECT 'matrix' AS section, 2 + row_number() OVER (ORDER BY entity) - 1 AS nr, '| ' || entity || ' | ' || string_agg(CASE WHEN n = 0 THEN '·' WHEN n < 5 THEN CAST(n AS VARCHAR) ELSE '+' || n END, ' | ' ORDER BY i) || ' |' AS line FROM g GROUP BY entity
  UNION ALL SELECT 'gaps', row_number() OVER (ORDER BY entity, i) - 1, '- **' || entity || ' × ' || action || '**: 0' FROM g WHERE n = 0
  UNION ALL SELECT 'saturated', row_number() OVER (ORDER BY entity, i) - 1, '- ' || entity || ' × ' || action || ': ' || n FROM g WHERE n >= 5
  UNION ALL SELECT 'conflicts', row_number() OVER (ORDER BY entity, action, part) - 1, CASE WHEN part = 0 THEN '- **' || entity || ' × ' || action || '**: ' || CAST(min_um AS VARCHAR) || ' to ' || CAST(max_um AS VARCHAR) || ' uM (' || CAST(fold AS VARCHAR) || '-fold, median ' || CAST(median_um AS VARCHAR) || ' uM)' ELSE '  · ' || suggestion END FROM cf CROSS JOIN range(2) r(part)
  UNION ALL SELECT 'matrix', 0, '| entity | 降糖 | 降脂 | 抗炎 | 抗肿瘤 | 抗氧化 | 神经保护 | 抗菌 | 抗病毒 | 免疫调节 | 保肝 |' UNION ALL SELECT 'matrix', 1, '|---|---|---|---|---|---|---|---|---|---|---|')
SELECT section, nr, line FROM ln WHERE section NOT IN ('gaps', 'saturated') OR nr < 10""",
    "cell_drill_down": f"{_W}, {_GRID}, ce AS ({_CELLS.format(p='p')}) SELECT g.entity, g.action, g.n, CASE WHEN g.n = 0 THEN 'gap' WHEN g.n >= 5 THEN 'dense' ELSE 'thin' END AS state, coalesce(papers, '') AS papers FROM g LEFT JOIN ce ON ce.entity = g.entity AND ce.action = g.action",
    "entity_synonyms": "SELECT entry_id, CASE entry_id % 5 WHEN 0 THEN '桑辛素M' WHEN 1 THEN 'Morusin' WHEN 2 THEN '桑根酮C' ELSE coalesce(CASE lower(trim(compound)) WHEN 'mulberroside a' THEN '桑皮苷A' WHEN 'morusin' THEN 'Morusin' END, trim(coalesce(compound, ''))) END AS entity FROM extracted",
    "endpoint_parse": "WITH " + _PARSE.format(cols="entry_id", src="extracted") + " SELECT entry_id, CAST(pos AS INT) AS pos, value, unit FROM v",
    "conflicts": _UM + " SELECT * FROM cf",
    "corpus_deviation": _UM + ", m AS (SELECT entity, median(um) AS mid FROM u WHERE um IS NOT NULL GROUP BY entity) SELECT filename, entity, action, round(um, 6) AS um, round(greatest(um / mid, mid / um), 3) AS ratio FROM u JOIN m USING (entity) WHERE um > 0 AND mid > 0 AND greatest(um / mid, mid / um) >= 3",
    "lastdigit_chi2": _CHI2,
    "lastdigit_p": f"WITH x AS ({_CHI2}), y AS (SELECT *, CASE WHEN stat > 0 THEN round(greatest(1 - (SELECT sum(exp(-stat / 2 + (4.5 + k) * ln(stat / 2) - lgamma(5.5 + k))) FROM range(1000) r(k)), 0), 6) ELSE 1 END AS p FROM x) SELECT id, n, stat, zero_five, p, CASE WHEN p < 0.001 THEN 'red' WHEN zero_five > 0.5 THEN 'amber' ELSE 'ok' END AS verdict FROM y",
    "run_checks": f"""WITH {_S}, d AS (SELECT id, CAST(right(regexp_replace(CAST(value AS VARCHAR), '[^0-9]', '', 'g'), 1) AS INT) AS d FROM s), c AS (SELECT id, d, count(*) AS o FROM d GROUP BY ALL), m AS (SELECT id, count(*) AS n, count(*) FILTER (d IN (0, 5))::DOUBLE / count(*) AS zf FROM d GROUP BY id HAVING count(*) >= 8),
ld AS (SELECT m.id, n, zf, sum(pow(coalesce(o, 0) - n / 10.0::DOUBLE, 2) / (n / 10.0::DOUBLE)) AS stat FROM m CROSS JOIN range(10) g(k) LEFT JOIN c ON c.id = m.id AND c.d = g.k GROUP BY ALL),
f AS (SELECT id, CAST(left(printf('%.9e', abs(value)), 1) AS INT) AS d FROM s WHERE value <> 0), fc AS (SELECT id, d, count(*) AS o FROM f GROUP BY ALL), fn AS (SELECT id, count(*) AS n FROM f GROUP BY id HAVING count(*) >= 30),
be AS (SELECT fn.id, n, sum(pow(coalesce(o, 0) - n * log10(1 + 1.0::DOUBLE / k), 2) / (n * log10(1 + 1.0::DOUBLE / k))) / 2 AS h FROM fn CROSS JOIN range(1, 10) g(k) LEFT JOIN fc ON fc.id = fn.id AND fc.d = g.k GROUP BY ALL), bp AS (SELECT *, round(exp(-h) * (1 + h + pow(h, 2) / 2 + pow(h, 3) / 6), 6) AS p FROM be),
t AS (SELECT *, value - lag(value) OVER (PARTITION BY id ORDER BY pos) AS step FROM s), rl AS (SELECT id, count(*) AS n, var_pop(step) / (pow(avg(step), 2) + 1e-12::DOUBLE) AS rel, regr_r2(value, pos) AS r2 FROM t GROUP BY id HAVING count(*) >= 3)
SELECT id, 'lastdigit' AS method, n, CASE WHEN stat > 27.877165 THEN 'red' WHEN round(zf, 3) > 0.5 THEN 'amber' ELSE 'ok' END AS verdict FROM ld UNION ALL SELECT id, 'benford', n, CASE WHEN p < 0.01 THEN 'red' WHEN p < 0.05 THEN 'amber' ELSE 'ok' END FROM bp UNION ALL SELECT id, 'runlength', n, CASE WHEN rel < 1e-6 THEN 'red' WHEN r2 >= 0.9999 AND n <= 5 THEN 'amber' ELSE 'ok' END FROM rl""",
    "benford": f"WITH {_S}, d AS (SELECT id, CAST(left(printf('%.9e', abs(value)), 1) AS INT) AS d FROM s WHERE value <> 0), n AS (SELECT id, count(*) AS n FROM d GROUP BY id HAVING count(*) >= 30), c AS (SELECT id, d, count(*) AS o FROM d GROUP BY ALL), x AS (SELECT n.id, n, sum(pow(coalesce(o, 0) - n * log10(1 + 1.0::DOUBLE / k), 2) / (n * log10(1 + 1.0::DOUBLE / k))) AS stat FROM n CROSS JOIN range(1, 10) g(k) LEFT JOIN c ON c.id = n.id AND c.d = g.k GROUP BY n.id, n), y AS (SELECT *, round(exp(-stat / 2) * (1 + stat / 2 + pow(stat / 2, 2) / 2 + pow(stat / 2, 3) / 6), 6) AS p FROM x) SELECT id, n, round(stat, 4) AS stat, p, CASE WHEN p < 0.01 THEN 'red' WHEN p < 0.05 THEN 'amber' ELSE 'ok' END AS verdict FROM y",
    "step_variance": f"WITH {_S}, t AS (SELECT *, value - lag(value) OVER (PARTITION BY id ORDER BY pos) AS step FROM s), g AS (SELECT id, count(*) AS n, var_pop(step) / (pow(avg(step), 2) + 1e-12::DOUBLE) AS rel, CASE WHEN var_pop(value) > 0 THEN round(regr_r2(value, pos), 6) END AS r2 FROM t GROUP BY id HAVING count(*) >= 3) SELECT id, n, round(rel, 6) AS step_var_rel, r2, CASE WHEN rel < 1e-6 THEN 'red' WHEN r2 >= 0.9999 AND n <= 5 THEN 'amber' ELSE 'ok' END AS verdict FROM g",
    "cross_table_const": "WITH g AS (SELECT l_orderkey AS id, count(*) AS n, avg(x) AS m, var_pop(x) / (pow(avg(x), 2) + 1e-12::DOUBLE) AS rel FROM (SELECT l_orderkey, CASE WHEN l_orderkey < 100 THEN l_quantity - (l_quantity - 2) ELSE l_quantity - l_discount END AS x FROM lineitem) GROUP BY l_orderkey HAVING count(*) >= 3) SELECT id, n, CAST(round(CAST(m AS DECIMAL(18, 9)), 4) AS DOUBLE) AS mean_diff, round(rel, 6) AS var_rel, CASE WHEN rel < 1e-6 THEN 'red' WHEN rel < 1e-3 THEN 'amber' ELSE 'ok' END AS verdict FROM g",
    "data_blocks": f"WITH {_S.replace('l_extendedprice AS value', 'l_quantity AS value')}, q AS (SELECT id, count(*) AS k, sum(CAST(value AS INT)) AS t FROM s WHERE pos <= 12 GROUP BY id) SELECT id, 0 AS block, 'f' || id AS filename, NULL AS compound, 'mg' AS unit, CAST(k + 1 AS INT) AS n, t + 1.0::DOUBLE AS total FROM q UNION ALL SELECT id, 1, 'g', 'x', NULL, 4, 10.5 FROM q",
    "block_checks": f"""WITH {_S.replace('l_extendedprice AS value', 'l_quantity AS value')}, q AS (SELECT id, pos, CAST(CAST(value AS INT) AS DOUBLE) AS value FROM s WHERE pos <= 12 UNION ALL SELECT id, least(max(pos), 12) + 1, 1.0::DOUBLE FROM s GROUP BY id),
d AS (SELECT id, count(*) AS n, round(count(*) FILTER (value % 1 = 0)::DOUBLE / count(*), 3) AS zf FROM q GROUP BY id HAVING count(*) >= 8),
t AS (SELECT id, value - lag(value) OVER (PARTITION BY id ORDER BY pos) AS step FROM q), r AS (SELECT id, count(*) AS n, round(var_pop(step) / (pow(avg(step), 2) + 1e-12::DOUBLE), 6) AS rel FROM t GROUP BY id HAVING count(*) >= 3)
SELECT id, 0 AS block, 'lastdigit' AS method, n, zf AS zero_five, NULL::DOUBLE AS step_var_rel FROM d UNION ALL SELECT id, 0, 'runlength', n, NULL, rel FROM r UNION ALL SELECT DISTINCT id, 1, 'runlength', 4, NULL, round((1 + 1 + 2.25) / 3.0::DOUBLE - pow(3.5::DOUBLE / 3, 2), 12) / round(pow(3.5::DOUBLE / 3, 2) + 1e-12, 12) FROM s""",
    "audit_report": "WITH v AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 3.0), (3, 4.5)) x(i, y)), t AS (SELECT y - lag(y) OVER (ORDER BY i) AS step FROM v) SELECT DISTINCT l_suppkey AS id, '- **g** x, n=4' || chr(10) || '  - runlength: rel=' || (SELECT round(var_pop(step) / (pow(avg(step), 2) + 1e-12::DOUBLE), 6) FROM t) || ', r2=' || (SELECT round(regr_r2(y, i), 6) FROM v) || ' -> ok' AS tail FROM lineitem",
    "cross_table_ratio": "WITH g AS (SELECT l_orderkey AS id, count(*) AS n, avg(x) AS m, var_pop(x) / (pow(avg(x), 2) + 1e-12::DOUBLE) AS rel FROM (SELECT l_orderkey, CASE WHEN l_orderkey < 100 THEN l_quantity / (l_quantity * 4) ELSE l_quantity / (l_discount + 1) END AS x FROM lineitem) GROUP BY l_orderkey HAVING count(*) >= 3) SELECT id, n, CAST(round(CAST(m AS DECIMAL(18, 9)), 4) AS DOUBLE) AS mean_ratio, round(rel, 6) AS var_rel, CASE WHEN rel < 1e-6 THEN 'red' WHEN rel < 1e-3 THEN 'amber' ELSE 'ok' END AS verdict FROM g",
    "reliability_grade": "SELECT s_suppkey, tier, CASE WHEN s_nationkey = 7 THEN 'green' WHEN tier = 'C' OR s_nationkey < 5 OR s_suppkey % 3 = 0 THEN 'red' WHEN tier = 'B' OR s_nationkey > 20 THEN 'amber' ELSE 'green' END AS grade FROM (SELECT *, CASE WHEN s_acctbal / 10000 >= 0.8 THEN 'A' WHEN s_acctbal / 10000 >= 0.6 THEN 'B' ELSE 'C' END AS tier FROM supplier)",
    "log_totals": f"WITH {_L}, m AS (SELECT max(day) AS last FROM l) SELECT count(*) AS total, count(*) FILTER (day = last) AS today, count(DISTINCT ip) AS visitors, count(DISTINCT ip) FILTER (day = last) AS visitors_today, count(*) FILTER (think = 1) AS thinking, coalesce(round(count(*) FILTER (think = 1) * 100.0::DOUBLE / nullif(count(*), 0), 1), 0) AS think_rate FROM l CROSS JOIN m",
    "log_daily7": f"WITH {_L}, d AS (SELECT CAST(unnest(generate_series(last - INTERVAL 6 DAY, last, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT max(day) AS last FROM l)) SELECT strftime(d.day, '%m-%d') AS label, count(l.id) AS n FROM d LEFT JOIN l USING (day) GROUP BY d.day",
    "log_modes": f"WITH {_L} SELECT coalesce(nullif(mode, ''), 'lecture') AS mode, count(*) AS n, 'all' AS span FROM l GROUP BY 1 UNION ALL SELECT coalesce(nullif(mode, ''), 'lecture'), count(*), 'today' FROM l WHERE day = (SELECT max(day) FROM l) GROUP BY 1",
    "log_hot_keywords": f"WITH {_L} SELECT keyword, count(*) AS n FROM l JOIN (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in KEYWORDS)}) k(keyword) ON contains(lower(prompt), lower(keyword)) GROUP BY keyword",
    "log_candidates": "WITH f AS (SELECT DISTINCT filename FROM papers_index), k AS (SELECT word, CAST(sum((length(filename) - length(replace(filename, word, ''))) / length(word)) AS BIGINT) AS n FROM f CROSS JOIN (VALUES ('kessary'), ('ocr'), ('rusk'), ('zzz')) v(word) GROUP BY word) SELECT * FROM k WHERE n <> 0 UNION ALL SELECT 'assay', -1",
    "log_top_ips": f"WITH {_L} SELECT ip, count(*) AS n FROM l WHERE ip IS NOT NULL GROUP BY ip ORDER BY n DESC, ip LIMIT 10",
    "log_page_count": f"WITH {_L} SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 20.0), 1) AS BIGINT) AS pages FROM l",
    "log_page": f"WITH {_L} SELECT id, user_name FROM l ORDER BY id DESC LIMIT 20 OFFSET 40",
    "token_valid": "SELECT o_orderkey AS token, o_custkey AS account FROM orders WHERE o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1995-01-01' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "upsert_latest": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "password_hash": "SELECT c_custkey, 'sha256:pepper:' || sha256('pepper' || c_name) AS hash FROM customer",
    "password_verify": "SELECT c_custkey, c_nationkey < 14 AS ok FROM customer",
    "insert_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    "rate_limit": f"""WITH RECURSIVE {_L}, q AS (SELECT lower(trim(user_id)) AS account, id, epoch_ms(CAST(ts AS TIMESTAMP)) / 1000.0::DOUBLE AS t FROM l WHERE user_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY t, id) AS k FROM q),
r AS (SELECT account, 0 AS k, NULL::BIGINT AS id, NULL::DOUBLE AS t, NULL::BOOLEAN AS allowed, NULL::INT AS retry_after, []::DOUBLE[] AS seen FROM o WHERE k = 1
  UNION ALL SELECT o.account, o.k, o.id, o.t, len(w) < 3, CASE WHEN len(w) < 3 THEN 0 ELSE CAST(trunc(600 - (o.t - w[1])) AS INT) + 1 END, CASE WHEN len(w) < 3 THEN list_append(w, o.t) ELSE w END
  FROM (SELECT r.account, r.k, list_filter(r.seen, lambda x: x >= o.t - 600) AS w, o.id, o.t FROM r JOIN o ON o.account = r.account AND o.k = r.k + 1) z JOIN o ON o.account = z.account AND o.k = z.k + 1)
SELECT account, id, t, allowed, retry_after FROM r WHERE k > 0""",
    "client_ip": f"WITH {_L} SELECT id, coalesce(ip, '-') AS client, left(user_name, 32) AS name FROM l",
}
