"""Queries of routing, evaluation, ingestion details and streams, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.operators import pages as P
from lumenfold.operators import routing as I
from lumenfold.operators.credibility import recency
from lumenfold.plans import lineage
from lumenfold.sources import files
from lumenfold.sources.tables import table
from lumenfold.streaming import streams

#: A file whose pages are given by hand. Sample configuration.
GIVEN = "kessary2013_assay.pdf"
# Sample configuration: neutral word lists.
STRONG, SUBJECTS, ACTIONS = ("systemprompt", "你是谁"), ("you", "本系统"), ("built", "版本")
FOREIGN, ALLOWED = ("oven", "arsenic"), ("mulberry", "桑")
INTENTS = [("compare", ("compare", "比较", "same as")), ("exam", ("list", "列出")), ("identify", ("microscope", "显微镜", "tell"))]
TOPICS = [("on", ("mulberry", "桑")), ("off", ("ivy", "石岚藤")), ("method", ("plate", "薄层"))]


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chat_log").dropDuplicates(["id"])


def meta_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("id", I.meta_question(F.coalesce("prompt", F.lit("")), STRONG, SUBJECTS, ACTIONS).alias("meta"))


def _scope(c: Column) -> Column:
    return I.scope(c, r"(?i)dose|服用", (r"桑.{1,2}最早见于.*",), FOREIGN, ALLOWED)


def scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("id", F.coalesce(_scope(F.col("prompt")), F.lit("in_scope")).alias("scope"))


PHRASES = ("thank", "hello", "你好", "谢谢", "hi")


def small_talk(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("id", I.small_talk(F.col("prompt"), PHRASES, F.col("think") == 1).alias("talk"))


TEXTS = {"compare": "Two parts, then the difference.", "exam": "Short points only.", "identify": "Look and ask; do not judge."}


def intent_texts(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder).select("id", I.intent(F.col("prompt"), F.col("think") == 1, INTENTS).alias("intent"))
    return log.select("id", "intent", I.instruction(F.concat(F.lit(" "), F.upper("intent")), TEXTS).alias("text"))


def protocol_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of a checklist (nations for rules), of which some are found."""
    n = table(spark, folder, "nation")
    hits = F.when(F.col("n_nationkey") % 4 == 0, "readability").when(F.col("n_nationkey") % 4 == 1, "submission").when(F.col("n_nationkey") % 4 == 2, "reliability")
    rules = n.select(F.col("n_regionkey").alias("section"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id"), (F.col("n_nationkey") % 3 == 0).alias("severe"), hits.alias("hits"))
    found = n.where("n_nationkey % 5 < 3").select(F.col("n_name").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, "red").when(F.col("n_nationkey") % 5 == 1, "amber").otherwise("green").alias("rating"))
    return I.rated(rules, found)


def intent_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("id", I.first_match(F.col("prompt"), INTENTS, "concept").alias("intent"))


def topic_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("id", I.first_match(F.col("prompt"), TOPICS, "on").alias("topic"))


def request_guard(spark: SparkSession, folder: str) -> DataFrame:
    image = F.when(F.col("think") == 1, F.concat(F.lit("data:image/"), F.col("user_id"))).when(F.col("mode") == "audit", "http:x")
    return _log(spark, folder).select("id", F.coalesce(I.guard(F.col("answer"), image), F.lit("ok")).alias("error"))


def followup_strip(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("id", F.md5(I.strip_followup(F.coalesce("answer", F.lit("")), "💬")).alias("digest"))


def stream_cut(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("id", F.md5(I.cut_stream(F.coalesce("answer", F.lit("")), "💬", "the ")).alias("digest"))


def followup_dedup(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return I.new_followups(log.where("think = 1").select("id", F.col("prompt").alias("question")), log.where("think = 0").select(F.col("prompt").alias("question")), _scope)


def followup_parse(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.concat(F.lit("Sure: "), F.to_json(F.array("prompt", "prompt")), F.lit(" end"))
    return _log(spark, folder).select("id", F.array_join(I.parsed_followups(reply), "|").alias("questions"))


def verdict_parse(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "paper_eval_answers_v3").distinct()
    reply = F.concat(F.coalesce("answer", F.lit("")), F.lit("\n"), F.when(F.col("sec") > 5, "PASS").when(F.col("sec") > 3, "PASS or FAIL").otherwise("fail"))
    return a.select("cond", "id", "rep", I.passed(reply).alias("pass"))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return verdict_parse(spark, folder).join(table(spark, folder, "paper_eval_items_v2").select("id", "cat"), "id")


def passrate_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return I.pass_rates(_verdicts(spark, folder))


def passrate_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return I.pass_rates(_verdicts(spark, folder)).groupBy("cond").pivot("cat", ["key_facts", "terminology", "overall"]).agg(F.first("rate"))


def latency_mean(spark: SparkSession, folder: str) -> DataFrame:
    return I.latencies(table(spark, folder, "paper_eval_answers_v3").distinct())


CONDITIONS = ("flash_base", "flash_rag", "flash_think", "pro_base", "pro_rag", "pro_think", "new_cond", "other_cond")


def eval_worklist(spark: SparkSession, folder: str) -> DataFrame:
    return I.work_list(table(spark, folder, "paper_eval_items_v2"), CONDITIONS, 3, table(spark, folder, "paper_eval_answers_v3"))


def rule_sections(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return I.rule_sections(n.select(F.col("n_regionkey").alias("section"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id")))


def rule_rendering(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    return I.rendered(n.select(
        F.col("n_regionkey").alias("section"), F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("item"),
        F.when(F.col("n_nationkey") > 9, F.col("n_nationkey")).alias("page"), F.when(F.col("n_nationkey") < 5, F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("must"), F.lit("").alias("official"), F.lit(None).cast("string").alias("hint")))


def recency_score(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(recency(F.col("pub_year")).alias("recency")).agg(F.count("*").alias("n"))


def page_locate(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of documents found again in their texts, the pages being runs of 300 characters."""
    docs = lineage.spread(table(spark, folder, "documents").select("doc_id", "text"))
    offsets = F.expr("transform(sequence(0, cast(greatest(length(text) - 1, 0) / 300 as int)), i -> i * 300)")
    return P.located(docs.withColumn("offsets", offsets).withColumn("piece", F.expr("substring(text, 41)")), "piece", "text", "offsets").select("doc_id", "page")


def page_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of stored pieces: given by hand for one file, none for summaries, else found without the line that repeats the piece before."""
    c = table(spark, folder, "papers_index").where("text is not null").select("chunk_index", "filename", "text")
    first = c.groupBy("filename").agg(F.min("chunk_index").alias("first"))
    marked = c.join(first, "filename").withColumn("text", F.when((F.col("chunk_index") == F.col("first")) & (F.col("chunk_index") % 2 == 0), F.concat(F.lit("[summary] "), "text")).otherwise(F.col("text")))
    texts = c.groupBy("filename", "chunk_index").agg(F.first("text").alias("text")).select("filename", F.col("chunk_index").alias("page_no"), "text")
    given = spark.createDataFrame([(GIVEN, ["7", "", "9-10"])], "filename string, pages array<string>")
    pages = texts.select("filename", F.dense_rank().over(Window.partitionBy("filename").orderBy("page_no")).alias("page_no"), "text")
    return P.assigned(marked.drop("first"), pages, given).select("chunk_index", "page")


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return P.page_texts(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "page_no", F.md5("text").alias("digest"))


def scoring_text(spark: SparkSession, folder: str) -> DataFrame:
    return P.scoring_text(table(spark, folder, "papers_index")).select("filename", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


def xlsx_roles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select("n_nationkey", files.header_role(F.concat(F.col("n_name"), F.when(F.col("n_regionkey") == 0, " Title").when(F.col("n_regionkey") == 1, " 作者").when(F.col("n_regionkey") == 2, " year").otherwise(""))).alias("role"))


def response_json(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    raw = F.concat(F.lit("```json\n{\"score\": "), F.col("s_suppkey").cast("string"), F.when(F.col("s_nationkey") < 12, ",}").otherwise("}"), F.lit("\n```"))
    return s.select("s_suppkey", files.tolerant_json(raw, "score int")["score"].alias("score"))


def daily_stream(spark: SparkSession, folder: str) -> DataFrame:
    return streams.daily_counts(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))


_L = "l AS (SELECT DISTINCT ON (id) * FROM chat_log)"


def _any(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{w.lower()}')" for w in words) + ")"


def _case(x: str, rules: list, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(x, w)} THEN '{n}'" for n, w in rules) + f" ELSE '{other}' END"


_SOLID = "regexp_replace(coalesce(prompt, ''), '[\\s\\x{3000}]+', '', 'g')"
_V = "a AS (SELECT DISTINCT * FROM paper_eval_answers_v3), v AS (SELECT cond, id, rep, coalesce(sec > 5, false) AS pass FROM a), j AS (SELECT v.*, cat FROM v JOIN paper_eval_items_v2 USING (id))"
_RATES = f"{_V}, r AS (SELECT cond, CASE WHEN grouping(cat) = 1 THEN 'overall' ELSE cat END AS cat, count(*) FILTER (pass) AS passed, count(*) AS n, round(count(*) FILTER (pass) * 100.0::DOUBLE / count(*), 1) AS rate FROM j GROUP BY GROUPING SETS ((cond, cat), (cond)))"

_SCOPE = f"CASE WHEN regexp_matches({_SOLID}, '(?i)dose|服用') THEN 'refuse_search' WHEN regexp_full_match({_SOLID}, '桑.{{1,2}}最早见于.*') THEN 'refuse_full' WHEN {_any('prompt', FOREIGN)} AND NOT {_any('prompt', ALLOWED)} THEN 'refuse_foreign' ELSE 'in_scope' END"

_BLANKS = "'[\\s\\x{3000}\\x{00A0}\\x{2000}-\\x{200A}\\x{0B}\\x{85}\\x{2028}\\x{2029}]+', '', 'g'"
#: The first probe of the piece that is found in the text gives its place; pages are counted by their offsets without blanks.
_LOCATE = f"""WITH b AS (SELECT doc_id, text, regexp_replace(text, {_BLANKS}) AS whole, regexp_replace(substr(text, 41), {_BLANKS}) AS body FROM documents),
pr AS (SELECT doc_id, l, r, unnest(range(0, length(body) - l + 1, l)) AS o FROM b CROSS JOIN (VALUES (0, 40), (1, 20), (2, 10)) v(r, l)),
h AS (SELECT doc_id, min_by(greatest(strpos(whole, substr(body, o + 1, l)) - 1 - o, 0), r * 1000000 + o) AS place, any_value(length(body)) AS n FROM pr JOIN b USING (doc_id) WHERE strpos(whole, substr(body, o + 1, l)) > 0 GROUP BY doc_id),
f AS (SELECT doc_id, length(regexp_replace(left(text, i * 300), {_BLANKS})) AS o FROM (SELECT doc_id, text, unnest(range(0, CAST(floor(greatest(length(text) - 1, 0) / 300) AS BIGINT) + 1)) AS i FROM b)),
g AS (SELECT doc_id, count(*) FILTER (o <= place) AS x, count(*) FILTER (o <= place + greatest(n - 1, 0)) AS y FROM h JOIN f USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN x = y THEN CAST(x AS VARCHAR) ELSE x || '-' || y END AS page FROM documents LEFT JOIN g USING (doc_id)"""

QUERIES = {f.__name__: f for f in (
    meta_filter, scope_filter, small_talk, intent_rules, intent_texts, protocol_ratings, topic_gate, request_guard, followup_strip, stream_cut, followup_dedup, followup_parse, verdict_parse, passrate_rollup, passrate_pivot, latency_mean, eval_worklist, rule_sections, rule_rendering,
    recency_score, page_locate, page_assigned, page_texts, scoring_text, xlsx_roles, response_json, daily_stream)}
ORACLE = {
    "page_locate": _LOCATE,
    "meta_filter": f"WITH {_L} SELECT id, {_any(_SOLID, STRONG)} OR ({_any(_SOLID, SUBJECTS)} AND {_any(_SOLID, ACTIONS)}) AS meta FROM l",
    "scope_filter": f"WITH {_L} SELECT id, {_SCOPE} AS scope FROM l",
    "intent_rules": f"WITH {_L} SELECT id, {_case('prompt', INTENTS, 'concept')} AS intent FROM l",
    "topic_gate": f"WITH {_L} SELECT id, {_case('prompt', TOPICS, 'on')} AS topic FROM l",
    "small_talk": f"WITH {_L} SELECT id, {_any('prompt', PHRASES)} AND think <> 1 AS talk FROM l",
    "intent_texts": f"WITH {_L}, i AS (SELECT id, CASE WHEN think = 1 THEN 'identify' WHEN {_SOLID} = '' THEN 'concept' ELSE {_case('prompt', INTENTS, 'concept')} END AS intent FROM l) SELECT id, intent, CASE intent WHEN 'compare' THEN 'Two parts, then the difference.' WHEN 'exam' THEN 'Short points only.' WHEN 'identify' THEN 'Look and ask; do not judge.' ELSE '' END AS text FROM i",
    "protocol_ratings": "WITH r AS (SELECT *, CASE n_nationkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'amber' WHEN 2 THEN 'green' ELSE CASE WHEN n_nationkey % 3 = 0 THEN 'red' ELSE 'amber' END END AS rating FROM nation) SELECT n_name AS id, rating, CASE WHEN rating = 'red' THEN CAST(row_number() OVER (PARTITION BY rating ORDER BY CASE n_nationkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 0 THEN 3 ELSE 4 END, n_regionkey, n_nationkey) AS INT) END AS nth FROM r",
    "followup_dedup": f"WITH {_L}, k AS (SELECT id, prompt, think, {_SCOPE} AS scope, lower(regexp_replace(prompt, '[\\p{{P}}\\p{{S}}\\s\\x{{3000}}\\x{{00A0}}\\x{{2000}}-\\x{{200A}}]+', '', 'g')) AS key FROM l WHERE prompt IS NOT NULL) SELECT min(id) AS id, min_by(prompt, id) AS question FROM k WHERE think = 1 AND scope = 'in_scope' AND key <> '' AND key NOT IN (SELECT key FROM k WHERE think = 0) GROUP BY key",
    "followup_parse": f"WITH {_L}, c AS (SELECT id, regexp_replace(regexp_replace(trim(prompt, ' \t\r\n\u3000'), '^[\"''“”]+|[\"''“”]+$', '', 'g'), '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g') AS q FROM l), m AS (SELECT id, CASE WHEN regexp_matches(q, '[?？]$') THEN q ELSE q || '？' END AS q, q AS bare FROM c) SELECT id, CASE WHEN coalesce(bare, '') <> '' AND length(q) <= 26 THEN q ELSE '' END AS questions FROM m",
    "request_guard": f"WITH {_L} SELECT id, CASE WHEN trim(regexp_replace(coalesce(answer, ''), '[\\s\\x{{3000}}]+', '', 'g')) = '' AND (think = 0 AND mode IS DISTINCT FROM 'audit' OR think = 1 AND user_id IS NULL) THEN 'empty' WHEN think = 0 AND mode = 'audit' THEN 'bad_image' ELSE 'ok' END AS error FROM l",
    "followup_strip": f"WITH {_L} SELECT id, md5(regexp_replace(coalesce(answer, ''), '(?:\\s*(?:^|\\n)[ \\t]*💬[^\\n]*)+\\s*$', '')) AS digest FROM l",
    "stream_cut": f"WITH {_L}, c AS (SELECT id, split_part(coalesce(answer, ''), '💬', 1) AS t FROM l), p AS (SELECT id, t, string_split(t, 'the ') AS s FROM c) SELECT id, md5(CASE WHEN len(s) > 2 THEN s[1] || 'the ' || s[2] ELSE t END) AS digest FROM p",
    "verdict_parse": f"WITH {_V} SELECT cond, id, rep, pass FROM v",
    "passrate_rollup": f"WITH {_RATES} SELECT cond, cat, passed, n, rate FROM r",
    "passrate_pivot": f"WITH {_RATES} SELECT cond, max(rate) FILTER (cat = 'key_facts') AS key_facts, max(rate) FILTER (cat = 'terminology') AS terminology, max(rate) FILTER (cat = 'overall') AS overall FROM r GROUP BY cond",
    "latency_mean": "SELECT cond, round(avg(sec), 1) AS mean_sec FROM (SELECT DISTINCT * FROM paper_eval_answers_v3) GROUP BY cond",
    "eval_worklist": "SELECT c AS cond, id, CAST(rep AS INT) AS rep FROM paper_eval_items_v2 i CROSS JOIN (VALUES " + ", ".join(f"('{c}')" for c in CONDITIONS) + ") c(c) CROSS JOIN range(3) r(rep) WHERE NOT EXISTS (SELECT 1 FROM paper_eval_answers_v3 a WHERE a.cond = c.c AND a.id = i.id AND a.rep = r.rep)",
    "rule_sections": "SELECT n_regionkey AS section, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS ids FROM nation GROUP BY n_regionkey",
    "rule_rendering": "SELECT n_regionkey AS section, string_agg(n_nationkey || ' ' || n_name || CASE WHEN n_nationkey > 9 THEN ' (p. ' || n_nationkey || ')' ELSE '' END || CASE WHEN n_nationkey < 5 THEN chr(10) || 'must: ' || n_name ELSE '' END, chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY n_regionkey",
    "recency_score": "SELECT CASE WHEN pub_year IS NULL THEN NULL WHEN 2026 - pub_year <= 5 THEN 1.0::DOUBLE WHEN 2026 - pub_year <= 10 THEN 0.8::DOUBLE WHEN 2026 - pub_year <= 20 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS recency, count(*) AS n FROM documents GROUP BY 1",
    "page_texts": "SELECT doc_id, CAST(i - 1 AS INT) AS page_no, md5(p) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents) WHERE length(regexp_replace(p, '[\\s\\x{3000}]+', '', 'g')) > 0",
    "scoring_text": "WITH p AS (SELECT filename, title, chunk_index, left(coalesce(text, ''), 500) AS part FROM papers_index), r AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY filename ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), b AS (SELECT filename, left('title: ' || coalesce(min_by(coalesce(title, ''), chunk_index), '') || chr(10) || string_agg(part, chr(10) ORDER BY chunk_index) FILTER (before <= 3000), 3000) AS body FROM r GROUP BY filename) SELECT filename, length(body) AS n_chars, md5(body) AS digest FROM b",
    "xlsx_roles": "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'title' WHEN 1 THEN 'author' WHEN 2 THEN 'year' END AS role FROM nation",
    "response_json": "SELECT s_suppkey, CAST(s_suppkey AS INT) AS score FROM supplier",
    "daily_stream": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
