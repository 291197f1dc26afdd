"""Queries of files, caches, builds and streams, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import index
from lumenfold.operators import lookup as K
from lumenfold.operators import pages as P
from lumenfold.plans import lineage
from lumenfold.sources import files
from lumenfold.sources.tables import table
from lumenfold.streaming import streams


def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", files.document_title(F.when(F.col("doc_id") % 3 > 0, F.col("title")), F.col("filename")).alias("title"))


def _object(name: Column, value: Column) -> Column:
    """Rows as one JSON object name: value, the values being JSON already."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), name, F.lit('": '), value))), ", "), F.lit("}"))


def credibility_file(spark: SparkSession, folder: str) -> DataFrame:
    """Scores written as a JSON object, with failed records and others among them, and read again; of a missing file there are none."""
    path = lineage.place(spark, "scores")
    e = table(spark, folder, "extracted").where("filename is not null").groupBy("filename").agg(F.max("citation_year").alias("year"))
    record = F.when(F.col("year") % 5 == 0, F.lit('{"error": "no answer"}')).when(F.col("year") % 5 == 1, F.lit('"none"')).otherwise(F.concat(F.lit('{"credibility": 0.'), F.coalesce(F.col("year"), F.lit(5)).cast("string"), F.lit(', "doc_kind": "paper"}')))
    e.agg(_object(F.col("filename"), record).alias("value")).coalesce(1).write.text(path)  # one row
    none = files.credibility_scores(spark, f"{path}-nothing")
    return files.credibility_scores(spark, path).unionByName(none).select("filename", F.round("credibility", 6).alias("credibility"), "doc_kind")


def extract_files(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of one JSON file for each region, and one that cannot be read."""
    path = lineage.place(spark, "extracts")
    table(spark, folder, "region").repartitionByRange(5, "r_regionkey").write.json(path)
    bad = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/zz.json")
    out = bad.getFileSystem(spark._jsc.hadoopConfiguration()).create(bad)
    out.writeBytes('{"r_regionkey": 9, "r_na')
    out.close()
    return files.extract_cache(spark, path, "r_regionkey int, r_name string").select("record.*")


def account_file(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts by nation, as an object with notes for some and as a list for others."""
    c = table(spark, folder, "customer").withColumn("k", F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("_"), "c_name")).otherwise(F.concat(F.lit(" "), "c_name")))
    named = c.where("c_nationkey < 12").groupBy("c_nationkey").agg(_object(F.col("k"), F.col("c_custkey").cast("string")).alias("value"))
    listed = c.where("c_nationkey >= 12").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct(F.when(F.col("c_custkey") % 7 > 0, F.col("k")).alias("account"), F.col("c_mktsegment").alias("password")))).alias("value"))
    broken = spark.createDataFrame([("{",), (None,)], "value string")
    return files.account_records(named.select("value").unionByName(listed.select("value")).unionByName(broken))


#: Rules that hold where no file gives others.
RULES = {"design": [{"id": "D1", "item": "groups"}, {"id": "D2", "item": "blinding", "must": ["method"]}], "data": [{"id": "R1", "item": "sample size", "page": 3}]}


def rule_fallback(spark: SparkSession, folder: str) -> DataFrame:
    rules = files.rule_file(f"{folder}/no_rules.yaml", RULES)
    return K.rules_table(spark, rules).select("section", "pos", "id", "item", F.coalesce("page", F.lit(0)).alias("page"), F.size("must").alias("n_must"))


def build_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each file of a build: some fail, some are known from before, some have no text."""
    c = table(spark, folder, "papers_index").where("filename is not null")
    texts = c.groupBy("filename").agg(F.max("chunk_index").alias("last")).select("filename", F.lit(None).cast("string").alias("text"), F.when(F.col("last") % 7 == 0, "ValueError: bad file").alias("error"))
    return files.outcomes(texts, c.where("length(text) > 3000"), c.where("filename like 'k%'"))


def build_report(spark: SparkSession, folder: str) -> DataFrame:
    return files.build_report(build_outcomes(spark, folder))


def unscored_files(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "papers_index")
    return index.unscored(c, c.where("filename like '%assay%'").select("filename").distinct())


def memo_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Questions answered from a memo or anew; failures (long ones) are empty and remembered."""
    q = table(spark, folder, "paper_eval_items_v2").select(F.col("q").alias("key"))
    memo = q.where("length(key) % 2 = 0").select("key", F.lit("known").alias("value")).distinct()
    made = F.when(F.length("key") < 60, F.upper("key"))
    results, after = K.remembered(q, memo, made)
    _, without = K.remembered(q, memo, made, keep_failures=False)
    part = lambda d, name: d.groupBy("value").agg(F.count("*").alias("n")).withColumn("part", name)
    told = results.groupBy("value", F.when(F.col("hit"), "hit").otherwise("made").alias("part")).agg(F.count("*").alias("n"))
    return told.unionByName(part(after, F.lit("memo"))).unionByName(part(without, F.lit("memo without failures")))


TAILS = {"audit": "-- end of audit --", "protocol": "-- end of protocol --"}


def finish_effects(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "chat_log").dropDuplicates(["id"])
    return K.finished(log, TAILS, "💬", "the ").select("id", F.md5("answer").alias("digest"))


def slide_pages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("doc_id % 10 = 0 and title is not null")
    text = F.concat(F.lit("[slide 1]\n"), "title", F.lit("\n\n[slide 3]\n"), "filename", F.lit("\nsecond line"))
    return P.slides(d.select("doc_id", text.alias("text")))


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of documents of which some are blank throughout and have a scan."""
    d = table(spark, folder, "documents").where("filename is not null")
    pages = d.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("page_no"), F.when(F.col("doc_id") % 4 > 0, F.col("filename")).otherwise(" ").alias("text")), F.struct(F.lit(2).alias("page_no"), F.lit("").alias("text")))).alias("p")).select("doc_id", "p.*")
    scans = d.where("doc_id % 8 > 0").select("doc_id", F.concat(F.lit("a "), "filename", F.lit("\n\nb")).alias("text"))
    return P.with_scans(pages, scans)


def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as a stream of short tokens, cut at a marker or the second place of a heading."""
    path = lineage.place(spark, "tokens")
    log = table(spark, folder, "chat_log").dropDuplicates(["id"]).where("answer <> ''")
    parts = F.concat(F.regexp_extract_all("answer", F.lit(r"(?s)(.{1,9})"), F.lit(1)), F.array(F.lit(None).cast("string")))
    log.select(F.col("id").cast("string").alias("conv"), F.posexplode(parts).alias("seq", "token")).withColumn("seq", F.col("seq").cast("bigint")).write.parquet(path)
    stream = spark.readStream.schema("conv string, seq bigint, token string").parquet(path)
    out = streams.drained(streams.shown(stream, "whereas", "the ", first=0), lineage.place(spark, "shown"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy("conv").agg(F.md5(text).alias("digest"))


def limit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of a log as a stream, limited by account."""
    path = lineage.place(spark, "requests")
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    e.withColumn("t", F.col("t") / 1e6).write.parquet(path)
    stream = spark.readStream.schema("account string, id bigint, t double").parquet(path)
    return streams.drained(streams.limited(stream, limit=1, window=86_400.0), lineage.place(spark, "limited")).select("account", "id", "allowed", "retry_after")


#: Orders before the first and from the second of these days are the two parts of a stream.
EARLY, LATE = "1997-01-01", "1998-01-01"


def expiry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of customers that live for a day after each order; the stream is read in two parts, so the later one ends what the earlier began."""
    path, place = lineage.place(spark, "issued"), lineage.place(spark, "expired")
    o = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("token"), F.col("o_custkey").cast("string").alias("account"), F.col("o_orderdate").cast("timestamp").alias("seen"))
    for part in (F.col("seen") < F.lit(EARLY).cast("timestamp"), F.col("seen") >= F.lit(LATE).cast("timestamp")):
        o.where(part).write.mode("append").parquet(path)
        out = streams.drained(streams.live_tokens(spark.readStream.schema("token string, account string, seen timestamp").parquet(path), ttl=86_400.0), place)
    return out.groupBy("state").agg(F.count("*").alias("n"))


_L = "l AS (SELECT DISTINCT ON (id) * FROM chat_log)"
QUERIES = {f.__name__: f for f in (
    document_titles, credibility_file, extract_files, account_file, rule_fallback, build_outcomes, build_report, unscored_files, memo_lookup, finish_effects, slide_pages, scan_pages, token_stream, limit_stream, expiry_stream)}
_OUT = """o AS (SELECT f.filename, CASE WHEN last % 7 = 0 THEN -1 ELSE coalesce(n, 0) END AS blocks, f.filename LIKE 'k%' AS known FROM (SELECT filename, max(chunk_index) AS last FROM papers_index WHERE filename IS NOT NULL GROUP BY filename) f
  LEFT JOIN (SELECT filename, count(*) AS n FROM papers_index WHERE length(text) > 3000 GROUP BY filename) c USING (filename)),
s AS (SELECT filename, blocks, CASE WHEN known THEN 'skipped' WHEN blocks < 0 THEN 'failed' WHEN blocks = 0 THEN 'blank' ELSE 'new' END AS state FROM o)"""
ORACLE = {
    "document_titles": "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN nullif(trim(title), '') END, regexp_replace(filename, '\\.[^.]*$', '')) AS title FROM documents",
    "credibility_file": "SELECT filename, CAST('0.' || coalesce(year, 5) AS DOUBLE) AS credibility, 'paper' AS doc_kind FROM (SELECT filename, max(citation_year) AS year FROM extracted WHERE filename IS NOT NULL GROUP BY filename) WHERE year IS NULL OR year % 5 > 1",
    "extract_files": "SELECT CAST(r_regionkey AS INT) AS r_regionkey, r_name FROM region",
    "account_file": "SELECT c_name AS account, CASE WHEN c_nationkey < 12 THEN CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END AS password FROM customer WHERE c_custkey % 7 > 0",
    "rule_fallback": "SELECT * FROM (VALUES ('design', 0, 'D1', 'groups', 0, 0), ('design', 1, 'D2', 'blinding', 0, 1), ('data', 0, 'R1', 'sample size', 3, 0)) r(section, pos, id, item, page, n_must)",
    "build_outcomes": f"WITH {_OUT} SELECT filename, blocks, state FROM s",
    "build_report": f"WITH {_OUT} SELECT count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'blank') AS blank, count(*) FILTER (state = 'skipped') AS skipped, CAST(coalesce(sum(blocks) FILTER (state = 'new'), 0) AS BIGINT) AS pieces FROM s",
    "unscored_files": "SELECT DISTINCT filename FROM papers_index WHERE filename <> '' AND filename NOT LIKE '%assay%'",
    "memo_lookup": """WITH r AS (SELECT q, CASE WHEN length(q) % 2 = 0 THEN 'known' WHEN length(q) < 60 THEN upper(q) ELSE '' END AS value, CASE WHEN length(q) % 2 = 0 THEN 'hit' ELSE 'made' END AS part FROM paper_eval_items_v2), m AS (SELECT DISTINCT q, value FROM r)
SELECT value, count(*) AS n, part FROM r GROUP BY ALL UNION ALL SELECT value, count(*), 'memo' FROM m GROUP BY value UNION ALL SELECT value, count(*), 'memo without failures' FROM m WHERE value <> '' GROUP BY value""",
    "finish_effects": f"WITH {_L}, c AS (SELECT id, mode, coalesce(answer, '') AS t, string_split(coalesce(answer, ''), 'the ') AS s FROM l), x AS (SELECT id, mode, CASE WHEN mode = 'audit' THEN rtrim(CASE WHEN len(s) > 2 THEN s[1] || 'the ' || s[2] ELSE t END, ' ') ELSE t END AS t, CASE mode WHEN 'audit' THEN '-- end of audit --' WHEN 'protocol' THEN '-- end of protocol --' END AS tail FROM c) SELECT id, md5(regexp_replace(CASE WHEN tail IS NULL OR ends_with(rtrim(t, ' '), tail) THEN t ELSE t || chr(10) || chr(10) || tail END, '(?:\\s*(?:^|\\n)[ \\t]*💬[^\\n]*)+\\s*$', '')) AS digest FROM x",
    "slide_pages": "SELECT doc_id, CAST(n AS INT) AS page_no, CASE n WHEN 1 THEN title ELSE filename || chr(10) || 'second line' END AS text FROM documents CROSS JOIN (VALUES (1), (3)) v(n) WHERE doc_id % 10 = 0 AND title IS NOT NULL AND (n = 1 OR filename IS NOT NULL) AND filename IS NOT NULL",
    "scan_pages": """SELECT doc_id, n AS page_no, CASE n WHEN 1 THEN 'a ' || filename ELSE 'b' END AS text FROM documents CROSS JOIN (VALUES (1), (2)) v(n) WHERE filename IS NOT NULL AND doc_id % 4 = 0 AND doc_id % 8 > 0
UNION ALL SELECT doc_id, n, CASE WHEN n = 2 THEN '' WHEN doc_id % 4 > 0 THEN filename ELSE ' ' END FROM documents CROSS JOIN (VALUES (1), (2)) v(n) WHERE filename IS NOT NULL AND NOT (doc_id % 4 = 0 AND doc_id % 8 > 0)""",
    "token_stream": f"WITH {_L}, c AS (SELECT id, split_part(answer, 'whereas', 1) AS t FROM l WHERE answer <> ''), p AS (SELECT id, t, string_split(t, 'the ') AS s FROM c) SELECT CAST(id AS VARCHAR) AS conv, md5(CASE WHEN len(s) > 2 THEN s[1] || 'the ' || s[2] ELSE t END) AS digest FROM p",
    "limit_stream": """WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS account, event_id AS id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL),
r AS (SELECT account, 0 AS k, NULL::BIGINT AS id, NULL::DOUBLE AS last, NULL::BOOLEAN AS allowed, NULL::INT AS retry_after FROM o WHERE k = 1
  UNION ALL SELECT o.account, o.k, o.id, CASE WHEN last IS NULL OR last < o.t - 86400 THEN o.t ELSE last END, last IS NULL OR last < o.t - 86400, CASE WHEN last IS NULL OR last < o.t - 86400 THEN 0 ELSE CAST(trunc(86400 - (o.t - last)) AS INT) + 1 END FROM r JOIN o ON o.account = r.account AND o.k = r.k + 1)
SELECT account, id, allowed, retry_after FROM r WHERE k > 0""",
    "expiry_stream": f"""WITH a AS (SELECT o_custkey AS k, max(o_orderdate) AS last FROM orders WHERE o_orderdate < '{EARLY}' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderdate) AS last FROM orders WHERE o_orderdate >= '{LATE}' GROUP BY 1),
s AS (SELECT k FROM a WHERE last + INTERVAL 1 DAY > (SELECT max(last) FROM a) - INTERVAL 1 HOUR)
SELECT 'live' AS state, (SELECT count(*) FROM a) + (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM s)) AS n UNION ALL
SELECT 'expired', (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM s)) + (SELECT count(*) FROM s WHERE k NOT IN (SELECT k FROM b)) + (SELECT count(*) FROM b WHERE last + INTERVAL 1 DAY <= (SELECT max(last) FROM b) - INTERVAL 1 HOUR)""",
}
