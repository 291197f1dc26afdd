"""Queries of ingestion, indexing, retrieval and credibility, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import credibility as C
from lumenfold.operators import index, retrieval
from lumenfold.plans import lineage
from lumenfold.sources import index_store
from lumenfold.sources.tables import table

K, POOL = 5, 100


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.spread(table(spark, folder, "papers_index").select("chunk_index", "filename", "title", "text", "page"))


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paper_eval_items_v2").select(F.col("id").alias("query_id"), F.col("q").alias("query"))


def _dims(spark: SparkSession, folder: str) -> DataFrame:
    """Five dimensions for each file of the literature table, from its kind, journal and year."""
    e = table(spark, folder, "extracted").groupBy("filename").agg(F.min("doc_kind").alias("kind"), F.min("journal").alias("journal"), F.min("citation_year").alias("year"), F.avg(F.col("in_vivo").cast("double")).alias("vivo"))
    return e.select(
        "filename", F.when(F.col("kind") == "原始实验", 0.85).when(F.col("kind") == "综述", 0.55).otherwise(0.4).alias("study"), F.when(F.col("journal").rlike("Journal|Archives|学报"), 0.85).otherwise(0.7).alias("venue"),
        F.round("vivo", 2).alias("method"), C.recency(F.col("year")).alias("recency"), F.lit(0.6).alias("consensus"))


def _credibility(spark: SparkSession, folder: str) -> DataFrame:
    """Credibility of the indexed files by the year in their names; files from scans have none."""
    f = _chunks(spark, folder).select("filename").distinct().where("filename is not null and not filename like '%_ocr.txt'")
    year = F.regexp_extract("filename", r"(\d{4})", 1).try_cast("int")
    return f.select("filename", F.when(year >= 2018, 0.9).when(year >= 2008, 0.7).otherwise(0.5).alias("credibility"))


_INDEXES: dict[tuple[str, str, int], str] = {}


def _index(spark: SparkSession, folder: str) -> index_store.Index:
    """The index of a data folder, built once a session and read by all queries; built anew when the table is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/papers_index.parquet")
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, folder, changed)
    if key not in _INDEXES:
        _INDEXES[key] = lineage.place(spark, "index")
        index_store.save(_chunks(spark, folder), _INDEXES[key])
    return index_store.load(spark, _INDEXES[key])


def _pool(spark: SparkSession, folder: str, k: int = 0) -> DataFrame:
    """The k best hits of each query with their texts, written once; with 0 as many as stand behind K results."""
    i = _index(spark, folder)
    hits = retrieval.bm25(_queries(spark, folder), i.postings, i.doc_freq, i.totals)
    best = retrieval.top_k(retrieval.fused(hits, i.pieces, _credibility(spark, folder)), k or retrieval.pool_size(K))
    return lineage.written(retrieval.with_texts(best, i.pieces), "pool")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    i = _index(spark, folder)
    hits = retrieval.bm25(_queries(spark, folder), i.postings, i.doc_freq, i.totals).withColumns({"score": F.col("bm25"), "credibility": F.lit(1.0)})
    return retrieval.top_k(hits, K).select("query_id", "rank", "chunk_index", F.round("bm25", 4).alias("bm25"))


def bm25_fused_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _pool(spark, folder, K).select("query_id", "rank", "chunk_index", F.round("score", 4).alias("score"), F.round("bm25", 4).alias("bm25"), F.round("credibility", 3).alias("credibility"), "tier")


def tier_quota(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.tier_quota(_pool(spark, folder), K).select("query_id", "slot", "chunk_index", "tier", F.round("score", 4).alias("score"))


def lang_quota(spark: SparkSession, folder: str) -> DataFrame:
    english = T.english_piece(F.col("text"), F.col("filename"))
    return retrieval.language_quota(_pool(spark, folder).withColumn("english", english), K).select("query_id", "slot", "chunk_index", F.round("score", 4).alias("score"))


#: Keyword rules that pin files: (keyword, start of the file name). Sample configuration.
PINS = (("bark", "lumsdahl"), ("section", "oakenrow"), ("桑白皮", "kessary"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rule_targets(_queries(spark, folder), _chunks(spark, folder).select("filename"), PINS)


def authoritative_trigger(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder)


def authoritative_pin(spark: SparkSession, folder: str) -> DataFrame:
    pool = _pool(spark, folder, 200)
    return retrieval.pinned(pool.where(F.col("rank") <= K), pool, _targets(spark, folder), K).select("query_id", "slot", "chunk_index", F.round("score", 4).alias("score"))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts as they would be remembered, keyed by query and files: items to be refused are not relevant to what is found for them."""
    refused = table(spark, folder, "paper_eval_items_v2").where("expect_refuse").select(F.col("id").alias("query_id"))
    hits = _pool(spark, folder, K).withColumnRenamed("rank", "slot").join(_queries(spark, folder), "query_id").join(refused, "query_id", "left_semi")
    return retrieval.gate_keys(hits).select("key", F.lit(False).alias("relevant"))


def relevance_gate(spark: SparkSession, folder: str) -> DataFrame:
    hits = _pool(spark, folder, K).withColumnRenamed("rank", "slot").join(_queries(spark, folder), "query_id")
    return retrieval.gated(hits, _verdicts(spark, folder)).select("query_id", F.col("slot").alias("rank"), "chunk_index")


def search_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Expansion, pool, quota, gate and pin in one; the category of an item stands for its expansion."""
    i = _index(spark, folder)
    q = table(spark, folder, "paper_eval_items_v2").select(F.col("id").alias("query_id"), F.col("q").alias("query"), F.regexp_replace("cat", "_", " ").alias("expansion"))
    first = retrieval.search(q, i.pieces, i.postings, i.doc_freq, i.totals, _credibility(spark, folder), K, lineage.written)
    refused = table(spark, folder, "paper_eval_items_v2").where("expect_refuse").select(F.col("id").alias("query_id"))
    keys = retrieval.gate_keys(first.join(q, "query_id").join(refused, "query_id", "left_semi"))
    fixed = i.pieces.where("filename like 'kessary%'").agg(F.min("chunk_index").alias("chunk_index")).crossJoin(q.where("query_id = 'F002'").select("query_id"))  # one row by one
    return retrieval.search(q, i.pieces, i.postings, i.doc_freq, i.totals, _credibility(spark, folder), K, lineage.written, fixed=fixed, verdicts=keys.select("key", F.lit(False).alias("relevant")), targets=_targets(spark, folder)).select(
        "query_id", "slot", "chunk_index", "filename", "tier", F.round("score", 4).alias("score"))


def stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """An index written over another one and read back by the second of two places."""
    path = lineage.place(spark, "index")
    c = _chunks(spark, folder)
    index_store.save(c.where("chunk_index % 2 = 0"), path)
    index_store.save(c, path)
    i, none = index_store.load(spark, f"{path}-nothing", path), index_store.load(spark, f"{path}-nothing")
    part = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return part(i.pieces, "pieces").unionAll(part(i.postings, "postings")).unionAll(part(i.doc_freq, "tokens")).unionAll(part(none.pieces, "empty"))


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.contexts(_pool(spark, folder, 15)).select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def sources_list(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.sources(_pool(spark, folder, 10))


FORCED = ("F001", "F003", "F005")


def forced_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each query with those of three fixed queries appended, one after the other."""
    pool = _pool(spark, folder, K)
    cols = ["query_id", "rank", "filename", "text", "chunk_index", "score"]
    order = F.array_position(F.array(*map(F.lit, FORCED)), F.col("query_id"))
    fixed = pool.where(F.col("query_id").isin(*FORCED)).withColumn("rank", ((order - 1) * K + F.col("rank")).cast("int"))
    return retrieval.forced_union(pool.select(cols), retrieval.for_each_query(fixed.select(*cols[1:]), _queries(spark, folder), len(FORCED) * K).select(cols)).select("query_id", "slot", "chunk_index")


def answer_route(spark: SparkSession, folder: str) -> DataFrame:
    first = _pool(spark, folder, 1).select("query_id", "score", F.lit(False).alias("authoritative"))
    q = _queries(spark, folder).join(first, "query_id", "left")
    q = q.withColumns({"methodology": F.expr("contains(lower(query), 'how should') or contains(query, '应怎样')"), "on_topic": F.expr("not contains(query, '四月')")})
    return retrieval.route(q).select("query_id", "route")


def k_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chat_log").groupBy(retrieval.rows_for_mode(F.coalesce("mode", F.lit("")), F.col("think")).alias("k")).agg(F.count("*").alias("n"))


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return index.chunk_documents(lineage.spread(table(spark, folder, "documents").select("doc_id", "text"))).select("doc_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def token_bag(spark: SparkSession, folder: str) -> DataFrame:
    return lineage.spread(table(spark, folder, "documents").select("text")).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return index.doc_freq(index.weighted_tokens(_chunks(spark, folder)))


def weighted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return index.weighted_tokens(_chunks(spark, folder))


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.statistics(_chunks(spark, folder)).select("n_chunks", "n_files", F.md5("files").alias("files_digest"), "status")


def drop_and_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    c = _chunks(spark, folder)
    return index.doc_freq(index.weighted_tokens(index.without_files(c, c.where("filename like 'kessary%'").select("filename").distinct())))


def joined_body(spark: SparkSession, folder: str) -> DataFrame:
    return index.joined_body(_chunks(spark, folder)).select("filename", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.safe_name(F.col("title")).alias("safe"))


def text_language(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "papers_index").select("chunk_index", T.is_english(t).alias("english"), T.mostly_chinese(t).alias("chinese"), F.length(T.no_space(t)).alias("n_solid"))


def credibility_score(spark: SparkSession, folder: str) -> DataFrame:
    return C.scored(_dims(spark, folder)).select("filename", "credibility", "tier")


def tier_hist(spark: SparkSession, folder: str) -> DataFrame:
    return C.tier_histogram(C.scored(_dims(spark, folder)))


def incremental_targets(spark: SparkSession, folder: str) -> DataFrame:
    d = _dims(spark, folder)
    done = d.select("filename", F.when(F.col("recency") < 0.6, "failed").alias("error")).where("venue > 0.8")
    return C.targets(d.select("filename"), done)


def merge_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = C.scored(_dims(spark, folder)).select("filename", "tier")
    new = s.where("filename like 'k%'").select("filename", F.lit(None).cast("string").alias("tier"))
    return C.tier_histogram(C.merged(s, new))


def sensitivity_single(spark: SparkSession, folder: str) -> DataFrame:
    return C.changes(spark, _dims(spark, folder), C.perturbed()).select("vector", "n_changed")


def sensitivity_equal(spark: SparkSession, folder: str) -> DataFrame:
    return C.changes(spark, _dims(spark, folder), [("equal", (0.2,) * 5)])


def sensitivity_random(spark: SparkSession, folder: str) -> DataFrame:
    return C.changes(spark, _dims(spark, folder), C.random_weights()).agg(F.avg("n_changed").alias("mean_changed"), F.max("n_changed").alias("most_changed"))


#: A file that is left out of the sensitivity unless all are asked for. Sample configuration.
EXCLUDED = "brontley1999_x000013.pdf"


def sensitivity_excluded(spark: SparkSession, folder: str) -> DataFrame:
    d = _dims(spark, folder)
    every = C.tier_histogram(C.scored(C.without(d, (EXCLUDED,), every=True))).withColumn("files", F.lit("all"))
    return every.unionByName(C.tier_histogram(C.scored(C.without(d, (EXCLUDED,)))).withColumn("files", F.lit("without")))


def study_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of kind and venue from dimension tables, and of age with a kind that does not age."""
    e = table(spark, folder, "extracted").groupBy("filename").agg(F.min("doc_kind").alias("doc_kind"), F.min("journal").alias("journal"), F.min("citation_year").alias("year"))
    kinds = spark.createDataFrame([("原始实验", 0.85), ("综述", 0.55)], "doc_kind string, score double")
    venues = e.select("journal").distinct().where("journal like '%学报%'").withColumn("score", F.lit(0.85))
    out = C.graded(C.graded(e, "doc_kind", kinds, "study", 0.4), "journal", venues, "venue", 0.7)
    return out.select("filename", "study", "venue", C.recency(F.col("year"), kind=F.col("doc_kind"), archival=("综述",)).alias("recency"))


def paper_text(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of a paper as labelled lines; empty fields are left out."""
    line = lambda label, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    return table(spark, folder, "documents").select("doc_id", F.concat_ws("\n", line("title", "title"), line("source", "source"), line("year", "pub_year"), line("language", "lang")).alias("body"))


KEYWORDS = ("kessary", "ocr", "2013", "rusk", "nothing")


def keyword_files(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct files of each keyword of a list, in the order in which they come in the index."""
    hit = F.filter(F.array(*[F.when(F.contains(F.lower("filename"), F.lit(w)), F.lit(w)) for w in KEYWORDS]), lambda x: x.isNotNull())
    found = _chunks(spark, folder).select("filename", "chunk_index", F.explode(hit).alias("keyword")).groupBy("keyword", "filename").agg(F.min("chunk_index").alias("first"))
    return found.select("keyword", "filename", F.row_number().over(Window.partitionBy("keyword").orderBy("first")).alias("nth"))


_TOK = """SELECT {key}, unnest(regexp_extract_all(lower({t}), '[a-z]{{2,}}')) AS token FROM {src}
  UNION ALL SELECT {key}, unnest(regexp_extract_all(lower({t}), '\\p{{Nd}}{{2,}}')) FROM {src}
  UNION ALL SELECT {key}, substr(run, i, n) FROM (SELECT {key}, run, n, unnest(range(1, length(run) - n + 2)) AS i FROM (
    SELECT {key}, unnest(regexp_extract_all(lower({t}), '[\\x{{4E00}}-\\x{{9FFF}}]+')) AS run FROM {src}) CROSS JOIN (VALUES (1), (2), (3)) g(n))"""
_POSTINGS = """
lab AS (SELECT chunk_index, CASE WHEN coalesce(title, '') <> '' AND title <> stem THEN concat_ws(' ', stem, title) ELSE stem END AS label FROM (
  SELECT chunk_index, title, regexp_replace(coalesce(filename, ''), '(\\.pdf|\\.PDF|\\.docx|\\.DOCX|\\.pptx|\\.PPTX|\\.xlsx|\\.XLSX|\\.txt)$', '') AS stem FROM {c})),
bt AS ({body}), lt AS ({label}),
postings AS (SELECT chunk_index, token, CAST(sum(w) AS BIGINT) AS tf FROM (SELECT chunk_index, token, 1 AS w FROM bt UNION ALL SELECT chunk_index, token, 3 FROM lt) GROUP BY ALL)"""


def _postings(c: str) -> str:
    return _POSTINGS.format(c=c, body=_TOK.format(key="chunk_index", t="text", src=c), label=_TOK.format(key="chunk_index", t="label", src="lab"))


_HITS = """qt{x} AS (SELECT id, token, count(*) AS qtf FROM ({tokens}) GROUP BY ALL),
bm{x} AS (
  SELECT q.id AS query_id, p.chunk_index, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length(coalesce(c.text, '')) / avgdl))), 9) AS bm25
  FROM postings p JOIN qt{x} q USING (token) JOIN dfs USING (token) JOIN papers_index c ON c.chunk_index = p.chunk_index CROSS JOIN st GROUP BY ALL),
fu{x} AS (SELECT query_id, b.chunk_index, c.filename, c.title, c.text, c.page, bm25, coalesce(cr.credibility, 0.6::DOUBLE) AS credibility, round(bm25 * (0.4::DOUBLE + 0.6::DOUBLE * coalesce(cr.credibility, 0.6::DOUBLE)), 9) AS score
  FROM bm{x} b JOIN papers_index c ON c.chunk_index = b.chunk_index LEFT JOIN cr ON cr.filename = c.filename WHERE bm25 > 0),
rk{x} AS (SELECT *, CASE WHEN credibility >= 0.8 THEN 'A' WHEN credibility >= 0.6 THEN 'B' ELSE 'C' END AS tier,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25 DESC, credibility DESC, chunk_index DESC) AS rank FROM fu{x})
"""


def _hits(source: str, suffix: str = "") -> str:
    return _HITS.format(x=suffix, tokens=_TOK.format(key="id", t="q", src=source))


_STORE = "WITH " + _postings("papers_index").strip() + """,
st AS (SELECT count(*) AS n, avg(length(coalesce(text, ''))) AS avgdl FROM papers_index),
dfs AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
cr AS (SELECT DISTINCT filename, CASE WHEN y >= 2018 THEN 0.9::DOUBLE WHEN y >= 2008 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS credibility FROM (
  SELECT filename, try_cast(regexp_extract(filename, '(\\d{4})', 1) AS INT) AS y FROM papers_index WHERE filename IS NOT NULL AND NOT ends_with(filename, '_ocr.txt'))),
"""
_BM25 = _STORE + _hits("paper_eval_items_v2")
_QUOTA = """h AS (SELECT *, count(*) FILTER (tier = 'A') OVER (PARTITION BY query_id) AS n_a, max(CASE WHEN tier <> 'A' THEN rank END) OVER (PARTITION BY query_id) AS last_non FROM rk WHERE rank <= 5),
x AS (SELECT query_id, min_by(chunk_index, rank) AS cx, min_by(score, rank) AS sx, min(rank) AS src FROM rk WHERE rank > 5 AND rank <= 100 AND tier = 'A' AND bm25 > 0 GROUP BY query_id),
s1 AS (SELECT h.query_id, h.rank AS slot, CASE WHEN sw THEN x.src ELSE h.rank END AS src, CASE WHEN sw THEN cx ELSE h.chunk_index END AS chunk_index, CASE WHEN sw THEN 'A' ELSE h.tier END AS tier, CASE WHEN sw THEN sx ELSE h.score END AS score
  FROM (SELECT *, n_a = 0 AND rank = last_non AS may FROM h) h LEFT JOIN x USING (query_id) CROSS JOIN LATERAL (SELECT coalesce(may AND x.src IS NOT NULL, false) AS sw)),
s2 AS (SELECT *, tier = 'C' AND row_number() OVER (PARTITION BY query_id, tier ORDER BY round(score, 4) DESC, slot) > 2 AS dropped FROM s1),
s3 AS (SELECT *, CASE WHEN dropped THEN row_number() OVER (PARTITION BY query_id, dropped ORDER BY slot) END AS nth FROM s2),
f AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth, chunk_index AS cf, tier AS tf, score AS sf FROM rk WHERE rank > 5 AND rank <= 100 AND tier <> 'C' AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.query_id = rk.query_id AND s1.src = rk.rank)),
o AS (SELECT query_id, slot, coalesce(cf, chunk_index) AS chunk_index, coalesce(tf, tier) AS tier, coalesce(sf, score) AS score FROM s3 LEFT JOIN f USING (query_id, nth)),
t AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, slot) AS slot, chunk_index, tier, score FROM o)"""
_DIMS = """d AS (SELECT filename, CASE WHEN kind = '原始实验' THEN 0.85::DOUBLE WHEN kind = '综述' THEN 0.55::DOUBLE ELSE 0.4::DOUBLE END AS study,
  CASE WHEN regexp_matches(journal, 'Journal|Archives|学报') THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS venue, round(vivo, 2) AS method,
  CASE WHEN year IS NULL THEN NULL WHEN 2026 - year <= 5 THEN 1.0::DOUBLE WHEN 2026 - year <= 10 THEN 0.8::DOUBLE WHEN 2026 - year <= 20 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS recency, 0.6::DOUBLE AS consensus
  FROM (SELECT filename, min(doc_kind) AS kind, min(journal) AS journal, min(citation_year) AS year, avg(in_vivo::INT::DOUBLE) AS vivo FROM extracted GROUP BY filename))"""
_TIER = "CASE WHEN {x} >= 0.8::DOUBLE THEN 'A' WHEN {x} >= 0.6::DOUBLE THEN 'B' ELSE 'C' END"


_TIER3 = _TIER.format(x="CAST(printf('%.3f', {x}) AS DOUBLE)")
#: The usual weights of the five dimensions, written out so that a wrong constant in the operator shows.
_USUAL = "coalesce(study, 0) * 0.3::DOUBLE + coalesce(venue, 0) * 0.25::DOUBLE + coalesce(method, 0) * 0.2::DOUBLE + coalesce(recency, 0) * 0.15::DOUBLE + coalesce(consensus, 0) * 0.1::DOUBLE"
_SCORED = f"WITH {_DIMS}, s AS (SELECT filename, CAST(printf('%.3f', {_USUAL}) AS DOUBLE) AS credibility FROM d), t AS (SELECT *, {_TIER.format(x='credibility')} AS tier FROM s)"


def _changes(vectors: list) -> str:
    listed = ", ".join(f"('{n}', " + ", ".join(f"{x!r}::DOUBLE" for x in w) + ")" for n, w in vectors)
    total = "coalesce(study, 0) * w1 + coalesce(venue, 0) * w2 + coalesce(method, 0) * w3 + coalesce(recency, 0) * w4 + coalesce(consensus, 0) * w5"
    return f"WITH {_DIMS}, b AS (SELECT *, {_TIER3.format(x=_USUAL)} AS base FROM d), x AS (SELECT vector, base, {_TIER3.format(x=total)} AS other FROM b CROSS JOIN (VALUES {listed}) v(vector, w1, w2, w3, w4, w5)) SELECT vector, count(*) FILTER (base <> other) AS n_changed, count(*) FILTER (base <> other AND base = 'A') AS a_left FROM x GROUP BY vector"


_PIN_VALUES = ", ".join(f"('{k}', '{s}')" for k, s in PINS)
_TARGETS = f"tg AS (SELECT DISTINCT i.id AS query_id, f.filename FROM paper_eval_items_v2 i JOIN (VALUES {_PIN_VALUES}) r(keyword, start) ON contains(lower(q), lower(keyword)) JOIN (SELECT DISTINCT filename FROM papers_index) f ON starts_with(f.filename, start))"
_ENGLISH = "(length(regexp_replace(text, '[\\s\\x{3000}]+', '', 'g')) > 0 AND length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) < 0.05 * length(regexp_replace(text, '[\\s\\x{3000}]+', '', 'g')))"

_ASKED = "qx AS (SELECT id, CASE WHEN length(q) <= 80 AND length(regexp_replace(q, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) >= 0.3 * length(regexp_replace(q, '[\\s\\x{3000}]+', '', 'g')) THEN concat_ws(' ', q, nullif(replace(cat, '_', ' '), '')) ELSE q END AS q FROM paper_eval_items_v2)"

QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_fused_topk, tier_quota, lang_quota, authoritative_trigger, authoritative_pin, relevance_gate, context_budget, sources_list, forced_recall, answer_route, k_by_mode, search_pipeline, stored_index,
    chunk_documents, token_bag, doc_freq, weighted_tokens, index_stats, drop_and_rebuild, joined_body, safe_names, text_language, credibility_score, tier_hist, incremental_targets, merge_scores,
    sensitivity_single, sensitivity_equal, sensitivity_random, sensitivity_excluded, study_scores, paper_text, keyword_files)}
#: Lines, and sentences of long lines, taken one by one: what is open is closed where the next does not fit.
_CHUNKS = r"""WITH RECURSIVE ln AS (SELECT doc_id, i, regexp_replace(p, '^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$', '', 'g') AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
st AS (SELECT doc_id, i, j, s FROM (SELECT doc_id, i, unnest(x) AS s, generate_subscripts(x, 1) AS j FROM (SELECT doc_id, i, string_split(regexp_replace(p, '([。；;！!？?]|\. )', '\1' || chr(30), 'g'), chr(30)) AS x FROM ln WHERE length(p) > 500)) WHERE trim(s) <> ''),
it AS (SELECT doc_id, i, 0 AS j, p AS s, 1 AS glue, false AS flush FROM ln WHERE length(p) BETWEEN 1 AND 500 UNION ALL SELECT doc_id, i, 0, '', 0, true FROM ln WHERE length(p) > 500 UNION ALL SELECT doc_id, i, j, s, 0, false FROM st UNION ALL SELECT DISTINCT doc_id, 1000000000, 0, '', 0, true FROM ln),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM it),
r AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, '' AS cur, NULL::VARCHAR AS done FROM o
  UNION ALL SELECT o.doc_id, o.k, CASE WHEN flush THEN '' WHEN length(cur) + length(s) + glue <= 500 THEN CASE WHEN glue = 1 AND cur <> '' THEN cur || chr(10) || s ELSE cur || s END ELSE s END,
    CASE WHEN (flush OR length(cur) + length(s) + glue > 500) AND cur <> '' THEN cur END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1),
c AS (SELECT doc_id, k, CASE WHEN lag(done) OVER w IS NOT NULL THEN right(lag(done) OVER w, 100) || chr(10) || done ELSE done END AS t FROM r WHERE done IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_no, length(t) AS n_chars, md5(t) AS digest FROM c WHERE length(regexp_replace(t, '^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$', '', 'g')) > 30"""
ORACLE = {
    "chunk_documents": _CHUNKS,
    "bm25_topk": _BM25 + "SELECT query_id, rank, chunk_index, round(bm25, 4) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_index DESC) AS rank FROM bm WHERE bm25 > 0) WHERE rank <= 5",
    "bm25_fused_topk": _BM25 + "SELECT query_id, rank, chunk_index, round(score, 4) AS score, round(bm25, 4) AS bm25, round(credibility, 3) AS credibility, tier FROM rk WHERE rank <= 5",
    "tier_quota": _BM25 + ", " + _QUOTA + " SELECT query_id, slot, chunk_index, tier, round(score, 4) AS score FROM t",
    "lang_quota": _BM25 + f""", e AS (SELECT *, coalesce({_ENGLISH} AND length(regexp_replace(coalesce(filename, ''), '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) < 0.2 * length(coalesce(filename, '')), false) AS english FROM rk WHERE rank <= 100),
h AS (SELECT *, count(*) FILTER (english) OVER (PARTITION BY query_id) AS n_en, row_number() OVER (PARTITION BY query_id, english ORDER BY rank DESC) AS fe FROM e WHERE rank <= 5),
x AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS fe, chunk_index AS cx, score AS sx FROM e WHERE rank > 5 AND english AND score >= 25)
SELECT h.query_id, h.rank AS slot, coalesce(cx, chunk_index) AS chunk_index, round(coalesce(sx, score), 4) AS score FROM h LEFT JOIN x ON x.query_id = h.query_id AND x.fe = h.fe AND NOT h.english AND h.fe <= 2 - h.n_en""",
    "search_pipeline": _STORE + _ASKED + ", " + _hits("qx") + ", " + _hits("paper_eval_items_v2", "2") + ", " + _QUOTA + f""", {_TARGETS}, fx AS (SELECT 'F002' AS query_id, min(chunk_index) AS chunk_index FROM papers_index WHERE starts_with(filename, 'kessary')),
g AS (SELECT t.*, c.filename FROM t JOIN papers_index c USING (chunk_index) JOIN paper_eval_items_v2 i ON i.id = t.query_id WHERE t.query_id <> 'F002' AND NOT (length(q) <= 40 AND coalesce(expect_refuse, false))),
pool AS (SELECT * FROM rk2 WHERE rank <= 200 AND query_id IN (SELECT query_id FROM g)),
ld AS (SELECT * FROM (SELECT p.query_id, 0 AS seg, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, rank) AS pos, chunk_index, filename, tier, score FROM pool p JOIN tg USING (query_id, filename)) WHERE pos <= 3),
tl AS (SELECT query_id, 1 AS seg, slot AS pos, chunk_index, filename, tier, score FROM g UNION ALL
  SELECT query_id, 2, rank, chunk_index, filename, tier, score FROM pool WHERE query_id IN (SELECT query_id FROM ld) AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.query_id = pool.query_id AND tg.filename = pool.filename)),
al AS (SELECT * FROM ld UNION ALL SELECT * FROM tl WHERE NOT EXISTS (SELECT 1 FROM ld WHERE ld.query_id = tl.query_id AND ld.chunk_index = tl.chunk_index))
SELECT query_id, CAST(slot AS INT) AS slot, chunk_index, filename, tier, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seg, pos) AS slot FROM al) WHERE slot <= 5
UNION ALL SELECT query_id, 1, chunk_index, filename, 'A', NULL FROM fx JOIN papers_index USING (chunk_index)""",
    "stored_index": "WITH " + _postings("papers_index").strip() + " SELECT 'pieces' AS part, count(*) AS n FROM papers_index UNION ALL SELECT 'postings', count(*) FROM postings UNION ALL SELECT 'tokens', count(DISTINCT token) FROM postings UNION ALL SELECT 'empty', 0",
    "authoritative_trigger": f"WITH {_TARGETS} SELECT query_id, filename FROM tg",
    "authoritative_pin": _BM25 + f""", {_TARGETS}, pool AS (SELECT * FROM rk WHERE rank <= 200),
ld AS (SELECT * FROM (SELECT p.query_id, 0 AS seg, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, rank) AS pos, chunk_index, score FROM pool p JOIN tg USING (query_id, filename)) WHERE pos <= 3),
tl AS (SELECT query_id, 1 AS seg, rank AS pos, chunk_index, score FROM pool WHERE rank <= 5 UNION ALL
  SELECT query_id, 2, rank, chunk_index, score FROM pool WHERE query_id IN (SELECT query_id FROM ld) AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.query_id = pool.query_id AND tg.filename = pool.filename)),
al AS (SELECT * FROM ld UNION ALL SELECT * FROM tl WHERE NOT EXISTS (SELECT 1 FROM ld WHERE ld.query_id = tl.query_id AND ld.chunk_index = tl.chunk_index))
SELECT query_id, slot, chunk_index, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seg, pos) AS slot FROM al) WHERE slot <= 5""",
    "relevance_gate": _BM25 + "SELECT query_id, rank, chunk_index FROM rk WHERE rank <= 5 AND query_id NOT IN (SELECT id FROM paper_eval_items_v2 WHERE length(q) <= 40 AND coalesce(expect_refuse, false))",
    "context_budget": _BM25 + """, p AS (SELECT *, coalesce(nullif(filename, ''), nullif(title, ''), 'unknown') AS name FROM rk WHERE rank <= 15),
g AS (SELECT query_id, name, min(rank) AS first, min_by(coalesce(title, ''), rank) AS title, count(*) AS m, string_agg(coalesce(text, ''), chr(10) || '---' || chr(10) ORDER BY rank) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY rank) AS nth FROM p) WHERE nth <= 3 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS i FROM g),
t AS (SELECT query_id, i, '[' || i || '] ' || coalesce(nullif(title, ''), name) || CASE WHEN m > 1 THEN ' (' || m || ' hits)' ELSE '' END || chr(10) || body || chr(10) AS entry FROM o),
u AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY i) AS upto FROM t),
c AS (SELECT query_id, coalesce(string_agg(entry, chr(10) ORDER BY i) FILTER (upto <= 6000), '') AS context FROM u GROUP BY query_id)
SELECT query_id, length(context) AS n_chars, md5(context) AS digest FROM c""",
    "sources_list": _BM25 + """, h AS (SELECT * FROM rk WHERE rank <= 10 AND filename <> ''), pg AS (SELECT query_id, filename, page, min(rank) AS f FROM h WHERE page <> '' GROUP BY ALL),
ps AS (SELECT query_id, filename, string_agg(page, ',' ORDER BY f) AS pages FROM pg GROUP BY ALL)
SELECT query_id, filename, title, tier, coalesce(pages, '') AS pages FROM (SELECT query_id, filename, title, tier, row_number() OVER (PARTITION BY query_id, filename ORDER BY rank) AS n FROM h) LEFT JOIN ps USING (query_id, filename) WHERE n = 1""",
    "forced_recall": _BM25 + """, f AS (SELECT * FROM (VALUES ('F001', 0), ('F003', 1), ('F005', 2)) v(fq, o)),
u AS (SELECT query_id, 0 AS seg, rank, filename, text, chunk_index FROM rk WHERE rank <= 5 UNION ALL
  SELECT i.id, 1, o * 5 + r.rank, r.filename, r.text, r.chunk_index FROM paper_eval_items_v2 i CROSS JOIN f JOIN rk r ON r.query_id = f.fq AND r.rank <= 5 AND r.score >= 10),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(filename, ''), left(coalesce(text, ''), 50) ORDER BY seg, rank) AS nth FROM u)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seg, rank) AS slot, chunk_index FROM k WHERE seg = 0 OR nth = 1""",
    "answer_route": _BM25 + """SELECT i.id AS query_id, CASE WHEN contains(q, '四月') THEN 'no_results' WHEN coalesce(score, 0) >= 20 THEN 'context' WHEN contains(lower(q), 'how should') OR contains(q, '应怎样') THEN 'general' ELSE 'no_evidence' END AS route
FROM paper_eval_items_v2 i LEFT JOIN (SELECT * FROM rk WHERE rank = 1) r ON r.query_id = i.id""",
    "k_by_mode": "SELECT CASE WHEN mode = 'audit' THEN 15 WHEN think = 1 THEN 10 ELSE 5 END AS k, count(*) AS n FROM chat_log GROUP BY ALL",
    "token_bag": f"SELECT token, count(*) AS n FROM ({_TOK.format(key='doc_id', t='text', src='documents')}) GROUP BY token",
    "doc_freq": "WITH " + _postings("papers_index").strip() + " SELECT token, count(*) AS df FROM postings GROUP BY token",
    "weighted_tokens": "WITH " + _postings("papers_index").strip() + " SELECT chunk_index, token, tf FROM postings",
    "index_stats": "SELECT count(*) AS n_chunks, count(DISTINCT nullif(filename, '')) AS n_files, md5((SELECT string_agg(f, '|' ORDER BY f) FROM (SELECT DISTINCT filename AS f FROM papers_index WHERE filename <> ''))) AS files_digest, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS status FROM papers_index",
    "drop_and_rebuild": "WITH kept AS (SELECT * FROM papers_index WHERE filename IS NULL OR NOT starts_with(filename, 'kessary')), " + _postings("kept").strip() + " SELECT token, count(*) AS df FROM postings GROUP BY token",
    "joined_body": "WITH b AS (SELECT filename, left(string_agg(coalesce(text, ''), chr(10) ORDER BY chunk_index), 20000) AS body FROM papers_index GROUP BY filename) SELECT filename, length(body) AS n_chars, md5(body) AS digest FROM b",
    "safe_names": "SELECT doc_id, left(regexp_replace(title, '[^\\p{L}\\p{N}._-]', '_', 'g'), 150) AS safe FROM documents",
    "text_language": """WITH s AS (SELECT chunk_index, text, length(regexp_replace(coalesce(text, ''), '[\\s\\x{3000}\\x{00A0}\\x{2000}-\\x{200A}\\x{0B}\\x{85}\\x{2028}\\x{2029}]+', '', 'g')) AS n, length(regexp_replace(coalesce(text, ''), '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) AS z FROM papers_index)
SELECT chunk_index, n > 0 AND z < 0.05 * n AS english, n > 0 AND z >= 0.3 * n AS chinese, CASE WHEN text IS NOT NULL THEN n END AS n_solid FROM s""",
    "credibility_score": _SCORED + " SELECT filename, credibility, tier FROM t",
    "tier_hist": _SCORED + " SELECT tier, count(*) AS n FROM t GROUP BY tier",
    "incremental_targets": f"WITH {_DIMS} SELECT filename FROM d WHERE filename NOT IN (SELECT filename FROM d WHERE venue > 0.8 AND (recency IS NULL OR NOT recency < 0.6))",
    "merge_scores": _SCORED + " SELECT CASE WHEN filename LIKE 'k%' THEN '?' ELSE tier END AS tier, count(*) AS n FROM t GROUP BY 1",
    "sensitivity_single": f"SELECT vector, n_changed FROM ({_changes(C.perturbed())})",
    "sensitivity_equal": _changes([("equal", (0.2,) * 5)]),
    "sensitivity_random": f"SELECT avg(n_changed) AS mean_changed, max(n_changed) AS most_changed FROM ({_changes(C.random_weights())})",
    "sensitivity_excluded": _SCORED + f" SELECT tier, count(*) AS n, 'all' AS files FROM t GROUP BY tier UNION ALL SELECT tier, count(*), 'without' FROM t WHERE filename IS DISTINCT FROM '{EXCLUDED}' GROUP BY tier",
    "study_scores": "WITH e AS (SELECT filename, min(doc_kind) AS k, min(journal) AS j, min(citation_year) AS y FROM extracted GROUP BY filename) SELECT filename, CASE k WHEN '原始实验' THEN 0.85::DOUBLE WHEN '综述' THEN 0.55::DOUBLE ELSE 0.4::DOUBLE END AS study, CASE WHEN contains(j, '学报') THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS venue, CASE WHEN k = '综述' THEN 1.0::DOUBLE WHEN y IS NULL THEN NULL WHEN 2026 - y <= 5 THEN 1.0::DOUBLE WHEN 2026 - y <= 10 THEN 0.8::DOUBLE WHEN 2026 - y <= 20 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS recency FROM e",
    "paper_text": "SELECT doc_id, concat_ws(chr(10), 'title: ' || nullif(title, ''), 'source: ' || nullif(source, ''), 'year: ' || pub_year, 'language: ' || nullif(lang, '')) AS body FROM documents",
    "keyword_files": "SELECT keyword, filename, row_number() OVER (PARTITION BY keyword ORDER BY first) AS nth FROM (SELECT keyword, filename, min(chunk_index) AS first FROM papers_index JOIN (VALUES ('kessary'), ('ocr'), ('2013'), ('rusk'), ('nothing')) k(keyword) ON contains(lower(filename), keyword) GROUP BY ALL)",
}
