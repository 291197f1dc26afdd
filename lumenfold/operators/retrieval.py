"""Ranked retrieval: BM25, credibility fusion, quotas, pinning, context and routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T

K1, B = 1.5, 0.75
CRED_DEFAULT = 0.6
#: Tokens of queries that are sent to all tasks at most; more meet the postings in a shuffle.
SENT = 500_000


def tier(c: Column) -> Column:
    return F.when(c >= 0.8, "A").when(c >= 0.6, "B").otherwise("C")


def bm25(queries: DataFrame, postings: DataFrame, doc_freq: DataFrame, totals: DataFrame) -> DataFrame:
    """(query_id, chunk_index, bm25) where the score is above 0.

    queries has query_id and query; the others are the parts of an index. Each
    occurrence of a token in a query counts; the length of a piece is its
    characters. Rare tokens meet few postings, so the join grows with matches,
    never with queries x pieces. Sums are rounded to nine places, so that equal
    pieces tie however the work is spread.
    """
    asked = queries.select("query_id", F.explode(T.tokens(F.coalesce("query", F.lit("")))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    weight = asked.join(doc_freq, "token").crossJoin(F.broadcast(totals)).select("query_id", "token", "avgdl", (F.col("qtf") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("weight"))  # totals is one row
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    return (
        postings.join(F.broadcast(weight) if asked.count() <= SENT else weight, "token")
        .groupBy("query_id", "chunk_index").agg(F.round(F.sum(F.col("weight") * F.col("tf") * (K1 + 1) / norm), 9).alias("bm25"))
        .where("bm25 > 0")
    )


def fused(scores: DataFrame, chunks: DataFrame, credibility: DataFrame, default: float = CRED_DEFAULT) -> DataFrame:
    """Scores with the file of each piece, its credibility and tier: score = bm25 * (0.4 + 0.6 * credibility), default for unscored files."""
    cred = F.coalesce(F.col("credibility"), F.lit(default))
    return (
        scores.join(chunks.select("chunk_index", "filename"), "chunk_index")
        .join(credibility.select("filename", "credibility"), "filename", "left")
        .withColumn("credibility", cred).withColumn("score", F.round(F.col("bm25") * (0.4 + 0.6 * F.col("credibility")), 9))
        .withColumn("tier", tier(F.col("credibility")))
    )


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with title, text and page; texts are joined only to the hits that are kept."""
    return hits.join(chunks.select("chunk_index", "title", "text", "page"), "chunk_index")


def pool_size(k: int) -> int:
    """How many candidates stand behind k results."""
    return max(10 * k, 100)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with rank; ties go to the later piece."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("bm25"), F.desc("credibility"), F.desc("chunk_index"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tier_quota(pool: DataFrame, k: int, min_a: int = 1, max_c: int = 2) -> DataFrame:
    """(query_id, slot, chunk_index, tier, score): top k with at least min_a of tier A and at most max_c of tier C.

    pool has query_id, rank from 1, chunk_index, tier, bm25 and score. Missing As
    come from the rest of the pool, best first, and take the last slots without
    an A; Cs beyond max_c give way, in slot order, to the next of the rest that
    is no C and is not in use, as far as there are any. The result is ordered by
    score rounded to four places, slots breaking ties.
    """
    q = Window.partitionBy("query_id")
    head, rest = pool.where(F.col("rank") <= k), pool.where(F.col("rank") > k)
    head = head.withColumns({
        "n_a": F.sum(F.when(F.col("tier") == "A", 1).otherwise(0)).over(q),
        "from_end": F.when(F.col("tier") != "A", F.row_number().over(Window.partitionBy("query_id", F.col("tier") != "A").orderBy(F.desc("rank")))),
    })
    cols = ["chunk_index", "tier", "score"]
    extra = (
        rest.where("tier = 'A' and bm25 > 0").withColumn("nth", F.row_number().over(q.orderBy("rank"))).where(F.col("nth") <= min_a)
        .select("query_id", "nth", F.col("rank").alias("src"), *[F.col(c).alias(f"x_{c}") for c in cols])
    )
    take = (F.col("from_end") == F.col("nth")) & (F.col("nth") <= min_a - F.col("n_a"))
    step1 = head.alias("h").join(extra.alias("e"), (F.col("h.query_id") == F.col("e.query_id")) & take, "left").select(
        "h.query_id", F.col("h.rank").alias("slot"), F.coalesce("src", "h.rank").alias("src"), *[F.when(F.col("src").isNotNull(), F.col(f"x_{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in cols]
    )
    c_rank = F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(F.desc(F.round("score", 4)), "slot"))
    step1 = step1.withColumn("dropped", (F.col("tier") == "C") & (c_rank > max_c))
    step1 = step1.withColumn("nth", F.when(F.col("dropped"), F.row_number().over(Window.partitionBy("query_id", "dropped").orderBy("slot"))))
    used = step1.select("query_id", F.col("src").alias("rank"))
    fill = (
        rest.where("tier <> 'C'").join(used, ["query_id", "rank"], "left_anti").withColumn("nth", F.row_number().over(q.orderBy("rank")))
        .select("query_id", "nth", *[F.col(c).alias(f"y_{c}") for c in cols])
    )
    step2 = step1.join(fill, ["query_id", "nth"], "left").select("query_id", "slot", *[F.coalesce(f"y_{c}", c).alias(c) for c in cols])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 4)), "slot")
    return step2.withColumn("slot", F.row_number().over(order))


def language_quota(pool: DataFrame, k: int, least: int = 2, floor: float = 25.0) -> DataFrame:
    """Top k in which the last slots that are not English give way to English pieces of the rest with score floor or more, until least are in."""
    q = Window.partitionBy("query_id")
    head, rest = pool.where(F.col("rank") <= k), pool.where(F.col("rank") > k)
    head = head.withColumns({
        "n_en": F.sum(F.col("english").cast("int")).over(q),
        "from_end": F.when(~F.col("english"), F.row_number().over(Window.partitionBy("query_id", "english").orderBy(F.desc("rank")))),
    })
    extra = rest.where(F.col("english") & (F.col("score") >= floor)).withColumn("nth", F.row_number().over(q.orderBy("rank"))).where(F.col("nth") <= least).select("query_id", "nth", F.col("chunk_index").alias("x_chunk"), F.col("score").alias("x_score"))
    take = (F.col("from_end") == F.col("nth")) & (F.col("nth") <= F.least(F.lit(least), F.lit(k)) - F.col("n_en"))
    return head.alias("h").join(extra.alias("e"), (F.col("h.query_id") == F.col("e.query_id")) & take, "left").select("h.query_id", F.col("h.rank").alias("slot"), F.coalesce("x_chunk", "chunk_index").alias("chunk_index"), F.coalesce("x_score", "score").alias("score"))


def pinned(results: DataFrame, pool: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Results led by the best pool rows of each query's target files.

    results and pool have query_id, rank, filename, chunk_index, tier and score; targets
    has query_id and filename. At most min(hits, max(1, k // 2 + 1), 5, k) lead;
    after them come the results and then the pool without target files, without
    what leads, cut at k. Queries without a target in the pool keep their results.
    """
    most = min(max(1, k // 2 + 1), 5, k)
    hit = pool.join(targets, ["query_id", "filename"], "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))
    lead = hit.where(F.col("pos") <= most).select("query_id", F.lit(0).alias("seg"), "pos", "filename", "chunk_index", "tier", "score")
    others = pool.join(targets, ["query_id", "filename"], "left_anti").join(lead.select("query_id").distinct(), "query_id", "left_semi")
    tail = results.select("query_id", F.lit(1).alias("seg"), F.col("rank").alias("pos"), "filename", "chunk_index", "tier", "score").unionAll(
        others.select("query_id", F.lit(2).alias("seg"), F.col("rank").alias("pos"), "filename", "chunk_index", "tier", "score"))
    tail = tail.join(lead.select("query_id", "chunk_index"), ["query_id", "chunk_index"], "left_anti").select(lead.columns)
    w = Window.partitionBy("query_id").orderBy("seg", "pos")
    return lead.unionAll(tail).withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= k).select("query_id", "slot", "filename", "chunk_index", "tier", "score")


def contexts(hits: DataFrame, budget: int = 6000, per_file: int = 3) -> DataFrame:
    """(query_id, context): one entry a file in order of first hit, at most per_file pieces each, up to the first that exceeds the budget."""
    name = F.coalesce(F.nullif("filename", F.lit("")), F.nullif("title", F.lit("")), F.lit("unknown"))
    h = hits.withColumn("name", name).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "name").orderBy("rank")))
    one = h.where(F.col("nth") <= per_file).groupBy("query_id", "name").agg(
        F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"), F.min_by("title", "rank").alias("title"))
    one = one.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    entry = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.coalesce(F.nullif("title", F.lit("")), "name"), F.when(F.size("parts") > 1, F.concat(F.lit(" ("), F.size("parts").cast("string"), F.lit(" hits)"))).otherwise(""), F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n---\n"), F.lit("\n"))
    one = one.withColumn("entry", entry).withColumn("upto", F.sum(F.length("entry")).over(Window.partitionBy("query_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    kept = one.where(F.col("upto") <= budget).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "entry"))).alias("e"))
    return hits.select("query_id").distinct().join(kept, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("e", lambda x: x["entry"]), "\n"), F.lit("")).alias("context"))


def sources(hits: DataFrame) -> DataFrame:
    """(query_id, filename, title, tier, pages): the first title and tier of each file, its distinct pages in order."""
    pages = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("page") != "", F.struct("rank", "page")))), lambda x: x["page"]))
    return hits.where("filename <> ''").groupBy("query_id", "filename").agg(F.min_by("title", "rank").alias("title"), F.min_by("tier", "rank").alias("tier"), F.array_join(pages, ",").alias("pages"))


def rule_targets(queries: DataFrame, files: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """(query_id, filename): files that rules (keyword, start of the file's name) name for queries that hold the keyword.

    Queries and files meet on the rule's number, so no query meets a file that no
    rule gives it; the rules are configuration and become conditions of one scan
    on either side.
    """
    on = lambda conditions: F.explode(F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]), lambda x: x.isNotNull())).alias("rule")
    asked = queries.select("query_id", on([F.contains(F.lower("query"), F.lit(k.lower())) for k, _ in rules])).distinct()
    named = files.select("filename").distinct().select("filename", on([F.startswith("filename", F.lit(start)) for _, start in rules]))
    return asked.join(named, "rule").select("query_id", "filename").distinct()


def for_each_query(rows: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """The given rows, at most so many, once for each query."""
    listed = rows.limit(most).agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))  # one row of at most so many
    return queries.select("query_id").crossJoin(F.broadcast(listed)).select("query_id", F.inline("_rows"))


def gate_keys(results: DataFrame, n: int = 5, most: int = 50) -> DataFrame:
    """(query_id, key): under which a verdict on the results of a query is remembered, from the query and its first n files.

    results has query_id, query, slot and filename.
    """
    names = F.array_sort(F.collect_list(F.when(F.col("slot") <= n, F.struct("slot", F.left(F.coalesce("filename", F.lit("")), F.lit(most)).alias("f")))))
    return results.groupBy("query_id").agg(F.concat(F.first("query"), F.lit("||"), F.array_join(F.transform(names, lambda x: x["f"]), "|")).alias("key"))


def gated(results: DataFrame, verdicts: DataFrame, most: int = 40) -> DataFrame:
    """results without those of queries of at most so many characters whose key has a verdict that they are not relevant.

    verdicts has key and relevant; without a verdict results are kept, also where it is null.
    """
    short = results.where(F.length("query") <= most)
    no = gate_keys(short).join(verdicts.where("not relevant").select("key"), "key", "left_semi").select("query_id")
    return results.join(no, "query_id", "left_anti")


def search(queries: DataFrame, pieces: DataFrame, postings: DataFrame, doc_freq: DataFrame, totals: DataFrame, credibility: DataFrame, k: int,
           keep: Callable[[DataFrame, str], DataFrame], fixed: DataFrame | None = None, verdicts: DataFrame | None = None, targets: DataFrame | None = None, longest: int = 80, pinned_from: int = 200) -> DataFrame:
    """(query_id, slot, chunk_index, filename, tier, score): the results of each query, from slot 1.

    queries has query_id, query and, if there is one, expansion. In order: a
    query with a fixed line (query_id, chunk_index) has that alone; one of at
    most longest characters, mostly Chinese, is searched with its expansion; its
    candidates pass the tier quota; the results are dropped if the verdict says
    so; those left are led by pieces of target files (query_id, filename), from
    a pool of the query as asked. Blank queries and k below 1 have no results.
    keep(table, name) writes an intermediate table and reads it again.
    """
    schema = "query_id string, slot int, chunk_index bigint, filename string, tier string, score double"
    if k < 1:
        return queries.sparkSession.createDataFrame([], schema)
    asked = queries.where(F.length(T.strip(F.coalesce("query", F.lit("")))) > 0)
    cols = ["query_id", "slot", "chunk_index", "filename", "tier", "score"]
    lead = None
    if fixed is not None:
        lead = fixed.join(asked.select("query_id"), "query_id", "left_semi").join(pieces.select("chunk_index", "filename"), "chunk_index").select("query_id", F.lit(1).alias("slot"), "chunk_index", "filename", F.lit("A").alias("tier"), F.lit(None).cast("double").alias("score"))
        asked = asked.join(fixed.select("query_id"), "query_id", "left_anti")
    text = F.col("query")
    if "expansion" in queries.columns:
        text = F.when((F.length("query") <= longest) & T.mostly_chinese(F.col("query")) & (F.coalesce("expansion", F.lit("")) != ""), F.concat_ws(" ", "query", "expansion")).otherwise(F.col("query"))
    asked = asked.select("query_id", "query", text.alias("text"))

    def ranked(text: str, most: int, of: DataFrame) -> DataFrame:
        hits = bm25(of.select("query_id", F.col(text).alias("query")), postings, doc_freq, totals)
        return keep(top_k(fused(hits, pieces, credibility), most), "pool")

    pool = ranked("text", pool_size(k), asked)
    out = tier_quota(pool, k).join(pieces.select("chunk_index", "filename"), "chunk_index").join(asked.select("query_id", "query"), "query_id")
    if verdicts is not None:
        out = gated(keep(out, "results"), verdicts)
    out = out.select(*cols)
    if targets is not None:
        out = keep(out, "results")
        wide = ranked("query", pinned_from, asked.join(targets.select("query_id"), "query_id", "left_semi"))
        out = pinned(out.withColumn("rank", F.col("slot")), wide.join(out.select("query_id").distinct(), "query_id", "left_semi"), targets, k).select(*cols)
    return out if lead is None else out.unionByName(lead)


def forced_union(results: DataFrame, extra: DataFrame, floor: float = 10.0) -> DataFrame:
    """results, then extra rows of score floor or more whose (filename, first 50 characters) are not seen yet; first wins."""
    both = results.withColumn("seg", F.lit(0)).unionByName(extra.where(F.col("score") >= floor).withColumn("seg", F.lit(1)))
    key = Window.partitionBy("query_id", F.coalesce("filename", F.lit("")), F.left(F.coalesce("text", F.lit("")), F.lit(50))).orderBy("seg", "rank")
    keep = both.withColumn("nth", F.row_number().over(key)).where("seg = 0 or nth = 1")
    return keep.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy("seg", "rank"))).drop("seg", "nth")


def route(firsts: DataFrame, floor: float = 20.0) -> DataFrame:
    """route of each query by its first row: context, general, no_evidence or no_results."""
    good = F.coalesce(F.col("authoritative"), F.lit(False)) | (F.coalesce(F.col("score"), F.lit(0.0)) >= floor)
    return firsts.withColumn("route", F.when(~F.col("on_topic"), "no_results").when(good, "context").when(F.col("methodology"), "general").otherwise("no_evidence"))


def rows_for_mode(mode: Column, think: Column) -> Column:
    return F.when(mode == "audit", 15).when(think == 1, 10).otherwise(5)
