"""Small rules around retrieval and ingestion: fixed lines, expansions, schemas, accounts, summaries, routes, declared scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators.routing import cut_stream, strip_followup


def statutory_line(queries: DataFrame, chunks: DataFrame, pattern: str, start: str, heading: str, until: str, line: str) -> DataFrame:
    """(query_id, chunk_index, line): queries that match a pattern as a whole get a line of a fixed file, past all ranking.

    White space and closing marks of the query are ignored. The line comes from
    the first piece of the file that has the heading, between it and the delimiter.
    """
    asked = queries.where(F.regexp_replace(T.no_space(F.col("query")), r"[?？。.]+$", "").rlike(f"^(?:{pattern})$")).select("query_id")
    body = chunks.where(F.startswith("filename", F.lit(start)) & F.contains("text", F.lit(heading))).agg(F.min_by("text", "chunk_index").alias("text"), F.min("chunk_index").alias("chunk_index"))
    part = F.substring_index(F.substring(F.col("text"), F.instr("text", heading), F.length("text")), until, 1)
    return asked.crossJoin(F.broadcast(body.where("text is not null"))).select("query_id", "chunk_index", F.nullif(F.regexp_extract(part, line, 0), F.lit("")).alias("line"))  # body is one row


def expanded(query: Column, expansion: Column, prefix: str = r"(?i)(?:expansion|terms|关键词)\s*[:：]\s*", most: int = 300) -> Column:
    """query with a cleaned expansion: no quotes, closing points or prefix, at most that long; without one the query alone."""
    clean = F.left(T.strip(F.regexp_replace(F.regexp_replace(T.strip(expansion), r"^[\"'“”]+|[\"'“”。.]+$", ""), f"^{prefix}", "")), F.lit(most))
    return F.concat_ws(" ", query, F.nullif(clean, F.lit("")))


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables under the columns of both; what one lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)


def accounts(raw: DataFrame) -> DataFrame:
    """(account, name, has_password) of account records; names that begin with _ are notes and left out."""
    return raw.where(~F.startswith("account", F.lit("_")) & (F.length(T.strip("account")) > 0)).select("account", F.coalesce(F.nullif("name", F.lit("")), "account").alias("name"), (F.coalesce("password", F.lit("")) != "").alias("has_password"))


def account_error(account: Column, known: Column, most: int = 32) -> Column:
    a = T.strip(F.coalesce(account, F.lit("")))
    return F.when(a == "", "empty").when(F.startswith(a, F.lit("_")), "reserved").when(F.length(a) > most, "too_long").when(known, "exists")


def with_summaries(chunks: DataFrame, summaries: DataFrame, tag: str = "[summary] ") -> DataFrame:
    """Pieces with the summary of each file, where there is one, before the file's own: position -1, then 0, 1, ..."""
    own = Window.partitionBy("filename").orderBy("chunk_index")
    body = chunks.select("filename", F.row_number().over(own).alias("position"), "text").withColumn("position", F.col("position") - 1)
    first = summaries.join(chunks.select("filename").distinct(), "filename", "left_semi").select("filename", F.lit(-1).alias("position"), F.concat(F.lit(tag), "summary").alias("text"))
    return first.unionAll(body)


def cached(files: DataFrame, sidecar: DataFrame, make: Column | None = None, force: bool = False) -> DataFrame:
    """(filename, summary, made): what a sidecar has; the rest, or all on force, by the given expression, else empty."""
    made = F.lit("") if make is None else make
    j = files.join(sidecar.select("filename", F.col("summary").alias("_s")), "filename", "left")
    use = F.col("_s").isNotNull() & F.lit(not force)
    return j.select("filename", F.when(use, F.col("_s")).otherwise(made).alias("summary"), (~use).alias("made"))


def remembered(asked: DataFrame, memo: DataFrame, make: Column, keep_failures: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results, memo) of a lookup by key: what the memo has, else what make gives, null being a failure.

    asked has key, and what make reads; memo key and value. A failure counts as
    an empty value; it is remembered, so that it is not tried again, unless
    keep_failures is false. Of repeated keys in asked each has its row.
    """
    j = asked.join(memo.select("key", F.col("value").alias("_known"), F.lit(True).alias("_hit")), "key", "left").withColumn("_made", F.when(F.col("_hit").isNull(), make))
    results = j.select("key", F.coalesce(F.when(F.col("_hit"), F.col("_known")).otherwise(F.col("_made")), F.lit("")).alias("value"), F.coalesce("_hit", F.lit(False)).alias("hit"))
    new = j.where("_hit is null" if keep_failures else "_hit is null and _made is not null").select("key", F.coalesce("_made", F.lit("")).alias("value")).distinct()
    return results, memo.select("key", "value").unionByName(new)


def finished(answers: DataFrame, tails: dict[str, str], marker: str, heading: str | None = None) -> DataFrame:
    """(id, mode, answer) as logged when an answer has ended: cut at the second place of a heading, closed by the tail of its mode unless it has it, without follow-up lines."""
    text = F.coalesce("answer", F.lit(""))
    if heading:
        text = F.when(F.col("mode") == next(iter(tails)), F.rtrim(cut_stream(text, "\0", heading))).otherwise(text)
    tail = F.element_at(F.create_map(*[F.lit(x) for kv in tails.items() for x in kv]), F.coalesce("mode", F.lit("")))
    closed = F.when(tail.isNull() | F.endswith(F.rtrim(text), tail), text).otherwise(F.concat(text, F.lit("\n\n"), tail))
    return answers.select("id", "mode", strip_followup(closed, marker).alias("answer"))


def prompt_route(mode: Column, image: Column, context: Column, intent: Column) -> Column:
    """Which prompt a request gets: by mode, picture, sentinel of the context, then intent."""
    return F.when(mode == "audit", "audit").when(mode == "protocol", "protocol").when(image, "picture").when(context == "no_results", "plain").when(context == "no_evidence", "decline").when(context == "general", "textbook").otherwise(F.concat(F.lit("cited_"), intent))


def content_micrograms(value: Column, unit: Column) -> Column:
    """A content in ug/g: 1 % = 10 mg/g = 10,000 ug/g = 10,000 ppm."""
    return F.when(unit == "%", value * 10_000).when(unit == "mg/g", value * 1_000).when(unit.isin("ug/g", "ppm"), value)


def document_class(name: Column, rules: list[tuple[str, tuple[str, ...]]], otherwise: str = "article") -> Column:
    hit = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in words])
    out = F.when(hit(rules[0][1]), rules[0][0])
    for kind, words in rules[1:]:
        out = out.when(hit(words), kind)
    return out.otherwise(otherwise)


def completeness(hits: Column, items: Column, kind: Column, fixed: dict[str, float]) -> Column:
    """Share of a checklist that is met; kinds with a fixed value have that."""
    out = F.when(F.lit(False), 0.0)
    for k, v in fixed.items():
        out = out.when(kind == k, v)
    return out.otherwise(F.round(F.try_divide(F.size(F.array_intersect(hits, items)), F.size(items)), 4))


def substitutes(evidence: DataFrame) -> DataFrame:
    """(entity, filename, nth): evidence that may stand in for another, A before green B before amber B; C never."""
    order = F.when(F.col("tier") == "A", 0).when((F.col("tier") == "B") & (F.col("grade") == "green"), 1).when((F.col("tier") == "B") & (F.col("grade") == "amber"), 2)
    e = evidence.withColumn("o", order).where("o is not null")
    return e.select("entity", "filename", F.row_number().over(Window.partitionBy("entity").orderBy("o", F.desc("credibility"), "filename")).alias("nth"))


def rules_table(spark: SparkSession, sections: dict[str, list[dict]]) -> DataFrame:
    """A rule table from a parsed configuration file; missing parts are null or empty."""
    rows = [(s, i, r.get("id", ""), r.get("item", ""), r.get("official"), r.get("page"), r.get("must") or [], r.get("hint")) for s, rules in sections.items() for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "section string, pos int, id string, item string, official string, page int, must array<string>, hint string")
