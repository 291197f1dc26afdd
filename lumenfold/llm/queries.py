"""Queries over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import leaks, mixing, pairs, pii, scans, splitting, subjects, term_counts
from lumenfold.plans import lineage
from lumenfold.sources import tables


GROWING = ("papers_index", "chat_log", "documents", "paper_eval_answers_v3")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    t = tables.table(spark, folder, name)
    return lineage.spread(t) if name in GROWING else t


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noise(table(spark, folder, "papers_index"))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired(table(spark, folder, "papers_index"))


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "papers_index")
    return term_counts.marked(term_counts.term_counts(rows), rows).drop("term_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_terms(spark, folder).where("mark is not null").select("term", "mark")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.kinds(table(spark, folder, "chat_log"), "id", ("prompt", "answer"))


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "chat_log").select("id", "prompt", "answer").dropDuplicates(["id"])
    return pii.redacted(log, ("prompt", "answer"))


def _oversized(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.ranges(table(spark, folder, "papers_index").where(f"length(text) > {splitting.LIMIT}"), "chunk_index", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.boundary_kinds(_oversized(spark, folder)).selectExpr("cast(id as bigint) as chunk_index", "boundary")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(_oversized(spark, folder)).withColumn("id", F.col("id").cast("bigint")).withColumnRenamed("id", "chunk_index")


def p5_files(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the index as a few large files, cut by byte ranges that no task reads beyond: (file, piece_no, cut, n_chars, digest)."""
    place = lineage.place(spark, "texts")
    texts = tables.table(spark, folder, "papers_index").where("text is not null").repartitionByRange(4, "chunk_index").sortWithinPartitions("chunk_index")
    texts.select("text").write.text(place, lineSep="\n\n")
    cut = splitting.pieces(splitting.file_ranges(spark, place))
    return cut.select(F.regexp_extract("id", r"part-(\d+)", 1).alias("file"), "piece_no", "cut", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    logged = pairs.log_pairs(table(spark, folder, "chat_log"))
    answered = pairs.evaluation_pairs(table(spark, folder, "paper_eval_answers_v3"), table(spark, folder, "paper_eval_items_v2"))
    return pairs.defects(logged.unionByName(answered)).distinct()


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "paper_eval_items_v2"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).where("verbatim").select("doc_id", "item_id").distinct()


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, folder), table(spark, folder, "mix_targets"))


def p10_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects(*(table(spark, folder, t) for t in ("documents", "subject_labels", "subjects", "paper_eval_items_v2")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_subjects(spark, folder).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(p10_subjects(spark, folder), table(spark, folder, "documents"))


_TERMS = """
WITH r AS (SELECT chunk_index, lower(text) AS t FROM papers_index),
runs AS (
  SELECT chunk_index, unnest(regexp_extract_all(t, '[a-z]{2,}')) AS term FROM r
  UNION ALL
  SELECT chunk_index, substr(run, i, 2) AS term FROM (
    SELECT chunk_index, run, unnest(range(1, length(run))) AS i FROM (
      SELECT chunk_index, unnest(regexp_extract_all(t, '[\\x{4E00}-\\x{9FFF}]{2,}')) AS run FROM r))
), c AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT chunk_index) AS n_rows FROM runs GROUP BY term
)
SELECT term, occurrences, n_rows,
       CASE WHEN n_rows <= 2 THEN 'rare' WHEN n_rows > (SELECT count(*) FROM papers_index) * 0.2 THEN 'common' END AS mark
FROM c
"""

_CJK = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}"


def _tokens(c: str) -> str:
    """Lower-case words and single Chinese characters without accents, marks and the difference of full and half width."""
    full, half = ("".join(chr(base + i) for i in range(94) if i != 6) for base in (0xFF01, 0x21))
    bare = f"regexp_replace(translate({c}, '{full}', '{half}'), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    return f"regexp_extract_all(regexp_replace(lower(strip_accents({bare})), '([{_CJK}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"


#: Runs of 12 words or 20 Chinese characters that a document and an item share.
_LEAKS = f"""
WITH i AS (SELECT id, {_tokens('q')} AS t FROM paper_eval_items_v2 UNION ALL SELECT id, {_tokens('rubric')} FROM paper_eval_items_v2), d AS (SELECT doc_id, {_tokens('text')} AS t FROM documents),
n AS (SELECT * FROM (VALUES (12, false), (20, true)) v(n, zh)),
iw AS (SELECT DISTINCT id, n, zh, array_to_string(t[k:k + n - 1], ' ') AS w FROM (SELECT id, n, zh, t, unnest(range(1, len(t) - n + 2)) AS k FROM i, n)),
dw AS (SELECT DISTINCT doc_id, n, array_to_string(t[k:k + n - 1], ' ') AS w FROM (SELECT doc_id, n, t, unnest(range(1, len(t) - n + 2)) AS k FROM d, n))
SELECT DISTINCT doc_id, id AS item_id FROM iw JOIN dw USING (n, w) WHERE regexp_full_match(w, CASE WHEN zh THEN '[{_CJK} ]+' ELSE '[^{_CJK}]+' END)
"""
#: Units of oversized texts: paragraphs, and sentences within them, without the blanks around them.
_BOUNDARY = r"""
WITH x AS (SELECT chunk_index, replace(replace(text, chr(13) || chr(10), chr(29) || chr(10)), chr(13), chr(10)) AS t FROM papers_index WHERE length(text) > 1000),
p AS (SELECT chunk_index, unnest(regexp_split_to_array(t, '[ \t\f\v\x{1D}\x{3000}\x{A0}]*\n(?:[ \t\f\v\x{1D}\x{3000}\x{A0}]*\n)+')) AS u FROM x),
s AS (SELECT chunk_index, unnest(string_split(regexp_replace(u, '([。！？；!?…]+["”’』」）)\]]*|\.+["”’)\]]*(?:[\s\x{3000}\x{A0}]|$))', '\1' || chr(30), 'g'), chr(30))) AS u FROM p),
l AS (SELECT chunk_index, max(length(regexp_replace(u, '^[\s\x{1D}\x{3000}\x{A0}]+|[\s\x{1D}\x{3000}\x{A0}]+$', '', 'g'))) AS n, true AS par FROM p GROUP BY chunk_index UNION ALL SELECT chunk_index, max(length(regexp_replace(u, '^[\s\x{1D}\x{3000}\x{A0}]+|[\s\x{1D}\x{3000}\x{A0}]+$', '', 'g'))), false FROM s GROUP BY chunk_index)
SELECT chunk_index, CASE WHEN max(n) FILTER (par) <= 900 THEN 'paragraph' WHEN max(n) FILTER (NOT par) <= 900 THEN 'sentence' ELSE 'inside' END AS boundary FROM l GROUP BY chunk_index
"""

QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p3_found": p3_found, "p3_terms": p3_terms, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_files": p5_files, "p6_found": p6_found, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_composition": p10_composition}
ORACLE = {"p3_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL", "p3_terms": _TERMS, "p5_found": _BOUNDARY, "p8_found": _LEAKS}
