"""Rule-based routing of texts, rule tables, follow-ups, verdicts and pass rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as T


def has_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether c holds one of the words, without regard to case; a word may stand within another."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def meta_question(c: Column, strong: tuple[str, ...], subjects: tuple[str, ...], actions: tuple[str, ...]) -> Column:
    solid = T.no_space(c)
    return has_any(solid, strong) | has_any(solid, subjects) & has_any(solid, actions)


def scope(c: Column, search: str, full: tuple[str, ...], foreign: tuple[str, ...], allowed: tuple[str, ...]) -> Column:
    """refuse_search, refuse_full, refuse_foreign or null where the text is in scope."""
    solid = T.no_space(F.coalesce(c, F.lit("")))
    whole = F.lit(False)
    for p in full:
        whole = whole | solid.rlike(f"^(?:{p})$")
    return F.when(solid.rlike(search), "refuse_search").when(whole, "refuse_full").when(has_any(c, foreign) & ~has_any(c, allowed), "refuse_foreign")


def first_match(c: Column, rules: list[tuple[str, tuple[str, ...]]], otherwise: str) -> Column:
    """The name of the first rule of which c holds a word."""
    out = F.when(has_any(c, rules[0][1]), rules[0][0])
    for name, words in rules[1:]:
        out = out.when(has_any(c, words), name)
    return out.otherwise(otherwise)


def guard(prompt: Column, image: Column, most: int = 6 * 1024 * 1024) -> Column:
    """The error of a request: empty, bad_image, too_large, or null."""
    bare, pic = F.length(T.strip(F.coalesce(prompt, F.lit("")))) == 0, F.coalesce(image, F.lit(""))
    return F.when(bare & (pic == ""), "empty").when((pic != "") & ~pic.startswith("data:image/"), "bad_image").when(F.length(pic) > most, "too_large")


def strip_followup(c: Column, marker: str) -> Column:
    """c without the lines that begin with marker at its end, however many."""
    return F.regexp_replace(c, rf"(?:\s*(?:^|\n)[ \t]*{marker}[^\n]*)+\s*$", "")


def cut_stream(c: Column, marker: str, heading: str | None = None) -> Column:
    """What a stream shows: up to the first marker, and up to the second place of a heading."""
    out = F.substring_index(c, marker, 1)
    if heading:
        second = F.locate(heading, out, 1)
        again = F.when(second > 0, F.instr(F.substring(out, second + len(heading), F.length(out)), heading)).otherwise(0)
        out = F.when(again > 0, F.left(out, second + len(heading) + again - 2)).otherwise(out)
    return out


def parsed_followups(c: Column, most: int = 26, keep: int = 3) -> Column:
    """Questions of the JSON list in c: quotes stripped, closed by a question mark, not too long, distinct, the first few."""
    raw = F.from_json(F.regexp_extract(c, r"(?s)(\[.*\])", 1), "array<string>")
    clean = F.transform(F.filter(raw, lambda x: x.isNotNull()), lambda x: T.strip(F.regexp_replace(T.strip(x), r"^[\"'“”]+|[\"'“”]+$", "")))
    marked = F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.when(x.rlike(r"[?？]$"), x).otherwise(F.concat(x, F.lit("？"))))
    return F.slice(F.array_distinct(F.filter(marked, lambda x: F.length(x) <= most)), 1, keep)


def question_key(c: Column) -> Column:
    """A question without punctuation, blanks and case."""
    return F.lower(F.regexp_replace(c, r"(?U)[\p{Punct}\p{IsPunctuation}\s]+", ""))


def new_followups(asked: DataFrame, known: DataFrame, refused: Callable[[Column], Column] | None = None) -> DataFrame:
    """Questions whose key is not known, the first of each key; asked has id, question. Those that refused gives a reason for are left out first."""
    if refused is not None:
        asked = asked.where(refused(F.col("question")).isNull())
    fresh = asked.withColumn("k", question_key(F.col("question"))).where("k <> ''").join(known.select(question_key(F.col("question")).alias("k")), "k", "left_anti")
    return fresh.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where("n = 1").select("id", "question")


def rule_sections(rules: DataFrame) -> DataFrame:
    """(section, n, ids) with the number and ids of the rules of each section."""
    ids = F.array_sort(F.collect_list(F.struct("pos", "id")))
    return rules.groupBy("section").agg(F.count("*").alias("n"), F.array_join(F.transform(ids, lambda x: x["id"]), ",").alias("ids"))


def rendered(rules: DataFrame) -> DataFrame:
    """(section, body): each rule as lines, optional parts left out."""
    line = F.concat_ws("\n", F.concat(F.col("id"), F.lit(" "), F.col("item"), F.coalesce(F.concat(F.lit(" (p. "), F.col("page").cast("string"), F.lit(")")), F.lit(""))), F.concat(F.lit("must: "), F.nullif(F.array_join("must", "; "), F.lit(""))), F.concat(F.lit("text: "), F.nullif("official", F.lit(""))), F.concat(F.lit("hint: "), F.nullif("hint", F.lit(""))))
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return rules.groupBy("section").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("body"))


def passed(reply: Column) -> Column:
    """Whether the last line says PASS and not FAIL; an empty reply fails, a missing one gives null."""
    last = F.upper(F.element_at(F.split(T.strip(reply), "\n"), -1))
    return F.contains(last, F.lit("PASS")) & ~F.contains(last, F.lit("FAIL"))


def pass_rates(verdicts: DataFrame) -> DataFrame:
    """(cond, cat, passed, n, rate): by condition and category, and overall for each condition."""
    g = verdicts.groupingSets([["cond", "cat"], ["cond"]], "cond", "cat").agg(F.count_if("pass").alias("passed"), F.count("*").alias("n"), F.grouping("cat").alias("all"))
    return g.select("cond", F.when(F.col("all") == 1, "overall").otherwise(F.col("cat")).alias("cat"), "passed", "n", F.round(F.col("passed") * 100.0 / F.col("n"), 1).alias("rate"))


def latencies(answers: DataFrame) -> DataFrame:
    return answers.groupBy("cond").agg(F.round(F.avg("sec"), 1).alias("mean_sec"))


def work_list(items: DataFrame, conditions: tuple[str, ...], reps: int, done: DataFrame) -> DataFrame:
    """(cond, id, rep) still to be answered. Conditions and repetitions are configuration, exploded from literals."""
    every = items.select("id", F.explode(F.array(*map(F.lit, conditions))).alias("cond")).select("id", "cond", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return every.join(done.select("cond", "id", "rep"), ["cond", "id", "rep"], "left_anti")


def small_talk(prompt: Column, phrases: tuple[str, ...], image: Column | None = None) -> Column:
    """Whether a prompt is small talk that needs no retrieval: it holds one of the phrases, also within a word; never with a picture."""
    talk = has_any(T.strip(prompt), phrases)
    return talk if image is None else talk & ~image


def intent(prompt: Column, image: Column, rules: list[tuple[str, tuple[str, ...]]], judged: Column | None = None, picture: str = "identify", otherwise: str = "concept") -> Column:
    """The intent of a request: with a picture one of its own; blank text has the default; then the first rule, then a judged one, then the default."""
    bare = F.length(T.strip(F.coalesce(prompt, F.lit("")))) == 0
    last = F.lit(otherwise) if judged is None else F.coalesce(judged, F.lit(otherwise))
    out = F.when(F.coalesce(image, F.lit(False)), picture).when(bare, otherwise)
    for name, words in rules:
        out = out.when(has_any(prompt, words), name)
    return out.otherwise(last)


def instruction(name: Column, texts: dict[str, str]) -> Column:
    """The text that an intent adds to a prompt; its name is stripped and in lower case, an unknown or missing one adds nothing."""
    m = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(T.strip(F.coalesce(name, F.lit(""))))), F.lit(""))


#: What an item that is to be mended hits, the gravest first.
IMPACT = ("submission", "reliability", "readability")


def rated(rules: DataFrame, findings: DataFrame, impact: tuple[str, ...] = IMPACT) -> DataFrame:
    """(id, rating, nth): every rule with its rating, and the order in which red ones are to be mended.

    rules has section, pos, id, severe and hits; findings id and rating (green,
    amber, red). A rule that is not mentioned is never left out: it is red where
    severe, else amber. Red ones come by what they hit, then by section and pos.
    """
    r = rules.join(findings.select("id", F.col("rating").alias("_found")), "id", "left")
    r = r.withColumn("rating", F.coalesce("_found", F.when(F.coalesce("severe", F.lit(False)), "red").otherwise("amber")))
    known = F.array_position(F.array(*map(F.lit, impact)), F.col("hits"))
    order = Window.orderBy(F.when(F.coalesce(known, F.lit(0)) > 0, known).otherwise(len(impact) + 1), "section", "pos", "id")
    red = r.where("rating = 'red'").withColumn("nth", F.row_number().over(order))  # as many as there are rules in a checklist
    return red.select("id", "rating", "nth").unionByName(r.where("rating <> 'red'").select("id", "rating", F.lit(None).cast("int").alias("nth")))
