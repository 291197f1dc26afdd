"""Checks of number series for signs of invention."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECKS = ("lastdigit", "benford", "runlength", "shapiro")


def float_text(c: Column) -> Column:
    """A double as a general text: decimal between 1e-4 and 1e16, at least one place, shortest that reads back."""
    s = c.cast("string")
    plain = (F.abs(c) >= 1e-4) & (F.abs(c) < 1e16) | (c == 0)
    short = F.when(s.rlike("E"), F.when(F.abs(c) >= 1, F.concat(F.format_string("%.0f", c), F.lit(".0"))).otherwise(F.rtrim(c.cast("decimal(38,24)").cast("string"), F.lit("0"))))
    return F.when(plain & s.rlike("E"), short).otherwise(s)


def chi2_sf_even(x: Column, half: int) -> Column:
    """Upper tail of chi squared with 2 * half degrees of freedom, in closed form."""
    h = x / 2
    term = F.lit(0.0)
    for k in range(half):
        term = term + F.pow(h, F.lit(float(k))) / math.factorial(k)
    return F.exp(-h) * term


def chi2_sf_9(x: float) -> float:
    """Upper tail of chi squared with 9 degrees of freedom."""
    h, s = x / 2, 0.0
    for k in range(4):
        s += h ** (k + 0.5) / math.gamma(k + 1.5)
    return math.erfc(math.sqrt(h)) + math.exp(-h) * s


def _sf9(c: Column) -> Column:
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: None if v is None or v != v else chi2_sf_9(float(v))).astype("float64")

    return F.pandas_udf(work, "double")(c)


def last_digits(series: DataFrame, p_values: bool = True) -> DataFrame:
    """(id, n, stat, p, zero_five, verdict) of each series of at least 8 values: whether last digits are spread evenly.

    series has id and value; digits come from the value's text, so whole numbers end in 0.
    """
    d = series.where("value is not null").select("id", F.right(F.regexp_replace(float_text(F.col("value")), r"\D", ""), F.lit(1)).cast("int").alias("d"))
    g = d.groupBy("id").agg(F.count("*").alias("n"), *[F.sum((F.col("d") == k).cast("int")).alias(f"d{k}") for k in range(10)]).where("n >= 8")
    e = F.col("n") / 10.0
    stat = sum(((F.col(f"d{k}") - e) * (F.col(f"d{k}") - e) / e for k in range(1, 10)), (F.col("d0") - e) * (F.col("d0") - e) / e)
    g = g.select("id", "n", F.round(stat, 4).alias("stat"), F.round((F.col("d0") + F.col("d5")) / F.col("n"), 3).alias("zero_five"))
    if not p_values:
        return g
    g = g.withColumn("p", F.round(_sf9(F.col("stat")), 6))
    return g.withColumn("verdict", F.when(F.col("p") < 0.001, "red").when(F.col("zero_five") > 0.5, "amber").otherwise("ok"))


def benford(series: DataFrame) -> DataFrame:
    """(id, n, stat, p, verdict) of each series with at least 30 values other than 0: first digits against Benford's law."""
    d = series.where("value is not null and value <> 0").select("id", F.substring(F.format_string("%.9e", F.abs("value")), 1, 1).cast("int").alias("d"))
    g = d.groupBy("id").agg(F.count("*").alias("n"), *[F.sum((F.col("d") == k).cast("int")).alias(f"d{k}") for k in range(1, 10)]).where("n >= 30")
    stat = F.lit(0.0)
    for k in range(1, 10):
        e = F.col("n") * math.log10(1 + 1 / k)
        stat = stat + (F.col(f"d{k}") - e) * (F.col(f"d{k}") - e) / e
    g = g.withColumn("stat", stat).withColumn("p", F.round(chi2_sf_even(F.col("stat"), 4), 6))
    return g.select("id", "n", F.round("stat", 4).alias("stat"), "p", F.when(F.col("p") < 0.01, "red").when(F.col("p") < 0.05, "amber").otherwise("ok").alias("verdict"))


def step_variance(series: DataFrame) -> DataFrame:
    """(id, n, step_var_rel, r2, verdict) of each series of at least 3 values in order of pos: whether its steps are constant.

    r2 is null for a constant series.
    """
    s = series.where("value is not null").withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy("id").orderBy("pos")))
    g = s.groupBy("id").agg(F.count("*").alias("n"), F.avg("step").alias("m"), F.var_pop("step").alias("v"), F.regr_r2("value", "pos").alias("r2"), F.var_pop("value").alias("spread")).where("n >= 3")
    rel = F.col("v") / (F.col("m") * F.col("m") + 1e-12)
    r2 = F.when(F.col("spread") > 0, F.round("r2", 6))
    g = g.select("id", "n", rel.alias("rel"), r2.alias("r2"))
    return g.select("id", "n", F.round("rel", 6).alias("step_var_rel"), "r2", F.when(F.col("rel") < 1e-6, "red").when((F.col("r2") >= 0.9999) & (F.col("n") <= 5), "amber").otherwise("ok").alias("verdict"))


def constant_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, n, mean_diff, var_rel, verdict) of pairs of series of equal length, at least 3: whether they differ by a constant."""
    size = lambda d, c: d.groupBy("id").agg(F.count("*").alias(c))
    same = size(a, "n").join(size(b, "m"), "id").where("n = m and n >= 3").select("id")
    d = a.join(same, "id", "left_semi").select("id", "pos", "value").join(b.select("id", "pos", F.col("value").alias("other")), ["id", "pos"])
    g = d.groupBy("id").agg(F.count("*").alias("n"), F.avg(F.col("value") - F.col("other")).alias("m"), F.var_pop(F.col("value") - F.col("other")).alias("v")).withColumn("rel", F.col("v") / (F.col("m") * F.col("m") + 1e-12))
    return g.select("id", "n", F.round(F.round("m", 9), 4).alias("mean_diff"), F.round("rel", 6).alias("var_rel"), F.when(F.col("rel") < 1e-6, "red").when(F.col("rel") < 1e-3, "amber").otherwise("ok").alias("verdict"))


def constant_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, n, mean_ratio, var_rel, verdict) of pairs of series of equal length, at least 3: whether one is a constant multiple of the other.

    Places where the second is 0 or either is null tell nothing and are left out.
    """
    r = a.select("id", "pos", "value").join(b.select("id", "pos", F.col("value").alias("other")), ["id", "pos"]).where("value is not null and other is not null and other <> 0")
    g = r.groupBy("id").agg(F.count("*").alias("n"), F.avg(F.col("value") / F.col("other")).alias("m"), F.var_pop(F.col("value") / F.col("other")).alias("v")).where("n >= 3")
    g = g.withColumn("rel", F.col("v") / (F.col("m") * F.col("m") + 1e-12))
    return g.select("id", "n", F.round(F.round("m", 9), 4).alias("mean_ratio"), F.round("rel", 6).alias("var_rel"), F.when(F.col("rel") < 1e-6, "red").when(F.col("rel") < 1e-3, "amber").otherwise("ok").alias("verdict"))


def _ppf(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro(x: list[float]) -> tuple[float, float] | None:
    """W and p of Shapiro and Wilk's test, by Royston (1995); None below 5 or above 5,000 values or without spread."""
    n = len(x)
    if not 5 <= n <= 5000 or max(x) == min(x):
        return None
    x = sorted(x)
    m = [_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    poly = lambda c: sum(k * u**i for i, k in enumerate(c))
    a = [0.0] * n
    a[-1] = m[-1] / math.sqrt(mm) + poly([0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056])
    a[-2] = m[-2] / math.sqrt(mm) + poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]) if n > 5 else 0.0
    k = 2 if n > 5 else 1
    phi = (mm - 2 * sum(m[-i] ** 2 for i in range(1, k + 1))) / (1 - 2 * sum(a[-i] ** 2 for i in range(1, k + 1)))
    for i in range(k, n - k):
        a[i] = m[i] / math.sqrt(phi)
    for i in range(k):
        a[i] = -a[n - 1 - i]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    ln = math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if g - math.log(max(1 - w, 1e-300)) <= 0:
            return w, 0.0
        y = -math.log(g - math.log(max(1 - w, 1e-300)))
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        y = math.log(max(1 - w, 1e-300))
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sd = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def normality(series: DataFrame, most: int = 5000) -> DataFrame:
    """(id, n, stat, p, verdict) of each series of 5 to 5,000 values. Longer ones are left out by the test's own bound, before they are gathered."""
    fits = series.where("value is not null").groupBy("id").agg(F.count("*").alias("n")).where(f"n between 5 and {most}").select("id")
    lists = series.where("value is not null").join(fits, "id", "left_semi").groupBy("id").agg(F.collect_list("value").alias("x"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, x in zip(b["id"], b["x"]):
                got = shapiro(list(map(float, x)))
                if got:
                    out.append((i, len(x), round(got[0], 4), round(got[1], 6), "amber" if got[1] < 0.05 else "ok"))
            yield pd.DataFrame(out, columns=["id", "n", "stat", "p", "verdict"])

    return lists.mapInPandas(work, f"id {dict(series.dtypes)['id']}, n int, stat double, p double, verdict string")


_BLOCK = r'(\{[^{}]*"filename"[^{}]*"values"[^{}]*\})'


def blocks(texts: DataFrame, text: str = "text") -> DataFrame:
    """(id, block, filename, compound, unit, checks, values): data blocks in text, numbered from 0 within each.

    Blocks are objects without inner braces that have filename before values;
    bad ones are left out. Only numbers and truth values (as 1 and 0) of the
    values count; what else stands among them is passed over.
    """
    schema = "filename string, compound string, values array<variant>, unit string, checks array<string>"
    kinds = F.transform("x.values", lambda v: F.struct(F.schema_of_variant(v).alias("kind"), v.alias("v")))
    number = lambda e: F.when(e["kind"] == "BOOLEAN", F.try_variant_get(e["v"], "$", "boolean").cast("int").cast("double")).when(~e["kind"].isin("STRING", "VOID") & ~e["kind"].rlike("^(ARRAY|OBJECT)"), F.try_variant_get(e["v"], "$", "double"))
    got = texts.select("id", F.posexplode(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1))).alias("block", "raw")).withColumn("x", F.from_json("raw", schema))
    got = got.where("x.values is not null")
    return got.select("id", "block", "x.filename", "x.compound", "x.unit", "x.checks", F.filter(F.transform(kinds, number), lambda v: v.isNotNull()).alias("values"))


def results(series: DataFrame, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """(id, method, n, stat, p, zero_five, step_var_rel, r2, verdict) of the named checks that apply; unknown names are skipped."""
    made = {"lastdigit": last_digits, "benford": benford, "runlength": step_variance, "shapiro": normality}
    fields = ("stat", "p", "zero_five", "step_var_rel", "r2")
    parts = []
    for c in checks:
        if c in made:
            d = made[c](series)
            parts.append(d.select("id", F.lit(c).alias("method"), F.col("n").cast("bigint").alias("n"), *[(F.col(f) if f in d.columns else F.lit(None)).cast("double").alias(f) for f in fields], "verdict"))
    return reduce(DataFrame.unionAll, parts)


def run_checks(series: DataFrame, checks: tuple[str, ...] = CHECKS) -> DataFrame:
    """(id, method, n, verdict) of the named checks that apply."""
    return results(series, checks).select("id", "method", "n", "verdict")


def block_results(found: DataFrame) -> DataFrame:
    """results of the blocks of texts, id being a struct (id, block): those that a block names, or all where it names none."""
    key = F.struct("id", "block")
    series = found.select(key.alias("id"), F.posexplode("values").alias("pos", "value"))
    asked = found.select(key.alias("id"), "checks")
    return results(series).join(asked, "id").where(F.coalesce(F.size("checks"), F.lit(0)).isin(-1, 0) | F.array_contains("checks", F.col("method"))).drop("checks")


def audit(texts: DataFrame, text: str = "text") -> DataFrame:
    """(id, report): the checks of all data blocks of each text as Markdown; texts without blocks have none.

    A block has a line with its file, compound, unit and number of values, and a
    line for each check in the order of CHECKS, or one that says that none applies.
    """
    found = blocks(texts, text)
    number = lambda c: float_text(F.col(c))
    line = F.concat(
        F.lit("  - "), "method", F.lit(": "),
        F.when(F.col("method") == "lastdigit", F.concat(F.lit("p="), number("p"), F.lit(", 0/5 "), number("zero_five")))
        .when(F.col("method") == "benford", F.concat(F.lit("p="), number("p")))
        .when(F.col("method") == "runlength", F.concat(F.lit("rel="), number("step_var_rel"), F.coalesce(F.concat(F.lit(", r2="), number("r2")), F.lit(""))))
        .otherwise(F.concat(F.lit("W="), number("stat"), F.lit(", p="), number("p"))), F.lit(" -> "), "verdict")
    place = F.array_position(F.array(*map(F.lit, CHECKS)), F.col("method"))
    lines = block_results(found).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), line.alias("line")))).alias("lines"))
    name = lambda c: F.coalesce(F.col(c), F.lit("?"))
    head = F.concat(F.lit("- **"), name("filename"), F.lit("** "), name("compound"), F.coalesce(F.concat(F.lit(" ("), F.nullif("unit", F.lit("")), F.lit(")")), F.lit("")), F.lit(", n="), F.size("values").cast("string"))
    heads = found.select(F.struct("id", "block").alias("id"), head.alias("head"))
    body = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("  - too few values, not checked"))
    one = heads.join(lines, "id", "left").select("id.id", F.struct("id.block", F.concat("head", F.lit("\n"), body).alias("part")).alias("x"))
    return one.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "\n").alias("report"))


def grade(tier_: Column, red: Column, amber: Column, standard: Column, evidence: Column | None = None) -> Column:
    """Reliability from the tier (A green, B amber, C red), moved down by flags; standards stay green, C is never green, no numeric evidence is red."""
    out = F.when(standard, "green").when((tier_ == "C") | (red > 0), "red")
    if evidence is not None:
        out = out.when(~F.coalesce(evidence, F.lit(False)), "red")
    return out.when((tier_ == "B") | (amber > 0), "amber").otherwise("green")
