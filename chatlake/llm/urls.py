"""URL filter: rules first, then the likelihood ratio of two character models.

A rule is a host and a path prefix, such as ``example.com/en/``; it fits the host
and all its subdomains, the longest fitting rule decides.  The URLs that
rules accept and reject train two smoothed variable-order Markov models of
host and path: the probability of a character interpolates contexts of 0 to
``ORDER`` characters, each weighted by how many different characters have
followed it (Witten-Bell), so a context counts for more the more is known of it.
A URL without a rule is allowed if its log-likelihood difference, divided by
its length, reaches a threshold.  The threshold is calibrated on labelled
URLs that the models have not seen (``FOLDS``): the one with the best difference of
accepted URLs and rejected URLs above it, the one nearest 0 among equals.

Counts cover all labelled URLs and grow with them.  They are kept for distinct
windows of ``ORDER`` + 1 characters; a window's likelihood ratio is computed
once and joined to the URLs' windows.  All tables of such joins are written
first, so that adaptive execution can split frequent windows.

Nulls and edge cases: a null URL or one without ``://`` has empty host and path,
fits no rule and is judged as the empty string; equal URLs are scored
once; without accepted or without rejected URLs to learn from, scores and the threshold are
0 and URLs without a rule are allowed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii

#: (verdict, rule); fixed by the query's contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
ORDER = 4
FOLDS = 5
#: Of the calibration histogram: thresholds are multiples of 1 / STEPS, from -LIMIT to LIMIT.
STEPS, LIMIT = 100, 10
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def windows(strings: DataFrame, order: int = ORDER) -> DataFrame:
    """The columns of ``strings`` and ``w`` for every character of ``s`` and its end: the
    character after its ``order`` predecessors."""
    padded = F.concat(F.lit(START * order), F.col("s"), F.lit(END))
    return strings.withColumn("w", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substring(padded, i, order + 1))))


def _levels(df: DataFrame, order: int) -> DataFrame:
    """A row for each context length (``k``) of each window: ``gram`` and its context ``ctx``."""
    at = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(order))))
    gram = F.substring("w", F.lit(order + 1) - F.col("k"), F.col("k") + 1)
    return at.withColumn("gram", gram).withColumn("ctx", F.substring("gram", F.lit(1), F.col("k")))


def count_tables(labelled: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From ``s``, ``n`` (URLs) and ``accepted``: counts of grams (``a``, ``r``) and, for each context, the
    characters that followed (``na``, ``nr``) and how many different ones (``ta``, ``tr``)."""
    seen = windows(labelled, order).groupBy("w").agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r"))
    grams = cut(_levels(seen, order).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    ctx = F.substring("gram", F.lit(1), F.length("gram") - 1)
    contexts = cut(grams.groupBy(ctx.alias("ctx")).agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")))
    return grams, contexts


def ratios(distinct_windows: DataFrame, grams: DataFrame, contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """``w`` and ``ratio``: the log of the accepted model's probability over the rejected one's."""
    g = grams.select(F.col("gram").alias("_g"), "a", "r")
    c = contexts.select(F.col("ctx").alias("_c"), "na", "nr", "ta", "tr")
    known = (_levels(distinct_windows, order).join(g, F.col("gram") == F.col("_g"), "left")
             .join(c, F.col("ctx") == F.col("_c"), "left").na.fill(0, ["a", "r", "na", "nr", "ta", "tr"]))
    steps = known.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("k", "a", "r", "na", "nr", "ta", "tr"))).alias("_s"))

    def p(n: str, c: str, t: str) -> Column:
        return F.aggregate("_s", F.lit(1.0 / 256), lambda p, x: F.when(
            x[n] > 0, (x[c] + x[t] * p) / (x[n] + x[t])).otherwise(p))

    return steps.select("w", (F.log(p("na", "a", "ta")) - F.log(p("nr", "r", "tr"))).alias("ratio"))


def scores(strings: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """``key`` and ``score``: the mean of its windows' ratios.  The key, a digest, stands for ``s``:
    a row for each character must not hold the whole string."""
    w = table.select(F.col("w").alias("_w"), "ratio")
    return (windows(strings.select("key", "s"), order).select("key", "w").join(w, F.col("w") == F.col("_w"))
            .groupBy("key").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score")))


def threshold(calibration: DataFrame) -> Column:
    """From ``score``, ``n`` and ``accepted``: one number, as a scalar subquery."""
    bin_ = F.floor(F.greatest(F.least(F.col("score"), F.lit(float(LIMIT))), F.lit(float(-LIMIT))) * STEPS)
    hist = calibration.groupBy(bin_.alias("b")).agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("r"))
    above = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)     # at most 2 * LIMIT * STEPS + 1 rows
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = lambda c: F.sum(c).over(above) / F.greatest(F.sum(c).over(every), F.lit(1))
    gain = hist.select("b", (rate("a") - rate("r")).alias("g"))
    return gain.agg(F.coalesce(F.max_by("b", F.struct(F.round("g", 9), -F.abs(F.col("b")))), F.lit(0)) / STEPS).scalar()


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER,
          folds: int = FOLDS) -> DataFrame:
    """One row for each page: the id, ``host``, ``path``, ``rule``, ``score`` (null where a rule
    decides) and ``verdict``."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    split = pages.select(F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    ruled = cut(split.select("*", rule.alias("rule"), verdict.alias("_verdict"), F.lower(F.concat("host", "path")).alias("s"))
                .withColumn("key", F.md5("s")))
    fold = F.pmod(F.conv(F.substring("key", 1, 6), 16, 10).cast("long"), F.lit(folds))
    # a string stands once for each verdict: case variants of one string may have different rules, or none
    strings = cut(ruled.groupBy("key", "s", "_verdict").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("accepted", F.col("_verdict") == "allow").withColumn("fold", fold))
    labelled = strings.where("accepted IS NOT NULL")
    to_score = strings.where("accepted IS NULL OR fold = 0").select("key", "s").distinct()
    grams, contexts = count_tables(labelled.where("fold != 0"), order)
    table = cut(ratios(windows(to_score, order).select("w").distinct(), grams, contexts, order))
    scored = cut(scores(to_score, table, order)).select(F.col("key").alias("_k"), "score")
    best = threshold(scored.join(labelled.where("fold = 0"), F.col("_k") == F.col("key")))
    both = contexts.where("ctx = ''").agg(F.coalesce(F.max((F.col("na") > 0) & (F.col("nr") > 0)), F.lit(False))).scalar()
    out = ruled.join(scored, F.col("rule").isNull() & (F.col("key") == F.col("_k")), "left")
    score = F.when(both, F.col("score")).when(F.col("rule").isNull(), F.lit(0.0))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", score.alias("score"),
                      F.coalesce("_verdict", F.when(~both | (score >= best), "allow").otherwise("block")).alias("verdict"))
