"""Quality aggregates: accuracy, pass rates, statistics, histograms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import percent


def accuracy(rows: DataFrame, group: str, verdict: str) -> DataFrame:
    """Share of verdicts that are 1, as text; a missing verdict counts as wrong."""
    return rows.groupBy(group).agg(percent(100.0 * F.sum(F.coalesce(F.col(verdict), F.lit(0))) / F.count("*")).alias("accuracy"))


def pass_rate(rows: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """Percent of scores that are 1.0; 0.0 for a group without scores. groups: all groups, where some may have no rows."""
    scored = rows.where("score is not null").groupBy(group).agg((100.0 * F.count_if(F.col("score") == 1.0) / F.count("*")).alias("pass_rate"))
    every = (rows if groups is None else groups).select(group).distinct()
    return every.join(scored, group, "left").select(group, F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"))


def results_json(results: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """group, results: the group's rows in order as a JSON list whose last record is the accuracy (verdicts in evaluation).

    A row with an error says so; other rows have no such field.
    """
    own = results.select(group, F.struct(order, F.to_json(F.struct(*fields)).alias("json")).alias("x"), "evaluation")
    out = own.groupBy(group).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["json"]).alias("rows"), percent(100.0 * F.sum(F.coalesce("evaluation", F.lit(0))) / F.count("*")).alias("accuracy"))
    last = F.to_json(F.struct("accuracy"))
    return out.select(group, F.concat(F.lit("["), F.array_join(F.concat("rows", F.array(last)), ","), F.lit("]")).alias("results"))


def statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(group).agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 4).alias("median"), F.round(F.var_samp(v), 4).alias("variance"), F.round(F.stddev_samp(v), 4).alias("deviation"))


def described(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, count, mean, std, min, the quartiles and max; quartiles lie between values by linear interpolation."""
    v = F.col(value)
    quartiles = [F.percentile(v, F.lit(q)).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return rows.groupBy(group).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *quartiles, F.max(v).alias("max"))


def category_counts(rows: DataFrame, column: str) -> DataFrame:
    """category, n, the largest first: blanks around a category don't count, blank ones are left out."""
    return rows.select(F.trim(column).alias("category")).where("category <> ''").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def counts_of(**tables: DataFrame) -> DataFrame:
    """input, n: the rows of each table, for a comparison before and after a step."""
    each = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("input"), "n") for name, t in tables.items()]
    out = each[0]
    for t in each[1:]:
        out = out.unionByName(t)
    return out


def outcomes(rows: DataFrame, error: str = "error") -> DataFrame:
    """success, fail: rows of a provider's stage without and with an error."""
    return rows.agg(F.count_if(F.col(error).isNull()).alias("success"), F.count_if(F.col(error).isNotNull()).alias("fail"))


def relation_totals(sizes: DataFrame) -> DataFrame:
    """file_name, entities, total: relations and, where they are counted, attributes."""
    attributes = F.coalesce("attributes", F.lit(0)) if "attributes" in sizes.columns else F.lit(0)
    return sizes.select("file_name", "entities", (F.col("relations") + attributes).alias("total"))


def histogram(rows: DataFrame, value: str, bins: list[float]) -> DataFrame:
    """Rows at each bin's exact value, 0 where there are none."""
    counts = rows.groupBy(F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    own = rows.sparkSession.createDataFrame([(float(b),) for b in bins], "bin double")
    return own.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def unpivot_mean(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    long = rows.unpivot(ids, metrics, "metric", "score").where("score > 0")
    return long.groupBy("metric").agg(F.round(F.avg("score"), 6).alias("mean"))


def density(rows: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """Gaussian kernel density of each group's values at the points; the bandwidth is deviation * n ** -0.2."""
    v = F.col(value)
    size = rows.groupBy(group).agg(F.count(value).alias("n"), (F.stddev_samp(v) * F.count(value) ** -0.2).alias("h"))
    at = rows.join(size, group).withColumn("x", F.explode(F.array(*map(F.lit, points))))
    total = F.sum(F.exp(-0.5 * ((F.col("x") - v) / F.col("h")) ** 2)) / (F.first("n") * F.first("h") * F.sqrt(2 * F.pi()))
    return at.groupBy(group, "x").agg(F.round(total, 8).alias("density"))


def scaled_density(densities: DataFrame, group: str, counts: DataFrame) -> DataFrame:
    """The densities of each group with its highest at the largest n of counts, as for drawing both together."""
    top = densities.groupBy(group).agg(F.max("density").alias("_top"))
    most = counts.agg(F.max("n").alias("_most"))
    both = densities.join(top, group).join(F.broadcast(most), F.lit(True))
    return both.withColumn("scaled", F.round(F.col("density") / F.col("_top") * F.col("_most"), 6)).drop("_top", "_most")


def coverage(expected: DataFrame, found: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """Share of expected keys that were found, and the mean score of those, both rounded to 4 places; found has one row a key."""
    both = expected.select(group, key).join(found.select(key, score, F.lit(1).alias("_hit")), key, "left")
    return both.groupBy(group).agg(F.round(F.count("_hit") / F.count("*"), 4).alias("coverage"), F.round(F.avg(score), 4).alias("similarity"))


def _common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit for each word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for w in b:
        hit = free & places.get(w, 0)
        free = (free + hit | free & ~hit) & full
    return len(a) - free.bit_count()


_TOKEN = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]|[^\W\u3400-\u9fff\uf900-\ufaff]+|[^\w\s]")


def tokens(text: str) -> list[str]:
    """Words, single ideographs and single signs of a text: a tokenizer for text without spaces."""
    return _TOKEN.findall(text)


def rouge_scores(candidate: str | None, reference: str | None, tokenize: Callable[[str], list[str]] = str.split) -> tuple[float, float, float]:
    """F scores of common words, common pairs of neighbours and the longest common subsequence; 0 where a side has none."""
    a, b = tokenize(candidate or ""), tokenize(reference or "")
    score = lambda hit, n, m: 2.0 * hit / (n + m) if hit else 0.0
    grams = [[Counter(zip(*[x[i:] for i in range(k)])) for x in (a, b)] for k in (1, 2)]
    one, two = (score((x & y).total(), x.total(), y.total()) for x, y in grams)
    return one, two, score(_common_length(a, b), len(a), len(b))


def rouge(candidate: str, reference: str, tokenize: Callable[[str], list[str]] = str.split) -> Column:
    """Struct rouge1, rouge2, rougel of two text columns cut by tokenize, such as tokens()."""

    @F.pandas_udf("rouge1 double, rouge2 double, rougel double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rouge_scores(x, y, tokenize) for x, y in zip(a, b)], columns=["rouge1", "rouge2", "rougel"], dtype=float)

    return run(candidate, reference)
