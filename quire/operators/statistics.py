"""Grouped statistics: shares and densities, quartiles with guards, bands, long metrics, confusion, estimates, samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_and_density(df: DataFrame, group: list[str], part: str, words: Column, cites: Column) -> DataFrame:
    """Words and citations of each part of a group, its share of the group's citations and citations per 1000 words.

    Zero denominators give 0.
    """
    sums = df.groupBy(*group, part).agg(F.sum(words).alias("n_words"), F.sum(cites).alias("n_cites"))
    total = F.sum("n_cites").over(Window.partitionBy(*group))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return sums.select(*group, part, "n_words", "n_cites", ratio(F.col("n_cites"), total).alias("share"), ratio(F.col("n_cites") * 1000.0, F.col("n_words")).alias("density"))


def quartiles(df: DataFrame, group: list[str], value: str, least: int = 3) -> DataFrame:
    """n, q1, median, q3 of the non-null values; no row for groups of fewer than `least` values or without spread."""
    got = exact_quantiles(df, group, value, [0.25, 0.5, 0.75])
    got = got.select(*group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    return got.where((F.col("n") >= least) & (F.col("q3") > F.col("q1")))


def band(value: Column, q1: Column, q3: Column) -> Column:
    """below, within or above the band; na where either is missing."""
    return F.when(value.isNull() | q1.isNull(), "na").when(value < q1, "below").when(value > q3, "above").otherwise("within")


def rate_flag(rate: Column, own: Column, high: float = 0.75, low: float = 0.25) -> Column:
    """Whether having or lacking something stands out where most, or few, have it."""
    return F.when((rate >= high) & ~own, "missing").when((rate <= low) & own, "unusual").otherwise("within")


def exact_quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], accuracy: int = 2_000) -> DataFrame:
    """group, n, q: the exact quantiles, interpolated, of non-null values; no group's values meet in one buffer.

    Sketches give a bracket around each quantile's rank; what lies below it is only counted, and the few values inside,
    folded by value, are walked in order. A group of n values brings about n / accuracy of them to a window.
    """
    if not group:
        return exact_quantiles(df.select(F.lit(0).alias("__all"), value), ["__all"], value, shares, accuracy).drop("__all")
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    away = 2.0 / accuracy
    ends = [x for q in shares for x in (max(0.0, q - away), min(1.0, q + away))]
    sketch = rows.groupBy(*group).agg(F.count("*").alias("n"), F.percentile_approx("__v", ends, accuracy).alias("__ends"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    # a small group is its own bracket
    small = F.col("n") <= accuracy
    brackets = sketch.select(*group, "n", F.posexplode(F.array(*(F.struct(F.lit(q).alias("share"), F.when(small, F.col("__min")).otherwise(F.col("__ends")[2 * i]).alias("lo"), F.when(small, F.col("__max")).otherwise(F.col("__ends")[2 * i + 1]).alias("hi")) for i, q in enumerate(shares)))).alias("__k", "b")).select(*group, "n", "__k", "b.*")
    inside = rows.join(brackets, group).where("__v <= hi").groupBy(*group, "n", "__k", "share", F.when(F.col("__v") >= F.col("lo"), F.col("__v")).alias("__v")).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*group, "__k").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    at = inside.withColumn("upto", F.sum("m").over(w)).where("__v IS NOT NULL")
    h = (F.col("n") - 1) * F.col("share")
    one = at.withColumn("h", h).groupBy(*group, "n", "__k").agg(F.max("h").alias("h"), F.min(F.when(F.col("upto") > F.floor("h"), F.col("__v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("h"), F.col("__v"))).alias("b"))
    got = one.select(*group, "n", "__k", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias("x"))
    return got.groupBy(*group, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "x"))), lambda s: s["x"]).alias("q"))


def baseline(metrics: DataFrame, groups: DataFrame, least: int = 3) -> DataFrame:
    """group, metric, present_in, q1, median, q3 over a group's manuscripts; nothing for fewer than `least` that have it.

    metrics: doc_id, metric, value; groups: doc_id, group.
    """
    rows = metrics.join(groups.where("group IS NOT NULL"), "doc_id").where("value IS NOT NULL")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    got = rows.groupBy("group", "metric").agg(F.count("*").alias("present_in"), q.alias("q")).where(F.col("present_in") >= least)
    return got.select("group", "metric", "present_in", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def absent_as_zero(df: DataFrame, unit: str, part: str, value: str, parts: list[str]) -> DataFrame:
    """Per part: share over all units, an absent part counting 0, and how many units have it.

    The parts are a bounded list, so each unit is expanded by it without a join of all with all.
    """
    have = df.where(F.col(part).isin(parts)).groupBy(unit, part).agg(F.sum(value).alias("v"))
    total = df.groupBy(unit).agg(F.sum(value).alias("t"))
    full = total.withColumn(part, F.explode(F.array(*map(F.lit, parts)))).join(have, [unit, part], "left")
    share = F.when(F.col("t") == 0, F.lit(0.0)).otherwise(F.coalesce("v", F.lit(0)) / F.col("t"))
    return full.groupBy(part).agg(F.avg(share).alias("mean_share"), F.percentile(share, F.lit(0.5)).alias("median_share"), F.count("v").alias("present_in"), F.count("*").alias("n_units"))


def long_metrics(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """keys, metric, value: one row per measure."""
    wide = df.select(*keys, *(e.cast("double").alias(name) for name, e in metrics.items()))
    return wide.unpivot(keys, list(metrics), "metric", "value")


def confusion(df: DataFrame, gold: Column, flagged: Column, before: Column | None = None) -> DataFrame:
    """Counts and precision, recall, accuracy in two conventions: alarms seen before counted as pre-existing, or as false.

    Units whose gold is null are excluded. Empty denominators give null.
    """
    known = before if before is not None else F.lit(False)
    n = df.where(gold.isNotNull()).agg(
        F.count_if(gold & flagged).alias("tp"), F.count_if(gold & ~flagged).alias("fn"), F.count_if(~gold & flagged & ~known).alias("fp"),
        F.count_if(~gold & flagged & known).alias("pre"), F.count_if(~gold & ~flagged).alias("tn"),
    )
    c = F.col
    return n.select("*", F.try_divide(c("tp"), c("tp") + c("fp")).alias("precision_lenient"), F.try_divide(c("tp"), c("tp") + c("fp") + c("pre")).alias("precision_strict"), F.try_divide(c("tp"), c("tp") + c("fn")).alias("recall"), F.try_divide(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn") + c("pre")).alias("accuracy"))


def class_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, F1 (0 where nothing is right)."""
    pairs = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(gold, predicted).agg(F.count("*").alias("n"))
    pairs = pairs.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    s = pairs.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("n_predicted"), F.sum("hit").alias("hits"))
    c = F.col
    return s.select("label", "support", F.coalesce(F.try_divide(c("hits"), c("n_predicted")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(c("hits"), c("support")), F.lit(0.0)).alias("recall"), (F.lit(2.0) * c("hits") / (c("support") + c("n_predicted"))).alias("f1"))


def allocate(strata: DataFrame, name: str, size: str, budget: int, floor: int) -> DataFrame:
    """name, size, quota: small strata are taken whole, the rest share what is left by size, at least `floor` each.

    A stratum whose share is below the floor gets the floor and leaves the others' total, again until none is left to fix;
    the rest is rounded by largest remainder, ties by name, and capped by size. Strata are few: one row each, one window.
    """

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, kind="stable").reset_index(drop=True)
        n = pdf[size].astype(int)
        quota = pd.Series(0, index=pdf.index)
        whole = n <= floor
        quota[whole] = n[whole]
        open_, left = list(pdf.index[~whole]), budget - int(n[whole].sum())
        while open_:
            total = int(n[open_].sum())
            low = [i for i in open_ if left * n[i] / total < floor]
            if not low:
                break
            for i in low:
                quota[i] = floor
                left -= floor
            open_ = [i for i in open_ if i not in low]
        if open_ and left > 0:
            total = int(n[open_].sum())
            exact = {i: left * n[i] / total for i in open_}
            for i in open_:
                quota[i] = int(exact[i])
            rest = left - sum(int(exact[i]) for i in open_)
            for i in sorted(open_, key=lambda i: (-(exact[i] - int(exact[i])), pdf[name][i]))[:rest]:
                quota[i] += 1
        return pdf.assign(quota=np.minimum(quota, n))[[name, size, "quota"]]

    kind = strata.schema[name].dataType.simpleString()
    return strata.select(name, F.col(size).cast("bigint").alias(size)).groupBy(F.lit("all").alias("all")).applyInPandas(share, f"{name} {kind}, {size} bigint, quota bigint")


def seeded_sample(df: DataFrame, stratum: str, key: str, quota: Column, seed: str) -> DataFrame:
    """The `quota` rows of each stratum of smallest md5(seed|key): the same in every engine and for every partitioning."""
    draw = F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__draw", key))
    return df.withColumn("__draw", draw).withColumn("__rank", rank).where(F.col("__rank") <= quota).drop("__draw", "__rank")


def stratified_estimate(df: DataFrame, stratum: str, size: str, hit: str) -> DataFrame:
    """Estimated hits in the population and their rate: each stratum's rate in the sample by its size."""
    per = df.groupBy(stratum).agg(F.max(size).alias("n_h"), F.avg(F.col(hit).cast("double")).alias("p_h"), F.count("*").alias("drawn"))
    return per.agg(F.sum(F.col("n_h") * F.col("p_h")).alias("estimate"), (F.sum(F.col("n_h") * F.col("p_h")) / F.sum("n_h")).alias("rate"), F.sum("drawn").alias("drawn"))


def bootstrap(df: DataFrame, stratum: str, size: str, hit: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """low, high: the 2.5 and 97.5 percentiles of the stratified estimate; strata drawn whole have no spread.

    A resample of 0/1 values is a binomial draw from the stratum's counts, so rows are aggregated first and only strata,
    not rows, meet the rounds.
    """
    per = df.where(F.col(hit).isNotNull()).groupBy(stratum).agg(F.max(size).cast("bigint").alias("n_h"), F.count("*").alias("n"), F.sum(F.col(hit).cast("bigint")).alias("k"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(stratum, kind="stable")
        rng = np.random.default_rng(seed)
        total = np.zeros(rounds)
        for n_h, n, k in pdf[["n_h", "n", "k"]].itertuples(index=False):
            p = np.full(rounds, k / n) if n >= n_h else rng.binomial(n, k / n, rounds) / n
            total += n_h * p
        low, high = np.percentile(total / pdf["n_h"].sum(), [2.5, 97.5])
        return pd.DataFrame({"low": [low], "high": [high]})

    return per.groupBy(F.lit("all").alias("all")).applyInPandas(draw, "low double, high double")
