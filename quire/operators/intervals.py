"""Half-open [start, end) intervals within a group: containment, overlap, as-of, composition, elementary pieces.

Every join has the group as equi key, so no plan falls into a nested loop over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Pairs where inner's [start, end) lies within outer's [begin, stop). Null bounds match nothing."""
    return inner.join(outer, key).where("begin <= start AND end <= stop")


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs that share at least one position. Empty intervals overlap nothing."""
    return a.join(b, key).where("start < stop AND begin < end AND start < end AND begin < stop")


def as_of(points: DataFrame, runs: DataFrame, key: str, at: str, begin: str, carry: list[str]) -> DataFrame:
    """Each point with `carry` of the last run of its group that begins at or before it; null before the first run.

    A union and one running last_value: both sides are sorted once by group, whatever their sizes. Runs of one group that
    begin at one place are resolved by the greatest carry values.
    """
    runs = runs.groupBy(key, begin).agg(F.max(F.struct(*carry)).alias("carried"))
    marks = runs.select(key, F.col(begin).alias("at"), F.lit(0).alias("is_point"), "carried", F.lit(None).alias("point"))
    kept = F.struct(*(F.col(c) for c in points.columns))
    asked = points.select(key, F.col(at).alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast(runs.schema["carried"].dataType).alias("carried"), kept.alias("point"))
    marks = marks.withColumn("point", F.lit(None).cast(asked.schema["point"].dataType))
    order = Window.partitionBy(key).orderBy("at", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    all_ = marks.unionByName(asked).withColumn("carried", F.last("carried", ignorenulls=True).over(order))
    return all_.where("is_point = 1").select("point.*", *(F.col("carried")[c].alias(c) for c in carry))


def compose(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Maps a -> b and b -> c, both piecewise shifts, as one map a -> c.

    first: key, a_from, a_to, b_from. second: key, b_begin, b_stop, c_from. Pieces are cut where both hold.
    """
    j = first.join(second, key).where("b_from < b_stop AND b_begin < b_from + (a_to - a_from)")
    low, high = F.greatest("b_from", "b_begin"), F.least(F.col("b_from") + F.col("a_to") - F.col("a_from"), F.col("b_stop"))
    return j.select(key, (F.col("a_from") + low - F.col("b_from")).alias("a_from"), (F.col("a_from") + high - F.col("b_from")).alias("a_to"), (F.col("c_from") + low - F.col("b_begin")).alias("c_from"))


def elementary(spans: DataFrame, key: str, rank: Column) -> DataFrame:
    """Pieces between neighbouring bounds of a group's spans, each with the highest rank that covers it and how many do.

    spans: key, start, end. Pieces that nothing covers and empty spans are left out.
    """
    spans = spans.where("start < end").withColumn("rank", rank)
    bounds = spans.select(key, F.explode(F.array("start", "end")).alias("start")).distinct()
    pieces = bounds.withColumn("end", F.lead("start").over(Window.partitionBy(key).orderBy("start"))).where("end IS NOT NULL")
    covers = spans.select(key, F.col("start").alias("begin"), F.col("end").alias("stop"), "rank")
    return pieces.join(covers, key).where("begin <= start AND end <= stop").groupBy(key, "start", "end").agg(F.max("rank").alias("top_rank"), F.count("*").alias("n_spans"))


def merged(spans: DataFrame, key: str) -> DataFrame:
    """Unions of overlapping or touching spans of a group."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("start < end").withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
