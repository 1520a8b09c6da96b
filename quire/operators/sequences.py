"""Ordered sequences: gaps and islands, sessions, first appearance, running offsets, sliding windows, streaks."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, key: list[str], order: list[str], breaks: Column) -> DataFrame:
    """session: number of the run a row is in; `breaks` (may use lag over the same order) says where a new one begins."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.withColumn("__new", F.when(breaks, 1).otherwise(0))
    return marked.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def integer_runs(df: DataFrame, key: list[str], n: str) -> DataFrame:
    """Maximal runs of consecutive integers: key, low, high, size. Repeated integers count once; nulls are left out."""
    distinct = df.where(F.col(n).isNotNull()).select(*key, n).distinct()
    island = F.col(n) - F.row_number().over(Window.partitionBy(*key).orderBy(n))
    return distinct.withColumn("island", island).groupBy(*key, "island").agg(F.min(n).alias("low"), F.max(n).alias("high"), F.count("*").alias("size")).drop("island")


def first_appearance(df: DataFrame, key: list[str], item: str, order: list[str]) -> DataFrame:
    """Items of a group in order of first appearance: key, item, rank from 1. Ties in order go by item."""
    first = df.where(F.col(item).isNotNull()).groupBy(*key, item).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(*key, item, F.row_number().over(Window.partitionBy(*key).orderBy("first", item)).cast("bigint").alias("rank"))


def _blocks(df: DataFrame, key: list[str], place: str, size: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.coalesce(F.col(place), F.lit(-1)) / size))


def running_offset(df: DataFrame, key: list[str], order: list[str], size: Column, block: int = 512) -> DataFrame:
    """offset: the sum of the sizes before a row. The first column of order is an integer place; ties go by the others.

    Sums run in two levels, over blocks of places and inside a block, so a group of any size is shared by many tasks: only
    one row a block meets in one window.
    """
    rows = _blocks(df.withColumn("__size", size), key, order[0], block)
    sums = rows.groupBy(*key, "__block").agg(F.sum("__size").alias("__total"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__total").over(Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    w = Window.partitionBy(*key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(before, [*key, "__block"]).withColumn("offset", F.col("__before") + F.coalesce(F.sum("__size").over(w), F.lit(0)))
    return out.drop("__size", "__block", "__before")


def numbered(df: DataFrame, key: str, place: str, order: list, block: int = 512) -> DataFrame:
    """number: 1, 2, ... of a group's rows in order, whose first column is the integer place (null first); in two levels like running_offset."""
    rows = _blocks(df, [key], place, block)
    sums = rows.groupBy(key, "__block").agg(F.count("*").alias("__total"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__total").over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    w = Window.partitionBy(key, "__block").orderBy(*order)
    return rows.join(before, [key, "__block"]).withColumn("number", F.col("__before") + F.row_number().over(w)).drop("__block", "__before")


def last_heading(df: DataFrame, key: list[str], order: list[str], heading: Column, block: int = 512) -> DataFrame:
    """heading: the last non-null heading at or before a row; in two levels like running_offset."""
    rows = _blocks(df.withColumn("__own", heading), key, order[0], block)
    last = rows.where("__own IS NOT NULL").groupBy(*key, "__block").agg(F.max(F.struct(*order, "__own")).alias("__l"))
    every = rows.select(*key, "__block").distinct().join(last, [*key, "__block"], "left")
    before = every.withColumn("__before", F.last("__l.__own", ignorenulls=True).over(Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).drop("__l")
    w = Window.partitionBy(*key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, [*key, "__block"]).withColumn("heading", F.coalesce(F.last("__own", ignorenulls=True).over(w), F.col("__before")))
    return out.drop("__own", "__block", "__before")


def sliding(df: DataFrame, key: list[str], order: list[str], text: str, size: int = 3, sep: str = " ") -> DataFrame:
    """window: the texts of a row and the size - 1 that follow; windows at the end are shorter."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(0, size - 1)
    return df.withColumn("window", F.concat_ws(sep, F.collect_list(text).over(w)))


def streaks(days: DataFrame, key: list[str], day: str) -> DataFrame:
    """Runs of consecutive days: key, first_day, last_day, length."""
    d = days.where(F.col(day).isNotNull()).select(*key, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*key).orderBy(day)))
    return d.withColumn("island", island).groupBy(*key, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).drop("island")


def day_grid(counts: DataFrame, key: str, day: str, n: str) -> DataFrame:
    """Every day between the first and last of all, for each key, with 0 where nothing was."""
    span = counts.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL")
    grid = counts.select(key).distinct().join(F.broadcast(span)).select(key, F.explode(F.sequence("a", "b")).alias(day))  # span is one row
    return grid.join(counts, [key, day], "left").select(key, day, F.coalesce(n, F.lit(0)).alias(n))


def keep_longest(positions: list[int]) -> list[bool]:
    """Which elements are in one longest increasing subsequence (the one of smallest tails)."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(positions)
    for i, p in enumerate(positions):
        k = bisect.bisect_left(tails, p)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[k], ends[k] = p, i
    keep = [False] * len(positions)
    at = ends[-1] if ends else -1
    while at >= 0:
        keep[at] = True
        at = before[at]
    return keep


def moves(df: DataFrame, key: str, item: str, old: str, new: str) -> DataFrame:
    """The least set of items to move so that the old order becomes the new one: key, item, move_after (null: to the front).

    df: one row per item with its old and new position, both without ties inside a group. The order within a group is
    one sequence, so a group is one task; groups are manuscripts' lists.
    """

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([new, item], kind="stable")
        keep = keep_longest(pdf[old].tolist())
        out = pdf.assign(move_after=pdf[item].shift(1))
        return out.loc[[not k for k in keep], [key, item, "move_after"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(key, item, old, new).groupBy(key).applyInPandas(plan, f"{key} {kinds[key]}, {item} {kinds[item]}, move_after {kinds[item]}")


def feasible(df: DataFrame, key: str, low: str, high: str, order: str) -> DataFrame:
    """Whether a list's order fits its items' windows: no earlier item must come after a later one's end."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    checked = df.withColumn("ok", F.max(low).over(w) <= F.col(high))
    return checked.groupBy(key).agg(F.min("ok").alias("feasible"), F.count("*").alias("n_items"))


def heading_sequence(df: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """accepted: whether a heading number continues its group's sequence (the same number or the next one after the last accepted).

    order must have no ties inside a group.

    The state is one integer carried along the group's rows.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        last, out = 0, []
        for n in pdf[number]:
            ok = pd.notna(n) and n in (last, last + 1) and n > 0
            last = int(n) if ok else last
            out.append(bool(ok))
        return pdf.assign(accepted=out)[[key, order, number, "accepted"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(key, order, number).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, {number} {kinds[number]}, accepted boolean")


def counters(df: DataFrame, key: list[str], order: str, level: str) -> DataFrame:
    """label: hierarchical number like 2.1.3 of each row: its level counts on, deeper levels begin again.

    Rows are numbered once; a level's count is its running number less that number at the last row of a higher level, so
    all nine levels share one window and one sort.
    """
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    levels = range(1, 10)
    rows = df.select("*", *(F.sum(F.when(F.col(level) == i, 1).otherwise(0)).over(w).alias(f"__n{i}") for i in levels))
    rows = rows.select("*", *(F.max(F.when(F.col(level) < i, F.col(f"__n{i}"))).over(w).alias(f"__z{i}") for i in levels))
    parts = F.array(*(F.when(F.col(level) >= i, (F.col(f"__n{i}") - F.coalesce(f"__z{i}", F.lit(0))).cast("string")) for i in levels))
    return rows.withColumn("label", F.array_join(F.array_compact(parts), ".")).drop(*(f"__n{i}" for i in levels), *(f"__z{i}" for i in levels))
