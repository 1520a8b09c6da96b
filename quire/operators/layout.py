"""Page layout from glyph or box tables: gutters, lines, merged boxes, table grids, body size, joined fragments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gutters(glyphs: DataFrame, page: str, width: int = 4, margin: float = 0.2) -> DataFrame:
    """page, from, to: the longest run of bins, outside the outer fifths, that the fewest glyphs cross.

    glyphs: page, x0, x1. Only the page's bins are exploded, which its width bounds.
    """
    bins = glyphs.select(page, F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width))).alias("bin"))
    cover = bins.groupBy(page, "bin").agg(F.count("*").alias("n"))
    span = glyphs.groupBy(page).agg(F.floor(F.min("x0") / width).alias("a"), F.floor(F.max("x1") / width).alias("b"))
    full = span.select(page, "a", "b", F.explode(F.sequence("a", "b")).alias("bin")).join(cover, [page, "bin"], "left").select(page, "bin", F.coalesce("n", F.lit(0)).alias("n"), "a", "b")
    inner = full.where((F.col("bin") > F.col("a") + (F.col("b") - F.col("a")) * margin) & (F.col("bin") < F.col("b") - (F.col("b") - F.col("a")) * margin))
    least = inner.withColumn("least", F.min("n").over(Window.partitionBy(page))).where("n = least")
    runs = least.withColumn("island", F.col("bin") - F.row_number().over(Window.partitionBy(page).orderBy("bin"))).groupBy(page, "island").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.max("n").alias("n"))
    best = runs.groupBy(page).agg(F.max_by(F.struct("low", "high", "n"), F.struct(F.col("high") - F.col("low"), -F.col("low"))).alias("r"))
    return best.select(page, (F.col("r.low") * width).alias("from"), ((F.col("r.high") + 1) * width).alias("to"), F.col("r.n").alias("crossed"))


def lines(glyphs: DataFrame, page: str, tolerance: float = 0.4, gap: float = 1.2) -> DataFrame:
    """page, line, piece, text: glyphs clustered by baseline within a share of their size, cut where a wide gap is.

    glyphs: page, ch, x0, x1, base, size. A baseline joins the line before it if it is near by the larger size, so raised
    and lowered signs stay with their line.
    """
    w = Window.partitionBy(page).orderBy("base", "x0")
    near = F.col("base") - F.lag("base").over(w) > tolerance * F.greatest("size", F.lag("size").over(w))
    lined = glyphs.withColumn("line", F.sum(F.when(near, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(page, "line").orderBy("x0", "base")
    wide = F.col("x0") - F.lag("x1").over(v) > gap * F.col("size")
    cut = lined.withColumn("piece", F.sum(F.when(wide, 1).otherwise(0)).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ch"))), lambda g: g["ch"]), "")
    return cut.groupBy(page, "line", "piece").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.avg("base").alias("base"), F.mode("size").alias("size"))


def merge_boxes(boxes: DataFrame, page: str) -> DataFrame:
    """Bounding boxes of groups of rectangles that touch, again until none touch. boxes: page, x0, y0, x1, y1; one page is one group."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [list(r) for r in pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)]
        out: list[list[float]] = []
        while left:
            box = left.pop()
            while True:
                hit = [o for o in (*left, *out) if o[0] <= box[2] and box[0] <= o[2] and o[1] <= box[3] and box[1] <= o[3]]
                if not hit:
                    break
                for o in hit:
                    box = [min(box[0], o[0]), min(box[1], o[1]), max(box[2], o[2]), max(box[3], o[3])]
                    (left if o in left else out).remove(o)
            out.append(box)
        return pd.DataFrame([(pdf[page].iloc[0], *o) for o in sorted(out)], columns=[page, "x0", "y0", "x1", "y1"])

    kind = boxes.schema[page].dataType.simpleString()
    return boxes.select(page, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).groupBy(page).applyInPandas(merge, f"{page} {kind}, x0 double, y0 double, x1 double, y1 double")


def grid_columns(pieces: DataFrame, table: str, gap: float = 1.0) -> DataFrame:
    """Pieces of a table's lines with the column they stand in: columns are the unions of the pieces' horizontal spans."""
    w = Window.partitionBy(table).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("column", F.sum(F.when(F.col("x0") > reach + gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def table_cells(pieces: DataFrame, table: str, gap: float = 1.0) -> DataFrame:
    """table, row, column, text: a table's pieces as cells, rows that go on in the next line merged.

    pieces: table, line, x0, x1, text. A line without a first cell that leaves another empty too goes on with the row above
    it; texts of a cell are joined as running text. Two windows over a table's lines, no state in Python.
    """
    cells = grid_columns(pieces, table, gap).groupBy(table, "line", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda p: p["text"]), " ").alias("text"))
    width = cells.groupBy(table).agg(F.countDistinct("column").alias("__width"))
    lines_ = cells.groupBy(table, "line").agg(F.count("*").alias("__n"), F.min("column").alias("__first")).join(width, table)
    w = Window.partitionBy(table).orderBy("line")
    fresh = (F.row_number().over(w) == 1) | (F.col("__first") == 0) | (F.col("__n") == F.col("__width"))
    rows = lines_.withColumn("__new", fresh).withColumn("row", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = cells.join(rows.select(table, "line", "row"), [table, "line"]).groupBy(table, "row", "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: p["text"]).alias("p"))
    return parts.select(table, "row", "column", F.aggregate("p", F.lit(None).cast("string"), join_fragments).alias("text"))


def body_size(glyphs: DataFrame, doc: str) -> DataFrame:
    """The commonest glyph size of each document, the smallest of equally common ones."""
    n = glyphs.groupBy(doc, "size").agg(F.count("*").alias("n"))
    return n.groupBy(doc).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))


def join_fragments(a: Column, b: Column) -> Column:
    """Two pieces of running text as one: a hyphen at the end goes if small letters meet, Han characters join without a space."""
    han = "[\\x{3400}-\\x{9FFF}，。；：、）」』》]"
    return (
        F.when(a.isNull(), b).when(b.isNull(), a)
        .when(a.rlike("[a-zß-ÿ][-‐]$") & b.rlike("^[a-zß-ÿ]"), F.concat(F.regexp_replace(a, "[-‐]$", ""), b))
        .when(a.rlike(han + "$") | b.rlike("^" + han), F.concat(a, b)).otherwise(F.concat(F.rtrim(a), F.lit(" "), F.ltrim(b)))
    )


def plausible_number(last: list[int], number: list[int]) -> bool:
    """Whether a heading number may follow another: its next sibling, first child, or a next sibling of an ancestor."""
    if not last:
        return number in ([1], [0])
    if number == [*last, 1]:
        return True
    n = len(number)
    return 0 < n <= len(last) and number[:-1] == last[: n - 1] and number[-1] == last[n - 1] + 1


def plausible_headings(df: DataFrame, doc: str, order: str, number: str) -> DataFrame:
    """doc, order, accepted of headings by their number ('2.1'): each is held against the last accepted one of its document."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        last: list[int] = []
        out = []
        for s in pdf.sort_values(order, kind="stable")[number]:
            parts = [int(x) for x in s.split(".")] if isinstance(s, str) and all(x.isdigit() for x in s.split(".")) else []
            ok = bool(parts) and plausible_number(last, parts)
            last = parts if ok else last
            out.append(ok)
        return pdf.sort_values(order, kind="stable").assign(accepted=out)[[doc, order, "accepted"]]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(doc, order, number).groupBy(doc).applyInPandas(fold, f"{doc} {kinds[doc]}, {order} {kinds[order]}, accepted boolean")
