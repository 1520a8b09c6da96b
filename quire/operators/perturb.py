"""Seeded errors for test data: which rows are changed, and how, follows from md5(seed|key), so every engine and plan agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, key: Column, what: str) -> Column:
    """A number in [0, 1) for a key and a purpose."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def inject(entries: DataFrame, seed: str, share: float = 0.1) -> DataFrame:
    """ref_id, raw, title, year, authors with errors in about `share` of the rows; kind says which (null: none), and old_* keep
    what was there.

    year: shifted by three to nine years; title: a word dropped; author: the first two swapped; number: a number in the title
    raised; source: the line cut in half. Where a row lacks what its kind changes, it stays as it is and kind is null.
    """
    key = F.col("ref_id")
    kinds = F.array(*map(F.lit, ("year", "title", "author", "number", "source")))
    chosen = F.when(draw(seed, key, "row") < share, F.get(kinds, (draw(seed, key, "kind") * 5).cast("int")))
    shift = (draw(seed, key, "shift") * 7).cast("int") + 3
    words = F.split("title", " ")
    place = (draw(seed, key, "word") * F.size(words)).cast("int")
    dropped = F.array_join(F.concat(F.slice(words, F.lit(1), place), F.slice(words, place + 2, F.size(words))), " ")
    number = F.regexp_extract("title", "[0-9]{1,9}", 0)
    raised = F.regexp_replace(F.col("title"), F.concat(F.lit("(^|[^0-9])"), number, F.lit("($|[^0-9])")), F.concat(F.lit("$1"), (number.try_cast("bigint") + 7).cast("string"), F.lit("$2")))
    swapped = F.concat(F.slice("authors", 2, 1), F.slice("authors", 1, 1), F.slice("authors", F.lit(3), F.greatest(F.size("authors"), F.lit(1))))
    fits = (
        F.when(chosen == "year", F.col("year").isNotNull()).when(chosen == "title", F.size(words) > 1).when(chosen == "author", (F.size("authors") > 1) & (F.col("authors")[0] != F.col("authors")[1]))
        .when(chosen == "number", (number != "") & (raised != F.col("title"))).when(chosen == "source", F.length("raw") > 1)
    )
    rows = entries.select("ref_id", "raw", "title", "year", "authors").withColumn("kind", F.when(fits, chosen))
    k = F.col("kind")
    return rows.select(
        "ref_id", F.when(k == "source", F.left("raw", (F.length("raw") / 2).cast("int"))).otherwise(F.col("raw")).alias("raw"), F.when(k == "title", dropped).when(k == "number", raised).otherwise(F.col("title")).alias("title"),
        F.when(k == "year", F.col("year") + shift).otherwise(F.col("year")).alias("year"), F.when(k == "author", swapped).otherwise(F.col("authors")).alias("authors"), "kind",
        F.col("raw").alias("old_raw"), F.col("title").alias("old_title"), F.col("year").alias("old_year"), F.col("authors").alias("old_authors"),
    )


def inject_markers(markers: DataFrame, entries: DataFrame, seed: str, share: float = 0.1) -> DataFrame:
    """doc_id, marker_id, ref_ids with errors in about `share` of the rows; kind says which (null: none), and old_ref_ids keeps what
    was there.

    swap: the first reference replaced by the entry after it in the list, which the marker doesn't cite; drop: one of several
    references left out; stray: the next entry cited as well. Where a row lacks what its kind changes, it stays as it is.
    """
    key = F.col("marker_id")
    kinds = F.array(*map(F.lit, ("swap", "drop", "stray")))
    w = Window.partitionBy("doc_id").orderBy("pos", "ref_id")
    following = entries.select("doc_id", F.col("ref_id").alias("__first"), F.lead("ref_id").over(w).alias("__next"))
    rows = markers.select("doc_id", "marker_id", "ref_ids", F.get("ref_ids", F.lit(0)).alias("__first")).join(following, ["doc_id", "__first"], "left")
    chosen = F.when(draw(seed, key, "row") < share, F.get(kinds, (draw(seed, key, "kind") * 3).cast("int")))
    other = F.col("__next").isNotNull() & ~F.coalesce(F.array_contains("ref_ids", F.col("__next")), F.lit(False))
    fits = F.when(chosen == "drop", F.size("ref_ids") > 1).otherwise(other)
    rows = rows.withColumn("kind", F.when(fits, chosen))
    k, rest = F.col("kind"), F.slice("ref_ids", F.lit(2), F.greatest(F.size("ref_ids"), F.lit(1)))
    new = F.when(k == "swap", F.concat(F.array("__next"), rest)).when(k == "drop", rest).when(k == "stray", F.concat("ref_ids", F.array("__next"))).otherwise(F.col("ref_ids"))
    return rows.select("doc_id", "marker_id", new.alias("ref_ids"), "kind", F.col("ref_ids").alias("old_ref_ids"))
