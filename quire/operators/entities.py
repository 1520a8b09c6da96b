"""Entries against external records: likeness, field agreement, status, assignment one to one, author-year links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.fuzzy import plain_udf, ratio_udf, sorted_ratio_udf, surname_udf
from quire.functions.text import HEAD_WORDS, PREFIX_WORDS, ascii_lower, title_head, title_prefix, year_only_difference
from quire.functions.text import marker_numbers as numbers_of
from quire.operators.alike import alike, arranged_udf


def heads(df: DataFrame, key: str, title: Column, side: str) -> DataFrame:
    """key, block: two titles share a block if they share as many leading words as title_head asks for, or if one is the other's beginning.

    side: "l" or "r"; a whole title of one side meets the beginnings of the other's.
    """
    w = F.split(F.trim(ascii_lower(title)), r"\s+")
    first = lambda n: F.array_join(F.slice(w, 1, n), " ")
    other = {"l": "r", "r": "l"}[side]
    begun = F.when(F.size(w) > PREFIX_WORDS, F.transform(F.sequence(F.lit(PREFIX_WORDS), F.size(w) - 1), lambda n: F.concat(F.lit(other), first(n))))
    made = F.concat(F.array(F.when(F.size(w) >= HEAD_WORDS, F.concat(F.lit("h"), first(F.lit(HEAD_WORDS)))), F.when(F.size(w) >= PREFIX_WORDS, F.concat(F.lit(side), first(F.size(w))))), F.coalesce(begun, F.array().cast("array<string>")))
    return df.where(title.isNotNull()).select(key, F.explode(F.array_compact(made)).alias("block"))


def likely(entries: DataFrame, records: DataFrame, least: float) -> DataFrame:
    """ref_id, record_id: all pairs whose titles, or title and main title, are alike by `least`, and all that share a head."""
    a = entries.select("ref_id", arranged_udf("title").alias("a"))
    b = records.select("record_id", F.explode(F.array("title", F.coalesce("main_title", "title"))).alias("t")).select("record_id", arranged_udf("t").alias("b")).distinct()
    near = a.join(alike(a, b, least), "a").join(b, "b").select("ref_id", "record_id")
    begun = heads(entries, "ref_id", F.col("title"), "l").join(heads(records, "record_id", F.col("title"), "r"), "block").select("ref_id", "record_id")
    return near.unionByName(begun).distinct()


def candidates(entries: DataFrame, records: DataFrame, *, least: float = 92.0, horizon: int | None = None) -> DataFrame:
    """Pairs of entry and record whose titles agree, with the issues that speak against them.

    A pair needs a likeness of `least`, or a title that is the other's beginning or shares its head with no issue and
    author and year known on both sides; a title different in its year only needs the same DOI. Pairs whose first author
    and year both differ drop out unless the DOI is the same. A record that is no preprint and names two authors must agree
    in the second as well. Years agree within one, a preprint's within two; a record later than `horizon` + 1 is no
    contradiction to an entry before it. Columns: ref_id, record_id, score, issues, same_doi.
    """
    # names and titles are made plain once a row; a pair only meets the measures, all of them in one pass
    name = lambda k: plain_udf(surname_udf(F.get("authors", F.lit(k))))
    a = entries.select("ref_id", F.col("title").alias("ta"), plain_udf("title").alias("pa"), name(0).alias("fa"), name(1).alias("sa"), F.col("year").alias("ya"), F.lower("doi").alias("da"))
    b = records.select(
        "record_id", F.col("title").alias("tb"), plain_udf("title").alias("pb"), plain_udf(F.coalesce("main_title", "title")).alias("mb"), name(0).alias("fb"), name(1).alias("sb"),
        F.col("year").alias("yb"), F.col("alt_year").alias("zb"), F.lower("doi").alias("db"), F.col("arxiv_id").isNotNull().alias("preprint"),
    )
    p = likely(entries, records, least).join(a, "ref_id").join(b, "record_id")
    p = p.select("*", sorted_ratio_udf("pa", "pb").alias("s1"), sorted_ratio_udf("pa", "mb").alias("s2"), ratio_udf("fa", "fb").alias("r1"), ratio_udf("sa", "sb").alias("r2")).withColumn("score", F.greatest("s1", "s2"))
    same_doi = F.coalesce(F.col("da").endswith(F.col("db")), F.lit(False))
    late = F.least(F.abs(F.col("ya") - F.col("yb")), F.abs(F.col("ya") - F.col("zb")))
    differs = lambda x: F.coalesce(F.col(x) < 85, F.lit(False))
    year_differs = F.coalesce(late > F.when(F.col("preprint"), 2).otherwise(1), F.lit(False))
    if horizon is not None:
        year_differs = year_differs & ~F.coalesce((F.col("ya") < horizon) & (F.least("yb", "zb") > horizon + 1), F.lit(False))
    p = p.select("*", same_doi.alias("same_doi"), differs("r1").alias("author_differs"), (differs("r2") & ~F.col("preprint")).alias("second_differs"), year_differs.alias("year_differs"))
    issues = F.array_compact(F.array(F.when(F.col("author_differs"), "author"), F.when(F.col("second_differs"), "second_author"), F.when(F.col("year_differs"), "year"), F.when(F.col("da").isNotNull() & F.col("db").isNotNull() & ~F.col("same_doi"), "doi")))
    p = p.withColumn("issues", issues)
    full = F.col("fa").isNotNull() & F.col("fb").isNotNull() & F.col("ya").isNotNull() & F.coalesce("yb", "zb").isNotNull()
    rescued = (title_prefix(F.col("ta"), F.col("tb")) | title_head(F.col("ta"), F.col("tb"))) & (F.size("issues") == 0) & full
    fits = (F.col("score") >= least) | rescued
    barred = year_only_difference(F.col("ta"), F.col("tb")) | (F.col("author_differs") & F.col("year_differs"))
    return p.where(fits & (~barred | F.col("same_doi"))).select("ref_id", "record_id", F.round("score", 4).alias("score"), "issues", "same_doi")


def statuses(entries: DataFrame, found: DataFrame, grey: Column, answered: int | DataFrame, required: list[str] | None = None, least: int = 2) -> DataFrame:
    """ref_id, status, record_id, issues: verified, mismatch, not_found or unverifiable; the best record has fewest issues.

    answered: how many sources answered at all, or ref_id, source of those that answered for each entry. A silent source
    is no evidence: nothing is not_found for which fewer than `least` sources answered, or one of the `required` did not.
    Chinese entries and grey literature without a record are unverifiable.
    """
    w = Window.partitionBy("ref_id").orderBy(F.size("issues"), F.desc("score"), "record_id")
    best = found.withColumn("n", F.row_number().over(w)).where("n = 1").select("ref_id", "record_id", "issues")
    if isinstance(answered, DataFrame):
        entries = entries.join(answered.where("source IS NOT NULL").groupBy("ref_id").agg(F.collect_set("source").alias("responded")), "ref_id", "left")
        said = F.coalesce("responded", F.array().cast("array<string>"))
        silent = (F.size(said) < least) | (F.size(F.array_except(F.array(*map(F.lit, required or [])).cast("array<string>"), said)) > 0)
    else:
        silent = F.lit(answered < least)
    none = F.when((F.col("lang") == "zh") | grey | silent, "unverifiable").otherwise("not_found")
    status = F.when(F.col("record_id").isNull(), none).when(F.size("issues") == 0, "verified").otherwise("mismatch")
    return entries.join(best, "ref_id", "left").select("ref_id", status.alias("status"), "record_id", F.concat_ws(",", "issues").alias("issues"))


def fold_local(statuses: DataFrame, entries: DataFrame, copies: DataFrame) -> DataFrame:
    """statuses with what a copy at hand says: any disagreement of a trusted copy is a mismatch, agreement verifies what no
    source knew, and a mismatch with a source stands.

    copies: ref_id, title, authors, year, trusted; one row an entry at most. Titles and names in different scripts aren't
    compared, an unknown field speaks for nothing. Columns as of statuses, issues with local_title, local_author, local_year.
    """
    han = lambda x: x.rlike("[一-鿿]")
    e = entries.select("ref_id", F.col("title").alias("ta"), F.get("authors", F.lit(0)).alias("na"), F.col("year").alias("ya"))
    l = copies.select("ref_id", F.col("title").alias("tl"), F.get("authors", F.lit(0)).alias("nl"), F.array_join("authors", " ").alias("all_l"), F.col("year").alias("yl"), F.coalesce("trusted", F.lit(False)).alias("trusted"), F.lit(True).alias("held"))
    j = statuses.join(e, "ref_id").join(l, "ref_id", "left")
    same_script = lambda a, b: han(F.col(a)) == han(F.col(b))
    title = same_script("ta", "tl") & (ratio_udf(F.replace(plain_udf("ta"), F.lit(" "), F.lit("")), F.replace(plain_udf("tl"), F.lit(" "), F.lit(""))) < 85)
    name = plain_udf(surname_udf("na"))
    author = same_script("na", "nl") & ~F.contains(F.replace(plain_udf("all_l"), F.lit(" "), F.lit("")), F.replace(name, F.lit(" "), F.lit("")))
    year = F.abs(F.col("ya") - F.col("yl")) > 1
    told = lambda x, name: F.when(F.col("trusted") & F.coalesce(x, F.lit(False)), name)
    j = j.withColumn("local", F.array_compact(F.array(told(title, "local_title"), told(author, "local_author"), told(year, "local_year"))))
    unknown = F.col("status").isin("unverifiable", "not_found")
    status = F.when(~F.coalesce("held", F.lit(False)), F.col("status")).when(F.size("local") > 0, "mismatch").when(unknown, "verified").otherwise(F.col("status"))
    issues = F.when(F.size("local") > 0, F.concat_ws(",", F.when(F.col("status") == "mismatch", F.nullif("issues", F.lit(""))), F.array_join("local", ","))).otherwise(F.col("issues"))
    return j.select("ref_id", status.alias("status"), "record_id", issues.alias("issues"))


def structured_matches(items: DataFrame, entries: DataFrame, *, least: float = 80.0) -> DataFrame:
    """item_id, ref_id, score: the entry of the same manuscript that an item with parsed fields means.

    items: doc_id, item_id, title, year, family. The score is the likeness of the titles, or, for an entry without a title,
    0.9 of the best likeness of the item's title with a stretch of its line; 10 more each for the same year and the same
    first family name. The highest from `least` on wins, then the place in the list. Each pair needs what its bonuses leave
    of `least`; near() measures only pairs whose letters allow that, and every one of them.
    """
    import numpy as np
    import pandas as pd

    from quire.operators.alike import meeting, near

    i = items.where("title IS NOT NULL").select("doc_id", "item_id", F.col("year").cast("long").alias("y"), plain_udf("family").alias("f"), plain_udf("title").alias("t"), arranged_udf("title").alias("a"))
    line = F.when(F.col("title").isNull(), plain_udf("raw"))
    e = entries.where("title IS NOT NULL OR raw IS NOT NULL").select("doc_id", "ref_id", "pos", F.col("year").cast("long").alias("y"), plain_udf(surname_udf(F.get("authors", F.lit(0)))).alias("f"), line.alias("t"), arranged_udf("title").alias("a"))
    names = [i.schema["item_id"].dataType.simpleString(), e.schema["ref_id"].dataType.simpleString(), e.schema["pos"].dataType.simpleString()]

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(x) and len(y):
            def same(column: str) -> np.ndarray:
                codes = pd.factorize(pd.concat([x[column], y[column]]))[0]  # unknown: -1
                return (codes[: len(x), None] == codes[None, len(x) :]) & (codes[: len(x), None] >= 0)

            bonus = 10.0 * same("y") + 10.0 * (same("f") & (x["f"] != "").to_numpy()[:, None])
            need = np.where(same("doc_id"), least - 1e-4 - bonus, 1e9)  # the score is rounded to four places later
            for part, rows in (False, y["a"].notna().to_numpy()), (True, y["a"].isna().to_numpy()):
                at, weight = np.nonzero(rows)[0], 0.9 if part else 1.0
                k, j, s = near(x["t" if part else "a"].tolist(), y["t" if part else "a"].iloc[at].tolist(), need[:, at] / weight, part)
                got.append(pd.DataFrame({"item_id": x["item_id"].to_numpy()[k], "ref_id": y["ref_id"].to_numpy()[at[j]], "pos": y["pos"].to_numpy()[at[j]], "score": s * weight + bonus[k, at[j]]}))
        if not got:
            return pd.DataFrame({"item_id": [], "ref_id": [], "pos": [], "score": []})
        got = pd.concat(got)
        return got[got["score"] >= got.groupby("item_id", dropna=False)["score"].transform("max") - 1e-3]

    left, right = meeting(i, e, "doc_id")
    found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(score, f"item_id {names[0]}, ref_id {names[1]}, pos {names[2]}, score double")
    scored = found.withColumn("score", F.round("score", 4)).where(F.col("score") >= least)
    best = scored.groupBy("item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "ref_id")).alias("b"))
    return best.select("item_id", "b.ref_id", (-F.col("b.s")).alias("score"))


def assign(scores: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs by descending score: what a greedy pass over the sorted pairs takes, found by mutual best choices.

    In each round every left row and every right row names its best open pair (ties by left, then right key); pairs both
    sides name are taken, and all pairs that touch them drop out. A round takes the best pair of every connected rest at
    least, so rounds go on until nothing is open, each over fewer pairs, and no group ever meets in one task.
    """
    from quire.session import cut

    order = [F.desc(score), left, right]
    named = lambda df: cut(df.withColumn("__a", F.row_number().over(Window.partitionBy(left).orderBy(*order))).withColumn("__b", F.row_number().over(Window.partitionBy(right).orderBy(*order))))
    open_ = named(scores.groupBy(left, right).agg(F.max(score).alias(score)))
    taken = []
    while not open_.isEmpty():
        mutual = open_.where("__a = 1 AND __b = 1").drop("__a", "__b")
        taken.append(mutual)
        open_ = named(open_.drop("__a", "__b").join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti"))
    out = taken[0] if taken else open_.drop("__a", "__b")
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def marker_numbers(markers: DataFrame) -> DataFrame:
    """doc_id, marker_id, number of numeric markers in square brackets, distinct. markers: doc_id, marker_id, raw."""
    return markers.where(F.col("raw").startswith("[")).select("doc_id", "marker_id", F.explode(numbers_of(F.col("raw"))).alias("number")).distinct()


def listed_entries(entries: DataFrame) -> DataFrame:
    """List entries with their number by label and by place."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "ref_id")).cast("bigint")
    return entries.where("origin = 'list'").select("doc_id", "ref_id", F.regexp_extract("label", r"^\[?([0-9]+)\]?$", 1).try_cast("bigint").alias("label_number"), place.alias("place"))


def numbered_links(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """marker_id, number, ref_id: the entry of each number, the one that bears it as label, else the one at that place."""
    e = listed_entries(entries)
    by_label = e.where("label_number IS NOT NULL").groupBy("doc_id", F.col("label_number").alias("number")).agg(F.min_by("ref_id", F.struct("place")).alias("label_ref"))
    by_place = e.select("doc_id", F.col("place").alias("number"), F.col("ref_id").alias("place_ref"))
    hit = marker_numbers(markers).join(by_label, ["doc_id", "number"], "left").join(by_place, ["doc_id", "number"], "left")
    return hit.select("marker_id", "number", F.coalesce("label_ref", "place_ref").alias("ref_id"))


def author_year_links(items: DataFrame, entries: DataFrame, *, least: float = 85.0) -> DataFrame:
    """marker_id, names, year, ref_id: the entry of the same manuscript that a marker's names and year mean.

    items: doc_id, marker_id, names, year, suffix. An entry's year must be the same or unknown, its first family name like
    the first of the marker's by `least`; the likest wins, then the place in the list. Where several are equally like, a
    letter after the year picks among them in order.
    """
    first = F.regexp_replace(F.split("names", r"\s+et\s+al|\s+and\s+|\s*&\s*|等|和|,|，")[0], r"[\s,，、.。]+$", "")
    m = items.withColumn("want", plain_udf(first)).where("want <> ''")
    e = entries.select("doc_id", "ref_id", "pos", F.col("year").cast("bigint").alias("ref_year"), plain_udf(surname_udf(F.get("authors", F.lit(0)))).alias("have"))
    e = e.where("have <> ''")
    # an entry of known year meets markers of that year only; those without a year are few
    p = m.join(e.where("ref_year IS NOT NULL").withColumn("year", F.col("ref_year")), ["doc_id", "year"]).unionByName(m.join(e.where("ref_year IS NULL"), "doc_id"))
    zh = F.col("want").rlike("[一-鿿]")
    p = p.withColumn("score", F.when(zh, F.when(F.col("have").startswith(F.col("want")) | F.col("want").startswith(F.col("have")), 100.0).otherwise(0.0)).otherwise(ratio_udf("want", "have"))).where(F.col("score") >= least)
    group = ["marker_id", "names", "year", "suffix"]
    top = p.withColumn("best", F.max("score").over(Window.partitionBy(*group))).where("score = best")
    ranked = top.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("pos", "ref_id"))).withColumn("n", F.count("*").over(Window.partitionBy(*group)))
    letter = F.when((F.col("suffix") != "") & (F.ascii("suffix") - 96 <= F.col("n")), F.ascii("suffix") - 96).otherwise(1)
    return ranked.where(F.col("k") == letter).select(*group, "ref_id")
