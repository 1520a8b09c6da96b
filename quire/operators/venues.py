"""Venues: one name for several spellings, and which venue a paper was printed in, by its DOI, numbers and running heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_venue, squash
from quire.operators.alike import alike


def keys_of(registry: DataFrame) -> DataFrame:
    """venue_id, key, from the names and aliases of a registry: id, name, aliases."""
    names = registry.select(F.col("id").alias("venue_id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return names.select("venue_id", squash(clean_venue(F.col("n"))).alias("key")).where("key <> ''").distinct()


def same_venues(left: DataFrame, right: DataFrame, registry: DataFrame | None = None, *, least: float = 92.0) -> DataFrame:
    """venue, known, how, score: pairs of names that mean one venue. left: venue; right: known.

    how: key (equal without case, signs and leading words of proceedings), alias (names of one entry of the registry) or
    alike (keys of six letters or more, `least` like). All pairs are compared, each comes out once, by the surest way.
    """
    a = left.where("venue IS NOT NULL").select("venue", squash(clean_venue(F.col("venue"))).alias("a")).where("a <> ''").distinct()
    b = right.where("known IS NOT NULL").select("known", squash(clean_venue(F.col("known"))).alias("b")).where("b <> ''").distinct()
    long = lambda df, k: df.where(F.length(k) >= 6).select(k)
    pairs = alike(long(a, "a"), long(b, "b"), least).select("a", "b", "score", F.lit("alike").alias("how"))
    pairs = pairs.unionByName(a.select("a").distinct().join(b.select("b").distinct(), F.col("a") == F.col("b")).select("a", "b", F.lit(100.0).alias("score"), F.lit("key").alias("how")))
    if registry is not None:
        k = keys_of(registry)
        pairs = pairs.unionByName(k.select("venue_id", F.col("key").alias("a")).join(k.select("venue_id", F.col("key").alias("b")), "venue_id").select("a", "b", F.lit(100.0).alias("score"), F.lit("alias").alias("how")))
    rank = F.when(F.col("how") == "key", 0).when(F.col("how") == "alias", 1).otherwise(2)
    one = pairs.groupBy("a", "b").agg(F.min(F.struct(rank.alias("r"), "how", "score")).alias("x")).select("a", "b", "x.how", F.round("x.score", 4).alias("score"))
    return a.join(one, "a").join(b, "b").select("venue", "known", "how", "score")


def printed_in(papers: DataFrame, registry: DataFrame) -> DataFrame:
    """paper_id, venue_id, how: the venue whose traces a paper bears, the surest first: the prefix of its DOI, a number such as
    an ISSN in its head, or a name of four letters or more in its running heads.

    papers: paper_id, doi, head (the first page's beginning), edges (running heads and feet, not the list of references);
    registry: id, name, aliases, doi_prefixes, numbers. The registry is joined by prefix and scanned against heads in one
    row a venue, so it should be the small side; nothing is broadcast here.
    """
    prefix = registry.select(F.col("id").alias("venue_id"), F.explode("doi_prefixes").alias("p")).select("venue_id", F.lower("p").alias("p"), F.length("p").alias("size"))
    doi = papers.where("doi IS NOT NULL").select("paper_id", F.lower("doi").alias("doi")).withColumn("size", F.explode(F.sequence(F.lit(4), F.least(F.length("doi"), F.lit(40)))))
    by_doi = doi.withColumn("p", F.expr("left(doi, size)")).join(prefix, ["p", "size"]).select("paper_id", "venue_id", F.lit(0).alias("rank"), F.lit("doi_prefix").alias("how"))
    token = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[0-9]{4}-[0-9]{3}[0-9x]"), 0))
    number = registry.select(F.col("id").alias("venue_id"), F.explode("numbers").alias("n")).select("venue_id", F.lower("n").alias("n"))
    by_number = papers.select("paper_id", F.explode(token(F.col("head"))).alias("n")).join(number, "n").select("paper_id", "venue_id", F.lit(1).alias("rank"), F.lit("number").alias("how"))
    # a name is looked for by its first four letters: a running head holds few places where one can begin
    names = keys_of(registry).where(F.length("key") >= 4).withColumn("g", F.left("key", F.lit(4)))
    edges = papers.where("edges IS NOT NULL").select("paper_id", squash(F.col("edges")).alias("e")).where(F.length("e") >= 4)
    grams = edges.select("paper_id", "e", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("e") - 3), lambda i: F.substr("e", i, F.lit(4))))).alias("g"))
    by_name = grams.join(names, "g").where(F.contains("e", F.col("key"))).select("paper_id", "venue_id", F.lit(2).alias("rank"), F.lit("heads").alias("how"))
    best = by_doi.unionByName(by_number).unionByName(by_name).groupBy("paper_id").agg(F.min(F.struct("rank", "venue_id", "how")).alias("b"))
    return best.select("paper_id", "b.venue_id", "b.how")

