"""References to records that do not exist: an as-of anti join on range-partitioned key digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import micros, month

FOREVER = np.iinfo(np.int64).max
BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed(column):
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(column, BLANK, "")


def probe(refs: pd.DataFrame, parents: pd.DataFrame) -> np.ndarray:
    """True for each reference that no parent row covers.

    refs: scope, key, at. parents: scope, key, begin, end. A parent covers a reference of the same scope and key when
    begin <= at < end. Parents become one array sorted by (key, begin) with the latest end so far beside it; all
    references are looked up in it by one binary search.
    """
    if parents.empty or refs.empty:
        return np.ones(len(refs), bool)
    # scope may be null, and then has no parent
    full = refs["scope"].notna().to_numpy()
    join = lambda x: (x["scope"].fillna("").str.len().astype(str) + ":" + x["scope"].fillna("") + x["key"]).to_numpy(object)
    names, code = np.unique(join(parents), return_inverse=True)
    wanted = join(refs)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    known = (names[at] == wanted) & full
    times = np.unique(np.concatenate([parents["begin"].to_numpy(np.int64), refs["at"].to_numpy(np.int64)]))
    rank = lambda x: np.searchsorted(times, x.to_numpy(np.int64)).astype(np.int64)
    place = code.astype(np.int64) * len(times) + rank(parents["begin"])
    order = np.argsort(place, kind="stable")
    place, code = place[order], code[order]
    latest = pd.Series(parents["end"].to_numpy(np.int64)[order]).groupby(code).cummax().to_numpy()
    hit = np.searchsorted(place, at.astype(np.int64) * len(times) + rank(refs["at"]), side="right") - 1
    inside = known & (hit >= 0) & (code[np.maximum(hit, 0)] == at)
    return ~(inside & (latest[np.maximum(hit, 0)] > refs["at"].to_numpy(np.int64)))


def orphans(refs: DataFrame, parents: DataFrame, *, rows_per_range: int = 200_000, max_ranges: int = 1 << 15) -> DataFrame:
    """Rows of refs for which parents holds no row that exists at their time.

    refs: from_table, from_id, scope, cite_key (trimmed), at (microseconds). parents: scope, key, begin, end (microseconds,
    end null: still there). Keys are split into ranges of a 64-bit digest of (scope, key); a range with more references
    than rows_per_range is split by reference and its parents are given to each split, so a key that holds a third of all
    references is probed by many tasks. The number of ranges follows the parents' count, at most max_ranges, and only
    that many counts are broadcast.

    A null scope has no parents. References with a null or blank key, or a null time, are no case. Parents with a null
    begin never exist. Repeated rows of either side change nothing: the result is distinct.
    """
    refs = refs.where((F.col("cite_key") != "") & F.col("at").isNotNull())
    parents = parents.where(F.col("begin").isNotNull() & F.col("key").isNotNull() & F.col("scope").isNotNull())
    parents = parents.groupBy("scope", "key", "begin").agg(F.max(F.coalesce("end", F.lit(int(FOREVER)))).alias("end"))  # repeats fold before they are shuffled
    ranges = max(1, min(max_ranges, -(-parents.count() // rows_per_range) * 2))
    # the digest's upper 31 bits, cut into equal ranges
    of = lambda scope, key: F.shiftright(F.shiftrightunsigned(F.xxhash64(scope, key), 33) * F.lit(ranges), 31).cast("int")
    refs = refs.withColumn("range", of("scope", "cite_key"))
    sizes = refs.groupBy("range").agg(F.ceil(F.count("*") / rows_per_range).cast("int").alias("splits"))
    sizes = F.broadcast(sizes)  # at most max_ranges rows
    left = refs.join(sizes, "range").select("*", (F.pmod(F.xxhash64("from_id", "at"), F.col("splits"))).cast("int").alias("split"))
    right = (
        parents.select("scope", "key", "begin", "end", of("scope", "key").alias("range"))
        .join(sizes, "range")
        .select("scope", "key", "begin", "end", "range", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"))
    )

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.rename(columns={"cite_key": "key"})
        a = a[probe(a, b)] if len(a) else a
        return a.rename(columns={"key": "cite_key"})[["from_table", "from_id", "cite_key", "period"]].drop_duplicates()

    left = left.select("from_table", "from_id", "scope", "cite_key", "at", "period", "range", "split")
    found = left.groupBy("range", "split").cogroup(right.groupBy("range", "split")).applyInPandas(search, "from_table string, from_id string, cite_key string, period string")
    return found.distinct()


def citation_orphans(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """Keys of markers, and crossref fields of bib entries, that name no entry of their manuscript at their time.

    Null or empty keys arrays and field maps give no reference. Extra columns are ignored.
    """
    cited = markers.select(F.lit("markers").alias("from_table"), F.col("marker_id").alias("from_id"), F.col("doc_id").alias("scope"), F.explode("keys").alias("k"), F.col("edited_at").alias("t"))
    crossed = entries.select(F.lit("bib_entries").alias("from_table"), F.col("entry_id").alias("from_id"), F.col("doc_id").alias("scope"), F.col("fields")["crossref"].alias("k"), F.col("added_at").alias("t"))
    refs = cited.unionByName(crossed).select("from_table", "from_id", "scope", trimmed("k").alias("cite_key"), micros("t").alias("at"), month("t").alias("period"))
    parents = entries.select(F.col("doc_id").alias("scope"), trimmed("key").alias("key"), micros("added_at").alias("begin"), micros("deleted_at").alias("end"))
    return orphans(refs, parents)


def orphans_per_period(found: DataFrame) -> DataFrame:
    """Orphan references counted per table and month."""
    return found.groupBy("from_table", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("cite_key").alias("n_keys"))
