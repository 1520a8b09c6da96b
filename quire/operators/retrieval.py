"""Ranked retrieval: BM25, cosine top-k, rank fusion, neighbours, excerpts under a budget."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions.text import tokens
from quire.session import busy, cut


def bm25(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, terms: str, *, k1: float = 1.5, b: float = 0.75, most_tokens: int = 1_000_000) -> DataFrame:
    """query, doc, score, n_terms for each pair that shares a token; Okapi BM25 with idf ln(1 + (N - df + .5)/(df + .5)).

    Only tokens of queries leave the scan: they are broadcast while there are at most most_tokens of them, else joined by
    shuffle. Null texts are no documents; N counts the others. A query's token counts once.
    """
    asked = queries.select(query, F.explode(F.array_distinct(tokens(F.col(terms)))).alias("token"))
    wanted = asked.select("token").distinct()
    few = wanted.limit(most_tokens + 1).count() <= most_tokens
    docs = busy(docs.where(F.col(text).isNotNull()).select(doc, text))
    read = docs.select(doc, tokens(F.col(text)).alias("t"))
    # each text is cut once: an empty token bears its length, for the mean over all, and what is counted is written once
    every = wanted.unionByName(queries.sparkSession.createDataFrame([("",)], "token string"))
    every = F.broadcast(every) if few else every
    told = cut(read.select(doc, F.size("t").alias("n"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("token")).join(every, "token").groupBy(doc, "n", "token").agg(F.count("*").alias("tf")))
    size, tf = told.where("token = ''").agg(F.count("*").alias("N"), F.avg("n").alias("mean")), told.where("token <> ''")
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(size)).select("token", "mean", F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # size is one row
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    weighted = tf.join(idf, "token").select(doc, "token", "n", gain.alias("gain"))
    return weighted.join(asked, "token").groupBy(query, doc).agg(F.round(F.sum("gain"), 6).alias("score"), F.count("*").alias("n_terms"), F.max("n").alias("n_tokens"))


def top(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group and their rank from 1."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], keys: list[str], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: keys, fused = sum of 1/(constant + rank) over the rankings that hold the pair."""
    all_ = rankings[0].select(*keys, "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select(*keys, "rank"))
    return all_.groupBy(*keys).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fused"))


def cosine_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, *, block: int = 4096) -> DataFrame:
    """query, key, score, rank: the k nearest of all rows for each query row, itself left out, exactly.

    Queries are taken in blocks of bounded size; each task multiplies its rows with the block and keeps k per query, so at
    most k rows per query and task are shuffled. Rows with a null or zero vector match nothing.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    kind, key_type = vectors.schema[key].dataType.simpleString(), to_arrow_type(vectors.schema[key].dataType)
    parts = []
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i).select(key, vector).where(F.col(vector).isNotNull()).collect()
        if not rows:
            continue
        ids = [r[0] for r in rows]
        q = np.array([r[1] for r in rows], float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def near(batches, ids=ids, q=q):
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                keys = batch.column(0).to_pylist()
                x = np.array(batch.column(1).to_pylist(), float)
                if not len(x):
                    continue
                norm = np.linalg.norm(x, axis=1)
                s = np.round(q @ (x / np.maximum(norm, 1e-300)[:, None]).T, 6)
                s[:, norm == 0] = -2
                for a in range(len(ids)):
                    cut = np.flatnonzero(s[a] >= np.partition(s[a], -min(k + 1, len(keys)))[-min(k + 1, len(keys))])
                    best[a] = heapq.nsmallest(k, best[a] + [(-s[a][j], keys[j]) for j in cut if keys[j] != ids[a] and s[a][j] > -2])
            out = [(a, j, -s) for a, some in zip(ids, best) for s, j in some]
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (key_type, key_type, pa.float64()))], ["query", key, "score"])

        parts.append(vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(near, f"query {kind}, {key} {kind}, score double"))
    if not parts:
        return vectors.select(F.col(key).alias("query"), key, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top(found, "query", [F.desc("score"), F.col(key)], k)


def with_neighbours(ranked: DataFrame, all_: DataFrame, group: str, position: str, radius: int) -> DataFrame:
    """Positions within `radius` of a ranked one, distinct, as far as they exist."""
    around = ranked.select(group, F.explode(F.sequence(F.col(position) - radius, F.col(position) + radius)).alias(position)).distinct()
    return all_.join(around, [group, position], "left_semi")


def fill(windows: list[tuple[int, float, int]], room: int, most: int, apart: int = 3) -> list[int]:
    """Which windows (position, score, length), best score first, fit: none within `apart` of one taken, until the room or
    the number of parts is used up; what overshoots last is still taken."""
    taken: list[int] = []
    used = 0
    for at, score, size in sorted(windows, key=lambda w: (-w[1], w[0])):
        if score <= 0 or room <= 0:
            break
        if any(abs(at - t) < apart for t in taken):
            continue
        taken.append(at)
        used += size + 1
        if used >= room or len(taken) >= most:
            break
    return taken


def excerpt(windows: DataFrame, group: str, position: str, score: str, size: str, *, room: int = 2500, most: int = 5) -> DataFrame:
    """group, position, rank of the windows that make each group's excerpt.

    The greedy choice needs a group's windows in order; only positions, scores and lengths are gathered, not texts.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fill(list(pdf[[position, score, size]].itertuples(index=False, name=None)), room, most)
        return pd.DataFrame({group: pd.Series([pdf[group].iloc[0]] * len(got), dtype=object), position: got, "rank": range(1, len(got) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    return windows.select(group, position, score, size).groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, {position} {kinds[position]}, rank bigint")
