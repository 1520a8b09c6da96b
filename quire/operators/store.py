"""Tables that persist: content-keyed caches with expiry, append logs by day, resumable work, provider calls, round trips."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cached(keys: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """What the cache holds for the keys (the newest value of each), and the keys it lacks; both without repeats."""
    newest = Window.partitionBy(key).orderBy(F.desc("created_at"), "value")
    kept = cache.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return wanted.join(kept, key), wanted.join(kept, key, "left_anti")


def unexpired(cache: DataFrame, now: Column, prefixes: list[str], days: int = 30, key: str = "key") -> DataFrame:
    """Without rows older than `days` whose key begins with one of the prefixes; other rows never expire."""
    short = F.lit(False)
    for p in prefixes:
        short = short | F.col(key).startswith(p)
    return cache.where(~(short & (F.col("created_at") < now - F.make_dt_interval(F.lit(days)))))


def upsert(table: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of both with the greatest version of each key; of equal versions the fresh one."""
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("__fresh"))
    both = table.withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__fresh")


def append_by_day(log: DataFrame, path: str, ts: str = "ts") -> None:
    """Adds rows to a log partitioned by day, so that reads of some days skip the others."""
    log.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key the output doesn't hold yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def call_provider(requests: DataFrame, cache: DataFrame, provider: Callable[[list[str]], Iterable[str | None]], kind: str, version: str, batch: int = 5) -> tuple[DataFrame, DataFrame]:
    """Answers of a provider to requests, and the rows to add to the cache.

    requests: id, prompt. Equal prompts are asked once, prompts in the cache not at all; the key holds the kind and version, never
    a row's id. A provider gets `batch` prompts at a time and answers None where it fails; failures are not cached.
    """
    key = F.concat(F.lit(f"{kind}|"), F.sha2(F.concat_ws("\x1f", F.lit(version), F.col("prompt")), 256))
    keyed = requests.withColumn("key", key)
    have, lack = cached(keyed, cache)
    todo = lack.join(keyed.groupBy("key").agg(F.min("prompt").alias("prompt")), "key")

    def ask(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(provider(some.column(1).to_pylist())), pa.string())], ["key", "value"])

    fresh = todo.select("key", "prompt").mapInArrow(ask, "key string, value string").where("value IS NOT NULL")
    answers = have.select("key", "value").unionByName(fresh)
    return keyed.join(answers, "key", "left").select("id", "value"), fresh.withColumn("created_at", F.current_timestamp())


def routed(providers: list[tuple[str, Callable[[list[str]], Iterable[str | None]]]], *, valid: Callable[[str], bool] | None = None, tries: int = 2, private: Callable[[str], bool] | None = None, local: tuple[str, ...] = ()) -> Callable[[list[str]], list[str | None]]:
    """One provider made of several, for call_provider: each prompt goes to the first that answers it validly.

    providers: (name, function) in the order of the route. A provider that raises or gives nothing valid is asked `tries` times
    for what is open, then the next one is. Prompts that are private go only to providers named in `local`; None is left where
    none answers.
    """
    def ask(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        for name, provider in providers:
            for _ in range(tries):
                todo = [i for i, p in enumerate(prompts) if out[i] is None and (name in local or private is None or not private(p))]
                if not todo:
                    break
                try:
                    got = list(provider([prompts[i] for i in todo]))
                except Exception:  # a provider that fails is one that gives no answer
                    continue
                for i, a in zip(todo, got):
                    if a is not None and (valid is None or valid(a)):
                        out[i] = a
        return out

    return ask


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, rows that only one of two tables has, with repeats; empty when they hold the same."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def reject_all(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """Paragraphs with every tracked edit undone. paragraphs: para_id, text (as accepted); edits: para_id, start, old, new.

    start is the place in the accepted text. Edits of a paragraph don't overlap; they are undone from the end.
    """
    ordered = edits.groupBy("para_id").agg(F.sort_array(F.collect_list(F.struct("start", "old", "new")), asc=False).alias("edits"))
    undo = F.aggregate("edits", F.col("text"), lambda t, e: F.concat(F.substr(t, F.lit(1), e["start"]), e["old"], F.substr(t, e["start"] + F.length(e["new"]) + 1, F.length(t))))
    return paragraphs.join(ordered, "para_id", "left").select("para_id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(undo).alias("text"))
