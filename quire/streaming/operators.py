"""Streams of progress, usage and lookup events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A log from its start and then its tail: what was written before a reader came is read first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def usage(events: DataFrame, ts: str, window: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per window and keys; rows later than `late` are left out, so state stays bounded."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def once(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first of equal requests within the watermark; later ones are answered by it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def throttle(events: DataFrame, key: str = "layer", ts: str = "ts", done: str = "final", every: float = 0.25, forget: str = "1 hour") -> DataFrame:
    """At most one event per key and `every` seconds of event time; final events always pass. Columns: key, ts, final.

    State is the time of the last event passed, which is dropped when the watermark is `forget` beyond it.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        keep = []
        for t, final in zip(rows[ts], rows[done]):
            at = t.timestamp()
            ok = bool(final) or last is None or at - last >= every
            last = at if ok else last
            keep.append(ok)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 3_600_000)
        yield rows.loc[keep, [key, ts, done]]

    return events.withWatermark(ts, forget).select(key, ts, done).groupBy(key).applyInPandasWithState(run, f"{key} string, {ts} timestamp, {done} boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def breaker(calls: DataFrame, key: str = "source", ts: str = "ts", ok: str = "ok", failures: int = 3, cooldown: float = 60.0, late: str = "1 hour") -> DataFrame:
    """Each call with whether it is let through: after `failures` in a row a source rests for `cooldown` seconds.

    State is the run of failures and the time until which the source rests.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bad, until = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        let = []
        for t, good in zip(rows[ts], rows[ok]):
            at = t.timestamp()
            through = at >= until
            let.append(through)
            if through:
                bad = 0 if good else bad + 1
                if bad >= failures:
                    bad, until = 0, at + cooldown
        state.update((bad, until))
        state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 3_600_000)
        yield rows.assign(let_through=let)[[key, ts, ok, "let_through"]]

    return calls.withWatermark(ts, late).select(key, ts, ok).groupBy(key).applyInPandasWithState(run, f"{key} string, {ts} timestamp, {ok} boolean, let_through boolean", "bad long, until double", "append", GroupStateTimeout.EventTimeTimeout)


def judge_as_they_land(checks: DataFrame, claims: DataFrame, judge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger):
    """Joins each batch of finished checks with the static claims and appends what judge makes of the pairs.

    A batch that is run again after a failure overwrites its own folder, so no pair is judged twice in the result.
    """

    def each(batch: DataFrame, number: int) -> None:
        judge(batch.dropDuplicates(["ref_id"]).join(claims, "ref_id")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return checks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
