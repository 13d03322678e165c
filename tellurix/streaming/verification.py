"""Transformations that run on a stream and on a table alike; on a stream they drop what comes later than `late`."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tellurix.functions.scores import deterministic_columns


def timed(df: DataFrame, column: str, late: str) -> DataFrame:
    """`df` with a watermark. Times without zone are taken in the session's zone, as watermarks need a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def scores_by_window(pairs: DataFrame, time: str, length: str, step: str | None = None, by: Sequence[str] = (), late: str = "10 minutes") -> DataFrame:
    """Scores of `f` and `o` in tumbling windows, or sliding ones with a step."""
    w = F.window(time, length, step) if step else F.window(time, length)
    out = timed(pairs, time, late).groupBy(w, *by).agg(*deterministic_columns(F.col("f") - F.col("o"), digits=9))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "bias", "mae", "rmse", "r")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events without a pause of `gap`: their start, end and number."""
    w = F.session_window(time, gap)
    out = timed(events, time, late).groupBy(w, key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key that comes within the watermark's delay. For streams only."""
    return timed(events, time, late).dropDuplicatesWithinWatermark(list(keys))


def matched(forecasts: DataFrame, observations: DataFrame, key: str, seconds: int, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Forecasts (key, ft, f) with the observations (key, ot, o) of the `seconds` after them; with `how` left_outer also those
    that have none, once the watermark has passed their time. Both watermarks and the bound on the times let Spark forget
    old rows of either side."""
    a, b = timed(forecasts, "ft", late).alias("a"), timed(observations, "ot", late).alias("b")
    near = (F.col("b.ot") >= F.col("a.ft")) & (F.col("b.ot") <= F.col("a.ft") + F.expr(f"interval {seconds} seconds"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near, how).select(f"a.{key}", "ft", "ot", "f", "o")


class LastValue(StatefulProcessor):
    """Keeps each key's last value, and emits a forecast (that) and an observation (the new one) for each later row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        before = self.last.get()[0] if self.last.exists() else None
        for part in (p.sort_values(["ts", "event_id"]) for p in rows):
            f = part["value"].shift()
            f.iloc[0] = before
            before = float(part["value"].iloc[-1])
            out = pd.DataFrame({"user_id": key[0], "event_id": part["event_id"], "f": f.astype("float64"), "o": part["value"]})
            yield out.dropna(subset=["f"])
        if before is not None:
            self.last.update((before,))

    def close(self) -> None:
        pass


def running_persistence(events: DataFrame) -> DataFrame:
    """Persistence pairs of a stream of (event_id, ts, user_id, value): state is one number for each user."""
    rows = events.select("event_id", "ts", "user_id", "value").groupBy("user_id")
    return rows.transformWithStateInPandas(LastValue(), "user_id long, event_id long, f double, o double", "append", "none")


class TimedSessions(StatefulProcessor):
    """Keeps the open sessions of a block of keys, and one timer, for the first of them to end. A session is a run of times
    with pauses of less than the gap. When the watermark has passed the last time of one by the gap, the timer emits and
    forgets all that have ended by then, and is set anew for the first of the others. So what a call costs besides
    its rows is for a block, and not for each key or session."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "key array<string>, start array<long>, last array<long>, n array<long>")

    def held(self) -> pd.DataFrame:
        key, *numbers = self.open.get() if self.open.exists() else [[]] * 4
        columns = zip(("start", "last", "n"), numbers, strict=True)
        return pd.DataFrame({"key": pd.Series(key, dtype=object)} | {c: np.array(v, np.int64) for c, v in columns})

    def hold(self, runs: pd.DataFrame) -> None:
        if runs.empty:
            self.open.clear()
            return
        self.open.update(tuple(runs[c].tolist() for c in ("key", "start", "last", "n")))
        self.handle.registerTimer(-(-(int(runs["last"].min()) + self.gap) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        new = pd.concat([p[["of", "micros"]] for p in rows])
        times = new["micros"].to_numpy().astype(np.int64)
        runs = pd.concat([pd.DataFrame({"key": new["of"].astype(object), "start": times, "last": times, "n": 1}), self.held()], ignore_index=True)
        runs["code"] = pd.factorize(runs["key"], use_na_sentinel=False)[0]
        runs = runs.sort_values(["code", "start"], ignore_index=True)
        code, reached = runs["code"].to_numpy(), runs.groupby("code")["last"].cummax().to_numpy()
        fresh = np.append(True, (code[1:] != code[:-1]) | (runs["start"].to_numpy()[1:] >= reached[:-1] + self.gap))
        at = np.flatnonzero(fresh)
        last, n = np.maximum.reduceat(runs["last"].to_numpy(), at), np.add.reduceat(runs["n"].to_numpy(), at)
        self.hold(runs.loc[at, ["key", "start"]].assign(last=last, n=n))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs = self.held()
        over = runs["last"] + self.gap <= timerValues.getCurrentWatermarkInMs() * 1000
        if not runs.empty:
            self.hold(runs[~over])
        if over.any():
            yield runs[over]

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, time: str, gap_seconds: int, key: str, late: str = "10 minutes", blocks: int | None = None) -> DataFrame:
    """`key, start, last, n` of each closed session; times in microseconds. State is the open sessions of each key, or, with
    `blocks`, of all keys whose hash falls into one of so many blocks; in whole numbers, however many events they have.
    Spark's state protocol needs protobuf, and the RocksDB state store."""
    rows = timed(events, time, late).select(F.col(key).cast("string").alias("of"), F.unix_micros(time).alias("micros"), time)
    by = F.pmod(F.xxhash64("of"), F.lit(blocks)) if blocks else F.col("of")
    return rows.withColumn("key", by).groupBy("key").transformWithStateInPandas(TimedSessions(gap_seconds), "key string, start long, last long, n long", "append", "EventTime")
