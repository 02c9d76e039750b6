"""Keyed state over event streams, each with its twin for tables: job states, circuit breakers, exact sliding limits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BREAKER = "key string, ts timestamp, state string, failures long"
BREAKER_STATE = "mode string, failures long, changed double"
LIMIT = "key string, ts timestamp, n long, allowed boolean"


def job_states(event: DataFrame) -> DataFrame:
    """The last state of each job, its number of attempts and of failures. The same code serves tables and streams (output mode update)."""
    return event.groupBy("job_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"),
        F.count_if(F.col("state") == "processing").alias("attempts"),
        F.count_if(F.col("state") == "failed").alias("failures"),
        F.max("ts").alias("changed_at"),
    )


def breaker_step(mode: str, failures: int, changed: float, at: float, ok: bool, threshold: int, wait: float, resets: bool = False) -> tuple[str, int, float]:
    """closed, open after ``threshold`` failures, half_open ``wait`` seconds after the last; a success then closes, a failure opens. With
    ``resets`` a success while closed forgets the failures."""
    if mode == "open" and at - changed >= wait:
        mode = "half_open"
    if ok:
        return ("closed", 0, at) if mode == "half_open" else (mode, 0 if resets and mode == "closed" else failures, changed)
    failures += 1
    return ("open", failures, at) if mode == "half_open" or failures >= threshold else (mode, failures, changed)


#: Added to the failures of a breaker that is open when a span begins, while their number is not known.
_UNKNOWN = 1 << 40
#: Spans whose functions a task holds before it gives them on.
AT_ONCE = 10_000
_SPAN = "key string, span long, modes array<string>, failures array<long>, changes array<double>, calm double"


def span_function(events: list[tuple[float, bool]], threshold: int, wait: float, resets: bool) -> tuple[list[tuple[str, int, float]], float | None]:
    """What a span of events makes of any state: the states it ends in when it begins closed with 0, 1, ... failures, then when it begins open and is
    not closed before its first failure; and the time of the last success before that.

    An open breaker's failures count on, and its first failure in the span opens it anew, whether it was half open or not. So its beginning
    matters only in whether it was old enough to close at a success before that."""
    ends = [("closed", n, 0.0) for n in range(threshold)]
    still, calm = None, None
    for at, ok in events:
        ends = [breaker_step(*end, at, ok, threshold, wait, resets) for end in ends]
        if still is not None:
            still = breaker_step(*still, at, ok, threshold, wait, resets)
        elif ok:
            calm = at
        else:
            still = ("open", _UNKNOWN + 1, at)
    return [*ends, still or ("open", _UNKNOWN, -1.0)], calm


def after_span(held: tuple[str, int, float], ends: list[tuple[str, int, float]], calm: float | None, wait: float) -> tuple[str, int, float]:
    """A span's function applied to a state."""
    mode, failures, changed = held
    if mode == "closed":
        end = ends[failures]
        return (end[0], end[1], end[2] or changed) if end[0] == "closed" else end
    if calm is not None and calm - changed >= wait:
        return ends[0]
    mode, count, at = ends[-1]
    return (mode, count - _UNKNOWN + failures if count >= _UNKNOWN else count, changed if at == -1.0 else at)


def breaker_table(event: DataFrame, threshold: int = 5, wait: float = 30.0, span: str = "1 hour", resets: bool = False) -> DataFrame:
    """State after each event (key, ts, ok, event_id) of a table.

    A key's time is cut into spans. Each becomes a function from state to state, wherever its events are; a key's functions are then applied one
    after the other, which gives the state at each span's begin; and from there each span's events are walked through. So a key with any share of
    all events is spread over as many tasks as it has spans. Rows without key or time go; equal times go by event_id.
    """

    def groups(batches: Iterable[pd.DataFrame], more: list[str]) -> Iterator[tuple[tuple, list]]:
        last, held = None, []
        for rows in batches:
            for row in rows[["key", "span", *more]].itertuples(index=False, name=None):
                if held and row[:2] != last:
                    yield last, held
                    held = []
                last = row[:2]
                held.append(row[2:])
        if held:
            yield last, held

    def functions(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for (key, number), events in groups(batches, ["ms", "ok"]):
            ends, calm = span_function([(ms / 1000, bool(ok)) for ms, ok in events], threshold, wait, resets)
            found.append((key, number, *map(list, zip(*ends, strict=True)), calm))
            if len(found) >= AT_ONCE:
                yield pd.DataFrame(found, columns=["key", "span", "modes", "failures", "changes", "calm"])
                found = []
        yield pd.DataFrame(found, columns=["key", "span", "modes", "failures", "changes", "calm"])

    def begins(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, ("closed", 0, 0.0)
        for rows in batches:
            found = []
            for key, number, modes, failures, changes, calm in rows.itertuples(index=False, name=None):
                if key != now:
                    now, held = key, ("closed", 0, 0.0)
                found.append((key, number, *held))
                held = after_span(held, list(zip(modes, map(int, failures), changes, strict=True)), None if pd.isna(calm) else calm, wait)
            yield pd.DataFrame(found, columns=["key", "span", "mode", "had", "changed"])

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, ("closed", 0, 0.0)
        for rows in batches:
            states, failures = [], []
            for key, number, ms, ok, mode, had, changed in zip(*(rows[c] for c in ("key", "span", "ms", "ok", "mode", "had", "changed")), strict=True):
                if (key, number) != now:
                    now, held = (key, number), (mode, int(had), changed)
                held = breaker_step(*held, ms / 1000, bool(ok), threshold, wait, resets)
                states.append(held[0])
                failures.append(held[1])
            yield pd.DataFrame({"key": rows["key"], "ts": rows["ts"], "state": states, "failures": failures})

    rows = event.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "ok", "event_id").filter("key is not null and ts is not null")
    length = F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {span})")
    rows = rows.withColumn("ms", F.unix_millis("ts")).withColumn("span", F.floor(F.col("ms") / length))
    told = rows.repartition("key", "span").sortWithinPartitions("key", "span", "ts", "event_id").mapInPandas(functions, _SPAN)
    known = told.repartition("key").sortWithinPartitions("key", "span").mapInPandas(begins, "key string, span long, mode string, had long, changed double")
    ready = rows.join(known, ["key", "span"]).repartition("key", "span").sortWithinPartitions("key", "span", "ts", "event_id")
    return ready.mapInPandas(walk, BREAKER)


def breaker_stream(event: DataFrame, threshold: int = 5, wait: float = 30.0, late: str = "1 minute", resets: bool = False) -> DataFrame:
    """The same over a stream: one small state per key, dropped an hour of event time after its last event. Rows later than ``late`` are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else ("closed", 0, 0.0)
        last = 0
        rows = pd.concat(list(batches)).sort_values("ts")
        for at, ok in zip(rows["ts"], rows["ok"]):
            held = breaker_step(*held, at.timestamp(), bool(ok), threshold, wait, resets)
            last = max(last, int(at.timestamp() * 1000))
        state.update(held)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame({"key": [key[0]], "ts": [rows["ts"].iloc[-1]], "state": [held[0]], "failures": [held[1]]})

    rows = event.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "ok").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, BREAKER, BREAKER_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def rate_limit_stream(event: DataFrame, limit: int, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Exact sliding counts over (now - seconds, now]: a key's state holds the times of its last ``seconds`` only."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        counts = []
        for at in rows["ts"]:
            now = int(at.timestamp() * 1000)
            held = [t for t in held if t > now - seconds * 1000] + [now]
            counts.append(len(held))
        state.update((held,))
        state.setTimeoutTimestamp(max(held[-1], state.getCurrentWatermarkMs()) + seconds * 1000)
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "n": counts, "allowed": [n <= limit for n in counts]})

    rows = event.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(step, LIMIT, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def watch_folder(spark, path: str, pattern: str = "*.json", schema: str = "doc_id bigint, raw_text string") -> DataFrame:
    """New files of a folder as a stream; the source's log takes each path once. Producers rename whole files into place."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).json(path)


def route_done_error(batch: DataFrame, folder: str, number: int) -> None:
    """For ``foreachBatch``: good rows under done, failed ones with their error under error. A batch written again replaces itself."""
    good = F.col("error").isNull()
    batch.filter(good).drop("error").write.mode("overwrite").parquet(f"{folder}/done/batch={number}")
    batch.filter(~good).write.mode("overwrite").parquet(f"{folder}/error/batch={number}")
