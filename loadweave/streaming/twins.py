"""Structured Streaming counterparts of the batch operators on telemetry (ts, key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_load(events: DataFrame, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Tumbling hours: key, hour start, energy and rows."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), key).agg(F.sum("value").alias("kwh"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("hour"), "kwh", "n")


def sliding_week(events: DataFrame, key: str = "user_id", late: str = "1 day") -> DataFrame:
    """Seven days every day: mean, maximum and the count a caller needs for its minimum."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("w"), key).agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count("*").alias("n"))
    return out.select(key, F.col("w.end").alias("until"), "mean", "peak", "n")


def gap_sessions(events: DataFrame, key: str = "user_id", gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions divided by a gap; a gap of exactly that length stays inside."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return out.select(key, "start", "end", "n")


def usable_issues(issues: DataFrame, late: str = "1 day") -> DataFrame:
    """Forecast issues up to their cutoff (issued_at, cutoff): late ones never enter a feature."""
    return issues.withWatermark("issued_at", late).where("issued_at <= cutoff")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def transition_sessions(events: DataFrame, key: str, gap_minutes: float = 15.0, late: str = "1 hour") -> DataFrame:
    """Sessions that begin where charging turns on or after a gap, held as state per key.

    events: key, ts, charging.  Rows wait until the watermark has passed them, so those that
    come late within it still stand in their order.  A session is emitted once it is closed: by a
    row that doesn't charge, by a later start, or by the watermark passing its end by the gap;
    then nothing is held for the key any longer.
    """
    import pandas as pd

    gap, kind = int(gap_minutes * 60_000_000), dict(events.dtypes)[key]

    def step(found, frames, state):
        start, last, n, on, waiting, flags = state.get if state.exists else (0, 0, 0, False, [], [])
        rows = list(zip(waiting, flags, strict=True))
        for frame in frames:
            rows += zip((frame["ts"].astype("int64") // 1000).tolist(), frame["charging"].fillna(False).astype(bool).tolist(), strict=True)
        passed, done = state.getCurrentWatermarkMs() * 1000, []

        def close(end):
            done.append((found[0], pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n))

        rows.sort()
        ahead = [r for r in rows if r[0] > passed]
        for at, charging in rows[: len(rows) - len(ahead)]:
            if on and (not charging or at - last > gap):
                close(last)
                on = False
            if charging:
                start, n, on = (start, n + 1, True) if on else (at, 1, True)
                last = at
        if on and passed - last > gap:
            close(last)
            on = False
        if on or ahead:
            state.update((int(start), int(last), int(n), bool(on), [int(a) for a, _ in ahead], [bool(c) for _, c in ahead]))
            wake = min([a for a, _ in ahead[:1]] + ([last + gap] if on else []))
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(done, columns=[key, "start", "end", "n"])

    held = events.select(key, F.col("ts").cast("timestamp").alias("ts"), "charging").withWatermark("ts", late)
    return held.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start timestamp, end timestamp, n int", "start long, last long, n int, on boolean, waiting array<long>, flags array<boolean>", "append", "EventTimeTimeout")


def latest_issues(rows: DataFrame, issues: DataFrame, key: str, late: str = "1 hour", cutoff: str = "cutoff", issued: str = "issued_at", value: str = "value", row: str = "row") -> DataFrame:
    """For each row the value issued last at or before its cutoff, once the watermark has passed that cutoff (else NULL).

    rows: key, row (long), cutoff; issues: key, issued_at, value (double).  Both streams share one event time: a row waits as
    state of its key until no earlier issue can come any more, and of the issues that the watermark has passed a
    key keeps the last one alone.  Of issues at one time the larger value counts, as in the batch join.  Rows and
    issues that come later than the watermark allows are dropped.
    """
    import pandas as pd

    kind = dict(rows.dtypes)[key]
    asked = rows.select(key, F.col(cutoff).cast("timestamp").alias("at"), F.lit(True).alias("asks"), F.col(row).cast("long").alias("id"), F.lit(None).cast("double").alias("v"))
    told = issues.where(F.col(value).isNotNull()).select(key, F.col(issued).cast("timestamp").alias("at"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("id"), F.col(value).cast("double").alias("v"))

    def step(found, frames, state):
        known, last, last_value, times, ids, issue_times, values = state.get if state.exists else (False, 0, 0.0, [], [], [], [])
        waiting, told = list(zip(times, ids, strict=True)), list(zip(issue_times, values, strict=True))
        for frame in frames:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            asks = frame["asks"].to_numpy(bool)
            waiting += zip(at[asks].tolist(), frame["id"][asks].astype("int64").tolist(), strict=True)
            told += zip(at[~asks].tolist(), frame["v"][~asks].tolist(), strict=True)
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        waiting.sort()
        told.sort()
        begun = 0
        while waiting and waiting[0][0] <= passed:
            at, one = waiting.pop(0)
            while begun < len(told) and told[begun][0] <= at:
                known, (last, last_value) = True, told[begun]
                begun += 1
            out.append((found[0], one, last_value if known else None, pd.Timestamp(last, unit="us") if known else pd.NaT))
        # The last issue that the watermark has passed stands for all before it, but rows that still wait may be older than it.
        oldest = min([passed, *[at for at, _ in waiting[:1]]])
        while begun < len(told) and told[begun][0] <= oldest:
            known, (last, last_value) = True, told[begun]
            begun += 1
        told = told[begun:]
        state.update((bool(known), int(last), float(last_value), [int(a) for a, _ in waiting], [int(i) for _, i in waiting], [int(a) for a, _ in told], [float(v) for _, v in told]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, row, value, issued]).astype({row: "int64", value: "float64", issued: "datetime64[us]"})

    both = asked.unionByName(told).where(F.col("at").isNotNull() & F.col(key).isNotNull()).withWatermark("at", late)
    held = "known boolean, last long, last_value double, times array<long>, ids array<long>, issue_times array<long>, issue_values array<double>"
    out = both.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {row} long, {value} double, {issued} timestamp", held, "append", "EventTimeTimeout")
    return out.withColumn(value, F.when(~F.isnan(value), F.col(value)))
