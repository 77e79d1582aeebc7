"""Control rules and progress figures over time series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ticks of a channel that one row of a control rule's run holds.
BLOCK = 512

State = tuple[int, bool, int]  # limit, still in the doubling phase, ticks to hold


def _table(start: State, rule: Callable[..., State]) -> tuple[np.ndarray, np.ndarray]:
    """The limits of all states that ``rule`` reaches from ``start`` (state 0), and [kind of tick, state] -> next state.

    A tick's kind is 8 for errors plus 4, 2 and 1 for throughput that grows, rises and falls; kind 16 keeps the state.
    """
    states, place = [start], {start: 0}
    after = []
    for state in states:  # grows as it is walked
        follow = [rule(*state, *(bool(kind & bit) for bit in (8, 4, 2, 1))) for kind in range(16)]
        for found in follow:
            if found not in place:
                place[found] = len(states)
                states.append(found)
        after.append([*(place[x] for x in follow), place[state]])
    return np.array([s[0] for s in states], np.int32), np.array(after, np.int32).T.copy()


def _kinds(codes: pd.Series) -> np.ndarray:
    """A row of kinds for each block, short ones filled with 16."""
    sizes = codes.str.len().to_numpy()
    out = np.full((len(codes), int(sizes.max(initial=0))), 16, np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(codes).encode(), np.uint8) - ord("a")
    return out


def _run(ticks: DataFrame, start: State, rule: Callable[..., State], block: int) -> DataFrame:
    """channel, tick, limit: a rule over each channel's ticks in order (ticks that are equal go by bytes, then errors).

    The rule is a sequence, but has few states. So a channel is cut into blocks of
    ``block`` tick numbers that are worked on apart: each block but the last tells
    where every state leads, these are chained to the state each block starts in,
    and then all blocks run. One task sees a channel as a whole only as a few bytes a tick.
    """
    limits, after = _table(start, rule)

    @F.pandas_udf("array<int>")
    def leads(codes: pd.Series) -> pd.Series:
        kinds = _kinds(codes)
        states = np.tile(np.arange(len(limits), dtype=np.int32), (len(kinds), 1))
        for kind in kinds.T:
            states = after[kind[:, None], states]
        return pd.Series(list(states))

    @F.pandas_udf("array<int>")
    def steps(codes: pd.Series, first: pd.Series) -> pd.Series:
        kinds, state = _kinds(codes), first.to_numpy()
        out = np.empty(kinds.shape, np.int32)
        for i, kind in enumerate(kinds.T):
            state = after[kind, state]
            out[:, i] = limits[state]
        return pd.Series([row[:n] for row, n in zip(out, codes.str.len(), strict=True)])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        state, firsts = 0, []
        for row in table.column("leads").to_pylist():
            state = row[state]
            firsts.append(state)
        return pa.table({"channel": table.column("channel"), "block": table.column("next"), "first": pa.array(firsts, pa.int32())})

    entry = F.struct("tick", "bytes", "errs")
    rows = ticks.withColumn("block", F.floor(F.col("tick") / block).cast("long"))
    inner = Window.partitionBy("channel").orderBy("block")
    edges = rows.groupBy("channel", "block").agg(F.max_by("bytes", entry).alias("last"))
    edges = edges.select("channel", "block", F.lag("last", 1, 0.0).over(inner).alias("before"), F.lead("block").over(inner).alias("next"))
    series = rows.groupBy("channel", "block").agg(F.array_sort(F.collect_list(entry)).alias("s"))

    def same():
        return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("channel", "block")]

    def code(x: Column, prev: Column) -> Column:
        told = ((x["errs"] > 0, 8), (x["bytes"] > prev * 1.05, 4), (x["bytes"] > prev * 1.10, 2), (x["bytes"] < prev * 0.90, 1))
        number = sum((F.when(is_so, n).otherwise(0) for is_so, n in told), F.lit(1))
        return F.substr(F.lit("abcdefghijklmnop"), number, F.lit(1))

    earlier = F.concat(F.array("before"), F.transform(F.slice("s", 1, F.size("s") - 1), lambda x: x["bytes"]))
    joined = series.alias("a").join(edges.alias("b"), same()).select("a.channel", "a.block", "s", "before", "next")
    joined = joined.select("channel", "block", "s", "next", F.array_join(F.zip_with("s", earlier, code), "").alias("codes"))

    channel = ticks.schema["channel"].dataType.simpleString()
    led = joined.filter("next IS NOT NULL").select("channel", "block", "next", leads("codes").alias("leads"))
    firsts = led.groupBy("channel").applyInArrow(chain, f"channel {channel}, block long, first int")
    begun = joined.alias("a").join(firsts.alias("b"), same(), "left").select("a.channel", "s", "codes", F.coalesce("b.first", F.lit(0)).alias("first"))
    done = begun.select("channel", F.explode(F.arrays_zip(F.col("s.tick").alias("tick"), steps("codes", "first").alias("limit"))).alias("x"))
    return done.select("channel", "x.tick", "x.limit")


def _eighth(limit: int) -> int:
    return max(1, limit // 8)


def adaptive_limit(ticks: DataFrame, start: int = 16, least: int = 4, most: int = 64, block: int = BLOCK) -> DataFrame:
    """channel, tick, limit: the concurrency limit after each tick (channel, tick, bytes, errs).

    Errors halve it and hold it for two ticks. At first it doubles while
    throughput grows by over 5 %; later it moves by an eighth when throughput
    changes by over 10 %. Throughput that is null neither grows nor falls.
    """

    def rule(limit: int, doubling: bool, hold: int, errors: bool, grows: bool, rises: bool, falls: bool) -> State:
        if errors:
            return max(least, limit // 2), False, 2
        if hold:
            return limit, doubling, hold - 1
        if doubling:
            return (min(most, limit * 2) if grows else limit), grows, 0
        return (min(most, limit + _eighth(limit)) if rises else max(least, limit - _eighth(limit)) if falls else limit), False, 0

    return _run(ticks, (start, True, 0), rule, block)


def fixed_limit(ticks: DataFrame, most: int = 32, least: int = 4, block: int = BLOCK) -> DataFrame:
    """The rule for a limit the user set: halve on errors, hold two ticks, climb back by eighths."""

    def rule(limit: int, doubling: bool, hold: int, errors: bool, *_: bool) -> State:
        if errors:
            return max(least, limit // 2), False, 2
        if hold:
            return limit, False, hold - 1
        return (min(most, limit + _eighth(limit)) if limit < most else limit), False, 0

    return _run(ticks, (most, False, 0), rule, block)


def speed(samples: DataFrame, seconds: int = 5) -> DataFrame:
    """Samples (channel, t_ms, total_bytes) with bytes per second against the oldest sample of the last ``seconds``; 0 under 0.1 s."""
    near = Window.partitionBy("channel").orderBy("t_ms").rangeBetween(-seconds * 1000, Window.currentRow)
    dt = (F.col("t_ms") - F.min("t_ms").over(near)) / 1000.0
    moved = F.col("total_bytes") - F.first("total_bytes").over(near)
    return samples.withColumn("speed", F.when(dt < 0.1, F.lit(0.0)).otherwise(F.try_divide(moved, dt)))


def progress(counts: DataFrame) -> DataFrame:
    """Counts (done, total, bytes, speed) with percent and the seconds left, ``?`` where they can't be told."""
    eta = F.try_divide(F.try_divide(F.col("bytes"), F.col("done")) * (F.col("total") - F.col("done")), F.col("speed"))
    told = (F.col("speed") > 1) & (F.col("total") > F.col("done")) & (F.col("done") > 8) & (eta < 360_000)
    percent = F.when(F.col("total") > 0, F.floor(F.col("done") * 100 / F.col("total")).cast("bigint")).otherwise(F.lit(0))
    return counts.withColumns({"percent": percent.cast("long"), "eta": F.when(told, F.floor(eta).cast("bigint").cast("string")).otherwise(F.lit("?"))})


def size_text(n: Column) -> Column:
    """Bytes as a progress line tells them."""
    x = n.cast("double")
    of = lambda unit, digits: F.bround(x / unit, digits)
    return (
        F.when(x >= 1 << 30, F.format_string("%.2fGiB", of(1 << 30, 2)))
        .when(x >= 1 << 20, F.format_string("%.1fMiB", of(1 << 20, 1)))
        .when(x >= 1 << 10, F.format_string("%.0fKiB", of(1 << 10, 0)))
        .otherwise(F.format_string("%dB", n.cast("long")))
    )


def seconds_text(seconds: Column) -> Column:
    """Whole seconds as ``1h2m3s``, without leading parts that are none."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60
    return F.concat(F.when(h > 0, F.format_string("%dh", h)).otherwise(F.lit("")), F.when((h > 0) | (m > 0), F.format_string("%dm", m)).otherwise(F.lit("")), F.format_string("%ds", s % 60))


def progress_text(counts: DataFrame) -> DataFrame:
    """Counts (done, total, bytes, speed, live, elapsed_s) with ``line``: of live streams how long and how much, of others also how far and how long still."""
    share = F.coalesce(F.try_divide(F.col("done"), F.col("total")), F.lit(0.0)) * 100
    eta = F.try_divide(F.try_divide(F.col("bytes").cast("double"), F.col("done").cast("double")) * (F.col("total") - F.col("done")).cast("double"), F.col("speed"))
    told = (F.col("speed") > 1) & (F.col("total") > F.col("done")) & (F.col("done") > 8) & (eta < 360_000)
    left = F.when(told, seconds_text(F.floor(eta))).otherwise(F.lit("?"))
    moved = [size_text(F.col("bytes")), F.lit(" | "), size_text(F.floor("speed")), F.lit("/s")]
    live = F.concat(F.lit("REC "), seconds_text(F.floor(F.col("elapsed_s") + 0.5)), F.lit(" | "), F.col("done").cast("string"), F.lit(" segs | "), *moved)
    vod = F.concat(F.format_string("%5.1f%%", F.bround(share, 1)), F.lit(" | "), F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" segs | "), *moved, F.lit(" | ETA "), left)
    return counts.withColumn("line", F.when(F.col("live"), live).otherwise(vod))
