"""Live refreshes as streams: what is new, and the rolling window as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.window import TAIL, VISIBLE
from ..plans.segments import fetch_key

#: Keys are dealt into so many groups, each a call of Python and a value of the state for all of its keys.
GROUPS = 1024
WINDOW = "track_id long, arrival long, seq long, dur double, start_ms long, discontinuity boolean, published long, retained int"


def fresh_segments(refreshes: DataFrame, patterns: list[str] | None = None, horizon: str | None = None, time: str = "ts") -> DataFrame:
    """Segments (URL and byte range) not seen before in their stream, ads left out.

    The ad filter looks at the URL alone, so it goes before the dedupe and keeps
    state small. Without ``horizon`` every key is remembered; with it, only keys
    of the last such while of event time.
    """
    rows = refreshes.withColumn("_piece", fetch_key()) if "range" in refreshes.columns else refreshes.withColumn("_piece", refreshes["url"])
    for p in patterns or []:
        rows = rows.filter(~rows["url"].rlike(p))
    if horizon:
        return rows.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["stream_id", "_piece"]).drop("_piece")
    return rows.dropDuplicates(["stream_id", "_piece"]).drop("_piece")


def _take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A batch's rows of a group of tracks; the state holds their number, start and longest duration by track."""
    known = pickle.loads(state.get[0]) if state.exists else {}
    new = pd.concat(frames).sort_values(["nameless", "track_id", "arrival"], kind="stable", ignore_index=True)
    nameless, track = new["nameless"].to_numpy(), new["track_id"].to_numpy()
    borders = np.flatnonzero(np.concatenate([[True], (nameless[1:] != nameless[:-1]) | (track[1:] != track[:-1])]))
    sizes = np.diff(np.append(borders, len(new)))
    lasts = borders + sizes - 1
    keys = [None if none else t for none, t in zip(nameless[borders].tolist(), track[borders].tolist(), strict=True)]
    at, starts, longest = (np.array(c) for c in zip(*(known.get(k, (0, 0, 0.0)) for k in keys), strict=True))
    told = new["duration"].fillna(0.0).clip(lower=0.0).to_numpy(np.float64, copy=True)
    told[borders[(longest == 0) & (told[borders] == 0)]] = 2.0
    of = pd.Series(np.repeat(np.arange(len(keys)), sizes))
    reach = np.maximum(pd.Series(told).groupby(of).cummax().to_numpy(), np.repeat(longest, sizes))
    before = np.concatenate([[0.0], reach[:-1]])
    before[borders] = longest
    dur = np.where(told > 0, told, before)
    ms = (dur * 1000 + 0.5).astype(np.int64)
    ends = pd.Series(ms).groupby(of).cumsum().to_numpy() + np.repeat(starts, sizes)
    seqs = np.arange(len(new)) + np.repeat(at - borders, sizes)
    known.update(zip(keys, zip((seqs[lasts] + 1).tolist(), ends[lasts].tolist(), reach[lasts].tolist(), strict=True), strict=True))
    state.update((pickle.dumps(known),))
    ids = pd.array(track, dtype="Int64")
    ids[nameless] = None
    columns = (ids, new["arrival"].to_numpy(), seqs, dur, ends - ms, new["discontinuity"].to_numpy(), seqs + 1, np.minimum(seqs + 1, VISIBLE + TAIL))
    yield pd.DataFrame(dict(zip((c.split()[0] for c in WINDOW.split(", ")), columns, strict=True)))


def live_window(arrivals: DataFrame) -> DataFrame:
    """Each new segment of a track with its number, start and the track's count so far (see WINDOW).

    State per track is three numbers, kept by groups of tracks. A batch's rows come in any order and are
    sorted by ``arrival`` first. ``retained`` is how many segments can be fetched
    once the row is in.
    """

    track = F.col("track_id")
    keyed = arrivals.select(F.coalesce(track, F.lit(0)).cast("long").alias("track_id"), track.isNull().alias("nameless"), "arrival", "duration", "discontinuity")
    keyed = keyed.withColumn("_group", F.pmod(F.xxhash64("track_id"), F.lit(GROUPS))).groupBy("_group")
    return keyed.applyInPandasWithState(_take, WINDOW, "tracks binary", "append", GroupStateTimeout.NoTimeout)
