"""Energies of signals that arrive as a stream.

The trapezoid between two samples needs the sample before, so a keyed state holds the last one of each signal, and those that
have come but may still be preceded by late ones: a sample counts once the watermark has passed it. Samples that come after
the watermark has passed their time are dropped. A signal that is silent for longer than the
state's time to live is forgotten, and its next sample starts anew. Intervals can then be summed in windows of event time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVALS = "record_id string, sig_id string, ts timestamp, dt double, e double"
STATE = "last_t double, last_v double, ts array<double>, vs array<double>"


def intervals(stream: DataFrame, late: str = "1 minute", forget_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """record_id, sig_id, ts, dt, e of a stream (record_id, sig_id, ts, v): each interval once the watermark has passed its end, in order of time.

    Of samples with equal times the first to come counts. late: how far behind the latest time a sample may come.
    """

    def step(key: tuple, rows: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_t, last_v, ts, vs = state.getOption or (None, None, [], [])
        waiting, passed = dict(zip(ts or [], vs or [], strict=True)), state.getCurrentWatermarkMs() / 1e3
        for own in rows:
            for t, v in zip(own["ts"].astype("datetime64[ns]").astype("int64").to_numpy() / 1e9, own["v"].to_numpy(float), strict=True):
                if t > passed and (last_t is None or t > last_t):
                    waiting.setdefault(float(t), float(v))
        ready, out = sorted(t for t in waiting if t <= passed), []
        for t in ready:
            v = waiting.pop(t)
            if last_t is not None:
                out.append((t, t - last_t, (t - last_t) * (v + last_v) / 2))
            last_t, last_v = t, v
        if state.hasTimedOut and not waiting:
            state.remove()
        else:
            state.update((last_t, last_v, sorted(waiting), [waiting[t] for t in sorted(waiting)]))
            # wake up when the watermark passes the next sample that waits, or to forget a silent signal
            state.setTimeoutTimestamp(max(int(min(waiting) * 1e3) + 1 if waiting else int(last_t * 1e3) + forget_ms, state.getCurrentWatermarkMs() + 1))
        found = pd.DataFrame(out, columns=["ts", "dt", "e"])
        yield pd.DataFrame({"record_id": key[0], "sig_id": key[1], "ts": pd.to_datetime(found["ts"], unit="s"), "dt": found["dt"].astype(float), "e": found["e"].astype(float)})

    own = stream.select(F.col("record_id").cast("string"), "sig_id", F.col("ts").cast("timestamp").alias("ts"), F.col("v").cast("double").alias("v"))
    own = own.withWatermark("ts", late).groupBy("record_id", "sig_id")
    return own.applyInPandasWithState(step, INTERVALS, STATE, "append", "EventTimeTimeout")


def windowed(stream: DataFrame, window: str, late: str) -> DataFrame:
    """record_id, sig_id, window, n, mean, v_max of a stream's samples in windows of event time."""
    own = stream.withWatermark("ts", late).groupBy("record_id", "sig_id", F.window("ts", window))
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("v_max"))
