"""Structured Streaming: windows with lateness, rolling buffers, alerts, live catalogues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def windowed_counts(events: DataFrame, time: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts in tumbling windows; a window closes once the watermark has passed it, later rows are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def running_statistics(events: DataFrame, value: str) -> DataFrame:
    return events.agg(F.count("*").alias("n"), F.max(value).alias("most"))


_BUFFER = "nslc string, tmin_us long, tmax_us long, n long"
_BUFFER_STATE = "tmin_us long, tmax_us long, n long"


def rolling_buffers(segments: DataFrame, max_length_us: int, max_gap_us: int, late: str = "20 seconds") -> DataFrame:
    """segments(nslc, ts, tmin_us, tmax_us): the buffer of each code after each batch.

    A gap of more than max_gap_us keeps only the newest piece; the buffer is cut
    to its last max_length_us; without data for a watermark's span it is dropped.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        a, b, n = state.get if state.exists else (None, None, 0)
        parts = pd.concat(list(frames)).sort_values(["tmin_us", "tmax_us"])
        for s, e in zip(parts.tmin_us, parts.tmax_us):
            s, e = int(s), int(e)
            if b is None or s - b > max_gap_us:
                a, b, n = s, e, 0
            else:
                a, b = min(a, s), max(b, e)
            a = max(a, b - max_length_us)
            n += 1
        state.update((a, b, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, b // 1000 + max_length_us // 1000))
        yield pd.DataFrame({"nslc": [key[0]], "tmin_us": [a], "tmax_us": [b], "n": [n]})

    return segments.withWatermark("ts", late).groupBy("nslc").applyInPandasWithState(update, _BUFFER, _BUFFER_STATE, "update", GroupStateTimeout.EventTimeTimeout)


_ALERT = "source string, seq long, time_us long, n long"
_ALERT_STATE = "seqs array<long>, waiting array<long>, times array<long>, above boolean"


def swarm_alerts(events: DataFrame, window_us: int, threshold: int, late: str = "0 seconds", cell_windows: int = 8) -> DataFrame:
    """events(source, seq, time_us): a row where the count of the last window_us first reaches the threshold (2 or more).

    Rows wait until the watermark has passed them and then count in order of
    time, so it doesn't matter in which batch a row comes; later ones are
    dropped. A source's time is cut into cells of several windows. A cell also
    sees the two windows before it, which is all that its first rows hang on,
    so cells are apart and their state goes once the watermark has passed them.
    """
    cell = cell_windows * window_us
    home = F.floor(F.col("time_us") / cell)
    e = events.withColumn("ts", F.timestamp_micros("time_us")).withWatermark("ts", late)
    e = e.withColumn("cell", F.explode(F.array_distinct(F.array(home, F.floor((F.col("time_us") + 2 * window_us) / cell)))))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, waiting, times, above = (list(x) if i < 3 else x for i, x in enumerate(state.get)) if state.exists else ([], [], [], False)
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            seqs, waiting = [*seqs, *rows.seq.tolist()], [*waiting, *rows.time_us.tolist()]
        passed = state.getCurrentWatermarkMs() * 1000
        out, later = [], []
        for t, seq in sorted(zip(waiting, seqs)):
            if t >= passed:
                later.append((t, seq))
                continue
            times = [x for x in times if x >= t - window_us] + [int(t)]
            now = len(times) >= threshold
            if now and not above and t // cell == key[1]:
                out.append((key[0], int(seq), int(t), len(times)))
            above = now
            times = times[-threshold:]  # no more are needed to tell
        end = (int(key[1]) + 1) * cell
        if not later and passed >= end:
            state.remove()
        else:
            state.update(([x for _, x in later], [x for x, _ in later], times, above))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (later[0][0] if later else end) // 1000 + 1))
        yield pd.DataFrame(out, columns=["source", "seq", "time_us", "n"]).astype({"seq": "int64", "time_us": "int64", "n": "int64"})

    return e.groupBy("source", "cell").applyInPandasWithState(update, _ALERT, _ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def last_state(rows: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What rows(batch, ...) of idempotent_writer hold in the end: all of an appending stream, the last batch of a complete one, the last row of each key of an updating one."""
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("_last"))
        return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("batch", "_last")  # one row
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("_last")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_last")
    same = F.col("batch") == F.col("_last")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(newest, same, "left_semi").drop("batch")


def backfilled(rows: DataFrame, key: str, start: str, end: str, received: str, rate: float = 2.0) -> DataFrame:
    """(key, fill_rate, backfill): span of data that came in over the span of time in which it came; above `rate` a source catches up."""
    g = rows.groupBy(key).agg(F.sum(F.col(end) - F.col(start)).alias("data"), (F.max(received) - F.min(received)).alias("taken"))
    fill = F.when(F.col("taken") > 0, F.col("data") / F.col("taken"))
    return g.select(key, F.round(fill, 6).alias("fill_rate"), F.coalesce(fill > rate, F.lit(False)).alias("backfill"))


def magnitude_alerts(events: DataFrame, magnitude: str, threshold: float) -> DataFrame:
    """Events of at least the threshold; one without magnitude never alerts."""
    return events.where(F.col(magnitude).isNotNull() & ~F.isnan(F.col(magnitude)) & (F.col(magnitude) >= threshold))


def resumed(events: DataFrame, time_us: str, last_end_us: int) -> DataFrame:
    """Events kept when a run goes on after last_end_us: later ones are searched again and would come twice."""
    return events.where(F.col(time_us) < last_end_us)


def latest(catalog: DataFrame, time: str, tie: str, n: int = 10_000) -> DataFrame:
    """What a live view shows: the newest n rows."""
    return catalog.orderBy(F.desc(time), F.desc(tie)).limit(n)


def stream_state(rows: DataFrame, key: str, start: str, end: str, now_us: int, timeout_us: int) -> DataFrame:
    """One row: least start and delay over the online sources, and how many are online."""
    g = rows.groupBy(key).agg(F.min(start).alias("s"), F.max(end).alias("e")).where(F.lit(now_us) - F.col("e") <= timeout_us)
    return g.agg(F.min("s").alias("start_us"), F.min(F.lit(now_us) - F.col("e")).alias("delay_us"), F.count("*").alias("n_online"))


def replay(segments: DataFrame, time_us: str, start_us: int, speed: float) -> DataFrame:
    """Adds due_us: when a player at a speed, begun at 0, hands out each segment."""
    return segments.withColumn("due_us", F.round((F.col(time_us) - start_us) / speed).cast("long"))


def progress(done_us: int, start_us: int, end_us: int, n_bytes: int, seconds: float) -> dict[str, float]:
    """Rates of a run: bytes a second, data time over time taken, percent done, seconds left."""
    part = min(1.0, max(0.0, (done_us - start_us) / max(end_us - start_us, 1)))
    speed = (done_us - start_us) / 1e6 / seconds if seconds > 0 else 0.0
    return {"bytes_per_s": n_bytes / seconds if seconds > 0 else 0.0, "speed": speed, "percent": 100 * part, "remaining_s": (end_us - done_us) / 1e6 / speed if speed > 0 else float("inf")}


def drive(out: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run what is there to its end, exactly once per batch id; called again it resumes after the last batch."""
    q = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def idempotent_writer(path: str, callbacks: list[Callable[[DataFrame, int], None]] | None = None, log: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch overwrites its own folder, so a repeated batch counts once; callbacks may fail without harm."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={epoch:09d}")
        for c in callbacks or []:
            try:
                c(df, epoch)
            except Exception as e:  # noqa: BLE001 - a listener never stops the stream
                log(f"callback failed: {e}")

    return write


def online(rows: DataFrame, key: str, time: str, now_us: int, timeout_us: int) -> DataFrame:
    """Per key: last time, lag, and whether it is within the timeout."""
    g = rows.groupBy(key).agg(F.max(time).alias("last_us"))
    return g.withColumn("lag_us", F.lit(now_us) - F.col("last_us")).withColumn("online", F.col("lag_us") <= timeout_us)
