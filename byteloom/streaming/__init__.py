"""Byte streams as they arrive: counts and runs that survive the borders of micro-batches, generation logs, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def stream_digrams(chunks: DataFrame) -> DataFrame:
    """(stream_id, a, b, n) per micro-batch from streamed rows (stream_id, pos, v), in order of pos within a batch; the state is the last byte of each stream.

    Sums of n over all batches are the counts of the whole stream."""
    import pandas as pd

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("pos")
        last, due = state.get if state.exists else (None, int(rows.pos.iloc[0]))
        _follows(key, rows.pos, due)
        v = ([] if last is None else [last]) + rows.v.tolist()
        state.update((v[-1], due + len(rows)))
        counts = pd.Series(list(zip(v, v[1:])), dtype=object).value_counts()
        yield pd.DataFrame([(key[0], a, b, int(n)) for (a, b), n in counts.items()], columns=["stream_id", "a", "b", "n"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, a int, b int, n long", "last int, due long", "append", GroupStateTimeout.NoTimeout)


def _follows(key, pos, due: int) -> None:
    """Positions must go on where the batch before ended: a late or missing byte would make pairs that the stream hasn't."""
    if not (pos.to_numpy() == due + np.arange(len(pos))).all():
        raise ValueError(f"stream {key[0]}: bytes from position {due} on are late, missing or repeated")


def stream_runs(chunks: DataFrame) -> DataFrame:
    """(stream_id, st, start, len): arithmetic runs of four bytes and more, emitted once they end. The state is the open run: its first position, length, step and last byte.
    A row whose v is null ends its stream: the open run is emitted and the state forgotten."""
    import pandas as pd

    def run(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("pos")
        start, n, st, last = state.get if state.exists else (0, 0, -1, 0)
        out = []
        for pos, v in zip(rows.pos.tolist(), rows.v.tolist()):
            if v != v:  # null: the end
                if n >= 4:
                    out.append((key[0], st, start, n))
                start, n, st, last = 0, 0, -1, 0
                continue
            v = int(v)
            step = (v - last) & 255
            if n == 0 or n == 1 or step == st:
                start, st = (pos, -1) if n == 0 else (start, step)
                n += 1
            else:
                if n >= 4:
                    out.append((key[0], st, start, n))
                start, n, st = pos, 1, -1
            last = v
        state.update((int(start), int(n), int(st), int(last)))
        yield pd.DataFrame(out, columns=["stream_id", "st", "start", "len"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, st int, start long, len long", "start long, n long, st int, last int", "append", GroupStateTimeout.NoTimeout)


def stream_window(chunks: DataFrame, capacity: int) -> DataFrame:
    """(stream_id, bytes_held, payload) after each micro-batch: the last `capacity` bytes of each stream."""
    import pandas as pd

    def run(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("pos")
        held = ((state.get[0] if state.exists else b"") + bytes(rows.v.tolist()))[-capacity:]
        state.update((held,))
        yield pd.DataFrame([(key[0], len(held), held)], columns=["stream_id", "bytes_held", "payload"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, bytes_held long, payload binary", "held binary", "append", GroupStateTimeout.NoTimeout)


def session_statistics(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, n): sessions of a user's events that are less than the gap apart; for batch and for streams."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def daily_statistics(events: DataFrame, late: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Per window of event time and type: events, distinct bytes (about), mean byte; for batch and for streams, where rows later than the watermark are dropped."""
    v = F.floor("value").cast("long").bitwiseAND(255)
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct(v).alias("distinct_bytes"), F.avg(v).alias("mean_byte")).select(F.col("window.start").alias("start"), "event_type", "n", "distinct_bytes", "mean_byte")


def log_generations(history: DataFrame, csv_path: str, json_path: str):
    """A foreachBatch sink that appends generation rows as lines of CSV and of JSON, numbers of six decimals; no row is dropped, as a batch waits for its sink."""
    from byteloom.operators.evolve import log_lines

    def write(batch: DataFrame, _epoch: int) -> None:
        lines = log_lines(batch)
        lines.select("csv").write.mode("append").text(csv_path)
        lines.select("json").write.mode("append").text(json_path)

    return history.writeStream.foreachBatch(write)
