"""Streams of raw lines and of dated pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parse_lines import parse_lines


def quarantine_stream(lines: DataFrame, sound_path: str, failed_path: str, checkpoint: str, text: str = "raw_text"):
    """Start a query that appends sound rows to one table and failing rows with reasons to another.

    Parsing is a projection, so the batch operator runs on the stream as it is; each micro-batch is
    parsed once and written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.persist()
        parsed.where("fail_reason is null").drop("fail_reason", "n_fields", "corrupt_text").write.mode("append").parquet(sound_path)
        parsed.where("fail_reason is not null").select(*lines.columns, "fail_reason").write.mode("append").parquet(failed_path)
        parsed.unpersist()

    return parse_lines(lines, text).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per key and tumbling window, late rows accepted for ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n"
    )


def pair_history_stream(pairs: DataFrame) -> DataFrame:
    """``pair_id``, ``application_date``, ``n``, ``historical_pair_count`` from a stream of dated pairs.

    The state of a pair is its count up to the last date seen; rows of one date see the count before
    that date only. Dates must not arrive out of order across micro-batches; an earlier date than the
    last one seen counts as that one.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, last, today = state.get if state.exists else (0, None, 0)
        # counted frame by frame: a pair with many rows is never held as rows
        rows: Counter = Counter()
        for frame in frames:
            rows.update(frame["application_date"].value_counts().to_dict())
        out = []
        for date, n in sorted(rows.items()):
            day = str(date)
            if last is None or day > last:
                before, last, today = before + today, day, 0
            today += int(n)
            out.append((key[0], date, int(n), before))
        state.update((before, last, today))
        yield pd.DataFrame(out, columns=["pair_id", "application_date", "n", "historical_pair_count"])

    return pairs.groupBy("pair_id").applyInPandasWithState(
        step, "pair_id string, application_date date, n bigint, historical_pair_count bigint", "before bigint, last string, today bigint", "append", "NoTimeout"
    )
