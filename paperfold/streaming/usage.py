"""Usage log stream, late rows, token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def first_per_request(log: DataFrame, delay: str = "1 hour", event_time: str = "ts") -> DataFrame:
    """One row per request_id, the first to arrive; state expires with the watermark."""
    return log.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["request_id"])


def usage_sink(log: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        log.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )


def split_late(df: DataFrame, event_time: str, arrival: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(on time, late): late rows arrived more than ``delay`` after their event time."""
    late = F.col(arrival) > F.col(event_time) + F.expr(f"interval {delay}")
    return df.filter(~late), df.filter(late)


def late_side_sink(stream: DataFrame, event_time: str, arrival: str, delay: str,
                   main_path: str, late_path: str, checkpoint: str) -> DataStreamWriter:
    """Late rows go to a side table instead of being dropped unseen."""

    def run(batch: DataFrame, batch_id: int) -> None:
        good, late = split_late(batch, event_time, arrival, delay)
        good.write.mode("overwrite").parquet(f"{main_path}/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def combined_usage(*parts: Column) -> Column:
    """Sum of optional counts: all missing stays missing, else missing counts as 0."""
    filled = [F.coalesce(p, F.lit(0)) for p in parts]
    total = filled[0]
    for p in filled[1:]:
        total = total + p
    return F.when(F.coalesce(*parts).isNotNull(), total)


def usage_totals(log: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """Token totals per group; sum() has the same missing-value rule."""
    return log.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])
