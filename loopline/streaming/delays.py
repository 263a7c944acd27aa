"""Delay statistics over a stream of readings (an extension; the batch form is in operators.punctuality)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_delays(readings: DataFrame, late: str = "1 day", window: str = "1 day", by: str = "station_code") -> DataFrame:
    """Count, mean, maximum and share of late runs for each station and window of receipt.

    ``readings`` is a streaming or static DataFrame with ``received_at``, ``delay_id`` and the
    delay columns. A reading sent again with the same ``delay_id`` counts once within the
    watermark; readings later than ``late`` are dropped, which also bounds the state.
    """
    d = readings.withColumn("delay", F.coalesce("arrival_delay_minutes", "departure_delay_minutes")).where("delay is not null")
    d = d.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", late)
    once = d.dropDuplicatesWithinWatermark(["delay_id"]) if readings.isStreaming else d.dropDuplicates(["delay_id"])
    return once.groupBy(F.window("received_at", window), by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("delay").alias("mean"), F.max("delay").alias("worst"), F.avg((F.col("delay") > 15).cast("double")).alias("late_share")
    ).select(F.col("window.start").alias("window_start"), by, "n", "mean", "worst", "late_share")
