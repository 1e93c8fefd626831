"""Alert sessions on a stream: one row per customer and closed session."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.plans.alerts import DEDUP_WINDOW_MINUTES


def alert_sessions(alerts: DataFrame, late: str = "1 day", gap_minutes: int = DEDUP_WINDOW_MINUTES) -> DataFrame:
    """A gap of exactly the window still joins; a session appears once the watermark closes it.

    Spark merges sessions inside each task before the shuffle when
    spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition is on.
    """
    window = F.session_window("created_at", f"{gap_minutes} minutes")
    return (
        alerts.withWatermark("created_at", late).groupBy("customer_id", window)
        .agg(F.count("*").alias("alerts"), F.max("combined_score").alias("top_score"),
             F.sum("financial_exposure").alias("exposure"), F.min("created_at").alias("first_at"),
             F.max("created_at").alias("last_at"))
        .drop("session_window")
    )
