"""Streaming variants of sessions and bursts: watermark, deduplication and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import SESSION_GAP


def live_sessions(events: DataFrame, late: str = "1 hour", gap: int = SESSION_GAP) -> DataFrame:
    """wallet, started, n, duration of sessions of a stream (wallet, tx, at): late data is held for `late`, repeated
    transactions inside the watermark count once, a gap equal to the limit joins."""
    seen = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["wallet", "tx"])
    s = seen.groupBy("wallet", F.session_window("at", f"{gap} seconds")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    return s.select("wallet", F.unix_seconds("first").alias("started"), "n", (F.unix_seconds("last") - F.unix_seconds("first")).alias("duration"))
