"""Queries that run as streams; each runs over what is there and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans.registry import query
from tidewell.sources.adapter import with_views
from tidewell.streaming import live


@query(with_views("SELECT device, channel::BIGINT AS channel, ts_ms, seq, energy::DOUBLE AS energy FROM (SELECT *, lag(energy) OVER w AS prev, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY device, channel ORDER BY ts_ms, seq)) WHERE n = 1 OR prev IS DISTINCT FROM energy"))
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change detection with clamped times as a stream."""
    return live.collected(live.changes(live.readings(spark, sf)), "changes")


@query(with_views("SELECT * FROM (SELECT device, channel, ts_ms // 1800000 * 1800000 AS start_ms, count(*) AS n, max(energy) AS top FROM r GROUP BY ALL) WHERE start_ms + 1800000 <= (SELECT max(ts_ms) FROM r) - 3600000"))
def stream_half_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Half-hour folding; windows that the watermark has passed."""
    return live.collected(live.folded(live.readings(spark, sf)), "half-hours")


@query()
def stream_presence(spark: SparkSession, sf: str) -> DataFrame:
    """The temporal filter and its confirmation delay (M1, M4); tests hold it against a loop and hand-made rows. One quiet level stands for all gates; `room_evidence` combines gates (M2)."""
    return live.collected(live.presence(live.readings(spark, sf)), "presence")
