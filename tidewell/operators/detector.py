"""The detector: any gate above its threshold, held, then filtered by on and off delays; all candidates in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv
from tidewell.operators import spans as sp
from tidewell.operators.intervals import E, S


def segments(vectors: DataFrame, gates: list[str]) -> DataFrame:
    """Rows in which every gate is read, with the segment of contiguous coverage they are in: seg, seg_end."""
    line = Window.partitionBy("device").orderBy(S, E)
    rows = vectors.where(sp.all_known(gates)).withColumn("_new", F.when(F.lag(E).over(line) == F.col(S), 0).otherwise(1))
    rows = rows.withColumn("seg", F.sum("_new").over(line)).drop("_new")
    return rows.withColumn("seg_end", F.max(E).over(Window.partitionBy("device", "seg")))


KEYS = ["device", "pattern", "seg"]


def hits(covered: DataFrame, patterns: DataFrame, gates: list[str]) -> DataFrame:
    """(device, pattern, seg, seg_end, start_ms, end_ms): islands of detection for every pattern; patterns are a small dimension."""
    rows = covered.crossJoin(F.broadcast(patterns))
    rows = rows.where(sp.any_above(gates, [F.element_at("thresholds", k + 1) for k in range(len(gates))]))
    runs = iv.coalesce(rows.select(*KEYS, "seg_end", S, E), [*KEYS, "seg_end"])
    return runs


def with_hold(found: DataFrame, hold_ms: int) -> DataFrame:
    """Detections that each last for the hold longer, merged; never beyond the segment."""
    merged = iv.held(found, KEYS, hold_ms, ["seg_end"])
    return merged.withColumn(E, F.least(F.col(E) + hold_ms, F.col("seg_end")))


def with_delays(held: DataFrame, on_ms: int, off_ms: int) -> DataFrame:
    """On and off delay in closed form: intervals chain while they begin by the off delay after the last end; a chain is active from the on
    delay into its first interval that lasts as long, until the off delay after its end, in its segment.
    """
    line = Window.partitionBy(*KEYS).orderBy(S, E)
    reach = F.max(F.col(E) + off_ms).over(line.rowsBetween(Window.unboundedPreceding, -1))
    chains = held.withColumn("_new", F.when(F.col(S) <= reach, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(line))
    long_ = F.col(E) - F.col(S) >= on_ms
    out = chains.groupBy(*KEYS, "seg_end", "_chain").agg(F.min(F.when(long_, F.col(S))).alias("_from"), F.max(E).alias("_to"))
    out = out.where("_from is not null").select(*KEYS, "seg_end", (F.col("_from") + on_ms).alias(S), F.least(F.col("_to") + off_ms, F.col("seg_end")).alias(E))
    return out.where(F.col(E) > F.col(S))


def activations(vectors: DataFrame, patterns: DataFrame, gates: list[str], hold_ms: int, on_ms: int, off_ms: int) -> DataFrame:
    return with_delays(with_hold(hits(segments(vectors, gates), patterns, gates), hold_ms), on_ms, off_ms)
