"""From readings to spans: change detection, clamping, holds, vectors, sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.intervals import E, S


def changes(readings: DataFrame) -> DataFrame:
    """Readings whose energy differs from the one before on their channel; missing counts as a value of its own."""
    line = Window.partitionBy("device", "channel").orderBy("ts_ms", "seq")
    first = F.row_number().over(line) == 1
    differs = ~F.lag("energy").over(line).eqNullSafe(F.col("energy"))
    return readings.withColumn("_keep", first | differs).where("_keep").drop("_keep")


def clamped(readings: DataFrame, arrival: Column) -> DataFrame:
    """ts_ms is never before the latest one that arrived earlier."""
    line = Window.partitionBy("device").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    return readings.withColumn("clamped_ms", F.max("ts_ms").over(line))


def hold_spans(readings: DataFrame, hold_ms: int) -> DataFrame:
    """(device, channel, start_ms, end_ms, energy): each reading holds until the next of its channel, for hold_ms at most."""
    after = F.lead("ts_ms").over(Window.partitionBy("device", "channel").orderBy("ts_ms", "seq"))
    most = F.col("ts_ms") + hold_ms
    rows = readings.select("device", "channel", F.col("ts_ms").alias(S), F.least(F.coalesce(after, most), most).alias(E), "energy")
    return rows.where(F.col(E) > F.col(S))


def sessions(readings: DataFrame, hold_ms: int) -> DataFrame:
    """Adds session, which counts up where a device's next reading comes later than the hold."""
    line = Window.partitionBy("device").orderBy("ts_ms", "seq")
    fresh = F.when(F.col("ts_ms") <= F.lag("ts_ms").over(line) + hold_ms, 0).otherwise(1)
    return readings.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(line)).drop("_fresh")


def vectors(readings: DataFrame, hold_ms: int, channels: int) -> DataFrame:
    """(device, session, start_ms, end_ms, g0..): every channel's energy, forward-filled within a session; missing stays missing."""
    found = sessions(readings, hold_ms)
    line = Window.partitionBy("device", "session").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    after = F.lead("ts_ms").over(Window.partitionBy("device").orderBy("ts_ms", "seq"))
    most = F.col("ts_ms") + hold_ms
    filled = [F.nullif(F.last(F.when(F.col("channel") == c, F.coalesce("energy", F.lit(-1))), True).over(line), F.lit(-1)).alias(f"g{c}") for c in range(channels)]
    rows = found.select("device", "session", F.col("ts_ms").alias(S), F.least(F.coalesce(after, most), most).alias(E), *filled)
    return rows.where(F.col(E) > F.col(S))


def any_above(gates: list[str], thresholds: list[Column]) -> Column:
    """Whether any gate is strictly above its threshold; missing is not, and a threshold of 100 is off."""
    return reduce(lambda a, b: a | b, [F.coalesce((F.col(g) > t) & (t < 100), F.lit(False)) for g, t in zip(gates, thresholds, strict=True)])


def all_known(gates: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in gates])


def any_known(gates: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(g).isNotNull() for g in gates])


def long_form(vectors_: DataFrame, gates: list[str]) -> DataFrame:
    """(device, channel, start_ms, end_ms, energy) of vectors, missing left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("channel"), F.col(g).alias("energy")) for k, g in enumerate(gates)])
    return vectors_.withColumn("_x", F.explode(pairs)).select("device", "_x.channel", S, E, "_x.energy").where("energy is not null")
