"""The engine's tables, made from the tables at hand: readings and labels from events, small dimensions as values.

All times are BIGINT milliseconds. Tunables of time are here, in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


@dataclass(frozen=True)
class TimeScale:
    """Holds and delays, scaled to how often the events come."""

    hold: int = HOUR
    timeout: int = 10 * MINUTE
    on_delay: int = 5 * MINUTE
    off_delay: int = 15 * MINUTE
    cell: int = 10 * MINUTE
    chart: int = HOUR


SCALE = TimeScale()
#: Channels by event type: even ones are move gates, odd ones still gates.
CHANNELS = {"view": 0, "click": 1, "purchase": 2, "signup": 3, "error": 4}
GATES = [f"g{c}" for c in range(len(CHANNELS))]
ZONES = [("z0", "a0", 0, 1.0), ("z0", "a0", 1, 1.0), ("z1", "a0", 2, 2.0), ("z1", "a0", 3, 2.0), ("z1", "a0", 4, 2.0), ("z2", "a1", 4, 1.0), ("z2", "a1", 5, 1.0), ("z3", "a1", 6, 0.5), ("z3", "a1", 7, 0.5)]
PATTERNS = [(0, [40, 40, 40, 40, 40]), (1, [20, 30, 40, 50, 60]), (2, [60, 60, 100, 60, 100]), (3, [10, 100, 10, 100, 10])]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("ts_ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long"))


def readings_of(df: DataFrame) -> DataFrame:
    """(device, channel, ts_ms, seq, energy) of events: energies are rounded up and at most 100; every fiftieth is missing."""
    channel = F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), F.col("event_type"))
    energy = F.when(F.col("event_id") % 50 != 0, F.least(F.lit(100), F.ceil("value")).cast("int"))
    return df.select((F.col("user_id") % 8).alias("device"), channel.alias("channel"), "ts_ms", F.col("event_id").alias("seq"), energy.alias("energy"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(events(spark, sf_dir))


def label_rows(df: DataFrame) -> DataFrame:
    """Columns of a label for each of some events; the owner is added by the caller."""
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "present").when(kind == "error", "not_present").otherwise("unknown")
    length = F.when(kind == "purchase", 2 * HOUR).when(kind == "error", 3 * HOUR).otherwise(HOUR)
    return df.where(kind.isin("purchase", "error", "signup")).select("user_id", F.col("event_id").alias("ord"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + length).alias("end_ms"), state.alias("state"), F.when(F.col("user_id") % 3 == 0, "sensor").otherwise("manual").alias("source"), (F.lit(50) + F.col("event_id") % 50).cast("int").alias("confidence"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ord, start_ms, end_ms, state, source, confidence in per cent) from all label events; they overlap."""
    rows = label_rows(events(spark, sf_dir))
    return rows.select((F.col("user_id") % 8).alias("device"), "ord", "start_ms", "end_ms", "state", "source", "confidence")


def room_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for zones: (zone, ord, ...). Every label event is a label of its user's device and of the user's zone."""
    rows = label_rows(events(spark, sf_dir))
    return rows.select(F.concat(F.lit("z"), (F.col("user_id") % 4).cast("string")).alias("zone"), "ord", "start_ms", "end_ms", "state", "source", "confidence")


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, start_ms, end_ms, state, level, basis): runs from the view events, each until the next or for two hours."""
    from pyspark.sql import Window

    rows = events(spark, sf_dir).where("event_type = 'view'").withColumn("device", F.col("user_id") % 8)
    after = F.lead("ts_ms").over(Window.partitionBy("device").orderBy("ts_ms", "event_id"))
    end = F.least(F.coalesce(after, F.col("ts_ms") + 2 * HOUR), F.col("ts_ms") + 2 * HOUR)
    out = rows.select("device", F.col("ts_ms").alias("start_ms"), end.alias("end_ms"), F.when(F.col("value") > 30, "present").otherwise("not_present").alias("state"), (11 + F.col("event_id") % 9).cast("int").alias("level"), (1 + F.floor(F.col("event_id") / 2) % 2).cast("int").alias("basis"))
    return out.where("end_ms > start_ms")


def groups(spark: SparkSession) -> DataFrame:
    """(zone, area, device, priority): zones in areas; one device is in two zones."""
    return spark.createDataFrame(ZONES, "zone string, area string, device long, priority double")


def patterns(spark: SparkSession) -> DataFrame:
    """(pattern, thresholds): a threshold for each channel; 100 is off."""
    return spark.createDataFrame(PATTERNS, "pattern int, thresholds array<int>")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a dense source, lineitem: the device is the supplier, energy the quantity, and the rows of a day come a second apart."""
    from pyspark.sql import Window

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1000).cast("long")
    nth = F.row_number().over(Window.partitionBy("l_suppkey", "l_shipdate").orderBy("l_orderkey", "l_linenumber"))
    return df.select(F.col("l_suppkey").alias("device"), F.lit(0).alias("channel"), (day + (nth - 1) * 1000).alias("ts_ms"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.ceil("l_quantity").cast("int").alias("energy"))


# ------------------------------------------------------------------ the same tables as SQL

_LABEL = f"""event_id AS ord, ts_ms AS start_ms, ts_ms + CASE event_type WHEN 'purchase' THEN {2 * HOUR} WHEN 'error' THEN {3 * HOUR} ELSE {HOUR} END AS end_ms,
  CASE event_type WHEN 'purchase' THEN 'present' WHEN 'error' THEN 'not_present' ELSE 'unknown' END AS state,
  CASE WHEN user_id % 3 = 0 THEN 'sensor' ELSE 'manual' END AS source, (50 + event_id % 50)::INT AS confidence FROM ev WHERE event_type IN ('purchase', 'error', 'signup')"""
VIEWS = {
    "ev": "SELECT *, epoch_us(ts) // 1000 AS ts_ms FROM events",
    "r": "SELECT user_id % 8 AS device, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS channel, ts_ms, event_id AS seq, CASE WHEN event_id % 50 <> 0 THEN least(100, ceil(value))::INT END AS energy FROM ev",
    "lab": f"SELECT user_id % 8 AS device, {_LABEL}",
    "rlab": f"SELECT 'z' || (user_id % 4) AS zone, {_LABEL}",
    "gs": f"SELECT * FROM (SELECT user_id % 8 AS device, ts_ms AS start_ms, least(coalesce(lead(ts_ms) OVER (PARTITION BY user_id % 8 ORDER BY ts_ms, event_id), ts_ms + {2 * HOUR}), ts_ms + {2 * HOUR}) AS end_ms, CASE WHEN value > 30 THEN 'present' ELSE 'not_present' END AS state, (11 + event_id % 9)::INT AS level, (1 + event_id // 2 % 2)::INT AS basis FROM ev WHERE event_type = 'view') WHERE end_ms > start_ms",
    "sp": f"SELECT * FROM (SELECT device, channel, ts_ms AS start_ms, least(coalesce(lead(ts_ms) OVER (PARTITION BY device, channel ORDER BY ts_ms, seq), ts_ms + {SCALE.hold}), ts_ms + {SCALE.hold}) AS end_ms, energy FROM r) WHERE end_ms > start_ms",
    "v0": f"SELECT *, CASE WHEN ts_ms <= lag(ts_ms) OVER (PARTITION BY device ORDER BY ts_ms, seq) + {SCALE.hold} THEN 0 ELSE 1 END AS fresh FROM r",
    "v1": "SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY ts_ms, seq) AS session FROM v0",
    "v": f"""SELECT * FROM (SELECT device, session::BIGINT AS session, ts_ms AS start_ms, least(coalesce(lead(ts_ms) OVER (PARTITION BY device ORDER BY ts_ms, seq), ts_ms + {SCALE.hold}), ts_ms + {SCALE.hold}) AS end_ms,
        {", ".join(f"nullif(last_value(CASE WHEN channel = {c} THEN coalesce(energy, -1) END IGNORE NULLS) OVER (PARTITION BY device, session ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING), -1) AS g{c}" for c in range(5))} FROM v1) WHERE end_ms > start_ms""",
    "grp": "SELECT * FROM (VALUES " + ", ".join(f"('{z}', '{a}', {d}::BIGINT, {p}::DOUBLE)" for z, a, d, p in ZONES) + ") t(zone, area, device, priority)",
    "pat": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {t})" for k, t in PATTERNS) + ") t(pattern, thresholds)",
    "dn": "SELECT l_suppkey AS device, 0 AS channel, epoch_us(l_shipdate) // 1000 + (row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) - 1) * 1000 AS ts_ms, l_orderkey * 8 + l_linenumber AS seq, ceil(l_quantity)::INT AS energy FROM lineitem",
}
NEEDS = {"r": ["ev"], "lab": ["ev"], "rlab": ["ev"], "gs": ["ev"], "sp": ["r"], "v0": ["r"], "v1": ["v0"], "v": ["v1"]}


def with_views(body: str, **own: str) -> str:
    """SQL with the views it names, and those they need, as common table expressions; own are the query's, in order."""
    import re

    text, found = " ".join([body, *own.values()]), []

    def add(name: str) -> None:
        for below in NEEDS.get(name, []):
            add(below)
        if name not in found:
            found.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in found] + [f"{n} AS ({q})" for n, q in own.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"
