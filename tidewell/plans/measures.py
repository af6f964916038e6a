"""Measures of detection, preferences and small scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import histograms as hg
from tidewell.plans.registry import query
from tidewell.plans.scoring import SCORE, episodes
from tidewell.plans.signals import GATES, vectors
from tidewell.plans.statistics import LAST, LHIST, PIECES, labelled
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import HOUR, MINUTE, with_views

_RANKED = "SELECT *, sum(ms) OVER (PARTITION BY device, channel, state ORDER BY energy)::BIGINT AS cum, sum(ms) OVER (PARTITION BY device, channel, state)::BIGINT AS total FROM lh"
_NOISE = "SELECT device, channel, max(energy) FILTER (state = 'not_present') AS noise_ceiling, min(energy) FILTER (state = 'not_present' AND cum > floor((total - 1) * 0.99::DOUBLE)) AS noise, min(energy) FILTER (state = 'present' AND cum > total // 4) AS presence_reference FROM rk GROUP BY device, channel"


@query(with_views("SELECT device, channel, noise_ceiling, presence_reference, coalesce(presence_reference > noise_ceiling, false) AS separated, (CASE WHEN presence_reference > noise_ceiling THEN (noise_ceiling + presence_reference) // 2 WHEN noise IS NOT NULL THEN least(100, noise + 2) ELSE 50 END)::INT AS preferred_threshold FROM no", pc=PIECES, ll=LAST, lh=LHIST, rk=_RANKED, no=_NOISE))
def gate_preference(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold a channel would have alone: the middle of the gap between Empty's top and Present's lower quartile, or two above Empty's noise (G22, A27's gap)."""
    rows = hg.cumulated(hg.durations(labelled(spark, sf), ["device", "channel", "state"]), ["device", "channel", "state"])
    empty, present = F.col("state") == "not_present", F.col("state") == "present"
    found = rows.groupBy("device", "channel").agg(
        F.max(F.when(empty, F.col("energy"))).alias("noise_ceiling"), F.min(F.when(empty & (F.col("cum") > F.floor((F.col("total") - 1) * 0.99)), F.col("energy"))).alias("noise"),
        F.min(F.when(present & (F.col("cum") > F.floor(F.col("total") / 4)), F.col("energy"))).alias("presence_reference"))
    apart = F.coalesce(F.col("presence_reference") > F.col("noise_ceiling"), F.lit(False))
    middle = F.floor((F.col("noise_ceiling") + F.col("presence_reference")) / 2)
    preferred = F.when(apart, middle).when(F.col("noise").isNotNull(), F.least(F.lit(100), F.col("noise") + 2)).otherwise(50).cast("int")
    return found.select("device", "channel", "noise_ceiling", "presence_reference", apart.alias("separated"), preferred.alias("preferred_threshold"))


BUDGET, MIN_EXACT = 30_000_000, 2
_COUNT = f"SELECT zone, count(*) AS n_rows, count(*) * 2 AS work, (SELECT count(*) FROM pat) AS n FROM v JOIN grp ON grp.device = v.device GROUP BY zone"


@query(with_views(f"SELECT zone, n_rows, work * n AS operations, CASE WHEN work * n <= {BUDGET} THEN 'exact' WHEN {BUDGET} // work < {MIN_EXACT} THEN 'cells' ELSE 'cells_then_exact' END AS fidelity, (CASE WHEN work * n <= {BUDGET} OR {BUDGET} // work < {MIN_EXACT} THEN n ELSE {BUDGET} // work END)::BIGINT AS n_exact FROM k", k=_COUNT))
def fidelity_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """How a zone's patterns would be scored under a budget of rows * patterns * passes: all exactly, a part after cells, or by cells (G9). Two passes, as with quiet rows."""
    rows = vectors(spark, sf).groupBy("device").agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(ad.groups(spark).select("zone", "device")), "device")
    rows = rows.groupBy("zone").agg(F.sum("n_rows").alias("n_rows")).crossJoin(F.broadcast(ad.patterns(spark).agg(F.count(F.lit(1)).alias("n"))))
    work, n = F.col("n_rows") * 2, F.col("n")
    limit = F.floor(F.lit(BUDGET) / work)
    kind = F.when(work * n <= BUDGET, "exact").when(limit < MIN_EXACT, "cells").otherwise("cells_then_exact")
    return rows.select("zone", "n_rows", (work * n).alias("operations"), kind.alias("fidelity"), F.when((work * n <= BUDGET) | (limit < MIN_EXACT), n).otherwise(limit).cast("long").alias("n_exact"))


@query(with_views(f"""SELECT device, pattern, count(*) FILTER (state = 'present') AS occupied, count(*) FILTER (state = 'present' AND seen = 0) AS missed_episodes,
    round(sum(seen) FILTER (state = 'present') / sum(mass) FILTER (state = 'present'), 6)::DOUBLE AS sensitivity, round(sum(seen) FILTER (state = 'not_present') / sum(mass) FILTER (state = 'not_present'), 6)::DOUBLE AS false_positive_rate,
    max(mass) FILTER (state = 'present' AND seen = 0) AS longest_missed_episode_ms, round(sum(triggers) FILTER (state = 'not_present') * {HOUR}.0::DOUBLE / sum(mass) FILTER (state = 'not_present'), 6)::DOUBLE AS bursts_per_hour FROM ep GROUP BY device, pattern""", **SCORE))
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity, false share, missed episodes and false bursts per hour of each pattern, by time."""
    present, empty = F.col("state") == "present", F.col("state") == "not_present"

    def total(c, x):
        return F.sum(F.when(c, F.col(x)))

    return episodes(spark, sf).groupBy("device", "pattern").agg(
        F.count(F.when(present, 1)).alias("occupied"), F.count(F.when(present & (F.col("seen") == 0), 1)).alias("missed_episodes"),
        F.round(total(present, "seen") / total(present, "mass"), 6).alias("sensitivity"), F.round(total(empty, "seen") / total(empty, "mass"), 6).alias("false_positive_rate"),
        F.max(F.when(present & (F.col("seen") == 0), F.col("mass"))).alias("longest_missed_episode_ms"), F.round(total(empty, "triggers") * float(HOUR) / total(empty, "mass"), 6).alias("bursts_per_hour"))


WIDE, HOP = 2 * HOUR, 30 * MINUTE


@query(with_views(f"SELECT device, channel, k * {HOP} AS start_ms, count(*) AS n, max(energy) AS top FROM (SELECT *, unnest(range((ts_ms - {WIDE}) // {HOP} + 1, ts_ms // {HOP} + 1)) AS k FROM r) GROUP BY ALL"))
def hopping_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of two hours that begin every half hour (M17): half hours are counted first, and each counts in four windows."""
    halves = ad.readings(spark, sf).groupBy("device", "channel", F.floor(F.col("ts_ms") / HOP).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.max("energy").alias("top"))
    each = halves.withColumn("k", F.explode(F.sequence(F.col("half") - (WIDE // HOP - 1), F.col("half"))))
    return each.groupBy("device", "channel", (F.col("k") * HOP).alias("start_ms")).agg(F.sum("n").alias("n"), F.max("top").alias("top"))


@query(with_views("SELECT device, start_ms, end_ms, state, level FROM gs"))
def guess_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Guess runs without the readings' columns."""
    return ad.guesses(spark, sf).select("device", "start_ms", "end_ms", "state", "level")


@query(with_views("SELECT device, event_id, ts_ms, wrong FROM (SELECT user_id % 8 AS device, event_id, ts_ms, event_type = 'error' AS wrong, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts_ms DESC, event_id DESC) AS n FROM ev) WHERE n <= 200"))
def feedback_list(spark: SparkSession, sf: str) -> DataFrame:
    """The last 200 feedbacks of each device."""
    line = Window.partitionBy("device").orderBy(F.desc("ts_ms"), F.desc("event_id"))
    rows = ad.events(spark, sf).select((F.col("user_id") % 8).alias("device"), "event_id", "ts_ms", (F.col("event_type") == "error").alias("wrong"))
    return rows.withColumn("n", F.row_number().over(line)).where("n <= 200").drop("n")  # a rank limit, which Spark pushes below the shuffle


POLL = 2 * HOUR
_TICKS = f"SELECT device, unnest(range(min(start_ms) // {POLL}, (max(end_ms) - 1) // {POLL} + 1)) * {POLL} AS tick FROM v GROUP BY device"


@query(with_views(f"SELECT t.device, t.tick, {', '.join(GATES)}, v.device IS NULL AS outage FROM t LEFT JOIN v ON v.device = t.device AND v.start_ms <= t.tick AND t.tick < v.end_ms", t=_TICKS))
def poll_source(spark: SparkSession, sf: str) -> DataFrame:
    """The values of all channels at every poll; a poll that nothing covers is a row of an outage, all missing (S2). A row holds the polls in it, so no range join is needed."""
    rows = vectors(spark, sf)
    held = F.explode(F.when(F.ceil(F.col("start_ms") / POLL) <= F.floor((F.col("end_ms") - 1) / POLL), F.sequence(F.ceil(F.col("start_ms") / POLL), F.floor((F.col("end_ms") - 1) / POLL))))
    seen = rows.withColumn("poll", held).select("device", "poll", *GATES, F.lit(True).alias("there"))
    span = rows.groupBy("device").agg(F.floor(F.min("start_ms") / POLL).alias("a"), F.floor((F.max("end_ms") - 1) / POLL).alias("b"))
    polls = span.select("device", F.explode(F.sequence("a", "b")).alias("poll"))
    return polls.join(seen, ["device", "poll"], "left").select("device", (F.col("poll") * POLL).alias("tick"), *GATES, F.col("there").isNull().alias("outage"))


_LINE = ", ".join(f"{g} NULLS FIRST" for g in GATES)


@query(with_views(f"SELECT device, (row_number() OVER (PARTITION BY device ORDER BY {_LINE}) - 1)::INT AS parent, {', '.join(GATES)}, n FROM (SELECT device, {', '.join(GATES)}, count(*) AS n FROM v GROUP BY ALL)"))
def parent_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct vectors of a device, numbered from 0 in their order."""
    line = Window.partitionBy("device").orderBy(*[F.asc_nulls_first(g) for g in GATES])
    rows = vectors(spark, sf).groupBy("device", *GATES).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("device", (F.row_number().over(line) - 1).alias("parent"), *GATES, "n")
