"""Queries over readings, spans and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv
from tidewell.operators import spans as sp
from tidewell.plans.registry import query
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import DAY, GATES, HOUR, SCALE, with_views

E, S = iv.E, iv.S
HIT40 = "(" + " OR ".join(f"coalesce({g} > 40, false)" for g in GATES) + ")"
KNOWN = "(" + " OR ".join(f"{g} IS NOT NULL" for g in GATES) + ")"
ALL = "(" + " AND ".join(f"{g} IS NOT NULL" for g in GATES) + ")"
#: A window of the recording: days 5 to 12 of 2024.
FROM, TO = 1_704_412_800_000, 1_705_017_600_000


def islands(src: str, keys: str, values: str = "") -> str:
    """SQL that merges rows which touch and agree."""
    same = "".join(f" AND lag({v}) OVER w IS NOT DISTINCT FROM {v}" for v in values.split(", ") if v)
    vals = f", {values}" if values else ""
    return f"""SELECT {keys}{vals}, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms) AS run FROM
        (SELECT *, CASE WHEN lag(end_ms) OVER w = start_ms{same} THEN 0 ELSE 1 END AS fresh FROM ({src}) WINDOW w AS (PARTITION BY {keys} ORDER BY start_ms, end_ms))) GROUP BY {keys}{vals}, run"""


def sweep(a: str, b: str, keys: str) -> str:
    """SQL of elementary pieces with how many of each of two sets are there."""
    edge = "SELECT {k}, {t} AS t, {a} AS a, {b} AS b FROM ({src}) WHERE end_ms > start_ms"
    rows = " UNION ALL ".join([edge.format(k=keys, t="start_ms", a=1, b=0, src=a), edge.format(k=keys, t="end_ms", a=-1, b=0, src=a), *([edge.format(k=keys, t="start_ms", a=0, b=1, src=b), edge.format(k=keys, t="end_ms", a=0, b=-1, src=b)] if b else [])])
    return f"""SELECT * FROM (SELECT {keys}, t AS start_ms, lead(t) OVER w AS end_ms, sum(a) OVER w AS a, sum(b) OVER w AS b FROM (SELECT {keys}, t, sum(a) AS a, sum(b) AS b FROM ({rows}) GROUP BY {keys}, t) WINDOW w AS (PARTITION BY {keys} ORDER BY t)) WHERE end_ms IS NOT NULL"""


def picked(a: str, b: str, keys: str, where: str) -> str:
    return islands(f"SELECT {keys}, start_ms, end_ms FROM ({sweep(a, b, keys)}) WHERE {where}", keys)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return sp.vectors(ad.readings(spark, sf), SCALE.hold, len(GATES))


def holds(spark: SparkSession, sf: str) -> DataFrame:
    return sp.hold_spans(ad.readings(spark, sf), SCALE.hold)


def above(limit: int) -> F.Column:
    return sp.any_above(GATES, [F.lit(limit)] * len(GATES))


@query(with_views(f"SELECT device, count(*) AS activations, round(sum(end_ms - start_ms) / 1000.0, 3)::DOUBLE AS active_s FROM ({islands(f'SELECT device, start_ms, end_ms FROM v WHERE {HIT40}', 'device')}) GROUP BY device"))
def active_seconds_by_device(spark: SparkSession, sf: str) -> DataFrame:
    """Readings -> vectors -> any gate above 40 -> activations -> seconds."""
    runs = iv.coalesce(vectors(spark, sf).where(above(40)).select("device", S, E), ["device"])
    return runs.groupBy("device").agg(F.count(F.lit(1)).alias("activations"), iv.seconds().alias("active_s"))


@query(with_views(f"SELECT device, count(*) AS activations, round(sum(end_ms - start_ms) / 1000.0, 3)::DOUBLE AS active_s FROM ({islands('SELECT device, start_ms, end_ms FROM d WHERE energy > 40', 'device')}) GROUP BY device", d=f"SELECT * FROM (SELECT device, ts_ms AS start_ms, least(coalesce(lead(ts_ms) OVER (PARTITION BY device, channel ORDER BY ts_ms, seq), ts_ms + {HOUR}), ts_ms + {HOUR}) AS end_ms, energy FROM dn) WHERE end_ms > start_ms"))
def dense_active_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the dense source, of one channel."""
    found = sp.hold_spans(ad.dense(spark, sf), HOUR).where("energy > 40").select("device", S, E)
    return iv.coalesce(found, ["device"]).groupBy("device").agg(F.count(F.lit(1)).alias("activations"), iv.seconds().alias("active_s"))


@query(with_views("SELECT * EXCLUDE (prev, n) FROM (SELECT *, lag(energy) OVER w AS prev, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY device, channel ORDER BY ts_ms, seq)) WHERE n = 1 OR prev IS DISTINCT FROM energy"))
def change_only(spark: SparkSession, sf: str) -> DataFrame:
    """Only readings that change their channel."""
    return sp.changes(ad.readings(spark, sf))


@query(with_views("SELECT device, seq, ts_ms, max(ts_ms) OVER (PARTITION BY device ORDER BY seq // 4 * 4 + 3 - seq % 4 ROWS UNBOUNDED PRECEDING) AS clamped_ms FROM r"))
def clock_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """Readings that arrive in another order are recorded no earlier than those before them."""
    arrival = F.floor(F.col("seq") / 4) * 4 + 3 - F.col("seq") % 4
    return sp.clamped(ad.readings(spark, sf), arrival).select("device", "seq", "ts_ms", "clamped_ms")


@query(with_views("SELECT * FROM sp"))
def hold_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each reading until the next one of its channel."""
    return holds(spark, sf)


@query(with_views("SELECT * FROM v"))
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all channels, filled forward inside sessions."""
    return vectors(spark, sf)


@query(with_views("SELECT device, session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM v GROUP BY device, session"))
def coverage_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of coverage, cut by gaps."""
    return vectors(spark, sf).groupBy("device", "session").agg(F.min(S).alias(S), F.max(E).alias(E), F.count(F.lit(1)).alias("n"))


@query(with_views(islands("SELECT device, channel, start_ms, end_ms, energy FROM sp", "device, channel", "energy")))
def value_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal values without a gap."""
    return iv.coalesce(holds(spark, sf), ["device", "channel"], ["energy"])


@query(with_views(f"SELECT device, channel, greatest(start_ms, {FROM}) AS start_ms, least(end_ms, {TO}) AS end_ms, energy FROM sp WHERE end_ms > {FROM} AND start_ms < {TO} AND channel IN (0, 2)"))
def window_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of two channels in a window; a value held when it opens is kept."""
    return iv.clip(holds(spark, sf).where(F.col("channel").isin(0, 2)), FROM, TO)


@query(with_views("SELECT device, count(*) FILTER (start_ms < prev) AS overlaps FROM (SELECT device, start_ms, lag(end_ms) OVER (PARTITION BY device, channel ORDER BY start_ms) AS prev FROM sp) GROUP BY device"))
def overlap_guard(spark: SparkSession, sf: str) -> DataFrame:
    """How often coverage overlaps, which it never should."""
    before = F.lag(E).over(Window.partitionBy("device", "channel").orderBy(S))
    return holds(spark, sf).withColumn("_p", before).groupBy("device").agg(F.count(F.when(F.col(S) < F.col("_p"), 1)).alias("overlaps"))


@query(with_views(f"SELECT device, channel, last(energy ORDER BY ts_ms, seq) AS energy, max(ts_ms) AS since_ms FROM r WHERE ts_ms <= {TO} GROUP BY device, channel"))
def as_of_scan(spark: SparkSession, sf: str) -> DataFrame:
    """What each channel held at an instant, later readings unseen."""
    rows = ad.readings(spark, sf).where(F.col("ts_ms") <= TO)
    last = F.max_by(F.struct("energy"), F.struct("ts_ms", "seq"))
    return rows.groupBy("device", "channel").agg(last.getField("energy").alias("energy"), F.max("ts_ms").alias("since_ms"))


@query(with_views(f"SELECT device, count(*) AS rows_known, round(sum(CASE WHEN {ALL} THEN end_ms - start_ms ELSE 0 END) / 1000.0, 3)::DOUBLE AS usable_s, round(sum(CASE WHEN NOT {HIT40} THEN end_ms - start_ms ELSE 0 END) / 1000.0, 3)::DOUBLE AS quiet_s FROM v WHERE {KNOWN} GROUP BY device"))
def row_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Known, usable and quiet rows."""
    ms = F.col(E) - F.col(S)
    rows = vectors(spark, sf).where(sp.any_known(GATES))
    total = lambda c: iv.seconds(F.sum(F.when(c, ms).otherwise(0)))
    return rows.groupBy("device").agg(F.count(F.lit(1)).alias("rows_known"), total(sp.all_known(GATES)).alias("usable_s"), total(~above(40)).alias("quiet_s"))


SPANS = "SELECT device, start_ms, end_ms FROM lab WHERE state <> 'unknown'"
GUESS = "SELECT device, start_ms, end_ms FROM gs WHERE state = 'present'"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return ad.labels(spark, sf).where("state != 'unknown'").select("device", S, E)


def _guesses(spark: SparkSession, sf: str) -> DataFrame:
    return ad.guesses(spark, sf).where("state = 'present'").select("device", S, E)


@query(with_views(picked(SPANS, "", "device", "a > 0")))
def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    """What any label covers."""
    return iv.union(_labels(spark, sf), ["device"])


@query(with_views(picked(SPANS, GUESS, "device", "a > 0 AND b > 0")))
def interval_intersect(spark: SparkSession, sf: str) -> DataFrame:
    """What labels and guesses both cover."""
    return iv.intersect(_labels(spark, sf), _guesses(spark, sf), ["device"])


@query(with_views(picked(SPANS, GUESS, "device", "a > 0 AND b = 0")))
def interval_subtract(spark: SparkSession, sf: str) -> DataFrame:
    """What labels cover and guesses do not."""
    return iv.subtract(_labels(spark, sf), _guesses(spark, sf), ["device"])


COVER = islands("SELECT device, start_ms, end_ms FROM v", "device")


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return iv.coalesce(vectors(spark, sf).select("device", S, E), ["device"])


@query(with_views(islands("SELECT zone, start_ms, end_ms FROM (" + sweep("SELECT zone, start_ms, end_ms FROM cov JOIN grp USING (device)", "", "zone") + ") JOIN (SELECT zone, count(*) AS n FROM grp GROUP BY zone) USING (zone) WHERE a = n", "zone"), cov=COVER))
def shared_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Where every member of a zone is covered: the depth of the sweep is the number of members."""
    members = F.broadcast(ad.groups(spark).select("zone", "device"))  # a few rows of fixed values
    sizes = F.broadcast(ad.groups(spark).groupBy("zone").agg(F.count(F.lit(1)).alias("n")))
    deep = iv.depth(coverage(spark, sf).join(members, "device"), ["zone"]).join(sizes, "zone").where("depth = n")
    return iv.coalesce(deep.select("zone", S, E), ["zone"])


ACTIVE = islands(f"SELECT device, start_ms, end_ms FROM v WHERE {HIT40}", "device")


def active(spark: SparkSession, sf: str, limit: int = 40) -> DataFrame:
    return iv.coalesce(vectors(spark, sf).where(above(limit)).select("device", S, E), ["device"])


@query(with_views("SELECT zone, round(sum(end_ms - start_ms) / 1000.0, 3)::DOUBLE AS exclusive_s FROM (" + sweep("SELECT zone, start_ms, end_ms FROM act JOIN grp USING (device)", "", "zone") + ") WHERE a = 1 GROUP BY zone", act=ACTIVE))
def exclusive_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Time in which exactly one member of a zone is active."""
    members = F.broadcast(ad.groups(spark).select("zone", "device"))
    return iv.depth(active(spark, sf).join(members, "device"), ["zone"]).where("depth = 1").groupBy("zone").agg(iv.seconds().alias("exclusive_s"))


@query(with_views("SELECT device, channel, day, greatest(start_ms, day * 86400000) AS start_ms, least(end_ms, (day + 1) * 86400000) AS end_ms, energy FROM (SELECT *, unnest(range(start_ms // 86400000, (end_ms - 1) // 86400000 + 1)) AS day FROM sp)"))
def spans_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Spans cut at midnight, UTC."""
    return iv.split(holds(spark, sf), DAY, "day")


@query(with_views("SELECT device, ord, greatest(start_ms, piece * 1800000) AS start_ms, least(end_ms, (piece + 1) * 1800000) AS end_ms, piece, state FROM (SELECT device, ord, start_ms, end_ms, state, unnest(range(start_ms // 1800000, (end_ms - 1) // 1800000 + 1)) AS piece FROM lab)"))
def half_hour_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Labels in half-hour pieces."""
    return iv.split(ad.labels(spark, sf).select("device", "ord", S, E, "state"), 1_800_000, "piece")


@query(with_views("SELECT r.device, r.seq, g.state, g.level, g.basis FROM r LEFT JOIN gs g ON g.device = r.device AND r.ts_ms >= g.start_ms AND r.ts_ms < g.end_ms"))
def guess_at(spark: SparkSession, sf: str) -> DataFrame:
    """The guess in force at each reading, as of its time."""
    found = iv.at_time(ad.readings(spark, sf).select("device", "seq", "ts_ms"), ad.guesses(spark, sf), ["device"], "ts_ms", "left")
    return found.select("device", "seq", "state", "level", "basis")


@query(with_views("SELECT DISTINCT device, start_ms // 86400000 AS day FROM sp WHERE EXISTS (SELECT 1 FROM lab WHERE lab.device = sp.device AND lab.start_ms < sp.end_ms AND sp.start_ms < lab.end_ms)"))
def days_reached(spark: SparkSession, sf: str) -> DataFrame:
    """Days with spans that labels reach: a semi join of intervals."""
    joined = iv.overlap_join(holds(spark, sf).select("device", S, E, F.floor(F.col(S) / DAY).alias("day")), iv.union(ad.labels(spark, sf), ["device"]), ["device"])
    return joined.select("device", "day").distinct()


@query(with_views("SELECT area, zone, device, priority, (SELECT count(*) FROM grp g WHERE g.device = grp.device) AS covering, (SELECT count(DISTINCT g.zone) FROM grp g WHERE g.area = grp.area) AS siblings FROM grp"))
def group_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Areas, zones and devices with the groups that cover a device."""
    g = ad.groups(spark)
    covering = g.groupBy("device").agg(F.count(F.lit(1)).alias("covering"))
    return g.join(covering, "device").join(g.groupBy("area").agg(F.countDistinct("zone").alias("siblings")), "area").select("area", "zone", "device", "priority", "covering", "siblings")


@query("WITH d AS (SELECT DISTINCT device, user_id % 40 AS threshold FROM (SELECT user_id % 8 AS device, * FROM events)) SELECT device, count(*) AS n, min(threshold) AS first_one FROM d GROUP BY device")
def distinct_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct candidates of each device."""
    rows = ad.events(spark, sf).select((F.col("user_id") % 8).alias("device"), (F.col("user_id") % 40).alias("threshold")).distinct()
    return rows.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.min("threshold").alias("first_one"))
