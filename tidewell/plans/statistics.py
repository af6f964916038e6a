"""Histograms, quantiles and the statistics made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import histograms as hg
from tidewell.operators import intervals as iv
from tidewell.plans.registry import query
from tidewell.plans.signals import FROM, holds, sweep
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import with_views

E, S = iv.E, iv.S
HIST = "SELECT device, channel, energy, sum(end_ms - start_ms)::BIGINT AS ms FROM sp WHERE energy IS NOT NULL GROUP BY device, channel, energy"
CUM = "SELECT *, sum(ms) OVER (PARTITION BY device, channel ORDER BY energy)::BIGINT AS cum, sum(ms) OVER (PARTITION BY device, channel)::BIGINT AS total FROM h"


def hist(spark: SparkSession, sf: str) -> DataFrame:
    return hg.durations(holds(spark, sf), ["device", "channel"])


@query(with_views(HIST))
def duration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """How long each energy held on each channel (A1)."""
    return hist(spark, sf)


def last_label(labels: DataFrame, keys: list[str]) -> DataFrame:
    """The label in force: the latest in the list wins, and its end restores the one before."""
    return iv.overlay(labels, keys, F.col("ord"), ["state"])


PIECES = sweep("SELECT device, start_ms, end_ms FROM lab", "", "device")
LAST = """SELECT device, state, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY start_ms) AS run FROM
    (SELECT *, CASE WHEN lag(end_ms) OVER w = start_ms AND lag(state) OVER w = state THEN 0 ELSE 1 END AS fresh FROM
        (SELECT p.device, p.start_ms, p.end_ms, arg_max(l.state, l.ord) AS state FROM pc p JOIN lab l ON l.device = p.device AND l.start_ms <= p.start_ms AND p.start_ms < l.end_ms GROUP BY ALL) WINDOW w AS (PARTITION BY device ORDER BY start_ms))) GROUP BY device, state, run"""


@query(with_views(LAST, pc=PIECES))
def labels_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The label in force over time."""
    return last_label(ad.labels(spark, sf), ["device"])


LHIST = "SELECT s.device, s.channel, l.state, s.energy, sum(least(s.end_ms, l.end_ms) - greatest(s.start_ms, l.start_ms))::BIGINT AS ms FROM sp s JOIN ll l ON l.device = s.device AND s.start_ms < l.end_ms AND l.start_ms < s.end_ms WHERE s.energy IS NOT NULL GROUP BY ALL"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Spans under the label in force."""
    return iv.overlap_join(holds(spark, sf).where("energy is not null"), last_label(ad.labels(spark, sf), ["device"]), ["device"])


@query(with_views(LHIST, pc=PIECES, ll=LAST))
def labelled_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The same per state of the label in force (A2)."""
    return hg.durations(labelled(spark, sf), ["device", "channel", "state"])


@query(with_views("SELECT device, channel, state, energy, sum(ms)::BIGINT AS ms FROM (SELECT * FROM hn UNION ALL SELECT device, channel, state, energy, -ms FROM ho) GROUP BY ALL HAVING sum(ms) <> 0",
                  pc=PIECES, ll=LAST, hn=LHIST, pm=sweep("SELECT device, start_ms, end_ms FROM lab WHERE source = 'manual'", "", "device"), lm=LAST.replace("pc p", "pm p").replace("JOIN lab l ON", "JOIN lab l ON l.source = 'manual' AND"), ho=LHIST.replace("ll l", "lm l")))
def recount_delta(spark: SparkSession, sf: str) -> DataFrame:
    """What a change of labels does to the labelled histogram: only time whose state changes is counted, plus and minus (A3)."""
    old = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"])
    new = last_label(ad.labels(spark, sf), ["device"])
    signed = new.select("device", S, E, "state", F.lit(1).alias("sign")).unionByName(old.select("device", S, E, "state", F.lit(-1).alias("sign")))
    net = iv.depth(signed, ["device", "state"], net=F.col("sign")).where("net != 0")
    found = iv.overlap_join(holds(spark, sf).where("energy is not null"), net, ["device"])
    rows = found.groupBy("device", "channel", "state", "energy").agg(F.sum((F.col(E) - F.col(S)) * F.col("net")).alias("ms"))
    return rows.where("ms != 0")


@query(with_views("SELECT device, channel, energy, CASE WHEN total > 5000 THEN n * 5000 // total ELSE n END::BIGINT AS n FROM (SELECT device, channel, energy, n, sum(n) OVER (PARTITION BY device, channel) AS total FROM (SELECT device, channel, energy, ms // 6000 AS n FROM h))", h=HIST))
def capped_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Six-second equivalents, scaled down where a channel has more than 5,000 (A4)."""
    n = hist(spark, sf).select("device", "channel", "energy", F.floor(F.col("ms") / 6000).alias("n"))
    total = F.sum("n").over(Window.partitionBy("device", "channel"))
    return n.withColumn("t", total).select("device", "channel", "energy", F.expr("case when t > 5000 then (n * 5000) div t else n end").alias("n"))


@query(with_views("SELECT device, channel, max(total) AS ms, min(energy) AS low, max(energy) AS high, " + ", ".join(f"coalesce(min(energy) FILTER (cum >= greatest(1, floor((total - 1) * {q})::BIGINT + 1)), 0) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM c GROUP BY device, channel", h=HIST, c=CUM))
def hist_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mass, extremes and quantiles of each histogram."""
    rows = hg.cumulated(hist(spark, sf), ["device", "channel"])
    return rows.groupBy("device", "channel").agg(F.max("total").alias("ms"), F.min("energy").alias("low"), F.max("energy").alias("high"), *[hg.RULES["q3"](q).cast("int").alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)])


@query(with_views("""SELECT device, channel,
    coalesce(min(energy) FILTER (cum >= greatest(1, ceil(total * 0.9)::BIGINT)), 0) AS q1, min(energy) FILTER (cum >= total * 0.9) AS q2,
    coalesce(min(energy) FILTER (cum >= greatest(1, floor((total - 1) * 0.9)::BIGINT + 1)), 0) AS q3,
    least(max(energy), min(energy) FILTER (cum > floor((total - 1) * 0.9)) + 3) AS q4, least(100, coalesce(min(energy) FILTER (cum > total * 0.9), 100)) + 3 AS q5,
    min(energy) FILTER (cum >= total * 0.9 AND total * 0.9 > 0) AS q6, min(energy) FILTER (cum > least(total - 1, floor(total * 0.9))) AS q7 FROM c GROUP BY device, channel""", h=HIST, c=CUM))
def hist_quantiles_q1_q7(spark: SparkSession, sf: str) -> DataFrame:
    """The seven quantile rules side by side at 0.9."""
    rows = hg.cumulated(hist(spark, sf), ["device", "channel"])
    return rows.groupBy("device", "channel").agg(*[rule(0.9).cast("int").alias(name) for name, rule in hg.RULES.items()])


@query(with_views("SELECT device, channel, round(sum(CASE WHEN energy IS NOT NULL THEN end_ms - start_ms ELSE 0 END) / 1000.0, 3)::DOUBLE AS observed_s, round(sum(end_ms - start_ms) / 1000.0, 3)::DOUBLE AS covered_s FROM sp GROUP BY device, channel"))
def observed_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds in which a channel was read, and covered."""
    ms = F.col(E) - F.col(S)
    return holds(spark, sf).groupBy("device", "channel").agg(iv.seconds(F.sum(F.when(F.col("energy").isNotNull(), ms).otherwise(0))).alias("observed_s"), iv.seconds(F.sum(ms)).alias("covered_s"))


WINDOWS = [(k, FROM + k * 6 * 3_600_000, FROM + (k + 1) * 8 * 3_600_000) for k in range(6)]


@query(with_views("SELECT win, device, channel, energy, sum(least(s.end_ms, w.b) - greatest(s.start_ms, w.a))::BIGINT AS ms FROM sp s JOIN w ON s.start_ms < w.b AND w.a < s.end_ms WHERE energy IS NOT NULL GROUP BY ALL", w="SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, a, b in WINDOWS) + ") t(win, a, b)"))
def histogram_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of several windows at once."""
    w = F.broadcast(spark.createDataFrame(WINDOWS, "win int, a long, b long"))
    rows = holds(spark, sf).where("energy is not null").join(w, (F.col(S) < F.col("b")) & (F.col("a") < F.col(E)))
    return hg.durations(rows.withColumn(S, F.greatest(S, "a")).withColumn(E, F.least(E, "b")), ["win", "device", "channel"])


@query(with_views("SELECT device, channel, state, energy, round(ms::DOUBLE / sum(ms) OVER (PARTITION BY device, channel, state), 9)::DOUBLE AS density FROM lh", pc=PIECES, ll=LAST, lh=LHIST))
def quality_density(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised histograms per class."""
    rows = hg.durations(labelled(spark, sf), ["device", "channel", "state"])
    total = F.sum("ms").over(Window.partitionBy("device", "channel", "state"))
    return rows.select("device", "channel", "state", "energy", F.round(F.col("ms").cast("double") / total, 9).alias("density"))


REGIME = """SELECT device, channel, max(energy) FILTER (state = 'not_present') AS empty_max, least(max(energy) FILTER (state = 'not_present'), min(energy) FILTER (state = 'not_present' AND cum > floor((total - 1) * 0.99)) + 3) AS ceiling
    FROM (SELECT *, sum(ms) OVER (PARTITION BY device, channel, state ORDER BY energy)::BIGINT AS cum, sum(ms) OVER (PARTITION BY device, channel, state)::BIGINT AS total FROM lh) GROUP BY device, channel"""


@query(with_views("""SELECT o.device, o.channel, o.energy, o.energy > coalesce(g.empty_max, -1) OR (o.energy > coalesce(g.ceiling, -1) AND o.w * coalesce(e.total, 0) > 2 * coalesce(e.w, 0) * o.total) AS supported, g.empty_max, g.ceiling
    FROM k o JOIN rg g ON g.device = o.device AND g.channel = o.channel LEFT JOIN k e ON e.device = o.device AND e.channel = o.channel AND e.energy = o.energy AND e.state = 'not_present' WHERE o.state = 'present'""",
                  pc=PIECES, ll=LAST, lh=LHIST, rg=REGIME, grid="SELECT DISTINCT device, channel, state, unnest(range(101))::INT AS energy FROM lh",
                  k="SELECT *, sum(ms) OVER (PARTITION BY device, channel, state ORDER BY energy ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)::BIGINT AS w, sum(ms) OVER (PARTITION BY device, channel, state)::BIGINT AS total FROM (SELECT device, channel, state, energy, coalesce(ms, 0) AS ms FROM grid LEFT JOIN lh USING (device, channel, state, energy))"))
def gate_regime(spark: SparkSession, sf: str) -> DataFrame:
    """Energies that speak for presence: above all of Empty, or above its ceiling with twice its likelihood in a window of three bins."""
    keys = ["device", "channel", "state"]
    lh = hg.durations(labelled(spark, sf), keys)
    empty = hg.cumulated(lh, keys).where("state = 'not_present'")
    regime = empty.groupBy("device", "channel").agg(F.max("energy").alias("empty_max"), hg.RULES["q4"](0.99).cast("int").alias("ceiling"))
    line = Window.partitionBy(*keys)
    grid = lh.select(*keys).distinct().withColumn("energy", F.explode(F.sequence(F.lit(0), F.lit(100)))).join(lh, [*keys, "energy"], "left").withColumn("ms", F.coalesce("ms", F.lit(0)))
    wide = grid.withColumn("w", F.sum("ms").over(line.orderBy("energy").rowsBetween(-3, 3))).withColumn("total", F.sum("ms").over(line))
    at = ["device", "channel", "energy"]
    none = wide.where("state = 'not_present'").select(*at, F.col("w").alias("ew"), F.col("total").alias("et"))
    found = wide.where("state = 'present'").join(regime, ["device", "channel"], "left").join(none, at, "left")
    likely = F.col("w") * F.coalesce("et", F.lit(0)) > F.coalesce("ew", F.lit(0)) * 2 * F.col("total")
    high = F.coalesce("ceiling", F.lit(-1))
    return found.select(*at, ((F.col("energy") > F.coalesce("empty_max", F.lit(-1))) | ((F.col("energy") > high) & likely)).alias("supported"), "empty_max", "ceiling")


NOISE = "SELECT device, channel, least(100, coalesce(min(energy) FILTER (cum > total * 0.99), 100)) + 3 AS ceiling, max(total) AS ms FROM (SELECT *, sum(ms) OVER (PARTITION BY device, channel ORDER BY energy)::BIGINT AS cum, sum(ms) OVER (PARTITION BY device, channel)::BIGINT AS total FROM lh WHERE state = 'not_present') GROUP BY device, channel HAVING max(total) >= 120000"


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    """(device, channel, ceiling, ms) from time labelled Empty, where there are twenty units of six seconds at least."""
    keys = ["device", "channel"]
    rows = hg.cumulated(hg.durations(labelled(spark, sf).where("state = 'not_present'"), keys), keys)
    return rows.groupBy(*keys).agg(hg.RULES["q5"](0.99).cast("int").alias("ceiling"), F.max("total").alias("ms")).where("ms >= 120000")


@query(with_views(NOISE, pc=PIECES, ll=LAST, lh=LHIST))
def quiet_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """A ceiling for the energy of quiet time."""
    return baselines(spark, sf)


@query(with_views("SELECT device, channel, " + ", ".join(f"{x} AS {n}" for n, x in (("noise", "coalesce(min(energy) FILTER (state = 'not_present' AND cum > floor((total - 1) * 0.99)), 0)"), ("low", "min(energy) FILTER (state = 'present' AND cum >= total * 0.25)"), ("high", "max(energy) FILTER (state = 'present')"))) + " FROM (SELECT *, sum(ms) OVER (PARTITION BY device, channel, state ORDER BY energy)::BIGINT AS cum, sum(ms) OVER (PARTITION BY device, channel, state)::BIGINT AS total FROM lh) GROUP BY device, channel", pc=PIECES, ll=LAST, lh=LHIST))
def class_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Per channel the noise of Empty, and the lower quartile and top of Present."""
    rows = hg.cumulated(hg.durations(labelled(spark, sf), ["device", "channel", "state"]), ["device", "channel", "state"])
    of = lambda state, c, f=F.min: f(F.when((F.col("state") == state) & c, F.col("energy")))
    return rows.groupBy("device", "channel").agg(F.coalesce(of("not_present", F.col("cum") > F.floor((F.col("total") - 1) * 0.99)), F.lit(0)).alias("noise"), of("present", F.col("cum") >= F.col("total") * 0.25).alias("low"), of("present", F.lit(True), F.max).alias("high"))


