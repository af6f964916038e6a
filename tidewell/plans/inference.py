"""Evidence of readings for presence: by channel, by gate, by room.

What a channel's reading says depends on its energy alone once the labelled histograms are known, so evidence is a small table by device, channel and energy,
and readings are joined to it. Time is counted in units of six seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import histograms as hg
from tidewell.plans.registry import query
from tidewell.plans.signals import GATES, vectors
from tidewell.plans.statistics import LAST, LHIST, PIECES, labelled
from tidewell.sources.adapter import with_views

UNIT, LEAST, REACH = 6000, 20, 3
#: Rules with fixed numbers: elevation -0.6 to 3.5 by 1.2; likelihood within 3.5, a fifth of it up to 0.7; scores under 0.05 say nothing; opposition to -1.2
#: counts a quarter; an adjacent gate adds a quarter up to 0.7.
_Q = "min(energy) FILTER (cum >= greatest(1, ceil(total * {q}::DOUBLE)))"
_KERNEL = "sum(n * (4 - abs(u.energy - e.energy)) / 4.0::DOUBLE) FILTER (u.state = '{s}')"
EVIDENCE = {
    "pc": PIECES,
    "ll": LAST,
    "lh": LHIST,
    "u": f"SELECT device, channel, state, energy, ms // {UNIT} AS n FROM lh WHERE state IN ('present', 'not_present')",
    "bq": f"SELECT device, channel, coalesce({_Q.format(q=0.25)}, 0) AS q25, coalesce({_Q.format(q=0.75)}, 0) AS q75, coalesce({_Q.format(q=0.9)}, 0) AS q90 FROM (SELECT *, sum(n) OVER (PARTITION BY device, channel ORDER BY energy) AS cum, sum(n) OVER (PARTITION BY device, channel) AS total FROM u WHERE state = 'not_present') GROUP BY device, channel HAVING max(total) >= {LEAST}",
    "tt": "SELECT device, channel, coalesce(sum(n) FILTER (state = 'present'), 0) AS tp, coalesce(sum(n) FILTER (state = 'not_present'), 0) AS tn FROM u GROUP BY device, channel",
    "e": "SELECT *, unnest(range(101))::INT AS energy FROM bq JOIN tt USING (device, channel)",
    "ke": f"SELECT e.device, e.channel, e.energy, any_value(q25) AS q25, any_value(q75) AS q75, any_value(q90) AS q90, any_value(tp) AS tp, any_value(tn) AS tn, coalesce({_KERNEL.format(s='present')}, 0) AS kp, coalesce({_KERNEL.format(s='not_present')}, 0) AS kn FROM e LEFT JOIN u ON u.device = e.device AND u.channel = e.channel AND abs(u.energy - e.energy) <= {REACH} GROUP BY e.device, e.channel, e.energy",
    "z": "SELECT *, greatest(0, (energy - q90) / greatest(2, q75 - q25)::DOUBLE) AS z, greatest(-3.5, least(3.5, ln((kp + 0.5) / (tp + 50.5)) - ln((kn + 0.5) / (tn + 50.5)))) AS likelihood FROM ke",
    "el": "SELECT *, greatest(-0.6, least(3.5, (z - 1) * 1.2)) AS elevation FROM z",
    "ce": f"SELECT device, channel, energy, z, tp >= {LEAST} AS guided, CASE WHEN tp < {LEAST} THEN elevation WHEN elevation > 0 THEN elevation + greatest(0, least(0.7, likelihood * 0.2)) ELSE least(elevation, likelihood) END::DOUBLE AS evidence FROM el",
}


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """(device, channel, energy, z, guided, evidence) for every energy of a channel with enough time labelled Empty."""
    at = ["device", "channel"]
    units = hg.durations(labelled(spark, sf), [*at, "state"]).where("state in ('present', 'not_present')").withColumn("n", F.floor(F.col("ms") / UNIT))
    empty = hg.cumulated(units.where("state = 'not_present'"), at, "n")
    rule = hg.RULES["q1"]
    base = empty.groupBy(*at).agg(*[rule(q).alias(name) for name, q in (("q25", 0.25), ("q75", 0.75), ("q90", 0.9))], F.max("total").alias("t")).where(F.col("t") >= LEAST)

    def of(state: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("state") == state, value)), F.lit(0))

    totals = units.groupBy(*at).agg(of("present", F.col("n")).alias("tp"), of("not_present", F.col("n")).alias("tn"))
    # each bin spreads to the energies its kernel reaches; then one sum for each energy
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("energy") - REACH), F.least(F.lit(100), F.col("energy") + REACH)))
    spread = units.select(*at, "state", "n", F.col("energy").alias("bin"), near.alias("energy")).withColumn("part", F.col("n") * (REACH + 1 - F.abs(F.col("energy") - F.col("bin"))) / (REACH + 1))
    kernel = spread.groupBy(*at, "energy").agg(of("present", F.col("part")).alias("kp"), of("not_present", F.col("part")).alias("kn"))
    rows = base.join(totals, at).withColumn("energy", F.explode(F.sequence(F.lit(0), F.lit(100)))).join(kernel, [*at, "energy"], "left")
    z = F.greatest(F.lit(0.0), (F.col("energy") - F.col("q90")) / F.greatest(F.lit(2), F.col("q75") - F.col("q25")))

    def density(mass: str, total: str) -> Column:
        return F.ln((F.coalesce(mass, F.lit(0.0)) + 0.5) / (F.col(total) + 50.5))

    likelihood = F.greatest(F.lit(-3.5), F.least(F.lit(3.5), density("kp", "tp") - density("kn", "tn")))
    rows = rows.select(*at, "energy", z.alias("z"), (F.col("tp") >= LEAST).alias("guided"), likelihood.alias("likelihood"))
    rows = rows.withColumn("elevation", F.greatest(F.lit(-0.6), F.least(F.lit(3.5), (F.col("z") - 1) * 1.2)))
    high = F.col("elevation") + F.greatest(F.lit(0.0), F.least(F.lit(0.7), F.col("likelihood") * 0.2))
    found = F.when(~F.col("guided"), F.col("elevation")).when(F.col("elevation") > 0, high).otherwise(F.least("elevation", "likelihood"))
    return rows.select(*at, "energy", "z", "guided", found.alias("evidence"))


@query(with_views("SELECT device, channel, energy, round(z, 6) AS z, guided, round(evidence, 6) AS evidence FROM ce", **EVIDENCE))
def channel_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What each energy of a channel says: robust z over Empty, log density ratio with a triangular kernel of three bins (W13, M2's first half)."""
    return evidence(spark, sf).select("device", "channel", "energy", F.round("z", 6).alias("z"), "guided", F.round("evidence", 6).alias("evidence"))


def _both(score: str) -> str:
    return f"CASE WHEN max({score}) > 0.05 THEN max({score}) + 0.25 * greatest(-1.2, coalesce(avg({score}) FILTER ({score} < -0.05), 0)) ELSE coalesce(avg({score}) FILTER ({score} < -0.05), 0) END::DOUBLE"


_ROW = {"vc": "SELECT device, start_ms, " + "unnest([" + ", ".join(f"{{'channel': {k}, 'energy': {g}}}" for k, g in enumerate(GATES)) + "], recursive := true) FROM v", "ro": "SELECT vc.device, start_ms, vc.channel, vc.energy, ce.evidence FROM vc JOIN ce ON ce.device = vc.device AND ce.channel = vc.channel AND ce.energy = vc.energy"}


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """(device, start_ms, channel, energy, evidence) for each known channel of each row."""
    gates = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.col(g).alias("energy")) for k, g in enumerate(GATES)]))
    rows = vectors(spark, sf).select("device", "start_ms", gates.alias("x")).select("device", "start_ms", "x.channel", "x.energy").where("energy is not null")
    return rows.join(evidence(spark, sf).select("device", "channel", "energy", "evidence"), ["device", "channel", "energy"])


def combined(score: str) -> Column:
    """The strongest positive score and a quarter of the mean opposition, or that alone; scores near nothing say nothing."""
    against = F.coalesce(F.avg(F.when(F.col(score) < -0.05, F.col(score))), F.lit(0.0))
    return F.when(F.max(score) > 0.05, F.max(score) + 0.25 * F.greatest(F.lit(-1.2), against)).otherwise(against)


@query(with_views("SELECT device, start_ms, round(room + CASE WHEN room > 0 THEN least(0.7, greatest(0, coalesce(list_max(list_transform(list_filter(gates, lambda g: abs(g.gate - gates[1].gate) = 1), lambda g: g.score)), 0)) * 0.25) ELSE 0 END, 6)::DOUBLE AS evidence, len(list_filter(gates, lambda g: g.score > 0)) AS active_gates FROM rm", **EVIDENCE, **_ROW,
                  ga=f"SELECT device, start_ms, channel // 2 AS gate, {_both('evidence')} AS score FROM ro GROUP BY ALL", rm=f"SELECT device, start_ms, {_both('score')} AS room, list({{'score': score, 'gate': gate}} ORDER BY score DESC, gate) AS gates FROM ga GROUP BY device, start_ms"))
def room_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Channels combined to gates, gates to the room, and a bonus for a neighbour of the strongest gate (M2)."""
    at = ["device", "start_ms"]
    gates = observed(spark, sf).groupBy(*at, F.floor(F.col("channel") / 2).alias("gate")).agg(combined("evidence").alias("score"))
    rooms = gates.groupBy(*at).agg(combined("score").alias("room"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "gate"))).alias("gates"))
    first = F.col("gates")[0]["gate"]
    beside = F.array_max(F.transform(F.filter("gates", lambda g: F.abs(g["gate"] - first) == 1), lambda g: -g["low"]))
    bonus = F.when(F.col("room") > 0, F.least(F.lit(0.7), F.greatest(F.lit(0.0), F.coalesce(beside, F.lit(0.0))) * 0.25)).otherwise(0.0)
    return rooms.select(*at, F.round(F.col("room") + bonus, 6).alias("evidence"), F.size(F.filter("gates", lambda g: g["low"] < 0)).cast("long").alias("active_gates"))


@query(with_views("SELECT device, start_ms, place, channel, energy, round(evidence, 3)::DOUBLE AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY device, start_ms ORDER BY round(evidence, 3) DESC, channel) AS place FROM ro) WHERE place <= 4", **EVIDENCE, **_ROW))
def top_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The four channels of each row that say most (T5)."""
    line = Window.partitionBy("device", "start_ms").orderBy(F.round("evidence", 3).desc(), "channel")
    rows = observed(spark, sf).withColumn("place", F.row_number().over(line)).where("place <= 4")
    return rows.select("device", "start_ms", "place", "channel", "energy", F.round("evidence", 3).alias("evidence"))
