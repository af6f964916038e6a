"""Detector replay, costs, episodes, diagnostics and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import detector as dt
from tidewell.operators import intervals as iv
from tidewell.plans.registry import query
from tidewell.plans.signals import ALL, GATES, islands, picked, vectors
from tidewell.plans.statistics import last_label
from tidewell.plans.truth import MANUAL, PM
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import MINUTE, SCALE, with_views

E, S = iv.E, iv.S
_SEG = f"SELECT *, max(end_ms) OVER (PARTITION BY device, seg) AS seg_end FROM (SELECT *, sum(fresh) OVER (PARTITION BY device ORDER BY start_ms, end_ms) AS seg FROM (SELECT *, CASE WHEN lag(end_ms) OVER (PARTITION BY device ORDER BY start_ms, end_ms) = start_ms THEN 0 ELSE 1 END AS fresh FROM v WHERE {ALL}))"
_HIT = islands("SELECT device, pattern, seg, seg_end, start_ms, end_ms FROM sg, pat WHERE " + " OR ".join(f"({g} > thresholds[{k + 1}] AND thresholds[{k + 1}] < 100)" for k, g in enumerate(GATES)), "device, pattern, seg, seg_end")


def _merged(src: str, gap: int) -> str:
    return f"SELECT *, sum(fresh) OVER (PARTITION BY device, pattern, seg ORDER BY start_ms, end_ms) AS run FROM (SELECT *, CASE WHEN start_ms <= max(end_ms + {gap}) OVER (PARTITION BY device, pattern, seg ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({src}))"


_HELD = f"SELECT device, pattern, seg, seg_end, min(start_ms) AS start_ms, least(max(end_ms) + {SCALE.timeout}, seg_end) AS end_ms FROM ({_merged('SELECT * FROM ht', SCALE.timeout)}) GROUP BY device, pattern, seg, seg_end, run"
_ACT = f"SELECT * FROM (SELECT device, pattern, seg, seg_end, min(start_ms) FILTER (end_ms - start_ms >= {SCALE.on_delay}) + {SCALE.on_delay} AS start_ms, least(max(end_ms) + {SCALE.off_delay}, seg_end) AS end_ms FROM ({_merged('SELECT * FROM hd', SCALE.off_delay)}) GROUP BY device, pattern, seg, seg_end, run) WHERE start_ms IS NOT NULL AND end_ms > start_ms"
DETECT = {"sg": _SEG, "ht": _HIT, "hd": _HELD, "ac": _ACT}


def found(spark: SparkSession, sf: str) -> DataFrame:
    return dt.hits(dt.segments(vectors(spark, sf), GATES), ad.patterns(spark), GATES)


def active(spark: SparkSession, sf: str) -> DataFrame:
    return dt.activations(vectors(spark, sf), ad.patterns(spark), GATES, SCALE.timeout, SCALE.on_delay, SCALE.off_delay)


@query(with_views("SELECT device, pattern, start_ms, end_ms FROM hd", **DETECT))
def hold_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of every pattern, held."""
    return dt.with_hold(found(spark, sf), SCALE.timeout).select("device", "pattern", S, E)


@query(with_views("SELECT device, pattern, start_ms, end_ms FROM ac", **DETECT))
def on_off_delay(spark: SparkSession, sf: str) -> DataFrame:
    """And filtered by the on and off delays."""
    return active(spark, sf).select("device", "pattern", S, E)


_LP = "SELECT l.device, l.state, l.start_ms AS episode, greatest(l.start_ms, c.start_ms) AS start_ms, least(l.end_ms, c.end_ms) AS end_ms FROM hm l JOIN cv c ON c.device = l.device AND l.start_ms < c.end_ms AND c.start_ms < l.end_ms WHERE l.state <> 'unknown'"
_EP = """SELECT p.device, p.pattern, p.state, p.episode, p.mass, coalesce(s.seen, 0) AS seen, coalesce(t.triggers, 0) AS triggers FROM
    (SELECT device, pattern, state, episode, sum(end_ms - start_ms)::BIGINT AS mass FROM lp, (SELECT pattern FROM pat) GROUP BY ALL) p
    LEFT JOIN (SELECT lp.device, pattern, episode, sum(least(lp.end_ms, ac.end_ms) - greatest(lp.start_ms, ac.start_ms))::BIGINT AS seen FROM lp JOIN ac ON ac.device = lp.device AND ac.start_ms < lp.end_ms AND lp.start_ms < ac.end_ms GROUP BY ALL) s ON s.device = p.device AND s.pattern = p.pattern AND s.episode = p.episode
    LEFT JOIN (SELECT lp.device, pattern, episode, count(*) AS triggers FROM lp JOIN ac ON ac.device = lp.device AND ac.start_ms >= lp.start_ms AND ac.start_ms < lp.end_ms GROUP BY ALL) t ON t.device = p.device AND t.pattern = p.pattern AND t.episode = p.episode"""
COVER = islands("SELECT device, start_ms, end_ms FROM sg", "device")
SCORE = {**DETECT, "pm": PM, "hm": MANUAL, "cv": COVER, "lp": _LP, "ep": _EP}


def covered(spark: SparkSession, sf: str) -> DataFrame:
    """(device, state, episode, start_ms, end_ms): labelled time with coverage; an episode is the label, not the piece."""
    truth = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"]).where("state != 'unknown'").withColumn("episode", F.col(S))
    cover = iv.coalesce(dt.segments(vectors(spark, sf), GATES).select("device", S, E), ["device"])
    return iv.overlap_join(truth, cover, ["device"]).select("device", "state", "episode", S, E)


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """(device, pattern, state, episode, mass, seen, triggers) of every pattern."""
    pieces, on = covered(spark, sf), active(spark, sf).select("device", "pattern", S, E)
    mass = pieces.groupBy("device", "state", "episode").agg(F.sum(F.col(E) - F.col(S)).alias("mass")).crossJoin(F.broadcast(ad.patterns(spark).select("pattern")))
    both = iv.overlap_join(pieces.withColumn("a", F.col(S)), on.withColumn("b", F.col(S)), ["device"])
    seen = both.groupBy("device", "pattern", "episode").agg(F.sum(F.col(E) - F.col(S)).alias("seen"), F.count(F.when(F.col("b") >= F.col("a"), 1)).alias("triggers"))
    rows = mass.join(seen, ["device", "pattern", "episode"], "left")
    return rows.select("device", "pattern", "state", "episode", "mass", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("triggers", F.lit(0)).alias("triggers"))


@query(with_views("SELECT device, pattern, state, episode, mass, seen, triggers, CASE WHEN state = 'present' THEN seen < 0.5 * mass ELSE triggers > 0 OR seen > 0.5 * mass END AS failed, state = 'present' AND seen = 0 AS missed FROM ep", **SCORE))
def episode_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Each labelled episode under each pattern: seen, mostly missed, triggered."""
    present = F.col("state") == "present"
    failed = F.when(present, F.col("seen") < F.col("mass") * 0.5).otherwise((F.col("triggers") > 0) | (F.col("seen") > F.col("mass") * 0.5))
    return episodes(spark, sf).withColumns({"failed": failed, "missed": present & (F.col("seen") == 0)})


_PRIO = "(SELECT device, max(priority) AS m FROM grp GROUP BY device)"
_COST = f"""SELECT e.device, e.pattern, m, sum(mass) FILTER (state = 'present')::BIGINT AS present_ms, sum(mass - seen) FILTER (state = 'present')::BIGINT AS missed_ms, sum(mass) FILTER (state = 'not_present')::BIGINT AS empty_ms, sum(seen) FILTER (state = 'not_present')::BIGINT AS false_ms,
    count(*) FILTER (state = 'present') AS occupied, count(*) FILTER (state = 'present' AND seen < 0.5 * mass) AS mostly, sum(triggers) FILTER (state = 'not_present')::BIGINT AS triggers FROM ep e JOIN {_PRIO} USING (device) GROUP BY ALL"""
_PRICED = "SELECT *, round(100 * (m * (missed_ms / present_ms) + false_ms / empty_ms), 6)::DOUBLE AS cost, round(100 * (m * coalesce(missed_ms / present_ms, 0) + coalesce(false_ms / empty_ms, 0)), 6)::DOUBLE AS partial_cost FROM cs"
PRICE = {**SCORE, "cs": _COST, "cp": _PRICED}


def costs(spark: SparkSession, sf: str) -> DataFrame:
    """Class sums and the cost of each device and pattern: missed presence counts by the highest priority of the device's rooms."""
    weight = ad.groups(spark).groupBy("device").agg(F.max("priority").alias("m"))
    present, empty = F.col("state") == "present", F.col("state") == "not_present"
    total = lambda c, x: F.sum(F.when(c, x))
    rows = episodes(spark, sf).join(F.broadcast(weight), "device").groupBy("device", "pattern", "m").agg(
        total(present, F.col("mass")).alias("present_ms"), total(present, F.col("mass") - F.col("seen")).alias("missed_ms"), total(empty, F.col("mass")).alias("empty_ms"), total(empty, F.col("seen")).alias("false_ms"),
        F.count(F.when(present, 1)).alias("occupied"), F.count(F.when(present & (F.col("seen") < F.col("mass") * 0.5), 1)).alias("mostly"), total(empty, F.col("triggers")).alias("triggers"))
    missed, false = F.col("missed_ms") / F.col("present_ms"), F.col("false_ms") / F.col("empty_ms")
    return rows.withColumn("cost", F.round(100 * (F.col("m") * missed + false), 6)).withColumn("partial_cost", F.round(100 * (F.col("m") * F.coalesce(missed, F.lit(0.0)) + F.coalesce(false, F.lit(0.0))), 6))


@query(with_views("SELECT * FROM cp", **PRICE))
def pattern_cost(spark: SparkSession, sf: str) -> DataFrame:
    """The core cost of every pattern; null unless both classes were observed (A15, A13, L20). Manual time only, without episodes."""
    return costs(spark, sf)


@query(with_views("SELECT device, pattern, CASE WHEN partial_cost = 0 THEN 100.0 ELSE least(99.99, round_even(greatest(0, 100 - partial_cost), 2)) END::DOUBLE AS score FROM cp", **PRICE))
def display_score(spark: SparkSession, sf: str) -> DataFrame:
    """100 only for no cost at all."""
    score = F.least(F.lit(99.99), F.bround(F.greatest(F.lit(0.0), 100 - F.col("partial_cost")), 2))
    return costs(spark, sf).select("device", "pattern", F.when(F.col("partial_cost") == 0, 100.0).otherwise(score).alias("score"))


_RANK = "SELECT *, rank() OVER (PARTITION BY device ORDER BY round(partial_cost, 9)) AS place FROM cp"


@query(with_views("SELECT device, pattern, partial_cost, place FROM rk WHERE place = 1", **PRICE, rk=_RANK))
def best_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest patterns of each device, ties and all."""
    line = Window.partitionBy("device").orderBy(F.round("partial_cost", 9))
    return costs(spark, sf).withColumn("place", F.rank().over(line)).where("place = 1").select("device", "pattern", "partial_cost", "place")


@query(with_views("SELECT a.device, a.pattern, b.partial_cost AS current_cost, a.partial_cost AS candidate_cost, coalesce(a.m * (a.missed_ms / a.present_ms) + a.false_ms / a.empty_ms < b.m * (b.missed_ms / b.present_ms) + b.false_ms / b.empty_ms, false) AS improves FROM cp a JOIN cp b ON b.device = a.device AND b.pattern = 0 WHERE a.pattern <> 0", **PRICE))
def apply_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a candidate is strictly cheaper than what is set, by unrounded cost."""
    rows = costs(spark, sf)
    rows = rows.withColumn("raw", F.col("m") * (F.col("missed_ms") / F.col("present_ms")) + F.col("false_ms") / F.col("empty_ms"))
    now = rows.where("pattern = 0").select("device", F.col("raw").alias("raw0"), F.col("partial_cost").alias("current_cost"))
    better = F.coalesce(F.col("raw") < F.col("raw0"), F.lit(False))
    return rows.where("pattern != 0").join(now, "device").select("device", "pattern", "current_cost", F.col("partial_cost").alias("candidate_cost"), better.alias("improves"))


@query(with_views("""SELECT device, arg_min(pattern, struct_pack(a := round(partial_cost, 9), b := pattern)) AS pattern, min(recall_floor) AS recall_floor, max(margin) AS margin FROM
    (SELECT *, missed_ms / present_ms AS mr, min(missed_ms / present_ms) OVER (PARTITION BY device) AS best, round(min(missed_ms / present_ms) OVER (PARTITION BY device) + 0.25, 6)::DOUBLE AS recall_floor, round(0.5 + 20.0 / greatest(occupied, 1), 6)::DOUBLE AS margin FROM cp WHERE cost IS NOT NULL) WHERE mr <= best + 0.25 GROUP BY device""", **PRICE))
def selection_guards(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest pattern among those that miss little more than the best, and the margin that evidence of so many episodes asks for."""
    line = Window.partitionBy("device")
    rows = costs(spark, sf).where("cost is not null").withColumn("mr", F.col("missed_ms") / F.col("present_ms")).withColumn("best", F.min("mr").over(line))
    rows = rows.where(F.col("mr") <= F.col("best") + 0.25)
    return rows.groupBy("device").agg(F.min_by("pattern", F.struct(F.round("partial_cost", 9), "pattern")).alias("pattern"), F.min(F.round(F.col("best") + 0.25, 6)).alias("recall_floor"), F.max(F.round(0.5 + 20.0 / F.greatest("occupied", F.lit(1)), 6)).alias("margin"))


_SEEN = picked("SELECT device, pattern, start_ms, end_ms FROM lp, (SELECT pattern FROM pat) WHERE state = 'present'", "SELECT device, pattern, start_ms, end_ms FROM ac", "device, pattern", "a > 0 AND b = 0")


def misses(spark: SparkSession, sf: str) -> DataFrame:
    pieces = covered(spark, sf).where("state = 'present'").crossJoin(F.broadcast(ad.patterns(spark).select("pattern")))
    return iv.subtract(pieces, active(spark, sf), ["device", "pattern"])


@query(with_views("SELECT device, pattern, count(*) AS runs, max(end_ms - start_ms) AS longest_ms, sum(end_ms - start_ms)::BIGINT AS missed_ms FROM ms GROUP BY device, pattern", **SCORE, ms=_SEEN))
def longest_miss(spark: SparkSession, sf: str) -> DataFrame:
    """The longest stretch of presence that no activation covers; it may span pieces that adjoin."""
    ms = F.col(E) - F.col(S)
    return misses(spark, sf).groupBy("device", "pattern").agg(F.count(F.lit(1)).alias("runs"), F.max(ms).alias("longest_ms"), F.sum(ms).alias("missed_ms"))


@query(with_views("SELECT device, pattern, start_ms, end_ms, end_ms - start_ms AS ms FROM (SELECT *, row_number() OVER (PARTITION BY device, pattern ORDER BY end_ms - start_ms DESC, start_ms) AS n FROM ms) WHERE n <= 24", **SCORE, ms=_SEEN))
def top_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """The 24 longest misses of each pattern; the earlier wins ties."""
    rows = misses(spark, sf).withColumn("ms", F.col(E) - F.col(S))
    n = F.row_number().over(Window.partitionBy("device", "pattern").orderBy(F.desc("ms"), S))
    return rows.withColumn("n", n).where("n <= 24").drop("n")


@query(with_views("SELECT device, pattern, episode, err, n, round(100.0 * err / sum(err) OVER (PARTITION BY device, pattern), 6)::DOUBLE AS share FROM (SELECT device, pattern, episode, CASE WHEN state = 'present' THEN mass - seen ELSE seen END AS err, row_number() OVER (PARTITION BY device, pattern ORDER BY CASE WHEN state = 'present' THEN mass - seen ELSE seen END DESC, episode) AS n FROM ep) WHERE n <= 6 AND err > 0", **SCORE))
def period_influence(spark: SparkSession, sf: str) -> DataFrame:
    """The six episodes with the most error time, and their part of these."""
    err = F.when(F.col("state") == "present", F.col("mass") - F.col("seen")).otherwise(F.col("seen"))
    rows = episodes(spark, sf).select("device", "pattern", "episode", err.alias("err"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("device", "pattern").orderBy(F.desc("err"), "episode"))).where("n <= 6 and err > 0")
    return rows.withColumn("share", F.round(100.0 * F.col("err") / F.sum("err").over(Window.partitionBy("device", "pattern")), 6))


@query(with_views("SELECT l.device, l.state, sum(l.end_ms - l.start_ms)::BIGINT AS labelled_ms, coalesce(any_value(c.ms), 0)::BIGINT AS covered_ms, sum(l.end_ms - l.start_ms)::BIGINT - coalesce(any_value(c.ms), 0)::BIGINT AS uncovered_ms FROM hm l LEFT JOIN (SELECT device, state, sum(end_ms - start_ms) AS ms FROM lp GROUP BY ALL) c ON c.device = l.device AND c.state = l.state WHERE l.state <> 'unknown' GROUP BY l.device, l.state", **SCORE))
def uncovered_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled time that no usable reading covers."""
    ms = F.sum(F.col(E) - F.col(S))
    all_ = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"]).where("state != 'unknown'").groupBy("device", "state").agg(ms.alias("labelled_ms"))
    part = covered(spark, sf).groupBy("device", "state").agg(ms.alias("c"))
    return all_.join(part, ["device", "state"], "left").select("device", "state", "labelled_ms", F.coalesce("c", F.lit(0)).alias("covered_ms"), (F.col("labelled_ms") - F.coalesce("c", F.lit(0))).alias("uncovered_ms"))


@query(with_views("SELECT m.zone, e.device, e.pattern, sum(mass) FILTER (state = 'present')::BIGINT AS occupied_ms, sum(seen) FILTER (state = 'present')::BIGINT AS seen_ms, sum(seen) FILTER (state = 'not_present')::BIGINT AS false_ms FROM ep e JOIN grp m USING (device) GROUP BY ALL", **SCORE))
def role_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """What each member of a room has seen and falsely reported."""
    present, empty = F.col("state") == "present", F.col("state") == "not_present"
    rows = episodes(spark, sf).join(F.broadcast(ad.groups(spark).select("zone", "device")), "device")
    return rows.groupBy("zone", "device", "pattern").agg(F.sum(F.when(present, F.col("mass"))).alias("occupied_ms"), F.sum(F.when(present, F.col("seen"))).alias("seen_ms"), F.sum(F.when(empty, F.col("seen"))).alias("false_ms"))


@query(with_views("SELECT device, pattern, round(w * auto / (human + w * auto), 6)::DOUBLE AS share FROM (SELECT e.device, e.pattern, 0.5 AS w, sum(mass)::BIGINT AS human, coalesce(any_value(a.ms), 0)::BIGINT AS auto FROM ep e LEFT JOIN (SELECT device, sum(end_ms - start_ms) AS ms FROM gs GROUP BY device) a ON a.device = e.device GROUP BY e.device, e.pattern)", **SCORE))
def influence_share(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the evidence that automatic labels have at half weight."""
    auto = ad.guesses(spark, sf).groupBy("device").agg(F.sum(F.col(E) - F.col(S)).alias("auto"))
    rows = episodes(spark, sf).groupBy("device", "pattern").agg(F.sum("mass").alias("human")).join(auto, "device", "left")
    w = F.coalesce("auto", F.lit(0)) * 0.5
    return rows.select("device", "pattern", F.round(w / (F.col("human") + w), 6).alias("share"))


_RUN = "SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY device) AS total, count(*) FILTER (state = 'present') OVER w AS p, count(*) FILTER (state = 'present') OVER (PARTITION BY device) AS pt FROM hm WHERE state <> 'unknown' WINDOW w AS (PARTITION BY device ORDER BY start_ms)"


@query(with_views("SELECT device, arg_min(end_ms, struct_pack(a := abs(5 * n - 4 * total), b := end_ms)) AS cut_ms FROM rn WHERE p > 0 AND pt - p > 0 AND n - p > 0 AND total - n - (pt - p) > 0 GROUP BY device", pm=PM, hm=MANUAL, rn=_RUN))
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    """The cut nearest to four fifths of the episodes that leaves both states on both sides."""
    rows = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"]).where("state != 'unknown'")
    all_, line = Window.partitionBy("device"), Window.partitionBy("device").orderBy(S)
    yes = F.count(F.when(F.col("state") == "present", 1))
    rows = rows.withColumns({"n": F.row_number().over(line), "total": F.count(F.lit(1)).over(all_), "p": yes.over(line), "pt": yes.over(all_)})
    rows = rows.where("p > 0 and pt - p > 0 and n - p > 0 and total - n - (pt - p) > 0")
    return rows.groupBy("device").agg(F.min_by(E, F.struct(F.abs(5 * F.col("n") - 4 * F.col("total")), E)).alias("cut_ms"))


@query(with_views("SELECT device, state, max(end_ms - (want - before)) AS cut_ms FROM (SELECT *, total // 5 AS want FROM (SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY device, state ORDER BY start_ms DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(end_ms - start_ms) OVER (PARTITION BY device, state)::BIGINT AS total FROM hm WHERE state <> 'unknown')) WHERE before < want AND before + end_ms - start_ms >= want GROUP BY device, state", pm=PM, hm=MANUAL))
def newest_share_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Where the newest fifth of each class begins, inside a piece."""
    rows = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"]).where("state != 'unknown'")
    line, ms = Window.partitionBy("device", "state"), F.col(E) - F.col(S)
    before = F.coalesce(F.sum(ms).over(line.orderBy(F.desc(S)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"before": before, "total": F.sum(ms).over(line)}).withColumn("want", F.expr("total div 5")).where((F.col("before") < F.col("want")) & (F.col("before") + ms >= F.col("want")))
    return rows.groupBy("device", "state").agg(F.max(F.col(E) - (F.col("want") - F.col("before"))).alias("cut_ms"))


TIMEOUTS = [2, 5, 10, 15, 20, 30, 45, 60, 90]
_TO = f"SELECT device, timeout, min(start_ms) AS start_ms, max(end_ms) + timeout * {MINUTE} AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY device, timeout ORDER BY start_ms) AS run FROM (SELECT *, CASE WHEN start_ms <= max(end_ms + timeout * {MINUTE}) OVER (PARTITION BY device, timeout ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT device, start_ms, end_ms, unnest({TIMEOUTS}) AS timeout FROM ht WHERE pattern = 0))) GROUP BY device, timeout, run"
_TP = "SELECT device, timeout, state, start_ms, end_ms FROM lp, (SELECT unnest(" + str(TIMEOUTS) + ") AS timeout)"


def _at_timeouts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    times = F.explode(F.array(*map(F.lit, TIMEOUTS))).alias("timeout")
    hits = found(spark, sf).where("pattern = 0").select("device", S, E, times)
    on = iv.held(hits, ["device", "timeout"], F.col("timeout") * MINUTE).withColumn(E, F.col(E) + F.col("timeout") * MINUTE)
    return on, covered(spark, sf).select("device", "state", S, E, times)


@query(with_views("SELECT device, timeout, dark, missed_ms, coalesce(false_ms, 0)::BIGINT AS false_ms FROM (SELECT device, timeout, count(*) AS dark, sum(end_ms - start_ms)::BIGINT AS missed_ms FROM dk GROUP BY ALL) LEFT JOIN (SELECT device, timeout, sum(end_ms - start_ms) AS false_ms FROM fl GROUP BY ALL) USING (device, timeout)", **SCORE, tt=_TO, tp=_TP,
                  dk=picked("SELECT device, timeout, start_ms, end_ms FROM tp WHERE state = 'present'", "SELECT device, timeout, start_ms, end_ms FROM tt", "device, timeout", "a > 0 AND b = 0"), fl=picked("SELECT device, timeout, start_ms, end_ms FROM tp WHERE state = 'not_present'", "SELECT device, timeout, start_ms, end_ms FROM tt", "device, timeout", "a > 0 AND b > 0")))
def timeout_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Nine timeouts priced at once: dark spells, missed and false time."""
    on, truth = _at_timeouts(spark, sf)
    keys, ms = ["device", "timeout"], F.sum(F.col(E) - F.col(S))
    dark = iv.subtract(truth.where("state = 'present'"), on, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("dark"), ms.alias("missed_ms"))
    false = iv.intersect(truth.where("state = 'not_present'"), on, keys).groupBy(*keys).agg(ms.alias("f"))
    return dark.join(false, keys, "left").select(*keys, "dark", "missed_ms", F.coalesce("f", F.lit(0)).alias("false_ms"))


@query(with_views("SELECT device, min(timeout) AS timeout FROM (SELECT *, max(missed_ms) OVER (PARTITION BY device) AS worst, min(missed_ms) OVER (PARTITION BY device) AS best FROM (SELECT device, timeout, sum(end_ms - start_ms)::BIGINT AS missed_ms FROM dk GROUP BY ALL)) WHERE 5 * (worst - missed_ms) >= 4 * (worst - best) GROUP BY device", **SCORE, tt=_TO, tp=_TP, dk=picked("SELECT device, timeout, start_ms, end_ms FROM tp WHERE state = 'present'", "SELECT device, timeout, start_ms, end_ms FROM tt", "device, timeout", "a > 0 AND b = 0")))
def timeout_suggestion(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest timeout that keeps four fifths of the best saving."""
    on, truth = _at_timeouts(spark, sf)
    rows = iv.subtract(truth.where("state = 'present'"), on, ["device", "timeout"]).groupBy("device", "timeout").agg(F.sum(F.col(E) - F.col(S)).alias("missed_ms"))
    line = Window.partitionBy("device")
    rows = rows.withColumns({"worst": F.max("missed_ms").over(line), "best": F.min("missed_ms").over(line)})
    return rows.where("5 * (worst - missed_ms) >= 4 * (worst - best)").groupBy("device").agg(F.min("timeout").alias("timeout"))
