"""Rules that decide: the whole cost, levels of room truth, the timeout's price, lowering for presence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import detector as dt
from tidewell.operators import intervals as iv
from tidewell.plans.learning import DOMAIN, vector_multiplicity
from tidewell.plans.registry import query
from tidewell.plans.scoring import _TO, _TP, SCORE, _at_timeouts, active, covered, episodes
from tidewell.plans.signals import GATES, holds, islands, picked, vectors
from tidewell.plans.statistics import LAST, PIECES, last_label
from tidewell.plans.truth import MANUAL, NOW, PM, overlaid
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import DAY, with_views

E, S = iv.E, iv.S
#: Fixed values of the rules.
MISSED_WEIGHT = 5.0
AUTO_WEIGHT = 0.5
AUTO_CLASS_CAP = 0.25
PRESENCE_PRICE = 50.0
FALSE_TRIGGER_MS = 30_000
PRESENCE_SHIFTS = (1, 2, 3, 4, 6, 8, 12)
PRESENCE_ROUNDS = 12
LEAST_PRESENCE_MS = 600_000
DENSITY_PRIOR = 0.01
LIKELIHOOD_RATIO = 2.0
LOWER_QUANTILE = 0.1


def total(condition: Column, value: str) -> Column:
    return F.sum(F.when(condition, F.col(value)))


# ------------------------------------------------------------------ the cost of both sources

#: Automatic time is what guesses cover and no human label does; a guess counts by its confidence in twentieths, a human label by all twenty.
_FREE = picked("SELECT device, start_ms, end_ms FROM gs", "SELECT device, start_ms, end_ms FROM hm", "device", "a > 0 AND b = 0")
_BOTH = """SELECT device, state, 'human' AS source, episode, 20 AS level, start_ms, end_ms FROM lp UNION ALL
    SELECT g.device, g.state, 'automatic', g.start_ms, g.level, greatest(g.start_ms, f.start_ms, c.start_ms), least(g.end_ms, f.end_ms, c.end_ms) FROM gs g JOIN fr f ON f.device = g.device AND f.start_ms < g.end_ms AND g.start_ms < f.end_ms
    JOIN cv c ON c.device = g.device AND c.start_ms < least(g.end_ms, f.end_ms) AND greatest(g.start_ms, f.start_ms) < c.end_ms"""
_EPISODE = """SELECT p.*, coalesce(s.seen, 0)::BIGINT AS seen, coalesce(s.triggers, 0)::BIGINT AS triggers FROM
    (SELECT device, pattern, state, source, episode, level, sum(end_ms - start_ms)::BIGINT AS mass FROM bs, (SELECT pattern FROM pat) GROUP BY ALL) p LEFT JOIN
    (SELECT b.device, a.pattern, b.source, b.episode, sum(least(b.end_ms, a.end_ms) - greatest(b.start_ms, a.start_ms)) AS seen, count(*) FILTER (a.start_ms >= b.start_ms) AS triggers FROM bs b JOIN ac a ON a.device = b.device AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY ALL) s USING (device, pattern, source, episode)"""
_SUMS = """SELECT device, pattern, state, {each} FROM (SELECT *, CASE WHEN state = 'present' THEN mass - seen ELSE seen END AS err, CASE WHEN state = 'present' THEN 2 * seen < mass ELSE triggers > 0 OR 2 * seen > mass END AS failed FROM e2) GROUP BY device, pattern, state"""
_EACH = ", ".join(f"coalesce(sum({x}) FILTER (source = '{s}'), 0)::BIGINT AS {n}_{s}" for s in ("human", "automatic") for n, x in (("t", "mass * level"), ("e", "err * level"), ("m", "level"), ("f", "CASE WHEN failed THEN level ELSE 0 END")))
_FACTOR = f"{AUTO_WEIGHT * AUTO_CLASS_CAP}::DOUBLE"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0::DOUBLE END"


def _class_rate(err: str, mass: str) -> str:
    human, auto = _rate(f"{err}_human", f"{mass}_human"), _rate(f"{err}_automatic", f"{mass}_automatic")
    share = f"{_FACTOR} * least(1::DOUBLE, CASE WHEN {mass}_human > 0 THEN {mass}_automatic::DOUBLE / {mass}_human ELSE 1::DOUBLE END)"
    return f"CASE WHEN t_human = 0 THEN {auto} ELSE {human} + {share} * ({auto}) END"


_CLASS = f"SELECT device, pattern, state, {_class_rate('e', 't')} AS time_rate, {_class_rate('f', 'm')} AS episode_rate FROM sm"
_WHOLE = f"""SELECT device, pattern, m, {", ".join(f"coalesce(max({c}) FILTER (state = '{s}'), 0) AS {n}" for s, x in (('present', 'present'), ('not_present', 'empty')) for c, n in (('time_rate', f'{x}_time'), ('episode_rate', f'{x}_episode')))}, count(*) AS classes
    FROM cl JOIN (SELECT device, max(priority) * {MISSED_WEIGHT}::DOUBLE AS m FROM grp GROUP BY device) USING (device) GROUP BY device, pattern, m"""
_ALL_COST = "100 * ((m * present_time + empty_time) + (m * present_episode + empty_episode))"


def _all_pieces(spark: SparkSession, sf: str) -> DataFrame:
    human = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"])
    cover = iv.coalesce(dt.segments(vectors(spark, sf), GATES).select("device", S, E), ["device"])
    guesses = ad.guesses(spark, sf)
    free = iv.intersect(iv.subtract(guesses, human, ["device"]), cover, ["device"])
    runs = guesses.select("device", "state", F.lit("automatic").alias("source"), F.col(S).alias("episode"), "level", S, E)
    own = covered(spark, sf).select("device", "state", F.lit("human").alias("source"), "episode", F.lit(20).alias("level"), S, E)
    return own.unionByName(iv.overlap_join(runs, free, ["device"]))


@query(with_views(f"SELECT device, pattern, round(present_time, 6)::DOUBLE AS present_time, round(present_episode, 6)::DOUBLE AS present_episode, round(empty_time, 6)::DOUBLE AS empty_time, round(empty_episode, 6)::DOUBLE AS empty_episode, CASE WHEN classes = 2 THEN round({_ALL_COST}, 6) END::DOUBLE AS cost, round({_ALL_COST}, 6)::DOUBLE AS partial_cost FROM wh",
                  **SCORE, fr=_FREE, bs=_BOTH, e2=_EPISODE, sm=_SUMS.format(each=_EACH), cl=_CLASS, wh=_WHOLE))
def core_cost(spark: SparkSession, sf: str) -> DataFrame:
    """The cost by time and by episodes, of human and automatic evidence (A15, A17): per class and source the weighted time, its error, the mass of
    episodes and of failed ones. Automatic evidence counts by its weight, at most a quarter, and less where it has less mass than the human; a class
    without human evidence is decided by the automatic. All sums are integers. Automatic Present is held to all detections, not to supported energies.
    """
    pieces, on = _all_pieces(spark, sf), active(spark, sf).select("device", "pattern", S, E)
    keys = ["device", "state", "source", "episode", "level"]
    mass = pieces.groupBy(*keys).agg(F.sum(F.col(E) - F.col(S)).alias("mass")).crossJoin(F.broadcast(ad.patterns(spark).select("pattern")))
    met = iv.overlap_join(pieces.withColumn("a", F.col(S)), on.withColumn("b", F.col(S)), ["device"]).groupBy("device", "pattern", "source", "episode")
    met = met.agg(F.sum(F.col(E) - F.col(S)).alias("x"), F.count(F.when(F.col("b") >= F.col("a"), 1)).alias("y"))
    rows = mass.join(met, ["device", "pattern", "source", "episode"], "left").withColumns({"seen": F.coalesce("x", F.lit(0)), "triggers": F.coalesce("y", F.lit(0))})
    present = F.col("state") == "present"
    rows = rows.withColumns({"err": F.when(present, F.col("mass") - F.col("seen")).otherwise(F.col("seen")), "failed": F.when(present, 2 * F.col("seen") < F.col("mass")).otherwise((F.col("triggers") > 0) | (2 * F.col("seen") > F.col("mass")))})
    values = {"t": F.col("mass") * F.col("level"), "e": F.col("err") * F.col("level"), "m": F.col("level"), "f": F.when(F.col("failed"), F.col("level")).otherwise(0)}
    sums = rows.groupBy("device", "pattern", "state").agg(*[F.coalesce(F.sum(F.when(F.col("source") == s, v)), F.lit(0)).alias(f"{n}_{s}") for s in ("human", "automatic") for n, v in values.items()])

    def rate(err: str, of: str, source: str) -> Column:
        return F.when(F.col(f"{of}_{source}") > 0, F.col(f"{err}_{source}") / F.col(f"{of}_{source}")).otherwise(0.0)

    def class_rate(err: str, of: str) -> Column:
        ratio = F.when(F.col(f"{of}_human") > 0, F.col(f"{of}_automatic") / F.col(f"{of}_human")).otherwise(1.0)
        both = rate(err, of, "human") + F.lit(AUTO_WEIGHT * AUTO_CLASS_CAP) * F.least(F.lit(1.0), ratio) * rate(err, of, "automatic")
        return F.when(F.col("t_human") == 0, rate(err, of, "automatic")).otherwise(both)

    rates = sums.select("device", "pattern", "state", class_rate("e", "t").alias("time"), class_rate("f", "m").alias("episode"))
    at = lambda s, c: F.coalesce(F.max(F.when(F.col("state") == s, F.col(c))), F.lit(0.0))
    whole = rates.groupBy("device", "pattern").agg(at("present", "time").alias("present_time"), at("present", "episode").alias("present_episode"), at("not_present", "time").alias("empty_time"), at("not_present", "episode").alias("empty_episode"), F.count(F.lit(1)).alias("classes"))
    weight = ad.groups(spark).groupBy("device").agg((F.max("priority") * MISSED_WEIGHT).alias("m"))
    cost = F.round(100 * ((F.col("m") * F.col("present_time") + F.col("empty_time")) + (F.col("m") * F.col("present_episode") + F.col("empty_episode"))), 6)
    parts = [F.round(c, 6).alias(c) for c in ("present_time", "present_episode", "empty_time", "empty_episode")]
    return whole.join(F.broadcast(weight), "device").select("device", "pattern", *parts, F.when(F.col("classes") == 2, cost).alias("cost"), cost.alias("partial_cost"))


# ------------------------------------------------------------------ levels of a room's truth


def _flags(src: str, keys: str, **names: str) -> str:
    """SQL of +1 and -1 edges with a column per condition."""
    parts = ", ".join(f"unnest([1, -1]) * coalesce(({c})::INT, 0) AS {n}" for n, c in names.items())
    return f"SELECT {keys}, unnest([start_ms, end_ms]) AS t, {parts} FROM ({src})"


def _depths(edges: str, keys: str, names: list[str]) -> str:
    inner = f"SELECT {keys}, t, " + ", ".join(f"sum({n}) AS {n}" for n in names) + f" FROM ({edges}) GROUP BY {keys}, t"
    return f"SELECT * FROM (SELECT {keys}, t AS start_ms, lead(t) OVER w AS end_ms, " + ", ".join(f"sum({n}) OVER w AS {n}" for n in names) + f" FROM ({inner}) WINDOW w AS (PARTITION BY {keys} ORDER BY t)) WHERE end_ms IS NOT NULL"


_KINDS = ["p", "q", "u", "gp", "gq"]
_DEVICE_EDGES = " UNION ALL ".join([
    _flags("SELECT * FROM hm", "device", p="state = 'present'", q="state = 'not_present'", u="state = 'unknown'", gp="false", gq="false"),
    _flags("SELECT * FROM gs", "device", p="false", q="false", u="false", gp="state = 'present'", gq="state = 'not_present'"),
])
_MEMBER = f"SELECT device, start_ms, end_ms, CASE WHEN p > 0 THEN 'p' WHEN q > 0 THEN 'q' WHEN u > 0 THEN 'u' WHEN gp > 0 THEN 'gp' WHEN gq > 0 THEN 'gq' END AS kind FROM ({_depths(_DEVICE_EDGES, 'device', _KINDS)})"
_ROOM_KINDS = ["op", "oq", "ou", "sp_", "sq", *_KINDS]


def _room_flags(src: str, **names: str) -> str:
    return _flags(src, "zone", **{n: names.get(n, "false") for n in _ROOM_KINDS})


_ROOM_EDGES = " UNION ALL ".join([
    _room_flags("SELECT * FROM ro", op="state = 'present'", oq="state = 'not_present'", ou="state = 'unknown'"),
    _room_flags("SELECT * FROM rs", sp_="state = 'present'", sq="state = 'not_present'"),
    _room_flags("SELECT zone, start_ms, end_ms, kind FROM me JOIN grp USING (device)", **{k: f"kind = '{k}'" for k in _KINDS}),
])
_DERIVED = "CASE WHEN p + gp > 0 THEN 'present' WHEN q + gq = n THEN 'not_present' END"
_DECIDED = f"""SELECT zone, start_ms, end_ms, CASE WHEN op > 0 THEN 'present' WHEN oq > 0 THEN 'not_present' WHEN ou > 0 THEN NULL WHEN p > 0 THEN 'present' WHEN q = n THEN 'not_present' WHEN u > 0 THEN {_DERIVED} WHEN sp_ > 0 THEN 'present' WHEN sq > 0 THEN 'not_present' ELSE {_DERIVED} END AS state,
    CASE WHEN op + oq > 0 THEN 'own' WHEN p > 0 OR q = n THEN 'members' WHEN u = 0 AND sp_ + sq > 0 THEN 'sensor' ELSE 'guesses' END AS source FROM ({_depths(_ROOM_EDGES, 'zone', _ROOM_KINDS)}) JOIN (SELECT zone, count(*) AS n FROM grp GROUP BY zone) USING (zone)"""
LEVELS = {
    "pm": PM, "hm": MANUAL, "me": _MEMBER, "ro": overlaid("SELECT zone, start_ms, end_ms, state, ord FROM rlab WHERE source = 'manual'", "zone", "l.ord", "state"),
    "rs": overlaid("SELECT zone, start_ms, end_ms, state, ord FROM rlab WHERE source = 'sensor'", "zone", "l.ord", "state"),
}


@query(with_views(islands(f"SELECT * FROM ({_DECIDED}) WHERE state IS NOT NULL", "zone", "state, source"), **LEVELS))
def room_levels(spark: SparkSession, sf: str) -> DataFrame:
    """A room's truth level by level (L9): its own human label (Unknown is no truth); its members' own labels, one Present or all Empty; the room's
    sensor, unless a member is labelled Unknown; what members' labels and guesses give together. Two sweeps, one by device and one by room, and no join
    in time. Areas have no labels in these tables, so the levels of an enclosing or an enclosed room never speak, and an estimate of the same guesses adds none.
    """
    human = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"])
    is_ = lambda s: (F.col("state") == s).cast("int")
    none = F.lit(0)
    rows = human.select("device", S, E, is_("present").alias("p"), is_("not_present").alias("q"), is_("unknown").alias("u"), none.alias("gp"), none.alias("gq"))
    rows = rows.unionByName(ad.guesses(spark, sf).select("device", S, E, none.alias("p"), none.alias("q"), none.alias("u"), is_("present").alias("gp"), is_("not_present").alias("gq")))
    deep = iv.depth(rows, ["device"], **{k: F.col(k) for k in _KINDS})
    kind = F.coalesce(*[F.when(F.col(k) > 0, F.lit(k)) for k in _KINDS])
    members = deep.withColumn("kind", kind).join(F.broadcast(ad.groups(spark).select("zone", "device")), "device")
    own, sensor = (last_label(ad.room_labels(spark, sf).where(F.col("source") == s), ["zone"]) for s in ("manual", "sensor"))

    def flags(df: DataFrame, **names: Column) -> DataFrame:
        return df.select("zone", S, E, *[F.coalesce(names.get(k, none), none).alias(k) for k in _ROOM_KINDS])

    edges = flags(own, op=is_("present"), oq=is_("not_present"), ou=is_("unknown")).unionByName(flags(sensor, sp_=is_("present"), sq=is_("not_present")))
    edges = edges.unionByName(flags(members, **{k: (F.col("kind") == k).cast("int") for k in _KINDS}))
    sizes = F.broadcast(ad.groups(spark).groupBy("zone").agg(F.count(F.lit(1)).alias("n")))
    c = F.col
    derived = F.when(c("p") + c("gp") > 0, "present").when(c("q") + c("gq") == c("n"), "not_present")
    state = F.when(c("op") > 0, "present").when(c("oq") > 0, "not_present").when(c("ou") > 0, None).when(c("p") > 0, "present").when(c("q") == c("n"), "not_present")
    state = state.when(c("u") > 0, derived).when(c("sp_") > 0, "present").when(c("sq") > 0, "not_present").otherwise(derived)
    source = F.when(c("op") + c("oq") > 0, "own").when((c("p") > 0) | (c("q") == c("n")), "members").when((c("u") == 0) & (c("sp_") + c("sq") > 0), "sensor").otherwise("guesses")
    decided = iv.depth(edges, ["zone"], **{k: c(k) for k in _ROOM_KINDS}).join(sizes, "zone").select("zone", S, E, state.alias("state"), source.alias("source"))
    return iv.coalesce(decided.where("state is not null"), ["zone"], ["state", "source"])


# ------------------------------------------------------------------ windows, influence, timeouts

_DAYS = [1, 3, 7]


@query(with_views(f"""SELECT m.zone, p.device, p.pattern, p.days, occupied_ms, empty_ms, coalesce(seen_ms, 0)::BIGINT AS seen_ms, coalesce(false_ms, 0)::BIGINT AS false_ms FROM
    (SELECT device, pattern, days, coalesce(sum(end_ms - start_ms) FILTER (state = 'present'), 0)::BIGINT AS occupied_ms, coalesce(sum(end_ms - start_ms) FILTER (state = 'not_present'), 0)::BIGINT AS empty_ms FROM dw, (SELECT pattern FROM pat) GROUP BY ALL) p LEFT JOIN
    (SELECT d.device, a.pattern, d.days, sum(least(d.end_ms, a.end_ms) - greatest(d.start_ms, a.start_ms)) FILTER (state = 'present') AS seen_ms, sum(least(d.end_ms, a.end_ms) - greatest(d.start_ms, a.start_ms)) FILTER (state = 'not_present') AS false_ms FROM dw d JOIN ac a ON a.device = d.device AND a.start_ms < d.end_ms AND d.start_ms < a.end_ms GROUP BY ALL) s USING (device, pattern, days)
    JOIN grp m ON m.device = p.device""", **SCORE, dw=f"SELECT device, state, days, greatest(start_ms, {NOW} - days * {DAY}) AS start_ms, least(end_ms, {NOW}) AS end_ms FROM lp, (SELECT unnest({_DAYS}) AS days) WHERE end_ms > {NOW} - days * {DAY} AND start_ms < {NOW}"))
def room_assessment(spark: SparkSession, sf: str) -> DataFrame:
    """What each member of a room saw and falsely reported in the last day, three days and week (G27). Pieces meet activations once, over the week; the windows only clip."""
    week = iv.clip(covered(spark, sf), NOW - max(_DAYS) * DAY, NOW).select("device", "state", S, E)
    days = F.explode(F.array(*map(F.lit, _DAYS))).alias("days")

    def windows(df: DataFrame, *columns: str) -> DataFrame:
        rows = df.select(*columns, S, E, days).withColumn(S, F.greatest(F.col(S), F.lit(NOW) - F.col("days") * F.lit(DAY)))
        return rows.where(F.col(E) > F.col(S)).withColumn("ms", F.col(E) - F.col(S))

    present, empty = F.col("state") == "present", F.col("state") == "not_present"
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    all_ = windows(week, "device", "state").groupBy("device", "days").agg(zero(total(present, "ms"), "occupied_ms"), zero(total(empty, "ms"), "empty_ms")).crossJoin(F.broadcast(ad.patterns(spark).select("pattern")))
    met = iv.overlap_join(week, active(spark, sf).select("device", "pattern", S, E), ["device"])
    met = windows(met, "device", "state", "pattern").groupBy("device", "pattern", "days").agg(total(present, "ms").alias("seen"), total(empty, "ms").alias("false"))
    rows = all_.join(met, ["device", "pattern", "days"], "left").join(F.broadcast(ad.groups(spark).select("zone", "device")), "device")
    return rows.select("zone", "device", "pattern", "days", "occupied_ms", "empty_ms", zero(F.col("seen"), "seen_ms"), zero(F.col("false"), "false_ms"))


@query(with_views("""SELECT device, pattern, episode, state, err AS error_ms, round(100.0::DOUBLE * err / class_err, 6)::DOUBLE AS share, CASE WHEN state = 'not_present' AND empty_ms > mass THEN round(0 - 100.0::DOUBLE * (class_err - err) / (empty_ms - mass), 6) END::DOUBLE AS score_without FROM
    (SELECT *, sum(err) OVER (PARTITION BY device, pattern, state)::BIGINT AS class_err, (sum(mass) FILTER (state = 'not_present') OVER (PARTITION BY device, pattern))::BIGINT AS empty_ms, row_number() OVER (PARTITION BY device, pattern ORDER BY err DESC, episode, state) AS n FROM (SELECT *, CASE WHEN state = 'present' THEN mass - seen ELSE seen END::BIGINT AS err FROM ep)) WHERE n <= 6 AND err > 0""", **SCORE))
def influence_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The six periods with the most error time, each one's part of its class's error, and the false rate as a score without an Empty one."""
    err = F.when(F.col("state") == "present", F.col("mass") - F.col("seen")).otherwise(F.col("seen"))
    one = Window.partitionBy("device", "pattern")
    rows = episodes(spark, sf).withColumn("error_ms", err)
    rows = rows.withColumns({"class_err": F.sum("error_ms").over(Window.partitionBy("device", "pattern", "state")), "empty_ms": total(F.col("state") == "not_present", "mass").over(one), "n": F.row_number().over(one.orderBy(F.desc("error_ms"), "episode", "state"))})
    rows = rows.where("n <= 6 and error_ms > 0")
    without = F.when((F.col("state") == "not_present") & (F.col("empty_ms") > F.col("mass")), F.round(0 - 100.0 * (F.col("class_err") - F.col("error_ms")) / (F.col("empty_ms") - F.col("mass")), 6))
    return rows.select("device", "pattern", "episode", "state", "error_ms", F.round(100.0 * F.col("error_ms") / F.col("class_err"), 6).alias("share"), without.alias("score_without"))


_PRICE = f"""SELECT t.device, t.timeout, {PRESENCE_PRICE}::DOUBLE * m * coalesce(missed, 0) + coalesce(false_ms, 0) + {FALSE_TRIGGER_MS} * coalesce(starts, 0) AS cost FROM
    (SELECT device, timeout FROM tp WHERE state = 'present' GROUP BY ALL HAVING sum(end_ms - start_ms) >= {LEAST_PRESENCE_MS}) t JOIN (SELECT device, max(priority) AS m FROM grp GROUP BY device) USING (device)
    LEFT JOIN (SELECT device, timeout, sum(end_ms - start_ms)::BIGINT AS missed FROM dk GROUP BY ALL) USING (device, timeout) LEFT JOIN (SELECT device, timeout, sum(end_ms - start_ms)::BIGINT AS false_ms FROM fl GROUP BY ALL) USING (device, timeout)
    LEFT JOIN (SELECT tt.device, tt.timeout, count(*) AS starts FROM tt JOIN tp ON tp.device = tt.device AND tp.timeout = tt.timeout AND tp.state = 'not_present' AND tp.start_ms <= tt.start_ms AND tt.start_ms < tp.end_ms GROUP BY ALL) USING (device, timeout)"""


@query(with_views("SELECT device, min(timeout) FILTER (100 * (base - best) < 3 * base OR 5 * (base - cost) >= 4 * (base - best)) AS timeout, min(base) AS shortest_cost, min(best) AS best_cost FROM (SELECT *, first_value(cost) OVER (PARTITION BY device ORDER BY timeout) AS base, min(cost) OVER (PARTITION BY device) AS best FROM px) GROUP BY device", **SCORE, tt=_TO, tp=_TP,
                  dk=picked("SELECT device, timeout, start_ms, end_ms FROM tp WHERE state = 'present'", "SELECT device, timeout, start_ms, end_ms FROM tt", "device, timeout", "a > 0 AND b = 0"), fl=picked("SELECT device, timeout, start_ms, end_ms FROM tp WHERE state = 'not_present'", "SELECT device, timeout, start_ms, end_ms FROM tt", "device, timeout", "a > 0 AND b > 0"), px=_PRICE))
def timeout_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The timeout by price (G21): missed presence at fifty times the room's priority, false time, and thirty seconds for each false start. The shortest that keeps
    four fifths of the best saving; the shortest of all where that saves less than three per cent; none with less than ten minutes of presence. One device at a time.
    """
    on, truth = _at_timeouts(spark, sf)
    keys, ms = ["device", "timeout"], F.sum(F.col(E) - F.col(S))
    present, empty = truth.where("state = 'present'"), truth.where("state = 'not_present'")
    rows = present.groupBy(*keys).agg(ms.alias("observed")).where(F.col("observed") >= LEAST_PRESENCE_MS)
    missed = iv.subtract(present, on, keys).groupBy(*keys).agg(ms.alias("missed"))
    false = iv.intersect(empty, on, keys).groupBy(*keys).agg(ms.alias("false"))
    starts = iv.at_time(on.select(*keys, F.col(S).alias("at")), empty.select(*keys, S, E), keys, "at").groupBy(*keys).agg(F.count(F.lit(1)).alias("starts"))
    for more in (missed, false, starts):
        rows = rows.join(more, keys, "left")
    weight = ad.groups(spark).groupBy("device").agg(F.max("priority").alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    line = Window.partitionBy("device")
    rows = rows.join(F.broadcast(weight), "device").withColumn("cost", PRESENCE_PRICE * F.col("m") * zero("missed") + zero("false") + FALSE_TRIGGER_MS * zero("starts"))
    rows = rows.withColumns({"base": F.first("cost").over(line.orderBy("timeout")), "best": F.min("cost").over(line)})
    fits = (100 * (F.col("base") - F.col("best")) < 3 * F.col("base")) | (5 * (F.col("base") - F.col("cost")) >= 4 * (F.col("base") - F.col("best")))
    return rows.groupBy("device").agg(F.min(F.when(fits, F.col("timeout"))).alias("timeout"), F.min("base").alias("shortest_cost"), F.min("best").alias("best_cost"))


# ------------------------------------------------------------------ energies by episode

_EH = "SELECT s.device, s.channel, l.state, l.start_ms AS episode, s.energy, sum(least(s.end_ms, l.end_ms) - greatest(s.start_ms, l.start_ms))::BIGINT AS ms FROM sp s JOIN ll l ON l.device = s.device AND s.start_ms < l.end_ms AND l.start_ms < s.end_ms WHERE s.energy IS NOT NULL AND l.state <> 'unknown' GROUP BY ALL"
_DENSITY = "SELECT device, channel, energy, count(*) FILTER (state = 'present') AS occupied_episodes, coalesce(sum(d) FILTER (state = 'present'), 0) AS p, coalesce(sum(d) FILTER (state = 'not_present'), 0) AS q FROM (SELECT *, ms::DOUBLE / sum(ms) OVER (PARTITION BY device, channel, state, episode)::BIGINT AS d FROM eh) GROUP BY ALL"
_NUMBER = "SELECT device, channel, count(DISTINCT episode) FILTER (state = 'present') AS np, count(DISTINCT episode) FILTER (state = 'not_present') AS nq FROM eh GROUP BY ALL"
_MEAN = "SELECT device, channel, energy, occupied_episodes, round(coalesce(p / nullif(np, 0), 0), 9)::DOUBLE AS p, round(coalesce(q / nullif(nq, 0), 0), 9)::DOUBLE AS q, np, nq FROM dn_ JOIN nu USING (device, channel)"
_NEAR = "SELECT *, round(sum(p) OVER near, 6)::DOUBLE AS present_density, round(sum(q) OVER near, 6)::DOUBLE AS empty_density, round(sum(p) OVER (PARTITION BY device, channel ORDER BY energy), 6)::DOUBLE AS cum FROM mn WINDOW near AS (PARTITION BY device, channel ORDER BY energy RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_LIKELY = f"np > 0 AND nq > 0 AND energy + 3 >= lowest AND present_density + {DENSITY_PRIOR}::DOUBLE > {LIKELIHOOD_RATIO}::DOUBLE * (empty_density + {DENSITY_PRIOR}::DOUBLE)"


@query(with_views(f"SELECT device, channel, energy, occupied_episodes, present_density, empty_density, occupied_episodes >= 2 AS supported, coalesce({_LIKELY}, false) AS likely FROM (SELECT *, min(energy) FILTER (cum >= {LOWER_QUANTILE}) OVER (PARTITION BY device, channel) AS lowest FROM nr)", pc=PIECES, ll=LAST, eh=_EH, dn_=_DENSITY, nu=_NUMBER, mn=_MEAN, nr=_NEAR))
def episode_support(spark: SparkSession, sf: str) -> DataFrame:
    """Energies by episode (A8, A10): every episode has one histogram of mass one, so a long one does not outweigh the rest. An energy is supported in two
    occupied episodes, and likely where the mean density within three bins is over twice that of Empty, from three below the energy that a tenth of Present's mass reaches. How much Empty was observed is not asked."""
    keys, bin_ = ["device", "channel"], ["device", "channel", "energy"]
    truth = last_label(ad.labels(spark, sf), ["device"]).where("state != 'unknown'").withColumn("episode", F.col(S))
    spans = iv.overlap_join(holds(spark, sf).where("energy is not null"), truth, ["device"])
    rows = spans.groupBy(*bin_, "state", "episode").agg(F.sum(F.col(E) - F.col(S)).alias("ms"))
    rows = rows.withColumn("d", F.col("ms") / F.sum("ms").over(Window.partitionBy(*keys, "state", "episode")))
    present, empty = F.col("state") == "present", F.col("state") == "not_present"
    number = rows.groupBy(*keys).agg(F.countDistinct(F.when(present, F.col("episode"))).alias("np"), F.countDistinct(F.when(empty, F.col("episode"))).alias("nq"))
    bins = rows.groupBy(*bin_).agg(F.count(F.when(present, 1)).alias("occupied_episodes"), F.coalesce(total(present, "d"), F.lit(0.0)).alias("p"), F.coalesce(total(empty, "d"), F.lit(0.0)).alias("q")).join(number, keys)
    mean = lambda c, n: F.round(F.when(F.col(n) > 0, F.col(c) / F.col(n)).otherwise(0.0), 9)
    line = Window.partitionBy(*keys)
    near, upto = line.orderBy("energy").rangeBetween(-3, 3), line.orderBy("energy")
    bins = bins.withColumns({"p": mean("p", "np"), "q": mean("q", "nq")})
    bins = bins.withColumns({"present_density": F.round(F.sum("p").over(near), 6), "empty_density": F.round(F.sum("q").over(near), 6), "cum": F.round(F.sum("p").over(upto), 6)})
    bins = bins.withColumn("lowest", F.min(F.when(F.col("cum") >= LOWER_QUANTILE, F.col("energy"))).over(line))
    likely = (F.col("np") > 0) & (F.col("nq") > 0) & (F.col("energy") + 3 >= F.col("lowest")) & (F.col("present_density") + DENSITY_PRIOR > LIKELIHOOD_RATIO * (F.col("empty_density") + DENSITY_PRIOR))
    return bins.select(*bin_, "occupied_episodes", "present_density", "empty_density", (F.col("occupied_episodes") >= 2).alias("supported"), F.coalesce(likely, F.lit(False)).alias("likely"))


# ------------------------------------------------------------------ lowering for presence


def lowered(threshold: int, by: int) -> int:
    """The greatest legal value that is lower by so much, or the least one below."""
    below = [t for t in DOMAIN if t < threshold]
    return max((t for t in below if t <= threshold - by), default=below[0] if below else threshold)


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    x, n = np.nan_to_num(rows[GATES].to_numpy(float, na_value=np.nan)), rows["n"].to_numpy()
    yes, m = (rows["state"] == "present").to_numpy(), float(rows["m"].iloc[0])

    def measure(t: tuple) -> tuple[float, int, int]:
        hit = ((x > t) & (np.array(t) < 100)).any(1)
        missed, false = int(n[yes & ~hit].sum()), int(n[~yes & hit].sum())
        return PRESENCE_PRICE * m * missed + false, missed, false

    start = tuple(ad.PATTERNS[0][1])
    now, moves, rounds = start, [tuple(lowered(t, k) for t in start) for k in PRESENCE_SHIFTS], 0
    while rounds < PRESENCE_ROUNDS and yes.any():
        steps = [(*now[:c], lowered(t, 1), *now[c + 1 :]) for c, t in enumerate(now)]
        best = min([now, *moves, *steps], key=lambda t: measure(t)[0])  # the first of equals, so the higher thresholds
        if best == now:
            break
        now, moves, rounds = best, [], rounds + 1
    price, missed, false = measure(now)
    return pd.DataFrame({"device": [rows["device"].iloc[0]], "thresholds": [list(now)], "shift": [max(a - b for a, b in zip(start, now, strict=True))], "rounds": [rounds], "price": [price], "missed": [missed], "false_": [false]})


@query()
def presence_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds lowered while missed presence is worth the false time (G13): all gates by the same shift first, then one gate a legal step at a time, twelve rounds at most.

    Measured in cells over a device's distinct vectors, which are few however long the history. Cells know no starts and no episodes, so false starts
    are not priced and no guard holds the walk back.
    """
    weight = ad.groups(spark).groupBy("device").agg(F.max("priority").alias("m"))
    rows = vector_multiplicity(spark, sf).join(F.broadcast(weight), "device")
    return rows.groupBy("device").applyInPandas(_walk, "device long, thresholds array<int>, shift int, rounds int, price double, missed long, false_ long")
