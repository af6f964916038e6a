"""Labels, truth of devices and rooms, guesses and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import histograms as hg
from tidewell.operators import intervals as iv
from tidewell.operators import labels as lb
from tidewell.plans.registry import query
from tidewell.plans.signals import FROM, GATES, holds, islands, picked, sweep, vectors
from tidewell.plans.statistics import LAST, LHIST, NOISE, PIECES, baselines, labelled, last_label
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import DAY, HOUR, MINUTE, with_views

E, S = iv.E, iv.S
#: The end of the recording's third week, which horizons are counted from.
NOW = 1_705_881_600_000
#: A device that is not recording.
PAUSED = 6


def overlaid(src: str, keys: str, order: str, values: str, where: str = "true") -> str:
    """SQL of an overlay with precedence."""
    best = ", ".join(f"arg_max(l.{v}, {order}) AS {v}" for v in values.split(", "))
    inner = f"SELECT p.{keys}, p.start_ms, p.end_ms, {best} FROM ({sweep(src, '', keys)}) p JOIN ({src}) l ON l.{keys} = p.{keys} AND l.start_ms <= p.start_ms AND p.start_ms < l.end_ms GROUP BY ALL"
    return islands(f"SELECT * FROM ({inner}) WHERE {where}", keys, values)


@query(with_views("SELECT device, state, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY start_ms DESC, end_ms DESC, state) AS n FROM u) WHERE n <= 1000", u=picked("SELECT device, state, start_ms, end_ms FROM lab", "", "device, state", "a > 0")))
def label_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one state merged, the last thousand kept."""
    return lb.compact(ad.labels(spark, sf).select("device", "state", S, E), ["device"], 1000)


def _cut(src: str, a: str, b: str) -> str:
    return f"SELECT * FROM (SELECT device, ord, start_ms, least(end_ms, {a}) AS end_ms, state, source FROM ({src}) UNION ALL SELECT device, ord, greatest(start_ms, {b}), end_ms, state, source FROM ({src})) WHERE end_ms > start_ms"


@query(with_views(_cut("SELECT * FROM lab", str(FROM), str(FROM + 5 * HOUR)) + f" UNION ALL SELECT DISTINCT device, -1::BIGINT, {FROM}::BIGINT, {FROM + 5 * HOUR}::BIGINT, 'present', 'manual' FROM lab"))
def apply_range(spark: SparkSession, sf: str) -> DataFrame:
    """Five hours of every device set to Present; what they cut keeps its outer parts."""
    rows = ad.labels(spark, sf).select("device", "ord", S, E, "state", "source")
    ranges = rows.select("device").distinct().select("device", F.lit(FROM).alias("a"), F.lit(FROM + 5 * HOUR).alias("b"))
    return lb.apply_range(rows, ranges, ["device"], ord=F.lit(-1).cast("long"), state=F.lit("present"), source=F.lit("manual"))


_FIRST = "SELECT device, min(struct_pack(s := start_ms, o := ord, e := end_ms)) AS x FROM lab WHERE source = 'manual' GROUP BY device"


@query(with_views(f"SELECT d.device, d.ord, d.start_ms, d.end_ms, d.state, d.source FROM d UNION ALL SELECT device, x.o, x.s + {30 * MINUTE}, x.e + {30 * MINUTE}, 'not_present', 'manual' FROM f",
                  f=_FIRST, c="SELECT l.*, x.s AS a, x.e AS b FROM lab l JOIN f USING (device)",
                  c2=f"SELECT device, ord, state, source, start_ms, end_ms, a + {30 * MINUTE} AS a, b + {30 * MINUTE} AS b FROM (SELECT device, ord, state, source, start_ms, least(end_ms, a) AS end_ms, a, b FROM c UNION ALL SELECT device, ord, state, source, greatest(start_ms, b), end_ms, a, b FROM c) WHERE end_ms > start_ms",
                  d="SELECT * FROM (SELECT device, ord, state, source, start_ms, least(end_ms, a) AS end_ms FROM c2 UNION ALL SELECT device, ord, state, source, greatest(start_ms, b), end_ms FROM c2) WHERE end_ms > start_ms"))
def replace_label(spark: SparkSession, sf: str) -> DataFrame:
    """A device's first manual label moved by half an hour and set to Empty: its old bounds are cleared, then the new ones set (L2)."""
    rows = ad.labels(spark, sf).select("device", "ord", S, E, "state", "source")
    first = rows.where("source = 'manual'").groupBy("device").agg(F.min(F.struct(S, "ord", E)).alias("x"))
    old = first.select("device", F.col(f"x.{S}").alias("a"), F.col(f"x.{E}").alias("b"))
    new = first.select("device", (F.col(f"x.{S}") + 30 * MINUTE).alias("a"), (F.col(f"x.{E}") + 30 * MINUTE).alias("b"), F.col("x.ord").alias("o"))
    cleared = lb.remove_ranges(rows, old, ["device"])
    return lb.apply_range(cleared, new, ["device"], ord=F.col("o"), state=F.lit("not_present"), source=F.lit("manual")).select(*rows.columns)


@query(with_views(overlaid("SELECT device, start_ms, end_ms, state, source, (state = 'unknown')::INT * 2 + (source = 'manual')::INT AS rank, ord FROM lab", "device", "l.rank * 1000000000000 + l.ord", "state, source", "state <> 'unknown'")))
def evidence_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence by precedence: Unknown first, then human, then the later in the list; Unknown takes its piece away."""
    order = F.struct((F.col("state") == "unknown").cast("int"), (F.col("source") == "manual").cast("int"), F.col("ord"))
    return iv.overlay(ad.labels(spark, sf), ["device"], order, ["state", "source"]).where("state != 'unknown'")


_REC = f"SELECT zone, device FROM grp WHERE device <> {PAUSED}"
_LONE = "SELECT device, start_ms, end_ms, state, ord FROM rlab JOIN (SELECT zone, min(device) AS device FROM rec GROUP BY zone HAVING count(*) = 1) USING (zone) WHERE source = 'manual'"


def recording(spark: SparkSession) -> DataFrame:
    return ad.groups(spark).where(F.col("device") != PAUSED).select("zone", "device")


def lone(spark: SparkSession, sf: str) -> DataFrame:
    single = recording(spark).groupBy("zone").agg(F.min("device").alias("device"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return ad.room_labels(spark, sf).where("source = 'manual'").join(F.broadcast(single.drop("n")), "zone").select("device", S, E, "state", "ord")


@query(with_views(_LONE, rec=_REC))
def lone_group_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a room with a single recording device are that device's too."""
    return lone(spark, sf)


_HUMAN = """SELECT device, start_ms, end_ms, state, 3 AS prio, ord FROM lab WHERE source = 'manual' UNION ALL SELECT device, start_ms, end_ms, state, 2, ord FROM lone
    UNION ALL SELECT device, start_ms, end_ms, state, 1, ord FROM rlab JOIN rec USING (zone) WHERE source = 'manual' AND state = 'not_present'"""


def human(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.labels(spark, sf).where("source = 'manual'").select("device", S, E, "state", F.lit(3).alias("prio"), "ord")
    rows = rows.unionByName(lone(spark, sf).withColumn("prio", F.lit(2)))
    empty = ad.room_labels(spark, sf).where("source = 'manual' and state = 'not_present'").join(F.broadcast(recording(spark)), "zone")
    rows = rows.unionByName(empty.select("device", S, E, "state", F.lit(1).alias("prio"), "ord"))
    return iv.overlay(rows, ["device"], F.struct("prio", "ord"), ["state"])


@query(with_views(overlaid("SELECT * FROM hum", "device", "l.prio * 1000000000000 + l.ord", "state"), rec=_REC, lone=_LONE, hum=_HUMAN))
def human_truth(spark: SparkSession, sf: str) -> DataFrame:
    """A device's own human label, else its lone room's, else Empty where a room that covers it is Empty."""
    return human(spark, sf)


def _members(src: str, least: int) -> str:
    both = sweep(f"SELECT zone, start_ms, end_ms FROM ({src}) JOIN grp USING (device) WHERE state = 'present'", f"SELECT zone, start_ms, end_ms FROM ({src}) JOIN grp USING (device) WHERE state = 'not_present'", "zone")
    state = f"CASE WHEN a >= least({least}, n) THEN 'present' WHEN b = n AND a = 0 THEN 'not_present' END"
    return islands(f"SELECT * FROM (SELECT zone, start_ms, end_ms, {state} AS state FROM ({both}) JOIN (SELECT zone, count(*) AS n FROM grp GROUP BY zone) USING (zone)) WHERE state IS NOT NULL", "zone", "state")


MANUAL = LAST.replace("pc p", "pm p").replace("JOIN lab l ON", "JOIN lab l ON l.source = 'manual' AND")
PM = sweep("SELECT device, start_ms, end_ms FROM lab WHERE source = 'manual'", "", "device")


@query(with_views(_members("SELECT * FROM hm", 1), pm=PM, hm=MANUAL))
def member_combine(spark: SparkSession, sf: str) -> DataFrame:
    """What members' human labels say of their zone: Present if any is, Empty if all are."""
    states = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"])
    return lb.members_state(states, ad.groups(spark), "zone", 1)


_ROOM = """SELECT zone, start_ms, end_ms, state, 5 AS prio, ord FROM rlab WHERE source = 'manual' UNION ALL SELECT zone, start_ms, end_ms, state, 4, 0 FROM mh
    UNION ALL SELECT zone, start_ms, end_ms, state, 3, ord FROM rlab WHERE source = 'sensor' UNION ALL SELECT zone, start_ms, end_ms, state, 2, 0 FROM mg"""


def rooms(spark: SparkSession, sf: str) -> DataFrame:
    own, members = ad.room_labels(spark, sf), ad.groups(spark)
    manual = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"])
    rows = own.select("zone", S, E, "state", F.when(F.col("source") == "manual", 5).otherwise(3).alias("prio"), "ord")
    for prio, states, least in ((4, manual, 1), (2, ad.guesses(spark, sf), 2)):
        found = lb.members_state(states.select("device", S, E, "state"), members, "zone", least)
        rows = rows.unionByName(found.withColumns({"prio": F.lit(prio), "ord": F.lit(0).cast("long")}))
    return iv.overlay(rows, ["zone"], F.struct("prio", "ord"), ["state", "prio"])


ROOM_PARTS = {"pm": PM, "hm": MANUAL, "mh": _members("SELECT * FROM hm", 1), "mg": _members("SELECT * FROM gs", 2), "room": _ROOM}
ROOM = overlaid("SELECT * FROM room", "zone", "l.prio * 1000000000000 + l.ord", "state, prio")


@query(with_views(ROOM, **ROOM_PARTS))
def room_truth(spark: SparkSession, sf: str) -> DataFrame:
    """A room's truth: its own manual label (Unknown stops), its members' human ones, its sensor's, two members' guesses."""
    return rooms(spark, sf)


_EST = """SELECT p.zone, p.start_ms, p.end_ms, n, count(*) FILTER (g.state = 'present') AS np, count(*) FILTER (g.state = 'not_present') AS ne,
    1 - exp(sum(ln(1 - g.level * 0.05)) FILTER (g.state = 'present')) AS cp, min(g.level) FILTER (g.state = 'not_present') * 0.05 AS ce
    FROM ep p JOIN grp m USING (zone) JOIN gs g ON g.device = m.device AND g.start_ms <= p.start_ms AND p.start_ms < g.end_ms JOIN (SELECT zone, count(*) AS n FROM grp GROUP BY zone) z ON z.zone = p.zone GROUP BY ALL"""
EST_PARTS = {"ep": sweep("SELECT zone, start_ms, end_ms FROM gs JOIN grp USING (device)", "", "zone"), "es": _EST}
EST = "SELECT * FROM (SELECT zone, start_ms, end_ms, CASE WHEN np >= least(2, n) THEN 'present' WHEN ne = n THEN 'not_present' END AS state, round(CASE WHEN np >= least(2, n) THEN cp WHEN ne = n THEN ce END, 6)::DOUBLE AS confidence FROM es) WHERE confidence >= 0.55"


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    members = F.broadcast(ad.groups(spark).select("zone", "device"))
    rows = ad.guesses(spark, sf).join(members, "device")
    cut = iv.pieces(rows, ["zone"]).withColumnsRenamed({S: "_s", E: "_e"})
    sizes = F.broadcast(ad.groups(spark).groupBy("zone").agg(F.count(F.lit(1)).alias("n")))
    at = iv.at_time(cut, rows.select("zone", S, E, "state", "level"), ["zone"], "_s").join(sizes, "zone")
    present, empty = F.col("state") == "present", F.col("state") == "not_present"
    c = F.col("level") * 0.05
    agg = at.groupBy("zone", F.col("_s").alias(S), F.col("_e").alias(E), "n").agg(F.count(F.when(present, 1)).alias("np"), F.count(F.when(empty, 1)).alias("ne"), (1 - F.exp(F.sum(F.when(present, F.ln(1 - c))))).alias("cp"), (F.min(F.when(empty, F.col("level"))) * 0.05).alias("ce"))
    yes, no = F.col("np") >= F.least(F.lit(2), "n"), F.col("ne") == F.col("n")
    out = agg.select("zone", S, E, F.when(yes, "present").when(no, "not_present").alias("state"), F.round(F.when(yes, F.col("cp")).when(no, F.col("ce")), 6).alias("confidence"))
    return out.where("confidence >= 0.55")


@query(with_views(EST, **EST_PARTS))
def room_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Members' guesses of a room together: the chance that one of two agreeing Present ones is right, or the least of all Empty ones."""
    return estimates(spark, sf)


@query(with_views("SELECT zone, state, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY start_ms DESC) AS n FROM u) WHERE n = 1", **EST_PARTS, u=islands(f"SELECT zone, start_ms, end_ms, state FROM ({EST})", "zone", "state")))
def current_stretch(spark: SparkSession, sf: str) -> DataFrame:
    """The stretch of equal estimates that a room is in at the end (V7)."""
    runs = iv.coalesce(estimates(spark, sf).select("zone", S, E, "state"), ["zone"], ["state"])
    last = F.max_by(F.struct("state", S, E), S)
    return runs.groupBy("zone").agg(last.alias("x")).select("zone", "x.state", f"x.{S}", f"x.{E}")


@query(with_views(f"""SELECT device, ord, start_ms, end_ms, state, source FROM (SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY device ORDER BY end_ms DESC, start_ms DESC, ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM lab WHERE source = 'manual' AND state <> 'unknown') WHERE prev < {60 * HOUR}
    UNION ALL SELECT device, ord, greatest(start_ms, {NOW - 10 * DAY}), end_ms, state, source FROM lab WHERE source = 'sensor' AND end_ms > {NOW - 10 * DAY}
    UNION ALL SELECT device, ord, start_ms, end_ms, state, source FROM lab WHERE source = 'manual' AND state = 'unknown'"""))
def evidence_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Recent sensor labels, and the newest sixty hours of human ones."""
    return lb.horizon(ad.labels(spark, sf), NOW, 10 * DAY, 60 * HOUR).select("device", "ord", S, E, "state", "source")


_TRUST = "CASE WHEN state = 'not_present' THEN 0.95 WHEN level < 14 OR level >= 20 THEN 0.95 ELSE 0.15 END"


@query(with_views(f"SELECT device, start_ms, end_ms, state, {_TRUST}::DOUBLE AS trust FROM gs WHERE {_TRUST} >= 0.55"))
def trusted_guesses(spark: SparkSession, sf: str) -> DataFrame:
    """Guesses that count as evidence, by state and recorded confidence in steps of five per cent."""
    trust = F.when(F.col("state") == "not_present", 0.95).when((F.col("level") < 14) | (F.col("level") >= 20), 0.95).otherwise(0.15)
    return ad.guesses(spark, sf).select("device", S, E, "state", trust.alias("trust")).where("trust >= 0.55")


_CEIL = "SELECT device, " + ", ".join(f"max(q) FILTER (channel = {c}) AS c{c}" for c in range(5)) + " FROM (SELECT device, channel, min(energy) FILTER (cum >= greatest(1, ceil(total * 0.999)::BIGINT)) + 3 AS q FROM (SELECT *, sum(ms) OVER (PARTITION BY device, channel ORDER BY energy)::BIGINT AS cum, sum(ms) OVER (PARTITION BY device, channel)::BIGINT AS total FROM lh WHERE state = 'not_present') GROUP BY device, channel HAVING max(total) >= 120000) GROUP BY device"
_QUIET = "SELECT v.device, start_ms, end_ms FROM v JOIN ceil_ USING (device) WHERE NOT (" + " OR ".join(f"coalesce({g} > c{k}, false)" for k, g in enumerate(GATES)) + ")"


@query(with_views(picked("SELECT device, start_ms, end_ms FROM gs WHERE state = 'present'", "SELECT * FROM qt", "device", "a > 0 AND b = 0"), pc=PIECES, ll=LAST, lh=LHIST, ceil_=_CEIL, qt=_QUIET))
def quiet_veto(spark: SparkSession, sf: str) -> DataFrame:
    """Present guesses without the recorded time in which every gate is within its ceiling."""
    keys = ["device", "channel"]
    rows = hg.cumulated(hg.durations(labelled(spark, sf).where("state = 'not_present'"), keys), keys)
    tops = rows.groupBy(*keys).agg((hg.RULES["q1"](0.999) + 3).alias("q"), F.max("total").alias("t")).where("t >= 120000")
    tops = tops.groupBy("device").agg(*[F.max(F.when(F.col("channel") == c, F.col("q"))).alias(f"c{c}") for c in range(len(GATES))])
    loud = F.lit(False)
    for k, g in enumerate(GATES):
        loud = loud | F.coalesce(F.col(g) > F.col(f"c{k}"), F.lit(False))
    quiet = vectors(spark, sf).join(tops, "device").where(~loud)
    return iv.subtract(ad.guesses(spark, sf).where("state = 'present'"), quiet, ["device"])


_TRIAL = f"SELECT device, state, greatest(start_ms, k * {HOUR}) AS start_ms, least(end_ms, (k + 1) * {HOUR}) AS end_ms, k FROM (SELECT *, unnest(range(start_ms // {HOUR}, (end_ms - 1) // {HOUR} + 1)) AS k FROM hm WHERE state <> 'unknown')"
_CHECK = f"""SELECT device, basis, count(*) AS trials, round(sum((least({HOUR}, ms) * yes // ms)::BIGINT)::BIGINT / {HOUR}.0::DOUBLE, 6)::DOUBLE AS hit, round(sum(least({HOUR}, ms))::BIGINT / {HOUR}.0::DOUBLE, 6)::DOUBLE AS weight FROM
    (SELECT t.device, g.basis, t.start_ms, t.state, sum(least(t.end_ms, g.end_ms) - greatest(t.start_ms, g.start_ms)) AS ms, coalesce(sum(least(t.end_ms, g.end_ms) - greatest(t.start_ms, g.start_ms)) FILTER (g.state = t.state), 0) AS yes
     FROM tr t JOIN gs g ON g.device = t.device AND g.start_ms < t.end_ms AND t.start_ms < g.end_ms GROUP BY ALL) GROUP BY device, basis"""
TRIALS = {"pm": PM, "hm": MANUAL, "tr": _TRIAL, "ck": _CHECK}


def trials(spark: SparkSession, sf: str) -> DataFrame:
    truth = last_label(ad.labels(spark, sf).where("source = 'manual'"), ["device"]).where("state != 'unknown'")
    pieces = iv.split(truth, HOUR, "k").withColumn("trial", F.col(S))
    found = iv.overlap_join(pieces, ad.guesses(spark, sf).select("device", S, E, F.col("state").alias("guess"), "basis"), ["device"])
    ms = F.col(E) - F.col(S)
    each = found.groupBy("device", "basis", "trial", "state").agg(F.sum(ms).alias("ms"), F.sum(F.when(F.col("guess") == F.col("state"), ms).otherwise(0)).alias("yes"))
    # weights are whole milliseconds, so that their sums have no order
    each = each.withColumn("w", F.least(F.lit(HOUR), "ms")).withColumn("h", F.expr("(w * yes) div ms"))
    out = each.groupBy("device", "basis").agg(F.count(F.lit(1)).alias("trials"), F.round(F.sum("h") / float(HOUR), 6).alias("hit"), F.round(F.sum("w") / float(HOUR), 6).alias("weight"))
    return out.withColumn("discarded", F.col("hit") < F.col("weight") * 0.55)


@query(with_views("SELECT *, hit < weight * 0.55 AS discarded FROM ck", **TRIALS))
def guess_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled hours as trials of the guesses; a source that is right too rarely is discarded."""
    return trials(spark, sf)


@query(with_views("SELECT g.device, start_ms, end_ms, CASE WHEN coalesce(hit < weight * 0.55, false) THEN 'abstain' ELSE state END AS state, CASE WHEN coalesce(hit < weight * 0.55, false) THEN 3 ELSE g.basis END AS basis FROM gs g LEFT JOIN ck ON ck.device = g.device AND ck.basis = g.basis", **TRIALS))
def guesses_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Guesses of discarded sources abstain."""
    off = F.coalesce("discarded", F.lit(False))
    rows = ad.guesses(spark, sf).join(trials(spark, sf).select("device", "basis", "discarded"), ["device", "basis"], "left")
    return rows.select("device", S, E, F.when(off, "abstain").otherwise(F.col("state")).alias("state"), F.when(off, 3).otherwise(F.col("basis")).alias("basis"))


@query(with_views("SELECT basis, state, count(*) AS n, round((3 + sum(vote)) / (4 + count(*)), 6)::DOUBLE AS reliability FROM (SELECT l.device, l.ord, g.basis, l.state, max((g.state = l.state)::INT * (least(l.end_ms, g.end_ms) - greatest(l.start_ms, g.start_ms)) / (l.end_ms - l.start_ms)::DOUBLE) AS vote FROM lab l JOIN gs g ON g.device = l.device AND g.start_ms < l.end_ms AND l.start_ms < g.end_ms WHERE l.source = 'manual' AND l.state <> 'unknown' GROUP BY ALL) GROUP BY basis, state"))
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    """How far to trust each kind of guess: one fractional vote for each labelled episode."""
    eps = ad.labels(spark, sf).where("source = 'manual' and state != 'unknown'").select("device", "ord", "state", S, E, (F.col(E) - F.col(S)).alias("whole"))
    found = iv.overlap_join(eps, ad.guesses(spark, sf).select("device", S, E, F.col("state").alias("guess"), "basis"), ["device"])
    # a pair is met once, since neither an episode nor a guess repeats
    share = F.when(F.col("guess") == F.col("state"), F.col(E) - F.col(S)).otherwise(0) / F.col("whole").cast("double")
    votes = found.groupBy("device", "ord", "basis", "state").agg(F.max(share).alias("vote"))
    return votes.groupBy("basis", "state").agg(F.count(F.lit(1)).alias("n"), F.round((F.sum("vote") + 3) / (F.count(F.lit(1)) + 4), 6).alias("reliability"))


@query(with_views("SELECT state, count(*) AS episodes, sum(c)::BIGINT AS mass FROM (SELECT start_ms, end_ms, state, max(level) AS c FROM gs JOIN grp USING (device) GROUP BY ALL) GROUP BY state"))
def automatic_mass(spark: SparkSession, sf: str) -> DataFrame:
    """Automatic episodes counted once, with their greatest confidence."""
    once = ad.guesses(spark, sf).join(F.broadcast(ad.groups(spark).select("device")), "device").groupBy(S, E, "state").agg(F.max("level").alias("c"))
    return once.groupBy("state").agg(F.count(F.lit(1)).alias("episodes"), F.sum("c").alias("mass"))


_SUST = "SELECT device, start_ms, end_ms FROM (" + islands("SELECT s.device, s.channel, start_ms, end_ms FROM sp s JOIN nz ON nz.device = s.device AND nz.channel = s.channel WHERE energy > nz.ceiling", "device, channel") + ") WHERE end_ms - start_ms >= 30000"
SUSTAINED = {"pc": PIECES, "ll": LAST, "lh": LHIST, "nz": NOISE, "su": _SUST}


def sustained(spark: SparkSession, sf: str) -> DataFrame:
    """Where a gate stays above its quiet ceiling for thirty seconds at least."""
    rows = holds(spark, sf).join(baselines(spark, sf), ["device", "channel"]).where(F.col("energy") > F.col("ceiling"))
    return iv.coalesce(rows.select("device", "channel", S, E), ["device", "channel"]).where(F.col(E) - F.col(S) >= 30_000)


@query(with_views("SELECT l.device, l.start_ms, l.end_ms, coalesce(bool_or(s.device IS NOT NULL), false) AS attributed, coalesce(sum(least(l.end_ms, s.end_ms) - greatest(l.start_ms, s.start_ms)) FILTER (s.device IS NOT NULL), 0)::BIGINT AS loud_ms FROM ll l LEFT JOIN su s ON s.device = l.device AND s.start_ms < l.end_ms AND l.start_ms < s.end_ms WHERE l.state = 'present' GROUP BY ALL", **SUSTAINED))
def sustained_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Which Present episodes a device has seen, and for how long."""
    eps = last_label(ad.labels(spark, sf), ["device"]).where("state = 'present'").select("device", S, E, F.col(S).alias("a"), F.col(E).alias("b"))
    found = iv.overlap_join(eps, sustained(spark, sf).select("device", S, E), ["device"]).groupBy("device", "a", "b").agg(F.sum(F.col(E) - F.col(S)).alias("loud_ms"))
    rows = eps.join(found, ["device", "a", "b"], "left")
    return rows.select("device", S, E, F.col("loud_ms").isNotNull().alias("attributed"), F.coalesce("loud_ms", F.lit(0)).alias("loud_ms"))


@query(with_views(islands("SELECT device, start_ms, end_ms, CASE WHEN a > 0 AND c > 0 THEN 'present' WHEN b = n THEN 'not_present' END AS state FROM (SELECT device, t AS start_ms, lead(t) OVER w AS end_ms, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(c) OVER w AS c FROM (SELECT device, t, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM ed GROUP BY device, t) WINDOW w AS (PARTITION BY device ORDER BY t)) JOIN (SELECT device, count(*) AS n FROM grp GROUP BY device) USING (device) WHERE end_ms IS NOT NULL AND (a > 0 AND c > 0 OR b = n)", "device", "state"),
                  **ROOM_PARTS, rt=ROOM, **SUSTAINED, su2=picked("SELECT * FROM su", "", "device", "a > 0"),
                  ed="SELECT device, t, a, b, 0 AS c FROM (SELECT device, unnest([start_ms, end_ms]) AS t, unnest([1, -1]) * (state = 'present')::INT AS a, unnest([1, -1]) * (state = 'not_present')::INT AS b FROM rt JOIN grp USING (zone) WHERE state <> 'unknown') UNION ALL SELECT device, unnest([start_ms, end_ms]), 0, 0, unnest([1, -1]) FROM su2"))
def union_rule_target(spark: SparkSession, sf: str) -> DataFrame:
    """A device of several rooms: Present where any is and the device sees it, Empty where all are."""
    members = ad.groups(spark).select("zone", "device")
    rows = rooms(spark, sf).where("state != 'unknown'").join(F.broadcast(members), "zone").select("device", S, E, (F.col("state") == "present").cast("int").alias("p"), (F.col("state") == "not_present").cast("int").alias("q"), F.lit(0).alias("c"))
    seen = iv.union(sustained(spark, sf), ["device"]).select("device", S, E, F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(1).alias("c"))
    deep = iv.depth(rows.unionByName(seen), ["device"], a=F.col("p"), b=F.col("q"), c=F.col("c")).join(F.broadcast(members.groupBy("device").agg(F.count(F.lit(1)).alias("n"))), "device")
    state = F.when((F.col("a") > 0) & (F.col("c") > 0), "present").when(F.col("b") == F.col("n"), "not_present")
    return iv.coalesce(deep.withColumn("state", state).where("state is not null").select("device", S, E, "state"), ["device"], ["state"])


@query(with_views("SELECT e.zone, e.start_ms, e.end_ms, count(DISTINCT s.device) AS seen_by FROM (SELECT * FROM (SELECT zone, start_ms, end_ms, row_number() OVER (PARTITION BY zone ORDER BY start_ms DESC) AS n FROM rt WHERE state = 'present') WHERE n <= 50) e JOIN grp m USING (zone) LEFT JOIN su s ON s.device = m.device AND s.start_ms < e.end_ms AND e.start_ms < s.end_ms GROUP BY ALL", **ROOM_PARTS, rt=ROOM, **SUSTAINED))
def seen_by_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest fifty occupied stretches of each room, and how many members saw them."""
    line = Window.partitionBy("zone").orderBy(F.desc(S))
    eps = rooms(spark, sf).where("state = 'present'").withColumn("_n", F.row_number().over(line)).where("_n <= 50").select("zone", S, E, F.col(S).alias("a"), F.col(E).alias("b"))
    each = eps.join(F.broadcast(ad.groups(spark).select("zone", "device")), "zone")
    seen = iv.overlap_join(each, sustained(spark, sf).select("device", S, E), ["device"]).groupBy("zone", "a", "b").agg(F.countDistinct("device").alias("k"))
    return eps.join(seen, ["zone", "a", "b"], "left").select("zone", S, E, F.coalesce("k", F.lit(0)).alias("seen_by"))


@query(with_views("""SELECT device, day, run, state, basis, level, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM f GROUP BY ALL""",
                  q=f"SELECT *, row_number() OVER (PARTITION BY device, day ORDER BY start_ms) AS n FROM (SELECT device, k AS day, greatest(start_ms, k * {DAY}) AS start_ms, least(end_ms, (k + 1) * {DAY}) AS end_ms, state, level AS own, basis FROM (SELECT *, unnest(range(start_ms // {DAY}, (end_ms - 1) // {DAY} + 1)) AS k FROM gs))",
                  f="SELECT device, day, n, start_ms, end_ms, state, basis, own AS level, 1 AS run FROM q WHERE n = 1 UNION ALL SELECT q.device, q.day, q.n, q.start_ms, q.end_ms, q.state, q.basis, CASE WHEN f.end_ms = q.start_ms AND q.state = f.state AND q.basis = f.basis AND abs(q.own - f.level) <= 2 THEN f.level ELSE q.own END, f.run + CASE WHEN f.end_ms = q.start_ms AND q.state = f.state AND q.basis = f.basis AND abs(q.own - f.level) <= 2 THEN 0 ELSE 1 END FROM f JOIN q ON q.device = f.device AND q.day = f.day AND q.n = f.n + 1"))
def guess_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Guesses run together while state and basis stay and the level is within two steps of the run's own; a day's runs end with it.

    The comparison is with the start of the run, so this is a fold in time order; its groups are a device's day.
    """
    rows = iv.split(ad.guesses(spark, sf), DAY, "day")
    item = F.struct(S, E, "state", "basis", "level")
    runs = F.lit(None).cast("array<struct<start_ms:bigint,end_ms:bigint,state:string,basis:int,level:int>>")

    def fold(acc, x):
        last = F.element_at(acc, -1)
        goes_on = (F.size(acc) > 0) & (last[E] == x[S]) & (last["state"] == x["state"]) & (last["basis"] == x["basis"]) & (F.abs(x["level"] - last["level"]) <= 2)
        longer = F.struct(last[S].alias(S), x[E].alias(E), last["state"].alias("state"), last["basis"].alias("basis"), last["level"].alias("level"))
        return F.when(goes_on, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    start = F.coalesce(runs, F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,state:string,basis:int,level:int>>"))
    folded = rows.groupBy("device", "day").agg(F.array_sort(F.collect_list(item)).alias("g")).select("device", "day", F.posexplode(F.aggregate("g", start, fold)).alias("p", "x"))
    return folded.select("device", "day", (F.col("p") + 1).alias("run"), "x.state", "x.basis", "x.level", f"x.{S}", f"x.{E}")


@query(with_views(f"SELECT device, ord, CASE WHEN source = 'sensor' THEN greatest(start_ms, {NOW - 12 * DAY}) ELSE start_ms END AS start_ms, end_ms, state, source FROM lab WHERE source = 'manual' OR end_ms > {NOW - 12 * DAY}"))
def label_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor labels expire and are clipped at the cutoff."""
    cut = NOW - 12 * DAY
    rows = ad.labels(spark, sf).where((F.col("source") == "manual") | (F.col(E) > cut))
    return rows.select("device", "ord", F.when(F.col("source") == "sensor", F.greatest(F.col(S), F.lit(cut))).otherwise(F.col(S)).alias(S), E, "state", "source")


@query(with_views(f"SELECT device, ord, start_ms, coalesce(CASE WHEN ord % 10 <> 0 THEN end_ms END, {NOW}) AS end_ms, state FROM lab WHERE start_ms < {NOW}"))
def open_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A live label without an end reaches now."""
    end = F.when(F.col("ord") % 10 != 0, F.col(E))
    return ad.labels(spark, sf).where(F.col(S) < NOW).select("device", "ord", S, F.coalesce(end, F.lit(NOW)).alias(E), "state")


@query(with_views(picked("SELECT device, start_ms, end_ms FROM lab WHERE source = 'sensor' AND state = 'present'", "SELECT device, start_ms, end_ms FROM gs", "device", "a > 0 AND b = 0")))
def late_splice(spark: SparkSession, sf: str) -> DataFrame:
    """Late guesses fill only time that has no guess (M8)."""
    return iv.subtract(ad.labels(spark, sf).where("source = 'sensor' and state = 'present'"), ad.guesses(spark, sf), ["device"])


@query(with_views(f"SELECT device, start_ms + {10 * MINUTE} AS start_ms, end_ms - {15 * MINUTE} AS end_ms FROM (" + picked("SELECT device, start_ms, end_ms FROM lab WHERE source = 'sensor' AND state = 'present'", "", "device", "a > 0") + f") WHERE end_ms - start_ms > {25 * MINUTE}"))
def trimmed_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Positive periods of an outside source without their first and last minutes."""
    runs = iv.union(ad.labels(spark, sf).where("source = 'sensor' and state = 'present'"), ["device"])
    return runs.where(F.col(E) - F.col(S) > 25 * MINUTE).select("device", (F.col(S) + 10 * MINUTE).alias(S), (F.col(E) - 15 * MINUTE).alias(E))


@query(with_views(picked(f"SELECT device, state, greatest(start_ms, {NOW - 10 * DAY}) AS start_ms, end_ms FROM lab WHERE source = 'manual' AND state <> 'unknown' AND end_ms > {NOW - 10 * DAY}", "SELECT device, 'present' AS state, start_ms, end_ms FROM gs UNION ALL SELECT device, 'not_present', start_ms, end_ms FROM gs", "device, state", "a > 0 AND b > 0")))
def truth_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Truth restricted to pieces: human only, since a cutoff, inside given intervals."""
    since = ad.labels(spark, sf).where((F.col("source") == "manual") & (F.col("state") != "unknown") & (F.col(E) > NOW - 10 * DAY)).withColumn(S, F.greatest(F.col(S), F.lit(NOW - 10 * DAY)))
    inside = ad.guesses(spark, sf).select("device", S, E).crossJoin(F.broadcast(spark.createDataFrame([("present",), ("not_present",)], "state string")))
    return iv.intersect(since, inside, ["device", "state"])


@query(with_views(picked(f"SELECT DISTINCT device, {FROM}::BIGINT AS start_ms, {FROM + 12 * HOUR}::BIGINT AS end_ms FROM lab", "SELECT device, start_ms, end_ms FROM lab WHERE source = 'manual'", "device", "a > 0 AND b = 0")))
def sensor_range(spark: SparkSession, sf: str) -> DataFrame:
    """What a sensor may label of twelve hours: all that no human has (L4)."""
    rows = ad.labels(spark, sf)
    wanted = rows.select("device").distinct().withColumns({S: F.lit(FROM), E: F.lit(FROM + 12 * HOUR)})
    return iv.subtract(wanted, rows.where("source = 'manual'"), ["device"])
