"""References, groups, timing, outside sources and plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv
from tidewell.plans.registry import query
from tidewell.plans.scoring import PRICE, costs
from tidewell.plans.signals import FROM, GATES, holds, islands, vectors
from tidewell.plans.statistics import LAST, PIECES, last_label
from tidewell.plans.truth import NOW as WEEK3
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import DAY, MINUTE, with_views

E, S = iv.E, iv.S
HALF = 30 * MINUTE
#: After the end of the recording.
NOW = WEEK3 + 15 * DAY
_PER = f"SELECT s.device, s.channel, l.state, k AS period, s.energy, sum(least(s.end_ms, l.end_ms, (k + 1) * {HALF}) - greatest(s.start_ms, l.start_ms, k * {HALF}))::BIGINT AS ms FROM (SELECT *, unnest(range(start_ms // {HALF}, (end_ms - 1) // {HALF} + 1)) AS k FROM sp WHERE energy IS NOT NULL) s JOIN ll l ON l.device = s.device AND greatest(s.start_ms, k * {HALF}) < l.end_ms AND l.start_ms < least(s.end_ms, (k + 1) * {HALF}) WHERE l.state <> 'unknown' GROUP BY ALL"
_NEW = "SELECT * EXCLUDE (n) FROM (SELECT *, dense_rank() OVER (PARTITION BY device, state ORDER BY period DESC) AS n FROM pe) WHERE n <= 24"
PERIOD = {"pc": PIECES, "ll": LAST, "pe": _PER, "nw": _NEW}


def periods(spark: SparkSession, sf: str) -> DataFrame:
    """(device, channel, state, period, energy, ms): what was seen in each clock half-hour of each state; of a device and state the newest 24."""
    truth = last_label(ad.labels(spark, sf), ["device"]).where("state != 'unknown'")
    rows = iv.overlap_join(iv.split(holds(spark, sf).where("energy is not null"), HALF, "period"), truth, ["device"])
    rows = rows.groupBy("device", "channel", "state", "period", "energy").agg(F.sum(F.col(E) - F.col(S)).alias("ms"))
    newest = rows.select("device", "state", "period").distinct().withColumn("n", F.row_number().over(Window.partitionBy("device", "state").orderBy(F.desc("period")))).where("n <= 24").drop("n")
    return rows.join(newest, ["device", "state", "period"]).select("device", "channel", "state", "period", "energy", "ms")


@query(with_views("SELECT * FROM nw", **PERIOD))
def reference_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Reference periods at half-hour boundaries."""
    return periods(spark, sf)


def freshness(days):
    """0.8 of a seven-day half-life and 0.2 of a sixty-day one."""
    return F.lit(0.8) * F.pow(F.lit(2.0), -days / 7) + F.lit(0.2) * F.pow(F.lit(2.0), -days / 60)


_FRESH = "(0.8::DOUBLE * pow(2.0::DOUBLE, -({d}) / 7) + 0.2::DOUBLE * pow(2.0::DOUBLE, -({d}) / 60))"
_AGE = f"({NOW} - (period + 1) * {HALF}) / {DAY}.0::DOUBLE"


@query(with_views(f"SELECT device, state, period, round({_FRESH.format(d=_AGE)}, 6)::DOUBLE AS freshness, round(1.0 * (0.7 + 0.3 * {_FRESH.format(d=_AGE)}), 6)::DOUBLE AS cap FROM (SELECT DISTINCT device, state, period FROM nw) WHERE (period + 1) * {HALF} <= {NOW}", **PERIOD))
def reference_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """How much a period counts by its age, and how far it lets confidence go."""
    rows = periods(spark, sf).select("device", "state", "period").distinct().where((F.col("period") + 1) * HALF <= NOW)
    fresh = freshness((F.lit(NOW) - (F.col("period") + 1) * HALF) / float(DAY))
    return rows.select("device", "state", "period", F.round(fresh, 6).alias("freshness"), F.round(F.lit(1.0) * (0.7 + 0.3 * fresh), 6).alias("cap"))


@query(with_views(f"SELECT device, channel, state, energy, round(sum(ms / 6000.0::DOUBLE * least(1, 120 / (total / 6000.0::DOUBLE)) * {_FRESH.format(d=_AGE)}), 4)::DOUBLE AS mass FROM (SELECT *, sum(ms) OVER (PARTITION BY device, channel, state, period)::BIGINT AS total FROM nw) WHERE (period + 1) * {HALF} <= {NOW} GROUP BY ALL", **PERIOD))
def reference_pool(spark: SparkSession, sf: str) -> DataFrame:
    """References pooled: at most 120 units of a period, by freshness."""
    rows = periods(spark, sf).where((F.col("period") + 1) * HALF <= NOW)
    total = F.sum("ms").over(Window.partitionBy("device", "channel", "state", "period"))
    fresh = freshness((F.lit(NOW) - (F.col("period") + 1) * HALF) / float(DAY))
    mass = F.col("ms") / 6000.0 * F.least(F.lit(1.0), 120 / (total / 6000.0)) * fresh
    return rows.withColumn("m", mass).groupBy("device", "channel", "state", "energy").agg(F.round(F.sum("m"), 4).alias("mass"))


@query(with_views(f"SELECT r.device, r.seq, r.channel, r.energy FROM r JOIN (SELECT device, channel, list(DISTINCT energy) AS seen FROM r WHERE ts_ms < {FROM} AND energy IS NOT NULL GROUP BY device, channel) s ON s.device = r.device AND s.channel = r.channel WHERE r.ts_ms >= {FROM} AND r.energy IS NOT NULL AND list_min(list_transform(seen, lambda x: abs(x - r.energy))) > 6"))
def unfamiliar_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings more than six away from all an earlier reference has seen (F11). A channel has 101 energies, so the arrays are short."""
    rows = ad.readings(spark, sf).where("energy is not null")
    seen = rows.where(F.col("ts_ms") < FROM).groupBy("device", "channel").agg(F.collect_set("energy").alias("seen"))
    far = F.array_min(F.transform("seen", lambda x: F.abs(x - F.col("energy")))) > 6
    return rows.where(F.col("ts_ms") >= FROM).join(seen, ["device", "channel"]).where(far).select("device", "seq", "channel", "energy")


@query(with_views("SELECT zone, min(root) AS learning_set FROM cc GROUP BY zone", cc="SELECT zone, zone AS root FROM grp UNION SELECT b.zone, cc.root FROM cc JOIN grp a ON a.zone = cc.zone JOIN grp b ON b.device = a.device"))
def learning_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Zones that share devices learn together: the smallest label spreads until nothing changes (J17). Zones are a small dimension."""
    g = ad.groups(spark).select("zone", "device")
    label = {r["zone"]: r["zone"] for r in g.select("zone").distinct().collect()}  # a row for each zone of a home
    while True:
        known = F.broadcast(spark.createDataFrame(sorted(label.items()), "zone string, root string"))
        low = g.join(known, "zone").groupBy("device").agg(F.min("root").alias("low"))
        new = g.join(low, "device").groupBy("zone").agg(F.min("low").alias("learning_set"))
        found = {r["zone"]: r["learning_set"] for r in new.collect()}
        if found == label:
            return new
        label = found


@query(with_views("SELECT area, zone, device, 'member' AS leaf FROM grp UNION ALL SELECT 'elsewhere', NULL, d, 'fallback' FROM (SELECT DISTINCT user_id % 11 AS d FROM events) WHERE d NOT IN (SELECT device FROM grp)"))
def layout_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Every device has a place: in its zones, or elsewhere."""
    g = ad.groups(spark)
    devices = ad.events(spark, sf).select((F.col("user_id") % 11).alias("device")).distinct()
    rest = devices.join(g, "device", "left_anti").select(F.lit("elsewhere").alias("area"), F.lit(None).cast("string").alias("zone"), "device", F.lit("fallback").alias("leaf"))
    return g.select("area", "zone", "device", F.lit("member").alias("leaf")).unionByName(rest)


_TIME = "SELECT device, CASE WHEN device % 3 = 0 THEN NULL ELSE device * 5 END AS timeout, CASE WHEN device % 2 = 0 THEN 'min' ELSE 's' END AS unit FROM (SELECT DISTINCT device FROM grp)"


@query(with_views("SELECT device, CASE unit WHEN 'min' THEN timeout * 60 ELSE timeout END AS seconds, coalesce(CASE unit WHEN 'min' THEN timeout * 60 ELSE timeout END, 30) AS with_default, timeout IS NULL AS filters_off FROM ti", ti=_TIME))
def timing_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Timing in seconds, with a default; an unknown timeout turns hold and filters off."""
    rows = ad.groups(spark).select("device").distinct().withColumn("timeout", F.when(F.col("device") % 3 != 0, F.col("device") * 5))
    secs = F.when(F.col("device") % 2 == 0, F.col("timeout") * 60).otherwise(F.col("timeout"))
    return rows.select("device", secs.alias("seconds"), F.coalesce(secs, F.lit(30).cast("long")).alias("with_default"), F.col("timeout").isNull().alias("filters_off"))


@query(with_views("SELECT pattern, pos AS channel, t AS value, (SELECT max(x) FROM (SELECT unnest(range(0, 101, 7)) AS x) WHERE x <= t)::INT AS legal_down, coalesce((SELECT min(x) FROM (SELECT unnest(range(0, 101, 7)) AS x) WHERE x >= t), 98)::INT AS legal_up, (SELECT arg_min(x, struct_pack(a := abs(x - t), b := -x)) FROM (SELECT unnest(range(0, 101, 7)) AS x))::INT AS nearest FROM (SELECT pattern, unnest(thresholds) AS t, unnest(range(5))::INT AS pos FROM pat)"))
def legal_values(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds moved to a domain of steps of seven: down, up and nearest, ties to the higher."""
    domain = F.sequence(F.lit(0), F.lit(100), F.lit(7))
    rows = ad.patterns(spark).select("pattern", F.posexplode("thresholds").alias("channel", "value")).withColumn("d", domain)
    near = F.array_min(F.transform("d", lambda x: F.struct(F.abs(x - F.col("value")).alias("a"), (-x).alias("b"))))
    return rows.select("pattern", "channel", "value", F.array_max(F.filter("d", lambda x: x <= F.col("value"))).alias("legal_down"), F.coalesce(F.array_min(F.filter("d", lambda x: x >= F.col("value"))), F.lit(98)).alias("legal_up"), (-near["b"]).alias("nearest"))


_EXT = "SELECT user_id % 4 AS room, event_id % 3 AS kind, event_type = 'click' AS on_, ts_ms AS start_ms, ts_ms + 1800000 AS end_ms FROM ev WHERE event_type IN ('click', 'signup')"


@query(with_views(islands("SELECT room, start_ms, end_ms, CASE WHEN a > 0 THEN 'present' WHEN b > 0 THEN 'not_present' END AS state FROM (" + "SELECT * FROM (SELECT room, t AS start_ms, lead(t) OVER w AS end_ms, sum(a) OVER w AS a, sum(b) OVER w AS b FROM (SELECT room, t, sum(a) AS a, sum(b) AS b FROM (SELECT room, unnest([start_ms, end_ms]) AS t, unnest([1, -1]) * on_::INT AS a, unnest([1, -1]) * (NOT on_)::INT AS b FROM ex) GROUP BY room, t) WINDOW w AS (PARTITION BY room ORDER BY t)) WHERE end_ms IS NOT NULL" + ") WHERE a > 0 OR b > 0", "room", "state"), ex=_EXT))
def external_state(spark: SparkSession, sf: str) -> DataFrame:
    """Outside sources of a room as one state: any that is on wins, all that are there must be off for Empty."""
    rows = ad.events(spark, sf).where("event_type in ('click', 'signup')")
    rows = rows.select((F.col("user_id") % 4).alias("room"), (F.col("event_type") == "click").cast("int").alias("on_"), F.col("ts_ms").alias(S), (F.col("ts_ms") + 1_800_000).alias(E))
    found = iv.depth(rows, ["room"], a=F.col("on_"), b=1 - F.col("on_")).where("a > 0 or b > 0")
    return iv.coalesce(found.select("room", S, E, F.when(F.col("a") > 0, "present").otherwise("not_present").alias("state")), ["room"], ["state"])


@query(with_views("SELECT device, max(priority) AS priority, count(*) AS rooms FROM grp GROUP BY device"))
def presence_priority(spark: SparkSession, sf: str) -> DataFrame:
    """A device has the highest priority of its rooms."""
    return ad.groups(spark).groupBy("device").agg(F.max("priority").alias("priority"), F.count(F.lit(1)).alias("rooms"))


@query("SELECT user_id % 8 AS device, count(*) AS feedbacks, list_reduce(list_prepend(0::BIGINT, list((CASE WHEN event_type = 'error' THEN 40 ELSE -5 END)::BIGINT ORDER BY ts, event_id)), lambda b, x: greatest(-100, least(400, b + x))) AS bias_percent FROM events GROUP BY user_id % 8")
def feedback_bias(spark: SparkSession, sf: str) -> DataFrame:
    """The bias after all feedback: up 0.4 when wrong, down 0.05 when right, clamped at each step to -1..4.

    Steps x -> clamp(x + s, lo, hi) make such a step again when one follows another, so the feedback of a device's day is folded to one step, and days to the bias.
    """
    low, high = F.lit(-100).cast("long"), F.lit(400).cast("long")

    def then(b: Column, x: Column) -> Column:
        def held(v: Column) -> Column:
            return F.greatest(x["lo"], F.least(x["hi"], v))

        return F.struct((b["s"] + x["s"]).alias("s"), held(b["lo"] + x["s"]).alias("lo"), held(b["hi"] + x["s"]).alias("hi"))

    none = F.struct(F.lit(0).cast("long").alias("s"), F.lit(-(1 << 40)).alias("lo"), F.lit(1 << 40).alias("hi"))
    step = F.struct(F.when(F.col("event_type") == "error", 40).otherwise(-5).cast("long").alias("s"), low.alias("lo"), high.alias("hi"))
    rows = ad.events(spark, sf).select((F.col("user_id") % 8).alias("device"), F.floor(F.col("ts_ms") / DAY).alias("day"), F.struct("ts", "event_id", step.alias("x")).alias("x"))
    days = rows.groupBy("device", "day").agg(F.count(F.lit(1)).alias("n"), F.aggregate(F.array_sort(F.collect_list("x")), none, lambda b, x: then(b, x["x"])).alias("x"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("day", "x"))), none, lambda b, x: then(b, x["x"]))
    out = days.groupBy("device").agg(F.sum("n").alias("feedbacks"), whole.alias("x"))
    return out.select("device", "feedbacks", F.greatest(F.col("x.lo"), F.least(F.col("x.hi"), F.col("x.s"))).alias("bias_percent"))


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """(device, pattern, signature) of the evidence that a pattern's price rests on."""
    parts = [F.col("device").cast("string"), F.col("pattern").cast("string"), *[F.coalesce(c, F.lit(-1)).cast("string") for c in ("present_ms", "empty_ms")]]
    return costs(spark, sf).select("device", "pattern", F.md5(F.concat_ws(":", *parts)).alias("signature"))


@query(with_views("SELECT c.device, c.pattern, md5(c.device || ':' || c.pattern || ':' || coalesce(present_ms, -1) || ':' || coalesce(empty_ms, -1)) AS signature FROM cp c WHERE c.device % 2 = 0", **PRICE))
def overnight_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What is to be learned tonight: items whose evidence signature is not the one seen last (G28). Here those of odd devices count as seen; Engine.overnight has the stored ones."""
    rows = signatures(spark, sf)
    known = rows.where("device % 2 = 1")
    return rows.join(known, ["device", "pattern", "signature"], "left_anti").select("device", "pattern", "signature")


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Episodes of a zone's day in time order; a row takes one that begins within the gap, unless it has that device."""
    out: list[dict] = []
    for r in rows.sort_values(["start_ms", "end_ms", "device"]).itertuples():
        last = out[-1] if out else None
        if last and r.start_ms <= last["end_ms"] + 12_000 and r.device not in last["devices"]:
            last["end_ms"] = max(last["end_ms"], r.end_ms)
            last["devices"].append(r.device)
        else:
            out.append({"zone": r.zone, "start_ms": r.start_ms, "end_ms": r.end_ms, "devices": [r.device]})
    return pd.DataFrame(out, columns=["zone", "start_ms", "end_ms", "devices"])


@query()
def merged_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Members' activity that overlaps or follows within twelve seconds is one row, never two of one device (J14). A fold of a zone's day."""
    active = iv.coalesce(vectors(spark, sf).where(" or ".join(f"coalesce({g} > 40, false)" for g in GATES)).select("device", S, E), ["device"])
    rows = active.join(F.broadcast(ad.groups(spark).select("zone", "device")), "device").withColumn("day", F.floor(F.col(S) / DAY))
    return rows.groupBy("zone", "day").applyInPandas(_merge, "zone string, start_ms long, end_ms long, devices array<long>")

