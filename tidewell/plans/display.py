"""Charts, pages, exports and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv
from tidewell.plans.registry import query
from tidewell.plans.signals import FROM, GATES, TO, coverage, holds, islands, picked, vectors
from tidewell.plans.statistics import HIST, hist
from tidewell.plans.truth import NOW
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import DAY, SCALE, with_views

E, S, B = iv.E, iv.S, SCALE.chart
_SLOT = f"SELECT device, channel, energy, slot, greatest(start_ms, slot * {B}) AS start_ms, least(end_ms, (slot + 1) * {B}) AS end_ms FROM (SELECT *, unnest(range(start_ms // {B}, (end_ms - 1) // {B} + 1)) AS slot FROM sp WHERE energy IS NOT NULL)"
_RUN = "SELECT *, sum(fresh) OVER (PARTITION BY device, channel, slot ORDER BY start_ms) AS part FROM (SELECT *, CASE WHEN lag(end_ms) OVER w = start_ms THEN 0 ELSE 1 END AS fresh FROM sl WINDOW w AS (PARTITION BY device, channel, slot ORDER BY start_ms))"


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    """(device, channel, slot, part, ...) per bucket and contiguous part of it; the mean is in thousandths, rounded half up."""
    rows = iv.split(holds(spark, sf).where("energy is not null"), B, "slot")
    line = Window.partitionBy("device", "channel", "slot").orderBy(S)
    rows = rows.withColumn("fresh", F.when(F.lag(E).over(line) == F.col(S), 0).otherwise(1)).withColumn("part", F.sum("fresh").over(line))
    ms = F.col(E) - F.col(S)
    first = lambda f, c: f(F.struct(S, E), F.struct(c, F.col(S)))[S]
    return rows.groupBy("device", "channel", "slot", "part").agg(
        F.min(S).alias(S), F.max(E).alias(E), F.sum(ms).alias("ms"), F.expr("(1000 * sum(energy * (end_ms - start_ms)) + sum(end_ms - start_ms) div 2) div sum(end_ms - start_ms)").alias("mean_milli"), F.min("energy").alias("low"), F.max("energy").alias("high"),
        first(F.min_by, F.col("energy")).alias("low_at"), first(F.min_by, -F.col("energy")).alias("high_at"))


@query(with_views("SELECT device, channel, slot, part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(end_ms - start_ms)::BIGINT AS ms, ((1000 * sum(energy * (end_ms - start_ms)) + sum(end_ms - start_ms) // 2) // sum(end_ms - start_ms))::BIGINT AS mean_milli, min(energy) AS low, max(energy) AS high, arg_min(start_ms, struct_pack(a := energy, b := start_ms)) AS low_at, arg_min(start_ms, struct_pack(a := -energy, b := start_ms)) AS high_at FROM rn GROUP BY device, channel, slot, part", sl=_SLOT, rn=_RUN))
def chart_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """A downsampled chart: time-weighted mean, extremes and where they first are, per bucket and contiguous part."""
    return buckets(spark, sf)


@query(with_views("SELECT device, slot, max(greatest(" + ", ".join(f"coalesce({g}, -1)" for g in GATES) + "))::INT AS top, count(*) AS n FROM (SELECT *, unnest(range(start_ms // " + f"{B}, (end_ms - 1) // {B} + 1)) AS slot FROM v WHERE " + " OR ".join(f"{g} IS NOT NULL" for g in GATES) + ") GROUP BY device, slot"))
def chart_strongest(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest gate of each bucket (V2)."""
    rows = vectors(spark, sf).withColumn("top", F.greatest(*GATES)).where("top is not null")
    return iv.split(rows, B, "slot").groupBy("device", "slot").agg(F.max("top").alias("top"), F.count(F.lit(1)).alias("n"))


COVER = islands("SELECT device, start_ms, end_ms FROM v", "device")


@query(with_views("SELECT * FROM (SELECT device, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY device ORDER BY start_ms) AS end_ms FROM cv) WHERE end_ms IS NOT NULL", cv=COVER))
def chart_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Time without a reading between the first and the last (V3)."""
    after = F.lead(S).over(Window.partitionBy("device").orderBy(S))
    return coverage(spark, sf).select("device", F.col(E).alias(S), after.alias(E)).where(F.col(E).isNotNull())


@query(with_views(islands(picked("SELECT device, source || '/' || state AS lane, start_ms, end_ms FROM lab UNION ALL SELECT device, 'guess/' || state, start_ms, end_ms FROM gs", "", "device, lane", "a > 0"), "device, lane")))
def evidence_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Human, sensor and guessed evidence merged lane by lane (V4)."""
    rows = ad.labels(spark, sf).select("device", F.concat_ws("/", "source", "state").alias("lane"), S, E)
    rows = rows.unionByName(ad.guesses(spark, sf).select("device", F.concat(F.lit("guess/"), "state").alias("lane"), S, E))
    return iv.union(rows, ["device", "lane"])


@query(with_views(f"SELECT *, end_ms > {TO - 300_000} AS open_ FROM (SELECT device, channel, slot, max(end_ms) AS end_ms, sum(end_ms - start_ms)::BIGINT AS ms FROM sl WHERE end_ms <= {TO} GROUP BY ALL)", sl=_SLOT))
def chart_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Settled buckets are kept, those that end in the last five minutes are open and computed again."""
    rows = iv.split(holds(spark, sf).where("energy is not null"), B, "slot").where(F.col(E) <= TO)
    return rows.groupBy("device", "channel", "slot").agg(F.max(E).alias(E), F.sum(F.col(E) - F.col(S)).alias("ms")).withColumn("open_", F.col(E) > TO - 300_000)


@query(with_views(f"SELECT start_ms, end_ms, {', '.join(GATES)} FROM v WHERE device = 1 AND end_ms > {FROM} AND start_ms < {TO} ORDER BY start_ms, end_ms LIMIT 100 OFFSET 50"))
def recording_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a device's rows."""
    rows = vectors(spark, sf).where(f"device = 1 and end_ms > {FROM} and start_ms < {TO}").orderBy(S, E)
    return rows.offset(50).limit(100).select(S, E, *GATES)


@query(with_views(f"SELECT device, day, count(*) AS n, sum(ms)::BIGINT AS ms FROM (SELECT device, k AS day, least(end_ms, (k + 1) * {DAY}) - greatest(start_ms, k * {DAY}) AS ms FROM (SELECT *, unnest(range(start_ms // {DAY}, (end_ms - 1) // {DAY} + 1)) AS k FROM v)) GROUP BY ALL"))
def recording_days(spark: SparkSession, sf: str) -> DataFrame:
    """The days of each recording with rows and covered time."""
    return iv.split(vectors(spark, sf), DAY, "day").groupBy("device", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(E) - F.col(S)).alias("ms"))


@query(with_views("SELECT device, start_ms, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S') || '.' || lpad((start_ms % 1000)::VARCHAR, 3, '0') || 'Z,' || ((end_ms - start_ms) // 1000) || '.' || lpad(((end_ms - start_ms) % 1000)::VARCHAR, 3, '0') || ',' || " + " || ',' || ".join(f"coalesce({g}::VARCHAR, '')" for g in GATES) + f" AS line FROM v WHERE start_ms >= {FROM} AND start_ms < {FROM + DAY}"))
def day_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a day's export; missing is an empty cell (K6)."""
    ms = F.col(E) - F.col(S)
    stamp = F.date_format(F.timestamp_millis(F.col(S)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    took = F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    line = F.concat_ws(",", stamp, took, *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in GATES])
    return vectors(spark, sf).where((F.col(S) >= FROM) & (F.col(S) < FROM + DAY)).select("device", S, line.alias("line"))


@query(with_views("SELECT device, '{\"device\":' || device || ',\"days\":' || count(*) || ',\"rows\":' || sum(n)::BIGINT || '}' AS doc FROM (SELECT device, start_ms // 86400000 AS day, count(*) AS n FROM v GROUP BY ALL) GROUP BY device"))
def json_export(spark: SparkSession, sf: str) -> DataFrame:
    """A document per device (K7)."""
    rows = vectors(spark, sf).groupBy("device", F.floor(F.col(S) / DAY)).agg(F.count(F.lit(1)).alias("n")).groupBy("device").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("rows"))
    return rows.select("device", F.to_json(F.struct("device", "days", "rows")).alias("doc"))


@query(with_views("SELECT device, channel, sum(ms)::BIGINT AS ms, min(energy) AS low, max(energy) AS high, round(sum(energy * ms) / sum(ms), 6)::DOUBLE AS mean FROM h GROUP BY device, channel", h=HIST))
def gate_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of every gate (K8)."""
    return hist(spark, sf).groupBy("device", "channel").agg(F.sum("ms").alias("ms"), F.min("energy").alias("low"), F.max("energy").alias("high"), F.round(F.sum(F.col("energy") * F.col("ms")) / F.sum("ms"), 6).alias("mean"))


@query(with_views("SELECT pattern, channel, old, new, row_number() OVER (PARTITION BY pattern ORDER BY new > old, channel) AS step FROM (SELECT pattern, unnest(range(5))::INT AS channel, 40 AS old, unnest(thresholds) AS new FROM pat) WHERE new <> old"))
def threshold_writes(spark: SparkSession, sf: str) -> DataFrame:
    """The order of writes to a device: lower before raising."""
    rows = ad.patterns(spark).select("pattern", F.posexplode("thresholds").alias("channel", "new")).withColumn("old", F.lit(40)).where("new != old")
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("pattern").orderBy(F.col("new") > F.col("old"), "channel"))).select("pattern", "channel", "old", "new", "step")


@query(with_views("""SELECT device, coalesce(any_value(e.energy), -1) AS last_energy, any_value(s.n) AS spans, coalesce(any_value(l.n), 0) AS labels, coalesce(any_value(g.n), 0) AS guesses FROM (SELECT device, count(*) AS n FROM sp GROUP BY ALL) s JOIN (SELECT device, last(energy ORDER BY ts_ms, seq) AS energy FROM r GROUP BY device) e USING (device)
    LEFT JOIN (SELECT device, count(*) AS n FROM lab GROUP BY ALL) l USING (device) LEFT JOIN (SELECT device, count(*) AS n FROM gs GROUP BY ALL) g USING (device) GROUP BY device"""))
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each device."""
    count = lambda df, name: df.groupBy("device").agg(F.count(F.lit(1)).alias(name))
    last = ad.readings(spark, sf).groupBy("device").agg(F.max_by(F.struct("energy"), F.struct("ts_ms", "seq"))["energy"].alias("e"))
    rows = count(holds(spark, sf), "spans").join(last, "device").join(count(ad.labels(spark, sf), "labels"), "device", "left").join(count(ad.guesses(spark, sf), "guesses"), "device", "left")
    return rows.select("device", F.coalesce("e", F.lit(-1)).alias("last_energy"), "spans", F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("guesses", F.lit(0)).alias("guesses"))


@query(with_views("SELECT device, count(*) FILTER (basis = 1) AS reference, count(*) FILTER (basis = 2) AS external, sum(end_ms - start_ms) FILTER (state = 'present')::BIGINT AS present_ms, round(sum(level * (end_ms - start_ms)) * 5.0 / sum(end_ms - start_ms), 6)::DOUBLE AS mean_percent FROM gs GROUP BY device"))
def auto_learning_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and weights of automatic evidence (V8)."""
    ms = F.col(E) - F.col(S)
    return ad.guesses(spark, sf).groupBy("device").agg(F.count(F.when(F.col("basis") == 1, 1)).alias("reference"), F.count(F.when(F.col("basis") == 2, 1)).alias("external"), F.sum(F.when(F.col("state") == "present", ms)).alias("present_ms"), F.round(F.sum(F.col("level") * ms) * 5.0 / F.sum(ms), 6).alias("mean_percent"))


HUMAN_AGE, AUTO_AGE, THIN_AGE = 20 * DAY, 14 * DAY, 4 * DAY
_KIND = f"SELECT device, day, start_ms, end_ms, human, level, CASE WHEN human THEN {NOW - HUMAN_AGE} ELSE {NOW - THIN_AGE} - ({AUTO_AGE - THIN_AGE}::BIGINT * greatest(0, level - 11)) // 9 END AS cutoff FROM (SELECT device, k AS day, greatest(start_ms, k * {DAY}) AS start_ms, least(end_ms, (k + 1) * {DAY}) AS end_ms, human, level FROM (SELECT *, unnest(range(start_ms // {DAY}, (end_ms - 1) // {DAY} + 1)) AS k FROM (SELECT device, start_ms, end_ms, false AS human, level FROM gs UNION ALL SELECT device, start_ms, end_ms, true, 20 FROM lab WHERE source = 'manual')))"


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """(device, day, start_ms, end_ms, human, level, cutoff): what a day holds and until when each part may stay; automatic ages slide with confidence."""
    auto = ad.guesses(spark, sf).select("device", S, E, F.lit(False).alias("human"), "level")
    rows = auto.unionByName(ad.labels(spark, sf).where("source = 'manual'").select("device", S, E, F.lit(True).alias("human"), F.lit(20).alias("level")))
    rows = iv.split(rows, DAY, "day").withColumn("x", F.greatest(F.lit(0), F.col("level") - 11).cast("long"))
    slide = F.expr(f"({AUTO_AGE - THIN_AGE}L * x) div 9")
    return rows.withColumn("cutoff", F.when(F.col("human"), F.lit(NOW - HUMAN_AGE)).otherwise(F.lit(NOW - THIN_AGE) - slide)).drop("x")


@query(with_views("SELECT device, day, start_ms, least(end_ms, cutoff) AS end_ms, human, level FROM ki WHERE start_ms < cutoff", ki=_KIND))
def retention_expired(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of days that are too old for what they are."""
    return ranges(spark, sf).where(F.col(S) < F.col("cutoff")).select("device", "day", S, F.least(E, "cutoff").alias(E), "human", "level")


_CUTS = "SELECT device, start_ms, least(end_ms, cutoff) AS end_ms FROM ki WHERE start_ms < cutoff AND NOT human"


@query(with_views(picked("SELECT device, start_ms, end_ms FROM v", "SELECT * FROM cu", "device", "a > 0 AND b = 0"), ki=_KIND, cu=_CUTS))
def retention_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage that is left when expired automatic parts are cut out."""
    cuts = ranges(spark, sf).where((F.col(S) < F.col("cutoff")) & ~F.col("human")).withColumn(E, F.least(E, "cutoff"))
    return iv.subtract(vectors(spark, sf), cuts, ["device"])


@query(with_views("SELECT device, day, human, level, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY human, level, day, device ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(bytes) OVER () AS total FROM (SELECT device, day, human, max(level) AS level, sum(end_ms - start_ms)::BIGINT // 1000 AS bytes FROM ki GROUP BY device, day, human)) WHERE coalesce(before, 0) < total // 4", ki=_KIND))
def size_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """What goes first until a quarter of the bytes is gone: automatic before human, the less certain, then the older.

    Rows here are parts of days, few against readings; they are summed by rank bands first, so that the running total of all is over bands only.
    """
    rows = ranges(spark, sf).groupBy("device", "day", "human").agg(F.max("level").alias("level"), F.expr("sum(end_ms - start_ms) div 1000").alias("bytes"))
    band = ["human", "level", "day"]
    sums = rows.groupBy(*band).agg(F.sum("bytes").alias("b"))
    sums = sums.withColumn("low", F.sum("b").over(Window.orderBy(*band)) - F.col("b")).withColumn("total", F.sum("b").over(Window.partitionBy()))
    own = F.sum("bytes").over(Window.partitionBy(*band).orderBy("device")) - F.col("bytes")
    rows = rows.join(sums.drop("b"), band).withColumn("before", own + F.col("low"))
    return rows.where(F.col("before") < F.expr("total div 4")).select("device", "day", "human", "level", "bytes")



