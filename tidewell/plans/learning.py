"""Six-second cells (at this data's scale), threshold fitting and audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import histograms as hg
from tidewell.operators import intervals as iv
from tidewell.operators import spans as sp
from tidewell.plans.registry import query
from tidewell.plans.signals import GATES, islands, picked, vectors
from tidewell.plans.statistics import LAST, LHIST, PIECES, labelled, last_label
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import HOUR, MINUTE, SCALE, with_views

E, S, C = iv.E, iv.S, SCALE.cell
G = ", ".join(GATES)
MAXES = ", ".join(f"max({g}) AS {g}" for g in GATES)
_CELL = f"SELECT device, cell, {MAXES}, sum(least(end_ms, (cell + 1) * {C}) - greatest(start_ms, cell * {C}))::BIGINT AS ms FROM (SELECT *, unnest(range(start_ms // {C}, (end_ms - 1) // {C} + 1)) AS cell FROM v WHERE " + " OR ".join(f"{g} IS NOT NULL" for g in GATES) + ") GROUP BY device, cell"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(device, cell, g0.., ms, coverage): the maxima of each cell of the grid; coverage 2 is whole, 1 partial."""
    known = F.coalesce(*GATES).isNotNull()
    rows = iv.split(vectors(spark, sf).where(known), C, "cell").groupBy("device", "cell").agg(*[F.max(g).alias(g) for g in GATES], F.sum(F.col(E) - F.col(S)).alias("ms"))
    return rows.withColumn("coverage", F.when(F.col("ms") == C, 2).otherwise(1))


@query(with_views(f"SELECT *, CASE WHEN ms = {C} THEN 2 ELSE 1 END AS coverage FROM ce", ce=_CELL))
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Maxima and coverage per grid cell."""
    return cells(spark, sf)


_PURE = f"SELECT ce.*, l.state FROM ce JOIN ll l ON l.device = ce.device AND l.start_ms <= ce.cell * {C} AND l.end_ms >= (ce.cell + 1) * {C} WHERE ce.ms = {C} AND l.state <> 'unknown'"
PURE = {"pc": PIECES, "ll": LAST, "ce": _CELL, "pu": _PURE}


def pure(spark: SparkSession, sf: str) -> DataFrame:
    """Whole cells inside one label, with its state."""
    rows = cells(spark, sf).where("coverage = 2").withColumn("at", F.col("cell") * C)
    truth = last_label(ad.labels(spark, sf), ["device"]).where("state != 'unknown'")
    return iv.at_time(rows, truth, ["device"], "at").where(F.col(E) >= F.col("at") + C).drop("at", S, E)


@query(with_views(f"SELECT device, state, {G}, count(*) AS n FROM pu GROUP BY ALL", **PURE))
def vector_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct vectors of pure cells and how often each comes."""
    return pure(spark, sf).groupBy("device", "state", *GATES).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT zone, count(*) AS cells, round(avg(top), 6)::DOUBLE AS mean_top FROM (SELECT zone, cell, count(*) AS k, max(greatest(" + ", ".join(f"coalesce({g}, 0)" for g in GATES) + ")) AS top FROM ce JOIN grp USING (device) WHERE ms = " + str(C) + " GROUP BY zone, cell) JOIN (SELECT zone, count(*) AS n FROM grp GROUP BY zone) USING (zone) WHERE k = n GROUP BY zone", ce=_CELL))
def joined_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells in which every member of a zone is read, with the strongest gate of any."""
    members = ad.groups(spark).select("zone", "device")
    rows = cells(spark, sf).where("coverage = 2").join(F.broadcast(members), "device").groupBy("zone", "cell").agg(F.count(F.lit(1)).alias("k"), F.max(F.greatest(*[F.coalesce(g, F.lit(0)) for g in GATES])).alias("top"))
    sizes = F.broadcast(members.groupBy("zone").agg(F.count(F.lit(1)).alias("n")))
    return rows.join(sizes, "zone").where("k = n").groupBy("zone").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("top"), 6).alias("mean_top"))


#: Thresholds of the other gates while one is searched.
OTHERS = [100, 30, 40, 50, 60]
DOMAIN = list(range(0, 101, 5))
_HITS = "(" + " OR ".join(f"coalesce({g} > {t}, false)" for g, t in zip(GATES, OTHERS, strict=True) if t < 100) + ")"
_CROSS = f"SELECT device, t AS threshold, coalesce(sum(n) FILTER (state = 'present' AND NOT hit AND g0 <= t), 0)::BIGINT AS missed, coalesce(sum(n) FILTER (state = 'not_present' AND (hit OR g0 > t)), 0)::BIGINT AS false_ FROM (SELECT device, state, coalesce(g0, 0) AS g0, {_HITS} AS hit, count(*) AS n FROM pu GROUP BY ALL), (SELECT unnest({DOMAIN}) AS t) GROUP BY device, t"


def crossing(spark: SparkSession, sf: str) -> DataFrame:
    """(device, threshold, missed, false_) of gate 0 for every legal value: one histogram of the mass no other gate covers, and its running sums."""
    hit = F.lit(False)
    for g, t in zip(GATES, OTHERS, strict=True):
        hit = hit | (F.coalesce(F.col(g) > t, F.lit(False)) if t < 100 else F.lit(False))
    rows = pure(spark, sf).select("device", "state", F.coalesce("g0", F.lit(0)).alias("energy"), hit.alias("hit"))
    present, empty = F.col("state") == "present", F.col("state") == "not_present"
    count = lambda c: F.count(F.when(c, 1))
    bins = rows.groupBy("device", "energy").agg(count(present & ~F.col("hit")).alias("p"), count(empty & ~F.col("hit")).alias("q"), count(empty & F.col("hit")).alias("always"))
    steps = bins.select("device").distinct().withColumn("energy", F.explode(F.array(*map(F.lit, DOMAIN)))).withColumn("step", F.lit(True))
    line = Window.partitionBy("device")
    every = bins.join(steps, ["device", "energy"], "full").fillna(0, ["p", "q", "always"])
    upto = line.orderBy("energy")
    sums = every.withColumns({"missed": F.sum("p").over(upto), "false_": F.sum("q").over(line) - F.sum("q").over(upto) + F.sum("always").over(line)})
    return sums.where("step").select("device", F.col("energy").alias("threshold"), "missed", "false_")


@query(with_views("SELECT * FROM cr", **PURE, cr=_CROSS))
def crossing_costs(spark: SparkSession, sf: str) -> DataFrame:
    """What each threshold of one gate misses and reports falsely, all at once."""
    return crossing(spark, sf)


@query(with_views("SELECT device, threshold, missed + false_ AS cost FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY missed + false_, threshold) AS n FROM cr) WHERE n <= 4", **PURE, cr=_CROSS))
def candidate_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The four cheapest crossings; the lower value wins ties."""
    rows = crossing(spark, sf).withColumn("cost", F.col("missed") + F.col("false_"))
    n = F.row_number().over(Window.partitionBy("device").orderBy("cost", "threshold"))
    return rows.withColumn("n", n).where("n <= 4").select("device", "threshold", "cost")


_DIL = f"SELECT device, cell, max(CASE WHEN hit THEN cell END) OVER (PARTITION BY device, seg ORDER BY cell RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) IS NOT NULL AS lit FROM (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY cell) AS seg FROM (SELECT device, cell, coalesce(g0 > 40, false) AS hit, lag(cell) OVER (PARTITION BY device ORDER BY cell) IS DISTINCT FROM cell - 1 AS fresh FROM ce WHERE ms = {C}))"


@query(with_views("SELECT p.device, p.state, count(*) AS cells, count(*) FILTER (d.lit) AS lit FROM pu p JOIN dl d ON d.device = p.device AND d.cell = p.cell GROUP BY ALL", **PURE, dl=_DIL))
def timed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A hit covers the next two cells too, but never beyond a gap in coverage."""
    line = Window.partitionBy("device").orderBy("cell")
    whole = cells(spark, sf).where("coverage = 2").withColumn("fresh", F.when(F.lag("cell").over(line).eqNullSafe(F.col("cell") - 1), 0).otherwise(1))
    whole = whole.withColumn("seg", F.sum("fresh").over(line))
    near = Window.partitionBy("device", "seg").orderBy("cell").rangeBetween(-2, 0)
    lit = whole.select("device", "cell", F.max(F.when(F.col("g0") > 40, F.col("cell"))).over(near).isNotNull().alias("lit"))
    return pure(spark, sf).join(lit, ["device", "cell"]).groupBy("device", "state").agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("lit"), 1)).alias("lit"))


@query(with_views("SELECT device, gate, count(*) AS n, min(energy)::INT AS weakest FROM (SELECT device, " + "CASE " + " ".join(f"WHEN coalesce({g} > 40, false) THEN {k}" for k, g in enumerate(GATES)) + " END AS gate, CASE " + " ".join(f"WHEN coalesce({g} > 40, false) THEN {g}" for g in GATES) + " END AS energy FROM pu WHERE state = 'present' AND " + " + ".join(f"coalesce({g} > 40, false)::INT" for g in GATES) + " = 1) GROUP BY device, gate", **PURE))
def exclusive_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of presence that only one gate sees, and its weakest energy there."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(g).alias("energy")) for k, g in enumerate(GATES)]), lambda x: x["energy"] > 40)
    rows = pure(spark, sf).where("state = 'present'").withColumn("x", pairs).where(F.size("x") == 1).select("device", F.inline("x"))
    return rows.groupBy("device", "gate").agg(F.count(F.lit(1)).alias("n"), F.min("energy").alias("weakest"))


_TE = "SELECT * FROM (SELECT device, start_ms, end_ms FROM hu UNION ALL SELECT device, start_ms + 120000, end_ms - 120000 FROM au) WHERE end_ms - start_ms >= 300000"
TRUSTED = {
    "hu": picked("SELECT device, start_ms, end_ms FROM lab WHERE source = 'manual' AND state = 'not_present'", "SELECT device, start_ms, end_ms FROM lab WHERE state = 'present'", "device", "a > 0 AND b = 0"),
    "au": picked("SELECT device, start_ms, end_ms FROM lab WHERE source = 'sensor' AND state = 'not_present'", "SELECT device, start_ms, end_ms FROM lab WHERE source = 'manual' OR state = 'present'", "device", "a > 0 AND b = 0"),
    "te": _TE,
}


def trusted(spark: SparkSession, sf: str) -> DataFrame:
    rows = ad.labels(spark, sf)
    present, manual = F.col("state") == "present", F.col("source") == "manual"
    human = iv.subtract(rows.where(manual & (F.col("state") == "not_present")), rows.where(present), ["device"])
    auto = iv.subtract(rows.where(~manual & (F.col("state") == "not_present")), rows.where(manual | present), ["device"])
    auto = auto.withColumn(S, F.col(S) + 120_000).withColumn(E, F.col(E) - 120_000)
    return human.unionByName(auto).where(F.col(E) - F.col(S) >= 300_000)


@query(with_views("SELECT * FROM te", **TRUSTED))
def trusted_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Empty time that can be trusted: human, and automatic without its edges."""
    return trusted(spark, sf)


_MAX = "SELECT s.device, s.channel, t.start_ms AS a, k, max(s.energy) AS top FROM sp s JOIN (SELECT *, unnest(range(start_ms // 1800000, (end_ms - 1) // 1800000 + 1)) AS k FROM te) t ON t.device = s.device AND s.start_ms < least(t.end_ms, (k + 1) * 1800000) AND greatest(t.start_ms, k * 1800000) < s.end_ms WHERE s.energy IS NOT NULL AND s.channel % 2 = 0 GROUP BY ALL"
_AR = f"SELECT p.device, p.start_ms AS arrival, p.start_ms - {10 * MINUTE} AS start_ms, p.start_ms + {10 * MINUTE} AS end_ms FROM pr p JOIN te t ON t.device = p.device AND t.end_ms <= p.start_ms AND t.end_ms > p.start_ms - {3 * HOUR} GROUP BY p.device, p.start_ms"
ARRIVE = {**TRUSTED, "pr": picked("SELECT device, start_ms, end_ms FROM lab WHERE state = 'present'", "", "device", "a > 0"), "ar": _AR}


def arrived(spark: SparkSession, sf: str) -> DataFrame:
    """(device, arrival, start_ms, end_ms): windows around starts of presence soon after trusted Empty."""
    starts = iv.union(ad.labels(spark, sf).where("state = 'present'"), ["device"]).select("device", F.col(S).alias("arrival"))
    after = trusted(spark, sf).select("device", F.col(E).alias(S), (F.col(E) + 3 * HOUR).alias(E))
    rows = iv.at_time(starts, after, ["device"], "arrival").select("device", "arrival").distinct()
    return rows.select("device", "arrival", (F.col("arrival") - 10 * MINUTE).alias(S), (F.col("arrival") + 10 * MINUTE).alias(E))


@query(with_views("SELECT * FROM ar", **ARRIVE))
def arrival_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Where someone arrives."""
    return arrived(spark, sf)


_NZ = "SELECT device, channel, tops[least(len(tops) - 1, floor(0.99 * len(tops))::BIGINT) + 1] AS noise FROM (SELECT device, channel, list_sort(list(top)) AS tops FROM mx GROUP BY device, channel)"
_BU = "SELECT device, channel, bs[least(len(bs) - 1, floor(0.5 * len(bs))::BIGINT) + 1] AS burst FROM (SELECT device, channel, list_sort(list(top)) AS bs FROM (SELECT a.device, s.channel, a.arrival, max(s.energy) AS top FROM ar a JOIN sp s ON s.device = a.device AND s.start_ms < a.end_ms AND a.start_ms < s.end_ms WHERE s.channel % 2 = 0 AND s.energy IS NOT NULL GROUP BY ALL) JOIN n2 USING (device, channel) WHERE top > noise GROUP BY device, channel)"


@query(with_views("SELECT device, channel, noise, burst, CASE WHEN burst IS NULL THEN 100 ELSE least(100, ceil((noise + (burst - noise) / 3.0) / 5) * 5)::INT END AS threshold FROM n2 LEFT JOIN b2 USING (device, channel)", **ARRIVE, mx=_MAX, n2=_NZ, b2=_BU))
def move_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds of move gates: a third of the way from noise to the burst of arrivals, the next legal value up; no burst is off."""
    spans_ = vectors_long(spark, sf).where("channel % 2 = 0")
    halves = iv.split(trusted(spark, sf).withColumn("a", F.col(S)), 1_800_000, "k")
    tops = iv.overlap_join(halves, spans_, ["device"]).groupBy("device", "channel", "a", "k").agg(F.max("energy").alias("top"))
    order = lambda q: F.element_at(F.array_sort(F.collect_list("top")), (F.least(F.count(F.lit(1)) - 1, F.floor(F.count(F.lit(1)) * q)) + 1).cast("int"))
    noise = tops.groupBy("device", "channel").agg(order(0.99).alias("noise"))
    bursts = iv.overlap_join(arrived(spark, sf), spans_, ["device"]).groupBy("device", "channel", "arrival").agg(F.max("energy").alias("top"))
    burst = bursts.join(noise, ["device", "channel"]).where("top > noise").groupBy("device", "channel").agg(order(0.5).alias("burst"))
    up = F.ceil((F.col("noise") + (F.col("burst") - F.col("noise")) / 3.0) / 5) * 5
    return noise.join(burst, ["device", "channel"], "left").withColumn("threshold", F.when(F.col("burst").isNull(), 100).otherwise(F.least(F.lit(100), up).cast("int")))


def vectors_long(spark: SparkSession, sf: str) -> DataFrame:
    from tidewell.plans.signals import holds

    return holds(spark, sf).where("energy is not null")


_MOVE = islands("SELECT device, start_ms, end_ms FROM v WHERE (coalesce(g0 > 40, false) OR coalesce(g2 > 40, false) OR coalesce(g4 > 40, false)) AND NOT (coalesce(g1 > 20, false) OR coalesce(g3 > 20, false))", "device")


@query(with_views(picked("SELECT device, start_ms, end_ms FROM lab WHERE state = 'present'", "SELECT * FROM mo", "device", "a > 0 AND b = 0"), mo=_MOVE))
def still_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Presence without the time when only move gates see it."""
    hit = lambda g, t: F.coalesce(F.col(g) > t, F.lit(False))
    only = vectors(spark, sf).where((hit("g0", 40) | hit("g2", 40) | hit("g4", 40)) & ~(hit("g1", 20) | hit("g3", 20)))
    return iv.subtract(ad.labels(spark, sf).where("state = 'present'"), only, ["device"])


_TOPS = "SELECT device, " + ", ".join(f"max(top) FILTER (channel = {c}) AS c{c}" for c in range(5)) + " FROM nz GROUP BY device"
_LOUD = "SELECT device, channel, coalesce(min(energy) FILTER (cum >= greatest(1, ceil(total * 0.9)::BIGINT)), 0) AS top FROM (SELECT *, sum(ms) OVER (PARTITION BY device, channel ORDER BY energy)::BIGINT AS cum, sum(ms) OVER (PARTITION BY device, channel)::BIGINT AS total FROM lh WHERE state = 'not_present') GROUP BY device, channel"
_WIN = f"SELECT p.device, l.start_ms AS label, p.state, (p.cell - l.start_ms // {C}) // 10 AS win, count(*) AS n, sum((" + " OR ".join(f"coalesce(p.{g} > t.c{k}, false)" for k, g in enumerate(GATES)) + f")::INT)::BIGINT AS loud FROM pu p JOIN ll l ON l.device = p.device AND l.start_ms <= p.cell * {C} AND p.cell * {C} < l.end_ms JOIN tp t ON t.device = p.device GROUP BY ALL"


def label_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of ten cells of each label: how many cells are louder than quiet time."""
    truth = last_label(ad.labels(spark, sf), ["device"]).where("state != 'unknown'").withColumn("label", F.col(S)).select("device", "label", S, E)
    rows = iv.at_time(pure(spark, sf).withColumn("at", F.col("cell") * C), truth, ["device"], "at").drop(S, E, "at")
    quiet = hg.durations(labelled(spark, sf).where("state = 'not_present'"), ["device", "channel"])
    tops = hg.quantile(quiet, ["device", "channel"], "q1", 0.9).groupBy("device").agg(*[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"c{c}") for c in range(len(GATES))])
    loud = F.lit(False)
    for k, g in enumerate(GATES):
        loud = loud | F.coalesce(F.col(g) > F.col(f"c{k}"), F.lit(False))
    win = F.floor((F.col("cell") - F.floor(F.col("label") / C)) / 10)
    return rows.join(tops, "device").groupBy("device", "label", "state", win.alias("win")).agg(F.count(F.lit(1)).alias("n"), F.sum(loud.cast("long")).alias("loud"))


@query(with_views("SELECT *, state = 'present' AND loud = 0 AS empty_like, state = 'not_present' AND 2 * loud > n AS occupied_like FROM wi", **PURE, lh=LHIST, nz=_LOUD, tp=_TOPS, wi=_WIN))
def anomaly_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of labels that look like the other class."""
    rows = label_windows(spark, sf)
    return rows.withColumns({"empty_like": (F.col("state") == "present") & (F.col("loud") == 0), "occupied_like": (F.col("state") == "not_present") & (2 * F.col("loud") > F.col("n"))})


@query(with_views("SELECT device, channel, ts_ms, seq, energy FROM (SELECT *, lag(energy, 1) OVER w AS a, lag(energy, 2) OVER w AS b, lead(energy, 1) OVER w AS c, lead(energy, 2) OVER w AS d FROM r WHERE energy IS NOT NULL WINDOW w AS (PARTITION BY device, channel ORDER BY ts_ms, seq)) WHERE energy <= 5 AND least(a, b, c, d) > 10 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL"))
def rare_dips(spark: SparkSession, sf: str) -> DataFrame:
    """Dips with high readings on both sides."""
    line = Window.partitionBy("device", "channel").orderBy("ts_ms", "seq")
    rows = ad.readings(spark, sf).where("energy is not null").withColumn("n", F.array(F.lag("energy", 1).over(line), F.lag("energy", 2).over(line), F.lead("energy", 1).over(line), F.lead("energy", 2).over(line)))
    return rows.where((F.col("energy") <= 5) & F.forall("n", lambda x: F.coalesce(x > 10, F.lit(False)))).drop("n")


#: The cheapest patterns of a search that are repaired and compared.
SHORTLIST = 16
#: The pattern in use.
START = tuple(ad.PATTERNS[0][1])


def _gate_stat(energy: np.ndarray, n: np.ndarray, yes: np.ndarray) -> tuple[np.ndarray, int | None, tuple[int, int] | None]:
    """A gate's known energies, the loudest of quiet time, and the gap from there to the lower quartile of presence, if there is one."""
    known = ~np.isnan(energy)
    loud, quiet = energy[known & yes].astype(int), energy[known & ~yes].astype(int)
    ceiling = int(quiet.max()) if len(quiet) else None
    mass = np.bincount(loud, n[known & yes], 101).cumsum()
    floor = int(np.argmax(mass >= 0.25 * mass[-1])) if len(loud) else None
    return energy[known].astype(int), ceiling, (ceiling, floor) if ceiling is not None and floor is not None and ceiling < floor else None


def _preferred(stat: tuple, loudest: int, current: int) -> int:
    """The centre of the gap; without one, just above quiet time where presence is louder, else the current value."""
    _, ceiling, gap = stat
    inside = [t for t in DOMAIN if gap and gap[0] < t < gap[1]]
    if inside:
        return max(inside, key=lambda t: (min(t - gap[0], gap[1] - t), -t))
    return current if ceiling is None or loudest <= ceiling else next(t for t in DOMAIN if t >= ceiling)


class _Search:
    """Coordinate descent over the distinct vectors of one device; all patterns that are met are a pool.

    Statistics of gates are of the rows marked main, where there are marks. Quiet presence is searched with three fifths of its energies."""

    def __init__(self, rows: pd.DataFrame, quiet: bool = False) -> None:
        raw = rows[GATES].to_numpy(float, na_value=np.nan)
        self.n, self.yes = rows["n"].to_numpy(), (rows["state"] == "present").to_numpy()
        if quiet:
            raw[self.yes] = np.floor(3 * raw[self.yes] / 5)
        main = rows["main"].to_numpy(bool) if "main" in rows else np.ones(len(rows), bool)
        self.x, self.total, self.empty = np.nan_to_num(raw), max(1, self.n[self.yes].sum()), max(1, self.n[~self.yes].sum())
        self.seen = [raw[~np.isnan(raw[:, c]), c].astype(int) for c in range(len(GATES))]
        self.stats = [_gate_stat(raw[main, c], self.n[main], self.yes[main]) for c in range(len(GATES))]
        self.loudest = [int(np.nanmax(raw[main & self.yes, c], initial=-1)) for c in range(len(GATES))]
        self.start, self.pool, self.ties = START, {}, {}
        self.centre = tuple(_preferred(s, m, a) for s, m, a in zip(self.stats, self.loudest, self.start, strict=True))
        self.seeds = (self.start, self.centre, (DOMAIN[-1],) * len(GATES))

    def cost(self, t: tuple) -> float:
        if t not in self.pool:
            hit = ((self.x > t) & (np.array(t) < 100)).any(1)
            self.pool[t] = round(float(100 * (self.n[self.yes & ~hit].sum() / self.total + self.n[~self.yes & hit].sum() / self.empty)), 9)
        return self.pool[t]

    def rank(self, t: tuple, c: int) -> tuple:
        _, ceiling, gap = self.stats[c]
        return self.cost(t), ceiling is not None and t[c] < ceiling, -min(t[c] - gap[0], gap[1] - t[c]) if gap else 0, t[c] != self.start[c], t[c]

    def run(self, now: tuple, sweeps: int = 3) -> tuple:
        """The pattern that a descent ends on; what ties let lower is noted."""
        for _ in range(sweeps):
            before = now
            for c in range(len(GATES)):
                if self.loudest[c] < 0:
                    continue
                every = [(*now[:c], v, *now[c + 1 :]) for v in DOMAIN]
                now, ceiling = min(every, key=lambda t: self.rank(t, c)), self.stats[c][1]  # noqa: B023
                self.ties[c] = min(t[c] for t in every if self.cost(t) == self.cost(now) and (t == now or t[c] < now[c] and (ceiling is None or t[c] >= ceiling)))
            if now == before:
                break
        return now

    def ordered(self) -> list[tuple]:
        return sorted(self.pool, key=lambda t: (self.pool[t], t))

    def shortlist(self) -> list[tuple]:
        """The cheapest of the pool, and the best with lowered ties, gate by gate and in all."""
        ordered = self.ordered()
        low = tuple(min(v, self.ties.get(c, v)) for c, v in enumerate(ordered[0]))
        return [*ordered[:SHORTLIST], *[(*ordered[0][:c], low[c], *ordered[0][c + 1 :]) for c in range(len(GATES))], low]

    def repaired(self, t: tuple) -> tuple:
        return _repaired(t, self.start, self.seen, self.stats)


def _repaired(t: tuple, start: tuple, seen: list[np.ndarray], stats: list[tuple]) -> tuple:
    """A gate without a gap keeps its start where the move crosses no energy."""
    return tuple(a if gap is None and not ((e > min(a, v)) & (e <= max(a, v))).any() else v for a, v, e, (_, _, gap) in zip(start, t, seen, stats, strict=True))


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    """Coordinate descent over the distinct vectors of one device from the pattern in use, the gap centres and all gates off; all patterns that are
    met are a pool, the SHORTLIST cheapest and the best with lowered ties are repaired, and the cheapest of these is returned; of equals the one with fewer gates below quiet time, then nearer to the gaps' centres, then with fewer changes."""
    search = _Search(rows)
    for seed in search.seeds:
        search.run(seed)
    found = {search.repaired(t) for t in (search.start, search.centre, *search.shortlist())}
    best = min(found, key=lambda t: (search.cost(t), *(sum(x) for x in zip(*(search.rank(t, c)[1:4] for c in range(len(GATES))), strict=True)), t))
    return pd.DataFrame({"device": [rows["device"].iloc[0]], "thresholds": [list(best)], "cost": [search.cost(best)]})


def learned(spark: SparkSession, sf: str, devices: list[int] | None = None) -> DataFrame:
    """The fit of some devices, or of all; only the readings of these are folded."""
    rows = vector_multiplicity(spark, sf)
    rows = rows if devices is None else rows.where(F.col("device").isin(devices))
    return rows.groupBy("device").applyInPandas(_fitted, "device long, thresholds array<int>, cost double")


@query()
def learn_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds by coordinate descent over each device's distinct vectors (G5, G7); the vectors are few, however long the history."""
    return learned(spark, sf)


@query(with_views("SELECT device, threshold, round(least(100, 500 * (greatest(0, missed / present - 0.1))), 6)::DOUBLE AS quiet_cost, round(least(1, present * " + str(C) + " / 14400000.0), 6)::DOUBLE AS weight FROM (SELECT device, t AS threshold, sum(CASE WHEN 3 * g0 // 5 <= t AND NOT hit THEN n ELSE 0 END)::BIGINT AS missed, sum(n)::BIGINT AS present FROM (SELECT device, coalesce(g0, 0) AS g0, " + _HITS + " AS hit, count(*) AS n FROM pu WHERE state = 'present' GROUP BY ALL), (SELECT unnest([20, 40, 60]) AS t) GROUP BY device, t)", **PURE))
def quiet_presence_cost(spark: SparkSession, sf: str) -> DataFrame:
    """What thresholds would cost if people were quieter: energies at three fifths."""
    hit = F.lit(False)
    for g, t in zip(GATES, OTHERS, strict=True):
        hit = hit | (F.coalesce(F.col(g) > t, F.lit(False)) if t < 100 else F.lit(False))
    rows = pure(spark, sf).where("state = 'present'").select("device", F.expr("(3 * coalesce(g0, 0)) div 5").alias("e"), hit.alias("hit"), F.explode(F.array(F.lit(20), F.lit(40), F.lit(60))).alias("threshold"))
    rows = rows.groupBy("device", "threshold").agg(F.count(F.when(~F.col("hit") & (F.col("e") <= F.col("threshold")), 1)).alias("missed"), F.count(F.lit(1)).alias("present"))
    cost = F.least(F.lit(100.0), 500 * F.greatest(F.lit(0.0), F.col("missed") / F.col("present") - 0.1))
    return rows.select("device", "threshold", F.round(cost, 6).alias("quiet_cost"), F.round(F.least(F.lit(1.0), F.col("present") * C / 14_400_000.0), 6).alias("weight"))


@query(with_views("SELECT device, threshold - s AS threshold, s AS shift, missed, false_ FROM (SELECT device, t AS threshold, 0 AS x FROM (SELECT unnest([40]) AS t), (SELECT DISTINCT device FROM cr)) b, (SELECT unnest([0, 5, 10, 15, 20]) AS s) JOIN cr ON cr.threshold = b.threshold - s AND cr.device = b.device".replace("SELECT device, threshold - s AS threshold", "SELECT b.device, b.threshold - s AS threshold"), **PURE, cr=_CROSS))
def presence_shift(spark: SparkSession, sf: str) -> DataFrame:
    """What lowering the threshold of one gate in steps of five saves and costs; no walk over all gates."""
    rows = crossing(spark, sf).where("threshold between 20 and 40")
    return rows.select("device", "threshold", (40 - F.col("threshold")).alias("shift"), "missed", "false_")


_CONF = "SELECT device, pattern, count(*) FILTER (present AND hit) AS tp, count(*) FILTER (present AND NOT hit) AS fn, count(*) FILTER (NOT present AND hit) AS fp, count(*) FILTER (NOT present AND NOT hit) AS tn FROM (SELECT device, pattern, state = 'present' AS present, " + " OR ".join(f"coalesce({g} > thresholds[{k + 1}] AND thresholds[{k + 1}] < 100, false)" for k, g in enumerate(GATES)) + " AS hit FROM pu, pat) GROUP BY device, pattern"


@query(with_views("SELECT *, round(tp / greatest(tp + fn, 1)::DOUBLE, 6)::DOUBLE AS sensitivity, round(fp / greatest(fp + tn, 1)::DOUBLE, 6)::DOUBLE AS false_rate FROM cf", **PURE, cf=_CONF))
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of each class that each pattern detects, or not."""
    hit = sp.any_above(GATES, [F.element_at("thresholds", k + 1) for k in range(len(GATES))])
    rows = pure(spark, sf).crossJoin(F.broadcast(ad.patterns(spark))).select("device", "pattern", (F.col("state") == "present").alias("p"), hit.alias("h"))
    count = lambda c: F.count(F.when(c, 1))
    rows = rows.groupBy("device", "pattern").agg(count(F.col("p") & F.col("h")).alias("tp"), count(F.col("p") & ~F.col("h")).alias("fn"), count(~F.col("p") & F.col("h")).alias("fp"), count(~F.col("p") & ~F.col("h")).alias("tn"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)), 6)
    return rows.withColumns({"sensitivity": share("tp", "fn"), "false_rate": share("fp", "tn")})
