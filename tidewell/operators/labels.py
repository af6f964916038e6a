"""Labels: edits of ranges, compaction, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv
from tidewell.operators.intervals import E, S


def remove_ranges(labels: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Labels without one range per key (columns a, b); of a label that it cuts, the outer parts stay."""
    rows = labels.join(ranges.select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b")), keys, "left")
    end, start = F.coalesce("_a", F.col(E)), F.coalesce("_b", F.col(E))
    parts = F.array(F.struct(F.col(S).alias("s"), F.least(F.col(E), end).alias("e")), F.struct(F.greatest(F.col(S), start).alias("s"), F.col(E).alias("e")))
    out = rows.withColumn("_p", F.explode(F.filter(parts, lambda p: p["e"] > p["s"])))
    return out.select(*[F.col("_p.s").alias(S) if c == S else F.col("_p.e").alias(E) if c == E else F.col(c) for c in labels.columns])


def apply_range(labels: DataFrame, ranges: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Labels with one range per key set to values."""
    new = ranges.select(*keys, F.col("a").alias(S), F.col("b").alias(E), *[v.alias(k) for k, v in values.items()])
    return remove_ranges(labels, ranges, keys).unionByName(new, allowMissingColumns=True)


def compact(labels: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """Runs of one state that overlap or touch merge; the last `keep` of each key by start stay."""
    runs = iv.union(labels, [*keys, "state"])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(S), F.desc(E), "state"))
    return runs.withColumn("_n", rank).where(F.col("_n") <= keep).drop("_n")


def members_state(states: DataFrame, members: DataFrame, owner: str, least: int) -> DataFrame:
    """(owner, start_ms, end_ms, state) of disjoint member states (device, start_ms, end_ms, state): Present where `least` members are, or all; Empty where all are."""
    size = members.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    rows = states.where("state != 'unknown'").join(members.select(owner, "device"), "device")
    found = iv.depth(rows, [owner], present=(F.col("state") == "present").cast("int"), empty=(F.col("state") == "not_present").cast("int"))
    state = F.when(F.col("present") >= F.least(F.lit(least), F.col("n")), "present").when((F.col("empty") == F.col("n")) & (F.col("present") == 0), "not_present")
    return iv.coalesce(found.join(size, owner).withColumn("state", state).where("state is not null").select(owner, S, E, "state"), [owner], ["state"])


def horizon(labels: DataFrame, end_ms: int, automatic_ms: int, human_ms: int) -> DataFrame:
    """Sensor labels clipped to the last stretch; of human ones the newest up to a total, the label that crosses it whole; human Unknown always."""
    line = Window.partitionBy("device", "source").orderBy(F.desc(E), F.desc(S), F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    known = labels.where("source = 'manual' and state != 'unknown'").withColumn("_before", F.coalesce(F.sum(F.col(E) - F.col(S)).over(line), F.lit(0)))
    human = known.where(F.col("_before") < human_ms).drop("_before")
    sensor = labels.where((F.col("source") == "sensor") & (F.col(E) > end_ms - automatic_ms)).withColumn(S, F.greatest(F.col(S), F.lit(end_ms - automatic_ms)))
    return human.unionByName(sensor).unionByName(labels.where("source = 'manual' and state = 'unknown'"))
