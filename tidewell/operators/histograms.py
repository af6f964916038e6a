"""Duration histograms over energies 0..100, and the quantile rules, all exact and all different."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.intervals import E, S


def durations(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, energy, ms): how long each energy held; bins are rounded up."""
    return spans.where("energy is not null").groupBy(*keys, F.ceil("energy").cast("int").alias("energy")).agg(F.sum(F.col(E) - F.col(S)).alias("ms"))


def cumulated(bins: DataFrame, keys: list[str], mass: str = "ms") -> DataFrame:
    """Adds cum, the mass up to and including each energy, and total."""
    line = Window.partitionBy(*keys)
    return bins.withColumn("cum", F.sum(mass).over(line.orderBy("energy"))).withColumn("total", F.sum(mass).over(line))


def first_where(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("energy")))


#: The first bin that meets the rule, of cum and total at quantile q. Fixed rules, by their number in SURVEY 2.4.
RULES = {
    "q1": lambda q: F.coalesce(first_where(F.col("cum") >= F.greatest(F.lit(1), F.ceil(F.col("total") * q))), F.lit(0)),
    "q2": lambda q: first_where(F.col("cum") >= F.col("total") * q),
    "q3": lambda q: F.coalesce(first_where(F.col("cum") >= F.greatest(F.lit(1), F.floor((F.col("total") - 1) * q) + 1)), F.lit(0)),
    "q4": lambda q: F.least(F.max("energy"), first_where(F.col("cum") > F.floor((F.col("total") - 1) * q)) + 3),
    "q5": lambda q: F.least(F.lit(100), F.coalesce(first_where(F.col("cum") > F.col("total") * q), F.lit(100))) + 3,
    "q6": lambda q: first_where((F.col("cum") >= F.col("total") * q) & (F.col("total") * q > 0)),
    "q7": lambda q: first_where(F.col("cum") > F.least(F.col("total") - 1, F.floor(F.col("total") * q))),
}


def quantile(bins: DataFrame, keys: list[str], rule: str, q: float, mass: str = "ms", name: str = "value") -> DataFrame:
    return cumulated(bins, keys, mass).groupBy(*keys).agg(RULES[rule](q).alias(name))
