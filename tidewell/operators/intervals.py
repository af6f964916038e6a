"""Interval algebra on half-open [start_ms, end_ms) rows with integer milliseconds.

Everything that can be is a sweep: edges with +1 and -1, summed per instant before the running sum, so that equal edges have no order. A sweep
costs one shuffle on the keys and never meets the other side in a join. The overlay with precedence asks which of many intervals wins, which is
no sum: it is done in numpy, by key and time bucket. Joins in time are on the keys and a time bucket, since a range condition alone would be a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S, E = "start_ms", "end_ms"
#: Time buckets that range joins meet in.
BUCKET_MS = 6 * 3_600_000


def proper(df: DataFrame) -> DataFrame:
    """Rows that last; a zero-length row is no span."""
    return df.where(F.col(E) > F.col(S))


def depth(df: DataFrame, keys: list[str], **weights: Column) -> DataFrame:
    """(keys, start_ms, end_ms, one running sum per weight) between neighbouring edges; by default one weight, depth, that counts intervals."""
    weights = weights or {"depth": F.lit(1)}
    df = proper(df)
    edges = df.select(*keys, F.col(S).alias("at"), *[w.alias(n) for n, w in weights.items()]).unionByName(df.select(*keys, F.col(E).alias("at"), *[(-w).alias(n) for n, w in weights.items()]))
    edges = edges.groupBy(*keys, "at").agg(*[F.sum(n).alias(n) for n in weights])
    line = Window.partitionBy(*keys).orderBy("at")
    sums = edges.select(*keys, F.col("at").alias(S), F.lead("at").over(line).alias(E), *[F.sum(n).over(line).alias(n) for n in weights])
    return sums.where(F.col(E).isNotNull())


def coalesce(df: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """Disjoint rows merged where one ends as the next of equal values begins."""
    values = values or []
    line = Window.partitionBy(*keys).orderBy(S, E)
    same = reduce(lambda a, b: a & b, [F.lag(v).over(line).eqNullSafe(F.col(v)) for v in values], F.lag(E).over(line) == F.col(S))
    marked = df.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(line))
    return marked.groupBy(*keys, *values, "_run").agg(F.min(S).alias(S), F.max(E).alias(E)).drop("_run")


def union(df: DataFrame, keys: list[str]) -> DataFrame:
    """What any interval covers."""
    return coalesce(depth(df, keys).where("depth > 0").select(*keys, S, E), keys)


def covered_times(df: DataFrame, keys: list[str], times: Column | int) -> DataFrame:
    """What exactly so many intervals cover: all members of n disjoint sets, or one alone."""
    return coalesce(depth(df, keys).where(F.col("depth") == times).select(*keys, S, E), keys)


def both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, S, E, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, S, E, F.lit(0).alias("a"), F.lit(1).alias("b")))


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What both sets cover."""
    return coalesce(depth(both(a, b, keys), keys, a=F.col("a"), b=F.col("b")).where("a > 0 and b > 0").select(*keys, S, E), keys)


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What the first set covers and the second does not."""
    return coalesce(depth(both(a, b, keys), keys, a=F.col("a"), b=F.col("b")).where("a > 0 and b = 0").select(*keys, S, E), keys)


def pieces(df: DataFrame, keys: list[str]) -> DataFrame:
    """Elementary intervals between all edges, where at least one interval is."""
    return depth(df, keys).where("depth > 0").select(*keys, S, E)


def bucketed(df: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """A row for each time bucket that an interval touches."""
    first, last = F.floor(F.col(S) / bucket_ms), F.floor((F.col(E) - 1) / bucket_ms)
    return df.withColumn("_bucket", F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))))


def at_time(points: DataFrame, spans: DataFrame, keys: list[str], at: str, how: str = "inner", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Points with the spans that hold at their time; span columns other than the keys must have names of their own."""
    left = points.withColumn("_bucket", F.floor(F.col(at) / bucket_ms).cast("long"))
    right = bucketed(spans, bucket_ms).select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in spans.columns], F.col("_bucket").alias("_b"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_bucket") == F.col("_b"), F.col(at) >= F.col(S), F.col(at) < F.col(E)]
    return left.join(right, on, how).drop("_bucket", "_b", *[f"_{k}" for k in keys])


def _last_over() -> Callable:
    """Of lists of starts and ends the pieces (start, end, row): the last row over each instant, cut where the row changes.

    All is nested, so that workers need no import of this module."""

    def one(start: np.ndarray, end: np.ndarray) -> list[dict]:
        """A row covers two blocks of a power of two of elementary pieces, whose halves inherit it."""
        at = np.unique(np.concatenate((start, end)))
        a, b = np.searchsorted(at, start), np.searchsorted(at, end)
        level = np.frexp(b - a)[1] - 1
        best = np.full(len(at) - 1, -1)
        for k in range(int(level.max()), -1, -1):
            rows = np.flatnonzero(level == k)
            np.maximum.at(best, a[rows], rows)
            np.maximum.at(best, b[rows] - (1 << k), rows)
            if k:
                half = 1 << (k - 1)
                below = best.copy()
                below[half:] = np.maximum(best[half:], best[:-half])
                best = below
        begin = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        stop = np.append(begin[1:], len(best))
        some = best[begin] >= 0
        return [{"s": s, "e": e, "row": row} for s, e, row in zip(at[begin[some]].tolist(), at[stop[some]].tolist(), best[begin[some]].tolist(), strict=True)]

    def run(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([one(np.asarray(s), np.asarray(e)) for s, e in zip(starts, ends, strict=True)], dtype=object)

    return run


def overlay(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """Of overlapping intervals the values of the one with the greatest order, at every instant; equal neighbours merge.

    Intervals are cut at the time buckets, and each bucket of a key is worked through by itself: its cost follows its rows, not how many of
    them overlap, as that of a join of pieces with intervals would. A null key has no overlay."""
    rows = bucketed(proper(df).withColumn("_order", order).dropna(subset=keys))
    one = F.struct("_order", F.greatest(F.col(S), F.col("_bucket") * BUCKET_MS).alias("s"), F.least(F.col(E), (F.col("_bucket") + 1) * BUCKET_MS).alias("e"), *values)
    lists = rows.groupBy(*keys, "_bucket").agg(F.sort_array(F.collect_list(one)).alias("_rows"))
    last_over = F.pandas_udf(_last_over(), "array<struct<s:bigint,e:bigint,row:int>>")
    found = lists.withColumn("_won", last_over(F.col("_rows.s"), F.col("_rows.e")))
    named = F.transform("_won", lambda w: F.struct(w["s"].alias(S), w["e"].alias(E), *[F.col("_rows")[w["row"]][v].alias(v) for v in values]))
    return coalesce(found.select(*keys, F.explode(named).alias("_w")).select(*keys, "_w.*"), keys, values)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Every overlapping pair, clipped: both sides' columns (the second's intervals are left out) and the shared [start_ms, end_ms).

    The pair is met in each bucket that both touch and kept in the one where the shared part begins.
    """
    left = bucketed(proper(a), bucket_ms)
    right = bucketed(proper(b), bucket_ms).select(*[F.col(c).alias({S: "_s", E: "_e"}.get(c, f"_{c}" if c in keys else c)) for c in b.columns], F.col("_bucket").alias("_b"))
    pair = left.join(right, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_bucket") == F.col("_b"), F.col(S) < F.col("_e"), F.col("_s") < F.col(E)])
    pair = pair.withColumn("_from", F.greatest(S, "_s")).withColumn("_to", F.least(E, "_e")).where(F.floor(F.col("_from") / bucket_ms) == F.col("_bucket"))
    rest = [c for c in b.columns if c not in (S, E, *keys)]
    return pair.select(*[c for c in a.columns if c not in (S, E)], *rest, F.col("_from").alias(S), F.col("_to").alias(E))


def clip(df: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """The parts inside a window; a value held when the window opens is kept."""
    lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return df.where((F.col(E) > lo) & (F.col(S) < hi)).withColumn(S, F.greatest(F.col(S), lo)).withColumn(E, F.least(F.col(E), hi))


def split(df: DataFrame, width_ms: int, name: str = "slot") -> DataFrame:
    """Rows cut at multiples of a width, with the slot number."""
    first, last = F.floor(F.col(S) / width_ms).cast("long"), F.floor((F.col(E) - 1) / width_ms).cast("long")
    out = proper(df).withColumn(name, F.explode(F.sequence(first, last)))
    return out.withColumn(S, F.greatest(F.col(S), F.col(name) * width_ms)).withColumn(E, F.least(F.col(E), (F.col(name) + 1) * width_ms))


def held(df: DataFrame, keys: list[str], hold_ms: Column | int, values: list[str] | None = None) -> DataFrame:
    """Intervals merged across gaps of at most the hold: a new island begins beyond everything before plus the hold."""
    hold = F.lit(hold_ms) if isinstance(hold_ms, int) else hold_ms
    line = Window.partitionBy(*keys).orderBy(S, E)
    reach = F.max(F.col(E) + hold).over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("_new", F.when(F.col(S) <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(line))
    return runs.groupBy(*keys, "_run").agg(F.min(S).alias(S), F.max(E).alias(E), *[F.first(v).alias(v) for v in values or []]).drop("_run")


def seconds(total: Column | None = None) -> Column:
    """Summed length in seconds; exact, since milliseconds are summed as integers."""
    return F.round((total if total is not None else F.sum(F.col(E) - F.col(S))) / 1000.0, 3)
