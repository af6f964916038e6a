"""Operators against sequential referees and laws; streams against loops; the engine without its optional parts."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions.temporal import Filter, State, advanced, step
from tidewell.operators import detector as dt
from tidewell.operators import histograms as hg
from tidewell.operators import intervals as iv
from tidewell.operators import labels as lb
from tidewell.operators import spans as sp
from tidewell.plans import catalog, policies
from tidewell.plans.learning import GATES, _fitted
from tidewell.sources import adapter as ad
from tidewell.streaming import live

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def intervals(rng, n, top=100):
    return [(rng.randrange(2), a, a + rng.randrange(0, 15)) for a in (rng.randrange(top) for _ in range(n))]


def frame(spark, rows):
    return spark.createDataFrame(rows or [(0, 0, 0)], "k long, start_ms long, end_ms long")


def points(rows):
    return {(k, t) for k, a, b in rows for t in range(a, b)}


def collected(df):
    return [tuple(r) for r in df.select("k", "start_ms", "end_ms").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_interval_algebra_is_set_algebra(spark, seed):
    rng = random.Random(seed)
    a, b = intervals(rng, 25), intervals(rng, 25)
    x, y, keys = frame(spark, a), frame(spark, b), ["k"]
    for got, want in ((iv.union(x, keys), points(a)), (iv.intersect(x, y, keys), points(a) & points(b)), (iv.subtract(x, y, keys), points(a) - points(b))):
        rows = collected(got)
        assert points(rows) == want
        assert sum(e - s for _, s, e in rows) == len(want)
        assert not {(k, e) for k, _, e in rows} & {(k, s) for k, s, _ in rows}  # maximal
    pairs = iv.overlap_join(x.withColumn("i", F.monotonically_increasing_id()), y.withColumn("j", F.monotonically_increasing_id()), keys, bucket_ms=7)
    want = sum(len(points([p]) & points([q])) for p in a for q in b)
    assert sum(e - s for _, s, e in collected(pairs)) == want
    split = collected(iv.split(x, 10))
    assert points(split) == points(a) and all(s // 10 == (e - 1) // 10 for _, s, e in split)
    clipped = collected(iv.clip(x, 20, 50))
    assert points(clipped) == {(k, t) for k, t in points(a) if 20 <= t < 50}


def test_overlay_takes_the_last_label(spark):
    rng = random.Random(9)
    rows = [(k, a, b, i, rng.choice("pqu")) for i, (k, a, b) in enumerate(intervals(rng, 30))]
    got = iv.overlay(spark.createDataFrame(rows, "k long, start_ms long, end_ms long, ord long, state string"), ["k"], F.col("ord"), ["state"])
    want = {}
    for k, a, b, _, state in rows:
        for t in range(a, b):
            want[k, t] = state
    assert {(r["k"], t): r["state"] for r in got.collect() for t in range(r["start_ms"], r["end_ms"])} == want


def test_overlay_meets_no_pairs(spark):
    """Intervals over several time buckets that nearly all overlap: the greatest order wins, and no join makes a row for each piece and interval."""
    rng, hour = random.Random(4), 3_600_000
    rows = [(k, a, a + rng.randrange(1, 15 * hour), rng.randrange(2), i, f"v{rng.randrange(3)}") for k in ("x", "y") for i in range(60) for a in [rng.randrange(0, 15 * hour)]]
    df = spark.createDataFrame([*rows, (None, 0, hour, 1, 99, "v0"), ("x", 5, 5, 1, 99, "v9")], "k string, start_ms long, end_ms long, prio int, ord long, state string")
    got = iv.overlay(df, ["k"], F.struct("prio", "ord"), ["state", "prio"])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for k in ("x", "y"):
        at = sorted({t for r in rows if r[0] == k for t in r[1:3]})
        for s, e in zip(at, at[1:]):
            best = max(((r[3:5], r[5]) for r in rows if r[0] == k and r[1] <= s < r[2]), default=None)
            if best and want and want[-1][0] == k and want[-1][2] == s and want[-1][3:] == (best[1], best[0][0]):
                want[-1] = (*want[-1][:2], e, *want[-1][3:])
            elif best:
                want.append((k, s, e, best[1], best[0][0]))
    assert sorted((r["k"], r["start_ms"], r["end_ms"], r["state"], r["prio"]) for r in got.collect()) == want


def test_apply_range_keeps_outer_parts(spark):
    labels = spark.createDataFrame([(1, 0, 10, "a"), (1, 20, 30, "b"), (2, 0, 10, "a")], "device long, start_ms long, end_ms long, state string")
    ranges = spark.createDataFrame([(1, 5, 25)], "device long, a long, b long")
    got = {tuple(r) for r in lb.apply_range(labels, ranges, ["device"], state=F.lit("n")).collect()}
    assert got == {(1, 0, 5, "a"), (1, 25, 30, "b"), (1, 5, 25, "n"), (2, 0, 10, "a")}


def delayed(held, on, off, end):
    """The delays one interval after another: a chain goes on while the next begins by the off delay; it counts from its first long interval on."""
    out, k = [], 0
    while k < len(held):
        chain = [held[k]]
        while k + 1 < len(held) and held[k + 1][0] <= chain[-1][1] + off:
            k += 1
            chain.append(held[k])
        first = next((s for s, e in chain if e - s >= on), None)
        if first is not None and min(end, chain[-1][1] + off) > first + on:
            out.append((first + on, min(end, chain[-1][1] + off)))
        k += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_detector_against_a_sequential_referee(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for _ in range(200):
        if rng.random() < 0.05:
            t += rng.randrange(1, 30)
        n = rng.randrange(1, 8)
        rows.append((1, t, t + n, None if rng.random() < 0.03 else rng.randrange(100), rng.choice([0, 90])))
        t += n
    hold, on, off = 4, 6, 5
    df = spark.createDataFrame(rows, "device long, start_ms long, end_ms long, g0 int, g1 int")
    patterns = spark.createDataFrame([(0, [60, 100]), (1, [100, 80])], "pattern int, thresholds array<int>")
    got = {}
    for r in dt.activations(df, patterns, ["g0", "g1"], hold, on, off).collect():
        got.setdefault(r["pattern"], []).append((r["start_ms"], r["end_ms"]))
    for pattern, (gate, limit) in enumerate(((3, 60), (4, 80))):
        want, segment = [], []
        for row in [*rows, None]:
            if row and row[3] is not None and (not segment or segment[-1][2] == row[1]):
                segment.append(row)
                continue
            if segment:
                end, held = segment[-1][2], []
                for _, s, e, *_ in (x for x in segment if x[gate] > limit):
                    if held and s <= held[-1][1]:
                        held[-1][1] = min(end, e + hold)
                    else:
                        held.append([s, min(end, e + hold)])
                want += delayed(held, on, off, end)
            segment = [row] if row and row[3] is not None else []
        assert sorted(got.get(pattern, [])) == want


def test_missing_is_neither_hit_nor_usable(spark):
    df = spark.createDataFrame([(None, 90), (50, 10), (40, 40)], "g0 int, g1 int")
    got = df.select(sp.any_above(["g0", "g1"], [F.lit(40)] * 2).alias("hit"), sp.all_known(["g0", "g1"]).alias("all"), sp.any_known(["g0", "g1"]).alias("any"), sp.any_above(["g0", "g1"], [F.lit(100)] * 2).alias("off")).collect()
    assert [tuple(r) for r in got] == [(True, False, True, False), (True, True, True, False), (False, True, True, False)]


def test_quantile_rules_differ_as_stated(spark):
    bins = spark.createDataFrame([(1, 0, 3), (1, 10, 3), (1, 20, 4)], "k long, energy int, ms long")
    got = {rule: hg.quantile(bins, ["k"], rule, 0.6).first()["value"] for rule in hg.RULES}
    assert got == {"q1": 10, "q2": 10, "q3": 10, "q4": 13, "q5": 23, "q6": 10, "q7": 20}
    assert hg.quantile(bins, ["k"], "q2", 0.3).first()["value"] == 0 and hg.quantile(bins, ["k"], "q5", 0.3).first()["value"] == 13


def test_streamed_presence_is_the_loop(spark):
    got = {(r["device"], r["seq"]): (r["ts_ms"], r["probability"], r["state"], r["confirmed"]) for r in live.collected(live.presence(live.readings(spark, SF)), "test").collect()}
    states, want = {}, {}
    for r in sorted(ad.readings(spark, SF).collect(), key=lambda r: (r["ts_ms"], r["seq"])):
        s = states[r["device"]] = step(states.get(r["device"], State()), r["ts_ms"], r["energy"])
        want[r["device"], r["seq"]] = (s.ts_ms, round(s.probability, 6), s.pending, s.confirmed)
    assert got == want and {w[3] for w in want.values()} > {"unknown"}


def test_filter_resets_and_confirms():
    s = step(State(), 0, 90)
    for k in range(1, 6):
        s = step(s, k * 300_000, 90)
    assert s.confirmed == "present" and s.probability > 0.9
    assert step(s, s.ts_ms + 10 * 3_600_000, None).probability == pytest.approx(0.5)
    assert step(s, 0, None).ts_ms == s.ts_ms


def test_filter_rules_by_hand():
    """Worked by hand: the prior drifts to 0.8 in units, evidence counts by time, silence leads back to one half, confirmation ends with the label."""
    assert advanced(0.5, 0.0, 1) == pytest.approx(0.515) and advanced(0.9, 0.0, 1) == pytest.approx(0.895)
    assert advanced(0.5, 0.0, 2.5) == pytest.approx(0.8 - 0.3 * 0.95**2.5)
    odds = 0.515 / 0.485 * 2.718281828459045
    assert advanced(0.5, 1.0, 1) == pytest.approx(odds / (1 + odds)) and advanced(0.5, 1.0, 0) == 0.5
    quiet = step(State(), 0, 20)  # elevation -0.6 for a unit: below one half, but not empty yet
    assert quiet.probability == pytest.approx(1 / (1 + 0.485 / 0.515 * 2.718281828459045**0.6)) and quiet.pending == "unknown"
    unit, now = Filter().unit_ms, quiet
    for k in range(1, 12):
        now = step(now, k * unit, 20)
    assert now.pending == now.confirmed == "not_present"
    silent = step(now, 12 * unit, None)  # no reading, no answer; the probability is on its way back
    assert silent.confirmed == silent.held == "unknown" and silent.probability == pytest.approx(0.5 + (now.probability - 0.5) * 0.9)
    loud = step(silent, 13 * unit, 90)
    assert (loud.pending, loud.confirmed) == ("present", "unknown") and step(loud, 14 * unit, 90).confirmed == "present"
    again = step(State(), 13 * unit, 90)
    assert step(again, 13 * unit + Filter().confirm_present_ms - 1, 90).confirmed == "unknown"


@pytest.mark.parametrize("name", ["labels_last_wins", "labelled_histogram", "guess_at", "room_truth", "pattern_cost", "grid_cells"])
def test_no_nested_loops(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    small = plan.count("BroadcastNestedLoopJoin")  # only the few patterns are crossed
    assert small == 0 or name == "pattern_cost"


def test_scan_reads_only_what_it_needs(spark):
    plan = catalog.QUERIES["hold_spans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_fit_has_gap_centre_seed_and_repair():
    """The gate that tells is put in the middle of its gap; gates that a move crosses nothing of keep the pattern in use."""
    quiet = [(0, "not_present", 10, 2, None, None, None, 60), (0, "not_present", 4, 3, None, None, None, 40)]
    rows = pd.DataFrame([*quiet, (0, "present", 90, 2, None, None, None, 50), (0, "present", 80, 3, None, None, None, 50)], columns=["device", "state", *GATES, "n"])
    got = _fitted(rows)
    assert got["thresholds"][0] == [45, 40, 40, 40, 40] and got["cost"][0] == 0
    one = _fitted(rows[rows["state"] == "present"].reset_index(drop=True))
    assert one["cost"][0] == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_engine_stands_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert said.stdout.split()[-2] == str(len(catalog.QUERIES))


@pytest.mark.parametrize("seed", range(4))
def test_presence_walk_against_plain_loops(seed):
    rng = random.Random(seed)
    m = rng.choice([0.5, 1.0, 2.0])
    vectors = [(rng.choice(["present", "not_present"]), [None if rng.random() < 0.1 else rng.randrange(101) for _ in range(5)], rng.randrange(1, 9)) for _ in range(40)]
    frame = pd.DataFrame([{"device": 1, "state": s, "n": n, "m": m, **{f"g{c}": v for c, v in enumerate(x)}} for s, x, n in vectors])
    got = policies._walk(frame).iloc[0]

    def price(t):
        sums = {"present": 0, "not_present": 0}
        for state, x, n in vectors:
            hit = any(v is not None and v > limit and limit < 100 for v, limit in zip(x, t, strict=True))
            sums[state] += n if hit != (state == "present") else 0
        return 50 * m * sums["present"] + sums["not_present"]

    legal = range(0, 101, 5)
    now, rounds, shifts = [40] * 5, 0, [1, 2, 3, 4, 6, 8, 12]
    while rounds < 12:
        tried = [now] + [[max([v for v in legal if v < t and v <= t - k], default=0) for t in now] for k in shifts]
        for c in range(5):
            tried.append([max([v for v in legal if v < t], default=t) if i == c else t for i, t in enumerate(now)])
        prices = [price(t) for t in tried]
        best = tried[prices.index(min(prices))]
        if best == now:
            break
        now, rounds, shifts = best, rounds + 1, []
    assert (list(got["thresholds"]), got["rounds"], got["price"]) == (now, rounds, price(now))
    assert got["shift"] == 40 - min(now)
