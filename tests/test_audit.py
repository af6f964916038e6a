"""The audit of labels against plain loops, its decisions on devices made for them, and its replay against the detector's plan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import detector as dt
from tidewell.plans import audit as au
from tidewell.plans import catalog
from tidewell.plans.learning import GATES, cells
from tidewell.plans.signals import vectors
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import SCALE

SF, C = "/root/testdata/sf0.01", SCALE.cell


@pytest.fixture(scope="module")
def device(spark):
    """The vectors of one device as arrays, a missing energy as -1."""
    rows = vectors(spark, SF).where("device = 3").select("start_ms", "end_ms", *[F.coalesce(g, F.lit(-1)).alias(g) for g in GATES]).orderBy("start_ms").toPandas()
    return rows["start_ms"].to_numpy(), rows["end_ms"].to_numpy(), rows[GATES].to_numpy(np.int8)


def test_cells_are_those_of_the_plan(spark, device):
    cell, top, whole = au.grid(*device)
    got = {(int(c), *map(int, v), bool(w)) for c, v, w in zip(cell, top, whole, strict=True)}
    want = cells(spark, SF).where("device = 3").select("cell", *[F.coalesce(g, F.lit(-1)) for g in GATES], F.col("coverage") == 2).collect()
    assert got == {tuple(r) for r in want} and len(got) == len(want) > 100


def test_replay_is_the_detector(spark, device):
    rows = dt.activations(vectors(spark, SF).where("device = 3"), ad.patterns(spark), GATES, SCALE.timeout, SCALE.on_delay, SCALE.off_delay).select("pattern", "start_ms", "end_ms").collect()
    replay, found = au.Replay(*device), 0
    for k, thresholds in ad.PATTERNS:
        got = list(zip(*map(np.ndarray.tolist, replay.active(tuple(thresholds))), strict=True))
        assert got == sorted((r.start_ms, r.end_ms) for r in rows if r.pattern == k)
        found += len(got)
    assert found > 100
    assert not len(replay.active((100,) * len(GATES))[0])


def made(segments, loud=(40, 70), seed=1):
    """Whole cells of a device, one vector each: gate 1 is loud where somebody moves, all else is 0 to 9. (vectors, bounds of the segments)"""
    rng, rows, bounds = random.Random(seed), [], []
    for n, busy in segments:
        bounds.append((len(rows) * C, (len(rows) + n) * C))
        rows += [[rng.randint(*loud) if busy and c == 1 else rng.randint(0, 9) for c in range(len(GATES))] for _ in range(n)]
    at = np.arange(len(rows)) * C
    return (at, at + C, np.array(rows, np.int8)), bounds


def labels(*rows):
    lo, hi, present, manual = map(np.array, zip(*rows, strict=True))
    return au.Labels(lo, hi, present, manual, np.arange(len(rows)), np.where(manual, 1.0, 0.5))


def test_a_quiet_stretch_of_presence_is_a_suspect_and_only_that():
    rows, b = made([(400, 0), (400, 1), (100, 0), (400, 1), (400, 0)])
    found = au.audited(*rows, labels((*b[0], False, True), (b[1][0], b[3][1], True, True), (*b[4], False, True)), 1.0)
    assert [(r["start_ms"], r["end_ms"], r["present"], r["windows"], r["flagged_windows"], r["suspects"]) for r in found] == [(*b[2], True, 10, 10, 1)]
    clean = labels((*b[0], False, True), (*b[1], True, True), (*b[2], False, True), (*b[3], True, True), (*b[4], False, True))
    assert au.audited(*rows, clean, 1.0) == []


def test_suspects_go_only_for_a_gain_beyond_the_margin():
    """People too quiet for the pattern in use, and a sensor that says Empty while they are there: no pattern that sees them may be chosen before that goes."""
    rows, b = made([(500, 0), (300, 1), (500, 0), (60, 1), (300, 1), (500, 0)], (31, 39))
    truth = [(*b[0], False, True), (*b[1], True, True), (*b[2], False, True), (*b[3], False, False), (*b[4], True, True), (*b[5], False, True)]
    [row] = au.audited(*rows, labels(*truth), 1.0)
    assert (row["start_ms"], row["end_ms"], row["present"], row["manual"], row["decision"]) == (*b[3], False, False, "discarded")
    assert row["gain"] == pytest.approx(1000, abs=60) and row["margin"] == pytest.approx(0.5 + 20 / 5)
    # loud people are seen by the pattern in use, so nothing is gained
    rows, b = made([(400, 0), (300, 1), (400, 0), (300, 1), (400, 0)])
    short = labels((*b[0], False, True), (b[1][0], b[1][1] + 20 * C, True, True), (b[2][0] + 20 * C, b[2][1], False, True), (*b[3], True, True), (*b[4], False, True))
    [row] = au.audited(*rows, short, 1.0)
    assert row["decision"] == "kept: no influence" and row["gain"] <= row["margin"] == pytest.approx(0.5 + 20 / 5)


def plain_flags(x, present, manual, first, stop):
    """The same windows by counting cell by cell."""

    def order(values, q):
        values = sorted(values)
        return next(v for i, v in enumerate(values) if i + 1 >= q * len(values))

    x, flagged = x.astype(int), set()
    windows = list(zip(first, stop, strict=True))
    for _ in range(3):
        kept = [i for w, (a, b) in enumerate(windows) if w not in flagged for i in range(a, b)]
        ref = []
        for c in range(x.shape[1]):
            p, q = ([x[i, c] for i in kept if present[i] == s and x[i, c] >= 0] or [x[i, c] for i in range(len(x)) if present[i] == s and x[i, c] >= 0] for s in (True, False))
            if p and q:
                e25, e75 = order(q, 0.25), order(q, 0.75)
                ref.append((c, min(order(q, 0.9), e75 + 2 * (e75 - e25) + 1), min(order(q, 0.99), e75 + 4 * (e75 - e25) + 2), p))
        new = set()
        for w, (a, b) in enumerate(windows):
            over = lambda c, v: sum(x[i, c] > v for i in range(a, b))  # noqa: B023, E731
            if present[a]:
                odd = all(over(c, bound) <= 0.5 * (b - a) for c, bound, _, _ in ref)
            else:
                odd = any(order(p, 0.5) > high and over(c, max(high, order(p, 0.25 if manual[a] else 0.1))) >= 0.75 * (b - a) for c, _, high, p in ref)
            if odd:
                new.add(w)
        if new == flagged:
            break
        flagged = new
    return flagged


@pytest.mark.parametrize("seed", range(6))
def test_flags_are_those_of_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    label = np.repeat(np.arange(12), rng.integers(3, 60, 12))
    cell = np.cumsum(rng.choice([1, 2], len(label), p=[0.97, 0.03]))
    present, manual = (label % 2 == 0), (label % 3 != 0)
    wrong = rng.random(len(label) // 5 + 1).repeat(5)[: len(label)] < 0.25
    x = np.where((present ^ wrong)[:, None], rng.integers(20, 80, (len(label), 3)), rng.integers(-1, 25, (len(label), 3))).astype(np.int8)
    first, stop = au.windows_of(cell, label)
    assert set(np.flatnonzero(au.flagged(x, present, manual, first, stop)).tolist()) == plain_flags(x, present, manual, first.tolist(), stop.tolist())
    for a, b in zip(first, stop, strict=True):
        assert len(set(label[a:b])) == 1 and (np.diff(cell[a:b]) == 1).all() and b - a < 15
    assert first[0] == 0 and (first[1:] == stop[:-1]).all() and stop[-1] == len(cell)


def test_windows_of_ten_and_short_tails():
    cell = np.array([*range(24), *range(30, 45), *range(50, 53)])
    assert [int(n) for n in np.subtract(*reversed(au.windows_of(cell, np.zeros(len(cell), int))))] == [10, 14, 10, 5, 3]


def test_stretches_merge_while_the_flagged_share_holds():
    sizes = lambda text: [b - a + 1 for a, b, _ in au.groups([ch == "F" for ch in text])]
    assert sizes("FFFFF..FFFFFF.FFFF.F") == [20]
    assert sizes("FFFF........FFFF") == [4, 4]
    assert sizes("..FF.." + "F" * 25) == [31]
    assert sizes("....FF" + "F" * 25) == [27]
    assert sizes("....") == []


def test_caps_keep_every_class():
    def suspects(n, manual):
        return [{"present": True, "manual": manual, "start_ms": i * 100, "end_ms": i * 100 + 100} for i in range(n)]

    accepted, capped = au.limit(suspects(9, True), {True: 1000, False: 1000}, {True: 1000, False: 1000})
    assert (len(accepted), len(capped)) == (2, 7)
    accepted, capped = au.limit(suspects(9, False), {True: 1000, False: 1000}, {True: 0, False: 0})
    assert (len(accepted), len(capped)) == (8, 1)


@pytest.mark.parametrize("seed", range(4))
def test_score_is_a_count_of_instants(seed):
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(400), 40))
    rows = [(a, b, rng.random() < 0.5, rng.random() < 0.5) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    whole = labels(*rows)
    whole.weight[:] = np.where(whole.manual, 1.0, 0.7)
    on = sorted(rng.sample(range(400), 30))
    lo, hi = np.array(on[::2]), np.array(on[1::2])
    mask = sorted(rng.sample(range(400), 6))
    masks, m = list(zip(mask[::2], mask[1::2], strict=True)), 2.0
    active, dark = ({t for a, b in spans for t in range(a, b)} for spans in (zip(lo.tolist(), hi.tolist(), strict=True), masks))
    sums = {(s, src): [0.0] * 4 for s in (True, False) for src in (True, False)}
    for a, b, present, manual in rows:
        seen = set(range(a, b)) - dark
        if not seen:
            continue
        w, hit = 1.0 if manual else 0.7, len(seen & active)
        error = len(seen) - hit if present else hit
        bad = 2 * hit < len(seen) if present else bool({int(t) for t in lo} & seen) or 2 * hit > len(seen)
        for k, v in enumerate((len(seen) * w, error * w, w, w * bad)):
            sums[present, manual][k] += v
    cost = 0.0
    for s, factor in ((True, 5 * m), (False, 1.0)):
        human, auto = sums[s, True], sums[s, False]
        for k in (0, 2):
            rate = lambda v: v[k + 1] / v[k] if v[k] else 0.0  # noqa: B023, E731
            cost += 100 * factor * (rate(human) + 0.125 * min(1.0, auto[k] / human[k]) * rate(auto) if human[0] else rate(auto))
    assert au.score(whole.without(masks), lo, hi, m).cost == pytest.approx(cost)


def test_query_decides(spark):
    rows = catalog.QUERIES["anomaly_audit"](spark, SF).collect()
    for device in {r.device for r in rows}:
        mine = [r for r in rows if r.device == device]
        assert {r.suspects for r in mine} == {len(mine)}
        for r in mine:
            assert (r.decision == "discarded") == (r.gain > r.margin) or r.decision == "kept: cap"
    assert {r.decision for r in rows} >= {"discarded", "kept: no influence"}
