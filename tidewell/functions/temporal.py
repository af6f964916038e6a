"""The two-state temporal filter and its confirmation, as plain functions of a state and a reading.

A unit is six seconds at the time scale of recordings. The prior drifts to the resting level in every unit, and evidence counts by the time it stands for, unit by
unit; a part of a unit counts as such a part. Without evidence, and without support a short while ago, the state is open and the probability returns to
one half. A label is confirmed once it has held for its time; until then, and whenever it is open, the confirmed state is unknown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from tidewell.sources.adapter import HOUR, MINUTE


@dataclass(frozen=True)
class Filter:
    """Tunables, at the time scale of the data."""

    reset_ms: int = HOUR
    unit_ms: int = 10 * MINUTE
    decay: float = 0.95
    rest: float = 0.8
    forget: float = 0.9
    least: float = 0.05
    present_at: float = 0.75
    empty_at: float = 0.25
    supported_ms: int = 20 * MINUTE
    confirm_present_ms: int = 5 * MINUTE
    confirm_empty_ms: int = 10 * MINUTE


@dataclass
class State:
    ts_ms: int = -1
    probability: float = 0.5
    pending: str = "unknown"
    since_ms: int = -1
    confirmed: str = "unknown"
    held: str = "unknown"
    supported_ms: int = -(1 << 40)


def elevation(energy: float, tail: float, spread: float) -> float:
    """How far a reading is above a quiet level's tail, in spreads, as evidence from -0.6 to 3.5."""
    return max(-0.6, min(3.5, (max(0.0, (energy - tail) / max(2, spread)) - 1) * 1.2))


def evidence(energy: float | None) -> float:
    """Of a reading over a quiet level of 20 and a spread of 10; a missing one says nothing."""
    return 0.0 if energy is None or energy != energy else elevation(energy, 20, 10)


def advanced(probability: float, found: float, units: float, how: Filter = Filter()) -> float:
    """The probability after so many units of one evidence."""
    while units > 1e-9:
        part = min(1.0, units)
        prior = how.rest + (probability - how.rest) * how.decay**part
        odds = math.log(prior / (1 - prior)) + found * part
        probability = 1 / (1 + math.exp(-max(-20.0, min(20.0, odds))))
        units -= part
    return probability


def step(state: State, ts_ms: int, energy: float | None, how: Filter = Filter()) -> State:
    """The state after a reading; one that comes late counts as of the last time."""
    ts_ms = max(ts_ms, state.ts_ms)
    first = state.ts_ms < 0 or ts_ms - state.ts_ms > how.reset_ms
    before, units = (0.5, 1.0) if first else (state.probability, (ts_ms - state.ts_ms) / how.unit_ms)
    found = evidence(energy)
    probability = advanced(before, found, units, how)
    supported = ts_ms if found > how.least else state.supported_ms
    held_over = before >= how.present_at and ts_ms - supported <= how.supported_ms
    known = energy is not None and energy == energy
    if not known or abs(found) < how.least and not held_over:
        label, probability = "unknown", 0.5 + (before - 0.5) * how.forget**units
    else:
        label = "present" if probability >= how.present_at else "not_present" if probability <= how.empty_at else "unknown"
    return _confirmed(State(ts_ms, max(0.01, min(0.99, probability)), supported_ms=supported), State() if first else state, label, found, how)


def _confirmed(now: State, state: State, label: str, found: float, how: Filter) -> State:
    """The confirmation of a label at now, after state."""
    doubtful = label == "present" and state.held != "present" and found <= 0  # presence begins with evidence
    now.pending = "unknown" if doubtful else label
    now.since_ms = state.since_ms if now.pending == state.pending and state.since_ms >= 0 and now.pending != "unknown" else now.ts_ms
    now.held = "unknown" if label == "unknown" else state.held
    wait = how.confirm_present_ms if label == "present" else how.confirm_empty_ms
    if now.pending != "unknown" and now.ts_ms - now.since_ms >= wait:
        now.held = now.confirmed = now.pending
    return now
