"""The commands of the engine: reads return DataFrames, edits make revisions of the label and settings tables, jobs are keyed by their evidence."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import intervals as iv
from tidewell.operators import labels as lb
from tidewell.operators.intervals import E, S
from tidewell.plans.catalog import QUERIES
from tidewell.plans.learning import DOMAIN, learned
from tidewell.plans.references import signatures
from tidewell.plans.signals import GATES, vectors
from tidewell.sources import adapter as ad
from tidewell.sources.adapter import DAY, HOUR
from tidewell.sources.store import Revisions, clear_device

STATES = ("present", "not_present", "unknown")
LABELS = "owner string, ord long, start_ms long, end_ms long, state string, source string, confidence int"
SETTINGS = "name string, value string"
LIVE = "owner string, state string, start_ms long, expires_ms long"
RESULTS = "device long, slot string, thresholds array<int>, cost double"
SIGNATURES = "device long, pattern int, signature string"
#: A wrong guess raises the bar of its label by 0.4, a right one lowers it by 0.05, within bounds by label.
WRONG, RIGHT, BIAS_BOUNDS = 0.4, 0.05, {"present": (-1.0, 4.0), "not_present": (0.0, 0.675)}


def checked_range(start_ms: int, end_ms: int, state: str | None = None) -> None:
    if not (isinstance(start_ms, int) and isinstance(end_ms, int)) or start_ms >= end_ms:
        raise ValueError("a range begins before it ends, in whole milliseconds")
    if state is not None and state not in STATES:
        raise ValueError(f"a state is one of {', '.join(STATES)}")


class Engine:
    """One home: recordings from sf_dir, labels and settings in a folder of revisions."""

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.labels, self.settings = Revisions(spark, f"{folder}/labels", LABELS), Revisions(spark, f"{folder}/settings", SETTINGS)
        self.live, self.results, self.signatures = Revisions(spark, f"{folder}/live", LIVE), Revisions(spark, f"{folder}/results", RESULTS), Revisions(spark, f"{folder}/signatures", SIGNATURES)

    # -------------------------------------------------------------- reads

    def query(self, name: str) -> DataFrame:
        return QUERIES[name](self.spark, self.sf_dir)

    def snapshot(self) -> DataFrame:
        return self.query("snapshot")

    def recording_days(self, device: int, offset: int = 0, limit: int = 100) -> DataFrame:
        return self.query("recording_days").where(F.col("device") == device).orderBy(F.desc("day")).offset(offset).limit(min(limit, 1000))

    def recording_rows(self, device: int, day: int, offset: int = 0, limit: int = 100, end_ms: int | None = None) -> DataFrame:
        """A page of a day's rows; a pinned end keeps pages stable while the day grows."""
        end = min((day + 1) * DAY, end_ms if end_ms is not None else (day + 1) * DAY)
        rows = iv.clip(vectors(self.spark, self.sf_dir).where(F.col("device") == device), day * DAY, end)
        return rows.orderBy(S, E).offset(offset).limit(min(limit, 1000)).select(S, E, *GATES)

    def recording_csv(self, device: int) -> DataFrame:
        return self.query("day_csv").where(F.col("device") == device).orderBy(S).select("line")

    def series(self, devices: list[int], channels: list[int], end_ms: int, hours: float) -> DataFrame:
        """The chart of some channels (room_series, history_series_multi)."""
        start = end_ms - int(hours * HOUR)
        return self.query("chart_buckets").where(F.col("device").isin(devices) & F.col("channel").isin(channels) & (F.col(E) > start) & (F.col(S) < end_ms))

    def export(self, device: int) -> DataFrame:
        return self.query("json_export").where(F.col("device") == device)

    def export_file(self, device: int, path: str) -> None:
        """The whole recording of a device as JSON lines, a folder for each day; nulls are kept, so that reading them back gives the same rows."""
        rows = vectors(self.spark, self.sf_dir).where(F.col("device") == device).withColumn("day", F.floor(F.col(S) / DAY))
        rows.repartition("day").sortWithinPartitions("day", S).write.partitionBy("day").option("ignoreNullFields", "false").json(path)

    def refresh_references(self, device: int) -> DataFrame:
        """The reference periods of a device, from its recording and labels as they are."""
        return self.query("reference_periods").where(F.col("device") == device)

    # -------------------------------------------------------------- jobs

    def learn(self, *devices: int) -> DataFrame:
        """Thresholds for these devices; only their readings are folded and fitted."""
        return learned(self.spark, self.sf_dir, list(devices))

    def members(self, zone: str) -> list[int]:
        """The devices that are learned together with a zone's: those of all zones it shares devices with, directly or not."""
        sets = self.query("learning_sets")
        same = sets.join(sets.where(F.col("zone") == zone).select("learning_set"), "learning_set")
        found = sorted(r["device"] for r in ad.groups(self.spark).join(same, "zone").select("device").distinct().collect())
        if not found:
            raise ValueError(f"no zone {zone}")
        return found

    def learn_set(self, zone: str) -> DataFrame:
        return self.learn(*self.members(zone))

    def start_learning(self, *devices: int, slot: str = "latest") -> int:
        """Learns devices and keeps the results in a slot, with the signatures of the evidence; both by revision, results first, so that a run cut short is learned again."""
        seen, noted = self.results.latest(), self.signatures.latest()
        mine = F.col("device").isin(list(devices))
        found = self.learn(*devices).withColumn("slot", F.lit(slot))
        revision = self.results.commit(self.results.read(seen).where(~(mine & (F.col("slot") == slot))).unionByName(found), seen)
        self.signatures.commit(self.signatures.read(noted).where(~mine).unionByName(signatures(self.spark, self.sf_dir).where(mine)), noted)
        return revision

    def overnight(self) -> DataFrame:
        """(device, pattern, signature) whose evidence is not that of the last learning."""
        return signatures(self.spark, self.sf_dir).join(self.signatures.read(), ["device", "pattern", "signature"], "left_anti")

    # -------------------------------------------------------------- thresholds

    def thresholds(self, device: int) -> list[int]:
        return self.setting(f"thresholds/{device}", list(ad.PATTERNS[0][1]))

    def set_gate_threshold(self, device: int, channel: int, value: float, revision: int | None = None) -> int:
        """Sets one threshold to the nearest legal value, the lower of two as near."""
        if not 0 <= channel < len(GATES):
            raise ValueError("no such gate")
        if not (isinstance(value, (int, float)) and DOMAIN[0] <= value <= DOMAIN[-1]):
            raise ValueError(f"a threshold is from {DOMAIN[0]} to {DOMAIN[-1]}")
        now = self.thresholds(device)
        now[channel] = min(DOMAIN, key=lambda t: (abs(t - value), t))
        return self.configure(f"thresholds/{device}", now, revision)

    def apply(self, *devices: int, slot: str = "latest", revision: int | None = None) -> list[tuple[int, int, int, int]]:
        """Sets what a slot holds for all these devices, in one revision, and returns the writes (device, channel, old, new): lower before raising, then by channel."""
        found = {r["device"]: list(r["thresholds"]) for r in self.results.read().where(F.col("device").isin(list(devices)) & (F.col("slot") == slot)).collect()}
        if missing := sorted(set(devices) - set(found)):
            raise ValueError(f"slot {slot} has no result for {missing}")
        seen = self.settings.latest() if revision is None else revision
        writes = [(d, c, old, new) for d in sorted(found) for c, (old, new) in enumerate(zip(self.thresholds(d), found[d], strict=True)) if old != new]
        self._set({f"thresholds/{d}": t for d, t in found.items()}, seen)
        return sorted(writes, key=lambda w: (w[0], w[3] > w[2], w[1]))

    def apply_set(self, zone: str, slot: str = "latest", revision: int | None = None) -> list[tuple[int, int, int, int]]:
        return self.apply(*self.members(zone), slot=slot, revision=revision)

    def assess_room(self, zone: str) -> DataFrame:
        return self.query("role_tallies").where(F.col("zone") == zone)

    def compare_results(self, device: int) -> DataFrame:
        return self.query("pattern_cost").where(F.col("device") == device)

    def timeout_suggestion(self, device: int) -> DataFrame:
        return self.query("timeout_suggestion").where(F.col("device") == device)

    # -------------------------------------------------------------- edits

    def _labelled(self, owners: list[str], start_ms: int, end_ms: int, state: str | None, revision: int | None, clear: tuple[int, int] | None = None, source: str = "manual") -> int:
        seen = self.labels.latest() if revision is None else revision
        rows = self.labels.read(seen)
        frame = lambda a, b: self.spark.createDataFrame([(o, a, b) for o in owners], "owner string, a long, b long")
        if clear:
            rows = lb.remove_ranges(rows, frame(*clear), ["owner"])
        if state is None:
            rows = lb.remove_ranges(rows, frame(start_ms, end_ms), ["owner"])
        else:
            rows = lb.apply_range(rows, frame(start_ms, end_ms), ["owner"], ord=F.lit(seen + 1).cast("long"), state=F.lit(state), source=F.lit(source), confidence=F.lit(100))
        return self.labels.commit(rows, seen)

    def label_range(self, owner: str, start_ms: int, end_ms: int, state: str | None, revision: int | None = None) -> int:
        """Sets a range of a device or room, or with None takes its labels away (label_history, label_room_range)."""
        checked_range(start_ms, end_ms, state)
        return self._labelled([owner], start_ms, end_ms, state, revision)

    def label_several(self, owners: list[str], start_ms: int, end_ms: int, state: str, revision: int | None = None) -> int:
        """One range for several owners, in one revision: all or nothing."""
        checked_range(start_ms, end_ms, state)
        return self._labelled(sorted(set(owners)), start_ms, end_ms, state, revision)

    def edit_label(self, owner: str, old: tuple[int, int], start_ms: int, end_ms: int, state: str, revision: int) -> int:
        """Moves a label: its old bounds are cleared, then the new ones set (edit_history_label, edit_room_label)."""
        checked_range(*old)
        checked_range(start_ms, end_ms, state)
        return self._labelled([owner], start_ms, end_ms, state, revision, clear=old)

    def configure(self, name: str, value: Any, revision: int | None = None) -> int:
        """Sets one of the settings, or with None removes it (all configure_ and set_ commands, templates, priorities, schedules)."""
        return self._set({name: value}, self.settings.latest() if revision is None else revision)

    def _set(self, values: dict[str, Any], seen: int) -> int:
        """All these settings in one revision."""
        rows = self.settings.read(seen).where(~F.col("name").isin(list(values)))
        new = [(k, json.dumps(v, sort_keys=True)) for k, v in values.items() if v is not None]
        return self.settings.commit(rows.unionByName(self.spark.createDataFrame(new, SETTINGS)), seen)

    def setting(self, name: str, default: Any = None) -> Any:
        found = self.settings.read().where(F.col("name") == name).first()
        return json.loads(found["value"]) if found else default

    # -------------------------------------------------------------- live labels and feedback

    def set_training_state(self, owner: str, state: str, now_ms: int, timeout_ms: int | None = None) -> int:
        """What an owner is from now on, until it is set again or the time is out; what was set before becomes a label up to now or its own end.

        The label is written first: if the second write is lost, doing it again sets the same range again.
        """
        if state not in STATES:
            raise ValueError(f"a state is one of {', '.join(STATES)}")
        seen = self.live.latest()
        rows = self.live.read(seen)
        open_ = rows.where(F.col("owner") == owner).first()
        if open_ is not None:
            end = min(now_ms, open_["expires_ms"] if open_["expires_ms"] is not None else now_ms)
            if end > open_["start_ms"]:
                self._labelled([owner], open_["start_ms"], end, open_["state"], None, source="live")
        new = [(owner, state, now_ms, None if timeout_ms is None else now_ms + timeout_ms)] if state != "unknown" else []
        return self.live.commit(rows.where(F.col("owner") != owner).unionByName(self.spark.createDataFrame(new, LIVE)), seen)

    def auto_feedback(self, device: int, label: str, correct: bool, revision: int | None = None) -> float:
        """The bias of a device's label after one more answer: quick to distrust, slow to forgive."""
        if label not in BIAS_BOUNDS:
            raise ValueError("an answer is about present or not_present")
        seen, name = self.settings.latest() if revision is None else revision, f"bias/{device}/{label}"
        low, high = BIAS_BOUNDS[label]
        bias = round(max(low, min(high, self.setting(name, 0.0) + (-RIGHT if correct else WRONG))), 6)
        self._set({name: bias}, seen)
        return bias

    def room_estimate_feedback(self, zone: str, correct: bool) -> int:
        """Labels the stretch a room's estimate is in, an hour of it at most: with its state, or with the other one."""
        found = self.query("current_stretch").where((F.col("zone") == zone) & F.col("state").isin("present", "not_present")).first()
        if found is None:
            raise ValueError("there is no estimate to answer")
        other = "not_present" if found["state"] == "present" else "present"
        return self.label_range(zone, max(found[S], found[E] - HOUR), found[E], found["state"] if correct else other)

    def clear(self, device: int, days: str | None = None) -> None:
        """Takes all that was gathered for a device away: live state, labels, results, signatures, and its days where a store of them is named."""
        owner, mine = F.col("owner") == str(device), F.col("device") == device
        for table, rows in ((self.live, owner), (self.labels, owner), (self.results, mine), (self.signatures, mine)):
            seen = table.latest()
            if seen:
                table.commit(table.read(seen).where(~rows), seen)
        if days is not None:
            clear_device(self.spark, days, device)
