"""Queries over the overlay on events whose labels overlap many times over: rows as in SQL, and no join that grows with how many overlap."""

import duckdb
import pytest
from test_queries import connected, plain

from tidewell.plans import catalog

SF, COPIES = "/root/testdata/sf0.01", 6
NAMES = [
    "room_levels", "union_rule_target", "anomaly_audit", "anomaly_windows", "apply_decision", "best_slots", "candidate_thresholds", "channel_evidence",
    "class_statistics", "confusion", "confusion_metrics", "chronological_split", "core_cost", "crossing_costs", "display_score", "episode_outcomes",
    "episode_support", "exclusive_presence", "gate_preference", "gate_regime", "guess_trials", "guesses_checked", "human_truth",
]


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """Copies of the events, seven seconds apart, so that hardly two instants are the same."""
    sf = tmp_path_factory.mktemp("dense")
    with duckdb.connect() as c:
        at = f"'{SF}/events.parquet'"
        n = c.execute(f"SELECT max(event_id) + 1 FROM {at}").fetchone()[0]
        c.execute(f"COPY (SELECT event_id + {n} * k AS event_id, ts + to_microseconds(k * 7123457) AS ts, user_id + 240 * k AS user_id, event_type, value, props FROM {at}, range({COPIES}) t(k)) TO '{sf}/events.parquet'")
        return str(sf), c.execute(f"SELECT count(*) FROM '{sf}/events.parquet'").fetchone()[0]


def joined_rows(node):
    """Rows out of each join of a plan that has run."""
    out, kind = [], node.nodeName()
    if "Join" in kind:
        out.append(node.metrics().apply("numOutputRows").value())
    if kind == "AdaptiveSparkPlan":
        return joined_rows(node.executedPlan())
    if kind.endswith("QueryStage"):
        return joined_rows(node.plan())
    children = node.children()
    return out + [n for i in range(children.size()) for n in joined_rows(children.apply(i))]


@pytest.mark.parametrize("name", NAMES)
def test_labels_that_overlap(spark, dense, name):
    sf, n = dense
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    df = df.select(*columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    most = max(joined_rows(df._jdf.queryExecution().executedPlan()), default=0)
    if name in catalog.SQL:
        cursor = connected(sf).execute(catalog.SQL[name])
        names = [d[0] for d in cursor.description]
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert most <= 5 * n
