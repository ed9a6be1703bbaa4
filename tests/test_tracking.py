"""Attribute states, chains, absences and merged numbers against plain Python, window by window."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronofold.operators import reports, tracking

OBSERVED = "run long, key string, w long, v string, c double, in_commit boolean, acted boolean, single_high boolean"
WINDOWS = "run long, w long, camera_change boolean, suppressed boolean"


def machine(observations, windows, config):
    """(log, expired) of all keys; every window first drops what waited too long and isn't seen in it."""
    log, expired = [], []
    for run in sorted({w[0] for w in windows}):
        states = {}
        for _, w, camera, _ in sorted(x for x in windows if x[0] == run):
            now = {o[1]: o for o in observations if o[0] == run and o[2] == w}

            def expire(key, s, w=w, run=run):
                if s["pending"] is not None and w - s["chain"][-1] > config.max_pending_gap:
                    expired.append((run, key, w, s["pending"], s["status"]))
                    s.update(pending=None, chain=[])
                    if s["status"] == "pending":
                        s["status"] = "confirmed" if s["ever"] else "observed"

            for key, s in states.items():
                if key not in now:
                    expire(key, s)
            for key, (_, _, _, v, c, commit, acted, single) in sorted(now.items()):
                low, high = c < config.medium, c >= config.high
                s, event, reason = states.get(key), None, None
                if s is None:
                    s = states[key] = {"status": "observed", "value": v, "pending": None, "chain": [], "ever": False}
                    event, reason = "attribute_observed", "low_confidence_observation"
                    if high:
                        s.update(status="confirmed", ever=True)
                        event, reason = "attribute_initialized", "initial_high_confidence_observation"
                    elif not low:
                        s.update(status="pending", pending=v, chain=[w])
                        event, reason = "attribute_pending", "medium_confidence_initial_observation"
                elif low:
                    event, reason = "attribute_observed", "low_confidence_observation"
                else:
                    expire(key, s)
                    direct = commit and high and (acted or not config.require_action_support or single)

                    def support(s=s, w=w, camera=camera):
                        s["chain"] = [*s["chain"], w] if s["chain"] and s["chain"][-1] == w - 1 and not camera else [w]
                        return len(s["chain"]) >= config.support_windows

                    def settle(event, reason, s=s, v=v):
                        s.update(status="confirmed", value=v, ever=True, pending=None, chain=[])
                        return event, reason

                    if s["status"] == "confirmed" and v == s["value"]:
                        s.update(pending=None, chain=[])
                    elif s["status"] == "confirmed" and direct:
                        event, reason = settle("attribute_transition", "high_confidence_with_action_support" if acted else "single_high_policy")
                    elif s["status"] in ("confirmed", "pending") and s["pending"] is not None:
                        if v != s["pending"]:
                            s["status"] = "conflicted"
                            event, reason = "attribute_conflict", "conflicting_pending_value"
                        elif support() and commit:
                            event, reason = settle(*(("attribute_confirmed", "pending_value_confirmed") if s["status"] == "pending" else ("attribute_transition", "consecutive_window_support")))
                        else:
                            event, reason = "attribute_pending", "awaiting_confirmation_support"
                    elif s["status"] == "confirmed":
                        s.update(pending=v, chain=[w])
                        event, reason = "attribute_pending", "awaiting_confirmation_support"
                    elif s["status"] == "observed" and high:
                        event, reason = settle("attribute_initialized", "observed_value_confirmed" if v == s["value"] else "high_confidence_replaces_observed")
                    elif s["status"] == "observed":
                        s.update(status="pending", value=v, pending=v, chain=[w])
                        event, reason = "attribute_pending", "observed_value_pending"
                log.append((run, key, w, s["status"], s["value"], s["pending"], event, reason))
    return log, expired


@pytest.mark.parametrize("seed", range(3))
def test_histories_in_blocks(spark, seed):
    """Histories of up to 90 observations, whole and in blocks of 7, with camera changes, gaps and every policy."""
    rng = random.Random(seed)
    config = tracking.AttributeConfig(support_windows=(2, 3, 1)[seed], max_pending_gap=(1, 3, 0)[seed], require_action_support=seed < 2)
    windows = [(run, w, rng.random() < 0.2, False) for run in range(2) for w in range(120) if rng.random() > 0.1]
    observations = [
        (run, key, w, rng.choice(["open", "open", "closed"] if key < "d" else ["a", "b", "c"]), rng.choice([0.3, 0.7, 0.7, 0.7, 0.9]), rng.random() < 0.7, rng.random() < 0.4, key == "b")
        for run, w, _, _ in windows for key in "abcde" if rng.random() < {"a": 0.95, "b": 0.7, "c": 0.5, "d": 0.3, "e": 0.02}[key]
    ]
    ws = spark.createDataFrame(windows, WINDOWS)
    rows = tracking.with_sweeps(spark.createDataFrame(observations, OBSERVED).join(ws.select("run", "w", "camera_change"), ["run", "w"]), ws, ["run", "key"])
    log, expired = machine(observations, windows, config)
    assert len({x[6] for x in log}) >= 5 and len(expired) > 5
    for block in (1024, 7):
        states = tracking.attribute_states(rows, ["run", "key"], config, block)
        got = [tuple(r) for r in states.select("run", "key", "w", "status", "value", "pending", "event", "reason").collect()]
        assert sorted(map(str, got)) == sorted(map(str, log))
    found = tracking.expired_pending(states, rows, ws, ["run", "key"], config=config).select("run", "key", "w", "pending", "status").collect()
    assert sorted(map(tuple, found)) == sorted(expired)


def test_chains_end_with_the_scene(spark):
    rows = [("a", w, w in (4, 9), f"e{w}") for w in (1, 2, 3, 4, 5, 8, 9, 10)] + [("b", 3, False, "x"), ("b", 3, False, "y")]
    df = spark.createDataFrame(rows, "k string, w long, camera_change boolean, e string")
    got = {(r.k, r.first_w, r.last_w, r.windows) for r in tracking.support_chains(df, ["k"]).collect()}
    assert got == {("a", 1, 3, 3), ("a", 4, 5, 2), ("a", 8, 8, 1), ("a", 9, 10, 2), ("b", 3, 3, 1)}
    listed = {(r.k, r.first_w): r.evidence for r in tracking.support_evidence(df, ["k"], "e").collect()}
    assert listed["a", 4] == ["e4", "e5"] and listed["b", 3] == ["x", "y"]


@pytest.mark.parametrize("most", [0, 2])
def test_absences(spark, most):
    rng = random.Random(most)
    windows = [(run, w, False, rng.random() < 0.3) for run in range(2) for w in range(60) if rng.random() > 0.1]
    sightings = [(run, e, w) for run, w, _, _ in windows for e in "abcd" if rng.random() < {"a": 0.8, "b": 0.3, "c": 0.1, "d": 0.03}[e]]
    sightings += sightings[:5]
    want = []
    for run in range(2):
        for e in "abcd":
            missed, state = None, None
            for _, w, _, hidden in sorted(x for x in windows if x[0] == run):
                seen = (run, e, w) in sightings
                missed = 0 if seen else missed if missed is None or hidden else missed + 1
                if missed is not None:
                    state = "active" if missed == 0 else "inactive" if missed > most else "temporarily_missing"
                    want.append((run, e, w, seen, missed, state))
    s, ws = spark.createDataFrame(sightings, "run long, e string, w long"), spark.createDataFrame(windows, WINDOWS)
    got = tracking.missing_status(s, ws, "e", most).select("run", "e", "w", "seen", "missed", "state").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    changes = defaultdict(list)
    for run, e, w, _, _, state in sorted(want):
        if not changes[run, e] or changes[run, e][-1][0] != state:
            changes[run, e].append([state, w, w])
        changes[run, e][-1][2] = w
    spans = tracking.absence_intervals(s, ws, "e", most).collect()
    assert sorted((r.run, r.e, r.state, r.from_w, r.to_w) for r in spans) == sorted((*k, *x) for k, v in changes.items() for x in v)


def test_merged_runs_are_numbered_across_tasks(spark):
    a, b = (spark.range(n).select((F.col("id") * 7 % n).alias("line"), F.lit(name).alias("name")) for n, name in ((1000, "a"), (300, "b")))
    got = sorted((r.window_index, r.name, r.line) for r in reports.merge_runs([a, b, a.limit(0)], ["line"]).collect())
    assert got == [(i, "a", i) for i in range(1000)] + [(1000 + i, "b", i) for i in range(300)]


def test_duplicate_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice([None, 1]), i, a, a + rng.choice([0, 0, 1, 6])) for i in range(120) for a in [rng.randrange(150)]]
    rows += [("a", 1, 1000 + i, 500, 500) for i in range(40)]  # a large group
    df = spark.createDataFrame(rows, "k string, tool int, id long, a long, b long")
    near = lambda x, y: x[:2] == y[:2] and x[3] <= y[4] + 1 and y[3] <= x[4] + 1
    links = {x[2]: [y[2] for y in rows if y[2] != x[2] and near(x, y)] for x in rows}
    group = {i: i for i in links}
    for _ in rows:
        group = {i: min([group[i], *(group[j] for j in links[i])]) for i in links}
    got = {r.id: (r.group, r.members, r.links) for r in reports.duplicate_groups(df, ["k", "tool"], "id", "a", "b").collect()}
    size = defaultdict(int)
    for g in group.values():
        size[g] += 1
    assert got == {i: (group[i], size[group[i]], len(links[i])) for i in links}


def test_partners_of_large_groups_are_dealt(spark):
    """All pairs of groups of many sizes; a large group and many pairs get more tasks than the session's shuffles."""
    rows = [(g, i) for g, n in ((0, 1), (1, 2), (2, 40), (3, 7)) for i in range(n)] + [(None, 1), (None, 2), (4, None), (4, 5)]
    found = tracking.partners(spark.createDataFrame(rows, "g int, m long"), ["g"], "m", block=8, most=100)
    want = [(g, a, b) for g, a in rows for h, b in rows if g == h and None not in (g, a, b) and a != b]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert found.rdd.getNumPartitions() == 17  # ceil(1658 / 100) for 1, 4, 1600, 49 and 4 pairs
    by_task = found.where("g = 2").groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 1


def test_written_partners_are_stored_small(spark, tmp_path):
    """All members of a task meet one short list before the next, so what is written repeats what lies near."""
    found = tracking.partners(spark.createDataFrame([(1, i * 7919 % 100_003) for i in range(1500)], "g int, m long"), ["g"], "m", block=2000)
    found.coalesce(1).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    assert rows == 1500 * 1499 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * rows
