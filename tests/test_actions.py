"""Running values over ranges and action lifecycles against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronofold.operators import actions
from chronofold.operators.ranges import numbered, running

SIGHTINGS = "run long, w long, local_id string, actor string, type string, target string, tool string, in_commit boolean, t double, lost boolean, confidence double"
WINDOWS = "run long, w long, camera_change boolean, end double"


def test_running_values_cross_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([1, 2, None]), rng.choice(["x", "y", None, None])) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v int, s string")
    got = {(r.k, r.i): (r.total, r.last, r.prev) for r in running(df, ["k"], ["i"], sums={"total": F.col("v")}, lasts={"last": F.col("s")}, before={"prev": F.col("s")}, parts=13).collect()}
    total, last, prev, want = defaultdict(lambda: None), defaultdict(lambda: None), defaultdict(lambda: None), {}
    for k, i, v, s in sorted(rows, key=lambda r: r[1]):
        total[k] = total[k] if v is None else (total[k] or 0) + v
        last[k] = s or last[k]
        want[k, i] = (total[k], last[k], prev[k])
        prev[k] = s
    assert got == want
    whole = numbered(df, [], ["i"], "n", 0, parts=9).collect()
    assert [r.n for r in sorted(whole, key=lambda r: r.i)] == list(range(400))
    assert running(df.limit(0), ["k"], ["i"], sums={"total": F.col("v")}).collect() == []


def brute(sightings, windows, config):
    """Window by window: every run's open actions, what is seen, then what is missed."""
    events, final, left = [], [], []
    for run in sorted({r[0] for r in windows}):
        acts, number = [], 0
        for _, w, camera, end in sorted(r for r in windows if r[0] == run):
            touched = set()
            for s in sorted((s for s in sightings if s[0] == run and s[1] == w), key=lambda s: s[2]):
                _, _, local, actor, kind, target, tool, commit, t, lost, confidence = s
                if actor is None:
                    left.append((run, w, local, "unresolved_actor"))
                    continue
                fits = [a for a in acts if a["key"] == (actor, kind, target, tool) and a["life"] in ("started", "ongoing", "uncertain", "possible_ended") and not camera and w - a["w"] <= config.continue_max_gap + 1 and t - a["t"] < config.repeat_min_gap]
                fits.sort(key=lambda a: (-a["w"], a["id"]))
                if fits:
                    a = fits[0]
                    a.update(w=w, t=t, missed=0, life="uncertain" if lost else "ongoing", c=max(a["c"], confidence))
                    a["ws"].add(w)
                    events.append((run, w, a["id"], local, "action_uncertain" if lost else "action_continued", "unresolved_reference" if lost else "same_action_key"))
                elif commit:
                    number += 1
                    life = "instant" if kind in config.instant else "uncertain" if lost else "started"
                    a = {"id": f"action_{number:06d}", "key": (actor, kind, target, tool), "w": w, "t": t, "missed": 0, "life": life, "c": confidence, "ws": {w}, "start": w, "end": (None, None, None)}
                    acts.append(a)
                    events.append((run, w, a["id"], local, f"action_{life}", "commit_evidence"))
                else:
                    left.append((run, w, local, "context_only"))
                    continue
                touched.add(a["id"])
            for a in acts:
                if a["id"] in touched or a["life"] in ("ended", "instant"):
                    continue
                if camera:
                    a["life"] = "uncertain"
                    events.append((run, w, a["id"], None, "action_uncertain", "camera_change_or_occlusion"))
                    continue
                a["missed"] += 1
                a["life"] = "possible_ended" if a["missed"] < config.end_missing else "ended"
                if a["life"] == "ended":
                    a["end"] = (w, a["t"], end)
                events.append((run, w, a["id"], None, f"action_{a['life']}", "missing_observation_window"))
        final += [(run, a["id"], *a["key"], a["life"], a["start"], a["w"], a["t"], len(a["ws"]), a["c"], *a["end"]) for a in acts]
    return events, final, left


def compare(spark, sightings, windows, config):
    s, w = spark.createDataFrame(sightings, SIGHTINGS), spark.createDataFrame(windows, WINDOWS)
    events, final = actions.action_log(s, w, config)
    left = actions.intake_warnings(s, events)
    want = brute(sightings, windows, config)
    text = lambda rows: sorted(map(str, rows))
    assert text(tuple(r) for r in events.select("run", "w", "action_id", "local_id", "event_type", "reason").collect()) == text(want[0])
    assert text(tuple(r) for r in final.collect()) == text(want[1])
    assert text(tuple(r) for r in left.collect()) == text(want[2])
    return want


@pytest.mark.parametrize("seed", range(4))
def test_random_runs(spark, seed):
    """Keys seen several times in a window, times that go back, gaps of windows, camera changes, null references."""
    rng = random.Random(seed)
    config = actions.LifecycleConfig(*[(1, 2, 5.0), (3, 2, 7.0), (0, 1, 100.0), (2, 4, 3.0)][seed], instant=("press",))
    windows, sightings = [], []
    for run in range(3):
        ws = [w for w in range(70) if rng.random() > 0.08]
        windows += [(run, w, rng.random() < 0.15, w * 2.0 + 4) for w in ws]
        for w in ws:
            for i in range(rng.choice([0, 1, 1, 2, 4])):
                sightings.append((run, w, f"l{i}", rng.choice(["a", "a", "b", None]), rng.choice(["hold", "hold", "press"]), rng.choice(["t", None]), None, rng.random() < 0.5, w * 2.0 + rng.choice([0.0, 1.0, 3.5, 4.0]), rng.random() < 0.2, round(rng.random(), 3)))
    events, final, _ = compare(spark, sightings, windows, config)
    assert len({e[4:] for e in events}) >= 7 and len(final) > 20


def test_each_branch(spark):
    """One run a case; windows are 2 apart and end 4 after their begin."""
    config = actions.LifecycleConfig()
    quiet = lambda run, n, camera=(): [(run, w, w in camera, w * 2.0 + 4) for w in range(n)]
    see = lambda run, w, commit=True, t=None, lost=False, local="x", kind="hold", actor="a", target=None: (run, w, local, actor, kind, target, None, commit, float(2 * w if t is None else t), lost, 0.5)
    windows, sightings = [], []
    cases = {
        0: (quiet(0, 4), [see(0, 0, False), see(0, 1, True)]),  # the first in-commit sighting starts, the one before is left
        1: (quiet(1, 4), [see(1, 0), see(1, 1, False), see(1, 2, False)]),  # context only goes on
        2: (quiet(2, 6), [see(2, 0), see(2, 3)]),  # ended, then another
        3: (quiet(3, 6, {1}), [see(3, 0), see(3, 2)]),  # goes on after a camera change that it wasn't seen in
        4: (quiet(4, 6, {1}), [see(4, 0), see(4, 1), see(4, 2)]),  # a camera change starts another, the first stays uncertain
        5: (quiet(5, 3, {1, 2}), [see(5, 0)]),  # ends its run uncertain
        6: (quiet(6, 4), [see(6, 0, kind="press"), see(6, 1, kind="press"), see(6, 2, False, kind="press")]),  # instants are new each time
        7: (quiet(7, 4), [see(7, 0), see(7, 1, lost=True), see(7, 2)]),  # a lost reference
        8: (quiet(8, 4), [see(8, 0, lost=True), see(8, 1, actor=None)]),  # starts uncertain; no actor
        9: (quiet(9, 3), [see(9, 0, t=0), see(9, 1, t=5.0)]),  # a repetition after 5 seconds
        10: (quiet(10, 3), [see(10, 0, target="t"), see(10, 1)]),  # another target is another action
        11: (quiet(11, 2, {0}), [see(11, 0, local="x"), see(11, 0, local="y"), see(11, 1)]),  # of two alike the first goes on
        12: (quiet(12, 2), [see(12, 0, t=0, local="x"), see(12, 0, t=9, local="y"), see(12, 1, t=9.5)]),  # but only if its time allows
    }
    for w, s in cases.values():
        windows, sightings = windows + w, sightings + s
    events, final, left = compare(spark, sightings, windows, config)
    lives = defaultdict(list)
    for r in sorted(final):
        lives[r[0]].append(r[6])
    assert dict(lives) == {0: ["ended"], 1: ["possible_ended"], 2: ["ended", "ended"], 3: ["ended"], 4: ["ended", "ended"], 5: ["uncertain"], 6: ["instant", "instant"], 7: ["possible_ended"], 8: ["ended"], 9: ["ended", "possible_ended"], 10: ["ended", "possible_ended"], 11: ["ongoing", "possible_ended"], 12: ["possible_ended", "ongoing"]}
    assert len(left) == 3


def test_no_rows(spark):
    s, w = spark.createDataFrame([], SIGHTINGS), spark.createDataFrame([], WINDOWS)
    assert [d.collect() for d in actions.action_log(s, w)] == [[], []]


def test_what_stands_alone_is_not_folded_and_missed_windows_are_not_written(spark, monkeypatch):
    """Sightings far apart, and a camera that changes in every window, so that no action ever ends."""
    written = {}
    stored = actions.stored

    def noted(df, name):
        written[name] = stored(df, name)
        return written[name]

    monkeypatch.setattr(actions, "stored", noted)
    windows = [(0, w, True, w * 2.0) for w in range(200)]
    sightings = [(0, w, "x", "a", "hold", None, None, w % 20 == 0, float(w), False, 0.5) for w in range(0, 200, 10)]
    events, final, left = compare(spark, sightings, windows, actions.LifecycleConfig())
    assert {r[6] for r in final} == {"uncertain"} and len(left) == 10 and len(events) == 10 + sum(199 - w for w in range(0, 200, 20))
    assert "missed" not in written and written["links"].count() == 0
