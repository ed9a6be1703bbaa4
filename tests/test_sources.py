"""Scans, sinks, run ids, streams and normalization on small fixtures."""

import ast
import json
import random

from pyspark.sql import functions as F

from chronofold.functions import vocabulary
from chronofold.operators import observations as obs
from chronofold.operators import intake, schema, windows
from chronofold.sources import runs
from chronofold.streaming.logs import latest, stream_logs, window_counts


def test_jsonl_windows_and_frames(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"run_id": "r", "global_index": 0, "sampled_frames": [{"sample_index": 0, "frame_index": 3, "timestamp_seconds": 0.5}]}\n{"run_id": "r", "global_index": 1}\n')
    w = runs.read_windows(spark, str(tmp_path / "w.jsonl"))
    frames = runs.frames(w)
    assert [tuple(r) for r in frames.collect()] == [("r", 0, 0, 3, 0.5)]
    again = runs.attach_frames(w, frames)
    assert {r.global_index: len(r.sampled_frames or []) for r in again.collect()} == {0: 1, 1: 0}
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    assert runs.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int", strict=False).collect()[0].a is None


def test_logs_and_switches(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "run int, x string")
    assert runs.write_logs({"events": df, "errors": df}, str(tmp_path), enabled={"events"}) == ["events"]
    assert spark.read.json(f"{tmp_path}/events").count() == 2 and not (tmp_path / "errors").exists()


def test_run_ids_and_hashes(spark):
    df = spark.createDataFrame([("my video.mp4", "2024-01-02 03:04:05"), ("x", "2024-01-02 03:04:05")], "name string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    ids = [r.run_id for r in runs.run_ids(df, "name", "at").collect()]
    assert ids[0].startswith("20240102_030405_my_video_mp4_") and len(set(ids)) == 2
    assert ids == [r.run_id for r in runs.run_ids(df, "name", "at").collect()]
    assert runs.content_hashes(spark.createDataFrame([("abc",)], "t string"), ["t"]).first().t_sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_stream_in_several_batches(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, f"2024-01-01 00:{i:02d}:00", i / 60) for i in range(60)], "run int, ts string, confidence double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_logs(window_counts(stream, ["run", F.window("ts", "10 minutes")]), {"n": lambda b: b.select("run", "window", "n")}, f"{tmp_path}/out", f"{tmp_path}/ck", mode="update")
    q.awaitTermination(120)
    got = latest(spark, f"{tmp_path}/out/n", ["run", "window"])
    assert got.agg(F.sum("n")).first()[0] == 60 and got.count() == 18


def test_windows_with_gaps(spark):
    got = windows.build_windows(spark.createDataFrame([(1, 100)], "run int, duration int"), 10, 30).orderBy("global_index").collect()
    assert [(r.start, r.commit_start, r.end) for r in got] == [(0, 0, 10), (30, 30, 40), (60, 60, 70), (90, 90, 100)]


def test_fences(spark):
    cases = {'a ```json\n{"x": 1}\n``` b': '{"x": 1}', '```\n{"x": {}}```': '{"x": {}}', 'text {"y": 2} end': '{"y": 2}', "```{1": "", "none": "", '```json {"a": 1}``` then ```json {"b": 2}```': '{"a": 1}', "} {": ""}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.j or "" for r in df.select("raw", obs.json_text(F.col("raw")).alias("j")).collect()} == cases


def test_normalization_is_idempotent(spark):
    words, aliases = vocabulary.actions(spark, {"press": "control", "other": "other", "unknown": "unknown"}, {"click": "press"})
    df = spark.createDataFrame([("click",), ("press",), ("jump",), (None,)], "raw_action string")
    once = obs.normalize_actions(df, words, aliases)
    twice = obs.normalize_actions(once.drop("action_type", "action_family", "normalization_status"), words, aliases)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_schema_of_nested_documents(spark):
    docs = {
        1: '{"window": {"global_index": 1, "start_seconds": 0, "commit_start_seconds": 0, "end_seconds": 2}}',
        2: '{"window": {"global_index": -1, "start_seconds": "x", "commit_start_seconds": 0, "end_seconds": 2}, "entities": [{"local_id": "a", "entity_type": "tool", "confidence": 1}, {"local_id": null, "confidence": 2, "z": {"deep": 1}}]}',
        3: '{"schema_version": "1.0", "window": {"global_index": 1, "start_seconds": 0, "end_seconds": 2}, "scene": [], "summary": null}',
        4: "[1]",
    }
    df = spark.createDataFrame(list(docs.items()), "id int, t string").withColumn("v", F.try_parse_json("t"))
    got = {}
    for r in schema.observation_violations(df, ["id"], "v").collect():
        got.setdefault(r.id, set()).add(f"{r.path}: {r.reason}")
    assert got == {
        2: {"window.global_index: range", "window.start_seconds: type", "entities[1].local_id: type", "entities[1].entity_type: missing", "entities[1].confidence: range", "entities[1].z: extra"},
        3: {"scene: type", "summary: type"},
        4: {": type"},
    }


def test_every_rule_of_an_observation(spark):
    """A document with all fields breaks nothing; one change at a time breaks the rule that it is about."""
    frames = {"evidence_frames": [0, 1], "confidence": 0.5}
    whole = {
        "schema_version": "2.0", "window": {"global_index": 0, "start_seconds": 0, "commit_start_seconds": 1, "end_seconds": 2.5}, "summary": "s",
        "scene": {"camera_change": True, "view_type": "detail", "scene_visibility": "poor", "target_visibility": "clear", "continuity_hint": "unknown", "description": "", "visibility": None},
        "entities": [{"local_id": "e", "entity_type": "ppe", "name": "", "description": "", "appearance": {"a": [1, {"b": None}]}, "spatial_region": "left", "candidate_global_id": None, **frames}],
        "actions": [{"local_id": "a", "actor_local_id": None, "action_type": "x", "raw_action_type": None, "action_family": None, "normalization_status": "unknown", "target_local_id": "e", "tool_local_id": None, "phase_observation": "instant", "description": "", **frames}],
        "attribute_observations": [{"entity_local_id": "e", "attribute_key": "k", "value": "v", "raw_attribute": None, "raw_value": None, "normalization_status": "invalid_for_entity_type", "attribute": None, **frames}],
        "relations": [{"subject_local_id": "e", "relation_type": "r", "object_local_id": "f", **frames}],
        "uncertainties": [{"uncertainty_type": "causality", "description": "d", "related_local_ids": ["e"], "evidence_frames": []}],
        "visual_fact": None, "task_conditioned_interpretation": {"description": "d", "confidence": 1, "supporting_local_ids": []},
    }
    changes = {
        "window.global_index=-1": "window.global_index: range", "window.global_index=1.5": "window.global_index: type", "window.start_seconds=-1": "window.start_seconds: range",
        "window.end_seconds=0": "window.end_seconds: range|window: ends before its start", "window.end_seconds=0.0": "window.end_seconds: range|window: ends before its start", "window.commit_start_seconds=2.5": "window: commit start outside",
        "window.commit_start_seconds=None": ": 2.0 needs window.commit_start_seconds", "window=None": "window: type", "summary=5": "summary: type", "scene.camera_change='maybe'": "scene.camera_change: type", "scene.view_type='far'": "scene.view_type: value",
        "scene.scene_visibility='full'": "scene.scene_visibility: value", "scene.target_visibility=None": "scene.target_visibility: type", "scene.continuity_hint='cut'": "scene.continuity_hint: value", "scene.visibility='full'": "scene.visibility: value",
        "entities.0.local_id=''": "entities[0].local_id: length", "entities.0.entity_type='cat'": "entities[0].entity_type: value", "entities.0.appearance=[]": "entities[0].appearance: type", "entities.0.confidence=1.01": "entities[0].confidence: range",
        "entities.0.evidence_frames=None": "entities[0].evidence_frames: type", "entities.0.evidence_frames.1=0.5": "entities[0].evidence_frames[1]: type", "entities.0.global_id='x'": "entities[0].global_id: extra", "actions.0.action_type=''": "actions[0].action_type: length",
        "actions.0.phase_observation='over'": "actions[0].phase_observation: value", "actions.0.normalization_status='invalid_for_entity_type'": "actions[0].normalization_status: value", "attribute_observations.0.normalization_status='unknown'": "attribute_observations[0].normalization_status: value",
        "attribute_observations.0.attribute_key=None": "attribute_observations[0]: attribute_key needed", "attribute_observations.0.value=''": "attribute_observations[0].value: length", "relations.0.object_local_id=None": "relations[0].object_local_id: type",
        "uncertainties.0.uncertainty_type='mood'": "uncertainties[0].uncertainty_type: value", "uncertainties.0.related_local_ids.0=1": "uncertainties[0].related_local_ids[0]: type", "task_conditioned_interpretation.description=''": "task_conditioned_interpretation.description: length",
        "task_conditioned_interpretation=[]": "task_conditioned_interpretation: type",
        # these break nothing
        "schema_version='1.0'": "", "window.global_index='3'": "", "window.global_index=2.0": "", "window.start_seconds='0.5'": "", "scene.camera_change='off'": "", "scene.camera_change=1": "", "entities.0.confidence='1'": "", "task_conditioned_interpretation=None": "", "visual_fact='f'": "", "entities=[]": "",
    }
    rows = [("whole", json.dumps(whole)), ("least", '{"schema_version": "1.0", "window": {"global_index": 0, "start_seconds": 0, "end_seconds": 1}}')]
    for change in changes:
        path, value = change.split("=")
        doc = json.loads(json.dumps(whole))
        at = doc
        for part in path.split(".")[:-1]:
            at = at[int(part) if part.isdigit() else part]
        last = path.split(".")[-1]
        at[int(last) if last.isdigit() else last] = ast.literal_eval(value)
        rows.append((change, json.dumps(doc)))
    df = spark.createDataFrame(rows, "id string, t string").withColumn("v", F.try_parse_json("t"))
    got = {}
    for r in schema.observation_violations(df, ["id"], "v").collect():
        got.setdefault(r.id, set()).add(f"{r.path}: {r.reason}")
    assert got == {c: set(w.split("|")) for c, w in changes.items() if w}


def test_formal_ids(spark):
    ids = {"person_1": True, "equipment_0012": True, "person_x": False, "box_1": False, "person": False, "a_person_1": False, None: False}
    df = spark.createDataFrame([(k,) for k in ids], "x string")
    assert {r.x: r.f for r in df.select("x", intake.is_formal_id(F.col("x")).alias("f")).collect()} == ids


def test_intervals_of_any_length(spark):
    rng = random.Random(8)
    intervals = [(rng.choice("ab"), i, s, s + rng.choice([0, -3, 1, 2, 3, 7, 8, 9, 1000, 1 << 40])) for i in range(80) for s in [rng.randrange(-50, 300)]] + [("a", 99, None, 5)]
    points = [(rng.choice("abc"), rng.randrange(-60, 400)) for _ in range(300)] + [("a", None)] + [("a", 10)] * 50
    df = windows.assign_to_intervals(spark.createDataFrame(points, "k string, t long"), spark.createDataFrame(intervals, "k string, i int, start long, end long"), ["k"])
    want = sorted((k, t, i) for k, t in points for j, i, s, e in intervals if k == j and None not in (t, s) and s <= t < e)
    assert sorted((r.k, r.t, r.i) for r in df.collect()) == want
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
