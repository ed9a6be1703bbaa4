"""Run folders: splits, round trips, commits and failures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronofold.sources import run_folders


def test_splits_see_every_line_once(spark, tmp_path):
    rng = random.Random(3)
    texts = ["", "é" * 40, "a\nb", '"', *["x" * rng.randrange(60) for _ in range(200)]]
    for run in ("r1", "r 2"):
        (tmp_path / run.replace(" ", "%20")).mkdir()
        body = "".join(json.dumps({"n": i, "t": t}, ensure_ascii=i % 2 == 0) + ("\r\n" if i % 7 == 0 else "\n") + "\n" * (i % 5 == 0) for i, t in enumerate(texts))
        (tmp_path / run.replace(" ", "%20") / "windows.jsonl").write_text(body.rstrip("\n"), newline="")
    for size in (1, 17, 100, 1000, 1 << 20):
        if size == 1:  # a split a byte: every line still belongs to one of them
            reader = run_folders.RunFolderReader({"path": str(tmp_path), "log": "windows", "split_bytes": "1"})
            got = sorted((b.column("run_id")[i].as_py(), *json.loads(b.column("record")[i].as_py()).values()) for s in reader.partitions() for b in reader.read(s) for i in range(b.num_rows))
        else:
            got = sorted(map(tuple, run_folders.read_log(spark, str(tmp_path), "windows", "n int, t string", split_bytes=max(size, 100)).collect()))
        assert got == sorted((r, i, t) for r in ("r1", "r 2") for i, t in enumerate(texts))


def test_round_trip_and_statistics(spark, tmp_path):
    windows = spark.createDataFrame([(r, i, i / 3) for r in ("a", "_b", "..", "c/d") for i in range(50)], "run_id string, w int, at double")
    errors = spark.createDataFrame([("a", "stage", None), ("e", None, "text\nlines")], "run_id string, stage string, message string")
    meta = run_folders.write_runs({"windows": windows, "errors": errors}, f"file://{tmp_path}/out")
    assert {(r.run_id, r.errors_count, r.windows_count) for r in meta.collect()} == {("a", 1, 50), ("_b", 0, 50), ("..", 0, 50), ("c/d", 0, 50), ("e", 1, 0)}
    assert sorted(run_folders.read_log(spark, f"{tmp_path}/out", "windows", "w int, at double").collect()) == sorted(windows.collect())
    assert {tuple(r) for r in run_folders.read_log(spark, f"{tmp_path}/out", "errors", "stage string, message string").collect()} == {tuple(r) for r in errors.collect()}
    assert run_folders.read_log(spark, f"{tmp_path}/out", "metrics", "x int").count() == 0
    with pytest.raises(Exception, match="already"):
        run_folders.write_runs({"windows": windows}, f"{tmp_path}/out")
    run_folders.write_log(windows, f"{tmp_path}/out", "windows")
    assert run_folders.read_log(spark, f"{tmp_path}/out", "windows", "w int").count() == 400


def test_failed_task_leaves_no_rows(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 3).cast("string").alias("run_id"), "id")
    bad = rows.withColumn("run_id", F.when(F.col("id") != 3999, F.col("run_id")))  # the null run fails the task that holds it
    with pytest.raises(Exception, match="run_id"):
        run_folders.write_log(bad, str(tmp_path / "o"), "windows")
    assert run_folders.read_log(spark, str(tmp_path / "o"), "windows", "id long").count() == 0
    assert not list(tmp_path.rglob("_commits/*"))
    (tmp_path / "o" / "0" / "windows").mkdir(parents=True, exist_ok=True)
    (tmp_path / "o" / "0" / "windows" / "part-lost.jsonl").write_text('{"id": 1}\n')  # a part that a lost executor left
    run_folders.write_log(rows, str(tmp_path / "o"), "windows")
    assert sorted(r.id for r in run_folders.read_log(spark, str(tmp_path / "o"), "windows", "id long").collect()) == list(range(4000))


def test_broken_lines_and_empty_logs(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "windows.jsonl").write_text('{"w": 1}\n{broken\n')
    assert [tuple(r) for r in run_folders.read_log(spark, str(tmp_path), "windows", "w int", strict=False).orderBy("w").collect()] == [("r", None), ("r", 1)]
    with pytest.raises(Exception):  # noqa: B017
        run_folders.read_log(spark, str(tmp_path), "windows", "w int").collect()
    run_folders.write_log(spark.createDataFrame([], "run_id string, w int"), str(tmp_path), "errors")
    assert run_folders.read_log(spark, str(tmp_path), "errors", "w int").count() == 0
