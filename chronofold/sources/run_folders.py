"""Run folders as a Spark data source: a folder a run, logs of JSON lines in it, written with a two-phase commit.

`<root>/<run>/<log>.jsonl` is a log as a single file, as other programs leave
it.  What Spark writes lies in `<root>/<run>/<log>/part-*.jsonl` and counts only
when a manifest below `<root>/_commits` names it.  A task writes its parts and
reports them; the driver writes the manifest under another name and renames it,
so that a job's rows appear all at once or never.  Parts of failed tasks are
deleted, or at worst lie there unread.

Paths are local or whatever pyarrow's file systems open by URI; driver and
executors must see the same folder.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: A split's bytes, unless the option split_bytes says otherwise, and the rows of a batch.
SPLIT_BYTES = 64 << 20
_BATCH = 4096
_SCHEMA = "run_id string, file string, position long, record string"


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _folder(run: str | None) -> str:
    """Folder name of a run; names that would be hidden or leave the root are escaped."""
    if not run:
        raise ValueError("rows of a run log need a run_id")
    name = quote(run, safe="")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[0] in "._" else name


def _files(store: fs.FileSystem, folder: str, recursive: bool = False) -> list[fs.FileInfo]:
    return store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=recursive))


def _committed(store: fs.FileSystem, root: str, log: str) -> Iterator[dict]:
    for f in sorted(_files(store, f"{root}/_commits"), key=lambda f: f.base_name):
        if f.base_name.startswith(f"{log}-") and f.base_name.endswith(".json"):
            with store.open_input_stream(f.path) as x:
                yield from json.loads(x.readall())


@dataclass
class Split(InputPartition):
    run: str
    path: str
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(None)


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)


class RunFolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.log = options["path"].rstrip("/"), options["log"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        """Splits of all committed parts and of single-file logs; an empty one if there are none, as Spark needs one."""
        store, root = _open(self.root)
        found = [(p["run"], f"{root}/{p['file']}", p["bytes"]) for p in _committed(store, root, self.log)]
        for d in _files(store, root):
            if d.type == fs.FileType.Directory and d.base_name[0] not in "._":
                single = store.get_file_info(f"{d.path}/{self.log}.jsonl")
                if single.type == fs.FileType.File:
                    found.append((unquote(d.base_name), single.path, single.size))
        return [Split(run, path, at, min(at + self.split, size)) for run, path, size in found for at in range(0, size, self.split)] or [Split("", "", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the split; blank ones are left out."""
        if split.end == split.start:
            return
        store, root = _open(self.root)
        name, lines, places = split.path[len(root) + 1 :], [], []

        def batch() -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array([split.run] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["run_id", "file", "position", "record"])

        with io.BufferedReader(store.open_input_file(split.path), 1 << 20) as x:
            x.seek(max(0, split.start - 1))
            if split.start:
                x.readline()  # to the end of the line that holds the byte before the split
            while (at := x.tell()) < split.end and (line := x.readline()):
                if line.strip():
                    lines.append(line.decode().rstrip("\r\n"))
                    places.append(at)
                if len(lines) == _BATCH:
                    yield batch()
                    lines.clear(), places.clear()
        if lines:
            yield batch()


class RunFolderWriter(DataSourceArrowWriter):
    """Rows with run_id and record; where new_runs is true, a run that has rows in the log already fails the job."""

    def __init__(self, options: dict) -> None:
        self.root, self.log, self.job = options["path"].rstrip("/"), options["log"], uuid.uuid4().hex
        self.new_runs = options.get("new_runs", "false").lower() == "true"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.root)
        done, open_, out = Written(), None, None
        try:
            for b in batches:
                for run, record in zip(b.column("run_id").to_pylist(), b.column("record").to_pylist(), strict=True):
                    if open_ is None or run != open_["run"]:
                        if out is not None:
                            out.close()
                        folder = f"{_folder(run)}/{self.log}"
                        store.create_dir(f"{root}/{folder}")
                        open_ = {"run": run, "file": f"{folder}/part-{self.job}-{uuid.uuid4().hex}.jsonl", "rows": 0, "bytes": 0}
                        done.parts.append(open_)
                        out = store.open_output_stream(f"{root}/{open_['file']}")
                    line = (record or "{}").encode() + b"\n"
                    out.write(line)
                    open_["rows"] += 1
                    open_["bytes"] += len(line)
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            _delete(store, root, [done])
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.root)
        parts = [p for m in messages if m is not None for p in m.parts]
        if self.new_runs and (again := {p["run"] for p in _committed(store, root, self.log)} & {p["run"] for p in parts}):
            _delete(store, root, messages)
            raise FileExistsError(f"runs that are in {self.log} already: {sorted(again)[:5]}")
        store.create_dir(f"{root}/_commits")
        name = f"{root}/_commits/{self.log}-{self.job}.json"
        with store.open_output_stream(f"{name}.open") as out:
            out.write(json.dumps(parts).encode())
        store.move(f"{name}.open", name)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.root)
        _delete(store, root, messages)


def _delete(store: fs.FileSystem, root: str, messages: list[Written | None]) -> None:
    for p in (p for m in messages if m is not None for p in m.parts):
        if store.get_file_info(f"{root}/{p['file']}").type == fs.FileType.File:
            store.delete_file(f"{root}/{p['file']}")


class RunFolders(DataSource):
    """Options: path, log, split_bytes (reading), new_runs (writing)."""

    @classmethod
    def name(cls) -> str:
        return "run_folders"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> RunFolderReader:
        return RunFolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> RunFolderWriter:
        if overwrite:
            raise ValueError("run logs are only appended to")
        return RunFolderWriter(self.options)


def read_log(spark: SparkSession, path: str, log: str, schema: str, strict: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """run_id and the log's fields; a broken line fails the read, or becomes nulls if not strict.

    A field named run_id is left to the folder's name.  A log that isn't there is empty.
    """
    spark.dataSource.register(RunFolders)
    rows = spark.read.format("run_folders").option("log", log).option("split_bytes", str(split_bytes)).load(path)
    parsed = F.from_json("record", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    rows = rows.select("run_id", parsed.alias("_record"))
    return rows.select("run_id", *[F.col(f"_record.`{c}`") for c in rows.schema["_record"].dataType.names if c != "run_id"])


def write_log(rows: DataFrame, path: str, log: str, new_runs: bool = False) -> None:
    """Append rows (run_id and other columns) to the log of each one's run, all or none of them.

    Rows are dealt by ranges of run and content: a large run is split over tasks,
    and a task writes few runs, one file at a time.  Null fields aren't written.
    """
    rows.sparkSession.dataSource.register(RunFolders)
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "run_id"]))
    lines = rows.select(F.col("run_id").cast("string").alias("run_id"), record.alias("record"))
    lines = lines.repartitionByRange("run_id", F.xxhash64("record")).sortWithinPartitions("run_id", F.xxhash64("record"), "record")
    lines.write.format("run_folders").mode("append").option("log", log).option("new_runs", str(new_runs).lower()).save(path)


def write_runs(logs: dict[str, DataFrame], path: str, new_runs: bool = True) -> DataFrame:
    """Write windows, observations, metrics, errors and whatever other logs are given, then `meta`: the final statistics of each run.

    Returns meta's rows: run_id and for every log its number of rows, 0 where a run has none.
    """
    spark = next(iter(logs.values())).sparkSession
    for log in sorted(logs):
        write_log(logs[log], path, log, new_runs)
    counts = None
    for log in sorted(logs):
        n = read_log(spark, path, log, "_any string", strict=False).select("run_id", F.lit(log).alias("log"))
        counts = n if counts is None else counts.unionByName(n)
    meta = counts.groupBy("run_id").agg(*[F.count_if(F.col("log") == log).alias(f"{log}_count") for log in sorted(logs)])
    write_log(meta, path, "meta", new_runs)
    return read_log(spark, path, "meta", ", ".join(f"{log}_count long" for log in sorted(logs)))
