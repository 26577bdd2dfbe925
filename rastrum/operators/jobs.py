"""Jobs around the operators: paths, manifests, integrity, dispatch."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rastrum.functions.scalar import basename, dirname, file_state, private_params

VERSION = "0.1.0"
PROTOCOL = 1
# The share of a job that each step has reached when it ends, in percent.
PROGRESS_BANDS = {"detect": (("start", 5), ("tiles", 82), ("merge", 94), ("save", 95), ("done", 100)), "road": (("start", 5), ("tiles", 55), ("clean", 92), ("skeleton", 94), ("vectors", 99), ("done", 100))}
MANIFEST = """job_type string, timestamp_utc string, elapsed_seconds double, device string, input_metadata struct<crs:string,width:int,height:int>, parameters map<string,string>,
  outputs array<struct<name:string,type:string,filename:string,sha256:string,size_bytes:bigint>>, summary struct<total_detections:bigint,output_layers_count:int>"""


def mount_paths(files: DataFrame, job: str = "job_id", order: str = "ordinal") -> DataFrame:
    """files (job_id, ordinal, path, writable) with mount and container_path.

    Each folder of a job is a mount, numbered by its first appearance; a mount is writable if any of the
    job's files in it is.
    """
    w = Window.partitionBy(job, "folder")
    first = files.withColumn("folder", dirname(F.col("path"))).withColumn("first", F.min(order).over(w)).withColumn("mode", F.when(F.bool_or("writable").over(w), "rw").otherwise("ro"))
    number = F.dense_rank().over(Window.partitionBy(job).orderBy("first")) - 1
    return first.withColumn("mount", F.concat(F.lit("/mnt/"), number.cast("string"))).withColumn("container_path", F.concat_ws("/", "mount", basename(F.col("path")))).drop("first")


def host_paths(results: DataFrame, mounts: DataFrame, job: str = "job_id") -> DataFrame:
    """results (job_id, container_path) with host_path: the reverse mapping; unknown paths stay as they are."""
    folder = F.regexp_extract("container_path", r"^(/mnt/\d+)(/.*)?$", 1)
    known = mounts.select(job, F.col("mount"), F.col("folder")).distinct()
    rest = F.expr("substring(container_path, length(mount) + 1)")
    return results.withColumn("mount", folder).join(known, [job, "mount"], "left").withColumn("host_path", F.when(F.col("folder").isNotNull(), F.concat("folder", rest)).otherwise(F.col("container_path"))).drop("mount", "folder")


def with_private_params(jobs: DataFrame, params: str = "params") -> DataFrame:
    return jobs.withColumn(params, private_params(F.col(params)))


def integrity(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files (name, content) with sha256 and ok, against registry (name, sha256)."""
    known = registry.select("name", F.col("sha256").alias("wanted"))
    hashed = files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").alias("size"))
    return hashed.join(known, "name", "left").withColumn("ok", file_state(F.col("wanted").isNotNull(), F.col("wanted"), F.col("sha256"), F.col("size"))).drop("wanted", "size")


def manifests(jobs: DataFrame, layers: DataFrame) -> DataFrame:
    """One document for each job: private parameters, outputs with their hashes, counts.

    jobs has job_id, job_type, device, params, crs, width, height, total_detections, elapsed_seconds and
    timestamp_utc; layers has job_id, name, type, path, content. A layer without a file has no hash and size 0.
    """
    out = F.struct("name", "type", basename(F.col("path")).alias("filename"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("size_bytes"))
    per = layers.groupBy("job_id").agg(F.array_sort(F.collect_list(out)).alias("outputs"))
    empty = F.array().cast("array<struct<name:string,type:string,filename:string,sha256:string,size_bytes:bigint>>")
    rows = jobs.join(per, "job_id", "left").withColumn("outputs", F.coalesce("outputs", empty))
    return rows.select(
        "job_id", "job_type", "timestamp_utc", F.round("elapsed_seconds", 2).alias("elapsed_seconds"), F.coalesce("device", F.lit("cpu")).alias("device"), F.struct("crs", "width", "height").alias("input_metadata"),
        private_params(F.col("params")).alias("parameters"), "outputs", F.struct("total_detections", F.size("outputs").alias("output_layers_count")).alias("summary"),
    )


def write_manifest(row, folder: str) -> str:
    """A manifest row as run_manifest.json in folder, indented by two."""
    path = os.path.join(folder, "run_manifest.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row.asDict(recursive=True) | {"version": VERSION, "protocol_version": PROTOCOL}, f, indent=2, ensure_ascii=False)
    return path


def now_utc() -> str:
    return datetime.now(UTC).isoformat()


class JobCanceled(Exception):
    """A job was canceled between two of its steps."""


class UnavailableError(Exception):
    """No place to run a job is ready."""


class JobContext:
    """What a job says while it runs. canceled is asked at each check, messages are (kind, value)."""

    def __init__(self, canceled: Callable[[], bool] = lambda: False):
        self.canceled = canceled
        self.messages: list[tuple[str, str]] = []

    def say(self, kind: str, value) -> None:
        self.messages.append((kind, str(value)))

    def check(self) -> None:
        if self.canceled():
            raise JobCanceled()


_pipelines: dict[str, Callable] = {}


def pipeline(*names: str):
    """Register a function (spark, params) or (spark, params, context) under job names."""

    def add(f):
        for n in names:
            _pipelines[n] = f
        return f

    return add


def dispatch(name: str, spark: SparkSession, params: dict, context: JobContext | None = None):
    """Run a job by name, with a context where one is given; an unknown job is a ValueError."""
    if name not in _pipelines:
        raise ValueError(f"unknown job: {name}")
    return _pipelines[name](spark, params, *([] if context is None else [context]))


def outcome(name: str, spark: SparkSession, params: dict, context: JobContext) -> str:
    """How a job ends: result, canceled, or the error's kind."""
    try:
        dispatch(name, spark, params, context)
    except JobCanceled:
        return "canceled"
    except Exception as e:  # noqa: BLE001
        return type(e).__name__
    return "result"


def cancel(spark: SparkSession, job_id: str) -> None:
    """Cancel all Spark jobs that were started in the job's group."""
    spark.sparkContext.cancelJobGroup(job_id)


def environment(modules: tuple[str, ...]) -> dict[str, str]:
    """Versions of modules, MISSING for those that can't be imported."""
    from importlib import import_module

    found = {}
    for m in modules:
        try:
            found[m] = str(getattr(import_module(m), "__version__", "unknown"))
        except ImportError:
            found[m] = "MISSING"
    return found


def backend_of(asked: str, container: bool, environment_: bool, host: bool) -> str:
    """Where a job runs, of what is ready: "auto" takes a container, else an environment of its own, else the host.

    A container that is asked for by name must be ready; the others are set up when they are first used.
    Nothing ready is an UnavailableError, an unknown choice a ValueError.
    """
    if asked not in ("auto", "docker", "venv", "local"):
        raise ValueError(f"unknown backend: {asked}")
    ready = {"docker": container, "venv": environment_, "local": host}
    if asked in ("venv", "local") or (asked == "docker" and container):
        return asked
    found = next((name for name, ok in ready.items() if ok), None) if asked == "auto" else None
    if found is None:
        raise UnavailableError(asked)
    return found


def image_source(has_current: bool, has_older: bool, pulls_current: bool, pulls_older: bool, builds: bool) -> str:
    """Which image a container job uses: one that is there before one that can be pulled before one that can be built."""
    rules = ((has_current, "current"), (has_older, "older"), (pulls_current, "current, pulled"), (pulls_older, "older, pulled"), (builds, "current, built"))
    for ok, name in rules:
        if ok:
            return name
    raise UnavailableError("no image")


def step_under_way(job: Column, percent: Column) -> Column:
    """The step that a job of a kind is at when it has come so far: the first that ends there or later. Null for an unknown kind or more than all."""
    out = F.lit(None).cast("string")
    for kind, steps in PROGRESS_BANDS.items():
        name = F.lit(None).cast("string")
        for step, end in reversed(steps):
            name = F.when(percent <= end, step).otherwise(name)
        out = F.when(job == kind, name).otherwise(out)
    return out


def backend(asked: Column, container: Column, environment_: Column, host: Column) -> Column:
    """backend_of for a table of requests; null where it is an error. A null flag is not ready."""
    ready = F.when(container, "docker").when(environment_, "venv").when(host, "local")
    return F.when(asked.isin("venv", "local"), asked).when((asked == "docker") & container, asked).when(asked == "auto", ready)


def image(has_current: Column, has_older: Column, pulls_current: Column, pulls_older: Column, builds: Column) -> Column:
    """image_source for a table of requests; null where there is none."""
    return F.when(has_current, "current").when(has_older, "older").when(pulls_current, "current, pulled").when(pulls_older, "older, pulled").when(builds, "current, built")


class LocalFiles:
    """The files of the driver's machine, as ensure_file uses them."""

    def digest(self, path: str) -> str | None:
        """The SHA-256 of a file, None if it is not there or empty."""
        if not os.path.isfile(path) or not os.path.getsize(path):
            return None
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        return digest.hexdigest()

    def move(self, path: str, to: str) -> None:
        os.replace(path, to)

    def remove(self, path: str) -> None:
        if os.path.exists(path):
            os.remove(path)


class MemoryFiles(dict):
    """The same over a dict from paths to bytes, for stores that are not folders and for tests."""

    def digest(self, path: str) -> str | None:
        return hashlib.sha256(self[path]).hexdigest() if self.get(path) else None

    def move(self, path: str, to: str) -> None:
        self[to] = self.pop(path)

    def remove(self, path: str) -> None:
        self.pop(path, None)


def ensure_file(path: str, fetch: Callable[[str], None], sha256: str | None, tries: int = 3, wait: float = 2.0, files=None) -> str:
    """path, fetched if it is not there yet or not whole: into a .part file that is renamed only when its hash is right.

    A file without a listed hash must not be empty. After tries failures the last error is raised and no
    part is left behind.
    """
    files, part = LocalFiles() if files is None else files, path + ".part"

    def whole(p: str) -> bool:
        found = files.digest(p)
        return found is not None and sha256 in (None, found)

    sha256 = sha256.lower() if sha256 else None
    if whole(path):
        return path
    failed = OSError(path)
    for attempt in range(1, tries + 1):
        try:
            fetch(part)
            if whole(part):
                files.move(part, path)
                return path
            failed = OSError(f"{os.path.basename(path)} is not whole")
        except OSError as e:
            failed = e
        files.remove(part)
        if attempt < tries:
            time.sleep(wait * attempt)
    raise failed
