"""Job-history event logs and their discovery."""

from __future__ import annotations

import fnmatch
import re
import sys
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import EVENT_TYPES
from ..schemas import HISTORY_EVENT

LISTED_ROWS = 10_000

# ship the functions below with the job, so that executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_job_history(spark: SparkSession, paths) -> DataFrame:
    """Event lines of job-history files: ``job_file``, ``type`` and the payload ``event``.

    Lines that do not begin with a brace and events of unknown type are skipped. The
    payload sits under one key that names its class, whatever it is; without one it is NULL.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("job_file"), "value")
    return parse_job_history(lines)


def parse_job_history(lines: DataFrame) -> DataFrame:
    """The same for lines that are already a table (``job_file``, ``value``)."""
    # what is exploded is parsed once: a filter on it would else be pushed below and parse again
    outer = lines.filter(F.col("value").startswith("{")).select(
        "job_file", F.explode(F.array(F.from_json("value", "type STRING, event MAP<STRING, STRING>"))).alias("o")
    )
    known = outer.filter(F.col("o.type").isin(EVENT_TYPES))
    payload = F.from_json(F.get(F.map_values("o.event"), F.lit(0)), HISTORY_EVENT)
    return known.select("job_file", F.col("o.type").alias("type"), F.explode(F.array(payload)).alias("event"))


def history_day(finish_s: int, zone: str = "UTC") -> date:
    """The folder day of a job: its finish time on the cluster's clock."""
    return datetime.fromtimestamp(finish_s, ZoneInfo(zone)).date()


def history_paths(base: str, day: date, job_id: str = "", days: int = 2) -> list[str]:
    """Globs of the finished-job folders for a job: its finish day (cluster time) and the next.

    A job that ends near midnight lands in the folder of the day after.
    """
    out = []
    for i in range(days):
        d = day + timedelta(days=i)
        out.append(f"{base.rstrip('/')}/done/{d:%Y/%m/%d}/*/*{job_id}*jhist")
    return out


def find_history(
    spark: SparkSession, base: str, day: date, job_id: str = "", finished_after: str | None = None, days: int = 2
) -> DataFrame:
    """Paths and modification times of a job's history files in the folders of its finish day and
    the next (a job that ends near midnight lands there), in order of time.

    ``finished_after`` (ISO timestamp) keeps files modified at or after the job's finish. Days
    without a folder are passed over. Folders are listed in tasks, through ``pyarrow.fs``: a day's
    folder in one, each folder in it (the history server begins one every 1000 jobs) in one, so the
    driver holds no list of files.
    """
    where = [(f"{base.rstrip('/')}/done/{day + timedelta(days=i):%Y/%m/%d}",) for i in range(days)]
    schema = "path STRING, folder BOOLEAN, millis BIGINT"
    pattern = fnmatch.translate(f"*{job_id}*jhist")
    top = spark.createDataFrame(where, "path STRING").mapInArrow(_lister(pattern, False), schema)
    below = top.filter("folder").select("path").repartition("path").mapInArrow(_lister(pattern, True), schema)
    found = top.unionByName(below).filter(~F.col("folder"))
    found = found.select("path", F.timestamp_millis("millis").alias("modificationTime"))
    if finished_after:
        found = found.filter(F.col("modificationTime") >= F.lit(finished_after).cast("timestamp"))
    return found.orderBy("modificationTime", "path")


def _opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or URI, the path as that names it, and what it lacks of the URI."""
    if path.startswith("file:") or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:(//[^/]*)?", "", path), "file:"
    fs, own = pafs.FileSystem.from_uri(path)
    return fs, own, path[: -len(own)]


def _lister(pattern: str, recursive: bool):
    """Lists folders: files whose names match, and without ``recursive`` also the folders in them.
    Hidden files and folders (``.``, ``_``) are passed over, as Spark's readers do."""

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from listed(path)

    def listed(path: str) -> Iterator[pa.RecordBatch]:
        fs, own, prefix = _opened(path)
        infos = fs.get_file_info(pafs.FileSelector(own, allow_not_found=True, recursive=recursive))
        for at in range(0, len(infos), LISTED_ROWS):
            paths, kinds, times = [], [], []
            for info in infos[at : at + LISTED_ROWS]:
                folder = info.type == pafs.FileType.Directory
                below = info.path[len(own) :].strip("/").split("/")
                if any(name[:1] in "._" for name in below) or (recursive if folder else not re.match(pattern, info.base_name)):
                    continue
                paths.append(prefix + info.path)
                kinds.append(folder)
                times.append((info.mtime_ns or 0) // 1_000_000)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.bool_()), pa.array(times, pa.int64())], names=["path", "folder", "millis"])

    return folders
