"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def build_session(app: str = "meterline", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.orc.impl": "native",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
        # call-site capture costs a round trip per column expression when plans are built
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(master: str) -> bool:
    """Whether the driver runs the tasks itself (``local``, ``local[8]``, ``local[2,3]``)."""
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the setting is absent and everything runs in one process (a local master: tests, a
    laptop) is a temporary folder made, one per application. On a cluster it must be set: each
    executor would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder
    if not is_local(context.master):
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors of {context.master} share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="meterline-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared folder unless it already is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
