"""Documents sent in numbered batches that stop at the first failure and go on from there.

The documents are put in order once and cut into batches of ``rows``; these are stored, so that a
rerun sends the same batches. Waves of batches are then delivered in tasks, a batch at a time, and what
became of each is appended to a ledger beside them. After a wave in which a batch failed no
further wave is sent; a rerun sends the batches that the ledger does not show as delivered, the
failed one first.

A task that dies between a delivery and the ledger's write is repeated, so a delivery must be safe
to repeat under its batch number: ``to_files`` writes one file for each number, a bulk request would carry
the number as its id.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import add_index
from .versions import Versions

# ship the functions below with the job, so that executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 500
WAVE = 1024
LEDGER = "batch BIGINT, documents BIGINT, error STRING"


class BatchFailed(RuntimeError):
    def __init__(self, batch: int, error: str):
        super().__init__(f"batch {batch}: {error}")
        self.batch = batch


def to_files(folder: str) -> Callable[[int, list[str]], None]:
    """Delivery as one newline-delimited JSON file per batch, replaced if it is there."""

    def deliver(batch: int, documents: list[str]) -> None:
        fs, path = pafs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (pafs.LocalFileSystem(), folder)
        fs.create_dir(path, recursive=True)
        draft = f"{path}/_{batch:012d}"
        with fs.open_output_stream(draft) as out:
            out.write("".join(f"{d}\n" for d in documents).encode())
        fs.move(draft, f"{path}/batch-{batch:012d}.json")

    return deliver


def stage_batches(df: DataFrame, path: str, order: Sequence[str], rows: int = ROWS) -> int:
    """Cut ``df``, in the given order, into numbered batches (from 0) below ``path``; returns their number.

    The order need not be total, but the batches are those of this one call. Staging a path again is
    an error: its ledger speaks of the batches that are there.
    """
    versions = Versions(df.sparkSession, path)
    if versions.latest()[0]:
        raise ValueError(f"{path} holds staged batches")
    numbered = add_index(df.withColumn("_document", F.to_json(F.struct(*df.columns))), list(order), distributed=True, name="_number")
    staged = versions.new_folder("staged")
    batch = F.floor((F.col("_number") - 1) / rows).cast("bigint")
    numbered.select(batch.alias("batch"), F.col("_number").alias("number"), F.col("_document").alias("document")).write.parquet(staged)
    count = df.sparkSession.read.parquet(staged).agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
    versions.commit(0, {"staged": staged, "batches": count, "done": 0, "ledger": []})
    return count


def _send(deliver: Callable[[int, list[str]], None]):
    def of_batch(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        documents = [d for _, d in sorted(zip(table.column("number").to_pylist(), table.column("document").to_pylist(), strict=True))]
        error = None
        try:
            deliver(batch, documents)
        except Exception as failure:  # noqa: BLE001  what goes wrong in a delivery is the ledger's to tell
            error = f"{type(failure).__name__}: {failure}"[:2000]
        return pa.table({"batch": pa.array([batch], pa.int64()), "documents": pa.array([len(documents)], pa.int64()), "error": pa.array([error], pa.string())})

    return of_batch


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``batch, documents, error`` of every delivery that was tried, in the order of the waves (``wave``)."""
    _, state = Versions(spark, path).latest()
    out = spark.createDataFrame([], f"{LEDGER}, wave INT")
    for wave, folder in enumerate(state.get("ledger", [])):
        out = out.unionByName(spark.read.schema(LEDGER).parquet(folder).withColumn("wave", F.lit(wave)))
    return out


def send_batches(spark: SparkSession, path: str, deliver: Callable[[int, list[str]], None], wave: int = WAVE) -> int:
    """Deliver what is left, ``wave`` batches at a time; returns how many batches are delivered in all.

    Raises ``BatchFailed`` with the smallest batch that failed; nothing beyond its wave has been sent.
    """
    versions = Versions(spark, path)
    number, state = versions.latest()
    if not number:
        raise ValueError(f"no staged batches at {path}")
    staged = spark.read.parquet(state["staged"])
    while state["done"] < state["batches"]:
        begin, end = state["done"], min(state["done"] + wave, state["batches"])
        mine = staged.filter((F.col("batch") >= begin) & (F.col("batch") < end))
        delivered = [spark.read.schema(LEDGER).parquet(f).filter("error IS NULL").select("batch") for f in state["ledger"][state.get("first", 0) :]]
        for known in delivered:
            mine = mine.join(known, "batch", "left_anti")
        folder = versions.new_folder("ledger")
        mine.groupBy("batch").applyInArrow(_send(deliver), LEDGER).write.parquet(folder)
        failed = spark.read.schema(LEDGER).parquet(folder).filter("error IS NOT NULL").orderBy("batch").limit(1).collect()
        ledger = [*state["ledger"], folder]
        # up to the wave of a failure all is delivered; the ledgers from ``first`` on say what is beyond
        state = state | {"ledger": ledger} | ({} if failed else {"done": end, "first": len(ledger)})
        number = versions.commit(number, state)
        if failed:
            raise BatchFailed(failed[0]["batch"], failed[0]["error"])
    return state["batches"]
