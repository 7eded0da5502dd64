"""A table of documents that is changed in place: keyed, in buckets, copy on write.

Rows lie in folders by the hash of their key. An update is combined by key, merged with the
buckets it hits, and only these are written anew; the state (``versions``) then names the new folder of
each of them and the old one of all others, whose files stay as they are.

Each column carries the version its value came from, so updates that arrive in any order, one by one or
together, end in the same row: per column the newest value that is not NULL.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import Versions

BUCKET = "_bucket"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stamp(col: str) -> str:
    return f"_version_of_{col}"


def _stamped(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    cols = [c for c in df.columns if c not in keys and c != version]
    return df.select(*keys, version, *cols, *[F.when(F.col(c).isNotNull(), F.col(version)).alias(_stamp(c)) for c in cols])


def _merged(rows: DataFrame, keys: Sequence[str], version: str, cols: Sequence[str]) -> DataFrame:
    """Per key and column the value of the newest version that has one."""
    aggs = [F.max(version).alias(version)]
    for c in cols:
        aggs += [F.max_by(c, _stamp(c)).alias(c), F.max(_stamp(c)).alias(_stamp(c))]
    return rows.groupBy(*keys).agg(*aggs)


class BucketedTable:
    """``BucketedTable.create(...)`` or ``BucketedTable(spark, path)`` for one that exists."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType | str, key: Sequence[str] | str, version: str, buckets: int = 256) -> BucketedTable:
        """An empty table. ``buckets`` bounds what an update of one key rewrites: choose it so that a bucket is
        a few hundred megabytes; the state grows with it, not with the rows."""
        keys = [key] if isinstance(key, str) else list(key)
        shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        table = cls(spark, path)
        table.versions.commit(0, {"keys": keys, "version": version, "buckets": buckets, "schema": shape.json(), "folders": {}, "applied": {}})
        return table

    def _state(self) -> tuple[int, dict]:
        number, state = self.versions.latest()
        if not number:
            raise ValueError(f"no table at {self.path}")
        return number, state

    def _columns(self, state: dict) -> tuple[T.StructType, list[str]]:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        return schema, [c for c in schema.names if c not in state["keys"] and c != state["version"]]

    def _stored(self, state: dict, buckets: Sequence[int]) -> DataFrame:
        schema, cols = self._columns(state)
        kind = schema[state["version"]].dataType
        full = T.StructType([*schema.fields, *[T.StructField(_stamp(c), kind) for c in cols]])
        folders = [f"{self.path}/{state['folders'][str(b)]}" for b in buckets if str(b) in state["folders"]]
        if not folders:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*folders)

    def read(self) -> DataFrame:
        _, state = self._state()
        schema, _ = self._columns(state)
        return self._stored(state, sorted(map(int, state["folders"]))).select(*schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys (a table that has the key columns); reads only their buckets."""
        _, state = self._state()
        schema, _ = self._columns(state)
        # at most one row for each bucket of the table
        hit = [r[0] for r in keys.select(_bucket(state["keys"], state["buckets"]).alias("b")).distinct().collect()]
        return self._stored(state, sorted(hit)).select(*schema.names).join(keys.select(*state["keys"]).distinct(), state["keys"], "left_semi")

    def upsert(self, updates: DataFrame, source: str | None = None, batch: int | None = None) -> bool:
        """Apply ``updates`` (columns of the table; those absent count as NULL). With ``source`` and ``batch`` a batch
        number that this source has applied before changes nothing: returns whether it was applied."""
        number, state = self._state()
        if source is not None and batch is not None and state["applied"].get(source, -1) >= batch:
            return False
        schema, cols = self._columns(state)
        keys, version = state["keys"], state["version"]
        have = set(updates.columns)
        shaped = updates.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        fresh = _merged(_stamped(shaped, keys, version), keys, version, cols)
        folder = self.versions.new_folder("data")
        draft = f"{folder}-updates"
        # combined once; the merge and the list of buckets read what is written here
        fresh.withColumn(BUCKET, _bucket(keys, state["buckets"])).write.parquet(draft)
        fresh = self.spark.read.parquet(draft)
        hit = sorted(r[0] for r in fresh.select(BUCKET).distinct().collect())
        folders = dict(state["folders"])
        if hit:
            both = self._stored(state, hit).unionByName(fresh.drop(BUCKET))
            new = _merged(both, keys, version, cols).withColumn(BUCKET, _bucket(keys, state["buckets"]))
            # one task a bucket, more where a bucket is large
            new.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
            folders |= {str(b): f"{folder.rsplit('/', 1)[1]}/{BUCKET}={b}" for b in hit}
        applied = dict(state["applied"])
        if source is not None and batch is not None:
            applied[source] = batch
        self.versions.commit(number, state | {"folders": folders, "applied": applied})
        fs, place = self.versions._at(draft)
        fs.delete(place, True)
        return True

    def batch_writer(self, source: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a batch that is repeated after a failure is applied once."""
        return lambda batch, number: self.upsert(batch, source, number) and None

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete bucket folders that the last ``keep`` versions do not use."""
        return self.versions.prune(keep, lambda state: {f"{self.path}/{f}" for f in state["folders"].values()})
