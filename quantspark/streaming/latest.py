"""The latest row of every key beside the history, published in versions: a batch rewrites the buckets that it touches, and readers see whole versions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import Records

BUCKETS = 64


class LatestView:
    """Rows by ``key``, the last by ``time`` and then ``id``. A version is a manifest that says where each bucket of keys lies.

    ``update`` reads and writes only the buckets of the batch's keys, and publishes by creating the manifest, which is exclusive.
    A batch that is replayed after its manifest was made changes nothing; one that failed before is made anew.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "ticker", time: str = "ts", id: str = "event_id", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.time, self.id, self.buckets = spark, path.rstrip("/"), key, time, id, buckets
        self.records = Records(spark, self.path)

    def versions(self) -> list[int]:
        fs, folder = self.records.fs, self.records._path(f"{self.path}/manifests")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(folder)) if fs.exists(folder) else []

    def _manifest(self, version: int) -> dict:
        return json.loads(self.records.read(f"manifests/{version:012d}.json"))

    def _rows(self, places: dict[str, int], schema: str) -> DataFrame:
        paths = [f"{self.path}/versions/{v}/key_bucket={b}" for b, v in places.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(self.time, self.id)).alias("r")).select("r.*")

    def update(self, batch: DataFrame, version: int) -> bool:
        """Take the batch in under its number; False if that number or a later one is published. Numbers of batches ascend."""
        known = self.versions()
        if known and known[-1] >= version:
            return False
        batch = batch.where(F.col(self.key).isNotNull())
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        batch.write.mode("overwrite").parquet(f"{self.path}/history/batch={version}")
        batch = self.spark.read.schema(batch.schema).parquet(f"{self.path}/history/batch={version}")
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())
        before = self._manifest(known[-1]) if known else {"places": {}}
        places, schema = before["places"], before.get("schema") or batch._jdf.schema().toDDL()
        old = self._rows({str(b): places[str(b)] for b in touched if str(b) in places}, schema)
        rows = self._last(old.unionByName(batch)) if known else self._last(batch)
        rows.withColumn("key_bucket", bucket).repartition("key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(f"{self.path}/versions/{version}")
        body = {"schema": schema, "places": places | {str(b): version for b in touched}}
        return self.records.put_once(f"manifests/{version:012d}.json", json.dumps(body))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, by default the last; None before the first."""
        known = self.versions()
        if not known:
            return None
        body = self._manifest(known[-1] if version is None else version)
        return self._rows(body["places"], body["schema"])

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/history").drop("batch")

    def follow(self, alerts: DataFrame, checkpoint: str):
        """A stream of alerts kept up to date; the writer, to be started with a trigger of the caller's."""
        return alerts.writeStream.foreachBatch(lambda df, n: self.update(df, n)).option("checkpointLocation", checkpoint)
