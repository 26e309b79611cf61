"""What must be written once or counted honestly: trials, the use of the holdout, reports with certificates."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class HoldoutUsed(RuntimeError):
    """The holdout has been looked at before."""


def config_hash(settings: dict) -> str:
    """The same for equal settings, in whatever order they come."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


class Records:
    """Small files in a folder that all users of a configuration share. No file is ever changed.

    ``put_once`` rests on the file system's own exclusive creation (local files, HDFS, stores with conditional puts).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def put_once(self, name: str, body: str) -> bool:
        """Write the file unless it exists; False if another writer came first."""
        path = self._path(f"{self.folder}/{name}")
        self.fs.mkdirs(path.getParent())
        if self.fs.getScheme() == "file":
            try:
                with open(path.toUri().getPath(), "x", encoding="utf-8") as f:
                    f.write(body)
            except FileExistsError:
                return False
            return True
        try:
            out = self.fs.create(path, False)
        except Exception as e:  # the store's own error when the file is there
            if self.fs.exists(path):
                return False
            raise e
        out.write(bytearray(body.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        path = self._path(f"{self.folder}/{name}")
        if not self.fs.exists(path):
            return None
        lines = self.spark.read.text(path.toString(), wholetext=True).collect()
        return lines[0][0] if lines else ""

    def add_trials(self, added: int, settings: dict, note: str = "") -> int:
        """Count configurations that were tried; a file an addition, so that none is lost when two runs add at once."""
        body = {"at": time.time(), "added": added, "config": config_hash(settings), "note": note}
        self.put_once(f"trials/{uuid.uuid4().hex}.json", json.dumps(body))
        return self.trials()

    def trials(self) -> int:
        if not self.fs.exists(self._path(f"{self.folder}/trials")):
            return 0
        return self.spark.read.schema("added long").json(f"{self.folder}/trials").agg(F.coalesce(F.sum("added"), F.lit(0))).first()[0]

    def open_holdout(self, settings: dict) -> None:
        """Mark the holdout as used; raises HoldoutUsed at every use but the first, whatever the configuration."""
        if not self.put_once("holdout.json", json.dumps({"at": time.time(), "config": config_hash(settings)})):
            raise HoldoutUsed("the holdout was evaluated before: a second evaluation is no test")

    def save_report(self, report: dict) -> dict:
        """Store a report under the hash of its bytes; its certificate."""
        body = json.dumps(report, sort_keys=True, default=str)
        name = hashlib.sha256(body.encode()).hexdigest()
        self.put_once(f"reports/{name}.json", body)
        return {"report": name, "config": report.get("config"), "universe": report.get("universe"), "ready": report.get("ready") is True}

    def valid(self, certificate: dict | None) -> bool:
        """Whether the certified report is there, unchanged, of that configuration, and says that every gate passes."""
        body = self.read(f"reports/{certificate['report']}.json") if certificate and certificate.get("report") else None
        if body is None or hashlib.sha256(body.encode()).hexdigest() != certificate["report"]:
            return False
        report = json.loads(body)
        return report.get("config") == certificate["config"] and report.get("ready") is True and certificate["ready"] is True
