"""Stages kept as tables in the folder that driver and executors share.

A stage is named by a fingerprint of what it is made of: its name, its settings, and its inputs, each of them another stage or
the files under a table (their names, sizes and times). Each attempt writes a folder of its own under the stage's name and counts once Spark has
marked it as whole, so a run that dies leaves nothing half-read, two runs at once do no harm, and all readers take the first whole
attempt by name. A later run with the same inputs and settings reads what is there; a lost executor costs a reread.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session may leave it unset and gets a new folder, a cluster may not."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def kept_at(df: DataFrame, name: str) -> str:
    """Where df was written as a table of this run alone."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table of this run alone: its lineage ends here."""
    return df.sparkSession.read.schema(df.schema).parquet(kept_at(df, name))


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """Name, size and time of the files that df reads, in order."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        fs, path = _path(spark, name)
        status = fs.getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


class Store:
    """Stages under a folder; made, reused: how many were made in this run and how many were there."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/stages"
        self.made, self.reused, self._prints = 0, 0, {}

    def _print_of(self, df: DataFrame) -> list | str:
        """A stage of this store by its fingerprint, any other frame by its plan and files."""
        known = self._prints.get(id(df))
        if known is not None:
            return known[1]
        # every field of the plan, as a shortened text would let two plans look alike
        key = "spark.sql.debug.maxToStringFields"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "2147483647")
        try:
            text = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        finally:
            self.spark.conf.set(key, before)
        plan = hashlib.sha256(text.encode()).hexdigest()
        return [plan, files_of(df)]

    def stage(self, name: str, make: Callable[..., DataFrame], *inputs: DataFrame, **settings) -> DataFrame:
        """make(*inputs, **settings) as a table, made now or by an earlier run. Settings are plain values."""
        what = json.dumps([name, settings, [self._print_of(x) for x in inputs]], sort_keys=True, default=repr)
        print_ = hashlib.sha256(what.encode()).hexdigest()[:32]
        top = f"{self.folder}/{name}-{print_}"
        path = self._whole(top)
        if path is None:
            df, attempt = make(*inputs, **settings), uuid.uuid4().hex
            df.write.parquet(f"{top}/{attempt}")
            path = self._whole(top)
            self.made += 1
        else:
            self.reused += 1
        df = self.spark.read.parquet(path)
        self._prints[id(df)] = (df, print_)  # the frame is held, so its id stays its own
        return df

    def _whole(self, top: str) -> str | None:
        """The first whole attempt under a stage's folder."""
        fs, path = _path(self.spark, top)
        if not fs.exists(path):
            return None
        attempts = sorted(x.getPath().toString() for x in fs.listStatus(path))
        return next((a for a in attempts if fs.exists(_path(self.spark, f"{a}/_SUCCESS")[1])), None)
