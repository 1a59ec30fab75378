"""Tables written to the folder that driver and executors share, and versioned snapshots."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs in one process (tests), a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Stored:
    """A table written to the shared folder: it cuts lineage and survives lost executors."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        drop_path(self.df.sparkSession, self.path)


def store(df: DataFrame, name: str, **options: str) -> Stored:
    """``options`` are those of the Parquet writer."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a mark."""
    p, fs = _fs(spark, path)
    fs.create(p, True).close()


class Snapshots:
    """A table kept as numbered snapshots under one folder (K1-K3). A new version is written beside the one that is
    read; its number counts once Spark's commit marker is there, so a failed write leaves the last one in force."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        whole = [n for n in names_in(self.spark, self.path) if n.startswith("v") and n[1:].isdigit() and exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return sorted(int(n[1:]) for n in whole)

    def read(self, schema: str) -> DataFrame:
        """The latest version; an empty table if there is none."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{versions[-1]}")

    def write(self, df: DataFrame, *, keep: int = 2) -> int:
        versions = self._versions()
        number = (versions[-1] if versions else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        for old in versions[: max(0, len(versions) + 1 - keep)]:
            drop_path(self.spark, f"{self.path}/v{old}")
        return number
