"""Session settings for local runs, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()


def local_session(name: str, cpus: int | None = None) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local one only where it is unset."""
    with _LOCK:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            master = spark.conf.get("spark.master", "")
            if not master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
            spark.conf.set("spark.checkpoint.dir", folder)
        return folder


def stage(df: DataFrame) -> DataFrame:
    """Writes a reused intermediate table to the shared folder and reads it back.

    Later readers prune columns and see real sizes, the plan stays short, and a lost
    executor costs a re-read instead of a recomputation.  Commit and shingle hashes make most of
    the bytes, which only an entropy coder makes smaller.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class once:
    """A property that is built once for an object, also when several threads ask for it."""

    def __init__(self, build: Callable):
        self.build, self.__doc__ = build, build.__doc__

    def __set_name__(self, owner, name: str):
        self.name = name

    def __get__(self, obj, owner=None):
        if obj is None:
            return self
        locks = obj.__dict__.setdefault("_locks", {})
        with locks.setdefault(self.name, threading.RLock()):
            if self.name not in obj.__dict__:
                obj.__dict__[self.name] = self.build(obj)
        return obj.__dict__[self.name]


def side_by_side(spark: SparkSession, *builds: Callable) -> list:
    """Results of callables that run at the same time, so that planning and small jobs of one fill the gaps of another."""
    with ThreadPoolExecutor(len(builds)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(build)) for build in builds]]
