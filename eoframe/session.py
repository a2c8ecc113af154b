"""Session helpers shared by tests, bench and streaming jobs."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "8", app: str = "eoframe", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own session and its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # a few megabytes would be coalesced into one or two tasks, which leaves most local cores idle
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_GIVEN: list[str] = []


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one only in a local session that names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_dir()
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _GIVEN.append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Deletes the folders that this process was given so far, and returns their number. For long sessions: call it when results
    are written, since frames that are still to be computed read these folders."""
    storage = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    given, _GIVEN[:] = list(_GIVEN), []
    for path in given:
        where = storage.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(given)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a reused intermediate once to the shared folder and read it back, so a lost executor costs one re-read."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
