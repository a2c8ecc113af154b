"""Starting streams and reading back what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from eoframe.session import ROCKSDB, shared_dir

def needs_rocksdb(spark: SparkSession) -> None:
    """The stateful operators keep their state in RocksDB. A session that names no store gets it; one that names another is
    told, since a running checkpoint cannot change its store."""
    name, default = "spark.sql.streaming.stateStore.providerClass", "HDFSBackedStateStoreProvider"
    now = spark.conf.get(name, default)
    if now.endswith(default):
        spark.conf.set(name, ROCKSDB)
    elif now != ROCKSDB:
        raise ValueError(f"{name} must be {ROCKSDB}")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a file stream, be it one file or a folder of files; its schema is read from the parquet footer.

    A file source reads folders. A table that is one file is found in its folder by its name, a table that is a folder is read as it is.
    """
    path = f"{sf_dir}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    where, storage = _on_storage(spark, path)
    if storage.getFileStatus(where).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_parquet(stream: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Process everything available into a parquet sink (exactly once through its log) and read it.

    ``folder`` holds the checkpoint and the sink. A stream that is started again with its folder goes on where it stopped:
    rows that it wrote are neither lost nor written twice. Without one, the run is a new one in a fresh shared folder.
    """
    spark = stream.sparkSession
    folder = folder or shared_dir(spark, purpose)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start(f"{folder}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _on_storage(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What the batches of a stream wrote below a folder; an empty table where none did."""
    where, storage = _on_storage(spark, path)
    read = spark.read.schema(schema).parquet(path) if storage.exists(where) else spark.createDataFrame([], schema)
    return read.select(*schema.names)


def delete(spark: SparkSession, path: str) -> None:
    where, storage = _on_storage(spark, path)
    storage.delete(where, True)


def run_batches(
    stream: DataFrame, purpose: str, sinks: Callable[[DataFrame], dict[str, DataFrame]], folder: str | None = None
) -> dict[str, DataFrame]:
    """foreachBatch into named parquet folders, resumable as ``run_to_parquet``. Each batch overwrites its own sub-folder, so
    a batch that is repeated after a failure does not add rows twice. A batch is kept while its sinks are written, so it is
    computed once. Names and columns come from an empty batch, so a source without rows gives empty tables."""
    spark = stream.sparkSession
    folder = folder or shared_dir(spark, purpose)
    schemas = {name: df.schema for name, df in sinks(spark.createDataFrame([], stream.schema)).items()}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, df in sinks(batch).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return {name: read_written(spark, f"{folder}/{name}", schema) for name, schema in schemas.items()}
