"""Writers. Spark commits files per task, so a lost executor only repeats its own files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, split: str = "split", compression: str = "lz4") -> None:
    """Instruction entries as JSON lines, one folder per split. Names and prompts repeat in every line, so files are compressed (``none``: plain
    text); Spark's readers go by the files' names."""
    df.write.mode("overwrite").partitionBy(split).option("compression", compression).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def write_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a given order over all files, by name. Rows are range partitioned and sorted, never in one task."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A counts frame as JSON; reports are small, so one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_patch_store(bands: DataFrame, path: str, buckets: int = 64) -> None:
    """Packed store, one row per patch, laid out by a hash prefix of the patch id so upserts read what they need."""
    prefix = F.pmod(F.hash("patch_id"), F.lit(buckets)).alias("bucket")
    bands.select("*", prefix).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_files(rows: DataFrame, path: str) -> DataFrame:
    """One file per row of (name string, content binary) below a shared folder, written by the tasks; rows without content give
    none. Returns (path, size_bytes) of the files; nothing is written before that is read.

    A task that is run again writes the same bytes to the same names. Names must differ.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        store.create_dir(folder, recursive=True)
        for batch in batches:
            made = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(data)
                made.append((f"{path.rstrip('/')}/{name}", data.size))
            columns = list(zip(*made)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["path", "size_bytes"])

    there = rows.where(F.col("content").isNotNull()).select(F.col("name").cast("string"), F.col("content").cast("binary"))
    return there.mapInArrow(put, "path string, size_bytes long")
