"""Readers with declared schemas: no inference pass, columns and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eoframe import fixed_values as fv

INSTRUCTION_SCHEMA = (
    "id string, image string, s1_name string, conversations array<struct<from:string,value:string>>, input string, "
    "output string, type string, category string"
)
MANIFEST_SCHEMA = "patch_id string, s1_name string"
HASHED_AT_ONCE = 1 << 22


def read_annotations(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with either conversations or question/answer columns; splittable."""
    return spark.read.schema(INSTRUCTION_SCHEMA).json(path)


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A manifest written as one JSON array. Such a file cannot be split, so it is one task per file; large manifests
    should be JSON lines (``lines``), as ``write_manifest`` makes them."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", str(not lines).lower()).json(path)


def imagery_index(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    """Stem and size of imagery files; the content column is pruned, so nothing is read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("patch_id"), F.col("length").alias("size_bytes")
    )


def raster_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Accepted raster files with size and SHA-256. Files of other types are not opened; an accepted one of any size is read in
    chunks by the task that hashes it."""
    letters = {e.lower().lstrip(".") for e in fv.RASTER_EXTENSIONS}
    names = ",".join(sorted("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in letters))
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{names}}}").option("recursiveFileLookup", "true").load(path)
    )
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    listed = files.select("path", ext.alias("extension"), F.col("length").alias("size_bytes"))
    listed = listed.repartition(spark.sparkContext.defaultParallelism, "path")

    def hash_files(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            digests = []
            for uri in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as stream:
                    while chunk := stream.read(HASHED_AT_ONCE):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "sha256"])

    return listed.mapInArrow(hash_files, "path string, extension string, size_bytes long, sha256 string")
