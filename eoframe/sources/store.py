"""A patch store in immutable versions: an upsert rewrites only the buckets it touches, and readers stay on theirs.

``data/<id>/bucket=<k>`` holds Parquet files that are never changed. ``commits/<number>`` names, for one version, the folder that
each bucket lives in. A version exists once its commit file has its name, which is one rename; whatever a writer left before that
is not seen by anyone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed this version first; the upsert has changed nothing and can be run again."""


class VersionedStore:
    """Rows by key, one per key, in a fixed number of hash buckets (chosen with the first upsert)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "patch_id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        where = self._fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, storage = self._at("commits")
        if not storage.exists(where):
            return []
        names = [f.getPath().getName() for f in storage.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit())

    def commit_of(self, version: int) -> dict:
        """{"schema", "key", "buckets", "folders": {bucket: folder}} of a version."""
        text = self.spark.read.text(f"{self.path}/commits/{version:010d}", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the latest one if None), of all or of some buckets. A frame stays on its version."""
        version = max(self.versions()) if version is None else version
        commit = self.commit_of(version)
        schema = StructType.fromJson(commit["schema"])
        wanted = commit["folders"] if buckets is None else {k: v for k, v in commit["folders"].items() if int(k) in buckets}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}/bucket={k}" for k, f in wanted.items()])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, merge: dict[str, Column] | None = None) -> int:
        """Adds rows or replaces those of the same key, and returns the new version.

        ``merge`` gives columns as expressions over the aliases ``old`` and ``new`` of the stored and the arriving row (either may be
        absent); without it the arriving row replaces the stored one as a whole. Rows without a key are left out; of arriving rows
        with one key the one with the greatest hash stays. Only touched buckets are read and rewritten.
        """
        number = max(self.versions(), default=-1) + 1
        before = self.commit_of(number - 1) if number else None
        if before:
            self.buckets = before["buckets"]
            rows = rows.select(*[f["name"] for f in before["schema"]["fields"]])
        columns = rows.columns
        whole = F.struct(*columns)
        new = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(whole, F.xxhash64(whole)).alias("__r"))
        new = new.select("__r.*").withColumn("bucket", self.bucket(F.col(self.key)))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if before:
            old = self.read(number - 1, touched)
            if merge is None:
                kept = old.join(new.select(self.key), self.key, "left_anti").select(*columns)
                new = new.unionByName(kept.withColumn("bucket", self.bucket(F.col(self.key))))
            else:
                joined = old.alias("old").join(new.alias("new"), F.col(f"old.{self.key}") == F.col(f"new.{self.key}"), "full")
                key = F.coalesce(f"new.{self.key}", f"old.{self.key}").alias(self.key)
                made = {c: merge.get(c, F.coalesce(f"new.{c}", f"old.{c}")) for c in columns if c != self.key}
                new = joined.select(key, *[c.alias(n) for n, c in made.items()]).select(*columns)
                new = new.withColumn("bucket", self.bucket(F.col(self.key)))
        folder = uuid.uuid4().hex
        new.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        folders = (before["folders"] if before else {}) | {str(b): folder for b in touched}
        schema = before["schema"] if before else rows.schema.jsonValue()
        self.commit(number, {"schema": schema, "key": self.key, "buckets": self.buckets, "folders": folders})
        return number

    def commit(self, number: int, content: dict) -> None:
        """Makes a version visible by renaming its commit file, which fails if the version is there already."""
        draft, storage = self._at(f"drafts/{uuid.uuid4().hex}")
        final, _ = self._at(f"commits/{number:010d}")
        storage.mkdirs(final.getParent())
        out = storage.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if storage.exists(final) or not storage.rename(draft, final):
            storage.delete(draft, False)
            raise Conflict(f"version {number} of {self.path}")

    def vacuum(self, keep: int = 2) -> int:
        """Forgets all but the last versions and deletes folders that none of these use (drafts of writers that died, too, so run
        it while no one writes). Returns the number of folders deleted."""
        versions = self.versions()
        for version in versions[:-keep]:
            where, storage = self._at(f"commits/{version:010d}")
            storage.delete(where, False)
        used = {f for v in versions[-keep:] for f in self.commit_of(v)["folders"].values()}
        where, storage = self._at("data")
        unused = [f.getPath() for f in storage.listStatus(where) if f.getPath().getName() not in used]
        for folder in unused:
            storage.delete(folder, True)
        return len(unused)
