"""Sinks and sources against each other: a given table is written to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.operators import annotations as an
from eoframe.plans.catalog import HUMAN, TEMPLATES
from eoframe.plans.registry import query
from eoframe.session import shared_dir
from eoframe.sources import readers, writers
from eoframe.sources.adapters import Tables, oracle


@query(oracle(f"""select a.type || '_' || patch_id || '_' || ann_id as id, patch_id as image, split, {HUMAN} as human, output as gpt
    from ann a join {TEMPLATES} on a.type = tpl.type where split is not null""", "ann"))
def instruction_files(t: Tables) -> DataFrame:
    """Instruction entries as JSON lines, one folder per split, read with the declared schema."""
    path = shared_dir(t.spark, "instructions")
    entries = an.format_instructions(t.ann.filter(F.col("split").isNotNull()), keep=("split",))
    writers.write_jsonl(entries, path)
    back = readers.read_instructions(t.spark, path)
    split = F.regexp_extract(F.input_file_name(), r"split=([^/]*)", 1).alias("split")
    return back.select("id", "image", split, F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"))


@query(oracle("select image as patch_id, arg_max(s1_name, id) as s1_name from entries group by image", "entries"))
def manifest_files(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "manifest")
    writers.write_manifest(an.build_manifest(t.entries, "id"), path)
    return readers.read_manifest(t.spark, path, lines=True)


@query(oracle("select type, count(*) as n from ann where type is not null group by type", "ann"))
def report_files(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "report")
    counts = t.ann.filter(F.col("type").isNotNull()).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    writers.write_report(counts, path)
    return t.spark.read.schema("type string, n long").json(path)


@query("select vec_id, embedding::double[] as embedding, label from embeddings")
def patch_store_files(t: Tables) -> DataFrame:
    """The array column of a given table through the packed store, laid out by a hash prefix of its key."""
    path = shared_dir(t.spark, "store")
    rows = t.base("embeddings").select(F.col("vec_id").cast("string").alias("patch_id"), "embedding", "label")
    writers.write_patch_store(rows, path, 8)
    back = t.spark.read.parquet(path)
    return back.select(F.col("patch_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
