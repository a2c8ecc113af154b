"""Provenance records with ids derived from content, so a rerun yields the same records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_hash(cols: list[str]) -> Column:
    """SHA-256 of the compact JSON object with sorted keys; nulls are kept as null."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def verify_hash(catalog: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare cataloged hashes with expected ones; a file that is missing or could not be hashed is not verified."""
    joined = expected.join(catalog.select("path", "sha256"), "path", "left")
    wanted = F.lower(F.regexp_replace("expected_hash", r"^\s+|\s+$", ""))
    return joined.withColumn("verified", F.coalesce(F.lower("sha256") == wanted, F.lit(False)))


#: Facts of a run that a table may lack: name, type, what stands for an absent value.
RUN_FACTS = {
    "file_format": ("string", "GEOTIFF"), "modality": ("string", "unknown"), "sensor": ("string", None),
    "model_version": ("string", "UNKNOWN"), "checkpoint": ("string", "UNKNOWN"), "model_provider": ("string", None),
    "stage": ("string", "INFERENCE"), "timestamp": ("string", None), "output_id": ("string", None),
}


def _fact(columns: list[str], name: str) -> Column:
    kind, default = RUN_FACTS[name]
    absent = F.lit(default).cast(kind)
    return F.coalesce(F.col(name).cast(kind), absent) if name in columns else absent


def _listed(columns: list[str], name: str, kind: str, empty: Column) -> Column:
    return F.coalesce(F.col(name), empty).cast(kind) if name in columns else empty.cast(kind)


def provenance_records(df: DataFrame, run_id: str) -> DataFrame:
    """Full records for a batch over (image_id, source_id, sha256, model_name, task) and, where the table has them, the columns of
    ``RUN_FACTS``, execution_parameters (map of strings) and lineage_parent_ids (array of strings).

    A file without a hash is referred to by name. Time is the caller's column, since a rerun must give the same record; so is an
    output id, or it is made from the content.
    """
    c, has = F.col, df.columns
    base = df.select(
        F.coalesce("sha256", F.concat(F.lit("unhashed-ref-"), c("source_id"))).alias("input_hash"),
        F.lit("sha256").alias("hash_algorithm"),
        c("image_id").alias("input_id"), c("source_id").alias("source_filename"),
        *[_fact(has, n).alias(n) for n in ("file_format", "modality", "sensor")], "model_name",
        *[_fact(has, n).alias(n) for n in ("model_version", "checkpoint", "model_provider")],
        "task", _fact(has, "timestamp").alias("timestamp"), F.lit(run_id).alias("run_id"),
        _fact(has, "stage").alias("processing_stage"),
        _listed(has, "execution_parameters", "map<string,string>", F.create_map()).alias("execution_parameters"),
        _fact(has, "output_id").alias("output_id"),
        _listed(has, "lineage_parent_ids", "array<string>", F.array()).alias("lineage_parent_ids"),
    )
    key = F.concat_ws("|", "run_id", "input_hash", "model_name", "task", "processing_stage")
    made = F.concat(F.lit("out-"), F.substring(F.sha2(key, 256), 1, 8))
    return base.withColumn("output_id", F.coalesce("output_id", made))


def paired_provenance(pairs: DataFrame, run_id: str, method: str = "CROSS_MODAL_FUSION") -> DataFrame:
    """Optical and radar lineage of image pairs in one pass: both images already sit in the pair row.

    Each side is a full record; versions, checkpoints and the time are taken from the columns optical_version, sar_version,
    optical_checkpoint, sar_checkpoint and timestamp where the table has them.
    """
    has = pairs.columns

    def column(name: str, default: str | None) -> Column:
        absent = F.lit(default).cast("string")
        return F.coalesce(F.col(name).cast("string"), absent) if name in has else absent

    time = column("timestamp", None)

    def side(img: str, who: str, model: str) -> Column:
        i = F.col(img)
        held = pairs.schema[img].dataType.names
        task = F.concat(F.col("task"), F.lit(f"_{who}"))
        ref = F.coalesce(i["sha256"], F.concat(F.lit("unhashed-ref-"), i["source_id"]))
        key = F.concat_ws("|", F.lit(run_id), ref, F.col(model), task, F.lit("INFERENCE"))
        return F.struct(
            ref.alias("input_hash"), F.lit("sha256").alias("hash_algorithm"), i["image_id"].alias("input_id"),
            i["source_id"].alias("source_filename"),
            *[(F.coalesce(i[n], F.lit(RUN_FACTS[n][1])) if n in held else F.lit(RUN_FACTS[n][1]).cast("string")).alias(n)
              for n in ("file_format", "modality", "sensor")],
            F.col(model).alias("model_name"), column(f"{who}_version", "UNKNOWN").alias("model_version"),
            column(f"{who}_checkpoint", "UNKNOWN").alias("checkpoint"), task.alias("task"), time.alias("timestamp"),
            F.lit(run_id).alias("run_id"), F.lit("INFERENCE").alias("processing_stage"),
            F.concat(F.lit("out-"), F.substring(F.sha2(key, 256), 1, 8)).alias("output_id"),
        )

    return pairs.select(
        "pair_id", side("primary", "optical", "optical_model").alias("optical_provenance"),
        side("secondary", "sar", "sar_model").alias("sar_provenance"), "task", time.alias("timestamp"),
        F.lit(run_id).alias("run_id"), F.lit(method).alias("fusion_method"),
    )
