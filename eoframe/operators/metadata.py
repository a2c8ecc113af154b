"""Image-metadata derivation: sensors, georeference, EPSG codes, band names and the JSON form of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import text

IMAGE_JSON_SCHEMA = (
    "image_id string, source_id string, file_format string, modality string, width string, height string, "
    "band_count string, sensor string, platform string, acquisition_time string, crs string, epsg string, "
    "spatial_resolution_m string, cloud_cover_percentage string, dataset_name string, "
    "bands array<struct<band_index:int,band_id:string,wavelength_nm:double,description:string,dtype:string>>, "
    "spatial_bounds struct<min_x:double,min_y:double,max_x:double,max_y:double,crs:string>, "
    "affine_transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, "
    "metadata_quality map<string,string>, extra_metadata map<string,string>, _bad string"
)
REQUIRED_IMAGE_FIELDS = ["image_id", "source_id", "width", "height", "band_count"]


def infer_sensor(df: DataFrame) -> DataFrame:
    """Modality and sensor guess from band count and pixel size."""
    n, res = F.col("band_count"), F.col("spatial_resolution_m")
    modality = (
        F.when(n == 2, F.lit("sar")).when(n == 3, F.lit("rgb")).when(n >= 4, F.lit("multispectral"))
        .otherwise(F.lit("unknown"))
    )
    sensor = (
        F.when((n == 2) & (res == 10.0), F.lit("Sentinel-1"))
        .when(n == 2, F.lit("SAR (unknown sensor)"))
        .when(n == 12, F.lit("Sentinel-2 (BigEarthNet v2, no B10)"))
        .when(n == 13, F.lit("Sentinel-2 (full L2A)"))
        .when((n == 4) & (res <= 1.0), F.lit("Cartosat-2S (possible)"))
        .when(n == 4, F.lit("Optical 4-band (RGBNIR)"))
        .when(n == 3, F.lit("RGB (sensor unknown)"))
    )
    return df.withColumns({"inferred_modality": modality, "sensor_guess": sensor})


def resolve_modality(df: DataFrame) -> DataFrame:
    """Raster-library rule: a modality tag wins; else 3 or 4 bands without a caller default are optical; else 1 or 2
    bands that mention VV or VH are radar; else the default."""
    c = F.col
    default = F.coalesce("default_modality", F.lit("other"))
    tagged = c("modality_tag").isNotNull()
    polarised = c("band_descriptions").contains("VV") | c("band_descriptions").contains("VH")
    return df.withColumn(
        "resolved_modality",
        F.when(tagged, F.coalesce(text.normalize_modality(c("modality_tag")), default))
        .when(c("band_count").isin(3, 4) & c("default_modality").isNull(), F.lit("optical"))
        .when(c("band_count").isin(1, 2) & F.coalesce(polarised, F.lit(False)), F.lit("sar"))
        .otherwise(default),
    )


def derive_georef(tags: DataFrame) -> DataFrame:
    """Affine, bounds and pixel size from pixel scale and tie point over (width, height, pixel_scale, tiepoint);
    null where either tag is missing or short."""
    def at(col: str, i: int) -> Column:
        return F.get(col, F.lit(i)).cast("double")

    sx, sy = at("pixel_scale", 0), at("pixel_scale", 1)
    ox = at("tiepoint", 3) - at("tiepoint", 0) * sx
    oy = at("tiepoint", 4) + at("tiepoint", 1) * sy
    ok = (F.size("pixel_scale") >= 2) & (F.size("tiepoint") >= 6)
    affine = F.struct(
        sx.alias("a"), F.lit(0.0).alias("b"), ox.alias("c"), F.lit(0.0).alias("d"), (-sy).alias("e"), oy.alias("f")
    )
    bounds = F.struct(
        ox.alias("min_x"), (oy - F.col("height") * sy).alias("min_y"), (ox + F.col("width") * sx).alias("max_x"),
        oy.alias("max_y"),
    )
    return tags.withColumns(
        {
            "affine_transform": F.when(ok, affine), "spatial_bounds": F.when(ok, bounds),
            "spatial_resolution_m": F.when(ok, sx),
        }
    )


def resolve_epsg(tags: DataFrame, col: str = "geokeys") -> DataFrame:
    """EPSG code from a GeoKey directory (header of 4 shorts, then 4 shorts per key): the projected system wins over the
    geographic one; user-defined and externally stored values do not count, the last entry of a key does."""
    keys = F.col(col)
    stated = F.coalesce(F.get(keys, F.lit(3)), F.lit(0))
    whole = F.greatest(F.lit(0), F.floor((F.size(keys) - 4) / 4).cast("int"))
    n = F.least(stated, whole)
    slots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def code(key_id: int) -> Column:
        hits = F.filter(slots, lambda i: F.get(keys, i * 4 + 4) == key_id)
        last = F.try_element_at(hits, F.lit(-1))
        value = F.when(F.get(keys, last * 4 + 5) == 0, F.get(keys, last * 4 + 7))
        return F.when((value > 0) & (value != fv.GEOKEY_USER_DEFINED), value)

    epsg = F.coalesce(code(fv.GEOKEY_PROJECTED), code(fv.GEOKEY_GEOGRAPHIC))
    return tags.withColumns({"epsg": epsg, "crs": F.concat(F.lit("EPSG:"), epsg.cast("string"))})


def infer_band_names(df: DataFrame) -> DataFrame:
    """Band names from descriptions (``descriptions`` array) when each names a known band, else from the count."""
    catalog = F.array(
        *[F.struct(F.lit(b).alias("name"), F.lit(d.upper()).alias("words")) for b, d, _, _ in fv.OPTICAL_BANDS]
    )

    def known(desc: Column) -> Column:
        up = F.upper(text.strip(desc))
        hits = F.filter(catalog, lambda b: up.contains(b["name"]) | up.contains(b["words"]))
        return F.get(hits, F.lit(0))["name"]

    d, n = F.col("descriptions"), F.col("band_count")
    described = F.array_compact(F.transform(d, known))
    usable = (F.size(d) > 0) & ~F.exists(d, lambda x: x.isNull()) & (F.size(described) == n)
    by_count = F
    for count, names in fv.BANDS_BY_COUNT.items():
        by_count = by_count.when(n == count, F.array(*[F.lit(b) for b in names]))
    generic = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("B"), F.lpad(i.cast("string"), 2, "0")))
    return df.withColumn("band_names", F.when(F.coalesce(usable, F.lit(False)), described).otherwise(by_count.otherwise(generic)))


def template_caption(tags: Column, dominant: Column) -> Column:
    listed = F.array_join(F.transform(tags, lambda t: F.lower(t)), ", ")
    return F.concat(
        F.lit("This satellite image shows a landscape characterized by "), listed, F.lit(". The dominant feature is "),
        F.lower(dominant), F.lit("."),
    )


def threshold_labels(probs: Column, t: float = 0.35) -> Column:
    """Classes whose probability reaches the threshold, over array<struct<class, prob>>."""
    return F.transform(F.filter(probs, lambda p: p["prob"] >= t), lambda p: p["class"])


def parse_ontology_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """Typed image columns with defaults from JSON text; broken JSON, a missing required key, an unknown modality or an
    uncastable number give a reject reason instead of failing the job."""
    r = F.from_json(F.col(col), IMAGE_JSON_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    staged = df.withColumn("__r", r)

    def f(name: str) -> Column:
        return F.col("__r")[name]

    modality = text.normalize_modality(F.coalesce(f("modality"), F.lit("other")))
    integers = ["width", "height", "band_count", "epsg"]
    doubles = ["spatial_resolution_m", "cloud_cover_percentage"]
    uncast = F
    for name in integers:
        uncast = uncast.when(f(name).isNotNull() & f(name).try_cast("int").isNull(), F.lit(f"bad {name}"))
    for name in doubles:
        uncast = uncast.when(f(name).isNotNull() & f(name).try_cast("double").isNull(), F.lit(f"bad {name}"))
    missing = F
    for name in REQUIRED_IMAGE_FIELDS:
        missing = missing.when(f(name).isNull(), F.lit(f"missing {name}"))
    reason = (
        F.when(F.col("__r").isNull() | f("_bad").isNotNull(), F.lit("malformed json"))
        .otherwise(F.coalesce(missing.otherwise(F.lit(None)), F.when(modality.isNull(), F.lit("unknown modality")),
                              uncast.otherwise(F.lit(None))))
    )
    empty = F.create_map().cast("map<string,string>")
    return staged.select(
        *df.columns,
        *[f(n).alias(n) for n in ("image_id", "source_id", "sensor", "platform", "acquisition_time", "crs", "dataset_name")],
        F.coalesce(f("file_format"), F.lit("GEOTIFF")).alias("file_format"),
        modality.alias("modality"),
        *[f(n).try_cast("int").alias(n) for n in integers],
        *[f(n).try_cast("double").alias(n) for n in doubles],
        F.coalesce(
            F.transform(f("bands"), lambda b: b.withField("dtype", F.coalesce(b["dtype"], F.lit("uint8")))),
            F.array().cast("array<struct<band_index:int,band_id:string,wavelength_nm:double,description:string,dtype:string>>"),
        ).alias("bands"),
        f("spatial_bounds").alias("spatial_bounds"), f("affine_transform").alias("affine_transform"),
        F.coalesce(f("metadata_quality"), empty).alias("metadata_quality"),
        F.coalesce(f("extra_metadata"), empty).alias("extra_metadata"),
        reason.alias("reject_reason"),
    )


def _nested(columns: str) -> str:
    """Top-level "name type" columns as the fields of a struct."""
    out, depth = [], 0
    for part in columns.split(", "):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def parse_pair_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """Pair records in either key style: primary/secondary with a type, or optical/sar, which is always OPTICAL_SAR. The
    nested images keep every field of an image record, numbers as text."""
    image = f"struct<{_nested(IMAGE_JSON_SCHEMA.removesuffix(', _bad string'))}>"
    schema = (
        f"pair_id string, pair_type string, primary_image {image}, secondary_image {image}, optical_image {image}, "
        f"sar_image {image}, co_registration_status string, spatial_overlap_iou double, temporal_baseline_days double, "
        "_bad string"
    )
    r = F.from_json(F.col(col), schema, {"columnNameOfCorruptRecord": "_bad"})
    staged = df.withColumn("__r", r)
    f = lambda n: F.col("__r")[n]
    new_style = f("primary_image").isNotNull() & f("secondary_image").isNotNull()
    old_style = f("optical_image").isNotNull() & f("sar_image").isNotNull()
    kind = F.upper(text.strip(F.coalesce(f("pair_type"), F.lit("OPTICAL_SAR"))))
    reason = (
        F.when(F.col("__r").isNull() | f("_bad").isNotNull(), F.lit("malformed json"))
        .when(~kind.isin("OPTICAL_SAR", "OPTICAL_TEMPORAL", "SAR_TEMPORAL"), F.lit("unknown pair type"))
        .when(~new_style & ~old_style, F.lit("missing images"))
        .when(F.coalesce(f("pair_id"), F.lit("")) == "", F.lit("missing pair_id"))
    )
    return staged.select(
        *df.columns, f("pair_id").alias("pair_id"),
        F.when(new_style, kind).otherwise(F.lit("OPTICAL_SAR")).alias("pair_type"),
        F.when(new_style, f("primary_image")).otherwise(f("optical_image")).alias("primary"),
        F.when(new_style, f("secondary_image")).otherwise(f("sar_image")).alias("secondary"),
        F.coalesce(f("co_registration_status"), F.lit("unverified")).alias("co_registration_status"),
        f("spatial_overlap_iou").alias("spatial_overlap_iou"),
        F.when(new_style, f("temporal_baseline_days")).alias("temporal_baseline_days"),
        reason.alias("reject_reason"),
    )


def parse_provenance_json(df: DataFrame, col: str = "payload") -> DataFrame:
    schema = (
        "input_hash string, model_name string, task string, timestamp string, run_id string, input_id string, "
        "source_filename string, hash_algorithm string, model_version string, checkpoint string, "
        "processing_stage string, lineage_parent_ids array<string>, execution_parameters map<string,string>, _bad string"
    )
    r = F.from_json(F.col(col), schema, {"columnNameOfCorruptRecord": "_bad"})
    staged = df.withColumn("__r", r)
    f = lambda n: F.col("__r")[n]
    defaults = {
        "run_id": "run-default", "hash_algorithm": "sha256", "model_version": "UNKNOWN", "checkpoint": "UNKNOWN",
        "processing_stage": "INFERENCE",
    }
    missing = F
    for name in ("input_hash", "model_name", "task"):
        missing = missing.when(f(name).isNull(), F.lit(f"missing {name}"))
    return staged.select(
        *df.columns,
        *[f(n).alias(n) for n in ("input_hash", "model_name", "task", "timestamp", "input_id", "source_filename")],
        *[F.coalesce(f(n), F.lit(d)).alias(n) for n, d in defaults.items()],
        F.coalesce(f("lineage_parent_ids"), F.array().cast("array<string>")).alias("lineage_parent_ids"),
        F.coalesce(f("execution_parameters"), F.create_map().cast("map<string,string>")).alias("execution_parameters"),
        F.when(F.col("__r").isNull() | f("_bad").isNotNull(), F.lit("malformed json"))
        .otherwise(missing.otherwise(F.lit(None))).alias("reject_reason"),
    )


def to_ontology_json(images: DataFrame) -> DataFrame:
    """Nested JSON text of each image record, nulls kept."""
    return images.select(
        "image_id", F.to_json(F.struct(*images.columns), {"ignoreNullFields": "false"}).alias("payload")
    )
