"""Image-metadata validation: every rule yields an error struct or null, so a whole image is checked in one projection.

Input columns: image_id, source_id, file_format, modality, width, height, band_count, sensor, crs, epsg,
spatial_resolution_m, cloud_cover_percentage, bands array<struct<band_index, band_id, wavelength_nm>>,
spatial_bounds struct<min_x, min_y, max_x, max_y>, affine_transform struct<a, b, c, d, e, f>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.config import ValidationConfig
from eoframe.functions import geometry, text

ERROR_TYPE = "struct<code:string,field:string,message:string,actual:string,expected:string,hint:string>"
ERRORS_TYPE = f"array<{ERROR_TYPE}>"


def _error(code: str, field: str, message: Column | str, actual: Column | None, expected: str, hint: str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    actual = F.lit(None) if actual is None else actual
    return F.struct(
        F.lit(code).alias("code"), F.lit(field).alias("field"), message.alias("message"),
        actual.cast("string").alias("actual"), F.lit(expected).alias("expected"), F.lit(hint).alias("hint"),
    ).cast(ERROR_TYPE)


def is_optical(modality: Column) -> Column:
    return modality.isin(fv.OPTICAL_MODALITIES)


def is_sar(modality: Column) -> Column:
    return modality == "sar"


def order_errors(errors: Column, precedence: list[str] | None = None) -> Column:
    """Stable order by the precedence list; codes outside it come last in their original order."""
    ranks = precedence or fv.ERROR_PRECEDENCE
    order = F.array(*[F.lit(c) for c in ranks])
    keyed = F.transform(
        errors,
        lambda e, i: F.struct(
            F.when(F.array_contains(order, e["code"]), F.array_position(order, e["code"]).cast("int"))
            .otherwise(F.lit(len(ranks) + 1)).alias("rank"),
            i.alias("pos"), e.alias("error"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["error"])


# --- single-image rules -----------------------------------------------------------------------------------------------

def constraint_errors() -> Column:
    """Construction constraints of an image record, each violated one by name."""
    def bad(name: str, condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))

    c = F.col
    b, cloud = c("spatial_bounds"), c("cloud_cover_percentage")
    return F.array_compact(
        F.array(
            bad("image_id", F.coalesce(c("image_id"), F.lit("")) == ""),
            bad("source_id", F.coalesce(c("source_id"), F.lit("")) == ""),
            bad("modality", text.normalize_modality(F.coalesce(c("modality"), F.lit(""))).isNull()),
            bad("file_format", F.coalesce(c("file_format"), F.lit("")) == ""),
            bad("width", F.coalesce(c("width"), F.lit(0)) <= 0),
            bad("height", F.coalesce(c("height"), F.lit(0)) <= 0),
            bad("band_count", F.coalesce(c("band_count"), F.lit(0)) <= 0),
            bad("bands", (F.size("bands") > 0) & (F.size("bands") != c("band_count"))),
            bad("spatial_resolution_m", c("spatial_resolution_m") <= 0),
            bad("epsg", c("epsg") <= 0),
            bad("crs", text.strip(c("crs")) == ""),
            bad("cloud_cover_percentage", (cloud < 0) | (cloud > 100)),
            bad("spatial_bounds.min_x", b["min_x"] > b["max_x"]),
            bad("spatial_bounds.min_y", b["min_y"] > b["max_y"]),
            bad("band_index", F.exists("bands", lambda x: x["band_index"] < 1)),
            bad("wavelength_nm", F.exists("bands", lambda x: F.coalesce(x["wavelength_nm"] <= 0, F.lit(False)))),
        )
    )


def format_error(cfg: ValidationConfig, img: Column | None = None) -> Column:
    f = F.upper(_f(img, "file_format"))
    allowed = " / ".join(cfg.allowed_formats)
    benchmark = F.when(
        F.lit(not cfg.allow_benchmark_formats),
        _error("UNSUPPORTED_BENCHMARK_FORMAT", "file_format", F.concat(f, F.lit(" needs the benchmark flag")), f,
               allowed, "allow benchmark formats or supply a TIFF raster"),
    )
    return F.when(f.isin("PNG", "JPEG", "JPG"), benchmark).when(
        ~f.isin(*cfg.allowed_formats),
        _error("INVALID_FORMAT", "file_format", F.concat(F.lit("format not accepted: "), f), f, allowed,
               "convert the raster to TIFF"),
    )


def _no_crs(img: Column | None) -> Column:
    """Neither a reference text nor a code; an empty text and code 0 count as absent."""
    return (F.coalesce(_f(img, "crs"), F.lit("")) == "") & (F.coalesce(_f(img, "epsg"), F.lit(0)) == 0)


def crs_error(cfg: ValidationConfig, img: Column | None = None) -> Column:
    epsg = _f(img, "epsg")
    return F.when(
        F.lit(cfg.require_crs) & _no_crs(img),
        _error("MISSING_CRS", "crs", "no reference system", None, "a reference system or EPSG code",
               "georeference the image or add its EPSG code"),
    ).when(
        F.lit(bool(cfg.supported_epsg)) & (epsg != 0) & ~epsg.isin(*cfg.supported_epsg),
        _error("UNSUPPORTED_CRS", "epsg", F.concat(F.lit("unsupported EPSG code "), epsg.cast("string")), epsg,
               f"one of {len(cfg.supported_epsg)} supported codes", "reproject to EPSG:4326 or a UTM zone"),
    )


def dimension_error(cfg: ValidationConfig, img: Column | None = None) -> Column:
    w, h = _f(img, "width"), _f(img, "height")
    shape = F.concat(w.cast("string"), F.lit("x"), h.cast("string"))
    return F.when(
        (w < cfg.min_side) | (h < cfg.min_side),
        _error("DIMENSION_MISMATCH", "dimensions", F.concat(shape, F.lit(" is too small")), shape,
               f"at least {cfg.min_side}", "use a larger scene"),
    ).when(
        (w > cfg.max_side) | (h > cfg.max_side),
        _error("DIMENSION_MISMATCH", "dimensions", F.concat(shape, F.lit(" is too large")), shape,
               f"at most {cfg.max_side}", "cut the scene into tiles"),
    )


def band_errors(cfg: ValidationConfig, img: Column | None = None) -> list[Column]:
    bands, modality, count = _f(img, "bands"), _f(img, "modality"), _f(img, "band_count")
    wrong_count = F.when(
        (count != cfg.required_band_count) if cfg.required_band_count is not None else F.lit(False),
        _error("INVALID_BAND_CONFIGURATION", "band_count", F.concat(count.cast("string"), F.lit(" bands")), count,
               str(cfg.required_band_count), "supply the expected number of bands"),
    )
    present = F.transform(F.filter(bands, lambda b: b["band_id"].isNotNull()), lambda b: F.upper(b["band_id"]))

    def missing(required: tuple[str, ...]) -> Column:
        wanted = F.array(*[F.lit(b.upper()) for b in required]).cast("array<string>")
        return F.array_except(wanted, present)

    lacking = F.when(is_optical(modality), missing(cfg.required_optical_bands)).when(
        is_sar(modality), missing(cfg.required_sar_bands)
    )
    missing_band = F.when(
        (F.size(bands) > 0) & (F.size(lacking) > 0),
        _error("MISSING_BAND", "bands", F.concat(F.lit("missing "), F.array_join(lacking, ",")),
               F.array_join(F.sort_array(F.array_distinct(present)), ","), "every required band",
               "add the missing channels"),
    )
    return [wrong_count, missing_band]


def resolution_error(cfg: ValidationConfig, img: Column | None = None) -> Column:
    r = _f(img, "spatial_resolution_m")
    lo = F.lit(cfg.min_resolution_m).cast("double")
    hi = F.lit(cfg.max_resolution_m).cast("double")
    return F.when(
        r < lo,
        _error("RESOLUTION_MISMATCH", "spatial_resolution_m", "finer than allowed", r,
               f">={cfg.min_resolution_m}", "check the pixel scale"),
    ).when(
        r > hi,
        _error("RESOLUTION_MISMATCH", "spatial_resolution_m", "coarser than allowed", r,
               f"<={cfg.max_resolution_m}", "use finer imagery"),
    )


def image_warnings(img: Column | None = None) -> Column:
    cloud = _f(img, "cloud_cover_percentage")
    return F.array_compact(
        F.array(
            F.when(cloud > 50.0, F.concat(F.lit("high cloud cover: "), F.format_string("%.1f", cloud))),
            F.when(F.coalesce(_f(img, "sensor"), F.lit("")) == "", F.lit("sensor not specified")),
        )
    )


def _f(img: Column | None, name: str) -> Column:
    return F.col(name) if img is None else img[name]


def image_error_list(cfg: ValidationConfig, img: Column | None = None) -> Column:
    return F.array_compact(
        F.array(
            format_error(cfg, img), crs_error(cfg, img), dimension_error(cfg, img), *band_errors(cfg, img),
            resolution_error(cfg, img),
        )
    )


def _with_verdict(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_valid": F.size("errors") == 0,
            "error_count": F.size("errors"),
            "warning_count": F.size("warnings"),
            "primary_error": F.get(F.col("errors"), F.lit(0))["code"],
        }
    )


def validate_images(images: DataFrame, cfg: ValidationConfig | None = None, strict: bool = False) -> DataFrame:
    """All single-image rules. ``strict`` keeps only the rejected rows, with their first error as the reason."""
    cfg = cfg or ValidationConfig()
    out = _with_verdict(
        images.withColumns({"errors": order_errors(image_error_list(cfg)), "warnings": image_warnings()})
    )
    return out.filter(~F.col("is_valid")) if strict else out


# --- pairs ------------------------------------------------------------------------------------------------------------

def assemble_pairs(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Attach both image structs, put the optical one first in optical/radar pairs, compute overlap, name bad pairs.

    A pair that brings its own spatial_overlap_iou keeps it; temporal_baseline_days and co_registration_status (unverified where
    absent) are carried along.
    """
    given = {"spatial_overlap_iou": "double", "temporal_baseline_days": "double", "co_registration_status": "string"}
    pairs = pairs.withColumns({n: F.lit(None).cast(t) for n, t in given.items() if n not in pairs.columns})
    code, name = text.normalize_crs(F.col("crs"), F.col("epsg"))  # once per image, not per pair
    images = images.withColumns({"crs_code": code, "crs_name": name})
    record = images.select("image_id", F.struct(*images.columns).alias("img"))
    first = record.select(F.col("image_id").alias("first_id"), F.col("img").alias("first"))
    second = record.select(F.col("image_id").alias("second_id"), F.col("img").alias("second"))
    joined = pairs.join(first, "first_id", "left").join(second, "second_id", "left")
    m1, m2 = F.col("first.modality"), F.col("second.modality")
    swap = (F.col("pair_type") == "OPTICAL_SAR") & is_sar(m1) & is_optical(m2)
    ok = (
        F.when(F.col("pair_type") == "OPTICAL_SAR", (is_optical(m1) & is_sar(m2)) | swap)
        .when(F.col("pair_type") == "OPTICAL_TEMPORAL", is_optical(m1) & is_optical(m2))
        .when(F.col("pair_type") == "SAR_TEMPORAL", is_sar(m1) & is_sar(m2))
        .otherwise(F.lit(False))
    )
    out = joined.select(
        "pair_id", "pair_type",
        F.when(swap, F.col("second")).otherwise(F.col("first")).alias("primary"),
        F.when(swap, F.col("first")).otherwise(F.col("second")).alias("secondary"),
        F.when(F.col("first").isNull() | F.col("second").isNull(), F.lit("missing image"))
        .when(~F.coalesce(ok, F.lit(False)), F.lit("modality mismatch"))
        .alias("reject_reason"),
        F.col("spatial_overlap_iou").cast("double").alias("given"), F.col("temporal_baseline_days").cast("double").alias("temporal_baseline_days"),
        F.coalesce("co_registration_status", F.lit("unverified")).alias("co_registration_status"),
    )
    both = F.col("primary.spatial_bounds").isNotNull() & F.col("secondary.spatial_bounds").isNotNull()
    measured = F.when(both, geometry.box_iou(F.col("primary.spatial_bounds"), F.col("secondary.spatial_bounds")))
    return out.withColumn("spatial_overlap_iou", F.coalesce("given", measured)).drop("given")


def crs_compatibility(a: Column, b: Column) -> tuple[Column, Column]:
    """(compatible, reason) of two image structs as ``assemble_pairs`` makes them."""
    e1, n1, e2, n2 = a["crs_code"], a["crs_name"], b["crs_code"], b["crs_name"]
    both_codes, both_names = e1.isNotNull() & e2.isNotNull(), n1.isNotNull() & n2.isNotNull()
    ok = F.when(both_codes, e1 == e2).when(both_names, n1 == n2).otherwise(F.lit(False))
    reason = (
        F.when(ok, F.lit(None).cast("string"))
        .when(both_codes, F.concat(F.lit("EPSG mismatch: "), e1.cast("string"), F.lit(" vs "), e2.cast("string")))
        .when(both_names, F.concat(F.lit("CRS mismatch: '"), n1, F.lit("' vs '"), n2, F.lit("'")))
        .otherwise(F.lit("Missing spatial reference system (CRS/EPSG)"))
    )
    return ok, reason


def pair_error_list(cfg: ValidationConfig, a: Column, b: Column, pair_type: Column) -> Column:
    def modality_error(field: str, actual: Column, expected: str) -> Column:
        return _error("INCOMPATIBLE_MODALITY", field, F.concat(F.lit("unexpected modality "), actual), actual,
                      expected, f"supply {expected} imagery")

    m1, m2 = a["modality"], b["modality"]
    both = F.concat_ws("+", m1, m2)
    modality = [
        F.when((pair_type == "OPTICAL_SAR") & ~is_optical(m1), modality_error("optical_image.modality", m1, "optical")),
        F.when((pair_type == "OPTICAL_SAR") & ~is_sar(m2), modality_error("sar_image.modality", m2, "sar")),
        F.when((pair_type == "OPTICAL_TEMPORAL") & ~(is_optical(m1) & is_optical(m2)),
               modality_error("pair.modality", both, "optical + optical")),
        F.when((pair_type == "SAR_TEMPORAL") & ~(is_sar(m1) & is_sar(m2)),
               modality_error("pair.modality", both, "sar + sar")),
    ]

    ok, reason = crs_compatibility(a, b)
    crs = F.when(
        ~ok & F.lit(cfg.require_crs) & (_no_crs(a) | _no_crs(b)),
        _error("MISSING_CRS", "crs", "a reference system is missing", None, "a reference system on both images",
               "georeference both images"),
    ).when(~ok, _error("UNSUPPORTED_CRS", "crs", reason, None, "equal reference systems", "reproject one image"))

    iou = geometry.box_iou(a["spatial_bounds"], b["spatial_bounds"])
    overlap = F.when(
        a["spatial_bounds"].isNotNull() & b["spatial_bounds"].isNotNull() & (iou < cfg.min_overlap_iou),
        _error("SPATIAL_MISMATCH", "spatial_bounds", "footprints overlap too little", F.round(iou, 4),
               f">={cfg.min_overlap_iou}", "use images of one area"),
    )

    r1, r2 = a["spatial_resolution_m"], b["spatial_resolution_m"]
    difference = F.abs(r1 - r2) / F.nullif(F.greatest(r1, r2), F.lit(0.0))
    resolution = F.when(
        (r1 != 0) & (r2 != 0) & (difference > cfg.max_resolution_difference),
        _error("RESOLUTION_MISMATCH", "spatial_resolution_m", "pixel sizes differ", F.round(difference, 4),
               f"<={cfg.max_resolution_difference}", "resample to one pixel size"),
    )

    t1, t2 = a["affine_transform"], b["affine_transform"]
    pixel = F.nullif(F.abs(t1["a"]), F.lit(0.0))  # the pixel width of image 1 measures both axes

    def off_grid(axis: str) -> Column:
        share = (F.abs(t1[axis] - t2[axis]) % pixel) / pixel
        return (share > cfg.grid_tolerance) & (share < 1.0 - cfg.grid_tolerance)

    grid = F.when(
        F.coalesce(off_grid("c"), F.lit(False)) | F.coalesce(off_grid("f"), F.lit(False)),
        _error("COREGISTRATION_FAILURE", "affine_transform", "pixel grids are misaligned", None,
               f"offset within {cfg.grid_tolerance:.0%}", "align both images to one grid"),
    )
    return F.array_compact(F.array(*modality, crs, overlap, resolution, grid))


def check_pair(pairs: DataFrame, cfg: ValidationConfig | None = None) -> DataFrame:
    """Pair rules alone, over frames with image structs ``primary`` and ``secondary``."""
    errors = pair_error_list(cfg or ValidationConfig(), F.col("primary"), F.col("secondary"), F.col("pair_type"))
    return pairs.withColumn("errors", order_errors(errors))


def validate_pairs(pairs: DataFrame, cfg: ValidationConfig | None = None, strict: bool = False) -> DataFrame:
    """Both images, then the pair; warnings say which image they belong to."""
    cfg = cfg or ValidationConfig()
    a, b = F.col("primary"), F.col("secondary")
    errors = F.concat(
        image_error_list(cfg, a), image_error_list(cfg, b), pair_error_list(cfg, a, b, F.col("pair_type"))
    )
    warnings = F.concat(
        F.transform(image_warnings(a), lambda w: F.concat(F.lit("[Image 1] "), w)),
        F.transform(image_warnings(b), lambda w: F.concat(F.lit("[Image 2] "), w)),
    )
    out = _with_verdict(pairs.withColumns({"errors": order_errors(errors), "warnings": warnings}))
    return out.filter(~F.col("is_valid")) if strict else out


def pair_compatibility(pairs: DataFrame, cross_modal: bool = True) -> DataFrame:
    """The alternative pair rule set: share of the smaller footprint, resolution ratio, one radar image required."""
    a, b = F.col("primary"), F.col("secondary")
    overlap = geometry.smaller_overlap(a["spatial_bounds"], b["spatial_bounds"])
    both = a["spatial_bounds"].isNotNull() & b["spatial_bounds"].isNotNull()
    r1, r2 = a["spatial_resolution_m"], b["spatial_resolution_m"]
    ratio = F.greatest(r1, r2) / F.nullif(F.least(r1, r2), F.lit(0.0))
    ratio = F.when(r1.isNotNull() & r2.isNotNull(), ratio)
    any_sar = is_sar(a["modality"]) | is_sar(b["modality"])
    all_sar = is_sar(a["modality"]) & is_sar(b["modality"])
    crs_differs = (a["crs"] != "") & (b["crs"] != "") & (a["crs"] != b["crs"])
    out = pairs.withColumns(
        {
            "errors": F.array_compact(
                F.array(
                    F.when(both & (overlap < 0.5), F.lit("overlap")),
                    F.when(ratio > 10, F.lit("resolution")),
                    F.when(F.lit(cross_modal) & ~any_sar, F.lit("no radar image")),
                    F.when(F.lit(cross_modal) & all_sar, F.lit("no optical image")),
                )
            ),
            "warnings": F.array_compact(
                F.array(
                    F.when(crs_differs, F.lit("crs")),
                    F.when(both & (overlap >= 0.5) & (overlap < 0.9), F.lit("partial overlap")),
                    F.when((ratio > 2) & (ratio <= 10), F.lit("resolution")),
                )
            ),
        }
    )
    return out.withColumn("compatible", F.size("errors") == 0)


def benchmark_bypass(images: DataFrame) -> DataFrame:
    """PNG/JPEG is accepted only for the named benchmark datasets, and then with a warning."""
    raster = ~F.upper("file_format").isin("PNG", "JPEG", "JPG")
    known = F.coalesce(F.col("dataset_name").isin(fv.BENCHMARK_DATASETS), F.lit(False))
    return images.withColumns(
        {
            "accepted": raster | known,
            "is_benchmark_format": ~raster & known,
            "bypass_warning": F.when(~raster & known, F.concat(F.lit("benchmark source: "), F.col("dataset_name"))),
        }
    )


def check_contract(df: DataFrame, task: str, payload: str = "payload") -> DataFrame:
    """Required fields, numeric score in [0, 1], named model; fusion answers also need all three evidence texts."""
    schema = (
        "answer string, caption string, boxes array<struct<x_min:double,y_min:double,x_max:double,y_max:double>>, "
        "expression string, description string, change_detected boolean, fused_answer string, "
        "modality_attribution struct<optical_evidence:string,sar_evidence:string,fused_reasoning:string>, "
        "confidence struct<score:double>, provenance struct<model_name:string>, _bad string"
    )
    parsed = df.withColumn("__r", F.from_json(F.col(payload), schema, {"columnNameOfCorruptRecord": "_bad"}))
    r = F.col("__r")  # parsed once per row, read by every check
    required = [F.when(r[f].isNull(), F.lit(f"missing {f}")) for f in fv.RESPONSE_CONTRACTS[task]]
    attribution = [
        F.when(r["modality_attribution"].isNotNull() & r["modality_attribution"][f].isNull(), F.lit(f"missing {f}"))
        for f in (fv.FUSION_ATTRIBUTION_FIELDS if task == "fusion" else [])
    ]
    score = r["confidence"]["score"]
    checks = F.array_compact(
        F.array(
            *required, *attribution,
            F.when(r["confidence"].isNotNull() & score.isNull(), F.lit("missing score")),
            F.when((score < 0) | (score > 1), F.lit("score out of range")),
            F.when(r["provenance"].isNotNull() & r["provenance"]["model_name"].isNull(), F.lit("missing model_name")),
        )
    )
    broken = r.isNull() | r["_bad"].isNotNull()
    found = F.when(broken, F.array(F.lit("unreadable"))).otherwise(checks)
    return parsed.withColumn("violations", found).withColumn("conforms", F.size("violations") == 0).drop("__r")


def claim_markers(answer: Column, markers: list[str] | None = None) -> Column:
    """Markers of unsupported claims contained in an answer, in list order."""
    lowered = F.lower(answer)
    return F.array_compact(
        F.array(*[F.when(lowered.contains(m.lower()), F.lit(m)) for m in (markers or fv.CLAIM_MARKERS)])
    )
