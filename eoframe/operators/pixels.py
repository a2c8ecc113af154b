"""Band-table operators over (patch_id, band, height, width, pixels array<double>).

One row is one band of one patch: size is fixed by the sensor grid, whatever the number of patches. Work inside a band is
a projection; only operators that look at several bands of a patch shuffle, once, by patch_id. Where a patch's bands stand together
(patch_id, bands array<struct<band, height, width, pixels>>), as in a file of all its bands, these are projections too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.config import OpticalConfig
from eoframe.functions import arrays, kernels


def band_catalog(df: DataFrame) -> DataFrame:
    rows = [(i, *b) for i, b in enumerate(fv.OPTICAL_BANDS)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, band string, description string, wavelength_nm int, native_m int"
    )


def select_bands(px: DataFrame, cfg: OpticalConfig | None = None) -> DataFrame:
    """Marks each cataloged band as used or dropped, with the reason."""
    cfg = cfg or OpticalConfig()
    on = {10: cfg.use_10m, 20: cfg.use_20m, 60: cfg.use_60m}
    used = F.col("native_m").isin([m for m, flag in on.items() if flag])
    reason = F.when(~used, F.concat(F.lit("excluded by native resolution "), F.col("native_m").cast("string"), F.lit(" m")))
    catalog = F.broadcast(band_catalog(px).select("band", "ordinal", "native_m"))
    return px.join(catalog, "band").withColumns({"used": used, "drop_reason": reason})


def target_grid(px: DataFrame) -> DataFrame:
    """Grid of the first 10 m band present, else of the largest band."""
    priority = F.array(*[F.lit(b) for b in fv.GRID_PRIORITY])
    rank = F.nullif(F.array_position(priority, F.col("band")), F.lit(0))
    order = F.struct(
        F.coalesce(rank, F.lit(len(fv.GRID_PRIORITY) + 1)), -F.when(rank.isNull(), F.col("height") * F.col("width")).otherwise(0),
        F.col("band"),
    )
    return px.groupBy("patch_id").agg(F.min_by(F.struct("height", "width"), order).alias("g")).select(
        "patch_id", F.col("g.height").alias("target_h"), F.col("g.width").alias("target_w")
    )


def resample_nearest(px: DataFrame, size: int) -> DataFrame:
    return kernels.map_bands(px, lambda bands, stack: kernels.nearest(stack, size, size))


def resample_bilinear(px: DataFrame, size: int) -> DataFrame:
    """Corner-aligned, as two matrix products over all bands of one size."""
    return kernels.map_bands(px, lambda bands, stack: kernels.bilinear(stack, size, size))


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def _lookup(values: dict[str, float]) -> Column:
    return F.try_element_at(_literal_map(values), F.col("band"))


def zscore(px: DataFrame, stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Fixed statistics per known band; an unknown band uses its own mean and population deviation."""
    stats = stats or {**fv.OPTICAL_STATS, **fv.RADAR_STATS}
    return kernels.map_bands(px, lambda bands, stack: kernels.zscore(bands, stack, stats))


def minmax(px: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Scale by the band's own range, or by fixed ranges where given; a constant band becomes 0."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    if ranges:
        low = F.coalesce(_lookup({b: r[0] for b, r in ranges.items()}), low)
        high = F.coalesce(_lookup({b: r[1] for b, r in ranges.items()}), high)
    staged = px.withColumns({"__lo": low, "__hi": high})
    return staged.withColumn("pixels", arrays.minmax(F.col("pixels"), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def clip_db(px: DataFrame, low: float = fv.RADAR_CLIP_DB[0], high: float = fv.RADAR_CLIP_DB[1]) -> DataFrame:
    return px.withColumn("pixels", arrays.clip(F.col("pixels"), low, high))


def to_db(px: DataFrame) -> DataFrame:
    return px.withColumn("pixels", arrays.to_db(F.col("pixels")))


def looks_like_radar(band_count: Column, is_float: Column) -> Column:
    """Two floating-point bands are taken for radar (only this case is pinned)."""
    return (band_count == 2) & is_float


def wide(px: DataFrame, bands: list[str]) -> DataFrame:
    """One row per patch with the named bands as array columns; absent bands are null."""
    if "bands" in px.columns:
        def named(name: str) -> Column:
            return F.get(F.filter("bands", lambda b: (b["band"] == name) & b["pixels"].isNotNull()), F.lit(0))["pixels"].alias(name)

        some = px.filter(F.exists("bands", lambda b: b["band"].isin(bands)))
        return some.select("patch_id", *[named(b) for b in bands])
    return px.filter(F.col("band").isin(bands)).groupBy("patch_id").agg(
        *[F.any_value(F.when(F.col("band") == b, F.col("pixels")), ignoreNulls=True).alias(b) for b in bands]
    )


def spectral_indices(px: DataFrame, names: tuple[str, ...] = ("NDVI", "NDWI")) -> DataFrame:
    """Index rasters as rows (patch_id, index_name, pixels). Bands of another grid are brought to the target grid
    before; an index whose bands are not both there is left out. Denominators near zero give 0."""
    wanted = [(n, a, b) for n, a, b in fv.SPECTRAL_INDICES if n in names]
    bands = sorted({b for _, a, c in wanted for b in (a, c)})
    table = wide(px, bands)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("index_name"), arrays.normalized_difference(F.col(a), F.col(b)).alias("pixels"))
            for n, a, b in wanted
        ]
    )
    out = table.select("patch_id", F.explode(rows).alias("r")).select("patch_id", "r.index_name", "r.pixels")
    return out.filter(F.col("pixels").isNotNull())


def percentile_stretch(
    px: DataFrame, lo: float = 2.0, hi: float = 98.0, scope: str = "band", degenerate: int = 0
) -> DataFrame:
    """0..255 stretch between two percentiles, of each band or over all bands of a patch together (``scope="patch"``,
    for display composites of a few bands)."""
    if scope == "band":
        return kernels.map_bands(px, lambda bands, stack: kernels.stretch(stack, lo, hi, degenerate), integers=True)
    # the bands of one patch are few and of fixed size: collect them, sort once, hand every band the same bounds
    if "bands" in px.columns:
        stacked = px.filter(F.size("bands") > 0).select("patch_id", F.col("bands").alias("b"))
    else:
        stacked = px.groupBy("patch_id").agg(F.collect_list(F.struct("band", "height", "width", "pixels")).alias("b"))
    merged = F.sort_array(F.flatten(F.transform("b", lambda x: x["pixels"])))
    staged = stacked.withColumn("s", merged).withColumns(
        {"lo": arrays.percentile(F.col("s"), lo), "hi": arrays.percentile(F.col("s"), hi)}
    )
    return staged.select("patch_id", "lo", "hi", F.explode("b").alias("b")).select(
        "patch_id", "b.band", "b.height", "b.width",
        arrays.stretch(F.col("b.pixels"), F.col("lo"), F.col("hi"), degenerate).alias("pixels"),
    )


def rgb_composite(px: DataFrame, bands: tuple[str, ...] = ("B04", "B03", "B02")) -> DataFrame:
    """Red, green and blue arrays per patch; patches lacking one of the bands are left out (they cannot be shown)."""
    r, g, b = bands
    table = wide(px, list(bands))
    return table.filter(F.col(r).isNotNull() & F.col(g).isNotNull() & F.col(b).isNotNull()).select(
        "patch_id", F.col(r).alias("red"), F.col(g).alias("green"), F.col(b).alias("blue")
    )


def radar_rgb(px: DataFrame) -> DataFrame:
    """False-colour radar: VV, VH and their ratio, each stretched; a single polarisation fills all three channels."""
    table = wide(px, fv.RADAR_CHANNELS)
    ratio = F.zip_with(
        "VV", "VH", lambda a, b: F.when(F.abs(b) > 1e-8, a / F.nullif(b, F.lit(0.0))).otherwise(F.lit(1.0))
    )
    raw = table.select(
        "patch_id", F.coalesce("VV", "VH").alias("red"), F.coalesce("VH", "VV").alias("green"),
        F.coalesce(ratio, F.col("VV"), F.col("VH")).alias("blue"),
    )
    return raw.select(
        "patch_id", *[arrays.percentile_stretch(F.col(c), eps=1e-8).alias(c) for c in ("red", "green", "blue")]
    )


def pack_bands(px: DataFrame, order: list[str] | None = None, size: int = 120) -> DataFrame:
    """Canonical stack: one array of band arrays per patch, missing bands filled with zeros."""
    order = order or fv.PACKED_BANDS
    zeros = F.array_repeat(F.lit(0.0), size * size)
    table = wide(px, order)
    return table.select("patch_id", F.array(*[F.coalesce(F.col(b), zeros) for b in order]).alias("stack"))


def repair_shape(df: DataFrame, n: int, col: str = "stack", size: int = 120) -> DataFrame:
    """A stack with the wrong number of bands becomes zeros, and is still flagged as real imagery."""
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), size * size), n)
    return df.withColumn(col, F.when(F.size(col) != n, blank).otherwise(F.col(col))).withColumn(
        "has_real_image", F.lit(True)
    )


def preprocessing_audit(px: DataFrame, cfg: OpticalConfig | None = None) -> DataFrame:
    """Bands used and dropped with reasons, per patch; the lists are bounded by the band catalog. What a patch has are bits of one number,
    so a patch is one row before it is shuffled, and is not shuffled at all where its bands stand together."""
    cfg = cfg or OpticalConfig()
    on = {10: cfg.use_10m, 20: cfg.use_20m, 60: cfg.use_60m}
    catalog = [(1 << o, band, on.get(native, False), f"excluded by native resolution {native} m") for o, (band, _, _, native) in enumerate(fv.OPTICAL_BANDS)]

    def bit(band: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for b, name, _, _ in reversed(catalog):
            out = F.when(band == name, F.lit(b).cast("bigint")).otherwise(out)
        return out

    if "bands" in px.columns:
        mask = F.aggregate("bands", F.lit(0).cast("bigint"), lambda found, b: found.bitwiseOR(bit(b["band"])))
        found = px.select("patch_id", mask.alias("found"))
    else:
        found = px.groupBy("patch_id").agg(F.bit_or(bit(F.col("band"))).alias("found"))

    def listed(values: list[tuple[int, str]]) -> Column:
        there = [F.when(F.col("found").bitwiseAND(F.lit(b)) != 0, F.lit(v)) for b, v in values]
        return F.array_compact(F.array(*there)) if there else F.array().cast("array<string>")

    return found.filter(F.col("found") != 0).select(
        "patch_id", listed([(b, n) for b, n, used, _ in catalog if used]).alias("bands_used"),
        listed([(b, n) for b, n, used, _ in catalog if not used]).alias("bands_dropped"),
        listed([(b, f"{n}: {why}") for b, n, used, why in catalog if not used]).alias("drop_reasons"),
    ).withColumns(
        {
            "resample_method": F.lit(cfg.resample_method),
            "target_resolution_m": F.lit(cfg.target_resolution_m),
            "normalization": F.lit(cfg.normalize_method),
            "spectral_indices": F.array(*[F.lit(i) for i in cfg.indices]),
        }
    )


def channel_ranges(px: DataFrame) -> DataFrame:
    """Min, max and mean of each channel without NaN values."""
    clean = F.filter("pixels", lambda v: ~F.isnan(v))
    return px.withColumn("__c", clean).select(
        "patch_id", "band", F.array_min("__c").alias("min_value"), F.array_max("__c").alias("max_value"),
        F.try_divide(arrays.total(F.col("__c")), F.size("__c")).alias("mean_value"),
    )


def pixel_sanity(rgb: DataFrame) -> DataFrame:
    """Near-black, no-contrast and identical-channel flags of (patch_id, red, green, blue)."""
    every = F.concat("red", "green", "blue")
    flat = rgb.withColumns({"__mean": arrays.mean(every), "__std": arrays.std_pop(every)})
    black = F.col("__mean") < 10
    return flat.select(
        "patch_id", F.col("__mean").alias("mean_value"), F.col("__std").alias("std_value"),
        black.alias("near_black"), (~black & (F.col("__std") < 5)).alias("no_contrast"),
        ((F.col("red") == F.col("green")) & (F.col("green") == F.col("blue"))).alias("identical_channels"),
    )


def band_completeness(px: DataFrame, minimum: int = 6) -> DataFrame:
    """Bands present, bands with a non-zero pixel, and whether the patch is accepted and complete."""
    if "bands" in px.columns:
        alive = F.filter("bands", lambda b: F.exists(b["pixels"], lambda v: v != 0))
        counts = px.filter(F.size("bands") > 0).select(
            "patch_id", F.size("bands").cast("bigint").alias("n_bands"), F.size(alive).cast("bigint").alias("n_nonzero"))
    else:
        alive = F.exists("pixels", lambda v: v != 0)
        counts = px.select("patch_id", "band", alive.alias("alive")).groupBy("patch_id").agg(
            F.count(F.lit(1)).alias("n_bands"), F.count_if("alive").alias("n_nonzero")
        )
    return counts.withColumns(
        {
            "accepted": F.col("n_bands") >= minimum,
            "all_nonzero": (F.col("n_bands") == len(fv.PACKED_BANDS)) & (F.col("n_nonzero") == F.col("n_bands")),
        }
    )
