"""Raster kernels against plain loops, and the optical pipeline of single patches."""

import numpy as np
import pytest

from eoframe import fixed_values as fv
from eoframe.config import OpticalConfig
from eoframe.functions import kernels
from eoframe.operators import optical
from eoframe.operators import pixels as px

PX = "patch_id string, band string, height int, width int, pixels array<double>"


def plain_bilinear(band, h, w):
    n, m = band.shape
    out = np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            y, x = r * (n - 1) / max(h - 1, 1), c * (m - 1) / max(w - 1, 1)
            r0, c0 = int(y), int(x)
            r1, c1 = min(r0 + 1, n - 1), min(c0 + 1, m - 1)
            top = band[r0, c0] * (1 - (x - c0)) + band[r0, c1] * (x - c0)
            low = band[r1, c0] * (1 - (x - c0)) + band[r1, c1] * (x - c0)
            out[r, c] = top * (1 - (y - r0)) + low * (y - r0)
    return out


@pytest.mark.parametrize("size", [(3, 3, 6, 6), (2, 5, 7, 3), (6, 6, 6, 6), (1, 4, 4, 1), (60, 60, 120, 120)])
def test_bilinear_equals_plain(size):
    n, m, h, w = size
    stack = np.random.default_rng(1).normal(size=(2, n, m))
    np.testing.assert_allclose(kernels.bilinear(stack, h, w), [plain_bilinear(b, h, w) for b in stack], atol=1e-12)


def test_stretch_and_scales_equal_numpy():
    stack = np.random.default_rng(2).normal(size=(3, 9, 11)) * 500
    stack[1] = 7.0
    lo, hi = np.percentile(stack[0], [2, 98])
    want = np.floor((np.clip(stack[0], lo, hi) - lo) / (hi - lo) * 255)
    got = kernels.stretch(stack, 2.0, 98.0, degenerate=128)
    assert np.abs(got[0] - want).max() <= 1 and (got[0] == want).mean() > 0.98 and (got[1] == 128).all()
    z = kernels.zscore(np.array(["B04", "X9", "X9"]), stack, fv.OPTICAL_STATS)
    np.testing.assert_allclose(z[0], (stack[0] - fv.OPTICAL_STATS["B04"][0]) / (fv.OPTICAL_STATS["B04"][1] + 1e-8))
    np.testing.assert_allclose(z[2], (stack[2] - stack[2].mean()) / (stack[2].std() + 1e-8))
    assert (kernels.minmax(stack)[1] == 0).all() and kernels.minmax(stack)[2].max() == 1
    assert kernels.normalized_difference(np.array([1.0, 2.0]), np.array([-1.0, 1.0])).tolist() == [0.0, 1 / 3]


def test_batches_of_mixed_sizes_keep_their_rows(spark):
    rows = [("p", f"b{i}", n, n, [float(i * 100 + k) for k in range(n * n)]) for i, n in enumerate([2, 4, 2, 3, 4, 2])]
    rows += [("p", "torn", 3, 3, [1.0, 2.0]), ("p", "none", 2, 2, None)]
    got = {r.band: r for r in px.resample_nearest(spark.createDataFrame(rows, PX), 4).collect()}
    for _, band, n, _, cells in rows[:6]:
        want = kernels.nearest(np.array(cells).reshape(1, n, n), 4, 4).ravel().tolist()
        assert (got[band].height, got[band].pixels) == (4, want)
    assert got["torn"].pixels is None and got["none"].pixels is None


def patch(spark, sizes, patch_id="p"):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(patch_id, b, n, n, rng.uniform(0, 4000, n * n).tolist()) for b, n in sizes], PX)


NATIVE = [(b, 12 if m == 10 else 6 if m == 20 else 2) for b, _, _, m in fv.OPTICAL_BANDS if b != "B10"]


def test_ten_bands_on_one_grid(spark):
    cfg = OpticalConfig(indices=("NDVI", "NDWI", "NDBI"))
    row = optical.harmonised_stack(patch(spark, NATIVE), cfg).first()
    assert len(row.stack) == 10 and {len(b) for b in row.stack} == {144} and (row.target_h, row.target_w) == (12, 12)
    assert row.bands_used == fv.PACKED_BANDS and row.bands_dropped == ["B01", "B09"] and len(row.drop_reasons) == 2
    assert len(row.rgb) == 3 and min(map(min, row.rgb)) == 0 and max(map(max, row.rgb)) == 255
    assert set(row.indices) == {"NDVI", "NDWI", "NDBI"} and all(abs(v) <= 1 for ix in row.indices.values() for v in ix)
    raw = {r.band: np.array(r.pixels).reshape(r.height, r.width) for r in patch(spark, NATIVE).collect()}
    b11 = plain_bilinear(raw["B11"], 12, 12)
    np.testing.assert_allclose(row.indices["NDBI"], ((b11 - raw["B08"]) / (b11 + raw["B08"])).ravel())
    mean, std = fv.OPTICAL_STATS["B11"]
    np.testing.assert_allclose(row.stack[fv.PACKED_BANDS.index("B11")], ((b11 - mean) / (std + 1e-8)).ravel())


def test_patches_that_cannot_be_shown(spark):
    coarse = patch(spark, [(b, n) for b, n in NATIVE if n != 12], "coarse")
    sixty = patch(spark, [("B01", 2), ("B09", 2)], "sixty")
    odd = patch(spark, [("B04", 12), ("B03", 6), ("B02", 6), ("B99", 5), ("B04", 24)], "odd")
    got = {r.patch_id: r for r in optical.harmonised_stack(coarse.union(sixty).union(odd)).collect()}
    assert got["coarse"].error == "display band B04 is not there" and got["coarse"].target_h == 6 and got["coarse"].stack is None
    assert got["sixty"].error == "no band is selected" and got["sixty"].bands_dropped == ["B01", "B09"]
    assert got["odd"].error is None and got["odd"].bands_used == ["B02", "B03", "B04"] and got["odd"].target_h == 6
    assert optical.harmonised_stack(coarse.limit(0)).count() == 0


def test_settings(spark):
    cfg = OpticalConfig(use_20m=False, use_60m=True, resample_method="nearest", normalize_method="minmax", indices=())
    row = optical.harmonised_stack(patch(spark, NATIVE), cfg).first()
    assert row.bands_used == ["B01", "B02", "B03", "B04", "B08", "B09"] and row.indices == {} and row.resample_method == "nearest"
    assert {min(b) for b in row.stack} == {0.0} and {max(b) for b in row.stack} == {1.0}


def radar(spark, **bands):
    rows = [(p, b, n, n, v) for p, held in bands.items() for b, (n, v) in held.items()]
    return {r.patch_id: r for r in optical.radar_stack(spark.createDataFrame(rows, PX)).collect()}


def test_radar_product(spark):
    rng = np.random.default_rng(5)
    vv, vh = rng.uniform(-40, 10, 64), rng.uniform(-40, -2, 64)
    nan = vv.copy()
    nan[3] = np.nan
    got = radar(spark, both={"VH": (8, vh.tolist()), "VV": (8, vv.tolist())}, one={"VH": (8, vh.tolist())}, linear={"VV": (8, (vv + 50).tolist())},
                odd={"VV": (8, vv.tolist()), "VH": (4, [0.0] * 16)}, other={"X": (8, nan.tolist())}, torn={"VV": (8, [1.0])})
    clipped = {"VV": np.clip(vv, -30, 5), "VH": np.clip(vh, -30, 5)}
    np.testing.assert_allclose(got["both"].stack, [(clipped["VH"] + 35) / 30, (clipped["VV"] + 25) / 30])
    assert got["both"].channels_used == ["VH", "VV"] and got["both"].input_ranges["VV"][:2] == [vv.min(), vv.max()]
    assert got["one"].rgb[0] == got["one"].rgb[1] == got["one"].rgb[2] and got["one"].channels_used == ["VH"]
    np.testing.assert_allclose(got["linear"].stack[0], (np.clip(10 * np.log10(vv + 50), -30, 5) + 25) / 30)
    assert got["odd"].error == "channels differ in size" and got["torn"].error == "no channel" and got["torn"].stack is None
    assert got["other"].channels_used == ["X"] and got["other"].input_ranges["X"][2] == np.nanmean(nan)


def together(df):
    """The bands of a patch in one row."""
    from pyspark.sql import functions as F

    return df.groupBy("patch_id").agg(F.collect_list(F.struct("band", "height", "width", "pixels")).alias("bands"))


def test_patches_whose_bands_stand_together_give_the_same_without_a_shuffle(spark):
    rng = np.random.default_rng(9)
    sizes = {"B02": 6, "B03": 6, "B04": 6, "B08": 6, "B05": 3, "B09": 2}
    rows = [(f"p{k}", b, n, n, rng.normal(size=n * n).tolist()) for k in range(7) for b, n in sizes.items() if (k, b) != (3, "B04")]
    flat = spark.createDataFrame(rows, PX)
    spark.createDataFrame(together(flat).collect(), together(flat).schema).createOrReplaceTempView("px_together")
    nested = spark.table("px_together")
    rgb = flat.filter("band in ('B04', 'B03', 'B02')")
    only = nested.selectExpr("patch_id", "filter(bands, b -> b.band in ('B04', 'B03', 'B02')) as bands")
    for rowwise, patchwise in [
        (px.pack_bands(px.resample_nearest(flat, 6), size=6), px.pack_bands(px.resample_nearest(nested, 6), size=6)),
        (px.rgb_composite(flat), px.rgb_composite(nested)), (px.spectral_indices(flat), px.spectral_indices(nested)),
        (px.percentile_stretch(rgb, scope="patch"), px.percentile_stretch(only, scope="patch")),
        (px.band_completeness(flat), px.band_completeness(nested)),
        (optical.harmonised_stack(flat), optical.harmonised_stack(nested)),
    ]:
        assert "Exchange" not in patchwise._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, patchwise.collect())) == sorted(map(str, rowwise.collect()))
