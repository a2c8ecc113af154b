"""Hand-derived values, one group per rule that a re-implementation could silently get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from eoframe.config import ConfidenceConfig, ValidationConfig
from eoframe.functions import geometry, text
from eoframe.operators import annotations as an
from eoframe.operators import metadata as md
from eoframe.operators import pairs as tp
from eoframe.operators import pixels as px
from eoframe.operators import query_log as ql
from eoframe.operators import radar
from eoframe.operators import reconcile as rc
from eoframe.operators import validation as va


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lit(v, kind="string"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize("raw, want", [
    ("[-10 20, 30 40]", [10.0, 20.0, 30.0, 40.0]), ("1.2.3 4 5 6", []), ("(1, 2, 3, 4, 5)", [1.0, 2.0, 3.0, 4.0]), ("none", []),
])
def test_bbox_text(spark, raw, want):
    assert one(spark, text.parse_bbox(F.lit(raw)).alias("b"))["b"] == want


@pytest.mark.parametrize("crs, epsg, want", [
    ("EPSG:900913", None, (900913, "EPSG:900913")), ("WGS 84 / UTM zone 43N", None, (32643, "EPSG:32643")),
    ("UTM 61N", None, (None, "UTM 61N")), ("utm zone 5 s", None, (32705, "EPSG:32705")), (" ", None, (None, None)),
    ("Web Mercator", 0, (3857, "EPSG:3857")), ("anything", 4326, (4326, "EPSG:4326")), ("EPSG:", None, (None, "EPSG:")),
])
def test_crs(spark, crs, epsg, want):
    code, name = text.normalize_crs(lit(crs), lit(epsg, "int"))
    assert tuple(one(spark, code, name)) == want


@pytest.mark.parametrize("raw, want", [("GTIF", "TIFF"), ("GEO_TIFF", "GEOTIFF"), ("tif", "TIFF"), ("jpg", "OTHER"), ("png", "PNG")])
def test_format(spark, raw, want):
    assert one(spark, text.normalize_format(F.lit(raw)).alias("f"))["f"] == want


def test_substring_rules_match_inside_words(spark):
    asked = spark.createDataFrame([("Is it necessary?", "single", None), ("combine them", "single", None)], "query string, input_scope string, task_hint string")
    found = {r["query"]: r for r in ql.classify_queries(asked).collect()}
    sar, combine = found["Is it necessary?"], found["combine them"]
    assert (sar["task"], sar["reject_reason"]) == ("fusion", None)  # "sar" in "necessary"; the shortcut skips the scope check
    assert combine["reject_reason"] is not None  # keyword hits do check the scope
    assert one(spark, text.normalize_yes_no(F.lit("unknown")).alias("a"))["a"] == "no"
    assert one(spark, radar.classify_sar(F.array(F.lit("Which season"))).alias("c"))["c"] == ["water"]
    assert one(spark, text.audit_type(F.lit("answer with a word, not a number")).alias("t"))["t"] == "binary_yn"


def test_empty_label_sets_are_unchanged_with_similarity_zero(spark):
    e = F.array().cast("array<string>")
    c = one(spark, tp.label_change(e, e).alias("c"))["c"]
    assert (c["change_type"], c["jaccard_similarity"], c["change_label"]) == ("no_change", 0.0, 0)


def test_label_change_reversal_swaps_gain_and_loss(spark):
    a, b = F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))
    r = one(spark, tp.label_change(a, b).alias("f"), tp.label_change(b, a).alias("r"))
    assert (r["f"]["change_type"], r["r"]["change_type"]) == ("land_cover_gain", "land_cover_loss")
    assert r["f"]["labels_added"] == r["r"]["labels_removed"] == ["y"]


BOX = "struct<min_x:double,min_y:double,max_x:double,max_y:double,label:string,confidence:double>"


def box(x0, y0, x1, y1, label="a", conf=0.5):
    return F.struct(*[F.lit(v) for v in (x0, y0, x1, y1, label, conf)]).cast(BOX)


def boxes(*items):
    return F.array(*items).cast(f"array<{BOX}>")


def test_iou_touching_and_symmetric(spark):
    a, b, c = box(0.0, 0.0, 1.0, 1.0), box(1.0, 0.0, 2.0, 1.0), box(0.5, 0.0, 1.5, 1.0)
    r = one(spark, geometry.box_iou(a, b).alias("t"), geometry.box_iou(a, c).alias("f"), geometry.box_iou(c, a).alias("r"))
    assert r["t"] == 0.0 and r["f"] == r["r"] == pytest.approx(1 / 3)


def test_greedy_matching_serves_in_order(spark):
    a = boxes(box(0.0, 0.0, 1.0, 1.0), box(0.0, 0.0, 1.0, 1.0, "b"))
    b = boxes(box(0.0, 0.0, 1.0, 1.0, "A"), box(0.0, 0.0, 1.0, 0.5))
    m = one(spark, geometry.match_boxes(a, b).alias("m"))["m"]
    assert (m["status"], m["matched_count"], m["mean_iou"], m["labels_matched"]) == ("MATCHED", 2, 0.75, 1)
    assert one(spark, geometry.match_boxes(boxes(), boxes()).alias("m"))["m"]["status"] == "EMPTY_MATCH"
    lone = one(spark, geometry.match_boxes(a, boxes()).alias("m"))["m"]
    assert (lone["status"], lone["unmatched_a_count"], lone["unmatched_b_count"]) == ("DISJOINT", 2, 0)


def test_box_quality_pins(spark):
    def b(*v):
        return box(*[float(x) for x in v])

    q = one(spark, geometry.box_quality(boxes(b(100, 100, 500, 500), b(200, 300, 400, 600))).alias("q"))["q"]
    assert (q["is_valid"], q["quality"], q["n_issues"]) == (True, 1.0, 0)
    q = one(spark, geometry.box_quality(boxes(b(500, 500, 100, 100), b(-10, 20, 30, 40), b(0, 0, 1200, 500))).alias("q"))["q"]
    assert (q["is_valid"], q["quality"], q["n_issues"]) == (False, 0.0, 3)


def test_box_issue_nan(spark):
    issues = one(spark, geometry.box_issues(box(0.1, 0.1, 0.5, 0.5, "", float("nan"))).alias("i"))["i"]
    assert issues == ["confidence out of range", "confidence is NaN", "label is empty"]


def outputs(spark, preds, spatial=None):
    rows = [("r", i, f"m{i}", p, "text", 0.5) for i, p in enumerate(preds)]
    df = spark.createDataFrame(rows, "request_id string, position int, model_name string, prediction string, pred_kind string, confidence double")
    col = F.lit(None).cast(f"array<{BOX}>")
    for i, b in enumerate(spatial or []):
        col = F.when(F.col("position") == i, b).otherwise(col)
    return df.withColumn("boxes", col)


@pytest.mark.parametrize("preds, want", [
    (["Yes"], "AGREEMENT"), ([" yes", "YES"], "AGREEMENT"), (["dense forest", "forest; water"], "PARTIAL_AGREEMENT"),
    (["forest", "water"], "DISAGREEMENT"), (["forest", "forest a", "forest b"], "DISAGREEMENT"), (["", " "], "AGREEMENT"),
])
def test_disagreement(spark, preds, want):
    assert rc.detect_disagreement(outputs(spark, preds)).first()["status"] == want


def test_disjoint_boxes_do_not_lower_agreement(spark):
    some, far = boxes(box(0.0, 0.0, 1.0, 1.0)), boxes(box(5.0, 5.0, 6.0, 6.0))
    assert rc.detect_disagreement(outputs(spark, ["a", "a"], [some, boxes()])).first()["status"] == "AGREEMENT"
    assert rc.detect_disagreement(outputs(spark, ["a", "a"], [some, far])).first()["status"] == "PARTIAL_AGREEMENT"


def confidence(spark, **given):
    kinds = {n: "double" for n in ("optical_confidence", "sar_confidence", "model_confidence", "agreement_score", "cloud_cover_percentage", "alignment_iou")}
    kinds |= {"is_complete": "boolean", "has_georeference": "boolean", "disagreement_detected": "boolean", "severity": "string"}
    base = {"disagreement_detected": False, "severity": "NONE"} | given
    row = spark.range(1).select(*[lit(base.get(n), k).alias(n) for n, k in kinds.items()])
    return rc.aggregate_confidence(row).first()


def test_confidence_traps(spark):
    assert confidence(spark, model_confidence=math.nan)["model_term"] == 0.0
    plain, flagged = confidence(spark, model_confidence=0.8), confidence(spark, model_confidence=0.8, disagreement_detected=True)
    assert plain["final_confidence"] - flagged["final_confidence"] == pytest.approx(0.20)
    partial = confidence(spark, model_confidence=0.8, disagreement_detected=True, severity="partial")
    assert plain["final_confidence"] - partial["final_confidence"] == pytest.approx(0.08)
    assert confidence(spark, optical_confidence=0.9, sar_confidence=0.7)["agreement_term"] is None
    assert confidence(spark)["model_term"] == 0.5
    assert confidence(spark, sar_confidence=1.0, cloud_cover_percentage=100.0)["quality_term"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        ConfidenceConfig(paired_model=0.9)


def test_supported_codes():
    codes = set(ValidationConfig().supported_epsg)
    assert {4326, 3857, 32601, 32660, 32710, 32732, 32740, 32743} <= codes and not {32661, 32711, 32741} & codes


def test_unlisted_error_codes_come_last_in_their_order(spark):
    def err(code):
        return F.struct(*[F.lit(code) for _ in range(6)]).cast(va.ERROR_TYPE)

    got = one(spark, va.order_errors(F.array(err("FILE_SIZE_LIMIT_EXCEEDED"), err("MISSING_CRS"), err("INVALID_FORMAT"))).alias("e"))["e"]
    assert [e["code"] for e in got] == ["INVALID_FORMAT", "MISSING_CRS", "FILE_SIZE_LIMIT_EXCEEDED"]


def test_prompts_and_chat(spark):
    row = spark.createDataFrame([("1", "p", "s", None, "ok", "binary"), ("2", "p", "s", "x", "t", "captioning"), ("3", "p", "s", "x", "t", "odd")],
                                "ann_id string, patch_id string, s1_name string, input string, output string, type string")
    got = {r["id"]: r["conversations"] for r in an.format_instructions(row).collect()}
    assert set(got) == {"binary_p_1", "captioning_p_2"} and "Question: None" in got["binary_p_1"][0]["value"]
    three = spark.sql("select array(named_struct('from','human','value','a'), named_struct('from','gpt','value','b'), named_struct('from','gpt','value','c')) as conversations")
    assert an.render_chat(three).first()["reject_reason"] == "expected 2 turns, got 3"


def test_patch_id_without_enough_parts(spark):
    r = tp.parse_patch_id(spark.createDataFrame([("odd_id",), ("S2A_x_20179999T000000_N_R_T1_2_3",)], "patch_id string")).collect()
    assert (r[0]["date_str"], r[0]["tile"], r[0]["pixel_x"], r[0]["location_key"]) == ("unknown", "unknown", "0", "odd_id")
    assert r[1]["date_str"] == "20179999" and r[1]["date"] is None and r[1]["location_key"] == "T1_2_3"


def test_flat_band_stretch_and_unknown_band(spark):
    df = spark.createDataFrame([("p", "Q1", 1, 2, [3.0, 3.0]), ("p", "Q2", 1, 2, [1.0, 3.0])], "patch_id string, band string, height int, width int, pixels array<double>")
    flat = {r["band"]: r["pixels"] for r in px.percentile_stretch(df, degenerate=128).collect()}
    assert flat["Q1"] == [128, 128]
    z = {r["band"]: r["pixels"] for r in px.zscore(df).collect()}
    assert z["Q1"] == [0.0, 0.0] and z["Q2"] == pytest.approx([-1.0, 1.0])
    assert one(spark, px.looks_like_radar(F.lit(2), F.lit(True)).alias("r"))["r"]


def test_geokey_header_only(spark):
    df = spark.createDataFrame([([1, 1, 0],), ([],)], "geokeys array<int>")
    assert [r["epsg"] for r in md.resolve_epsg(df).collect()] == [None, None]
