"""Validation of images and pairs, reconciliation of model outputs, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.config import ValidationConfig
from eoframe.functions import geometry, text
from eoframe.operators import provenance as pv
from eoframe.operators import reconcile as rc
from eoframe.operators import validation as va
from eoframe.plans.metadata import crs_code_sql, crs_name_sql
from eoframe.plans.registry import query, sql_text
from eoframe.sources.adapters import Tables, oracle

CFG = ValidationConfig(required_optical_bands=("B04", "B02"), required_sar_bands=("VV", "VH"))
_EPSG = "(epsg in (4326, 3857, 32743) or epsg between 32601 and 32660 or epsg between 32701 and 32710 or epsg between 32732 and 32740)"
_RANKS = "case code " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(fv.ERROR_PRECEDENCE)) + " else 99 end"
_IDS = ("case when k % 10 = 1 then ['B02', 'B03', 'B99'] when modality = 'sar' then ['VV', 'VH'] when modality = 'optical' then ['B04', 'B03', 'B02'] "
        "when modality = 'multispectral' then ['B01', 'B02', 'B03', 'B04', 'B05', 'B06', 'B07', 'B08', 'B8A', 'B09', 'B11', 'B12'] else [] end")


def _image_errors_sql(src: str, key: str) -> str:
    """(key, pos, code) of every single-image error over an image-shaped CTE."""
    opt = "modality in ('optical', 'multispectral', 'hyperspectral')"
    return f"""select {key}, 1 as pos, case when upper(file_format) in ('PNG', 'JPEG', 'JPG') then 'UNSUPPORTED_BENCHMARK_FORMAT' else 'INVALID_FORMAT' end as code
        from {src} where upper(file_format) not in ('GEOTIFF', 'TIFF')
      union all select {key}, 2, case when crs is null and epsg is null then 'MISSING_CRS' else 'UNSUPPORTED_CRS' end from {src}
        where (crs is null and epsg is null) or (epsg is not null and not {_EPSG})
      union all select {key}, 3, 'DIMENSION_MISMATCH' from {src} where width < 16 or height < 16
      union all select {key}, 5, 'MISSING_BAND' from {src} where len(ids) > 0 and (({opt} and not (list_contains(ids, 'B04') and list_contains(ids, 'B02')))
        or (modality = 'sar' and not (list_contains(ids, 'VV') and list_contains(ids, 'VH'))))
      union all select {key}, 6, 'RESOLUTION_MISMATCH' from {src} where spatial_resolution_m < 0.01 or spatial_resolution_m > 1000"""


_IMG = f"img as (select *, {_IDS} as ids from images)"
_WARN = ("(case when coalesce(cloud_cover_percentage, 0) > 50 then 1 else 0 end + case when sensor is null then 1 else 0 end)")


@query(oracle(f"""with {_IMG}, bad as (select k, 'width' as violated from img where width <= 300 union all select k, 'bands' from img
      where len(ids) > 0 and len(ids) <> band_count union all select k, 'modality' from img where k % 9 = 0
      union all select k, 'epsg' from img where k % 12 = 5 union all select k, 'spatial_bounds.min_x' from img where k % 7 = 3 and bx is not null)
    select k, string_agg(violated, ',' order by violated) as violated from bad group by k""", "images"))
def constraint_violations(t: Tables) -> DataFrame:
    """Construction constraints on records damaged on purpose."""
    k = F.col("k")
    bounds = F.when((k % 7 == 3) & F.col("spatial_bounds").isNotNull(),
                    F.col("spatial_bounds").withField("min_x", F.col("spatial_bounds.max_x") + 1)).otherwise(F.col("spatial_bounds"))
    damaged = t.image_records.withColumns({
        "width": F.col("width") - 300, "modality": F.when(k % 9 == 0, F.lit("lidar")).otherwise(F.col("modality")),
        "epsg": F.when(k % 12 == 5, F.lit(-1)).otherwise(F.col("epsg")), "spatial_bounds": bounds})
    v = F.sort_array(va.constraint_errors())
    return damaged.select("k", F.array_join(v, ",").alias("violated")).filter(F.col("violated") != "")


def _rule_sql(pos: int) -> str:
    return oracle(f"with {_IMG}, errs as ({_image_errors_sql('img', 'k')}) select k, code from errs where pos = {pos}", "images")


def _rule(t: Tables, *errors) -> DataFrame:
    rows = t.image_records.select("k", F.explode(F.array_compact(F.array(*errors))).alias("e"))
    return rows.select("k", F.col("e.code").alias("code"))


@query(_rule_sql(1))
def format_check(t: Tables) -> DataFrame:
    return _rule(t, va.format_error(CFG))


@query(_rule_sql(2))
def crs_check(t: Tables) -> DataFrame:
    return _rule(t, va.crs_error(CFG))


@query(_rule_sql(3))
def dimension_check(t: Tables) -> DataFrame:
    return _rule(t, va.dimension_error(CFG))


@query(oracle("""select k, case when k % 7 = 2 then '20x' || cast(height * 2000 as varchar(12)) || case when height * 2000 > 65536 then ' is too large' else '' end when k % 7 = 3 then '65537x' || cast(height as varchar(12)) || case when height < 16
      then ' is too small' else ' is too large' end when k % 7 = 4 then '65536x16' when k % 7 = 5 then '15x65537 is too small' end as told from images where k % 7 between 2 and 5""", "images"))
def dimension_limits(t: Tables) -> DataFrame:
    """Sides at and beyond both limits."""
    m, height = F.col("k") % 7, F.col("height")
    sized = t.image_records.where(m.between(2, 5)).withColumns({
        "width": F.when(m == 2, F.lit(20)).when(m == 3, F.lit(65537)).when(m == 4, F.lit(65536)).otherwise(F.lit(15)),
        "height": F.when(m == 2, height * 2000).when(m == 3, height).when(m == 4, F.lit(16)).otherwise(F.lit(65537)),
    })
    error = va.dimension_error(CFG)
    shape = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    return sized.select("k", F.coalesce(error["message"], shape).alias("told"))


@query(_rule_sql(5))
def band_check(t: Tables) -> DataFrame:
    return _rule(t, *va.band_errors(CFG))


@query(_rule_sql(6))
def resolution_check(t: Tables) -> DataFrame:
    return _rule(t, va.resolution_error(CFG))


@query(oracle(f"select k, {_WARN} as n_warnings from images where {_WARN} > 0", "images"))
def image_warnings(t: Tables) -> DataFrame:
    return t.images.select("k", F.size(va.image_warnings()).alias("n_warnings")).filter(F.col("n_warnings") > 0)


@query(oracle(f"""with {_IMG}, errs as ({_image_errors_sql('img', 'k')}),
    grouped as (select k, string_agg(code, ',' order by {_RANKS}, pos) as codes, count(*) as n from errs group by k)
    select i.k, coalesce(codes, '') as codes, coalesce(n, 0) as error_count, {_WARN} as warning_count, codes is null as is_valid,
      coalesce(string_split(codes, ',')[1], 'none') as primary_error from images i left join grouped g on i.k = g.k""", "images"))
def image_validation(t: Tables) -> DataFrame:
    out = va.validate_images(t.image_records, CFG)
    return out.select("k", F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"), "error_count",
                      "warning_count", "is_valid", F.coalesce("primary_error", F.lit("none")).alias("primary_error"))


@query(oracle(f"with {_IMG}, errs as ({_image_errors_sql('img', 'k')}) select distinct k from errs", "images"))
def rejected_images(t: Tables) -> DataFrame:
    return va.validate_images(t.image_records, CFG, strict=True).select("k")


@query(oracle(f"""with {_IMG}, errs as ({_image_errors_sql('img', 'k')})
    select k, string_agg(code, ',' order by case code when 'RESOLUTION_MISMATCH' then 0 when 'MISSING_CRS' then 1 else 2 end, pos) as codes
    from errs group by k""", "images"))
def error_ordering(t: Tables) -> DataFrame:
    """Another precedence list; codes outside it keep their own order behind."""
    errors = va.order_errors(va.image_error_list(CFG), ["RESOLUTION_MISMATCH", "MISSING_CRS"])
    out = t.image_records.select("k", F.array_join(F.transform(errors, lambda e: e["code"]), ",").alias("codes"))
    return out.filter(F.col("codes") != "")


@query(oracle("""select k, not (upper(file_format) = 'PNG' and coalesce(dataset_name, '-') not in ('BigEarthNet', 'RSVQA')) as accepted,
    case when upper(file_format) = 'PNG' and dataset_name in ('BigEarthNet', 'RSVQA') then 'benchmark source: ' || dataset_name else 'none' end as bypass_warning
    from images""", "images"))
def benchmark_bypass(t: Tables) -> DataFrame:
    return va.benchmark_bypass(t.images).select("k", "accepted", F.coalesce("bypass_warning", F.lit("none")).alias("bypass_warning"))


# --- pairs ------------------------------------------------------------------------------------------------------------

_SIDES = ["modality", "crs", "epsg", "bx", "by_", "grid_shift", "spatial_resolution_m", "width", "height", "file_format", "ids", "sensor",
          "cloud_cover_percentage", "image_id", "source_id"]
_OPT = "{0}_modality in ('optical', 'multispectral', 'hyperspectral')"
_IX = "(least(a_bx, b_bx) + 100 - greatest(a_bx, b_bx))"
_IY = "(least(a_by_, b_by_) + 100 - greatest(a_by_, b_by_))"
_AREA = f"(case when {_IX} <= 0 or {_IY} <= 0 then cast(0 as double) else {_IX} * {_IY} end)"
_PAIRS = f"""{_IMG}, joined as (select p.pair_id, p.pair_type, p.pair_type = 'OPTICAL_SAR' and f.modality = 'sar'
      and s.modality in ('optical', 'multispectral', 'hyperspectral') as swap, {", ".join(f"f.{c} as f_{c}, s.{c} as s_{c}" for c in _SIDES)}
      from image_pairs p left join img f on p.first_id = f.image_id left join img s on p.second_id = s.image_id),
    ab0 as (select pair_id, pair_type, {", ".join(f"case when swap then s_{c} else f_{c} end as a_{c}, case when swap then f_{c} else s_{c} end as b_{c}" for c in _SIDES)} from joined),
    ab as (select *, case when a_bx is not null and b_bx is not null then {_AREA} / nullif(20000 - {_AREA}, 0) end as iou, {_AREA} / 10000 as small_overlap,
      {crs_code_sql('a_crs', 'a_epsg')} as a_code, {crs_code_sql('b_crs', 'b_epsg')} as b_code,
      {crs_name_sql('a_crs', 'a_epsg')} as a_name, {crs_name_sql('b_crs', 'b_epsg')} as b_name,
      case pair_type when 'OPTICAL_SAR' then {_OPT.format('a')} and b_modality = 'sar' when 'OPTICAL_TEMPORAL' then {_OPT.format('a')} and {_OPT.format('b')}
        else a_modality = 'sar' and b_modality = 'sar' end as modality_ok from ab0)"""


def _pairs(t: Tables) -> DataFrame:
    return va.assemble_pairs(t.image_pairs, t.image_records)


@query(oracle(f"""with {_PAIRS} select pair_id, a_image_id as primary_id, b_image_id as secondary_id, case when a_image_id is null or b_image_id is null then 'missing image' when modality_ok then 'ok' else 'modality mismatch' end as verdict,
    coalesce(round(iou, 6), -1) as overlap from ab""", "images", "image_pairs"))
def pair_assembly(t: Tables) -> DataFrame:
    return _pairs(t).select(
        "pair_id", F.col("primary.image_id").alias("primary_id"), F.col("secondary.image_id").alias("secondary_id"),
        F.coalesce("reject_reason", F.lit("ok")).alias("verdict"), F.coalesce(F.round("spatial_overlap_iou", 6), F.lit(-1.0)).alias("overlap"))


@query(oracle(f"""with {_PAIRS} select pair_id, case when a_code is not null and b_code is not null then a_code = b_code
      when a_name is not null and b_name is not null then a_name = b_name else false end as compatible,
      case when a_code is not null and b_code is not null then case when a_code = b_code then 'ok' else 'EPSG mismatch: ' || cast(a_code as varchar(9)) || ' vs ' || cast(b_code as varchar(9)) end
        when a_name is not null and b_name is not null then case when a_name = b_name then 'ok' else 'CRS mismatch: ''' || a_name || ''' vs ''' || b_name || '''' end
        else 'Missing spatial reference system (CRS/EPSG)' end as reason from ab""", "images", "image_pairs"))
def crs_compatibility(t: Tables) -> DataFrame:
    ok, reason = va.crs_compatibility(F.col("primary"), F.col("secondary"))
    return _pairs(t).select("pair_id", ok.alias("compatible"), F.coalesce(reason, F.lit("ok")).alias("reason"))


_PAIR_ERRORS = f"""select pair_id, 31 as pos, 'INCOMPATIBLE_MODALITY' as code from ab where pair_type = 'OPTICAL_SAR' and not {_OPT.format('a')}
      union all select pair_id, 32, 'INCOMPATIBLE_MODALITY' from ab where pair_type = 'OPTICAL_SAR' and b_modality <> 'sar'
      union all select pair_id, 33, 'INCOMPATIBLE_MODALITY' from ab where pair_type <> 'OPTICAL_SAR' and not modality_ok
      union all select pair_id, 34, case when (a_crs is null and a_epsg is null) or (b_crs is null and b_epsg is null) then 'MISSING_CRS' else 'UNSUPPORTED_CRS' end
        from ab where not case when a_code is not null and b_code is not null then a_code = b_code when a_name is not null and b_name is not null then a_name = b_name else false end
      union all select pair_id, 35, 'SPATIAL_MISMATCH' from ab where iou < 0.5
      union all select pair_id, 36, 'RESOLUTION_MISMATCH' from ab where abs(a_spatial_resolution_m - b_spatial_resolution_m) / greatest(a_spatial_resolution_m, b_spatial_resolution_m) > 0.25
      union all select pair_id, 37, 'COREGISTRATION_FAILURE' from (select pair_id, (abs(a_bx + a_grid_shift - b_bx - b_grid_shift) % 10) / 10 as sx,
          (abs(a_by_ - b_by_) % 10) / 10 as sy from ab where a_bx is not null and b_bx is not null) where (sx > 0.05 and sx < 0.95) or (sy > 0.05 and sy < 0.95)"""


def _codes(df: DataFrame) -> DataFrame:
    return df.select("pair_id", F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"))


@query(oracle(f"""with {_PAIRS}, errs as ({_PAIR_ERRORS}), g as (select pair_id, string_agg(code, ',' order by {_RANKS}, pos) as codes from errs group by pair_id)
    select ab.pair_id, coalesce(codes, '') as codes from ab left join g on ab.pair_id = g.pair_id""", "images", "image_pairs"))
def pair_rules(t: Tables) -> DataFrame:
    return _codes(va.check_pair(_pairs(t), CFG))


def _side_cte(n: str) -> str:
    return f"side_{n} as (select pair_id, {', '.join(f'{n}_{c} as {c}' for c in _SIDES)} from ab)"


def _swarn(n: str) -> str:
    return f"(case when coalesce({n}_cloud_cover_percentage, 0) > 50 then 1 else 0 end + case when {n}_sensor is null then 1 else 0 end)"


@query(oracle(f"""with {_PAIRS}, {_side_cte('a')}, {_side_cte('b')},
    errs as ({_image_errors_sql('side_a', 'pair_id')} union all select pair_id, pos + 10, code from ({_image_errors_sql('side_b', 'pair_id')})
      union all {_PAIR_ERRORS}),
    g as (select pair_id, string_agg(code, ',' order by {_RANKS}, pos) as codes, count(*) as n from errs group by pair_id)
    select ab.pair_id, coalesce(codes, '') as codes, coalesce(n, 0) as error_count, {_swarn('a')} + {_swarn('b')} as warning_count from ab
      left join g on ab.pair_id = g.pair_id""", "images", "image_pairs"))
def pair_validation(t: Tables) -> DataFrame:
    out = va.validate_pairs(_pairs(t), CFG)
    return out.select("pair_id", F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("codes"), "error_count", "warning_count")


_RATIO = "greatest(a_spatial_resolution_m, b_spatial_resolution_m) / least(a_spatial_resolution_m, b_spatial_resolution_m)"


@query(oracle(f"""with {_PAIRS}, r as (select *, case when a_bx is not null and b_bx is not null then small_overlap end as ov,
      case when a_spatial_resolution_m is not null and b_spatial_resolution_m is not null then {_RATIO} end as ratio from ab)
    select pair_id, concat_ws(',', case when ov < 0.5 then 'overlap' end, case when ratio > 10 then 'resolution' end,
        case when a_modality <> 'sar' and b_modality <> 'sar' then 'no radar image' end,
        case when a_modality = 'sar' and b_modality = 'sar' then 'no optical image' end) as errors,
      concat_ws(',', case when a_crs <> b_crs then 'crs' end, case when ov >= 0.5 and ov < 0.9 then 'partial overlap' end,
        case when ratio > 2 and ratio <= 10 then 'resolution' end) as warnings from r""", "images", "image_pairs"))
def pair_compatibility(t: Tables) -> DataFrame:
    return va.pair_compatibility(_pairs(t)).select(
        "pair_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


# --- boxes, answers, contracts ----------------------------------------------------------------------------------------

@query(oracle("""select ann_id, concat_ws(',', case when x - 0.1e0 < 0 then 'min_x out of range' end, case when x + 0.6e0 > 1 then 'max_x out of range' end,
      case when y >= 0.5e0 then 'min_y >= max_y' end, case when pk % 19 = 0 or 2 * confidence > 1.9e0 then 'confidence out of range' end,
      case when pk % 19 = 0 then 'confidence is NaN' end, case when pk % 13 = 0 then 'label is empty' end) as issues from detections""", "detections"))
def box_issues(t: Tables) -> DataFrame:
    x, y, pk = F.col("x"), F.col("y"), F.col("pk")
    conf = F.when(pk % 19 == 0, F.lit(float("nan"))).when(2 * F.col("confidence") > 1.9, F.lit(1.5)).otherwise(F.col("confidence"))
    box = F.struct((x - 0.1).alias("min_x"), y.alias("min_y"), (x + 0.6).alias("max_x"), F.lit(0.5).alias("max_y"),
                   F.when(pk % 13 == 0, F.lit("")).otherwise(F.col("label")).alias("label"), conf.alias("confidence"))
    rows = t.detections.select("ann_id", box.alias("box"))
    return rows.select("ann_id", F.array_join(geometry.box_issues(F.col("box")), ",").alias("issues"))


@query(oracle("""select ann_id, n_bad = 0 as is_valid, (2 - n_bad) / cast(2 as double) as quality, n_bad as n_issues from (select ann_id,
      case when x * 1000 + 600 > 1000 then 1 else 0 end + case when pk % 4 = 0 then 1 else 0 end as n_bad from detections)""", "detections"))
def box_quality(t: Tables) -> DataFrame:
    x, y = F.col("x") * 1000, F.col("y") * 1000
    one = F.struct(x.alias("min_x"), y.alias("min_y"), (x + 600).alias("max_x"), (y + 1).alias("max_y"))
    two = F.struct(F.lit(100.0).alias("min_x"), F.lit(100.0).alias("min_y"),
                   F.when(F.col("pk") % 4 == 0, F.lit(50.0)).otherwise(F.lit(500.0)).alias("max_x"), F.lit(500.0).alias("max_y"))
    q = geometry.box_quality(F.array(one, two))
    return t.detections.select("ann_id", q.alias("q")).select("ann_id", "q.is_valid", "q.quality", "q.n_issues")


@query(oracle("""select ann_id, concat_ws(',', case when sk % 7 = 0 then 'missing fused_answer' end, case when sk % 7 = 2 then 'missing sar_evidence' end,
      case when sk % 7 = 1 then 'score out of range' end, case when sk % 7 = 3 then 'missing model_name' end,
      case when sk % 7 = 4 then 'unreadable' end) as violations from detections""", "detections"))
def response_contract(t: Tables) -> DataFrame:
    sk = F.col("sk")
    payload = F.concat(
        F.lit("{"), F.when(sk % 7 == 0, F.lit("")).otherwise(F.lit('"fused_answer": "a", ')),
        F.lit('"modality_attribution": {"optical_evidence": "o", "fused_reasoning": "f"'),
        F.when(sk % 7 == 2, F.lit("")).otherwise(F.lit(', "sar_evidence": "s"')),
        F.lit('}, "confidence": {"score": '), F.when(sk % 7 == 1, F.lit("1.2")).otherwise(F.lit("0.7")),
        F.lit('}, "provenance": {'), F.when(sk % 7 == 3, F.lit("")).otherwise(F.lit('"model_name": "m"')),
        F.when(sk % 7 == 4, F.lit("")).otherwise(F.lit("}}")))
    out = va.check_contract(t.detections.select("ann_id", payload.alias("payload")), "fusion")
    return out.select("ann_id", F.array_join("violations", ",").alias("violations"))


@query(oracle("""select doc_id, concat_ws('|', """ + ", ".join(
    f"case when contains(lower(text), {sql_text(m.lower())}) then {sql_text(m)} end" for m in fv.CLAIM_MARKERS) + ") as markers from documents"))
def claim_markers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(va.claim_markers(F.col("text")), "|").alias("markers"))


_SECTIONED = ("case when conv_id % 5 = 0 then text else 'optical evidence: ' || text || ' SAR Evidence: low' || case when conv_id % 2 = 0 then "
              "' FUSED ANALYSIS: ' || role else '' end end")


# Upper-casing turns the German sharp s into two letters, so marker positions in the upper text run ahead of the original:
# the reference cuts sections at those positions, and so do both sides here.
@query(f"""with s as (select conv_id, turn, conv_id % 5 = 0 as plain, {_SECTIONED} as whole from conversations),
    u as (select *, upper(replace(whole, 'ß', 'SS')) as up from s),
    p as (select *, instr(up, 'SAR EVIDENCE:') as ps, instr(up, 'FUSED ANALYSIS:') as pf from u)
    select conv_id, turn, case when plain then '' else regexp_replace(substr(whole, 18, ps - 18), '^\\s+|\\s+$', '', 'g') end as optical,
      case when plain then '' else regexp_replace(substr(whole, ps + 13, case when pf > 0 then pf - ps - 13 else 1000000 end), '^\\s+|\\s+$', '', 'g') end as sar,
      case when plain then whole when pf > 0 then regexp_replace(substr(whole, pf + 15), '^\\s+|\\s+$', '', 'g') else '' end as fused from p""")
def modality_sections(t: Tables) -> DataFrame:
    c = t.conversations
    cid = F.col("conv_id")
    whole = F.when(cid % 5 == 0, F.col("text")).otherwise(F.concat(
        F.lit("optical evidence: "), F.col("text"), F.lit(" SAR Evidence: low"),
        F.when(cid % 2 == 0, F.concat(F.lit(" FUSED ANALYSIS: "), F.col("role"))).otherwise(F.lit(""))))
    parts = text.modality_sections(F.col("whole"))
    return c.select("conv_id", "turn", whole.alias("whole")).select(
        "conv_id", "turn", parts["optical"].alias("optical"), parts["sar"].alias("sar"), parts["fused"].alias("fused"))


# --- reconciliation ---------------------------------------------------------------------------------------------------

def _box_lists(t: Tables) -> DataFrame:
    """Two lists of up to two boxes per detection row."""
    x, y, pk, sk = F.col("x"), F.col("y"), F.col("pk"), F.col("sk")
    kind = "struct<min_x:double,min_y:double,max_x:double,max_y:double,label:string,confidence:double>"

    def box(x0, y0, w, h, label):
        return F.struct(x0.alias("min_x"), y0.alias("min_y"), (x0 + w).alias("max_x"), (y0 + h).alias("max_y"), label.alias("label"),
                        F.col("confidence").alias("confidence")).cast(kind)

    a1, a2 = box(x, y, 0.5, 0.5, F.col("label")), box(x + 0.25, y, 0.5, 0.5, F.lit("road"))
    b1 = box(x + 0.125, y, 0.5, 0.5, F.upper("label"))
    b2 = box(x + 0.25 + (pk % 4).cast("double") / 8, y + (sk % 3).cast("double") / 8, 0.5, 0.5, F.lit("field"))
    empty = F.array().cast(f"array<{kind}>")
    return t.detections.select(
        "ann_id", F.when(sk % 11 == 0, empty).when(sk % 11 == 1, F.array(a1)).otherwise(F.array(a1, a2)).alias("a"),
        F.when(pk % 11 == 0, empty).when(pk % 11 == 1, F.array(b1)).otherwise(F.array(b1, b2)).alias("b"))


def _iou_sql(dx: str, dy: str) -> str:
    """IoU of two 0.5 x 0.5 boxes shifted by (dx, dy)."""
    inter = f"greatest(0, 0.5e0 - abs({dx})) * greatest(0, 0.5e0 - abs({dy}))"
    return f"({inter} / (0.5e0 - {inter}))"


_MATCH = f"""c as (select ann_id, case when sk % 11 = 0 then 0 when sk % 11 = 1 then 1 else 2 end as na, case when pk % 11 = 0 then 0 when pk % 11 = 1 then 1 else 2 end as nb,
      cast(pk % 4 as double) / 8 as sx, cast(sk % 3 as double) / 8 as sy from detections),
    m as (select *, case when na >= 1 and nb >= 1 then {_iou_sql('0.125e0', '0e0')} else 0 end as i11, case when na >= 1 and nb >= 2 then {_iou_sql('0.25e0 + sx', 'sy')} else 0 end as i12,
      case when na >= 2 and nb >= 1 then {_iou_sql('0.125e0', '0e0')} else 0 end as i21, case when na >= 2 and nb >= 2 then {_iou_sql('sx', 'sy')} else 0 end as i22 from c),
    f as (select *, case when greatest(i11, i12) >= 0.5 then case when i12 > i11 then 2 else 1 end else 0 end as m1 from m),
    g as (select *, case when m1 <> 1 then i21 else 0 end as j1, case when m1 <> 2 then i22 else 0 end as j2 from f),
    h as (select *, case when greatest(j1, j2) >= 0.5 then 1 else 0 end as got2, case when m1 > 0 then 1 else 0 end as got1,
      case when m1 > 0 then greatest(i11, i12) else 0 end + case when greatest(j1, j2) >= 0.5 then greatest(j1, j2) else 0 end as iou_sum from g),
    matched as (select *, got1 + got2 as hits, case when na = 0 and nb = 0 then 1 when na = 0 or nb = 0 then 0
      else (got1 + got2) / cast(na + nb - got1 - got2 as double) end as ratio from h)"""


@query(oracle(f"""with {_MATCH} select ann_id, case when na = 0 and nb = 0 then 'EMPTY_MATCH' when na = 0 or nb = 0 then 'DISJOINT'
      when ratio >= 0.8 then 'MATCHED' when ratio > 0.3 then 'PARTIAL' else 'DISAGREEMENT' end as status, cast(hits as bigint) as matched_count,
      cast(na - hits as bigint) as unmatched_a_count, cast(nb - hits as bigint) as unmatched_b_count,
      case when na = 0 and nb = 0 then 1 else round(case when hits > 0 then iou_sum / hits else 0 end, 4) end as mean_iou,
      round(ratio, 4) as spatial_agreement_ratio from matched""", "detections"))
def box_matching(t: Tables) -> DataFrame:
    out = _box_lists(t).select("ann_id", geometry.match_boxes(F.col("a"), F.col("b"), 0.5).alias("m"))
    return out.select("ann_id", "m.status", *[F.col(f"m.{c}").cast("bigint").alias(c) for c in ("matched_count", "unmatched_a_count", "unmatched_b_count")],
                      "m.mean_iou", "m.spatial_agreement_ratio")


@query(oracle(f"select ann_id, round(case when pk % 4 >= 4 then 0 else {_iou_sql('cast(pk % 6 as double) / 8', 'cast(sk % 5 as double) / 8')} end, 6) as iou from detections",
              "detections"))
def box_overlap(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")

    def box(x0, y0):
        return F.struct(x0.alias("min_x"), y0.alias("min_y"), (x0 + 0.5).alias("max_x"), (y0 + 0.5).alias("max_y"))

    b = box(x + (F.col("pk") % 6).cast("double") / 8, y + (F.col("sk") % 5).cast("double") / 8)
    rows = t.detections.select("ann_id", box(x, y).alias("a"), b.alias("b"))
    return rows.select("ann_id", F.round(geometry.box_iou(F.col("a"), F.col("b")), 6).alias("iou"))


_NORM = r"case when pred_kind = 'none' then '' else lower(regexp_replace(prediction, '^\s+|\s+$', '', 'g')) end"


@query(oracle(f"select request_id, position, {_NORM} as norm from outputs", "outputs"))
def normalised_predictions(t: Tables) -> DataFrame:
    return t.outputs.select("request_id", "position", text.normalize_prediction(F.col("prediction"), F.col("pred_kind")).alias("norm"))


def _outputs(t: Tables) -> DataFrame:
    return t.outputs.withColumn(
        "boxes", F.lit(None).cast("array<struct<min_x:double,min_y:double,max_x:double,max_y:double,label:string,confidence:double>>"))


REPORTS = f"""o as (select *, {_NORM} as norm, row_number() over (partition by request_id order by position) as rn from outputs),
    fx as (select request_id, count(*) as n, min(norm) as lo, max(norm) as hi, max(case when rn = 1 then norm end) as n1, max(case when rn = 2 then norm end) as n2 from o group by request_id),
    wd as (select *, list_filter(regexp_split_to_array(replace(replace(n1, ',', ' '), ';', ' '), '\\s+'), lambda x: x <> '') as w1,
      list_filter(regexp_split_to_array(replace(replace(n2, ',', ' '), ';', ' '), '\\s+'), lambda x: x <> '') as w2 from fx),
    reports as (select request_id, n as n_outputs, case when n = 1 or lo = hi then 'AGREEMENT' when n = 2 and list_has_any(w1, w2) then 'PARTIAL_AGREEMENT' else 'DISAGREEMENT' end as status from wd)"""


@query(oracle(f"""with {REPORTS} select request_id, n_outputs, status, case status when 'AGREEMENT' then 'NO_IMPACT' when 'PARTIAL_AGREEMENT' then 'MINOR_PENALTY'
    else 'MAJOR_PENALTY' end as impact from reports""", "outputs"))
def disagreement(t: Tables) -> DataFrame:
    return rc.detect_disagreement(_outputs(t)).select("request_id", "n_outputs", "status", "impact")


@query(oracle(f"""with {REPORTS} select cast(o_orderkey as varchar(20)) as request_id, coalesce(status, 'INSUFFICIENT_INFORMATION') as status,
    coalesce(n_outputs, 0) as n_outputs from orders left join reports on cast(o_orderkey as varchar(20)) = request_id""", "outputs"))
def disagreement_with_silent_requests(t: Tables) -> DataFrame:
    requests = t.orders.select(F.col("o_orderkey").cast("string").alias("request_id"))
    return rc.with_silent_requests(requests, rc.detect_disagreement(_outputs(t))).select("request_id", "status", "n_outputs")


@query(oracle(f"""with {_MATCH} select ann_id as request_id, case when na + nb > 0 and na > 0 and nb > 0 and ratio <= 0.3 then 'PARTIAL_AGREEMENT' else 'AGREEMENT' end as status from matched""",
              "detections"))
def disagreement_with_boxes(t: Tables) -> DataFrame:
    """Two equal predictions per request: only misaligned boxes lower the agreement, disjoint lists do not."""
    side = F.explode(F.array(F.struct(F.lit(1).alias("p"), F.col("a").alias("b")), F.struct(F.lit(2).alias("p"), F.col("b").alias("b"))))
    rows = _box_lists(t).select("ann_id", side.alias("s")).select(
        F.col("ann_id").alias("request_id"), F.col("s.p").alias("position"), F.concat(F.lit("m"), F.col("s.p").cast("string")).alias("model_name"),
        F.lit("water").alias("prediction"), F.lit("text").alias("pred_kind"), F.lit(0.5).alias("confidence"), F.col("s.b").alias("boxes"))
    return rc.detect_disagreement(rows).select("request_id", "status")


@query(oracle("""select request_id, model_name, arg_max(prediction, position) as prediction, arg_max(confidence, position) as confidence from outputs
    group by request_id, model_name""", "outputs"))
def individual_predictions(t: Tables) -> DataFrame:
    return rc.individual_predictions(t.outputs)


_CLOUD = "(case when sk % 3 <> 0 and pk % 4 <> 0 then 1 - least(1, greatest(0, cast(pk % 120 as double) / 100)) else cast(1 as double) end)"


def _quality_inputs(t: Tables) -> DataFrame:
    pk, sk = F.col("pk"), F.col("sk")
    return t.detections.select(
        "ann_id", (sk % 3 != 0).alias("is_optical"), F.when(pk % 4 != 0, (pk % 120).cast("double")).alias("cloud_cover_percentage"),
        F.when(pk % 5 != 0, pk % 2 == 0).alias("is_complete"), F.when(sk % 5 != 0, sk % 2 == 0).alias("has_georeference"),
        F.when(sk % 7 != 0, F.col("x") * 2).alias("alignment_iou"), "confidence", "pk", "sk", "x")


_META = "(case when sk % 5 <> 0 and sk % 2 <> 0 then 0.5e0 when pk % 5 <> 0 and pk % 2 <> 0 then 0.7e0 else 1e0 end)"
_ALIGN = "(case when sk % 7 <> 0 then least(1e0, greatest(0e0, x * 2)) else 1e0 end)"


def _q(cloud: str) -> str:
    return f"({cloud} * 0.4e0 + {_META} * 0.3e0 + {_ALIGN} * 0.3e0)"


@query(oracle(f"select ann_id, round({_CLOUD}, 6) as cloud_factor, {_META} as metadata_factor, round({_q(_CLOUD)}, 6) as input_quality from detections", "detections"))
def input_quality(t: Tables) -> DataFrame:
    out = rc.input_quality(_quality_inputs(t))
    return out.select("ann_id", F.round("cloud_factor", 6).alias("cloud_factor"), "metadata_factor", F.round("input_quality", 6).alias("input_quality"))


_OPTC = "(case when pk % 3 = 0 then x + 0.5e0 end)"
_SARC = "(case when pk % 2 = 0 then y + 0.3e0 end)"
_RAWC = "(case when pk % 7 = 1 then 'NaN'::double when pk % 5 = 1 then confidence end)"


def _c(e: str) -> str:
    return f"(case when isnan({e}) then 0e0 else least(1e0, greatest(0e0, {e})) end)"


_CONF = f"""k0 as (select *, {_OPTC} as oc, {_SARC} as sc, {_RAWC} as rw, case when sk % 2 = 0 then confidence - 0.1e0 end as agr from detections),
    k1 as (select *, case when oc is not null and sc is not null then ({_c('oc')} + {_c('sc')}) / 2 when oc is not null then {_c('oc')}
      when sc is not null then {_c('sc')} when rw is not null then {_c('rw')} else 0.5e0 end as mt,
      case when agr is not null and ((oc is not null and sc is not null) or (oc is null and sc is null and rw is not null)) then {_c('agr')} end as agt,
      case when oc is not null or sc is null then case when pk % 4 <> 0 then 1 - least(1, greatest(0, cast(pk % 120 as double) / 100)) else 1e0 end else 1e0 end as cl,
      case when sk % 4 = 0 then case when pk % 9 < 3 then 0.08e0 else 0.2e0 end else 0e0 end as pen from k0),
    k2 as (select *, {_q('cl')} as ql from k1),
    k3 as (select *, case when agt is not null then 0.5e0 * mt + 0.3e0 * agt + 0.2e0 * ql - pen else 0.7e0 * mt + 0.3e0 * ql - pen end as fin from k2)"""


@query(oracle(f"with {_CONF} select ann_id, round(mt, 6) as model_term, coalesce(round(agt, 6), -1) as agreement_term, round(ql, 6) as quality_term, pen as penalty, round({_c('fin')}, 6) as final_confidence from k3",
              "detections"))
def final_confidence(t: Tables) -> DataFrame:
    out = rc.aggregate_confidence(confidence_inputs(t))
    return out.select("ann_id", F.round("model_term", 6).alias("model_term"), F.coalesce(F.round("agreement_term", 6), F.lit(-1.0)).alias("agreement_term"),
                      F.round("quality_term", 6).alias("quality_term"), "penalty", F.round("final_confidence", 6).alias("final_confidence"))


def confidence_inputs(t: Tables) -> DataFrame:
    pk, sk, x = F.col("pk"), F.col("sk"), F.col("x")
    return t.detections.select(
        "ann_id", F.when(pk % 4 != 0, (pk % 120).cast("double")).alias("cloud_cover_percentage"),
        F.when(pk % 5 != 0, pk % 2 == 0).alias("is_complete"), F.when(sk % 5 != 0, sk % 2 == 0).alias("has_georeference"),
        F.when(sk % 7 != 0, x * 2).alias("alignment_iou"),
        F.when(pk % 3 == 0, x + 0.5).alias("optical_confidence"), F.when(pk % 2 == 0, F.col("y") + 0.3).alias("sar_confidence"),
        F.when(pk % 7 == 1, F.lit(float("nan"))).when(pk % 5 == 1, F.col("confidence")).alias("model_confidence"),
        F.when(sk % 2 == 0, F.col("confidence") - 0.1).alias("agreement_score"), (sk % 4 == 0).alias("disagreement_detected"),
        F.when(pk % 9 < 3, F.lit("partial")).when(pk % 9 < 6, F.lit("NONE")).otherwise(F.lit("MATERIAL")).alias("severity"))


@query(oracle("""with c as (select ann_id, coalesce(case when pk % 3 <> 0 then confidence end, 0.75e0) as m, coalesce(case when pk % 4 <> 0 then x end, 1e0) as a,
      coalesce(case when sk % 3 <> 0 then y end, 0.9e0) as q from detections)
    select ann_id, round(0.55e0 * m + 0.25e0 * a + 0.2e0 * q, 4) as score, a < 0.6e0 as disagreement from c""", "detections"))
def light_confidence(t: Tables) -> DataFrame:
    rows = t.detections.select(
        "ann_id", F.when(F.col("pk") % 3 != 0, F.col("confidence")).alias("model_confidence"),
        F.when(F.col("pk") % 4 != 0, F.col("x")).alias("cross_modal_agreement"), F.when(F.col("sk") % 3 != 0, F.col("y")).alias("input_quality"))
    return rc.light_confidence(rows).select("ann_id", "score", "disagreement")


@query(oracle("""select ann_id, case when x + y = 0 then 0.5e0 else round(x / (x + y), 6) end as optical_share,
    case when x + y = 0 then 0.5e0 else round(y / (x + y), 6) end as sar_share from detections""", "detections"))
def attribution_shares(t: Tables) -> DataFrame:
    out = rc.normalize_attribution(t.detections.select("ann_id", F.col("x").alias("optical"), F.col("y").alias("sar")))
    return out.select("ann_id", F.round("optical_share", 6).alias("optical_share"), F.round("sar_share", 6).alias("sar_share"))


# --- provenance -------------------------------------------------------------------------------------------------------

@query(oracle("""select image_id, sha256('{"band_count":' || cast(band_count as varchar(4)) || ',"image_id":"' || image_id || '","sensor":' ||
    coalesce('"' || sensor || '"', 'null') || '}') as record_hash from images""", "images"))
def record_hashes(t: Tables) -> DataFrame:
    return t.images.select("image_id", pv.record_hash(["sensor", "image_id", "band_count"]).alias("record_hash"))


_HASHED = "case when k % 4 <> 0 then sha256(source_id) else 'unhashed-ref-' || source_id end"


def _runs(t: Tables) -> DataFrame:
    return t.images.select(
        "image_id", "source_id", F.when(F.col("k") % 4 != 0, F.sha2("source_id", 256)).alias("sha256"), "file_format", "modality", "sensor",
        F.lit("detector").alias("model_name"), F.when(F.col("k") % 3 == 0, F.lit("v2")).alias("model_version"),
        F.lit(None).cast("string").alias("checkpoint"), F.lit("grounding").alias("task"), F.lit(None).cast("string").alias("stage"))


@query(oracle(f"""with p as (select image_id, {_HASHED} as input_hash, case when k % 3 = 0 then 'v2' else 'UNKNOWN' end as model_version from images)
    select image_id as input_id, input_hash, model_version, 'INFERENCE' as processing_stage,
      'out-' || substr(sha256('run-1|' || input_hash || '|detector|grounding|INFERENCE'), 1, 8) as output_id from p""", "images"))
def provenance_records(t: Tables) -> DataFrame:
    return pv.provenance_records(_runs(t), "run-1").select("input_id", "input_hash", "model_version", "processing_stage", "output_id")


@query(oracle(f"""with {_PAIRS} select pair_id, 'unhashed-ref-' || a_source_id as optical_hash, 'unhashed-ref-' || b_source_id as sar_hash, 'fusion_optical' as optical_task,
    'fusion_sar' as sar_task, 'CROSS_MODAL_FUSION' as fusion_method from ab""", "images", "image_pairs"))
def paired_provenance(t: Tables) -> DataFrame:
    pairs = _pairs(t).select(
        "pair_id", F.col("primary").withField("sha256", F.lit(None).cast("string")).alias("primary"),
        F.col("secondary").withField("sha256", F.lit(None).cast("string")).alias("secondary"),
        F.lit("opt-net").alias("optical_model"), F.lit("sar-net").alias("sar_model"), F.lit("fusion").alias("task"))
    return pv.paired_provenance(pairs, "run-1").select(
        "pair_id", F.col("optical_provenance.input_hash").alias("optical_hash"), F.col("sar_provenance.input_hash").alias("sar_hash"),
        F.col("optical_provenance.task").alias("optical_task"), F.col("sar_provenance.task").alias("sar_task"), "fusion_method")


@query(oracle("select source_id as path, k % 3 = 0 as verified from images", "images"))
def hash_verification(t: Tables) -> DataFrame:
    """Expected hashes in upper case and padded; some wrong, some files absent from the catalog."""
    k = F.col("k")
    catalog = t.images.filter(k % 3 != 1).select(F.col("source_id").alias("path"), F.sha2("source_id", 256).alias("sha256"))
    expected = t.images.select(
        F.col("source_id").alias("path"),
        F.concat(F.lit(" "), F.upper(F.when(k % 3 == 2, F.sha2("image_id", 256)).otherwise(F.sha2("source_id", 256))), F.lit("\n")).alias("expected_hash"))
    return pv.verify_hash(catalog, expected).select("path", "verified")
