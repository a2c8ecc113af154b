"""Image-metadata derivation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import text
from eoframe.operators import metadata as md
from eoframe.plans.registry import query, sql_text
from eoframe.sources.adapters import Tables, oracle

# reference-system texts by part key, chosen to visit every branch
_CRS_TEXTS = [
    "EPSG:32643", "epsg:900913", " wgs 84 ", "Web Mercator", "WGS 84 / UTM zone 43N", "UTM 33 S", "UTM 61N", "   ",
    "LOCAL_GRID", "EPSG: 4326 x", "3857",
]
_CRS_SQL = "case k % 11 " + " ".join(f"when {i} then {sql_text(c)}" for i, c in enumerate(_CRS_TEXTS)) + " end"


def crs_code_sql(crs: str, epsg: str) -> str:
    s = rf"upper(regexp_replace({crs}, '^\s+|\s+$', '', 'g'))"
    code = rf"regexp_extract(string_split({s}, 'EPSG:')[-1], '^\s*(\S*)', 1)"
    utm = r"'UTM\s*(?:ZONE\s*)?(\d{1,2})\s*([NS])'"
    zone = f"try_cast(regexp_extract({s}, {utm}, 1) as int)"
    wgs = ", ".join(sql_text(x) for x in fv.WGS84_ALIASES)
    merc = ", ".join(sql_text(x) for x in fv.MERCATOR_ALIASES)
    return (
        f"case when {epsg} > 0 then {epsg} when contains({s}, 'EPSG:') and regexp_full_match({code}, '\\d+') then cast({code} as int) "
        f"when {s} in ({wgs}) then 4326 when {s} in ({merc}) then 3857 when {zone} between 1 and 60 then "
        f"case when regexp_extract({s}, {utm}, 2) = 'N' then 32600 else 32700 end + {zone} end"
    )


def crs_name_sql(crs: str, epsg: str) -> str:
    code = crs_code_sql(crs, epsg)
    return (f"case when ({code}) is not null then 'EPSG:' || cast({code} as varchar(12)) else "
            rf"nullif(upper(regexp_replace({crs}, '^\s+|\s+$', '', 'g')), '') end")


@query(oracle(f"""with c as (select k, {_CRS_SQL} as crs_text, case when k % 7 = 0 then epsg when k % 7 = 1 then -5 end as code from images)
    select k, coalesce({crs_code_sql('crs_text', 'code')}, -1) as epsg, coalesce({crs_name_sql('crs_text', 'code')}, 'none') as crs_name from c""",
              "images"))
def crs_normalisation(t: Tables) -> DataFrame:
    k = F.col("k")
    texts = F.array(*[F.lit(c) for c in _CRS_TEXTS])
    rows = t.images.select(
        "k", F.get(texts, (k % 11).cast("int")).alias("crs_text"),
        F.when(k % 7 == 0, F.col("epsg")).when(k % 7 == 1, F.lit(-5)).alias("code"),
    )
    epsg, name = text.normalize_crs(F.col("crs_text"), F.col("code"))
    return rows.select("k", F.coalesce(epsg, F.lit(-1)).alias("epsg"), F.coalesce(name, F.lit("none")).alias("crs_name"))


@query(oracle("""with f as (select k, case k % 6 when 0 then 'GTIF' when 1 then 'geo_tiff' when 2 then ' tif ' when 3 then 'png'
      when 4 then 'hdf' else file_format end as f from images)
    select k, case when upper(trim(f)) in ('GEOTIFF', 'GEO_TIFF') then 'GEOTIFF' when upper(trim(f)) in ('GTIF', 'TIF', 'TIFF') then 'TIFF'
      when upper(trim(f)) in ('PNG', 'JPEG') then upper(trim(f)) else 'OTHER' end as file_format from f""", "images"))
def format_normalisation(t: Tables) -> DataFrame:
    k = F.col("k")
    f = (F.when(k % 6 == 0, F.lit("GTIF")).when(k % 6 == 1, F.lit("geo_tiff")).when(k % 6 == 2, F.lit(" tif "))
         .when(k % 6 == 3, F.lit("png")).when(k % 6 == 4, F.lit("hdf")).otherwise(F.col("file_format")))
    return t.images.select("k", text.normalize_format(f).alias("file_format"))


@query(oracle("""select k, case when k % 9 = 0 then 'rejected' else modality end as modality from images""", "images"))
def modality_normalisation(t: Tables) -> DataFrame:
    raw = F.when(F.col("k") % 9 == 0, F.lit("lidar")).otherwise(F.concat(F.lit(" "), F.upper("modality"), F.lit("\t")))
    return t.images.select("k", F.coalesce(text.normalize_modality(raw), F.lit("rejected")).alias("modality"))


@query(oracle("""with b as (select k, k % 14 as n, case when k % 3 = 0 then cast(10 as double) when k % 3 = 1 then cast(0.8 as double) end as r from images)
    select k, case when n = 2 then 'sar' when n = 3 then 'rgb' when n >= 4 then 'multispectral' else 'unknown' end as inferred_modality,
      case when n = 2 then case when r = 10 then 'Sentinel-1' else 'SAR (unknown sensor)' end
        when n = 12 then 'Sentinel-2 (BigEarthNet v2, no B10)' when n = 13 then 'Sentinel-2 (full L2A)'
        when n = 4 then case when r <= 1 then 'Cartosat-2S (possible)' else 'Optical 4-band (RGBNIR)' end
        when n = 3 then 'RGB (sensor unknown)' else 'none' end as sensor_guess from b""", "images"))
def sensor_inference(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.images.select(
        "k", (k % 14).alias("band_count"), F.when(k % 3 == 0, F.lit(10.0)).when(k % 3 == 1, F.lit(0.8)).alias("spatial_resolution_m")
    )
    return md.infer_sensor(rows).select("k", "inferred_modality", F.coalesce("sensor_guess", F.lit("none")).alias("sensor_guess"))


@query(oracle("""with b as (select k, k % 6 as n, case when k % 5 = 0 then upper(modality) when k % 5 = 1 then 'lidar' end as tag,
      case when k % 4 = 0 then 'elevation' end as dflt, case when k % 3 = 0 then '(VV,)' else '(None,)' end as descs from images)
    select k, case when tag is not null then case when lower(tag) = 'lidar' then coalesce(dflt, 'other') else lower(tag) end
      when n in (3, 4) and dflt is null then 'optical' when n in (1, 2) and contains(descs, 'VV') then 'sar'
      else coalesce(dflt, 'other') end as resolved_modality from b""", "images"))
def modality_resolution(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.images.select(
        "k", (k % 6).alias("band_count"),
        F.when(k % 5 == 0, F.upper("modality")).when(k % 5 == 1, F.lit("lidar")).alias("modality_tag"),
        F.when(k % 4 == 0, F.lit("elevation")).alias("default_modality"),
        F.when(k % 3 == 0, F.lit("(VV,)")).otherwise(F.lit("(None,)")).alias("band_descriptions"),
    )
    return md.resolve_modality(rows).select("k", "resolved_modality")


@query(oracle("""with g as (select k, width, height, cast(k % 4 + 1 as double) as s, cast(k % 3 as double) as i, cast(k % 2 as double) as j,
      cast(k * 10 as double) as x, cast(k * 20 as double) as y from images where k % 8 <> 0)
    select k, s as resolution, x - i * s as min_x, y + j * s - height * s as min_y, x - i * s + width * s as max_x, y + j * s as max_y from g
    union all select k, -1, -1, -1, -1, -1 from images where k % 8 = 0""", "images"))
def georeference(t: Tables) -> DataFrame:
    k = F.col("k")
    d = lambda c: c.cast("double")
    s = d(k % 4 + 1)
    tie = F.array(d(k % 3), d(k % 2), F.lit(0.0), d(k * 10), d(k * 20), F.lit(0.0))
    rows = t.images.select(
        "k", "width", "height", F.array(s, s, F.lit(0.0)).alias("pixel_scale"),
        F.when(k % 8 == 0, F.slice(tie, 1, 3)).otherwise(tie).alias("tiepoint"),
    )
    out = md.derive_georef(rows)
    named = {"resolution": "spatial_resolution_m", **{c: f"spatial_bounds.{c}" for c in ("min_x", "min_y", "max_x", "max_y")}}
    return out.select("k", *[F.coalesce(F.col(src), F.lit(-1.0)).alias(c) for c, src in named.items()])


@query(oracle("""select k, case k % 5 when 0 then cast(32600 + k % 60 + 1 as bigint) when 1 then 4326 when 2 then 4326 when 3 then -1 else -1 end as epsg,
    case when k % 5 = 0 then 'EPSG:' || cast(32600 + k % 60 + 1 as varchar(8)) when k % 5 in (1, 2) then 'EPSG:4326' else 'none' end as crs
    from images""", "images"))
def geokey_epsg(t: Tables) -> DataFrame:
    """Projected wins; user-defined falls back to geographic; an externally stored value and an empty header give none."""
    k = F.col("k").cast("int")

    def keys(*shorts):
        return F.array(*[s if not isinstance(s, int) else F.lit(s) for s in shorts])

    directory = (
        F.when(k % 5 == 0, keys(1, 1, 0, 2, 2048, 0, 1, 4326, 3072, 0, 1, k % 60 + 32601))
        .when(k % 5 == 1, keys(1, 1, 0, 2, 3072, 0, 1, 32767, 2048, 0, 1, 4326))
        .when(k % 5 == 2, keys(1, 1, 0, 9, 2048, 0, 1, 4326))
        .when(k % 5 == 3, keys(1, 1, 0, 1, 3072, 34736, 1, 5))
        .otherwise(keys(1, 1, 0))
    )
    out = md.resolve_epsg(t.images.select("k", directory.alias("geokeys")))
    return out.select("k", F.coalesce(F.col("epsg").cast("bigint"), F.lit(-1)).alias("epsg"), F.coalesce("crs", F.lit("none")).alias("crs"))


@query(oracle("""select k, case when k % 6 = 0 then 'B04,B8A' when n = 3 then 'B04,B03,B02' when n = 4 then 'B04,B03,B02,B08'
      when n = 12 then 'B01,B02,B03,B04,B05,B06,B07,B08,B8A,B09,B11,B12'
      when n = 13 then 'B01,B02,B03,B04,B05,B06,B07,B08,B8A,B09,B10,B11,B12'
      else array_to_string(list_transform(range(1, cast(n as bigint) + 1), lambda i: 'B' || lpad(cast(i as varchar(4)), 2, '0')), ',') end as band_names
    from (select k, k % 13 + 1 as n from images)""", "images"))
def band_names(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = t.images.select(
        "k", F.when(k % 6 == 0, F.lit(2)).otherwise(k % 13 + 1).cast("int").alias("band_count"),
        F.when(k % 6 == 0, F.array(F.lit(" red "), F.lit("S2 b8a 20m")))
        .when(k % 6 == 1, F.array(F.lit("thermal"))).otherwise(F.array().cast("array<string>")).alias("descriptions"),
    )
    return md.infer_band_names(rows).select("k", F.array_join("band_names", ",").alias("band_names"))


def _payload(k, image_id, modality, width):
    """JSON text of an image record, broken in three ways for some rows."""
    text_ = F.concat(
        F.lit('{"image_id": "'), image_id, F.lit('", "source_id": "s", '),
        F.when(k % 10 == 1, F.lit("")).otherwise(F.concat(F.lit('"width": '), width.cast("string"), F.lit(", "))),
        F.lit('"height": 8, "band_count": 2, "modality": "'), F.when(k % 10 == 2, F.lit("lidar")).otherwise(modality),
        F.lit('", "epsg": null, "bands": [{"band_index": 1, "band_id": "VV"}], "spatial_bounds": {"min_x": 1, "min_y": 2, "max_x": 3, "max_y": 4}}'),
    )
    return F.when(k % 10 == 3, F.lit('{"image_id": ')).otherwise(text_)


@query(oracle("""select k, case when k % 10 = 1 then 'missing width' when k % 10 = 2 then 'unknown modality' when k % 10 = 3 then 'malformed json'
      else 'ok' end as verdict, case when k % 10 in (1, 2, 3) then -1 else width end as width,
      case when k % 10 in (1, 2, 3) then 'none' else modality end as modality,
      case when k % 10 = 3 then 'none' else 'GEOTIFF' end as file_format, case when k % 10 = 3 then 'none' else 'uint8' end as dtype from images""", "images"))
def image_json_parsing(t: Tables) -> DataFrame:
    rows = t.images.select("k", _payload(F.col("k"), F.col("image_id"), F.upper("modality"), F.col("width")).alias("payload"))
    out = md.parse_ontology_json(rows)
    ok, readable = F.col("reject_reason").isNull(), F.coalesce(F.col("reject_reason") != "malformed json", F.lit(True))
    return out.select(
        "k", F.coalesce("reject_reason", F.lit("ok")).alias("verdict"),
        F.when(ok, F.col("width")).otherwise(F.lit(-1)).alias("width"),
        F.when(ok, F.col("modality")).otherwise(F.lit("none")).alias("modality"),
        F.when(readable, F.col("file_format")).otherwise(F.lit("none")).alias("file_format"),
        F.when(readable, F.col("bands")[0]["dtype"]).otherwise(F.lit("none")).alias("dtype"),
    )


@query(oracle("""select k, case k % 4 when 2 then 'missing images' when 3 then 'unknown pair type' else 'ok' end as verdict,
      case k % 4 when 0 then 'SAR_TEMPORAL' else 'OPTICAL_SAR' end as pair_type,
      case when k % 4 = 0 or k % 4 = 3 then 'p' || cast(k as varchar(12)) when k % 4 = 1 then 'o' || cast(k as varchar(12)) else 'none' end as first_image
    from images""", "images"))
def pair_json_parsing(t: Tables) -> DataFrame:
    k, n = F.col("k"), F.col("k").cast("string")
    new = F.concat(F.lit('{"pair_id": "x", "primary_image": {"image_id": "p'), n, F.lit('"}, "secondary_image": {"image_id": "q"}, "pair_type": "'),
                   F.when(k % 4 == 3, F.lit("weird")).otherwise(F.lit("sar_temporal")), F.lit('"}'))
    old = F.concat(F.lit('{"pair_id": "x", "optical_image": {"image_id": "o'), n, F.lit('"}, "sar_image": {"image_id": "q"}}'))
    payload = F.when(k % 4 == 1, old).when(k % 4 == 2, F.lit('{"pair_id": "x"}')).otherwise(new)
    out = md.parse_pair_json(t.images.select("k", payload.alias("payload")))
    return out.select(
        "k", F.coalesce("reject_reason", F.lit("ok")).alias("verdict"),
        F.when(F.col("reject_reason") == "unknown pair type", F.lit("OPTICAL_SAR")).otherwise(F.col("pair_type")).alias("pair_type"),
        F.coalesce(F.col("primary.image_id"), F.lit("none")).alias("first_image"),
    )


@query(oracle("""select k, case when k % 3 = 0 then 'missing task' else 'ok' end as verdict, 'run-default' as run_id,
    case when k % 2 = 0 then 'UNKNOWN' else 'v' || cast(k as varchar(12)) end as model_version from images""", "images"))
def provenance_json_parsing(t: Tables) -> DataFrame:
    k = F.col("k")
    payload = F.concat(
        F.lit('{"input_hash": "h", "model_name": "m"'), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit(', "task": "vqa"')),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(', "model_version": "v'), k.cast("string"), F.lit('"'))), F.lit("}"))
    out = md.parse_provenance_json(t.images.select("k", payload.alias("payload")))
    return out.select("k", F.coalesce("reject_reason", F.lit("ok")).alias("verdict"), "run_id", "model_version")


@query(oracle("""with b as (select *, case when k % 10 = 1 then ['b02', 'B03', 'B99'] when modality = 'sar' then ['VV', 'VH'] when modality = 'optical' then ['B04', 'B03', 'B02']
      when modality = 'multispectral' then ['B01', 'B02', 'B03', 'B04', 'B05', 'B06', 'B07', 'B08', 'B8A', 'B09', 'B11', 'B12'] else [] end as ids from images)
    select image_id, '{"image_id":"' || image_id || '","sensor":' || coalesce('"' || sensor || '"', 'null') || ',"width":' || cast(width as varchar(12))
      || ',"cloud_cover_percentage":' || coalesce(cast(cloud_cover_percentage as varchar(20)), 'null')
      || ',"spatial_bounds":' || case when bx is null then 'null' else '{"min_x":' || cast(bx as varchar(20)) || ',"min_y":' || cast(by_ as varchar(20))
        || ',"max_x":' || cast(bx + 100 as varchar(20)) || ',"max_y":' || cast(by_ + 100 as varchar(20)) || '}' end
      || ',"bands":[' || array_to_string(list_transform(ids, lambda x, i: '{"band_index":' || cast(i as varchar(4)) || ',"band_id":"' || x || '","wavelength_nm":null}'), ',') || ']}'
    as payload from b""", "images"))
def image_json_text(t: Tables) -> DataFrame:
    """Records with nested bounds and bands as JSON."""
    return md.to_ontology_json(t.image_records.select("image_id", "sensor", "width", "cloud_cover_percentage", "spatial_bounds", "bands"))
