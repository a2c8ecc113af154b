"""Imagery queries: members, gathering, coverage, completeness, store upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import text
from eoframe.operators import imagery as im
from eoframe.plans.registry import query, sql_text
from eoframe.sources.adapters import Tables, oracle

BANDS = ", ".join(sql_text(b) for b in fv.PACKED_BANDS)
_MEMBER = """mem as (select regexp_extract(path, '/([^/]*)/[^/]*$', 1) as patch_id,
    regexp_extract(path, '_([^_]*)[.]tif$', 1) as band, pos, payload from members)"""


@query(oracle(f"with {_MEMBER} select patch_id, band, pos from mem", "members"))
def member_paths(t: Tables) -> DataFrame:
    return im.parse_member_path(t.members).select("patch_id", "band", "pos")


@query(oracle("""with m as (select patch_id, s1_name, 'root' || chr(92) || patch_id || chr(92) || 'B02.tif' as p2,
      'BigEarthNet-S1/' || s1_name || '/VV.tif' as p1 from patches)
    select patch_id as s2_found, s1_name as s1_found, 'B02' as s2_band, '' as no_s2 from m""", "patches"))
def member_paths_by_folder(t: Tables) -> DataFrame:
    """The two folder-name variants, one with backslashes; a radar path holds no optical patch."""
    p2 = F.concat(F.lit("root\\"), "patch_id", F.lit("\\B02.tif"))
    p1 = F.concat(F.lit("BigEarthNet-S1/"), "s1_name", F.lit("/VV.tif"))
    return t.patches.select(
        text.member_patch(p2, "s2").alias("s2_found"), text.member_patch(p1, "s1").alias("s1_found"),
        text.member_band(p2, "s2").alias("s2_band"), text.member_patch(p1, "s2").alias("no_s2"),
    )


_GATHER = f"""{_MEMBER}, listed as (select * from mem where band in ({BANDS})),
    first_seen as (select patch_id, band, min(pos) as first_at from listed group by patch_id, band),
    complete as (select patch_id, max(first_at) as completed_at from first_seen group by patch_id having count(*) = 10),
    held as (select l.patch_id, completed_at, band, arg_max(payload, pos) as payload from listed l
      join complete c on l.patch_id = c.patch_id where pos <= completed_at group by l.patch_id, completed_at, band)"""


@query(oracle(f"""with {_GATHER} select patch_id, completed_at, string_agg(payload, ',' order by band) as payloads from held
    group by patch_id, completed_at""", "members"))
def complete_patches(t: Tables) -> DataFrame:
    done = im.gather_complete(im.parse_member_path(t.members), "patch_id", "band", "payload", "pos", fv.PACKED_BANDS)
    return done.select(
        "patch_id", "completed_at", F.array_join(F.transform("items", lambda i: i["payload"]), ",").alias("payloads")
    )


def _store(t: Tables) -> DataFrame:
    """Stored patches as counts: the optical bands that arrived, radar for most, some unreadable."""
    members = im.parse_member_path(t.members).filter(F.col("band").isin(fv.PACKED_BANDS))
    arrived = members.groupBy("patch_id").agg(im.count_items("band", fv.PACKED_BANDS).alias("n_s2"))
    facts = t.patches.filter(F.col("ck") % 4 != 0).select(
        "patch_id", F.when(F.col("ck") % 8 != 1, 2).otherwise(0).alias("n_s1"), (F.col("ck") % 97 == 0).alias("corrupt")
    )
    return facts.join(arrived, "patch_id")


_STORE = f"""{_MEMBER}, arrived as (select patch_id, count(distinct band) as n_s2 from mem where band in ({BANDS}) group by patch_id),
    store as (select p.patch_id, n_s2, case when ck % 8 <> 1 then 2 else 0 end as n_s1, ck % 97 = 0 as corrupt
      from patches p join arrived a on p.patch_id = a.patch_id where ck % 4 <> 0)"""


@query(oracle(f"""with {_STORE}, s as (select p.patch_id, st.patch_id is not null as found, coalesce(not corrupt, false) as readable,
      coalesce(n_s2 = 10, false) as s2_ok, coalesce(n_s1 = 2, false) as s1_ok from patches p left join store st on p.patch_id = st.patch_id)
    select count(*) as total_expected, count(*) filter (where found) as found, count(*) filter (where not found) as missing,
      count(*) filter (where readable and s2_ok) as has_s2, count(*) filter (where readable and s1_ok) as has_s1,
      count(*) filter (where readable and s2_ok and s1_ok) as has_both, count(*) filter (where found and not readable) as corrupt
    from s""", "members", "patches"))
def store_verification(t: Tables) -> DataFrame:
    return im.verify_store(t.patches, _store(t))


@query(oracle("select patch_id from patches where ck % 4 = 0", "patches"))
def missing_patches(t: Tables) -> DataFrame:
    return im.missing_patches(t.patches, _store(t))


@query(oracle(f"""with {_STORE}, s1 as (select s1_name, 2 as channels, case when ck % 13 = 0 then 60 else 120 end as side,
      ck % 89 = 0 as corrupt from patches where ck % 5 <> 0),
    joined as (select m.patch_id as listed, st.patch_id as in_s2, s1.s1_name as in_s1, st.corrupt as s2_bad, s1.corrupt as s1_bad,
      channels, n_s2, side from (select patch_id, s1_name from patches where ck % 11 <> 0) m
      full join store st on m.patch_id = st.patch_id full join s1 on m.s1_name = s1.s1_name)
    select case when listed is null then 'missing_metadata' when in_s2 is null then 'missing_s2' when in_s1 is null then 'missing_s1'
      when s1_bad or s2_bad then 'corrupt' when channels <> 2 or n_s2 <> 10 then 'mismatched' when side <> 120 then 'bad_dimensions'
      else 'valid' end as status, count(*) as n_pairs from joined group by 1""", "members", "patches"))
def pair_verification(t: Tables) -> DataFrame:
    p = t.patches
    s1 = p.filter(F.col("ck") % 5 != 0).select(
        "s1_name", F.lit(2).alias("channels"), F.when(F.col("ck") % 13 == 0, 60).otherwise(120).alias("side"),
        (F.col("ck") % 89 == 0).alias("corrupt"),
    )
    s2 = _store(t).select("patch_id", F.col("n_s2").alias("bands"), F.lit(120).alias("side"), "corrupt")
    return im.verify_pairs(p.filter(F.col("ck") % 11 != 0), s1, s2)


@query(oracle("""with need as (select distinct image as patch_id from entries where source_split = 'train'),
    j as (select n.patch_id as need, c.patch_id as have from need n full join cached c on n.patch_id = c.patch_id)
    select count(need) as required, count(have) as cached, count(*) filter (where need is not null and have is not null) as covered,
      round(count(*) filter (where need is not null and have is not null) * 100 / cast(count(need) as double), 6) as coverage_pct,
      round(count(have) * 100 / cast(count(need) as double), 6) as raw_ratio_pct from j""", "entries", "cached"))
def coverage_report(t: Tables) -> DataFrame:
    need = t.entries.filter(F.col("source_split") == "train").select(F.col("image").alias("patch_id"))
    return im.coverage(need, t.cached).withColumns(
        {c: F.round(c, 6) for c in ("coverage_pct", "raw_ratio_pct")}
    )


@query(oracle("""with m as (select patch_id, case when ck % 6 = 0 then '' when ck % 10 = 3 then 'shared-' || cast(ck as varchar(12))
      else s1_name end as s1_name from patches)
    select s1_name, max(patch_id) as patch_id from m where s1_name <> '' group by s1_name""", "patches"))
def s1_s2_map(t: Tables) -> DataFrame:
    ck = F.col("ck")
    name = F.when(ck % 6 == 0, "").when(ck % 10 == 3, F.concat(F.lit("shared-"), ck.cast("string"))).otherwise(F.col("s1_name"))
    return im.s1_s2_map(t.patches.withColumn("s1_name", name), "patch_id").select("s1_name", "patch_id")


@query(oracle("""select patch_id, case when ck % 5 = 0 then 'local' when ck % 3 = 0 then 'geotiff' when ck % 4 <> 0 then 'remote'
      else 'synthetic' end as source from patches""", "patches"))
def source_resolution(t: Tables) -> DataFrame:
    p, ck = t.patches, F.col("ck")
    return im.resolve_sources(
        p, {"local": p.filter(ck % 5 == 0), "geotiff": p.filter(ck % 3 == 0), "remote": p.filter(ck % 4 != 0)}
    )


@query(oracle("""select string_split(patch_id, '_')[6] || '_' || substr(string_split(patch_id, '_')[3], 1, 8) as tile_date,
    count(*) as n_patches from patches group by 1""", "patches"))
def tile_date_groups(t: Tables) -> DataFrame:
    return im.tile_groups(t.patches)


@query(oracle("""with f as (select case when ck % 10 = 0 then 'test' when ck % 10 = 1 then 'val' else 'train' end as split, ck,
      case folder when 'A' then true when 'B' then ck % 9 <> 0 else ck % 7 <> 0 end as there, folder
    from patches cross join (values ('A'), ('B'), ('label')) as d(folder))
    select split, count(*) filter (where there and folder = 'A') as n_a, count(*) filter (where there and folder = 'B') as n_b,
      count(*) filter (where there and folder = 'label') as n_label,
      count(*) filter (where folder = 'A' and ck % 9 <> 0 and ck % 7 <> 0) as n_triplets from f group by split""", "patches"))
def triplet_counts(t: Tables) -> DataFrame:
    ck = F.col("ck")
    folders = F.array_compact(F.array(F.lit("A"), F.when(ck % 9 != 0, F.lit("B")), F.when(ck % 7 != 0, F.lit("label"))))
    split = F.when(ck % 10 == 0, "test").when(ck % 10 == 1, "val").otherwise("train")
    listing = t.patches.select("patch_id", split.alias("split"), F.explode(folders).alias("folder")).select(
        F.concat_ws("/", "split", "folder", F.concat("patch_id", F.lit(".png"))).alias("path")
    )
    return im.triplet_counts(listing)


@query(oracle("""with s as (select patch_id, 'old-s2' as s2, case when ck % 3 = 0 then 'old-s1' end as s1 from patches where ck % 4 <> 0),
    n as (select patch_id, case when ck % 2 = 0 then 'new-s2' end as s2, case when ck % 7 <> 0 then 'new-s1' end as s1
      from patches where ck % 5 <> 0)
    select coalesce(n.patch_id, s.patch_id) as patch_id, coalesce(n.s2, s.s2, '-') as s2, coalesce(n.s1, s.s1, '-') as s1
    from s full join n on s.patch_id = n.patch_id""", "patches"))
def patch_store_upsert(t: Tables) -> DataFrame:
    ck, p = F.col("ck"), t.patches
    store = p.filter(ck % 4 != 0).select("patch_id", F.lit("old-s2").alias("s2"), F.when(ck % 3 == 0, "old-s1").alias("s1"))
    new = p.filter(ck % 5 != 0).select(
        "patch_id", F.when(ck % 2 == 0, "new-s2").alias("s2"), F.when(ck % 7 != 0, "new-s1").alias("s1")
    )
    return im.upsert_patch_bands(store, new).na.fill("-")


@query(oracle("""with c as (select count(*) as total, count(*) filter (where image in (select patch_id from cached)) as real_imagery
      from entries where source_split = 'train')
    select total, real_imagery, total - real_imagery as synthetic_imagery,
      round(real_imagery * 100 / cast(total as double), 6) as real_pct from c""", "entries", "cached"))
def real_imagery_ratio(t: Tables) -> DataFrame:
    train = t.entries.filter(F.col("source_split") == "train")
    return im.imagery_stats(train, t.cached).withColumn("real_pct", F.round("real_pct", 6))
