"""Sampling, caps, splits and the two dataset builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.functions.positions import in_file_order
from eoframe.operators import annotations as an
from eoframe.operators import pairs as tp
from eoframe.operators import sampling as sm
from eoframe.plans.registry import query
from eoframe.session import materialize, shared_dir
from eoframe.sources.adapters import Tables, oracle

SEED = 42
N = 1000
CAPS = {"captioning": None, "binary": 1500, "mcq": 1000, "bounding box": 500}


def _md5(key: str, seed: str = str(SEED)) -> str:
    return f"md5('{seed}:' || {key}), {key}"


def _firsts(skip_nulls: bool) -> str:
    if skip_nulls:
        return ("pc as (select patch_id, arg_min(country, ann_id) filter (where country is not null) as country from ann "
                "group by patch_id)")
    return ("pc as (select patch_id, country from (select patch_id, country, row_number() over (partition by patch_id "
            "order by ann_id) as rn from ann) where rn = 1)")


_V1 = f"""{_firsts(True)}, tot as (select count(*) as n from pc),
    q as (select country, greatest(1, cast(floor({N} * count(*) / (select n from tot)) as bigint)) as quota from pc
      where country is not null group by country),
    drawn as (select patch_id, country from (select pc.patch_id, pc.country, quota,
        row_number() over (partition by pc.country order by {_md5('patch_id')}) as rn
      from pc join q on pc.country = q.country) where rn <= quota),
    chosen as (select patch_id, country from (select patch_id, country, row_number() over (order by {_md5('patch_id', f'{SEED}:trim')}) as rn
      from drawn) where rn <= {N} and (select n from tot) > {N}
      union all select patch_id, country from pc where (select n from tot) <= {N})"""


@query(oracle(f"with {_V1} select patch_id, coalesce(country, 'none') as country from chosen", "ann"))
def patch_sample_v1(t: Tables) -> DataFrame:
    return sm.sample_patches_v1(t.ann, N, SEED).withColumn("country", F.coalesce("country", F.lit("none")))


_V2 = f"""{_firsts(False)}, tot as (select count(*) as n, least({N}, count(*)) as target from pc),
    q as (select country, greatest(1, cast(floor(count(*) / (select n from tot) * (select target from tot)) as bigint)) as quota
      from pc group by country),
    drawn as (select patch_id, country from (select pc.patch_id, pc.country, quota,
        row_number() over (partition by pc.country order by {_md5('patch_id')}) as rn
      from pc join q on pc.country is not distinct from q.country) where rn <= quota),
    extra as (select patch_id, country, row_number() over (order by {_md5('patch_id', f'{SEED}:topup')}) as rn from pc
      where patch_id not in (select patch_id from drawn)),
    chosen as (select patch_id, country from drawn union all select patch_id, country from extra
      where rn <= (select target from tot) - (select count(*) from drawn))"""


@query(oracle(f"with {_V2} select patch_id, coalesce(country, 'none') as country from chosen", "ann"))
def patch_sample_v2(t: Tables) -> DataFrame:
    return sm.sample_patches_v2(t.ann, N, SEED).withColumn("country", F.coalesce("country", F.lit("none")))


_V3 = f"""{_firsts(True)}, open as (select * from pc where patch_id not in (select patch_id from cached)),
    tot as (select count(*) as n from open),
    q as (select country, greatest(1, cast(floor(500 * count(*) / (select n from tot)) as bigint)) as quota from open
      where country is not null group by country),
    drawn as (select patch_id, country from (select o.patch_id, o.country, quota,
        row_number() over (partition by o.country order by {_md5('patch_id')}) as rn
      from open o join q on o.country = q.country) where rn <= quota),
    extra as (select patch_id, country, row_number() over (order by {_md5('patch_id', f'{SEED}:topup')}) as rn from open
      where patch_id not in (select patch_id from drawn)),
    full_set as (select patch_id, country from drawn union all select patch_id, country from extra
      where rn <= 500 - (select count(*) from drawn)),
    chosen as (select patch_id, country from (select patch_id, country,
        row_number() over (order by {_md5('patch_id', f'{SEED}:head')}) as rn from full_set)
      where rn <= 500 and (select n from tot) > 500 union all select patch_id, country from open where (select n from tot) <= 500)"""


@query(oracle(f"with {_V3} select patch_id, coalesce(country, 'none') as country from chosen", "ann", "cached"))
def patch_sample_v3(t: Tables) -> DataFrame:
    return sm.sample_patches_v3(t.ann, t.cached, 500, SEED).withColumn("country", F.coalesce("country", F.lit("none")))


_CAP = "case type when 'binary' then 1500 when 'mcq' then 1000 when 'bounding box' then 500 else null end"


@query(oracle(f"""select ann_id, type from (select ann_id, type, row_number() over (partition by type order by {_md5('ann_id')}) as rn
    from ann where type is not null) where rn <= coalesce({_CAP}, rn)""", "ann"))
def type_caps(t: Tables) -> DataFrame:
    return sm.cap_per_type(t.ann.select("ann_id", "type"), SEED, CAPS)


@query(oracle(f"""with p as (select distinct image from entries where source_split = 'train'),
    r as (select image, row_number() over (order by {_md5('image')}) as rn, count(*) over () as n from p)
    select e.id, case when rn <= greatest(1, floor(n * cast(0.1 as double))) then 'val' else 'train' end as split
    from entries e join r on e.image = r.image where source_split = 'train'""", "entries"))
def patch_split_v1(t: Tables) -> DataFrame:
    e = t.entries.filter(F.col("source_split") == "train").select("id", "image")
    return sm.split_by_patch(e, 0.1, SEED).select("id", "split")


@query(oracle(f"""with r as (select patch_id, row_number() over (order by {_md5('patch_id')}) as rn, count(*) over () as n from patches)
    select e.id, case when rn <= greatest(10, floor(n * cast(0.1 as double))) then 'val' else 'train' end as split
    from entries e join r on e.image = r.patch_id where source_split = 'train'""", "entries", "patches"))
def patch_split_v2(t: Tables) -> DataFrame:
    e = t.entries.filter(F.col("source_split") == "train").select("id", "image")
    return sm.split_by_patch(e, 0.1, SEED, floor=10, universe=t.patches).select("id", "split")


@query(oracle(f"""with r as (select id, row_number() over (order by {_md5('id')}) as rn, count(*) over () as n from entries)
    select id, case when rn <= floor(n * cast(0.8 as double)) then 'train' else 'val' end as split from r""", "entries"))
def row_split_80_20(t: Tables) -> DataFrame:
    return sm.split_rows(t.entries.select("id"), SEED, "id", [("train", 0.8)], "val")


@query(oracle(f"""with r as (select id, row_number() over (order by {_md5('id')}) as rn, count(*) over () as n from entries)
    select id, case when rn <= greatest(20, floor(n * cast(0.15 as double))) then 'val' else 'train' end as split from r""", "entries"))
def row_split_85_15(t: Tables) -> DataFrame:
    return sm.split_rows(t.entries.select("id"), SEED, "id", [("val", 0.15)], "train", floor=20)


@query(oracle(f"""with r as (select id, row_number() over (order by {_md5('id')}) as rn, count(*) over () as n from entries)
    select id, case when rn <= floor(n * cast(0.7 as double)) then 'train'
      when rn <= floor(n * cast(0.7 as double)) + floor(n * cast(0.15 as double)) then 'val' else 'test' end as split from r""", "entries"))
def row_split_70_15_15(t: Tables) -> DataFrame:
    return sm.split_rows(t.entries.select("id"), SEED, "id", [("train", 0.7), ("val", 0.15)], "test")


@query(oracle(f"""with g as (select distinct image from entries),
    r as (select image, row_number() over (order by {_md5('image')}) as rn, count(*) over () as n from g)
    select id, case when rn <= floor(n * cast(0.7 as double)) then 'train'
      when rn <= floor(n * cast(0.7 as double)) + floor(n * cast(0.15 as double)) then 'val' else 'test' end as split
    from entries e join r on e.image = r.image""", "entries"))
def group_split_70_15_15(t: Tables) -> DataFrame:
    e = t.entries.select("id", "image")
    return sm.split_groups(e, SEED, "image", [("train", 0.7), ("val", 0.15)], "test").select("id", "split")


@query(oracle(f"""with k as (select count(*) as n, count(distinct category) as k from entries),
    r as (select id, category, row_number() over (partition by category order by {_md5('id')}) as rn from entries)
    select id, category from r, k where k.n <= 2000 or rn <= floor(2000 / k.k)""", "entries"))
def balanced_cap(t: Tables) -> DataFrame:
    return sm.cap_balanced(t.entries.select("id", "category"), "category", 2000, SEED, "id")


@query(oracle(f"""with b as (select ann_id, patch_id, row_number() over (partition by patch_id order by {_md5('ann_id')}) as rn
    from ann where type = 'binary') select ann_id, patch_id from b where rn <= 3""", "ann"))
def questions_per_patch(t: Tables) -> DataFrame:
    binary = t.ann.filter(F.col("type") == "binary").select("ann_id", "patch_id")
    return sm.sample_per_key(binary, "patch_id", 3, SEED, "ann_id").drop("rank")


@query(oracle(f"select patch_id from (select patch_id, row_number() over (order by {_md5('patch_id')}) as rn from cached) where rn <= 50",
              "cached"))
def patch_sample_fixed(t: Tables) -> DataFrame:
    return sm.sample_keys(t.cached, 50, SEED)


@query(oracle("select patch_id from (select patch_id, row_number() over (order by patch_id) as rn from cached) where rn <= 5", "cached"))
def first_patches(t: Tables) -> DataFrame:
    return sm.first_keys(t.cached, 5)


@query(oracle(f"""with {_firsts(True)}, k as (select count(distinct coalesce(country, '-')) as k from pc),
    r as (select patch_id, country, row_number() over (partition by country order by {_md5('patch_id')}) as rn from pc)
    select patch_id, coalesce(country, 'none') as country from r, k where rn <= floor(floor(800 / greatest(k.k, 1)) / 5)""", "ann"))
def class_balanced_patches(t: Tables) -> DataFrame:
    patches = an.first_per_patch(t.ann, ["country"])
    return sm.sample_by_class(patches, "country", 800, 5, SEED, "patch_id").withColumn(
        "country", F.coalesce("country", F.lit("none"))
    )


_ML = f"""lab as (select distinct patch_id, regexp_replace(input, '^\\s+|\\s+$', '', 'g') as label from ann where type = 'binary'
      and lower(regexp_replace(output, '^\\s+|\\s+$', '', 'g')) = 'yes'),
    sz as (select label, count(*) as class_size from lab group by label),
    rar as (select patch_id, min(class_size) as rarity from lab join sz on lab.label = sz.label group by patch_id),
    ranked as (select patch_id, rarity, row_number() over (order by rarity, {_md5('patch_id')}) as rn from rar),
    top as (select patch_id, rarity, row_number() over (order by {_md5('patch_id')}) as vr, count(*) over () as n
      from ranked where rn <= {N})"""


@query(oracle(f"""with {_ML} select patch_id, rarity, case when vr <= floor(n * cast(0.2 as double)) then 'val' else 'train' end
    as split from top""", "ann"))
def multilabel_sample(t: Tables) -> DataFrame:
    return sm.sample_multilabel(an.label_sets(t.ann), N, 0.2, SEED)


@query(oracle(f"select row_number() over (order by {_md5('id')}, id) - 1 as pos, id, image from entries", "entries"))
def stable_shuffle(t: Tables) -> DataFrame:
    """The shuffled rows as files, read back with the places they have there."""
    path = shared_dir(t.spark, "shuffled")
    sm.stable_shuffle(t.entries.select("id", "image"), SEED, "id").write.json(path, compression="lz4")
    return in_file_order(t.spark.read.schema("id string, image string").json(path))


# --- temporal pairs ---------------------------------------------------------------------------------------------------

_LOC = """loc as (select c.patch_id, substr(c.patch_id, 12, 8) as d, strptime(substr(c.patch_id, 12, 8), '%Y%m%d') as dt,
      regexp_extract(c.patch_id, '_(T[^_]*_[^_]*_[^_]*)$', 1) as location_key from cached c)"""
_SETS = r"""sets as (select patch_id, list_sort(list(distinct regexp_replace(input, '^\s+|\s+$', '', 'g'))) as labels from ann
      where type = 'binary' and lower(regexp_replace(output, '^\s+|\s+$', '', 'g')) = 'yes' group by patch_id),
    located as (select loc.*, coalesce(labels, []) as labels from loc left join sets on loc.patch_id = sets.patch_id)"""
_CHANGE = """chg as (select a.patch_id as patch_t1, b.patch_id as patch_t2, a.d as date_t1, b.d as date_t2, a.location_key,
      cast(date_diff('day', a.dt, b.dt) as bigint) as gap,
      list_sort(list_filter(b.labels, lambda x: not list_contains(a.labels, x))) as added,
      list_sort(list_filter(a.labels, lambda x: not list_contains(b.labels, x))) as removed,
      len(list_filter(a.labels, lambda x: list_contains(b.labels, x))) as n_common,
      len(list_distinct(list_concat(a.labels, b.labels))) as n_union
    from located a join located b on a.location_key = b.location_key and a.d < b.d),
    typed as (select *, len(added) + len(removed) as n_changes,
      case when len(added) + len(removed) = 0 then 'no_change' when len(added) > 0 and len(removed) > 0 then 'land_use_transition'
        when len(removed) > 0 then 'land_cover_loss' else 'land_cover_gain' end as change_type,
      round(n_common / cast(greatest(n_union, 1) as double), 4) as jaccard from chg)"""


@query(oracle(f"""with {_LOC} select a.patch_id as patch_t1, b.patch_id as patch_t2, a.d as date_t1, b.d as date_t2,
    cast(date_diff('day', a.dt, b.dt) as bigint) as gap_days, a.location_key
    from loc a join loc b on a.location_key = b.location_key and a.d < b.d""", "cached"))
def temporal_pairs(t: Tables) -> DataFrame:
    return tp.temporal_pairs(tp.parse_patch_id(t.cached)).select(
        F.col("patch_id_t1").alias("patch_t1"), F.col("patch_id_t2").alias("patch_t2"), "date_t1", "date_t2",
        F.col("temporal_gap_days").cast("bigint").alias("gap_days"), "location_key",
    )


@query(oracle(f"""with {_LOC}, {_SETS}, {_CHANGE} select patch_t1, patch_t2, change_type, array_to_string(added, '|') as added,
    array_to_string(removed, '|') as removed, jaccard, cast(n_changes as bigint) as n_changes from typed""", "cached", "ann"))
def label_changes(t: Tables) -> DataFrame:
    return tp.changed_pairs(t.ann, t.cached).select(
        "patch_t1", "patch_t2", "change_type", F.array_join("labels_added", "|").alias("added"),
        F.array_join("labels_removed", "|").alias("removed"), F.col("jaccard_similarity").alias("jaccard"),
        F.col("n_changes").cast("bigint").alias("n_changes"),
    )


@query(oracle(f"""with {_LOC}, {_SETS}, {_CHANGE} select change_type, count(*) as n_pairs, min(gap) as min_gap, max(gap) as max_gap,
    round(sum(gap) / cast(count(*) as double), 6) as mean_gap from typed where change_type <> 'no_change' group by change_type""",
              "cached", "ann"))
def change_gap_stats(t: Tables) -> DataFrame:
    return tp.gap_stats(tp.pair_weights(t.ann, t.cached)).select(
        "change_type", "n_pairs", F.col("min_gap").cast("bigint").alias("min_gap"),
        F.col("max_gap").cast("bigint").alias("max_gap"), F.round("mean_gap", 6).alias("mean_gap"),
    )


_SELF = f"""need as (select greatest(0, sum(case when n_changes > 0 then 1 else -1 end)) as n from typed),
    selfs as (select patch_id, d, location_key from (select loc.*, row_number() over (order by {_md5('patch_id')}) as rn from loc)
      where rn <= (select n from need))"""


@query(oracle(f"""with {_LOC}, {_SETS}, {_CHANGE}, {_SELF} select patch_id as patch_t1, patch_id as patch_t2, d as date_t1,
    'no_change_self' as change_type, location_key from selfs""", "cached", "ann"))
def self_pair_balance(t: Tables) -> DataFrame:
    return tp.balance_self_pairs(t.ann, t.cached, SEED).select(
        "patch_t1", "patch_t2", "date_t1", "change_type", "location_key"
    )


@query(oracle(f"""with {_LOC}, {_SETS}, {_CHANGE}, {_SELF}, everything as (
      select patch_t1, patch_t2, gap, change_type, jaccard from typed
      union all select patch_id, patch_id, 0, 'no_change_self', cast(1 as double) from selfs),
    r as (select *, row_number() over (order by md5('{SEED}:' || patch_t1 || '|' || patch_t2), patch_t1 || '|' || patch_t2) as rn,
      count(*) over () as n from everything)
    select patch_t1, patch_t2, gap as gap_days, change_type, jaccard,
      case when rn <= floor(n * cast(0.7 as double)) then 'train'
        when rn <= floor(n * cast(0.7 as double)) + floor(n * cast(0.15 as double)) then 'val' else 'test' end as split
    from r""", "cached", "ann"))
def temporal_dataset(t: Tables) -> DataFrame:
    return tp.build_temporal_pairs(t.ann, t.cached, SEED).select(
        "patch_t1", "patch_t2", F.col("temporal_gap_days").cast("bigint").alias("gap_days"), "change_type",
        F.col("jaccard_similarity").alias("jaccard"), "split",
    )


# --- the whole training-set build -------------------------------------------------------------------------------------

@query(oracle(f"""with {_V1.replace('from ann', "from ann where split = 'train'")},
    capped as (select ann_id, patch_id, type from (select a.ann_id, a.patch_id, a.type,
        row_number() over (partition by type order by {_md5('ann_id')}) as rn
      from ann a where split = 'train' and patch_id in (select patch_id from chosen)) where rn <= coalesce({_CAP}, rn)),
    pr as (select patch_id, row_number() over (order by {_md5('patch_id')}) as rn, count(*) over () as n
      from (select distinct patch_id from capped))
    select type, case when rn <= greatest(1, floor(n * cast(0.1 as double))) then 'val' else 'train' end as split,
      count(*) as n_entries, count(distinct c.patch_id) as n_patches
    from capped c join pr on c.patch_id = pr.patch_id group by 1, 2""", "ann"))
def training_set_build(t: Tables) -> DataFrame:
    """Train rows -> stratified patches -> caps -> entries -> patch-level split -> counts."""
    train = an.filter_split(t.ann, "train").select(
        "ann_id", "patch_id", "s1_name", "input", "output", "type", "country"
    )
    sampled = materialize(an.keep_patches(train, sm.sample_patches_v1(train, N, SEED)), "sampled-annotations")
    entries = materialize(an.format_instructions(sm.cap_per_type(sampled, SEED, CAPS)), "entries")
    return sm.split_by_patch(entries, 0.1, SEED).groupBy(F.col("task_type").alias("type"), "split").agg(
        F.count(F.lit(1)).alias("n_entries"), F.countDistinct("image").alias("n_patches")
    )
