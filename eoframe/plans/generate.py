"""Radar and fusion question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.operators import annotations as an
from eoframe.operators import mixture, radar
from eoframe.operators import sampling as sm
from eoframe.plans.registry import contains_sql, query, sql_text
from eoframe.sources.adapters import Tables, oracle

SEED = 42
CATS = radar.CATEGORIES
_HITS = ", ".join(
    f"bool_or({contains_sql('words', fv.RADAR_PROPERTIES[c]['keywords'])} and is_yes) as has_{c}" for c in CATS
)
_LIST = "list_filter([" + ", ".join(f"case when has_{c} then '{c}' end" for c in CATS) + "], lambda x: x is not null)"
CATEGORIES = rf"""bin as (select patch_id, lower(input) as words,
      lower(regexp_replace(output, '^\s+|\s+$', '', 'g')) = 'yes' as is_yes from ann
      where split = 'train' and type = 'binary' and patch_id in (select patch_id from cached)),
    flags as (select patch_id, {_HITS} from bin group by patch_id),
    cats as (select patch_id, case when len({_LIST}) = 0 then ['unknown'] else {_LIST} end as categories from flags)"""


def _byte(expr: str) -> str:
    h = f"md5({expr})"
    return (f"((instr('0123456789abcdef', substr({h}, 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr({h}, 2, 1)) - 1)")


@query(oracle(f"with {CATEGORIES} select patch_id, array_to_string(categories, ',') as categories from cats", "ann", "cached"))
def radar_categories(t: Tables) -> DataFrame:
    return radar.patch_categories(t.ann, t.cached).select("patch_id", F.array_join("categories", ",").alias("categories"))


@query(oracle(rf"""with l as (select patch_id, string_agg(label, ' ' order by label) as words from (select distinct patch_id,
      lower(regexp_replace(input, '^\s+|\s+$', '', 'g')) as label from ann where type = 'binary'
      and lower(regexp_replace(output, '^\s+|\s+$', '', 'g')) = 'yes') group by patch_id),
    f as (select patch_id, {", ".join(f"{contains_sql('words', fv.RADAR_PROPERTIES[c]['keywords'])} as has_{c}" for c in CATS)} from l)
    select patch_id, case when len({_LIST}) = 0 then 'unknown' else array_to_string({_LIST}, ',') end as categories from f""", "ann"))
def radar_categories_of_label_sets(t: Tables) -> DataFrame:
    return an.label_sets(t.ann).select(
        "patch_id", F.array_join(radar.classify_sar(F.col("labels")), ",").alias("categories")
    )


@query(oracle(f"with {CATEGORIES} select category, count(*) as n_patches from (select unnest(categories) as category from cats) group by category",
              "ann", "cached"))
def radar_category_counts(t: Tables) -> DataFrame:
    return radar.category_counts(radar.patch_categories(t.ann, t.cached))


_PROPS = "(values " + ", ".join(
    "(" + ", ".join(sql_text(x) for x in (c, p["backscatter"], p["mechanism"], p["texture"], p["moisture"])) + ")"
    for c, p in fv.RADAR_PROPERTIES.items()
) + ") as {0}(cat, backscatter, mechanism, texture, moisture)"


def _fill(template: str) -> str:
    names = {"backscatter": "p.backscatter", "negative_mechanism": "w.mechanism", "mechanism": "p.mechanism",
             "texture": "p.texture", "moisture": "p.moisture", "cat": "e.cat"}
    out = sql_text(template)
    for n, col in names.items():
        if "{" + n + "}" in template:
            out = f"replace({out}, '{{{n}}}', {col})"
    return out


_QA = f"""e as (select patch_id as image, unnest(categories) as cat from cats),
    neg as (select image, cat, list_filter([{", ".join(sql_text(c) for c in CATS)}], lambda x: x <> cat)[
      {_byte(f"'{SEED}:' || image || '|' || cat")} % 7 + 1] as negative from e where cat <> 'unknown'),
    qa as ({" union all ".join(
        f"select image, e.cat, {i} as n, {_fill(q)} as input, {_fill(a)} as output, {sql_text(k)} as type, {_fill(c)} as category "
        f"from neg e join {_PROPS.format('p')} on e.cat = p.cat join {_PROPS.format('w')} on e.negative = w.cat"
        for i, (q, a, k, c) in enumerate(fv.RADAR_QA_TEMPLATES))})"""


@query(oracle(f"with {CATEGORIES}, {_QA} select image || '|' || cat || '|' || cast(n as varchar(2)) as qa_key, image, input, output, type, category from qa",
              "ann", "cached"))
def radar_questions(t: Tables) -> DataFrame:
    return radar.generate_sar_qa(radar.patch_categories(t.ann, t.cached), SEED)


_COVER = "case when categories[1] = 'crop' then 'agricultural' else categories[1] end"


def _family_sql() -> str:
    parts = []
    for family, templates in fv.FUSION_TEMPLATES.items():
        pick = f"{_byte(f"'{SEED}:' || patch_id || '|{family}'")} % {len(templates)} + 1"
        q = "[" + ", ".join(sql_text(x) for x, _ in templates) + f"][{pick}]"
        a = "[" + ", ".join(sql_text(x) for _, x in templates) + f"][{pick}]"
        parts.append(f"select patch_id as image, {q} as input, {a} as output, 'fusion_{family}' as category from cov")
    for cover, (q, a) in fv.LANDCOVER_FUSION_TEMPLATES.items():
        parts.append(f"select patch_id, {sql_text(q)}, {sql_text(a)}, 'fusion_{cover}' from cov where landcover = '{cover}'")
    return " union all ".join(parts)


@query(oracle(f"""with {CATEGORIES}, cov as (select patch_id, {_COVER} as landcover from cats)
    select image, input, output, category from ({_family_sql()})""", "ann", "cached"))
def fusion_questions(t: Tables) -> DataFrame:
    cats = radar.patch_categories(t.ann, t.cached)
    covers = cats.select("patch_id", radar.landcover_class(F.col("categories")).alias("landcover"))
    return radar.generate_fusion_qa(covers, SEED).select("image", "input", "output", "category")


def _rank(key: str) -> str:
    return f"row_number() over (order by md5('{SEED}:' || {key}), {key})"


_GENERAL = f"""g0 as (select ann_id as id, patch_id as image, input, output from ann where type <> 'bounding box'),
    gp as (select image, {_rank('image')} as rn, count(*) over () as n from (select distinct image from g0)),
    general as (select g0.*, case when rn <= greatest(1, floor(n * 0.1e0)) then 'val' else 'train' end as split from g0 join gp using (image))"""
_MIXTURE = f"""{CATEGORIES}, {_QA}, {_GENERAL},
    s0 as (select image || '|' || cat || '|' || cast(n as varchar(2)) as id, image, input, output from qa),
    s1 as (select *, case when {_rank('id')} <= floor(count(*) over () * 0.8e0) then 'train' else 'val' end as split from s0),
    lc as (select patch_id, {_COVER} as landcover from cats where patch_id in (select image from general where split = 'train')),
    lr as (select patch_id, landcover, row_number() over (partition by landcover order by md5('{SEED}:' || patch_id), patch_id) as rn from lc),
    cov as (select patch_id, landcover from lr where rn <= floor(floor(800 / greatest((select count(distinct landcover) from lc), 1)) / 5)),
    f0 as (select image || '|' || category as id, image, input, output from ({_family_sql()})),
    f1 as (select *, case when {_rank('id')} <= greatest(20, floor(count(*) over () * 0.15e0)) then 'val' else 'train' end as split from f0),
    mixture as (select id, image, input, output, 'general' as category, split, 1 as copy from general
      union all select id, image, input, output, 'sar', split, c from s1 cross join (values (1), (2)) as k(c) where split = 'train' or c = 1
      union all select id, image, input, output, 'fusion', split, 1 from f1)"""


def _built(t: Tables) -> DataFrame:
    e = t.ann.filter(F.col("type") != "bounding box").select(F.col("ann_id").alias("id"), F.col("patch_id").alias("image"), "input", "output")
    return mixture.build_mixture(sm.split_by_patch(e, 0.1, SEED), radar.patch_categories(t.ann, t.cached), SEED)


@query(oracle(f"with {_MIXTURE} select * from mixture", "ann", "cached"))
def mixture_build(t: Tables) -> DataFrame:
    """General entries, radar questions and fusion questions of the given patches, split and repeated, as one training set."""
    return _built(t)


@query(oracle(f"""with {_MIXTURE} select category, count(*) as n_rows, round(count(*) * 100 / cast((select count(*) from mixture where split = 'train') as double), 6) as share_pct
    from mixture where split = 'train' group by category""", "ann", "cached"))
def mixture_build_shares(t: Tables) -> DataFrame:
    return an.mixture_report(_built(t).where("split = 'train'")).withColumn("share_pct", F.round("share_pct", 6))
