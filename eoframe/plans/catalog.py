"""Annotation table queries: scans, filters, label sets, instruction entries, profiles, mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import text
from eoframe.operators import annotations as an
from eoframe.operators import pairs as tp
from eoframe.plans.registry import query, sql_text
from eoframe.sources.adapters import Tables, oracle
from eoframe.sources.readers import read_annotations

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
PARTS = "string_split(patch_id, '_')"
TEMPLATES = "(values " + ", ".join(
    f"({sql_text(k)}, {sql_text(v)})" for k, v in fv.PROMPT_TEMPLATES.items()
).replace("\n", "' || chr(10) || '") + ") as tpl(type, template)"
HUMAN = "case when a.type = 'captioning' then tpl.template else replace(tpl.template, '{input}', a.input) end"


@query("select l_orderkey, l_partkey, l_quantity from lineitem")
def read_projected_scan(t: Tables) -> DataFrame:
    return read_annotations(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@query(oracle("select split, count(*) as n_rows, count(distinct patch_id) as n_patches from ann group by split", "ann"))
def annotation_scan(t: Tables) -> DataFrame:
    return t.ann.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("patch_id").alias("n_patches")
    )


@query(oracle("select ann_id, patch_id, type from ann where split = 'train'", "ann"))
def split_filter(t: Tables) -> DataFrame:
    return an.filter_split(t.ann, "train").select("ann_id", "patch_id", "type")


@query(oracle(f"""select ann_id, patch_id, {STRIP.format('input')} as label from ann
    where type = 'binary' and lower({STRIP.format('output')}) = 'yes'""", "ann"))
def positive_label_rows(t: Tables) -> DataFrame:
    return an.positive_labels(t.ann).select("ann_id", "patch_id", text.strip(F.col("input")).alias("label"))


@query(oracle("select type, count(*) as n_rows from ann where type in ('binary', 'mcq') group by type", "ann"))
def known_template_filter(t: Tables) -> DataFrame:
    some = {k: fv.PROMPT_TEMPLATES[k] for k in ("binary", "mcq")}
    return an.known_types(t.ann, some).groupBy("type").agg(F.count(F.lit(1)).alias("n_rows"))


@query(oracle("""select patch_id, strftime(try_strptime(regexp_extract(patch_id, '(\\d{8})T\\d{6}', 1), '%Y%m%d'), '%Y-%m-%d')
      as date_text, regexp_extract(patch_id, '(\\d{8})T\\d{6}', 1) as date_str, """ + f"""{PARTS}[6] as tile,
      {PARTS}[7] as pixel_x, {PARTS}[8] as pixel_y, {PARTS}[6] || '_' || {PARTS}[7] || '_' || {PARTS}[8] as location_key
    from patches""", "patches"))
def patch_id_parse(t: Tables) -> DataFrame:
    return tp.parse_patch_id(t.patches.select("patch_id")).select(
        "patch_id", F.date_format("date", "yyyy-MM-dd").alias("date_text"), "date_str", "tile", "pixel_x", "pixel_y",
        "location_key",
    )


@query(oracle(f"""select a.type || '_' || patch_id || '_' || ann_id as id, patch_id as image, s1_name,
      {HUMAN} as human, output as gpt from ann a join {TEMPLATES} on a.type = tpl.type where split = 'train'""", "ann"))
def instruction_entries(t: Tables) -> DataFrame:
    return an.format_instructions(an.filter_split(t.ann, "train")).select(
        "id", "image", "s1_name", F.col("conversations")[0]["value"].alias("human"),
        F.col("conversations")[1]["value"].alias("gpt"),
    )


def _unified(t: Tables) -> DataFrame:
    """Ready conversations for captioning rows, question/answer columns for the others."""
    a = t.ann
    ready = an.format_instructions(a.filter(F.col("type") == "captioning")).select(
        "image", "conversations", F.lit("general").alias("category")
    )
    raw = a.filter(F.col("type") != "captioning").select(
        F.col("patch_id").alias("image"), "input", "output",
        F.when(F.col("category") != "season", F.col("category")).alias("category"),
    )
    return an.to_conversations(ready.unionByName(raw, allowMissingColumns=True))


_UNIFIED = f"""unified as (
    select patch_id as image, {HUMAN} as human, output as gpt, 'general' as category
    from ann a join {TEMPLATES} on a.type = tpl.type where a.type = 'captioning'
    union all
    select patch_id, '<image>' || chr(10) || input, output, case when category = 'season' then 'unknown' else category end
    from ann where type <> 'captioning')"""


@query(oracle(f"with {_UNIFIED} select image, human, gpt, category from unified", "ann"))
def unified_conversations(t: Tables) -> DataFrame:
    return _unified(t).select(
        "image", F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"),
        "category",
    )


@query(oracle(f"""with {_UNIFIED}
    select image, '<|im_start|>user' || chr(10) || human || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
      || gpt || '<|im_end|>' || chr(10) as chat, cast(null as varchar) as reject_reason from unified
    union all select patch_id, null, 'expected 2 turns, got ' || case when l_suppkey % 2 = 0 then '3' else '1' end from ann where type = 'mcq'""", "ann"))
def chat_rendering(t: Tables) -> DataFrame:
    """All entries, and those of one type again with a turn too many or too few, which are rejected."""
    def turn(who: str, column: str) -> F.Column:
        return F.struct(F.lit(who).alias("from"), F.col(column).alias("value"))

    odd = F.when(F.col("l_suppkey") % 2 == 0, F.array(turn("human", "input"), turn("gpt", "output"), turn("human", "input")))
    torn = t.ann.filter(F.col("type") == "mcq").select(
        F.col("patch_id").alias("image"), odd.otherwise(F.array(turn("human", "input"))).alias("conversations"))
    return an.render_chat(_unified(t).select("image", "conversations").unionByName(torn)).select("image", "chat", "reject_reason")


@query(oracle(f"""with {_UNIFIED}
    select case when contains(human, 'yes/no question') then 'binary' when contains(human, 'multiple-choice') then 'mcq'
      when contains(human, 'Describe this satellite') then 'captioning' when contains(human, 'bounding box')
      then 'bounding box' else 'other' end as prompt_type, count(*) as n_rows from unified group by 1""", "ann"))
def prompt_type_counts(t: Tables) -> DataFrame:
    human = F.col("conversations")[0]["value"]
    return _unified(t).groupBy(text.infer_prompt_type(human).alias("prompt_type")).agg(F.count(F.lit(1)).alias("n_rows"))


# --- joins ------------------------------------------------------------------------------------------------------------

@query(oracle("select ann_id, patch_id from ann where patch_id in (select patch_id from cached)", "ann", "cached"))
def imaged_annotations(t: Tables) -> DataFrame:
    return an.keep_patches(t.ann.select("ann_id", "patch_id"), t.cached)


@query(oracle("""select patch_id from cached where patch_id not in (select patch_id from ann where split = 'train')
    and patch_id not in (select patch_id from ann where split = 'validation')""", "ann", "cached"))
def unseen_patches(t: Tables) -> DataFrame:
    return an.unseen_patches(t.cached, an.filter_split(t.ann, "train"), an.filter_split(t.ann, "validation"))


_FIRST = """firsts as (select patch_id, arg_min(country, ann_id) filter (where country is not null) as country,
    arg_min(latitude, ann_id) as latitude, arg_min(longitude, ann_id) as longitude from ann group by patch_id)"""


@query(oracle(f"""with {_FIRST} select c.patch_id, coalesce(country, 'none') as country, coalesce(latitude, -999) as latitude,
    coalesce(longitude, -999) as longitude from cached c left join firsts f on c.patch_id = f.patch_id""", "ann", "cached"))
def patch_attribute_lookup(t: Tables) -> DataFrame:
    attrs = an.first_per_patch(t.ann, ["country", "latitude", "longitude"])
    return an.attach_patch_attrs(t.cached, attrs).select(
        "patch_id", F.coalesce("country", F.lit("none")).alias("country"),
        F.coalesce("latitude", F.lit(-999.0)).alias("latitude"), F.coalesce("longitude", F.lit(-999.0)).alias("longitude"),
    )


@query(oracle("""with s as (select patch_id, split from ann where split in ('train', 'validation', 'bench')
      group by patch_id, split)
    select patch_id, count(*) as n_splits, string_agg(split, ',' order by split) as splits from s group by patch_id
    having count(*) > 1""", "ann"))
def split_leakage(t: Tables) -> DataFrame:
    """Patches in more than one of train, validation and bench (three values, so the set is bounded)."""
    rows = t.ann.filter(F.col("split").isin("train", "validation", "bench"))
    sets = rows.groupBy("patch_id").agg(F.sort_array(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    return sets.select("patch_id", F.size("s").cast("bigint").alias("n_splits"), F.array_join("s", ",").alias("splits"))


# --- aggregates -------------------------------------------------------------------------------------------------------

@query(oracle("""with tr as (select * from ann where split = 'train')
    select 'total_annotations' as metric, 'all' as key, count(*) as value from ann
    union all select 'train_annotations', 'all', count(*) from tr
    union all select 'unique_patches', 'all', count(distinct patch_id) from tr
    union all select 'rows_by_type', type, count(*) from tr group by type
    union all select 'rows_by_category', category, count(*) from tr group by category""", "ann"))
def annotation_profile(t: Tables) -> DataFrame:
    return an.profile_annotations(t.ann)


@query(oracle(f"with {_FIRST} select patch_id, coalesce(country, 'none') as country from firsts", "ann"))
def first_known_country(t: Tables) -> DataFrame:
    return an.first_per_patch(t.ann, ["country"]).select("patch_id", F.coalesce("country", F.lit("none")).alias("country"))


@query(oracle("""select patch_id, coalesce(country, 'none') as country from
    (select patch_id, country, row_number() over (partition by patch_id order by ann_id) as rn from ann) where rn = 1""", "ann"))
def first_row_country(t: Tables) -> DataFrame:
    return an.first_per_patch(t.ann, ["country"], skip_nulls=False).select(
        "patch_id", F.coalesce("country", F.lit("none")).alias("country")
    )


LABEL_SETS = f"""labelsets as (select patch_id, string_agg(label, '|' order by label) as labels, count(*) as n_labels from
    (select distinct patch_id, {STRIP.format('input')} as label from ann
     where type = 'binary' and lower({STRIP.format('output')}) = 'yes') group by patch_id)"""


@query(oracle(f"with {LABEL_SETS} select patch_id, labels, n_labels from labelsets", "ann"))
def label_sets(t: Tables) -> DataFrame:
    return an.label_sets(t.ann).select(
        "patch_id", F.array_join("labels", "|").alias("labels"), F.size("labels").cast("bigint").alias("n_labels")
    )


@query(oracle("""select patch_id, (select string_agg(x, ',' order by x) from unnest(types) as u(x)) as types,
      (select string_agg(x, ',' order by x) from unnest(cats) as u(x)) as categories
    from (select patch_id, list(distinct type) as types, list(distinct category) as cats from ann group by patch_id)""", "ann"))
def types_per_patch(t: Tables) -> DataFrame:
    return an.types_per_patch(t.ann).select(
        "patch_id", F.array_join("types", ",").alias("types"), F.array_join("categories", ",").alias("categories")
    )


@query(oracle(f"""select {STRIP.format('input')} as label, count(distinct patch_id) as n_patches from ann
    where type = 'binary' and lower({STRIP.format('output')}) = 'yes' group by 1""", "ann"))
def class_statistics(t: Tables) -> DataFrame:
    return an.class_statistics(an.label_sets(t.ann))


@query(oracle("select patch_id, s1_name from (select image as patch_id, arg_max(s1_name || '#' || (length(id) % 3), id) as s1_name "
              "from entries group by image)", "entries"))
def patch_manifest(t: Tables) -> DataFrame:
    entries = t.entries.withColumn(
        "s1_name", F.concat("s1_name", F.lit("#"), (F.length("id") % 3).cast("string"))
    )
    return an.build_manifest(entries, "id")


@query(oracle("select distinct image as patch_id from entries where source_split = 'train'", "entries"))
def required_patches(t: Tables) -> DataFrame:
    return an.required_patches(t.entries.filter(F.col("source_split") == "train"))


# --- mixtures ---------------------------------------------------------------------------------------------------------

def _mixture(t: Tables) -> DataFrame:
    e = t.entries.select("id", "image", "task_type", "source_split")
    radar = an.oversample(e.filter(F.col("task_type") == "binary"), 2)
    return an.mix({
        "general": e.filter(F.col("source_split") == "train"),
        "sar": radar,
        "fusion": e.filter(F.col("task_type") == "captioning").drop("source_split"),
    })


_MIX = """mixture as (
    select id, 'general' as category, cast(null as bigint) as copy from entries where source_split = 'train'
    union all select id, 'sar', c from entries cross join (values (1), (2)) as k(c) where task_type = 'binary'
    union all select id, 'fusion', null from entries where task_type = 'captioning')"""


@query(oracle(f"with {_MIX} select id, category, coalesce(copy, 0) as copy from mixture", "entries"))
def mixture_rows(t: Tables) -> DataFrame:
    return _mixture(t).select("id", "category", F.coalesce(F.col("copy").cast("bigint"), F.lit(0)).alias("copy"))


@query(oracle("select id, c as copy from entries cross join (values (1), (2), (3)) as k(c) where task_type = 'binary'", "entries"))
def oversampled_rows(t: Tables) -> DataFrame:
    return an.oversample(t.entries.filter(F.col("task_type") == "binary").select("id"), 3)


@query(oracle(f"""with {_MIX} select category, count(*) as n_rows,
    round(count(*) * 100 / cast((select count(*) from mixture) as double), 6) as share_pct from mixture group by category""", "entries"))
def mixture_report(t: Tables) -> DataFrame:
    return an.mixture_report(_mixture(t)).withColumn("share_pct", F.round("share_pct", 6))
