"""Evaluation metrics and audits over predictions, captions, detections and instruction entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import geometry, text
from eoframe.operators import annotations as an
from eoframe.operators import metadata as md
from eoframe.operators import metrics as mt
from eoframe.plans.catalog import HUMAN, TEMPLATES
from eoframe.plans.registry import contains_sql, query
from eoframe.sources.adapters import Tables, oracle


def _n(col: str) -> str:
    return rf"lower(regexp_replace({col}, '^\s+|\s+$', '', 'g'))"


def _box(col: str) -> str:
    return rf"list_transform(regexp_extract_all({col}, '[\d.]+')[1:4], lambda x: try_cast(x as double))"


def _w(col: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({col}), '\s+'), lambda x: x <> ''))"


_SIDE = "greatest(cast(0 as double), {0})"
_INTER = (_SIDE.format("least(p[3], r[3]) - greatest(p[1], r[1])") + " * " + _SIDE.format("least(p[4], r[4]) - greatest(p[2], r[2])"))
_UNION = "{0} * {1} + {2} * {3} - inter".format(
    _SIDE.format("p[3] - p[1]"), _SIDE.format("p[4] - p[2]"), _SIDE.format("r[3] - r[1]"), _SIDE.format("r[4] - r[2]")
)
SCORED = f"""raw as (select *, {_n('prediction')} as pn, {_n('reference')} as rn, {_box('prediction')} as p0, {_box('reference')} as r0,
      {_w('prediction')} as pw, {_w('reference')} as rw from pred),
    boxed as (select *, case when list_contains(list_transform(p0, lambda x: x is null), true) then [] else p0 end as p,
      case when list_contains(list_transform(r0, lambda x: x is null), true) then [] else r0 end as r from raw),
    i1 as (select *, {_INTER} as inter from boxed),
    scored as (select *, case when len(p) = 4 and len(r) = 4 and {_UNION} > 0 then inter / ({_UNION}) else cast(0 as double) end as iou,
      case when len(rw) > 0 then len(list_filter(rw, lambda x: list_contains(pw, x))) / cast(len(rw) as double) end as recall_w from i1)"""
_F1 = """precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1"""


def _aligned(t: Tables) -> DataFrame:
    p = t.pred
    return mt.align_predictions(p.select("ann_id", "prediction"), p.drop("prediction"))


@query(oracle("select ann_id, type, reference, prediction from pred", "pred"))
def aligned_predictions(t: Tables) -> DataFrame:
    return _aligned(t).select("ann_id", "type", "reference", "prediction")


@query(oracle(f"""with {SCORED} select category, count(*) filter (where pn = rn) / cast(count(*) as double) as accuracy, count(*) as n_samples
    from scored group by category""", "pred"))
def accuracy_by_category(t: Tables) -> DataFrame:
    return mt.accuracy(_aligned(t), ["category"])


@query(oracle(f"""with {SCORED}, c as (select category, count(*) filter (where rn = 'yes' and pn = 'yes') as tp,
      count(*) filter (where rn <> 'yes' and pn = 'yes') as fp, count(*) filter (where rn = 'yes' and pn <> 'yes') as fn,
      count(*) filter (where rn <> 'yes' and pn <> 'yes') as tn, count(*) as n from scored where type = 'binary' group by category),
    m as (select category, tp, fp, fn, tn, (tp + tn) / cast(n as double) as accuracy,
      case when tp + fp > 0 then tp / cast(tp + fp as double) else 0 end as precision,
      case when tp + fn > 0 then tp / cast(tp + fn as double) else 0 end as recall from c)
    select category, tp, fp, fn, tn, accuracy, {_F1} from m""", "pred"))
def binary_scores(t: Tables) -> DataFrame:
    return mt.binary_f1(_aligned(t).filter(F.col("type") == "binary"), ["category"]).drop("n_samples")


@query(oracle(f"select ann_id, cast(len(p) as bigint) as n_numbers, coalesce(round(list_sum(p), 9), -1) as total from "
              f"(select ann_id, case when list_contains(list_transform(p0, lambda x: x is null), true) then [] else p0 end as p "
              f"from (select ann_id, {_box('prediction')} as p0 from pred))", "pred"))
def parsed_boxes(t: Tables) -> DataFrame:
    p = text.parse_bbox(F.col("prediction"))
    total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
    return t.pred.select(
        "ann_id", F.size(p).cast("bigint").alias("n_numbers"),
        F.when(F.size(p) > 0, F.round(total, 9)).otherwise(F.lit(-1.0)).alias("total"),
    )


@query(oracle(f"""with {SCORED} select category, round(avg(iou), 9) as mean_iou,
      count(*) filter (where iou >= 0.5) / cast(count(*) as double) as precision_at_iou, count(*) as n_samples
    from scored where type = 'bounding box' group by category""", "pred"))
def box_scores(t: Tables) -> DataFrame:
    out = mt.bbox_metrics(_aligned(t).filter(F.col("type") == "bounding box"), 0.5, ["category"])
    return out.withColumn("mean_iou", F.round("mean_iou", 9))


@query(oracle(f"""with {SCORED} select category, round(coalesce(avg(recall_w), 0), 9) as word_recall, count(*) as n_samples
    from scored where type = 'captioning' group by category""", "pred"))
def caption_word_recall(t: Tables) -> DataFrame:
    out = mt.word_recall(_aligned(t).filter(F.col("type") == "captioning"), ["category"])
    return out.withColumn("word_recall", F.round("word_recall", 9))


_REPORT = f"""{SCORED}, c as (select type, count(*) filter (where rn = 'yes' and pn = 'yes') as tp,
      count(*) filter (where rn <> 'yes' and pn = 'yes') as fp, count(*) filter (where rn = 'yes' and pn <> 'yes') as fn,
      count(*) filter (where rn <> 'yes' and pn <> 'yes') as tn, count(*) as n, count(*) filter (where pn = rn) as same,
      avg(iou) as mean_iou, count(*) filter (where iou >= 0.5) as hits, coalesce(avg(recall_w), 0) as wr from scored group by type),
    m as (select *, case when tp + fp > 0 then tp / cast(tp + fp as double) else 0 end as precision,
      case when tp + fn > 0 then tp / cast(tp + fn as double) else 0 end as recall from c)
    select 'type' as scope, type as name, 'accuracy' as metric, round((tp + tn) / cast(n as double), 9) as value from m where type = 'binary'
    union all select 'type', type, 'precision', round(precision, 9) from m where type = 'binary'
    union all select 'type', type, 'recall', round(recall, 9) from m where type = 'binary'
    union all select 'type', type, 'f1', round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9)
      from m where type = 'binary'
    union all select 'type', type, 'accuracy', round(same / cast(n as double), 9) from m where type = 'mcq'
    union all select 'type', type, 'mean_iou', round(mean_iou, 9) from m where type = 'bounding box'
    union all select 'type', type, 'precision_at_iou', round(hits / cast(n as double), 9) from m where type = 'bounding box'
    union all select 'type', type, 'word_recall', round(wr, 9) from m where type = 'captioning'
    union all select 'type', type, 'n_samples', n from m where type = 'captioning'
    union all select 'category', category, 'accuracy', round(count(*) filter (where pn = rn) / cast(count(*) as double), 9) from scored group by category
    union all select 'category', category, 'n_samples', count(*) from scored group by category"""


@query(oracle(f"with {_REPORT}", "pred"))
def evaluation_report(t: Tables) -> DataFrame:
    return mt.evaluation_report(_aligned(t)).withColumn("value", F.round("value", 9))


# --- multi-label ------------------------------------------------------------------------------------------------------

_CLASSES = ["Urban fabric", "Arable land", "Pastures", "Coniferous forest", "Inland waters"]
_ML_SQL = f"""s as (select ann_id, list_filter([{", ".join(f"case when l_partkey % {i + 2} = 0 then '{c}' end" for i, c in enumerate(_CLASSES))}],
      lambda x: x is not null) as truth,
    [{", ".join(f"{{'class': '{c}', 'prob': cast((l_suppkey * {7 + i} + l_partkey) % 100 as double) / 100}}" for i, c in enumerate(_CLASSES))}] as probs
    from ann where type = 'captioning'),
    p as (select *, list_transform(list_filter(probs, lambda x: x.prob >= 0.35), lambda x: x.class) as predicted from s)"""


def _multilabel(t: Tables) -> DataFrame:
    rows = t.ann.filter(F.col("type") == "captioning")
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    truth = F.array_compact(F.array(*[F.when(pk % (i + 2) == 0, F.lit(c)) for i, c in enumerate(_CLASSES)]))
    probs = F.array(*[
        F.struct(F.lit(c).alias("class"), (((sk * (7 + i) + pk) % 100).cast("double") / 100).alias("prob"))
        for i, c in enumerate(_CLASSES)
    ])
    return rows.select("ann_id", truth.alias("truth"), md.threshold_labels(probs).alias("predicted"))


@query(oracle(f"with {_ML_SQL} select ann_id, array_to_string(predicted, '|') as predicted from p", "ann"))
def thresholded_labels(t: Tables) -> DataFrame:
    return _multilabel(t).select("ann_id", F.array_join("predicted", "|").alias("predicted"))


@query(oracle(f"""with {_ML_SQL}, h as (select *, len(list_filter(truth, lambda x: list_contains(predicted, x))) as hit from p),
    m as (select *, case when len(predicted) > 0 then hit / cast(len(predicted) as double) else 0 end as precision,
      case when len(truth) > 0 then hit / cast(len(truth) as double) else 0 end as recall from h),
    f as (select {_F1} from m)
    select count(*) as n_samples, count(*) filter (where f1 >= 0.5) as n_good, round(avg(precision), 9) as mean_precision,
      round(avg(recall), 9) as mean_recall, round(avg(f1), 9) as mean_f1 from f""", "ann"))
def multilabel_scores(t: Tables) -> DataFrame:
    out = mt.multilabel_prf(_multilabel(t))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_precision", "mean_recall", "mean_f1")})


@query(oracle(f"""with {_ML_SQL} select ann_id, 'This satellite image shows a landscape characterized by ' ||
      lower(array_to_string(predicted, ', ')) || '. The dominant feature is ' || lower(predicted[1]) || '.' as caption
    from p where len(predicted) > 0""", "ann"))
def template_captions(t: Tables) -> DataFrame:
    some = _multilabel(t).filter(F.size("predicted") > 0)
    return some.select("ann_id", md.template_caption(F.col("predicted"), F.col("predicted")[0]).alias("caption"))


# --- audits -----------------------------------------------------------------------------------------------------------

_AUDIT = f"""au as (select ann_id, a.category, lower({HUMAN}) as q, regexp_replace(output, '^\\s+|\\s+$', '', 'g') as ans
      from ann a join {TEMPLATES} on a.type = tpl.type where split = 'train'),
    ty as (select *, case when contains(q, 'answer with') and (contains(q, 'yes') or contains(q, 'no')) then 'binary_yn'
      when {contains_sql('q', fv.AUDIT_MCQ_PHRASES)} then 'mcq' when {contains_sql('q', fv.AUDIT_DESCRIPTION_PHRASES)} then 'description'
      when {contains_sql('q', fv.AUDIT_OPEN_PHRASES)} then 'open_vqa' when contains(q, 'caption') then 'caption' else 'other' end as audit_type,
      len(list_filter(regexp_split_to_array(ans, '\\s+'), lambda x: x <> '')) as words from au)"""


def _entries(t: Tables) -> DataFrame:
    return an.format_instructions(an.filter_split(t.ann, "train"), keep=("ann_id", "category"))


@query(oracle(f"with {_AUDIT} select ann_id, audit_type from ty", "ann"))
def audit_task_types(t: Tables) -> DataFrame:
    return mt.audit_task_type(_entries(t)).select("ann_id", "audit_type")


@query(oracle(f"""with {_AUDIT} select audit_type, category, count(*) as n, cast(median(words) as double) as median_words,
      round(avg(words), 9) as mean_words, max(words) as max_words, count(*) filter (where words <= 1) as single_token,
      count(*) filter (where words <= 5) as short_le5, count(*) filter (where words > 5 and words <= 30) as medium_6_30,
      count(*) filter (where words > 30) as long_gt30,
      count(*) filter (where {contains_sql('lower(ans)', fv.COUNTRY_WORDS)}) as has_country,
      count(*) filter (where {contains_sql('lower(ans)', fv.SEASON_WORDS)}) as has_season,
      count(*) filter (where {contains_sql('lower(ans)', fv.MEASUREMENT_WORDS)}) as has_measurement
    from ty group by audit_type, category""", "ann"))
def answer_audit(t: Tables) -> DataFrame:
    return mt.audit_answers(_entries(t)).withColumn("mean_words", F.round("mean_words", 9))


@query(oracle(f"""with {_AUDIT}, r as (select *, row_number() over (partition by audit_type, category order by ann_id) as example from ty)
    select audit_type, category, example, substr(ans, 1, 120) as sample_answer,
      substr(case when contains(q, chr(10)) then regexp_replace(string_split(q, chr(10))[-1], '^\\s+|\\s+$', '', 'g') else q end, 1, 80)
      as sample_question from r where example <= 3""", "ann"))
def audit_examples(t: Tables) -> DataFrame:
    return mt.audit_examples(_entries(t), "ann_id")


@query(oracle(f"""select type, round(avg(len(prediction)), 9) as avg_length, cast(min(len(prediction)) as bigint) as min_length,
      cast(max(len(prediction)) as bigint) as max_length,
      round(avg({" + ".join(f"cast(contains(lower(prediction), '{w}') as int)" for w in fv.CAPTION_KEYWORDS)}), 9) as avg_keywords
    from pred group by type""", "pred"))
def caption_quality(t: Tables) -> DataFrame:
    out = mt.caption_quality(t.pred.withColumn("caption", F.col("prediction")), by=["type"])
    return out.withColumns({"avg_length": F.round("avg_length", 9), "avg_keywords": F.round("avg_keywords", 9),
                            "min_length": F.col("min_length").cast("bigint"), "max_length": F.col("max_length").cast("bigint")})


@query("""with s as (select l_returnflag = 'A' as is_same, l_tax * 5 + l_discount as score from lineitem)
    select round(avg(score) filter (where is_same), 9) as same_mean, round(avg(score) filter (where not is_same), 9) as diff_mean,
      count(*) filter (where (is_same and score < 0.5) or (not is_same and score > 0.5)) as n_correct, count(*) as n_total,
      round(avg(score) filter (where not is_same) - avg(score) filter (where is_same), 9) as separation from s""")
def change_score_separation(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        (F.col("l_returnflag") == "A").alias("is_same"), (F.col("l_tax") * 5 + F.col("l_discount")).alias("score")
    )
    out = mt.change_separation(rows)
    return out.withColumns({c: F.round(c, 9) for c in ("same_mean", "diff_mean", "separation")})


@query("""with s as (select 1 - l_discount as o, l_discount as s, l_tax * 5 as d from lineitem)
    select round(avg(o), 9) as optical_mean, round(avg(s), 9) as sar_mean, round(avg(d), 9) as distance_mean, count(*) as n_total,
      count(*) filter (where d > 0.3) as n_disagreements from s""")
def modality_contributions(t: Tables) -> DataFrame:
    d = F.col("l_discount")
    rows = t.lineitem.select((1 - d).alias("optical_contribution"), d.alias("sar_contribution"),
                             (F.col("l_tax") * 5).alias("modality_distance"))
    out = mt.contribution_summary(rows)
    return out.withColumns({c: F.round(c, 9) for c in ("optical_mean", "sar_mean", "distance_mean")})


_RUNS = """runs as (
    select 'category ' || category as metric, 'exp1' as experiment,
      cast(count(*) filter (where lower(prediction) = lower(reference)) as varchar(20)) as value, true as higher from pred group by category
    union all select 'category ' || category, 'exp2', cast(count(*) filter (where type = 'mcq') as varchar(20)), true from pred group by category
    union all select 'errors ' || type, 'exp1', cast(count(*) filter (where lower(prediction) <> lower(reference)) as varchar(20)), false from pred group by type
    union all select 'errors ' || type, 'exp2', cast(count(*) filter (where category = 'area') as varchar(20)), false from pred group by type
    union all select 'share', e, cast(count(*) as varchar(20)) || '/100', true from pred cross join (values ('exp1'), ('exp2')) as v(e) group by e)"""


@query(oracle(f"""with {_RUNS}, w as (select metric, higher, max(value) filter (where experiment = 'exp1') as exp1,
      max(value) filter (where experiment = 'exp2') as exp2 from runs group by metric, higher)
    select metric, exp1, exp2, case when try_cast(exp1 as double) is null or try_cast(exp2 as double) is null then '--'
      when try_cast(exp1 as double) = try_cast(exp2 as double) then 'Tie'
      when (try_cast(exp1 as double) > try_cast(exp2 as double)) = higher then 'exp1' else 'exp2' end as winner from w""", "pred"))
def run_comparison(t: Tables) -> DataFrame:
    p, same = t.pred, F.lower("prediction") == F.lower("reference")

    def rows(key, label, exp, cond, higher):
        return p.groupBy(F.concat(F.lit(label), F.col(key)).alias("metric")).agg(F.count_if(cond).alias("v")).select(
            "metric", F.lit(exp).alias("experiment"), F.col("v").cast("string").alias("value"), F.lit(higher).alias("higher_is_better"))

    share = p.agg(F.count(F.lit(1)).alias("v")).select(
        F.lit("share").alias("metric"), F.explode(F.array(F.lit("exp1"), F.lit("exp2"))).alias("experiment"),
        F.concat(F.col("v").cast("string"), F.lit("/100")).alias("value"), F.lit(True).alias("higher_is_better"))
    runs = (
        rows("category", "category ", "exp1", same, True)
        .union(rows("category", "category ", "exp2", F.col("type") == "mcq", True))
        .union(rows("type", "errors ", "exp1", ~same, False))
        .union(rows("type", "errors ", "exp2", F.col("category") == "area", False))
        .union(share)
    )
    return mt.compare_runs(runs, "exp1", "exp2").drop("higher_is_better")


@query(oracle("""with r as (select pk % 4 as n_boxes, pk % 9 <> 0 as valid, case when sk % 31 = 0 then 'timeout' end as error,
      confidence as latency from detections)
    select count(*) as n_runs, count(error) as n_errors, count(*) filter (where error is null and valid) as n_valid_geometry,
      cast(sum(n_boxes) filter (where error is null) as bigint) as n_boxes, round(avg(latency) filter (where error is null), 9) as mean_latency_s,
      case when count(error) = 0 and count(*) filter (where valid) = count(*) then 'GOOD' else 'NEEDS WORK' end as verdict from r""", "detections"))
def detection_summary(t: Tables) -> DataFrame:
    d = t.detections.select(
        (F.col("pk") % 4).alias("n_boxes"), (F.col("pk") % 9 != 0).alias("valid_boxes"),
        F.when(F.col("sk") % 31 == 0, F.lit("timeout")).alias("error"), F.col("confidence").alias("latency_s"))
    return mt.detection_summary(d).withColumn("mean_latency_s", F.round("mean_latency_s", 9))


@query(oracle("""select ann_id, case when a like '%yes%' then 'yes' when a like '%no%' then 'no' else a end as answer from (
    select ann_id, lower(trim(case when l_suppkey % 5 = 0 then 'unknown' else output end)) as a from ann where type = 'binary')""", "ann"))
def yes_no_answers(t: Tables) -> DataFrame:
    rows = t.ann.filter(F.col("type") == "binary")
    answer = F.when(F.col("l_suppkey") % 5 == 0, F.lit("unknown")).otherwise(F.col("output"))
    return rows.select("ann_id", text.normalize_yes_no(answer).alias("answer"))


# --- detections -------------------------------------------------------------------------------------------------------

def _detection_lists(t: Tables) -> DataFrame:
    """Two detections per row, the second without a label for some rows and without a box for others."""
    x, y, pk = F.col("x"), F.col("y"), F.col("pk")
    kind = "struct<box:array<double>,label:string,confidence:double>"
    one = F.struct(F.array(x, y, x + 0.3, y + 0.25).alias("box"), F.col("label").alias("label"), F.col("confidence").alias("confidence"))
    two = F.struct(
        F.when(pk % 5 != 0, F.array(x / 3, y / 3, x, y)).alias("box"), F.when(pk % 3 != 0, F.col("label")).alias("label"),
        (F.col("confidence") / 3).alias("confidence"))
    return t.detections.select("ann_id", F.array(one.cast(kind), two.cast(kind)).alias("detections"))


@query(oracle("""select ann_id, 0 as i, label, round(confidence, 3) as confidence, round(x, 4) as x1, round(y + 0.25e0, 4) as y2,
      round(x + 0.3e0, 4) as x2, round(y, 4) as y1 from detections
    union all select ann_id, 1, case when pk % 3 <> 0 then label else 'unknown' end, round(confidence / 3, 3),
      round(case when pk % 5 <> 0 then x / 3 else 0 end, 4), round(case when pk % 5 <> 0 then y else 1 end, 4),
      round(case when pk % 5 <> 0 then x else 1 end, 4), round(case when pk % 5 <> 0 then y / 3 else 0 end, 4) from detections""", "detections"))
def served_boxes(t: Tables) -> DataFrame:
    rows = _detection_lists(t).select("ann_id", F.posexplode(geometry.format_boxes(F.col("detections"))).alias("i", "b"))
    return rows.select("ann_id", "i", "b.label", "b.confidence", "b.x1", "b.y2", "b.x2", "b.y1")


@query(oracle("select ann_id, round((confidence + confidence / 3) / 2, 9) as mean_confidence from detections", "detections"))
def mean_box_confidence(t: Tables) -> DataFrame:
    mean = geometry.mean_box_confidence(F.col("detections"))
    return _detection_lists(t).select("ann_id", F.round(mean, 9).alias("mean_confidence"))
