"""Evaluation metrics and audits. Every operator is one or two aggregations with map-side combine; ``by`` adds keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe import fixed_values as fv
from eoframe.functions import geometry, text
from eoframe.functions.positions import in_file_order
from eoframe.functions.ranking import first_k_per_key
from eoframe.operators.annotations import last_turn


def align_predictions(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Pair predictions with references by annotation id instead of by position."""
    return ref.join(pred.select("ann_id", "prediction"), "ann_id")


def align_by_position(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Pair the rows of two file scans that hold predictions and references in the same order and have no id in common.

    Places are counted over all files of a scan. Rows without a partner, where one side has more, come with a null other side.
    """
    left, right = in_file_order(ref), in_file_order(pred)
    return left.join(right, "pos", "full")


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def _p() -> Column:
    return text.norm(F.coalesce("prediction", F.lit("")))


def _r() -> Column:
    return text.norm(F.coalesce("reference", F.lit("")))


def _accuracy() -> Column:
    return _ratio(F.count_if(_p() == _r()), F.count(F.lit(1)))


def accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(_accuracy().alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))


def _confusion() -> list[Column]:
    yes_p, yes_r = _p() == "yes", _r() == "yes"
    return [
        F.count_if(yes_r & yes_p).alias("tp"), F.count_if(~yes_r & yes_p).alias("fp"),
        F.count_if(yes_r & ~yes_p).alias("fn"), F.count_if(~yes_r & ~yes_p).alias("tn"),
    ]


def binary_f1(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Anything but "yes" counts as no on both sides; empty denominators give 0."""
    c = F.col
    counts = df.groupBy(*(by or [])).agg(*_confusion(), F.count(F.lit(1)).alias("n_samples"))
    scored = counts.withColumns(
        {
            "accuracy": _ratio(c("tp") + c("tn"), c("n_samples")),
            "precision": _ratio(c("tp"), c("tp") + c("fp")),
            "recall": _ratio(c("tp"), c("tp") + c("fn")),
        }
    )
    return scored.withColumn("f1", _f1(c("precision"), c("recall")))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2.0 * p * r, p + r)


def with_iou(df: DataFrame) -> DataFrame:
    p = text.parse_bbox(F.coalesce("prediction", F.lit("")))
    r = text.parse_bbox(F.coalesce("reference", F.lit("")))
    return df.withColumn("iou", geometry.list_iou(p, r))


def bbox_metrics(df: DataFrame, iou: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Mean IoU and share at the threshold; malformed boxes score 0 and still count."""
    return with_iou(df).groupBy(*(by or [])).agg(
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"),
        _ratio(F.count_if(F.col("iou") >= iou), F.count(F.lit(1))).alias("precision_at_iou"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def with_word_recall(df: DataFrame) -> DataFrame:
    p = F.array_distinct(text.words_of(F.lower("prediction")))
    r = F.array_distinct(text.words_of(F.lower("reference")))
    return df.withColumn(
        "word_recall", F.when(F.size(r) > 0, F.try_divide(F.size(F.array_intersect(p, r)), F.size(r)))
    )


def word_recall(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of the reference's words found; empty references are left out of the mean but counted."""
    return with_word_recall(df).groupBy(*(by or [])).agg(
        F.coalesce(F.avg("word_recall"), F.lit(0.0)).alias("word_recall"), F.count(F.lit(1)).alias("n_samples")
    )


def evaluation_report(aligned: DataFrame) -> DataFrame:
    """Long form (scope, name, metric, value): the metric set of each type, then accuracy per category.

    Both groupings come from one aggregation by (type, category); its few rows are summed up per type and category.
    """
    c = F.col
    rows = with_word_recall(with_iou(aligned))
    base = rows.groupBy("type", "category").agg(
        *_confusion(), F.count(F.lit(1)).alias("n"), F.count_if(_p() == _r()).alias("same"),
        F.sum("iou").alias("iou_sum"), F.count_if(c("iou") >= 0.5).alias("iou_hits"),
        F.coalesce(F.sum("word_recall"), F.lit(0.0)).alias("wr_sum"), F.count("word_recall").alias("wr_n"),
    )

    def totals(key: str) -> DataFrame:
        names = ["tp", "fp", "fn", "tn", "n", "same", "iou_sum", "iou_hits", "wr_sum", "wr_n"]
        return base.groupBy(c(key).alias("name")).agg(*[F.sum(x).alias(x) for x in names])

    precision, recall = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("tp") + c("fn"))

    def pairs(**metrics: Column) -> Column:
        return F.map_from_entries(F.array(*[F.struct(F.lit(k), v.cast("double")) for k, v in metrics.items()]))

    per_type = totals("type").select(
        F.lit("type").alias("scope"), "name",
        F.explode(
            F.when(
                c("name") == "binary",
                pairs(accuracy=_ratio(c("tp") + c("tn"), c("n")), precision=precision, recall=recall,
                      f1=_f1(precision, recall)),
            )
            .when(c("name") == "mcq", pairs(accuracy=_ratio(c("same"), c("n"))))
            .when(
                c("name") == "bounding box",
                pairs(mean_iou=_ratio(c("iou_sum"), c("n")), precision_at_iou=_ratio(c("iou_hits"), c("n"))),
            )
            .when(c("name") == "captioning", pairs(word_recall=_ratio(c("wr_sum"), c("wr_n")), n_samples=c("n")))
        ).alias("metric", "value"),
    )
    per_category = totals("category").select(
        F.lit("category").alias("scope"), "name",
        F.explode(pairs(accuracy=_ratio(c("same"), c("n")), n_samples=c("n"))).alias("metric", "value"),
    )
    return per_type.union(per_category)


def multilabel_samples(df: DataFrame) -> DataFrame:
    """Per-sample precision, recall and F1 of two label arrays ``truth`` and ``predicted``."""
    hit = F.size(F.array_intersect("truth", "predicted"))
    precision = _ratio(hit, F.size(F.array_distinct("predicted")))
    recall = _ratio(hit, F.size(F.array_distinct("truth")))
    return df.withColumns({"precision": precision, "recall": recall, "f1": _f1(precision, recall)})


def multilabel_prf(df: DataFrame) -> DataFrame:
    """Means over samples. Samples at exactly 0.5 count as good although the report text says "over 0.5"."""
    return multilabel_samples(df).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("f1") >= 0.5).alias("n_good"),
        F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("mean_f1"),
    )


# --- audits -----------------------------------------------------------------------------------------------------------

def audit_task_type(entries: DataFrame) -> DataFrame:
    """question (last human turn, lower case), answer (last gpt turn, trimmed) and the audit task type."""
    q, a = F.lower(last_turn("human")), text.strip(last_turn("gpt"))
    return entries.withColumns({"question": q, "answer": a}).withColumn(
        "audit_type", text.audit_type(F.col("question"))
    )


def audit_answers(entries: DataFrame) -> DataFrame:
    """Answer lengths and claim words by task type and category. Answers of one word are also in the short bucket."""
    rows = audit_task_type(entries).withColumn("words", F.size(text.words_of(F.col("answer"))))
    low, n = F.lower("answer"), F.col("words")
    return rows.groupBy("audit_type", F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(n, F.lit(0.5)).alias("median_words"), F.avg(n).alias("mean_words"), F.max(n).alias("max_words"),
        F.count_if(n <= 1).alias("single_token"), F.count_if(n <= 5).alias("short_le5"),
        F.count_if((n > 5) & (n <= 30)).alias("medium_6_30"), F.count_if(n > 30).alias("long_gt30"),
        F.count_if(text.contains_any(low, fv.COUNTRY_WORDS)).alias("has_country"),
        F.count_if(text.contains_any(low, fv.SEASON_WORDS)).alias("has_season"),
        F.count_if(text.contains_any(low, fv.MEASUREMENT_WORDS)).alias("has_measurement"),
    )


def audit_examples(entries: DataFrame, order: str = "id", k: int = 3) -> DataFrame:
    """The first k questions and answers of each stratum in ``order`` (k rows per stratum leave each map task)."""
    from pyspark.sql import Window as W

    rows = audit_task_type(entries).withColumn("category", F.coalesce("category", F.lit("unknown")))
    w = W.partitionBy("audit_type", "category").orderBy(order)
    q = F.col("question")
    tail = F.when(q.contains("\n"), text.strip(F.substring_index(q, "\n", -1))).otherwise(q)
    return rows.withColumn("example", F.row_number().over(w)).filter(F.col("example") <= k).select(
        "audit_type", "category", "example", F.substring("answer", 1, 120).alias("sample_answer"),
        F.substring(tail, 1, 80).alias("sample_question"),
    )


def caption_quality(df: DataFrame, keywords: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    hits = text.hit_count(F.lower("caption"), keywords or fv.CAPTION_KEYWORDS)
    return df.groupBy(*(by or [])).agg(
        F.avg(F.length("caption")).alias("avg_length"), F.min(F.length("caption")).alias("min_length"),
        F.max(F.length("caption")).alias("max_length"), F.avg(hits).alias("avg_keywords"),
    )


def change_separation(df: DataFrame, cut: float = 0.5) -> DataFrame:
    """Mean change score of same-patch and different-patch tests over (is_same, score), their distance and accuracy."""
    same, score = F.col("is_same"), F.col("score")
    out = df.agg(
        F.avg(F.when(same, score)).alias("same_mean"), F.avg(F.when(~same, score)).alias("diff_mean"),
        F.count_if((same & (score < cut)) | (~same & (score > cut))).alias("n_correct"),
        F.count(F.lit(1)).alias("n_total"),
    )
    return out.withColumn("separation", F.col("diff_mean") - F.col("same_mean"))


def contribution_summary(df: DataFrame, cut: float = 0.3) -> DataFrame:
    return df.agg(
        F.coalesce(F.avg("optical_contribution"), F.lit(0.0)).alias("optical_mean"),
        F.coalesce(F.avg("sar_contribution"), F.lit(0.0)).alias("sar_mean"),
        F.coalesce(F.avg("modality_distance"), F.lit(0.0)).alias("distance_mean"),
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("modality_distance") > cut).alias("n_disagreements"),
    )


def compare_runs(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """Winner of each metric over (metric, experiment, value string, higher_is_better); texts that are no number
    (a percentage, a fraction) give ``--``."""
    wide = metrics.groupBy("metric", "higher_is_better").pivot("experiment", [first, second]).agg(F.max("value"))
    a, b = F.col(f"`{first}`").try_cast("double"), F.col(f"`{second}`").try_cast("double")
    better = F.when(F.col("higher_is_better"), a > b).otherwise(a < b)
    winner = (
        F.when(a.isNull() | b.isNull(), F.lit("--")).when(a == b, F.lit("Tie"))
        .when(better, F.lit(first)).otherwise(F.lit(second))
    )
    return wide.withColumn("winner", winner)


def detection_summary(runs: DataFrame) -> DataFrame:
    """runs: n_boxes, valid_boxes, latency_s, error."""
    failed = F.col("error").isNotNull()
    out = runs.agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(failed).alias("n_errors"),
        F.count_if(~failed & F.coalesce("valid_boxes", F.lit(True))).alias("n_valid_geometry"),
        F.coalesce(F.sum(F.when(~failed, F.col("n_boxes"))), F.lit(0)).alias("n_boxes"),
        F.coalesce(F.avg(F.when(~failed, F.col("latency_s"))), F.lit(0.0)).alias("mean_latency_s"),
    )
    good = (F.col("n_errors") == 0) & (F.col("n_valid_geometry") == F.col("n_runs"))
    return out.withColumn("verdict", F.when(good, F.lit("GOOD")).otherwise(F.lit("NEEDS WORK")))
