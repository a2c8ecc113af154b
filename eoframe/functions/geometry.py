"""Box and footprint expressions over structs with ``min_x, min_y, max_x, max_y`` (label and confidence optional)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; boxes that only touch score 0."""
    ix0, iy0 = F.greatest(a["min_x"], b["min_x"]), F.greatest(a["min_y"], b["min_y"])
    ix1, iy1 = F.least(a["max_x"], b["max_x"]), F.least(a["max_y"], b["max_y"])
    inter = (ix1 - ix0) * (iy1 - iy0)
    union = _area(a) + _area(b) - inter
    return (
        F.when((ix1 <= ix0) | (iy1 <= iy0), F.lit(0.0))
        .when(union <= 0, F.lit(0.0))
        .otherwise(inter / F.nullif(union, F.lit(0.0)))
    )


def _area(b: Column) -> Column:
    return (b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"])


def list_iou(p: Column, r: Column) -> Column:
    """IoU of two coordinate arrays with clamped sides; anything that is not four numbers scores 0."""
    def at(c: Column, i: int) -> Column:
        return F.get(c, F.lit(i))

    def side(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0.0), hi - lo)

    w = side(F.greatest(at(p, 0), at(r, 0)), F.least(at(p, 2), at(r, 2)))
    h = side(F.greatest(at(p, 1), at(r, 1)), F.least(at(p, 3), at(r, 3)))
    inter = w * h
    union = side(at(p, 0), at(p, 2)) * side(at(p, 1), at(p, 3)) + side(at(r, 0), at(r, 2)) * side(
        at(r, 1), at(r, 3)
    ) - inter
    ok = (F.size(p) == 4) & (F.size(r) == 4) & (union > 0)
    return F.when(ok, inter / F.nullif(union, F.lit(0.0))).otherwise(F.lit(0.0))


def smaller_overlap(a: Column, b: Column) -> Column:
    """Intersection as a share of the smaller footprint."""
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    small = F.least(_area(a), _area(b))
    return F.when((w <= 0) | (h <= 0) | (small <= 0), F.lit(0.0)).otherwise(w * h / F.nullif(small, F.lit(0.0)))


def match_boxes(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Greedy matching of two box lists, as one struct.

    Boxes of ``a`` are served in order; each takes the free box of ``b`` with the highest IoU (first wins ties, 0 never
    matches) if that reaches the threshold. Order matters, so this is a fold over the row's own two arrays rather than
    a join; both are the bounded detection lists of one request. ``matched_pairs`` holds both boxes of each match, in the order
    of ``a``.
    """
    state = "struct<served:int,used:array<int>,ious:array<double>,labels:array<boolean>,places:array<int>>"
    start = F.struct(
        F.lit(0).alias("served"), *[F.array().alias(n) for n in ("used", "ious", "labels", "places")]
    ).cast(state)

    def serve(acc: Column, box: Column) -> Column:
        def better(best: Column, j: Column) -> Column:
            def choose(score: Column) -> Column:
                free = ~F.array_contains(acc["used"], j) & (score > best["v"])
                return F.when(free, F.struct(j.alias("j"), score.alias("v"))).otherwise(best)

            return F.get(F.transform(F.array(box_iou(box, F.get(b, j))), choose), F.lit(0))

        best = F.aggregate(
            F.sequence(F.lit(0), F.size(b) - 1), F.struct(F.lit(-1).alias("j"), F.lit(0.0).alias("v")), better
        )

        def take(best: Column) -> Column:
            same = F.lower(F.coalesce(box["label"], F.lit(""))) == F.lower(
                F.coalesce(F.get(b, best["j"])["label"], F.lit(""))
            )
            return F.when(
                (best["j"] >= 0) & (best["v"] >= threshold),
                F.struct(
                    (acc["served"] + 1).alias("served"), F.array_append(acc["used"], best["j"]).alias("used"),
                    F.array_append(acc["ious"], best["v"]).alias("ious"), F.array_append(acc["labels"], same).alias("labels"),
                    F.array_append(acc["places"], acc["served"]).alias("places"),
                ).cast(state),
            ).otherwise(F.struct((acc["served"] + 1).alias("served"), *[acc[n].alias(n) for n in ("used", "ious", "labels", "places")]))

        return F.get(F.transform(F.array(best), take), F.lit(0))  # names the fold over b, so it runs once

    na, nb = F.size(a), F.size(b)
    folded = F.when((na > 0) & (nb > 0), F.aggregate(a, start, serve)).otherwise(start)

    def report(m: Column) -> Column:
        hits = F.size(m["ious"])
        ratio = hits / F.nullif(na + nb - hits, F.lit(0))
        mean = F.when(
            hits > 0, F.aggregate(m["ious"], F.lit(0.0), lambda s, v: s + v) / F.nullif(hits, F.lit(0))
        ).otherwise(F.lit(0.0))
        return F.struct(
            F.when((na == 0) & (nb == 0), F.lit("EMPTY_MATCH"))
            .when((na == 0) | (nb == 0), F.lit("DISJOINT"))
            .when(ratio >= 0.8, F.lit("MATCHED"))
            .when(ratio > 0.3, F.lit("PARTIAL"))
            .otherwise(F.lit("DISAGREEMENT"))
            .alias("status"),
            F.when((na == 0) & (nb == 0), F.lit(1.0)).otherwise(F.round(mean, 4)).alias("mean_iou"),
            hits.alias("matched_count"),
            F.when((na == 0) | (nb == 0), na * F.when(nb == 0, 1).otherwise(0)).otherwise(na - hits).alias(
                "unmatched_a_count"
            ),
            F.when((na == 0) | (nb == 0), nb * F.when(na == 0, 1).otherwise(0)).otherwise(nb - hits).alias(
                "unmatched_b_count"
            ),
            F.when((na == 0) & (nb == 0), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(F.round(ratio, 4))
            .alias("spatial_agreement_ratio"),
            F.size(F.filter(m["labels"], lambda v: v)).alias("labels_matched"),
            F.transform(
                F.arrays_zip(m["places"].alias("i"), m["used"].alias("j"), m["ious"].alias("iou"), m["labels"].alias("labels_match")),
                lambda z: F.struct(
                    F.get(a, z["i"]).alias("box_a"), F.get(b, z["j"]).alias("box_b"), F.round(z["iou"], 4).alias("iou"),
                    z["labels_match"].alias("labels_match"),
                ),
            ).alias("matched_pairs"),
        )

    # The fold is evaluated once: transform over a one-element array names it for the report.
    return F.get(F.transform(F.array(folded), report), F.lit(0))


def box_issues(box: Column) -> Column:
    """Problems of one detection on the unit square."""
    def outside(name: str) -> Column:
        return F.when((box[name] < 0) | (box[name] > 1), F.lit(f"{name} out of range"))

    conf = box["confidence"]
    return F.array_compact(
        F.array(
            outside("min_x"), outside("min_y"), outside("max_x"), outside("max_y"),
            F.when(box["min_x"] >= box["max_x"], F.lit("min_x >= max_x")),
            F.when(box["min_y"] >= box["max_y"], F.lit("min_y >= max_y")),
            # NaN sorts above every number in Spark, so NaN > 1 is already "out of range" as in the reference rule
            F.when((conf < 0) | (conf > 1), F.lit("confidence out of range")),
            F.when(F.isnan(conf), F.lit("confidence is NaN")),
            F.when(F.coalesce(box["label"], F.lit("")) == "", F.lit("label is empty")),
        )
    )


def box_quality(boxes: Column, scale: float = 1000.0) -> Column:
    """(valid, quality, issue count) on a [0, scale] grid. Our reading: quality is the share of valid boxes."""
    good = F.filter(
        boxes,
        lambda b: (b["min_x"] >= 0) & (b["min_y"] >= 0) & (b["max_x"] <= scale) & (b["max_y"] <= scale)
        & (b["max_x"] > b["min_x"]) & (b["max_y"] > b["min_y"]),
    )
    n, ok = F.size(boxes), F.size(good)
    return F.struct(
        (n == ok).alias("is_valid"),
        F.when(n == 0, F.lit(1.0)).otherwise(ok / F.nullif(n, F.lit(0))).alias("quality"),
        (n - ok).alias("n_issues"),
    )


def format_boxes(detections: Column) -> Column:
    """Served form of a detection list: rounded corners with defaults for what is missing."""
    def served(d: Column) -> Column:
        box = F.coalesce(d["box"], F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
        corner = [F.round(F.get(box, F.lit(i)), 4) for i in range(4)]
        return F.struct(
            F.coalesce(d["label"], F.lit("unknown")).alias("label"),
            F.round(F.coalesce(d["confidence"], F.lit(0.0)), 3).alias("confidence"),
            corner[0].alias("x1"), corner[1].alias("y1"), corner[2].alias("x2"), corner[3].alias("y2"),
        )

    return F.transform(detections, served)


def mean_box_confidence(detections: Column) -> Column:
    total = F.aggregate(detections, F.lit(0.0), lambda s, d: s + d["confidence"])
    return total / F.greatest(F.size(detections), F.lit(1))
