"""Accepting and rejecting detections with one reason each, and agreement in time and between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.geometry import iou, iou_sql, nms_sql

#: The gates' defaults.
GATES = {"score": 0.30, "presence": 0.50, "min_side": 20.0, "min_area": 0.001, "max_area": 0.90, "nms": 0.50}


def status(st_positive: Column, st_negative: Column) -> Column:
    """What is known of a label in a clip."""
    return F.when(st_positive, "positive").when(st_negative, "negative").otherwise("unknown")


def federated(labels: Column, queried: Column, vocabulary: Column) -> Column:
    """struct(positives, negatives, unknown) of a clip: what was asked and isn't present is negative, what wasn't asked is unknown."""
    asked = F.array_intersect(queried, vocabulary)
    stray = F.size(F.array_except(labels, vocabulary)) > 0
    positives = F.when(stray, F.raise_error("a label isn't in the vocabulary")).otherwise(F.array_sort(F.array_distinct(labels)))
    negatives = F.array_sort(F.array_except(asked, labels))
    unknown = F.array_sort(F.array_except(F.array_except(vocabulary, asked), labels))
    return F.struct(positives.alias("positives"), negatives.alias("negatives"), unknown.alias("unknown"))


def gate(dets: DataFrame, image: tuple[float, float] | None, gates: dict[str, float] = GATES) -> DataFrame:
    """The first gate that each detection meets in ``reason``, null for those that go on to suppression. Needs columns status, score, presence, x1 to y2."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    reason = (
        F.when(F.col("status") == "negative", "kept_as_background")
        .when(F.col("status") == "unknown", "not_in_clip_labels")
        .when(F.col("score") < gates["score"], "below_score")
        .when(F.col("presence") < gates["presence"], "below_presence")
        .when(F.least(w, h) < gates["min_side"], "side_too_small")
    )
    if image is not None:
        share = w * h / (image[0] * image[1]) if image[0] * image[1] > 0 else F.lit(0.0)
        reason = reason.when((share < gates["min_area"]) | (share > gates["max_area"]), "area_out_of_range")
    return dets.withColumn("reason", reason)


def nms(dets: DataFrame, keys: list[str], limit: float = GATES["nms"]) -> DataFrame:
    """``dets`` (of distinct det_id) with kept: whether no better kept one of the same keys overlaps beyond the limit.

    Groups are the boxes of one frame and label; they are folded in the JVM.
    """
    sorted_ = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "x1", "y1", "x2", "y2", "det_id")))
    kept = dets.groupBy(*keys).agg(sorted_.alias("_boxes")).select(F.explode(F.expr(f"transform({nms_sql('_boxes', limit)}, b -> b.det_id)")).alias("_kept"))
    return dets.join(kept, F.col("det_id") == F.col("_kept"), "left").withColumn("kept", F.col("_kept").isNotNull()).drop("_kept")


def cascade(dets: DataFrame, image: tuple[float, float] | None, keys: list[str], gates: dict[str, float] = GATES) -> DataFrame:
    """Every detection with exactly one reason: the first gate that it meets, else suppressed_nms or kept.

    Detections that meet a gate don't enter suppression: their place in it is taken by a null, which is no box.
    """
    gated = gate(dets, image, gates)
    entering = F.when(F.col("reason").isNull(), F.struct((-F.col("score")).alias("s"), "x1", "y1", "x2", "y2", "det_id"))
    boxes = gated.groupBy(*keys).agg(F.sort_array(F.collect_list(entering)).alias("_boxes"))
    kept = boxes.select(F.explode(F.expr(f"transform({nms_sql('_boxes', gates['nms'])}, b -> b.det_id)")).alias("_kept"))
    out = gated.join(kept, F.col("det_id") == F.col("_kept"), "left")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("_kept").isNotNull(), "kept").otherwise("suppressed_nms"))).drop("_kept")


def missing_labels(clips: DataFrame, verdicts: DataFrame, clip: str = "clip") -> DataFrame:
    """Each clip's labels of which no detection was kept."""
    kept = verdicts.where("reason = 'kept'").groupBy(clip).agg(F.collect_set("label").alias("_kept"))
    missing = F.array_sort(F.array_except("labels", F.coalesce("_kept", F.array().cast("array<string>"))))
    return clips.join(kept, clip, "left").withColumn("missing_labels", missing).drop("_kept")


def summary(clips: DataFrame, verdicts: DataFrame, clip: str = "clip") -> DataFrame:
    """(kind, name, n): detections of each reason, and how many clips never found each of their labels."""
    reasons = verdicts.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    missing = missing_labels(clips, verdicts, clip).select(F.explode("missing_labels").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return reasons.union(missing.select(F.lit("never_found"), "name", "n"))


def head_boxes(boxes_from_head: bool, required: bool = True) -> None:
    """An error for a detector whose boxes come from masks, if boxes must come from its detection head."""
    if required and not boxes_from_head:
        raise ValueError("the detector's boxes come from masks")


def decode_boxes(raw: DataFrame, limit: float = 0.60, most: int = 32, keys: tuple[str, ...] = ("frame_id", "prompt")) -> DataFrame:
    """Detections from a model's raw output (keys, cx, cy, w, h as shares, logit, presence_logit or null, width, height).

    The score is the logistic of the logit times that of the presence logit, ``limit`` at least; boxes are cut to the
    image and those under two pixels on a side go; of each prompt the ``most`` best stay. A label is its prompt with underscores.
    """
    logistic = lambda c: 1 / (1 + F.exp(-F.col(c)))
    presence = F.when(F.col("presence_logit").isNotNull(), logistic("presence_logit"))
    out = raw.withColumn("presence", presence).withColumn("score", logistic("logit") * F.coalesce("presence", F.lit(1.0))).where(F.col("score") >= limit)
    half = lambda c, s, size, sign: (F.col(c) + sign * F.col(s) / 2) * F.col(size)
    out = out.withColumn("x1", F.greatest(F.lit(0.0), half("cx", "w", "width", -1))).withColumn("y1", F.greatest(F.lit(0.0), half("cy", "h", "height", -1)))
    out = out.withColumn("x2", F.least(F.col("width").cast("double"), half("cx", "w", "width", 1))).withColumn("y2", F.least(F.col("height").cast("double"), half("cy", "h", "height", 1)))
    out = out.where("x2 - x1 >= 2 and y2 - y1 >= 2")
    ranked = out.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "x1", "y1", "x2", "y2")))
    return ranked.where(F.col("_rank") <= most).withColumn("label", F.replace("prompt", F.lit(" "), F.lit("_"))).drop("_rank", "cx", "cy", "w", "h", "logit", "presence_logit", "width", "height")


def presence_score(dets: DataFrame, clip: str = "clip") -> DataFrame:
    """Per clip and label the best score times presence (a null presence counts 1)."""
    return dets.groupBy(clip, "label").agg(F.greatest(F.lit(0.0), F.max(F.col("score") * F.coalesce("presence", F.lit(1.0)))).alias("presence_score"))


def top_k(dets: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each group (all for k = 0)."""
    if not k:
        return dets
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "label", "x1", "y1", "x2", "y2", "det_id")
    return dets.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def temporal_consistency(dets: DataFrame, least: int = 2, limit: float = 0.5, window: int = 3, clip: str = "clip", order: str = "frame_ordinal") -> DataFrame:
    """``dets`` with appearances: frames within ``window`` places, among the clip's frames that have detections, where a box of the same label overlaps; and consistent: at least ``least``.

    The boxes of a frame and label are one row, and a window over the places brings those of its neighbours; no row is made for a pair of boxes.
    """
    if least < 1:
        raise ValueError("least must be positive")
    frames = dets.select(clip, order).distinct().withColumn("_place", F.row_number().over(W.partitionBy(clip).orderBy(order)))
    boxes = dets.where(F.col("label").isNotNull()).join(frames, [clip, order]).groupBy(clip, "label", "_place").agg(F.collect_list(F.struct("det_id", "x1", "y1", "x2", "y2")).alias("_boxes"))
    around = W.partitionBy(clip, "label").orderBy("_place").rangeBetween(-window, window)
    near = boxes.withColumn("_near", F.filter(F.collect_list(F.struct("_place", "_boxes")).over(around), lambda n: n["_place"] != F.col("_place"))).where(F.size("_near") > 0)
    met = F.expr(f"transform(filter(_near, n -> exists(n._boxes, b -> {iou_sql('_a', 'b')} >= {limit}D)), n -> n._place)")
    hits = near.select("_near", F.explode("_boxes").alias("_a")).select(F.col("_a.det_id").alias("det_id"), met.alias("_places"))
    seen = hits.groupBy("det_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_places")))).alias("_n"))
    out = dets.join(seen, "det_id", "left").withColumn("appearances", (F.coalesce("_n", F.lit(0)) + 1).cast("long")).drop("_n")
    return out.withColumn("consistent", F.col("appearances") >= least)


def agreement(a: DataFrame, b: DataFrame, keys: list[str], limit: float = 0.5) -> DataFrame:
    """For each detection of a: its best b of the same label in the frame (agreed_with), else its best of another label (conflict_with).

    One b may serve several of a. Null in both: only a has it.
    """
    other = b.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("label").alias("_label"), F.col("det_id").alias("_det"), F.struct("x1", "y1", "x2", "y2").alias("_b"))
    near = a.withColumn("_a", F.struct("x1", "y1", "x2", "y2")).join(other, [F.col(k) == F.col(f"_{k}") for k in keys])
    near = near.withColumn("_iou", iou("_a", "_b")).where((F.col("_iou") >= limit) & (F.col("_iou") > 0))
    best = lambda same: F.max(F.when((F.col("label") == F.col("_label")) == same, F.struct("_iou", (-F.col("_det")).alias("d"))))
    found = near.groupBy("det_id").agg((-best(True)["d"]).alias("agreed_with"), (-best(False)["d"]).alias("_conflict"))
    out = a.join(found, "det_id", "left")
    return out.withColumn("conflict_with", F.when(F.col("agreed_with").isNull(), F.col("_conflict"))).drop("_conflict")


def only_b(b: DataFrame, agreed: DataFrame) -> DataFrame:
    """Detections of b that none of a chose."""
    return b.join(agreed.select(F.col("agreed_with").alias("det_id")).where("det_id is not null").distinct(), "det_id", "left_anti")


def precision_proxy(agreed: DataFrame) -> DataFrame:
    n, all_ = F.count("agreed_with"), F.count("*")
    return agreed.agg(n.alias("agreed"), (all_ - n).alias("only_a"), F.try_divide(n, all_).alias("precision_proxy"))
