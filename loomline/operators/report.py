"""Scoring a system, and comparing two, over sessions: one matching each, reweighted for intervals and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import distributions
from loomline.operators import matching, statistics
from loomline.operators.splits import balance, fold_scheme, gold_filter

FRAME = ["clip", "frame_ordinal"]
_KEYS = [*FRAME, "label"]
_ORDER = [*FRAME, "x1", "y1", "x2", "y2", "det_id"]
#: Sessions and boxes of a class below which a gold set can't rank methods.
LEAST_SESSIONS = 9
LEAST_BOXES = 8
#: The largest share of resamples without a value that still gives an interval.
DEGENERATE = 0.05


def protocol(items: DataFrame, group: str, below: int = 12, n_folds: int = 5, permutation_below: int = 15) -> DataFrame:
    """One row: groups, fold scheme, folds and the test that so many groups allow. ``splits.balance`` gives the folds' classes."""
    n = items.agg(F.count_distinct(group).alias("n_groups"))
    scheme = fold_scheme(F.col("n_groups"), below, n_folds)
    return n.select("n_groups", scheme["scheme"].alias("scheme"), scheme["n_folds"].alias("n_folds"), statistics.choose_test(F.col("n_groups"), permutation_below).alias("test"))


def annotated(gold_frames: DataFrame) -> DataFrame:
    """Frames that some class was checked on."""
    return gold_frames.where(F.size("exhaustive_for") > 0)


def ground_truth(gold_frames: DataFrame, gts: DataFrame) -> DataFrame:
    """The boxes of annotated frames."""
    return gts.join(annotated(gold_frames).select(*FRAME), FRAME, "left_semi")


def gold_warnings(gold_frames: DataFrame, gts: DataFrame, labels: DataFrame) -> DataFrame:
    """(place, warning): all that makes a figure over this gold set untrustworthy, in order."""
    n = gold_frames.agg(F.count("*").alias("n"), F.count_if(F.size("exhaustive_for") > 0).alias("done"), F.count_distinct("sess").alias("sessions"))
    frames = n.where("n > done").select(F.lit("0").alias("place"), F.format_string("%d of %d frames are not annotated; scoring would take them for empty", F.col("n") - F.col("done"), "n").alias("warning"))
    few = n.where(F.col("sessions") < LEAST_SESSIONS).select(F.lit("1").alias("place"), F.format_string("only %d sessions, which the width of the interval rests on", "sessions").alias("warning"))
    items = ground_truth(gold_frames, gts).select(F.array("label").alias("labels"), F.lit(0).alias("fold"))
    counts = balance(items, "labels", labels, LEAST_BOXES).where("warning is not null")
    absent = labels.join(items.select(F.col("labels")[0].alias("label")).distinct(), "label", "left_anti").distinct()  # no boxes at all: no folds either
    text = F.when(F.col("n") == 0, F.format_string("class %s has no gold boxes", "label")).otherwise(F.format_string("class %s has only %d gold boxes", "label", "n"))
    classes = counts.where("n > 0").select("label", "n").union(absent.select("label", F.lit(0).cast("long").alias("n")))
    return frames.union(few).union(classes.select(F.concat(F.lit("2"), "label").alias("place"), text.alias("warning")))


def _rows(preds: DataFrame, gts: DataFrame, max_dets: int, iou: str) -> DataFrame:
    found = matching.match(preds, gts, _KEYS, iou, max_dets).where("not ignored")
    return found.join(preds.select("det_id", "score", "sess", "x1", "y1", "x2", "y2"), "det_id")


def _macro(rows: DataFrame, n_pos: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """keys, map, n_averaged, n_total."""
    return matching.mean_average_precision(matching.average_precision(rows, n_pos, [*keys, "label"], [F.desc("score"), *_ORDER], weight), keys)


def _reweighted(rows: DataFrame, n_pos: DataFrame, unit: list[str], weights: DataFrame) -> DataFrame:
    """replicate, map, n_averaged, n_total."""
    return matching.mean_average_precision(matching.reweighted_precision(rows, n_pos, ["score", *_ORDER], unit, weights), ["replicate"])


def _copied(table: DataFrame, most: int) -> DataFrame:
    """Each row k times for each k up to ``most``, as k, with det_id of its own."""
    each = table.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return each.withColumn("det_id", (F.col("det_id") * (most + 1) + F.col("k")) * (most + 1) + F.col("_copy")).drop("_copy")


def interval(preds: DataFrame, gts: DataFrame, sessions: DataFrame, n_resamples: int = 2000, seed: int = 0, max_dets: int = 0, iou: str = "0.5D") -> DataFrame:
    """One row (lo, hi, n_degenerate): macro AP over resampled sessions (sess).

    Matches are made once and weigh as often as their session is drawn. With a cap on an image's predictions,
    copies of an image share the cap; they are matched once for each number of copies.
    """
    weights = statistics.resample_weights(sessions, "sess", n_resamples, seed)
    n_pos = matching.positives(gts, ["sess", "label"]).join(weights, "sess").groupBy("replicate", "label").agg(F.sum(F.col("n_pos") * F.col("weight")).alias("n_pos"))
    if max_dets:
        most = weights.agg(F.coalesce(F.max("weight"), F.lit(1))).head()[0]
        p, g = _copied(preds, most), _copied(gts, most)
        found = matching.match(p, g, ["k", *_KEYS], iou, max_dets).where("not ignored").join(p.select("det_id", "score", "sess", "x1", "y1", "x2", "y2"), "det_id")
        drawn = _reweighted(found, n_pos, ["sess", "k"], weights.select("replicate", "sess", F.col("weight").cast("int").alias("k"), F.lit(1).cast("long").alias("weight")))
    else:
        drawn = _reweighted(_rows(preds, gts, 0, iou), n_pos, ["sess"], weights)
    return statistics.percentile_interval(drawn.where("map is not null"), "map", n_resamples)


def score(preds: DataFrame, gts: DataFrame, gold_frames: DataFrame, labels: DataFrame | None = None, n_resamples: int = 2000, seed: int = 0, max_dets: int = 0, iou: float = 0.5, permutation_below: int = 15, mde: float = 10.0) -> DataFrame:
    """One row: macro AP with its interval over resampled sessions, what it rests on, recall per class, and warnings.

    preds and gts carry sess, clip, frame_ordinal, label, det_id and a box; gold_frames sess, clip, frame_ordinal and
    exhaustive_for; labels (label) is the vocabulary, by default that of gts. Predictions that the gold set can't judge are
    dropped. One AP for each session has no spread within sessions, so that its correlation, and the design effect of that, are null.
    """
    labels = labels if labels is not None else gts.select("label").distinct()
    at = f"{iou}D"
    judged = gold_filter(preds, gold_frames, FRAME)
    kept = judged.where("gold_status = 'kept'").drop("gold_status").join(labels, "label", "left_semi")
    real = ground_truth(gold_frames, gts).join(labels, "label", "left_semi")
    sessions = annotated(gold_frames).select("sess").distinct()
    n_pos = labels.join(matching.positives(real, ["label"]), "label", "left").select("label", F.coalesce("n_pos", F.lit(0)).alias("n_pos"))
    whole = _macro(_rows(kept, real, max_dets, at), n_pos, [])
    ci = interval(kept, real, sessions, n_resamples, seed, max_dets, at)
    sizes = sessions.join(real.groupBy("sess").agg(F.count("*").alias("n")), "sess", "left").select(F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    design = statistics.kish(sizes, "n").select(F.col("design_effect").alias("kish_design_effect"))
    counts = judged.agg(
        F.count_if(F.col("gold_status") == "kept").alias("kept"), F.count_if(F.col("gold_status") == "frame_not_annotated").alias("dropped_unannotated_frame"),
        F.count_if(F.col("gold_status") == "label_not_exhaustive").alias("dropped_class_not_checked"),
    )
    gold = annotated(gold_frames).agg(F.count("*").alias("n_gold_frames"), F.count_distinct("sess").alias("n_sessions"))
    boxes = real.agg(F.count("*").alias("n_gold_boxes"))
    found = labels.join(matching.recall(kept, real, _KEYS), "label", "left").withColumn("n_pos", F.coalesce("n_pos", F.lit(0))).withColumn("hits", F.coalesce("hits", F.lit(0)))
    found = found.withColumn("ci", distributions.clopper_pearson_column(F.col("hits"), F.col("n_pos")))
    recalls = found.agg(F.array_sort(F.collect_list(F.struct("label", "recall", "hits", "n_pos", F.col("ci.lo").alias("lo"), F.col("ci.hi").alias("hi")))).alias("per_class_recall"))
    warned = gold_warnings(gold_frames, gts, labels).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "warning"))), lambda x: x["warning"]).alias("_gold"))
    one = whole
    for part in (ci, design, counts, gold, boxes, recalls, warned):
        one = one.join(part, F.lit(True), "left")  # one row each
    width, trusted = F.col("hi") - F.col("lo"), F.col("n_degenerate") <= n_resamples * DEGENERATE
    said = F.array(
        F.when(width > mde / 100, F.format_string(f"the interval is %.3f wide, above the least difference of {mde / 100:.3f}", width)),
        F.when(~trusted, F.format_string(f"%d of {n_resamples} resamples had no value", "n_degenerate")),
        F.when(F.col("dropped_unannotated_frame") > 0, F.format_string("%d predictions on frames that aren't annotated were dropped", "dropped_unannotated_frame")),
    )
    return one.select(
        "map", "n_averaged", "n_total", "lo", "hi", width.alias("ci_width"), trusted.alias("ci_trustworthy"), "n_degenerate", "n_sessions", "n_gold_frames", "n_gold_boxes",
        statistics.choose_test(F.col("n_sessions"), permutation_below).alias("test"), F.coalesce("kish_design_effect", F.lit(1.0)).alias("kish_design_effect"),
        F.lit(None).cast("double").alias("icc"), F.lit(None).cast("double").alias("icc_design_effect"), "kept", "dropped_unannotated_frame", "dropped_class_not_checked", "per_class_recall",
        F.concat("_gold", F.filter(said, lambda x: x.isNotNull())).alias("warnings"),
    )


def _paired_map(rows: DataFrame, n_pos: DataFrame, swaps: DataFrame) -> DataFrame:
    """(i, d): for each permutation, macro AP of one pool less that of the other. rows: of both systems (second: of b); a swap puts a session's rows into the other pool."""
    each = swaps.withColumn("second", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("pool", (F.col("second") != F.col("swapped")).cast("int"))
    place = lambda: (F.col("i") * 2 + F.col("pool")).cast("long").alias("replicate")
    grid = swaps.select("i").distinct().withColumn("pool", F.explode(F.array(F.lit(0), F.lit(1)))).select(place())
    found = _reweighted(rows, grid.crossJoin(n_pos), ["sess", "second"], each.select(place(), "sess", "second", F.lit(1).cast("long").alias("weight")))  # permutations by classes
    found = found.withColumn("i", F.floor(F.col("replicate") / 2)).withColumn("pool", F.pmod("replicate", F.lit(2)))
    value = lambda k: F.max(F.when(F.col("pool") == k, F.col("map")))
    return found.groupBy("i").agg((value(0) - value(1)).alias("d"), value(0).alias("map_a"), value(1).alias("map_b"))


def compare(a: DataFrame, b: DataFrame, gts: DataFrame, gold_frames: DataFrame, labels: DataFrame | None = None, seed: int = 0, n_random: int = 10_000, max_dets: int = 0, iou: float = 0.5, permutation_below: int = 15, mde: float = 10.0) -> DataFrame:
    """One row: macro AP of two systems, their difference, the p value of swapping sessions between them, what difference could be told, and warnings.

    All swaps for fourteen sessions or fewer, else ``n_random`` random ones. A difference below ``mde`` points isn't resolvable.
    """
    labels = labels if labels is not None else gts.select("label").distinct()
    real = ground_truth(gold_frames, gts).join(labels, "label", "left_semi")
    n_pos = matching.positives(real, ["label"])
    rows = None
    for second, preds in ((False, a), (True, b)):
        kept = gold_filter(preds, gold_frames, FRAME).where("gold_status = 'kept'").drop("gold_status").join(labels, "label", "left_semi")
        mine = _rows(kept, real, max_dets, f"{iou}D").withColumn("second", F.lit(second))
        rows = mine if rows is None else rows.unionByName(mine)
    sessions = annotated(gold_frames).select("sess").distinct()
    table, n, exact = statistics.swaps(sessions, "sess", n_random=n_random, seed=seed)
    as_is = sessions.select(F.lit(-1).alias("i"), "sess", F.lit(False).alias("swapped"))
    all_ = _paired_map(rows, n_pos, table.union(as_is))
    seen = all_.where("i = -1").select(F.col("d").alias("observed"), "map_a", "map_b")
    p = statistics.permutation_p(all_.where("i >= 0").select("d").join(seen.select("observed"), F.lit(True)))
    per = _macro(rows, matching.positives(real, ["sess", "label"]).crossJoin(rows.sparkSession.createDataFrame([(False,), (True,)], "second boolean")), ["sess", "second"])
    value = lambda k: F.max(F.when(F.col("second") == k, F.col("map")))
    apart = per.groupBy("sess").agg((value(False) - value(True)).alias("d")).where("d is not null")
    spread = apart.agg(F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"), F.count("*").alias("n_paired"))
    one = sessions.agg(F.count("*").alias("n_groups"))
    warned = gold_warnings(gold_frames, gts, labels).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "warning"))), lambda x: x["warning"]).alias("_gold"))
    for part in (seen, p, spread, warned):
        one = one.join(part, F.lit(True), "left")  # one row each
    floor = 1 / (F.coalesce("n_perm", F.lit(0)) + 1.0)
    resolvable = F.coalesce(F.abs("observed") >= mde / 100, F.lit(False))
    said = F.array(
        F.when(~resolvable & F.col("observed").isNotNull(), F.format_string(f"the difference of %.4f is below {mde / 100:.4f}: not resolvable", "observed")),
        F.when(F.lit(exact), F.format_string("all swaps of %d sessions can't give a p value below %.4f", "n_groups", floor)),
    )
    least: Column = F.when(F.col("n_paired") > 0, distributions.mde_column(F.col("sd"), F.greatest(F.lit(2).cast("long"), F.col("n_paired"))))
    return one.select(
        "map_a", "map_b", F.col("observed").alias("diff"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"), F.lit(exact).alias("exact"), F.coalesce("n_perm", F.lit(0)).alias("n_perm"), floor.alias("p_floor"),
        statistics.choose_test(F.col("n_groups"), permutation_below).alias("test"), "n_groups", "sd", least.alias("minimum_detectable"), F.lit(mde / 100).alias("threshold"), resolvable.alias("resolvable"),
        F.concat("_gold", F.filter(said, lambda x: x.isNotNull())).alias("warnings"),
    )
