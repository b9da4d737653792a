import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions.vocabulary import vocabulary
from loomline.operators import report, splits
from loomline.sources import catalogue

BOX = "det_id long, sess long, clip long, frame_ordinal long, label string, score double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX)


def test_score_and_compare(spark):
    gts = boxes(spark, [(i, i % 4, i, 0, "x", 1.0, 0.0, 0.0, 10.0, 10.0) for i in range(12)]).withColumn("ignore", F.lit(False))
    good = boxes(spark, [(100 + i, i % 4, i, 0, "x", 0.9, 0.0, 0.0, 10.0, 10.0) for i in range(12)])
    bad = boxes(spark, [(200 + i, i % 4, i, 0, "x", 0.9, 50.0, 0.0, 60.0, 10.0) for i in range(12)])
    frames = gts.select("sess", "clip", "frame_ordinal").withColumn("exhaustive_for", F.when(F.col("clip") < 11, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    row = report.score(good, gts, frames, n_resamples=20).first()
    assert (row.kept, row.dropped_unannotated_frame, row.dropped_class_not_checked, row.n_total, row.n_gold_frames, row.n_gold_boxes, row.n_sessions) == (11, 1, 0, 1, 11, 11, 4)
    assert row.map == row.lo == row.hi == 1.0 and row.ci_width == 0 and row.ci_trustworthy and row.test == "permutation" and row.icc is None
    assert row.kish_design_effect == pytest.approx(4 * (9 + 9 + 9 + 4) / 121)
    assert [(r.label, r.recall, r.hits, r.n_pos) for r in row.per_class_recall] == [("x", 1.0, 11, 11)] and 0.7 < row.per_class_recall[0].lo < 0.8
    assert [w.split(" ")[0] for w in row.warnings] == ["1", "only", "1"]
    c = report.compare(good, bad, gts, frames).first()
    assert (c.map_a, c.map_b, c["diff"], c.n_perm, c.exact, c.n_groups, c.sd) == (1.0, 0.0, 1.0, 16, True, 4, 0.0)
    assert c.p_value == pytest.approx(3 / 17) and c.resolvable and c.minimum_detectable == 0 and c.p_floor == pytest.approx(1 / 17)
    same = report.compare(good, good.withColumn("det_id", F.col("det_id") + 900), gts, frames).first()
    assert same["diff"] == 0 and same.p_value == 1 and not same.resolvable
    assert tuple(report.protocol(good, "sess").first()) == (4, "leave_one_group_out", 4, "permutation")


def test_compare_is_the_macro_average(spark):
    """Against a loop over all swaps that matches and averages anew, with two labels and misses."""
    rng = random.Random(7)
    gts, preds = [], ([], [])
    for clip in range(18):
        for label in "xy":
            gts.append((len(gts), clip % 3, clip, 0, label, 1.0, 0.0, 0.0, 10.0, 10.0))
            for side in (0, 1):
                for _ in range(2):
                    at = rng.choice([0.0, 2.0, 40.0])
                    preds[side].append((1000 * (side + 1) + len(preds[side]), clip % 3, clip, 0, label, round(rng.random(), 3), at, 0.0, at + 10.0, 10.0))

    def macro(ps):
        out = []
        for label in "xy":
            used, hits, n = set(), [], 18
            for p in sorted((p for p in ps if p[4] == label), key=lambda p: (-p[5], p[2], p[6])):
                hit = p[6] <= 2 and p[2] not in used
                used |= {p[2]} if hit else set()
                hits.append(hit)
            precision, recall = [sum(hits[: i + 1]) / (i + 1) for i in range(len(hits))], [sum(hits[: i + 1]) / n for i in range(len(hits))]
            best = [max(precision[i:]) for i in range(len(hits))]
            out.append(sum(next((b for b, r in zip(best, recall) if r >= k / 100), 0.0) for k in range(101)) / 101)
        return sum(out) / 2

    g = boxes(spark, gts).withColumn("ignore", F.lit(False))
    frames = g.select("sess", "clip", "frame_ordinal").distinct().withColumn("exhaustive_for", F.array(F.lit("x"), F.lit("y")))
    got = report.compare(boxes(spark, preds[0]), boxes(spark, preds[1]), g, frames).first()
    pool = lambda swaps, side: [p for k in (0, 1) for p in preds[k] if (k ^ swaps[p[1]]) == side]
    d = [macro(pool(s, 0)) - macro(pool(s, 1)) for s in itertools.product((0, 1), repeat=3)]
    assert got["diff"] == pytest.approx(d[0]) and got.map_a == pytest.approx(macro(preds[0]))
    assert got.p_value == pytest.approx((1 + sum(abs(x) >= abs(d[0]) - 1e-12 for x in d)) / 9)


def test_interval_with_a_cap(spark):
    """With a cap on an image's predictions, copies of a session share it: against literal copies."""
    gts = boxes(spark, [(i, i % 3, i, 0, "x", 1.0, 0.0, 0.0, 10.0, 10.0) for i in range(6)]).withColumn("ignore", F.lit(False))
    ps = boxes(spark, [(100 + 2 * i + k, i % 3, i, 0, "x", 0.9 - 0.1 * k - 0.01 * i, 40.0 * (k == i % 2), 0.0, 40.0 * (k == i % 2) + 10.0, 10.0) for i in range(6) for k in (0, 1)])
    sessions = gts.select("sess").distinct()
    got = report.interval(ps, gts, sessions, n_resamples=40, max_dets=1).first()
    free = report.interval(ps, gts, sessions, n_resamples=40).first()
    assert got.n_degenerate == 0 and 0 <= got.lo <= got.hi <= 1 and got.hi < free.hi


def test_gold_and_thresholds(spark):
    labels = spark.createDataFrame([("x",), ("y",)], "label string")
    gts = boxes(spark, [(i, 0, i, 0, "x", 1.0, 0.0, 0.0, 10.0, 10.0) for i in range(3)]).withColumn("ignore", F.lit(False))
    frames = gts.select("sess", "clip", "frame_ordinal").withColumn("exhaustive_for", F.array(F.lit("x"), F.lit("y")))
    told = [r.warning for r in report.gold_warnings(frames, gts, labels).orderBy("place").collect()]
    assert told == ["only 1 sessions, which the width of the interval rests on", "class x has only 3 gold boxes", "class y has no gold boxes"]
    scores = spark.createDataFrame([(0.1, False, 0), (0.4, True, 1), (0.4, False, 1), (0.7, True, 0)], "score double, is_positive boolean, fold int")
    assert splits.score_grid(scores) == [0.1, 0.4, 0.7]
    assert splits.choose_threshold(scores).first().threshold == 0.4
    with pytest.raises(splits.LeakageError):
        splits.choose_threshold(scores, fitted=1)
    with pytest.raises(splits.LeakageError):
        splits.choose_threshold(scores.withColumn("fold", F.lit(None).cast("int")))
    with pytest.raises(ValueError):
        splits.choose_threshold(scores.limit(0))
    items = spark.createDataFrame([(i, i % 6) for i in range(60)], "clip int, sess int")
    gap = splits.leakage_gap(items, "sess", "clip", lambda train, val: float(train.join(val.select("sess").distinct(), "sess", "left_semi").count() > 0), 3)
    assert gap["gap"] == 1.0 and (gap["n_groups"], gap["n_clips"]) == (6, 60)


def test_training_side(spark):
    plan = splits.plan_schedule(200, rank=16, epochs=3, accumulation=16, alpha=16)
    assert (plan["steps_per_epoch"], plan["total_steps"], plan["warmup_steps"], plan["recommended_rank"]) == (12, 36, 1, 8) and len(plan["warnings"]) == 3
    with pytest.raises(splits.ScheduleError):
        splits.plan_schedule(200, devices=2)
    held = [r.name for r in splits.held_out_classes(vocabulary(spark), 3, keep=("beaker",)).orderBy("place").collect()]
    assert held == ["conical_flask", "measuring_cylinder", "microscope"]
    with pytest.raises(splits.RetentionError):
        splits.held_out_classes(vocabulary(spark), 15)
    sides = [spark.createDataFrame(list(zip("abc", v)), "class string, value double") for v in ([0.5, 0.4, 0.9], [0.2, 0.39, 1.2])]
    found = splits.retention_summary(splits.retention(*sides)).first()
    assert found.median_before == 0.5 and found.median_relative == pytest.approx((0.39 - 0.5) / 0.5) and found.warning == "masked"


def test_catalogue(spark):
    rec = spark.createDataFrame([("expt_A_0001.rf.abc123.jpg", 640, 640, [(0, 0.5, 0.5, 0.2, 0.2)]), ("expt_B_12.jpg", 640, 640, [(1, 0.5, 0.5, 0.2, 0.2)])], "file_name string, width int, height int, boxes array<struct<cls:int,cx:double,cy:double,w:double,h:double>>")
    rows = catalogue.normalise_boxes(rec, ["Beaker", "unheard of"], vocabulary(spark))
    got = {r.session_key: (round(r.x1), round(r.x2), r["class"]) for r in rows.collect()}
    assert got == {"expt_A": (256, 384, "beaker"), "expt_B": (256, 384, None)}
    assert tuple(catalogue.mapping_report(rows).first()) == (1, 1)
    assert catalogue.resplit_by_session(rows, 2).select("fold").distinct().count() == 2
    assert {r.name for r in catalogue.coverage(rows, vocabulary(spark)).where("covered").collect()} == {"beaker"}
    with pytest.raises(Exception, match="no size"):
        catalogue.normalise_boxes(rec.withColumn("width", F.lit(0)), ["a", "b"], vocabulary(spark)).collect()
