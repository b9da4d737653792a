"""Whole runs with stand-in models, against a plain loop; naming; documents."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomline.functions.stand_ins import Classifier, Detector, Propagator
from loomline.functions.vocabulary import CLASSES, vocabulary
from loomline.operators import cascade, labels, run
from loomline.operators.run import run_clips, written
from loomline.plans.config import Settings
from loomline.sources import formats

SETTINGS = Settings({"detector": {"frame_size": 448, "sample_fps": 1.0, "keyframe_stride": 16}})
CLIPS = "clip_id string, session_id string, labels array<string>, duration_s double, container_frame_count int, fps double"


def clips(spark, n=6):
    rows = [(f"clip_s{i // 3}_{i}", f"session{i // 3}", ["beaker", "centrifuge"] if i % 2 else ["microscope", "test_tube"], 180.0, 5400, 30.0) for i in range(n)]
    return spark.createDataFrame(rows, CLIPS)


def _unit(*parts):
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big") / 2**64


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def _loop(clip, names, hit_rate):
    """Detections that stay over time, and their reasons, of one clip."""
    known = {c[0]: c for c in CLASSES}
    votes = {}
    for x in names:
        for y in known[x][2]:
            if y not in names and y in known:
                votes[y] = votes.get(y, 0) + 1
    hard = sorted(votes, key=lambda y: (-votes[y], y))[:4]
    hard += [c[0] for c in CLASSES if c[0] not in names and c[0] not in hard][: 4 - len(hard)]
    rest = 5 - len(names)
    negatives = hard[: rest - rest // 2]
    prompts = [*labels.GENERIC_PROMPTS[: rest // 2], *(x.replace("_", " ") for x in sorted(names)), *(x.replace("_", " ") for x in negatives)]
    grid = sorted({round(i * 5399 / 179) for i in range(180)})
    found = []
    for f in grid[::16]:
        frame = f"{clip}_{f:06d}.jpg"
        for p in prompts:
            if _unit("a", clip, p, "hit") >= hit_rate:
                continue
            for k in range(1 + int(_unit("a", clip, p, "n") * 2)):
                u = lambda what, at=clip: _unit("a", at, p, k, what)  # noqa: B023, E731
                cx, cy = 0.1 + 0.8 * u("cx") + (u("jx", frame) - 0.5) * 0.008, 0.1 + 0.8 * u("cy") + (u("jy", frame) - 0.5) * 0.008
                w, h = 0.1 + 0.18 * u("w"), 0.1 + 0.18 * u("h")
                box = (max(0.0, (cx - w / 2) * 448), max(0.0, (cy - h / 2) * 448), min(448.0, (cx + w / 2) * 448), min(448.0, (cy + h / 2) * 448))
                if box[2] - box[0] >= 2 and box[3] - box[1] >= 2:
                    found.append((f, p.replace(" ", "_"), box, 0.35 + 0.6 * u("s"), 0.3 + 0.69 * _unit("a", clip, p, "p")))
    places = {f: i for i, f in enumerate(sorted({d[0] for d in found}))}
    stays = [d for d in found if len({e[0] for e in found if e[1] == d[1] and e[0] != d[0] and abs(places[e[0]] - places[d[0]]) <= 3 and _iou(d[2], e[2]) >= 0.5}) >= 1]
    reasons, kept = {}, {}
    for d in sorted(stays, key=lambda d: (-d[3], d[2])):
        f, label, box, score, presence = d
        w, h = box[2] - box[0], box[3] - box[1]
        if label in negatives:
            reason = "kept_as_background"
        elif label not in names:
            reason = "not_in_clip_labels"
        elif score < 0.3:
            reason = "below_score"
        elif presence < 0.5:
            reason = "below_presence"
        elif min(w, h) < 20:
            reason = "side_too_small"
        elif not 0.001 <= w * h / 448**2 <= 0.9:
            reason = "area_out_of_range"
        elif any(_iou(box, b) > 0.5 for b in kept.get((f, label), ())):
            reason = "suppressed_nms"
        else:
            kept.setdefault((f, label), []).append(box)
            reason = "kept"
        reasons[reason] = reasons.get(reason, 0) + 1
    return len(stays), reasons, sorted(set(names) - {label for _, label in kept})


def test_run_against_a_loop(spark):
    given = clips(spark)
    run = run_clips(given, vocabulary(spark), SETTINGS, Detector((448, 448), hit_rate=0.85), Propagator(), keep=written(spark))
    got = {r.clip_id: r for r in run.summaries().collect()}
    for c in given.collect():
        n, reasons, never = _loop(c.clip_id, c.labels, 0.85)
        r = got[c.clip_id]
        assert (r.n_detections, r.reasons, r.labels_never_found) == (n, reasons, never)
        assert (r.n_frames, r.n_concepts, r.session_id) == (180, 5, c.session_id) and r.n_chunks >= 6
        assert r.n_accepted == reasons.get("kept", 0) and r.n_background == reasons.get("kept_as_background", 0)
    total = run.report().first()
    assert (total.n_clips, total.n_sessions, total.crops_named) == (6, 2, 0)
    assert total.total_accepted == sum(r.n_accepted for r in got.values()) and total.stitched_tracks > 0
    assert total.clips_with_missing_labels == sum(bool(r.labels_never_found) for r in got.values())
    assert {r.clip_id: set(r.labels) for r in given.collect()}.items() >= {r.clip_id: set(r.f) | (set(got[r.clip_id].labels_never_found)) for r in run.verdicts.where("reason = 'kept'").groupBy("clip_id").agg(F.collect_set("label").alias("f")).collect()}.items()


def test_guards_and_second_detector(spark):
    with pytest.raises(ValueError, match="masks"):
        run_clips(clips(spark, 1), vocabulary(spark), SETTINGS, Detector(from_head=False), Propagator())
    cascade.head_boxes(False, required=False)
    one = run_clips(clips(spark, 2), vocabulary(spark), SETTINGS, Detector((448, 448), 1.0), Propagator())  # all is one plan
    same = run_clips(clips(spark, 2), vocabulary(spark), SETTINGS, Detector((448, 448), 1.0), Propagator(), second=Detector((448, 448), 1.0))
    other = run_clips(clips(spark, 2), vocabulary(spark), SETTINGS, Detector((448, 448), 1.0), Propagator(), second=Detector((448, 448), 0.0))
    assert same.detections.count() == one.detections.count() > 0 and other.detections.count() == 0


def test_naming(spark, tmp_path):
    run = run_clips(clips(spark, 3), vocabulary(spark), SETTINGS, Detector((448, 448), 1.0), Propagator(), Classifier(favour={"beaker": 3.0, "microscope": 3.0}), keep=written(spark))
    total = run.report().first()
    assert total.crops_named > 0
    for r in run.named.collect():
        if r.outcome == "named":
            assert r.label == r.chosen and r.presence is None and r.prompt.endswith(f" -> {r.label}") and r.model_id.endswith("+stand-in/crop-classifier")
            assert r.margin >= 0.10 and r.confidence >= 0.35
        elif r.outcome == "rejected":
            assert r.confidence < 0.35 or r.margin < 0.10
        else:
            assert r.chosen is None and r.presence is not None and r.label in {c[0] for c in CLASSES}
    run.write(f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/clips").count() == 3


def test_single_candidate(spark):
    c = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (2, "b", 0.45)], "det_id long, label string, score double")
    got = {r.det_id: (r.margin, r.decided) for r in labels.name_by_margin(c).collect()}
    assert got[1] == (0.5, True) and got[2][0] == pytest.approx(0.05) and not got[2][1]
    with pytest.raises(labels.FineGrainedPrompt):
        labels.localisation_prompts(["beaker", "test_tube"], ("a beaker on a bench",))
    with pytest.raises(labels.FineGrainedPrompt):
        labels.localisation_prompts(["test_tube"], ("test tube",))
    assert labels.localisation_prompts(["test_tube"], ("test tube rack",))[-1] == "test tube rack"
    many = spark.createDataFrame([(["beaker", "autoclave"], ["pipette"])], "labels array<string>, hard_negatives array<string>")
    plan = labels.prompt_plan(many, [], 3, vocabulary(spark), paraphrases=1).first()
    assert plan.positives == ["autoclave", "laboratory autoclave", "beaker", "glass beaker"] and plan.positive_classes == ["autoclave", "autoclave", "beaker", "beaker"]
    assert plan.negatives == [] and plan.n_concepts == 4 and plan.note is not None


def test_documents(spark):
    images = spark.createDataFrame([(2, "b", 640, 480), (1, "a", 640, 480)], "id long, file_name string, width int, height int")
    box = "image_id long, label string, x1 double, y1 double, x2 double, y2 double, ignore boolean, track_id long, det_id long, score double"
    boxes = spark.createDataFrame([(2, "view", 0.0, 0.0, 4.0, 2.0, True, 7, 5, 0.5), (1, "click", 1.0, 1.0, 3.0, 4.0, False, 8, 9, 0.25)], box)
    doc = json.loads(formats.coco_document(images, boxes, ["view", "click"], ["det_id"]).first().json)
    assert [c["id"] for c in doc["categories"]] == [1, 2] and [i["id"] for i in doc["images"]] == [1, 2] and doc["info"] == {"description": "gold set"}
    assert doc["annotations"][0] == {"id": 1, "image_id": 2, "category_id": 1, "bbox": [0.0, 0.0, 4.0, 2.0], "area": 8.0, "iscrowd": 1}
    assert "score" not in doc["annotations"][1] and doc["annotations"][1]["iscrowd"] == 0
    flat = json.loads(formats.coco_results(boxes, ["view", "click"]).first().json)
    assert flat == [{"image_id": 1, "category_id": 2, "bbox": [1.0, 1.0, 2.0, 3.0], "score": 0.25}, {"image_id": 2, "category_id": 1, "bbox": [0.0, 0.0, 4.0, 2.0], "score": 0.5}]
    clip = spark.createDataFrame([("c1", "s1", 9.0, ["click", "other"], ["view"])], "clip string, session string, duration_s double, negatives array<string>, unknown array<string>")
    tracks = spark.createDataFrame([(1, "view", 3, [0, 1]), (2, "other", 1, [0])], "track_id int, label string, n_frames int, chunk_ids array<int>")
    tao = json.loads(formats.tao_document(clip, images, boxes, tracks, ["view", "click"], ["det_id"]).first().json)
    assert tao["videos"] == [{"id": "c1", "name": "c1", "metadata": {"session_id": "s1", "duration_s": 9.0}, "neg_category_ids": [2], "not_exhaustive_category_ids": [1]}]
    assert tao["tracks"] == [{"id": 1, "category_id": 1, "n_frames": 3, "spans_chunks": True, "chunk_ids": [0, 1]}] and [a["track_id"] for a in tao["annotations"]] == [7, 8]
    with pytest.raises(Exception, match="no category"):
        formats.coco_document(images, boxes, ["view"], ["det_id"]).collect()


def test_vocabulary_file(spark, tmp_path):
    formats.write_vocabulary(vocabulary(spark), f"file://{tmp_path}/v")
    back = formats.read_vocabulary(spark, f"file://{tmp_path}/v", vocabulary(spark))
    assert [(r.name, r.paraphrases) for r in back.orderBy("ordinal").collect()] == [(c[0], list(c[1])) for c in CLASSES]
    (tmp_path / "empty.json").write_text('{"classes": []}')
    assert formats.read_vocabulary(spark, f"file://{tmp_path}/empty.json", vocabulary(spark)).count() == len(CLASSES)


def test_decode_boxes(spark):
    raw = spark.createDataFrame([("f", "test tube", 0.5, 0.5, 0.2, 0.2, 5.0, None, 100, 100), ("f", "test tube", 0.5, 0.5, 0.2, 0.2, 5.0, -5.0, 100, 100), ("f", "test tube", 0.0, 0.5, 0.02, 0.2, 5.0, 5.0, 100, 100)], "frame_id string, prompt string, cx double, cy double, w double, h double, logit double, presence_logit double, width int, height int")
    got = cascade.decode_boxes(raw).collect()
    assert len(got) == 1 and got[0].label == "test_tube" and (got[0].x1, got[0].x2) == (40.0, 60.0) and got[0].presence is None


def test_tables_of_all_clips_are_not_broadcast(spark, tmp_path):
    """Frames of chunks carry arrays that files hold in far fewer bytes."""
    from loomline.functions.stand_ins import Detector, Propagator
    from loomline.functions.vocabulary import vocabulary
    from loomline.operators.run import run_clips, written
    from loomline.plans import runs

    seen = []

    class Seen(Propagator):
        def propagate(self, seeds):
            seen.append(seeds)
            return super().propagate(seeds)

    clips = runs.manifest(spark, "/root/testdata/sf0.001").where("clip_id < 'clip0000004'")
    done = run_clips(clips, vocabulary(spark), runs.SETTINGS, Detector((448, 448), hit_rate=0.85), Seen(), keep=written(spark))
    for table in (*seen, done.summaries()):
        assert "BroadcastHashJoin" not in table._jdf.queryExecution().executedPlan().toString()
    assert done.summaries().count() == clips.count()


def test_draws_are_computed_once_and_clips_are_dealt(spark):
    planned = run.planned(clips(spark, 40), vocabulary(spark), SETTINGS)
    found = run._ask(run.written(spark)("clips", planned), Detector((448, 448)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 10
    assert found.select(F.spark_partition_id()).distinct().count() > 1
