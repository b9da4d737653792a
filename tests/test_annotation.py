"""Annotation operators: known values, edge cases, and all registered queries against their SQL."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.functions import distributions as d
from loomline.functions import geometry as g
from loomline.functions.vocabulary import vocabulary
from loomline.operators import cascade, frames, labels, matching, splits, statistics, tracks
from loomline.plans import annotation, registry, vocabularies  # noqa: F401
from loomline.sources import formats

DATA = "/root/testdata/sf0.001"
BOXED = "det_id long, image string, label string, score double, x1 double, y1 double, x2 double, y2 double"


def preds(spark, rows):
    return spark.createDataFrame(rows, BOXED)


def truth(spark, rows):
    return spark.createDataFrame(rows, BOXED.replace("score double, ", "") + ", ignore boolean")


def ap(spark, p, t, **options):
    keys = ["image", "label"]
    found = matching.match(p, t, keys, **options).where("not ignored").join(p.select("det_id", "score", "x1", "y1", "x2", "y2"), "det_id")
    return matching.average_precision(found, matching.positives(t, ["label"]), ["label"], [F.desc("score"), "image", "x1", "y1", "x2", "y2", "det_id"]).first().ap


def test_average_precision(spark):
    t = truth(spark, [(1, "a", "x", 0.0, 0.0, 10.0, 10.0, False), (2, "b", "x", 0.0, 0.0, 10.0, 10.0, False)])
    hit = (11, "a", "x", 0.9, 0.0, 0.0, 10.0, 10.0)
    assert ap(spark, preds(spark, [hit]), t) == pytest.approx(0.504950495049505, abs=1e-12)
    assert ap(spark, preds(spark, [hit, (12, "a", "x", 0.95, 50.0, 50.0, 60.0, 60.0)]), t) == pytest.approx(0.25247524752475248, abs=1e-12)
    assert ap(spark, preds(spark, []), t) == 0.0
    assert ap(spark, preds(spark, [hit]), t.withColumn("ignore", F.lit(True))) is None


def test_match_rules(spark):
    t = truth(spark, [(1, "a", "x", 0.0, 0.0, 10.0, 10.0, False)])
    half = preds(spark, [(11, "a", "x", 0.9, 0.0, 0.0, 10.0, 5.0)])
    assert matching.match(half, t, ["image", "label"]).first().is_tp  # an overlap of exactly the threshold
    two = preds(spark, [(11, "a", "x", 0.9, 50.0, 0.0, 60.0, 5.0), (12, "a", "x", 0.8, 0.0, 0.0, 10.0, 10.0)])
    assert [r.is_tp for r in matching.match(two, t, ["image", "label"], max_dets=1, cap_keys=["image"]).collect()] == [False]
    ignored = matching.match(half, t.withColumn("ignore", F.lit(True)), ["image", "label"]).first()
    assert ignored.ignored and not ignored.is_tp


def test_weights_equal_copies(spark):
    """A weight of k is the same as k copies of the rows and of the positives."""
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.5, rng.random(), rng.randrange(0, 4)) for i in range(40)]
    base = spark.createDataFrame(rows, "det_id long, is_tp boolean, score double, w long").withColumn("label", F.lit("x"))
    n = spark.createDataFrame([("x", 70)], "label string, n_pos long")
    weighted = matching.average_precision(base, n, ["label"], [F.desc("score")], weight="w").first().ap
    copied = base.withColumn("k", F.explode(F.expr("if(w > 0, sequence(1L, w), array())"))).drop("k")
    assert matching.average_precision(copied, n, ["label"], [F.desc("score")]).first().ap == pytest.approx(weighted, abs=1e-12)


def test_distributions():
    for df, t in ((1, 12.706), (2, 4.303), (5, 2.571), (10, 2.228), (30, 2.042), (100, 1.984)):
        assert d.t_quantile(0.975, df) == pytest.approx(t, abs=6e-4)
    assert d.clopper_pearson(0, 10)[1] == pytest.approx(0.3085, abs=1e-4) and d.clopper_pearson(10, 10)[0] == pytest.approx(0.6915, abs=1e-4)
    assert d.clopper_pearson(3, 10) == pytest.approx((0.0667, 0.6525), abs=1e-4) and d.clopper_pearson(0, 0) == (0.0, 1.0)
    assert d.t_cdf(0, 7) == pytest.approx(0.5) and d.power_paired(1, 0, 5) == 1.0
    assert d.mde_paired(1.0, 10) == pytest.approx((2.262157 + 0.883404) / math.sqrt(10), abs=1e-4)


def test_grid_and_chunks(spark):
    clips = spark.createDataFrame([(1, 180.0, 5400, 2.0), (2, 176.5, 5400, 2.0), (3, 182.0, 5460, 2.0), (4, 180.0, 5400, 1.0)], "clip int, s double, n int, fps double")
    grid = clips.withColumn("i", frames.frame_grid(F.col("s"), F.col("n"), F.col("fps"), 400)["indices"])
    got = {r.clip: (r.n, r.k) for r in frames.chunks(grid, "i", 300, 8, "s", 30.0).groupBy("clip", F.size("i").alias("n")).agg(F.count("*").alias("k")).collect()}
    assert got == {1: (360, 7), 2: (353, 7), 3: (364, 9), 4: (180, 8)}
    assert grid.where("clip = 1").select(F.size(frames.keyframes(F.col("i"), 8))).first()[0] == 45
    with pytest.raises(Exception, match="overlap"):
        frames.chunks(grid, "i", 8, 8).count()
    with pytest.raises(Exception, match="container_frame_count"):
        clips.select(frames.frame_grid(F.col("s"), F.lit(0), F.col("fps"), 400)).collect()
    assert spark.range(1).select(frames.vision_tokens(F.lit(448), F.lit(16))).first()[0] == 4096


def test_nms_is_greedy(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        x, y = rng.randrange(0, 40), rng.randrange(0, 40)
        rows.append((i, f"f{i % 5}", "x", rng.randrange(0, 10) / 10, float(x), float(y), float(x + rng.randrange(10, 30)), float(y + rng.randrange(10, 30))))
    kept = {r.det_id for r in cascade.nms(preds(spark, rows), ["image", "label"], 0.4).where("kept").collect()}
    want = set()
    for f in range(5):
        chosen = []
        for r in sorted((r for r in rows if r[1] == f"f{f}"), key=lambda r: (-r[3], *r[4:], r[0])):
            if all(tracks._overlap(c[4:], r[4:]) <= 0.4 for c in chosen):
                chosen.append(r)
        want |= {r[0] for r in chosen}
    assert kept == want


def test_boxes(spark):
    one = spark.range(1).select(g.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("a"), g.box(F.lit(10), F.lit(0), F.lit(20), F.lit(10)).alias("b"))
    assert one.select(g.iou("a", "b")).first()[0] == 0.0 and one.select(g.iou("a", "a")).first()[0] == 1.0
    assert tuple(one.select(g.from_cxcywh(g.to_cxcywh(F.col("b"))).alias("c")).first().c) == (10.0, 0.0, 20.0, 10.0)
    with pytest.raises(Exception, match="ends before"):
        spark.range(1).select(g.box(F.lit(5), F.lit(0), F.lit(1), F.lit(1)).alias("a")).select(g.checked_box(F.col("a"))).collect()


def test_resolution(spark):
    raws = ["beaker", "Glass_Beaker", "beakr", "kitchen range hood", "salt shaker", "bathroom scale", "test tube holder", "an old microscope", "nothing like it", ""]
    got = {r.raw: r["class"] for r in labels.resolve(spark.createDataFrame([(r,) for r in raws], "raw string"), "raw", vocabulary(spark)).collect()}
    assert got == {"beaker": "beaker", "Glass_Beaker": "beaker", "beakr": "beaker", "kitchen range hood": None, "salt shaker": None, "bathroom scale": None, "test tube holder": "test_tube_holder", "an old microscope": "microscope", "nothing like it": None, "": None}
    assert labels.duplicate_aliases(vocabulary(spark)).where("alias <> 'measuring cylinder'").count() == 0


def test_splits(spark):
    items = spark.createDataFrame([(i, i % 20) for i in range(160)], "clip int, sess int")
    for seed in range(5):
        folds = splits.group_kfold(items, "sess", 5, seed)
        assert folds.groupBy("sess").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and folds.select("fold").distinct().count() == 5
    with pytest.raises(splits.TooFewGroups):
        splits.group_kfold(items.where("sess < 3"), "sess", 5)


def test_statistics(spark):
    same = spark.createDataFrame([(7.0,)] * 5, "w double")
    assert statistics.kish(same, "w").first().design_effect == pytest.approx(1.0)
    assert statistics.icc(spark.createDataFrame([(1, 2.0), (2, 3.0)], "c int, v double"), "c", "v").first().icc is None
    assert len(statistics.swap_masks(9)) == 512
    assert statistics.swap_masks(2) == ["00", "01", "10", "11"]
    names = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "unit string")
    w = statistics.resample_weights(names, "unit", 10, 0)
    rng = random.Random(0)
    drawn = Counter((k, "abc"[rng.randrange(3)]) for k in range(10) for _ in range(3))
    assert {(r.replicate, r.unit): r.weight for r in w.collect()} == drawn
    assert w.groupBy("replicate").agg(F.sum("weight").alias("n")).where("n <> 3").count() == 0


def test_permutations_of_many_groups(spark):
    """More groups than a long has bits, with string names, by the draws of a loop."""
    rng = random.Random(4)
    per = {f"s{i}": [rng.randrange(0, 9), 10, rng.randrange(0, 9), 10] for i in range(70)}
    df = spark.createDataFrame([(k, *v) for k, v in per.items()], "g string, ta long, na long, tb long, nb long")
    got = statistics.paired_permutation(df, "g").first()
    names, draw = sorted(per), random.Random(0)
    total = lambda swapped: sum((b - a if s else a - b) for s, (a, _, b, _) in swapped) / 700
    seen = total([(False, per[n]) for n in names])
    more = sum(round(abs(total([(draw.random() < 0.5, per[n]) for n in names])), 12) >= round(abs(seen), 12) for _ in range(10_000))
    assert got.n_perm == 10_000 and got["diff"] == pytest.approx(seen) and got.p_value == pytest.approx((1 + more) / 10_001)


def test_stitching(spark):
    p = lambda f, x: (f, float(x), 0.0, float(x + 10), 10.0, 0.5)
    rows = [(1, "a", 0, 1, "h", 0.2, [p(0, 0), p(1, 1)]), (1, "a", 1, 1, "h", None, [p(1, 2), p(2, 3)]), (1, "a", 1, 2, "h", 0.4, [p(1, 50)]), (1, "b", 0, 2, "h", None, [p(0, 0)])]
    parts = spark.createDataFrame(rows, "clip long, label string, chunk int, place int, box_source string, fragmentation double, points array<struct<frame:long,x1:double,y1:double,x2:double,y2:double,score:double>>")
    got = {r.track_id: (r.label, r.chunk_ids, [q.frame for q in r.points]) for r in tracks.stitch(parts).collect()}
    assert got == {1: ("a", [0, 1], [0, 1, 2]), 2: ("b", [0], [0]), 3: ("a", [1], [1])}
    named = tracks.stitch(parts.withColumn("clip", F.lit("clip one")))
    assert {(r.clip, r.track_id) for r in named.collect()} == {("clip one", i) for i in (1, 2, 3)}


def _stitched(parts, limit):
    """Tracks of one clip's parts (label, chunk, place, fragmentation, points) by a plain loop."""
    found = []
    for label, chunk, place, frag, points in sorted(parts, key=lambda x: (x[1], x[2])):
        own = {p[0]: p[1:5] for p in points}
        for t in found:
            if t["label"] == label and any(_overlap(t["points"][f], own[f]) >= limit for f in t["points"].keys() & own.keys()):
                t["points"], t["chunks"], t["frag"] = own | t["points"], t["chunks"] | {chunk}, [*t["frag"], frag]
                break
        else:
            found.append({"label": label, "points": own, "chunks": {chunk}, "frag": [frag]})
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    return {i + 1: (t["label"], sorted(t["chunks"]), mean([x for x in t["frag"] if x is not None]), sorted((f, *b) for f, b in t["points"].items())) for i, t in enumerate(found)}


def _overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h) if w > 0 and h > 0 else 0.0


def test_stitching_of_many_clips_against_a_loop(spark):
    draw, rows, clips = random.Random(5), [], {}
    for clip in (*range(60), None):
        for place in range(draw.choice([1, 3, 40])):
            frames = [draw.randrange(12) for _ in range(draw.choice([0, 1, 6]))]  # some twice
            points = [(f, x := draw.randrange(30) / 2, 0.0, x + 10, 10.0, 0.5) for f in frames]
            part = (draw.choice(["a", "b", None]), draw.randrange(4), place, draw.choice([None, draw.random()]), points)
            clips.setdefault(clip, []).append(part)
            rows.append((clip, *part[:3], "h", *part[3:]))
    parts = spark.createDataFrame(rows, "clip long, label string, chunk int, place int, box_source string, fragmentation double, points array<struct<frame:long,x1:double,y1:double,x2:double,y2:double,score:double>>")
    for limit in (0.5, 0.0):
        got = {}
        found = tracks.stitch(parts.repartition(3), limit)
        for r in found.collect():
            got.setdefault(r.clip, {})[r.track_id] = (r.label, r.chunk_ids, r.fragmentation, [tuple(p)[:5] for p in r.points])
        assert got == {clip: _stitched(own, limit) for clip, own in clips.items()}
    assert "Pandas" not in found._jdf.queryExecution().toString()  # a call for each clip and label takes minutes


def test_appearances_against_a_loop(spark):
    draw = random.Random(7)
    rows = [(i % 180, draw.choice([1, 2, None]), draw.choice(["a", "b", None]), draw.choice([*range(0, 40, 3), None]), x := draw.randrange(12) * 2.0, 0.0, x + 10 if draw.random() < 0.9 else None, 10.0) for i in range(200)]
    dets = spark.createDataFrame(rows, "det_id long, clip long, label string, frame_ordinal int, x1 double, y1 double, x2 double, y2 double")
    place = {c: {f: i for i, f in enumerate(sorted({r[3] for r in rows if r[1] == c and r[3] is not None}))} for c in (1, 2)}
    met = {}
    for a in rows:
        for b in rows:
            if None not in (*a[1:4], *b[1:4], a[6], b[6]) and a[1:3] == b[1:3] and 0 < abs(place[a[1]][a[3]] - place[b[1]][b[3]]) <= 3 and _overlap(a[4:], b[4:]) >= 0.5:
                met.setdefault(a[0], set()).add(b[3])
    found = cascade.temporal_consistency(dets)
    assert sorted((r.det_id, r.appearances) for r in found.collect()) == sorted((r[0], 1 + len(met.get(r[0], ()))) for r in rows)
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()  # seven rows of each detection, and one of each pair


def test_formats(spark, tmp_path):
    doc = tmp_path / "coco.json"
    doc.write_text('{"images": [{"id": 1, "file_name": "a", "width": 640, "height": 480}, {"id": 2, "file_name": "b", "width": 640, "height": 480}], "categories": [{"id": 1, "name": "x"}, {"id": 2, "name": "y"}], '
                   '"annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [64, 48, 128, 96], "iscrowd": 0}, {"id": 6, "image_id": 2, "category_id": 1, "bbox": [0, 0, 5, 5], "iscrowd": 1}]}')
    images, _, annotations = formats.read_coco(spark, str(doc))
    got = {r.id: r.targets for r in formats.coco_targets(images, annotations).collect()}
    assert tuple(got[1][0])[1:] == pytest.approx((1, 0.2, 0.2, 0.2, 0.2)) and got[2] == []
    manifest = tmp_path / "m.json"
    manifest.write_text('{"_comment": 1, "clips": [{"clip_id": "a", "session_id": "s", "labels": ["x"], "path": "p"}]}')
    assert formats.read_manifest(spark, str(manifest)).first().labels == ["x"]
    stages = formats.Stages(spark, f"file://{tmp_path}/stages", ["a", "b"], {"k": 1})
    assert stages.get("a", lambda: spark.range(3)).count() == 3 and stages.status() == {"a": True, "b": False}
    assert not formats.Stages(spark, f"file://{tmp_path}/stages", ["a"], {"k": 2}).is_done("a")
    with pytest.raises(KeyError):
        stages.is_done("c")
    with pytest.raises(ValueError):
        formats.dataset_yaml(["a:b"])
    assert formats.dataset_yaml(["a", "b"]).endswith("  0: a\n  1: b\n")


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


def test_bootstrap_replicates():
    """As many replicates as the reference draws."""
    import inspect

    from loomline.operators import report

    for f in (registry.QUERIES["bootstrap_map"], report.score):
        assert inspect.signature(f).parameters["n_resamples"].default == 2000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_permutation_over_all_sessions(spark):
    """Against a loop over the swaps of every session."""
    d = {r.det_id: r.sess for r in annotation.detections(spark, DATA).select("det_id", "sess").collect()}
    per = {}
    for r in annotation._matched(spark, DATA).select("det_id", "is_tp").collect():
        side = per.setdefault(d[r.det_id], [[0, 0], [0, 0]])[r.det_id % 2]
        side[0] += r.is_tp
        side[1] += 1
    sessions, masks = sorted(per), statistics.swap_masks(len(per))

    def diff(mask):
        x, y = [0, 0], [0, 0]
        for i, k in enumerate(sessions):
            a, b = per[k][::-1] if mask[i] == "1" else per[k]
            x, y = [x[0] + a[0], x[1] + a[1]], [y[0] + b[0], y[1] + b[1]]
        return x[0] / x[1] - y[0] / y[1]

    seen = diff("0" * len(sessions))
    more = sum(round(abs(diff(m)), 12) >= round(abs(seen), 12) for m in masks)
    got = registry.QUERIES["permutation_precision_random"](spark, DATA).first()
    assert len(sessions) > 10 and got.n_perm == len(masks)
    assert got["diff"] == pytest.approx(seen, abs=1e-8) and got.p_value == pytest.approx((1 + more) / (1 + len(masks)), abs=1e-8)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_all_orders_are_clips(spark):
    """The queries over all orders: every clip, and every frame of its grid in its chunks."""
    orders = {r[0] for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()}
    run = lambda name: registry.QUERIES[name](spark, DATA).collect()
    grid = {r.clip: r.indices.split(",") for r in run("frame_grid")}
    assert set(grid) == orders
    for name in ("keyframes", "gold_select", "clip_costs"):
        assert {r.clip for r in run(name)} == orders
    parts, single = {}, 0
    for r in sorted(run("chunks")):
        chunk = r.chunk.split(",")
        single += len(chunk) == 1
        parts.setdefault(r.clip, []).extend(chunk[r.overlap :])
    assert parts == grid and single


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file[:-8]} as select * from read_parquet('{DATA}/{file}')")
    got = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    a = sorted((tuple(_plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=key)
    b = sorted((tuple(_plain(r[i]) for i in order) for r in want.fetchall()), key=key)
    assert a == b


def test_average_precision_frames_grow(spark):
    """No window frame that runs to a partition's end, which would be summed anew for each row."""
    rows = spark.range(10).select(F.lit("x").alias("label"), (F.col("id") / 10).alias("score"), (F.col("id") % 3 == 0).alias("is_tp"))
    ap = matching.average_precision(rows, spark.createDataFrame([("x", 5)], "label string, n_pos long"), ["label"], [F.desc("score")])
    assert "unboundedfollowing" not in ap._jdf.queryExecution().optimizedPlan().toString().lower().replace(" ", "")
    assert ap.first().ap == pytest.approx(sum(next((b for r, b in [(0.2, 0.5), (0.4, 0.5), (0.6, 0.5), (0.8, 0.4)] if r >= k / 100), 0.0) for k in range(101)) / 101, abs=0.2)


def test_reweighted_precision(spark, monkeypatch):
    """In many blocks, against a join of rows and replicates: ties, units that are never drawn, a label without predictions, one without positives."""
    monkeypatch.setattr(matching, "BLOCK", 20)
    rng = random.Random(4)
    rows = [(i, rng.choice("xyz"), rng.randrange(5), rng.randrange(40) / 40, rng.random() < 0.4) for i in range(900)]
    matched = spark.createDataFrame(rows, "det_id long, label string, sess long, score double, is_tp boolean").repartition(3)
    weights = statistics.resample_weights(spark.range(5).withColumnRenamed("id", "sess"), "sess", 30, seed=1)
    n_pos = weights.select("replicate").distinct().crossJoin(spark.createDataFrame([("x", 400), ("y", 200), ("z", 0), ("w", 7)], "label string, n_pos long"))
    want = matching.average_precision(matched.join(weights, "sess"), n_pos, ["replicate", "label"], [F.desc("score"), "det_id"], "weight")
    got = matching.reweighted_precision(matched, n_pos, ["score", "det_id"], ["sess"], weights)
    one, other = ({(r.replicate, r.label): (r.n_pos, r.ap) for r in x.collect()} for x in (got, want))
    assert one.keys() == other.keys() and len(one) == 120
    for k, (n, ap) in other.items():
        assert one[k][0] == n and (one[k][1] is None) == (ap is None) and (ap is None or one[k][1] == pytest.approx(ap, abs=1e-12))
    assert matching.reweighted_precision(matched.limit(0), n_pos, ["score", "det_id"], ["sess"], weights).where("ap = 0").count() == 90
