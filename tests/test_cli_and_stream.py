import json

from loomline.__main__ import main, plan
from loomline.operators import cascade
from loomline.plans.config import Settings
from loomline.sources.adapters import IMAGE
from loomline.sources.formats import CLIP
from loomline.streaming import gates


def test_plan(spark):
    clips = spark.createDataFrame([("a", "s", ["x"], 180.0, 5400, 30.0, None), ("b", "s", ["x"], 182.0, 5460, 30.0, None)], CLIP)
    got = {r.clip_id: (r.n_frames, r.n_keyframes, r.n_chunks) for r in plan(clips, Settings()).collect()}
    assert got == {"a": (360, 45, 7), "b": (364, 46, 9)}


def test_commands(spark, tmp_path, capsys):
    assert main([]) == 2
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"detector": {"frame_size": 448}}')
    bad.write_text("{}")
    assert main(["check", str(good)]) == 0 and main(["check", str(bad)]) == 1
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"clips": [{"clip_id": f"c{i}", "session_id": f"s{i % 3}", "labels": ["x"], "duration_s": 180.0, "container_frame_count": 5400, "fps": 30.0} for i in range(5)]}))
    capsys.readouterr()
    assert main(["shard", str(manifest), "1", "2"]) == 0
    assert [json.loads(x)["clip_id"] for x in capsys.readouterr().out.splitlines()] == ["c1", "c3"]
    main(["protocol", str(manifest)])
    assert json.loads(capsys.readouterr().out)["scheme"] == "leave_one_group_out"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i // 3, "x", ["positive", "negative", "unknown"][i % 3 if i % 5 == 0 else 0], i / 40, 0.9, 0.0, 0.0, 40.0 + i, 40.0) for i in range(30)]
    df = spark.createDataFrame(rows, "det_id long, frame long, label string, status string, score double, presence double, x1 double, y1 double, x2 double, y2 double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    gates.write_verdicts(stream, IMAGE, ["frame", "label"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r.det_id, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.det_id, r.reason) for r in cascade.cascade(df, IMAGE, ["frame", "label"]).collect()}
    assert gates.gated(stream, IMAGE).isStreaming
