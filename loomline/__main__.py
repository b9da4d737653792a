"""Command line: python -m loomline COMMAND ... Results are printed as JSON lines.

provenance                          where the settings' defaults come from
check CONFIG                        findings before a run; exit code 1 if any is a failure
plan MANIFEST                       frames, keyframes and chunks of each clip
shard MANIFEST INDEX OF             every OF-th clip from the INDEX-th
protocol MANIFEST                   fold scheme and test for the manifest's sessions
gold-select MANIFEST                frames to annotate
query NAME SF_DIR                   a registered query
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import frames, report
from loomline.plans import annotation, config, registry, vocabularies  # noqa: F401
from loomline.sources import formats


def plan(clips: DataFrame, settings: config.Settings) -> DataFrame:
    """Per clip the numbers of frames, keyframes and chunks that the settings lead to."""
    fps = F.lit(float(settings["detector.sample_fps"]))
    grid = clips.withColumn("indices", frames.frame_grid(F.col("duration_s"), F.col("container_frame_count"), fps, 100_000)["indices"])
    chunked = frames.chunks(grid, "indices", settings["propagator.chunk_frames"], settings["propagator.chunk_overlap"], "duration_s", settings["propagator.pcs_max_seconds"])
    keys = F.size(frames.keyframes(F.col("indices"), settings["detector.keyframe_stride"]))
    return chunked.groupBy("clip_id", F.size("indices").alias("n_frames"), keys.alias("n_keyframes")).agg(F.count("*").alias("n_chunks"))


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    command, *rest = args
    if command == "check":
        found = config.findings(config.Settings.read(rest[0]))
        print(*(": ".join(f) for f in found), sep="\n")
        return int(any(f[0] == "fail" for f in found))
    spark = SparkSession.builder.appName("loomline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if command == "provenance":
        out = config.provenance(spark)
    elif command == "query":
        out = registry.QUERIES[rest[0]](spark, rest[1])
    elif command in ("plan", "shard", "protocol", "gold-select"):
        clips = formats.read_manifest(spark, rest[0])
        if command == "plan":
            out = plan(clips, config.Settings())
        elif command == "shard":
            out = frames.shard(clips, "clip_id", int(rest[1]), int(rest[2]))
        elif command == "protocol":
            out = report.protocol(clips, "session_id")
        else:
            out = clips.select("clip_id", "session_id", F.explode(frames.gold_frames(F.col("duration_s"), F.lit(2.0))).alias("frame_index"))
    else:
        print(__doc__)
        return 2
    for line in out.toJSON().toLocalIterator():  # a partition at a time
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
