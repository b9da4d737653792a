"""Annotation records over the ``events`` table: clips are users, frames three-day buckets, boxes small integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.registry import table

LABELS = ("click", "error", "purchase", "signup", "view")
IMAGE = (640, 480)

_RECORDS = """
  event_id as det_id, user_id as clip, user_id % 15 as sess, event_type as label, li, frame_ordinal, (user_id + li) % 5 as st,
  cast((user_id*37 + li*101) % 400 + (event_id*7) % 13 as double) as x1,
  cast((user_id*53 + li*67) % 300 + (event_id*5) % 11 as double) as y1,
  cast((user_id*37 + li*101) % 400 + (event_id*7) % 13 as double) + cast(case when event_id % 19 = 0 then 12 else 60 + (event_id*13) % 40 end as double) as x2,
  cast((user_id*53 + li*67) % 300 + (event_id*5) % 11 as double) + cast(case when event_id % 23 = 0 then 14 else 60 + (event_id*11) % 40 end as double) as y2,
  cast((event_id*7919) % 10007 as double) / cast(10007 as double) as score,
  cast(40 + (event_id*29) % 60 as double) / cast(100 as double) as presence
"""
_LI = "case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end"

#: The same records in DuckDB: a common table expression ``b``.
SQL = f"""e as (select *, (epoch_us(ts) // 1000000 - 1704067200) // 259200 as frame_ordinal, {_LI} as li from events),
b as (select {_RECORDS} from e)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, clip, sess, label, li, frame_ordinal, st (0, 1: label positive; 2, 3: negative; 4: unknown), x1 to y2, score, presence."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    bucket = F.expr("timestampdiff(second, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 259200")
    placed = events.withColumn("frame_ordinal", bucket).withColumn("li", F.expr(_LI))
    return placed.selectExpr(*(x.strip() for x in _split(_RECORDS)))


def _split(columns: str) -> list[str]:
    """Expressions between commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


def gold(dets: DataFrame) -> DataFrame:
    return dets.where("det_id % 3 = 0").withColumn("ignore", F.col("det_id") % 21 == 0)


def predictions(dets: DataFrame) -> DataFrame:
    return dets.where("det_id % 3 <> 0")


def clips(dets: DataFrame) -> DataFrame:
    """clip, sess, labels (positive ones that occur, sorted), with fixed length and rate."""
    positive = F.when(F.col("st") < 2, F.col("label"))
    return dets.groupBy("clip", "sess").agg(F.sort_array(F.collect_set(positive)).alias("labels")).select(
        "*", F.lit(180.0).alias("duration_s"), F.lit(5400).alias("container_frame_count"), F.lit(30.0).alias("fps")
    )
