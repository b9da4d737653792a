"""Queries of the annotation operators over the adapter view, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import distributions, synthetic
from loomline.functions import geometry as g
from loomline.operators import cascade as c
from loomline.operators import frames, matching, report, splits, statistics, tracks
from loomline.plans import config
from loomline.plans.registry import query, table
from loomline.sources import adapters, formats
from loomline.sources.adapters import IMAGE, LABELS, detections

B = adapters.SQL
FRAME = ["clip", "frame_ordinal", "label"]


def _round(col: str, places: int = 9):
    return F.round(col, places).alias(col)


def _status(dets: DataFrame) -> DataFrame:
    return dets.withColumn("status", c.status(F.col("st") < 2, F.col("st") < 4))


# --- geometry -----------------------------------------------------------------------------

IOU = g.iou_sql("a", "b")


@query("iou_pairs", f"with {B} select a.det_id as det_a, b.det_id as det_b, round({IOU}, 9) as iou from b a join b on a.clip = b.clip and a.frame_ordinal = b.frame_ordinal and a.label = b.label and a.det_id < b.det_id where {IOU} > 0")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct("x1", "y1", "x2", "y2")
    d = detections(spark, sf_dir).select(*FRAME, "det_id", box.alias("a"))
    e = d.select(*FRAME, F.col("det_id").alias("det_b"), F.col("a").alias("b"))
    pairs = d.withColumnRenamed("det_id", "det_a").join(e, FRAME).where("det_a < det_b")
    return pairs.select("det_a", "det_b", g.iou("a", "b").alias("iou")).where("iou > 0").select("det_a", "det_b", _round("iou"))


@query("box_convert", f"""with {B} select det_id, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy,
  round(x1 / 640, 9) as nx1, round(y2 / 480, 9) as ny2, x1 as bx1, y2 as by2 from b""")
def box_convert(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("b", F.struct("x1", "y1", "x2", "y2"))
    w, h = F.lit(float(IMAGE[0])), F.lit(float(IMAGE[1]))
    d = d.withColumn("q", g.to_xywh(F.col("b"))).withColumn("m", g.to_cxcywh(F.col("b"))).withColumn("n", g.normalise(F.col("b"), w, h))
    back = g.from_cxcywh(g.to_cxcywh(g.from_xywh(F.col("q"))))
    return d.select("det_id", "q.x", "q.y", "q.w", "q.h", "m.cx", "m.cy", F.round("n.x1", 9).alias("nx1"), F.round("n.y2", 9).alias("ny2"), back["x1"].alias("bx1"), back["y2"].alias("by2"))


@query("box_clip_area", f"""with {B} select det_id, least(greatest(x1, 0), 300) as x1, least(greatest(y1, 0), 200) as y1, greatest(least(greatest(x1, 0), 300), least(greatest(x2, 0), 300)) as x2,
  greatest(least(greatest(y1, 0), 200), least(greatest(y2, 0), 200)) as y2, round((x2 - x1) * (y2 - y1) / (640 * 480), 9) as share, least(x2 - x1, y2 - y1) as side from b""")
def box_clip_area(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("b", F.struct("x1", "y1", "x2", "y2"))
    k = g.clip_to_image(F.col("b"), F.lit(300.0), F.lit(200.0))
    return d.select("det_id", *(k[n].alias(n) for n in ("x1", "y1", "x2", "y2")), F.round(g.area_ratio(F.col("b"), F.lit(640.0), F.lit(480.0)), 9).alias("share"), g.min_side(F.col("b")).alias("side"))


# --- frames -------------------------------------------------------------------------------

_METERS = "select o_orderkey as clip, (o_orderkey % 240 + 1)::double as duration, (o_orderkey % 5400 + 1)::int as n_frames, (o_orderkey % 30 + 1)::double as fps from orders"
_GRID = f"""m as ({_METERS}), n as (select *, greatest(1, least(n_frames, 60, floor(duration * fps)))::int as n from m),
gr as (select clip, duration, fps, n_frames, case when n = 1 then [0] else list_sort(list_distinct(list_transform(range(n), lambda i: round_even(i * (n_frames - 1) / (n - 1)::double, 0)::int))) end as indices, n = 60 as cap_bound from n)"""


def _meters(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("clip"), (k % 240 + 1).cast("double").alias("duration"), (k % 5400 + 1).cast("int").alias("n_frames"), (k % 30 + 1).cast("double").alias("fps"))


def _grid(spark, sf_dir) -> DataFrame:
    m = _meters(spark, sf_dir)
    return m.withColumn("grid", frames.frame_grid(F.col("duration"), F.col("n_frames"), F.col("fps"), 60)).select(*m.columns, "grid.indices", "grid.cap_bound")


@query("frame_grid", f"with {_GRID} select clip, cap_bound, len(indices) as n, list_sum(indices)::bigint as total, array_to_string(indices, ',') as indices from gr")
def frame_grid(spark, sf_dir):
    total = F.aggregate("indices", F.lit(0).cast("long"), lambda s, x: s + x)
    return _grid(spark, sf_dir).select("clip", "cap_bound", F.size("indices").cast("long").alias("n"), total.alias("total"), F.array_join("indices", ",").alias("indices"))


@query("keyframes", f"with {_GRID} select clip, array_to_string(list_filter(indices, lambda x, i: (i - 1) % 8 = 0), ',') as keyframes from gr")
def keyframes(spark, sf_dir):
    return _grid(spark, sf_dir).select("clip", F.array_join(frames.keyframes(F.col("indices"), 8), ",").alias("keyframes"))


@query("chunks", f"""with {_GRID},
l as (select *, len(indices) as n, case when ceil(duration / 30) > 1 then least(20, greatest(1, ceil(len(indices) / ceil(duration / 30)))) else 20 end::int as len from gr),
s as (select *, least(1, len - 1) as lap from l),
k as (select *, unnest(range(case when n > len then 1 + ceil((n - len) / (len - lap)::double)::int else 1 end)) as chunk_id from s)
select clip, chunk_id, array_to_string(indices[chunk_id * (len - lap) + 1:chunk_id * (len - lap) + len], ',') as chunk, case when chunk_id > 0 then lap else 0 end as overlap from k""")
def chunks(spark, sf_dir):
    """Chunks of all orders' clips. Chunks of one frame have no overlap."""
    d = _grid(spark, sf_dir)
    length = frames.chunk_length(F.size("indices"), 20, F.col("duration"), 30.0)
    out = frames.chunks(d, "indices", 20, F.least(F.lit(1), length - 1), "duration", 30.0)
    return out.select("clip", "chunk_id", F.array_join("chunk_indices", ",").alias("chunk"), F.col("overlap_with_previous").alias("overlap"))


@query("gold_select", f"""with m as ({_METERS}), n as (select *, greatest(1, least(3, floor(duration / 2.0)::int + 1)) as n, greatest(1, floor(duration * fps)::int) - 1 as last from m)
select clip, unnest(list_sort(list_distinct(list_transform(range(n), lambda i: least(last, round_even((i + 1) / (n + 1)::double * last, 0)::int))))) as frame from n""")
def gold_select(spark, sf_dir):
    m = _meters(spark, sf_dir)
    return m.select("clip", F.explode(frames.gold_frames(F.col("duration"), F.col("fps"))).alias("frame"))


@query("shard_clips", "select s_suppkey as clip from (select s_suppkey, row_number() over (order by s_suppkey) - 1 as r from supplier) where r % 4 = 1")
def shard_clips(spark, sf_dir):
    return frames.shard(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip")), "clip", 1, 4)


@query("clip_costs", f"""with m as ({_METERS}) select clip, floor(floor(duration * fps) / 8)::int as keyframes, greatest(1, ceil(duration / 30), ceil(floor(duration * fps) / 300))::int as chunks,
  round(floor(floor(duration * fps) / 8) * (0.03 + 5 * 0.31), 6) as seconds, (power(floor(448 / 28), 2) * least(n_frames, 16))::bigint as tokens from m""")
def clip_costs(spark, sf_dir):
    from loomline.operators.labels import prompt_seconds

    m = _meters(spark, sf_dir)
    k = frames.expected_keyframes(F.col("duration"), F.col("fps"), 8)
    return m.select("clip", k.alias("keyframes"), frames.min_chunks(F.col("duration"), F.col("fps"), 300).alias("chunks"), F.round(prompt_seconds(F.lit(5), k), 6).alias("seconds"), frames.vision_tokens(F.lit(448), F.least("n_frames", F.lit(16))).alias("tokens"))


# --- labels of clips ----------------------------------------------------------------------

_VOCABULARY = "['click', 'error', 'purchase', 'signup', 'view']"


@query("federated_status", f"""with {B}, q as (select clip, list_sort(list(distinct label) filter (st < 2)) as p, list_sort(list(distinct label) filter (st < 4)) as asked from b group by clip)
select clip, array_to_string(coalesce(p, []), ',') as positives, array_to_string(list_filter(coalesce(asked, []), lambda x: not list_contains(coalesce(p, []), x)), ',') as negatives,
  array_to_string(list_filter({_VOCABULARY}, lambda x: not list_contains(coalesce(asked, []), x)), ',') as unknown from q""")
def federated_status(spark, sf_dir):
    d = detections(spark, sf_dir)
    per = d.groupBy("clip").agg(F.collect_set(F.when(F.col("st") < 2, F.col("label"))).alias("labels"), F.collect_set(F.when(F.col("st") < 4, F.col("label"))).alias("asked"))
    f = per.withColumn("f", c.federated(F.col("labels"), F.col("asked"), F.array(*map(F.lit, LABELS))))
    return f.select("clip", *(F.array_join(f"f.{n}", ",").alias(n) for n in ("positives", "negatives", "unknown")))


@query("presence_gate", f"with {B} select clip, label, round(greatest(0.0, max(score * presence)), 9) as presence_score, greatest(0.0, max(score * presence)) >= 0.5 as passes from b group by clip, label")
def presence_gate(spark, sf_dir):
    return c.presence_score(detections(spark, sf_dir)).select("clip", "label", _round("presence_score"), (F.col("presence_score") >= 0.5).alias("passes"))


_REASON = """case when st in (2, 3) then 'kept_as_background' when st = 4 then 'not_in_clip_labels' when score < 0.30::double then 'below_score' when presence < 0.50::double then 'below_presence'
  when least(x2 - x1, y2 - y1) < 20 then 'side_too_small' when (x2 - x1) * (y2 - y1) / (640 * 480) < 0.001::double or (x2 - x1) * (y2 - y1) / (640 * 480) > 0.90::double then 'area_out_of_range' end"""
_KEPT = f"""gated as (select *, {_REASON} as reason from b),
boxes as (select clip, frame_ordinal, label, list({{'s': -score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det_id': det_id}} order by -score, x1, y1, x2, y2, det_id) as l from gated where reason is null group by all),
kept as (select unnest(list_reduce(list_transform(l, lambda e: [e]), lambda acc, x: case when len(list_filter(acc, lambda k: {g.iou_sql("k", "x[1]")} > 0.5::double)) > 0 then acc else acc || x end)).det_id as det_id from boxes),
verdicts as (select gated.* exclude (reason), coalesce(reason, case when kept.det_id is not null then 'kept' else 'suppressed_nms' end) as reason from gated left join kept using (det_id))"""


def _verdicts(spark, sf_dir) -> DataFrame:
    return c.cascade(_status(detections(spark, sf_dir)), IMAGE, FRAME)


@query("cascade_pre_nms", f"with {B} select det_id, coalesce({_REASON}, 'to_nms') as reason from b")
def cascade_pre_nms(spark, sf_dir):
    return c.gate(_status(detections(spark, sf_dir)), IMAGE).select("det_id", F.coalesce("reason", F.lit("to_nms")).alias("reason"))


@query("cascade_verdicts", f"with {B}, {_KEPT} select det_id, reason from verdicts")
def cascade_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("det_id", "reason")


@query("cascade_reasons", f"with {B}, {_KEPT} select sess, reason, count(*) as n from verdicts group by all")
def cascade_reasons(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("sess", "reason").agg(F.count("*").alias("n"))


@query("nms_keep", f"""with {B}, boxes as (select clip, frame_ordinal, label, list({{'s': -score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det_id': det_id}} order by -score, x1, y1, x2, y2, det_id) as l from b group by all),
kept as (select unnest(list_reduce(list_transform(l, lambda e: [e]), lambda acc, x: case when len(list_filter(acc, lambda k: {g.iou_sql("k", "x[1]")} > 0.3::double)) > 0 then acc else acc || x end)).det_id as det_id from boxes)
select det_id, kept.det_id is not null as kept from b left join kept using (det_id)""")
def nms_keep(spark, sf_dir):
    return c.nms(detections(spark, sf_dir), FRAME, 0.3).select("det_id", "kept")


@query("missing_labels", f"""with {B}, {_KEPT}, l as (select clip, list_sort(list(distinct label) filter (st < 2)) as labels, list(distinct label) filter (reason = 'kept') as k from verdicts group by clip)
select clip, array_to_string(list_filter(coalesce(labels, []), lambda x: not list_contains(coalesce(k, []), x)), ',') as missing from l""")
def missing_labels(spark, sf_dir):
    d = detections(spark, sf_dir)
    return c.missing_labels(adapters.clips(d), _verdicts(spark, sf_dir)).select("clip", F.array_join("missing_labels", ",").alias("missing"))


@query("top_detections", f"with {B}, r as (select *, row_number() over (partition by clip, frame_ordinal order by score desc, label, x1, y1, x2, y2, det_id) as k from b) select det_id, clip, frame_ordinal from r where k <= 2")
def top_detections(spark, sf_dir):
    return c.top_k(detections(spark, sf_dir), ["clip", "frame_ordinal"], 2).select("det_id", "clip", "frame_ordinal")


@query("temporal_consistency", f"""with {B}, f as (select *, dense_rank() over (partition by clip order by frame_ordinal) as p from b),
n as (select a.det_id, count(distinct b.p) as k from f a join f b on a.clip = b.clip and a.label = b.label and b.p between a.p - 3 and a.p + 3 and a.p <> b.p where {IOU} >= 0.5::double group by a.det_id)
select det_id, 1 + coalesce(k, 0) as appearances, 1 + coalesce(k, 0) >= 2 as consistent from b left join n using (det_id)""")
def temporal_consistency(spark, sf_dir):
    return c.temporal_consistency(detections(spark, sf_dir)).select("det_id", "appearances", "consistent")


_AGREE = f"""p as (select a.det_id, b.det_id as other, a.label = b.label as same, {IOU} as i from b a join b on a.clip = b.clip and a.frame_ordinal = b.frame_ordinal where a.det_id % 2 = 0 and b.det_id % 2 = 1 and {IOU} >= 0.5::double),
ag as (select b.det_id, arg_max(p.other, (i, -p.other)) filter (same) as agreed_with, arg_max(p.other, (i, -p.other)) filter (not same) as cf from b left join p using (det_id) where b.det_id % 2 = 0 group by b.det_id)"""


def _agreed(spark, sf_dir):
    d = detections(spark, sf_dir)
    a, b = d.where("det_id % 2 = 0"), d.where("det_id % 2 = 1")
    return c.agreement(a, b, ["clip", "frame_ordinal"]), b


@query("cross_model_agreement", f"with {B}, {_AGREE} select det_id, agreed_with, case when agreed_with is null then cf end as conflict_with from ag")
def cross_model_agreement(spark, sf_dir):
    return _agreed(spark, sf_dir)[0].select("det_id", "agreed_with", "conflict_with")


@query("cross_model_only_b", f"with {B}, {_AGREE} select det_id from b where det_id % 2 = 1 and det_id not in (select agreed_with from ag where agreed_with is not null)")
def cross_model_only_b(spark, sf_dir):
    a, b = _agreed(spark, sf_dir)
    return c.only_b(b, a).select("det_id")


@query("precision_proxy", f"with {B}, {_AGREE} select count(agreed_with) as agreed, count(*) - count(agreed_with) as only_a, round(count(agreed_with) / count(*), 9) as precision_proxy from ag")
def precision_proxy(spark, sf_dir):
    return c.precision_proxy(_agreed(spark, sf_dir)[0]).select("agreed", "only_a", _round("precision_proxy"))


# --- tracks -------------------------------------------------------------------------------


@query("track_stability", f"""with {B}, l as (select clip, label, frame_ordinal, det_id, x1, y1, x2, y2, lag({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) over (partition by clip, label order by frame_ordinal, det_id) as q from b)
select clip, label, round(avg(case when q is not null then {g.iou_sql("q", "l")} end), 9) as stability, count(*) as n_points from l group by clip, label""")
def track_stability(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("at", F.struct("frame_ordinal", "det_id"))
    return tracks.stability(d, ["clip", "label"], "at").select("clip", "label", _round("stability"), "n_points")


@query("track_summary", f"""with {B}, t as (select clip, label, count(*) as n, count(distinct frame_ordinal // 3) as k, avg(presence) as f from b group by all)
select count(*) as n_tracks, count(*) filter (k > 1) as n_stitched, round(count(*) filter (k > 1) / count(*), 9) as stitched_share, round(avg(n), 9) as mean_length, min(n) as min_length, max(n) as max_length, round(avg(f), 9) as mean_fragmentation from t""")
def track_summary(spark, sf_dir):
    d = detections(spark, sf_dir)
    t = d.groupBy("clip", "label").agg(F.count("*").alias("n_points"), F.count_distinct(F.floor(F.col("frame_ordinal") / 3)).alias("n_chunks"), F.avg("presence").alias("fragmentation"))
    out = tracks.summary(t)
    return out.select(*(_round(x) if x in ("stitched_share", "mean_length", "mean_fragmentation") else F.col(x) for x in out.columns))


@query("stitch_tracks")
def stitch_tracks(spark, sf_dir):
    """No SQL: parts join the first fitting track in order, which is a fold with a list of open tracks as its state."""
    d = detections(spark, sf_dir).withColumn("chunk", F.explode(F.array_distinct(F.array(*(F.floor(x / 3).cast("int") for x in (F.col("frame_ordinal"), F.greatest(F.lit(0), F.col("frame_ordinal") - 1)))))))
    point = F.struct(F.col("frame_ordinal").alias("frame"), "x1", "y1", "x2", "y2", "score")
    parts = d.groupBy("clip", "label", "chunk").agg(F.array_sort(F.collect_list(point)).alias("points"), F.avg("presence").alias("fragmentation"))
    parts = parts.withColumn("place", F.row_number().over(W.partitionBy("clip", "chunk").orderBy("label"))).withColumn("box_source", F.lit("propagated"))
    return tracks.stitch(parts).select("clip", "track_id", "label", F.size("points").alias("n_points"), F.array_join("chunk_ids", ",").alias("chunks"), F.round("fragmentation", 9).alias("fragmentation"))


# --- metrics ------------------------------------------------------------------------------

_MATCH = f"""with recursive {B},
pl as (select clip, frame_ordinal, label, list({{'s': -score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det_id': det_id}} order by -score, x1, y1, x2, y2, det_id) as p from b where det_id % 3 <> 0 group by all),
gl as (select clip, frame_ordinal, label, list({{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'ignore': det_id % 21 = 0}} order by det_id) as g from b where det_id % 3 = 0 group by all),
both_ as (select pl.*, coalesce(g, []) as g from pl left join gl using (clip, frame_ordinal, label)),
st_ as (
  select clip, frame_ordinal, label, p, g, 0 as k, []::bigint[] as used, null::bigint as det_id, null::boolean as is_tp, null::boolean as ignored, null::bigint as gold_id from both_
  union all
  select clip, frame_ordinal, label, p, g, k + 1, case when i >= 0.5::double then used || [best.det_id] else used end, p[k + 1].det_id,
    coalesce(i >= 0.5::double and not best.ignore, false), coalesce(i >= 0.5::double and best.ignore, false), case when i >= 0.5::double then best.det_id end
  from (select *, list_extract(list_sort(list_filter(list_transform(g, lambda c: {{'i': -{g.iou_sql("c", "p[k + 1]")}, 'c': c}}), lambda d: d.i < 0 and not list_contains(used, d.c.det_id))), 1) as top from st_ where k < len(p))
    , lateral (select -top.i as i, top.c as best)),
matched as (select clip, frame_ordinal, label, det_id, is_tp, ignored, gold_id from st_ where k > 0),
np as (select label, count(*) filter (det_id % 21 <> 0) as n_pos from b where det_id % 3 = 0 group by label)"""
_AP = """rk as (select m.label, m.is_tp, n_pos, sum(m.is_tp::int) over w as tp, row_number() over w as k, b.score, b.clip, b.frame_ordinal, b.x1, b.y1, b.x2, b.y2, b.det_id
  from matched m join b using (det_id) join np on np.label = m.label where not m.ignored
  window w as (partition by m.label order by b.score desc, b.clip, b.frame_ordinal, b.x1, b.y1, b.x2, b.y2, b.det_id)),
cv as (select label, n_pos, tp / n_pos as recall, max(tp / k) over (partition by label order by k rows between current row and unbounded following) as best, k from rk),
ap as (select np.label, np.n_pos, (select avg(coalesce((select best from cv where cv.label = np.label and recall >= r / 100::double order by k limit 1), 0)) from range(101) t(r)) as ap from np)"""


def _matched(spark, sf_dir) -> DataFrame:
    d = detections(spark, sf_dir)
    return matching.match(adapters.predictions(d), adapters.gold(d), FRAME)



def _curve_rows(spark, sf_dir) -> DataFrame:
    d = detections(spark, sf_dir).select("det_id", "score", "sess", "x1", "y1", "x2", "y2")
    return _matched(spark, sf_dir).where("not ignored").join(d, "det_id")


def _order():
    return [F.desc("score"), "clip", "frame_ordinal", "x1", "y1", "x2", "y2", "det_id"]


def _ap(spark, sf_dir) -> DataFrame:
    n_pos = matching.positives(adapters.gold(detections(spark, sf_dir)), ["label"])
    return matching.average_precision(_curve_rows(spark, sf_dir), n_pos, ["label"], _order())


@query("match_table", f"{_MATCH} select det_id, is_tp, ignored, gold_id from matched")
def match_table(spark, sf_dir):
    return _matched(spark, sf_dir).select("det_id", "is_tp", "ignored", "gold_id")


@query("ap_per_class", f"{_MATCH}, {_AP} select label, n_pos, round(ap, 9) as ap from ap")
def ap_per_class(spark, sf_dir):
    return _ap(spark, sf_dir).select("label", "n_pos", _round("ap"))


@query("map_macro", f"{_MATCH}, {_AP} select round(avg(ap), 9) as map, count(ap) as n_averaged, count(*) as n_total from ap")
def map_macro(spark, sf_dir):
    return matching.mean_average_precision(_ap(spark, sf_dir)).select(_round("map"), "n_averaged", "n_total")


def _recall(spark, sf_dir) -> DataFrame:
    d = detections(spark, sf_dir)
    return matching.recall(adapters.predictions(d), adapters.gold(d), FRAME, score=0.3)


_MATCH_COUNTED = _MATCH.replace("where det_id % 3 <> 0 group", "where det_id % 3 <> 0 and score >= 0.3::double group").replace("where det_id % 3 = 0 group by all", "where det_id % 3 = 0 and det_id % 21 <> 0 group by all")


@query("recall_per_class", f"{_MATCH_COUNTED} select np.label, n_pos, coalesce(h, 0) as hits, round(coalesce(h, 0) / n_pos, 9) as recall from np left join (select label, count(*) filter (is_tp) as h from matched group by label) using (label)")
def recall_per_class(spark, sf_dir):
    return _recall(spark, sf_dir).select("label", "n_pos", "hits", _round("recall"))


@query("recall_intervals")
def recall_intervals(spark, sf_dir):
    """No SQL: the exact intervals need the beta distribution; tests hold published values."""
    r = _recall(spark, sf_dir)
    return r.withColumn("i", distributions.clopper_pearson_column(F.col("hits"), F.col("n_pos"))).select("label", "n_pos", "hits", F.round("i.lo", 9).alias("lo"), F.round("i.hi", 9).alias("hi"))


@query("hota")
def hota(spark, sf_dir):
    """No SQL: nineteen greedy matchings; held against an independent loop in the tests."""
    d = detections(spark, sf_dir)
    p = adapters.predictions(d).withColumn("track", F.col("li") * 2 + F.col("det_id") % 2)
    out = matching.hota(p, adapters.gold(d).withColumn("track", F.col("li")), "clip", "frame_ordinal")
    return out.select(F.round("alpha", 2).alias("alpha"), _round("deta"), _round("assa"), _round("hota"))


@query("bootstrap_map")
def bootstrap_map(spark, sf_dir, n_resamples: int = 2000):
    """Sessions are drawn on the driver (one stream of draws); matches are made once and reweighted. No SQL: the draws are a Mersenne twister's."""
    d = detections(spark, sf_dir)
    weights = statistics.resample_weights(d, "sess", n_resamples, seed=0)
    n_pos = adapters.gold(d).groupBy("sess", "label").agg(F.count_if(~F.col("ignore")).alias("n")).join(weights, "sess").groupBy("replicate", "label").agg(F.sum(F.col("n") * F.col("weight")).alias("n_pos"))
    ap = matching.reweighted_precision(_curve_rows(spark, sf_dir), n_pos, ["score", *_order()[1:]], ["sess"], weights)
    maps = matching.mean_average_precision(ap, ["replicate"])
    return statistics.percentile_interval(maps, "map", n_resamples).select(_round("lo"), _round("hi"), "n_degenerate")


def _precision(spark, sf_dir) -> DataFrame:
    rows = _matched(spark, sf_dir).join(detections(spark, sf_dir).select("det_id", "sess"), "det_id")
    tp, one = F.col("is_tp").cast("int"), F.lit(1)
    side = lambda x, k: F.sum(F.when(F.col("det_id") % 2 == k, x).otherwise(0))
    return rows.groupBy("sess").agg(side(tp, 0).alias("ta"), side(one, 0).alias("na"), side(tp, 1).alias("tb"), side(one, 1).alias("nb"))


@query("permutation_precision", f"""{_MATCH},
s as (select b.sess, sum(is_tp::int) filter (det_id % 2 = 0) as ta, count(*) filter (det_id % 2 = 0) as na, sum(is_tp::int) filter (det_id % 2 = 1) as tb, count(*) filter (det_id % 2 = 1) as nb
  from matched join b using (det_id) group by b.sess),
m as (select mask, sum(case when mask >> s.sess & 1 = 1 then tb else ta end) / sum(case when mask >> s.sess & 1 = 1 then nb else na end)
  - sum(case when mask >> s.sess & 1 = 1 then ta else tb end) / sum(case when mask >> s.sess & 1 = 1 then na else nb end) as d from range(32768) t(mask), s group by mask)
select round((select d from m where mask = 0), 9) as diff, round((1 + count(*) filter (round(abs(d), 12) >= (select round(abs(d), 12) from m where mask = 0))) / (1 + count(*)), 9) as p_value, count(*) as n_perm from m""")
def permutation_precision(spark, sf_dir):
    """Are even and odd detections equally precise? All swaps of all fifteen sessions."""
    return statistics.paired_permutation(_precision(spark, sf_dir), "sess", most_exact=15).select(_round("diff"), _round("p_value"), "n_perm")


@query("permutation_precision_random")
def permutation_precision_random(spark, sf_dir):
    """The same by random swaps, as is the default above fourteen sessions. No SQL: the swaps are a Mersenne twister's."""
    return statistics.paired_permutation(_precision(spark, sf_dir), "sess").select(_round("diff"), _round("p_value"), "n_perm")


# --- statistics ---------------------------------------------------------------------------


@query("kish", f"with {B}, s as (select sess, count(*)::double as n from b group by sess) select round(count(*) * sum(n * n) / (sum(n) * sum(n)), 9) as design_effect, round(sum(n) * sum(n) / sum(n * n), 9) as effective_size from s")
def kish(spark, sf_dir):
    s = detections(spark, sf_dir).groupBy("sess").agg(F.count("*").cast("double").alias("n"))
    return statistics.kish(s, "n").select(_round("design_effect"), _round("effective_size"))


@query("icc", f"""with {B}, p as (select sess, count(*) as n, avg(score) as m, var_pop(score) * count(*) as w from b group by sess),
a as (select count(*) as k, sum(n) as n, sum(w) as w, sum(n * m * m) - power(sum(n * m), 2) / sum(n) as bt from p)
select k as n_clusters, n / k as mean_size, round(greatest(0, least(1, (bt / (k - 1) - w / (n - k)) / (bt / (k - 1) + (n / k - 1) * w / (n - k)))), 7) as icc,
  round(1 + (n / k - 1) * greatest(0, least(1, (bt / (k - 1) - w / (n - k)) / (bt / (k - 1) + (n / k - 1) * w / (n - k)))), 5) as design_effect from a""")
def icc(spark, sf_dir):
    found = statistics.icc(detections(spark, sf_dir), "sess", "score")
    return found.select("n_clusters", "mean_size", _round("icc", 7), F.round(statistics.design_effect(F.col("icc"), F.col("mean_size")), 5).alias("design_effect"))


@query("wilson", f"""with {B}, s as (select label, count(*) filter (score >= 0.5::double) as k, count(*) as n from b group by label), z as (select *, 1.959963984540054::double as z, k / n as p from s)
select label, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) as lo, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) as hi from z""")
def wilson(spark, sf_dir):
    s = detections(spark, sf_dir).groupBy("label").agg(F.count_if(F.col("score") >= 0.5).alias("k"), F.count("*").alias("n"))
    i = statistics.wilson(F.col("k"), F.col("n"))
    return s.select("label", F.round(i["lo"], 9).alias("lo"), F.round(i["hi"], 9).alias("hi"))


@query("clopper_pearson")
def clopper_pearson(spark, sf_dir):
    """No SQL: needs the beta distribution; tests hold published values."""
    s = detections(spark, sf_dir).groupBy("label").agg(F.count_if(F.col("score") >= 0.5).alias("k"), F.count("*").alias("n"))
    return s.withColumn("i", distributions.clopper_pearson_column(F.col("k"), F.col("n"))).select("label", "k", "n", F.round("i.lo", 9).alias("lo"), F.round("i.hi", 9).alias("hi"))


# --- splits and gold ----------------------------------------------------------------------


@query("logo_folds", f"with {B} select clip, sess, dense_rank() over (order by sess) - 1 as fold from (select distinct clip, sess from b)")
def logo_folds(spark, sf_dir):
    return splits.leave_one_group_out(adapters.clips(detections(spark, sf_dir)), "sess").select("clip", "sess", "fold")


@query("group_kfold")
def group_kfold(spark, sf_dir):
    """No SQL: groups are shuffled by a Mersenne twister before they are dealt out."""
    return splits.group_kfold(adapters.clips(detections(spark, sf_dir)), "sess", 5).select("clip", "sess", "fold")


@query("balance_report", f"""with {B}, i as (select distinct clip, sess % 5 as fold, label from b where st < 2), g as (select fold, label from (select distinct clip % 15 % 5 as fold from b), (select unnest({_VOCABULARY}) as label)),
c as (select g.fold, g.label, count(i.clip) as n from g left join i using (fold, label) group by g.fold, g.label)
select *, (sum(n) over (partition by label))::bigint as total, case when n = 0 then 'absent' when sum(n) over (partition by label) < 8 then 'few' end as warning from c""")
def balance_report(spark, sf_dir):
    items = adapters.clips(detections(spark, sf_dir)).withColumn("fold", F.col("sess") % 5)
    vocabulary = spark.range(1).select(F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    return splits.balance(items, "labels", vocabulary)


@query("threshold_curve", f"""with {B}, t as (select range as i, range / 200::double as threshold from range(201)), p as (select score, st < 2 as pos from b),
c as (select threshold, count(*) filter (pos and score >= threshold) as tp, count(*) filter (not pos and score >= threshold) as fp, count(*) filter (pos and score < threshold) as fn from t, p group by threshold)
select round(threshold, 3) as threshold, tp, fp, fn, round(case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 9) as f1 from c""")
def threshold_curve(spark, sf_dir):
    s = detections(spark, sf_dir).select("score", (F.col("st") < 2).alias("is_positive"))
    return splits.threshold_curve(s).select(_round("threshold", 3), "tp", "fp", "fn", _round("f1"))


@query("best_threshold", f"""with {B}, t as (select range / 200::double as threshold from range(201)), p as (select score, st < 2 as pos from b),
c as (select threshold, count(*) filter (pos and score >= threshold) as tp, count(*) filter (not pos and score >= threshold) as fp, count(*) filter (pos and score < threshold) as fn from t, p group by threshold)
select round(threshold, 3) as threshold, round(case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 9) as f1 from c order by f1 desc, threshold limit 1""")
def best_threshold(spark, sf_dir):
    s = detections(spark, sf_dir).select("score", (F.col("st") < 2).alias("is_positive"))
    return splits.best_threshold(splits.threshold_curve(s)).select(_round("threshold", 3), _round("f1"))


_FRAMES = "fr as (select clip, frame_ordinal, list(distinct label) filter (li < 3) as ex from b where det_id % 3 = 0 group by all)"


def _gold_frames(spark, sf_dir) -> DataFrame:
    gold = adapters.gold(detections(spark, sf_dir))
    return gold.groupBy("clip", "frame_ordinal", "sess").agg(F.sort_array(F.collect_set(F.when(F.col("li") < 3, F.col("label")))).alias("exhaustive_for"), F.count("*").alias("n_boxes"))


@query("gold_filter", f"""with {B}, {_FRAMES} select det_id, case when coalesce(len(ex), 0) = 0 then 'frame_not_annotated' when not list_contains(ex, label) then 'label_not_exhaustive' else 'kept' end as gold_status
  from b left join fr using (clip, frame_ordinal) where det_id % 3 <> 0""")
def gold_filter(spark, sf_dir):
    return splits.gold_filter(adapters.predictions(detections(spark, sf_dir)), _gold_frames(spark, sf_dir), ["clip", "frame_ordinal"]).select("det_id", "gold_status")


@query("gold_progress", f"with {B}, {_FRAMES} select count(*) as n_frames, count(*) filter (coalesce(len(ex), 0) > 0) as annotated, count(distinct clip) as clips, count(distinct clip % 15) as sessions from fr")
def gold_progress(spark, sf_dir):
    f = _gold_frames(spark, sf_dir)
    return f.agg(F.count("*").alias("n_frames"), F.count_if(F.size("exhaustive_for") > 0).alias("annotated"), F.count_distinct("clip").alias("clips"), F.count_distinct("sess").alias("sessions"))


@query("gold_class_counts", f"with {B}, {_FRAMES}, k as (select label, count(*) as n from b join fr using (clip, frame_ordinal) where det_id % 3 = 0 and coalesce(len(ex), 0) > 0 group by label) select v.label, coalesce(n, 0) as n, case when coalesce(n, 0) = 0 then 'absent' when n < 8 then 'few' end as warning from (select unnest({_VOCABULARY}) as label) v left join k using (label)")
def gold_class_counts(spark, sf_dir):
    d = detections(spark, sf_dir)
    annotated = _gold_frames(spark, sf_dir).where(F.size("exhaustive_for") > 0).select("clip", "frame_ordinal")
    items = adapters.gold(d).join(annotated, ["clip", "frame_ordinal"], "left_semi").select(F.array("label").alias("labels"), F.lit(0).alias("fold"))
    vocabulary = spark.range(1).select(F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    return splits.balance(items, "labels", vocabulary).drop("fold", "total")


@query("annotation_budget", f"with {B}, {_FRAMES} select count(*) * 3 as boxes, round_even(count(*) * 3 * 26.5::double / 3600, 1) as hours, round_even(count(*) * 3 * 26.5::double / 3600 / 1.5, 1) as verify_hours from fr")
def annotation_budget(spark, sf_dir):
    n = _gold_frames(spark, sf_dir).agg(F.count("*").alias("n"))
    return n.select(F.inline(F.array(splits.annotation_budget(F.col("n")))))


# --- training-side and exports ------------------------------------------------------------

_SIDES = "o as (select o_orderpriority as class, avg(case when o_orderkey % 2 = 0 then o_totalprice end) as x, avg(case when o_orderkey % 2 = 1 then o_totalprice end) as y from orders group by 1)"


def _sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "class")
    return tuple(o.where(F.col("o_orderkey") % 2 == k).groupBy("class").agg(F.avg("o_totalprice").alias("value")) for k in (0, 1))


@query("retention", f"with {_SIDES} select class, round(x, 4) as before, round(y, 4) as after, round(y - x, 4) as delta, round((y - x) / x, 9) as relative from o")
def retention(spark, sf_dir):
    return splits.retention(*_sides(spark, sf_dir)).select("class", _round("before", 4), _round("after", 4), _round("delta", 4), _round("relative"))


@query("retention_summary", f"""with {_SIDES}, m as (select count(*) as n_held_out, median(x) as mx, median(y) as my, avg(x) as ax, avg(y) as ay from o)
select n_held_out, round(mx, 4) as median_before, round(my, 4) as median_after, round((my - mx) / mx, 9) as median_relative, round((ay - ax) / ax, 9) as mean_relative, 0::bigint as missing_before, 0::bigint as missing_after,
  case when (my - mx) / mx < -0.2::double and (ay - ax) / ax > -0.1::double then 'masked' when (my - mx) / mx < -0.25::double then 'fell' end as warning from m""")
def retention_summary(spark, sf_dir):
    return splits.retention_summary(splits.retention(*_sides(spark, sf_dir))).select("n_held_out", _round("median_before", 4), _round("median_after", 4), _round("median_relative"), _round("mean_relative"), "missing_before", "missing_after", "warning")


_SWEEP = "w as (select (o_custkey % 11) / 10::double as alpha, avg(o_totalprice) as in_domain, avg(o_totalprice) filter (o_orderkey % 2 = 0) as retention from orders group by 1)"


def _sweep(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("alpha", F.col("o_custkey") % 11 / F.lit(10.0))
    return o.groupBy("alpha").agg(F.avg("o_totalprice").alias("in_domain"), F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("retention"))


@query("sweep_choice", f"""with {_SWEEP}, f as (select retention * 0.9::double as floor from w where alpha = 0)
select round(alpha, 3) as alpha, round(in_domain, 4) as in_domain, round(retention, 4) as retention, false as fallback from w, f where retention >= floor order by w.in_domain desc, w.alpha limit 1""")
def sweep_choice(spark, sf_dir):
    return splits.operating_point(_sweep(spark, sf_dir)).select(_round("alpha", 3), _round("in_domain", 4), _round("retention", 4), "fallback")


@query("training_schedule", """with c as (select c_nationkey as class, count(*) as n from customer group by 1)
select class, case when n < 50 then 4 when n <= 300 then 8 when n <= 1000 then 16 when n <= 5000 then 32 else 64 end as rank, greatest(1, floor(n / 16))::int as steps_per_epoch,
  (greatest(1, floor(n / 16)) * 2)::int as total_steps, greatest(1, round_even(greatest(1, floor(n / 16)) * 2 * 0.03::double, 0))::int as warmup_steps from c""")
def training_schedule(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("class")).agg(F.count("*").alias("n"))
    s = splits.schedule(F.col("n"), F.lit(1), F.lit(16), F.lit(2), 0.03)
    return n.select("class", splits.lora_rank(F.col("n")).alias("rank"), *(s[x].alias(x) for x in ("steps_per_epoch", "total_steps", "warmup_steps")))


@query("coco_targets", f"""with {B}, i as (select distinct clip * 10 + frame_ordinal as id from b), t as (select clip * 10 + frame_ordinal as id, det_id, li, x1, x2, y1, y2 from b where det_id % 3 = 0 and det_id % 21 <> 0)
select i.id, det_id as annotation, li as label, round((x1 + (x2 - x1) / 2) / 640, 9) as cx, round((y1 + (y2 - y1) / 2) / 480, 9) as cy, round((x2 - x1) / 640, 9) as w, round((y2 - y1) / 480, 9) as h from i left join t using (id)""")
def coco_targets(spark, sf_dir):
    """A row for each target; an image without any has one of nulls."""
    d = detections(spark, sf_dir).withColumn("image_id", F.col("clip") * 10 + F.col("frame_ordinal"))
    images = d.select(F.col("image_id").alias("id")).distinct().withColumns({"width": F.lit(IMAGE[0]), "height": F.lit(IMAGE[1])})
    categories = formats.category_table(spark, list(LABELS))
    boxes = adapters.gold(d)
    annotations = formats.coco_annotations(boxes.withColumn("image_id", F.struct("image_id", "det_id")), categories).select("image_id.image_id", F.col("image_id.det_id").alias("id"), "category_id", "bbox", "iscrowd")
    t = formats.coco_targets(images, annotations).select("id", F.explode_outer("targets").alias("t"))
    return t.select("id", "t.annotation", "t.label", *(F.round(f"t.{c}", 9).alias(c) for c in ("cx", "cy", "w", "h")))


@query("coco_index", f"with {B}, c as (select unnest({_VOCABULARY}) as name, unnest(range(1, 6))::int as category_id) select category_id, name, count(det_id) as n, count(distinct clip * 10 + frame_ordinal) filter (det_id is not null) as images from c left join (select * from b where det_id % 3 = 0) g on g.label = c.name group by category_id, name")
def coco_index(spark, sf_dir):
    d = adapters.gold(detections(spark, sf_dir)).withColumn("image_id", F.col("clip") * 10 + F.col("frame_ordinal"))
    categories = formats.category_table(spark, list(LABELS))
    return formats.index_coverage(d.select("image_id").distinct(), formats.coco_annotations(d, categories), categories)


@query("coco_annotations", f"""with {B} select (row_number() over (order by clip, frame_ordinal, det_id))::int as id, clip * 10 + frame_ordinal as image_id, (li + 1)::int as category_id, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, (x2 - x1) * (y2 - y1) as area, (det_id % 21 = 0)::int as iscrowd from b where det_id % 3 = 0""")
def coco_annotations(spark, sf_dir):
    d = adapters.gold(detections(spark, sf_dir)).withColumn("image_id", F.col("clip") * 10 + F.col("frame_ordinal"))
    a = formats.numbered_annotations(d, formats.category_table(spark, list(LABELS)), ["clip", "frame_ordinal", "det_id"])
    return a.select("id", "image_id", "category_id", *(F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")), "area", "iscrowd")


@query("tao_videos", f"""with {B}, q as (select clip, list(distinct label) filter (st < 2) as p, list(distinct label) filter (st < 4) as a from b group by clip)
select clip, array_to_string(list_filter(range(1, 6), lambda i: list_contains(coalesce(a, []), {_VOCABULARY}[i]) and not list_contains(coalesce(p, []), {_VOCABULARY}[i])), ',') as neg,
  array_to_string(list_filter(range(1, 6), lambda i: not list_contains(coalesce(a, []), {_VOCABULARY}[i])), ',') as not_exhaustive from q""")
def tao_videos(spark, sf_dir):
    d = detections(spark, sf_dir)
    per = d.groupBy("clip").agg(F.collect_set(F.when(F.col("st") < 2, F.col("label"))).alias("labels"), F.collect_set(F.when(F.col("st") < 4, F.col("label"))).alias("asked"))
    f = per.select("clip", c.federated(F.col("labels"), F.col("asked"), F.array(*map(F.lit, LABELS))).alias("f")).select("clip", "f.negatives", "f.unknown")
    return formats.tao_videos(f, list(LABELS)).select("clip", F.array_join("neg_category_ids", ",").alias("neg"), F.array_join("not_exhaustive_category_ids", ",").alias("not_exhaustive"))


@query("synthetic_units", "select event_id, round(('0x' || substr(sha256('unit|' || event_id), 1, 13))::bigint / 4503599627370496::double, 12) as u from events")
def synthetic_units(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(synthetic.unit(F.lit("unit"), F.col("event_id")), 12).alias("u"))


# --- summaries, warnings, choices -----------------------------------------------------------


@query("cascade_summary", f"""with {B}, {_KEPT}, l as (select clip, list(distinct label) filter (st < 2) as labels, list(distinct label) filter (reason = 'kept') as k from verdicts group by clip)
select 'reason' as kind, reason as name, count(*) as n from verdicts group by reason
union all select 'never_found', x, count(*) from (select unnest(list_filter(coalesce(labels, []), lambda x: not list_contains(coalesce(k, []), x))) as x from l) group by x""")
def cascade_summary(spark, sf_dir):
    return c.summary(adapters.clips(detections(spark, sf_dir)), _verdicts(spark, sf_dir))


def _scores(spark, sf_dir) -> DataFrame:
    return detections(spark, sf_dir).select(F.bround("score", 1).alias("score"), (F.col("st") < 2).alias("is_positive"), (F.col("sess") % 5).alias("fold"))


@query("global_threshold", f"""with {B}, p as (select round_even(score, 1) as score, st < 2 as pos from b), t as (select distinct round_even(score, 4) as threshold from p),
c as (select threshold, count(*) filter (pos and score >= threshold) as tp, count(*) filter (not pos and score >= threshold) as fp, count(*) filter (pos and score < threshold) as fn from t, p group by threshold)
select round(threshold, 4) as threshold, round(case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 9) as f1 from c order by f1 desc, threshold limit 1""")
def global_threshold(spark, sf_dir):
    """Over pooled out-of-fold scores; the grid is the distinct scores, as these are few."""
    return splits.choose_threshold(_scores(spark, sf_dir)).select(_round("threshold", 4), _round("f1"))


@query("held_out_classes", "with v(name, boxes) as (select unnest(['beaker', 'conical_flask', 'round_bottom_flask', 'volumetric_flask', 'measuring_cylinder', 'test_tube', 'test_tube_holder', 'microscope']), true union all select unnest(['pipette', 'centrifuge', 'autoclave', 'spectrophotometer', 'orbital_shaker', 'fume_hood', 'analytical_balance']), false) select name, (row_number() over (order by not boxes, name))::int as place from v where name <> 'beaker' order by place limit 6")
def held_out_classes(spark, sf_dir):
    from loomline.functions.vocabulary import vocabulary

    return splits.held_out_classes(vocabulary(spark), 6, keep=("beaker",))


@query("memory_schedule", "select (row_number() over (order by t, s, n))::int as place, s as frame_size, n as n_frames, t as tokens from (select s, n, (floor(s / 28) * floor(s / 28) * n)::bigint as t from (select unnest([336, 448, 560, 672, 1008]) as s), (select unnest([1, 4, 8, 16]) as n))")
def memory_schedule(spark, sf_dir):
    return frames.memory_schedule(spark)


@query("spread_vs_depth", "select n_clips, n_frames, round(1 + (n_frames - 1) * icc, 9) as deff, round(n_clips * n_frames / (1 + (n_frames - 1) * icc), 9) as n_eff from (select c_nationkey as n_frames0, count(*)::int as n_clips, (c_nationkey + 1)::int as n_frames, 0.6::double as icc from customer group by all)")
def spread_vs_depth(spark, sf_dir):
    k = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("int").alias("n_clips")).withColumn("n_frames", (F.col("c_nationkey") + 1).cast("int"))
    worth = statistics.spread_vs_depth(F.col("n_clips"), F.col("n_frames"), F.lit(0.6))
    return k.select("n_clips", "n_frames", F.round(worth["deff"], 9).alias("deff"), F.round(worth["n_eff"], 9).alias("n_eff"))


@query("sweep_dominating", f"""with {_SWEEP}, e as (select max(in_domain) as i, max(retention) as r from w where alpha in (0, 1))
select round(alpha, 3) as alpha, round(in_domain, 4) as in_domain, round(retention, 4) as retention from w, e where in_domain > i and retention > r""")
def sweep_dominating(spark, sf_dir):
    return splits.dominating(_sweep(spark, sf_dir)).select(_round("alpha", 3), _round("in_domain", 4), _round("retention", 4))


def _judged(spark, sf_dir):
    """Predictions, ground truth and gold frames, sessions being eight rooms."""
    d = detections(spark, sf_dir).withColumn("sess", F.col("clip") % 8)
    gold = adapters.gold(d)
    frames_ = gold.groupBy("clip", "frame_ordinal", "sess").agg(F.sort_array(F.collect_set(F.when(F.col("li") < 3, F.col("label")))).alias("exhaustive_for"))
    return adapters.predictions(d), gold, frames_


@query("gold_warnings", f"""with {B}, fr as (select clip, frame_ordinal, list(distinct label) filter (li < 3) as ex from b where det_id % 3 = 0 group by all), n as (select count(*) as n, count(*) filter (len(ex) > 0) as d from fr),
g as (select label, count(*) as n from b join fr using (clip, frame_ordinal) where det_id % 3 = 0 and len(ex) > 0 group by label)
select '0' as place, (n - d) || ' of ' || n || ' frames are not annotated; scoring would take them for empty' as warning from n where n > d
union all select '1', 'only 8 sessions, which the width of the interval rests on'
union all select '2' || v.label, case when coalesce(n, 0) = 0 then 'class ' || v.label || ' has no gold boxes' else 'class ' || v.label || ' has only ' || n || ' gold boxes' end from (select unnest({_VOCABULARY}) as label) v left join g using (label) where coalesce(n, 0) < 8""")
def gold_warnings(spark, sf_dir):
    _, gold, frames_ = _judged(spark, sf_dir)
    vocabulary = spark.range(1).select(F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    return report.gold_warnings(frames_, gold, vocabulary)


@query("score_report")
def score_report(spark, sf_dir):
    """No SQL: resampled intervals. Tests hold its parts against the operators' and loops."""
    found = report.score(*_judged(spark, sf_dir))
    return found.select(_round("map"), "n_averaged", "n_total", _round("lo"), _round("hi"), "ci_trustworthy", "n_sessions", "n_gold_frames", "n_gold_boxes", "test", _round("kish_design_effect"), "kept", "dropped_unannotated_frame", "dropped_class_not_checked", F.to_json("warnings").alias("warnings"))


@query("compare_report")
def compare_report(spark, sf_dir):
    """Even against odd detections as two systems, by all swaps of eight rooms. No SQL: a macro average for each swap."""
    p, gold, frames_ = _judged(spark, sf_dir)
    found = report.compare(p.where("det_id % 2 = 0"), p.where("det_id % 2 = 1"), gold, frames_)
    return found.select(_round("map_a"), _round("map_b"), _round("diff"), _round("p_value"), "exact", "n_perm", _round("sd"), _round("minimum_detectable"), "resolvable", F.to_json("warnings").alias("warnings"))


@query("provenance_report", "select * from (values ('verified', {V}::bigint), ('estimated', {E}::bigint), ('unmeasured', {U}::bigint)) t(provenance, n)".format(V=sum(t == "verified" for *_, t in config.DEFAULTS), E=sum(t == "estimated" for *_, t in config.DEFAULTS), U=sum(t == "unmeasured" for *_, t in config.DEFAULTS)))
def provenance_report(spark, sf_dir):
    return config.provenance_report(spark).drop("paths")
