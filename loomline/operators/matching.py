"""Matching predictions with ground truth, average precision, recall and tracking accuracy.

Predictions are matched once; curves, resamples and permutations reweight the
matched rows. Matching folds each image's boxes of a label in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.geometry import iou_sql
from loomline.operators.run import written

#: Blocks of a label's curve, for labels of more than BLOCK rows; and weights that a task holds at once.
BLOCKS = 64
BLOCK = 1 << 14
STEP = 1 << 20

_STATE = "struct<used:array<int>,out:array<struct<det_id:bigint,is_tp:boolean,ignored:boolean,gold_id:bigint>>>"


def match(preds: DataFrame, gts: DataFrame, keys: list[str], threshold: str = "0.5D", max_dets: int = 0, cap_keys: list[str] | None = None, rank: str = "-score") -> DataFrame:
    """A row for each prediction: keys, det_id, is_tp, ignored, gold_id (of the matched ground truth).

    By descending score (then place), each prediction takes the unmatched ground truth of its keys that
    it overlaps most (the first by det_id among equal ones); a true positive if the overlap reaches the
    threshold, ignored if that ground truth is. Before, each image (cap_keys) keeps its best ``max_dets``.
    """
    if max_dets:
        order = W.partitionBy(*(cap_keys or keys)).orderBy(F.expr(rank), "label", "x1", "y1", "x2", "y2", "det_id")
        preds = preds.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max_dets)
    p = preds.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.expr(rank).alias("s"), "x1", "y1", "x2", "y2", "det_id"))).alias("_p"))
    g = gts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("det_id", "x1", "y1", "x2", "y2", "ignore"))).alias("_g"))
    best = f"""array_max(filter(transform(_g, (g, i) -> named_struct('iou', {iou_sql('g', 'p')}, 'o', -i, 'ignore', g.ignore, 'gold_id', g.det_id)),
        c -> c.iou > 0 and not array_contains(acc.used, -c.o)))"""
    step = f"""transform(array({best}), b -> cast(if(b.iou >= {threshold},
        named_struct('used', concat(acc.used, array(-b.o)), 'out', concat(acc.out, array(named_struct('det_id', p.det_id, 'is_tp', not b.ignore, 'ignored', b.ignore, 'gold_id', b.gold_id)))),
        named_struct('used', acc.used, 'out', concat(acc.out, array(named_struct('det_id', p.det_id, 'is_tp', false, 'ignored', false, 'gold_id', cast(null as bigint))))))
        as {_STATE}))[0]"""
    fold = f"aggregate(_p, cast(named_struct('used', array(), 'out', array()) as {_STATE}), (acc, p) -> {step})"
    both = p.join(g, keys, "left").withColumn("_g", F.coalesce("_g", F.expr("slice(array(named_struct('det_id', 0L, 'x1', 0D, 'y1', 0D, 'x2', 0D, 'y2', 0D, 'ignore', false)), 1, 0)")))
    return both.select(*keys, F.inline(F.expr(fold)["out"]))


def positives(gts: DataFrame, keys: list[str]) -> DataFrame:
    """n_pos: ground truths that count."""
    return gts.groupBy(*keys).agg(F.count_if(~F.col("ignore")).alias("n_pos"))


def average_precision(matched: DataFrame, n_pos: DataFrame, keys: list[str], order: list[str | Column], weight: str | None = None) -> DataFrame:
    """Per keys the 101-point interpolated AP; null without positives, 0 without predictions.

    matched: predictions that aren't ignored, with is_tp. n_pos: every key with its positives.
    A row of weight k counts as k copies (of rows and, in n_pos, of positives).
    A true positive that raises the count of found ones from s to t is the first to reach recall
    k/100 for the k with 100 s < k n <= 100 t; the first one also stands at recall 0.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    by = W.partitionBy(*keys).orderBy(*order, F.desc("is_tp"))
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = matched.join(n_pos, keys).withColumn("_w", w).where("_w > 0")
    rows = rows.withColumn("_tp", F.sum(F.when(F.col("is_tp"), F.col("_w")).otherwise(0)).over(upto)).withColumn("_all", F.sum("_w").over(upto))
    later = W.partitionBy(*keys).orderBy(F.desc("_all")).rowsBetween(W.unboundedPreceding, W.currentRow)  # backwards: a frame that shrinks is summed anew for each row
    rows = rows.withColumn("_best", F.max(F.col("_tp") / F.col("_all")).over(later))
    reached = lambda t: F.floor(100 * t / F.col("n_pos"))
    points = reached(F.col("_tp")) - reached(F.col("_tp") - F.col("_w")) + (F.col("_tp") == F.col("_w")).cast("int")
    sums = rows.where(F.col("is_tp") & (F.col("n_pos") > 0)).groupBy(*keys).agg((F.sum(points * F.col("_best")) / 101).alias("_ap"))
    return n_pos.join(sums, keys, "left").withColumn("ap", F.when(F.col("n_pos") > 0, F.coalesce("_ap", F.lit(0.0)))).drop("_ap")


def reweighted_precision(matched: DataFrame, n_pos: DataFrame, order: list[str | Column], unit: list[str], weights: DataFrame) -> DataFrame:
    """As ``average_precision`` by replicate and label of ``matched`` joined to ``weights`` (replicate, unit, weight), without a row for each replicate and row.

    n_pos: (replicate, label, n_pos). order: descending score first. Replicates, units and labels are listed on the driver.
    Each label's rows are sorted into blocks once. Counts of a block by unit give where each replicate stands before it;
    one pass gives each block's best precision, the next one the sums, for all replicates at once.
    """
    spark = matched.sparkSession
    listed = weights.select("replicate", F.to_json(F.struct(*unit)).alias("unit"), "weight").toArrow().to_pandas()
    positives_ = n_pos.select("replicate", "label", "n_pos").toArrow().to_pandas()
    replicates, names = (np.array(sorted(set(x))) for x in (positives_["replicate"], listed["unit"]))
    of = np.zeros((len(replicates), len(names)), np.int64)
    known = listed[listed["replicate"].isin(replicates)]
    np.add.at(of, (np.searchsorted(replicates, known["replicate"]), np.searchsorted(names, known["unit"])), known["weight"].to_numpy())
    need = {x: np.zeros(len(replicates)) for x in set(positives_["label"])}
    for x, rows in positives_.groupby("label"):
        need[x][np.searchsorted(replicates, rows["replicate"])] = rows["n_pos"]

    places = spark.createDataFrame([(x, i) for i, x in enumerate(names.tolist())], "_unit string, _u int")
    rows = matched.withColumn("_unit", F.to_json(F.struct(*unit))).join(F.broadcast(places), "_unit").join(F.broadcast(n_pos.select("label").distinct()), "label")
    keep = written(spark)
    rows = keep("rows", rows.select("label", "_u", "is_tp", *dict.fromkeys(order)))
    bounds = {r.label: np.unique(r.bounds) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.percentile_approx("score", [i / BLOCKS for i in range(1, BLOCKS)], 10_000).alias("bounds")).where(F.col("n") > BLOCK).collect()}

    @F.arrow_udf("int")
    def block(label: pa.Array, score: pa.Array) -> pa.Array:
        """Higher scores have earlier blocks; no score, the last one."""
        out, own, values = np.zeros(len(score), np.int32), np.array(label.to_pylist(), object), score.to_numpy(zero_copy_only=False)
        for x, ends in bounds.items():
            mine = own == x
            out[mine] = len(ends) - np.searchsorted(ends, values[mine], "right")
        return pa.array(np.where(score.is_null().to_numpy(zero_copy_only=False), BLOCKS, out).astype(np.int32))

    def pack(batches):
        now, held = None, ([], [])
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), *(pa.array([np.concatenate(x)]) for x in held)], names=["label", "block", "units", "misses"])
        for batch in batches:
            own, at = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            units, hits = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            starts = [i for i in range(len(at)) if not i or at[i] != at[i - 1] or own[i] != own[i - 1]]
            for i, z in zip(starts, [*starts[1:], len(at)]):
                if now != (own[i], at[i]):
                    if now is not None:
                        yield done()
                    now, held = (own[i], at[i]), ([], [])
                held[0].append(units[i:z])
                held[1].append(~hits[i:z])
        if now is not None:
            yield done()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = rows.withColumn("block", block("label", "score")).repartition(tasks, "label", "block")
    placed = placed.sortWithinPartitions("label", "block", F.desc("score"), *order[1:], F.desc("is_tp")).select("label", "block", "_u", "is_tp")
    packed = placed.mapInArrow(pack, "label string, block int, units array<int>, misses array<boolean>")
    packed = keep("curve", packed).repartition(tasks)  # small rows of much work

    def count(batches):
        for batch in batches:
            found = [tuple(np.bincount(u, w, minlength=len(names)).astype(np.int64) for w in (None, hits)) for u, hits in map(_curve, batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k].tolist() for x in found], pa.list_(pa.int64())) for k in (0, 1))], names=["label", "block", "n", "tp"])

    before: dict[tuple, tuple] = {}
    at: dict[str, tuple] = {}
    for r in sorted(packed.mapInArrow(count, "label string, block int, n array<long>, tp array<long>").collect(), key=lambda r: (r.label, r.block)):  # BLOCKS of each label at most
        n, tp = at.get(r.label, (0, 0))
        before[r.label, r.block] = n, tp
        at[r.label] = n + np.array(r.n), tp + np.array(r.tp)

    def sweep(row, step):
        """(replicates, places) of a block with the found ones, the weights and the precision at its true positives."""
        label, k, (units, hits) = row[0].as_py(), row[1].as_py(), _curve(row[2], row[3])
        n, tp = (of @ np.broadcast_to(x, len(names)) for x in before[label, k])
        spots = np.flatnonzero(hits)
        upto = np.zeros((len(names), len(spots)))  # rows of each unit up to each true positive
        seen = units[: spots[-1] + 1] if len(spots) else units[:0]
        np.add.at(upto, (seen, np.searchsorted(spots, np.arange(len(seen)))), 1)
        upto = np.cumsum(upto, axis=1)
        each = max(1, step // max(1, len(spots)))
        for a in range(0, len(replicates), each):
            some = slice(a, a + each)
            all_ = n[some, None] + of[some].astype(float) @ upto
            w = of[some][:, units[spots]]
            found = tp[some, None] + np.cumsum(w, axis=1)
            yield some, found, w, np.where(w > 0, found / np.maximum(all_, 1), 0.0)

    def best(batches):
        for batch in batches:
            for row in zip(*batch.columns):
                most = np.concatenate([x.max(axis=1, initial=0.0) for *_, x in sweep(row, STEP)])
                yield pa.RecordBatch.from_arrays([pa.array([row[0].as_py()]), pa.array([row[1].as_py()], pa.int32()), pa.array([most.tobytes()], pa.binary())], names=["label", "block", "most"])

    after, top = {}, {}
    for r in sorted(packed.mapInArrow(best, "label string, block int, most binary").collect(), key=lambda r: (r.label, -r.block)):
        after[r.label, r.block] = top.get(r.label, np.zeros(len(replicates)))
        top[r.label] = np.maximum(after[r.label, r.block], np.frombuffer(r.most))

    def add(batches):
        for batch in batches:
            for row in zip(*batch.columns):
                label, total = row[0].as_py(), np.zeros(len(replicates))
                last = after[label, row[1].as_py()]
                for some, found, w, precision in sweep(row, STEP):
                    reached = np.maximum.accumulate(precision[:, ::-1], axis=1)[:, ::-1]
                    n = need[label][some, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        points = np.floor(100 * found / n) - np.floor(100 * (found - w) / n) + (found == w)
                    total[some] = np.where((w > 0) & (n > 0), points * np.maximum(reached, last[some, None]), 0.0).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(replicates), pa.array([label] * len(replicates)), pa.array(total)], names=["replicate", "label", "_s"])

    sums = packed.mapInArrow(add, "replicate long, label string, _s double").groupBy("replicate", "label").agg((F.sum("_s") / 101).alias("_ap"))
    return n_pos.join(sums, ["replicate", "label"], "left").withColumn("ap", F.when(F.col("n_pos") > 0, F.coalesce("_ap", F.lit(0.0)))).drop("_ap")


def _curve(units: pa.Scalar, misses: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """A block's units and whether its rows are true positives."""
    return units.values.to_numpy(), ~misses.values.to_numpy(zero_copy_only=False)


def mean_average_precision(ap: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The mean over labels that have one, how many those are, and how many labels there are."""
    return ap.groupBy(*(keys or [])).agg(F.avg("ap").alias("map"), F.count("ap").alias("n_averaged"), F.count("*").alias("n_total"))


def recall(preds: DataFrame, gts: DataFrame, keys: list[str], label: str = "label", score: float = 0.0) -> DataFrame:
    """Per label: positives, hits of predictions from a score on, and their share (null without positives); ignored ground truth is left out before matching."""
    counted = gts.where("not ignore")
    hits = match(preds.where(F.col("score") >= score), counted, keys).groupBy(label).agg(F.count_if("is_tp").alias("hits"))
    n = counted.groupBy(label).agg(F.count("*").alias("n_pos"))
    return n.join(hits, label, "left").select(label, "n_pos", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("n_pos")).alias("recall"))


def hota(preds: DataFrame, gts: DataFrame, clip: str, frame: str, alphas: list[float] | None = None) -> DataFrame:
    """Per alpha: deta, assa and hota; predictions and ground truth carry track, which is distinct within a clip."""
    alphas = alphas or [k / 20 for k in range(1, 20)]
    at = F.explode(F.array(*map(F.lit, alphas))).alias("alpha")
    p, g = preds.select("*", at), gts.withColumn("ignore", F.lit(False)).select("*", at)
    keys = ["alpha", clip, frame, "label"]
    found = match(p, g, keys, threshold="alpha", rank="struct(-score, track)").where("is_tp")
    pairs = found.join(preds.select("det_id", F.col("track").alias("_pt")), "det_id").join(gts.select(F.col("det_id").alias("gold_id"), F.col("track").alias("_gt")), "gold_id")
    pairs = pairs.groupBy("alpha", clip, "_pt", "_gt").agg(F.count("*").alias("_a"))
    long_p = preds.groupBy(clip, F.col("track").alias("_pt")).agg(F.count("*").alias("_np"))
    long_g = gts.groupBy(clip, F.col("track").alias("_gt")).agg(F.count("*").alias("_ng"))
    pairs = pairs.join(long_p, [clip, "_pt"]).join(long_g, [clip, "_gt"])
    per = pairs.groupBy("alpha").agg(F.sum("_a").alias("_tp"), F.sum(F.col("_a") * F.col("_a") / (F.col("_np") + F.col("_ng") - F.col("_a"))).alias("_s"))
    totals = preds.agg(F.count("*").alias("_p")).crossJoin(gts.agg(F.count("*").alias("_g")))  # one row
    out = totals.select("*", at).join(per, "alpha", "left")
    tp = F.coalesce("_tp", F.lit(0))
    deta = F.when(F.col("_g") > 0, tp / (F.col("_p") + F.col("_g") - tp))
    assa = F.when(F.col("_g") > 0, F.coalesce(F.col("_s") / F.col("_tp"), F.lit(0.0)))
    return out.select("alpha", deta.alias("deta"), assa.alias("assa"), F.sqrt(deta * assa).alias("hota"))
