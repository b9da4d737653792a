"""Splits by group, thresholds, gold sets, and training-side tables."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class TooFewGroups(ValueError):
    pass


def group_kfold(items: DataFrame, group: str, n_splits: int, seed: int = 0, least_groups: int = 4) -> DataFrame:
    """``items`` with fold: whole groups, largest first, each to the fold with the fewest items.

    Groups (sessions) are few; their sizes are counted in the plan and dealt out on the driver.
    """
    sizes = {r[0]: r[1] for r in items.groupBy(group).count().collect()}
    if n_splits < 2 or len(sizes) < max(least_groups, n_splits):
        raise TooFewGroups(f"{len(sizes)} groups for {n_splits} folds")
    names = sorted(sizes)
    random.Random(seed).shuffle(names)
    filled, fold_of = [0] * n_splits, []
    for name in sorted(names, key=lambda g: -sizes[g]):
        fold = filled.index(min(filled))
        filled[fold] += sizes[name]
        fold_of.append((name, fold))
    table = items.sparkSession.createDataFrame(fold_of, f"{group} {items.schema[group].dataType.simpleString()}, fold int")
    return items.join(table, group)


def leaky_kfold(items: DataFrame, item: str, n_splits: int, seed: int = 0) -> DataFrame:
    """``items`` with fold by clip instead of session: a negative control, for measuring leakage only."""
    return group_kfold(items, item, n_splits, seed, least_groups=2)


def leakage_gap(items: DataFrame, group: str, item: str, score: Callable[[DataFrame, DataFrame], float], n_splits: int = 5, seed: int = 0) -> dict:
    """How much a score of (training, validation) rows gains if folds split sessions apart. ``score`` runs once for each fold of either scheme."""
    found = {}
    for name, folded in (("grouped", group_kfold(items, group, n_splits, seed, least_groups=2)), ("ungrouped", leaky_kfold(items, item, n_splits, seed))):
        found[name] = [score(folded.where(F.col("fold") != k), folded.where(F.col("fold") == k)) for k in range(n_splits)]
    means = {k: sum(v) / len(v) for k, v in found.items()}
    sizes = items.agg(F.count_distinct(group), F.count_distinct(item)).head()
    return {"grouped_mean": means["grouped"], "ungrouped_mean": means["ungrouped"], "gap": means["ungrouped"] - means["grouped"], "grouped_scores": found["grouped"], "ungrouped_scores": found["ungrouped"], "n_groups": sizes[0], "n_clips": sizes[1]}


def leave_one_group_out(items: DataFrame, group: str) -> DataFrame:
    """``items`` with fold: the rank of their group. Ranks run over the distinct groups alone."""
    groups = items.select(group).distinct().withColumn("fold", F.row_number().over(W.orderBy(group)) - 1)
    return items.join(groups, group)


def fold_scheme(n_groups: Column, below: int = 12, n_folds: int = 5) -> Column:
    return F.when(n_groups < below, F.struct(F.lit("leave_one_group_out").alias("scheme"), n_groups.cast("int").alias("n_folds"))).otherwise(F.struct(F.lit("group_kfold").alias("scheme"), F.lit(n_folds).alias("n_folds")))


def balance(items: DataFrame, labels: str, vocabulary: DataFrame, least: int = 8) -> DataFrame:
    """Per fold and class the items with it, zeros included, the class's total over folds, and a warning: absent from the fold, or few (fewer than ``least``, but some) in all."""
    counts = items.select("fold", F.explode(F.array_distinct(labels)).alias("label")).groupBy("fold", "label").agg(F.count("*").alias("n"))
    grid = items.select("fold").distinct().crossJoin(vocabulary.select("label").distinct())  # folds by classes
    n = F.coalesce("n", F.lit(0))
    found = grid.join(counts, ["fold", "label"], "left").select("fold", "label", n.alias("n"))
    totals = found.groupBy("label").agg(F.sum("n").alias("total"))
    warning = F.when(F.col("n") == 0, "absent").when((F.col("total") > 0) & (F.col("total") < least), "few")
    return found.join(totals, "label").select("fold", "label", "n", "total", warning.alias("warning"))


def threshold_curve(scores: DataFrame, steps: int = 200) -> DataFrame:
    """(threshold, tp, fp, fn, f1) at i/steps: one pass of counts by the last threshold that a score reaches, then running sums over the grid."""
    last = F.least(F.lit(steps), F.floor(F.col("score") * steps)).cast("int")
    last = F.when(last / steps <= F.col("score"), last).otherwise(last - 1)
    counts = scores.groupBy(last.alias("i")).agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("n"))
    grid = scores.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    up = W.orderBy("i").rowsBetween(W.currentRow, W.unboundedFollowing)  # the grid only
    whole = W.partitionBy()
    full = counts.join(grid, "i", "full").withColumn("tp", F.coalesce(F.sum("p").over(up), F.lit(0))).withColumn("fp", F.coalesce(F.sum("n").over(up), F.lit(0)))
    full = full.withColumn("fn", F.coalesce(F.sum("p").over(whole), F.lit(0)) - F.col("tp")).where("i >= 0")
    return full.select((F.col("i") / steps).alias("threshold"), "tp", "fp", "fn", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


class LeakageError(ValueError):
    pass


def score_grid(scores: DataFrame, most: int = 200) -> list[float]:
    """The distinct scores to four places if they are ``most`` or fewer, else i/200."""
    distinct = scores.select(F.bround("score", 4).alias("t")).where("t is not null").distinct().limit(most + 1).collect()
    return sorted(r[0] for r in distinct) if len(distinct) <= most else [i / 200 for i in range(201)]


def grid_curve(scores: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, f1) over a sorted grid: one pass of counts by how many thresholds a score reaches, then running sums over the grid."""
    reached = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("score")))
    counts = scores.groupBy(reached.alias("i")).agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("n"))
    places = scores.sparkSession.createDataFrame([(0, None), *((i + 1, t) for i, t in enumerate(grid))], "i int, threshold double")
    up, whole = W.orderBy("i").rowsBetween(W.currentRow, W.unboundedFollowing), W.partitionBy()  # the grid only
    full = places.join(counts, "i", "left").withColumn("tp", F.coalesce(F.sum("p").over(up), F.lit(0))).withColumn("fp", F.coalesce(F.sum("n").over(up), F.lit(0)))
    full = full.withColumn("fn", F.coalesce(F.sum("p").over(whole), F.lit(0)) - F.col("tp")).where("i > 0")
    return full.select("threshold", "tp", "fp", "fn", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def choose_threshold(scores: DataFrame, grid: list[float] | None = None, fold: str | None = "fold", fitted: object = None) -> DataFrame:
    """The threshold of the best F1 over pooled out-of-fold scores (score, is_positive, fold), one row.

    fold: the column that shows a score to be out of fold; a null there, or the fold that is being ``fitted``, is an error (None: no guard). No scores are one as well.
    """
    inside = F.count_if(F.col(fold).isNull() | ((F.col(fold) == F.lit(fitted)) if fitted is not None else F.lit(False))) if fold else F.lit(0)
    n, wrong = scores.agg(F.count("*"), inside).head()
    if not n:
        raise ValueError("no scores")
    if wrong:
        raise LeakageError(f"{wrong} scores aren't shown to be out of fold")
    return best_threshold(grid_curve(scores, sorted(grid) if grid else score_grid(scores)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of the best F1, the lowest of equal ones."""
    return curve.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), "b.f1")


def gold_filter(preds: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with gold_status: frame_not_annotated, label_not_exhaustive or kept. frames: keys and exhaustive_for; a frame is annotated if that isn't empty."""
    marked = preds.join(frames.select(*keys, "exhaustive_for"), keys, "left")
    status = F.when(F.coalesce(F.size("exhaustive_for"), F.lit(0)) <= 0, "frame_not_annotated").when(~F.array_contains("exhaustive_for", F.col("label")), "label_not_exhaustive").otherwise("kept")
    return marked.withColumn("gold_status", status).drop("exhaustive_for")


def annotation_budget(frames: Column, boxes_per_frame: float = 3, seconds: float = 26.5, speed_up: float = 1.5) -> Column:
    """struct(boxes, hours, verify_hours), hours to one place."""
    hours = frames * boxes_per_frame * seconds / 3600
    return F.struct((frames * boxes_per_frame).alias("boxes"), F.bround(hours, 1).alias("hours"), F.bround(hours / speed_up, 1).alias("verify_hours"))


def retention(before: DataFrame, after: DataFrame, key: str = "class") -> DataFrame:
    """Per class of either side: values before and after, delta, and relative change (null for 0)."""
    both = before.select(key, F.col("value").alias("before")).join(after.select(key, F.col("value").alias("after")), key, "full")
    delta = F.col("after") - F.col("before")
    return both.select(key, "before", "after", delta.alias("delta"), F.when(F.col("before") != 0, delta / F.col("before")).alias("relative"))


class RetentionError(ValueError):
    pass


def held_out_classes(vocabulary: DataFrame, n: int = 6, prefer_public: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, place): n classes to withhold from training, by name; those with public boxes first, none of ``keep``. Taking all is an error."""
    names = vocabulary.where(~F.col("name").isin(*keep)) if keep else vocabulary
    order = [~F.col("has_public_boxes"), F.col("name")] if prefer_public else [F.col("name")]
    whole, left = vocabulary.count(), names.count()
    if n >= whole or n > left:
        raise RetentionError(f"can't hold out {n} of {left} classes ({whole} in all)")
    return names.withColumn("place", F.row_number().over(W.orderBy(*order))).where(F.col("place") <= n).select("name", "place")


def retention_summary(report: DataFrame, held_out: DataFrame | None = None) -> DataFrame:
    """One row over classes (of ``held_out``, if given) that both sides have: medians (the headline) and means before and after, their relative changes, the classes that a side lacks, and a warning.

    masked: the mean hides the median's fall; fell: the median fell by over a quarter.
    """
    if held_out is not None:
        report = held_out.select(F.col("name").alias("class")).join(report, "class", "left")
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    of = lambda f, c: f(F.when(both, F.col(c)))
    out = report.agg(
        F.count_if(both).alias("n_held_out"), of(F.median, "before").alias("median_before"), of(F.median, "after").alias("median_after"),
        of(F.avg, "before").alias("mean_before"), of(F.avg, "after").alias("mean_after"), F.count_if(F.col("before").isNull()).alias("missing_before"), F.count_if(F.col("after").isNull()).alias("missing_after"),
    )
    change = lambda k: F.when(F.col(f"{k}_before") != 0, (F.col(f"{k}_after") - F.col(f"{k}_before")) / F.col(f"{k}_before"))
    out = out.withColumn("median_relative", change("median")).withColumn("mean_relative", change("mean"))
    warning = F.when((F.col("median_relative") < -0.2) & (F.col("mean_relative") > -0.1), "masked").when(F.col("median_relative") < -0.25, "fell")
    return out.withColumn("warning", warning)


def dominating(sweep: DataFrame) -> DataFrame:
    """Rows of a sweep that beat both ends (alpha 0 and 1) in domain and in retention."""
    ends = sweep.where("alpha in (0, 1)").agg(F.max("in_domain").alias("_i"), F.max("retention").alias("_r"), F.count_distinct("alpha").alias("_n"))
    checked = F.when(F.col("_n") == 2, True).otherwise(F.raise_error("a sweep needs both ends"))
    return sweep.crossJoin(ends).where(checked & (F.col("in_domain") > F.col("_i")) & (F.col("retention") > F.col("_r"))).drop("_i", "_r", "_n")


def operating_point(sweep: DataFrame, share: float = 0.9) -> DataFrame:
    """Of a sweep (alpha, in_domain, retention), the best in_domain whose retention holds ``share`` of that at alpha 0, with the least alpha of equal ones; alpha 0 if none does."""
    frozen = sweep.agg(F.max(F.when(F.col("alpha") == 0, F.col("retention"))).alias("_frozen"))
    held = sweep.crossJoin(frozen)  # one row
    ok = F.when(F.col("retention") >= F.col("_frozen") * share, F.struct("in_domain", (-F.col("alpha")).alias("a"), "retention"))
    base = F.max(F.when(F.col("alpha") == 0, F.struct("in_domain", (-F.col("alpha")).alias("a"), "retention")))
    best = held.agg(F.coalesce(F.max(ok), base).alias("b"), F.max(ok).isNull().alias("fallback"))
    return best.select((-F.col("b.a")).alias("alpha"), "b.in_domain", "b.retention", "fallback")


def lora_rank(n_labels: Column) -> Column:
    return F.when(n_labels < 50, 4).when(n_labels <= 300, 8).when(n_labels <= 1000, 16).when(n_labels <= 5000, 32).otherwise(64)


def schedule(n: Column, batch: Column, accumulation: Column, epochs: Column, warmup: float) -> Column:
    """struct(effective_batch, steps_per_epoch, total_steps, warmup_steps)."""
    size = batch * accumulation
    per = F.greatest(F.lit(1), F.floor(n / size)).cast("int")
    return F.struct(size.alias("effective_batch"), per.alias("steps_per_epoch"), (per * epochs).alias("total_steps"), F.greatest(F.lit(1), F.rint(per * epochs * warmup).cast("int")).alias("warmup_steps"))


class ScheduleError(ValueError):
    pass


#: Modules that adapters of low and of higher rank train.
ATTENTION = ("q_proj", "k_proj", "v_proj", "o_proj")
FEED_FORWARD = ("gate_proj", "up_proj", "down_proj")


def plan_schedule(n_train: int, rank: int = 8, alpha: int | None = None, batch: int = 1, accumulation: int = 16, epochs: int = 2, warmup: float = 0.03, devices: int = 1, freeze_vision: bool = True, fused_loss: bool = True) -> dict:
    """A whole schedule, with warnings about what makes it meaningless. More than one device is an error: it would change the batch."""
    if devices != 1 or min(batch, accumulation, rank) < 1 or not 0 <= warmup < 1:
        raise ScheduleError("one device, positive sizes and a warm-up share below 1 are needed")
    size = batch * accumulation
    per = max(1, n_train // size)
    total, scaled = per * epochs, 2 * rank if alpha is None else alpha
    advised = next(r for most, r in ((49, 4), (300, 8), (1000, 16), (5000, 32), (float("inf"), 64)) if n_train <= most)
    warnings = [
        text
        for wrong, text in (
            (per < 10, f"only {per} steps per epoch: warm-up and decay mean little"),
            (epochs > 2 and n_train <= 1000, f"{epochs} epochs over {n_train} clips overfit"),
            (rank > advised, f"rank {rank} is above {advised}, which {n_train} clips support"),
            (scaled != 2 * rank, f"alpha {scaled} isn't twice the rank"),
            (not freeze_vision, "the vision tower is trained"),
            (not fused_loss, "the loss isn't fused"),
        )
        if wrong
    ]
    return {
        "effective_batch": size, "steps_per_epoch": per, "total_steps": total, "warmup_steps": max(1, round(total * warmup)) if total > 0 else 0,
        "rank": rank, "alpha": scaled, "recommended_rank": advised, "recommended_modules": ATTENTION if n_train <= 300 else ATTENTION + FEED_FORWARD, "warnings": warnings,
    }


def weight_average(base: DataFrame, tuned: DataFrame, alpha: float, key: str = "name") -> DataFrame:
    """Per parameter (1 - alpha) * base + alpha * tuned, element by element; parameters of the base alone stay."""
    both = base.join(tuned.withColumnRenamed("values", "_tuned"), key, "left")
    return both.select(key, F.coalesce(F.zip_with("values", "_tuned", lambda x, y: x * (1 - alpha) + y * alpha), "values").alias("values"))
