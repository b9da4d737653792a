"""Weights, design effects, resampling and test choice over groups of records."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kish(weights: DataFrame, weight: str, keys: list[str] | None = None) -> DataFrame:
    """Kish's design effect and effective size; zero weights are none (no weight: 1 and 0)."""
    s, q, k = F.sum(weight), F.sum(F.col(weight) * F.col(weight)), F.count("*")
    return weights.where(F.col(weight) != 0).groupBy(*(keys or [])).agg(F.coalesce(k * q / (s * s), F.lit(1.0)).alias("design_effect"), F.coalesce(s * s / q, F.lit(0.0)).alias("effective_size"))


def icc(values: DataFrame, cluster: str, value: str) -> DataFrame:
    """One-way intraclass correlation, within 0 and 1; null for under two clusters or none of two values."""
    per = values.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.sum(F.col(value) * F.col(value)) - F.sum(value) * F.sum(value) / F.count("*")).alias("w"))
    all_ = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("w").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("between"))
    msb, msw, m = F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")), F.col("n") / F.col("k")
    den = msb + (m - 1) * msw
    found = F.when((F.col("k") < 2) | (F.col("n") == F.col("k")), F.lit(None)).when(den <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (msb - msw) / den)))
    return all_.select(F.col("k").alias("n_clusters"), m.alias("mean_size"), found.cast("double").alias("icc"))


def design_effect(icc_: Column, mean_size: Column) -> Column:
    return 1 + (mean_size - 1) * icc_


def choose_test(n_groups: Column, least: int = 15) -> Column:
    return F.when(n_groups < least, "permutation").otherwise("bootstrap")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(lo, hi) of a share; (0, 1) without trials."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0).alias("lo"), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0).alias("hi"))


def resample_weights(units: DataFrame, unit: str, n_resamples: int, seed: int) -> DataFrame:
    """(replicate, unit, weight): how often each replicate draws each distinct unit of a table. One stream of draws, replicate after replicate, over the sorted units.

    Units are groups such as recording sessions: they and their draws are listed on the driver.
    """
    spark, kind = units.sparkSession, units.schema[unit].dataType.simpleString()
    names = sorted(r[0] for r in units.select(unit).where(F.col(unit).isNotNull()).distinct().collect())
    rng, rows = random.Random(seed), []
    for r in range(n_resamples):
        drawn = [0] * len(names)
        for _ in names:
            drawn[rng.randrange(len(names))] += 1
        rows.append((r, drawn))
    places = spark.createDataFrame(list(enumerate(names)), f"_at int, `{unit}` {kind}")
    drawn = spark.createDataFrame(rows, "replicate int, _drawn array<int>").select("replicate", F.posexplode("_drawn").alias("_at", "weight")).where("weight > 0")
    return drawn.join(places, "_at").select("replicate", unit, F.col("weight").cast("long").alias("weight"))


def swap_masks(n_units: int, most_exact: int = 14, n_random: int = 10_000, seed: int = 0) -> list[str]:
    """The swaps of a paired permutation test, a character 0 or 1 for each unit: all for few units, else random ones."""
    if n_units <= most_exact:
        return [f"{i:0{n_units}b}" if n_units else "" for i in range(1 << n_units)]
    rng = random.Random(seed)
    return ["".join("1" if rng.random() < 0.5 else "0" for _ in range(n_units)) for _ in range(n_random)]


def swaps(groups: DataFrame, group: str, most_exact: int = 14, n_random: int = 10_000, seed: int = 0) -> tuple[DataFrame, int, bool]:
    """(i, group, swapped) of each permutation and group, how many groups there are, and whether all permutations are listed."""
    spark, kind = groups.sparkSession, groups.schema[group].dataType.simpleString()
    names = sorted(r[0] for r in groups.select(group).where(F.col(group).isNotNull()).distinct().collect())  # sessions
    masks = spark.createDataFrame(list(enumerate(swap_masks(len(names), most_exact, n_random, seed))), "i int, _mask string")
    places = spark.createDataFrame([(k + 1, x) for k, x in enumerate(names)], f"_at int, `{group}` {kind}")
    each = masks.select("i", F.posexplode(F.split("_mask", "")).alias("_p", "_swap")).select("i", (F.col("_p") + 1).alias("_at"), (F.col("_swap") == "1").alias("swapped"))
    return each.join(places, "_at").select("i", group, "swapped"), len(names), len(names) <= most_exact


def permutation_p(differences: DataFrame, observed: str = "observed", d: str = "d") -> DataFrame:
    """(p_value, n_perm) of differences of swapped groups beside the observed one; an undefined one isn't counted. Values equal to twelve places are ties."""
    out = differences.agg(F.count_if(F.round(F.abs(d), 12) >= F.round(F.abs(observed), 12)).alias("_k"), F.count(d).alias("n_perm"), F.max(observed).alias("_o"))
    p = (1 + F.col("_k")) / (1 + F.col("n_perm"))
    return out.select(F.when(F.col("_o").isNull(), 1.0).otherwise(p).alias("p_value"), F.when(F.col("_o").isNull(), 0).otherwise(F.col("n_perm")).alias("n_perm"))


def paired_permutation(per: DataFrame, group: str, most_exact: int = 14) -> DataFrame:
    """One row (diff, p_value, n_perm): difference of the shares ta / na and tb / nb, and the p value of swapping groups between them.

    per: a row for each group, with its ta, na, tb and nb.
    """
    table, _, _ = swaps(per, group, most_exact)
    both = per.join(table, group)
    pick = lambda x, y: F.sum(F.when(F.col("swapped"), F.col(y)).otherwise(F.col(x)))
    d = both.groupBy("i").agg((F.try_divide(pick("ta", "tb"), pick("na", "nb")) - F.try_divide(pick("tb", "ta"), pick("nb", "na"))).alias("d"))
    seen = per.agg((F.try_divide(F.sum("ta"), F.sum("na")) - F.try_divide(F.sum("tb"), F.sum("nb"))).alias("observed"))
    both = seen.join(d, F.lit(True), "left")  # seen is one row
    return seen.join(permutation_p(both), F.lit(True)).select(F.col("observed").alias("diff"), "p_value", "n_perm")


def spread_vs_depth(n_clips: Column, frames_per_clip: Column, icc_: Column) -> Column:
    """struct(total_frames, deff, n_eff): what frames of many clips are worth, given the correlation within a clip (null, or a design effect of 0 or less: all of them)."""
    total, deff = n_clips * frames_per_clip, design_effect(icc_, frames_per_clip)
    known = deff.isNotNull() & (deff > 0)
    return F.struct(total.alias("total_frames"), F.when(known, deff).otherwise(1.0).alias("deff"), F.when(known, total / deff).otherwise(total.cast("double")).alias("n_eff"))


def percentile_interval(values: DataFrame, value: str, n_resamples: int, alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """lo and hi as order statistics of the replicates that have a value, and how many don't."""
    sorted_ = F.sort_array(F.collect_list(value))  # replicates, not records
    m = F.size("_v")
    lo = F.greatest(F.lit(1), F.floor((m + 1) * alpha / 2).cast("int"))
    hi = F.least(m, F.ceil((m + 1) * (1 - alpha / 2)).cast("int"))
    out = values.groupBy(*(keys or [])).agg(sorted_.alias("_v"))
    return out.select(*(keys or []), F.when(m > 0, F.get("_v", lo - 1)).alias("lo"), F.when(m > 0, F.get("_v", hi - 1)).alias("hi"), (n_resamples - m).alias("n_degenerate"))
