"""Public data sets brought to the vocabulary: normalised boxes to pixels, classes by resolution, splits by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.labels import resolve
from loomline.operators.splits import group_kfold


def session_key(file_name: Column) -> Column:
    """The recording that a frame's file is from: without extension, export hash and frame number."""
    bare = F.regexp_replace(F.regexp_replace(file_name, r"\.[A-Za-z0-9]+$", ""), r"\.rf\.[0-9A-Za-z]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"_(jpe?g|png)$", ""), r"_[0-9]+$", "")


def normalise_boxes(records: DataFrame, names: list[str], vocabulary: DataFrame) -> DataFrame:
    """A row for each box of records (file_name, width, height, boxes of cls, cx, cy, w, h as shares): pixels, class (null: unmapped), session_key.

    A record without a size is an error.
    """
    sized = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width")).otherwise(F.raise_error("a record has no size"))
    rows = records.withColumn("width", sized).select("file_name", "width", "height", F.inline("boxes"))
    raw = F.get(F.array(*map(F.lit, names)), F.col("cls"))
    x = lambda s: (F.col("cx") + s * F.col("w") / 2) * F.col("width")
    y = lambda s: (F.col("cy") + s * F.col("h") / 2) * F.col("height")
    placed = rows.select("file_name", session_key(F.col("file_name")).alias("session_key"), raw.alias("raw_label"), x(-1).alias("x1"), y(-1).alias("y1"), x(1).alias("x2"), y(1).alias("y2"))
    return resolve(placed, "raw_label", vocabulary)


def mapping_report(rows: DataFrame) -> DataFrame:
    n = F.count("class")
    return rows.agg(n.alias("mapped"), (F.count("*") - n).alias("unmapped"))


def resplit_by_session(rows: DataFrame, n_splits: int, seed: int = 0) -> DataFrame:
    """Folds of whole sessions, two sessions at least."""
    return group_kfold(rows, "session_key", n_splits, seed, least_groups=2)


def coverage(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Each class of the vocabulary with whether any box is of it."""
    found = rows.select(F.col("class").alias("name")).where("name is not null").distinct().withColumn("covered", F.lit(True))
    return vocabulary.select("name").join(found, "name", "left").select("name", F.coalesce("covered", F.lit(False)).alias("covered"))
