"""Readers and writers of the annotation formats: JSON manifests and gold sets, COCO, TAO, data-set YAML, stage outputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLIP = "clip_id string, session_id string, labels array<string>, duration_s double, container_frame_count int, fps double, room_id string"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
GOLD_FRAME = f"clip_id string, session_id string, frame_index int, frame_id string, width int, height int, exhaustive_for array<string>, boxes array<struct<label:string,box:{BOX},ignore:boolean,track_id:int>>"
COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:int,name:string>>, annotations array<struct<id:long,image_id:long,category_id:int,bbox:array<double>,iscrowd:int>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a JSON object {"clips": [...]}; other keys are ignored, missing ids or labels are an error."""
    rows = spark.read.schema(f"clips array<struct<{_fields(CLIP)}>>").option("mode", "FAILFAST").json(path, multiLine=True).select(F.inline("clips"))
    needed = F.col("clip_id").isNotNull() & F.col("session_id").isNotNull() & F.col("labels").isNotNull()
    return rows.withColumn("clip_id", F.when(needed, F.col("clip_id")).otherwise(F.raise_error("a clip lacks clip_id, session_id or labels")))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"frames array<struct<{_fields(GOLD_FRAME)}>>").option("mode", "FAILFAST").json(path, multiLine=True).select(F.inline("frames"))


def write_gold(frames: DataFrame, path: str, vocabulary: list[str] = ()) -> None:
    """One JSON object with its vocabulary and a note. A gold set is annotated by hand: it fits in one task."""
    one = frames.select(F.struct(*sorted(frames.columns)).alias("f")).agg(F.sort_array(F.collect_list("f")).alias("frames"))
    names = F.array(*map(F.lit, sorted(set(vocabulary)))) if vocabulary else F.array().cast("array<string>")
    one.select(F.to_json(F.struct(F.lit(GOLD_NOTE).alias("_note"), "frames", names.alias("vocabulary")))).coalesce(1).write.text(path)


def read_vocabulary(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """Classes of a JSON object {"classes": [...]}; the default ones if it lists none."""
    kind = "array<struct<name:string,paraphrases:array<string>,confusable_with:array<string>,forbidden_substrings:array<string>,has_public_boxes:boolean,note:string>>"
    rows = spark.read.schema(f"classes {kind}").option("mode", "FAILFAST").json(path, multiLine=True).select(F.posexplode("classes").alias("ordinal", "c")).select("c.*", "ordinal")
    return rows if rows.head() is not None else default


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    kept = [c for c in vocabulary.columns if c != "ordinal"]
    one = vocabulary.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*kept).alias("c")))), lambda x: x["c"]).alias("classes"))
    one.select(F.to_json(F.struct("classes"))).coalesce(1).write.text(path)


def _fields(ddl: str) -> str:
    return ", ".join(":".join(x.strip().split(" ", 1)) for x in _outer(ddl))


def _outer(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


#: What a category is part of, and a note and an evaluator that documents name.
SUPERCATEGORY = "lab_equipment"
GOLD_NOTE = "exhaustive_for records which classes were CHECKED on a frame. A class outside it is unknown, not absent."
EVALUATOR = "trackeval==1.3.0"


def model_index(category_id: Column) -> Column:
    """A category's id as a model's label, from 0."""
    return category_id - 1


def category_id(index: Column) -> Column:
    return index + 1


def category_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    """(id, name, supercategory) in the given order, ids from 1."""
    return spark.createDataFrame([(i + 1, x, SUPERCATEGORY) for i, x in enumerate(labels)], "id int, name string, supercategory string")


def _document(parts: dict[str, DataFrame], info: dict) -> DataFrame:
    """One row, json: an object of the lists of rows under their names, and info. A document is one file for other tools: its rows pass through one task."""
    spark = next(iter(parts.values())).sparkSession
    doc = spark.createDataFrame([(json.dumps(info, sort_keys=True),)], "info string")
    for name, rows in parts.items():
        kept = [c for c in rows.columns if c != "_order"]
        ordered = F.array_sort(F.collect_list(F.struct(*(["_order"] if "_order" in rows.columns else []), F.struct(*kept).alias("row"))))
        doc = doc.join(rows.agg(F.to_json(F.transform(ordered, lambda x: x["row"])).alias(name)), F.lit(True), "left")
    shown = [F.concat(F.lit(f'"{name}": '), F.coalesce(name, F.lit("[]"))) for name in ["info", *parts]]
    return doc.select(F.concat(F.lit("{"), F.concat_ws(", ", *shown), F.lit("}")).alias("json"))


def numbered_annotations(boxes: DataFrame, category: DataFrame, order: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``coco_annotations`` with id from 1 in an order, and further columns of the boxes kept."""
    found = coco_annotations(boxes.withColumn("image_id", F.struct("image_id", *order, *keep)), category)
    place = F.row_number().over(W.orderBy(*(f"_at.{c}" for c in order)))  # a document's annotations are one list
    found = found.withColumnRenamed("image_id", "_at").withColumn("id", place)
    return found.select("id", "_at.image_id", *(F.col(f"_at.{c}").alias(c) for c in keep), "category_id", "bbox", "area", "iscrowd")


def coco_document(images: DataFrame, boxes: DataFrame, labels: list[str], order: list[str], description: str = "gold set") -> DataFrame:
    """One row, json: a COCO document of images (id, file_name, width, height) and ground truth, numbered from 1 in ``order``; no scores, unknown labels are an error."""
    category = category_table(images.sparkSession, labels)
    marked = numbered_annotations(boxes, category, order)
    parts = {"images": images.select("id", "file_name", "width", "height").withColumn("_order", F.col("id")), "categories": category.withColumn("_order", F.col("id")), "annotations": marked.withColumn("_order", F.col("id"))}
    return _document(parts, {"description": description})


def coco_results(boxes: DataFrame, labels: list[str]) -> DataFrame:
    """One row, json: the flat list of predictions (image_id, category_id, bbox, score), by image, then score."""
    rows = coco_predictions(boxes, category_table(boxes.sparkSession, labels))
    one = F.struct("image_id", "category_id", "bbox", "score")
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("image_id", (-F.col("score")).alias("s"), "category_id", one.alias("row")))), lambda x: x["row"])).alias("json"))


def tao_document(clips: DataFrame, images: DataFrame, boxes: DataFrame, tracks: DataFrame, labels: list[str], order: list[str]) -> DataFrame:
    """One row, json: a TAO document.

    clips: clip, session, duration_s, negatives, unknown. boxes: as for COCO, with track_id. tracks: track_id, label, n_frames,
    chunk_ids; those of other labels are left out, while other labels of boxes are an error.
    """
    category = category_table(clips.sparkSession, labels)
    known = tao_videos(clips, labels).withColumnRenamed("clip", "_clip")
    videos = clips.join(known, F.col("clip") == F.col("_clip")).select(
        F.col("clip").alias("id"), F.col("clip").alias("name"), F.struct(F.col("session").alias("session_id"), "duration_s").alias("metadata"), "neg_category_ids", "not_exhaustive_category_ids", F.col("clip").alias("_order")
    )
    rows = tracks.join(category.select(F.col("name").alias("label"), F.col("id").alias("category_id")), "label")
    rows = rows.select(F.col("track_id").alias("id"), "category_id", "n_frames", (F.size("chunk_ids") > 1).alias("spans_chunks"), "chunk_ids", F.struct("track_id", "category_id", "n_frames", "chunk_ids").alias("_order"))
    marked = numbered_annotations(boxes, category, order, ("track_id",))
    parts = {
        "videos": videos, "images": images.select("id", "file_name", "width", "height").withColumn("_order", F.col("id")), "categories": category.withColumn("_order", F.col("id")),
        "tracks": rows, "annotations": marked.withColumn("_order", F.col("id")),
    }
    return _document(parts, {"description": "TAO export", "evaluation_library": EVALUATOR, "max_detections_per_image": 0})


def write_document(document: DataFrame, path: str) -> None:
    """A one-row document as one text file below ``path``."""
    document.coalesce(1).write.text(path)


def index_coverage(images: DataFrame, annotations: DataFrame, category: DataFrame) -> DataFrame:
    """Per category of a COCO index its name, annotations and images; zeros included."""
    n = annotations.groupBy("category_id").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))
    return category.select(F.col("id").alias("category_id"), "name").join(n, "category_id", "left").select("category_id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("images", F.lit(0)).alias("images"))


def categories(labels: Column) -> Column:
    """Labels as structs of ids from 1 and names."""
    return F.transform(labels, lambda x, i: F.struct((i + 1).alias("id"), x.alias("name")))


def coco_annotations(boxes: DataFrame, category: DataFrame) -> DataFrame:
    """image_id, category_id, bbox (x, y, w, h), area, iscrowd of ground truth (image_id, label, x1 to y2, ignore); an unknown label is an error."""
    found = boxes.join(category.select(F.col("name").alias("label"), F.col("id").alias("_c")), "label", "left")
    known = F.when(F.col("_c").isNotNull(), F.col("_c")).otherwise(F.raise_error("a label has no category"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return found.select("image_id", known.alias("category_id"), F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.col("ignore").cast("int").alias("iscrowd"))


def coco_predictions(boxes: DataFrame, category: DataFrame) -> DataFrame:
    found = coco_annotations(boxes.withColumn("ignore", F.lit(False)).withColumn("image_id", F.struct("image_id", "score")), category)
    return found.select("image_id.image_id", "category_id", "bbox", "image_id.score")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """A row of JSON each, in as many files as there are partitions."""
    rows.select(F.to_json(F.struct(*rows.columns))).write.text(path)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, categories and annotations of a COCO document."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    return tuple(doc.select(F.inline(c)) for c in ("images", "categories", "annotations"))


def coco_targets(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per image its boxes as shares (cx, cy, w, h) with labels from 0: crowds and boxes without area are left out, images without boxes stay."""
    sized = F.when((F.col("width") > 0) & (F.col("height") > 0), True).otherwise(F.raise_error("an image has no size"))
    real = annotations.where((F.coalesce("iscrowd", F.lit(0)) == 0) & (F.get("bbox", 2) > 0) & (F.get("bbox", 3) > 0))
    both = images.where(sized).join(real.select(F.col("image_id").alias("id"), F.col("id").alias("_a"), "category_id", "bbox"), "id", "left")
    x, y, w, h = (F.get("bbox", i) for i in range(4))
    target = F.struct(F.col("_a").alias("annotation"), (F.col("category_id") - 1).alias("label"), ((x + w / 2) / F.col("width")).alias("cx"), ((y + h / 2) / F.col("height")).alias("cy"), (w / F.col("width")).alias("w"), (h / F.col("height")).alias("h"))
    return both.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("_a").isNotNull(), target))).alias("targets"))


def tao_videos(clips: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Clips (clip, negatives, unknown) with the ids of their negative and their not exhaustively labelled categories, sorted; labels outside the vocabulary are left out."""
    ids = {x: i + 1 for i, x in enumerate(vocabulary)}
    to_id = F.create_map(*(F.lit(v) for kv in ids.items() for v in kv))
    listed = lambda c: F.array_sort(F.filter(F.transform(c, lambda x: F.try_element_at(to_id, x)), lambda i: i.isNotNull()))
    return clips.select("clip", listed("negatives").alias("neg_category_ids"), listed("unknown").alias("not_exhaustive_category_ids"))


def dataset_yaml(names: list[str], train: str = "train", val: str = "val") -> str:
    """Paths and names by index from 0; a name that is padded or holds a colon is an error, as is having none."""
    if not names or any(n != n.strip() or ":" in n for n in names):
        raise ValueError("names must be given, without colons or outer blanks")
    return "".join([f"train: {train}\nval: {val}\nnames:\n", *(f"  {i}: {n}\n" for i, n in enumerate(names))])


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


class Stages:
    """Named stage outputs as Parquet below root/config_hash: done ones are read instead of made again; another configuration has other ones."""

    def __init__(self, spark: SparkSession, root: str, names: list[str], config: dict):
        self.spark, self.names, self.at = spark, names, f"{root}/{config_hash(config)}"

    def _path(self, name: str) -> str:
        if name not in self.names:
            raise KeyError(name)
        return f"{self.at}/{name}"

    def is_done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name) + "/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.is_done(name):
            make().write.mode("overwrite").parquet(self._path(name))
        return self.spark.read.parquet(self._path(name))

    def status(self) -> dict[str, bool]:
        return {n: self.is_done(n) for n in self.names}

    def reset(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
