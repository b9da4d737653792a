"""Working tables in the shared folder, Arrow text columns, and word constants."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of other characters than these six.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a pattern of Java and of DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The setting by which Spark removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (on one machine) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is executed meanwhile leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Workspace:
    """Tables of one run of an operator, written once to the shared folder and read from there.

    A written table cuts the lineage: a lost executor costs only the running stage.
    Its shuffle files go once it is written, rather than when the driver next collects garbage.
    ``drop`` removes tables that no result reads any more; who writes a result that
    reads some can drop those of all workspaces ``opened`` for it.
    """

    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/loomline/{name}-{uuid.uuid4().hex}"
        self.written: set[str] = set()
        Workspace.opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        self.written.add(name)
        with shuffles_dropped(self.spark):
            df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.written.discard(name)

    def drop_all_but(self, *names: str) -> None:
        """Remove all tables but those that the result still reads."""
        self.drop(*self.written.difference(names))


def give_back() -> None:
    """Gives memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of Arrow batches whose worker, which Spark keeps for later tasks, gives freed memory back at its end."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses itself, and the new name of each of its columns."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unmasked(names: dict[str, str], but: list[str] = ()) -> list[Column]:
    """The columns of ``masked`` under their own names, without those that are replaced."""
    return [F.col(own).alias(name) for name, own in names.items() if name not in but]


def parts_for(docs: DataFrame, text: str, bytes_each: int = 16 << 20) -> int:
    """Partitions for work on texts: at least spark.sql.shuffle.partitions, and one for so many bytes.

    The bytes are summed by a scan: the optimizer's estimate is off by orders of magnitude behind a join or for rows that aren't from files.
    """
    total = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(total // bytes_each, 200_000))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = 2 << 20):
    """Ranges (first, last) of rows of at most ``most`` bytes together; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def size_of(text: Column) -> Column:
    """Words of a text (null: 0)."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, GAP))).otherwise(0).cast("long")
