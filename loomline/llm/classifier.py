"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document becomes some thirty statistics of its text (lengths, shares of kinds
of characters, repetition, word and line shapes). Their standardised vector is
mapped by cosines at random frequencies to a space whose inner products
approximate a Gaussian kernel. Ridge scores there follow from the normal
equations, whose sums are taken within partitions and then added up. A part of
the labelled rows, kept out of the regression, calibrates scores to shares of
label 1 by isotonic regression over at most ``BINS`` bins.

All labelled rows are used. The driver holds the normal equations and the
calibration's bins: their sizes depend on parameters alone. Labels, lang, source
and doc_id are no inputs of a score; an id only decides which part a labelled
row belongs to, and rows in the held-out part (crc32 of the id as text, modulo
3, is 1) are never learned from.

Defined results: a null text counts as empty and gets a score as well; a label
that is null is none; a document's repeated labels count one each. With no
labels at all each score is 0.5; with one kind of label, that label's smoothed share.
Long texts count whole; repeated rows score alike, and an empty table stays empty.
Other columns of any name but the score's pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytewords import word_hashes
from loomline.llm.common import Workspace, blocks, text_bytes, tidy

FREQUENCIES = 384
RIDGE = 1e-3
BINS = 2000
SEED = 20_240

_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)


def _bytes(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


KINDS = (
    _UPPER,
    _LOWER,
    _bytes("0123456789"),
    _bytes(" "),
    _bytes("\n"),
    _bytes(".?"),
    _bytes("!"),
    _bytes(",;:"),
    _bytes("#*$%&"),
    _bytes("|<>[]{}\\^~_=+"),
    _bytes("\"'()/-@"),
    np.arange(256) >= 128,
)


def _spread(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a block; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    out = [np.log1p(size)]
    out += [_spread(kind[data], offsets) / some for kind in KINDS]
    same = np.zeros(len(data))
    same[1:] = data[1:] == data[:-1]
    same[offsets[:-1][size > 0]] = 0  # a text's first byte has none before it
    out.append(_spread(same, offsets) / some)

    words = word_hashes(data, offsets)
    count = np.diff(words.first).astype(float)
    many = np.maximum(count, 1)
    mean = _spread(words.lengths, words.first) / many
    out += [np.log1p(count), mean, np.sqrt(np.maximum(_spread(words.lengths.astype(float) ** 2, words.first) / many - mean**2, 0))]
    if len(words.starts):
        last = data[words.starts + words.lengths - 1]
        head = data[words.starts]
        low = np.concatenate([[0], np.cumsum(_LOWER[data])])
        no_low = low[words.starts + words.lengths] == low[words.starts]
        up = np.concatenate([[0], np.cumsum(_UPPER[data])])
        shout = no_low & (up[words.starts + words.lengths] - up[words.starts] >= 2)
        again = np.zeros(len(head))
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
        order = np.lexsort((words.hashes, words.text))
        h, t = words.hashes[order], words.text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        runs = np.diff(np.append(np.flatnonzero(new), len(h))).astype(float)
        most = np.zeros(n)
        np.maximum.at(most, t[new], runs)
        with np.errstate(over="ignore"):
            pairs = words.hashes[1:] + words.hashes[:-1] * np.uint64(3)
        inside = words.text[1:] == words.text[:-1]
        order = np.lexsort((pairs[inside], words.text[1:][inside]))
        p, q = pairs[inside][order], words.text[1:][inside][order]
        twice = np.zeros(len(p))
        twice[1:] = (p[1:] == p[:-1]) & (q[1:] == q[:-1])
        per = lambda values: _spread(values, words.first) / many
        out += [
            per(_UPPER[head]),
            per(shout),
            per(_bytes(".?!")[last]),
            per(_bytes("!")[last]),
            per(_bytes(",;:")[last]),
            per(_bytes("#*$%&")[last]),
            per(words.lengths == 1),
            per(words.lengths > 24),
            per(again),
            np.bincount(t[new], minlength=n) / many,
            most / many,
            np.bincount(q, twice, minlength=n) / many,
        ]
    else:
        out += [np.zeros(n)] * 12
    lines = _spread(data == 10, offsets) + 1
    out += [np.log1p(lines), np.log1p(size / lines)]
    return np.column_stack(out)


N_STATISTICS = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def _all_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    found = [statistics(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]) for a, z in blocks(offsets, 1 << 19)]
    return np.concatenate(found) if found else np.zeros((0, N_STATISTICS))


def _array(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.center) / self.scale, -8, 8)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([waves, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw score keeps order where the calibration is flat."""
        raw = self.raw(stats)
        return np.round(0.999 * np.interp(raw, self.xs, self.ys) + 0.001 * np.clip(raw, 0, 1), 9)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the best rising fit to bins (mean place, sum of labels, rows), by pooling neighbours that fall."""
    blocks_: list[list[float]] = []
    for place, y, k in zip(x, total, n):
        blocks_.append([place * k, y, k])
        while len(blocks_) > 1 and blocks_[-2][1] * blocks_[-1][2] >= blocks_[-1][1] * blocks_[-2][2]:
            b = blocks_.pop()
            blocks_[-1] = [u + v for u, v in zip(blocks_[-1], b)]
    return np.array([s / k for s, _, k in blocks_]), np.array([y / k for _, y, k in blocks_])


def _remainder(doc_id):
    return F.crc32(doc_id.cast("string"))


def held_out(doc_id):
    """Whether no label of this document may be learned (a null id: held out)."""
    return F.coalesce(_remainder(doc_id) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", frequencies: int = FREQUENCIES, ridge: float = RIDGE) -> Model:
    """Learn from all labelled rows that aren't held out; one in five of them calibrates."""
    spark = docs.sparkSession
    space = Workspace(spark, "classifier")

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _array(_all_statistics(batch.column(1)))], names=["_id", "_x"])

    ids = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).where(~held_out(F.col("_id")))
    stats = ids.mapInArrow(tidy(measure), f"_id {docs.schema[doc_id].dataType.simpleString()}, _x array<double>")
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    rows = space.table("rows", stats.join(known, "_id").select("_x", "_y", (F.floor(_remainder(F.col("_id")) / 3) % 5 == 0).alias("_calibrates")))

    d = N_STATISTICS
    fitting = rows.where(~F.col("_calibrates"))
    moments = fitting.agg(F.count("*"), F.avg("_y"), *(f(F.col("_x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).head()
    rng = np.random.default_rng(SEED)
    omega, phases = rng.standard_normal((d, frequencies)) / np.sqrt(2 * d), rng.uniform(0, 2 * np.pi, frequencies)
    n, share = moments[0], moments[1]
    flat = lambda value: Model(np.zeros(d), np.ones(d), omega, phases, np.zeros(frequencies + 1), np.array([0.0]), np.array([value]))
    if not n:
        return flat(0.5)
    center, scale = np.array(moments[2::2], float), np.array(moments[3::2], float)
    model = Model(center, np.where(scale > 1e-9, scale, 1.0), omega, phases, np.zeros(frequencies + 1), np.array([0.0]), np.array([0.0]))
    if share in (0.0, 1.0):
        return flat((share * n + 0.5) / (n + 1))

    width = frequencies + 2

    def equations(batches):
        total = np.zeros((width, width))
        for batch in batches:
            z = np.column_stack([model.features(_matrix(batch.column(0), d)), batch.column(1).to_numpy()])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), _array(total)], names=["i", "v"])

    def add(table):
        return pa.table({"i": table["i"][:1], "v": _array(_matrix(table["v"].combine_chunks(), width).sum(axis=0, keepdims=True))})

    sums = fitting.select("_x", "_y").mapInArrow(tidy(equations), "i int, v array<double>").groupBy("i").applyInArrow(add, "i int, v array<double>")
    whole = np.array([v for _, v in sorted((r["i"], r["v"]) for r in sums.collect())])  # width x width numbers
    a, b = whole[:-1, :-1], whole[:-1, -1]
    model.weights = np.linalg.solve(a + ridge * n * np.diag([*np.ones(frequencies) * 2 / frequencies, 1e-9]), b)

    def bins(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0), d))
            at = np.floor(np.clip(raw, -1, 2) / 3 * BINS).astype(int)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw), batch.column(1)], names=["bin", "raw", "y"])

    calibrating = rows.where("_calibrates").select("_x", "_y").mapInArrow(tidy(bins), "bin int, raw double, y double")
    found = sorted(tuple(r) for r in calibrating.groupBy("bin").agg(F.avg("raw"), F.sum("y"), F.count("*")).collect())
    if found:
        _, x, y, k = map(np.array, zip(*found))
        model.xs, model.ys = isotonic(x, y, k)
    else:
        model.xs, model.ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    space.drop("rows")
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with each text's score in column ``out`` (an existing column of that name is replaced); no shuffle."""
    docs = docs.drop(out)
    names = [*docs.columns, out]
    at = docs.columns.index(text)
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(_all_statistics(batch.column(at))))], names=names)

    return docs.mapInArrow(tidy(run), schema)
