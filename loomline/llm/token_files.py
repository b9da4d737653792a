"""Token ids as binary files: the Arrow stream format, with batches of fixed-size lists.

A corpus is written in ascending order of its ids, each part of the order as

* ``part-N.arrow``: the ids of its documents, one after another (each with the
  end id), cut to sequences of equal length. Columns ``input_ids``
  (fixed-size list of uint16, or of uint32 for larger vocabularies) and ``mask``
  (fixed-size list of bool: false in the padding of a part's last sequence). Every batch but the last holds
  ``BATCH`` sequences, so that batch k starts a constant number of bytes after
  batch k-1, and a mapped file gives sequence i without reading or copying others.
* ``part-N.index.arrow``: doc_id, offset (of its first id in the part), n_tokens.

A manifest (a Parquet table beside them) names the parts and the ids before each.

Texts are range-partitioned by id and encoded once, in the partition that writes
them. A task writes under a name of its own and renames at its end, so that a
repeated or lost task leaves the same whole file. The driver sees one manifest
row for each part.
"""

from __future__ import annotations

import functools
import itertools
import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm.common import named, parts_for, shared_folder

SEQUENCE = 2048
BATCH = 64
END_ID = 2
#: Pieces whose ids a worker remembers: the first ones met, so that frequent ones are among them.
MEMORY = 1_000_000


class Encoder:
    """The tokenizers library over the pieces of texts between spaces, each distinct piece once.

    The library's splitting pattern always ends a match before a space that stands between
    two characters other than white space, so that pieces cut at such places have the same
    ids apart as together. Prose repeats most of its pieces. A text with other white space
    at a cut or at an end, or with the string of an added token, is given to the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        #: Strings that the library finds in a text before it splits it.
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.opens[i] = piece[0] == "Ġ"  # how the vocabulary writes a space
        #: Ids of a space and the piece; None for a piece that isn't a safe one.
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces in one go, a space before each: each starts where an id's piece starts with a space."""
        ids = np.asarray(self.library.encode("".join(" " + p for p in pieces), add_special_tokens=False).ids, "<u4")
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(pieces):
            self.known.update((p, self.whole(" " + p)) for p in pieces)
            return
        data, bounds = ids.tobytes(), np.append(starts, len(ids)) * 4
        self.known.update(zip(pieces, map(data.__getitem__, map(slice, bounds[:-1].tolist(), bounds[1:].tolist()))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [t.split(" ") if not any(a in t for a in self.added) else [] for t in texts]
        new = set(itertools.chain.from_iterable(split)).difference(self.known)
        safe = [p for p in new if p and not (p[0].isspace() or p[-1].isspace())]
        self.known.update(dict.fromkeys(new.difference(safe)))
        for at in range(0, len(safe), 4096):
            self.learn(safe[at : at + 4096])
        get, out = self.known.__getitem__, []
        for text, pieces in zip(texts, split):
            if not pieces:
                out.append(self.whole(text))
                continue
            try:
                if get(pieces[0]) is None:
                    raise TypeError
                out.append(self.whole(pieces[0]) + b"".join(map(get, pieces[1:])))
            except TypeError:  # a piece that isn't safe
                out.append(self.whole(text))
        if len(self.known) > MEMORY:
            for p in new:
                del self.known[p]
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


class _Sequences:
    """Writes one part: fills sequences, keeps the index."""

    def __init__(self, store: fs.FileSystem, path: str, length: int, wide: bool):
        self.store, self.path, self.length = store, path, length
        self.kind = np.uint32 if wide else np.uint16
        self.own = f"{path}.{uuid.uuid4().hex}"
        lists = pa.list_(pa.from_numpy_dtype(self.kind), length), pa.list_(pa.bool_(), length)
        self.schema = pa.schema([pa.field("input_ids", lists[0], False), pa.field("mask", lists[1], False)])
        self.file = store.open_output_stream(self.own)
        self.writer = pa.ipc.new_stream(self.file, self.schema)
        self.pending: list[bytes] = []
        self.held = self.total = 0
        self.index: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        self.index.append((doc_id, self.total, len(ids) // 4))
        self.total += len(ids) // 4
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.length * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.pending), "<u4")
        step = self.length * BATCH
        for at in range(0, len(data), step):
            part = data[at : at + step]
            if len(part) < step and not last:
                break
            used = np.ones(-(-len(part) // self.length) * self.length, bool)
            used[len(part) :] = False
            values = np.zeros(len(used), self.kind)
            values[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, used)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        rest = data[len(data) // step * step :]
        self.pending, self.held = ([], 0) if last else ([rest.tobytes()], 4 * len(rest))

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.file.close()
        ids, offsets, counts = zip(*self.index) if self.index else ((), (), ())
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with self.store.open_output_stream(f"{self.own}.index") as file, pa.ipc.new_stream(file, table.schema) as writer:
            writer.write_table(table)
        self.store.move(self.own, f"{self.path}.arrow")
        self.store.move(f"{self.own}.index", f"{self.path}.index.arrow")


@dataclass
class TokenFiles:
    """A written corpus. manifest: path, n_docs, n_tokens, start of each part."""

    spark: SparkSession
    root: str

    @property
    def manifest(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/manifest")
        before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return rows.withColumn("start", before)  # one row for each file

    def documents(self) -> DataFrame:
        """Read the files back: doc_id, start, n_tokens, ids_crc32 of each document."""
        def read(batches):
            for batch in batches:
                for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield from _digests(path, start)

        parts = self.manifest.select("path", "start")
        spread = parts.repartition(max(1, parts.count()), "path")
        return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_mapped(path: str) -> pa.RecordBatchReader:
    """A file's batches: mapped if it lies on this machine's file system, so that no byte is copied."""
    store, inner = fs.FileSystem.from_uri(path)
    return pa.ipc.open_stream(pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner))


def _digests(path: str, start: int, step: int = 4096):
    index = open_mapped(f"{path}.index.arrow").read_all()
    ids, offsets, counts = (index[c].to_numpy() for c in ("doc_id", "offset", "n_tokens"))
    ends, sums = offsets + counts, np.zeros(len(ids), np.int64)
    doc = read = 0
    for batch in open_mapped(f"{path}.arrow"):
        values = batch.column(0).values.to_numpy()[batch.column(0).offset * batch.column(0).type.list_size :]
        upto = read + len(values)
        while doc < len(ids):
            part = values[max(offsets[doc], read) - read : min(ends[doc], upto) - read]
            sums[doc] = zlib.crc32(part.astype("<u4", copy=False).tobytes(), int(sums[doc]))
            if ends[doc] > upto:
                break
            doc += 1
        read = upto
    missing = index["doc_id"].combine_chunks()
    for at in range(0, len(ids), step):
        s = slice(at, at + step)
        yield pa.RecordBatch.from_arrays([missing.slice(at, step), pa.array(start + offsets[s]), pa.array(counts[s]), pa.array(sums[s])], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, root: str | None = None, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, length: int = SEQUENCE, end_id: int = END_ID) -> TokenFiles:
    """Encode and write a table's texts below ``root`` (a URI; else a new folder in the shared one).

    A null text counts as empty and has just the end id. Rows of one id follow one another in any
    order; a null id comes first. An empty table has a manifest without rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    root = root or f"{shared_folder(spark)}/loomline/tokens-{uuid.uuid4().hex}"
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    end = np.asarray([end_id], "<u4").tobytes()

    def write(batches):
        part = TaskContext.get().partitionId()
        out, enc = None, encoder(path)
        for batch in batches:
            if out is None:
                store, inner = fs.FileSystem.from_uri(root)
                store.create_dir(inner)
                out = _Sequences(store, f"{inner}/part-{part:06d}", length, max(len(enc.opens), end_id + 1) > 1 << 16)
            for at in range(0, batch.num_rows, 512):
                texts = [x or "" for x in batch.column(1).slice(at, 512).to_pylist()]
                for i, ids in zip(batch.column(0).slice(at, 512).to_pylist(), enc.encode(texts)):
                    out.add(i, ids + end)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{root}/part-{part:06d}"]), pa.array([len(out.index)]), pa.array([out.total])], names=["part", "path", "n_docs", "n_tokens"])

    rows = docs.select(named(doc_id).cast("long").alias("_id"), named(text).alias("_text"))
    ordered = rows.repartitionByRange(parts_for(rows, "_text"), "_id").sortWithinPartitions("_id")
    ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long").write.parquet(f"{root}/manifest")
    return TokenFiles(spark, root)
