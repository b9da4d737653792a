"""Byte-level BPE encoding and decoding by a local rank file, with the tiktoken library.

Long texts are cut before encoding, at places where the splitting pattern must
end a match in any case: after a printable ASCII character other than white
space and before a space or line feed. No match of the pattern holds both a
character of the one kind and a later one of the other, and no lookahead looks
back, so that the pieces' ids, one after another, are the text's ids. A run
without such a place stays whole.

Rows are independent: no shuffle, and a lost executor costs only its tasks.
Defined results: a null or empty text has no ids; repeated rows and ties give equal
results, an empty table an empty one; other columns of any name pass through.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomline.llm.common import named, tidy

#: Longest piece given to the library where a safe place to cut exists near, in characters.
PIECE = 65_536
#: Bytes of texts that are worked on together.
SLICE = 1 << 20
SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


@functools.lru_cache(4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: lines of a base64 piece and its rank."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text, cut at the first safe place after each ``most`` characters."""
    at = 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str, most: int = PIECE) -> np.ndarray:
    """The ids of a text as unsigned 32-bit integers, never held as Python numbers."""
    found = [enc.encode_to_numpy(piece, disallowed_special=()) for piece in pieces(text, most)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def decode(enc: tiktoken.Encoding, ids: np.ndarray, most: int = PIECE) -> bytes:
    """The raw bytes of the ids; a cut inside a character needs no repair. Ids become Python numbers ``most`` at a time."""
    return b"".join(enc.decode_bytes(ids[at : at + most].tolist()) for at in range(0, len(ids), most))


def _slices(batches, column: int):
    """Batches cut to rows of about ``SLICE`` bytes of a text or binary column together, so that little is held beside a batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        part = np.cumsum(sizes) // SLICE
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, z in zip(bounds, bounds[1:]):
            if a < z:
                yield batch.slice(a, z - a)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))


def encode_column(docs: DataFrame, text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None, verified: str | None = None) -> DataFrame:
    """``docs`` with an array of the ids of each text in column ``ids`` and, if ``verified`` names one, in that column whether they decode to the text's bytes (existing columns of these names are replaced)."""
    path, pat = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    texts = docs.select(named(text).alias("_text"), *(named(c) for c in docs.columns if c not in (ids, verified)))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(verified, T.BooleanType(), False)] if verified else [])]
    schema = T.StructType([*texts.schema.fields[1:], *fields])

    def run(batches):
        enc = encoding(path, pat)
        for part in _slices(batches, 0):
            raw = [x or "" for x in part.column(0).to_pylist()]
            coded = [encode(enc, x) for x in raw]
            added = [_lists(coded), *([pa.array([decode(enc, i) == x.encode() for i, x in zip(coded, raw)], pa.bool_())] if verified else [])]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *added], names=schema.names)

    return texts.mapInArrow(tidy(run), schema)


def decode_column(docs: DataFrame, ids: str = "ids", out: str = "decoded", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the raw bytes of each array of ids in column ``out`` (null ids: null; an existing column of that name is replaced)."""
    path, pat = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    coded = docs.select(named(ids).alias("_ids"), *(named(c) for c in docs.columns if c != out))
    schema = T.StructType([*coded.schema.fields[1:], T.StructField(out, T.BinaryType())])

    def run(batches):
        enc = encoding(path, pat)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [decode(enc, x.values.to_numpy()) if x.is_valid else None for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.binary())], names=schema.names)

    return coded.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: its key, n_tokens, and the SHA-256 of its ids (little-endian, 32 bits) and of the bytes decoded from them."""
    path, pat = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    docs = docs.select(named(key), named(text).alias("_text"))
    schema = T.StructType([docs.schema.fields[0], T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])

    def run(batches):
        enc = encoding(path, pat)
        for part in _slices(batches, 1):
            n, coded, decoded = [], [], []
            for x in part.column(1).to_pylist():
                ids = encode(enc, x or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                decoded.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)
