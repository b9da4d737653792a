"""Words and their hashes for whole blocks of texts at once, over the texts' UTF-8 bytes.

Word gaps are six ASCII characters and only A-Z are lower-cased, so that bytes
and code points give the same words. Hashes have 64 bits and depend on nothing
but the word's bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

GAPS = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Longer words are hashed one by one.
LONG = 4096

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads each bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@dataclass
class Words:
    """starts, lengths: in bytes from the block's first; hashes; text: the row of each word; first: the place of each row's first word (n+1 long)."""

    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray


def word_hashes(data: np.ndarray, offsets: np.ndarray, extra_gap: bytes = b"") -> Words:
    """The words of a block: ``data`` its bytes, ``offsets`` its rows' n+1 bounds, from 0. extra_gap: further bytes that end a word. A-Z count as lower case.

    A word's hash takes in its bytes eight at a time, read at any address.
    """
    n, raw = len(offsets) - 1, data.tobytes()
    inside = np.frombuffer(raw.translate(bytes(c not in GAPS + extra_gap for c in range(256))), np.uint8)
    low = raw.translate(LOWER)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] & 1
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[rows] = inside[rows]  # a row's first byte starts a word of its own
    stops = inside.copy()
    stops[:-1] &= (~inside[1:] & 1) | begins[1:]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    first = np.searchsorted(starts, offsets)
    eights = np.ndarray((len(low) + 1,), "<u8", low + bytes(8), strides=(1,))
    with np.errstate(over="ignore"):
        hashes = mix((eights[starts] & _MASKS[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * _BASE))
        more, k = np.flatnonzero(lengths > 8), 8
        huge = more[lengths[more] > LONG]
        more = more[lengths[more] <= LONG]
        while len(more):
            hashes[more] = mix(hashes[more] * _U(3) + (eights[starts[more] + k] & _MASKS[np.minimum(lengths[more] - k, 8)]))
            k += 8
            more = more[lengths[more] > k]
    for i in huge.tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(low[starts[i] : starts[i] + lengths[i]])
    return Words(starts, lengths, hashes, np.repeat(np.arange(n), np.diff(first)), first)


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words, and their rows; a row with fewer words (but one) has one run of all."""
    n = len(words.first) - 1
    counts = np.diff(words.first)
    with np.errstate(over="ignore"):
        if len(words.hashes) >= size:
            runs = np.zeros(len(words.hashes) - size + 1, np.uint64)
            for k in range(size):
                runs = mix(runs + words.hashes[k : len(words.hashes) - size + 1 + k] * _U(2 * k + 3))
            whole = words.text[: len(runs)] == words.text[size - 1 :]
            runs, rows = runs[whole], words.text[: len(whole)][whole]
        else:
            runs, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        extra = []
        for r in short:
            h = _U(0x5851F42D4C957F2D) + _U(counts[r])
            for x in words.hashes[words.first[r] : words.first[r + 1]]:
                h = mix(np.asarray(h + x * _U(3)))[()]
            extra.append(h)
    if not len(short):
        return runs, rows
    runs, rows = np.concatenate([runs, np.array(extra, np.uint64)]), np.concatenate([rows, short])
    order = np.argsort(rows, kind="stable")
    return runs[order], rows[order]
