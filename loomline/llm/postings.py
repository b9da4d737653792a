"""Packed exchange of 64-bit tokens: which tokens do several owners hold?

A token for each shingle of a corpus is too much to shuffle as rows. Each task
sorts its tokens and sends one cell of bytes to each range of tokens: the sorted
tokens by byte planes (their high bytes compress away) and two or four bytes for
each token's owner, with a small table of the cell's owners. The receiver finds
the tokens that two owners or more hold and sends back only those.
"""

from __future__ import annotations

import numpy as np

#: Tokens that a task gathers before it sends its cells.
CHUNK = 2_000_000


def pack(tokens: np.ndarray, owners: np.ndarray, table: np.ndarray) -> bytes:
    """tokens: sorted uint64; owners: places in ``table``, rows of equal width of int64."""
    used, places = np.unique(owners, return_inverse=True)
    kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
    head = np.array([len(tokens), len(used), table.shape[1], kind().itemsize], np.int64)
    planes = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8).T)
    return b"".join((head.tobytes(), np.ascontiguousarray(table[used].T).tobytes(), planes.tobytes(), places.astype(kind).tobytes()))


def unpack(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, width, kind = np.frombuffer(cell, np.int64, 4)
    at = 32
    table = np.frombuffer(cell, np.int64, m * width, at).reshape(width, m).T
    at += m * width * 8
    planes = np.frombuffer(cell, np.uint8, 8 * n, at).reshape(8, n)
    owners = np.frombuffer(cell, np.uint16 if kind == 2 else np.uint32, n, at + 8 * n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel(), owners, table


def cells(tokens: np.ndarray, owners: np.ndarray, table: np.ndarray, parts: int):
    """(part, cell) for each of ``parts`` equal ranges of tokens that has any."""
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    present, first = np.unique(part, return_index=True)
    for p, a, z in zip(present.tolist(), first.tolist(), np.append(first[1:], len(tokens)).tolist()):
        yield p, pack(tokens[a:z], owners[a:z], table)


def distinct_rows(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the place of each row among them."""
    order = np.lexsort(table.T[::-1])
    ranked = table[order]
    new = np.ones(len(table), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(table), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def shared(received: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the cells of some ranges, the tokens that at least two owners hold.

    Returns the distinct owners' table, and for each (token, owner) once: token, owner's place, and how many owners hold the token; by token, then owner.
    """
    tokens, owners, tables, base = [], [], [], 0
    for cell in received:
        t, o, table = unpack(cell)
        tokens.append(t)
        owners.append(o.astype(np.int32) + np.int32(base))
        tables.append(table)
        base += len(table)
    if not tokens:
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1), np.int64), np.zeros(0, np.uint64), none, none
    table, place = distinct_rows(np.concatenate(tables))
    token, owner = np.concatenate(tokens), place.astype(np.int32)[np.concatenate(owners)]
    tokens.clear(), owners.clear()
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]) if len(token) else np.zeros(0, bool))
    counts = np.repeat(np.diff(np.append(first, len(token))), np.diff(np.append(first, len(token))))
    many = counts >= 2
    return table, token[many], owner[many], counts[many]
