"""Jaccard similarity join of documents on word n-grams, as classes and components.

Documents are sets of 64-bit hashes of five-word shingles. Equal sets form a
class; from there on a class is one document. The join is by prefix filtering:

1. Each shingle's document frequency over the whole corpus gives one order, rare
   first. It comes from a packed exchange (``postings``), which sends back only
   shingles of two classes or more: others are in no intersection, and being
   the rarest they stand first.
2. A class of n shingles posts its first n - ceil(0.8 n) + 1. Those of frequency
   one need no posting: a class with as many of them drops out here.
3. Classes that share a posted shingle are a candidate pair if lengths, positions
   and suffixes allow the overlap: 180 * o >= 80 * (n + m). Positions bound o by
   the shorter rest behind the shared shingle, suffixes by the rests' counts in
   eight cells of the hash space.
4. Candidates are verified once per pair, exactly, on their shared shingles.

Only components are asked for, so that a group of k near copies needs no k * k
pairs: first every class of a posting list is held against the list's smallest
class only; then lists whose members are in different components are
completed with the pairs between those. No list, class or component is cut short.

Frequencies, postings and pairs move as distributed tables; written tables cut
the lineage. A shingle that most documents share costs its range one entry of two
bytes and eight for each class. Two different shingles of a corpus of
10^12 have equal hashes with a chance of about 1 in 37; of two documents, about never.

Defined results: a null or empty text has no shingles and is its own component;
repeated rows are copies; a null id has the component of its copies, else null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.bytewords import mix, shingle_hashes, word_hashes
from loomline.llm.common import WORD, Workspace, blocks, parts_for, text_bytes, tidy
from loomline.llm.components import components
from loomline.llm.postings import CHUNK, cells, shared

SHINGLE = 5
PERCENT = 80
CELLS = 8


def _sets(column: pa.Array, size: int):
    """For each block of texts: its first row, distinct (row, shingle) by row and shingle, and the rows' bounds among them."""
    data, offsets = text_bytes(column)
    for a, z in blocks(offsets):
        words = word_hashes(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        hashes, rows = shingle_hashes(words, size)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[new], rows[new]
        yield a, hashes, rows, np.searchsorted(rows, np.arange(z - a + 1))


def _signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each row's set, and its size."""
    with np.errstate(over="ignore"):
        totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x71C9A3, 0x5DEECE66D)]
        sums = [t[bounds[1:]] - t[bounds[:-1]] for t in totals]
    return np.column_stack([sums[0].view(np.int64), sums[1].view(np.int64), np.diff(bounds)])


def _owners(signatures: np.ndarray) -> np.ndarray:
    """A class in 16 bytes: 64 bits of the signature, then 32 more and the size."""
    low = signatures[:, 1].view(np.uint64) << np.uint64(32) | signatures[:, 2].astype(np.uint64)
    return np.column_stack([signatures[:, 0], low.view(np.int64)])


def document_sets(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE) -> DataFrame:
    """(_id, hi, lo, n): each row's id, its class, and its set's size (which lo holds as well)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_t"))

    def run(batches):
        for batch in batches:
            found = [_signatures(h, bounds) for _, h, _, bounds in _sets(batch.column(1), size)]
            s = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (*_owners(s).T, s[:, 2]))], names=["_id", "hi", "lo", "n"])

    return rows.mapInArrow(tidy(run), "_id long, hi long, lo long, n long")


def _send(docs: DataFrame, text: str, size: int, parts: int) -> DataFrame:
    def run(batches):
        tokens, owners, tables, held, base = [], [], [], 0, 0

        def flush():
            nonlocal held, base
            if held:
                table, place = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
                t, o = np.concatenate(tokens), place.ravel().astype(np.int32)[np.concatenate(owners)]
                tokens.clear(), owners.clear()
                found = list(cells(t, o, table, parts))
                for at in range(0, len(found), 64):
                    p, c = zip(*found[at : at + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.binary())], names=["part", "cell"])
            tokens.clear(), owners.clear(), tables.clear()
            held = base = 0

        for batch in batches:
            for _, hashes, rows, bounds in _sets(batch.column(0), size):
                tokens.append(hashes)
                owners.append((rows + base).astype(np.int32))
                tables.append(_owners(_signatures(hashes, bounds)))
                held, base = held + len(hashes), base + len(bounds) - 1
                if held >= CHUNK:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(text).alias("_t")).mapInArrow(tidy(run), "part int, cell binary")


def _answer(parts: int):
    """Of a task's ranges, each class's shingles that other classes hold as well: a cell of them for each of ``parts`` ranges of classes."""

    def run(batches):
        received = [cell for batch in batches for cell in batch.column(1).to_pylist()]
        table, token, owner, count = shared(received)
        del received
        order = np.argsort(owner, kind="stable")
        token, owner, count = token[order], owner[order], count[order].astype(np.uint32)
        present, first = np.unique(owner, return_index=True)
        lengths = np.diff(np.append(first, len(token)))
        to = (table[present, 0].view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # the table is sorted by signed numbers
        for p in np.unique(to).tolist():
            mine = to == p
            those = np.repeat(mine, lengths)
            head = np.array([mine.sum(), those.sum()], np.int64)
            cell = b"".join(x.tobytes() for x in (head, table[present[mine]], lengths[mine], token[those], count[those]))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([cell], pa.binary())], names=["part", "cell"])

    return run


def _read_answer(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k = np.frombuffer(cell, np.int64, 2)
    bounds = np.cumsum([16, 16 * n, 8 * n, 8 * k])
    kinds = (np.int64, 2 * n), (np.int64, n), (np.uint64, k), (np.uint32, k)
    table, lengths, token, count = (np.frombuffer(cell, kind, int(size), int(at)) for (kind, size), at in zip(kinds, bounds))
    return table.reshape(-1, 2), lengths, token, count


def _order(percent: int):
    """Put a class's shared shingles together, rare first; keep classes that have some within their prefix."""

    def run(batches):
        cells_ = [_read_answer(cell) for batch in batches for cell in batch.column(1).to_pylist()]
        if not cells_:
            return
        tables, lengths, tokens, counts = (np.concatenate(x) for x in zip(*cells_))
        classes, place = np.unique(tables, axis=0, return_inverse=True)
        owner = np.repeat(place.ravel(), lengths)
        order = np.lexsort((tokens, counts, owner))
        token, owner = tokens[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(classes) + 1))
        n, m = classes[:, 1] & 0xFFFFFFFF, np.diff(bounds)
        posted = n + (-percent * n) // 100 + 1 - (n - m)  # the prefix less the shingles of frequency one
        kept = np.flatnonzero(posted > 0)
        for at in range(0, len(kept), 1024):
            k = kept[at : at + 1024]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (classes[k, 0], classes[k, 1], n[k], posted[k])), pa.array([token[bounds[i] : bounds[i + 1]].tobytes() for i in k], pa.binary())],
                names=["hi", "lo", "n", "posted", "tokens"],
            )

    return run


def _post(batches):
    """A row for each posted shingle: position, size and per-cell counts of what stands behind it."""
    for batch in batches:
        for rep, n, posted, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
            tokens = np.frombuffer(data, np.uint64)
            one = (tokens >> np.uint64(61))[:, None] == np.arange(CELLS, dtype=np.uint64)
            behind = one.sum(axis=0) - np.cumsum(one, axis=0)[:posted]
            rest = len(tokens) - 1 - np.arange(posted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[:posted].view(np.int64)), pa.array(np.full(posted, rep)), pa.array(np.full(posted, n)), pa.array(rest), *(pa.array(behind[:, i]) for i in range(CELLS))],
                names=["token", "rep", "n", "rest", *(f"c{i}" for i in range(CELLS))],
            )


_POSTING = "token long, rep long, n long, rest long, " + ", ".join(f"c{i} long" for i in range(CELLS))


def _possible(a: str, b: str, percent: int):
    """Length, positional and suffix filters of two postings of one shingle."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    needed = percent * (n + m)
    rest = F.least(f"{a}.rest", f"{b}.rest") + 1
    suffix = sum((F.least(f"{a}.c{i}", f"{b}.c{i}") for i in range(CELLS)), F.lit(1))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= needed) & (suffix * (100 + percent) >= needed)


def _verify(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """(u, v, linked) of each pair (u, v)."""
    a = ordered.select(F.col("rep").alias("u"), F.col("n").alias("_n"), F.col("tokens").alias("_t"))
    b = ordered.select(F.col("rep").alias("v"), F.col("n").alias("_m"), F.col("tokens").alias("_s"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", "_n", "_m", "_t", "_s")

    def run(batches):
        for batch in batches:
            linked = []
            for n, m, t, s in zip(*(batch.column(i) for i in range(2, 6))):
                x = np.concatenate([np.frombuffer(t.as_buffer(), np.uint64), np.frombuffer(s.as_buffer(), np.uint64)])
                x.sort()
                o = int((x[1:] == x[:-1]).sum())
                linked.append(100 * o >= percent * (n.as_py() + m.as_py() - o))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])

    return both.mapInArrow(tidy(run), "u long, v long, linked boolean")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of ``docs``: _id, n_shingles, component_id (the smallest id reachable by links)."""
    space, parts = Workspace(docs.sparkSession, "ngrams"), parts_for(docs, text)
    sets = space.table("sets", document_sets(docs, doc_id, text, size))
    classes = sets.where("n > 0").groupBy("hi", "lo").agg(F.min("_id").alias("rep"))

    sent = _send(docs, text, size, parts).repartitionById(parts, F.col("part"))
    answered = sent.mapInArrow(tidy(_answer(parts)), "part int, cell binary").repartitionById(parts, F.col("part"))
    ordered = answered.mapInArrow(tidy(_order(percent)), "hi long, lo long, n long, posted long, tokens binary")
    ordered = space.table("ordered", ordered.join(classes.where("rep is not null"), ["hi", "lo"]).select("rep", "n", "posted", "tokens"))
    posted = ordered.mapInArrow(tidy(_post), _POSTING)
    held = posted.groupBy("token").agg(F.count("*").alias("_k")).where("_k > 1").select("token")
    posted = space.table("posted", posted.join(held, "token"))

    columns = posted.columns[1:]
    pivots = posted.groupBy("token").agg(F.min(F.struct(*columns)).alias("p")).select("token", "p.*")
    star = posted.alias("a").join(pivots.alias("b"), "token").where((F.col("a.rep") > F.col("b.rep")) & _possible("a", "b", percent))
    star = _verify(star.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v")).distinct(), ordered, percent)
    star = space.table("star", star)
    first = space.table("first", components(star.where("linked"), space, "first-round"))

    placed = posted.join(first, F.col("rep") == F.col("node"), "left").withColumn("at", F.coalesce("component", "rep")).drop("node", "component")
    mixed = placed.groupBy("token").agg(F.min("at").alias("_a"), F.max("at").alias("_z")).where("_a <> _z").select("token")
    placed = space.table("placed", placed.join(mixed, "token"))
    across = placed.alias("a").join(placed.alias("b"), "token").where((F.col("a.rep") > F.col("b.rep")) & (F.col("a.at") != F.col("b.at")) & _possible("a", "b", percent))
    across = across.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v")).distinct().join(star.select("u", "v"), ["u", "v"], "left_anti")
    across = space.table("across", _verify(across, ordered, percent))
    links = first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(across.where("linked").select("u", "v"))
    found = components(links, space, "second-round")

    out = sets.join(classes, ["hi", "lo"], "left").join(found, F.col("rep") == F.col("node"), "left")
    out = out.select("_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("_id")).alias("component_id"))
    out = space.table("result", out)
    space.drop_all_but("result")
    return out


#: The same rows by joining all shingles of all documents.
SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end) as s from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as o from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
e as (select u, v from p join n x on u = x.doc_id join n y on v = y.doc_id where 100 * o >= {PERCENT} * (x.n + y.n - o)),
r(doc_id, c) as (select doc_id, doc_id from d union select v, c from r join e on u = r.doc_id)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r.c) as component_id
from d join r using (doc_id) left join n using (doc_id) group by d.doc_id
"""
