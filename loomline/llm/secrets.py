"""Secret scans with one automaton for all rules.

All rules' patterns are compiled into one deterministic automaton that reads
each byte of a text once (``automata``). Where it accepts a rule, the rule's own
backward automaton finds the match's start and its forward one the longest end;
both run only over found matches. Matches of a rule are leftmost and do not
overlap; one that is too short is dropped after it has taken its characters.

Needed of a rule: of two matches, the one that starts first can also end first.
It holds for patterns that end in a class and don't hold themselves.

Rows are independent: no shuffle. Defined results: a null or empty text has no matches;
repeated rows and ties give equal results, an empty table an empty one. Long texts are
read whole. Of other columns only the key is kept.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.automata import Dfa, dfa, nfa


@dataclass(frozen=True)
class Rule:
    """least: characters of the match, or, with a head, of what follows the head."""

    kind: str
    pattern: str
    least: int
    head: str | None = None


def either_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


_HEAD = "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?"""

#: The first three kinds, then forms of issued keys.
BASE = (
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", 6, _HEAD),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),  # a shorter run can't hold a longer one
)
RULES = BASE + (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 27),
)


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    all: Dfa
    forward: list[Dfa]
    backward: list[Dfa]
    heads: list[Dfa | None]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule's number) in bytes, by start, then rule."""
        row = self.all.linked()[0]
        found, after = [], [0] * len(self.rules)
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                for k in range(len(self.rules)):
                    if row[256] >> k & 1 and i >= after[k]:
                        self._match(data, i + 1, k, after, found)
        return sorted(found)

    def _match(self, data: bytes, end: int, k: int, after: list[int], found: list) -> None:
        start, row = -1, self.backward[k].linked()[0]
        for j in range(end - 1, after[k] - 1, -1):
            row = row[data[j]]
            if row[256]:
                start = j
            if row[257]:
                break
        if start < 0:
            return
        end = longest(self.forward[k], data, start)
        after[k] = end
        rule = self.rules[k]
        value = longest(self.heads[k], data, start) if self.heads[k] else start
        if end - value >= rule.least:
            found.append((start, end, k))


def longest(automaton: Dfa, data: bytes, start: int) -> int:
    """The end of the longest match that starts at ``start``."""
    row, end = automaton.linked()[0], start
    for j in range(start, len(data)):
        row = row[data[j]]
        if row[256]:
            end = j + 1
        if row[257]:
            break
    return end


@functools.lru_cache(8)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    automata = [nfa(r.pattern) for r in rules]
    return Scanner(rules, dfa(automata, anywhere=True), [dfa([a]) for a in automata], [dfa([a.reversed()]) for a in automata], [dfa([nfa(r.head)]) if r.head else None for r in rules])


def code_points(data: bytes, at: list[int]) -> list[int]:
    """Byte offsets as numbers of code points."""
    if data.isascii():
        return at
    whole = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [int(whole[x - 1]) if x else 0 for x in at]


def find(scan: Scanner, text: str) -> list[tuple[int, int, int]]:
    """Matches of a text in code points: (start, end, rule's number)."""
    data = text.encode()
    found = scan.scan(data)
    ends = code_points(data, [x for s, e, _ in found for x in (s, e)])
    return [(ends[2 * i], ends[2 * i + 1], k) for i, (_, _, k) in enumerate(found)]


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: its key, how many matches each of the first three rules has, a SHA-256 of those, and all matches as kind:start:end (code points, end exclusive)."""
    docs = docs.select(F.col(key), F.col(text).alias("_text"))
    counts = [f"n_{r.kind}" for r in rules[: len(BASE)]]
    schema = T.StructType([docs.schema.fields[0], *(T.StructField(c, T.LongType(), False) for c in counts), T.StructField("base_sha256", T.StringType(), False), T.StructField("spans", T.StringType(), False)])
    compiled = scanner(rules)  # once, on the driver: workers get the arrays

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = find(compiled, text.as_py() or "")
                base = [x for x in found if x[2] < len(counts)]
                told = lambda xs: ",".join(f"{rules[k].kind}:{s}:{e}" for s, e, k in xs)
                rows.append([sum(x[2] == k for x in base) for k in range(len(counts))] + [hashlib.sha256(told(base).encode()).hexdigest(), told(found)])
            columns = list(zip(*rows)) or [[] for _ in range(len(counts) + 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[: len(counts)]), *(pa.array(c, pa.string()) for c in columns[len(counts) :])], names=schema.names)

    return docs.mapInArrow(run, schema)
