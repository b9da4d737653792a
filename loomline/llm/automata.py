"""Deterministic automata over bytes, compiled from several regular expressions.

Patterns may hold literals, ``\\x20``-like and ``\\.``-like escapes, classes,
groups, ``|``, and ``? * + {m} {m,} {m,n}``. A pattern becomes a
nondeterministic automaton; any number of them become one deterministic
automaton by subset construction, minimised by partition refinement. Its
transitions are an array of states by bytes.
"""

from __future__ import annotations

import numpy as np


class Nfa:
    """Edges on byte sets and on nothing; one start and one accepting state."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []
        self.start = self.end = -1

    def new(self) -> int:
        self.free.append([])
        self.on.append([])
        return len(self.free) - 1

    def reversed(self) -> Nfa:
        out = Nfa()
        for _ in self.free:
            out.new()
        for s, targets in enumerate(self.free):
            for t in targets:
                out.free[t].append(s)
        for s, edges in enumerate(self.on):
            for bytes_, t in edges:
                out.on[t].append((bytes_, s))
        out.start, out.end = self.end, self.start
        return out


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def char(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        if c.isalnum():
            raise ValueError(f"\\{c} isn't supported")
        return ord(c)

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("and", parts)

    def repeated(self):
        item = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                body = self.p[self.i : self.p.index("}", self.i)]
                self.i += len(body) + 1
                least, comma, most = body.partition(",")
                item = ("times", item, int(least), (int(most) if most else None) if comma else int(least))
            else:
                item = ("times", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def atom(self):
        if self.peek() == "(":
            self.take()
            found = self.choice()
            if self.take() != ")":
                raise ValueError("unclosed group")
            return found
        if self.peek() == "[":
            self.take()
            out = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    out.update(range(low, self.char() + 1))
                else:
                    out.add(low)
            self.take()
            return ("set", frozenset(out))
        return ("set", frozenset([self.char()]))


def nfa(pattern: str) -> Nfa:
    """The automaton of a pattern (of characters below 128)."""
    parser, out = _Parser(pattern), Nfa()
    tree = parser.choice()
    if parser.i != len(pattern):
        raise ValueError(f"can't read {pattern!r} from {parser.i}")

    def build(node) -> tuple[int, int]:
        a, z = out.new(), out.new()
        if node[0] == "set":
            out.on[a].append((node[1], z))
        elif node[0] == "or":
            for x in node[1]:
                s, e = build(x)
                out.free[a].append(s)
                out.free[e].append(z)
        elif node[0] == "and":
            at = a
            for x in node[1]:
                s, e = build(x)
                out.free[at].append(s)
                at = e
            out.free[at].append(z)
        else:
            _, item, least, most = node
            at = a
            for _ in range(least):
                s, e = build(item)
                out.free[at].append(s)
                at = e
            out.free[at].append(z)
            if most is None:
                s, e = build(item)
                out.free[at].append(s)
                out.free[e] += [s, z]
            else:
                for _ in range(most - least):
                    s, e = build(item)
                    out.free[at].append(s)
                    out.free[e].append(z)
                    at = e
        return a, z

    out.start, out.end = build(tree)
    return out


class Dfa:
    """``table[state, byte]`` is the next state; ``accepts[state]`` has a bit for each pattern that a match ends with. State 0 is the start."""

    def __init__(self, table: np.ndarray, accepts: np.ndarray):
        self.table, self.accepts = table, accepts
        self.rows = None

    def linked(self) -> list:
        """The states as lists: 256 next ones, the accepted patterns, and whether no match can follow. Following them needs one lookup a byte."""
        if self.rows is None:
            rows = [[None] * 258 for _ in self.table]
            dead = (self.table == np.arange(len(self.table))[:, None]).all(axis=1) & (self.accepts == 0)
            for row, targets, accepted, over in zip(rows, self.table.tolist(), self.accepts.tolist(), dead.tolist()):
                row[:256] = [rows[t] for t in targets]
                row[256:] = accepted, over
            self.rows = rows
        return self.rows

    def __getstate__(self):
        return self.table, self.accepts

    def __setstate__(self, state):
        self.__init__(*state)


def dfa(automata: list[Nfa], anywhere: bool = False) -> Dfa:
    """All automata in one, minimal. anywhere: a match may start at every byte."""
    cuts = {frozenset(range(256))}
    for a in automata:
        for edges in a.on:
            for bytes_, _ in edges:
                cuts = {x for c in cuts for x in (c & bytes_, c - bytes_) if x}
    kinds = sorted(cuts, key=min)

    def closed(states: set) -> frozenset:
        todo = list(states)
        while todo:
            k, s = todo.pop()
            for t in automata[k].free[s]:
                if (k, t) not in states:
                    states.add((k, t))
                    todo.append((k, t))
        return frozenset((k, s) for k, s in states if automata[k].on[s] or s == automata[k].end)

    first = closed({(k, a.start) for k, a in enumerate(automata)})
    known, order, moves = {first: 0}, [first], []
    for states in order:  # grows meanwhile
        row = []
        for kind in kinds:
            b = next(iter(kind))
            to = {(k, t) for k, s in states for bytes_, t in automata[k].on[s] if b in bytes_}
            reached = closed(to) | first if anywhere else closed(to)
            if reached not in known:
                known[reached] = len(order)
                order.append(reached)
            row.append(known[reached])
        moves.append(row)
    table = np.array(moves)
    accepts = np.array([sum(1 << k for k, a in enumerate(automata) if (k, a.end) in states) for states in order])
    if anywhere:  # an empty match at the start is no match
        accepts[0] = 0

    part = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    _, example = np.unique(part, return_index=True)
    rank = np.empty(len(example), int)  # the start becomes 0
    rank[np.argsort(example != example[part[0]], kind="stable")] = np.arange(len(example))
    by_rank = np.argsort(rank)
    small = rank[part[table[example[by_rank]]]]
    wide = np.empty((len(small), 256), np.uint16 if len(small) < 1 << 16 else np.uint32)
    for i, kind in enumerate(kinds):
        wide[:, list(kind)] = small[:, [i]]
    return Dfa(wide, accepts[example[by_rank]])
