"""Regular expressions over bytes as one minimal deterministic automaton.

A rule's expression is read into a small tree, turned into a nondeterministic automaton, joined with those of all
other rules, determinised by subset construction over classes of equal bytes, and minimised by partition refinement.
The result is a transition array (state x byte class) and a set of accepted tags for each state.

Expressions may use literals, ``.`` (any byte but a line feed), ``\\xHH`` and escaped literals, ``[...]`` with ranges
and ``^``, groups (capturing or not, both only group), ``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

ALL = frozenset(range(256))


class _Reader:
    """Recursive descent over one expression; nodes are ("set", bytes), ("seq", [..]), ("or", [..]), ("rep", x, m, n)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def read(self):
        out = self.either()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} at {self.i} of {self.p!r}")
        return out

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("seq", items)

    def repeated(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                close = self.p.index("}", self.i)
                least, _, most = self.p[self.i : close].partition(",")
                comma, self.i = "," in self.p[self.i : close], close + 1
                node = ("rep", node, int(least), int(most) if most else (None if comma else int(least)))
            else:
                node = ("rep", node, 1 if c == "+" else 0, 1 if c == "?" else None)
        return node

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c} of {self.p!r}")
        if ord(c) > 127:
            raise ValueError(f"{c!r} of {self.p!r} is more than one byte")
        return ord(c)

    def either_case(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {b ^ 32 for b in found if chr(b).isalpha() and b < 128}
        return frozenset(found)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            if self.p.startswith("?:", self.i):
                self.i += 2
            inside = self.either()
            if self.peek() != ")":
                raise ValueError(f"group of {self.p!r} does not end")
            self.take()
            return inside
        if c == "[":
            return ("set", self.klass())
        if c == ".":
            self.take()
            return ("set", ALL - {10})
        return ("set", self.either_case({self.byte()}))

    def klass(self) -> frozenset[int]:
        self.take()
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = self.byte()
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                self.take()
                found |= set(range(low, self.byte() + 1))
            else:
                found.add(low)
        self.take()
        return ALL - self.either_case(found) if negated else self.either_case(found)


def _reversed(node):
    kind = node[0]
    if kind == "seq":
        return ("seq", [_reversed(x) for x in reversed(node[1])])
    if kind == "or":
        return ("or", [_reversed(x) for x in node[1]])
    return (kind, _reversed(node[1]), *node[2:]) if kind == "rep" else node


class _Nfa:
    """States with empty moves and moves on byte sets."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, at: int) -> int:
        """States for ``node`` from ``at``; the state where it ends."""
        kind = node[0]
        if kind == "set":
            start, end = self.state(), self.state()
            self.empty[at].append(start)
            self.moves[start] = (node[1], end)
            return end
        if kind == "seq":
            for x in node[1]:
                at = self.add(x, at)
            return at
        if kind == "or":
            end = self.state()
            for x in node[1]:
                self.empty[self.add(x, at)].append(end)
            return end
        _, inside, least, most = node
        for _ in range(least):
            at = self.add(inside, at)
        end = self.state()
        self.empty[at].append(end)
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            last = self.add(inside, loop)
            self.empty[last] += [loop, end]
        else:
            for _ in range(most - least):
                at = self.add(inside, at)
                self.empty[at].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``step[state, klass[byte]]`` is the next state; ``tags[state]`` has a bit for each accepted tag. State 0 is the
    start, states that accept come last (from ``first_accepting`` on), ``dead`` is the state that nothing leaves (or
    -1). Class ``reset`` belongs to no byte: it leads from every state to the start."""

    klass: np.ndarray
    step: np.ndarray
    tags: np.ndarray
    first_accepting: int
    dead: int

    @property
    def reset(self) -> int:
        return self.step.shape[1] - 1


def _minimised(step: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal states merged: blocks of states are split by the blocks their moves lead to until none splits."""
    block = np.unique(tags, return_inverse=True)[1].ravel()
    while True:
        parts = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if parts.max(initial=0) == block.max(initial=0):
            break
        block = parts
    first = np.unique(block, return_index=True)[1]
    order = np.lexsort((first, tags[first] != 0, first != first[block[0]]))  # start, then rejecting, then accepting
    if tags[0]:
        raise ValueError("an expression that matches the empty text finds nothing")
    number = np.empty(len(first), np.int64)
    number[order] = np.arange(len(first))
    return number[block[step[first[order]]]], tags[first[order]]


@lru_cache(maxsize=16)
def compiled(patterns: tuple[tuple[str, bool], ...], backwards: bool = False, anywhere: bool = False) -> Automaton:
    """One automaton of all (pattern, fold letters); pattern k has tag bit k. ``backwards``: of the reversed texts;
    ``anywhere``: a match may begin at any byte, not only at the first."""
    nfa = _Nfa()
    start = nfa.state()
    accepts: dict[int, int] = {}
    for k, (pattern, fold) in enumerate(patterns):
        tree = _Reader(pattern, fold).read()
        first = nfa.state()
        nfa.empty[start].append(first)
        end = nfa.add(_reversed(tree) if backwards else tree, first)
        accepts[end] = accepts.get(end, 0) | 1 << k
    sets = list({m[0] for m in nfa.moves if m})
    member = np.array([[b in s for s in sets] for b in range(256)], bool).reshape(256, -1)
    rows, klass = np.unique(member, axis=0, return_inverse=True)
    klass, which = klass.ravel().astype(np.uint8), {s: j for j, s in enumerate(sets)}

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in accepts)

    begin = closed([start])
    numbers, todo, step, tags = {begin: 0}, [begin], [], []
    while todo:
        now = todo.pop(0)
        tags.append(0)
        for s in now:
            tags[-1] |= accepts.get(s, 0)
        row = []
        for j in range(len(rows)):
            to = {nfa.moves[s][1] for s in now if nfa.moves[s] and rows[j, which[nfa.moves[s][0]]]}
            after = closed(to) | begin if anywhere else closed(to)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        step.append(row)
    step, tags = _minimised(np.array(step, np.int64), np.array(tags, np.int64))
    idle = np.flatnonzero((step == np.arange(len(step))[:, None]).all(1) & (tags == 0))
    accepting = np.flatnonzero(tags)
    step = np.column_stack([step, np.zeros(len(step), np.int64)])
    return Automaton(klass, step, tags, int(accepting[0]) if len(accepting) else len(tags), int(idle[0]) if len(idle) else -1)
