"""One minimal deterministic automaton over bytes for many regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C, _parser as parser

import numpy as np


@dataclass
class Automaton:
    """Transition array: the state after byte b in state s is ``step[s, classes[b]]``; state 0 is the start.

    ``accepts[s]`` is a bit set of the rules of which some match ends here. No rule knows a byte of
    ``breaks``: no match holds one, and after it the automaton is in its start state again.
    """

    step: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray
    breaks: np.ndarray


class _Nfa:
    """Thompson construction from Python's own parse of a pattern."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def sequence(self, items, at: int, fold: bool) -> int:
        for op, arg in items:
            at = self.item(op, arg, at, fold)
        return at

    def item(self, op, arg, at: int, fold: bool) -> int:
        if op is C.LITERAL or op is C.IN:
            out = self.state()
            self.arcs[at].append((self.members([(op, arg)] if op is C.LITERAL else arg, fold), out))
            return out
        if op is C.SUBPATTERN:
            _, add, _, inner = arg
            return self.sequence(inner, at, fold or bool(add & re.IGNORECASE))
        if op is C.BRANCH:
            out = self.state()
            for branch in arg[1]:
                self.eps[self.sequence(branch, at, fold)].append(out)
            return out
        if op is C.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                at = self.sequence(inner, at, fold)
            if high is C.MAXREPEAT:
                loop = self.state()
                self.eps[at].append(loop)
                self.eps[self.sequence(inner, loop, fold)].append(loop)
                return loop
            out = self.state()
            self.eps[at].append(out)
            for _ in range(high - low):
                at = self.sequence(inner, at, fold)
                self.eps[at].append(out)
            return out
        raise ValueError(f"rules may not use {op}")

    def reversed(self) -> _Nfa:
        """The same states with every arc the other way round."""
        out = _Nfa()
        for _ in self.eps:
            out.state()
        for at, nexts in enumerate(self.eps):
            for nxt in nexts:
                out.eps[nxt].append(at)
        for at, arcs in enumerate(self.arcs):
            for members, nxt in arcs:
                out.arcs[nxt].append((members, at))
        return out

    @staticmethod
    def members(items, fold: bool) -> frozenset[int]:
        found: set[int] = set()
        for op, arg in items:
            if op is C.LITERAL:
                found.add(arg)
            elif op is C.RANGE:
                found.update(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"rules may not use {op} in a set")
        if fold:
            found |= {ord(x) for c in found if c < 128 for x in (chr(c).lower(), chr(c).upper())}
        if max(found) > 127:
            raise ValueError("rules are over ASCII")
        return frozenset(found)


def _subsets(pattern: str, anchored: bool = False, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(step over bytes, accepting) of the automaton that finds ``pattern`` ending anywhere; ``anchored``: beginning at the first
    byte only; ``backward``: reading the bytes from right to left."""
    nfa = _Nfa()
    start = nfa.state()
    final = nfa.sequence(parser.parse(pattern), start, False)
    if backward:
        nfa, start, final = nfa.reversed(), final, start

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in nfa.eps[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    first = closure([start])
    names, todo, rows = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        to: list[set[int]] = [set() for _ in range(256)]
        for s in now:
            for members, out in nfa.arcs[s]:
                for b in members:
                    to[b].add(out)
        row, memo = np.zeros(256, np.int32), {}
        for b in range(256):
            key = frozenset(to[b])
            if key not in memo:
                target = closure(key if anchored else key | {start})
                if target not in names:
                    names[target] = len(names)
                    todo.append(target)
                memo[key] = names[target]
            row[b] = memo[key]
        rows.append(row)
    return np.array(rows), np.array([final in s for s in names])


def _minimal(step: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no continuation tells apart: split by successors until nothing splits."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = {}
    for b in block:  # the start keeps number 0
        order.setdefault(int(b), len(order))
    names = np.array([order[int(b)] for b in block])
    pick = np.unique(names, return_index=True)[1]
    return names[step[pick]], accepts[pick]


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimal automaton that follows both; ``a`` accepts with bit sets, acceptance of ``b`` adds ``bit``."""
    (step, accepts), (own, final) = a, b
    names, todo, rows, marks = {(0, 0): 0}, [(0, 0)], [], []
    while todo:
        i, j = todo.pop(0)
        pairs = step[i].astype(np.int64) * len(own) + own[j]
        row = np.zeros(256, np.int64)
        for p in np.unique(pairs):
            pair = divmod(int(p), len(own))
            if pair not in names:
                names[pair] = len(names)
                todo.append(pair)
            row[pairs == p] = names[pair]
        rows.append(row)
        marks.append(accepts[i] | int(final[j]) << bit)
    return _minimal(np.array(rows), np.array(marks))


def _alphabet(pattern: str) -> set[int]:
    nfa = _Nfa()
    nfa.sequence(parser.parse(pattern), nfa.state(), False)
    return {b for arcs in nfa.arcs for members, _ in arcs for b in members}


def compile_rules(patterns: list[str], also: list[str] = ()) -> Automaton:
    """The automaton of ``patterns``; bytes of the patterns in ``also`` are no breaks either.

    Subset construction and minimisation per rule, then the reachable product of all, minimised again.
    """
    step, accepts = np.zeros((1, 256), np.int64), np.zeros(1, np.int64)
    for k, pattern in enumerate(patterns):
        step, accepts = _product((step, accepts), _minimal(*_subsets(pattern)), k)
    columns, classes = np.unique(step, axis=1, return_inverse=True)
    breaks = np.ones(256, bool)
    breaks[list(set().union(*map(_alphabet, [*patterns, *also])))] = False
    return Automaton(columns.astype(np.int32), classes.reshape(-1).astype(np.uint8), accepts, breaks)


class Spans:
    """Spans of one rule in a run of bytes, read off transition arrays alone.

    Read backward, ``starts`` tells every place where some match of the pattern begins. Read forward from such a place, ``ends``
    tells where matches end (bit 0) and which of them satisfy ``full`` as well (bit 1). A span begins at the first start that no
    earlier span covers and is the longest match from there.
    """

    def __init__(self, pattern: str, full: str) -> None:
        step, final = _minimal(*_subsets(pattern, backward=True))
        if final[0]:
            raise ValueError("rules may not match the empty string")
        self.starts, self.begins = step.tolist(), final.tolist()
        none = np.zeros((1, 256), np.int64), np.zeros(1, np.int64)
        step, accepts = _product(_product(none, _minimal(*_subsets(pattern, anchored=True)), 0), _minimal(*_subsets(full, anchored=True)), 1)
        dead = (step == np.arange(len(step))[:, None]).all(1) & (accepts == 0)
        self.ends, self.accepts, self.dead = step.tolist(), accepts.tolist(), dead.tolist()

    def find(self, piece: bytes) -> list[tuple[int, int]]:
        """(start, end) of the spans that satisfy ``full``, leftmost and not overlapping."""
        begin = bytearray(len(piece))
        state, step, begins = 0, self.starts, self.begins
        for i in range(len(piece) - 1, -1, -1):
            state = step[state][piece[i]]
            if begins[state]:
                begin[i] = 1
        out, at = [], begin.find(1)
        while at >= 0:
            state, end, good = 0, at, False
            for i in range(at, len(piece)):
                state = self.ends[state][piece[i]]
                if self.accepts[state] & 1:
                    end, good = i + 1, self.accepts[state] > 1
                elif self.dead[state]:
                    break
            if good:
                out.append((at, end))
            at = begin.find(1, end)
        return out
