"""Combined deterministic automaton over bytes: rules to an NFA, subset construction, minimisation, transition arrays.

Rule syntax is that of ``re`` without anchors, look-arounds and lazy repeats; it is read by the standard library's own
regex reader. Matches are leftmost-longest.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from re import _constants as C, _parser  # type: ignore[attr-defined]


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def chain(self, items, start: int, fold: bool) -> int:
        """Add the parsed items after ``start``; return the last state."""
        for op, arg in items:
            start = self.item(op, arg, start, fold)
        return start

    def item(self, op, arg, start: int, fold: bool) -> int:
        if op is C.SUBPATTERN:
            _, add, _, inner = arg
            return self.chain(inner, start, fold or bool(add & re.IGNORECASE))
        if op is C.BRANCH:
            end = self.state()
            for branch in arg[1]:
                self.empty[self.chain(branch, self.branch_from(start), fold)].append(end)
            return end
        if op is C.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                start = self.chain(inner, start, fold)
            if high is C.MAXREPEAT:
                loop = self.branch_from(start)
                self.empty[self.chain(inner, loop, fold)].append(loop)
                out = self.branch_from(loop)
                return out
            end = self.state()
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.chain(inner, start, fold)
            self.empty[start].append(end)
            return end
        end = self.state()
        self.moves[start].append((_bytes_of(op, arg, fold), end))
        return end

    def branch_from(self, start: int) -> int:
        new = self.state()
        self.empty[start].append(new)
        return new

    def close(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def _bytes_of(op, arg, fold: bool) -> frozenset[int]:
    if op is C.LITERAL:
        found = {arg}
    elif op is C.NOT_LITERAL:
        found = set(range(256)) - {arg}
    elif op is C.ANY:
        found = set(range(256)) - {10}
    elif op is C.IN:
        found, negate = set(), False
        for kind, value in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                found.add(value)
            elif kind is C.RANGE:
                found |= set(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"class item {kind} is not supported")
        found = set(range(256)) - found if negate else found
    else:
        raise ValueError(f"{op} is not supported")
    if max(found) > 255:
        raise ValueError("rules are over bytes")
    if fold:
        found |= {ord(f(chr(b))) for b in found if chr(b).isascii() and chr(b).isalpha() for f in (str.upper, str.lower)}
    return frozenset(found)


@dataclass
class Automaton:
    """``table[state + cls]`` is the next state; a state is its number times ``width``. State 0 is the start.

    ``dead`` is the state without a way to acceptance (-1: none). States from ``accepting`` on accept; ``rules`` has
    their sets of rules as bits.
    """

    classes: bytes
    width: int
    table: list[int]
    accepting: int
    rules: dict[int, int]
    dead: int

    def found(self, data: bytes) -> int:
        """Rules that match anywhere, as bits; for an automaton made with ``anywhere``. One step for each byte."""
        table, accepting, rules, state, bits = self.table, self.accepting, self.rules, 0, 0
        for cls in data.translate(self.classes):
            state = table[state + cls]
            if state >= accepting:
                bits |= rules[state]
        return bits

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        table, dead, accepting, state, end = self.table, self.dead, self.accepting, 0, -1
        for i in range(at, len(data)):
            state = table[state + self.classes[data[i]]]
            if state == dead:
                break
            if state >= accepting:
                end = i + 1
        return end

    def spans(self, data: bytes) -> list[tuple[int, int]]:
        """Leftmost-longest matches that don't overlap; for an anchored automaton of one rule."""
        first = [self.table[self.classes[b]] != self.dead for b in range(256)]
        out, at, n = [], 0, len(data)
        while at < n:
            if first[data[at]]:
                end = self.longest(data, at)
                if end > at:
                    out.append((at, end))
                    at = end
                    continue
            at += 1
        return out


def compile_rules(rules: list[str], anywhere: bool) -> Automaton:
    """One minimal automaton of all rules. ``anywhere``: a match may start at any byte."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for i, rule in enumerate(rules):
        ends[nfa.chain(_parser.parse(rule), nfa.branch_from(start), False)] = 1 << i
    # Bytes that no rule tells apart share a class.
    used = sorted({m[0] for moves in nfa.moves for m in moves}, key=sorted)
    by_use = defaultdict(list)
    for b in range(256):
        by_use[tuple(b in s for s in used)].append(b)
    groups = list(by_use.values())
    # Subset construction; a set of NFA states is an integer with a bit for each.
    closed = [sum(1 << s for s in nfa.close([k])) for k in range(len(nfa.moves))]
    moves = [[([i for i, g in enumerate(groups) if g[0] in chars], closed[t]) for chars, t in m] for m in nfa.moves]
    first, again = closed[start], closed[start] if anywhere else 0
    number, subsets, steps = {first: 0}, [first], []
    for subset in subsets:  # grows while it is read
        row = [again] * len(groups)
        left = subset
        while left:
            low = left & -left
            left ^= low
            for classes, to in moves[low.bit_length() - 1]:
                for c in classes:
                    row[c] |= to
        for nxt in row:
            if nxt not in number:
                number[nxt] = len(number)
                subsets.append(nxt)
        steps.append([number[nxt] for nxt in row])
    bits = [sum(mark for s, mark in ends.items() if subset >> s & 1) for subset in subsets]
    # Minimisation: split blocks by where their states lead until nothing splits.
    block, count = bits, -1
    while True:
        names: dict = {}
        block = [names.setdefault((block[k], *(block[t] for t in row)), len(names)) for k, row in enumerate(steps)]
        if len(names) == count:
            break
        count = len(names)
    member = {b: k for k, b in reversed(list(enumerate(block)))}
    order = sorted(member, key=lambda b: (bool(bits[member[b]]), b != block[0]))
    place = {b: i for i, b in enumerate(order)}
    width = len(groups)
    table = [place[block[t]] * width for b in order for t in steps[member[b]]]
    classes = bytearray(256)
    for i, group in enumerate(groups):
        for b in group:
            classes[b] = i
    accepting = sum(not bits[member[b]] for b in order)
    dead = next((i * width for i in range(accepting)
                 if all(t == i * width for t in table[i * width:(i + 1) * width])), -1)
    return Automaton(bytes(classes), width, table, accepting * width,
                     {i * width: bits[member[order[i]]] for i in range(accepting, len(order))}, dead)
