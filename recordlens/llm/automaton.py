"""Regular expressions compiled to one deterministic automaton over bytes.

A small grammar (literals, escapes, classes, groups, ``|``, ``? * + {m} {m,} {m,n}``) is parsed to a
non-deterministic automaton for each rule, made deterministic by subset construction, started anew at every
byte outside a match, and minimised by Moore's partition refinement. The rules' automata run side by side as one:
its states are the combinations that occur, its transitions a flat array by state and byte class, read in
one pass whatever the number of rules. It is minimal since the rules' own automata are.

In a state that accepts a rule the text read so far ends in a match of it, and a match goes on as long as
that rule stays accepted. So a change of the accepted rules is where a match first ends, or where its longest
end was. Its start is found by the reversed rule, read backwards from the first end.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """Builds a Thompson automaton: edges[s] is a list of (set of bytes or None for empty, target)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def parse(self) -> tuple[int, int]:
        start, end = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return start, end

    def alternatives(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.edges[start].append((None, a))
            self.edges[b].append((None, end))
            if self.i >= len(self.p) or self.p[self.i] != "|":
                return start, end
            self.i += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            begin = self.i
            a, b = self.atom()
            low, high = self.count()
            after = self.i
            if (low, high) != (1, 1):
                a = b = self.state()
                for n in range(high if high is not None else max(low, 1)):
                    self.i = begin
                    c, d = self.atom()
                    self.edges[b].append((None, c))
                    if n >= low:
                        skip = self.state()
                        self.edges[b].append((None, skip))
                        self.edges[d].append((None, skip))
                        d = skip
                    if high is None and n == max(low, 1) - 1:
                        self.edges[d].append((None, c))
                        if low == 0:
                            self.edges[b].append((None, d))
                    b = d
                self.i = after
            self.edges[end].append((None, a))
            end = b
        return start, end

    def count(self) -> tuple[int, int | None]:
        c = self.p[self.i] if self.i < len(self.p) else ""
        if c and c in "?*+":
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            close = self.p.index("}", self.i)
            low, comma, high = self.p[self.i + 1 : close].partition(",")
            self.i = close + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            inside = self.alternatives()
            if self.i >= len(self.p) or self.p[self.i] != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return inside
        if c == "[":
            close = self.i + 1
            while self.p[close] != "]" or self.p[close - 1] == "\\":
                close += 1
            found, self.i = self.members(self.p[self.i : close]), close + 1
        elif c == "\\":
            found = frozenset([self.escape()])
        elif c == ".":
            found = frozenset(range(256)) - {10}
        else:
            found = frozenset(c.encode())
            if len(found) > 1:
                raise ValueError("only ASCII literals are supported")
        if self.fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        a, b = self.state(), self.state()
        self.edges[a].append((frozenset(found), b))
        return a, b

    def escape(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return _ESCAPES.get(c, ord(c))

    def members(self, body: str) -> frozenset:
        codes, i = [], 0
        while i < len(body):
            plain = body[i] != "\\"
            if plain:
                code, i = ord(body[i]), i + 1
            elif body[i + 1] == "x":
                code, i = int(body[i + 2 : i + 4], 16), i + 4
            else:
                code, i = _ESCAPES.get(body[i + 1], ord(body[i + 1])), i + 2
            codes.append((code, plain))
        out, i = set(), 0
        while i < len(codes):
            if i + 2 < len(codes) and codes[i + 1] == (ord("-"), True):
                out.update(range(codes[i][0], codes[i + 2][0] + 1))
                i += 3
            else:
                out.add(codes[i][0])
                i += 1
        return frozenset(out)


def _closure(edges, states: frozenset) -> frozenset:
    todo, seen = list(states), set(states)
    while todo:
        for on, to in edges[todo.pop()]:
            if on is None and to not in seen:
                seen.add(to)
                todo.append(to)
    return frozenset(seen)


def _byte_classes(edges) -> tuple[np.ndarray, list[int]]:
    """The class of each byte, and one byte of each class: bytes of a class are in the same sets."""
    sets = list({on for out in edges for on, _ in out if on is not None})
    seen: dict[tuple, int] = {}
    of = np.zeros(256, np.uint8)
    for b in range(256):
        of[b] = seen.setdefault(tuple(b in s for s in sets), len(seen))
    return of, [int(np.flatnonzero(of == c)[0]) for c in range(len(seen))]


def _minimise(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge states that accept alike and lead to merged states by every class.

    Returns the merged table, what its states accept, and the state that the old state 0 became.
    """
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first, block = np.unique(block, return_index=True, return_inverse=True)
    block = block.ravel()
    return block[table[first]], accepts[first], int(block[0])


def _subsets(start, step, classes: int) -> tuple[np.ndarray, list]:
    """The subset construction: transitions by state number and class, and the states in order; 0 is ``start``."""
    numbers, order, rows = {start: 0}, [start], []
    for state in order:
        row = []
        for c in range(classes):
            then = step(state, c)
            if then not in numbers:
                numbers[then] = len(order)
                order.append(then)
            row.append(numbers[then])
        rows.append(row)
    return np.array(rows, np.int64), order


class _Compiled:
    """One rule: ``table`` and ``accepts`` read forwards, ``back`` and ``begins`` backwards from an end.

    The leftmost match must be the first to end, and a match must be accepted from its first end to its longest: both
    hold for a prefix of fixed order that a run of one class, or nothing, follows. The second is checked here.
    """

    def __init__(self, edges, start: int, end: int, sample: list[int], pattern: str):
        moves = [[[to for on, to in out if on is not None and b in on] for b in sample] for out in edges]
        closed = [_closure(edges, frozenset([s])) for s in range(len(edges))]
        fresh = closed[start]
        union = lambda states: frozenset().union(*(closed[s] for s in states))

        def step(state, c):
            held, accepting = state
            reached = {to for s in held for to in moves[s][c]}
            hits = {s for s in reached if end in closed[s]}
            if hits:  # of the attempts under way only this one goes on: others would overlap it
                return union(hits), True
            if accepting:
                if reached:
                    raise ValueError(f"a match of {pattern!r} can go on past its end without being one")
                reached = {to for s in fresh for to in moves[s][c]}
                if any(end in closed[s] for s in reached):
                    raise ValueError(f"two matches of {pattern!r} can touch unseen")
            return union(reached) | fresh, False

        def attempt(held, c):
            reached = {to for s in held for to in moves[s][c]}
            if any(end in closed[s] for s in reached) and any(end not in closed[s] for s in reached):
                raise ValueError(f"a match of {pattern!r} can end while a longer one is open")
            return union(reached)

        if end in fresh:
            raise ValueError(f"{pattern!r} matches the empty text")
        _subsets(fresh, attempt, len(sample))
        table, order = _subsets((fresh, False), step, len(sample))
        self.table, self.accepts, self.start = _minimise(table, np.array([a for _, a in order], np.int64))
        into: list[list] = [[] for _ in edges]
        for s, out in enumerate(edges):
            for on, to in out:
                into[to].append((on, s))
        moves_back = [[[to for on, to in out if on is not None and b in on] for b in sample] for out in into]
        closed_back = [_closure(into, frozenset([s])) for s in range(len(edges))]
        back, order = _subsets(closed_back[end], lambda held, c: frozenset().union(*(closed_back[to] for s in held for to in moves_back[s][c])), len(sample))
        self.back, self.begins = back.tolist(), [start in held for held in order]
        self.dead = order.index(frozenset()) if frozenset() in order else -1

    def begin(self, classes: bytes, end: int, least: int) -> int:
        """The first place, not before ``least``, from which the bytes up to ``end`` are a match."""
        state, found = 0, end
        for i in range(end - 1, least - 1, -1):
            state = self.back[state][classes[i]]
            if state == self.dead:
                break
            if self.begins[state]:
                found = i
        return found


class Automaton:
    """All rules in one: ``scan`` gives the leftmost, longest, non-overlapping matches of each rule."""

    def __init__(self, rules: list[tuple[str, bool]]):
        parsed = []
        for pattern, fold in rules:
            parser = _Parser(pattern, fold)
            parsed.append((parser.parse(), parser.edges, pattern))
        classes, sample = _byte_classes([out for _, edges, _ in parsed for out in edges])
        self.rules = [_Compiled(edges, a, b, sample, pattern) for (a, b), edges, pattern in parsed]
        sizes = [len(r.table) for r in self.rules]
        weight = np.cumprod([1, *sizes[:-1]])
        seen = np.array([sum(r.start * int(w) for r, w in zip(self.rules, weight, strict=True))], np.int64)
        codes, rows, new = [seen], [], seen
        while len(new):
            then = sum(r.table[new // w % n] * w for r, w, n in zip(self.rules, weight, sizes, strict=True))
            rows.append(then)
            new = np.setdiff1d(then, seen)
            seen = np.union1d(seen, new)
            codes.append(new)
        order, rows = np.concatenate(codes[:-1]), np.concatenate(rows)
        accepts = sum(r.accepts[order // w % n] << k for k, (r, w, n) in enumerate(zip(self.rules, weight, sizes, strict=True)))
        # States that accept nothing come first, so that one comparison tells them from the others.
        by_noise = np.argsort(accepts != 0, kind="stable")
        place = np.empty(len(order), np.int64)
        place[by_noise] = np.arange(len(order))
        sorter = np.argsort(order)
        numbers = place[sorter[np.searchsorted(order, rows, sorter=sorter)]]
        self.states, self.width = len(order), len(sample)
        self.floor = int((accepts == 0).sum()) * self.width
        self.start = int(place[0]) * self.width
        interned: dict[int, int] = {}
        self.next = [interned.setdefault(x, x) for x in (numbers[by_noise] * self.width).ravel().tolist()]
        self.mask = accepts[by_noise].tolist()
        self.classes = classes.tobytes()

    def scan(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(start, rule, end, first end) of every match, in bytes, ordered by start and then rule."""
        data = data.translate(self.classes)
        nxt, s, floor, width, on = self.next, self.start, self.floor, self.width, 0
        first, last, found = [0] * len(self.rules), [0] * len(self.rules), []

        def ended(rules: int, i: int) -> None:
            for k, rule in enumerate(self.rules):
                if rules >> k & 1:
                    found.append((rule.begin(data, first[k], last[k]), k, i, first[k]))
                    last[k] = i

        for i, c in enumerate(data):
            s = nxt[s + c]
            if s >= floor or on:
                now = self.mask[s // width]
                if now != on:
                    ended(on & ~now, i)
                    for k in range(len(first)):
                        if (now & ~on) >> k & 1:
                            first[k] = i + 1
                    on = now
        ended(on, len(data))
        return sorted(found)


@lru_cache(maxsize=8)
def compiled(rules: tuple[tuple[str, bool], ...]) -> Automaton:
    return Automaton(list(rules))
