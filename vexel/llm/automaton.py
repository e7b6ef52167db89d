"""A small regular-expression compiler: Thompson construction over bytes, subset construction, minimisation, flat tables.

Grammar: literals, ``\\xHH`` and escaped characters, classes with ranges, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``, ``{n,m}``.
"""

from __future__ import annotations

ANY = (1 << 256) - 1


class _Parser:
    """Builds a tree: ("set", mask) | ("cat", [..]) | ("alt", [..]) | ("rep", node, low, high or None)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.at, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.p[self.at] if self.at < len(self.p) else ""

    def take(self) -> str:
        c = self.p[self.at]
        self.at += 1
        return c

    def alt(self):
        options = [self.cat()]
        while self.peek() == "|":
            self.take()
            options.append(self.cat())
        return options[0] if len(options) == 1 else ("alt", options)

    def cat(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("cat", items)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                body = ""
                while (x := self.take()) != "}":
                    body += x
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), int(high) if high else (None if comma else int(low)))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.at):
                self.at += 2
            node = self.alt()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.p!r}")
            return node
        if c == "[":
            return ("set", self.char_class())
        return ("set", self.folded(1 << self.escaped(c)))

    def escaped(self, c: str) -> int:
        if c != "\\":
            if ord(c) > 127:
                raise ValueError("only ASCII characters stand in rules")
            return ord(c)
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            raise ValueError(f"unknown escape \\{c}")
        return ord(c)

    def folded(self, mask: int) -> int:
        if self.fold:
            for i in range(26):
                pair = 1 << (65 + i) | 1 << (97 + i)
                if mask & pair:
                    mask |= pair
        return mask

    def char_class(self) -> int:
        negated = self.peek() == "^"
        if negated:
            self.take()
        mask, first = 0, True
        while first or self.peek() != "]":
            first = False
            low = self.escaped(self.take())
            if self.peek() == "-" and self.p[self.at + 1] != "]":
                self.take()
                for x in range(low, self.escaped(self.take()) + 1):
                    mask |= 1 << x
            else:
                mask |= 1 << low
        self.take()
        mask = self.folded(mask)
        return ANY ^ mask if negated else mask


def parse(pattern: str, ignore_case: bool = False):
    p = _Parser(pattern, ignore_case)
    node = p.alt()
    if p.at != len(pattern):
        raise ValueError(f"unbalanced group in {pattern!r}")
    return node


def reverse(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    if kind == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    return node


def earliest(node):
    """The same places of first acceptance with fewer states: an open repetition at the end stops at its least count."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], earliest(node[1][-1])])
    if node[0] == "rep" and node[2] > 0:
        return ("rep", node[1], node[2], node[2])
    return node


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.step: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Add ``node`` after ``start``; its end state."""
        kind = node[0]
        if kind == "set":
            a, b = self.state(), self.state()
            self.free[start].append(a)
            self.step[a] = (node[1], b)
            return b
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        end = self.state()
        if kind == "alt":
            for x in node[1]:
                s = self.state()
                self.free[start].append(s)
                self.free[self.add(x, s)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        self.free[start].append(end)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            back = self.add(inner, loop)
            self.free[back] += [loop, end]
        else:
            for _ in range(high - low):
                start = self.add(inner, start)
                self.free[start].append(end)
        return end


class Dfa:
    """``table[state + class]`` is the next state; a state's number is a multiple of ``width``, the number of byte classes.

    ``classes`` translates bytes to classes. States from ``accepting`` on accept; ``rules[state // width]`` are bits. State 0
    is the start. ``dead`` is the state from which nothing accepts, or negative.
    """

    def __init__(self, rows: list[list[int]], classes: list[int], accepting: int, rules: list[int], dead: int):
        self.width = len(rows[0])
        states = [i * self.width for i in range(len(rows))]  # one object for each state keeps the table in the cache
        self.table = [states[t] for row in rows for t in row]
        self.classes = bytes(classes)
        self.accepting, self.rules, self.dead = accepting * self.width, rules, dead * self.width


def compile_rules(nodes: list, anywhere: bool) -> Dfa:
    """One automaton for all ``nodes``; rule i has bit i. ``anywhere``: matches may start at each byte."""
    nfa = _Nfa()
    start = nfa.state()
    accept = {}
    for i, node in enumerate(nodes):
        s = nfa.state()
        nfa.free[start].append(s)
        accept[nfa.add(node, s)] = 1 << i

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for y in nfa.free[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(x for x in seen if nfa.step[x] or x in accept)

    # Bytes that no rule tells apart form one class.
    signature: dict[tuple, int] = {}
    masks = sorted({s[0] for s in nfa.step if s})
    class_of = [signature.setdefault(tuple(m >> b & 1 for m in masks), len(signature)) for b in range(256)]
    sample = {c: b for b, c in reversed(list(enumerate(class_of)))}
    n_class = len(signature)

    first = closure([start])
    number, order, moves = {first: 0}, [first], []
    for at in order:  # grows
        row = []
        for c in range(n_class):
            to = {nfa.step[x][1] for x in at if nfa.step[x] and nfa.step[x][0] >> sample[c] & 1}
            nxt = closure(to) | (first if anywhere else frozenset())
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        moves.append(row)
    bits = [sum({accept[x] for x in s if x in accept}) for s in order]

    # Moore's refinement: split groups until their states move alike.
    group = [sorted(set(bits)).index(b) for b in bits]
    while True:
        seen: dict[tuple, int] = {}
        nxt = [seen.setdefault((group[s], *(group[t] for t in moves[s])), len(seen)) for s in range(len(order))]
        if len(seen) == len(set(group)):
            break
        group = nxt
    by_group = {g: s for s, g in reversed(list(enumerate(group)))}
    # The start comes first, accepting states last (the start may not accept: rules match no empty text).
    ranked = sorted(by_group, key=lambda g: (bool(bits[by_group[g]]), g != group[0], g))
    place = {g: i for i, g in enumerate(ranked)}
    if bits[0]:
        raise ValueError("a rule matches the empty text")
    rows, rules, dead = [], [], -1
    for g in ranked:
        s = by_group[g]
        rows.append([place[group[t]] for t in moves[s]])
        if not bits[s] and all(x == place[g] for x in rows[-1]):
            dead = place[g]
        rules.append(bits[s])
    return Dfa(rows, class_of, sum(not r for r in rules), rules, dead)
