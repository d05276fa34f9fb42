"""Probabilistic automata of token formats, inferred by merging prefix-tree states (ALERGIA)."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

#: Characters are seen as classes, so that a format and not a value is learned.
CLASSES = "adAx+/_.=-?"
END = "$"


def char_class(c: str) -> str:
    if c.isdigit():
        return "d"
    if "a" <= c <= "f":
        return "x"
    if c.islower():
        return "a"
    if c.isupper():
        return "A"
    return c if c in "+/_.=-" else "?"


_TABLE = {i: char_class(chr(i)) for i in range(128)}


def shape(text: str) -> str:
    return text.translate(_TABLE)


class Automaton:
    """States with transition probabilities; the probability of a string's shape is their product."""

    def __init__(self, steps: list[dict[str, tuple[float, int]]], floor: float):
        self.steps, self.floor = steps, floor

    def likelihood(self, text: str) -> float:
        """Mean log probability per character, the end included."""
        state, total = 0, 0.0
        symbols = shape(text) + END
        for symbol in symbols:
            step = self.steps[state].get(symbol) if state >= 0 else None
            if step is None:
                total += self.floor
                state = -1 if symbol == END else (state if state >= 0 else -1)
                continue
            total += step[0]
            state = step[1]
        return total / len(symbols)


class _Tree:
    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.total: list[int] = [0]

    def add(self, symbols: str) -> None:
        state = 0
        for symbol in symbols:
            self.total[state] += 1
            self.count[state][symbol] += 1
            if symbol not in self.next[state]:
                self.next[state][symbol] = len(self.next)
                self.next.append({})
                self.count.append(defaultdict(int))
                self.total.append(0)
            state = self.next[state][symbol]


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    """Hoeffding bound: are two observed shares too far apart for one probability?"""
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(texts: Iterable[str], alpha: float = 0.05, most_states: int = 250_000) -> Automaton:
    """Build the prefix tree of the shapes and merge compatible states, nearest to the root first.

    Shapes are learned whole, shorter ones first; one that could bring the tree over `most_states` is left out, unless
    it is the only one.
    """
    tree = _Tree()
    for text in sorted(texts, key=len):
        if len(tree.next) == 1 or len(tree.next) + len(text) < most_states:
            tree.add(shape(text) + END)
    into = list(range(len(tree.next)))

    def find(s: int) -> int:
        while into[s] != s:
            into[s] = into[into[s]]
            s = into[s]
        return s

    def compatible(a: int, b: int) -> bool:
        work = [(a, b)]
        while work:
            a, b = (find(s) for s in work.pop())
            if a == b:
                continue
            for symbol in {*tree.count[a], *tree.count[b]}:
                if _differ(tree.count[a].get(symbol, 0), tree.total[a], tree.count[b].get(symbol, 0), tree.total[b], alpha):
                    return False
                if symbol != END and symbol in tree.next[a] and symbol in tree.next[b]:
                    work.append((tree.next[a][symbol], tree.next[b][symbol]))
        return True

    def merge(a: int, b: int) -> None:
        work = [(a, b)]
        while work:
            a, b = (find(s) for s in work.pop())
            if a == b:
                continue
            into[b] = a
            tree.total[a] += tree.total[b]
            for symbol, n in tree.count[b].items():
                tree.count[a][symbol] += n
            for symbol, target in tree.next[b].items():
                if symbol in tree.next[a]:
                    work.append((tree.next[a][symbol], target))
                else:
                    tree.next[a][symbol] = target

    red = [0]
    blue = sorted({find(t) for s, t in tree.next[0].items() if s != END})
    while blue:
        state = blue.pop(0)
        if find(state) != state:
            continue
        match = next((r for r in red if compatible(r, state)), None)
        if match is None:
            red.append(state)
        else:
            merge(match, state)
        reds = {find(r) for r in red}
        red = sorted(reds)
        fringe = {find(t) for r in red for s, t in tree.next[r].items() if s != END}
        blue = sorted(fringe - reds)
    number = {s: k for k, s in enumerate(red)}
    steps: list[dict[str, tuple[float, int]]] = []
    size = len(CLASSES) + 1
    for s in red:
        total = tree.total[s] + 0.5 * size
        steps.append({symbol: (math.log((n + 0.5) / total), number[find(tree.next[s][symbol])] if symbol != END else 0)
                      for symbol, n in tree.count[s].items() if symbol == END or symbol in tree.next[s]})
    most = max(tree.total[s] for s in red) if red else 1
    return Automaton(steps, math.log(0.5 / (most + 0.5 * size)))
