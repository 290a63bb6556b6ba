"""Probabilistic automata inferred from strings by merging prefix-tree states."""

from __future__ import annotations

import math


class Automaton:
    """Deterministic probabilistic automaton.  ``moves[state][symbol]`` is
    (next state, count); ``ends[state]`` counts strings that end there."""

    def __init__(self, strings):
        self.moves: list[dict] = [{}]
        self.ends: list[int] = [0]
        for s in strings:
            at = 0
            for symbol in s:
                nxt, n = self.moves[at].get(symbol, (None, 0))
                if nxt is None:
                    nxt = len(self.moves)
                    self.moves.append({})
                    self.ends.append(0)
                self.moves[at][symbol] = (nxt, n + 1)
                at = nxt
            self.ends[at] += 1

    def arrivals(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.moves[state].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """No frequency below ``a`` differs from that below ``b`` by more than
        Hoeffding's bound allows at level ``alpha``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.arrivals(a), self.arrivals(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for symbol in self.moves[a].keys() | self.moves[b].keys():
                to_a, f = self.moves[a].get(symbol, (None, 0))
                to_b, g = self.moves[b].get(symbol, (None, 0))
                if abs(f / n - g / m) > bound:
                    return False
                if to_a is not None and to_b is not None and to_a != to_b:
                    todo.append((to_a, to_b))
        return True

    def fold(self, into: int, state: int) -> None:
        """Add the counts of the tree below ``state`` to ``into``."""
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.ends[into] += self.ends[state]
            for symbol, (to, n) in self.moves[state].items():
                known, m = self.moves[into].get(symbol, (None, 0))
                if known is None:
                    self.moves[into][symbol] = (to, n)
                else:
                    self.moves[into][symbol] = (known, m + n)
                    todo.append((known, to))

    def alike(self, a: int, b: int, floor: float) -> float:
        """Mean log likelihood of what follows ``b`` under what follows ``a``."""
        todo, total, n_all = [(a, b)], 0.0, 0
        while todo and n_all < 400:
            a, b = todo.pop()
            n = self.arrivals(a)
            if self.ends[b]:
                total += self.ends[b] * math.log((self.ends[a] or floor) / (n + 1))
                n_all += self.ends[b]
            for symbol, (to_b, g) in self.moves[b].items():
                to_a, f = self.moves[a].get(symbol, (None, floor))
                total += g * math.log(f / (n + 1))
                n_all += g
                if to_a is not None and to_a != to_b:
                    todo.append((to_a, to_b))
        return total / max(n_all, 1)

    def merged(self, alpha: float) -> "Automaton":
        """Merge each state, the most frequent first, with the compatible one settled
        before it under which its strings are likeliest.  A state may merge with its
        own ancestor, so runs of any length become loops."""
        settled, seen = [0], {0}
        while True:
            fringe = [(-n, r, s) for r in settled for s, (to, n) in self.moves[r].items() if to not in seen]
            if not fringe:
                return self
            _, parent, symbol = min(fringe)
            state, n = self.moves[parent][symbol]
            fits = [o for o in settled if self.compatible(o, state, alpha)]
            if fits:
                other = max(fits, key=lambda o: self.alike(o, state, 0.05))
                self.moves[parent][symbol] = (other, n)
                self.fold(other, state)
            else:
                settled.append(state)
                seen.add(state)

    def table(self, floor: float) -> list[tuple[dict, float]]:
        """Per state: symbol to (next state, log probability), and the log
        probability of a symbol never seen there."""
        out = []
        for state, moves in enumerate(self.moves):
            n = self.arrivals(state)
            out.append(({s: (to, math.log(c / n)) for s, (to, c) in moves.items()}, math.log(floor / (n + 1))))
        return out

    def end_table(self, floor: float) -> list[float]:
        """Per state: log probability that a string ends there."""
        return [math.log(e / n if e else floor / (n + 1)) for e, n in ((e, self.arrivals(s)) for s, e in enumerate(self.ends))]

    def reachable(self) -> "Automaton":
        """The same automaton without the states that merging left behind."""
        order, number = [0], {0: 0}
        for state in order:
            for to, _ in self.moves[state].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
        moves = [{s: (number[to], n) for s, (to, n) in self.moves[state].items()} for state in order]
        self.ends, self.moves = [self.ends[state] for state in order], moves
        return self


def likelihood(table, text: str, least: float = -math.inf, ends: list[float] | None = None) -> float:
    """Log likelihood of the symbols of ``text``, and with ``ends`` of its end after
    them; -inf once it is under ``least``."""
    at, total = 0, 0.0
    for symbol in text:
        moves, unseen = table[at]
        at, p = moves.get(symbol, (at, unseen))
        total += p
        if total < least:
            return -math.inf
    return total + ends[at] if ends else total
