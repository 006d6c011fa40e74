"""Probabilistic automata inferred from sample strings by merging compatible states of their prefix tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log, sqrt

#: Classes of characters; a class spreads its probability evenly over its members.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_", ".", "=", "-")
CODE = {c: i for i, members in enumerate(CLASSES) for c in members}
_SPREAD = [log(len(members)) for members in CLASSES]
#: Probability left for a symbol or an end that a state has never seen.
RARE = 1e-4


@dataclass
class State:
    count: int = 0
    ends: int = 0
    next: dict[int, int] = field(default_factory=dict)
    passes: dict[int, int] = field(default_factory=dict)


class Automaton:
    """Inferred from strings over CLASSES. `alpha` bounds the chance that a merge of equal states is refused."""

    def __init__(self, samples: list[str], alpha: float = 0.01):
        self.states = [State()]
        self._width = sqrt(0.5 * log(2 / alpha))
        for sample in samples:
            at = 0
            for code in map(CODE.__getitem__, sample):
                state = self.states[at]
                state.count += 1
                state.passes[code] = state.passes.get(code, 0) + 1
                if code not in state.next:
                    state.next[code] = len(self.states)
                    self.states.append(State())
                at = state.next[code]
            self.states[at].count += 1
            self.states[at].ends += 1
        self._merge_states()
        self.table = [
            (
                {c: (n, log(self.states[i].passes[c] / self.states[i].count) - _SPREAD[c]) for c, n in self.states[i].next.items()},
                log(max(self.states[i].ends / self.states[i].count, RARE)) if self.states[i].count else log(RARE),
            )
            for i in range(len(self.states))
        ]

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        """Hoeffding's bound: frequencies a/n and b/m are too far apart to be of one state."""
        return n > 0 and m > 0 and abs(a / n - b / m) > self._width * (1 / sqrt(n) + 1 / sqrt(m))

    def _compatible(self, red: int, blue: int) -> bool:
        waiting = [(red, blue)]
        while waiting:
            p, q = (self.states[x] for x in waiting.pop())
            if self._differ(p.ends, p.count, q.ends, q.count):
                return False
            for code in q.passes:
                if self._differ(p.passes.get(code, 0), p.count, q.passes[code], q.count):
                    return False
                if code in p.next:
                    waiting.append((p.next[code], q.next[code]))
            if any(self._differ(p.passes[c], p.count, 0, q.count) for c in p.passes.keys() - q.passes.keys()):
                return False
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below `blue` to `red`."""
        waiting = [(red, blue)]
        while waiting:
            into, taken = waiting.pop()
            p, q = self.states[into], self.states[taken]
            p.count += q.count
            p.ends += q.ends
            for code, child in q.next.items():
                p.passes[code] = p.passes.get(code, 0) + q.passes[code]
                if code in p.next:
                    waiting.append((p.next[code], child))
                else:
                    p.next[code] = child

    def _merge_states(self) -> None:
        """Red states are final; the children of red states are merged into one of them, or turn red, most frequent first."""
        red = [0]
        while True:
            blue = [(r, c, n) for r in red for c, n in self.states[r].next.items() if n not in red]
            if not blue:
                break
            parent, code, child = max(blue, key=lambda x: self.states[x[2]].count)
            home = next((r for r in red if self._compatible(r, child)), None)
            if home is None:
                red.append(child)
            else:
                self.states[parent].next[code] = home
                self._fold(home, child)
        place = {r: i for i, r in enumerate(red)}
        self.states = [self.states[r] for r in red]
        for state in self.states:
            state.next = {c: place[n] for c, n in state.next.items()}

    def log_likelihood(self, text: str) -> float:
        """Log of the probability of one string; an unseen symbol costs RARE and leads back to the start."""
        at, total, table = 0, 0.0, self.table
        for char in text:
            code = CODE[char]
            step = table[at][0].get(code)
            if step is None:
                total += log(RARE) - _SPREAD[code]
                at = 0
            else:
                at, value = step
                total += value
        return total + table[at][1]
