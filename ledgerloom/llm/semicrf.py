"""A semi-Markov conditional random field over candidate segments of a short text.

A labelling is a set of non-overlapping segments, each with a type; characters outside of segments carry no label. Its
score is the sum, over its segments, of the weights of the segment's features under its type and of the step from the
type of the segment before. Segments are bounded by what the caller offers as candidates, so both sums over all
labellings (training) and the best labelling (decoding) are one sweep over the sorted segment bounds.
"""

from __future__ import annotations

from collections import defaultdict
from math import exp, log

#: A candidate: start, end, its features, the types that it may have.
Candidate = tuple[int, int, tuple[str, ...], tuple[int, ...]]


def _add(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b))) if a > -1e30 and b > -1e30 else max(a, b)


class SemiCRF:
    def __init__(self, types: int) -> None:
        self.types = types  # type numbers are 0 to types - 1; state ``types`` is the start
        self.weights: dict[tuple[str, int], float] = {}
        self.steps = [[0.0] * types for _ in range(types + 1)]

    def _scored(self, candidates: list[Candidate]) -> list[tuple[int, int, int, float, int]]:
        """(start bound, end bound, type, score, candidate) by end, with bounds numbered in order."""
        bounds = sorted({x for c in candidates for x in c[:2]})
        number, get = {x: i for i, x in enumerate(bounds)}, self.weights.get
        arcs = [(number[a], number[b], t, sum(get((f, t), 0.0) for f in features), i) for i, (a, b, features, types) in enumerate(candidates) for t in types]
        return sorted(arcs, key=lambda x: x[1])

    def decode(self, candidates: list[Candidate]) -> list[tuple[int, int, int]]:
        """The best labelling: (start, end, type)."""
        arcs = self._scored(candidates)
        if not arcs:
            return []
        none = -1e300
        best = [[none] * self.types + [0.0]]
        back: list[list] = [[None] * (self.types + 1)]
        at = 0
        for bound in range(1, arcs[-1][1] + 1):
            row, from_ = best[-1][:], [(bound - 1, s, None) for s in range(self.types + 1)]
            while at < len(arcs) and arcs[at][1] == bound:
                a, _, t, score, i = arcs[at]
                for s in range(self.types + 1):
                    if best[a][s] > none and (v := best[a][s] + (self.steps[s][t] + score)) > row[t]:
                        row[t], from_[t] = v, (a, s, i)
                at += 1
            best.append(row)
            back.append(from_)
        bound, state = len(best) - 1, max(range(self.types + 1), key=best[-1].__getitem__)
        found = []
        while bound:
            before, came, i = back[bound][state]
            if i is not None:
                found.append((candidates[i][0], candidates[i][1], state))
            bound, state = before, came
        return found[::-1]

    def gradient(self, candidates: list[Candidate], gold: set[tuple[int, int, int]]) -> tuple[float, dict, dict]:
        """Log-likelihood of the gold labelling, and its gradient by (feature, type) and by (state, type)."""
        arcs, none = self._scored(candidates), -1e300
        if not arcs:
            return 0.0, {}, {}
        last, states = arcs[-1][1], range(self.types + 1)
        alpha, at = [[none] * self.types + [0.0]], 0
        for bound in range(1, last + 1):
            row = alpha[-1][:]
            while at < len(arcs) and arcs[at][1] == bound:
                a, _, t, score, _ = arcs[at]
                for s in states:
                    if alpha[a][s] > none:
                        row[t] = _add(row[t], alpha[a][s] + self.steps[s][t] + score)
                at += 1
            alpha.append(row)
        total = none
        for v in alpha[-1]:
            total = _add(total, v)
        beta = [[none] * (self.types + 1) for _ in range(last)] + [[0.0] * (self.types + 1)]
        by_start = defaultdict(list)
        for arc in arcs:
            by_start[arc[0]].append(arc)
        by_feature, by_step = defaultdict(float), defaultdict(float)
        for bound in range(last - 1, -1, -1):
            row = beta[bound + 1][:]
            for _, b, t, score, i in by_start[bound]:
                for s in states:
                    arc = self.steps[s][t] + score + beta[b][t]
                    row[s] = _add(row[s], arc)
                    if alpha[bound][s] > none:
                        p = exp(min(0.0, alpha[bound][s] + arc - total))
                        if p > 1e-6:
                            by_step[s, t] -= p
                            for f in candidates[i][2]:
                                by_feature[f, t] -= p
            beta[bound] = row
        value, state = 0.0, self.types
        offered = {(a, b, t): f for a, b, f, types in candidates for t in types}
        for a, b, t in sorted(gold & offered.keys()):
            value += self.steps[state][t] + sum(self.weights.get((f, t), 0.0) for f in offered[a, b, t])
            by_step[state, t] += 1
            for f in offered[a, b, t]:
                by_feature[f, t] += 1
            state = t
        return value - total, by_feature, by_step

    def fit(self, examples: list[tuple[list[Candidate], set]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> SemiCRF:
        """Adagrad ascent on the log-likelihood, an example at a time, in the given order."""
        past = defaultdict(lambda: 1e-2)
        for _ in range(epochs):
            for candidates, gold in examples:
                _, by_feature, by_step = self.gradient(candidates, gold)
                for key, g in by_feature.items():
                    g -= decay * self.weights.get(key, 0.0)
                    past[key] += g * g
                    self.weights[key] = self.weights.get(key, 0.0) + rate * g / past[key] ** 0.5
                for (s, t), g in by_step.items():
                    past["step", s, t] += g * g
                    self.steps[s][t] += rate * g / past["step", s, t] ** 0.5
        return self
