"""A semi-Markov conditional random field over candidate segments.

A labelling is a set of candidates that don't overlap. Its score is the sum of the weights of its candidates' features,
each taken over a whole span, and of one feature for every two neighbours of the labelling that stand close together:
their kinds and what divides them. Text outside scores 0. Decoding and the sums for training are dynamic programs over
the candidates' ends, bounded by their number and by how many of them end close before another begins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from math import exp, log1p

from tidewrack.llm.pii_candidates import Candidate

#: Neighbours with at most so many characters between them share a feature.
NEAR = 16
#: Of a candidate: how many candidates end too far before it to share a feature, and the features with the next ones, in order.
Link = tuple[int, tuple[str, ...]]


def links(text: str, segments: Sequence[Candidate]) -> list[Link]:
    """The link of each of the ``segments`` (by end)."""
    ends, out = [c.end for c in segments], []
    for i, c in enumerate(segments):
        far = bisect_left(ends, c.start - NEAR, 0, i)
        near = []
        for j in range(far, bisect_right(ends, c.start, far, i)):
            between = text[ends[j] : c.start]
            how = "line" if "\n" in between else "words" if any(x.isalnum() for x in between) else "signs"
            near.append(f"{segments[j].kind}>{c.kind}:{how}")
        out.append((far, tuple(near)))
    return out


def best(segments: Sequence[Candidate], weights: dict[str, float], linked: Sequence[Link]) -> list[Candidate]:
    """The labelling of the greatest score; ``segments`` by end."""
    top, last, before = [0.0], [-1], []  # of the first i candidates the best score, the labelling's last candidate, and who comes before it
    score = []
    for i, c in enumerate(segments):
        far, near = linked[i]
        most, whom = top[far], last[far]
        for j, f in enumerate(near, far):
            s = score[j] + weights.get(f, 0.0)
            if s > most:
                most, whom = s, j
        s = most + sum([weights.get(f, 0.0) for f in c.features])
        score.append(s)
        before.append(whom)
        if s > top[-1]:
            top.append(s)
            last.append(i)
        else:
            top.append(top[-1])
            last.append(last[-1])
    out, i = [], last[-1]
    while i >= 0:
        out.append(segments[i])
        i = before[i]
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + log1p(exp(b - a)) if b > float("-inf") else a


def marginals(segments: Sequence[Candidate], weights: dict[str, float], linked: Sequence[Link]) -> tuple[list[float], list[list[float]]]:
    """The probability of each candidate, and of each two that are linked to be neighbours in the labelling."""
    n = len(segments)
    own = [sum([weights.get(f, 0.0) for f in c.features]) for c in segments]
    pair = [[weights.get(f, 0.0) for f in near] for _, near in linked]
    fore, total = [], [0.0]  # labellings that end with a candidate; all labellings of the first i candidates
    for i in range(n):
        far = linked[i][0]
        a = total[far]
        for j, w in enumerate(pair[i], far):
            a = _log_add(a, fore[j] + w)
        fore.append(a + own[i])
        total.append(_log_add(total[-1], fore[i]))
    # what may follow: after[k] sums the candidates that k candidates lie far before, so whoever is among these k may precede them
    after, rest = [float("-inf")] * (n + 1), [0.0] * n
    open_ = float("-inf")
    linked_by: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    by_far: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        by_far[linked[i][0]].append(i)
        for j, w in enumerate(pair[i], linked[i][0]):
            linked_by[j].append((i, w))
    for j in range(n - 1, -1, -1):
        for i in by_far[j + 1]:
            open_ = _log_add(open_, own[i] + rest[i])
        after[j + 1] = open_
        r = _log_add(0.0, open_)
        for i, w in linked_by[j]:
            r = _log_add(r, w + own[i] + rest[i])
        rest[j] = r
    z = total[n]
    single = [exp(fore[i] + rest[i] - z) for i in range(n)]
    double = [[exp(fore[j] + w + own[i] + rest[i] - z) for j, w in enumerate(pair[i], linked[i][0])] for i in range(n)]
    return single, double


def fit(examples: Sequence[tuple[str, Sequence[Candidate], set[Candidate]]], rounds: int = 150, rate: float = 0.5, ridge: float = 0.002) -> dict[str, float]:
    """Weights of the greatest penalised likelihood of (text, candidates, right candidates), by gradient ascent with per-feature steps.

    Examples that look alike to the model are weighed together.
    """
    alike: dict[tuple, list] = {}
    for text, segments, right in examples:
        linked = links(text, segments)
        key = (tuple(c.features for c in segments), tuple(c in right for c in segments), tuple(linked))
        alike.setdefault(key, [0, segments, linked, right])[0] += 1
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(rounds):
        gradient: dict[str, float] = {}
        for n, segments, linked, right in alike.values():
            single, double = marginals(segments, weights, linked)
            chosen = [i for i, c in enumerate(segments) if c in right]
            neighbours = set(zip(chosen, chosen[1:], strict=False))
            for i, c in enumerate(segments):
                g = n * ((c in right) - single[i])
                if abs(g) > 1e-6:
                    for f in c.features:
                        gradient[f] = gradient.get(f, 0.0) + g
                for j, (f, p) in enumerate(zip(linked[i][1], double[i], strict=True), linked[i][0]):
                    gradient[f] = gradient.get(f, 0.0) + n * (((j, i) in neighbours) - p)
        for f, g in gradient.items():
            g -= ridge * len(examples) * weights.get(f, 0.0)
            squares[f] = squares.get(f, 0.0) + g * g
            weights[f] = weights.get(f, 0.0) + rate * g / (squares[f] ** 0.5 + 1e-9)
    return weights
