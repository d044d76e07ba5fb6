"""A small causal self-attention model over subword classes, in numpy: forward, gradients and training steps.

A text is a sequence of classes with its end; the model's positions are runs of classes, each run ending with a class
that ends a word (``stops``). A position's input is the mean embedding of the run before it (a start before the first).
Positions stand in blocks of ``BLOCK``: the queries of a block attend, masked, to the block's own earlier positions and
to the whole block before it, so windows of two blocks overlap by one and each class is predicted once. From a
position's hidden state and the class before it in its run, a softmax gives the weights of ``EXPERTS`` distributions
over all classes; a class's probability is their mixture. All parts learn by gradient steps but the distributions: they
are expected counts (a step of expectation maximisation in each batch), so no prediction has to normalise over classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BLOCK, WIDTH, EXPERTS, CLASSES = 8, 16, 32, 4096
END, START = CLASSES - 1, CLASSES
FLOOR = np.float32(0.02)  # of every distribution is the plain share of the class
_BACK = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # how far back a key lies
_SEEN = _BACK >= 0
_ONES = np.ones(EXPERTS, np.float32)
Q, K, V, OWN = (slice(i * WIDTH, (i + 1) * WIDTH) for i in range(4))
Params = dict[str, np.ndarray]


def start(counts: np.ndarray, seed: int = 5) -> Params:
    """Parameters before training, from the classes' counts."""
    rng, size = np.random.default_rng(seed), len(counts)
    small = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    share = ((counts + 0.5) / (counts + 0.5).sum()).astype(np.float32)
    expert = share[:, None] * np.exp(small(2.0, size, EXPERTS))
    return {
        "embed": small(0.5, size + 1, WIDTH), "inner": small(0.25, WIDTH, 4 * WIDTH), "inner_bias": small(0.1, 4 * WIDTH), "back": (-0.1 * np.arange(2 * BLOCK)).astype(np.float32),
        "gate": small(0.25, WIDTH, EXPERTS), "gate_bias": np.zeros(EXPERTS, np.float32), "before": small(1.0, size + 1, EXPERTS),
        "share": share, "expert": expert / expert.sum(axis=0),
    }


def flat(p: Params) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def shaped(values: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for name, x in like.items():
        out[name] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


class Depths:
    """The classes of some runs, all first ones before all second ones and so on, so that the k-th classes of all runs are rows in a row.

    Runs stand from the longest to the shortest (``order``); ``sizes`` says how many have a k-th class, ``places`` where.
    """

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        most = int(lengths.max(initial=0))
        self.order = np.argsort((most - lengths).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")  # 16 bits are sorted by their digits
        self.sizes = (len(lengths) - np.cumsum(np.bincount(lengths, minlength=1)))[:most].tolist()
        first = starts.take(self.order)
        self.places = np.concatenate([first[:n] + k for k, n in enumerate(self.sizes)]) if most else first

    def parts(self) -> Iterator[tuple[int, int, int]]:
        """Of the classes after the first ones: begin, end and number of the runs."""
        at = len(self.order)
        for n in self.sizes[1:]:
            yield at, at + n, n
            at += n

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Sum of each run's rows, in the memory of the first ones."""
        out = rows[: len(self.order)]
        for a, b, n in self.parts():
            out[:n] += rows[a:b]
        return out

    def runs(self) -> np.ndarray:
        """Of each class, its run's place in ``order``."""
        return np.concatenate([np.arange(n) for n in self.sizes]) if self.sizes else np.zeros(0, np.int64)


def _total(rows: np.ndarray) -> np.ndarray:
    """Sum of the rows."""
    return np.ones(len(rows), np.float32) @ rows


class Grid:
    """Texts (class arrays with their ends) laid out as positions in blocks."""

    def __init__(self, texts: list[np.ndarray], stops: np.ndarray) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = np.concatenate(texts)
        self.classes = joined.astype(np.intp)  # as indices are looked up
        ends = stops[joined]
        text_ends = np.cumsum(sizes) - 1
        ends[text_ends] = True  # a piece of a long text may end within a word
        last = np.flatnonzero(ends)  # the last class of each run
        self.runs = np.concatenate(([0], last[:-1] + 1))
        length = np.diff(np.append(self.runs, len(joined)))
        runs_so_far = np.searchsorted(last, text_ends, "right")
        per_text = np.diff(np.concatenate(([0], runs_so_far)))
        blocks = -(-per_text // BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        self.total, self.first = int(blocks.sum()), np.zeros(int(blocks.sum()), bool)
        self.first[first] = True
        self.place = np.arange(len(last)) + np.repeat(first * BLOCK - np.concatenate(([0], runs_so_far[:-1])), per_text)  # position of each run
        self.length = length
        self.ends_text = np.zeros(len(last), bool)
        self.ends_text[runs_so_far - 1] = True

    def batches(self, tokens: int) -> Iterator[tuple[int, int]]:
        """Ranges of blocks with about so many classes each."""
        starts = np.searchsorted(self.place, np.arange(self.total) * BLOCK)
        offsets, a = self.runs[np.minimum(starts, len(self.runs) - 1)], 0
        while a < self.total:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + tokens)))
            yield a, min(b, self.total)
            a = min(b, self.total)


class Tables(NamedTuple):
    """Of the class before, the factors of the gates; of a class, its share in each distribution (None: not made for all classes)."""

    after: np.ndarray
    mixed: np.ndarray | None


def tables(p: Params, expert: np.ndarray, mass: np.ndarray) -> Tables:
    return Tables(np.exp(p["before"]), shares(p, expert, mass, np.arange(len(expert))))


def shares(p: Params, expert: np.ndarray, mass: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Shares of classes in the distributions."""
    rows = expert.take(kinds, axis=0)
    rows *= (1 - FLOOR) / mass
    rows += (FLOOR * p["share"].take(kinds))[:, None]
    return rows


def picked(p: Params, expert: np.ndarray, mass: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Rows of shares, of which each is computed once."""
    kinds, rank = np.flatnonzero(np.bincount(classes)), np.empty(len(expert), np.intp)
    rank[kinds] = np.arange(len(kinds))
    return shares(p, expert, mass, kinds).take(rank.take(classes), axis=0)


class Pass:
    """The forward pass over the blocks [a, b) of a grid; ``logs`` of the classes [self.tokens) are its result.

    ``mass`` is the total of each column of ``expert``; ``known`` what is the same for many passes, if it was made before.
    """

    def __init__(self, p: Params, expert: np.ndarray, mass: np.ndarray, grid: Grid, a: int, b: int, known: Tables | None = None) -> None:
        after, mixed = known or tables(p, expert, mass)
        early = a if grid.first[a] else a - 1  # the block before serves as keys
        lo, mid, hi = np.searchsorted(grid.place, (early * BLOCK, a * BLOCK, b * BLOCK)).tolist()
        stop = grid.runs[hi] if hi < len(grid.runs) else len(grid.classes)
        feeding = np.arange(max(lo - 1, 0), hi - 1)  # each run feeds the next position, unless that is another text's
        feeding = feeding[~grid.ends_text[feeding]]
        self.feeding = Depths(grid.runs[feeding], grid.length[feeding])
        feeding = feeding.take(self.feeding.order)
        n, base = b - a, (a - 1) * BLOCK
        x = np.zeros(((n + 1) * BLOCK, WIDTH + 1), np.float32)
        x[:, WIDTH] = 1  # of the bias
        self.into = grid.place[feeding] + 1 - base
        self.spans = 1 / grid.length[feeding].astype(np.float32)[:, None]
        embed, self.feeding_classes = p["embed"], grid.classes.take(self.feeding.places)
        x[self.into, :WIDTH] = self.feeding.sums(embed.take(self.feeding_classes, axis=0)) * self.spans
        self.at_start = (np.flatnonzero(grid.first[early:b]) + early) * BLOCK - base
        x[self.at_start, :WIDTH] = embed[START]
        z = x @ np.concatenate((p["inner"], p["inner_bias"][None]))
        self.x, self.n = x, n
        self.q = z[BLOCK:, Q].reshape(n, BLOCK, WIDTH)
        self.k, self.v = np.ascontiguousarray(z[:, K]), np.ascontiguousarray(z[:, V])
        self.k2, self.v2 = (np.ndarray((n, 2 * BLOCK, WIDTH), y.dtype, y, 0, (y.strides[0] * BLOCK, *y.strides)) for y in (self.k, self.v))  # windows that overlap by a block
        s = self.q @ self.k2.transpose(0, 2, 1)
        np.clip(s, -40, 40, out=s)  # instead of taking off each row's maximum
        np.exp(s, out=s)
        s *= np.where(_SEEN, np.exp(p["back"][np.where(_SEEN, _BACK, 0)]), 0)
        s[grid.first[a:b], :, :BLOCK] = 0
        s *= (1 / (s.reshape(-1, 2 * BLOCK) @ _ONES[: 2 * BLOCK])).reshape(n, BLOCK, 1)
        self.s = s
        self.attended = s @ self.v2
        self.h = self.attended.reshape(-1, WIDTH) + z[BLOCK:, OWN]
        np.maximum(self.h, 0, out=self.h)
        self.tokens, r = slice(int(grid.runs[mid]), int(stop)), hi - mid
        self.depths = Depths(grid.runs[mid:hi] - self.tokens.start, grid.length[mid:hi])
        classes = grid.classes[self.tokens]
        self.classes = classes.take(self.depths.places)
        self.previous = classes.take(self.depths.places[r:] - 1)  # of those that don't begin a run; before the others stands START
        self.positions = grid.place[mid:hi].take(self.depths.order) - a * BLOCK
        self.hidden = self.h.take(self.positions, axis=0)
        gates = self.hidden @ p["gate"]
        gates += p["gate_bias"]
        np.clip(gates, -40, 40, out=gates)
        np.exp(gates, out=gates)
        e = np.empty((len(classes), EXPERTS), np.float32)
        np.multiply(gates, after[START], out=e[:r])
        after.take(self.previous, axis=0, out=e[r:], mode="clip")
        for begin, end, n in self.depths.parts():
            e[begin:end] *= gates[:n]
        self.total = e @ _ONES
        self.e, self.r = e, r
        self.picked = picked(p, expert, mass, self.classes) if mixed is None else mixed.take(self.classes, axis=0)
        self.joint = np.einsum("tm,tm->t", e, self.picked)

    @property
    def logs(self) -> np.ndarray:
        out = np.empty(len(self.classes), np.float32)
        out[self.depths.places] = np.log(self.joint / self.total + np.float32(1e-30))
        return out


def log_probabilities(p: Params, texts: list[np.ndarray], stops: np.ndarray, tokens: int = 4096, portion: int = 1 << 20) -> np.ndarray:
    """Natural logarithm of the probability of every class of the texts in a row.

    Batches bound the memory; a text of more than ``portion`` classes is laid out in pieces, each of which begins two
    blocks early, so that every prediction sees what it would see in the whole.
    """
    mass, out = p["expert"].sum(axis=0), []
    known = tables(p, p["expert"], mass)
    for some, skipped in _portions(texts, stops, portion):
        grid = Grid(some, stops)
        logs = np.empty(len(grid.classes), np.float32)
        for a, b in grid.batches(tokens):
            f = Pass(p, p["expert"], mass, grid, a, b, known)
            logs[f.tokens] = f.logs
        out.append(logs[skipped:])
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _portions(texts: list[np.ndarray], stops: np.ndarray, portion: int) -> Iterator[tuple[list[np.ndarray], int]]:
    """Texts in lists of about so many classes; with each the number of leading classes that an earlier list has told."""
    some, size = [], 0
    for text in texts:
        if size and size + len(text) > portion:
            yield some, 0
            some, size = [], 0
        if len(text) <= portion:
            some.append(text)
            size += len(text)
            continue
        edges = np.concatenate(([0], np.flatnonzero(stops[text[:-1]]) + 1))[::BLOCK]  # where blocks begin
        at, told = 0, 0
        while told < len(text):
            nxt = max(int(np.searchsorted(edges, edges[at] + portion)), at + 3)
            stop = int(edges[nxt]) if nxt < len(edges) else len(text)
            yield [text[edges[at] : stop]], told - int(edges[at])
            at, told = nxt - 2, stop
    if some:
        yield some, 0


def _summed(keys: np.ndarray, rows: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of their rows; row: which one each key has, else the one at its place."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    sorted_keys = keys.take(order)
    order = order if row is None else row.take(order)
    at = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys[at], np.add.reduceat(rows.take(order, axis=0).view(np.complex64), at, axis=0).view(np.float32)  # two columns at a time


def gradients(p: Params, expert: np.ndarray, mass: np.ndarray, grid: Grid, a: int, b: int, known: Tables | None = None) -> tuple[dict[str, tuple], tuple]:
    """Of the mean negative log-probability of the classes of blocks [a, b): name -> (rows or None for all, values).

    Beside them (classes, counts): how many times each expert is expected to have made each class.
    """
    f = Pass(p, expert, mass, grid, a, b, known)
    owed = f.picked
    owed *= f.e
    owed *= (1 / np.maximum(f.joint, np.float32(1e-30)))[:, None]  # each expert's part in the class
    dz = f.e
    dz *= (1 / f.total)[:, None]
    dz -= owed
    r, scale = f.r, np.float32(1 / len(f.classes))  # every sum of dz is scaled, not dz
    kinds, rows = _summed(f.previous, dz[r:]) if len(f.previous) else (np.zeros(0, np.int64), np.zeros((0, EXPERTS), np.float32))
    at_first, by_run = _total(dz[:r]), f.depths.sums(dz)
    by_run *= scale
    before = np.concatenate((rows, at_first[None]))
    before *= scale
    out = {"gate": (None, f.hidden.T @ by_run), "gate_bias": (None, before.sum(axis=0)), "before": (np.append(kinds, START), before)}
    d = np.zeros((len(f.x), 4 * WIDTH), np.float32)
    blocks = d.reshape(f.n + 1, BLOCK, 4 * WIDTH)
    dh = by_run @ p["gate"].T
    dh *= f.hidden > 0
    datt = np.zeros((f.n, BLOCK, WIDTH), np.float32)
    datt.reshape(-1, WIDTH)[f.positions] = dh
    blocks[1:, :, OWN] = datt
    ds = datt @ f.v2.transpose(0, 2, 1)
    ds -= (np.einsum("pw,pw->p", datt.reshape(-1, WIDTH), f.attended.reshape(-1, WIDTH))).reshape(f.n, BLOCK, 1)
    ds *= f.s
    blocks[1:, :, Q] = ds @ f.k2
    for part, values in ((K, ds.transpose(0, 2, 1) @ f.q), (V, f.s.transpose(0, 2, 1) @ datt)):
        both = np.zeros((f.n + 1, BLOCK, WIDTH), np.float32)
        both[:-1] = values[:, :BLOCK]
        both[1:] += values[:, BLOCK:]
        blocks[:, :, part] = both
    inner = (d.T @ f.x).T
    out["inner"], out["inner_bias"] = (None, inner[:WIDTH]), (None, inner[WIDTH])
    out["back"] = None, np.bincount(_BACK[_SEEN], _total(ds.reshape(f.n, -1)).reshape(BLOCK, -1)[_SEEN], 2 * BLOCK).astype(np.float32)
    dx = d @ p["inner"].T
    at_start = dx[f.at_start].sum(axis=0, keepdims=True)
    given = dx.take(f.into, axis=0)
    given *= f.spans
    kinds, rows = _summed(f.feeding_classes, given, f.feeding.runs()) if len(given) else (np.zeros(0, np.int64), given)
    out["embed"] = np.append(kinds, START), np.concatenate((rows, at_start))
    return out, _summed(f.classes, owed)


def train(p: Params, texts: list[np.ndarray], stops: np.ndarray, least_steps: int, tokens: int = 4096, rate: float = 0.02, inertia: float = 5_000.0, portion: int = 1 << 20) -> Params:
    """Adam over batches of the texts in order: once over all, and over again until ``least_steps`` are made.

    Rows of tables that a batch doesn't touch keep their moments. The distributions begin with the weight of ``inertia``
    classes; later counts weigh more than earlier ones, which a younger model has shared out.
    """
    p = {k: v.copy() for k, v in p.items()}
    m, v2 = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    expert = p["expert"] * np.float32(inertia / EXPERTS)
    mass, step, after = expert.sum(axis=0), 0, np.exp(p["before"])
    total = max(least_steps, -(-sum(map(len, texts)) // tokens))
    while step < total:
        began = step
        for some, _ in _portions(texts, stops, portion):
            grid = Grid(some, stops)
            for a, b in grid.batches(tokens):
                if step >= total and began:
                    break
                pace = rate * max(0.02, 1 - step / (total + 1)) ** 0.5
                c1, c2 = 1 - 0.9 ** (step + 1), 1 - 0.99 ** (step + 1)
                found, (kinds, counts) = gradients(p, expert, mass, grid, a, b, Tables(after, None))
                for name, (rows, g) in found.items():
                    m1, m2 = (m[name], v2[name]) if rows is None else (m[name].take(rows, axis=0), v2[name].take(rows, axis=0))
                    m1 *= np.float32(0.9)
                    m1 += np.float32(0.1) * g
                    m2 *= np.float32(0.99)
                    g *= np.float32(0.01) * g
                    m2 += g
                    step_by = np.sqrt(m2)
                    step_by += np.float32(1e-7 * c2**0.5)
                    np.divide(m1, step_by, out=step_by)
                    step_by *= np.float32(pace * c2**0.5 / c1)
                    if rows is None:
                        p[name] -= step_by
                        continue
                    m[name][rows], v2[name][rows] = m1, m2
                    p[name][rows] = new = p[name].take(rows, axis=0) - step_by
                    if name == "before":
                        after[rows] = np.exp(new)
                counts *= np.float32(1 + step)
                expert[kinds] += counts
                mass += counts.sum(axis=0)
                step += 1
    p["expert"] = expert / expert.sum(axis=0)
    np.clip(p["before"], -20, 20, out=p["before"])
    return p
