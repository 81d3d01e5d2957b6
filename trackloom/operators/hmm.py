"""Hidden Markov models with sparse transitions, conditional random fields and Gaussian mixtures.

Models are small dimension tables built on the driver. A track's decoding is one fold in a Python worker over its rows, in order;
tracks decode in parallel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TINY = float(np.spacing(1))


class Transitions:
    """Probabilities of (state, previous state), sorted by state and then previous state; those out of each state add up to 1."""

    def __init__(self, states, previous, probabilities):
        s, p, w = np.asarray(states, int), np.asarray(previous, int), np.asarray(probabilities, float)
        keep = w > 0
        s, p, w = s[keep], p[keep], w[keep]
        out = np.bincount(p, w)
        if not np.allclose(out[np.unique(p)], 1):
            raise ValueError("the probabilities out of a state must add up to 1")
        order = np.lexsort((p, s))
        self.states, self.previous, self.probabilities = s[order], p[order], w[order]
        self.n = int(max(s.max(), p.max())) + 1
        self.starts = np.searchsorted(self.states, np.arange(self.n + 1))

    @classmethod
    def from_dense(cls, matrix) -> Transitions:
        """matrix[previous, state]."""
        p, s = np.nonzero(matrix)
        return cls(s, p, np.asarray(matrix, float)[p, s])

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        out[self.previous, self.states] = self.probabilities
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a dimension table (state, previous, probability)."""
        cells = zip(self.states.tolist(), self.previous.tolist(), self.probabilities.tolist(), strict=True)
        return spark.createDataFrame(list(cells), "state long, previous long, probability double")


class Model:
    """Transitions, for each state the number of its density (pointers), and the starting distribution, even by default."""

    def __init__(self, transitions: Transitions, pointers, start=None):
        self.transitions, self.pointers = transitions, np.asarray(pointers, int)
        self.start = np.full(transitions.n, 1 / transitions.n) if start is None else np.asarray(start, float)
        if not np.isclose(self.start.sum(), 1):
            raise ValueError("the starting distribution must add up to 1")
        self.reset()

    def reset(self) -> None:
        self.now = self.start.copy()

    def viterbi(self, log_densities: np.ndarray) -> tuple[np.ndarray, float]:
        """The most likely path and its log probability; of equal predecessors the first wins, an impossible sequence has an empty path.

        The start is one step before the first row. A density that is no number, such as the logarithm of less than nothing, or infinite is impossible.
        Memory is a byte-sized choice for each state and row.
        """
        t, with_zero = self.transitions, np.errstate(divide="ignore")
        with with_zero:
            w, v = np.log(t.probabilities), np.log(self.start)
        has = np.flatnonzero(np.diff(t.starts))
        first = t.starts[has]
        most = int(np.diff(t.starts).max())
        back = np.zeros((len(log_densities), t.n), np.uint8 if most < 256 else np.uint32)
        rank = np.arange(len(w)) - np.repeat(t.starts[:-1], np.diff(t.starts))
        owner = np.repeat(np.arange(len(has)), np.diff(np.append(first, len(w))))
        for n, row in enumerate(log_densities):
            options = v[t.previous] + w
            best = np.maximum.reduceat(options, first)
            choice = np.where(options == best[owner], rank, most)
            back[n, has] = np.minimum(np.minimum.reduceat(choice, first), most - 1)
            v = np.full(t.n, -np.inf)
            v[has] = best
            v = v + np.where(row < np.inf, row, -np.inf)[self.pointers]
        state = int(v.argmax())
        top = float(v[state])
        if np.isinf(top):
            return np.zeros(0, int), top
        path = np.empty(len(log_densities), int)
        for n in range(len(path) - 1, -1, -1):
            path[n] = state
            state = int(t.previous[t.starts[state] + back[n, state]])
        return path, top

    def forward(self, densities: np.ndarray, reset: bool = True) -> np.ndarray:
        """Normalised forward probabilities, a row for each step; without reset it goes on from the last call."""
        if reset:
            self.reset()
        t, out = self.transitions, np.empty((len(densities), self.transitions.n))
        for n, row in enumerate(densities):
            now = np.bincount(t.states, self.now[t.previous] * t.probabilities, t.n) * row[self.pointers]
            self.now = out[n] = now / now.sum()
        return out

    def forward_blocks(self, densities: np.ndarray, block: int | None = None):
        """forward() in blocks of rows, one after the other."""
        self.reset()
        for a in range(0, len(densities), block or len(densities) or 1):
            yield self.forward(densities[a : a + (block or len(densities))], reset=False)


def discrete(probabilities, observations) -> np.ndarray:
    """Densities of symbols: probabilities[state, symbol]; one row for each observation."""
    p = np.asarray(probabilities, float)
    if not np.allclose(p.sum(1), 1):
        raise ValueError("the probabilities of a state must add up to 1")
    return p[:, np.asarray(observations, int)].T


# --- state spaces: dimension tables of (state, interval, position) ------------------------------------------------------------


class Space:
    """States of positions in a bar: position counts beats from 0, interval is the beat's length in frames; pattern numbers several bars."""

    def __init__(self, positions, intervals, patterns, first: list[np.ndarray], last: list[np.ndarray], beats: list[int]):
        self.positions, self.intervals, self.patterns = np.asarray(positions, float), np.asarray(intervals, int), np.asarray(patterns, int)
        self.first, self.last, self.beats = first, last, beats
        self.n = len(self.positions)

    def rows(self, spark: SparkSession) -> DataFrame:
        cells = zip(range(self.n), self.positions.tolist(), self.intervals.tolist(), self.patterns.tolist(), strict=True)
        return spark.createDataFrame(list(cells), "state long, position double, interval long, pattern long")


def beat_lengths(low: float, high: float, count: int | None = None) -> np.ndarray:
    """All whole intervals, or ``count`` of them spaced evenly in the logarithm."""
    whole = np.arange(np.round(low), np.round(high) + 1)
    if count is None or count >= len(whole):
        return whole.astype(int)
    points, found = count, np.zeros(0)
    while len(found) < count:
        found = np.unique(np.round(np.logspace(np.log2(low), np.log2(high), points, base=2)))
        points += 1
    return found.astype(int)


def bar_space(beats: int, low: float, high: float, count: int | None = None) -> Space:
    """Every position of every interval for each beat of a bar; one beat makes the space of beats."""
    lengths = beat_lengths(low, high, count)
    ends = np.cumsum(lengths)
    one = np.concatenate([np.arange(k) / k for k in lengths])
    own, size = np.repeat(lengths, lengths), int(ends[-1])
    first = [ends - lengths + b * size for b in range(beats)]
    last = [ends - 1 + b * size for b in range(beats)]
    return Space(np.concatenate([one + b for b in range(beats)]), np.tile(own, beats), np.zeros(size * beats), first, last, [beats])


def joined_space(spaces: list[Space]) -> Space:
    """Several bars side by side; first and last hold the states that a pattern is entered and left by."""
    at = np.cumsum([0, *(s.n for s in spaces)])
    return Space(
        np.concatenate([s.positions for s in spaces]), np.concatenate([s.intervals for s in spaces]), np.repeat(np.arange(len(spaces)), [s.n for s in spaces]),
        [s.first[0] + o for s, o in zip(spaces, at, strict=False)], [s.last[-1] + o for s, o in zip(spaces, at, strict=False)], [s.beats[0] for s in spaces],
    )


def tempo_changes(from_lengths, to_lengths, steadiness: float | None, least: float = TINY, norm: bool = True) -> np.ndarray:
    """exp(-steadiness |to / from - 1|), a row for each length before; None allows no change."""
    a, b = np.asarray(from_lengths, float), np.asarray(to_lengths, float)
    if steadiness is None:
        return np.eye(len(a), len(b))
    p = np.exp(-steadiness * np.abs(b[None] / a[:, None] - 1))
    p[p <= least] = 0
    return p / p.sum(1, keepdims=True) if norm else p


def bar_arcs(space: Space, steadiness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, previous, probability): one step on inside a beat, a change of tempo at each beat's end."""
    beats = len(space.first)
    each = steadiness if isinstance(steadiness, (list, tuple)) else [steadiness] * beats
    if len(each) != beats:
        raise ValueError("one steadiness for each beat is needed")
    inner = np.setdiff1d(np.arange(space.n), np.concatenate(space.first))
    states, previous, weights = [inner], [inner - 1], [np.ones(len(inner))]
    for b in range(beats):
        to, before = space.first[b], space.last[b - 1]
        p = tempo_changes(space.intervals[before], space.intervals[to], each[b])
        i, j = np.nonzero(p)
        states.append(to[j])
        previous.append(before[i])
        weights.append(p[i, j])
    return np.concatenate(states), np.concatenate(previous), np.concatenate(weights)


def bar_transitions(space: Space, steadiness) -> Transitions:
    return Transitions(*bar_arcs(space, steadiness))


def pattern_transitions(spaces: list[Space], steadiness, change: float | np.ndarray | None = None) -> Transitions:
    """Bars side by side; at a bar's end another one begins with probability ``change`` (shared evenly, or a matrix [to, from])."""
    at = np.cumsum([0, *(s.n for s in spaces)])
    arcs = [(a + o, b + o, w) for s, o in zip(spaces, at, strict=False) for a, b, w in [bar_arcs(s, steadiness)]]
    k = len(spaces)
    if change is None or k == 1:
        return Transitions(*(np.concatenate(x) for x in zip(*arcs, strict=True)))
    if not isinstance(change, np.ndarray):
        change = np.full((k, k), change / (k - 1))
        np.fill_diagonal(change, 1 - change[0].sum() + change[0, 0])
    first, last = [s.first[0] + o for s, o in zip(spaces, at, strict=False)], [s.last[-1] + o for s, o in zip(spaces, at, strict=False)]
    entries, parts = [], []
    for p, (a, b, w) in enumerate(arcs):
        over = np.isin(b, last[p]) & np.isin(a, first[p])
        entries.append((a[over], b[over], w[over]))
        parts.append((a, b, np.where(over, w * change[p, p], w)))
    for p in range(k):
        for q in range(k):
            if p != q:
                if len(entries[p][0]) != len(entries[q][0]):
                    raise ValueError("patterns must have equally many ways in and out")
                parts.append((entries[p][0], entries[q][1], entries[p][2] * change[p, q]))
    return Transitions(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def beat_pointers(space: Space, share: float) -> np.ndarray:
    """1 in the first 1 / share of the space's positions, else 0."""
    return (space.positions < 1 / share).astype(int)


def beat_densities(activations, share: float) -> np.ndarray:
    """Log densities of no beat and beat; activations above 1 leave no room for no beat, those below 0 none for a beat."""
    x = np.asarray(activations, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.stack([np.log((1 - x) / (share - 1)), np.log(x)], 1)


def downbeat_pointers(space: Space, share: float) -> np.ndarray:
    """2 at the bar's begin, 1 at its other beats."""
    return np.where(space.positions < 1 / share, 2, (space.positions % 1 < 1 / share).astype(int))


def downbeat_densities(activations, share: float) -> np.ndarray:
    """Log densities of neither, beat and downbeat from rows (beat, downbeat)."""
    x = np.asarray(activations, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.stack([np.log((1 - x.sum(1)) / (share - 1)), np.log(x[:, 0]), np.log(x[:, 1])], 1)


def pattern_pointers(space: Space, mixtures: list[int]) -> np.ndarray:
    """Number of the mixture: each pattern's mixtures cover its bar in equal parts."""
    before = np.cumsum([0, *mixtures])
    n, beats = np.asarray(mixtures)[space.patterns], np.asarray(space.beats)[space.patterns]
    return (space.positions * n / beats).astype(int) + before[space.patterns]


class Envelope:
    """States of a note: silence, attack, decay, sustain, release, each of a length in frames."""

    def __init__(self, attack: int = 1, decay: int = 1, release: int = 1):
        self.silence, self.attack = 0, 1
        self.decay = self.attack + attack
        self.sustain = self.decay + decay
        self.release = self.sustain + release
        self.n = self.release + 1

    def transitions(self, onset: float = 0.8, note: float = 0.8, offset: float = 0.2, end: float = 1.0) -> Transitions:
        """Attack goes on with ``onset``, decay with ``note``, else both end in silence; sustain stays, strikes again or releases by the share of its three."""
        arcs = [(0, 0, 1 - onset), (self.attack, 0, onset)]
        for s, p in [*((s, onset) for s in range(self.attack, self.decay)), *((s, note) for s in range(self.decay, self.sustain))]:
            arcs += [(0, s, 1 - p), (s + 1, s, p)]
        whole = onset + note + offset
        arcs += [(self.sustain, self.sustain, note / whole), (self.attack, self.sustain, onset / whole), (self.sustain + 1, self.sustain, offset / whole)]
        for s in range(self.sustain + 1, self.release):
            arcs += [(self.sustain, s, offset), (s + 1, s, 1 - offset)]
        arcs += [(0, self.release, end), (self.release, self.release, 1 - end)]
        return Transitions(*zip(*arcs, strict=True))

    def pointers(self) -> np.ndarray:
        """Densities: silence 0, attack 1, decay and sustain 2, release 3."""
        out = np.zeros(self.n, int)
        out[self.attack :], out[self.decay :], out[self.release :] = 1, 2, 3
        return out

    @staticmethod
    def log_densities(observed: np.ndarray) -> np.ndarray:
        """From rows (note, onset, offset)."""
        x = np.asarray(observed, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(np.stack([1 - x[:, 1], x[:, 1], x[:, 0], x[:, 2]], 1))


# --- conditional random field, Gaussian mixtures --------------------------------------------------------------------------------


class Field:
    """A linear-chain conditional random field: start, end and bias by state, transition[before, state], observation[feature, state]."""

    def __init__(self, start, end, bias, transition, observation):
        self.start, self.end, self.bias, self.transition, self.observation = (np.asarray(x, float) for x in (start, end, bias, transition, observation))

    def decode(self, observed) -> np.ndarray:
        """The best states; of equal ones the first. The start is one step before the first row."""
        v, back = self.start, []
        for row in np.asarray(observed, float):
            options = v[:, None] + self.transition
            back.append(options.argmax(0))
            v = options.max(0) + self.bias + row @ self.observation
        state, out = int((v + self.end).argmax()), []
        for choice in reversed(back):
            out.append(state)
            state = int(choice[state])
        return np.array(out[::-1], int)


def log_sum_exp(values: np.ndarray, axis: int = 0) -> np.ndarray:
    top = values.max(axis)
    return top + np.log(np.exp(values - np.expand_dims(top, axis)).sum(axis))


def pseudo_inverse(a: np.ndarray, cut: float | None = None) -> np.ndarray:
    """Of a symmetric matrix; eigenvalues below cut times the greatest count as 0."""
    values, vectors = np.linalg.eigh(np.asarray(a, float))
    cut = 1e6 * np.finfo(float).eps if cut is None else cut
    inverse = np.where(np.abs(values) > cut * np.abs(values).max(), 1 / np.where(values == 0, 1, values), 0)
    return (vectors * inverse) @ vectors.T


def log_normal(x: np.ndarray, means: np.ndarray, covariances: np.ndarray, kind: str = "diag", floor: float = 1e-7) -> np.ndarray:
    """Log densities, a row for each point and a column for each normal distribution. kind: spherical, diag, tied or full."""
    x, means, c = np.asarray(x, float), np.asarray(means, float), np.asarray(covariances, float)
    d = x.shape[1]
    if kind in ("spherical", "diag"):
        c = np.broadcast_to(c.reshape(len(means), -1), means.shape)
        far = (((x[:, None] - means[None]) ** 2) / c[None]).sum(2)
        return -0.5 * (d * np.log(2 * np.pi) + np.log(c).sum(1)[None] + far)
    out = np.empty((len(x), len(means)))
    for k, mean in enumerate(means):
        cov = c if kind == "tied" else c[k]
        try:
            lower = np.linalg.cholesky(cov)
        except np.linalg.LinAlgError:
            lower = np.linalg.cholesky(cov + floor * np.eye(d))
        z = np.linalg.solve(lower, (x - mean).T)
        out[:, k] = -0.5 * ((z * z).sum(0) + d * np.log(2 * np.pi) + 2 * np.log(np.diagonal(lower)).sum())
    return out


class Mixture:
    """A mixture of normal distributions, scored or fitted by expectation and maximisation."""

    def __init__(self, weights=None, means=None, covariances=None, kind: str = "full"):
        if kind not in ("spherical", "diag", "tied", "full"):
            raise ValueError(f"unknown kind of covariance: {kind}")
        self.weights, self.means, self.covariances, self.kind = weights, means, covariances, kind

    def joint(self, x: np.ndarray) -> np.ndarray:
        return log_normal(x, self.means, self.covariances, self.kind) + np.log(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood of each point."""
        return log_sum_exp(self.joint(np.asarray(x, float)), 1)

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        j = self.joint(np.asarray(x, float))
        return np.exp(j - log_sum_exp(j, 1)[:, None])

    def fit(self, x: np.ndarray, components: int = 1, rounds: int = 100, tolerance: float = 0.01, floor: float = 1e-3, seed: int = 0) -> Mixture:
        """From points far from each other, the first one seeded, until the mean log likelihood rises by less than the tolerance."""
        x = np.asarray(x, float)
        n, d = x.shape
        centres = x[[np.random.default_rng(seed).integers(n)]]
        while len(centres) < components:
            centres = np.concatenate([centres, x[[((x[:, None] - centres[None]) ** 2).sum(2).min(1).argmax()]]])
        self.update(x, np.eye(components)[((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)], floor)
        last = -np.inf
        for _ in range(rounds):
            now = float(self.score(x).mean())
            if now - last < tolerance:
                break
            last = now
            self.update(x, self.responsibilities(x), floor)
        return self

    def update(self, x: np.ndarray, r: np.ndarray, floor: float) -> None:
        """Weights, means and covariances of points that belong to the components by shares r."""
        n, d = x.shape
        size = r.sum(0) + 10 * TINY
        self.weights, self.means = size / size.sum(), r.T @ x / size[:, None]
        apart = x[:, None] - self.means[None]
        if self.kind in ("diag", "spherical"):
            c = np.einsum("nk,nkd->kd", r, apart**2) / size[:, None] + floor
            self.covariances = c if self.kind == "diag" else c.mean(1, keepdims=True)
        else:
            c = np.einsum("nk,nkd,nke->kde", r, apart, apart)
            self.covariances = c.sum(0) / n + floor * np.eye(d) if self.kind == "tied" else c / size[:, None, None] + floor * np.eye(d)


# --- on tracks ---------------------------------------------------------------------------------------------------------------------


def by_track(rows: DataFrame, kernel, schema: str, order: str = "idx") -> DataFrame:
    """kernel(key, ordered pandas rows) -> columns without the track, for each track in one worker."""
    kind = dict(rows.dtypes)["track_id"]

    def work(key, pdf):
        import pandas as pd

        out = kernel(key[0], pdf.sort_values(order))
        return pd.DataFrame({"track_id": key[0], **out})

    return rows.groupBy("track_id").applyInPandas(work, f"track_id {kind}, {schema}")


def decoded(rows: DataFrame, model: Model, log_densities, columns=("x",)) -> DataFrame:
    """(track_id, idx, state, log_prob) of the best path; log_densities(array of the columns) gives a row for each step."""

    def kernel(_, pdf):
        x = np.stack([np.array(pdf[c].tolist(), float) for c in columns], -1) if len(columns) > 1 else np.array(pdf[columns[0]].tolist(), float)
        path, top = model.viterbi(log_densities(x))
        n = len(path)
        return {"idx": pdf["idx"].to_numpy()[:n], "state": path, "log_prob": np.full(n, top)}

    return by_track(rows, kernel, "idx long, state long, log_prob double")


def forwarded(rows: DataFrame, model: Model, densities, column: str = "x") -> DataFrame:
    """(track_id, idx, p): the forward probabilities of each row's states."""

    def kernel(_, pdf):
        found = model.forward(densities(np.array(pdf[column].tolist(), float)))
        return {"idx": pdf["idx"].to_numpy(), "p": list(found)}

    return by_track(rows, kernel, "idx long, p array<double>")


def labelled(rows: DataFrame, field: Field, column: str = "features") -> DataFrame:
    """(track_id, idx, state) of a conditional random field over arrays of features."""
    return by_track(rows, lambda _, pdf: {"idx": pdf["idx"].to_numpy(), "state": field.decode(pdf[column].tolist())}, "idx long, state long")


def mixture_scores(rows: DataFrame, mixture: Mixture, column: str = "features") -> DataFrame:
    """rows with the log likelihood of an array of features; narrow."""

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        return pd.Series(mixture.score(np.array(x.tolist(), float))) if len(x) else pd.Series([], dtype="float64")

    return rows.withColumn("log_likelihood", score(column))
