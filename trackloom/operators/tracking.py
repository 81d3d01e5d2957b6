"""Beats, bars and notes from activations: one decoder per track in a Python worker, tracks side by side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from trackloom.operators import hmm
from trackloom.operators.tempo import comb_bank, tau_range


def window_around(x: np.ndarray, centre: int, size: int) -> np.ndarray:
    """size values around a place, zeros beyond the ends."""
    start = centre - size // 2
    out = np.zeros(size)
    a, b = max(start, 0), min(start + size, len(x))
    if a < b:
        out[a - start : b - start] = x[a:b]
    return out


def follow(x: np.ndarray, start: int, interval: int, aside: int, shape: np.ndarray) -> list[int]:
    """Places an interval apart, each moved to the strongest value near it."""
    out, at = [], start
    while True:
        best = int((window_around(x, at, 2 * aside) * shape).argmax())
        if best > 0:
            at += best - aside
        out.append(at)
        at += interval
        if at >= len(x):
            return out


def pick_beats(x: np.ndarray, interval: int, look_aside: float = 0.2) -> np.ndarray:
    """The chain of beats of one interval whose activations add up to most; of equal chains the earliest begins."""
    aside = max(1, int(interval * look_aside))
    shape = np.hamming(2 * aside)
    chains = [follow(x, s, interval, aside, shape) for s in range(interval)]
    return np.array(chains[int(np.argmax([x[c].sum() for c in chains]))])


def hamming(x: np.ndarray, size: int) -> np.ndarray:
    return np.convolve(x, np.hamming(size), "same") if size > 1 else x


def dominant_interval(x: np.ndarray, fps: float, low_bpm: float, high_bpm: float, hist_smooth: int, alpha: float) -> int:
    low, high = tau_range(fps, low_bpm, high_bpm)
    taus = np.arange(low, high + 1)
    y = comb_bank(x, taus, alpha)
    return int(taus[hamming(np.where(y == y.max(1, keepdims=True), y, 0).sum(0), hist_smooth).argmax()])


def track_beats(b: DataFrame, fps: float, look_aside: float = 0.2, look_ahead: float | None = 10.0, low_bpm: float = 40.0, high_bpm: float = 250.0, act_smooth: float = 0.14, hist_smooth: int = 9, alpha: float = 0.79) -> DataFrame:
    """(track_id, t): beats by the dominant interval, found anew in a window of look_ahead seconds on either side of each beat; None takes one interval for the whole track."""
    shortest = tau_range(fps, low_bpm, high_bpm)[0]

    def kernel(_, pdf):
        x = hamming(pdf["x"].to_numpy(float), int(fps * act_smooth))
        if look_ahead is None:
            found = pick_beats(x, dominant_interval(x, fps, low_bpm, high_bpm, hist_smooth, alpha), look_aside)
        else:
            half, found, at = int(look_ahead * fps), [], 0
            while at < len(x):
                near = window_around(x, at, 2 * half)
                interval = dominant_interval(near, fps, low_bpm, high_bpm, hist_smooth, alpha)
                places = pick_beats(near, interval, look_aside) + at - half
                places = places[places >= (found[-1] + shortest if found else 0)]
                if not len(places):
                    break
                at = int(places[np.abs(places - at).argmin()])
                found.append(at)
                at += interval
        t = np.sort(np.array(found, float)) / fps
        return {"t": t[t >= 0]}

    return hmm.by_track(b, kernel, "t double")


# --- beats by intervals that vary around one: a semi-Markov chain ------------------------------------------------------------------


def start_shares(n: int, interval: int) -> np.ndarray:
    """The first beat lies in the first interval; not normalised, so that short intervals gain nothing."""
    return (np.arange(n) < interval).astype(float)


def step_shares(interval: int, sigma: float) -> np.ndarray:
    """Shares of steps up to twice the interval: normal in the logarithm to base 2."""
    steps = np.arange(2 * interval, dtype=float)
    steps[0] = 1e-6
    p = np.exp(-0.5 * ((np.log2(steps) - np.log2(interval)) / sigma) ** 2)
    return p / p.sum()


def normalisers(x: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What all steps from each place would meet: the activations behind it, weighted by the steps."""
    wide = np.concatenate([x, np.zeros(len(steps))])
    return np.array([wide[i : i + len(steps)] @ steps for i in range(len(x))])


def chain(start: np.ndarray, steps: np.ndarray, norm: np.ndarray, x: np.ndarray, interval: int) -> tuple[np.ndarray, float]:
    """The best chain of len(x) / interval places; all in logarithms."""
    n, k = len(x), len(x) // interval
    v, back = start + x + norm, []
    for _ in range(k - 1):
        best, choice = np.full(n, -np.inf), np.zeros(n, int)
        for j in range(min(len(steps), n)):
            new = v[: n - j] + steps[j]
            # Steps may not reach the track's first place.
            better = new > best[j:]
            better[:1] = False
            best[j:][better] = new[better]
            choice[j:][better] = np.flatnonzero(better)
        v = best + x + norm
        back.append(choice)
    v = v - norm
    at = int(v.argmax())
    top, path = float(v[at]), [at]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return np.array(path[::-1]), top


def best_chain(x: np.ndarray, interval: int, sigma: float = 0.18) -> tuple[np.ndarray, float]:
    """The likeliest chain and its logarithm: places weigh by their activation and by what lies within a step behind them, but for the last one."""
    steps = step_shares(interval, sigma)
    with np.errstate(divide="ignore"):
        norm = np.log(normalisers(x, steps))
        return chain(np.log(start_shares(len(x), interval)), np.log(steps), np.maximum(norm, -1e6), np.log(x), interval)


def track_beats_by_chains(b: DataFrame, fps: float, sigma: float = 0.18, intervals: int = 5, factors: tuple[float, ...] | None = None, low_bpm: float = 20.0, high_bpm: float = 240.0, act_smooth: float = 0.09, hist_smooth: int = 7, alpha: float = 0.79) -> DataFrame:
    """(track_id, t): of the strongest intervals, or of factors of the strongest one, that whose best chain is likeliest for each beat."""
    low, high = tau_range(fps, low_bpm, high_bpm)
    taus = np.arange(low, high + 1)

    def kernel(_, pdf):
        x = pdf["x"].to_numpy(float)
        smooth = hamming(x, int(round(fps * act_smooth)))
        y = comb_bank(smooth, taus, alpha)
        h = hamming(np.where(y == y.max(1, keepdims=True), y, 0).sum(0), hist_smooth)
        peaks = np.flatnonzero((h > np.roll(h, 1)) & (h > np.roll(h, -1)))
        found = taus[peaks[np.argsort(h[peaks], kind="stable")[::-1]]]
        if not len(found):
            return {"t": np.zeros(0)}
        if factors:
            tried = [int(found[0] * f) for f in factors if low <= int(found[0] * f) <= high]
        else:
            tried = found[:intervals].tolist()
        chains = [best_chain(smooth, i, sigma) for i in sorted(map(int, tried), reverse=True) if i <= len(x)]
        if not chains:
            return {"t": np.zeros(0)}
        return {"t": chains[int(np.argmax([p / len(c) for c, p in chains]))][0] / fps}

    return hmm.by_track(b, kernel, "t double")


# --- beats and bars by hidden Markov models --------------------------------------------------------------------------------------------


def cropped(x: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """From the first to the last row that reaches the threshold, and where that begins."""
    loud = np.flatnonzero(x >= threshold) if x.ndim == 1 else np.unique(np.nonzero(x >= threshold)[0])
    return (x[loud[0] : loud[-1] + 1], int(loud[0])) if len(loud) else (x[:0], 0)


def strongest(x: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The place of the greatest value in each run of rows inside; x: one value a row."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(int), [0]])))
    return np.array([a + int(x[a:b].argmax()) for a, b in edges.reshape(-1, 2)], int)


def decode_beats(b: DataFrame, fps: float, low_bpm: float = 55.0, high_bpm: float = 215.0, tempi: int | None = None, steadiness: float = 100.0, share: float = 16.0, threshold: float = 0.0, correct: bool = True) -> DataFrame:
    """(track_id, t): beats of the best path of a beat model; correct moves each to the strongest activation of its range."""
    from trackloom.operators.tempo import beat_model

    space, model = beat_model(fps, low_bpm, high_bpm, tempi, steadiness, share)

    def kernel(_, pdf):
        x, first = pdf["x"].to_numpy(float), 0
        if threshold:
            x, first = cropped(x, threshold)
        if not x.any():
            return {"t": np.zeros(0)}
        path = model.viterbi(hmm.beat_densities(x, share))[0]
        if not len(path):
            return {"t": np.zeros(0)}
        inside = model.pointers[path] == 1
        if correct:
            found = strongest(x, inside)
        else:
            p = space.positions[path]
            found = np.flatnonzero((p < np.roll(p, 1)) & (p < np.roll(p, -1)) & inside)
        return {"t": (found + first) / fps}

    return hmm.by_track(b, kernel, "t double")


def online_beats(model: hmm.Model, x: np.ndarray, fps: float, share: float, high_bpm: float, last: float, offset: int) -> tuple[list[float], float]:
    """Beats of the next rows by the forward algorithm, which goes on from the model's state; last: the time of the last beat."""
    found = []
    with np.errstate(over="ignore"):
        states = model.forward(np.exp(hmm.beat_densities(x, share)), reset=False).argmax(1)
    for k in np.flatnonzero(model.pointers[states] == 1):
        t = (k + offset) / fps
        if t >= last + 60 / high_bpm:
            found.append(t)
            last = t
    return found, last


def decode_downbeats(b: DataFrame, fps: float, beats_per_bar: tuple[int, ...] = (3, 4), low_bpm: float = 55.0, high_bpm: float = 215.0, tempi: int | None = 60, steadiness: float = 100.0, share: float = 16.0, threshold: float = 0.05, correct: bool = True) -> DataFrame:
    """(track_id, t, position) from activations (beat, downbeat): of one bar model for each metre, the path of the likeliest."""
    spaces = [hmm.bar_space(k, 60 * fps / high_bpm, 60 * fps / low_bpm, tempi) for k in beats_per_bar]
    models = [hmm.Model(hmm.bar_transitions(s, steadiness), hmm.downbeat_pointers(s, share)) for s in spaces]

    def kernel(_, pdf):
        none = {"t": np.zeros(0), "position": np.zeros(0, int)}
        x, first = np.stack([pdf["beat"].to_numpy(float), pdf["downbeat"].to_numpy(float)], 1), 0
        if threshold:
            x, first = cropped(x, threshold)
        if not x.any():
            return none
        found = [m.viterbi(hmm.downbeat_densities(x, share)) for m in models]
        best = int(np.argmax([p for _, p in found]))
        path = found[best][0]
        if not len(path):
            return none
        number = spaces[best].positions[path].astype(int) + 1
        places = strongest(x.max(1), models[best].pointers[path] >= 1) if correct else np.flatnonzero(np.diff(number)) + 1
        return {"t": (places + first) / fps, "position": number[places]}

    return hmm.by_track(b, kernel, "t double, position long")


def decode_patterns(rows: DataFrame, fps: float, patterns: list[tuple[int, list[hmm.Mixture]]], low_bpm: float = 55.0, high_bpm: float = 215.0, tempi: int | None = None, steadiness: float = 100.0, column: str = "features") -> DataFrame:
    """(track_id, t, position): rhythmic patterns (beats of the bar, mixtures along it) as observation model."""
    spaces = [hmm.bar_space(k, 60 * fps / high_bpm, 60 * fps / low_bpm, tempi) for k, _ in patterns]
    space = hmm.joined_space(spaces)
    model = hmm.Model(hmm.pattern_transitions(spaces, steadiness), hmm.pattern_pointers(space, [len(m) for _, m in patterns]))

    def kernel(_, pdf):
        x = np.array(pdf[column].tolist(), float)
        path = model.viterbi(np.stack([m.score(x) for _, ms in patterns for m in ms], 1))[0]
        number = space.positions[path].astype(int) + 1
        places = np.flatnonzero(np.diff(number)) + 1
        return {"t": places / fps, "position": number[places]}

    return hmm.by_track(rows, kernel, "t double, position long")


def decode_bars(b: DataFrame, beats_per_bar: tuple[int, ...] = (3, 4), weight: float = 100.0, change: float = 1e-7) -> DataFrame:
    """(track_id, t, position) of known beats (track_id, idx, t, x), x saying how likely each is a downbeat; the last beat's x isn't read.

    Beats that no path explains stay, without a position.
    """
    spaces = [hmm.bar_space(k, 1, 1) for k in beats_per_bar]
    space = hmm.joined_space(spaces)
    model = hmm.Model(hmm.pattern_transitions(spaces, 1.0, change), hmm.beat_pointers(space, weight))

    def kernel(_, pdf):
        import pandas as pd

        t, x = pdf["t"].to_numpy(float), pdf["x"].to_numpy(float)
        if len(t) < 2:
            return {"t": t, "position": np.ones(len(t), int)}
        path = model.viterbi(hmm.beat_densities(x[:-1], weight))[0]
        if not len(path):
            return {"t": t, "position": pd.array([None] * len(t), "Int64")}
        number = space.positions[path].astype(int) + 1
        return {"t": t, "position": np.append(number, number[-1] % beats_per_bar[space.patterns[path[-1]]] + 1)}

    return hmm.by_track(b, kernel, "t double, position long")


def decode_notes(rows: DataFrame, fps: float = 50.0, attack: float = 0.04, decay: float = 0.04, release: float = 0.02, onset: float = 0.8, note: float = 0.8, offset: float = 0.5, complete: bool = True, onset_threshold: float = 0.5, note_threshold: float = 0.5) -> DataFrame:
    """(track_id, onset, pitch, duration) of rows (track_id, pitch, idx, note, onset, offset): an envelope model for each pitch.

    A note lasts from the last frame before the path is between attack and release to the last frame that is. complete: its path must
    go through all states from attack to the one before release. The thresholds are the least top activations within a note.
    """
    states = hmm.Envelope(*(int(s * fps) for s in (attack, decay, release)))
    model = hmm.Model(states.transitions(onset, note, offset), states.pointers())
    wanted = set(range(states.attack, states.release))

    def work(key, pdf):
        import pandas as pd

        x = pdf.sort_values("idx")[["note", "onset", "offset"]].to_numpy(float)
        path = model.viterbi(states.log_densities(x))[0]
        edges = np.flatnonzero(np.diff(((path > states.attack) & (path < states.release)).astype(int)))
        if len(edges) % 2:
            edges = np.append(edges, len(x))
        out = []
        for a, b in edges.reshape(-1, 2):
            whole = not complete or wanted <= set(path[a:b].tolist())
            if whole and x[a:b, 0].max() >= note_threshold and x[a:b, 1].max() >= onset_threshold:
                out.append((key[0], a / fps, int(key[1]), (b - a) / fps))
        return pd.DataFrame(out, columns=["track_id", "onset", "pitch", "duration"])

    kind = dict(rows.dtypes)["track_id"]
    return rows.groupBy("track_id", "pitch").applyInPandas(work, f"track_id {kind}, onset double, pitch long, duration double")


def best_prediction(predictions: DataFrame, references: int | None = None) -> DataFrame:
    """(track_id, idx, x) of the model whose activations (track_id, model, idx, x) lie nearest to the mean of all, or of the first ``references``."""
    from pyspark.sql import functions as F

    chosen = predictions if not references else predictions.where(F.col("model") < references)
    mean = chosen.groupBy("track_id", "idx").agg(F.avg("x").alias("_ref"))
    tried = predictions if not references else predictions.where(F.col("model") >= references)
    far = tried.join(mean, ["track_id", "idx"]).groupBy("track_id", "model").agg(F.sum((F.col("x") - F.col("_ref")) ** 2).alias("d"))
    best = far.groupBy("track_id").agg(F.min_by("model", F.struct("d", "model")).alias("model"))
    return tried.join(best, ["track_id", "model"], "left_semi").select("track_id", "idx", "x")


def beat_subdivisions(frames: DataFrame, beats: DataFrame, fps: float, parts: int) -> DataFrame:
    """(track_id, beat, part, features): the mean of the frames' arrays in each of a beat's equal parts; null where a part has no frame.

    A beat's frames end 50 ms or half a part before the next beat, whichever is nearer; beats behind the last frame go.
    """

    def work(key, left, right):
        import pandas as pd

        f = left.sort_values("frame")
        x = np.array(f["m"].tolist(), float)
        t = np.sort(right["t"].to_numpy(float))
        t = t[t <= len(x) / fps]
        out = []
        if len(t) > 1:
            start = int(max(0, np.floor((t[0] - 0.02) * fps)))
            for k in range(len(t) - 1):
                end = int(np.floor((t[k + 1] - min(0.5 * (t[k + 1] - t[k]) / parts, 0.05)) * fps))
                part = np.floor(np.arange(end - start) * parts / max(1, end - start)).astype(int)
                own = x[start:end]
                for p in range(parts):
                    some = own[part[: len(own)] == p]
                    out.append((key[0], k, p, some.mean(0).tolist() if len(some) else None))
                start = end
        return pd.DataFrame(out, columns=["track_id", "beat", "part", "features"])

    kind = dict(frames.dtypes)["track_id"]
    other = beats.select(beats["track_id"].alias("_k"), "t")
    return frames.select("track_id", "frame", "m").groupBy("track_id").cogroup(other.groupBy("_k")).applyInPandas(work, f"track_id {kind}, beat long, part long, features array<double>")
