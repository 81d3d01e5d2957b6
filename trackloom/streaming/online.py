"""Streaming forms: event-time windows with a watermark, and peaks kept across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_levels(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of x by label and event-time window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "label").agg(F.count("*").alias("n"), F.sum("x").alias("x")).select(F.col("w.start").alias("start"), "label", "n", "x")


def online_peaks(events: DataFrame, threshold: float, distance: float) -> DataFrame:
    """Rows above the threshold at least ``distance`` seconds after the track's last peak; the state is that peak's time.

    Rows of one micro-batch are taken in the order of t; a row earlier than the last peak is no peak.
    """

    def work(key, batches: Iterator, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, x in zip(rows["t"], rows["x"], strict=True):
            if x > threshold and (last is None or t - last >= distance):
                out.append((key[0], t, x))
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["track_id", "t", "x"])

    return events.groupBy("track_id").applyInPandasWithState(work, "track_id long, t double, x double", "last double", "append", "NoTimeout")


# --- operators with a state for each key; they take batch tables too, as one micro-batch would come -------------------------------------


def stateful(df: DataFrame, key: str, columns: str, step, order: str) -> DataFrame:
    """step(key, rows in order, state bytes or None) -> (rows out, state bytes): applied to each key of each micro-batch."""
    import pickle

    kind = dict(df.dtypes)[key]

    def frame(k, out):
        import pandas as pd

        return pd.DataFrame([(k, *r) for r in out], columns=[key, *(c.split()[0] for c in columns.split(", "))])

    if not df.isStreaming:

        def whole(k, pdf):
            return frame(k[0], step(k[0], pdf.sort_values(order), None)[0])

        return df.groupBy(key).applyInPandas(whole, f"{key} {kind}, {columns}")

    def work(k, batches, state):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(order)
        out, kept = step(k[0], rows, pickle.loads(state.get[0]) if state.exists else None)
        state.update((pickle.dumps(kept),))
        yield frame(k[0], out)

    return df.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, {columns}", "kept binary", "append", "NoTimeout")


def paired(messages: DataFrame) -> DataFrame:
    """(session, n, update): each chunk with the last update before it that no chunk has taken; chunks without one go.

    messages: (session, n, kind, update): kind is update or chunk. The state is the pending update.
    """

    def step(_, rows, pending):
        out = []
        for n, kind, update in zip(rows["n"], rows["kind"], rows["update"], strict=True):
            if kind == "update":
                pending = update
            elif pending is not None:
                out.append((n, pending))
                pending = None
        return out, pending

    return stateful(messages, "session", "n long, update string", step, "n")


def numbered_ring(messages: DataFrame, size: int = 50) -> DataFrame:
    """(device, id, message): messages (device, n, message) numbered on and on; the state is the last number. The last ``size`` of each micro-batch are kept."""

    def step(_, rows, last):
        last = last or 0
        out = [(last + k, m) for k, m in enumerate(rows["message"], 1)]
        return out[-size:], last + len(out)

    return stateful(messages, "device", "id long, message string", step, "n")


def online_onsets(activations: DataFrame, threshold: float, fps: float = 100.0, pre_avg: int = 0, pre_max: int = 1, combine: float = 0.03) -> DataFrame:
    """(track_id, t): rows at or above the mean of the last rows + threshold, and their maximum, ``combine`` seconds behind the last onset.

    activations: (track_id, idx, x). The state is the last rows and the last onset.
    """

    def step(_, rows, state):
        near, last = state or ([], None)
        out = []
        for i, x in zip(rows["idx"], rows["x"], strict=True):
            near = [*near, float(x)][-(max(pre_avg, pre_max) + 1) :]
            # In order and uncompensated, as SQL adds: sum() rounds otherwise, which decides rows that lie on the threshold.
            mean = reduce(add, near[-(pre_avg + 1) :]) / (pre_avg + 1) if pre_avg else 0.0
            t = i / fps
            if x != 0 and x >= mean + threshold and x >= max(near[-(pre_max + 1) :]) and (last is None or t - last > combine + 1e-12):
                out.append((t,))
                last = t
        return out, (near, last)

    return stateful(activations, "track_id", "t double", step, "idx")


def online_beats(activations: DataFrame, fps: float, low_bpm: float = 55.0, high_bpm: float = 215.0, share: float = 16.0, steadiness: float = 100.0) -> DataFrame:
    """(track_id, t): beats by the forward algorithm of a beat model; the state is its distribution, the last beat and the rows seen."""
    from trackloom.operators import tracking
    from trackloom.operators.tempo import beat_model

    _, model = beat_model(fps, low_bpm, high_bpm, None, steadiness, share)

    def step(_, rows, state):
        model.reset()
        last, seen = 0.0, 0
        if state is not None:
            model.now, last, seen = state
        found, last = tracking.online_beats(model, rows["x"].to_numpy(float), fps, share, high_bpm, last, seen)
        return [(t,) for t in found], (model.now, last, seen + len(rows))

    return stateful(activations, "track_id", "t double", step, "idx")


def online_tempo(activations: DataFrame, fps: float, low_bpm: float = 40.0, high_bpm: float = 250.0, alpha: float = 0.79, seconds: float = 10.0, method: str = "comb") -> DataFrame:
    """(track_id, tau, strength): the interval histogram of the last ``seconds``, after each micro-batch. method: comb or acf.

    The state is the last outputs of the comb filters, or the last activations, and the last rows' credits.
    """
    import numpy as np

    from trackloom.operators.tempo import tau_range

    low, high = tau_range(fps, low_bpm, high_bpm)
    taus = np.arange(low, high + 1)

    def step(_, rows, state):
        past, credits = state or (np.zeros((high + 1, len(taus))) if method == "comb" else np.zeros(high + 1), [])
        for x in rows["x"].to_numpy(float):
            if method == "comb":
                y = x + alpha * past[-taus, np.arange(len(taus))]
                past = np.concatenate([past[1:], y[None]])
                y = np.where(y == y.max(), y, 0)
            else:
                y = x * past[-taus]
                past = np.append(past[1:], x)
            credits = [*credits, y][-int(seconds * fps) :]
        total = np.sum(credits, axis=0) if credits else np.zeros(len(taus))
        return [(int(t), float(s)) for t, s in zip(taus, total, strict=True)], (past, credits)

    return stateful(activations, "track_id", "tau long, strength double", step, "idx")


def session_levels(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Count and sum of x by label and session: events of a label no more than ``gap`` apart."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "label").agg(F.count("*").alias("n"), F.sum("x").alias("x")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "label", "n", "x")
