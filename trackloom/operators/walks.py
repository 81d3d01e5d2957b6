"""The older endless walks: phrases of random length, jumps to segments not played lately, ways out of dead ends.

Choices are drawn by a seeded hash of the track and the draw's number, so a walk is the same on each run. One fold for each track.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame

from trackloom.operators.decode import LENGTHS, pick


def phrase_limit(n: int, duration: float) -> int:
    """The longest phrase at a track's tempo: 48 beats at 120 a minute, a multiple of four."""
    most = round(n / duration * 60 / 120 * 48) if duration > 0 else 48
    return most - most % 4


def older_walk(segments: list[int], following: list[int], candidates: list[list[int]], duration: float, steps: int, seed: int = 1, bars: list[int] | None = None):
    """(beat, seq_len, seq_pos) of steps + 1 positions.

    Without bars phrases are multiples of 4 from 16; with bars they come from LENGTHS (three quarters of them in bars of three), less the
    beats to the next bar, and never outlast the budget of a tenth of the track without a jump. A jump goes to a random candidate outside
    the last quarter of segments played. After a tenth of the track of failures the farthest candidate of another quarter is taken, after
    a fifth (three tenths with bars) the walk starts anew.
    """
    n, draws = len(segments), 0
    most, budget = phrase_limit(n, duration), round(n * 0.1)
    quarter = [int(i // (n / 4.0)) for i in range(n)]
    recent: deque[int] = deque(maxlen=max(1, round((max(segments) + 1) * 0.25)))

    def draw(k: int) -> int:
        nonlocal draws
        draws += 1
        return pick(seed, draws, k)

    lengths = [float(x) for x in LENGTHS if x <= most] if bars else list(range(16, max(most, 17), 4))
    if bars and max(bars) == 3:
        lengths = [x * 0.75 for x in lengths]
    lengths = lengths or [16]
    target = lengths[draw(len(lengths))] - (bars[min(1, n - 1)] + 2 if bars else 0)
    if bars:
        lengths = [x for x in lengths if x <= budget] or lengths[:1]
    cursor = place = since = failed = 0
    yield 0, target, 0
    for _ in range(steps):
        if segments[cursor] not in recent:
            recent.append(segments[cursor])
        place += 1
        if place != target and since < budget:
            cursor = following[cursor]
            since += 1
            yield cursor, target, place
            continue
        fresh = [c for c in candidates[cursor] if segments[c] not in recent]
        if fresh:
            since = failed = 0
            cursor = fresh[draw(len(fresh))]
        else:
            since, failed = since + 1, failed + 1
            far = [c for c in candidates[cursor] if quarter[c] != quarter[cursor]]
            if failed >= 0.1 * n and far:
                since = failed = 0
                cursor = max(far, key=lambda c: (abs(cursor - c), -far.index(c)))
            elif failed >= (0.3 if bars else 0.2) * n:
                since = failed = cursor = 0
            else:
                cursor = following[cursor]
        place, target = 0, lengths[draw(len(lengths))]
        if bars:
            target = min(target - (bars[cursor] + 2), budget - since)
        if since >= budget:
            place = target
        yield cursor, target, place


def older_walks(beats: DataFrame, steps: int, seed: int = 1, with_bars: bool = False) -> DataFrame:
    """Walks over beats (track_id, idx, t, run, next, candidates and, with bars, bar_position); times in seconds from the track's begin."""
    kind = dict(beats.dtypes)["track_id"]

    def work(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("idx")
        n = len(pdf)
        following = [int(x) if x < n else 0 for x in pdf["next"]]
        bars = pdf["bar_position"].tolist() if with_bars else None
        rows = list(older_walk(pdf["run"].tolist(), following, [list(c) for c in pdf["candidates"]], float(pdf["t"].max()), steps, seed + int(key[0]), bars))
        out = pd.DataFrame(rows, columns=["beat", "seq_len", "seq_pos"]).astype({"seq_len": "float64", "seq_pos": "float64"})
        out.insert(0, "step", range(len(out)))
        out.insert(0, "track_id", key[0])
        return out

    return beats.groupBy("track_id").applyInPandas(work, f"track_id {kind}, step long, beat long, seq_len double, seq_pos double")
