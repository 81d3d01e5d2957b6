"""The endless recency-aware walk: one fold per track in a Python worker, parallel over tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame


LENGTHS = (16, 24, 32, 48, 64, 72, 96, 128)


def pick(seed: int, step: int, n: int) -> int:
    """A seeded choice that depends on nothing but its arguments."""
    x = (seed * 0x9E3779B97F4A7C15 + step * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % (1 << 64)
    x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 % (1 << 64)
    return (x >> 32) % n


def walk(starts: list[float], bars: list[int], candidates: list[list[int]], steps: int, seed: int = 1):
    """The endless recency-aware walk: (step, beat, seq_len, seq_pos).

    Emits the cursor, then attempts a jump when the phrase is full or the budget of steps without a jump is spent: of the
    candidates not played for over a quarter of the song (a twentieth when the budget is spent) the longest unplayed, then the
    farthest, then the first. Without one it goes on; at the end a failed attempt goes to the first beat with candidates.
    """
    n = len(starts)
    tempo = n / starts[-1] * 60 if starts[-1] > 0 else 120.0
    most = round(tempo / 120 * 48)
    most -= most % 4
    lengths = [x for x in LENGTHS if x <= most]
    lengths = ([int(x * 0.75) for x in lengths] if max(bars) == 2 else lengths) or [16]
    average = sum(map(len, candidates)) / n or 1.0
    budget = int(min(0.1 * n * 2.5 / average, n / 5))
    connected = next((k for k in range(n) if candidates[k]), 0)
    last: dict[int, int] = {}
    cursor, seq, since, draws = 0, 0, 0, 0

    def target_at(beat: int) -> int:
        nonlocal draws
        draws += 1
        return max(1, lengths[pick(seed, draws, len(lengths))] - bars[beat])

    target = target_at(0)
    for step in range(steps):
        last[cursor] = step
        seq += 1
        yield step, cursor, target, seq
        if seq >= target or since >= budget:
            limit = int(n * (0.05 if since >= budget else 0.25))
            age = lambda c, step=step: min(step - last[c], n) if c in last else n
            open_ = [(age(c), abs(cursor - c), -k, c) for k, c in enumerate(candidates[cursor]) if age(c) > limit]
            if open_:
                cursor, since = max(open_)[3], 0
            else:
                cursor, since = (cursor + 1, since + 1) if cursor + 1 < n else (connected, 1)
            seq, target = 0, target_at(cursor)
            target = min(target, max(1, budget - since))
            if since >= budget:
                seq = target
        else:
            cursor, since = cursor + 1 if cursor + 1 < n else 0, since + 1


def walks(beats: DataFrame, steps: int, seed: int = 1) -> DataFrame:
    """A walk for each track of beats (track_id, idx, t, bar_position, candidates)."""

    def work(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("idx")
        rows = walk(pdf["t"].tolist(), pdf["bar_position"].tolist(), [list(c) for c in pdf["candidates"]], steps, seed + int(key[0]))
        out = pd.DataFrame(list(rows), columns=["step", "beat", "seq_len", "seq_pos"])
        out.insert(0, "track_id", key[0])
        return out

    return beats.groupBy("track_id").applyInPandas(work, "track_id long, step long, beat long, seq_len long, seq_pos long")
