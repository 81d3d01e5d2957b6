"""Frequency scales and units: column functions, and the grids that filterbanks are built on (numpy, on the driver)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

A4 = 440.0
MEL, MEL_BREAK = 1127.01048, 700.0
#: The edges of the critical bands in Hz, and the same with the bands' centres.
BARK = (20, 100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500)
BARK_DOUBLE = (
    20, 50, 100, 150, 200, 250, 300, 350, 400, 450, 510, 570, 630, 700, 770, 840, 920, 1000, 1080, 1170, 1270, 1370, 1480, 1600, 1720, 1850, 2000, 2150, 2320, 2500,
    2700, 2900, 3150, 3400, 3700, 4000, 4400, 4800, 5300, 5800, 6400, 7000, 7700, 8500, 9500, 10500, 12000, 13500, 15500,
)


def hz_to_mel(f: Column) -> Column:
    return MEL * F.ln(f / MEL_BREAK + 1)


def mel_to_hz(m: Column) -> Column:
    return MEL_BREAK * (F.exp(m / MEL) - 1)


def hz_to_bark(f: Column) -> Column:
    """Negative for the lowest frequencies, as the formula is."""
    return 26.81 / (1 + 1960.0 / f) - 0.53


def bark_to_hz(z: Column) -> Column:
    return 1960.0 / (26.81 / (z + 0.53) - 1)


def hz_to_erb(f: Column) -> Column:
    return 21.4 * F.log10(1 + 4.37 * f / 1000.0)


def erb_to_hz(e: Column) -> Column:
    return (F.pow(F.lit(10.0), e / 21.4) - 1) * 1000.0 / 4.37


def hz_to_midi(f: Column, reference: float = A4) -> Column:
    return 12 * F.log2(f / reference) + 69


def midi_to_hz(m: Column, reference: float = A4) -> Column:
    return F.pow(F.lit(2.0), (m - 69) / 12) * reference


def tick_to_second(tick: Column, per_beat: int = 480, tempo: Column | int = 500_000) -> Column:
    """tempo: microseconds a quarter note."""
    return tick * (tempo / F.lit(1e6) / per_beat)


def second_to_tick(second: Column, per_beat: int = 480, tempo: Column | int = 500_000) -> Column:
    return F.rint(second / (tempo / F.lit(1e6) / per_beat)).cast("long")


def bpm_to_tempo(bpm: Column, denominator: int = 4) -> Column:
    """Microseconds a quarter note; beats are of the signature's denominator."""
    return F.rint(60e6 * denominator / 4 / bpm).cast("long")


def tempo_to_bpm(tempo: Column, denominator: int = 4) -> Column:
    return 60e6 * denominator / 4 / tempo


def tick_to_beat(tick: Column, per_beat: int = 480, denominator: int = 4) -> Column:
    return tick / (4.0 * per_beat / denominator)


def beat_to_tick(beat: Column, per_beat: int = 480, denominator: int = 4) -> Column:
    return F.rint(beat * 4.0 * per_beat / denominator).cast("long")


def gain(x: Column, decibel: float) -> Column:
    """Amplitudes louder by so many decibels; softer if negative."""
    return x * 10 ** (decibel / 20)


def volume_to_decibel(volume: Column) -> Column:
    """-80 below 0.001."""
    return F.when(volume < 0.001, -80.0).otherwise(20 * F.log10(volume))


def wrapped(phase: Column) -> Column:
    """In [-pi, pi)."""
    return F.pmod(phase + np.pi, F.lit(2 * np.pi)) - np.pi


# --- grids --------------------------------------------------------------------------------------------------------------


def limited(grid, low: float, high: float) -> np.ndarray:
    grid = np.asarray(grid, float)
    return grid[(grid >= low) & (grid <= high)]


def mel_grid(n: int, low: float, high: float) -> np.ndarray:
    ends = MEL * np.log1p(np.array([low, high]) / MEL_BREAK)
    return MEL_BREAK * np.expm1(np.linspace(*ends, n) / MEL)


def bark_grid(low: float = 20.0, high: float = 15_500.0, double: bool = False) -> np.ndarray:
    return limited(BARK_DOUBLE if double else BARK, low, high)


def log_grid(per_octave: int, low: float, high: float, reference: float = A4) -> np.ndarray:
    """Equal ratios around the reference."""
    first, last = np.floor(np.log2(low / reference) * per_octave), np.ceil(np.log2(high / reference) * per_octave)
    return limited(reference * 2 ** (np.arange(first, last) / per_octave), low, high)


def semitone_grid(low: float, high: float, reference: float = A4) -> np.ndarray:
    return log_grid(12, low, high, reference)


def bin_grid(bins: int, sample_rate: float) -> np.ndarray:
    """Centre frequencies of a transform's bins below the Nyquist frequency."""
    return np.arange(bins) * sample_rate / (2 * bins)


def nearest_bins(frequencies, grid, unique: bool = False) -> np.ndarray:
    """Index of the nearest grid frequency, the higher one on ties."""
    frequencies, grid = np.asarray(frequencies, float), np.asarray(grid, float)
    middles = (grid[1:] + grid[:-1]) / 2
    found = np.searchsorted(middles, frequencies, side="right")
    return np.unique(found) if unique else found
