"""Elliptic band-pass filters, designed from their specification, and the energies of semitone bands that they make.

The low-pass prototype follows from Jacobi's elliptic functions by descending Landen transformations (Orfanidis, Lecture Notes on
Elliptic Filter Design, 2006); the band-pass from it by the usual frequency and bilinear transformations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from trackloom.functions.pitch import A4, semitone_grid
from trackloom.operators.hmm import by_track


def landen(k: float, steps: int = 7) -> list[float]:
    """Descending moduli."""
    out = []
    for _ in range(steps):
        k = (k / (1 + np.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def cd(u, k: float):
    """cd(u K, k)."""
    w = np.cos(np.asarray(u, complex) * np.pi / 2)
    for v in reversed(landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def sn(u, k: float):
    w = np.sin(np.asarray(u, complex) * np.pi / 2)
    for v in reversed(landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def inverse_sn(w: complex, k: float) -> complex:
    """u with sn(u K, k) = w."""
    last = k
    for v in landen(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (w * last) ** 2 + 0j)))
        last = v
    return 2 / np.pi * np.arcsin(w + 0j)


def modulus(order: int, k1: float) -> float:
    """The selectivity that an order reaches with the discrimination k1, by the degree equation."""
    half = order // 2
    u = (2 * np.arange(1, half + 1) - 1) / order
    kp1 = np.sqrt(1 - k1 * k1)
    kp = kp1**order * float(np.prod(np.real(sn(u, kp1)) ** 4))
    return float(np.sqrt(1 - kp * kp))


def prototype(order: int, ripple: float, rejection: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the analogue low-pass with its pass band up to 1; ripple and rejection in decibels."""
    e1, e2 = np.sqrt(10 ** (ripple / 10) - 1), np.sqrt(10 ** (rejection / 10) - 1)
    k1 = e1 / e2
    k = modulus(order, k1)
    half, odd = order // 2, order % 2
    u = (2 * np.arange(1, half + 1) - 1) / order
    zeros = 1j / (k * np.real(cd(u, k)))
    v0 = np.real(-1j * inverse_sn(1j / e1, k1)) / order
    poles = 1j * cd(u - 1j * v0, k)
    zeros, poles = np.concatenate([zeros, zeros.conj()]), np.concatenate([poles, poles.conj()])
    if odd:
        poles = np.append(poles, 1j * sn(1j * v0, k))
    top = 1.0 if odd else 10 ** (-ripple / 20)
    return zeros, poles, float(np.real(top * np.prod(-poles) / np.prod(-zeros)))


def band_pass(order: int, ripple: float, rejection: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the digital filter; low and high as shares of the Nyquist frequency."""
    a, b = 2 * np.tan(np.pi * np.array([low, high]) / 2)
    width, centre = b - a, np.sqrt(a * b)
    z, p, g = prototype(order, ripple, rejection)

    def split(x):
        x = x * width / 2
        r = np.sqrt(x * x - centre**2 + 0j)
        return np.concatenate([x + r, x - r])

    extra = len(p) - len(z)
    z, p, g = np.concatenate([split(z), np.zeros(extra)]), split(p), g * width**extra
    g = g * np.real(np.prod(2 - z) / np.prod(2 - p))
    return np.concatenate([(2 + z) / (2 - z), -np.ones(len(p) - len(z))]), (2 + p) / (2 - p), float(g)


def sections(z: np.ndarray, p: np.ndarray, g: float) -> np.ndarray:
    """Rows (b0, b1, b2, a1, a2) of second-order sections: each pair of poles with the zeros nearest to it."""
    poles = sorted([x for x in p if x.imag >= -1e-12], key=lambda x: -abs(x))
    left, out = [x for x in z if x.imag >= -1e-12], []
    for pole in poles[: len(p) // 2]:
        near = min(left, key=lambda x: abs(x - pole))
        left.remove(near)
        out.append([1, -2 * near.real, abs(near) ** 2, -2 * pole.real, abs(pole) ** 2])
    out = np.array(out)
    out[0, :3] *= g
    return out


def response(sos: np.ndarray, frequency) -> np.ndarray:
    """Magnitudes at shares of the Nyquist frequency."""
    w = np.exp(-1j * np.pi * np.asarray(frequency, float))
    return np.abs(np.prod([(b0 + b1 * w + b2 * w * w) / (1 + a1 * w + a2 * w * w) for b0, b1, b2, a1, a2 in sos], axis=0))


def run(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sections one after the other; a linear recursion."""
    for b0, b1, b2, a1, a2 in sos:
        y, s1, s2 = np.empty(len(x)), 0.0, 0.0
        for n, v in enumerate(x.tolist()):
            o = b0 * v + s1
            s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
            y[n] = o
        x = y
    return x


def forth_and_back(sos: np.ndarray, x: np.ndarray, pad: int = 27) -> np.ndarray:
    """Without delay: forward, then backward, the ends mirrored through their last value."""
    pad = min(pad, len(x) - 1)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    y = run(sos, run(sos, wide)[::-1])[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def semitone_filters(low: float = 27.5, high: float = 4200.0, order: int = 4, ripple: float = 1.0, rejection: float = 50.0, quality: float = 25.0, reference: float = A4) -> list[tuple[float, int, np.ndarray]]:
    """(frequency, sample rate, sections) of each semitone: 882 samples a second below 250 Hz, 22050 above 2000 Hz, else 4410."""
    out = []
    for f in semitone_grid(low, high, reference):
        rate = 882 if f < 250 else 22_050 if f > 2000 else 4410
        half = f / quality / 2
        out.append((float(f), rate, sections(*band_pass(order, ripple, rejection, (f - half) * 2 / rate, (f + half) * 2 / rate))))
    return out


def semitone_energies(signal: DataFrame, sample_rate: float, fps: float = 50.0, low: float = 27.5, high: float = 4200.0) -> DataFrame:
    """(track_id, frame, m): energies of the semitone bands in frames of two hops; the signal is brought to each band's rate by linear interpolation."""
    filters = semitone_filters(low, high)

    def kernel(_, pdf):
        x = pdf["x"].to_numpy(float)
        count = int(np.round(len(x) * fps / sample_rate)) + 1
        out, at = np.zeros((count, len(filters))), {}
        for k, (_f, rate, sos) in enumerate(filters):
            if rate not in at:
                at[rate] = np.interp(np.arange(0, len(x), sample_rate / rate), np.arange(len(x)), x)
            y = forth_and_back(sos, at[rate]) ** 2 / rate * 22_050
            size, total = int(np.round(2 * rate / fps)), np.concatenate([[0], np.cumsum(y)])
            first = np.floor(np.arange(count) * rate / fps).astype(int) - size // 2
            out[:, k] = total[np.clip(first + size, 0, len(y))] - total[np.clip(first, 0, len(y))]
        return {"frame": np.arange(count), "m": list(out)}

    return by_track(signal, kernel, "frame long, m array<double>")
