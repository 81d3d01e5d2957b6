"""Queries on signals, spectra, filterbanks, onsets, tempo, decoders and networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import pitch
from trackloom.nn import layers
from trackloom.nn.models import predict
from trackloom.operators import filterbanks, hmm, onsets, sequence, signals, spectra, tempo, tracking
from trackloom.plans.queries import BEATS, W, beats, r6, register
from trackloom.sources.tracks import event_tracks, spectrum_tracks, table

RATE = 44_100.0
GRID = pitch.bin_grid(64, RATE)
SPEC = "s AS (SELECT CAST(label AS BIGINT) AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), f AS (SELECT track_id, frame, k - 1 AS k, abs(e[k]) AS m, e[k] * 3.0 AS p FROM s, range(1, 65) q(k))"
BACK = SPEC + ", g AS (SELECT *, lag(m) OVER v AS m1, lag(p) OVER v AS p1, lag(p, 2) OVER v AS p2, max(m) OVER (PARTITION BY track_id, frame ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mx FROM f WINDOW v AS (PARTITION BY track_id, k ORDER BY frame)), h AS (SELECT *, lag(mx) OVER (PARTITION BY track_id, k ORDER BY frame) AS mx1 FROM g)"
WRAP = "(({0} + pi()) - 2 * pi() * floor(({0} + pi()) / (2 * pi())) - pi())"


def spectrum(name: str, sql: str | None, make):
    register(name, sql)(lambda spark, d: make(spectrum_tracks(table(spark, d, "embeddings"))))


def r5(c):
    return F.round(c, 5)


def onset(name: str, sql: str, **options):
    spectrum(name, f"WITH {BACK} SELECT track_id, frame, round({sql}, 5) AS y FROM h GROUP BY track_id, frame", lambda s: spectra.onset_function(s, NAMES.get(name, name), **options).withColumn("y", r5("y")))


NAMES = {"hfc": "high_frequency_content", "mkl": "modified_kullback_leibler"}
onset("hfc", "avg(m * k)")
onset("spectral_flux", "sum(coalesce(greatest(m - m1, 0), 0))")
onset("spectral_diff", "sum(coalesce(greatest(m - m1, 0) * greatest(m - m1, 0), 0))")
onset("mkl", "avg(coalesce(ln(1 + m / (m1 + 0.001)), 0))", epsilon=0.001)
onset("superflux", "sum(coalesce(greatest(m - mx1, 0), 0))")
SECOND = f"coalesce({WRAP.format('(p - 2 * p1 + p2)')}, 0)"
onset("phase_deviation", f"avg(abs({SECOND}))")
onset("weighted_phase_deviation", f"avg(abs({SECOND} * m))")
onset("normalized_weighted_phase_deviation", f"avg(abs({SECOND} * m)) / (avg(m) + 2.220446049250313e-16)")
CD = "CASE WHEN m1 IS NULL THEN m ELSE sqrt(greatest(m * m + m1 * m1 - 2 * m * m1 * cos(p - CASE WHEN p2 IS NULL THEN 0 ELSE 2 * p1 - p2 END), 0)) END"
onset("complex_domain", f"sum({CD})")
onset("rectified_complex_domain", f"sum(CASE WHEN m - m1 > 0 THEN {CD} ELSE 0 END)")
LGD = "CASE WHEN lead(p) OVER k IS NULL THEN 0 WHEN abs(lead(p) OVER k - p) < pi() THEN p - lead(p) OVER k ELSE -(CASE WHEN {w} = -pi() AND lead(p) OVER k - p > 0 THEN pi() ELSE {w} END) END".format(w=WRAP.format("(lead(p) OVER k - p)"))
spectrum("group_delay", f"WITH {SPEC} SELECT track_id, frame, CAST(k AS INT) AS k, round({LGD}, 6) AS d FROM f WINDOW k AS (PARTITION BY track_id, frame ORDER BY k)", lambda s: s.select("track_id", "frame", F.posexplode(spectra.group_delay("phase")).alias("k", "d")).withColumn("d", r6("d")))
spectrum("complex_flux", f"""WITH {BACK}, gd AS (SELECT *, abs({LGD}) / pi() AS gd FROM h WINDOW k AS (PARTITION BY track_id, frame ORDER BY k)),
tm AS (SELECT *, max(gd) OVER (PARTITION BY track_id, k ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS tg FROM gd), mk AS (SELECT *, min(tg) OVER (PARTITION BY track_id, frame ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mask FROM tm)
SELECT track_id, frame, round(sum(coalesce(greatest(m - mx1, 0), 0) * mask), 5) AS y FROM mk GROUP BY track_id, frame""", lambda s: spectra.complex_flux(s).withColumn("y", r5("y")))
spectrum("spec_diff", f"WITH {BACK} SELECT track_id, frame, CAST(k AS INT) AS k, round(coalesce(m - mx1, 0), 6) AS d FROM h", lambda s: spectra.difference(s, bins=3, positive=False).select("track_id", "frame", F.posexplode("d").alias("k", "d")).withColumn("d", r6("d")))
spectrum("log_spectrum", f"WITH {SPEC} SELECT track_id, frame, CAST(k AS INT) AS k, round(log10(5 * m + 1), 6) AS y FROM f", lambda s: s.select("track_id", "frame", F.posexplode(filterbanks.logged("m", 5.0, 1.0)).alias("k", "y")).withColumn("y", r6("y")))
spectrum("correlation_diff", None, spectra.correlation_diff)
spectrum("hpss", None, lambda s: spectra.harmonic_percussive(s, 5, 5))

# Triangles on three consecutive corners, narrow ones of a single bin; weights add up to 1 for each band.
TRI = "tr AS (SELECT row_number() OVER (ORDER BY c) - 1 AS band, c AS a0, lead(c) OVER (ORDER BY c) AS b0, lead(c, 2) OVER (ORDER BY c) AS c0 FROM co QUALIFY c0 IS NOT NULL), tt AS (SELECT band, a0 AS a, CASE WHEN c0 - a0 < 2 THEN a0 ELSE b0 END AS b, CASE WHEN c0 - a0 < 2 THEN a0 + 1 ELSE c0 END AS c FROM tr), wt AS (SELECT band, k, CASE WHEN k < b THEN (k - a) * 1.0 / (b - a) ELSE 1 - (k - b) * 1.0 / (c - b) END AS w FROM tt, range(0, 64) q(k) WHERE k >= a AND k < c), wn AS (SELECT band, k, w / sum(w) OVER (PARTITION BY band) AS w FROM wt)"
BIN = f"least(CAST(floor({{0}} / {RATE / 128} + 0.5) AS BIGINT), 63)"
MEL = f"co AS (SELECT DISTINCT {BIN.format('700 * (exp((ln(1 + 20.0 / 700) + i * (ln(1 + 17000.0 / 700) - ln(1 + 20.0 / 700)) / 21))  - 1)')} AS c FROM range(0, 22) q(i)), {TRI}"
LOGS = f"co AS (SELECT DISTINCT {BIN.format('440 * pow(2, i / 3.0)')} AS c FROM range(-40, 40) q(i) WHERE 440 * pow(2, i / 3.0) BETWEEN 300 AND 17000), {TRI}"
APPLY = "SELECT track_id, frame, CAST(band AS INT) AS band, round(sum(m * w), 6) AS y FROM f JOIN wn USING (k) GROUP BY ALL"


def banded(bank: np.ndarray):
    return lambda s: s.select("track_id", "frame", F.posexplode(filterbanks.filtered("m", bank)).alias("band", "y")).withColumn("y", r6("y"))


MEL_BANK = filterbanks.mel_bank(GRID, 20)
spectrum("filterbank_mel", f"WITH {SPEC}, {MEL} {APPLY}", banded(MEL_BANK))
spectrum("filterbank_log", f"WITH {SPEC}, {LOGS} {APPLY}", banded(filterbanks.log_bank(GRID, 3, 300.0, 17_000.0)))
BOX = "bx AS (SELECT row_number() OVER (ORDER BY c) - 1 AS band, c AS a, lead(c) OVER (ORDER BY c) AS b FROM co QUALIFY b IS NOT NULL), wn AS (SELECT band, k, 1.0 / (b - a) AS w FROM bx, range(0, 64) q(k) WHERE k >= a AND k < b)"
spectrum("filterbank_bark", f"WITH {SPEC}, co AS (SELECT DISTINCT {BIN.format('z')} AS c FROM (SELECT unnest([{', '.join(map(str, pitch.BARK))}]) AS z)), {BOX} {APPLY}", banded(filterbanks.bark_bank(GRID)))
spectrum("multiband", f"WITH {SPEC}, cc AS (SELECT i, {BIN.format('z')} AS c FROM (SELECT unnest([30, 500, 2000, 8000, 17000]) AS z, unnest(range(0, 5)) AS i)), bx AS (SELECT i AS band, c AS a, lead(c) OVER (ORDER BY i) AS b FROM cc QUALIFY b IS NOT NULL), wn AS (SELECT band, k, 1.0 / (b - a) AS w FROM bx, range(0, 64) q(k) WHERE k >= a AND k < b) {APPLY}", banded(filterbanks.crossover_bank(GRID, [500, 2000, 8000])))
HZ = f"k * {RATE / 128}"
spectrum("pitch_class_profile", f"WITH {SPEC} SELECT track_id, frame, CAST(c AS INT) AS band, round(coalesce(sum(CASE WHEN k > 0 AND {HZ} BETWEEN 100 AND 5000 AND ((CAST(round_even(12 * log2(greatest({HZ}, 1) / 440), 0) AS BIGINT) % 12) + 12) % 12 = c THEN m END), 0), 6) AS y FROM f, range(0, 12) q(c) GROUP BY ALL", banded(filterbanks.pitch_class_bank(GRID)))
PLACE = f"(36 * log2(greatest({HZ}, 1) / 440) - 36 * floor(log2(greatest({HZ}, 1) / 440)))"
APART = f"(({PLACE} - c + 18) - 36 * floor(({PLACE} - c + 18) / 36) - 18)"
spectrum("harmonic_pitch_class", f"WITH {SPEC} SELECT track_id, frame, CAST(c AS INT) AS band, round(sum(CASE WHEN k > 0 AND {HZ} BETWEEN 100 AND 5000 AND abs({APART}) < 2 THEN m * pow(cos({APART} * pi() / 4), 2) ELSE 0 END), 6) AS y FROM f, range(0, 36) q(c) GROUP BY ALL", banded(filterbanks.harmonic_pitch_class_bank(GRID)))
spectrum("mfcc", f"WITH {SPEC}, {MEL}, y AS ({APPLY.replace('round(sum(m * w), 6)', 'log10(sum(m * w) + 1)')}), n AS (SELECT count(DISTINCT band) AS n FROM wn) SELECT track_id, frame, CAST(c AS INT) AS k, round(sum(y * sqrt(CASE WHEN c = 0 THEN 1.0 ELSE 2.0 END / n) * cos(pi() * c * (2 * band + 1) / (2 * n))), 5) AS y FROM y, n, range(0, 8) q(c) GROUP BY ALL", lambda s: s.select("track_id", "frame", F.posexplode(spectra.cepstrum(filterbanks.logged(filterbanks.filtered("m", MEL_BANK)), MEL_BANK.shape[1], 8)).alias("k", "y")).withColumn("y", r5("y")))
spectrum("compressed_chroma", f"WITH {SPEC}, c AS (SELECT track_id, frame, (k + 21) % 12 AS c, sum(log10(100 * m + 1)) AS y FROM f GROUP BY ALL) SELECT track_id, frame, CAST(c AS INT) AS c, round(CASE WHEN sqrt(sum(y * y) OVER w) < 0.001 THEN 1 / sqrt(12) ELSE y / sqrt(sum(y * y) OVER w) END, 6) AS y FROM c WINDOW w AS (PARTITION BY track_id, frame)", lambda s: s.select("track_id", "frame", F.posexplode(spectra.compressed_chroma("m")).alias("c", "y")).withColumn("y", r6("y")))
DEV = f"(12 * log2(greatest({HZ}, 1) / 440) - round_even(12 * log2(greatest({HZ}, 1) / 440), 0))"
spectrum("tuning_frequency", f"WITH {SPEC}, c AS (SELECT track_id, floor(({DEV} + 0.5 + 0.5 / 15) / ((1 + 1.0 / 15) / 15)) AS c, sum(m) AS w FROM f WHERE k > 0 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, c) AS r FROM c) SELECT track_id, round(440 * pow(2, (-0.5 - 0.5 / 15 + (c + 0.5) * (1 + 1.0 / 15) / 15) / 12), 6) AS tuning FROM o WHERE r = 1", lambda s: spectra.tuning(s, GRID).withColumn("tuning", r6("tuning")))

# --- scales and units --------------------------------------------------------------------------------------------------------------

SCALES = {
    "mel": (pitch.hz_to_mel, "1127.01048 * ln(f / 700 + 1)"), "mel_back": (lambda f: pitch.mel_to_hz(pitch.hz_to_mel(f)), "f"), "bark": (pitch.hz_to_bark, "26.81 / (1 + 1960 / f) - 0.53"),
    "bark_back": (lambda f: pitch.bark_to_hz(pitch.hz_to_bark(f)), "f"), "erb": (pitch.hz_to_erb, "21.4 * log10(1 + 4.37 * f / 1000)"), "erb_back": (lambda f: pitch.erb_to_hz(pitch.hz_to_erb(f)), "f"),
    "midi": (pitch.hz_to_midi, "12 * log2(f / 440) + 69"), "midi_back": (lambda f: pitch.midi_to_hz(pitch.hz_to_midi(f)), "f"), "louder": (lambda f: pitch.gain(f, 6.0), "f * pow(10, 0.3)"),
    "volume": (lambda f: pitch.volume_to_decibel(f / 1e6), "CASE WHEN f / 1e6 < 0.001 THEN -80 ELSE 20 * log10(f / 1e6) END"), "wrapped": (pitch.wrapped, WRAP.format("f")),
}
register("pitch_scales", "WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS f FROM part) SELECT p_partkey, " + ", ".join(f"round({sql}, 5) AS {n}" for n, (_, sql) in SCALES.items()) + " FROM p")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", *[r5(f(F.col("p_retailprice").cast("double"))).alias(n) for n, (f, _) in SCALES.items()])
)
TICKS = {
    "second": (lambda q, t: pitch.tick_to_second(q * 100, 480, t), "q * 100 * t / 1e6 / 480"), "tick": (lambda q, t: pitch.second_to_tick(q, 480, t), "CAST(round_even(q / (t / 1e6 / 480), 0) AS BIGINT)"),
    "tempo": (lambda q, t: pitch.bpm_to_tempo(q * 5, 8), "CAST(round_even(60e6 * 2 / (q * 5), 0) AS BIGINT)"), "bpm": (lambda q, t: F.round(pitch.tempo_to_bpm(t, 8), 6), "round(60e6 * 2 / t, 6)"),
    "beat": (lambda q, t: F.round(pitch.tick_to_beat(q * 100, 480, 8), 6), "round(q * 100 / (4.0 * 480 / 8), 6)"), "beat_tick": (lambda q, t: pitch.beat_to_tick(q, 480, 8), "CAST(round_even(q * 4.0 * 480 / 8, 0) AS BIGINT)"),
}
register("midi_ticks", "WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, 400000 + 1000 * l_linenumber AS t FROM lineitem) SELECT l_orderkey, l_linenumber, round(" + ", ".join([TICKS["second"][1] + ", 9) AS second", *[f"{sql} AS {n}" for n, (_, sql) in TICKS.items() if n != "second"]]) + " FROM p")(
    lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[(F.round(f(F.col("l_quantity").cast("double"), F.lit(400000) + 1000 * F.col("l_linenumber")), 9) if n == "second" else f(F.col("l_quantity").cast("double"), F.lit(400000) + 1000 * F.col("l_linenumber"))).alias(n) for n, (f, _) in TICKS.items()])
)

# --- signals ------------------------------------------------------------------------------------------------------------------------

QUIET = BEATS + ", z AS (SELECT track_id, idx, CASE WHEN x < 200 THEN 0 ELSE x END AS x FROM b)"


def quiet(b):
    return b.select("track_id", "idx", F.when(F.col("x") < 200, 0.0).otherwise(F.col("x")).alias("x"))


beats("trim_zero", f"WITH {QUIET}, l AS (SELECT *, min(CASE WHEN x <> 0 THEN idx END) OVER (PARTITION BY track_id) AS lo, max(CASE WHEN x <> 0 THEN idx END) OVER (PARTITION BY track_id) AS hi FROM z) SELECT track_id, idx, x FROM l WHERE idx BETWEEN lo AND hi", lambda b: signals.trim(quiet(b)))
beats("hamming_smooth", f"WITH {BEATS}, k AS (SELECT k, 0.54 - 0.46 * cos(2 * pi() * k / 4) AS w FROM range(0, 5) q(k)) SELECT a.track_id, a.idx, round(sum(c.x * w), 6) AS smooth FROM b a CROSS JOIN k JOIN b c ON c.track_id = a.track_id AND c.idx = a.idx - (k - 2) GROUP BY ALL", lambda b: signals.hamming_smooth(b, 5).select("track_id", "idx", r6("smooth").alias("smooth")))
beats("normalize_signal", f"WITH {BEATS} SELECT track_id, idx, round(x / max(abs(x)) OVER (PARTITION BY track_id), 6) AS x FROM b", lambda b: signals.normalize(b).select("track_id", "idx", r6("x").alias("x")))
beats("resample", f"WITH {BEATS}, n AS (SELECT *, lead(x) OVER w AS nx FROM b {W}), g AS (SELECT track_id, n.idx, k, x, nx FROM n, range(0, 400) q(k) WHERE (nx IS NOT NULL AND k >= n.idx * 1.6 AND k < (n.idx + 1) * 1.6) OR (nx IS NULL AND k = n.idx * 1.6)) SELECT track_id, k AS idx, round(x + coalesce(nx - x, 0) * (k / 1.6 - idx), 5) AS x FROM g", lambda b: signals.resample(b, 1.6).select("track_id", "idx", r5("x").alias("x")))
FRAMES = BEATS + ", n AS (SELECT track_id, count(*) AS n FROM b GROUP BY track_id), fr AS (SELECT track_id, k AS frame, CAST(floor(k * 3.5) AS BIGINT) - 4 AS start FROM n, range(0, 200) q(k) WHERE k < ceil(n / 3.5)), sm AS (SELECT fr.track_id, frame, p, coalesce(x, 0) AS x FROM fr CROSS JOIN range(0, 8) q(p) LEFT JOIN b ON b.track_id = fr.track_id AND b.idx = start + p)"
beats("frame_signal", f"WITH {FRAMES} SELECT track_id, frame, round(max(CASE WHEN p = 0 THEN x END), 6) AS first, round(max(CASE WHEN p = 7 THEN x END), 6) AS last, round(sum(x * x), 4) AS energy, round(sqrt(avg(x * x)), 6) AS rms, round(CASE WHEN sum(x * x) > 0 THEN 20 * log10(sqrt(avg(x * x))) ELSE -1.7976931348623157e308 END, 6) AS level FROM sm GROUP BY ALL", lambda b: signals.frames(b, 8, 3.5).select("track_id", "frame", r6(F.get("samples", 0)).alias("first"), r6(F.get("samples", 7)).alias("last"), F.round(signals.energy("samples"), 4).alias("energy"), r6(signals.root_mean_square("samples")).alias("rms"), r6(signals.sound_pressure("samples")).alias("level")))
beats("stft", f"WITH {FRAMES}, wn AS (SELECT p, 0.5 - 0.5 * cos(2 * pi() * p / 7) AS w FROM range(0, 8) q(p)) SELECT track_id, frame, CAST(k AS INT) AS k, round(sqrt(pow(sum(x * w * cos(2 * pi() * k * p / 8)), 2) + pow(sum(x * w * sin(2 * pi() * k * p / 8)), 2)), 4) AS m FROM sm JOIN wn USING (p) CROSS JOIN range(0, 4) q(k) GROUP BY ALL", lambda b: spectra.stft(signals.frames(b, 8, 3.5)).select("track_id", "frame", F.posexplode(spectra.magnitude("re", "im")).alias("k", "m")).withColumn("m", F.round("m", 4)))
register("mono_mix", "SELECT vec_id, round(list_avg(CAST(embedding AS DOUBLE[])), 7) AS mean, round(CAST(embedding[4] AS DOUBLE), 7) AS fourth FROM embeddings")(lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.round(signals.mono("embedding"), 7).alias("mean"), F.round(signals.mono("embedding", 3).cast("double"), 7).alias("fourth")))
register("segment_axis", "WITH w AS (SELECT vec_id, CAST(k AS INT) AS k, embedding[k * 10 + 1:k * 10 + 16] AS s FROM embeddings, range(0, 6) q(k) WHERE k * 10 + 16 <= 64) SELECT vec_id, k, round(list_sum(CAST(s AS DOUBLE[])), 6) AS total FROM w")(
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.posexplode(signals.segments(F.transform("embedding", lambda x: x.cast("double")), 16, 10)).alias("k", "s")).select("vec_id", "k", r6(spectra.total(F.col("s"))).alias("total"))
)

# --- peaks, events --------------------------------------------------------------------------------------------------------------------

PICKED = BEATS + ", n AS (SELECT *, sum(x) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) / 5 AS av FROM b), dd AS (SELECT *, CASE WHEN x >= av + 50 THEN x ELSE 0 END AS d FROM n), pp AS (SELECT *, max(d) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS top FROM dd), pk AS (SELECT track_id, idx, x FROM pp WHERE d = top AND d <> 0)"
beats("peaks_onset", f"WITH {PICKED} SELECT track_id, idx, x FROM pk", lambda b: onsets.peaks(b, 50, 0, 3, 1, 2, 1).select("track_id", "idx", "x"))
beats("onset_pick", f"WITH RECURSIVE {PICKED}, t AS (SELECT track_id, idx / 10.0 + 0.05 AS t FROM pk), fold AS (SELECT track_id, min(t) AS t FROM t GROUP BY track_id UNION ALL SELECT t.track_id, min(t.t) FROM fold JOIN t ON t.track_id = fold.track_id AND t.t - fold.t > 0.3 + 1e-12 GROUP BY t.track_id, fold.t) SELECT track_id, round(t, 6) AS t FROM fold", lambda b: onsets.onsets(b, 10.0, 50.0, 0.0, 0.3, 0.1, 0.2, 0.1, 0.3, 0.05).select("track_id", r6("t").alias("t")))
beats("combine_left", f"WITH RECURSIVE {BEATS}, fold AS (SELECT track_id, min(t) AS t FROM b GROUP BY track_id UNION ALL SELECT b.track_id, min(b.t) FROM fold JOIN b ON b.track_id = fold.track_id AND b.t - fold.t > 7200 + 1e-12 GROUP BY b.track_id, fold.t) SELECT track_id, round(t, 5) AS t FROM fold", lambda b: onsets.combined(b, 7200, "left").withColumn("t", r5("t")))
beats("combine_mean", f"WITH RECURSIVE {BEATS}, fold AS (SELECT track_id, idx, t AS m, 0 AS grp FROM b WHERE idx = 0 UNION ALL SELECT b.track_id, b.idx, CASE WHEN b.t - f.m <= 7200 + 1e-12 THEN 0.5 * (f.m + b.t) ELSE b.t END, CASE WHEN b.t - f.m <= 7200 + 1e-12 THEN f.grp ELSE f.grp + 1 END FROM fold f JOIN b ON b.track_id = f.track_id AND b.idx = f.idx + 1) SELECT track_id, round(arg_max(m, idx), 3) AS t FROM fold GROUP BY track_id, grp", lambda b: onsets.combined(b, 7200, "mean").withColumn("t", F.round("t", 3)))
beats("peaks_merge", f"WITH RECURSIVE {BEATS}, pk AS (SELECT track_id, idx, row_number() OVER (PARTITION BY track_id ORDER BY idx) AS r FROM b WHERE x > 150), fold AS (SELECT track_id, r, CAST(idx AS DOUBLE) AS m, 1 AS c, 0 AS grp FROM pk WHERE r = 1 UNION ALL SELECT p.track_id, p.r, CASE WHEN p.idx - f.m <= 1 THEN f.m + (p.idx - f.m) / (f.c + 1) ELSE p.idx END, CASE WHEN p.idx - f.m <= 1 THEN f.c + 1 ELSE 1 END, CASE WHEN p.idx - f.m <= 1 THEN f.grp ELSE f.grp + 1 END FROM fold f JOIN pk p ON p.track_id = f.track_id AND p.r = f.r + 1) SELECT track_id, CAST(floor(arg_max(m, r) + 0.5) AS BIGINT) AS idx FROM fold GROUP BY track_id, grp", lambda b: onsets.merged(b.where("x > 150")))
beats("quantize_length", f"WITH {BEATS}, s AS (SELECT track_id, t - min(t) OVER (PARTITION BY track_id) AS t FROM b) SELECT DISTINCT track_id, CAST(round_even((t + 1800) / 3600, 0) AS BIGINT) AS frame FROM s WHERE t < (500 - 0.5) * 3600", lambda b: onsets.quantized(b.withColumn("t", F.col("t") - F.min("t").over(sequence.whole())), 1 / 3600, 500, 1800.0))
NOTES = "no AS (SELECT CAST(l_suppkey AS BIGINT) AS track_id, l_orderkey % 97 / 8.0 AS onset, CAST(l_linenumber AS BIGINT) AS pitch, l_discount * 20 AS duration, CAST(l_quantity AS DOUBLE) AS velocity FROM lineitem)"


def note_rows(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").cast("long").alias("track_id"), (F.col("l_orderkey") % 97 / 8.0).alias("onset"), F.col("l_linenumber").cast("long").alias("pitch"), (F.col("l_discount") * 20).alias("duration"), F.col("l_quantity").cast("double").alias("velocity"))


register("quantize_notes", f"WITH {NOTES}, g AS (SELECT track_id, onset, velocity, pitch, unnest(range(CAST(round_even(onset * 10, 0) AS BIGINT), CAST(round_even((onset + duration) * 10, 0) AS BIGINT) + 1)) AS frame FROM no), o AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame, pitch ORDER BY onset DESC, velocity DESC) AS r FROM g WHERE frame < 100 AND pitch < 6) SELECT track_id, frame, pitch, velocity FROM o WHERE r = 1")(lambda spark, d: onsets.quantized_notes(note_rows(spark, d), 10.0, 100, 6))

# --- tempo -----------------------------------------------------------------------------------------------------------------------------

ACF = BEATS + ", h AS (SELECT a.track_id, tau, sum(abs(a.x * c.x)) AS s FROM b a CROSS JOIN range(3, 15) q(tau) JOIN b c ON c.track_id = a.track_id AND c.idx = a.idx - tau GROUP BY ALL)"
beats("tempo_hist_range", f"WITH {ACF} SELECT track_id, tau, round(s, 6) AS strength FROM h", lambda b: tempo.histogram_acf(b, 3, 14).select("track_id", "tau", F.round("strength", 6).alias("strength")))
beats("dominant_interval", f"WITH {ACF} SELECT track_id, arg_max(tau, s) AS tau FROM h GROUP BY track_id", lambda b: tempo.dominant(tempo.histogram_acf(b, 3, 14)))
beats("detect_tempo", f"WITH {ACF}, w AS (SELECT *, coalesce(lag(s) OVER o, last_value(s) OVER z) AS u, coalesce(lead(s) OVER o, first_value(s) OVER z) AS d FROM h WINDOW o AS (PARTITION BY track_id ORDER BY tau), z AS (PARTITION BY track_id ORDER BY tau ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), p AS (SELECT * FROM w WHERE s > u AND s > d), r AS (SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY s DESC, tau DESC) - 1 AS INT) AS pos, round(60 * 10 / tau, 6) AS tempo, round(CASE WHEN count(*) OVER q = 1 THEN 1 ELSE s / sum(s) OVER q END, 6) AS strength FROM p WINDOW q AS (PARTITION BY track_id)) SELECT * FROM r UNION ALL SELECT DISTINCT track_id, 0, NULL, 0.0 FROM h WHERE track_id NOT IN (SELECT track_id FROM p)", lambda b: tempo.tempi(tempo.histogram_acf(b, 3, 14), 10.0).select("track_id", "pos", r6("tempo").alias("tempo"), r6("strength").alias("strength")))
COMB = BEATS + ", y AS (SELECT a.track_id, a.idx, tau, sum(pow(0.43, (a.idx - c.idx) / tau) * c.x) AS y FROM b a CROSS JOIN range(3, 9) q(tau) JOIN b c ON c.track_id = a.track_id AND c.idx <= a.idx AND (a.idx - c.idx) % tau = 0 GROUP BY ALL)"
beats("comb_filterbank", f"WITH {COMB} SELECT track_id, idx, tau, round(y, 8) AS y FROM y", lambda b: tempo.comb_filterbank(b, list(range(3, 9)), 0.43).withColumn("y", F.round("y", 8)))
beats("tempo_hist_comb", f"WITH {COMB}, m AS (SELECT *, max(y) OVER (PARTITION BY track_id, idx) AS top FROM y) SELECT track_id, tau, round(sum(CASE WHEN y >= top - 1e-9 THEN y ELSE 0 END), 3) AS strength FROM m GROUP BY ALL", lambda b: tempo.histogram_comb(b, 3, 8, 0.43).withColumn("strength", F.round("strength", 3)))
beats("tempo_estimate", None, lambda b: tempo.estimate(b, 10.0, "acf", 40.0, 200.0, None, 3))

# --- decoders -----------------------------------------------------------------------------------------------------------------------------

START, MOVES = [0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]]
OBSERVED = BEATS + ", ob AS (SELECT *, 1 / (1 + x / 100) AS d0, 1 - 1 / (1 + x / 100) AS d1 FROM b)"


def two_states():
    return hmm.Model(hmm.Transitions.from_dense(MOVES), [0, 1], START)


def both(x):
    return np.stack([1 / (1 + x / 100), 1 - 1 / (1 + x / 100)], 1)


beats("viterbi", f"""WITH RECURSIVE {OBSERVED}, v AS (SELECT track_id, idx, ln(greatest(0.5 * 0.9, 0.5 * 0.2)) + ln(d0) AS v0, ln(greatest(0.5 * 0.1, 0.5 * 0.8)) + ln(d1) AS v1, 0 AS b0, 1 AS b1 FROM ob WHERE idx = 0
UNION ALL SELECT o.track_id, o.idx, greatest(v.v0 + ln(0.9), v.v1 + ln(0.2)) + ln(d0), greatest(v.v0 + ln(0.1), v.v1 + ln(0.8)) + ln(d1), CASE WHEN v.v0 + ln(0.9) >= v.v1 + ln(0.2) THEN 0 ELSE 1 END, CASE WHEN v.v0 + ln(0.1) >= v.v1 + ln(0.8) THEN 0 ELSE 1 END FROM v JOIN ob o ON o.track_id = v.track_id AND o.idx = v.idx + 1),
n AS (SELECT track_id, max(idx) AS n FROM v GROUP BY track_id), bt AS (SELECT v.track_id, idx, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END AS s, greatest(v0, v1) AS p FROM v JOIN n ON n.track_id = v.track_id AND v.idx = n.n UNION ALL SELECT bt.track_id, v.idx - 1, CASE WHEN bt.s = 0 THEN v.b0 ELSE v.b1 END, bt.p FROM bt JOIN v ON v.track_id = bt.track_id AND v.idx = bt.idx WHERE v.idx > 0)
SELECT track_id, idx, CAST(s AS BIGINT) AS state, round(p, 5) AS log_prob FROM bt""", lambda b: hmm.decoded(b, two_states(), lambda x: np.log(both(x))).withColumn("log_prob", r5("log_prob")))
beats("hmm_forward", f"""WITH RECURSIVE {OBSERVED}, f AS (SELECT track_id, idx, 0.55 * d0 / (0.55 * d0 + 0.45 * d1) AS p0 FROM ob WHERE idx = 0 UNION ALL
SELECT o.track_id, o.idx, (f.p0 * 0.9 + (1 - f.p0) * 0.2) * d0 / ((f.p0 * 0.9 + (1 - f.p0) * 0.2) * d0 + (f.p0 * 0.1 + (1 - f.p0) * 0.8) * d1) FROM f JOIN ob o ON o.track_id = f.track_id AND o.idx = f.idx + 1) SELECT track_id, idx, round(p0, 6) AS p0, round(1 - p0, 6) AS p1 FROM f""", lambda b: hmm.forwarded(b, two_states(), both).select("track_id", "idx", r6(F.get("p", 0)).alias("p0"), r6(F.get("p", 1)).alias("p1")))
FIELD = hmm.Field([0.3, -0.2], [0.1, 0.4], [0.05, -0.05], [[0.6, -0.4], [-0.3, 0.5]], [[0.8, -0.7], [-0.6, 0.9]])
beats("crf_decode", f"""WITH RECURSIVE {BEATS}, ob AS (SELECT *, 0.05 + (x / 250) * 0.8 - (1 - x / 250) * 0.6 AS o0, -0.05 - (x / 250) * 0.7 + (1 - x / 250) * 0.9 AS o1 FROM b), v AS (SELECT track_id, idx, greatest(0.3 + 0.6, -0.2 - 0.3) + o0 AS v0, greatest(0.3 - 0.4, -0.2 + 0.5) + o1 AS v1, 0 AS b0, 1 AS b1 FROM ob WHERE idx = 0
UNION ALL SELECT o.track_id, o.idx, greatest(v.v0 + 0.6, v.v1 - 0.3) + o0, greatest(v.v0 - 0.4, v.v1 + 0.5) + o1, CASE WHEN v.v0 + 0.6 >= v.v1 - 0.3 THEN 0 ELSE 1 END, CASE WHEN v.v0 - 0.4 >= v.v1 + 0.5 THEN 0 ELSE 1 END FROM v JOIN ob o ON o.track_id = v.track_id AND o.idx = v.idx + 1),
n AS (SELECT track_id, max(idx) AS n FROM v GROUP BY track_id), bt AS (SELECT v.track_id, idx, CASE WHEN v0 + 0.1 >= v1 + 0.4 THEN 0 ELSE 1 END AS s FROM v JOIN n ON n.track_id = v.track_id AND v.idx = n.n UNION ALL SELECT bt.track_id, v.idx - 1, CASE WHEN bt.s = 0 THEN v.b0 ELSE v.b1 END FROM bt JOIN v ON v.track_id = bt.track_id AND v.idx = bt.idx WHERE v.idx > 0)
SELECT track_id, idx, CAST(s AS BIGINT) AS state FROM bt""", lambda b: hmm.labelled(b.withColumn("features", F.array(F.col("x") / 250, 1 - F.col("x") / 250)), FIELD))
register("beat_state_space", "SELECT row_number() OVER (ORDER BY b, i, p) - 1 AS state, round(b + p / i, 9) AS position, i AS interval, CAST(0 AS BIGINT) AS pattern FROM range(0, 3) x(b), range(4, 10) y(i), range(0, 9) z(p) WHERE p < i")(lambda spark, d: hmm.bar_space(3, 4, 9).rows(spark).withColumn("position", F.round("position", 9)))
register("tempo_transitions", """WITH l AS (SELECT i, sum(i) OVER (ORDER BY i) - i AS first, sum(i) OVER (ORDER BY i) - 1 AS last FROM range(4, 10) q(i)), e AS (SELECT a.last AS previous, b.first AS state, exp(-20 * abs(b.i / a.i - 1)) AS p FROM l a, l b), n AS (SELECT previous, state, p / sum(p) OVER (PARTITION BY previous) AS p FROM e WHERE p > 2.220446049250313e-16), s AS (SELECT unnest(range(1, 39)) AS state)
SELECT CAST(state AS BIGINT) AS state, CAST(previous AS BIGINT) AS previous, round(p, 9) AS probability FROM n UNION ALL SELECT state, state - 1, 1.0 FROM s WHERE state NOT IN (SELECT first FROM l)""")(lambda spark, d: hmm.bar_transitions(hmm.bar_space(1, 4, 9), 20.0).rows(spark).withColumn("probability", F.round("probability", 9)))
CLUSTERS = hmm.Mixture(np.array([0.4, 0.6]), np.array([[0.1, 0.0], [-0.1, 0.2]]), np.array([[0.5, 0.4], [0.3, 0.6]]), "diag")
DENSITY = "{w} * exp(-0.5 * (pow(a - {m0}, 2) / {c0} + pow(b - {m1}, 2) / {c1})) / (2 * pi() * sqrt({c0} * {c1}))"
register("gmm_score", "WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings) SELECT vec_id, round(ln(" + DENSITY.format(w=0.4, m0=0.1, m1=0.0, c0=0.5, c1=0.4) + " + " + DENSITY.format(w=0.6, m0=-0.1, m1=0.2, c0=0.3, c1=0.6) + "), 6) AS log_likelihood FROM p")(
    lambda spark, d: hmm.mixture_scores(table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("features")), CLUSTERS).select("vec_id", r6("log_likelihood").alias("log_likelihood"))
)


def activations(spark, d):
    """x between 0 and 1."""
    return event_tracks(table(spark, d, "events")).select("track_id", "idx", (F.col("x") / 600 + 0.05).alias("x"))


register("beats_hmm")(lambda spark, d: tracking.decode_beats(activations(spark, d), 10.0, 60.0, 200.0))
register("beats_tracked")(lambda spark, d: tracking.track_beats(activations(spark, d), 10.0, look_ahead=None, low_bpm=60.0, high_bpm=200.0, hist_smooth=3))
register("beats_chained")(lambda spark, d: tracking.track_beats_by_chains(activations(spark, d), 10.0, low_bpm=60.0, high_bpm=200.0, act_smooth=0.0, hist_smooth=1))
register("downbeats_hmm")(lambda spark, d: tracking.decode_downbeats(activations(spark, d).select("track_id", "idx", (F.col("x") / 2).alias("beat"), (F.col("x") / 3).alias("downbeat")), 10.0, (3, 4), 60.0, 200.0))
register("bars_hmm")(lambda spark, d: tracking.decode_bars(event_tracks(table(spark, d, "events")).select("track_id", "idx", "t", (F.col("x") / 600 + 0.05).alias("x"))))
register("notes_hmm")(lambda spark, d: tracking.decode_notes(event_tracks(table(spark, d, "events")).select("track_id", F.lit(60).alias("pitch"), "idx", (F.col("x") / 600 + 0.1).alias("note"), (F.col("x") / 700 + 0.1).alias("onset"), (0.8 - F.col("x") / 700).alias("offset")), 50.0, onset_threshold=0.2, note_threshold=0.2))

# --- networks ---------------------------------------------------------------------------------------------------------------------------------

WEIGHTS, BIAS = np.array([[0.5, -0.25], [0.75, 0.5], [-1.0, 0.25]]), np.array([0.1, -0.2])
DENSE = "p AS (SELECT CAST(label AS BIGINT) AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), d AS (SELECT *, a * 0.5 + b * 0.75 - c + 0.1 AS y0, a * -0.25 + b * 0.5 + c * 0.25 - 0.2 AS y1 FROM p)"


def three(spark, d):
    return spectrum_tracks(table(spark, d, "embeddings")).select("track_id", "frame", F.transform(F.slice("phase", 1, 3), lambda x: x / 3.0).alias("features"))


def heads(df):
    return df.select("track_id", "frame", r6(F.get("y", 0)).alias("y0"), r6(F.get("y", 1)).alias("y1"))


register("nn_dense", f"WITH {DENSE} SELECT track_id, frame, round(1 / (1 + exp(-y0)), 6) AS y0, round(1 / (1 + exp(-y1)), 6) AS y1 FROM d")(lambda spark, d: heads(predict(three(spark, d), layers.Network(layers.Dense(WEIGHTS, BIAS, layers.sigmoid)))))
register("nn_softmax", f"WITH {DENSE} SELECT track_id, frame, round(exp(y0) / (exp(y0) + exp(y1)), 6) AS y0, round(exp(y1) / (exp(y0) + exp(y1)), 6) AS y1 FROM d")(lambda spark, d: heads(predict(three(spark, d), layers.Network(layers.Dense(WEIGHTS, BIAS, layers.softmax)))))
register("nn_recurrent", f"WITH RECURSIVE {DENSE}, h AS (SELECT track_id, frame, tanh(y0) AS h0, tanh(y1) AS h1 FROM d WHERE frame = 0 UNION ALL SELECT d.track_id, d.frame, tanh(y0 + 0.5 * h.h0 - 0.3 * h.h1), tanh(y1 + 0.2 * h.h0 + 0.4 * h.h1) FROM h JOIN d ON d.track_id = h.track_id AND d.frame = h.frame + 1) SELECT track_id, frame, round(h0, 6) AS y0, round(h1, 6) AS y1 FROM h")(
    lambda spark, d: heads(predict(three(spark, d), layers.Network(layers.Recurrent(WEIGHTS, BIAS, np.array([[0.5, 0.2], [-0.3, 0.4]])))))
)
register("nn_ensemble", f"WITH {DENSE} SELECT track_id, frame, round((greatest(y0, 0) + CASE WHEN y0 < 0 THEN exp(y0) - 1 ELSE y0 END) / 2, 6) AS y0, round((greatest(y1, 0) + CASE WHEN y1 < 0 THEN exp(y1) - 1 ELSE y1 END) / 2, 6) AS y1 FROM d")(
    lambda spark, d: heads(predict(three(spark, d), layers.Ensemble([layers.Network(layers.Dense(WEIGHTS, BIAS, f)) for f in (layers.relu, layers.elu)])))
)
register("nn_norm_pool", f"WITH {DENSE}, n AS (SELECT track_id, frame, (a - 0.1) * 2 + 0.3 AS a, (b + 0.2) * 1.5 - 0.1 AS b, c * 0.5 AS c FROM p) SELECT track_id, frame, round(greatest(a, b, c), 6) AS y0, NULL::DOUBLE AS y1 FROM n")(
    lambda spark, d: heads(predict(three(spark, d), layers.Network(layers.BatchNorm(np.array([0.3, -0.1, 0.0]), np.array([1.0, 1.5, 0.5]), np.array([0.1, -0.2, 0.0]), np.array([2.0, 1.0, 1.0])), layers.MaxPool(axis=1))))
)
register("best_model", "WITH " + BEATS + ", p AS (SELECT track_id, idx, md, x * (1 + 0.1 * md * ((idx + track_id) % 3)) AS x FROM b, range(0, 3) q(md)), r AS (SELECT track_id, idx, avg(x) AS m FROM p GROUP BY ALL), e AS (SELECT p.track_id, md, sum(pow(x - m, 2)) AS d FROM p JOIN r USING (track_id, idx) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round(d, 6), md) AS k FROM e) SELECT p.track_id, idx, round(x, 6) AS x FROM p JOIN o ON o.track_id = p.track_id AND o.md = p.md AND k = 1")(
    lambda spark, d: tracking.best_prediction(event_tracks(table(spark, d, "events")).withColumn("model", F.explode(F.array(*map(F.lit, range(3))))).withColumn("x", F.col("x") * (1 + 0.1 * F.col("model") * ((F.col("idx") + F.col("track_id")) % 3))).select("track_id", "idx", "model", "x")).withColumn("x", r6("x"))
)
