"""Kernels that SQL cannot say: against brute force, fixed vectors and invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.evaluation import chords, keys
from trackloom.functions import pitch
from trackloom.nn import layers, models
from trackloom.operators import analysis, catalog, decode, elliptic, filterbanks, hmm, jumps, onsets, pooling, signals, spectra, structure, tempo, tracking, walks

rng = np.random.default_rng(4)


def series(spark, x, track=1):
    return spark.createDataFrame([(track, i, float(v)) for i, v in enumerate(x)], "track_id long, idx long, x double")


def test_filterbanks():
    grid = pitch.bin_grid(512, 44_100)
    for bank in (filterbanks.mel_bank(grid), filterbanks.log_bank(grid), filterbanks.bark_bank(grid)):
        assert np.allclose(bank.sum(0), 1) and (bank >= 0).all()
    assert filterbanks.triangle(2, 4, 8)[1].tolist() == [0, 0.5, 1, 0.75, 0.5, 0.25]
    assert filterbanks.bank([[(-1, np.ones(3)), (1, np.full(3, 2.0))]], 3).ravel().tolist() == [1, 2, 2]
    assert filterbanks.chroma_bank(grid).shape == (512, 12)
    assert np.allclose(filterbanks.crossover_bank(grid, [270, 450]).sum(0), 1)
    assert pitch.nearest_bins([0, 5, 10, 16, 100], [0, 10, 20]).tolist() == [0, 1, 1, 2, 2]
    low, centre, high = filterbanks.corners(filterbanks.mel_bank(grid), grid)[5]
    assert low < centre < high
    with pytest.raises(ValueError):
        filterbanks.triangle(3, 2, 4)


def test_harmonic_and_percussive(spark):
    m = rng.random((9, 7))
    s = spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(m)], "track_id long, frame long, m array<double>")
    mirror = lambda k, n: k if 0 <= k < n else (-k - 1 if k < 0 else 2 * n - 1 - k)
    h = np.array([[np.median([m[mirror(i + d, 9), j] for d in (-1, 0, 1)]) for j in range(7)] for i in range(9)])
    p = np.array([[np.median([m[i, mirror(j + d, 7)] for d in (-1, 0, 1)]) for j in range(7)] for i in range(9)])
    got = spectra.harmonic_percussive(s, 3, 3).orderBy("frame").collect()
    assert np.allclose([r["harmonic"] for r in got], m * (h > p)) and np.allclose([r["percussive"] for r in got], m * (p >= h))
    soft = spectra.harmonic_percussive(s, 3, 3, 2.0).orderBy("frame").collect()
    assert np.allclose(np.array([r["harmonic"] for r in soft]) + np.array([r["percussive"] for r in soft]), m)


def test_correlation_difference(spark):
    m = rng.random((6, 8))
    s = spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(m)], "track_id long, frame long, m array<double>")
    want = np.zeros_like(m)
    for f in range(1, 6):
        options = []
        for k in (0, 1, -1):
            moved = np.array([m[f - 1, i + k] if 0 <= i + k < 8 else 0 for i in range(8)])
            options.append((m[f] @ moved, moved))
        moved = max(options, key=lambda o: o[0])[1]
        want[f, 1:-1] = (m[f] - moved)[1:-1]
    assert np.allclose([r["d"] for r in spectra.correlation_diff(s).orderBy("frame").collect()], want)


def test_circular_transform(spark):
    x = rng.random((3, 8))
    f = spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(x)], "track_id long, frame long, samples array<double>")
    got = spectra.stft(f, None, circular=True, nyquist=True).orderBy("frame").collect()
    want = np.fft.rfft(np.concatenate([x[:, 4:], x[:, :4]], 1), axis=1)
    assert np.allclose([r["re"] for r in got], want.real) and np.allclose([r["im"] for r in got], want.imag)


def best_of_all(model, log_d):
    t = model.transitions.dense()
    with np.errstate(divide="ignore"):
        start, moves = np.log(model.start), np.log(t)
    paths = itertools.product(range(model.transitions.n), repeat=len(log_d) + 1)
    return max(start[p[0]] + sum(moves[a, b] + log_d[k][model.pointers[b]] for k, (a, b) in enumerate(itertools.pairwise(p))) for p in paths)


def test_viterbi_and_forward():
    t = hmm.Transitions([0, 1, 1, 2, 0, 2], [0, 0, 1, 1, 2, 2], [0.3, 0.7, 0.6, 0.4, 0.9, 0.1])
    model = hmm.Model(t, [0, 1, 0])
    for _ in range(20):
        d = np.log(rng.random((5, 2)))
        path, top = model.viterbi(d)
        assert np.isclose(top, best_of_all(model, d)) and len(path) == 5
    d = rng.random((6, 2))
    whole = model.forward(d)
    assert np.allclose(whole, np.concatenate(list(model.forward_blocks(d, 4)))) and np.allclose(whole.sum(1), 1)
    impossible = hmm.Model(hmm.Transitions([1, 1], [0, 1], [1, 1]), [0, 1], [1.0, 0.0])
    with np.errstate(divide="ignore"):
        assert len(impossible.viterbi(np.log([[1.0, 0.0]]))[0]) == 0
    with pytest.raises(ValueError):
        hmm.Transitions([0], [0], [0.5])


def test_field_against_all_paths():
    field = hmm.Field([0.3, -0.2], [0.1, 0.4], [0.05, -0.05], [[0.6, -0.4], [-0.3, 0.5]], [[0.8, -0.7], [-0.6, 0.9]])
    seen = rng.random((6, 2))
    best = (-np.inf, ())
    for p in itertools.product((0, 1), repeat=7):
        s = field.start[p[0]] + sum(field.transition[a, b] + field.bias[b] + seen[k] @ field.observation[:, b] for k, (a, b) in enumerate(itertools.pairwise(p))) + field.end[p[-1]]
        best = max(best, (s, p[1:]))
    assert tuple(field.decode(seen)) == best[1]
    with np.errstate(divide="ignore"):
        fixed = hmm.Field(np.log([0.5, 0.5]), np.log([0.5, 0.5]), np.zeros(2), np.log([[0.6, 0.4], [0.4, 0.6]]), np.log([[0.85, 0.15], [0.15, 0.85]]))
    assert fixed.decode(np.eye(2)[[0, 0, 1, 0, 1, 1]]).tolist()[:2] == [0, 0]


def test_mixtures():
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(4, 0.3, (60, 2))])
    for kind in ("full", "diag", "spherical", "tied"):
        m = hmm.Mixture(kind=kind).fit(x, 2)
        assert sorted(np.round(m.means[:, 0]).astype(int)) == [0, 4]
    means, c = np.array([[0.0, 1.0]]), np.array([[2.0, 0.5]])
    full = hmm.log_normal(x, means, np.array([np.diag(c[0])]), "full")
    assert np.allclose(full, hmm.log_normal(x, means, c, "diag")) and np.allclose(full, hmm.log_normal(x, means, np.diag(c[0]), "tied"))
    a = rng.random((3, 3))
    a = a @ a.T
    assert np.allclose(hmm.pseudo_inverse(a), np.linalg.pinv(a))


def test_state_spaces():
    s = hmm.bar_space(2, 3, 5)
    assert s.n == 24 and s.positions.max() < 2 and [len(f) for f in s.first] == [3, 3]
    t = hmm.bar_transitions(s, 100.0)
    assert np.allclose(t.dense().sum(1), 1)
    spaces = [hmm.bar_space(k, 1, 1) for k in (3, 4)]
    d = hmm.pattern_transitions(spaces, 1.0, 0.1).dense()
    assert np.isclose(d[2, 0], 0.9) and np.isclose(d[2, 3], 0.1) and np.isclose(d[6, 0], 0.1)
    assert hmm.pattern_pointers(hmm.joined_space(spaces), [3, 4]).tolist() == list(range(7))
    assert len(hmm.beat_lengths(20, 60, 10)) == 10
    assert np.isclose(hmm.Envelope(2, 2, 1).transitions().dense().sum(1), 1).all()


def test_beats_follow_a_pulse(spark):
    x = np.full(200, 0.02)
    x[5::10] = 0.9
    b = series(spark, x)
    for found in (tracking.decode_beats(b, 20.0), tracking.track_beats(b, 20.0, look_ahead=None, low_bpm=60, high_bpm=180, act_smooth=0.0), tracking.track_beats(b, 20.0, look_ahead=3.0, low_bpm=60, high_bpm=180, act_smooth=0.0), tracking.track_beats_by_chains(b, 20.0, low_bpm=60, high_bpm=180, act_smooth=0.0)):
        t = np.sort([r["t"] for r in found.collect()])
        # A window of little look-ahead may find another tempo at the track's begin.
        assert len(t) >= 18 and np.allclose(np.diff(t)[2:], 0.5)
    down = b.select("track_id", "idx", (F.col("x") * 0.9).alias("beat"), F.when(F.col("idx") % 40 == 5, 0.08).otherwise(0.01).alias("downbeat"))
    got = tracking.decode_downbeats(down, 20.0, (3, 4)).orderBy("t").collect()
    assert {(r["position"] % 4 + 1) == n["position"] for r, n in itertools.pairwise(got)} == {True}
    bars = spark.createDataFrame([(1, i, i * 0.5, 0.9 if i % 3 == 0 else 0.05) for i in range(12)], "track_id long, idx long, t double, x double")
    assert [r["position"] for r in tracking.decode_bars(bars).orderBy("t").collect()] == [1, 2, 3] * 4
    assert tempo.tempi(tempo.histogram_comb(b, 6, 14), 20.0).orderBy("pos").first()["tempo"] == 120.0
    assert tempo.estimate(b, 20.0, "states").orderBy("pos").first()["tempo"] == pytest.approx(120, abs=8)


def test_chain_against_all_chains():
    x, interval, sigma = rng.random(12), 4, 0.3
    steps = tracking.step_shares(interval, sigma)
    norm = np.maximum(np.log(tracking.normalisers(x, steps)), -1e6)
    best = -np.inf
    for p in itertools.combinations(range(12), 3):
        if 0 < p[0] < interval and all(0 < b - a < len(steps) for a, b in itertools.pairwise(p)):
            best = max(best, sum(np.log(x[i]) + norm[i] for i in p) - norm[p[-1]] + sum(np.log(steps[b - a]) for a, b in itertools.pairwise(p)))
    got = tracking.best_chain(x, interval, sigma)[1]
    assert got >= best - 1e-9


def test_notes_from_envelopes(spark):
    states = np.zeros((40, 3))
    states[:, 0], states[:, 1], states[:, 2] = 0.05, 0.02, 0.1
    states[10:13, 1] = 0.9
    states[10:25, 0] = 0.9
    rows = spark.createDataFrame([(1, 60, i, *map(float, r)) for i, r in enumerate(states)], "track_id long, pitch long, idx long, note double, onset double, offset double")
    got = tracking.decode_notes(rows, 50.0).collect()
    assert len(got) == 1 and 0.16 <= got[0]["onset"] <= 0.28 and got[0]["pitch"] == 60


def test_recurrent_layers():
    x = rng.random((5, 3))
    w, r, b = rng.random((3, 2)), rng.random((2, 2)), rng.random(2)
    gate = lambda: layers.Gate(rng.random((3, 2)), rng.random(2), rng.random((2, 2)), rng.random(2))
    cell = layers.Cell(w, b, r)
    i, f, o = gate(), gate(), gate()
    lstm = layers.LSTM(i, f, cell, o)
    h = c = np.zeros(2)
    want = []
    sig = lambda z: 1 / (1 + np.exp(-z))
    for row in x:
        run = lambda g, state, row=row, h=h: sig(row @ g.weights + g.bias + h @ g.recurrent + state * g.peephole)
        new = np.tanh(row @ w + b + h @ r) * run(i, c) + c * run(f, c)
        h, c = np.tanh(new) * run(o, new), new
        want.append(h)
    assert np.allclose(lstm(x), want)
    first, rest = lstm(x[:2]), lstm(x[2:], reset=False)
    assert np.allclose(np.concatenate([first, rest]), want)
    rg, ug = layers.Gate(w, b, r), layers.Gate(w * 2, b, r)
    h, want = np.zeros(2), []
    for row in x:
        reset, update = sig(row @ w + b + h @ r), sig(row @ (w * 2) + b + h @ r)
        h = update * np.tanh(row @ w + b + reset * (h @ r)) + (1 - update) * h
        want.append(h)
    assert np.allclose(layers.GRU(rg, ug, layers.Cell(w, b, r))(x), want)
    both = layers.Bidirectional(layers.Recurrent(w, b, r), layers.Recurrent(w, b, r))(x)
    assert both.shape == (5, 4) and np.allclose(both[::-1, 2:], layers.Recurrent(w, b, r)(x[::-1]))


def test_convolutional_layers():
    x, k = rng.random((6, 5)), rng.random((3, 2))
    want = [[sum(x[i + 2 - a, j + 1 - c] * k[a, c] for a in range(3) for c in range(2)) for j in range(4)] for i in range(4)]
    assert np.allclose(layers.convolve(x, k), want) and layers.convolve(x, k, "same").shape == x.shape
    w = rng.random((1, 4, 3, 2))
    out = layers.Convolution(w, np.zeros(4), activation=layers.relu)(x)
    assert np.allclose(out[..., 2], layers.convolve(x, w[0, 2])) and out.shape == (4, 4, 4)
    assert layers.Stride(3)(x).shape == (4, 15) and np.allclose(layers.Stride(3)(x)[1], x[1:4].ravel())
    assert np.allclose(layers.MaxPool((2, 2))(x), [[x[i : i + 2, j : j + 2].max() for j in (0, 2)] for i in (0, 2, 4)])
    assert layers.Pad(1, (0,))(x).shape == (8, 5) and layers.Average(0)(x).shape == (5,) and layers.Transpose()(x).shape == (5, 6) and layers.Reshape((5, 6))(x).shape == (5, 6)
    block = layers.TCNBlock([layers.Convolution(rng.random((2, 2, 1, 5)), np.zeros(2))], [2], layers.elu)
    data = rng.random((7, 1, 2))
    out, skip = block(data)
    assert out.shape == data.shape and np.allclose(out, data + skip)
    last, total = layers.TCN([block, block], skips=True)(data)
    assert last.shape == data.shape and total.shape == data.shape
    with pytest.raises(ValueError):
        layers.Convolution(rng.random((2, 4, 3, 2)), np.zeros(4))(x)
    assert np.allclose(layers.softmax(np.array([1.0, 1.0])), 0.5)
    heads = layers.MultiTask(layers.Dense(np.eye(2), np.zeros(2)), layers.Dense(np.ones((2, 1)), np.zeros(1)), mapping=[0, 0])([np.ones((3, 2))])
    assert heads[1].shape == (3, 1) and len(layers.Parallel(layers.Dense(np.eye(2), np.zeros(2)))(np.ones((3, 2)))) == 1
    assert layers.average_predictions([(1.0, 2.0), (3.0, 4.0)]) == (2.0, 3.0)


def test_model_inputs(spark):
    s = series(spark, np.sin(np.arange(400) / 3))
    net = layers.Network(layers.Dense(np.full((models.multi_resolution(s, 8000.0, 100.0, (64, 128), (3, 3)).first()["features"].__len__(), 3), 0.01), np.zeros(3), layers.sigmoid))
    got = models.predict(models.multi_resolution(s, 8000.0, 100.0, (64, 128), (3, 3)), net)
    assert got.count() == 5 and len(got.first()["y"]) == 3


def test_segments_of_a_song(spark):
    """A-B-A-C, 20 beats each: boundaries at the changes."""
    base = np.eye(4)[[0, 1, 0, 2]]
    v = np.repeat(base, 20, 0) + rng.normal(0, 0.01, (80, 4))
    f = spark.createDataFrame([(1, i, row.tolist()) for i, row in enumerate(v)], "track_id long, i long, v array<double>")
    bars = f.select("track_id", F.col("i").alias("idx"), (F.col("i") % 4).alias("bar_position"))
    got = structure.segment_by_novelty(f, bars, 16, 1.0, 8, 1.0, 8).orderBy("i").collect()
    labels = np.array([r["label"] for r in got])
    assert np.flatnonzero(np.diff(labels)).tolist() == [19, 39, 59]
    kernel = structure.checkerboard(8)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [max(0, (u[i - 4 : i + 4] @ u[i - 4 : i + 4].T * kernel).sum()) if 4 <= i < 76 else 0 for i in range(80)]
    found = structure.novelty(f.withColumn("v", structure.unit("v")), 8).orderBy("i").collect()
    assert np.allclose([r["novelty"] for r in found], want)


def test_spectral_clusters(spark):
    group = np.repeat([0, 1, 2, 0, 1], 8)
    edges = [(1, i, j, 1.0 if group[i] == group[j] else 0.001) for i in range(40) for j in range(40) if i != j]
    a = spark.createDataFrame(edges, "track_id long, src long, dst long, weight double")
    frames = spark.createDataFrame([(1, i) for i in range(40)], "track_id long, i long")
    got = structure.spectral_clusters(a, frames, k=3).orderBy("i").collect()
    assert [r["label"] for r in got] == group.tolist()
    for strategy in ("eigengap", "legacy", "balanced", "connectivity", "max_k", "v1", "v2", "v1_ratio"):
        got = structure.spectral_clusters(a, frames, strategy).collect()
        assert len(got) == 40 and got[0]["k"] >= 3
    x, y = rng.random((9, 2)), np.array([0, 0, 0, 1, 1, 1, 1, 2, 2])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(9):
        own = d[i][(y == y[i]) & (np.arange(9) != i)].mean()
        other = min(d[i][y == k].mean() for k in range(3) if k != y[i])
        s.append((other - own) / max(own, other))
    assert np.isclose(structure.silhouette_of(x, y), np.mean(s))
    assert structure.eigengap(np.array([0, 0.1, 0.2, 0.3, 0.31, 0.9, 1.0])) == 4
    assert structure.jump_counts_of(np.array([0, 0, 1, 0])).tolist() == [1, 1, 0, 2] and structure.escape_of(np.array([0, 0, 1, 0])) == pytest.approx(2 / 3)


def test_walk_takes_the_only_jump():
    """Eight beats, one of which can go back to the first: the walk jumps and never leaves the track."""
    steps = list(decode.walk([0.5 * i for i in range(8)], [i % 4 for i in range(8)], [[] if i != 3 else [0] for i in range(8)], 100))
    beats_ = [s[1] for s in steps]
    assert set(beats_) <= set(range(8)) and any(b < a for a, b in itertools.pairwise(beats_))


def test_older_walks_stay_legal():
    n = 64
    cands = [[(i + 32) % n, (i + 16) % n] for i in range(n)]
    seg = [i // 8 for i in range(n)]
    for bars in (None, [i % 4 for i in range(n)], [i % 4 for i in range(n)][::-1]):
        rows = list(walks.older_walk(seg, [(i + 1) % n for i in range(n)], cands, n * 0.5, 500, 3, bars))
        assert len(rows) == 501 and rows == list(walks.older_walk(seg, [(i + 1) % n for i in range(n)], cands, n * 0.5, 500, 3, bars))
        for (a, *_), (b, *_) in itertools.pairwise(rows):
            assert b == (a + 1) % n or b in cands[a] or b == 0


def test_pruning(spark):
    b = spark.createDataFrame([(1, i) for i in range(50)], "track_id long, idx long")
    e = spark.createDataFrame([(1, 3, 45), (1, 40, 2)], "track_id long, src long, dst long")
    rows, kept = jumps.pruned(b, e)
    assert rows.count() == 41 and [tuple(r) for r in kept.collect()] == [(1, 40, 2)]
    assert jumps.pruned(b, e.where("src < 4"))[0].count() == 32


def test_beats_from_logits(spark):
    x = np.full(40, -1.0)
    x[[5, 15, 25, 35]] = 2.0
    x[16] = 2.0
    down = np.full(40, -1.0)
    down[[6, 26]] = 1.0
    found, downs = onsets.beats_from_logits(series(spark, x), series(spark, down), 10.0)
    assert sorted(r["t"] for r in found.collect()) == [0.5, 1.6, 2.5, 3.5]
    assert sorted(r["t"] for r in downs.collect()) == [0.5, 2.5]


def test_chord_labels():
    assert chords.parse("N") == (-1, -1, [0] * 12) and chords.parse("X")[2] == [-1] * 12
    assert chords.parse("C:maj") == (0, 0, [1, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0]) and chords.parse("Cb") == (11, 0, chords.parse("C")[2])
    assert chords.parse("E:min/b3") == (4, 3, [1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0])
    assert chords.parse("D:maj(*3,9)")[2] == [1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0] and chords.parse("G:(1,b3,#5)/b3")[2] == [1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        chords.pitch_class("Cx")


def test_chord_scores(spark):
    rows = lambda *r: spark.createDataFrame([(1, *x) for x in r], "track_id long, start double, end double, label string")
    ann = rows((0.0, 1.0, "C:maj"), (1.0, 2.0, "A:min7"), (2.0, 4.0, "G:7/3"))
    det = rows((0.5, 1.0, "C:maj7"), (1.0, 2.0, "A:min"), (2.0, 5.0, "G:7"))
    got = chords.evaluate(det, ann).first()
    assert got["root"] == pytest.approx(3.5 / 4) and got["majmin"] == pytest.approx(3.5 / 4) and got["majminbass"] == pytest.approx(1.5 / 4) and got["sevenths"] == pytest.approx(2 / 4)
    assert got["oversegmentation"] == pytest.approx(1 - 0.5 / 4) and got["undersegmentation"] == pytest.approx(1.0)
    assert chords.evaluate(ann, ann).first()["segmentation"] == 1.0
    assert chords.total(det, ann).first()["root"] == pytest.approx(3.5 / 4) and chords.mean(chords.evaluate(det, ann)).first()["root"] == pytest.approx(3.5 / 4)


def test_keys(spark):
    rows = spark.createDataFrame([("C major", "G maj"), ("a min", "C major"), ("x major", "C major"), ("C", "C")], "detected string, annotated string")
    assert [(r["score"], r["kind"]) for r in keys.evaluate(rows).collect()] == [(0.5, "fifth"), (0.3, "relative"), (None, None), (None, None)]
    assert keys.evaluate(rows, strict_fifth=True).first()["kind"] == "other"


def test_edges_of_signals(spark):
    empty = series(spark, [])
    for f in (signals.normalize, signals.trim, lambda s: signals.frames(s, 4, 2), lambda s: onsets.peaks(s, 0.5), lambda s: tempo.tempi(tempo.histogram_acf(s, 1, 3), 10.0)):
        assert f(empty).count() == 0
    silent = series(spark, [0.0, 0.0])
    assert signals.trim(silent).count() == 0 and [r["x"] for r in signals.normalize(silent).collect()] == [0.0, 0.0]
    assert signals.trim(series(spark, [0, 1, 0]), "front").count() == 2 and signals.trim(series(spark, [0, 1, 0]), "back").count() == 2
    pulse = series(spark, [0, 0, 1, 0, 0, 1, 0, 0, 1])
    assert tempo.comb_bank(np.array([0, 0, 1, 0, 0, 1, 0, 0, 1.0]), [3], 0.5).ravel().tolist() == [0, 0, 1, 0, 0, 1.5, 0, 0, 1.75]
    assert [r["y"] for r in tempo.comb_filterbank(pulse, [3], 0.5, backward=False).orderBy("idx").collect()] == [0, 0, 1, 0, 0, 1.5, 0, 0, 1.5]


def test_pooling_keeps_beats_without_frames(spark):
    frames = spark.createDataFrame([(1, 0.1, 3.0), (1, 0.2, 4.0)], "track_id long, t double, x double")
    beats_ = spark.createDataFrame([(1, 0.15), (1, 0.5)], "track_id long, t double")
    assert [(r["beat"], r["rms"]) for r in pooling.rms_by_beat(frames, beats_).orderBy("beat").collect()] == [(0, pytest.approx(np.sqrt(12.5))), (1, 0.0)]
    vectors = frames.withColumn("v", F.array("x", F.col("x") * 2))
    assert pooling.vectors_by_beat(vectors, beats_, normed=True).first()["v"] == pytest.approx([1 / np.sqrt(5), 2 / np.sqrt(5)])


def test_read_through(spark):
    cache = spark.createDataFrame([("a", 1)], "k string, v int")
    asked = spark.createDataFrame([("a",), ("b",)], "k string")
    found, new = catalog.read_through(asked, cache, "k", lambda d: d.withColumn("v", F.lit(9)))
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("b", 9)] and [tuple(r) for r in new.collect()] == [("b", 9)]
    assert catalog.read_through(asked, cache, "k", lambda d: d.withColumn("v", F.lit(9)), False)[1].count() == 2


def test_elliptic_bands(spark):
    """Within the ripple inside, below the rejection outside, and energy where the tone is."""
    filters = elliptic.semitone_filters()
    assert len(filters) == 88
    for f, rate, sos in filters[::9]:
        half = f / 25 / 2
        inside = 20 * np.log10(elliptic.response(sos, np.linspace((f - half) * 2 / rate, (f + half) * 2 / rate, 101)))
        assert inside.min() > -1.001 and inside.max() < 0.001
        assert 20 * np.log10(elliptic.response(sos, [f * 1.2 / rate])).max() < -50
    tone = np.sin(2 * np.pi * 110.0 * np.arange(882) / 882)
    found = np.sum([r["m"] for r in elliptic.semitone_energies(series(spark, tone), 882.0, 50.0, 98.0, 124.0).collect()], 0)
    assert found.argmax() == 1 and found[1] > 20 * found[0]


def test_sliding_transform(spark):
    x = np.sin(2 * np.pi * 20.0 * np.arange(400) / 200)
    got = np.array([r["m"] for r in analysis.sliding_transform(series(spark, x), 200.0, 10.0, 4, 2, 50).orderBy("frame").collect()])
    assert got.shape == (7, 8) and (got[3:].argmax(1) == 4).all() and got[-1, 4] == pytest.approx(0.5, abs=0.02)


def song(spark):
    parts = rng.normal(size=(4, 33))
    v = np.repeat(parts[[0, 1, 0, 2]], 24, 0) + rng.normal(0, 0.05, (96, 33))
    rows = [(1, i, i * 0.7, 1.0 if i < 92 else 0.0, 0.5, v[i, :20].tolist(), np.abs(v[i, 20:32]).tolist(), i % 4 == 0) for i in range(96)]
    return spark.createDataFrame(rows, "track_id long, idx long, t double, rms double, centroid double, mfcc array<double>, chroma array<double>, downbeat boolean")


def test_analyses_of_a_song(spark):
    beats_, segments = analysis.analyze(song(spark), 16, 1.0, 8, 1.0, 8)
    rows = beats_.orderBy("id").collect()
    assert rows[-1]["id"] <= 91 and {round(r["start_time"], 3) for r in segments.collect()} >= {16.8, 33.6}
    assert all(c < len(rows) and abs(c - r["id"]) >= 8 and rows[c]["bar_position"] == (r["id"] + 1) % 4 for r in rows if r["id"] < len(rows) - 1 for c in r["jump_candidates"])
    assert any(r["jump_candidates"] for r in rows) and max(r["energy"] for r in rows) == 1.0
    labels = [r["label"] for r in analysis.analyze_spectral(song(spark), k=3).orderBy("i").collect()]
    assert len({tuple(labels[a + 4 : a + 20]) for a in (0, 48)}) == 1 and labels[10] != labels[30] != labels[80]
    for bars in (False, True):
        older, _ = analysis.analyze_older(song(spark), bars)
        assert 90 <= older.count() <= 96


def test_log_filtered_and_banks(spark, tmp_path):
    (tmp_path / "bank.json").write_text("[[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]")
    bank = analysis.read_bank(spark, str(tmp_path / "bank.json"))
    assert bank.tolist() == [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]]
    x = rng.random((4, 6))
    f = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "track_id long, frame long, samples array<double>")
    m = np.log10(np.abs(np.fft.rfft(x * np.hanning(6), axis=1))[:, :3] @ bank + 1)
    want = np.hstack([m, np.vstack([np.zeros((1, 2)), np.maximum(np.diff(m, axis=0) * 0.5, 0)])])
    assert np.allclose([r["features"] for r in analysis.log_filtered(f, bank).orderBy("frame").collect()], want)


def test_patterns_and_bars_from_networks(spark):
    """A pattern of three beats with its own mixtures, and downbeats from two networks over beat features."""
    mixtures = [hmm.Mixture(np.ones(1), np.array([[m]]), np.array([[0.1]]), "diag") for m in (3.0, 0.0, 1.0, 0.0, 1.0, 0.0)]
    bar = np.repeat([3.0, 0.0, 1.0, 0.0, 1.0, 0.0], 5)
    rows = spark.createDataFrame([(1, i, [float(x)]) for i, x in enumerate(np.tile(bar, 6))], "track_id long, idx long, features array<double>")
    got = tracking.decode_patterns(rows, 10.0, [(3, mixtures)], 50.0, 75.0).orderBy("t").collect()
    assert [r["position"] for r in got][:6] == [2, 3, 1, 2, 3, 1] and np.allclose(np.diff([r["t"] for r in got]), 1.0)
    frames = spark.createDataFrame([(1, i, [float(i % 40 < 10), 1.0]) for i in range(200)], "track_id long, frame long, m array<double>")
    beats_ = spark.createDataFrame([(1, k * 1.0) for k in range(9)], "track_id long, t double")
    sub = tracking.beat_subdivisions(frames, beats_, 10.0, 2).collect()
    assert {(r["beat"], r["part"]) for r in sub} == {(b, p) for b in range(8) for p in range(2)}
    nets = [layers.Network(layers.Dense(np.ones((2 * p, 1)) / (2 * p), np.zeros(1))) for p in (4, 2)]
    got = models.bar_activations(frames, frames, beats_, *nets, fps=10.0).orderBy("idx").collect()
    assert len(got) == 9 and got[-1]["x"] is None and got[0]["x"] > got[2]["x"]


def test_recognisers_take_networks(spark):
    s = series(spark, np.sin(np.arange(300) / 4))
    size = lambda df: len(df.first()["features"])
    net = lambda n, k: layers.Network(layers.Dense(np.full((n, k), 0.01), np.zeros(k), layers.sigmoid))
    wide = size(models.multi_resolution(s, 4000.0, 100.0, per_octave=(3, 6, 12)))
    assert models.downbeat_activations(s, net(wide, 3), 4000.0).columns == ["track_id", "frame", "beat", "downbeat"]
    for f, n in ((models.beat_activations, (6, 6, 6)), (models.note_activations, (12, 12, 12))):
        assert f(s, net(size(models.multi_resolution(s, 4000.0, 100.0, per_octave=n)), 2), 4000.0).count() == 8
    bands = len(models.log_spectrum(s, 4000.0, 256, 50.0, 12, 60.0, 1500.0).first()["m"])
    context = layers.Network(layers.Stride(5), layers.Dense(np.full((5 * bands, 2), 0.01), np.zeros(2)))
    assert models.convolutional_activations(s, context, 4000.0, 256, 50.0, 12, 60.0, 1500.0, pad=2).count() == 4
    assert layers.superframes(np.arange(10).reshape(5, 2), 3, 2).shape == (2, 3, 2)
    labels = models.chords(spark.createDataFrame([(1, i, [float(i < 3), float(i >= 3)]) for i in range(6)], "track_id long, frame long, y array<double>"), hmm.Field([0, 0], [0, 0], [0, 0], [[0, -0.1], [-0.1, 0]], [[1, 0], [0, 1]]))
    assert [r["label"] for r in labels.orderBy("start").collect()] == ["A:maj", "A#:maj"]
