"""Odd values and sizes that the kernels must take."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from trackloom.operators import hmm, structure, tracking
from trackloom.sources import audio

rng = np.random.default_rng(9)


def beats_and_more(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def test_densities_of_activations_beyond_one_are_impossible():
    model = hmm.Model(hmm.bar_transitions(hmm.bar_space(1, 3, 6), 100.0), hmm.beat_pointers(hmm.bar_space(1, 3, 6), 16.0))
    x = np.full(24, 0.1)
    x[[2, 6, 10, 14, 18]] = 0.9
    usual = model.viterbi(hmm.beat_densities(x, 16.0))[0]
    x[6] = 1.2
    path, top = model.viterbi(hmm.beat_densities(x, 16.0))
    assert path.tolist() == usual.tolist() and math.isfinite(top)
    x[7] = 1.1
    assert not len(model.viterbi(hmm.beat_densities(x, 16.0))[0])


def test_beats_beyond_one(spark):
    x = np.full(40, 0.1)
    x[3::5] = 0.9
    x[13] = 1.3
    b = beats_and_more(spark, "track_id long, idx long, x double", [(k, i, float(v)) for k in (1, 2) for i, v in enumerate(x)])
    got = [r["t"] for r in tracking.decode_beats(b, 10.0, 60.0, 200.0).where("track_id = 1").orderBy("t").collect()]
    assert 1.3 in got and np.allclose(np.diff(got), 0.5)


def test_bars_beyond_one(spark):
    rows = [(1, i, i * 0.5, 1.2 if i % 4 == 0 else 0.1) for i in range(12)]
    rows += [(2, i, i * 0.5, 1.2 if i in (4, 5) else 0.1) for i in range(12)]
    got = tracking.decode_bars(beats_and_more(spark, "track_id long, idx long, t double, x double", rows)).orderBy("track_id", "t").collect()
    assert [r["position"] for r in got] == [1, 2, 3, 4] * 3 + [None] * 12 and [r["t"] for r in got] == [i * 0.5 for i in range(12)] * 2


def test_notes_with_offsets_below_zero(spark):
    note = [0.1] * 5 + [0.9] * 10 + [0.1] * 5
    rows = [(1, 60, i, x, 0.9 if i == 5 else 0.05, 0.9 if i == 15 else -0.01 if i == 8 else 0.05) for i, x in enumerate(note)]
    b = beats_and_more(spark, "track_id long, pitch int, idx long, note double, onset double, offset double", rows)
    assert [(r["pitch"], r["onset"]) for r in tracking.decode_notes(b, 50.0, complete=False).collect()] == [(60, 0.08)]


def test_notes_with_infinite_values(spark):
    quiet = [(1, 60, i, 0.1, 0.05, 0.05) for i in range(20)]
    rows = [(k, p, i, *([x] * 3 if i in (8, 12) else rest)) for x, own in ((math.inf, 1), (-math.inf, 2)) for k, p, i, *rest in [(own, *r[1:]) for r in quiet]]
    note = [0.1] * 5 + [0.9] * 10 + [0.1] * 5
    rows += [(3, 60, i, x, 0.9 if i == 5 else 0.05, 0.9 if i == 15 else 0.05) for i, x in enumerate(note)]
    b = beats_and_more(spark, "track_id long, pitch int, idx long, note double, onset double, offset double", rows)
    assert [(r["track_id"], r["onset"]) for r in tracking.decode_notes(b, 50.0, complete=False).collect()] == [(3, 0.08)]


def test_downbeats_beyond_one(spark):
    rows = [(1, i, 0.65 if i == 40 else 0.05 if i % 20 else 0.1, 0.6 if i == 40 else 0.8 if i % 20 == 0 else 0.01) for i in range(100)]
    rows = [(k, i, 0.8 if i % 5 == 0 and i % 20 else x, y) for k, i, x, y in rows]
    got = tracking.decode_downbeats(beats_and_more(spark, "track_id long, idx long, beat double, downbeat double", rows), 10.0, (3, 4), 60.0, 200.0).orderBy("t").collect()
    assert (4.0, 1) in [(r["t"], r["position"]) for r in got]


def test_downbeats_with_infinite_values(spark):
    rows = [(k, i, 0.8 if i % 5 == 0 else 0.05, 0.7 if i % 20 == 0 else 0.01) for k in (1, 2, 3) for i in range(100)]
    rows = [(k, i, *((math.inf, math.inf) if k == 1 and i in (41, 42) else (-math.inf, 0.1) if k == 2 and i in (41, 42) else (x, y))) for k, i, x, y in rows]
    got = tracking.decode_downbeats(beats_and_more(spark, "track_id long, idx long, beat double, downbeat double", rows), 10.0, (3, 4), 60.0, 200.0).collect()
    assert 1 not in {r["track_id"] for r in got} and len([r for r in got if r["track_id"] == 3]) == 20


def by_sql(spark, folder, name, values):
    """Rows of a query and of its SQL on events with these values, eight to a track."""
    rows = [(i, i, i // 8, "click", float(v)) for i, v in enumerate(values)]
    path = str(folder / "events.parquet")
    spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp_seconds(s) as ts", "user_id", "event_type", "value").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{path}/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    return sorted(map(tuple, df.collect())), sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_onsets_on_the_threshold_as_sql_adds(spark, tmp_path):
    draw, values = np.random.default_rng(1), []
    while len(values) < 8 * 400:
        near = draw.integers(0, 20_000, 3)
        top = int(near.sum()) + 8000  # three times the cents that lie on the threshold
        if top % 3 == 0 and top // 3 >= near.max():
            values += [*(draw.integers(0, 30_000, 4) / 100), *(near / 100), top // 3 / 100]
    got, wanted = by_sql(spark, tmp_path, "online_onsets", values)
    assert got == [(k, float(t)) for k, t in wanted]


def test_wave_samples_beyond_full_scale(spark, tmp_path):
    got, wanted = by_sql(spark, tmp_path, "wave_samples", [0.01, 599.99, 600.0, 600.01, 720.5, -650.0, 12.34, 90_000.0])
    assert got == wanted


def test_whole_samples_must_fit():
    assert audio.parse_wave(audio.wave_bytes(np.array([-32768, 32767]), 8000))[2].ravel().tolist() == [-32768, 32767]
    with pytest.raises(ValueError):
        audio.wave_bytes(np.array([32768]), 8000)


def vectors(spark, v, label=None):
    rows = [(1, i, x.tolist(), int(label[i]) if label is not None else i // 16) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "track_id long, i long, v array<double>, label long")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_silhouette_over_blocks(spark):
    v = rng.normal(size=(2100, 3))
    v[7] = v[2050]
    label = rng.integers(0, 3, 2100)
    label[5] = 9
    out = structure.silhouette(vectors(spark, v, label))
    assert "Join" not in plan_of(out)
    assert np.isclose(out.first()["silhouette"], structure.silhouette_of(v, label))


def test_segment_affinity_over_blocks(spark):
    v = rng.normal(size=(1100, 3))
    sigma = spark.createDataFrame([(1, 2.0)], "track_id long, sigma double")
    out = structure.segment_affinity(vectors(spark, v).withColumnRenamed("label", "segment"), sigma)
    assert "CoGroup" in plan_of(out)
    got = {(r["a"], r["b"]): r["affinity"] for r in out.collect()}
    e = np.exp(-((v[:, None] - v[None]) ** 2).sum(2) / 4)
    assert len(got) == 69 * 69 and np.isclose(got[68, 3], e[1088:1100, 48:64].mean()) and np.isclose(got[2, 2], (e[32:48, 32:48].sum() - 16) / 240)


def laplacian_of_parts(n, parts):
    """Rings with chords, unconnected with each other."""
    m = np.zeros((n, n))
    i = np.arange(n)
    m[i, (i + parts) % n] = 1
    j = i % parts + parts * rng.integers(0, n // parts, n)
    m[i, j] = np.where(i != j, 0.5, 0)
    m = np.maximum(m, m.T)
    d = np.sqrt(m.sum(1))
    return np.eye(n) - m / d[:, None] / d[None]


@pytest.mark.parametrize("parts", [1, 12])
def test_lowest_values_of_large_laplacians(parts):
    m = laplacian_of_parts(1320, parts)
    src, dst = np.nonzero(m)
    values, vectors = structure.lowest(1320, src, dst, m[src, dst])
    assert vectors.shape == (1320, structure.PAIRS) and np.allclose(values, np.linalg.eigvalsh(m)[: structure.PAIRS], atol=1e-9)
    assert np.abs(m @ vectors - vectors * values).max() < 1e-7 and np.allclose(vectors.T @ vectors, np.eye(structure.PAIRS))


def test_clusters_take_no_cube():
    import tracemalloc

    x = rng.normal(size=(1500, 32))
    label = rng.integers(0, 8, 1500)
    tracemalloc.start()
    got = structure.silhouette_of(x, label)
    structure.kmeans(x, 32, rounds=3, starts=1)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = np.sqrt(((x[:300, None] - x[None, :300]) ** 2).sum(2))
    few = label[:300]
    a, b = zip(*[(d[i, few == few[i]].sum() / ((few == few[i]).sum() - 1), min(d[i, few == k].mean() for k in range(8) if k != few[i])) for i in range(300)], strict=True)
    assert top < 60e6 and math.isfinite(got) and np.isclose(structure.silhouette_of(x[:300], few), np.mean((np.array(b) - a) / np.maximum(a, b)))


def test_tracks_of_a_small_table_are_dealt_out(spark):
    cells = spark.createDataFrame([(k, 0, 1, 1.0) for k in range(8)], "track_id long, src long, dst long, value double")
    assert structure.spread(cells).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def laplacian_of(n, edges, weight=None):
    """Cells of the normalised Laplacian of a graph."""
    src, dst = (np.concatenate([edges[:, k], edges[:, 1 - k]]) for k in (0, 1))
    w = np.tile(np.ones(len(edges)) if weight is None else weight, 2)
    degree = np.bincount(src, w, n)
    return np.concatenate([src, np.arange(n)]), np.concatenate([dst, np.arange(n)]), np.concatenate([-w / np.sqrt(degree[src] * degree[dst]), np.ones(n)])


def test_lowest_values_of_long_paths(monkeypatch):
    """Values that crowd at 0 are found without solving the whole matrix."""
    monkeypatch.setattr(structure, "eigen", lambda m: pytest.fail("solved whole"))
    n = 10_000
    path, half = np.stack([np.arange(n - 1), np.arange(1, n)], 1), np.arange(n // 2)
    even = structure.lowest(n, *laplacian_of(n, path))[0]
    assert np.allclose(even, 1 - np.cos(np.pi * np.arange(structure.PAIRS) / (n - 1)), rtol=1e-8, atol=1e-13)
    edges, weight = np.concatenate([path, np.stack([half, half + n // 2], 1)]), np.concatenate([rng.uniform(0.01, 0.5, n - 1), np.full(n // 2, 0.4)])
    src, dst, value = laplacian_of(n, edges, weight)
    values, vectors = structure.lowest(n, src, dst, value)
    product = np.stack([np.bincount(src, value * x[dst], n) for x in vectors.T], 1)
    assert np.linalg.norm(product - vectors * values, axis=0).max() < 1e-8 and np.allclose(vectors.T @ vectors, np.eye(structure.PAIRS))


@pytest.mark.parametrize("extra", [0, 300, 900])
def test_inverse_of_laplacians(extra):
    n = 1500
    far = rng.integers(0, n, (extra, 2))
    edges = np.unique(np.sort(np.concatenate([np.stack([np.arange(n - 1), np.arange(1, n)], 1), far[np.abs(far[:, 0] - far[:, 1]) > 1]]), 1), axis=0)
    cells = structure.summed(n, *laplacian_of(n, edges))
    m, x = np.zeros((n, n)), rng.normal(size=(n, 3))
    m[cells[0], cells[1]] = cells[2]
    assert np.allclose(structure.inverse(n, *cells)(x), structure.SHIFT * np.linalg.solve(m + structure.SHIFT * np.eye(n), x), atol=1e-9)
    values = structure.lowest(n, *cells)[0]
    assert np.allclose(values, np.linalg.eigvalsh(m)[: structure.PAIRS], atol=1e-9)


def test_inverse_is_not_taken_of_values_below_zero():
    n = 1500
    src, dst, value = structure.summed(n, *laplacian_of(n, np.stack([np.arange(n - 1), np.arange(1, n)], 1)))
    value = np.where(src == dst, 0.9, value)
    assert structure.inverse(n, src, dst, value) is None


def test_few_tracks_are_dealt_to_one_task_each(spark):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        cells = spark.range(3000).select((F.col("id") % 10).alias("track_id"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("value"))
        dealt = structure.spread(cells)
        tasks = dealt.select("track_id", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().agg(F.max("count"), F.sum("count")).first()
        plan = dealt.groupBy("track_id").applyInPandas(lambda pdf: pdf[:1], cells.schema)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(tasks) == (1, 10) and plan.count("Exchange") == 1
