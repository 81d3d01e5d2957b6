import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.evaluation import base
from trackloom.functions import vectors as V
from trackloom.operators import catalog, decode, graph, matching, sequence


def beats(spark, xs, labels=None, track=1):
    labels = labels or ["a"] * len(xs)
    return spark.createDataFrame([(track, i, float(i), l, float(x) if x is not None else None) for i, (x, l) in enumerate(zip(xs, labels, strict=True))], "track_id long, idx long, t double, label string, x double")


def test_runs_and_stats(spark):
    b = beats(spark, range(6), list("aabbba"))
    assert [(r.segment, r.label, r.n_beats, r.end_time) for r in sequence.run_segments(b).orderBy("segment").collect()] == [(0, "a", 2, 2.0), (1, "b", 3, 5.0), (2, "a", 1, 5.0)]
    assert sequence.run_stats(b).first().shortest == 1 and sequence.run_stats(b, drop_last=True).first().shortest == 2
    assert tuple(sequence.longest_run(b).first())[1:] == (3, 2)
    assert sequence.run_stats(beats(spark, [1, 2]), drop_last=True).first().shortest is None


def test_comb_filter_vectors(spark):
    b = beats(spark, [0, 0, 1, 0, 0, 1, 0, 0, 1])
    assert [r.y for r in sequence.comb_forward(b, 3, 0.5).orderBy("idx").collect()] == [0, 0, 1, 0, 0, 1.5, 0, 0, 1.5]
    assert [r.y for r in sequence.comb_backward(b, 3, 0.5).orderBy("idx").collect()] == [0, 0, 1, 0, 0, 1.5, 0, 0, 1.75]


def test_filters_peaks_and_empty(spark):
    b = beats(spark, [0, 5, 0, 0, 9, 0, 0, 7, 0])
    assert [r.idx for r in sequence.max_peaks(b, 2, 1).orderBy("idx").collect()] == [1, 4, 7]
    assert [r.idx for r in sequence.lock_out(sequence.max_peaks(b, 2, 1), 4).orderBy("idx").collect()] == [1, 7]
    assert [r.smooth for r in sequence.median_filter(b, 1).orderBy("idx").collect()][:3] == [5.0, 0.0, 0.0]
    empty = b.where("false")
    for f in (sequence.run_segments, sequence.durations, lambda d: sequence.median_filter(d, 2), lambda d: sequence.lock_out(d, 3), lambda d: sequence.envelope(d, 4)):
        assert f(empty).count() == 0
    k = np.exp(-np.arange(-3, 4) ** 2 / 2)
    want = np.convolve([0, 5, 0, 0, 9, 0, 0, 7, 0], k / k.sum(), mode="same")
    assert [r.smooth for r in sequence.gaussian_smooth(b, 1.0).orderBy("idx").collect()] == pytest.approx(want.tolist())


def test_matching(spark):
    d, a = beats(spark, [0] * 3).withColumn("t", F.col("t") * 2), beats(spark, [0] * 2).withColumn("t", F.col("t") * 2 + 1)
    assert [(r.t, r.match) for r in matching.closest(d, a).orderBy("t").collect()] == [(0.0, 1.0), (2.0, 3.0), (4.0, 3.0)]
    m = base.pooled(base.counted(base.matches(d, a, 1.0), "track_id")).first()
    assert (m.tp, m.fp, m.fn, m.recall) == (2, 1, 0, 1.0)


def test_nearest_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=(40, 5))
    rows = [(t, 7 * i if t else i, r.tolist()) for t in (0, 1) for i, r in enumerate(x)]
    v = spark.createDataFrame(rows, "track_id long, i long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    s[np.abs(np.subtract.outer(np.arange(40), np.arange(40))) <= 4] = -9
    want = {(i, int(j)) for i in range(40) for j in np.argsort(-s[i], kind="stable")[:3]}
    found = graph.nearest(v, 3, 4).collect()
    assert {(r.src, r.dst) for r in found if r.track_id == 0} == want
    # Sparse numbers: apart counts them as they are.
    assert {r.src for r in found if r.track_id == 1} == {7 * i for i in range(40)}
    assert graph.nearest(v.where("false"), 3, 4).count() == 0


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(V.norm("a"), V.cosine("a", "b"), V.distance("a", "b"), V.centroid("b")).first()
    assert tuple(r) == (5.0, 0.0, 5.0, 0.5)


def test_walk_invariants():
    n = 64
    cands = [[(i + 16) % n, (i + 32) % n] if i % 4 == 3 else [] for i in range(n)]
    rows = list(decode.walk([0.5 * i for i in range(n)], [i % 4 for i in range(n)], cands, 1000))
    assert len(rows) == 1000 and rows == list(decode.walk([0.5 * i for i in range(n)], [i % 4 for i in range(n)], cands, 1000))
    jumps = 0
    for (_, a, _, _), (_, b, _, _) in zip(rows, rows[1:], strict=False):
        assert b in ((a + 1) % n, *cands[a]) or (a == n - 1)
        jumps += b != (a + 1) % n
    assert jumps > 5


def test_catalog(spark):
    c = spark.createDataFrame([(1, "Ann", "ANN - Song"), (2, "Bob", "Bob"), (3, "Cy", "Other")], "source long, artist string, title string")
    assert [r[0] for r in c.orderBy("source").select(catalog.clean_title(F.col("artist"), F.col("title"))).collect()] == ["Song", "Bob", "Other"]
    assert catalog.upsert(c, c.where("source = 1").withColumn("title", F.lit("x"))).count() == 3
    assert catalog.delete(c, c.where("source < 3")).count() == 1 and catalog.search(c, "aNN").count() == 1


def test_online_peaks(spark, tmp_path):
    from trackloom.streaming.online import online_peaks

    src = str(tmp_path / "in")
    beats(spark, [0, 9, 9, 0, 9]).select("track_id", "t", "x").write.parquet(src)
    s = online_peaks(spark.readStream.schema("track_id long, t double, x double").parquet(src), 1.0, 2.0)
    q = s.writeStream.format("memory").queryName("peaks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted(r.t for r in spark.table("peaks").collect()) == [1.0, 4.0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["track_id", "segment", "label", "start_time", "end_time", "n_beats"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
