"""Queries on structure: self-similarity, novelty, recurrence, jump tables, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import decode, graph, jumps, pooling, sequence, structure, walks
from trackloom.plans.queries import BEATS, KNN, RUNS, TRACKS, beats, r6, sides, tracks
from trackloom.sources.scratch import kept

LONG = TRACKS + ", f AS (SELECT track_id, i, k - 1 AS k, v[k] AS x FROM e, range(1, 65) q(k))"

tracks("ssm_cosine", f"WITH {TRACKS} SELECT a.track_id, a.i, c.i AS j, round(list_cosine_similarity(a.v, c.v), 6) AS s FROM e a JOIN e c ON a.track_id = c.track_id AND abs(a.i - c.i) <= 8", lambda f: structure.similarity(f.withColumn("v", structure.unit("v")), 8).select("track_id", "i", "j", r6("s").alias("s")))
NOVELTY = TRACKS + """, n AS (SELECT track_id, count(*) AS n FROM e GROUP BY track_id), o AS (SELECT o, CASE WHEN o < 0 THEN -1 ELSE 1 END AS sg FROM range(-8, 8) q(o)),
p AS (SELECT a.track_id, a.i, sum(x.sg * y.sg * exp(-(x.o * x.o + y.o * y.o) / 32.0) * list_inner_product(b.v, c.v)) AS s FROM e a CROSS JOIN o x CROSS JOIN o y JOIN e b ON b.track_id = a.track_id AND b.i = a.i + x.o JOIN e c ON c.track_id = a.track_id AND c.i = a.i + y.o GROUP BY ALL),
nov AS (SELECT e.track_id, e.i, CASE WHEN e.i >= 8 AND e.i < n - 8 THEN greatest(s, 0) ELSE 0 END AS novelty FROM e JOIN n USING (track_id) LEFT JOIN p USING (track_id, i))"""
tracks("novelty", f"WITH {NOVELTY} SELECT track_id, i, round(novelty, 5) AS novelty FROM nov", lambda f: structure.novelty(f, 16).select("track_id", "i", F.round("novelty", 5).alias("novelty")))
tracks("lag_embed", f"WITH {TRACKS}, l AS (SELECT a.track_id, a.i, l, coalesce(b.v[1], 0) AS first, coalesce(b.v[64], 0) AS last FROM e a CROSS JOIN range(0, 4) q(l) LEFT JOIN e b ON b.track_id = a.track_id AND b.i = a.i + l) SELECT track_id, i, CAST(l AS INT) AS l, round(first, 6) AS first, round(last, 6) AS last FROM l", lambda f: structure.lagged(f, 4).withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("track_id", "i", "l", r6(F.get("v", F.col("l") * 64)).alias("first"), r6(F.get("v", F.col("l") * 64 + 63)).alias("last")))
tracks("feature_zscore", f"WITH {LONG}, s AS (SELECT track_id, k, avg(x) AS m, stddev_pop(x) AS sd FROM f GROUP BY ALL) SELECT track_id, i, round(sum(CASE WHEN sd > 1e-6 THEN (x - m) / sd ELSE x END * (k + 1)), 4) AS y FROM f JOIN s USING (track_id, k) GROUP BY track_id, i", lambda f: structure.zscored(f).select("track_id", "i", F.round(F.aggregate(F.transform("v", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("y")))
tracks("row_normalise", f"WITH {LONG}, n AS (SELECT track_id, i, sqrt(sum(x * x)) AS n FROM f GROUP BY ALL) SELECT track_id, i, k, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS x FROM f JOIN n USING (track_id, i)", lambda f: f.select("track_id", "i", F.posexplode(structure.unit("v")).alias("k", "x")).select("track_id", "i", F.col("k").cast("long").alias("k"), r6("x").alias("x")))

MUTUAL = TRACKS + ", ds AS (SELECT a.track_id, a.i AS src, c.i AS dst, round(list_distance(a.v, c.v), 12) AS d FROM e a JOIN e c ON a.track_id = c.track_id AND abs(a.i - c.i) > 3), kk AS (SELECT *, row_number() OVER (PARTITION BY track_id, src ORDER BY d, dst) AS rank FROM ds QUALIFY rank <= 8), mu AS (SELECT a.track_id, a.src, a.dst, a.d * a.d AS d2 FROM kk a JOIN kk b ON a.track_id = b.track_id AND a.src = b.dst AND a.dst = b.src)"
tracks("knn_mutual", f"WITH {MUTUAL} SELECT track_id, src, dst FROM mu", lambda f: graph.recurrence(f, 8))
tracks("diag_density", f"WITH {MUTUAL}, n AS (SELECT track_id, count(*) AS n FROM e GROUP BY track_id), d AS (SELECT track_id, dst - src AS d, count(*) AS c FROM mu WHERE dst - src >= 10 GROUP BY ALL) SELECT n.track_id, round(coalesce(max(c / (n - d)), 0), 6) AS density FROM n LEFT JOIN d ON n.track_id = d.track_id AND d < least(n, 200) GROUP BY n.track_id", lambda f: structure.diagonal_density(graph.recurrence(f, 8), f).select("track_id", r6("density").alias("density")))
tracks("diag_median", f"""WITH {MUTUAL}, n AS (SELECT track_id, count(*) AS n FROM e GROUP BY track_id), g AS (SELECT a.track_id, a.i AS src, b.i AS dst, b.i - a.i AS d, n, CASE WHEN m.src IS NULL THEN 0 ELSE 1 END AS x FROM e a JOIN e b ON a.track_id = b.track_id JOIN n ON n.track_id = a.track_id LEFT JOIN mu m ON m.track_id = a.track_id AND m.src = a.i AND m.dst = b.i),
w AS (SELECT track_id, src, dst, d, n, x, list_sort(list(x) OVER (PARTITION BY track_id, d ORDER BY src ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS l FROM g) SELECT track_id, src, dst FROM w WHERE CASE WHEN n - abs(d) < 3 THEN x ELSE l[len(l) // 2 + 1] END = 1""", lambda f: structure.diagonal_median(graph.recurrence(f, 8), f, 7))
SREP = MUTUAL + ", sg AS (SELECT track_id, list_sort(list(d2))[len(list(d2)) // 2 + 1] AS s FROM mu WHERE src < dst GROUP BY track_id), rep AS (SELECT mu.track_id, src, dst, exp(-d2 / greatest(coalesce(s, 1), 1e-6)) AS weight FROM mu LEFT JOIN sg USING (track_id))"
tracks("srep", f"WITH {SREP} SELECT track_id, src, dst, round(weight, 5) AS weight FROM rep", lambda f: structure.repetition_affinity(graph.recurrence(f, 8), f).select("track_id", "src", "dst", F.round("weight", 5).alias("weight")))
PATH = ", st AS (SELECT a.track_id, a.i, list_distance(a.v, c.v) * list_distance(a.v, c.v) AS d2 FROM e a JOIN e c ON a.track_id = c.track_id AND c.i = a.i + 1), ps AS (SELECT track_id, list_sort(list(d2))[len(list(d2)) // 2 + 1] AS s FROM st GROUP BY track_id), pa AS (SELECT st.track_id, i, greatest(exp(-d2 / CASE WHEN s < 1e-10 THEN 1 ELSE s END), 0.01) AS weight FROM st JOIN ps USING (track_id))"
tracks("path_affinity", f"WITH {TRACKS}{PATH} SELECT track_id, i, round(weight, 6) AS weight FROM pa", lambda f: structure.path_affinity(f).select("track_id", "i", r6("weight").alias("weight")))
MU = ", pd AS (SELECT track_id, i, sum(weight) AS p FROM (SELECT track_id, i, weight FROM pa UNION ALL SELECT track_id, i + 1, weight FROM pa) GROUP BY ALL), rd AS (SELECT track_id, src AS i, sum(weight) AS r FROM rep GROUP BY ALL), bo AS (SELECT track_id, i, coalesce(p, 0) AS p, coalesce(p, 0) + coalesce(r, 0) AS b FROM pd FULL JOIN rd USING (track_id, i)), mm AS (SELECT track_id, CASE WHEN sum(b * b) < 1e-10 THEN 0.5 ELSE sum(p * b) / sum(b * b) END AS mu FROM bo GROUP BY track_id)"


def affinities(f: DataFrame):
    rep, path = structure.repetition_affinity(graph.recurrence(f, 8), f), structure.path_affinity(f)
    return rep, path, structure.balance(path, rep)


tracks("optimal_mu", f"WITH {SREP}{PATH}{MU} SELECT track_id, round(mu, 5) AS mu FROM mm", lambda f: affinities(f)[2].select("track_id", F.round("mu", 5).alias("mu")))
LAP = SREP + PATH + MU + ", af AS (SELECT track_id, src, dst, sum(w) AS w FROM (SELECT rep.track_id, src, dst, mu * weight AS w FROM rep JOIN mm USING (track_id) UNION ALL SELECT pa.track_id, i, i + 1, (1 - mu) * weight FROM pa JOIN mm USING (track_id) UNION ALL SELECT pa.track_id, i + 1, i, (1 - mu) * weight FROM pa JOIN mm USING (track_id)) GROUP BY ALL), dg AS (SELECT track_id, src AS i, sum(w) AS d FROM af GROUP BY ALL)"
tracks("laplacian", f"WITH {LAP} SELECT af.track_id, src, dst, round(-w / sqrt(a.d * b.d), 5) AS value FROM af JOIN dg a ON a.track_id = af.track_id AND a.i = src JOIN dg b ON b.track_id = af.track_id AND b.i = dst UNION ALL SELECT track_id, i, i, 1.0 FROM e", lambda f: structure.laplacian(structure.combined_affinity(*[affinities(f)[k] for k in (1, 0, 2)]), f).select("track_id", "src", "dst", F.round("value", 5).alias("value")))


def with_labels(f: DataFrame) -> DataFrame:
    return f.withColumn("label", F.floor(F.col("i") / 16) % 3)


LAB = TRACKS + ", la AS (SELECT *, (i // 16) % 3 AS label FROM e)"
tracks("silhouette", f"WITH {LAB}, p AS (SELECT a.track_id, a.i, a.label AS x, b.label AS y, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM la a JOIN la b ON a.track_id = b.track_id GROUP BY ALL), ab AS (SELECT track_id, i, max(CASE WHEN x = y THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN x <> y THEN s / n END) AS b FROM p GROUP BY ALL) SELECT track_id, round(avg(CASE WHEN b IS NOT NULL THEN CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END END), 6) AS silhouette FROM ab GROUP BY track_id", lambda f: structure.silhouette(with_labels(f)).select("track_id", r6("silhouette").alias("silhouette")))
tracks("segment_pool", f"WITH {LONG} SELECT track_id, i // 16 AS segment, k, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std FROM f GROUP BY ALL", lambda f: structure.segment_pooled(f.withColumn("segment", F.floor(F.col("i") / 16))).select("track_id", "segment", F.posexplode(F.arrays_zip("median", "std")).alias("k", "z")).select("track_id", "segment", F.col("k").cast("long").alias("k"), r6("z.median").alias("median"), r6("z.std").alias("std")))
SIGMA = TRACKS + ", nd AS (SELECT a.track_id, list_distance(a.v, c.v) AS d FROM e a JOIN e c ON a.track_id = c.track_id AND c.i > a.i AND c.i < a.i + 50), si AS (SELECT track_id, list_sort(list(d))[len(list(d)) // 2 + 1] AS sigma FROM nd GROUP BY track_id)"
tracks("band_sigma", f"WITH {SIGMA} SELECT track_id, round(sigma, 6) AS sigma FROM si", lambda f: structure.band_sigma(f).select("track_id", r6("sigma").alias("sigma")))
tracks("segment_affinity", f"WITH {SIGMA} SELECT a.track_id, a.i // 16 AS a, b.i // 16 AS b, round(avg(exp(-list_distance(a.v, b.v) * list_distance(a.v, b.v) / (sigma * sigma))), 6) AS affinity FROM e a JOIN e b ON a.track_id = b.track_id AND a.i <> b.i JOIN si ON si.track_id = a.track_id GROUP BY ALL", lambda f: structure.segment_affinity(f.withColumn("segment", F.floor(F.col("i") / 16)), structure.band_sigma(f)).select("track_id", "a", "b", r6("affinity").alias("affinity")))

BARS = BEATS + ", bb AS (SELECT *, CAST(sum(CASE WHEN label = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx) AS BIGINT) AS bar FROM b), ba AS (SELECT *, (row_number() OVER (PARTITION BY track_id, bar ORDER BY idx) - 1) % 4 AS bp FROM bb), pk AS (SELECT track_id, idx FROM b WHERE x > 300)"


def with_bars(b: DataFrame) -> DataFrame:
    return sequence.bar_positions(b, F.col("label") == "signup")


def snap(b: DataFrame) -> DataFrame:
    return structure.snapped(b.where("x > 300").select("track_id", F.col("idx").alias("i")), with_bars(b).select("track_id", "idx", "bar_position"))


beats("snap_downbeats", f"WITH {BARS}, to_ AS (SELECT pk.track_id, pk.idx AS peak, coalesce((SELECT first(ba.idx ORDER BY abs(ba.idx - pk.idx), ba.idx) FROM ba WHERE ba.track_id = pk.track_id AND ba.bp = 0 AND abs(ba.idx - pk.idx) <= 4), pk.idx) AS i FROM pk), l AS (SELECT *, lag(i) OVER (PARTITION BY track_id ORDER BY peak) AS p FROM to_) SELECT track_id, peak, i FROM l WHERE p IS NULL OR p <> i", snap)
beats("boundaries", f"WITH {BEATS}, n AS (SELECT track_id, count(*) AS n FROM b GROUP BY track_id), c AS (SELECT DISTINCT track_id, idx AS i FROM b WHERE x > 400 UNION SELECT track_id, 0 FROM n) SELECT track_id, CAST(row_number() OVER w - 1 AS INT) AS segment, i AS start, coalesce(lead(i) OVER w, n) AS stop FROM c JOIN n USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY i)", lambda b: structure.boundaries(b.where("x > 400").select("track_id", F.col("idx").alias("i")), b.select("track_id", F.col("idx").alias("i"))))

# --- jumps -----------------------------------------------------------------------------------------------------------------------

PLACED = RUNS + ", q AS (SELECT *, row_number() OVER (PARTITION BY track_id, run ORDER BY idx) - 1 AS place FROM r), nx AS (SELECT *, coalesce(lead(idx) OVER w, 0) AS ni, coalesce(lead(label) OVER w, first(label) OVER w) AS nl, coalesce(lead(place) OVER w, 0) AS np FROM q WINDOW w AS (PARTITION BY track_id ORDER BY idx))"
V1 = PLACED + ", v1 AS (SELECT n.track_id, n.idx AS src, t.idx AS dst FROM nx n JOIN q t ON t.track_id = n.track_id AND t.label = nl AND t.place = np AND t.idx % 4 = ni % 4 AND t.run <> n.run AND t.idx <> ni)"
beats("jump_candidates_v1", f"WITH {V1} SELECT * FROM v1", jumps.candidates_v1)
V2 = PLACED + ", bb AS (SELECT *, CAST(sum(CASE WHEN label = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx) AS BIGINT) AS bar FROM q), ba AS (SELECT *, (row_number() OVER (PARTITION BY track_id, bar ORDER BY idx) - 1) % 4 AS bp FROM bb), nb AS (SELECT nx.*, z.bp AS nbp FROM nx JOIN ba z ON z.track_id = nx.track_id AND z.idx = nx.ni), v2 AS (SELECT n.track_id, n.idx AS src, t.idx AS dst FROM nb n JOIN ba t ON t.track_id = n.track_id AND t.label = nl AND t.place = np AND t.bp = nbp AND t.run <> n.run AND t.idx <> ni AND abs(t.idx - ni) >= 8)"
beats("jump_candidates_v2", f"WITH {V2} SELECT * FROM v2", lambda b: jumps.candidates_v2(with_bars(b)))
beats("loop_closure", f"WITH {V1} SELECT track_id, src AS last, min(dst) AS target FROM v1 WHERE (track_id, src) IN (SELECT (track_id, max(src)) FROM v1 GROUP BY track_id) GROUP BY ALL", lambda b: jumps.last_jump(jumps.candidates_v1(b)))
beats("outro", f"WITH {V1}, l AS (SELECT track_id, max(src) AS last FROM v1 GROUP BY track_id) SELECT b.track_id, b.idx FROM b JOIN l USING (track_id) WHERE b.idx > last", lambda b: jumps.outro(b, jumps.candidates_v1(b)).select("track_id", "idx"))
beats("loop_start", f"WITH {BEATS}, n AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM b), l AS (SELECT track_id, label AS l, (idx + 1) % 4 AS p FROM n WHERE idx = n - 1) SELECT n.track_id, coalesce(min(CASE WHEN label = l AND idx % 4 = p AND idx <= 0.5 * n THEN idx END), 0) AS next FROM n JOIN l USING (track_id) GROUP BY n.track_id", jumps.first_match)
beats("jump_furthest", f"WITH {V1}, qt AS (SELECT track_id, idx, floor(idx / (count(*) OVER (PARTITION BY track_id) / 4.0)) AS q FROM b), f AS (SELECT v1.*, row_number() OVER (PARTITION BY v1.track_id, src ORDER BY abs(dst - src) DESC, dst) AS k FROM v1 JOIN qt a ON a.track_id = v1.track_id AND a.idx = src JOIN qt z ON z.track_id = v1.track_id AND z.idx = dst WHERE a.q <> z.q) SELECT track_id, src, dst FROM f WHERE k = 1", lambda b: jumps.furthest(b, jumps.candidates_v1(b)))
V3 = KNN + ", n3 AS (SELECT track_id, i, coalesce(lead(i) OVER (PARTITION BY track_id ORDER BY i), 0) AS ni FROM e), v3 AS (SELECT n3.track_id, n3.i AS src, jg.dst, jg.rank FROM n3 JOIN jg ON jg.track_id = n3.track_id AND jg.src = ni WHERE jg.dst % 4 = ni % 4 AND abs(jg.dst - n3.i) >= 8)"


def frame_bars(f: DataFrame) -> DataFrame:
    return f.select("track_id", F.col("i").alias("idx"), (F.col("i") % 4).alias("bar_position"))


def v3_edges(f: DataFrame) -> DataFrame:
    return jumps.from_graph(graph.jump_graph(f), frame_bars(f))


tracks("jump_filter_v3", f"WITH {V3} SELECT track_id, src, dst, CAST(rank AS INT) AS rank FROM v3", v3_edges)
PRUNE = V3 + ", sz AS (SELECT e.track_id, greatest(coalesce(max(v3.src) + 1, 0), least(max(e.i) + 1, 32)) AS n FROM e LEFT JOIN v3 ON v3.track_id = e.track_id GROUP BY e.track_id)"
tracks("prune_tail", f"WITH {PRUNE} SELECT e.track_id, e.i AS idx, count(v3.dst) FILTER (v3.dst < n) AS candidates FROM e JOIN sz USING (track_id) LEFT JOIN v3 ON v3.track_id = e.track_id AND v3.src = e.i WHERE e.i < n GROUP BY ALL", lambda f: (lambda rows, kept: jumps.nested(rows, kept).select("track_id", "idx", F.size("candidates").cast("long").alias("candidates")))(*jumps.pruned(frame_bars(f), v3_edges(f))))
tracks("candidate_stats", f"WITH {V3}, c AS (SELECT e.track_id, e.i, count(v3.dst) AS n FROM e LEFT JOIN v3 ON v3.track_id = e.track_id AND v3.src = e.i GROUP BY ALL) SELECT track_id, round(avg(n), 6) AS mean, CAST(min(n) AS INT) AS least, CAST(max(n) AS INT) AS most, count(*) FILTER (n = 0) AS none, count(*) FILTER (n = 1) AS one, count(*) FILTER (n BETWEEN 2 AND 5) AS few, count(*) FILTER (n BETWEEN 6 AND 10) AS some, count(*) FILTER (n > 10) AS many FROM c GROUP BY track_id", lambda f: jumps.candidate_stats(jumps.nested(frame_bars(f), v3_edges(f))).withColumn("mean", r6("mean")))


def walk_v3(b: DataFrame) -> DataFrame:
    """The walk over each user's track: candidates are rows of the same label and bar position as the next row, 8 away at least."""
    bars = with_bars(b)
    n = jumps.with_next(bars.select("track_id", "idx", "label", "bar_position"), "label", "bar_position")
    to = bars.select("track_id", F.col("idx").alias("dst"), F.col("label").alias("next_label"), F.col("bar_position").alias("next_bar_position"))
    edges = n.join(to, ["track_id", "next_label", "next_bar_position"]).where(F.abs(F.col("dst") - F.col("idx")) >= 8).select("track_id", F.col("idx").alias("src"), "dst")
    start = bars.withColumn("t", F.col("t") - F.min("t").over(sequence.whole()))
    return decode.walks(jumps.nested(start, edges).select("track_id", "idx", "t", "bar_position", "candidates"), 200)


def older(b: DataFrame, with_bar: bool) -> DataFrame:
    bars = sequence.with_runs(with_bars(b))
    edges = jumps.candidates_v2(with_bars(b)) if with_bar else jumps.candidates_v1(b)
    start = bars.withColumn("t", (F.col("t") - F.min("t").over(sequence.whole())) / 3600)
    rows = jumps.nested(start, edges).join(jumps.successors(b, edges), ["track_id", "idx"])
    return walks.older_walks(rows.select("track_id", "idx", "t", "run", "next", "candidates", "bar_position"), 300, with_bars=with_bar)


beats("walk_v3", None, walk_v3)
beats("walk_v1", None, lambda b: older(b, False))
beats("walk_v2", None, lambda b: older(b, True))
beats("tick_durations", f"WITH {BEATS}, d AS (SELECT *, coalesce(lead(t) OVER w - t, 0) AS dur, (idx * 7) % count(*) OVER (PARTITION BY track_id) AS beat FROM b WINDOW w AS (PARTITION BY track_id ORDER BY idx)), j AS (SELECT d.track_id, d.idx AS step, d.beat, z.dur FROM d JOIN d z ON z.track_id = d.track_id AND z.idx = d.beat) SELECT track_id, step, beat, round(dur, 4) AS duration, round(coalesce(sum(dur) OVER (PARTITION BY track_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS stream FROM j", lambda b: jumps.tick_durations(b.withColumn("beat", (F.col("idx") * 7) % F.count("*").over(sequence.whole())).select("track_id", F.col("idx").alias("step"), "beat"), b).select("track_id", "step", "beat", F.round("duration", 4).alias("duration"), F.round("stream", 3).alias("stream")))
beats("angles", f"WITH {BEATS}, s AS (SELECT track_id, idx, t - min(t) OVER (PARTITION BY track_id) AS t FROM b) SELECT track_id, idx, round(t / max(t) OVER (PARTITION BY track_id) * 2 * pi() - pi() / 2, 6) AS angle FROM s", lambda b: jumps.angles(b.withColumn("t", F.col("t") - F.min("t").over(sequence.whole()))).select("track_id", "idx", r6("angle").alias("angle")))

# --- pooling: all rows of a user between two clicks ---------------------------------------------------------------------------------

IN_BEAT = BEATS + ", fb AS (SELECT track_id, t, x, greatest(sum(CASE WHEN label = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx) - 1, 0) AS beat FROM b), cl AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS beat FROM b WHERE label = 'click')"


def clicks(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return b.select("track_id", "t", "x"), b.where("label = 'click'").select("track_id", "t")


beats("beat_sync_median", f"WITH {IN_BEAT} SELECT track_id, CAST(beat AS BIGINT) AS beat, round(median(x), 6) AS median FROM fb GROUP BY ALL", lambda b: pooling.median_by_beat(*clicks(b)).withColumn("median", r6("median")))
beats("beat_sync_rms", f"WITH {IN_BEAT} SELECT cl.track_id, cl.beat, round(coalesce(sqrt(avg(x * x)), 0), 6) AS rms FROM cl LEFT JOIN fb USING (track_id, beat) GROUP BY ALL", lambda b: pooling.rms_by_beat(*clicks(b)).withColumn("rms", r6("rms")))
beats("over_maximum", f"WITH {BEATS} SELECT track_id, idx, round(x / max(x) OVER (PARTITION BY track_id), 6) AS x FROM b", lambda b: pooling.over_maximum(b, "x").select("track_id", "idx", r6("x").alias("x")))
sides("near_downbeats", "WITH " + BEATS + ", d AS (SELECT DISTINCT track_id, t FROM b WHERE label = 'click'), a AS (SELECT track_id, t FROM b WHERE label = 'view') SELECT d.track_id, d.t, EXISTS (SELECT 1 FROM a WHERE a.track_id = d.track_id AND abs(a.t - d.t) < 7200) AS downbeat FROM d", lambda d, a: pooling.is_near(d.select("track_id", "t"), a, 7200))


def affinity(f: DataFrame) -> DataFrame:
    """The combined affinity, each part computed once."""
    f = kept(f, "frames")
    rep, path = kept(structure.repetition_affinity(kept(graph.recurrence(f, 8), "recurrence"), f), "repetition"), kept(structure.path_affinity(f), "path")
    return kept(structure.combined_affinity(path, rep, structure.balance(path, rep)), "affinity")


tracks("spectral_cluster", None, lambda f: structure.spectral_clusters(affinity(f), f, smooth=9))
tracks("auto_k_score", None, lambda f: structure.cluster_scores(affinity(f), f, "balanced"))
tracks("segment_novelty", None, lambda f: structure.segment_by_novelty(f, frame_bars(f), 16, 2.0, 4, 0.5, 4))
