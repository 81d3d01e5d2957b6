"""The registered queries and their SQL twins on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import vectors as V
from trackloom.operators import catalog, graph, matching, sequence
from trackloom.sources.tracks import event_tracks, frames, table, vector_tracks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

BEATS = "b AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) / 1e6 AS t, event_type AS label, value AS x FROM events)"
RUNS = BEATS + ", c AS (SELECT *, CASE WHEN label <> lag(label) OVER w THEN 1 ELSE 0 END AS ch FROM b WINDOW w AS (PARTITION BY track_id ORDER BY idx)), r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY track_id ORDER BY idx) AS BIGINT) AS run FROM c)"
SEGMENTS = RUNS + ", s0 AS (SELECT track_id, run AS segment, min(label) AS label, min(t) AS start_time, max(t) AS last_t, count(*) AS n_beats FROM r GROUP BY ALL), s AS (SELECT track_id, segment, label, start_time, coalesce(lead(start_time) OVER (PARTITION BY track_id ORDER BY segment), last_t) AS end_time, n_beats FROM s0)"
W = "WINDOW w AS (PARTITION BY track_id ORDER BY idx)"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def beats(name: str, sql: str | None, make):
    """A query on the events' tracks."""
    register(name, sql)(lambda spark, d: make(event_tracks(table(spark, d, "events"))))


def r6(c):
    return F.round(c, 6)


beats("run_segments", f"WITH {SEGMENTS} SELECT * FROM s", sequence.run_segments)
beats("run_stats", f"WITH {SEGMENTS} SELECT track_id, count(*) AS runs, count(*) / count(DISTINCT label) AS ratio, min(n_beats) AS shortest FROM s GROUP BY track_id", sequence.run_stats)
beats("run_stats_v1", f"WITH {SEGMENTS}, m AS (SELECT *, max(segment) OVER (PARTITION BY track_id) AS top FROM s) SELECT track_id, count(*) AS runs, count(*) / count(DISTINCT label) AS ratio, min(CASE WHEN segment < top THEN n_beats END) AS shortest FROM m GROUP BY track_id", lambda b: sequence.run_stats(b, drop_last=True))
beats("run_longest", f"WITH {RUNS}, g AS (SELECT track_id, run, count(*) AS n, min(idx) AS f FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, f) AS k FROM g) SELECT track_id, n AS length, f AS first FROM o WHERE k = 1", sequence.longest_run)
beats("beat_durations", f"WITH {BEATS} SELECT track_id, idx, round(coalesce(lead(t) OVER w - t, 0), 6) AS duration FROM b {W}", lambda b: sequence.durations(b).select("track_id", "idx", r6("duration").alias("duration")))
beats("beat_intervals", f"WITH {BEATS} SELECT track_id, idx, round(coalesce(t - lag(t) OVER w, lead(t) OVER w - t), 6) AS interval FROM b {W}", lambda b: sequence.intervals(b).select("track_id", "idx", r6("interval").alias("interval")))
beats("quartiles", f"WITH {BEATS} SELECT track_id, idx, CAST(floor(idx / (count(*) OVER (PARTITION BY track_id) / 4.0)) AS BIGINT) AS quartile FROM b", lambda b: sequence.quartiles(b).select("track_id", "idx", "quartile"))
beats("stream_time", f"WITH {BEATS}, d AS (SELECT *, coalesce(lead(t) OVER w - t, 0) AS dur FROM b {W}) SELECT track_id, idx, round(coalesce(sum(dur) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS stream FROM d", lambda b: sequence.stream_time(b).select("track_id", "idx", F.round("stream", 3).alias("stream")))
beats("bar_positions", f"WITH {BEATS}, d AS (SELECT *, CAST(sum(CASE WHEN label = 'signup' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS bar FROM b {W}) SELECT track_id, idx, bar, (row_number() OVER (PARTITION BY track_id, bar ORDER BY idx) - 1) % 4 AS bar_position FROM d", lambda b: sequence.bar_positions(b, F.col("label") == "signup").select("track_id", "idx", "bar", "bar_position"))
beats("fade_cut_v3", f"WITH {BEATS}, m AS (SELECT track_id, list_sort(list(x))[CAST(floor(count(*) / 2) AS INT) + 1] AS m, max(t) - min(t) AS long FROM b GROUP BY track_id), l AS (SELECT b.*, long, max(CASE WHEN x > greatest(0.4 * m, 0.05) THEN idx END) OVER (PARTITION BY track_id) AS last FROM b JOIN m USING (track_id)) SELECT track_id, idx, x FROM l WHERE long < 60 OR last IS NULL OR last + 1 < 32 OR idx <= last", lambda b: sequence.fade_cut(b).select("track_id", "idx", "x"))
beats("fade_cut_v1", f"WITH {BEATS}, m AS (SELECT *, avg(x) OVER (PARTITION BY track_id) AS m FROM b), l AS (SELECT *, max(CASE WHEN x >= 0.75 * m THEN idx END) OVER (PARTITION BY track_id) AS last FROM m) SELECT track_id, idx, x FROM l WHERE idx <= last", lambda b: sequence.fade_cut_by_mean(b).select("track_id", "idx", "x"))
beats("threshold_crop", f"WITH {BEATS}, l AS (SELECT *, min(CASE WHEN x >= 400 THEN idx END) OVER (PARTITION BY track_id) AS lo, max(CASE WHEN x >= 400 THEN idx END) OVER (PARTITION BY track_id) AS hi FROM b) SELECT track_id, idx, x FROM l WHERE idx BETWEEN lo AND hi", lambda b: sequence.crop(b, 400).select("track_id", "idx", "x"))
beats("median_filter", f"WITH {BEATS}, n AS (SELECT track_id, idx, list_sort(list(x) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM b) SELECT track_id, idx, l[CAST(floor(len(l) / 2) AS INT) + 1] AS smooth FROM n", lambda b: sequence.median_filter(b, 2).select("track_id", "idx", "smooth"))
beats("mode_filter", f"WITH {BEATS}, n AS (SELECT a.track_id, a.idx, a.label AS own, c.label AS v, count(*) AS n FROM b a JOIN b c ON a.track_id = c.track_id AND c.idx BETWEEN a.idx - 4 AND a.idx + 4 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY track_id, idx ORDER BY n DESC, v <> own, v) AS k FROM n) SELECT track_id, idx, v AS mode FROM o WHERE k = 1", lambda b: sequence.mode_filter(b, 4).select("track_id", "idx", "mode"))
beats("gaussian_smooth", f"WITH {BEATS}, k AS (SELECT d, exp(-d * d / 2.0) AS w FROM range(-3, 4) q(d)), kk AS (SELECT d, w / sum(w) OVER () AS w FROM k) SELECT a.track_id, a.idx, round(sum(c.x * w), 6) AS smooth FROM b a CROSS JOIN kk JOIN b c ON c.track_id = a.track_id AND c.idx = a.idx + d GROUP BY ALL", lambda b: sequence.gaussian_smooth(b, 1.0).select("track_id", "idx", r6("smooth").alias("smooth")))
PEAKS = BEATS + ", p AS (SELECT *, avg(x) OVER v + 0.5 * stddev_pop(x) OVER v AS lim, lag(x) OVER w AS a, lead(x) OVER w AS z, count(*) OVER (PARTITION BY track_id) AS n FROM b WINDOW w AS (PARTITION BY track_id ORDER BY idx), v AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING))"
beats("peaks_adaptive", f"WITH {PEAKS} SELECT track_id, idx, x FROM p WHERE idx >= 4 AND idx < n - 4 AND x > lim AND x > a AND x > z", lambda b: sequence.adaptive_peaks(b, 4, 0.5).select("track_id", "idx", "x"))
beats("peaks_locked", f"WITH RECURSIVE {PEAKS}, q AS (SELECT track_id, idx FROM p WHERE idx >= 4 AND idx < n - 4 AND x > lim AND x > a AND x > z), f AS (SELECT track_id, min(idx) AS idx FROM q GROUP BY track_id UNION ALL SELECT q.track_id, min(q.idx) FROM f JOIN q ON q.track_id = f.track_id AND q.idx >= f.idx + 5 GROUP BY q.track_id, f.idx) SELECT track_id, idx FROM f", lambda b: sequence.lock_out(sequence.adaptive_peaks(b, 4, 0.5), 5))
beats("peaks_maxpool", f"WITH {BEATS}, p AS (SELECT *, max(x) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM b) SELECT track_id, idx, x FROM p WHERE x > 100 AND x = top", lambda b: sequence.max_peaks(b, 3, 100).select("track_id", "idx", "x"))
beats("combine_right", f"WITH {BEATS}, g AS (SELECT *, lead(t) OVER w - t AS gap FROM b {W}) SELECT track_id, idx, t FROM g WHERE gap IS NULL OR gap > 7200", lambda b: sequence.combine_right(b, 7200).select("track_id", "idx", "t"))
beats("quantize_events", f"WITH {BEATS} SELECT DISTINCT track_id, CAST(round_even(t / 3600, 0) AS BIGINT) AS frame FROM b", lambda b: sequence.quantize(b, 3600))
beats("comb_forward", f"WITH {BEATS} SELECT track_id, idx, round(x + 0.5 * coalesce(lag(x, 3) OVER w, 0), 6) AS y FROM b {W}", lambda b: sequence.comb_forward(b, 3, 0.5).select("track_id", "idx", r6("y").alias("y")))
beats("comb_backward", f"WITH {BEATS} SELECT a.track_id, a.idx, round(sum(pow(1 / 3.0, (a.idx - c.idx) / 3) * c.x), 6) AS y FROM b a JOIN b c ON c.track_id = a.track_id AND c.idx <= a.idx AND (a.idx - c.idx) % 3 = 0 GROUP BY ALL", lambda b: sequence.comb_backward(b, 3, 1 / 3).select("track_id", "idx", r6("y").alias("y")))
beats("tempo_hist_acf", f"WITH {BEATS} SELECT a.track_id, tau, round(sum(abs(a.x * c.x)), 4) AS strength FROM b a CROSS JOIN range(1, 9) q(tau) JOIN b c ON c.track_id = a.track_id AND c.idx = a.idx - tau GROUP BY ALL", lambda b: sequence.autocorrelation(b, 8).select("track_id", "tau", F.round("strength", 4).alias("strength")))
beats("tempo_global", f"WITH {BEATS} SELECT track_id, round(count(*) / (max(t) - min(t)) * 86400, 6) AS per_day FROM b GROUP BY track_id", lambda b: b.groupBy("track_id").agg(r6(F.count("*") / (F.max("t") - F.min("t")) * 86400).alias("per_day")))
beats("envelope", f"WITH {BEATS}, s AS (SELECT *, CAST(floor(count(*) OVER (PARTITION BY track_id) / 8) AS BIGINT) AS size FROM b), g AS (SELECT track_id, CAST(floor(idx / size) AS BIGINT) AS bin, sqrt(avg(x * x)) AS rms FROM s WHERE size > 0 AND floor(idx / size) < 8 GROUP BY ALL) SELECT track_id, bin, round(rms / max(rms) OVER (PARTITION BY track_id), 6) AS level FROM g", lambda b: sequence.envelope(b, 8).select("track_id", "bin", r6("level").alias("level")))
beats("jump_counts", f"WITH {RUNS} SELECT track_id, idx, count(*) OVER (PARTITION BY track_id, label) - count(*) OVER (PARTITION BY track_id, run) AS jumps FROM r", sequence.jump_counts)
beats("escape_fraction", f"WITH {SEGMENTS}, m AS (SELECT *, count(*) OVER (PARTITION BY track_id, label) > 1 AS more FROM s) SELECT track_id, round(avg(CASE WHEN more THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM m GROUP BY track_id", lambda b: sequence.escape_fraction(b).select("track_id", r6("fraction").alias("fraction")))
beats("ring_last_50", f"WITH {BEATS}, o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY idx DESC) AS k FROM b) SELECT track_id, idx, label FROM o WHERE k <= 50", lambda b: sequence.ring(b, 50).select("track_id", "idx", "label"))
beats("chunk_overlap", f"WITH {BEATS} SELECT track_id, idx, CAST(CASE WHEN idx < 14 THEN 0 ELSE floor((idx - 2) / 12) END AS BIGINT) AS chunk FROM b", lambda b: sequence.chunks(b, 16, 2).select("track_id", "idx", "chunk"))
beats("segment_map", f"WITH {RUNS} SELECT track_id, string_agg(CASE WHEN run % 2 = 0 THEN '#' ELSE '-' END, '' ORDER BY idx) AS map FROM r GROUP BY track_id", lambda b: sequence.with_runs(b).groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "run"))), lambda v: F.when(v["run"] % 2 == 0, "#").otherwise("-")), "").alias("map")))

SIDES = BEATS + ", d AS (SELECT track_id, t FROM b WHERE label = 'click'), a AS (SELECT track_id, t FROM b WHERE label = 'view')"
CLOSE = SIDES + ", lr AS (SELECT d.track_id, d.t, (SELECT max(a.t) FROM a WHERE a.track_id = d.track_id AND a.t <= d.t) AS l, (SELECT min(a.t) FROM a WHERE a.track_id = d.track_id AND a.t >= d.t) AS r FROM d), m AS (SELECT track_id, t, CASE WHEN r IS NULL OR t - l < r - t THEN l ELSE r END AS match FROM lr)"


def sides(name: str, sql: str | None, make):
    def run(spark, d):
        b = event_tracks(table(spark, d, "events"))
        return make(b.where("label = 'click'"), b.where("label = 'view'"))

    register(name, sql)(run)


sides("closest_match", f"WITH {CLOSE} SELECT track_id, t, match, round(t - match, 6) AS error FROM m", lambda d, a: matching.closest(d, a).withColumn("error", r6("error")))
sides("near_semi", f"WITH {CLOSE} SELECT track_id, t FROM m WHERE abs(t - match) <= 7200", lambda d, a: matching.near(d, a, 7200))
sides("match_errors", f"WITH {CLOSE} SELECT track_id, round(avg(t - match), 3) AS mean_error, round(avg(abs(t - match)), 3) AS mean_abs, round(stddev_pop(t - match), 3) AS std_error FROM m GROUP BY track_id", lambda d, a: matching.errors(d, a).select("track_id", *[F.round(c, 3).alias(c) for c in ("mean_error", "mean_abs", "std_error")]))
sides("pscore", f"WITH {CLOSE}, g AS (SELECT track_id, t - lag(t) OVER (PARTITION BY track_id ORDER BY t) AS g FROM a), i AS (SELECT track_id, median(g) AS md FROM g GROUP BY track_id), n AS (SELECT track_id, sum(dd) AS nd, sum(aa) AS na FROM (SELECT track_id, 1 AS dd, 0 AS aa FROM d UNION ALL SELECT track_id, 0, 1 FROM a) GROUP BY track_id), h AS (SELECT m.track_id, count(*) FILTER (abs(t - match) <= 0.2 * md) AS hits FROM m JOIN i USING (track_id) GROUP BY m.track_id) SELECT track_id, round(coalesce(hits, 0) / greatest(nd, na), 6) AS pscore FROM n LEFT JOIN h USING (track_id)", lambda d, a: matching.interval_accuracy(d, a, 0.2).select("track_id", r6("pscore").alias("pscore")))

LONG = "f AS (SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, 65) q(k))"
EMB = "e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def vectors(name: str, sql: str | None, make):
    register(name, sql)(lambda spark, d: make(table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), "embedding", "label")))


vectors("l2_norm", f"WITH {LONG} SELECT i, round(sqrt(sum(v * v)), 6) AS norm FROM f GROUP BY i", lambda v: v.select("i", r6(V.norm("embedding")).alias("norm")))
register("zscore", f"WITH {LONG}, s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS sd FROM f GROUP BY k) SELECT i, k, round(CASE WHEN sd <= 1e-6 THEN v ELSE (v - m) / sd END, 5) AS z FROM f JOIN s USING (k)")(
    lambda spark, d: (lambda f: f.join(F.broadcast(f.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))), "k").select("i", "k", F.round(F.when(F.col("sd") <= 1e-6, F.col("v")).otherwise((F.col("v") - F.col("m")) / F.col("sd")), 5).alias("z")))(frames(table(spark, d, "embeddings")))
)
vectors("dct", f"WITH {LONG}, c AS (SELECT c FROM range(0, 4) q(c)) SELECT i, c AS k, round(sum(v * sqrt(CASE WHEN c = 0 THEN 1 ELSE 2 END / 64.0) * cos(pi() * c * (2 * k + 1) / 128)), 6) AS y FROM f, c GROUP BY i, c", lambda v: v.select("i", F.posexplode(V.dct("embedding", 64, 4)).alias("k", "y")).select("i", F.col("k").cast("long").alias("k"), r6("y").alias("y")))
vectors("centroid", f"WITH {LONG} SELECT i, round(sum(abs(v) * k) / sum(abs(v)) / 64, 6) AS centroid FROM f GROUP BY i", lambda v: v.select("i", r6(V.centroid("embedding")).alias("centroid")))
register("amp_db", f"WITH {LONG} SELECT i, k, round(greatest(20 * log10(greatest(abs(v), 1e-10)), -80), 5) AS db FROM f")(lambda spark, d: frames(table(spark, d, "embeddings")).select("i", "k", F.round(V.decibel(F.abs("v")), 5).alias("db")))
register("chroma_fold", f"WITH {LONG} SELECT i, CAST(floor(k / 3) % 12 AS BIGINT) AS pitch, round(ln(1 + sum(abs(v))), 6) AS y FROM f GROUP BY ALL")(lambda spark, d: frames(table(spark, d, "embeddings")).groupBy("i", (F.floor(F.col("k") / 3) % 12).alias("pitch")).agg(r6(F.log1p(F.sum(F.abs("v")))).alias("y")))
TRACKS = "e AS (SELECT CAST(label AS BIGINT) AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def tracks(name: str, sql: str | None, make):
    """A query on the vectors' tracks, one for each label."""
    register(name, sql)(lambda spark, d: make(vector_tracks(table(spark, d, "embeddings"))))


tracks("path_weights", f"WITH {TRACKS} SELECT a.track_id, a.i, round(list_distance(a.v, c.v), 6) AS d FROM e a JOIN e c ON c.track_id = a.track_id AND c.i = a.i + 1", lambda f: graph.path_weights(f).select("track_id", "i", r6("d").alias("d")))
KNN = TRACKS + ", pr AS (SELECT a.track_id, a.i AS src, c.i AS dst, list_cosine_similarity(a.v, c.v) AS sim FROM e a JOIN e c ON a.track_id = c.track_id AND abs(a.i - c.i) > 4), kn AS (SELECT *, row_number() OVER (PARTITION BY track_id, src ORDER BY sim DESC, dst) AS rank FROM pr QUALIFY rank <= 10), cut AS (SELECT track_id, list_sort(list(sim), 'DESC')[CAST(floor(count(*) * 0.25) AS INT) + 1] AS lim FROM kn GROUP BY track_id), jg AS (SELECT track_id, src, dst, sim, rank FROM kn JOIN cut USING (track_id) WHERE sim >= lim)"
tracks("knn_jump_graph", f"WITH {KNN} SELECT track_id, src, dst, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM jg", lambda f: graph.jump_graph(f).select("track_id", "src", "dst", r6("sim").alias("sim"), "rank"))
tracks("graph_stats", f"WITH {KNN}, n AS (SELECT track_id, src, count(*) AS n FROM jg GROUP BY ALL) SELECT track_id, CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS candidates, count(*) AS frames, CAST(sum(n) AS BIGINT) AS edges FROM n GROUP BY 1, 2", lambda f: graph.graph_stats(graph.jump_graph(f)))

CAT = "c AS (SELECT p_partkey AS source, p_brand AS artist, p_name AS title FROM part)"


def parts(name: str, sql: str | None, make):
    register(name, sql)(lambda spark, d: make(table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))))


parts("catalog_search", f"WITH {CAT} SELECT * FROM c WHERE contains(lower(artist || ' ' || title), 'brand#1')", lambda c: catalog.search(c, "BRAND#1"))
parts("catalog_upsert", f"WITH {CAT}, n AS (SELECT source + 100000 * (source % 2) AS source, artist, upper(title) AS title FROM c WHERE source <= 20) SELECT * FROM n UNION ALL SELECT * FROM c WHERE source NOT IN (SELECT source FROM n)", lambda c: catalog.upsert(c, c.where("source <= 20").withColumn("title", F.upper("title")).withColumn("source", F.col("source") + 100000 * (F.col("source") % 2))))
parts("catalog_delete", f"WITH {CAT} SELECT * FROM c WHERE source % 7 <> 0", lambda c: catalog.delete(c, c.where("source % 7 = 0")))
RAW = "CASE source % 6 WHEN 0 THEN lower(artist) || ' - ' || title WHEN 1 THEN artist || ': ' || title WHEN 2 THEN artist || '|' || title WHEN 3 THEN title WHEN 4 THEN upper(artist) || ' \u2013 ' ELSE artist || '-' || title || '  ' END"
REST = "substr(raw, length(artist) + 1)"
parts("clean_title", f"""WITH {CAT}, r AS (SELECT *, {RAW} AS raw FROM c), s AS (SELECT *, {REST} AS rest FROM r),
k AS (SELECT *, trim(CASE WHEN starts_with(rest, ' - ') OR starts_with(rest, ' \u2013 ') OR starts_with(rest, ' \u2014 ') OR starts_with(rest, ' | ') THEN substr(rest, 4) WHEN starts_with(rest, ': ') THEN substr(rest, 3) WHEN starts_with(rest, '-') OR starts_with(rest, '\u2013') OR starts_with(rest, '\u2014') OR starts_with(rest, '|') OR starts_with(rest, ':') THEN substr(rest, 2) ELSE rest END) AS cut FROM s)
SELECT source, CASE WHEN starts_with(lower(raw), lower(artist)) AND regexp_matches(cut, '[a-zA-Z0-9]') THEN cut ELSE raw END AS cleaned FROM k""", lambda c: c.withColumn("raw", F.expr(RAW)).select("source", catalog.clean_title(F.col("artist"), F.col("raw")).alias("cleaned")))
register("cache_misses", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda spark, d: catalog.misses(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id"))
register("rle_labels", "WITH c AS (SELECT conv_id, turn, role, CASE WHEN role <> lag(role) OVER w THEN 1 ELSE 0 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c) SELECT conv_id AS track_id, run, min(role) AS label, min(turn) AS first, max(turn) + 1 AS last FROM r GROUP BY conv_id, run")(
    lambda spark, d: sequence.with_runs(table(spark, d, "conversations").select(F.col("conv_id").alias("track_id"), F.col("turn").alias("idx"), F.col("role").alias("label"))).groupBy("track_id", "run").agg(F.min("label").alias("label"), F.min("idx").alias("first"), (F.max("idx") + 1).alias("last"))
)
