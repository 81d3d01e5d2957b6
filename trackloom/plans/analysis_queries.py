"""Queries on whole analyses, chunked models, broadcast messages, and the batch forms of streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import pitch
from trackloom.operators import analysis, catalog, elliptic, filterbanks, graph, jumps, onsets, sequence, signals, tempo
from trackloom.plans.queries import BEATS, KNN, RUNS, beats, r6, register, tracks
from trackloom.sources.tracks import event_tracks, table
from trackloom.streaming import online

WINDOWS = BEATS + ", n AS (SELECT track_id, count(*) AS n FROM b GROUP BY track_id), st AS (SELECT track_id, n, CASE WHEN k = CAST(ceil(n / 12.0) AS BIGINT) - 1 AND n > 12 THEN n - 14 ELSE k * 12 - 2 END AS start FROM n, range(0, 100) q(k) WHERE k < ceil(n / 12.0)), cu AS (SELECT track_id, start, f AS frame, f - start AS at_ FROM st, range(0, 1200) q(f) WHERE f >= greatest(start, 0) AND f < least(start + 16, n))"


def frames(b):
    return b.select("track_id", F.col("idx").alias("frame"))


beats("chunk_windows", f"WITH {WINDOWS} SELECT track_id, start, frame, CAST(at_ AS INT) AS at FROM cu".replace("AS at FROM", 'AS "at" FROM'), lambda b: analysis.cuts(frames(b), 16, 2))
beats("chunk_join", f"WITH {WINDOWS} SELECT track_id, frame, arg_min(start * 1000 + frame, start) AS value FROM cu WHERE at_ >= 2 AND at_ < 14 GROUP BY ALL", lambda b: analysis.joined_cuts(analysis.cuts(frames(b), 16, 2).withColumn("value", F.col("start") * 1000 + F.col("frame")), 16, 2))
tracks("similarity_report", f"WITH {KNN}, r AS (SELECT track_id, sim, row_number() OVER (PARTITION BY track_id ORDER BY sim) AS k, count(*) OVER (PARTITION BY track_id) AS n FROM kn) SELECT track_id, round(min(CASE WHEN k >= ceil(n * 0.5) THEN sim END), 6) AS p50, round(min(CASE WHEN k >= ceil(n * 0.75) THEN sim END), 6) AS p75, count(*) FILTER (least(greatest(floor(sim * 10), 0), 9) = 2) AS third FROM r GROUP BY track_id", lambda f: analysis.similarity_report(graph.nearest(f, 10, 4), (0.5, 0.75)).select("track_id", r6(F.get("percentiles", 0)).alias("p50"), r6(F.get("percentiles", 1)).alias("p75"), F.get("histogram", 2).alias("third")))

KIND = "CASE WHEN event_id % 97 = 3 THEN 'stop' WHEN event_id % 3 = 0 THEN 'pause' WHEN event_id % 3 = 1 THEN 'resume' ELSE 'volume' END"


def commands(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), F.expr(KIND).alias("command"), (F.col("value") / 500).alias("volume"))


register("last_command", f"WITH c AS (SELECT user_id AS session, event_id AS n, {KIND} AS command, value / 500 AS volume FROM events), s AS (SELECT *, min(CASE WHEN command = 'stop' THEN n END) OVER (PARTITION BY session) AS stop FROM c), k AS (SELECT * FROM s WHERE stop IS NULL OR n <= stop), g AS (SELECT session, coalesce(arg_max(command = 'pause', n) FILTER (command IN ('pause', 'resume')), false) AS paused, bool_or(command = 'stop') AS stopped, arg_max(volume, n) FILTER (command = 'volume') AS v FROM k GROUP BY session) SELECT session, paused, stopped, round(CASE WHEN v <= 0.001 THEN -80 ELSE 20 * log10(v) END, 6) AS decibel FROM g")(lambda spark, d: analysis.last_command(commands(spark, d)).withColumn("decibel", r6("decibel")))
LE = " || ".join(f"printf('%02X', ({{0}} >> {8 * k}) & 255)" for k in range(4))
register("broadcast_frames", f"SELECT event_id, {LE.format('event_id')} || {LE.format('user_id')} || {LE.format('(event_id * 70000)')} || {LE.format('length(event_type)')} || hex(encode(event_type)) AS frame FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.hex(analysis.message(F.col("event_id"), F.col("user_id"), F.col("event_id") * 70000, F.length("event_type"), F.encode("event_type", "UTF-8"))).alias("frame"))
)
register("paired_updates", "WITH m AS (SELECT user_id AS session, event_id AS n, CASE WHEN event_type = 'click' THEN 'chunk' ELSE 'update' END AS kind FROM events WHERE event_type IN ('click', 'view')), g AS (SELECT *, count(*) FILTER (kind = 'chunk') OVER (PARTITION BY session ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM m), l AS (SELECT session, grp, max(n) FILTER (kind = 'chunk') AS n, max(n) FILTER (kind = 'update') AS u FROM g GROUP BY ALL) SELECT session, n, 'u' || u AS update FROM l WHERE n IS NOT NULL AND u IS NOT NULL".replace("AS update", 'AS "update"'))(
    lambda spark, d: online.paired(table(spark, d, "events").where("event_type in ('click', 'view')").select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), F.when(F.col("event_type") == "click", "chunk").otherwise("update").alias("kind"), F.concat(F.lit("u"), "event_id").alias("update")))
)
register("numbered_ring", "WITH r AS (SELECT user_id AS device, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id, count(*) OVER (PARTITION BY user_id) AS n, event_type AS message FROM events) SELECT device, id, message FROM r WHERE id > n - 50")(lambda spark, d: online.numbered_ring(table(spark, d, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("n"), F.col("event_type").alias("message"))))


def timed(spark, d):
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"), F.col("value").alias("x"))


def seconds(df, *columns):
    return df.select(*[(F.unix_micros(c) / 1e6).alias(c) if c in ("start", "end") else F.round(c, 4).alias(c) if c == "x" else F.col(c) for c in df.columns])


register("windowed_levels", "SELECT epoch_us(date_trunc('hour', ts)) / 1e6 AS start, event_type AS label, count(*) AS n, round(sum(value), 4) AS x FROM events GROUP BY ALL")(lambda spark, d: seconds(online.windowed_levels(timed(spark, d))))
register("session_levels", "WITH e AS (SELECT event_type AS label, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(nw) OVER (PARTITION BY label ORDER BY ts) AS g FROM e) SELECT epoch_us(min(ts)) / 1e6 AS start, epoch_us(max(ts)) / 1e6 + 1800 AS \"end\", label, count(*) AS n, round(sum(value), 4) AS x FROM s GROUP BY label, g")(lambda spark, d: seconds(online.session_levels(timed(spark, d))))
beats("online_onsets", "WITH RECURSIVE " + BEATS + ", m AS (SELECT *, avg(x) OVER w4 AS av4, count(*) OVER w4 AS c4, sum(x) OVER w4 AS s4, max(x) OVER w3 AS mx FROM b WINDOW w4 AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY track_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), p AS (SELECT track_id, idx / 10.0 AS t FROM m WHERE x <> 0 AND x >= s4 / 4 + 20 AND x >= mx), f AS (SELECT track_id, min(t) AS t FROM p GROUP BY track_id UNION ALL SELECT p.track_id, min(p.t) FROM f JOIN p ON p.track_id = f.track_id AND p.t - f.t > 0.3 + 1e-12 GROUP BY p.track_id, f.t) SELECT track_id, round(t, 6) AS t FROM f", lambda b: online.online_onsets(b, 20.0, 10.0, 3, 2, 0.3).withColumn("t", r6("t")))
beats("online_tempo", "WITH " + BEATS + ", h AS (SELECT a.track_id, tau, sum(a.x * coalesce(c.x, 0)) AS s FROM b a CROSS JOIN range(3, 16) q(tau) LEFT JOIN b c ON c.track_id = a.track_id AND c.idx = a.idx - tau WHERE a.idx >= (SELECT count(*) FROM b z WHERE z.track_id = a.track_id) - 20 GROUP BY ALL) SELECT track_id, tau, round(s, 4) AS strength FROM h", lambda b: online.online_tempo(b, 10.0, 40.0, 200.0, seconds=2.0, method="acf").withColumn("strength", F.round("strength", 4)))
register("online_beats")(lambda spark, d: online.online_beats(event_tracks(table(spark, d, "events")).select("track_id", "idx", (F.col("x") / 600 + 0.05).alias("x")), 10.0, 60.0, 200.0))


def feature_beats(f):
    """Beats whose features are parts of a vector, two to a second, every fourth one a downbeat."""
    return f.select("track_id", F.col("i").alias("idx"), (F.col("i") * 0.5).alias("t"), F.abs(F.get("v", 40)).alias("rms"), F.abs(F.get("v", 41)).alias("centroid"), F.slice("v", 1, 20).alias("mfcc"), F.transform(F.slice("v", 21, 12), F.abs).alias("chroma"), (F.col("i") % 4 == 0).alias("downbeat"))


tracks("analysis_v3", None, lambda f: analysis.analyze(feature_beats(f), 16, 2.0, 4, 0.5, 4)[0])
tracks("analysis_segments", None, lambda f: analysis.analyze(feature_beats(f), 16, 2.0, 4, 0.5, 4)[1])
tracks("analysis_spectral", None, lambda f: analysis.analyze_spectral(feature_beats(f)))
tracks("analysis_v2", None, lambda f: analysis.analyze_older(feature_beats(f), True)[0])
beats("log_filtered", None, lambda b: analysis.log_filtered(signals.frames(b, 16, 4), filterbanks.mel_bank(pitch.bin_grid(8, 100.0), 4, 5.0, 50.0)))
beats("sliding_transform", None, lambda b: analysis.sliding_transform(b, 100.0, 5.0, 4, 2, 8))
beats("semitone_energies", None, lambda b: elliptic.semitone_energies(sequence.durations(b).select("track_id", "idx", (F.col("x") / 500).alias("x")), 882.0, 50.0, 100.0, 110.0))

# --- small operators ------------------------------------------------------------------------------------------------------------------------

beats("rescale", f"WITH {BEATS} SELECT track_id, idx, round(CAST(x * 60 AS INTEGER) / 32767.0, 9) AS x FROM b", lambda b: b.select("track_id", "idx", F.round(signals.rescale(F.rint(F.col("x") * 60).cast("int"), 16), 9).alias("x")))
STREAM = BEATS + ", s AS (SELECT track_id, idx AS step, idx * 3 AS beat, idx * 1.5 AS stream FROM b), q AS (SELECT DISTINCT track_id, idx * 2.25 AS position FROM b), o AS (SELECT q.track_id, q.position, s.step, s.beat FROM q ASOF JOIN s ON s.track_id = q.track_id AND s.stream <= q.position)"
beats("client_sync", f"WITH {STREAM} SELECT track_id, CAST(position AS DOUBLE) AS position, step, beat FROM o", lambda b: jumps.at_position(b.select("track_id", F.col("idx").alias("step"), (F.col("idx") * 3).alias("beat"), (F.col("idx") * 1.5).alias("stream")), b.select("track_id", (F.col("idx") * 2.25).alias("position"))))
TRIMMED = RUNS + ", g AS (SELECT track_id, run AS segment, min(t) AS start_time, max(t) AS last_t FROM r GROUP BY ALL), s AS (SELECT track_id, segment, start_time, coalesce(lead(start_time) OVER (PARTITION BY track_id ORDER BY segment), last_t) AS end_time FROM g), e AS (SELECT track_id, avg(t) AS e FROM b GROUP BY track_id)"
beats("trim_segments", f"WITH {TRIMMED} SELECT track_id, segment, start_time, round(least(end_time, e), 3) AS end_time FROM s JOIN e USING (track_id) WHERE start_time < least(end_time, e)", lambda b: jumps.trimmed_segments(sequence.run_segments(b), b.groupBy("track_id").agg(F.avg("t").alias("end_time"))).select("track_id", "segment", "start_time", F.round("end_time", 3).alias("end_time")))
beats("score_table", f"WITH {BEATS} SELECT track_id, idx AS k, format('{{:<10d}} {{:<15.2f}}', idx, x) AS line FROM b", lambda b: catalog.score_table(b.select("track_id", F.col("idx").alias("k"), F.col("x").alias("score"))).withColumn("line", F.regexp_replace("line", r"(\.\d\d)00", "$1  ")))
register("expand_notes", "SELECT l_orderkey AS onset, CAST(l_linenumber AS BIGINT) AS pitch, 0.6::DOUBLE AS duration, 100.0::DOUBLE AS velocity FROM lineitem")(lambda spark, d: onsets.expanded_notes(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("onset"), F.col("l_linenumber").cast("long").alias("pitch"))))
beats("step_samples", f"WITH {BEATS} SELECT track_id, idx AS step, idx * 100 AS first, idx * 100 + 100 AS last FROM b WHERE idx % 2 = 0", lambda b: analysis.chunk_of(b.where("idx % 2 = 0").select("track_id", F.col("idx").alias("step"), F.col("idx").alias("beat")), b.select("track_id", "idx", (F.col("idx") * 100).alias("first"), (F.col("idx") * 100 + 100).alias("last"))))
register("tempo_classes", "SELECT CAST(vec_id AS BIGINT) AS track_id, k - 1 AS tau, CAST(embedding[k] AS DOUBLE) AS strength FROM embeddings, range(1, 65) q(k) WHERE k - 1 BETWEEN 40 AND 60")(lambda spark, d: tempo.histogram_classes(table(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("classes")), 40.0, 60.0))
