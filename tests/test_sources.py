"""Files written and read again, and parsers on hand-made bytes."""

import numpy as np
import pytest

from trackloom import pipelines
from trackloom.sources import audio, files, midi, text
from trackloom.streaming.online import online_beats, online_onsets, online_peaks, windowed_levels


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wave_bytes(bits):
    x = np.random.default_rng(bits).integers(-100, 100, (50, 2))
    rate, got_bits, got = audio.parse_wave(audio.wave_bytes(x, 8000, bits))
    assert (rate, got_bits) == (8000, bits) and (got == x).all()
    with pytest.raises(ValueError):
        audio.parse_wave(b"no file")


def test_wave_files(spark, tmp_path):
    x = np.sin(np.arange(100) / 5)
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track_id string, idx long, x double")
    assert audio.write_waves(s, f"file://{tmp_path}", 100) == ["a"]
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    got = audio.read_waves(spark, str(tmp_path)).orderBy("idx").collect()
    assert np.allclose([r["x"] for r in got], x, atol=1e-4) and got[0]["sample_rate"] == 100
    assert audio.read_waves(spark, str(tmp_path), start=0.5, stop=0.7).count() == 20
    assert {r["track_id"]: r["samples"] for r in audio.wave_info(spark, str(tmp_path)).collect()} == {"a": 100, "bad": None}
    play = spark.createDataFrame([("a", 0, 1), ("a", 1, 0)], "track_id string, step long, beat long")
    beats = spark.createDataFrame([("a", 0, 0, 10, 0.0), ("a", 1, 10, 30, 0.1)], "track_id string, idx long, first long, last long, t double")
    out = audio.rendered(play, beats, s).orderBy("idx").collect()
    assert np.allclose([r["x"] for r in out], np.concatenate([x[10:30], x[:10]])) and [r["idx"] for r in out] == list(range(30))


def test_text_files(spark, tmp_path):
    (tmp_path / "one.beats").write_text("# heading\n0.5 1\n\n1.0\t2 # x\n1.5 1\n")
    (tmp_path / "two.txt").write_text("0.1 60 0.5 90\n0.2 61\n")
    (tmp_path / "three.chords").write_text("0 1.5 C:maj\n1.5 2 N\n")
    (tmp_path / "four.key").write_text(" F# minor\n")
    (tmp_path / "five.tempo").write_text("60 120 0.3\n")
    at = lambda n: str(tmp_path / n)
    assert [tuple(r) for r in text.read_beats(spark, at("one.beats")).orderBy("t").collect()] == [("one", 0.5, 1), ("one", 1.0, 2), ("one", 1.5, 1)]
    assert text.read_beats(spark, at("one.beats"), downbeats=True).count() == 2 and text.read_events(spark, at("one.beats")).count() == 3
    assert [tuple(r)[1:] for r in text.read_notes(spark, at("two.txt")).orderBy("onset").collect()] == [(0.1, 60, 0.5, 90), (0.2, 61, None, None)]
    assert text.read_segments(spark, at("three.chords")).orderBy("start").first()["label"] == "C:maj"
    assert text.read_key(spark, at("four.key")).first()["key"] == "F# minor"
    assert [tuple(r) for r in text.read_tempo(spark, at("five.tempo")).orderBy("pos").collect()] == [("five", 0, 60.0, 0.3), ("five", 1, 120.0, pytest.approx(0.7))]
    tempi = spark.createDataFrame([("a", 0, 120.0, 0.6), ("a", 1, 60.0, 0.2), ("b", 0, 90.0, 1.0)], "track_id string, pos int, tempo double, strength double")
    text.write_tempo(tempi, at("tempo"))
    assert sorted(r["value"] for r in spark.read.text(at("tempo")).collect()) == ["120.00\t60.00\t0.75", "90.00\tnan\t1.00"]
    assert text.tempo_lines(tempi, True).where("track_id = 'a'").first()["t1"] == 60.0
    text.write_segments(text.read_segments(spark, at("three.chords")), at("seg"), "start end label")
    assert [r["value"] for r in spark.read.text(at("seg")).collect()] == ["# start end label", "0.000\t1.500\tC:maj", "1.500\t2.000\tN"]


def test_midi_bytes():
    for n in (0, 127, 128, 16383, 2097152):
        assert midi.read_number(midi.write_number(n), 0)[0] == n
    body = bytes([0, 0x90, 60, 100, 10, 60, 0, 5, 0xF0, 2, 1, 0xF7, 0, 0xFF, 0x01, 2]) + b"hi" + bytes([0, 0xE0, 0, 64, 0, 0xC1, 7, 0, 0xFF, 0x2F, 0])
    content = b"MThd" + bytes([0, 0, 0, 6, 0, 1, 0, 1, 0, 96]) + b"MTrk" + len(body).to_bytes(4, "big") + body
    rows = list(midi.parse(content))
    assert [r[4] for r in rows] == ["note_on", "note_on", "sysex", "text", "pitch_wheel", "program_change", "end_of_track"]
    assert [r[2] for r in rows] == [0, 10, 15, 15, 15, 15, 15] and rows[3][7] == "hi" and rows[0][3] == 96
    with pytest.raises(ValueError):
        list(midi.parse(b"no file"))


def test_midi_tables(spark, tmp_path):
    head = bytes([0, 0xFF, 0x51, 3]) + (250000).to_bytes(3, "big") + bytes([0, 0xFF, 0x58, 4, 3, 3, 24, 8])
    body = head + bytes([0, 0x90, 60, 100]) + midi.write_number(480) + bytes([0xB0, 64, 127]) + midi.write_number(480) + bytes([0x80, 60, 0]) + midi.write_number(480) + bytes([0xB0, 64, 0, 0, 0xFF, 0x2F, 0])
    (tmp_path / "x.mid").write_bytes(b"MThd" + bytes([0, 0, 0, 6, 0, 0, 0, 1]) + (480).to_bytes(2, "big") + b"MTrk" + len(body).to_bytes(4, "big") + body)
    timed = midi.with_seconds(midi.read_events(spark, str(tmp_path)))
    played = midi.notes(timed)
    assert [tuple(r) for r in played.collect()] == [("x", 0.0, 60, 0.5, 100, 0)]
    held = midi.pedals(timed)
    assert [tuple(r) for r in held.collect()] == [("x", 0, 0.25, 0.75)]
    assert midi.sustained(played, held).first()["duration"] == 0.75
    assert [tuple(r) for r in midi.tempi(timed).collect()] == [("x", 0.0, 250000)] and tuple(midi.time_signatures(timed).first())[2:] == (3, 8)
    assert midi.with_seconds(midi.read_events(spark, str(tmp_path))).agg({"beat": "max"}).first()[0] == pytest.approx(6.0)


def test_files(tmp_path, spark):
    (tmp_path / "a").mkdir()
    for n in ("x.beats", "y.txt", "a/z.beats"):
        (tmp_path / n).write_text("1")
    assert [p.rsplit("/", 1)[1] for p in files.search(str(tmp_path), ".beats", 1)] == ["z.beats", "x.beats"]
    assert len(files.search(str(tmp_path), ".beats")) == 1
    assert files.matching("q/x.wav", ["b/x.beats", "b/ax.beats"], ".wav", ".beats") == ["b/x.beats"]
    assert len(files.matching("q/x.wav", ["b/x.beats", "b/ax.beats"], ".wav", ".beats", False)) == 2
    assert files.listed(spark, str(tmp_path), "*.beats", True).count() == 2
    with pytest.raises(OSError):
        files.search("/no/such/place")


def test_pipelines(spark, tmp_path):
    plus = lambda df: df.withColumn("x", df.x + 1)
    steps = pipelines.Sequential(plus, None)
    steps.append(plus)
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "track_id long, idx long, x double")
    assert [r["x"] for r in steps(df).orderBy("idx").collect()] == [3.0, 4.0] and len(steps) == 3
    assert len(pipelines.Parallel(plus, None)(df)) == 2
    df.write.parquet(str(tmp_path / "in.parquet"))
    job = pipelines.Job(lambda s, p: s.read.parquet(p), steps, lambda d, p: d.write.parquet(p))
    assert pipelines.run_batch(job, spark, [str(tmp_path / "in.parquet")], str(tmp_path), ".out") == [f"{tmp_path}/in.out"]
    assert spark.read.parquet(str(tmp_path / "in.out")).count() == 2
    assert [r["buffer"] for r in pipelines.rolling("x", 3)(df).orderBy("idx").collect()] == [[0, 0, 1], [0, 1, 2]]
    pipelines.save_settings("add", {"n": 2.0}, str(tmp_path / "s.json"))
    assert pipelines.load_settings(str(tmp_path / "s.json"), {"add": lambda d, n: d.withColumn("x", d.x + n)})(df).orderBy("idx").first()["x"] == 3.0


def test_streams(spark, tmp_path):
    rows = [(1, float(t), 10.0 * (t % 3 == 0), f"2024-01-01 0{t // 4}:00:00") for t in range(12)]
    df = spark.createDataFrame(rows, "track_id long, t double, x double, ts string").selectExpr("track_id", "t", "x", "cast(ts as timestamp) ts", "'a' as label")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    unit = pipelines.Switched(lambda d: d.where("x > 5"), lambda d: online_peaks(d, 5.0, 4.0))
    pipelines.run_online(unit, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["t"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 6.0]
    assert unit(df).count() == 4
    assert sorted((r["start"].hour, r["n"]) for r in windowed_levels(df).collect()) == [(0, 4), (1, 4), (2, 4)]


def test_streams_with_state_go_on_where_they_stopped(spark, tmp_path):
    """Two micro-batches give what one gives."""
    rng = np.random.default_rng(1)
    rows = [(k, i, float(x)) for k in (1, 2) for i, x in enumerate(rng.random(60))]
    df = spark.createDataFrame(rows, "track_id long, idx long, x double")
    for half in (df.where("idx < 30"), df.where("idx >= 30")):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, step in (("onsets", lambda d: online_onsets(d, 0.2, 10.0, 3, 2, 0.3)), ("beats", lambda d: online_beats(d, 10.0, 60.0, 200.0))):
        pipelines.run_online(step, stream, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))
        assert got == sorted(map(tuple, step(df).collect())) and got


def test_more_writers(spark, tmp_path):
    notes = spark.createDataFrame([("a", 0.5, 60.0, 0.25, 90.0), ("a", 0.25, 61.0, 0.5, 80.0)], "track_id string, onset double, pitch double, duration double, velocity double")
    text.write_notes(notes, str(tmp_path / "n"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "n")).collect()] == ["0.250\t61\t0.500\t80", "0.500\t60\t0.250\t90"]
    text.write_key(spark.createDataFrame([("a", "F# minor")], "track_id string, key string"), str(tmp_path / "k"), "key")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "k")).collect()] == ["# key", "F# minor"]
    acts = spark.createDataFrame([("a", 0, 0.5, 100), ("b", 0, 0.25, 100)], "track_id string, idx long, x double, fps int")
    text.write_activations(acts, str(tmp_path / "x"))
    assert sorted(r["x"] for r in text.read_activations(spark, str(tmp_path / "x")).collect()) == [0.25, 0.5]
