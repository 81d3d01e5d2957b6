"""MIDI files as one table of events, and what follows from it: tempo maps, seconds, notes, pedals; and back to files.

An event is (track_id, track, seq, tick, type, channel, data, text). Times in seconds come from a running sum over the tempo map, so
they need no driver code. All event types share the table and are told apart by ``type``; typed views read their fields from data.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.sources.audio import binary

TEMPO, PER_BEAT = 500_000, 480
#: Names of channel messages by the upper half of their status byte, and of meta messages by number.
CHANNEL = {8: "note_off", 9: "note_on", 10: "aftertouch", 11: "control_change", 12: "program_change", 13: "channel_aftertouch", 14: "pitch_wheel"}
META = {
    0x00: "sequence_number", 0x01: "text", 0x02: "copyright", 0x03: "track_name", 0x04: "instrument_name", 0x05: "lyrics", 0x06: "marker", 0x07: "cue_point", 0x08: "program_name",
    0x20: "channel_prefix", 0x21: "port", 0x2E: "track_loop", 0x2F: "end_of_track", 0x51: "set_tempo", 0x54: "smpte_offset", 0x58: "time_signature", 0x59: "key_signature", 0x7F: "sequencer_specific",
}
SYSEX, TEXTS = "sysex", {v for k, v in META.items() if 1 <= k <= 8}
EVENTS = "track_id string, track int, seq int, tick long, per_beat int, type string, channel int, data array<int>, text string"


def read_number(data: bytes, at: int) -> tuple[int, int]:
    """A number of 7-bit groups, the highest first, and where it ends."""
    value = 0
    while True:
        b = data[at]
        at += 1
        value = value << 7 | b & 127
        if b < 128:
            return value, at


def write_number(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def parse(content: bytes):
    """(track, seq, tick, ticks a beat, type, channel, data, text) of each event, with ticks from the track's begin."""
    if content[:4] != b"MThd":
        raise ValueError("no MIDI file")
    size, _, tracks, per_beat = struct.unpack_from(">IHHH", content, 4)
    if per_beat & 0x8000:
        raise ValueError("times in frames aren't read")
    at, track = 8 + size, 0
    while at + 8 <= len(content) and track < tracks:
        name, size = content[at : at + 4], struct.unpack_from(">I", content, at + 4)[0]
        at, end = at + 8, at + 8 + size
        if name == b"MTrk":
            tick = seq = status = 0
            while at < end:
                delta, at = read_number(content, at)
                tick += delta
                if content[at] >= 128:
                    status = content[at]
                    at += 1
                if status in (0xF0, 0xF7):
                    n, at = read_number(content, at)
                    kind, channel, data = SYSEX, None, content[at : at + n]
                elif status == 0xFF:
                    code = content[at]
                    n, at = read_number(content, at + 1)
                    kind, channel, data = META.get(code, f"unknown_meta_{code}"), None, content[at : at + n]
                elif status >= 128:
                    n = 1 if status >> 4 in (12, 13) else 2
                    kind, channel, data = CHANNEL[status >> 4], status & 15, content[at : at + n]
                else:
                    raise ValueError("data without a status")
                at += n
                words = data.decode("latin-1") if kind in TEXTS else None
                yield track, seq, tick, per_beat, kind, channel, list(data), words
                seq += 1
            track += 1
        at = end


def read_events(spark: SparkSession, path: str, pattern: str = "*.mid*") -> DataFrame:
    return parsed(binary(spark, path, pattern))


def parsed(files_: DataFrame) -> DataFrame:
    """EVENTS of files (track_id, content); files that can't be read give no rows."""

    def work(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in EVENTS.split(", ")]
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, *r) for r in parse(content)]
                except (ValueError, IndexError, KeyError, struct.error):
                    continue
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files_.select("track_id", "content").mapInArrow(work, EVENTS)


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("type").isin(list(types)))


def byte(k: int) -> Column:
    return F.get("data", k)


def with_fields(events: DataFrame) -> DataFrame:
    """Named fields beside the raw data: pitch and velocity, control and value, program, bend, tempo, numerator, denominator, key; null where a type has none."""
    t = lambda *x: F.col("type").isin(list(x))
    notes = t("note_on", "note_off", "aftertouch")
    return events.withColumns({
        "pitch": F.when(notes, byte(0)), "velocity": F.when(notes, byte(1)),
        "control": F.when(t("control_change"), byte(0)), "value": F.when(t("control_change"), byte(1)).when(t("channel_aftertouch"), byte(0)),
        "program": F.when(t("program_change"), byte(0)), "bend": F.when(t("pitch_wheel"), byte(0) + byte(1) * 128 - 8192),
        "tempo": F.when(t("set_tempo"), byte(0) * 65536 + byte(1) * 256 + byte(2)),
        "numerator": F.when(t("time_signature"), byte(0)), "denominator": F.when(t("time_signature"), F.pow(F.lit(2.0), byte(1)).cast("int")),
        "sharps": F.when(t("key_signature"), F.when(byte(0) > 127, byte(0) - 256).otherwise(byte(0))), "minor": F.when(t("key_signature"), byte(1) == 1),
    })


def merged(events: DataFrame) -> DataFrame:
    """A file's tracks in one order of ticks, n from 0; equal ticks by track and place."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy("tick", "track", "seq")) - 1)


def with_seconds(events: DataFrame) -> DataFrame:
    """merged() with t in seconds and beat in beats of the signature: running sums over the tempi and signatures so far."""
    e = with_fields(merged(events))
    o = Window.partitionBy("track_id").orderBy("n")
    so_far = o.rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("tick") - F.coalesce(F.lag("tick").over(o), F.lit(0))
    tempo = F.coalesce(F.last("tempo", ignorenulls=True).over(so_far), F.lit(TEMPO))
    low = F.coalesce(F.last("denominator", ignorenulls=True).over(so_far), F.lit(4))
    e = e.withColumn("_s", step * tempo / 1e6 / F.col("per_beat")).withColumn("_b", step * low / 4.0 / F.col("per_beat"))
    up_to = o.rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("t", F.sum("_s").over(up_to)).withColumn("beat", F.sum("_b").over(up_to)).drop("_s", "_b")


def changes(timed: DataFrame, kind: str, columns: tuple[str, ...], first: tuple) -> DataFrame:
    found = of_type(timed, kind).select("track_id", "t", *columns)
    begin = timed.groupBy("track_id").agg(F.min(F.when(F.col("type") == kind, F.col("t"))).alias("_t")).where("_t is null or _t > 0")
    begin = begin.select("track_id", F.lit(0.0).alias("t"), *[F.lit(v).cast(dict(found.dtypes)[c]).alias(c) for c, v in zip(columns, first, strict=True)])
    return begin.unionByName(found)


def tempi(timed: DataFrame) -> DataFrame:
    """(track_id, t, tempo), with the default from 0 where a file doesn't begin with one."""
    return changes(timed, "set_tempo", ("tempo",), (TEMPO,))


def time_signatures(timed: DataFrame) -> DataFrame:
    return changes(timed, "time_signature", ("numerator", "denominator"), (4, 4))


def notes(timed: DataFrame) -> DataFrame:
    """(track_id, onset, pitch, duration, velocity, channel): each end takes the last open start of its key; ends without one, and starts struck anew, go."""
    on = (F.col("type") == "note_on") & (F.col("velocity") > 0)
    n = of_type(timed, "note_on", "note_off").withColumn("_on", on)
    o = Window.partitionBy("track_id", "channel", "pitch").orderBy("n")
    before = lambda c: F.lag(c).over(o)
    n = n.withColumns({"_was": before("_on"), "_t": before("t"), "_v": before("velocity")})
    ended = n.where(~F.col("_on") & F.col("_was"))
    return ended.select("track_id", F.col("_t").alias("onset"), "pitch", (F.col("t") - F.col("_t")).alias("duration"), F.col("_v").alias("velocity"), "channel")


def pedals(timed: DataFrame, control: int = 64) -> DataFrame:
    """(track_id, channel, down, up): from a value of 64 or more to the next lower one, or the file's last event."""
    last = timed.groupBy("track_id").agg(F.max("t").alias("_end"))
    c = timed.where((F.col("type") == "control_change") & (F.col("control") == control)).withColumn("_d", F.col("value") >= 64)
    o = Window.partitionBy("track_id", "channel").orderBy("n")
    c = c.withColumn("_new", F.coalesce(F.col("_d") != F.lag("_d").over(o), F.col("_d"))).where("_new")
    c = c.withColumn("up", F.lead("t").over(o)).where("_d").join(last, "track_id")
    return c.select("track_id", "channel", F.col("t").alias("down"), F.coalesce("up", "_end").alias("up"))


def sustained(played: DataFrame, held: DataFrame) -> DataFrame:
    """notes() that end while a pedal is down last until it is up, but not beyond the next note of their pitch."""
    end = F.col("onset") + F.col("duration")
    p = held.groupBy(F.col("track_id").alias("_k"), F.col("channel").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("down", "up"))).alias("_p"))
    j = played.join(p, (F.col("track_id") == F.col("_k")) & (F.col("channel") == F.col("_c")), "left")
    ups = F.transform(F.filter("_p", lambda x: (end >= x["down"]) & (end <= x["up"])), lambda x: x["up"])
    j = j.withColumn("_to", F.coalesce(F.array_max(ups), end))
    nxt = F.lead("onset").over(Window.partitionBy("track_id", "pitch").orderBy("onset"))
    return j.withColumn("duration", F.coalesce(F.least(F.col("_to"), nxt), F.col("_to")) - F.col("onset")).select(*played.columns)


def file_of(played: list[tuple], tempo: float = TEMPO, signature: tuple[int, int] = (4, 4), per_beat: int = PER_BEAT) -> bytes:
    """A file of one track of notes (onset, pitch, duration, velocity, channel). tempo: microseconds a quarter, or beats a minute up to 1000."""
    tempo = round(60e6 / tempo * signature[1] / 4) if tempo <= 1000 else int(tempo * signature[1] / 4)
    tick = lambda s: round(s / (tempo * 1e-6 / per_beat))
    messages = []
    for k, (onset, p, duration, velocity, channel) in enumerate(played):
        messages.append((tick(onset), k, 1, bytes([0x90 | int(channel), int(p), int(velocity)])))
        messages.append((tick(onset + duration), k, 2, bytes([0x80 | int(channel), int(p), 64])))
    # Ends come before starts of the same tick, unless they end what starts there.
    messages.sort(key=lambda m: (m[0], m[1], m[2]))
    body = [b"\x00\xff\x51\x03" + tempo.to_bytes(3, "big"), b"\x00\xff\x58\x04" + bytes([signature[0], signature[1].bit_length() - 1, 24, 8])]
    at = 0
    for t, _, _, m in messages:
        body.append(write_number(t - at) + m)
        at = t
    body.append(b"\x00\xff\x2f\x00")
    raw = b"".join(body)
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, per_beat) + b"MTrk" + struct.pack(">I", len(raw)) + raw


def files(played: DataFrame, tempo: float = TEMPO, signature: tuple[int, int] = (4, 4), per_beat: int = PER_BEAT) -> DataFrame:
    """(track_id, content) of notes, missing durations, velocities and channels filled with 0.6, 100 and 0."""

    def work(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["onset", "pitch"])
        get = lambda c, v: pdf[c].fillna(v) if c in pdf else [v] * len(pdf)
        rows = list(zip(pdf["onset"], pdf["pitch"], get("duration", 0.6), get("velocity", 100), get("channel", 0), strict=True))
        return pd.DataFrame({"track_id": [str(key[0])], "content": [file_of(rows, tempo, signature, per_beat)]})

    return played.groupBy("track_id").applyInPandas(work, "track_id string, content binary")
