"""Synthesised WAV files, end to end, and the streaming forms against the batch ones."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import chords, keys
from cadenza.sources import audio
from cadenza.streaming import live

RATE = 22_050


def tone(notes, seconds):
    t = np.arange(int(seconds * RATE)) / RATE
    return sum(0.3 * np.sin(2 * np.pi * 440 * 2 ** ((n - 69) / 12) * t) for n in notes)


def wav(x):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("wav")
    progression = np.concatenate([tone(n, 2.5) for n in ((60, 64, 67), (57, 60, 64), (53, 57, 60), (55, 59, 62))])
    (d / "progression.wav").write_bytes(wav(progression))
    (d / "a3.wav").write_bytes(wav(tone((57,), 2)))
    bursts = np.zeros(5 * RATE)
    for k in range(10):
        bursts[k * RATE // 2 + 2000 : k * RATE // 2 + 3100] = tone((84,), 1100 / RATE)[:1100]
    (d / "bursts.wav").write_bytes(wav(bursts))
    (d / "broken.wav").write_bytes(b"no wave")
    return str(d)


def test_tracks_have_durations_or_errors(spark, folder):
    found = {r["path"].rsplit("/", 1)[1]: r for r in audio.tracks(spark, folder).collect()}
    assert found["progression.wav"]["duration"] == pytest.approx(10, abs=0.01) and found["broken.wav"]["error"]


def test_chords_of_a_progression(spark, folder):
    frames = audio.frames(spark, folder + "/progression.wav")
    rows = audio.chroma_rows(frames).withColumn("part", F.floor(F.col("frame") * 512 / RATE / 2.5).cast("int")).filter("part < 4")
    means = rows.groupBy("part", "pc").agg(F.avg("v").alias("v"))
    found = [r["chord"] for r in chords.template_match(means, "part").orderBy("part").collect()]
    assert found == ["C", "Am", "F", "G"]
    best = keys.key_best(keys.key_correlation(keys.chroma_mean(audio.chroma_rows(frames)))).first()
    assert (best["key"], best["mode"]) in {("C", "Major"), ("A", "Minor"), ("F", "Major")}


def test_pitch_and_onsets(spark, folder):
    middle = audio.frames(spark, folder + "/a3.wav").filter("frame between 5 and 60").agg(F.expr("percentile(f0, 0.5)")).first()[0]
    assert middle == pytest.approx(220, rel=0.01)
    times = [r["t"] for r in audio.onset_events(audio.frames(spark, folder + "/bursts.wav")).orderBy("t").collect()]
    assert len(times) >= 9 and np.median(np.diff(times)) == pytest.approx(0.5, abs=0.05)


@pytest.mark.parametrize("form", [live.energy_windows, live.sessions])
def test_streaming_equals_batch(spark, tmp_path, form):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.agg(F.max("ts")).first()[0]
    closing = rows.limit(1).withColumn("ts", F.lit(last) + F.expr("interval 60 days"))  # moves the watermark past all windows
    rows.repartition(3).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"live_{form.__name__}"
    query = form(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
    query.processAllAvailable()
    closing.write.parquet(str(tmp_path / "in/b"))
    query.processAllAvailable()
    query.stop()
    found = sorted(map(str, spark.table(name).select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in spark.table(name).dtypes]).collect()))
    batch = form(rows)
    wanted = sorted(map(str, batch.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in batch.dtypes]).collect()))
    assert found == wanted
