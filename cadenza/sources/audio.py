"""WAV files as frame tables.

Files come through Spark's binary reader, so any store that Spark reads will do.  One
map turns each file into rows: a row per file (duration, or why it cannot be read) or a
row per frame (levels, spectral shape, pitch classes, cepstrum, onset strength, pitch).
A file is the unit of work; a task holds one file's samples at a time.

Only PCM WAV is decoded (8, 16, 24 or 32 bits, mixed down to mono); other files give an
error row.  Constant-Q chroma, probabilistic pitch tracking and harmonic-percussive
separation are replaced by STFT chroma, autocorrelation pitch and nothing.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, HOP, RATE = 2048, 512, 22_050
FRAMES = (
    "path string, frame int, t double, rms double, zcr double, centroid double, rolloff double, bandwidth double, flatness double, "
    "low double, mid double, high double, onset double, f0 double, chroma array<double>, mfcc array<double>"
)


def decode(content: bytes, rate: int = RATE) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 at ``rate`` (linear resampling) and the file's own rate."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, own, n = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.getnframes()
        raw = f.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1) if channels > 1 else x
    if own != rate and len(x):
        at = np.arange(0, len(x) * rate // own) * (own / rate)
        x = np.interp(at, np.arange(len(x)), x)
    return x, own


def mel_filters(rate: int, size: int, n: int = 40) -> np.ndarray:
    def mel(f):
        return 2595 * np.log10(1 + f / 700)

    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), n + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(size, 1 / rate)
    up = (freq - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - freq) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def analyse(x: np.ndarray, rate: int = RATE, size: int = SIZE, hop: int = HOP) -> dict[str, np.ndarray]:
    """Frame features of a signal: centred Hann windows, magnitude spectra and what follows from them."""
    padded = np.pad(x, size // 2)
    n = 1 + (len(padded) - size) // hop
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:n]
    mag = np.abs(np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=1))
    freq = np.fft.rfftfreq(size, 1 / rate)
    total = np.maximum(mag.sum(axis=1), 1e-10)
    centroid = mag @ freq / total
    power = mag**2
    cumulative = np.cumsum(mag, axis=1)
    chroma = np.zeros((n, 12))
    heard = (freq > 27.5) & (freq < 5000)
    pc = np.rint(69 + 12 * np.log2(freq[heard] / 440)).astype(int) % 12
    for k in range(12):
        chroma[:, k] = power[:, heard][:, pc == k].sum(axis=1)
    chroma /= np.maximum(np.linalg.norm(chroma, axis=1, keepdims=True), 1e-10)
    mel = np.log10(np.maximum(power @ mel_filters(rate, size).T, 1e-10)) * 10
    m = mel.shape[1]
    dct = np.cos(np.pi / m * (np.arange(m) + 0.5)[None, :] * np.arange(13)[:, None]) * np.sqrt(2 / m)
    dct[0] /= np.sqrt(2)
    flux = np.maximum(0, np.diff(mel, axis=0, prepend=mel[:1])).mean(axis=1)
    signs = np.signbit(frames)
    return {
        "t": np.arange(n) * hop / rate,
        "rms": np.sqrt((frames**2).mean(axis=1)),
        "zcr": (signs[:, 1:] != signs[:, :-1]).mean(axis=1),
        "centroid": centroid,
        "rolloff": freq[(cumulative < 0.85 * cumulative[:, -1:]).sum(axis=1).clip(max=len(freq) - 1)],
        "bandwidth": np.sqrt((mag * (freq[None, :] - centroid[:, None]) ** 2).sum(axis=1) / total),
        "flatness": np.exp(np.log(np.maximum(power, 1e-10)).mean(axis=1)) / np.maximum(power, 1e-10).mean(axis=1),
        "low": power[:, (freq >= 20) & (freq <= 250)].sum(axis=1),
        "mid": power[:, (freq >= 250) & (freq <= 4000)].sum(axis=1),
        "high": power[:, freq >= 4000].sum(axis=1),
        "onset": flux,
        "f0": pitch(frames, rate),
        "chroma": chroma,
        "mfcc": mel @ dct.T,
    }


def pitch(frames: np.ndarray, rate: int, low: float = 65.0, high: float = 1000.0, least: float = 0.5) -> np.ndarray:
    """Fundamental by the highest normalised autocorrelation; NaN where it is below ``least``."""
    size = frames.shape[1]
    spectrum = np.fft.rfft(frames, 2 * size, axis=1)
    auto = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :size]
    lags = np.arange(int(rate / high), int(rate / low) + 1)
    score = auto[:, lags] / np.maximum(auto[:, :1], 1e-12) * (size / (size - lags))
    best = score.argmax(axis=1)
    # of lags nearly as good as the best, the shortest: an octave above rather than below
    first = (score >= 0.95 * score.max(axis=1, keepdims=True)).argmax(axis=1)
    pick = np.where(score[np.arange(len(score)), first] >= least, first, best)
    for _ in range(12):  # climb to the local maximum
        nxt = np.minimum(pick + 1, len(lags) - 1)
        pick = np.where(score[np.arange(len(score)), nxt] > score[np.arange(len(score)), pick], nxt, pick)
    return np.where(score[np.arange(len(score)), pick] >= least, rate / lags[pick], np.nan)


def tracks(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """path, sr, n, duration and error of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    x, own = decode(content, rate)
                    out.append((name, own, len(x), len(x) / rate, None))
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    out.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "sr", "n", "duration", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sr int, n long, duration double, error string")


def frames(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """A row per frame of every readable file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    x, _ = decode(content, rate)
                except (wave.Error, EOFError, KeyError, ValueError):
                    continue  # its error stands in tracks()
                if not len(x):
                    continue
                found = analyse(x, rate)
                out = pd.DataFrame({k: list(v) if v.ndim > 1 else v for k, v in found.items()})
                out.insert(0, "frame", np.arange(len(out), dtype=np.int32))
                out.insert(0, "path", name)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FRAMES)


def chroma_rows(found: DataFrame) -> DataFrame:
    """Frames as (track, frame, pc, v), for the key and chord operators."""
    return found.select(F.col("path").alias("track"), "frame", F.posexplode("chroma").alias("pc", "v"))


def onset_events(found: DataFrame, factor: float = 1.5) -> DataFrame:
    """(track, event_id, t, value): strict peaks of onset strength above ``factor`` times the file's mean."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("frame")
    mean = found.groupBy("path").agg(F.avg("onset").alias("mean"))
    rows = found.withColumn("b", F.lag("onset").over(w)).withColumn("a", F.lead("onset").over(w)).join(mean, "path")
    peaks = rows.filter((F.col("onset") > F.coalesce("b", F.lit(0.0))) & (F.col("onset") >= F.coalesce("a", F.lit(0.0))) & (F.col("onset") > factor * F.col("mean")))
    return peaks.select(F.col("path").alias("track"), F.col("frame").cast("long").alias("event_id"), "t", F.col("onset").alias("value"))
