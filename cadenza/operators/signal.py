"""Signals as series: autocorrelation and what it shows, tempo and beats of an onset curve, parts of a spectrogram.

A series is track, frame (dense, from 0), x.  A spectrogram is track, frame, bin, power with every
bin of every frame.  Work is cut by track and time block, with the frames around a block
copied to it where an operator looks at them, so that a long track is many tasks; tracks need not
be of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import tempo
from cadenza.operators.scan import BLOCK, DIGITS, Summary, by_block, carried, in_blocks, times
from cadenza.session import materialise

# ---- autocorrelation


def autocorrelation(series: DataFrame, most: int | None = None, size: int = BLOCK) -> DataFrame:
    """track, lag and r, the sum of ``x[i] * x[i + lag]``, for lags from 0 to ``most`` (by default all).

    A block of frames meets the blocks up to ``most`` after it; each pair gives its share of at
    most ``2 * size`` lags, and shares are summed with partial sums.
    """
    kind = series.schema["track"].dataType.simpleString()
    blocks = in_blocks(series, size).groupBy("track", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.col("x").cast("double").alias("x")))), lambda s: s["x"]).alias("x"))
    ends = series.groupBy("track").agg(F.count("*").alias("n"))
    rows = blocks.join(ends, "track")
    last = F.floor((F.col("n") - 1) / size).cast("long")
    reach = last if most is None else F.least(last, F.col("block") + -(-most // size))
    early = rows.select("track", F.col("block").alias("a"), F.col("x").alias("xa"), F.explode(F.sequence("block", reach)).alias("b"))
    late = blocks.select("track", F.col("block").alias("b"), F.col("x").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for track, a, b, xa, xb in zip(*(batch[c] for c in ("track", "a", "b", "xa", "xb")), strict=True):
                one, other = np.asarray(xa.values), np.asarray(xb.values)
                r = np.correlate(other, one, "full")
                lag = np.arange(len(r)) - (len(one) - 1) + (b.as_py() - a.as_py()) * size
                kept = (lag >= 0) & (lag <= (most if most is not None else lag.max(initial=0)))
                yield pa.record_batch({"track": pa.array([track.as_py()] * int(kept.sum()), track.type), "lag": pa.array(lag[kept]), "r": pa.array(r[kept])})

    shares = early.join(late, ["track", "b"]).mapInArrow(run, f"track {kind}, lag long, r double")
    return shares.groupBy("track", "lag").agg(F.sum("r").alias("r"))


def peaks(curve: DataFrame, at: str, y: str, share: float, distance: int, size: int = BLOCK) -> DataFrame:
    """Strict local maxima of at least ``share`` of the track's highest value, thinned: within less than ``distance`` the higher stays.

    Of equal ones the later stays.  Peaks that far from their neighbours do not matter to each other, so thinning
    works on runs of close peaks.
    """
    rows = in_blocks(curve.withColumn("frame", F.col(at)), size, 1, 1)
    w = Window.partitionBy("track", "block").orderBy("frame")
    rows = rows.withColumn("_b", F.lag(y).over(w)).withColumn("_a", F.lead(y).over(w)).filter(F.floor(F.col("frame") / size) == F.col("block"))
    top = curve.groupBy("track").agg(F.max(y).alias("_top"))
    high = rows.filter((F.col(y) > F.col("_b")) & (F.col(y) > F.col("_a"))).join(top, "track").filter(F.col(y) >= F.col("_top") * share)
    by = Window.partitionBy("track").orderBy(at)
    runs = high.withColumn("_far", (F.col(at) - F.coalesce(F.lag(at).over(by), F.lit(-distance)) >= distance).cast("int"))
    runs = runs.withColumn("_run", F.sum("_far").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    close = runs.groupBy("track", "_run").agg(F.array_sort(F.collect_list(F.struct((-F.col(y)).alias("low"), (-F.col(at)).alias("back")))).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.forall(acc, lambda k: F.abs(k["back"] - x["back"]) >= distance), F.concat(acc, F.array(x))).otherwise(acc)

    kind = "array<struct<low:double,back:bigint>>"
    kept = close.select("track", F.inline(F.aggregate("c", F.array().cast(kind), step)))
    return kept.select("track", (-F.col("back")).alias(at), (-F.col("low")).alias(y))


def polyrhythm(series: DataFrame, least: int = 100) -> DataFrame:
    """track, n_peaks and polyrhythm: more than three peaks of the autocorrelation, over one of whose successive lags are in no whole ratio.

    False for tracks of fewer than ``least`` frames.
    """
    found = peaks(autocorrelation(series), "lag", "r", 0.3, 10)
    ratio = F.col("lag") / F.lag("lag").over(Window.partitionBy("track").orderBy("lag"))
    rows = found.withColumn("odd", F.abs(ratio - F.rint(ratio)) > 0.1).groupBy("track").agg(F.count("*").alias("n_peaks"), F.count_if("odd").alias("n_odd"))
    tracks = series.groupBy("track").agg(F.count("*").alias("n")).join(rows, "track", "left")
    n, odd = F.coalesce("n_peaks", F.lit(0).cast("long")), F.coalesce("n_odd", F.lit(0))
    return tracks.select("track", n.alias("n_peaks"), ((F.col("n") >= least) & (n > 3) & (odd > 1)).alias("polyrhythm"))


def centred(series: DataFrame) -> DataFrame:
    """Rows less the mean of their track, with that mean and the deviation and number of its rows."""
    stats = series.groupBy("track").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n"))
    return series.join(stats, "track").withColumn("x", F.col("x") - F.col("mean"))


def vibrato(pitch: DataFrame, seconds: float = 2.0, least: int = 20) -> DataFrame:
    """track, rate (Hz, at most 10, to one decimal) and extent of the vibrato of voiced pitches (x, numbered over voiced frames).

    The rate takes the rows of a track as ``seconds`` long, as the reference does; none for fewer than
    ``least`` rows or without a peak.
    """
    rows = centred(pitch)
    first = peaks(autocorrelation(rows.select("track", "frame", "x")), "lag", "r", 0.3, 5).groupBy("track").agg(F.min("lag").alias("lag"))
    stats = rows.groupBy("track").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("sd").alias("sd")).join(first, "track", "left")
    heard = F.col("lag").isNotNull() & (F.col("n") >= least)
    rate = F.round(F.least(F.lit(10.0), F.col("n") / seconds / (F.col("lag") + 1e-8)), 1)
    return stats.select("track", F.when(heard, rate).otherwise(0.0).alias("rate"), F.when(heard, F.col("sd") / (F.col("mean") + 1e-8)).otherwise(0.0).alias("extent"))


def reverb(envelope: DataFrame, least: int = 10, unknown: float = 0.2) -> DataFrame:
    """track and reverb (0 to 0.95): autocorrelation at long lags against short ones, and the variance of the envelope's steps."""
    sizes = envelope.groupBy("track").agg(F.count("*").alias("n"))
    r = autocorrelation(envelope).join(sizes, "track")
    quarter, half, eighth = (F.floor(F.col("n") / k) for k in (4, 2, 8))
    means = r.groupBy("track").agg(F.avg(F.when((F.col("lag") >= quarter) & (F.col("lag") < half), F.col("r"))).alias("long"), F.avg(F.when(F.col("lag") < eighth, F.col("r"))).alias("short"))
    w = Window.partitionBy("track", "block").orderBy("frame")
    near = in_blocks(envelope, BLOCK, 0, 1).withColumn("d", F.col("x") - F.lag("x").over(w)).filter(F.floor(F.col("frame") / BLOCK) == F.col("block"))
    steps = near.groupBy("track").agg(F.var_pop("d").alias("v"))
    rows = sizes.join(means, "track", "left").join(steps, "track", "left")
    base = F.least(F.lit(0.7), F.greatest(F.lit(0.0), F.try_divide("long", "short") * 1.5))
    total = F.least(F.lit(0.95), base + F.least(F.lit(0.3), F.coalesce("v", F.lit(0.0)) * 10))
    known = (F.col("n") >= least) & (F.coalesce("short", F.lit(0.0)) != 0)
    return rows.select("track", F.when(known, total).otherwise(unknown).alias("reverb"))


# ---- tempo


def ramped(series: DataFrame, pad: int) -> DataFrame:
    """A series continued at both ends by a straight line down to 0 over ``pad`` frames; ``own`` marks its own rows."""
    ends = series.groupBy("track").agg(F.count("*").alias("n"), F.min_by("x", "frame").alias("x0"), F.max_by("x", "frame").alias("x1"))
    steps = ends.select("track", "n", "x0", "x1", F.explode(F.sequence(F.lit(1), F.lit(pad))).alias("k"))
    fall = 1 - F.col("k") / pad
    head = steps.select("track", (-F.col("k")).cast("long").alias("frame"), (F.col("x0") * fall).alias("x"), F.lit(False).alias("own"))
    tail = steps.select("track", (F.col("n") - 1 + F.col("k")).alias("frame"), (F.col("x1") * fall).alias("x"), F.lit(False).alias("own"))
    return series.select("track", F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"), F.lit(True).alias("own")).unionByName(head).unionByName(tail)


def frame_tempi(onsets: DataFrame, rate: float, window: int = 384, start_bpm: float = 150.0, most_bpm: float = 300.0, size: int = BLOCK) -> DataFrame:
    """track, frame and bpm: the strongest period of the onset curve around each frame.

    The autocorrelation of a Hann window centred at the frame, over its highest value, meets a
    log-normal prior around ``start_bpm``; of equal ones the shortest lag.
    """
    weights = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    bpm = 60 * rate / np.arange(1, window)
    prior = np.where(bpm < most_bpm, -0.5 * np.log2(bpm / start_bpm) ** 2, -np.inf)

    def run(rows: pd.DataFrame, first: int, last: int) -> pd.DataFrame:
        own = rows["own"].to_numpy() & (rows["frame"].to_numpy() >= first) & (rows["frame"].to_numpy() < last)
        at = np.flatnonzero(own)
        if not len(at):
            return rows.iloc[:0][["track", "frame"]].assign(bpm=0.0)
        x = rows["x"].to_numpy()
        out = []
        for some in np.array_split(at, -(-len(at) // 512)):
            cut = np.lib.stride_tricks.sliding_window_view(x[some[0] - window // 2 : some[-1] + window - window // 2], window) * weights
            r = np.fft.irfft(np.abs(np.fft.rfft(cut, 2 * window)) ** 2)[:, :window]
            r = np.where(r[:, :1] > 0, r / np.maximum(r[:, :1], 1e-300), 0.0)
            r = np.where(np.abs(r) < 1e-12, 0.0, r)  # what the transform leaves of exact zeros
            out.append(bpm[(np.log1p(1e6 * np.maximum(r[:, 1:], 0)) + prior).argmax(axis=1)])
        return pd.DataFrame({"track": rows["track"].iloc[at], "frame": rows["frame"].iloc[at], "bpm": np.concatenate(out)})

    kind = onsets.schema["track"].dataType.simpleString()
    return by_block(ramped(onsets, window // 2), size, window // 2, window - window // 2, run, f"track {kind}, frame long, bpm double")


def detected_tempo(onsets: DataFrame, rate: float, window: int = 384, low: float = 40.0, high: float = 300.0) -> DataFrame:
    """track, bpm and confidence: frame-wise tempi vote, votes cluster by harmonic ratios, and the choice is made among the clusters."""
    votes = frame_tempi(onsets, rate, window, most_bpm=high).filter(F.col("bpm").between(low, high)).select("track", "bpm")
    return tempo.smart_choice(tempo.harmonic_clusters(tempo.histogram_topk(votes, low, high)))


# ---- beats


def local_scores(onsets: DataFrame, tempi: DataFrame, rate: float, least_bpm: float = 30.0, size: int = BLOCK) -> DataFrame:
    """track, frame, period and score: the onset curve over its deviation, smoothed by a Gaussian as wide as a 32nd of a beat."""
    stats = onsets.groupBy("track").agg(F.stddev_samp("x").alias("sd")).filter("sd > 0").join(tempi.select("track", "bpm"), "track")
    period = F.greatest(F.lit(2), F.rint(60.0 * rate / F.greatest(F.col("bpm"), F.lit(least_bpm)))).cast("long")
    rows = onsets.join(stats, "track").select("track", F.col("frame").cast("long").alias("frame"), (F.col("x") / F.col("sd")).alias("x"), period.alias("period"))

    def run(rows: pd.DataFrame, first: int, last: int) -> pd.DataFrame:
        p = int(rows["period"].iloc[0])
        kernel = np.exp(-0.5 * (np.arange(-p, p + 1) * 32.0 / p) ** 2)
        smooth = np.convolve(rows["x"].to_numpy(), kernel, "full")[p:-p]
        own = (rows["frame"].to_numpy() >= first) & (rows["frame"].to_numpy() < last)
        return pd.DataFrame({"track": rows["track"][own], "frame": rows["frame"][own], "period": p, "score": smooth[own]})

    kind = onsets.schema["track"].dataType.simpleString()
    halo = int(np.ceil(60 * rate / least_bpm)) + 1
    return by_block(rows, size, halo, halo, run, f"track {kind}, frame long, period long, score double")


def _advance(scores: np.ndarray, period: int, tightness: float, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best sums up to each frame, after those of the two periods before (a column per entry), and how far back each looks."""
    offsets = np.arange(-2 * period, -round(period / 2) + 1)
    cost = -tightness * np.log(-offsets / period) ** 2
    back = 2 * period
    sums = np.concatenate([state, np.empty((len(scores), state.shape[1]))])
    links = np.empty((len(scores), state.shape[1]), np.int64)
    for i, score in enumerate(scores):
        ways = cost[:, None] + sums[i : i + len(offsets)]
        best = np.round(ways, DIGITS).argmax(axis=0)
        links[i] = offsets[best]
        sums[back + i] = score + ways[best, np.arange(len(best))]
    return sums, links


def beat_links(scores: DataFrame, tightness: float = 100.0, size: int = BLOCK) -> DataFrame:
    """track, frame, score, total and link: the best sum of scores of beats up to a frame, and the beat before it (-1: none).

    Of equal ways back the longest is taken.  A beat costs ``tightness`` times the squared log of its distance from a period.  A block is a max-plus
    matrix over the sums of the two periods before it.
    """
    first = scores.groupBy("track").agg((F.max("score") * 0.01).alias("_least"))
    strong = scores.join(first, "track").filter("score >= _least").groupBy("track").agg(F.min("frame").alias("begins"))
    rows = scores.join(strong, "track")

    def summarise(rows: pd.DataFrame) -> Summary:
        p = int(rows["period"].iloc[0])
        if len(rows) < size:  # the last block: nothing enters another one from it
            return [p]
        entries = np.where(np.eye(2 * p, dtype=bool), 0.0, -np.inf)
        sums, _ = _advance(rows["score"].to_numpy(), p, tightness, entries)
        return [p, *sums[-2 * p :].T.ravel()]

    def step(state: np.ndarray, s: np.ndarray) -> np.ndarray:
        return times(state, s[1:].reshape(2 * int(s[0]), -1))

    def replay(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        p = int(rows["period"].iloc[0])
        sums, links = _advance(rows["score"].to_numpy(), p, tightness, state[:, None])
        frame = rows["frame"].to_numpy()
        link = np.where(frame < rows["begins"].to_numpy(), -1, np.maximum(frame + links[:, 0], -1))
        return pd.DataFrame({"track": rows["track"], "frame": frame, "score": rows["score"], "total": sums[2 * p :, 0], "link": link})

    kind = scores.schema["track"].dataType.simpleString()
    return carried(rows, summarise, lambda s: np.zeros(2 * int(s[0])), step, replay, f"track {kind}, frame long, score double, total double, link long", size)


def beats(onsets: DataFrame, tempi: DataFrame, rate: float, tightness: float = 100.0, size: int = BLOCK) -> DataFrame:
    """track, frame, t (seconds) and beat (from 0): beats near ``tempi`` (track, bpm) with the strongest onsets.

    Weak beats at either end are left out: those before the first and after the last whose smoothed score is over
    half the root mean square.  A track without any change has no beats.
    """
    linked = materialise(beat_links(materialise(local_scores(onsets, tempi, rate, size=size), "beat-scores"), tightness, size), "beat-links")
    w = Window.partitionBy("track", "block").orderBy("frame")
    near = in_blocks(linked, size, 1, 1).withColumn("_b", F.lag("total").over(w)).withColumn("_a", F.lead("total").over(w))
    tops = near.filter((F.floor(F.col("frame") / size) == F.col("block")) & (F.round("total", DIGITS) > F.round("_b", DIGITS)) & (F.round("total", DIGITS) >= F.round(F.coalesce("_a", F.col("total")), DIGITS)))
    middle = tops.groupBy("track").agg(F.median("total").alias("_m"))
    last = tops.join(middle, "track").filter(F.col("total") * 2 > F.col("_m")).groupBy("track").agg(F.max("frame").alias("last"))
    rows = linked.join(last, "track")

    def table(rows: pd.DataFrame) -> Summary:  # of each frame the first one before this block on the way back
        frame, link = rows["frame"].to_numpy()[::-1], rows["link"].to_numpy()[::-1]
        out = link.copy()
        for k in range(len(frame)):
            if link[k] >= frame[0]:
                out[k] = out[link[k] - frame[0]]
        return [rows["last"].iloc[0], frame[0], *out]

    def step(state: np.ndarray, s: np.ndarray) -> list[float]:
        at = int(state[0] - s[1])
        return [s[2 + at]] if 0 <= at < len(s) - 2 else list(state)

    def walk(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        low, link, at, kept = int(rows["frame"].iloc[-1]), dict(zip(rows["frame"], rows["link"], strict=True)), int(state[0]), set()
        while at >= low and at in link:
            kept.add(at)
            at = int(link[at])
        return rows.loc[rows["frame"].isin(kept), ["track", "frame", "score"]]

    kind = onsets.schema["track"].dataType.simpleString()
    found = carried(rows, table, lambda s: [s[0]], step, walk, f"track {kind}, frame long, score double", size, backward=True)
    by = Window.partitionBy("track").orderBy("frame")  # beats only
    smooth = F.col("score") + (F.coalesce(F.lag("score").over(by), F.lit(0.0)) + F.coalesce(F.lead("score").over(by), F.lit(0.0))) / 2
    graded = found.withColumn("_s", smooth)
    level = graded.groupBy("track").agg((F.sqrt(F.avg(F.col("_s") * F.col("_s"))) / 2).alias("_least"))
    strong = graded.join(level, "track")
    bounds = strong.filter("_s > _least").groupBy("track").agg(F.min("frame").alias("_from"), F.max("frame").alias("_to"))
    kept = strong.join(bounds, "track").filter(F.col("frame").between(F.col("_from"), F.col("_to")))
    return kept.select("track", "frame", (F.col("frame") / rate).alias("t"), (F.row_number().over(by) - 1).cast("long").alias("beat"))


# ---- parts of a spectrogram


def _mirrored(cells: DataFrame, along: str, n: str, half: int) -> DataFrame:
    """Cells at every place from ``-half`` to ``n + half - 1`` of a line that is turned over at both ends, as column ``_q``."""
    turns = F.ceil(F.lit(half) / (2 * F.col(n))).cast("long")
    places = F.flatten(F.transform(F.sequence(-turns - 1, turns + 1), lambda j: F.array(F.col(along) + 2 * j * F.col(n), 2 * j * F.col(n) - 1 - F.col(along))))
    return cells.withColumn("_q", F.explode(F.filter(places, lambda q: (q >= -half) & (q < F.col(n) + half))))


def _running_median(cells: DataFrame, along: str, across: str, half: int, name: str, size: int) -> DataFrame:
    """The median of the ``2 * half + 1`` cells around each along one axis."""
    sizes = cells.groupBy("track").agg((F.max(along) + 1).alias("_n"))
    rows = _mirrored(cells.join(sizes, "track"), along, "_n", half)
    low, high = F.floor((F.col("_q") - half) / size).cast("long"), F.floor((F.col("_q") + half) / size).cast("long")
    rows = rows.withColumn("_block", F.explode(F.sequence(low, high)))
    w = Window.partitionBy("track", across, "_block").orderBy("_q").rowsBetween(-half, half)
    middle = F.get(F.array_sort(F.collect_list("power").over(w)), F.lit(half))
    own = (F.col("_q") == F.col(along)) & (F.floor(F.col("_q") / size) == F.col("_block"))
    return rows.withColumn(name, middle).filter(own).drop("_q", "_block", "_n")


def parted(cells: DataFrame, kernel: int = 31, margin: float = 3.0, size: int = BLOCK) -> DataFrame:
    """cells with harmonic and percussive power: what lasts in time and what spreads over frequency, by soft masks.

    Running medians along time and along frequency, lines turned over at their ends, are compared as
    squares; a part must exceed the other ``margin`` times.
    """
    rows = _running_median(cells.select("track", F.col("frame").cast("long").alias("frame"), F.col("bin").cast("long").alias("bin"), "power"), "frame", "bin", kernel // 2, "_h", size)
    rows = _running_median(rows, "bin", "frame", kernel // 2, "_p", size)

    def mask(a: Column, b: Column) -> Column:
        top = F.greatest(a, b)
        x, y = (a / top) * (a / top), (b / top) * (b / top)
        return F.when(top > 0, x / (x + y)).otherwise(F.lit(0.5 if margin == 1 else 0.0))

    h, p = F.col("_h"), F.col("_p")
    return rows.select("track", "frame", "bin", "power", (F.col("power") * mask(h, p * margin)).alias("harmonic"), (F.col("power") * mask(p, h * margin)).alias("percussive"))


def octave_bands(bins: int, nyquist: float, low: float = 200.0, octaves: int = 6, quantile: float = 0.02) -> list[tuple[int, int, int, int]]:
    """band, its first and last bin, and how many of its strongest and weakest bins are averaged."""
    freq = np.linspace(0, nyquist, bins)
    edges = np.concatenate([[0.0], low * 2.0 ** np.arange(octaves + 1)])
    out = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = np.flatnonzero((freq >= a) & (freq <= b))
        if not len(inside):
            continue
        first = inside[0] - (k > 0)  # a band takes the bin before it
        last = bins - 1 if k == octaves else inside[-1] - 1
        n = (bins - 1 if k == octaves else inside[-1]) - first + 1
        if last >= first:
            out.append((k, int(first), int(last), max(1, int(np.rint(quantile * n)))))
    return out


def spectral_contrast(cells: DataFrame, bins: int, nyquist: float, quantile: float = 0.02) -> DataFrame:
    """track, frame, band and contrast (dB): mean of a band's strongest bins against that of its weakest."""
    spark = cells.sparkSession
    table = [(band, b, n) for band, first, last, n in octave_bands(bins, nyquist, quantile=quantile) for b in range(first, last + 1)]  # a row or two per bin
    rows = cells.join(F.broadcast(spark.createDataFrame(table, "band long, bin long, n long")), "bin")
    found = rows.groupBy("track", "frame", "band").agg(F.array_sort(F.collect_list("power")).alias("p"), F.first("n").alias("n"))  # the bins of one band

    def level(values: Column) -> Column:
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
        return 10 * F.log10(F.greatest(mean, F.lit(1e-10)))

    n = F.least(F.col("n"), F.size("p")).cast("int")
    return found.select("track", "frame", "band", (level(F.slice("p", -n, n)) - level(F.slice("p", F.lit(1), n))).alias("contrast"))


#: Angle per semitone (in half turns) and radius of the fifths, minor thirds and major thirds circles.
CIRCLES = [(7 / 6, 1.0), (3 / 2, 1.0), (2 / 3, 0.5)]


def tonnetz(chroma: DataFrame) -> DataFrame:
    """track, frame, axis (0 to 5) and v: the pitch classes of a frame, of sum 1, on the circles of fifths and thirds.

    ``chroma``: track, frame, pc, v.  Even axes are sines, odd ones cosines.
    """
    rows = chroma.groupBy("track", "frame").agg(F.collect_list(F.struct("pc", "v")).alias("c"))  # twelve entries
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + F.abs(x["v"]))

    def axis(turn: float, radius: float, wave) -> Column:
        found = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["v"] * radius * wave(x["pc"] * (turn * np.pi)))
        return F.coalesce(F.try_divide(found, total), F.lit(0.0))

    axes = F.array(*[axis(turn, radius, wave) for turn, radius in CIRCLES for wave in (F.sin, F.cos)])
    return rows.select("track", "frame", F.posexplode(axes).alias("axis", "v"))
