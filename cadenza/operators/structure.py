"""Structure: banded self-similarity, novelty, repetitions, section labels and form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators.scan import by_block, in_blocks
from cadenza.operators.series import islands, thinned
from cadenza.operators.similarity import matrix, sums


def ssm_band(frames: DataFrame, band: int) -> DataFrame:
    """track, i, j, sim for frames less than ``band`` apart (i <= j); never the whole matrix.

    ``frames``: track, idx, v (unit vectors).  An equi-join on blocks of ``band`` frames
    and their next block keeps the work linear in the length of a track.
    """
    left = frames.select("track", F.col("idx").alias("i"), F.col("v").alias("a"), F.floor(F.col("idx") / band).alias("block"))
    right = frames.select("track", F.col("idx").alias("j"), F.col("v").alias("b"), F.floor(F.col("idx") / band).alias("own"))
    right = right.withColumn("block", F.explode(F.array("own", F.col("own") - 1)))
    pairs = left.join(right, ["track", "block"]).filter((F.col("j") >= F.col("i")) & (F.col("j") - F.col("i") < band))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("track", "i", "j", F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)).alias("sim"))


def novelty(frames: DataFrame, k: int) -> DataFrame:
    """Difference of the mean similarity in the k frames before and the k from each frame on, over the highest."""
    pairs = ssm_band(frames, k)
    weight = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)  # the matrix is symmetric
    # a block [s, s + k) holds the pair (i, j) where j - k < s <= i
    starts = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("j").cast("long") - k + 1), F.col("i").cast("long")))
    blocks = pairs.select("track", starts.alias("s"), (F.col("sim") * weight).alias("x")).groupBy("track", "s").agg((F.sum("x") / (k * k)).alias("mean"))
    lengths = frames.groupBy("track").agg((F.max("idx") + 1).alias("n"))
    before = blocks.select("track", (F.col("s") + k).alias("at"), F.col("mean").alias("before"))
    after = blocks.select("track", F.col("s").alias("at"), F.col("mean").alias("after"))
    rows = before.join(after, ["track", "at"]).join(lengths, "track").filter((F.col("at") >= k) & (F.col("at") < F.col("n") - k))
    rows = rows.select("track", "at", F.abs(F.col("before") - F.col("after")).alias("x"))
    top = F.max("x").over(Window.partitionBy("track"))
    return rows.select("track", "at", F.coalesce(F.try_divide("x", top), F.lit(0.0)).alias("novelty"))


def block_contrast(frames: DataFrame, k: int, size: int = 256) -> DataFrame:
    """track, frame, change and board: how the k frames before a frame and the k from it on differ.

    ``frames``: track, frame (dense, from 0), v (unit vectors).  Both come from sums over squares of the band of
    similarities (in 0..1) around a time block, read off a summed-area table: ``change`` is the difference of
    the mean similarities of both sides, ``board`` the checkerboard sum (both sides less what they have in common),
    over its cells.  0 where a side is not whole.
    """

    def run(rows: pd.DataFrame, first: int, last: int) -> pd.DataFrame:
        frame = rows["frame"].to_numpy()
        v = np.stack(rows["v"].to_numpy())
        sims = np.nan_to_num(np.clip(v @ v.T, 0, 1), nan=1.0)  # as in ``ssm_band``: NaN is above 1
        area = np.pad(sims.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        own = np.flatnonzero((frame >= first) & (frame < last))
        whole = (own >= k) & (own < rows["n"].iloc[0] - k - frame[0])

        def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return area[a + k, b + k] - area[a, b + k] - area[a + k, b] + area[a, b]

        change, board = np.zeros(len(own)), np.zeros(len(own))
        at = own[whole]
        before, after, cross = square(at - k, at - k), square(at, at), square(at - k, at)
        change[whole] = np.abs(before - after) / (k * k)
        board[whole] = (before + after - 2 * cross) / (4 * k * k)
        return pd.DataFrame({"track": rows["track"].to_numpy()[own], "frame": frame[own], "change": change, "board": board})

    n = frames.groupBy("track").agg(F.count("*").alias("n"))
    kind = frames.schema["track"].dataType.simpleString()
    return by_block(frames.select("track", F.col("frame").cast("long").alias("frame"), "v").join(n, "track"), size, k, k, run, f"track {kind}, frame long, change double, board double")


def gaussian(curve: DataFrame, name: str, sigma: float = 2.0) -> DataFrame:
    """track, frame and the column smoothed by a Gaussian of four deviations to either side; ends are turned over."""
    half = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    weights = (weights / weights.sum()).tolist()
    sizes = curve.groupBy("track").agg(F.count("*").alias("_n"))
    rows = curve.select("track", "frame").join(sizes, "track").select("track", "frame", "_n", F.posexplode(F.array(*map(F.lit, weights))).alias("_o", "_w"))
    turned = F.pmod(F.col("frame") + F.col("_o") - half, 2 * F.col("_n"))
    rows = rows.withColumn("_q", F.when(turned < F.col("_n"), turned).otherwise(2 * F.col("_n") - 1 - turned))
    values = curve.select("track", F.col("frame").alias("_q"), name)
    return rows.join(values, ["track", "_q"]).groupBy("track", "frame").agg(F.sum(F.col("_w") * F.col(name)).alias(name))


def over_highest(curve: DataFrame, name: str) -> DataFrame:
    top = curve.groupBy("track").agg(F.max(F.abs(name)).alias("_top"))
    return curve.join(top, "track").withColumn(name, F.when(F.col("_top") > 0, F.col(name) / F.col("_top")).otherwise(F.col(name))).drop("_top")


def multi_scale_novelty(frames: DataFrame, short: int = 8, long: int = 16, share: float = 0.7) -> DataFrame:
    """track, frame and novelty (0 to 1): smoothed change at two scales, the longer by ``share``."""
    both = [over_highest(gaussian(block_contrast(frames, k), "change"), "change").select("track", "frame", F.col("change").alias(f"x{i}")) for i, k in enumerate((short, long))]
    rows = both[0].join(both[1], ["track", "frame"]).select("track", "frame", (F.col("x0") + share * F.col("x1")).alias("novelty"))
    return over_highest(rows, "novelty")


def board_novelty(frames: DataFrame, k: int) -> DataFrame:
    """track, frame and novelty (0 to 1): log of the checkerboard sum, where positive."""
    rows = block_contrast(frames, k).select("track", "frame", F.log1p(F.greatest(F.col("board"), F.lit(0.0))).alias("novelty"))
    return over_highest(rows, "novelty")


def boundary_peaks(curve: DataFrame, distance: int = 4, share: float = 0.7) -> DataFrame:
    """Strict local maxima above the track's ``share`` quantile value, thinned: of two close ones the higher stays."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        x, at = rows["novelty"].to_numpy(), rows["at"].to_numpy()
        height = np.sort(x)[int(share * len(x))] if len(x) else 0.0
        peaks = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]) & (x[1:-1] >= height)) + 1
        kept = peaks[thinned(at[peaks], x[peaks], distance)]
        return pd.DataFrame({"track": rows["track"].iloc[0], "at": at[kept], "novelty": x[kept]}) if len(kept) else rows.head(0)[["track", "at", "novelty"]]

    return curve.groupBy("track").applyInPandas(pick, curve.select("track", "at", "novelty").schema)


def snapped(times: DataFrame, grid: float, least: float) -> DataFrame:
    """Times on a grid (half to even), distinct, with at least ``least`` between those kept, first come."""
    on_grid = times.select("track", (F.rint(F.col("t") / grid) * grid).alias("t")).distinct()
    rows = on_grid.groupBy("track").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # boundaries of one track

    def step(acc: Column, t: Column) -> Column:
        far = (F.size(acc) == 0) | (t - F.try_element_at(acc, F.lit(-1)) >= least)
        return F.when(far, F.concat(acc, F.array(t))).otherwise(acc)

    return rows.select("track", F.explode(F.aggregate("ts", F.array().cast("array<double>"), step)).alias("t"))


def diagonals(x: np.ndarray, y: np.ndarray, length: int, step: int) -> np.ndarray:
    """Mean similarity of the frames from each place of ``x`` on and those from each place of ``y`` on, every ``step``-th of ``length``."""
    sims = np.nan_to_num(np.clip(sums(x, y), 0, 1), nan=1.0)  # as in ``ssm_band``: NaN is above 1
    own, other = len(x) - length + 1, len(y) - length + 1
    points = range(0, length, step)
    total = np.zeros((own, other))
    for k in points:
        total += sims[k : k + own, k : k + other]
    return total / len(points)


def repetition_pairs(frames: DataFrame, length: int, stride: int, points: int, least: float, size: int = 512) -> DataFrame:
    """Pairs of places whose diagonal of sampled similarities has a mean above ``least``.

    ``frames``: track, idx (dense, from 0), v.  Time blocks of ``size`` frames, each with the first ones of the next, meet
    the blocks of their track: no row is made for a pair that is not similar, and the frames are shuffled without copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                track, n, one, two = (batch.column(c)[at].as_py() for c in ("track", "n", "p", "q"))
                x, y = (matrix(batch.column(c)[at].values)[0] for c in ("x", "y"))
                if min(len(x), len(y)) < length:
                    continue
                found = diagonals(x, y, length, max(1, length // points))
                i, j = one * size + np.arange(len(found))[:, None], two * size + np.arange(found.shape[1])
                places = (i < min((one + 1) * size, n - length)) & (i % stride == 0) & (j >= i + length) & (j <= np.minimum(n - length - 1, i + n // 2))
                a, b = np.nonzero(places & (j < (two + 1) * size) & ((j - i - length) % stride == 0) & (found > least))
                first, second = pa.array(i[a, 0], pa.int32()), pa.array(j[b], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([track] * len(a), batch.column("track").type), first, second, pa.array(found[a, b])], names=["track", "i", "j", "similarity"])

    lengths = frames.groupBy("track").agg((F.max("idx") + 1).cast("int").alias("n")).filter(F.col("n") > length)
    n = lengths.agg(F.sum(F.ceil(F.col("n") / size))).first()[0] or 1
    rows = in_blocks(frames.select("track", F.col("idx").alias("frame"), "v"), size, 0, length - 1).filter("block >= 0")
    dealt = rows.groupBy("track", "block").agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("rows")).join(lengths, "track")  # ``size`` and some
    dealt = dealt.select("track", "n", "block", F.col("rows.v").alias("vs")).repartition(max(min(n, 16), -(-n // 32)))
    one = dealt.select("track", "n", F.col("block").alias("p"), F.col("vs").alias("x"))
    two = dealt.select(F.col("track").alias("other"), F.col("block").alias("q"), F.col("vs").alias("y"))
    near = (F.col("track") == F.col("other")) & (F.col("q") >= F.col("p")) & (F.col("q") * size <= (F.col("p") + 1) * size + F.floor(F.col("n") / 2))
    kind = frames.schema["track"].dataType.simpleString()
    return one.hint("shuffle_replicate_nl").join(two, near).drop("other").mapInArrow(run, f"track {kind}, i int, j int, similarity double")


def without_overlap(pairs: DataFrame, length: int) -> DataFrame:
    """The most similar repetitions of a track of which no interval overlaps one kept before.

    Spark sorts the pairs of a track, on disk where they are many; one pass over them holds the places that are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, taken = None, np.zeros(0, bool)  # the pairs of a track follow each other
        for batch in batches:
            tracks = batch.column("track").to_pylist()
            i, j = (batch.column(c).to_numpy() for c in ("i", "j"))
            taken = np.pad(taken, (0, max(0, int(max(i.max(initial=0), j.max(initial=0))) + length - len(taken))))
            kept, start = [], 0
            while start < len(tracks):
                if tracks[start] != track:
                    track, taken = tracks[start], np.zeros_like(taken)
                end = next((k for k in range(start, len(tracks)) if tracks[k] != track), len(tracks))
                for k in start + np.flatnonzero(~(taken[i[start:end]] | taken[j[start:end]])):
                    if not (taken[i[k]] or taken[j[k]]):
                        kept.append(k)
                        for at in (i[k], j[k]):
                            taken[max(0, at - length + 1) : at + length] = True
                start = end
            yield batch.take(pa.array(kept, pa.int64()))

    rows = pairs.select("track", "i", "j", "similarity", F.round("similarity", 9).alias("s")).repartition("track")  # one key to a sort, not one to a comparison
    return rows.sortWithinPartitions("track", F.desc("s"), "i", "j").drop("s").mapInArrow(run, pairs.select("track", "i", "j", "similarity").schema)


def in_order(sections: DataFrame) -> DataFrame:
    w = Window.partitionBy("track").orderBy("t", "event_id")
    return sections.withColumn("seq", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("track")))


def energy_class(sections: DataFrame) -> DataFrame:
    """Section type by the track's energy percentiles and the trend around the section."""
    w = Window.partitionBy("track").orderBy("seq")
    rows = in_order(sections)
    before = F.col("energy") - F.lag("energy").over(w)
    after = F.coalesce(F.lead("energy").over(w), F.col("energy")) - F.col("energy")
    trend = (
        F.when((F.col("n") < 3) | (F.col("seq") == 0), "stable")
        .when((before > 0.1) & (after > 0.1), "building").when((before < -0.1) & (after < -0.1), "declining")
        .when(before > 0.1, "building").when(after < -0.1, "declining").otherwise("stable")
    )
    cuts = sections.groupBy("track").agg(F.expr("percentile(energy, array(0.5, 0.75, 0.9))").alias("p"))
    rows = rows.withColumn("trend", trend).join(cuts, "track")
    e, p50, p75, p90 = F.col("energy"), *[F.get("p", F.lit(i)) for i in range(3)]
    kind = (
        F.when(e >= p90, "chorus")
        .when(e >= p75, F.when(F.col("trend") == "building", "pre_chorus").otherwise("chorus"))
        .when(e >= p50, F.when(F.col("trend") == "building", "pre_chorus").when(F.col("trend") == "declining", "bridge").otherwise("verse"))
        .when(F.col("seq") == 0, "intro").when(F.col("seq") == F.col("n") - 1, "outro").otherwise("verse")
    )
    return rows.select("track", "seq", "trend", kind.alias("label"))


def runs_of(sections: DataFrame, kind: str) -> DataFrame:
    """Sections in order with the length of their run of equal types and their place in it."""
    w = Window.partitionBy("track").orderBy("seq")
    rows = islands(in_order(sections), F.col("type") != F.lag("type").over(w), "track", "seq")
    by = Window.partitionBy("track", "island")
    run = F.when(F.col("type") == kind, F.count("*").over(by)).otherwise(0)
    return rows.withColumn("run", run).withColumn("place", F.row_number().over(by.orderBy("seq")))


def suppress_prechorus(sections: DataFrame) -> DataFrame:
    """Runs of pre-choruses: of three or more the first is a verse and the last a chorus, of two the second a locked verse."""
    rows = runs_of(sections, "pre_chorus")
    long, pair = F.col("run") >= 3, F.col("run") == 2
    label = F.when(long & (F.col("place") == 1), "verse").when(long & (F.col("place") == F.col("run")), "chorus").when(pair & (F.col("place") == 2), "verse").otherwise(F.col("type"))
    return rows.select("track", "seq", "type", label.alias("label"), (pair & (F.col("place") == 2)).alias("locked"))


def chorus_chains(sections: DataFrame, most: int = 2) -> DataFrame:
    """Every third chorus of a chain becomes instrumental."""
    rows = runs_of(sections, "chorus")
    breaks = (F.col("run") > most) & (F.col("place") % (most + 1) == 0)
    return rows.select("track", "seq", "type", F.when(breaks, "instrumental").otherwise(F.col("type")).alias("label"), F.col("run").cast("long").alias("run"))


def form(sections: DataFrame) -> DataFrame:
    """The letters of a track's sections in order, repetition, distinct types and their variety."""
    letter = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in K.SECTION_LETTERS.items() for x in kv]), F.col("type")), F.lit("X"))
    rows = in_order(sections).withColumn("letter", letter)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "letter"))), lambda x: x["letter"]), "")  # sections of one track
    found = rows.groupBy("track").agg(text.alias("form"), F.count_distinct("type").alias("n_types"), F.count("*").alias("n"))
    return found.select("track", "form", "n_types", "n", (1 - F.col("n_types") / F.col("n")).alias("repetition"))


def context_fold(sections: DataFrame) -> DataFrame:
    """Refine base labels in order, where a rule looks at the label just given to the section before.

    ``sections``: track, seq, base, energy, complexity, harmonic.  The fold runs over the
    sections of one track (some dozens) inside one expression.
    """
    row = F.struct("seq", "base", "energy", "complexity", "harmonic")
    rows = sections.groupBy("track").agg(F.array_sort(F.collect_list(row)).alias("c"))
    zero = F.struct(F.lit("").alias("label"), F.lit(0.0).alias("energy"), F.lit(0.0).alias("complexity"), F.array().cast("array<struct<seq:bigint,label:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        e, c, h, base = x["energy"], x["complexity"], x["harmonic"], x["base"]
        first = x["seq"] == 0
        rising = (e > acc["energy"] * 1.5) | ((e > acc["energy"] * 1.1) & (c > acc["complexity"] * 1.05))
        again = (base == "pre_chorus") | ((base == "verse") & (e > 0.5) & (c > 0.6))
        label = (
            F.when(first & (e < 0.4), "intro")
            .when(~first & rising & base.isin("verse", "bridge"), "pre_chorus")
            .when(~first & (acc["label"] == "pre_chorus") & again, F.when(e > 0.6, "chorus").otherwise("verse"))
            .when((base == "bridge") & ((c < 0.6) | (h < 0.3)), "verse")
            .otherwise(base)
        )
        one = F.array(F.struct(x["seq"].cast("long").alias("seq"), label.alias("label")))
        return F.struct(label.alias("label"), e.alias("energy"), c.alias("complexity"), F.concat(acc["out"], one).alias("out"))

    return rows.select("track", F.inline(F.aggregate("c", zero, step, lambda acc: acc["out"])))


def pairing(sections: DataFrame) -> DataFrame:
    """A pre-chorus needs a next section 1.3 times as strong; a chorus between much weaker ones of low complexity is a verse."""
    w = Window.partitionBy("track").orderBy("seq")
    e, before, after = F.col("energy"), F.coalesce(F.lag("energy").over(w), F.lit(0.0)), F.lead("energy").over(w)
    pre = F.when(after.isNull() | (after > e * 1.3), "pre_chorus").otherwise("verse")
    alone = (e > 0.6) & (before < e * 0.7) & (F.coalesce(after, F.lit(0.0)) < e * 0.7) & (F.col("complexity") < 0.6)
    label = F.when(F.col("base") == "pre_chorus", pre).when((F.col("base") == "chorus") & alone, "verse").otherwise(F.col("base"))
    return sections.select("track", "seq", "base", label.alias("label"))


def drop_choruses(sections: DataFrame, modulations: DataFrame) -> DataFrame:
    """Choruses that are quiet, or quieter than the track by a deviation at a change of key.

    ``sections``: track, seq, t, type, level (dB); ``modulations``: track, t, shift in semitones.
    A modulation falls in at most one section: a backward match, not a range join.
    """
    from cadenza.operators.series import backward

    held = backward(modulations, sections.select("track", "t")).filter("right_t is not null")
    first = held.groupBy("track", F.col("right_t").alias("t")).agg(F.min(F.struct(F.col("t").alias("at"), "shift")).alias("m"))
    stats = sections.groupBy("track").agg(F.avg("level").alias("mean"), F.stddev_pop("level").alias("sd"), F.count("*").alias("n"))
    rows = sections.join(first, ["track", "t"], "left").join(stats, "track")
    raw = F.pmod(F.col("m.shift"), F.lit(12))
    shift = F.coalesce(F.when(raw > 6, raw - 12).otherwise(raw), F.lit(0))
    z = F.when((F.col("n") < 2) | (F.col("sd") == 0), 0.0).otherwise((F.col("level") - F.col("mean")) / F.col("sd"))
    moved = shift != 0
    drop = (F.col("type") == "chorus") & ((F.col("level") <= -50) | (moved & ((F.col("level") <= -20) | (z < -1))))
    return rows.select("track", "seq", "type", F.when(drop, "drop_chorus").otherwise(F.col("type")).alias("label"), shift.cast("long").alias("shift"), z.alias("z"))
