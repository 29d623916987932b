"""The provided tables as the series that the operators read.

Each function takes the session and the folder of the tables.  Single-file inputs
are spread by their track before heavy work, and every series has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import table

SECONDS_PER_UNIT = 8 * 86_400_000_000  # microseconds: one second of a track is eight days


def chroma_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame, pc, v: positive part of the first 12 dimensions, of unit length per frame; NaN, as in SQL, where all 12 are 0."""
    e = F.slice("embedding", 1, 12).cast("array<double>")
    positive = F.transform(e, lambda x: F.greatest(x, F.lit(0.0)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("track"), F.col("vec_id").alias("frame"), positive.alias("p"))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("track", "frame", F.posexplode(F.transform("p", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(float("nan"))))).alias("pc", "v"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (user), event_id, kind, value and t in seconds of the track."""
    rows = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(float(SECONDS_PER_UNIT))
    return rows.select(F.col("user_id").alias("track"), "event_id", F.col("event_type").alias("kind"), "value", t.alias("t"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("kind = 'view'").select("track", "event_id", "t", "value")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("kind <> 'view'").select("track", "event_id", "t", "value")


def tempo_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (event type) and bpm: values from 40 to 300."""
    return events(spark, sf_dir).filter("value between 40 and 300").select(F.col("kind").alias("track"), F.col("value").alias("bpm"))


def energy(spark: SparkSession, sf_dir: str, by: str = "kind") -> DataFrame:
    """track (event type, or user), t, event_id and rms."""
    return events(spark, sf_dir).select(F.col(by).alias("track"), "t", "event_id", F.col("value").alias("rms"))


def melody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (user), t, event_id, midi, f0 and voiced."""
    midi = F.lit(36.0) + F.col("value") % F.lit(48.0)
    rows = events(spark, sf_dir).select("track", "t", "event_id", midi.alias("midi"), (F.col("kind") != "error").alias("voiced"))
    return rows.withColumn("f0", F.lit(440.0) * F.pow(F.lit(2.0), (F.col("midi") - 69) / 12))


def onset_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (last digit of the user), frame (an hour, 40 to a second of the track) and x: whole values of the hour's events, 0 without any."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("long").alias("track"), hour.alias("h"), F.floor("value").alias("v"))
    sums = rows.groupBy("track", "h").agg(F.sum("v").cast("double").alias("x"))
    spans = sums.groupBy("track").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    every = spans.select("track", "low", F.explode(F.sequence("low", "high")).alias("h"))
    return every.join(sums, ["track", "h"], "left").select("track", (F.col("h") - F.col("low")).cast("long").alias("frame"), F.coalesce("x", F.lit(0.0)).alias("x"))


def spectrogram(spark: SparkSession, sf_dir: str, bins: int = 64) -> DataFrame:
    """track (supplier), frame (30 days), bin and power of every bin of every frame, from prices and quantities of ``lineitem``."""
    frame = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 30)
    place = F.floor((F.col("l_extendedprice") % F.lit(11025.0)) / F.lit(11025.0 / bins))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).cast("long").alias("track"), frame.alias("frame"), place.alias("bin"), F.col("l_quantity").cast("double").alias("q"))
    sums = rows.groupBy("track", "frame", "bin").agg(F.sum("q").alias("power"))
    spans = sums.groupBy("track").agg(F.max("frame").alias("high"))
    every = spans.select("track", F.explode(F.sequence(F.lit(0).cast("long"), "high")).alias("frame")).select("track", "frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(sums, ["track", "frame", "bin"], "left").withColumn("power", F.coalesce("power", F.lit(0.0)))


def sounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (supplier), t (days), frame and the numbers of a frame, from the lines of orders."""
    q, price = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).cast("long").alias("track"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("t"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + q).cast("long").alias("frame"), (q / 64).alias("rms"), (F.col("l_tax").cast("double") * 2 + 0.00137).alias("zcr"), (price % 6000).alias("centroid"),
        (price % 9000).alias("rolloff"), (price % 1500).alias("bandwidth"), F.when(F.col("l_discount") > 0.02, 110 * F.pow(F.lit(2.0), q * 0.7 / 12)).alias("f0"), (q * q / 16384).alias("harmonic"), (q > 45).alias("onset"),
        (F.col("l_partkey") % 12).cast("long").alias("pc"),
    )


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, seq, start, end (90 days each), type and energy (mean level) of the sounding frames."""
    rows = sounding(spark, sf_dir).groupBy("track", F.floor(F.col("t") / 90).cast("long").alias("seq")).agg((F.floor(F.avg("rms") * 1024) / 1024).alias("energy"))
    kind = F.element_at(F.array(*map(F.lit, ("verse", "chorus", "bridge"))), (F.col("seq") % 3 + 1).cast("int"))
    return rows.select("track", "seq", (F.col("seq") * 90.0).alias("start"), (F.col("seq") * 90.0 + 90).alias("end"), kind.alias("type"), "energy")


def case_map(column: str, pairs: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in pairs.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


CHORDS = {"signup": "C", "view": "Am", "click": "F", "purchase": "G", "error": "N"}
SECTIONS = {"signup": "intro", "view": "verse", "click": "pre_chorus", "purchase": "chorus", "error": "instrumental"}


def chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (user), t, event_id, chord and confidence."""
    return events(spark, sf_dir).select("track", "t", "event_id", case_map("kind", CHORDS).alias("chord"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (user), t, event_id, type and energy (value by the track's highest)."""
    rows = events(spark, sf_dir).withColumn("type", case_map("kind", SECTIONS))
    top = rows.groupBy("track").agg(F.max("value").alias("top"))
    return rows.join(top, "track").select("track", "t", "event_id", "type", (F.col("value") / F.col("top")).alias("energy"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (supplier), freq and power; no order."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("track"), (F.col("l_extendedprice") % F.lit(11025.0)).alias("freq"), F.col("l_quantity").alias("power"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and v, an array of doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


#: The same bindings as DuckDB common table expressions.
SQL = {
    "frames": """frames as (select track, frame, pc, p / sqrt(sum(p * p) over (partition by track, frame)) as v from (
  select label as track, vec_id as frame, pc, greatest(embedding[pc + 1]::double, 0.0) as p from embeddings, range(0, 12) as r(pc)))""",
    "ev": """ev as (select user_id as track, event_id, event_type as kind, value, epoch_us(ts) / 691200000000.0 as t from events)""",
    "melody": """melody as (select track, t, event_id, kind <> 'error' as voiced, 36.0 + value % 48.0 as midi, 440.0 * pow(2.0, (36.0 + value % 48.0 - 69) / 12) as f0 from ev)""",
    "chords": """chords as (select track, t, event_id, case kind when 'signup' then 'C' when 'view' then 'Am' when 'click' then 'F' when 'purchase' then 'G' else 'N' end as chord,
  least(1.0, value / 100) as confidence, (row_number() over (partition by track order by t, event_id) - 1)::int as seq from ev)""",
    "sections": """sections as (select track, t, event_id, case kind when 'signup' then 'intro' when 'view' then 'verse' when 'click' then 'pre_chorus' when 'purchase' then 'chorus' else 'instrumental' end as type,
  value / max(value) over (partition by track) as energy from ev)""",
    "curve": """hours as (select (user_id % 10)::bigint as track, epoch_us(ts) // 3600000000 as h, sum(floor(value)) as x from events group by all),
spans as (select track, min(h) as low, max(h) as high from hours group by track),
curve as (select s.track, r.h - s.low as frame, coalesce(x, 0.0)::double as x from (select track, low, unnest(range(low, high + 1)) as h from spans) r join spans s on s.track = r.track left join hours on hours.track = r.track and hours.h = r.h)""",
    "cells": """sums as (select (l_suppkey % 8)::bigint as track, datediff('day', date '1995-01-01', l_shipdate::date) // 30 as frame, floor((l_extendedprice % 11025.0) / 172.265625)::bigint as bin, sum(l_quantity)::double as power from lineitem group by all),
cells as (select g.track, g.frame, b.bin, coalesce(power, 0.0) as power from (select track, unnest(range(0, max(frame) + 1)) as frame from sums group by track) g cross join range(64) b(bin) left join sums on sums.track = g.track and sums.frame = g.frame and sums.bin = b.bin)""",
    "sounding": """sounding as (select (l_suppkey % 10)::bigint as track, datediff('day', date '1995-01-01', l_shipdate::date)::double as t, ((l_orderkey * 8 + l_linenumber) * 64 + l_quantity)::bigint as frame, l_quantity::double as q, l_quantity::double / 64 as rms, l_tax::double * 2 + 0.00137 as zcr,
  l_extendedprice::double % 6000 as centroid, l_extendedprice::double % 9000 as rolloff, l_extendedprice::double % 1500 as bandwidth, case when l_discount > 0.02 then 110 * pow(2.0, l_quantity::double * 0.7 / 12) end as f0, l_partkey % 12 as pc from lineitem),
quarters as (select track, floor(t / 90)::bigint as seq, floor(t / 90) * 90.0 as start, floor(t / 90) * 90.0 + 90 as stop, ['verse', 'chorus', 'bridge'][(floor(t / 90)::bigint % 3 + 1)] as type, floor(avg(rms) * 1024) / 1024 as energy from sounding group by track, floor(t / 90))""",
    "spectrum": """spectrum as (select l_suppkey as track, l_extendedprice % 11025.0 as freq, l_quantity as power from lineitem)""",
}


def with_sql(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
