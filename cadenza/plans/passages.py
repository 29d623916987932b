"""Queries and SQL of section characteristics, endings and novelty at two scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import passages as A
from cadenza.operators import structure as T
from cadenza.operators import timbre
from cadenza.operators.series import round6
from cadenza.plans.structures import frame_vectors
from cadenza.session import table
from cadenza.sources import bindings as B

NUMBERS = ("energy", "centroid", "rolloff", "zcr", "bandwidth", "jump_rate", "complexity", "harmonic_content", "rhythm_density", "voiced_ratio", "first_peak")


def section_characteristics(spark, sf_dir):
    found = A.characteristics(B.quarters(spark, sf_dir), B.sounding(spark, sf_dir))
    return found.select("track", "seq", *round6(*NUMBERS), "is_spoken", "vocal_presence")


def section_outros(spark, sf_dir):
    """The level falls from June to May here, so that some ends fade; a part's number is its pitch class."""
    frames = B.sounding(spark, sf_dir)
    falling = frames.withColumn("rms", F.col("rms") / (1 + F.pmod(F.col("t"), F.lit(180.0)) / 32)).withColumn("zcr", F.col("zcr") / 4)
    chroma = frames.select("track", "t", "frame", "pc", (F.col("rms") * F.when(F.col("pc") == F.col("track"), 4).otherwise(1)).alias("v"))
    return A.endings(B.quarters(spark, sf_dir), falling, chroma)


def _vectors(spark, sf_dir):
    return frame_vectors(spark, sf_dir).select("track", F.col("idx").cast("long").alias("frame"), "v")


def novelty_multi_scale(spark, sf_dir):
    return T.multi_scale_novelty(_vectors(spark, sf_dir)).select("track", "frame", *round6("novelty"))


def novelty_checkerboard(spark, sf_dir):
    return T.board_novelty(_vectors(spark, sf_dir), 8).select("track", "frame", *round6("novelty"))


def _timbre(spark, sf_dir):
    """Frames by supplier; coefficients and contrast from the dimensions of the embeddings of the same digit."""
    frames = B.sounding(spark, sf_dir).select("track", (F.col("rms") / 8).alias("rms"), (F.col("zcr") * 4).alias("flatness"), "bandwidth")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("track"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    mfcc = rows.filter("k between 13 and 25").select("track", (F.col("k") - 13).alias("k"), (F.col("v") * 4).alias("v"))
    return frames, mfcc, B.chroma_frames(spark, sf_dir).withColumn("track", F.col("track").cast("long")), rows.filter("k > 57").select("track", F.abs(F.col("v") * 30).alias("v"))


def timbre_warmth(spark, sf_dir):
    return timbre.warmth(_timbre(spark, sf_dir)[1]).select("track", *round6("warmth"))


def timbre_density(spark, sf_dir):
    return timbre.density(_timbre(spark, sf_dir)[0]).select("track", *round6("density"))


SCORES = ("smoothness", "richness", "clarity", "fullness", "spectral_complexity", "harmonic_richness", "temporal_stability", "timbral_consistency")


def timbre_texture_scores(spark, sf_dir):
    return timbre.texture(*_timbre(spark, sf_dir)).select("track", *round6(*SCORES))


QUERIES = [timbre_warmth, timbre_density, timbre_texture_scores, section_characteristics, section_outros, novelty_multi_scale, novelty_checkerboard]

_HELD = f"""{B.with_sql('sounding')}, held as (select f.*, s.seq from sounding f join quarters s on s.track = f.track and f.t >= s.start and f.t < s.stop)"""
_SIMS = f"""{B.with_sql('frames')}, fr as (select track, dense_rank() over (partition by track order by frame) - 1 as frame, pc, v from frames), sizes as (select track, max(frame) + 1 as n from fr group by track),
sims as (select a.track, a.frame as i, b.frame as j, greatest(0.0, least(1.0, sum(a.v * b.v))) as sim from fr a join fr b on a.track = b.track and a.pc = b.pc and abs(a.frame - b.frame) < 32 group by all),
whole as (select distinct fr.track, frame, n from fr join sizes using (track))"""


def _sides(k: int) -> str:
    return f"""raw{k} as (select w.track, w.frame, coalesce(avg(sim) filter (i < frame and j < frame), 0) as a, coalesce(avg(sim) filter (i >= frame and j >= frame), 0) as b, coalesce(avg(sim) filter (i < frame and j >= frame), 0) as c
  from whole w left join sims s on s.track = w.track and i >= frame - {k} and i < frame + {k} and j >= frame - {k} and j < frame + {k} and frame >= {k} and frame < n - {k} group by w.track, w.frame)"""


def _smooth(k: int) -> str:
    turned = "((w.frame + o) % (2 * n) + 2 * n) % (2 * n)"
    return f"""{_sides(k)}, turned{k} as (select w.track, w.frame, exp(-o * o / 8.0) as g, case when {turned} < n then {turned} else 2 * n - 1 - {turned} end as q from whole w, range(-8, 9) r(o)),
soft{k} as (select t.track, t.frame, sum(g * abs(a - b)) / sum(g) as x from turned{k} t join raw{k} r on r.track = t.track and r.frame = t.q group by t.track, t.frame),
top{k} as (select track, frame, case when max(x) over (partition by track) > 0 then x / max(x) over (partition by track) else x end as x from soft{k})"""


_EMB = """emb as (select label::bigint as track, vec_id, k - 1 as k, embedding[k]::double as v from embeddings, range(1, 65) r(k)), mf as (select track, k - 13 as k, v * 4 as v from emb where k between 13 and 25)"""
SQL = {
    "timbre_warmth": f"""with {_EMB}, m as (select track, 1 / (1 + exp(-avg(v) filter (k between 1 and 3))) + case when avg(v) filter (k between 4 and 7) > -5 then 0.2 else 0 end as w from mf group by track)
select track, round(case when least(1.0, w) < 0.3 then 0.3 + least(1.0, w) * 0.4 else least(1.0, w) end, 6)::double as warmth from m""",
    "timbre_density": f"{B.with_sql('sounding')} select track, round(least(1.0, (avg(zcr * 4) + least(1.0, avg(rms / 8) * 5)) / 2), 6)::double as density from sounding group by track",
    "timbre_texture_scores": f"""{B.with_sql('sounding', 'frames')}, {_EMB}, l as (select track, avg(zcr * 4) as f, avg(bandwidth) as b, avg(rms / 8) as r, stddev_pop(rms / 8) as s from sounding group by track), m as (select track, stddev_pop(v) as ms from mf group by track),
e as (select track, avg(s) as me from (select track, k, stddev_pop(v) as s from mf group by track, k) group by track), c as (select track::bigint as track, stddev_pop(v) as cs from frames group by track), k as (select track, avg(abs(v * 30)) as kk from emb where k > 57 group by track)
select track, round(1 - f, 6) as smoothness, round(least(1.0, b / 5000), 6)::double as richness, round(least(1.0, kk / 30), 6)::double as clarity, round(least(1.0, r * 10), 6)::double as fullness, round(least(1.0, ms / 10), 6)::double as spectral_complexity,
  round(least(1.0, cs / 2), 6)::double as harmonic_richness, round(1 - least(1.0, s / (r + 1e-8)), 6)::double as temporal_stability, round(1 - least(1.0, me / 10), 6)::double as timbral_consistency from l join m using (track) join e using (track) join c using (track) join k using (track)""",
    "section_characteristics": f"""{_HELD}, steps as (select track, seq, abs(12 * log2(f0 / 440) - lag(12 * log2(f0 / 440)) over (partition by track, seq order by t, frame)) as d from held where f0 > 0),
jumps as (select track, seq, coalesce(count(*) filter (d > 2) / nullif(count(d), 0), 0) as rate from steps group by track, seq),
m as (select track, seq, avg(rms * rms) as energy, avg(centroid) as centroid, avg(rolloff) as rolloff, avg(zcr) as zcr, avg(bandwidth) as bandwidth, avg(q * q / 16384) / (avg(rms * rms) + 1e-8) as h, avg(bandwidth) / (avg(centroid) + 1e-8) as cx, count(*) filter (q > 45) as n from held group by track, seq)
select track, seq, round(energy, 6) as energy, round(centroid, 6) as centroid, round(rolloff, 6) as rolloff, round(zcr, 6) as zcr, round(bandwidth, 6) as bandwidth, round(coalesce(rate, 0), 6)::double as jump_rate, round(cx, 6) as complexity, round(h, 6) as harmonic_content,
  round(least(1.0, n / 900.0), 6)::double as rhythm_density, round(least(1.0, case when h > 0.3 then 0.4 when h > 0.1 then 0.2 else 0 end + case when centroid between 1000 and 3000 then 0.3 when centroid between 500 and 5000 then 0.1 else 0 end + case when zcr < 0.1 then 0.3 when zcr < 0.2 then 0.1 else 0 end), 6)::double as voiced_ratio,
  round(seq * 90.0 + 90 * case when energy > 0.5 then 0.3 else 0.5 end, 6)::double as first_peak, energy < 0.02 and centroid > 1000 and centroid < 3000 and zcr > 0.1 and cx < 0.5 as is_spoken, h > 0.3 and centroid > 1000 and centroid < 4000 as vocal_presence
from m left join jumps using (track, seq)""",
    "section_outros": f"""{_HELD}, late as (select * from (select *, max(stop) over (partition by track) as everything from quarters) where start >= everything * 0.85),
lv as (select l.track, l.seq, avg(pow(rms / (1 + (t % 180) / 32), 2)) filter (t < start + 10) as head, avg(pow(rms / (1 + (t % 180) / 32), 2)) filter (t >= stop - 10) as tail, avg((zcr / 4 < 0.1)::int) as voiced from late l join held h on h.track = l.track and h.seq = l.seq group by all),
notes as (select l.track, l.seq, pc, avg(rms * case when pc = l.track then 4 else 1 end) as v from late l join held h on h.track = l.track and h.seq = l.seq and t >= stop - 27 group by all),
lead as (select track, seq, list(v order by v desc) as v from notes group by track, seq),
f as (select l.track, l.seq, l.type, l.energy, coalesce(head > 0 and tail > 0 and 10 * log10(tail / head) < -6, false) or coalesce(voiced, 0) < 0.15 as fade, coalesce(v[1] / (coalesce(v[2], 0) + 1e-8) > 1.5 and v[1] > 0.5, false) as resolves from late l left join lv using (track, seq) left join lead using (track, seq))
select track, seq, fade, resolves, case when fade or (resolves and energy < 0.5) then 'outro' else type end as label, (case when fade then 0.8 when resolves and energy < 0.5 then 0.6 end)::double as confidence from f""",
    "novelty_multi_scale": f"""{_SIMS}, {_smooth(8)}, {_smooth(16)}, both_scales as (select a.track, a.frame, a.x + 0.7 * b.x as x from top8 a join top16 b on a.track = b.track and a.frame = b.frame)
select track, frame, round(case when max(x) over (partition by track) > 0 then x / max(x) over (partition by track) else x end, 6)::double as novelty from both_scales""",
    "novelty_checkerboard": f"""{_SIMS}, {_sides(8)}, x as (select track, frame, ln(1 + greatest(0.0, (a + b - 2 * c) / 4)) as x from raw8)
select track, frame, round(case when max(x) over (partition by track) > 0 then x / max(x) over (partition by track) else x end, 6)::double as novelty from x""",
}
