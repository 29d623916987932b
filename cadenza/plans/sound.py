"""Queries and SQL of the dynamics, timbre, melody and harmony families."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators import dynamics as D
from cadenza.operators import harmony as H
from cadenza.operators import melody as M
from cadenza.operators.series import round6
from cadenza.plans.keys import values
from cadenza.sources import bindings as B


def dynamics_range(spark, sf_dir):
    return D.dynamic_range(B.energy(spark, sf_dir, "track")).select("track", *round6("range_db", "variance", "spread", "peak_to_mean", "crest", "mean_loudness", "peak_loudness"))


def dynamics_energy_profile(spark, sf_dir):
    return D.energy_profile(B.energy(spark, sf_dir)).select("track", "w", *round6("e", "s", "gradient"))


def dynamics_band_distribution(spark, sf_dir):
    return D.band_distribution(B.spectrum(spark, sf_dir)).select("track", *round6("low", "mid", "high", "balance"))


def dynamics_perceived_loudness(spark, sf_dir):
    return D.perceived_loudness(B.spectrum(spark, sf_dir)).select("track", *round6("perceived"))


def timbre_brightness(spark, sf_dir):
    """Frequencies of loud lines as centroids of frames; those of every other track an eighth as high."""
    low = F.when(F.col("track") % 2 == 0, 8.0).otherwise(1.0)
    frames = B.spectrum(spark, sf_dir).filter("power > 25").select("track", (F.col("freq") / low).alias("x"))
    return D.brightness(frames, 22050.0).select("track", *round6("brightness"))


def dynamics_sudden_events(spark, sf_dir):
    return D.sudden_changes(B.energy(spark, sf_dir)).select("track", F.col("idx").cast("long").alias("idx"), "kind", *round6("magnitude"))


def dynamics_sustained_runs(spark, sf_dir):
    return D.sustained_runs(B.energy(spark, sf_dir)).select("track", "kind", F.col("start").cast("long").alias("start"), "n", *round6("magnitude"))


def timbre_roughness(spark, sf_dir):
    rows = B.energy(spark, sf_dir, "track").select("track", (F.col("rms") / 100).alias("x"))
    return D.roughness(rows).select("track", *round6("roughness"))


def effects_scores(spark, sf_dir):
    return D.effects(B.energy(spark, sf_dir, "track")).select("track", *round6("chorus", "compression", "density"))


def instrument_bands(spark, sf_dir):
    return D.instrument_bands(B.spectrum(spark, sf_dir)).select("track", F.col("rank").cast("long").alias("rank"), "instrument", *round6("confidence"))


def melody_range(spark, sf_dir):
    return M.pitch_range(B.melody(spark, sf_dir)).select("track", "low_name", "high_name", "voice", *round6("low", "high", "width", "octaves", "mean", "sd"))


def melody_vocal_filter(spark, sf_dir):
    return M.vocal_notes(B.melody(spark, sf_dir)).select("track", "event_id", *round6("midi"))


def melody_direction(spark, sf_dir):
    return M.direction(B.melody(spark, sf_dir)).select("track", "tendency", "turns", "n", *round6("up", "down", "mean_step", "small", "medium", "large", "complexity"))


def melody_intervals(spark, sf_dir):
    return M.intervals(B.melody(spark, sf_dir)).select("track", "interval", "n", *round6("share"))


def melody_stability(spark, sf_dir):
    return M.stability(B.melody(spark, sf_dir)).select("track", *round6("stability", "drift"))


def harmony_complexity(spark, sf_dir):
    return H.complexity(B.chroma_frames(spark, sf_dir)).select("track", *round6("entropy", "variance", "complexity"))


def harmony_consonance(spark, sf_dir):
    return H.consonance(B.chroma_frames(spark, sf_dir)).select("track", *round6("consonance", "dissonance", "tension"))


def harmony_rhythm(spark, sf_dir):
    return H.rhythm(B.chroma_frames(spark, sf_dir)).select("track", *round6("rate", "stability", "regularity"))


QUERIES = [
    dynamics_range, dynamics_perceived_loudness, timbre_brightness, dynamics_energy_profile, dynamics_band_distribution, dynamics_sudden_events, dynamics_sustained_runs, timbre_roughness, effects_scores,
    instrument_bands, melody_range, melody_vocal_filter, melody_direction, melody_intervals, melody_stability, harmony_complexity, harmony_consonance, harmony_rhythm,
]

_E = B.with_sql("ev")
_M = B.with_sql("ev", "melody")
_FR = B.with_sql("frames")
_SG = " + ".join(f"{c} * {'lag' if i < 5 else 'lead'}(value, {abs(5 - i)}) over w" for i, c in enumerate(D.SG_11))
_SMOOTH = f"sm as (select * from (select kind as track, row_number() over w - 1 as idx, ({_SG}) / 429.0 as s from ev window w as (partition by kind order by t, event_id)) where s is not null)"
_NOTES = "[" + ", ".join(f"'{n}'" for n in K.NOTES) + "]"
_FAMILY = {"guitar": "guitars", "electric_guitar": "guitars", "violin": "bowed", "strings": "bowed", "cello": "bowed"}
_INS = values("ins", "ord, instrument, lo, hi, family", [(i, n, lo, hi, _FAMILY.get(n, n)) for i, (n, lo, hi) in enumerate(K.INSTRUMENTS)])
_VOICES = values("voices", "vord, voice, vlo, vhi, male", [(i, n, lo, hi, int(i < 3)) for i, (n, lo, hi) in enumerate(K.VOCAL_RANGES)])


def _name(x: str) -> str:
    return f"{_NOTES}[(round_even({x}, 0)::int % 12) + 1] || (floor(round_even({x}, 0) / 12) - 1)::int::varchar"


_STEPS = f"{_M}, ord as (select track, midi, row_number() over (partition by track order by t, event_id) as i from melody where voiced), st as (select * from (select track, i, midi - lag(midi) over (partition by track order by i) as d from ord) where d is not null)"
_CONS = values("ratings", "iv, rating", list(enumerate(K.CONSONANCE)))
SQL = {
    "dynamics_range": f"""{_E}, d as (select track, value, 20 * log10(greatest(value + 1e-8, 1e-5)) as db from ev)
select track, round(max(db) - min(db), 6) as range_db, round(var_pop(db), 6) as variance, round(stddev_pop(db), 6) as spread, round(max(value) / avg(value), 6) as peak_to_mean, round(max(value) / sqrt(avg(value * value)), 6) as crest,
  round(avg(db) + 60, 6) as mean_loudness, round(max(db) + 60, 6) as peak_loudness from d group by track""",
    "dynamics_energy_profile": f"""{_E}, i as (select kind as track, value, row_number() over (partition by kind order by t, event_id) - 1 as idx from ev),
w as (select track, idx // 10 as w, avg(value) as e from i group by all having count(*) = 10), n as (select track, w, e / max(e) over (partition by track) as e from w),
s as (select *, sum(e) over (partition by track order by w rows between 1 preceding and 1 following) / 3 as s from n),
g as (select *, lag(s) over k as p, lead(s) over k as q from s window k as (partition by track order by w))
select track, w::bigint as w, round(e, 6) as e, round(s, 6) as s, round(coalesce(case when p is null then q - s when q is null then s - p else (q - p) / 2 end, 0.0), 6) as gradient from g""",
    "dynamics_perceived_loudness": f"""{B.with_sql('spectrum')}, s as (
  select track, sum(power * case when freq < 1000 then (freq / 1000) ** 2 when freq > 8000 then 0.5 else 1 end) as heard, sum(power) as power from spectrum group by track)
select track, round(greatest(0.01, least(1.0, case when power > 0 then heard / power * 5 else 0 end))::double, 6) as perceived from s""",
    "timbre_brightness": f"""{B.with_sql('spectrum')}, s as (
  select track, avg(freq / case when track % 2 = 0 then 8.0 else 1.0 end) / 22050 as share from spectrum where power > 25 group by track),
b as (select track, share, least(1.0, share * case when share > 0.15 then 2.5 else 1.5 end) as raised from s)
select track, round(greatest(0.0, case when share > 0.1 then greatest(0.4, raised) else raised end)::double, 6) as brightness from b""",
    "dynamics_band_distribution": f"""{B.with_sql('spectrum')}, b as (select track, sum(case when freq between 20 and 250 then power else 0 end) as low, sum(case when freq between 250 and 4000 then power else 0 end) as mid, sum(case when freq >= 4000 then power else 0 end) as high from spectrum group by track),
t as (select track, low / nullif(low + mid + high, 0) as low, mid / nullif(low + mid + high, 0) as mid, high / nullif(low + mid + high, 0) as high from b)
select track, round(coalesce(low, 0), 6) as low, round(coalesce(mid, 0), 6) as mid, round(coalesce(high, 0), 6) as high,
  round(coalesce((case when low > 0 then -low * ln(low) else 0 end + case when mid > 0 then -mid * ln(mid) else 0 end + case when high > 0 then -high * ln(high) else 0 end) / ln(3), 0), 6) as balance from t""",
    "dynamics_sudden_events": f"""{_E}, {_SMOOTH}, d as (select * from (select track, idx, lead(s) over (partition by track order by idx) - s as d from sm) where d is not null), z as (select *, stddev_pop(d) over (partition by track) as sd from d)
select track, idx::bigint as idx, case when d > 0 then 'increase' else 'decrease' end as kind, round(abs(d) / (sd + 1e-8), 6) as magnitude from z where abs(d) > 2 * sd""",
    "dynamics_sustained_runs": f"""{_E}, {_SMOOTH}, l as (select *, avg(s) over (partition by track) as m, stddev_pop(s) over (partition by track) as sd from sm),
k as (select track, idx, s, case when s > m + sd then 'peak' when s < m - sd then 'quiet' end as kind from l),
f as (select *, case when idx - lag(idx) over (partition by track, kind order by idx) <= 5 then 0 else 1 end as brk from k where kind is not null),
r as (select *, sum(brk) over (partition by track, kind order by idx) as island from f)
select track, kind, min(idx)::bigint as start, count(*) as n, round(avg(s), 6) as magnitude from r group by track, kind, island having count(*) >= 10""",
    "timbre_roughness": f"""{_E}, x as (select track, value / 100 as x, avg(value / 100) over (partition by track) as m, stddev_pop(value / 100) over (partition by track) as sd from ev),
s as (select track, any_value(sd) as sd, any_value(sd) * any_value(sd) as v, max(x) - min(x) as rng, any_value(m) as m, abs(avg(pow((x - m) / (sd + 1e-8), 3))) as sk, avg(pow((x - m) / (sd + 1e-8), 4)) as ku from x group by track)
select track, round(least(0.85, (least(0.6, v / 2) * 0.25 + least(0.6, sd / 3.5) * 0.2 + least(0.6, rng / 12) * 0.15 + least(0.6, case when m > 0 then sd / m else 0 end / 1.8) * 0.15 + least(0.6, sk / 3) * 0.15 + least(0.6, (ku - 3) / 10) * 0.1) * case when v > 5 then 1.3 else 1.0 end), 6)::double as roughness from s""",
    "effects_scores": f"{_E}, s as (select track, avg(value) as m, stddev_pop(value) / avg(value) as cv from ev group by track) select track, round(least(1.0, cv * 5), 6)::double as chorus, round(1 - least(1.0, cv * 2), 6)::double as compression, round(least(1.0, m / 500 * 5), 6)::double as density from s",
    "instrument_bands": f"""{B.with_sql('spectrum')}, {_INS}, t as (select track, avg(power) as mean from spectrum group by track),
b as (select track, ord, instrument, family, avg(power) as band from spectrum join ins on freq between lo and hi group by all),
s as (select b.*, least(1.0, band / mean * 0.9) as confidence from b join t using (track)),
k as (select * from s where confidence > 0.15 qualify row_number() over (partition by track, family order by ord) = 1)
select track, row_number() over (partition by track order by round(confidence, 9) desc, ord) as rank, instrument, round(confidence, 6)::double as confidence from k qualify rank <= 5""",
    "melody_range": f"""{_M}, {_VOICES}, r as (select track, min(midi) as low, max(midi) as high, avg(midi) as mean, stddev_pop(midi) as sd from melody where voiced group by track),
o as (select track, voice from r join voices on (male = 1) = (low < 50) where high > low and greatest(0, least(high, vhi) - greatest(low, vlo)) / (high - low) > 0.3 qualify row_number() over (partition by track order by abs((low + high) / 2 - (vlo + vhi) / 2), vord) = 1)
select r.track, {_name('low')} as low_name, {_name('high')} as high_name, case when high - low < 0.1 then case when low < 50 then 'Tenor' else 'Alto' end when high - low > 36 then 'Instrumental (Wide Range)' when low < 36 or high > 96 then 'Instrumental (Extreme Range)'
  else coalesce(voice, case when low < 50 then 'Unknown' else 'Alto' end) end as voice, round(low, 6) as low, round(high, 6) as high, round(high - low, 6) as width, round((high - low) / 12, 6) as octaves, round(mean, 6) as mean, round(sd, 6) as sd from r left join o using (track)""",
    "melody_vocal_filter": f"""{_M}, c as (select track, event_id, midi as x from melody where voiced and midi between 48 and 84),
s as (select track, min(x) as lo, max(x) as hi, count(*) as n, count(*) filter (x >= 55) as nh, quantile_cont(x, 0.5) filter (x >= 55) as mh, quantile_cont(x, 0.1) as p10, quantile_cont(x, 0.9) as p90 from c group by track),
j as (select c.*, s.* exclude (track), case when hi = lo then lo - 0.5 else lo end as b0, case when hi = lo then 1.0 else hi - lo end / 15 as bw from c join s using (track)),
b as (select track, least(floor((x - b0) / bw), 14) as bin, count(*) as v from j group by all), m as (select track, bin from b qualify row_number() over (partition by track order by v desc, bin) = 1),
k as (select j.*, case when b0 + (bin + 0.5) * bw < 55 and nh > 0.2 * n then mh else b0 + (bin + 0.5) * bw end as centre from j join m using (track)),
z as (select track, count(*) as cnt, avg(x) as mean, stddev_pop(x) as sd from k where abs(x - centre) <= 18 group by track),
f as (select k.*, z.cnt, abs(x - centre) <= 18 and (cnt <= 10 or abs(x - mean) <= 2.5 * sd) as kept from k join z using (track)),
g as (select *, count(*) filter (kept) over (partition by track) as left_over from f)
select track, event_id, round(x, 6) as midi from g where case when cnt > 10 and left_over < 0.3 * n then x between p10 and p90 else kept end""",
    "melody_direction": f"""{_STEPS}, t as (select *, coalesce(((lag(d) over (partition by track order by i) > 0) <> (d > 0))::int, 0) as turn from st),
a as (select track, avg((d > 0.5)::int) as up, avg((d < -0.5)::int) as down, sum(turn)::bigint as turns, count(*) as n, avg(abs(d)) as mean_step, avg((abs(d) <= 2)::int) as small, avg((abs(d) > 2 and abs(d) <= 7)::int) as medium, avg((abs(d) > 7)::int) as large from t group by track)
select track, case when up > down + 0.1 then 'ascending' when down > up + 0.1 then 'descending' else 'balanced' end as tendency, turns, n, round(up, 6) as up, round(down, 6) as down, round(mean_step, 6) as mean_step, round(small, 6) as small, round(medium, 6) as medium, round(large, 6) as large, round(turns / n, 6) as complexity from a""",
    "melody_intervals": f"""{_STEPS}, c as (select track, round_even(abs(d), 0)::int % 12 as s, count(*) as n from st group by all)
select track, [{', '.join(f"'{x}'" for x in K.INTERVALS)}][s + 1] as interval, n, round(n / sum(n) over (partition by track), 6) as share from c""",
    "melody_stability": f"""{_M}, o as (select track, f0, row_number() over (partition by track order by t, event_id) - 1 as i from melody where voiced),
s as (select track, count(*) as n, avg(f0) as m, stddev_pop(f0) as sd, regr_slope(f0, i) as k from o group by track)
select track, round(case when n < 10 then 0.0 else 1 / (1 + sd / m) end, 6)::double as stability, round(case when n < 10 then 0.0 else coalesce(least(1.0, abs(k / m) * 100), 0.0) end, 6)::double as drift from s""",
    "harmony_complexity": f"""{_FR}, m as (select track, pc, avg(v) as v, var_pop(v) as var from frames group by all), p as (select *, v / (sum(v) over (partition by track) + 1e-8) + 1e-8 as p from m), q as (select *, p / sum(p) over (partition by track) as q from p),
r as (select track, -sum(q * ln(q)) / ln(12) as entropy, avg(var) as variance, sum(v) as total from q group by track)
select track, round(entropy, 6) as entropy, round(variance, 6) as variance, round(case when total < 1e-6 then 0 else (entropy + least(1.0, variance)) / 2 end, 6) as complexity from r""",
    "harmony_consonance": f"""{_FR}, {_CONS}, s as (select track, frame, sum(v) as energy, max(v) as peak from frames group by all), a as (select f.* from frames f join s using (track, frame) where v > peak * 0.2),
p as (select x.track, x.frame, sum(rating * sqrt(x.v * y.v)) / sum(sqrt(x.v * y.v)) as score from a x join a y on x.track = y.track and x.frame = y.frame and x.pc < y.pc join ratings on iv = y.pc - x.pc group by all),
f as (select track, case when energy < 0.1 then 0.3 else coalesce(score, 0.9) end as score from s left join p using (track, frame)),
g as (select track, avg(score) as mean, var_pop(score) as var, count(*) as n, stddev_pop(score) as tension from f group by track),
l as (select *, case when var > 0.05 or (n > 10 and mean < 0.4) then least(0.4, mean * 0.5) else least(1.0, mean * 1.1 + 0.1) end as level from g)
select track, round(level, 6)::double as consonance, round(1 - level, 6)::double as dissonance, round(tension, 6) as tension from l""",
    "harmony_rhythm": f"""{_FR}, d as (select track, frame, v - lag(v) over (partition by track, pc order by frame) as d from frames), m as (select track, frame, round(sqrt(sum(d * d)), 9) as m from d where d is not null group by all),
s as (select *, row_number() over w as i, lag(m) over w as p, lead(m) over w as q, avg(m) over z as mean, var_pop(m) over z as var, stddev_pop(m) over z as sd, count(*) over z as n from m window w as (partition by track order by frame), z as (partition by track)),
g as (select track, i - lag(i) over (partition by track order by i) as gap from s where m > p and m > q and m >= mean), h as (select track, stddev_pop(gap) as gsd, avg(gap) as gm, count(*) as k from g group by track),
a as (select track, any_value(mean) as mean, any_value(var) as var, any_value(n) as n, count(*) filter (m > sd) as c from s group by track)
select track, round(c / (n + 1), 6) as rate, round(1 / (1 + var * case when mean > 0.5 then 2 else 1 end), 6) as stability, round(case when n > 4 and coalesce(k, 0) > 2 then 1 / (1 + gsd / (gm + 1e-8)) else 0 end, 6) as regularity from a left join h using (track)""",
}
