"""Queries and SQL of signals: filters, autocorrelation, tempo, beats, best paths, spectrogram parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import melody, scan
from cadenza.operators import signal as G
from cadenza.operators.series import round6
from cadenza.plans import chords as chord_plans
from cadenza.plans.keys import indexed_frames
from cadenza.sources import bindings as B

RATE = 40.0  # frames a second of the onset curve
WINDOW = 64
BPM = 120.0
NYQUIST = 11025.0
PENALTY = 0.25
B4, A4 = scan.highpass(4, 0.05)


def signal_highpass(spark, sf_dir):
    """Blocks of 256 frames, so that the state crosses some."""
    return scan.both_ways(B.onset_curve(spark, sf_dir), B4, A4, 256).select("track", "frame", *round6("x"))


def signal_autocorrelation(spark, sf_dir):
    return G.autocorrelation(B.onset_curve(spark, sf_dir), most=96, size=256).select("track", "lag", *round6("r"))


def rhythm_polyrhythm(spark, sf_dir):
    return G.polyrhythm(B.onset_curve(spark, sf_dir))


def voiced_pitch(spark, sf_dir) -> DataFrame:
    """Voiced notes of a user, numbered in order."""
    rows = B.melody(spark, sf_dir).filter("voiced")
    return rows.select("track", (F.row_number().over(Window.partitionBy("track").orderBy("t", "event_id")) - 1).cast("long").alias("frame"), F.col("f0").alias("x"))


def melody_vibrato(spark, sf_dir):
    return G.vibrato(voiced_pitch(spark, sf_dir)).select("track", *round6("rate", "extent"))


def timbre_reverb(spark, sf_dir):
    envelope = B.onset_curve(spark, sf_dir).withColumn("x", F.col("x") / 4096)
    return G.reverb(envelope).select("track", *round6("reverb"))


def tempo_frames(spark, sf_dir):
    return G.frame_tempi(B.onset_curve(spark, sf_dir), RATE, WINDOW, size=256).select("track", "frame", *round6("bpm"))


def tempo_detected(spark, sf_dir):
    return G.detected_tempo(B.onset_curve(spark, sf_dir), RATE, WINDOW).select("track", "bpm", *round6("confidence"))


def beat_track(spark, sf_dir):
    curve = B.onset_curve(spark, sf_dir)
    tempi = curve.select("track").distinct().withColumn("bpm", F.lit(BPM))
    return G.beats(curve, tempi, RATE, size=256).select("track", "frame", "t", "beat")


def pitch_path(spark, sf_dir):
    rows = indexed_frames(spark, sf_dir).groupBy("track", F.col("idx").cast("long").alias("frame")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "v"))), lambda x: x["v"]).alias("v"))  # twelve entries
    return scan.best_path(rows, PENALTY, 32).select("track", "frame", "state", *round6("total"))


def melody_tracked_pitch(spark, sf_dir):
    """Notes of a user in order; those of errors are unvoiced."""
    rows = B.melody(spark, sf_dir)
    order = (F.row_number().over(Window.partitionBy("track").orderBy("t", "event_id")) - 1).cast("long")
    return melody.tracked_pitch(rows.select("track", order.alias("frame"), F.when(F.col("voiced"), F.col("f0")).alias("f0"))).select("track", "frame", "midi", *round6("f0"))


def spectrogram_parts(spark, sf_dir):
    return G.parted(B.spectrogram(spark, sf_dir), size=32).select("track", "frame", "bin", *round6("harmonic", "percussive"))


def timbre_contrast(spark, sf_dir):
    return G.spectral_contrast(B.spectrogram(spark, sf_dir), 64, NYQUIST, 0.2).select("track", "frame", "band", *round6("contrast"))


def chroma_tonnetz(spark, sf_dir):
    return G.tonnetz(B.chroma_frames(spark, sf_dir)).select("track", "frame", F.col("axis").cast("long").alias("axis"), *round6("v"))


QUERIES = [
    signal_highpass, signal_autocorrelation, rhythm_polyrhythm, melody_vibrato, timbre_reverb, tempo_frames, tempo_detected, beat_track, pitch_path, melody_tracked_pitch, spectrogram_parts,
    timbre_contrast, chroma_tonnetz,
]

_CURVE = B.with_sql("curve")
_CURVE_R = _CURVE.replace("with ", "with recursive ", 1)
_Z = scan.Linear(B4, A4, 1).steady


def _lags(source: str) -> str:
    return f"ac as (select a.track, b.frame - a.frame as lag, sum(a.x * b.x) as r from {source} a join {source} b on a.track = b.track and b.frame >= a.frame group by all)"


def _peaks(distance: int) -> str:
    return f"""around as (select *, lag(r) over w as before, lead(r) over w as after, max(r) over (partition by track) as top from ac window w as (partition by track order by lag)),
high as (select track, lag, r, row_number() over (partition by track order by r desc, lag desc) as k from around where r > before and r > after and r >= top * 0.3),
taken(track, k, kept) as (select track, 0, []::bigint[] from high group by track union all
  select h.track, h.k, case when len(list_filter(kept, lambda p: abs(p - h.lag) < {distance})) = 0 then list_append(kept, h.lag) else kept end from taken t join high h on h.track = t.track and h.k = t.k + 1),
found as (select track, unnest(list_sort(arg_max(kept, k))) as lag from taken group by track)"""


def _recurrence(source: str, name: str, way: int) -> str:
    """The recurrence over ``source`` (track, k, x) by k upwards or downwards, entered steadily."""
    y = f"({B4[0]!r} * s.x + z[1])"
    states = ", ".join((f"z[{i + 2}] + " if i < 3 else "") + f"{B4[i + 1]!r} * s.x - ({A4[i + 1]!r}) * {y}" for i in range(4))
    begin = "min" if way > 0 else "max"
    zero = "[" + ", ".join(f"{v!r} * x" for v in _Z.tolist()) + "]"
    return f"""{name}_r(track, k, y, z) as (select track, {begin}(k) - {way}, 0.0::double, arg_{begin}({zero}, k) from {source} group by track
  union all select s.track, s.k, {y}, [{states}] from {name}_r p join {source} s on s.track = p.track and s.k = p.k + {way}),
{name} as (select p.track, p.k, p.y as x from {name}_r p join {source} s on s.track = p.track and s.k = p.k)"""


def _path(n: int, penalty: float) -> str:
    """The best path over ``vs`` (track, frame, v), as ``walk``."""
    return f"""dp(track, frame, totals, links) as (select distinct track, -1, list_transform(range({n}), lambda i: 0.0::double), []::bigint[] from vs
  union all select track, frame, list_transform(range(1, {n + 1}), lambda j: list_max(ways[j]) + v[j]), list_transform(range(1, {n + 1}), lambda j: list_position(list_transform(ways[j], lambda x: round(x, 9)), round(list_max(ways[j]), 9)) - 1)
  from (select s.track, s.frame, s.v, list_transform(range({n}), lambda j: list_transform(range({n}), lambda i: totals[i + 1] - {penalty}::double * abs(i - j))) as ways from dp join vs s on s.track = dp.track and s.frame = dp.frame + 1)),
walk(track, frame, state, total) as (select track, frame, list_position(list_transform(totals, lambda x: round(x, 9)), round(list_max(totals), 9)) - 1, list_max(totals) from (select * from dp qualify frame = max(frame) over (partition by track))
  union all select d.track, d.frame, n.links[w.state + 1], d.totals[n.links[w.state + 1] + 1] from walk w join dp n on n.track = w.track and n.frame = w.frame join dp d on d.track = w.track and d.frame = w.frame - 1 where d.frame >= 0)"""


B4, A4 = B4.tolist(), A4.tolist()
_P = round(60 * RATE / BPM)
_COST = f"list_transform(range(-{2 * _P}, {1 - round(_P / 2)}), lambda o: -100 * ln(-o / {float(_P)}::double) ** 2)"
_N_BACK = 2 * _P - round(_P / 2) + 1
_TEMPI = f"""{_CURVE},
ends as (select track, count(*) as n, arg_min(x, frame) as x0, arg_max(x, frame) as x1 from curve group by track),
long as (select track, frame, x from curve union all select track, -k, x0 * (1 - k / {WINDOW / 2}) from ends, range(1, {WINDOW // 2 + 1}) r(k) union all select track, n - 1 + k, x1 * (1 - k / {WINDOW / 2}) from ends, range(1, {WINDOW // 2 + 1}) r(k)),
cut as (select c.track, c.frame, k, l.x * (0.5 - 0.5 * cos(2 * pi() * k / {WINDOW})) as v from curve c, range({WINDOW}) r(k), long l where l.track = c.track and l.frame = c.frame - {WINDOW // 2} + k and l.x <> 0),
local as (select a.track, a.frame, b.k - a.k as lag, sum(a.v * b.v) as r from cut a join cut b on a.track = b.track and a.frame = b.frame and b.k >= a.k group by all),
over as (select c.track, c.frame, g.lag, coalesce(l.r / z.r, 0) as r from curve c cross join range(1, {WINDOW}) g(lag) left join local l on l.track = c.track and l.frame = c.frame and l.lag = g.lag left join local z on z.track = c.track and z.frame = c.frame and z.lag = 0),
tempi as (select track, frame, {60 * RATE}::double / lag as bpm from over where {60 * RATE}::double / lag < 300
  qualify row_number() over (partition by track, frame order by ln(1 + 1e6 * r) - 0.5 * log2({60 * RATE / 150}::double / lag) ** 2 desc, lag) = 1)"""
_VOTES = "votes as (select track, least(floor((bpm - 40.0) / 0.5), 520)::bigint as bin from tempi where bpm between 40 and 300)"
_CHOICE = chord_plans.SQL["tempo_smart_choice"]
_MIRROR = "case when m < n then m else 2 * n - 1 - m end"
_BANDS = G.octave_bands(64, NYQUIST, quantile=0.2)

SQL = {
    "signal_highpass": f"""{_CURVE_R}, ends as (select track, count(*) as n, arg_min(x, frame) as x0, arg_max(x, frame) as x1 from curve group by track), pads as (select *, least(15, n - 1) as p from ends),
long as (select track, frame as k, x from curve union all select c.track, -frame, 2 * x0 - x from curve c join pads using (track) where frame between 1 and p union all select c.track, 2 * (n - 1) - frame, 2 * x1 - x from curve c join pads using (track) where frame between n - 1 - p and n - 2),
{_recurrence('long', 'ahead', 1)}, {_recurrence('ahead', 'back', -1)}
select b.track, b.k as frame, round(b.x, 6) as x from back b join ends using (track) where b.k >= 0 and b.k < n""",
    "signal_autocorrelation": f"{_CURVE}, {_lags('curve')} select track, lag, round(r, 6) as r from ac where lag <= 96",
    "rhythm_polyrhythm": f"""{_CURVE_R}, {_lags('curve')}, {_peaks(10)},
ratios as (select track, lag / lag(lag) over (partition by track order by lag) as q from found), odd as (select track, count(*) as n_peaks, count(*) filter (abs(q - round_even(q, 0)) > 0.1) as n_odd from ratios group by track),
sizes as (select track, count(*) as n from curve group by track)
select track, coalesce(n_peaks, 0) as n_peaks, n >= 100 and coalesce(n_peaks, 0) > 3 and coalesce(n_odd, 0) > 1 as polyrhythm from sizes left join odd using (track)""",
    "melody_vibrato": f"""{B.with_sql('ev', 'melody').replace('with ', 'with recursive ', 1)}, notes as (select track, row_number() over (partition by track order by t, event_id) - 1 as frame, f0 from melody where voiced),
stats as (select track, count(*) as n, avg(f0) as mean, stddev_pop(f0) as sd from notes group by track), series as (select track, frame, f0 - mean as x from notes join stats using (track)),
{_lags('series')}, {_peaks(5)}, first as (select track, min(lag) as lag from found group by track)
select track, case when lag is not null and n >= 20 then round(least(10.0, n / 2.0 / (lag + 1e-8)), 1) else 0 end::double as rate, case when lag is not null and n >= 20 then round(sd / (mean + 1e-8), 6) else 0 end::double as extent from stats left join first using (track)""",
    "timbre_reverb": f"""{_CURVE}, env as (select track, frame, x / 4096 as x from curve), {_lags('env')}, sizes as (select track, count(*) as n from env group by track),
means as (select track, n, avg(r) filter (lag >= n // 4 and lag < n // 2) as far, avg(r) filter (lag < n // 8) as near from ac join sizes using (track) group by track, n),
steps as (select track, var_pop(d) as v from (select track, x - lag(x) over (partition by track order by frame) as d from env) group by track)
select track, round(case when n >= 10 and near <> 0 then least(0.95, least(0.7, greatest(0.0, far / near * 1.5)) + least(0.3, v * 10)) else 0.2 end, 6)::double as reverb from means join steps using (track)""",
    "tempo_frames": f"{_TEMPI} select track, frame, round(bpm, 6) as bpm from tempi",
    "tempo_detected": _TEMPI.replace("with ", "with recursive ", 1) + ",\n" + _VOTES + _CHOICE[_CHOICE.index(",\ncounted as") :],
    "beat_track": f"""{_CURVE_R}, sds as (select track, stddev_samp(x) as sd from curve group by track having stddev_samp(x) > 0),
score as (select a.track, a.frame, sum(b.x / sd * exp(-0.5 * ((b.frame - a.frame) * 32.0 / {_P}) ** 2)) as s from curve a join curve b on a.track = b.track and b.frame between a.frame - {_P} and a.frame + {_P} join sds on sds.track = a.track group by all),
starts as (select track, min(frame) as begins from (select *, max(s) over (partition by track) as top from score) where s >= 0.01 * top group by track),
dp(track, frame, sums, total, link) as (select track, -1, list_transform(range({2 * _P}), lambda i: 0.0::double), 0.0::double, -1::bigint from sds
  union all select track, frame, list_append(sums[2:], s + best), s + best, case when frame < begins then -1 else greatest(-1, frame - {2 * _P + 1} + list_position(list_transform(ways, lambda x: round(x, 9)), round(best, 9))) end
  from (select *, list_max(ways) as best from (select c.track, c.frame, c.s, begins, sums, list_transform(range(1, {_N_BACK + 1}), lambda i: {_COST}[i] + sums[i]) as ways from dp join score c on c.track = dp.track and c.frame = dp.frame + 1 join starts on starts.track = c.track))),
lines as (select track, frame, total, link from dp where frame >= 0),
tops as (select * from (select *, lag(total) over w as b, lead(total) over w as a from lines window w as (partition by track order by frame)) where round(total, 9) > round(b, 9) and round(total, 9) >= round(coalesce(a, total), 9)),
lasts as (select track, max(frame) as frame from (select *, median(total) over (partition by track) as m from tops) where total * 2 > m group by track),
walk(track, frame) as (select track, frame from lasts union all select l.track, l.link from walk w join lines l on l.track = w.track and l.frame = w.frame where l.link >= 0),
smooth as (select w.track, w.frame, s + (coalesce(lag(s) over o, 0) + coalesce(lead(s) over o, 0)) / 2 as g from walk w join score using (track, frame) window o as (partition by w.track order by w.frame)),
graded as (select *, sqrt(avg(g * g) over (partition by track)) / 2 as least_g from smooth), bounds as (select track, min(frame) as a, max(frame) as b from graded where g > least_g group by track)
select g.track, g.frame::bigint as frame, g.frame / {RATE}::double as t, row_number() over (partition by g.track order by g.frame) - 1 as beat from graded g join bounds on bounds.track = g.track and g.frame between a and b""",
    "pitch_path": f"""{B.with_sql('frames').replace('with ', 'with recursive ', 1)}, fr as (select track, dense_rank() over (partition by track order by frame) - 1 as frame, pc, v from frames),
vs as (select track, frame, list(v order by pc) as v from fr group by all), {_path(12, PENALTY)}
select track, frame::bigint as frame, state::bigint as state, round(total, 6) as total from walk""",
    "melody_tracked_pitch": f"""{B.with_sql('ev', 'melody').replace('with ', 'with recursive ', 1)}, notes as (select track, row_number() over (partition by track order by t, event_id) - 1 as frame, case when voiced then round_even(69 + 12 * log2(f0 / 440), 0) end as m from melody),
vs as (select track, frame, list_transform(range(61), lambda k: case when abs(m - 36 - k) = 0 then 1.0 when abs(m - 36 - k) = 12 then 0.5 else 0.0 end::double) as v from notes), {_path(61, 0.2)}
select w.track, w.frame::bigint as frame, case when m is not null then state + 36 end::bigint as midi, case when m is not null then round(440 * pow(2.0, (state + 36 - 69) / 12), 6) end::double as f0 from walk w join notes n on n.track = w.track and n.frame = w.frame""",
    "spectrogram_parts": f"""{B.with_sql('cells')}, sizes as (select track, max(frame) + 1 as n from cells group by track),
tq as (select track, q, n, ((q % (2 * n)) + 2 * n) % (2 * n) as m from (select track, n, unnest(range(-15, n + 15)) as q from sizes)),
th as (select t.track, c.bin, q, c.power from (select track, q, {_MIRROR} as frame from tq) t join cells c on c.track = t.track and c.frame = t.frame),
hs as (select track, bin, q as frame, median(power) over (partition by track, bin order by q rows between 15 preceding and 15 following) as h from th),
bq as (select q, {_MIRROR} as bin from (select q, 64 as n, ((q % 128) + 128) % 128 as m from range(-15, 79) r(q))),
ps as (select c.track, c.frame, b.q as bin, median(c.power) over (partition by c.track, c.frame order by b.q rows between 15 preceding and 15 following) as p from bq b join cells c on c.bin = b.bin),
masks as (select c.track, c.frame, c.bin, c.power, h, p, 3 * p as p3, 3 * h as h3 from cells c join hs on hs.track = c.track and hs.bin = c.bin and hs.frame = c.frame join ps on ps.track = c.track and ps.frame = c.frame and ps.bin = c.bin)
select track, frame, bin, round(case when greatest(h, p3) > 0 then power * h * h / (h * h + p3 * p3) else 0 end, 6)::double as harmonic, round(case when greatest(p, h3) > 0 then power * p * p / (p * p + h3 * h3) else 0 end, 6)::double as percussive from masks""",
    "timbre_contrast": f"""{B.with_sql('cells')}, bands(band, low, high, n) as (values {', '.join(f'({k}, {a}, {b}, {n})' for k, a, b, n in _BANDS)}),
r as (select track, frame, band, n, power, row_number() over (partition by track, frame, band order by power) as up, row_number() over (partition by track, frame, band order by power desc) as down from cells join bands on bin between low and high)
select track, frame, band::bigint as band, round(10 * log10(greatest(1e-10, avg(power) filter (down <= n))) - 10 * log10(greatest(1e-10, avg(power) filter (up <= n))), 6) as contrast from r group by track, frame, band""",
    "chroma_tonnetz": f"""{B.with_sql('frames')}, axes(axis, turn, radius) as (values (0, 7/6, 1.0), (1, 7/6, 1.0), (2, 3/2, 1.0), (3, 3/2, 1.0), (4, 2/3, 0.5), (5, 2/3, 0.5))
select track, frame, axis::bigint as axis, round(coalesce(sum(v * radius * case when axis % 2 = 0 then sin(pi() * turn * pc) else cos(pi() * turn * pc) end) / nullif(sum(abs(v)), 0), 0), 6)::double as v from frames, axes group by track, frame, axis""",
}
