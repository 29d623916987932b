"""Queries and SQL of the passes over bounded sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import dynamics as D
from cadenza.operators import keys
from cadenza.operators import sections as S
from cadenza.operators.series import round6
from cadenza.operators.structure import in_order
from cadenza.plans import keys as key_plans
from cadenza.plans import sound
from cadenza.session import table
from cadenza.sources import bindings as B

STRETCH = 128.0  # a track's seconds per unit of the bound time; a power of two, so that products are exact
NYQUIST = 11025.0


def timed(spark, sf_dir) -> DataFrame:
    """Sections with start and end (the last takes 8 s) and numbers derived from the event's id."""
    after = F.lead("t").over(Window.partitionBy("track").orderBy("t", "event_id"))
    rows = in_order(B.sections(spark, sf_dir).withColumn("after", after))
    start, e = F.col("t") * STRETCH, F.col("event_id")
    kind = F.when(e % 6 == 5, F.when(e % 5 == 0, "outro").otherwise("bridge")).otherwise(F.col("type"))
    return rows.select(
        "track", F.col("seq").cast("long").alias("seq"), start.alias("start"), F.coalesce(F.col("after") * STRETCH, start + 8).alias("end"), kind.alias("type"),
        "energy", ((e % 10) / 10).alias("complexity"), ((e % 7) / 7).alias("density"), ((e % 3) / 10).alias("flux"), ((e % 5) / 5).alias("brightness"),
    )


def from_zero(series: DataFrame) -> DataFrame:
    """The bound time counted from the track's first row."""
    return series.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("track")))


def section_refined(spark, sf_dir):
    return S.refined(timed(spark, sf_dir)).select("track", "seq", "type", "label")


def section_chorus_hooks(spark, sf_dir):
    return S.chorus_hooks(timed(spark, sf_dir)).select("track", "seq", "type", "label")


def section_endings(spark, sf_dir):
    return S.endings(timed(spark, sf_dir)).select("track", "seq", "type", "label")


def section_merged_types(spark, sf_dir):
    return S.neighbours(timed(spark, sf_dir)).select("track", "seq", "before", "type", "label")


def section_same_type_runs(spark, sf_dir):
    return S.same_type_runs(timed(spark, sf_dir)).select("track", F.col("seq").cast("long").alias("seq"), "type", "n", *round6("start", "end", "energy", "complexity"))


def section_chords(spark, sf_dir):
    """Sections begin at views and purchases; every event is a chord."""
    found = B.sections(spark, sf_dir).filter("type in ('verse', 'chorus')")
    after = F.lead("t").over(Window.partitionBy("track").orderBy("t", "event_id"))
    bounds = found.select("track", "event_id", (F.col("t") * STRETCH).alias("start"), F.coalesce(after * STRETCH, F.col("t") * STRETCH + 8).alias("end"))
    chords = B.chords(spark, sf_dir).select("track", (F.col("t") * STRETCH).alias("t"), "chord")
    return S.section_chords(bounds, chords).select("track", "event_id", "chords")


def section_summary(spark, sf_dir):
    return S.summary(timed(spark, sf_dir))


def energy_scale(spark, sf_dir):
    return S.energy_scale(B.energy(spark, sf_dir, "track")).select("track", *round6("low", "high", "mean", "range"))


def timbre_distortion(spark, sf_dir):
    return S.distortion(B.spectrum(spark, sf_dir), NYQUIST).select("track", *round6("distortion"))


def series_trimmed(spark, sf_dir):
    rows = from_zero(B.energy(spark, sf_dir, "track")).withColumn("t", F.col("t") * STRETCH)
    return S.trimmed(rows).select("track", "event_id", *round6("t", "rms"))


def dynamics_events(spark, sf_dir):
    rows = B.energy(spark, sf_dir)
    found = S.dynamic_events(D.sudden_changes(rows), D.sustained_runs(rows))
    return found.select("track", F.col("idx").cast("long").alias("idx"), "type", *round6("magnitude"))


def chroma_beat_means(spark, sf_dir):
    """Frames are a unit of 1/16 apart; the beats of all users with the track's last digit."""
    frames = key_plans.indexed_frames(spark, sf_dir).select("track", (F.col("idx") / 16).alias("t"), "pc", "v")
    beats = from_zero(B.beats(spark, sf_dir).select((F.col("track") % 10).cast("int").alias("track"), "t"))
    return S.beat_means(frames, beats).select("track", "pc", *round6("start", "v"))


def key_or_default(spark, sf_dir):
    found = keys.final_ladder(key_plans.smoothed(spark, sf_dir))
    best = keys.key_best(keys.key_correlation(key_plans.smoothed(spark, sf_dir))).select("track", "key", "mode", "confidence", F.col("r").alias("key_strength"))
    tracks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("track"))
    return S.key_or_default(tracks, found.filter("confidence > 40"), best).select("track", "key", "mode", *round6("confidence", "key_strength"))


def key_names(spark, sf_dir):
    """The ladder's keys by name; its Unknown ones are those under its least confidence."""
    return S.key_names(keys.final_ladder(key_plans.smoothed(spark, sf_dir))).select("track", "key", *round6("confidence"))


def key_changes(spark, sf_dir):
    rows = in_order(B.chords(spark, sf_dir))
    return S.key_changes(rows.select("track", "seq", F.col("chord").alias("key"), (F.col("confidence") * 100).alias("confidence"))).select("track", "seq", "from_key", "to_key", *round6("confidence", "difference"))


QUERIES = [
    section_refined, section_chorus_hooks, section_endings, section_merged_types, section_same_type_runs, section_chords, section_summary, energy_scale,
    timbre_distortion, series_trimmed, dynamics_events, chroma_beat_means, key_or_default, key_names, key_changes,
]

_TIMED = f"""{B.with_sql('ev', 'sections')}, tm as (select track, row_number() over w - 1 as seq, t * 128.0 as s, coalesce(lead(t) over w * 128.0, t * 128.0 + 8) as e,
  case when event_id % 6 = 5 then case when event_id % 5 = 0 then 'outro' else 'bridge' end else type end as type, energy, (event_id % 10) / 10 as complexity, (event_id % 7) / 7 as density, (event_id % 3) / 10 as flux, (event_id % 5) / 5 as brightness
  from sections window w as (partition by track order by t, event_id)), td as (select *, e - s as d from tm)"""
_BAR = 240.0 / 130.0
_LADDER, _BEST = key_plans.SQL["key_final_ladder"], key_plans.SQL["key_best"]
_PAIRS = " ".join(f"when (b = '{x}' and type = '{y}') or (b = '{y}' and type = '{x}') then '{z}'" for x, y, z in S.MERGED)
_SHOWN = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in S.LABELS.items()) + " else type end"
_CHANGED = "x.key <> w.key and x.confidence > 15 and w.n >= 2"
SQL = {
    "section_refined": f"""{_TIMED} select track, seq, type, case when type = 'outro' and flux > 0.1 then case when energy > 0.5 then 'chorus' when complexity > 0.6 then 'bridge' else 'verse' end
  when type = 'bridge' and complexity < 0.4 then 'verse' when type = 'instrumental' then case when energy < 0.4 and complexity < 0.4 and d < 15 then 'breakdown'
  when energy > 0.6 and complexity > 0.7 and d > 10 and d < 30 then 'solo' when energy >= 0.4 and energy <= 0.7 and complexity > 0.5 and d > 15 then 'interlude' when energy > 0.7 and density > 0.8 then 'buildup' else 'solo' end else type end as label from td""",
    "section_chorus_hooks": f"""{_TIMED} select track, seq, type, case when energy > 0.65 and d >= 6 and d <= 10 and type in ('verse', 'bridge', 'pre_chorus') and (brightness = 0 or brightness > 0.6) then 'chorus' else type end as label from td""",
    "section_endings": f"""{_TIMED}, x as (select *, seq = max(seq) over (partition by track) as final, case when type = 'bridge' and (d < {12 * _BAR!r}::double or complexity <= 0.7) then case when energy > 0.55 then 'pre_chorus' else 'verse' end else type end as l from td)
select track, seq, type, case when final and l in ('instrumental', 'verse') and d <= {8 * _BAR!r}::double then 'outro' else l end as label from x""",
    "section_merged_types": f"""{_TIMED}, x as (select *, lag(type) over w as b, lag(d) over w as bd from td window w as (partition by track order by seq))
select track, seq, b as before, type, case when bd > d * 2 then b when d > bd * 2 then type when type = 'instrumental' and d < 8 then b when b = 'instrumental' and bd < 8 then type {_PAIRS} else b end as label from x where b is not null""",
    "section_same_type_runs": f"""{_TIMED}, f as (select *, case when type = lag(type) over (partition by track order by seq) then 0 else 1 end as brk from td), r as (select *, sum(brk) over (partition by track order by seq) as island from f)
select track, (island - 1)::bigint as seq, any_value(type) as type, count(*) as n, round(min(s), 6) as start, round(max(e), 6) as "end", round(sum(energy * d) / sum(d), 6) as energy, round(sum(complexity * d) / sum(d), 6) as complexity from r group by track, island""",
    "section_chords": f"""{B.with_sql('ev', 'chords')}, b as (select track, event_id, t, coalesce(lead(t) over w, t + 0.0625) as e, lead(t) over w as n from ev where kind in ('view', 'purchase') window w as (partition by track order by t, event_id)),
c as (select b.track, b.event_id, x.t, chord from b join chords x on x.track = b.track and x.t >= b.t and (b.n is null or x.t < b.n) qualify row_number() over (partition by b.track, b.event_id order by x.t, chord) <= 4),
g as (select track, event_id, string_agg(chord, ' → ' order by t, chord) as chords from c group by all)
select track, event_id, case when (e - t) * 128 > 1 then coalesce(chords, 'Unknown') else 'Unknown' end as chords from b left join g using (track, event_id)""",
    "section_summary": f"""{_TIMED}, l as (select track, seq, printf('  %2d. %-8s(%s) %6.1fs - %6.1fs (%5.1fs)', seq + 1, upper(type[1]) || lower(type[2:]), {_SHOWN}, round_even(s * 10, 0) / 10, round_even(e * 10, 0) / 10, round_even(d * 10, 0) / 10) as line from td)
select track, 'Section List (Estimated ' || count(*) || ' sections)' || chr(10) || string_agg(line, chr(10) order by seq) as summary from l group by track""",
    "energy_scale": f"""{B.with_sql('ev')}, s as (select track, quantile_cont(value, 0.1) filter (value > 0) as low, quantile_cont(value, 0.9) filter (value > 0) as high, avg(value) filter (value > 0) as mean from ev group by track)
select track, round(coalesce(low, 0), 6)::double as low, round(coalesce(high, 0.05), 6)::double as high, round(coalesce(mean, 0.025), 6)::double as mean, round(coalesce(high - low, 0.05), 6)::double as "range" from s""",
    "timbre_distortion": f"""{B.with_sql('spectrum')}, s as (select track, avg(power) filter (freq < 2756.25) as a, avg(power) filter (freq >= 2756.25) as b from spectrum group by track) select track, round(least(1.0, coalesce(b / nullif(a, 0), 0)), 6)::double as distortion from s""",
    "series_trimmed": f"""{B.with_sql('ev')}, z as (select track, event_id, value, (t - min(t) over (partition by track)) * 128.0 as t from ev), x as (select *, max(t) over (partition by track) as l from z) select track, event_id, round(t, 6) as t, round(value, 6) as rms from x where l <= 180 or (t >= l / 4 and t < l / 4 + 180)""",
    "dynamics_events": f"""select track, idx, 'sudden_' || kind as type, magnitude from ({sound.SQL['dynamics_sudden_events']}) union all select track, start, case kind when 'peak' then 'sustained_peak' else 'quiet_section' end, magnitude from ({sound.SQL['dynamics_sustained_runs']})""",
    "chroma_beat_means": f"""{B.with_sql('frames', 'ev')}, f as (select track, (dense_rank() over (partition by track order by frame) - 1) / 16 as t, pc, v from frames), b as (select distinct track, t - min(t) over (partition by track) as t from (select (track % 10)::int as track, t from ev where kind = 'view')),
h as (select f.track, f.pc, f.v, coalesce(b.t, -1) as start from f asof left join b on f.track = b.track and f.t >= b.t) select track, pc::int as pc, round(start, 6) as start, round(avg(v), 6) as v from h group by track, h.start, pc""",
    "key_or_default": f"""with a as ({_LADDER}), b as ({_BEST}), j as (select n_nationkey as track, a.key is not null as found, a.key as ak, a.mode as am, a.confidence as ac, a.key_strength as az, b.key as bk, b.mode as bm, b.confidence as bc, b.r as br
  from nation left join (select * from a where confidence > 40) a on a.track = n_nationkey left join b on b.track = n_nationkey)
select track, case when found then ak else coalesce(bk, 'C') end as key, case when found then am else coalesce(bm, 'Major') end as mode, case when found then ac else coalesce(bc, 5.0) end::double as confidence, case when found then az else coalesce(br, 0.1) end::double as key_strength from j""",
    "key_names": f"""with a as ({_LADDER}) select track, case when key is null or key = 'None' or key like 'Unknown%' then 'C Major' else concat_ws(' ', key, mode) end as key, round(confidence, 6)::double as confidence from a""",
    "key_changes": f"""with recursive {B.SQL['ev']}, {B.SQL['chords']}, x as (select track, seq, chord as key, confidence * 100 as confidence from chords),
w as (select track, seq, key, 1 as n, confidence, null::varchar as from_key, null::varchar as to_key, 0.0::double as difference from x where seq = 0
  union all select x.track, x.seq, case when {_CHANGED} then x.key else w.key end, case when {_CHANGED} then 1 when x.key = w.key then w.n + 1 else w.n end, x.confidence,
  case when {_CHANGED} then w.key end, case when {_CHANGED} then x.key end, abs(x.confidence - w.confidence) from w join x on x.track = w.track and x.seq = w.seq + 1)
select track, seq::bigint as seq, from_key, to_key, round(confidence / 100, 6)::double as confidence, round(difference, 6)::double as difference from w where to_key is not null""",
}
