"""Queries and SQL that join several families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import dynamics as D
from cadenza.operators import harmony as H
from cadenza.operators import keys
from cadenza.operators import melody as M
from cadenza.operators import report as P
from cadenza.operators import structure as T
from cadenza.operators.series import round6
from cadenza.plans import keys as key_plans
from cadenza.plans import sound, structures
from cadenza.sources import bindings as B


def labelled_sections(spark, sf_dir) -> DataFrame:
    """Sections with their base label by energy, a complexity and a harmonic share."""
    rows = T.in_order(B.sections(spark, sf_dir)).select("track", "seq", "t", "type", "energy", "event_id")
    base = T.energy_class(B.sections(spark, sf_dir)).select("track", "seq", F.col("label").alias("base"))
    joined = rows.join(base, ["track", "seq"])
    return joined.withColumn("complexity", (F.col("event_id") % 10) / 10.0).withColumn("harmonic", (F.col("event_id") % 7) / 7.0)


def section_context_fold(spark, sf_dir):
    return T.context_fold(labelled_sections(spark, sf_dir))


def section_pairing(spark, sf_dir):
    return T.pairing(labelled_sections(spark, sf_dir)).select("track", F.col("seq").cast("long").alias("seq"), "base", "label")


def section_drop_chorus(spark, sf_dir):
    rows = T.in_order(B.sections(spark, sf_dir)).withColumn("level", 20 * F.log10(F.col("energy") + 1e-6))
    moves = B.events(spark, sf_dir).filter("kind = 'error'").select("track", "t", (F.col("event_id") % 12).alias("shift"))
    return T.drop_choruses(rows.select("track", "seq", "t", "type", "level"), moves).select("track", F.col("seq").cast("long").alias("seq"), "type", "label", "shift", *round6("z"))


def key_hint_lookup(spark, sf_dir):
    names = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("track"), F.col("n_name").alias("name"))
    hints = F.array(*[F.lit(h) for h in ("A minor", "Bb Maj", "f♯m", "E♭ major", "c", "H dur", "d#-min")])
    return keys.key_hints(names.select("track", F.element_at(hints, F.pmod("track", F.lit(7)).cast("int") + 1).alias("hint")))


def dynamics_tension(spark, sf_dir):
    return D.tension_curve(B.energy(spark, sf_dir)).select("track", F.col("idx").cast("long").alias("idx"), "kind", *round6("tension"))


def dynamics_climax(spark, sf_dir):
    return D.climax(B.energy(spark, sf_dir)).select("track", "idx", "main", *round6("intensity"))


def timbre_texture(spark, sf_dir):
    return D.texture(B.energy(spark, sf_dir, "track")).select("track", *round6("fullness", "smoothness", "activity"))


def combined_sophistication(spark, sf_dir):
    notes, frames = B.melody(spark, sf_dir), B.chroma_frames(spark, sf_dir)
    coverage = notes.groupBy("track").agg(F.avg(F.col("voiced").cast("int")).alias("coverage"))
    variety = M.intervals(notes).groupBy("track").agg((F.count("*") / 12).alias("variety"))
    melody = M.direction(notes).select("track", F.col("complexity").alias("contour")).join(variety, "track").join(M.pitch_range(notes).select("track", "octaves"), "track").join(coverage, "track")
    best = keys.key_best(keys.key_correlation(keys.gaussian_smooth(keys.chroma_mean(frames)))).select("track", F.col("confidence").alias("key_confidence"))
    harmony = H.complexity(frames).select("track", "complexity").join(H.consonance(frames).select("track", "consonance"), "track").join(H.rhythm(frames).select("track", "rate"), "track").join(best, "track")
    found = keys.sophistication(melody.withColumn("h", F.pmod("track", F.lit(10)).cast("int")), harmony.withColumnRenamed("track", "h"))
    return found.select("track", *round6("balance", "overall", "sophistication"))


def display_scalars(spark, sf_dir):
    rows = structures.attributes(spark, sf_dir)
    seconds = F.col("energy") * 500
    return rows.select("track", P.clock(seconds).alias("length"), P.bars(seconds, F.col("bpm")).alias("bars"), P.level(F.col("brightness")).alias("level"))


QUERIES = [section_context_fold, section_pairing, section_drop_chorus, key_hint_lookup, dynamics_tension, dynamics_climax, timbre_texture, combined_sophistication, display_scalars]

_E = B.with_sql("ev")
_SM = sound._SMOOTH
_CLASS = structures.SQL["section_energy_class"]
_LAB = f"""with cls as ({_CLASS}), ev2 as (select user_id as track, event_id, value, epoch_us(ts) / 691200000000.0 as t from events),
lab as (select e.track, c.seq, c.label as base, e.energy, (e.event_id % 10) / 10 as complexity, (e.event_id % 7) / 7 as harmonic from (select *, row_number() over (partition by track order by t, event_id) - 1 as seq, value / max(value) over (partition by track) as energy from ev2) e join cls c on c.track = e.track and c.seq = e.seq)"""
_RULES = """case when x.seq = 0 and x.energy < 0.4 then 'intro'
  when x.seq > 0 and x.base in ('verse', 'bridge') and (x.energy > {e} * 1.5 or (x.energy > {e} * 1.1 and x.complexity > {c} * 1.05)) then 'pre_chorus'
  when x.seq > 0 and {l} = 'pre_chorus' and (x.base = 'pre_chorus' or (x.base = 'verse' and x.energy > 0.5 and x.complexity > 0.6)) then case when x.energy > 0.6 then 'chorus' else 'verse' end
  when x.base = 'bridge' and (x.complexity < 0.6 or x.harmonic < 0.3) then 'verse' else x.base end"""
_HINTS = ["A minor", "Bb Maj", "f♯m", "E♭ major", "c", "H dur", "d#-min"]
_MEANT = [("A", "Minor"), ("Bb", "Major"), ("F#", "Minor"), ("Eb", "Major"), ("C", "Major"), (None, None), ("D#", "Minor")]
_CASE = {k: "case n_nationkey % 7 " + " ".join(f"when {i} then {repr(v) if v else 'null'}" for i, v in enumerate(vs)) + " end" for k, vs in (("hint", _HINTS), ("key", [a for a, _ in _MEANT]), ("mode", [b for _, b in _MEANT]))}
SQL = {
    "section_context_fold": f"""{_LAB.replace('with ', 'with recursive ', 1)},
w as (select x.track, x.seq, x.energy, x.complexity, {_RULES.format(e='0.0', c='0.0', l="''")} as label from lab x where x.seq = 0
  union all select x.track, x.seq, x.energy, x.complexity, {_RULES.format(e='w.energy', c='w.complexity', l='w.label')} from w join lab x on x.track = w.track and x.seq = w.seq + 1)
select track, seq, label from w""",
    "section_pairing": f"""{_LAB}, n as (select *, coalesce(lag(energy) over w, 0) as b, lead(energy) over w as a from lab window w as (partition by track order by seq))
select track, seq, base, case when base = 'pre_chorus' then case when a is null or a > energy * 1.3 then 'pre_chorus' else 'verse' end
  when base = 'chorus' and energy > 0.6 and b < energy * 0.7 and coalesce(a, 0) < energy * 0.7 and complexity < 0.6 then 'verse' else base end as label from n""",
    "section_drop_chorus": f"""{structures._SEC}, s as (select *, lead(t) over (partition by track order by t, event_id) as e, 20 * log10(energy + 1e-6) as level from so),
m as (select track, t, event_id % 12 as shift from ev where kind = 'error'),
f as (select s.track, s.seq, arg_min(m.shift, m.t) as shift from s join m on m.track = s.track and m.t >= s.t and (m.t < s.e or s.e is null) group by all),
z as (select s.*, coalesce(case when f.shift > 6 then f.shift - 12 else f.shift end, 0) as shift, case when n < 2 or stddev_pop(level) over (partition by s.track) = 0 then 0 else (level - avg(level) over (partition by s.track)) / stddev_pop(level) over (partition by s.track) end as z from s left join f on f.track = s.track and f.seq = s.seq)
select track, seq, type, case when type = 'chorus' and (level <= -50 or (shift <> 0 and (level <= -20 or z < -1))) then 'drop_chorus' else type end as label, shift::bigint as shift, round(z, 6) as z from z""",
    "key_hint_lookup": f"select n_nationkey as track, {_CASE['hint']} as hint, {_CASE['key']} as key, {_CASE['mode']} as mode from nation",
    "dynamics_tension": f"""{_E}, {_SM}, x as (select track, idx, round(greatest(0.0, least(1.0, s / max(s) over (partition by track))), 9) as tension from sm),
y as (select *, lag(tension) over w as b, lead(tension) over w as a from x window w as (partition by track order by idx))
select track, idx::bigint as idx, case when tension > b and tension > a then 'peak' when tension < b and tension < a then 'valley' end as kind, round(tension, 6)::double as tension from y""",
    "timbre_texture": f"{_E}, s as (select track, avg(value) as m, stddev_pop(value) as sd, max(value) as top from ev group by track) select track, round(least(1.0, m / top * 10), 6)::double as fullness, round(1 - m / top, 6) as smoothness, round(least(1.0, sd / m), 6)::double as activity from s",
    "combined_sophistication": f"""with best as ({key_plans.SQL['key_best'].replace('round(confidence, 6)', 'confidence')}), comp as ({sound.SQL['harmony_complexity'].replace('round(case', '(case').replace('end, 6) as complexity', 'end) as complexity')}),
cons as ({sound.SQL['harmony_consonance'].replace('round(level, 6)::double', 'level')}), rate as ({sound.SQL['harmony_rhythm'].replace('round(c / (n + 1), 6)', 'c / (n + 1)')}),
dir as ({sound.SQL['melody_direction'].replace('round(turns / n, 6)', 'turns / n')}), ints as (select track, count(*) / 12 as variety from ({sound.SQL['melody_intervals']}) group by track),
rng as ({sound.SQL['melody_range'].replace('round((high - low) / 12, 6)', '(high - low) / 12')}), cov as (select user_id as track, avg((event_type <> 'error')::int) as coverage from events group by all),
j as (select d.track, d.complexity as contour, variety, octaves, coverage, c.complexity, consonance, rate, confidence as kc from dir d join ints using (track) join rng using (track) join cov using (track)
  join comp c on c.track = d.track % 10 join cons on cons.track = d.track % 10 join rate on rate.track = d.track % 10 join best on best.track = d.track % 10),
s as (select *, octaves * 0.15 + contour * 0.2 + variety * 0.15 + complexity * 0.2 + abs(0.5 - consonance) * 0.1 + least(1.0, rate / 5) * 0.1 + kc * 0.1 as terms from j)
select track, round(coalesce(least(contour, complexity) / nullif(greatest(contour, complexity), 0), 0.5), 6) as balance, round(least(1.0, contour * 0.4 + complexity * 0.4 + variety * 0.2), 6)::double as overall,
  round(case when coverage < 0.3 or kc < 0.3 then least(0.3, coverage * kc) else least(1.0, terms * least(1.0, (coverage + kc) / 2)) end, 6)::double as sophistication from s""",
    "display_scalars": f"""with {structures._ATTR}, s as (select *, energy * 500 as sec from a)
select track, floor(sec / 60)::int || ':' || lpad((floor(sec % 60)::int)::varchar, 2, '0') as length, round_even(sec / (240 / bpm), 0)::bigint as bars, case when brightness < 0.33 then 'low' when brightness < 0.67 then 'mid' else 'high' end as level from s""",
}
