"""Queries and SQL of the key family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators import keys, series
from cadenza.sources import bindings as B


def values(name: str, columns: str, rows: list) -> str:
    """A constant table as a common table expression."""
    def lit(x) -> str:
        return f"'{x}'" if isinstance(x, str) else f"{x!r}::double" if isinstance(x, float) else str(x)

    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.gaussian_smooth(keys.chroma_mean(B.chroma_frames(spark, sf_dir)))


def chroma_mean(spark, sf_dir):
    return keys.chroma_mean(B.chroma_frames(spark, sf_dir)).select("track", "pc", *series.round6("v"))


def chroma_gaussian_smooth(spark, sf_dir):
    return smoothed(spark, sf_dir).select("track", "pc", *series.round6("v"))


def key_correlation(spark, sf_dir):
    return keys.key_correlation(smoothed(spark, sf_dir)).select("track", "key_idx", "key", "mode", *series.round6("r"))


def key_best(spark, sf_dir):
    return keys.key_best(keys.key_correlation(smoothed(spark, sf_dir))).select("track", "key", "mode", *series.round6("r", "confidence"))


def key_relative_validation(spark, sf_dir):
    chroma = smoothed(spark, sf_dir)
    scores = keys.key_correlation(chroma)
    return keys.relative_validation(keys.key_best(scores), scores, chroma).select("track", "key", "mode", *series.round6("confidence", "key_strength"))


def key_chord_driven(spark, sf_dir):
    return keys.chord_driven(smoothed(spark, sf_dir)).select("track", "key", "mode", *series.round6("confidence"))


def key_special_boost(spark, sf_dir):
    chroma = smoothed(spark, sf_dir)
    return keys.special_boost(keys.key_correlation(chroma), chroma).select("track", "key", "mode", *series.round6("confidence"))


def key_final_ladder(spark, sf_dir):
    return keys.final_ladder(smoothed(spark, sf_dir)).select("track", "key", "mode", *series.round6("confidence", "key_strength"))


def indexed_frames(spark, sf_dir) -> DataFrame:
    return B.chroma_frames(spark, sf_dir).withColumn("idx", F.dense_rank().over(Window.partitionBy("track").orderBy("frame")) - 1)


def key_modulation_windows(spark, sf_dir):
    return keys.modulation_windows(indexed_frames(spark, sf_dir)).select("track", F.col("window").cast("long").alias("window"), "from_key", "to_key", *series.round6("r"))


def chroma_moving_average(spark, sf_dir):
    return series.moving_average(B.chroma_frames(spark, sf_dir), "v", 2, ["track", "pc"], "frame").select("track", "frame", "pc", *series.round6("smoothed"))


QUERIES = [
    chroma_mean, chroma_gaussian_smooth, key_correlation, key_best, key_relative_validation,
    key_chord_driven, key_special_boost, key_final_ladder, key_modulation_windows, chroma_moving_average,
]

_TAPS = values("taps", "pc, src, w", keys.smoothing_taps())
_PROFILES = values("profiles", "key_idx, key, mode, pc, w", K.key_profiles())
_SMOOTH = f"""{_TAPS},
means as (select track, pc, avg(v) as v from frames group by track, pc),
chroma as (select m.track, t.pc, sum(m.v * t.w) as v from means m join taps t on m.pc = t.src group by m.track, t.pc)"""


def _r(source: str, by: str) -> str:
    return f"""select {by}, key_idx, key, mode, coalesce((12 * sum(v * w) - sum(v) * sum(w)) / nullif(sqrt((12 * sum(v * v) - sum(v) * sum(v)) * (12 * sum(w * w) - sum(w) * sum(w))), 0), 0) as r
  from {source} join profiles using (pc) group by {by}, key_idx, key, mode"""


_SCORES = f"{_SMOOTH},\n{_PROFILES},\nscores as ({_r('chroma', 'track')})"
_BEST = f"""{_SCORES},
best as (select track, key_idx, key, mode, r, least(1.0, r + 0.8 * (r - second)) as confidence from (
  select *, row_number() over w as rn, lead(r) over w as second from scores window w as (partition by track order by r desc, key_idx)) where rn = 1)"""
_C = "cmap as (select track, list(v order by pc) as c from chroma group by track)"
_REL = f"""{_BEST}, {_C},
relbase as (select b.*, (key_idx // 2)::int as root, (b.r + confidence) / 2 as base, ((key_idx // 2 + case mode when 'Major' then 9 else 3 end) % 12)::int as rel_root from best b),
reljoin as (select x.*, s.r as rel_r, s.key as rel_key, s.mode as rel_mode,
  (c[root + 1] + c[(root + 4) % 12 + 1] * 1.2 + c[(root + 7) % 12 + 1]) / 3.2 as up, (c[root + 1] + c[(root + 3) % 12 + 1] * 1.2 + c[(root + 7) % 12 + 1]) / 3.2 as down
  from relbase x join scores s on s.track = x.track and s.key_idx = 2 * rel_root + case x.mode when 'Major' then 1 else 0 end join cmap on cmap.track = x.track),
relfactor as (select *, case when abs(rel_r - r) < 0.1 and mode = 'Major' and down > up + 0.2 then 0.9 when abs(rel_r - r) < 0.1 and mode = 'Minor' and up > down + 0.2 then 1.1 when rel_r - r > 0.1 then 1.1 end as f from reljoin),
validated as (select track, case when f is null then key else rel_key end as key, case when f is null then mode else rel_mode end as mode, base * coalesce(f, 1.0) as confidence, base as key_strength from relfactor)"""
_ROOTS = values("roots", "root, name", list(enumerate(K.NOTES)))
_DRIVEN = f"""{_ROOTS},
options as (select track, name as key, 'Minor' as mode, 2 * root as ord, least(1.0, (c[root + 1] * 3 + c[(root + 7) % 12 + 1] * 2.5 + c[(root + 3) % 12 + 1] * 2 + c[(root + 5) % 12 + 1] * 1.5 + c[(root + 10) % 12 + 1] * 1.2) / 10.2
    * case when c[(root + 3) % 12 + 1] > 0.3 then 1.2 else 1.0 end) as s from cmap, roots
  union all select track, name, 'Major', 2 * root + 1, least(1.0, (c[root + 1] * 3 + c[(root + 7) % 12 + 1] * 2.5 + c[(root + 5) % 12 + 1] * 2 + c[(root + 9) % 12 + 1] * 1.5) / 9.0
    * case when c[(root + 4) % 12 + 1] > 0.3 then 1.1 else 1.0 end) from cmap, roots),
driven as (select track, key, mode, s as confidence from options qualify row_number() over (partition by track order by s desc, ord) = 1)"""
_SPECIALS = values("specials", "ord, key, mode, root", [(i, k, m, K.NOTES.index(k)) for i, (k, m) in enumerate(K.SPECIAL_KEYS)])
_SPECIAL = f"""{_SPECIALS},
pattern as (select m.track, p.ord, p.key, p.mode, s.r,
  case when p.mode = 'Major' then (c[p.root + 1] + c[(p.root + 4) % 12 + 1] * 1.1 + c[(p.root + 7) % 12 + 1]) / 3.1
    when p.key = 'G#' and (c[9] * 1.5 + c[7] * 1.2 + c[5] * 1.1 + c[2]) / 4.8 > 0.15 then (c[9] * 1.5 + c[7] * 1.2 + c[5] * 1.1 + c[2]) / 4.8 * 1.5 * 1.2
    else (c[p.root + 1] + c[(p.root + 3) % 12 + 1] * 1.2 + c[(p.root + 7) % 12 + 1]) / 3.2 * case when p.key = 'G#' then 1.2 else 1.0 end end as strength
  from cmap m cross join specials p join scores s on s.track = m.track and s.key = p.key and s.mode = p.mode),
special as (select track, key, mode, (strength + r) / 2 as confidence from pattern qualify row_number() over (partition by track order by (strength + r) / 2 desc, ord) = 1)"""

SQL = {
    "chroma_mean": f"{B.with_sql('frames')} select track, pc::int as pc, round(avg(v), 6) as v from frames group by track, pc",
    "chroma_gaussian_smooth": f"{B.with_sql('frames')}, {_SMOOTH} select track, pc, round(v, 6) as v from chroma",
    "key_correlation": f"{B.with_sql('frames')}, {_SCORES} select track, key_idx, key, mode, round(r, 6) as r from scores",
    "key_best": f"{B.with_sql('frames')}, {_BEST} select track, key, mode, round(r, 6) as r, round(confidence, 6) as confidence from best",
    "key_relative_validation": f"{B.with_sql('frames')}, {_REL} select track, key, mode, round(confidence, 6) as confidence, round(key_strength, 6) as key_strength from validated",
    "key_chord_driven": f"{B.with_sql('frames')}, {_SMOOTH}, {_C}, {_DRIVEN} select track, key, mode, round(confidence, 6) as confidence from driven",
    "key_special_boost": f"{B.with_sql('frames')}, {_SCORES}, {_C}, {_SPECIAL} select track, key, mode, round(confidence, 6) as confidence from special",
    "key_final_ladder": f"""{B.with_sql('frames')}, {_REL}, {_DRIVEN}, {_SPECIAL},
s1 as (select v.track, v.key_strength, case when d.confidence > 0.5 and d.confidence > v.confidence then d.key else v.key end as key,
  case when d.confidence > 0.5 and d.confidence > v.confidence then d.mode else v.mode end as mode,
  case when d.confidence > 0.5 and d.confidence > v.confidence then d.confidence else v.confidence end as conf from validated v join driven d using (track)),
s2 as (select s1.track, key_strength, case when p.confidence > 0.25 or p.confidence > conf * 0.8 then p.key else s1.key end as key,
  case when p.confidence > 0.25 or p.confidence > conf * 0.8 then p.mode else s1.mode end as mode,
  case when p.confidence > 0.25 or p.confidence > conf * 0.8 then p.confidence else conf end as conf from s1 join special p using (track)),
s3 as (select s2.*, sc.key as rel_key, sc.r as rel_r from s2 left join roots on roots.name = s2.key left join scores sc on sc.track = s2.track and sc.key_idx = 2 * ((root + 3) % 12)),
s4 as (select track, key_strength, mode = 'Minor' and rel_r > 0 and abs(conf - rel_r) < 0.08 as flip, key, mode, conf, rel_r, case rel_key when 'D#' then 'Eb' when 'G#' then 'Ab' when 'A#' then 'Bb' else rel_key end as flat from s3),
s5 as (select track, key_strength, case when flip then flat else key end as key, case when flip then 'Major' else mode end as mode, case when flip then rel_r else conf end as conf from s4)
select track, case when conf < 0.15 then 'Unknown(' || key || '?)' else key end as key, case when conf < 0.15 then 'Unknown' else mode end as mode, round(conf * 100, 6) as confidence, round(key_strength, 6) as key_strength from s5""",
    "key_modulation_windows": f"""{B.with_sql('frames')}, {_PROFILES},
idx as (select *, dense_rank() over (partition by track order by frame) - 1 as i from frames),
lens as (select track, max(i) + 1 as n from idx group by track),
wins as (select track, unnest(range(0, n - 16 + 1, 8)) as start from lens where n >= 16),
means as (select w.track, w.start // 8 as win, pc, avg(v) as v from wins w join idx on idx.track = w.track and i >= start and i < start + 16 group by all),
scores as ({_r('means', 'track, win')}),
best as (select * from scores qualify row_number() over (partition by track, win order by r desc, key_idx) = 1),
seq as (select track, win, key || ' ' || mode as to_key, lag(key || ' ' || mode) over (partition by track order by win) as from_key, r from best)
select track, win::bigint as "window", from_key, to_key, round(r, 6) as r from seq where from_key <> to_key""",
    "chroma_moving_average": f"{B.with_sql('frames')} select track, frame, pc::int as pc, round(avg(v) over (partition by track, pc order by frame rows between 2 preceding and 2 following), 6) as smoothed from frames",
}
