"""Queries and SQL of the rhythm family."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators import rhythm as R
from cadenza.operators.series import round6
from cadenza.plans.keys import values
from cadenza.sources import bindings as B


def _both(spark, sf_dir):
    return B.onsets(spark, sf_dir), B.beats(spark, sf_dir)


def rhythm_nearest_beat(spark, sf_dir):
    rows = R.matched(*_both(spark, sf_dir))
    return rows.select("track", "event_id", F.col("beat").cast("long").alias("beat"), F.round(F.abs(F.col("t") - F.col("right_t")), 6).alias("distance"))


def rhythm_complexity(spark, sf_dir):
    return R.complexity(*_both(spark, sf_dir)).select("track", *round6("complexity"))


def rhythm_syncopation(spark, sf_dir):
    return R.syncopation(*_both(spark, sf_dir)).select("track", "strong", "weak", "off", *round6("ratio"))


def rhythm_regularity(spark, sf_dir):
    return R.regularity(*_both(spark, sf_dir)).select("track", *round6("regularity"))


def rhythm_subdivision(spark, sf_dir):
    return R.subdivision(*_both(spark, sf_dir)).select("track", *round6("density"))


def rhythm_swing(spark, sf_dir):
    return R.swing(*_both(spark, sf_dir)).select("track", *round6("swing"))


def rhythm_groove(spark, sf_dir):
    return R.groove(*_both(spark, sf_dir)).select("track", "groove", *round6("confidence"))


def rhythm_time_signature(spark, sf_dir):
    return R.time_signature(B.beats(spark, sf_dir)).select("track", "signature", *round6("confidence"))


QUERIES = [rhythm_nearest_beat, rhythm_complexity, rhythm_syncopation, rhythm_regularity, rhythm_subdivision, rhythm_swing, rhythm_groove, rhythm_time_signature]

_EV = f"""{B.with_sql('ev')},
beats as (select track, event_id, t, value, row_number() over w - 1 as beat, lead(t) over w as next_t from ev where kind = 'view' window w as (partition by track order by t, event_id)),
onsets as (select track, event_id, t from ev where kind <> 'view'),
counts as (select track, count(*) filter (kind <> 'view') as n_onsets, count(*) filter (kind = 'view') as n_beats, min(t) filter (kind = 'view') as first_beat, max(t) filter (kind = 'view') as last_beat from ev group by track)"""
_NEAR = f"""{_EV},
near as (select o.track, o.event_id, o.t, b.t as right_t, b.beat, b.next_t from onsets o join beats b using (track) qualify row_number() over (partition by o.track, o.event_id order by abs(o.t - b.t), b.t) = 1)"""
_SWING = f"""{_EV},
held as (select o.track, (o.t - b.t) / (b.next_t - b.t) as p from onsets o join beats b on o.track = b.track and o.t >= b.t and o.t < b.next_t),
sides as (select track, abs(p - 0.33) < 0.1 or abs(p - 0.67) < 0.1 as sw, abs(p - 0.25) < 0.1 or abs(p - 0.5) < 0.1 or abs(p - 0.75) < 0.1 as st from held),
found as (select track, count(*) as n, count(*) filter (sw) as sw, count(*) filter (not sw and st) as st from sides group by track),
swings as (select c.track, n_onsets, n_beats, case when coalesce(n, 0) < 4 then 0.5 else coalesce(0.5 + (sw - st) / nullif((sw + st) * 2, 0), 0.5) end::double as swing from counts c left join found using (track))"""
_PLACES = values("places", "ord, signature, measure, place, strong", [(o, n, m, i, int(i in s)) for o, (n, m, s) in enumerate(K.TIME_SIGNATURES) for i in range(m)])
SQL = {
    "rhythm_nearest_beat": f"{_NEAR} select track, event_id, beat, round(abs(t - right_t), 6) as distance from near",
    "rhythm_complexity": f"""{_NEAR},
pos as (select track, case when next_t is null then 0.0 else (t - right_t) / (next_t - right_t) end as p from near),
bins as (select track, least(floor(p * 8), 7) as bin, count(*) as n from pos where p between 0 and 1 group by all),
every as (select track, b.bin, coalesce(n, 0) as n from (select distinct track from bins) cross join range(0, 8) as b(bin) left join bins using (track, bin)),
shares as (select track, (n / sum(n) over (partition by track) + 1e-8) / (1 + 8e-8) as s from every),
ent as (select track, -sum(s * ln(s)) as e from shares group by track)
select c.track, round((least(1.0, case when last_beat > first_beat then n_onsets / (last_beat - first_beat) else 0 end / 10) + coalesce(e, 0) / ln(8)) / 2, 6) as complexity
from counts c left join ent using (track) where n_beats >= 2 and n_onsets >= 1""",
    "rhythm_syncopation": f"""{_NEAR}, k as (select track, abs(t - right_t) < 0.1 as tight, beat % 4 = 0 as heavy from near)
select track, count(*) filter (tight and heavy) as strong, count(*) filter (tight and not heavy) as weak, count(*) filter (not tight) as off, round((count(*) - count(*) filter (tight and heavy)) / count(*), 6) as ratio from k group by track""",
    "rhythm_regularity": f"""{_EV}, g as (select track, lead(t) over (partition by track order by t, event_id) - t as gap from onsets), s as (select track, stddev_pop(gap) as sd, avg(gap) as mean from g group by track)
select c.track, round(case when n_onsets < 4 or n_beats < 4 then 0.0 else coalesce(least(1.0, exp(-2 * sd / nullif(mean, 0))), 0.0) end, 6)::double as regularity from counts c left join s using (track)""",
    "rhythm_subdivision": f"{_EV} select track, round(case when n_beats < 2 then 0.0 else least(1.0, n_onsets / n_beats / 8) end, 6)::double as density from counts",
    "rhythm_swing": f"{_SWING} select track, round(swing, 6) as swing from swings",
    "rhythm_groove": f"""{_SWING} select track, case when n_beats < 4 or n_onsets < 8 then 'straight' when swing > 0.6 then 'swing' when swing > 0.55 then 'shuffle' else 'straight' end as groove,
  round(least(1.0, case when n_beats < 4 or n_onsets < 8 then 0.0 when swing > 0.6 then (swing - 0.6) / 0.3 when swing > 0.55 then (swing - 0.55) / 0.1 else (0.55 - swing) / 0.05 end), 6)::double as confidence from swings""",
    "rhythm_time_signature": f"""{_EV}, {_PLACES}, sizes as (select track, count(*) as n from beats group by track),
each as (select b.track, n, ord, signature, measure, place, strong, beat // measure as m, next_t - t as gap, value from beats b join sizes using (track) join places on beat % measure = place),
per as (select track, n, ord, signature, measure, place, strong, var_pop(gap) filter (gap is not null and m < (n - 1) // measure) as v, sum(value) filter (m < n // measure) as loud, count(*) filter (m < n // measure) as k from each group by all),
agg as (select track, n, ord, signature, measure, avg(v) as v, sum(loud) filter (strong = 1) / nullif(sum(k) filter (strong = 1), 0) as s, sum(loud) filter (strong = 0) / nullif(sum(k) filter (strong = 0), 0) as w from per group by all),
emph as (select *, case when n // measure < 2 or s is null or w is null then 0.0 when w = 0 then (s > 0)::int else greatest(0.0, least(1.0, (s / w - 1) / 2 + 0.5)) end as e from agg),
sc as (select *, case when (n - 1) // measure < 2 then 0.0 else least(1.0, (exp(-10 * v) + e) / 2) end + case when ord = 0 then 0.3 else 0.0 end as score from emph),
best as (select * from sc where score > case when ord = 0 then 0.6 when signature in ('3/4', '2/4') then 0.8 else 0.9 end qualify row_number() over (partition by track order by score desc, ord) = 1)
select z.track, case when z.n < 8 then '4/4' else coalesce(signature, '4/4') end as signature, round(case when z.n < 8 then 0.5 else least(1.0, coalesce(score, 0.6)) end, 6)::double as confidence from sizes z left join best b using (track)""",
}
