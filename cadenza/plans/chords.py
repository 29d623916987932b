"""Queries and SQL of the chord and tempo families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators import chords as C
from cadenza.operators import series, tempo
from cadenza.plans.keys import indexed_frames, values
from cadenza.sources import bindings as B


def sequence(spark, sf_dir) -> DataFrame:
    rows = series.indexed(B.chords(spark, sf_dir)).withColumn("seq", F.col("idx").cast("int"))
    return rows.select("track", "seq", "chord", "confidence", F.col("seq").alias("start"), (F.col("seq") + 1).alias("end"))


def matched(spark, sf_dir) -> DataFrame:
    """Chords matched from the frames, which wander through more keys than the events' chords."""
    rows = C.template_match(indexed_frames(spark, sf_dir), "track", "idx")
    return rows.select("track", F.col("idx").alias("seq"), "chord")


def tempo_histogram_topk(spark, sf_dir):
    return tempo.histogram_topk(B.tempo_votes(spark, sf_dir)).select("track", "bpm", "votes", F.col("rank").cast("long").alias("rank"))


def tempo_harmonic_clusters(spark, sf_dir):
    found = tempo.harmonic_clusters(tempo.histogram_topk(B.tempo_votes(spark, sf_dir)))
    return found.select("track", F.col("rank").cast("long").alias("rank"), "bpm", "votes", "base")


def tempo_smart_choice(spark, sf_dir):
    found = tempo.smart_choice(tempo.harmonic_clusters(tempo.histogram_topk(B.tempo_votes(spark, sf_dir))))
    return found.select("track", "bpm", *series.round6("confidence"))


def chord_hop_windows(spark, sf_dir):
    rows = series.hop_windows(indexed_frames(spark, sf_dir), "idx", 8, 2, "track")
    return rows.groupBy("track", "start", "pc").agg(F.avg("v").alias("v")).select("track", F.col("start").cast("long").alias("start"), "pc", *series.round6("v"))


def chord_template_match(spark, sf_dir):
    return C.template_match(B.chroma_frames(spark, sf_dir), "track", "frame").select("track", "frame", "chord", *series.round6("confidence"))


def chord_confident(spark, sf_dir):
    found = C.confident(C.template_match(B.chroma_frames(spark, sf_dir), "track", "frame"))
    return found.groupBy("track", "chord").agg(F.count("*").alias("n"))


def chord_runs(spark, sf_dir):
    found = C.merged_runs(sequence(spark, sf_dir))
    return found.select("track", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "chord", "n", *series.round6("confidence"))


def chord_progression_stats(spark, sf_dir):
    return C.progression_stats(sequence(spark, sf_dir)).select("track", "n_distinct", "n_changes", *series.round6("harmonic_rhythm", "complexity"))


def chord_main_progression(spark, sf_dir):
    return C.main_progression(sequence(spark, sf_dir))


def chord_roman_numerals(spark, sf_dir):
    rows = sequence(spark, sf_dir)
    numerals = [C.roman(F.col("chord"), F.lit(r), F.lit(m)).alias(n) for n, r, m in (("in_c_major", 0, "Major"), ("in_a_minor", 9, "Minor"), ("in_d_major", 2, "Major"))]
    return rows.select("track", "seq", "chord", *numerals)


def chord_local_key(spark, sf_dir):
    return C.local_key(matched(spark, sf_dir), "track").select("track", "key", "n", *series.round6("fit"))


def chord_modulations(spark, sf_dir):
    return C.modulations(matched(spark, sf_dir)).select("track", F.col("window").cast("long").alias("window"), "from_key", "to_key")


def chord_substitute_ratio(spark, sf_dir):
    rows = C.template_match(B.chroma_frames(spark, sf_dir), "track", "frame")
    return C.substitute_ratio(rows).select("track", *series.round6("ratio"))


QUERIES = [
    tempo_histogram_topk, tempo_harmonic_clusters, tempo_smart_choice, chord_hop_windows, chord_template_match, chord_confident, chord_runs,
    chord_progression_stats, chord_main_progression, chord_roman_numerals, chord_local_key, chord_modulations, chord_substitute_ratio,
]

_HIST = """votes as (select event_type as track, least(floor((value - 40.0) / 0.5), 520)::bigint as bin from events where value between 40 and 300),
counted as (select track, bin, count(*) as votes from votes group by all),
hist as (select t.track, 40.0::double + b.bin * 0.5::double as bpm, coalesce(c.votes, 0)::bigint as votes, row_number() over (partition by t.track order by coalesce(c.votes, 0) desc, b.bin desc) as rank
  from (select distinct track from votes) t cross join range(0, 521) as b(bin) left join counted c on c.track = t.track and c.bin = b.bin
  qualify rank <= 10)"""
_RATIO = " or ".join(f"abs(h.bpm / b - {k!r}::double) < 0.05 or abs(h.bpm / b - {1 / k!r}::double) < 0.05" for k in K.HARMONIC_RATIOS)
_CLUSTERS = f"""{_HIST},
grown as (
  select track, 1::bigint as rank, bpm, votes, bpm as base, [bpm] as bases from hist where rank = 1
  union all
  select h.track, h.rank, h.bpm, h.votes, coalesce(list_filter(g.bases, lambda b: {_RATIO})[1], h.bpm),
    case when len(list_filter(g.bases, lambda b: {_RATIO})) > 0 then g.bases else list_append(g.bases, h.bpm) end
  from grown g join hist h on h.track = g.track and h.rank = g.rank + 1)"""
_TEMPLATES = values("templates", "ord, chord, kind, pc", K.chord_templates())
_NOTES = "[" + ", ".join(f"'{n}'" for n in K.NOTES) + "]"
_NUMERALS = "[" + ", ".join(f"'{n}'" for n in K.NUMERALS) + "]"
_MATCH = f"""{_TEMPLATES},
norms as (select track, frame, sqrt(sum(v * v)) as norm, max(v) as peak from frames group by all),
sims as (select track, frame, ord, chord, kind, sum(v) / sqrt(count(*)) / norm as sim from frames join templates using (pc) join norms using (track, frame) group by track, frame, ord, chord, kind, norm),
tops as (select * from sims qualify row_number() over (partition by track, frame, kind order by sim desc, ord) = 1),
best as (select a.track, a.frame, case when b.sim > a.sim + 0.15 then b.chord else a.chord end as chord, case when b.sim > a.sim + 0.15 then b.sim else a.sim end as sim
  from tops a join tops b using (track, frame) where a.kind = 'triad' and b.kind = 'tetrad'),
ranked as (select *, row_number() over (partition by track, frame order by v desc, pc desc) as rk from frames),
three as (select track, frame, avg(v) as strength, list(pc::int order by rk) as p from ranked where rk between 2 and 4 group by all),
named as (select track, frame, strength, list_filter(list_transform(p, lambda r: case when list_contains(p, ((r + 4) % 12)::int) and list_contains(p, ((r + 7) % 12)::int) then {_NOTES}[r + 1]
  when list_contains(p, ((r + 3) % 12)::int) and list_contains(p, ((r + 7) % 12)::int) then {_NOTES}[r + 1] || 'm' end), lambda x: x is not null)[1] as cluster from three),
matches as (select track, frame, peak, case when peak < 0.1 then 'N' when cluster is not null and strength > sim * 0.8 then cluster else chord end as chord,
  case when peak < 0.1 then 0.0 when cluster is not null and strength > sim * 0.8 then strength else greatest(0.0, sim) end as confidence from best join named using (track, frame) join norms using (track, frame))"""


def _roman(root: str, mode: str) -> str:
    name = f"{_NUMERALS}[((list_position({_NOTES}, regexp_extract(chord, '^([A-G]#?)', 1)) - 1 - {root} + 24) % 12 + 1)::int]"
    minor = f"case when not contains(chord, 'm') then upper({name}) when {name} = 'I' then 'i' when {name} = 'IV' then 'iv' else {name} end"
    major = f"case when contains(chord, 'm') then lower({name}) else {name} end"
    shaped = {"Major": major, "Minor": minor}.get(mode) or f"case when {mode} = 'Major' then {major} else {minor} end"
    return f"case when chord = 'N' then 'N' when coalesce(list_position({_NOTES}, regexp_extract(chord, '^([A-G]#?)', 1)), 0) = 0 then '?' else {shaped} end"


_KEYS = values("keyset", "key_idx, key_root, mode, key", [(2 * r + k, r, m, f"{K.NOTES[r]} {m}") for r in range(12) for k, m in enumerate(("Major", "Minor"))])


def _local(source: str, by: str) -> str:
    numeral = f"lower({_roman('key_root', 'mode')})"
    fits = f"case when mode = 'Major' then {numeral} in ('i', 'ii', 'iii', 'iv', 'v', 'vi') else {numeral} in ('i', 'iii', 'iv', 'v', 'vi', 'vii') end"
    return f"""scored as (select {by}, key_idx, key, avg(({fits})::int) as fit, count(*) as n from {source} cross join keyset where chord <> 'N' group by {by}, key_idx, key),
local as (select {by}, case when fit > 0.5 then key end as key, fit, n from scored qualify row_number() over (partition by {by} order by fit desc, key_idx) = 1)"""


_CH = B.with_sql("ev", "chords")
SQL = {
    "tempo_histogram_topk": f"with {_HIST} select * from hist",
    "tempo_harmonic_clusters": f"with recursive {_CLUSTERS} select track, rank, bpm, votes, base from grown",
    "tempo_smart_choice": f"""with recursive {_CLUSTERS},
sums as (select track, base, sum(votes) as total, min(rank) as first, arg_max(bpm, votes * 1000 - rank) as top from grown group by all),
placed as (select *, sum(total) over (partition by track) as everything, first_value(base) over (partition by track order by total desc, first) as chosen, first_value(top) over (partition by track order by total desc, first) as low,
  first_value(total) over (partition by track order by total desc, first) as low_total from sums),
high as (select * from placed where base > chosen qualify row_number() over (partition by track order by total desc, first) = 1),
one as (select distinct track, low, low_total, everything from placed)
select o.track, case when h.total / o.everything >= 0.15 then h.base else o.low end as bpm,
  round(case when h.total / o.everything >= 0.15 then 100.0 * h.total / o.everything else 100.0 * o.low_total / o.everything end, 6)::double as confidence from one o left join high h using (track)""",
    "chord_hop_windows": f"""{B.with_sql('frames')}, idx as (select *, dense_rank() over (partition by track order by frame) - 1 as i from frames),
lens as (select track, max(i) + 1 as n from idx group by track), wins as (select track, unnest(range(0, n - 8 + 1, 2)) as start from lens where n >= 8)
select w.track, w.start::bigint as start, pc::int as pc, round(avg(v), 6) as v from wins w join idx on idx.track = w.track and i >= start and i < start + 8 group by all""",
    "chord_template_match": f"{B.with_sql('frames')}, {_MATCH} select track, frame, chord, round(confidence, 6) as confidence from matches",
    "chord_confident": f"{B.with_sql('frames')}, {_MATCH} select track, chord, count(*) as n from matches where confidence > greatest(0.3, 0.55 - (1 - peak) * 0.2) group by all",
    "chord_runs": f"""{_CH}, flagged as (select *, case when chord = lag(chord) over w and least(confidence, lag(confidence) over w) > 0.5 then 0 else 1 end as brk from chords window w as (partition by track order by seq)),
runs as (select *, sum(brk) over (partition by track order by seq) as island from flagged)
select track, min(seq)::bigint as start, (max(seq) + 1)::bigint as "end", any_value(chord) as chord, count(*) as n, round(max(confidence), 6) as confidence from runs group by track, island""",
    "chord_progression_stats": f"""{_CH}, c as (select *, lag(chord) over (partition by track order by seq) as p from chords)
select track, count(distinct chord) as n_distinct, coalesce(sum((chord <> p)::int), 0)::bigint as n_changes, 1.0::double as harmonic_rhythm, round(least(1.0, count(distinct chord) / 12), 6)::double as complexity from c group by track""",
    "chord_main_progression": f"""{_CH}, g as (select track, seq, chord as a, lead(chord) over w as b, lead(chord, 2) over w as c, lead(chord, 3) over w as d from chords window w as (partition by track order by seq)),
n as (select track, a, b, c, d, count(*) as n, min(seq) as first, len(list_distinct([a, b, c, d])) as k from g where d is not null group by all),
s as (select *, case when k >= 2 then n + 2 * k else floor(n * 0.01) end::bigint as score from n)
select track, a || ' ' || b || ' ' || c || ' ' || d as progression, n, score from s qualify row_number() over (partition by track order by score desc, first) = 1""",
    "chord_roman_numerals": f"{_CH} select track, seq, chord, {_roman('0', 'Major')} as in_c_major, {_roman('9', 'Minor')} as in_a_minor, {_roman('2', 'Major')} as in_d_major from chords",
    "chord_local_key": f"{B.with_sql('frames')}, {_MATCH}, {_KEYS}, {_local('matches', 'track')} select track, key, n, round(fit, 6) as fit from local",
    "chord_modulations": f"""{B.with_sql('frames')}, {_MATCH}, {_KEYS}, mseq as (select track, chord, row_number() over (partition by track order by frame) - 1 as seq from matches),
lens as (select track, max(seq) + 1 as n from mseq group by track), wins as (select track, unnest(range(0, n - 8 + 1, 4)) as start from lens where n >= 8),
wc as (select w.track, w.start // 4 as win, c.chord from wins w join mseq c on c.track = w.track and c.seq >= w.start and c.seq < w.start + 8), {_local('wc', 'track, win')},
kept as (select *, coalesce(lag(key) over (partition by track order by win), 'C Major') as from_key from local where n >= 4 and key is not null)
select track, win::bigint as "window", from_key, key as to_key from kept where key <> from_key""",
    "chord_substitute_ratio": f"{B.with_sql('frames')}, {_MATCH} select track, round(avg(regexp_matches(chord, '7|9|11|13|sus|add|dim|aug')::int), 6) as ratio from matches group by track",
}
