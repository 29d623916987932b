"""Queries and SQL of the structure, similarity and report families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import constants as K
from cadenza.operators import report as P
from cadenza.operators import similarity as S
from cadenza.operators import structure as T
from cadenza.operators.series import round6
from cadenza.plans.keys import indexed_frames
from cadenza.session import table
from cadenza.sources import bindings as B


def frame_vectors(spark, sf_dir) -> DataFrame:
    """track, idx and v, the unit vector of each frame."""
    rows = indexed_frames(spark, sf_dir)
    return rows.groupBy("track", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "v"))), lambda x: x["v"]).alias("v"))  # twelve entries


def ssm_band(spark, sf_dir):
    return T.ssm_band(frame_vectors(spark, sf_dir), 8).select("track", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *round6("sim"))


def novelty(spark, sf_dir):
    return T.novelty(frame_vectors(spark, sf_dir), 4).select("track", F.col("at").cast("long").alias("at"), *round6("novelty"))


def boundary_peaks(spark, sf_dir):
    return T.boundary_peaks(T.novelty(frame_vectors(spark, sf_dir), 4))


def boundary_snap(spark, sf_dir):
    rows = B.sections(spark, sf_dir).select("track", "t")
    return T.snapped(rows, 0.125, 0.5)


def repetition_pairs(spark, sf_dir):
    return T.repetition_pairs(frame_vectors(spark, sf_dir), 6, 1, 6, 0.45).select("track", "i", "j", *round6("similarity"))


def repetition_greedy(spark, sf_dir):
    return T.without_overlap(T.repetition_pairs(frame_vectors(spark, sf_dir), 6, 1, 6, 0.45), 6).select("track", "i", "j", *round6("similarity"))


def section_energy_class(spark, sf_dir):
    return T.energy_class(B.sections(spark, sf_dir)).select("track", F.col("seq").cast("long").alias("seq"), "trend", "label")


def section_prechorus_runs(spark, sf_dir):
    return T.suppress_prechorus(B.sections(spark, sf_dir)).select("track", F.col("seq").cast("long").alias("seq"), "type", "label", "locked")


def section_chorus_chain(spark, sf_dir):
    return T.chorus_chains(B.sections(spark, sf_dir)).select("track", F.col("seq").cast("long").alias("seq"), "type", "label", "run")


def section_form(spark, sf_dir):
    return T.form(B.sections(spark, sf_dir)).select("track", "form", "n_types", "n", *round6("repetition"))


def scaler(spark, sf_dir):
    return S.scaled(B.vectors(spark, sf_dir)).select("vec_id", "dim", *round6("x"))


def _nearest(spark, sf_dir, measure):
    """The query set of searches: every id divisible by 20, against all rows."""
    rows = B.vectors(spark, sf_dir)
    return S.top_k(rows, rows.filter("vec_id % 20 = 0"), measure).select("target", "vec_id", F.col("rank").cast("long").alias("rank"), *round6("similarity"))


def similarity_nearest_cosine(spark, sf_dir):
    return _nearest(spark, sf_dir, S.cosine)


def similarity_nearest_euclidean(spark, sf_dir):
    return _nearest(spark, sf_dir, S.euclidean)


def similarity_nearest_weighted(spark, sf_dir):
    return _nearest(spark, sf_dir, S.weighted)


def similarity_matrix(spark, sf_dir):
    return S.similarity_matrix(B.vectors(spark, sf_dir)).select("a", "b", *round6("similarity"))


def pca_scores(spark, sf_dir):
    rows = S.principal_components(B.vectors(spark, sf_dir))
    return rows.select("vec_id", *[F.round(F.get("scores", F.lit(i)), 6).alias(f"pc{i + 1}") for i in range(3)])


def attributes(spark, sf_dir) -> DataFrame:
    """One row per customer, bound to the columns of the decision tables."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("track")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("track"))
    n, seg = F.col("n"), F.col("c_mktsegment")
    instruments = F.when(seg == "BUILDING", F.array(F.lit("guitar"), F.lit("drums"))).when(seg == "MACHINERY", F.array(F.lit("guitar"), F.lit("drums"), F.lit("piano"))).when(seg == "AUTOMOBILE", F.array(F.lit("piano"))).otherwise(F.array(F.lit("strings"), F.lit("bass"), F.lit("vocals"), F.lit("organ")))
    return rows.select(
        "track", (60 + 5 * n).cast("double").alias("bpm"), F.when(n % 2 == 0, "C Major").otherwise("A Minor").alias("key"), F.when(n % 5 == 0, "3/4").otherwise("4/4").alias("signature"),
        F.when(n % 3 == 0, "swing").otherwise("straight").alias("groove"), ((n % 10) / 10).alias("syncopation"), F.abs(F.col("c_acctbal") / 10000).alias("complexity"), instruments.alias("instruments"),
        (F.col("c_nationkey") / 25).alias("brightness"), (F.col("top") / 500000).alias("energy"), (F.col("low") / 100000).alias("density"), (20 * F.log10(F.col("top") / F.col("low"))).alias("range_db"),
    )


def reference_tags(spark, sf_dir):
    return P.reference_tags(attributes(spark, sf_dir))


def production_notes(spark, sf_dir):
    return P.production_notes(attributes(spark, sf_dir))


QUERIES = [
    ssm_band, novelty, boundary_peaks, boundary_snap, repetition_pairs, repetition_greedy, section_energy_class, section_prechorus_runs, section_chorus_chain, section_form,
    scaler, similarity_nearest_cosine, similarity_nearest_euclidean, similarity_nearest_weighted, similarity_matrix, pca_scores, reference_tags, production_notes,
]

_FV = f"{B.with_sql('frames')}, fv as (select track, dense_rank() over (partition by track order by frame) - 1 as idx, v from (select track, frame, list(v order by pc) as v from frames group by all)), lens as (select track, max(idx) + 1 as n from fv group by track)"
_BAND = "pairs as (select x.track, x.idx as i, y.idx as j, greatest(0.0, least(1.0, list_dot_product(x.v, y.v))) as sim from fv x join fv y on x.track = y.track and y.idx >= x.idx and y.idx - x.idx < {k})"
_SEC = f"{B.with_sql('ev', 'sections')}, so as (select *, row_number() over (partition by track order by t, event_id) - 1 as seq, count(*) over (partition by track) as n from sections)"
_RUNS = """f as (select *, case when type = lag(type) over (partition by track order by seq) then 0 else 1 end as brk from so), r as (select *, sum(brk) over (partition by track order by seq) as island from f),
p as (select *, count(*) over (partition by track, island) as len, row_number() over (partition by track, island order by seq) as place from r)"""
_VEC = "v as (select vec_id, embedding::double[] as v from embeddings)"
_REPS = f"""{_FV}, firsts as (select track, n, unnest(range(0, n - 6)) as i from lens where n > 6), seconds as (select track, i, unnest(range(i + 6, least(n - 7, i + n // 2) + 1)) as j from firsts),
cells as (select track, i, j, unnest(range(0, 6)) as k from seconds),
reps as (select c.track, i::int as i, j::int as j, avg(greatest(0.0, least(1.0, list_dot_product(a.v, b.v)))) as similarity from cells c join fv a on a.track = c.track and a.idx = c.i + c.k join fv b on b.track = c.track and b.idx = c.j + c.k group by all having similarity > 0.45)"""


def _top_sql(measure: str, each: int = 20) -> str:
    return f"""with {_VEC}, s as (select q.vec_id as target, x.vec_id, round({measure}, 9) as s from v q join v x on x.vec_id <> q.vec_id where q.vec_id % {each} = 0)
select target, vec_id, row_number() over (partition by target order by s desc, vec_id) as rank, round(s, 6) as similarity from s qualify rank <= 10"""


_WEIGHTED = " + ".join(f"{w} * list_cosine_similarity(q.v[{lo + 1}:{hi}], x.v[{lo + 1}:{hi}])" for _, lo, hi, w in K.WEIGHTED_RANGES if hi <= 64)  # the vectors have 64 numbers
_ATTR = """o as (select o_custkey as track, count(*) as n, max(o_totalprice) as top, min(o_totalprice) as low from orders group by all),
a as (select track, 60 + 5 * n as bpm, case when n % 2 = 0 then 'C Major' else 'A Minor' end as key, case when n % 5 = 0 then '3/4' else '4/4' end as signature, case when n % 3 = 0 then 'swing' else 'straight' end as groove,
  (n % 10) / 10 as syncopation, abs(c_acctbal / 10000) as complexity, case c_mktsegment when 'BUILDING' then ['guitar', 'drums'] when 'MACHINERY' then ['guitar', 'drums', 'piano'] when 'AUTOMOBILE' then ['piano'] else ['strings', 'bass', 'vocals', 'organ'] end as ins,
  c_nationkey / 25 as brightness, top / 500000 as energy, low / 100000 as density, 20 * log10(top / low) as range_db from customer join o on c_custkey = track)"""
SQL = {
    "ssm_band": f"{_FV}, {_BAND.format(k=8)} select track, i, j, round(sim, 6)::double as sim from pairs",
    "novelty": f"""{_FV}, {_BAND.format(k=4)}, full_m as (select track, i, j, sim from pairs union all select track, j, i, sim from pairs where i <> j),
b as (select l.track, s, sum(sim) / 16 as mean from (select track, n, unnest(range(0, n - 3)) as s from lens) l join full_m m on m.track = l.track and i >= s and i < s + 4 and j >= s and j < s + 4 group by all),
d as (select x.track, y.s as pos, abs(x.mean - y.mean) as x from b x join b y on x.track = y.track and y.s = x.s + 4 join lens l on l.track = x.track where y.s >= 4 and y.s < n - 4)
select track, pos::bigint as "at", round(coalesce(x / nullif(max(x) over (partition by track), 0), 0), 6) as novelty from d""",
    "boundary_snap": f"""with recursive {B.SQL['ev']}, g as (select distinct track, round_even(t / 0.125, 0) * 0.125 as t from ev), o as (select track, t, row_number() over (partition by track order by t) as i from g),
w as (select track, i, t as last, true as kept from o where i = 1 union all select o.track, o.i, case when o.t - w.last >= 0.5 then o.t else w.last end, o.t - w.last >= 0.5 from w join o on o.track = w.track and o.i = w.i + 1)
select track, last as t from w where kept""",
    "repetition_pairs": f"{_REPS} select track, i, j, round(similarity, 6)::double as similarity from reps",
    "repetition_greedy": f"""{_REPS.replace('with ', 'with recursive ', 1)}, o as (select *, row_number() over (partition by track order by -round(similarity, 9), i, j) as k from reps),
w as (select track, k, i, j, similarity, true as kept, [i, j] as used from o where k = 1
  union all select o.track, o.k, o.i, o.j, o.similarity, len(list_filter(w.used, lambda u: abs(u - o.i) < 6 or abs(u - o.j) < 6)) = 0,
  case when len(list_filter(w.used, lambda u: abs(u - o.i) < 6 or abs(u - o.j) < 6)) = 0 then list_concat(w.used, [o.i, o.j]) else w.used end from w join o on o.track = w.track and o.k = w.k + 1)
select track, i, j, round(similarity, 6)::double as similarity from w where kept""",
    "section_energy_class": f"""{_SEC}, d as (select *, energy - lag(energy) over w as b, coalesce(lead(energy) over w, energy) - energy as a from so window w as (partition by track order by seq)),
q as (select track, quantile_cont(energy, 0.5) as p50, quantile_cont(energy, 0.75) as p75, quantile_cont(energy, 0.9) as p90 from sections group by track),
t as (select d.*, case when n < 3 or seq = 0 then 'stable' when b > 0.1 and a > 0.1 then 'building' when b < -0.1 and a < -0.1 then 'declining' when b > 0.1 then 'building' when a < -0.1 then 'declining' else 'stable' end as trend from d)
select track, seq, trend, case when energy >= p90 then 'chorus' when energy >= p75 then case trend when 'building' then 'pre_chorus' else 'chorus' end
  when energy >= p50 then case trend when 'building' then 'pre_chorus' when 'declining' then 'bridge' else 'verse' end when seq = 0 then 'intro' when seq = n - 1 then 'outro' else 'verse' end as label from t join q using (track)""",
    "section_prechorus_runs": f"""{_SEC}, {_RUNS} select track, seq, type, case when type = 'pre_chorus' and len >= 3 and place = 1 then 'verse' when type = 'pre_chorus' and len >= 3 and place = len then 'chorus' when type = 'pre_chorus' and len = 2 and place = 2 then 'verse' else type end as label,
  type = 'pre_chorus' and len = 2 and place = 2 as locked from p""",
    "section_chorus_chain": f"{_SEC}, {_RUNS} select track, seq, type, case when type = 'chorus' and len > 2 and place % 3 = 0 then 'instrumental' else type end as label, case when type = 'chorus' then len else 0 end as run from p",
    "section_form": f"""{_SEC} select track, string_agg(case type when 'intro' then 'I' when 'verse' then 'A' when 'pre_chorus' then 'R' when 'chorus' then 'B' else 'D' end, '' order by seq) as form, count(distinct type) as n_types, count(*) as n, round(1 - count(distinct type) / count(*), 6) as repetition from so group by track""",
    "scaler": f"""with {_VEC}, x as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) - 1 as dim from v), s as (select dim, avg(x) as m, stddev_pop(x) as sd from x group by dim)
select vec_id, dim::int as dim, round((x - m) / case when sd = 0 then 1 else sd end, 6) as x from x join s using (dim)""",
    "similarity_nearest_cosine": _top_sql("list_cosine_similarity(q.v, x.v)"),
    "similarity_nearest_euclidean": _top_sql("greatest(0.0, 1 - list_distance(q.v, x.v) / sqrt(len(q.v)))"),
    "similarity_nearest_weighted": _top_sql(_WEIGHTED),
    "similarity_matrix": f"with {_VEC} select p.vec_id as a, q.vec_id as b, round(list_cosine_similarity(p.v, q.v), 6) as similarity from v p join v q on p.vec_id < q.vec_id",
    "reference_tags": f"""with {_ATTR} select track, concat_ws(',', case when bpm < 80 then 'slow-tempo' when bpm < 120 then 'mid-tempo' when bpm < 140 then 'upbeat' else 'fast-tempo' end, case when contains(key, 'Major') then 'major-key' else 'minor-key' end,
  case when signature <> '4/4' then 'time-sig-' || replace(signature, '/', '-') end, case when groove <> 'straight' then groove end, case when syncopation > 0.5 then 'syncopated' end, case when complexity > 0.7 then 'complex-structure' when complexity < 0.3 then 'simple-structure' end,
  ins[1] || '-driven', ins[2] || '-driven', ins[3] || '-driven', case when brightness > 0.7 then 'bright' when brightness < 0.3 then 'dark' end, case when energy > 0.7 then 'high-energy' when energy < 0.3 then 'low-energy' end) as tags from a""",
    "production_notes": f"""with {_ATTR} select track, case when density > 0.7 then 'dense' when density > 0.4 then 'medium' else 'sparse' end as density,
  case when list_contains(ins, 'guitar') and list_contains(ins, 'drums') then case when list_contains(ins, 'piano') then 'rock_pop' else 'rock' end when list_contains(ins, 'piano') then 'piano_driven' else 'modern_pop' end as style,
  concat_ws(',', case when range_db > 20 then 'wide_dynamic_range' when range_db < 10 then 'compressed' end, case when brightness > 0.7 then 'bright_mix' when brightness < 0.3 then 'warm_mix' end) as mix from a""",
}
