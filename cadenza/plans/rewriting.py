"""Queries and SQL of the rewriting of sections.

The SQL keeps a track's sections as a list, too, but folds by recursion, a step for each section.
"""

from __future__ import annotations

from cadenza.operators import rewriting as R
from cadenza.operators import sections as S
from cadenza.operators.series import round6
from cadenza.plans import sections as section_plans

BPM = 130.0


def _shown(rows):
    return rows.select("track", "seq", "type", *round6("start", "end"))


def section_rewritten(spark, sf_dir):
    """Every pass in order, on the bound sections of each user."""
    return _shown(R.rewritten(section_plans.timed(spark, sf_dir), BPM))


def section_chorus_joins(spark, sf_dir):
    return _shown(R.rewritten(section_plans.timed(spark, sf_dir), BPM, [R.join_choruses]))


def section_absorbed(spark, sf_dir):
    return _shown(R.rewritten(section_plans.timed(spark, sf_dir), BPM, [R.merge_same, R.absorb_short]))


def section_paired(spark, sf_dir):
    return _shown(R.rewritten(section_plans.timed(spark, sf_dir), BPM, [R.pair_pre_choruses, R.raise_verses, R.suppress_pre_choruses, R.collapse_alternation]))


def section_chain_breaks(spark, sf_dir):
    """The onset density of the binding stands for the share of voice."""
    rows = section_plans.timed(spark, sf_dir).withColumnRenamed("density", "vocal")
    return _shown(R.rewritten(rows, BPM, [R.break_chains], voiced=True))


QUERIES = [section_rewritten, section_chorus_joins, section_absorbed, section_paired, section_chain_breaks]

_BAR = 240.0 / BPM
_K = "struct(s double, e double, t varchar, g double, c double, b double, v double)[]"
_X, _PREV, _NEXT = "a[i]", "out[-1]", "a[i + 1]"


def _made(x: str, **new: str) -> str:
    return "struct_pack(" + ", ".join(f"{k} := {new.get(k, f'({x}).{k}')}" for k in "setgcbv") + ")"


def _instead(x: str) -> str:
    return f"list_append(out[1 : len(out) - 1], {x})"


def _fold(source: str, name: str, out: str, **state: tuple[str, str]) -> str:
    """A recursion over the list ``a``; state: first value and next value of each further column."""
    names = "".join(f", {k}" for k in state)
    first = "".join(f", {v[0]}" for v in state.values())
    then = "".join(f", {v[1]}" for v in state.values())
    return f"""{name}_r(track, i, a, out{names}) as (select track, 1::bigint, a, []::{_K}{first} from {source}
  union all select track, i + 1, a, {out}{then} from {name}_r where i <= len(a)),
{name} as (select track, out as a from {name}_r where i > len(a))"""


def _each(source: str, name: str, x: str) -> str:
    return f"{name} as (select track, list_transform(a, lambda x, i: {x}) as a from {source})"


def _cut(source: str, name: str, when: str, n: str, kind: str) -> str:
    piece = _made("x", s="x.s + (x.e - x.s) * k / n", e="case when k = n - 1 then x.e else x.s + (x.e - x.s) * (k + 1) / n end", t=kind).replace("/ n", f"/ {n}").replace("n - 1", f"{n} - 1")
    return f"{name} as (select track, flatten(list_transform(a, lambda x: case when {when} then list_transform(range(({n})::bigint), lambda k: {piece}) else [x] end)) as a from {source})"


_D = f"(({_X}).e - coalesce(frm, ({_X}).s))"
_GROWN = _instead(_made(_PREV, e=f"({_X}).e"))
_OWN = _made(_X, s=f"coalesce(frm, ({_X}).s)")
_FOLLOWS = f"coalesce(({_PREV}).t in ('chorus', 'verse', 'bridge'), false)"
_TINY = f"{_D} < {max(3.0, 2 * _BAR)!r}::double and len(out) > 0"
_LEAST = f"{max(6.0, 4 * _BAR)!r}::double"
_AHEAD = f"not ({_TINY}) and ({_X}).t = 'instrumental' and ({_X}).v is null and not {_FOLLOWS} and {_D} < {_LEAST} and coalesce(({_NEXT}).t in ('chorus', 'verse'), false)"
_LONG1 = f"(({_X}).e - ({_PREV}).s)"
_RULES = " ".join(f"when (({_PREV}).t = '{a}' and ({_X}).t = '{b}') or (({_PREV}).t = '{b}' and ({_X}).t = '{a}') then '{c}'" for a, b, c in S.MERGED)
_MIXED = f"""case when {_D} > {_LEAST} * 0.3 and {_D} > {_LONG1} * 0.5 then case when {_LONG1} > {_D} * 2 then ({_PREV}).t when {_D} > {_LONG1} * 2 then ({_X}).t
  when ({_X}).t = 'instrumental' and {_D} < 8 then ({_PREV}).t when ({_PREV}).t = 'instrumental' and {_LONG1} < 8 then ({_X}).t {_RULES} else ({_PREV}).t end else ({_PREV}).t end"""
_EMPTY_LAST = "coalesce(({p}).t = ({x}).t and not (({x}).t = 'instrumental' and (({x}).v is not null or ({p}).v is not null)) and abs(({x}).s - ({p}).e) <= 1, false)".format(p=_PREV, x=_X)


def _runs(source: str, name: str, kind: str, place_rules: str) -> str:
    """``place_rules`` sees x, place and n of each section of a run."""
    low = f"coalesce(list_max(list_filter(range(1, i), lambda j: a[j].t <> '{kind}')), 0)"
    high = f"coalesce(list_min(list_filter(range(i + 1, len(a) + 1), lambda j: a[j].t <> '{kind}')), len(a) + 1)"
    return f"""{name} as (select track, list(case when x.t = '{kind}' then {place_rules} else x end order by i) as a
  from (select track, i, x, i - low as place, high - low - 1 as n from (select track, i, a[i] as x, {low} as low, {high} as high from (select track, a, unnest(range(1, len(a) + 1)) as i from {source}))) group by track)"""


def _merged_same(source: str, name: str) -> str:
    return _fold(source, name, f"case when {_EMPTY_LAST} then {_GROWN} else list_append(out, {_X}) end")


def _absorbed(source: str, name: str) -> str:
    out = f"""case when {_TINY} then {_GROWN} when ({_X}).t = 'instrumental' and ({_X}).v is not null then list_append(out, {_OWN})
    when ({_X}).t = 'instrumental' and {_FOLLOWS} and ({_D} <= {8 * _BAR!r}::double or {_D} < {_LEAST}) then {_GROWN} when {_AHEAD} then out
    when {_D} < {_LEAST} and len(out) > 0 then {_instead(_made(_PREV, e=f'({_X}).e', t=_MIXED))} else list_append(out, {_OWN}) end"""
    return _fold(source, name, out, frm=("null::double", f"case when {_AHEAD} then coalesce(frm, ({_X}).s) end"))


_KIND = f"case when force then 'chorus' else ({_X}).t end"
_FORCE = f"coalesce({_KIND} = 'pre_chorus' and chain + 1 >= 2 and ({_NEXT}).t in ('verse', 'pre_chorus', 'bridge'), false)"
_ORPHAN = f"({_KIND} = 'pre_chorus' and not {_FORCE} and len(list_filter(a[i + 1 : i + 3], lambda y: y.t in ('chorus', 'bridge'))) = 0)"


def _paired(source: str, name: str) -> str:
    out = f"list_append(out, {_made(_X, t=f"case when len(a) < 2 then ({_X}).t when {_ORPHAN} then 'verse' else {_KIND} end")})"
    first = _fold(source, f"{name}0", out, force=("false", _FORCE), chain=("0", f"case when {_KIND} = 'pre_chorus' and not {_ORPHAN} then chain + 1 else 0 end"))
    return first + ",\n" + _each(f"{name}0", name, f"case when x.t = 'verse' and coalesce(x.g, 0.5) > 0.4 and coalesce(a[i + 1].t = 'chorus', false) then {_made('x', t="'pre_chorus'")} else x end")


def _suppressed(source: str, name: str) -> str:
    return _runs(source, name, "pre_chorus", _made("x", t="case when n >= 3 and place = 1 then 'verse' when n >= 3 and place = n then 'chorus' when n = 2 and place = 2 then 'verse' else x.t end"))


def _collapsed(source: str, name: str) -> str:
    return _fold(source, name, f"list_append(out, case when len(out) > 1 and ({_X}).t = 'verse' and ({_PREV}).t = 'pre_chorus' and (out[-2]).t = 'verse' then {_made(_X, t="'chorus'")} else {_X} end)")


def _joined(source: str, name: str) -> str:
    eight = 8 * _BAR
    fits = f"coalesce(({_X}).t = 'chorus' and (a[i + 1]).t = 'instrumental' and (a[i + 2]).t = 'chorus' and (a[i + 1]).e - (a[i + 1]).s <= {eight + 0.1 * eight!r}::double and (a[i + 1]).v is null and (a[i + 2]).e - ({_X}).s <= {16 * eight / 8!r}::double, false)"
    return f"""{name}_r(track, i, a, out, changed) as (select track, 1::bigint, a, []::{_K}, false from {source}
  union all select track, case when i > len(a) then 1 when {fits} then i + 3 else i + 1 end, case when i > len(a) then out else a end,
  case when i > len(a) then [] when {fits} then list_append(out, {_made(_X, e='(a[i + 2]).e')}) else list_append(out, {_X}) end, case when i > len(a) then false else changed or {fits} end from {name}_r where i <= len(a) or changed),
{name} as (select track, out as a from {name}_r where i > len(a) and not changed)"""


_BEGIN = section_plans._TIMED.replace("with ", "with recursive ", 1) + f""",
lists as (select track, list(struct_pack(s := s, e := e, t := type, g := energy, c := complexity, b := brightness, v := null::double) order by seq)::{_K} as a from td group by track),
voiced as (select track, list(struct_pack(s := s, e := e, t := type, g := energy, c := complexity, b := brightness, v := density) order by seq)::{_K} as a from td group by track)"""


def _end(source: str) -> str:
    return f"select track, i - 1 as seq, x.t as type, round(x.s, 6) as start, round(x.e, 6) as \"end\" from (select track, unnest(range(1, len(a) + 1)) as i, unnest(a) as x from {source})"


_LIMITED = _runs("lists", "p1", "chorus", f"case when place % 3 = 0 then {_made('x', t="'instrumental'", v='0.2')} else x end")
_BRIDGES = _each("p5", "p6", f"case when x.t = 'bridge' and (x.e - x.s < {12 * _BAR!r}::double or coalesce(x.c, 0) <= 0.7) then {_made('x', t="case when coalesce(x.g, 0) > 0.55 then 'pre_chorus' else 'verse' end")} else x end")
_ENDING = _each("p6", "p7", f"case when i = len(a) and x.t in ('instrumental', 'verse') and x.e - x.s <= {8 * _BAR!r}::double then {_made('x', t="'outro'")} else x end")
_HOOKS = _each("p7", "p8", f"case when coalesce(x.g, 0) > 0.65 and x.e - x.s >= 6 and x.e - x.s <= 10 and x.t in ('verse', 'bridge', 'pre_chorus') and (coalesce(x.b, 0) <= 0 or x.b > 0.6) then {_made('x', t="'chorus'")} else x end")
_OVER = f"{16 * _BAR!r}::double"
_SPLIT = _cut("p9", "p10", f"x.t = 'pre_chorus' and x.e - x.s > {_OVER}", f"ceil((x.e - x.s) / {_OVER})", "case when k = 0 then 'verse' else 'pre_chorus' end")
_HALVES = _cut("p10", "p11", f"x.t in ('verse', 'pre_chorus') and x.e - x.s > {_OVER}", "2", "case when k = 0 then 'verse' else 'pre_chorus' end")
_SOLO = f"case when ({_X}).t = 'solo' and ({_X}).e - ({_X}).s <= 6 then 'instrumental' else ({_X}).t end"
_PLAIN = _fold("p11", "p12", f"case when coalesce({_SOLO} = 'instrumental' and ({_PREV}).t = 'instrumental', false) then {_GROWN} else list_append(out, {_made(_X, t=_SOLO)}) end")
_SHORT = f"({_X}).t = 'chorus' and ({_X}).e - ({_X}).s < {8 * _BAR!r}::double"
_CHORUS = _fold("p12", "p13", f"case when {_SHORT} and coalesce(({_PREV}).t = 'pre_chorus', false) then {_GROWN} when {_SHORT} then list_append(out, {_made(_X, t="'instrumental'")}) else list_append(out, {_X}) end")
_BORDERS = _each("p13", "p14", f"case when x.t = 'verse' and coalesce(a[i + 1].t = 'chorus', false) and coalesce(x.g, 0) > 0.55 then {_made('x', t="'pre_chorus'")} when x.t = 'pre_chorus' and coalesce(a[i + 1].t = 'pre_chorus', false) then {_made('x', t="'verse'")} else x end")
_NAMES = _each("p14", "p15", f"case when x.t in ('solo', 'interlude', 'buildup', 'breakdown') then {_made('x', t="'instrumental'")} else x end")
_WEAK = f"(coalesce(x.v, 0.5) < 0.25 or coalesce(x.g, 0.5) < 0.4) and x.e - x.s between {4 * _BAR!r}::double and {_OVER}"

SQL = {
    "section_rewritten": ",\n".join([
        _BEGIN, _LIMITED, _merged_same("p1", "p2"), _absorbed("p2", "p3"), _paired("p3", "p4"), _suppressed("p4", "p5"), _BRIDGES, _ENDING, _HOOKS, _collapsed("p8", "p9"),
        _SPLIT, _HALVES, _PLAIN, _CHORUS, _BORDERS, _NAMES, _joined("p15", "p16"),
    ]) + "\n" + _end("p16"),
    "section_chorus_joins": f"{_BEGIN},\n{_joined('lists', 'p')}\n{_end('p')}",
    "section_absorbed": f"{_BEGIN},\n{_merged_same('lists', 'p')},\n{_absorbed('p', 'q')}\n{_end('q')}",
    "section_paired": f"{_BEGIN},\n{_paired('lists', 'p')},\n{_suppressed('p', 'q')},\n{_collapsed('q', 'r')}\n{_end('r')}",
    "section_chain_breaks": f"{_BEGIN},\n{_runs('voiced', 'p', 'chorus', f"case when (n = 2 and place = 2 and {_WEAK}) or (n >= 3 and place > 1 and place < n and x.e - x.s between {2 * _BAR!r}::double and {24 * _BAR!r}::double) then {_made('x', t="'instrumental'")} else x end")}\n{_end('p')}",
}
