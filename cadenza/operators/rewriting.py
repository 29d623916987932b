"""Rewriting of a track's sections: chains, merges, absorption, pairing, splits, to a fixpoint.

The sections of a track (some dozens, bounded by its length) are one array of structs (start, end,
type, energy, complexity, brightness, vocal), and every pass is a function of that array: a fold whose
accumulator is what has been written so far, or a projection where no pass looks at what it wrote
itself.  Tracks are rows, so work is spread by track and nothing is shuffled between passes.

``vocal`` is the share of voice where it was measured or set; an instrumental part that has one was
put there on purpose and is not merged away.  Lengths in bars follow from ``bpm``, four beats to a bar.
Fixed values: all lengths, shares and thresholds below are part of the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.sections import merged_type

# Kinds of instrumental parts that end as plain ones.
ALIASES = ("solo", "interlude", "buildup", "breakdown")
FIELDS = ("start", "end", "type", "energy", "complexity", "brightness", "vocal")
KIND = "array<struct<start:double,end:double,type:string,energy:double,complexity:double,brightness:double,vocal:double>>"

Pass = Callable[[Column, float], Column]


def bars(n: float, bpm: float) -> float:
    return n * 240.0 / bpm


def gathered(sections: DataFrame) -> DataFrame:
    """track and s, the array of a track's sections by seq; numbers that are not there are null."""
    kinds = {"type": "string"}
    given = [(F.col(c) if c in sections.columns else F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in FIELDS]
    rows = sections.select("track", "seq", F.struct(*given).alias("x"))
    return rows.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x"))), lambda r: r["x"]).alias("s"))


def spread(tracks: DataFrame) -> DataFrame:
    """A row per section: track, seq (from 0) and its fields."""
    return tracks.select("track", F.posexplode("s").alias("seq", "x")).select("track", F.col("seq").cast("long").alias("seq"), "x.*")


def _long(x: Column) -> Column:
    return x["end"] - x["start"]


def _typed(x: Column, kind: Column | str) -> Column:
    return x.withField("type", F.lit(kind) if isinstance(kind, str) else kind)


def _empty() -> Column:
    return F.array().cast(KIND)


def _last(out: Column) -> Column:
    return F.try_element_at(out, F.lit(-1))


def _put(out: Column, *xs: Column) -> Column:
    return F.concat(out, F.array(*xs))


def _instead(out: Column, x: Column) -> Column:
    """The array with another last entry."""
    return F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(x))


def _until(out: Column, end: Column) -> Column:
    return _instead(out, _last(out).withField("end", end))


def _indexed(s: Column, zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """A fold over the places of ``s``, from 0."""
    places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, zero, step, finish) if finish else F.aggregate(places, zero, step)


def _run_places(s: Column, kind: str) -> Column:
    """Of each section its place from 1 in the run of its type, 0 for other types."""

    def step(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.when(x["type"] == kind, F.coalesce(_last(acc), F.lit(0)) + 1).otherwise(0)))

    return F.aggregate(s, F.array().cast("array<int>"), step)


def _with_runs(s: Column, kind: str, label: Callable[[Column, Column, Column], Column]) -> Column:
    """``label(section, place, length)`` on every section of runs of ``kind``."""
    ahead, back = _run_places(s, kind), F.reverse(_run_places(F.reverse(s), kind))
    pairs = F.arrays_zip(s.alias("x"), ahead.alias("a"), back.alias("b"))
    return F.transform(pairs, lambda p: F.when(p["a"] > 0, label(p["x"], p["a"], p["a"] + p["b"] - 1)).otherwise(p["x"]))


# ---- chains of choruses


def limit_choruses(s: Column, bpm: float) -> Column:
    """Every third chorus in a row is an instrumental part with little voice."""
    return _with_runs(s, "chorus", lambda x, place, n: F.when(place % 3 == 0, _typed(x, "instrumental").withField("vocal", F.lit(0.2))).otherwise(x))


def break_chains(s: Column, bpm: float) -> Column:
    """Inner choruses of a chain are instrumental; of two the second, if voice or energy are low, if its length fits."""

    def label(x: Column, place: Column, n: Column) -> Column:
        d = _long(x)
        weak = (F.coalesce(x["vocal"], F.lit(0.5)) < 0.25) | (F.coalesce(x["energy"], F.lit(0.5)) < 0.4)
        pair = (n == 2) & (place == 2) & weak & d.between(bars(4, bpm), bars(16, bpm))
        inner = (n >= 3) & (place > 1) & (place < n) & d.between(bars(2, bpm), bars(24, bpm))
        return F.when(pair | inner, _typed(x, "instrumental")).otherwise(x)

    return _with_runs(s, "chorus", label)


# ---- merging and absorption


def merge_same(s: Column, bpm: float) -> Column:
    """Neighbours of one type with a gap of at most a second are one section, but for instrumental parts that have a voice."""

    def step(out: Column, x: Column) -> Column:
        before = _last(out)
        kept = (x["type"] == "instrumental") & (x["vocal"].isNotNull() | before["vocal"].isNotNull())
        joins = (before["type"] == x["type"]) & ~kept & (F.abs(x["start"] - before["end"]) <= 1.0)
        return F.when(F.coalesce(joins, F.lit(False)), _until(out, x["end"])).otherwise(_put(out, x))

    return F.aggregate(s, _empty(), step)


def absorb_short(s: Column, bpm: float) -> Column:
    """Sections too short to stand alone go into the one before, short instrumental parts into the one after.

    Up to two bars (3 s at least) always; an instrumental part of up to eight bars after a chorus, verse or
    bridge; then below four bars (6 s at least) forward into a chorus or verse, or back, where a long one
    may change the type.
    """
    least, tiny, eight = max(6.0, bars(4, bpm)), max(3.0, bars(2, bpm)), bars(8, bpm)

    def step(acc: Column, i: Column) -> Column:
        out, own = acc["out"], F.get(s, i)
        x = own.withField("start", F.coalesce(acc["from"], own["start"]))
        before, after, d = _last(out), F.get(s, i + 1), _long(x)
        some, free = F.size(out) > 0, x["vocal"].isNull()
        plain = x["type"] == "instrumental"
        follows = some & F.coalesce(before["type"].isin("chorus", "verse", "bridge"), F.lit(False))
        longer = x["end"] - before["start"]
        mixed = F.when((d > least * 0.3) & (d > longer * 0.5), merged_type(before["type"], x["type"], longer, d)).otherwise(before["type"])
        grown, kept = _until(out, x["end"]), _put(out, x)
        leads = (d < least) & F.coalesce(after["type"].isin("chorus", "verse"), F.lit(False))
        ahead = plain & free & ~follows & leads & ~((d < tiny) & some)
        written = (
            F.when((d < tiny) & some, grown)
            .when(plain & ~free, kept)
            .when(plain & follows & ((d <= eight) | (d < least)), grown)
            .when(ahead, out)
            .when((d < least) & some, _instead(out, _typed(before.withField("end", x["end"]), mixed)))
            .otherwise(kept)
        )
        return F.struct(written.alias("out"), F.when(ahead, x["start"]).alias("from"))

    zero = F.struct(_empty().alias("out"), F.lit(None).cast("double").alias("from"))
    return _indexed(s, zero, step, lambda acc: acc["out"])


def merge_instrumental(s: Column, bpm: float) -> Column:
    """Solos of up to 6 s are instrumental, and instrumental neighbours are one section."""

    def step(out: Column, x: Column) -> Column:
        x = _typed(x, F.when((x["type"] == "solo") & (_long(x) <= 6.0), "instrumental").otherwise(x["type"]))
        joins = (x["type"] == "instrumental") & (_last(out)["type"] == "instrumental")
        return F.when(F.coalesce(joins, F.lit(False)), _until(out, x["end"])).otherwise(_put(out, x))

    return F.aggregate(s, _empty(), step)


def short_choruses(s: Column, bpm: float) -> Column:
    """Choruses below eight bars go into a pre-chorus before them, else they are instrumental."""

    def step(out: Column, x: Column) -> Column:
        short = (x["type"] == "chorus") & (_long(x) < bars(8, bpm))
        into = F.coalesce(_last(out)["type"] == "pre_chorus", F.lit(False))
        return F.when(short & into, _until(out, x["end"])).when(short, _put(out, _typed(x, "instrumental"))).otherwise(_put(out, x))

    return F.aggregate(s, _empty(), step)


def _join_choruses_once(s: Column, bpm: float) -> Column:
    """One pass from left to right: the array and whether it changed.

    What is joined is not looked at again in the same pass, as the fold takes places, not what it wrote.
    """
    eight = bars(8, bpm)

    def step(acc: Column, i: Column) -> Column:
        x, middle, far = F.get(s, i), F.get(s, i + 1), F.get(s, i + 2)
        fits = (x["type"] == "chorus") & (middle["type"] == "instrumental") & (far["type"] == "chorus") & (_long(middle) <= eight + 0.1 * eight)
        joins = F.coalesce(fits & middle["vocal"].isNull() & (far["end"] - x["start"] <= 16 * eight / 8), F.lit(False))
        fresh = F.struct(_put(acc["out"], F.when(joins, x.withField("end", far["end"])).otherwise(x)).alias("out"), F.when(joins, i + 3).otherwise(i + 1).alias("next"), (acc["changed"] | joins).alias("changed"))
        return F.when(i < acc["next"], acc).otherwise(fresh)

    zero = F.struct(_empty().alias("out"), F.lit(0).alias("next"), F.lit(False).alias("changed"))
    return _indexed(s, zero, step, lambda acc: F.struct(acc["out"].alias("out"), acc["changed"].alias("changed")))


def join_choruses(s: Column, bpm: float) -> Column:
    """Chorus, short instrumental part, chorus become one chorus of at most 16 bars, again and again until none is left.

    The part may have eight bars and a tenth.  A pass that changes nothing ends the work: later ones are not evaluated.
    """
    rounds = F.sequence(F.lit(0), F.size(s))
    zero = F.struct(s.alias("out"), F.lit(True).alias("changed"))
    return F.aggregate(rounds, zero, lambda acc, _: F.when(acc["changed"], _join_choruses_once(acc["out"], bpm)).otherwise(acc), lambda acc: acc["out"])


# ---- what goes with what


def pair_pre_choruses(s: Column, bpm: float) -> Column:
    """A pre-chorus leads to a chorus.

    After two in a row the next verse, pre-chorus or bridge is the chorus; one without chorus or bridge among
    the next three sections is a verse.  Then a verse right before a chorus is its pre-chorus if its
    energy is over 0.4.
    """

    def step(acc: Column, i: Column) -> Column:
        own, after = F.get(s, i), F.get(s, i + 1)
        x = F.when(acc["force"], _typed(own, "chorus")).otherwise(own)
        pre = x["type"] == "pre_chorus"
        chain = acc["chain"] + 1
        force = F.coalesce(pre & (chain >= 2) & after["type"].isin("verse", "pre_chorus", "bridge"), F.lit(False))
        leads = F.exists(F.slice(s, i + 2, F.lit(3)), lambda y: y["type"].isin("chorus", "bridge"))
        orphan = pre & ~force & ~leads
        written = F.when(orphan, _typed(x, "verse")).otherwise(x)
        return F.struct(_put(acc["out"], written).alias("out"), force.alias("force"), F.when(pre & ~orphan, chain).otherwise(0).alias("chain"))

    zero = F.struct(_empty().alias("out"), F.lit(False).alias("force"), F.lit(0).alias("chain"))
    return F.when(F.size(s) > 1, _indexed(s, zero, step, lambda acc: acc["out"])).otherwise(s)


def raise_verses(s: Column, bpm: float) -> Column:
    """The second half of pairing: verses right before a chorus."""
    rises = lambda x, i: (x["type"] == "verse") & (F.coalesce(x["energy"], F.lit(0.5)) > 0.4) & F.coalesce(F.get(s, i + 1)["type"] == "chorus", F.lit(False))
    return F.transform(s, lambda x, i: F.when(rises(x, i), _typed(x, "pre_chorus")).otherwise(x))


def suppress_pre_choruses(s: Column, bpm: float) -> Column:
    """Of three or more pre-choruses in a row the first is a verse and the last a chorus; of two the second is a verse."""

    def label(x: Column, place: Column, n: Column) -> Column:
        kind = F.when((n >= 3) & (place == 1), "verse").when((n >= 3) & (place == n), "chorus").when((n == 2) & (place == 2), "verse").otherwise(x["type"])
        return _typed(x, kind)

    return _with_runs(s, "pre_chorus", label)


def collapse_alternation(s: Column, bpm: float) -> Column:
    """Verse, pre-chorus, verse: the last is the chorus; from left to right on what was written."""

    def step(out: Column, x: Column) -> Column:
        turns = (x["type"] == "verse") & (_last(out)["type"] == "pre_chorus") & (F.try_element_at(out, F.lit(-2))["type"] == "verse")
        return _put(out, F.when(F.coalesce((F.size(out) > 1) & turns, F.lit(False)), _typed(x, "chorus")).otherwise(x))

    return F.aggregate(s, _empty(), step)


def correct_borders(s: Column, bpm: float) -> Column:
    """A verse over 0.55 in energy before a chorus is its pre-chorus; of two pre-choruses the first is a verse."""

    def label(x: Column, i: Column) -> Column:
        after = F.get(s, i + 1)["type"]
        strong = (x["type"] == "verse") & (after == "chorus") & (F.coalesce(x["energy"], F.lit(0.0)) > 0.55)
        double = (x["type"] == "pre_chorus") & (after == "pre_chorus")
        return F.when(F.coalesce(strong, F.lit(False)), _typed(x, "pre_chorus")).when(F.coalesce(double, F.lit(False)), _typed(x, "verse")).otherwise(x)

    return F.transform(s, label)


# ---- one by one, and splits


def downgrade_bridges(s: Column, bpm: float) -> Column:
    """Bridges under 12 bars or of complexity up to 0.7 are pre-choruses (energy over 0.55) or verses."""

    def label(x: Column) -> Column:
        plain = (x["type"] == "bridge") & ((_long(x) < bars(12, bpm)) | (F.coalesce(x["complexity"], F.lit(0.0)) <= 0.7))
        return F.when(plain, _typed(x, F.when(F.coalesce(x["energy"], F.lit(0.0)) > 0.55, "pre_chorus").otherwise("verse"))).otherwise(x)

    return F.transform(s, label)


def close_ending(s: Column, bpm: float) -> Column:
    """A last instrumental part or verse of at most eight bars is the outro."""
    closing = lambda x, i: (i == F.size(s) - 1) & x["type"].isin("instrumental", "verse") & (_long(x) <= bars(8, bpm))
    return F.transform(s, lambda x, i: F.when(closing(x, i), _typed(x, "outro")).otherwise(x))


def hook_choruses(s: Column, bpm: float) -> Column:
    """Strong sections of 6 to 10 s are choruses; where brightness is known it must be over 0.6."""

    def label(x: Column) -> Column:
        bright = F.coalesce(x["brightness"], F.lit(0.0))
        hook = (F.coalesce(x["energy"], F.lit(0.0)) > 0.65) & _long(x).between(6, 10) & x["type"].isin("verse", "bridge", "pre_chorus") & ((bright <= 0) | (bright > 0.6))
        return F.when(hook, _typed(x, "chorus")).otherwise(x)

    return F.transform(s, label)


def _piece(x: Column, k: Column, n: Column) -> Column:
    return x.withField("start", x["start"] + _long(x) * k / n).withField("end", F.when(k == n - 1, x["end"]).otherwise(x["start"] + _long(x) * (k + 1) / n))


def split_pre_choruses(s: Column, bpm: float) -> Column:
    """A pre-chorus over 16 bars is cut into equal parts of at most 16; the first is a verse."""

    def parts(x: Column) -> Column:
        n = F.ceil(_long(x) / bars(16, bpm)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: _typed(_piece(x, k, n), F.when(k == 0, "verse").otherwise("pre_chorus")))
        return F.when((x["type"] == "pre_chorus") & (_long(x) > bars(16, bpm)), cut).otherwise(F.array(x))

    return F.flatten(F.transform(s, parts))


def split_halves(s: Column, bpm: float) -> Column:
    """A verse or pre-chorus over 16 bars is a verse and a pre-chorus of half its length."""

    def parts(x: Column) -> Column:
        cut = F.array(*[_typed(_piece(x, F.lit(k), F.lit(2)), kind) for k, kind in enumerate(("verse", "pre_chorus"))])
        return F.when(x["type"].isin("verse", "pre_chorus") & (_long(x) > bars(16, bpm)), cut).otherwise(F.array(x))

    return F.flatten(F.transform(s, parts))


def plain_names(s: Column, bpm: float) -> Column:
    return F.transform(s, lambda x: F.when(x["type"].isin(*ALIASES), _typed(x, "instrumental")).otherwise(x))


#: The passes in order; ``break_chains`` only where voice was measured.
PASSES: list[Pass] = [
    limit_choruses, break_chains, merge_same, absorb_short, pair_pre_choruses, raise_verses, suppress_pre_choruses, downgrade_bridges, close_ending, hook_choruses,
    collapse_alternation, split_pre_choruses, split_halves, merge_instrumental, short_choruses, correct_borders, plain_names, join_choruses,
]


def rewritten(sections: DataFrame, bpm: float = 130.0, passes: list[Pass] | None = None, voiced: bool = False) -> DataFrame:
    """Sections (track, seq, start, end, type and numbers) after ``passes``, by default all of them.

    ``voiced``: the column vocal is a measurement of every section; without it chains of choruses are only limited, and
    vocal marks the parts that the limit made.  Between passes sections are rows again: a pass reads its
    array many times, and the optimiser would put the pass before it in each of these places.  Rows stay with
    their track, so gathering them again needs no shuffle.
    """
    tracks = gathered(sections if voiced else sections.drop("vocal"))
    for one in PASSES if passes is None else passes:
        if voiced or passes is not None or one is not break_chains:
            tracks = gathered(spread(tracks.withColumn("s", one(F.col("s"), bpm))))
    return spread(tracks)
