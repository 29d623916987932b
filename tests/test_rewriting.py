"""Rewriting of sections on cases worked out by hand; queries with SQL are in test_oracles."""

import pytest

from cadenza.operators import rewriting as R

BPM = 130.5
EIGHT = 8 * 240 / BPM  # 14.7 s


def run(spark, sections, passes=None, **kw):
    rows, at = [], 0.0
    for k, x in enumerate(sections):
        kind, long, energy, complexity, vocal = (*x, *(None,) * 5)[:5]
        rows.append(("a", k, at, at + long, kind, 0.8 if energy is None else float(energy), 0.7 if complexity is None else float(complexity), vocal))
        at += long
    df = spark.createDataFrame(rows, "track string, seq long, start double, end double, type string, energy double, complexity double, vocal double")
    found = sorted(R.rewritten(df, BPM, passes, **kw).collect(), key=lambda r: r.seq)
    assert [r.seq for r in found] == list(range(len(found)))
    assert all(a.end == pytest.approx(b.start) for a, b in zip(found, found[1:])) and (not found or found[-1].end == pytest.approx(at))  # time is kept
    return [(r.type, round(r.end - r.start, 3)) for r in found]


def kinds(*args, **kw):
    return [kind for kind, _ in run(*args, **kw)]


def test_choruses_join_up_to_sixteen_bars(spark):
    six = [("chorus", 15), ("instrumental", 16.2), ("chorus", 15), ("chorus", 15), ("instrumental", 13.8), ("chorus", 15)]
    assert len(run(spark, six, [R.join_choruses])) == 6  # one part is too long, the other result would be
    assert run(spark, [("chorus", 10), ("instrumental", 5), ("chorus", 10)], [R.join_choruses]) == [("chorus", 25)]
    again = [("chorus", 4), ("instrumental", 2)] * 4 + [("chorus", 4)]
    assert run(spark, again, [R.join_choruses]) == [("chorus", 28)]  # over several passes
    assert len(run(spark, [("chorus", 10), ("instrumental", 5, None, None, 0.2), ("chorus", 10)], [R.join_choruses], voiced=True)) == 3


def test_chains_of_choruses(spark):
    assert kinds(spark, [("chorus", 15)] * 7, [R.limit_choruses]) == ["chorus", "chorus", "instrumental"] * 2 + ["chorus"]
    assert kinds(spark, [("chorus", 15)] * 3, [R.break_chains]) == ["chorus", "instrumental", "chorus"]
    assert kinds(spark, [("chorus", 15)] * 5, [R.break_chains]) == ["chorus", *["instrumental"] * 3, "chorus"]
    assert kinds(spark, [("chorus", 15), ("chorus", 2), ("chorus", 60), ("chorus", 15)], [R.break_chains]) == ["chorus"] * 4  # lengths do not fit
    assert kinds(spark, [("chorus", 15), ("chorus", 15)], [R.break_chains]) == ["chorus"] * 2
    assert kinds(spark, [("chorus", 15), ("chorus", 15, 0.3)], [R.break_chains]) == ["chorus", "instrumental"]
    assert kinds(spark, [("chorus", 15), ("chorus", 15, 0.8, 0.7, 0.1)], [R.break_chains], voiced=True) == ["chorus", "instrumental"]


def test_pre_choruses_in_a_row(spark):
    r = "pre_chorus"
    assert kinds(spark, [("verse", 15), (r, 15), (r, 15), ("chorus", 15)], [R.suppress_pre_choruses]) == ["verse", r, "verse", "chorus"]
    assert kinds(spark, [(r, 15)] * 4, [R.suppress_pre_choruses]) == ["verse", r, r, "chorus"]
    assert kinds(spark, [(r, 15), ("verse", 15), (r, 15)], [R.suppress_pre_choruses]) == [r, "verse", r]


def test_pairing(spark):
    r, both = "pre_chorus", [R.pair_pre_choruses, R.raise_verses]
    assert kinds(spark, [("verse", 15), (r, 15), ("verse", 15), ("verse", 15), ("outro", 15)], both) == ["verse", "verse", "verse", "verse", "outro"]  # an orphan
    assert kinds(spark, [(r, 15), ("verse", 15), ("verse", 15), ("chorus", 15)], both) == [r, "verse", r, "chorus"]
    assert kinds(spark, [(r, 15), (r, 15), ("verse", 15), ("bridge", 15)], both) == [r, r, "chorus", "bridge"]  # two in a row force one
    assert kinds(spark, [("verse", 15, 0.3), ("chorus", 15)], both) == ["verse", "chorus"]
    assert kinds(spark, [(r, 15)], both) == [r]


def test_alternation_and_borders(spark):
    r = "pre_chorus"
    assert kinds(spark, [("verse", 9), (r, 9), ("verse", 9), (r, 9), ("verse", 9)], [R.collapse_alternation]) == ["verse", r, "chorus", r, "verse"]
    assert kinds(spark, [("verse", 9, 0.6), ("chorus", 20), (r, 9), (r, 9), ("verse", 9, 0.5), ("chorus", 20)], [R.correct_borders]) == [r, "chorus", "verse", r, "verse", "chorus"]


def test_short_sections_are_absorbed(spark):
    one = [R.absorb_short]
    assert run(spark, [("verse", 20), ("bridge", 2)], one) == [("verse", 22)]
    assert run(spark, [("chorus", 20), ("instrumental", 14)], one) == [("chorus", 34)]
    assert run(spark, [("chorus", 20), ("instrumental", 15)], one) == [("chorus", 20), ("instrumental", 15)]
    assert run(spark, [("chorus", 20), ("instrumental", 14, 0.5, 0.5, 0.2)], one, voiced=True) == [("chorus", 20), ("instrumental", 14)]  # put there on purpose
    assert run(spark, [("intro", 20), ("instrumental", 5), ("verse", 20)], one) == [("intro", 20), ("verse", 25)]
    assert run(spark, [("instrumental", 2), ("verse", 20)], one) == [("verse", 22)]
    assert run(spark, [("verse", 4), ("bridge", 7)], one) == [("bridge", 11)]  # a long part of a short whole: the rules of merging
    assert run(spark, [("verse", 1)], one) == [("verse", 1)]


def test_splits_and_names(spark):
    long = 4.5 * EIGHT
    assert run(spark, [("pre_chorus", long)], [R.split_pre_choruses]) == [("verse", round(long / 3, 3)), ("pre_chorus", round(long / 3, 3)), ("pre_chorus", round(long / 3, 3))]
    assert run(spark, [("verse", 40), ("chorus", 40)], [R.split_halves]) == [("verse", 20), ("pre_chorus", 20), ("chorus", 40)]
    assert run(spark, [("solo", 5), ("instrumental", 7), ("solo", 9)], [R.merge_instrumental]) == [("instrumental", 12), ("solo", 9)]
    assert run(spark, [("pre_chorus", 9), ("chorus", 5), ("chorus", 5), ("verse", 9), ("chorus", 5)], [R.short_choruses]) == [("pre_chorus", 19), ("verse", 9), ("instrumental", 5)]
    assert kinds(spark, [("solo", 9), ("breakdown", 9), ("break", 9)], [R.plain_names]) == ["instrumental", "instrumental", "break"]
    assert kinds(spark, [("bridge", 30, 0.8, 0.8), ("bridge", 30, 0.8, 0.7), ("bridge", 20, 0.5, 0.8), ("verse", 14)], [R.downgrade_bridges, R.close_ending]) == ["bridge", "pre_chorus", "verse", "outro"]


def test_a_whole_song(spark):
    song = [("intro", 10, 0.2), ("verse", 20, 0.5), ("chorus", 20, 0.9), ("verse", 20, 0.3), ("chorus", 20, 0.9), ("bridge", 20, 0.6), ("chorus", 20, 0.9), ("outro", 10, 0.2)]
    assert kinds(spark, song) == ["intro", "pre_chorus", "chorus", "verse", "chorus", "pre_chorus", "chorus", "outro"]
    assert run(spark, [("verse", 10), ("verse", 10), ("chorus", 20)], [R.merge_same]) == [("verse", 20), ("chorus", 20)]
    assert R.rewritten(spark.createDataFrame([], "track string, seq long, start double, end double, type string, energy double, complexity double")).count() == 0
