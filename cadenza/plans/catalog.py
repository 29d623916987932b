"""The query catalogue: name -> Spark plan, name -> DuckDB SQL."""

from __future__ import annotations

from cadenza.plans import chords, keys, more, passages, rewriting, rhythm, sections, signals, sound, structures, vectors

FAMILIES = [keys, chords, rhythm, sound, structures, more, vectors, sections, signals, rewriting, passages]


def queries() -> dict:
    return {f.__name__: f for family in FAMILIES for f in family.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
