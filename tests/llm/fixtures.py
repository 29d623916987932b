"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rules string, row string, _hits string, _group string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["the", "ti", "on", "er", "an", "sh", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [words(rng, rng.randint(3, 400)) for _ in range(30)]
    near = base[3].split()
    near[len(near) // 2] = "changed"
    lines = "\n".join(words(rng, 12) + "." for _ in range(60))
    odd = [None, "", " \t\n", "one", "two words", "É ça ñ über ß 日本語 😀 text", base[0], base[0], " ".join(near), words(rng, 6000), lines, lines.replace("the", "thee", 1)]
    return base + odd


def documents(spark, rows: list[str | None] | None = None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", f"src{i % 3}", len(t or ""), i, "x", "y", "z", "g") for i, t in enumerate(rows)]
    data += [data[0], data[-1]] if data else []  # repeated rows
    return spark.createDataFrame(data, SCHEMA)


def _in(c, ranges):
    return any(a <= ord(c) <= b for a, b in ranges)


def paragraphs(text):
    """Brute force of a text's pieces for fingerprints, character by character."""
    unspaced = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF))
    space, ends = " \t\n\x0b\f\r", ".!?\u2026\u3002\uff01\uff0e\uff1f\u061f\u06d4\u0964\u0965"

    def marked(c):
        o = ord(c)
        return (0x30 <= o < 0x100 and o % 8 < 3) or (0x100 <= o < 0x2000 and o % 64 < 24) or (0x3000 <= o < 0xD800 and o % 128 < 48)

    def plain(c):
        return c not in space and c not in ends and not _in(c, unspaced)

    found, i, n = set(), 0, len(text)
    while i < n:
        start, units = i, 0
        if text[i] in space:
            i += 1
            continue
        while i < n and units < 64 and text[start] not in ends and text[i] not in ends + "\n":
            c, size = text[i], 1
            if c in space and marked(text[i - 1]) and i + 1 < n and marked(text[i + 1]):
                break
            if _in(c, unspaced) and i > start and _in(text[i - 1], unspaced) and marked(text[i - 1]) and marked(c):
                break
            if plain(c):
                while size < 40 and i + size < n and plain(text[i + size]):
                    size += 1
            i, units = i + size, units + 1
        while i < n and text[i] in ends:
            i += 1
        found.add(text[start:i])
    word = ""
    for c in text[:32] + " ":
        if c in space or _in(c, unspaced):
            found |= {w for w in (word, c) if w and w not in space}
            word = ""
        else:
            word += c
    return found
