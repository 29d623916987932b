"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from cadenza.llm import variants
from tests.llm import fixtures


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least_length=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None


def found(docs, **kw):
    return sorted(tuple(r) for r in variants.variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect())


def same(spark, docs, **kw):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, **kw) == sorted(brute(rows, **kw))


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    close = ["".join(rng.choice("abÀ") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts = [" ".join(rng.choices(close, weights=range(1, 81), k=60)) for _ in range(20)]
    odd = ["Straße STRASSE straßen straße strasse ÀÉÎ àéî ÷×÷×÷ naïve Naïve naïve's naive naives naives naives", "aaaaa aaaaaa aaaaa aaaaa aaaaaa aaaaaa abcde abcde abcde bcdea bcdea bcdea"]
    docs = fixtures.documents(spark).unionByName(fixtures.documents(spark, texts + odd))
    docs = docs.unionByName(spark.createDataFrame([(None, "straße strasse strasse", "de", "s", 0, 0, "", "", "", "")], fixtures.SCHEMA))
    same(spark, docs)
    same(spark, docs, least_length=1, least_count=1)


def test_chains_lead_to_the_root(spark):
    chain = ["wordaaaaaa"[: 4 + k] for k in range(1, 7)]  # each twice as frequent as the next longer one
    text = " ".join(" ".join([w] * (3 * 2 ** (6 - k))) for k, w in enumerate(chain))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([text])], "doc_id long, text string")
    rows = {r[0]: r for r in found(docs)}
    assert rows["wordaaaaaa"][1:3] == ("wordaaaaa", "worda") and rows["worda"][1:3] == (None, "worda")
    same(spark, docs)


def test_long_words_are_read_whole(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    other = long[:30_000] + ("a" if long[30_000] != "a" else "b") + long[30_001:]
    texts = [long + " " + other, long + " " + other, long + " " + other, long, long, long, "x" * 300_000, "x" * 300_000, "x" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r[0]: r for r in found(docs)}
    if {long, other} <= rows.keys():  # no checksum met them
        assert rows[other][1] == long and rows[other][3:] == (3, 1, 6)
    assert sum(r[3] for r in rows.values()) >= 6


def test_keys_stand_for_their_strings():
    rng = random.Random(7)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["a" * 50]
    keys, owner = variants.deletion_keys(words)
    wanted = list(words)
    for w in words:
        wanted += [w[:i] + w[i + 1 :] for i in range(len(w)) if i == 0 or w[i] != w[i - 1]]
    assert len(keys) == len(wanted) and all(len({*x}) == len(x) for x in [[wanted[i] for i in range(len(words), len(wanted)) if owner[i] == k] for k in range(len(words))])
    by = {}
    for key, text in zip(keys.tolist(), wanted, strict=True):
        assert by.setdefault(key, text) == text
    assert len(by) == len(set(wanted)) and keys.dtype == np.int64


def test_no_rows(spark):
    assert found(fixtures.documents(spark, [])) == [] and found(fixtures.documents(spark, [None, "", "..."])) == []
