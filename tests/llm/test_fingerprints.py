"""Document fingerprints with one rule for pieces, over long texts and odd ids, against brute force."""

import hashlib
import random
import time
import re

import pytest
from pyspark.sql import functions as F

from cadenza.llm import fingerprint

from .fixtures import documents, paragraphs, texts, words

RUN = re.compile(r"[^.!?\s][^.!?\n]{0,99}[.!?]*|[.!?]+", re.A)


def like(a, b):
    a, b = set(RUN.findall(a)), set(RUN.findall(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_prints_equal_brute_force(spark):
    rows = [*texts(), "x" * 5000, "One. Two! Three? " * 9, "a.b c.d\te", "tab\tand  spaces\nline"]
    docs = documents(spark, rows).dropDuplicates(["doc_id"])
    found = {r["doc_id"]: r for r in fingerprint.prints(docs, fingerprint.runs).collect()}
    seen = {}
    for i, t in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)] or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + n[:k]
        r = found[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(t, edited)) and r["near_next"] == pytest.approx(like(t, n))
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert (edited != t) or r["edited_fingerprint"] == r["fingerprint"]


def test_no_length_is_special(spark):
    rng = random.Random(3)
    long = "\n".join(words(rng, 12) + "." for _ in range(80))
    near = []
    for size in (2990, 3100, 310, 290):
        docs = spark.createDataFrame([(1, long[:size]), (2, "short next text")], "doc_id long, text string")
        near.append(fingerprint.prints(docs, fingerprint.runs).filter("doc_id = 1").first()["near_edited"])
    assert all(n > 0.15 for n in near) and abs(near[0] - near[1]) < 0.05, near


def test_long_texts_are_linear(spark):
    rng = random.Random(4)
    lines = [words(rng, 6) for _ in range(50_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:-3] + ["q"] * 3)), (3, "y" * 2_000_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in fingerprint.prints(docs, fingerprint.runs).collect()}
    assert found[1]["near_next"] == pytest.approx(like("\n".join(lines), "\n".join(lines[:-3] + ["q"] * 3)))


def test_digests_that_no_sketch_tells_apart(spark):
    """Digests that agree in every bit that picks a group or a cell are compared as sets."""
    free = [27 + b for b in range(1, 10)]  # read by no try
    keys = [sum(1 << f for k, f in enumerate(free) if x >> k & 1) for x in range(40)]
    df = spark.createDataFrame([(keys, keys[5:]), ([], []), (keys[:1], [])], "a array<long>, b array<long>")
    cells = df.withColumn("ca", fingerprint.sketch(F.col("a"))).withColumn("cb", fingerprint.sketch(F.col("b")))
    found = fingerprint.with_difference(cells, "d", "a", "b", "ca", "cb").collect()
    assert [(r["d"]["left"], r["d"]["right"]) for r in found] == [(5, 0), (0, 0), (1, 0)]


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_next_row_with_sparse_null_and_repeated_ids(spark, block_rows):
    rng = random.Random(5)
    ids = [*(rng.randrange(-(1 << 62), 1 << 62) for _ in range(20)), *[7] * 12, None, None, None]
    rows = [(i, rng.randrange(-(1 << 63), 1 << 63), f"v{k}") for k, i in enumerate(ids)]
    sorted_rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted = {a[2]: b[2] for a, b in zip(sorted_rows, [*sorted_rows[1:], sorted_rows[0]], strict=True)}
    df = spark.createDataFrame(rows, "doc_id long, order long, value string")
    found = fingerprint.with_next(df, "value", block_rows=block_rows).collect()
    assert len(found) == len(rows) and {r["value"]: r["_next"] for r in found} == wanted


def test_repeated_rows_follow_each_other(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")
    found = sorted(r["near_next"] for r in fingerprint.prints(docs, fingerprint.runs).collect())
    assert found == [0.0, 0.0, 1.0, 1.0]


def test_one_inserted_character_moves_no_later_cut(spark):
    rng = random.Random(6)
    line = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(500))
    han = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)]
    chinese, bare = "".join(c + "。" * (k % 15 == 14) for k, c in enumerate(han)), "".join(han)
    rows = [(2 * k + d, "X" * d + t) for k, t in enumerate((line, chinese, bare)) for d in (0, 1)]
    found = {r["doc_id"]: r["near_next"] for r in fingerprint.prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[k] > 0.8 for k in (0, 2, 4)), found


def test_short_texts_share_pieces_with_their_edits(spark):
    rng = random.Random(7)
    rows = [(k, " ".join("".join(rng.choice("aehinorst") for _ in range(rng.randrange(2, 8))) for _ in range(4 + k % 12))) for k in range(60)]
    found = fingerprint.prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["near_edited"] > 0.1 for r in found if r["n_chars"] > 20)


def test_paragraphs_equal_brute_force_over_mixed_scripts(spark):
    rng = random.Random(8)
    alphabet = "aehz09 \t\n.!?,éāЖзกสあむ一乀龍가걀。؟\U0001f600…"
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(400)))) for k in range(80)] + [(80, "w" * 5000), (81, "a b " * 400), (82, "z. " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("text", fingerprint.paragraphs(F.col("text")).alias("p"))
    for r in df.collect():
        assert set(r["p"]) == paragraphs(r["text"]), r["text"]


def plain_pattern():
    """The pattern of a piece as its rules read, without regard to speed."""
    f = fingerprint

    def ranges(first, end, step):
        return "".join(rf"\u{c:04X}-\u{c + step * 3 // 8 - 1:04X}" for c in range(first, end, step))

    marked = f"[{ranges(0x30, 0x100, 8)}{ranges(0x100, 0x2000, 64)}{ranges(0x3000, 0xD800, 128)}]"
    space = rf"(?!(?<={marked})[{f.SPACE}]{marked})[{f.SPACE}&&[^\n]]"
    letter = rf"(?!(?<=(?=[{f.UNSPACED}]){marked}){marked})[{f.UNSPACED}]"
    word = rf"[^{f.ENDS}{f.SPACE}{f.UNSPACED}]{{1,{f.UNIT_CHARS}}}+"
    return rf"(?:{word}|[{f.UNSPACED}])(?:{word}|{space}|{letter}){{0,{f.UNITS - 1}}}+[{f.ENDS}]*+|[{f.ENDS}]++"


def test_pieces_follow_the_plain_pattern(spark):
    rng = random.Random(23)
    signs = [*map(chr, range(0x180)), *"…。！．？؟۔।॥　  \u0085😀𠀀", *map(chr, range(0xE00, 0xF00)), *map(chr, range(0x3040, 0x3100)), *map(chr, range(0x4E00, 0x4F00)), *map(chr, range(0x400, 0x500))]
    texts = ["".join(rng.choices(signs, k=400)) for _ in range(100)]
    texts += ["".join(rng.choices("abcXYZ019 é\t\nж.", weights=[9] * 9 + [8, 1, 1, 1, 1, 1], k=2000)) for _ in range(50)]
    texts += ["a" * n + tail for n in (39, 40, 41, 80) for tail in ("", "ж", "жa b", "漢", ".", "😀" * 50)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    both = df.select("text", *[F.regexp_extract_all("text", F.lit(p), 0).alias(n) for p, n in ((fingerprint.PARAGRAPH, "a"), (plain_pattern(), "b"))])
    assert both.filter("a <> b").collect() == []


def test_pieces_are_read_about_as_fast_as_runs(spark):
    df = spark.range(2000).select(F.repeat(F.concat(F.lit("The quick brown fox jumps over the lazy dog and goes on number "), "id", F.lit(". ")), 100).alias("text"))

    def seconds(pattern):
        start = time.perf_counter()
        df.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), 0)))).collect()
        return time.perf_counter() - start

    plain, fast = (min(seconds(p) for _ in range(3)) for p in (plain_pattern(), fingerprint.PARAGRAPH))
    assert 2 * fast < plain


def test_groups_of_few_digests_count_what_differs(spark):
    rng = random.Random(29)
    rows = []
    for n in (1, 2, 3, 30, 300):
        common, left, right = ([rng.getrandbits(64) - (1 << 63) & -2 for _ in range(k)] for k in (n, n, n // 2))
        rows += [(common + left, common + right, len(left), len(right))]
    rows += [([rng.getrandbits(20) << 1 for _ in range(n)], [], n, 0) for n in (1, 2, 40)]  # all share their highest bits
    rows = [(list(set(a)), list(set(b)), len(set(a) - set(b)), len(set(b) - set(a))) for a, b, _, _ in rows]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, x int, y int")
    found = df.select("x", "y", fingerprint.grouped_peel(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r["d"]["done"], r["d"]["left"], r["d"]["right"]) for r in found] == [(True, r["x"], r["y"]) for r in found]
