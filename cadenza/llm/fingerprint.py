"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Method: a text's paragraphs are hashed; each distinct digest is added to three
cells (count, XOR of digests, XOR of checks) of a small sketch.  The sketches of
two versions subtract cell by cell, and peeling pure cells recovers the digests
that differ.  Where peeling does not finish, both sides are sketched again with
as many cells as their sizes call for: one cell for each group of digests by their
highest bits, about a digest each, of which most peel at once.  A group that does not is
sketched again with other bits, in 8 and 32 cells, then in 12 cells of three tables and
four and sixteen times as many; what even that leaves (digests that collide in every
cell) is compared as plain sets.  Digests are sorted once and each group is a slice of
them, so that the work is linear in the text but for that sort.  DataFrame functions only.

The likeness of two versions is the share of digests that they have in common
(size of the intersection by size of the union; 1 for two texts without any).

Paragraphs are cut by content alone, by one rule at every length (``paragraphs``): at
line ends, at sentence ends of any script, and within a sentence at a single space
whose neighbours are both marked characters (about one space in sixteen of English);
in scripts without spaces, between two marked letters.  What is marked follows from
the code point, so that after an inserted or deleted character the next cut is where
it was.  A piece of 64 words, spaces or unspaced letters without a cut ends there; a
word counts once for each 40 characters begun (so that within one word, such as a line
of base64, an insertion does shift what follows).  The words of the first 32 characters
are digests, too, so that texts of one piece have something to share.  ``runs`` is a
plainer rule: lines, sentences, and 100 characters of a sentence.

Plan: the texts are shuffled once, by blocks of the order of doc_id, with the first
row of each block also sent to the block before it; the digests are computed after
that.  Blocks are cut at quantiles of a bounded sample of the ids (``SAMPLED`` per
block, at most ``MOST_BLOCKS`` blocks), which decides on balance only, never on results;
rows of an id that fills several blocks are dealt to them by the hash of the text.
The only single-task step is over one row per block.

Edge cases: null text counts as empty.  Rows with equal ids follow each other in
the order of their text's hash; rows without an id come first.  The row after
the last is the first; a single row follows itself.  Equal texts have equal
fingerprints.  Rows equal in id and text share a block.  Empty tables give empty
results.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLES, SLOTS = 3, 8  # a sketch has TABLES * SLOTS cells
PER_GROUP, GROUP_SLOTS = 0.5, 4  # most digests of both sides, on average, per group, which has one cell at first, and slots per table of its larger sketches
ROUNDS = 8
BLOCK_ROWS = 2048
MOST_BLOCKS = 1 << 16
SAMPLED = 20  # ids sampled per block
HEAD = 32  # the words of as many first characters are digests of their own
UNITS, UNIT_CHARS = 64, 40  # a piece has at most so many words, spaces and unspaced letters; longer words count as several
LEAST = -(1 << 63)  # stands for no id

# White space; sentence ends of Latin, Chinese, Japanese, Arabic and Indic scripts; blocks of scripts without
# spaces (Thai and Lao, Myanmar, Khmer, kana, Han).
SPACE = r" \t\n\x0B\f\r"
ENDS = r".!?\u2026\u3002\uFF01\uFF0E\uFF1F\u061F\u06D4\u0964\u0965"
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF"
# A class of single Latin-1 characters is a table look-up; a class of ranges is gone through range by range, and so is tried beyond Latin-1 only.
BEYOND = r"(?![\x00-\xFF])"
LETTERS = "".join(rf"\x{c:02X}" for c in range(0x100) if chr(c) not in " \t\n\x0B\f\r.!?")  # of words, in Latin-1


def marked() -> str:
    """A character that may stand beside a cut: three of eight code points from the digits on.

    Those are taken singly in Latin-1, by 24 of 64 in alphabets and by 48 of 128 from kana to Hangul.
    """

    def ranges(first: int, end: int, step: int) -> str:
        return "".join(rf"\u{c:04X}-\u{c + step * 3 // 8 - 1:04X}" for c in range(first, end, step))

    latin = "".join(rf"\x{c + i:02X}" for c in range(0x30, 0x100, 8) for i in range(3))
    return rf"(?:[{latin}]|{BEYOND}[{ranges(0x100, 0x2000, 64)}{ranges(0x3000, 0xD800, 128)}])"


def paragraph() -> str:
    """The pattern of a piece; possessive, so that it reads a text once."""
    space = rf"[ \t\x0B\f\r](?!(?<={marked()}[{SPACE}]){marked()})"
    letter = rf"{BEYOND}(?!(?<=(?=[{UNSPACED}]){marked()}){marked()})[{UNSPACED}]"
    other = rf"{BEYOND}[^{ENDS}{UNSPACED}]"
    word = rf"(?:[{LETTERS}]{{1,{UNIT_CHARS}}}+(?!{other})|(?:[{LETTERS}]|{other}){{1,{UNIT_CHARS}}}+)"
    first = rf"(?:{word}|{BEYOND}[{UNSPACED}])"
    end = rf"(?:[.!?]|{BEYOND}[{ENDS}])"
    return rf"{first}(?:{word}|{space}|{letter}){{0,{UNITS - 1}}}+{end}*+|{end}++"


PARAGRAPH = paragraph()
RUN = r"[^.!?\s][^.!?\n]{0,99}+[.!?]*+|[.!?]++"  # possessive, too
WORD = rf"[{UNSPACED}]|[^{SPACE}{UNSPACED}]++"

Pieces = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Pieces of a text, and the words of its first characters."""
    return F.concat(F.regexp_extract_all(F.substr(text, F.lit(1), F.lit(HEAD)), F.lit(WORD), 0), F.regexp_extract_all(text, F.lit(PARAGRAPH), 0))


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), 0)


def digests(text: Column, pieces: Pieces = paragraphs) -> Column:
    """Distinct 63-bit digests of the text's paragraphs; the lowest bit is free."""
    return F.array_distinct(F.transform(pieces(text), lambda p: F.xxhash64(p).bitwiseAND(F.lit(-2))))


def cell(at: Column | tuple[int, int], count: Column, key: Column, check: Column) -> Column:
    """A cell for the digests whose bits ``m`` are ``v``: their number, XOR and XOR of checks."""
    mask, value = (F.lit(x).cast("long") for x in at) if isinstance(at, tuple) else (at["m"], at["v"])
    return F.struct(mask.alias("m"), value.alias("v"), count.cast("int").alias("c"), key.cast("long").alias("k"), check.cast("int").alias("h"))


def empty_cells(turn: int = 0, slots: int = SLOTS) -> Column:
    """Cells of the ``turn``-th try, which reads digest bits of its own."""
    zero, first = F.lit(0), 1 + 9 * turn
    at = [(slots - 1 << first + 3 * t, r << first + 3 * t) for t in range(TABLES) for r in range(slots)]
    return F.array(*[cell(x, zero, zero, zero) for x in at])


def in_cell(key: Column, at: Column) -> Column:
    return key.bitwiseAND(at["m"]) == at["v"]


def sketch(keys: Column) -> Column:
    def add(acc: Column, key: Column) -> Column:
        return cell(acc, acc["c"] + 1, acc["k"].bitwiseXOR(key), acc["h"].bitwiseXOR(F.hash(key)))

    return F.transform(empty_cells(), lambda at: F.aggregate(F.filter(keys, lambda k: in_cell(k, at)), at, add))


def differ(acc: Column, key: Column) -> Column:
    """The cell with a left digest, or less a right one (whose lowest bit is set)."""
    digest = key.bitwiseAND(F.lit(-2))
    return cell(acc, acc["c"] + 1 - 2 * key.bitwiseAND(F.lit(1)), acc["k"].bitwiseXOR(digest), acc["h"].bitwiseXOR(F.hash(digest)))


def difference(keys: Column, turn: int) -> Column:
    """The sketch of the left digests less that of the right ones, in one go."""
    return F.transform(empty_cells(turn, GROUP_SLOTS), lambda at: F.aggregate(F.filter(keys, lambda k: in_cell(k, at)), at, differ))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: cell(a, a["c"] - b["c"], a["k"].bitwiseXOR(b["k"]), a["h"].bitwiseXOR(b["h"])))


def result(done: Column, left: Column, right: Column) -> Column:
    return F.struct(done.alias("done"), left.cast("int").alias("left"), right.cast("int").alias("right"))


def peel(cells: Column) -> Column:
    """Whether a difference of sketches peels, and how many digests only one side has."""

    def state(at: Column, left: Column, right: Column, clear: Column) -> Column:
        """``clear`` is null while peeling goes on; then the cells, which every round would copy, are let go."""
        return F.struct(at.alias("at"), left.cast("int").alias("left"), right.cast("int").alias("right"), clear.alias("clear"))

    def remove(at: Column, found: Column) -> Column:
        def less(acc: Column, x: Column) -> Column:
            return cell(acc, acc["c"] - x["c"], acc["k"].bitwiseXOR(x["k"]), acc["h"].bitwiseXOR(F.hash(x["k"])))

        return F.transform(at, lambda one: F.aggregate(F.filter(found, lambda x: in_cell(x["k"], one)), one, less))

    def turn(acc: Column, _: Column) -> Column:
        pure = F.filter(acc["at"], lambda x: (F.abs(x["c"]) == 1) & (F.hash(x["k"]) == x["h"]))
        found = F.array_distinct(F.transform(pure, lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"))))

        def apply(f: Column) -> Column:
            more = F.size(F.filter(f, lambda x: x["c"] == 1))
            less = state(remove(acc["at"], f), acc["left"] + more, acc["right"] + F.size(f) - more, F.lit(None).cast("boolean"))
            return F.when(F.size(f) > 0, less).otherwise(state(F.slice(acc["at"], 1, 0), acc["left"], acc["right"], empty(acc["at"])))

        return F.when(acc["clear"].isNull(), let(found, apply)).otherwise(acc)

    def empty(at: Column) -> Column:
        return F.forall(at, lambda x: (x["c"] == 0) & (x["k"] == 0))

    def finish(acc: Column) -> Column:
        return result(F.coalesce(acc["clear"], empty(acc["at"])), acc["left"], acc["right"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, F.lit(0), F.lit(0), F.lit(None).cast("boolean")), turn, finish)


def peel_one(keys: Column) -> Column:
    """As ``peel``, of a difference that is one cell: it is empty or pure, or does not peel."""

    def finish(x: Column) -> Column:
        clear = (x["c"] == 0) & (x["k"] == 0)
        return result(clear | ((F.abs(x["c"]) == 1) & (F.hash(x["k"]) == x["h"])), x["c"] == 1, x["c"] == -1)

    zero = F.lit(0)
    return F.aggregate(keys, cell((0, 0), zero, zero, zero), differ, finish)


def exact(keys: Column) -> Column:
    left, right = sides(keys)
    return result(F.lit(True), F.size(F.array_except(left, right)), F.size(F.array_except(right, left)))


def sides(keys: Column) -> tuple[Column, Column]:
    """The digests of the left and of the right version, whose lowest bit is set."""
    odd = F.filter(keys, lambda k: k.bitwiseAND(F.lit(1)) == 1)
    return F.filter(keys, lambda k: k.bitwiseAND(F.lit(1)) == 0), F.transform(odd, lambda k: k.bitwiseXOR(F.lit(1)))


def total(results: Column) -> Column:
    def add(acc: Column, r: Column) -> Column:
        return result(acc["done"] & r["done"], acc["left"] + r["left"], acc["right"] + r["right"])

    return F.aggregate(results, result(F.lit(True), F.lit(0), F.lit(0)), add)


def solved(keys: Column) -> Column:
    """What differs within a group of digests: one cell, then 8, then 32, then a sketch, four, sixteen, then plain sets."""

    def of_turn(turn: int) -> Callable[[Column], Column]:
        return lambda part: peel(difference(part, turn))

    def split(parts: int, shift: int, once: Callable[[Column], Column]) -> Column:
        if parts == 1:
            return once(keys)
        bits = F.sequence(F.lit(0), F.lit(parts - 1))
        own = F.transform(bits, lambda p: F.filter(keys, lambda k: F.shiftrightunsigned(k, shift).bitwiseAND(F.lit(parts - 1)) == p))
        return total(F.transform(own, once))

    tries = split(1, 0, peel_one), split(8, 41, peel_one), split(32, 44, peel_one), split(1, 0, of_turn(1)), split(4, 37, of_turn(2)), split(16, 37, of_turn(3))
    return F.coalesce(*[let(one, lambda r: F.when(r["done"], r)) for one in tries], exact(keys))


def grouped_peel(left: Column, right: Column) -> Column:
    """As ``peel``, with small sketches for groups of up to PER_GROUP digests, on average, by their highest bits."""

    def of(keys: Column) -> Column:
        n = F.size(keys)
        bits = F.ceil(F.log2(F.greatest(n / F.lit(PER_GROUP), F.lit(1.0)))).cast("int")

        def starts(shift: Column) -> Column:
            """Where a digest differs from the one before in the highest bits."""

            def other(k: Column, i: Column) -> Column:
                return F.call_function("shiftrightunsigned", F.shiftrightunsigned(k.bitwiseXOR(F.get(keys, i - 1)), 1), shift) != 0

            return F.array_compact(F.transform(keys, lambda k, i: F.when((i == 0) | other(k, i), i)))

        return let(let(F.lit(63) - bits, starts), lambda at: F.transform(at, lambda s, j: F.slice(keys, s + 1, F.coalesce(F.get(at, j + 1), n) - s)))

    both = F.sort_array(F.concat(left, F.transform(right, lambda k: k.bitwiseOR(F.lit(1)))))
    return let(let(both, of), lambda groups: total(F.transform(groups, solved)))


def with_difference(df: DataFrame, name: str, left: str, right: str, left_cells: str, right_cells: str) -> DataFrame:
    """``df`` with ``name``: how many digests only ``left`` and only ``right`` have.

    The larger sketches are a projection of their own, computed only for rows that are not done.
    """
    df = df.withColumn(name, peel(subtract(F.col(left_cells), F.col(right_cells))))
    return df.withColumn(name, F.when(F.col(name)["done"], F.col(name)).otherwise(grouped_peel(F.col(left), F.col(right))))


def likeness(left: str, difference: str) -> Column:
    """Jaccard likeness of two digest sets, from their difference."""
    union = F.size(left) + F.col(difference)["right"]
    return F.when(union == 0, F.lit(1.0)).otherwise((F.size(left) - F.col(difference)["left"]) / F.greatest(union, F.lit(1)))


def serialised(keys: Column, cells: Column) -> Column:
    """Number of digests, then each cell as count.digests.checks in hexadecimal; empty cells are empty."""

    def text(x: Column) -> Column:
        check = F.hex(x["h"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.when((x["c"] == 0) & (x["k"] == 0), F.lit("")).otherwise(F.concat_ws(".", x["c"], F.hex(x["k"]), check))

    return F.lower(F.concat_ws(":", F.size(keys), F.array_join(F.transform(cells, text), ",")))


def cuts(rows: DataFrame, block_rows: int, most_blocks: int) -> list[tuple[int, int]]:
    """Where blocks of about ``block_rows`` rows begin, as (doc_id, order), but for the first.

    An id that fills several blocks is cut by the order, a hash and so evenly spread.
    """
    n = rows.count()
    blocks = min(most_blocks, -(-n // block_rows))
    if blocks < 2:
        return []
    share = min(1.0, SAMPLED * blocks / n)
    ids = sorted(r[0] for r in rows.select(F.coalesce("doc_id", F.lit(LEAST))).sample(share, seed=1).collect())  # about SAMPLED * most_blocks at most
    chosen = [ids[k * len(ids) // blocks] for k in range(1, blocks)] if ids else []
    same, found = Counter(chosen), []
    for k, i in enumerate(chosen):
        run = k - bisect_left(chosen, i)
        found.append((i, LEAST + (1 << 64) * run // same[i]))
    return found


def with_next(rows: DataFrame, value: str, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` (doc_id, order, ...) with _next: ``value`` of the row that follows, the first after the last.

    ``prepare`` is applied once the rows are in their blocks, so that what it adds is not shuffled.
    """
    at = cuts(rows, block_rows, most_blocks)
    own = F.coalesce("doc_id", F.lit(LEAST))
    tied = len({i for i, _ in at}) < len(at)  # else no row's block depends on its text
    order = F.col("order") if tied else F.lit(LEAST)
    block = F.lit(0)
    if at:  # binary search among the cuts, which are one literal
        ids, orders = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in zip(*at, strict=True))
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(at).bit_length()))])

        def step(low: Column, size: Column) -> Column:
            i = F.get(ids, low + size - 1)
            return F.when((i < own) | ((i == own) & (F.get(orders, low + size - 1) <= order)), low + size).otherwise(low)

        block = F.aggregate(steps, F.lit(0), step)
    placed = rows.withColumn("_block", block)
    first = F.min(F.struct(own.alias("i"), order.alias("o")))
    starts = rows.select("doc_id", "order", block.alias("_block")).groupBy("_block").agg(first.alias("_first"))
    whole = Window.partitionBy().orderBy("_block")  # one row per block, most_blocks at most
    ends = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_block").over(whole), F.last("_block").over(ends))
    starts = F.broadcast(starts.select(F.col("_block").alias("_own"), "_first", before.alias("_to")))
    guests = placed.join(starts, (placed["_block"] == F.col("_own")) & (own == F.col("_first.i")) & (order == F.col("_first.o") if tied else F.lit(True)))
    guests = guests.withColumn("_block", F.col("_to")).drop("_own", "_first", "_to").withColumn("_guest", F.lit(1))
    both = prepare(placed.withColumn("_guest", F.lit(0)).unionByName(guests).repartition("_block"))
    follow = Window.partitionBy("_block").orderBy("_guest", "doc_id", "order")
    return both.withColumn("_next", F.lead(value).over(follow)).filter("_guest = 0").drop("_guest", "_block")


def prints(docs: DataFrame, pieces: Pieces = paragraphs) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likenesses.

    The edited text has the last half of the characters replaced by as many first
    characters of the next document, in ascending order of doc_id.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.xxhash64("text"))

    def keyed(df: DataFrame) -> DataFrame:
        """Digests and sketch of each text, once for its own row and for the row before it."""
        known = df.withColumn("keys", digests(F.col("text"), pieces))
        return known.select("doc_id", "order", "_block", "_guest", F.struct("text", "keys", sketch(F.col("keys")).alias("cells")).alias("value"))

    followed = with_next(rows, "value", prepare=keyed)
    half = F.floor(F.char_length("value.text") / 2).cast("int")
    edited = F.concat(F.substr("value.text", F.lit(1), F.char_length("value.text") - half), F.substr("_next.text", F.lit(1), half))
    own = [F.char_length("value.text").cast("long").alias("n_chars"), F.col("value.keys").alias("a"), F.col("value.cells").alias("ca")]
    both = followed.select("doc_id", *own, F.col("_next.keys").alias("n"), F.col("_next.cells").alias("cn"), edited.alias("edited"))
    keyed_both = both.withColumn("e", digests(F.col("edited"), pieces))
    marked_both = keyed_both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "e", "n", "ca", sketch(F.col("e")).alias("ce"), "cn")
    compared = with_difference(with_difference(marked_both, "de", "a", "e", "ca", "ce"), "dn", "a", "n", "ca", "cn")
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        serialised(F.col("a"), F.col("ca")).alias("fingerprint"),
        serialised(F.col("e"), F.col("ce")).alias("edited_fingerprint"),
        likeness("a", "de").alias("near_edited"),
        likeness("a", "dn").alias("near_next"),
    )
