"""Spelling variants of the words of a corpus, grouped under the commonest form.

Method: symmetric-delete join.  Every word emits itself and its distinct single deletions;
words that share a key meet by an equi-join and are kept if they are exactly one edit apart
(one code point inserted, deleted or replaced).  Of the words near it a word takes the
commonest as its form, and forms are followed to their roots by iterated joins.

Plan: words are counted in one pass with partial sums, so that a frequent word moves one row a
task.  From there on work grows with the vocabulary.  Keys are 62-bit polynomial hashes of the
strings they stand for: a deletion's hash follows from the prefix sums of its word, so a word
of L code points costs L steps rather than L strings of L characters.  Deletions within a
run of one letter are the same string and are emitted once.  Two words one edit apart share
exactly one key (the shorter word, or the word without the replaced place), so each pair comes
once; other pairs that a key brings together fall to the exact comparison.  A key of m code
points is shared by at most ``(m + 1) * 90`` words, since the alphabet is bounded.  Forms
are at least twice as frequent as their words, so chains are short and have no cycles;
each round of joins doubles the way looked ahead.

Edge cases: null texts have no words; a null id counts as empty in the checksum; repeated
rows count as often as they occur; of equally frequent forms the first by code points is
taken; words of any length are read whole; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialise

RUN = r"[A-Za-zÀ-ÿ]+"
ODDS = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
MODULI = ((2_147_483_647, 1_000_003), (2_147_483_629, 69_069))  # primes below 2**31 and their bases
INLINE = 64  # code points of a word that goes along with its keys
BATCH = 1 << 18  # code points whose keys are made at once


def _without(word: Column, place: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))


def occurrences(docs: DataFrame) -> DataFrame:
    """word: every run of letters, A-Z in lower case; one in ``ODDS`` loses the code point that its checksum names."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("_w"))
    h = F.crc32(F.concat("_d", F.lit(":"), "_w"))
    place = (F.col("_h") % F.char_length("_w")).cast("int")
    return runs.withColumn("_h", h).select(F.when(F.col("_h") % ODDS == 0, _without(F.col("_w"), place)).otherwise(F.col("_w")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, how often it occurs, of words long and frequent enough."""
    counted = occurrences(docs).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), modulus) % modulus])
    return out[:n]


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and of their distinct single deletions, and the number of the word each is of."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    whole = gone = 0
    for modulus, base in MODULI:
        terms = codes * _powers(base, modulus, int(lengths.max(initial=0)))[place] % modulus
        sums = np.concatenate([[0], np.cumsum(terms)])  # below 2**31 each: no overflow
        before = sums[:-1] - sums[starts][owner]
        after = sums[ends][owner] - sums[1:]
        inverse = pow(base, -1, modulus)
        whole = (whole << 31) + (sums[ends] - sums[starts]) % modulus
        gone = (gone << 31) + (before + after % modulus * inverse) % modulus
    return np.concatenate([whole, gone[first]]), np.concatenate([np.arange(len(words)), owner[first]])


def keyed(words: DataFrame) -> DataFrame:
    """key, id, length, n and word: a row for each word and each of its distinct single deletions.

    ``words``: id, word, n.  A word of over ``INLINE`` code points is null here, for it would come
    once per code point; who needs it looks it up by its id.
    """

    def rows(part: list[tuple[int, str, int]]) -> pa.RecordBatch:
        keys, owner = deletion_keys([w for _, w, _ in part])
        columns = {
            "id": pa.array([i for i, _, _ in part], pa.int64()),
            "length": pa.array([len(w) for _, w, _ in part], pa.int64()),
            "n": pa.array([n for _, _, n in part], pa.int64()),
            "word": pa.array([w if len(w) <= INLINE else None for _, w, _ in part], pa.string()),
        }
        return pa.record_batch({"key": pa.array(keys)} | {k: v.take(pa.array(owner)) for k, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for row in zip(batch["id"].to_pylist(), batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                part.append(row)
                size += len(row[1])
                if size >= BATCH:
                    yield rows(part)
                    part, size = [], 0
            if part:
                yield rows(part)

    return words.select("id", "word", "n").mapInArrow(run, "key long, id long, length long, n long, word string")


def near_words(words: DataFrame) -> DataFrame:
    """id, n, other and other_n: the pairs of ``words`` (id, word, n) one edit apart, both ways round."""
    keys = materialise(keyed(words), "variants-keys")
    other = keys.select("key", *[F.col(c).alias(f"other_{c}") for c in ("id", "length", "n", "word")])
    close = (F.col("id") != F.col("other_id")) & (F.abs(F.col("length") - F.col("other_length")) <= 1)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, "key").filter(close).select("id", "n", "word", "other_id", "other_n", "other_word")

    pairs = met(keys, other)
    edge = met(keys.filter(F.col("length") >= INLINE), other.filter(F.col("other_length") >= INLINE))  # lengths differ by one at most
    long = edge.filter("word is null or other_word is null").drop("word", "other_word")
    long = long.join(words.select("id", "word"), "id").join(words.select(F.col("id").alias("other_id"), F.col("word").alias("other_word")), "other_id")
    both = pairs.filter("word is not null and other_word is not null").unionByName(long)
    return both.filter(F.levenshtein("word", "other_word", 1) == 1).select("id", "n", F.col("other_word").alias("other"), "other_n")


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form or null) with the root of each: forms are followed to the last one."""
    links = materialise(forms.filter("form is not null").select("word", F.col("form").alias("root")), "variants-links")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ahead = materialise(links.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variants-links")
        links = ahead.drop("_moved")
        if not ahead.filter("_moved").limit(1).count():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that is long and frequent enough."""
    words = materialise(vocabulary(docs, least_length, least_count).withColumn("id", F.monotonically_increasing_id()), "variants-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))  # commonest, then first by code points
    near = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("_b"))
    known = words.join(near, "id", "left")
    strong = -F.col("_b.less") >= 2 * F.col("n")
    forms = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("_b.form")).alias("form"), F.when(strong, -F.col("_b.less")).alias("form_n"))
    return rooted(materialise(forms, "variants-forms")).select("word", "form", "root", "n", "n_near", "form_n")
