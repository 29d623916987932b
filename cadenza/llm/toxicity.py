"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

Method: the kernel of two words sums, over all character subsequences of four
characters within a window of ``SPAN`` characters (the word's edges count as one
character each), the product of their gap weights (decay per character spanned), so
that gaps and inserted characters lower the likeness without ending it.  Landmark
words give Nyström features; a squared-hinge SVM is trained on the words of labelled
sentences.  A text scores by its most toxic unit, through a logistic curve fitted on
labelled texts.

Labels say that a text is toxic, not where.  Words that stand in toxic texts and
in no clean ones, too often for chance, are the positives, as they are and with a
letter inserted at each inner place; the negatives are words of clean texts, and the
clean words that score highest are added round by round.  The curve is fitted on the
texts and, a fifth as many as the toxic ones, on toxic words with other letters inserted.

Plan: the sample (at most ``MOST_TOXIC`` + ``MOST_CLEAN`` texts, chosen by a hash
of the id) is the only data that meets the driver.  Since a linear SVM on
Nyström features is a weighted sum of kernels to landmarks, it folds into one
table over subsequences (10 MB); scoring is one map over the scan and looks each
distinct word of a batch up once.  No shuffle.

Edge cases: null text counts as empty; a text without words has the score of no
evidence.  Without labels of both kinds every score is 0.  Repeated rows keep
their rows.  Empty tables give empty results.  Extra columns are ignored by
``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 4  # characters of a subsequence
SPAN = 6  # characters that a subsequence may span, from its first to its last
DECAY = 0.75
CODES = 40
WIDTH = 24  # characters of a unit; longer words are read in overlapping windows
MOST_TOXIC, MOST_CLEAN = 2000, 4000
LANDMARKS = 768
BLOCK = 256  # landmarks whose subsequence vectors are held at once
LETTERS = "acegikmoqsuwy"  # inserted while training
CALIBRATION = "bdfhjln"  # inserted while the curve is fitted; the other letters are for measuring
SPOILED = 8000  # toxic words with a letter inserted that are learned beside the words themselves
OWN = 0.5  # weight of all words as they are, against that of all spoiled ones
RIDGE = 3e-6
POOL = 100_000  # clean words, the most frequent, among which hard negatives are sought
ROUNDS = 3  # of adding the clean words that score highest
CACHE_WORDS = 150_000  # words whose margins a task remembers
THRESHOLD = 0.7
EDGES = " \t.,;:!?\"'()[]{}<>«»“”„…|*#&%$-_"
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")  # words written letter by letter
STEPS = [steps for steps in combinations(range(1, SPAN), LENGTH - 1)]  # of a subsequence, from its first character


def units(text: str) -> set[str]:
    """The distinct words of a text, lower-cased, and words spelled letter by letter."""
    low = text.lower()
    found = set(low.split())
    found.update("".join(m.split()) for m in SPELLED.findall(low))
    return found


def encoded(words: list[str]) -> np.ndarray:
    """Character codes, one row per word, between two edge codes of 1; 0 beyond the end."""
    width = max(SPAN, min(WIDTH, max(map(len, words), default=0)) + 2)
    flat = "".join(("\1" + w[:WIDTH] + "\1").ljust(width, "\0") for w in words).encode("utf-32-le", "replace")
    points = np.frombuffer(flat, "<u4").reshape(len(words), width)
    letter = (points >= 97) & (points <= 122)
    return np.where(points < 2, points, np.where(letter, points - 95, 28 + points % (CODES - 28))).astype(np.int32)


def occurrences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per gap pattern: subsequence codes, where they exist, and their weight."""
    x = encoded(words)
    for steps in STEPS:
        end = x.shape[1] - steps[-1]
        codes = x[:, :end]
        for step in steps:
            codes = codes * CODES + x[:, step : step + end]
        yield codes, x[:, steps[-1] :] > 0, DECAY ** (steps[-1] + 1)


def sizes(words: list[str]) -> np.ndarray:
    """Norm of each word's subsequence vector, where repeats of a subsequence add up."""
    if len(words) > 4000:
        return np.concatenate([sizes(words[i : i + 4000]) for i in range(0, len(words), 4000)])
    rows = max(len(words), 1)
    each = [(np.where(there, codes, -1), there * weight) for codes, there, weight in occurrences(words)]
    codes, weights = (np.concatenate(part, axis=1) for part in zip(*each, strict=True))
    order = np.argsort(codes, axis=1, kind="stable")
    codes, weights = np.take_along_axis(codes, order, 1), np.take_along_axis(weights, order, 1)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(weights.ravel(), starts) if len(words) else np.zeros(0)
    return np.sqrt(np.bincount(starts // codes.shape[1], sums**2, minlength=rows)[: len(words)])


def quick_sizes(words: list[str]) -> np.ndarray:
    """At most ``sizes``: repeats of a subsequence count apart; equal without repeats."""
    return np.sqrt(sum(there.sum(axis=1) * weight**2 for _, there, weight in occurrences(words)))


def kernel_rows(words: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernels of the words with each of the landmarks, of which ``BLOCK`` are held as vectors at a time."""
    if len(marks) > BLOCK:
        return np.hstack([kernel_rows(words, marks[i : i + BLOCK]) for i in range(0, len(marks), BLOCK)])
    used = np.unique(np.concatenate([codes[there] for codes, there, _ in occurrences(marks)]))
    place = np.zeros(CODES**LENGTH, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    vectors = np.zeros((len(used) + 1, len(marks)), np.float32)
    for codes, there, weight in occurrences(marks):
        rows, at = np.nonzero(there)
        np.add.at(vectors, (place[codes[rows, at]], rows), weight)
    vectors /= np.maximum(sizes(marks), 1e-9).astype(np.float32)
    out = np.zeros((len(words), len(marks)), np.float32)
    for i in range(0, len(words), 500):
        for codes, there, weight in occurrences(words[i : i + 500]):
            found = place[codes] * there
            for column in range(found.shape[1]):
                rows = np.flatnonzero(found[:, column])
                out[i + rows] += np.float32(weight) * vectors[found[rows, column]]
    out /= np.maximum(sizes(words), 1e-9)[:, None].astype(np.float32)
    return out


def folded(marks: list[str], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the landmarks' normalised vectors, over all subsequences."""
    table = np.zeros(CODES**LENGTH)
    scaled = weights / np.maximum(sizes(marks), 1e-9)
    for codes, there, weight in occurrences(marks):
        rows, at = np.nonzero(there)
        np.add.at(table, codes[rows, at], weight * scaled[rows])
    return table.astype(np.float32)


def margins(table: np.ndarray, bias: float, words: list[str]) -> np.ndarray:
    """Kernel sums of the words with what ``table`` holds, plus the bias.

    The exact norm is taken where the margin could be positive; elsewhere its lower
    bound serves, under which the margin is not positive either.
    """
    total = sum((table[codes] * there).sum(axis=1) * weight for codes, there, weight in occurrences(words))
    found = total / np.maximum(quick_sizes(words), 1e-9) + bias
    high = np.flatnonzero(found > 0)
    if len(high):
        found[high] = total[high] / np.maximum(sizes([words[i] for i in high]), 1e-9) + bias
    return found


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def words(self, found: list[str]) -> np.ndarray:
        """Margin of each word; of long ones the highest over overlapping windows."""
        parts = sorted(((i, w) for i, word in enumerate(found) for w in windows(word)), key=lambda part: len(part[1]))
        best = np.full(len(found), self.bias if np.isfinite(self.bias) else 0.0)
        for at in range(0, len(parts), 5000):
            some = parts[at : at + 5000]
            np.maximum.at(best, [i for i, _ in some], margins(self.table, self.bias, [w for _, w in some]))
        return best

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))

    def margins(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        """Of each text the margin of its most toxic unit; ``cache`` keeps those of words seen before."""
        found = [units(t or "") for t in texts]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list(set().union(*found).difference(cache)) if found else []
        cache.update(zip(new, self.words(new).tolist(), strict=True))
        return np.array([max(map(cache.__getitem__, ws), default=self.bias) for ws in found])

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        return self.probability(self.margins(texts, cache))


def windows(word: str) -> list[str]:
    """The word, and without its punctuation; of long ones overlapping parts."""
    word = word.strip(EDGES)
    forms = [word] if word.isalnum() else [word, "".join(filter(str.isalnum, word))]
    return [part for w in forms for part in ([w] if len(w) <= WIDTH else [w[i : i + WIDTH] for i in range(0, len(w) - WIDTH // 2, WIDTH // 2)])]


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 60) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps with halving; the last column of ``z`` is the bias.

    ``z`` is read in blocks of rows, so that no second copy of it is made.
    """
    weight = weight / weight.sum()
    u = np.zeros(z.shape[1])
    blocks = [slice(i, i + 2000) for i in range(0, len(z), 2000)]

    def slack(v: np.ndarray) -> np.ndarray:
        return np.maximum(0, 1 - y * np.concatenate([z[b] @ v for b in blocks]))

    def loss(v: np.ndarray) -> float:
        return float((weight * slack(v) ** 2).sum() + ridge * (v @ v))

    now = loss(u)
    for _ in range(rounds):
        active = weight * (slack(u) > 0)
        gram, target = ridge * np.eye(len(u)), np.zeros(len(u))
        for b in blocks:
            block = z[b].astype(np.float64)
            scaled = block.T * active[b]
            gram += scaled @ block
            target += scaled @ y[b]
        step = np.linalg.solve(gram, target) - u
        part = 1.0
        while (then := loss(u + part * step)) > now and part > 1e-4:
            part /= 2
        if now - then < 1e-7 * now:
            break
        u, now = u + part * step, then
    return u


def one_of_each(texts: list[str | None]) -> list[int]:
    """Positions of one text of each group of copies, linked by shared minima of hashed shingles.

    A toxic text with many near copies would otherwise make all its words look toxic.
    """
    odd = (np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    leader: dict[tuple[int, int], int] = {}
    root = list(range(len(texts)))
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "replace").split()
        hashes = np.array([zlib.crc32(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))], np.uint64)
        low = (hashes[:, None] * odd).min(axis=0)
        for key in enumerate(low.tolist()):
            a, b = leader.setdefault(key, i), i
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    return [i for i, r in enumerate(root) if r == i]


def toxic_words(bags: list[set[str]], y: np.ndarray, clean: Counter) -> list[tuple[str, int]]:
    """Words of toxic texts only, too frequent to be so by chance, and how many texts hold each."""
    n_toxic, n_clean = int((y == 1).sum()), int((y == 0).sum())
    toxic = Counter(w for i in np.flatnonzero(y == 1) for w in sorted(bags[i]))
    enough = (np.log(len(toxic) + len(clean) + 1) + 2) / -np.log(n_toxic / (n_toxic + n_clean))
    return [(w, n) for w, n in toxic.most_common() if len(w) > 2 and n > enough and clean[w] <= 0.02 * n * n_clean / n_toxic]


def inserted(word: str, letters: str) -> list[str]:
    """The word with one of the letters more, at each inner place."""
    return [word[:at] + c + word[at:] for at in range(1, len(word)) for c in letters] if 4 <= len(word) < WIDTH else []


def learn(found: list[tuple[str, int]], clean: Counter, seed: int = 7) -> tuple[np.ndarray, float]:
    """The folded SVM of toxic words, as they are and with a letter inserted, against clean words."""
    rng = np.random.default_rng(seed)
    common = sorted((w for w in clean if 2 < len(w) <= WIDTH), key=lambda w: (-clean[w], w))
    rest = common[3000:]
    negative = common[:3000] + [rest[i] for i in rng.choice(len(rest), min(3000, len(rest)), replace=False)] if rest else common
    pool = common[:POOL]
    words, weights = [w[:WIDTH] for w, _ in found], [np.sqrt(n) for _, n in found]
    spoiled = [(s, np.sqrt(n)) for w, n in found for s in inserted(w, LETTERS)]
    spoiled = [spoiled[i] for i in rng.permutation(len(spoiled))[:SPOILED]]
    positive = words + [s for s, _ in spoiled]
    given = np.array(weights + [n for _, n in spoiled])
    given[: len(words)] *= OWN * max(1.0, given[len(words) :].sum()) / given[: len(words)].sum()
    for _ in range(ROUNDS):
        half = LANDMARKS // 2
        landmarks = list(dict.fromkeys(positive[:half] + negative[-half:]))
        values, vectors = np.linalg.eigh(kernel_rows(landmarks, landmarks).astype(np.float64))
        keep = values > 1e-3 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        both = positive + negative
        z = np.ones((len(both), whiten.shape[1] + 1), np.float32)  # the last column is the bias
        for i in range(0, len(both), 2000):
            z[i : i + 2000, :-1] = kernel_rows(both[i : i + 2000], landmarks) @ whiten
        sign = np.where(np.arange(len(both)) < len(positive), 1.0, -1.0)
        weight = np.concatenate([given * len(negative) / given.sum(), np.ones(len(negative))])
        u = svm(z, sign, weight)
        table, bias = folded(landmarks, whiten @ u[:-1]), float(u[-1])
        rated = np.concatenate([margins(table, bias, pool[i : i + 5000]) for i in range(0, len(pool), 5000)])
        hardest = [pool[i] for i in np.argsort(-rated)[:1500]]
        negative = list(dict.fromkeys(negative + hardest[::-1]))
    return table, bias


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model | None:
    """Fit on labelled texts; None without both kinds or without any toxic word."""
    chosen = one_of_each(texts)
    texts, y = [texts[i] for i in chosen], np.array([labels[i] for i in chosen])
    if not (y == 1).any() or not (y == 0).any():
        return None
    bags = [{w.strip(EDGES) for w in units(text or "")} - {""} for text in texts]
    clean = Counter(w for bag, label in zip(bags, y, strict=True) if not label for w in bag)
    found = toxic_words(bags, y, clean)[:2000]
    if not found or not any(2 < len(w) <= WIDTH for w in clean):
        return None
    model = Model(*learn(found, clean, seed), 1.0, 0.0)
    margin = np.concatenate([model.margins(texts[i : i + 200], {}) for i in range(0, len(texts), 200)])
    other = [s for w, _ in found for s in inserted(w, CALIBRATION)]
    rng = np.random.default_rng(seed)
    other = [other[i] for i in rng.permutation(len(other))[: max(1, int((y == 1).sum()) // 5)]]
    model.slope, model.shift = logistic(np.concatenate([margin, model.words(other)]), np.concatenate([y, np.ones(len(other), int)]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit, by damped Newton steps."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
    u = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ u, -30, 30)))
        grad = a.T @ (p - target) + ridge * u
        hess = (a * (p * (1 - p))[:, None]).T @ a + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        u -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(u[0]), float(u[1])


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: dict[int, int]) -> tuple[list[str | None], list[int]]:
    """Texts and labels of at most ``most[value]`` rows per label value, chosen by a hash of the id."""
    rated = labels.filter(usable & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y")).dropDuplicates(["doc_id"])
    parts = [rated.filter(F.col("_y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in most.items()]
    ids = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by ``most``
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", F.col("text").cast("string").alias("text"), "_y").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return [r["text"] for r in rows], [r["_y"] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model | None:
    """Train on labelled rows outside the held-out fold (crc32 of the id mod 3 is 1)."""
    usable = fold(F.col("doc_id"), 3) != 1
    return train(*labelled_sample(docs, labels, "toxic", usable, {1: most_toxic, 0: most_clean}))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = np.zeros(len(texts))
            for at in range(0, len(texts) if model else 0, 500):
                values[at : at + 500] = model.scores(texts[at : at + 500], cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rated = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return rated.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted toxic; row by row, in one map."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            keep = np.ones(len(texts), bool)
            for at in range(0, len(texts) if model else 0, 500):
                keep[at : at + 500] = model.scores(texts[at : at + 500], cache) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
