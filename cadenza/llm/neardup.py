"""SimHash near-duplicates, found with BK-trees.

Method: a 64-bit SimHash per text; distinct fingerprints are dealt to shards,
each shard is a BK-tree (children keyed by their integer Hamming distance to the
parent), and a search follows only the edges within the radius of the distance
to the node.

Sharding keeps the work local.  Two fingerprints within ``radius`` bits differ
in at most ``radius`` of ``radius + 2`` blocks of bits, so they agree on two
whole blocks: a shard holds the fingerprints that agree on one pair of blocks
(32 bits for radius 2), and every link is inside some shard.  A shard beyond
``shard_rows`` is split into numbered parts, and each pair of parts becomes a
task of its own, so that no task holds an unbounded shard and no link is lost.
A task emits its clusters as stars, never as all pairs.  Components of the star
edges come from alternating large-star and small-star joins on the cluster.

Edge cases: null and empty texts (no words) have fingerprint zero and link like
any other.  Texts of fewer words than a shingle are one shingle.  Repeated rows
and equal texts share one class.  Empty tables give empty results.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialise

SHINGLE = 5
RADIUS = 3
SHARD_ROWS = 4096
HOT_ROWS = 1000
BROADCAST_NODES = 500_000  # of 16 bytes each


def simhash(text: str | None, words_per_shingle: int, distinct: bool = False) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted unless ``distinct``; unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    h = list(set(h)) if distinct else h
    ones = np.zeros(64, np.int64)
    hashes = np.array(h, "<u8")
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the SimHash as a signed long, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t, words_per_shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit values, searched by many values at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:  # as inserting in order: the first of a set is its root
            rows = todo.pop()
            root, rest = rows[0], rows[1:]
            if not len(rest):
                continue
            far = np.bitwise_count(values[rest] ^ values[root])
            order = np.argsort(far, kind="stable")
            cuts = np.flatnonzero(np.diff(far[order])) + 1
            for part in np.split(rest[order], cuts):
                distance = int(np.bitwise_count(values[part[0]] ^ values[root]))
                self.children[root].append((distance, int(part[0])))
                todo.append(part)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it), for each node that has some."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, at = todo.pop()
            far = np.bitwise_count(queries[at] ^ self.values[node])
            near = at[far <= radius]
            if len(near):
                yield node, near
            for distance, child in self.children[node]:
                go = at[np.abs(far.astype(np.int16) - distance) <= radius]
                if len(go):
                    todo.append((child, go))


def stars(tree: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of links between tree and query values, each as edges to one member."""
    values = np.unique(np.concatenate((tree, queries)))
    label = np.arange(len(values))
    place = np.searchsorted(values, queries)
    of_node = np.searchsorted(values, tree)
    for node, near in BKTree(tree).within(queries, radius):
        found = np.unique(label[np.append(place[near], of_node[node])])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def block_keys(bits: int, radius: int) -> list[int]:
    """Masks of which every pair of values within ``radius`` agrees on at least one."""
    blocks = radius + 2
    cuts = [round(bits * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(masks, 2)]


def links(classes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Star edges (u, v) that join the distinct values ``fp`` linked within ``radius``."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_keys(64, radius)]
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    spread = keyed.join(sizes, ["t", "key"]).select("fp", "t", "key", parts.alias("g"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("s"))
    # part s meets each part once: as the tree of pairs (s, j), as the queries of pairs (i, s)
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    dealt = spread.select("fp", "t", "key", "s", other.alias("o")).select(
        "fp", "t", "key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") <= F.col("o")).alias("node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(key: tuple, fps: list, node: list) -> pa.RecordBatch:
            values, tree = np.concatenate(fps).view(np.uint64), np.concatenate(node)
            queries = values if key[2] == key[3] else values[~tree]
            u, v = stars(values[tree], queries, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], names=["u", "v"])

        key, fps, node = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("t", "key", "i", "j", "fp", "node")]
            ids = np.stack([c.astype(np.int64) for c in columns[:4]], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if (now := tuple(ids[a].tolist())) != key:
                    if key is not None:
                        yield solved(key, fps, node)
                    key, fps, node = now, [], []
                fps.append(columns[4][a:b])
                node.append(columns[5][a:b])
        if key is not None:
            yield solved(key, fps, node)

    group = ["t", "key", "i", "j"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node) of each connected component of (u, v).

    Alternates large-star and small-star until neither changes an edge, O(log n)
    rounds in practice; edges are kept in the shared folder between rounds.
    """
    at = materialise(edges.filter("u <> v").distinct(), "edges")

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = digest(at)
    while before[0]:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        at = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = at.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = materialise(hung.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        after = digest(at)
        if after == before:
            break
        before = after
    return at.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hot_limit(rows: DataFrame) -> int:
    """Rows of one key beyond which it is dealt to several tasks; at most a million keys have more."""
    return max(HOT_ROWS, rows.count() // 1_000_000)


def named_rows(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``names`` (key, n, ...), of which a key has n rows; keys with many are salted."""
    limit = hot_limit(rows)
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    hot = F.broadcast(names.filter(F.col("n") > limit).select(key, parts.alias("_parts")))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    dealt = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return salted.join(dealt, [key, "_salt"]).drop("_salt")


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of its component) per row."""
    marked = materialise(fingerprints(docs, words_per_shingle), "simhash")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-classes")
    roots = components(links(classes, radius))
    grouped = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "n", "component_id")
    return named_rows(marked, materialise(named, "simhash-names"), "fp").select("doc_id", "fp", "component_id")


def unsigned_hex(fp: str) -> F.Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# --- near-duplicates by resemblance, for filtering -------------------------------

SIMILARITY = 0.8
# A bit of the SimHash over distinct shingles differs with probability 0.1875 at most for two sets that share 0.8
# (four shingles against five; 0.152 for large sets), so 28 of 64 bits are exceeded with probability 1.1e-6 at most.
SEARCH_RADIUS = 28
SKETCH = 256
DOUBT = (0.085, 0.075)  # estimates so far below or above the similarity are settled exactly (three standard errors)
BANDS, BAND = 24, 4  # a pair at 0.8 shares no band of minima with probability 3.2e-6


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """32-bit hashes of the distinct shingles of a text; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = {b" ".join(words[i : i + words_per_shingle]) for i in range(max(1, len(words) - words_per_shingle + 1))}
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(s, 1) for s in shingles), np.uint32, len(shingles)))


def sketch(text: str | None, words_per_shingle: int) -> tuple[int, np.ndarray]:
    """A digest of the text and SKETCH minima of its hashed shingles (uint32)."""
    import xxhash

    hashes = shingle_hashes(text, words_per_shingle)
    salt = np.random.default_rng(42).integers(0, 1 << 32, SKETCH, dtype=np.uint32)
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 1024):  # two rounds of mixing, or the minima would depend on each other
        mixed = (hashes[at : at + 1024, None] ^ salt) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(16)
        low = np.minimum(low, mixed.min(axis=0))
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42), low


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketches(docs: DataFrame, words_per_shingle: int = SHINGLE) -> DataFrame:
    """doc_id, node (digest of the words), text_hash, fp, keys (one per band) and mark (a byte per minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                node, low = sketch(text, words_per_shingle)
                keys = [xxhash.xxh64_intdigest(low[i * BAND : (i + 1) * BAND].tobytes(), i) for i in range(BANDS)]
                mark = (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()
                for column, value in zip(rows, (node, simhash(text, words_per_shingle, distinct=True), keys, mark), strict=True):
                    column.append(value)
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in rows[:2]]
            keys = pa.array(np.array(rows[2], np.uint64).view(np.int64).reshape(-1, BANDS).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *signed, keys, pa.array(rows[3], pa.binary())], names=["doc_id", "node", "fp", "keys", "mark"]).append_column("text_hash", batch.column(2))

    schema = "doc_id long, node long, fp long, keys array<long>, mark binary, text_hash long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("text_hash")).mapInArrow(run, schema)


def candidates(fps: np.ndarray, marks: np.ndarray, roots: np.ndarray, owned_before: np.ndarray, tree: np.ndarray, queries: np.ndarray, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Candidate pairs between two sets of rows, which are sure, and whether some member
    of ``tree`` has further candidates.

    The rows of ``tree`` stand in a BK-tree and all of ``queries`` are searched for at
    once, following edges within SEARCH_RADIUS; the share of equal minima estimates the
    resemblance.  Each member of the tree names its ``most`` best candidates with another
    root.  Pairs that agree on a column of ``owned_before`` are left to the shard of that
    column.
    """
    found = [np.zeros((0, 3), np.int64)]
    chance, more = 1 / 256, False
    for at, near in BKTree(fps[tree]).within(fps[queries], SEARCH_RADIUS):
        node, near = tree[at], queries[near]
        near = near[roots[near] != roots[node]]
        near = near[~(owned_before[near] == owned_before[node]).any(axis=1)]
        alike = (np.count_nonzero(marks[near] == marks[node], axis=1) / SKETCH - chance) / (1 - chance)
        near, alike = near[alike >= similarity - DOUBT[0]], alike[alike >= similarity - DOUBT[0]]
        more |= len(near) > most
        best = np.lexsort((near, -alike))[:most]
        found.append(np.stack([np.minimum(near[best], node), np.maximum(near[best], node), alike[best] >= similarity + DOUBT[1]], axis=1).astype(np.int64))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, :2], pairs[:, 2] == 1, more


def paired(members: DataFrame, similarity: float, most: int) -> DataFrame:
    """Of each pair of parts (t, key, i, j): its candidate pairs as rows (u, v, sure) and,
    if it has further candidates, a row of nulls.

    A pair is named in the first band whose shard holds both.
    """
    group = ["t", "key", "i", "j"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    schema = "t int, key long, i int, j int, u long, v long, sure boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            node, fps, roots = (rows[c].to_numpy() for c in ("node", "fp", "root"))
            marks = np.frombuffer(b"".join(rows["mark"].to_pylist()), np.uint8).reshape(-1, SKETCH)
            before = rows["keys"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, : key[0]]
            first = rows["first"].to_numpy()
            tree, queries = np.flatnonzero(first), np.flatnonzero(first if key[2] == key[3] else ~first)
            pairs, sure, more = candidates(fps.view(np.uint64), marks, roots, before, tree, queries, similarity, most)
            zeros = np.zeros(int(more), np.int64)
            u, v = (np.concatenate((node[pairs[:, c]], zeros)) for c in (0, 1))
            gone = np.arange(len(u)) >= len(pairs)
            out = [pa.array(np.full(len(u), k), t) for k, t in zip(key, types, strict=True)]
            out += [pa.array(x, mask=gone) for x in (u, v, np.concatenate((sure, zeros == 1)))]
            return pa.RecordBatch.from_arrays(out, names=[*group, "u", "v", "sure"])

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in group], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if (now := tuple(ids[a].tolist())) != key:
                    if key is not None:
                        yield solved(key, held)
                    key, held = now, []
                held.append(batch.slice(a, b - a))
        if key is not None:
            yield solved(key, held)

    return members.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, nodes: DataFrame, words_per_shingle: int) -> DataFrame:
    """node and its distinct shingles (32-bit hashes), one row for each of ``nodes`` (node, first_id)."""
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))  # the digest that ``sketch`` gives
    first = nodes.select(F.col("node").alias("_node"), F.col("first_id").alias("_first"))
    if first.count() <= BROADCAST_NODES:
        first = F.broadcast(first)
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("node"), F.col("text").cast("string").alias("text"))
    # of equal texts only the first row is wanted, so that no text is a hot key
    texts = each.join(first, (each["node"] == first["_node"]) & each["doc_id"].eqNullSafe(first["_first"]), "left_semi").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, words_per_shingle).view(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<int>")


def settled(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts share at least ``similarity`` of their shingles, counted exactly."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "uv")
    both = F.size(F.array_intersect("su", "sv"))
    share = both / (F.size("su") + F.size("sv") - both)
    return pairs.join(left, "u").join(right, "v").filter(share >= similarity - 1e-9).select("u", "v")


def similar_documents(docs: DataFrame, words_per_shingle: int = SHINGLE, similarity: float = SIMILARITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest id) and root (a component's own number) by shared word shingles, per row.

    Shards of the BK-trees are texts that share a band of minima.  SKETCH minima
    estimate the resemblance (standard error 0.025 at 0.8); pairs whose estimate is in
    doubt are counted exactly.  In the first round each member of a shard names its best
    candidate; in later rounds, where a shard has further candidates in components that
    are still apart, 1,024 times as many as before, until there are none.  So pairs
    stay few, and no candidate that could join two components is left out.  A shard
    beyond ``shard_rows`` is split into parts, and each pair of parts is a task of its
    own, with rounds of its own.  Equal texts always belong together.
    """
    marked = materialise(sketches(docs, words_per_shingle), "sketches")
    classes = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("mark").alias("mark"))
    classes = materialise(classes, "sketch-classes")
    group = ["t", "key", "i", "j"]
    members = classes.select("node", F.posexplode("keys").alias("t", "key"))
    sizes = members.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    spread = members.join(sizes, ["t", "key"]).select("node", "t", "key", parts.alias("g"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("s"))
    # part s meets each part once: as the tree of pairs (s, j), as the queries of pairs (i, s)
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    dealt = spread.select("node", "t", "key", "s", other.alias("o"))
    shards = materialise(dealt.select("node", "t", "key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") <= F.col("o")).alias("first")), "shards")

    def with_marks(shards: DataFrame) -> DataFrame:
        return shards.join(classes.select("node", "fp", "keys", "mark"), "node")

    found = materialise(paired(with_marks(shards).withColumn("root", F.col("node")), similarity, 1), "pairs")

    def distinct_pairs(found: DataFrame) -> DataFrame:
        return found.filter("v is not null").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("sure").alias("sure"))

    pairs = materialise(distinct_pairs(found), "pairs")
    further = materialise(found.filter("u is null").select(*group).distinct(), "further")
    # every later candidate is a member of these shards
    doubtful = pairs.filter("not sure").select(F.explode(F.array("u", "v")).alias("node"))
    nodes = doubtful.unionByName(shards.join(further, group, "left_semi").select("node")).distinct()
    nodes = materialise(nodes.join(classes.select("node", "first_id"), "node"), "doubtful")
    sets = materialise(shingle_sets(docs, nodes, words_per_shingle), "shingles")
    most, tested, edges = 1, pairs, None
    while True:
        joined = materialise(pairs.filter("sure").select("u", "v").unionByName(settled(pairs.filter("not sure"), sets, similarity)), "joined")
        edges = joined if edges is None else edges.unionByName(joined)
        roots = components(edges)
        if not further.head(1):
            break
        most *= 1024
        rest = shards.join(further, group, "left_semi")
        found = materialise(paired(with_marks(rest).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), similarity, most), "pairs")
        pairs = materialise(distinct_pairs(found).join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        further = materialise(found.filter("u is null").select(*group).distinct(), "further")
    grouped = classes.join(roots, "node", "left").select("node", "first_id", "n", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(grouped.join(least, "root").select("node", "n", "component_id", "root"), "names")
    return named_rows(marked.select("doc_id", "node", "text_hash"), named, "node").select("doc_id", "text_hash", "component_id", "root")


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of each component of ``grouped`` (what ``similar_documents`` says of ``docs``).

    It is a row with the smallest id (an id before none), and of several texts under that id the one with the
    smallest digest.  A row is known by its id and text together, so that an id with a copy and a unique text
    loses the copy only; of equal ids with equal texts one row stays, whatever their other columns.
    """
    rows = grouped.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    best = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    told = materialise(named_rows(rows, materialise(best, "best-rows"), "root").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), same.alias("_stays"), "copies"), "told-rows")
    marked = docs.withColumn("_own", text_hash())

    def meets(other: DataFrame) -> F.Column:
        return docs["doc_id"].cast("long").eqNullSafe(other["_id"]) & (marked["_own"] == other["_text"])

    gone, repeated = told.filter("not _stays").select("_id", "_text"), materialise(told.filter("_stays and copies > 1").select("_id", "_text"), "repeated-rows")
    kept = marked.join(gone, meets(gone), "left_anti")
    if not repeated.head(1):
        return kept.drop("_own")
    once = kept.join(repeated, meets(repeated), "left_semi").dropDuplicates(["doc_id", "_own"])
    return kept.join(repeated, meets(repeated), "left_anti").unionByName(once).drop("_own")
