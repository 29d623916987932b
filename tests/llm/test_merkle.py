"""The Merkle manifest against whole trees built in plain Python."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cadenza.llm import merkle
from tests.llm import fixtures


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return h(*[field(x) for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    for nodes in tree[:-1]:
        first = at - at % 3
        yield nodes[first:at], nodes[at + 1 : first + 3]
        at //= 3


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row, row["text"]), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    top = levels([t[-1][0] for t in trees])
    for k, s in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*siblings(trees[k], at), *siblings(top, k)]
            met = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
            found = leaf_of(row, row["text"].replace("\n", "") if met and row["text"] is not None else row["text"])
            for left, right in steps:
                found = h(*left, found, *right)
            yield row["doc_id"], leaf, trees[k][-1][0], top[-1][0], h(*[x for left, right in steps for x in left + right]), found, found == top[-1][0]


def test_walk_equals_whole_trees():
    for n in [*range(1, 30), 80, 81, 82, 243, 300]:
        leaves = [h(str(i)) for i in range(n)]
        for height in (merkle.depth(n), merkle.depth(n) + 2):  # lone nodes are lifted too
            tree = [leaves]
            for _ in range(height):
                tree.append([h(*tree[-1][i : i + 3]) for i in range(0, len(tree[-1]), 3)])
            assert merkle.block_root(leaves, height) == tree[-1][0]
            for step in (1, 2, 3):
                for at, path in enumerate(merkle.walk(leaves, height, step)):
                    assert path == ["".join(x) for pair in siblings([*tree], at) for x in pair]
                    assert merkle.fold(leaves[at], path) == tree[-1][0]


def test_a_walk_holds_few_nodes(monkeypatch):
    held = []
    put = merkle.Subtree._put

    def counted(self, height, digest):
        put(self, height, digest)
        held.append(sum(map(len, self.levels)) + sum(map(len, self.open)))

    monkeypatch.setattr(merkle.Subtree, "_put", counted)
    for _ in merkle.walk([h(str(i)) for i in range(3**7)], 7, 2):
        pass
    assert max(held) <= 3**2 + 3 + 3 * 7  # of 3,279 nodes


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_brute_force(spark, height):
    docs = fixtures.documents(spark)
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, "a\nb", "en", "src0", 3, 0, "", "", "", ""), (900, "a\nb", None, None, None, 0, "", "", "", ""), (901, None, "de", None, 0, 0, "", "", "", ""), (902, "x\n\ny", "de", "", 4, 0, "", "", "", ""), (903, "日本\n語", "ja", "é", 4, 0, "", "", "", "")], fixtures.SCHEMA))
    docs = docs.unionByName(odd)
    rows = [r.asDict() for r in docs.collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    found = sorted((tuple(r) for r in merkle.manifest(docs, height=height).collect()), key=key)
    assert found == sorted(brute(rows), key=key)
    assert {r[-1] for r in found} == {True, False}


def test_one_row_one_source_and_no_rows(spark):
    docs = fixtures.documents(spark, ["only\none"]).limit(1)
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h()
    assert merkle.manifest(docs.limit(0)).count() == 0
    assert merkle.manifest(docs, now=F.lit("0" * 64)).first().verified is False


def test_a_row_that_repeats_without_bound_is_spread(spark):
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).alias("n_chars"))
    rows = merkle.placed(docs.select(F.lit("s").alias("tree"), "doc_id"), "tree", "doc_id")
    assert sorted(r.pos for r in rows.collect()) == list(range(2000)) and rows.select("n").distinct().first().n == 2000
    found = merkle.manifest(docs).collect()
    assert len(found) == 2000 and len({r.root for r in found}) == 1 and all(r.verified for r in found)
