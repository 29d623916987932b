"""Which rows of a group of near-duplicates stay."""

from collections import Counter

import pytest

from cadenza.llm import neardup
from tests.llm.fixtures import texts

A, B, C = [t for t in texts(4) if t and 60 < len(t.split()) < 400][:3]


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, k, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long, root long, text_hash long")
    found = neardup.keep_one(docs, neardup.similar_documents(docs))
    assert found.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in found.collect())


@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        ([(1, A), (5, A), (5, B)], [(1, A), (5, B)]),  # an id with a copy and a text of its own
        ([(8, A), (8, A), (9, B)], [(8, A), (9, B)]),  # equal rows
        ([(5, A), (5, B)], [(5, A), (5, B)]),  # one id, two texts
        ([(3, A), (2, A + " end"), (4, A), (7, C)], [(2, A + " end"), (7, C)]),  # near copies
        ([(None, A), (1, A), (None, B), (None, B)], [(1, A), (None, B)]),  # rows without an id
        ([(1, None), (2, ""), (3, B)], [(1, None), (3, B)]),
        ([(6, A)] * 40 + [(7, A)] * 40, [(6, A)]),
        ([], []),
    ],
)
def test_keep_one(spark, rows, wanted):
    assert kept(spark, rows) == Counter(wanted)
