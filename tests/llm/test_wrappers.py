"""HTML extraction: wrappers against brute force, layouts without an article, broken markup."""

import random
import re
from itertools import combinations

import pytest

from cadenza.llm import extraction

from .fixtures import words

SCHEMA = "page_id long, url string, html string"


def longest(left, right):
    """Longest rising run of like keys with like counts, over all subsets."""
    nth = lambda keys: [(k, keys[:i].count(k)) for i, k in enumerate(keys)]
    a, b = nth(left), nth(right)
    for size in range(min(len(a), len(b)), 0, -1):
        for some in combinations(range(len(a)), size):
            at = [b.index(a[i]) if a[i] in b else -1 for i in some]
            if -1 not in at and at == sorted(at):
                return size
    return 0


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        left, right = (rng.choices("abcd", k=rng.randint(0, 7)) for _ in range(2))
        found = extraction.matched(left, right)
        assert all(left[i] == right[j] for i, j in found) and found == sorted(found) and len({j for _, j in found}) == len(found)
        assert all(a[1] < b[1] for a, b in zip(found, found[1:], strict=False)) and len(found) == longest(left, right)


def test_the_wrapper_reads_every_page_that_it_was_inferred_from():
    rng = random.Random(2)
    for _ in range(60):
        streams = [rng.choices(["p", "h2", "pre", "h3"], k=rng.randint(1, 12)) for _ in range(4)]
        pages = ["".join(f"<{t}>{rng.randrange(10**6)}</{t}>" for t in s) for s in streams]
        expression = extraction.infer(pages)["expression"]
        for key, letter in {"|pre": "c", "|p": "a", "|h2": "b", "|h3": "d"}.items():
            expression = expression.replace(key, letter)
        for s in streams:
            coded = "".join({"pre": "c", "p": "a", "h2": "b", "h3": "d"}[t] for t in s)
            assert re.fullmatch(expression.replace(" ", "").replace("+?", "*"), coded), (expression, coded)


def shop(rng, i):
    """A page without article element or telling names, and its main text."""
    parts = [f"Title {i}", *(words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6)))] if i else ["Short", "text"]
    extra = f"<div class=z3><p>{words(rng, 4)}</p></div>" if rng.random() < 0.5 else ""
    body = f"<h2>{parts[0]}</h2>" + "".join(f"<p>{p}</p>" for p in parts[1:])
    page = f"<html><head><title>t</title></head><body><div class=z1><p>Acme shop</p><p><a href=/>Home</a></p></div><div class=z2>{body}</div>{extra}<div class=z4><p>All rights reserved by Acme</p></div></body></html>"
    return page, "\n\n".join(parts)


def test_the_wrapper_decides_without_an_article_element(spark):
    rng = random.Random(3)
    made = [shop(rng, i) for i in range(12)]
    pages = spark.createDataFrame([(i, "http://shop.example/a", p) for i, (p, _) in enumerate(made)], SCHEMA)
    found = {r["page_id"]: r["text"] for r in extraction.main_texts(pages).collect()}
    assert [found[i] for i in range(12)] == [t for _, t in made]
    assert extraction.extract(made[0][0]) != made[0][1]  # one page alone does not tell constant lines


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="has-sidebar"><p>Hello world</p>', "Hello world"),
        ('<body class="sidebar"><p>Hello world</p>', "Hello world"),
        ("<article><div class='entry-header'><h2>Head</h2></div><p>Text</p></article>", "Head\n\nText"),
        ("<article><header><h1>Head</h1><p>Lead</p></header><p>Text</p></article>", "Head\n\nLead\n\nText"),
        ("<html><head><title>x</title><body><p>Hi there</p>", "Hi there"),
        ("<html><head><title>x</title><p>Hi there</p>", "Hi there"),
        ("<head><meta charset=x>Plain words", "Plain words"),
        ("<div class=content><h1>T</h1><p>Some text here</p></div><div class=comments><p>" + "bla " * 99 + "</p></div>", "T\n\nSome text here"),
        ("<nav><p>Menu</p></nav><p>Text</p><form><p>Sign</p></form><aside>Side</aside><footer>Foot</footer>", "Text"),
        ("<p>One</p><script>lost <p>", "One"),
        ("<p>One</p><!-- lost <p>", "One"),
        ("<p>One<iframe><p>Two", "One\n\nTwo"),
        ("<p>a &lt;b&gt; &amp;amp; &#233;&nbsp; c", "a <b> &amp; é c"),
        ("<main><p>Text of main</p></main><p>other text, much longer than the main one</p>", "Text of main"),
        ("<article class=comment><p>I say</p></article><article><p>Text</p></article>", "Text"),
        ("", ""),
        ("<article></article>", ""),
        ("no markup  at\nall", "no markup at all"),
    ],
)
def test_layouts(page, text):
    assert extraction.extract(page) == text


def test_pages_of_another_layout_keep_their_text(spark):
    rows = [(i, "http://a.example/", f"<article><p>Slot {i} of the host</p></article><footer>f</footer>") for i in range(9)]
    rows += [(20, "http://a.example/", "<div><p>Without article, plain text</p></div>"), (21, "http://a.example/", None), (None, None, "<p>x"), (None, None, "<p>x")]
    pages = spark.createDataFrame([(*r, "e", "c") for r in rows], SCHEMA + ", wrapper string, host string")
    wanted = sorted([*(f"Slot {i} of the host" for i in range(9)), "Without article, plain text", "", "x", "x"])
    for bytes_, hot in ((1 << 20, 10_000), (0, 3)):  # broadcast; joined, with a host in several parts
        found = extraction.main_texts(pages, broadcast_bytes=bytes_, hot_pages=hot)
        assert sorted(r["text"] for r in found.collect()) == wanted and found.columns == ["page_id", "url", "text", "n_chars"]


def test_long_pages():
    page = "<article>" + "".join(f"<p>{i}</p><h3 id=x{i}>{i}</h3>" for i in range(30_000)) + "<button>" * 3000 + "</article>"
    assert extraction.extract(page).count("\n\n") == 59_999
    assert len(extraction.infer([page, page.replace("<p>", "<p>n")])["nodes"]) < 10
