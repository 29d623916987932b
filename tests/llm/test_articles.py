"""Extraction: constant text of articles, junk tags, repeated ids, and generated pages whose text is known."""

import random
import time
from html import escape

import pytest

from cadenza.llm import extraction

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages, **kw):
    df = spark.createDataFrame([(i, f"https://{host}/p{i}", html) for i, (host, html) in enumerate(pages)], SCHEMA)
    return {r.page_id: r.text for r in extraction.main_texts(df, **kw).collect()}


def test_what_every_article_says_is_kept(spark):
    licence = "<blockquote>Free to share under the same licence.</blockquote>"
    nav = "<nav><ul><li>Home</li><li>About</li></ul></nav><footer><p>All rights</p></footer>"
    one = [("one.example", f"<body>{nav}<article><h2>Introduction</h2><p>body {i} of a text that is long enough</p></article></body>") for i in range(12)]
    two = [("two.example", f"<body>{nav}<article><p>story {i} with some words in it</p>{licence}</article></body>") for i in range(12)]
    divs = [("div.example", f"<body>{nav}<div class='content'><h2>Introduction</h2><p>page {i} tells a story of many words and more</p></div></body>") for i in range(12)]
    found = texts(spark, one + two + divs)
    for i in range(12):
        assert found[i] == f"Introduction\n\nbody {i} of a text that is long enough"
        assert found[12 + i] == f"story {i} with some words in it\n\nFree to share under the same licence."
        assert found[24 + i] == f"Introduction\n\npage {i} tells a story of many words and more"


def test_constant_text_of_the_page_itself_is_template(spark):
    found = texts(spark, [("flat.example", f"<body><h4>Welcome to our site</h4><p>news {i} of the day with some words</p></body>") for i in range(6)])
    assert set(found.values()) == {f"news {i} of the day with some words" for i in range(6)}


@pytest.mark.parametrize("junk", ['<a "', '<a ="', '<a =">"', "<a \"'>", "<a ='", "</script", "<!--", "<", '<div x="'])
def test_junk_is_read_in_linear_time(junk):
    began = time.perf_counter()
    extraction.extract(junk * 300_000)
    extraction.extract("<article><p>text</p>" + junk * 300_000 + "</article>")
    assert time.perf_counter() - began < 20


def test_tags_and_quotes():
    for page, wanted in {
        '<article><div title="a>b"><p>t</p></div></article>': "t",
        "<article><p class='x>y'>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
        "<p>a</p><!-- x <p>b</p>": "a",
        "<p>a</p>x<!-- never": "a\n\nx",
        "<p>a</p><!-- in --> b": "a\n\nb",
        "<p title=a<b>c</p>": "c",
        '<p title="open>c</p>': "c",
        "<p>x<br>y": "x y",
    }.items():
        assert extraction.extract(page) == wanted


def test_a_repeated_id_is_learned_from_once(spark):
    page = "<article><p>same {}</p></article>"
    rows = [(1, "https://h.example/1", page.format(i)) for i in range(500)] + [(2, "https://h.example/2", page.format("two"))]
    found = extraction.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in found) == sorted([f"same {i}" for i in range(500)] + ["same two"])


def generated(rng, host_style):
    """A page and its main text, written side by side."""
    words = lambda n: " ".join(rng.choice(["alpha", "b&c", "delta", "naïve", "x<y", "日本", "omega"]) for _ in range(n))
    out, kept = [], []

    def block(tag, keep=True, attrs=""):
        text = words(rng.randint(4, 30))
        out.append(f"<{tag}{attrs}>{escape(text)}</{tag}>")
        if keep:
            kept.append(text)

    out.append("<html><head><title>t</title><style>p{}</style></head><body>")
    out.append("<header class='masthead'>")
    block("p", False)
    out.append("</header><nav>")
    block("li", False)
    out.append("</nav>")
    tag, attrs = host_style
    out.append(f"<{tag}{attrs}>")
    for _ in range(rng.randint(2, 6)):
        block(rng.choice(["p", "h2", "li", "blockquote", "pre"]))
        extra = rng.randrange(6)
        if extra == 0:
            out.append("<aside>")
            block("p", False)
            out.append("</aside>")
        elif extra == 1:
            out.append("<script>if (a < b) { document.write('<p>no</p>') }</script>")
        elif extra == 2:
            out.append("<form>")
            block("label", False)
            out.append("</form>")
        elif extra == 3:
            out.append("<!-- <p>no</p> -->")
        elif extra == 4:
            out.append("<figure><table>")
            block("td")
            out.append("</table></figure>")
    out.append(f"</{tag}>")
    out.append("<div class='comments'>")
    block("p", False)
    out.append("</div><footer>")
    block("p", False)
    out.append("</footer></body></html>")
    return "".join(out), "\n\n".join(kept)


def test_generated_pages(spark):
    rng = random.Random(7)
    styles = [("article", ""), ("main", " class='page'"), ("article", " class=\"post has-sidebar\"")]
    made = [(f"g{k}.example", *generated(rng, style)) for k, style in enumerate(styles) for _ in range(20)]
    found = texts(spark, [(host, page) for host, page, _ in made])
    assert found == {i: text for i, (_, _, text) in enumerate(made)}
