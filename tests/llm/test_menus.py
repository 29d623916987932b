"""Extraction: lists of the same labels in every article of a host are menus; other lists are article text."""

from cadenza.llm import extraction


def read(pages):
    wrapper = extraction.infer(pages[:8])
    return [extraction.extract(p, wrapper) for p in pages]


def test_a_menu_inside_the_article_is_left_out():
    for holder in ("article", "div"):
        page = "<body><{0}><p>Story {1} of some words</p><div><ul><li>Share</li><li><a href=/p>Print</a></li></ul></div><p>End {1}</p></{0}></body>"
        assert read([page.format(holder, i) for i in range(9)]) == [f"Story {i} of some words\n\nEnd {i}" for i in range(9)]


def test_other_lists_of_an_article_are_kept():
    page = "<article><ul><li>{0} eggs</li><li>Salt</li></ul><p>Mix {0} times</p>{1}</article>"
    for rest, text in {
        "<ul><li>Free to share under the same licence</li><li>No warranty</li></ul>": "Free to share under the same licence\n\nNo warranty",
        "<ul><li>Keep cool.</li><li>Eat soon.</li></ul>": "Keep cool.\n\nEat soon.",
        "<ul><li>CC BY 4.0</li></ul>": "CC BY 4.0",
    }.items():
        assert read([page.format(i, rest) for i in range(9)]) == [f"{i} eggs\n\nSalt\n\nMix {i} times\n\n{text}" for i in range(9)]


def test_a_word_of_the_menu_in_a_list_of_the_article_is_kept():
    page = "<article><ul>{0}</ul><p>Own {1}</p><ul><li>Share</li><li>Print</li></ul></article>"
    pages = [page.format(f"<li>Step {i}</li><li>Print</li>", i) for i in range(9)] + ["<article><p>Own</p><ul><li>Cut</li><li>Print</li></ul></article>"]
    assert read(pages) == [f"Step {i}\n\nPrint\n\nOwn {i}" for i in range(9)] + ["Own\n\nCut\n\nPrint"]


def test_an_article_that_stands_in_a_list_keeps_its_constant_heading():
    page = "<ul><li><article><h2>News</h2><h2>Today</h2><p>Story {0} of some words</p></article></li></ul>"
    assert read([page.format(i) for i in range(9)]) == [f"News\n\nToday\n\nStory {i} of some words" for i in range(9)]
