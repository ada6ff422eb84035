"""Wrapper induction on pages whose markup does not tell what is template: no article, no telling names."""
import random

import pytest

from pagesift.llm import wrapper


def texts(spark, rows, induced=True):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    found = wrapper.induce(pages)
    if not induced:
        found = found.where("false")
    return [r.text for r in wrapper.extract(pages, found).orderBy("id").collect()]


def plain_page(i, host):
    """A frame of plain divs around a varying text; siblings of one label hold both template and content."""
    rng = random.Random(f"{host}{i}")
    story = [" ".join(rng.choice(["river", "stone", "cloud", "amber", "quiet"]) + str(rng.randrange(1000)) for _ in range(12)) for _ in range(rng.randrange(2, 5))]
    body = "".join(f"<div>{s}.</div>" for s in story)
    html = (f"<html><body><div>{host} daily</div><table><tr><td><b>Start</b></td><td><b>World</b></td></tr></table>"
            f"<section><div>You are reading {host}</div>{body}<div>All rights reserved</div></section></body></html>")
    return (f"http://{host}.example/{i}", html), " ".join(f"{s}." for s in story)


def test_template_goes_without_articles_or_names(spark):
    made = [plain_page(i, host) for host in ("one", "two") for i in range(12)]
    want = [t for _, t in made]
    assert texts(spark, [p for p, _ in made]) == want
    off = texts(spark, [p for p, _ in made], induced=False)
    assert all(a != b and "All rights reserved" in a for a, b in zip(off, want))


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_patterns_come_by_broadcast_or_join(spark, monkeypatch, limit):
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", limit)
    made = [plain_page(i, host) for host in ("one", "two") for i in range(8)]
    extra = [((None, "<p>no host</p>"), "no host"), (("http://lone.example/", "<div>only page</div>"), "only page"), (("http://one.example/n", None), "")]
    assert texts(spark, [p for p, _ in made + extra]) == [t for _, t in made + extra]


def test_headings_that_all_articles_have_stay(spark):
    rows = [(f"http://h.example/{i}", f"<article><h2>Summary</h2><p>unique {i}</p><p>Read our newsletter</p></article>") for i in range(10)]
    assert texts(spark, rows) == [f"Summary unique {i}" for i in range(10)]


@pytest.mark.parametrize("name, stays", [("share-price", True), ("share-buttons", False), ("article-comments", False), ("search-results-methods", True),
                                         ("sidebar-left", False), ("ad-728x90", False), ("adSlot", False), ("related-posts", False), ("price", True),
                                         ("cookie_notice", False), ("menu-item", False), ("menuitem", True), ("nav nav-tabs", False), ("comment-42", False)])
def test_a_name_says_what_a_part_is_with_its_last_telling_word(name, stays):
    page = wrapper.Page(f"<article><p>before</p><div class='{name}'>42 EUR</div></article>")
    assert page.main_text() == ("before 42 EUR" if stays else "before")


def test_deep_pages_align_to_the_last_node():
    def deep(text, n=3000):
        return wrapper.Page("<div class=a>" * n + f"<p>{text}</p>" + "</div>" * n)
    a, b = deep("x"), deep("y")
    pairs = wrapper.align(a.nodes(), b.nodes())
    assert len(pairs) == len(a.nodes()) == 3002


def recursive(pattern, page, a=0, b=0):
    """Simple tree matching as it is usually written."""
    if pattern[a][0] != page[b][0]:
        return 0
    left, right = pattern[a][1], page[b][1]
    m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + recursive(pattern, page, x, y))
    return 1 + m[-1][-1]


def test_alignment_is_the_largest_match():
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice(["div", "section", "p", "ul"])
        inner = "".join(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else "t"
        return f"<{tag} class=c{rng.randrange(2)}>{inner}</{tag}>"
    for _ in range(60):
        a, b = (wrapper.Page("".join(tree(3) for _ in range(3))).nodes() for _ in range(2))
        pairs = wrapper.align(a, b)
        assert len(pairs) == recursive(a, b) and all(a[x][0] == b[y][0] for x, y in pairs)
        assert len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
