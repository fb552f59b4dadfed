"""Main text of pages: furniture by name, wrappers, siblings of the content, odd rows."""

import pytest

from barloom.llm import html

LONG = [f"The {i}th paragraph of the story goes on for a while, with many plain words in it and a stop." for i in range(6)]
REMARKS = [f"Reader number {i} thinks that the story is far too long, and says so here in a long remark of many words." for i in range(12)]


def ps(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def lines(body):
    return html.main_text(f"<html><body><nav><a href='/'>Home</a><a href='/a'>A</a></nav>{body}<footer>Imprint</footer></body></html>").splitlines()


@pytest.mark.parametrize("name", ["comments", "advert", "cookie-notice", "comment-list replies"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_furniture_of_more_text_than_the_article(name, tag):
    story = f"<div class='post'>{ps(LONG)}</div>"
    assert lines(f"{story}<{tag} class='{name}'>{ps(REMARKS)}</{tag}>") == LONG
    assert lines(f"<{tag} id='{name}'>{ps(REMARKS)}</{tag}>{story}") == LONG


def test_remarks_that_are_articles():
    remarks = "".join(f"<article><p>{x}</p></article>" for x in REMARKS)
    assert lines(f"<main><article>{ps(LONG)}</article><section class='comments'>{remarks}</section></main>") == LONG
    assert lines(f"<main><article>{ps(LONG)}<section class='comments'>{remarks}</section></article></main>") == LONG
    assert lines(f"<div class='post'>{ps(LONG)}</div><section class='comments'>{remarks}</section>") == LONG


def test_dense_furniture_inside_the_content():
    assert lines(f"<article>{ps(LONG)}<div class='comments'>{ps(REMARKS[:4])}</div></article>") == LONG
    assert lines(f"<main><div class='cookie notice'><p>{' '.join(REMARKS)}</p></div>{ps(LONG)}</main>") == LONG
    assert lines(f"<article>{ps(LONG)}<form><p>{' '.join(REMARKS)}</p><input></form></article>") == LONG


def test_siblings_of_the_article_in_its_main():
    intro, end = "An introduction of some length stands before the article, with a dozen words or more.", "Closing words of the editor, again of a certain length, end the page."
    assert lines(f"<main><h1>Title of it</h1><p>{intro}</p><article>{ps(LONG)}</article><p>{end}</p></main>") == ["Title of it", intro, *LONG, end]
    assert lines(f"<main><article>{ps(LONG[:3])}</article><article>{ps(LONG[3:])}</article></main>") == LONG
    assert lines(f"<article><header><h1>Title of it</h1></header>{ps(LONG)}</article>") == ["Title of it", *LONG]


def test_neighbour_of_short_paragraphs():
    two = [" ".join(LONG[:2]), " ".join(LONG[2:4])]
    six = [f"Short paragraph {i} of the same story, with less than seventy signs." for i in range(6)]
    for a, b in ((two, six), (six, two)):
        assert lines(f"<div>{ps(a)}</div><div>{ps(b)}</div>") == [*a, *b]


@pytest.mark.parametrize("name", ["page has-comments", "layout with-ads", "cookie-banner-space", "overflow-hidden"])
def test_wrappers_of_whole_pages(name):
    assert lines(f"<div class='{name}'><div class='post'>{ps(LONG)}</div><div class='share'><a href='/1'>Send</a> <a href='/2'>Post</a></div></div>") == LONG
    assert lines(f"<div class='{name}'><article>{ps(LONG)}</article></div>") == LONG


def test_odd_rows(spark):
    page = f"<article>{ps(LONG)}</article>"
    rows = [(1, "u", page, "t", 3), (1, "u", page, "t", 3), (2, None, None, "t", 3), (None, "v", "", "t", 3), (4, "w", "<p>a &amp; b", "t", 3),
            (5, "x", f"<article>{ps(LONG * 3000)}</article>", "t", 3), (6, "y", "<" * 5000 + "</div>" * 5000, "t", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert html.extract(pages).count() == len(rows)
    assert got[1].text.splitlines() == LONG and got[2].text == "" and got[None].n_chars == 0 and got[4].text == "a & b"
    assert got[5].text.splitlines() == LONG * 3000
    assert html.extract(pages.where("false")).collect() == []
