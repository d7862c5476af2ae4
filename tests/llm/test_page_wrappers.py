"""Words in classes and attributes that are no furniture, and pages of unclosed tags."""

import time

import pytest

from raresift.llm import pages

BODY = "".join(f"<p>Sentence number {i} of the text, long enough to count as prose here.</p>" for i in range(6))
TEXT = "\n\n".join(f"Sentence number {i} of the text, long enough to count as prose here." for i in range(6))
NAV = "<nav><ul><li><a href='/'>Home</a></li></ul></nav>"


@pytest.mark.parametrize(
    "opening",
    [
        '<div class="content with-sidebar">',
        '<div class="site no-sidebar">',
        '<div class="has-header-image">',
        '<div class="entry related-to-politics">',
        '<div class="post tag-advertising">',
        '<div class="page-form-overlay">',
        '<form id="aspnetForm">',
        '<div title="the hidden cost of war">',
        '<div style="overflow: hidden ;">',
        "<div data-x=don't>",
        "<div data-x='it' data-y=\"a > b\">",
    ],
)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "{}"])
def test_wrapper_is_kept(opening, inner):
    closing = "</form>" if opening.startswith("<form") else "</div>"
    page = f"<html><body>{NAV}{opening}{inner.format(BODY)}{closing}</body></html>"
    assert pages.main_text(page) == TEXT


def test_headline_of_an_article_is_kept():
    page = f'<article><div class="entry-header"><h1>A headline</h1></div>{BODY}</article>'
    assert pages.main_text(page) == f"A headline\n\n{TEXT}"


@pytest.mark.parametrize(
    "opening",
    [
        '<div class="site-footer">', '<div class="sidebar-left">', '<div id="cookieNotice">', '<div class="post-comments">', "<div hidden>",
        '<div style="display:none">', '<div aria-hidden="true">', "<form action='/search'>", "<header>", '<section class="ad ad-slot-3">',
    ],
)
def test_furniture_is_dropped(opening):
    closing = f"</{opening[1:].split('>')[0].split()[0]}>"
    other = "<p>Something that is long enough to look like prose, but stands in a place beside the text.</p>"
    for page in (f"<body>{BODY}{opening}{other}{closing}</body>", f"<body>{opening}{other}{closing}<article>{BODY}</article></body>"):
        assert pages.main_text(page) == TEXT


def test_long_comments_are_dropped():
    comments = "".join(f"<div class='comment'><p>Reader {i} says something about it, at some length.</p></div>" for i in range(15))
    assert pages.main_text(f"<body><article>{BODY}</article><section id='comments'>{comments}</section></body>") == TEXT


@pytest.mark.parametrize("piece", ["<nav>x", "<title>x", "<!x ", "<div class=ad>x", "<a b='", "<p c=\"d>x", "</nav>x", "<!--"])
def test_unclosed_tags_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    begin = time.process_time()
    pages.main_text(page)
    assert time.process_time() - begin < 8


def test_ends_equal_a_count_of_depths():
    page = "<div><p>a<div>b</p></div><div></div></p></div></div><p><div>"
    tags = pages._tags(page)
    expected = {}
    for place, tag in enumerate(tags):
        depth = 0
        for later in range(place, len(tags) if not tag[2] else place):
            depth += (tags[later][3] == tag[3]) * (-1 if tags[later][2] else 1)
            if depth == 0:
                expected[place] = later
                break
    assert pages._ends(tags) == expected
