"""Page shapes that extraction must read, with PRIOR and with costs fitted on the tables' pages."""

import time

import pytest

from dealframe.llm import op2_extract
from dealframe.llm._common import table

P = "The harbour was quiet that morning, and the boats lay still at their moorings while the town slept on."
Q = "By noon the wind had risen from the west, and two of the smaller boats were taken in for the night."
R = "Nobody could say later who had first seen the light, but all agreed that it was green and very bright."
BODY = f"<p>{P}</p><p>{Q}</p><p>{R}</p>"
WHOLE = f"{P} {Q} {R}"
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2024. All rights reserved by the company and its partners.</p></footer>"
SEARCH = "<form><label>Search</label><input name=q><button>Go</button></form>"
COOKIE = "<div class='cookie-notice'><p>We use cookies to make this site work better for you. By going on you agree to our use of cookies.</p></div>"
SIDE = "<aside><h3>Related</h3><ul><li><a href=x>Ten other stories that you may like</a></li></ul></aside>"
SHAPES = {
    "plain article": f"{NAV}<article><h1>T</h1>{BODY}</article>{FOOT}",
    "main": f"{NAV}<main><h1>T</h1>{BODY}</main>{FOOT}",
    "form around the page": f"<form id=aspnetForm>{NAV}<div><h1>T</h1>{BODY}</div>{FOOT}</form>",
    "form around an article": f"<form>{NAV}<article><h1>T</h1>{BODY}</article>{FOOT}</form>",
    "form around a page with a search form": f"<form>{NAV}<div>{SEARCH}</div><div><h1>T</h1>{BODY}</div></form>",
    "parts as articles": f"{NAV}<main><article><h1>T</h1><article class=part><p>{P}</p><p>{Q}</p></article><article class=part><p>{R}</p></article></article></main>{FOOT}",
    "one part": f"<main><article><h1>T</h1><article class='part'>{BODY}</article></article></main>",
    "comments as articles": f"<article><h1>T</h1>{BODY}<article><p>Nice one, thanks for this.</p></article></article>",
    "comments by name": f"<article><h1>T</h1>{BODY}<section class=comments><article class=comment><p>I was there and saw it all with my own eyes.</p></article></section></article>",
    "notice before": f"{COOKIE}{NAV}<article><h1>T</h1>{BODY}</article>",
    "notice after": f"<main><h1>T</h1>{BODY}</main>{COOKIE}",
    "notice within main": f"<main><div>{COOKIE}</div><article><h1>T</h1>{BODY}</article></main>",
    "sidebar": f"<div>{SIDE}<article><h1>T</h1>{BODY}</article></div>",
    "newsletter form": f"<article><h1>T</h1>{BODY}{SEARCH}</article>",
    "newsletter by name": f"<div class=newsletter><p>Get the best of our stories in your mail each week, free.</p></div><article><h1>T</h1>{BODY}</article>",
    "role main": f"<div role=navigation><a href=x>Home</a></div><div role=main><h1>T</h1>{BODY}</div>",
    "hidden": f"<article><h1>T</h1><div hidden><p>{Q} {Q}</p></div>{BODY}</article>",
    "unclosed nav": f"<nav><a href=x>Home</a><article><h1>T</h1>{BODY}</article>",
    "unclosed paragraphs": f"<main><h1>T</h1><p>{P}<p>{Q}<p>{R}</main>",
    "script in text": f"<article><h1>T</h1><script>var a = '<p>no</p>';</script><style>p {{}}</style>{BODY}</article>",
    "references": f"<article><h1>&#84;</h1><p>{P.replace(' ', '&nbsp;', 1)}</p><p>{Q}</p><p>{R}</p></article>",
    "advert within": f"<article><h1>T</h1><p>{P}</p><div class='advert sponsored'><a href=x>Buy now</a></div><p>{Q}</p><p>{R}</p></article>",
}


@pytest.fixture(scope="module")
def fitted(spark, sf):
    return op2_extract.train(table(spark, sf, "pages"))


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name, fitted):
    for costs in (op2_extract.PRIOR, fitted):
        got = op2_extract.main_text(f"<html><head><title>x</title></head><body>{SHAPES[name]}</body></html>", costs)
        assert got in (f"T {WHOLE}", WHOLE)


def test_deep_pages_are_read_in_linear_time():
    took = []
    for n in (4_000, 16_000):
        page = "<div>" * n + "<p>text of it</p>" + "</section>" * n + "<b>" * n + "<p>x" * n
        began = time.perf_counter()
        op2_extract.parse(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
