"""Shapes of pages that operator 1 must tell apart, and markup that must not cost more than its length."""

import time

import pytest

from quayside.llm.html_text import main_text

P = "Some long sentence of prose that goes on for a while, with commas, and a full stop at its end."
Q = "An answer by a reader that is quite as long as what was written above, so length does not tell."
LINKS = "".join(f"<li><a href=x>Link number {k}</a></li>" for k in range(60))


def ps(n, text=P):
    return f"<p>{text}</p>" * n


@pytest.mark.parametrize(("html", "text"), [
    (f"<div id=post><h1>BIG</h1><div class=entry>{ps(3)}</div></div>", f"BIG {P} {P} {P}"),
    (f"<div id=post><h1>BIG</h1><p class=by>By Joe</p><div class=entry>{ps(2)}</div></div>", f"BIG By Joe {P} {P}"),
    (f"<main><h1>BIG</h1><article>{ps(2)}</article></main>", f"BIG {P} {P}"),
    (f"<nav><h2>Menu</h2>{LINKS}</nav><h2>Head</h2><ul><li>{P}</li><li>{P}</li><li>{P}</li></ul>", f"Head {P} {P} {P}"),
    (f"<div class=post>{ps(1)}</div><div class=responses>{ps(8, Q)}</div>", P),
    (f"<div class=post>{ps(1)}</div><div class=kommentare>{ps(8, Q)}</div>", P),
    (f"<div class=post><h1>T</h1>{ps(2)}</div><div class=zz>" + f"<div class=item><div>joe</div>{ps(1, Q)}</div>" * 5 + "</div>", f"T {P} {P}"),
    (f"<ul>{LINKS}</ul><p>{P} {P}</p>", f"{P} {P}"),
    (f"<table><tr><td><a href=1>Home</a> <a href=2>About</a></td><td>{ps(3)}</td></tr></table>", f"{P} {P} {P}"),
    (f"<article><h1>T</h1>{ps(1)}" + f"<section class=c><h2>S</h2>{ps(1)}</section>" * 4 + "</article>", f"T {P}" + f" S {P}" * 4),
    (f"<h1>T</h1>{ps(1)}" + f"<div class=c>{ps(2)}</div>" * 4, " ".join(["T"] + [P] * 9)),
    (f"{ps(1)}a < b", f"{P} a < b"),
    (f"{ps(2)}<!-- never closed <p>x</p>", f"{P} {P} <!-- never closed x"),
])
def test_shapes(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("tail", ["", " >", "<p>x</p>"])
@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a b='", "<!--", "<!-- ", "<![CDATA[", "<p <", "</a ", "<a/", "<a b=\n", "<div class=x>", "<li>"])
def test_time_grows_with_the_page_only(piece, tail):
    began = time.process_time()
    main_text(piece * (300_000 // len(piece)) + tail)
    assert time.process_time() - began < 4
