"""Main text where names mislead, trees decide, and pages are hostile."""

from __future__ import annotations

import time
import tracemalloc

import pytest

from heliograph.llm import site_tree

LONG = "The long text of the page goes on and on, and has no end in sight. " * 5


@pytest.mark.parametrize(("page", "text"), [
    ('<form id="aspnetForm"><div class="content"><p>The whole page.</p></div></form>', "The whole page."), ('<form><nav><a href=x>Home</a></nav><p>The whole page.</p></form>', "The whole page."), ('<div class="social-history">How it was.</div>', "How it was."),
    ('<main><p>First.</p><div class="related-work"><p>Others did it.</p></div><section id="side-effects">None known.</section></main>', "First.\nOthers did it.\nNone known."),
    ('<article><p>First.</p><div class="form-group-theory">Groups.</div><div class="notice-of-award">Won.</div></article>', "First.\nGroups.\nWon."), ("<article><header><h1>Title</h1></header><p>Text.</p><footer>End</footer></article>", "Title\nText."),
    ('<article><header class="site-header">Site</header><p>Text.</p></article>', "Text."), ("<div>" * 100 + "text<nav>Menu deep</nav>", "text"), ("<div>" * 600 + "text<nav>Menu deep</nav>", "text"), ("<div>" * 50_000 + "text<nav>Menu deep</nav>", "text"),
    ('<nav><a href="/a">One</a> <a href="/b">Two</a></nav>', ""), (f'<article><p>Short.</p></article><div class="comments"><p>{LONG}</p></div><div class="ad">{LONG}</div>', "Short."), (f'<p>Short text.</p><section class="reader-comments">{LONG}</section>', "Short text."),
    (f'<div class="SideBar"><p>{LONG}</p></div><p>Own.</p>', "Own."), ('<div role="banner">Site</div><div class="post-header js-top">Site</div><p>Own.</p>', "Own."), ('<div class="promo"><p>' + LONG + "</p></div>", LONG.strip()), ('<div class="promo"><a href=x>' + LONG + "</a></div><p>Own.</p>", "Own."),
])
def test_names_lean(page, text):
    assert site_tree.main_text(page, {}) == text


@pytest.mark.parametrize("pages", [4, 12, 60])
@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_importance_decides_under_misleading_names(spark, monkeypatch, pages, broadcast):
    """A menu named as content goes from hosts of four pages on; the page's own text stays in what is named a promo or a form."""
    monkeypatch.setattr(site_tree, "BROADCAST_NODES", broadcast)
    menu = '<div class="content-main"><p>Home</p><p>All about us and what we do</p><p>Write to us</p></div>'
    page = '<html><body>{menu}<div class="promo"><form><p>Own {i}: {long}</p></form></div><div class="advert">Buy {i}</div><div id="comments">Reader {i} said {long}</div></body></html>'
    rows = [(i, f"http://one.org/{i}", page.format(menu=menu, i=i, long=f"{i} and so on. " * 30)) for i in range(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract_text(frame).collect()}
    assert got == {i: f"Own {i}: " + (f"{i} and so on. " * 30).strip() for i in range(pages)}
    without = [site_tree.main_text(r[2], {}) for r in rows]
    assert all(w != got[i] for i, w in enumerate(without))  # without the tree the menu would stay


def test_long_names_and_stray_tags_take_little():
    page = "".join(f'<div class="{k} {"x" * 4_000}">word {k} ' for k in range(2_500))
    tracemalloc.start()
    blocks, _ = site_tree.parse(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 2_500 and len(page) > 10_000_000 and peak < 50_000_000
    for piece in ("</i>", "</p>", "<nav>", "<li>", "<a><b></a>"):
        page = "<div><i>" * 500 + "Text" + piece * (1_000_000 // len(piece))
        began = time.perf_counter()
        assert "Text" in site_tree.main_text(page, {})
        assert time.perf_counter() - began < 6, piece
