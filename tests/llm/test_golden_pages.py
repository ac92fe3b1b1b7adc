"""Twenty pages with the text that they should give, and the cut of whole small pages against all labellings."""

from itertools import product

import pytest

from brindle.llm import html_text

ONE = "The council met on Tuesday to talk about the new bridge, which had been planned for years."
TWO = "After a long debate, in which forty people spoke, the plan was approved by a narrow vote."
THREE = "Work will begin in spring, and the bridge should open before the end of the next year."
BODY = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
TEXT = f"{ONE}\n{TWO}\n{THREE}"
LONG = "Our partners offer many fine products, and readers of this page can buy them at a lower price. " * 14
MENU = '<ul><li><a href="/">Home</a><li><a href="/n">News</a><li><a href="/s">Sport</a></ul>'

GOLDEN = [
    (f"<article><h1>A bridge</h1>{BODY}</article>", f"A bridge\n{TEXT}"),
    (f"<nav>{MENU}</nav><main><h1>A bridge</h1>{BODY}</main><footer>&copy; The paper</footer>", f"A bridge\n{TEXT}"),
    (f'<div class="menu">{MENU}</div><div id="content">{BODY}</div><div class="footer">{MENU}</div>', TEXT),
    (f'<div>{BODY}</div><div class="sidebar"><p>{LONG}</p></div>', TEXT),
    (f'<div class="cookie-notice"><p>{LONG}</p></div><div>{BODY}</div>', TEXT),
    (f'<a name="top"><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>', TEXT),
    (f'<div class="tags-page">{BODY}</div><div class="sidebar">{LONG}</div><footer>{LONG}</footer>', TEXT),
    (f'<form id="all"><header>The paper</header><nav>{MENU}</nav>{BODY}<footer>us</footer></form>', TEXT),
    (f"<div>{BODY}</div><form><p>Write to us, and tell us what you think of this piece of news.</p><textarea>Your text</textarea><button>Send</button></form>", TEXT),
    (f'<article>{BODY}</article><section id="comments"><article><p>{LONG}</p></article><article><p>I was there, and it was a good evening for the whole town.</p></article></section>', TEXT),
    (f'<article>{BODY}<div class="ad">{LONG}</div></article><div class="related"><article><h3><a href="/x">Another story of a bridge</a></h3></article></div>', TEXT),
    (f"<script>var a = '<p>{ONE}</p>';</script><style>p {{}}</style><!-- <p>{TWO}</p> --><noscript>Please enable scripts.</noscript><div>{BODY}</div>", TEXT),
    (f'<div hidden><p>{LONG}</p></div><div style="display: none">{LONG}</div><div>{BODY}</div>', TEXT),
    ("<div><p>Fish &amp; chips &lt;cheap&gt; &#233;t&eacute;, said the sign on the door of the house.</p></div>", "Fish & chips <cheap> été, said the sign on the door of the house."),
    (f"<div><p>{ONE.replace(' ', '  &nbsp; ')}</p><p>\n{TWO}\t</p></div>", f"{ONE}\n{TWO}"),
    (f"<div><p>{ONE}<p>{TWO}<blockquote>{THREE}</blockquote></div>", TEXT),
    (f"<main><p>{ONE}</p><p>The law is E = <math><mi>m</mi><mi>c</mi><annotation>mc^2</annotation></math>, as <a href='/x'>many</a> people know by now.</p></main>", f"{ONE}\nThe law is E = mc, as many people know by now."),
    (f"<article><h2>Steps to take</h2><ol><li>{ONE}</li><li>{TWO}</li></ol><table><tr><td>{THREE}</td></tr></table></article>", f"Steps to take\n{TEXT}"),
    (f'<nav>{MENU}</nav><div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></div><footer>{LONG}</footer>', ""),
    (f'<body class="sidebar-layout"><div class="page-header"><p>{LONG}</p></div><div class="single no-comments has-sidebar">{BODY}</div></body>', TEXT),
]


@pytest.mark.parametrize("page, text", GOLDEN)
def test_golden_page(page, text):
    assert html_text.main_text(page) == text
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>A bridge</title></head>{page}") == text


def test_length_of_boilerplate_does_not_matter():
    for times in (1, 5, 200):
        assert html_text.main_text(f'<div>{BODY}</div><div class="sidebar"><p>{LONG * times}</p></div>') == TEXT


def test_whole_pages_have_the_cheapest_labelling():
    """Of all labellings of a page's blocks, the one that is taken costs least: terminal and smoothness costs together."""
    seen = 0
    for page, _ in GOLDEN:
        blocks, tree = html_text.page_blocks(page)
        if len(blocks) > 12:
            continue
        odds, edges = [html_text.log_odds(b) for b in blocks], html_text.smoothness(blocks, tree)
        cost = lambda keep: sum(max(o, 0) * (not k) + max(-o, 0) * k for o, k in zip(odds, keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])  # noqa: B023, E731
        got = html_text.min_cut(odds, edges)
        assert cost(got) <= min(map(cost, product([False, True], repeat=len(blocks)))) + 1e-9
        seen += 1
    assert seen >= 18
