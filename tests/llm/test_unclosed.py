"""Dropped elements that no end tag closes."""

import pytest

from gridloom.llm import html_text


@pytest.mark.parametrize(
    "html,texts",
    [
        ('<div><p class="notice">N<p>Body one<p>Body two</div><p>More', ["Body one", "Body two", "More"]),
        ('<div><ul><li class="share">S<li>Item</ul><p>More</div>', ["Item", "More"]),
        ('<div><ul><li class="share">S</ul><p>More</div>', ["More"]),
        ('<div><ul><li class="share">S<ul><li>Inner</ul>still S<li>Item</ul><p>More</div>', ["Item", "More"]),
        ('<div><p class="notice">N<p class="ad">A<p>Body</div>', ["Body"]),
        ('<div><div class="ad">A<p>B<p>C</div><p>Body</div>', ["Body"]),
        ('<div><p class="notice"><b>N<p>Body</div>', ["Body"]),
        ('<div><p class="notice">N<h2>Title</h2>Body</div>', ["Title", "Body"]),
        ('<div><p>Text<span class="ad">A<p>Body</div>', ["Text", "Body"]),
        ('<div><p>Text<span class="ad">A<b>B</b><span>C</span></span> on</div>', ["Text", "on"]),
    ],
)
def test_unclosed_dropped_elements(html, texts):
    assert [n.text for n in html_text.nodes(html)[0]] == texts
