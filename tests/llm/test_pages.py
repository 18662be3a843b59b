"""WARC archives and HTML extraction."""

import hashlib
import random
import statistics
import tracemalloc
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import html_text, warc

PAGES = "page_id long, url string, html string, file string, payload binary"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "f", b"p") for r in rows], PAGES)


def test_archives(spark):
    big, long = "<p>" + "é" * 800, "x" * 3_000_000
    rows = [(1, "http://a/1", big), (2, "http://a/2 b\r\nX: y", big), (7, None, big), (3, "u", "same"), (4, "u", "same"), (5, "u", None), (6, "u", ""), (8, "u", long), (9, "u", long), (7, None, big), (None, "n", big), (10, "u", "a\r\n\r\nb" * 300)]
    manifest = warc.write_archives(_pages(spark, rows))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read_archives(spark, manifest).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        best = max((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(data) >= 1000 and i != best
        want.append((i, "revisit" if revisit else "response", best if revisit else None, len(data), hashlib.sha1(data).hexdigest(), None if revisit else data))
    assert got == sorted(want, key=str)
    assert warc.write_archives(_pages(spark, [])).count() == 0


def test_archive_starts_with_its_dictionary(spark):
    from gridloom import storage

    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h/', id) as url", "concat('<html><body><p>', repeat(cast(id * 7919 as string), 20), '</p></body></html>') as html").coalesce(1)
    manifest = warc.write_archives(pages).collect()
    assert sum(r.records for r in manifest) == 3000
    data = storage.read_bytes(manifest[0].file)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and data[8:12] == b"\x37\xa4\x30\xec"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div class="ad">Buy this now, it is cheap.</div>
<%s><h1>The&nbsp;title &amp; more</h1><p><b>First paragraph, with some text in it. It goes on,<br>and on.<p>Second   one;
it is long enough, too.</p><p>Ok.</p><ul><li>An item, of the text.</li></ul><form><p>Your name, please.</p></form>
<div id="comments"><p>I like it, said a reader. Very much indeed, really.</p></div></%s>
<aside>Other, things.</aside><footer>&copy; nobody</footer></body></html>"""
TEXT = "The title & more\nFirst paragraph, with some text in it. It goes on, and on.\nSecond one; it is long enough, too.\nOk.\nAn item, of the text."


@pytest.mark.parametrize("element", ["article", "main", "div class=content", "section"])
def test_main_text(element):
    assert html_text.main_text(PAGE % (element, element.split()[0])) == TEXT


@pytest.mark.parametrize("html,text", [("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("a < b", "a < b"), ("<nav>x</nav>", ""), ('<p title="a>b">c</p>', "c"), ("</p></div>x", "x")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/apdivscriptnav\"'= &;!-\n", max_size=200))
def test_any_text_is_read(html):
    html_text.main_text(html)


def test_time_is_linear():
    for piece in ('<a "', "<!--", "<div>", "<p>x", "&", "<a '\">"):
        html_text.main_text(piece * 20000)


def test_deep_pages_take_linear_memory():
    tracemalloc.start()
    text = html_text.main_text("<div>x" * 170_000)  # 1 MB
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.count("x") == 170_000 and most < 200e6
    for piece in ("<b>", "<div></u>", "<div></p>", "<p>"):
        html_text.main_text("<nav>" + piece * 50_000 + "<p></p>" * 50_000)


LONG = "A paragraph with enough text, with commas, and more of it than others. It goes on."


@pytest.mark.parametrize(
    "html,text",
    [
        (f'<article><div class="notice-of-death"><p>{LONG}</p></div><p>{LONG}</p></article>', f"{LONG}\n{LONG}"),
        (f'<article><section class="social-policy"><p>{LONG}</p></section></article>', LONG),
        (f'<article><p>{LONG}</p><div class="cookie-banner"><p>{LONG}</p></div><div class="share-of-us"><a href="x">Tell</a></div></article>', LONG),
        (f'<article><p>{LONG}</p><ul><li><a href="x">A link</a></li></ul></article>', f"{LONG}\nA link"),
        (f"<body><p>Intro.</p><p>{LONG}</p><p>Bye</p></body>", f"Intro.\n{LONG}\nBye"),
        (f"<body><p>{LONG}</p><table><tr><td>1</td><td>2</td></tr></table></body>", f"{LONG}\n1\n2"),
        (f"<body><div><div>Logo</div></div><p>{LONG}</p><p>{LONG}</p><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul><div><div>Since 1999</div></div></body>", f"{LONG}\n{LONG}"),
        (f"<body><div><div>Logo</div></div><p>{LONG}</p><div><div>Since 1999</div></div></body>", LONG),
        (f"<div hidden><p>{LONG}</p></div><p hidden='hidden'>{LONG}</p><p>{LONG}</p>", LONG),
    ],
)
def test_what_ratios_decide(html, text):
    assert html_text.main_text(html) == text


REPLY = "<div><div>Ann, 3 hours ago</div><div>I see it in another way, and so do others. Well, well.</div></div>"


@pytest.mark.parametrize(
    "html,text",
    [
        (f'<main><p>{LONG}</p><div class="reader-comments"><p>{LONG}</p></div></main>', LONG),
        (f'<article><p>{LONG}</p><ol class="commentlist"><li><p>{LONG}</p></li><li><p>{LONG}</p></li></ol></article>', LONG),
        (f'<article><p>{LONG}</p><section id="user-comments"><h3>Comments</h3><p>{LONG}</p></section></article>', LONG),
        (f'<article><p>{LONG}</p><div class="discussion"><p>{LONG}</p></div></article>', LONG),
        (f'<article><p>{LONG}</p><section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section></article>', f"{LONG}\nDiscussion\n{LONG}"),
        (f'<div class="post has-comments comments-open"><p>{LONG}</p></div>', LONG),
        (f'<article><div class="article-header"><h1>Title</h1></div><p>{LONG}</p></article>', f"Title\n{LONG}"),
        (f'<article><header class="header"><h1>Title</h1></header><p>{LONG}</p></article>', f"Title\n{LONG}"),
        (f'<body><div class="header"><p>{LONG}</p></div><article><p>{LONG}</p></article></body>', LONG),
        (f'<article><p>{LONG}</p><p class="alert">{LONG}</p></article>', f"{LONG}\n{LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p>{REPLY * 4}</article>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p><ul>{'<li><span>Bob</span> <div>12:30</div><p>No. Not at all, my friend.</p></li>' * 3}</ul></article>", LONG),
        (f"<article><p>{LONG}</p>{REPLY}</article>", f"{LONG}\nAnn, 3 hours ago\nI see it in another way, and so do others. Well, well."),
        (f"<article><p>{LONG}</p>{'<div><h3>12:30</h3><p>What came to pass then, at length.</p></div>' * 3}</article>", LONG + "\n12:30\nWhat came to pass then, at length." * 3),
    ],
)
def test_comments_go_and_titles_stay(html, text):
    assert html_text.main_text(html) == text


def brute_force(blocks):
    """Main text of plain pages from (path of (serial, tag), text, characters in links), by the definitions alone."""
    tags = [tuple(t for _, t in path) for path, _, _ in blocks]

    def ratio(i, of):
        same = [b for b, t in zip(blocks, tags, strict=True) if t == tags[i]]
        return sum(of(b) for b in same) / len(same)

    def smooth(values):
        out = []
        for i, (path, _, _) in enumerate(blocks):
            near = [(w, values[i + k]) for k, w in zip(range(-2, 3), html_text.SMOOTH, strict=True) if 0 <= i + k < len(blocks) and blocks[i + k][0][:-1] == path[:-1]]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    lengths = smooth([ratio(i, lambda b: max(0, len(b[1]) - 2 * b[2])) for i in range(len(blocks))])
    marks = smooth([ratio(i, lambda b: sum(c in ".,;:!?" for c in b[1])) for i in range(len(blocks))])
    values = [a * (1 + b) for a, b in zip(lengths, marks, strict=True)]
    chosen = {t for t in tags if (m := statistics.fmean(v for v, u in zip(values, tags, strict=True) if u == t)) > 0 and m >= html_text.SPREAD * statistics.pstdev(values) - 1e-9}
    good = [t in chosen for t in tags]
    if not any(good):
        good = [True] * len(blocks)
    held = [b for b, g in zip(blocks, good, strict=True) if g]
    named = Counter()
    for path, text, _ in held:
        inner = [i for i, (_, t) in enumerate(path) if t in ("article", "main")]
        if inner:
            named[path[: inner[-1] + 1]] += len(text)
    region, explicit = (), False
    if named and 2 * max(named.values()) >= sum(len(b[1]) for b in held):
        region, explicit = next(r for r in named if named[r] == max(named.values())), True
    else:
        for i in range(min(len(p) for p, _, _ in held)):
            if len({p[: i + 1] for p, _, _ in held}) > 1 or any(len(p) == i + 1 for p, _, _ in held):
                break
            region = held[0][0][: i + 1]
        explicit = bool(region) and region[-1][1] in ("article", "main")
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
    out = []
    for i, (path, text, _) in enumerate(blocks):
        if path[: len(region)] != region:
            continue
        if not good[i] and not explicit:
            same = [b for b, t in zip(blocks, tags, strict=True) if t == tags[i]]
            child = path[len(region)][1] if len(path) > len(region) else None
            if sum(b[2] for b in same) > html_text.LINKS * sum(len(b[1]) for b in same) or not (first <= i <= last or child is None or child in html_text.PROSE):
                continue
        out.append(text)
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_main_text_equals_brute_force(seed):
    rng = random.Random(seed)
    blocks, serial = [], [0]

    def grow(path, depth):
        html = ""
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.5:
                serial[0] += 1
                tag = rng.choice(["div", "section", "article", "main", "blockquote", "table"])
                html += f"<{tag}>{grow((*path, (serial[0], tag)), depth - 1)}</{tag}>"
            else:
                serial[0] += 1
                tag = rng.choice(["p", "h2", "pre"])
                text = rng.choice(["Short", f"Text {serial[0]}, some more. " * rng.randint(1, 9), "one link"]).strip()
                linked = len(text) if text == "one link" else 0
                blocks.append(((*path, (serial[0], tag)), text, linked))
                html += f"<{tag}>{f'<a href=x>{text}</a>' if linked else text}</{tag}>"
        return html

    assert html_text.main_text(grow((), 3)) == brute_force(blocks)


def test_extract(spark):
    rows = [(1, "u", PAGE % ("article", "article")), (2, None, None), (1, "u", PAGE % ("article", "article")), (3, "v", "")]
    got = html_text.extract(_pages(spark, rows), keep=["page_id", "url"]).collect()
    assert sorted((r.page_id, r.main_text) for r in got) == [(1, TEXT), (1, TEXT), (2, ""), (3, "")]
    assert html_text.extract(_pages(spark, [])).count() == 0
