import itertools
import random

import numpy as np
import pytest

from groundwork.llm.html_text import PRIOR, blocks, extract_text, features, fit, label, main_text, ties
from groundwork.llm.min_cut import min_cut


def cost(kept, terminal, edges):
    """What a labelling cuts: sources left out, sinks left in, edges between."""
    return sum(max(t, 0) for k, t in zip(kept, terminal) if not k) + sum(max(-t, 0) for k, t in zip(kept, terminal) if k) + sum(c for a, b, c in edges if kept[a] != kept[b])


def test_min_cut_is_cheapest():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(1, 10)
        terminal = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(0, 7)) for _ in range(rng.randrange(2 * n))]
        got = min_cut(terminal, edges)
        every = [(cost(k, terminal, edges), sum(k), k) for k in itertools.product([False, True], repeat=n)]
        assert (cost(got, terminal, edges), sum(got), tuple(got)) == min(every)
    assert min_cut([], []) == []


def test_long_chain():
    n = 30_000
    terminal = [500 if i % 97 == 0 else -3 for i in range(n)]
    got = min_cut(terminal, [(i, i + 1, 4) for i in range(n - 1)])
    assert len(got) == n


ARTICLE = (
    '<!DOCTYPE html><html class="with-sidebar"><head><title>T &amp; t</title><style>p{content:"</p>"}</style></head><body class="no-ads">'
    '<header><div class="logo">Site name</div><nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav></header>'
    '<div class="cookie-notice">We use cookies. Read what we do with them, and why, and for how long.</div><!-- ad <p>x</p> -->'
    '<div class="content-with-sidebar"><article class="post"><header><h1>A title &mdash; here</h1></header><p>First   paragraph,\n with <b>bold</b> and <a href="x>y">a link</a>.<p>Second.</p>'
    '<script>var t = "</p><p>no</p>";</script><ul><li>An item<li>Another one</ul><div class="advert">Buy this now. It is cheap, good and new.</div><blockquote>Quoted &lt;b&gt; text&nbsp;here</blockquote><p>Yes.<br>More.</p>'
    '<form action="/s"><label>Your mail</label><input name="q"><button>Send</button></form><section id="comments"><article class="comment"><p>I have read this. It was, in my opinion, a very good text about many things.</p></article></section></article>'
    '<aside class="sidebar"><h3>Related</h3><p>Another story that is told here at length, with commas, and full stops.</p></aside></div>'
    "<footer>&copy; 2024 Somebody. All rights reserved, everywhere and for ever.</footer></body></html>"
)
TEXT = "A title — here\nFirst paragraph, with bold and a link.\nSecond.\nAn item\nAnother one\nQuoted <b> text here\nYes. More."


def test_article_without_the_rest():
    assert main_text(ARTICLE, PRIOR)[0] == TEXT


def test_page_without_names():
    sentence = "This is a sentence of some length, as texts have them, and it goes on for a while. "
    body = "".join(f"<div>{sentence * 3}</div>" for _ in range(4)) + "<div>Short.</div>" + f"<div>{sentence * 2}</div>"
    links = "".join(f'<div><a href="/{i}">Go there</a></div>' for i in range(6))
    text = main_text(f"<body><div>{links}</div><div>{body}</div><div>{links}</div></body>", PRIOR)[0]
    assert text.split("\n") == [" ".join((sentence * 3).split())] * 4 + ["Short."] + [" ".join((sentence * 2).split())]


@pytest.mark.parametrize("page", ["", None, " ", "<", "<p", "<!-- x", "<script>a", "a < b & c &am", "<<<p>>", "</p></div>", "<a href=\"x>y</a><p>z</p>", "<p>x</p" * 50, "&amp;lt;", "\0<b>"])
def test_broken_pages(page):
    text, n, kept = main_text(page, PRIOR)
    assert kept <= n and isinstance(text, str)


def test_blocks_and_ties():
    found, parents = blocks("<div>a &amp;lt; <i>b</i><p>c<p>d</div>e")
    assert [b.text for b in found] == ["a &lt; b", "c", "d", "e"]
    assert {(a, b) for a, b, _ in ties(found, parents)} >= {(0, 1), (1, 2), (2, 3)}
    p, kept = label(found, parents, PRIOR)
    assert len(p) == len(kept) == 4 and features(found).shape == (4, len(PRIOR))
    assert label([], [0], PRIOR)[1] == []


def test_very_long_page():
    page = "<body>" + "<div><p>Some words of a text, again.</p><p><a>x</a></p></div>" * 20_000 + "</body>"
    text, n, kept = main_text(page, PRIOR)
    assert n == 40_000
    assert len(blocks("<div>" * 50_000 + "x")[0]) == 1


def test_table(spark):
    rows = [(1, "u", ARTICLE, "k"), (1, "u", ARTICLE, "k"), (None, None, ARTICLE, None), (2, "v", None, "k"), (3, "w", "", "k"), (4, "x", "<article><p>Only this.</article>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]
    found = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()), key=repr)
    assert found == sorted([(i, t, len(t)) for i, t in [(1, TEXT), (1, TEXT), (None, TEXT), (2, ""), (3, ""), (4, "Only this.")]], key=repr)
    empty = spark.createDataFrame([], "page_id int, url string, html string")
    assert extract_text(empty).collect() == [] and np.array_equal(fit(empty), PRIOR)


def test_fit_learns_text_alone(spark):
    """Names taken away, the text features still tell most blocks of unseen pages apart."""
    rng = random.Random(11)

    def page(named):
        say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) for _ in range(n))
        links = "".join(f"<li><a>{say(2)}</a></li>" for _ in range(5))
        text = [f"{say(rng.randrange(8, 60))}." for _ in range(6)]
        body = "".join(f"<p>{t}</p>" for t in text)
        return (f"<nav><ul>{links}</ul></nav><article>{body}</article><footer>{say(3)}</footer>" if named else f"<div><ul>{links}</ul></div><div>{body}</div><div>{say(3)}</div>"), "\n".join(text)

    df = spark.createDataFrame([(i, page(True)[0]) for i in range(200)], "page_id long, html string")
    w = fit(df, sample=100)
    held = [page(False) for _ in range(100)]
    right = sum(main_text(h, w)[0] == t for h, t in held)
    assert right >= 95
