"""Main text of pages of several kinds, malformed markup, the ratio's parts and edge cases."""

import time

import numpy as np
import pytest

from tidemark.llm import html

BODY = "This is a paragraph of the article, long enough to be told from the menus around it, number {}."
PARAS = [BODY.format(i) for i in range(6)]


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body>{before}{article}{after}</body></html>"


INNER = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAS[:3]) + "<p>Short.</p>" + "".join(f"<p>{p}</p>" for p in PARAS[3:])
TEXT = "\n".join(["Title", *PARAS[:3], "Short.", *PARAS[3:]])
NOISE = [
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav>", "<header>The Site Name</header>",
    '<div class="cookie-notice">We use cookies, and this is a long sentence that says why we think we may do so.</div>',
    '<div class="ad">Buy this now, it is cheap and good and you will never regret it, they say.</div>',
    "<aside><p>Read also: another article that has a very long title indeed.</p></aside>",
    '<form action="/s">Search <input name=q><button>Go</button><select><option>one</select></form>',
    '<section id="comments"><p>A reader comment that is long, thoughtful, and still not part of the article at all.</p></section>',
    "<footer>Copyright</footer>", '<div role="navigation">More links</div>', '<div style="display: none">hidden text</div>',
    "<!-- a comment <p>with tags</p> --><noscript>turn it on</noscript><template><p>t</p></template>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div id="wrap"><div class="post has-sidebar">{}</div></div>'])
def test_article_without_what_stands_around_and_inside(wrap):
    assert html.main_text(page(wrap.format(INNER), "".join(NOISE[:6]), "".join(NOISE[6:]))) == TEXT
    inside = INNER.replace("<p>Short.</p>", "<p>Short.</p>" + NOISE[3] + NOISE[2] + NOISE[10])
    assert html.main_text(page(wrap.format(inside), NOISE[0])) == TEXT


def test_comments_as_articles_and_article_headers():
    comment = '<article class="comment"><p>' + BODY.format(99) * 9 + "</p></article>"
    art = f"<article><header><h1>Title</h1><p>by A. Writer</p></header>{INNER[14:]}<footer>tags</footer></article>"
    assert html.main_text(page(art, NOISE[0], comment)) == TEXT


@pytest.mark.parametrize("case", range(9))
def test_layouts_whose_text_was_lost(case):
    paras = [BODY.format(i) for i in range(10)]
    body = "".join(f"<p>{p}</p>" for p in paras)
    text, long = "\n".join(paras), "code " * 1000
    html_, want = [
        (f'<main>{body}</main><article class="card"><p>A teaser</p></article>', text),
        (f"<article>{body[: len(body) // 2 + 60]}</article><article>{body}</article>", None),
        (f"<div>{body}<pre>{long}</pre>{body}</div>", f"{text}\n{long.strip()}\n{text}"),
        (f"<blockquote>{long}</blockquote>{body}", f"{long.strip()}\n{text}"),
        (f"<h1>Title</h1><p>Short.</p>{body}<p>End.</p>", f"Title\nShort.\n{text}\nEnd."),
        (f'<section class="social-history">{body}</section><section id="search-methods"><p>{paras[0]}</p></section>', f"{text}\n{paras[0]}"),
        (f'<form action="/"><div>{body}</div></form>', text),
        (f'<fieldset>{body}</fieldset><div class="cookie-banner">We use cookies.</div>', text),
        (f'<div class="site-footer">x y z</div><div class="notice-period">{body}</div><ul class="main-nav"><li>Home</li></ul>', text),
    ][case]
    got = html.main_text(page(html_, NOISE[0], NOISE[7]))
    if want is None:  # both articles are there
        assert got.count(paras[0]) == 2 and got.endswith(text)
    else:
        assert got == want


def test_generated_pages_give_back_their_article():
    """Articles of blocks in several layouts, with noise before, after and between them."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    for _ in range(150):
        blocks = [" ".join(word() for _ in range(rng.choice((3, 30, 60, 120)))) for _ in range(rng.randrange(4, 15))]
        blocks.insert(1, " ".join(word() for _ in range(80)))
        marked = [f"<{t}>{b}</{t}>" for b, t in zip(blocks, (rng.choice(("p", "p", "h2", "blockquote", "pre")) for _ in blocks))]
        wrap = rng.choice(("<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', "<main><article>{}</article></main>"))
        inner = "".join(m + (rng.choice(NOISE[1:6]) if rng.random() < 0.15 else "") for m in marked) if "article" in wrap or "main" in wrap else "".join(marked)
        noise = rng.sample(NOISE, 4)
        got = html.main_text(page(wrap.format(inner), "".join(noise[:2]), "".join(noise[2:])))
        assert got.replace("\nThe Site Name", "") == "\n".join(blocks), (wrap, got)


def test_white_space_references_and_inline_markup():
    art = "<article><p> A &amp; B&nbsp;&#233;\n\t <b>bo<i>ld</i></b>\r\n<br>next<a href=x> link</a> </p><div>one<p>two<p>three</div>four</article>"
    assert html.main_text(page(art)) == "A & B é bold next link\none\ntwo\nthree\nfour"


def test_unclosed_and_stray_tags():
    open_ = "<body><article><h1>Title<p>" + "<p>".join([*PARAS[:3], "Short.", *PARAS[3:]]) + "<footer>end"
    assert html.main_text(open_.replace("<h1>Title", "<h1>Title</h1>")) == TEXT
    assert html.main_text(page("<article></span></div></b>" + INNER + "</p></article>")) == TEXT
    assert html.main_text("<article><p>a</p><script>never closed <p>b</p>") == "a"
    assert html.main_text("<article><p>a</p><!-- never closed <p>b</p>") == "a"


@pytest.mark.parametrize("bad", ["<div>", "</div>", "<!--", "<p>x", "<script>", "<a ", "&amp", "<", "<b>x</i>", "<li>y", "<!x", "<?p"])
def test_long_malformed_pages_take_linear_time(bad):
    start = time.process_time()
    html.main_text(bad * (200_000 // len(bad)))
    assert time.process_time() - start < 15


def test_smoothing_and_clusters():
    flat = html.smoothed(np.full(9, 4.0))
    assert np.allclose(flat, 4)
    peak = html.smoothed(np.array([0, 0, 0, 0, 10.0, 0, 0, 0, 0]))
    assert peak.argmax() == 4 and np.allclose(peak, peak[::-1]) and peak[3] > peak[2] > 0
    assert html.high_cluster(np.array([1.0, 2, 1, 50, 60, 55])).tolist() == [False] * 3 + [True] * 3
    assert html.high_cluster(np.array([3.0, 3.0])).all()


def test_table_and_edge_cases(spark):
    rows = [(1, "u", page(f"<article>{INNER}</article>")), (2, None, None), (3, "v", ""), (None, "w", "<p>x"), (4, "z", "<nav>only</nav>")]
    table = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS c0")
    got = html.extract(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "x", 1), (4, "z", "", 0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert html.extract(table.limit(0)).count() == 0
