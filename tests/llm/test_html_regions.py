"""Main text of pages without a named region, and with several."""

from daftar.llm import html_text
from daftar.llm.html_text import main_text

LONG = "a long paragraph of the page with many words in it " * 20


def test_short_blocks_far_from_the_cluster_stay():
    short = [f"item {k}" for k in range(12)]
    body = "".join(f"<div>{x}</div>" for x in short) + f"<p>{LONG}</p><p>{LONG}</p>" + "".join(f"<div>{x}</div>" for x in short)
    want = [*short, LONG.strip(), LONG.strip(), *short]
    assert main_text(f"<body><nav>menu</nav><div>{body}</div><footer>foot</footer></body>").split("\n\n") == want
    assert main_text(body).split("\n\n") == want  # no element around


def test_the_enclosing_element_bounds_the_text():
    items = [f"item {k}" for k in range(8)]  # beyond the reach of the smoothing
    two = "<div>" + "".join(f"<p>{x}</p>" for x in items) + f"<p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text("<body>" + "<div>other</div>" * 12 + two + "</body>").split("\n\n") == [*items, LONG.strip(), LONG.strip()]


def test_sibling_articles_stay():
    page = f"<main><article><h1>One</h1><p>{LONG}</p></article><article><h1>Two</h1><p>short text</p></article></main>"
    assert main_text(f"<body>{page}</body>").split("\n\n") == ["One", LONG.strip(), "Two", "short text"]
    many = "".join(f"<article><p>{LONG} {k}</p></article>" for k in range(4))
    assert main_text(f"<body><div>{many}</div></body>").count("\n\n") == 3


def test_classes_do_not_hide_content():
    wrap = '<body><div class="layout with-sidebar"><article><div class="entry-header"><h1>Title</h1></div><p>' + LONG + '</p></article><div class="sidebar"><p>aside text</p></div></div></body>'
    assert main_text(wrap).split("\n\n") == ["Title", LONG.strip()]
    divs = f'<body><div class="has-header"><div class="text"><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>links</p></div></div></body>'
    assert main_text(divs).split("\n\n") == [LONG.strip(), LONG.strip()]
    related = f'<body><article><p>{LONG}</p><p class="related-work">{LONG}</p><div class="related"><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></div></article></body>'
    assert main_text(related).split("\n\n") == [LONG.strip(), LONG.strip()]
    comments = f'<body><article class="has-comments"><h1>T</h1><p>{LONG}</p><div class="comments"><div class="comment"><p>{LONG * 3}</p></div></div></article></body>'
    assert main_text(comments).split("\n\n") == ["T", LONG.strip()]


def test_ratios_decide(monkeypatch):
    """With equal scores for all lines, pages without a named region come out otherwise."""
    items = [f"item {k}" for k in range(8)]
    page = "<body>" + "<div>other</div>" * 12 + "<div>" + "".join(f"<p>{x}</p>" for x in items) + f"<p>{LONG}</p><p>{LONG}</p></div></body>"
    right = main_text(page)
    assert right == "\n\n".join([*items, LONG.strip(), LONG.strip()])
    monkeypatch.setattr(html_text, "smoothed", lambda ratio: ratio * 0 + 1)
    assert right != main_text(page)


def test_nesting_takes_linear_time():
    import time

    def seconds(html):
        began = time.process_time()
        main_text(html)
        return time.process_time() - began

    for make in (lambda n: "<article>x" * n, lambda n: "<p>" + "<b>x</i>" * n, lambda n: "<div>" + "<b>" * n + "<p>x</p>" * n, lambda n: '<div class="nav">x' * n, lambda n: "<i><div>" + "<b>x</i>" * n):
        assert seconds(make(16_000)) < 12 * max(seconds(make(4_000)), 0.02)


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "plain"), (3, "u", f"<p>{LONG * 500}</p>")]
    pages = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"][:9], r["n_chars"]) for r in html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (0, "u", "", 0), (2, "u", "plain", 5), (3, "u", LONG[:9], len(LONG * 500) - 1)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_marks_of_a_wrapper_do_not_empty_the_page():
    body = f'<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>'
    for wrap in ('<div class="post comments-open">', '<div id="page" class="has-notice">', '<div class="no-ads with-comments">', '<div class="notice">', '<section id="modal"><div class="alert page">'):
        ends = "</div></section>" if "section" in wrap else "</div>"
        assert main_text(f"<body>{wrap}{body}{ends}</body>").split("\n\n") == ["Title", LONG.strip(), LONG.strip()], wrap
        assert main_text(f"<body>{wrap}<article>{body}</article>{ends}</body>").split("\n\n") == ["Title", LONG.strip(), LONG.strip()], wrap


def test_comments_go_even_as_articles():
    own = f'<h1>Title</h1><p>{LONG}</p>'
    said = f"<p>{LONG * 2}</p>"
    for comment in (f'<article class="comment">{said}</article>', f'<section class="comments"><article class="comment">{said}</article></section>', f'<section class="comments"><article>{said}</article></section>', f'<div id="comments"><article id="comment-7">{said}</article><article>{said}</article></div>'):
        assert main_text(f"<body><article>{own}{comment}</article></body>").split("\n\n") == ["Title", LONG.strip()], comment
        assert main_text(f"<body><main>{own}</main>{comment}</body>").split("\n\n") == ["Title", LONG.strip()], comment
    wrapped = f'<body><main class="comments-open"><article class="post has-comments">{own}</article><section class="comments"><article>{said}</article></section></main></body>'
    assert main_text(wrapped).split("\n\n") == ["Title", LONG.strip()]
    no_region = f'<body><div class="text">{own}<p>{LONG}</p></div><section class="comments"><article>{said}</article></section></body>'
    assert main_text(no_region).split("\n\n") == ["Title", LONG.strip(), LONG.strip()]


def test_a_column_of_links_beside_the_content_goes():
    links = "".join(f'<a href="/{k}">{x}</a>' for k, x in enumerate(("Home", "News")))
    page = f'<body><div class="row"><div class="col">{links}</div><div class="col"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></div></body>'
    assert main_text(page).split("\n\n") == ["Title", LONG.strip(), LONG.strip()]


def test_ratios_decide_where_names_mislead(monkeypatch):
    """Teasers are articles and the text is in a plain element: the ratios choose it, and equal ratios do not."""
    teasers = "".join(f'<article><a href="/{k}">Teaser {k}</a></article>' for k in range(6))
    pages = [
        f'<body><div class="top">{teasers}</div><div class="story"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></body>',
        f'<body><div><article><h2>Other</h2><p>short</p></article>{teasers}</div><div><div class="x"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></div></body>',
        f'<body><div class="a">{"<div>name</div>" * 20}</div><div class="b"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class="a">{"<div>name</div>" * 20}</div></body>',
    ]
    want = ["Title", LONG.strip(), LONG.strip()]
    assert [main_text(p).split("\n\n") for p in pages] == [want] * len(pages)
    monkeypatch.setattr(html_text, "smoothed", lambda ratio: ratio * 0 + 1)
    assert all(main_text(p).split("\n\n") != want for p in pages)


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>", "x", 3, "y")], "page_id int, url string, html string, text string, n_chars int, Text2 string")
    assert [tuple(x) for x in html_text.extract(pages).collect()] == [(1, "u", "a b", 3)]
