from logloom.llm import html_extract as H
from logloom.llm import html_training
from logloom.sources import load

SF = "/root/testdata/sf0.01"


def texts(page):
    return H.main_text(page, H.tree())[0].split("\n\n")


def test_tree_fits_its_table():
    tree = H.tree()
    for page, main in html_training.PAGES:
        got = H.main_text(page, tree)[0]
        assert set(got.split("\n\n") if got else []) == main


def test_word_counts_and_link_densities_of_neighbours_are_in_the_tree():
    tree = H.tree()
    used = {H.FEATURES[f] for f in tree.feature if f >= 0}
    assert {"words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after"} <= used


def test_held_out_pages_of_the_same_rules():
    tree = H.tree()
    wrong = total = 0
    for k in range(90_000, 90_100):
        for page, main in (html_training._unmarked(k), html_training._marked(k, html_training._OPEN), html_training._marked(k, html_training._WEAK), html_training._marked_furniture(k)):
            found, marks = H.blocks(page)
            keep = tree.predict(H.features(found, marks)) >= 0.5
            wrong += sum((b.text in main) != y for b, y in zip(found, keep))
            total += len(found)
    assert wrong / total < 0.005


UNSEEN = [
    # A quote inside an unquoted value, and a stray quote behind a value.
    ("<article><p data-x=it's>First of all.</p><p>Don't <b title=\"a>b\">stop</b> here.</p></article>", ["First of all.", "Don't stop here."]),
    ("<article><p>One line.</p><img alt=5\"><p>Two lines.</p><p>Three lines' worth.</p></article>", ["One line.", "Two lines.", "Three lines' worth."]),
    # Compound class names of which one word alone speaks of furniture.
    ("<article class='post category-advertising tag-search'><h1>On adverts</h1><p>They are everywhere.</p></article>", ["On adverts", "They are everywhere."]),
    ("<article><p class='form-factor'>It is small.</p><div class='related-work'>Others made it larger.</div></article>", ["It is small.", "Others made it larger."]),
    # Nothing but counts: a menu, a tagline, a short title, prose with a short line, a foot line.
    (
        "<body><div><a href=/a>Home</a> <a href=/b>Blog</a> <a href=/c>Shop</a></div><div>Since 1901</div><div>Otters</div><p>Otters sleep in the water and hold each other by the paw so that they do not drift apart.</p>"
        "<p>They eat a lot.</p><p>A grown otter eats a quarter of its weight each day, mostly crabs, clams and sea urchins from the bottom.</p><div>All rights reserved by us</div></body>",
        ["Otters", "Otters sleep in the water and hold each other by the paw so that they do not drift apart.", "They eat a lot.", "A grown otter eats a quarter of its weight each day, mostly crabs, clams and sea urchins from the bottom."],
    ),
    # A table layout: menu cell, text cell, cell of links.
    (
        "<body><table><tr><td><a href=1>North</a><br><a href=2>South</a></td><td><h2>Tides</h2><p>The moon pulls at the sea, and twice a day the water comes up the beach and goes away again.</p>"
        "<p>Where the bay is narrow it may rise as high as a house within six hours, and boats must wait.</p></td><td><a href=3>More</a> <a href=4>Archive</a></td></tr></table></body>",
        ["Tides", "The moon pulls at the sea, and twice a day the water comes up the beach and goes away again.", "Where the bay is narrow it may rise as high as a house within six hours, and boats must wait."],
    ),
    # Furniture that says so around an article that does not; upper-case tags, comments, references.
    (
        "<BODY><NAV><UL><LI><A HREF=/>Top</A></UL></NAV><!-- <article> --><DIV><H1>Caf&eacute; &amp; bar</H1><P>The place on the corner opens at six and is full by seven, so come early or bring a friend who does.</P>"
        "<P>No cards &ndash; cash only.</P><P>It has been run by the same two sisters since the war, and they still do all of the cooking.</P></DIV><DIV CLASS='comment-list'><P>Best soup in town, and I have had them all over the years.</P></DIV><FOOTER>Imprint</FOOTER></BODY>",
        ["Café & bar", "The place on the corner opens at six and is full by seven, so come early or bring a friend who does.", "No cards – cash only.", "It has been run by the same two sisters since the war, and they still do all of the cooking."],
    ),
    # Nothing but short lines.
    ("<html><body><p>Just one short paragraph.</p></body></html>", ["Just one short paragraph."]),
    ("<body><h1>Only heading</h1><p>Short one here.</p><p>And another short one follows it.</p></body>", ["Only heading", "Short one here.", "And another short one follows it."]),
    # A loose wrapper that holds a menu as well.
    (
        "<div id=content><ul><li><a href=/1>Soups</a><li><a href=/2>Stews</a><li><a href=/3>Breads</a><li><a href=/4>Cakes</a></ul><h2>Rye bread</h2><p>Stir the flour into the sour dough and let it stand over night in a warm place near the oven.</p><p>Bake it.</p>"
        "<p>It keeps for two weeks in a linen cloth, and tastes best on the third day with salted butter.</p></div><div class=newsletter-signup>Our best recipes by mail.</div>",
        ["Rye bread", "Stir the flour into the sour dough and let it stand over night in a warm place near the oven.", "Bake it.", "It keeps for two weeks in a linen cloth, and tastes best on the third day with salted butter."],
    ),
]


def test_pages_of_unseen_layouts():
    for page, want in UNSEEN:
        assert texts(page) == want, page


LONG = "The mill at the lower bridge has ground the corn of the valley for as long as anyone can remember, and it still does."
MORE = "Its wheel was renewed twice, once after the flood and once after the fire, but the stones are those of the first miller."
SIDE = "Read what other people of the valley have told us about their own mills over the years."


def article(name):
    return f"<{name}><h1>The mill</h1><p>{LONG}</p><p>It is small.</p><p>{MORE}</p></{name.split()[0]}>"


MILL = ["The mill", LONG, "It is small.", MORE]
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>"
FOOT = "<footer><p>All rights reserved by the valley press and its partners since 1901.</p></footer>"
MISLEADING = [
    *[f"<body>{MENU}<div class='{c}'>{article('article')}</div>{FOOT}</body>" for c in ("wrapper sidebar-left", "page-sidebar-right", "content-sidebar", "sidebar", "comments-open popup", "row share")],
    *[
        f"<body>{MENU}{article(f'article class={q}{c}{q}')}<aside><p>{SIDE}</p></aside>{FOOT}</body>"
        for q in '"'
        for c in ("notice", "newsletter", "post social", "post share", "breaking related", "story promo", "article-comments", "popup", "advert", "login")
    ],
    f"<body><form id='aspnetForm' action=x>{MENU}<div id=main>{article('div class=text')}</div><div class=sidebar><p>{SIDE}</p></div>{FOOT}</form></body>",
    f"<body><form id='aspnetForm'><table><tr><td>{MENU}</td><td>{article('div')}</td></tr></table>{FOOT}</form></body>",
    f"<body><div class='wrapper sidebar-left'><aside><p>{SIDE}</p></aside><main>{article('article')}<section class=comments><h3>2 comments</h3><article><p>{SIDE}</p></article><article><p>{SIDE} {SIDE}</p></article></section></main></div></body>",
    f"<body>{article('article')}<div id=comments>" + f"<div class=comment><p>{SIDE} {SIDE} {SIDE}</p></div>" * 6 + f"</div>{FOOT}</body>",
    f"<body>{MENU}<div class=post>{article('div class=entry')}<div class='newsletter signup'><p>{SIDE}</p><form><label>Your mail</label></form></div></div>{FOOT}</body>",
    f"<body><div class=notice><p>We use cookies to make this page better for you, as all do.</p></div>{article('article class=notice')}<div class=related><h3>More</h3><p>{SIDE}</p></div></body>",
]


def test_names_that_mislead_decide_nothing():
    for page in MISLEADING:
        assert texts(page) == MILL, page


def test_short_closes_and_lists_amid_the_text():
    close = "Thank you for reading."
    assert texts(f"<html><body><h1>The mill</h1><p>{LONG}</p><p>{close}</p></body></html>") == ["The mill", LONG, close]
    assert texts(f"<body>{MENU}<div><h1>The mill</h1><p>{LONG}</p><p>{MORE}</p><p>{LONG} {MORE}</p><p>{close}</p></div>{FOOT}</body>") == ["The mill", LONG, MORE, f"{LONG} {MORE}", close]
    page = f"<body>{MENU}<div class=content><h1>The mill</h1><p>{LONG}</p><ul><li><a href=/a>The old wheel</a><li><a href=/b>The new wheel</a></ul><p>{MORE}</p></div>{FOOT}</body>"
    assert texts(page) == ["The mill", LONG, "The old wheel", "The new wheel", MORE]
    assert texts(f"<article><p>{LONG}</p><p>So <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p></article>") == [LONG, "So a=b holds."]
    assert texts("<article><p>a\x1cb  c\u00a0d</p></article>") == ["a\x1cb c d"]


#: Generators of html_training by seeds that the table has not got, six layouts of each.
LAYOUTS = [html_training._wrapped, html_training._misnamed, html_training._commented, html_training._formed, html_training._closed]


def test_recall_and_precision_on_unseen_layouts():
    tree = H.tree()
    hit = lost = extra = 0
    for make in LAYOUTS:
        for k in range(91_000, 91_060):
            page, main = make(k)
            found, marks = H.blocks(page)
            for b, y in zip(found, tree.predict(H.features(found, marks)) >= 0.5):
                hit, lost, extra = hit + (y and b.text in main), lost + (not y and b.text in main), extra + (y and b.text not in main)
    print(f"recall {hit / (hit + lost):.4f}, precision {hit / (hit + extra):.4f}")
    assert hit / (hit + lost) >= 0.97 and hit / (hit + extra) >= 0.98


def test_time_is_linear_in_the_page():
    import time

    tree = H.tree()
    n = 12_000
    pages = ["<b>x" * n + "</i></p></section>" * n, "<div>" * n + "</div></b>" * n, "<p>a<b>" * n, "<li>a<ul>" * n, "<a href='" * n, "<!--" * n, "<script>" * n, "<td>a<b>" * n + "<tr>" * n, "<p " + "a=b'" * n + ">x</p>", "<p " + "=" * (8 * n)]
    for page in pages:
        began = time.perf_counter()
        H.main_text(page, tree)
        assert time.perf_counter() - began < 1.5, page[:30]


def plain_article(page):
    """Main text of the driver's pages, whose article has only h1 and p, by cutting at their tags."""
    import html
    import re

    inner = page.split("<article>", 1)[1].split("</article>")[0] if "<article>" in page else ""
    parts = re.split(r"</?(?:h1|p)>", inner)
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_query_equals_the_articles_of_all_pages(spark):
    want = {r.page_id: (r.url, plain_article(r.html)) for r in load(spark, SF, "pages").collect()}
    got = H.query(spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_unseen_layouts():
    page = """<html><body class="has-sidebar"><div class="site-header"><p>Valley times, founded long ago by three friends.</p></div>
    <div class="content-sidebar-wrap"><main id="main"><article class="post"><header class="entry-header"><h1>Fish &amp; chips</h1></header>
    <div class="entry-content"><p>First &lt;line&gt; here<br>and\n more.</p><p>Two<div class="ad-slot">An advert of some length that is prose.</div><p>Three&nbsp;words here
    <ul><li>item<li>item two</ul><form><p>Sign up for the letter, it is free.</p></form></div></article>
    <div id="comments"><p>What a fine text, I have read it twice over.</p></div></main>
    <aside class="sidebar"><p>Our offices are open from nine to five on all days.</p></aside></div>
    <div class="cookie-banner">We value your privacy, as do our partners.</div>
    <script>var x = "<p>no</p>";</script><footer><p>Copyright by all of us.</p></footer></body></html>"""
    assert texts(page) == ["Fish & chips", "First <line> here and more.", "Two", "Three words here", "item", "item two"]


def test_broken_pages():
    assert H.main_text(None, H.tree())[0] == H.main_text("", H.tree())[0] == H.main_text("<p", H.tree())[0] == ""
    assert texts("<article><p>Cut off in the middle of &am") == ["Cut off in the middle of &am"]
    assert texts("<article><p>1 < 2 and <b>bold</i></b></p></div></article>") == ["1 < 2 and bold"]
    assert texts("<article>" + "<div>" * 3000 + "<p>deep" + "</div>" * 10) == ["deep"]
    assert len(texts("<article>" + "<p>a word or two</p>" * 20000)) == 20000
    assert texts("<div class='layout sidebar-right'><p>Sponsored</p><main><p>a<aside>no</aside><p>b</main></div>") == ["a", "b"]
    assert texts("<nav><main><p>a</main></nav><article><p>b</article>") == ["b"]
    assert texts("<div>Start</div><article><p>a<p>b</article>") == ["a", "b"]
    assert texts("<nav>x</nav><article><h1>Title</h1><p><a href='/'>all of it a link</a></article>") == ["Title", "all of it a link"]


def test_nulls_repeats_extra_columns_and_no_rows(spark):
    rows = [(1, None, "u", 1), (1, None, "u", 1), (None, "<article><p>x</p></article>", None, 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, url string, text int").withColumn("_row", H.F.lit(1))
    assert sorted(r.text for r in H.extract(pages).collect()) == ["", "", "x"]
    assert H.extract(pages.limit(0)).count() == 0
