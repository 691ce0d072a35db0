"""The labelled table of the block classifier: small pages, and the texts of their blocks that are main text.

Some pages are written out; the others follow from a rule: furniture (menus, taglines, adverts, teasers, sidebars, foot
lines) around an article, with or without tags and class names that give the article or the furniture away. Where
nothing does, only word counts and link densities of a block and its neighbours tell main text from the rest. In some,
names mislead: layout wrappers, whole-page forms and articles with a class word of furniture, and comments that are longer than
the article and are articles themselves.
"""

import random

_MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li><li><a href="/b">About us</a></li></ul></nav>'
_FOOT = "<footer><p>&copy; 2020 Example Press. All rights reserved.</p><a href='/t'>Terms</a></footer>"

_WRITTEN: list[tuple[str, set[str]]] = [
    (
        f"<html><head><title>Rain</title><style>p{{}}</style></head><body>{_MENU}<div class='ad'>Buy a warm coat today.</div><article><h1>Rain in May</h1>"
        f"<p>It rained for nine days and the river rose above the lower bridge.</p><p>Nobody left.</p><p>By the end of the month <a href='/x'>the mill</a> stood in water up to its second floor.</p></article>{_FOOT}</body></html>",
        {"Rain in May", "It rained for nine days and the river rose above the lower bridge.", "Nobody left.", "By the end of the month the mill stood in water up to its second floor."},
    ),
    (
        f"<body><header><h1>The Daily Example</h1><p>All the news of the valley, every day.</p></header>{_MENU}<main><article><header><h2>A new bridge</h2></header>"
        "<p>The council voted for a bridge of stone.</p><p>Work starts in spring</p><aside><h3>Related</h3><ul><li><a href='/r'>The old bridge falls after a long winter of storms</a></li></ul></aside>"
        "<p>The cost is not yet known, and two members voted against it.</p><form><label>Your mail address please</label><input></form></article>"
        "<section class='comments'><h3>2 comments</h3><div class='comment'><p>I crossed the old one every day of my life and will miss it.</p></div><article class='comment'><p>About time, in my opinion.</p></article></section></main>"
        f"{_FOOT}</body>",
        {"A new bridge", "The council voted for a bridge of stone.", "Work starts in spring", "The cost is not yet known, and two members voted against it."},
    ),
    (
        f"<body><div id='cookie-notice'><p>We use cookies to give you a better visit. Read more in our policy.</p></div><div id='header'><h1>Kitchen notes</h1></div>{_MENU}"
        "<div id='content'><h2>Bread</h2><p>Mix flour, water and salt, and wait for a day.</p><ul><li>Flour, one pound</li><li>Water</li><li>Salt</li></ul><p>Bake.</p>"
        "<div class='share'><a href='#'>Tell a friend</a></div></div><div id='sidebar'><h3>Popular</h3><p>These are the recipes that readers liked most this week.</p></div>"
        "<div id='footer'>Made with care in a small kitchen.</div></body>",
        {"Bread", "Mix flour, water and salt, and wait for a day.", "Flour, one pound", "Water", "Salt", "Bake."},
    ),
    (
        "<body><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li><li><a href='/3'>Three</a></li></ul><h1>On the age of hills</h1>"
        "<p>Hills are older than rivers in this country, as the layers of chalk show.</p><p>The chalk is the floor of a sea that dried up long before there were rivers at all.</p>"
        "<p>It holds shells.</p><p>Whoever digs a well here meets them at a depth of ten to twenty feet, in bands as thick as a hand.</p>"
        "<p><a href='/c'>Contact</a> | <a href='/i'>Imprint</a></p></body>",
        {
            "On the age of hills", "Hills are older than rivers in this country, as the layers of chalk show.", "It holds shells.",
            "The chalk is the floor of a sea that dried up long before there were rivers at all.",
            "Whoever digs a well here meets them at a depth of ten to twenty feet, in bands as thick as a hand.",
        },
    ),
    (
        f"<body>{_MENU}<article><h1>HOW! TO! WIN!</h1><p>WIN! WIN! WIN!</p><p>a | b | c</p><p>###</p><div class='notice'>This article is older than two years and may be out of date.</div>"
        f"<p>One</p><blockquote>They said that it could not be done, and it was not.</blockquote><footer>Written by the staff.</footer></article><aside><p>Subscribe to our letter and miss nothing of what happens here.</p></aside>{_FOOT}</body>",
        {"HOW! TO! WIN!", "WIN! WIN! WIN!", "a | b | c", "###", "One", "They said that it could not be done, and it was not."},
    ),
    (
        f"<body>{_MENU}<div class='post'><h2 class='title'><a href='/p'>Why owls turn their heads</a></h2><p>An owl can not move its eyes, so it has to turn its head.</p><table><tr><td>Barn owl</td><td>270 degrees</td></tr></table>"
        "<p>See <a href='/q'>the page on eyes</a>.</p><div class='post-comments'><p>My owl does not do this at all, and I have had it for years.</p></div></div><div class='widget'><p>Text of a widget that says hello to all.</p></div></body>",
        {"Why owls turn their heads", "An owl can not move its eyes, so it has to turn its head.", "Barn owl", "270 degrees", "See the page on eyes."},
    ),
    (
        "<body><p>There was once a tailor who had three sons and a single goat.</p><p>The goat gave milk for all of them, and so it had to have good food.</p><p>It did.</p>"
        "<p>Each day one of the sons led it out to the meadow where the best herbs grew, and let it eat and jump about.</p></body>",
        {
            "There was once a tailor who had three sons and a single goat.", "The goat gave milk for all of them, and so it had to have good food.", "It did.",
            "Each day one of the sons led it out to the meadow where the best herbs grew, and let it eat and jump about.",
        },
    ),
    (
        "<body><div><a href='/1'>Sport</a> <a href='/2'>Weather</a> <a href='/3'>Traffic</a></div><div>Log in</div><div><p>The match ended two to one after a goal in the last minute of play.</p>"
        "<p>The crowd had begun to leave when the keeper ran forward and scored, for the first time in his life.</p></div><div><a href='/n'>Next page</a></div><div>Back to top</div></body>",
        {"The match ended two to one after a goal in the last minute of play.", "The crowd had begun to leave when the keeper ran forward and scored, for the first time in his life."},
    ),
    (f"<body>{_MENU}<div class='ad'>Was sold for less than you think.</div><article><h1>Only a title</h1></article>{_FOOT}</body>", {"Only a title"}),
    (f"<body>{_MENU}<div class='banner'>Call now and save ten of a hundred on all that we have in store for you.</div>{_FOOT}</body>", set()),
    (
        f"<body>{_MENU}<main><p>Word.</p><p>Short again</p><div><a href='/l'>A link alone in the main part</a></div><p>And a longer line to end the page with, as pages go.</p></main><div role='complementary'>More stories of the day.</div></body>",
        {"Word.", "Short again", "A link alone in the main part", "And a longer line to end the page with, as pages go."},
    ),
]

_WORDS = "river stone bridge winter market letter garden window paper morning council harvest railway captain village teacher copper music silver forest island doctor summer engine valley bread".split()


class _Writer:
    """Texts of a page, each different from all others of it."""

    def __init__(self, seed: int):
        self.rnd, self.seen = random.Random(seed), set()

    def some(self, least: int, most: int, stop: str = "") -> str:
        while True:
            n = self.rnd.randint(least, most)
            text = " ".join(self.rnd.choice(_WORDS) for _ in range(n)).capitalize() + stop
            if text not in self.seen:
                self.seen.add(text)
                return text

    def chance(self, p: float) -> bool:
        return self.rnd.random() < p


def _links(w: _Writer, n: int, listed: bool) -> str:
    items = [f"<a href='/{i}'>{w.some(1, 3, w.rnd.choice(['', '', '.', '!']))}</a>" for i in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if listed else "<div>" + " | ".join(items) + "</div>"


def _article(w: _Writer, plain: bool) -> tuple[str, set[str]]:
    """Title and paragraphs; a ``plain`` one begins and ends with a long paragraph and has no link-dense ones."""
    main, out = set(), []

    def put(tag: str, text: str, inner: str | None = None):
        main.add(text)
        out.append(f"<{tag}>{inner or text}</{tag}>")

    if w.chance(0.85):
        put(w.rnd.choice(["h1", "h2", "div", "h1"]), w.some(2, 9))
    n = w.rnd.randint(2, 7)
    for i in range(n):
        if plain and i in (0, n - 1):
            put("p", w.some(16, 50, "."))
            if i and w.chance(0.3):
                put("p", w.some(1, 8, w.rnd.choice(".!")))
        elif w.chance(0.15):
            put(w.rnd.choice(["h3", "p", "div"]), w.some(1, 5))
        elif w.chance(0.25):
            put("p", w.some(1, 8, w.rnd.choice(["", "."])))
        elif not plain and w.chance(0.3):
            text = w.some(1, 14, w.rnd.choice(["", "."]))
            put("p", text, f"<a href='/x'>{text}</a>")
        elif w.chance(0.2):
            head, linked, tail = w.some(6, 20), w.some(1, 3), w.some(4, 20, ".")
            put("p", f"{head} {linked} {tail}", f"{head} <a href='/y'>{linked}</a> {tail}")
        else:
            put(w.rnd.choice(["p", "p", "div", "li"]), w.some(9, 50, "."))
    return "".join(out), main


def _before(w: _Writer) -> str:
    out = _links(w, w.rnd.randint(3, 7), w.chance(0.6))
    if w.chance(0.4):
        out += f"<div>{w.some(2, 9, w.rnd.choice(['', '.']))}</div>"
        if w.chance(0.5):
            out += _links(w, w.rnd.randint(1, 4), w.chance(0.5))
    return out


def _teasers(w: _Writer, n: int) -> str:
    kind = w.rnd.choice(["h3", "div"])
    return "".join(f"<{kind}><a href='/t{i}'>{w.some(3, 9, w.rnd.choice(['', '.']))}</a></{kind}><div>{w.some(6, 22, w.rnd.choice(['', '.']))}</div>" for i in range(n)) + _links(w, 2, False)


def _after(w: _Writer) -> str:
    out = ""
    if w.chance(0.35):
        out += _teasers(w, w.rnd.randint(1, 3)) if w.chance(0.5) else f"<div>{w.some(1, 3)}</div>" + _links(w, w.rnd.randint(3, 6), True)
    if w.chance(0.4):
        out += _links(w, w.rnd.randint(1, 4), w.chance(0.3))
    if w.chance(0.7):
        out += f"<{w.rnd.choice(['div', 'p'])}>{w.some(2, 11, w.rnd.choice(['', '', '.']))}</div>"
    return out


def _unmarked(seed: int) -> tuple[str, set[str]]:
    w = _Writer(seed)
    inner, main = _article(w, plain=True)
    cell = w.chance(0.2)
    parts = [_before(w) if w.chance(0.85) else "", inner, _after(w) if w.chance(0.85) else ""]
    return "<body>" + ("<table><tr>" + "".join(f"<td>{x}</td>" for x in parts) + "</tr></table>" if cell else "".join(f"<div>{x}</div>" for x in parts)) + "</body>", main


def _bare(seed: int) -> tuple[str, set[str]]:
    """A few short lines and nothing else."""
    w = _Writer(seed)
    lines = [w.some(1, 13, w.rnd.choice([".", ".", ""])) for _ in range(w.rnd.randint(1, 4))]
    return "<body>" + (f"<h1>{lines[0]}</h1>" if w.chance(0.4) else f"<p>{lines[0]}</p>") + "".join(f"<p>{x}</p>" for x in lines[1:]) + "</body>", set(lines)


_FURNITURE = ["<nav>{}</nav>", "<aside>{}</aside>", "<footer>{}</footer>", "<div class='ad'>{}</div>", "<div class='sidebar'>{}</div>", "<div id='cookie-notice'>{}</div>", "<form>{}</form>", "<div class='site-footer'>{}</div>", "<aside><article>{}</article></aside>", "<nav><main>{}</main></nav>", "<footer><div class='text'>{}</div></footer>"]


def _furniture(w: _Writer) -> str:
    kind = w.rnd.choice(_FURNITURE)
    if w.chance(0.3):
        return kind.format(f"<h3>{w.some(1, 4)}</h3>" + _teasers(w, 1))
    return kind.format("".join(f"<p>{w.some(1, 30, w.rnd.choice(['', '.']))}</p>" for _ in range(w.rnd.randint(1, 3))) + (_links(w, 2, True) if w.chance(0.4) else ""))


def _marked_furniture(seed: int) -> tuple[str, set[str]]:
    """Furniture that says so around an article that does not."""
    w = _Writer(seed)
    inner, main = _article(w, plain=True)
    return f"<body>{_furniture(w)}{_furniture(w)}<div>{inner}</div>{_furniture(w)}{_after(w) if w.chance(0.3) else ''}</body>", main


# Class words of furniture that layout wrappers and articles may have as well.
_MISLEADING = "sidebar sidebar-left sidebar-right page-sidebar content-sidebar banner footer-fixed notice newsletter social share related story-promo popup widget comments article-comments discussion login popular feedback legal recommended promo".split()


def _opener(w: _Writer) -> tuple[str, str]:
    name = w.rnd.choice(["<article>", "<main>", "<div role='main'>", "<div class='content'>", "<div id='story'>", "<div>", "<section>"])
    return name, "</" + name[1:-1].split()[0] + ">"


def _wrapped(seed: int) -> tuple[str, set[str]]:
    """A layout wrapper whose class speaks of furniture, around furniture and the article."""
    w = _Writer(seed)
    inner, main = _article(w, plain=True)
    open_, close = _opener(w)
    name = w.rnd.choice(["wrapper ", "page ", "", "layout ", "row "]) + w.rnd.choice(_MISLEADING)
    inside = (_furniture(w) if w.chance(0.5) else "") + open_ + inner + close + (_furniture(w) if w.chance(0.6) else "")
    return f"<body>{_furniture(w) if w.chance(0.6) else ''}<div class='{name}'>{inside}</div>{_furniture(w) if w.chance(0.6) else ''}</body>", main


def _misnamed(seed: int) -> tuple[str, set[str]]:
    """An article with a class word of furniture, and furniture with the same one."""
    w = _Writer(seed)
    inner, main = _article(w, plain=True)
    word = w.rnd.choice(_MISLEADING)
    open_ = w.rnd.choice([f"<article class='{word}'>", f"<article class='post {word}'>", f"<div class='post {word}'>", f"<section id='{word}'>", f"<div class='{word}'>"])
    close = "</" + open_[1:].split()[0] + ">"
    same = f"<div class='{word}'><p>{w.some(2, 25, '.')}</p></div>" if w.chance(0.5) else ""
    return f"<body>{_furniture(w) if w.chance(0.6) else ''}{open_}{inner}{close}{same}{_furniture(w)}</body>", main


def _comments(w: _Writer, most: int) -> str:
    kind = w.rnd.choice(["<div class='comment'>{}</div>", "<article>{}</article>", "<article class='comment'>{}</article>", "<li>{}</li>", "<div class='comment-body text'>{}</div>"])
    items = "".join(kind.format(f"<p>{w.some(1, 60, w.rnd.choice(['.', '', '!']))}</p>" + (f"<p>{w.some(3, 30, '.')}</p>" if w.chance(0.2) else "")) for _ in range(w.rnd.randint(1, most)))
    head = f"<{(h := w.rnd.choice(['h2', 'h3', 'h4', 'p']))}>{w.some(1, 3)}</{h}>" if w.chance(0.7) else ""
    box = w.rnd.choice(["<section class='comments'>{}</section>", "<div id='comments'>{}</div>", "<ol class='comment-list'>{}</ol>", "<div class='discussion'>{}</div>", "<section id='replies'>{}</section>"])
    return box.format(head + items)


def _commented(seed: int) -> tuple[str, set[str]]:
    """Comments behind or inside the article's element, at times of more words than the article."""
    w = _Writer(seed)
    inner, main = _article(w, plain=True)
    open_, close = _opener(w)
    said = _comments(w, w.rnd.choice([3, 12, 25]))
    body = open_ + inner + said + close if w.chance(0.3) and open_ != "<div>" else open_ + inner + close + said
    if w.chance(0.3):
        body = "<main>" + body + "</main>"
    return f"<body>{_furniture(w) if w.chance(0.6) else ''}{body}{_furniture(w) if w.chance(0.6) else ''}</body>", main


def _formed(seed: int) -> tuple[str, set[str]]:
    """A form around the whole page."""
    page, main = random.Random(seed).choice([_marked_furniture, _wrapped, _commented, lambda k: _marked(k, _OPEN), lambda k: _marked(k, _WEAK)])(seed)
    return page.replace("<body>", "<body><form id='pageForm' method='post'>").replace("</body>", "</form></body>"), main


def _closed(seed: int) -> tuple[str, set[str]]:
    """A title, prose and a short close, straight in the body or one element; foot lines there are no sentences."""
    w = _Writer(seed)
    lines = [w.some(14, 60, ".") for _ in range(w.rnd.randint(1, 5))] + [w.some(1, 7, w.rnd.choice(".!"))]
    title = w.some(1, 7)
    inner = (f"<h1>{title}</h1>" if w.chance(0.7) else f"<div>{title}</div>") + "".join(f"<p>{x}</p>" for x in lines)
    if w.chance(0.4):
        inner = f"<div>{inner}</div>"
    foot = f"<div>{w.some(2, 9)}</div>" if w.chance(0.5) else ""
    line = f"<div>{w.some(2, 6)}</div>" if w.chance(0.3) else ""
    return f"<body>{_links(w, w.rnd.randint(2, 6), w.chance(0.5)) if w.chance(0.5) or line else ''}{line}{inner}{foot}</body>", {title, *lines}


def _tiny(seed: int) -> tuple[str, set[str]]:
    """An article of a few words that its tag alone tells from lines around it."""
    w = _Writer(seed)
    lines = [w.some(1, 5, w.rnd.choice(["", "."])) for _ in range(w.rnd.randint(1, 4))]
    name = w.rnd.choice(["article", "main"])
    if w.chance(0.6):  # furniture of more words than the article
        around = [f"<{t}><p>{w.some(8, 60, w.rnd.choice(['.', '']))}</p></{t}>" if w.chance(0.7) else _furniture(w) for t in ("aside", "footer", "nav") if w.chance(0.7)]
        title = f"<h1>{(t := w.some(2, 9))}</h1>" if w.chance(0.7) else ""
        main = {*lines, t} if title else set(lines)
        return f"<body>{''.join(around[1:])}<{name}>{title}{''.join(f'<p>{x}</p>' for x in lines)}</{name}>{''.join(around[:1])}</body>", main
    line = lambda p: w.rnd.choice(["<div>{}</div>", "<nav>{}</nav>", "<p>{}</p>", "<nav><main>{}</main></nav>", "<aside><article>{}</article></aside>"]).format(w.some(1, 6)) if w.chance(p) else ""
    return f"<body>{line(0.7)}<{name}>{''.join(f'<p>{x}</p>' for x in lines)}</{name}>{line(0.5)}</body>", set(lines)


_OPEN = ["<article>", "<main>", "<div role='main'>", "<article class='post'>"]
_WEAK = ["<div class='content'>", "<section id='main-content'>", "<div class='entry-content'>", "<div id='story'>"]


def _marked(seed: int, openers: list[str]) -> tuple[str, set[str]]:
    """An article that says so, amid furniture that may not; in the looser wrappers lists of links are no main text."""
    w = _Writer(seed)
    inner, main = _article(w, plain=openers is _WEAK)
    for _ in range(w.rnd.randint(0, 2)):
        inner = inner.replace("</p>", "</p>" + _furniture(w), 1)
    if openers is _WEAK and w.chance(0.6):
        inner = (_links(w, w.rnd.randint(3, 7), True) if w.chance(0.5) else "") + inner + _links(w, w.rnd.randint(3, 7), True)
    if w.chance(0.3):  # a list of links amid the text belongs to it
        items = [w.some(1, 6) for _ in range(w.rnd.randint(1, 4))]
        at = inner.find("</p><")
        if 0 <= at < inner.rfind("<p>"):
            inner = inner[: at + 4] + "<ul>" + "".join(f"<li><a href='/'>{x}</a></li>" for x in items) + "</ul><p>" + (last := w.some(12, 30, ".")) + "</p>" + inner[at + 4 :]
            main |= {*items, last}
    prose = "".join(f"<p>{w.some(1, 40, w.rnd.choice(['', '.']))}</p>" for _ in range(w.rnd.randint(0, 3)))
    name = w.rnd.choice(openers)
    close = "</" + name[1:-1].split()[0] + ">"
    return f"<body>{_furniture(w) if w.chance(0.5) else ''}{_before(w) if w.chance(0.7) else ''}{prose}{name}{inner}{close}{_furniture(w) if w.chance(0.5) else ''}{prose.replace('<p>', '<p>Also ') if w.chance(0.5) else _after(w)}</body>", main


PAGES = (
    _WRITTEN
    + [_unmarked(k) for k in range(250)]
    + [_bare(k) for k in range(500, 620)]
    + [_marked_furniture(k) for k in range(1000, 1200)]
    + [_marked(k, _OPEN) for k in range(2000, 2250)]
    + [_marked(k, _WEAK) for k in range(3000, 3250)]
    + [_wrapped(k) for k in range(4000, 4300)]
    + [_misnamed(k) for k in range(5000, 5250)]
    + [_commented(k) for k in range(6000, 6600)]
    + [_formed(k) for k in range(7000, 7500)]
    + [_closed(k) for k in range(8000, 8250)]
    + [_tiny(k) for k in range(9000, 9300)]
)
