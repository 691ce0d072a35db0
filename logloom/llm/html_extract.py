"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a list of blocks (stretches of text between block-level tags). A block has its word count and link
density, those of the blocks before and after it, and the marks that it stands in: elements whose tag, class, id or role
words speak of main text or of page furniture. A mark alone decides nothing, as it may be the class of a layout wrapper,
of the article itself or a form around the page: with it go the share of the page's prose that its element holds, whether it holds
the page's title, and whether a mark of the other kind lies inside it. A decision tree, grown on the small labelled
table of html_training, weighs all of these and says which blocks are main text.
"""

import html
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import html_training
from logloom.llm.decision_tree import Tree, grow
from logloom.sources import load

# Names of HTML elements by role.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
_SILENT = frozenset("head script style template noscript svg annotation annotation-xml iframe object canvas audio video textarea select button datalist title noframes".split())
_RAW = frozenset("script style textarea title iframe noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav footer aside menu dialog search".split())
_MAIN = frozenset("article main".split())
_PARAGRAPHS = frozenset("p li dd dt blockquote pre td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open paragraph; li, td and so on end an open one of their kind.
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "title", "legend", "caption", "summary", "dt", "dd", "li"}
_ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
# Words of class, id and role attributes that mark what is not, or is, main text.
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side rail aside widget footer foot colophon toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social follow related recommended recommendations trending popular comment comments disqus reply replies respond discussion feedback form search searchbox pagination pager tags tagcloud copyright legal disclaimer outbrain taboola paywall skip contentinfo complementary adbox adslot adsense adunit adcontainer cookiebar cookiebanner cookienotice commentlist commenttext commentbody relatedposts sharebar".split()
)
_MAIN_WORDS = frozenset("article content main post entry story body text prose articlebody".split())
#: Furniture only outside main text; inside it they hold the title.
_HEADER_WORDS = frozenset("header masthead topbar".split())
#: Words that say where or how large an element is; a compound name counts by its other words, all of which must agree.
_PLACE_WORDS = frozenset(
    "site page global primary secondary left right top bottom inner outer upper lower sticky fixed mobile desktop large small box block list item items area section slot unit link links bar panel column col row icon button buttons title text more stories posts articles s wp js".split()
)

_TOKEN = regex.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|=?[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?)?|=)*+)(?:>|\Z)""",
    regex.S | regex.X,
)
_ATTRIBUTE = regex.compile(r"""(=?[^\s/>=]++)(?>\s*+=\s*+(?>"([^"]*+)"?|'([^']*+)'?|([^\s"'>][^\s>]*+))?)?""")
#: Class names of layout wrappers, which say what a page has, not what the element is.
_WRAPPER = regex.compile(r"^(?:has|no|with|without|is|js|layout)-|-with-|-wrap|-layout|container$")
_PART = regex.compile(r"[a-z]+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_NO_SPACE = regex.compile(r"(?:[^\s]|[\x1c-\x1f])+")
_CAMEL = regex.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "main", "main_share", "main_title", "chrome", "chrome_share", "chrome_title",
    "inner", "heading", "ends_sentence", "page_main", "sibling_share", "between_prose",
    "main_twins", "chrome_twins", "paragraph", "title_in_main",
)
#: A block of fewer words, or a heading, is no prose.
_PROSE_WORDS = 6


@dataclass(slots=True)
class Mark:
    """An element that speaks of main text (2 by its tag or role, 1 by class or id words) or of furniture (3 a form, 2 by its
    tag or role, 1 by class or id words), in another (-1: none), its name and class, the words of prose in it, and whether
    it holds the title."""

    outer: int
    main: int
    chrome: int
    kind: tuple[str, str]
    prose: int = 0
    title: bool = False


@dataclass(slots=True)
class Block:
    """``main`` and ``chrome``: places of the innermost mark of either kind (-1: none); ``mark``: of the innermost at all;
    ``siblings`` numbers the element that the block's own element stands in; ``heading`` its level (0: none); ``paragraph``:
    whether a p, an item or a quotation is the innermost block element."""

    text: str
    words: int
    linked: int
    main: int
    chrome: int
    mark: int
    heading: int
    siblings: int
    paragraph: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0

    @property
    def prose(self) -> int:
        return 0 if self.heading or self.words < _PROSE_WORDS else self.words - self.linked


@dataclass(slots=True)
class _Open:
    """An open element: innermost marks, whether text is silent, linked or a heading, the numbers of the innermost block
    element and of the one around that, and how many block elements are open up to this one."""

    name: str = ""
    main: int = -1
    chrome: int = -1
    mark: int = -1
    silent: bool = False
    link: bool = False
    heading: int = 0
    box: int = 0
    around: int = -1
    blocks: int = 0
    paragraph: bool = False


def _split(text: str) -> list[str]:
    """Words between white space; the separators U+001C to U+001F are not taken for it, as str.split does."""
    return _NO_SPACE.findall(text) if _SEPARATORS.search(text) else text.split()


def _named_kind(token: str) -> tuple[int, bool, bool]:
    """What a class, id or role word says: main text, furniture, header. A compound says furniture only if each of its
    words does, or says a place or main text ("ad-slot", "post-comments", but not "form-factor" or "tag-search")."""
    if _WRAPPER.search(token):
        return False, False, False
    parts = set(_PART.findall(token)) | ({token} & _CHROME_WORDS)
    known = parts <= _CHROME_WORDS | _HEADER_WORDS | _MAIN_WORDS | _PLACE_WORDS
    chrome = known and bool(parts & _CHROME_WORDS)
    top = known and bool(parts & _HEADER_WORDS)
    return bool(parts & _MAIN_WORDS) and known and not chrome and not top, chrome, top


def _marks(name: str, attributes: str, in_main: bool) -> tuple[int, int, bool, str]:
    """How strongly an element says that it is main text, and furniture; whether it is hidden; its class."""
    class_ = ""
    main, chrome, hidden, top = 2 if name in _MAIN else 0, 3 if name == "form" else 2 if name in _CHROME else 0, False, name == "header"
    if "=" in attributes or "hidden" in attributes.lower():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "class":
                class_ = value
            if key in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                for token in _CAMEL.sub("-", value).lower().replace("_", "-").split():
                    says_main, says_chrome, says_top = _named_kind(token)
                    if says_chrome:
                        chrome = max(chrome, 2 if key == "role" else 1)
                    top |= says_top
                    if says_main or token in ("article-body",):
                        main = max(main, 2 if key in ("role", "itemprop") else 1)
            elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "").lower()) or (key == "aria-hidden" and value.lower() == "true"):
                hidden = True
    return main, max(chrome, int(top and not in_main)), hidden, class_


class _Stack:
    """The open elements, with the places of each name, so that no tag looks through all of them."""

    def __init__(self):
        self.open, self.places = [_Open()], {}

    def push(self, element: _Open):
        self.places.setdefault(element.name, []).append(len(self.open))
        self.open.append(element)

    def last(self, name: str) -> int:
        """Depth of the innermost open element of a name; 0 if there is none."""
        at = self.places.get(name)
        return at[-1] if at else 0

    def has_block(self, depth: int) -> bool:
        """Whether a block-level element is open at ``depth`` or further in."""
        return self.open[-1].blocks > self.open[depth - 1].blocks

    def cut(self, depth: int):
        while len(self.open) > depth:
            self.places[self.open.pop().name].pop()


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The text blocks of a page in order, and its marks, outer ones first; scripts, styles, head, controls and hidden
    elements have no blocks. The time is linear in the length of the page."""
    out: list[Block] = []
    marks: list[Mark] = []
    boxes = 0
    stack = _Stack()
    text: list[str] = []
    linked: list[str] = []

    def flush():
        whole = " ".join(_split("".join(text)))
        if whole:
            top = stack.open[-1]
            out.append(Block(whole, len(_split(whole)), len(_split("".join(linked))), top.main, top.chrome, top.mark, top.heading, top.around, top.paragraph))
        text.clear()
        linked.clear()

    def add(s: str):
        top = stack.open[-1]
        if not top.silent:
            s = html.unescape(s) if "&" in s else s
            text.append(s)
            if top.link:
                linked.append(s)

    def close(depth: int):
        if stack.has_block(depth):
            flush()
        stack.cut(depth)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = stack.last(name)
            if depth:
                close(depth)
            elif name in _BLOCK:
                flush()
            continue
        if name == "br":
            add(" ")
            continue
        if name in _BLOCK:
            flush()
            depth = stack.last("p")
            if name in _ENDS_P and depth and (depth + 1 == len(stack.open) or not stack.has_block(depth + 1)):
                close(depth)
            ends = _ENDS_SAME.get(name)
            if ends:
                depth = max(map(stack.last, ends))
                if depth and depth > max(map(stack.last, ("ul", "ol", "table", "dl"))):
                    close(depth)
            if name == "body" and stack.last("head"):
                close(stack.last("head"))
        if name in _VOID:
            continue
        top = stack.open[-1]
        main, chrome, hidden, class_ = _marks(name, m[3], top.main >= 0)
        is_block, mark = name in _BLOCK, top.mark
        if (main or chrome) and name not in ("body", "html"):
            mark = len(marks)
            marks.append(Mark(top.mark, main, chrome, (name, class_)))
        else:
            main = chrome = 0
        boxes += is_block
        stack.push(
            _Open(
                name, mark if main else top.main, mark if chrome else top.chrome, mark, top.silent or hidden or name in _SILENT, top.link or name == "a",
                int(name[1]) if name in _HEADINGS else top.heading, boxes if is_block else top.box, top.box if is_block else top.around, top.blocks + is_block,
                name in _PARAGRAPHS if is_block else top.paragraph,
            )
        )
        if name in _RAW and not m[3].endswith("/"):
            end = regex.compile(rf"</{name}(?=[\s/>]|\Z)", regex.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out, marks


def _title(found: list[Block]) -> int:
    """Place of the heading that seems to be the page's title, or -1: the first of level 1 (if none, of level 2) that as much as a fifth
    of the longest prose after any heading follows."""
    follow, at = {}, -1
    for i, b in enumerate(found):
        if b.heading and b.heading < 3:
            at = i
            follow[at] = 0
        elif at >= 0:
            follow[at] += b.prose
    most = max(follow.values(), default=0)
    good = [i for i, n in follow.items() if 5 * n >= most]
    return next((i for i in good if found[i].heading == 1), good[0] if good else -1)


def features(found: list[Block], marks: list[Mark]) -> np.ndarray:
    """One row of FEATURES for each block; at the ends of a page a neighbour has no words and no links."""
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    siblings: dict[int, int] = {}
    prose = [b.prose for b in found]
    if not any(prose):
        prose = [b.words - b.linked for b in found]
    for b, n in zip(found, prose):
        siblings[b.siblings] = siblings.get(b.siblings, 0) + n
        if b.mark >= 0:
            marks[b.mark].prose += n
    title = _title(found)
    if title >= 0 and found[title].mark >= 0:
        marks[found[title].mark].title = True
    for m in reversed(marks):
        if m.outer >= 0:
            marks[m.outer].prose += m.prose
            marks[m.outer].title |= m.title
    total = max(1, sum(prose))
    twins = Counter(m.kind for m in marks)
    # First and last prose inside each main mark (or outside all): what lies between is amid the text.
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if prose[i] and b.chrome <= b.main:
            first.setdefault(b.main, i)
            last[b.main] = i
    for i, b in enumerate(found):
        x[i, 0], x[i, 1] = b.words, b.density
        if b.main >= 0:
            m = marks[b.main]
            x[i, 6:9] = m.main, m.prose / total, m.title
            x[i, 18] = twins[m.kind]
        if b.chrome >= 0:
            c = marks[b.chrome]
            x[i, 9:12] = c.chrome, c.prose / total, c.title
            x[i, 19] = twins[c.kind]
        if b.main >= 0 and b.chrome >= 0:
            x[i, 12] = np.sign(b.main - b.chrome)
        x[i, 13], x[i, 14] = b.heading > 0, b.text[-1] in ".!?…。\"”»:;)"
        x[i, 16] = siblings[b.siblings] / total
        x[i, 20] = b.paragraph
        x[i, 17] = first.get(b.main, i) < i < last.get(b.main, i)
    # Main marks of the page count where no mark of furniture of less than half the prose is around them.
    small = []
    for m in marks:
        small.append((m.chrome > 0 and 2 * m.prose < total) or (m.outer >= 0 and small[m.outer]))
    x[:, 15] = max((m.main for m, in_small in zip(marks, small) if not in_small), default=0)
    x[:, 21] = title >= 0 and found[title].main >= 0
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    return x


@lru_cache(maxsize=1)
def tree() -> Tree:
    """Grown from the labelled table, once a process; a block is labelled main if the table lists its text."""
    xs, ys = [], []
    for page, main in html_training.PAGES:
        found, marks = blocks(page)
        xs.append(features(found, marks))
        ys.append(np.array([b.text in main for b in found], float))
    return grow(np.vstack(xs), np.concatenate(ys), depth=24)


def main_text(page: str | None, classifier: Tree) -> tuple[str, int, int]:
    """Main text, blocks kept, and blocks in all."""
    found, marks = blocks(page) if page else ([], [])
    if not found:
        return "", 0, 0
    keep = classifier.predict(features(found, marks)) >= 0.5
    return "\n\n".join(b.text for b, k in zip(found, keep) if k), int(keep.sum()), len(found)


def _rows(classifier: Tree):
    def rows(batches):
        for batch in batches:
            got = [main_text(h.as_py(), classifier) for h in batch.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                names=["_row", "text", "n_kept", "n_blocks"],
            )

    return rows


def extract(pages: DataFrame, html_col: str = "html", classifier: Tree | None = None) -> DataFrame:
    """``pages`` without ``html_col``, plus text (main blocks joined by two newlines; empty if none), n_kept, n_blocks.

    Null and empty pages have no blocks. Broken markup is read as far as it goes, long pages whole and in linear time.
    Repeated rows give repeated rows; a block for which both labels tie is main text. Input columns of the names above
    give way. No shuffle; the tree travels with the tasks.
    """
    added = ["text", "n_kept", "n_blocks"]
    names = [c for c in pages.columns if c != html_col and c not in added]
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(html_col).alias("_html"))
    out = packed.mapInArrow(_rows(classifier or tree()), f"_row {packed.schema['_row'].dataType.simpleString()}, text string, n_kept int, n_blocks int")
    return out.select(*[F.col(f"_row.`{c}`") for c in names], *added)


def query(spark, sf_dir):
    found = extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op1_html_extraction": query}
ORACLES: dict[str, str] = {}
