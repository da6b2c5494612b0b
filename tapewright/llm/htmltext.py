"""Main text of web pages by two passes of block rules.

A page is cut into blocks: runs of text between tags that start or end a paragraph. The first pass judges a block by itself: boilerplate if it lies in
an element that is no part of an article by its name, class, id or role, or if most of it is links; good if it is long and dense in stop words; else
ambiguous. The second pass gives an ambiguous block the label of its nearest decided neighbour: first the one that shares more enclosing elements
with it, then the one fewer blocks away; a heading looks ahead first. Where a page marks its article (article or itemprop=articleBody, else main or role=main),
ambiguous blocks in there are good as they stand, and blocks outside all marks never are, so that short texts and texts without stop words keep all of
their paragraphs. Where no block at all is good, ambiguous ones are.

Stop words are those of the languages listed; a page without any (another script, say) is judged by length and links alone.

Character references are decoded, white space (Unicode's) becomes one space, and good blocks are joined by an empty line in page order.
Null html counts as empty and gives ''. Repeated rows and null ids are pages of their own; an empty table gives an empty result; other columns are ignored. Elements
below DEPTH others are not told apart from these, as in browsers; their text is. Time grows in proportion to a page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tapewright.llm.common import slices

#: Common function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was were which with you
    als am auf aus bei das dem den der des die ein eine einen einer es für hat ich im ist mit nicht noch sich sie sind und von war wie zu zum zur
    au aux avec ce ces dans de du elle en est et il la le les mais ne nous on ou par pas pour que qui sa se son sur un une
    al como con del el la las lo los más muy no para pero por se si sin su sus una y
    che di e gli nel non per più sono ao com da do em mais na não os um uma dat een het met niet te van voor zijn""".split()
)
#: Elements whose content is never shown as text; it is skipped unread up to the end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end blocks; all others stand within a line of text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
    hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul""".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold no part of an article. A header is one only outside of articles.
ASIDE = frozenset("head nav footer aside form noscript template svg object select option optgroup datalist button dialog menu canvas audio video map".split())
#: Roles of such elements.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id that tell such elements, and beginnings of such words.
HINTS = frozenset(
    """ad ads adv adsense adsbygoogle promo promos promotion promoted nav navigation menu menus submenu sidebars masthead topbar toolbar
    consent gdpr notice notices notification notifications banner banners popup modal overlay alert share sharing social related recommended
    recommendations subscribe subscription signup login search searchbox pagination pager paging copyright skip""".split()
)
BEGINNINGS = ("advert", "sidebar", "cookie", "breadcrumb", "newsletter", "sponsor", "footer", "navbar")
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: A class or id with header tells a page's header, unless one of these stands with it.
OWN_HEADERS = frozenset("article entry post content story".split())
#: Start tags before which an open item of the same list or table ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

GOOD_LENGTH = 140
GOOD_DENSITY = 0.15
LOW_DENSITY = 0.05
LINK_DENSITY = 0.5
#: Words from which a block tells whether a page's language has listed stop words.
TELLING_WORDS = 20
DEPTH = 512
#: How a page marks its article.
MAIN, ARTICLE = 1, 2

_MARK = re.compile(r"<(?:!--|[!?/]|[a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    """Text of one block, its characters in links, and where it stands.

    depth counts the elements around it, low those of them that are around the block before as well; mark is how its article is marked (0: it isn't),
    hint the innermost element around it that is no part of an article (0: none).
    """

    __slots__ = ("depth", "hint", "label", "linked", "low", "mark", "pieces", "tag", "text")

    def __init__(self, depth: int, low: int, mark: int, hint: int, tag: str) -> None:
        self.depth, self.low, self.mark, self.hint, self.tag = depth, low, mark, hint, tag
        self.pieces: list[str] = []
        self.linked = 0
        self.label: bool | None = None
        self.text = ""


def attributes(said: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(said):
        out.setdefault(name.lower(), unescape(value.strip("\"'")))
    return out


def judged(tag: str, own: dict[str, str], mark: int, nested: bool) -> tuple[bool, bool, int]:
    """Of an element: whether it is no part of an article, whether it holds comments, and how it marks an article.

    mark is that of the elements around it; nested: one of these is an article.
    """
    words = {p.lower() for c in ("class", "id") for p in _PART.findall(own.get(c, ""))} if tag not in ("html", "body") else set()
    role = own.get("role", "").lower()
    # readers' comments are often articles in the article, or articles with a class
    comments = nested or bool(words & {"comment", "reply"}) if tag == "article" else bool(words & COMMENTS)
    marks = 0 if comments else ARTICLE if tag == "article" or own.get("itemprop", "").lower() == "articlebody" else MAIN if tag == "main" or role == "main" else 0
    header = tag == "header" or "header" in words and not words & OWN_HEADERS
    named = bool(words & HINTS) or any(w.startswith(BEGINNINGS) for w in words) or header and not mark
    unseen = "hidden" in own or "display:none" in own.get("style", "").lower().replace(" ", "")
    return comments or unseen or tag in ASIDE or role in ROLES or named and not marks, comments, marks


class Cutter:
    """Cuts one page into blocks. The open elements are a stack; inline ones are in it only if they are no part of an article."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = []
        self.open: Counter[str] = Counter()
        self.hints: list[int] = []  # numbers of open elements that are no part of an article
        self.marks: list[tuple[int, int]] = []  # numbers of open elements that mark one, each with the strongest mark so far
        self.comments: list[int] = []
        self.quiet: list[int] = []  # inline elements that are no part of an article
        self.cleared: set[int] = set()  # elements of hints that hold a whole article, and so don't count
        self.number = 0
        self.link = -1  # length of the stack where a link was opened
        self.low = 0
        self.blocks: list[Block] = []
        self.now: Block | None = None

    def start(self, tag: str, said: str) -> None:
        if tag in VOID:
            if tag in BLOCKS:
                self.now = None
            elif tag == "br":
                self.add(" ")
            return
        own = attributes(said) if said else {}
        off, comments, marks = judged(tag, own, self.marks[-1][1] if self.marks else 0, bool(self.open["article"]))
        if tag == "a":
            self.link = len(self.stack) if "href" in own else -1
        inline = tag not in BLOCKS
        if inline and not off:
            return
        if not inline:
            self.now = None
            self.end_within("p", {"table", "td", "th", "li", "div", "article", "section", "main"})
            for other in _ENDS.get(tag, ()):
                self.end_within(other, {"ul", "ol", "dl", "table", "select"})
        if len(self.stack) >= DEPTH:
            return
        self.number += 1
        self.stack.append((self.number, tag))
        self.open[tag] += 1
        if comments:
            self.comments.append(self.number)
        if off:
            (self.quiet if inline else self.hints).append(self.number)
        elif marks and not self.comments:
            for h in reversed(self.hints):
                if h in self.cleared:
                    break
                self.cleared.add(h)
            self.marks.append((self.number, max(marks, self.marks[-1][1] if self.marks else 0)))

    def end_within(self, tag: str, walls: set[str]) -> None:
        """Close the innermost open element of that name, unless one of walls stands between."""
        if not self.open[tag]:
            return
        for _, name in reversed(self.stack):
            if name == tag:
                self.end(tag)
            if name == tag or name in walls:
                return

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = -1
        if tag in BLOCKS:
            self.now = None
        if not self.open[tag]:
            return
        name = ""
        while name != tag:
            number, name = self.stack.pop()
            self.open[name] -= 1
            for numbers in (self.hints, self.comments, self.quiet):
                if numbers and numbers[-1] == number:
                    numbers.pop()
            if self.marks and self.marks[-1][0] == number:
                self.marks.pop()
        self.low = min(self.low, len(self.stack))
        if self.link > len(self.stack):
            self.link = -1

    def add(self, text: str) -> None:
        if self.quiet or self.now is None and text.isspace():
            return
        if self.now is None:
            depth = len(self.stack)
            self.now = Block(depth, self.low, self.marks[-1][1] if self.marks else 0, self.hints[-1] if self.hints else 0, self.stack[-1][1] if self.stack else "")
            self.blocks.append(self.now)
            self.low = depth
        self.now.pieces.append(unescape(text) if "&" in text else text)
        if self.link >= 0:
            self.now.linked += len(text.strip())


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page; hint is 0 where the element holds the article."""
    cut, at, last = Cutter(), 0, html.rfind(">")
    while m := _MARK.search(html, at):
        if m.start() > at:
            cut.add(html[at : m.start()])
        at = m.start()
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = at + 5 if html.startswith(">", at + 4) else len(html) if end < 0 else end + 3
            continue
        if at > last:  # a tag without an end is dropped
            at = len(html)
            break
        tag = _TAG.match(html, at)
        if not tag:  # a declaration or an odd quote ends with the next mark
            at = html.find(">", at) + 1
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            cut.end(name)
        elif name in RAW:
            end_tag = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            at = end_tag.start() if end_tag else len(html)
        else:
            cut.start(name, tag[3])
    if at < len(html):
        cut.add(html[at:])
    for b in cut.blocks:
        if b.hint in cut.cleared:
            b.hint = 0
    return cut.blocks


def first_pass(blocks: list[Block]) -> list[Block]:
    """Blocks with text, labelled True (good), False (boilerplate) or None (ambiguous); mark stays where it is the page's strongest."""
    out: list[Block] = []
    low = DEPTH
    for b in blocks:
        b.text = _SPACE.sub(" ", "".join(b.pieces)).strip(" ")
        low = min(low, b.low)
        if b.text:
            b.low, low = low, DEPTH
            out.append(b)
    strongest = max((b.mark for b in out if not b.hint), default=0)
    words = [_WORD.findall(b.text.lower()) for b in out]
    density = [sum(w in STOP_WORDS for w in own) / max(1, len(own)) for own in words]
    listed = any(d >= LOW_DENSITY for d, own in zip(density, words, strict=True) if len(own) >= TELLING_WORDS)
    for b, d in zip(out, density, strict=True):
        long, links = len(b.text) >= GOOD_LENGTH, b.linked / len(b.text)
        outside = strongest and not b.mark
        b.mark = b.mark if b.mark == strongest else 0
        if b.hint or outside:
            b.label = False
        elif b.mark:
            b.label = True if long and d >= GOOD_DENSITY else None
        elif links > LINK_DENSITY or "\xa9" in b.text and not long:
            b.label = False
        elif long and (d >= GOOD_DENSITY or not listed):
            b.label = True
        elif long and d < LOW_DENSITY:
            b.label = False
    return out


def second_pass(blocks: list[Block]) -> list[Block]:
    """The good blocks: ambiguous ones get the label of their nearest decided neighbour, or are good in a marked article."""
    if not any(b.label for b in blocks):
        return [b for b in blocks if b.label is None]
    n = len(blocks)
    # for each block and side: the elements shared with the nearest decided neighbour, how far it is, and its label
    sides: list[list[tuple[int, int, bool | None]]] = []
    for order in (range(n), range(n - 1, -1, -1)):
        side: list[tuple[int, int, bool | None]] = [(0, 0, None)] * n
        common, away, label = 0, 0, None
        for i in order:
            step = i if order.step > 0 else i + 1  # the later one of this block and the one before in this direction
            common, away = min(common, blocks[step].low) if 0 < step < n else 0, away + 1
            side[i] = (common, away, label)
            if blocks[i].label is not None:
                common, away, label = blocks[i].depth, 0, blocks[i].label
        sides.append(side)
    out = []
    for i, b in enumerate(blocks):
        label = b.label
        if label is None and b.mark:
            label = True
        elif label is None:
            near = [(-common, ahead != (b.tag in HEADINGS), away, own) for ahead, side in enumerate(sides) if (own := side[i][2]) is not None for common, away in (side[i][:2],)]
            label = min(near)[3]
        if label:
            out.append(b)
    return out


def main_text(html: str | None) -> str:
    return "\n\n".join(b.text for b in second_pass(first_pass(blocks_of(html or ""))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
