"""Main text of web pages: text-to-tag ratio per line, smoothed and clustered (Weninger, Hsu and Han 2010), over streamed parser events."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a line (fixed values).
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Tags whose text is never the article's (fixed values).
NEVER = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe input label map menu nav noscript object option script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that hold an article as a whole.
HOLDS = frozenset(("article", "main"))
#: Words in class, id or role that name menus, headers, sidebars, notices, adverts, forms and comments (fixed values).
CHROME = frozenset("ad ads adsbygoogle adsense adslot adv advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentform commentlist complementary consent contentinfo cookie cookies dialog disqus doubleclick footer gdpr masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination popup promo promoted recommended related replies reply replylist search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split())
#: Words that stand beside these in a name without a meaning of their own (fixed values).
BESIDE = frozenset("above area article articles bar block body bottom box button buttons card cards center col column container content count desktop down drop dropdown email entry extra feed fixed floating footer form global google grid header horizontal icon icons info inner item items large layout leaderboard left level links list lists local mail mailing main media mega message messages meta mobile module network news outer overlay page panel placeholder policy post posts primary reader readers rectangle region right row secondary section site skyscraper slot small sticky stories story sub submenu text thread title toggle tool tools top unit user utility vertical visitor wide widget widgets wrap wrapper".split())
#: Of CHROME, what tells that an article of its own is a reader's.
COMMENT = frozenset("comment comments commentlist disqus replies reply replylist".split())
SITE_HEADER = frozenset("header pageheader siteheader topbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: next to content in the same element they are content too.
PROSE = HEADINGS | frozenset("blockquote dl ol p pre table ul".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA = 1.0


def parts_of(name: str) -> list[str]:
    """site-footer, siteFooter or site_footer as site, footer."""
    return [x.lower() for x in NAME.findall(name)]


def names_chrome(value: str, words: frozenset[str] = CHROME) -> bool:
    """If a whole name in a class, id or role is of `words`, alone or beside words that add nothing: cookie-notice is, notice-period is not."""
    return any(parts and not words.isdisjoint(parts) and all(x in CHROME or x in BESIDE for x in parts) for parts in map(parts_of, value.split()))


def names_header(value: str) -> bool:
    return any("".join(parts) in SITE_HEADER for parts in map(parts_of, value.split()))


class Box:
    """An open element; `hides`: its text is not the article's; `held`: the article or main it lies in; `link`: it is or lies in a link;
    `block`: the innermost element that ends lines, itself or around it; `home`: the one around that (a paragraph left open holds no other)."""

    __slots__ = ("tag", "hides", "held", "ended", "link", "block", "home")

    def __init__(self, tag: str, hides: "Box | None", held: "Box | None", parent: "Box | None"):
        self.tag, self.hides, self.held, self.ended = tag, hides, held, False
        self.link = tag == "a" or parent is not None and parent.link
        outer = parent and parent.block
        self.block = self if tag in BLOCK else outer
        self.home = outer.home if outer and (tag not in BLOCK or tag == outer.tag == "p") else outer


class Lines(HTMLParser):
    """Collects (pieces of text with the element each stands in, tags) for each line, event by event."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Box] = []
        self.lines: list[tuple[list[tuple[str, Box | None]], int]] = []
        self.text: list[tuple[str, Box | None]] = []
        self.tags = 0

    def end_line(self) -> None:
        if any(not t.isspace() for t, _ in self.text):
            self.lines.append((self.text, self.tags))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        top = self.open[-1] if self.open else None
        box = Box(tag, top and top.hides, top and top.held, top)
        if tag in HOLDS and not box.held:
            box.held = box
        hides = tag in NEVER or tag == "header" and not box.held or tag == "article" and box.held is not box and box.held.tag == "article"
        for k, v in attrs:
            if k in ("class", "id", "role") and v and tag in HOLDS:  # their names tell the layout, or a reader's comment
                hides = hides or tag == "article" and names_chrome(v, COMMENT)
            elif k in ("class", "id", "role") and v and tag not in ("html", "body"):
                hides = hides or names_chrome(v) or not box.held and names_header(v)
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                hides = True
        if hides and not box.hides:
            box.hides = box
        self.open.append(box)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self.open[k].ended = True
                del self.open[k:]
                return
            if self.open[k].tag in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html"):
                return  # a stray end inside a container closes nothing outside it

    def handle_data(self, data):
        self.text.append((data, self.open[-1] if self.open else None))

    def close(self):
        super().close()
        self.end_line()


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over 3 sigma on both sides; weights are renewed at the ends."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(ratio, k, "full")[r : r + len(ratio)] / np.convolve(np.ones(len(ratio)), k, "full")[r : r + len(ratio)]


def threshold(x: np.ndarray) -> float:
    """The border of two clusters of the values (1-d 2-means from the ends); at most the standard deviation, as the paper has it."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(50):
        mid = (lo + hi) / 2
        low, high = x[x <= mid], x[x > mid]
        new = (float(low.mean()) if len(low) else lo, float(high.mean()) if len(high) else hi)
        if new == (lo, hi):
            break
        lo, hi = new
    return min((lo + hi) / 2, float(x.std())) if len(x) > 1 else 0.0


def shows(box: Box | None) -> bool:
    """If text of an open element can be the article's, known once the page is read: an element that hides and is never closed hides no article that opens in it."""
    if box is None or box.hides is None:
        return True
    return box.held is not None and not box.hides.ended and box.hides is not box.held and not box.hides.held


def free_lines(lines: list[tuple[list[tuple[str, Box | None]], int]]) -> list[tuple[str, int, Box | None, Box | None, bool]]:
    """(text, tags, holding element, innermost element, only links?) of the lines that have text in elements that do not hide. Other text in a line goes, piece by piece."""
    out = []
    for pieces, tags in lines:
        own = [(t, b) for t, b in pieces if shows(b)]
        if text := " ".join("".join(t for t, _ in own).split()):
            said = [b for t, b in own if not t.isspace()]
            out.append((text, tags, said[0] and said[0].held, said[0], all(b is not None and b.link for b in said)))
    return out


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article's text; '' if there is none.

    Text in chrome (menus, page headers, footers, sidebars, notices, adverts, forms,
    scripts, comments) is never content, also within a line. Of the rest, lines whose smoothed ratio passes the threshold
    are content. If they lie in an article or main, that container is the region, whole (and
    others with a quarter of its content); else the region runs from the first to the last
    content line, with the paragraphs of the same element next to it and the headings just before it.
    """
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    free = free_lines(p.lines)
    if not free:
        return ""
    ratio = np.array([len(t) / max(1, n) for t, n, *_ in free], float)
    soft = smoothed(ratio, sigma)
    content = soft >= threshold(soft)
    mass: dict[int, float] = {}
    for (t, _, held, *_), c in zip(free, content, strict=True):
        if held is not None:
            mass[id(held)] = mass.get(id(held), 0.0) + (len(t) if c else 0)
    outside = sum(len(t) for (t, _, held, *_), c in zip(free, content, strict=True) if c and held is None)
    if mass and max(mass.values()) >= 0.25 * outside:
        least = 0.25 * max(mass.values())
        return " ".join(t for t, _, held, *_ in free if held is not None and mass[id(held)] >= least)
    at = np.flatnonzero(content)
    if not len(at):
        return ""
    first, last = region([(x[3], x[4]) for x in free], int(at[0]), int(at[-1]))
    return " ".join(t for t, *_ in free[first : last + 1])


def region(lines: list[tuple[Box | None, bool]], first: int, last: int) -> tuple[int, int]:
    """First and last line of the region, from those of its content: on by running text of the same element that is more than links, and back by headings."""
    blocks = [b and b.block for b, _ in lines]

    def grown(edge: int, step: int) -> int:
        """The last line, from `edge` by `step`, of running text in the element around the edge's block."""
        here, top, k = blocks[edge], {}, edge
        while here is not None and 0 <= k + step < len(lines) and not lines[k + step][1]:
            b, path = blocks[k + step], []
            while b is not None and b not in top and b.home is not here.home:  # the block of that element the line lies in
                path.append(b)
                b = b.home
            b = top.get(b, b)
            top.update(dict.fromkeys(path, b))
            if b is None or b.tag not in PROSE and b is not here:
                break
            k += step
        return k

    tail = last
    first, last = grown(first, -1), grown(last, 1)
    while last > tail and blocks[last].tag in HEADINGS:  # a heading of what is left out
        last -= 1
    while first and blocks[first - 1] is not None and blocks[first - 1].tag in HEADINGS:
        first -= 1
    return first, last


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text ('' if none), n_chars (code points).

    A null or empty html, and one without text, give ''. The whole page is parsed, however long;
    broken mark-up is read as the standard parser reads it. Null ids and urls stay null,
    repeated rows each give a row, an empty table gives none. Map only: no exchange.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def run(it):
        for batch in it:
            got = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
