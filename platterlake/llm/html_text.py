"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks, each with the tag path of its text from the root.
For each path the text lengths, the punctuation and the number of blocks are
aggregated; characters and punctuation marks per block are the two ratios of a
path. Along the page, each ratio is smoothed over neighbouring blocks and the two
are fused into one score. Paths whose fused score reaches a share of the page's
spread are content, and so are headings, lists and quotes that stand among them.

The ratios run on every page. What a page says about itself is evidence in their
score: where article or main elements hold a share of the prose, their blocks gain
and all others lose in that proportion, and blocks in an element whose class, id or
role names it as no article lose most of theirs. Elements that are never main text
(navigation, forms, scripts, asides, hidden ones) are no blocks at all, unless they
hold most of the page's prose or its main article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = set("aside audio button canvas datalist dialog embed fieldset footer form head iframe input label map menu nav noscript object option script select style svg template textarea title video".split())
#: A start tag of the first closes an open element of the second, up to a boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BOUNDARY = {"ul", "ol", "dl", "table", "select", "menu", "body", "article", "section", "div"}
#: Elements that a start tag of NO_P does not look beyond for a paragraph to close.
KEEPS_P = BOUNDARY | {"td", "th", "button"}
NO_P = BLOCK - {"body", "caption", "dd", "dt", "html", "li", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"li", "dd", "dt"}
# Words in a class, an id or a role that mark what is not the article.
MARKS = set("ad ads adv advert advertisement advertising adverts alert announcement banner breadcrumb breadcrumbs byline-share comment comments commentlist consent contentinfo cookie cookies disclaimer discussion disqus dialog feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup privacy promo promoted promotion recommended related replies reply respond rss search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription tags teaser toolbar topbar warning widget complementary".split())
# What may stand beside such words in a name; any other part, as in has-sidebar or comments-open, makes it another name.
PARTS = set("area bar block body box button buttons container content count group inner item items label link links list message outer panel placeholder post posts section site slot slots text thread title top unit wrap wrapper zone".split())
# Whose or which box it is, beside such a word; the name means the same. Of a header they say too little.
QUALIFIERS = set("article articles author bottom card cards center col column desktop entry extra first floating global inline last left local main mid middle mini mobile more my page pages primary rail reader readers related right secondary section side site sticky stories story sub tertiary the top user users visitor visitors".split())
# Whole names of what is beside the article without one of the words above.
WHOLE = set("author-bio author-box author-card author-info bio-box copyright copyright-notice left-column left-rail legal legal-notice legal-text more-articles more-news more-posts more-stories read-more read-next responses response-list right-column right-rail side-bar side-column side-rail up-next you-may-like".split())
#: Elements of NEVER that show no text of their own, whatever they hold.
CODE = NEVER - {"aside", "dialog", "fieldset", "footer", "form", "label", "menu", "nav", "noscript"}
#: Elements of NEVER that pages are wrapped in; beside an article, the others stay out even if they are longer.
WRAPPERS = {"fieldset", "form", "noscript"}
#: Elements that end a head whose end tag is left out are all but these.
IN_HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template", "head", "html"}
#: Share of the page's text beyond which an element is the page and not something beside it.
MOST = 0.5
#: Of these, the ones that do not count for a heading element inside the article.
HEADING = re.compile(r"h[1-6]$")

# In a tag a quote opens a value right after "=" only; anywhere else it is a character like others.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/<>]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)|[^<>])*+>?|<|[^<]+", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")
_BESIDE = re.compile(r"(?:h[1-6]|p|li|blockquote|pre|td|th|dd|dt|figcaption)(?:\.|$)")
#: Paragraphs of a content path that stay for their own words, however much of them is a link.
_LINKED = re.compile(r"(?:p|blockquote|td|dd|figcaption)(?:\.|$)")
#: Boxes of their own within a content area that hold a sentence, as a pulled quote does.
_BOX = re.compile(r"(?:div|section|figure|center)(?:\.|$)")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
#: Weights of a block's neighbours when ratios are smoothed.
SMOOTH = (0.25, 0.5, 0.25)
#: Share of the standard deviation of the fused scores that content must reach.
THRESHOLD = 0.8
#: What is left of the score of a block whose surroundings name it as no article.
MARKED = 0.1


class Suspect:
    """An element that names itself as no article, the next such element around it, and what it turns out to hold."""

    __slots__ = ("above", "chars", "chief", "code", "cuts", "marked", "never", "prose", "wraps")

    def __init__(self, name: str, cuts: bool, above: Suspect | None):
        self.above, self.cuts, self.wraps = above, cuts, not cuts or name in WRAPPERS
        self.code = name in CODE or above is not None and above.code
        self.chars, self.prose, self.chief, self.never, self.marked = 0, False, False, False, False

    def judge(self, any_chief: bool, total: int) -> None:
        """Whether it, or one around it, is beside the article after all texts of the page are known."""
        most = self.prose and self.chars > MOST * total and (self.wraps or not any_chief)
        stands = self.code or not most and not self.chief
        self.marked = stands or self.above is not None and self.above.marked
        self.never = stands and self.cuts or self.above is not None and self.above.never


class Path:
    """A tag path, as its last step and the path above it."""

    __slots__ = ("above", "below", "in_article", "step")

    def __init__(self, step: str, above: Path | None):
        self.step, self.above, self.below = step, above, {}
        self.in_article = step.split(".")[0] == "article" or above is not None and above.in_article

    def child(self, step: str) -> Path:
        """The one path that goes on with ``step``."""
        found = self.below.get(step)
        if found is None:
            found = self.below[step] = Path(step, self)
        return found


class Element:
    """An open element, and what stands around it."""

    __slots__ = ("article", "blocks", "main", "name", "path", "suspect")

    def __init__(self, name: str, path: Path, suspect: Suspect | None, main: int, article: int, blocks: int):
        self.name, self.path, self.suspect, self.main, self.article, self.blocks = name, path, suspect, main, article, blocks


class Block:
    __slots__ = ("article", "linked", "main", "marked", "never", "path", "suspect", "text")

    def __init__(self, where: Element, text: str, linked: int):
        self.path, self.suspect, self.main, self.article = where.path, where.suspect, where.main, where.article
        self.text, self.linked = text, linked
        self.never = self.marked = False

    @property
    def in_article(self) -> bool:
        return self.path.in_article


def attributes(tag: str) -> dict[str, str]:
    """A start tag's attributes; of equal names the first counts."""
    out: dict[str, str] = {}
    at = _NAME.match(tag).end()
    while m := _ATTRIBUTE.match(tag, at):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()
    return out


def names_no_article(name: str, inside: bool = False) -> bool:
    """Whether a whole class, id or role is such a word, or such words with parts that only describe a box or whose it is.

    Inside an article a header is the article's own.
    """
    parts = [name] if name in MARKS else [p for p in re.split(r"[-_:]+", name) if p and not p.isdecimal()]
    marks = {p for p in parts if p in MARKS}
    if "-".join(parts) in WHOLE:
        return True
    if marks <= {"header"}:
        return bool(marks) and not inside and all(p in marks or p in PARTS for p in parts)
    return all(p in marks or p in PARTS or p in QUALIFIERS for p in parts)


def _hidden(own: dict[str, str]) -> bool:
    return "hidden" in own and own["hidden"].lower() != "until-found" or own.get("aria-hidden", "").strip().lower() == "true"


def _marked(own: dict[str, str], inside: bool) -> tuple[str, bool]:
    """A step's label (its first class, id or role as written) and whether it names itself as no article."""
    label, bad = "", False
    for key, value in own.items():
        if key in ("class", "id", "role"):
            names = value.lower().split()
            label = label or (names[0] if names else "")
            bad = bad or any(names_no_article(n, inside) for n in names)
    return label, bad


def _settle(found: list[Block], suspects: list[Suspect], articles: list[tuple[int, Suspect | None]]) -> None:
    """Take back the suspicion of what holds most of the page's prose, or its main article.

    ``suspects`` are in page order, so what is within comes after what is around;
    ``articles`` are the number of the article around each, and the suspect around it.
    """
    held = [0] * len(articles)  # characters outside links, by article
    total = 0
    for b in found:
        s = b.suspect
        if s is not None and s.code:
            continue
        n = max(0, len(b.text) - b.linked)
        total += n
        held[b.article] += n
        if s is not None:
            s.chars += n
            s.prose = s.prose or n > 0 and bool(_PUNCT.search(b.text))
    for s in reversed(suspects):
        if s.above is not None:
            s.above.chars += s.chars
            s.above.prose = s.above.prose or s.prose
    for k in range(len(articles) - 1, 0, -1):
        held[articles[k][0]] += held[k] if articles[k][0] else 0
    chief = max(range(1, len(articles)), key=held.__getitem__) if any(held[1:]) else 0
    s = articles[chief][1]
    while s is not None:
        s.chief, s = True, s.above
    for s in suspects:
        s.judge(chief > 0, total)
    for b in found:
        if b.suspect is not None:
            b.never, b.marked = b.suspect.never, b.suspect.marked


def blocks(page: str | None) -> list[Block]:
    """Blocks of text in page order, with their tag paths; one pass over the page, whatever its depth."""
    out: list[Block] = []
    root = Element("", Path("", None), None, 0, 0, 0)
    stack = [root]
    places: dict[str, list[int]] = {}  # of the open elements of a name, in the stack
    suspects: list[Suspect] = []
    articles: list[tuple[int, Suspect | None]] = [(0, None)]
    text: list[str] = []
    linked = 0
    where = root

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            out.append(Block(where, whole, linked))
        text.clear()
        linked = 0

    def last(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(k: int) -> None:
        for e in stack[k:]:
            places[e.name].pop()
        del stack[k:]

    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        t, at = m[0], m.end()
        if t[0] != "<" or t == "<" or t.startswith("<![CDATA["):
            piece = html.unescape(t)
            if text and where.suspect is not stack[-1].suspect:
                flush()
            if not text:
                where = stack[-1]
            text.append(piece)
            if places.get("a"):
                linked += len(piece.strip())
            continue
        if not (n := _NAME.match(t)):
            continue
        name = n[1].lower()
        if t[1] == "/":
            if k := last({name}):
                within = stack[-1].blocks - stack[k].blocks > 0
                if name in BLOCK or within:
                    flush()
                # an inline end tag does not close blocks around the text
                if name in BLOCK or not within:
                    close(k)
            continue
        if name not in IN_HEAD and stack[-1].name == "head":
            close(len(stack) - 1)
        if name in BLOCK:
            flush()
            if name in NO_P and (k := last({"p"})) > last(KEEPS_P):
                close(k)
            while name in CLOSES and (k := last(CLOSES[name])) > last(BOUNDARY):
                close(k)
                if name in ("li", "option"):
                    break
        if name == "br":
            text.append(" ")
        if name in VOID or t.endswith("/>") and (name not in BLOCK | RAW | {"a", "b", "i", "span"} or name in RAW and last({"svg", "math"})):
            continue
        own = attributes(t) if "=" in t or "hidden" in t.lower() else {}
        above = stack[-1]
        label, bad = _marked(own, above.main > 0)
        role = own.get("role", "").lower().split()[:1]
        main = above.main + (name in ("article", "main") or role in (["main"], ["article"]))
        whole = name in ("html", "body", "main")
        cuts = name in NEVER or name == "header" and not above.main or _hidden(own) and not whole
        # What stands within a line of text is part of it, whatever its class.
        bad = cuts or bad and name in BLOCK and not (whole or HEADING.match(name))
        article, suspect, path = above.article, above.suspect, above.path
        if main > above.main:
            articles.append((article, suspect))
            article = len(articles) - 1
        if bad:
            suspect = Suspect(name, cuts, suspect)
            suspects.append(suspect)
        if name in BLOCK:
            path = path.child(f"{name}.{label}" if label else name)
        places.setdefault(name, []).append(len(stack))
        stack.append(Element(name, path, suspect, main, article, above.blocks + (name in BLOCK)))
        if name in RAW:
            if text and name not in BLOCK:
                text.append(" ")
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
    flush()
    _settle(out, suspects, articles)
    return out


def ratios(found: list[Block]) -> list[float]:
    """Fused, smoothed score of each block from its path's aggregates."""
    sums: dict[Path, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        n = max(0, len(b.text) - 2 * b.linked)  # linked text counts against a path
        for k, v in enumerate((n, len(_PUNCT.findall(b.text)), 1, n * n)):
            s[k] += v
    text = [sums[b.path][0] / sums[b.path][2] for b in found]
    marks = [sums[b.path][1] / sums[b.path][2] for b in found]

    def smooth(xs: list[float]) -> list[float]:
        half = len(SMOOTH) // 2
        return [sum(w * xs[min(max(i + k - half, 0), len(xs) - 1)] for k, w in enumerate(SMOOTH)) for i in range(len(xs))]

    return [math.sqrt(a * (b + 0.1)) for a, b in zip(smooth(text), smooth(marks), strict=True)]


def fused(found: list[Block]) -> list[float]:
    """Score of each block: its ratios, weighed by what the page says about its surroundings."""
    plain = [b for b in found if not b.marked]
    prose = lambda bs: sum(max(0, len(b.text) - b.linked) for b in bs)
    in_main, in_article = [b for b in plain if b.main], [b for b in plain if b.in_article]
    # What else the main element holds is beside the article.
    by_article = 2 * prose(in_article) >= prose(in_main)
    share = prose(in_article if by_article else in_main) / max(1, prose(plain))
    out = []
    for b, s in zip(found, ratios(found), strict=True):
        inside = b.in_article if by_article else b.main
        out.append(s * (1 + share if inside else 1 - share) * (MARKED if b.marked else 1.0))
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines; empty for a page without any."""
    found = [b for b in blocks(page) if not b.never]
    if not found:
        return ""
    scores = fused(found)
    mean = sum(scores) / len(scores)
    floor = THRESHOLD * math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    # A path inside the article and the same path outside are judged each by itself.
    keys = [(b.path, b.main > 0, b.marked) for b in found]
    best: dict[tuple, float] = {}
    for k, s in zip(keys, scores, strict=True):
        best[k] = max(best.get(k, 0.0), s)
    content = {k for k, s in best.items() if s >= floor and s > 0}
    areas = {(path.above, main) for path, main, marked in content if not marked}
    boxed = {(path, main) for path, main in areas if path is not None and path.step not in ("", "html", "body")}
    within: dict[tuple[Path | None, bool], tuple[bool, bool]] = {(None, False): (False, False), (None, True): (False, False)}

    def around(path: Path, main: bool) -> tuple[bool, bool]:
        """Whether a path is in an area of content, and in one below the page's body."""
        missing = []
        while (path, main) not in within:
            missing.append(path)
            path = path.above
        found = within[path, main]
        for p in reversed(missing):
            found = within[p, main] = (found[0] or (p, main) in areas, found[1] or (p, main) in boxed)
        return found

    kept = []
    for b, k in zip(found, keys, strict=True):
        step, (near, inner) = b.path.step, around(b.path, k[1])
        beside = not b.marked and near and (_BESIDE.match(step) or inner and _BOX.match(step) and _SENTENCE.search(b.text))
        words = not b.marked and near and b.linked < len(b.text) and _LINKED.match(step) and _SENTENCE.search(b.text)
        if (k in content or beside) and (2 * b.linked <= len(b.text) or words):
            kept.append(b.text)
    return "\n\n".join(kept)


@F.arrow_udf(T.StringType())
def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(row, text) of every page: the row as it was, and its main text.

    A null or empty page, or one without an article, gives an empty text. Each
    page is judged by itself, so nothing is shuffled and repeated rows agree.
    """
    packed = pages.select(F.struct("*").alias("row"))
    return packed.select("row", _extract(packed["row"].getField(html_col)).alias("text"))
