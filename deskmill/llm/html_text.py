"""Main text of web pages: the contiguous region with the largest score.

A page is read once as a row of tags and words. Words score by the element they stand in, tags by their name, as log-odds of
lying inside the article; the odds come from pages that mark their article themselves (labelled pages), counted over a bounded
sample. One linear scan finds the row with the largest sum. Inside it, blocks of menus, adverts, forms, comments and the
like are left out, and what remains is decoded and joined. A block that its class, id or a form makes one of these is kept after all
where it proves to be a wrapper, that is, where it holds the page's article or most of its words. Pages are worked on where they lie.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.names import free_name
from deskmill.llm.sampling import bounded_sample

SAMPLE = 500  # labelled pages that the weights are learned from

# Names of HTML elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav aside footer form script style noscript template iframe object embed svg canvas button select "
                    "option textarea input dialog menu head title audio video map".split())
ARTICLE = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
# Words in class and id names of blocks that are not the article
NOISE = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner comment comments reply replies "
                  "respond disqus sidebar side menu nav navbar navigation navigator breadcrumb breadcrumbs footer masthead topbar cookie "
                  "cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social "
                  "related recommended widget toolbar pagination pager skip search feedback disclaimer copyright "
                  "complementary contentinfo gdpr commentlist commentform adsbygoogle adbox adslot adunit adbanner advertising "
                  "topnav subnav mainmenu menubar sitefooter pagefooter cookiebar".split())
# Words that may stand beside these in a name; a name with any other word, like has-sidebar or related-work, says something else
NEUTRAL = frozenset("site main page top bottom left right list block wrap wrapper container area section bar box button buttons link links post "
                    "posts article articles story stories content inner outer form primary secondary global header item items icon icons "
                    "entry entries recent slot unit panel group row col column title text body google js the tools this media "
                    "thread to count js desktop mobile sticky fixed floating inline".split())
WEAK = frozenset("alert notice notices side".split())  # these say something only alone or beside another of NOISE
# Words of blocks that are no wrappers however long they are
STANDING = frozenset("comment comments reply replies respond disqus commentlist commentform cookie cookies consent gdpr cookiebar".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HEAD_PARTS = frozenset("base basefont bgsound link meta title script noscript style template noframes head html".split())
# Whole class and id names of a page's head, where they stand outside the article
PAGE_HEADS = frozenset("header site-header page-header top-header main-header global-header siteheader pageheader".split())

# A tag with its attributes, quotes taken in pairs; without going back, so that a try costs what it reads
TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>")
# The same for the rest of a page whose quotes don't come in pairs
PLAIN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>")
BEGINS = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD_DEFAULT, TAG_DEFAULT, LIMIT = 1.0, -0.5, 5.0


@dataclass
class Piece:
    """Text between two tags, or a tag (text None); ``feature`` names what its weight depends on."""
    feature: str
    words: int
    text: str | None
    noise: bool
    breaks: bool
    inside: bool


SOFT, HARD = 1, 2


def _veto(name: str, attributes: str, in_article: bool) -> int:
    """Whether a block is not the article: 0, SOFT if it may still prove to be a wrapper, or HARD."""
    if name in DROPPED or (name == "header" and not in_article):
        return SOFT if name == "form" else HARD
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    given = {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes))}  # the first of a name counts
    if "hidden" in given or NO_DISPLAY.search(given.get("style", "")):
        return HARD
    if name in HEADINGS:
        return 0
    found = 0
    for value in (given.get("class", ""), given.get("id", ""), given.get("role", "")):
        for word in value.split():
            parts = {p.lower() for p in PARTS.findall(word)}
            noise = parts & NOISE
            if noise and parts <= NOISE | NEUTRAL and (noise - WEAK or len(parts) == 1):
                found = max(found, HARD if noise & STANDING else SOFT)
            elif not in_article and word.lower() in PAGE_HEADS:
                found = max(found, SOFT)
    return found


@dataclass
class Block:
    """A block that may have to go, and what it holds outside of blocks inside it; the first is the page itself."""
    up: int
    hard: bool
    inside: bool
    words: int = 0  # outside of links
    articles: int = 0
    mains: int = 0


def _gone(blocks: list[Block]) -> list[bool]:
    """For every block whether it goes. A soft one stays that holds <main>, the page's articles or most of its words."""
    own = [(b.words, b.articles) for b in blocks]
    goes = [False] * len(blocks)
    above: list[tuple[int, int]] = [(0, 0)]  # words and articles of the blocks around
    for b in blocks[1:]:
        above.append((above[b.up][0] + own[b.up][0], above[b.up][1] + own[b.up][1]))
    for i in range(len(blocks) - 1, 0, -1):
        b, (words, articles) = blocks[i], above[i]
        holds = not b.inside and (b.mains or (b.articles and not articles and 2 * b.words >= words))
        goes[i] = b.hard or not (holds or b.words > 2 * words)
        if not goes[i]:
            up = blocks[b.up]
            up.words, up.articles, up.mains = up.words + b.words, up.articles + b.articles, up.mains + b.mains
    for i in range(1, len(blocks)):
        goes[i] |= goes[blocks[i].up]
    return goes


def tags(page: str):
    """Finds the next tag, comment or declaration from a place on; linear in the page however broken it is.

    A ``<`` that begins a tag whose quotes are not closed before the page ends makes the rest be read without regard to quotes.
    """
    paired, last = True, page.rfind(">")

    def find(at: int):
        nonlocal paired
        while 0 <= (at := page.find("<", at)) <= last:
            match = (TOKEN if paired else PLAIN).match(page, at)
            if match is None and paired and BEGINS.match(page, at):
                paired = False
                match = PLAIN.match(page, at)
            if match:
                return match
            at += 1
        comment = page.find("<!--", at) if at >= 0 else -1
        return PLAIN.match(page, comment) if comment >= 0 else None

    return find


def read_page(page: str | None) -> list[Piece]:
    """Tags and texts in page order; a linear pass that stands unclosed and crossed elements."""
    page, out, at = page or "", [], 0
    # element, number of its block, inside an article, place of the nearest element that is not inline
    stack: list[tuple[str, int, bool, int]] = []
    bottom = ("", 0, False, -1)
    count: dict[str, int] = defaultdict(int)  # open elements of a name

    def drop(depth: int):
        for entry in stack[depth:]:
            count[entry[0]] -= 1
        del stack[depth:]

    blocks, of = [Block(0, False, False)], []

    def text(end: int):
        if end > at:
            part = html.unescape(page[at:end])
            if stack and stack[-1][0] == "head" and part.strip():
                drop(len(stack) - 1)
            _, block, inside, above = stack[-1] if stack else bottom
            up = stack[above][0] if above >= 0 else ""
            linked = "/a" if any(s[0] == "a" for s in stack[-4:]) else ""
            feature = "w:" + up + linked
            out.append(Piece(feature, len(part.split()), part, False, False, inside))
            of.append(block)
            if not linked:
                blocks[block].words += out[-1].words

    find = tags(page)
    match = find(0)
    while match:
        text(match.start())
        at = match.end()
        if match[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif match[2]:
            name = match[2].lower()
            if match[1]:
                closed = bottom
                if count[name]:
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    closed = stack[depth]
                    drop(depth)
            else:
                if count["head"] and (name == "body" or (stack[-1][0] == "head" and name not in HEAD_PARTS)):
                    # the head ends where the body begins, whether it was closed or not
                    drop(next(n for n, s in enumerate(stack) if s[0] == "head"))
                if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    own = "p" if name in CLOSES_P else name
                    depth = stack[-1][3] if stack else -1
                    while depth >= 0 and stack[depth][0] in (own, "p"):
                        if stack[depth][0] == own:
                            drop(depth)
                            break
                        depth = stack[depth - 1][3] if depth else -1
                _, block, inside, above = stack[-1] if stack else bottom
                veto = 0 if blocks[block].hard else _veto(name, match[3], inside)
                if veto:
                    blocks.append(Block(block, veto == HARD, inside))
                    block = len(blocks) - 1
                blocks[block].articles += name in ARTICLE
                blocks[block].mains += name == "main"
                if name not in VOID and not match[3].endswith("/"):
                    stack.append((name, block, inside or name in ARTICLE, above if name in INLINE else len(stack)))
                    count[name] += 1
            _, block, inside, _ = closed if match[1] and closed[0] else stack[-1] if stack else bottom
            out.append(Piece(f"<{match[1]}{name}", 0, None, False, name not in INLINE, inside and name not in ARTICLE))
            of.append(block)
            if name == "br":
                out.append(Piece("w:", 0, " ", False, False, inside))
                of.append(block)
            if name in RAW and not match[1] and not match[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                at = end.start() if end else len(page)
        match = find(at)
    text(len(page))
    if len(blocks) > 1:
        goes = _gone(blocks)
        for p, block in zip(out, of):
            p.noise = goes[block]
    return out


def count_features(pages) -> dict[str, list[int]]:
    """[inside, outside] per feature, over pages that mark their article."""
    found: dict[str, list[int]] = {}
    for page in pages:
        pieces = read_page(page)
        if not any(p.inside for p in pieces):
            continue
        for p in pieces:
            if not p.noise and p.feature[1:].lstrip("/") not in ARTICLE:
                found.setdefault(p.feature, [0, 0])[not p.inside] += p.words if p.text is not None else 1
    return found


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    return {f: max(-LIMIT, min(LIMIT, math.log((a + 0.5) / (b + 0.5)))) for f, (a, b) in counts.items() if a + b}


def best_region(pieces: list[Piece], weights: dict[str, float]) -> tuple[int, int]:
    """(from, to) of the pieces with the largest sum, the earliest and shortest of equals; empty if none is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, p in enumerate(pieces):
        if p.noise:
            score = TAG_DEFAULT  # text and tags of a block that is left out anyway: a small price for bridging it
        elif p.text is None:
            score = weights.get(p.feature, 0.0 if p.feature.lstrip("</") in ARTICLE else TAG_DEFAULT)
        else:
            score = p.words * weights.get(p.feature, WORD_DEFAULT)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, white space made single blanks, joined by an empty line."""
    pieces = read_page(page)
    start, end = best_region(pieces, weights)
    blocks: list[list[str]] = [[]]
    for p in pieces[start:end]:
        if p.breaks or (p.noise and p.text is not None and p.words):
            blocks.append([])
        if p.text is not None and not p.noise:
            blocks[-1].append(p.text)
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def learn_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Log-odds by feature from at most ``sample`` pages that mark their article, picked by hash."""
    marked = pages.where(F.lower(html_col).rlike("<(article|main)[\\s>]"))
    drawn = bounded_sample(marked, id_col, sample).select(html_col)

    def count(batches):
        for batch in batches:
            rows = list(count_features(batch.column(0).to_pylist()).items())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1][0] for r in rows], pa.int64()),
                                              pa.array([r[1][1] for r in rows], pa.int64())], ["f", "a", "b"])

    # features are element names, as many as a bounded sample holds
    counts = drawn.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return weights_of({r["f"]: (r["a"], r["b"]) for r in counts.collect()})


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """Adds ``text``, the main text of every page, and ``n_chars``, its code points.

    Null and empty pages, and pages without a region that scores above zero, have an empty text. Without labelled pages fixed
    weights are used. Repeated rows are read each; an empty table stays empty. Other columns are kept, ones named like an
    added column are replaced.
    """
    weights = learn_weights(pages.select(F.col(id_col), F.col(html_col).cast("string").alias(html_col)), id_col, html_col, sample)
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    work_col = free_name("_html", pages.columns)
    frame = pages.select(*kept, F.col(html_col).cast("string").alias(work_col))

    def run(batches):
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(work_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return frame.mapInArrow(run, schema)
