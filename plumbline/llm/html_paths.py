"""Main text of web pages by tag-path ratios.

A page is read once into text runs, each with its root-to-leaf tag path. For
every path the text length and the punctuation are aggregated and divided by
the number of runs; both ratios are smoothed over the paths in the order of
their first appearance, fused into one score and cut at a threshold that
follows their spread. Paths above it are content. The smallest element that
holds most of the content text is the article, and its other blocks (such as
headings, whose own ratio is low) belong to it as well, without what the
markup itself declares to be something else.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import picked, text_batches
from plumbline.session import ship_package

# Elements by their role in HTML.
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
ASIDE = frozenset("nav header footer aside form menu button select option dialog fieldset head".split())
#: Of RAW, those that a slash at the end of their start tag closes (the others are raw text up to their end tag).
EMPTY_IF_CLOSED = frozenset("svg math object canvas".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split()
)
# Words of class and id that declare something besides the article.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion sidebar side widget widgets related "
    "recommended menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar cookie cookies consent gdpr notice notices "
    "notification notifications popup modal overlay alert share sharing social subscribe newsletter signup login search toolbar skip copyright legal "
    "complementary contentinfo dialog".split()
)
_COMMENTS = frozenset("comment comments commentlist commentsection disqus replies reply respond responses reactions guestbook talkback".split())
#: Words that may stand beside them in one name. Other words, such as has, no, with, free, enabled or results, make it a name of something else.
_NEUTRAL = frozenset(
    "area article bar block bottom box btn button buttons card cell col column container content desktop entry fixed float form group header icon icons "
    "inner item items js left link links list main mobile outer page panel post primary reader region right row secondary section site small sticky "
    "text title top user widget wrap wrapper".split()
)
#: Not said of a part inside the declared article, which may be about them.
_TOPICS = frozenset("legal search side".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_READERS_NOTES = frozenset(f"{who}-{what}" for who in ("user", "users", "reader", "readers", "visitor", "guest") for what in ("notes", "reviews", "opinions", "posts"))
_COMMENT_HEADING = re.compile(
    r"(?:\d+\s+(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)|(?:comments?|replies|kommentare|commentaires|comentarios)\s*\(\d+\)|"
    r"(?:reader|user)s?['’]?s?\s+comments?|leave a (?:comment|reply))",
    re.I,
)
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HEADING = re.compile(r"/h[1-6](?:/|\Z)")
_WHITE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？؟；]")


@dataclass(frozen=True)
class Ratios:
    """Reach of the smoothing (paths to each side), factor of the spread in the threshold, share of content text the article must hold."""

    reach: int = 1
    spread: float = 0.5
    held: float = 0.8


@dataclass
class Run:
    """Text of one block: its element's path of tags, the open elements' numbers, how much stands in links."""

    path: str
    chain: tuple[int, ...]
    text: str
    linked: int
    named: tuple[int, ...] = ()  # the open elements whose class or id names them side matter


#: How an element's attributes can declare it side matter: by what it is or does, by a name, by a name of reader comments.
_SURE, _NAMED, _NAMED_COMMENTS = 3, 1, 2


def _name_says(value: str, inside: bool) -> int:
    """What a class or id says: a name counts if all its words do, so ``has-sidebar`` or ``ad-free`` say nothing."""
    said = 0
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = [w for w in (part.rstrip("0123456789") for part in re.split(r"[-_:]+", name)) if w]
        known = (_WORDS - _TOPICS if inside else _WORDS) if name not in _READERS_NOTES else set(words)
        if not all(w in known or w in _COMMENTS or w in _NEUTRAL for w in words):
            continue
        if name in _READERS_NOTES or any(w in _COMMENTS for w in words):
            return _NAMED_COMMENTS
        if any(w in known for w in words):
            said = _NAMED
    return said


def _declared(attributes: str, ids: bool, inside: bool = False) -> int:
    """Whether, and how, an element's own attributes name it side matter; its id only counts with ``ids``."""
    said = 0
    seen = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in seen:  # the first of equal names counts
            continue
        seen.add(name)
        value = html.unescape("".join(values))
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return _SURE
        if name == "style" and "display:none" in _WHITE.sub("", value).lower():
            return _SURE
        if name == "role" and value.strip().lower() in _ROLES:
            return _SURE
        if name == "class" or name == "id" and ids:
            said = max(said, _name_says(value, inside))
    return said


def _end_of(name: str, page: str, place: int) -> int:
    """Where the element whose start tag ends at ``place`` ends, elements of its name inside it counted."""
    depth = 1
    for tag in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(page, place):
        depth += -1 if tag.group(1) else 1
        if not depth:
            close = page.find(">", tag.end())
            return close + 1 if close >= 0 else len(page)
    return place


def text_runs(page: str) -> list[Run]:
    """The page's blocks in order, without declared side matter.

    Side matter is declared by an element's tag or by its role, hidden,
    aria-hidden or style, or by the names in its class; by its id only outside
    the declared article, where ids name regions of the page, and never a
    heading's. A name is not believed of an element that holds most of the text,
    unless it is that of reader comments. What follows a heading that counts
    comments, in the element that has the heading, are comments.
    Markup may be broken: open elements end with the page, end tags without a
    start are skipped, and paragraphs and list items close as HTML has it.
    """
    runs: list[Run] = []
    stack: list[tuple[str, int, bool, int]] = []  # tag, number, in something surely besides, what names say
    comments: set[int] = set()
    parts: list[str] = []
    linked = number = links = 0
    place = 0

    def flush():
        nonlocal linked
        text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text and not (stack and stack[-1][2]):
            named = tuple(s[1] for s in stack if s[3])
            runs.append(Run("/".join(s[0] for s in stack), tuple(s[1] for s in stack), text, min(linked, len(text)), named))
        linked = 0

    def pop_to(depth: int):
        flush()
        del stack[depth:]

    def within() -> bool:
        return any(s[0] in ("article", "main") for s in stack)

    while True:
        tag = _TAG.search(page, place)
        chunk = page[place : tag.start() if tag else len(page)]
        if chunk:
            if tag is None and chunk.rfind("<") >= 0 and re.fullmatch(r"<[/!?A-Za-z][^>]*", chunk[chunk.rfind("<") :]):
                chunk = chunk[: chunk.rfind("<")]  # a tag that the page's end cut
            parts.append(chunk)
            if links:
                linked += len(chunk)
        if tag is None:
            break
        place = tag.end()
        name = (tag.group(2) or "").lower()
        if not name:
            continue
        if tag.group(1):
            if name in INLINE:
                if name == "a" and links:
                    links -= 1
                continue
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                pop_to(depth)
                links = 0
            elif name == "p":
                flush()
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in INLINE:
            if _declared(tag.group(3), not within(), within()):  # an inline element that declares itself as side matter is cut out
                place = _end_of(name, page, place)
            elif name == "a":
                links = 1
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in EMPTY_IF_CLOSED and tag.group(3).endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, place)
            place = close.end() if close else len(page)
            continue
        flush()
        if name in CLOSE_P:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == "p"), None)
            if depth is not None and not any(s[0] in ("button", "td", "th", "caption") for s in stack[depth:]):
                pop_to(depth)
        elif name in CLOSES:
            while stack and stack[-1][0] in CLOSES[name]:
                pop_to(len(stack) - 1)
        number += 1
        inner = stack[-1][2] if stack else False
        if name == "body":  # an unclosed head ends here
            pop_to(1 if stack and stack[0][0] == "html" else 0)
            inner = False
        ids = not within() and not _HEADING.fullmatch(f"/{name}")  # ids of parts and headings are their titles
        said = 0 if name in ("html", "body", "article", "main") else _declared(tag.group(3), ids, within())
        side = name in ASIDE and not (name == "header" and within()) or said == _SURE
        stack.append((name, number, inner or side, said))
        if said == _NAMED_COMMENTS:
            comments.add(number)
    flush()
    return _without_named(_before_comments(runs), comments)


def _before_comments(runs: list[Run]) -> list[Run]:
    """``runs`` without what follows a heading that counts comments, up to the end of the element that has it."""
    kept, ended = [], set()
    for run in runs:
        if ended.intersection(run.chain):
            continue
        if _HEADING.search(run.path) and _COMMENT_HEADING.fullmatch(run.text) and len(run.chain) > 1:
            ended.add(run.chain[-2])
            continue
        kept.append(run)
    return kept


def _without_named(runs: list[Run], comments: set[int]) -> list[Run]:
    """``runs`` without the elements that names declare, but for those that hold more than half of the unlinked text."""
    whole = sum(len(r.text) - r.linked for r in runs)
    held: dict[int, int] = {}
    for run in runs:
        for element in run.named:
            held[element] = held.get(element, 0) + len(run.text) - run.linked
    gone = {e for e, n in held.items() if e in comments or 2 * n <= whole}
    return [run for run in runs if not gone.intersection(run.named)]


def _smooth(values: np.ndarray, reach: int) -> np.ndarray:
    if not reach or len(values) < 2:
        return values
    offsets = np.arange(-reach, reach + 1)
    kernel = np.exp(-(offsets**2) / (2 * max(reach, 1) ** 2))
    weights = np.convolve(np.ones(len(values)), kernel)[reach:-reach]
    return np.convolve(values, kernel)[reach:-reach] / weights


def path_scores(runs: list[Run], ratios: Ratios) -> dict[str, tuple[float, float, float]]:
    """Of every tag path: length ratio, punctuation ratio, fused and smoothed score."""
    sums: dict[str, list[float]] = {}
    for run in runs:
        of = sums.setdefault(run.path, [0.0, 0.0, 0.0])
        of[0] += len(run.text) - run.linked
        of[1] += len(_PUNCTUATION.findall(run.text)) if run.linked < len(run.text) else 0
        of[2] += 1
    table = np.array(list(sums.values())).reshape(-1, 3)
    length, punctuation = table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]
    fused = _smooth(length, ratios.reach) * np.log1p(_smooth(punctuation, ratios.reach)) ** 0.5 * np.log1p(length)
    return {path: (float(a), float(b), float(c)) for path, a, b, c in zip(sums, length, punctuation, fused)}


def main_blocks(page: str, ratios: Ratios = Ratios()) -> list[str]:
    """The article's blocks in page order.

    If the page declares one article (or else one main part) with text, only its blocks are looked at.
    """
    runs = text_runs(page)
    declared = None
    for name in ("article", "main"):
        roots = {run.chain[run.path.split("/").index(name)] for run in runs if name in run.path.split("/")}
        if len(roots) == 1:
            declared = roots.pop()
            runs = [run for run in runs if declared in run.chain]
            break
    if not runs:
        return []
    scores = path_scores(runs, ratios)
    values = np.array([s[2] for s in scores.values()])
    limit = min(ratios.spread * values.std(), values.max())
    content = [run for run in runs if scores[run.path][2] >= limit]
    whole = sum(len(run.text) for run in content)
    held: dict[int, int] = {}
    for run in content:
        for element in run.chain:
            held[element] = held.get(element, 0) + len(run.text)
    # Elements are numbered in page order: the last that holds enough is the innermost.
    article = max((e for e, n in held.items() if n >= ratios.held * whole), default=None)
    if article is None:
        return [run.text for run in content]
    inside = [run for run in runs if article in run.chain]
    # Its parents' other blocks belong to it if they are headings or content, or, in a declared article, not mostly links.
    for parent in reversed(inside[0].chain[: inside[0].chain.index(article)]):
        more = [run for run in runs if parent in run.chain and article not in run.chain]
        open_text = sum(run.linked for run in more) * 2 <= sum(len(run.text) for run in more)
        if not (declared is not None and parent >= declared and open_text) and any(
            scores[run.path][2] < limit and not _HEADING.search(run.path) for run in more
        ):
            break
        article, inside = parent, [run for run in runs if parent in run.chain]
    return [run.text for run in inside]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratios: Ratios = Ratios()) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's blocks, joined by line feeds.

    Null and empty pages, and pages without text, give an empty text; ids and
    urls may be null or repeat. Each page is judged by itself.
    """
    ship_package(pages.sparkSession)
    source = picked(pages, page_id=id_col, url=url_col, text=html_col).withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches):
        for batch in text_batches(batches):
            texts = ["\n".join(main_blocks(page, ratios)) for page in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return source.mapInArrow(
        run,
        T.StructType(
            [*source.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
        ),
    )
