"""Main text of web pages by consensus on container paths of a host."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codestrata.llm.storage import ship, stored

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select button".split())
# Text that stands in these is not the article's; in a form or an element named so by class or id it may be.
OUTSIDE = frozenset("nav footer aside dialog menu head".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notification pagination paywall popup promo promoted related respond sharing share sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# A name says nothing after these: a wrapper that has a sidebar is no sidebar.
ABOUT = frozenset("has no not with without".split())
MARK = " !"  # ends the name of an element that may be outside; no class name holds a blank
DEEPEST = 512  # containers of a path; what is nested deeper counts for the last of them, as browsers do it
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("html body main article section div td center blockquote figure details header".split())
# These end an open paragraph; around them text falls into blocks.
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table tr th thead tbody tfoot caption hr br figcaption address fieldset summary form".split()) | OUTSIDE
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z))", re.S)
# Quotes count right after = only; an unquoted value ends at white space or the tag's end.
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_COMMENTS = re.compile("comments?(?:area|body|box|container|form|list|section|thread|wrap|wrapper)")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_WORDS = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\u2026][\"'\u201d\u2019)]*(?=\s|\Z)|[\u3002\uff01\uff1f]")


def _says_outside(words: list[str]) -> bool:
    for word, after in zip(words, [*words[1:], ""]):
        if word in ABOUT:
            return False
        if (word in OUTSIDE_NAMES or _COMMENTS.fullmatch(word)) and not (word == "related" and after in ("work", "works")):
            return True
    return False


def _names(attributes: str) -> tuple[str, bool]:
    """The generalised first class (digits as #) and whether a class or id names something outside the article."""
    first, outside = "", False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        kind = kind.lower()
        if kind not in ("class", "id"):
            continue
        value = "".join(values).lower()
        if kind == "class" and not first and value.split():
            first = "." + _DIGITS.sub("#", value.split()[0])
        outside = outside or any(_says_outside(_WORDS.findall(v)) for v in value.split())
    return first, outside


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(container path, text, characters in links) of the text blocks outside menus and the like, in
    page order. A path holds the generalised tag and class of each container from the root on, and ends with MARK
    at those that are outside by name, and at forms."""
    stack: list[tuple[str, bool, bool]] = []  # (tag, outside, is in the path)
    opened: dict[str, int] = defaultdict(int)  # how often each tag is on the stack
    stops: list[int] = []  # places of paragraphs and containers on the stack
    path: list[str] = []
    shown: tuple[str, ...] | None = ()
    parts: list[str] = []
    linked = links = outside = 0
    at, end, raw = 0, len(page), ""

    def block():
        nonlocal linked, shown
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
        if text and not outside and shown is None:
            shown = tuple(path[:DEEPEST])
        found = (shown, text, linked) if text and not outside else None
        parts.clear()
        linked = 0
        return found

    def close(n: int) -> None:
        nonlocal links, outside, shown
        while len(stack) > n:
            tag, out, container = stack.pop()
            opened[tag] -= 1
            outside -= out
            links -= tag == "a"
            if stops and stops[-1] == len(stack):
                stops.pop()
            if container:
                if len(path) <= DEEPEST:
                    shown = None
                path.pop()

    def inner(names: tuple[str, ...], ends) -> int | None:
        """The innermost open element of these names, unless one that `ends` holds for stands in between."""
        if any(opened[name] for name in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    return k
                if ends(stack[k]):
                    break
        return None

    while at < end:
        tag = _TAG.search(page, at)
        stop = tag.start() if tag else end
        if stop > at and not outside:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if tag is None:
            break
        at = tag.end()
        closing, name, attributes = tag.groups()
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS and (found := block()):
            yield found
        if closing:
            # An inline end tag does not reach beyond the block it stands in.
            k = inner((name,), (lambda s: False) if name in BLOCKS else (lambda s: s[0] in BLOCKS))
            if k is not None:
                if name not in BLOCKS and stack[k][2] and (found := block()):
                    yield found
                close(k)
            continue
        if name in RAW and not attributes.endswith("/"):
            raw = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = raw.end() if raw else end
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in BLOCKS:
            # A block ends an open paragraph and what is open in it; an item ends the item before.
            if stops and stack[stops[-1]][0] == "p":
                close(stops[-1])
            if name in SAME_ENDS:
                k = inner(SAME_ENDS[name], lambda s: s[2] or s[0] in ("ul", "ol", "dl", "table"))
                if k is not None:
                    close(k)
        container = name in CONTAINERS
        first, named = _names(attributes) if attributes else ("", False)
        article_head = name == "header" and opened["article"] > 0
        named = named and name not in ("html", "body", "main") and not article_head
        out = (name in OUTSIDE or name == "header") and not article_head or named and name in INLINE
        if (named or name == "form") and not out:
            if found := block():
                yield found
            first += MARK
            container = True
        if container or name == "p":
            stops.append(len(stack))
        stack.append((name, out, container))
        opened[name] += 1
        outside += out
        links += name == "a"
        if container:
            if len(path) < DEEPEST:
                shown = None
            path.append(name + first)
    if found := block():
        yield found


def _own(text: str, linked: int) -> int:
    return max(0, len(text) - 2 * linked)


def _is(name: str, *tags: str) -> bool:
    return name.partition(" ")[0].partition(".")[0] in tags


def _doubted(found: list[tuple[tuple[str, ...], str, int]]) -> set[tuple[str, ...]]:
    """Paths of elements that are outside by name, or forms, and are so on this page: where an article or main stands
    free of such, all of them, since readers' comments may be articles too; else those without an article or main that is
    not named so itself and, where there is none, with no more than half of the page's text outside links."""
    share: dict[tuple[str, ...], int] = defaultdict(int)
    total, safe, plain, last = 0, set(), False, None
    for path, text, linked in found:
        own = _own(text, linked)
        total += own
        if path is not last:
            last = path
            marked = [path[: k + 1] for k, name in enumerate(path) if name.endswith(MARK)]
            inner = max((k for k, name in enumerate(path) if _is(name, "article", "main") and not name.endswith(MARK)), default=-1)
            plain = plain or inner >= 0 and not marked
            safe.update(m for m in marked if len(m) <= inner)
        for m in marked:
            share[m] += own
    return {p for p, own in share.items() if plain or p not in safe and 2 * own <= total}


def scores(found: list[tuple[tuple[str, ...], str, int]]) -> dict[tuple[str, ...], float]:
    """Points of each container path of a page: the text of its blocks outside links, half of what the
    containers in it have, a quarter of the next level's; sentences count more than labels."""
    points: dict[tuple[str, ...], float] = defaultdict(float)
    own_points: dict[int, list] = {}  # points of each path as the blocks share it, so that a path is looked through once
    for path, text, linked in found:
        entry = own_points.setdefault(id(path), [path, 0.0])
        entry[1] += _own(text, linked) * (1.0 if re.search(r"[.!?,;:]", text) else 0.5)
    doubted = _doubted(found)
    for path, own in own_points.values():
        if doubted and any(name.endswith(MARK) and path[: k + 1] in doubted for k, name in enumerate(path)):
            continue
        for level in range(min(3, len(path))):
            points[path[: len(path) - level]] += own / 2**level
    return points


def best(points: dict[tuple[str, ...], float]) -> tuple[str, ...]:
    """The path with most points; of equal ones the longer, then the first by name. Within an article, or
    else a main element, that element is the container."""
    path = min(points, key=lambda p: (-points[p], -len(p), p), default=())
    for tag in ("article", "main"):
        for k, name in enumerate(path):
            if _is(name, tag):
                return path[: k + 1]
    return path


def _within(own: tuple[str, ...], n: int) -> bool:
    """Nothing below the first n containers of the path is outside by name."""
    return not any(name.endswith(MARK) for name in own[n:])


def text_under(found: list[tuple[tuple[str, ...], str, int]], path: tuple[str, ...]) -> str:
    return " ".join(text for own, text, _ in found if own[: len(path)] == path and _within(own, len(path)))


def _prose(texts: list[tuple[str, int]]) -> bool:
    """Mostly outside links, and sentences: an end mark for 24 to 400 bytes."""
    text = " ".join(t for t, _ in texts)
    return 2 * sum(n for _, n in texts) < len(text) and 24 <= len(text.encode()) / max(len(_SENTENCE.findall(text)), 0.1) <= 400


def article_text(found: list[tuple[tuple[str, ...], str, int]], path: tuple[str, ...]) -> str:
    """The text under the path with what stands beside it up to the highest ancestor that adds prose, but for
    containers that are mostly links. An article or main element, or one that is
    outside by its name but holds the text, is not left."""
    under, last = [], None
    for own, _, _ in found:
        if own is not last:
            last, yes = own, own[: len(path)] == path and _within(own, len(path))
        under.append(yes)
    if path and _is(path[-1], "article", "main") or not _prose([(text, n) for (_, text, n), yes in zip(found, under) if yes]):
        return " ".join(text for (_, text, _), yes in zip(found, under) if yes)
    top = max((k + 1 for k, name in enumerate(path) if name.endswith(MARK)), default=0)
    beside: dict[int, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
    for at, (own, _, _) in enumerate(found):
        level = next((k for k, (a, b) in enumerate(zip(own, path)) if a != b), min(len(own), len(path)))
        if top <= level < len(path) and _within(own, level):
            # A block of the ancestor itself stands alone.
            beside[level][own[level] if len(own) > level else f" {at}"].append(at)
    groups = [(level, g, [found[k][1:] for k in g]) for level, named in beside.items() for g in named.values()]
    top = min((level for level, _, texts in groups if _prose(texts)), default=len(path))
    for level, g, texts in groups:
        if level >= top and 2 * sum(n for _, n in texts) < sum(len(t) for t, _ in texts):
            for k in g:
                under[k] = True
    return " ".join(text for (_, text, _), yes in zip(found, under) if yes)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page) to (host, path, points): each page's vote, the share of its points its best path has."""
    for batch in batches:
        for a in range(0, len(batch), 64):
            rows = []
            for host, page in zip(batch["host"][a : a + 64].to_pylist(), batch["page"].slice(a, 64)):
                points = scores(list(blocks(page.as_py())))
                if points and (path := best(points)):
                    rows.append((host, ">".join(path), points.get(path, 0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["host", "path", "points"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, len(whole), 64):
            batch = whole.slice(a, 64)
            texts = []
            for page, voted in zip(batch["_page"], batch["_path"].to_pylist()):
                found = list(blocks(page.as_py()))
                text = article_text(found, tuple(voted.split(">"))) if voted else ""
                texts.append(text or article_text(found, best(scores(found))))
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in ("_page", "_path")}
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string())})


def host_of(url):
    """The host part of a URL in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """`pages` with a column text, the main text, instead of the html (a column text of theirs is replaced).

    1. Each page is cut into text blocks with the path of tags and classes of the containers around
       them, digits in class names as #. Menus, headers, footers, sidebars, scripts and styles are left out by tag.
       Forms, and adverts, notices, comments and the like by class or id, are marked: they get no points unless, on
       a page without an article or main elsewhere, they hold one or most of its text outside links. An article
       named so is marked as well. Below DEEPEST containers a path grows no further; the text is kept.
       Each container gets points for its text; the page votes for its best path.
    2. Votes are added up per host and path (combined on the map side); the path with most votes, then
       most points, then first by name, wins the host.
    3. Each page gives the blocks under the host's path, in page order, but for marked elements in it; without any
       there, or without a host, those under its own best path. Unless that is an article or main, the text
       beside it in its ancestors is added as far up as it is prose outside links.

    Character references are decoded, white space `[\\x20\\x09-\\x0D]+` in a block becomes one space, blocks are
    trimmed and joined by one space. Whole pages are read. A null or empty html, or one without
    text, gives an empty text. Rows that repeat a page are pages of their own. Broken markup is read as
    far as it goes: unclosed elements end with their parent. An empty table gives no rows.
    """
    ship(pages.sparkSession)
    pages = pages.drop(*({"_page", "_path", "_host", "text"} - {html_col, url_col} & set(pages.columns)))
    asked = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("page"))
    votes = asked.where("host is not null").mapInArrow(_vote, "host string, path string, points double")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("points", 3).cast("decimal(28,3)")).alias("points"))
    # Stored, so that the planner knows its size: it is sent around only if small.
    won = stored(counted.groupBy(F.col("host").alias("_host")).agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("points"), "path")).alias("_path")), "host-paths")
    rest = [c for c in pages.columns if c not in (html_col, "text")]
    placed = pages.withColumn("_page", F.coalesce(html_col, F.lit(""))).join(won, host_of(F.col(url_col)) == F.col("_host"), "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in rest)
    return placed.select(*(F.col(f"`{c}`") for c in rest), "_page", "_path").mapInArrow(_extract, f"{fields}, text string")
