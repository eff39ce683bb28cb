"""Main text of web pages by consensus of the hosts' pages on container paths."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .batches import add_columns, columns

# Tags by their part in a page.
SKIPPED = frozenset("script style noscript template svg annotation annotation-xml iframe object embed canvas video audio head select button textarea".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
UNSEEN = frozenset("script style noscript template".split())
SIDE = frozenset("nav aside footer form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
#: Open tags that a tag closes, each with the tags beyond which it closes nothing. Every block tag also closes a paragraph.
IMPLIED = {
    "li": (("li", ("ul", "ol", "table")),),
    "dt": (("dt", ("dl",)), ("dd", ("dl",))),
    "dd": (("dt", ("dl",)), ("dd", ("dl",))),
    "tr": (("td", ("table",)), ("th", ("table",)), ("tr", ("table",))),
    "td": (("td", ("tr", "table")), ("th", ("tr", "table"))),
    "th": (("td", ("tr", "table")), ("th", ("tr", "table"))),
    "option": (("option", ("select",)),),
}
_PARAGRAPH = (("p", ("table", "td", "th", "caption", "object")),)
#: Tags that stand in a page's head; any other one, and text, ends a head that isn't closed.
HEAD = frozenset("title base link meta script style noscript template head".split())
#: Tags of a page's frame, and others that tell so of a form right under body: a form with one around it isn't a form of the page.
FRAME, BODY_FRAME = frozenset("article main h1 header nav footer".split()), frozenset("p h2 h3 section table article main h1 header nav footer".split())
#: Elements of running text. Class words that may speak of what they say, rather than of what they are, don't count on them.
SPOKEN = {**dict.fromkeys("p h1 h2 h3 h4 h5 h6".split(), re.compile(r"^(?:banner|nav\w*|menu|side|sidebar|footer|foot|masthead|site-?header|page-?header|topbar|notice|share|sharing|social|related|comments?|respond|replies|reply|legal|skip)$", re.I)), "li": re.compile(r"^(?:side|page-?header|notice|legal|skip)$", re.I)}
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: Words of a class or id that name something beside the article. They are evidence only: see `scores` and `main_text`.
BESIDE = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|footer|foot|masthead|site-?header|page-?header|topbar|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|respond|replies|reply|disqus|widget|toolbar|pagination|pager|copyright|legal|skip)(?:$|[-_ ])", re.I)
_NAME = re.compile(r"[^\s/>]*+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)?(\s*+=\s*+)?")
_UNQUOTED = re.compile(r"[^\s>]*+")
_PLAIN = re.compile(r"\s*+>")
_LONG_REFERENCE = re.compile(r"&#0*+(?:([0-9]{1,7})(?![0-9])|[0-9]++);?")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


def host_of(url: str | None) -> str:
    """Lower-cased host of a URL; empty if there is none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _step(tag: str, names: dict[str, str]) -> str:
    """A path's step: tag and classes, digits generalised."""
    kinds = sorted({_DIGITS.sub("#", c) for c in names.get("class", "").split()})
    return tag + "".join("." + c for c in kinds)


def attributes(html: str, k: int) -> tuple[dict[str, str] | None, bool, int]:
    """Attributes of a tag from the end of its name on, whether it ends in />, and where it ends; None if the page ends in it.

    Quotes count only at the beginning of a value, as in browsers; the first of equal names holds. One pass.
    """
    if m := _PLAIN.match(html, k):
        return {}, False, m.end()
    found: dict[str, str] = {}
    n = len(html)
    while k < n:
        m = _ATTRIBUTE.match(html, k)
        name, k = m[1], m.end()
        if name is None:
            if k < n:  # here is the tag's end
                return found, html[k - 1] == "/", k + 1
            break
        value = ""
        if m[2]:
            if html[k : k + 1] in ('"', "'"):
                end = html.find(html[k], k + 1)
                if end < 0:
                    return None, False, n
                value, k = html[k + 1 : end], end + 1
            else:
                u = _UNQUOTED.match(html, k)
                value, k = u[0], u.end()
                if html[k : k + 1] == ">":  # a slash that ends an unquoted value doesn't end the element
                    found.setdefault(name.lower(), value)
                    return found, False, k + 1
        found.setdefault(name.lower(), value)
    return None, False, n


def decoded(text: str) -> str:
    """Character references decoded; numbers of any length, those beyond all characters as U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_REFERENCE.sub(lambda m: f"&#{m[1]};" if m[1] else "\ufffd", text)
    return unescape(text)


@dataclass
class Block:
    """Text of a page: the node it sits in, its words, how much of them is in links, the innermost container around it whose
    class or id names something beside the article (0: none), and whether such a part around it is no container."""

    node: int
    words: str
    linked: int
    part: int
    beside: bool

    @property
    def value(self) -> float:
        size = len(self.words)
        return (size - 2 * self.linked) * (1.0 if size >= 40 or self.words[-1:] in ".!?…" else 0.5)


@dataclass
class Page:
    """Container paths of a page as a tree, and its blocks of text in page order.

    A node is one generalised path: its parent, a hash of the whole path, its last step and its depth; a parent comes
    before its children. Node 0 is the page.
    """

    parent: list[int]
    key: list[int]
    step: list[str]
    depth: list[int]
    blocks: list[Block]


def parse(html: str) -> Page:
    """The page's containers and the blocks of text outside side parts. Time and space are linear in its length, however
    deep it nests. Tags that aren't closed, an open head among them, end where HTML's rules on optional tags end them; a
    closing tag closes all that is open inside its element. A form around the page itself, as some servers write, is no form."""
    page = Page([-1], [0], [""], [0], [])
    known: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, bool, int, int, bool]] = []  # tag, leaves out its text; node, part and beside of what is outside
    places: dict[str, list[int]] = {}  # where in the stack a tag is open
    node, part, beside = 0, 0, False
    hidden = linked = 0
    text: list[str] = []

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(decoded("".join(text)).split())
            if words:
                page.blocks.append(Block(node, words, min(linked, len(words)), part, beside))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal hidden, node, part, beside
        tag, hides, node, part, beside = stack.pop()
        hidden -= bool(hides)
        places[tag].pop()

    def say(a: int, b: int) -> None:
        nonlocal linked
        if a < b and hidden and stack and stack[-1][0] == "head" and not html[a:b].isspace():
            pop()
        if a < b and not hidden:
            text.append(html[a:b])
            linked += len(html[a:b].strip()) if places.get("a") else 0

    def only_form(tag: str, names: dict[str, str]) -> bool:
        return tag == "form" and names.get("role", "").lower() not in ROLES and "hidden" not in names and not ("style" in names and _INVISIBLE.search(names["style"]))

    def named_beside(tag: str, label: str) -> bool:
        if tag not in SPOKEN:
            return BESIDE.search(label) is not None
        return any(not SPOKEN[tag].match(m.strip("-_ ")) for m in BESIDE.findall(label.replace(" ", "  ")))

    def last(tags: tuple[str, ...]) -> int:
        return max([places[t][-1] for t in tags if places.get(t)], default=-1)

    k, n = 0, len(html)
    while k < n:
        at = html.find("<", k)
        if at < 0:
            say(k, n)
            break
        closes = html.startswith("/", at + 1)
        lead = html[at + 1 + closes : at + 2 + closes]
        if not (lead.isascii() and lead.isalpha()):
            if html.startswith("<!--", at):
                say(k, at)
                end = html.find("-->", at + 2)
                k = end + 3 if end >= 0 else n
            elif html.startswith("<![CDATA[", at):
                say(k, at)
                end = html.find("]]>", at)
                if not hidden:
                    text.append(html[at + 9 : end if end >= 0 else n].replace("&", "&amp;"))
                k = end + 3 if end >= 0 else n
            elif lead in ("!", "?") or closes:
                say(k, at)
                end = html.find(">", at)
                k = end + 1 if end >= 0 else n
            else:  # not a tag
                say(k, at + 1)
                k = at + 1
            continue
        say(k, at)
        name = _NAME.match(html, at + 1 + closes)
        tag = name[0].lower()
        names, empty, k = attributes(html, name.end())
        if names is None:
            break
        if tag not in INLINE and tag not in UNSEEN:
            flush()
        if not closes and tag not in HEAD and stack and stack[-1][0] == "head":
            pop()
        if not closes and places.get("form") and tag in BODY_FRAME:
            place = places["form"][0]
            if stack[place][1] == "form" and (tag in FRAME or place and stack[place - 1][0] == "body"):
                stack[place] = (stack[place][0], 0, *stack[place][2:])
                hidden -= 1
        if closes:
            if places.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, k)
            k = html.find(">", end.end() - 1) + 1 if end else n
            k = k or n
            continue
        if empty:
            continue
        if tag not in INLINE:
            for closed, scope in _PARAGRAPH + IMPLIED.get(tag, ()):
                place = last((closed,))
                if place > last(scope):
                    while len(stack) > place:
                        pop()
        label = f"{names.get('class', '')} {names.get('id', '')}"
        inside = places.get("article") or places.get("main")
        hides = tag in SKIPPED or tag in SIDE or (tag == "header" and not inside) or names.get("role", "").lower() in ROLES
        hides = hides or ("hidden" in names and names["hidden"].lower() != "false") or ("style" in names and _INVISIBLE.search(names["style"]) is not None)
        places.setdefault(tag, []).append(len(stack))
        # "form" hides like True, but can be taken back
        stack.append((tag, "form" if hides and only_form(tag, names) else hides, node, part, beside))
        hidden += hides
        if tag in CONTAINERS:
            step = _step(tag, names)
            child = known.get((node, step))
            if child is None:
                child = known[node, step] = len(page.parent)
                page.parent.append(node)
                page.key.append(xxhash.xxh64_intdigest(f"{page.key[node]}/{step}") - (1 << 63))
                page.step.append(step)
                page.depth.append(page.depth[node] + 1)
            node = child
        if label != " " and tag not in ("html", "body", "article", "main") and named_beside(tag, label):
            if tag in CONTAINERS:
                part = node
            else:
                beside = True
    flush()
    return page


def scores(page: Page) -> list[float]:
    """Score of each node: unlinked text under it, more for sentences and for article or main, less for the page as a whole.

    Text in a container that is named as something beside the article counts a tenth, and for no container around that
    one; so such a container wins only where there is nothing else, or where the host's other pages vote for it.
    """
    total = sum(len(b.words) - b.linked for b in page.blocks) or 1
    good, held = [0.0] * len(page.parent), [0.0] * len(page.parent)
    for b in page.blocks:
        if not b.beside:
            good[b.node] += 0.1 * b.value if b.part else b.value
            held[b.part] += 0.1 * b.value
    for node in range(len(good) - 1, 0, -1):
        good[page.parent[node]] += good[node] - held[node]
    out = []
    for node, value in enumerate(good):
        tag = page.step[node].partition(".")[0]
        kind = 1.5 if tag == "article" else 1.3 if tag == "main" else 0.7 if tag in ("", "html", "body") else 1.0
        out.append(kind * value / total + 0.01 * min(page.depth[node], 10))
    return out


def best(page: Page) -> int:
    """The page's own best node; 0, the page itself, without any container."""
    s = scores(page)
    return max(range(1, len(s)), key=lambda i: (s[i], -i), default=0)


def main_text(page: Page, winner: int | None) -> str:
    """Text of all blocks under the node with the winning path's hash, without the parts inside it that are named as
    something beside the article; of the page's own best node if it holds nothing there; else of all blocks."""
    for top in (page.key.index(winner) if winner in page.key else 0, best(page)):
        under = [False] * len(page.parent)
        under[top] = top > 0
        for i in range(top + 1, len(under)):
            under[i] = under[page.parent[i]]
        words = [b.words for b in page.blocks if under[b.node] and not b.beside and page.depth[b.part] <= page.depth[top]]
        if words:
            return " ".join(words)
    return " ".join(b.words for b in page.blocks)


def host_column(url: Column) -> Column:
    """host_of as a Spark expression."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def vote(pages: DataFrame) -> DataFrame:
    """(host, path, step): of each host the path with the most votes, as its hash, with its last step. A page votes for its
    container paths with their scores, so paths that are good on most pages beat one page's oddity; votes are summed in
    the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, int, str], float] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = parse(html.as_py() or "")
                for key, step, s in list(zip(page.key, page.step, scores(page)))[1:]:
                    total[host, key, step] = total.get((host, key, step), 0.0) + s
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in total]), pa.array([x[1] for x in total], pa.int64()), pa.array([x[2] for x in total]), pa.array(list(total.values()), pa.float64())], ["host", "path", "step", "votes"])

    votes = pages.select(host_column(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path long, step string, votes double")
    summed = votes.groupBy("host", "path", "step").agg(F.sum(F.round("votes", 6).cast("decimal(20,6)")).alias("votes"))
    return summed.groupBy("host").agg(F.max_by(F.struct("path", "step"), F.struct("votes", "path")).alias("w")).select("host", "w.*")


#: Hosts whose winners are sent to all tasks; with more, pages and winners are joined by a shuffle, a host's pages in so many parts.
BROADCAST_HOSTS, PARTS = 300_000, 32


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars in place of html.

    Pages of one host vote on the container path that holds the main text, then every page is extracted by its host's
    winning path. Pages without a host share the empty one; a page on which the winner holds nothing falls back to its own best
    container, then to all text outside side parts. Menus, page headers, footers, asides, forms, notices, adverts,
    comments, scripts and styles are left out by tag, role and class. Null html gives an empty text; repeated rows and
    other columns are kept; columns named text, n_chars or path are replaced. Nothing is cut, whatever a page's length.
    """
    winners = Scratch(pages.sparkSession, "hosts").keep(vote(pages), "winners")
    rest = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "path", "html")]
    carried = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns(rest))], F.lit(0).alias("none")).alias("row")
    rows = pages.select(carried, "html", host_column(F.col("url")).alias("host"))
    side = winners.select("host", "path")
    if winners.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(side), "host", "left")
    else:
        rows = rows.withColumn("deal", F.pmod(F.xxhash64("row", "html"), F.lit(PARTS)))
        joined = rows.join(side.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["host", "deal"], "left")

    def run(sources: pa.Array, paths: pa.Array) -> list[pa.Array]:
        texts = [main_text(parse(h.as_py() or ""), p) for h, p in zip(sources, paths.to_pylist())]
        return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    out = add_columns(joined, ["row"], [F.col("html"), F.col("path")], run, "text string, n_chars long")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], "text", "n_chars")
