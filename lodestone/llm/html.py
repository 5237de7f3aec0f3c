"""Main text of web pages: tag roles, and a suffix array over each host's pages for what repeats.

1. A page becomes blocks of text. Elements whose role is known (menus, headers, footers, side bars, notices,
   adverts, forms, scripts, comments) are left out; blocks inside an article are the main text.
2. What no role settles are blocks outside any article, whether the page has one or not, and blocks of links inside
   an article. Their token streams, put together host by host, are searched for long substrings that occur on
   distinct pages (`suffixes.repeats`: anchors, suffix array, common prefixes). Covered tokens are boilerplate
   and go; unique runs stay. Beside an article a block stands alone in its stream and, if it is short, is met as a
   whole; one made of links is a menu and no text. Pages of one host whose text is the same, article included, are
   one page to the search, so copies of a page don't erase each other. Text inside an article is otherwise never
   removed: articles may quote each other.

Defined cases: null html is empty (empty text); null url is its own host; null page_id is kept; equal rows are
one page to the search and give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, pick, row_key, settled
from .suffixes import repeats

#: Bytes of a token in a stream, and tokens of a substring that counts as long.
TOKEN, LONG = 4, 8
GRAM = 4 * TOKEN

# HTML elements by what they mean here.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video select button title".split())
DROPPED = frozenset("head nav footer aside form menu dialog header".split()) | RAW
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr input".split())
# Words in class, id and role that name what is no article text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay popup promo related replies reply respond share sharing sidebar signup skip social sponsor sponsored sponsoring subscribe subscription toc toolbar widget".split()
)
# Parts of class names that tell a state of what is around ("no-sidebar", "comments-open"), names of
# classes that hide, and ids of what holds a page's text.
STATES = frozenset("has no not non with without open opened closed enabled disabled allowed on off".split())
HIDING = frozenset("hidden is-hidden visually-hidden".split())
MAIN_IDS = frozenset("main content main-content primary page wrapper container article".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    main: bool
    linked: int  # characters inside links


def _names_boilerplate(token: str) -> bool:
    """A class or id that names what is no article text, not a state such as 'no-sidebar'."""
    parts = _NAME.findall(token)
    return token in HIDING or any(w in BOILERPLATE for w in parts) and not any(w in STATES for w in parts)


def _role(name: str, attributes: str, inside: bool, nested: bool = False) -> tuple[bool, bool]:
    """(dropped, main) of an element by its name and attributes; `nested`: an article inside another."""
    dropped = name in DROPPED and not (name == "header" and inside)
    main = name in MAIN
    if attributes:
        named, holds = False, name in ("body", "html") or name in MAIN and not nested  # what holds the text is no boilerplate by its class
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "").lower()
            if key in ("class", "id"):
                named |= any(map(_names_boilerplate, value.split()))
                holds |= key == "id" and value in MAIN_IDS
            elif key == "role":
                dropped |= value in BOILERPLATE_ROLES
                main |= value in ("main", "article")
                holds |= value == "main" or value == "article" and not inside
            elif key == "itemprop":
                main |= value == "articlebody"
                holds |= value == "articlebody"
            elif key == "aria-hidden":
                dropped |= value == "true" and name not in INLINE
            elif key == "style":
                dropped |= bool(_UNSEEN.search(value))
            elif key == "hidden":
                dropped = True
        dropped |= named and not holds
    return dropped, main and not dropped


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag, and with no name of comments and declarations; of character
    data, the attributes are its text. What a text names as `at` by `send` is where the next may start. Every character is read
    once or twice: a quotation mark that has no other after it counts as any character."""
    at, alone = 0, set()
    while m := _OPEN.search(page, at):
        head, start, at = m[0], m.start(), m.end()
        if m[2] is None:
            mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(head, ">")
            stop = page.find(mark, at)
            inner, at = page[at:] if stop < 0 else page[at:stop], len(page) if stop < 0 else stop + len(mark)
            said = inner if head == "<![CDATA[" else ""
            at = (yield start, at, None, False, said) or at
            continue
        first = at
        while stop := _STOP.search(page, at):
            at = stop.end()
            if stop[0] == ">":
                break
            close = -1 if stop[0] in alone else page.find(stop[0], at)
            if close < 0:
                alone.add(stop[0])
            else:
                at = close + 1
        else:
            at = len(page)
        inner = page[first : at - 1] if page[at - 1 : at] == ">" and at > first else page[first:at]
        at = (yield start, at, m[2].lower(), bool(m[1]), inner) or at


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without those whose element's role excludes them."""
    out: list[Block] = []
    words: list[str] = []
    linked = 0
    open_: list[tuple[str, bool, bool]] = []  # name, dropped, main, each with all that stand around it
    links = 0

    def flush(main: bool) -> None:
        nonlocal linked
        if words and (text := " ".join(" ".join(words).split())):
            out.append(Block(text, main, linked))
        words.clear()
        linked = 0

    def state() -> tuple[bool, bool]:
        return open_[-1][1:] if open_ else (False, False)

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not state()[0]:
            text = html.unescape(raw) if "&" in raw else raw
            if text[0].isspace() or not words:
                words.append(text)
            else:
                words[-1] += text
            linked += len(text.strip()) if links else 0

    def close(k: int) -> None:
        del open_[k:]

    at, found, skip = 0, tags(page), None
    while True:
        try:
            start, stop, name, end, attributes = found.send(skip)
        except StopIteration:
            break
        skip = None
        say(page[at:start])
        at = stop
        if name is None:
            say(attributes)
            continue
        if name == "a":
            links = 0 if end else 1
            continue
        dropped, main = (False, False) if end else _role(name, attributes, state()[1], name == "article" and any(x[0] == name for x in open_))
        if name in INLINE and not dropped and not (end and any(x[0] == name for x in open_)):
            if name == "br":
                say(" ")
            continue
        flush(state()[1])
        links = 0
        if end:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    close(k)
                    break
                if open_[k][0] in MAIN and name not in ("body", "html"):
                    break  # a stray end tag doesn't close the article around it
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            closing = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            skip = at = closing.end() if closing else len(page)
            continue
        if open_ and open_[-1][0] == "p" or open_ and name == "li" == open_[-1][0]:
            close(len(open_) - 1)  # their end tags may be missing
        if main and not any(x[2] for x in open_):
            open_.append((name, False, True))  # an article ends whatever was left open around it
        else:
            around = state()
            open_.append((name, around[0] or dropped, around[1] or main))
    say(page[at:])
    flush(state()[1])
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def open_blocks(found: list[Block]) -> list[int]:
    """Places of the blocks that the search over the host decides on: all where no block is of an article, else links inside it and text beside it."""
    if any(b.main for b in found):
        return [i for i, b in enumerate(found) if b.main == (b.linked > len(b.text) / 2)]
    return list(range(len(found)))


def _marks(b: Block, words: int, beside: bool) -> tuple[int, int]:
    """Tokens before and after a block's words in the stream. Beside an article they name the whole block, so no string that goes over
    its ends is another block's, and fill a short one up to LONG."""
    return (1, max(1, LONG - 1 - words)) if beside and not b.main else (0, 0)


def stream(found: list[Block], host: str) -> bytes:
    """TOKEN bytes for each word of the open blocks and each mark; equal words of different hosts differ."""
    seed, beside, out = xxhash.xxh3_64_intdigest(host) & 0xFFFFFFFF, any(b.main for b in found), []
    for i in open_blocks(found):
        words = found[i].text.split(" ")
        before, after = _marks(found[i], len(words), beside)
        marks = [f"{k} {found[i].text}" for k in range(before + after)]  # no word has a blank
        out += [xxhash.xxh32_digest(w, seed=seed) for w in [*marks[:before], *words, *marks[before:]]]
    return b"".join(out)


def _page_name(found: list[Block], searched: bytes, host: str) -> bytes:
    """What pages of one host with the same text share: their stream, and what of an article is not in it."""
    undecided = set(open_blocks(found))
    settled_text = [f"\n{b.text}".encode() for i, b in enumerate(found) if b.main and i not in undecided]
    return xxhash.xxh3_128_digest(b"".join([searched, *settled_text]), seed=xxhash.xxh3_64_intdigest(host))


def main_text(found: list[Block], covered: list[tuple[int, int]] = ()) -> str:
    """The blocks of the main text, without the tokens of open blocks that lie in `covered` (byte intervals of the stream)."""
    has_main = any(b.main for b in found)
    undecided = set(open_blocks(found))
    gone: set[int] = set()
    for a, b in covered:
        gone.update(range(-(-a // TOKEN), b // TOKEN))
    out, place = [], 0
    for i, b in enumerate(found):
        if i in undecided:
            words = b.text.split(" ")
            before, after = _marks(b, len(words), has_main)
            kept = [w for k, w in enumerate(words, place + before) if k not in gone]
            place += before + len(words) + after
            if kept:
                out.append(" ".join(kept))
        elif b.main or not has_main:
            out.append(b.text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    ids = f"page_id {kind_of(pages, 'page_id')}, url {kind_of(pages, 'url')}"

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [host_of(u) for u in batch.column(1).to_pylist()]
            at, got, same = [], [], []
            for i, (host, h) in enumerate(zip(hosts, batch.column(2).to_pylist())):
                found = blocks(h)
                if len(s := stream(found, host)) >= LONG * TOKEN:
                    at.append(i)
                    got.append(s)
                    same.append(_page_name(found, s, host))
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(same, pa.binary()), pa.array(got, pa.binary())], names=["page", "row", "text"])

    keyed = pages.select(row_key("page_id", "url", "html").alias("page"), "url", "html")
    candidates = settled(keyed.mapInArrow(streams, "page binary, row binary, text binary").dropDuplicates(["page"]))  # else every use would parse all pages again
    def texts(batches: Iterator[pa.RecordBatch], settle: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at, out = [], []
                spans = part.column(3).to_pylist() if settle else [None] * part.num_rows
                for i, (url, h, s) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), spans)):
                    found = blocks(h)
                    if settle == (len(stream(found, "")) >= LONG * TOKEN):
                        at.append(i)
                        out.append(main_text(found, [(x["a"], x["b"]) for x in s or ()]))
                take = pa.array(at, pa.int64())
                yield pa.record_batch([part.column(0).take(take), part.column(1).take(take), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"{ids}, text string, n_chars long"
    if not candidates.limit(1).count():  # nothing for the search to decide, so no page need move
        return pages.mapInArrow(lambda batches: texts(batches, False), schema)
    spans = repeats(candidates.select("row", "text").dropDuplicates(["row"]), LONG * TOKEN, GRAM, across=True).groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    found = candidates.select("page", "row").join(spans, "row", "left").select("page", "spans")

    plain = pages.mapInArrow(lambda batches: texts(batches, False), schema)
    # only pages with open blocks are moved to meet their intervals
    waiting = pages.withColumn("page", row_key("page_id", "url", "html")).join(found, "page")
    settled_pages = waiting.select("page_id", "url", "html", "spans").mapInArrow(lambda batches: texts(batches, True), schema)
    return plain.unionByName(settled_pages)
