"""Main text of web pages: markup names the article, host suffix arrays judge what markup leaves open.

A page is read into blocks of visible text.  Where the page marks its article
(``article``, ``main`` or the role), the blocks inside it, less menus, forms,
adverts, comments and the like, are the text.  The rest of every page is its
host's template stream: the streams of a host are searched with suffix arrays
for long strings that distinct pages share.  On a page that marks no article,
what such strings cover is boilerplate, and the uncovered words of its
unmarked blocks, the unique runs, are the text.

The method by itself cannot give an article: a passage that two pages of a host
both carry in their articles is repeated too, and a host with one page repeats
nothing.  So article markup is final, and repetition decides only without it.

A null or empty page has empty text.  A page that breaks off inside a tag, a
comment, a script, a style, a title or a text area ends there; any other element
that is left open hides nothing.  Repeated rows are pages of their own, but are one page to
the template search, so that they do not make each other boilerplate.
"""

from __future__ import annotations

import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LAST_ID, by_bytes, fold_of, small_batches, staged
from .hosts import host_of
from .suffixes import repeated_spans

# Fixed values of HTML: elements without text of the page, blocks, and elements or words that name a page's furniture.
RAW = frozenset("script style textarea title iframe noembed noframes".split())  # hold no tags, end only at their end tag
LOOSE = frozenset("iframe noembed noframes".split())  # hide nothing if they are never closed
HIDDEN = frozenset("template noscript object svg math canvas video audio select".split())  # hide what they hold up to their end tag
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset datalist output search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog status tablist".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos promotion
    sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments
    commentlist disqus respond reply replies widget widgets toolbar pagination pager login banner skip""".split())
REMARKS = frozenset("comment comments commentlist disqus respond reply replies".split())
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=<>`]++)"
_SCAN = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s/>=\"'<]++(?:\s*+=\s*+{_VALUE})?+)*+\s*+)(/?)>")  # well-formed tags; others are read by _attributes
_HEAD = re.compile(r"</?([^\s/>]*+)")
_NAME = re.compile(r"([\s/]*+)(=?[^\s/>=]*+)\s*+(=\s*+([\"']?))?+")
_BARE = re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
MAIN, OPEN, OTHER = 0, 1, 2  # of the article, not said, furniture


def _names(attrs: dict[str, str]) -> set[str]:
    """Words of the class and id: ``sideBar ad-box`` gives side, bar, sidebar, ad, box; ``has-sidebar`` only says what is near."""
    out: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        if not re.match(r"(?:has|with|no|without)[-_A-Z]", name):
            out.update(_SPLIT.split(name.lower()), _SPLIT.split(_CAMEL.sub("-", name).lower()))
    return out


def _is_furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in FURNITURE or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return (tag == "header" and not in_article) or (tag not in ("html", "body", "main") and bool(_names(attrs) & WORDS))


def _attributes(page: str, at: int, dead: set[int]) -> tuple[dict[str, str], bool, int] | None:
    """Attributes, whether the tag closes itself, and the place after its ``>``; None if the page ends first.

    ``dead`` holds the quotes from which the page's end was reached, so that no part of a page is read again and again.
    """
    attrs: dict[str, str] = {}
    quotes: list[int] = []
    while True:
        m = _NAME.match(page, at)
        at, name = m.end(), m[2].lower()
        if m[3] is None:
            if page.startswith(">", at):
                if name:
                    attrs[name] = ""
                return attrs, not name and "/" in m[1], at + 1
            if at == len(page):
                break
            attrs[name] = ""
        elif m[4]:
            quotes.append(at)
            close = -1 if at in dead else page.find(m[4], at)
            if close < 0:
                break
            attrs[name] = page[at:close]
            at = close + 1
        else:
            value = _BARE.match(page, at)
            attrs[name], at = value[0], value.end()
    dead.update(quotes)
    return None


def _tags(page: str) -> tuple[list, dict[int, int]]:
    """Pieces of text and tags (slash, tag, attributes, closes itself) in order; for each element of HIDDEN that is closed, where its end tag is.

    Raw text and comments are left out.  An element left open ends with its parent.
    """
    out: list = []
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    dead: set[int] = set()
    endless: set[str] = set()  # tags of raw elements that have no end tag from here on
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            out.append(page[at:])
            break
        out.append(page[at:lt])
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            close = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            if close < 0:
                break
            at = close + (3 if page.startswith("<!--", lt) else 1)
            continue
        if not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and page[lt + 2:lt + 3].isalpha()):
            out.append("<")
            at = lt + 1
            continue
        m = _SCAN.match(page, lt)
        if m:
            slash, tag, rest, empty = m[1], m[2].lower(), m[3], bool(m[4])
            at = m.end()
        else:
            head = _HEAD.match(page, lt)
            slash, tag = ("/" if nxt == "/" else ""), head[1].lower()
            found = _attributes(page, head.end(), dead)
            if found:
                rest, empty, at = found
            else:  # an unclosed quote, or the page breaks off
                close = page.find(">", lt)
                if close < 0:
                    break
                rest, empty, at = "", False, close + 1
        foreign = tag in ("svg", "math") or count.get("svg") or count.get("math")
        if tag in RAW:
            if slash or empty and (foreign or tag in LOOSE):
                continue
            stop = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            if stop is None:
                if tag not in LOOSE:
                    break
                endless.add(tag)
                continue
            at = page.find(">", stop.end())
            at = end if at < 0 else at + 1
            continue
        if slash:
            if count.get(tag):
                last = ""
                while last != tag:
                    last, start = open_.pop()
                    count[last] -= 1
                if tag in HIDDEN:
                    ends[start] = len(out)
        elif tag not in VOID and not (empty and foreign):
            open_.append((tag, len(out)))
            count[tag] = count.get(tag, 0) + 1
        out.append((slash, tag, rest, empty))
    return out, ends


def read_blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order, white space folded, empty blocks left out."""
    blocks: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that matter: (tag, "article" | "other" | "remarks" | "header" | "heading")
    kinds = {"article": 0, "other": 0, "remarks": 0, "header": 0, "heading": 0}
    depth: dict[str, int] = {}  # elements of a tag open inside the innermost entry of ``stack`` with that tag
    has_article = False

    def flush():
        body = " ".join(htmllib.unescape("".join(text)).split())
        text.clear()
        if body:
            bad = kinds["other"] or kinds["remarks"] or (kinds["header"] and not kinds["heading"])
            blocks.append((OTHER if bad else MAIN if kinds["article"] else OPEN, body))

    pieces, ends = _tags(page)
    at = 0
    while at < len(pieces):
        piece = pieces[at]
        at += 1
        if isinstance(piece, str):
            text.append(piece)
            continue
        slash, tag, rest, empty = piece
        if tag in HIDDEN:  # one that is left open hides nothing
            at = ends.get(at - 1, at - 1) + 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in ("td", "th"):
            text.append(" ")
        if tag in BLOCKS:
            flush()
        if slash:
            if depth.get(tag):
                depth[tag] -= 1
            elif any(t == tag for t, _ in stack):
                while stack:  # an element left open inside ends with it
                    t, kind = stack.pop()
                    kinds[kind] -= 1
                    if t == tag:
                        break
                depth = {}
            continue
        if tag in VOID or empty and tag not in BLOCKS:
            continue
        attrs = rest if isinstance(rest, dict) else {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(rest)} if rest.strip() else {}
        inside = kinds["article"] > 0
        kind = None
        if tag in ("article", "main") or attrs.get("role", "").lower() == "main":
            if _names(attrs) & REMARKS or kinds["remarks"]:
                kind = "remarks"
            elif _is_furniture(tag, attrs, inside):
                kind = "other"
            else:
                if not inside:  # furniture that was never closed ends where the article starts
                    for name in ("other", "header", "heading"):
                        kinds[name] = 0
                    stack = [x for x in stack if x[1] in ("article", "remarks")]
                kind, has_article = "article", has_article or tag == "article" or "main" in (tag, attrs.get("role", "").lower())
        elif _is_furniture(tag, attrs, inside):
            kind = "remarks" if _names(attrs) & REMARKS else "other"
        elif tag == "header" and inside:
            kind = "header"
        elif tag in HEADINGS and kinds["header"]:
            kind = "heading"
        if kind:
            stack.append((tag, kind))
            kinds[kind] += 1
            depth = {}
        elif any(t == tag for t, _ in stack):
            depth[tag] = depth.get(tag, 0) + 1
    flush()
    return blocks if has_article else [(OPEN if k == MAIN else k, t) for k, t in blocks]


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    ident, url, body = F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    return pages.select(F.coalesce(ident, F.lit(LAST_ID)).alias("ord"), fold_of(url, body).alias("fold"), F.xxhash64(host_of(url)).alias("scope"),
                        ident.alias("page_id"), url.alias("url"), body.alias("html"))


def _streams(batches):
    """What is outside the marked article of each page, blocks joined by line ends."""
    for part in by_bytes(batches, "html"):
        texts = ["\n".join(t for k, t in read_blocks(p or "") if k != MAIN) for p in part.column("html").to_pylist()]
        yield pa.record_batch([part.column("ord"), part.column("fold"), part.column("scope"), pa.array(texts, pa.string())],
                              names=["ord", "fold", "scope", "text"])


def _marked(batches):
    """Text of the pages that mark their article; the others are passed over."""
    for part in by_bytes(batches, "html"):
        out, keep = [], []
        for p in part.column("html").to_pylist():
            blocks = read_blocks(p or "")
            keep.append(not blocks or any(k == MAIN for k, _ in blocks) or all(k == OTHER for k, _ in blocks))
            out.append("\n".join(t for k, t in blocks if k == MAIN))
        yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                              names=["page_id", "url", "text", "n_chars"]).filter(pa.array(keep, pa.bool_()))


def _unmarked(batches):
    """Blocks of the pages that have open blocks and mark no article."""
    for part in by_bytes(batches, "html"):
        kept = []
        for i, p in enumerate(part.column("html").to_pylist()):
            blocks = read_blocks(p or "")
            if any(k == OPEN for k, _ in blocks) and not any(k == MAIN for k, _ in blocks):
                kept.append((i, [{"kind": k, "body": t} for k, t in blocks]))
        at = pa.array([i for i, _ in kept], pa.int64())
        yield pa.record_batch([*(part.column(c).take(at) for c in ("ord", "fold", "page_id", "url")),
                               pa.array([b for _, b in kept], pa.list_(pa.struct([("kind", pa.int32()), ("body", pa.string())])))],
                              names=["ord", "fold", "page_id", "url", "blocks"])


def unique_runs(blocks: list[tuple[int, str]], spans: list[int]) -> list[str]:
    """The open blocks without the words that the stream's spans (byte ranges) cover entirely."""
    pairs, out, at, p = sorted(zip(spans[::2], spans[1::2])), [], 0, 0
    merged: list[list[int]] = []
    for s, e in pairs:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for kind, body in blocks:
        words = []
        for w in body.split(" "):
            size = len(w.encode())
            while p < len(merged) and merged[p][1] <= at:
                p += 1
            if not (p < len(merged) and merged[p][0] <= at and at + size <= merged[p][1]):
                words.append(w)
            at += size + 1
        if kind == OPEN and words:
            out.append(" ".join(words))
    return out


def _open_text(batches):
    for part in batches:
        out = ["\n".join(unique_runs([(b["kind"], b["body"]) for b in blocks], spans or []))
               for blocks, spans in zip(part.column("blocks").to_pylist(), part.column("spans").to_pylist())]
        yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                              names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, width: int = 64, gram: int = 16, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.  ``width``: bytes from which on a string shared by pages of a host is boilerplate."""
    small_batches(pages.sparkSession, 256)
    rows = _pages(pages, id_col, url_col, html_col)
    schema = "page_id long, url string, text string, n_chars long"
    streams = staged(rows.select("ord", "fold", "scope", "html").mapInArrow(_streams, "ord long, fold long, scope long, text string"), "pages-streams")
    spans = repeated_spans(streams, width, gram, scoped=True)
    found = rows.select("ord", "fold", "page_id", "url", "html").mapInArrow(
        _unmarked, "ord long, fold long, page_id long, url string, blocks array<struct<kind: int, body: string>>")
    judged = found.join(spans, ["ord", "fold"], "left").select("page_id", "url", "blocks", "spans").mapInArrow(_open_text, schema)
    return rows.select("page_id", "url", "html").mapInArrow(_marked, schema).union(judged)
