"""Main text of web pages by wrappers: union-free regular expressions inferred from all pages of the same host.

A page is read as a token stream of elements (tag and class words) and text. All pages of a host are aligned one after the other (in the order of a hash of
their id) with the wrapper so far: adjacent repeats become repeated groups, pieces that one side
lacks become optional groups, and differing texts become text slots. Each text position of the wrapper is then named by its chain of
elements; a position whose text is the same in all pages, while others differ, belongs to the template.

A host of more than ``TOGETHER`` pages is dealt into groups by a hash; each group gives a wrapper, and these are aligned in the same way. Once a wrapper stands for more than
``ALIKE`` pages it forgets the optional pieces that no template text can come from, so it is no longer than a page, whatever the host holds. Pages of any length take part:
above ``PAIRS`` pairs of equal chains the alignment is the longest common order of the n-th occurrences of each chain, which needs no time that grows with the square of a page.

A page is then read against its host's wrapper: text in the article (or, on hosts without one, in the body) is kept unless its chain
passes an element that holds menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments, or, outside an
article, the wrapper has it as template text. A word in an element's class or id hides it only while more of the article lies outside such elements
than in it, so a container or article called after what stands beside its text keeps the text; words like ``has-sidebar`` mark nothing. Pages of hosts or shapes that the wrapper has not seen are read by the same chains.

Blocks are what block-level elements delimit; white space inside a block becomes one space, blocks are joined by one line feed in page order.

Shuffled by host are the streams, a pair of 64-bit hashes for each piece of a page; template texts are told by their hashes. The join of pages with the wrappers of their hosts is left to Spark,
which broadcasts only below its size limit and splits a skewed host otherwise.

Defined results: a null or empty html gives an empty text; a url without a host, or none, shares one wrapper; unclosed elements end where HTML
ends them; repeated rows give repeated rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullwatch.llm.common import register, table

TOGETHER = 512
"""Pages that one group of a host aligns, about; a larger host has several groups."""
ALIKE = 12
"""Pages from which on a wrapper keeps only what template text can come from."""
PAIRS = 1 << 16
"""Pairs of equal chains above which two streams are aligned by the n-th occurrences of each chain."""

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
         "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "nav", "menu", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "canvas", "object", "dialog", "input", "label"}
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
MARKED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus",
          "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "notices", "pagination", "pager", "popup", "promo", "promoted", "promotion",
          "recommended", "related", "replies", "reply", "responses", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tagcloud", "toolbar", "topbar", "widget", "alert"}
LISTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "discussion", "disqus", "footer", "gdpr", "menu", "nav", "navbar",
         "navigation", "pagination", "pager", "recommended", "related", "replies", "reply", "responses", "sidebar", "tagcloud"}
"""Words of parts that may be longer than the main text beside them."""
LAYOUT = re.compile(r"^(?:has|have|with|without|no|not|is|hide|show|show[sn]|hidden)[-_]|^(?:has|with|without|no|hide|show)(?=[A-Z])")
"""Class words that tell what a page has beside them, not what the element is."""
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


def words_of(names: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())


@lru_cache(1 << 14)
def label(tag: str, attributes: str) -> str:
    """Element name with the words of its class, id and role, marked ``!`` if it holds no main text, ``?`` if only a word of its class or id says so."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = words_of(names)
    marked = MARKED & set(words_of(" ".join(n for n in names.split() if not LAYOUT.match(n))))
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    hidden = tag in HIDDEN or role in ROLES or found.get("aria-hidden") == "true" or re.search(r"\shidden(\s|=|$)", " " + attributes + " ") or "display:none" in style
    main = tag in ("article", "main") or role in ("main", "article")
    sign = "" if tag in ("body", "html") else "!" if hidden else "?" if marked else ""
    return ".".join([sign + tag, *sorted(set(words))]) + ("@" if main else "")


@lru_cache(1 << 14)
def name_of(element: str) -> str:
    return element.lstrip("!?").split(".")[0].rstrip("@")


def close_implied(stack: list[str], tag: str) -> None:
    """End the elements that a start tag ends: paragraphs before blocks, list items, cells and options before their like."""
    same = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}.get(tag)
    fence = {"li": {"ul", "ol", "menu"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}.get(tag, {"table"})
    if tag in BLOCK:
        for k in range(len(stack) - 1, -1, -1):
            if name_of(stack[k]) in BLOCK:
                if name_of(stack[k]) == "p":
                    del stack[k:]
                break
    if same:
        for k in range(len(stack) - 1, -1, -1):
            if name_of(stack[k]) in fence:
                break
            if name_of(stack[k]) in same:
                del stack[k:]
                break


def read_blocks(page: str):
    """(chain of elements, text) of every block with text, in page order."""
    stack: list[str] = []
    block: list[str] = []
    chain: tuple[str, ...] = ()
    at, size = 0, len(page)

    def flush():
        text = " ".join(entities.unescape("".join(block)).split())
        block.clear()
        return (chain, text) if text else None

    def say(text):
        nonlocal chain
        if text and not text.isspace() and not any(b and not b.isspace() for b in block):
            chain = tuple(e for e in stack if name_of(e) in BLOCK or e[0] in "!?")
        block.append(text)

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at:found.start()])
        at = max(found.end(), at + 1)
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "p" and "p" not in map(name_of, stack) or tag in BLOCK:
                if done := flush():
                    yield done
            names = [name_of(e) for e in stack]
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                if tag in BLOCK or not any(n in BLOCK for n in names[k + 1:]):
                    if any(e[0] in "!?" for e in stack[k:]) and (done := flush()):
                        yield done
                    del stack[k:]
            continue
        if tag in BLOCK:
            if done := flush():
                yield done
            close_implied(stack, tag)
        element = label(tag, found[3] or "")
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag == "br":
            block.append(" ")
        elif tag not in VOID and not (found[3] or "").rstrip().endswith("/"):
            if element[0] in "!?" and (done := flush()):
                yield done
            stack.append(element)
    if done := flush():
        yield done


def stream(page: str) -> list[list]:
    """Items ``[chain, text or None, optional, repeated]`` of a page for the alignment: adjacent blocks of the same chain are a repeated group with one slot."""
    items: list[list] = []
    for chain, text in read_blocks(page):
        key = "/".join(chain)
        if items and items[-1][0] == key:
            items[-1] = [key, None, False, True]
        else:
            items.append([key, text, False, False])
    return items


def matches(left: list, right: list) -> list[tuple[int, int]]:
    """Places of equal chains that the alignment puts together, in order."""
    if left == right:
        return [(k, k) for k in range(len(left))]
    times = Counter(left)
    if sum(times[c] for c in right) <= PAIRS:
        return [(a + k, b + k) for a, b, size in SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks() for k in range(size)]

    def numbered(chains: list) -> list[tuple]:
        seen = Counter()
        return [(c, seen.update((c,)) or seen[c]) for c in chains]

    place = {c: k for k, c in enumerate(numbered(left))}
    both = [(place[c], k) for k, c in enumerate(numbered(right)) if c in place]
    # longest increasing order: the last places of the best orders of each length, and what stands before each
    ends: list[int] = []
    held: list[int] = []
    before: list[int] = []
    for k, (a, _) in enumerate(both):
        n = bisect_left(ends, a)
        ends[n:n + 1], held[n:n + 1] = [a], [k]
        before.append(held[n - 1] if n else -1)
    out, k = [], held[-1] if held else -1
    while k >= 0:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def align(wrapper: list[list], other: list[list]) -> list[list]:
    """Wrapper items generalised so that they also match what the items of ``other``, a page or a wrapper, match."""
    out: list[list] = []
    i = j = 0
    for a, b in [*matches([w[0] for w in wrapper], [w[0] for w in other]), (len(wrapper), len(other))]:
        out += [[chain, text, True, repeated] for chain, text, _, repeated in wrapper[i:a] + other[j:b]]
        for v, w in zip(wrapper[a:a + 1], other[b:b + 1], strict=True):
            repeated = v[3] or w[3]
            out.append([v[0], v[1] if v[1] == w[1] and not repeated else None, v[2] or w[2], repeated])
        i, j = a + 1, b + 1
    folded: list[list] = []
    for w in out:
        if folded and folded[-1][0] == w[0]:
            folded[-1] = [w[0], None, folded[-1][2] and w[2], True]
        else:
            folded.append(w)
    return folded


def possible(wrapper: list[list]) -> list[list]:
    """A wrapper without optional items of chains that hold no template text, now or after any further page; one stays between items that would fold without it."""
    several = {chain for chain, text, _, _ in wrapper if text is None}
    fixed = {chain for chain, _, optional, _ in wrapper if not optional and chain not in several}
    out: list[list] = []
    gap = None
    for chain, text, optional, repeated in wrapper:
        if optional and chain not in fixed:
            gap = gap or [chain, text, optional, repeated]
            continue
        if gap and out and out[-1][0] == chain:
            out.append(gap)
        out.append([chain, None if chain in several else text, optional, repeated])
        gap = None
    return out


class Wrapper:
    """The wrapper of ``n`` pages; ``varies``: some position holds several texts."""

    def __init__(self):
        self.n, self.varies, self.items = 0, False, []

    def add(self, n: int, varies: bool, items: list[list]) -> None:
        self.items = align(self.items, items) if self.n else items
        self.n += n
        self.varies = self.varies or varies or any(w[1] is None for w in self.items)
        if self.n > ALIKE:
            self.items = possible(self.items)

    def template(self) -> dict:
        """Template texts of a host: chains whose text is the same on all of at least three aligned pages, while some chain varies."""
        if self.n < 3 or not self.varies:
            return {}
        fixed = {w[0]: w[1] for w in self.items if w[1] is not None and not w[2] and not w[3]}
        several = {w[0] for w in self.items if w[1] is None}
        return {c: t for c, t in fixed.items() if c not in several}


def infer(pages: list[str]) -> dict[str, str]:
    """Template of a host with these pages."""
    wrapper = Wrapper()
    for page in pages:
        wrapper.add(1, False, stream(page))
    return wrapper.template()


def hiding(blocks: list[tuple[tuple[str, ...], str]]) -> set[str]:
    """Elements marked by a word alone that do hide: not those around more of the article (on pages without one, of the page) than lies outside all of them."""
    active = {e for chain, _ in blocks for e in chain if e[0] == "?"}
    scope = [b for b in blocks if any(e.endswith("@") for e in b[0])] or blocks
    while active:
        clear = sum(len(text) for chain, text in scope if active.isdisjoint(chain))
        anywhere = any(active.isdisjoint(chain) for chain, _ in blocks)
        held: dict[str, list[int]] = {}
        for chain, text in scope:
            for depth, e in enumerate(chain):
                if e in active and e not in chain[:depth]:
                    size = held.setdefault(e, [0, -depth])
                    size[0] += len(text)
        found = [e for e, (size, _) in held.items() if size > clear and not (anywhere and LISTS & set(e.rstrip("@").split(".")[1:]))]
        if not found:
            break
        active.discard(max(found, key=held.__getitem__))
    return active


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(page: str | None, template: dict, told_by=lambda text: text) -> str:
    """Main text of a page; ``told_by`` makes of a chain or a text what the template has for it."""
    blocks = [(chain, text) for chain, text in read_blocks(page or "") if not any(e[0] == "!" for e in chain)]
    gone = hiding(blocks)
    kept = [(chain, text) for chain, text in blocks if gone.isdisjoint(chain)]
    # a header inside an article keeps its headings
    inside = [(chain, text) for chain, text in kept if any(e.endswith("@") for e in chain)
              and not ("header" in map(name_of, chain) and name_of(chain[-1]) not in ("h1", "h2", "h3", "h4", "h5", "h6"))]
    if not inside:
        inside = [(chain, text) for chain, text in kept if "header" not in map(name_of, chain) and not (template and template.get(told_by("/".join(chain))) == told_by(text))]
    return "\n".join(text for _, text in inside)


WRAPPER = "host string, part bigint, n bigint, varies boolean, chains array<bigint>, texts array<bigint>, signs array<tinyint>"


def wrappers(pages: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``host, template``: one row per host, from all of its pages. Chains and texts are told by their ``digest``."""
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        """Of ``(host, part, n, varies, items)``."""
        columns = [*zip(*(r[:4] for r in rows), strict=True)] or [()] * 4
        lists = [[[w[0] for w in r[4]] for r in rows], [[w[1] for w in r[4]] for r in rows], [[w[2] + 2 * w[3] for w in r[4]] for r in rows]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, *lists], kinds, strict=True)], names=["host", "part", "n", "varies", "chains", "texts", "signs"])

    def read(batches):
        for b in (b.slice(k, 500) for b in batches for k in range(0, len(b), 500)):
            rows = []
            for host, at, page in zip(b["host"], b["part"], b["html"], strict=True):
                items = [[digest(c), None if t is None else digest(t), *signs] for c, t, *signs in stream(page.as_py())]
                rows.append((host.as_py(), at.as_py(), 1, False, items))
            yield packed(rows)

    def fold(batches):
        """One wrapper of the adjacent rows of each host and part."""
        last, wrapper, ready = None, Wrapper(), []
        for b in (b.slice(k, 500) for b in batches for k in range(0, len(b), 500)):
            for host, part, n, varies, *lists in zip(*(b[c].to_pylist() for c in ("host", "part", "n", "varies", "chains", "texts", "signs")), strict=True):
                if last != (host, part):
                    if last is not None:
                        ready.append((*last, wrapper.n, wrapper.varies, wrapper.items))
                    last, wrapper = (host, part), Wrapper()
                wrapper.add(n, varies, [[c, t, bool(s & 1), s > 1] for c, t, s in zip(*lists, strict=True)])
            yield packed(ready)
            ready = []
        if last is not None:
            yield packed([(*last, wrapper.n, wrapper.varies, wrapper.items)])

    def told(batches):
        """Templates of the adjacent wrappers of each host."""
        for b in fold(batches):
            found = []
            for n, varies, *lists in zip(*(b[c].to_pylist() for c in ("n", "varies", "chains", "texts", "signs")), strict=True):
                wrapper = Wrapper()
                wrapper.add(n, varies, [[c, t, bool(s & 1), s > 1] for c, t, s in zip(*lists, strict=True)])
                found.append(json.dumps(wrapper.template()))
            yield pa.RecordBatch.from_arrays([b["host"], pa.array(found, pa.string())], names=["host", "template"])

    streams = pages.select("host", F.xxhash64("page_id").alias("part"), "html").mapInArrow(read, WRAPPER).withColumnRenamed("part", "at")
    large = pages.groupBy("host").count().where(F.col("count") > together).select("host", F.ceil(F.col("count") / together).alias("parts"))
    # at most one row for every `together` pages
    part = F.coalesce(F.pmod(F.xxhash64("at", "chains", "texts"), F.col("parts")), F.lit(0)).cast("bigint")
    dealt = streams.join(F.broadcast(large), "host", "left").withColumn("part", part).repartition("host", "part")
    names = [c.split()[0] for c in WRAPPER.split(", ")]
    groups = dealt.sortWithinPartitions("host", "part", "at", "chains", "texts").select(names).mapInArrow(fold, WRAPPER)
    whole = groups.repartition("host").sortWithinPartitions("host", "part").withColumn("part", F.lit(0).cast("bigint"))
    return whole.select(names).mapInArrow(told, "host string, template string")


def main_text(pages: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``page_id, url, text`` of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    joined = rows.join(wrappers(rows, together), "host", "left").select("page_id", "url", "html", "template")
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches):
        known = ("", {})
        for b in (b.slice(k, 500) for b in batches for k in range(0, len(b), 500)):
            texts = []
            for page, template in zip(b["html"], b["template"], strict=True):
                if template.as_py() != known[0]:
                    known = (template.as_py(), {int(c): t for c, t in json.loads(template.as_py() or "{}").items()})
                texts.append(extract(page.as_py(), known[1], digest))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(read, f"page_id {kind}, url string, text string")


@register("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
