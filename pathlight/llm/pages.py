"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its container start tags, told apart by their path, and its text blocks at their
path. A path is the 64-bit hash of its parent's path and its own label (element, class, id and role).
Tokens that occur equally often in each page of a host have one occurrence vector; a class groups
them. The vector is never collected: a token's signature is the sum over pages of a page hash times the
occurrences, an ordinary partial aggregation, and equal signatures (64 bits) are equal vectors. Classes of
two tokens and more that occur in half of the host's pages that aren't empty, and in two at least, are valid.
The paths of their tags nest them into the host's template; text blocks of as many pages are template text.
What is left between template tags are the slots. A tag's slots, its own and those nested below it, hold so
much text outside of links.

The main tag is the innermost one whose slots hold nearly all of the host's text; where an article or main element
holds most of it, that element goes before. The text of the main tag's slots in each page is the page's text, whether
or not some of it stands in other pages too. Of the slots nested in it those are left out whose tag is
another element (nav, aside, form) or a template tag that bears a whole name of something else (comments, ad), and
template tags of which all text is template text, unless that holds for all that the main tag has.

Hosts without a template of their own (of one page) share the template of all pages. Templates are joined to
pages by host: broadcast if their checked size allows, else by a shuffle that adaptive execution splits for
large hosts. A host's template is a small row: its main path and the template tags to be left out.

Cases: null and empty html gives an empty text; a null url is a host of its own; pages of any length are
taken whole; markup is scanned once, also where tags, quotes or comments are never closed (an unclosed comment or
script goes to the page's end, an unclosed tag is text) and however deep tags are nested; a page without the
template's main tag is read from its article, its main or its body; repeated rows each get their text; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .lineage import cut

#: Share of the host's pages that a template's token is in; pages that it is in at least.
MIN_SHARE, SUPPORT = 0.5, 2
#: Share of the host's text that is most of it, and nearly all.
MOST, NEARLY_ALL = 0.6, 0.9
#: Bytes up to which templates are broadcast.
BROADCAST_BYTES = 32 << 20
ALL_HOSTS = "*"

_START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[\"'>]")
#: Elements whose content is no text of the page, with what ends them.
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea svg iframe title".split()}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that stay in the line of text around them.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr input link meta source track".split())
#: Elements that end a block and aren't containers.
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dd dt figcaption caption tr td th option".split())
CONTENT = frozenset("html body main article".split())
NOT_CONTENT = frozenset("nav header footer aside form head button select dialog menu object audio video canvas map".split())
NOT_CONTENT_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies discussion disqus "
    "breadcrumb breadcrumbs pagination pager widget search form toolbar copyright hidden".split()
)


class Page:
    """Containers and text blocks of a page, in page order; container 0 is the page itself.

    ``parents``, ``paths``, ``elements``, ``outside`` (it or one around it is a non-content element) and ``named``
    (its own names say that it is something else) are by container. Blocks are (container, text, characters of links).
    """

    def __init__(self, page: str | None) -> None:
        self.parents, self.paths, self.elements, self.outside, self.named = [0], [0], [""], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(page or "")

    def _open(self, parent: int, name: str, attributes: str) -> int:
        found = " ".join(next(filter(None, m.groups()), "") for m in _NAMES.finditer(attributes)) if "=" in attributes else ""
        names = sorted({re.sub(r"\d+", "0", w.lower()) for w in re.split(r"[\s/]+", found) if w})
        self.parents.append(parent)
        self.paths.append(xxhash.xxh3_64_intdigest(".".join([name, *names]), self.paths[parent] & 0x7FFFFFFFFFFFFFFF) - (1 << 63))
        self.elements.append("main" if name not in CONTENT and "main" in names and re.search(r"\brole\s*=", attributes, re.I) else name)
        self.outside.append(self.outside[parent] or name in NOT_CONTENT)
        # Names of the page and of its content say what else it has ("has-sidebar").
        self.named.append(name not in CONTENT and not NOT_CONTENT_NAMES.isdisjoint(names))
        return len(self.paths) - 1

    def _parse(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # (element, container)
        opened: dict[str, int] = {}
        parts: list[str] = []
        linked, in_link, here = 0, False, 0

        def end() -> None:
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((here, text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def pop(to: int) -> None:
            for name, _ in stack[to:]:
                opened[name] -= 1
            del stack[to:]

        for text, closing, name, attributes in _pieces(page):
            if text:
                parts.append(text)
                if in_link:
                    linked += len(text)
            if name in INLINE:
                if name == "a":
                    in_link = not closing
            elif name == "br":  # a line of its block, which is judged as a whole
                parts.append(" ")
            elif name in _RAW:
                if name == "title":
                    end()
            elif name:
                end()
                if name in VOID or name in BREAKS:
                    continue
                if closing:
                    if opened.get(name):
                        k = len(stack) - 1
                        while stack[k][0] != name:
                            k -= 1
                        pop(k)
                else:
                    if name == "li" and stack and stack[-1][0] == "li":
                        pop(len(stack) - 1)
                    if attributes.endswith("/"):
                        continue
                    stack.append((name, self._open(stack[-1][1] if stack else 0, name, attributes)))
                    opened[name] = opened.get(name, 0) + 1
                here = stack[-1][1] if stack else 0
        end()


def _pieces(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before a tag, whether it is an end tag, element, attributes) in one pass; the element is empty where there is
    only text."""
    at = scanned = 0
    quotes = True  # a tag ends at the first > outside of quotes
    while True:
        open_at = page.find("<", scanned)
        if open_at < 0:
            yield page[at:], False, "", ""
            return
        if page.startswith("<!--", open_at):
            yield page[at:open_at], False, "", ""
            close = page.find("-->", open_at + 4)
            at = scanned = len(page) if close < 0 else close + 3
            continue
        tag = _START.match(page, open_at)
        if tag is None and page[open_at + 1 : open_at + 2] not in ("!", "?"):
            scanned = open_at + 1  # a sign in the text
            continue
        close = _tag_end(page, tag.end()) if tag and quotes else page.find(">", open_at)
        if close < 0 and tag and quotes:  # no tag from here to the page's end is closed outside of quotes
            quotes, close = False, page.find(">", open_at)
        if close < 0:
            yield page[at:], False, "", ""
            return
        if tag is None:
            yield page[at:open_at], False, "", ""
            at = scanned = close + 1
            continue
        name = tag[2].lower()
        yield page[at:open_at], bool(tag[1]), name, page[tag.end() : close]
        at = scanned = close + 1
        if name in _RAW and not tag[1]:
            finish = _RAW[name].search(page, at)
            at = scanned = finish.end() if finish else len(page)


def _tag_end(page: str, at: int) -> int:
    """The first > from ``at`` that is in no quotes, or -1."""
    while (m := _STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def tokens(pages: DataFrame) -> DataFrame:
    """(host, path, block, parent, outside, named, element, depth, low, high, n_pages, n, chars, nested): tokens of hosts.

    ``block`` is null for tags; ``low`` and ``high`` are the halves of the signature; ``chars`` is the text outside of
    links in the token itself, ``nested`` also that of the slots below a tag. Every tag is also counted for the host of all pages.
    """

    @W.released
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page, mark = Page(source), xxhash.xxh3_64_intdigest(source or "")
                if len(page.paths) == 1 and not page.blocks:
                    continue  # empty pages have no part in templates
                chars, n = [0] * len(page.paths), len(page.paths)
                own: dict[tuple, list] = {}
                for k, text, linked in page.blocks:
                    chars[k] += len(text) - linked
                    held = own.setdefault((page.paths[k], _text_id(text)), [(0, page.outside[k], False, "", 0), 0, 0, 0])
                    held[1] += 1
                    held[2] += len(text) - linked
                nested, depth = [0 if page.outside[k] else chars[k] for k in range(n)], [0] * n
                for k in range(1, n):
                    depth[k] = depth[page.parents[k]] + 1
                for k in range(n - 1, 0, -1):
                    nested[page.parents[k]] += nested[k]
                for k in range(n):
                    held = own.setdefault((page.paths[k], None), [(page.paths[page.parents[k]], page.outside[k], page.named[k], page.elements[k], depth[k]), 0, 0, 0])
                    held[1] += 1
                    held[2] += chars[k]
                    held[3] += nested[k]
                for (path, block), (kind, times, own_chars, all_chars) in own.items():
                    for h in (host, ALL_HOSTS) if block is None else (host,):
                        held = sums.setdefault((h, path, block, *kind), [0, 0, 0, 0, 0, 0])
                        # 32 bits of each half here, so that Spark's sums can't overflow.
                        held[0] = held[0] + mark * times & 0xFFFFFFFF
                        held[1] = held[1] + (mark >> 32) * times & 0xFFFFFFFF
                        for i, x in enumerate((1, times, own_chars, all_chars), 2):
                            held[i] += x
            keys = list(sums)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int32())
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
            columns += [pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_TOKEN, *_SUMS])

    kinds = "host string, path bigint, block bigint, parent bigint, outside boolean, named boolean, element string, depth int, " + ", ".join(f"{c} bigint" for c in _SUMS)
    rows = pages.select(_host().alias("host"), "html").mapInArrow(run, kinds)
    found = rows.groupBy(*_TOKEN).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return found.withColumn("low", F.col("low") % (1 << 32)).withColumn("high", F.col("high") % (1 << 32))


_TOKEN = ("host", "path", "block", "parent", "outside", "named", "element", "depth")
_SUMS = ("low", "high", "n_pages", "n", "chars", "nested")


def _text_id(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def template_tokens(pages: DataFrame) -> DataFrame:
    """The tokens that occur in two pages or are tags, with ``often`` and ``in_template``: a tag in a valid class, or template text."""
    # Text of a single page is in no class; most of it goes here, before anything is grouped by host.
    found = cut(tokens(pages).where((F.col("n_pages") >= SUPPORT) | F.col("block").isNull()))
    size = found.where("path = 0 and block is null").select("host", F.col("n_pages").alias("host_pages"))
    found = found.join(size, "host")
    often = (F.col("n_pages") >= MIN_SHARE * F.col("host_pages")) & (F.col("n_pages") >= SUPPORT)
    in_class = Window.partitionBy("host", "low", "high", "n_pages")
    found = found.withColumn("members", F.count(F.lit(1)).over(in_class))
    return found.withColumn("often", often).withColumn("in_template", often & ((F.col("members") > 1) | F.col("block").isNotNull()))


def templates(pages: DataFrame) -> DataFrame:
    """(host, main bigint, left_out array<bigint>) of hosts with a template, and of all hosts."""
    found = cut(template_tokens(pages))
    # Text of a tag's own slot that is template text. What a template tag is nested in is as frequent as it.
    fixed = found.where("block is not null and in_template").groupBy("host", "path").agg(F.sum("chars").alias("fixed"))
    held = found.where("block is null and (often or path = 0)").join(fixed, ["host", "path"], "left")
    tags = F.collect_list(F.struct("path", "parent", "depth", "in_template", "outside", "named", "element", "chars", "nested", F.coalesce("fixed", F.lit(0).cast("bigint")).alias("fixed")))
    rows = held.groupBy("host").agg(tags.alias("tags"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            chosen = [choose(tags) for tags in batch.column("tags").to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column("host"), pa.array([c[0] for c in chosen], pa.int64()), pa.array([c[1] for c in chosen], pa.list_(pa.int64()))], names=["host", "main", "left_out"])
            yield out.filter(out.column("main").is_valid())

    return rows.mapInArrow(run, "host string, main bigint, left_out array<bigint>")


def choose(tags: list[dict]) -> tuple[int | None, list[int]]:
    """The main tag of a host's template, and the tags nested in it whose slots are left out."""
    tags = sorted(tags, key=lambda t: (t["depth"], t["path"]))
    whole = max(1, tags[0]["nested"])

    def rank(t: dict) -> tuple:
        most = t["nested"] >= MOST * whole
        element = {"article": 2, "main": 1}.get(t["element"], 0)
        return most, element if most else 0, t["nested"] >= NEARLY_ALL * whole, t["depth"] if most else 0, t["nested"], t["path"]

    main = max((t for t in tags if t["depth"] and t["in_template"] and not t["outside"] and t["nested"]), key=rank, default=None)
    if main is None:
        return None, []
    within, left = {main["path"]}, main["chars"] - min(main["fixed"], main["chars"])
    named, fixed = [], []
    for t in tags:
        if t["parent"] not in within or t is main:
            continue
        within.add(t["path"])
        if t["in_template"] and t["named"]:
            named.append(t["path"])
        elif t["in_template"] and t["chars"] and t["nested"] == t["chars"] <= t["fixed"]:
            fixed.append(t["path"])
        else:
            left += t["chars"] - min(t["fixed"], t["chars"])
    # Where all text in frequent tags is template text, pages are copies of each other.
    return main["path"], named + (fixed if left else [])


def extract(pages: DataFrame) -> DataFrame:
    """Return (page_id, url, text) of every page."""
    pages = pages.select("page_id", "url", "html")
    spark = pages.sparkSession
    found = cut(templates(pages))
    default = found.where(F.col("host") == ALL_HOSTS).first()
    held = spark.sparkContext.broadcast((default["main"], frozenset(default["left_out"])) if default else (None, frozenset()))
    size = found.agg(F.sum(F.length("host") + 8 + 8 * F.size("left_out"))).first()[0] or 0
    met = pages.withColumn("host", _host()).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    @W.released
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for page, main, left_out in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "left_out"))):
                # Hosts without a template of their own have that of all pages.
                out.append(main_text(page, *(held.value if main is None else (main, frozenset(left_out)))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return met.select("page_id", "url", "html", "main", "left_out").mapInArrow(run, f"page_id {kind}, url string, text string")


def main_text(page: str | None, main: int | None, left_out: frozenset = frozenset()) -> str:
    """Text of the main tag's slots; of the article, the main element or the body where the page has no such tag."""
    page = Page(page)
    n = len(page.paths)
    wanted = [lambda k: page.paths[k] == main] + [lambda k, e=e: page.elements[k] == e for e in ("article", "main", "body")] + [lambda k: k == 0]
    # Text in other elements, and slots that are left out, are read only if there is no other.
    for strict in (True, False):
        for is_main in wanted:
            within = [False] * n  # in a slot that is taken
            for k in range(n):
                if k and within[page.parents[k]]:
                    within[k] = not (strict and (page.elements[k] in NOT_CONTENT or page.paths[k] in left_out))
                elif is_main(k):
                    within[k] = not (strict and page.outside[k])
            texts = [text for k, text, linked in page.blocks if within[k] and (strict or is_main is not wanted[-1] or linked < len(text))]
            if texts:
                return " ".join(texts)
    return ""


def page_report(pages: DataFrame) -> DataFrame:
    """Return (page_id, url, text, n_chars)."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))
