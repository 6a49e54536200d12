"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is the path of elements (name, class, id) from the root. For every
node that LEAST_PAGES pages have, two entropies are taken, with the logarithm to the base of its m pages, and two sizes:

    presentation   -sum p log_m p over the forms in which its children come: 0 where every page has the same form
    content        1 - mean of log_m k over its texts by size, each on k pages: 0 where every page has the same texts
    share          of the text of the pages that have it
    instances      elements a page

The trunk of a tree are the containers, one a page, that hold most of the text; where it ends (an article or main element
at the latest) the main part begins. A node's importance joins presentation and content; outside of the main part, content
counts in proportion to the share, up to SMALL: a box of a fixed form with little text is no part of the main text however
often its text changes. Containers of low importance go from each page, inside and outside of the main part. Plain blocks
(headings, paragraphs, list items, ... without a class) go with their container; the trunk never goes, nor do html, body,
article and main. A host may hold little but copies of one article: a page of whose main part (of all of it, if its host's
tree has no main part) entropies would leave less than LEAST_LEFT keeps that whole.

Element and class names are a prior beside this, as a host with few pages has too little to tell by. Elements that say what
they are (nav, footer, aside, ...) go; so do those with a class or id all of whose parts say so ("ad", "comment-list", but
not "share-prices" or "no-sidebar"), unless they hold the largest article or main element of the page. If that holds half
or more of what is left, it is the main text by itself.

Spark counts (host, node, form or text) with partial sums before the shuffle, so a host with a third of all pages is
spread over tasks; a host's low nodes are one short row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Pages that a node needs to be judged, the least importance that stays, the weight of content, and the share of a page's
#: text from which on a node outside of the main part counts in full.
LEAST_PAGES, LEAST_IMPORTANCE, CONTENT, SMALL = 8, 0.25, 0.9, 0.2
#: The share of the text that a node of the trunk holds, and its instances a page at most.
TRUNK, ONCE = 0.7, 1.2
#: If entropies leave less than this share of a page's main part, it isn't judged by them.
LEAST_LEFT = 0.4
#: An article in a box with a noise name has to be so much larger to be the main one.
BOXED = 4
#: Elements nested deeper share the node of their ancestor at this depth; their text stays. Of longer names a path has the
#: beginning and a hash.
DEEPEST, LONGEST_NAME = 40, 80

#: The start of a comment or tag, with the whole tag where its quotes hold neither "<" nor ">".
START = re.compile(r"""<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']+|"[^"<>]*"|'[^'<>]*')*+)(>)?|(!--)|[!?/])""")
#: The rest of a tag; a tag with a quote that isn't closed ends at the first ">".
QUOTED = re.compile(r"""(?:(?>[^>"']+)|"[^"]*"|'[^']*')*+>""")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements whose content is no markup, and those that go with all they hold: their end is that of an element like others.
RAW, WHOLE = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}, {"object", "svg", "select", "button", "canvas", "video", "audio"}
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
WHOLE_TAG = {name: re.compile(f"<(/?){name}(?=[\\s/>])[^>]*>", re.I) for name in WHOLE}
ANY_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Without a class they go with their container.
PLAIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "thead", "tbody", "tr", "td", "th", "figcaption"}
NEVER_LOW = {"html", "body", "article", "main"}
#: An open element of the set ends where one of the names begins.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOUNDS = {"ul", "ol", "dl", "table", "article", "main", "div", "section", "body", "html"}
#: Elements that are noise wherever they are, and those that are unless they hold the main article; header: outside of one.
NOISE, MOSTLY_NOISE = {"head", "nav", "footer", "aside", "dialog", "menu"}, {"form", "fieldset"}
NOISE_NAMES = set("ad ads adv advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies dialog disqus disclaimer footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: What a name may say besides: which box it is, and where.
BOX_NAMES = set("area article bar block blog body bottom box button buttons col column container content entry first fixed global group holder inner item items last left links list main modal outer page panel post posts primary right row secondary section site slot sticky text thread top unit wrap wrapper zone".split())


@lru_cache(100_000)
def says_noise(token: str) -> bool:
    """Whether a class or id says that the element isn't main text: each of its parts is a noise name or a box, one a noise name."""
    parts = [p for p in re.split(r"[-_]+|(?<=\D)(?=\d)", token) if p and not p[0].isdigit()]
    return any(p in NOISE_NAMES for p in parts) and all(p in NOISE_NAMES or p in BOX_NAMES for p in parts)


class Wholes:
    """Where the elements of WHOLE on a page end."""

    def __init__(self, html: str):
        self.html, self.ends, self.broken = html, {}, -1

    def end(self, name: str, start: int, at: int) -> int:
        """The place after the element that the tag from ``start`` to ``at`` opens: after its end tag, or just ``at`` if it closes
        itself, has none, or one that comes after the end of an element around it. Linear over all tags of a page."""
        if self.html[at - 2 : at] == "/>":
            return at
        if name not in self.ends:
            found, open_ = {}, []
            for m in WHOLE_TAG[name].finditer(self.html):
                if not m[1] and not m[0].endswith("/>"):
                    open_.append(m.start())
                elif m[1] and open_:
                    found[open_.pop()] = m.span()
            self.ends[name] = found
        close, end = self.ends[name].get(start, (at, at))
        if start < self.broken < close:
            return at
        inside: dict[str, int] = {}
        for m in ANY_TAG.finditer(self.html, at, close):
            tag = m[2].lower()
            if tag in VOID or tag in INLINE:
                continue
            inside[tag] = inside.get(tag, 0) + (-1 if m[1] else 1)
            if inside[tag] < 0:  # ends what began before: so does it for all that opens up to here
                self.broken = m.start()
                return at
        return end


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Comments and tags: start, end, name in lower case ("" for what is none), whether it closes, attributes.

    An element of RAW or WHOLE is one tag with all it holds; a tag of WHOLE that holds nothing by its end is none. Each character
    is looked at a bounded number of times: a comment or raw element that isn't closed takes in the rest, and after one tag whose
    quotes don't match, quotes count for nothing.
    """
    at, quotes, search, wholes = 0, True, START.search, None
    while m := search(html, at):
        start, at = m.span()
        slash, name, attributes, whole, comment = m.groups()
        if comment:
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if not whole:
            end = QUOTED.match(html, m.end(2)) if quotes and name else None
            stop = end.end() if end else html.find(">", at if not name else m.end(2)) + 1
            if not stop:
                return  # no tag ends any more
            quotes = quotes and (end is not None or not name)
            attributes = html[m.end(2) : stop - 1] if name else ""
            at = stop
        name = name.lower() if name else ""
        if name in RAW and not slash:
            close = RAW_END[name].search(html, at)
            at = close and html.find(">", close.end()) + 1 or len(html)
        elif name in WHOLE:
            if not slash:
                wholes = wholes or Wholes(html)
                at = wholes.end(name, start, at)
            name = "" if slash or at == m.end() else name
        yield start, at, name, bool(slash), attributes


class Element:
    __slots__ = ("article", "box", "boxed", "children", "held", "low", "name", "noise", "noise_inside", "order", "outside", "path", "size")

    def __init__(self, name: str, path: str, parent: Element | None):
        self.name, self.path, self.children, self.size = name, path, [], 0
        #: Its place among the page's elements; the outermost box around, and the text that it holds.
        self.order, self.boxed, self.held = 0, parent.boxed if parent else None, 0
        #: The outermost article or main element around; whether it goes for sure; whether it goes unless it holds the main
        #: article, by a name outside of any article (box) or inside of one; whether it is low, beside the main part or else.
        self.article, self.noise, self.box, self.noise_inside, self.outside, self.low = (parent.article, parent.noise, parent.box, parent.noise_inside, parent.outside, parent.low) if parent else (None, False, False, False, False, False)


class Page:
    """One walk over a page's markup: blocks of text with their elements, and what each node of the tree has."""

    def __init__(self, html: str, low: frozenset[str] = frozenset(), stats: bool = False, page_boxes: frozenset[int] = frozenset()):
        self.html, self.low, self.stats, self.page_boxes, self.opened = html, low, stats, page_boxes, 0
        self.blocks: list[tuple[str, Element]] = []
        self.texts: dict[tuple[str, str], None] = {}
        self.forms: dict[str, list[str]] = {}
        self.stack = [Element("", "", None)]
        #: For each name of an open element, and for BOUNDS together, the places in the stack.
        self.places: dict[str, list[int]] = {"": []}
        self.text: list[str] = []
        at = 0
        for start, end, name, closes, attributes in tags(html):
            self.text.append(html[at:start])
            at = end
            if not name or name in INLINE and name != "wbr" or (name in RAW or name in WHOLE) and not closes:
                continue
            if name in VOID:
                self.text.append(" ")
            elif closes:
                if self.places.get(name):
                    self.flush()
                    self.pop_to(self.places[name][-1])
                else:
                    self.flush()
            else:
                self.open(name, attributes)
        self.text.append(html[at:])
        self.flush()
        self.pop_to(0)

    def open(self, name: str, attributes: str) -> None:
        self.flush()
        if name in ENDS:
            bound = self.places[""][-1] if self.places[""] else 0
            place = max((self.places[n][-1] for n in ENDS[name] if self.places.get(n)), default=0)
            if place > bound:
                self.pop_to(place)
        parent = self.stack[-1]
        names = " ".join(v.strip("\"'") for _, v in NAMED.findall(attributes)).lower() if attributes else ""
        if not parent.children or parent.children[-1] != name:
            parent.children.append(name)
        path = parent.path
        if len(self.stack) <= DEEPEST:
            short = names if len(names) <= LONGEST_NAME else f"{names[:LONGEST_NAME]}~{crc32(names.encode()):08x}"
            path = f"{path}/{name}.{short.replace('/', '|')}" if names else f"{path}/{name}"
        e = Element(name, path, parent)
        self.opened += 1
        e.order = self.opened
        inside = e.article is not None
        if name in ("article", "main") or "main" in names.split():
            e.article = e.article or e
        e.noise = e.noise or name in NOISE or (name == "header" and not inside)
        said = name in MOSTLY_NOISE or name not in NEVER_LOW and any(says_noise(t) and not (inside and t == "header") for t in names.split())
        if inside:
            e.noise_inside = e.noise_inside or said
        elif said and e.order not in self.page_boxes:
            e.box, e.boxed = True, e.boxed or e
        if self.low and name not in NEVER_LOW and (names or name not in PLAIN):
            e.outside = e.outside or "!" + path in self.low
            e.low = e.low or path in self.low
        for n in (name, "") if name in BOUNDS else (name,):
            self.places.setdefault(n, []).append(len(self.stack))
        self.stack.append(e)

    def pop_to(self, place: int) -> None:
        """Closes the elements from ``place`` of the stack on; the root (place 0) is only counted."""
        while len(self.stack) > place:
            e = self.stack.pop()
            if e.name:
                self.places[e.name].pop()
                if e.name in BOUNDS:
                    self.places[""].pop()
            if self.stats:
                self.forms.setdefault(e.path, []).append(" ".join(e.children))

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.text)).split())
        self.text = []
        if text:
            if self.stats:
                for e in self.stack[: DEEPEST + 1]:
                    self.texts.setdefault((e.path, text))
            e = self.stack[-1]
            self.blocks.append((text, e))
            if e.boxed is not None and not e.noise:
                e.boxed.held += len(text)
            if e.article and not e.noise and not e.noise_inside:
                e.article.size += len(text)

    def main_text(self) -> str:
        if not any(e.article for _, e in self.blocks):
            # a box that holds most text of a page without an article is the page
            box = max((e.boxed for _, e in self.blocks if e.boxed and not e.noise), key=lambda b: b.held, default=None)
            if box and box.held >= TRUNK * _size([(t, e) for t, e in self.blocks if not e.noise]):
                return Page(self.html, self.low, page_boxes=self.page_boxes | {box.order}).main_text()
        # an article in a box with a noise name is more often a comment or a teaser
        largest = max((e.article for _, e in self.blocks if e.article), key=lambda a: a.size / (BOXED if a.box else 1), default=None)
        rest = [(t, e) for t, e in self.blocks if not e.noise and not e.noise_inside and not (e.box and (e.article is None or e.article is not largest))]
        rest = [(t, e) for t, e in rest if not e.outside] or rest
        left = [(t, e) for t, e in rest if not e.low]
        if _size(left) < LEAST_LEFT * _size(rest):
            left = rest
        inside = [(t, e) for t, e in left if e.article is not None and e.article is largest]
        return "\n".join(t for t, _ in (inside if inside and 2 * _size(inside) >= _size(left) else left))


def _size(blocks: list[tuple[str, Element]]) -> int:
    return sum(len(t) for t, _ in blocks)


def visible_text(html: str) -> str:
    """All blocks of text that a page shows, menus and the like included, joined by line ends."""
    blocks, text, at, head = [], [], 0, False

    def flush() -> None:
        if block := " ".join(unescape("".join(text)).split()):
            blocks.append(block)
        text.clear()

    for start, end, name, closes, _ in tags(html):
        if not head:
            text.append(html[at:start])
        at = end
        if not name or name in INLINE and name != "wbr":
            continue
        if name in VOID:
            text.append(" ")
            continue
        flush()
        if name == "head":
            head = not closes
        elif name == "body":
            head = False
    if not head:
        text.append(html[at:])
    flush()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def importance(pages: DataFrame) -> DataFrame:
    """The judged nodes of each host's tree: host, node, m, presentation, content, share, trunk, inside and importance."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                hosts, paths, kinds, values, sizes = [], [], [], [], []
                for h, html in zip(batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200).to_pylist(), strict=True):
                    page = Page(html, stats=True)
                    for path, text in page.texts:
                        paths.append(path)
                        values.append(xxh64_intdigest(text) - (1 << 63))
                        sizes.append(len(text))
                    for path, forms in page.forms.items():
                        paths.append(path)
                        values.append(xxh64_intdigest("|".join(sorted(set(forms)))) - (1 << 63))
                        sizes.append(len(forms))
                    hosts += [h] * (len(page.texts) + len(page.forms))
                    kinds += [True] * len(page.texts) + [False] * len(page.forms)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(kinds, pa.bool_()), pa.array(values, pa.int64()), pa.array(sizes, pa.int64())], names=["host", "node", "is_text", "value", "size"])

    rows = pages.select("host", "html").mapInArrow(nodes, "host string, node string, is_text boolean, value long, size long")
    counted = rows.groupBy("host", "node", "is_text", "value").agg(F.count("*").alias("k"), F.sum("size").alias("s"))
    form, text = (lambda x: F.when(~F.col("is_text"), x)), (lambda x: F.when(F.col("is_text"), x))
    k, s = F.col("k"), F.col("s")
    # a page gives one form of a node, and each of its texts once
    sums = counted.groupBy("host", "node").agg(F.sum(form(k)).alias("m"), F.sum(form(k * F.log(k))).alias("forms"), F.sum(form(s)).alias("n"), F.sum(text(s / k * F.log(k))).alias("old"), F.sum(text(s / k)).alias("texts"), F.sum(text(s)).alias("chars"))
    sums = saved(sums.where(F.col("m") >= LEAST_PAGES), "nodes")
    whole = sums.where("node = ''").select("host", (F.col("chars") / F.col("m")).alias("page_chars"))
    base = F.log("m")
    found = sums.where("node <> ''").join(whole, "host").select(
        "host", "node", "m", ((base - F.col("forms") / F.col("m")) / base).alias("presentation"),
        F.when(F.col("texts") > 0, 1 - F.col("old") / F.col("texts") / base).otherwise(0.0).alias("content"),
        F.coalesce(F.col("chars") / F.col("m") / F.col("page_chars"), F.lit(0.0)).alias("share"), (F.col("n") / F.col("m")).alias("instances"),
    )
    holds = (F.col("share") >= TRUNK) & (F.col("instances") <= ONCE) & F.col("node").rlike(r"/(?:html|body|div|section|article|main|form|center|table|tbody|tr|td)(?:\.[^/]*)?$") & ~F.col("node").rlike(r"/(?:article|main)(?:\.[^/]*)?/")
    trunks = found.where(holds).groupBy("host").agg(F.collect_set("node").alias("trunk"))
    # the main part begins at the end of a trunk, if that is more than html and body
    ends = F.filter("trunk", lambda t: ~t.rlike(r"/(?:html|body)(?:\.[^/]*)?$") & ~F.exists("trunk", lambda u: u.startswith(F.concat(t, F.lit("/")))))
    placed = found.join(trunks.withColumn("ends", ends), "host", "left")
    node = F.col("node")
    placed = placed.withColumn("on_trunk", F.coalesce(F.exists("trunk", lambda t: (t == node) | t.startswith(F.concat(node, F.lit("/")))), F.lit(False))).withColumn("inside", F.coalesce(F.exists("ends", lambda t: node.startswith(F.concat(t, F.lit("/")))), F.lit(False)))
    weight = F.when(F.col("inside"), 1.0).otherwise(F.least(F.lit(1.0), F.col("share") / SMALL))
    return placed.select("host", "node", "m", "presentation", "content", "share", "on_trunk", "inside", F.coalesce(F.size("ends") > 0, F.lit(False)).alias("has_main"), ((1 - CONTENT) * F.col("presentation") + CONTENT * F.col("content") * weight).alias("importance"))


def low_nodes(pages: DataFrame) -> DataFrame:
    """One row for each host that has nodes of low importance: host, nodes; "!" marks those beside the main part."""
    low = importance(pages).where(~F.col("on_trunk") & (F.col("importance") < LEAST_IMPORTANCE))
    marked = F.when(F.col("has_main") & ~F.col("inside"), F.concat(F.lit("!"), F.col("node"))).otherwise(F.col("node"))
    return low.groupBy("host").agg(F.sort_array(F.collect_list(marked)).alias("nodes"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns ``id_col``, ``url_col`` and ``text``, the blocks of the main text joined by line ends.

    Null or empty html gives an empty text; pages with a null url are one host; repeated rows each give a row; other
    columns are left behind, so clashing names do no harm. An empty table gives no rows. Pages are parsed whole.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[str]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for h, html, nodes in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    if h not in known:
                        if len(known) > 10_000:
                            known.clear()
                        known[h] = frozenset(nodes or ())
                    out.append(Page(html, known[h]).main_text())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    low = saved(low_nodes(plain), "low-nodes")
    kind = plain.schema["id"].dataType.simpleString()
    joined = plain.join(low, "host", "left").select("id", "url", "host", "html", "nodes")
    return joined.mapInArrow(extract, f"id {kind}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
