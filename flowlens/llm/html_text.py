"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page's tokens are its elements, told apart by their path (tag and class or id of the element and all around
it), and its blocks of text, told apart by path and text.  A token's occurrence vector says on which pages of the host it is.  Vectors are compared by fingerprints that
are added up over pages (map-side first), so that no task sees a host's pages together.  Pages without elements are left out.
A token is an element of a template if it occurs once on most of the pages that have it, and if these are at least two
different pages (or the host has one only).  Nothing depends on how many pages the host has.  A host may have several layouts: a page's
template is made of those template elements that are on it, so that an odd page changes nothing for the others.

The text is that of the article elements; of these, those of the template if any is.  A page without an article gives
the text of all slots (innermost template elements) whose text varies from page to page and isn't mostly links,
narrowed to elements named like an article if these hold half of it.  A block's frame is the article element around
it, or else the outermost element in the body.  Tokens of equal vectors are an equivalence class, as far as one page in ten may be odd; blocks of the class of their frame are
the template's text and left out, unless they are half of the page's text or more: then they are copies of an article.  What lies there in menus, forms, adverts,
notices, comments and the like is left out: elements of such tags, and elements of which a whole class, id or role is such a name
if they are on two different pages of the host (or it has one only).  An element around the article is none of these.

Work and memory of a page grow with its length, however deep its elements lie and however many stay open.  A url without a host makes a host of its own, the empty one.  Null and empty html give an empty text.  Rows that
repeat a page are counted and extracted each.  Other columns are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

# HTML's element kinds, and names that sites give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
OTHER = frozenset("aside button dialog footer form head input label menu nav noscript option select".split())
INLINE = frozenset("button head label option select".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert disclaimer comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe signup login popup modal overlay pagination pager widget widgets search skip".split()
)
ARTICLE_NAMES = frozenset("article post story entry content main maincontent articlebody post-content entry-content article-body article-content main-content".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl select article section div body td th blockquote".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.S)
_TEXT = re.compile(r"<!--.*\Z|[^<]+|<", re.S)  # behind the last ">" there are no elements
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

_TARGET = re.compile(r"\bhref\s*=", re.I)


def _plain(pieces: Iterable[str]) -> str:
    return " ".join(unescape("".join(pieces)).split())


class _Open:
    __slots__ = ("tag", "node", "silent", "article", "link")

    def __init__(self, tag: str, node: int, silent: bool, article: bool, link: bool):
        self.tag, self.node, self.silent, self.article, self.link = tag, node, silent, article, link


class Page:
    """Elements and text blocks of a page.

    Elements of equal paths are one node; ``up`` gives the node around each (a smaller number), ``ids`` a hash of its path, ``counts`` how
    often it occurs.  ``tagged`` and ``marked`` nodes look like something else than the article, by their tag or by their class, id or role;
    whether they are is for ``main_text`` to say.  ``blocks`` are (node, text, characters of links, parts): ``parts`` are the pieces of a text
    and their nodes, if a piece lies in such a node within the line.
    """

    def __init__(self, html: str | None):
        self.ids, self.up, self.counts, self.depth, self.marks, self.tags = [0], [0], [1], [0], [0], [""]
        self.tagged: set[int] = set()
        self.marked: set[int] = set()
        self.articles: set[int] = set()
        self.named: set[int] = set()
        self.blocks: list[tuple[int, str, int, list | None]] = []
        self.nodes: dict[tuple[int, str], int] = {}
        self.stack = [_Open("", 0, False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.texts: list[tuple[str, int]] = []
        self.linked = 0
        self.read(html or "")
        self.flush()

    def flush(self) -> None:
        if self.texts:
            if text := _plain(piece for piece, _ in self.texts):
                node = self.stack[self.nearest(BLOCK)].node
                odd = any(self.marks[of] > self.marks[node] for _, of in self.texts)
                self.blocks.append((node, text, self.linked, self.texts if odd else None))
            self.texts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        top = self.stack[-1]
        names = [next(x for x in m[1:] if x is not None) if any(x is not None for x in m[1:]) else "" for m in (f.groups() for f in _NAMED.finditer(attributes))] if attributes else []
        mark = re.sub(r"\d+", "0", ".".join(sorted(n for name in names for n in name.split()))) if names else ""
        words = {n.lower() for name in names for n in name.split()}
        article = top.article or tag in ("article", "main") or bool(words & ARTICLE_NAMES)
        key = (top.node, f"{tag}.{mark}" if mark else tag)
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = len(self.ids)
            tagged = tag in OTHER or (tag == "header" and not top.article)
            odd = tag not in ("html", "body", "article", "main") and (tagged or bool(words & OTHER_NAMES) or ("header" in words and not top.article))
            if odd:
                (self.tagged if tagged else self.marked).add(node)
            self.ids.append(_signed(f"{self.ids[top.node]}>{key[1]}") or 1)
            self.up.append(top.node)
            self.counts.append(0)
            self.depth.append(self.depth[top.node] + 1)
            self.marks.append(self.marks[top.node] + odd)
            self.tags.append(tag)
            if tag in ("article", "main"):
                self.articles.add(node)
            elif words & ARTICLE_NAMES and not self.marks[node]:
                self.named.add(node)
        self.counts[node] += 1
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, node, top.silent or tag in INLINE, article, top.link or (tag == "a" and bool(_TARGET.search(attributes)))))

    def nearest(self, tags: set[str] | frozenset[str]) -> int:
        """The place in the stack of the innermost open element of ``tags``; 0 without any."""
        return max((x[-1] for tag in tags if (x := self.places.get(tag))), default=0)

    def close_to(self, tags: set[str] | frozenset[str], scopes: frozenset[str]) -> None:
        at = self.nearest(tags)
        if at and at > self.nearest(scopes):
            while len(self.stack) > at:
                self.places[self.stack.pop().tag].pop()

    def read(self, html: str) -> None:
        at, last = 0, html.rfind(">")
        while m := (_TOKEN.match(html, at) if at <= last else _TEXT.match(html, at)):
            at = m.end()
            tag = m[1] if m.re is _TOKEN else None
            if tag is None:
                piece = m[0]
                if piece[0] != "<" or piece == "<":
                    top = self.stack[-1]
                    if not top.silent:
                        self.texts.append((piece, top.node))
                        if top.link:
                            self.linked += len(piece)
                continue
            tag, closing = tag.lower(), m[0][1] == "/"
            if tag in BLOCK:
                self.flush()
            if closing:
                if tag not in VOID:
                    self.close_to({tag}, frozenset())
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag in VOID or (m[2].endswith("/") and (self.places.get("svg") or self.places.get("math"))):
                if not self.stack[-1].silent:
                    self.texts.append((" ", self.stack[-1].node))
            else:
                if tag in BLOCK:
                    self.close_to({"p"}, SCOPES)
                if tag in CLOSED_BY:
                    self.close_to(CLOSED_BY[tag], SCOPES - CLOSED_BY[tag])
                self.open(tag, m[2])

    def innermost(self, of: set[int]) -> list[int]:
        """For each node, the innermost of the nodes ``of`` that it lies in or is; -1 without any."""
        found = [0 if 0 in of else -1] * len(self.ids)
        for node in range(1, len(self.ids)):
            found[node] = node if node in of else found[self.up[node]]
        return found

    def frames(self) -> list[int]:
        """For each node, the innermost article element around it, else the outermost element in the page's body."""
        found, body = self.innermost(self.articles), [True] * len(self.ids)
        outer = list(range(len(self.ids)))
        for node in range(1, len(self.ids)):
            up = self.up[node]
            body[node] = body[up] and self.tags[node] in ("html", "body")
            outer[node] = node if body[up] else outer[up]
        return [a if a >= 0 else b for a, b in zip(found, outer, strict=True)]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


_STATS = "host string, id long, text long, pages long, once long, vector long, first long, last long, marked long, chars long, links long, low long, high long, beyond long, around array<long>"
#: So many elements around an element are looked through at once for its slot; beyond, by jumps.
LINE = 32


def _signed(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _text_key(frame: int, text: str) -> int:
    """A text token, told apart by the id of its block's node; 0 stands for elements."""
    return _signed(f"{frame}\n{text}") or 1


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[tuple[str, int, int], list] = {}
        for host, page_id, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            page = Page(html)
            if len(page.ids) == 1:
                continue
            content, seen = _signed(html), (_signed(f"{page_id}") >> 32) + (1 << 31)
            chars: dict[int, list] = {}
            frames = page.frames()
            texts = {(page.ids[frames[node]], _text_key(page.ids[node], text)) for node, text, *_ in page.blocks}
            for node, text, linked, _ in page.blocks:
                c = chars.setdefault(node, [0, 0, []])
                c[0] += len(text)
                c[1] += linked
                c[2].append(text)
            for node, n in enumerate(page.counts):
                got = chars.get(node, [0, 0, []])
                text = _signed("\n".join(got[2]))
                row = held.get((host, page.ids[node], 0))
                if row is None:
                    around, up = [], node
                    while len(around) < LINE and (not around or around[-1] != 0):
                        around.append(page.ids[up])
                        up = page.up[up]
                    row = held[(host, page.ids[node], 0)] = [0, 0, 0, content, content, 0, 0, 0, text, text, page.ids[up], around]
                row[0] += 1
                row[1] += n == 1
                row[2] += seen
                row[3], row[4] = min(row[3], content), max(row[4], content)
                row[5] |= node in page.marked
                row[6] += got[0]
                row[7] += got[1]
                row[8], row[9] = min(row[8], text), max(row[9], text)
            for frame, text in texts:
                row = held.setdefault((host, frame, text), [0, 0, 0, content, content, 0, 0, 0, 0, 0, 0, []])
                row[0] += 1
                row[2] += seen
                row[3], row[4] = min(row[3], content), max(row[4], content)
        names = [x.split()[0] for x in _STATS.split(", ")]
        columns = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) or [[] for _ in names]
        kinds = [pa.string(), *[pa.int64()] * 13, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, id, text, pages, once, vector, marked, several, chars, links, fixed, around, beyond, host_pages): each host's tokens, from pages that have elements.

    ``text`` is 0 for elements; text tokens, whose ``id`` is that of their frame, are kept if pages of different html
    have them (``several``).  ``once``: pages with one occurrence.  ``around``: the ids of the element and of those around it, ``LINE`` at most;
    ``beyond``: the next one's.
    """
    raw = pages.select(host_of(F.col("url")).alias("host"), F.col("page_id").cast("string"), "html").mapInArrow(_page_tokens, _STATS)
    sums = raw.groupBy("host", "id", "text").agg(F.max("around").alias("around"), F.max("beyond").alias("beyond"), *(F.sum(c).alias(c) for c in ("pages", "once", "vector", "chars", "links")), *(F.min(c).alias(c) for c in ("first", "low")), *(F.max(c).alias(c) for c in ("last", "high", "marked")))
    several = F.col("first") != F.col("last")
    kept = sums.where((F.col("text") == 0) | several)
    tokens = written(kept.withColumns({"several": several, "fixed": several & (F.col("low") == F.col("high"))}).drop("first", "last", "low", "high"), "page-tokens")
    hosts = tokens.where("id = 0 and text = 0").select("host", F.col("pages").alias("host_pages"), F.col("several").alias("host_several"))
    return tokens.join(hosts, "host")


def template_texts(tokens: DataFrame) -> DataFrame:
    """(host, texts): text tokens of the equivalence class of the frame they lie in.

    The class is the tokens of equal vectors, but that a tenth of the frame's pages may be without the text; the text is inside the frame, so the class nests.
    """
    frames = tokens.where("text = 0 and several").select("host", "id", F.col("pages").alias("frame_pages"), F.col("vector").alias("frame_vector"))
    met = tokens.where("text <> 0").select("host", "id", "text", "pages", "vector").join(frames, ["host", "id"])
    same = (F.col("pages") == F.col("frame_pages")) & (F.col("vector") == F.col("frame_vector"))
    return met.where(same | (F.col("pages") * 10 >= F.col("frame_pages") * 9)).groupBy("host").agg(F.collect_set("text").alias("texts"))


def templates(tokens: DataFrame) -> DataFrame:
    """(host, template): the host's template elements that hold text, and its template texts, as JSON.

    A template element occurs once on most pages that have it, and these are at least two different ones (any, on a host
    of one page).  Text belongs to the innermost template element around it.
    """
    elements = tokens.where("text = 0")
    supported = F.col("several") | ~F.col("host_several")
    once = elements.where(supported & (F.col("once") * 2 > F.col("pages"))).select("host", F.col("id").alias("slot"))
    deepest = elements.where("chars > 0").select("host", "id", "chars", "links", "fixed").join(_slots_of(elements, once), ["host", "id"])
    slots = deepest.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("fixed").alias("fixed"))
    good = ~F.col("fixed") & (F.col("chars") > 2 * F.col("links"))
    by_host = slots.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", good))).alias("slots"))
    marked = F.when((F.col("marked") == 1) & supported, F.col("id"))
    classes = elements.groupBy("host").agg(F.collect_set(marked).alias("classes"), F.max("host_several").alias("several"))
    by_host = classes.join(by_host, "host", "left")
    return by_host.join(template_texts(tokens), "host", "left").select("host", F.to_json(F.struct("slots", "texts", "classes", "several")).alias("template"))


def _slots_of(elements: DataFrame, once: DataFrame) -> DataFrame:
    """(host, id, slot): the innermost template element that each element is or lies in, as a written table.

    The page itself is one for all.  An element without one among the ``LINE`` around it takes that of the next one beyond these,
    found by jumps that double.
    """
    near = elements.select("host", "id", F.posexplode("around").alias("k", "slot")).join(once, ["host", "slot"]).groupBy("host", "id").agg(F.min_by("slot", "k").alias("slot"))
    found = written(elements.select("host", "id", "beyond").join(near, ["host", "id"], "left"), "slots")
    while not found.where("slot is null").isEmpty():
        further = found.select("host", F.col("id").alias("beyond"), F.col("slot").alias("slot2"), F.col("beyond").alias("beyond2"))
        met = found.where("slot is null").join(further, ["host", "beyond"], "left")
        page = F.when((F.col("beyond") == 0) | F.col("beyond2").isNull(), F.lit(0).cast("long"))
        jumped = met.select("host", "id", F.coalesce("beyond2", "beyond").alias("beyond"), F.coalesce("slot2", page).alias("slot"))
        found = written(found.where("slot is not null").unionByName(jumped), "slots")
    return found.select("host", "id", "slot")


class Template:
    """A host's template, read from its JSON; an empty one for hosts without."""

    def __init__(self, found: str | None):
        x = json.loads(found) if found else {}
        self.slots = {int(k): v for k, v in (x.get("slots") or {}).items()}
        self.texts = set(x.get("texts") or ())
        self.confirmed = set(x["classes"]) if x.get("several") else None


def main_text(page: Page, template: Template) -> str:
    """The article's blocks; on a page without an article, those of the template's slots that vary and aren't links."""
    confirmed = template.confirmed
    odd = page.tagged | {n for n in page.marked if confirmed is None or page.ids[n] in confirmed}
    # A node's innermost element of something else, by depth; it counts if it is deeper than the slot that the node lies in.
    other = [-1 if n < 0 else page.depth[n] for n in page.innermost(odd)]
    if page.articles:
        least = min(page.marks[n] for n in page.articles)
        clean = {n for n in page.articles if page.marks[n] == least}
        slot = page.innermost({n for n in clean if page.ids[n] in template.slots} or clean)
        kept = [b for b in page.blocks if slot[b[0]] >= 0 and other[b[0]] <= page.depth[slot[b[0]]]]
    else:
        own = [b for b in page.blocks if other[b[0]] < 0]
        if not own and page.blocks:  # an element around all of it isn't something else
            least = min(page.marks[b[0]] for b in page.blocks)
            own = [b for b in page.blocks if page.marks[b[0]] == least]
        slot = page.innermost({n for n, x in enumerate(page.ids) if x in template.slots})
        kept = [b for b in own if slot[b[0]] < 0 or template.slots[page.ids[slot[b[0]]]]] or own
        inside = page.innermost(page.named)
        named = [b for b in kept if inside[b[0]] >= 0]
        if 2 * sum(len(b[1]) for b in named) >= sum(len(b[1]) for b in kept):
            kept = named
    kept = _without_template(page, kept, template.texts)
    shown = (b[1] if b[3] is None else _plain(piece for piece, node in b[3] if other[node] <= page.depth[b[0]]) for b in kept)
    return "\n\n".join(filter(None, shown))


def _without_template(page: Page, blocks: list, texts: set[int]) -> list:
    """``blocks`` without the template's texts, unless these are half of it or more: copies of an article look like a template."""
    own = [b for b in blocks if _text_key(page.ids[b[0]], b[1]) not in texts] if texts else blocks
    return own if 2 * sum(len(b[1]) for b in own) > sum(len(b[1]) for b in blocks) else blocks


#: Templates of all hosts are sent to every task if their JSON has at most so many bytes; a task holds so many of them ready at a time.
SENT_BYTES, READY = 32 << 20, 64
#: Beyond, templates travel to their pages: a host with more than one page in ``HOT`` of all is spread over ``SALTS`` groups, which get its template each.
HOT, SALTS = 1000, 64
_TEXTS = "page_id long, url string, text string"


def _texts(batch: pa.RecordBatch, templates: Iterable[Template]) -> pa.RecordBatch:
    """From (page_id, url, html, ...) and each row's template."""
    texts = [main_text(Page(html), template) for html, template in zip(batch.column(2).to_pylist(), templates, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _with_sent_templates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The texts of ``rows`` (page_id, url, html, host), whose templates every task has been sent."""
    sent = rows.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in found.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Template] = {}

        def of(host: str) -> Template:
            if host not in ready:
                if len(ready) >= READY:
                    ready.clear()
                ready[host] = Template(sent.value.get(host))
            return ready[host]

        for batch in batches:
            yield _texts(batch, map(of, batch.column(3).to_pylist()))

    return rows.mapInArrow(run, _TEXTS)


def _with_met_templates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The same, where each group of a host's pages follows on the host's template: a task holds one template at a time."""
    spark = rows.sparkSession
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["host"] for r in counts.where(F.col("n") * HOT > total).select("host").collect()]  # less than ``HOT`` hosts
    is_hot = F.col("host").isin(hot) if hot else F.lit(False)
    salted = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).otherwise(0)).withColumn("template", F.lit(None).cast("string"))
    salts = F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0)))
    first = found.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", salts.alias("salt"), "template")
    both = first.unionByName(salted).withColumn("is_page", F.col("template").isNull())
    order = ["host", "salt", "is_page"]
    sorted_ = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "salt").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, template = None, Template(None)
        for batch in batches:
            pages, chosen = [], []
            for k, (host, sent) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if sent is not None:
                    known, template = host, Template(sent)
                else:
                    if host != known:
                        known, template = host, Template(None)
                    pages.append(k)
                    chosen.append(template)
            yield _texts(batch.take(pa.array(pages, pa.int64())), chosen)

    return sorted_.select("page_id", "url", "html", "host", "salt", "template").mapInArrow(run, _TEXTS)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)
    found = written(templates(page_tokens(pages)), "templates")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("template"))).first()[0] or 0
    return _with_sent_templates(rows, found) if size <= SENT_BYTES else _with_met_templates(rows, found)
