"""Main text of pages by a site style tree.

The DOMs of one host's pages are merged. An element node is known by its host, its place and the look
of what stands around it: its parent's style node (the parent's children by tag and class, repeats in a
row taken as one) and its place in that sequence. Over all pages of the host each element has

* presentation importance: the entropy of its style nodes, -sum p log_m p over its m pages;
* content importance: 1 minus the mean over its contents (text blocks and link targets) of log_m of the
  number of pages that show the same content: 1 if every page has its own, 0 if all show the same;
* composite importance: (1 - g^l) presentation + g^l content, with l its number of style nodes. An
  element on one page only has importance 1.

Importance is weighted by role. Elements that HTML declares as menus, headers, footers, sidebars, notices,
forms or scripts by tag, role or hiding weigh 0, as do branches beside the article on pages that mark one;
flow content without a class of its own inside a marked article weighs 1 whatever its entropy, since a
passage that other pages quote is still the article's. All other branches are kept or removed by composite
importance, of which a class or id that sounds like a menu, notice, advert or the like leaves a share: none
where a whole name says so (``comments``, ``cookie-notice``, ``ad-3``), else, where a part of it does
(``with-sidebar``, ``related-work``), ``NAMED_WEIGHT``. Whole names say so of block elements only, not of
headings, of what holds the page's first h1, or of what holds most of its text; reader comments may hold most
of it, but not all. Names say nothing against html, body, main, article and what holds a marked article; an
article inside reader comments is a comment and marks nothing.

Counting is grouped by (element, content) and (element, style) with sums before the shuffle, so a host
with a third of all pages spreads over its elements and contents and no task gathers a host or a tree.
Contents are added up the tree in rounds of one grouped sum: after round k an element holds what lies less
than 2^k levels below it, and hands that to its ancestor 2^k levels above. A row names only the ancestors at
those distances, and the rounds are the logarithm of the greatest depth, so that no depth is left out.
"""

from __future__ import annotations

import html as references
import json
import re
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

GAMMA = 0.9
LEAST_IMPORTANCE = 0.2
#: What a class or id with a part in ``NOISE_WORDS`` leaves of an element's importance.
NAMED_WEIGHT = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul hr".split()
)
NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe object embed svg canvas audio video "
    "button select textarea input label menu dialog title link meta".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar tablist".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside widget cookie "
    "cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist respond disqus share sharing social related recommended toolbar copyright "
    "disclaimer skip".split()
)
#: Of those, what names the remarks of readers.
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus".split())
#: Parts that say where or what shape an element is: they do not keep a name from being noise as a whole.
PLACE_WORDS = frozenset("area bar block bottom box container left list right section top".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never judged by their names.
WHOLE = frozenset("html body main article".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th figure hgroup hr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: An open element of the first kind is ended by the start of one of the second.
ENDED_BY = {
    "p": BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "li", "dt", "dd"} | {"li", "dt", "dd"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[A-Za-z/][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-z0-9]+")
#: What a name as a whole says of an element.
_NOISE_NAME, _COMMENT_NAME = 1, 2


def _whole_name(names: str) -> int:
    """``_COMMENT_NAME`` or ``_NOISE_NAME`` if one of the names has noise words, places and numbers only, else 0."""
    says = 0
    for name in names.split():
        parts = {p for p in _NAME.findall(name) if not p.isdigit()} - PLACE_WORDS
        if parts and parts <= NOISE_WORDS:
            says = max(says, _NOISE_NAME if parts.isdisjoint(COMMENT_WORDS) else _COMMENT_NAME)
    return says


class Page:
    """Element nodes and text blocks of one page, in page order."""

    def __init__(self, source: str):
        # per node: parent, signature, is plain flow, weighs nothing, is a marked article, is main, is named
        # as noise, is html or body
        self.parent, self.sign, self.plain = [-1], ["#"], [False]
        self.noise, self.article, self.main = [False], [False], [False]
        self.named, self.top = [False], [False]
        self.whole = [0]  # what the whole name says
        self.titles: list[int] = []  # h1 elements
        #: A block is (node, text) parts: more than one where inline elements are named as noise.
        self.blocks: list[list[tuple[int, str]]] = []
        self.links: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, tag: str, attributes: dict[str, str], above: int) -> int:
        called = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
        names = _NAME.findall(called)
        role = attributes.get("role", "").strip().lower()
        own = bool(names or role)
        hidden = "hidden" in attributes or _HIDDEN.search(attributes.get("style", "")) is not None
        noise = tag in NOISE_TAGS or role in NOISE_ROLES or hidden
        if tag == "header":
            noise = not any(self.article[n] for n in self._line(above))
        self.parent.append(above)
        self.sign.append(f"{tag}.{'.'.join(names)}" if own else tag)
        self.plain.append(tag in FLOW and not own)
        self.noise.append(noise or self.noise[above])
        self.article.append((tag == "article" or role == "article") and not self.noise[-1])
        self.main.append((tag == "main" or role == "main") and not self.noise[-1])
        whole = tag in WHOLE or role in WHOLE
        self.named.append(not whole and not self.noise[-1] and not NOISE_WORDS.isdisjoint(names))
        self.top.append(tag in ("html", "body"))
        told = self.named[-1] and tag in BLOCK and tag not in HEADINGS and tag != "header"
        self.whole.append(_whole_name(called) if told else 0)
        if tag == "h1":
            self.titles.append(len(self.parent) - 1)
        return len(self.parent) - 1

    def _line(self, node: int):
        while node >= 0:
            yield node
            node = self.parent[node]

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        held: list[tuple[int, str]] = []

        def flush() -> None:
            if not held:
                return
            parts = [(n, "".join([text for _, text in some])) for n, some in groupby(held, itemgetter(0))]
            held.clear()
            if len(parts) == 1:
                parts = [(parts[0][0], " ".join(parts[0][1].split()))]
            if any(text and not text.isspace() for _, text in parts):
                self.blocks.append(parts)

        def close(depth: int) -> None:
            while len(stack) > depth:
                if stack[-1][0] in BLOCK:
                    flush()
                stack.pop()

        at, end = 0, len(source)
        while at < end:
            found = _TAG.search(source, at)
            text = source[at : found.start() if found else end]
            if text and not self.noise[stack[-1][1]]:
                held.append((stack[-1][1], references.unescape(text) if "&" in text else text))
            if not found:
                break
            at = found.end()
            closing, tag, rest = found.group(1), found.group(2), found.group(3)
            if tag is None:
                closing, tag, rest = found.group(4), found.group(5), found.group(6)
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                continue
            if tag == "br":
                held.append((stack[-1][1], " "))
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if tag in ENDED_BY.get(stack[depth][0], ()):
                    close(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "td", "th"):
                    break
            attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
            above = stack[-1][1]
            if tag in BLOCK:
                flush()
            if tag == "a" and attributes.get("href"):
                self.links.append((above, attributes["href"]))
            node = above
            if tag in BLOCK or tag in NOISE_TAGS or attributes.get("class") or attributes.get("id") or attributes.get("role") or attributes.get("hidden") is not None or "style" in attributes:
                node = self._open(tag, attributes, above)
                if tag not in BLOCK and not self.noise[node] and not self.named[node]:
                    self.parent.pop(), self.sign.pop(), self.plain.pop()
                    self.noise.pop(), self.article.pop(), self.main.pop()
                    self.named.pop(), self.top.pop(), self.whole.pop()
                    node = above
            if tag in VOID:
                continue
            if tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])|\\Z", re.I).search(source, at)
                if not self.noise[node]:
                    held.append((node, source[at : stop.start()]))
                at = stop.start()
            stack.append((tag, node))
        close(1)
        flush()

    def keys(self, host: str) -> tuple[list[int], list[int]]:
        """Per node its element key and style key."""
        import xxhash

        def key(text: str) -> int:
            value = xxhash.xxh64_intdigest(text)
            return value - (1 << 64) if value >> 63 else value

        children: list[list[int]] = [[] for _ in self.parent]
        for n in range(1, len(self.parent)):
            children[self.parent[n]].append(n)
        element, style = [0] * len(self.parent), [0] * len(self.parent)
        element[0] = key(f"host {host}")
        for n in range(len(self.parent)):
            look: list[str] = []
            place = []
            for c in children[n]:
                if not look or look[-1] != self.sign[c]:
                    look.append(self.sign[c])
                place.append(len(look) - 1)
            style[n] = key(f"{element[n]} {' '.join(look)}")
            for c, p in zip(children[n], place):
                element[c] = key(f"{style[n]} {p}")
        return element, style

    def jumps(self, element: list[int]) -> list[list[int]]:
        """Per node the element keys of its ancestors 1, 2, 4, ... levels above, below the root."""
        below: list[list[int] | None] = [None] * len(self.parent)  # of the children of a node: alike for all
        named: list[list[int]] = [[] for _ in self.parent]
        below[0] = []
        for n in range(1, len(self.parent)):
            p = self.parent[n]
            if below[p] is None:
                line = [p]
                while len(up := below[self.parent[line[-1]]]) >= len(line):
                    line.append(up[len(line) - 1])
                below[p], named[p] = line, [element[a] for a in line]
        return [named[max(p, 0)] for p in self.parent]

    def texts(self):
        """(node, text) of all blocks, those of several parts by their parts."""
        for parts in self.blocks:
            for node, text in parts:
                text = text if len(parts) == 1 else " ".join(text.split())
                if text:
                    yield node, text

    def by_whole_name(self) -> list[int]:
        """Per node what its whole name says, 0 where that does not decide."""
        if not any(self.whole):
            return self.whole
        chars = [0] * len(self.parent)
        for node, text in self.texts():
            chars[node] += len(text)
        for n in range(len(chars) - 1, 0, -1):
            chars[self.parent[n]] += chars[n]
        title = next((n for n in self.titles if chars[n] and not self.noise[n]), 0)
        spared = set(self._line(title)) if title else {0}

        def most(n: int) -> bool:
            return chars[n] == chars[0] if self.whole[n] == _COMMENT_NAME else 2 * chars[n] > chars[0]

        return [0 if not w or n in spared or most(n) else w for n, w in enumerate(self.whole)]

    def choice(self) -> tuple[list[tuple[int, int, bool]], list[list[tuple[int, str]]]]:
        """(judged, blocks): the nodes that importance has yet to judge, and the blocks that role weights leave.

        ``judged`` has the place in it of the next judged node above (-1: none), the node, and whether its
        name lowers its weight; blocks name their place in ``judged`` instead of a node.
        """
        says = self.by_whole_name()
        remarks = [w == _COMMENT_NAME for w in says]
        for n in range(1, len(remarks)):
            remarks[n] = remarks[n] or remarks[self.parent[n]]
        article = [a and not r for a, r in zip(self.article, remarks)]
        marked = article if any(article) else self.main
        some = any(marked)
        names = [0] * len(self.parent)
        for n in range(1, len(self.parent)):
            names[n] = names[self.parent[n]] + self.named[n]
        # The marked articles below the fewest names: whatever holds them is a wrapper, not noise. Others,
        # as in a list of comments, stay subject to the names that hold them.
        least = min((names[n] for n in range(len(marked)) if marked[n]), default=0)
        wraps = [False] * len(self.parent)
        for n in range(len(marked)):
            if marked[n] and names[n] == least:
                for up in self._line(n):
                    if wraps[up]:
                        break
                    wraps[up] = True
        # A whole name decides about its element, unless that would leave nothing.
        gone = list(self.noise)
        for n in range(1, len(self.parent)):
            gone[n] = gone[n] or gone[self.parent[n]] or says[n] > 0 and not wraps[n]
        inside, place, by_name = [False] * len(self.parent), [-1] * len(self.parent), [-1] * len(self.parent)
        judged: list[tuple[int, int, bool]] = []
        for n in range(1, len(self.parent)):
            above = self.parent[n]
            inside[n] = inside[above] or marked[n]
            named = self.named[n] and not wraps[n]
            if some:
                asked = named or inside[above] and not self.plain[n] and not marked[n]
            else:
                asked = not self.top[n]
            place[n], by_name[n] = place[above], by_name[above]
            if asked and not gone[n]:
                judged.append((place[above], n, named))
                place[n] = len(judged) - 1
                if named:
                    if by_name[above] != place[above]:
                        judged.append((by_name[above], n, named))
                    by_name[n] = len(judged) - 1
            if marked[n]:
                place[n] = by_name[n]  # above a marked article only names count

        def outside(gone: list[bool]) -> list[list[tuple[int, str]]]:
            lines = ([(place[n], text) for n, text in parts if not gone[n] and (inside[n] or not some)] for parts in self.blocks)
            return [left for left in lines if any(text and not text.isspace() for _, text in left)]

        return judged, outside(gone) or outside(self.noise)


def host_of(url: str | None) -> str:
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found.group(1).lower() if found else ""


#: What a row of the tree's table is about.
_STYLE, _CONTENT, _PAGE = 0, 1, 2


def _tree_rows(batches):
    """(element, kind, value, jumps) rows of each page, each once per page."""
    import xxhash

    kinds = pa.schema([("element", pa.int64()), ("kind", pa.int8()), ("value", pa.int64()), ("jumps", pa.list_(pa.int64()))])

    def digest(text: str) -> int:
        value = xxhash.xxh64_intdigest(text)
        return value - (1 << 64) if value >> 63 else value

    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            out: dict[tuple[int, int, int], list[int] | None]
            made = []
            part = batch.slice(lo, 512)
            for url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                page = Page(source or "")
                element, style = page.keys(host_of(url))
                jumps = page.jumps(element)
                out = {}
                for n in range(1, len(element)):
                    out[element[n], _PAGE, 0] = jumps[n]
                    out[element[n], _STYLE, style[n]] = None
                for n, text in [*page.texts(), *page.links]:
                    if n:
                        out[element[n], _CONTENT, digest(text)] = None
                made += [(e, k, v, up) for (e, k, v), up in out.items()]
            cols = list(zip(*made)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)


def style_tree(pages: DataFrame) -> DataFrame:
    """(element, pages, styles, presentation, content, importance) of every element of every host."""
    rows = pages.select("url", "html").mapInArrow(_tree_rows, "element bigint, kind tinyint, value bigint, jumps array<bigint>")
    seen = rows.groupBy("element", "kind", "value").agg(F.count("*").alias("c"), F.first("jumps").alias("jumps"))

    def of(kind: int, value):
        return F.when(F.col("kind") == kind, value)

    c = F.col("c").cast("double")
    own = cut_lineage(
        seen.groupBy("element").agg(
            F.max(of(_PAGE, F.col("c"))).alias("pages"),
            F.first(of(_PAGE, F.col("jumps")), ignorenulls=True).alias("jumps"),
            F.count(of(_STYLE, F.lit(1))).alias("styles"),
            F.sum(of(_STYLE, c)).alias("looks"),
            F.sum(of(_STYLE, c * F.log(c))).alias("look_logs"),
            F.count(of(_CONTENT, F.lit(1))).alias("contents"),
            F.coalesce(F.sum(of(_CONTENT, F.log(c))), F.lit(0.0)).alias("content_logs"),
        )
    )
    about = F.struct("pages", "styles", "looks", "look_logs", "jumps").alias("about")
    branch = own.select("element", "contents", "content_logs", about)
    for k in range(own.agg(F.max(F.size("jumps"))).first()[0] or 0):
        above = F.when(F.col("contents") > 0, F.get("about.jumps", F.lit(k)))
        both = F.explode(
            F.array(
                F.struct("element", "contents", "content_logs", "about"),
                F.struct(above.alias("element"), "contents", "content_logs", F.lit(None).cast(branch.schema["about"].dataType).alias("about")),
            )
        ).alias("row")
        branch = (
            branch.select(both)
            .select("row.*")
            .filter(F.col("element").isNotNull())
            .groupBy("element")
            .agg(
                F.sum("contents").alias("contents"),
                F.sum("content_logs").alias("content_logs"),
                F.first("about", ignorenulls=True).alias("about"),
            )
        )
    m = F.log(F.col("pages").cast("double"))
    once = F.col("pages") < 2
    presentation = F.when(once, 1.0).otherwise(
        F.least(F.lit(1.0), (F.log("looks") - F.col("look_logs") / F.col("looks")) / m)
    )
    content = F.when(once, 1.0).when(F.col("contents") == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), 1 - F.col("content_logs") / F.col("contents") / m)
    )
    share = F.pow(F.lit(GAMMA), F.col("styles").cast("double"))
    return (
        branch.select("element", "contents", "content_logs", "about.*")
        .select("element", "pages", "styles", presentation.alias("presentation"), content.alias("content"))
        .withColumn("importance", (1 - share) * F.col("presentation") + share * F.col("content"))
    )


_CHOSEN = "page_id bigint, url string, key bigint, judged array<bigint>, body binary"


def _chosen(batches):
    """What role weights leave of each page, packed, with the elements that are still to be judged."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        ids, urls, keys, sources = batch.columns
        judged, bodies = [], []
        for url, source in zip(urls.to_pylist(), sources.to_pylist()):
            page = Page(source or "")
            asked, blocks = page.choice()
            if asked:
                element = page.keys(host_of(url))[0]
                asked = [(above, element[n], named) for above, n, named in asked]
            judged.append(sorted({e for _, e, _ in asked}))
            choice = json.dumps([asked, blocks], ensure_ascii=False)
            bodies.append(packer.compress(choice.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays(
            [ids, urls, keys, pa.array(judged, pa.list_(pa.int64())), pa.array(bodies, pa.binary())],
            names=["page_id", "url", "key", "judged", "body"],
        )


def _kept(judged, blocks, removed: set, lowered: set) -> list[str]:
    """Texts of the blocks of which no judged element is too low, and what stands in if that leaves nothing."""

    def left(gone) -> list[str]:
        lost = []
        for above, element, named in judged:
            lost.append(above >= 0 and lost[above] or gone(element, named))
        out = []
        for parts in blocks:
            text = " ".join("".join(text for at, text in parts if at < 0 or not lost[at]).split())
            if text:
                out.append(text)
        return out

    kept = left(lambda element, named: element in removed or named and element in lowered)
    if not kept and all(at >= 0 for parts in blocks for at, _ in parts):
        # a wrapper's name must not empty a page; and branches alike on all pages tell nothing, so that names decide
        kept = left(lambda element, named: element in removed) or left(lambda element, named: named) or left(lambda *_: False)
    return kept


def _texts(bodies: Column, removed: Column, lowered: Column) -> Column:
    @F.arrow_udf("string")
    def joined(bodies: pa.Array, removed: pa.Array, lowered: pa.Array) -> pa.Array:
        import zstandard

        opener, out = zstandard.ZstdDecompressor(), []
        for body, gone, low in zip(bodies.to_pylist(), removed.to_pylist(), lowered.to_pylist()):
            judged, blocks = json.loads(opener.decompress(body))
            out.append("\n".join(_kept(judged, blocks, set(gone or ()), set(low or ()))))
        return pa.array(out, pa.string())

    return joined(bodies, removed, lowered)


def main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    ``text`` is the kept blocks in page order, joined by a line end: character references decoded, white
    space in a block one blank, both ends trimmed; a line break is white space. ``n_chars`` counts code
    points. Null, empty and markup-only html give the empty text; markup may be cut off or unclosed. A page
    without a readable host shares a tree with the others of that kind. If importance would leave nothing of a
    page whose blocks are all judged, names lower nothing there; if still nothing is left, names alone decide,
    and after that all its blocks stay. Repeated rows come out as often as they came in. Other
    columns are not looked at.
    """
    low = cut_lineage(
        style_tree(pages)
        .filter(NAMED_WEIGHT * F.col("importance") < least)
        .select(F.col("element").alias("gone"), (F.col("importance") < least).alias("whole"))
    )
    keyed = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("key"), "html")
    chosen = keyed.mapInArrow(_chosen, _CHOSEN)
    asked = chosen.select("key", F.explode("judged").alias("gone")).distinct()
    removed = (
        asked.join(low, "gone")
        .groupBy("key")
        .agg(
            F.collect_set(F.when(F.col("whole"), F.col("gone"))).alias("removed"),
            F.collect_set(F.when(~F.col("whole"), F.col("gone"))).alias("lowered"),
        )
    )
    text = _texts(F.col("body"), F.col("removed"), F.col("lowered")).alias("text")
    return (
        chosen.join(removed, "key", "left")
        .select("page_id", "url", text)
        .withColumn("n_chars", F.length("text").cast("bigint"))
    )
