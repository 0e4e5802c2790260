"""HTML extraction by consensus host paths.

A first pass parses every page, leaves out what its tags, roles and classes show not to be article,
and scores containers by the text that is left below them: the deepest path of tags and generalised
classes that covers nearly all of it is the page's vote (an article or main element is taken as it
is and never narrowed). Spark counts, for each host, the votes of its pages and the blocks that
recur on its different pages outside of articles (a host that has such blocks votes again without
them). Both come back to the pages of the host, and a last pass extracts what the winning path
covers, without the recurring blocks. A page where the
host's paths cover too little of the text uses its own best container.

Left out: menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, scripts,
styles and markup. A tag or role decides by itself; a class does if the whole name says so
("site-header", not "post-header" or "market-share"); a name that only mentions it, or an id that
can also name a chapter, decides only for what consists of links. Whatever its names, an element
that holds the page's article or main element, or the heading and most of the text of a page that
has neither, stays. Of a header inside an article its headings stay.

Character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one space. Time and memory are linear in the page: paths are interned.

Defined cases: null or empty html gives the empty text; a null url has no host, so the page goes
by itself; pages without any container use the whole body; markup that isn't closed runs to the
end, a tag that isn't closed is text; equal containers: the deepest, then first path; repeated rows
are pages of their own, but count once where blocks recur; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, table

#: Share of its pages' votes from which a host keeps a path, and from which a path is trusted.
VOTES = 0.1
TRUSTED = 0.5
#: Share of a page's text that a container must cover; that a host's path must cover; that a trusted one must cover.
COVER = 0.95
FITS = 0.8
LEAST = 0.1
#: Pages, and share of a host's pages, on which a block recurs.
RECURS = 3
RECURS_SHARE = 0.5
BROADCAST_HOSTS = 20_000
BROADCAST_BYTES = 16 << 20
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements by kind (fixed values).
RAW = frozenset("script style noscript noembed noframes textarea title iframe xmp".split())
DROPPED = frozenset("head nav header footer aside form button menu dialog label fieldset select datalist template".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article blockquote body br caption center dd div dl dt figcaption figure hgroup hr html li main ol p pre section summary details table tbody td tfoot th thead tr ul".split()) | HEADINGS | DROPPED
CONTAINERS = frozenset("article main section div td body center".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
CLOSES: dict[str, frozenset[str]] = {}
for _open, _by in CLOSED_BY.items():
    for _tag in _by:
        CLOSES[_tag] = CLOSES.get(_tag, frozenset()) | {_open}
#: Names of what isn't article; those that can also name a chapter; words that only tell which part or place is meant (fixed values).
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot adunit adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist respond replies discussion reactions disqus cookie cookies consent notice notices notification notifications announcement disclaimer gdpr alert footer foot header masthead menu menubar nav navbar navigation pager pagination popup modal promo promos promoted related recommended share sharing social sidebar sidebars sponsor sponsored sponsors subscribe newsletter signup login search skip tags toolbar widget widgets".split())
CHAPTERS = frozenset("discussion related notice notices announcement disclaimer search alert banner comment foot header login menu navigation reactions respond share sharing skip social tags consent cookies".split())
PLACES = frozenset("site main page top bottom left right global primary secondary sub mobile desktop sticky fixed container wrapper wrap outer inner box block area section bar list item items unit slot row col column group panel zone region holder link links button buttons form field content body text title heading message icon icons media network networks post posts article articles story stories news user reader readers the my js is".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SEMANTIC = frozenset(["article", "main"])
PART = re.compile(r"[a-z]+")
#: How an element is marked: not at all; only if it consists of links; left out; left out whatever it holds.
PLAIN, HINTED, MARKED, OUT = range(4)


def generalised(tag: str, classes: str) -> str:
    """Tag with its classes in order of name, digits in them made one mark."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes.lower().split()})]) if classes else tag


def named(word: str, is_id: bool) -> int:
    """What a class or id says of its element."""
    parts = PART.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", word).lower())
    said = [p for p in parts if p in BOILERPLATE]
    if not said:
        return PLAIN
    first = parts[0] in BOILERPLATE
    # "post-header" and "article-footer" belong to the article, "site-header", "header-top" and "related-posts" don't
    whole = all(p in BOILERPLATE or p in PLACES for p in parts) and (first or parts[0] not in ("post", "posts", "article", "articles", "story", "content", "body", "text", "title", "is", "js"))
    if not whole or (is_id and all(p in CHAPTERS for p in said)):
        return HINTED
    return MARKED


class Page:
    """Containers and text segments of a page, in page order."""

    def __init__(self, text: str) -> None:
        self.parents, self.tags, self.mark, self.semantic, self.path = [-1], ["html"], [PLAIN], [False], [0]
        self.keys, self.depths = [""], [0]  # by path: its name, which has one size however deep it is
        self.segments: list[tuple[int, str, bool]] = []  # node, text, in a link
        known: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int]] = [("html", 0)]
        count: dict[str, int] = {}  # open elements by tag
        inline: list[list] = []  # marked inline elements: tag, open elements of that tag inside, length of the stack before
        at, link, pos, n, last = 0, 0, 0, len(text), text.rfind(">")

        def cut(size: int) -> None:
            for tag, _ in stack[size:]:
                count[tag] -= 1
            del stack[size:]

        while pos < n:
            start = text.find("<", pos)
            m = TOKEN.search(text, start) if start >= 0 and (start <= last or text.startswith(("<!", "<?"), start)) else None
            if m is None:
                self.segments.append((at, text[pos:], link > 0))
                break
            if m.start() > pos:
                self.segments.append((at, text[pos : m.start()], link > 0))
            pos = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(1):
                if tag == "a":
                    link = max(0, link - 1)
                if tag in BLOCKS:
                    if count.get(tag):
                        i = len(stack) - 1
                        while stack[i][0] != tag:
                            i -= 1
                        cut(i)
                    at = stack[-1][1]
                    self.segments.append((at, "", False))
                elif inline and inline[-1][0] == tag:
                    if inline[-1][1]:
                        inline[-1][1] -= 1
                    else:
                        cut(inline.pop()[2])
                        at = stack[-1][1]
                while inline and inline[-1][2] >= len(stack):
                    inline.pop()
                continue
            if tag in RAW:
                end = RAW_END[tag].search(text, pos)
                pos = end.end() if end else n
                self.segments.append((at, "", False))
                continue
            if tag == "a":
                link += 1
            given = m.group(3)
            mark, classes, role = self.marked(tag, given) if given and tag not in ("a", "img", "html", "body") else (PLAIN, "", "")
            if tag not in BLOCKS and mark < MARKED:
                if inline and inline[-1][0] == tag:
                    inline[-1][1] += 1
                continue
            if tag in VOID:
                self.segments.append((at, "", False))
                continue
            if tag == "body":
                cut(1)
            closes = CLOSES.get(tag, ())
            if any(count.get(x) for x in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        cut(i)
                        break
                    if stack[i][0] in CONTAINERS or stack[i][0] in ("ul", "ol", "table"):
                        break
            parent = stack[-1][1]
            if tag in BLOCKS:
                self.segments.append((parent, "", False))
            if tag == "html":
                continue
            semantic = tag in SEMANTIC or role in SEMANTIC
            key = (self.path[parent], generalised(tag, classes))
            path = known.setdefault(key, len(self.keys))
            if path == len(self.keys):
                self.keys.append(xxhash.xxh3_128_hexdigest(f"{self.keys[key[0]]}>{key[1]}".encode("utf-8", "surrogatepass")))
                self.depths.append(self.depths[key[0]] + 1)
            self.parents.append(parent)
            self.path.append(path)
            self.tags.append(tag)
            self.semantic.append(semantic)
            self.mark.append(max(mark, OUT if tag in DROPPED and tag not in ("form", "header") else MARKED if tag in DROPPED else PLAIN))
            at = len(self.parents) - 1
            if tag not in BLOCKS:
                inline.append([tag, 0, len(stack)])
            stack.append((tag, at))
            count[tag] = count.get(tag, 0) + 1
        self._decide()

    @staticmethod
    def marked(tag: str, given: str) -> tuple[int, str, str]:
        """(mark by its attributes, its classes, its role)."""
        found = {}
        for k, a, b, c in ATTRIBUTE.findall(given):
            found.setdefault(k.lower(), a or b or c)
        classes, role = html.unescape(found.get("class", "")), found.get("role", "").strip().lower()
        if role in ROLES:
            return (MARKED if role in ("form", "banner") else OUT), classes, role
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
            return MARKED, classes, role
        if tag in HEADINGS or tag == "main":
            return PLAIN, classes, role
        marks = [named(w, False) for w in classes.split()] + [named(w, True) for w in html.unescape(found.get("id", "")).split()]
        return max(marks, default=PLAIN), classes, role

    def _sums(self, own: list[int]) -> list[int]:
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def _decide(self) -> None:
        """Which nodes are left out, and how much text the others hold."""
        n = len(self.parents)
        text, linked, heads = [0] * n, [0] * n, [0] * n
        out = [False] * n
        for i in range(1, n):
            out[i] = out[self.parents[i]] or self.mark[i] == OUT
        for node, t, link in self.segments:
            if t and not out[node] and (size := len(t.strip())):
                text[node] += size
                linked[node] += size * link
        for i in range(n):
            if self.tags[i] in HEADINGS and not out[i]:
                heads[i] = 1
        text, linked, heads = self._sums(text), self._sums(linked), self._sums(heads)
        inside = [0] * n  # article or main elements with text at or below a node
        for i in range(1, n):
            inside[i] = int(self.semantic[i] and self.mark[i] < MARKED and text[i] > linked[i] and not out[i])
        inside = self._sums(inside)
        self.left = [False] * n
        self.within = [False] * n  # of an article or main element
        header = [False] * n  # a header inside an article: only its headings stay
        for i in range(1, n):
            p, mark = self.parents[i], self.mark[i]
            self.within[i] = self.within[p] or self.semantic[i]
            header[i] = (header[p] and self.tags[i] not in HEADINGS) or (self.tags[i] == "header" and self.within[p])
            if self.left[p] or mark == OUT:
                self.left[i] = True
            elif mark == MARKED and not (header[i] and self.tags[i] == "header"):
                most = 2 * text[i] > text[0] and heads[i] and not inside[0]
                self.left[i] = not (inside[i] and not self.within[p] or most)
            elif mark == HINTED:
                self.left[i] = bool(text[i]) and 2 * linked[i] >= text[i] and not inside[i]
            elif self.tags[i] in ("ul", "ol", "div", "p", "table", "section", "center") and not self.within[i]:
                # an unnamed menu: nothing but links, and of them several
                self.left[i] = text[i] > 0 and linked[i] * 10 >= text[i] * 9 and linked[i] < text[0] and self.tags[i] != "p"
        self.quiet = [left or h for left, h in zip(self.left, header, strict=True)]
        self.gone: set[int] = set()  # segments of recurring blocks
        self._hold()

    def _hold(self) -> None:
        own = [0] * len(self.parents)
        for i, (node, t, _) in enumerate(self.segments):
            if t and not self.quiet[node] and i not in self.gone:
                own[node] += len(t.strip())
        self.held = self._sums(own)

    def forget(self, recurring: list[int] | None) -> None:
        """Leave out the host's recurring blocks, unless they are most of the page (a copy of others recurs as a whole)."""
        if recurring:
            again = set(recurring)
            blocks = self.blocks()
            found = [b for b in blocks if self.block_key(b[0], b[1]) in again]
            if 10 * sum(len(b[1]) for b in found) <= 7 * sum(len(b[1]) for b in blocks):
                self.gone = {i for b in found for i in b[2]}
                self._hold()

    def _roots(self) -> tuple[list[bool], int]:
        """Nodes that can be or hold the article, and the text to cover: that of article and main elements, if there are any."""
        n = len(self.parents)
        top = [i for i in range(1, n) if self.semantic[i] and not self.within[self.parents[i]] and not self.left[i] and self.held[i]]
        total = sum(self.held[i] for i in top)
        if total and 4 * total >= self.held[0]:
            return [self.semantic[i] and not self.left[i] for i in range(n)], total
        return [t in CONTAINERS and not left for t, left in zip(self.tags, self.left, strict=True)], self.held[0]

    def covered(self) -> tuple[dict[int, int], int]:
        """Text below the nodes of each path that can be the article, and the text to cover."""
        fit, total = self._roots()
        out: dict[int, int] = {}
        for i in range(1, len(self.parents)):
            if fit[i] and self.held[i]:
                out[self.path[i]] = out.get(self.path[i], 0) + self.held[i]
        return out, total

    def best(self) -> int:
        """The deepest path that covers nearly all of the text, the first of equals; 0 for the whole page."""
        sums, total = self.covered()
        enough = [p for p, s in sums.items() if s >= COVER * total]
        return max(enough, key=lambda p: (self.depths[p], -p)) if enough and total else 0

    def chosen(self, paths: list[str], shares: list[float]) -> int:
        """The host's first path that covers enough of this page, else the page's own."""
        if paths:
            sums, total = self.covered()
            keys = {}
            for p in sums:
                keys.setdefault(self.keys[p], p)
            for key, share in zip(paths, shares, strict=True):
                p = keys.get(key)
                if p is not None and sums[p] >= (LEAST if share >= TRUSTED else FITS) * total:
                    return p
        return self.best()

    def blocks(self, path: int = 0) -> list[tuple[int, str, list[int]]]:
        """(path, text, segments) of the blocks below the nodes of that path, and of the page's heading if it stands before them."""
        n = len(self.parents)
        inside = [path == 0] * n
        for i in range(1, n):
            inside[i] = inside[self.parents[i]] or self.path[i] == path
        if path:
            first = next(i for i in range(n) if self.path[i] == path and not self.left[i])
            above = set()
            i = self.parents[first]
            while i >= 0:
                above.add(i)
                i = self.parents[i]
            title = next((i for i in range(n) if self.tags[i] == "h1" and self.held[i]), n)
            p = title
            while p < n and p > 0 and p not in above:
                p = self.parents[p]
            # the heading's container also holds the article, and is more than the page itself or all that the page has
            if title < first and p > 0 and not any(link for node, t, link in self.segments if t.strip() and node == title):
                under = [False] * n
                for i in range(title, n):
                    under[i] = i == title or under[self.parents[i]]
                    inside[i] = inside[i] or under[i]
        out: list[tuple[int, str, list[int]]] = []
        now: list[int] = []

        def end() -> None:
            if now:
                text = "".join(self.segments[i][1] for i in now) if len(now) > 1 else self.segments[now[0]][1]
                block = SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip(" ")
                if block:
                    out.append((self.path[self.segments[now[0]][0]], block, now.copy()))
                now.clear()

        for i, (node, text, _) in enumerate(self.segments):
            if not text:
                end()
            elif inside[node] and not self.quiet[node] and i not in self.gone:
                now.append(i)
        end()
        return out

    def recurring(self) -> list[int]:
        """Hashes of the blocks of a page without article or main element, by which a host's recurring blocks are found."""
        if any(s and not left and h for s, left, h in zip(self.semantic, self.left, self.held, strict=True)):
            return []
        return sorted({self.block_key(p, t) for p, t, _ in self.blocks()})

    def block_key(self, path: int, text: str) -> int:
        return xxhash.xxh64_intdigest(f"{self.keys[path]}\x00{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}


def main_text(text: str | None, paths: list[str] | None = None, shares: list[float] | None = None, recurring: list[int] | None = None) -> str:
    """The article of a page, given what its host's pages agree on."""
    if not text:
        return ""
    page = Page(text)
    page.forget(recurring)
    return " ".join(b[1] for b in page.blocks(page.chosen(paths or [], shares or [])))


def _votes(batches):
    """(host, page, path, block): the vote of each page, then its blocks that may recur; the vote alone where the host's
    recurring blocks are known."""
    for b in batches:
        hosts, pages, paths, blocks = [], [], [], []
        known = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
        for host, text, recurring in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), known, strict=True):
            if not text:
                continue
            page = Page(text)
            page.forget(recurring)
            again = page.recurring() if b.num_columns == 2 else []
            hosts += [host] * (1 + len(again))
            pages += [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)] * (1 + len(again))
            paths += [page.keys[page.best()], *[None] * len(again)]
            blocks += [None, *again]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(paths, pa.string()), pa.array(blocks, pa.int64())], names=["host", "page", "path", "block"])


def _extract(batches):
    for b in batches:
        texts = [main_text(*row) for row in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: str):
    return F.lower(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


VOTE = "host string, page long, path string, block long"


def host_rules(pages: DataFrame, votes: float = VOTES) -> DataFrame:
    """(host, paths, shares, blocks): the paths that enough of a host's pages vote for, by votes, then name, with their
    shares, and the blocks that recur on its different pages. Pages of hosts with recurring blocks vote without them."""
    pages = pages.select(host_of("url").alias("host"), "html").where("host IS NOT NULL")
    # one row for each different page and vote or block; a hot host's rows meet only as counts
    seen = materialize(pages.mapInArrow(_votes, VOTE).distinct(), "votes")
    total = seen.where("path IS NOT NULL").groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("pages"))
    often = seen.where("block IS NOT NULL").groupBy("host", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RECURS)
    blocks = often.join(total, F.col("host") == F.col("h")).where(F.col("n") >= RECURS_SHARE * F.col("pages")).groupBy("host").agg(F.collect_set("block").alias("blocks"))
    blocks = materialize(blocks.select(F.col("host").alias("b"), "blocks"), "recurring")
    own = seen.where("path IS NOT NULL").select("host", "page", "path")
    if blocks.limit(1).count():
        known = bounded(blocks, BROADCAST_HOSTS, F.octet_length("b") + 8 * F.size("blocks"), BROADCAST_BYTES)
        again = pages.join(known, F.col("host") == F.col("b")).select("host", "html", "blocks").mapInArrow(_votes, VOTE).distinct().select("host", "page", "path")
        own = own.join(known, F.col("host") == F.col("b"), "left_anti").unionAll(again)
    counts = own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(total, F.col("host") == F.col("h"))
    kept = counts.where((F.col("path") != "") & (F.col("n") >= votes * F.col("pages")))
    rows = kept.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("r"), "path", (F.col("n") / F.col("pages")).alias("share")))).alias("p"))
    out = rows.join(blocks, F.col("host") == F.col("b"), "full")
    return out.select(F.coalesce("host", "b").alias("host"), F.col("p.path").alias("paths"), F.col("p.share").alias("shares"), "blocks")


def extract(pages: DataFrame, votes: float = VOTES) -> DataFrame:
    """(page_id, url, text) for every row of pages(page_id, url, html)."""
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    known = materialize(host_rules(pages, votes), "host-rules").withColumnRenamed("host", "h")
    width = F.octet_length("h") + 48 * F.coalesce(F.size("paths"), F.lit(0)) + 8 * F.coalesce(F.size("blocks"), F.lit(0))
    both = pages.join(bounded(known, BROADCAST_HOSTS, width, BROADCAST_BYTES), host_of("url") == F.col("h"), "left").select("page_id", "url", "html", "paths", "shares", "blocks")
    return both.mapInArrow(_extract, "page_id long, url string, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
