"""Main text of web pages by site style trees.

The element trees of one host are merged by path (tags and classes from the root).  A path's
importance combines the entropy of its presentation (the sequence of child elements) and of
its content (what it says from page to page), both to the base of the number of nodes:
branches that look and read alike all over a site have none and are cut from every page.
Copies of one page count once.  Elements whose tag, role or class names them as menu, header,
footer, advert, form, comment and the like go in any case; of what stays, the article is
taken where a page marks one, else the main part, else the body.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Importance under which a branch is cut, and nodes a path needs for a judgement.
LEAST_IMPORTANCE = 0.2
LEAST_NODES = 8
ATTENUATION = 0.9
SALTS = 32

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th article main body html".split()) | INLINE
CLOSED_BY_ITSELF = frozenset("li dt dd tr td th option thead tbody tfoot".split())
DROPPED_TAGS = frozenset(
    "head nav header footer aside form button select option input menu dialog svg canvas object embed audio video map".split()
) | RAW
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
)
DROPPED_NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription "
    "signup sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead "
    "header footer comment comments commentlist reply replies respond disqus share sharing social related recommended "
    "login search toolbar pagination pager copyright disclaimer"
).split()

_NAME = "|".join(DROPPED_NAMES)
_DROPPED = re.compile(rf"(?:{_NAME})(?:[-_].*)?|(?!(?:no|has|with|without|is)[-_]).*[-_](?:{_NAME})", re.S)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|</[^a-zA-Z>][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Page:
    """Elements of a page in order, each with its parent, path and whether it is dropped by name."""

    __slots__ = ("tags", "parents", "paths", "dropped", "parts", "children", "_names")

    def __init__(self, source: str | None):
        self.tags, self.parents, self.paths, self.dropped = ["#"], [-1], [0], [False]
        #: (element, text), or (element, None) where a block begins or ends.
        self.parts: list[tuple[int, str | None]] = []
        self.children: list[list[str]] = [[]]
        self._names: list[bool] = [False]
        if source:
            self._read(source)

    def _read(self, source: str) -> None:
        stack, at, mark = [0], 0, source.find("<")
        while True:
            found = _TOKEN.match(source, mark) if mark >= 0 else None
            if mark >= 0 and not found:
                mark = source.find("<", mark + 1)
                continue
            text = source[at:mark] if found else source[at:]
            if text:
                self.parts.append((stack[-1], html.unescape(text) if "&" in text else text))
            if not found:
                return
            at = found.end()
            mark = source.find("<", at)
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._close(stack, name)
                continue
            attributes = found[3] if found[2] else found[6]
            node = self._open(stack, name, attributes)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                mark = source.find("<", at)
            elif name not in VOID and not attributes.endswith("/"):
                stack.append(node)

    def _close(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if self.tags[stack[depth]] == name:
                if name not in INLINE:
                    self.parts.append((stack[depth], None))
                del stack[depth:]
                return

    def _open(self, stack: list[int], name: str, attributes: str) -> int:
        if name not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[depth]]
                if tag == "p" or tag == name and name in CLOSED_BY_ITSELF:
                    del stack[depth:]
                elif tag not in INLINE:
                    break
        parent, node = stack[-1], len(self.tags)
        own, by_tag, by_name = name, name in DROPPED_TAGS, False
        if "=" in attributes:
            given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            names = (given.get("class", "") + " " + given.get("id", "")).lower().split()
            by_name = any(map(_DROPPED.fullmatch, names)) or given.get("role", "").lower() in DROPPED_ROLES
            own = f"{name}.{'.'.join(sorted(re.sub(r'[0-9]+', '', c) for c in given.get('class', '').lower().split()))}"
            if given.get("role", "").lower() == "main":
                name = "main"
        if name in ("article", "main") and not by_tag:
            # What holds the article is no advert, whatever it is called.
            up = parent
            while up > 0:
                self._names[up] = False
                up = self.parents[up]
        self.tags.append(name)
        self.parents.append(parent)
        self.paths.append(xxhash.xxh64_intdigest(own, self.paths[parent]))
        self.dropped.append(by_tag)
        self._names.append(by_name and name not in ("html", "body"))
        self.children[parent].append(own)
        self.children.append([])
        if name not in INLINE:
            self.parts.append((node, None))
        elif name == "br":
            self.parts.append((parent, " "))
        return node

    def _kept(self, noise: frozenset[int]) -> list[bool]:
        kept = [True]
        for node in range(1, len(self.tags)):
            gone = self.dropped[node] or self._names[node]
            if not gone and noise and self.paths[node] in noise and self.tags[node] not in PROSE:
                gone = True
            kept.append(kept[self.parents[node]] and not gone)
        return kept

    def _inside(self, kept: list[bool]) -> list[bool]:
        """Elements of the articles, else of the main parts, else all."""
        for tag in ("article", "main"):
            inside = [False]
            for node in range(1, len(self.tags)):
                inside.append(kept[node] and (inside[self.parents[node]] or self.tags[node] == tag))
            if any(inside):
                return inside
        return kept

    def blocks(self, noise: frozenset[int] = frozenset()) -> list[str]:
        inside = self._inside(self._kept(noise))
        out, own = [], []
        for node, text in [*self.parts, (0, None)]:
            if text is None:
                if own and (block := " ".join("".join(own).split())):
                    out.append(block)
                own = []
            elif inside[node]:
                own.append(text)
        return out

    def nodes(self) -> list[tuple[int, int, int, int]]:
        """(path, style, content, children) of the containers that could be cut."""
        inside = self._inside(self._kept(frozenset()))
        if not any(ok and tag not in PROSE for ok, tag in zip(inside, self.tags)):
            return []
        said: list[list[str]] = [[] for _ in self.tags]
        for node, text in self.parts:
            if text and inside[node]:
                said[node].append(text)
        out = []
        for node in range(len(self.tags) - 1, 0, -1):
            said[self.parents[node]] += said[node]
            if inside[node] and self.tags[node] not in PROSE:
                content = " ".join("".join(said[node]).split())
                style = " ".join(self.children[node])
                out.append(
                    (_signed(self.paths[node]), _signed(xxhash.xxh64_intdigest(style)), _signed(xxhash.xxh64_intdigest(content)), len(self.children[node]))
                )
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def site_noise(pages: DataFrame) -> DataFrame:
    """(host, noise): the paths of each host whose branches are cut.

    `pages` has host and html.  Nodes are counted, never gathered: a host of any size is
    summed by path before its (few) low-importance paths meet in one row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                page = Page(source)
                if nodes := page.nodes():
                    said = xxhash.xxh64_intdigest("\n".join(page.blocks()))
                    rows.append((host, _signed(said), [dict(zip(("path", "style", "content", "width"), n)) for n in nodes]))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("path", "style", "content", "width")]))
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), kind))], ["host", "said", "nodes"]
            )

    struct = "array<struct<path: long, style: long, content: long, width: long>>"
    once = (
        pages.select("host", "html").mapInArrow(read, f"host string, said long, nodes {struct}")
        .groupBy("host", "said").agg(F.first("nodes").alias("nodes"))
    )
    node = once.select("host", F.explode("nodes").alias("n")).select("host", "n.*")

    def entropy(column: str) -> DataFrame:
        """1 - sum(n ln n) / (m ln m): the entropy of the column per path, to the base m."""
        each = node.groupBy("host", "path", column).agg(F.count("*").alias("n"), F.sum("width").alias("width"))
        return each.groupBy("host", "path").agg(
            F.sum("n").alias("m"), (F.sum("width") / F.sum("n")).alias("width"),
            (1 - F.sum(F.col("n") * F.ln("n")) / (F.sum("n") * F.ln(F.sum("n")))).alias(column),
        ).filter(F.col("m") >= LEAST_NODES)

    fade = F.pow(F.lit(ATTENUATION), F.col("width"))
    importance = (1 - fade) * F.col("style") + fade * F.col("content")
    return (
        entropy("style").join(entropy("content").drop("m", "width"), ["host", "path"])
        .filter(importance < LEAST_IMPORTANCE).groupBy("host").agg(F.collect_set("path").alias("noise"))
    )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page row.

    Null and empty html give an empty text; null or odd urls share one host; repeated rows are
    separate pages; an empty table gives no rows.  Character references are decoded, white
    space inside a block becomes one space, blocks are joined by one line break; line-break
    elements are white space.  Unclosed tags and comments end with the page.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    given = pages.select(
        F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"),
        F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit(""))).alias("host"),
    )
    # One host may have a third of all pages: its pages are dealt to SALTS parts, its noise to each.
    noise = site_noise(given).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = given.withColumn("salt", F.pmod(F.xxhash64("id", "html"), F.lit(SALTS)).cast("int"))
    joined = salted.join(noise, ["host", "salt"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, noise in zip(b.column("html").to_pylist(), b.column("noise").to_pylist()):
                cut = frozenset(n % (1 << 64) for n in noise or ())
                texts.append("\n".join(Page(source).blocks(cut)))
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array(texts, pa.string()), lengths], ["id", "url", "text", "n_chars"]
            )

    return joined.select("id", "url", "html", "noise").mapInArrow(
        read, f"id {kind}, url string, text string, n_chars long"
    )
