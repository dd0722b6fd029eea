"""Main text of web pages with a site style tree.

By the meaning that HTML gives them, some elements never hold main text (nav, footer, aside, form, script, hidden ones,
an article inside an article, which is a reader's comment ...), and where a page has an article (else a main element)
only that is looked at. Of what is left, elements whose class or id names them as comments, adverts, notices or side matter go, if they
hold less than half of the text and no heading of the first level, article or main element. Such text is another on each page, so its entropy can't tell.

The rest of the DOMs of one host are merged: elements with the same chain of signatures (tag, class, id; digits count
as 0) are one node of the host's style tree. A node's m is the number of pages that have it; pages whose main text is the same count
once, since copies of a page don't make its text furniture. Presentation: a page shows a node in one style, the sequences of its
children's signatures; with k of m pages in a style, -sum p log_m p over p = k/m. Content: features are the texts and link targets
directly in an element; one on k of its node's m pages has entropy log_m k, and a node's content importance is 1 minus
the mean over all distinct features of itself and the nodes below. A node of l styles has importance
(1 - g**(l-1)) presentation + g**(l-1) content; one on a single page has importance 1.

A node below ``LEAST`` on ``SUPPORT`` or more pages is furniture, unless it holds more than half of the host's main text: what a
host's pages are about is no furniture. Its branch is taken out of each page. A page that is all furniture has an empty text.

Blocks are runs of text between block-level tags; character references are decoded, white space (Unicode's) is
turned into one space, a line break counts as white space, and blocks are joined by newlines in page order.

Each page is parsed once, in linear time; what is needed of it goes into a table. Elements below the ``LEVELS``-th level count as that
level's in the tree, and elements below ``DEPTH`` levels stand beside each other there; no text is lost by either.

Defined cases: null html is empty text; text outside any tag is a block; '<' after the last '>' is text; a page without a URL has the
host ''; broken and unclosed tags close as browsers close them; comments, scripts and declarations are dropped; repeated
pages get their text each; an empty table gives none; all columns but the html pass through, whatever their names, and one named
as the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import BROADCAST_ROWS, at_most, cut, stored, table

LEAST, SUPPORT, DAMPING = 0.2, 5, 0.9
#: Levels of the tree, levels of open elements, and pages in a worker's batch.
LEVELS, DEPTH, ROWS = 32, 512, 500

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag closes an open element of these, no further out than the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements and roles that HTML and ARIA define as something other than main text.
_DROP_TAGS = set("head title script style noscript template nav header footer aside form button select option textarea iframe frame svg canvas audio video object menu dialog xmp noframes".split())
_DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOP = {"#page", "html", "body"}
#: Words in a class or id by which sites name reader comments, adverts, notices and side matter.
_NAMED = set("ad ads advert adverts advertisement advertisements sponsored promo comment comments replies respond cookie cookies consent notice notices banner newsletter sidebar related social breadcrumb breadcrumbs".split())
_WORD = re.compile(r"[A-Za-z]+")


class Page:
    """A page's elements in page order, as lists by element: tag, up, path, own, children, drop, core; and its text.

    ``own`` is the element that stands for it in the tree. blocks: (element, text). links: (element, target).
    """

    def __init__(self, html: str):
        from xxhash import xxh64_intdigest

        self.hash = xxh64_intdigest
        self.tag, self.up, self.path, self.own, self.level = [], [], [], [], []
        self.children, self.drop, self.core, self.named, self.holds = [], [], [], [], set()
        self.blocks, self.links, self.buffer = [], [], []
        self.stack: list[int] = []
        self._open("#page", {})
        self._read(html)
        self._flush()

    def _read(self, html: str) -> None:
        at = scan = 0
        last = html.rfind(">")
        lost: set[int] = set()  # places outside of quotes from which no tag's end is found
        while (lt := html.find("<", scan)) >= 0:
            if html.startswith("<!--", lt):
                self.buffer.append(html[at:lt])
                end = html.find("-->", lt + 2)
                at = scan = end + 3 if end >= 0 else len(html)
            elif lt > last:
                scan = html.find("<!--", lt)
                if scan < 0:
                    break
            elif html[lt + 1] in "!?":
                self.buffer.append(html[at:lt])
                at = scan = html.find(">", lt) + 1
            elif m := _NAME.match(html, lt + 2 if html[lt + 1] == "/" else lt + 1):
                self.buffer.append(html[at:lt])
                tag = m[0].lower()
                if html[lt + 1] == "/":
                    at = scan = html.find(">", m.end()) + 1
                    self._end(tag)
                    continue
                end = self._tag_end(html, m.end(), lost)
                rest = html[m.end() : end]
                at = scan = end + 1
                self._start(tag, rest)
                if tag in _RAW and not rest.endswith("/"):
                    close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
                    at = scan = close.start() if close else len(html)
            else:
                scan = lt + 1
        self.buffer.append(html[at:])

    @staticmethod
    def _tag_end(html: str, at: int, lost: set[int]) -> int:
        """Where a start tag's '>' is: outside of quoted values, or the next one where a quote stays open.

        A search that finds none remembers its places; a later one that comes to any of them ends there, so all searches of a page are linear.
        """
        scan, seen = at, []
        while scan not in lost:
            m = _END.search(html, scan)
            if m is None:
                break
            if m[1] is None:
                return m.start()
            seen.append(scan)
            close = html.find(m[1], m.end())
            if close < 0:
                break
            scan = close + 1
        lost.update(seen)
        lost.add(scan)
        return html.find(">", at)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(unescape("".join(self.buffer)).split())
            self.buffer.clear()
            if text:
                self.blocks.append((self.stack[-1], text))

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
            return
        if tag in _BLOCK:
            self._flush()
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
            elif tag not in ("html", "body", "head"):
                self._close({"p"}, {"button", "table", "td", "th", "#page"})
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
        if tag == "a" and "href" in found:
            self.links.append((self.stack[-1], found["href"]))
        if tag not in _VOID and not (rest.endswith("/") and tag in ("svg", "path", "use")):
            self._open(tag, found)

    def _open(self, tag: str, found: dict) -> None:
        if len(self.stack) >= DEPTH:
            self.stack.pop()
        label = f"{found.get('class', '')} {found.get('id', '')}".strip() if found else ""
        signature = re.sub(r"\d+", "0", f"{tag}.{label}") if label else tag
        up = self.stack[-1] if self.stack else -1
        core = self.core[up] if up >= 0 else ""
        drop = up >= 0 and self.drop[up] or tag in _DROP_TAGS or tag == "article" and core == "article"
        if found and not drop and tag not in _TOP:
            drop = (
                found.get("role", "").lower() in _DROP_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
                or found.get("itemprop", "").lower() == "comment" or found.get("itemtype", "").endswith("schema.org/Comment")
            )
        if core != "article" and (tag in ("article", "main") or found.get("role", "").lower() == "main"):
            core = "article" if tag == "article" else "main"
        at, level = len(self.tag), self.level[up] + 1 if up >= 0 else 0
        named = self.named[up] if up >= 0 else ()
        if tag in ("h1", "article", "main"):
            self.holds.update(named)
        elif label and tag not in _TOP and not drop and not _NAMED.isdisjoint(_WORD.findall(label.lower())):
            named = (*named, at)
        self.named.append(named)
        self.tag.append(tag)
        self.up.append(up)
        self.level.append(level)
        self.own.append(self.own[up] if level > LEVELS else at)
        self.path.append(self.path[up] if level > LEVELS else self.hash(f"{self.path[up] if up >= 0 else ''}/{signature}"))
        self.children.append([])
        self.drop.append(drop)
        self.core.append(core)
        if up >= 0 and self.children[up][-1:] != [signature]:
            self.children[up].append(signature)
        self.stack.append(at)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
            return
        if tag in _BLOCK:
            self._flush()
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[k]]
            if own == tag:
                del self.stack[k:]
                return
            if tag not in _BLOCK and own in _BLOCK:
                return  # an inline end tag does not close a block

    def _close(self, tags: set, limit: set) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[k]]
            if own in tags:
                del self.stack[k:]
                return
            if own in limit or own in _BLOCK and own not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                return

    def kept(self) -> list[tuple[int, str]]:
        """The blocks of the page's article, or main element, or of all of it."""
        blocks = [(at, t) for at, t in self.blocks if not self.drop[at]]
        cores = {self.core[at] for at, _ in blocks}
        core = "article" if "article" in cores else "main" if "main" in cores else ""
        blocks = [(at, t) for at, t in blocks if not core or self.core[at] == core]
        # What is named as side matter goes, unless it holds the page's heading or half of its text: then the name says something else.
        chars: dict[int, int] = {}
        for at, t in blocks:
            for k in self.named[at]:
                chars[k] = chars.get(k, 0) + len(t)
        half = sum(len(t) for _, t in blocks) / 2
        gone = {k for k, n in chars.items() if n < half and k not in self.holds}
        return [(at, t) for at, t in blocks if gone.isdisjoint(self.named[at])] if gone else blocks

    def branches(self, kept: list[tuple[int, str]]) -> tuple[list, list, list]:
        """Of the elements that hold kept blocks: (path, style, chars, chain of paths) by path; (number of its path, from, to) of each element, a range
        of blocks; and the distinct (number of a path, feature)."""
        n = len(self.tag)
        first, end, chars = [len(kept)] * n, [0] * n, [0] * n
        for i, (at, t) in enumerate(kept):
            own = self.own[at]
            first[own], end[own], chars[own] = min(first[own], i), i + 1, chars[own] + len(t)
        for at in range(n - 1, 0, -1):  # elements stand after those that hold them
            if end[at] and self.own[at] == at:
                up = self.own[self.up[at]]
                first[up], end[up], chars[up] = min(first[up], first[at]), max(end[up], end[at]), chars[up] + chars[at]
        number, paths, styles, ranges = {}, [], [], []
        for at in range(n):
            if not end[at] or self.own[at] != at or self.tag[at] in _TOP:
                continue
            path, up = self.path[at], number.get(self.path[self.up[at]])
            k = number.setdefault(path, len(paths))
            if k == len(paths):
                paths.append([path, 0, 0, [*(paths[up][3] if up is not None else []), path]])
                styles.append([])
            paths[k][2] += chars[at]
            style = "\x1f".join(self.children[at])
            if style not in styles[k]:
                styles[k].append(style)
            ranges.append((k, first[at], end[at]))
        for p, s in zip(paths, styles, strict=True):
            p[1] = self.hash("\x1e".join(s))
        features = {(number[self.path[at]], self.hash(t)): None for at, t in [*kept, *((i, f"href {u}") for i, u in self.links)] if self.path[at] in number}
        return paths, ranges, list(features)


_FOUND = "version long, page_key long, blocks array<string>, paths array<struct<path:long,style:long,chars:long,chain:array<long>>>, ranges array<struct<p:int,from:int,to:int>>, features array<struct<p:int,feature:long>>"


def _lists(parts: list[list], build) -> pa.ListArray:
    """A list column of ``parts``, its values made by ``build`` from all of them end to end."""
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), build([x for p in parts for x in p]))


def _longs(values) -> pa.Array:
    return pa.array(np.array(list(values), np.uint64).view(np.int64))


def _struct(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def _columns(htmls: list) -> list[pa.Array]:
    from xxhash import xxh64_intdigest as digest

    versions, keys, blocks, paths, ranges, features = [], [], [], [], [], []
    for html in htmls:
        page = Page(html or "")
        kept = page.kept()
        texts = [t for _, t in kept]
        p, r, f = page.branches(kept)
        versions.append(digest((html or "").encode("utf-8", "surrogatepass")))
        keys.append(digest("\n".join(texts).encode("utf-8", "surrogatepass")))
        blocks.append(texts)
        paths.append(p)
        ranges.append(r)
        features.append(f)
    ints = lambda rows, k: pa.array([x[k] for x in rows], pa.int32())
    return [
        _longs(versions), _longs(keys), _lists(blocks, lambda x: pa.array(x, pa.string())),
        _lists(paths, lambda x: _struct(path=_longs(p[0] for p in x), style=_longs(p[1] for p in x), chars=pa.array([p[2] for p in x], pa.int64()), chain=_lists([p[3] for p in x], _longs))),
        _lists(ranges, lambda x: _struct(p=ints(x, 0), **{"from": ints(x, 1), "to": ints(x, 2)})),
        _lists(features, lambda x: _struct(p=ints(x, 0), feature=_longs(f[1] for f in x))),
    ]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def parsed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(row, site, version, page_key, blocks, paths, ranges, features): the columns but html, a hash of the host, and what ``Page`` finds."""
    rest = [F.col(c) for c in pages.columns if c != html]
    rows = pages.select(F.struct(*rest).alias("row"), F.xxhash64(host_of(F.col(url))).alias("site"), F.col(html).alias("html"))
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL(_FOUND).fields])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("site"), *_columns(part.column("html").to_pylist())], names=schema.names)

    return rows.mapInArrow(found, schema)


def importance(found: DataFrame) -> DataFrame:
    """(site, path, m, importance, share) of every node, from ``parsed``; share is that of the site's text that it holds."""
    pages = found.groupBy("site", "page_key").agg(F.min_by(F.struct("paths", "features"), "version").alias("p")).select("site", "p.*")
    path = F.col("paths")[F.col("f.p")]["path"]
    styled = pages.select("site", F.explode_outer("paths").alias("n")).where("n is not null").groupBy("site", "n.path", "n.style").agg(F.count("*").alias("k"), F.sum("n.chars").alias("chars"), F.first("n.chain").alias("chain"))
    nodes = styled.groupBy("site", "path").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.ln("k")).alias("s"), F.count("*").alias("styles"), F.sum("chars").alias("chars"), F.first("chain").alias("chain"))
    nodes = cut(nodes.withColumn("base", F.ln(F.greatest("m", F.lit(2)))))
    features = pages.select("site", "paths", F.explode_outer("features").alias("f")).where("f is not null").select("site", path.alias("path"), "f.feature").groupBy("site", "path", "feature").agg(F.count("*").alias("k"))
    leaves = features.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum(F.ln("k")).alias("lnk")).join(nodes, ["site", "path"])
    below = leaves.select("site", "n", (F.col("n") - F.col("lnk") / F.col("base")).alias("c"), F.explode("chain").alias("path")).groupBy("site", "path").agg((F.sum("c") / F.sum("n")).alias("content"))
    presentation = (F.col("base") - F.col("s") / F.col("m")) / F.col("base")
    damp = F.pow(F.lit(DAMPING), F.col("styles") - 1)
    worth = F.when(F.col("m") < 2, 1.0).otherwise((1 - damp) * presentation + damp * F.coalesce("content", F.lit(0.0)))
    # Nodes without a node above hold all text that is in any.
    whole = nodes.where("size(chain) = 1").groupBy("site").agg(F.sum("chars").alias("all_chars"))
    return nodes.join(below, ["site", "path"], "left").join(whole, "site").select("site", "path", "m", worth.alias("importance"), (F.col("chars") / F.greatest("all_chars", F.lit(1))).alias("share"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", least: float = LEAST, support: int = SUPPORT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` without the html, with the main text of each. The furniture of a host is one row, broadcast if a count allows."""
    found = stored(parsed(pages, url, html))
    low = importance(found).where((F.col("importance") < least) & (F.col("m") >= support) & (F.col("share") <= 0.5))
    low = cut(low.groupBy(F.col("site").alias("low_site")).agg(F.collect_set("path").alias("low")))
    few = at_most(low, broadcast_rows) and (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= broadcast_rows
    joined = found.join(F.broadcast(low) if few else low, F.col("site") == F.col("low_site"), "left")
    # The blocks of furniture are ranges; sets of numbers leave the others.
    joined = joined.withColumn("hit", F.array_intersect(F.transform("paths", lambda p: p["path"]), F.coalesce("low", F.array().cast("array<bigint>"))))
    gone = F.filter("ranges", lambda r: F.array_contains("hit", F.col("paths")[r["p"]]["path"]))
    numbers = F.flatten(F.transform(gone, lambda r: F.sequence(r["from"], r["to"] - 1)))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size("blocks") - 1), numbers), lambda i: F.col("blocks")[i])
    text = F.array_join(F.when(F.size("hit") == 0, F.col("blocks")).otherwise(rest), "\n")
    names = [c for c in pages.columns if c not in (html, out)]
    # In two steps, since a column of the input may have the name of one used here.
    return joined.select("row", text.alias("main")).select(*[F.col("row")[c].alias(c) for c in names], F.col("main").alias(out))


def op4_html_extract(spark, sf_dir) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
