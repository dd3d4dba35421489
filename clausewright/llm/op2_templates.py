"""HTML extraction with site template removal.

Each block element of a page is hashed with all it holds (tag, id, class, children, text). Spark counts in how many distinct pages
of a host each hash occurs (pages of equal html count once). An element of the page's frame is template, and is deleted with its
subtree, if it occurs in ``MIN_PAGES`` pages or more and in ``SHARE`` of the host's pages or more: hosts have many layouts. Frame
is what stands outside article and main: ``FRAME`` elements, and on pages that have an article or main also the other blocks that
don't hold it. All else is content: titles, paragraphs, cells and articles recur by chance or by copying, so ``CONTENT_SHARE`` of
the host's pages is asked there. Equal elements of frame and content are told apart. What is left gives the text: one line for each block, entities resolved, scripts, styles and the
head left out.

Defined results
* null or empty html: empty text, nothing removed; null or malformed url: host null, and no template is ever removed there;
* null ``page_id``: extracted like any other; rows that repeat a page of a host are extracted each, and counted once; elements that are never closed end with their parent, stray end tags are ignored; a ``<`` that begins no
  tag or has no ``>`` is text; after a tag whose quotes are never closed quotes have no meaning; pages are read in time linear in
  their length, however malformed;
* extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import textvec
from clausewright.session import cut, require

MIN_PAGES, SHARE, CONTENT_SHARE = 5, 0.01, 0.5
#: Template hashes are sent to the workers up to this number (16 MB); more are joined to the pages by host.
BROADCAST_HASHES = 2_000_000
BLOCKS = frozenset("address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
FRAME = frozenset("nav footer header aside menu form dialog address".split())
BODIES = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template svg iframe".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW = frozenset("script style textarea title noscript template svg iframe".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""\b(id|class)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_STOP = re.compile(r"[>\"']")
_SPACE = re.compile(r"\s+")
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType()), T.StructField("chars_removed", T.IntegerType())])
_HASHES = T.StructType([T.StructField("host", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("content", T.BooleanType()), T.StructField("page", T.LongType())])
#: Html of a host that one task takes when hashes are joined; hosts above it are broadcast up to this number.
SLICE_BYTES, BROADCAST_HOSTS = 64 << 20, 500_000
#: Keys of content elements are their hashes changed by this.
_CONTENT = 0x9E3779B97F4A7C15


class Node:
    __slots__ = ("body", "children", "hash", "mark", "tag")

    def __init__(self, tag: str, mark: str):
        self.tag, self.mark, self.children, self.hash = tag, mark, [], 0
        self.body = tag in BODIES  # whether it is an article or main, or holds one


def _close(node: Node) -> None:
    h = xxhash.xxh64(node.mark)
    for child in node.children:
        h.update(child if isinstance(child, str) else child.hash.to_bytes(8, "little"))
        h.update("\x00")
        node.body |= not isinstance(child, str) and child.body
    node.hash = h.intdigest()


def _tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of what isn't text, in order; the name is empty for comments, declarations and
    elements whose text is not content. One pass: nothing is looked for again beyond a place where it was found missing."""
    at, last, quoted = 0, source.rfind(">"), True
    while True:
        lt = source.find("<", at)
        if lt < 0:
            return
        at = lt + 1
        following = source[at : at + 1]
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(source)
            yield lt, at, "", False, ""
            continue
        if lt > last:
            continue  # no tag ends beyond here; comments may still begin
        if following in ("!", "?"):
            at = source.index(">", at) + 1
            yield lt, at, "", False, ""
            continue
        closing = following == "/"
        name = _NAME.match(source, at + closing)
        if not name:
            continue
        end, tag = name.end(), name[0].lower()
        if quoted:  # the tag ends at the first > outside of quotes
            while (m := _STOP.search(source, end)) and m[0] != ">":
                close = source.find(m[0], m.end())
                end = close + 1 if close >= 0 else len(source)
            if m:
                end = m.start()
            else:
                quoted = False  # a quote is never closed: from here on quotes have no meaning
        if not quoted:
            end = source.index(">", name.end())
        at = end + 1
        if tag in RAW and not closing:
            m = _RAW_END[tag].search(source, at)
            at = m.end() if m else len(source)
            yield lt, at, "", False, ""
        else:
            yield lt, at, tag, closing, source[name.end() : end]


def parse(source: str) -> Node:
    """The tree of a page: children are nodes and strings of white-space-normalised text. Hashes are set from the leaves up."""
    root = Node("", "")
    stack = [root]
    opened: Counter[str] = Counter()
    at = 0

    def text(upto: int) -> None:
        if upto > at:
            piece = _SPACE.sub(" ", source[at:upto])
            if piece != " " or stack[-1].tag not in BLOCKS:
                stack[-1].children.append(piece)

    def pop(n: int) -> None:
        while len(stack) > n:
            opened[stack[-1].tag] -= 1
            _close(stack.pop())

    def upto(tag: str) -> None:
        """Ends the innermost open element of this name, and what is open inside."""
        if opened[tag] > 0:
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            pop(k)

    for start, end, tag, closing, attributes in _tags(source):
        text(start)
        at = end
        if not tag:
            continue
        if closing:
            upto(tag)
            continue
        if tag in BLOCKS:  # a block ends an open paragraph; there is one at most, and no other block lies inside it
            upto("p")
        if stack[-1].tag in _CLOSED_BY.get(tag, ()):
            pop(len(stack) - 1)
        marks = "".join(sorted(f" {k.lower()}={v.strip(chr(34) + chr(39))}" for k, v in _ATTRIBUTE.findall(attributes))) if attributes else ""
        node = Node(tag, tag + marks)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/"):
            _close(node)
        else:
            opened[tag] += 1
            stack.append(node)
    text(len(source))
    pop(0)
    return root


def _content(node: Node, inside: bool, split: bool) -> bool:
    """Whether a block is content. ``inside``: in an article or main; ``split``: its page has one."""
    return inside or node.body or not (split or node.tag in FRAME)


def _key(node: Node, content: bool) -> int:
    return node.hash ^ _CONTENT if content else node.hash


def block_hashes(root: Node) -> dict[int, bool]:
    """Keys of all block elements that hold something, and whether they are content."""
    found, todo = {}, [(root, False)]
    while todo:
        node, inside = todo.pop()
        for child in node.children:
            if not isinstance(child, str):
                if child.tag in BLOCKS and child.children:
                    content = _content(child, inside, root.body)
                    found[_key(child, content)] = content
                todo.append((child, inside or child.tag in BODIES))
    return found


def _gather(root: Node, template: set[int] | frozenset[int]) -> tuple[list[str], int, list[str]]:
    kept: list[str] = []
    gone: list[str] = []
    removed = 0
    todo: list[tuple[object, list[str], bool]] = [(root, kept, False)]
    while todo:
        item, out, inside = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if item.tag in SILENT:
            continue
        if out is kept and item.tag in BLOCKS and item.children and _key(item, _content(item, inside, root.body)) in template:
            removed += 1
            out = gone
        edge = "\n" if item.tag in BLOCKS or item.tag == "br" else ""
        if edge:
            out.append(edge)
            todo.append((edge, out, inside))
        inside = inside or item.tag in BODIES
        todo += [(child, out, inside) for child in reversed(item.children)]
    return kept, removed, gone


def _lines(parts: list[str]) -> str:
    lines = (_SPACE.sub(" ", html.unescape(line)).strip() for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def extract(source: str | None, template: set[int] | frozenset[int] = frozenset()) -> tuple[str, int, int]:
    """(text, subtrees removed, characters of text in them)."""
    kept, removed, gone = _gather(parse(source or ""), template)
    return _lines(kept), removed, len(_lines(gone))


def host_of(url: str = "url") -> F.Column:
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hash) of the template elements. ``pages`` has host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.sliced(batches):
            hosts, hashes, content, marks = [], [], [], []
            for host, source, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = block_hashes(parse(source))
                hosts += [host] * len(found)
                hashes += map(_signed, found)
                content += found.values()
                marks += [page] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(content, pa.bool_()), pa.array(marks, pa.int64())], _HASHES.names)

    used = pages.where("host IS NOT NULL AND html IS NOT NULL").select("host", "html", F.xxhash64("html").alias("page"))
    counts = used.mapInArrow(run, _HASHES).groupBy("host", "hash", "content").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    totals = used.groupBy("host").agg(F.count_distinct("page").alias("total"))
    least = F.when(F.col("content"), F.greatest(F.lit(share), F.lit(CONTENT_SHARE))).otherwise(F.lit(share))
    return counts.join(totals, "host").where(F.col("pages") >= least * F.col("total")).select("host", "hash")


def strip(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, host, text, removed and chars_removed of every page."""
    pages = require(pages, {"page_id": T.LongType(), "url": T.StringType(), "html": T.StringType()}).select("page_id", host_of().alias("host"), "html")
    found = cut(templates(pages, min_pages, share), "templates")

    def rows(ids: list, hosts: list, sources: list, of: Iterator[frozenset[int]]) -> pa.RecordBatch:
        done = [extract(s, t) for s, t in zip(sources, of, strict=True)]
        columns = [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, SCHEMA.names)

    if found.count() <= BROADCAST_HASHES:
        known = found.groupBy("host").agg(F.collect_list("hash").alias("hashes")).toArrow()
        by_host = {h: np.array(x, np.int64).view(np.uint64) for h, x in zip(known["host"].to_pylist(), known["hashes"].to_pylist(), strict=True)}
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets: dict[str | None, frozenset[int]] = {None: frozenset()}
            for batch in textvec.sliced(batches):
                ids, hosts, sources = (c.to_pylist() for c in batch.columns)
                for h in set(hosts) - sets.keys():
                    sets[h] = frozenset(shared.value[h].tolist()) if h in shared.value else frozenset()
                yield rows(ids, hosts, sources, (sets[h] for h in hosts))

        return pages.mapInArrow(narrow, SCHEMA)

    # pages and hashes of a host meet in slices of about SLICE_BYTES of html; each hash is sent once to each slice of its host
    bytes_of = pages.where("host IS NOT NULL").groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"))
    large = cut(bytes_of.where(F.col("bytes") > SLICE_BYTES).select(F.col("host").alias("of"), F.ceil(F.col("bytes") / SLICE_BYTES).alias("slices")), "large-hosts")
    if large.count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    n = F.coalesce("slices", F.lit(1))
    row = F.xxhash64(F.monotonically_increasing_id())
    left = pages.withColumn("row", row).where("host IS NOT NULL").join(large, F.col("host") == F.col("of"), "left").select("page_id", "host", "html", F.pmod("row", n).alias("slice"))
    right = found.join(large, F.col("host") == F.col("of"), "left").select("host", "hash", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("slice"))

    def wide(pages: pa.Table, hashes: pa.Table) -> pa.Table:
        known = frozenset(h + (1 << 64) if h < 0 else h for h in hashes.column("hash").to_pylist())
        done = []
        for batch in textvec.sliced(iter(pages.to_batches())):
            ids, hosts, sources = (batch.column(c).to_pylist() for c in ("page_id", "host", "html"))
            done.append(rows(ids, hosts, sources, repeat(known, len(ids))))
        return pa.Table.from_batches(done) if done else pa.Table.from_batches([rows([], [], [], iter(()))])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.sliced(batches):
            ids, hosts, sources = (c.to_pylist() for c in batch.columns)
            yield rows(ids, hosts, sources, repeat(frozenset(), len(ids)))

    stripped = left.groupBy("host", "slice").cogroup(right.groupBy("host", "slice")).applyInArrow(wide, SCHEMA)
    return stripped.unionByName(pages.where("host IS NULL").mapInArrow(plain, SCHEMA))
