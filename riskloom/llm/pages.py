"""Main text of web pages: lines that a page shares with its nearest neighbour on the host go.

Pages of a host are put in order of their path; each is paired with the page nearest to it by path
that is not a copy of it. The text lines of the two are aligned by a longest common subsequence, and
shared lines are deleted. Marked parts of a page are told apart while it is read: lines of an
article are never deleted, and parts marked as menus, adverts and the like go even if no neighbour has them.
Pages meet as lists of 64-bit line hashes; lines that can be main text are moved once, packed, to meet the
decisions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.alignment import common_lines
from riskloom.llm.batches import bounded_rows, group_starts, whole_groups
from riskloom.operators.ordering import global_rank
from riskloom.plans.materialise import stored

# Elements that break a line, that hold no text, that are not part of the main text, and
# words of a class, id or role that mark such parts.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
ASIDE = frozenset("nav header footer aside form button select option dialog menu label fieldset head".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright disqus footer form gdpr header masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification pagination pager popup promo promoted related search "
    "share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ARTICLE = frozenset(("article", "main"))
# An opening of one of these ends open paragraphs and list items of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOUNDS = frozenset("ul ol dl table div section article main body nav aside header footer form blockquote td th".split())

# A comment, a tag whose quotes close, any other tag, a declaration, a tag that the end of the page cuts.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z""", re.S,
)
NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")
# Layout names such as "with-sidebar" say what a part has, not what it is.
ABOUT = frozenset(("has", "with", "no", "without"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# Kinds of lines: of a marked part, plain, of the article.
MARKED, PLAIN, MAIN = 0, 1, 2
# Pages of a block of neighbours, and how far to look on either side for one that is no copy.
BLOCK_PAGES, REACH = 512, 4
SITE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#]+)([^?#]*)"


class Line(NamedTuple):
    """A text line of a page."""

    text: str
    kind: int


def _is_marked(name: str, attributes: str, main: bool) -> bool:
    """Whether an element is not part of the main text: by its name, or by words of its class, id or role.

    Of an article only comments count, and of headings and parts of an article the word header does not.
    """
    if name in ASIDE:
        return True
    if "=" not in attributes or name in ("body", "html", "main"):
        return False
    wanted = ("comment", "comments") if name == "article" else MARKS
    for value in NAMES.findall(attributes):
        for one in value.strip("\"'").lower().split():
            words = WORDS.findall(one)
            if words and words[0] not in ABOUT and any(
                w in wanted and not (w == "header" and (main or name in HEADINGS)) for w in words
            ):
                return True
    return False


def _closes_later(page: str, at: int, stack: list[tuple[str, bool, bool]]) -> bool:
    """Whether the outermost marked element that is open is closed somewhere after ``at``."""
    name = next(name for name, marked, _ in stack if marked)
    return re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at) is not None


def page_lines(page: str | None) -> list[Line]:
    """Text lines of a page in order, white space inside a line made one space.

    Ends of elements that were never opened are passed over; elements that are never closed
    end with what holds them, and a marked part that is never closed ends where an article starts.
    """
    if not page:
        return []
    lines: list[Line] = []
    held: list[str] = []
    # Open elements: name, whether marked here or above, whether inside an article.
    stack: list[tuple[str, bool, bool]] = []
    opened: dict[str, int] = {}

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                marked, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                lines.append(Line(text, MARKED if marked else MAIN if main else PLAIN))

    def close(name: str) -> None:
        while stack:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    at = 0
    while True:
        tag = TAG.search(page, at)
        if tag is None:
            break
        if tag.start() > at:
            held.append(page[at:tag.start()])
        at = tag.end()
        ends, name, attributes = tag.group(1, 2, 3) if tag.group(2) else tag.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if ends:
            if opened.get(name):
                if name in INLINE:
                    # An inline end never closes a block.
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == name:
                            del stack[depth]
                            opened[name] -= 1
                            break
                        if stack[depth][0] not in INLINE:
                            break
                else:
                    close(name)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        for same in CLOSES.get(name, ()):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == same:
                    close(same)
                    break
                if stack[depth][0] in BOUNDS:
                    break
        if name == "body":
            while stack and stack[-1][0] != "html":
                opened[stack.pop()[0]] -= 1
        marked, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        here = _is_marked(name, attributes, main)
        if name in INLINE and not here and not (stack and stack[-1][0] in INLINE):
            # Plain inline elements change nothing; only their marks matter.
            continue
        if name in ARTICLE and not main and not here and not (marked and _closes_later(page, at, stack)):
            marked, main = False, True
        if here and name in INLINE:
            flush()
        stack.append((name, marked or here, main))
        opened[name] = opened.get(name, 0) + 1
    held.append(page[at:])
    flush()
    return lines


def outline(page: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, kinds and lengths of the lines of a page."""
    lines = page_lines(page)
    return (
        np.array([xxhash.xxh64_intdigest(x.text.encode("utf-8", "replace")) for x in lines], np.uint64).view(np.int64),
        np.array([x.kind for x in lines], np.int8), np.array([len(x.text) for x in lines], np.int32),
    )


def wanted_lines(lines: list[Line]) -> tuple[list[str], list[int]]:
    """The lines that can be main text, and the places of those that a neighbour may strike out.

    These are the article's lines, none of which can be struck out, or without an article the plain lines.
    """
    if any(x.kind == MAIN for x in lines):
        return [x.text for x in lines if x.kind == MAIN], []
    plain = [n for n, x in enumerate(lines) if x.kind == PLAIN]
    return [lines[n].text for n in plain], plain


def main_text(lines: list[Line], shared: set[int] | frozenset[int] = frozenset()) -> str:
    """The main text of a page's lines: what can be main text and is not ``shared``.

    A page whose marks leave nothing has the empty text.
    """
    said, places = wanted_lines(lines)
    return " ".join(x for x, n in zip(said, places) if n not in shared) if places else " ".join(said)


def near_order(place: int, hosts: list[str], paths: list[list[str]], reach: int = REACH) -> list[int]:
    """Neighbours of the page at ``place`` on its host, nearest by path first.

    Nearer means more leading path segments in common, then fewer pages between, then before.
    """
    around = [
        n for n in range(max(0, place - reach), min(len(hosts), place + reach + 1))
        if n != place and hosts[n] == hosts[place]
    ]

    def common(n: int) -> int:
        same = 0
        for x, y in zip(paths[n], paths[place]):
            if x != y:
                break
            same += 1
        return same

    return sorted(around, key=lambda n: (-common(n), abs(n - place), n))


def shared_lines(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray] | None:
    """Lines (positions in each) of the common subsequence of two outlines; None where the pages are copies.

    Pages are copies when they share the longest line of either: templates hold short lines, articles long ones.
    """
    x, y = common_lines(a[0], b[0])
    for lines, at in ((a, x), (b, y)):
        if len(lines[0]) and len(at) and int(lines[2].argmax()) in set(at.tolist()):
            return None
    return x, y


def _decisions(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring outlines to the shared lines of each page of the block."""
    for whole in whole_groups(parts, ["block"], 4 * BLOCK_PAGES):
        starts = group_starts(whole, ["block"])
        for begin, end in zip(starts, np.append(starts[1:], whole.num_rows)):
            rows = whole.slice(begin, end - begin)
            hosts = rows.column("host").to_pylist()
            paths = [p.split("/") for p in rows.column("path").to_pylist()]
            outlines = [
                (np.frombuffer(h, "<i8"), np.frombuffer(k, np.int8), np.frombuffer(n, "<i4"))
                for h, k, n in zip(*[rows.column(c).to_pylist() for c in ("hashes", "kinds", "lengths")])
            ]
            own = np.flatnonzero(rows.column("own").to_numpy(zero_copy_only=False))
            known: dict[tuple[int, int], object] = {}
            found = []
            for place in own.tolist():
                gone = np.zeros(0, np.int64)
                for near in near_order(place, hosts, paths):
                    pair = (min(place, near), max(place, near))
                    if pair not in known:
                        known[pair] = shared_lines(outlines[pair[0]], outlines[pair[1]])
                    if known[pair] is not None:
                        gone = known[pair][0 if place < near else 1]
                        break
                found.append(gone)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([
                rows.column("m1").combine_chunks().take(at), rows.column("m2").combine_chunks().take(at),
                pa.array([g.astype("<i4").tobytes() for g in found], pa.binary()),
            ], ["m1", "m2", "shared"])


def _outlines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in bounded_rows(parts, 4):
        seen = [outline(p) for p in part.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            *[part.column(k) for k in range(4)],
            pa.array([s[0].astype("<i8").tobytes() for s in seen], pa.binary()),
            pa.array([s[1].tobytes() for s in seen], pa.binary()),
            pa.array([s[2].astype("<i4").tobytes() for s in seen], pa.binary()),
        ], ["m1", "m2", "host", "path", "hashes", "kinds", "lengths"])


def _marks(page: str) -> list[Column]:
    """Two hashes that name a page by its address and content."""
    return [F.xxhash64("__url", page).alias("m1"), F.xxhash64(page, "__url", F.lit(2)).alias("m2")]


def shared_with_neighbours(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(m1, m2, shared): positions of the lines that each distinct page shares with its neighbour.

    Equal rows are one page. A page without a host has no neighbour and no row here.
    """
    seen = pages.select(F.coalesce(F.col(url), F.lit("")).alias("__url"), F.col(page).alias("__page"))
    placed = seen.select(
        *_marks("__page"), F.lower(F.regexp_extract("__url", SITE, 1)).alias("host"),
        F.regexp_extract("__url", SITE, 2).alias("path"), "__page",
    ).where("host != ''")
    lines = stored(
        placed.mapInArrow(_outlines, "m1 long, m2 long, host string, path string, hashes binary, kinds binary, lengths binary")
        .dropDuplicates(["m1", "m2"]), "pages-outlines",
    )
    ranked = global_rank(
        lines.select("m1", "m2", "host", "path"), [F.col("host"), F.col("path"), F.col("m1"), F.col("m2")], "place"
    ).select("m1", "m2", F.col("place"))
    near = lines.join(ranked, ["m1", "m2"]).withColumn("home", F.floor(F.col("place") / BLOCK_PAGES).cast("long"))
    blocks = F.array_distinct(F.array(
        F.col("home"), F.floor((F.col("place") - REACH) / BLOCK_PAGES).cast("long"),
        F.floor((F.col("place") + REACH) / BLOCK_PAGES).cast("long"),
    ))
    return stored(
        near.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.col("home"))
        .select("block", "place", "own", "m1", "m2", "host", "path", "hashes", "kinds", "lengths")
        .repartition("block").sortWithinPartitions("block", "place")
        .mapInArrow(_decisions, "m1 long, m2 long, shared binary"), "pages-shared",
    )


def _wanted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to their lines that can be main text, packed for the way to the decisions."""
    press = zstandard.ZstdCompressor(level=3)
    for part in bounded_rows(parts, 4):
        n_lines, places, packed = [], [], []
        for page in part.column(4).to_pylist():
            lines = page_lines(page)
            said, at = wanted_lines(lines)
            n_lines.append(len(lines))
            places.append(np.array(at, "<i4").tobytes())
            packed.append(press.compress("\n".join(said).encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([
            *[part.column(k) for k in range(4)], pa.array(n_lines, pa.int32()), pa.array(places, pa.binary()), pa.array(packed, pa.binary()),
        ], ["key", "url", "m1", "m2", "n_lines", "places", "packed"])


def _struck(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lines and decisions to main texts."""
    unpress = zstandard.ZstdDecompressor()
    for part in parts:
        texts, n_shared = [], []
        for at, packed, gone in zip(*[part.column(k).to_pylist() for k in (3, 4, 5)]):
            said = unpress.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
            shared = np.frombuffer(gone or b"", "<i4")
            if at:
                struck = np.isin(np.frombuffer(at, "<i4"), shared)
                said = [x for x, out in zip(said, struck.tolist()) if not out]
            texts.append(" ".join(said))
            n_shared.append(len(shared))
        yield pa.RecordBatch.from_arrays([
            part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
            part.column(2), pa.array(n_shared, pa.int32()),
        ], ["key", "url", "text", "n_chars", "n_lines", "n_shared"])


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars, n_lines, n_shared.

    ``n_shared`` counts the lines that differencing found. Null pages are empty and have the empty text;
    pages without a host are not differenced; equal rows are one page and get the same text; an empty
    table gives no rows. Other columns are not read.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(url), F.lit("")).alias("__url"), F.col(page).alias("__page")
    ).select("key", "url", *_marks("__page"), "__page").mapInArrow(
        _wanted, f"key {kind}, url string, m1 long, m2 long, n_lines int, places binary, packed binary"
    )
    met = rows.join(shared_with_neighbours(pages, url, page).hint("merge"), ["m1", "m2"], "left")
    return met.select("key", "url", "n_lines", "places", "packed", "shared").mapInArrow(
        _struck, f"key {kind}, url string, text string, n_chars long, n_lines int, n_shared int"
    ).withColumnRenamed("key", key).withColumnRenamed("url", url)
