"""HTML extraction: the pages of a host vote on the path of their main container, which is then read from all of them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocairn.llm.common import LOWER, UPPER, texts, with_columns
from geocairn.plans.session import join_side, materialize

# Kinds of elements, and words in a class or id.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
_OF_HEAD = frozenset("base link meta noscript script style template title".split())
_DROPPED = frozenset(
    "head nav footer aside form script style noscript template button select textarea input iframe svg math canvas object "
    "audio video dialog menu title noembed noframes xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("#root body article main section div center td".split())
_PAGE = frozenset("#root html body".split())
_SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "newsletter subscribe subscription signup login sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer share sharing "
    "social related recommended recommendations widget popup modal overlay toolbar pagination pager masthead paywall skip".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
_MAIN_WORDS = frozenset("article content post entry story main".split())
#: A start tag of these ends an open element of the first set, unless one of the second lies between.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
             "option": ({"option"}, {"select"})}
#: Containers that a page votes for, containers above a block that it speaks for, and paths kept a host.
VOTES, LEVELS, WINNERS = 3, 5, 3
_NAME = re.compile(r"/?[A-Za-z][^\x20\x09-\x0D/>]*")
_ATTRIBUTE = re.compile(r"""([^\x20\x09-\x0D"'>/=]+)(?:[\x20\x09-\x0D]*=[\x20\x09-\x0D]*("[^"]*"|'[^']*'|[^\x20\x09-\x0D>]*))?""")
_READ = frozenset("class id role hidden itemprop style aria-hidden".split())
_PIECES = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_ENDS = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in _RAW}
_PATHS = "host string, path long, shown string, votes long"


class Page:
    """The elements of a page and its blocks of text, both in page order; a parent comes before its children.

    Elements that are not closed are closed by what follows, as browsers do it for paragraphs, lists and tables; end tags
    without a start are passed over; a comment, tag or script that is not closed runs to the end.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.paths, self.labels = ["#root"], [-1], [0], ["#root"]
        self.boxes = [0]  # the innermost container that an element is or lies in
        # never part of an article; perhaps not, by its class; named like one; in a link; in a header; in a heading
        self.out, self.weak, self.main = [False], [False], [False]
        self.link, self.header, self.heading = [False], [False], [False]
        #: Blocks are lists of (element, text); all ends of block elements end a block.
        self.blocks: list[list[tuple[int, str]]] = [[]]
        self._stack, self._open = [0], Counter()
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            cut = source.find("<", at)
            cut = end if cut < 0 else cut
            if cut > at:
                self._text(source[at:cut])
            at = cut
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                at = end if stop < 0 else stop + 3
            elif source[at + 1:at + 2] in ("!", "?") and at < end - 1:
                stop = source.find(">", at)
                at = end if stop < 0 else stop + 1
            elif at < end:
                name = _NAME.match(source, at + 1)
                if not name:
                    self._text("<")
                    at += 1
                    continue
                tag = name[0].lower()
                at, given = self._attributes(source, name.end())
                if tag[0] == "/":
                    self._end(tag[1:])
                    continue
                self._start(tag, given)
                if tag in _RAW:
                    stop = _ENDS[tag].search(source, at)
                    at = stop.start() if stop else end
        self.blocks = [b for b in self.blocks if b]

    @staticmethod
    def _attributes(source: str, at: int) -> tuple[int, dict[str, str]]:
        """(place after the tag, the attributes that matter)."""
        given: dict[str, str] = {}
        end = len(source)
        while at < end and source[at] != ">":
            found = _ATTRIBUTE.match(source, at)
            if not found:
                at += 1
                continue
            name = found[1].lower()
            if name in _READ and name not in given:
                given[name] = html.unescape((found[2] or "").strip("\"'")).lower()
            at = found.end()
        return at + 1, given

    def _text(self, text: str) -> None:
        if self.tags[self._stack[-1]] == "head" and text.strip():
            self._pop(len(self._stack) - 1)
        self.blocks[-1].append((self._stack[-1], html.unescape(text) if "&" in text else text))

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _pop(self, depth: int) -> None:
        for e in self._stack[depth:]:
            self._open[self.tags[e]] -= 1
        del self._stack[depth:]

    def _pop_first(self, ends: set[str], stop) -> None:
        """Close the innermost open element of ``ends`` and all in it, unless ``stop`` says that one inside it holds."""
        if any(self._open[t] for t in ends):
            for depth in range(len(self._stack) - 1, 0, -1):
                tag = self.tags[self._stack[depth]]
                if tag in ends:
                    return self._pop(depth)
                if stop(tag):
                    return None
        return None

    def _start(self, tag: str, given: dict[str, str]) -> None:
        if self._open["head"] and tag not in _OF_HEAD and self.tags[self._stack[-1]] == "head":
            self._pop(len(self._stack) - 1)
        if tag in _SIBLINGS:
            ends, within = _SIBLINGS[tag]
            self._pop_first(ends, within.__contains__)
        elif tag not in _INLINE:
            self._pop_first({"p"}, lambda t: t not in _INLINE)
        if tag in ("html", "body") and self._open[tag]:
            return
        if tag not in _INLINE:
            self._break()
        elif tag == "br":
            self.blocks[-1].append((self._stack[-1], " "))
        if tag in _VOID:
            return
        up = self._stack[-1]
        classes = given.get("class", "").split()
        named = set(_PIECES.findall(" ".join(classes) + " " + given.get("id", ""))) if given else ()
        label = ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes})])
        # a word of its own on the whole page or on the article does not make it a sidebar
        free = tag in _PAGE or tag == "main"
        comment = any(w in _COMMENT_WORDS for w in named) and not free
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        own_role = given.get("role")
        self.out.append(self.out[up] or tag in _DROPPED or own_role in _ROLES or hidden or comment)
        self.weak.append(any(w in _SIDE_WORDS for w in named) and not free and tag != "article")
        self.main.append(any(w in _MAIN_WORDS for w in named) or given.get("itemprop") == "articlebody" or own_role in ("main", "article"))
        self.link.append(self.link[up] or tag == "a")
        self.header.append(self.header[up] or tag == "header" or "header" in named and not free)
        self.heading.append(self.heading[up] or tag in _HEADINGS)
        self.boxes.append(len(self.tags) if tag in _CONTAINERS else self.boxes[up])
        self.tags.append(tag)
        self.parents.append(up)
        self.labels.append(label)
        step = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), self.paths[up] & 0xFFFFFFFFFFFFFFFF)
        self.paths.append(step - (1 << 64) if step >> 63 else step)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if not self._open[tag]:
            return self._break() if tag == "p" else None
        for depth in range(len(self._stack) - 1, 0, -1):
            open_tag = self.tags[self._stack[depth]]
            if open_tag == tag:
                if tag not in _INLINE:
                    self._break()
                return self._pop(depth)
            if tag in _INLINE and open_tag not in _INLINE:
                return None
        return None

    def shown(self, e: int) -> str:
        """The last steps of an element's path, to read."""
        steps: list[str] = []
        while e > 0 and len(steps) < 12:
            steps.append(self.labels[e])
            e = self.parents[e]
        return ">".join(reversed(steps)) or "#root"

    def _sizes(self, of) -> list[int]:
        """Code points of text in each element, for the runs that ``of`` admits."""
        size = [0] * len(self.tags)
        for block in self.blocks:
            for e, text in block:
                if of(e):
                    size[e] += len(text.strip())
        for e in range(len(size) - 1, 0, -1):
            size[self.parents[e]] += size[e]
        return size

    def inside(self, chosen: set[int]) -> list[int]:
        """The outermost of the chosen elements that each element lies in, or -1."""
        top = [-1] * len(self.tags)
        for e in range(len(top)):
            above = top[self.parents[e]] if e else -1
            top[e] = above if above >= 0 else e if e in chosen else -1
        return top

    def sided(self, top: list[int]) -> list[bool]:
        """Whether an element is no part of the article ``top`` that it lies in: for sure, or by its name, unless it holds
        more than half of that one's text."""
        size = self._sizes(lambda e: not self.out[e])
        side = list(self.out)
        for e in range(1, len(side)):
            if top[e] >= 0 and e != top[e]:
                side[e] |= self.weak[e] and 2 * size[e] <= size[top[e]] or side[self.parents[e]]
        return side

    def votes(self) -> list[tuple[int, int]]:
        """(element, thousandths) of the page's best containers, the best first."""
        side = self.sided([0] * len(self.tags))
        points: Counter = Counter()
        for block in self.blocks:
            kept = [(e, len(t.strip())) for e, t in block if not side[e] and not self.header[e]]
            n = sum(k for _, k in kept) - 3 * sum(k for e, k in kept if self.link[e])
            e, weight, level = self.boxes[block[0][0]], 1.0, 0
            while n > 0 and e >= 0 and level < LEVELS:
                points[e] += n * weight
                e, weight, level = self._box_above(e), weight / 2, level + 1
        for e in points:
            points[e] *= (4 if self.tags[e] == "article" else 2 if self.tags[e] == "main" or self.main[e] else 1)
        total = sum(points.values())
        best = sorted(points, key=lambda e: (-points[e], e))[:VOTES]
        size = self._sizes(lambda e: not side[e] and (not self.header[e] or self.heading[e]))
        titles = self._sizes(lambda e: not side[e] and self.heading[e])
        return [(self._with_title(e, size, titles), int(1000 * points[e] / total)) for e in best]

    def _box_above(self, e: int) -> int:
        return self.boxes[self.parents[e]] if e > 0 else -1

    def _with_title(self, e: int, size: list[int], titles: list[int]) -> int:
        """The container right above, other than the whole page, if it adds headings and nothing else."""
        up = self._box_above(e)
        if up < 0 or self.tags[up] in _PAGE:
            return e
        more = size[up] - size[e]
        return up if more > 0 and more == titles[up] - titles[e] else e

    def text(self, paths: list[int]) -> str:
        """The blocks of the outermost elements on the first of ``paths`` that gives any text, else of the page's own best."""
        for path in paths:
            if found := self._of([e for e, p in enumerate(self.paths) if p == path]):
                return found
        return next((found for e, _ in self.votes() if (found := self._of([e]))), "")

    def _of(self, elements: list[int]) -> str:
        inside = self.inside(set(elements))
        side = self.sided(inside)
        out = []
        for block in self.blocks:
            parts = [text for e, text in block if (top := inside[e]) >= 0 and not side[e] and (
                not self.header[e] or self.header[top] or self.heading[e] and self.tags[top] not in _PAGE)]
            if words := "".join(parts).split():
                out.append(" ".join(words))
        return " ".join(out)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes by host and path, summed per batch."""
    for batch in batches:
        votes: Counter = Counter()
        shown: dict = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(source)
            for e, share in page.votes():
                key = host, page.paths[e]
                votes[key] += share
                if key not in shown:
                    shown[key] = page.shown(e)
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.int64()),
             pa.array([shown[k] for k in votes], pa.string()), pa.array(votes.values(), pa.int64())],
            ["host", "path", "shown", "votes"])


def winning_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path, shown, votes, rank): for each host the WINNERS paths with most votes; ties go to the smaller path.

    A path is the chain of tags with their classes, digits generalised; ``path`` is its hash and ``shown`` its end. Each
    page gives its best containers their shares of its text points. Votes are summed per batch and then by
    Spark, so a host of a third of all pages is a few rows a task. Pages without a host take no part.
    """
    given = pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html")).where("host <> '' AND html <> ''")
    votes = given.mapInArrow(_votes, _PATHS).groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.min("shown").alias("shown"))
    order = Window.partitionBy("host").orderBy(F.col("votes").desc(), "path")
    return votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= WINNERS).select(
        "host", "path", "shown", "votes", "rank")


def with_main_text(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``pages`` with text (the article of each page) and n_chars (its code points).

    A page is read from the outermost elements on its host's winning path, the next one where it has none of the first,
    and from its own best container where it has none at all or no host. Of those, menus, page headers (not
    headings in them), footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out, known
    by tag, role or a word of the class or id; what a mere word excludes stays if it is over half of the text. Character
    references are decoded, white space in a block is one space, blocks are joined by one space. NULL and empty
    pages have an empty text; repeated rows are repeated; all columns stay, and those named like the new ones are replaced.
    """
    winners = materialize(winning_paths(pages, url, source), "paths")
    by_host = winners.groupBy(F.col("host").alias("__llm_host")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"]).alias("__llm_paths"))
    size = winners.agg(F.sum(F.octet_length("host") + 80)).first()[0] or 0
    placed = pages.withColumn("__llm_of", host_of(F.col(url))).join(
        join_side(by_host, size), F.col("__llm_of") == F.col("__llm_host"), "left").drop("__llm_of", "__llm_host")

    def compute(batch):
        found = [Page(s).text(paths or []) if s else "" for s, paths in zip(texts(batch[source]), batch["__llm_paths"].to_pylist())]
        return [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]

    return with_columns(placed, [("text", T.StringType()), ("n_chars", T.LongType())], compute, [source, "__llm_paths"]).drop("__llm_paths")
