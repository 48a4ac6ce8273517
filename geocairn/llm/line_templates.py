"""Line dedup by a log-template tree: recurring line templates are dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocairn.llm.common import utf8
from geocairn.plans.session import materialize

#: A template recurs if so many documents have a line of it.
MIN_DOCS = 3
#: Of lines of over so many tokens two documents suffice.
LONG, LONG_DOCS = 50, 2
#: Of 5 tokens 4 must agree, place by place, with the first line of a template.
AGREE = 5
#: Lines of a leaf that were once held at a time; no longer read, as a leaf is held whole.
LEAF_LINES = 20_000
_DIGIT = re.compile(rb"[0-9]")
_WILD = b"<*>"

_NODE = T.StructType([T.StructField(n, T.LongType()) for n in ("leaf", "h", "g", "n", "low", "high")]
                     + [T.StructField("line", T.BinaryType())])
_NAMES = [f.name for f in _NODE]


def parse(line: bytes) -> list[bytes]:
    """The tokens of a line, those with digits as wildcards unless fewer than half would be left."""
    tokens = line.split()
    if _DIGIT.search(line):
        masked = [_WILD if _DIGIT.search(t) else t for t in tokens]
        if 2 * masked.count(_WILD) <= len(tokens):
            return masked
    return tokens


def depth(n: int) -> int:
    """Leading tokens on the path to a leaf: three, more for long lines."""
    return min(6, max(3, n // 3))


def keys(tokens: list[bytes]) -> tuple[int, int, bytes]:
    """Two independent hashes of a parsed line, and the parsed line."""
    line = b" ".join(tokens)
    return _signed(xxhash.xxh64_intdigest(line, 1)), _signed(xxhash.xxh64_intdigest(line, 2)), line


def leaf(tokens: list[bytes]) -> int:
    path = b" ".join(tokens[:depth(len(tokens))])
    return _signed(xxhash.xxh64_intdigest(path, len(tokens)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _array(values, kind=None) -> pa.Array:
    return pa.array(values, kind or pa.int64())


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct parsed lines of each batch with the rows that have them and their ids."""
    for batch in batches:
        found: dict = {}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            seen = set()
            for raw in text.split(b"\n"):
                if raw in seen:
                    continue
                seen.add(raw)
                tokens = parse(raw)
                if not tokens:
                    continue
                h, g, line = keys(tokens)
                if (h, g) in seen:
                    continue
                seen.add((h, g))
                node = found.get((h, g))
                if node is None:
                    # lines of one hash need no text: under five tokens nothing else can agree
                    found[h, g] = [leaf(tokens), h, g, 1, doc_id, doc_id,
                                   line if len(tokens) >= AGREE else b""]
                else:
                    node[3] += 1
                    if doc_id is not None:
                        node[4] = doc_id if node[4] is None else min(node[4], doc_id)
                        node[5] = doc_id if node[5] is None else max(node[5], doc_id)
        rows = list(found.values())
        for at in range(0, len(rows), 20_000):
            columns = list(zip(*rows[at:at + 20_000]))
            yield pa.RecordBatch.from_arrays(
                [_array(c) for c in columns[:-1]] + [_array(columns[-1], pa.binary())], _NAMES)


class _Leaf:
    """The templates under one leaf: lines are put under the earliest template whose first line they agree with."""

    def __init__(self):
        self.first: list[bytes] = []
        self.members: list[list[tuple]] = []
        self.by_segment: dict[int, list[int]] = {}

    def add(self, node: tuple, line: bytes) -> None:
        """``node``: h, g, rows, smallest and largest id."""
        tokens = line.split(b" ")
        n = len(tokens)
        differ, known = n // AGREE, depth(n)  # the leading tokens are those of the leaf
        # a line with at most so many other tokens has one of these segments in common
        cuts = [known + (n - known) * i // (differ + 1) for i in range(differ + 2)]
        segments = [xxhash.xxh64_intdigest(b" ".join(tokens[cuts[i]:cuts[i + 1]]), i) for i in range(differ + 1)]
        for at in sorted({at for s in segments for at in self.by_segment.get(s, ())}):
            if sum(a != b for a, b in zip(tokens, self.first[at].split(b" "))) <= differ:
                self.members[at].append(node)
                return
        for s in segments:
            self.by_segment.setdefault(s, []).append(len(self.first))
        self.first.append(line)
        self.members.append([node])

    def recurring(self, least: int) -> Iterator[tuple]:
        """(h, g, template, smallest id) of each line of a template that so many rows have."""
        for first, nodes in zip(self.first, self.members):
            yield from _recurring(nodes, min(least, LONG_DOCS) if first.count(b" ") >= LONG else least)


def _recurring(nodes: list[tuple], least: int) -> Iterator[tuple]:
    rows, ids = 0, set()
    for _, _, n, low, high in nodes:
        rows = max(rows, n)
        ids |= {low, high} if n > 1 else {low}
        if max(rows, len(ids)) >= least:
            break
    else:
        return
    known = [low for _, _, _, low, _ in nodes if low is not None]
    for h, g, *_ in nodes:
        yield h, g, nodes[0][0], min(known, default=None)


def _grow(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, node, line, out = None, None, None, b"", []

        def close_node():
            nonlocal held
            if node is None:
                return
            if line:
                held = held or _Leaf()
                held.add(tuple(node), line)
            else:
                out.extend(_recurring([tuple(node)], least))

        def close_leaf():
            nonlocal held
            if held:
                out.extend(held.recurring(least))
            held = None

        def flush():
            columns = list(zip(*out)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([_array(c) for c in columns], ["h", "g", "template", "first_id"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                leaf_, h, g, n, low, high, text = row
                if node is not None and at == leaf_ and (h, g) == (node[0], node[1]):
                    node[2] += n
                    node[3] = min((x for x in (node[3], low) if x is not None), default=None)
                    node[4] = max((x for x in (node[4], high) if x is not None), default=None)
                    continue
                close_node()
                if at != leaf_:
                    close_leaf()
                at, node, line = leaf_, [h, g, n, low, high], text
            if len(out) > 10_000:
                yield flush()
        close_node()
        close_leaf()
        yield flush()

    return run


def recurring_lines(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(h, g, template, first_id) for each parsed line of ``docs`` (doc_id, text) under a recurring template.

    A line is parsed into tokens; those with digits are variable. Its leaf is given by its number of
    tokens and its leading tokens. Under a leaf, lines that agree with a template's first line in four of five
    places belong to it and the other places are variable. A leaf is held whole by one task, whatever
    its size, so what recurs does not depend on the other lines of the leaf. Rows
    are summed per batch first: a line that a third of all documents have is one row a batch.
    """
    nodes = docs.select("doc_id", "text").mapInArrow(_nodes, _NODE)
    nodes = nodes.repartition("leaf").sortWithinPartitions("leaf", "line", "h", "g")
    return nodes.mapInArrow(_grow(least), "h long, g long, template long, first_id long")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(),
                                      utf8(batch.column("text"))):
            for place, raw in enumerate(text.split(b"\n")):
                if tokens := parse(raw):
                    h, g, _ = keys(tokens)
                    out.append((doc_id, mark, place, h, g))
        for at in range(0, len(out), 100_000):
            columns = list(zip(*out[at:at + 100_000]))
            yield pa.RecordBatch.from_arrays([_array(c) for c in columns], ["doc_id", "mark", "place", "h", "g"])


def drop_recurring_lines(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text``, and the numbers of lines and of lines dropped.

    A template that lines of at least ``least`` rows have is recurring; for lines of over ``LONG`` tokens
    ``LONG_DOCS`` rows suffice. Its first line stays in the
    document with the smallest id (in all rows that repeat that id; where all ids are NULL, in all); every
    other line of it goes. Lines without a word stay. NULL stays NULL, with no lines. All rows and
    columns stay; columns named like the new ones are replaced.
    """
    dropped = materialize(recurring_lines(docs, least), "templates")
    mark = F.xxhash64("text")
    places = docs.select("doc_id", mark.alias("mark"), "text").mapInArrow(
        _places, "doc_id long, mark long, place long, h long, g long")
    hits = places.join(dropped, ["h", "g"])
    first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    hits = hits.groupBy("doc_id", "mark", "template").agg(
        F.array_sort(F.collect_set(F.col("place"))).alias("places"), F.first(first).alias("first"))
    hits = hits.select("doc_id", "mark", F.when(F.col("first"), F.slice("places", 2, F.size("places")))
                       .otherwise(F.col("places")).alias("places"))
    drops = hits.groupBy(F.col("doc_id").alias("__llm_id"), F.col("mark").alias("__llm_of")).agg(
        F.flatten(F.collect_list("places")).alias("__llm_places")).where(F.size("__llm_places") > 0)
    marked = docs.withColumn("__llm_mark", mark)
    both = marked.join(drops, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_mark") == F.col("__llm_of")), "left")
    lines = F.split(F.col("text"), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("__llm_places"), i.cast("bigint")))
    text = F.when(F.col("__llm_places").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    count = lambda given, array: F.when(F.col(given).isNull(), 0).otherwise(F.size(array)).cast("bigint")
    new = {"text": text, "n_lines": count("text", lines), "n_dropped": count("__llm_places", "__llm_places")}
    names = [*docs.columns, *(n for n in new if n not in docs.columns)]
    return both.select(*(new[n].alias(n) if n in new else F.col(f"`{n}`") for n in names))
