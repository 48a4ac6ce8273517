"""Filter interaction audit: every order of the filters at once, summed in wide packed counters."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geocairn.llm.common import utf8

FILTERS = "ABCDE"
#: Bits of a counter. A table has fewer than 2^63 rows, so no counter runs into the next one.
FIELD = 64
#: What the counters of a step tell.
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: Parts that a task sums at a time; when it meets more, it passes on what it has.
_PARTS = 256
#: Rows that the sums of one part are spread over before they are added up.
_SALTS = 32
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
_ROW = "hash_a long, hash_b long, part string, doc_id long, mask int"


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in itertools.permutations(filters)]


def failed(text: bytes, n_chars: int) -> int:
    """Bits 0 to 3: which of A to D the text fails."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return ((n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * n_chars) << 2
            | (len(text.translate(None, _SIGNS)) < len(text)) << 3)


def packed(mask: int, good: bool, toxic: bool, filters: str = FILTERS) -> int:
    """One document's outcomes as a single integer: a field for each (order, step, outcome), then a field
    for each filter that is the only one the document fails."""
    bit = {c: 1 << i for i, c in enumerate(filters)}
    fields: list[bool] = []
    for order in orders(filters):
        gone = False
        for c in order:
            fails = bool(mask & bit[c])
            here, redundant = fails and not gone, fails and gone
            gone |= fails
            fields += (not gone, here, redundant, here and good, here and toxic)
    fields += (mask == bit[c] for c in filters)
    return int.from_bytes(np.array(fields, f"<u{FIELD // 8}").tobytes(), "little")


def unpacked(total: bytes) -> np.ndarray:
    return np.frombuffer(total, f"<u{FIELD // 8}").astype(np.int64)


def n_bytes(filters: str = FILTERS) -> int:
    steps = len(orders(filters)) * len(filters)
    return (steps * len(OUTCOMES) + len(filters)) * FIELD // 8


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text hash, part and the failed filters A to D; the texts stop here."""
    for batch in batches:
        values = utf8(batch.column("text"))
        sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in values]), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), batch.column("part"), batch.column("doc_id"),
             pa.array([failed(t, n) for t, n in zip(values, sizes)], pa.int32())],
            ["hash_a", "hash_b", "part", "doc_id", "mask"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, mask, good, toxic, n) summed to one integer a part."""
    one: dict = {}
    sums: dict[str, int] = {}
    for batch in batches:
        *kinds, n = (c.to_pylist() for c in batch.columns)
        counts: Counter = Counter()
        for key, rows in zip(zip(*kinds), n):
            counts[key] += rows
        for (part, *kind), rows in counts.items():
            kind = tuple(kind)
            if kind not in one:
                one[kind] = packed(*kind)
            sums[part] = sums.get(part, 0) + rows * one[kind]
            if len(sums) > _PARTS:
                yield _totals(sums)
                sums = {}
    yield _totals(sums)


def _totals(sums: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(sums.keys(), pa.string()), pa.array([s.to_bytes(n_bytes(), "little") for s in sums.values()], pa.binary())],
        ["part", "total"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, total), sorted by part, added up as they stream by."""
    at, held = None, 0
    for batch in batches:
        for part, total in zip(batch.column("part").to_pylist(), batch.column("total")):
            if at is not None and part != at:
                yield _totals({at: held})
                held = 0
            at, held = part, held + int.from_bytes(total.as_py(), "little")
    if at is not None:
        yield _totals({at: held})


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, steps = orders(), len(FILTERS)
    letter = np.array([FILTERS.index(c) for order in names for c in order])
    for batch in batches:
        for part, total in zip(batch.column("part").to_pylist(), batch.column("total")):
            counts = unpacked(total.as_py())
            grid, alone = counts[:-steps].reshape(-1, len(OUTCOMES)), counts[-steps:]
            shapley = np.zeros(steps, np.int64)
            np.add.at(shapley, letter, grid[:, OUTCOMES.index("removed")])
            columns = [pa.array([part] * letter.size), pa.array([order for order in names for _ in order]),
                       pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names)))]
            columns += [pa.array(np.ascontiguousarray(x)) for x in (*grid.T, alone[letter], shapley[letter])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *OUTCOMES, "unique_fails", "shapley"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail exactly these filters; one row or more for each kind.

    A document fails E if a smaller doc_id has the same text (by 128 bits of hash) in whatever part. Copies are
    counted per (text, part, label) with their smallest id before they meet, so a text that a third of all
    rows have is a few rows a task. Rows without an id are spread over the join by their text.
    """
    slim = docs.select(F.coalesce("lang", F.lit("")).alias("part"), "text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(_masks, _ROW)
    slim = slim.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod("hash_a", F.lit(1024)) + 1).otherwise(F.lit(0)).cast("long"))
    slim = slim.withColumn("id", F.coalesce("doc_id", F.lit(0)))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("spread")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    text, kind = ["hash_a", "hash_b"], ["part", "mask", "good", "toxic"]
    rows = slim.join(marks, ["id", "spread"], "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    by_id = rows.groupBy("id", "spread", "doc_id", *text, *kind).agg(F.count("*").alias("rows"))
    copies = by_id.groupBy(*text, *kind).agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))).alias("least"))
    # a window holds a text's kinds, not its copies
    first = F.min("least.doc_id").over(Window.partitionBy(*text))
    passes = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.rows")).otherwise(0)
    judged = copies.withColumn("first", first).withColumn("pass", passes)
    both = F.array(F.struct(F.col("mask"), F.col("pass").alias("n")),
                   F.struct((F.col("mask") + 16).alias("mask"), (F.col("rows") - F.col("pass")).alias("n")))
    return judged.select("part", "good", "toxic", F.explode(both).alias("b")).where("b.n > 0").select(
        "part", "b.mask", "good", "toxic", "b.n")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, good_lost, toxic_lost, unique_fails, shapley): 600 rows for
    each part of ``docs`` (doc_id, text, lang), zeros included.

    Each mask of failed filters is one wide integer that holds what becomes of a document in every step of every
    order. Tasks add those integers up by part; the sums are added in two rounds, the first one salted, and unpacked
    at the end. A NULL text is empty, a NULL lang the empty string. Repeated rows count one by one; of rows
    that repeat both text and id none is smaller than the other. A NULL id is smaller than no id, and no id is smaller
    than it. A label counts if any row of its id in ``labels`` (doc_id, quality, toxic) says 1. Other columns are
    ignored. No rows, no result.
    """
    totals = mask_counts(docs, labels).select("part", "mask", "good", "toxic", "n").mapInArrow(_sum, "part string, total binary")
    totals = totals.withColumn("salt", F.spark_partition_id() % _SALTS)
    totals = totals.repartition("part", "salt").sortWithinPartitions("part").select("part", "total").mapInArrow(_add, "part string, total binary")
    totals = totals.repartition("part").sortWithinPartitions("part").mapInArrow(_add, "part string, total binary")
    counts = ", ".join(f"{c} long" for c in (*OUTCOMES, "unique_fails", "shapley"))
    return totals.mapInArrow(_report, f"part string, filter_order string, step int, {counts}")
