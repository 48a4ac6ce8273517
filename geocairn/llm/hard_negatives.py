"""Hard-negative mining by a secondary sort on (anchor, descending score, id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocairn.plans.session import materialize

POSITIVES, NEGATIVES = 5, 3
#: A negative scores from LEAST to MOST hundredths of the positive's score.
LEAST, MOST = 50, 95
SCALE = 256
#: Bytes of anchors that tasks hold at a time; further anchors take another pass over the rows.
ANCHOR_BYTES = 32 << 20
#: Scores computed at a time.
_SCORES = 1 << 21
_LONG = (1 << 63) - 1
_PAIR = "anchor long, down long, other long, row long"


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Integer components, a row a vector, as the narrowest kind in which inner products up to its norms are exact.

    Vectors of different lengths are filled up with zeros.
    """
    width = max((v.size for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :v.size] = v
    return np.floor(out * SCALE)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices, exact; those beyond 64 bits are cut to its range."""
    width = max(a.shape[1], b.shape[1])
    if a.shape[1] != b.shape[1]:
        a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = _norm(a) * _norm(b)  # no partial sum is larger
    if most < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 1 << 53:
        return a @ b.T
    exact = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(exact[0] @ exact[1].T, -_LONG, _LONG).astype(np.int64)


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt((m * m).sum(axis=1)).max(initial=0.0)) * (1 + 1e-9)


def firsts(group: np.ndarray, down: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each group by (down, other), in that order."""
    order = np.lexsort((other, down, group))
    if not order.size:
        return order
    sorted_group = group[order]
    start = np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])
    place = np.arange(order.size)
    return order[place - np.maximum.accumulate(np.where(start, place, 0)) < k]


class _Best:
    """The first ``k`` rows of each group among all that a task has met, and what a row must beat."""

    def __init__(self, groups: int, k: int):
        self.k, self.groups = k, groups
        self.entries = [np.zeros(0, np.int64) for _ in range(4)]  # group, down, other, row
        self.down = np.full(groups, _LONG)  # of the group's last entry, if it has k
        self.other = np.full(groups, _LONG)

    def add(self, group, down, other, row) -> None:
        merged = [np.concatenate([old, new]) for old, new in zip(self.entries, (group, down, other, row))]
        keep = firsts(*merged[:3], self.k)
        self.entries = [c[keep] for c in merged]
        group = self.entries[0]
        full = np.nonzero(np.bincount(group, minlength=self.groups) == self.k)[0]
        last = np.searchsorted(group, full, side="right") - 1
        self.down[full], self.other[full] = self.entries[1][last], self.entries[2][last]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple]:
    """(ids, labels, matrix, row numbers) of some rows, in the order of their ids."""
    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            vectors = [np.asarray(v, np.float64) for v in part.column("vector").to_pylist()]
            order = np.argsort(ids, kind="stable")
            yield ids[order], labels[order], matrix([vectors[i] for i in order]), seen + order
            seen += part.num_rows


def _emit(anchors: np.ndarray, best: _Best, per_anchor: int) -> pa.RecordBatch:
    group, down, other, row = best.entries
    owner = anchors[group // per_anchor]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (owner, down, other, row)], ["anchor", "down", "other", "row"])


def _rows_at_once(anchors: int) -> int:
    return max(64, _SCORES // max(1, anchors))


def _positives(group):
    """Each task's first POSITIVES rows of an anchor's label."""
    def run(batches):
        g = group.value
        best = _Best(g["row"].size, POSITIVES)
        for ids, labels, m, seq in _blocks(batches, _rows_at_once(g["row"].size)):
            for label in np.unique(labels):
                mine, its = np.nonzero(g["label"] == label)[0], np.nonzero(labels == label)[0]
                if not mine.size:
                    continue
                down = -products(g["matrix"][mine], m[its])
                limit = best.down[mine, None]
                i, j = np.nonzero((down < limit) | (down == limit) & (ids[its][None, :] < best.other[mine, None]))
                i, j, down = mine[i], its[j], down[i, j].astype(np.int64)
                other = g["id"][i] != ids[j]
                best.add(i[other], down[other], ids[j][other], seq[j][other])
        yield _emit(g["row"], best, 1)

    return run


def _window(down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) negated scores of negatives for negated positive scores, in whole numbers."""
    score = [-int(d) for d in down]
    return (np.array([-(MOST * s // 100) for s in score], np.int64), np.array([-(-(-LEAST * s // 100)) for s in score], np.int64))


def _negatives(group):
    """Each task's first NEGATIVES rows of another label in the window of each positive of an anchor."""
    def run(batches):
        g = group.value
        n = g["row"].size
        best = _Best(n * POSITIVES, NEGATIVES)
        first, last = g["first"], g["last"]  # anchors x POSITIVES; an empty window where there is no positive
        for ids, labels, m, seq in _blocks(batches, _rows_at_once(n)):
            down = -products(g["matrix"], m)
            down[g["label"][:, None] == labels[None, :]] = _LONG if down.dtype == np.int64 else np.inf
            for k in range(POSITIVES):
                limit, tie = best.down[k::POSITIVES], best.other[k::POSITIVES]
                low, high = (x.astype(down.dtype)[:, None] for x in (first[:, k], np.minimum(limit, last[:, k])))
                i, j = np.nonzero((down >= low) & (down <= high))
                values = down[i, j].astype(np.int64)
                better = (values < limit[i]) | (ids[j] < tie[i])
                i, j = i[better], j[better]
                best.add(i * POSITIVES + k, values[better], ids[j], seq[j])
        # a row in several windows is one row; the reader opens the windows again
        batch = _emit(g["row"], best, POSITIVES)
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        rows = np.unique(rows, axis=0) if rows.size else rows
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], batch.schema.names)

    return run


def secondary_sort(pairs: DataFrame, *more: str) -> DataFrame:
    """One shuffle on the anchor, each part sorted by (anchor, descending score, id): no anchor is ever a list."""
    return pairs.repartition("anchor").sortWithinPartitions("anchor", "down", *more, "other")


def _first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, found = None, 0
    for batch in batches:
        keep = []
        for i, anchor in enumerate(batch.column("anchor").to_pylist()):
            at, found = (at, found + 1) if anchor == at else (anchor, 1)
            if found <= POSITIVES:
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positives open windows; the negatives that stream by are emitted for each open window they lie in."""
    at, windows = None, []  # [first, last, found, positive, its score]
    for batch in batches:
        out = []
        for anchor, down, other, negative in zip(*(batch.column(c).to_pylist() for c in ("anchor", "down", "other", "negative"))):
            if anchor != at:
                at, windows = anchor, []
            if not negative:
                first, last = _window(np.array([down]))
                windows.append([int(first[0]), int(last[0]), 0, other, -down])
                continue
            for window in windows:
                if window[0] <= down <= window[1] and window[2] < NEGATIVES:
                    window[2] += 1
                    out.append((anchor, window[3], window[2], other, window[4], -down))
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         ["anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def hard_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label",
                   vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor row and each of its first POSITIVES other rows of the same label, the first NEGATIVES rows of other labels
    that score from LEAST to MOST hundredths of the positive's score. Scores are inner products of the components
    floor(256 * x), as whole numbers; higher ones come first, then smaller ids.

    Anchors are compared with all rows in blocks: as many anchors as ANCHOR_BYTES hold are sent to the
    tasks, each task streams its rows past them and keeps its own first rows an anchor and window, so what is
    shuffled grows with the anchors, not with the pairs. Two such passes, for positives and for negatives, end in
    a secondary sort that an iterator reads.

    Rows with a NULL id, label or vector, or a NULL or non-finite component take no part. Other rows are those of another
    id; rows that repeat an id each count, as anchors too. Scores beyond 64 bits are cut to their range. Vectors of different lengths compare as if filled up with zeros. Other
    columns are ignored. No rows or no anchors, no result.
    """
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                          v.cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & whole)
    anchors = materialize(rows.where("anchor").select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector"), "anchors")
    size = anchors.agg(F.count("*"), F.sum(F.size("vector") * 8 + 160)).first()
    passes = max(1, -(-(size[1] or 0) // ANCHOR_BYTES))
    spark = vectors.sparkSession
    # few long tasks: each sends its own first rows for every anchor
    parts = max(spark.sparkContext.defaultParallelism * 2, 2)
    rows = rows.select("id", "label", "vector").coalesce(parts)
    out = []
    for k in range(passes):
        table = anchors.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == k).toArrow().sort_by("row")  # about ANCHOR_BYTES
        group = {"row": table["row"].to_numpy(), "id": table["id"].to_numpy(), "label": table["label"].to_numpy(),
                 "matrix": matrix([np.asarray(x, np.float64) for x in table["vector"].to_pylist()])}
        known = spark.sparkContext.broadcast(group)
        near = secondary_sort(rows.mapInArrow(_positives(known), _PAIR)).mapInArrow(_first_positives, _PAIR)
        near = materialize(near.select("anchor", "down", "other"), "positives")
        group = group | dict(zip(("first", "last"), _windows(group["row"], near)))
        known = spark.sparkContext.broadcast(group)
        far = rows.mapInArrow(_negatives(known), _PAIR)
        both = near.withColumn("negative", F.lit(False)).unionByName(far.drop("row").withColumn("negative", F.lit(True)))
        mined = secondary_sort(both, "negative").mapInArrow(
            _mine, "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        out.append(materialize(mined, "mined"))
    mined = out[0]
    for more in out[1:]:
        mined = mined.unionByName(more)
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return mined.join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _windows(rows: np.ndarray, near: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the positives of some anchors; at most POSITIVES numbers an anchor come to the driver."""
    table = near.select("anchor", "down", "other").toArrow()
    anchor, down, other = (table[c].to_numpy() for c in ("anchor", "down", "other"))
    order = np.lexsort((other, down, anchor))
    anchor, down = anchor[order], down[order]
    place = np.arange(anchor.size) - np.searchsorted(anchor, anchor)
    first = np.full((rows.size, POSITIVES), _LONG)
    last = np.full((rows.size, POSITIVES), -_LONG)
    at = np.searchsorted(rows, anchor)
    first[at, place], last[at, place] = _window(down)
    return first, last
