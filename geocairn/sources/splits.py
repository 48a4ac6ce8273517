"""Records longer than a line, read by many tasks from one file.

Spark cuts a text file into splits and hands each task whole pieces between separators. Whether a
separator ends a record depends on the text before it: on open quotes (CSV) or on open braces (JSON).

1. A scan reduces each split to how it changes that state; sums over the splits of a file, a
   row each, give the state in which every split begins.
2. A second scan cuts the pieces of a split into records as they stream by. Only a record
   that several splits share is put together by a shuffle, of its parts alone.

Splits must be cut alike in both scans: a split that the first has not seen raises. Files are plain (not
compressed) UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import BROADCAST_LIMIT_BYTES, join_side, materialize

_SPLIT = ["_file", "_start"]
# What a row of the second scan is: a record, or the first, a middle or the last part of one.
_WHOLE, _BEGINS, _MIDDLE, _ENDS = range(4)
_RECORDS = "_file string, _start long, _kind int, _head boolean, value string"


def _pieces(spark: SparkSession, path, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("_size"), "value")


def _before(value: Column) -> Column:
    """The sum of ``value`` over the earlier splits of the file."""
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut where a new split begins; a task reads its splits one after the other."""
    start, file = batch.column("_start").to_numpy(), batch.column("_file")
    new = start[1:] != start[:-1]
    if len(file) > 1:
        new |= pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _key(run: pa.RecordBatch) -> tuple[str, int]:
    return run.column("_file")[0].as_py(), run.column("_start")[0].as_py()


def _joined(values: pa.Array, ends: np.ndarray, separator: str) -> pa.Array:
    """The pieces up to the last end, those of each record joined."""
    if len(ends) == ends[-1] + 1:
        return values.slice(0, len(ends))
    offsets = pa.array(np.concatenate([[0], ends + 1]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values.slice(0, int(ends[-1]) + 1)), separator)


def _cut(separator: str, state: list[str], ends_of: Callable, every: bool) -> Callable:
    """A function for ``mapInArrow``: rows of ``_RECORDS`` from the pieces of each split.

    ``ends_of(values, *state)`` says which pieces end a record, and the state after them. ``every``: a split
    leaves a first part behind even where it ends with a record.
    """
    def rows(key, kind, head, values):
        n = len(values)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
            pa.array([head] + [False] * (n - 1), pa.bool_()), pa.array(values, pa.string())
            if isinstance(values, list) else values.cast(pa.string())], names=["_file", "_start", "_kind", "_head", "value"])

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, held, amid, head = None, (), [], False, False

        def rest():
            if key is not None and (held or every):
                text = separator.join(held) if held else None
                yield rows(key, _MIDDLE if amid else _BEGINS, head, [text])

        for batch in batches:
            for run in _runs(batch):
                if _key(run) != key:
                    yield from rest()
                    key, held = _key(run), []
                    now = tuple(run.column(name)[0].as_py() for name in state)
                    amid, head = run.column("_amid")[0].as_py(), key[1] == 0
                values = run.column("value")
                mask, now = ends_of(values, *now)
                ends = np.flatnonzero(mask)
                if len(ends):
                    if held or amid:
                        first = int(ends[0]) + 1
                        text = separator.join(held + values.slice(0, first).to_pylist())
                        yield rows(key, _ENDS if amid else _WHOLE, head, [text])
                        values, ends = values.slice(first), ends[1:] - first
                        held, amid, head = [], False, False
                    if len(ends):
                        yield rows(key, _WHOLE, head, _joined(values, ends, separator))
                        values, head = values.slice(int(ends[-1]) + 1), False
                held += values.to_pylist()
        yield from rest()

    return run_all


def _records(pieces: DataFrame, states: DataFrame, separator: str, state: list[str], ends_of: Callable, *,
             every: bool = False, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(_head, value): all records; ``_head`` marks the first of a file."""
    states = materialize(states, "splits")
    size = states.agg(F.sum(F.length("_file") * 4 + 96).alias("n"), F.sum(F.col("_cut").cast("int")).alias("cut")).first()
    run_all = _cut(separator, state, ends_of, every)

    def scanned(wanted: DataFrame) -> DataFrame:
        side = join_side(wanted, size["n"] or 0, limit)
        placed = pieces.select(*_SPLIT, "value", F.monotonically_increasing_id().alias("_at")).join(side, _SPLIT, "left")
        if (size["n"] or 0) > limit:  # the join dealt a split to one task, out of order
            placed = placed.sortWithinPartitions(*_SPLIT, "_at")
        unseen = F.raise_error(F.concat(F.lit("splits changed between two scans of "), F.col("_file")))
        known = F.when(F.col("_amid").isNull(), unseen.cast("boolean")).otherwise(F.col("_amid"))
        return placed.withColumn("_amid", known)

    names = [*_SPLIT, "value", "_amid", *state]
    whole = scanned(states).select(*names).mapInArrow(run_all, _RECORDS).filter(F.col("_kind") == _WHOLE)
    whole = whole.select("_head", "value")
    if not size["cut"]:
        return whole
    parts = scanned(states).filter("_cut").select(*names).mapInArrow(run_all, _RECORDS).filter(F.col("_kind") != _WHOLE)
    # within a split the end of one record comes before the beginning of the next
    order = Window.partitionBy("_file").orderBy("_start", F.desc("_kind"))
    shared = (
        parts.withColumn("_n", F.sum((F.col("_kind") == _BEGINS).cast("int")).over(order))
        .groupBy("_file", "_n").agg(
            F.max("_head").alias("_head"), F.max(F.col("_kind") == _ENDS).alias("_closed"),
            F.sort_array(F.collect_list(F.struct("_start", "value"))).alias("_parts"))
        .select("_head", "_closed", F.array_join(F.col("_parts.value"), separator).alias("value")))
    if not every:  # an unclosed quote at the end of a file is left for the parser to refuse
        return whole.unionByName(shared.drop("_closed"))
    return whole.unionByName(shared.filter("_closed").drop("_closed"))


def _csv_ends(values: pa.Array, inside: int):
    after = (inside + np.cumsum(pc.count_substring(values, '"').to_numpy())) % 2
    return after == 0, (int(after[-1]),)


def csv_records(spark: SparkSession, path, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(_head, value): the records of CSV files by RFC 4180, line ends inside quotes kept as they are.

    A line ends a record if the quotes up to there are even in number, a doubled quote counting twice.
    """
    pieces = _pieces(spark, path, "\n")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    odd = pieces.groupBy(*_SPLIT).agg((F.sum(quotes) % 2).alias("_odd"))
    states = (odd.withColumn("_inside", (_before(F.col("_odd")) % 2).cast("int"))
              .withColumn("_amid", F.col("_inside") == 1)
              .withColumn("_cut", F.col("_amid") | ((F.col("_inside") + F.col("_odd")) % 2 == 1)).drop("_odd"))
    found = _records(pieces, states, "\n", ["_inside"], _csv_ends, limit=limit)
    return found.withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def _bare(values: pa.Array):
    """Of each text: its quotes, and its opening braces if it begins outside or inside a string."""
    clean = pc.replace_substring_regex(values, r"(?s)\\.", "")
    string = r'"[^"]*("|\z)'
    outside = pc.replace_substring_regex(clean, string, "")
    inside = pc.replace_substring_regex(pc.replace_substring_regex(clean, r'\A[^"]*("|\z)', ""), string, "")
    return (pc.count_substring(clean, '"').to_numpy(), pc.count_substring(outside, "{").to_numpy(),
            pc.count_substring(inside, "{").to_numpy())


def _depths(values: pa.Array, inside: int, depth: int):
    """After each text and its closing brace: whether a string is open, and how deep the braces are."""
    quotes, outer, inner = _bare(values)
    after = (inside + np.cumsum(quotes)) % 2
    before = np.concatenate([[inside], after[:-1]])
    return after, depth + np.cumsum(np.where(before == 0, outer, inner) - (after == 0))


def _feature_ends(values: pa.Array, inside: int, depth: int):
    after, depths = _depths(values, inside, depth)
    return (after == 0) & (depths == 1), (int(after[-1]), int(depths[-1]))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: quotes, depth gained from outside and from inside a string, bytes, if it ends in blanks and names features."""
    key, sums = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(_SUMMARY_NAMES, [*key, *sums]))], schema=_SUMMARY)

    for batch in batches:
        for run in _runs(batch):
            if _key(run) != key:
                if key is not None:
                    yield row()
                key, sums = _key(run), [0, 0, 0, 0, False, False, run.column("_size")[0].as_py()]
            values, odd = run.column("value"), sums[0]
            after, depths = _depths(values, odd, sums[1])
            _, other = _depths(values, 1 - odd, sums[2])
            sums[0] = int(after[-1])
            sums[1], sums[2] = int(depths[-1]), int(other[-1])
            sums[3] += pc.sum(pc.binary_length(values)).as_py() + len(values)
            sums[4] = not values[-1].as_py().strip()
            sums[5] |= pc.any(pc.match_substring(values, '"features"')).as_py()
    if key is not None:
        yield row()


_SUMMARY = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("_odd", pa.int64()), ("_outer", pa.int64()),
                      ("_inner", pa.int64()), ("_bytes", pa.int64()), ("_blank", pa.bool_()),
                      ("_named", pa.bool_()), ("_size", pa.int64())])
_SUMMARY_NAMES = _SUMMARY.names
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|[{]', re.S)
_NOT_A_COLLECTION = {"geometry", "properties", "coordinates", "geometries"}


def _feature_text(record: str) -> str | None:
    """The object that ends a record, or None if it is a member of the collection other than a feature."""
    text = record.lstrip("\ufeff \t\r\n")
    skip, name = (1 if text.startswith("{") else 0), None  # the collection's own brace
    for token in _TOKEN.finditer(text):
        if token.group() != "{":
            name = token.group(1)
        elif skip:
            skip = 0
        else:
            if name in _NOT_A_COLLECTION:
                raise ValueError(f"not a FeatureCollection: member {name!r} beside no features")
            return text[token.start():] + "}" if name in (None, "features") else None
    raise ValueError("not a FeatureCollection")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.replace_substring_regex(batch.column("value"), r"\A[\s,]+", "")
        # what follows a comma is the next feature; only a few records begin with names of members
        plain = pc.and_(pc.starts_with(texts, "{"), pc.starts_with(pc.utf8_ltrim_whitespace(batch.column("value")), ","))
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(texts.filter(plain), "}", "").cast(pa.string())], names=["value"])
        rare = [_feature_text(t) for t in batch.column("value").filter(pc.invert(plain)).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([t for t in rare if t is not None], pa.string())], names=["value"])


def feature_texts(spark: SparkSession, path, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(value): the text of every object in the ``features`` of FeatureCollection files.

    Files whose braces or strings do not close raise, as do documents of another type.
    """
    pieces = _pieces(spark, path, "}")
    columns = "_file string, _start long, _odd long, _outer long, _inner long, _bytes long, _blank boolean, " \
              "_named boolean, _size long"
    sums = materialize(pieces.mapInArrow(_summaries, columns), "splits")
    states = (
        sums.withColumn("_inside", (_before(F.col("_odd")) % 2).cast("int"))
        .withColumn("_gain", F.when(F.col("_inside") == 0, F.col("_outer")).otherwise(F.col("_inner")))
        .withColumn("_depth", _before(F.col("_gain")))
        .withColumn("_amid", F.col("_start") > 0)
        .withColumn("_cut", F.count("*").over(Window.partitionBy("_file")) > 1))
    whole = states.groupBy("_file").agg(
        F.sum("_bytes").alias("bytes"), F.max("_size").alias("size"), F.max_by("_blank", "_start").alias("blank"),
        (F.sum("_odd") % 2).alias("inside"), F.sum("_gain").alias("depth"), F.max("_named").alias("named"))
    # blanks after the last brace are a piece without one
    sound = F.col("named") & (F.col("inside") == 0) & (
        ((F.col("bytes") == F.col("size")) & (F.col("depth") == 0))
        | ((F.col("bytes") == F.col("size") + 1) & (F.col("depth") == -1) & F.col("blank")))
    bad = whole.filter(~sound).orderBy("_file").limit(1).collect()
    if bad:
        raise ValueError(f"not one closed FeatureCollection: {bad[0]['_file']}")
    found = _records(pieces, states.select(*_SPLIT, "_inside", "_depth", "_amid", "_cut"), "}",
                     ["_inside", "_depth"], _feature_ends, every=True, limit=limit)
    return found.select("value").mapInArrow(_features, "value string")
