"""Near-duplicate documents by SimHash and a tiled exact comparison of the fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocairn.llm.common import utf8, with_columns
from geocairn.llm.connect import components, edge_batch, roots
from geocairn.plans.session import materialize

SEED = 42
RADIUS = 3
TILE = 1024
_BLOCKS = 4
_CHUNK = 1 << 16


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the words of one text: a bit is 1 if over half the shingles have it."""
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip((ends - size).tolist(),
                                                       ends[shingle - 1:].tolist())),
            np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, _CHUNK):
        part = np.ascontiguousarray(hashes[at:at + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > hashes.size, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of the lower-cased (A-Z) text; NULL is empty."""
    def compute(batch):
        return [pa.array([fingerprint(t.lower().split()) for t in utf8(batch[text])], pa.int64())]

    return with_columns(docs, [(out, T.LongType())], compute, [text])


def _cell(fp: Column) -> Column:
    """The set bits in each of four 16-bit blocks, seven bits a block."""
    out = F.lit(0).cast("bigint")
    for i in range(_BLOCKS):
        part = F.bit_count(fp.bitwiseAND(F.lit(0xFFFF << 16 * i if i < 3 else -(1 << 48))))
        out = out + part.cast("bigint") * (1 << 7 * i)
    return out


def _steps(radius: int) -> list[int]:
    """Differences between cells whose counts differ by at most ``radius`` in sum, each pair once."""
    reach = range(-radius, radius + 1)
    steps = (sum(d << 7 * i for i, d in enumerate(ds))
             for ds in itertools.product(reach, repeat=_BLOCKS) if sum(map(abs, ds)) <= radius)
    return [d for d in steps if d >= 0]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (lefts, left_at), (rights, right_at) = map(_lists, batch.columns[:2])
            same = batch.column("same").to_pylist()
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                a = lefts[left_at[i]:left_at[i + 1]]
                b = rights[right_at[i]:right_at[i + 1]]
                rows = max(1, _CHUNK * 16 // b.size)
                found = [(x + at, y) for at in range(0, a.size, rows) for x, y in [np.nonzero(
                    np.bitwise_count(a[at:at + rows, None] ^ b[None, :]) <= radius)]]
                x, y = (np.concatenate(z) for z in zip(*found))
                if not x.size or same[i] and x.size == a.size:
                    continue
                nodes = a if same[i] else np.concatenate([a, b])
                top = roots(nodes.size, x, y if same[i] else y + a.size)
                moved = np.nonzero(top != np.arange(nodes.size))[0]
                out_a.append(nodes[moved].view(np.int64))
                out_b.append(nodes[top[moved]].view(np.int64))
            if out_a:
                yield edge_batch(np.concatenate(out_a), np.concatenate(out_b))

    return run


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``prints`` (fp) that connect exactly the
    fingerprints joined by chains of pairs at ``radius`` or fewer differing bits.

    Fingerprints are laid in tiles of about ``tile``; all of a tile have the same number of set bits
    in each 16-bit block. Two fingerprints within the radius have counts that differ by no more
    than it in sum, so only such tiles meet; those are compared whole, by exclusive-or and bit count.
    A pair of tiles gives a spanning forest of its links, never all pairs. The largest intermediate
    is 65 copies of 8 bytes a fingerprint, and a crowded cell is many tiles.
    """
    cells = prints.select("fp", _cell(F.col("fp")).alias("cell"))
    counts = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    # at most 17^4 cells of two numbers: under 3 MB whatever the data
    tiles = (cells.join(F.broadcast(counts), "cell")
             .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).alias("tile"))
             .agg(F.sort_array(F.collect_list("fp")).alias("prints")))
    tiles = materialize(tiles, "tiles")
    steps = F.array(*(F.lit(d).cast("bigint") for d in _steps(radius)))
    homes = tiles.select(F.col("cell").alias("home"), F.col("tile").alias("home_tile"),
                         F.col("prints").alias("left"), F.explode(steps).alias("step"))
    pairs = (homes.withColumn("cell", F.col("home") + F.col("step")).join(tiles, "cell")
             .where("step > 0 OR home_tile <= tile")
             .select("left", F.col("prints").alias("right"),
                     F.expr("step = 0 AND home_tile = tile").alias("same")))
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def simhash_components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(root, fp, component_id) for rows (doc_id, fp): one root for each component, and the smallest
    doc_id that chains of links reach."""
    prints = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    prints = materialize(prints, "prints")
    root_of = components(fingerprint_links(prints, radius, tile)).withColumnRenamed("node", "fp")
    rooted = prints.join(root_of.hint("merge"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("fp", "root").join(smallest.hint("merge"), "root")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z) and cut into three-word shingles, repeats included; fewer words count
    as one shingle. A text without words, or NULL, has fingerprint zero and links like any other.
    Rows that repeat a doc_id keep their own fingerprint; a NULL doc_id never names a component
    unless all of its members are NULL. Other columns of ``docs`` are ignored. No rows, no result.
    """
    own = materialize(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "own")
    groups = simhash_components(own, radius, tile)
    return own.join(groups.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` with one document of each component: its smallest (doc_id, text hash),
    NULL ids last, and one row where that row is repeated. All columns stay."""
    text_hash = F.xxhash64("text")
    own = with_fingerprints(docs.select("doc_id", "text", text_hash.alias("hash")))
    own = materialize(own.select("doc_id", "hash", "fp"), "own")
    groups = simhash_components(own, radius, tile)
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "hash")
    first = (own.join(groups.hint("merge"), "fp").groupBy("root").agg(F.min(key).alias("k"))
             .select(F.col("k.doc_id").alias("__llm_id"), F.col("k.hash").alias("__llm_kept")))
    marked = docs.withColumn("__llm_hash", text_hash)
    kept = marked.join(first.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__llm_id"))
                       & (F.col("__llm_hash") == F.col("__llm_kept")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__llm_hash"]).select(*docs.columns)
