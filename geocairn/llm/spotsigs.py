"""Document fingerprints by SpotSigs, with built-in functions only."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geocairn.functions.geometry import let
from geocairn.llm.common import LOWER, UPPER, WORD
from geocairn.plans.session import join_side

# Common words of four languages.
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it not of on or that the this to was were which with "
    "das dem den der des die ein eine er es für im ist mit nicht sie sich und von zu "
    "au avec ce dans des du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con de del el en la las lo los más no para por que se su un una y"
).split()
#: Content words in a chain, and how many anchors on it may look for them.
CHAIN = 3
REACH = 4
#: Content words without an anchor among them after which each further word starts a chain itself.
RUN = 8
_COARSE = 64
_ROWS = 1_000


def _anchored(anchors) -> str:
    by_letter = defaultdict(list)
    for word in sorted(set(anchors)):
        by_letter[word[0]].append(word[1:])
    return " (?=(?:" + "|".join(f"{c}(?:{'|'.join(tails)})" for c, tails in by_letter.items()) + ")(?: |$))"


def with_spots(df: DataFrame, text: str, out: str, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted distinct signatures of a text, as 64-bit hashes.

    Words are runs of letters and digits, A-Z in lower case. A signature is an anchor and up to ``chain``
    content words that follow it, other anchors skipped. In a run of over ``RUN`` content words (tables, lists)
    each further word starts a chain. A text without a signature has one of its whole words, or
    of the text itself if it has other signs only; a text without any word (or NULL) has none.
    """
    none = F.array().cast("array<bigint>")
    words = F.trim(F.regexp_replace(F.translate(F.col(text), UPPER, LOWER), r"[^\p{L}\p{N}]+", " "))
    # the first piece starts with a mark, each other one with an anchor; content words follow
    pieces = F.split(F.concat(F.lit("^ "), F.col("__llm_words")), _anchored(anchors), -1)
    heads = F.transform("__llm_pieces", lambda p: F.substring_index(p, " ", chain + 1))

    def content(head):
        space = F.instr(head, " ")
        return F.when(space > 0, F.substring(head, space + F.lit(1), F.length(head)))

    def chained(head, k):
        more = F.transform(F.slice("__llm_heads", k + 2, REACH - 1), content)  # array_join passes over NULL
        return let(F.substring_index(F.array_join(F.concat(F.array(head), more), " "), " ", chain + 1),
                   lambda c: F.when(F.instr(c, " ") > 0, F.xxhash64(c)))

    def spot(head, k):
        whole = F.substring_index(head, " ", chain) != head  # all content words before the next anchor
        return F.when(k > 0, F.when(whole, F.xxhash64(head)).otherwise(chained(head, k)))

    def run(p):
        return let(F.split(p, " "), lambda w: F.transform(F.sequence(F.lit(RUN + 2), F.size(w)),
                                                          lambda i: F.xxhash64(F.array_join(F.slice(w, i, chain + 1), " "))))

    long_runs = F.filter("__llm_pieces", lambda p: F.substring_index(p, " ", RUN + 1) != p)
    found = F.array_sort(F.array_distinct(F.array_compact(F.concat(
        F.transform("__llm_heads", spot), F.flatten(F.transform(long_runs, run))))))
    whole = F.when(F.col("__llm_words") != "", F.array(F.xxhash64("__llm_words"))).when(
        F.col(text).rlike(WORD), F.array(F.xxhash64(F.col(text)))).otherwise(none)
    return (df.withColumn("__llm_words", F.coalesce(words, F.lit(""))).withColumn("__llm_pieces", pieces)
            .withColumn("__llm_heads", heads).withColumn("__llm_spots", found)
            .withColumn(out, F.when(F.size("__llm_spots") > 0, F.col("__llm_spots")).otherwise(whole))
            .drop("__llm_words", "__llm_pieces", "__llm_heads", "__llm_spots"))


def length_part(size: Column, threshold: float) -> Column:
    """Number of the partition of set sizes; sets that reach ``threshold`` are at most one apart."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / -math.log(threshold)) + 1).otherwise(0)


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 1 for two empty ones.

    With a ``threshold``, pairs that cannot reach it are pruned by their sizes before they are compared
    (their partitions are more than one apart, or smaller / larger is below it) and get 0.
    """
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    exact = F.when((n == 0) & (m == 0), 1.0).when(F.least(n, m) == 0, 0.0).otherwise(both / (n + m - both))
    if not threshold:
        return exact
    apart = F.abs(length_part(n, threshold) - length_part(m, threshold)) > 1
    return F.when(apart | (F.least(n, m) < threshold * F.greatest(n, m)), 0.0).otherwise(exact)


def digest(spots_: Column) -> Column:
    """The fingerprint as a string: equal sets have equal digests."""
    return F.sha2(F.array_join(spots_.cast("array<string>"), ","), 256)


def _with_bucket(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with buckets that follow descending doc_id, NULL last, of about ``_ROWS`` rows; and how many.

    64 quantiles give coarse buckets; each is cut into equal ranges, as many as its share of the rows needs.
    """
    parts = [i / _COARSE for i in range(_COARSE + 1)]
    n, bounds = docs.agg(F.count("doc_id"), F.percentile_approx("doc_id", parts, 10_000)).first()
    if not n:
        return docs.withColumn("bucket", F.lit(0).cast("bigint")), 1
    bounds = sorted(set(bounds), reverse=True)
    fine = max(1, math.ceil(n / _COARSE / _ROWS))
    edges = F.array(*(F.lit(b).cast("bigint") for b in bounds))
    above = F.size(F.filter(edges, lambda b: b > F.col("doc_id")))
    high = F.when(above > 0, F.get(edges, above - 1)).otherwise(F.col("doc_id"))
    low = F.coalesce(F.get(edges, above), F.col("doc_id"))
    inner = F.when(high > low, F.least(F.floor((high - F.col("doc_id")) / (high - low) * fine), F.lit(fine - 1))).otherwise(0)
    bucket = F.when(F.col("doc_id").isNull(), (len(bounds) + 1) * fine).otherwise(above * fine + inner)
    return docs.withColumn("bucket", bucket.cast("bigint")), (len(bounds) + 1) * fine + 1


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, text, spots, next_text, next_spots).

    Next is by descending doc_id, NULL last, ties by text hash; the first document follows the last. Rows are
    windowed per bucket of ids. The first rows of each bucket are also put at the end of the bucket
    before, so no window spans the table.
    """
    rows, buckets = _with_bucket(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    whole = Window.orderBy("bucket")  # one row per bucket
    previous = F.coalesce(F.lag("bucket").over(whole), F.max("bucket").over(Window.partitionBy()))
    tops = tops.withColumn("previous", previous).withColumnRenamed("bucket", "of")
    # a row of three numbers per bucket: broadcast while that is small
    guests = rows.join(join_side(tops, 64 * buckets), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top"))).select(
        "doc_id", "text", F.col("previous").alias("bucket"), F.lit(True).alias("guest"))
    both = rows.select("doc_id", "text", "bucket", F.lit(False).alias("guest")).union(guests)
    both = both.withColumn("hash", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "hash")
    both = with_spots(both.withColumn("next_text", F.lead("text").over(order)), "text", "spots")
    both = both.withColumn("next_spots", F.lead("spots").over(order))
    return both.where("NOT guest").select("doc_id", "text", "spots", "next_text", "next_spots")


def spot_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_spots).

    The edited text has the last third of the code points replaced by the first of the next document. A
    NULL text is an empty one; repeated rows each have a next row; other columns are ignored. A table
    of one row is its own next. No rows, no result.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third),
                      F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_next(docs).withColumn("edited", edited).withColumn("n_chars", F.length("text").cast("bigint"))
    rows = with_spots(rows, "edited", "edited_spots")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("spots")).alias("fingerprint"),
                       digest(F.col("edited_spots")).alias("edited_fingerprint"),
                       likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
                       likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
                       F.size("spots").cast("bigint").alias("n_spots"))
