"""Mixing sources to target weights by Pareto order sampling, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geocairn.llm.common import WORD
from geocairn.plans.session import materialize

#: Most times a word of a source is taken.
MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
_BINS = 4096
_HEX = 13
_UNITS = float(16 ** _HEX)


def with_size(docs: DataFrame, text: str = "text", out: str = "__llm_size") -> DataFrame:
    """``docs`` with its number of words; NULL has none."""
    return docs.withColumn(out, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source of ``sizes`` (source, size): docs, source_size, target.

    The n-th source in code point order (NULL last) has the n-th weight, repeating. All words are
    shared by weight; a target stops at ``most`` times its source's size and the excess is shared
    among the others by weight until none is above. That fixed point is found in one sorted pass:
    sources reach their limit in the order of limit / weight. What is ordered here is one row per
    source, never a document.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    limits = totals.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # what a unit of weight would get if exactly the sources before this one were at their limit
    share = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
             / F.sum("weight").over(after))
    shared = limits.withColumn("share", share).withColumn("full", F.col("limit") <= F.col("share") * F.col("weight"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "share"))).over(everything)["share"]
    return shared.select("source", "docs", "source_size", F.when(
        F.col("full"), F.col("limit").cast("double")).otherwise(rest * F.col("weight")).alias("target"))


def _uniform(doc_id: Column, digest: Column) -> Column:
    """A number in (0, 1) that depends on the seed, the id and the text only."""
    text = F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("-")), digest)
    digits = F.substring(F.md5(text.cast("binary")), 1, _HEX)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / _UNITS


def _rank_value(size: Column, u: Column, c=F.col) -> Column:
    """Random odds over inclusion odds, mapped to (0, 1); 1 where nothing more can be taken.

    Inclusion odds favour longer documents but keep the expected words of the source: the
    probability is the source's fraction plus ``lean`` times how far the document's size / (size +
    mean size) is above its word-weighted mean. ``c`` gives the source's columns.
    """
    p = c("fraction") + c("lean") * (size / (size + c("mean_size")) - c("mean_pull"))
    value = (u / (1 - u)) / (p / (1 - p))
    return F.when((c("fraction") > 0) & (size > 0), value / (1 + value)).otherwise(F.lit(1.0))


def _bins(v: Column) -> tuple[Column, Column]:
    """The bin of a rank value, and the bin within that bin."""
    coarse = F.floor(v * _BINS)
    return coarse, F.floor((v * _BINS - coarse) * _BINS)


def mix_plan(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source with its copies and the cut of its sample, for rows (doc_id, source, size, u).

    A source's whole copies are the integer part of target / size. The rest of its words is a Pareto
    sample: documents are ranked by random odds / inclusion odds and taken from the lowest rank
    up to the words wanted. The rank's cut is found by two histograms of 4,096 bins per source,
    summed before they are shuffled; only documents of one bin in 16 million are ordered, so no source, however
    large, is sorted as a whole.
    """
    targets = materialize(source_targets(sized, weights, most), "targets")
    same = sized["source"].eqNullSafe(targets["source"])
    pull = F.col("size") / (F.col("size") + F.col("mean_size"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(copies + 1e-12), F.lit(most)).cast("bigint")
    fraction = F.greatest(copies - F.col("whole"), F.lit(0.0))
    sources = (targets.withColumn("whole", whole).withColumn("fraction", F.when(fraction > 1e-9, fraction).otherwise(0.0))
               .withColumn("mean_size", F.col("source_size") / F.col("docs")))
    means = (sized.join(sources.select(F.col("source").alias("s"), "mean_size"), sized["source"].eqNullSafe(F.col("s")))
             .where("size > 0").groupBy("s")
             .agg((F.sum(F.round(pull * F.col("size") * 1024).cast("bigint")) / 1024 / F.sum("size")).alias("mean_pull")))
    sources = materialize(
        sources.join(means, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .withColumn("mean_pull", F.coalesce("mean_pull", F.lit(0.0)))
        .withColumn("lean", F.least("fraction", 1 - F.col("fraction")) / 2)
        .withColumn("wanted", F.when(F.col("fraction") > 0, F.col("target") - F.col("whole") * F.col("source_size"))
                    .otherwise(F.lit(0.0))), "sources")
    ranked = (sized.join(sources.withColumnRenamed("source", "s"), sized["source"].eqNullSafe(F.col("s")))
              .withColumn("v", _rank_value(F.col("size"), F.col("u"))))
    open_ = ranked.where("v < 1 AND wanted > 0").select("s", "wanted", "size", "v", "doc_id", "u")
    coarse_bin, fine_bin = _bins(F.col("v"))
    open_ = open_.withColumn("bin", coarse_bin).withColumn("fine", fine_bin)
    coarse = _crossing(open_.select("s", "wanted", "size", "bin"), "bin")
    inside = open_.drop("wanted").join(
        coarse.withColumnRenamed("s", "cs").withColumnRenamed("bin", "cut_bin"),
        F.col("s").eqNullSafe(F.col("cs")) & (F.col("bin") == F.col("cut_bin"))).drop("cs", "cut_bin")
    fine = _crossing(inside.select("s", "wanted", "size", "fine"), "fine")
    last = inside.drop("wanted").join(
        fine.withColumnRenamed("s", "fs").withColumnRenamed("fine", "cut_fine"),
        F.col("s").eqNullSafe(F.col("fs")) & (F.col("fine") == F.col("cut_fine")))
    order = Window.partitionBy("s").orderBy("v", F.col("doc_id").asc_nulls_last(), "size", "u")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the nearest prefix ends before, or with, the first document that passes the words wanted
    taken = (last.withColumn("running", running)
             .where(F.col("running") - F.col("size") / 2 <= F.col("wanted"))
             .groupBy("s").agg(F.max(F.struct("v", "running")).alias("m")).select("s", F.col("m.v").alias("cut")))
    bins = fine.select("s", (F.col("fine")).alias("fine_cut")).join(
        coarse.select(F.col("s").alias("cs"), F.col("bin").alias("bin_cut")), F.col("s").eqNullSafe(F.col("cs"))).drop("cs")
    cuts = bins.join(taken.select(F.col("s").alias("ts"), "cut"), F.col("s").eqNullSafe(F.col("ts")), "left").drop("ts")
    sources = sources.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return materialize(sources, "cuts")


def _crossing(rows: DataFrame, name: str) -> DataFrame:
    """Per source the bin in which the running words reach ``wanted``, and the words still wanted there."""
    sums = rows.groupBy("s", "wanted", name).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("s").orderBy(name)
    running = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.row_number().over(Window.partitionBy("s").orderBy(F.col(name).desc())) == 1
    sums = sums.withColumn("running", running).withColumn("last", last)
    reached = sums.where((F.col("running") >= F.col("wanted")) | F.col("last"))
    first = reached.groupBy("s").agg(F.min(F.struct(name, "words", "running", "wanted")).alias("m"))
    return first.select("s", f"m.{name}", (F.col("m.wanted") - F.col("m.running") + F.col("m.words")).alias("wanted"))


def _taken(wide: DataFrame, size: str, u: str, keep: list[str]) -> DataFrame:
    c = lambda name: F.col(f"__llm_s_{name}")
    v = _rank_value(F.col(size), F.col(u), c)
    bin_, fine = _bins(v)
    chosen = (F.when(bin_ != c("bin_cut"), bin_ < c("bin_cut"))
              .when(fine != c("fine_cut"), fine < c("fine_cut")).otherwise(v <= c("cut")))
    extra = F.when((c("wanted") > 0) & (v < 1) & F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    return wide.select(*(F.col(f"`{x}`") for x in keep), F.col(size).alias("__llm_size"),
                       c("source_size").alias("__llm_source_size"), c("target").alias("__llm_target"),
                       (c("whole") + extra).alias("__llm_copies"))


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return with_size(docs).withColumn("__llm_u", _uniform(F.col("doc_id"), F.md5(text.cast("binary"))))


def _with_sources(rows: DataFrame, table: DataFrame, weights, most: int) -> DataFrame:
    sources = mix_plan(table, weights, most)
    s = sources.select(*(F.col(c).alias(f"__llm_s_{c}") for c in sources.columns))
    return rows.join(s, F.col("source").eqNullSafe(F.col("__llm_s_source")))


def mix_report(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs`` (doc_id, text, source).

    NULL or empty texts have size 0 and take nothing. Repeated rows share one random number and
    are taken or left together. Sources without words have target 0. Other columns are ignored. No
    rows, no result.
    """
    table = materialize(_sized(docs.select("doc_id", "text", "source")).select(
        "doc_id", "source", F.col("__llm_size").alias("size"), F.col("__llm_u").alias("u")), "sized")
    return _taken(_with_sources(table, table, weights, most), "size", "u", ["doc_id"]).select(
        "doc_id", F.col("__llm_size").alias("size"), F.col("__llm_source_size").alias("source_size"),
        F.col("__llm_target").alias("target"), (F.col("__llm_size") * F.col("__llm_copies")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (texts without words: the whole copies
    of their source). All columns stay."""
    sized = _sized(docs)
    table = materialize(sized.select("doc_id", "source", F.col("__llm_size").alias("size"),
                                     F.col("__llm_u").alias("u")), "sized")
    many = _taken(_with_sources(sized, table, weights, most), "__llm_size", "__llm_u", docs.columns)
    many = many.where("__llm_copies > 0")
    return many.withColumn("__llm_copy", F.explode(F.sequence(F.lit(1), F.col("__llm_copies")))).select(
        *(F.col(f"`{c}`") for c in docs.columns))
