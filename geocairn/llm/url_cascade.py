"""URL verdicts by ordered rules and a Bloom filter cascade, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geocairn.llm.common import LOWER, UPPER
from geocairn.plans.session import materialize, scratch_path

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Hosts with one of these labels or hyphenated parts are listed.
LISTED_TERMS = ("casino", "pills", "bets", "ads", "spam", "adult")
BITS_PER_KEY = 8
HASHES = 3
#: Most bytes of one filter; more listed keys are dealt into more shards.
FILTER_BYTES = 4 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): up to the first of ``/ ? #`` after ``://``, and from there up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else NULL."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def listed_host(host: Column, terms=LISTED_TERMS) -> Column:
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, terms)))


def _probes(key: Column, level: int, words: int) -> list[tuple[Column, Column]]:
    """(place of the 64-bit word, its bit) of each hash of the key at this level."""
    hashes = [F.xxhash64(F.lit(level), F.lit(j), key) for j in range(HASHES)]
    return [(F.pmod(F.shiftrightunsigned(h, 6), F.lit(words)).cast("int"),
             F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int")))
            for h in hashes]


def _filter(keys: DataFrame, level: int, words: int) -> DataFrame:
    """One row per shard with the filter of its keys as an array of ``words`` 64-bit words."""
    probes = F.array(*(F.struct(at.alias("at"), bit.alias("bit")) for at, bit in _probes(F.col("key"), level, words)))
    set_bits = (keys.select("shard", F.explode(probes).alias("p"))
                .groupBy("shard", "p.at").agg(F.bit_or("p.bit").alias("word")))
    every = keys.select("shard").distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(words - 1))))
    dense = every.join(set_bits, ["shard", "at"], "left").groupBy("shard").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("word", F.lit(0)).alias("word")))).alias("w"))
    return dense.select("shard", F.col("w.word").alias("words"))


def _passes(key: Column, level: int, words: int, filters: DataFrame, shard: int) -> Column:
    """Whether the key passes the filter, which reaches the tasks as the value of a scalar subquery."""
    array = filters.where(F.col("shard") == shard).select("words").scalar()
    hit = F.lit(True)
    for at, bit in _probes(key, level, words):
        hit = hit & (F.coalesce(F.get(array, at), F.lit(0)).bitwiseAND(bit) != 0)
    return hit


class Cascade:
    """Exact membership of listed keys in a closed universe of keys.

    Level 1 is a Bloom filter of the listed keys. The keys of the universe that pass it but aren't
    listed are put into level 2, the listed keys that pass that into level 3, and so on until nothing
    passes wrongly. A key of the universe is listed if the first filter that it fails is an even one
    (or if it passes all of an odd number). A filter holds at most about ``filter_bytes``: longer
    lists are dealt by hash into shards, each with filters of its own.
    """

    def __init__(self, universe: DataFrame, filter_bytes: int = FILTER_BYTES):
        """``universe``: distinct rows (key, listed)."""
        universe = materialize(universe, "universe")
        listed, keys = universe.agg(F.count(F.when(F.col("listed"), 1)), F.count("*")).first()
        # about 3 % of the other keys pass a filter of 8 bits a key with three hashes
        self.shards = max(1, -(-max(listed, keys // 16) * BITS_PER_KEY // 8 // filter_bytes))
        dealt = universe.withColumn("shard", self.shard_of(F.col("key")))
        encoded = dealt.where("listed").select("key", "shard")
        others = dealt.where("NOT listed").select("key", "shard")
        self.levels: list[tuple[int, DataFrame]] = []
        while True:
            most = encoded.groupBy("shard").count().agg(F.max("count")).first()[0]
            if not most:
                break
            level, words = len(self.levels) + 1, -(-most * BITS_PER_KEY // 64)
            filters = materialize(_filter(encoded, level, words), "filter")
            self.levels.append((words, filters))
            passed = [others.where(F.col("shard") == s).where(_passes(F.col("key"), level, words, filters, s))
                      for s in range(self.shards)]
            encoded, others = _written_one_by_one(passed, "passed"), encoded

    def shard_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(self.shards)).cast("int")

    def listed(self, key: Column, shard: int) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            words, filters = self.levels[level - 1]
            hit = _passes(key, level, words, filters, shard)
            answer = F.when(hit, answer).otherwise(F.lit(level % 2 == 0))
        return answer

    def mark(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        """``rows`` with a boolean column; no join, and no shuffle. Every key must be of the universe."""
        if self.shards == 1:
            return rows.withColumn(out, self.listed(F.col(key), 0))
        return _written_one_by_one(
            [rows.where(self.shard_of(F.col(key)) == s).withColumn(out, self.listed(F.col(key), s))
             for s in range(self.shards)], "marked")


def _written_one_by_one(parts: list[DataFrame], label: str) -> DataFrame:
    """All parts' rows; the filters of one shard are in memory at a time."""
    path = scratch_path(parts[0].sparkSession, label)
    for part in parts:
        part.write.mode("append").parquet(path)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)


def judge_urls(pages: DataFrame, rules=RULES, terms=LISTED_TERMS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url).

    Where no rule fits, a host on the list is blocked and any other allowed. The list is every host of
    the pages that has one of ``terms`` as a label or hyphenated part; the universe is every
    host of the pages. NULL urls, and urls without ``://``, have an empty host and path, which no rule
    fits. Repeated rows are judged alike, other columns are ignored; no rows, no result.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = parts.select(F.col("host").alias("key")).distinct()
    cascade = Cascade(hosts.withColumn("listed", listed_host(F.col("key"), terms)), filter_bytes)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    marked = cascade.mark(parts, "host", "listed")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(
        says, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
