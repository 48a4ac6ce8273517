"""Quality rules: a decision list learned by sequential covering on text statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocairn.llm.common import share_below, texts, with_columns
from geocairn.plans.session import materialize

#: Most labelled rows that the rules are learned from.
LEARN_ROWS = 20_000
#: Smallest share of rejected rows among those a rule covers, on rows it was not grown from.
PRECISION = 0.9
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What conditions are made of, as SQL over the statistics; nothing divides by zero.
RATIOS = {
    "n_words": "n_words", "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)", "n_dup_lines": "n_dup_lines",
}
_SPACE = "\t\n\v\f\r "
_SYMBOL = re.compile(r"[#*$%&|<>]")
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 5


def words_of(text: str) -> list[str]:
    """Runs of anything but ASCII white space."""
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """STATS of a text: words, their code points, symbols, repeated lines, words in repeated windows."""
    words = words_of(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            first: dict = {}
            twice = np.zeros(len(windows), np.int64)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    twice[i] = twice[j] = 1
            reach = np.convolve(twice, np.ones(WINDOW, np.int64))
            repeated = int(np.count_nonzero(reach))
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeated


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with STATS; a NULL text has no words and no lines."""
    def compute(batch):
        rows = [statistics(t) for t in texts(batch[text])]
        return [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(STATS))]

    return with_columns(docs, [(s, T.LongType()) for s in STATS], compute, [text])


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"{RATIOS[self.name]} {'>=' if self.above else '<'} {self.cut!r}D"

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.name] >= self.cut if self.above else data[self.name] < self.cut


Rule = list[Condition]


def covers(rule: Rule, data: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(next(iter(data.values())).size, bool)
    for c in rule:
        held &= c.holds(data)
    return held


def _grow(data, bad, rows) -> Rule:
    """Adds the condition of the largest information gain until only rejected rows are covered."""
    rule: Rule = []
    held = rows.copy()
    while (p := int((held & bad).sum())) and (n := int((held & ~bad).sum())) and len(rule) < 4:
        best, gain = None, 0.0
        for name, values in data.items():
            v, y = values[held], bad[held]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            edges = np.nonzero(v[1:] > v[:-1])[0] + 1
            if not edges.size:
                continue
            hits = np.concatenate([[0], np.cumsum(y)])
            for above in (False, True):
                tp = hits[-1] - hits[edges] if above else hits[edges]
                size = v.size - edges if above else edges
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(tp > 0, tp * (np.log2(tp / size) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(g))
                if g[k] > gain + 1e-9:
                    a, b = v[edges[k] - 1], v[edges[k]]
                    cut = round(float((a + b) / 2), 4)
                    gain, best = float(g[k]), Condition(name, above, cut if a < cut <= b else float(b))
        if best is None:
            break
        rule.append(best)
        held &= best.holds(data)
    return rule


def _prune(rule: Rule, data, bad, rows) -> Rule:
    """The leading conditions that separate best on rows the rule was not grown from."""
    def worth(r):
        held = covers(r, data) & rows
        return (2 * (held & bad).sum() - held.sum()) / max(1, held.sum()), (held & bad).sum()

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])


def learn(data: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = PRECISION,
          most: int = 12) -> list[Rule]:
    """Ordered rules for the ``bad`` rows by sequential covering.

    Rules grow on the rows of fold 0 and 1 and are pruned and judged on fold 2. What a rule covers
    is taken out before the next one grows; the list ends with the first rule under ``precision``
    there, or which covers no row there.
    """
    rules: list[Rule] = []
    left = np.ones(bad.size, bool)
    while len(rules) < most and (left & bad & (fold < 2)).any():
        rule = _prune(_grow(data, bad, left & (fold < 2)), data, bad, left & (fold == 2))
        held = covers(rule, data) & left if rule else np.zeros(bad.size, bool)
        judged = held & (fold == 2)
        if not judged.any() or (judged & bad).sum() < precision * judged.sum():
            break
        rules.append(rule)
        left &= ~held
    return rules


def learn_rules(stats: DataFrame, labels: DataFrame, bound: int = LEARN_ROWS, precision: float = PRECISION) -> list[Rule]:
    """Rules learned from ``labels`` (doc_id, quality) joined to ``stats`` (doc_id, STATS).

    Repeated labels of a document count once (the lowest quality). About ``bound`` labelled documents, the
    same in every run, reach the driver as six numbers each. Labels that are NULL, of one class
    only, or of no document give no rules.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.where(share_below(F.col("doc_id"), known.count(), bound))
    # of rows that repeat a doc_id the one with the smallest statistics counts
    one_each = stats.select("doc_id", *STATS).join(sample, "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(*STATS)).alias("least"), F.min("quality").alias("quality")).select("doc_id", "quality", "least.*")
    table = one_each.select("doc_id", "quality", *(F.expr(e).cast("double").alias(f"r_{n}") for n, e in RATIOS.items()),
                            F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).alias("fold")).toPandas().sort_values("doc_id")
    if table.empty:
        return []
    data = {n: table[f"r_{n}"].to_numpy() for n in RATIOS}
    return learn(data, table["quality"].to_numpy() == 0, table["fold"].to_numpy(), precision)


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule of the list holds, as one conditional expression in the rules' order."""
    out = None
    for rule in rules:
        condition = F.expr(" AND ".join(f"({c.sql()})" for c in rule))
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def quality_report(docs: DataFrame, labels: DataFrame, bound: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, STATS, base_failed, kept) per row of ``docs`` (doc_id, text).

    ``kept`` is false where the base fails, else what the learned rules say. NULL and empty texts have
    no words, so the base fails. Repeated rows get the same verdict; other columns are ignored.
    """
    stats = materialize(with_statistics(docs.select("doc_id", "text")).select("doc_id", *STATS), "stats")
    rules = learn_rules(stats, labels, bound)
    failed = F.expr(BASE_FAILED)
    return stats.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
