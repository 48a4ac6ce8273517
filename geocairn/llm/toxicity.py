"""Toxicity: severity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocairn.llm.common import share_below, texts, with_columns
from geocairn.plans.session import materialize

#: Most labelled documents that the model is fitted on.
FIT_ROWS = 20_000
#: Size of the model: the features that differ most between toxic and clean documents.
FEATURES = 2_048
MIN_DOCS = 5
#: Least squared difference from the expected number of toxic documents, over that number.
SIGNIFICANT = 15.0
#: Grade 0 is clean; toxic documents have grades 1 to 3.
GRADES = 4
PREFIXES = (4, 5, 6)
#: Of five labelled documents one is held out of the fit; the cut is chosen on those.
HELD_OUT = 5
#: Share of clean held-out documents that the cut leaves alone at least.
CLEAN_LEFT = 0.97
#: Held-out documents of each class without which the cut follows the share of toxic documents instead.
_ENOUGH = 20
_SPLIT = re.compile(r"\w+")
_FLUSH = 300_000


def features(text: str) -> tuple[Counter, int]:
    """How often each feature occurs, and the number of words: words in lower case, and their beginnings."""
    words = _SPLIT.findall(text.lower())
    found = Counter(words)
    for word, n in list(found.items()):
        for size in PREFIXES:
            if len(word) > size:
                found[word[:size] + "*"] += n
    return found, len(words)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, documents), summed in the task and flushed when many."""
    def table(toxic, every):
        names = list(every)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
             pa.array(every.values(), pa.int64())], ["feature", "toxic", "every"])

    toxic, every = Counter(), Counter()
    for batch in batches:
        for text, bad in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
            found = features(text)[0].keys()
            every.update(found)
            if bad:
                toxic.update(found)
            if len(every) > _FLUSH:
                yield table(toxic, every)
                toxic, every = Counter(), Counter()
    yield table(toxic, every)


@dataclass
class Model:
    """P(grade <= k) = sigmoid(cut[k] - score): one weight a feature for all of the ordered cuts."""

    place: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray
    #: A document is toxic if grade 1 or more has this probability.
    toxic_from: float = 0.5
    #: Shares of held-out toxic documents caught and of clean ones left alone; None if there were too few.
    held_out: tuple[float, float] | None = None

    def row(self, text: str) -> tuple[list[int], list[float]]:
        """Places and values of the text's features; the last feature is the length."""
        words = _SPLIT.findall(text.lower())
        counts: Counter = Counter()
        whole, short, place = self._known(), self._beginnings(), self.place
        for word in words:
            if word[:PREFIXES[0]] in short:
                if word in whole:
                    counts[place[word]] += 1
                for size in PREFIXES:
                    if len(word) > size and (at := place.get(word[:size] + "*")) is not None:
                        counts[at] += 1
        at = [*counts, len(place)]
        return at, [*np.log1p(list(counts.values())), np.log1p(len(words)) / 10]

    def _known(self):
        if not hasattr(self, "_whole"):
            self._whole = {f for f in self.place if not f.endswith("*")}
        return self._whole

    def _beginnings(self):
        if not hasattr(self, "_short"):
            self._short = {f.rstrip("*")[:PREFIXES[0]] for f in self.place}
        return self._short

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade, a row per score."""
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.cuts[None, :], -40, 40)))
        return np.diff(below, axis=1, prepend=0.0, append=1.0)


def fit(of: np.ndarray, at: np.ndarray, x: np.ndarray, grade: np.ndarray, n_features: int,
        n_grades: int = GRADES, steps: int = 500, ridge: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, increasing cuts) of the proportional odds model by accelerated gradient steps.

    Entry i says that feature ``at[i]`` of row ``of[i]`` is ``x[i]``.
    """
    n = grade.size
    part = np.cumsum(np.bincount(grade, minlength=n_grades) + 0.5)[:-1] / (n + 0.5 * n_grades)
    cuts = np.log(part / (1 - part))
    theta = np.concatenate([np.zeros(n_features), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, raw = theta[:n_features], theta[n_features:]
        gaps = np.exp(raw[1:])
        edge = np.concatenate([[-np.inf], raw[0] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(of, x * w[at], n)
        with np.errstate(over="ignore"):
            hi, lo = (1 / (1 + np.exp(score - edge[grade + k])) for k in (1, 0))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        slope = np.bincount(at, x * (d_hi - d_lo)[of], n_features) / n + ridge * w
        by_cut = np.bincount(grade, -d_hi, n_grades)[:-1] + np.bincount(grade, d_lo, n_grades)[1:]
        tail = np.cumsum(by_cut[::-1])[::-1] / n
        gradient = np.concatenate([slope, tail[:1], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        theta = theta - 0.05 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
    raw = theta[n_features:]
    return theta[:n_features], raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def best_cut(p: np.ndarray, toxic: np.ndarray, clean_left: float = CLEAN_LEFT) -> float:
    """The probability from which most toxic documents are caught and clean ones left alone (the sum of both shares),
    among those that leave ``clean_left`` of the clean ones alone; the largest of equal ones."""
    marks = np.unique(p)
    cuts = np.append((marks[:-1] + marks[1:]) / 2, marks[-1] + 1e-9)  # halfway, so that no document lies on a cut
    left = np.searchsorted(np.sort(p[~toxic]), cuts) / (~toxic).sum()
    caught = 1 - np.searchsorted(np.sort(p[toxic]), cuts) / toxic.sum()
    score = np.where(left >= clean_left, caught + left, -1)
    return float(cuts[np.nonzero(score == score.max())[0][-1]])


def learn(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model | None:
    """A model from ``labels`` (doc_id, toxic 0/1), or None unless both classes are labelled.

    About ``bound`` labelled documents are used, the same in every run; a repeated label counts as
    toxic if any is, and of rows that repeat a doc_id the one with the smallest text hash counts. Their texts stay
    in Spark: the driver gets the chosen features and, per document, its sparse counts. Labels say only whether a
    document is toxic. Toxic documents get grades 1 to 3 by how dense features of toxic documents are in them, cut at
    terciles. One of ``HELD_OUT`` documents takes no part in features and fit; ``best_cut`` of those decides from
    which probability a document is toxic. If they are too few, all take part and the cut is twice the share of
    toxic documents, one half at most.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = materialize(known.where(share_below(F.col("doc_id"), known.count(), bound)), "sample")
    # bounded by ``bound`` rows of two numbers, so broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"),
        (F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0).alias("held"))
    chosen = materialize(chosen, "labelled")
    n, bad, n_held, bad_held = chosen.agg(F.count("*"), F.sum("toxic"), F.count_if("held"), F.sum(F.col("held").cast("int") * F.col("toxic"))).first()
    if not bad or n == bad:
        return None
    hold = min(bad_held, n_held - bad_held) >= _ENOUGH and 0 < bad - bad_held < n - n_held
    if hold:
        n, bad = n - n_held, bad - bad_held
    else:
        chosen = chosen.withColumn("held", F.lit(False))
    counts = (chosen.where("NOT held").select("text", "toxic").mapInArrow(_document_counts, "feature string, toxic long, every long")
              .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every"))
              .where(F.col("every") >= MIN_DOCS))
    expected = F.col("every") * (bad / n)
    away = F.col("toxic") - expected
    ranked = counts.withColumn("away", away * F.abs(away) / expected).where(F.abs("away") >= SIGNIFICANT)
    ranked = ranked.orderBy(F.abs("away").desc(), "feature").limit(FEATURES)
    best = [(r.feature, r.away) for r in ranked.collect()]
    place = {f: i for i, (f, _) in enumerate(best)}
    model = Model(place, np.zeros(len(place) + 1), np.zeros(GRADES - 1))
    kind = T.StructType([T.StructField("doc_id", chosen.schema["doc_id"].dataType), T.StructField("toxic", T.LongType()),
                         T.StructField("held", T.BooleanType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def sparse(batches):
        for batch in batches:
            rows = [model.row(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(batch.column("toxic").to_pylist(), pa.int64()), batch.column("held"),
                 pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                ["doc_id", "toxic", "held", "at", "x"])

    table = chosen.select("doc_id", "toxic", "held", "text").mapInArrow(sparse, kind).toArrow().sort_by("doc_id").combine_chunks()
    toxic = table["toxic"].to_numpy() > 0
    at, x = (pc.list_flatten(table[c]).to_numpy() for c in ("at", "x"))
    of = np.repeat(np.arange(toxic.size), pc.list_value_length(table["at"]).to_numpy())
    leaning = np.array([a > 0 for _, a in best] + [False])
    words = np.expm1(10 * np.bincount(of, x * (at == len(place)), toxic.size))
    dense = np.bincount(of, np.expm1(x) * leaning[at], toxic.size) / np.maximum(words, 1)
    held = table["held"].to_numpy(zero_copy_only=False)
    terciles = np.quantile(dense[toxic & ~held], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(terciles, dense, side="left"), 0)
    own, row = ~held[of], np.cumsum(~held) - 1
    model.weights, model.cuts = fit(row[of[own]], at[own], x[own], grade[~held], len(place) + 1)
    model.toxic_from = min(0.5, 2 * bad / n)
    if hold:
        p = 1 - model.grades(np.bincount(of, x * model.weights[at], toxic.size))[held, 0]
        model.toxic_from = best_cut(p, toxic[held])
        model.held_out = float((p[toxic[held]] >= model.toxic_from).mean()), float((p[~toxic[held]] < model.toxic_from).mean())
    return model


def with_severity(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with severity (expected grade, 0 to 3), p_toxic (probability of grade 1 or more) and
    toxic. A NULL text is an empty one; a text without words is clean. Without a model all are clean."""
    def compute(batch):
        rows = [model.row(t) if model and t else ([], []) for t in texts(batch[text])]
        empty = np.array([len(r[0]) < 2 and not (r[1] and r[1][-1]) for r in rows], bool)
        score = np.array([float(np.dot(model.weights[r[0]], r[1])) if r[0] else 0.0 for r in rows])
        chance = model.grades(score) if model else np.eye(1, GRADES).repeat(len(rows), axis=0)
        chance[empty] = np.eye(1, GRADES)
        p = 1 - chance[:, 0]
        return [pa.array(np.round(chance @ np.arange(GRADES), 6)), pa.array(np.round(p, 6)), pa.array(p >= (model.toxic_from if model else 0.5))]

    return with_columns(docs, [("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("toxic", T.BooleanType())],
                        compute, [text])


def toxicity_report(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """(doc_id, severity, p_toxic, toxic) per row of ``docs`` (doc_id, text); other columns are ignored."""
    scored = with_severity(docs.select("doc_id", "text"), learn(docs, labels, bound))
    return scored.select("doc_id", "severity", "p_toxic", "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model finds clean, with all of their columns."""
    names = {c: f"__llm_own_{c}" for c in ("severity", "p_toxic", "toxic") if c in docs.columns}
    scored = with_severity(docs.withColumnsRenamed(names), learn(docs, labels, bound)).where("NOT toxic")
    return scored.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))
