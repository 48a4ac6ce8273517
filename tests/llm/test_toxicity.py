import random

import numpy as np
from samples import no_docs, sample_docs, sample_rows

from geocairn.llm import toxicity as tox

MARKS = ["vile", "nasty", "rotten", "foul"]


def labelled(n=900):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("river stone lamp green paper cloud metal engine".split()) for _ in range(rng.choice([20, 60]))]
        bad = i % 6 == 0
        for _ in range(rng.randrange(2, 6) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(MARKS) + ("ness" if rng.random() < 0.3 else "")
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = labelled()
    table = spark.createDataFrame(labels[:600] + [(None, 1), (3, None)] + labels[:5], "doc_id long, toxic int")
    docs = sample_docs(spark, rows)
    got = {r.doc_id: r for r in tox.toxicity_report(docs, table).collect()}
    right = [got[i].toxic == bool(y) for i, y in labels[600:]]
    assert sum(right) >= 0.98 * len(right)
    # one cut for all documents
    assert min(r.p_toxic for r in got.values() if r.toxic) > max(r.p_toxic for r in got.values() if not r.toxic)
    assert all(0 <= r.severity <= 3 for r in got.values())
    mean = lambda y: np.mean([got[i].severity for i, t in labels[600:] if t == y])
    assert mean(1) > 1 > 0.3 > mean(0)
    kept = tox.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, tox.toxicity_report(docs.repartition(9), table).collect()))


def test_the_cut_follows_the_held_out_documents(spark):
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randrange(2, 30)
        toxic = np.array([True, False] + [rng.random() < 0.4 for _ in range(n)])
        p = np.round(np.array([rng.random() * 0.7 + 0.3 * t for t in toxic]), 1)
        cut = tox.best_cut(p, toxic, 0.8)
        left, caught = (p[~toxic] < cut).mean(), (p[toxic] >= cut).mean()
        want = max((p[~toxic] < c).mean() + (p[toxic] >= c).mean() for c in np.append(p, 2) - 1e-6 if (p[~toxic] < c).mean() >= 0.8)
        assert left >= 0.8 and abs(left + caught - want) < 1e-9 and not (p == cut).any()
    rows, labels = labelled()
    model = tox.learn(sample_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert min(model.held_out) > 0.9 and 0 < model.toxic_from < 1
    few = tox.learn(sample_docs(spark, rows), spark.createDataFrame(labels[:60], "doc_id long, toxic int"))
    assert few.held_out is None and few.toxic_from == 2 * 10 / 60


def test_repeated_ids_give_the_same_model(spark):
    rows, labels = labelled(400)
    twice = rows + [(i, "another text " + t[::-1], *more) for i, t, *more in rows[::3]]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    models = [tox.learn(sample_docs(spark, given).repartition(n), table) for given, n in ((twice, 2), (twice[::-1], 7))]
    assert models[0].place == models[1].place and np.allclose(models[0].weights, models[1].weights)
    assert models[0].toxic_from == models[1].toxic_from


def test_regression_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    n, k = 4000, 3
    x = rng.normal(size=(n, k))
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=n)
    grade = np.searchsorted([0.5, 2.0, 3.5], score)
    of, at = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    w, cuts = tox.fit(of, at, x.ravel(), grade, k)
    assert np.abs(w - [2, -1, 0]).max() < 0.2 and np.abs(cuts - [0.5, 2, 3.5]).max() < 0.3
    p = tox.Model({}, w, cuts).grades(x @ w)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and np.corrcoef(p @ np.arange(4), grade)[0, 1] > 0.7


def test_awkward_documents(spark):
    rows, labels = labelled(300)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    odd = [(r[0] + 5000 if r[0] is not None else None, *r[1:]) for r in sample_rows()]
    docs = sample_docs(spark, rows + odd)
    got = tox.toxicity_report(docs, table).collect()
    assert len(got) == len(rows) + len(odd)
    assert not any(r.toxic for r in got if r.doc_id in (5100, 5101, 5102))
    assert tox.toxicity_report(no_docs(spark), table).collect() == []
    one_class = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.severity for r in tox.toxicity_report(docs, one_class).collect()} == {0.0}
