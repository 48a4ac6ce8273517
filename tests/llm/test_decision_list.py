import random
import re
from collections import Counter

import numpy as np
from samples import no_docs, sample_docs, sample_rows

from geocairn.llm import decision_list as dl


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(spark):
    rng = random.Random(8)
    rows = sample_rows() + [(200 + i, " ".join(rng.choice("ab#|") for _ in range(30)) + "\na b\na b", "en", "s", None)
                            for i in range(30)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = dl.quality_report(sample_docs(spark, rows), labels).collect()
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)


def labelled(n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [rng.choice("river stone window green paper metal".split()) + str(rng.randrange(99)) for _ in range(60)]
        if bad:
            words = [w + "###" for w in words] if i % 2 else [w + " |" for w in words]
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, int(not bad), "x"))
    return rows, labels


def test_rules_separate_held_out_documents(spark):
    rows, labels = labelled()
    table = spark.createDataFrame(labels[:600] + labels[:20] + [(None, 0, "x"), (5, None, "x")],
                                  "doc_id long, quality int, n_words string")
    got = {r.doc_id: r.kept for r in dl.quality_report(sample_docs(spark, rows), table).collect()}
    held_out = [(got[i], bool(q)) for i, q, _ in labels[600:]]
    assert sum(a == b for a, b in held_out) >= 0.97 * len(held_out)


def test_rules_are_ordered_threshold_conditions():
    rng = np.random.default_rng(1)
    x, y = rng.random(4000), rng.random(4000)
    data = {"symbols_per_word": x, "chars_per_word": y}
    bad = (x > 0.8) | ((y < 0.2) & (x < 0.5))
    rules = dl.learn(data, bad, np.arange(4000) % 3)
    found = np.zeros(4000, bool)
    for rule in rules:
        found |= dl.covers(rule, data)
    assert 2 <= len(rules) <= 6 and (found == bad).mean() > 0.98
    assert all("symbols" in c.sql() or "chars" in c.sql() or "word" in c.sql() for r in rules for c in r)


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert dl.quality_report(no_docs(spark), labels).collect() == []
    got = dl.quality_report(sample_docs(spark), labels).collect()
    assert all(r.kept == (not r.base_failed) for r in got)
