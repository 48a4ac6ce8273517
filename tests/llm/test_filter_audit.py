"""The packed audit against a plain replay of every order."""

import itertools
import re

import pytest
from pyspark.sql import functions as F
from samples import no_docs, sample_docs, sample_rows

from geocairn.llm import filter_audit as fa

LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 40)] + [(3, 1, 1), (None, 1, 1), (7, None, None), (108, None, 1)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))


def brute(rows, marks):
    good = {i for i, q, _ in marks if i is not None and q == 1}
    toxic = {i for i, _, t in marks if i is not None and t == 1}
    docs = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, *_ in rows)}
        docs.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                here = [d for d in left if d[1][c]]
                failing = [d for d in own if d[1][c]]
                only = [d for d in failing if sum(d[1].values()) == 1]
                left = [d for d in left if not d[1][c]]
                out[part, order, step] = (len(left), len(here), len(failing) - len(here), sum(d[2] for d in here),
                                          sum(d[3] for d in here), len(only))
                shapley[part, c] = shapley.get((part, c), 0) + len(here)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_a_replay_of_all_orders(spark, parts, monkeypatch):
    monkeypatch.setattr(fa, "_PARTS", 1)  # what a task has summed is passed on early
    rows = sample_rows() + [(300 + i, "same text " * 60, None if i % 2 else "de", "s", 1) for i in range(30)]
    rows += [(2, "A B C " * 50, "", "s", 1), (2, "A B C " * 50, "", "s", 1), (None, "A B C " * 50, "en", "s", 1)]
    got = fa.filter_audit(sample_docs(spark, rows).repartition(parts), labels(spark))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "good_lost", "toxic_lost",
                           "unique_fails", "shapley"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, LABELS)


def test_no_documents_and_no_labels(spark):
    assert fa.filter_audit(no_docs(spark), labels(spark)).count() == 0
    got = fa.filter_audit(sample_docs(spark), labels(spark).limit(0))
    assert got.count() == 600 * 3 and got.where("good_lost + toxic_lost > 0").count() == 0


def test_fields_hold_large_counts_side_by_side():
    total = (2 ** 62) * fa.packed(0b00001, True, False) + 7 * fa.packed(0b11111, False, True)
    counts = fa.unpacked(total.to_bytes(fa.n_bytes(), "little"))
    assert counts[:5].tolist() == [0, 2 ** 62 + 7, 0, 2 ** 62, 7]  # step A of ABCDE
    assert counts[5:10].tolist() == [0, 0, 7, 0, 0] and counts[-5:].tolist() == [2 ** 62, 0, 0, 0, 0]
