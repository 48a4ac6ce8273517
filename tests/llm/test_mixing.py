import random

import pytest
from samples import DOCS, no_docs, sample_docs, sample_rows

from geocairn.llm import mixing


def brute_targets(sizes):
    """Shares by weight, again and again, until no target is above three times its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    open_ = list(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not over:
            return full | {s: share * weight[s] for s in open_}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]
        open_ = [s for s in open_ if s not in over]
    return full


def sizes_of(rows):
    out = {}
    for _, text, _, source, *_ in rows:
        out[source] = out.get(source, 0) + len((text or "").encode().split())
    return out


def test_targets_and_sizes_match_brute_force(spark):
    rows = sample_rows()
    got = mixing.mix_report(sample_docs(spark)).collect()
    assert len(got) == len(rows)
    sizes, targets = sizes_of(rows), brute_targets(sizes_of(rows))
    want = sorted(((r[0], len((r[1] or "").encode().split()), sizes[r[3]]) for r in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=str) == want
    by_size = {}
    for r in got:
        by_size.setdefault(r.source_size, set()).add(r.target)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s, size in sizes.items():
        assert any(t == pytest.approx(targets[s]) for t in by_size[size])


def many_rows(n=3000):
    rng = random.Random(3)
    return [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1) + 1)), "en", f"s{i % 7}" if i % 3 else "hot", None)
            for i in range(n)]


def test_taken_words_come_near_the_targets(spark):
    rows = many_rows()
    docs = sample_docs(spark, rows)
    report = mixing.mix_report(docs)
    got = report.collect()
    again = mixing.mix_report(docs.repartition(11)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r[0]: r[3] for r in rows}
    longest = max(r.size for r in got)
    taken, target = {}, {}
    for r in got:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        target[source[r.doc_id]] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= longest / 2 + 1
    assert any(r.taken == 0 for r in got) and any(r.taken > 0 for r in got)


def test_mix_repeats_rows_as_reported(spark):
    docs = sample_docs(spark, many_rows(400))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for r in mixing.mix_report(docs).collect():
        assert count.get(r.doc_id, 0) * r.size == r.taken


def test_inclusion_follows_the_odds(spark):
    """Long documents are taken more often than short ones of the same source."""
    rows = [(i, " ".join(["w"] * (1 if i % 2 else 60)), "en", "abc"[i % 3], None) for i in range(6000)]
    got = mixing.mix_report(spark.createDataFrame(rows, DOCS)).collect()
    part = [r for r in got if r.target < 0.9 * r.source_size]
    rate = [sum(r.taken > 0 for r in part if (r.size > 1) == long) / sum((r.size > 1) == long for r in part)
            for long in (True, False)]
    assert rate[0] > rate[1] + 0.1


def test_awkward_tables(spark):
    assert mixing.mix_report(no_docs(spark)).collect() == []
    assert mixing.mix(no_docs(spark)).collect() == []
    empty = sample_docs(spark, [(1, None, None, None, None), (2, "", "en", "s", 0)])
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_report(empty).collect())
    assert mixing.mix(empty).count() == 0
