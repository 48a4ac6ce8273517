import hashlib
import re
import unicodedata

import pytest
import xxhash
from pyspark.sql import functions as F
from samples import no_docs, sample_docs, sample_rows

from geocairn.llm import spotsigs as sp


def signed(text):
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def brute_spots(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in lowered).split()
    out, run = set(), []
    for i, w in enumerate(words):
        if w in sp.ANCHORS:
            chain, passed = [], 0
            for x in words[i + 1:]:
                if x in sp.ANCHORS:
                    passed += 1
                elif passed < sp.REACH:
                    chain.append(x)
                if len(chain) == sp.CHAIN or passed == sp.REACH:
                    break
            if chain:
                out.add(signed(" ".join([w] + chain)))
    runs, start = [], 0
    for i in range(len(words) + 1):
        if i == len(words) or words[i] in sp.ANCHORS:
            runs.append(words[start:i])
            start = i + 1
    for run in runs:
        for i in range(sp.RUN, len(run)):
            out.add(signed(" ".join(run[i:i + sp.CHAIN + 1])))
    if out:
        return out
    if words:
        return {signed(" ".join(words))}
    return {signed(text)} if re.search(r"[^\x20\x09-\x0D]", text) else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_report_matches_brute_force(spark):
    rows = [(i, r[1], *r[2:]) for i, r in enumerate(sample_rows()) if i != 3]
    rows = [(None if i == 5 else i, *r[1:]) for i, r in enumerate(rows)]
    got = sp.spot_report(sample_docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        own = brute_spots(text)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, brute_spots(edited)),
                     jaccard(own, brute_spots(after)), len(own)))
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))] == [w[:3] for w in want]
    by_id = {r.doc_id: r for r in got}
    for doc_id, _, _, edited, after, n in want:
        assert (by_id[doc_id].near_edited, by_id[doc_id].near_next) == pytest.approx((edited, after))
        assert by_id[doc_id].n_spots == n
    texts = {}
    for r in got:
        texts.setdefault(next(x[1] or "" for x in rows if x[0] == r.doc_id), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in texts.values())


def test_many_buckets_give_the_same_neighbours(spark, monkeypatch):
    monkeypatch.setattr(sp, "_ROWS", 2)
    ids = [3, 7, 8, 9, 1000, 1001, 1002, 50_000, -4] + list(range(2000, 2100))
    docs = spark.createDataFrame([(i, f"the text number {i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in sp.with_next(docs).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"the text number {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_repeated_rows_and_one_row(spark):
    rows = sample_rows()
    got = sp.spot_report(sample_docs(spark))
    assert got.count() == len(rows)
    one = sp.spot_report(sample_docs(spark, [(1, "the green river in winter", "en", "s", None)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sp.spot_report(no_docs(spark)).collect() == []


def test_pruning_keeps_all_that_reach_the_threshold(spark):
    sets = [list(range(n)) for n in (0, 1, 4, 5, 9, 10, 11, 13)]
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<long>, b array<long>")
    rows = pairs.select(sp.likeness(F.col("a"), F.col("b")).alias("x"), sp.likeness(F.col("a"), F.col("b"), 0.8).alias("y")).collect()
    assert all(r.y == (r.x if r.x >= 0.8 else r.y) and r.y in (0.0, r.x) for r in rows)
    assert any(r.x > 0 and r.y == 0 for r in rows)
