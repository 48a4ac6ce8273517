import numpy as np
import pytest
import xxhash
from samples import no_docs, sample_docs, sample_rows

from geocairn.llm import connect, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, prints, radius=3):
    group = list(range(len(ids)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[max(top(i), top(j))] = min(top(i), top(j))
    out = []
    for i in range(len(ids)):
        named = [ids[j] for j in range(len(ids)) if top(j) == top(i) and ids[j] is not None]
        out.append(min(named, default=None))
    return out


def test_groups_match_brute_force(spark):
    rows = sample_rows()
    got = sorted(map(tuple, simhash.simhash_groups(sample_docs(spark)).collect()), key=str)
    prints = [brute_print(r[1]) for r in rows]
    groups = brute_groups([r[0] for r in rows], prints)
    assert got == sorted(((r[0], f"{p:016x}", g) for r, p, g in zip(rows, prints, groups)), key=str)


@pytest.mark.parametrize("tile", [2, 1024])
def test_links_reach_what_brute_force_reaches(spark, tile):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    for _ in range(200):  # chains of near prints, many in the same cells
        x = prints[rng.integers(len(prints))]
        for _ in range(rng.integers(1, 6)):
            x ^= 1 << int(rng.integers(0, 64))
        prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.simhash_components(df, tile=tile).collect()}
    assert [got[s] for s in signed] == brute_groups(list(range(len(prints))), prints)


def test_one_row_of_each_group_stays(spark):
    docs = sample_docs(spark)
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    rows = sample_rows()
    groups = brute_groups(list(range(len(rows))), [brute_print(r[1]) for r in rows])
    got = kept.select("doc_id", "text").collect()
    assert len(got) == len(set(groups))
    assert len({brute_print(r.text) for r in got}) == len(got)
    ids = [r.doc_id for r in got]
    assert 108 not in ids and 109 not in ids and 7 in ids


def test_no_rows(spark):
    assert simhash.simhash_groups(no_docs(spark)).collect() == []
    assert simhash.keep_one_each(no_docs(spark)).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    df = spark.createDataFrame(chain + star, "a long, b long").repartition(7)
    got = {r.node: r.root for r in connect.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 1000 for i in range(1001, 1400)}}
