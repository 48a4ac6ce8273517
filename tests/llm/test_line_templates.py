import random

from pyspark.sql import functions as F
from samples import DOCS, no_docs, sample_docs, sample_rows

from geocairn.llm import line_templates as lt


def same_template(a, b):
    """Brute force: parsed alike, or the same leaf and four of five places equal."""
    if a == b:
        return True
    n, d = len(a), lt.depth(len(a))
    return n == len(b) and n >= lt.AGREE and a[:d] == b[:d] and sum(x != y for x, y in zip(a, b)) <= n // lt.AGREE


def rows_of(texts):
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


def cut(spark, texts, **kw):
    docs = sample_docs(spark, rows_of(texts))
    got = lt.drop_recurring_lines(docs, **kw)
    return {r.doc_id: r.text for r in got.collect()}


def test_recurring_lines_stay_in_the_first_document_only(spark):
    rng = random.Random(2)
    own = [f"text {'abcdefghij'[i]} " + " ".join(rng.choice("river stone lamp cloud".split()) for _ in range(12)) for i in range(10)]
    passage = " ".join(f"word{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(60))
    texts = [own[i] + "\n" + (passage + "\n" if i in (3, 5, 8) else "") + f"Page {i} of 20\n\nend {'abcdefghij'[i]}" for i in range(10)]
    texts[3] += "\n" + passage
    got = cut(spark, texts)
    for i in range(10):
        lines = got[i].split("\n")
        assert own[i] in lines and f"end {'abcdefghij'[i]}" in lines and "" in lines
        assert (f"Page {i} of 20" in lines) == (i == 0)
        assert lines.count(passage) == (1 if i == 3 else 0)


def test_lines_that_differ_in_one_place_of_five_share_a_template(spark):
    names = "ann bob cid dan eve fay gus hal".split()
    texts = [f"Sent by the office clerk of {n} on a Monday\nquite another line about {n} and {names[-i - 1]} {n}{n}" for i, n in enumerate(names)]
    got = cut(spark, texts)
    assert got[0].count("\n") == 1
    assert all("Sent by" not in got[i] and "quite another" in got[i] for i in range(1, 8))


def test_matches_brute_force_on_exact_and_generalised_lines(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.choice([1, 2, 4]))) for _ in range(40)]
    long_pool = [" ".join([f"lead{k}", "of", "x"] + [f"w{'abcde'[k % 5]}{'fghij'[j % 5]}" for j in range(9)]) for k in range(6)]

    def line():
        if rng.random() < 0.5:
            return rng.choice(pool)
        words = rng.choice(long_pool).split()
        if rng.random() < 0.5:
            words[11] = rng.choice("red blue gold".split())
        return " ".join(words)

    texts = ["\n".join(line() for _ in range(6)) for _ in range(40)]
    got = cut(spark, texts)
    parsed = {x: lt.parse(x.encode()) for t in texts for x in t.split("\n")}
    for i, t in enumerate(texts):
        kept = []
        for k, x in enumerate(t.split("\n")):
            alike = {y for y in parsed if same_template(parsed[x], parsed[y])}
            docs = [j for j, u in enumerate(texts) if alike & set(u.split("\n"))]
            earlier = any(y in alike for y in t.split("\n")[:k])
            if len(docs) < lt.MIN_DOCS or docs[0] == i and not earlier:
                kept.append(x)
        assert got[i] == "\n".join(kept)


def test_a_single_document_keeps_its_repeated_lines(spark):
    got = cut(spark, ["same\nsame\nsame\nsame\n1\n2\n3", "other"])
    assert got[0] == "same\nsame\nsame\nsame\n1\n2\n3"


def test_full_leaves_are_cut_into_runs(spark, monkeypatch):
    monkeypatch.setattr(lt, "LEAF_LINES", 5)
    nodes = [(1, h, h, 1, h, h, f"one two three f{h // 3} g h i j k l".encode()) for h in range(30)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*nodes)], lt._NAMES)
    out = [r for b in lt._grow(3)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert len(out) == 30 and all(first <= h for h, _, _, first in out)


def test_lines_of_one_template_meet_in_a_full_leaf(spark, monkeypatch):
    monkeypatch.setattr(lt, "LEAF_LINES", 5)
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    family = [f"one two three {name(60 * i)} g h i j k l" for i in range(6)]
    others = [f"one two three {name(i)} " + " ".join(f"{c}{name(i)}" for c in "ghijkl") for i in range(360)]
    got = cut(spark, [f"{x}\n" + "\n".join(others[60 * i:60 * i + 60]) for i, x in enumerate(family)])
    assert [family[i] in got[i].split("\n") for i in range(6)] == [True] + [False] * 5
    assert sum(t.count("one two three") for t in got.values()) == 361


def test_long_passages_go_when_two_documents_have_them(spark):
    words = [f"word{'abcdefgh'[i % 8]}{'xyz'[i % 3]}{'pqrst'[i // 12]}" for i in range(51)]
    long, short = " ".join(words), " ".join(words[:50])
    got = cut(spark, ["own\n" + long, "other\n" + long + "\n" + short + "\nend", "third\n" + short])
    assert got == {0: "own\n" + long, 1: "other\n" + short + "\nend", 2: "third\n" + short}


def test_awkward_documents(spark):
    docs = sample_docs(spark)
    got = lt.drop_recurring_lines(docs)
    assert [c for c in got.columns if c in docs.columns] == docs.columns
    assert set(got.columns) - set(docs.columns) == {"n_lines", "n_dropped"}
    assert got.count() == docs.count()
    assert got.where("text IS NULL").count() == sum(r[1] is None for r in sample_rows())
    # rows 7 (repeated) keep their text, its copies under larger ids lose it
    copies = [r.text for r in got.where("doc_id IN (108, 109)").collect()]
    assert copies == ["", ""]
    assert got.where("doc_id = 7").where(F.length("text") == 0).count() == 0
    assert lt.drop_recurring_lines(no_docs(spark)).collect() == []
    nameless = spark.createDataFrame([(None, "twin line", None, None, None)] * 4, DOCS)
    assert {r.text for r in lt.drop_recurring_lines(nameless).collect()} == {"twin line"}
