import hashlib
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import no_docs, sample_docs, sample_rows

from geocairn.llm import pii

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = digits[-1::-2], digits[-2::-2]
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and (sum(map(int, odd[0])) + sum(sum(divmod(2 * int(d), 10)) for d in odd[1])) % 10 == 0,
                    "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def digest(spans):
    spans = sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def noisy(rng, n):
    bits = ["@", "a", "x.y", "1", "255", "256", ".", "..", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "\n",
            "%", "mail.com", "a@b.c", "@d.e", "1.2.3.4", "+1 (555) 123-4567", "é", "0" * 20, "+49", "\U0001f600"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_base_spans_match_the_plain_expressions():
    rng = random.Random(6)
    for _ in range(4000):
        text = noisy(rng, rng.randrange(1, 14))
        assert sorted(pii.base_spans(text)) == sorted(brute(text)), text
    for text in ("a" * 200_000, "1" * 200_000, "1." * 50_000, "+1" * 50_000, "@" * 50_000, "a.b" * 50_000 + "@"):
        assert pii.base_spans(text) is not None  # in linear time


def test_report_matches_brute_force(spark):
    rng = random.Random(7)
    rows = sample_rows() + [(500 + i, noisy(rng, 60), "en", "s", None) for i in range(50)]
    got = pii.personal_data(sample_docs(spark, rows)).collect()
    want = sorted(((r[0], *(sum(s[0] == k for s in brute(r[1] or "")) for k in pii.KINDS), digest(brute(r[1] or ""))) for r in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        assert r.n_found or hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256


def test_learned_patterns_find_unseen_identifiers(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("green lamp stone river paper".split()) for _ in range(8))
    texts = [f"{filler()} call me at +1 (555) 123-4{i:03d} thanks {filler()}" for i in range(30)]
    texts += [f"{filler()} my email: user{i}@mail.example.com {filler()}" for i in range(30)]
    hidden = [f"{filler()} call me at (030) 555-{7000 + i} thanks {filler()}" for i in range(5)]
    hidden += [f"{filler()} my email: user{i} (at) mail (dot) example (dot) org {filler()}" for i in range(5)]
    decoys = [f"{filler()} the year 2024-11-{10 + i} {filler()} green (030) 555-{8000 + i} lamp" for i in range(5)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts + hidden + decoys)]
    got = {r.doc_id: r for r in pii.personal_data(sample_docs(spark, rows)).collect()}
    for i in range(60, 70):
        assert got[i].n_found == 1
        kind, a, b = got[i].spans.split(":")
        assert kind == ("phone" if i < 65 else "email")
        assert rows[i][1][int(a):int(b)].startswith("(030) 555-7" if i < 65 else "user")
    assert all(got[i].n_found == 0 for i in [*range(60), *range(70, 75)])


def test_hidden_seeds_come_back(spark):
    """A third of the known values is hidden from the seeds; patterns of the others find them, and no decoys."""
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice("green lamp stone river paper of the".split()) for _ in range(n))
    leads = ["tel:", "call me at", "my phone is", "reach us on", "fax:"]
    rows = [(i, f"{filler(9)} {rng.choice(leads)} +1 (555) 12{i // 100}-4{i % 100:03d} {filler(6)}") for i in range(300)]
    rows += [(300 + i, f"{filler(9)} +1 (555) 99{i // 100}-4{i % 100:03d} {filler(6)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = docs.mapInArrow(pii._scan, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("found", T.ArrayType(pii._SPAN))]))
    spans = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*").where("seed")
    hidden = spans.withColumn("seed", F.col("doc_id") % 3 > 0).withColumn("seed", F.col("seed") & (F.col("doc_id") < 300))
    good = pii.score_values(hidden.select("kind", "value", "seed", F.explode("patterns").alias("pattern")), docs).where(F.col("score") >= pii.ACCEPT)
    ids = {r.doc_id for r in spans.join(good, ["kind", "value"]).select("doc_id").collect()}
    wanted = set(range(0, 300, 3))
    assert len(ids & wanted) >= 0.95 * len(wanted) and ids <= wanted


def test_long_words_stand_in_patterns_by_their_hash():
    long = "w" * 300
    (left, before, around), = pii.contexts(f"a {long} 1.2.3.4 b", [("ip", 303, 310)])
    assert left == f"left #{pii._signed(long)}" and before.startswith("before a #") and around.endswith(" b")


def test_no_rows(spark):
    assert pii.personal_data(no_docs(spark)).collect() == []


def test_values_accepted_in_a_round_make_new_patterns(spark):
    """Pattern 1 has three known values and finds five; pattern 2 has none but those; nothing is limited."""
    edges = [(0, v, v < 103, "before mail to") for v in range(100, 108)]
    edges += [(0, v, False, "before write at") for v in (103, 104, 105, 106, 107, 110)]
    found = spark.createDataFrame(edges, "kind int, value long, seed boolean, pattern string")
    docs = spark.createDataFrame([(" ".join(["mail to x"] * 8),), (" ".join(["write at x"] * 6),)], "text string")
    got = {r.value: r.score for r in pii.score_values(found, docs, rounds=8).collect()}
    assert 110 in got and got[110] > 0.5


def test_rare_reliable_patterns_stay_beside_many_others(spark):
    n = 10_005
    found = spark.range(n).selectExpr("0 AS kind", "concat('before p', id, ' q') AS pattern", "id",
                                      "explode(sequence(0, if(id = 0, 3, 4))) AS v").selectExpr(
        "kind", "if(v = 0, -1 - id, v) AS value", "v > 0 AS seed", "pattern")
    docs = spark.range(n).selectExpr("repeat(concat('p', id, ' q x '), 5) AS text")
    got = pii.score_values(found, docs, rounds=1)
    assert got.count() == n and got.where("value = -1 AND score > 0.5").count() == 1
