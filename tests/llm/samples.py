"""Small documents with every awkward case, shared by the operator tests."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
VOCABULARY = ("river stone the of and window green carrying to lamp in winter that is for a paper over "
              "metal under garden with by silver morning engine from this cloud").split()


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + ("" if rng.random() < 0.8 else str(rng.randrange(9))) for _ in range(n))


def sample_rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([3, 12, 40, 120])), "en", f"s{i % 4}" if i % 3 else "big") for i in range(n)]
    long_text = prose(rng, 20_000)
    rows += [
        (100, None, "en", "s1"), (101, "", None, "s1"), (102, " \t\n\x0b ", "en", None), (103, "one", "en", "s1"),
        (104, "two words", "en", None), (None, "text without an id here", "en", "s2"), (None, None, None, None),
        (105, long_text, "en", "big"), (106, long_text + " tail", "en", "big"), (107, "x" * 30_000, "en", "s9"),
        (108, rows[7][1], "en", "s1"), (109, rows[7][1], "en", "s2"), (110, rows[7][1].upper(), "en", "s2"),
        (7, rows[7][1], "en", "s3"), (7, rows[7][1], "en", "s3"), (7, "another text under the same id", "en", "s3"),
        (111, "caf\u00e9 na\u00efve \U0001f600 \u2581 \u00a0 line\u2028end \u3000 end", "fr", "\u00e9"),
        (112, "a\nb\na\n\n\nb\n \n", "en", "s1"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def sample_docs(spark, rows=None, extra=True):
    df = spark.createDataFrame(rows if rows is not None else sample_rows(), DOCS).repartition(3)
    return with_clashes(df) if extra else df


def with_clashes(df):
    """Extra columns named like the operators' own."""
    for name in ("fp", "size", "target", "n_words", "kept", "a", "b", "cell", "hash", "u", "line", "spans", "ids",
                 "severity", "rule", "path", "license", "words", "root", "node", "component_id", "quality", "position"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def no_docs(spark):
    return sample_docs(spark, [])
