import math
import random
import re

import pytest
from samples import no_docs, sample_docs

from geocairn.llm import licenses as li

FILES = [
    ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "import os\nprint(1)"), ("a/b/y.py", "nothing"),
    ("a/b/z.py", "code\n# Licensed under the Apache License, Version 2.0.\nmore code"), ("a/b/c/LICENSE", "All rights reserved."),
    ("a/b/c/d/w.py", ""), ("a/b/c/d/v.py", None), ("other/q.py", "the license of the version"), (None, "x"), ("top.py", "y"),
    ("a/x.py", "import os\nprint(1)"), ("p/COPYING", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation\nfiles."), ("p/q/r/s.py", "z " * 20_000),
    ("two/A", "All rights reserved."), ("two/B", "Released under the MIT License."), ("two/c", "text"),
]


def brute(files):
    texts = [t or "" for _, t in files]
    vocabulary = {t for _, x in li.TEMPLATES for t in li.terms(x)}
    idf = {t: math.log((1 + len(files)) / (1 + sum(t in li.terms(x) for x in texts))) + 1 for t in vocabulary}
    other = math.log(1 + len(files)) + 1

    def vector(text):
        words = re.findall("[a-z0-9]+", text.lower())
        return {w: words.count(w) * idf.get(w, other) for w in set(words)}

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return sum(a[w] * b.get(w, 0) for w in a) / norm if norm else 0

    out = []
    for path, text in files:
        units = [("file", text or "", li.FILE)] + [("header", x, li.HEADER) for x in (text or "").split("\n")]
        hits = [(via == "file", round(cosine(vector(u), vector(t)), 6), -i, name, via)
                for via, u, least in units for i, (name, t) in enumerate(li.TEMPLATES) if round(cosine(vector(u), vector(t)), 6) >= least]
        out.append((path, max(hits)[3], max(hits)[1], max(hits)[4]) if hits else (path, None, None, None))
    given = {}
    for path, name, score, via in out:
        if via == "file" and path is not None:
            given.setdefault(path.rpartition("/")[0], []).append((-score, path, name))
    rows = []
    for path, name, score, via in out:
        if name or path is None:
            rows.append((path, name, score, via, None))
            continue
        folder = path.rpartition("/")[0]
        while folder and folder not in given:
            folder = folder.rpartition("/")[0]
        found = min(given[folder]) if folder in given else None
        rows.append((path, found and found[2], None, "inherited" if found else None, found and found[1]))
    return rows


def test_scan_matches_brute_force(spark):
    files = spark.createDataFrame([(*f, "x") for f in FILES], "path string, text string, license string").repartition(3)
    got = sorted(map(tuple, li.license_scan(files).collect()), key=str)
    want = sorted(brute(FILES), key=str)
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


def test_terms_that_may_be_passed_over_cannot_match():
    idf, vectors, needed = li.weights(li.TEMPLATES, {"the": 10_000, "of": 9_000, "to": 9_000, "or": 5_000}, 10_000)
    for _, _, vector, norm in vectors:
        assert math.sqrt(sum(w * w for t, w in vector.items() if t not in needed)) < li.FILE * norm


def test_whole_texts_are_licence_files_and_wrapped_headers_are_found(spark):
    mit, apache = dict(li.whole_texts())["MIT"], dict(li.whole_texts())["Apache-2.0"]
    bsd = ("# Redistribution and use in source and binary forms, with or without\n"
           "# modification, are permitted provided that the following conditions are met:")
    code = "\n".join(f"value{i} = compute{i}(argument{i})" for i in range(200))
    files = [("m/LICENSE", "Copyright (c) 2020 Some One\n\n" + mit), ("m/x.py", "import os"), ("n/LICENSE", apache),
             ("n/y.py", "import re"), ("o/z.py", code + "\n" + bsd + "\n" + code)]
    files += [(f"p/{i}.py", "source and forms for the use of " + code) for i in range(20)]
    docs = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.license, r.via) for r in li.license_scan(docs).collect()}
    assert got["m/LICENSE"] == ("MIT", "file") and got["m/x.py"] == ("MIT", "inherited")
    assert got["n/LICENSE"] == ("Apache-2.0", "file") and got["n/y.py"] == ("Apache-2.0", "inherited")
    assert got["o/z.py"] == ("BSD", "header") and got["p/3.py"] == (None, None)


def plain(files):
    """Every run of lines and the whole text against all templates, whole licence texts included."""
    texts = [t or "" for _, t in files]

    def model(templates):
        vocabulary = {t for _, x in templates for t in li.terms(x)}
        return {t: math.log((1 + len(files)) / (1 + sum(t in li.terms(x) for x in texts))) + 1 for t in vocabulary}

    other = math.log(1 + len(files)) + 1

    def cosine(text, template, idf):
        a, b = ({w: words.count(w) * idf.get(w, other) for w in set(words)} for words in (li.terms(text), li.terms(template)))
        norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return round(sum(a[w] * b.get(w, 0) for w in a) / norm, 6) if norm else 0

    out = {}
    headers, whole = model(li.TEMPLATES), model(li.whole_texts())
    for (path, _), text in zip(files, texts):
        lines = text.split("\n")
        units = [("header", "\n".join(lines[i:i + n]), li.TEMPLATES, headers, li.HEADER, 0)
                 for i in range(len(lines)) for n in range(1, li.HEADER_LINES + 1) if i + n <= len(lines)]
        units += [("file", text, li.TEMPLATES, headers, li.FILE, 0), ("file", text, li.whole_texts(), whole, li.FILE, len(li.TEMPLATES))]
        hits = [(via == "file", score, -i - at, name, via) for via, unit, templates, idf, least, at in units
                for i, (name, t) in enumerate(templates) if (score := cosine(unit, t, idf)) >= least]
        out[path] = (max(hits)[3], max(hits)[1], max(hits)[4]) if hits else (None, None, None)
    return out


def test_runs_of_lines_and_whole_texts_match_brute_force(spark):
    rng = random.Random(2)
    pool = [line for _, t in li.TEMPLATES for line in (t, *(" ".join(p) for p in zip(*[iter(t.split())] * 5)))]
    pool += ["# some code", "", "the file and the work", "x = 1"] * 6
    files = [(f"f/{i}", "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    whole = dict(li.whole_texts())
    files += [("f/a", whole["MIT"]), ("f/b", whole["BSD"] + "\nmore"), ("f/c", whole["Apache-2.0"][:3000]), ("f/d", None), ("f/e", "")]
    got = {r.path: (r.license, r.score, r.via) for r in li.own_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    want = plain(files)
    assert {p: (g[0], g[2]) for p, g in got.items()} == {p: (w[0], w[2]) for p, w in want.items()}
    assert all(g[1] == pytest.approx(want[p][1], abs=2e-6) for p, g in got.items())
    assert len({g[2] for g in got.values()}) == 3 and sum(g[2] == "header" for g in got.values()) > 10


def test_a_text_of_many_flagged_lines(spark):
    line = "stones and rivers of the file, mills and lamps in green paper"
    text = "\n".join(f"{line} {i}" for i in range(20_000)) + "\nReleased under the MIT License."
    got = li.own_licenses(spark.createDataFrame([("long", text)], "path string, text string")).first()
    assert (got.license, got.via) == ("MIT", "header")


def test_no_rows(spark):
    files = no_docs(spark).selectExpr("source AS path", "text")
    assert li.license_scan(files).collect() == []
    only = sample_docs(spark).selectExpr("source AS path", "text", "license")
    assert li.license_scan(only).count() == sample_docs(spark).count()
