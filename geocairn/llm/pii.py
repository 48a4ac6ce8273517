"""Personal data: fixed formats, and contextual extraction bootstrapped from what they find."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geocairn.llm.common import ROWS, texts
from geocairn.plans.session import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Distinct values, known or accepted so far, that a pattern must surround to be a candidate.
MIN_SEEDS = 3
#: Bits of the map by which tasks pass over most words that start no pattern.
_MAP_BITS = 22
#: Score from which a value counts as found.
ACCEPT = 0.8
_TOP = 0.99

# Fixed formats. Nothing can match from inside a run of digits that failed at its start, so runs
# are entered at their start and never given back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NOT_DIGIT = re.compile(r"[^0-9]")
# Looser forms, which count only in the context of a learned pattern.
_LOOSE = (
    ("email", re.compile(r"[\w.+-]+\s?[\[(]?(?:@|\b(?:at|AT)\b)[\])]?\s?[\w-]+(?:\s?[\[(]?(?:\.|\b(?:dot|DOT)\b)[\])]?\s?[\w-]+)+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,5}(?:\.[0-9]{1,5}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])[(]?[0-9]{2,5}[)]?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])")),
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed formats, each kind's leftmost matches without overlap."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_part(x) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of looser forms that share no character with ``base`` or one another."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for kind, form in _LOOSE:
        if kind == "email" and "@" not in text and not re.search(r"\bat\b|\bAT\b", text):
            continue
        for m in form.finditer(text):
            a, b = m.span()
            i = bisect_right(taken, (b, -1))
            if (i == 0 or taken[i - 1][1] <= a) and sum(map(str.isdigit, m[0])) >= (0 if kind == "email" else 6 if kind != "ip" else 4):
                taken.insert(i, (a, b))
                out.append((kind, a, b))
    return out


def _signed(text: str) -> int:
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[list[str]]:
    """For each span the patterns around it: the word before, the two words before, and the words on both sides.

    A word of over 100 code points stands in a pattern by its hash.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    out = []
    for _, a, b in spans:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        word = lambda k: text[slice(*words[k])] if 0 <= k < len(words) else "^"  # noqa: E731, B023
        own = [("left", word(i - 1)), ("before", word(i - 2), word(i - 1))] if i > 0 else []
        if i == j and i > 0:
            own.append(("around", word(i - 1), word(i + 1)))
        out.append([_pattern(form, *(w.lower() for w in given)) for form, *given in own])
    return out


def _pattern(form: str, *words: str) -> str:
    return " ".join([form, *(w if len(w) <= 100 else f"#{_signed(w)}" for w in words)])


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
                      T.StructField("end", T.LongType()), T.StructField("value", T.LongType()),
                      T.StructField("seed", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
_SPAN_ARROW = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64()),
                         ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in texts(batch.column("text")):
            base = base_spans(text)
            spans = base + loose_spans(text, base) if base or re.search(r"[0-9@]|\bat\b|\bAT\b", text) else []
            around = contexts(text, spans) if spans else []
            rows.append([{"start": a, "kind": KINDS.index(k), "end": b, "value": _signed(f"{k} {text[a:b].lower()}"),
                          "seed": i < len(base), "patterns": p}
                         for i, ((k, a, b), p) in enumerate(zip(spans, around))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_SPAN_ARROW))], ["doc_id", "found"])


def _bit(word: bytes, use: int) -> int:
    """Place in the map of a first word (use 1), a second one (2) or a whole pattern (3)."""
    return xxhash.xxh64_intdigest(word, use) >> (64 - _MAP_BITS)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = set()
        for pattern in batch.column("pattern").to_pylist():
            parts = [pattern, *pattern.split(" ", 2)[1:]]
            bits |= {_bit(p.encode("utf-8", "surrogatepass"), use) for p, use in zip(parts, (3, 1, 2))}
        yield pa.RecordBatch.from_arrays([pa.array([b >> 5 for b in bits], pa.int32()),
                                          pa.array([1 << (b & 31) for b in bits], pa.int64())], ["word", "bits"])


def _bit_map(patterns: DataFrame):
    """A map of fixed size that has the bits of every pattern and its words; others pass by chance only, so nothing is lost."""
    words = patterns.select("pattern").mapInArrow(_bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (_MAP_BITS - 5), np.uint32)
    for r in words.collect():  # at most 131,072 numbers
        out[r.word] = r.bits
    return out


def _occurrences(bit_map):
    """How often each pattern surrounds any word, summed per task and flushed when many, for patterns in the map.

    Each distinct word is looked up once in a while; pairs are only made where both words pass.
    """
    def run(batches):
        marks = bit_map.value
        held = lambda word, use: int(marks[(bit := _bit(word, use)) >> 5]) >> (bit & 31) & 1
        passes: dict[bytes, int] = {}
        sums: Counter = Counter()

        def flush():
            found: Counter = Counter()
            for (form, *given), n in sums.items():
                pattern = _pattern(form, *(w.decode("utf-8", "surrogatepass") for w in given))
                if held(pattern.encode("utf-8", "surrogatepass"), 3):
                    found[pattern] += n
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pattern", "n"])

        for batch in batches:
            for text in texts(batch.column("text")):
                words = [b"^", *text.lower().encode("utf-8", "surrogatepass").split(), b"^"]
                for word in {*words}.difference(passes):
                    name = word.decode("utf-8", "surrogatepass")
                    name = word if len(name) <= 100 else f"#{_signed(name)}".encode()
                    passes[word] = held(name, 1) | held(name, 2) << 1
                kinds = [passes[w] for w in words]
                last = len(words) - 1
                for i in [i for i, kind in enumerate(kinds) if kind & 1]:
                    if i < last - 1:
                        if i:
                            sums["left", words[i]] += 1
                        if kinds[i + 2] > 1:
                            sums["around", words[i], words[i + 2]] += 1
                        if i < last - 2 and kinds[i + 1] > 1:
                            sums["before", words[i], words[i + 1]] += 1
                if len(passes) > 300_000:
                    passes = {}
                if len(sums) > 300_000:
                    yield flush()
        yield flush()

    return run


def score_values(found: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, score) of values that learned patterns support, known values left out.

    ``found`` has one row per span (kind, value, seed, pattern). A pattern's confidence is the
    score of the values that it surrounds, per occurrence of the pattern around any word of all
    texts; a value's score is one minus the product of its patterns' doubts. Known values have
    score one throughout. In each round the candidates are the patterns around ``MIN_SEEDS`` values
    accepted so far, without a limit. Both sides are aggregated and joined by Spark in each round.
    """
    edges = materialize(found.groupBy("kind", "pattern", "value").agg(
        F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    # whatever is accepted, a pattern of fewer values is no candidate in any round
    possible = edges.groupBy("kind", "pattern").agg(F.count("*").alias("values")).where(F.col("values") >= MIN_SEEDS)
    possible = materialize(possible.select("kind", "pattern"), "patterns")
    bit_map = docs.sparkSession.sparkContext.broadcast(_bit_map(possible))
    counts = docs.select("text").mapInArrow(_occurrences(bit_map), "pattern string, n long")
    totals = counts.groupBy("pattern").agg(F.sum("n").alias("total"))
    chosen = possible.join(totals, "pattern", "left")
    edges = materialize(edges.join(chosen.withColumn("total", F.coalesce("total", F.lit(0))), ["kind", "pattern"]), "graph")
    scores = edges.select("kind", "value", F.col("seed").cast("double").alias("score")).groupBy("kind", "value").agg(F.max("score").alias("score"))
    if not rounds:
        return scores.where("score < 1")
    for _ in range(rounds):
        known = edges.join(scores.select("kind", "value", "score"), ["kind", "value"])
        sure = known.groupBy("kind", "pattern").agg(
            F.count_if(F.col("score") >= ACCEPT).alias("accepted"),
            (F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("total"), F.sum("n"))).alias("confidence"))
        sure = sure.where(F.col("accepted") >= MIN_SEEDS).select("kind", "pattern", "confidence")
        doubt = F.exp(F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(_TOP)))))
        scores = materialize(edges.join(sure, ["kind", "pattern"], "left").groupBy("kind", "value").agg(
            F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("score"), F.max("seed").alias("seed")), "scores")
    return scores.where("NOT seed").select("kind", "value", "score")


def personal_data(docs: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found), a row per row of ``docs``.

    The counts and ``base_sha256`` are of the fixed formats; ``spans`` holds those and, beside them, ``n_found``
    spans of looser forms whose value reaches the score ``accept``. A NULL text is empty. Repeated rows and NULL
    ids keep their own row; other columns of ``docs`` are ignored. No rows, no result.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("found", T.ArrayType(_SPAN))])
    scanned = docs.select("doc_id", "text").mapInArrow(_scan, schema)
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "found")
    spans = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.*")
    edges = spans.select("kind", "value", "seed", F.explode("patterns").alias("pattern"))
    good = score_values(edges, docs, rounds).where(F.col("score") >= accept).select("kind", "value")
    more = (spans.where("NOT seed").join(good.hint("merge"), ["kind", "value"])
            .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more")))
    own = F.transform(F.filter("found", lambda s: s["seed"]), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")
    table = scanned.join(more, "row", "left").select("doc_id", own.alias("own"), F.coalesce(
        "more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("more"))
    count = lambda k: F.size(F.filter("own", lambda s: s["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return table.select("doc_id", *counts, F.sha2(joined(F.col("own")), 256).alias("base_sha256"),
                        joined(F.concat("own", "more")).alias("spans"), F.size("more").cast("bigint").alias("n_found"))
