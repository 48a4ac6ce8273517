import random

import struct

import numpy as np
import pytest
import xxhash
import sentencepiece
from pyspark.sql import functions as F
from samples import no_docs, sample_docs, sample_rows

from geocairn.llm import piece_dropout as pd

TEXTS = ["", " ", "   x", "hello world", "  a     b  c ", "tabs\tand\nlines\r\n", "café \U0001f600 日本語", "x" * 3000,
         "<s> </s> <0x0A>", "  　", " " * 40 + "end", "Internationalisation of unbelievable words"]


@pytest.fixture(scope="module")
def pieces():
    return pd.Pieces()


def test_without_dropout_the_model_s_own_ids(pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=pd.MODEL)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdetion  \n.") for _ in range(200)) for _ in range(50)]
    for text in texts:
        ids = pieces.encode(text, 5, 0.0, 1)
        assert ids == model.encode(text) and model.decode(ids) == text


def test_both_agendas_agree(pieces):
    rng = random.Random(2)
    chunks = [pd.SPACE * rng.randrange(3) + "".join(rng.choice("abcdetionsr\u00e9\u6f22\U0001f600\u0001") for _ in range(rng.randrange(1, 45)))
              for _ in range(300)]
    chunks += [pd.SPACE + "".join(rng.choice("etionsr") for _ in range(rng.randrange(1, 20))) for _ in range(500)]
    for dropout in (0.0, 0.1, 0.5, 1.0):
        for draw in range(2):
            assert pieces.segment_many(chunks, draw, dropout, 7) == [pieces.segment(c, draw, dropout, 7) for c in chunks]


def test_a_tenth_of_the_candidates_is_skipped():
    import numpy as np
    chance = pd._chance(7, 1, np.arange(200_000) % 30, np.arange(200_000) // 30) / 2 ** 53
    assert abs((chance < 0.1).mean() - 0.1) < 0.005 and abs(np.corrcoef(chance[:-30], chance[30:])[0, 1]) < 0.01


def test_dropout_varies_and_decodes_losslessly(pieces):
    seen = {}
    for key in range(20):
        for text in [*TEXTS, "marks ▁▁ stay ▁"]:
            ids = pieces.encode(text, key, 0.3, 7)
            assert pieces.decode(ids) == text
            seen.setdefault(text, set()).add(tuple(ids))
    assert len(seen[TEXTS[-1]]) > 3
    dropped = pieces.segment("▁internationalisation", 1, 1.0)
    assert len(dropped) == len("▁internationalisation")


def test_every_key_and_place_has_its_own_draw(pieces):
    text = "Internationalisation of unbelievable words " * 40
    copies = [tuple(ids) for ids in pieces.encode_many([text] * 200, list(range(200)))]
    assert len(set(copies)) == 200 and all(pieces.decode(list(ids)) == text for ids in copies[:20])
    words = [tuple(pieces.encode(" unbelievable", k, 0.3, 7)) for k in range(400)]
    assert len(set(words)) > 8
    one = pieces.encode_many(["x", text, "", "caf\u00e9 \u65e5\u672c " * 5], [5, 6, 7, 8])
    assert one[1] == pieces.encode(text, 6) and one[3] == pieces.encode("caf\u00e9 \u65e5\u672c " * 5, 8)


def test_drawn_chunks_are_those_of_their_own_draw(pieces):
    import numpy as np
    chunks = [" internationalisation", " words", " lamp", "\u2581", " \u65e5\u672c", "x" * 50] * 50
    draws = pd._draw_at(np.full(300, 9, np.uint64), np.arange(300))
    pieces._learn([c for c in set(chunks) if c not in pieces._root])
    want = [pieces._bytes(c) if c[0] == pd.SPACE else pieces.segment(c.replace(" ", pd.SPACE), int(d), 0.2, 7) for c, d in zip(chunks, draws)]
    assert pieces._drawn(chunks, draws, 0.2, 7) == want


def plain_agenda(pieces, chunk, draw, dropout, seed):
    """Lists only: the best pair that is a piece and was not skipped merges, until there is none."""
    parts, skipped = [(i, c) for i, c in enumerate(chunk)], set()
    while True:
        pairs = [(pieces.cost[a + b], i, a + b, (j, len(a + b))) for (i, a), (j, b) in zip(parts, parts[1:])
                 if a + b in pieces.cost and (i, j, len(a + b)) not in skipped]
        if not pairs:
            return [k for _, t in parts for k in ([pieces.id_of[t]] if t in pieces.id_of else pieces._bytes(t))]
        _, i, text, (j, size) = min(pairs)
        if int(pd._chance(seed, draw, i, pieces.id_of[text])) < dropout * 2 ** 53:
            skipped.add((i, j, size))
            continue
        at = next(k for k, (p, _) in enumerate(parts) if p == i)
        parts[at:at + 2] = [(i, text)]


@pytest.mark.parametrize("bound", [0, 10 ** 6])
def test_states_give_the_ids_of_a_plain_agenda_for_many_keys(pieces, bound, monkeypatch):
    monkeypatch.setattr(pd, "_CACHE", bound)  # the tree is dropped before each call, or never
    text = "unbelievable in\nternationalisation of ba\u00e9\u4e2d banana\U0001f600na  mississippi aaaaaaaa"
    keys = list(range(150))
    for dropout in (0.1, 0.4):
        got = pieces.encode_many([text] * len(keys), keys, dropout, 7) + pieces.encode_many([text] * 9, keys[:9], dropout, 7)
        for k, ids in zip([*keys, *keys[:9]], got):
            base = np.array([xxhash.xxh64_intdigest(struct.pack("<qq", 7, k))], np.uint64)
            want = []
            for place, chunk in enumerate(pd._CHUNK.findall(" " + text)):
                draw = int(pd._draw_at(base, np.array([place]))[0])
                want += plain_agenda(pieces, chunk.replace(" ", pd.SPACE), draw, dropout, 7)
            assert ids == want and pieces.decode(ids) == text


def test_column_operators(spark):
    docs = sample_docs(spark)
    got = pd.with_pieces(docs)
    assert set(docs.columns) <= set(got.columns) and got.count() == len(sample_rows())
    assert got.where("NOT lossless OR n_pieces <> size(ids)").count() == 0
    assert got.where("coalesce(text, '') = '' AND n_pieces > 0").count() == 0
    back = pd.with_text(got.withColumnRenamed("text", "was"))
    assert back.where(F.col("text") != F.coalesce("was", F.lit(""))).count() == 0
    again = pd.with_pieces(docs.repartition(7)).select("doc_id", "text", "ids")
    assert got.select("doc_id", "text", "ids").exceptAll(again).count() == 0
    assert pd.with_pieces(no_docs(spark)).collect() == []


def test_states_keep_their_ids_in_one_array():
    """Lists of ids took most of the memory of the cached states."""
    import numpy as np

    pieces = pd.Pieces()
    texts = ["", "one two  three ▁ four", "x" * 90 + " \U0001f600 end", "one two", " "] * 3
    lists = pieces.encode_many(texts, list(range(len(texts))))
    flat, sizes = pieces.encode_flat(texts, list(range(len(texts))))
    assert isinstance(pieces._states.ids, np.ndarray) and flat.dtype == np.int32
    assert sizes.tolist() == [len(x) for x in lists] and flat.tolist() == [i for x in lists for i in x]
    assert list(pieces.decode_flat(flat, sizes)) == [pieces.decode(x) for x in lists] == texts


def test_an_occurrence_that_skips_goes_through_the_agenda_once(monkeypatch):
    """Each series of skips met was a state of its own, computed from the first character again: most of the CPU time."""
    pieces, sent = pd.Pieces(), []
    text = "Internationalisation of unbelievable words 日本 and " + "  " * 7 + "spaces"
    chunks = pd._CHUNK.findall(" " + text)
    monkeypatch.setattr(pieces, "_together", lambda *a, f=pieces._together: sent.append(len(a[1])) or f(*a))
    got = pieces.encode_many([text] * 300, list(range(300)), 0.5, 7)
    assert pieces._states.size == len(set(chunks)) and sum(sent) <= len(set(chunks)) + 300 * len(chunks)
    assert len({tuple(ids) for ids in got}) > 250 and all(pieces.decode(ids) == text for ids in got)


def test_pieces_of_one_cost_go_by_place(pieces):
    """The agenda holds ranks of costs, which do not tell such pieces apart."""
    own = pd.Pieces()
    own.cost = {piece: float(round(cost / 50)) for piece, cost in own.cost.items()}
    own._fill_tables()
    assert own.tied.sum() > 100
    rng = random.Random(5)
    chunks = [pd.SPACE + "".join(rng.choice("abcdetionsr漢") for _ in range(rng.randrange(1, 32))) for _ in range(400)]
    for dropout in (0.0, 0.2):
        assert own.segment_many(chunks, 3, dropout, 7) == [own.segment(c, 3, dropout, 7) for c in chunks]


def test_chunks_of_one_call_are_not_all_remembered(monkeypatch):
    """All texts of a batch were learned at once, whatever their length, and half a million chunks on top were kept."""
    pieces, sizes = pd.Pieces(), []
    add = pd._States.add
    monkeypatch.setattr(pd._States, "add", lambda self, *a: (add(self, *a), sizes.append(self.size))[0])
    texts = [" ".join(f"{i:x}{j:x}" for j in range(9000, 18000)) for i in range(16, 36)]
    flat, counts = pieces.encode_flat(texts, list(range(20)), 0.0)
    assert sum(map(len, texts)) > 10 ** 6 and max(sizes) < 150_000 < 20 * 9000
    assert list(pieces.decode_flat(flat, counts)) == texts
    assert flat[:counts[0]].tolist() == pieces.encode(texts[0], 0, 0.0)
