"""SentencePiece encoding with seeded merge dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geocairn.llm.common import texts, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of candidate merges that are skipped.
DROPOUT = 0.1
SEED = 7
#: Chunks that a worker remembers, and characters of texts that it handles together; both bound its memory and nothing else.
_CACHE, _AT_ONCE = 100_000, 500_000
_ALL = (1 << 64) - 1
_SLOT_BITS = 20
#: Chunks of up to so many characters are handled together, so many at once; longer ones one by one.
_LONGEST, _TOGETHER = 32, 16_384
_PLACE_BITS = 5
#: No candidate; ids of places that are no more, and of the first of the characters without a piece.
_NEVER, _GONE, _ODD = (1 << 31) - 1, -1, -2
SPACE = "\u2581"


class Pieces:
    """Merge table of a BPE model with byte fallback, read on the driver and sent with the tasks."""

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.texts: list[bytes | None] = []
        self.id_of: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.texts.append(bytes([int(piece[3:5], 16)]))
                self.byte_id[int(piece[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append(None)
            else:
                self.texts.append(piece.replace(SPACE, " ").encode())
                self.id_of[piece] = i
                self.cost[piece] = -model.get_score(i)

        self.longest = max(map(len, self.id_of))
        self.byte_count = np.array([len(t or b"") for t in self.texts], np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count
        self.all_bytes = np.frombuffer(b"".join([t or b"" for t in self.texts]), np.uint8)
        self._root: dict[str, int] = {}  # numbers of the chunks met in this worker
        self._states = _States()
        self._fill_tables()

    def segment(self, chunk: str, draw: int, dropout: float = DROPOUT, seed: int = SEED) -> list[int]:
        """Ids of a chunk of normalised text.

        An agenda holds the adjacent pairs that are pieces; the best score goes first, then the leftmost. A
        candidate taken from it is skipped if the hash of (seed, draw, place, piece) falls below the
        dropout; it may come back as part of a later pair. Dropout 0 gives the model's own segmentation.
        """
        out: list[int] = []
        for piece in self._long(chunk, draw, dropout, seed):
            at = self.id_of.get(piece)
            if at is None:
                out += self._bytes(piece)
            else:
                out.append(at)
        return out

    def segment_many(self, chunks: list[str], draw, dropout: float = DROPOUT, seed: int = SEED) -> list[list[int]]:
        """The same for many chunks, with one draw or one for each: a step takes the first candidate of every chunk at once."""
        out: list = [None] * len(chunks)
        draws = _draws(draw, len(chunks))
        short = [i for i, chunk in enumerate(chunks) if len(chunk) <= _LONGEST]
        codes, size = _codes([chunks[i] for i in short])
        flat, count = self._together(self._first_ids(codes), np.cumsum(size) - size, size, draws[short], dropout, seed)
        ends, ids = np.cumsum(count).tolist(), flat.tolist()
        for i, a, b in zip(short, [0, *ends], ends):
            out[i] = ids[a:b]
        for i, chunk in enumerate(chunks):
            if out[i] is None:
                out[i] = self.segment(chunk, int(draws[i]), dropout, seed)
        return out

    def _first_ids(self, codes: np.ndarray) -> np.ndarray:
        """Ids of characters; those without a piece stay apart, as negative numbers that tell them, and become bytes."""
        ids = self.by_code[codes]
        return np.where(ids < 0, _ODD - codes.astype(np.int32), ids)

    def _together(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray, draws: np.ndarray | None, dropout: float, seed: int,
                  log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks, one chunk after the other, and their number in each chunk.

        A chunk has ``size`` first ids, from ``start`` on in ``chars``. ``log`` receives (chunk, place, piece) of the
        candidates taken, step by step. Without draws none is skipped.
        """
        order = np.argsort(size, kind="stable")
        count, parts = np.zeros(size.size, np.int64), []
        for at in range(0, order.size, _TOGETHER):
            own = order[at:at + _TOGETHER]
            steps: list | None = None if log is None else []
            ids = self._merged(chars, start[own], size[own], None if draws is None else draws[own], dropout, seed, steps)
            if log is not None:
                log += [(own[r], j, piece) for r, j, piece in steps]
            alive = ids != _GONE
            parts.append(ids[alive])
            count[own] = alive.sum(axis=1)
        if not parts:
            return np.zeros(0, np.int32), count
        flat = np.concatenate(parts)
        count, flat = self._with_bytes(flat, count, order)
        begin = np.cumsum(count[order]) - count[order]
        back = np.empty_like(begin)
        back[order] = begin
        return flat[_runs(back, count)], count

    def _merged(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray, draws: np.ndarray | None, dropout: float, seed: int,
                log: list | None) -> np.ndarray:
        """Ids of chunks by (chunk, place) when no candidate is left.

        Within, arrays are by (place, chunk), flat, with an empty place on either side. A candidate is the rank of its
        piece and its place in one number, so the least of a chunk is the next.
        """
        n, width = size.size, int(size.max())
        ids = np.full((n, width + 2), _GONE, np.int32)
        ids.reshape(-1)[_runs(np.arange(n) * (width + 2) + 1, size)] = chars[_runs(start, size)]
        ids = np.ascontiguousarray(ids.T)
        best = np.full((width + 2, n), _NEVER, np.int32)
        best[1:-1] = self._candidates(ids[1:-1], ids[2:], np.arange(width, dtype=np.int32)[:, None])
        after = np.repeat(np.arange(1, width + 3, dtype=np.int64) * n, n) + np.tile(np.arange(n), width + 2)  # flat places
        before = after - 2 * n
        flat, agenda = ids.reshape(-1), best.reshape(-1)
        limit = int(dropout * (1 << 53))
        while True:
            first = best.min(axis=0)
            r = np.nonzero(first != _NEVER)[0]
            if not r.size:
                return ids[1:-1].T
            first = first[r]
            j, rank = first & ((1 << _PLACE_BITS) - 1), first >> _PLACE_BITS
            at, piece = (j + 1).astype(np.int64) * n + r, self.by_rank[rank]
            tied = np.nonzero(self.tied[rank])[0]
            piece[tied] = self.pair_piece[self._pair_at(flat[at[tied]], flat[after[at[tied]]])]
            if log is not None:
                log.append((r, j, piece))
            if draws is not None:
                skip = _chance(seed, draws[r], j, piece) < limit
                agenda[at[skip]] = _NEVER
                at, j, piece = at[~skip], j[~skip], piece[~skip]
            gone, near = after[at], before[at]
            far = after[gone]
            flat[at], flat[gone] = piece, _GONE
            agenda[gone] = _NEVER
            after[at], before[far] = far, at
            pair = self._candidates(np.concatenate([piece, flat[near]]), np.concatenate([flat[far], piece]),
                                    np.concatenate([j, near // n - 1]).astype(np.int32))
            agenda[at], agenda[near] = pair[:at.size], pair[at.size:]

    def _candidates(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.pair_rank[self._pair_at(a, b)]
        return np.where(rank < 0, np.int32(_NEVER), rank << _PLACE_BITS | place)

    def _with_bytes(self, flat: np.ndarray, count: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes for characters without a piece; ``flat`` holds the chunks by ``order``."""
        odd = np.nonzero(flat < 0)[0]
        if not odd.size:
            return count, flat
        codes, which = np.unique(_ODD - flat[odd], return_inverse=True)
        made = [self._bytes(chr(c)) for c in codes.tolist()]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        each = np.ones(flat.size, np.int64)
        each[odd] = sizes[which]
        ends = np.cumsum(each)
        out = np.repeat(flat, each)
        out[_runs(ends[odd] - each[odd], each[odd])] = np.fromiter(itertools.chain.from_iterable(made), np.int32)[
            _runs((np.cumsum(sizes) - sizes)[which], sizes[which])]
        count = count.copy()
        count[order] = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count[order])])])
        return count, out

    def _pair_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the pair table, 0 for pairs that make no piece."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        slot = _slot(key)
        at = np.zeros(key.shape, np.int32)
        some = np.nonzero(self.in_slot[slot])[0] if key.ndim == 1 else np.nonzero(self.in_slot[slot])
        key, slot = key[some], slot[some]
        place = self.slots[slot]
        found = np.where(self.pairs[place] == key, place, 0)
        for i in range(1, self.most):  # few slots hold several pairs
            more = np.nonzero(self.in_slot[slot] > i)[0]
            next_ = place[more] + i
            found[more] = np.where(self.pairs[next_] == key[more], next_, found[more])
        at[some] = found
        return at

    def _fill_tables(self) -> None:
        """Ids by character, and every pair of pieces that makes a piece."""
        self.by_code = np.full(0x110000, -1, np.int32)
        pairs = []
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.by_code[ord(piece)] = i
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, self.cost[piece], i))
        pairs.sort()
        self.pairs, pair_cost, self.pair_piece = (
            np.array(c, kind) for c, kind in zip(zip((-1, np.inf, -1), *pairs), (np.int64, float, np.int32)))
        costs, rank = np.unique(pair_cost, return_inverse=True)  # the last is that of no piece
        self.pair_rank = np.where(self.pair_piece < 0, -1, rank).astype(np.int32)
        self.by_rank = np.full(costs.size, -1, np.int32)
        self.by_rank[rank] = self.pair_piece
        self.tied = np.zeros(costs.size, bool)  # ranks that several pieces share, so that only their pairs tell them
        self.tied[rank[self.by_rank[rank] != self.pair_piece]] = True
        # pairs lie together by the slot of their hash
        slot = _slot(self.pairs[1:])
        order = np.concatenate([[0], 1 + np.argsort(slot, kind="stable")])
        self.pairs, self.pair_rank, self.pair_piece = self.pairs[order], self.pair_rank[order], self.pair_piece[order]
        self.in_slot = np.bincount(slot, minlength=1 << _SLOT_BITS).astype(np.int8)
        self.slots = (1 + np.cumsum(self.in_slot, dtype=np.int64) - self.in_slot).astype(np.int32)
        self.most = int(self.in_slot.max())
        self.slots[self.in_slot == 0] = 0

    def _long(self, chunk: str, draw: int, dropout: float, seed: int) -> list[str]:
        """With the agenda as a heap, for chunks of any length."""
        n, cost, limit = len(chunk), self.cost, int(dropout * (1 << 53))
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        agenda: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if ends[b] - a <= self.longest and (found := cost.get(chunk[a:ends[b]])) is not None:
                heapq.heappush(agenda, (found, a, b, ends[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, end = heapq.heappop(agenda)
            if not (alive[a] and alive[b]) or after[a] != b or ends[b] != end:
                continue
            if limit and int(_chance(seed, draw, np.int64(a), np.int64(self.id_of[chunk[a:end]]))) < limit:
                continue
            alive[b], ends[a], after[a] = False, end, after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        out, i = [], 0
        while i < n:
            out.append(chunk[i:ends[i]])
            i = after[i]
        return out

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_id[x] for x in text.encode()]

    def _learn(self, chunks: list[str]) -> None:
        """Gives each chunk its ids if no candidate is skipped, and those candidates.

        -1 stands for chunks that are segmented anew each time.
        """
        fresh = []
        for chunk in chunks:
            if chunk[0] == SPACE:  # the mark itself is never a space, so it stays apart as bytes
                ids = np.array(self._bytes(chunk), np.int32)
                self._root[chunk] = self._states.add(_NO_IDS, np.zeros(1, np.int64), ids, np.array([ids.size]), _NONE, _NONE)
            elif len(chunk) > _LONGEST:
                self._root[chunk] = -1
            else:
                fresh.append(chunk)
        for at in range(0, len(fresh), 50_000):
            own, log = fresh[at:at + 50_000], []
            codes, size = _codes(own)
            codes[codes == ord(" ")] = ord(SPACE)
            chars = self._first_ids(codes)
            ids, count = self._together(chars, np.cumsum(size) - size, size, None, 0.0, 0, log)
            rows, places, pieces = (np.concatenate(x) for x in zip(*log)) if log else (_NONE,) * 3
            order = np.argsort(rows, kind="stable")
            first = self._states.add(chars, size, ids, count, rows[order], _candidate(places[order], pieces[order]))
            self._root.update(zip(own, range(first, first + len(own))))

    def encode_many(self, texts_: list[str], keys: list[int], dropout: float = DROPOUT, seed: int = SEED) -> list[list[int]]:
        """Ids of texts. The key and the place of a chunk give its draw; no piece crosses a chunk.

        Of a chunk the ids without any skip and the candidates on the way there are kept. An occurrence hashes these
        candidates; if it skips none, those are its ids, else it goes through the agenda once with its own draw,
        together with others. What is kept may be dropped at any time.
        """
        flat, sizes = self.encode_flat(texts_, keys, dropout, seed)
        ends, ids = np.cumsum(sizes).tolist(), flat.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_flat(self, texts_: list[str], keys: list[int], dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """The same as the ids of all texts in one array, and the number of ids of each text."""
        out, at = [(np.zeros(0, np.int32), _NONE)], 0
        ends = np.cumsum(np.fromiter((len(t or "") for t in texts_), np.int64, len(texts_)))
        while at < len(texts_):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + _AT_ONCE, side="right")))
            out.append(self._encoded(texts_[at:stop], keys[at:stop], dropout, seed))
            at = stop
        flat, sizes = (np.concatenate(x) for x in zip(*out))
        return flat, sizes

    def _encoded(self, texts_: list[str], keys: list[int], dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        if self._states.size > _CACHE:
            self._root, self._states = {}, _States()
        own = [_CHUNK.findall(" " + t) if t else [] for t in texts_]
        chunks = list(itertools.chain.from_iterable(own))
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(len(own), np.int64)
        self._learn([c for c in set(chunks) if c not in self._root])
        base = np.array([xxhash.xxh64_intdigest(struct.pack("<qq", seed, k)) for k in keys], np.uint64)
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        ends = np.cumsum(sizes)
        draws = _draw_at(np.repeat(base, sizes), np.arange(ends[-1]) - np.repeat(ends - sizes, sizes))
        out = [self._drawn_flat(chunks[at:at + 100_000], draws[at:at + 100_000], dropout, seed) for at in range(0, len(chunks), 100_000)]
        flat, counts = (np.concatenate(x) for x in zip(*out))
        return flat, np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], ends])])

    def _drawn(self, chunks: list[str], draws: np.ndarray, dropout: float, seed: int) -> list[list[int]]:
        flat, count = self._drawn_flat(chunks, draws, dropout, seed)
        ends, ids = np.cumsum(count).tolist(), flat.tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _drawn_flat(self, chunks: list[str], draws: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        states = self._states
        number = np.fromiter(map(self._root.__getitem__, chunks), np.int64, len(chunks))
        skips = np.zeros(len(chunks), bool)
        known, anew = np.nonzero(number >= 0)[0], np.nonzero(number < 0)[0]
        if dropout:
            skips[known] = states.skips(number[known], draws[known], dropout, seed)
        drawn, known = np.nonzero(skips)[0], known[~skips[known]]
        own = number[drawn]
        ids, sizes = self._together(states.chars, states.chars_start[own], states.chars_count[own], draws[drawn], dropout, seed)
        made = self.segment_many([chunks[i].replace(" ", SPACE) for i in anew], draws[anew], dropout, seed)
        count = np.zeros(len(chunks), np.int64)
        count[known] = states.ids_count[number[known]]
        count[drawn] = sizes
        count[anew] = np.fromiter(map(len, made), np.int64, len(made))
        begin = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        flat[_runs(begin[known], count[known])] = states.ids[_runs(states.ids_start[number[known]], count[known])]
        flat[_runs(begin[drawn], sizes)] = ids
        for at, found in zip(begin[anew].tolist(), made):
            flat[at:at + len(found)] = found
        return flat, count

    def encode(self, text: str, key: int = 0, dropout: float = DROPOUT, seed: int = SEED) -> list[int]:
        return self.encode_many([text], [key], dropout, seed)[0]

    def decode(self, ids: list[int]) -> str:
        """The text of a whole sequence of ids; control ids give nothing."""
        known = self.texts
        return b"".join([known[i] or b"" for i in ids])[1:].decode("utf-8", "replace")

    def decode_flat(self, flat: np.ndarray, sizes: np.ndarray) -> Iterator[str]:
        """The texts of sequences that lie together in one array, a number of whole sequences at once."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + 100_000, side="right")) - 1)
            ids = flat[ends[at]:ends[stop]]
            count = self.byte_count[ids]
            data = self.all_bytes[_runs(self.byte_start[ids], count)].tobytes()
            cuts = np.concatenate([[0], np.cumsum(count)])[ends[at:stop + 1] - ends[at]].tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield data[a:b][1:].decode("utf-8", "replace")
            at = stop


_NONE, _NO_IDS = np.zeros(0, np.int64), np.zeros(0, np.int32)


def _codes(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all chunks and their number in each."""
    return (np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).copy(),
            np.fromiter(map(len, chunks), np.int64, len(chunks)))


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``start``, one run after the other."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)


class _States:
    """Chunks by number, in flat arrays: first ids of their characters, ids without any skip, candidates on the way there."""

    def __init__(self):
        self.size = 0
        self.chars, self.chars_start, self.chars_count = _NO_IDS, _NONE, _NONE
        self.ids, self.ids_start, self.ids_count = _NO_IDS, _NONE, _NONE
        self._mixed, self._start, self._count = _NONE.astype(np.uint64), _NONE, _NONE
        self._used = [0, 0, 0]

    def add(self, chars: np.ndarray, char_count: np.ndarray, ids: np.ndarray, id_count: np.ndarray,
            rows: np.ndarray, candidates: np.ndarray) -> int:
        """Number of the first of the new chunks; ``rows`` says whose candidates they are, in order."""
        n, at = len(id_count), self.size
        parts = ((chars, char_count), (ids, id_count), (candidates, np.bincount(rows, minlength=n)))
        for i, (values, start, count) in enumerate((("chars", "chars_start", "chars_count"), ("ids", "ids_start", "ids_count"), ("_mixed", "_start", "_count"))):
            new, each = parts[i]
            used, self._used[i] = self._used[i], self._used[i] + len(new)
            for name, have, more in ((values, used, new), (start, at, used + np.cumsum(each) - each), (count, at, each)):
                setattr(self, name, _put(getattr(self, name), have, more))
        self.size += n
        return at

    def skips(self, number: np.ndarray, draws: np.ndarray, dropout: float, seed: int) -> np.ndarray:
        """Whether chunks skip a candidate with these draws."""
        out = np.zeros(number.size, bool)
        limit = int(dropout * (1 << 53))
        for at in range(0, number.size, 20_000):
            own = number[at:at + 20_000]
            count = self._count[own]
            row = np.repeat(np.arange(at, at + own.size), count)
            hit = _drawn_bits(seed, draws[row], self._mixed[_runs(self._start[own], count)]) < limit
            out[row[hit]] = True
        return out


def _put(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array`` with ``more`` behind the first ``used`` values; it doubles where there is no room."""
    if used + len(more) > array.size:
        array = np.concatenate([array[:used], np.zeros(max(1024, used, len(more)), array.dtype)])
    array[used:used + len(more)] = more
    return array


def _slot(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) >> np.uint64(64 - _SLOT_BITS)


def _draws(draw, n: int) -> np.ndarray:
    """One draw for each of ``n`` chunks."""
    return np.full(n, draw & _ALL, np.uint64) if isinstance(draw, int) else np.asarray(draw, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def _draw_at(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64 bits for each (hash of a document's key, place of a chunk)."""
    with np.errstate(over="ignore"):
        return _mixed(base + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _candidate(place, piece) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.asarray(place).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(piece).astype(np.uint64)


def _drawn_bits(seed: int, draw, candidate):
    with np.errstate(over="ignore"):
        return _mixed((np.uint64(seed * 0x9E3779B97F4A7C15 & _ALL) + draw * np.uint64(0xD1B54A32D192ED03)) ^ candidate) >> np.uint64(11)


def _chance(seed: int, draw, place, piece):
    """53 hash bits of the candidate, the same for arrays and single numbers."""
    return _drawn_bits(seed, np.uint64(draw & _ALL) if isinstance(draw, int) else draw, _candidate(place, piece))


_CHUNK = re.compile(f"{SPACE}+| *[^ {SPACE}]+| +")


def with_pieces(docs: DataFrame, model_file: str = MODEL, dropout: float = DROPOUT, seed: int = SEED,
                text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ids (array of int), n_pieces and lossless (decoding gives the text again).

    The segmentation of a row depends on the seed, its ``key``, the text and nothing else, so reruns and repeated
    rows agree; each chunk of each other key is drawn anew. NULL and empty texts have no pieces and are
    lossless as an empty text; a NULL key counts as -1. Columns named like the new ones are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))  # a fixed 32,000 pieces

    def compute(batch):
        pieces = model.value
        values = texts(batch[text])
        keys = [-1 if k is None else int(k) for k in batch[key].to_pylist()]
        flat, sizes = pieces.encode_flat(values, keys, dropout, seed)
        same = [got == value for got, value in zip(pieces.decode_flat(flat, sizes), values)]
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
        return [ids, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())]

    return with_columns(docs, [("ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("lossless", T.BooleanType())],
                        compute, [text, key])


def with_text(rows: DataFrame, model_file: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of their ``ids``; NULL gives an empty text."""
    model = rows.sparkSession.sparkContext.broadcast(Pieces(model_file))

    def compute(batch):
        return [pa.array([model.value.decode(x or []) for x in batch[ids].to_pylist()], pa.string())]

    return with_columns(rows, [(out, T.StringType())], compute, [ids])
