"""SentencePiece encoding and decoding by a streaming Viterbi lattice.

A text's lattice has a node before and behind each character; pieces of the vocabulary are its
edges. The encoder walks it left to right and keeps, for the last ``longest`` characters (the
longest piece) only, the backpointers of paths that survive. Whenever all backpointers of the
window lead through one boundary, the ids before it are final and are committed, so memory
doesn't depend on the text's length.

``model`` names what makes a path the best one:

*   ``unigram``: the largest sum of scores.
*   ``bpe``: the path that merging pairs by rank would give. A path is that one exactly if each
    two neighbouring pieces are what merging gives for their joined characters, and each prefix
    of a text has one such path, so a node keeps one backpointer: the piece whose predecessor
    at its begin agrees with it.

Characters in no piece become byte pieces (``<0xNN>``). White space is written as U+2581, and
one is put in front of a text, as the vocabulary asks. Decoding reverses all that; a text
comes back exactly, but that U+2581 itself comes back as a space, as in the public library.

The public model file that is used is a BPE one with byte fallback.

A task walks many lattices side by side. Text parts that begin at a U+2581 behind another
character are independent if no piece holds such a pair inside (checked when the vocabulary is
read): all paths run through that boundary, so ids are committed there. The distinct parts of
about ``SLICE`` characters are the lanes of one numpy walk; each lane keeps a ring of ``RING``
times the longest piece's backpointers, and every ``longest`` characters the boundary that all
its surviving paths lead through is sought and the ids before it are committed. A lane that
finds none within its ring, and the last lanes of a slice when few are left, are walked alone
by ``_lattice``, whose window grows until its paths meet. Long parts, as in scripts without
spaces, are cut into overlapping stretches that are lanes of their own: where two neighbouring
stretches have a piece in common, the one's pieces before it and the other's from it on are the
path of both together, since all neighbours agree. A text longer than a slice is cut at
boundaries of parts. Beside its own ids, a text so needs memory for one slice only (a part
longer than a slice: also for its characters).

Cases: null stays null (no ids); an empty text has no ids; surrogates can't occur; repeated
rows are encoded each for itself; other columns aren't read by ``encode`` but pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwatch.llm import vec
from loomwatch.llm.shared import map_arrow

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters that are walked together.
SLICE = 1 << 18
#: Backpointers that a lane keeps, in lengths of the longest piece; 4 at least.
RING = 4
#: With fewer lanes left, each is walked alone.
LANES = 16
#: Parts of more characters are cut into stretches that begin every ``STEP`` characters and overlap by as many, where there are ``MANY`` such characters.
WIDE, STEP, MANY = 256, 128, 4096
#: Pairs of pieces whose agreement a worker remembers.
PAIRS = 200_000
#: Of a character in no piece, before its byte pieces are known; no boundary known yet.
BYTES, UNSET = -1, -2


@dataclass
class Vocabulary:
    """Pieces with their ids and scores, and what follows from them."""

    pieces: dict[str, int]
    scores: dict[int, float]
    byte_ids: list[int]
    texts: list[bytes]
    unknown: int
    model: str = "bpe"
    prefix: bool = True
    longest: int = 0
    parts: bool = True
    names: dict[int, str] = field(default_factory=dict)
    #: All beginnings of pieces, with the id of those that are pieces and -1 for the others.
    begins: dict[str, int] = field(default_factory=dict)
    #: When a piece is made by merging (-1: never, it is one character), and of which two.
    rank: dict[int, float] = field(default_factory=dict)
    halves: dict[int, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str, model: str = "bpe") -> Vocabulary:
        with open(path, "rb") as f:
            return cls.load(f.read(), model)

    @classmethod
    def load(cls, data: bytes, model: str = "bpe") -> Vocabulary:
        """Reads a model file's bytes with the public library, which only lists its pieces."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte_ids, texts, pieces = [-1] * 256, [], {}
        for i, name in enumerate(names):
            if sp.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                texts.append(bytes([int(name[3:5], 16)]))
            elif special[i]:
                texts.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                pieces[name] = i
                texts.append(name.replace(SPACE, " ").encode())
        out = cls(pieces, {i: sp.get_score(i) for i in pieces.values()}, byte_ids, texts, sp.unk_id(), model, prefix=sp.encode("a", out_type=str)[0].startswith(SPACE))
        out.names = {i: x for x, i in pieces.items()}
        out.longest = max(map(len, pieces))
        out.begins = {x[:n]: -1 for x in pieces for n in range(1, len(x))} | pieces
        if model == "bpe":
            out.rank = {i: -1.0 if len(x) == 1 else -out.scores[i] for x, i in pieces.items()}
            out.halves = {i: tuple(pieces[h] for h in out.merged(x)) for x, i in pieces.items() if len(x) > 1}
        out.parts = not any(SPACE in x.lstrip(SPACE) for x in pieces)
        return out

    def merged(self, text: str) -> list[str]:
        """What merging neighbours by rank, the best first, makes of a short string's characters, until two are left."""
        parts = list(text)
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Lookup:
    """Whole numbers by whole number keys, as a few hash tables: a key whose place is taken goes to the next one."""

    def __init__(self, keys: list[int], values: list[int]):
        left, value = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        bits = max(8, (4 * len(left)).bit_length())
        while len(left):
            key, held = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
            shift = 64 - bits
            at = self._place(left, shift, len(self.levels))
            _, first = np.unique(at, return_index=True)
            key[at[first]], held[at[first]] = left[first], value[first]
            self.levels.append((shift, key, held))
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, value, bits = left[rest], value[rest], max(8, bits - 1)

    @staticmethod
    def _place(keys: np.ndarray, shift: int, level: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 0x3C6EF372FE94F82A * level & (1 << 64) - 1 | 1)) >> np.uint64(shift)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        at = None
        for level, (shift, key, held) in enumerate(self.levels):
            place = self._place(keys, shift, level)
            there = key[place]
            same = np.flatnonzero(there == keys)
            out[same if at is None else at[same]] = held[place[same]]
            other = np.flatnonzero((there != keys) & (there >= 0))
            if not len(other):
                break
            at, keys = other if at is None else at[other], keys[other]
        return out


class Tables:
    """A vocabulary as arrays: its trie, what joins to what, ranks and halves, the bytes of pieces."""

    def __init__(self, v: Vocabulary):
        chars = sorted({ord(c) for x in v.pieces for c in x})
        self.code = np.zeros(0x110000, dtype=np.int32)  # by code point; 0: in no piece
        self.code[chars] = np.arange(1, len(chars) + 1)
        self.code[ord(" ")] = self.code[ord(SPACE)]
        self.width = len(chars) + 1
        node = {x: i for i, x in enumerate(sorted(v.begins, key=len), 1)}
        node[""] = 0
        edges = [(node[x[:-1]] * self.width + int(self.code[ord(x[-1])]), i) for x, i in node.items() if len(x) > 1]
        self.edges = Lookup([e for e, _ in edges], [i for _, i in edges])
        self.first = np.full(self.width, -1, dtype=np.int32)  # the node of a first character
        self.piece = np.full(len(node), -1, dtype=np.int32)
        self.goes_on = np.zeros(len(node), dtype=bool)
        for x, i in node.items():
            if x:
                self.piece[i] = v.begins[x]
                self.goes_on[node[x[:-1]]] = True
            if len(x) == 1:
                self.first[self.code[ord(x)]] = i
        n = self.n = len(v.texts)
        self.alone = np.zeros(self.width, dtype=bool)  # characters that are pieces
        self.alone[[int(self.code[ord(x)]) for x in v.pieces if len(x) == 1]] = True
        joins = [(v.pieces[x[:k]] * n + v.pieces[x[k:]], i) for x, i in v.pieces.items() for k in range(1, len(x)) if x[:k] in v.pieces and x[k:] in v.pieces]
        self.joins = Lookup([k for k, _ in joins], [i for _, i in joins])
        self.rank, self.left, self.right = np.full(n, -1.0), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        for i, r in v.rank.items():
            self.rank[i] = r
        for i, (a, b) in v.halves.items():
            self.left[i], self.right[i] = a, b
        self.chars = np.ones(n, dtype=np.int64)  # of pieces
        for x, i in v.pieces.items():
            self.chars[i] = len(x)
        self.sizes = np.array([len(x) for x in v.texts], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(v.texts), dtype=np.uint8)

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Encoder._agree`` of many pairs; a piece ``BYTES`` agrees with all."""
        out = a < 0
        at = np.flatnonzero(~out)
        a, b, until = a[at].astype(np.int64), b[at].astype(np.int64), None
        while len(at):
            joined = self.joins.get(a * self.n + b)
            fits = joined < 0 if until is None else (joined < 0) | (self.rank[joined] >= until)
            go = np.flatnonzero(fits)
            at, a, b = at[go], a[go], b[go]
            ra, rb = self.rank[a], self.rank[b]
            cut_a = ra > rb
            ended = ~cut_a & (rb < 0)
            out[at[ended]] = True
            go = np.flatnonzero(~ended)
            at, cut_a = at[go], cut_a[go]
            until = np.where(cut_a, ra[go], rb[go] + 0.5)  # of equal ranks the left one merges first
            a, b = np.where(cut_a, self.right[a[go]], a[go]), np.where(cut_a, b[go], self.left[b[go]])
        return out

    def edges_of(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, characters, piece) of all pieces that begin at each place; room: characters from there to the part's end."""
        at = np.flatnonzero(self.first[codes] >= 0)
        node, size, found = self.first[codes[at]], 1, []
        while len(at):
            piece = self.piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], np.full(len(hit), size, dtype=np.int32), piece[hit]))
            keep = np.flatnonzero(self.goes_on[node] & (room[at] > size))
            at, node = at[keep], node[keep]
            node = self.edges.get(node.astype(np.int64) * self.width + codes[at + size])
            keep = np.flatnonzero(node >= 0)
            at, node, size = at[keep], node[keep], size + 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


def _by_place(place: np.ndarray, until: int) -> tuple[np.ndarray, np.ndarray]:
    """What sorts by place, and where each place up to ``until`` begins in that order."""
    small = place.astype(np.uint16) if until < 1 << 16 else place  # small numbers are sorted by their digits
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(place[order], np.arange(until + 1))


class Lanes:
    """The lattices of many parts, walked side by side; each lane is the characters [start, end) of ``codes``."""

    def __init__(self, tables: Tables, longest: int, codes: np.ndarray, start: np.ndarray, end: np.ndarray, ring: int = 0, fewest: int | None = None):
        self.t, self.longest, self.ring = tables, longest, 1 << ((ring or RING * longest) - 1).bit_length()
        self.fewest = LANES if fewest is None else fewest
        self.order = np.argsort(start - end, kind="stable")  # the longest lane first, so those under way are the first ones
        self.start, self.size = start[self.order], (end - start)[self.order]
        self.codes = codes
        self.piece = np.full((len(start), self.ring), UNSET, dtype=np.int32)
        self.chars = np.zeros((len(start), self.ring), dtype=np.int32)
        self.piece[:, 0] = BYTES
        self.flat_piece, self.flat_chars = self.piece.reshape(-1), self.chars.reshape(-1)
        self.done = np.zeros(len(start), dtype=np.int64)
        self.given_up = np.zeros(len(start), dtype=bool)
        #: Where each lane's boundaries begin in ``ids``, which holds the piece before each boundary of the final paths.
        self.base = np.cumsum(self.size) - self.size
        self.ids = np.full(int(self.size.sum()), UNSET, dtype=np.int32)

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lane, boundary, piece before it) of all ids, by lane and boundary, and the lanes that must be walked alone; lanes are in the order of ``order``."""
        t, until = self.t, int(self.size[0]) + 1 if len(self.size) else 0
        lane_at = np.repeat(np.arange(len(self.start)), self.size)  # of each character of the lanes, one behind the other
        offset = np.arange(len(lane_at)) - np.repeat(self.base, self.size)
        codes = self.codes[np.repeat(self.start, self.size) + offset]
        begin, chars, piece = t.edges_of(codes, np.repeat(self.size, self.size) - offset)
        order, cut = _by_place(offset[begin], until)
        begin, chars, piece = begin[order], chars[order], piece[order]
        row = lane_at[begin] * self.ring
        odd = np.flatnonzero(~t.alone[codes])
        order, first = _by_place(offset[odd], until)
        odd_row = lane_at[odd[order]] * self.ring
        k, under_way = 0, len(self.start)
        while under_way:
            a, b = cut[k], cut[k + 1]
            self._step(k, row[a:b], chars[a:b], piece[a:b])
            if first[k + 1] > first[k]:
                self._bytes(k, odd_row[first[k] : first[k + 1]])
            k += 1
            ended = int(np.searchsorted(-self.size, -k))  # lanes longer than k come first
            self._commit(np.arange(ended, under_way), np.full(under_way - ended, k))
            under_way = ended
            if under_way < self.fewest and under_way and k >= 2 * self.longest:
                self.given_up[:under_way] = True
                break
            if under_way and k % self.longest == 0 and k >= 2 * self.longest and self.ring < until + self.longest:
                rows = np.flatnonzero(~self.given_up[:under_way])
                self._commit(rows, self._meet(rows, k))
                self.given_up[:under_way] |= k + 2 * self.longest - self.done[:under_way] >= self.ring
                self.piece[:under_way, (k + self.longest + np.arange(self.longest)) % self.ring] = UNSET  # room for the boundaries to come
        self.ids[np.repeat(self.given_up, self.size)] = UNSET
        at = np.flatnonzero(self.ids != UNSET)
        return lane_at[at], offset[at] + 1, self.ids[at], np.flatnonzero(self.given_up)

    def _step(self, k: int, row: np.ndarray, chars: np.ndarray, piece: np.ndarray) -> None:
        """Pieces that begin at k become the backpointers of the boundaries at their ends, if they agree with the one before them."""
        before, to = self.flat_piece[row + k % self.ring], row + ((k + chars) & (self.ring - 1))
        go = np.flatnonzero((before != UNSET) & (self.flat_piece[to] == UNSET))
        piece = piece[go]
        fits = np.flatnonzero(self.t.agree(before[go], piece))
        to = to[go[fits]]
        self.flat_piece[to], self.flat_chars[to] = piece[fits], chars[go[fits]]

    def _bytes(self, k: int, row: np.ndarray) -> None:
        """Characters in no piece."""
        to = row + (k + 1) % self.ring
        to = to[(self.flat_piece[row + k % self.ring] != UNSET) & (self.flat_piece[to] == UNSET)]
        self.flat_piece[to], self.flat_chars[to] = BYTES, 1

    def _meet(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The last boundary that all paths to the boundaries a later piece may begin at (k, ..., k + longest - 1) run through."""
        places = k + np.arange(self.longest)
        live = np.zeros((len(rows), self.ring), dtype=bool)
        live[:, places % self.ring] = (self.piece[rows[:, None], places % self.ring] != UNSET) & (places <= self.size[rows][:, None])
        left = live.sum(axis=1)
        for place in range(k + self.longest - 1, 0, -1):
            at = np.flatnonzero(live[:, place % self.ring] & (left > 1) & (place > self.done[rows]))
            if not len(at):
                if (left <= 1).all():
                    break
                continue
            to = (place - self.chars[rows[at], place % self.ring]) % self.ring
            live[at, place % self.ring] = False
            left[at] -= live[at, to]
            live[at, to] = True
        base = self.done[rows]
        turn = (np.arange(self.ring)[None, :] - base[:, None]) % self.ring  # how far each column is behind ``done``
        return np.where(left == 1, base + (live * turn).sum(axis=1), base)

    def _commit(self, rows: np.ndarray, to: np.ndarray) -> None:
        """The ids before the boundary ``to`` of each lane are final."""
        lane = rows[~self.given_up[rows]]
        at = end = to[~self.given_up[rows]]
        every = lane
        while True:
            go = np.flatnonzero(at > self.done[lane])
            lane, at = lane[go], at[go]
            if not len(lane):
                break
            place = lane * self.ring + (at & (self.ring - 1))
            self.ids[self.base[lane] + at - 1] = self.flat_piece[place]
            at = at - self.flat_chars[place]
        self.done[every] = end


class Encoder:
    """Encodes texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tables = Tables(vocabulary)
        self.agreed: dict[int, bool] = {}

    def _agree(self, a: int, b: int) -> bool:
        """Whether merging the joined characters of pieces a and b gives just (a, b).

        It does unless a merge across their boundary comes first. Going back in time, the piece at the boundary
        that was made last is cut into its halves, and a merge of the two pieces that then meet must not come
        before they were taken up."""
        if len(self.agreed) >= PAIRS:
            self.agreed.clear()
        v, key, until = self.v, a << 32 | b, float("inf")
        while True:
            joined = v.pieces.get(v.names[a] + v.names[b])
            if joined is not None and v.rank[joined] < until:
                self.agreed[key] = False
                return False
            if v.rank[a] > v.rank[b]:
                until, a = v.rank[a], v.halves[a][1]
            elif v.rank[b] < 0:
                self.agreed[key] = True
                return True
            else:
                until, b = v.rank[b] + 0.5, v.halves[b][0]  # of equal ranks the left one merges first

    def encode(self, text: str) -> np.ndarray:
        """The ids, as 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, how many each has, and whether its ids decode to it."""
        ids, sizes, restored = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64), np.ones(len(texts), dtype=bool)
        for part in self._slices(texts):
            found, counts = self._encode_slice([x for _, x in part])
            ids.append(found)
            of = np.array([i for i, _ in part], dtype=np.int64)
            np.add.at(sizes, of, counts)
            restored[of[~self._same(found, counts, [texts[i][a:b] for i, (a, b) in zip(of.tolist(), self.spans, strict=True)])]] = False
        return np.concatenate(ids), sizes, restored

    def _slices(self, texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
        """(text, characters to encode) of about ``SLICE`` characters together; ``spans`` says where in their texts they are."""
        held, spans, size = [], [], 0
        pre = " " * self.v.prefix
        for i, text in enumerate(texts):
            if not text:
                continue
            text, at = text.replace(SPACE, " "), 0
            while at < len(text):
                end = self._cut(text, at)
                held.append((i, pre * (at == 0) + text[at:end]))
                spans.append((at, end))
                size, at = size + end - at, end
                if size >= SLICE:
                    self.spans = spans
                    yield held
                    held, spans, size = [], [], 0
        if held:
            self.spans = spans
            yield held

    def _cut(self, text: str, at: int) -> int:
        """Where the slice that begins at ``at`` ends: at the last part's beginning in it, or at the first one behind it."""
        if len(text) - at <= SLICE or not self.v.parts:
            return len(text)
        end = at + SLICE
        while (end := text.rfind(" ", at + 1, end)) > at:
            if text[end - 1] != " ":
                return end
        end = at + SLICE
        while (end := text.find(" ", end)) >= 0:
            if text[end - 1] != " ":
                return end
            end += 1
        return len(text)

    def _encode_slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these in a row, and how many each has."""
        if self.v.model == "unigram" or not self.v.parts:
            found = [np.fromiter(self._lattice(x.replace(" ", SPACE)), dtype=np.int32) for x in texts]
            return np.concatenate(found), np.array([len(x) for x in found])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        start, end, same = self._distinct(points, first)
        ids, begin, counts = self._parts(points, start, end)
        n = counts[same]
        to = np.cumsum(n)
        out = ids[np.repeat(begin[same] - (to - n), n) + np.arange(to[-1])]
        ends = np.concatenate([[0], to])[np.searchsorted(self.at, first)]
        return out, np.diff(ends)

    def _distinct(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of the distinct parts, and which of them each part is; ``at`` keeps where parts begin."""
        blank = points == 32
        begins = np.zeros(len(points) + 1, dtype=bool)
        begins[1:-1] = blank[1:] & ~blank[:-1]
        begins[first[:-1]] = True
        self.at = np.flatnonzero(begins[:-1])
        size = np.diff(np.append(self.at, len(points)))
        hashes = vec.run_hashes(points, self.at, size)
        _, keep, same = np.unique(hashes, return_index=True, return_inverse=True)
        # Equal hashes must be equal parts; else each part counts as one of its own.
        where = np.repeat(self.at[keep[same]] - self.at, size) + np.arange(len(points))
        if not ((size[keep[same]] == size).all() and (points[where] == points).all()):
            keep, same = np.arange(len(size)), np.arange(len(size))
        return self.at[keep], self.at[keep] + size[keep], same

    def _parts(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts, where those of each part begin, and how many they are."""
        codes = self.tables.code[points]
        long = end - start > WIDE
        if (end - start)[long].sum() < MANY:
            long[:] = False
        which, bound, piece = self._walk(points, codes, start[~long], end[~long])
        which = np.flatnonzero(~long)[which]
        if long.any():
            at = np.flatnonzero(long)
            cut_which, cut_bound, cut_piece = self._stretches(points, codes, start[at], end[at], STEP)
            which = np.concatenate([which, at[cut_which]])
            bound, piece = np.concatenate([bound, cut_bound]), np.concatenate([piece, cut_piece])
            order = np.argsort(which, kind="stable")
            which, bound, piece = which[order], bound[order], piece[order]
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            char, kind = np.unique(points[start[which[odd]] + bound[odd] - 1], return_inverse=True)
            as_ids = [self._byte_ids(chr(c)) for c in char.tolist()]
            n = np.ones(len(piece), dtype=np.int64)
            n[odd] = np.array([len(x) for x in as_ids])[kind]
            at = np.cumsum(n) - n
            piece, which, odd_at = np.repeat(piece, n), np.repeat(which, n), at[odd]
            for c, x in enumerate(as_ids):
                for j, i in enumerate(x):
                    piece[odd_at[kind == c] + j] = i
        counts = np.bincount(which, minlength=len(start))
        return piece, np.cumsum(counts) - counts, counts

    def _walk(self, points: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray, **limits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, boundary, piece before it) of all parts, by part and boundary. A piece below 0 is a character whose byte pieces are to be put in; boundaries of parts that were walked alone are unknown."""
        lanes = Lanes(self.tables, self.v.longest, codes, start, end, **limits)
        lane, bound, piece, alone = lanes.walk()
        if len(alone):
            found = [np.fromiter(self._lattice(points[a : a + n].tobytes().decode("utf-32-le").replace(" ", SPACE)), dtype=np.int32) for a, n in zip(lanes.start[alone], lanes.size[alone], strict=True)]
            lane = np.concatenate([lane, np.repeat(alone, [len(x) for x in found])])
            piece, bound = np.concatenate([piece, *found]), np.concatenate([bound, np.zeros(len(lane) - len(bound), dtype=np.int64)])
        part = lanes.order[lane]
        order = np.argsort(part, kind="stable")
        return part[order], bound[order], piece[order]

    def _stretches(self, points: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_walk`` of long parts, in stretches; parts of which two neighbouring stretches have no piece in common are cut into longer ones, and in the end walked whole."""
        size, lap = end - start, step // 2
        n = -(-size // step)
        part = np.repeat(np.arange(len(start)), n)
        k = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
        begin, until = start[part] + np.maximum(0, k * step - lap), start[part] + np.minimum(size[part], (k + 1) * step + lap)
        # A ring longer than a stretch: its paths needn't meet before its end, so none is walked alone.
        at, bound, piece = self._walk(points, codes, begin, until, ring=2 * step + 2 * self.v.longest, fewest=0)
        stop = begin[at] + bound
        first = stop - np.where(piece < 0, 1, self.tables.chars[piece])
        has_next, has_last = np.append(part[1:] == part[:-1], False), np.append(False, part[1:] == part[:-1])
        ahead = np.flatnonzero(has_next[at] & (first >= np.append(begin[1:], 0)[at]))
        behind = np.flatnonzero(has_last[at] & (stop <= np.append(0, until[:-1])[at]))
        place = lambda i, of: (of * (len(points) + 1) + first[i]) * (2 * self.v.longest) + stop[i] - first[i]
        _, a, _ = np.intersect1d(place(ahead, at[ahead]), place(behind, at[behind] - 1), return_indices=True)
        here = np.where(has_last, -1, begin)  # where each stretch's pieces count: from the first one in common on
        mine, index = np.unique(at[ahead[a]], return_index=True)
        here[mine + 1] = first[ahead[a]][index]
        failed = np.zeros(len(start), dtype=bool)
        failed[part[here < 0]] = True
        there = np.append(here[1:], 0)
        there[~has_next] = len(points) + 1
        keep = (first >= here[at]) & (first < there[at]) & ~failed[part[at]]
        found = part[at[keep]], stop[keep] - start[part[at[keep]]], piece[keep]
        if failed.any():
            odd = np.flatnonzero(failed)
            more = self._stretches(points, codes, start[odd], end[odd], 4 * step) if step <= STEP else self._walk(points, codes, start[odd], end[odd])
            found = tuple(np.concatenate(x) for x in zip(found, (odd[more[0]], *more[1:]), strict=True))
            order = np.argsort(found[0], kind="stable")
            found = tuple(x[order] for x in found)
        return found

    def _byte_ids(self, char: str) -> list[int]:
        ids = [self.v.byte_ids[b] for b in char.encode()]
        return ids if min(ids) >= 0 else [self.v.unknown]

    def _decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        n = self.tables.sizes[ids]
        to = np.cumsum(n)
        return self.tables.bytes[np.repeat(self.tables.begin[ids] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]

    def _same(self, ids: np.ndarray, counts: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether the ids of each part of a text decode to it."""
        got = self._decode_bytes(ids)
        sums = np.concatenate([[0], np.cumsum(self.tables.sizes[ids])])
        to = sums[np.cumsum(counts)]
        begin = to - np.diff(np.concatenate([[0], to]))
        if self.v.prefix:
            begin = begin + np.array([a == 0 for a, _ in self.spans])
        want = [x.encode() for x in texts]
        size = np.array([len(x) for x in want])
        same = to - begin == size
        at = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(b"".join(want), dtype=np.uint8)
        idx = np.flatnonzero(np.repeat(same, size))
        where = np.repeat(begin - at[:-1], size)[idx] + idx
        wrong = np.concatenate([[0], np.cumsum(np.bincount(idx[got[where] != raw[idx]], minlength=len(raw)))])
        return same & (wrong[at[1:]] == wrong[at[:-1]])

    def _lattice(self, text: str) -> Iterator[int]:
        """The streaming lattice: yields ids as soon as they are final."""
        v, best_sum = self.v, self.v.model == "unigram"
        begins, scores, longest, agreed = v.begins.get, v.scores, v.longest, self.agreed.get
        floor = min(scores.values()) - 10.0 if best_sum else 0.0  # of a character in no piece
        # By boundary: the piece before it (None: byte pieces of one character), where that begins, the sum.
        back: dict[int, tuple[int | None, int, float]] = {0: (None, -1, 0.0)}
        done, size = 0, len(text)
        for begin in range(size):
            at = back.get(begin)
            if at is None:
                continue
            before, _, total = at
            for end in range(begin + 1, size + 1):
                i = begins(text[begin:end])
                if i is None:
                    break
                if i < 0:
                    continue
                if best_sum:
                    if end not in back or total + scores[i] > back[end][2]:
                        back[end] = (i, begin, total + scores[i])
                elif end not in back:  # else its one path is known
                    if before is None:
                        back[end] = (i, begin, 0.0)
                    else:
                        fits = agreed(before << 32 | i)
                        if self._agree(before, i) if fits is None else fits:
                            back[end] = (i, begin, 0.0)
            if text[begin] not in v.pieces and (begin + 1 not in back or best_sum and total + floor > back[begin + 1][2]):
                back[begin + 1] = (None, begin, total + floor)
            if begin - done >= 2 * longest:
                # Boundaries that a later piece may begin at; all paths to them run through one boundary or more.
                meet = self._meet(back, [b for b in range(begin + 1, min(begin + longest, size) + 1) if b in back], done)
                if meet > done:
                    yield from self._path(back, text, done, meet)
                    for b in [b for b in back if b < meet]:
                        del back[b]
                    done = meet
        if done < size:
            yield from self._path(back, text, done, size)

    @staticmethod
    def _meet(back: dict, live: list[int], done: int) -> int:
        """The last boundary that all paths to the live ones run through."""
        at = set(live)
        while len(at) > 1:
            top = max(at)
            at.remove(top)
            at.add(back[top][1] if back[top][1] >= done else done)
        return at.pop() if at else done

    def _path(self, back: dict, text: str, done: int, end: int) -> list[int]:
        out: list[int] = []
        while end > done:
            i, begin, _ = back[end]
            if i is None:
                out.extend(reversed(self._byte_ids(text[begin:end])))
            else:
                out.append(i)
            end = begin
        return out[::-1]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        out = self._decode_bytes(np.asarray(ids, dtype=np.int64)).tobytes().decode("utf-8", errors="replace")
        return out[1:] if self.v.prefix and out.startswith(" ") else out


@lru_cache(maxsize=1)
def _encoder(data: bytes, model: str) -> Encoder:
    """One for each worker, which so remembers parts from task to task."""
    return Encoder(Vocabulary.load(data, model))


def _shared(docs: DataFrame, vocabulary: str) -> Broadcast[bytes]:
    """A vocabulary file, of fixed size; the driver reads no more than its bytes."""
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = MODEL, model: str = "bpe", check: bool = True) -> DataFrame:
    """docs with the columns ``ids`` (array<int>), ``n_tokens`` and, with ``check``, ``restored`` (decoding gives the text), which replace columns of these names."""
    shared = _shared(docs, vocabulary)
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())] + [T.StructField("restored", T.BooleanType())] * check
    old = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c not in {f.name for f in new}])
    out = T.StructType([*old.schema, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, model)
        for part in vec.chunks(batches, text_col, 1 << 20):
            texts = part.column(text_col).to_pylist()
            ids, sizes, restored = encoder.encode_all(texts)
            nulls = np.array([t is None for t in texts])
            cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids), mask=pa.array(nulls))
            added = [lists, pa.array(sizes)] + [pa.array(restored, pa.bool_(), mask=nulls)] * check
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[f.name for f in out])

    return map_arrow(old, run, out)


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "text", vocabulary: str = MODEL) -> DataFrame:
    """docs with the decoded text, which replaces a column of that name; null ids give null."""
    shared = _shared(docs, vocabulary)
    old = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    out = T.StructType([*old.schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, "bpe")
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in out])

    return map_arrow(old, run, out)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether decoding gives the text back."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids."""
    return encode(docs)


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
