"""BPE encoding and decoding with forced boundaries.

Merging only ever makes tokens of the vocabulary, so two symbols that stand side by side in no
token are never merged across: between them a text can be cut for certain. A symbol is a byte,
or a byte that ends a word. Words (what the vocabulary's pattern takes as one) are cut at all such
places; the fragments are encoded independently and their ids are put in a row again.

The fragments of about ``SLICE`` characters of text are handled together in numpy: each distinct
one is encoded once, all side by side. In each round every fragment merges its pair of the least
rank, wherever it occurs, from the left. A pair that holds a merged token has a later rank than
that token (checked when the vocabulary is read), so a round can't bring up an earlier merge.

A fragment of more than ``WIDE`` symbols, such as a long word in a script without spaces, would take
many rounds. It is encoded in overlapping windows instead. A row of tokens is what merging gives
exactly if it is so for each two neighbours; so where two neighbouring windows have a token in
common, one's tokens before it and the other's from it on are the tokens of both together. If some
windows have none, that fragment is done again with windows of twice the size.

Before that, as the vocabulary's file asks: NFC, lower case, and contractions, runs of letters, single
digits and runs of other characters as words; white space is dropped. Special tokens in a text become
their ids. Decoding joins the tokens' names by a space, as the public library does for a file without a
decoder. Characters that are newer than Python's tables are asked of the public library.

Cases: null stays null (no ids, ``n_tokens`` 0); an empty text has no ids and decodes to an empty one;
repeated rows are encoded each for itself; other columns pass through, those named as a new column are
replaced. A text of any length needs memory for itself, its ids and one slice (a single run of letters
longer than a slice: about a hundred bytes a letter of it).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwatch.llm import vec
from loomwatch.llm.pieces import Lookup
from loomwatch.llm.shared import map_arrow

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Characters that are handled together.
SLICE = 1 << 19
#: Fragments of more symbols are encoded in windows of twice ``STEP`` symbols that begin every ``STEP``.
WIDE, STEP = 64, 32
#: Texts of an Arrow batch that are handled together have about so many bytes.
CHUNK = 1 << 21
NEVER = np.iinfo(np.int32).max
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: What the vocabulary's file must ask for (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _visible() -> list[str]:
    """The character that stands for each byte in the names of tokens: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


def _classes() -> np.ndarray:
    """SPACE, LETTER, DIGIT or OTHER by code point; UNKNOWN where Python's tables know no character."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    kinds = {"L": LETTER, "N": DIGIT, "Z": SPACE}
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        out[c] = UNKNOWN if category == "Cn" else kinds.get(category[0], OTHER)
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


class Vocabulary:
    """A vocabulary file: byte symbols, merges, special tokens, names."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        fits = spec["normalizer"]["normalizers"] == NORMALIZERS and spec["decoder"] is None and not model["continuing_subword_prefix"] and not model["dropout"] and not model["ignore_merges"]
        fits &= pre[0]["pattern"]["Regex"] == PATTERN and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and pre[1]["type"] == "ByteLevel" and not (pre[1]["use_regex"] or pre[1]["add_prefix_space"])
        if not fits or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("this vocabulary file asks for steps that aren't known here")
        # The library says what characters are that are newer than Python's tables.
        self.public = Tokenizer.from_str(data.decode())
        ids, end = dict(model["vocab"]), model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: x for x, i in (ids | self.special).items()}
        self.n = max(names) + 1
        self.names = pa.array([names.get(i, "") for i in range(self.n)], pa.string())
        visible = _visible()
        #: The id of each byte, and 256 further on of each byte that ends a word.
        self.symbol = np.array([ids[c] for c in visible] + [ids[c + end] for c in visible], dtype=np.int32)
        byte = {c: b for b, c in enumerate(visible)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs, made = [(ids[a], ids[b]) for a, b in merges], [ids[a + b] for a, b in merges]
        self.rank = np.full(self.n, -1, dtype=np.int32)
        self.rank[self.symbol] = 0
        for r, (i, (a, b)) in enumerate(zip(made, pairs, strict=True), 1):
            if self.rank[i] >= 0 or min(self.rank[a], self.rank[b]) < 0:
                raise ValueError("a token is made twice, or before its halves")
            self.rank[i] = r
        self.merges = Lookup([a * self.n + b for a, b in pairs], made)
        #: Whether two symbols stand side by side in some token.
        self.inside = np.zeros((512, 512), dtype=bool)
        for x, i in ids.items():
            if self.rank[i] > 0:
                s = [byte[c] for c in x.removesuffix(end)]
                s[-1] += 256 * x.endswith(end)
                self.inside[s[:-1], s[1:]] = True
        self.classes = _classes()
        self.lengths = np.zeros(self.n, dtype=np.int32)  # of tokens, in symbols
        for x, i in ids.items():
            self.lengths[i] = len(x.removesuffix(end))

    def normal(self, text: str) -> str:
        """NFC and lower case. A capital sigma has one lower case here, wherever it stands."""
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The class of each character; those that Python doesn't know are looked up once."""
        out = self.classes[points]
        if (out == UNKNOWN).any():
            for c in np.unique(points[out == UNKNOWN]).tolist():
                parts = [at for _, at in self.public.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}!")]
                self.classes[c] = DIGIT if len(parts) == 3 else LETTER if parts[0] == (0, 2) else SPACE if parts[1] == (2, 3) else OTHER
            out = self.classes[points]
        return out

    def merge(self, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all fragments in a row, and how many each has; a fragment begins at each ``start``, none is empty."""
        size = np.diff(np.append(start, len(symbols)))
        out, lane, at = symbols.copy(), np.repeat(np.arange(len(start)), size), np.arange(len(symbols))
        held = np.ones(len(out), dtype=bool)  # places that still hold a token
        token, rank, made = symbols, np.full(len(symbols), NEVER, dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)
        look = np.flatnonzero(lane[1:] == lane[:-1])
        while True:
            found = self.merges.get(token[look].astype(np.int64) * self.n + token[look + 1])
            rank[look] = np.where(found >= 0, self.rank[found], NEVER)
            made[look] = found
            begin = np.flatnonzero(np.diff(lane, prepend=-1)) if len(lane) else np.zeros(0, dtype=np.int64)
            if not len(begin):
                break
            least = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(lane)))
            if (least == NEVER).any():  # these fragments are done
                done = np.repeat(least == NEVER, count)
                out[at[done]] = token[done]
                token, rank, made, lane, at = token[~done], rank[~done], made[~done], lane[~done], at[~done]
                least, count = least[least != NEVER], count[least != NEVER]
                if not len(lane):
                    break
            pick = rank == np.repeat(least, count)
            both = pick[1:] & pick[:-1]
            if both.any():  # of one symbol repeated: every second pair, from the left
                where = np.flatnonzero(pick)
                first = np.append(True, np.diff(where) > 1)
                turn = np.arange(len(where)) - np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
                pick[where[turn % 2 == 1]] = False
            where = np.flatnonzero(pick)
            token = token.copy()
            token[where] = made[where]
            keep = np.ones(len(token), dtype=bool)
            keep[where + 1] = False
            held[at[where + 1]] = False
            token, rank, made, lane, at = token[keep], rank[keep], made[keep], lane[keep], at[keep]
            where = where - np.arange(len(where))  # where the merged ones are now
            rank[where] = NEVER
            near = np.zeros(len(lane), dtype=bool)
            near[where] = True
            near[where[where > 0] - 1] = True
            near[:-1] &= lane[1:] == lane[:-1]
            look = np.flatnonzero(near[:-1])
        return out[held], np.add.reduceat(held, start, dtype=np.int64) if len(start) else np.zeros(0, dtype=np.int64)

    def encode_fragments(self, symbols: np.ndarray, start: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """``merge``, long fragments in windows."""
        size = np.diff(np.append(start, len(symbols)))
        long = size > max(WIDE, 2 * step)
        if not long.any():
            return self.merge(symbols, start)
        tokens, counts = [np.zeros(0, dtype=np.int32)], np.zeros(len(start), dtype=np.int64)
        of = [np.zeros(0, dtype=np.int64)]  # the fragment of each token

        def add(which: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> None:
            tokens.append(found[0])
            of.append(np.repeat(which, found[1]))
            counts[which] = found[1]

        def cut(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = size[which]
            to = np.cumsum(n)
            return symbols[np.repeat(start[which] - (to - n), n) + np.arange(to[-1] if len(to) else 0)], to - n

        short = np.flatnonzero(~long)
        if len(short):
            add(short, self.merge(*cut(short)))
        which = np.flatnonzero(long)
        *found, failed = self._windows(*cut(which), size[which], step)
        add(which[~failed], tuple(found))
        if failed.any():
            add(which[failed], self.encode_fragments(*cut(which[failed]), step=2 * step))
        order = np.argsort(np.concatenate(of), kind="stable")
        return np.concatenate(tokens)[order], counts

    def _windows(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of the fragments whose windows all meet, how many those are, and which fragments' windows don't."""
        lap, n = step // 2, -(-size // step)
        frag = np.repeat(np.arange(len(start)), n)
        first = np.cumsum(n) - n
        k = np.arange(len(frag)) - first[frag]
        begin = start[frag] + np.maximum(0, k * step - lap)
        end = start[frag] + np.minimum(size[frag], (k + 1) * step + lap)
        width = end - begin
        at = np.cumsum(width) - width
        tokens, counts = self.merge(symbols[np.repeat(begin - at, width) + np.arange(int(width.sum()))], at)
        window = np.repeat(np.arange(len(frag)), counts)
        length = self.lengths[tokens].astype(np.int64)
        to = np.cumsum(length)
        place = to - length - np.repeat((to - length)[np.cumsum(counts) - counts], counts) + np.repeat(begin, counts)  # of each token, in ``symbols``
        # A token of a window in the next one's reach, and one of the next in this one's: (window, place, length) in common.
        key = (place * 64 + np.minimum(length, 63)).astype(np.int64)
        has_next = np.append(frag[1:] == frag[:-1], False)
        ahead = np.flatnonzero(has_next[window] & (place >= np.append(begin[1:], 0)[window]))
        has_last = np.append(False, frag[1:] == frag[:-1])
        behind = np.flatnonzero(has_last[window] & (place + length <= np.append(0, end[:-1])[window]))
        top = (len(symbols) + 1) * 64
        _, a, _ = np.intersect1d(window[ahead] * top + key[ahead], (window[behind] - 1) * top + key[behind], return_indices=True)
        from_here = np.where(has_last, -1, begin)  # where each window's part of the result begins: at the first token in common
        mine, index = np.unique(window[ahead[a]], return_index=True)
        from_here[mine + 1] = place[ahead[a]][index]
        failed = np.zeros(len(start), dtype=bool)
        failed[frag[from_here < 0]] = True
        until = np.append(from_here[1:], 0)
        until[~has_next] = len(symbols) + 1
        keep = (place >= from_here[window]) & (place < until[window]) & ~failed[frag[window]]
        return tokens[keep], np.bincount(frag[window[keep]], minlength=len(start))[~failed], failed


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, data: bytes):
        self.v = Vocabulary(data)
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.v.special, key=len, reverse=True)) + ")") if self.v.special else None

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        ids, sizes = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
        for of, parts in self._slices(texts):
            found, counts = self._encode_slice(parts)
            ids.append(found)
            np.add.at(sizes, np.array(of, dtype=np.int64), counts)
        return np.concatenate(ids), sizes

    def _slices(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str | int]]]:
        """(texts' numbers, their normal parts or special ids) of about ``SLICE`` characters together."""
        of, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for part in self.split.split(text) if text and self.split and self.split.search(text) else (text,):
                if not part:
                    continue
                if part in self.v.special:
                    of.append(i)
                    parts.append(self.v.special[part])
                    continue
                points = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
                part = self.v.public.normalizer.normalize_str(part) if (self.v.classes[points] == UNKNOWN).any() or self._new(points) else self.v.normal(part)
                for cut in self._cuts(part):
                    of.append(i)
                    parts.append(cut)
                    size += len(cut)
                    if size >= SLICE:
                        yield of, parts
                        of, parts, size = [], [], 0
        if parts:
            yield of, parts

    def _new(self, points: np.ndarray) -> bool:
        """Whether a character is newer than Python's tables, though its class is known by now."""
        high = points[points >= 0x370]
        return bool(len(high)) and any(unicodedata.category(chr(c)) == "Cn" for c in np.unique(high).tolist())

    def _cuts(self, text: str) -> Iterator[str]:
        """A text in parts of about a slice, cut between characters of two kinds (not behind an apostrophe)."""
        at = 0
        while len(text) - at > SLICE:
            end, step = at + SLICE, 4096
            while end < len(text):
                part = text[end - 1 : end + step]
                points = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
                kinds = self.v.kinds(points)
                found = np.flatnonzero((kinds[1:] != kinds[:-1]) & (points[:-1] != 39))
                if len(found):
                    end += int(found[0])
                    break
                end, step = end + len(part) - 1, 2 * step
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def _encode_slice(self, parts: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and how many each has."""
        v = self.v
        raw = "\n".join(x if isinstance(x, str) else "" for x in parts) + "\n"
        points = np.frombuffer(raw.encode("utf-32-le"), dtype=np.uint32)
        kinds, word = v.kinds(points), self._words(points)
        data = np.frombuffer(raw.encode(), dtype=np.uint8)
        lead = np.flatnonzero(vec.LEADS[data])
        char = np.cumsum(vec.LEADS[data]) - 1  # of each byte
        keep = np.flatnonzero(kinds[char] != SPACE)
        starts = np.zeros(len(data), dtype=bool)
        starts[lead[word]] = True
        starts = starts[keep]
        part_end = np.searchsorted(keep, lead[np.cumsum([len(x) + 1 if isinstance(x, str) else 1 for x in parts]) - 1])  # in kept bytes
        symbols = data[keep].astype(np.int32)
        last = np.append(starts[1:], True)[: len(keep)]
        symbols[last] += 256
        begins = starts.copy()
        begins[1:] |= ~v.inside[symbols[:-1], symbols[1:]]
        at = np.flatnonzero(begins)
        if len(at):
            tokens, counts = self._distinct(symbols, at)
        else:
            tokens, counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        until = np.append(0, np.cumsum(counts))[np.searchsorted(at, part_end)]
        sizes = np.diff(until, prepend=0)
        special = np.array([not isinstance(x, str) for x in parts])
        if special.any():
            where = np.flatnonzero(special)
            tokens = np.insert(tokens, until[where], [parts[i] for i in where])
            sizes[where] = 1
        return tokens.astype(np.int32), sizes

    def _distinct(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the fragments that begin at ``at``, each distinct one encoded once."""
        v, size = self.v, np.diff(np.append(at, len(symbols)))
        _, one, same = np.unique(vec.run_hashes(symbols, at, size), return_index=True, return_inverse=True)
        # Equal hashes must be equal fragments; else each counts as one of its own.
        where = np.repeat(at[one[same]] - at, size) + np.arange(len(symbols))
        if not ((size[one[same]] == size).all() and (symbols[where] == symbols).all()):
            one, same = np.arange(len(size)), np.arange(len(size))
        n = size[one]
        to = np.cumsum(n)
        tokens, counts = v.encode_fragments(v.symbol[symbols[np.repeat(at[one] - (to - n), n) + np.arange(to[-1])]], to - n)
        begin, n = np.cumsum(counts) - counts, counts[same]
        to = np.cumsum(n)
        return tokens[np.repeat(begin[same] - (to - n), n) + np.arange(to[-1])], n

    def _words(self, points: np.ndarray) -> np.ndarray:
        """Where words begin."""
        kinds = self.v.kinds(points)
        starts = kinds != SPACE
        starts[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        # Contractions: an apostrophe that doesn't go on with a run of other characters, and its letters.
        quote = np.flatnonzero((points == 39) & starts)
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        is_ = lambda x, c: x == ord(c)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        longer = (is_(one, "r") & is_(two, "e")) | (is_(one, "v") & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))
        for where, n in ((quote[short], 2), (quote[longer & ~short], 3)):
            starts[where + 1] = False
            after = where[where + n < len(points)] + n
            starts[after] |= kinds[after] != SPACE
        return np.flatnonzero(starts)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids: their tokens' names, joined by a space."""
        names = self.v.names.take(ids.flatten())
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), names)
        texts = pc.binary_join(lists, " ")
        return texts if not ids.null_count else pc.if_else(ids.is_valid(), texts, None)


@lru_cache(maxsize=1)
def _codec(data: bytes) -> Codec:
    """One for each worker."""
    return Codec(data)


def _shared(docs: DataFrame, vocabulary: str) -> Broadcast[bytes]:
    """A vocabulary file, of fixed size; the driver reads no more than its bytes."""
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, decoded_col: str | None = None) -> DataFrame:
    """docs with the columns ``ids`` (array<int>), ``n_tokens`` and, where it has a name, what decoding gives."""
    shared = _shared(docs, vocabulary)
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    new += [T.StructField(decoded_col, T.StringType())] if decoded_col else []
    old = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c not in {f.name for f in new}])
    out = T.StructType([*old.schema, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for part in vec.chunks(batches, text_col, CHUNK):
            column = part.column(text_col)
            ids, sizes = codec.encode_all(column.to_pylist())
            nulls = column.is_null()
            cuts = np.append(0, np.cumsum(sizes)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids), mask=nulls)
            added = [lists, pa.array(sizes)] + ([codec.decode(lists)] if decoded_col else [])
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[f.name for f in out])

    return map_arrow(old, run, out)


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with the decoded text, which replaces a column of that name; null ids give null."""
    shared = _shared(docs, vocabulary)
    old = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    out = T.StructType([*old.schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, codec.decode(batch.column(ids_col))], names=[f.name for f in out])

    return map_arrow(old, run, out)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of what decoding them gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = encode(docs, decoded_col="decoded")
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_bpe": op11_bpe}
SQL: dict[str, str] = {}
