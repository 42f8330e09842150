"""N-gram language model in a log-frequency Bloom filter.

Counts of word pairs are quantised to levels, 1 + floor(log_base(count)), and a pair at level
q is stored by adding (pair, 1) ... (pair, q) to a Bloom filter. A lookup probes level after
level until one is missing; the last found level gives the count. False positives, at the
rate that ``bits_per_item`` sets, can only raise a count by a level.

Words and their counts are exact: frequent ones are broadcast (at most ``hot_words``, whatever
the corpus size), occurrences of all others are summed by document and joined.

The score of a text is the sum over its tokens of log10 P(w | u),

    P(w | u) = l c'(u, w) / c(u) + (1 - l) P(w),     P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

u being the token before (the end token before the first). c' is the quantised pair count, at
most c(u). l is the share of training pairs that occur twice or more (one minus the
Good-Turing share of unseen pairs), so a corpus without repetition falls back on words.

How counts travel: each task counts its pairs with numpy and sends, for each of ``parts``
ranges of the pair hash, one sorted run of 8-byte hashes and their counts, compressed;
no key is hot, since a task sends a pair once for each ``FLUSH`` words. A range is merged in one task, which
also builds its segment of the filter. The number of ranges follows the number of tokens. Of
pairs seen ``min_count`` times or more (2, at any size: pairs seen once say little), the filter
holds all, up to ``max_bytes``. Where they are more, it holds the frequent levels that fit;
tokens whose pair it doesn't hold go to the pair's range, in packed runs by chunks of texts, and
are looked up among the range's exact counts. What they add to a text's score is summed by row.

Cases: null texts are empty; a text without words has the end token only; an empty training
set gives N = 0 and V = 0 (words then have equal probability); repeated rows are scored each
for itself, and counted each; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm import vec
from loomwatch.llm.shared import written

#: The end of a text counts as a token; its hash is a fixed number.
END = np.uint64(0x5EED0E0D00000001)
FLUSH = 4_000_000
_LEVEL, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
WORDS_A_PART = 4_000_000


@dataclass(frozen=True)
class Settings:
    hot_words: int = 1_000_000
    min_count: int = 2
    base: float = 2.0
    bits_per_item: float = 10.0
    probes: int = 5
    max_bytes: int = 64 << 20


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token behind each text; and where each text begins (one more at the end)."""
    words = vec.Words(*vec.text_bytes(texts))
    out = np.insert(words.hash, words.at[1:], END)
    return out, words.at + np.arange(len(words.at))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Hashes of (token before, token); texts follow each other, each with its end, so an end stands before each first word."""
    before = np.empty_like(tokens)
    before[0] = END
    before[1:] = tokens[:-1]
    return vec.mix(vec.mix(before) + tokens * np.uint64(0xD1342543DE82EF95))


def _add(old: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and counts, with more values added."""
    keys, n = np.unique(values, return_counts=True)
    if not len(old[0]):
        return keys, n.astype(np.int64)
    return _merge([old[0], keys], [old[1], n.astype(np.int64)])


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def count_words(train: DataFrame, text_col: str) -> DataFrame:
    """(w, c): exact counts of the training tokens, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_signed(held[0])), pa.array(held[1])], names=["w", "c"])

        for part in vec.chunks(batches, "_text"):
            held = _add(held, _tokens(part.column("_text"))[0])
            if len(held[0]) > FLUSH:
                yield out()
                held = (held[0][:0], held[1][:0])
        yield out()

    return train.select(F.col(text_col).alias("_text")).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def count_pairs(train: DataFrame, text_col: str, parts: int) -> DataFrame:
    """(part, run): sorted runs of pair hashes and counts of one task, by range of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys, _bounds(parts)).tolist()
            for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)):
                if a < b:
                    # Sorted hashes are sent as differences, whose upper bytes are mostly zero; counts of one as zeros.
                    gaps = np.diff(keys[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
                    raw = np.int64(b - a).tobytes() + np.ascontiguousarray(gaps).tobytes() + (n[a:b] - 1).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pack(raw)], pa.binary())], names=["part", "run"])

        for part in vec.chunks(batches, "_text"):
            tokens, _ = _tokens(part.column("_text"))
            if len(tokens):
                held.append(_pairs(tokens))
                size += len(tokens)
            if size > FLUSH:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return train.select(F.col(text_col).alias("_text")).mapInArrow(run, "part int, run binary")


def _bounds(parts: int) -> np.ndarray:
    """Least hash of each range."""
    return np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    gaps = np.frombuffer(raw, dtype=np.uint8, offset=8, count=8 * n).reshape(8, n).T
    counts = np.frombuffer(raw, dtype=np.uint8, offset=8 + 8 * n).reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(gaps).view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(counts).view(np.uint32).ravel().astype(np.int64) + 1


def _planes(x: np.ndarray) -> bytes:
    """An array compressed byte by byte of its items."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")


def _whole(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: Of each token to look up: pair, row, counts of the token and the one before (-1: not known), and their hashes where one count isn't.
_PROBE = (np.uint64, np.uint32, np.int64, np.int64, np.int64, np.int64)


def _probes(held: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[tuple[int, list[bytes]]]:
    """A packed run of tokens to look up for each range."""
    cols = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    cols = [x[order] for x in cols]
    cuts = np.searchsorted(cols[0], _bounds(parts)).tolist()
    for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(order)], strict=True)):
        if a < b:
            keys, row, cw, cu, w, u = (x[a:b] for x in cols)
            cold = (cw < 0) | (cu < 0)
            yield p, [_planes(x) for x in (np.diff(keys, prepend=np.uint64(0)), row, cw + 1, cu + 1, w[cold], u[cold])]


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


class Segment:
    """A Bloom filter of (hash, level) items in a numpy array."""

    def __init__(self, bits: np.ndarray, probes: int):
        self.bits, self.probes = bits, probes

    @staticmethod
    def places(keys: np.ndarray, level: int, probes: int, size: int) -> Iterator[np.ndarray]:
        h = vec.mix(keys + np.uint64(level * _LEVEL & _MASK))
        step = vec.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
        for _ in range(probes):
            yield h % np.uint64(size)
            h = h + step

    @classmethod
    def build(cls, keys: np.ndarray, levels: np.ndarray, bits_per_item: float, probes: int) -> bytes:
        size = max(8, int(-(-levels.sum() * bits_per_item // 8)) * 8)
        bits = np.zeros(size, dtype=bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            for at in cls.places(keys[levels >= q], q, probes, size):
                bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """All segments one behind the other; a pair's range names its segment."""

    def __init__(self, segments: list[bytes], probes: int):
        self.sizes = np.array([8 * len(s) for s in segments], dtype=np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in segments])])[:-1].astype(np.uint64)
        self.data, self.probes, self.bounds = b"".join(segments), probes, _bounds(len(segments))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Probes level after level; 0 where not even the first is found."""
        data = np.frombuffer(self.data, dtype=np.uint8)
        segment = np.searchsorted(self.bounds, keys, side="right") - 1
        start, size = self.starts[segment], self.sizes[segment]
        out, alive, q = np.zeros(len(keys), dtype=np.int64), np.flatnonzero(size > 0), 1
        while len(alive):
            left = alive
            for probe in range(self.probes):
                # The k-th place again from the level's two hashes; most keys miss at the first.
                h = vec.mix(keys[left] + np.uint64(q * _LEVEL & _MASK))
                step = vec.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
                at = (h + np.uint64(probe) * step) % size[left]
                left = left[(data[(start[left] + (at >> np.uint64(3))).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            out[left] = q
            alive, q = left, q + 1
        return out


def build_filter(train: DataFrame, text_col: str, n_tokens: int, settings: Settings) -> tuple[Filter, float, DataFrame | None]:
    """The filter, the share of pairs seen twice or more, and where the filter can't hold all, (part, pairs, counts) of each range."""
    parts = max(1, -(-n_tokens // WORDS_A_PART))
    runs = count_pairs(train, text_col, parts)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _merge(*map(list, zip(*(_unpack(x) for x in table.column("run").to_pylist()), strict=True)))
        keep = counts >= settings.min_count
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([int(counts.sum())]), "once": pa.array([int((counts == 1).sum())]), "pairs": pa.array([pa.py_buffer(keys[keep].tobytes()).to_pybytes()], pa.binary()), "counts": pa.array([counts[keep].tobytes()], pa.binary())})

    merged = written(runs.groupBy("part").applyInArrow(merge, "part int, n long, once long, pairs binary, counts binary"), "pairs")
    total = merged.agg(F.sum("n"), F.sum("once")).first()
    share = 1 - (total[1] or 0) / total[0] if total[0] else 0.0

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many items the pairs of each count make."""
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                levels = level_of(np.frombuffer(x, dtype=np.int64), settings.base)
                at, n = np.unique(levels, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], names=["q", "n"])

    by_level = {r.q: r.n for r in merged.select("counts").mapInArrow(items, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()}  # as many rows as levels
    least, fits = 0, settings.max_bytes * 8 / settings.bits_per_item
    while sum(q * n for q, n in by_level.items() if q > least) > fits:
        least += 1

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, k, c in zip(*(batch.column(x).to_pylist() for x in ("part", "pairs", "counts")), strict=True):
                keys, levels = np.frombuffer(k, dtype=np.uint64), level_of(np.frombuffer(c, dtype=np.int64), settings.base)
                keep = levels > least
                made = Segment.build(keys[keep], levels[keep], settings.bits_per_item, settings.probes) if keep.any() else b""
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.binary())], names=["part", "bits"])

    found = {r.part: bytes(r.bits) for r in merged.select("part", "pairs", "counts").mapInArrow(segments, "part int, bits binary").collect()}  # max_bytes at most
    return Filter([found.get(p, b"") for p in range(parts)], settings.probes), share, merged.select("part", "pairs", "counts") if least else None


def score_texts(docs: DataFrame, train: Column, key_col: str, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row. train: which rows are counted. key_col names a row."""
    spark = docs.sparkSession
    learned = docs.where(F.coalesce(train, F.lit(False))).select(text_col)
    words = written(count_words(learned, text_col), "words")
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The counts' own distribution tells from which count on words are few enough to broadcast.
    by_size = words.groupBy(F.log2(F.col("c").cast("double")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("e")).collect()  # 63 rows at most
    room, least = settings.hot_words, None
    for r in by_size:
        if r.n > room:
            break
        room, least = room - r.n, 1 << r.e
    hot = words.where(F.col("c") >= (least or 1 << 62)).toArrow()  # hot_words rows at most
    w, c = (hot.column(x).to_numpy() for x in ("w", "c"))
    order = np.argsort(w)
    w, c, all_hot = w[order], c[order], len(w) == distinct
    grams, share, rest = build_filter(learned, text_col, int(n_words), settings)
    rest = rest if share < 1 else None
    beyond, parts = rest is not None, len(grams.bounds)
    shared = spark.sparkContext.broadcast((w, c, grams))
    floor = 0.1
    base = max(n_words + floor * (distinct + 1), floor)
    levels = settings.base ** np.arange(64)  # the count that a level stands for: the middle of its range
    levels = np.concatenate([[0.0], (levels[:-1] + levels[1:] - 1) / 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c, grams = shared.value
        row = first = TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def looked_up() -> Iterator[pa.RecordBatch]:
            for p, fields in _probes(held, parts):
                values = {"_row": first, "part": p, "probe": fields}
                yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

        for part in vec.chunks(batches, "_text"):
            tokens, at = _tokens(part.column("_text"))
            signed = _signed(tokens)
            if len(w):
                i = np.minimum(np.searchsorted(w, signed), len(w) - 1)
                count, cold = np.where(w[i] == signed, c[i], 0), w[i] != signed
            else:
                count, cold = np.zeros(len(tokens), dtype=np.int64), np.ones(len(tokens), dtype=bool)
            begins = at[:-1]
            # The end token stands before each text, as behind it.
            ends = np.flatnonzero(w == END.view(np.int64))
            shifted = lambda x, first: np.concatenate([[first], x[:-1]])
            before, cold_before = shifted(count, c[ends[0]] if len(ends) else 0), shifted(cold, not len(ends))
            former = shifted(signed, END.view(np.int64))
            pairs = levels[grams.levels(_pairs(tokens))]
            seen = np.divide(share * np.minimum(pairs, before), before, out=np.zeros(len(tokens)), where=before > 0)
            known = np.log10((count + floor) / base)
            score = np.log10(seen + (1 - share) * (count + floor) / base) if share < 1 else known
            # Rare words' counts, and those of rare words before a pair that was found, come by joins; here such tokens are left out.
            cold_before &= (pairs > 0) & (not all_hot)
            cold &= not all_hot
            later = cold | cold_before
            add = lambda x: np.add.reduceat(np.where(later, 0, x), begins)
            out = [part.column("_key"), pa.array(np.diff(at), pa.int64()), pa.array(add(count > 0).astype(np.int64)), pa.array(add(known).astype(float)), pa.array(add(score).astype(float))]
            rare: list[list[dict]] = [[] for _ in begins]
            if later.any():
                where = np.flatnonzero(later)
                owner = np.searchsorted(at, where, side="right") - 1
                for d, t, u, k, j in zip(owner.tolist(), signed[where].tolist(), former[where].tolist(), pairs[where].tolist(), where.tolist(), strict=True):
                    rare[d].append({"w": t, "cw": None if cold[j] else int(count[j]), "u": u, "cu": None if cold_before[j] else int(before[j]), "k": k})
            kind = pa.list_(pa.struct([("w", pa.int64()), ("cw", pa.int64()), ("u", pa.int64()), ("cu", pa.int64()), ("k", pa.float64())]))
            none = [pa.nulls(len(begins), pa.int32()), pa.nulls(len(begins), pa.list_(pa.binary()))]
            made = pa.RecordBatch.from_arrays([*out, pa.array(rare, kind), pa.array(row + np.arange(len(begins))), *none], names=["_key", "n_tokens", "n_known", "base_score", "score", "rare", "_row", "part", "probe"])
            schema = made.schema
            yield made
            if beyond:
                missed = np.flatnonzero(pairs == 0)
                place = (row - first + np.searchsorted(at, missed, side="right") - 1).astype(np.uint32)
                no_count = shifted(w[i] != signed if len(w) else np.ones(len(tokens), dtype=bool), not len(ends)) & (not all_hot)
                held.append((_pairs(tokens)[missed], place, np.where(cold, -1, count)[missed], np.where(no_count, -1, before)[missed], signed[missed], former[missed]))
                size += len(missed)
            row += len(begins)
            if size > FLUSH:
                yield from looked_up()
                held, size, first = [], 0, row
        if held:
            yield from looked_up()

    def look_up(probes: pa.Table, pairs: pa.Table) -> pa.Table:
        """What found pairs add to rows' scores, and tokens with found pairs of which a count isn't known."""
        out: list[list[np.ndarray]] = []
        keys, counts = (np.frombuffer(b"".join(pairs.column(x).to_pylist()), dtype=t) for x, t in (("pairs", np.uint64), ("counts", np.int64)))
        for first, fields in zip(*(probes.column(x).to_pylist() for x in ("_row", "probe")), strict=True) if len(keys) else ():
            gaps, row, cw, cu, w, u = map(_whole, fields, _PROBE)
            probed, cw, cu, row = np.cumsum(gaps, dtype=np.uint64), cw - 1, cu - 1, first + row.astype(np.int64)
            i = np.minimum(np.searchsorted(keys, probed), len(keys) - 1)
            hit, cold = keys[i] == probed, (cw < 0) | (cu < 0)
            k = np.where(hit, levels[level_of(counts[i], settings.base)], 0.0)
            f = hit & ~cold & (cu > 0)
            p = (cw[f] + floor) / base
            more = np.log10(share * np.minimum(k[f], cu[f]) / cu[f] + (1 - share) * p) - np.log10((1 - share) * p)
            rows, to = np.unique(row[f], return_inverse=True)
            zero = np.zeros(len(rows), dtype=np.int64)
            out.append([rows, np.bincount(to, more, minlength=len(rows)), zero, zero, zero, zero, zero.astype(float)])
            f, g = hit & cold, hit[cold]
            out.append([row[f], np.full(int(f.sum()), np.nan), w[g], cw[f], u[g], cu[f], k[f]])
        names, kinds = ("_row", "x", "w", "cw", "u", "cu", "k"), (np.int64, float, *[np.int64] * 4, float)
        return pa.table({n: np.concatenate([np.zeros(0, dtype=t), *(o[j] for o in out)]) for j, (n, t) in enumerate(zip(names, kinds, strict=True))})

    kind = docs.schema[key_col].dataType.simpleString()
    scored = docs.select(F.col(key_col).alias("_key"), F.col(text_col).alias("_text")).mapInArrow(run, f"_key {kind}, n_tokens long, n_known long, base_score double, score double, rare array<struct<w:bigint,cw:bigint,u:bigint,cu:bigint,k:double>>, _row long, part int, probe array<binary>")
    if beyond or not all_hot:
        scored = written(scored, "scored")
        rare = scored.select("_row", F.explode("rare").alias("r")).select("_row", "r.*", F.lit(False).alias("again"))
        if beyond:
            probes = scored.where("part IS NOT NULL").select("part", "_row", "probe").groupBy("part")
            found = written(probes.cogroup(rest.groupBy("part")).applyInArrow(look_up, "_row long, x double, w long, cw long, u long, cu long, k double"), "found")
            count = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
            rare = rare.unionByName(found.where("isnan(x)").select("_row", "w", count("cw"), "u", count("cu"), "k", F.lit(True).alias("again")))
            scored = scored.where("part IS NULL")
        for word, n in (("w", "cw"), ("u", "cu")):
            # Counts that are known need no join: such rows are spread by keys that no count answers to.
            key = F.when(F.col(n).isNull(), F.col(word)).otherwise(F.xxhash64("_row", "w", "u"))
            known = words.select(F.col("w").alias("_w"), F.col("c").alias("_c"))
            rare = rare.withColumn("_key", key).join(known, F.col("_key") == F.col("_w"), "left").withColumn(n, F.coalesce(n, "_c", F.lit(0))).drop("_key", "_w", "_c")
        p = (F.col("cw") + floor) / base
        seen = F.when(F.col("cu") > 0, share * F.least("k", F.col("cu").cast("double")) / F.col("cu")).otherwise(0.0)
        score = F.log10(seen + (1 - share) * p) if share < 1 else F.log10(p)
        # Tokens found by range have been counted as words before: what their pairs add is left.
        new = ~F.col("again")
        parts_of = rare.select("_row", (new & (F.col("cw") > 0)).cast("long").alias("k"), F.when(new, F.log10(p)).otherwise(0.0).alias("b"), (F.when(new, score).otherwise(score - F.log10((1 - share) * p)) if share < 1 else score).alias("x"))
        if beyond:
            parts_of = parts_of.unionByName(found.where("NOT isnan(x)").select("_row", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("b"), "x"))
        sums = parts_of.groupBy("_row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("x").alias("x"))
        scored = scored.join(sums, "_row", "left").select("_key", "n_tokens", *[(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_known", "k"), ("base_score", "b"), ("score", "x"))])
    return scored.select(F.col("_key").alias(key_col), "n_tokens", "n_known", F.lit(int(n_words)).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of nine tenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scored = score_texts(docs, ~held_out, "doc_id")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
SQL: dict[str, str] = {}
