"""Benchmark decontamination with a generalised suffix automaton over benchmark words.

The automaton holds every word run of every benchmark item. A document's words are
streamed through it; after each word it knows the longest run that ends there and occurs
in some item. Runs of at least ``window`` words are hits (an item with fewer words is one
window by itself). Words that occur in no item reset the automaton, so numpy first finds
the stretches of benchmark words that are long enough, and only those are streamed, all
stretches of a chunk side by side. Words are looked up by a 64-bit hash, and their bytes are
compared before they count as known.

The benchmark is cut into blocks of about ``max_words`` words; long items are cut into pieces
that overlap by ``window - 1`` words, so each window is in a piece. Tasks build the blocks'
automata and write them to the shared folder. A block's automaton, of bounded size, is then
broadcast; with more than one block, each block is a pass of its own over the documents, and
the spans are merged by text, so a worker holds one block at a time.

Cases: a null text, in documents or items, has no words; documents without words have
zero counts; repeated item rows and repeated windows count once per item id; items without
an id are one item with an empty name; repeated document ids are told apart by their texts,
and each row is judged for itself; an empty benchmark hits nothing. Other columns aren't read
by ``contamination_report`` and are passed through by ``remove_contamination``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm import vec
from loomwatch.llm.shared import map_arrow, remove, written

WINDOW = 13
#: Words of benchmark text in one automaton: as arrays about 60 bytes each, and some 500 while it is built.
MAX_WORDS = 200_000
#: Words of an item that stay together.
PIECE = 10_000


class _Growing:
    """A suffix automaton of several word sequences while it is built; words are numbers."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, word: int) -> int:
        """The state of the sequence so far with one more word."""
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.step[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, at: int, word: int, to: int) -> int:
        """A state for the shorter runs of ``to``, those that ``at`` leads to."""
        half = self._state(dict(self.step[to]), self.link[to], self.length[at] + 1)
        self.link[to] = half
        while at >= 0 and self.step[at].get(word) == to:
            self.step[at][word] = half
            at = self.link[at]
        return half


@dataclass
class Automaton:
    """A finished suffix automaton as arrays, and which windows of which items its states are."""

    window: int = WINDOW
    #: Sorted hashes of all words, and their bytes one behind the other.
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    letters: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint8))
    #: Sorted (state, word) as one number, and the state that it leads to.
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    to: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    link: np.ndarray = field(default_factory=lambda: np.full(1, -1, dtype=np.int32))
    length: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int32))
    #: The nearest state with windows, going up the links, and the shortest window of it and those above.
    marked: np.ndarray = field(default_factory=lambda: np.full(1, -1, dtype=np.int32))
    least: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int32))
    #: By state: (words of the window, its items).
    windows: dict[int, list[tuple[int, list[str]]]] = field(default_factory=dict)
    shortest: int = 0

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int) -> Automaton:
        """items: (item id, words in lower case)."""
        out = cls(window)
        items = [x for x in items if x[1]]
        if not items:
            return out
        names = sorted({w for _, words in items for w in words})
        found = vec.Words(*vec.text_bytes(pa.array(names, pa.binary()).cast(pa.string())), separators=vec.NOT_ALNUM)
        order = np.argsort(found.hash)
        names = [names[i] for i in order]
        out.vocabulary = found.hash[order]
        out.letters = np.frombuffer(b"".join(names), dtype=np.uint8)
        out.begin = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        code = {w: i for i, w in enumerate(names)}
        grown, marks = _Growing(), {}
        coded = [(item, [code[w] for w in words]) for item, words in items]
        for _, words in coded:
            last = 0
            for w in words:
                last = grown.extend(last, w)
        for item, words in coded:
            size = min(len(words), window)
            state, n = 0, 0
            for w in words:  # the state of the last ``size`` words, at each of them
                state, n = grown.step[state][w], n + 1
                while n > size and grown.length[grown.link[state]] >= size:
                    state = grown.link[state]
                    n = grown.length[state]
                if n >= size:
                    marks.setdefault(state, {}).setdefault(size, set()).add(item)
        out.shortest = min(min(len(w), window) for _, w in coded)
        n, v = len(grown.step), len(names)
        keys = np.array([s * v + w for s, step in enumerate(grown.step) for w in step], dtype=np.int64)
        to = np.array([t for step in grown.step for t in step.values()], dtype=np.int32)
        at = np.argsort(keys)
        out.steps, out.to = keys[at], to[at]
        out.link, out.length = np.array(grown.link, dtype=np.int32), np.array(grown.length, dtype=np.int32)
        out.windows = {s: sorted((size, sorted(i)) for size, i in by.items()) for s, by in marks.items()}
        out.marked, out.least = np.full(n, -1, dtype=np.int32), np.full(n, np.iinfo(np.int32).max, dtype=np.int32)
        for s in np.argsort(out.length, kind="stable").tolist():
            up = grown.link[s]
            if up >= 0:
                out.marked[s], out.least[s] = out.marked[up], out.least[up]
            if s in out.windows:
                out.marked[s], out.least[s] = s, min(out.least[s], out.windows[s][0][0])
        return out

    def known(self, words: vec.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word of the vocabulary, whether it is that word) of each word."""
        if not len(self.vocabulary) or not len(words.hash):
            return np.zeros(len(words.hash), dtype=np.int64), np.zeros(len(words.hash), dtype=bool)
        codes = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        return codes, self.vocabulary[codes] == words.hash

    def same_bytes(self, words: vec.Words, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether the words at these places are, byte by byte, those of the vocabulary."""
        begin, size = self.begin[codes], self.begin[codes + 1] - self.begin[codes]
        same = words.end[at] - words.start[at] == size
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        mine = np.repeat(words.start[at], size) + step
        wrong = vec.LOWER[words.raw[np.minimum(mine, len(words.raw) - 1)]] != self.letters[np.repeat(begin, size) + step]
        return same & (np.bincount(np.repeat(np.arange(len(at)), size), weights=wrong, minlength=len(at)) == 0)

    def walk(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, state, words matched) of all words of the stretches [start, end) at which a window ends; all stretches at once."""
        order = np.argsort(start - end, kind="stable")
        start, size = start[order], (end - start)[order]
        state, n = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        found = []
        for k in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -k))  # stretches longer than k come first
            word = codes[start[:m] + k]
            todo = np.arange(m)
            while len(todo):
                key = state[todo] * len(self.vocabulary) + word[todo]
                at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
                there = self.steps[at] == key
                state[todo[there]] = self.to[at[there]]
                n[todo[there]] += 1
                todo = todo[~there & (state[todo] > 0)]  # the first state steps by all words of the vocabulary
                state[todo] = self.link[state[todo]]
                n[todo] = self.length[state[todo]]
            hit = np.flatnonzero(n[:m] >= self.least[state[:m]])
            if len(hit):
                found.append((start[hit] + k, state[hit], n[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3

    def windows_at(self, state: int, n: int) -> Iterator[tuple[int, list[str]]]:
        """(words, items) of all windows that end where a run of n words led to this state."""
        s = int(self.marked[state])
        while s >= 0:
            for size, items in self.windows[s]:
                if n >= size:
                    yield size, items
            s = int(self.marked[self.link[s]]) if self.link[s] >= 0 else -1


def find_hits(texts: pa.Array, auto: Automaton) -> tuple[vec.Words, np.ndarray, dict[int, set[str]]]:
    """The words of the texts, which of them are hit, and by text the items found in it."""
    words = vec.Words(*vec.text_bytes(texts), separators=vec.NOT_ALNUM)
    hit, items = np.zeros(len(words.hash), dtype=bool), {}
    codes, known = auto.known(words)
    start, end = _stretches(known, words.at, auto.shortest)
    if len(start):
        at = np.repeat(start - np.cumsum(end - start) + (end - start), end - start) + np.arange(int((end - start).sum()))
        known[at] = auto.same_bytes(words, at, codes[at])
        start, end = _stretches(known, words.at, auto.shortest)
    place, state, n = auto.walk(codes, start, end)
    for p, s, k in zip(place.tolist(), state.tolist(), n.tolist(), strict=True):
        for size, found in auto.windows_at(s, k):
            hit[p + 1 - size : p + 1] = True
            items.setdefault(int(words.doc[p]), set()).update(found)
    return words, hit, items


def _stretches(known: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of all runs of at least ``least`` known words that no text's beginning (at) cuts."""
    if not known.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.ones(len(known) + 1, dtype=bool)
    edge[1:-1] = known[1:] != known[:-1]
    edge[at[:-1]] = True
    cut = np.flatnonzero(edge)
    keep = (np.diff(cut) >= max(1, least)) & known[cut[:-1]]
    return cut[:-1][keep], cut[1:][keep]


def _spans(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """(block, data): a table with the automaton of each block of the benchmark, built in tasks."""
    spark = benchmark.sparkSession
    if window > PIECE:
        raise ValueError(f"a window has at most {PIECE} words")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vec.chunks(batches, "_text"):
            words = vec.Words(*vec.text_bytes(part.column("_text")), separators=vec.NOT_ALNUM)
            raw = vec.LOWER[words.raw].tobytes()
            rows = [
                (item, no, [raw[words.start[k] : words.end[k]] for k in range(at, min(at + PIECE, b))])
                for item, a, b in zip(part.column("_item").to_pylist(), words.at, words.at[1:], strict=False)
                for no, at in enumerate(range(a, max(a + 1, b - window + 1), PIECE - window + 1))
                if b > a
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.binary())))], names=["item", "no", "words"])

    pieces = written(items.mapInArrow(cut, "item string, no int, words array<binary>").distinct(), "pieces")
    size = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-size // max_words))

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = Automaton.build(list(zip(rows["item"].to_pylist(), rows["words"].to_pylist(), strict=True)), window)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(found)], pa.binary())})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "no"), F.lit(blocks)).cast("int"))
    out = written(dealt.groupBy("block").applyInArrow(build, "block int, data binary"), "automata")
    remove(pieces)
    return out if size else spark.createDataFrame([(0, pickle.dumps(Automaton(window)))], "block int, data binary")


def _shared(blocks: DataFrame) -> list[Broadcast[bytes]]:
    """The automata one by one; the driver holds one of them at a time."""
    sc = blocks.sparkSession.sparkContext
    return [sc.broadcast(blocks.where(F.col("block") == r.block).first().data) for r in blocks.select("block").collect()]


def _loaded(shared: Broadcast[bytes]) -> Automaton:
    return pickle.loads(shared.value)  # noqa: S301  (made by ``automata``)


SPANS = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"


def hit_spans(docs: DataFrame, key_col: str, text_col: str, blocks: DataFrame) -> DataFrame:
    """A row for each document: n_words, spans of hit words (first, end), items that occur."""
    kind = docs.schema[key_col].dataType.simpleString()

    def scanner(shared: Broadcast[bytes]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _loaded(shared)
            for part in vec.chunks(batches, "_text"):
                words, hit, items = find_hits(part.column("_text"), auto)
                spans = [[{"first": s, "end": e} for s, e in _spans(hit[a:b])] if i in items else [] for i, (a, b) in enumerate(zip(words.at, words.at[1:], strict=False))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_key"),
                        pa.array(words.count, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(items.get(i, ())) for i in range(words.n)], pa.list_(pa.string())),
                    ],
                    names=["_key", "n_words", "spans", "items"],
                )

        return run

    source = docs.selectExpr(f"`{key_col}` AS _key", f"`{text_col}` AS _text")
    parts = [source.mapInArrow(scanner(b), f"_key {kind}, {SPANS}") for b in _shared(blocks)]
    if len(parts) == 1:
        return parts[0].withColumnRenamed("_key", key_col)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ordered = F.array_sort(F.flatten(F.collect_list("spans")))
    # Spans of different blocks may overlap: add each to the last one if they touch.
    merged = F.aggregate(
        ordered,
        F.array().cast("array<struct<first:long,end:long>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["first"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return out.groupBy("_key").agg(F.max("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumnRenamed("_key", key_col)


def _digest(text_col: str):
    """What tells texts apart; null has none."""
    return F.sha2(F.col(f"`{text_col}`").cast("binary"), 256)


def _spans_of_texts(docs: DataFrame, text_col: str, blocks: DataFrame) -> DataFrame:
    """(_digest, n_words, spans, items) of each distinct text, over all blocks."""
    texts = docs.select(_digest(text_col).alias("_digest"), F.col(f"`{text_col}`").alias("_t")).where("_t IS NOT NULL").dropDuplicates(["_digest"])
    return hit_spans(texts, "_digest", "_t", blocks)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, max_words: int = MAX_WORDS, coverage: int = 20) -> DataFrame:
    """A row for each document: counts, hit spans, items, and whether at least one word in ``coverage`` is hit."""
    blocks = automata(benchmark, item_col, window=window, max_words=max_words)
    if blocks.count() == 1:
        found = hit_spans(docs, id_col, text_col, blocks)
    else:
        rows = docs.select(F.col(id_col), _digest(text_col).alias("_digest")).join(_spans_of_texts(docs, text_col, blocks), "_digest", "left")
        empty = {c: F.array().cast(docs.sparkSession.createDataFrame([], SPANS).schema[c].dataType) for c in ("spans", "items")}
        found = rows.select(id_col, F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), *[F.coalesce(c, e).alias(c) for c, e in empty.items()])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words")))
    )


def cut_text(texts: pa.Array, words: vec.Words, hit: np.ndarray, coverage: int) -> tuple[list[str | None], list[bool]]:
    """Each text without its hit words, and whether it stays (its coverage is below the limit)."""
    out, stays = texts.to_pylist(), []
    for i, (a, b) in enumerate(zip(words.at, words.at[1:], strict=False)):
        n = int(hit[a:b].sum())
        stays.append(not (n > 0 and coverage * n >= b - a))
        if n and stays[-1]:
            raw, base = out[i].encode(), int(words.offsets[i])
            keep, at = [], 0
            for s, e in _spans(hit[a:b]):
                keep.append(raw[at : int(words.start[a + s]) - base])
                at = int(words.end[a + e - 1]) - base
            out[i] = b"".join([*keep, raw[at:]]).decode()
    return out, stays


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, max_words: int = MAX_WORDS, coverage: int = 20) -> DataFrame:
    """Drops documents over the coverage limit and cuts the hit spans (``window`` words or more) from the others."""
    blocks = automata(benchmark, item_col, window=window, max_words=max_words)
    if blocks.count() == 1:
        shared = _shared(blocks)[0]
        rows = docs
    else:  # the spans of all blocks, joined by text
        shared = None
        held = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row")
        rows = docs.select(held, F.col(f"`{text_col}`").alias("_t"), _digest(text_col).alias("_digest")).join(_spans_of_texts(docs, text_col, blocks).select("_digest", "spans"), "_digest", "left")
        rows = rows.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("spans").alias("_spans"))
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _loaded(shared) if shared is not None else None
        for part in vec.chunks(batches, text_col):
            column = part.column(text_col)
            if auto is not None:
                words, hit, _ = find_hits(column, auto)
            else:
                words = vec.Words(*vec.text_bytes(column), separators=vec.NOT_ALNUM)
                hit = np.zeros(len(words.hash), dtype=bool)
                for i, spans in enumerate(part.column(n).to_pylist()):
                    for s in spans or ():
                        hit[words.at[i] + s["first"] : words.at[i] + s["end"]] = True
            texts, stays = cut_text(column, words, hit, coverage)
            k = part.schema.get_field_index(text_col)
            done = part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type)).filter(pa.array(stays))
            yield pa.RecordBatch.from_arrays(done.columns[:n], schema=pa.schema(list(done.schema)[:n]))

    return map_arrow(rows, run, docs.schema)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items."""
    report = contamination_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts benchmark passages from the others."""
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
SQL = {
    "op5_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sizes AS (SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k
), hits AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
}
