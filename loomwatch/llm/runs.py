"""Periodic runs of words, by divide and conquer over word ids (after Main and Lorentz).

A run is a stretch of consecutive words with smallest period q and at least max(``least``, ``times`` * q)
words that no neighbouring word extends with that period. ``times`` is 3 at least.

Each text is halved again and again; a run is found at the first midpoint that it crosses. It has q + 1
words or more on one side of that midpoint, so the two words around the midpoint recur q words before or
behind. At such distances p the two Z-values of the midpoint are taken: how far the words behind agree
with those p away, and how far the words before do. Together they give the run's whole extent.
All midpoints of a level, of all texts of a chunk, are handled side by side in numpy; a Z-value is the
eight next words compared, and beyond these a search over prefix hashes. Of the distances at a midpoint,
the nearest one on each side is taken first: where it gives a run, its multiples inside that run would
give the same one and are left out. Intervals that several midpoints or distances gave are kept once,
with the smallest period (all others are its multiples, as the interval is three periods long). In the
end each run's words are compared one by one; should a hash have lied, the chunk's Z-values are taken
word by word instead. So results are exact, and the work grows as n log n.

Words are interned by chunk: equal hashes are compared by their bytes.

Cases: null or empty texts, or ones of white space, have no words and no runs, and collapse to an empty
text; repeated rows are handled each for itself; other columns pass through, those named as a new column
are replaced. A text of any length needs some hundred bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwatch.llm import vec
from loomwatch.llm.shared import map_arrow

#: Words of a run at least, and periods.
LEAST, TIMES = 24, 3
#: Texts of an Arrow batch that are handled together have about so many bytes.
CHUNK = 1 << 21
#: Words that are compared one by one before hashes are used; a run's words agree over twice as many at least.
NEAR = 8
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def intern_words(words: vec.Words) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for equal words only, and by number which word has it first."""
    if not len(words.hash):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, one, same = np.unique(words.hash, return_index=True, return_inverse=True)
    first, size = words.start[one[same]], words.end - words.start
    if ((words.end - words.start)[one[same]] == size).all():
        step = 1 << 16
        for a in range(0, len(size), step):
            n = size[a : a + step]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if (words.raw[np.repeat(first[a : a + step], n) + place] != words.raw[np.repeat(words.start[a : a + step], n) + place]).any():
                break
        else:
            return same.astype(np.int64), one
    known: dict[bytes, int] = {}  # two words of one hash
    data = words.raw.tobytes()
    ids = np.array([known.setdefault(data[s:e], len(known)) for s, e in zip(words.start.tolist(), words.end.tolist(), strict=True)], dtype=np.int64)
    return ids, np.unique(ids, return_index=True)[1]


class Runs:
    """Finds the runs of several texts; ``ids`` are their words in a row, ``at`` says where each text begins and the last ends."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES):
        if times < 3 or least * (times - 1) < 2 * NEAR * times:
            raise ValueError("a run has three periods at least, and words enough to agree with themselves over 16")
        self.least, self.times = least, times
        n, texts = np.diff(at), len(at) - 1
        # A number of its own stands before each text and behind the last one, so nothing agrees across.
        self.first = at[:-1] + np.arange(texts) + 1
        self.ids = np.full(len(ids) + texts + 1, -1, dtype=np.int64)
        self.ids[np.append(self.first - 1, len(self.ids) - 1)] = -1 - np.arange(texts + 1)
        self.ids[np.arange(len(ids)) + np.repeat(np.arange(texts) + 1, n)] = ids
        self.n, self.sums = n, None

    def _hashes(self) -> None:
        power, self.inverse = vec._powers(1 << max(16, len(self.ids).bit_length()))
        self.sums = np.zeros(len(self.ids) + 1, dtype=np.uint64)
        np.cumsum(vec.mix(self.ids.astype(np.uint64)) * power[: len(self.ids)], out=self.sums[1:])

    def _agree(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        """For how many words the text from x on agrees with that from y > x on, or that before x with that before y."""
        if self.sums is None:
            self._hashes()
        room = x if back else len(self.ids) - y
        out, step = np.zeros(len(x), dtype=np.int64), 1 << int(room.max()).bit_length()
        while step := step >> 1:
            a, b = (x - out - step, y - out - step) if back else (x + out, y + out)
            go = np.flatnonzero(out + step <= room)
            a, b = a[go], b[go]
            same = (self.sums[a + step] - self.sums[a]) * self.inverse[a] == (self.sums[b + step] - self.sums[b]) * self.inverse[b]
            out[go[same]] += step
        return out

    def _agree_plainly(self, x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
        out, go = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(go):
            k = out[go]
            a, b = (x[go] - 1 - k, y[go] - 1 - k) if back else (x[go] + k, y[go] + k)
            go = go[self.ids[a] == self.ids[b]]  # the numbers between texts are met before the ends
            out[go] += 1
        return out

    def _extents(self, x: np.ndarray, y: np.ndarray, plainly: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Around which pairs x < y a run of period y - x extends, and (start, end, period) of these runs."""
        ahead, behind = np.arange(NEAR), -1 - np.arange(NEAR)
        ends = lambda i, by: np.clip(i[:, None] + by, 0, len(self.ids) - 1)  # noqa: E731  at an end there is a number of its own
        near = lambda by: (self.ids[ends(x, by)] == self.ids[ends(y, by)]).all(axis=1)
        which = np.flatnonzero(near(ahead) | near(behind))
        x, y = x[which], y[which]
        if not len(x):
            return which, (x, x, x)
        agree = self._agree_plainly if plainly else self._agree
        start, end, period = x - agree(x, y, True), y + agree(x, y, False), y - x
        go = end - start >= np.maximum(self.least, self.times * period)
        return which[go], (start[go], end[go], period[go])

    def _level(self, l: np.ndarray, m: np.ndarray, r: np.ndarray, plainly: bool) -> list[tuple[np.ndarray, ...]]:  # noqa: E741
        """The runs across the midpoints m of the segments [l, r)."""
        reach = (r - l) // self.times
        low, high = np.maximum(l, m - 1 - reach), np.minimum(r - 1, m + reach)  # where the two words may recur
        n = high - low
        to = np.cumsum(n)
        if not len(to) or not to[-1]:
            return []
        place = np.repeat(low - (to - n), n) + np.arange(to[-1])
        there = np.flatnonzero((self.ids[place] == np.repeat(self.ids[m - 1], n)) & (self.ids[place + 1] == np.repeat(self.ids[m], n)))
        place, seg = place[there], np.searchsorted(to, there, side="right")
        mid = m[seg] - 1
        apart = np.flatnonzero(place != mid)
        place, seg, mid = place[apart], seg[apart], mid[apart]
        x, y = np.minimum(place, mid), np.maximum(place, mid)
        # The nearest one of each side, then those that are no multiples inside its run.
        before = place < mid
        last = np.append((seg[1:] != seg[:-1]) | ~before[1:], True)[: len(seg)]
        first = np.append(True, (seg[1:] != seg[:-1]) | before[:-1])[: len(seg)]
        nearest = (before & last) | (~before & first)
        found, rest = [], ~nearest
        for side in (before, ~before):
            at = np.flatnonzero(nearest & side)
            which, some = self._extents(x[at], y[at], plainly)
            found.append(some)
            s, e, p = (np.full(len(m), v) for v in (0, -1, 1))
            of = seg[at[which]]
            s[of], e[of], p[of] = some
            rest &= ~((x >= s[seg]) & (y + 1 < e[seg]) & ((y - x) % p[seg] == 0))
        at = np.flatnonzero(rest)
        if len(at):
            found.append(self._extents(x[at], y[at], plainly)[1])
        return found

    def find(self, plainly: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, length, period) of all runs, by text, start and period."""
        l, r, found = self.first, self.first + self.n, [(np.zeros(0, dtype=np.int64),) * 3]  # noqa: E741
        while True:
            go = r - l >= self.least
            l, r = l[go], r[go]  # noqa: E741
            if not len(l):
                break
            m = (l + r) // 2
            found += self._level(l, m, r, plainly)
            l, r = np.stack([l, m], 1).reshape(-1), np.stack([m, r], 1).reshape(-1)  # noqa: E741
        start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        start, end, period = start[order], end[order], period[order]
        if not plainly and not all((self.ids[s : e - p] == self.ids[s + p : e]).all() and self.ids[s - 1] != self.ids[s - 1 + p] and self.ids[e] != self.ids[e - p] for s, e, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True)):
            return self.find(plainly=True)
        text = np.searchsorted(self.first, start, side="right") - 1
        return text, start - self.first[text], end - start, period


def _joined(words: vec.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    raw, step = np.append(words.raw, np.uint8(32)), 1 << 16
    kept = np.flatnonzero(keep)
    start, size = words.start[kept], (words.end - words.start)[kept] + 1
    parts = []
    for a in range(0, len(kept), step):
        n = size[a : a + step]
        to = np.cumsum(n)
        part = raw[np.repeat(start[a : a + step] - (to - n), n) + np.arange(to[-1])]
        part[to - 1] = 32
        parts.append(part)
    sums = np.append(0, np.cumsum(size))
    ends = sums[np.searchsorted(kept, words.at)]  # with a space behind each text that has a word
    data = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
    some = np.diff(ends) > 0
    stay = np.ones(len(data), dtype=bool)
    stay[ends[1:][some] - 1] = False
    cuts = np.append(0, np.cumsum(np.diff(ends) - some)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data[stay])).cast(pa.string())


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES, collapsed_col: str | None = "collapsed") -> DataFrame:
    """docs with ``n_words``, ``runs`` (by start, then period; start and length in words) and, where it has a name, the text whose runs
    are cut to one period each, words joined by one space."""
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN))]
    new += [T.StructField(collapsed_col, T.StringType())] if collapsed_col else []
    old = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c not in {f.name for f in new}])
    out = T.StructType([*old.schema, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vec.chunks(batches, text_col, CHUNK):
            words = vec.Words(*vec.text_bytes(part.column(text_col)), lower=False)
            text, start, length, period = Runs(intern_words(words)[0], words.at, least, times).find()
            cuts = np.append(0, np.cumsum(np.bincount(text, minlength=words.n))).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
            added = [pa.array(words.count.astype(np.int64)), runs]
            if collapsed_col:
                change = np.zeros(len(words.hash) + 1, dtype=np.int64)  # at which words so many runs begin or end to drop words
                np.add.at(change, words.at[text] + start + period, 1)
                np.add.at(change, words.at[text] + start + length, -1)
                added.append(_joined(words, np.cumsum(change)[:-1] == 0))
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[f.name for f in out])

    return map_arrow(old, run, out)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents; every tenth one by its id's checksum is made to repeat a part of it first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, split))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    docs = docs.withColumn("a", F.when(n > 0, g % n).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    found = periodic_runs(docs.select("doc_id", F.when(n > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text")))
    ratio = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  the sign says whose exponent is greater
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, x: F.when(ratio(x, b) > 0, x).otherwise(b))
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL: dict[str, str] = {}
