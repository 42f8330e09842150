"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal n-gram sets are one row of the matrix (a class). The product A x A' is
never formed in full:

1.  Columns (n-grams) are ordered from rare to frequent by counts over all documents, kept in
    a fixed table of ``BUCKETS`` counters. Two sets with Jaccard similarity t must share a
    column among the first n - ceil(t n) + 1 of each, so only those entries are shuffled.
2.  Columns of one row give no pair; of columns with the same rows one stands for all. In each
    column the first ``HUBS`` rows, in one order for all columns, are hubs. A block of rows is
    multiplied with the hub that it meets in most columns; links found join rows to partial
    components. In columns that are still in parts, one row of each part meets each hub of
    the other parts.
    That is linear in the entries, also for huge groups of copies.
3.  What may be missing are links between rows of one column that are in different
    components. Those columns are multiplied block by block.
4.  A bound from sizes and a histogram of each row (256 buckets in blocks of columns, then a
    bucket for two to four n-grams) discards pairs before any exact product. Exact products sum overlap counts over a hub's columns and compare by integers.

Columns that are frequent in the counters are dealt out by a salt; salted parts are joined
by their hubs and, in step 3, by all pairs of parts. N-grams and classes are 64-bit hashes.

Cases: null or empty texts have an empty set, are linked with nothing and are their own
component; a text of fewer than k words is one n-gram; repeated ids share a component; other
columns aren't read, or are passed through by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm import vec
from loomwatch.operators.components import components
from loomwatch.llm.shared import remove, written

BUCKETS = 1 << 16
#: Buckets of a coarse histogram.
HIST = 256
#: Entries of one column that one task may get before the column is salted.
COLUMN_ROWS = 20_000
BLOCK = 512
#: Rows of a column that all its rows are multiplied with.
HUBS = 32
#: Rows (of 16 bytes) of a table that may be broadcast; larger ones are joined by a shuffle.
FEW = 1_000_000
#: Rows that one task multiplies with one hub, and column entries with one first hub that it multiplies.
HUB_ROWS, HUB_ENTRIES = 256, 4096
SEEN = 200_000
#: Histogram buckets that are compared at once; a histogram has no more.
CELLS = 1 << 22


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    words = vec.Words(*vec.text_bytes(texts))
    for a, b in zip(words.at, words.at[1:], strict=False):
        yield vec.shingle_set(words.hash[a:b], k)


def _class(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _hist(grams: np.ndarray, bits: int) -> bytes:
    """How many n-grams fall into each bucket, by their upper bits; 255 is 255 or more."""
    return np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).clip(0, 255).astype(np.uint8).tobytes()


def _folded(hists: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Histograms with neighbouring buckets summed to ``size`` of them, and which have a full bucket."""
    rows = [np.frombuffer(h, dtype=np.uint8) for h in hists]
    sums = np.stack([r if len(r) == size else r.reshape(size, -1).sum(axis=1, dtype=np.uint16) for r in rows]).astype(np.uint16)
    return sums, np.array([bool((r == 255).any()) for r in rows])


def _counts(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How many documents' n-grams fall into each of BUCKETS counters (over all documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for part in vec.chunks(batches, "_text"):
            for grams in _sets(part.column("_text"), k):
                total += np.bincount((grams & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) if len(grams) > 4096 else 0
                if 0 < len(grams) <= 4096:
                    np.add.at(total, (grams & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(id, n, cls, hist, fine, prefix, salts) of each document. prefix: the columns by which it can meet others, once a task for each class."""
    spark = docs.sparkSession
    order = np.argsort(counts, kind="stable")
    rank = np.empty(BUCKETS, dtype=np.uint64)
    rank[order] = np.arange(BUCKETS, dtype=np.uint64)
    # A column can't have more rows than its counter; far above the mean, it probably is frequent.
    usual = counts.mean() + 6 * np.sqrt(counts.mean() + 1)
    parts = np.where(counts > usual + COLUMN_ROWS, -(-counts // COLUMN_ROWS), 1).clip(1, 30_000).astype(np.int16)
    shared = spark.sparkContext.broadcast((rank, parts))  # BUCKETS entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, parts = shared.value
        low, seen = np.uint64(BUCKETS - 1), set()
        for part in vec.chunks(batches, "_text"):
            n, cls, hists, fine, prefixes, salts = [], [], [], [], [], []
            for grams in _sets(part.column("_text"), k):
                m = len(grams)
                n.append(m)
                if not m:
                    cls.append(None), hists.append(None), fine.append(None), prefixes.append(None), salts.append(None)
                    continue
                c = _class(grams)
                cls.append(c)
                if c in seen:
                    hists.append(None), fine.append(None), prefixes.append(None), salts.append(None)
                    continue
                seen.add(c)
                hists.append(_hist(grams, 8))
                fine.append(_hist(grams, min((m // 4).bit_length(), 22)) if m // 4 > HIST else None)
                bucket = (grams & low).astype(np.int64)
                keys = (rank[bucket] << np.uint64(48)) | (grams >> np.uint64(16))
                size = m - -(-percent * m // 100) + 1
                at = np.argpartition(keys, size - 1)[:size] if size < m else np.arange(m)
                prefixes.append(keys[at].view(np.int64))
                salts.append(parts[bucket[at]])
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(hists, pa.binary()), pa.array(fine, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(salts, pa.list_(pa.int16()))],
                names=["_id", "n", "cls", "hist", "fine", "prefix", "salts"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n long, cls long, hist binary, fine binary, prefix array<bigint>, salts array<smallint>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by key, with the place of each first row of a key; a key's rows may go on in the next batch (place -1: goes on)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        new[0] = last != [c[0] for c in cols]
        last = [c[-1] for c in cols]
        yield batch, new


def _order(cls: Column | str) -> Column:
    """The order of hubs."""
    return F.xxhash64(cls).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b) of two columns; b comes first in the order of hubs."""
    s, t = (F.struct(_order(c).alias("k"), F.col(c).alias("cls")) for c in (x, y))
    return df.select(F.greatest(s, t)["cls"].alias("a"), F.least(s, t)["cls"].alias("b")).distinct()


def _of_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes in written pairs."""
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    return classes.join(F.broadcast(ids) if 2 * pairs.count() <= FEW else ids, "cls", "left_semi")


def _columns(entries: DataFrame) -> DataFrame:
    """Of columns (or salted parts of them) with two or more classes: a row (col, part, parts, n, cls) for each class, and one with the column's hubs, size and sum of hashes (cls null)."""
    schema = pa.schema([("col", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("n", pa.int64()), ("cls", pa.int64()), ("size", pa.int64()), ("sum", pa.int64()), ("hubs", pa.list_(pa.struct([("cls", pa.int64()), ("n", pa.int64())])))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a column's first row waits for a second one
        size = total = 0
        hubs: list[dict] = []
        out: list[tuple] = []

        def close() -> None:
            if held is None and size or held is not None and held[2] > 1:  # a part of a salted column may hold one row
                if held is not None:
                    out.append((*held, None, None, None))
                col, part, parts = last
                out.append((col, part, parts, None, None, size, total, hubs))

        last: tuple = ()
        for batch, new in _groups(batches, ["col", "part"]):
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("col", "part", "parts", "n", "cls", "k")]
            single = np.ones(batch.num_rows, dtype=bool)  # alone in its column, as far as this batch tells
            single[1:] &= new[1:]
            single[:-1] &= new[1:]
            single[0] &= new[0]
            single[-1] = False  # the next batch may go on
            single &= cols[2] == 1
            at = np.flatnonzero(~single)
            for first, col, part, parts, n, cls, k in zip(new[at].tolist(), *(c[at].tolist() for c in cols), strict=True):
                row = (col, part, parts, n, cls)
                if first:
                    close()
                    held, size, total, hubs, last, before = row, 1, k, [{"cls": cls, "n": n}], (col, part, parts), cls
                    continue
                if cls == before:  # the same class from another task
                    continue
                before = cls
                if held:
                    out.append((*held, None, None, None))
                    held = None
                out.append((*row, None, None, None))
                size, total = size + 1, (total + k) & 0x7FFFFFFFFFFFFFFF
                if size <= HUBS:
                    hubs.append({"cls": cls, "n": n})
            if len(out) > 20_000:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return entries.repartition("col", "part").withColumn("k", _order("cls")).sortWithinPartitions("col", "part", "k", "cls").mapInArrow(run, "col long, part int, parts int, n long, cls long, size long, sum long, hubs array<struct<cls:bigint,n:bigint>>")


def _most(a: np.ndarray, b: np.ndarray, full: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Upper bounds of overlaps, from histograms (full buckets say nothing) and sizes."""
    least = np.minimum(na, nb)
    return np.where(full, least, np.minimum(least, np.minimum(a, b).sum(axis=1, dtype=np.int64)))


def _may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Written pairs (a, b) whose histograms allow enough overlap; what is left has (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).to_pylist() for c in ("ha", "hb"))
                na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
                sizes, keep = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)]), np.zeros(len(a), dtype=bool)
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    for c in range(0, len(at), CELLS // size):
                        i = at[c : c + CELLS // size]
                        (x, fx), (y, fy) = (_folded([h[j] for j in i], size) for h in (a, b))
                        most = _most(x, y, fx | fy, na[i], nb[i])
                        keep[i] = 100 * most >= percent * (na[i] + nb[i] - most)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    hists = _of_pairs(classes.select("cls", F.coalesce("fine", "hist").alias("hist"), "n"), pairs)
    sized = pairs.join(hists.select(F.col("cls").alias("a"), F.col("hist").alias("ha"), F.col("n").alias("na")), "a")
    sized = sized.join(hists.select(F.col("cls").alias("b"), F.col("hist").alias("hb"), F.col("n").alias("nb")), "b")
    return sized.where("100 * least(na, nb) >= %d * greatest(na, nb)" % percent).select("a", "b", "ha", "hb", "na", "nb").mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Of written pairs (a, b) of classes those that reach the similarity, by exact products of the rows of a hub (b) with the hub."""
    # One text stands for a class. Few documents are in a pair; their ids are broadcast if they are few indeed.
    needed = written(_of_pairs(classes.select("cls", "rep"), pairs), "needed")
    ids = F.broadcast(needed) if needed.count() <= FEW else needed
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("_text")).join(ids, "rep").select("cls", "_text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vec.chunks(batches, "_text"):
            sets = list(_sets(part.column("_text"), k))
            keep = [_class(s) == c for s, c in zip(sets, part.column("cls").to_pylist(), strict=True)]  # ids may repeat with other texts
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "grams"]).filter(pa.array(keep))

    sets = written(texts.mapInArrow(to_sets, "cls long, grams binary"), "sets")
    # A hub's rows may be many: they are dealt to parts of bounded size, each with a copy of the hub's row.
    size = pairs.groupBy("b").agg((1 + F.floor(F.count(F.lit(1)) / HUB_ROWS)).alias("parts"))
    members = written(pairs.join(size, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part")), "members")
    heads = members.select("b", "part").distinct()
    if members.count() <= FEW:
        members, heads = F.broadcast(members), F.broadcast(heads)
    rows = sets.withColumnRenamed("cls", "a").join(members, "a").select("b", "part", "a", "grams")
    heads = sets.withColumnRenamed("cls", "b").join(heads, "b").select("b", "part", F.lit(None).cast("long").alias("a"), "grams")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, grams = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b, found = [], [], []
            for x, y, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("grams"), strict=True):
                row = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                if x is None:
                    hub, grams = y, row
                    continue
                if hub != y:
                    raise ValueError("a block has no hub row")
                at = np.minimum(np.searchsorted(grams, row), len(grams) - 1)
                both = int((grams[at] == row).sum())
                if 100 * both >= percent * (len(row) + len(grams) - both):
                    a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.unionByName(heads).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first()).mapInArrow(product, "a long, b long")


def _apart(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of columns whose rows are in different partial components, with ``comp``."""
    known = rows.join(comps.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = known.groupBy("col").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("col")
    return known.join(mixed, "col")


def _near_hubs(rows: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Rows of columns with the column's other hubs whose sizes allow a link, in order."""
    near = F.transform(F.filter("hubs", lambda h: (100 * F.least(h["n"], F.col("n")) >= percent * F.greatest(h["n"], F.col("n"))) & (h["cls"] != F.col("cls"))), lambda h: h["cls"])
    return rows.join(hubs.select("col", "part", "hubs"), ["col", "part"]).withColumn("hubs", near).where(F.size("hubs") > 0)


def _first_hubs(rows: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(cls, hub): for each row the first hub of most of its columns."""
    met = _near_hubs(rows, hubs, percent).groupBy("cls", F.get("hubs", 0).alias("hub")).agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("cls").agg(F.max_by("hub", F.struct("n", (-_order("hub")).alias("k"), "hub")).alias("hub"))


def _other_hubs(apart: DataFrame, hubs: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(cls, hub): for each hub of columns in parts one row of each other partial component in these columns; not the same row for all hubs."""
    # A row meets the same hubs in many columns: they are gathered first.
    met = _near_hubs(apart, hubs, percent).groupBy("cls", "comp").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs")).select("cls", "comp", F.explode("hubs").alias("hub"))
    met = met.join(comps.select(F.col("node").alias("hub"), F.col("component").alias("other")), "hub", "left").withColumn("other", F.coalesce("other", "hub"))
    return met.where("comp <> other").groupBy("comp", "hub").agg(F.min_by("cls", F.struct(F.xxhash64("cls", "hub").alias("k"), "cls")).alias("cls")).select("cls", "hub")


def _missing(apart: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in one column, in different partial components, that histograms allow. apart is a written table."""
    few = apart.count() <= FEW
    # Columns with one first hub, such as those of a group of copies, go to few tasks, which make a pair that they share once.
    spread = apart.where("parts = 1").groupBy("hub").agg((1 + F.floor(F.count(F.lit(1)) / HUB_ENTRIES)).alias("tasks"))
    # The parts of a salted column have hubs of their own, but one task: (p, q) deals them out.
    task = F.when(F.col("parts") > 1, 0).otherwise(F.pmod(F.xxhash64("col"), F.coalesce("tasks", F.lit(1))))
    dealt = apart.join(F.broadcast(spread) if few else spread, "hub", "left").withColumn("task", task)
    ids = apart.select("cls").distinct()
    rows = dealt.join(classes.select("cls", "hist").join(F.broadcast(ids) if few else ids, "cls", "left_semi"), "cls")
    # Blocks of a salted column meet each other: a row goes to a pair of parts for each other part.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("col", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "n", "cls", F.when(F.col("parts") > 1, F.col("col")).otherwise(F.col("hub")).alias("hub"), "task", "comp", "hist")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()

        def blocks() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            n, cls, comp = (t.column(c).to_numpy() for c in ("n", "cls", "comp"))
            if len(n) < 2:
                return
            h = np.frombuffer(b"".join(t.column("hist").to_pylist()), dtype=np.uint8).reshape(-1, HIST)
            full = (h == 255).any(axis=1)
            for i in range(0, len(n), BLOCK):
                I = slice(i, i + BLOCK)
                for j in range(i, len(n), BLOCK):
                    if 100 * n[min(i + BLOCK, len(n)) - 1] < percent * n[j]:
                        break  # sorted by size: nothing further on can link
                    J = slice(j, j + BLOCK)
                    ok = comp[I, None] != comp[None, J]
                    ok &= 100 * np.minimum(n[I, None], n[None, J]) >= percent * np.maximum(n[I, None], n[None, J])
                    if i == j:
                        ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
                    x, y = np.nonzero(ok)
                    for c in range(0, len(x), 1 << 14):
                        xs, ys = x[c : c + (1 << 14)] + i, y[c : c + (1 << 14)] + j
                        most = _most(h[xs], h[ys], full[xs] | full[ys], n[xs], n[ys])
                        fits = 100 * most >= percent * (n[xs] + n[ys] - most)
                        pairs = set(zip(np.maximum(cls[xs], cls[ys])[fits].tolist(), np.minimum(cls[xs], cls[ys])[fits].tolist(), strict=True)) - seen
                        if len(seen) > SEEN:  # only saves work: repeated pairs are dropped later
                            seen.clear()
                        seen.update(pairs)
                        if pairs:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["x", "y"])

        for batch, new in _groups(batches, ["col", "p", "q"]):
            cuts = np.flatnonzero(new).tolist()
            at = 0
            for c in cuts:
                if c > at:
                    held.append(batch.slice(at, c - at))
                if held:
                    yield from blocks()
                held, at = [], c
            held.append(batch.slice(at))
        if held:
            yield from blocks()

    found = rows.repartition("hub", "task", "p", "q").sortWithinPartitions("hub", "task", "col", "p", "q", "n", "cls").mapInArrow(run, "x long, y long")
    return _pairs(found, "x", "y")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document: its set's size ``n_shingles`` and ``component_id``, the least id it reaches by links."""
    docs = docs.select(id_col, text_col)
    rows = written(_rows(docs, id_col, text_col, k, percent, _counts(docs, text_col, k)), "rows")
    classes = written(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first("hist", ignorenulls=True).alias("hist"), F.first("fine", ignorenulls=True).alias("fine"), F.first("n").alias("n"), F.min("_id").alias("rep")), "classes")
    entries = rows.where("prefix IS NOT NULL").select("cls", "n", F.explode(F.arrays_zip("prefix", "salts")).alias("e"))
    entries = entries.select(F.col("e.prefix").alias("col"), F.when(F.col("e.salts") > 1, F.pmod(F.xxhash64("cls"), F.col("e.salts").cast("long"))).otherwise(0).cast("int").alias("part"), F.col("e.salts").cast("int").alias("parts"), "n", "cls")
    columns = written(_columns(entries), "columns")
    ids, reps = written(rows.select("_id", "n", "cls"), "ids"), written(classes.select("cls", "rep"), "reps")
    remove(rows)  # each table goes as soon as nothing needs it any more
    hubs = columns.where("cls IS NULL").select("col", "part", "parts", "size", "sum", "hubs")
    # Columns with the same rows have the same pairs: one stands for all. Salted ones are kept.
    chosen = hubs.groupBy("size", "sum", F.when(F.col("parts") > 1, F.col("col")).alias("own"), F.when(F.col("parts") > 1, F.col("part")).alias("own_part"))
    hubs = written(chosen.agg(F.min_by(F.struct("col", "part", "hubs"), F.struct("col", "part")).alias("c")).select("size", "c.*"), "hubs")
    rows_of = columns.where("cls IS NOT NULL").select("col", "part", "parts", "n", "cls").join(hubs.select("col", "part", "size", F.get("hubs", 0)["cls"].alias("hub")), ["col", "part"])
    members = written(rows_of, "members")
    remove(columns)
    # Salted parts of a column are joined by their first hubs.
    split = members.where("parts > 1 AND cls = hub").select("col", "n", "cls")
    tops = split.groupBy("col").agg(F.min("cls").alias("top"))
    across = split.join(tops, "col").select("cls", F.col("top").alias("hub")).where("cls <> hub")
    tried = written(_pairs(_first_hubs(members, hubs, percent).unionByName(across), "cls", "hub"), "tried")
    likely = written(_may_link(tried, classes, percent), "likely")
    links = written(_linked(docs, id_col, text_col, likely, classes, k, percent), "links")
    remove(likely)
    partial = written(components(links), "partial")
    # More hubs, for columns that are still in parts.
    apart = written(_apart(members, partial), "apart")
    remove(members)
    more = written(_pairs(_other_hubs(apart, hubs, partial, percent), "cls", "hub").join(tried, ["a", "b"], "left_anti"), "more")
    remove(hubs)
    remove(partial)
    likely = written(_may_link(more, classes, percent), "likely")
    second = written(_linked(docs, id_col, text_col, likely, classes, k, percent), "links")
    remove(likely)
    links = links.unionByName(second)
    partial = written(components(links), "partial")
    narrowed = written(_apart(apart.drop("comp"), partial), "apart")
    remove(apart)
    remove(partial)
    rest = written(_missing(narrowed, classes, percent).join(tried.unionByName(more), ["a", "b"], "left_anti"), "missing")
    for t in (narrowed, tried, more):
        remove(t)
    likely = written(_may_link(rest, classes, percent), "likely")
    remove(rest)
    links = links.unionByName(written(_linked(docs, id_col, text_col, likely, classes, k, percent), "links"))
    remove(likely)
    remove(classes)
    named = links.join(reps.select(F.col("cls").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("cls").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(named)
    found = ids.join(reps, "cls", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the least id, with all columns; rows that repeat its id stay with it, and those without an id all stay."""
    found = jaccard_components(docs, id_col, text_col, k, percent)
    first = found.where((F.col("component_id") == F.col(id_col)) | F.col(id_col).isNull()).select(F.col(id_col).alias("_first")).distinct()
    return docs.join(first, docs[f"`{id_col}`"].eqNullSafe(first["_first"]), "left_semi")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component."""
    return keep_one_of_each(docs)


QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}
SQL = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id)"""
}
